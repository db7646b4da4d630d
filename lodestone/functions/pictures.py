"""Width and height of pictures from their first bytes, as Column expressions over binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JPEG segments that are looked through for the frame; a file has a few, or some hundreds with embedded profiles.
SEGMENTS = 4096


def big_endian(content: Column, at: Column | int, n: int) -> Column:
    """The number in ``n`` bytes from byte ``at`` (from 0); null beyond the content's end."""
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.substring(content, at + 1, F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def little_endian(content: Column, at: int, n: int) -> Column:
    total = F.lit(0)
    for i in range(n):
        total = total + big_endian(content, at + i, 1) * (1 << 8 * i)
    return total


def _jpeg(content: Column) -> Column:
    """Walk from marker to marker: a frame's segment holds height and width, any other its length; 0xFF may be repeated before a marker."""
    none = F.lit(None).cast("long")

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        marker = big_endian(content, at + 1, 1)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        # without a length: fill bytes, restarts, the start of the picture
        alone = marker.between(0xD0, 0xD8) | (marker == 0x01)
        broken = F.coalesce(big_endian(content, at, 1) != 0xFF, F.lit(True)) | marker.isNull() | marker.isin(0xD9, 0xDA)
        onward = F.when(marker == 0xFF, at + 1).when(alone, at + 2).otherwise(at + 2 + big_endian(content, at + 2, 2))
        done = lambda w, h: F.struct(none.alias("at"), w.alias("width"), h.alias("height"))
        walked = F.when(broken, done(none, none)).when(frame, done(big_endian(content, at + 7, 2), big_endian(content, at + 5, 2)))
        return F.when(at.isNull(), state).otherwise(walked.otherwise(F.struct(onward.alias("at"), none.alias("width"), none.alias("height"))))

    start = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(SEGMENTS), (F.octet_length(content) / 4).cast("int"))))
    return F.aggregate(steps, start, step)


def picture_size(content: Column) -> Column:
    """struct<width: long, height: long> of a PNG, GIF, BMP, lossy, lossless or extended WebP or JPEG; null fields where the bytes don't say."""
    head = F.hex(F.substring(content, 1, 30))
    size = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    walked = _jpeg(content)
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    kind = F.substring(head, 25, 8)
    bits = little_endian(content, 21, 4)
    lossless = size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1)
    lossy = size(little_endian(content, 26, 2).bitwiseAND(0x3FFF), little_endian(content, 28, 2).bitwiseAND(0x3FFF))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), size(big_endian(content, 16, 4), big_endian(content, 20, 4)))
        .when(head.startswith("47494638"), size(little_endian(content, 6, 2), little_endian(content, 8, 2)))
        .when(head.startswith("424D"), size(little_endian(content, 18, 4), little_endian(content, 22, 4)))
        .when(webp & (kind == "56503858"), size(little_endian(content, 24, 3) + 1, little_endian(content, 27, 3) + 1))
        .when(webp & (kind == "5650384C"), lossless)
        .when(webp & (kind == "56503820"), lossy)
        .when(head.startswith("FFD8"), size(walked["width"], walked["height"]))
        .otherwise(size(F.lit(None), F.lit(None)))
    )

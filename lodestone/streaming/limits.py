"""Keyed state: token buckets, breakers, windows; in batch, and as streams."""

from __future__ import annotations

import contextlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANONYMOUS, SIGNED_IN = (40_000.0, 0.463), (100_000.0, 1.157)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch; the session's time zone should be UTC for zone-less times."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def spend(state: tuple[float, float, float] | None, t: float, cost: float, capacity: float, rate: float, ttl: float) -> tuple[bool, tuple[float, float, float]]:
    """One request against (tokens, time, expiry): refill, allow if there is enough, and keep the refill if not.  Only an allowed request renews the expiry."""
    tokens, last, expiry = state if state is not None and t < state[2] else (capacity, t, t + ttl)
    tokens = min(capacity, tokens + max(0.0, t - last) * rate)
    if tokens >= cost:
        return True, (tokens - cost, t, t + ttl)
    return False, (tokens, t, expiry)


def token_bucket(events: DataFrame, key: str, t: str, order: str, cost: str, capacity: float, rate: float, ttl: float = 86_400.0) -> DataFrame:
    """(key, order, allowed, tokens) for each of ``events``, whose column ``t`` holds seconds; ties in time go by ``order``.

    Tasks walk their sorted rows and carry the state of one key, so that a key may have more rows than memory holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            allowed, tokens = [], []
            at, costs = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))  # null as NaN
            for k, x, c in zip(b.column(0).to_pylist(), at.tolist(), costs.tolist(), strict=True):
                if k != now and (k == k or now == now):  # NaN is one key
                    now, state = k, None
                ok, state = spend(state, x, c, capacity, rate, ttl)
                allowed.append(ok)
                tokens.append(state[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(allowed, pa.bool_()), pa.array(tokens, pa.float64())], [key, order, "allowed", "tokens"])

    kinds = dict(events.dtypes)
    rows = events.select(key, order, F.col(t).cast("double").alias("_t"), F.col(cost).cast("double").alias("_cost"))
    walk = rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last("_t"), F.asc_nulls_last(order))
    return walk.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, tokens double")


def _in_order(batches: Iterator[pd.DataFrame], by: list[str], run_rows: int = 200_000, piece: int = 2_000) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` by ``by``, nulls last, in frames of bounded size; what exceeds ``run_rows`` is sorted through files."""
    with contextlib.ExitStack() as files:
        runs: list[Any] = []
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= run_rows:
                runs.append(files.enter_context(tempfile.TemporaryFile()))
                pdf = pd.concat(held).sort_values(by, kind="stable")
                for i in range(0, len(pdf), piece):
                    pickle.dump(pdf.iloc[i : i + piece], runs[-1])
                runs[-1].seek(0)
                held = []
        last = [pd.concat(held).sort_values(by, kind="stable")] if held else []
        if not runs:
            yield from last
            return

        def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, ...]]:
            for pdf in frames:
                keys = [[(x is None or x != x, 0 if x is None or x != x else x) for x in pdf[c].tolist()] for c in by]
                yield from zip(zip(*keys, strict=True), pdf.itertuples(index=False, name=None), strict=True)

        def pieces(file: Any) -> Iterator[pd.DataFrame]:
            with contextlib.suppress(EOFError):
                while True:
                    yield pickle.load(file)

        merged = heapq.merge(*[rows(pieces(f)) for f in runs], rows(iter(last)), key=lambda x: x[0])
        while some := list(itertools.islice(merged, piece)):
            yield pd.DataFrame([x for _, x in some], columns=b.columns)


def token_bucket_stream(events: DataFrame, key: str, t: str, order: str, cost: str, capacity: float, rate: float, ttl: float = 86_400.0, idle: float | None = None) -> DataFrame:
    """token_bucket() over a stream; each key's state is (tokens, time, expiry).  Rows of a key that come together are put in order through files when they are many.

    idle: seconds without a request after which a key's state is dropped, by the clock; None keeps it for ever.  A bucket
    is full after ``ttl`` anyway, so an ``idle`` well above it changes nothing for a stream that isn't far behind.
    """

    def run(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        for pdf in _in_order(batches, [t, order]):
            out = []
            for o, at, c in zip(pdf[order], pdf[t], pdf[cost], strict=True):
                ok, now = spend(now, at, c, capacity, rate, ttl)
                out.append((k[0], o, ok, now[0]))
            state.update(now)
            if idle is not None:
                state.setTimeoutDuration(int(idle * 1000))
            yield pd.DataFrame(out, columns=[key, order, "allowed", "tokens"])

    kinds = dict(events.dtypes)
    return events.select(key, t, order, cost).groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, tokens double", "tokens double, last double, expiry double", "append",
        GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def sliding_counts(events: DataFrame, key: str, t: str, span: int, limit: int) -> DataFrame:
    """``events`` with in_window, the number of the key's events in the ``span`` seconds up to each (itself included), and allowed."""
    w = Window.partitionBy(key).orderBy(F.col(t)).rangeBetween(-span, 0)
    return events.withColumn("in_window", F.count("*").over(w)).withColumn("allowed", F.col("in_window") <= limit)


def weighted_window(events: DataFrame, key: str, t: str, span: int) -> DataFrame:
    """(key, slot, n, estimate): counts of fixed windows, and the estimate at a window's end from itself and its predecessor."""
    n = events.groupBy(key, F.floor(F.col(t) / span).alias("slot")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy(key).orderBy("slot"))
    near = F.lag("slot").over(Window.partitionBy(key).orderBy("slot")) == F.col("slot") - 1
    return n.withColumn("estimate", F.col("n") + F.when(near, before).otherwise(0) * 0.5)


def breaker_open(events: DataFrame, key: str, t: str, order: str, trips: Column, ttl: float) -> DataFrame:
    """``events`` with open: whether an earlier trip of the key is younger than ``ttl`` seconds."""
    w = Window.partitionBy(key).orderBy(t, order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("open", F.coalesce(F.max(F.when(trips, F.col(t) + ttl)).over(w) > F.col(t), F.lit(False)))


def next_model(priorities: DataFrame, broken: DataFrame, by: list[str]) -> DataFrame:
    """(by..., model): the first model by priority without a live breaker, from ``priorities`` (by..., model, priority)."""
    return priorities.join(broken, [*by, "model"], "left_anti").groupBy(*by).agg(F.min_by("model", "priority").alias("model"))


def fallback_model(broken: DataFrame, priority: list[str], by: list[str], *, failed: Column | int = 0, anonymous: Column | bool = False, title: Column | bool = False, cheap: str = "groq/") -> DataFrame:
    """(by..., model) for each row of ``broken`` (by..., models: array of those with a live breaker): the next of ``priority`` that isn't broken.

    The search skips ``failed`` models.  Anonymous users start at the first cheap model; titles go through the cheap ones
    backwards.  Null if there is none left.
    """
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    names = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    few = [m for m in priority if m.startswith(cheap)]
    first = next((i for i, m in enumerate(priority) if m.startswith(cheap)), len(priority))
    space = F.when(flag(title), names(few[::-1])).when(flag(anonymous), names(priority[first:])).otherwise(names(priority))
    left = F.filter(F.slice(space, flag(failed) + 1, len(priority) or 1), lambda m: ~F.array_contains(F.coalesce("models", names([])), m))
    return broken.select(*by, F.get(left, F.lit(0)).alias("model"))


def active_streams(events: DataFrame, key: str, t: str, now: Column, span: float = 3600.0) -> DataFrame:
    """(key, started) of the streams that were registered and neither finished, cancelled nor, for ``span`` seconds, forgotten: events (key, kind, t), the last of a key counts."""
    last = events.groupBy(key).agg(F.max_by("kind", t).alias("kind"), F.max(t).alias("started"))
    return last.where((F.col("kind") == "start") & (now - F.col("started") <= span)).select(key, "started")


def tool_calls(deltas: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by..., idx, id, name, arguments, signature) from a stream's ``deltas`` (by..., order, idx, id, name, arguments, signature): pieces joined in order, of signatures the last."""
    pieces = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "id", "name", "arguments")))
    joined = lambda f: F.array_join(F.transform("_p", lambda x: x[f]), "").alias(f)
    last = F.max_by("signature", F.when(F.col("signature").isNotNull(), F.col(order))).alias("signature")
    return deltas.groupBy(*by, "idx").agg(pieces.alias("_p"), last).select(*by, "idx", joined("id"), joined("name"), joined("arguments"), "signature")


def expired(sessions: DataFrame, t: str, now: Column, span: float = 3600.0) -> DataFrame:
    return sessions.where(now - F.col(t) > span)


def windowed(events: DataFrame, ts: str, width: str, late: str, by: list[str], *aggregates: Column) -> DataFrame:
    """Tumbling windows over event time with a watermark; ``ts`` may be zone-less."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).groupBy(F.window("_ts", width), *by).agg(*aggregates)

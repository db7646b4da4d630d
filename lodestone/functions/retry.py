"""What a provider's rate-limit error says about waiting."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import duration_seconds, seconds_to_midnight

T = TypeVar("T")
_BODY = "struct<error:struct<details:array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string>>>>>>"


def retry_details(remaining: Column, retry_after: Column, reset_requests: Column, reset_tokens: Column, body: Column, message: Column, at: Column) -> Column:
    """struct<limit_type, wait_seconds>: RPD (a day's requests are spent) or RPM_OR_TPM.

    If the headers count requests they decide: retry-after, else the reset that applies, else 5 s.
    Otherwise the JSON body's details do, then the message ("retry in 3.5s"), then the time to
    midnight for a day's limit and 600 s for any other.
    """
    spent = remaining == "0"
    set_ = lambda c: F.when(F.length(c) > 0, c)
    by_header = F.coalesce(set_(retry_after).try_cast("double"), F.when(spent, duration_seconds(set_(reset_requests))), duration_seconds(set_(reset_tokens)), F.lit(5.0))
    details = F.coalesce(F.from_json(body, _BODY)["error"]["details"], F.expr("cast(array() as array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string>>>>)"))
    per_day = F.exists(details, lambda d: F.coalesce(d["@type"].contains("QuotaFailure") & F.exists(d["violations"], lambda v: F.coalesce(v["quotaId"].contains("PerDay"), F.lit(False))), F.lit(False)))
    delays = F.filter(details, lambda d: F.coalesce(d["@type"].contains("RetryInfo") & (F.length(d["retryDelay"]) > 0), F.lit(False)))
    said = F.nullif(F.regexp_extract(message, r"(?i)retry in ([\d.]+)s", 1), F.lit("")).try_cast("double")
    by_body = F.coalesce(F.when(F.size(delays) > 0, duration_seconds(F.try_element_at(delays, F.lit(-1))["retryDelay"])), said, F.when(per_day, seconds_to_midnight(at)), F.lit(600.0))
    day = F.when(remaining.isNotNull(), spent).otherwise(per_day)
    return F.struct(F.when(day, "RPD").otherwise("RPM_OR_TPM").alias("limit_type"), F.round(F.when(remaining.isNotNull(), by_header).otherwise(by_body), 2).alias("wait_seconds"))


def retrying(call: Callable[[], T], *, retries: int = 5, base: float = 2.0, transient: tuple[type[Exception], ...] = (OSError,), wait: Callable[[float], None] = time.sleep) -> T:
    """What ``call`` returns, tried again after base ** n seconds (n from 0) as often as ``retries`` allows while it fails for a while; for uploads from a task."""
    for n in range(retries):
        try:
            return call()
        except transient:
            wait(base**n)
    return call()

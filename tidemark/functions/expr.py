"""Scalar expressions: probabilities, scores, buckets, times, costs."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 0.001
SECONDS = {"d": 86400, "h": 3600, "m": 60}


def clip(p: Column, epsilon: float = EPSILON) -> Column:
    """p within [epsilon, 1 - epsilon]; a null gives epsilon, since neither bound skips the other for a null."""
    return F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    """Without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def brier(p: Column, y: Column) -> Column:
    return F.pow(p - y, F.lit(2.0))


def log_loss(p: Column, y: Column, epsilon: float = EPSILON) -> Column:
    c = clip(p, epsilon)
    return -(y * F.log(c) + (1 - y) * F.log(1 - c))


def bin_index(p: Column, bins: int) -> Column:
    """Fixed-width bins; 1 belongs to the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries from a to b, as whole seconds: not the elapsed time rounded down."""
    return F.floor(micros(b) / 1_000_000) - F.floor(micros(a) / 1_000_000)


def elapsed_seconds(a: Column, b: Column) -> Column:
    """Elapsed time from a to b with its fraction."""
    return (micros(b) - micros(a)) / 1e6


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return ts + F.make_dt_interval(secs=s.cast("decimal(18,6)"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def left_closed_bucket(x: Column, edges: list[float], labels: list[str], missing: str = "missing") -> Column:
    """The label of the first edge above x; nulls are ``missing``."""
    out = F.when(x.isNull(), F.lit(missing))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x < edge, F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))


def right_closed_bucket(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge not below x; nulls stay null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(x <= edge, F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))


def outcome_number(outcome: Column) -> Column:
    return F.when(outcome == "yes", 1).when(outcome == "no", 0)


def taker_fee(rate: Column, price: Column) -> Column:
    return rate * price * (1 - price)


def lockup_cost(cost: Column, annual_rate: float, seconds: Column, day_count: int = 365) -> Column:
    return cost * annual_rate * F.greatest(seconds, F.lit(0.0)) / (day_count * 86400.0)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """All reasons whose mask is true or null, joined by semicolons; '' without any."""
    return F.concat_ws(";", *[F.when(F.coalesce(mask, F.lit(True)), F.lit(name)) for mask, name in pairs])


def first_reason(*pairs: tuple[Column, str]) -> Column:
    """The first reason whose mask is true; null without any. A null mask is not a reason."""
    return F.coalesce(*[F.when(F.coalesce(mask, F.lit(False)), F.lit(name)) for mask, name in pairs])


def keywords_pattern(keywords: list[str]) -> str:
    return "(?i)" + "|".join(map(re.escape, keywords))


def parse_duration(text: str) -> int:
    """Seconds of ``7d``, ``6h``, ``15m``; ``close`` is a minute before the end."""
    if text == "close":
        return 60
    m = re.fullmatch(r"(\d+)([dhm])", text.strip())
    if not m or not int(m[1]):
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * SECONDS[m[2]]


def format_duration(seconds: int) -> str:
    for unit, size in SECONDS.items():
        if seconds % size == 0:
            return f"{seconds // size}{unit}"
    return f"{seconds}s"


def parse_months(text: str) -> int:
    """Months of a window such as ``1month`` or ``3months``."""
    m = re.fullmatch(r"(\d+)\s*months?", text.strip())
    if not m or not int(m[1]):
        raise ValueError(f"no month window: {text!r}")
    return int(m[1])


def parse_timestamp(value: str | float | dt.datetime) -> dt.datetime:
    """An aware UTC time. Numbers from 1e10 on are milliseconds, smaller ones seconds; texts and times need an offset."""
    if isinstance(value, bool):
        raise ValueError("no timestamp")
    if isinstance(value, (int, float)):
        return dt.datetime.fromtimestamp(value / 1000 if abs(value) >= 1e10 else value, dt.UTC)
    at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    if at.tzinfo is None:
        raise ValueError(f"{value!r} has no time zone")
    return at.astimezone(dt.UTC)


def timestamp_of(text: Column) -> Column:
    """:func:`parse_timestamp` as an expression; null for what isn't a time with an offset."""
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) >= 1e10, number / 1000).otherwise(number)
    stamped = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))
    return F.when(number.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(stamped)

"""Expressions over measures: nearest-rank percentiles, durations, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per million tokens (cache miss, cache hit, output).
PRICES = {"deepseek-v4-flash": (0.14, 0.0028, 0.28), "deepseek-v4-pro": (0.435, 0.003625, 0.87), "deepseek-chat": (0.14, 0.0028, 0.28)}
# Seconds of a unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def rank_of(p: float, n: Column) -> Column:
    """The place, from 1, of percentile p of n sorted values: half-even rounding of p (n - 1)."""
    return F.bround(F.lit(p) * (n - 1)).cast("long") + 1


def cost(model: Column, hit: Column, miss: Column, output: Column) -> Column:
    out = F.lit(0.0)
    for name, (m, h, o) in PRICES.items():
        out = F.when(model == name, miss / 1e6 * m + hit / 1e6 * h + output / 1e6 * o).otherwise(out)
    return out


def seconds(text: Column) -> Column:
    """Of 30m, 2h, 1d, 90s or bare seconds; blank is null, another unit an error."""
    t = F.lower(F.trim(text))
    unit = F.regexp_extract(t, r"([smhd])$", 1)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)[smhd]?$", 1)
    factor = F.lit(1)
    for k, v in UNITS.items():
        factor = F.when(unit == k, v).otherwise(factor)
    return F.when((t == "") | t.isNull(), None).when(number == "", F.raise_error(F.concat(F.lit("not a duration: "), text)).cast("double")).otherwise(number.cast("double") * factor)


def redact(text: Column) -> Column:
    """The length and the first eight digits of the digest of a text; empty texts have no digest."""
    digest = F.substring(F.sha2(text, 256), 1, 8)
    return F.when(text == "", "<redacted:len=0>").otherwise(F.concat(F.lit("<redacted:len="), F.length(text).cast("string"), F.lit(":"), digest, F.lit(">")))

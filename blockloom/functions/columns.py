"""Column expressions used by several operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

# Day names in the Sunday = 0 order of the stored tables.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
SHORT_DAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
# Satoshi per coin and rows of a height bucket.
SATOSHI = 100_000_000
HEIGHT_BUCKET = 50_000

AsOf = Column | datetime | str


def moment(as_of: AsOf) -> Column:
    """An explicit "now": a column (often a scalar subquery), a datetime or a timestamp text."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def newest(df: DataFrame, ts: str = "timestamp") -> Column:
    """Newest time of a table as an uncorrelated scalar subquery, so nothing runs while planning."""
    return df.select(F.max(ts)).scalar()


def seconds(text: str) -> int:
    """Seconds of an interval text such as ``12H``, ``7d``, ``4W``, ``90 days`` or ``6 months`` (30-day months)."""
    digits = "".join(c for c in text if c.isdigit())
    unit = text.replace(digits, "", 1).strip().lower()
    sizes = {"h": 3600, "d": 86400, "w": 604800, "mo": 2592000, "mi": 60, "s": 1}
    for prefix in ("mo", "mi", "h", "d", "w", "s"):
        if digits and unit.startswith(prefix):
            return int(digits) * sizes[prefix]
    raise ValueError(f"not an interval: {text!r}")


def span(secs: int) -> Column:
    return F.expr(f"INTERVAL {int(secs)} SECONDS")


def output_address(script: Column) -> Column:
    """Address of an output script: ``address``, else the first of ``addresses``, else the script text."""
    return F.coalesce(script["address"], F.get(script["addresses"], F.lit(0)), script["asm"])


def listed_address(script: Column) -> Column:
    """Address rule of the repair path: first of ``addresses``, else ``address``, never the script text."""
    return F.coalesce(F.get(script["addresses"], F.lit(0)), script["address"])


def to_satoshi(amount: Column) -> Column:
    """Exact satoshi of a decimal amount (no binary floats on the way)."""
    return (amount.cast("decimal(16,8)") * F.lit(SATOSHI)).cast("bigint")


def height_bucket(height: Column) -> Column:
    return (F.floor(height / HEIGHT_BUCKET) * HEIGHT_BUCKET).cast("int")


def utc_day(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def sunday_first(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1).cast("int")


def pick_name(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index)


def where_height(df: DataFrame, low: int, high: int, column: str = "block_height") -> DataFrame:
    """Height range filter that also prunes ``height_bucket`` folders when the table has them."""
    keep = df.where(F.col(column).between(low, high))
    if "height_bucket" in df.columns:
        first, last = (v // HEIGHT_BUCKET * HEIGHT_BUCKET for v in (low, high))
        keep = keep.where(F.col("height_bucket").between(first, last))
    return keep


def event_hash(txid: Column, usd: Column) -> Column:
    """sha256 of ``txid-usd`` with the amount printed as a two-digit decimal, stable across engines."""
    return F.sha2(F.concat_ws("-", txid, usd.cast("decimal(20,2)").cast("string")), 256)

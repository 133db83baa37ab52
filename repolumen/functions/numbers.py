"""Display numbers, costs, limits and waits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars per million tokens by kind of embedding endpoint.
USD_PER_MILLION_TOKENS = {
    "batch_endpoint": 0.005,
    "realtime": 0.01,
    "async_batch": 0.005,
}
DEFAULT_LIMIT = 10
MAX_LIMIT = 50
FORK_FACTOR = 5


def fixed_text(value: Column, digits: int) -> Column:
    """Fixed number of digits, rounded on the exact binary value, ties away from zero.

    Only multiples of 1 / 2**(digits + 1) can be ties; they are moved up by half
    a unit, all others are rounded by the formatter.
    """
    size = F.abs(value.cast("double"))
    is_tie = (size * float(2 ** (digits + 1))) % 2 == 1
    moved = F.when(is_tie, size + 0.5 * 10.0**-digits).otherwise(size)
    pattern = "0" + ("." + "0" * digits if digits else "")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.call_function("format_number", moved, F.lit(pattern)))


def _drop_zero(text: Column) -> Column:
    return F.regexp_replace(text, r"\.0$", "")


def compact_number(n: Column) -> Column:
    """``999``, ``1k``, ``12.3k``: one digit, no trailing ``.0``."""
    kilo = F.concat(_drop_zero(fixed_text(n / 1000, 1)), F.lit("k"))
    return F.when(n >= 1000, kilo).otherwise(n.cast("string"))


def compact_count(n: Column) -> Column:
    """``999``, ``12k`` (no digits), ``3.4M`` (one digit)."""
    mega = F.concat(_drop_zero(fixed_text(n / 1_000_000, 1)), F.lit("M"))
    kilo = F.concat(fixed_text(n / 1000, 0), F.lit("k"))
    return F.when(n >= 1_000_000, mega).when(n >= 1000, kilo).otherwise(n.cast("string"))


def percent_text(score: Column) -> Column:
    return F.concat(fixed_text(score * 100, 0), F.lit("%"))


def token_cost(tokens: Column, usd_per_million: Column) -> Column:
    return tokens / F.lit(1_000_000.0) * usd_per_million


def estimated_tokens(total_chars: Column) -> Column:
    """Four characters count as one token."""
    return F.round(total_chars / 4).cast("long")


def requested_limit(text: Column, default: int = DEFAULT_LIMIT) -> Column:
    """Requested number of results: leading digits of the text, else the default. No cap."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return F.coalesce(number, F.lit(default))


def result_limit(text: Column, default: int = DEFAULT_LIMIT, cap: int = MAX_LIMIT) -> Column:
    """The same for the command line, which shows ``cap`` results at most."""
    return F.least(requested_limit(text, default), F.lit(cap))


def fetch_wait_seconds(attempt: Column) -> Column:
    """Wait after the zero-based failed attempt of a fetch."""
    return F.pow(F.lit(2.0), attempt)


def embed_wait_seconds(retries_left: Column) -> Column:
    """Wait before an embed retry, counted by the retries that are left (10 at first)."""
    return (F.lit(11) - retries_left) * 2

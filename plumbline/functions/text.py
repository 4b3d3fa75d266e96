"""Column expressions over text. All are total: null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = "(?U)^\\s+|\\s+$"


def canonical(c: Column | str) -> Column:
    """Lower case, every run of Unicode white space one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "(?U)\\s+", " "))


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, _EDGE, "")


def cleaned(c: Column | str) -> Column:
    """Stripped and in lower case; null where nothing is left."""
    return F.nullif(F.lower(stripped(c)), F.lit(""))


def duplicate_group(c: Column | str) -> Column:
    """SHA-1 of the canonical text in hexadecimal digits."""
    return F.sha1(canonical(c).cast("binary"))


def stable_rank(c: Column | str) -> Column:
    """The first 64 bits of `duplicate_group`. Their order as text is that of the unsigned number."""
    return F.substring(duplicate_group(c), 1, 16)


def hash_bucket(c: Column | str, buckets: int = 10_000) -> Column:
    """Bucket of a text by the first 32 bits of its hash."""
    return F.pmod(F.conv(F.substring(duplicate_group(c), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def strict_key(c: Column | str) -> Column:
    """Only letters, digits and underscores, in lower case."""
    return F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_]+", "")


def basename(c: Column | str) -> Column:
    """Last part of a path of either kind."""
    return F.element_at(F.split(c, "[\\\\/]"), -1)


def seeded(seed: str, c: Column | str) -> Column:
    """Pseudo-random hexadecimal order key of a value: the SHA-1 of seed, colon and value."""
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.col(c) if isinstance(c, str) else c).cast("binary"))

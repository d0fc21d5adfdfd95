"""Scalar rules of the lake as column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: epochs above this are microseconds, others milliseconds.
MICROS_ABOVE = 10_000_000_000_000
SECRET_WORDS = ("api_?key", "private_?key", "access_?key", "token", "secret", "password", "credential")


def epoch_to_timestamp(epoch: Column) -> Column:
    """Millisecond and microsecond epochs, mixed by row, as timestamps without zone."""
    c = epoch.cast("long")
    return F.timestamp_micros(F.when(c > MICROS_ABOVE, c).otherwise(c * 1000)).cast("timestamp_ntz")


def safe_double(text: Column) -> Column:
    """A number, or null where it is none."""
    return text.try_cast("double")


def day_number(seconds: Column) -> Column:
    return F.floor(seconds / 86_400).cast("long")


def identifier(text: Column) -> Column:
    """Lower case, with everything but letters, digits and underscores made an underscore."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]", "_")


def partition_map(path: Column) -> Column:
    """The key=value segments of a path, as a map in path order."""
    found = F.regexp_extract_all(path, F.lit(r"([^/=]+=[^/]*)(?=/)"), F.lit(1))
    return F.map_from_arrays(F.transform(found, lambda s: F.substring_index(s, "=", 1)), F.transform(found, lambda s: F.substring(s, F.instr(s, "=") + 1, F.length(s))))


def view_name(path: Column, root: Column) -> Column:
    """Root prefix and all partition values, joined by underscores."""
    found = F.regexp_extract_all(path, F.lit(r"([^/=]+=[^/]*)(?=/)"), F.lit(1))
    values = F.transform(found, lambda s: F.substring(s, F.instr(s, "=") + 1, F.length(s)))
    return F.translate(F.lower(F.array_join(F.concat(F.array(root), values), "_")), "-.", "__")


def digest_key(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def owner_slice(key: Column, workers: int) -> Column:
    """Which of ``workers`` owns a digest key: its first 32 bits, modulo."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(workers))


def finite(value: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(value), value)


def redacted(params: Column) -> Column:
    """A map with the values of keys that name a secret replaced by their length."""
    secret = lambda k: F.lower(k).rlike("|".join(SECRET_WORDS))
    return F.transform_values(params, lambda k, v: F.when(secret(k), F.concat(F.lit("<redacted "), F.length(v).cast("string"), F.lit(" chars>"))).otherwise(v))

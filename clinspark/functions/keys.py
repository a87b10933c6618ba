"""Row keys and repeatable pseudo-random numbers derived from them."""

from pyspark.sql import Column, functions as F

HASH_DIGITS = 4


def _text(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def key_hash(seed, *keys) -> Column:
    """md5 of the seed and the keys: the same value on any layout of the rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys]))


def uniform(seed, *keys) -> Column:
    """Uniform double in (0, 1) from the first 32 bits of the key hash."""
    word = F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("bigint")
    return (word + F.lit(0.5)) / F.lit(4294967296.0)


def hash_modulo(modulus, seed, *keys) -> Column:
    """Integer in [0, modulus) from the first 60 bits of the key hash."""
    word = F.conv(F.substring(key_hash(seed, *keys), 1, 15), 16, 10).cast("bigint")
    return F.pmod(word, modulus if isinstance(modulus, Column) else F.lit(modulus)).cast("bigint")


def joined_id(*parts) -> Column:
    """Dash-separated id such as note-start-end-label-task."""
    return F.concat_ws("-", *[_text(p) for p in parts])


def prefixed_reference(prefix: str, reference, reference_id) -> Column:
    """Reference text; `prefix/id` when the reference is empty and an id is known."""
    empty = F.coalesce(F.col(reference) if isinstance(reference, str) else reference, F.lit("")) == ""
    ident = F.col(reference_id) if isinstance(reference_id, str) else reference_id
    reference = F.col(reference) if isinstance(reference, str) else reference
    return F.when(empty & ident.isNotNull(), F.concat(F.lit(f"{prefix}/"), ident.cast("string"))).otherwise(reference)

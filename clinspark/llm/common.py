"""Small helpers shared by the operators of this folder."""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinspark.operators.stored import stored

# A word is a run of characters other than ASCII white space (Java and DuckDB regular expression).
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written to the shared checkpoint folder; the plan starts anew from them."""
    return stored(df)


def word_count(text: Column) -> Column:
    """Number of words as bigint; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("bigint")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't hold, whatever the case of the letters."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


# Most 64-bit words of a bit table that filters a scan; it is broadcast.
MOST_FILTER_WORDS = 1 << 17


def filter_words(wanted: int) -> int:
    """Size of a bit table for so many keys: 16 bits a key, so that few others pass, up to the bound; 0 where fewer than 2 bits a key are left."""
    words = 1 << max(10, math.ceil(math.log2(max(wanted, 1) / 4)))
    return min(words, MOST_FILTER_WORDS) if 2 * wanted <= 64 * MOST_FILTER_WORDS else 0


def may_be_among(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of `df` whose bigint key may be among the wanted keys (written rows, which are counted), without moving them.

    The wanted keys set bits of a table sized by their number, which is broadcast. Some other rows pass too; an exact join has to
    follow. Where the keys are too many for a table of bounded size, all rows pass and that join does the work alone.
    """
    words = filter_words(wanted.count())
    if not words:
        return df
    word, bit = free_name(df, "_word"), free_name(df, "_bit")

    def place(k):
        mixed = F.xxhash64(F.lit("filter"), k)
        return F.pmod(mixed, F.lit(words)).cast("int"), F.pmod(F.shiftright(mixed, 32), F.lit(64)).cast("int")

    wanted_word, wanted_bit = place(wanted_key)
    bits = wanted.select(wanted_word.alias("_key"), F.call_function("shiftleft", F.lit(1).cast("bigint"), wanted_bit).alias("_one"))
    bits = bits.groupBy("_key").agg(F.bit_or("_one").alias("_bits"))  # at most `words` rows
    own_word, own_bit = place(key)
    joined = df.withColumn(word, own_word).withColumn(bit, own_bit).join(F.broadcast(bits), F.col(word) == F.col("_key"))
    return joined.filter(F.call_function("shiftright", F.col("_bits"), F.col(bit)).bitwiseAND(F.lit(1)) == 1).select(*df.columns)

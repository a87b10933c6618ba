"""Names of a vocabulary in texts: a dictionary join of token runs, for vocabularies of any size."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.functions.text import fold_accents
from clinspark.operators.stored import stored

TOKEN = "[a-z0-9]+"
# Names of one regular expression, about.
CHUNK = 10_000
# Names up to which the vocabulary travels to the texts; a larger one and the token runs of the texts meet by key.
BROADCAST_NAMES = 100_000


def tokens(column) -> Column:
    """Runs of letters and digits of a text, lower-cased and without accents."""
    return F.regexp_extract_all(fold_accents(column), F.lit(TOKEN), 0)


def find_names(
    texts: DataFrame, names: DataFrame, key: str = "note_id", text: str = "note_text", name: str = "name", keep: Sequence[str] = ()
) -> DataFrame:
    """(key, at, name, keep): where the tokens of a name stand one after another in a text; `at` is the place of the first, from 0.

    Only as many token runs are made per place as names have different lengths, and they join the names as rows, so the cost does not grow with
    the vocabulary. The names are written once and counted: up to BROADCAST_NAMES of them go to the texts, and no token run is moved. What stands between tokens doesn't count. Names without tokens, null names and null texts match nothing; a name listed several
    times, with different columns to keep, gives a row for each.
    """
    listed = names.select(F.col(name).alias("name"), *keep, tokens(F.col(name)).alias("_tokens")).filter(F.size("_tokens") > 0).distinct()
    listed = stored(listed)
    few = listed.count() <= BROADCAST_NAMES
    lengths = listed.agg(F.sort_array(F.collect_set(F.size("_tokens")))).scalar()
    listed = listed.select(F.array_join("_tokens", " ").alias("_phrase"), "name", *keep)

    def runs(found):
        def at_place(at):
            fitting = F.filter(F.col("_lengths"), lambda n: at + n <= F.size(found))
            return F.transform(fitting, lambda n: F.struct(at.alias("at"), F.array_join(F.slice(found, at + 1, n), " ").alias("phrase")))

        places = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(places, at_place))

    source = texts.filter(F.col(text).isNotNull()).select(F.col(key), tokens(F.col(text)).alias("_tokens"))
    placed = source.withColumn("_lengths", lengths).select(key, F.explode(runs(F.col("_tokens"))).alias("_run"))
    placed = placed.select(key, F.col("_run.at").alias("at"), F.col("_run.phrase").alias("_phrase"))
    return placed.join(F.broadcast(listed) if few else listed, "_phrase").select(key, "at", "name", *keep)


def regex_chunks(names: DataFrame, by: Sequence[str], name: str = "name", chunk: int = CHUNK) -> DataFrame:
    """(by, chunk, names, regex): an alternation of the distinct names of each group, in chunks of about `chunk` names dealt by hash.

    No cell holds a whole vocabulary; a caller that wants expressions tries the chunks one by one.
    """
    distinct = names.filter(F.col(name).isNotNull()).select(*by, F.col(name).alias("name")).distinct()
    counts = distinct.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    dealt = distinct.join(counts, list(by)).withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("_chunks")).cast("int"))
    grouped = dealt.groupBy(*by, "chunk").agg(F.sort_array(F.collect_list("name")).alias("names"))
    quoted = F.transform(F.col("names"), lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E")))
    return grouped.withColumn("regex", F.concat(F.lit("(?i)(?:"), F.array_join(quoted, "|"), F.lit(")")))

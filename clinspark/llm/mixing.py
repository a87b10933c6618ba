"""Mixing sources to target weights with a low-discrepancy schedule of equal-sized blocks."""

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.llm.common import WORD_REGEX, checkpointed, word_count
from clinspark.operators.groups import series_rank

# Words of a block; a slot of the schedule takes one block of a source.
BLOCK_WORDS = 1024
# Hash buckets in which the documents of one source are put into their shuffled order.
BUCKETS = 4096
# Keys of repeated rows that are broadcast at most.
MOST_REPEATED = 100_000
# Sources, and slots, of one step of a running sum or of one row of work.
STEP = 4096
CHUNK = 1 << 16


def running_before(df: DataFrame, at: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows with a smaller `at` (dense numbers from 0): by steps first, whose sums are few, then inside a step."""
    rows = df.withColumn("_step", F.expr(f"{at} div {STEP}"))
    ahead = Window.orderBy("_at_step").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("_step").alias("_at_step")).agg(F.sum(value).alias("_sum"))
    sums = sums.select("_at_step", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_step").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, F.col("_step") == F.col("_at_step"))
    return joined.withColumn(name, F.col("_ahead") + F.col("_inside")).select(*df.columns, name)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share_percent: int = 150, most_repeats: int = 2
) -> DataFrame:
    """Target of each source: (source, source_size) -> (source, source_size, n, weight, target).

    Sources in code-point order (null last), numbered from 0, get `weights` in turn and share `share_percent` of all words. A target stops
    at `most_repeats` times the size of its source; what is over goes to the others by weight until none is above: the common level
    of words per weight rises until the sources above it are the same as before, a round being one aggregate. Sources may be very many:
    they are numbered in ranges, and only sums reach the driver.
    """
    named = sizes.select("source", F.col("source_size").cast("bigint").alias("source_size"), F.col("source").isNull().alias("_null"))
    listed = series_rank(named, [], ["_null", "source"], "_n").withColumn("n", F.col("_n") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    listed = listed.select("source", "source_size", "n", weight.alias("weight"), (F.col("source_size") * most_repeats).cast("double").alias("_most"))
    listed = checkpointed(listed)
    first = listed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    everything = (first["words"] or 0) * share_percent / 100.0
    level, capped = everything / first["weight"] if first["weight"] else 0.0, -1
    while True:
        over = F.col("_most") < F.lit(level) * F.col("weight")
        now = listed.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("_most"))).alias("words"), F.sum(F.when(~over, F.col("weight"))).alias("weight")
        ).first()
        if now["n"] == capped or not now["weight"]:
            level = math.inf if not now["weight"] else level
            break
        level, capped = (everything - (now["words"] or 0.0)) / now["weight"], now["n"]
    target = F.least(F.col("_most"), F.lit(level) * F.col("weight")) if math.isfinite(level) else F.col("_most")
    return listed.select("source", "source_size", "n", "weight", target.alias("target"))


def reversed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros_like(values)
    for k in range(bits):
        out |= ((values >> k) & 1) << (bits - 1 - k)
    return out


def ranks_in_range(slots: np.ndarray, points: np.ndarray, low: int, high: int, bits: int) -> np.ndarray:
    """How many earlier slots fall into [low, high): points are the slots with their bits reversed.

    The slots before i are, for each bit set in i, those that agree with i above that bit and have it unset: their points are one residue
    class, which is counted in closed form.
    """
    total = np.zeros_like(slots)
    for t in range(bits):
        step = np.int64(1) << (bits - t)
        least = points & ((step >> 1) - 1)
        count = (high - 1 - least) // step - (low - 1 - least) // step
        total += np.where((slots >> t) & 1 == 1, count, 0)
    return total


def schedule(needs: DataFrame) -> DataFrame:
    """(n, low, need) -> (n, rank, slot): which slot takes the block `rank` of the source n.

    `need` are the blocks of a source and `low` those of all sources before it. Slot i stands at the i-th van der Corput point, i with its
    bits reversed, of the first 2^m, the smallest power of two that is no less than the number of all blocks. The points are mapped through
    the cumulative needs; a source's slots, in their order, take its blocks, and slots beyond its last block stay empty. As there are at
    least as many points as blocks, each source has a slot for every block, and at every slot it is about as far as its share. Every
    source finds its slots and their ranks by itself, in pieces, so none is collected and no slot is held against every source.
    """
    total = needs.agg(F.sum("need")).first()[0] or 0
    bits = max(0, int(total - 1).bit_length()) if total else 0
    points = 1 << bits

    def pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for n, low, need in zip(*(batch.column(c).to_pylist() for c in ("n", "low", "need"))):
                first, last = -(-low * points // total), -(-(low + need) * points // total)
                starts = np.arange(first, last, CHUNK, dtype=np.int64)
                same = [pa.array(np.full(len(starts), v, np.int64)) for v in (n, need, first, last)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(starts)], names=["n", "need", "first", "last", "start"])

    def slots(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for n, need, first, last, start in zip(*(batch.column(k).to_pylist() for k in range(5))):
                at = np.arange(start, min(start + CHUNK, last), dtype=np.int64)
                slot = reversed_bits(at, bits)
                rank = ranks_in_range(slot, at, first, last, bits)
                keep = rank < need
                out = [np.full(int(keep.sum()), n, np.int64), rank[keep], slot[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=["n", "rank", "slot"])

    used = needs.filter("need > 0").select("n", "low", "need")
    cut = used.mapInArrow(pieces, "n bigint, need bigint, first bigint, last bigint, start bigint")
    return cut.repartition("n", "start").mapInArrow(slots, "n bigint, rank bigint, slot bigint")


def mix_key(doc_id: Column, text: Column, seed: int = 7) -> Column:
    return F.xxhash64(F.lit(seed), doc_id, text)


def stream_ranges(rows: DataFrame) -> DataFrame:
    """(source, bucket, key, doc_id, size) -> the same with `begin`, the words of the source that come before.

    Order is by hash of doc_id and text. Word counts are summed by (source, hash bucket), the sums of the buckets are
    accumulated, and rows are ordered inside buckets only, so a source with a third of all rows is spread over BUCKETS groups.
    """
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = numbered.alias("a").join(
        sums.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))
    )
    return joined.select("a.*", (F.col("_within") + F.col("_ahead")).cast("bigint").alias("begin")).drop("_within")


def _same_rows() -> Column:
    """Numbers rows of one doc_id and text, which are alike."""
    return F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(0)))


def _numbered(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with `nth` as the placed rows have it; only rows whose key occurs more than once are moved for it, if such keys are few."""
    repeated = checkpointed(placed.filter("nth > 1").select("key").distinct())
    n = repeated.count()
    if n > MOST_REPEATED:
        return rows.withColumn("nth", _same_rows())
    if not n:
        return rows.withColumn("nth", F.lit(1))
    single = rows.join(F.broadcast(repeated), "key", "left_anti").withColumn("nth", F.lit(1))
    return single.unionByName(rows.join(F.broadcast(repeated), "key", "left_semi").withColumn("nth", _same_rows()))


def _planned(docs, weights, share_percent, most_repeats, block_words, text_column) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the stream of their source, and the copies that the schedule takes of them."""
    text = F.col(text_column)
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), mix_key(F.col("doc_id"), text).alias("key"))
    rows = rows.withColumns({"bucket": F.pmod(F.shiftright("key", 40), F.lit(BUCKETS)).cast("int"), "nth": _same_rows()})
    rows = checkpointed(rows)  # narrow; texts are read once
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most_repeats)
    words = F.greatest(F.round("target").cast("bigint"), (F.col("target") > 0).cast("bigint"))
    words = F.least(words, F.col("source_size") * most_repeats)
    targets = targets.withColumn("words", words).withColumn("need", F.expr(f"(words + {block_words - 1}) div {block_words}"))
    needs = checkpointed(running_before(targets, "n", "need", "low"))
    timetable = checkpointed(schedule(needs))
    plan = needs.select(F.col("source").alias("_source"), "n", "source_size", "target", "words")
    placed = stream_ranges(rows).join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = checkpointed(placed)
    # The source's stream starts over at its end; a document has a stretch of words in every pass that reaches it.
    passes = F.expr("sequence(0L, (words - 1) div source_size)")
    turns = placed.filter("size > 0 and words > 0").withColumn("turn", F.explode(passes))
    begin = F.col("turn") * F.col("source_size") + F.col("begin")
    turns = turns.withColumn("first", begin).withColumn("last", F.least(begin + F.col("size"), F.col("words"))).filter("last > first")
    blocks = turns.withColumn("rank", F.explode(F.expr(f"sequence(first div {block_words}, (last - 1) div {block_words})")))
    part = F.least(F.col("last"), (F.col("rank") + 1) * block_words) - F.greatest(F.col("first"), F.col("rank") * block_words)
    met = blocks.withColumn("part", part).join(timetable, ["n", "rank"])
    copies = met.groupBy("doc_id", "key", "nth", "size", "turn").agg(F.sum("part").alias("words"), F.min(F.struct("rank", "slot")).alias("_first"))
    return placed, copies.select("doc_id", "key", "nth", "size", "turn", "words", F.col("_first.slot").alias("slot"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share_percent: int = 150,
    most_repeats: int = 2,
    block_words: int = BLOCK_WORDS,
    text_column: str = "text",
) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken, copies and slot.

    The documents of a source, in a shuffled order that repeats, are one stream of words, cut into blocks of `block_words`; it starts over at
    its end. The slots of the schedule take the blocks, the last one up to the source's target, rounded to whole words (at least one if it
    has any). `taken` are the words of the document in the taken blocks, `copies` the passes that have some of them, and `slot` the
    first slot that takes some (null where none does).

    Null or empty texts have size 0 and are taken 0 words; a null source is a source of its own; repeated rows count
    each; an empty table gives no rows. Extra columns are not read. Every order is total up to rows that are alike, so reruns
    agree. The cut may end inside a document.
    """
    placed, copies = _planned(docs, weights, share_percent, most_repeats, block_words, text_column)
    taken = copies.groupBy(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "key", "nth")]).agg(
        F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies"), F.min("slot").alias("slot")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("nth") == F.col("_nth"))
    zero = F.lit(0).cast("bigint")
    return placed.join(taken, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("copies", zero).alias("copies"), "slot"
    )


def mixed_documents(docs: DataFrame, length_column: str | None = "n_chars", text_column: str = "text", **options) -> DataFrame:
    """The mix itself, in the order of its slots: the rows of `docs` as often as the mix takes them, unchanged but for cut texts.

    A document taken in several passes gives several rows. Where the words of a source end inside a document, that copy's text is
    its first words joined by single blanks, and `length_column`, if there is such a column, holds the new length. Documents without words
    aren't in the mix. Columns of any name pass through; edge cases as in `mix`.
    """
    options = {"weights": (5, 2, 1), "share_percent": 150, "most_repeats": 2, "block_words": BLOCK_WORDS, **options}
    placed, copies = _planned(docs, text_column=text_column, **options)
    text = F.col(text_column)
    rows = docs.select(F.col("doc_id"), mix_key(F.col("doc_id"), text).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = _numbered(rows, placed).alias("a")
    plan = copies.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.nth") == F.col("b.nth"))
    joined = rows.join(plan, same).select("row", "slot", "turn", "words", "size", F.col("a.key").alias("key"), F.col("a.nth").alias("nth"))
    joined = joined.orderBy("slot", "turn", "key", "nth")
    whole = F.col(f"row.`{text_column}`")
    first = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD_REGEX), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    kept = F.when(F.col("words") < F.col("size"), first).otherwise(whole)
    made = {text_column: kept}
    if length_column in docs.columns:
        made[length_column] = F.length(kept).cast("bigint")
    return joined.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

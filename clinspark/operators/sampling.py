"""Repeatable samples, splits and balancing of spans."""

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.functions.keys import hash_modulo, key_hash, uniform
from clinspark.operators.groups import hash_rank, ordered_rank, with_group_totals
from clinspark.operators.stored import stored
from clinspark.reference_values import PROXIMITY_FLOOR, PROXIMITY_SCALE

# Distance in scales beyond which a normal density is exactly zero in double precision.
ZERO_DENSITY_SCALES = 39
# Copies of one row that are listed at a time when rows are drawn with replacement.
COPY_STEP = 10_000
# Copies of rows that one task is to make.
COPY_TASK = 50_000
# Steps per doubling of a weighted sampling key when rows are ranked by it.
KEY_STEPS = 1024


def sample_n(df: DataFrame, n, keys: Sequence[str], seed=0) -> DataFrame:
    """Exactly n rows (or all) chosen by key hash: repeatable on any layout. n may be a scalar column."""
    return hash_rank(df, keys, seed, "_rank", upto=n).drop("_rank")


def add_instance_id(df: DataFrame, keys: Sequence[str], dense: bool = False, name: str = "instance_id") -> DataFrame:
    """Id of each row from its keys; `dense` numbers the rows 0..n-1 in hash order.

    Dense numbers need counts of all rows first: the rows are written to the shared folder, so that what makes them runs once.
    """
    if not dense:
        return df.withColumn(name, key_hash("instance", *keys))
    return hash_rank(stored(df), keys, "instance", "_rank").withColumn(name, F.col("_rank") - 1).drop("_rank")


def screening_groups(df: DataFrame, n_groups: int, keys: Sequence[str], seed=0, name: str = "screening_group") -> DataFrame:
    """n groups of equal size (the first ones one larger) over the hash order, numbered from 1."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = hash_rank(df, keys, seed, "_rank")
    size, larger = F.floor(total / n_groups), total % n_groups
    edge = larger * (size + 1)
    group = F.when(F.col("_rank") <= edge, F.ceil(F.col("_rank") / (size + 1))).otherwise(
        larger + F.ceil((F.col("_rank") - edge) / size)
    )
    return ranked.withColumn(name, group.cast("int")).drop("_rank")


def split_persons(
    persons: DataFrame,
    groups: Mapping[str, Sequence[tuple[str, int]]],
    group_column: str = "hospital_group",
    seed=0,
    name: str = "split",
) -> DataFrame:
    """Disjoint splits of persons: within each hospital group, slices of the hash order with the asked sizes.

    `groups` maps a group to (split, size) pairs in order, e.g. {"A": [("dev", 501), ("test_a", 250),
    ("train", 1000)], "B": [("test_b", 250)]}. A person is drawn in one group only: the smallest one.
    """
    one = persons.groupBy("person_id").agg(F.min(group_column).alias(group_column))
    parts = []
    for group, slices in groups.items():
        total = sum(size for _, size in slices)
        ranked = hash_rank(one.filter(F.col(group_column) == group), ["person_id"], seed, "_rank", upto=total)
        label, upper = F.lit(None).cast("string"), 0
        bounds = []
        for split, size in slices:
            bounds.append((split, upper, upper + size))
            upper += size
        for split, low, high in bounds:
            label = F.when((F.col("_rank") > low) & (F.col("_rank") <= high), F.lit(split)).otherwise(label)
        parts.append(ranked.withColumn(name, label).drop("_rank"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def threshold_flags(df: DataFrame, prob: str, thresholds: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """`is_negative`: p <= t0, `is_positive`: p > t1; a span between the two is neither."""
    return df.withColumn("is_negative", F.col(prob) <= thresholds[0]).withColumn("is_positive", F.col(prob) > thresholds[1])


def proximity_weight(
    spans: DataFrame, positive: str = "is_positive", scale: float = PROXIMITY_SCALE, name: str = "weight",
    note: str = "note_id", start: str = "start",
) -> DataFrame:
    """Sum of normal densities of the span start around every positive start of the note, plus a floor.

    Densities beyond 39 scales are exactly zero, so each span only needs the positives of its own block of
    39 scales and the two next to it; these are counted per distinct start before they are collected.
    """
    width = int(math.ceil(ZERO_DENSITY_SCALES * scale))
    counted = spans.filter(F.col(positive)).groupBy(note, start).agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col(start) / width)
    near = counted.withColumn("_block", F.explode(F.array(block - 1, block, block + 1)))
    per_block = near.groupBy(note, "_block").agg(
        F.sort_array(F.collect_list(F.struct(F.col(start).alias("at"), F.col("_n").alias("n")))).alias("_near")
    )
    joined = spans.withColumn("_block", block).join(per_block, [note, "_block"], "left")
    peak = 1.0 / (scale * math.sqrt(2.0 * math.pi))

    def add(total, positive_start):
        z = (F.col(start) - positive_start["at"]) / F.lit(float(scale))
        return total + F.exp(z * z * -0.5) * F.lit(peak) * positive_start["n"]

    density = F.coalesce(F.aggregate("_near", F.lit(0.0), add), F.lit(0.0))
    return joined.withColumn(name, density + F.lit(PROXIMITY_FLOOR)).select(*spans.columns, name)


def weighted_sample(df: DataFrame, n, keys: Sequence[str], weight: str | None = None, seed=0) -> DataFrame:
    """n rows without replacement with probability by weight: the n smallest -ln(u)/w. n null keeps all rows.

    Keys are ranked by their logarithm in many small steps, so no task sorts the whole frame.
    """
    if n is None:
        return df
    if weight is None:
        return sample_n(df, n, keys, seed)
    keyed = df.withColumn("_key", -F.log(uniform(seed, *keys)) / F.col(weight))
    bucket = F.floor(F.log2("_key") * KEY_STEPS)
    return ordered_rank(keyed, bucket, [F.col("_key"), *[F.col(k) for k in keys]], "_rank", upto=n).drop("_rank", "_key")


def sample_negatives(
    spans: DataFrame, prob: str, n=None, keys: Sequence[str] = ("span_id",), seed=0, scale: float = PROXIMITY_SCALE,
    use_weight: bool = True, only_notes_with_positives: bool = True, thresholds: tuple[float, float] = (0.5, 0.5),
    note: str = "note_id",
) -> DataFrame:
    """Negative spans, by default near the positives of their note and only in notes that have some."""
    flagged = threshold_flags(spans, prob, thresholds)
    if only_notes_with_positives:
        flagged = with_group_totals(flagged, [note], _has_positive=F.max("is_positive")).filter("_has_positive").drop("_has_positive")
    if use_weight and n is not None:
        flagged = proximity_weight(flagged, scale=scale, note=note)
    negatives = flagged.filter("is_negative")
    chosen = weighted_sample(negatives, n, keys, "weight" if use_weight else None, seed)
    return chosen.select(*spans.columns)


def oversample(df: DataFrame, n: int | Column, keys: Sequence[str], seed=0, draw: str = "draw") -> DataFrame:
    """n draws with replacement: draw i takes the row whose hash rank is hash(i) modulo the number of rows.

    `draw` numbers the copies of a row from 1. An empty frame gives no rows.
    """
    session = df.sparkSession
    if isinstance(n, Column):
        n = session.range(1).select(n.cast("bigint")).first()[0]
    # Without a row there is nothing to draw from and the result is empty.
    total = F.greatest(df.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    draws = session.range(int(n or 0)).select((hash_modulo(total, seed, "id") + 1).alias("_rank"))
    # Draws are counted per row before the shuffle; the copies are made after the one-to-one join, in two
    # steps so that no array of copies is longer than COPY_STEP or the number of steps.
    counted = draws.groupBy("_rank").agg(F.count(F.lit(1)).alias("_n"))
    rows = hash_rank(df, keys, seed, "_rank").join(counted, "_rank")
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPY_STEP).cast("int"))))
    # Few rows may be in one task, which would make all copies: their steps are dealt out before they are copied.
    tasks = math.ceil(int(n or 0) / COPY_TASK)
    if tasks > 1:
        rows = rows.repartition(tasks, "_rank", "_at")
    first = F.col("_at").cast("bigint") * COPY_STEP + 1
    copies = F.sequence(first, F.least(first + COPY_STEP - 1, F.col("_n")))
    return rows.withColumn(draw, F.explode(copies)).select(*df.columns, draw)

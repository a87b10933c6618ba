"""Group-wise building blocks that keep a very large group off a single task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from clinspark.functions.keys import HASH_DIGITS, key_hash
from clinspark.operators.stored import stored

# Upper bound on the keys that travel by broadcast, those with most rows. Any other key holds less than that part of all rows, which is
# what a task gets on a large cluster anyway.
LARGEST_GROUPS = 10_000
# Rows of a key that one task should hold.
LARGE_ROWS = 100_000
# Number of ways in which the rows of a large group are spread over the shuffle.
SPREAD = 997


def _as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """Hash of the columns that can be hashed; maps are left out."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])


def unique_by(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """One row per key; the job stops when two rows share a key. The check is part of the plan and combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in others])
    single = F.when(F.col("_rows") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{what}: key {list(keys)} is not unique")).cast("boolean"))
    return grouped.filter(single).select(*df.columns)


def with_group_totals(df: DataFrame, keys: Sequence[str], large_rows: int = LARGE_ROWS, **aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row, like an unordered window.

    Totals are pre-aggregated before the shuffle. Those of the largest groups are broadcast (never more
    than LARGEST_GROUPS rows) and the rows of these groups are spread by content; all others join by key.
    """
    names = [f"_g{i}" for i in range(len(keys))]
    totals = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.struct(*[e.alias(n) for n, e in aggregates.items()]).alias("_total"), F.count(F.lit(1)).alias("_rows")
    )
    largest = (
        totals.filter(F.col("_rows") >= large_rows)
        .orderBy(F.desc("_rows"), *names)
        .limit(LARGEST_GROUPS)
        .select(*[F.col(n).alias(f"{n}h") for n in names], F.col("_total").alias("_large"))
    )

    def same_group(suffix=""):
        condition = F.lit(True)
        for key, name in zip(keys, names):
            condition = condition & F.col(key).eqNullSafe(F.col(f"{name}{suffix}"))
        return condition

    tagged = df.join(F.broadcast(largest), same_group("h"), "left").withColumn(
        "_spread",
        F.when(F.col("_large").isNull(), F.lit(0)).otherwise(F.pmod(row_hash(df), F.lit(SPREAD)) + 1),
    )
    joined = tagged.join(
        totals.drop("_rows").withColumn("_at", F.lit(0)),
        same_group() & (F.col("_spread") == F.col("_at")),
        "left",
    )
    picked = F.coalesce(F.col("_large"), F.col("_total"))
    return joined.select(*df.columns, *[picked[name].alias(name) for name in aggregates])


def key_loads(df: DataFrame, keys: Sequence[str], rows_per_task: int = LARGE_ROWS) -> DataFrame:
    """(keys, _copies): keys with more rows than one task should hold, and the number of tasks that their rows need.

    Counts are combined before the shuffle. Only the LARGEST_GROUPS keys with most rows are named, so the frame is small enough to broadcast;
    a key that is not named holds less than a LARGEST_GROUPS-th of all rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_task)
    largest = counts.orderBy(F.desc("_rows"), *keys).limit(LARGEST_GROUPS)
    return largest.select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_copies"))


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], loads: DataFrame | None = None) -> DataFrame:
    """Left join with a side that has one row per key, when some keys hold very many rows of the left side.

    `loads` is a result of `key_loads` over some of the join keys: rows of these keys are spread over as many shuffle keys as they
    need, by content, and only their right rows are copied. Rows with a null key match nothing and are spread too. The result is that of a plain
    join.
    """
    if loads is None:
        return left.join(right, list(keys), "left")
    on = [c for c in loads.columns if c != "_copies"]
    unmatched = F.lit(False)
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    spread = row_hash(left)
    home = F.when(unmatched, F.pmod(spread, F.lit(SPREAD))).otherwise(F.pmod(spread, F.coalesce("_copies", F.lit(1))))
    tagged = left.join(F.broadcast(loads), on, "left").withColumn("_copy", home.cast("int")).drop("_copies")
    copies = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    copied = right.join(F.broadcast(loads), on, "left").withColumn("_copy", F.explode(copies)).drop("_copies")
    joined = tagged.join(copied, [*keys, "_copy"], "left").drop("_copy")
    return joined.select(*left.columns, *[c for c in right.columns if c not in keys])


def ordered_rank(
    df: DataFrame, bucket: Column, order: Sequence[Column], name: str, within: Sequence[str] = (), upto=None
) -> DataFrame:
    """Exact 1-based rank over the whole frame (or `within` keys) without one global sort.

    `bucket` must grow with `order` and split the rows finely; only its counts are accumulated in one place,
    the rows are ranked bucket by bucket. `upto` drops every row whose rank is above that number or scalar.
    Without `within`, the number of buckets must be bounded (the callers use at most a few 100,000).
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *within, "_bucket", F.coalesce(F.sum("_rows").over(running), F.lit(0).cast("bigint")).alias("_before")
    )
    if upto is not None:
        offsets = offsets.filter(F.col("_before") < _as_column(upto))
    rows = rows.join(offsets if within else F.broadcast(offsets), [*within, "_bucket"])
    ranked = rows.withColumn(
        name, F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order))
    ).drop("_bucket", "_before")
    return ranked if upto is None else ranked.filter(F.col(name) <= _as_column(upto))


def hash_rank(df: DataFrame, keys: Sequence[str], seed, name: str, upto=None) -> DataFrame:
    """1-based rank in key-hash order: a repeatable shuffle of the rows with dense numbers."""
    digest = key_hash(seed, *keys)
    bucket = F.substring(digest, 1, HASH_DIGITS)
    return ordered_rank(df, bucket, [digest, *[F.col(k) for k in keys]], name, upto=upto)


def keep_n(
    df: DataFrame,
    sort_column: str = "note_datetime",
    how: str = "first",
    partition_by: Sequence[str] = ("person_id",),
    n: int = 1,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """First (or, for any other `how`, last) n rows per partition; Spark cuts groups before the shuffle."""
    sort = F.col(sort_column).asc() if how == "first" else F.col(sort_column).desc()
    window = Window.partitionBy(*partition_by).orderBy(sort, *tie_break)
    return df.withColumn("_row", F.row_number().over(window)).filter(F.col("_row") <= n).drop("_row")


def keep_one(df: DataFrame, **options) -> DataFrame:
    return keep_n(df, n=1, **options)


def dedupe_on(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in `order`, then by the remaining columns, so the choice is repeatable."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    window = Window.partitionBy(*keys).orderBy(*order, *rest) if order or rest else Window.partitionBy(*keys).orderBy(*keys)
    return df.withColumn("_row", F.row_number().over(window)).filter(F.col("_row") == 1).drop("_row")


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when two rows share a key; returns the frame unchanged."""
    repeated = df.groupBy(*keys).count().filter(F.col("count") > 1).take(1)
    if repeated:
        raise ValueError(f"key {list(keys)} is not unique: {repeated[0]}")
    return df


def value_counts(df: DataFrame, *columns: str, distinct: str | None = None) -> DataFrame:
    """Row counts (and distinct values of a column) per group, largest first."""
    measures = [F.count(F.lit(1)).alias("n")]
    if distinct:
        measures.append(F.count_distinct(F.col(distinct)).alias(f"n_{distinct}"))
    return df.groupBy(*columns).agg(*measures).orderBy(F.desc("n"), *columns)


def series_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based rank of each row in its series, whatever the size of a series.

    Rows are laid out in ranges of (series, order), which cut a long series where they must, and written so; each range counts its rows of
    a series, the counts of earlier ranges are summed, and rows are numbered within their range.
    """
    tie = row_hash(df)
    ranged = df.withColumn("_tie", tie).repartitionByRange(*keys, *order, "_tie").withColumn("_range", F.spark_partition_id())
    ranged = stored(ranged)
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    offsets = counts.select(*named, F.col("_range").alias("_at_range"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("bigint")).alias("_before"))
    same = F.col("_range") == F.col("_at_range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order, "_tie"))
    ranked = ranged.withColumn("_own", own).join(offsets, same).withColumn(name, F.col("_before") + F.col("_own"))
    return ranked.select(*df.columns, name)


def rolling_mean(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    partial: bool = False,
    name: str = "rolling_mean",
    block: int = 100_000,
) -> DataFrame:
    """Mean of the last n rows per series; null (or partial) before n rows exist.

    Series of any length are numbered in ranges and cut into blocks of `block` rows; each block borrows the n-1 rows before it.
    """
    block = max(block, n)
    ranked = series_rank(df, keys, order, "_at")
    ranked = ranked.withColumn("_block", F.floor((F.col("_at") - 1) / block))
    lead_in = (F.pmod(F.col("_at") - 1, F.lit(block)) >= block - (n - 1)) & F.lit(n > 1)
    copies = F.when(lead_in, F.array(F.col("_block"), F.col("_block") + 1)).otherwise(F.array(F.col("_block")))
    spread = ranked.withColumn("_home", F.explode(copies))
    window = Window.partitionBy(*keys, "_home").orderBy("_at").rowsBetween(-(n - 1), 0)
    mean = F.avg(value).over(window)
    out = spread.withColumn(name, mean).filter(F.col("_home") == F.col("_block"))
    if not partial:
        out = out.withColumn(name, F.when(F.col("_at") >= n, F.col(name)))
    return out.select(*df.columns, name)

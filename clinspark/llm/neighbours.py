"""Approximate nearest neighbours by inner product: a forest of sorted hash prefixes."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.llm.common import checkpointed

TREES = 24
BITS = 30  # length of a hash string; prefixes are as long as the candidates allow
# A query goes up the trees until its prefixes hold at least this share of the number of vectors, all trees together. Vectors
# without structure need a large share: on vectors spread evenly in 64 dimensions, with 16 trees, a share of 0.25 finds about 70 % of
# the 20 nearest, 0.5 about 85 % and 1.0 about 95 %; a share of 1 compares a query with some 70 % of them. Clustered ones need
# far less.
SHARE = 1.5
# Vectors of one block of a tree's sorted array; a larger prefix group is cut into several blocks.
BLOCK_ROWS = 20_000
SEED = 11


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero and holds only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(vectors: np.ndarray, extra: np.ndarray, trees: int) -> np.ndarray:
    """Hash strings of each tree as integers of BITS bits: signs of projections, the first one highest.

    `extra` is one more coordinate that makes all indexed vectors equally long, so that large inner products are small angles.
    """
    planes = np.random.Generator(np.random.PCG64(SEED)).standard_normal((vectors.shape[1] + 1, trees * BITS))
    signs = (vectors @ planes[:-1] + extra[:, None] * planes[-1:]) >= 0
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return signs.reshape(len(vectors), trees, BITS) @ weights


def _coded(vectors: DataFrame, longest: float, is_query: bool, trees: int) -> DataFrame:
    """(vec_id, vector) -> with codes array<bigint>, one per tree. `longest` is the greatest length of all vectors."""

    def code(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            extra = np.zeros(len(x)) if is_query else np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0.0))
            codes = _codes(x, extra, trees)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * trees).astype(np.int32)), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "vector", "codes"])

    return vectors.mapInArrow(code, "vec_id bigint, vector array<double>, codes array<bigint>")


def _prefix(code: Column, depth) -> Column:
    depth = depth if isinstance(depth, Column) else F.lit(depth)
    return F.call_function("shiftright", code, F.lit(BITS) - depth)


def search(
    rows: DataFrame,
    queries: Column,
    k: int = 20,
    trees: int = TREES,
    share: float = SHARE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k nearest found of each query row: query_id, rank from 1, vec_id, score (inner product in double precision).

    Every usable vector is indexed in each tree by a long hash string; equal strings lie together in a tree's sorted array.
    A query starts at the longest prefix that it shares with any vector and goes up all trees at the same time, one bit at a
    time, until the prefix groups hold `share` times the number of vectors in sum. Vectors of those groups are compared
    exactly, in blocks of the sorted arrays; groups of any size are cut into blocks, none is capped. Equal vectors are
    indexed once with their k + 1 smallest ids, since no more of them can be among k nearest with ties to the smaller id.

    Null, zero and non-finite vectors and null ids take no part; vectors of different lengths are as if filled up with zeros; repeated ids with
    one vector count once; without candidates a query has no rows; extra columns aren't read.
    """
    source = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"), queries.alias("_query"))
    source = source.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    facts = source.agg(
        F.max(F.size("vector")).alias("size"), F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")
    ).first()
    size, n, longest = (facts["size"], facts["n"], math.sqrt(facts["longest"])) if facts["n"] else (0, 0, 0.0)
    source = source.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("vector"))))
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    # Ids of one vector are cut to k + 1 in hash groups first, so that a very common vector is not collected as a whole.
    part = source.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(1 + n // 1000)).alias("_part")).agg(ids.alias("ids"))
    unique = part.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    unique = unique.withColumn("vec_id", F.col("ids")[0])
    index = _coded(unique.select("vec_id", "vector"), longest, False, trees)
    index = checkpointed(index.select("vec_id", "vector", F.posexplode("codes").alias("tree", "code")))
    asked = _coded(source.filter("_query").select("vec_id", "vector").dropDuplicates(["vec_id"]), longest, True, trees)
    asked = checkpointed(asked)

    # Sizes of prefix groups, from the longest prefix up; far fewer rows than vectors once prefixes are short.
    deepest = min(BITS, max(1, math.ceil(math.log2(max(n, 2))) + 2))
    counts = index.groupBy("tree", _prefix(F.col("code"), deepest).alias("prefix")).agg(F.count(F.lit(1)).alias("rows"))
    levels = F.explode(F.array(*[F.lit(d) for d in range(deepest + 1)])).alias("depth")
    group_of = F.call_function("shiftright", F.col("prefix"), F.lit(deepest) - F.col("depth"))
    counts = counts.select("tree", "prefix", "rows", levels).groupBy("tree", "depth", group_of.alias("prefix")).agg(F.sum("rows").alias("rows"))
    counts = checkpointed(counts)
    paths = asked.select(F.col("vec_id").alias("query_id"), F.posexplode("codes").alias("tree", "code"))
    met = paths.select("query_id", "tree", "code", levels).withColumn("prefix", _prefix(F.col("code"), F.col("depth")))
    met = met.join(counts, ["tree", "depth", "prefix"]).groupBy("query_id", "depth").agg(F.sum("rows").alias("rows"))
    found = F.coalesce(F.max(F.when(F.col("rows") >= share * n, F.col("depth"))), F.lit(0))
    depths = met.groupBy("query_id").agg(found.alias("depth"))

    # Blocks: a tree's groups at a common depth, cut into parts by id where they are large.
    coarse = min(deepest, max(0, math.ceil(math.log2(max(n, 1) / BLOCK_ROWS))))
    parts = counts.filter(F.col("depth") == coarse).select("tree", F.col("prefix").alias("block"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("parts"))
    blocks = index.withColumn("block", _prefix(F.col("code"), coarse)).join(parts, ["tree", "block"])
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    sent = asked.select(F.col("vec_id").alias("query_id"), "vector", F.posexplode("codes").alias("tree", "code")).join(depths, "query_id")
    # A query that goes above the common depth visits all blocks below its prefix.
    first = F.when(F.col("depth") >= coarse, _prefix(F.col("code"), coarse)).otherwise(
        F.call_function("shiftleft", _prefix(F.col("code"), F.col("depth")), F.greatest(F.lit(coarse) - F.col("depth"), F.lit(0)))
    )
    wide = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(coarse) - F.col("depth"), F.lit(0)))
    sent = sent.withColumn("block", F.explode(F.sequence(first, first + wide - 1))).join(parts, ["tree", "block"])
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, k + 1)

    key = ["tree", "block", "part"]
    best = (
        sent.select(*key, "query_id", "vector", "code", "depth").groupBy(*key)
        .cogroup(blocks.select(*key, "vec_id", "vector", "code").groupBy(*key))
        .applyInArrow(nearest, "query_id bigint, vec_id bigint, score double")
    )
    one = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    short = one.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    named = short.join(unique.select("vec_id", "ids"), "vec_id").select("query_id", "score", F.explode("ids").alias("vec_id"))
    ranked = named.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def inner(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of its components."""
    total = np.zeros(len(rows))
    for c in range(rows.shape[1]):
        total += rows[:, c] * x[c]
    return total


def _nearest(asked: pa.Table, block: pa.Table, k: int) -> pa.Table:
    """Best k of a block for each query, among the vectors that share the query's prefix: a range of the sorted array."""
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not asked.num_rows or not block.num_rows:
        return empty
    codes = block["code"].to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, ids = codes[order], block["vec_id"].to_numpy()[order]
    width = len(block["vector"][0])
    vectors = block["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    questions = asked["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for q, x, code, depth in zip(asked["query_id"].to_pylist(), questions, asked["code"].to_pylist(), asked["depth"].to_pylist()):
        low = (code >> (BITS - depth)) << (BITS - depth)
        a, b = np.searchsorted(codes, [low, low + (1 << (BITS - depth))])
        if a == b:
            continue
        rough = vectors[a:b] @ x
        if b - a > k:
            # Everything as good as the k-th but for rounding is scored again in a fixed order of sums.
            level = np.partition(rough, -k)[-k]
            near = np.flatnonzero(rough >= level - 1e-9 * max(1.0, abs(level)))
        else:
            near = np.arange(b - a)
        scores, names = inner(x, vectors[a:b][near]), ids[a:b][near]
        kept = np.lexsort((names, -scores))[:k]
        out.append((np.full(len(kept), q), names[kept], scores[kept]))
    if not out:
        return empty
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

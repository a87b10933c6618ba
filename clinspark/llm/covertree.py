"""Exact top-k search by inner product: cover trees over vectors and queries, descended together."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.llm.common import checkpointed
from clinspark.llm.whitening import finite

SCALE = 1024  # a component x becomes floor(SCALE * x)
TREE_ROWS = 2048  # vectors of one tree
QUERY_ROWS = 1024  # queries that descend one tree together
LEAF = 32  # vectors that are compared without a further bound
PIVOTS = 512  # most regions by which vectors are dealt to trees
SEED = 17
_EXACT = float(1 << 53)  # sums of whole numbers below this are exact in double precision
_LONG = 1 << 63
_SLACK = 1e-9  # bounds are widened by this share of their terms, more than rounding can take from them


class Tree:
    """Cover tree of the rows of a matrix: position 0 is the root, the subtree of a position is a range of positions.

    `order` has the row of each position, `parent` the position of its parent, `radius` the largest distance to a row of its subtree.
    """

    def __init__(self, order: np.ndarray, parent: np.ndarray, radius: np.ndarray):
        self.order, self.parent, self.radius = order, parent, radius


def cover_tree(x: np.ndarray) -> Tree:
    """Builds the levels of a cover tree (base 2) by a farthest-first walk.

    Every step takes the row farthest from the ones taken so far. Rows taken at distances above 2^i are more than 2^i apart and cover all others
    within 2^i: they are level i. A row's parent is the row of the next level up that is nearest to it. Equal rows hang on one of them.
    """
    n = len(x)
    squares = (x * x).sum(axis=1)
    near, best = np.zeros(n, np.int64), np.full(n, np.inf)
    parent, level = np.full(n, -1, np.int64), np.full(n, -(1 << 30), np.int64)
    taken = np.zeros(n, bool)
    upper, height, at = near, None, 0
    for step in range(n):
        taken[at] = True
        if step:
            i = math.frexp(math.sqrt(best[at]))[1] - 1  # 2^i <= distance < 2^(i+1)
            if i != height:
                upper, height = near.copy(), i
            parent[at], level[at] = upper[at], i
        d = squares + squares[at] - 2.0 * (x @ x[at])
        closer = d < best
        best[closer], near[closer] = d[closer], at
        best[at] = 0.0
        at = int(np.where(taken, -1.0, best).argmax())
        # Distances that are rounding of the products are looked at again, so that equal rows end the walk.
        if step + 1 < n and best[at] <= 1e-9 * (squares[at] + squares[near[at]]):
            left = np.flatnonzero(~taken)
            best[left] = ((x[left] - x[near[left]]) ** 2).sum(axis=1)
            at = int(left[best[left].argmax()])
            if best[at] == 0.0:
                parent[left] = near[left]
                break
    children: list[list[int]] = [[] for _ in range(n)]
    for row in sorted(range(1, n), key=lambda r: (-level[r], r)) if n else []:
        children[parent[row]].append(row)
    order, stack = np.zeros(n, np.int64), [0] if n else []
    place, k = np.zeros(n, np.int64), 0
    while stack:
        row = stack.pop()
        order[k], place[row] = row, k
        k += 1
        stack += children[row][::-1]
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    return Tree(order, up, _radii(x[order], up))


def _radii(x: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Largest distance from each position to a position below it."""
    radius, below = np.zeros(len(x)), np.arange(len(x))
    over = parent.copy()
    while len(below):
        below, over = below[over >= 0], over[over >= 0]
        if len(below):
            np.maximum.at(radius, over, np.sqrt(((x[below] - x[over]) ** 2).sum(axis=1)))
            over = parent[over]
    return radius


class Nodes:
    """Nodes of a tree in the form that the descent needs: centre, radius, range of positions, children (none of a leaf).

    A subtree of up to LEAF rows is a leaf. The own row of a larger one is a leaf below it.
    """

    def __init__(self, x: np.ndarray, parent: np.ndarray, radius: np.ndarray):
        n = len(x)
        size = np.ones(n, np.int64)
        for k in range(n - 1, 0, -1):
            size[parent[k]] += size[k]
        below: list[list[int]] = [[] for _ in range(n)]
        inner = [k for k in range(n) if size[k] > LEAF]
        shown = np.zeros(n, bool)
        shown[:1] = True
        for k in range(1, n):
            if size[parent[k]] > LEAF:
                shown[k] = True
                below[parent[k]].append(k)
        # Node numbers: subtrees first, then the own rows of inner ones.
        subtrees = np.flatnonzero(shown)
        number = np.cumsum(shown) - 1
        rows = np.concatenate([subtrees, np.array(inner, np.int64)])
        self.centres = x[rows]
        self.radii = np.concatenate([radius[subtrees], np.zeros(len(inner))])
        self.low = rows
        self.size = np.concatenate([size[subtrees], np.ones(len(inner), np.int64)])
        self.children: dict[int, np.ndarray] = {}
        for k, row in enumerate(inner):
            self.children[int(number[row])] = np.append(number[below[row]], len(subtrees) + k).astype(np.int64)
        self.is_leaf = np.ones(len(rows), bool)
        self.is_leaf[list(self.children)] = False

    def positions(self, nodes: np.ndarray) -> np.ndarray:
        sizes = self.size[nodes]
        starts = np.cumsum(sizes) - sizes
        return np.repeat(self.low[nodes] - starts, sizes) + np.arange(sizes.sum())


class Best:
    """The k best of each query so far: scores (falling) and names, and a floor below which nothing is of interest."""

    def __init__(self, queries: int, k: int, floor: list, kind):
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0, kind)] * queries
        self.names: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.given = np.array([-math.inf if f is None else float(f) for f in floor])
        self.worst = self.given.copy()  # as a float, rounded down a little

    def offer(self, query: int, scores: np.ndarray, names: np.ndarray) -> None:
        scores, names = np.concatenate([self.scores[query], scores]), np.concatenate([self.names[query], names])
        kept = np.lexsort((names, -scores))[: self.k]
        self.scores[query], self.names[query] = scores[kept], names[kept]
        if len(kept) == self.k:
            least = float(self.scores[query][-1])
            self.worst[query] = max(self.given[query], least - abs(least) * _SLACK)


def descend(q: np.ndarray, asked: list[int], floor: list, x: np.ndarray, names: np.ndarray, parent: np.ndarray, radius: np.ndarray, k: int) -> tuple[list, list, list, int]:
    """Dual-tree search: (query ids, vec ids, scores) of up to k best of each query among x, and the number of inner products of rows.

    Rows of x are in the order of their tree. A pair of nodes with centres a, b and radii r, s holds no inner product above
    a.b + |a| s + |b| r + r s; it is left if that is below the worst k-th score of the query node's queries. A query node meets a set of nodes
    of the other tree at once: of those that are not left, wider ones open; when all are narrower than the query node, it opens
    itself. A leaf of queries opens and compares nodes from the highest bound down, twice as many at each turn.
    """
    most = max(float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (x, q))
    exact = x.shape[1] * most**2 < _EXACT
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    tree = cover_tree(qf)
    q, qf, asked, floor = q[tree.order], qf[tree.order], [asked[i] for i in tree.order], [floor[i] for i in tree.order]
    mine, theirs = Nodes(qf, tree.parent, tree.radius), Nodes(xf, parent, radius)
    best = Best(len(q), k, floor, np.float64 if exact else object)
    a, b = np.linalg.norm(mine.centres, axis=1), np.linalg.norm(theirs.centres, axis=1)
    r, s = mine.radii * (1 + _SLACK), theirs.radii * (1 + _SLACK)
    bounds = mine.centres @ theirs.centres.T + np.outer(a, s) + np.outer(r, b) + np.outer(r, s)
    bounds += _SLACK * (np.outer(a + r, b + s) + 1.0)
    own = np.array(asked)
    left, right = (qf, xf) if exact else (q.astype(object), x.astype(object))
    compared = 0

    def compare(m: int, nodes: np.ndarray) -> int:
        low, high, at = mine.low[m], mine.low[m] + mine.size[m], theirs.positions(nodes)
        scores = left[low:high] @ right[at].T
        rough = scores if exact else scores.astype(np.float64)
        good = (rough >= best.worst[low:high, None]) & (names[None, at] != own[low:high, None])
        for i in np.flatnonzero(good.any(axis=1)):
            best.offer(low + i, scores[i][good[i]], names[at][good[i]])
        return len(at) * int(high - low)

    stack = [(0, np.zeros(1, np.int64))] if len(q) and len(x) else []
    while stack:
        m, met = stack.pop()
        span, chunk = slice(mine.low[m], mine.low[m] + mine.size[m]), 8
        while len(met := met[bounds[m, met] >= best.worst[span].min()]):
            if mine.is_leaf[m]:
                met = met[np.argsort(-bounds[m, met], kind="stable")]
                now, met = met[:chunk], met[chunk:]
                chunk *= 2
                if len(leaves := now[theirs.is_leaf[now]]):
                    compared += compare(m, leaves)
                wide = now[~theirs.is_leaf[now]]
            else:
                opens = ~theirs.is_leaf[met] & (s[met] >= r[m])
                wide, met = met[opens], met[~opens]
                if not len(wide):
                    stack += [(int(c), met) for c in mine.children[m]]
                    break
            met = np.concatenate([met, *[theirs.children[int(t)] for t in wide]])
    ids = [i for i, n in zip(asked, best.names) for _ in n]
    scores = [max(-_LONG, min(_LONG - 1, int(v))) for found in best.scores for v in found]
    return ids, [int(v) for found in best.names for v in found], scores, compared


def _matrix(column, size: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def whole_numbers(vector: Column) -> Column:
    """floor(SCALE * x) of each component, as bigint; beyond a long the nearest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("bigint"))


def _dealt(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with the nearest pivot and the distance to it; ties go to the first pivot."""
    size = pivots.shape[1]
    squares = (pivots**2).sum(axis=1)

    def near(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = _matrix(batch.column("vector"), size).astype(np.float64)
            region = (squares - 2.0 * (x @ pivots.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            away = np.sqrt(((x - pivots[region]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region, pa.int32()), pa.array(away)], names=[*batch.schema.names, "region", "away"])

    return vectors.mapInArrow(near, "vec_id bigint, vector array<bigint>, region int, away double")


def index(vectors: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vector) -> trees and regions, both written to the shared folder.

    A vector belongs to the region of its nearest pivot; a region of more than TREE_ROWS vectors is cut into even parts by id, each with a tree
    of its own, so that a region of any size is spread. Trees: region, part, pos, up (the parent's pos), radius, vec_id, vector. Regions:
    region, parts, reach (largest distance from the pivot).
    """
    size = pivots.shape[1]
    dealt = checkpointed(_dealt(vectors, pivots))
    regions = dealt.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).cast("int").alias("parts"), F.max("away").alias("reach"))
    regions = checkpointed(regions)
    part = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col("parts")).cast("int")

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        tree = cover_tree(_matrix(table["vector"], size).astype(np.float64))
        table = table.take(pa.array(tree.order))
        made = {"pos": pa.array(np.arange(len(tree.order)), pa.int32()), "up": pa.array(tree.parent, pa.int32()), "radius": pa.array(tree.radius)}
        return pa.table({"region": table["region"], "part": table["part"], **made, "vec_id": table["vec_id"], "vector": table["vector"]})

    cut = dealt.join(F.broadcast(regions), "region").select("region", part.alias("part"), "vec_id", "vector")
    trees = cut.groupBy("region", "part").applyInArrow(grow, "region int, part int, pos int, up int, radius double, vec_id bigint, vector array<bigint>")
    return checkpointed(trees), regions


def search(rows: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k rows with the largest inner products with each query row, ties to smaller ids.

    Vectors count as whole numbers floor(1024 x). Each query first descends the trees of one part of its own region, which gives it k scores to
    beat; then every region whose ball can hold a score as good gets it. Queries go to a tree in groups with a cover tree of their own.

    Null vectors, ones with null or non-finite components and null ids take no part, as queries or candidates. Repeated ids: a query is the
    first of its vectors in order, and no row of a query's id is its candidate; other repeated rows with equal vectors count once, of an id with
    different vectors the best counts. Vectors of different lengths are as if filled up with zeros. Without candidates a query has no rows;
    extra columns aren't read. A score beyond a long is the nearest long.
    """
    source = rows.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("given"), queries.alias("is_query"))
    source = source.filter(F.col("vec_id").isNotNull() & finite(F.col("given").cast("array<double>")))
    source = source.select("vec_id", whole_numbers(F.col("given")).alias("vector"), F.coalesce("is_query", F.lit(False)).alias("is_query"))
    facts = source.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size"), F.count_if("is_query").alias("q")).first()
    n, size, asked = facts["n"], facts["size"] or 0, facts["q"]
    source = source.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size("vector"))))
    candidates = source.groupBy("vec_id", "vector").agg(F.max("is_query").alias("is_query"))
    wanted = candidates.filter("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    if not n or not asked or not size:
        # Vectors without components have inner products of 0: all are equal.
        if not n or not asked:
            return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        source = candidates.select("vec_id", F.array(F.lit(0).cast("bigint")).alias("vector"))
        wanted, candidates, size = wanted.select("vec_id", F.array(F.lit(0).cast("bigint")).alias("vector")), source, 1
    # Pivots are vectors in the order of a hash of their ids; they only decide which vectors share a tree.
    count = min(PIVOTS, math.ceil(n / TREE_ROWS))
    chosen = candidates.select("vector", F.xxhash64("vec_id", F.lit(SEED)).alias("h")).orderBy("h", "vector").limit(count).collect()
    pivots = np.unique(np.array([r["vector"] for r in chosen], np.float64).reshape(-1, size), axis=0)
    trees, regions = index(candidates.select("vec_id", "vector"), pivots)
    reach = np.full(len(pivots), -1.0)
    for r in regions.collect():  # at most PIVOTS rows
        reach[r["region"]] = r["reach"]
    chunks = max(1, math.ceil(asked / QUERY_ROWS))
    own = checkpointed(_dealt(wanted, pivots).select("vec_id", "vector", "region"))
    empty = np.flatnonzero(reach < 0)
    chunk = F.pmod(F.xxhash64("vec_id", F.lit(SEED + 1)), F.lit(chunks)).cast("int").alias("chunk")

    def met(sent: DataFrame) -> DataFrame:
        """(region, part, vec_id, vector, floor) -> the best of each tree."""

        def join(left: pa.Table, right: pa.Table) -> pa.Table:
            names = ["query_id", "vec_id", "score"]
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in names})
            left, right = left.sort_by("vec_id"), right.sort_by("pos")
            found = descend(
                _matrix(left["vector"], size), left["vec_id"].to_pylist(), left["floor"].to_pylist(), _matrix(right["vector"], size),
                right["vec_id"].to_numpy(), right["up"].to_numpy(), right["radius"].to_numpy(), k,
            )
            return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, found)})

        key = ["region", "part", "chunk"]
        groups = sent.select(*[F.col(c).alias(c) for c in key]).distinct()
        copies = trees.join(groups, ["region", "part"])  # a tree is sent once for each group of queries
        return sent.groupBy(*key).cogroup(copies.groupBy(*key)).applyInArrow(join, "query_id bigint, vec_id bigint, score bigint")

    whole = own.join(F.broadcast(regions), "region")
    first = whole.select("region", F.pmod(F.xxhash64("vec_id", F.lit(SEED + 2)), F.col("parts")).cast("int").alias("part"), chunk, "vec_id", "vector", F.lit(None).cast("bigint").alias("floor"))
    begun = checkpointed(met(first))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = begun.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
    floors = ranked.select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    squares = (pivots**2).sum(axis=1)
    norms = np.sqrt(squares)

    def route(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            q = _matrix(batch.column("vector"), size).astype(np.float64)
            floor = np.array([-math.inf if f is None else float(f) for f in batch.column("floor").to_pylist()])
            sizes = np.sqrt((q**2).sum(axis=1))
            bounds = q @ pivots.T + np.outer(sizes, reach) + _SLACK * (np.outer(sizes, norms + np.abs(reach)) + 1.0)
            bounds[:, empty] = -math.inf
            rows, region = np.nonzero((bounds >= floor[:, None] - _SLACK * np.abs(np.where(np.isfinite(floor), floor, 0.0))[:, None]) & (bounds > -math.inf))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(region, pa.int32())], names=[*batch.schema.names, "region"])

    routed = own.join(floors, "vec_id", "left").select("vec_id", "vector", "floor").mapInArrow(route, "vec_id bigint, vector array<bigint>, floor bigint, region int")
    sent = routed.join(F.broadcast(regions), "region").select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), chunk, "vec_id", "vector", "floor")
    seen = first.select("vec_id", "region", "part")
    best = begun.union(met(checkpointed(sent.join(seen, ["vec_id", "region", "part"], "left_anti"))))
    one = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

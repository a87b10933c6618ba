"""N-gram Jaccard join with adaptive multi-match prefixes; classes of linked documents without listing all pairs."""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from clinspark.llm.common import checkpointed, may_be_among
from clinspark.llm.components import components
from clinspark.llm.hashing import shingle_set, words_of_texts

# Counters of the table of shingle frequencies; it covers all shingles of all texts, and its size is fixed.
COUNTERS = 1 << 22
COUNTER_SHIFT = np.uint64(64 - 22)
# A block of counters is one row while the tables of the tasks are summed.
BLOCK = 1 << 13
# Most shared prefix shingles that a document may ask for.
MOST_MATCHES = 8
# Bits of the table that says which prefix shingles occur in more than one set; others that pass in error only cost time.
SHARED_BITS = 1 << 26
SHARED_BLOCKS = 64


def _tally(table: np.ndarray, held: list[np.ndarray]) -> None:
    spots, n = np.unique(np.concatenate(held).astype(np.int64), return_counts=True)
    table[spots] += n.astype(np.int32)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """How many (document, shingle) pairs fall on each counter, over all documents.

    Tasks count on their own, the blocks of their tables are summed in the shuffle, and the table, of fixed size, reaches the driver.
    """

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int32)
        for batch in stream:
            held, n = [], 0
            for words in words_of_texts(batch.column(0)):
                held.append(shingle_set(words, size) >> COUNTER_SHIFT)
                n += len(held[-1])
                if n > COUNTERS // 4:
                    _tally(table, held)
                    held, n = [], 0
            if held:
                _tally(table, held)
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        rows = [zlib.compress(blocks[k].tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows, pa.binary())], names=["block", "counts"])

    def add(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in stream:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[block] = sums.get(block, 0) + np.frombuffer(zlib.decompress(counts.as_buffer()), np.int32).astype(np.int64)
        rows = [sums[k].tobytes() for k in sums]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition(16, "block").mapInArrow(add, schema)
    table = np.zeros((COUNTERS // BLOCK, BLOCK), np.float32)
    for row in summed.toLocalIterator():
        table[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1)


def middle(counts: np.ndarray) -> float:
    """Median of the table up to a sixteenth, block by block: no second table is made."""
    low, high = float(counts.min()), float(counts.max())
    while high - low > 1 / 16:
        guess = (low + high) / 2
        if sum(int((counts[at : at + BLOCK] <= guess).sum()) for at in range(0, len(counts), BLOCK)) * 2 >= len(counts):
            high = guess
        else:
            low = guess
    return high


def choose_matches(ordered: np.ndarray, n: int, least: int) -> int:
    """How many shared prefix shingles to ask for, given the frequencies of a document's shingles in their order.

    Asking for one more lengthens the prefix by one. The cost is the length of the prefix's lists plus the verification of
    at most (length of the lists / matches) documents, each at the set's size. A list counts one entry more than its estimate.
    """
    best, cost = 1, None
    for m in range(1, min(MOST_MATCHES, least) + 1):
        lists = float((ordered[: n - least + m] + 1.0).sum())
        c = lists * (1.0 + n / m)
        if cost is None or c < cost:
            best, cost = m, c
    return best


def signatures(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, text) -> doc_id, at (hash of the text), n, key (128-bit hash of the set), matches, prefix array<bigint>; written rows.

    Shingles are ordered by frequency, then hash. A set of n shingles shares at least ceil(percent * n / 100) with any set it links
    to, so two linked sets that both ask for m matches share m shingles of their first n - that + m ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    noise = middle(counts)

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in stream:
            n, keys, matches, prefixes = [], [], [], []
            for words in words_of_texts(batch.column(1)):
                found = shingle_set(words, size)
                n.append(len(found))
                if not len(found):
                    keys.append(None), matches.append(0), prefixes.append(np.zeros(0, np.int64))
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                frequency = table[(found >> COUNTER_SHIFT).astype(np.int64)]
                order = np.argsort(frequency, kind="stable")
                least = (percent * len(found) + 99) // 100
                m = choose_matches(np.maximum(frequency[order[: len(found) - least + MOST_MATCHES]] - noise, 0.0), len(found), least)
                matches.append(m)
                prefixes.append(found[order[: len(found) - least + m]].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(matches, pa.int32()), lists],
                names=["doc_id", "at", "n", "key", "matches", "prefix"],
            )

    schema = "doc_id bigint, at bigint, n bigint, key binary, matches int, prefix array<bigint>"
    made = checkpointed(docs.select("doc_id", "text", F.xxhash64("text").alias("at")).mapInArrow(sign, schema))
    sent.destroy()  # nothing reads the table once the rows are written
    return made


def shared_bits(nodes: DataFrame) -> np.ndarray:
    """Bit table of the prefix shingles that more than one set has; of fixed size, so it may reach the driver."""
    tokens = nodes.select(F.explode("set.prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    spot = F.pmod("token", F.lit(SHARED_BITS))
    size = SHARED_BITS // SHARED_BLOCKS

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in stream:
            blocks, spots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in np.unique(blocks).tolist():
                made.setdefault(block, np.zeros(size, bool))[spots[blocks == block] % size] = True
        rows = [zlib.compress(np.packbits(made[k]).tobytes(), 1) for k in made]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array(rows, pa.binary())], names=["block", "bits"])

    spots = tokens.select(F.floor(spot / size).cast("int").alias("block"), spot.cast("bigint").alias("spot"))
    table = np.zeros((SHARED_BLOCKS, size // 8), np.uint8)
    for row in spots.repartition(SHARED_BLOCKS, "block").mapInArrow(pack, "block int, bits binary").toLocalIterator():
        table[row["block"]] |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return table.reshape(-1)


def listed_postings(nodes: DataFrame) -> DataFrame:
    """Postings of the lists with more than one member, each with the list's pivot, the member with fewest rarer shingles; written rows."""
    bits = shared_bits(nodes)
    sent = nodes.sparkSession.sparkContext.broadcast(bits)
    rows = shared_postings(nodes, sent)
    pivot = F.min(F.struct("pos", "n", "matches", "before", "node")).alias("pivot")
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_rows"), pivot).filter("_rows > 1")
    postings = checkpointed(rows.join(lists.drop("_rows"), "token"))
    sent.destroy()
    return postings


def shared_postings(nodes: DataFrame, sent: Broadcast) -> DataFrame:
    """(node, set) -> token, node, n, matches, pos, before: only prefix shingles that the broadcast bit table knows.

    `pos` is the place in the set's order and `before` the number of earlier shingles that other sets may have: if two sets share a
    shingle of both prefixes, every earlier one that they share is in both prefixes too.
    """

    def post(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in stream:
            lists = batch.column(3)
            tokens = lists.flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            start = np.cumsum(sizes) - sizes
            pos = np.arange(len(tokens)) - np.repeat(start, sizes)
            spot = tokens % SHARED_BITS
            known = (table[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 > 0
            total = np.cumsum(known) - known
            before = total - np.repeat(np.append(total, 0)[start], sizes)
            take = pa.array(row[known])
            arrays = [pa.array(tokens[known]), *[batch.column(k).take(take) for k in range(3)], pa.array(pos[known].astype(np.int32)), pa.array(before[known].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "n", "matches", "pos", "before"])

    schema = "token bigint, node bigint, n bigint, matches int, pos int, before int"
    return nodes.select("node", "set.n", "set.matches", "set.prefix").mapInArrow(post, schema)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether two sets that share a shingle can reach the similarity.

    Before it they share at most the smaller number of shingles that other sets may have, from it on at most the smaller rest.
    """
    nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
    most = F.least(f"{x}before", f"{y}before") + F.least(nx - F.col(f"{x}pos"), ny - F.col(f"{y}pos"))
    return most * 100 >= (nx + ny - most) * percent


def counted_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, least) rows, one for each shared prefix shingle -> pairs (with `_shared`) that share as many as both ask for."""
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_shared"), F.first("least").alias("_least")).filter("_shared >= _least")


def pivot_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """For each node the pivot of its lists that it shares most prefix shingles with: at most one pair a node."""
    other = postings.filter("node <> pivot.node").filter(may_link("", "pivot.", percent))
    met = counted_pairs(other.select(F.col("node").alias("a"), F.col("pivot.node").alias("b"), F.least("matches", "pivot.matches").alias("least")))
    best = met.groupBy("a").agg(F.max(F.struct("_shared", "b")).alias("_best")).select("a", F.col("_best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def short_names(lists: DataFrame) -> DataFrame:
    """Rows of different tokens with a `short` name of each, int where they are few enough: half as wide as a hash. Written rows."""
    local = F.lit((1 << 33) - 1)
    numbered = checkpointed(lists.withColumn("_id", F.monotonically_increasing_id()))  # the part's number in the bits above 33
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(local)
    most = numbered.agg(F.max(part).alias("part"), F.max(place).alias("place")).first()
    step = (most["place"] or 0) + 1
    kind = "int" if ((most["part"] or 0) + 1) * step < 1 << 31 else "bigint"
    return numbered.withColumn("short", (part * F.lit(step).cast("bigint") + place).cast(kind)).drop("_id")


def with_rest(rows: DataFrame) -> DataFrame:
    """Rows with `rest`, the tokens of their node's rows from their own on, by `pos`."""
    others = [c for c in rows.columns if c not in ("node", "pos", "token")]
    listed = F.array_sort(F.collect_list(F.struct("pos", "token", *others))).alias("_rows")
    rows = rows.groupBy("node").agg(listed).select("node", F.transform("_rows", lambda r: r["token"]).alias("_tokens"), F.posexplode("_rows").alias("_at", "_row"))
    return rows.select("node", "_row.*", F.expr("slice(_tokens, _at + 1, size(_tokens))").alias("rest"))


def remaining_pairs(postings: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list whose members lie in different components: those outside the pivot's component with all others.

    Members of such lists carry their prefix shingles of such lists, so a pair is counted where its lists meet and passed on once, at the
    first shingle that both have, and only if they share as many as both ask for.
    """
    root = F.coalesce(F.col("root"), F.col("node"))
    placed = postings.join(roots, "node", "left").select("token", "node", "n", "pos", "before", "matches", root.alias("root"), (F.col("node") == F.col("pivot.node")).alias("is_pivot"))
    mixed_lists = placed.groupBy("token").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.max(F.when(F.col("is_pivot"), F.col("root"))).alias("home")
    ).filter("_low <> _high").select("token", "home")
    rows = checkpointed(placed.drop("is_pivot").join(short_names(mixed_lists), "token").drop("token").withColumnRenamed("short", "token"))

    def possible(x, y):
        return (F.col(f"{x}.token") == F.col(f"{y}.token")) & (F.col(f"{x}.root") != F.col(f"{y}.root")) & may_link(f"{x}.", f"{y}.", percent)

    # Only members that may link with another stay, each listed once, however many partners it has. A row gets the shingles of its node's rows
    # from its own on; those that two sets share are on both sides, unless the sets can't link. All sets have one order of shingles, so
    # exactly one of the shared ones has as many from it on as both ask for, if there are that many: the pair is passed on there.
    rows = checkpointed(rows.alias("x").join(rows.alias("y"), possible("x", "y"), "left_semi"))
    rows = with_rest(rows)
    x, y = rows.filter("root <> home").alias("x"), rows.alias("y")
    once = (F.col("y.root") == F.col("y.home")) | (F.col("x.node") < F.col("y.node"))
    counted = F.size(F.array_intersect("x.rest", "y.rest")) == F.least("x.matches", "y.matches")
    met = x.join(y, possible("x", "y") & once & counted)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of nodes whose whole sets reach the similarity.

    Only texts of nodes in a pair are shuffled: a bit table, made from those nodes, filters the scan first.
    """
    row_key = F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("at"))
    named = nodes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.at").alias("at")).withColumn("row", row_key)
    sides = {x: named.select(F.col("node").alias(x), F.col("row").alias(f"row_{x}"), F.col("at").alias(f"at_{x}")) for x in "ab"}
    keyed = checkpointed(pairs.join(sides["a"], "a").join(sides["b"], "b"))
    rows = checkpointed(keyed.select(F.col("row_a").alias("row")).union(keyed.select(F.col("row_b").alias("row"))).distinct())
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("at")).withColumn("row", row_key)
    passing = may_be_among(source, F.col("row"), rows, F.col("row"))
    passing = passing.select("row", "at", "text").dropDuplicates(["row", "at"])  # a repeated row has the same text
    text = {x: passing.select(F.col("row").alias(f"row_{x}"), F.col("at").alias(f"at_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab"}
    joined = keyed.join(text["a"], ["row_a", "at_a"]).join(text["b"], ["row_b", "at_b"]).select("a", "b", "text_a", "text_b")

    def check(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = []
            for x, y in zip(words_of_texts(batch.column(2)), words_of_texts(batch.column(3))):
                x, y = shingle_set(x, size), shingle_set(y, size)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return joined.mapInArrow(check, "a bigint, b bigint")


def ngram_classes(docs: DataFrame, size: int = 5, percent: int = 80, text_column: str = "text") -> DataFrame:
    """Class of each document: doc_id, at (hash of the text), n_shingles, class (null without shingles).

    Words are runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct runs of `size` words (the
    whole sequence, if it has fewer). Two documents link when their sets' intersection is at least `percent` hundredths of the union.
    Documents of equal sets are one node. Nodes that share prefix shingles are candidates; each list first verifies its
    members with one pivot (the member with fewest rarer shingles), components are formed, and then only pairs in different
    components are left, all of which are verified. So no list emits its pairs, and no link between components is lost.

    Null and empty texts have 0 shingles and link with nothing; repeated rows stay and link with each other unless empty; an
    empty table gives no rows; extra columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    signed = signatures(docs, size, percent, frequencies(docs, size))
    nodes = signed.filter("n > 0").groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.first(F.struct("n", "matches", "prefix")).alias("set"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))  # short names, fixed by the checkpoint
    postings = listed_postings(nodes)
    firsts = nodes.select("node", "first")
    links = checkpointed(verified(checkpointed(pivot_pairs(postings, percent)), firsts, docs, size, percent))
    more = verified(checkpointed(remaining_pairs(postings, components(links), percent)), firsts, docs, size, percent)
    roots = components(links.union(more))
    members = signed.select("doc_id", "at", F.col("n").alias("n_shingles"), "key").join(nodes.select("key", "node"), "key", "left")
    members = members.join(roots, "node", "left")
    return members.select("doc_id", "at", "n_shingles", F.coalesce("root", "node").alias("class"))


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, itself included. See `ngram_classes`.

    A document without shingles has its own doc_id; a null doc_id names a class only if all of its ids are null.
    """
    members = ngram_classes(docs, size, percent, text_column)
    names = members.groupBy("class").agg(F.min("doc_id").alias("_least")).filter("class is not null")
    named = members.join(names, "class", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))


def one_of_each_class(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with the smallest doc_id of their class (null last, then by a hash of the text); rows without shingles stay.

    Repeated rows of that doc_id and text leave one.
    """
    members = ngram_classes(docs, size, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "at")).alias("first")
    chosen = members.filter("class is not null").groupBy("class").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.at").alias("at"))
    empty = members.filter("class is null").select(F.col("doc_id").alias("id"), "at").distinct()
    chosen = chosen.withColumn("one", F.lit(True)).union(empty.withColumn("one", F.lit(False))).alias("c")
    # The user's columns travel in one struct, so that no name used here meets one of theirs.
    rows = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.id")) & (F.col("d.of") == F.col("c.at"))
    joined = rows.alias("d").join(chosen, same).select("d.doc_id", "d.of", "d.row", "c.one")
    single = joined.filter("one").dropDuplicates(["doc_id", "of"])
    return single.select("row").union(joined.filter("not one").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

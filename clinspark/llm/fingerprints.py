"""Document fingerprints from closed syncmers, in built-in functions only."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from clinspark.llm.common import free_name

# A token is a run of up to four characters other than white space, counted from the start of its word, so texts with and
# without blanks have many; a change moves no token beyond its own word.
TOKEN_REGEX = r"\S{1,4}"
K = 5  # tokens of a k-mer
S = 2  # tokens of its inner substrings
CELL = 256  # tokens; matching anchors lie in the same or in neighbouring cells
# Texts of one range of ids, in bytes, about; beyond MOST_RANGES ranges (some 2 TB) they grow instead, since their bounds are held by the driver.
RANGE_BYTES = 8 << 20
MOST_RANGES = 1 << 18


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`: array<struct<pos, hash>> of the closed syncmers of the text in column `text`.

    A k-mer is chosen if the least hash of its K - S + 1 inner substrings is that of the first or the last one (both, if they
    tie), which depends on the k-mer alone, not on its context. A text of fewer than K tokens has one anchor, all its tokens;
    a text without tokens has none.
    """
    tokens, inner, places = (free_name(df, f"_{name}_{x}") for x in ("tokens", "inner", "places"))
    last = K - S

    def at(i, k):
        return F.get(F.col(inner), (i + F.lit(k)).cast("int"))

    none = F.array().cast("array<int>")
    n = F.size(tokens)
    hashed = F.transform(F.regexp_extract_all(F.col(text), F.lit(TOKEN_REGEX), F.lit(0)), lambda t: F.xxhash64(t))
    pairs = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(F.get(F.col(tokens), i), F.get(F.col(tokens), (i + 1).cast("int"))))

    def closed(i):
        return F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, k) for k in range(1, last)])

    def anchor(i):
        return F.struct(i.alias("pos"), F.xxhash64(*[at(i, k) for k in (*range(0, last, S), last)]).alias("hash"))

    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(F.col(tokens)).alias("hash")))
    df = df.withColumn(tokens, hashed)
    df = df.withColumn(inner, F.when(n >= K, pairs).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(places, F.when(F.size(inner) > 0, F.filter(F.sequence(F.lit(0), F.size(inner) - last - 1), closed)).otherwise(none))
    found = F.when(n >= K, F.transform(F.col(places), anchor)).when(n > 0, whole).otherwise(F.array().cast("array<struct<pos: int, hash: bigint>>"))
    return df.withColumn(name, found).drop(tokens, inner, places)


def as_text(anchors: Column) -> Column:
    """Fingerprint as text: position, colon and the hash in hexadecimal digits, blank-separated."""
    return F.array_join(F.transform(anchors, lambda a: F.concat_ws(":", a["pos"].cast("string"), F.lower(F.hex(a["hash"])))), " ")


def _cells(anchors: Column) -> Column:
    return F.array_distinct(F.transform(anchors, lambda a: F.xxhash64(a["hash"], F.floor(a["pos"] / CELL))))


def _wide_cells(anchors: Column) -> Column:
    near = lambda a, d: F.xxhash64(a["hash"], F.floor(a["pos"] / CELL) + d)
    return F.flatten(F.transform(anchors, lambda a: F.array(*[near(a, d) for d in (-1, 0, 1)])))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add `name`: the share of (hash, cell) pairs that a and b have in common, in the same or a neighbouring cell.

    Pairs count once on both sides, however often a text repeats itself: the fewer of a's pairs that b has and b's pairs that a has,
    over the larger number of pairs. So a and b may be exchanged. 1 for equal anchors, also when there are none on both sides, and 0
    when only one side has some.
    """
    cells = free_name(df, f"_{name}_cells")
    sides = F.struct(_cells(F.col(a)).alias("a"), _wide_cells(F.col(a)).alias("wide_a"), _cells(F.col(b)).alias("b"), _wide_cells(F.col(b)).alias("wide_b"))
    df = df.withColumn(cells, sides)
    own_a, own_b = F.col(cells)["a"], F.col(cells)["b"]
    most = F.greatest(F.size(own_a), F.size(own_b))
    common = F.least(F.size(F.array_intersect(own_a, F.col(cells)["wide_b"])), F.size(F.array_intersect(own_b, F.col(cells)["wide_a"])))
    return df.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).when(most > 0, common / most).otherwise(F.lit(1.0))).drop(cells)


def followed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text) in ranges of ids, with copies of each range's first rows at the end of the range before.

    Columns _bucket, _guest and _key; ordering by (_guest, _key, text) in a bucket puts every row before its successor, and
    the last row of all before the first. A range has about RANGE_BYTES of texts, and only the first ids of the ranges reach the driver.
    """
    key = F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), key.alias("_key"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_column)), F.lit(0)) + 1)).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, math.ceil(total / RANGE_BYTES)))
    cuts = [k / ranges for k in range(1, ranges)]
    keys = docs.select(key.alias("_key"))
    bounds = keys.agg(F.percentile_approx("_key", cuts, 10 * ranges + 1000)).first()[0] if cuts and total else []
    numbered = keys.withColumn("_bucket", range_of(F.col("_key"), sorted(set(bounds or []))))
    firsts = sorted(r[0] for r in numbered.groupBy("_bucket").agg(F.min("_key")).select(F.col("min(_key)")).collect())  # one id a range
    bucket = range_of(F.col("_key"), firsts[1:])
    n = max(1, len(firsts))
    # A range's first id is the bound that its rows were placed by.
    is_first = F.col("_key") == F.element_at(_numbers(firsts), bucket + 1) if firsts else F.lit(False)
    here = F.struct(bucket.alias("_bucket"), F.lit(0).alias("_guest"))
    before = F.struct(F.pmod(bucket - 1, F.lit(n)).cast("int").alias("_bucket"), F.lit(1).alias("_guest"))
    both = F.explode(F.when(is_first, F.array(here, before)).otherwise(F.array(here)))
    return rows.withColumn("_place", both).select("doc_id", "text", "_key", "_place._bucket", "_place._guest")


def _numbers(values: list[int]) -> Column:
    """A constant array, folded to one literal however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds that are not above the key, by binary search in the sorted list."""
    if not bounds:
        return F.lit(0)
    listed = _numbers(bounds)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.get(listed, middle) <= key)
        return F.struct(
            F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high")
        )

    return F.aggregate(steps, start, halve, lambda s: s["low"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness to each other and to the next document's.

    Returns doc_id, n_chars, edited (the text with its last half, rounded down, replaced by as many first characters of the
    next document), anchors, edited_anchors array<struct<pos, hash>>, near_edited and near_next. The next document is that
    of the next larger doc_id, after the last the first; rows of one doc_id follow in the order of their texts, null ids come first.
    Null texts count as empty: no anchors, likeness 1 to another text without tokens, else 0. Whole texts are read, an empty table
    gives no rows, extra columns aren't read. One shuffle moves each text once; the ranges' boundaries come from quantiles of the ids.
    """
    rows = followed(docs, id_column, text_column).repartition("_bucket")
    rows = with_anchors(rows, "text", "anchors")
    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", "text")
    rows = rows.withColumn("_next", F.lead(F.struct("text", "anchors")).over(order)).filter("_guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next.text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "anchors", F.col("_next.anchors").alias("_next_anchors"))
    rows = with_anchors(rows, "edited", "edited_anchors")
    rows = with_likeness(rows, "anchors", "edited_anchors", "near_edited")
    return with_likeness(rows, "anchors", "_next_anchors", "near_next").drop("_next_anchors")

"""Line dedup: exact and near copies of lines found by a segment-partition edit join, in built-in functions only."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.llm.common import checkpointed, may_be_among

THRESHOLD = 2  # edits between near copies
SHORTEST = 20  # characters of the shortest line that is compared; shorter lines are always kept


def line_key(line: Column) -> Column:
    """What is compared of a line: without blanks, tabs and carriage returns at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def length_class(length: Column, threshold: int) -> Column:
    """Least length of the class of a length: classes are about an eighth as wide as their lengths, and no narrower than threshold + 1."""
    least = max(2, (threshold + 1).bit_length())
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))).cast("int") - 3, F.lit(least)))
    return length - length % width


def places(threshold: int) -> list[tuple[int, bool, int]]:
    """(segment, counted from the end, shift) of the substrings of a line that are looked up; those of shift 0 are index entries.

    A line of a class has threshold + 1 segments, a (threshold + 1)-th of the least length of the class each; the first half of them lie side by
    side from its start, the others from its end. Of two lines within the threshold, some segment i of the shorter one is untouched
    with at most i edits before it and at most threshold - i behind it, so it lies in the other line at most min(i, threshold - i)
    characters off, counted from the nearer end.
    """
    found = []
    for i in range(threshold + 1):
        reach = min(i, threshold - i)
        found += [(i, i > threshold - i, shift) for shift in range(-reach, reach + 1)]
    return sorted(found, key=lambda p: (p[2] != 0, p))


def probes(line: Column, length: Column, own: Column, lower: Column, threshold: int) -> Column:
    """Hash keys of a line, those of its threshold + 1 index entries first; `own` and `lower` are the classes of its length and of the least
    length of a line within the threshold.

    A key is a hash of the class, the segment's number and the substring. A line is indexed in its own class and looked up there; if shorter
    lines within the threshold may belong to the class below, it is looked up there too.
    """

    def keys(least):
        size = F.floor(least / (threshold + 1)).cast("int")
        made = []
        for i, from_end, shift in places(threshold):
            start = (length - size * (threshold + 1 - i) if from_end else size * i) + shift
            made.append(F.xxhash64(least, F.lit(i), F.substring(line, start + 1, size)))
        return F.array(*made)

    return F.concat(keys(own), F.when(lower < own, keys(lower)).otherwise(F.array().cast("array<bigint>")))


def within_edits(a: Column, b: Column, threshold: int) -> Column:
    """Whether two arrays of characters are at most `threshold` edits apart: banded, bit-parallel.

    Row e of the state has one bit for each of the 2 * threshold + 1 diagonals: set if the prefix of `b` read so far and the
    prefix of `a` on that diagonal are within e edits. A character of `b` moves all diagonals at once: kept where it
    matches, substituted in place, inserted one diagonal down, and characters of `a` left out one diagonal up.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1
    state = F.array(*[F.lit(sum(1 << (threshold + k) for k in range(e + 1)) & full) for e in range(threshold + 1)])

    def step(rows, j):
        c = F.get(b, j)
        match = F.lit(0)
        for d in range(width):
            at = (j + (d - threshold)).cast("int")
            bit = F.when((at >= 0) & F.coalesce(F.get(a, at) == c, F.lit(False)), F.lit(1 << d)).otherwise(F.lit(0))
            match = match.bitwiseOR(bit)
        # The match mask is bound once, then the rows are built from the one with fewest edits up.
        def rows_of(mask):
            def grow(made, e):
                same, less = F.get(rows, e).bitwiseAND(mask), F.get(rows, e - 1)
                new = same.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(F.get(made, e - 1), 1))
                return F.concat(made, F.array(new.bitwiseAND(F.lit(full))))

            fewest = F.array(F.get(rows, 0).bitwiseAND(mask))
            return F.aggregate(F.array(*[F.lit(e) for e in range(1, threshold + 1)]), fewest, grow) if threshold else fewest

        return F.get(F.transform(F.array(match), rows_of), 0)

    end = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), state, step)
    reached = F.call_function("shiftright", F.get(end, threshold), F.size(a) - F.size(b) + threshold).bitwiseAND(F.lit(1)) == 1
    near = F.abs(F.size(a) - F.size(b)) <= threshold
    return F.when(~near, F.lit(False)).when(F.size(b) == 0, F.size(a) <= threshold).otherwise(reached)


# Characters that are counted, seven to a number.
LETTERS = ("eanito ", "srlhdcu", "0123456", "789mpgf")


def letters(text: Column) -> list[Column]:
    """Counts of some characters, seven to a number, a byte each; a cheap bound on the edits between two lines."""
    made = []
    for group in LETTERS:
        packed = F.lit(0).cast("bigint")
        for k, letter in enumerate(group):
            n = F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
            packed = packed + F.call_function("shiftleft", F.pmod(n, F.lit(64)).cast("bigint"), F.lit(8 * k))
        made.append(packed)
    return made


def letters_apart(x: Column, y: Column) -> Column:
    """Lower bound of twice the edits between lines with these counts of one group (counts are kept modulo 64)."""
    total = F.lit(0).cast("bigint")
    for k in range(7):
        d = F.call_function("shiftright", x, F.lit(8 * k)).bitwiseAND(F.lit(63)) - F.call_function("shiftright", y, F.lit(8 * k)).bitwiseAND(F.lit(63))
        total = total + F.least(F.pmod(d, F.lit(64)), F.pmod(-d, F.lit(64)))
    return total


def distinct_lines(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(hash, line, place), lines repeated as they stand -> (node, hash, place, keys), one row per line with its first place, written.

    Texts are read once and stay where they are: only the keys move, combined per task.
    """
    # Lengths and classes are columns of their own, so that each is computed once.
    measured = lines.select("hash", "place", "line", F.length("line").alias("n"))
    shorter = F.greatest(F.col("n") - threshold, F.lit(0))
    measured = measured.select("*", length_class(F.col("n"), threshold).alias("own"), length_class(shorter, threshold).alias("lower"))
    keys = probes(F.col("line"), F.col("n"), F.col("own"), F.col("lower"), threshold)
    keyed = measured.select("hash", "place", keys.alias("keys"))
    grouped = keyed.groupBy("hash").agg(F.min("place").alias("place"), F.first("keys").alias("keys"))
    return checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()))  # short names, fixed by the checkpoint


def near_copies(distinct: DataFrame, text_of: Callable[[DataFrame], DataFrame], threshold: int = THRESHOLD) -> DataFrame:
    """`distinct_lines` -> hashes of lines with a near copy at an earlier place; `text_of` finds (line, place) for rows that have a place.

    Keys that a line shares with another, of which one is an index entry, are found first; then the text of only these lines is looked up.
    A line is of interest if an earlier one with the same key may be near it by their character counts. It is compared with the earliest
    of the possible partners of each key first; lines that this doesn't settle meet all partners of their keys. Each of these joins
    gives a line once for each of its keys, however many others share them: lines that share a key are compared where they lie and
    never listed in pairs. Lines of any length take part.
    """
    keyed = distinct.select("node", F.posexplode("keys").alias("at", "key")).select("node", "key", (F.col("at") <= threshold).alias("is_index"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("_a"), F.max("node").alias("_b"), F.max(F.col("is_index").cast("int")).alias("_i"))
    shared = checkpointed(shared.filter("_a <> _b and _i = 1").select("key"))
    met = checkpointed(may_be_among(keyed, F.col("key"), shared, F.col("key")).join(shared, "key"))
    wanted = checkpointed(distinct.select("node", "hash", "place").join(met.select("node").distinct(), "node", "left_semi"))
    texts = text_of(wanted).dropDuplicates(["place"]).join(wanted, "place")
    texts = checkpointed(texts.select("node", "hash", "line", "place"))
    head = F.substring(F.col("line"), F.lit(1), F.floor(F.length("line") / 2).cast("int"))
    counts = [c.alias(f"bag{k}") for k, c in enumerate(letters(F.col("line")))] + [c.alias(f"head{k}") for k, c in enumerate(letters(head))]
    placed = checkpointed(met.join(texts.select("node", "place", *counts), "node"))

    def earlier_partner(a: str, b: str) -> Column:
        """Whether the row `a` stands earlier than `b`, one of them is indexed, and their counts allow the threshold.

        An edit changes two counts of a line by one at most. The first halves of two lines within the threshold also differ by up to
        threshold + 1 characters that the edits have moved over the middle.
        """
        condition = (F.col(f"{a}.key") == F.col(f"{b}.key")) & (F.col(f"{a}.place") < F.col(f"{b}.place")) & (F.col(f"{a}.is_index") | F.col(f"{b}.is_index"))
        for name, most in (("bag", 2 * threshold), ("head", 3 * threshold + 1)):
            apart = F.lit(0).cast("bigint")
            for k in range(len(LETTERS)):
                apart = apart + letters_apart(F.col(f"{a}.{name}{k}"), F.col(f"{b}.{name}{k}"))
            condition = condition & (apart <= most)
        return condition

    def near(a: str, b: str) -> Column:
        # The arrays of characters are bound once for all steps of the comparison.
        both = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
        return F.get(F.transform(both, lambda v: within_edits(v["x"], v["y"], threshold)), 0)

    later = checkpointed(placed.alias("b").join(placed.alias("a"), earlier_partner("a", "b"), "left_semi"))
    partners = checkpointed(placed.alias("a").join(later.alias("b"), earlier_partner("a", "b"), "left_semi"))
    full = texts.select("node", "line")
    own = [c for c in placed.columns if c != "key"]
    earliest = partners.groupBy("key").agg(F.min(F.struct("place", *[c for c in own if c != "place"])).alias("_first"))
    earliest = earliest.select("key", *[F.col(f"_first.{c}").alias(c) for c in own])
    pairs = later.alias("b").join(earliest.alias("a"), earlier_partner("a", "b")).select(F.col("a.node").alias("x"), F.col("b.node").alias("node")).distinct()
    pairs = pairs.join(full, "node").join(full.select(F.col("node").alias("x"), F.col("line").alias("line_x")), "x")
    settled = checkpointed(pairs.filter(near("line_x", "line")).select("node").distinct())
    open_ = later.join(settled, "node", "left_anti").join(full, "node")
    rest = open_.alias("b").join(partners.join(full, "node").alias("a"), earlier_partner("a", "b") & near("a.line", "b.line"), "left_semi")
    found = settled.union(rest.select("node").distinct())
    return texts.join(found, "node", "left_semi").select("hash")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, shortest: int = SHORTEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of `docs` with the text cut to the lines that are kept, and n_lines, n_removed.

    Lines end at line feeds. A line of at least `shortest` characters (blanks at its ends not counted) is kept where it stands first, by
    doc_id (null last) and line number, unless a different line within `threshold` edits (inserted, deleted or replaced characters) stands
    earlier still. All other places of it are removed, within a document too. Shorter lines are kept. So of a chain of near copies the
    first line stays, which never needs their pairs as a whole.

    Null texts stay null and empty ones empty with 0 lines; a document may lose all its lines and stays with an empty text. Rows of the
    same doc_id and text are treated alike; of rows with the same doc_id and different texts, a line number that is kept in one is kept in
    all. Texts are read whole, an empty table gives no rows; columns named n_lines or n_removed are replaced.
    """
    made = ["n_lines", "n_removed"]
    kept_columns = [c for c in docs.columns if c.lower() not in made]
    # The user's columns travel in one struct, so that no name used here meets one of theirs.
    doc = F.col(id_column).cast("bigint")
    rows = docs.select(
        doc.isNull().cast("int").alias("last"), F.coalesce(doc, F.lit(0)).cast("bigint").alias("id"), F.col(text_column).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"),
    )
    cut = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    raw = rows.select("last", "id", F.posexplode(cut).alias("at", "raw"))

    def described(occurrences: DataFrame) -> DataFrame:
        """(line, place) of the lines that are compared; the hash in a place tells lines of repeated ids apart."""
        measured = occurrences.select("last", "id", "at", line_key(F.col("raw")).alias("line"))
        measured = measured.select("*", F.length("line").alias("n")).filter(F.col("n") >= shortest)
        return measured.select("line", F.struct("last", "id", "at", F.xxhash64("line").alias("h")).alias("place"))

    def text_of(wanted: DataFrame) -> DataFrame:
        # Most lines are left by their number, before anything is made of them.
        return described(may_be_among(raw, F.xxhash64("last", "id", "at"), wanted, F.xxhash64("place.last", "place.id", "place.at")))

    distinct = distinct_lines(described(raw).withColumn("hash", F.unhex(F.md5("line"))), threshold)
    near = near_copies(distinct, text_of, threshold)
    keeps = distinct.select("hash", "place").join(near, "hash", "left_anti").select("place.last", "place.id", "place.at")
    # Kept lines of a document as a dense array of 64-bit words: bit n of the text's n-th line. A very long text has many words.
    words = keeps.groupBy("last", "id", F.expr("at div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")
    )
    words = words.groupBy("last", "id").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("map"), F.max("word").alias("top"))
    dense = F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.element_at("map", w), F.lit(0).cast("bigint")))
    joined = rows.join(words.select("last", "id", dense.alias("kept")), ["last", "id"], "left")

    def stays(line, at):
        word = F.coalesce(F.get(F.col("kept"), F.floor(at / 64).cast("int")), F.lit(0).cast("bigint"))
        return (F.call_function("getbit", word, (at % 64).cast("int")) == 1) | (F.length(line_key(line)) < shortest)

    result = joined.withColumn("stay", F.filter(cut, stays))
    text = F.when(F.col("text").isNotNull(), F.array_join("stay", "\n"))
    n = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(cut)).otherwise(F.lit(0))
    return result.select(
        *[text.alias(c) if c == text_column else F.col(f"row.`{c}`") for c in kept_columns],
        n.cast("bigint").alias("n_lines"), F.greatest(n - F.size("stay"), F.lit(0)).cast("bigint").alias("n_removed"),
    )

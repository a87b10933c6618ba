"""Spelling variants: words one edit apart, met through partition-and-enumerate signatures of their letters."""

import itertools
import math

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.llm.common import checkpointed

RUN_REGEX = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x100))
# Letters by falling frequency are dealt to the parts in turn, so that each part holds about as many letters of a word.
BY_FREQUENCY = "etaoinshrdlcumwfgypbvkjxqz"
PARTS = 4
LEAST_LENGTH, LEAST_COUNT = 6, 5
ODD_ONE = 199  # one in so many (document, word) pairs loses a code point
FORM_FACTOR = 5  # a form is at least so many times as frequent as its variant


def _part_of(letter: str) -> int:
    place = BY_FREQUENCY.find(letter)
    return (place if place >= 0 else ord(letter)) % PARTS


def _lowered(run: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII, the usual case, takes the faster way."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): lower-cased letter runs of all texts with at least that many code points and occurrences.

    Where ODD_ONE divides the checksum of document and run, the run loses one code point, the same one wherever it stands in the document.
    Null and empty texts have no words, a null id counts as an empty one, repeated rows count each time; runs of any length take part.
    """
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(text_column, F.lit(RUN_REGEX), 0)).alias("r"))
    # Shorter runs never give a word: only deletions happen.
    runs = runs.filter(F.length("r") >= least_length).select("i", _lowered(F.col("r")).alias("r"))
    hashed = runs.select("r", F.crc32(F.encode(F.concat("i", F.lit(":"), "r"), "utf-8")).alias("h"))
    at = F.pmod(F.col("h"), F.length("r")).cast("int")
    cut = F.concat(F.substring(F.col("r"), F.lit(1), at), F.substring(F.col("r"), at + 2, F.length("r")))
    made = hashed.select(F.when(F.col("h") % ODD_ONE == 0, cut).otherwise(F.col("r")).alias("word")).filter(F.length("word") >= least_length)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def signatures(word: Column) -> Column:
    """Keys of a word: any two words one edit apart share at least one.

    The letters of a word, counted, are a binary vector with a place for each letter and count: an inserted letter changes one place and
    a replaced one two. The letters fall into PARTS parts. Of words of equal length at most two parts differ, so they agree on some PARTS - 2
    parts; of words whose lengths differ by one a single part differs. Every such choice of parts with its letters is a signature. Each
    carries the (shorter) length and, as a second key that splits groups of words with the same letters, the first or the last half of the
    word: an edit leaves one of them as it is.
    """
    ordered = F.array_join(F.array_sort(F.split(word, "")), "")
    every = LOWER + ACCENTED
    parts = [F.translate(ordered, "".join(c for c in every if _part_of(c) != p), "") for p in range(PARTS)]

    def keys(w):
        n = w["n"]
        made = []
        for kind, left_out in ((0, 2), (1, 1), (2, 1)):  # equal lengths; as the shorter word; as the longer word
            size = n - 1 if kind == 2 else n
            half = F.floor(size / 2).cast("int")
            for kept in itertools.combinations(range(PARTS), PARTS - left_out):
                letters = [x for p in kept for x in (w[f"p{p}"], F.lit("|"))]
                named = F.lit(left_out * 100 + sum(1 << p for p in kept))
                first = F.substring(w["word"], F.lit(1), half)
                last = F.substring(w["word"], n - (size - half) + 1, size - half)
                made += [F.xxhash64(named, size, *letters, F.lit(side), text) for side, text in ((0, first), (1, last))]
        return F.array_distinct(F.array(*made))

    bound = F.array(F.struct(word.alias("word"), F.length(word).alias("n"), *[x.alias(f"p{p}") for p, x in enumerate(parts)]))
    return F.get(F.transform(bound, keys), 0)


def links(counted: DataFrame) -> DataFrame:
    """(word, n) -> (word, n, other, other_n) for every ordered pair of words that are exactly one edited code point apart.

    Words meet on equal signatures only and are compared in the join itself, so a pair that is no link is never written.
    """
    keyed = counted.select(F.explode(signatures(F.col("word"))).alias("key"), "word", "n")
    x, y = keyed.alias("x"), keyed.alias("y")
    smaller = F.col("x.word") < F.col("y.word")
    one_edit = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & smaller & one_edit)
    pairs = met.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n")).distinct()
    ways = F.array(*[F.struct(F.col(u).alias("word"), F.col(f"{u}_n").alias("n"), F.col(v).alias("other"), F.col(f"{v}_n").alias("other_n")) for u, v in ("ab", "ba")])
    return pairs.select(F.inline(ways))


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the texts, the more usual spelling next to it, and the last of such spellings.

    The form is the most frequent near word (ties: the smallest in code-point order) if it is at least FORM_FACTOR times as frequent as the
    word, else null; the root is reached from the word by going from form to form. Frequencies grow by that factor at each step, so the way
    is short and is walked by doubling. No texts or no words give no rows; extra columns aren't read.
    """
    counted = checkpointed(words(docs, id_column=id_column, text_column=text_column))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = links(counted).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form_n = -F.col("best.n")
    formed = counted.join(near, "word", "left").withColumn("_ok", form_n >= FORM_FACTOR * F.col("n"))
    formed = formed.select(
        "word", F.when(F.col("_ok"), F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("_ok"), form_n).alias("form_n"),
    )
    formed = checkpointed(formed)
    most = counted.agg(F.max("n")).first()[0] or LEAST_COUNT
    steps = math.ceil(math.log(max(most, 1), FORM_FACTOR)) + 1
    hops = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1))) + 1):
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        hops = checkpointed(hops.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(hops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

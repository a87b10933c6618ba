"""Spans in notes: character offsets, sentences and context windows.

Finding offsets is the one step without a built-in expression: an Arrow function reads each text once and
returns the span rows; everything around it (ids, joins, votes) stays in Spark expressions.
"""

import re
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from heapq import merge
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from clinspark.functions.keys import joined_id, key_hash
from clinspark.functions.text import DATE_REGEX, accent_table, char_context

DATE_PATTERNS = {"date": DATE_REGEX}
SENTENCE_END = r"[.!?]+[ \t\r\n]|\n"
WORD_END = r"[ \t\r\n]+"


class ContextWindow:
    """Context of a span: sentences and/or words around it (the wider of both), or characters."""

    def __init__(self, sentences=None, words=None, chars: int | None = None, norm: bool = False):
        # An int n means the sentence of the span and n-1 on each side; a pair gives the two sides.
        if isinstance(sentences, int):
            sentences = (sentences, sentences)
        if sentences is None and words is None and chars is None:
            sentences = (1, 1)
        self.sentences = None if sentences is None else tuple(max(n - 1, 0) for n in sentences)
        self.words = None if words is None else tuple(abs(n) for n in words)
        self.chars = chars
        self.norm = norm

    def key(self) -> tuple:
        return self.sentences, self.words, self.chars, self.norm

    def bounds(self, length: int, start: int, end: int, sentence_starts, word_starts) -> tuple[int, int]:
        begins, stops = [], []
        if self.chars is not None:
            begins.append(max(start - self.chars, 0))
            stops.append(min(end + self.chars, length))
        for sides, starts in ((self.sentences, sentence_starts), (self.words, word_starts)):
            if sides is not None:
                first = bisect_right(starts, start) - 1 - sides[0]
                last = bisect_right(starts, max(end - 1, start)) + sides[1]
                begins.append(starts[max(first, 0)])
                stops.append(starts[last] if last < len(starts) else length)
        return min(begins), max(stops)


def _folded(raw: str, accents: dict) -> str:
    """Lower case without accents and as long as the text: a letter whose lower case has several characters stays as it is."""
    plain = raw.translate(accents)
    low = plain.lower()
    return low if len(low) == len(raw) else "".join(c if len(c.lower()) != 1 else c.lower() for c in plain)


# Characters of spans and contexts, and rows, after which an output batch ends.
BATCH_CHARS = 1 << 20
BATCH_ROWS = 1 << 13
# Spans of one group: a longer run of spans with the same contexts is cut.
GROUP_SPANS = 1 << 10
SPAN_NAMES = ["label", "lexical_variant", "start", "end"]
SPAN_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32()]


def _starts(text: str, boundary: re.Pattern) -> list[int]:
    """Offsets at which the segments that tile the text begin; a boundary closes its segment."""
    return [0] + [m.end() for m in boundary.finditer(text) if m.end() < len(text)]


def _ends(text: str, boundary: re.Pattern):
    """Offsets at which these segments end."""
    yield from (m.end() for m in boundary.finditer(text) if m.end() < len(text))
    yield len(text)


def extract_spans(
    notes: DataFrame,
    patterns: Mapping[str, str] = DATE_PATTERNS,
    keys: Sequence[str] = ("note_id",),
    text: str = "note_text",
    channel: str | None = None,
    contexts: Mapping[str, ContextWindow] | None = None,
) -> DataFrame:
    """One row per span: keys, span_id, label, lexical_variant, start, end and the asked context columns.

    `channel` TEXT searches the text as it stands, NORM its lower-case form without accents, which has the same offsets;
    by default the date pattern is searched in NORM and all other patterns in TEXT.

    Matches are leftmost and non-overlapping per label; whole texts are searched; start is 0-based, end exclusive.
    """
    contexts = dict(contexts or {})
    search = _searcher(patterns, contexts, channel)
    names, kinds = [*SPAN_NAMES, *contexts], [*SPAN_KINDS, *[pa.string()] * len(contexts)]
    return _with_span_id(_map_texts(notes, keys, text, search, names, kinds), keys)


def span_groups(
    notes: DataFrame,
    shared: Mapping[str, ContextWindow],
    patterns: Mapping[str, str] = DATE_PATTERNS,
    keys: Sequence[str] = ("note_id",),
    text: str = "note_text",
    channel: str | None = None,
    contexts: Mapping[str, ContextWindow] | None = None,
) -> DataFrame:
    """One row per run of spans with the same `shared` contexts: keys, these contexts, and `_spans`, an array of the spans.

    What depends on the shared contexts only is computed once per run: a sentence without an end may be a whole text with thousands of
    spans, and one copy of it for each would grow with its square. `grouped_spans` gives the spans back, those of `extract_spans`.
    """
    shared, contexts = dict(shared), dict(contexts or {})
    search = _searcher(patterns, contexts, channel, shared)
    span = pa.struct(list(zip([*SPAN_NAMES, *contexts], [*SPAN_KINDS, *[pa.string()] * len(contexts)])))

    def grouped(raw):
        run, last = [], None
        for values, around in search(raw):
            if run and (around.key != last.key or len(run) == GROUP_SPANS or sum(map(len, run[-1][4:])) * len(run) > BATCH_CHARS):
                yield *last.texts(), run
                run = []
            last = around
            run.append(values)
        if run:
            yield *last.texts(), run

    return _map_texts(notes, keys, text, grouped, [*shared, "_spans"], [*[pa.string()] * len(shared), pa.list_(span)])


def grouped_spans(groups: DataFrame, keys: Sequence[str] = ("note_id",), keep: Sequence[str] = ()) -> DataFrame:
    """One row per span of `span_groups`, as `extract_spans` gives it, with columns `keep` of its group."""
    return _with_span_id(groups.select(*keys, F.inline("_spans"), *keep), keys)


class _Around:
    """Shared contexts of a span: their bounds tell runs apart, the texts are cut once per run."""

    def __init__(self, key, windows, raw, folded):
        self.key, self.windows, self.raw, self.folded = key, windows, raw, folded

    def texts(self):
        return [(self.folded if w.norm else self.raw)[a:b] for w, (a, b) in zip(self.windows, self.key)]


def _searcher(
    patterns: Mapping[str, str], contexts: Mapping[str, ContextWindow], channel: str | None, shared: Mapping[str, ContextWindow] | None = None
):
    """Function text -> its spans one by one, as tuples of the span columns and contexts; with `shared` as (tuple, shared contexts) by start."""
    compiled = [
        (label, re.compile(pattern), channel == "NORM" or channel is None and pattern == DATE_REGEX)
        for label, pattern in patterns.items()
    ]
    shown, common = list(contexts.values()), list((shared or {}).values())
    needs_sentences = any(w.sentences is not None for w in shown + common)
    needs_words = any(w.words is not None for w in shown + common)
    needs_folded = any(in_norm for *_, in_norm in compiled) or any(w.norm for w in shown + common)
    accents = str.maketrans(*accent_table())
    sentence_end, word_end = re.compile(SENTENCE_END), re.compile(WORD_END)

    def matches(label, pattern, searched):
        return ((m.start(), m.end(), label) for m in pattern.finditer(searched) if m.end() > m.start())

    def search(raw):
        if not raw:
            return
        folded = _folded(raw, accents) if needs_folded else raw
        found = [matches(label, pattern, folded if in_norm else raw) for label, pattern, in_norm in compiled]
        sentence_starts = word_starts = None
        for start, end, label in chain(*found) if shared is None else merge(*found, key=lambda m: m[0]):
            if needs_sentences and sentence_starts is None:
                sentence_starts = _starts(raw, sentence_end)
            if needs_words and word_starts is None:
                word_starts = _starts(raw, word_end)
            cut = []
            for window in shown:
                begin, stop = window.bounds(len(raw), start, end, sentence_starts, word_starts)
                cut.append((folded if window.norm else raw)[begin:stop])
            values = (label, raw[start:end], start, end, *cut)
            if shared is None:
                yield values
            else:
                key = [w.bounds(len(raw), start, end, sentence_starts, word_starts) for w in common]
                yield values, _Around(key, common, raw, folded)

    return search


def _batches(batch: pa.RecordBatch, search, names, kinds):
    """Batches of the keys and what `search` yields for each text. A batch ends when it holds enough, also within a text."""
    rows, columns, size = [], [[] for _ in names], 0

    def made():
        taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
        values = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(taken + values, [*batch.schema.names[:-1], *names])

    for row, raw in enumerate(batch.column(batch.num_columns - 1)):
        for found in search(raw.as_py()):
            rows.append(row)
            for column, value in zip(columns, found):
                column.append(value)
                if isinstance(value, str):
                    size += len(value)
                elif isinstance(value, list):
                    size += sum(50 + sum(len(v) for v in one if isinstance(v, str)) for one in value)
            if size > BATCH_CHARS or len(rows) == BATCH_ROWS:
                yield made()
                rows, columns, size = [], [[] for _ in names], 0
    if rows:
        yield made()


def _spark_type(kind: pa.DataType) -> T.DataType:
    if pa.types.is_list(kind):
        return T.ArrayType(T.StructType([T.StructField(f.name, _spark_type(f.type)) for f in kind.value_type]))
    return {pa.string(): T.StringType(), pa.int32(): T.IntegerType()}[kind]


def _map_texts(notes: DataFrame, keys: Sequence[str], text: str, search, names, kinds) -> DataFrame:
    """Run a function text -> rows in an Arrow function over (keys, text) where they are read; only these columns are read."""
    source = notes.select(*keys, text)
    added = [T.StructField(n, _spark_type(k)) for n, k in zip(names, kinds)]

    def run(batches):
        for batch in batches:
            yield from _batches(batch, search, names, kinds)

    return source.mapInArrow(run, T.StructType(list(source.schema.fields[:-1]) + added))


def _with_span_id(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    span_id = key_hash("span", *keys, "label", "start", "end").alias("span_id")
    return rows.select(*keys, span_id, *[c for c in rows.columns if c not in keys])


def sentences(notes: DataFrame, keys: Sequence[str] = ("note_id",), text: str = "note_text") -> DataFrame:
    """One row per sentence with its offsets; sentences tile the note."""
    boundary = re.compile(SENTENCE_END)
    names = ["sentence_id", "start", "end", "sentence"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def split(raw):
        start = 0
        for k, end in enumerate(_ends(raw, boundary) if raw else []):
            yield k, start, end, raw[start:end]
            start = end

    return _map_texts(notes, keys, text, split, names, kinds)


def span_context(spans: DataFrame, text: str = "note_text", width: int = 100, name: str = "context") -> DataFrame:
    """Character context for spans that carry their note text."""
    return spans.withColumn(name, char_context(text, "start", "end", width))


def spans_to_rows(
    notes: DataFrame, spans: str = "spans", attributes: Sequence[str] = (), doc_attributes: Sequence[str] = ("person_id",)
) -> DataFrame:
    """Notes with an array of span structs -> one row per span, with span and note attributes."""
    rows = notes.select("note_id", *doc_attributes, F.explode(spans).alias("_s"))
    base = [F.col(f"_s.{c}").alias(c) for c in ("lexical_variant", "label", "start", "end")]
    return rows.select("note_id", *doc_attributes, *base, *[F.col(f"_s.{a}").alias(a) for a in attributes])


def span_lists(
    notes: DataFrame, patterns: Mapping[str, str] = DATE_PATTERNS, text: str = "note_text", name: str = "spans"
) -> DataFrame:
    """Notes with an array of their spans: no row is moved."""
    search = _searcher(patterns, {}, None)
    span = pa.struct(list(zip(SPAN_NAMES, SPAN_KINDS)))

    def find(texts: pa.Array) -> pa.Array:
        # The spans of some texts at a time are Python objects, the others are in Arrow arrays already.
        made, lists, size = [], [], 0
        for raw in texts:
            lists.append(list(search(raw.as_py())))
            size += len(lists[-1])
            if size > BATCH_ROWS:
                made.append(pa.array(lists, pa.list_(span)))
                lists, size = [], 0
        return pa.concat_arrays([*made, pa.array(lists, pa.list_(span))])

    kind = "array<struct<label:string,lexical_variant:string,start:int,end:int>>"
    # Not deterministic to the optimizer, which would else search the texts a second time in a filter for empty lists before an explode.
    return notes.withColumn(name, F.arrow_udf(find, kind).asNondeterministic()(F.col(text)))


def preannotate(
    notes: DataFrame, patterns: Mapping[str, str] = DATE_PATTERNS, order: str = "annotation_order"
) -> DataFrame:
    """Notes with automatic entities, marked as not seen, ready for annotation; notes without entities stay."""
    optional = [c for c in (order, "visit_start_datetime") if c in notes.columns]
    ordered = F.array_sort(
        F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["label"], s["lexical_variant"].alias("text")))
    )
    entities = F.transform(
        ordered,
        lambda s: F.struct(
            joined_id(F.lit("automatic"), s["label"], s["start"], s["end"]).alias("id"),
            s["text"].alias("text"),
            s["label"].alias("label"),
            s["start"].alias("begin"),
            s["end"].alias("end"),
        ),
    )
    return span_lists(notes, patterns, name="_spans").select(
        F.col("note_id").cast("string").alias("note_id"),
        F.col("person_id").cast("string").alias("person_id"),
        F.col("note_date").cast("string").alias("note_date"),
        "note_text",
        *optional,
        F.lit(False).alias("seen"),
        entities.alias("entities"),
    )

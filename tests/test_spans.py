import datetime
import re
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from clinspark.functions.text import char_context, fold_accents, norm_text, normalize_name, normalized_name, resolve_date
from clinspark.operators import spans as sp

TEXTS = {
    1: "Biopsie le 12/03/2020. TEP le 1er avril 2021\nIRM mars 2019! fin 03/04",
    2: "",
    3: None,
    4: "12/03/2020",
    5: "Œdème, élève à l’hôpital le 5/6/19... Vu en août 2020.\n\nSuite? Oui",
    6: "aucune date ici",
}


@pytest.fixture(scope="module")
def notes(spark):
    rows = [(k, k * 10, datetime.date(2021, 6, 30), v) for k, v in TEXTS.items()]
    return spark.createDataFrame(rows, "note_id long, person_id long, note_date date, note_text string")


def test_spans_have_python_offsets(notes):
    got = {(r.note_id, r.start, r.end, r.lexical_variant) for r in sp.extract_spans(notes).collect()}
    found = {
        1: ["12/03/2020", "1er avril 2021", "mars 2019", "03/04"], 4: ["12/03/2020"], 5: ["5/6/19", "août 2020"],
    }
    assert got == {(k, TEXTS[k].index(v), TEXTS[k].index(v) + len(v), v) for k, values in found.items() for v in values}


def test_dates_with_accents_capitals_and_iso(spark):
    text = "Biopsie le 12 février 2023. TEP le 3 Août 2021. IRM DÉCEMBRE 2020. Vu le 2020-05-12, n° 112/05/2020."
    notes = spark.createDataFrame([(1, text)], "note_id long, note_text string")
    rows = sp.extract_spans(notes).orderBy("start").collect()
    assert [r.lexical_variant for r in rows] == ["12 février 2023", "3 Août 2021", "DÉCEMBRE 2020", "2020-05-12"]
    assert all(text[r.start : r.end] == r.lexical_variant for r in rows)
    dated = sp.extract_spans(notes).select(resolve_date("lexical_variant", F.lit(datetime.date(2023, 6, 1))).cast("string").alias("d"))
    assert {r.d for r in dated.collect()} == {"2023-02-12", "2021-08-03", "2020-12-15", "2020-05-12"}


def test_normalised_channel_keeps_offsets(notes):
    rows = sp.extract_spans(notes, {"w": "aout|eleve|hopital"}, channel="NORM").collect()
    assert {(r.note_id, r.lexical_variant) for r in rows} == {(5, "août"), (5, "élève"), (5, "hôpital")}
    assert all(TEXTS[r.note_id][r.start : r.end] == r.lexical_variant for r in rows)


def test_sentences_tile_the_text(notes):
    rows = sp.sentences(notes).orderBy("note_id", "sentence_id").collect()
    for key, text in TEXTS.items():
        mine = [r for r in rows if r.note_id == key]
        assert "".join(r.sentence for r in mine) == (text or "")
        assert [r.start for r in mine][1:] == [r.end for r in mine][:-1]


def brute_window(text, start, end, before, after, boundary):
    starts = [0] + [m.end() for m in re.finditer(boundary, text) if m.end() < len(text)]
    first = bisect_right(starts, start) - 1
    last = bisect_right(starts, max(end - 1, start)) - 1
    begin = starts[max(first - before, 0)]
    stop = starts[last + after + 1] if last + after + 1 < len(starts) else len(text)
    return begin, stop


@pytest.mark.parametrize("sentences,words", [(1, None), (2, None), ((1, 3), None), (None, (2, 1)), (1, (3, 0))])
def test_context_windows(notes, sentences, words):
    window = sp.ContextWindow(sentences=sentences, words=words)
    for r in sp.extract_spans(notes, contexts={"c": window}).collect():
        text, bounds = TEXTS[r.note_id], []
        if sentences is not None:
            pair = (sentences, sentences) if isinstance(sentences, int) else sentences
            bounds.append(brute_window(text, r.start, r.end, pair[0] - 1, pair[1] - 1, sp.SENTENCE_END))
        if words is not None:
            bounds.append(brute_window(text, r.start, r.end, *words, sp.WORD_END))
        assert r.c == text[min(b for b, _ in bounds) : max(e for _, e in bounds)]


def test_character_context_is_cut_at_the_start(notes):
    rows = sp.extract_spans(notes, contexts={"c": sp.ContextWindow(chars=5)}).collect()
    assert all(r.c == TEXTS[r.note_id][max(r.start - 5, 0) : r.end + 5] for r in rows)
    joined = sp.extract_spans(notes).join(notes.select("note_id", "note_text"), "note_id")
    plain = sp.span_context(joined, width=5).collect()
    assert sorted(r.context for r in plain) == sorted(r.c for r in rows)


def test_preannotation_keeps_notes_without_entities(notes):
    rows = {r.note_id: r for r in sp.preannotate(notes).collect()}
    assert set(rows) == {str(k) for k in TEXTS}
    assert rows["6"].entities == [] and rows["3"].entities == [] and not rows["1"].seen
    first = rows["4"].entities[0]
    assert (first.id, first.text, first.begin, first.end) == ("automatic-date-0-10", "12/03/2020", 0, 10)


def test_spans_to_rows(spark):
    df = spark.createDataFrame(
        [("n1", 7, [("12/03", "date", 0, 5, "A")])],
        "note_id string, person_id long, spans array<struct<lexical_variant:string,label:string,start:int,end:int,lf_1:string>>",
    )
    row = sp.spans_to_rows(df, attributes=["lf_1"]).first()
    assert (row.note_id, row.person_id, row.lexical_variant, row.start, row.lf_1) == ("n1", 7, "12/03", 0, "A")


@pytest.mark.parametrize(
    "mention,note_date,expected",
    [
        ("27 février 2026", "2026-03-01", "2026-02-27"),
        ("1er avril 2021", "2021-06-30", "2021-04-01"),
        ("mars 2019", "2021-06-30", "2019-03-15"),
        ("5/6/19", "2021-06-30", "2019-06-05"),
        ("5/6/85", "2021-06-30", "1985-06-05"),
        ("03/04", "2021-06-30", "2021-04-03"),
        ("03/12", "2021-06-30", "2020-12-03"),
        ("31/02/2020", "2021-06-30", None),
        ("99/99/2020", "2021-06-30", None),
        ("hier", "2021-06-30", None),
        (None, "2021-06-30", None),
    ],
)
def test_resolve_date(spark, mention, note_date, expected):
    df = spark.createDataFrame([(mention, note_date)], "m string, d string").withColumn("d", F.to_date("d"))
    assert df.select(resolve_date("m", "d").cast("string")).first()[0] == expected


def test_names_and_accents(spark):
    df = spark.createDataFrame([("Éàç Œuf ﬁn½ Ñ-日",)], "t string")
    row = df.select(fold_accents("t").alias("f"), norm_text("t").alias("n"), F.length(norm_text("t")).alias("k")).first()
    assert row.f == "eac uf fin12 n-"
    assert row.n.startswith("eac œuf") and row.k == len("Éàç Œuf ﬁn½ Ñ-日")
    name = "Chemotherapy, for (x-y) a.b/c"
    got = spark.createDataFrame([(name,)], "t string").select(normalize_name("t")).first()[0]
    assert got == normalized_name(name) == "chemotherapy_for_x_y_a_b_c"


def test_char_context_expression(spark):
    df = spark.createDataFrame([("0123456789", 2, 4)], "t string, start int, end int")
    assert df.select(char_context("t", "start", "end", 3)).first()[0] == "0123456"


def test_output_batches_are_bounded(spark, monkeypatch):
    """Spans with wide contexts leave in batches of bounded size, and none is lost."""
    from clinspark.operators import spans as sp

    notes = spark.createDataFrame([(k, "a 1 " * 300) for k in range(6)], "note_id long, note_text string").coalesce(1)
    want = sorted(map(tuple, sp.extract_spans(notes, {"n": "[0-9]"}, contexts={"c": sp.ContextWindow(chars=200)}).collect()))
    monkeypatch.setattr(sp, "BATCH_CHARS", 1000)
    got = sorted(map(tuple, sp.extract_spans(notes, {"n": "[0-9]"}, contexts={"c": sp.ContextWindow(chars=200)}).collect()))
    assert got == want and len(got) == 1800


def test_batches_end_within_a_text(spark, monkeypatch):
    """One text may hold any number of spans and sentences: no batch holds them all, and none is lost."""
    import pyarrow as pa

    monkeypatch.setattr(sp, "BATCH_CHARS", 2000)
    notes = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array(["a 1. " * 1000, None])], ["note_id", "note_text"])
    search = sp._searcher({"n": "[0-9]", "a": "a"}, {"c": sp.ContextWindow(chars=200)}, None)
    made = list(sp._batches(notes, search, [*sp.SPAN_NAMES, "c"], [*sp.SPAN_KINDS, pa.string()]))
    assert sum(b.num_rows for b in made) == 2000 and max(b.num_rows for b in made) <= 20
    df = spark.createDataFrame([(7, "a 1. " * 1000), (8, None)], "note_id long, note_text string")
    rows = sp.sentences(df).orderBy("sentence_id").collect()
    assert [r.sentence_id for r in rows] == list(range(1000)) and "".join(r.sentence for r in rows) == "a 1. " * 1000
    lists = {r.note_id: r.spans for r in sp.span_lists(df, {"n": "[0-9]"}).collect()}
    assert [s.start for s in lists[7]] == list(range(2, 5000, 5)) and lists[8] == []


def test_spans_of_one_sentence_share_their_contexts(spark, monkeypatch):
    """A sentence of the whole text leaves once per run of spans, not once per span; the spans and votes are those of single spans."""
    from clinspark.operators import lfs

    texts = ["a 1 é 2 " * 400, "x 1. y 22! z 3\nend 4", "none", "", None]
    notes = spark.createDataFrame(list(enumerate(texts)), "note_id long, note_text string")
    functions = [
        lfs.PatternLF("one", "A", terms=("a", "y"), window=sp.ContextWindow(sentences=1)),
        lfs.PatternLF("two", "B", regexes=("e 2|z",), window=sp.ContextWindow(sentences=(1, 2), norm=True)),
    ]
    shared, words = lfs.context_columns(functions), {"c": sp.ContextWindow(words=(1, 1))}
    patterns = {"n": "[0-9]+", "a": "[a-z] [0-9]"}
    wide = sp.extract_spans(notes, patterns, contexts={**words, **shared})
    want = sorted(map(tuple, lfs.pattern_lfs(wide, functions, shared).drop(*shared).collect()))
    for most in (sp.GROUP_SPANS, 3):
        monkeypatch.setattr(sp, "GROUP_SPANS", most)
        got = lfs.pattern_voted_spans(notes, functions, patterns, contexts=words)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 1200
    monkeypatch.undo()
    groups = sp.span_groups(notes, shared, patterns).collect()
    assert len(groups) <= 6 and sum(len(g._context_0) for g in groups) < 10_000


def test_texts_of_span_lists_are_searched_once(spark):
    notes = spark.createDataFrame([(1, 1, "a 1"), (2, 2, "b")], "note_id long, person_id long, note_text string")
    rows = sp.spans_to_rows(sp.span_lists(notes, {"n": "[0-9]"}))
    assert [r.start for r in rows.collect()] == [2]
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1

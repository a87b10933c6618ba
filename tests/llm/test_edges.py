"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns: each case has a defined result."""

import hashlib
import random

from pyspark.sql import functions as F

from clinspark.llm import bpe, fingerprints, jaccard, lines, mixing, neighbours, pii, quality, secrets, urls
from clinspark.llm.queries import URL_RULES, byte_bpe


def by_id(rows, column):
    return {r["doc_id"]: r[column] for r in rows}


def test_quality_without_labels_and_on_edges(documents, edges, no_rows, labels_of):
    docs = documents(edges)
    model = quality.fit(docs, labels_of([]))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(edges) and {r["score"] for r in rows} == {quality.NO_EVIDENCE}
    labels = labels_of([(i, i % 2, 0) for i in range(1, 8)] + [(1, None, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0)])
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and by_id(rows, "score")[2] == quality.NO_EVIDENCE
    assert quality.score(no_rows, model).count() == 0


def test_lines_on_edges(documents, edges, no_rows):
    rows = lines.dedup_lines(documents(edges)).collect()
    text = by_id(rows, "text")
    assert len(rows) == len(edges) and text[1] is None and text[2] == "" and text[3] == " \t\n" and text[4] == "one"
    assert text[5] == edges[4][1] and text[None] == edges[6][1] and text[6] == edges[7][1]  # repeated rows are treated alike
    assert by_id(rows, "n_lines")[1] == 0 and by_id(rows, "n_removed")[6] == 0
    assert lines.dedup_lines(no_rows).count() == 0


def test_pseudonyms_on_edges(documents, edges, no_rows):
    rows = pii.pseudonymise(documents(edges), b"k").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows if r["text"] is not None) == sorted((i or 0, t) for i, t in edges if t is not None)
    assert by_id(rows, "text")[1] is None and pii.pseudonymise(no_rows, b"k").count() == 0


def test_bpe_on_edges(documents, edges, no_rows):
    rows = bpe.encode(documents(edges), *byte_bpe(), decoded=True).collect()
    assert len(rows) == len(edges) and by_id(rows, "ids")[1] == [] == by_id(rows, "ids")[2]
    assert all(bytes(r["decoded"]).decode() == (dict(edges)[r["doc_id"]] or "") for r in rows)
    assert bpe.encode(no_rows, *byte_bpe()).count() == 0


def test_jaccard_on_edges(documents, edges, no_rows):
    rows = jaccard.ngram_components(documents(edges), 3, 90).collect()
    assert len(rows) == len(edges)
    n, c = by_id(rows, "n_shingles"), by_id(rows, "component_id")
    assert (n[1], n[2], n[3], n[4]) == (0, 0, 0, 1) and all(c[i] == i for i in range(1, 8)) and c[None] is None
    assert n[6] == 2 and jaccard.ngram_components(no_rows).count() == 0
    kept = jaccard.one_of_each_class(documents(edges)).collect()
    assert len(kept) == len(edges) - 1 and len({r["doc_id"] for r in kept}) == 8  # the repeated row leaves one


def test_urls_on_edges(spark):
    schema = "page_id long, url string, HOST string, rule int"
    rows = [(1, None, "h", 1), (2, "", "h", 1), (3, "no scheme", "h", 1), (4, "http://A.Net", "h", 1), (5, "http://a.net/x", "h", 1), (5, "http://a.net/x", "h", 1), (None, "http://b.org/fr/" + "y" * 20_000, "h", 1)]
    found = urls.judge(spark.createDataFrame(rows, schema), URL_RULES).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"page_id", "url", "host", "path", "rule", "verdict", "score"}
    by = {r["page_id"]: r for r in found}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"]) == ("", "", None) and by[3]["host"] == ""
    assert (by[4]["host"], by[4]["path"], by[4]["rule"]) == ("a.net", "", None)  # no path, so no rule fits
    assert (by[5]["rule"], by[5]["verdict"]) == ("net/", "block") and by[None]["verdict"] == "allow"
    assert urls.judge(spark.createDataFrame([], schema), URL_RULES).count() == 0


def test_long_urls_and_columns_of_any_name(spark):
    """A random URL of 100,000 characters beside short ones, and columns named like those used inside."""
    rng = random.Random(2)
    long = "http://c.com/" + "".join(rng.choice("abcdefghij0123456789-%/é") for _ in range(100_000))
    schema = "page_id long, url string, _url string, _scored int, row string, id int, gram string, sum int"
    rows = [(k, f"http://site{k}.org/fr/a-{k}", "u", 1, "r", 2, "g", 3) for k in range(30)] + [(100 + k, f"http://x{k}.net/q{k}", "u", 1, "r", 2, "g", 3) for k in range(30)]
    found = urls.judge(spark.createDataFrame([*rows, (200, long, "u", 1, "r", 2, "g", 3)], schema), URL_RULES)
    assert found.columns == [*schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "host", "path", "rule", "verdict", "score"]
    got = {r["page_id"]: r for r in found.collect()}
    assert len(got) == 61 and all(tuple(r)[2:8] == ("u", 1, "r", 2, "g", 3) for r in got.values())
    assert got[200]["url"] == long and got[200]["host"] == "c.com" and got[200]["verdict"] in ("allow", "block")


def test_grams(spark):
    df = spark.createDataFrame([("Ab😀",), ("",)], "url string")
    got = [r[0] for r in df.select(urls.grams(F.col("url"), 2)).collect()]
    assert got == [["\x02\x02a", "\x02ab", "ab😀", "b😀\x03"], ["\x02\x02\x03"]]


def test_copies_of_columns_of_any_name(spark):
    rows = [(1, "one two three four five six seven", "i", 1, "o", "r", "f"), (2, "one two three four five six seven", "i", 1, "o", "r", "f"), (3, "", "i", 1, "o", "r", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _at int, _one string, row string, of string")
    kept = jaccard.one_of_each_class(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_neighbours_of_different_lengths(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0]), (1, [0.5, 1.0, 2.0]), (2, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 2.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 0.5)]


def test_mixing_on_edges(documents, edges, no_rows, spark):
    docs = documents(edges, sources=("a", None, "b"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(edges) and by_id(rows, "size")[1] == 0 == by_id(rows, "taken")[2]
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(no_rows).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.filter("doc_id in (1, 2, 3)").count() == 0


def test_fingerprints_on_edges(documents, edges, no_rows):
    rows = fingerprints.fingerprints(documents(edges)).collect()
    assert len(rows) == len(edges)
    n = by_id(rows, "n_chars")
    assert n[1] == 0 == n[2] and by_id(rows, "anchors")[1] == [] and by_id(rows, "near_next")[1] == 1.0
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({str(r["anchors"]) for r in rows if r["doc_id"] == 5}) == 1 and fingerprints.fingerprints(no_rows).count() == 0
    only = fingerprints.fingerprints(documents([(9, "abcd")])).first()
    assert only["edited"] == "abab" and only["near_next"] == 1.0  # its own successor


def test_neighbours_on_edges(spark):
    schema = "vec_id long, embedding array<float>, rank int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, None], 1), (6, [2.0, 1.0], 1), (7, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (None, [1.0, 1.0], 1), (9, [1.0, 2.0, 3.0], 1), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, schema)
    found = neighbours.search(df, F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == [(0, 1, 6, 2.0), (0, 2, 7, 1.0), (0, 3, 8, 1.0)]
    assert neighbours.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_secrets_on_edges(documents, edges, no_rows):
    rows = secrets.scan(documents(edges)).collect()
    assert len(rows) == len(edges) and all(r["spans"] == [] for r in rows) and secrets.scan(no_rows).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")

"""The corpus pipeline: each stage on what the one before kept, and the whole run."""

import re

import corpus_pipeline
from clinspark.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        kept.append(docs.collect())
    before, good, cut, single, mixed, encoded = kept
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    ids = [{r["doc_id"] for r in rows} for rows in kept]
    bad, fine = ({i for i, q in labels.items() if q == v} for v in (0, 1))
    assert len(bad & ids[1]) <= 0.1 * len(bad) and fine <= ids[1]
    assert ids[1] == ids[2] and sum(len(r["text"]) for r in cut) < sum(len(r["text"]) for r in good)
    assert all(r["n_chars"] == len(r["text"]) for r in [*cut, *mixed])
    seen = set()
    for r in sorted(single, key=lambda r: r["doc_id"]):
        words = tuple(w.lower() for w in WORD.findall(r["text"]))
        assert not words or words not in seen
        seen.add(words)
    assert len(single) < len(cut) and ids[4] <= ids[3]
    assert len(encoded) == len(mixed) and all(r["n_tokens"] == len(r["ids"]) > 0 for r in encoded)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in whole.collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in encoded)


NAMES = "Score string, size string, passes string, first_words string, _id string, _at string, _one string, _of string, _key string, _owner string, _kept string, n_lines string, row string, key string, nth string, slot string, stay string, ids string, decoded string, node string, hash string, place string, kept string, owner string"


def test_stages_on_columns_of_every_name(spark, sf_dir, edges):
    """Each stage on a table whose extra columns carry the names used inside, with nulls, empty, long and repeated rows, and on an empty one."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {NAMES}"
    own = [f"v{k}" for k in range(len(NAMES.split(", ")))]
    rows = [(i, t, "en", None if k % 3 else "a", len(t or ""), *own) for k, (i, t) in enumerate(edges)]
    rows += [(100 + k, f"A document of its own, number {k}, with words enough to be one. " * 3, None, "b", 0, *own) for k in range(6)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        got = made.collect()
        if name == corpus_pipeline.STAGES[-1][0]:
            assert len(got) == len(rows)
        else:
            assert made.columns == docs.columns, name
            assert got and all(tuple(r)[5:] == tuple(own) for r in got), name
            assert {r["doc_id"] for r in got} >= {100, 105}, name
        assert stage(spark, none, sf_dir).count() == 0, name

"""Prompts with examples, bounded requests, and answers that are asked once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinspark.operators import lfs

PROMPTS = {
    "0": {"system_prompt": "{attribute}: {{'{snomed_short_name}': bool}} {other}", "prefix_prompt": "<{span}|", "suffix_prompt": "> {snomed_short_name}?", "examples": [("1/2", "on 1/2 {span}", "yes"), ("x", "", "no")]},
    "7": {"system_prompt": "S", "prefix_prompt": "", "suffix_prompt": ""},
}


@pytest.fixture(scope="module")
def prompts(spark):
    tasks = spark.createDataFrame([(1, "biopsy_procedure", "Biopsy"), (2, "scan", "Scan")], "task_id int, normalized_task_name string, snomed_short_name string")
    spans = spark.createDataFrame([("s1", "3/4", "seen 3/4"), ("s2", "3/4", "seen 3/4"), ("s3", "5/6", None)], "span_id string, lexical_variant string, context string")
    return lfs.build_prompts(spans, lfs.prompt_rows(spark, PROMPTS, tasks, {2: "7"}))


def test_examples(prompts):
    rows = {(r["span_id"], r["task_id"]): r for r in prompts.collect()}
    assert len(rows) == 6
    first = rows["s1", 1]
    assert first["system_prompt"] == "biopsy_procedure: {'Biopsy': bool} {other}"
    assert first["prompt"] == "<3/4|seen 3/4> Biopsy?" and rows["s3", 1]["prompt"] == "<5/6|> Biopsy?"
    # The context of an example is text, not a template.
    assert [tuple(e) for e in first["examples"]] == [("<1/2|on 1/2 {span}> Biopsy?", "yes"), ("<x|> Biopsy?", "no")]
    assert rows["s1", 2]["examples"] == [] and rows["s3", 2]["prompt"] == ""


def test_answers_keep_the_order_of_the_rows():
    """Later requests may end first; never more than the asked number is open."""
    import threading
    import time

    lock, now, most = threading.Lock(), [0], [0]

    def scorer(asked):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 * (len(asked["prompt"].iloc[0]) % 3))
        with lock:
            now[0] -= 1
        return "a" + asked["prompt"]

    frames = [pd.DataFrame({"id": range(k, k + 13), "system_prompt": "", "examples": None, "prompt": ["p" * (i % 5) for i in range(k, k + 13)]}) for k in (0, 13)]
    out = pd.concat(lfs._answers(iter(frames), scorer, ["id"], 4, 3))
    assert out["id"].tolist() == list(range(26)) and out["answer"].tolist() == ["a" + "p" * (i % 5) for i in range(26)]
    assert 1 < most[0] <= 3


def test_failed_request_ends_the_task():
    frame = pd.DataFrame({"id": [1], "system_prompt": "", "examples": None, "prompt": "p"})

    def scorer(asked):
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        list(lfs._answers(iter([frame]), scorer, ["id"], 1, 2))


def test_no_prompt_is_asked_twice(spark, prompts, tmp_path):
    log, table = tmp_path / "asked", str(tmp_path / "answers")
    log.touch()

    def scorer(asked):
        with open(log, "a") as file:
            file.write("".join(f"{p}\n" for p in asked["prompt"]))
        return asked["prompt"].map(lambda p: None if "5/6" in p else f'{{"Biopsy": {str("3/4" in p).lower()}}}')

    keys = ["span_id", "task_id", "snomed_short_name"]
    rows = lfs.parse_votes(lfs.score_once(prompts, scorer, table, keys, waves=3)).collect()
    assert len(rows) == 6 and {(r["span_id"], r["vote"]) for r in rows if r["task_id"] == 1} == {("s1", True), ("s2", True), ("s3", None)}
    # s1 and s2 ask the same; so does every span that fills a task's prompt alike.
    first = log.read_text().splitlines()
    assert sorted(first) == sorted({r["prompt"] for r in prompts.collect()})
    again = lfs.score_once(prompts, scorer, table, keys, waves=3)
    assert sorted(map(tuple, lfs.parse_votes(again).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert log.read_text().splitlines() == first
    more = prompts.union(prompts.filter("span_id = 's1'").withColumns({"span_id": F.lit("s4"), "prompt": F.lit("new")}))
    assert lfs.score_once(more, scorer, table, keys, waves=3).count() == 8
    assert log.read_text().splitlines()[len(first) :] == ["new", "new"]  # under two system prompts


def test_a_broken_run_goes_on(spark, prompts, tmp_path):
    log, table = tmp_path / "asked", str(tmp_path / "answers")
    many = prompts.limit(1).select("system_prompt", "examples").crossJoin(spark.range(40)).select(F.col("id").alias("span_id"), "system_prompt", "examples", F.concat(F.lit("p"), "id").alias("prompt"))

    def scorer(asked):
        if not log.exists() and asked["prompt"].isin(["p7"]).any():
            log.touch()
            raise RuntimeError("broken off")
        return asked["prompt"]

    with pytest.raises(Exception):
        lfs.score_once(many, scorer, table, ["span_id"], waves=8)
    kept = spark.read.parquet(table).count() if (tmp_path / "answers").exists() else 0
    rows = lfs.score_once(many, scorer, table, ["span_id"], waves=8).collect()
    assert {r["span_id"]: r["answer"] for r in rows} == {i: f"p{i}" for i in range(40)}
    assert spark.read.parquet(table).count() == 40 and kept < 40


def test_no_prompts(spark, prompts, tmp_path):
    none = lfs.score_once(prompts.limit(0), lambda asked: asked["prompt"], str(tmp_path / "answers"))
    assert none.count() == 0 and not (tmp_path / "answers").exists()


def test_prompts_filled_at_the_scorer(spark):
    """The scorer is asked the same as through rows of prompts, and a context is read once for all tasks."""
    tasks = spark.createDataFrame([(1, "biopsy_procedure", "Biopsy"), (2, "scan", "Scan")], "task_id int, normalized_task_name string, snomed_short_name string")
    spans = spark.createDataFrame([("s1", "3/4", "seen {span} 3/4"), ("s2", None, "x"), ("s3", "{{5}}", None)], "span_id string, lexical_variant string, context string")
    odd = {**PROMPTS, "7": {"system_prompt": "S {span} {{span}}", "prefix_prompt": "", "suffix_prompt": "{span}{span}"}}
    rows = lfs.prompt_rows(spark, odd, tasks, {2: "7"})

    def scorer(asked):
        shown = asked["examples"].map(lambda found: [(e["prompt"], e["answer"]) for e in found])
        return asked["system_prompt"] + "|" + shown.astype(str) + "|" + asked["prompt"]

    want = lfs.score_prompts(lfs.build_prompts(spans, rows), scorer, rows=2)
    got = lfs.score_spans_by_prompts(spans, rows, scorer, rows=2, in_flight=3)
    assert got.columns == ["span_id", "task_id", "snomed_short_name", "answer"]
    answers = sorted(tuple(r[c] for c in got.columns) for r in got.collect())
    assert answers == sorted(tuple(r[c] for c in got.columns) for r in want.collect()) and len(answers) == 6
    assert answers[4] == ("s3", 1, "Biopsy", answers[4][3]) and answers[5][3] == "S {{5}} {span}|[]|{{5}}{{5}}"
    assert lfs.score_spans_by_prompts(spans.limit(0), rows, scorer).count() == 0


def test_rows_of_a_span_come_out_together(spark):
    """Keys are not repeated task after task: written files hold those of a span as one run."""
    tasks = spark.createDataFrame([(2, "scan", "Scan"), (1, "biopsy_procedure", "Biopsy")], "task_id int, normalized_task_name string, snomed_short_name string")
    spans = spark.createDataFrame([(i, f"s{i}", [i], "x" * i, f"seen {i}") for i in range(5)], "note_id int, span_id string, more array<int>, lexical_variant string, context string").coalesce(1)
    rows, keys = lfs.prompt_rows(spark, {"0": {"system_prompt": "S", "prefix_prompt": "", "suffix_prompt": " {span}"}}, tasks, {}), ["span_id", "more"]

    def scorer(asked):
        assert len(asked) <= 2 and asked["system_prompt"].tolist() == ["S"] * len(asked)
        return [None if "3" in p else float("nan") if "4" in p else p for p in asked["prompt"]]

    got = lfs.score_spans_by_prompts(spans, rows, scorer, keys, rows=2, in_flight=3)
    want = [(f"s{i}", [i], *task, f"seen {i} " + "x" * i if i < 3 else None) for i in range(5) for task in ((1, "Biopsy"), (2, "Scan"))]
    assert [tuple(r) for r in got.collect()] == want
    assert lfs.score_spans_by_prompts(spans, rows.limit(0), scorer, keys).collect() == []
    with pytest.raises(Exception):
        lfs.score_spans_by_prompts(spans, rows, lambda asked: asked["prompt"][:1], keys, rows=2).collect()


def test_answers_told_by_their_text_are_those_of_the_parser(spark):
    names = ["Biopsy", "", "é à", 'a"b', "a\\b", "a\tb", 'a":true,"b', "a\\", None]
    ends = ["true}", "false}", " true}", "  false}", " false} ", "True}", "TRUE}", '"true"}', '"False"}', "null}", "1}", 'true,"x":1}', "true} x", "true", "tru e}", "}true}", '{"Biopsy":true}}', "[true]}"]
    answers = [f'{h}"{n or ""}"{c}:{e}' for n in names for h in ("{", "{ ", '{"y":false,', "") for c in ("", " ") for e in ends]
    answers += ['{"Biopsy":true,"Biopsy":false}', '{"biopsy":true}', "", "{}", "true}", "no", None]
    rows = spark.createDataFrame([(n, a) for n in names for a in answers], "snomed_short_name string, answer string")
    parsed = F.lower(F.from_json("answer", "map<string,string>")[F.col("snomed_short_name")])
    found = lfs.parse_votes(rows).withColumn("want", F.when(parsed == "true", True).when(parsed == "false", False)).collect()
    assert [r for r in found if r["vote"] is not r["want"]] == []
    assert {r["vote"] for r in found if r["snomed_short_name"] == "Biopsy"} == {True, False, None}
    numbers = spark.createDataFrame([(1, '{"1":true}'), (2, '{"1":true}')], "k int, answer string")
    assert [r["vote"] for r in lfs.parse_votes(numbers, field_name="k").collect()] == [True, None]

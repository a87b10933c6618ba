"""Labelling functions: each one adds a vote column to spans."""

import json
import re
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clinspark.functions.text import accent_table, any_regex, terms_regex
from clinspark.operators.groups import LARGE_ROWS, key_loads, spread_join, unique_by, with_group_totals
from clinspark.operators.spans import BATCH_ROWS, DATE_PATTERNS, ContextWindow, grouped_spans, span_groups
from clinspark.operators.stored import stored

# ---------------------------------------------------------------- knowledge


def external_lf(
    spans: DataFrame, events: DataFrame, name: str, date: str = "span_date", threshold_days: int = 0,
    rows_per_task: int | None = LARGE_ROWS,
) -> DataFrame:
    """Vote = sorted classes of the person's events within the threshold of the span date, null if none.

    `events` holds (person_id, event_date, class). Events are reduced to one row per person and day (or per
    person and run of days), with at most days x classes values, before the spans are joined. Spans are counted by person and
    day, and those of a key with more than `rows_per_task` are spread over as many tasks as they need; `spans` is read twice for that and
    should be a written table (None: read once, not counted).
    """

    def voted(rows, right, keys):
        return spread_join(rows, right, keys, None if rows_per_task is None else key_loads(rows, keys, rows_per_task))

    known = events.select("person_id", F.col("event_date").alias("_day"), F.col("class").alias("_class")).distinct()
    if threshold_days == 0:
        per_day = known.groupBy("person_id", "_day").agg(F.sort_array(F.collect_set("_class")).alias(name))
        joined = voted(spans, per_day.withColumnRenamed("_day", date), ["person_id", date])
        return joined.select(*spans.columns, name)
    run = F.floor(F.datediff("_day", F.lit("1970-01-01").cast("date")) / threshold_days)
    # An event can only match spans of its own run of days or of the two next to it.
    near = known.withColumn("_run", F.explode(F.array(run - 1, run, run + 1)))
    per_run = near.groupBy("person_id", "_run").agg(F.collect_set(F.struct("_day", "_class")).alias("_near"))
    span_run = F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / threshold_days)
    joined = voted(spans.withColumn("_run", span_run), per_run, ["person_id", "_run"])
    inside = F.filter("_near", lambda e: F.abs(F.datediff(e["_day"], F.col(date))) <= threshold_days)
    classes = F.sort_array(F.array_distinct(F.transform(inside, lambda e: e["_class"])))
    return joined.select(*spans.columns, F.when(F.size(classes) > 0, classes).alias(name))


def external_lfs(
    spans: DataFrame, events: DataFrame, names: Sequence[str], date: str = "span_date", threshold_days: int = 0,
    rows_per_task: int | None = LARGE_ROWS,
) -> DataFrame:
    """All knowledge votes in one join; `events` also holds the `lf` each row belongs to."""
    tagged = F.struct(F.col("lf"), F.col("class"))
    packed = external_lf(
        spans, events.select("person_id", "event_date", tagged.alias("class")), "_votes", date, threshold_days, rows_per_task
    )

    def votes(name):
        mine = F.transform(F.filter("_votes", lambda v: v["lf"] == name), lambda v: v["class"])
        return F.when(F.size(mine) > 0, F.sort_array(mine)).alias(name)

    return packed.select(*spans.columns, *[votes(n) for n in names])


# ---------------------------------------------------------------- patterns


@dataclass(frozen=True)
class PatternLF:
    """Vote for `task` when the span context holds any of the terms (whole words) or regular expressions."""

    name: str
    task: str
    terms: tuple = ()
    regexes: tuple = ()
    window: ContextWindow = field(default_factory=ContextWindow)

    def regex(self) -> str:
        folded = str.maketrans(*accent_table())
        terms = [t.translate(folded).lower() for t in self.terms] if self.window.norm else list(self.terms)
        parts = ([terms_regex(terms)] if terms else []) + ([any_regex(self.regexes)] if self.regexes else [])
        return any_regex(parts)


def parse_patterns(config: Mapping[str, Mapping], known_lfs: Sequence[str] | None = None, strict: bool = False):
    """Pattern dictionary (task -> lf_name, terms, regex, context, attr) -> labelling functions.

    Entries without a name and names not in `known_lfs` are skipped (`strict`: raise); the last entry of a
    task wins when two share a name. Returns the functions and the skipped entries.
    """
    found, skipped = {}, []
    for task, entry in config.items():
        name = entry.get("lf_name")
        if not name or (known_lfs is not None and name not in known_lfs):
            if strict:
                raise ValueError(f"labelling function {name!r} of {task!r} is not in the reference")
            skipped.append((task, name))
            continue
        sents = entry.get("context_sents")
        words = entry.get("context_words")
        window = ContextWindow(
            sentences=sents if sents is None or isinstance(sents, int) else tuple(sents),
            words=None if words is None else tuple(words),
            norm=entry.get("attr", "NORM") == "NORM",
        )
        terms = tuple(t for group in (entry.get("terms") or {}).values() for t in group)
        regexes = tuple(r for group in (entry.get("regex") or {}).values() for r in group)
        found[name] = PatternLF(name, task, terms, regexes, window)
    return list(found.values()), skipped


def load_patterns(path: str, known_lfs: Sequence[str] | None = None, strict: bool = False):
    with open(path, encoding="utf-8") as handle:
        return parse_patterns(json.load(handle), known_lfs, strict)


def context_columns(lfs: Sequence[PatternLF]) -> dict[str, ContextWindow]:
    """One context column per distinct window, shared by the functions that use it."""
    windows = {}
    for lf in lfs:
        windows.setdefault(lf.window.key(), lf.window)
    return {f"_context_{i}": w for i, w in enumerate(windows.values())}


def pattern_lf(spans: DataFrame, lf: PatternLF, context: str = "context") -> DataFrame:
    return spans.withColumn(lf.name, F.when(F.col(context).rlike(lf.regex()), F.lit(lf.task)))


def pattern_lfs(spans: DataFrame, lfs: Sequence[PatternLF], contexts: Mapping[str, ContextWindow]) -> DataFrame:
    """All pattern votes in one projection over the shared context columns."""
    column_of = {w.key(): name for name, w in contexts.items()}
    votes = {lf.name: F.when(F.col(column_of[lf.window.key()]).rlike(lf.regex()), F.lit(lf.task)) for lf in lfs}
    return spans.withColumns(votes)


def pattern_voted_spans(
    notes: DataFrame,
    lfs: Sequence[PatternLF],
    patterns: Mapping[str, str] = DATE_PATTERNS,
    keys: Sequence[str] = ("note_id",),
    text: str = "note_text",
    contexts: Mapping[str, ContextWindow] | None = None,
) -> DataFrame:
    """Spans of the notes with all pattern votes. Spans in a row with the same windows are voted on once, before they become rows."""
    shared = context_columns(lfs)
    groups = span_groups(notes, shared, patterns, keys, text, contexts=contexts)
    return grouped_spans(pattern_lfs(groups, lfs, shared), keys, [lf.name for lf in lfs])


# ---------------------------------------------------------------- logic

_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z_][A-Za-z0-9_]*)")


def relation_tokens(relation: str, names: Sequence[str]) -> list[str]:
    """Words of a relation; only the given names, and, or, not and brackets are allowed."""
    tokens, at = [], 0
    while at < len(relation.rstrip()):
        match = _TOKEN.match(relation, at)
        if not match:
            raise ValueError(f"relation {relation!r} has an unexpected character at {at}")
        token = match.group(1)
        if token not in ("and", "or", "not", "(", ")") and token not in names:
            raise ValueError(f"relation {relation!r} uses unknown name {token!r}")
        tokens.append(token)
        at = match.end()
    return tokens


def _matches(df: DataFrame, column: str, expected, lenient_bool: bool) -> Column:
    kind = df.schema[column].dataType
    value = F.col(column)
    if expected is None:
        return value.isNull()
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_contains(value, expected), F.lit(False))
    if isinstance(kind, T.BooleanType):
        if isinstance(expected, bool):
            return F.coalesce(value == expected, F.lit(False))
        return F.coalesce(value, F.lit(False)) if lenient_bool else F.lit(False)
    if isinstance(kind, T.StringType):
        return F.coalesce(value == expected, F.lit(False)) if isinstance(expected, str) else F.lit(False)
    if isinstance(kind, T.NullType):
        return F.lit(False)
    raise TypeError(f"votes of {column!r} have type {kind.simpleString()}")


def logical_lf(spans: DataFrame, rule: Mapping, lenient_bool: bool = False) -> DataFrame:
    """Vote `value_out` where the relation over matched inputs holds, null elsewhere."""
    inputs = {name: f"_is_{i}" for i, name in enumerate(rule["lf_in"])}
    condition = " ".join(inputs.get(t, t) for t in relation_tokens(rule["relation"], list(inputs)))
    tested = spans.withColumns(
        {column: _matches(spans, name, rule["lf_in"][name], lenient_bool) for name, column in inputs.items()}
    )
    vote = F.when(F.expr(condition), F.lit(rule["value_out"]))
    return tested.withColumn(rule["name"], vote).drop(*inputs.values())


def logical_lfs(spans: DataFrame, rules: Sequence[Mapping], lenient_bool: bool = False) -> DataFrame:
    """Rules in order: a later rule may read the output of an earlier one."""
    for rule in rules:
        spans = logical_lf(spans, rule, lenient_bool)
    return spans


# ---------------------------------------------------------------- prompts and batch scorers


def _named(template, values: Mapping[str, Column]) -> Column:
    """Template text with {name} filled; unknown names stay, and doubled braces are held as control characters."""
    out = template if isinstance(template, Column) else F.lit(template)
    out = F.replace(F.replace(out, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def _single(out: Column) -> Column:
    return F.replace(F.replace(out, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def _fill(template, **values: Column) -> Column:
    """Template text with {name} filled; unknown names stay and doubled braces become single ones."""
    return _single(_named(template, values))


def _pieces(template, **values: Column) -> Column:
    """The text between the places of {span}, filled otherwise; joined by the span it is the filled template."""
    return F.transform(F.split(_named(template, values), r"\{span\}", -1), _single)


EXAMPLES = "array<struct<span:string,context:string,answer:string>>"


def prompt_rows(spark: SparkSession, prompts: Mapping[str, Mapping], tasks: DataFrame, prompt_ids: Mapping[int, str], default: str = "0") -> DataFrame:
    """One row per task with the system, prefix and suffix templates chosen for it, and its (span, context, answer) examples."""
    rows = [
        (str(k), p.get("system_prompt"), p.get("prefix_prompt"), p.get("suffix_prompt"), [tuple(map(str, e)) for e in p.get("examples") or []])
        for k, p in prompts.items()
    ]
    templates = spark.createDataFrame(rows, f"prompt_id string, system_prompt string, prefix_prompt string, suffix_prompt string, examples {EXAMPLES}")
    chosen = F.lit(str(default))
    for task_id, prompt_id in prompt_ids.items():
        chosen = F.when(F.col("task_id") == task_id, F.lit(str(prompt_id))).otherwise(chosen)
    return tasks.withColumn("prompt_id", chosen).join(templates, "prompt_id")


def build_prompts(spans: DataFrame, prompts: DataFrame, context: str = "context", span: str = "lexical_variant") -> DataFrame:
    """One row per (span, task): filled system prompt, examples (prompt, answer), and prefix + context + suffix.

    The prompt dimension has one row per task, so every span meets every asked task exactly once; it travels
    to the spans as one array value instead of a join. Templates and examples are filled once per task; only the span is left to each row.
    """
    tasks = task_prompts(prompts)
    packed = tasks.agg(F.sort_array(F.collect_list(F.struct(*tasks.columns)))).scalar()
    rows = spans.withColumn("_p", F.explode(packed))

    def text(column):
        return F.call_function("array_join", F.col(f"_p.{column}"), F.coalesce(F.col(span).cast("string"), F.lit("")))

    return rows.select(
        *spans.columns,
        F.col("_p.task_id").alias("task_id"),
        F.col("_p.normalized_task_name").alias("normalized_task_name"),
        F.col("_p.snomed_short_name").alias("snomed_short_name"),
        text("system_prompt").alias("system_prompt"),
        F.col("_p.examples").alias("examples"),
        F.concat(text("prefix_prompt"), F.coalesce(F.col(context), F.lit("")), text("suffix_prompt")).alias("prompt"),
    )


def task_prompts(prompts: DataFrame) -> DataFrame:
    """One row per task: its names, its templates as the pieces between the places of the span, and its filled examples (prompt, answer)."""
    names = {"attribute": F.col("normalized_task_name"), "snomed_short_name": F.col("snomed_short_name")}
    shown = F.col("examples") if "examples" in prompts.columns else F.array().cast(EXAMPLES)

    def example(e):
        filled = [_fill(F.col(c), **names, span=e["span"]) for c in ("prefix_prompt", "suffix_prompt")]
        return F.struct(F.concat(filled[0], e["context"], filled[1]).alias("prompt"), e["answer"].alias("answer"))

    filled = prompts.withColumn("examples", F.transform(F.coalesce(shown, F.array().cast(EXAMPLES)), example))
    pieces = [_pieces(F.col(c), **names).alias(c) for c in ("system_prompt", "prefix_prompt", "suffix_prompt")]
    return filled.select("task_id", "normalized_task_name", "snomed_short_name", *pieces, "examples")


ASKED = ["system_prompt", "examples", "prompt"]
Scorer = Callable[[pd.DataFrame], pd.Series]


def _requested(requests: Iterator[tuple], in_flight: int) -> Iterator[tuple]:
    """(kept, request) -> (kept, list of its answers) in the same order, with at most `in_flight` requests open at a time."""
    open_requests: deque = deque()

    def finish():
        kept, request = open_requests.popleft()
        return kept, list(request.result())

    with ThreadPoolExecutor(in_flight) as pool:
        for kept, request in requests:
            if len(open_requests) == in_flight:
                yield finish()
            open_requests.append((kept, pool.submit(request)))
        while open_requests:
            yield finish()


def _answers(batches: Iterator[pd.DataFrame], scorer: Scorer, keep: Sequence[str], rows: int, in_flight: int) -> Iterator[pd.DataFrame]:
    """Answers in the order of the rows, in requests of `rows` prompts."""
    pieces = (batch.iloc[at : at + rows] for batch in batches for at in range(0, len(batch), rows))
    for kept, answers in _requested(((piece[list(keep)], partial(scorer, piece[ASKED])) for piece in pieces), in_flight):
        yield kept.assign(answer=answers)


def score_prompts(
    prompts: DataFrame, scorer: Scorer, keys: Sequence[str] = ("span_id", "task_id", "snomed_short_name"), rows: int = 24, in_flight: int = 20
) -> DataFrame:
    """Answers of a caller-supplied function: frames of (system_prompt, examples, prompt) -> JSON texts, some requests at a time per task."""
    keys = list(keys)
    source = prompts.select(*keys, *ASKED)
    schema = T.StructType([source.schema[k] for k in keys] + [T.StructField("answer", T.StringType())])
    return source.mapInPandas(lambda batches: _answers(batches, scorer, keys, rows, in_flight), schema)


def score_spans_by_prompts(
    spans: DataFrame, prompts: DataFrame, scorer: Scorer, keys: Sequence[str] = ("span_id",), context: str = "context",
    span: str = "lexical_variant", rows: int = 24, in_flight: int = 20,
) -> DataFrame:
    """`score_prompts` of `build_prompts`, with the prompts filled where the scorer is called: a span and its context travel once, not once per task.

    The prompt dimension, one row per task, goes to the workers with the function. A request holds prompts of one task; a span and
    its answers of all tasks come back as one row.
    """
    keys = list(keys)
    source = spans.select(*keys, F.coalesce(F.col(span).cast("string"), F.lit("")).alias("_span"), F.coalesce(F.col(context), F.lit("")).alias("_context"))
    fields = [*[T.StructField(c, prompts.schema[c].dataType) for c in ("task_id", "snomed_short_name")], T.StructField("answer", T.StringType())]
    schema = T.StructType([*[source.schema[k] for k in keys], T.StructField("_answers", T.ArrayType(T.StructType(fields)))])
    tasks = task_prompts(prompts).orderBy("task_id").toArrow()
    names = [tasks[c.name].combine_chunks() for c in fields[:-1]]
    templates = tasks.select(["system_prompt", "prefix_prompt", "suffix_prompt", "examples"]).to_pylist()

    def asked(task, found, contexts):
        return scorer(_filled(task, found, contexts))

    def requests(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                found, contexts = piece["_span"].to_pylist(), piece["_context"].to_pylist()
                for task in templates:
                    # Filled by the thread that asks: no more than the open requests hold prompts.
                    yield piece, partial(asked, task, found, contexts)

    def run(batches):
        # Rows leave bit by bit while others are asked: the reader keeps up, where a whole piece at once would fill its socket.
        answered, ready = [], deque()
        for piece, answers in _requested(requests(batches), in_flight):
            answered.append(answers)
            if ready:
                yield ready.popleft()
            if len(answered) == len(templates):
                size = len(templates)
                answer = pa.array(chain.from_iterable(zip(*answered, strict=True)), pa.string(), from_pandas=True)
                named = [n.take(pa.array(np.tile(np.arange(size), piece.num_rows))) for n in names]
                of_tasks = pa.StructArray.from_arrays([*named, answer], [f.name for f in fields])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(piece.num_rows + 1, dtype="int32") * size), of_tasks)
                made = pa.RecordBatch.from_arrays([*[piece[k] for k in keys], lists], schema.names)
                step = max(BATCH_ROWS // size, 1)
                yield from ready
                answered, ready = [], deque(made.slice(at, step) for at in range(0, made.num_rows, step))
        yield from ready

    return source.mapInArrow(run, schema).select(*keys, F.inline("_answers"))


def _filled(task: Mapping, found: Sequence[str], contexts: Sequence[str]) -> pd.DataFrame:
    """A request: the prompts of one task of `task_prompts` for some spans and their contexts."""

    def text(pieces):
        return [None if pieces is None else pieces[0]] * len(found) if pieces is None or len(pieces) == 1 else [s.join(pieces) for s in found]

    examples = np.empty(len(found), object)
    examples.fill(task["examples"])
    lacking = task["prefix_prompt"] is None or task["suffix_prompt"] is None
    prompt = text(None) if lacking else list(map("".join, zip(text(task["prefix_prompt"]), contexts, text(task["suffix_prompt"]))))
    # Arrays of objects: nothing is left to infer from the values.
    return pd.DataFrame({"system_prompt": np.array(text(task["system_prompt"]), object), "examples": examples, "prompt": np.array(prompt, object)}, copy=False)


def prompt_key() -> Column:
    """Digest of all that a model is asked."""
    return F.sha2(F.to_json(F.struct(*ASKED)), 256)


def score_once(
    prompts: DataFrame,
    scorer: Scorer,
    path: str,
    keys: Sequence[str] = ("span_id", "task_id", "snomed_short_name"),
    waves: int = 8,
    rows: int = 24,
    in_flight: int = 20,
) -> DataFrame:
    """As `score_prompts`, with a table of answers at `path` that lasts: no prompt that is in it is asked again, nor one twice.

    Prompts are told apart by their digest. Those without an answer are asked in waves, each of which appends its answers when it is done, so
    a run that breaks off loses one wave at most and the next run goes on from there. A prompt whose answer is null counts as answered.
    """
    spark = prompts.sparkSession
    source = prompts.select(*keys, *ASKED).withColumn("_prompt", prompt_key())
    schema = "prompt_key string, answer string"

    def known() -> DataFrame:
        try:
            found = spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            found = spark.createDataFrame([], schema)
        return found.groupBy("prompt_key").agg(F.min("answer").alias("answer"))

    asked = source.select(F.col("_prompt").alias("prompt_key"), *ASKED).dropDuplicates(["prompt_key"])
    waiting = stored(asked.join(known().select("prompt_key"), "prompt_key", "left_anti"))
    wave = F.pmod(F.xxhash64("prompt_key"), F.lit(waves))
    for k in range(waves if not waiting.isEmpty() else 0):
        one = waiting.filter(wave == k)
        answered = one.mapInPandas(lambda batches: _answers(batches, scorer, ["prompt_key"], rows, in_flight), schema)
        answered.write.mode("append").parquet(path)
    named = source.select(*keys, F.col("_prompt").alias("prompt_key"))
    return named.join(known(), "prompt_key", "left").select(*keys, "answer")


def parse_votes(answers: DataFrame, answer: str = "answer", field_name: str = "snomed_short_name", name: str = "vote") -> DataFrame:
    """JSON answer -> boolean vote of the asked field; null when it is missing or not a truth value.

    An answer that is the field with a truth value and nothing else is told by its text; all others are parsed, which takes seven times as long.
    """
    text, field = F.col(answer), F.col(field_name).cast("string")
    value = _truth(F.from_json(text, "map<string,string>")[F.col(field_name)])
    # The name has to be one that JSON writes as it is.
    named = F.startswith(text, F.concat(F.lit('{"'), field, F.lit('":'))) & ~F.rlike(field, F.lit(r'["\\\x00-\x1f]'))
    left = F.octet_length(text) - F.octet_length(field) - len('{"":')

    def alone(end):
        return named & ((left == len(end)) & F.endswith(text, F.lit(end)) | (left == len(end) + 1) & F.endswith(text, F.lit(f" {end}")))

    return answers.withColumn(name, F.when(alone("true}"), True).when(alone("false}"), False).otherwise(value))


def _truth(value: Column) -> Column:
    # One use of the value: what it is parsed from is parsed once.
    return F.try_element_at(F.create_map(F.lit("true"), F.lit(True), F.lit("false"), F.lit(False)), F.lower(value))


def match_vote(column: Column, kind: T.DataType, expected: str) -> Column:
    """Vote cell against an expected value: list membership, equality, or the boolean itself."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_contains(column, expected), F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(column == expected, F.lit(False))
    return F.lit(False)


# ---------------------------------------------------------------- vote sets


def merge_votes(vote_sets: Sequence[DataFrame], keys: Sequence[str] = ("note_id", "start", "end"), shared: Sequence[str] = ()) -> DataFrame:
    """Vote sets side by side on the span key; the first one is the universe, repeated columns are dropped.

    A key that a vote set holds twice stops the job.
    """
    merged = unique_by(vote_sets[0], keys, "vote set 0")
    for i, votes in enumerate(vote_sets[1:], 1):
        extra = [c for c in votes.columns if c not in merged.columns and c not in shared]
        merged = merged.join(unique_by(votes.select(*keys, *extra), keys, f"vote set {i}"), list(keys), "left")
    return merged


def votes_with_gold(
    votes: DataFrame, gold: DataFrame, task: str, positive: int, negative: int, keys: Sequence[str] = ("note_id", "start", "end")
) -> DataFrame:
    """Votes with `ground_truth_label` of one task; spans without an annotation count as negative; a key that either side holds twice stops the job."""
    label = F.when(F.col(task).cast("string").isin("1", "true"), positive).when(
        F.col(task).cast("string").isin("0", "false"), negative
    )
    annotated = gold.select(*keys, label.cast("int").alias("ground_truth_label"))
    joined = unique_by(votes, keys, "votes").join(unique_by(annotated, keys, "gold labels"), list(keys), "left")
    return joined.fillna({"ground_truth_label": negative})


def has_any_vote(df: DataFrame, lfs: Sequence[str], note: str = "note_id") -> DataFrame:
    """Add `all_abstain`: true when no span of the note has any vote."""
    voted = F.lit(False)
    for lf in lfs:
        voted = voted | F.col(lf).isNotNull()
    return with_group_totals(df, [note], all_abstain=~F.max(voted))

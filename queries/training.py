"""Queries over samples, splits, training sets, prediction rows and report tables."""

from pyspark.sql import functions as F

from clinspark.functions.text import DATE_REGEX, accent_table
from clinspark.operators import datasets as ds, evaluation as evl, fhir, sampling as sm
from clinspark.operators.stored import stored
from clinspark.plans import labelling as lb, prediction as pr, selection as se
from queries import adapters as ad
from queries.adapters import with_ctes
from queries.labels import _rounded
from queries.spans import LF_FOLDED, LF_REGEX, LF_TERMS, LOGICAL_RULES, VOTE_CTES
from queries.registry import query

UNIFORM = "((('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"

# ---------------------------------------------------------------- samples and splits


@query("sl_sample_n", "SELECT doc_id FROM documents ORDER BY md5('11|' || doc_id), doc_id LIMIT 120")
def sl_sample_n(spark, d):
    return sm.sample_n(ad.table(spark, d, "documents").select("doc_id"), 120, ["doc_id"], seed=11)


@query(
    "sl_sample_share",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('5|' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= (SELECT count(*) // 4 FROM orders)",
)
def sl_sample_share(spark, d):
    orders = ad.table(spark, d, "orders").select("o_orderkey")
    n = orders.agg(F.floor(F.count(F.lit(1)) / 4)).scalar()
    return sm.sample_n(orders, n, ["o_orderkey"], seed=5)


@query("w_ntile_groups", "SELECT doc_id, CAST(ntile(3) OVER (ORDER BY md5('3|' || doc_id), doc_id) AS INTEGER) AS screening_group FROM documents")
def w_ntile_groups(spark, d):
    return sm.screening_groups(ad.table(spark, d, "documents").select("doc_id"), 3, ["doc_id"], seed=3)


@query("w_instance_id", with_ctes("SELECT span_id, row_number() OVER (ORDER BY md5('instance|' || span_id), span_id) - 1 AS instance_id FROM span", "span"))
def w_instance_id(spark, d):
    return sm.add_instance_id(ad.spans(spark, d).select("span_id"), ["span_id"], dense=True)


@query("w_instance_hash", with_ctes("SELECT span_id, md5('instance|' || span_id) AS instance_id FROM span", "span"))
def w_instance_hash(spark, d):
    return sm.add_instance_id(ad.spans(spark, d).select("span_id"), ["span_id"])


SPLIT = """WITH person AS (SELECT o_custkey AS person_id, min(CASE WHEN n_regionkey % 2 = 0 THEN 'A' ELSE 'B' END) AS hospital_group FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY hospital_group ORDER BY md5('0|' || person_id), person_id) AS rn FROM person)
  SELECT person_id, hospital_group, CASE WHEN hospital_group = 'B' THEN 'test_b' WHEN rn <= 101 THEN 'dev' WHEN rn <= 151 THEN 'test_a' ELSE 'train' END AS split FROM ranked
  WHERE (hospital_group = 'A' AND rn <= 451) OR (hospital_group = 'B' AND rn <= 50)"""


@query("sl_split", SPLIT)
def sl_split(spark, d):
    groups = ad.hospital_groups(spark, d)
    persons = ad.visits(spark, d).join(groups, "care_site_id").select("person_id", "hospital_group")
    slices = {"A": [("dev", 101), ("test_a", 50), ("train", 300)], "B": [("test_b", 50)]}
    return sm.split_persons(persons, slices)


def _narrow_spans(spark, d):
    """What samples of spans are chosen by, written once: the texts are searched a single time."""
    return stored(ad.scored_spans(spark, d).select("span_id", "note_id", "start", "biopsy_procedure_1"))


@query("pf_threshold_split", with_ctes("SELECT span_id, p1 <= 0.3 AS is_negative, p1 > 0.7 AS is_positive FROM scored", "scored"))
def pf_threshold_split(spark, d):
    return sm.threshold_flags(ad.scored_spans(spark, d), "biopsy_procedure_1", (0.3, 0.7)).select("span_id", "is_negative", "is_positive")


@query(
    "a_has_positive",
    with_ctes("SELECT span_id FROM scored WHERE p1 <= 0.5 AND note_id IN (SELECT note_id FROM scored WHERE p1 > 0.98)", "scored"),
)
def a_has_positive(spark, d):
    rows = sm.sample_negatives(_narrow_spans(spark, d), "biopsy_procedure_1", use_weight=False, thresholds=(0.5, 0.98))
    return rows.select("span_id")


WEIGHT = """SELECT s.*, coalesce(sum(exp(-0.5 * power((s.start - q.start) / {scale}::DOUBLE, 2)) / ({scale}::DOUBLE * sqrt(2 * pi()))), 0) + 1e-5 AS weight
  FROM scored s LEFT JOIN (SELECT note_id, start FROM scored WHERE p1 > {t}) q ON q.note_id = s.note_id GROUP BY ALL"""


@query("sl_proximity_weight", with_ctes("SELECT span_id, round(weight, 9) AS weight FROM weighted", "scored", weighted=WEIGHT.format(scale=150, t=0.9)))
def sl_proximity_weight(spark, d):
    flagged = sm.threshold_flags(ad.scored_spans(spark, d), "biopsy_procedure_1", (0.5, 0.9))
    return sm.proximity_weight(flagged, scale=150).select("span_id", F.round("weight", 9).alias("weight"))


NEGATIVES = (
    "SELECT * FROM weighted WHERE p1 <= 0.5 AND note_id IN (SELECT note_id FROM scored WHERE p1 > 0.98) ORDER BY -ln("
    + UNIFORM.format(seed=0, key="span_id")
    + ") / weight, span_id LIMIT {n}"
)


@query("sl_negatives", with_ctes("SELECT span_id FROM picked", "scored", weighted=WEIGHT.format(scale=500, t=0.98), picked=NEGATIVES.format(n=400)))
def sl_negatives(spark, d):
    return sm.sample_negatives(_narrow_spans(spark, d), "biopsy_procedure_1", 400, thresholds=(0.5, 0.98)).select("span_id")


@query(
    "sl_negatives_share",
    with_ctes("SELECT span_id FROM picked", "scored", weighted=WEIGHT.format(scale=500, t=0.98), picked=NEGATIVES.format(n="(SELECT count(*) * 2 FROM scored WHERE p1 > 0.98)")),
)
def sl_negatives_share(spark, d):
    scored = _narrow_spans(spark, d)
    n = scored.filter("biopsy_procedure_1 > 0.98").agg(F.count(F.lit(1)) * 2).scalar()
    return sm.sample_negatives(scored, "biopsy_procedure_1", n, thresholds=(0.5, 0.98)).select("span_id")


def _draws(n, seed, source, key):
    return f"""SELECT r.*, unnest(generate_series(1, c)) AS draw FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) AS rk FROM {source}) r
      JOIN (SELECT ('0x' || substr(md5('{seed}|' || i), 1, 15))::BIGINT % (SELECT count(*) FROM {source}) + 1 AS rk, count(*) AS c FROM (SELECT unnest(generate_series(0, {n} - 1)) AS i) GROUP BY 1) USING (rk)"""


@query("sl_oversample", "WITH poor AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT doc_id, draw FROM (" + _draws("(SELECT count(*) FROM labels WHERE quality = 1)", 9, "poor", "doc_id") + ")")
def sl_oversample(spark, d):
    labels = ad.table(spark, d, "labels")
    n = labels.filter("quality = 1").agg(F.count(F.lit(1))).scalar()
    return sm.oversample(labels.filter("quality = 0").select("doc_id"), n, ["doc_id"], seed=9)


# ---------------------------------------------------------------- training sets


@query(
    "j_doc_entities",
    with_ctes(
        """SELECT note_id, lang, CAST(count(*) AS INTEGER) AS n_entities, md5(string_agg(start || '-' || "end" || '-' || lexical_variant, '|' ORDER BY start, "end", lexical_variant)) AS entities FROM span JOIN note USING (note_id) GROUP BY 1, 2""", "span"
    ),
)
def j_doc_entities(spark, d):
    rows = ds.build_dataset(ad.notes(spark, d), ad.spans(spark, d), ["span_id"], ["lang"], "train_date")
    text = F.array_join(F.transform("entities", lambda e: F.concat_ws("-", e["start_char"].cast("string"), e["end_char"].cast("string"), e["lexical_variant"])), "|")
    return rows.select("note_id", "lang", F.size("entities").alias("n_entities"), F.md5(text).alias("entities"))


@query("src_read_dataset", with_ctes("SELECT note_id, start, \"end\", lexical_variant, 'train_date' AS label, span_id FROM span", "span"))
def src_read_dataset(spark, d):
    return ds.read_dataset(ds.build_dataset(ad.notes(spark, d), ad.spans(spark, d), ["span_id"], [], "train_date"), ["span_id"])


@query(
    "j_merge_tasks",
    with_ctes(
        """SELECT a.span_id, a.note_id, CAST(a.start > 500 AS INTEGER)::VARCHAR AS task_a, CASE WHEN b.span_id IS NOT NULL THEN CAST(b.start > 1000 AS INTEGER)::VARCHAR END AS task_b FROM (SELECT * FROM span WHERE label <> 'email') a
        LEFT JOIN (SELECT * FROM span WHERE label <> 'word') b ON a.span_id = b.span_id""",
        "span",
    ),
)
def j_merge_tasks(spark, d):
    merged = ds.merge_tasks(_task_sets(spark, d), ["span_id", "note_id"], "_vote")
    return merged.select("span_id", "note_id", "task_a", "task_b")


def _task_sets(spark, d):
    spans = ad.spans(spark, d)
    return {
        "task_a": spans.filter("label <> 'email'").withColumn("task_a_vote", F.col("start") > 500),
        "task_b": spans.filter("label <> 'word'").withColumn("task_b_vote", F.col("start") > 1000),
    }


@query(
    "cp_multitask",
    with_ctes("SELECT note_id, CAST(count(*) AS INTEGER) AS n_entities, sum(CAST(start > 500 AS INTEGER))::BIGINT AS n_a FROM span WHERE label <> 'email' GROUP BY 1", "span"),
)
def cp_multitask(spark, d):
    keys = ["span_id", "note_id", "start", "end", "lexical_variant"]
    dataset, _ = se.build_multitask_dataset(_task_sets(spark, d), ad.notes(spark, d), keys, "_vote")
    n_a = F.size(F.filter("entities", lambda e: e["task_a"] == "1")).cast("bigint")
    return dataset.select("note_id", F.size("entities").alias("n_entities"), n_a.alias("n_a"))


@query(
    "dataset_card",
    with_ctes("SELECT count(DISTINCT note_id) AS n_documents, count(DISTINCT span_id) AS n_entities, count(*) FILTER (p1 > 0.5) AS n_positive_examples, count(*) FILTER (p1 <= 0.5) AS n_negative_examples FROM scored", "scored"),
)
def dataset_card(spark, d):
    return ds.dataset_card(ad.scored_spans(spark, d), F.col("biopsy_procedure_1") > 0.5, entity="span_id")


POSITIVES = "SELECT * FROM scored WHERE p1 > 0.98 ORDER BY md5('123|' || span_id), span_id LIMIT 150"


@query(
    "cp_select",
    with_ctes(
        "SELECT span_id, true AS is_positive FROM positives UNION ALL SELECT span_id, false FROM picked",
        "scored",
        weighted=WEIGHT.format(scale=500, t=0.98),
        positives=POSITIVES,
        picked=NEGATIVES.format(n="(SELECT CAST(floor(count(*) * 1.5) AS BIGINT) FROM positives)"),
    ),
)
def cp_select(spark, d):
    rows = se.select_training_data(ad.scored_spans(spark, d), "Biopsy (procedure)", max_positives=150, thresholds=(0.5, 0.98), ratio=1.5)
    return rows.select("span_id", "is_positive")


@query(
    "cp_select_oversampling",
    with_ctes(
        "SELECT span_id, draw, true AS is_positive FROM drawn UNION ALL SELECT span_id, 0, false FROM rest",
        "scored",
        positives="SELECT * FROM scored WHERE p1 > 0.9",
        rest="SELECT * FROM scored WHERE p1 <= 0.4 AND note_id IN (SELECT note_id FROM scored WHERE p1 > 0.9)",
        drawn=_draws("(SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM rest)", 123, "positives", "span_id"),
    ),
)
def cp_select_oversampling(spark, d):
    rows = se.select_training_data(
        ad.scored_spans(spark, d), "Biopsy (procedure)", max_positives=None, thresholds=(0.4, 0.9), ratio=0.5, strategy="oversampling"
    )
    return rows.select("span_id", "draw", "is_positive")


# From notes to training sets: votes, majority labels of one task, and the three strategies.
TRAIN_TASK = "Biopsy (procedure)"
TRAIN_LFS = ["lf_terms", "lf_regex", "logical_1"]
TRAIN_LABELS = """SELECT span_id, note_id, start, "end", lexical_variant, CASE WHEN k2 > k1 THEN 1.0 WHEN k2 = k1 THEN 0.5 ELSE 0.0 END AS p1 FROM (
  SELECT *, (c1 = 1)::INTEGER + (c2 = 1)::INTEGER + (c3 = 1)::INTEGER AS k1, (c1 = 2)::INTEGER + (c2 = 2)::INTEGER + (c3 = 2)::INTEGER AS k2 FROM (
    SELECT logic.*, lexical_variant, CASE WHEN lf_terms IS NULL THEN 1 ELSE 2 END AS c1, CASE WHEN lf_regex IS NULL THEN 1 ELSE 0 END AS c2,
      CASE WHEN logical_1 THEN 2 ELSE 1 END AS c3 FROM logic JOIN (SELECT span_id, lexical_variant FROM span) USING (span_id)))"""
CANDIDATES = "SELECT * FROM scored WHERE p1 <= 0.5 AND note_id IN (SELECT note_id FROM scored WHERE p1 > 0.5)"
CAPPED = "SELECT * FROM scored WHERE p1 > 0.5 ORDER BY md5('123|' || span_id), span_id LIMIT 60"


def _training_set_sql(strategy) -> str:
    positives = "SELECT *, 0 AS draw, true AS is_positive FROM capped"
    negatives = "SELECT * FROM candidates"
    extra = {"scored": TRAIN_LABELS, "capped": CAPPED, "candidates": CANDIDATES}
    if strategy == "subsampling":
        extra["weighted"] = WEIGHT.format(scale=500, t=0.5)
        draw = UNIFORM.format(seed=0, key="span_id")
        extra["picked"] = f"""SELECT * FROM weighted WHERE span_id IN (SELECT span_id FROM candidates)
          ORDER BY -ln({draw}) / weight, span_id LIMIT (SELECT CAST(floor(count(*) * 1.5) AS BIGINT) FROM capped)"""
        negatives = "SELECT * EXCLUDE (weight) FROM picked"
    elif strategy == "oversampling":
        extra["drawn"] = _draws("(SELECT CAST(floor(count(*) * 1.5) AS BIGINT) FROM candidates)", 123, "capped", "span_id")
        positives = """SELECT span_id, note_id, start, "end", lexical_variant, p1, draw, true AS is_positive FROM drawn"""
    rows = f"""SELECT span_id, note_id, start, "end", lexical_variant, p1, draw, is_positive FROM ({positives}) UNION ALL
      SELECT span_id, note_id, start, "end", lexical_variant, p1, 0, false FROM ({negatives})"""
    body = """SELECT note_id, person_id, CAST(count(*) AS INTEGER) AS n_entities, md5(string_agg(start || '-' || "end" || '-' || lexical_variant || '-' || p1::DOUBLE || '-' || md5('instance|' || span_id || '|' || draw), '|'
        ORDER BY start, "end", lexical_variant, p1 DESC, md5('instance|' || span_id || '|' || draw))) AS entities
      FROM chosen JOIN note USING (note_id) GROUP BY 1, 2"""
    return with_ctes(body, "span", **VOTE_CTES, **extra, chosen=rows)


def _training_set(spark, d, strategy):
    notes = ad.notes(spark, d)
    votes = lb.apply_lfs(
        notes, None, [LF_TERMS, LF_REGEX, LF_FOLDED], LOGICAL_RULES, ad.SPAN_PATTERNS, keys=("note_id", "person_id", "note_date")
    )
    labels = lb.label_tasks(votes, {TRAIN_TASK: TRAIN_LFS})
    dataset, _ = se.task_dataset(labels, notes, TRAIN_TASK, max_positives=60, ratio=1.5, strategy=strategy)

    def text(e):
        return F.concat_ws("-", e["start_char"].cast("string"), e["end_char"].cast("string"), e["lexical_variant"], e["biopsy_procedure"]["1"].cast("string"), e["instance_id"])

    return dataset.select("note_id", "person_id", F.size("entities").alias("n_entities"), F.md5(F.array_join(F.transform("entities", text), "|")).alias("entities"))


@query("cp_dataset_subsampling", _training_set_sql("subsampling"))
def cp_dataset_subsampling(spark, d):
    return _training_set(spark, d, "subsampling")


@query("cp_dataset_oversampling", _training_set_sql("oversampling"))
def cp_dataset_oversampling(spark, d):
    return _training_set(spark, d, "oversampling")


@query("cp_dataset_all", _training_set_sql(None))
def cp_dataset_all(spark, d):
    return _training_set(spark, d, None)


# ---------------------------------------------------------------- predictions

TASK_NAMES = ["nation_0_procedure", "nation_1_procedure", "nation_2_procedure"]


def _predictions(spark, d):
    spans = ad.spans(spark, d)
    for i, t in enumerate(TASK_NAMES):
        p = F.pmod(F.col("start") * (i + 3) + F.col("note_id"), F.lit(100)) / 100.0
        spans = spans.withColumn(f"{t}_1", p)
    return spans


PREDICTED = "SELECT *, unnest([0, 1, 2]) AS t FROM span"
SCORES = "SELECT *, 'nation_' || t || '_procedure' AS task_name, ((start * (t + 3) + note_id) % 100) / 100.0::DOUBLE AS score FROM predicted"


@query(
    "sc_unpivot_predictions",
    with_ctes('SELECT note_id, start, "end", label, lexical_variant, task_name, score FROM scores WHERE score >= 0.9', "span", predicted=PREDICTED, scores=SCORES),
)
def sc_unpivot_predictions(spark, d):
    pred = _predictions(spark, d)
    pred = pred.withColumns({t: F.when(F.col(f"{t}_1") >= 0.9, "1").otherwise("0") for t in TASK_NAMES})
    probs = F.create_map(*[x for t in TASK_NAMES for x in (F.lit(t), F.create_map(F.lit("0"), 1 - F.col(f"{t}_1"), F.lit("1"), F.col(f"{t}_1")))])
    return fhir.predictions_long(pred.withColumn("prob", probs), TASK_NAMES)


FHIR_ROWS = """SELECT 'Procedure' AS resourceType, 'completed' AS status, 'https://www.snomed.org/' AS code__coding___0__system, CAST(sctid AS VARCHAR) AS code__coding___0__code, task AS code__coding___0__display,
  'Patient/' || person_id AS subject__reference, person_id AS subject__reference_id, CAST(note_date AS VARCHAR) AS performedDateTime,
  'http://terminology.hl7.org/CodeSystem/v3-ObservationValue' AS meta__security___0__system, 'AIAST' AS meta__security___0__code, 'Artificial Intelligence asserted' AS meta__security___0__display,
  note_id || '-' || start || '-' || "end" || '-' || label || '-' || task_name AS extension_nlp___0__id, 'DocumentReference/' || note_id AS extension_nlp___0__document_reference__reference,
  note_id AS extension_nlp___0__document_reference__reference_id, score AS extension_nlp___0__model_confidence, lexical_variant AS extension_nlp___0__span_text, start AS extension_nlp___0__span_start,
  "end" AS extension_nlp___0__span_end, label AS extension_nlp___0__span_label FROM scores JOIN task ON normalized_task_name = task_name WHERE score >= 0.5"""


def _fhir(spark, d):
    keep = ["note_id", "person_id", "note_date", "start", "end", "label", "lexical_variant"]
    return fhir.scores_long(_predictions(spark, d), TASK_NAMES, keep)


@query(
    "fhir_flat",
    with_ctes(f"SELECT *, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS encounter FROM ({FHIR_ROWS})", "span", "task", predicted=PREDICTED, scores=SCORES),
)
def fhir_flat(spark, d):
    rows = fhir.to_procedure(_fhir(spark, d), ad.tasks(spark, d), evidence=None, performed=F.col("note_date"))
    flat = fhir.flatten_struct(rows, "procedure")
    flat = flat.withColumn("performedDateTime", F.col("performedDateTime").cast("string"))
    return flat.drop("meta__source", "extension_nlp___0__related_span", "extension_nlp___0__text_evidence", "extension_nlp___0__attributes__mode")


@query(
    "cp_fhir",
    with_ctes(
        f"SELECT md5('procedure|' || extension_nlp___0__id) AS id, 'nlp_model_rules' AS meta__source, * FROM ({FHIR_ROWS})", "span", "task", predicted=PREDICTED, scores=SCORES
    ),
)
def cp_fhir(spark, d):
    rows = fhir.predictions_to_fhir(_fhir(spark, d), ad.tasks(spark, d), "rules", evidence=None, performed=F.col("note_date"))
    rows = rows.withColumn("performedDateTime", F.col("performedDateTime").cast("string"))
    return rows.drop("extension_nlp___0__text_evidence", "extension_nlp___0__attributes__mode")


# ---------------------------------------------------------------- report tables

NAMES = ["Rule based", "Medgemma-27b", "Qwen3-8b", "All tasks", "Extra model", "Task specific"]
SHOWN = """SELECT t.task, dataset, name_display, fscore, precision, recall, support FROM (SELECT * FROM metric WHERE (model_id, dataset, produced_at) IN (SELECT model_id, dataset, max(produced_at) FROM metric GROUP BY 1, 2)) t
  JOIN model m ON m.id = t.model_id WHERE active = 1 AND class = '1' AND (name_display <> 'Task specific' OR lower(replace(replace(replace(task_name, ' ', '_'), '(', ''), ')', '')) = t.task)"""


def _cells(measures):
    parts = [f"max(CASE WHEN dataset = '{x}' THEN support END) AS \"Support|{x}\"" for x in "AB"]
    for name in NAMES:
        for x in "AB":
            for m in measures:
                title = f"{name}|{x}|{m}" if len(measures) > 1 else f"{name}|{x}"
                parts.append(f"round(max(CASE WHEN dataset = '{x}' AND name_display = '{name}' THEN {m} END), 6) AS \"{title}\"")
    for x in "AB":
        for m in measures:
            title = f"LLM Average|{x}|{m}" if len(measures) > 1 else f"LLM Average|{x}"
            parts.append(
                f"round((max(CASE WHEN dataset = '{x}' AND name_display = 'Medgemma-27b' THEN {m} END) + max(CASE WHEN dataset = '{x}' AND name_display = 'Qwen3-8b' THEN {m} END)) / 2, 6) AS \"{title}\""
            )
    return ", ".join(parts)


def _metrics_sql(measures):
    return with_ctes(
        f'SELECT normalized_task_name AS task, CAST(any_value(task_id) AS INTEGER) AS "Task id", any_value(snomed_short_name) AS "Task (Procedure)", {_cells(measures)} FROM task LEFT JOIN shown ON shown.task = normalized_task_name GROUP BY 1',
        "task",
        "metric",
        "model",
        shown=SHOWN,
    )


def _table(spark, d, measures):
    models = evl.filter_models(ad.models(spark, d))
    return _rounded(evl.metrics_table(models, ad.metric_rows(spark, d), ad.tasks(spark, d), NAMES, measures))


@query("metrics_table", _metrics_sql(("fscore",)))
def metrics_table(spark, d):
    return _table(spark, d, ("fscore",))


@query("metrics_table_multi", _metrics_sql(("fscore", "recall")))
def metrics_table_multi(spark, d):
    return _table(spark, d, ("fscore", "recall"))


@query(
    "metric_stats",
    with_ctes(
        """SELECT name_display, dataset, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75,
        round(CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / avg(v) END, 6) AS cv FROM (SELECT *, CASE WHEN support >= 50 THEN recall END AS v FROM shown) GROUP BY 1, 2""",
        "metric",
        "model",
        shown=SHOWN,
    ),
)
def metric_stats(spark, d):
    shown = evl.shown_metrics(evl.filter_models(ad.models(spark, d)), ad.metric_rows(spark, d), ad.tasks(spark, d))
    return _rounded(evl.metric_stats(shown, "recall", minimum_support=50))


@query(
    "pf_models",
    with_ctes("SELECT id FROM model WHERE active = 1 AND name_display <> 'Task specific'", "model"),
)
def pf_models(spark, d):
    return evl.filter_models(ad.models(spark, d), True, ["code"], ["ws"]).select("id")


@query("sc_nan_to_null", "SELECT c_custkey, CASE WHEN c_nationkey <> 0 THEN c_acctbal END AS value FROM customer")
def sc_nan_to_null(spark, d):
    value = F.when(F.col("c_nationkey") == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    rows = ad.table(spark, d, "customer").select("c_custkey", value.alias("value"))
    return evl.clean_metrics(rows, ["value"])


INFERRED = f"""SELECT note_id, m[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS INTEGER) AS start
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT note_id, regexp_extract_all(t, '{DATE_REGEX}') AS m, regexp_split_to_array(t, '{DATE_REGEX}') AS g FROM (
    SELECT note_id, lower(translate(strftime(note_date, '%d/%m/%Y') || ' biopsie. ' || note_text, '{accent_table()[0]}', '{accent_table()[1]}')) AS t FROM note)) WHERE len(m) > 0)"""


@query(
    "cp_infer",
    with_ctes(
        """SELECT note_id, start, CAST(start + length(v) AS INTEGER) AS "end", 'biopsy_procedure' AS task_name, 1.0::DOUBLE / (1.0::DOUBLE + start / 100.0::DOUBLE) AS score FROM inferred WHERE start <= 100""",
        "note",
        inferred=INFERRED,
    ),
)
def cp_infer(spark, d):
    """Notes -> date spans -> batch scores -> long rows, with a stand-in scorer over span lengths."""
    mentions = ad.notes(spark, d).withColumn(
        "note_text", F.concat(F.date_format("note_date", "dd/MM/yyyy"), F.lit(" biopsie. "), F.col("note_text"))
    )
    rows = pr.infer(mentions, score_by_offset, ["biopsy_procedure"], export_to_fhir=False, long_format=True)
    return rows.select("note_id", "start", "end", "task_name", "score")


def score_by_offset(batch):
    import pandas as pd

    return pd.DataFrame({"biopsy_procedure_1": 1.0 / (1.0 + batch["start"] / 100.0)})

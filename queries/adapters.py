"""The given tables in the shape of the clinical contracts, for Spark and for SQL.

Each contract is a function here and a CTE of the same name in `CTES`.
"""

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from clinspark.functions.text import accent_table, normalize_name
from clinspark.operators.spans import ContextWindow, extract_spans

SOURCES = {"CLAIMS": "O", "WARD": "F"}
# Notes belong to as many persons as the event log has, and their dates vary independently of the person.
PERSONS_SQL = "(SELECT count(DISTINCT user_id) FROM events)"
NOTE_DAYS = 45

SPAN_PATTERNS = {
    "number": "[0-9]+",
    "email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+",
    "word": "(?:the|und|les|que)",
}
SPAN_KEYS = ("note_id", "person_id", "note_date")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Bytes of a file for one task; its rows in memory may take ten times as much.
SPREAD_BYTES = 4 << 20


def spread_few_files(df: DataFrame, keys) -> DataFrame:
    """The given tables are single files of one row group, which one task reads: their rows are spread over the cores here, by
    the caller. The operators themselves never add this shuffle; large tables have many files and need none. A task that joins or sorts
    the spread rows later holds its part of them, so their number grows with the bytes of the file."""
    if len(df.inputFiles()) != 1:
        return df
    first = df.select("_metadata.file_size").first()
    size = 0 if first is None else first[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, math.ceil(size / SPREAD_BYTES)), *keys)


def persons(spark, d):
    """Number of persons of the event log, as a scalar subquery."""
    return table(spark, d, "events").agg(F.count_distinct("user_id")).scalar()


def visits(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.col("o_orderkey").alias("visit_occurrence_id"),
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").alias("visit_start_datetime"),
        F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 10 as int))").alias("visit_end_datetime"),
        F.when(F.col("o_orderpriority") == "5-LOW", "hospitalisation incomplète")
        .otherwise(F.col("o_orderpriority"))
        .alias("visit_source_value"),
        F.col("o_orderstatus").alias("visit_occurrence_source_value"),
        F.col("c_nationkey").cast("bigint").alias("care_site_id"),
    )


def care_sites(spark, d):
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("care_site_id"), F.col("n_name").alias("care_site_name")
    )


def hospital_groups(spark, d):
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("care_site_id"),
        F.when(F.col("n_regionkey") % 2 == 0, "A").otherwise("B").alias("hospital_group"),
    )


def part_codes(spark, d):
    brand = F.lpad(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")), 2, "0")
    return table(spark, d, "part").select(
        "p_partkey",
        "p_brand",
        "p_type",
        "p_size",
        F.concat(F.substring("p_type", 1, 1), brand, F.col("p_size").cast("string")).alias("code"),
    )


def _occurrence_id():
    return F.md5(
        F.concat_ws(
            "|",
            *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("bigint").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
            "l_returnflag",
            "l_linestatus",
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        )
    )


def _claims(spark, d):
    lineitem, orders = spread_few_files(table(spark, d, "lineitem"), ["l_orderkey"]), table(spark, d, "orders")
    rows = lineitem.join(part_codes(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def conditions(spark, d):
    status = F.when(F.col("l_returnflag") == "R", "DP").when(F.col("l_returnflag") == "A", "DR").otherwise("DAS")
    return _claims(spark, d).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_orderkey").alias("visit_occurrence_id"),
        _occurrence_id().alias("condition_occurrence_id"),
        F.col("l_shipdate").alias("condition_start_datetime"),
        F.col("code").alias("condition_source_value"),
        status.alias("condition_status_source_value"),
        F.col("l_linestatus").alias("cdm_source"),
    )


def procedures(spark, d):
    return _claims(spark, d).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_orderkey").alias("visit_occurrence_id"),
        _occurrence_id().alias("procedure_occurrence_id"),
        F.col("l_shipdate").alias("procedure_datetime"),
        F.col("p_brand").alias("procedure_source_value"),
        F.col("l_linestatus").alias("cdm_source"),
    )


def costs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("cost_id"),
        F.col("o_orderkey").alias("cost_event_id"),
        F.col("o_orderstatus").alias("drg_source_value"),
        F.col("o_orderpriority").alias("cdm_source"),
    )


def concepts(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("concept_id"),
        F.col("p_brand").alias("concept_code"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(";")).alias("concept_name"),
        F.when(F.col("p_size") <= 25, "ATC").otherwise("OTHER").alias("vocabulary_id"),
    )


def drug_exposures(spark, d, status):
    """Administrations are the lines of status O, prescriptions those of status F."""
    lineitem, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = lineitem.filter(F.col("l_linestatus") == status).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("person_id"),
        F.to_date("l_shipdate").alias("drug_exposure_start_date"),
        F.col("l_partkey").alias("drug_class_concept_id"),
    )


def event_codes():
    code = F.lit(None).cast("bigint")
    for i, kind in enumerate(("click", "view", "purchase", "signup", "error"), 1):
        code = F.when(F.col("event_type") == kind, F.lit(i).cast("bigint")).otherwise(code)
    return code


def imaging(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("person_id"),
        F.col("ts").alias("series_datetime"),
        event_codes().alias("modality_concept_id"),
        (F.floor("value") % 7 + 1).cast("bigint").alias("modality_source_concept_id"),
    )


def notes(spark, d):
    lang = F.create_map(*[F.lit(x) for p in (("en", 1), ("fr", 2), ("de", 3), ("es", 4)) for x in p])
    source = F.substring("source", 4, 9).cast("bigint") + 100
    return spread_few_files(table(spark, d, "documents"), ["doc_id"]).select(
        F.col("doc_id").alias("note_id"),
        (F.col("doc_id") % persons(spark, d)).alias("person_id"),
        F.col("doc_id").alias("visit_occurrence_id"),
        F.expr(f"date_add(date'2024-01-01', cast((doc_id * 7 + doc_id div 11) % {NOTE_DAYS} as int))").alias("note_date"),
        F.array("lang", "source").alias("note_class_source_value"),
        F.array(lang[F.col("lang")].cast("bigint"), source).alias("note_class_concept_id"),
        F.col("text").alias("note_text"),
        F.when(F.col("n_chars") < 200, "Supprimé").otherwise("Actif").alias("row_status_source_value"),
        "n_chars",
        "lang",
        "source",
    )


def tasks(spark, d):
    return table(spark, d, "nation").select(
        (F.col("n_nationkey") + 1).alias("task_id"),
        F.concat("n_name", F.lit(" (procedure)")).alias("task"),
        normalize_name(F.concat("n_name", F.lit(" (procedure)"))).alias("normalized_task_name"),
        F.concat(F.lit("Acte "), "n_name").alias("Task Name (date de)"),
        F.initcap("n_name").alias("snomed_short_name"),
        (F.col("n_nationkey") + 1000).cast("bigint").alias("SNOMED CT - SCTID"),
        (F.col("n_regionkey") + 1).alias("Group"),
    )


def code_dictionary(spark, d):
    """(full_code): the terminology of the diagnosis codes."""
    return part_codes(spark, d).select(F.col("code").alias("full_code")).distinct()


def _listed(parts, entries):
    """Rows of the structs whose condition holds, from one read of the parts."""
    structs = F.array(*[F.when(F.expr(condition), entry) for condition, entry in entries])
    return parts.select(F.inline(F.filter(structs, lambda e: e.isNotNull()))).distinct()


def condition_codes(spark, d):
    """Three-character codes of small medium parts and full codes of large promo parts, with a task."""

    def entry(code, task):
        return F.struct(code.alias("code"), task.alias("task_id"))

    short = entry(F.substring("code", 1, 3), F.col("p_size") % 3 + 1)
    full = entry(F.col("code"), F.col("p_size") % 3 + 4)
    return _listed(part_codes(spark, d), [("p_type = 'MEDIUM' and p_size < 10", short), ("p_type = 'PROMO' and p_size >= 45", full)])


def procedure_codes(spark, d):
    return (
        part_codes(spark, d)
        .filter("p_size = 1")
        .select(F.col("p_brand").alias("code"), (F.length("p_type") % 3 + 7).alias("task_id"))
        .distinct()
    )


def step_lists(spark, d):
    """(list, code): claim code lists by part type."""

    def entry(name, code):
        return F.struct(F.lit(name).alias("list"), code.alias("code"))

    short = F.substring("code", 1, 3)
    return _listed(
        part_codes(spark, d),
        [
            ("p_type in ('ECONOMY', 'MEDIUM') and p_brand in ('Brand#11', 'Brand#5', 'Brand#7')", entry("list_1", short)),
            ("p_type = 'LARGE'", entry("list_1_radiotherapy", F.substring("code", 1, 1))),
            ("p_type = 'PROMO' and p_size > 40", entry("list_2", short)),
            ("p_type = 'STANDARD' and p_size > 45", entry("list_3", short)),
            ("p_type = 'STANDARD' and p_size < 30", entry("list_4d", F.col("code"))),
            ("p_brand in ('Brand#1', 'Brand#12', 'Brand#23')", entry("list_4a", F.col("p_brand"))),
        ],
    )


def localisations(spark, d):
    """(code, system, organ) of the three-character codes."""
    parts = part_codes(spark, d).filter("p_type in ('ECONOMY', 'LARGE', 'MEDIUM')")
    return parts.select(
        F.substring("code", 1, 3).alias("code"),
        F.col("p_type").alias("system"),
        F.concat(F.substring("p_type", 1, 2), F.lit("_"), F.col("p_brand")).alias("organ"),
    ).distinct()


def knowledge_rows(spark, d):
    """Knowledge events of the persons of the notes, from the event log."""
    lf = F.when(F.col("event_type").isin("click", "view"), "lf_imaging_md").otherwise("lf_ccam")
    return table(spark, d, "events").select(
        F.col("user_id").alias("person_id"),
        lf.alias("lf"),
        F.to_date("ts").alias("event_date"),
        F.col("event_type").alias("class"),
    )


def spans(spark, d, contexts=None):
    """Numbers, e-mail addresses and common words of the notes."""
    return extract_spans(notes(spark, d), SPAN_PATTERNS, keys=SPAN_KEYS, contexts=contexts)


def scored_spans(spark, d):
    """Spans with a probability column of one task."""
    score = F.pmod(F.col("start") * 7 + F.col("note_id"), F.lit(1000)) / 1000.0
    return spans(spark, d).withColumn("biopsy_procedure_1", score).withColumn("biopsy_procedure", F.round(score, 1).cast("string"))


TASK = "low quality"
VOTES = ["lf_marks", "lf_digit", "lf_short", "lf_lang", "lf_mail"]


def document_votes(spark, d):
    """Labelling functions over whole documents: string, boolean and array votes for one task."""
    text = F.col("text")
    return spread_few_files(table(spark, d, "documents"), ["doc_id"]).select(
        F.col("doc_id").alias("span_id"),
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("note_id"),
        (F.col("doc_id") % persons(spark, d)).alias("person_id"),
        F.when(text.rlike(r"!!|###|\$\$"), TASK).when(text.rlike("%%%"), "other task").alias("lf_marks"),
        F.when(text.rlike("[0-9]"), TASK).alias("lf_digit"),
        F.when(F.col("n_chars") < 400, F.lit(True)).when(F.col("n_chars") > 4000, F.lit(False)).alias("lf_short"),
        F.when(F.col("lang") == "es", F.array(F.lit("other task"), F.lit(TASK)))
        .when(F.col("lang") == "de", F.array(F.lit("other task")))
        .alias("lf_lang"),
        F.when(text.rlike("@"), F.lit(False)).alias("lf_mail"),
    )


def gold(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("span_id"), "quality", "toxic")


def gold_spans(spark, d):
    """Two tasks per labelled document, as "0"/"1"."""
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("note_id"),
        F.lit(0).alias("start"),
        F.lit(1).alias("end"),
        F.lit("doc").alias("label"),
        F.when(F.col("quality") == 0, "1").otherwise("0").alias("bad"),
        F.col("toxic").cast("string").alias("toxic"),
    )


def predicted_spans(spark, d, long_from=4000):
    """Rule predictions of the two tasks on every document."""
    text = F.col("text")
    return spread_few_files(table(spark, d, "documents"), ["doc_id"]).select(
        F.col("doc_id").alias("note_id"),
        F.lit(0).alias("start"),
        F.lit(1).alias("end"),
        F.lit("doc").alias("label"),
        F.when(text.rlike(r"!!|###|\$\$|%%%"), "1").otherwise("0").alias("bad"),
        F.when(F.col("n_chars") > long_from, "1").otherwise("0").alias("toxic"),
    )


def models(spark, d):
    """Model registry: one model per region, and a task-specific one per nation."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    names = F.create_map(
        *[F.lit(x) for p in enumerate(("Rule based", "Medgemma-27b", "Qwen3-8b", "All tasks", "Extra model")) for x in p]
    )
    general = region.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
        F.lit("code").alias("name_code"),
        names[F.col("r_regionkey")].alias("name_display"),
        F.lit("ws").alias("type"),
        F.lit(1).alias("active"),
        F.lit(None).cast("string").alias("task_name"),
    )
    specific = nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.lit("code").alias("name_code"),
        F.lit("Task specific").alias("name_display"),
        F.lit("ts").alias("type"),
        F.when(F.col("n_regionkey") == 4, 0).otherwise(1).alias("active"),
        F.concat("n_name", F.lit(" (procedure)")).alias("task_name"),
    )
    return general.unionByName(specific)


def metric_rows(spark, d):
    """Metrics per model, dataset, task and year, from order lines by supplier region and customer nation."""
    lineitem, orders, customer = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    base = (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    support = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("support"))
    ids = F.array(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    )
    rows = base.select(
        F.explode(ids).alias("model_id"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("dataset"),
        "c_nationkey",
        F.year("l_shipdate").alias("produced_at"),
        F.when(F.col("l_returnflag") == "N", "0").otherwise("1").alias("class"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    grouped = rows.groupBy("model_id", "dataset", "c_nationkey", "produced_at", "class").agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / F.count(F.lit(1)) / 10).alias("fscore"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("bigint")) / F.count(F.lit(1)) / 8).alias("precision"),
        (F.sum(F.col("l_quantity").cast("bigint")) / F.count(F.lit(1)) / 50).alias("recall"),
    )
    name = normalize_name(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit(" (procedure)")))
    return grouped.join(support, "c_nationkey").withColumn("task", name).withColumn("name_code", F.lit("code")).drop("c_nationkey")


CONTEXT = {"context": ContextWindow(sentences=1)}

# ------------------------------------------------------------------ the same contracts in SQL

_FROM, _TO = accent_table()


def _spans_sql() -> str:
    parts = []
    for label, pattern in SPAN_PATTERNS.items():
        parts.append(
            f"SELECT note_id, person_id, note_date, '{label}' AS label, regexp_extract_all(note_text, '{pattern}') AS m, "
            f"regexp_split_to_array(note_text, '{pattern}') AS g, note_text FROM note"
        )
    inner = " UNION ALL ".join(parts)
    return f"""
      SELECT *, CAST(start + length(lexical_variant) AS INTEGER) AS "end",
             md5('span|' || note_id || '|' || person_id || '|' || note_date || '|' || label || '|' || start || '|' || (start + length(lexical_variant))) AS span_id
      FROM (SELECT note_id, person_id, note_date, label, note_text, m[i] AS lexical_variant,
              CAST(list_sum(list_transform(g[1:i], lambda z: length(z)))
                + coalesce(list_sum(list_transform(m[1:i-1], lambda z: length(z))), 0) AS INTEGER) AS start
            FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM ({inner}) WHERE len(m) > 0))"""


CTES = {
    "visit": """SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, o_orderdate AS visit_start_datetime,
        o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS visit_end_datetime,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'hospitalisation incomplète' ELSE o_orderpriority END AS visit_source_value,
        o_orderstatus AS visit_occurrence_source_value, CAST(c_nationkey AS BIGINT) AS care_site_id
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "care_site": "SELECT CAST(n_nationkey AS BIGINT) AS care_site_id, n_name AS care_site_name FROM nation",
    "hospital": "SELECT CAST(n_nationkey AS BIGINT) AS care_site_id, CASE WHEN n_regionkey % 2 = 0 THEN 'A' ELSE 'B' END AS hospital_group FROM nation",
    "part_code": """SELECT p_partkey, p_brand, p_type, p_size,
        substr(p_type, 1, 1) || lpad(replace(p_brand, 'Brand#', ''), 2, '0') || CAST(p_size AS VARCHAR) AS code FROM part""",
    "claim": """SELECT o_custkey AS person_id, l_orderkey AS visit_occurrence_id,
        md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
            CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
            l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))) AS occurrence_id,
        l_shipdate, code, p_brand, l_returnflag, l_linestatus
        FROM lineitem JOIN part_code ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "condition": """SELECT person_id, visit_occurrence_id, occurrence_id AS condition_occurrence_id, l_shipdate AS condition_start_datetime,
        code AS condition_source_value, CASE l_returnflag WHEN 'R' THEN 'DP' WHEN 'A' THEN 'DR' ELSE 'DAS' END AS condition_status_source_value,
        l_linestatus AS cdm_source FROM claim""",
    "procedure_": """SELECT person_id, visit_occurrence_id, occurrence_id AS procedure_occurrence_id, l_shipdate AS procedure_datetime,
        p_brand AS procedure_source_value, l_linestatus AS cdm_source FROM claim""",
    "concept": """SELECT p_partkey AS concept_id, p_brand AS concept_code, replace(p_name, ' ', ';') AS concept_name,
        CASE WHEN p_size <= 25 THEN 'ATC' ELSE 'OTHER' END AS vocabulary_id FROM part""",
    "drug": """SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS drug_exposure_start_date, l_partkey AS drug_class_concept_id,
        l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "imaging": """SELECT user_id AS person_id, ts AS series_datetime,
        CAST(list_position(['click', 'view', 'purchase', 'signup', 'error'], event_type) AS BIGINT) AS modality_concept_id,
        CAST(floor(value) AS BIGINT) % 7 + 1 AS modality_source_concept_id FROM events""",
    "note": f"""SELECT doc_id AS note_id, doc_id % {PERSONS_SQL} AS person_id, doc_id AS visit_occurrence_id,
        CAST(DATE '2024-01-01' + CAST((doc_id * 7 + doc_id // 11) % {NOTE_DAYS} AS INTEGER) AS DATE) AS note_date, [lang, source] AS note_class_source_value,
        [CAST(list_position(['en', 'fr', 'de', 'es'], lang) AS BIGINT), CAST(substr(source, 4) AS BIGINT) + 100] AS note_class_concept_id,
        text AS note_text, CASE WHEN n_chars < 200 THEN 'Supprimé' ELSE 'Actif' END AS row_status_source_value, n_chars, lang, source
        FROM documents""",
    "task": """SELECT n_nationkey + 1 AS task_id, n_name || ' (procedure)' AS task, lower(n_name) || '_procedure' AS normalized_task_name,
        'Acte ' || n_name AS task_fr, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS snomed_short_name,
        CAST(n_nationkey + 1000 AS BIGINT) AS sctid, n_regionkey + 1 AS grp FROM nation""",
    "condition_code": """SELECT DISTINCT * FROM (SELECT substr(code, 1, 3) AS code, p_size % 3 + 1 AS task_id FROM part_code WHERE p_type = 'MEDIUM' AND p_size < 10
        UNION ALL SELECT code, p_size % 3 + 4 FROM part_code WHERE p_type = 'PROMO' AND p_size >= 45)""",
    "procedure_code": "SELECT DISTINCT p_brand AS code, CAST(length(p_type) % 3 + 7 AS INTEGER) AS task_id FROM part_code WHERE p_size = 1",
    "step_list": """SELECT DISTINCT * FROM (
        SELECT 'list_1' AS list, substr(code, 1, 3) AS code FROM part_code WHERE p_type IN ('ECONOMY', 'MEDIUM') AND p_brand IN ('Brand#11', 'Brand#5', 'Brand#7')
        UNION ALL SELECT 'list_1_radiotherapy', substr(code, 1, 1) FROM part_code WHERE p_type = 'LARGE'
        UNION ALL SELECT 'list_2', substr(code, 1, 3) FROM part_code WHERE p_type = 'PROMO' AND p_size > 40
        UNION ALL SELECT 'list_3', substr(code, 1, 3) FROM part_code WHERE p_type = 'STANDARD' AND p_size > 45
        UNION ALL SELECT 'list_4d', code FROM part_code WHERE p_type = 'STANDARD' AND p_size < 30
        UNION ALL SELECT 'list_4a', p_brand FROM part_code WHERE p_brand IN ('Brand#1', 'Brand#12', 'Brand#23'))""",
    "localisation": """SELECT DISTINCT substr(code, 1, 3) AS code, p_type AS system, substr(p_type, 1, 2) || '_' || p_brand AS organ
        FROM part_code WHERE p_type IN ('ECONOMY', 'LARGE', 'MEDIUM')""",
    "knowledge": """SELECT user_id AS person_id, CASE WHEN event_type IN ('click', 'view') THEN 'lf_imaging_md' ELSE 'lf_ccam' END AS lf,
        CAST(ts AS DATE) AS event_date, event_type AS class FROM events""",
    "span": _spans_sql(),
    "scored": "SELECT *, ((start * 7 + note_id) % 1000) / 1000.0::DOUBLE AS p1 FROM span",
    "vote": f"""SELECT doc_id AS span_id, CAST(floor(doc_id / 4) AS BIGINT) AS note_id, doc_id % {PERSONS_SQL} AS person_id,
        CASE WHEN regexp_matches(text, '!!|###|\\$\\$') THEN '{TASK}' WHEN regexp_matches(text, '%%%') THEN 'other task' END AS lf_marks,
        CASE WHEN regexp_matches(text, '[0-9]') THEN '{TASK}' END AS lf_digit,
        CASE WHEN n_chars < 400 THEN true WHEN n_chars > 4000 THEN false END AS lf_short,
        CASE WHEN lang = 'es' THEN ['other task', '{TASK}'] WHEN lang = 'de' THEN ['other task'] END AS lf_lang,
        CASE WHEN regexp_matches(text, '@') THEN false END AS lf_mail FROM documents""",
    # The vote codes of the task: 2 positive, 1 negative, 0 abstention; lf_digit has no negative vote of its own.
    "matrix": f"""SELECT span_id, note_id, person_id,
        CASE WHEN lf_marks = '{TASK}' THEN 2 ELSE 0 END AS lf_marks,
        CASE WHEN lf_digit = '{TASK}' THEN 2 WHEN lf_digit IS NULL THEN 1 ELSE 0 END AS lf_digit,
        CASE WHEN lf_short THEN 2 WHEN NOT lf_short THEN 1 ELSE 0 END AS lf_short,
        CASE WHEN list_contains(lf_lang, '{TASK}') THEN 2 ELSE 0 END AS lf_lang,
        CASE WHEN lf_mail THEN 2 WHEN NOT lf_mail THEN 1 ELSE 0 END AS lf_mail FROM vote""",
    "gold_span": """SELECT doc_id AS note_id, 0 AS start, 1 AS "end", 'doc' AS label, CASE WHEN quality = 0 THEN '1' ELSE '0' END AS bad,
        CAST(toxic AS VARCHAR) AS toxic FROM labels""",
    "pred_span": """SELECT doc_id AS note_id, 0 AS start, 1 AS "end", 'doc' AS label,
        CASE WHEN regexp_matches(text, '!!|###|\\$\\$|%%%') THEN '1' ELSE '0' END AS bad,
        CASE WHEN n_chars > 4000 THEN '1' ELSE '0' END AS toxic FROM documents""",
    "model": """SELECT 'r' || r_regionkey AS id, 'code' AS name_code,
        list_extract(['Rule based', 'Medgemma-27b', 'Qwen3-8b', 'All tasks', 'Extra model'], r_regionkey + 1) AS name_display, 1 AS active, NULL AS task_name FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'code', 'Task specific', CASE WHEN n_regionkey = 4 THEN 0 ELSE 1 END, n_name || ' (procedure)' FROM nation""",
    "metric": """SELECT model_id, dataset, c_nationkey, produced_at, class, 'nation_' || c_nationkey || '_procedure' AS task, support,
          CAST(sum(disc) AS DOUBLE) / count(*) / 10 AS fscore, CAST(sum(tax) AS DOUBLE) / count(*) / 8 AS precision, CAST(sum(qty) AS DOUBLE) / count(*) / 50 AS recall
        FROM (SELECT unnest(['r' || n_regionkey, 'n' || c_nationkey]) AS model_id, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS dataset, c_nationkey,
            year(l_shipdate) AS produced_at, CASE WHEN l_returnflag = 'N' THEN '0' ELSE '1' END AS class,
            CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
        JOIN (SELECT c_nationkey, count(*) AS support FROM customer GROUP BY 1) USING (c_nationkey)
        GROUP BY ALL""",
}

# Contracts that read other contracts, which must be stated before them.
NEEDS = {
    "claim": ["part_code"],
    "condition": ["claim"],
    "procedure_": ["claim"],
    "condition_code": ["part_code"],
    "procedure_code": ["part_code"],
    "step_list": ["part_code"],
    "localisation": ["part_code"],
    "span": ["note"],
    "scored": ["span"],
    "matrix": ["vote"],
}


def with_ctes(body: str, *names: str, **extra: str) -> str:
    """SQL text with the contracts it reads stated as CTEs; `extra` CTEs come after them."""
    ordered: list[str] = []

    def add(name):
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body

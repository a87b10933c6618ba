"""Queries over coded events: sources, filters, joins and set operations."""

from pyspark.sql import functions as F

from clinspark.functions import text as tx
from clinspark.operators import codes as cd, events as ev, groups as gr, vocabulary as voc
from clinspark.operators.datasets import fingerprint, text_fingerprint
from clinspark.sources import dimensions as dim, tables as tb
from queries import adapters as ad
from queries.adapters import with_ctes
from queries.registry import query

DAY = "CAST(CAST({} AS DATE) AS VARCHAR)"


def day(column):
    return F.to_date(column).cast("string")


# ---------------------------------------------------------------- sources


@query(
    "src_read_project",
    "SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id FROM orders",
)
def src_read_project(spark, d):
    df = tb.read_table(spark, "orders.parquet", folder=d)
    return df.withColumnsRenamed({"o_orderkey": "visit_occurrence_id", "o_custkey": "person_id"}).select(
        "visit_occurrence_id", "person_id"
    )


@query(
    "src_rename",
    "SELECT o_orderkey AS visit_occurrence_id, o_orderstatus AS condition_source_value, o_orderpriority AS cdm_source, o_custkey AS person_id FROM orders",
)
def src_rename(spark, d):
    raw = ad.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("_encounterReferenceId"),
        F.col("o_orderstatus").alias("code__text"),
        F.col("o_orderpriority").alias("meta__source"),
        F.col("o_custkey").alias("_subjectReferenceId"),
    )
    return tb.rename_columns(raw, "condition")


@query("src_rows_per_file", "SELECT 'lineitem.parquet' AS file, count(*) AS n_rows FROM lineitem")
def src_rows_per_file(spark, d):
    rows = tb.rows_per_file(ad.table(spark, d, "lineitem"))
    return rows.select(F.element_at(F.split("file_path", "/"), -1).alias("file"), "n_rows")


@query(
    "src_keep_avoid",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderpriority NOT IN ('5-LOW')",
)
def src_keep_avoid(spark, d):
    return tb.read_filtered(
        ad.table(spark, d, "orders"),
        ["o_orderkey", "o_custkey"],
        keep=["1-URGENT", "2-HIGH", "5-LOW"],
        avoid=["5-LOW"],
        filter_column="o_orderpriority",
    )


@query(
    "src_cast_to_tz",
    "SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS local_ts FROM events",
)
def src_cast_to_tz(spark, d):
    local = tb.cast_to_tz(ad.table(spark, d, "events").select("event_id", "ts"), "Europe/Paris")
    return local.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("local_ts"))


@query(
    "src_flag_lists",
    with_ctes(
        """SELECT DISTINCT list, code FROM (
        SELECT 'list_1' AS list, code FROM part_code WHERE p_type = 'ECONOMY' UNION ALL SELECT 'list_1_radiotherapy', code FROM part_code WHERE p_size < 10
        UNION ALL SELECT 'list_2', code FROM part_code WHERE p_brand = 'Brand#3' UNION ALL SELECT 'list_3', code FROM part_code WHERE p_type = 'STANDARD'
        UNION ALL SELECT 'list_4d', code FROM part_code WHERE p_size > 45 UNION ALL SELECT 'list_4a', code FROM part_code WHERE p_brand LIKE 'Brand#1%')""",
        "part_code",
    ),
)
def src_flag_lists(spark, d):
    flags = ad.part_codes(spark, d).select(
        F.col("code").alias("Code"),
        F.when(F.col("p_type") == "ECONOMY", "x").alias("Liste_1"),
        F.when(F.col("p_size") < 10, "x").alias("Radioth"),
        F.when(F.col("p_brand") == "Brand#3", "x").alias("Liste_2"),
        F.when(F.col("p_type") == "STANDARD", "x").otherwise("no").alias("Liste_3"),
        F.when(F.col("p_size") > 45, "x").alias("Liste_4_D"),
        F.when(F.col("p_brand").startswith("Brand#1"), "x").alias("Liste_4_A"),
    )
    return cd.step_code_lists(flags).distinct()


@query(
    "src_tasks",
    "SELECT n_nationkey AS task_id, n_name || ', (type/one-two. x)' AS task, lower(n_name) || '_type_one_two__x' AS normalized_task_name FROM nation",
)
def src_tasks(spark, d):
    raw = ad.table(spark, d, "nation").select(
        F.col("n_nationkey").alias("Task Number"),
        F.concat("n_name", F.lit(", (type/one-two. x)")).alias("SNOMED CT - Fully Specified Name (FSN)"),
    )
    return dim.read_tasks(raw)


@query(
    "src_lf_reference",
    with_ctes(
        """SELECT r.task_number, r.ref_name, r.lf_type, t.task_id, t.normalized_task_name
        FROM (SELECT s_nationkey + 2 AS task_number, 'lf_' || s_suppkey AS ref_name, CASE WHEN s_acctbal > 5000 THEN 'regex' ELSE 'code' END AS lf_type
              FROM supplier WHERE s_acctbal > 1000) r LEFT JOIN task t ON t.task_id = r.task_number""",
        "task",
    ),
)
def src_lf_reference(spark, d):
    raw = ad.table(spark, d, "supplier").select(
        (F.col("s_nationkey") + 2).alias("Task Number"),
        F.concat(F.lit("lf_"), F.col("s_suppkey").cast("string")).alias("ref_name"),
        F.when(F.col("s_acctbal") > 5000, "regex").otherwise("code").alias("LF type"),
        F.when(F.col("s_acctbal") > 1000, "ok").alias("Implemented"),
    )
    rows, _ = dim.read_lf_reference(raw, ad.tasks(spark, d))
    return rows.withColumnsRenamed({"Task Number": "task_number", "LF type": "lf_type"})


@query(
    "src_knowledge_codes",
    with_ctes(
        """SELECT 'condition' AS kind, code, task_id FROM condition_code UNION ALL SELECT 'procedure', code, task_id FROM procedure_code
        UNION ALL SELECT 'imaging', CAST(n_nationkey AS VARCHAR), n_regionkey FROM nation""",
        "condition_code",
        "procedure_code",
    ),
)
def src_knowledge_codes(spark, d):
    imaging = ad.table(spark, d, "nation").select(F.col("n_nationkey").alias("concept_id"), F.col("n_regionkey").alias("Task Number"))
    sheets = {
        "condition": ad.condition_codes(spark, d).withColumnRenamed("task_id", "Task Number"),
        "procedure": ad.procedure_codes(spark, d).withColumnRenamed("task_id", "Task Number"),
        "imaging": imaging,
    }
    return dim.knowledge_codes(sheets)


DRUG_CLASS = """CASE p_type WHEN 'ECONOMY' THEN 'Chimiothérapie' WHEN 'LARGE' THEN 'Thérapie ciblée' WHEN 'MEDIUM' THEN 'Immunothérapie'
  WHEN 'PROMO' THEN 'Médicaments antihormonaux utilisés en oncologie' ELSE 'Autre' END"""


def _raw_drugs(spark, d):
    kind = (
        F.when(F.col("p_type") == "ECONOMY", "Chimiothérapie")
        .when(F.col("p_type") == "LARGE", "Thérapie ciblée")
        .when(F.col("p_type") == "MEDIUM", "Immunothérapie")
        .when(F.col("p_type") == "PROMO", "Médicaments antihormonaux utilisés en oncologie")
        .otherwise("Autre")
    )
    return ad.table(spark, d, "part").select(
        F.col("p_brand").alias("ATC"),
        F.concat(F.lit("É"), F.element_at(F.split("p_name", " "), 1)).alias("atcnm_e"),
        F.concat(F.col("p_name"), F.lit(" Çœ+(")).alias("medicament"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("substance_active"),
        kind.alias("macro_class"),
    )


@query(
    "src_oncology_drugs",
    f"""SELECT ATC, treatement_type, normalized_atc, normalized_commercial_drug, normalized_active_substance,
      CASE treatement_type WHEN 'Chimiothérapie' THEN 367336001 WHEN 'Thérapie ciblée' THEN 1255831008 WHEN 'Immunothérapie' THEN 76334006 ELSE 169413002 END AS sctid
    FROM (SELECT p_brand AS ATC, {DRUG_CLASS} AS treatement_type, 'e' || split_part(p_name, ' ', 1) AS normalized_atc, p_name || ' c+(' AS normalized_commercial_drug,
      CASE WHEN p_size > 25 THEN lower(p_brand) END AS normalized_active_substance FROM part) WHERE treatement_type <> 'Autre'""",
)
def src_oncology_drugs(spark, d):
    drugs = dim.oncology_drugs(_raw_drugs(spark, d))
    return drugs.select(
        "ATC", "treatement_type", "normalized_atc", "normalized_commercial_drug", "normalized_active_substance",
        F.col("SNOMED CT - SCTID").alias("sctid"),
    )


@query(
    "drug_vocab",
    f"""WITH named AS (SELECT {DRUG_CLASS} AS treatement_type, unnest([{{'k': 'atc', 'v': 'e' || split_part(p_name, ' ', 1)}},
        {{'k': 'commercial', 'v': p_name || ' c+('}}, {{'k': 'active_substance', 'v': CASE WHEN p_size > 25 THEN lower(p_brand) END}}]) AS x FROM part),
      long AS (SELECT treatement_type, x.k AS label_type, x.v AS name FROM named WHERE treatement_type <> 'Autre' AND x.v IS NOT NULL),
      stacked AS (SELECT * FROM long UNION SELECT treatement_type, 'all', name FROM long UNION SELECT 'all', 'all', name FROM long)
    SELECT treatement_type, label_type, string_agg(name, '|' ORDER BY name) AS names, '(?i)(?:' || string_agg('\\Q' || name || '\\E', '|' ORDER BY name) || ')' AS regex
    FROM stacked GROUP BY 1, 2""",
)
def drug_vocab(spark, d):
    vocab = dim.drug_vocab(dim.oncology_drugs(_raw_drugs(spark, d)))
    return vocab.drop("chunk").withColumn("names", F.array_join("names", "|"))


DRUG_NAMES = f"""SELECT DISTINCT treatement_type, x.k AS label_type, x.v AS name FROM (SELECT {DRUG_CLASS} AS treatement_type, unnest([{{'k': 'atc', 'v': 'e' || split_part(p_name, ' ', 1)}},
    {{'k': 'commercial', 'v': p_name || ' c+('}}, {{'k': 'active_substance', 'v': CASE WHEN p_size > 25 THEN lower(p_brand) END}}]) AS x FROM part) WHERE treatement_type <> 'Autre' AND x.v IS NOT NULL"""


@query("drug_names", f"WITH one AS ({DRUG_NAMES}) SELECT * FROM one UNION SELECT treatement_type, 'all', name FROM one UNION SELECT 'all', 'all', name FROM one")
def drug_names(spark, d):
    return dim.drug_names(dim.oncology_drugs(_raw_drugs(spark, d)))


@query(
    "drug_mentions",
    f"""WITH name AS ({DRUG_NAMES}), named AS (SELECT treatement_type, label_type, name, regexp_extract_all(name, '[a-z0-9]+') AS t FROM name),
      note AS (SELECT l_orderkey * 10 + l_linenumber AS note_id, l_partkey, regexp_extract_all(lower('Traite par e' || split_part(p_name, ' ', 1) || ', puis ' || p_name || ' c+(; voir ' || p_brand || '.'), '[a-z0-9]+') AS t
        FROM lineitem JOIN part ON p_partkey = l_partkey),
      run AS (SELECT note_id, i - 1 AS place, n, array_to_string(t[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM note), (SELECT DISTINCT len(t) AS n FROM named) WHERE i + n - 1 <= len(t))
    SELECT note_id, CAST(place AS INTEGER) AS place, name, treatement_type, label_type FROM run JOIN named ON len(named.t) = run.n AND array_to_string(named.t, ' ') = phrase""",
)
def drug_mentions(spark, d):
    """Names of the drug list in a sentence per order line."""
    drugs = dim.drug_names(dim.oncology_drugs(_raw_drugs(spark, d))).filter("label_type <> 'all'")
    parts = ad.table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    lines = ad.table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    first = F.element_at(F.split("p_name", " "), 1)
    text = F.concat(F.lit("Traité par É"), first, F.lit(", puis "), F.upper("p_name"), F.lit(" Ç+(; voir "), F.col("p_brand"), F.lit("."))
    notes = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note_id"), text.alias("note_text"))
    return voc.find_names(notes, drugs, keep=("treatement_type", "label_type")).withColumnRenamed("at", "place")


@query(
    "fingerprint",
    """SELECT count(*) AS n_rows, CAST(sum(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)), 1, 12))::BIGINT) AS VARCHAR) AS hash_sum FROM orders""",
)
def fingerprint_query(spark, d):
    return text_fingerprint(ad.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("fingerprint_layout")
def fingerprint_layout(spark, d):
    return fingerprint(ad.table(spark, d, "orders"))


# ---------------------------------------------------------------- filters


@query(
    "pf_claim_source",
    with_ctes("SELECT person_id, condition_occurrence_id FROM condition WHERE cdm_source = 'O'", "condition"),
)
def pf_claim_source(spark, d):
    return cd.filter_source(ad.conditions(spark, d), "CLAIMS", ad.SOURCES).select("person_id", "condition_occurrence_id")


@query(
    "pf_procedures_list",
    with_ctes(
        f"""SELECT p.person_id, p.visit_occurrence_id, procedure_occurrence_id, {DAY.format('procedure_datetime')} AS procedure_date, v.visit_occurrence_source_value
        FROM procedure_ p LEFT JOIN visit v USING (visit_occurrence_id) WHERE procedure_source_value IN ('Brand#1', 'Brand#12') AND cdm_source = 'O'""",
        "procedure_",
        "visit",
    ),
)
def pf_procedures_list(spark, d):
    rows = ev.select_procedures(ad.procedures(spark, d), ad.visits(spark, d), ["Brand#1", "Brand#12"], "CLAIMS", ad.SOURCES)
    return rows.select(
        "person_id", "visit_occurrence_id", "procedure_occurrence_id", day("procedure_date").alias("procedure_date"), "visit_occurrence_source_value"
    )


@query(
    "pf_cost",
    "SELECT o_orderkey AS cost_id, o_orderkey AS visit_occurrence_id, o_orderstatus AS drg_source_value, o_orderpriority AS cdm_source FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'",
)
def pf_cost(spark, d):
    return ev.select_costs(ad.costs(spark, d), ["F", "P"], "1-URGENT", {"URGENT": "1-URGENT"})


@query(
    "pf_diag_type",
    with_ctes("SELECT condition_status_source_value, count(*) AS n FROM condition WHERE condition_status_source_value IN ('DP', 'DR') GROUP BY 1", "condition"),
)
def pf_diag_type(spark, d):
    rows = ev.filter_status(ad.conditions(spark, d), ["DP", "DR"])
    return rows.groupBy("condition_status_source_value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pf_icd_prefix_list",
    with_ctes(
        """SELECT person_id, condition_occurrence_id, condition_source_value FROM condition
        WHERE substr(condition_source_value, 1, 1) IN ('L', 'E1', 'E11', 'M0723') OR substr(condition_source_value, 1, 3) IN ('L', 'E1', 'E11', 'M0723')
           OR substr(condition_source_value, 1, 4) IN ('L', 'E1', 'E11', 'M0723') OR substr(condition_source_value, 1, 5) IN ('L', 'E1', 'E11', 'M0723')""",
        "condition",
    ),
)
def pf_icd_prefix_list(spark, d):
    rows = ev.select_conditions(ad.conditions(spark, d), ["L", "E1", "E11", "M0723"])
    return rows.select("person_id", "condition_occurrence_id", "condition_source_value")


PREFIX_MATCH = "({c} = substr({v}, 1, 1) OR {c} = substr({v}, 1, 3) OR {c} = substr({v}, 1, 4) OR {c} = substr({v}, 1, 5) OR {c} = substr({v}, 1, 6) OR {c} = substr({v}, 1, 7))"


@query(
    "conditions_full",
    with_ctes(
        f"""SELECT c.person_id, c.visit_occurrence_id, condition_occurrence_id, {DAY.format('condition_start_datetime')} AS condition_start_date,
          condition_source_value, condition_status_source_value, cdm_source, visit_occurrence_source_value, care_site_name, task_id
        FROM condition c JOIN condition_code k ON {PREFIX_MATCH.format(c='k.code', v='condition_source_value')}
        LEFT JOIN visit v ON v.visit_occurrence_id = c.visit_occurrence_id LEFT JOIN care_site s ON s.care_site_id = v.care_site_id
        WHERE cdm_source = 'O' AND condition_status_source_value = 'DP'""",
        "condition",
        "condition_code",
        "visit",
        "care_site",
    ),
)
def conditions_full(spark, d):
    rows = ev.get_conditions(
        ad.conditions(spark, d), ad.visits(spark, d), ad.care_sites(spark, d), ad.condition_codes(spark, d), "CLAIMS", ad.SOURCES, "DP",
        dictionary=ad.code_dictionary(spark, d),
    )
    return rows.withColumn("condition_start_date", day("condition_start_date"))


@query("pf_array_contains", with_ctes("SELECT person_id, CAST(note_date AS VARCHAR) AS note_date FROM note WHERE list_contains(note_class_concept_id, 2)", "note"))
def pf_array_contains(spark, d):
    return ev.select_notes(ad.notes(spark, d), 2).select("person_id", day("note_date").alias("note_date"))


@query(
    "pf_array_overlap",
    with_ctes("SELECT person_id, CAST(note_date AS VARCHAR) AS note_date FROM note WHERE list_has_any(note_class_concept_id, [3, 104, 999])", "note"),
)
def pf_array_overlap(spark, d):
    return ev.select_notes(ad.notes(spark, d), [3, 104, 999]).select("person_id", day("note_date").alias("note_date"))


@query(
    "pf_imaging",
    with_ctes(
        "SELECT person_id, modality_concept_id, CAST(CAST(series_datetime AS DATE) AS VARCHAR) AS series_date FROM imaging WHERE modality_concept_id IN (1, 3)", "imaging"
    ),
)
def pf_imaging(spark, d):
    rows = ev.select_imaging(ad.imaging(spark, d), [1, 3], "DICOM")
    return rows.select("person_id", "modality_concept_id", day("series_date").alias("series_date"))


@query(
    "pf_drugs_code",
    with_ctes(
        """SELECT person_id, CAST(drug_exposure_start_date AS VARCHAR) AS start_date, drug_class_concept_id, concept_code, concept_name FROM drug
        JOIN concept ON drug_class_concept_id = concept_id WHERE l_linestatus = 'O' AND vocabulary_id = 'ATC' AND concept_code IN ('Brand#2', 'Brand#9')""",
        "drug",
        "concept",
    ),
)
def pf_drugs_code(spark, d):
    rows = ev.select_drugs(ad.drug_exposures(spark, d, "O"), ad.concepts(spark, d), ["Brand#2", "Brand#9"])
    return rows.select("person_id", day("drug_exposure_start_date").alias("start_date"), "drug_class_concept_id", "concept_code", "concept_name")


@query(
    "pf_drugs_name",
    with_ctes(
        """SELECT person_id, CAST(drug_exposure_start_date AS VARCHAR) AS start_date, drug_class_concept_id, concept_name FROM drug
        JOIN concept ON drug_class_concept_id = concept_id WHERE l_linestatus = 'F' AND vocabulary_id = 'ATC' AND split_part(concept_name, ';', 1) IN ('small', 'red')""",
        "drug",
        "concept",
    ),
)
def pf_drugs_name(spark, d):
    rows = ev.select_drugs(ad.drug_exposures(spark, d, "F"), ad.concepts(spark, d), ["Smàll", "RED"], "name")
    return rows.select("person_id", day("drug_exposure_start_date").alias("start_date"), "drug_class_concept_id", "concept_name")


@query(
    "pf_note_eligible",
    with_ctes(
        "SELECT note_id, person_id FROM note WHERE note_text IS NOT NULL AND row_status_source_value = 'Actif' AND list_contains(note_class_source_value, 'fr') AND length(note_text) > 30",
        "note",
    ),
)
def pf_note_eligible(spark, d):
    return ev.eligible_notes(ad.notes(spark, d), note_class="fr").select("note_id", "person_id")


# ---------------------------------------------------------------- joins


@query(
    "j_broadcast_codes",
    with_ctes("SELECT procedure_occurrence_id, procedure_source_value, task_id FROM procedure_ JOIN procedure_code ON code = procedure_source_value", "procedure_", "procedure_code"),
)
def j_broadcast_codes(spark, d):
    rows = cd.match_codes(ad.procedures(spark, d), ad.procedure_codes(spark, d), "procedure_source_value")
    return rows.select("procedure_occurrence_id", "procedure_source_value", "task_id")


@query(
    "j_prefix_codes",
    with_ctes(
        f"SELECT condition_occurrence_id, condition_source_value, task_id FROM condition JOIN condition_code k ON {PREFIX_MATCH.format(c='k.code', v='condition_source_value')}",
        "condition",
        "condition_code",
    ),
)
def j_prefix_codes(spark, d):
    rows = cd.match_prefix_codes(
        ad.conditions(spark, d), ad.condition_codes(spark, d), "condition_source_value", dictionary=ad.code_dictionary(spark, d)
    )
    return rows.select("condition_occurrence_id", "condition_source_value", "task_id")


@query(
    "j_left_enrich",
    with_ctes(
        """SELECT condition_occurrence_id, visit_source_value, care_site_name, hospital_group FROM condition c LEFT JOIN visit v USING (visit_occurrence_id)
        LEFT JOIN care_site s ON s.care_site_id = v.care_site_id LEFT JOIN hospital h ON h.care_site_id = v.care_site_id""",
        "condition",
        "visit",
        "care_site",
        "hospital",
    ),
)
def j_left_enrich(spark, d):
    visits = ad.visits(spark, d).select("visit_occurrence_id", "visit_source_value", "care_site_id")
    sites = ad.care_sites(spark, d).join(ad.hospital_groups(spark, d), "care_site_id", "left")
    rows = ad.conditions(spark, d).join(visits, "visit_occurrence_id", "left").join(sites, "care_site_id", "left")
    return rows.select("condition_occurrence_id", "visit_source_value", "care_site_name", "hospital_group")


@query(
    "j_visit_intersect",
    with_ctes(
        """SELECT visit_occurrence_id FROM condition WHERE condition_status_source_value = 'DP' AND substr(condition_source_value, 1, 1) = 'L'
        INTERSECT SELECT visit_occurrence_id FROM condition WHERE condition_status_source_value = 'DR' AND substr(condition_source_value, 1, 1) = 'M'""",
        "condition",
    ),
)
def j_visit_intersect(spark, d):
    rows = ad.conditions(spark, d)
    main = ev.select_conditions(ev.filter_status(rows, "DP"), "L").select("visit_occurrence_id")
    related = ev.select_conditions(ev.filter_status(rows, "DR"), "M").select("visit_occurrence_id")
    return main.intersect(related)


@query(
    "j_semi_persons",
    with_ctes("SELECT visit_occurrence_id, person_id FROM visit WHERE person_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", "visit"),
)
def j_semi_persons(spark, d):
    persons = ad.table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("person_id"))
    return cd.filter_persons(ad.visits(spark, d), persons).select("visit_occurrence_id", "person_id")


@query(
    "j_anti_persons",
    with_ctes("SELECT visit_occurrence_id, person_id FROM visit WHERE person_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)", "visit"),
)
def j_anti_persons(spark, d):
    persons = ad.table(spark, d, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("person_id"))
    return cd.filter_persons(ad.visits(spark, d), persons, "leftanti").select("visit_occurrence_id", "person_id")


@query(
    "j_explode_codes",
    with_ctes(
        """SELECT DISTINCT person_id, CAST(note_date AS VARCHAR) AS note_date, array_to_string(note_class_concept_id, '|') AS classes, n_regionkey AS task_id
        FROM (SELECT *, unnest(note_class_concept_id) AS one FROM note) JOIN nation ON one = n_nationkey + 95 OR one = n_nationkey""",
        "note",
    ),
)
def j_explode_codes(spark, d):
    nation = ad.table(spark, d, "nation")
    concepts = nation.select(F.explode(F.array(F.col("n_nationkey") + 95, F.col("n_nationkey")).cast("array<bigint>")).alias("concept_id"), F.col("n_regionkey").alias("task_id"))
    rows = ev.select_notes(ad.notes(spark, d), concepts)
    return rows.select("person_id", day("note_date").alias("note_date"), F.array_join("note_class_concept_id", "|").alias("classes"), "task_id").distinct()


@query(
    "j_concept_chain",
    with_ctes(
        """SELECT person_id, drug_class_concept_id, label FROM drug JOIN (SELECT concept_id, min(label) AS label FROM concept
          JOIN (SELECT DISTINCT p_brand AS code, p_type AS label FROM part WHERE p_size > 45) w ON w.code = concept_code WHERE vocabulary_id = 'ATC' GROUP BY 1) k
        ON k.concept_id = drug_class_concept_id WHERE l_linestatus = 'O'""",
        "drug",
        "concept",
    ),
)
def j_concept_chain(spark, d):
    wanted = ad.table(spark, d, "part").filter("p_size > 45").select(F.col("p_brand").alias("ATC"), F.col("p_type").alias("label"))
    rows = ev.select_drugs(ad.drug_exposures(spark, d, "O"), ad.concepts(spark, d), wanted)
    return rows.select("person_id", "drug_class_concept_id", "label")


@query("a_dedupe_key", with_ctes(
    """SELECT visit_occurrence_id, condition_source_value, condition_status_source_value FROM (SELECT *, row_number() OVER (PARTITION BY visit_occurrence_id
      ORDER BY condition_source_value, condition_status_source_value) AS rn FROM condition) WHERE rn = 1""", "condition"))  # fmt: skip
def a_dedupe_key(spark, d):
    rows = ad.conditions(spark, d).select("visit_occurrence_id", "condition_source_value", "condition_status_source_value")
    return gr.dedupe_on(rows, ["visit_occurrence_id"], ["condition_source_value", "condition_status_source_value"])


@query(
    "a_counts_desc",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS n_l_partkey FROM lineitem GROUP BY 1, 2",
)
def a_counts_desc(spark, d):
    return gr.value_counts(ad.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", distinct="l_partkey")


@query(
    "a_missing_tasks",
    with_ctes("SELECT task_id FROM task WHERE task_id NOT IN (SELECT task_id FROM procedure_ JOIN procedure_code ON code = procedure_source_value)", "task", "procedure_", "procedure_code"),
)
def a_missing_tasks(spark, d):
    found = cd.match_codes(ad.procedures(spark, d), ad.procedure_codes(spark, d), "procedure_source_value")
    return cd.unmatched(ad.tasks(spark, d), found, "task_id")


# ---------------------------------------------------------------- set operations


@query(
    "so_union_distinct",
    with_ctes(
        """SELECT person_id, CAST(CAST(series_datetime AS DATE) AS VARCHAR) AS series_date FROM imaging WHERE modality_concept_id IN (1, 2)
        UNION SELECT person_id, CAST(CAST(series_datetime AS DATE) AS VARCHAR) FROM imaging WHERE modality_source_concept_id IN (1, 2)""",
        "imaging",
    ),
)
def so_union_distinct(spark, d):
    parts = [ev.select_imaging(ad.imaging(spark, d), [1, 2], v).select("person_id", day("series_date").alias("series_date")) for v in ("DICOM", "SOURCE")]
    return parts[0].unionByName(parts[1]).distinct()


@query(
    "so_union_tagged",
    with_ctes(
        """SELECT lf, count(*) AS n, count(DISTINCT person_id) AS n_persons FROM (SELECT 'lf_icd10' AS lf, person_id FROM condition WHERE condition_status_source_value = 'DP'
        UNION ALL SELECT 'lf_ccam', person_id FROM procedure_ UNION ALL SELECT 'lf_imaging_md', person_id FROM imaging) GROUP BY 1""",
        "condition",
        "procedure_",
        "imaging",
    ),
)
def so_union_tagged(spark, d):
    from clinspark.plans.knowledge import tag_events

    def event(df, date):
        return df.select("person_id", F.to_date(date).alias("event_date"), F.lit(1).alias("task_id"))

    tagged = tag_events(
        {
            "lf_icd10": event(ev.filter_status(ad.conditions(spark, d), "DP"), "condition_start_datetime"),
            "lf_ccam": event(ad.procedures(spark, d), "procedure_datetime"),
            "lf_imaging_md": event(ad.imaging(spark, d), "series_datetime"),
        }
    )
    return tagged.groupBy("lf").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person_id").alias("n_persons"))


@query("so_intersect", "SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def so_intersect(spark, d):
    english = ad.table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return ad.table(spark, d, "labels").select("doc_id").intersect(english)


# ---------------------------------------------------------------- scalar functions


@query(
    "sc_normalize_name",
    "SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(lower(p_name || ' (A-B), x.y/' || p_brand), ' ', '_'), ',', ''), '-', '_'), '.', '_'), '(', ''), ')', ''), '/', '_'), '#', '#') AS name FROM part",
)
def sc_normalize_name(spark, d):
    name = F.concat("p_name", F.lit(" (A-B), x.y/"), "p_brand")
    return ad.table(spark, d, "part").select("p_partkey", tx.normalize_name(name).alias("name"))


@query(
    "sc_fold_accents",
    r"SELECT doc_id, md5(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', '', 'g')) AS folded FROM documents",
)
def sc_fold_accents(spark, d):
    return ad.table(spark, d, "documents").select("doc_id", F.md5(tx.fold_accents("text")).alias("folded"))


@query("lf_norm_text", f"SELECT doc_id, md5(lower(translate(text, '{ad._FROM}', '{ad._TO}'))) AS norm, length(text) AS n FROM documents")
def lf_norm_text(spark, d):
    norm = tx.norm_text("text")
    return ad.table(spark, d, "documents").select("doc_id", F.md5(norm).alias("norm"), F.length(norm).cast("bigint").alias("n"))


@query("sc_first_part", "SELECT p_partkey, split_part(replace(p_name, ' ', ';'), ';', 1) AS first_name FROM part")
def sc_first_part(spark, d):
    return ad.concepts(spark, d).select(F.col("concept_id").alias("p_partkey"), tx.first_part("concept_name").alias("first_name"))


@query(
    "sc_resolve_date",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE)
        WHEN o_orderkey % 3 = 1 THEN make_date(year(o_orderdate), month(o_orderdate), 15)
        WHEN CAST(o_orderdate AS DATE) > make_date(year(o_orderdate), 6, 30) THEN make_date(year(o_orderdate) - 1, month(o_orderdate), day(o_orderdate))
        ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS resolved FROM orders""",
)
def sc_resolve_date(spark, d):
    orders = ad.table(spark, d, "orders")
    months = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
    name = F.get(F.array(*[F.lit(m) for m in months]), F.month("o_orderdate") - 1)
    kind = F.col("o_orderkey") % 3
    mention = (
        F.when(kind == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(kind == 1, F.concat(name, F.lit(" "), F.year("o_orderdate").cast("string")))
        .otherwise(F.date_format("o_orderdate", "dd/MM"))
    )
    note_date = F.make_date(F.year("o_orderdate"), F.lit(6), F.lit(30))
    return orders.select("o_orderkey", tx.resolve_date(mention, note_date).cast("string").alias("resolved"))

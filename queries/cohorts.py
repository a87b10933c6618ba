"""Queries over stays, patients, windows and knowledge."""

from pyspark.sql import functions as F

from clinspark.operators import groups as gr
from clinspark.operators.codes import code_frame
from clinspark.plans import cohort as co, knowledge as kn
from clinspark.reference_values import INCOMPLETE_STAY, NO_LOCALISATION
from queries import adapters as ad
from queries.adapters import with_ctes
from queries.claims import PREFIX_MATCH, day
from queries.registry import query

HITS = f"""SELECT visit_occurrence_id, list, condition_status_source_value AS status FROM condition JOIN step_list k
  ON list <> 'list_4a' AND {PREFIX_MATCH.format(c='k.code', v='condition_source_value')} WHERE cdm_source = 'O'
  UNION ALL SELECT visit_occurrence_id, list, NULL FROM procedure_ JOIN step_list k ON list = 'list_4a' AND k.code = procedure_source_value WHERE cdm_source = 'O'"""
FLAGS = """SELECT visit_occurrence_id, coalesce(bool_or(list = 'list_1' AND status = 'DP'), false) AS step_1a,
  coalesce(bool_or(list = 'list_1' AND status = 'DR'), false) AND coalesce(bool_or(list = 'list_1_radiotherapy' AND status = 'DP'), false) AS step_1b,
  coalesce(bool_or(list = 'list_2' AND status = 'DR'), false) AS step_2, coalesce(bool_or(list = 'list_3' AND status = 'DAS'), false) AS step_3,
  coalesce(bool_or(list = 'list_4d' AND status = 'DAS'), false) AND coalesce(bool_or(list = 'list_4a'), false) AS step_4 FROM hits GROUP BY 1"""
STEPS = "SELECT *, step_1a OR step_1b AS step_1, step_1a OR step_1b OR step_2 OR step_3 OR step_4 AS stay_cancer FROM flags WHERE step_1a OR step_1b OR step_2 OR step_3 OR step_4"
SCORES = f"""SELECT visit_occurrence_id, organ, CAST(sum(CASE condition_status_source_value WHEN 'DP' THEN 3 WHEN 'DR' THEN 2 ELSE 1 END) AS BIGINT) AS weight_code, min(system) AS system
  FROM condition JOIN localisation k ON {PREFIX_MATCH.format(c='k.code', v='condition_source_value')} WHERE cdm_source = 'O' GROUP BY 1, 2"""
HEAVIEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_occurrence_id ORDER BY weight_code DESC, organ) AS rn FROM scores) WHERE rn = 1"
STAYS = f"""SELECT s.visit_occurrence_id, person_id, visit_start_datetime, visit_end_datetime, visit_source_value, v.care_site_id, care_site_name, step_1a, step_1b, step_1, step_2, step_3, step_4, stay_cancer,
  coalesce(h.system, '{NO_LOCALISATION}') AS system, coalesce(h.organ, '{NO_LOCALISATION}') AS organ, weight_code
  FROM steps s LEFT JOIN visit v ON v.visit_occurrence_id = s.visit_occurrence_id LEFT JOIN heaviest h ON h.visit_occurrence_id = s.visit_occurrence_id
  LEFT JOIN care_site c ON c.care_site_id = v.care_site_id"""
STAY_CTES = {"hits": HITS, "flags": FLAGS, "steps": STEPS, "scores": SCORES, "heaviest": HEAVIEST, "stay": STAYS}
STAY_NEEDS = ("condition", "procedure_", "step_list", "localisation", "visit", "care_site")


def stays(spark, d, **options):
    return co.cancer_stays(
        ad.conditions(spark, d), ad.procedures(spark, d), ad.visits(spark, d), ad.care_sites(spark, d), ad.step_lists(spark, d),
        ad.localisations(spark, d), claim_source="CLAIMS", sources=ad.SOURCES, dictionary=ad.code_dictionary(spark, d), **options,
    )


@query(
    "j_outer_flags",
    with_ctes("SELECT visit_occurrence_id, step_1a, step_1b, step_1, step_2, step_3, step_4, stay_cancer FROM steps", *STAY_NEEDS[:3], hits=HITS, flags=FLAGS, steps=STEPS),
)
def j_outer_flags(spark, d):
    claims = ad.conditions(spark, d).filter("cdm_source = 'O'"), ad.procedures(spark, d).filter("cdm_source = 'O'")
    return co.stay_steps(co.list_hits(*claims, ad.step_lists(spark, d), ad.code_dictionary(spark, d)))


@query("a_visit_localisation", with_ctes("SELECT * FROM scores", "condition", "localisation", scores=SCORES))
def a_visit_localisation(spark, d):
    return co.score_localisation(ad.conditions(spark, d).filter("cdm_source = 'O'"), ad.localisations(spark, d))


@query(
    "cp_localisation",
    with_ctes("SELECT visit_occurrence_id, system, organ, weight_code FROM stay", *STAY_NEEDS, **STAY_CTES),
)
def cp_localisation(spark, d):
    claims = ad.conditions(spark, d).filter("cdm_source = 'O'"), ad.procedures(spark, d).filter("cdm_source = 'O'")
    flagged = co.stay_steps(co.list_hits(*claims, ad.step_lists(spark, d), ad.code_dictionary(spark, d))).select("visit_occurrence_id")
    return co.add_localisation(flagged, claims[0], ad.localisations(spark, d))


@query(
    "cp_cancer_stays",
    with_ctes(
        """SELECT visit_occurrence_id, person_id, CAST(CAST(visit_start_datetime AS DATE) AS VARCHAR) AS visit_start, CAST(CAST(visit_end_datetime AS DATE) AS VARCHAR) AS visit_end,
        visit_source_value, care_site_name, step_1, step_2, step_3, step_4, stay_cancer, system, organ, weight_code FROM stay
        WHERE visit_start_datetime >= '1994-01-01' AND visit_start_datetime <= '1999-12-31'""",
        *STAY_NEEDS,
        **STAY_CTES,
    ),
)
def cp_cancer_stays(spark, d):
    rows = stays(spark, d, after_date="1994-01-01", before_date="1999-12-31")
    return rows.select(
        "visit_occurrence_id", "person_id", day("visit_start_datetime").alias("visit_start"), day("visit_end_datetime").alias("visit_end"),
        "visit_source_value", "care_site_name", "step_1", "step_2", "step_3", "step_4", "stay_cancer", "system", "organ", "weight_code",
    )


@query(
    "pf_date_bounds",
    with_ctes("SELECT visit_occurrence_id FROM visit WHERE visit_start_datetime >= '1995-03-01' AND visit_start_datetime <= '1996-02-29'", "visit"),
)
def pf_date_bounds(spark, d):
    return co.date_bounds(ad.visits(spark, d), "visit_start_datetime", "1995-03-01", "1996-02-29").select("visit_occurrence_id")


WEIGHTED = f"""SELECT *, count(*) OVER (PARTITION BY person_id, visit_source_value, organ) AS weight_type_stay,
  CASE WHEN visit_source_value = '{INCOMPLETE_STAY}' THEN weight_code / count(*) OVER (PARTITION BY person_id, visit_source_value, organ) ELSE weight_code END AS weight FROM stay"""
LOCALISED = """SELECT *, sum(weight) OVER (PARTITION BY person_id, organ) AS weight_localisation, min(visit_start_datetime) OVER (PARTITION BY person_id, organ) AS first_date,
  count(*) OVER (PARTITION BY person_id, organ) AS n_occurrences_localisation FROM weighted"""


@query(
    "w_stay_weight",
    with_ctes("SELECT visit_occurrence_id, weight_type_stay, round(CAST(weight AS DOUBLE), 6) AS weight FROM weighted", *STAY_NEEDS, **STAY_CTES, weighted=WEIGHTED),
)
def w_stay_weight(spark, d):
    rows = gr.with_group_totals(stays(spark, d), ["person_id", "visit_source_value", "organ"], weight_type_stay=F.count(F.lit(1)))
    share = F.when(F.col("visit_source_value") == INCOMPLETE_STAY, F.col("weight_code") / F.col("weight_type_stay")).otherwise(
        F.col("weight_code").cast("double")
    )
    return rows.select("visit_occurrence_id", "weight_type_stay", F.round(share, 6).alias("weight"))


@query(
    "w_localisation",
    with_ctes(
        """SELECT visit_occurrence_id, CAST(sum(weight_code) OVER (PARTITION BY person_id, organ) AS BIGINT) AS weight_localisation,
        CAST(CAST(min(visit_start_datetime) OVER (PARTITION BY person_id, organ) AS DATE) AS VARCHAR) AS first_date, count(*) OVER (PARTITION BY person_id, organ) AS n_occurrences FROM stay""",
        *STAY_NEEDS,
        **STAY_CTES,
    ),
)
def w_localisation(spark, d):
    rows = gr.with_group_totals(
        stays(spark, d), ["person_id", "organ"],
        weight_localisation=F.sum("weight_code"), first=F.min("visit_start_datetime"), n_occurrences=F.count(F.lit(1)),
    )
    return rows.select("visit_occurrence_id", "weight_localisation", day("first").alias("first_date"), "n_occurrences")


PERSON_SETS = """SELECT person_id, count(DISTINCT organ) AS n_distinct_organ, count(DISTINCT system) AS n_distinct_system,
  string_agg(DISTINCT organ, '|' ORDER BY organ) AS all_organs, string_agg(DISTINCT system, '|' ORDER BY system) AS all_systems FROM stay GROUP BY 1"""
COHORT = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY round(weight_localisation, 9) DESC NULLS LAST, first_date, first_visit, organ, visit_start_datetime, visit_occurrence_id) AS rn
  FROM (SELECT *, min(CASE WHEN visit_start_datetime = first_date THEN visit_occurrence_id END) OVER (PARTITION BY person_id, organ) AS first_visit FROM localised)) WHERE rn = 1"""


@query(
    "a_person_sets",
    with_ctes("SELECT * FROM sets", *STAY_NEEDS, **STAY_CTES, sets=PERSON_SETS),
)
def a_person_sets(spark, d):
    cohort = co.patient_cohort(stays(spark, d))
    return cohort.select(
        "person_id", "n_distinct_organ", "n_distinct_system", F.array_join("all_organs", "|").alias("all_organs"),
        F.array_join("all_systems", "|").alias("all_systems"),
    )


@query(
    "cp_cohort",
    with_ctes(
        """SELECT c.person_id, system, organ, CAST(CAST(first_date AS DATE) AS VARCHAR) AS localisation_first_date, n_distinct_organ, n_distinct_system, all_organs, care_site_id, care_site_name
        FROM picked c JOIN sets USING (person_id) WHERE first_date >= '1993-01-01' AND organ NOT IN ('Absence de localisation primitive')""",
        *STAY_NEEDS,
        **STAY_CTES,
        weighted=WEIGHTED,
        localised=LOCALISED,
        picked=COHORT,
        sets=PERSON_SETS,
    ),
)
def cp_cohort(spark, d):
    cohort = co.patient_cohort(stays(spark, d), first_date_after="1993-01-01").filter(F.col("organ") != NO_LOCALISATION)
    return cohort.select(
        "person_id", "system", "organ", day("localisation_first_date").alias("localisation_first_date"), "n_distinct_organ", "n_distinct_system",
        F.array_join("all_organs", "|").alias("all_organs"), "care_site_id", "care_site_name",
    )


@query(
    "pf_cohort_membership",
    with_ctes(
        """SELECT c.person_id, organ FROM picked c WHERE organ LIKE 'EC%' AND person_id IN (SELECT person_id FROM stay WHERE organ IN ('EC_Brand#11', 'EC_Brand#5', 'EC_Brand#7', 'EC_Brand#2'))
        AND organ IN ('EC_Brand#11', 'EC_Brand#5', 'EC_Brand#7')""",
        *STAY_NEEDS,
        **STAY_CTES,
        weighted=WEIGHTED,
        localised=LOCALISED,
        picked=COHORT,
    ),
)
def pf_cohort_membership(spark, d):
    main = ["EC_Brand#11", "EC_Brand#5", "EC_Brand#7"]
    return co.patient_cohort(stays(spark, d), main_localisations=main, localisations=[*main, "EC_Brand#2"]).select("person_id", "organ")


@query(
    "w_keep_first",
    with_ctes(
        "SELECT person_id, visit_occurrence_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit_start_datetime, visit_occurrence_id) AS rn FROM visit) WHERE rn = 1", "visit"
    ),
)
def w_keep_first(spark, d):
    rows = gr.keep_one(ad.visits(spark, d), sort_column="visit_start_datetime", tie_break=["visit_occurrence_id"])
    return rows.select("person_id", "visit_occurrence_id")


@query(
    "w_keep_last_n",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3",
)
def w_keep_last_n(spark, d):
    turns = ad.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return gr.keep_n(turns, sort_column="turn", how="last", partition_by=["conv_id"], n=3)


@query(
    "w_rolling_mean",
    """SELECT event_id, CASE WHEN n >= 5 THEN round(m + 1e-9, 6) END AS rolling_mean FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
)
def w_rolling_mean(spark, d):
    events = ad.table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    rows = gr.rolling_mean(events, "value", ["user_id"], ["ts", "event_id"], 5)
    return rows.select("event_id", F.round(F.col("rolling_mean") + 1e-9, 6).alias("rolling_mean"))


@query(
    "w_rolling_mean_partial",
    """SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS rolling_mean FROM events""",
)
def w_rolling_mean_partial(spark, d):
    events = ad.table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    rows = gr.rolling_mean(events, "value", ["event_type"], ["ts", "event_id"], 100, partial=True, block=500)
    return rows.select("event_id", F.round(F.col("rolling_mean") + 1e-9, 6).alias("rolling_mean"))


@query(
    "j_cohort_notes",
    with_ctes(
        """SELECT note_id, n.person_id, gn.hospital_group, p.organ, p.system, p.first_date FROM note n JOIN visit v ON v.visit_occurrence_id = n.visit_occurrence_id JOIN hospital gn ON gn.care_site_id = v.care_site_id
        JOIN (SELECT person_id, organ, system, CAST(CAST(first_date AS DATE) AS VARCHAR) AS first_date, h.hospital_group FROM picked JOIN hospital h USING (care_site_id)) p ON p.person_id = n.person_id
        WHERE row_status_source_value = 'Actif' AND list_contains(note_class_source_value, 'en') AND length(note_text) > 30 AND p.hospital_group = gn.hospital_group""",
        "note",
        "hospital",
        *STAY_NEEDS,
        **STAY_CTES,
        weighted=WEIGHTED,
        localised=LOCALISED,
        picked=COHORT,
    ),
)
def j_cohort_notes(spark, d):
    cohort = co.patient_cohort(stays(spark, d))
    rows = co.cohort_notes(cohort, ad.hospital_groups(spark, d), ad.notes(spark, d), ad.visits(spark, d), note_class="en")
    return rows.select("note_id", "person_id", "hospital_group", "organ", "system", day("localisation_first_date").alias("first_date"))


# ---------------------------------------------------------------- knowledge


@query(
    "a_collect_events",
    with_ctes(
        """SELECT person_id, lf, string_agg(CAST(event_date AS VARCHAR) || ':' || class, '|' ORDER BY event_date, class) AS events
        FROM (SELECT DISTINCT * FROM knowledge) GROUP BY 1, 2""",
        "knowledge",
    ),
)
def a_collect_events(spark, d):
    rows = kn.collect_events(kn.clean_dates(ad.knowledge_rows(spark, d)))
    text = F.transform("events", lambda e: F.concat(e["value"].cast("string"), F.lit(":"), e["class"]))
    return rows.select("person_id", "lf", F.array_join(text, "|").alias("events"))


@query(
    "a_pivot_lf",
    with_ctes(
        """SELECT person_id, CAST(nullif(count(*) FILTER (lf = 'lf_ccam'), 0) AS INTEGER) AS n_ccam, CAST(nullif(count(*) FILTER (lf = 'lf_imaging_md'), 0) AS INTEGER) AS n_imaging,
        CAST(nullif(count(*) FILTER (lf = 'lf_drugs'), 0) AS INTEGER) AS n_drugs, string_agg(CAST(event_date AS VARCHAR) || ':' || class, '|' ORDER BY event_date, class) FILTER (lf = 'lf_ccam') AS lf_ccam
        FROM (SELECT DISTINCT * FROM knowledge) GROUP BY 1""",
        "knowledge",
    ),
)
def a_pivot_lf(spark, d):
    wide = kn.external_knowledge(ad.knowledge_rows(spark, d))
    text = F.transform("lf_ccam", lambda e: F.concat(e["value"].cast("string"), F.lit(":"), e["class"]))

    def n(lf):
        return F.when(F.col(lf).isNotNull(), F.size(lf))

    return wide.select("person_id", n("lf_ccam").alias("n_ccam"), n("lf_imaging_md").alias("n_imaging"), n("lf_drugs").alias("n_drugs"), F.array_join(text, "|").alias("lf_ccam"))


KNOWLEDGE = f"""SELECT DISTINCT e.person_id, lf, CAST(event_date AS VARCHAR) AS event_date, t.task AS class FROM (
  SELECT person_id, 'lf_ccam' AS lf, CAST(procedure_datetime AS DATE) AS event_date, task_id FROM procedure_ JOIN procedure_code k ON k.code = procedure_source_value WHERE cdm_source = 'O'
  UNION ALL SELECT person_id, 'lf_icd10', CAST(condition_start_datetime AS DATE), task_id FROM condition JOIN condition_code k ON {PREFIX_MATCH.format(c='k.code', v='condition_source_value')} WHERE cdm_source = 'O'
  UNION ALL SELECT person_id, 'lf_note_md', note_date, n_nationkey FROM (SELECT *, unnest(note_class_concept_id) AS one FROM note) JOIN nation ON one = n_nationkey + 95
  UNION ALL SELECT person_id, 'lf_imaging_md', CAST(series_datetime AS DATE), n_nationkey + 1 FROM imaging JOIN nation ON modality_concept_id = n_nationkey
  UNION ALL SELECT person_id, 'lf_imaging_md', CAST(series_datetime AS DATE), n_nationkey + 1 FROM imaging JOIN nation ON modality_source_concept_id = n_nationkey
  UNION ALL SELECT person_id, 'lf_drugs', drug_exposure_start_date, task_id FROM drug JOIN (
     SELECT concept_id, min(p_size) - 4 AS task_id FROM concept JOIN listed ON p_brand = concept_code WHERE vocabulary_id = 'ATC' GROUP BY 1
     UNION SELECT concept_id, min(p_size) - 4 FROM concept JOIN listed ON split_part(p_name, ' ', 1) = split_part(concept_name, ';', 1) WHERE vocabulary_id = 'ATC' GROUP BY 1) ON concept_id = drug_class_concept_id
  ) e JOIN task t ON t.task_id = e.task_id WHERE e.person_id IN (SELECT person_id FROM note)"""


def _knowledge(spark, d):
    parts = ad.table(spark, d, "part")
    listed = parts.filter("p_size between 5 and 8 and p_type = 'LARGE'")
    drugs = listed.select(
        F.col("p_brand").alias("ATC"),
        F.element_at(F.split("p_name", " "), 1).alias("normalized_atc"),
        (F.col("p_size") - 5 + 1000).cast("bigint").alias("SNOMED CT - SCTID"),
    )
    nation = ad.table(spark, d, "nation")
    tasks = ad.tasks(spark, d)
    rows = kn.drug_events(ad.drug_exposures(spark, d, "O"), ad.drug_exposures(spark, d, "F"), ad.concepts(spark, d), drugs, tasks)
    note_concepts = nation.select((F.col("n_nationkey") + 95).cast("bigint").alias("concept_id"), F.col("n_nationkey").alias("task_id"))
    imaging_concepts = nation.select(F.col("n_nationkey").cast("bigint").alias("concept_id"), (F.col("n_nationkey") + 1).alias("task_id"))
    return kn.knowledge_events(
        ad.notes(spark, d).select("person_id"), tasks, ad.procedures(spark, d), ad.conditions(spark, d), ad.notes(spark, d), ad.imaging(spark, d),
        rows, ad.procedure_codes(spark, d), ad.condition_codes(spark, d), note_concepts, imaging_concepts, "CLAIMS", ad.SOURCES,
        ad.code_dictionary(spark, d),
    )


KNOWLEDGE_CTES = {
    "listed": "SELECT * FROM part WHERE p_size BETWEEN 5 AND 8 AND p_type = 'LARGE'",
    "known": KNOWLEDGE,
}
KNOWLEDGE_NEEDS = ("procedure_", "procedure_code", "condition", "condition_code", "note", "imaging", "drug", "concept", "task")


@query("cp_knowledge_events", with_ctes("SELECT * FROM known", *KNOWLEDGE_NEEDS, **KNOWLEDGE_CTES))
def cp_knowledge_events(spark, d):
    return _knowledge(spark, d).withColumn("event_date", F.col("event_date").cast("string"))


@query(
    "cp_external_knowledge",
    with_ctes(
        """SELECT person_id, """
        + ", ".join(
            f"string_agg(event_date || ':' || class, '|' ORDER BY event_date, class) FILTER (lf = '{lf}') AS {lf}"
            for lf in ("lf_ccam", "lf_icd10", "lf_note_md", "lf_imaging_md", "lf_drugs")
        )
        + " FROM known GROUP BY 1",
        *KNOWLEDGE_NEEDS,
        **KNOWLEDGE_CTES,
    ),
)
def cp_external_knowledge(spark, d):
    wide = kn.external_knowledge(_knowledge(spark, d))

    def text(lf):
        return F.array_join(F.transform(lf, lambda e: F.concat(e["value"].cast("string"), F.lit(":"), e["class"])), "|").alias(lf)

    return wide.select("person_id", *[text(lf) for lf in wide.columns[1:]])

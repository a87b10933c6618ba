"""Cancer stays by claim steps, their localisation, and the patient cohort."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clinspark.operators.codes import code_dictionary, filter_source, listed_codes, match_codes, match_prefix_codes
from clinspark.operators.events import eligible_notes
from clinspark.operators.groups import keep_one, unique_by
from clinspark.reference_values import (
    INCOMPLETE_STAY,
    NO_LOCALISATION,
    OTHER_STATUS_WEIGHT,
    STATUS_ASSOCIATED,
    STATUS_MAIN,
    STATUS_RELATED,
    STATUS_WEIGHTS,
)

STEPS = (1, 2, 3, 4)
# Lists and statuses whose meetings are bits of one number: the list within eight bits, which are any status or one of the three.
LISTS = ("list_1", "list_1_radiotherapy", "list_2", "list_3", "list_4d", "list_4a", "list_5")
ACTS, COSTS = "list_4a", "list_5"  # met by procedures and costs, not by diagnoses
STATUSES = (STATUS_MAIN, STATUS_RELATED, STATUS_ASSOCIATED)


def list_hits(conditions: DataFrame, procedures: DataFrame, lists: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(visit_occurrence_id, list, status): one scan of diagnoses and one of procedures for all code lists."""
    by_prefix = lists.filter(F.col("list") != ACTS)
    coded = conditions.select("visit_occurrence_id", "condition_source_value", "condition_status_source_value")
    diagnoses = match_prefix_codes(coded, by_prefix, "condition_source_value", dictionary=dictionary).select(
        "visit_occurrence_id", "list", F.col("condition_status_source_value").alias("status")
    )
    acts = procedures.select("visit_occurrence_id", "procedure_source_value")
    acts = match_codes(acts, lists.filter(F.col("list") == ACTS), "procedure_source_value")
    return diagnoses.unionByName(acts.select("visit_occurrence_id", "list", F.lit(None).cast("string").alias("status")))


def list_bit(name: Column) -> Column:
    """Bit of a list name; an unknown name has none."""
    bit = F.lit(0).cast("bigint")
    for i, known in enumerate(LISTS):
        bit = F.when(name == known, F.lit(1 << i).cast("bigint")).otherwise(bit)
    return bit


def meeting_bits(lists: Column, status: Column) -> Column:
    """Bits of the lists that an event meets, once for any status and once for its own."""
    bits = lists
    for i, known in enumerate(STATUSES):
        bits = bits.bitwiseOR(F.when(status == known, F.call_function("shiftleft", lists, F.lit(8 * (i + 1)))).otherwise(F.lit(0).cast("bigint")))
    return bits


def steps_of_bits(met: DataFrame, steps: Sequence[int], with_costs: bool) -> DataFrame:
    """Visits with `bits`, the meetings of all their events -> those that meet any step, with a boolean per step instead."""
    known = {1, 2, 3, 4} | ({5} if with_costs else set())
    if not steps or not set(steps) <= known:
        raise ValueError(f"steps must be among {sorted(known)}")

    def hit(name: str, status: str | None) -> Column:
        bit = 1 << (LISTS.index(name) + (8 * (STATUSES.index(status) + 1) if status else 0))
        return F.col("bits").bitwiseAND(F.lit(bit).cast("bigint")) != 0

    flags = {
        "step_1a": hit("list_1", STATUS_MAIN),
        "step_1b": hit("list_1", STATUS_RELATED) & hit("list_1_radiotherapy", STATUS_MAIN),
        "step_2": hit("list_2", STATUS_RELATED),
        "step_3": hit("list_3", STATUS_ASSOCIATED),
        "step_4": hit("list_4d", STATUS_ASSOCIATED) & hit(ACTS, None),
        **({"step_5": hit(COSTS, None)} if with_costs else {}),
    }
    flagged = met.withColumns(flags).withColumn("step_1", F.col("step_1a") | F.col("step_1b")).drop("bits")
    every = [F.col(f"step_{i}") for i in sorted(known)]
    any_step = every[0]
    for flag in every[1:]:
        any_step = any_step | flag
    chosen = [F.col(f"step_{i}") for i in steps]
    cancer = F.greatest(*chosen) if len(chosen) > 1 else chosen[0]
    return flagged.filter(any_step).withColumn("stay_cancer", cancer)


def stay_steps(hits: DataFrame, steps: Sequence[int] = STEPS, costs: DataFrame | None = None) -> DataFrame:
    """One row per visit that meets any step, with a boolean per step: one union, one aggregate.

    Step 5 needs `costs`, the visits (visit_occurrence_id) whose cost code is listed.
    """
    rows = hits.select("visit_occurrence_id", meeting_bits(list_bit(F.col("list")), F.col("status")).alias("bits"))
    if costs is not None:
        rows = rows.unionByName(cost_bits(costs))
    return steps_of_bits(rows.groupBy("visit_occurrence_id").agg(F.bit_or("bits").alias("bits")), steps, costs is not None)


def cost_bits(costs: DataFrame) -> DataFrame:
    return costs.select("visit_occurrence_id", list_bit(F.lit(COSTS)).alias("bits"))


def codebook(dictionary: DataFrame, lists: DataFrame, localisations: DataFrame, level: str = "organ") -> DataFrame:
    """(full_code, lists, places): per code in use, the bits of the diagnosis lists that hold it or a leading part, and its localisations.

    One row per code, so that a diagnosis joins it once for all steps and its localisation together.
    """
    other = "system" if level == "organ" else "organ"
    nowhere = F.lit(None).cast("struct<level:string,other:string>")
    entries = lists.filter(F.col("list") != ACTS).select("code", list_bit(F.col("list")).alias("bit"), nowhere.alias("place"))
    place = F.struct(F.col(level).alias("level"), F.col(other).alias("other"))
    entries = entries.unionByName(localisations.select("code", F.lit(0).cast("bigint").alias("bit"), place.alias("place")))
    return listed_codes(dictionary, entries).groupBy("full_code").agg(F.bit_or("bit").alias("lists"), F.collect_list("place").alias("places"))


def located_steps(
    conditions: DataFrame, procedures: DataFrame, lists: DataFrame, localisations: DataFrame, steps: Sequence[int] = STEPS,
    level: str = "organ", costs: DataFrame | None = None, dictionary: DataFrame | None = None,
) -> DataFrame:
    """Visits that meet any step, with their steps and heaviest localisation, from one read of diagnoses and one of procedures.

    Rows are combined by (visit, localisation) and then by visit, each time before the shuffle: weights are summed and the bits of the
    lists joined on the way. The heaviest localisation has the largest weight, then the smallest name.
    """
    other = "system" if level == "organ" else "organ"
    known = code_dictionary(conditions, "condition_source_value") if dictionary is None else dictionary
    book = codebook(known, lists, localisations, level)
    diagnoses = conditions.select("visit_occurrence_id", "condition_source_value", "condition_status_source_value")
    diagnoses = diagnoses.join(book, F.col("condition_source_value") == F.col("full_code")).select(
        "visit_occurrence_id", meeting_bits(F.col("lists"), F.col("condition_status_source_value")).alias("bits"),
        status_weight().cast("bigint").alias("weight"), F.explode_outer("places").alias("place"),
    )
    diagnoses = diagnoses.withColumn("weight", F.when(F.col("place").isNotNull(), F.col("weight")))
    acts = procedures.select("visit_occurrence_id", "procedure_source_value")
    acts = match_codes(acts, lists.filter(F.col("list") == ACTS).select("code").distinct(), "procedure_source_value")
    unplaced = acts.select("visit_occurrence_id", list_bit(F.lit(ACTS)).alias("bits"))
    if costs is not None:
        unplaced = unplaced.unionByName(cost_bits(costs))
    rows = diagnoses.unionByName(unplaced, allowMissingColumns=True)
    placed = rows.groupBy("visit_occurrence_id", F.col("place.level").alias("level")).agg(
        F.bit_or("bits").alias("bits"), F.sum("weight").alias("weight"), F.min("place.other").alias("other")
    )
    weighed = F.when(F.col("weight").isNotNull(), F.struct((-F.col("weight")).alias("minus"), "level", "other"))
    met = placed.groupBy("visit_occurrence_id").agg(F.bit_or("bits").alias("bits"), F.min(weighed).alias("best"))
    found = steps_of_bits(met, steps, costs is not None)
    named = found.withColumns({level: F.col("best.level"), other: F.col("best.other"), "weight_code": -F.col("best.minus")}).drop("best")
    return named.fillna(NO_LOCALISATION, subset=["system", "organ"])


def date_bounds(df: DataFrame, column: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """Inclusive bounds."""
    if after:
        df = df.filter(F.col(column) >= after)
    if before:
        df = df.filter(F.col(column) <= before)
    return df


def status_weight(column: str = "condition_status_source_value") -> Column:
    weight = F.lit(OTHER_STATUS_WEIGHT)
    for status, value in STATUS_WEIGHTS.items():
        weight = F.when(F.col(column) == status, value).otherwise(weight)
    return weight


def score_localisation(conditions: DataFrame, localisations: DataFrame, level: str = "organ", dictionary: DataFrame | None = None) -> DataFrame:
    """(visit, level, weight_code, other level): summed status weights of the listed diagnoses."""
    other = "system" if level == "organ" else "organ"
    coded = conditions.select("visit_occurrence_id", "condition_source_value", "condition_status_source_value")
    matched = match_prefix_codes(coded, localisations, "condition_source_value", dictionary=dictionary)
    return (
        matched.withColumn("weight_code", status_weight())
        .groupBy("visit_occurrence_id", level)
        .agg(F.sum("weight_code").alias("weight_code"), F.min(other).alias(other))
    )


def add_localisation(stays: DataFrame, conditions: DataFrame, localisations: DataFrame, level: str = "organ") -> DataFrame:
    """Heaviest localisation of each stay; stays without one get the fixed text."""
    scored = score_localisation(conditions, localisations, level)
    heaviest = keep_one(
        scored, sort_column="weight_code", how="last", partition_by=["visit_occurrence_id"], tie_break=[level]
    ).select("visit_occurrence_id", "system", "organ", "weight_code")
    joined = stays.join(heaviest, "visit_occurrence_id", "left")
    return joined.fillna(NO_LOCALISATION, subset=["system", "organ"])


def cancer_stays(
    conditions: DataFrame,
    procedures: DataFrame,
    visits: DataFrame,
    care_sites: DataFrame,
    lists: DataFrame,
    localisations: DataFrame,
    steps: Sequence[int] = STEPS,
    claim_source: str | None = None,
    sources: Mapping[str, str] = {},
    after_date: str | None = None,
    before_date: str | None = None,
    date_column: str = "visit_start_datetime",
    level: str = "organ",
    costs: DataFrame | None = None,
    only_selected_steps: bool = False,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Stays by steps with their localisation, then date bounds and hospital; `dictionary` are the diagnosis codes in use, if known."""
    conditions = filter_source(conditions, claim_source, sources)
    procedures = filter_source(procedures, claim_source, sources)
    stays = located_steps(conditions, procedures, lists, localisations, steps, level, costs, dictionary)
    if only_selected_steps:
        stays = stays.filter("stay_cancer")
    visit_columns = ["visit_occurrence_id", "person_id", "visit_start_datetime", "visit_end_datetime", "visit_source_value", "care_site_id"]
    stays = stays.join(visits.select(*visit_columns), "visit_occurrence_id", "left")
    stays = date_bounds(stays, date_column, after_date, before_date)
    return stays.join(care_sites.select("care_site_id", "care_site_name"), "care_site_id", "left")


def patient_cohort(
    stays: DataFrame,
    level: str = "organ",
    first_date_after: str | None = None,
    first_date_before: str | None = None,
    main_localisations: Sequence[str] | None = None,
    localisations: Sequence[str] | None = None,
) -> DataFrame:
    """One row per person: the heaviest localisation, its first date and all localisations.

    Stays are reduced step by step, (person, type, level) -> (person, level) -> person, each time combined
    before the shuffle, so a person with very many stays never sits in one window. The stay shown is the
    earliest of the winning localisation, then the one with the smallest visit id.
    """
    other = "system" if level == "organ" else "organ"
    # Stays without a date come last: the first date is the smallest known one.
    undated = F.col("visit_start_datetime").isNull().alias("undated")
    shown = F.struct(undated, "visit_start_datetime", "visit_occurrence_id", other, "care_site_id", "care_site_name")
    by_type = stays.groupBy("person_id", "visit_source_value", level).agg(
        F.sum("weight_code").alias("_weight"),
        F.count(F.lit(1)).alias("_n"),
        F.min(shown).alias("_shown"),
        F.collect_set(other).alias("_others"),
    )
    share = F.when(F.col("visit_source_value") == INCOMPLETE_STAY, F.col("_weight") / F.col("_n")).otherwise(F.col("_weight"))
    by_level = by_type.groupBy("person_id", level).agg(
        F.round(F.sum(share), 9).alias("_weight"),
        F.min("_shown").alias("_shown"),
        F.array_distinct(F.flatten(F.collect_list("_others"))).alias("_others"),
    )
    # Smallest first: no weight last, then heavy before light, then the earliest stay.
    order = F.struct(
        F.col("_weight").isNull().alias("empty"),
        (-F.col("_weight")).alias("minus_weight"),
        F.col("_shown.undated").alias("undated"),
        F.col("_shown.visit_start_datetime").alias("first_date"),
        F.col("_shown.visit_occurrence_id").alias("visit"),
        F.col(level).alias("level"),
        F.col(f"_shown.{other}").alias("other"),
        F.col("_shown.care_site_id").alias("care_site_id"),
        F.col("_shown.care_site_name").alias("care_site_name"),
    )
    targeted = F.max(F.col(level).isin(list(localisations))) if localisations else F.lit(False)
    persons = by_level.groupBy("person_id").agg(
        F.min(order).alias("_best"),
        F.sort_array(F.collect_set(level)).alias(f"all_{level}s"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_others")))).alias(f"all_{other}s"),
        targeted.alias("_targeted"),
    )
    cohort = persons.select(
        "person_id",
        F.col("_best.other" if level == "organ" else "_best.level").alias("system"),
        F.col("_best.level" if level == "organ" else "_best.other").alias("organ"),
        F.col("_best.first_date").alias("localisation_first_date"),
        F.size("all_organs").cast("bigint").alias("n_distinct_organ"),
        F.size("all_systems").cast("bigint").alias("n_distinct_system"),
        "all_organs",
        "all_systems",
        F.col("_best.care_site_id").alias("care_site_id"),
        F.col("_best.care_site_name").alias("care_site_name"),
        "_targeted",
    )
    cohort = date_bounds(cohort, "localisation_first_date", first_date_after, first_date_before)
    if main_localisations is not None:
        cohort = cohort.filter(F.col(level).isin(list(main_localisations)))
    if localisations is not None:
        cohort = cohort.filter("_targeted")
    return cohort.drop("_targeted")


COHORT_COLUMNS = ("organ", "system", "localisation_first_date")


def cohort_notes(
    cohort: DataFrame, hospital_groups: DataFrame, notes: DataFrame, visits: DataFrame, group: str | None = None,
    cohort_columns: Sequence[str] = COHORT_COLUMNS, **eligibility,
) -> DataFrame:
    """Eligible notes of cohort persons written in the hospital group of the person's cohort row, with what the cohort knows of the person.

    The joins run on ids; only the texts of eligible notes are joined to the chosen note ids at the end.
    """
    shown = [c for c in cohort_columns if c in cohort.columns and c not in notes.columns]
    persons = keep_one(
        cohort.select(*dict.fromkeys(["person_id", "care_site_id", "localisation_first_date", *shown])),
        sort_column="localisation_first_date",
        tie_break=["care_site_id"],
    )
    sites = unique_by(hospital_groups.select("care_site_id", "hospital_group").distinct(), ["care_site_id"], "hospital groups")
    persons = persons.join(sites, "care_site_id").select("person_id", F.col("hospital_group").alias("_person_group"), *shown)
    eligible = eligible_notes(notes, **eligibility)
    if "care_site_id" in notes.columns:
        written = eligible.select("note_id", "person_id", "care_site_id")
    else:
        written = eligible.select("note_id", "person_id", "visit_occurrence_id")
        written = written.join(visits.select("visit_occurrence_id", "care_site_id"), "visit_occurrence_id")
    written = written.join(sites, "care_site_id").join(persons, "person_id")
    written = written.filter(F.col("hospital_group") == F.col("_person_group"))
    if group is not None:
        written = written.filter(F.col("hospital_group") == group)
    return eligible.join(written.select("note_id", "hospital_group", *shown), "note_id")

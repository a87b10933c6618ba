"""Matching coded events against code lists."""

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clinspark.reference_values import CODE_PREFIX_LENGTHS, FLAG_COLUMNS

# A code list made from driver-side rows is broadcast up to this many rows.
BROADCAST_ROWS = 100_000

Codes = str | int | Sequence | DataFrame | None


def code_frame(spark: SparkSession, rows: Iterable[Sequence], schema) -> DataFrame:
    """Code list from driver-side rows; broadcast when it is small enough."""
    rows = list(rows)
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def match_codes(df: DataFrame, codes: DataFrame, on: str, code: str = "code", keep: Sequence[str] | None = None) -> DataFrame:
    """Inner join with a code list; its other columns ride along and repeated list rows multiply.

    Spark broadcasts the list when its measured size allows, and otherwise splits skewed codes at run time.
    """
    listed = codes if keep is None else codes.select(code, *keep)
    listed = listed.withColumnRenamed(code, "_code")
    return df.join(listed, F.col(on) == F.col("_code"), "inner").drop("_code")


def code_prefixes(column) -> Column:
    """Distinct leading parts of a code at the lengths that may be listed."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_distinct(F.array(*[F.substring(column, 1, n) for n in CODE_PREFIX_LENGTHS]))


def code_dictionary(df: DataFrame, on: str) -> DataFrame:
    """(full_code): the distinct codes of a table of events, one narrow column of it; combined per task before the shuffle."""
    return df.select(F.col(on).alias("full_code")).filter(F.col("full_code").isNotNull()).distinct()


def listed_codes(dictionary: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Full codes with the list rows that equal them or a leading part: (full_code, other columns of the list).

    Leading parts are made of the codes in use, which are few, and never of the events.
    """
    listed = codes.withColumnRenamed(code, "_code")
    prefixed = dictionary.select("full_code", F.explode(code_prefixes("full_code")).alias("_prefix"))
    return prefixed.join(listed, F.col("_prefix") == F.col("_code"), "inner").drop("_prefix", "_code")


def match_prefix_codes(df: DataFrame, codes: DataFrame, on: str, code: str = "code", dictionary: DataFrame | None = None) -> DataFrame:
    """Inner join with a list whose codes may be a prefix of the event code.

    The list is matched against the dictionary of codes (`full_code`; by default the codes of `df`), and the events join the matches once,
    on their full code. A terminology table or a kept dictionary spares the read of the codes; codes that it lacks match nothing.
    """
    known = code_dictionary(df, on) if dictionary is None else dictionary.select("full_code").distinct()
    matched = listed_codes(known, codes, code)
    return df.join(matched, F.col(on) == F.col("full_code"), "inner").drop("full_code")


def has_listed_prefix(column, codes: Sequence[str]) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    condition = F.lit(False)
    for n in CODE_PREFIX_LENGTHS:
        condition = condition | F.substring(column, 1, n).isin(list(codes))
    return condition


def filter_codes(df: DataFrame, codes: Codes, on: str) -> DataFrame:
    """Keep rows by one code, a list of codes or a code-list frame; None keeps all."""
    if codes is None:
        return df
    if isinstance(codes, DataFrame):
        keep = [c for c in codes.columns if c != "code"]
        return match_codes(df, codes, on, keep=keep)
    if isinstance(codes, (str, int)) and not isinstance(codes, bool):
        return df.filter(F.col(on) == codes)
    if isinstance(codes, (list, tuple)):
        return df.filter(F.col(on).isin(list(codes)))
    raise TypeError("codes should be a str, int, list, tuple or DataFrame")


def source_value(claim_source: str, sources: Mapping[str, str]) -> str:
    """Stored value of a claim source given by key or by the value itself."""
    if claim_source in sources:
        return sources[claim_source]
    if claim_source in sources.values():
        return claim_source
    raise ValueError(f"unknown claim source {claim_source!r}; known: {sorted(sources)}")


def filter_source(df: DataFrame, claim_source: str | None, sources: Mapping[str, str]) -> DataFrame:
    if claim_source is None:
        return df
    return df.filter(F.col("cdm_source") == source_value(claim_source, sources))


def step_code_lists(flags: DataFrame, code: str = "Code") -> DataFrame:
    """Flag columns holding 'x' -> (list, code) rows."""
    present = [c for c in FLAG_COLUMNS if c in flags.columns]
    long = flags.unpivot([F.col(code).alias("code")], [F.col(c) for c in present], "column", "flag")
    names = F.create_map(*[F.lit(x) for c in present for x in (c, FLAG_COLUMNS[c])])
    return long.filter(F.col("flag") == "x").select(names[F.col("column")].alias("list"), "code")


def unmatched(wanted: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Requested values (tasks, codes) that matched nothing."""
    return wanted.select(on).distinct().join(found.select(on).distinct(), on, "left_anti")


def filter_persons(df: DataFrame, persons: DataFrame | Sequence[int] | None, method: str = "inner") -> DataFrame:
    """Restrict to (inner, left_semi) or exclude (left_anti) a set of persons; an empty list is an empty set."""
    if persons is None:
        return df
    how = {"inner": "left_semi", "left_semi": "left_semi", "semi": "left_semi", "leftsemi": "left_semi",
           "leftanti": "left_anti", "left_anti": "left_anti", "anti": "left_anti"}.get(method)
    if how is None:
        raise ValueError(f"unknown method {method!r}")
    if not isinstance(persons, DataFrame):
        schema = T.StructType([T.StructField("person_id", T.LongType())])
        persons = code_frame(df.sparkSession, [(int(p),) for p in set(persons)], schema)
        return df.join(persons, "person_id", how)
    return df.join(persons.select("person_id").distinct(), "person_id", how)

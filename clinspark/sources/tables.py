"""Reading tables, notes and predictions."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clinspark.operators.codes import code_frame
from clinspark.reference_values import COLUMN_MAPS

# A value list up to this size becomes an IN filter (pushed to the scan); a longer one becomes a join.
IN_LIST = 1000


def rename_columns(df: DataFrame, table: str) -> DataFrame:
    """Source names -> table names for the tables that have a map."""
    return df.withColumnsRenamed(COLUMN_MAPS.get(table, {}))


def read_table(
    spark: SparkSession, table: str, folder: str | None = None, db: str | None = None,
    columns: Sequence[str] | None = None, rename: bool = True,
) -> DataFrame:
    """Table of a database, or a Parquet directory; renamed first, then projected."""
    df = spark.read.table(f"{db}.{table}") if db is not None else spark.read.parquet(f"{folder.rstrip('/')}/{table}")
    df = rename_columns(df, table) if rename else df
    return df if columns is None else df.select(*columns)


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("n_rows"))


def keep_avoid(df: DataFrame, column: str = "person_id", keep: Sequence | None = None, avoid: Sequence | None = None) -> DataFrame:
    """Rows whose value is in one list and not in another; rows without a value never pass, nulls in a list count for nothing."""
    for values, negate in ((keep, False), (avoid, True)):
        if values is None:
            continue
        values = [v for v in values if v is not None]
        if len(values) <= IN_LIST:
            inside = F.col(column).isin(values) if values else F.lit(False)
            df = df.filter(F.col(column).isNotNull() & (~inside if negate else inside))
        else:
            schema = T.StructType([T.StructField(column, df.schema[column].dataType)])
            listed = code_frame(df.sparkSession, [(v,) for v in set(values)], schema)
            df = df.filter(F.col(column).isNotNull()).join(listed, column, "left_anti" if negate else "left_semi")
    return df


def cast_to_tz(df: DataFrame, zone: str) -> DataFrame:
    """Every timestamp column from UTC to the zone's wall clock."""
    kinds = (T.TimestampType, T.TimestampNTZType)
    stamps = [f for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return df.withColumns(
        {f.name: F.from_utc_timestamp(F.col(f.name).cast("timestamp"), zone).cast(f.dataType) for f in stamps}
    )


def read_filtered(
    df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence | None = None, avoid: Sequence | None = None,
    zone: str | None = None, filter_column: str = "person_id",
) -> DataFrame:
    df = keep_avoid(df, filter_column, keep, avoid)
    df = df if columns is None else df.select(*columns)
    return df if zone is None else cast_to_tz(df, zone)


def read_votes(df: DataFrame, keys: Sequence[str] = ("note_id", "start", "end"), dense: bool = False) -> DataFrame:
    """Votes with an instance id."""
    from clinspark.operators.sampling import add_instance_id

    return add_instance_id(df, keys, dense)


def load_notes(spark: SparkSession, data: DataFrame | str) -> DataFrame:
    """Notes from a frame, a Parquet file or directory, or a CSV file; note ids become text."""
    if isinstance(data, DataFrame):
        df = data
    elif data.endswith(".csv"):
        df = spark.read.csv(data, header=True, multiLine=True, escape='"')
    elif data.endswith(".parquet") or "." not in data.rstrip("/").rsplit("/", 1)[-1]:
        df = spark.read.parquet(data)
    else:
        raise ValueError("supported inputs are a DataFrame, .parquet or .csv")
    return df.withColumn("note_id", F.col("note_id").cast("string")) if "note_id" in df.columns else df

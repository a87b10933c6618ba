"""Writing datasets, predictions and tables."""

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_dataset(df: DataFrame, path: str, output_format: str = "parquet", overwrite: bool = True, batch_size: int | None = None) -> str:
    """Training set as Parquet, JSON lines (`jsonl`) or JSON files with `batch_size` rows each (`json`: one)."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if output_format == "parquet":
        writer.option("maxRecordsPerFile", batch_size or 0).parquet(path)
    elif output_format in ("jsonl", "json"):
        records = batch_size or (1 if output_format == "json" else 0)
        writer.option("maxRecordsPerFile", records).option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unsupported output format: {output_format}")
    return path


def write_predictions(predictions: DataFrame, notes: DataFrame, path: str, tasks: Sequence[str]) -> str:
    """Predictions as Parquet, and one JSON record with the number of notes, the time and the tasks."""
    began = time.perf_counter()
    predictions.write.mode("overwrite").parquet(path)
    seconds = time.perf_counter() - began
    record = notes.agg(F.count(F.lit(1)).alias("num_docs")).select(
        "num_docs", F.lit(seconds).alias("inference_time_sec"), F.array(*[F.lit(t) for t in tasks]).alias("task_names")
    )
    record.coalesce(1).write.mode("overwrite").json(f"{path}.json")
    return path


def write_table(df: DataFrame, name: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name)


def write_new(df: DataFrame, path: str, output_format: str = "csv") -> None:
    """Create-only write: fails when the target exists."""
    writer = df.write.mode("errorifexists")
    writer.csv(path, header=True) if output_format == "csv" else writer.format(output_format).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)

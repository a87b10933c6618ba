"""Corpus pipeline: stages applied one after the other to the documents, each written and read again."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clinspark.llm import bpe, jaccard, lines, mixing, quality
from clinspark.llm.common import checkpointed, table
from clinspark.llm.queries import LEAST_QUALITY, byte_bpe


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns in a struct `row`, so that no column of the documents meets a name used inside a stage."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` again, those in `changed` (if there) with new values."""
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches LEAST_QUALITY; all others go.

    Null texts are scored as empty ones; a text without evidence scores 0.5 and stays, as everything does without labels. Repeated rows
    stay or go together, an empty table stays empty, columns of any name pass through.
    """
    scored = quality.score(packed(docs), quality.fit(docs, table(spark, sf_dir, "labels")))
    return unpacked(scored.filter(F.col("score") >= LEAST_QUALITY), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand, exactly or nearly, in an earlier place; documents stay, even when all their lines go.

    Null and empty texts stay as they are, rows of one doc_id and text are treated alike, an empty table stays empty, columns of any name
    pass through; n_chars, if there, is that of the new text (0 for null).
    """
    cut = lines.dedup_lines(packed(docs))
    return unpacked(cut, docs, text=F.col("text"), n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of n-gram similar ones: five words, a similarity of 0.8 or more.

    Documents without words stay; repeated rows of a class leave one; null ids come last; an empty table stays empty, columns of any
    name pass through.
    """
    return jaccard.one_of_each_class(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its schedule.

    Documents without words aren't in the mix; a null source is one of its own; repeated rows count each; an empty table stays empty,
    columns of any name pass through.
    """
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and the digest of the bytes that they decode to. Null texts count as empty; other columns aren't read."""
    encoded = bpe.encode(docs.select("doc_id", "text"), *byte_bpe(), decoded=True)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode_bytes),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clinspark.llm.hashing import words_of_texts

# The fit reads at most so many labelled rows of each label, chosen by a hash of their id. All else covers all rows.
SAMPLE_PER_LABEL = 1000
TERMS = 2048  # hashed terms of each of the two kinds
RANK = 64  # latent dimensions
NEIGHBOURS = 31
SHARPNESS = 4.0  # votes weigh cosine ** SHARPNESS
BLOCK = 256  # documents of one matrix product
CHUNK = 1 << 20  # bytes of a text that are counted at once
FOLDS = 5
NO_EVIDENCE = 0.5

# Kinds of bytes: small letter, capital, digit, blank, line break, part of a character beyond ASCII, and each ASCII sign by itself.
_KIND = np.zeros(256, np.uint32)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 32]] = 4
_KIND[[10, 13]] = 5
_KIND[128:] = 6
_SIGNS = np.flatnonzero(_KIND == 0)
_KIND[_SIGNS] = 7 + np.arange(len(_SIGNS))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is left for testing: crc32 of the id's text is a multiple of FOLDS (null: as the empty text)."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS == 0


def _trigrams(data: np.ndarray, factors: tuple[int, int, int]) -> np.ndarray:
    a, b, c = (np.uint32(f) for f in factors)
    code = data[:-2].astype(np.uint32) * a + data[1:-1].astype(np.uint32) * b + data[2:].astype(np.uint32) * c
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=TERMS)


def counts_of(text: memoryview | bytes, words: np.ndarray) -> np.ndarray:
    """Term counts of a text: hashed trigrams of byte kinds, hashed byte trigrams, repeated and other adjacent words."""
    data = np.frombuffer(text, np.uint8)
    found = np.zeros(2 * TERMS + 2, np.float32)
    for low in range(0, max(len(data) - 2, 0), CHUNK):
        part = data[low : low + CHUNK + 2]
        found[:TERMS] += _trigrams(_KIND[part], (1681, 41, 1))
        found[TERMS : 2 * TERMS] += _trigrams(part, (65536, 256, 1))
    if len(words) > 1:
        again = int((words[1:] == words[:-1]).sum())
        found[-2:] = again, len(words) - 1 - again
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Term weights, projection to the latent space, and the labelled vectors with their labels; a few MB whatever the data."""

    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts[:, : 2 * TERMS]) * self.weights
        share = counts[:, 2 * TERMS :] / np.maximum(counts[:, 2 * TERMS :].sum(axis=1, keepdims=True), 1.0)
        return np.hstack([_unit(x[:, :TERMS]), 0.5 * _unit(x[:, TERMS:]), share])

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.weighted(counts) @ self.projection)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors, those as near as the last of them included.

        Votes also weigh the inverse number of labelled vectors of their label, so that a rare label is not outvoted by number.
        """
        if not len(self.labels):
            return np.full(len(counts), NO_EVIDENCE)
        near = self.latent(counts) @ self.vectors.T
        if near.shape[1] > NEIGHBOURS:
            last = np.partition(near, -NEIGHBOURS, axis=1)[:, -NEIGHBOURS]
            near = np.where(near >= last[:, None], near, 0.0)
        votes = np.maximum(near, 0.0).astype(np.float64) ** SHARPNESS
        ones = self.labels.sum()
        votes *= np.where(self.labels > 0, 1.0 / max(ones, 1.0), 1.0 / max(len(self.labels) - ones, 1.0))
        total = votes.sum(axis=1)
        share = np.where(total > 0, (votes @ self.labels) / np.maximum(total, 1e-300), NO_EVIDENCE)
        return np.clip(np.where(counts.any(axis=1), share, NO_EVIDENCE), 0.0, 1.0)


def _counted(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    texts = batch.column(column)
    for value, words in zip(texts, words_of_texts(texts)):
        yield counts_of(value.as_buffer() if value.is_valid else b"", words)


def fit(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """Fit on at most `sample_per_label` labelled documents of each label that are not held out.

    Labels: (doc_id, quality); several labels of one id count by their mean, null ids and labels are left out. The sample, of
    bounded size, is counted in tasks and factored in the driver: term weights log(rows / rows with the term), then a randomised
    singular value decomposition of RANK dimensions.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("_mean"))
    known = known.filter(~held_out(F.col("doc_id"))).select("doc_id", (F.col("_mean") >= 0.5).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 1").orderBy(*order).limit(sample_per_label).union(known.filter("label = 0").orderBy(*order).limit(sample_per_label))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text")).join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
    texts = texts.select("doc_id", "label", "text").orderBy(*order, F.xxhash64("text")).limit(4 * sample_per_label)

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [zlib.compress(c.tobytes(), 1) for c in _counted(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "counts"])

    # After the ordered limit all rows are in one partition; they are counted on several. Counts are mostly zeros and travel packed.
    rows = texts.repartition(16, "doc_id").mapInArrow(count, "doc_id bigint, label int, counts binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["counts"]))
    width = 2 * TERMS + 2
    model = Model(np.ones(2 * TERMS, np.float32), np.zeros((width, RANK), np.float32), np.zeros((0, RANK), np.float32), np.zeros(0))
    if not len(rows):
        return model

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        """Counts of some rows at a time: the driver holds the packed rows and one weighted matrix, and no copies of it."""
        for at in range(0, len(rows), BLOCK):
            part = [np.frombuffer(zlib.decompress(r["counts"]), np.float32) for r in rows[at : at + BLOCK]]
            yield at, np.array(part)

    having = np.zeros(2 * TERMS)
    for _, part in blocks():
        having += (part[:, : 2 * TERMS] > 0).sum(axis=0)
    model.weights = np.log((len(rows) + 1.0) / (having + 1.0)).astype(np.float32) + np.float32(0.1)
    x = np.empty((len(rows), width), np.float32)
    for at, part in blocks():
        x[at : at + len(part)] = model.weighted(part)
    basis = np.random.Generator(np.random.PCG64(1)).standard_normal((width, min(RANK + 8, width))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, rows_of_v = np.linalg.svd(x @ basis, full_matrices=False)
    model.projection = (basis @ rows_of_v.T[:, :RANK]).astype(np.float32)
    model.vectors = _unit(x @ model.projection).astype(np.float32)
    model.labels = np.array([r["label"] for r in rows], np.float64)
    return model


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Every whole text scored: all columns of `docs` and `score`, 0 to 1, higher where label 1 is likelier.

    The labelled vectors (at most 4 times the sample's bound) are broadcast; a block of documents is multiplied with all of them, so the
    nearest ones are exact. Null texts count as empty; a text without a trigram or two words, and a model without labels,
    score NO_EVIDENCE. Repeated rows get equal scores and stay, an empty table gives no rows, a column named score is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() != "score"]
    at = kept.index(text_column)
    schema = docs.select(*kept).schema.add("score", "double")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found, held = [], []
            for counts in _counted(batch, at):
                held.append(counts)
                if len(held) == BLOCK:
                    found.append(sent.value.scores(np.array(held)))
                    held = []
            if held:
                found.append(sent.value.scores(np.array(held)))
            scores = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return docs.select(*kept).mapInArrow(batches, schema)

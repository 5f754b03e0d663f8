"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Texts become hashed counts of words and of word shapes (letters, capitals, digits and symbols, runs made single). From a
bounded sample of labelled documents a truncated singular value decomposition gives a latent space; the sample's vectors
and labels are broadcast (at most MOST_LABELLED rows of DIMS floats). Every document is compared with all of them, in
blocks of exact cosine products, and its nearest neighbours vote with weights that grow with the similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: Bounds of what is learned from: labelled documents, hashed features, latent dimensions, neighbours.
MOST_LABELLED, BUCKETS, DIMS, NEIGHBOURS, SHARPNESS = 4000, 4096, 48, 25, 4
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def counts(raw: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, damped count) of a text's features: words in the lower half, shapes and repeats in the upper."""
    half = buckets // 2
    words = raw.lower().split()
    got: dict[int, int] = {}
    for word, n in Counter(words).items():
        k = crc32(word) % half
        got[k] = got.get(k, 0) + n
    shapes: dict[bytes, int] = {}
    for shape, n in Counter(raw.translate(_SHAPE).split()).items():
        shape = _RUN.sub(rb"\1", shape)
        shapes[shape] = shapes.get(shape, 0) + n
    shapes[b"= again"] = sum(map(bytes.__eq__, words[1:], words))
    lines = raw.split(b"\n")
    shapes[b"= line"] = 10 * (len(lines) - len(set(lines)))
    for shape, n in shapes.items():
        if n:
            k = half + crc32(shape) % half
            got[k] = got.get(k, 0) + n
    at = np.fromiter(got.keys(), np.int32, len(got))
    n = np.fromiter(got.values(), np.float32, len(got))
    total = max(1, len(words))
    weight = np.sqrt(n / total)
    weight[at < half] *= 0.5
    return at, weight


@dataclass
class Model:
    """What scoring needs: feature weights times latent directions, the labelled vectors, labels and their share of good."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, raw: bytes) -> np.ndarray:
        at, weight = counts(raw, len(self.project))
        v = weight @ self.project[at] if len(at) else np.zeros(self.project.shape[1], np.float32)
        size = np.linalg.norm(v)
        return v / size if size > 0 else v

    def score(self, texts: list[bytes] | pa.Array, block: int = 256) -> np.ndarray:
        """Share of good among the weighted votes of each text's neighbours; 0 for a null or a text without words, 0.5 without labels.

        Of an Arrow array of bytes a block at a time is held as Python objects.
        """
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            if isinstance(part, pa.Array):
                part = [x or b"" for x in part.to_pylist()]
            some = np.array([bool(x.strip()) for x in part])
            if not k:
                out[at : at + block] = np.where(some, 0.5, 0.0)
                continue
            near = np.stack([self.embed(x) for x in part]) @ self.vectors.T
            top = np.argpartition(near, -k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-3) ** SHARPNESS
            out[at : at + block] = np.where(some, (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1), 0.0)
        return np.clip(out, 0.0, 1.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dims: int = DIMS, seed: int = 42) -> Model:
    """Latent space of (buckets, weights, label) rows by a seeded randomised range finder."""
    n = len(rows)
    if not n:
        return Model(np.zeros((buckets, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    a = np.zeros((n, buckets), np.float32)
    for i, (at, weight, _) in enumerate(rows):
        a[i, at] = weight
    rare = np.log((1 + n) / (1 + (a > 0).sum(axis=0))).astype(np.float32) + 1
    a *= rare
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    k = min(dims, n, buckets)
    y = a @ np.random.default_rng(seed).standard_normal((buckets, min(k + 12, n)), dtype=np.float32)
    for _ in range(3):
        y, _ = np.linalg.qr(y)
        y = a @ (a.T @ y)
    y, _ = np.linalg.qr(y)
    _, _, vt = np.linalg.svd(y.T @ a, full_matrices=False)
    v = vt[:k].T.astype(np.float32)
    vectors = a @ v
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return Model(rare[:, None] * v, vectors, np.array([label for *_, label in rows], np.float32))


def held_out(id_col: str):
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fit on at most `most` labelled ids, those with the smallest hashes; held-out rows, null labels and null ids are left out.

    Of rows that repeat an id the one whose text has the smallest hash is learned from.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    picked = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_raw")).join(F.broadcast(picked), "_id")  # most rows at the utmost
    least = F.min(F.struct(F.xxhash64("_raw").alias("h"), F.col("_raw").alias("raw"))).alias("least")
    chosen = found.groupBy("_id").agg(least, F.first("_label").alias("_label")).select("_id", F.col("least.raw").alias("_raw"), "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(x.as_py() or b"") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float32())), b.column(2)], names=["_id", "at", "weight", "label"])

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("weight", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    rows = chosen.select("_id", "_raw", "_label").mapInArrow(run, schema).toArrow()
    rows = rows.sort_by("_id")
    return fit([(np.array(a, np.int32), np.array(w, np.float32), y) for a, w, y in zip(rows["at"].to_pylist(), rows["weight"].to_pylist(), rows["label"].to_pylist(), strict=True)])


def scorer(spark: SparkSession, model: Model):
    """The function from a column of bytes to scores; only this column goes to Python, in Arrow batches."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(texts), pa.float64())

    score_batches = lean(run)
    score_batches.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score_batches, T.DoubleType())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, held_out, score and predicted (1 if the score reaches the threshold).

    Only the text enters a score. A null or empty text scores 0; without any usable label every other text scores 0.5.
    Other columns of docs and labels are ignored; null and repeated ids are rows like others.
    """
    scored = docs.select(F.col(id_col), scorer(docs.sparkSession, train(docs, labels, id_col, text_col, label_col))(F.col(text_col).cast("binary")).alias("score"))
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold; see score."""
    good = scorer(docs.sparkSession, train(docs, labels, id_col, text_col, label_col))
    return docs.where(good(F.col(text_col).cast("binary")) >= threshold)

"""Quality classifier: similarity-weighted votes of nearest labelled neighbours in a latent
semantic space.

A text becomes a vector of hashed byte trigrams (log counts, inverse document frequency, unit
length) and one term for words that repeat the word before them.  A truncated singular value
decomposition of the labelled texts gives the latent axes; the labelled latent vectors are
broadcast (``max_labelled`` x ``dims`` floats, bounded by parameters), and every document is
compared with all of them by blocked matrix products, so the neighbours are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import crc32_text

#: hashed trigram terms; one more term stands for repeated words
TERMS = 4096
#: weight of the repeated-words term against the unit vector of trigrams
REPEAT_WEIGHT = 3.0
#: documents compared in one matrix product
BLOCK = 512
#: bytes hashed at a time
BYTES = 1 << 20
#: steps to 1 of the factors of inner products: the sums of the products of two such numbers are
#: exact in double precision, so a score depends neither on the batch nor on the order of a sum
GRID = 1 << 22


def term_vector(text: str | None) -> np.ndarray:
    """Log counts of the hashed byte trigrams of a whole text; last, the share of words that
    repeat the word before them."""
    out = np.zeros(TERMS + 1, np.float32)
    if not text:
        return out
    raw = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    counts = np.zeros(TERMS, np.int64)
    for at in range(0, len(raw) - 2, BYTES):
        b = raw[at:at + BYTES + 2].astype(np.uint32)
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        counts += np.bincount(((h ^ h >> 15) * np.uint32(0x2C1B3C6D)) >> 20, minlength=TERMS)
    out[:TERMS] = np.log1p(counts)
    words = text.split()
    out[TERMS] = sum(map(eq, words, words[1:])) / max(1, len(words))
    return out


@dataclass
class Model:
    """Latent axes and the labelled vectors that vote."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 10
    sharpness: int = 8

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = _on_grid(_weighted(terms, self.idf)) @ _on_grid(self.axes)
        return _on_grid(z / np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z))[:, None], 1e-9))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; of a text
        near none of them, the share of label 1 in all labels (0.5 without labels)."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(terms), prior)
        near = self.latent(terms) @ self.vectors.T
        k, n = min(self.neighbours, near.shape[1]), near.shape[1]
        # one number a vector: its similarity, and of equal ones the vector that comes first is larger
        rank = np.rint(near * GRID).astype(np.int64) * n + np.arange(n)[::-1]
        best = np.sort(np.argpartition(-rank, k - 1, axis=1)[:, :k], axis=1)
        votes = np.take_along_axis(near, best, 1).clip(0) ** self.sharpness
        total = votes.sum(axis=1)
        share = (votes * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.where(total > 1e-12, share, prior).clip(0, 1)


def _on_grid(values: np.ndarray) -> np.ndarray:
    return np.rint(values.astype(np.float64) * GRID) / GRID


def _weighted(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = terms[:, :TERMS] * idf
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)
    w = np.hstack([w, REPEAT_WEIGHT * np.sqrt(terms[:, TERMS:])])
    return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-9)


def fit_terms(terms: np.ndarray, labels: np.ndarray, dims: int = 32) -> Model:
    """Fits the latent space to term vectors by a randomized truncated SVD (fixed seed)."""
    n = len(terms)
    idf = (np.log((1 + n) / (1 + np.count_nonzero(terms[:, :TERMS] > 0, axis=0))) + 1).astype(np.float32)
    # rows are weighted one by one: blocks give the same numbers and hold no further whole copy
    w = np.empty(terms.shape, np.float32)
    for at in range(0, n, BLOCK):
        w[at:at + BLOCK] = _weighted(terms[at:at + BLOCK], idf)
    basis = np.random.default_rng(0).standard_normal((TERMS + 1, dims + 16)).astype(np.float32)
    for _ in range(5 if n else 0):
        basis, _ = np.linalg.qr(w.T @ (w @ basis))
    _, _, axes = np.linalg.svd(w @ basis, full_matrices=False)
    axes = (basis @ axes.T)[:, :dims].astype(np.float32)
    del w
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), labels.astype(np.float64))
    if n:
        model.vectors = np.vstack([model.latent(terms[at:at + BLOCK]) for at in range(0, n, BLOCK)])
    return model


def fit(docs: DataFrame, labels: DataFrame, dims: int = 32, max_labelled: int = 3000) -> Model:
    """Learns from ``labels(doc_id, quality)`` and the texts of ``docs``.

    At most ``max_labelled`` labelled documents, those of the smallest doc_id hashes, are used;
    the term vectors are made on the executors and only they come to the driver (8 kB each).
    Null ids and labels other than 0 and 1 are left out; of repeated labels the smaller counts;
    of repeated documents one is used.
    """
    chosen = (labels.where("doc_id is not null and quality in (0, 1)")
              .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    texts = (docs.select("doc_id", "text").join(F.broadcast(
        chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)), "doc_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"],
                                "terms": [term_vector(t).astype(np.float16).tobytes() for t in b["text"]]})

    rows = (texts.mapInPandas(run, "doc_id long, quality int, terms binary")
            .dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id"))    # max_labelled rows at most
    terms = np.empty((len(rows), TERMS + 1), np.float32)
    for i, t in enumerate(rows.pop("terms")):
        terms[i] = np.frombuffer(t, np.float16)
    return fit_terms(terms, rows["quality"].to_numpy(np.float64), dims)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    Only the whole ``text`` is an input.  A null or empty text has the share of label 1 among the
    labels; equal texts get equal scores; columns of these names are replaced, all others kept;
    an empty table stays empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = np.zeros(len(batch))
            for at in range(0, len(batch), BLOCK):
                part = batch.iloc[at:at + BLOCK]
                out[at:at + BLOCK] = shared.value.scores(np.array([term_vector(t) for t in part]))
            yield pd.Series(out)

    return (kept.withColumn("score", score("text"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def held_out():
    """Rows that labels are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.pmod(crc32_text(), F.lit(5)) == 0, F.lit(False))

"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASHED, SURFACE, RANK, NEIGHBOURS = 4096, 64, 64, 15
DIMS = HASHED + SURFACE
#: Weight of the surface bins against the hashed counts, which have length 1.
SURFACE_WEIGHT = 0.3


def surface(text: str) -> np.ndarray:
    """Eight shares of the whole text, each spread over eight soft bins; the share of its length is full from 4,096 words on."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    plain = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(plain, np.uint8), minlength=256)
    stats = (
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(words)) / n,
        counts[65:91].sum() / chars,
        counts[48:58].sum() / chars,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / chars * 2,
        counts[10] / n * 4,
        sum(map(len, words)) / n / 12,
        min(n, 4096) / 4096,
    )
    out = np.zeros((8, 8), np.float32)
    at = np.clip(np.sqrt(np.array(stats)), 0, 1) * 7
    low = np.minimum(at.astype(int), 6)
    out[np.arange(8), low], out[np.arange(8), low + 1] = 1 - (at - low), at - low
    return out.ravel() * (SURFACE_WEIGHT / 8**0.5)


def features(text: str) -> np.ndarray:
    """Hashed counts (square roots, unit length) of byte pairs and triples of the whole text as written, and its surface bins."""
    out = np.zeros(HASHED, np.float64)
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass"), np.uint8)
    if not text:
        return np.zeros(DIMS, np.float32)
    for at in range(0, max(1, len(raw) - 1), 1 << 16):  # in blocks: a long text needs no more memory than a short one
        b = raw[at : at + (1 << 16) + 2].astype(np.uint32)
        two = (b[:-1] << 8 | b[1:])[: 1 << 16]
        three = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) | np.uint32(1 << 24)
        for code in (two, three):
            out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=HASHED)
    out = np.sqrt(out)
    return np.concatenate([out / np.linalg.norm(out), surface(text)]).astype(np.float32)


@dataclass
class Model:
    """Labelled vectors of a bounded sample: weight x RANK projection, unit vectors, labels and their weights."""

    project: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def place(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; rows without features stay zero."""
        z = (x - self.mean * (x.any(axis=1, keepdims=True))) @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its cosine to the fourth power."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosine = self.place(x) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cosine, at, 1), 0) ** 4 * self.weights[at]
        return (np.sum(w * self.labels[at], axis=1) + 1e-3 * self.prior) / (w.sum(axis=1) + 1e-3)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most per_label documents of each label 0 and 1, those with the least hash of the id; the latent space is their SVD.

    per_label bounds the model, what reaches the driver, and the ids that are broadcast to
    find the texts; texts are not shuffled but those of the sample. Null, empty and missing texts and other labels
    teach nothing; rows that repeat a label count once, and of several texts of one id the least counts; the prior counts all labelled rows.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    # Some labelled documents may be empty or missing, so twice as many ids are drawn.
    draw = lambda y: known.where(F.col("y") == y).select("id", "y").distinct().orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(2 * per_label)
    sample = draw(0).unionByName(draw(1))
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text") != "").join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    one = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(3), "id"), "id")
    drawn = drawn.withColumn("_r", F.row_number().over(one)).where(F.col("_r") <= per_label).select("y", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": [features(t).astype(np.float16).tobytes() for t in b["text"]]})

    got = sorted((r["y"], bytes(r["x"])) for r in drawn.mapInPandas(run, "y int, x binary").collect())
    if not got:
        return Model(np.zeros((DIMS, 1), np.float32), np.zeros(DIMS, np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    y = np.array([r[0] for r in got], np.float64)
    x = np.stack([np.frombuffer(r[1], np.float16) for r in got]).astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    mean = x.mean(axis=0)
    z = (x - mean) * idf
    # Randomised SVD (Halko et al., 2011).
    basis = np.random.default_rng(3).standard_normal((DIMS, min(RANK + 16, len(x)))).astype(np.float32)
    for _ in range(3):
        basis, _ = np.linalg.qr(z.T @ (z @ basis))
    _, _, right = np.linalg.svd(z @ basis, full_matrices=False)
    project = idf[:, None] * (basis @ right[:RANK].T)
    seen = {v: max((y == v).sum(), 1) for v in (0, 1)}
    weights = np.where(y == 1, prior / seen[1], (1 - prior) / seen[0]) * len(y)
    m = Model(project.astype(np.float32), mean, np.zeros((0, 1), np.float32), y, np.sqrt(weights), prior)
    m.vectors = m.place(x).astype(np.float32)
    return m


def score(docs: DataFrame, model: Model, text_col: str = "text", block: int = 512) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= 0.5) added; a map without shuffle.

    Every document is held against all labelled vectors, in blocks of `block` rows. Null
    and empty texts get the prior. Repeated rows get equal scores up to rounding, an empty
    table none; columns of these names are replaced.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        m = cast.value
        out = [m.score(np.stack([features(t or "") for t in texts[at : at + block]])) for at in range(0, len(texts), block)]
        return pd.Series(np.concatenate(out) if out else np.empty(0)).clip(0, 1)

    plain = docs.drop("score", "predicted")
    return plain.withColumn("score", judge(F.col(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

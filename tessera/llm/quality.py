"""Quality score: random Fourier features, ridge regression, isotonic calibration.

A text's form statistics are standardised and sent through random cosine
features that approximate a Gaussian kernel. Ridge weights come from normal
equations that every task sums over its own rows; a held part of the training
labels calibrates the score by isotonic regression on a fixed number of bins.

Training labels are a bounded sample (``SAMPLE`` rows, chosen by a hash of the
id); what is collected has fixed size: the sample's ids, the normal equations
of ``FEATURE_COUNT`` features and ``BINS`` counts.

Defined cases: NULL or wordless text is scored from zero statistics; label
rows with NULL id or value teach nothing; an id labelled twice teaches twice;
without labels of both kinds every score is the share of good labels (1.0
without any); an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_sample, fields, fold, slices, stage_derived, text_bytes
from tessera.llm.text_stats import FEATURES, describe

SAMPLE = 20_000
FEATURE_COUNT = 200
RIDGE = 1e-3
BINS = 200


class QualityModel:
    """Standardisation, cosine features, weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, count: int = FEATURE_COUNT):
        rng = np.random.default_rng(7)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(len(mean), count)) / np.sqrt(len(mean))
        self.shift = rng.uniform(0, 2 * np.pi, size=count)
        self.weights = np.zeros(count + 1)
        self.steps = (np.array([0.0]), np.array([1.0]))

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.column_stack([wave, np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def isotonic(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for w, v in zip(weights, values):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.empty(0)


def _statistics(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Statistics of the labelled texts; the labels are few, so they are broadcast."""

    def work(batches):
        for batch in slices(batches):
            rows = [describe(t or b"") for t in batch.column(2).to_pylist()]
            yield fields(["label", "check", "x"], [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))])

    chosen = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).join(F.broadcast(labels), "doc_id")
    return chosen.select(label, "check", "text").mapInArrow(work, "label double, check boolean, x array<double>")


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y; each task adds up its rows, Spark adds up the tasks."""
    size = len(model.weights)
    upper = np.triu_indices(size)

    def work(batches):
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.map(np.array(batch.column(1).to_pylist()))
                gram += z.T @ z
                right += z.T @ batch.column(0).to_numpy(zero_copy_only=False)
        values = np.concatenate([gram[upper], right])
        yield fields(["place", "value"], [pa.array(range(len(values)), pa.int32()), pa.array(values)])

    sums = np.zeros(len(upper[0]) + size)
    parts = rows.select("label", "x").mapInArrow(work, "place int, value double")
    for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        sums[row["place"]] = row["value"]
    gram = np.zeros((size, size))
    gram[upper] = sums[: len(upper[0])]
    return gram + np.triu(gram, 1).T, sums[len(upper[0]) :]


def _calibration(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing map from raw scores to label shares over fixed bins."""

    def work(batches):
        counts = np.zeros((2, BINS))
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column(1).to_pylist()))
                at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                y = batch.column(0).to_numpy(zero_copy_only=False)
                counts += [np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]
        yield fields(["bin", "n", "good"], [pa.array(range(BINS), pa.int32()), pa.array(counts[0]), pa.array(counts[1])])

    sums = np.zeros((2, BINS))
    parts = rows.select("label", "x").mapInArrow(work, "bin int, n double, good double")
    for row in parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect():
        sums[:, row["bin"]] = row["n"], row["good"]
    used = np.nonzero(sums[0])[0]
    centres = (used + 0.5) * 2 / BINS - 0.5
    return centres, isotonic(sums[0][used], sums[1][used] / sums[0][used])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """A model from at most ``sample`` labelled rows; a quarter of them calibrates."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double")).dropna()
    chosen = bounded_sample(known, sample).withColumn("check", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rows = stage_derived(_statistics(docs, chosen, label))
    size = len(FEATURES)
    moments = rows.agg(
        F.count("*"), F.avg("label"), F.min("label"), F.max("label"),
        *[f(F.get("x", F.lit(i))) for i in range(size) for f in (F.avg, F.stddev_pop)],
    ).head()
    count, share, low, high = moments[:4]
    if not count or low == high:
        model = QualityModel(np.zeros(size), np.ones(size))
        model.steps = (np.array([0.0]), np.array([float(share) if count else 1.0]))
        return model
    spread = np.array(moments[5::2], dtype=float)
    model = QualityModel(np.array(moments[4::2], dtype=float), np.where(spread > 1e-9, spread, 1.0))
    gram, right = _normal_equations(rows.filter("not check"), model)
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) * np.eye(len(gram)), right)
    steps = _calibration(rows.filter("check"), model)
    model.steps = steps if len(steps[0]) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scorer(model: QualityModel) -> Column:
    """Column function: text bytes to a score in [0, 1]."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = [np.empty(0)]
        values = list(texts)
        for start in range(0, len(values), 256):
            part = [describe(t if isinstance(t, (bytes, bytearray)) else b"") for t in values[start : start + 256]]
            out.append(model.score(np.array(part)))
        return pd.Series(np.clip(np.concatenate(out), 0, 1))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    Labels of ids whose crc32 leaves ``held`` modulo ``parts`` are not used.
    """
    model = fit(docs, labels.filter(fold("doc_id", parts) != held))
    out = docs.select(
        F.col("doc_id").cast("long"), (fold("doc_id", parts) == held).alias("held_out"), scorer(model)(text_bytes()).alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns.

    Rows pass through the tasks in small slices, so a task holds the texts of
    one Arrow batch and no second copy of them.
    """
    model, at = fit(docs, labels), docs.columns.index("text")

    def work(batches):
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            scores = model.score(np.array([describe(t or b"") for t in texts])) if texts else np.empty(0)
            yield batch.filter(pa.array(scores >= threshold, pa.bool_()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(work, docs.schema)

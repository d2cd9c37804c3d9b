"""Quality rules: fixed limits, then robust multivariate outliers.

Each text gets counts; two fixed limits fail it outright. The others are
judged by four transformed statistics (log word length, marks per word,
shares of repeated words and of repeated lines) against the minimum
covariance determinant of their language and source: starting from medians
and median deviations, concentration steps refit mean and covariance on the
three quarters of the group's texts with the smallest Mahalanobis distances.
A text is rejected beyond ``DISTANCE``, and only on the side of more marks,
more repetition or unusual word length: it stays if it lies within the
distance once marks and repetition below the group's mean are set to the mean.

Statistics that are constant in most texts (no marks, no repeats) would give
a zero variance, so every standard deviation has a floor, ``FLOORS``. Where
the floors act, 18% repeated words, 25% repeated lines or 0.09 marks a word
are beyond the cut, each alone.

Every language and source, every language and the whole corpus get an estimate
of their own. A language is then the mixture of its own estimate, with weight
n**2 / (n**2 + ``HALF``**2) for n texts, and of the corpus; a source the mixture
of its own and its language's. Mixtures have the mean and covariance of their
two parts, distance between the parts included, so trust in a source's own
ways grows smoothly with its size: a few dozen like texts carry themselves, a
single odd text does not.

All texts take part, in three groups each; a step is two grouped aggregates over a narrow written
table, combined before the shuffle, so a group of any size is one summary row
per task. Only group parameters meet the rows again, in a join that Spark
broadcasts if their written size allows it.

Defined cases: NULL text has no words and fails the fixed limits; NULL
language or source is a value of its own; repeated rows count as often as
they occur; an empty table gives an empty result; other columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fields, slices, stage_derived
from tessera.llm.text_stats import rule_counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
DIMS = 4
#: Least standard deviations: they guard against singular groups and stay well below what the cut must tell apart.
FLOORS = (0.04, 0.02, 0.1, 0.12)
#: Texts at which a group's own estimate and the wider one weigh the same.
HALF = 30
STEPS = 3
#: Parts into which a group's rows are dealt where they meet its parameters.
PARTS = 32
SHARE = 0.75
#: Of the chi-squared distribution with 4 degrees: share / P(chi2_6 <= its 0.75 quantile).
CONSISTENCY = 1.485
#: Square root of the 0.999 quantile of chi-squared with 4 degrees.
DISTANCE = 4.297

_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
_MEANS = [f"m{i}" for i in range(DIMS)]
_COVS = [f"v{i}{j}" for i, j in _PAIRS]
_PARAMS = [*_MEANS, *[f"p{i}{j}" for i, j in _PAIRS]]
#: Statistics of which only more is a fault.
_ONE_SIDED = (1, 2, 3)


def _transformed() -> list[Column]:
    words = F.greatest("n_words", F.lit(1))
    angle = lambda share: F.asin(F.sqrt(F.least(share, F.lit(1.0))))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias("x0"),
        F.log1p(F.col("n_symbols") / words).alias("x1"),
        angle(F.col("n_repeat_words") / words).alias("x2"),
        angle(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("x3"),
    ]


def failed() -> Column:
    """The fixed limits."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def counted(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The documents with ``COUNTS``' columns and the transformed statistics.

    Texts are counted in small slices of a task's Arrow batches and, unless
    asked for, do not come back from there.
    """
    at = docs.columns.index(text)
    kept = [i for i, c in enumerate(docs.columns) if keep_text or i != at]
    schema = T.StructType([docs.schema.fields[i] for i in kept] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def work(batches):
        for batch in slices(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            counts = np.array([rule_counts(t) if t is not None else (0,) * len(COUNTS) for t in texts], dtype=np.int64)
            counts = counts.reshape(len(texts), len(COUNTS))
            columns = [*[batch.column(i) for i in kept], *[pa.array(counts[:, j]) for j in range(len(COUNTS))]]
            yield fields(schema.names, columns)

    out = docs.withColumn(text, F.col(text).cast("string")).mapInArrow(work, schema)
    return out.select("*", *_transformed(), failed().alias("base_failed"))


def _distance(one_sided: bool = False) -> Column:
    """Squared Mahalanobis distance; ``one_sided`` raises what is below the mean, where only more is a fault, to the mean."""
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    if one_sided:
        off = [F.greatest(d, F.lit(0.0)) if i in _ONE_SIDED else d for i, d in enumerate(off)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        term = off[i] * off[j] * F.col(f"p{i}{j}")
        total = total + (term if i == j else 2 * term)
    return total


def _groups() -> list[Column]:
    """Names of the groups a row belongs to: corpus, language, language and source."""
    return [
        F.lit("all"), F.concat(F.lit("language "), F.to_json(F.struct("lang"))),
        F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))),
    ]


def _symmetric(values) -> np.ndarray:
    """A matrix from its upper triangle, row by row."""
    out = np.zeros((DIMS, DIMS))
    for (i, j), v in zip(_PAIRS, values):
        out[i, j] = out[j, i] = v
    return out


def _sound(cov: np.ndarray) -> np.ndarray:
    """A covariance with the least standard deviations."""
    return cov + np.diag(np.maximum(np.square(FLOORS) - np.diag(cov), 1e-9))


def _triangle(matrix: np.ndarray) -> tuple[float, ...]:
    return tuple(float(matrix[i, j]) for i, j in _PAIRS)


def _in_rows(frame: DataFrame, keys: str, names: list[str], solve) -> DataFrame:
    """``keys`` (a schema) and double columns ``names`` that ``solve`` gives for each row of group parameters."""
    held = [part.split()[0] for part in keys.split(", ")]
    at = [frame.columns.index(k) for k in held]

    def work(batches):
        for batch in slices(batches, 4096):
            out = [solve(row) for row in batch.to_pylist()]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield fields([*held, *names], [*[batch.column(i) for i in at], *[pa.array(list(c), pa.float64()) for c in columns]])

    return frame.mapInArrow(work, ", ".join([keys, *[f"{n} double" for n in names]]))


def _inverse(sums: DataFrame) -> DataFrame:
    """Group sums to mean, precision and covariance, one small solve per group."""

    def solve(row):
        mean = np.array([row[f"s{i}"] for i in range(DIMS)]) / row["n"]
        cov = _symmetric(row[f"s{i}{j}"] / row["n"] for i, j in _PAIRS) - np.outer(mean, mean)
        cov = _sound(CONSISTENCY * cov)
        return (*map(float, mean), *_triangle(np.linalg.inv(cov)), *_triangle(cov))

    return _in_rows(sums, "group string", [*_PARAMS, *_COVS], solve)


def mixed(n: int, own: tuple, wide: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a group of ``n`` texts, its own estimate mixed with a wider one."""
    share = n**2 / (n**2 + HALF**2)
    off = own[0] - wide[0]
    return share * own[0] + (1 - share) * wide[0], share * own[1] + (1 - share) * wide[1] + share * (1 - share) * np.outer(off, off)


def _blended(keys: DataFrame, params: DataFrame) -> DataFrame:
    """Mean and precision of every language and source (``keys`` with sizes), mixed with the wider groups."""
    for i, level in enumerate(("all", "language", "source")):
        own = params.select(F.col("group").alias(level), F.struct(*_MEANS, *_COVS).alias(f"e{i}"))
        keys = keys.join(own, level)

    def solve(row):
        known = [(np.array([e[m] for m in _MEANS]), _symmetric(e[v] for v in _COVS)) for e in (row["e0"], row["e1"], row["e2"])]
        mean, cov = mixed(row["n"], known[2], mixed(row["n_lang"], known[1], known[0]))
        return (*map(float, mean), *_triangle(np.linalg.inv(_sound(cov))))

    return _in_rows(keys.select("k_lang", "k_source", "n", "n_lang", "e0", "e1", "e2"), "k_lang string, k_source string", _PARAMS, solve)


def _met(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Rows (with ``part``) beside their group's parameters; a group of any size is dealt over ``PARTS`` keys."""
    return rows.join(params.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["group", "part"])


def _start(rows: DataFrame) -> DataFrame:
    """Medians and median absolute deviations as the first estimate."""
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    centre = stage_derived(rows.groupBy("group").agg(*[median(f"x{i}").alias(f"m{i}") for i in range(DIMS)]))
    off = _met(rows, centre).groupBy("group")
    wide = off.agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)], *[median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in range(DIMS)])
    inverse = [
        (1 / F.pow(F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOORS[i])), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"p{i}{j}")
        for i, j in _PAIRS
    ]
    return stage_derived(wide.select("group", *[f"m{i}" for i in range(DIMS)], *inverse))


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Mean and precision of every group of ``rows`` (``group``, ``x0``..)."""
    rows = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int"))
    params = _start(rows)
    for _ in range(steps):
        placed = _met(rows, params).select("group", "part", *[f"x{i}" for i in range(DIMS)], _distance().alias("d"))
        limits = stage_derived(placed.groupBy("group").agg(F.percentile_approx("d", SHARE, 1000).alias("limit")))
        core = _met(placed, limits).filter("d <= limit").groupBy("group")
        sums = core.agg(
            F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMS)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS],
        )
        params = stage_derived(_inverse(sums))
    return params


def fit(rows: DataFrame) -> DataFrame:
    """Parameters for every language and source of counted ``rows``."""
    values = [f"x{i}" for i in range(DIMS)]
    rows = rows.filter("not base_failed")
    grouped = stage_derived(rows.select(F.explode(F.array(*_groups())).alias("group"), *values))
    names = [g.alias(n) for g, n in zip(_groups(), ("all", "language", "source"))]
    keys = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = keys.groupBy(_groups()[1].alias("language")).agg(F.sum("n").alias("n_lang"))
    keys = keys.select(F.col("lang").alias("k_lang"), F.col("source").alias("k_source"), "n", *names).join(sizes, "language")
    # written first: joined by its constant name, the corpus-wide group would be a product of all tasks with all
    return stage_derived(_blended(stage_derived(keys), estimates(grouped)))


def verdict(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Counted rows with ``kept``: within the fixed limits and the distance."""
    same = F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))
    near = F.coalesce(F.least(_distance(), _distance(one_sided=True)) <= DISTANCE**2, F.lit(True))
    return rows.join(params, same, "left").withColumn("kept", ~F.col("base_failed") & near).drop("k_lang", "k_source", *_PARAMS)


def rule_results(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every row."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    rows = stage_derived(counted(narrow))
    return verdict(rows, fit(rows)).select("doc_id", *COUNTS[:-1], "base_failed", "kept")


def keep_sound(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    Texts are counted twice, once to fit and once to decide, so that none is
    shuffled. The documents' columns travel under names of their own.
    """
    pair = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    narrow = stage_derived(counted(docs.select("text", *pair)))
    own = {c: f"__doc{i}" for i, c in enumerate(docs.columns)}
    rows = counted(docs.select(*[F.col(c).alias(n) for c, n in own.items()], *pair), own["text"], keep_text=True)
    return verdict(rows, fit(narrow)).filter("kept").select(*[F.col(n).alias(c) for c, n in own.items()])

"""Toxicity by compression: two zstandard dictionaries and their lengths.

The ordinary dictionary is trained on windows of ordinary texts. The toxic one
is trained on windows around the words that toxic texts use significantly more
often than ordinary ones (without the ordinary words in them), followed by
those words themselves, each once, and also holds the ordinary content, so that a window compresses
alike under both unless toxic wording occurs in it. A text is cut into windows
of ``WINDOW`` words; its statistic is the mean number of bytes, above one,
that the toxic dictionary saves per window. A held part of the training labels
calibrates the statistic to a score by isotonic regression over fixed bins.

Training uses a bounded sample of labelled rows (``SAMPLE``, by a hash of the
id). Near copies in it count once (same smallest three-word shingle), so that
a copied text does not make its own words look typical. What reaches the
driver has fixed bounds: the sample's ids, ``WORDS`` words, ``WINDOWS``
windows of at most ``WINDOW_BYTES`` bytes, ``BINS`` counts.

Defined cases: NULL or wordless text has the statistic of no saving; NULL
labels teach nothing; an id labelled twice teaches twice; without labels of
both kinds, or without typical words, every score is the share of toxic labels
(0.0 without any); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded_sample, fields, fold, slices, stage_derived, text_bytes
from tessera.llm.near_dedup import shingle_set
from tessera.llm.quality import isotonic

SAMPLE = 20_000
WORDS, WINDOWS, WINDOW_BYTES = 2_000, 100_000, 400
#: Words per window; least likelihood-ratio z, frequency ratio and toxic texts
#: of a typical word. The z is high, as all words of the corpus are tested and few texts overstate it.
WINDOW, TYPICAL, RATIO, SUPPORT_ROWS = 5, 6.5, 4.0, 4
#: The trained parts; all typical words are appended to the toxic one.
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 24_576, 4_096, 3
BINS = 300
_STRIP = b".,;:!?\"'()"


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of lower-cased words, with a space at either end."""
    words = text.lower().split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)]


class ToxicityModel:
    """Both dictionaries and the calibration; compressors are made per task."""

    def __init__(self, ordinary: bytes, toxic: bytes, base_rate: float):
        self.ordinary, self.toxic = ordinary, toxic
        self.steps = (np.array([0.0]), np.array([base_rate]))
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def _compressors(self):
        if self._tools is None:
            options = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            made = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=options).compress)
            self._tools = made
        return self._tools

    def saving(self, text: bytes) -> float:
        """Mean bytes above one that the toxic dictionary saves per window."""
        if not self.toxic:
            return 0.0
        plain, toxic = self._compressors()
        cut = windows(text)
        return sum(max(0, len(plain(w)) - len(toxic(w)) - 1) for w in cut) / len(cut) if cut else 0.0

    def score(self, saving: np.ndarray) -> np.ndarray:
        return np.interp(position(saving), *self.steps)


def position(saving: np.ndarray) -> np.ndarray:
    """Savings on a logarithmic scale, 0 to ``BINS``."""
    return np.minimum(BINS - 1.0, 40 * np.log1p(50 * np.asarray(saving, dtype=float)))


def _sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Labelled texts of the sample with a key that near copies share."""

    def work(batches):
        for batch in slices(batches):
            keys = []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, 3)
                keys.append(int(found[0] >> np.uint64(1)) if len(found) else -1)
            yield fields(["label", "check", "text", "key"], [*[batch.column(i) for i in range(3)], pa.array(keys, pa.int64())])

    read = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).join(F.broadcast(labels), "doc_id")
    return read.select(label, "check", "text").mapInArrow(work, "label int, check boolean, text binary, key long")


def _word_counts(rows: DataFrame) -> DataFrame:
    """In how many texts of either kind each word occurs."""

    def work(batches):
        for batch in slices(batches):
            words = [sorted({w.strip(_STRIP) for w in (t or b"").lower().split()}) for t in batch.column(1).to_pylist()]
            yield fields(["label", "words"], [batch.column(0), pa.array(words, pa.list_(pa.binary()))])

    listed = rows.select("label", "text").mapInArrow(work, "label int, words array<binary>")
    flat = listed.select("label", F.explode("words").alias("word"))
    return flat.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("plain"))


def typical_words(rows: DataFrame) -> list[tuple[bytes, int]]:
    """Words with a significantly larger share of toxic texts, at most ``WORDS``."""
    n_toxic, n_plain = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).head()
    if not n_toxic or not n_plain:
        return []
    p, q = F.col("toxic") / float(n_toxic), (F.col("plain") + 1) / float(n_plain + 2)
    others = (float(n_toxic) - F.col("toxic")) * F.log(F.greatest(1 - p, F.lit(1e-12)) / (1 - q))
    z = F.sqrt(F.greatest(F.lit(0.0), 2 * (F.col("toxic") * F.log(p / q) + others)))
    often = F.col("toxic") >= SUPPORT_ROWS
    found = _word_counts(rows).filter("word <> X''").filter(often & (p >= RATIO * q)).withColumn("z", z).filter(F.col("z") >= TYPICAL)
    return [(bytes(r["word"]), int(r["toxic"])) for r in found.orderBy(F.desc("z"), "word").limit(WORDS).collect()]


def _ordinary_windows(rows: DataFrame) -> list[bytes]:
    def work(batches):
        for batch in slices(batches):
            flat = [w[:WINDOW_BYTES] for t in batch.column(0).to_pylist() for w in windows(t or b"", 2 * WINDOW)]
            yield fields(["window"], [pa.array(flat, pa.binary())])

    cut = rows.filter("label = 0").select("text").mapInArrow(work, "window binary")
    return [bytes(r[0]) for r in cut.orderBy(F.xxhash64("window"), "window").limit(WINDOWS).collect()]


def _typical_windows(rows: DataFrame, words: list[bytes]) -> list[bytes]:
    """Windows of toxic texts around typical words, without their other words."""
    typical = frozenset(words)

    def work(batches):
        for batch in slices(batches):
            flat = []
            for text in batch.column(0).to_pylist():
                for window in windows(text or b""):
                    own = [x for x in (w.strip(_STRIP) for w in window.split()) if x in typical]
                    if own:
                        flat.append((b" " + b" ".join(own) + b" ")[:WINDOW_BYTES])
            yield fields(["window"], [pa.array(flat, pa.binary())])

    cut = rows.filter("label = 1").select("text").mapInArrow(work, "window binary")
    return [bytes(r[0]) for r in cut.orderBy(F.xxhash64("window"), "window").limit(WINDOWS).collect()]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def _calibration(rows: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    def work(batches):
        counts = np.zeros((2, BINS))
        for batch in slices(batches):
            at = position([model.saving(t or b"") for t in batch.column(1).to_pylist()]).astype(int)
            counts += [np.bincount(at, minlength=BINS), np.bincount(at, batch.column(0).to_numpy(zero_copy_only=False), BINS)]
        yield fields(["bin", "n", "bad"], [pa.array(range(BINS), pa.int32()), pa.array(counts[0]), pa.array(counts[1])])

    sums = np.zeros((2, BINS))
    parts = rows.select("label", "text").mapInArrow(work, "bin int, n double, bad double")
    for row in parts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect():
        sums[:, row["bin"]] = row["n"], row["bad"]
    used = np.nonzero(sums[0])[0]
    return used + 0.0, isotonic(sums[0][used], sums[1][used] / sums[0][used])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Dictionaries and calibration from at most ``sample`` labelled rows; a quarter calibrates."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int")).dropna()
    chosen = bounded_sample(known, sample).withColumn("check", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    rows = stage_derived(_sample(docs, chosen, label))
    rate = rows.agg(F.avg("label")).head()[0] or 0.0
    learn = rows.filter("not check").dropDuplicates(["label", "key"])
    words = typical_words(learn)
    toxic = b""
    if words:  # the trainer keeps few of so repetitive samples, so each word follows once, the most typical last
        trained = _trained(_typical_windows(learn, [w for w, _ in words]), TOXIC_BYTES)
        toxic = trained + b"".join(b" " + w[:WINDOW_BYTES] + b" " for w, _ in reversed(words))
    model = ToxicityModel(_trained(_ordinary_windows(learn), ORDINARY_BYTES) if toxic else b"", toxic, float(rate))
    if toxic:
        steps = _calibration(rows.filter("check"), model)
        if len(steps[0]):
            model.steps = steps
    return model


def scorer(model: ToxicityModel) -> Column:
    """Column function: text bytes to a score in [0, 1]."""

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        saved = [model.saving(t) if isinstance(t, (bytes, bytearray)) else 0.0 for t in texts]
        return pd.Series(model.score(np.array(saved)))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row.

    Labels of ids whose crc32 leaves ``held`` modulo ``parts`` are not used.
    """
    model = fit(docs, labels.filter(fold("doc_id", parts) != held))
    out = docs.select(
        F.col("doc_id").cast("long"), (fold("doc_id", parts) == held).alias("held_out"), scorer(model)(text_bytes()).alias("score")
    )
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Secrets in texts: fixed patterns, and tokens that look random.

Base spans come from three patterns. Further candidates are runs of 20 or more
characters of an encoding; each gets a battery of three tests of randomness
over the alphabet it uses (hex in lower, upper or mixed case, base32, one case
with digits, alphanumeric, base64, base64url). Dashes between runs of hex, as
in a UUID, are separators:
chi-squared uniformity, the runs test about the alphabet's middle, and lag-one
serial correlation. A candidate becomes a span ``random`` when

* the battery does not refute randomness (smallest of the three p-values,
  Bonferroni corrected, at least ``LEVEL``), and
* it is a discovery against ordinary text: the p-value of so even a use of
  letters in a token of that length drawn from the corpus's own character
  counts (chi-squared, non-central; for hex also the chance that letters of
  its case are all a to f) passes a weighted Benjamini-Hochberg step
  over all candidates of the corpus, weights in proportion to length, as long
  tokens can be told apart better.

Character counts, the number and mean length of candidates and the histogram
of weighted p-values cover all documents and have fixed sizes.

Defined cases: NULL text counts as empty; an empty text has no spans and the
digest of the empty string; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fields, slices, stage_derived, text_bytes

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

#: Alphabets by name: members in the order of their values.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _UPPER.lower(),
    "upper36": _DIGITS + _UPPER,
    "upper_hex": _DIGITS + "ABCDEF",
    "mixed_hex": _DIGITS + "abcdefABCDEF",
    "alphanumeric": _UPPER + _UPPER.lower() + _DIGITS,
    "base64": _UPPER + _UPPER.lower() + _DIGITS + "+/",
    "base64url": _UPPER + _UPPER.lower() + _DIGITS + "-_",
    "base66": _UPPER + _UPPER.lower() + _DIGITS + "+/-_",
}
_DASHED_HEX = re.compile(r"[0-9a-fA-F]{2,}(?:-[0-9a-fA-F]{2,})+")
#: Narrowest first.
_ORDER = ("hex", "upper_hex", "mixed_hex", "base32", "base36", "upper36", "alphanumeric", "base64", "base64url", "base66")
#: Share of false discoveries among the added spans, and level of the battery.
FDR, LEVEL = 0.01, 0.001
#: Weighted p-values are counted in bins of a tenth of a decade, the last open.
BINS, PER_DECADE = 600, 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(token: str) -> str | None:
    """Narrowest alphabet that holds the token; None for plain digits or letters of one case."""
    kinds = {"l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in token}
    if len(kinds) == 1 or not kinds & {"l", "u"}:
        return None
    used = set(token)
    return next(name for name in _ORDER if used <= set(ALPHABETS[name]))


def symbols(token: str) -> str:
    """The token's characters that carry its value: without the dashes of dashed hex."""
    return token.replace("-", "") if _DASHED_HEX.fullmatch(token) else token


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_cube(x: float, df: float, shift: float = 0.0) -> float:
    """z-value of a (non-central) chi-squared statistic by the cube-root rule."""
    mean, spread = df + shift, df + 2 * shift
    h = 1 - 2 * (df + shift) * (df + 3 * shift) / (3 * spread**2)
    p = spread / mean**2
    m = (h - 1) * (1 - 3 * h)
    return ((x / mean) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))


def battery(token: str, alphabet: str) -> tuple[float, float]:
    """Chi-squared statistic of uniformity, and the battery's combined p-value."""
    n, size = len(token), len(alphabet)
    values = np.array([alphabet.index(c) for c in token])
    counts = np.bincount(values, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    uneven = _tail(_chi_cube(max(chi, 1e-9), size - 1))
    high = values >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        mean = 2 * ups * downs / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _tail(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        runs = 2.0 ** (1 - n)
    spread = values - values.mean()
    total = float((spread**2).sum())
    lag = float((spread[1:] * spread[:-1]).sum()) / total if total else 1.0
    serial = 2 * _tail(abs(lag + 1 / n) * math.sqrt(n))
    return chi, min(1.0, 3 * min(uneven, runs, serial))


def ordinary_tail(chi: float, length: int, size: int, unevenness: float) -> float:
    """-log10 of the chance that ordinary text of this length looks as even as ``chi``."""
    z = -_chi_cube(max(chi, 1e-9), size - 1, length * unevenness)
    p = _tail(z)
    # far tail by its leading term, so that the logarithm stays finite
    return -math.log10(p) if p > 1e-300 else (z * z / 2 + math.log(z * math.sqrt(2 * math.pi))) / math.log(10)


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each ASCII byte occurs in the whole corpus (128 sums)."""

    def work(batches):
        total = np.zeros(128, dtype=np.int64)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(text or b"", dtype=np.uint8), minlength=256)[:128]
        yield fields(["code", "n"], [pa.array(range(128), pa.int32()), pa.array(total)])

    counts = np.zeros(128)
    parts = docs.select(text_bytes()).mapInArrow(work, "code int, n long")
    for row in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[row["code"]] = row["n"]
    return counts


def unevenness(counts: np.ndarray) -> dict[str, float]:
    """Non-centrality that ordinary text gives each alphabet, per character."""
    out = {}
    for name, alphabet in ALPHABETS.items():
        own = np.array([counts[ord(c)] for c in alphabet]) + 0.5
        share = own / own.sum()
        out[name] = float((share**2).sum() * len(alphabet) - 1)
    return out


def hex_letters(counts: np.ndarray) -> dict[str, float]:
    """-log10 of the share of a to f in ordinary letters, for each hex alphabet."""
    lower, upper = counts[97:123] + 0.5, counts[65:91] + 0.5
    cases = {"hex": lower, "upper_hex": upper, "mixed_hex": lower + upper}
    return {name: -math.log10(own[:6].sum() / own.sum()) for name, own in cases.items()}


def scan(docs: DataFrame, uneven: dict[str, float], letters: dict[str, float]) -> DataFrame:
    """Base spans of every text and its candidates with both p-values."""

    def work(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                cover = [(s, e) for s, e, _ in base]
                tokens = []
                for m in _TOKEN.finditer(text):
                    body = symbols(m[0])
                    name = encoding_of(body)
                    if name is None or any(s < m.end() and m.start() < e for s, e in cover):
                        continue
                    chi, random = battery(body, ALPHABETS[name])
                    odds = ordinary_tail(chi, len(body), len(ALPHABETS[name]), uneven[name])
                    if name in letters:
                        odds += letters[name] * sum(c.isalpha() for c in body)
                    tokens.append({"start": m.start(), "end": m.end(), "random": random, "odds": odds})
                named = [f"{k}:{s}:{e}" for s, e, k in base]
                digest = hashlib.sha256(",".join(named).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS), digest, [{"start": s, "end": e, "kind": k} for s, e, k in base], tokens))
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(_BASE), pa.list_(_CANDIDATE)]
            yield fields(
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens"],
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types)]],
            )

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "base array<struct<start: long, end: long, kind: string>>, "
        "tokens array<struct<start: long, end: long, random: double, odds: double>>"
    )
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


_BASE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("random", pa.float64()), ("odds", pa.float64())])


def discovery_limit(scanned: DataFrame, fdr: float = FDR) -> tuple[float, float]:
    """Mean candidate length and least weighted -log10 p of a discovery.

    Benjamini-Hochberg over the histogram of weighted p-values, each taken at
    its bin's larger end.
    """
    tokens = scanned.select(F.explode("tokens").alias("t")).select(
        (F.col("t.end") - F.col("t.start")).alias("length"), F.col("t.odds").alias("odds")
    )
    total, mean = tokens.agg(F.count("*"), F.avg("length")).head()
    if not total:
        return 1.0, math.inf
    weighted = F.col("odds") + F.log10(F.col("length") / F.lit(float(mean)))
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(weighted * PER_DECADE))).alias("bin")
    counts = np.zeros(BINS)
    for row in tokens.groupBy(place).count().collect():
        counts[int(row["bin"])] = row["count"]
    above = counts[::-1].cumsum()[::-1]
    edges = np.arange(BINS) / PER_DECADE
    with np.errstate(divide="ignore"):
        passed = (above > 0) & (np.power(10.0, -edges) * total <= fdr * above)
    return float(mean), float(edges[passed.argmax()]) if passed.any() else math.inf


def secret_spans(docs: DataFrame, fdr: float = FDR, level: float = LEVEL) -> DataFrame:
    """One row per document: base counts and digest, and all spans as text.

    Scans the texts twice (character counts, then spans) and keeps the narrow
    second result in the shared folder; no text is shuffled.
    """
    counts = character_counts(docs)
    scanned = stage_derived(scan(docs, unevenness(counts), hex_letters(counts)))
    mean, least = discovery_limit(scanned, fdr)
    weighted = lambda t: t["odds"] + F.log10((t["end"] - t["start"]) / F.lit(mean))
    accepted = F.filter("tokens", lambda t: (t["random"] >= F.lit(level)) & (weighted(t) >= F.lit(least)))
    order = {k: i for i, k in enumerate((*KINDS, "random"))}
    ranks = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("s"), ranks[s["kind"]].alias("r"), s["kind"].alias("k"), s["end"].alias("e")))
    added = F.transform(accepted, lambda s: F.struct(s["start"].alias("s"), F.lit(len(KINDS)).alias("r"), F.lit("random").alias("k"), s["end"].alias("e")))
    spans = F.array_sort(F.concat(base, added))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(accepted).cast("long").alias("n_random")
    )

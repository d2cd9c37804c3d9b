"""Personal data: fixed patterns, and boosted trees over further candidates.

Generators of high recall propose spans that may overlap: loose addresses
(also spelt "name at host dot tld"), dotted numbers, and digit runs with
separators. Each candidate is described by its format (length, digits,
separators, group shape, checksum) and context (neighbouring characters, cue
words before it). Boosted trees, trained on a bounded sample of the corpus's
own candidates, score it.

What the base patterns validate is never added, so it teaches only in other
spellings: each base span is written anew in its own place without what the
pattern asks for (``respelt``: no plus, no @, other separators; a wrong octet
or check digit beside a cue word, or in groups of four; a cue word),
and what the generators then propose is a positive example. Negative examples
are random strings of the generators' own syntax in the same places
(``random_forms``). Candidates of the corpus that touch no base span are
unlabelled: only those that a first fit scores below nearly every positive
become negatives of the second one. The threshold of each generator is the
least score from which precision, unlabelled candidates counting as positive
by their score, reaches ``PRECISION``, counted over held examples and all
documents' candidates.
Candidates above it that touch no base span become spans of kind ``likely``,
the best-scored first where they overlap one another.

Defined cases: NULL text counts as empty; an empty text has no spans and the
digest of the empty string; without positive examples no span is added; a
repeated row gives a repeated result; other columns are passed over, and
``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.boosting import BoostedTrees
from tessera.llm.common import fields, slices, stage_derived, thinned

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_SPELT_DOT = r"(?:\s?[\[({]dot[\])}]\s?|\sdot\s)"
# runs of any length; possessive, so that a run is read once and never given back
_LOOSE_MAIL = re.compile(
    r"(?i)(?<![\w.%+-])[\w.%+-]++(?:(?:\s?@\s?|\s?[\[({]at[\])}]\s?)[\w-]++(?:(?:\.|\s\.\s|" + _SPELT_DOT + r")[\w-]++)++"
    r"|\sat\s[\w-]++(?:" + _SPELT_DOT + r"[\w-]++)++)"
)
_DOTTED = re.compile(r"(?<![\w.])\d++(?:(?:\.|[\[(]\.[\])]|\s?[\[({]dot[\])}]\s?)\d++(?!\w)){2,}+")
_DIGITS = re.compile(r"(?<![\w])\+?\(?\d++(?!\w)(?:[\x20().-]{1,2}+\d++(?!\w))*+")
GENERATORS = (("mail", _LOOSE_MAIL), ("dotted", _DOTTED), ("digits", _DIGITS))
#: Digits of a proposed run, at least.
DIGITS = 7
_SPELT_MAIL = re.compile(r"(?i)at[\])}]|\sdot\s")
_CUES = re.compile(r"(?i:mail|phone|tel|call|fax|card|visa|account|ip|host|addr|contact|ssn|id)\b")

_ENDINGS = ("com", "org", "net", "de", "fr", "io", "es", "info", "co.uk")
_CALLS = ("tel ", "call ", "phone: ", "Tel.: ", "fax ", "mail ", "contact: ")

#: Candidates of each generator and label to train the trees on, at most.
SAMPLE = 7_000
PRECISION = 0.98
#: Scores are counted in so many bins; positives below the threshold at least.
BINS, MISSED = 1000, 0.01


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Address matches: each @ with the run before it, in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Validated spans of the fixed patterns, by kind and then start."""
    found = [("email", s, e) for s, e in _emails(text)]
    if not any(c in text for c in "0123456789"):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposed spans (generator, start, end); they may overlap."""
    out = []
    for g, (_, pattern) in enumerate(GENERATORS):
        if g and not any(c in text for c in "0123456789"):
            break
        if g == 0 and "@" not in text and not _SPELT_MAIL.search(text):
            continue
        found = pattern.finditer(text)
        if pattern is _DIGITS:
            found = (m for m in found if m.end() - m.start() >= DIGITS and sum(map(str.isdigit, m[0])) >= DIGITS)
        out += [(g, *m.span()) for m in found]
    return out


def respelt(kind: str, body: str, rng: random.Random) -> list[str]:
    """Spellings of a base span that its pattern does not match."""
    if kind == "email":
        local, _, domain = body.partition("@")
        short = re.split(r"[._%+-]", local)[0] or local
        names = domain.split(".")
        ways = ((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "(dot)"))
        out = []
        for at, dot in ways:
            end = names if rng.random() < 0.3 else [*names[-2 if rng.random() < 0.5 else 0 : -1], rng.choice(_ENDINGS)]
            out.append(rng.choice((local, short, short + str(rng.randrange(100)))) + at + dot.join(end))
        return out
    if kind == "ip":
        parts = body.split(".")
        parts[rng.randrange(len(parts))] = str(rng.randrange(256, 1000))
        return [*[body.replace(".", dot) for dot in ("[.]", "(dot)", " [dot] ")], rng.choice(("ip ", "host ", "IP: ", "addr ")) + ".".join(parts)]
    groups = re.findall(r"[0-9]+", body)
    digits = "".join(groups)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randrange(1, 10)) % 10)
        split = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        cued = [rng.choice(("card ", "visa ", "Card: ", "account ")) + w for w in (wrong, " ".join(split))]
        return [*[sep.join(fours) for sep in (".", "  ", ". ")], "-".join(split), " ".join(split), *cued]
    area, middle, last = groups[1:] if len(groups) == 4 else (digits[-10:-7], digits[-7:-4], digits[-4:])
    short, longer = f"{middle}-{last}", f"{digits[-8:-4]} {digits[-4:]}"
    full = [body[1:], *[sep.join((area, middle, last)) for sep in "-. "], f"({area}) {middle}-{last}", f"({area}) {middle} {last}", f"({area}){middle}{last}"]
    cued = [rng.choice(_CALLS) + way for way in (area + middle + last, middle + last, digits[-8:], short, longer, rng.choice(full))]
    return [*full, short, f"{middle} {last}", longer, longer.replace(" ", "-"), *cued]


def random_forms(rng: random.Random) -> list[str]:
    """Strings that follow the syntax of each generator and nothing else."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("aeinorst") for _ in range(n))
    part = lambda: rng.choice((digits, letters))(rng.randrange(1, 13))
    out = [part() + rng.choice(("@", " @ ", "(at)", " [at] ")) + rng.choice((".", "(dot)", " [dot] ")).join(part() for _ in range(rng.randrange(2, 5)))]
    dot = rng.choice((".", ".", ".", "[.]", "(dot)"))
    out += [dot.join(digits(rng.randrange(1, 7)) for _ in range(rng.randrange(3, 9))) for _ in range(2)]
    for _ in range(6):
        seps = rng.choice(("-", " ", ".", "-. ", "(-) "))
        out.append("".join(digits(rng.randrange(1, 9)) + rng.choice(seps) for _ in range(rng.randrange(1, 6))) + digits(rng.randrange(1, 9)))
    return [*out, digits(rng.randrange(7, 30)), digits(rng.randrange(7, 30))]


def examples(text: str, kind: str, start: int, end: int) -> list[tuple[int, int, list[float]]]:
    """Label, generator and features of what is proposed in place of a base span."""
    out = []
    rng = random.Random(zlib.crc32(text[max(0, start - 60) : end].encode("utf-8", "replace")))
    before, after = text[max(0, start - 60) : start], text[end : end + 20]
    if rng.random() < 0.2:
        before += rng.choice(_CALLS)
    ways = [(1, w) for w in dict.fromkeys(respelt(kind, text[start:end], rng))] + [(0, w) for w in random_forms(rng)]
    for label, way in ways:
        near, low, high = before + way + after, len(before), len(before) + len(way)
        touched = [(b, f) for _, b, f in base_spans(near) if b < high and low < f]
        for g, s, e in candidates(near):
            if min(e, high) - max(s, low) >= 0.5 * max(e - s, high - low) and not any(b < e and s < f for b, f in touched):
                out.append((label, g, describe(near, g, s, e)))
    return out


def describe(text: str, generator: int, start: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    body = text[start:end]
    digits = sum(c.isdigit() for c in body)
    groups = re.findall(r"\d+", body)
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
    tail = 0
    while tail < len(body) and (c := body[-1 - tail]).isalnum() and not c.isdecimal():
        tail += 1
    return [
        float(generator), float(end - start), float(digits), digits / max(1, end - start), float(len(groups)),
        float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(max((int(g[:6]) for g in groups), default=0)), float(body.count(".")), float(body.count("-")), float(body.count(" ")),
        float("@" in body), float(body.startswith("+")), float("(" in body),
        float(tail), float(len(set(body)) / max(1, len(body))),
        float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(13 <= digits <= 19 and _luhn("".join(groups))), float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(bool(_SPELT_MAIL.search(body))), float("dot" in body.lower() or "[.]" in body),
        float(before.isspace()), float(after.isspace()), float(after in ".,;:!?"),
        float(bool(_CUES.search(text[max(0, start - 30) : start]))),
    ]


def candidate_table(docs: DataFrame) -> DataFrame:
    """Examples in place of base spans (``valid`` 1 or 0), and candidates that touch no base span (NULL)."""

    def work(batches):
        for batch in slices(batches):
            ids, rows, good, kinds = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                base = base_spans(text)
                found = [x for span in base for x in examples(text, *span)]
                free = [c for c in candidates(text) if not any(b < c[2] and c[1] < f for _, b, f in base)]
                found += [(None, g, describe(text, g, s, e)) for g, s, e in free]
                for valid, g, x in found:
                    ids.append(doc_id)
                    kinds.append(g)
                    rows.append(x)
                    good.append(valid)
            yield fields(
                ["doc_id", "generator", "features", "valid"],
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(good, pa.int32())],
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(work, "doc_id long, generator int, features array<double>, valid int")


def trees(x: np.ndarray, y: np.ndarray) -> BoostedTrees:
    """Trees from examples and unlabelled rows (NaN), of which the sure negatives teach."""
    known = ~np.isnan(y)
    first = BoostedTrees().fit(x[known], y[known])
    scores = first.score(x)
    sure = np.isnan(y) & (scores < min(0.5, np.quantile(scores[y == 1], MISSED)))
    return BoostedTrees().fit(x[known | sure], np.where(known, y, 0.0)[known | sure])


def bin_of(scores: np.ndarray) -> np.ndarray:
    """Score bins, evenly spaced in log odds, so that both ends are told apart."""
    p = np.clip(scores, 1e-9, 1 - 1e-9)
    return np.clip((np.log(p / (1 - p)) + 12) / 24 * BINS, 0, BINS - 1).astype(int)


def least_bin(positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray, precision: float = PRECISION) -> int:
    """Least bin from which the precision is reached; ``BINS`` for none.

    Unlabelled candidates of a bin are positive by its score. The least score
    is one that all but ``MISSED`` of the positives reach.
    """
    share = 1 / (1 + np.exp(12 - 24 * (np.arange(BINS) + 0.5) / BINS))
    from_here = lambda counts: counts[::-1].cumsum()[::-1]
    good, everything = from_here(positive + share * unlabelled), from_here(positive + negative + unlabelled)
    passed = (everything > 0) & (good >= precision * everything)
    if not positive.sum() or not passed.any():
        return BINS
    reached = np.nonzero(from_here(positive) >= (1 - MISSED) * positive.sum())[0][-1]
    return int(max(passed.argmax(), reached))


def _training_rows(table: DataFrame, sample: int) -> list:
    """At most ``sample`` candidates of each generator and label, chosen by a hash of the id."""
    learn, out = table.filter("not held"), []
    for g in range(len(GENERATORS)):
        for label in ("valid = 1", "valid = 0", "valid is null"):
            own = thinned(learn.filter((F.col("generator") == g) & F.expr(label)), 2 * sample)
            out += own.orderBy(F.xxhash64("doc_id", "features"), "doc_id").limit(sample).select("features", "valid").collect()
    return out


def score_counts(table: DataFrame, model: BoostedTrees) -> np.ndarray:
    """Candidates by generator, label (1, 0, unlabelled) and score bin, over all rows of ``table``."""

    def work(batches):
        counts = np.zeros((len(GENERATORS), 3, BINS), dtype=np.int64)
        for batch in slices(batches, 4096):
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            label = np.array([2 if v is None else 1 - v for v in batch.column(2).to_pylist()], dtype=int)
            at = bin_of(model.score(np.array(batch.column(1).to_pylist(), dtype=float)))
            np.add.at(counts, (kind, label, at), 1)
        cell = np.nonzero(counts.ravel())[0]
        yield fields(["cell", "n"], [pa.array(cell, pa.int64()), pa.array(counts.ravel()[cell], pa.int64())])

    total = np.zeros((len(GENERATORS), 3, BINS), dtype=np.int64)
    parts = table.select("generator", "features", "valid").mapInArrow(work, "cell long, n long")
    for row in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total.ravel()[row["cell"]] = row["n"]
    return total


def fit(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> tuple[BoostedTrees, list[int]] | None:
    """Trees and a least score bin per generator.

    The trees learn from at most ``sample`` candidates of each generator and
    label, from two thirds of the documents. Thresholds come from histograms
    of scores: the other third's examples and every document's unlabelled
    candidates. Writes the candidates to the shared folder.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    table = stage_derived(candidate_table(docs).withColumn("held", held))
    rows = _training_rows(table, sample)
    y = np.array([np.nan if r["valid"] is None else r["valid"] for r in rows], dtype=float)
    if len(rows) < 50 or not (y == 1).any():
        return None
    model = trees(np.array([r["features"] for r in rows], dtype=float), y)
    counts = score_counts(table.filter("held or valid is null"), model)
    return model, [least_bin(*own, precision) for own in counts]


def all_spans(texts: Sequence[str], model: tuple[BoostedTrees, list[int]] | None) -> list[list[tuple[str, int, int]]]:
    """Base and added spans of each text, base first, by kind and then start."""
    out, asked = [base_spans(t) if t else [] for t in texts], []
    if model is None:
        return out
    for i, text in enumerate(texts):
        for g, s, e in candidates(text) if text else []:
            if not any(b < e and s < f for _, b, f in out[i]):
                asked.append((i, g, s, e))
    if asked:
        scores = model[0].score(np.array([describe(texts[i], g, s, e) for i, g, s, e in asked]))
        best = sorted((-p, i, s, e) for p, b, (i, g, s, e) in zip(scores, bin_of(scores), asked) if b >= model[1][g])
        taken: dict[int, list[tuple[int, int]]] = {}
        for _, i, s, e in best:
            own = taken.setdefault(i, [])
            if not any(a < e and s < b for a, b in own):
                own.append((s, e))
        for i, own in taken.items():
            out[i] += [("likely", s, e) for s, e in sorted(own)]
    return out


def pii_spans(docs: DataFrame, **options) -> DataFrame:
    """One row per document: base counts and digest, and all spans as text."""
    model = fit(docs, **options)

    def work(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for found in all_spans(texts, model):
                named = [f"{k}:{s}:{e}" for k, s, e in found]
                base = [n for n, f in zip(named, found) if f[0] in KINDS]
                kinds = [k for k, _, _ in found]
                rows.append((*(kinds.count(k) for k in (*KINDS, "likely")), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(named)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield fields(
                ["doc_id", *(f"n_{k}" for k in (*KINDS, "likely")), "base_sha256", "spans"],
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types)]],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_likely long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def cleaned(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """A text with each span replaced by its kind in angle brackets.

    Overlapping spans are replaced as one, under the kind that starts first.
    """
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with personal data replaced in ``text``; ``n_chars`` follows it. NULL stays NULL.

    Rows pass through the tasks in small slices of their Arrow batches.
    """
    model, at = fit(docs, **options), docs.columns.index("text")
    schema = T.StructType([T.StructField("text", T.StringType()) if i == at else f for i, f in enumerate(docs.schema.fields)])

    def work(batches):
        for batch in slices(batches, 64):
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], model)
            clean = pa.array([cleaned(t, s) for t, s in zip(texts, found)], pa.string())
            yield fields(schema.names, [clean if i == at else c for i, c in enumerate(batch.columns)])

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(work, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out

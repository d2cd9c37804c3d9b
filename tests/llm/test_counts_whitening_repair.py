"""Token counts, whitening and conversation repair against plain Python on small fixtures, with their defined cases."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import repair, token_counts, whitening
from tessera.llm.queries import QUERIES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

# token counts


def library_counts(texts):
    tool = Tokenizer.from_file(BYTE_BPE)
    return [len(e.ids) for e in tool.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(spark, rows, limit=1024):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    found = token_counts.token_counts(docs, BYTE_BPE, limit)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())


def expected(rows, limit=1024):
    return sorted((str(i), len((t or "").encode()), n, n > limit) for (i, t), n in zip(rows, library_counts([t for _, t in rows])))


PIECES = [
    "a", "B", "word", "é", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "'s", "'", "'re", "12", "²", "!", "...",
    "<|endoftext|>", "<|", "漢字", chr(0x558), chr(0x107BB), chr(0x3000), chr(0x200B), "😀", "e" + chr(0x301),
]


def test_counts_equal_the_library_on_random_texts(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(1500)]
    rows = list(enumerate(texts))
    assert counted(spark, rows) == expected(rows)


def test_counts_of_odd_rows(spark):
    rows = [
        (None, "no id"), (1, None), (2, ""), (3, " "), (4, " \n "), (5, "same row"), (5, "same row"), (6, "same row"),
        (7, "x" * 30_000), (8, "many words " * 20_000), (9, "<|endoftext|>" * 3), (10, "tail "),
    ]
    assert counted(spark, rows) == expected(rows)
    assert counted(spark, rows[5:8], limit=2) == expected(rows[5:8], limit=2)


def test_counts_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, BYTE_BPE).collect() == []
    only_empty = [(1, None), (2, "")]
    assert counted(spark, only_empty) == expected(only_empty)


def test_small_blocks_and_groups_give_the_same_counts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(PIECES) + str(rng.randrange(50)) for _ in range(200))) for i in range(60)]
    counter = token_counts.PieceCounter(BYTE_BPE)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    block = token_counts._Block(counter)
    for i, t in rows[:7]:
        block.add(i, t)
    for buckets in (1, 5, 1000):
        row = block.row(0, buckets).to_pylist()[0]
        assert sum(len(token_counts._unpack(s["lengths"])) for s in row["sets"]) == len(set(block.flat))
        assert row["sizes"] == [len(t.encode()) for _, t in rows[:7]]
    blocks = token_counts.frequency_blocks(docs, counter, 9)
    assert blocks.count() == 1


def test_every_code_point_is_cut_as_the_tokenizer_cuts_it():
    from tokenizers import pre_tokenizers

    counter = token_counts.PieceCounter(BYTE_BPE)
    own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in [*range(0x3100), *range(0xA000, 0xD800, 7), *range(0xE000, 0x11000, 5), *range(0x11000, 0x110000, 997)]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1{chr(c)}! {chr(c)} "
            assert counter.words(text) == [text[a:b] for _, (a, b) in own(text)], hex(c)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PieceCounter(public_tokenizers.path("word_bpe_49k.json"))


# whitening


def vectors(n=90, d=20, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d)) @ np.diag(np.linspace(3, 0.3, d)) + rng.standard_normal(d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    return [*rows, (n, rows[0][1]), (n + 1, rows[0][1])]


def by_hand(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, basis = values[order], basis[:, order]
    return x, n, s, values, ((x - s / n) @ basis)[:, :16] / np.sqrt(values[:16])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, whitened double")


def test_whitened_rows_match_an_eigensolver(spark):
    rows = vectors()
    found = sorted(whitening.whitened_rows(frame(spark, rows)).collect(), key=lambda r: (r.vec_id, r.component))
    x, n, s, values, expected_rows = by_hand(rows)
    assert len(found) == 16 * len(rows) and {r.n for r in found} == {n} == {90}
    got = np.array([r.whitened for r in found]).reshape(len(rows), 16)
    sign = np.sign((got * expected_rows).sum(axis=0))
    np.testing.assert_allclose(got * sign, expected_rows, atol=1e-8)
    np.testing.assert_allclose([r.explained for r in found[:16]], values[:16] / values.sum(), rtol=1e-10)
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert [r.deviation for r in found[::16]] == deviations
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-10
    twice = whitening.whitened_rows(frame(spark, [*rows, rows[3]]))
    assert twice.filter("vec_id = 3").count() == 32 and twice.filter("n = 90").count() == 16 * (len(rows) + 1)


def test_odd_vectors_take_no_part(spark):
    good = vectors(30, 5)
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, [1.0]), (505, [])]
    rows = [(r.vec_id, r.component, r.n, r.deviation) for r in whitening.whitened_rows(frame(spark, good + odd)).collect()]
    plain = [(r.vec_id, r.component, r.n, r.deviation) for r in whitening.whitened_rows(frame(spark, good)).collect()]
    assert sorted(rows) == sorted(plain) and {r[1] for r in rows} == {1, 2, 3, 4, 5}
    nameless = whitening.whitened_rows(frame(spark, [(None, good[0][1]), *good])).filter("vec_id IS NULL")
    assert nameless.count() == 5


def test_vectors_without_variance(spark):
    one = whitening.whitened_rows(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whitening.whitened_rows(frame(spark, [(i, [float(i), 2.0, -float(i)]) for i in range(9)])).collect()
    by_component = {r.component: (round(r.explained, 9), r.whitened is None) for r in line}
    assert by_component == {1: (1.0, False), 2: (0.0, True), 3: (0.0, True)}
    assert line[0].identity_error < 1e-10
    assert whitening.whitened_rows(frame(spark, [])).collect() == []
    assert whitening.whitened_rows(frame(spark, [(1, None)])).collect() == []


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(i, [float(2**30 * i), float(i % 3)]) for i in range(40)]
    found = {r.vec_id: r.deviation for r in whitening.whitened_rows(frame(spark, rows)).collect()}
    x, n, s, _, _ = by_hand(rows)
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s.tolist())) for row in x.tolist()]
    assert found == {i: v if v < 2**63 else None for i, v in enumerate(exact)} and None in found.values()


@pytest.mark.parametrize("values", [
    [5, 5, 5, 1], [1, 1, 1, 1], [1e6, 1, 1e-6, 0], [3, 3 - 1e-9, 3 - 2e-9, 2], [2, 0, 0, 0, 0, 0], list(range(1, 65)), [1] * 20 + [2] * 20,
])
def test_split_finds_components(values):
    rng = np.random.default_rng(1)
    basis, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = basis @ np.diag(np.array(values, dtype=float)) @ basis.T
    found, vectors_found = whitening.leading_components(matrix, min(16, len(values)))
    scale = max(values)
    np.testing.assert_allclose(found, sorted(values, reverse=True)[:16], atol=1e-12 * scale)
    np.testing.assert_allclose(vectors_found.T @ vectors_found, np.eye(len(found)), atol=1e-12)
    np.testing.assert_allclose(matrix @ vectors_found, vectors_found * found, atol=1e-11 * scale)


def test_polar_factor_is_orthogonal():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 40):
        a = rng.standard_normal((k, k))
        a = a + a.T
        u = whitening.polar_factor(a)
        np.testing.assert_allclose(u @ u.T, np.eye(k), atol=1e-12)
        assert np.linalg.eigvalsh(u @ a).min() > -1e-10


# conversation repair

WHITE = " \t\n\x0b\x0c\r"


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def repair_by_hand(rows):
    """Least cost, then least audit, by plain recursion over rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if inserted < 2:
            for letter, role in (("u", "user"), ("a", "assistant")):
                if letter in follow[state]:
                    cost, audit, lines = best(i, letter, inserted + 1)
                    options.append((cost + 5, "I" + audit, (f"{role}:",) + lines))
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                if role[:1] in follow[state]:
                    cost, audit, lines = best(i + 1, role[:1], 0)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}",) + lines))
                for letter, new in (("u", "user"), ("a", "assistant")):
                    if letter in follow[state]:
                        cost, audit, lines = best(i + 1, letter, 0)
                        options.append((cost + extra + 1, "R" + audit, (f"{new}:{text}",) + lines))
        return min(options) if options else (10**9, "~", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed=9, n=150, longest=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " \t", "", "why?", "fine. \n", None, "end.\x0b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", None, ""]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(longest)):
            role = roles[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(30)}."
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, audit int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def results(frame_found):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[c] for c in names) for r in frame_found.collect()}


def reports_by_hand(rows):
    left = damage_by_hand(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        out[conv] = repair_by_hand([r[1:] for r in left if r[0] == conv])
    return out


def test_damage_reports_match_plain_recursion(spark):
    rows = [*conversations(), (None, 0, "user", "x."), (None, None, "user", "x."), (None, 1, "assistant", "y."), (10**6, 3, None, None)]
    found = repair.damage_report(table_of(spark, rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got, by_hand_rows = results(found), reports_by_hand(rows)
    assert got.keys() == by_hand_rows.keys()
    wrong = {c: (got[c], by_hand_rows[c]) for c in got if got[c] != by_hand_rows[c]}
    assert not wrong, list(wrong.items())[:3]


@pytest.mark.parametrize("segment_rows", [1, 3])
def test_segments_of_few_rows_give_the_same_repair(spark, segment_rows):
    rows = [(c, t, r or " ", x or " ") for c, t, r, x in conversations(5, 60, 25)]
    report, repaired = repair.repair(table_of(spark, rows).drop("audit"), segment_rows)
    whole, _ = repair.repair(table_of(spark, rows).drop("audit"))
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    assert sorted(report.select(columns).collect()) == sorted(whole.select(columns).collect())
    by_conv = {}
    for c, t, r, x in rows:
        by_conv.setdefault(c, []).append((t, r, x))
    got = {r.conv_id: (r.cost, r.audit) for r in report.collect()}
    expected_rows = {c: repair_by_hand(own)[5:7] for c, own in by_conv.items()}
    assert got == expected_rows
    roles = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.position)):
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert all(re.fullmatch("s?(ua)+", v) for v in roles.values()) and roles


def test_one_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"row {i}.") for i in range(3000)]
    rows += [(1, 5000 + i, "user", "again.") for i in range(500)]
    report, repaired = repair.repair(table_of(spark, rows).drop("audit"), 100)
    found = report.collect()[0]
    assert (found.duplicate, found.cost, found.audit) == (499, 1000, "K" * 3000 + "D" * 500)
    assert repaired.count() == 3000 and found.gaps == 2000 and found.illegal == 499


def test_empty_and_wholly_dropped_conversations(spark):
    assert repair.damage_report(table_of(spark, [])).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = results(repair.damage_report(table_of(spark, [(gone, 0, "user", "x.")])))
    assert found == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("symbol", range(9))
def test_powers_equal_repeated_products(symbol):
    product = repair.UNIT
    for length in range(1, 20):
        product = repair.times(product, repair.power(symbol, 0))
        assert repair.run_matrix(symbol, length) == product


def test_given_tables_give_whole_results(spark):
    folder = "/root/testdata/sf0.001"
    talk = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in talk.select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op13_conversation_repair"](spark, folder)) == reports_by_hand(rows)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op11_token_counts"](spark, folder).collect()}
    assert counts == {i: n for (i, _), n in zip(docs, library_counts([t for _, t in docs]))}
    held = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, n, s, values, expected_rows = by_hand([tuple(r) for r in held])
    found = sorted(QUERIES["op12_embedding_whitening"](spark, folder).collect(), key=lambda r: (r.vec_id, r.component))
    got = np.array([r.whitened for r in found]).reshape(len(x), -1)
    expected_rows = expected_rows[np.argsort([r.vec_id for r in held])]
    np.testing.assert_allclose(np.abs(got), np.abs(expected_rows), atol=1e-6)

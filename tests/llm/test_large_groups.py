"""Near copies in large nodes, sources of few texts, one-sided verdicts, long candidates."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dedup, pii, rules
from tests.llm.test_brute_force import documents, groups_by_hand, words


def copies(rng, n, changed, length=60):
    """A text and copies of it with ``changed`` words replaced."""
    base = words(rng, length)
    out = []
    for _ in range(n):
        text = list(base)
        for at in rng.sample(range(length), changed):
            text[at] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("percent", [80, 55])
def test_large_groups_match_all_pairs(spark, monkeypatch, percent):
    """Groups far over a leaf and a block: linked, partly linked, and alike but below the threshold."""
    monkeypatch.setattr(near_dedup, "BLOCK", 24)
    rng = random.Random(31)
    texts = copies(rng, 120, 1) + copies(rng, 90, 3) + copies(rng, 90, 6) + copies(rng, 40, 10)
    texts += [" ".join(words(rng, rng.randrange(1, 80))) for _ in range(40)]
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts), 2, percent, leaf=2).collect()}
    assert found == groups_by_hand(texts, 2, percent)


def test_rows_of_every_tree_hold_numbers_only(spark, monkeypatch):
    """What is written and shuffled once per class and tree has neither fingerprints nor paths."""
    staged, write = [], near_dedup.stage_derived
    monkeypatch.setattr(near_dedup, "stage_derived", lambda df: staged.append(dict(df.dtypes)) or write(df))
    rng = random.Random(33)
    texts = list(enumerate(copies(rng, 60, 1) + copies(rng, 60, 6)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts), 2, 80, leaf=2).collect()}
    assert found == groups_by_hand(texts, 2, 80)
    by_tree = [d for d in staged if {"node", "members"} <= d.keys()]
    assert len(by_tree) > near_dedup.DEPTH and all(set(d.values()) == {"bigint"} for d in by_tree)


def test_texts_that_resemble_each_other_list_no_pairs(spark, monkeypatch):
    """Below the threshold most texts of such a group are likely links of each other; rows name texts, not pairs."""
    staged, write = [], near_dedup.stage_derived

    def counted(df):
        out = write(df)
        staged.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "stage_derived", counted)
    rng = random.Random(34)
    texts = list(enumerate(copies(rng, 300, 5) + copies(rng, 60, 1)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts), 2, 80, leaf=2).collect()}
    assert found == groups_by_hand(texts, 2, 80)
    assert max(n for _, n in staged) <= near_dedup.TREES * len(texts), staged


def test_a_likely_pair_is_settled_in_one_node():
    """Two texts of three shared nodes, a third that shares one with each; pieces of two blocks ask across them only."""
    nodes = {0: [9, 5, 7], 1: [7, 5, 9], 2: [9, 8, 3], 3: [6, 4, 2]}
    members = [(n, 0, 0, 0, c) for c, own in nodes.items() for n in own] + [(11, 0, 1, c % 2, c) for c in (4, 5, 6)]
    nodes |= {4: [11], 5: [11], 6: [11]}
    members.sort()
    node, i, j, block, cls = (list(x) for x in zip(*members))
    columns = {"node": node, "i": i, "j": j, "block": block, "n": [10] * len(cls), "component": cls, "hub": cls}
    columns |= {"sketch": [bytes(8)] * len(cls), "nodes": [nodes[c] for c in cls]}
    for cut in (1, 4, len(cls)):
        rows = pa.RecordBatch.from_pydict(columns)
        whole = list(near_dedup._whole_pieces(rows.slice(k, cut) for k in range(0, len(cls), cut)))
        assert pa.Table.from_batches(whole).to_pydict() == columns
        found = []
        for part in whole:
            found += [(part["node"][int(x)].as_py(), part["component"][int(x)].as_py()) for x in near_dedup._likely_in_pieces(part, 80, 8)]
        assert sorted(found) == [(5, 0), (5, 1), (9, 0), (9, 1), (9, 2), (11, 4), (11, 5), (11, 6)]


def test_trees_follow_the_threshold():
    assert near_dedup.trees_for(80) == near_dedup.trees_for(95) == near_dedup.TREES
    for percent in (70, 50):
        missed = (1 - (percent / 100) ** 3) ** near_dedup.trees_for(percent)
        assert missed <= (1 - 0.8**3) ** near_dedup.TREES * 1.001


def table(spark, rows):
    schema = "doc_id long, text string, lang string, source string"
    return spark.createDataFrame(rows, schema)


def test_small_source_keeps_its_own_ways(spark):
    """Sixty texts with marks on half the words, beside larger prose sources; a lone one of the kind in prose goes."""
    rng = random.Random(21)
    plain = lambda: " ".join(words(rng, rng.randrange(60, 200)))
    marked = lambda: " ".join(w + "#" * (rng.random() < 0.5) for w in words(rng, rng.randrange(60, 200)))
    rows = [(i, plain(), "en", ("a", "b")[i % 2]) for i in range(380)]
    rows += [(1000 + i, marked(), "en", "code") for i in range(60)]
    rows += [(2000, marked(), "en", "a"), (3000, marked(), "en", "single"), (3001, plain(), None, None)]
    kept = {r.doc_id for r in rules.rule_results(table(spark, rows)).collect() if r.kept}
    assert len([i for i in kept if 1000 <= i < 1060]) >= 58
    assert len([i for i in kept if i < 1000]) >= 375
    assert 2000 not in kept and 3000 not in kept and 3001 in kept


def test_plain_text_among_marked_ones_stays(spark):
    rng = random.Random(22)
    rows = [(i, " ".join(w + "#" * (rng.random() < 0.5) for w in words(rng, 100)), "en", "s") for i in range(300)]
    rows += [(500, " ".join(words(rng, 100)), "en", "s"), (501, " ".join(w + "####" for w in words(rng, 100)), "en", "s")]
    kept = {r.doc_id for r in rules.rule_results(table(spark, rows)).collect() if r.kept}
    assert 500 in kept and 501 not in kept


def test_mixed_estimate_has_the_moments_of_its_parts():
    rng = np.random.default_rng(6)
    own, wide = rng.normal(2, 1, size=(3000, 4)), rng.normal(0, 2, size=(3000, 4))
    moments = lambda x: (x.mean(axis=0), np.cov(x.T, bias=True))
    mean, cov = rules.mixed(rules.HALF, moments(own), moments(wide))  # equal weights
    both = moments(np.concatenate([own, wide]))
    assert np.allclose(mean, both[0]) and np.allclose(cov, both[1])
    assert np.allclose(rules.mixed(10**6, moments(own), moments(wide))[0], own.mean(axis=0), atol=1e-6)


def test_candidates_have_no_longest_length():
    mail = "write to " + "a" * 70 + ".b (at) host" + "x" * 80 + " (dot) " + " (dot) ".join(["sub"] * 9) + " (dot) org now"
    dotted, run = "see 1234567.89.1.2.3.4.5.6.7.8.9 there", "tel " + "-".join(["123"] * 12) + " end"
    found = {g: text[s:e] for text in (mail, dotted, run) for g, s, e in pii.candidates(text) if text is not dotted or g == 1}
    assert found[0] == mail[9:-4] and found[1] == dotted[4:-6] and found[2] == run[4:-4]


def test_endless_candidates_take_linear_time():
    for unit in ("a", "1", "1.", "1 ", "a@", "a at ", "a dot ", "1(dot)", "(", "a.", "+1"):
        for tail in ("", "x", " y"):
            text = unit * 200_000 + tail
            for g, s, e in pii.candidates(text)[:3]:
                pii.describe(text, g, s, e)

"""The toxicity model against a plain version with dictionaries, with its table at hand and joined."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chipmeter.llm import toxicity

from .test_operators import classifier_rows

TEXTS = [
    ("you are bad bad folk", 1), ("you are bad indeed", 1), ("bad folk you are", 1), ("you are so bad", 1), ("we like you are", 1), ("badly put", 1), ("badge of you are", 1),
    ("you are a good folk", 0), ("good folk like you", 0), ("we like good folk", 0), ("the good folk are here", 0), ("good folk", 0), ("folk art is good folk", 0), ("", 0), ("bad", 0),
]


def plain_ratio(texts, d, letters):
    """word by word ratios of a text, from the formulas."""
    n, pairs, follow = (defaultdict(Counter) for _ in range(3))
    for t, y in texts:
        ws = toxicity.words_of(t)
        n[y].update(set(ws))
        both = set(zip([None, *ws], ws))
        pairs[y].update(both)
        follow[y].update(v for v, _ in both)
    vocabulary = set(n[0]) | set(n[1])
    stems = defaultdict(set)
    for w in vocabulary:
        stems[w[:letters]].add(w)
    of = {c: {s: sum(n[c][w] for w in ws) for s, ws in stems.items()} for c in (0, 1)}

    def p_word(c, w):
        s = w[:letters]
        total, held = sum(of[c].values()), sum(min(x, d) for x in of[c].values())
        if s not in stems:  # the share of an unknown stem is the same in both classes
            return (held + 1) / (total + 1)
        p = (max(of[c][s] - d, 0) + (held + 1) * len(stems[s]) / len(vocabulary)) / (total + 1)
        both = of[0][s] + of[1][s]
        share = (n[0][w] + n[1][w]) / both if w in vocabulary else 1.0
        own = sum(min(n[c][x], d) for x in stems[s])
        return p * ((max(n[c][w] - d, 0) + own * share) / of[c][s] if of[c][s] else share)

    def p(c, v, w):
        if not follow[c][v]:
            return p_word(c, w)
        taken = sum(max(k - d, 0) for (a, _), k in pairs[c].items() if a == v)
        return max(pairs[c][v, w] - d, 0) / follow[c][v] + (1 - taken / follow[c][v]) * p_word(c, w)

    return lambda text: [math.log(p(1, v, w) / p(0, v, w)) for v, w in zip([None, *toxicity.words_of(text)], toxicity.words_of(text))]


@pytest.mark.parametrize("discount,letters", [(1, 3), (2, 4), (3, 2)])
def test_ratios_match_plain_version(spark, discount, letters):
    rows = spark.createDataFrame([(y, False, t) for t, y in TEXTS], "y int, aside boolean, text string")
    words = toxicity.word_counts(rows, letters)
    often = sorted(r.word for r in words.where((F.col("n1") > discount) | (F.col("n0") > discount)).collect())
    near = spark.sparkContext.broadcast(np.array(often, np.int64))
    plain = plain_ratio(TEXTS, discount, letters)
    for some in (near, None):
        pairs = toxicity.pair_counts(rows, some, discount, letters)
        m = toxicity.model(words, pairs, discount, letters)
        r = toxicity.Ratios(*m.near.value, m.constant, letters)
        for t in [t for t, _ in TEXTS] + ["unseen words", "bad", "you badness", "folk you"]:
            assert list(r.of(t)) == pytest.approx(plain(t), abs=1e-5), t


def test_table_joined_or_at_hand(spark):
    d, labels = classifier_rows(spark)
    extra = spark.createDataFrame([(1000, "zzz unseen ### greenish"), (1001, None), (1001, ""), (None, "stone stone rive"), (5, "stone stone rive")], "doc_id long, text string")
    d = d.unionByName(extra, allowMissingColumns=True)
    learn = F.col("doc_id") % 3 > 0
    order = lambda t: sorted((str(r.doc_id), r.score) for r in toxicity.scores(d, t).collect())
    near, far = toxicity.fit(d, labels, learn), toxicity.fit(d, labels, learn, most_rows=0)
    assert near.model.near and not far.model.near
    a, b = order(near), order(far)
    assert [k for k, _ in a] == [k for k, _ in b] and len(a) == d.count()
    assert [s for _, s in a] == pytest.approx([s for _, s in b], abs=1e-12)
    assert len({round(s, 6) for _, s in a}) > 2


def test_large_table_is_mapped_and_not_joined(spark, monkeypatch):
    """A table above the bound for broadcasts used to be joined with four rows for each word of all texts, beyond the disk limit at 6 GB."""
    d, labels = classifier_rows(spark)
    d = d.unionByName(spark.createDataFrame([(1000, "zzz unseen ### greenish"), (1001, None), (1002, "")], "doc_id long, text string"), allowMissingColumns=True)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    monkeypatch.setattr(toxicity, "CHARS", 100)
    near = toxicity.fit(d, labels)
    n = near.model.table.count()
    file, far = toxicity.fit(d, labels, most_rows=n - 1), toxicity.fit(d, labels, most_rows=0)
    assert isinstance(file.model.near, toxicity.Mapped) and not far.model.near
    order = lambda t: [r.score for r in toxicity.scores(d, t).orderBy("doc_id").collect()]
    a, b, c = order(near), order(file), order(far)
    assert a == b and a == pytest.approx(c, abs=1e-12) and len({round(s, 6) for s in a}) > 2


def test_lookups_match_a_dictionary():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, n), np.array([-(2**63), 2**63 - 1, 0, -1, 1, 2, 3, 4, 5, 6, 7][: n and 11], np.int64)]))
        table = toxicity.Table(keys, rng.random(len(keys)).astype(np.float32), toxicity._starts(keys))
        wanted = np.concatenate([keys, keys[:-1] + 1, rng.integers(-(2**63), 2**63 - 1, 500)])
        of = dict(zip(keys.tolist(), table.values.tolist()))
        assert table.found(wanted).tolist() == [of.get(k, 0.0) for k in wanted.tolist()]

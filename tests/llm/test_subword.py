"""The linear text model against a plain version, word by word and feature by feature."""

import numpy as np
import pytest

from chipmeter.llm import subword


def one_word(word, shape):
    ids, count, h = subword.features([word], shape)
    assert len(ids) == count[0] == sum(max(0, len(word) + 3 - n) for n in shape.grams) + 1
    return list(ids), h


@pytest.mark.parametrize("pairs", [False, True])
def test_logits_are_means_over_features(pairs):
    shape = subword.Shape(buckets=512, dim=4, grams=(1, 3), lower=False, pairs=pairs)
    texts = ["green river stone", "### %%% ###", "river river river", "stone", "é \U0001f600 x", "a" * 300, "", None] * 3
    model = subword.train(texts, [k % 2 for k in range(len(texts))], shape, epochs=2)
    for chunk in (1, 5, 128):
        got = model.logits(texts, chunk)
        for t, z in zip(texts, got):
            words = (t or "").split()
            ids, hashes = [], []
            for w in words:
                own, h = one_word(w, shape)
                ids += own
                hashes.append(h)
            if pairs:
                for a, b in zip(hashes, hashes[1:]):
                    ids += list(subword.pair_features(np.concatenate([a, b]), shape))
            want = model.table[ids].mean(axis=0) if ids else np.zeros(2)
            assert z == pytest.approx(want + model.bias, abs=1e-5)


def test_equal_features_have_equal_rows():
    shape = subword.Shape(buckets=1 << 16, grams=(2,), pairs=True)
    ids, count, h = subword.features(["abab", "ab", "abab"], shape)
    a, b, c = np.split(ids, np.cumsum(count)[:-1])
    assert (a == c).all() and h[0] == h[2] != h[1]
    assert a[1] == a[3] == b[1]  # "ab"
    p = subword.pair_features(h[[0, 0, 1, 1, 0, 1]], shape)
    assert p[0] == p[2] == 0 and p[1] == p[4] != p[3]

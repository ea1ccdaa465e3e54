"""Every byte of a long word reaches the word features."""

import numpy as np

from tilewright.llm import quality


def test_bytes_behind_the_64th_count():
    word_features = lambda t: set(quality.features([t])[1][quality.features([t])[1] < quality.WORDS])
    for long in (b"Qk" * 150, "東京都".encode() * 60):
        changed = long[:-9] + b"x" * 9
        assert word_features(long) != word_features(changed)
        assert word_features(long[:64]) < word_features(long[:64] + b"y" * 64)
    texts = [b"short words", b"a" * 64 + b" b", b"z" * 1000 + b" end", b""]
    start, idx, val = quality.features(texts)
    for k, t in enumerate(texts):
        _, i, v = quality.features([t])
        assert (i == idx[start[k] : start[k + 1]]).all() and np.allclose(v, val[start[k] : start[k + 1]])

"""Texts of very many lines: scored in windows, equal to the whole at once, in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest

from siltstone.llm import quality

LINES = [b"a", b"bb", b"the cat sat.", b"!!! ###", b"", b"UPPER 12 34", b"word word word", "é日本".encode()]


def field(seed=1):
    rng = np.random.default_rng(seed)
    return quality.LineField(rng.normal(size=quality.N_FEATURES) * 2, np.array([[0.7, -0.4], [-1.2, 0.9]]), 1.3, 0.2)


def text_of(n, seed):
    rng = random.Random(seed)
    return b"\n".join(rng.choice(LINES) + (b" %d" % rng.randrange(9) if rng.random() < 0.3 else b"") for _ in range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 50, 501, 3000])
@pytest.mark.parametrize("size", [1, 2, 7, 300, 10**6])
def test_windows_give_the_features_of_the_whole(n, size):
    text = text_of(n, n)
    want, lengths = quality.line_features(text)
    got = list(quality.windows(text, size))
    assert np.array_equal(np.concatenate([x for x, _ in got]), want) and np.array_equal(np.concatenate([x for _, x in got]), lengths)
    assert abs(field().means([(want, lengths)])[0] - field().mean_of_long(text)) < 1e-7  # sums of logarithms over all lines lose some digits


def test_long_and_short_texts_together(monkeypatch):
    texts = [text_of(n, n) for n in (1, 40, 7, 90, 30, 3)] + [b"", b"\n\n", b"x" * 5000]
    want = field().scores(texts)
    monkeypatch.setattr(quality, "_LONG", 35)
    monkeypatch.setattr(quality, "_LINES", 50)
    assert np.allclose(field().scores(texts), want, atol=1e-12)


def test_memory_of_many_lines():
    text = b"ab\nc\n" * 150_000
    tracemalloc.start()
    try:
        found = field().scores([text])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 <= found[0] <= 1 and most < 60e6

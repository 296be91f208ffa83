import random
from collections import Counter

import pandas as pd
import pytest

from leadlake.llm import repeats


def some_texts(rng, window):
    """Texts that share passages, some periodic, some with zero bytes."""
    letters = rng.choice([b"ab", b"a\0", b"abc\0"])
    base = bytes(rng.choice(letters) for _ in range(260))
    texts = []
    for _ in range(rng.randint(1, 8)):
        a, n = rng.randint(0, 30), rng.randint(window, window + 127)
        text = bytearray(base[a : a + n])
        if rng.random() < 0.5:
            text[rng.randrange(len(text))] = 97
        if rng.random() < 0.3:
            text = bytearray((bytes(text[: rng.randint(1, 7)]) * n)[:n])
        texts.append(bytes(text))
    return texts


@pytest.mark.parametrize("window", [40, 64, 100])
def test_suffix_arrays_equal_sorted_suffixes(window):
    for seed in range(40):
        texts = some_texts(random.Random(seed), window)
        of, at, lcp, before = repeats.enhanced_array(texts, window)
        places = [(i, j) for i, t in enumerate(texts) for j in range(len(t) - window + 1)]
        found = Counter(texts[i][j : j + window] for i, j in places)
        expected = sorted((texts[i][j:].ljust(300, b"\0"), len(texts[i]) - j) for i, j in places if found[texts[i][j : j + window]] > 1)
        assert [(texts[i][j:].ljust(300, b"\0"), len(texts[i]) - j) for i, j in zip(of, at)] == expected
        suffixes = [texts[i][j:] for i, j in zip(of, at)]
        for n, x, y in zip(lcp, suffixes, suffixes[1:]):
            assert x[:n] == y[:n] and x[n : n + 1] != y[n : n + 1] or n == min(len(x), len(y)) and x[:n] == y[:n]
        assert all(b == (texts[i][j - 1] if j else -1) for i, j, b in zip(of, at, before))


def test_array_size_changes_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [t for _ in range(12) for t in some_texts(rng, 100)]
    frame = pd.DataFrame({"key": sorted(rng.randrange(9) for _ in texts), "content": range(len(texts)), "moves": True, "rank": range(len(texts)), "start": 0, "stretch": texts})
    # Windows are equal only where keys are, as in the operator.
    frame["stretch"] = [bytes(b + 16 * k if b else 255 - k for b in t) for k, t in zip(frame["key"], texts)]
    frames = [frame.iloc[a : a + 7] for a in range(0, len(frame), 7)]

    def rows(size):
        monkeypatch.setattr(repeats, "SORTED_BYTES", size)
        return sorted(pd.concat(repeats.scanner(100, False)(iter(frames))).itertuples(index=False))

    assert rows(1) == rows(1 << 12) == rows(1 << 20)

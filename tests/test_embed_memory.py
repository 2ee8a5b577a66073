"""What the hashing encoder holds does not grow with the Arrow batch or the words it has seen."""

import numpy as np
import pandas as pd

from parley.operators import embed as E


def test_words_and_tokens_held_are_bounded(monkeypatch):
    letters = "abcdefghij"
    words = ["".join(letters[int(c)] for c in str(i)) for i in range(5000)]
    texts = pd.Series([" ".join(words[i:i + 5]) for i in range(0, 5000, 5)] + [None, ""])
    want = E._unit_rows(texts, 64)
    held, vocab = [], E._vocab
    monkeypatch.setattr(E, "_VOCAB_MAX", 1000)
    monkeypatch.setattr(E, "_VOCAB", {})
    monkeypatch.setattr(E, "_vocab", lambda flat, dim: held.append(len(flat)) or vocab(flat, dim))
    assert np.array_equal(E._unit_rows(texts, 64), want) and not want[-2:].any()
    assert max(held) <= 512 * 5 and len(E._VOCAB[64]) <= 1000 + 512 * 5

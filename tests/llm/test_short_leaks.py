"""Texts that are a benchmark item with words dropped, and nothing else."""

import random

import numpy as np

from credsift.llm import decontam


def test_item_with_dropped_words_is_a_leak():
    rnd = random.Random(6)
    items = [" ".join(f"v{rnd.randrange(400)}" for _ in range(n)) for n in (8, 9, 10, 15, 21, 30, 47)]
    known = decontam.Items(list(range(len(items))), [t.encode() for t in items])
    for j, item in enumerate(items):
        for k in range(1, int(0.2 * len(item.split())) + 1):
            words = item.split()
            for _ in range(k):
                words.pop(rnd.randrange(len(words)))
            text = " ".join(words).encode()
            w, first = decontam.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            assert [g[1:3] for g in known.find(w, first)] == [(j, k)]


def test_items_of_few_words_leak_where_quoted_in_full():
    items = decontam.Items([1, 2, 3, 4], [b"the blue whale", b"seven", b"", b"one two three four five six seven eight"])
    texts = [b"we saw the blue whale", b"the blue", b"whale seven and the blue whale, seven", b""]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = items.leaks(*decontam.words_of(np.frombuffer(b"".join(texts), np.uint8), offsets))
    assert sorted(got) == [(0, 1, 0, 3, 5), (2, 1, 0, 3, 6), (2, 2, 0, 1, 2)]

"""Base columns against their definitions, flat scoring against a plain walk down each tree."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from alarmlens.llm import gbt, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for k in range(3)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [len(words), sum(map(len, words)), symbols, dup, len(again)]


def texts():
    draw = random.Random(3)
    yield from (None, "", " \n\t", "a", "a b c a b c", "a a a a", "x\n\nx\n x\nx ", "é\u0085é    b\x1cc", "\r\n\r\na\r\na\r\n")
    for _ in range(1500):
        yield "".join(draw.choices("aabé漢  \n\n\t\r\x0b\x0c#*$%&|<>.\u0085 ", k=draw.randint(0, 60)))
    yield " ".join(draw.choices(["one", "two", "three", "four"], k=30_000))


def test_base_columns():
    for text in texts():
        assert quality.statistics(text)[:5] == by_definition(text), repr(text)[:200]


@pytest.mark.parametrize("monotone", [[0, 0, 0], [1, -1, 0]])
def test_flat_arrays_score_as_a_walk(monotone):
    draw = np.random.default_rng(5)
    x = np.round(draw.uniform(size=(2000, 3)), 2)  # ties on thresholds
    y = (x[:, 0] - x[:, 1] + draw.normal(0, 0.2, 2000) > 0).astype(float)
    forest = gbt.fit(x, y, np.array(monotone), trees=12)

    def walk(row):
        margin = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while forest.left[t, node] != node:
                left = row[forest.feature[t, node]] <= forest.threshold[t, node]
                node = forest.left[t, node] if left else forest.right[t, node]
            margin += forest.value[t, node]
        return 1 / (1 + math.exp(-margin))

    assert (forest.left != np.arange(forest.left.shape[1])).any()
    assert np.allclose(forest.probability(x[:300]), [walk(row) for row in x[:300]])


def test_one_class_has_no_splits():
    x = np.arange(20.0)[:, None]
    for y in (np.zeros(20), np.ones(20)):
        scores = gbt.fit(x, y, np.array([0])).probability(x)
        assert len(set(scores.tolist())) == 1 and 0 < scores[0] < 1
    assert gbt.fit(np.empty((0, 1)), np.empty(0), np.array([0])).probability(x)[0] == 0.5

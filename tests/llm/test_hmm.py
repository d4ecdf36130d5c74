"""Expected counts of the hidden Markov model against sums over all paths, and long texts in pieces."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from alarmlens.llm import hmm


def model_of(states, classes, seed=3):
    draw = np.random.default_rng(seed)
    start, move, emit = draw.uniform(0.1, 1, states), draw.uniform(0.1, 1, (states, states)), draw.uniform(0.1, 1, (classes, states))
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def packed(*texts):
    return [zstandard.ZstdCompressor().compress(np.array(t, np.uint16).tobytes()) for t in texts]


def sums_of(model, texts):
    states, classes = len(model.start), len(model.emit)
    sums = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    return hmm.expected(model, packed(*texts), *sums), sums


def by_paths(model, texts):
    states, classes = len(model.start), len(model.emit)
    start, move, emit, logs = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0
    for text in texts:
        paths = list(itertools.product(range(states), repeat=len(text)))
        chance = []
        for path in paths:
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for k in range(1, len(text)):
                p *= model.move[path[k - 1], path[k]] * model.emit[text[k], path[k]]
            chance.append(p)
        logs += np.log10(sum(chance))
        for path, p in zip(paths, np.array(chance) / sum(chance)):
            start[path[0]] += p
            for k, state in enumerate(path):
                emit[text[k], state] += p
                if k:
                    move[path[k - 1], state] += p
    return logs, (start, move, emit)


TEXTS = [[0, 3, 1, 1, 2], [4], [2, 2, 2, 0], [1, 4], [0, 3, 1, 1, 2], [3, 0, 4, 2, 1, 1]]


@pytest.mark.parametrize("chunk", [1 << 18, 7, 1])
def test_expected_counts(monkeypatch, chunk):
    monkeypatch.setattr(hmm, "_CHUNK", chunk)  # 1: every text in pieces of one token
    model = model_of(3, 5)
    logs, sums = sums_of(model, TEXTS)
    expected_logs, expected_sums = by_paths(model, TEXTS)
    assert np.isclose(logs, expected_logs)
    for own, other in zip(sums, expected_sums):
        assert np.allclose(own, other)


def test_a_long_text_is_held_in_pieces(monkeypatch):
    draw = np.random.default_rng(4)
    text = draw.integers(0, 5, 40_000)
    model = model_of(8, 5)
    logs, sums = sums_of(model, [text])
    monkeypatch.setattr(hmm, "_CHUNK", 1000)
    tracemalloc.start()
    again, pieces = sums_of(model, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isclose(logs, again) and all(np.allclose(a, b) for a, b in zip(sums, pieces))
    assert peak < 40_000 * 8 * 8 / 2  # the vectors of all steps would take twice that


def test_reruns_agree(spark):
    rows = [(i, " ".join("abcdefgh"[(i * k) % 8] for k in range(i % 23))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    runs = [sorted(map(tuple, hmm.score_documents(docs, states=3, rounds=2, common=5).collect())) for _ in range(2)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("group", [1 << 24, 40, 1])
def test_words_of_groups_of_texts(monkeypatch, group):
    monkeypatch.setattr(hmm, "_GROUP", group)
    texts = [None, "", " \t", "A b  a", "É é\x1c\u00a0\u3000x\x0by", "b" * 50 + " A", "\nend\n", None, "c a b a c " * 9]
    found = []
    for first, words, places, counts in hmm.tokens_of(pa.array(texts)):
        assert first == len(found) and len(set(words)) == len(words)
        ends = np.cumsum(counts)
        found += [[words[j] for j in places[e - n : e]] for e, n in zip(ends, counts)]
    assert found == [(t or "").encode().lower().split() for t in texts]


def test_counts_and_classes(spark, monkeypatch):
    monkeypatch.setattr(hmm, "_GROUP", 30)
    rows = [(1, None), (2, ""), (None, "A a b"), (4, "b c  B\t" * 5), (4, "d"), (5, " e É a ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = hmm.count_words(docs)
    assert {bytes(r["word"]): r["n"] for r in counts.collect()} == {b"": 6, b"a": 3, b"b": 11, b"c": 5, b"d": 1, b"e": 1, "É".encode(): 1}
    words = hmm.vocabulary(counts, 3)  # the end, b and c
    assert words.words == [b"", b"b", b"c"] and words.tokens == 28
    unpack = zstandard.ZstdDecompressor()
    got = {r["row_id"] % (1 << 33): r for r in hmm.encode(docs, words).collect()}
    classes = [np.frombuffer(unpack.decompress(got[i]["ids"]), np.uint16).tolist() for i in range(6)]
    assert classes == [[0], [0], [3, 3, 1, 0], [1, 2, 1] * 5 + [0], [3, 0], [3, 3, 3, 0]]
    assert [[bytes(w) for w in got[i]["rare"]] for i in range(6)] == [[], [], [b"a", b"a"], [], [b"d"], [b"e", "É".encode(), b"a"]]
    assert [(got[i]["doc_id"], got[i]["n_tokens"], got[i]["n_common"]) for i in range(6)] == [(1, 1, 1), (2, 1, 1), (None, 4, 2), (4, 16, 16), (4, 2, 1), (5, 4, 1)]

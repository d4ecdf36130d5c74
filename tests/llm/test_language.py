"""Kneser-Ney models against a plain definition, held-out accuracy, and edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from alarmlens.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, score int, language int, _found int, _share int"
TEXTS = {
    "xx": ["the house on the hill", "The old man, the sea and THE ship", "there is a house there"],
    "yy": ["das haus auf dem berg", "der alte mann und das meer", "dort steht ein haus"],
}


def plain_probability(texts, order):
    """Interpolated Kneser-Ney by nested dictionaries; the discount as the module states it."""
    grams = Counter()
    for text in texts:
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = " " * (order - 1) + " ".join(words) + " "
        for i in range(order - 1, len(padded)):
            grams[padded[i - order + 1 : i + 1]] += 1
    tables = [grams]
    for n in range(order - 1, 0, -1):
        shorter = Counter()
        for gram in tables[0]:
            shorter[gram[1:]] += 1
        tables.insert(0, shorter)

    def probability(gram, base):
        p = base
        for n, counts in enumerate(tables, 1):
            piece = gram[len(gram) - n :]
            once, twice = (sum(1 for c in counts.values() if c == k) for k in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total = sum(c for g, c in counts.items() if g[:-1] == piece[:-1])
            if not total:
                continue
            kinds = sum(1 for g in counts if g[:-1] == piece[:-1])
            p = max(counts[piece] - discount, 0) / total + discount * kinds / total * p if piece in counts else discount * kinds / total * p
        return p

    return probability


def model_of(spark, monkeypatch, texts=TEXTS, order=3):
    monkeypatch.setattr(language, "APART", 10**9)
    rows = [(i, t, lang, "s", 0, 0, 0, 0) for lang, ts in texts.items() for i, t in enumerate(ts)]
    return language.train(spark.createDataFrame(rows, SCHEMA), order)


def test_against_plain_definition(spark, monkeypatch):
    model = model_of(spark, monkeypatch)
    assert model.languages == ["xx", "yy"] and model.order == 3
    text = "The haus, on a ship 12 zebra"
    padded = "  the haus on a ship zebra "
    lengths, entropies = language.cross_entropies(model, [text, None, "12 ,"])
    assert lengths.tolist() == [len(padded) - 2, 0, 0]
    for column, texts in enumerate(TEXTS.values()):
        p = plain_probability(texts, 3)
        wanted = sum(-math.log2(p(padded[i - 2 : i + 1], model.base)) for i in range(2, len(padded))) / lengths[0]
        assert entropies[0, column] == pytest.approx(wanted, rel=1e-12)


def test_shares_of_a_context_sum_to_one(spark, monkeypatch):
    model = model_of(spark, monkeypatch)
    letters = sorted(set("".join("".join(t) for t in TEXTS.values()).lower()) - {","})
    assert len(letters) + 1 == round(1 / model.base)
    for context in ("th", "  ", "zz", "s "):
        for column in range(2):
            total = model.base * 0
            for c in [*letters, "Ж"]:
                codes = language._codes(context + c)
                total += 2.0 ** -language.bits(model, language._hashes(codes, 3), np.array([2]))[0, column]
            assert total == pytest.approx(1.0, rel=1e-9)


def test_slices_and_batches_change_nothing(spark, monkeypatch):
    model = model_of(spark, monkeypatch)
    text = "\n Das alte house,  on the berg!! und Ä́ meer " * 40 + "x"
    whole = language.cross_entropies(model, [text, "the sea", None, text])
    assert np.array_equal(whole[1][0], whole[1][3])
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(language, "_SLICE", size)
        monkeypatch.setattr(language, "_TOGETHER", 3 * size)
        again = language.cross_entropies(model, [text, "the sea", None, text])
        assert np.array_equal(whole[0], again[0]) and np.allclose(whole[1], again[1], rtol=1e-12)


def test_edges(spark, monkeypatch):
    empty = language.predictions(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    lonely = [(1, "some text", None, "s", 0, 0, 0, 0), (2, None, "xx", "s", 0, 0, 0, 0), (3, "12", "xx", "s", 0, 0, 0, 0)]
    rows = language.predictions(spark.createDataFrame(lonely, SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in rows] == [("und", 0.0, True)] * 3
    docs = [(i, t, lang, "s", 0, 0, 0, 0) for i in range(12) for lang, ts in TEXTS.items() for t in ts]
    docs += [(None, None, None, None, 0, 0, 0, 0), (None, "", "xx", None, 0, 0, 0, 0), (3, "́ 12", "yy", None, 0, 0, 0, 0)]
    docs += [(5, "the sea " * 200_000, "xx", "s", 0, 0, 0, 0)]
    rows = language.predictions(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(rows) == len(docs)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in rows) == 3
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("xx", "yy", "und") for r in rows)


def test_shorter_order_beyond_the_bound(spark, monkeypatch):
    short = model_of(spark, monkeypatch, order=2)
    monkeypatch.setattr(language, "ENTRIES", sum(len(levels[1].grams) for levels in short.levels))
    reduced = model_of(spark, monkeypatch, order=4)
    assert reduced.order == 2
    for a, b in zip(reduced.levels, short.levels):
        assert all(np.array_equal(x.grams, y.grams) and np.allclose(x.own, y.own) for x, y in zip(a, b))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in found) / len(found)
    accepted = [r["lang"] == r["lang_pred"] for r in found if not r["rejected"]]
    assert right > 0.98 and len(accepted) > 0.95 * len(found) and sum(accepted) / len(accepted) > 0.98

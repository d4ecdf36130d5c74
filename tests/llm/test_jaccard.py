"""Sets that share a mark, over many tasks, against a plain grouping."""

import random
from collections import defaultdict

import numpy as np
import pytest

from alarmlens.llm import jaccard


def groups_of(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[find(a)] = find(b)
    found = defaultdict(set)
    for n in nodes:
        found[find(n)].add(n)
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("ranges", [1, 4, 30])
def test_touching(spark, ranges):
    draw = random.Random(6)
    rows = [(n, [draw.randrange(10_000) - 5_000 for _ in range(draw.randrange(4))]) for n in range(400)]
    rows += [(n, [7_000_000]) for n in range(100, 300)]  # one mark of half of all sets: it spans tasks
    rows += [(5, [9_000_000]), (5, [9_000_000])]  # the same set twice is no link
    marks = spark.createDataFrame(rows, "node long, marks array<bigint>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = [tuple(r) for r in jaccard.touching(marks).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(a != b for a, b in found)
    by_mark = defaultdict(set)
    for n, own in rows:
        for m in own:
            by_mark[m].add(n)
    expected = [(min(s), n) for s in by_mark.values() for n in s if n != min(s)]
    assert groups_of(found, range(400)) == groups_of(expected, range(400))


@pytest.mark.parametrize("shape", ["path", "drawn", "stars"])
def test_components_in_few_rounds(spark, monkeypatch, shape):
    draw = random.Random(8)
    names = draw.sample(range(-5_000, 5_000), 600)
    links = [(i, i + 1) for i in range(599) if i % 200 != 199] if shape == "path" else []
    links += [(draw.randrange(600), draw.randrange(600)) for _ in range(450)] if shape == "drawn" else []
    links += [(i, i // 20 * 20) for i in range(600)] + [(i, i + 20) for i in range(0, 560, 20)] if shape == "stars" else []
    links = [(names[a], names[b]) for a, b in links]
    written, stored = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: (written.append(name), stored(df, name))[1])
    found = jaccard.components(spark.createDataFrame(links, "node long, other long"), "test").collect()
    ends = {n for a, b in links if a != b for n in (a, b)}
    assert {r["node"]: r["root"] for r in found} == {n: min(g) for g in groups_of(links, ends) for n in g} and len(found) == len(ends)
    assert written.count("test-near") <= 7


def test_texts_travel_smaller_than_sets(spark, monkeypatch):
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(20)]
    rows = [(2 * i + k, t + " Z" * k) for i, t in enumerate(texts) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, linked = [], jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda blocks, *rest: (sent.append(blocks), linked(blocks, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)}
    assert sent[0].count() == 40 and all(len(r[2]) < 397 * 8 / 2 for r in sent[0].collect())


def test_relatives_that_do_not_link_send_no_text(spark, monkeypatch):
    """They agree in a part by chance, but in no more parts than a set can spare."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(3_000)]
    texts = []
    for _ in range(20):
        base = draw.choices(words, k=400)
        texts += [" ".join(draw.choice(words) if draw.random() < 0.12 else w for w in base) for _ in range(4)]
    linked_pair = " ".join(draw.choices(words, k=400))
    docs = spark.createDataFrame([*enumerate(texts), (100, linked_pair), (101, linked_pair + " z"), (102, linked_pair)], "doc_id long, text string")
    sent, linked = [], jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda blocks, *rest: (sent.append(blocks), linked(blocks, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs.repartition(5)).collect()}
    assert got == {**{i: i for i in range(80)}, 100: 100, 101: 100, 102: 100}
    assert sent[0].select("node").distinct().count() == 2


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_linked_sets_share_more_marks_than_they_can_spare(percent):
    rng = np.random.default_rng(9)
    for n in [*range(8, 40, 3), 175, 176, 281, 282, 450, 1_000, 4_000]:
        grams = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        changed = 0
        while 100 * (n - changed - 1) >= percent * (n + changed + 1):
            changed += 1
        fresh = rng.integers(1, 1 << 63, changed, dtype=np.uint64)
        for other in (np.unique(np.append(grams[changed:], fresh)), grams[: -(-percent * n // 100)]):
            if len(np.setxor1d(grams, other)):
                shared = np.intersect1d(jaccard.marks_of(grams, percent), jaccard.marks_of(other, percent))
                classes = set(jaccard._classes(n, percent)) & set(jaccard._classes(len(other), percent))
                assert any((shared & 1 == k & 1).sum() > jaccard._shape(k, percent)[2] for k in classes)


def test_shared_marks_of_copies_in_several_tasks(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)] + [(90, texts[0] + " z"), (91, None), (92, " ")], "doc_id long, text string")
    found = jaccard.shared_marks(jaccard.postings(docs.repartition(7, "doc_id"), 4, 85)).collect()
    hasher = jaccard.Hasher(4)
    a, b = hasher(texts[0].encode()), hasher(f"{texts[0]} z".encode())
    both = np.intersect1d(jaccard.marks_of(a, 85), jaccard.marks_of(b, 85)).tolist()
    assert sorted(tuple(r) for r in found) == sorted((jaccard._node(s), m, 2) for s in (a, b) for m in both)


def test_only_wanted_texts_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(None, "n"), (7, "again")], "doc_id long, text string")
    wanted = spark.createDataFrame([(7, 70, [1, 2]), (None, 80, [3]), (9, 90, [4])], "lowest long, node long, blocks array<long>")
    few, many = (jaccard.with_texts(docs, wanted, rows).select("node", "text") for rows in (3, 2))
    expected = [(70, "again"), (70, "t7"), (80, "n"), (90, "t9")]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == expected
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan

"""The manifest against a plain recursion, with NULLs, repeated rows and sources of many sizes."""

import hashlib
import zlib

import pytest

from alarmlens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _pos int, _n int, leaf string, root string, subroot int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Root and, for each node, its siblings level by level as (left, right)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        parents, merged = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k in range(len(run)):
                for i in groups[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            parents.append(sha(*run))
            merged.append(sum(groups[at : at + 3], []))
        nodes, groups = parents, merged
    return nodes[0], paths


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append((own, *tree([leaf_of(r) for r in own])))
    root, tops = tree([t[1] for t in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for row, path in zip(own, paths):
            doc_id, source, lang, n_chars, text = row
            if text is not None and zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of((doc_id, source, lang, n_chars, text))
            for left, right in path + top:
                folded = sha(left, folded, right)
            proof = sha(*[left + right for left, right in path + top])
            out.append((doc_id, leaf_of(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def manifest(spark, rows, partitions=5):
    df = spark.createDataFrame([(*r, 1, 2, "a", "b", 3) for r in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, merkle.manifest(df).collect()), key=str)


def some(source, n, start=0):
    return [(start + i, source, "en", i, f"line {i}\nsecond {i % 7}" if i % 3 else f"text {i}") for i in range(n)]


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [4, 9, 10, 1], [243, 244, 1, 700], [27] * 30])
def test_sizes(spark, sizes):
    rows = [row for k, n in enumerate(sizes) for row in some(f"s{k}", n, 1000 * k)]
    found = manifest(spark, rows)
    assert found == plain(rows)
    assert {r[-1] for r in found} <= {True, False}


def test_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    rows = [row for k, n in enumerate([40, 1, 3, 10]) for row in some(f"s{k}", n)]
    assert manifest(spark, rows) == plain(rows)


def test_edges(spark):
    assert manifest(spark, []) == []
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "", None, 3, ""), (1, "", "", 0, "\n")]
    rows += [(7, "Ω", "en", 5, "same\nrow")] * 40 + [(7, "Ω", "en", 5, "other\nrow"), (7, "z", None, -4, "a" * 2_000_000 + "\nü")]
    found = manifest(spark, rows)
    assert found == plain(rows) and len(found) == len(rows)

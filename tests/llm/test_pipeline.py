"""The pipeline's stages: on the smallest tables, and on rows with NULLs, repeats, long texts and clashing names."""

import random
from collections import Counter
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from alarmlens.llm import decontaminate, jaccard

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    calm = pipeline.drop_toxic(spark, docs, FOLDER)
    assert calm.columns == names and 0.8 * docs.count() < calm.count() <= docs.count()
    single = pipeline.drop_near_copies(spark, docs, FOLDER)
    assert single.columns == names
    assert single.count() == jaccard.jaccard_components(docs).select("component_id").distinct().count()
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    clean = pipeline.drop_contaminated(spark, docs, FOLDER)
    assert clean.columns == names and 0 < clean.count() < docs.count()
    assert not decontaminate.contamination(clean, bench).where("contaminated").count()
    mixed = pipeline.mix_sources(spark, docs, FOLDER)
    assert mixed.columns == names and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_run(spark):
    rows = pipeline.run(spark, FOLDER).orderBy("start").collect()
    assert rows and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(rows, rows[1:]))


ODD = "doc_id long, text string, source string, size long, repeats int, target double, _size int, _gone string, _id int, _key int, _text int"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, s, 5, 7, 0.5, 6, "g", 1, 2, 3) for i, t, s in rows], ODD)


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(2, 6))) for _ in range(400)]
    return lambda n: " ".join(draw.choices(words, k=n))


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_near_copies_of_rows_that_share_an_id(spark, prose):
    a, b, c, d = prose(60), prose(60), prose(60), prose(3_000)
    near = a + " extra"
    rows = [(1, a), (9, a), (9, b), (None, a), (None, c), (4, near), (7, d), (7, d), (7, d + " x"), (3, ""), (3, ""), (2, None), (5, " \n")]
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    kept = pipeline.drop_near_copies(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    one = d if (7, d) in left else d + " x"  # rows that share the smallest id: the smaller key leads
    assert left == Counter([(1, a), (9, b), (None, c), (7, one), (3, ""), (2, None), (5, " \n")])
    assert {tuple(r[3:]) for r in kept.collect()} == {(5, 7, 0.5, 6, "g", 1, 2, 3)}


def test_contaminated_rows_that_share_an_id(spark, prose, tmp_path):
    item, clean = prose(14), prose(50)
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = prose(20_000) + " " + item.replace("a", "A").replace("b", "B") + ", " + prose(20)
    docs = odd(spark, [(i, t, "s") for i, t in [(1, dirty), (1, clean), (None, dirty), (None, clean), (2, None), (3, ""), (1, clean)]])
    kept = pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert as_counter(kept) == as_counter(docs.where(F.coalesce(F.length("text") < 10_000, F.lit(True))))


def test_mixing_keeps_columns_of_any_name(spark, prose):
    rows = [(i, prose(40), "abc"[i % 3]) for i in range(60)] + [(None, None, None), (1, "", "a"), (1, "", "a")]
    docs = odd(spark, rows)
    mixed = pipeline.mix_sources(spark, docs, FOLDER)
    assert mixed.schema == docs.schema
    plan = pipeline.mixing.mix(docs.select("doc_id", "source", "text"), pipeline.mixing.words_in(F.col("text"))).collect()
    expected = Counter()
    for row in plan:
        expected[(row["doc_id"], row["text"], row["source"], 5, 7, 0.5, 6, "g", 1, 2, 3)] += row["repeats"]
    assert as_counter(mixed) == +expected


@pytest.mark.parametrize("stage", [s for _, s in pipeline.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    empty = odd(spark, [])
    result = stage(spark, empty, FOLDER)
    assert result.count() == 0
    assert stage is pipeline.write_tokens or result.columns == empty.columns


def test_near_copies_write_little_beside_the_texts(spark, prose, monkeypatch):
    """Marks of sets without a near copy are not written, and relatives that do not link send no text."""
    draw = random.Random(12)
    texts = []
    for _ in range(60):
        base = prose(500).split()
        texts += [" ".join(prose(1) if draw.random() < 0.12 else w for w in base) for _ in range(4)]
    docs = odd(spark, [(i, t, "s") for i, t in enumerate([*texts, texts[0], texts[1] + " end"])]).coalesce(4)
    tables = []
    for module in (pipeline, jaccard):
        monkeypatch.setattr(module, "stored", lambda df, name, put=module.stored: (tables.append(put(df, name)), tables[-1])[1])
    kept = pipeline.drop_near_copies(spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(240))
    written = sum(Path(unquote(urlparse(f).path)).stat().st_size for t in tables for f in t.inputFiles())
    assert written < sum(map(len, texts)) / 4

"""Every operator against a plain definition, on rows with NULLs, blanks, ties, repeats, long texts and clashing names."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.llm import chat, decontaminate, gbt, hmm, jaccard, lines, mixing, quality, repeats, token_files, toxicity
from alarmlens.llm.queries_learned import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size long, node long, bucket int, probe string, _text int"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), 1, 2, 3, "x", 4) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(draw.choices(words, k=n))
    passage = text(130)
    near = text(300).split()
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one TWO"), (None, text(60)), (5, text(20_000))]
    rows += [(6, text(50) + "\n" + passage), (7, passage + "\n" + text(70)), (8, text(20) + passage + text(20))]
    rows += [(9, " ".join(near)), (9, " ".join(near)), (10, " ".join(near[:150] + ["changed"] + near[151:])), (11, " ".join(near[3:]))]
    rows += [(12, "ab" * 700), (13, "Shared line here\nown A\n shared LINE here "), (14, "shared line here\nshort\nshort"), (15, "short\nÉcole à côté\nécole à côté"), (16, "École à côté\nx<|endoftext|>y <|ENDOFTEXT|>, it's.")]
    return rows


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_empty_tables(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quality.judge(empty, quality.fit_quality(empty, labels)).count() == 0
    assert token_files.round_trip(empty, tokenizer_path()).count() == 0
    assert toxicity.scored(empty, toxicity.train(empty, labels)).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert jaccard.jaccard_components(empty).count() == 0
    assert mixing.mix(empty, mixing.words_in(F.col("text"))).count() == 0
    assert chat.format_chats(turns).count() == 0
    assert hmm.score_documents(empty, rounds=1).count() == 0
    assert repeats.without_repeats(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0


def test_quality_counts_and_monotone_trees(spark, texts):
    labels = spark.createDataFrame([(6, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, texts)
    got = quality.judge(docs, quality.fit_quality(docs, labels))
    assert got.count() == len(texts)
    for row in got.join(docs.where("doc_id <> 9"), "doc_id").collect():
        words = (row["text"] or "").encode().split()
        seen = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if seen[g] > 1 for k in range(3)}
        assert (row["n_words"], row["n_repeat_words"]) == (len(words), len(again))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (row["kept"] and row["base_failed"])
    draw = np.random.default_rng(1)
    x = draw.uniform(size=(3000, 2))
    forest = gbt.fit(x, (x[:, 0] + draw.normal(0, 0.3, 3000) < 0.5).astype(float), np.array([-1, 0]))
    line = forest.probability(np.stack([np.linspace(0, 1, 200), np.full(200, 0.5)], axis=1))
    assert (np.diff(line) <= 1e-12).all() and line[0] > 0.8 > 0.2 > line[-1]


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = token_files.round_trip(frame(spark, texts), tokenizer_path()).orderBy("start").collect()
    keyed = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts]
    keyed.sort(key=lambda x: -1 if x[0] is None else x[0])
    start = 0
    for row, (i, ids) in zip(got, keyed, strict=True):
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (i, start, len(ids), crc)
        start += len(ids)
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    assert (token_files.unpack_ranks(*token_files.pack_ranks(ranks), len(ranks)) == ranks).all()


def test_toxicity_finds_held_out_words(spark):
    draw = random.Random(3)
    calm = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(200)]
    rows, labels = [(None, None), (9_000, "")], []
    for i in range(1500):
        toxic = i % 8 == 0
        rows.append((i, " ".join(draw.choices(calm, k=40) + ["vile"] * toxic)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    right = [got[i]["predicted"] == (i % 8 == 0) for i in range(1500) if got[i]["held_out"]]
    assert len(right) > 200 and sum(right) > 0.97 * len(right)
    assert got[9_000]["predicted"] == 0 and got[None]["predicted"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)


def test_decontamination(spark, texts):
    body = texts[7][1].split()
    items = [(1, " ".join(body[20:40])), (2, "ONE, two!"), (3, None), (4, "..."), (5, " ".join(body[:9]) + " nowhere"), (2, "one two")]
    got = as_rows(decontaminate.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).drop("_text"))

    def words(text):
        import re

        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {(tuple(words(t)[k : k + 10]), i) for i, t in items for k in range(max(len(words(t)) - 9, 1)) if words(t)}
    expected = []
    for i, text in texts:
        own, hit, ids = words(text), set(), set()
        for window, item in windows:
            for k in range(len(own) - len(window) + 1):
                if tuple(own[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    ids.add(str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        expected.append((i, len(own), len(hit), len(ids), digest, bool(hit)))
    assert got == sorted(expected, key=repr) and any(r[5] for r in got)


@pytest.mark.parametrize("block_grams", [jaccard.BLOCK_GRAMS, 400])
def test_jaccard_components(spark, texts, block_grams):
    got = as_rows(jaccard.jaccard_components(frame(spark, texts), block_grams=block_grams))
    sets = []
    for _, text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    groups = defaultdict(list)
    for a, (i, _) in enumerate(texts):
        groups[root[a]].append(i)
    low = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    expected = [(i, len(s), low[root[a]] if s else i) for a, ((i, _), s) in enumerate(zip(texts, sets))]
    assert got == sorted(expected, key=repr)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_linked_sets_share_a_mark(percent):
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 60, 127, 250, 1000, 5000] * 3:
        grams = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        changed = 0
        while 100 * (n - changed - 1) >= percent * (n + changed + 1):
            changed += 1
        shorter = -(-percent * n // 100)
        fresh = rng.integers(1, 1 << 63, changed, dtype=np.uint64)
        for other in (np.unique(np.append(grams[changed:], fresh)), grams[:shorter], grams[n - shorter :]):
            if len(np.setxor1d(grams, other)):
                assert np.intersect1d(jaccard.marks_of(grams, percent), jaccard.marks_of(other, percent)).size
    far = [jaccard.marks_of(np.unique(rng.integers(1, 1 << 63, 250, dtype=np.uint64)), 85) for _ in range(300)]
    every = np.concatenate([np.unique(m) for m in far])
    assert len(np.unique(every)) == len(every)


def test_jaccard_cut_group_with_a_rest(spark):
    """Chains of near copies that touch but do not link: the rest meets the largest cluster in blocks of its own."""
    words = [f"w{i}" for i in range(60)]
    texts = []
    for chain in range(3):
        base = [f"{chain}x{w}" if i < 9 * chain else w for i, w in enumerate(words)]
        texts += [" ".join(base[:-1] + [f"{chain}-{k}"]) for k in range(14)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, list(enumerate(texts))), block_grams=150).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= 85 * len(x | y):
                    low[a] = min(low[a], low[b])
    assert got == dict(enumerate(low))


def test_mixing(spark, texts):
    sources = {5: "big", 6: "b", 7: None, 9: "a", 10: "a"}
    docs = frame(spark, texts, sources)
    got = mixing.mix(docs, mixing.words_in(F.col("text")))
    rows = got.select("source", "size", "source_size", "target", "repeats").collect()
    assert len(rows) == len(texts) and as_rows(got) == as_rows(mixing.mix(docs.repartition(3), mixing.words_in(F.col("text"))))
    sizes = {r["source"]: r["source_size"] for r in rows}
    total = sum(sizes.values())
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    low, high = 0.0, float(total)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weight[s]) for s in sizes) < total else (low, level)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(min(3 * sizes[s], low * weight[s]))
        assert abs(sum(r["size"] * r["repeats"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
        assert all(0 <= r["repeats"] <= 3 for r in own)


def test_chat_round_trip(spark):
    odd = "a\\<|im_end|>\\\\<\\|x<|turn|>\n"
    rows = [(1, 2, "assistant", odd), (1, 1, "user", "hi"), (1, 3, "assistant", None), (1, 3, "assistant", None), (1, 4, "r\n<|", "")]
    rows += [(2, None, None, "x"), (None, 1, "assistant", "y")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_chats(turns)
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_chats(formatted).collect()}
    assert back[1] == [("user", "hi"), ("assistant", odd), ("assistant", ""), ("assistant", ""), ("r\n<|", "")]
    assert back[2] == [("", "x")] and back[None] == [("assistant", "y")]
    digest = {r["conv_id"]: r for r in chat.digests(chat.read_chats(formatted)).collect()}
    assert digest[1]["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest() and digest[1]["loss_chars"] == len(odd)


def test_hmm_is_a_distribution_and_exact(spark, texts):
    got = hmm.score_documents(frame(spark, texts), states=3, rounds=2, common=20).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, own in tokens if not out(i) for w in own)
    everything = sum(counts.values()) + len(counts) + 1
    base = sorted((len(own), sum(np.log10((counts[w] + 1) / everything) for w in own)) for _, own in tokens)
    assert np.allclose(base, sorted((r["n_tokens"], r["base_score"]) for r in got))
    draw = np.random.default_rng(2)
    emit = draw.uniform(size=(4, 2))
    model = hmm.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.4, 0.6]]), emit / emit.sum(axis=0))
    scales, _, _ = hmm._forward(model, np.array([[0, 2], [3, 0], [1, 0]], np.uint16), np.array([2, 1, 1]), None, False)
    paths = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    whole = sum(model.start[a] * model.emit[0, a] * model.move[a, b] * model.emit[3, b] * model.move[b, c] * model.emit[1, c] for a, b, c in paths)
    assert np.isclose(scales[:, 0].prod(), whole) and np.isclose(scales[:, 1].prod(), model.start @ model.emit[2])


def brute_repeats(raws, length):
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


@pytest.mark.parametrize(("length", "gram"), [(400, 100), (40, 12)])
def test_repeats(spark, texts, length, gram, monkeypatch):
    monkeypatch.setattr(repeats, "_FEW", 3)
    got = repeats.without_repeats(frame(spark, texts), length, gram).select("n_bytes", "n_removed", "n_spans", "kept")
    expected = brute_repeats([(t or "").encode() for _, t in texts], length)
    assert sorted((*r[:3], bytes(r[3])) for r in got.collect()) == sorted(expected)


def test_merge_of_front_coded_runs():
    draw = random.Random(4)
    words = sorted(bytes(draw.choices(b"ab", k=draw.randint(0, 12))) for _ in range(500))
    for parts in (1, 2, 5, 8):
        runs = []
        for k in range(parts):
            own, before = [], b""
            for w in words[k::parts]:
                shared = repeats._common(before, w, 0)
                own.append((shared, w[shared:], k))
                before = w
            runs.append(iter(own))
        merged = list(repeats.merge_runs(runs))
        assert [key for _, key, _ in merged] == words
        assert [s for s, _, _ in merged] == [repeats._common(a, b, 0) for a, b in zip([b"", *words], words)]


def test_lines(spark, texts):
    got = as_rows(lines.dedup_lines(frame(spark, texts)))
    strip = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in texts:
        for line in (text or "").split("\n"):
            holders[strip(line)].add(-1 if i is None else i)
    expected = []
    for i, text in texts:
        own = (text or "").split("\n")
        gone = [len(strip(x)) >= 10 and len(holders[strip(x)]) > 1 and min(holders[strip(x)]) != (-1 if i is None else i) for x in own]
        expected.append((i, "\n".join(x for x, g in zip(own, gone) if not g), len(own), sum(gone)))
    assert got == sorted(expected, key=repr) and any(r[3] for r in got)

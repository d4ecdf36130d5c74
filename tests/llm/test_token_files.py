"""Word-wise encoding against the library on whole texts, with the signs and letters that make words depend on each other."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from alarmlens.llm import token_files
from alarmlens.llm.queries_learned import tokenizer_path

# Letters whose lower case or composed form is longer or shorter, combining marks, other white space, special tokens, controls.
ODD = ["İ", "İ", "ı", "J̌", "T̈", "H̱", "Å", "Å", "K", "ß", "ẞ", "ǅ", "Σ", "ς", "क़", "क़", "각", "각"]
ODD += ["́", "ͅ", " ", "\u0085", " ", "​", "\0", "\x1c", "\x7f", "²", "Ⅷ", "٣", "漢", "字", "😀", "ﬁ", "Ł", "×", "÷"]
ODD += ["<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'S", "'ll", "'", "_", "</w>"]
PLAIN = list("abcdeTILQüéñ") + list(".,!|*$%&#-()") + list("0379") + list(" \n\t\r\f\v") * 3


def drawn(n, seed=4):
    draw = random.Random(seed)
    for i in range(n):
        pool = PLAIN + ODD * (i % 3)
        yield "".join(draw.choices(pool, k=draw.randint(0, 40)))


def test_words_as_whole_texts():
    settings = open(tokenizer_path(), encoding="utf-8").read()
    library = Tokenizer.from_str(settings)
    encoder = token_files.WordEncoder(settings, *token_files.word_rules(settings))
    assert encoder.by_word and encoder.folds
    texts = ["GAZİ. TATİLİ, x", "J̌. T̈,", None, "", *drawn(50_000)]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        ids, counts = encoder.batch(some)
        expected = [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]
        for text, own, theirs in zip(some, np.split(ids, np.cumsum(counts)[:-1]), expected, strict=True):
            assert own.tolist() == theirs, repr(text)


def test_forgotten_words(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 50)
    settings = open(tokenizer_path(), encoding="utf-8").read()
    library, encoder = Tokenizer.from_str(settings), token_files.WordEncoder(settings, *token_files.word_rules(settings))
    for text in drawn(200, seed=9):
        assert encoder.batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizers_that_keep_white_space(name):
    settings = open(tokenizer_path(name), encoding="utf-8").read()
    library, encoder = Tokenizer.from_str(settings), token_files.WordEncoder(settings, *token_files.word_rules(settings))
    assert not encoder.by_word
    texts = [None, "two  words\n", *drawn(300)]
    ids, counts = encoder.batch(texts)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_words_met_again_are_kept(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 50)
    settings = open(tokenizer_path(), encoding="utf-8").read()
    library, encoder = Tokenizer.from_str(settings), token_files.WordEncoder(settings, *token_files.word_rules(settings))
    learned, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.extend(words.to_pylist()), learn(words)))
    draw = random.Random(3)
    for _ in range(20):
        text = " Often THE same, wörter: x-9 ü. ".join("".join(draw.choices("abcdeü.-", k=12)) for _ in range(12))
        assert encoder.batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.place) < 80 and all(learned.count(w) == 1 for w in ("the", "same,", "wörter:", "x-9"))


def test_white_space_is_that_of_bytes():
    settings = open(tokenizer_path(), encoding="utf-8").read()
    library, encoder = Tokenizer.from_str(settings), token_files.WordEncoder(settings, *token_files.word_rules(settings))
    texts = [f"{chr(i)}Ab{chr(i)}{chr(i)}cD.{chr(i)}" for i in [*range(0x3000), 0x3000, 0xFEFF, 0xFFFD, 0x1F600]]
    ids, counts = encoder.batch(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


class Rows:
    """Stands for a frame: gives back the function that Spark would run in its tasks."""

    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def batch_of(texts, kind):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, kind)], ["doc_id", "text"])


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", pa.string()), ("word_bpe_49k.json", pa.large_string()), ("byte_bpe_50k.json", pa.string())])
def test_parts_of_a_batch(monkeypatch, name, kind):
    groups = token_files._groups
    monkeypatch.setattr(token_files, "_groups", lambda texts: groups(texts, 60))
    library = Tokenizer.from_file(tokenizer_path(name))
    texts = [None, "", *drawn(200, seed=6), None, "long words " * 30, "", None]
    run = token_files.encode_documents(Rows(), tokenizer_path(name))
    out = pa.Table.from_batches(run(iter([batch_of(texts, kind), batch_of([], kind), batch_of(texts[3:], kind).slice(2)])))
    ids = [np.frombuffer(zstandard.decompress(v), np.uint16).tolist() for v in out["ids"].to_pylist()]
    expected = [library.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID] for t in texts + texts[5:]]
    assert ids == expected and out["doc_id"].to_pylist() == [*range(len(texts)), *range(2, len(texts) - 3)]
    assert out.num_rows == 2 * len(texts) - 5


def test_memory_does_not_follow_the_batch():
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdeü.-", k=7)) for _ in range(2000)]
    parts = [" ".join(draw.choices(words, k=100)) for _ in range(300)]
    batch = batch_of([" ".join(draw.choices(parts, k=16)) for _ in range(2500)], pa.string())
    run = token_files.encode_documents(Rows(), tokenizer_path())
    assert sum(b.num_rows for b in run(iter([batch.slice(0, 200)]))) == 200
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch]))) == 2500
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 30e6 and peak < batch.nbytes * 0.7, (batch.nbytes, peak)

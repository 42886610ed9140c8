"""Packing and token counts against the tokenizer's library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing, token_counts
from tidemark.llm.queries import TOKENIZER

tokenizers = pytest.importorskip("tokenizers")

ODD = [
    None, "", " ", "plain words here", "don't you're we'll 'sure ''s x' I'd've ''re '''ll", "<|endoftext|>a<|startoftext|>b <|endoftext|>",
    "ΑΣ ΣΑΣ Σ", "é café ́x", "123 4५६", "日本語テキスト 漢字 👩‍👩‍👧", "\x00\x1c\x85  a​b",
    "İstanbul STRASSE ß ŉ", "a" * 3000, "-" * 2000 + "x", "aaaa" * 50 + "!!!???", "</w> w</w>", "word " * 5000, "plain words here",
]


def encode(texts):
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, texts)], "doc_id long, text string, rank int, ids string").repartition(3)


def test_counts_are_the_library_s(spark):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, ODD), TOKENIZER, 2048).collect()}
    for i, ids in enumerate(encode(ODD)):
        assert got[i].n_tokens == len(ids), repr(ODD[i])
        assert got[i].n_bytes == len((ODD[i] or "").encode())
        assert got[i].over_limit == (len(ids) > 2048)


def test_states_and_words_can_be_forgotten():
    whole = token_counts.transducer(TOKENIZER)
    texts = [t or "" for t in ODD]
    for small in (token_counts.Transducer(TOKENIZER, max_states=50), token_counts.Transducer(TOKENIZER, max_words=20)):
        for part in (texts, texts[::-1], texts[5:9], texts):
            assert (small.count(part) == whole.count(part)).all()
            assert (small.encode(part)[0] == whole.encode(part)[0]).all()


def test_maps_of_chunks_are_composed():
    rng = random.Random(6)
    texts = ["a" * n for n in (255, 256, 257, 512, 513, 5000)] + ["é" * 700, "日本" * 900, "ab" * 400 + "c" * 400]
    texts += ["".join(rng.choices("abcdeé", k=rng.randrange(250, 4000))) for _ in range(40)]
    machine = token_counts.Transducer(TOKENIZER)
    ids, bounds = machine.encode(texts)
    for k, want in enumerate(encode(texts)):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want


def test_pre_tokens_of_one_hash(monkeypatch):
    monkeypatch.setattr(token_counts, "span_hash", lambda raw, start, end: (end - start).astype(np.uint64))
    texts = ["the cat has one hat", "a dog and the cow", "cat dog hat the one two"]
    machine = token_counts.Transducer(TOKENIZER)
    for part in (texts, texts[::-1]):
        ids, bounds = machine.encode(part)
        for k, want in enumerate(encode(part)):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == want


def test_every_id_lies_in_one_piece(spark):
    texts = ODD + ["some words", "other words of a text"] * 40
    ids = [None, 5, 5] + list(range(10, 10 + len(texts) - 3))
    got = packing.pack_documents(docs(spark, texts, ids), TOKENIZER, window=64, with_ids=True).collect()
    want = defaultdict(list)
    for i, x in zip(ids, encode(texts)):
        want[i].append(x + [1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(sequences) == -(-total // 64)
    for i, lists in want.items():
        for x in lists:
            found = [p for (d, n), ps in pieces.items() if d == i and n == len(x) for p in ps]
            copies = sum(y == x for y in lists)
            for start in {s for s, _ in found}:
                assert sum(s == start for s, _ in found) >= copies
            assert sum(len(p) for _, p in found) == len(x) * sum(len(y) == len(x) for y in lists)
            at = 0
            while at < len(x):
                at += next(len(p) for s, p in found if s == at and p == x[at : at + len(p)])


def test_plan_fills_windows_exactly():
    hist = np.zeros(64, np.int64)
    hist[[10, 20, 34, 44, 54]] = [50, 40, 30, 20, 30]
    p = packing.plan(hist, 64)
    assert (p.planned <= hist).all() and p.planned.sum() > 100
    fill = defaultdict(int)
    for length in range(64):
        for s in range(p.slot_of[length], p.slot_of[length + 1]):
            nxt = p.first[s + 1] if s + 1 < p.slot_of[length + 1] else p.planned[length]
            for k in range(nxt - p.first[s]):
                fill[int(p.sequence[s]) + k] += length
    assert set(fill.values()) == {64} and sorted(fill) == list(range(p.row_sequence))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    assert token_counts.count_tokens(none, TOKENIZER, 10).count() == 0

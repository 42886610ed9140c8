"""Extendible hashing against a plain split of buckets."""

import hashlib
from collections import Counter, defaultdict

from tidemark.llm import sharding


def hash60(i, t):
    inner = hashlib.md5((t or "").encode()).hexdigest()
    return int(hashlib.md5(f"{'' if i is None else i}={inner}".encode()).hexdigest()[:15], 16)


def brute(rows, limit):
    """(id, bytes, depth, prefix) by splitting the fullest bucket bit by bit."""
    items = [(hash60(i, t), i, len((t or "").encode())) for i, t in rows]
    out, open_ = [], [(0, 0, items)]
    while open_:
        depth, prefix, own = open_.pop()
        if sum(b for _, _, b in own) <= limit or len({h for h, _, _ in own}) <= 1:
            out += [(i, b, depth, prefix) for _, i, b in own]
            continue
        for bit in (0, 1):
            open_.append((depth + 1, prefix * 2 + bit, [x for x in own if (x[0] >> (59 - depth)) & 1 == bit]))
    return Counter(out)


def check(spark, rows, limit):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, depth int, page int").repartition(4)
    got = sharding.shard_documents(df, limit).collect()
    assert Counter((r.doc_id, r.n_bytes, r.depth, r.prefix) for r in got) == brute(rows, limit)
    shards = defaultdict(list)
    for r in got:
        shards[r.depth, r.prefix, r.page].append(r)
    for own in shards.values():
        assert {r.shard_bytes for r in own} == {sum(r.n_bytes for r in own)}
        assert len(own) == 1 or own[0].shard_bytes <= limit
    return shards


def test_buckets(spark):
    rows = [(i, "x" * (i * 37 % 200)) for i in range(300)]
    shards = check(spark, rows, 1000)
    assert len(shards) > 20 and len({d for d, _, _ in shards}) > 1


def test_hot_keys_long_texts_nulls_and_copies(spark):
    rows = [(7, f"text {k} " * 5) for k in range(100)]  # one id, many texts
    rows += [(8, "same " * 10)] * 100  # copies pass the limit by themselves
    rows += [(9, "y" * 5000), (None, None), (None, "z"), (10, None), (11, ""), (11, "")]
    shards = check(spark, rows, 400)
    assert len([s for s in shards if s[2] > 0]) >= 12


def test_a_deep_split_takes_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROUND_BITS", 1)
    check(spark, [(i, "w" * 50) for i in range(64)], 60)


def test_small_and_empty_tables(spark):
    assert {k[:2] for k in check(spark, [(1, "a"), (2, None)], 100)} == {(0, 0)}
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0

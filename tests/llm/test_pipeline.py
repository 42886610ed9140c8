"""The stages of the corpus pipeline, each on its own input, by brute force."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import test_near_dup, test_substring
from tidemark.llm.tables import stored, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SF), "test-stage")
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps, spark):
    names = table(spark, SF, "documents").columns
    assert len(steps) == 5 and all(made.columns == names for _, made in steps[:-1])
    for _, made in steps[:-1]:
        assert all(r.n_chars == len(r.text) for r in made.collect() if r.text is not None)


def test_quality_drops_low_and_keeps_clean(steps, spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after = ({r.doc_id for r in df.collect()} for df in steps[0])
    good, bad = ({i for i in before if labels.get(i) == y} for y in (1, 0))
    assert after < before and len(good & after) >= 0.97 * len(good) and len(bad & after) <= 0.1 * len(bad)


def test_one_of_each_class(steps):
    before, after = map(rows, steps[1])
    classes = defaultdict(set)
    for i, c, _ in test_near_dup.expected(before):
        classes[c].add(i)
    assert sorted(i for i, _ in after) == sorted(classes)
    assert set(after) <= set(before)


def test_repeated_passages_go(steps):
    before, after = map(rows, steps[2])
    want = {r[0]: r[2] for r in test_substring.brute(before, 50)}
    texts = dict(before)
    assert len(after) == len(before)
    for i, t in after:
        assert (t == texts[i]) if not want[i] else (len(t.split()) == len(texts[i].split()) - want[i])


def test_sources_meet_their_targets(steps):
    size = lambda t: len((t or "").split())
    before, after = (df.collect() for df in steps[3])
    have, got = Counter(), Counter()
    for r in before:
        have[r.source] += size(r.text)
    for r in after:
        got[r.source] += size(r.text)
    names = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(have.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * have[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * have[s]
        rest -= sum(target[s] for s in full)
        open_ -= full
    target |= share
    assert all(abs(got[s] - target[s]) <= 1 for s in names)
    own = {r.doc_id: r for r in before}
    taken = Counter()
    for r in after:
        assert own[r.doc_id].text == r.text or " ".join(own[r.doc_id].text.split()).startswith(r.text)
        taken[r.doc_id] += size(r.text)
    assert all(n <= 3 * size(own[i].text) for i, n in taken.items())


def test_packing_takes_every_token(steps):
    before, pieces = (df.collect() for df in steps[4])
    sequences = defaultdict(list)
    tokens = Counter()
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        tokens[p.doc_id] += p.length
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(tokens) == {r.doc_id for r in before}
    assert len(sequences) == -(-sum(tokens.values()) // 2048)

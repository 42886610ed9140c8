"""The classifier's held-out accuracy, its contract and its edges."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import quality
from tidemark.llm.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def report(spark):
    return quality.quality_report(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()


def test_held_out_accuracy(spark, report):
    labels = table(spark, SF, "labels").toPandas().set_index("doc_id")["quality"]
    r = report[report.held_out & report.doc_id.isin(labels.index)]
    y = labels.loc[r.doc_id].to_numpy()
    assert (r.predicted == y).mean() > 0.95
    good, bad = r.score[y == 1].to_numpy(), r.score[y == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_contract(report):
    assert len(report) == 1000 and report.score.between(0, 1).all()
    assert (report.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in report.doc_id]).all()
    assert (report.predicted == (report.score >= 0.3)).all()


def test_held_out_labels_are_not_used(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    seen = labels.where(quality.remainder(labels.doc_id) != 0)
    assert quality.fit(docs, labels) == quality.fit(docs, seen)


def test_scores_are_dot_products():
    s = quality.Settings(bits=12)
    texts = pa.array(["a b c a", "X!! y!! X!!", "", None, "and and and"])
    w = np.random.default_rng(0).normal(size=1 << 12).astype(np.float32)
    got = quality.scores(texts, w, 0.5, s)
    for t, g in zip(texts.to_pylist(), got):
        slot, _ = quality.ngrams(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), 12)
        z = 0.5 + (w[slot].astype(float).mean() * s.scale if len(slot) else 0)
        assert g == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_edges(spark):
    rows = [(1, "good words here", 5, "x"), (1, "good words here", 5, "x"), (None, None, 1, None), (2, "", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score int, c1 string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.quality_report(docs, none).collect()} == {0.5}
    assert quality.keep_quality(docs, none).columns == docs.columns
    assert quality.keep_quality(docs, none).count() == 4
    assert quality.quality_report(docs.limit(0), none).count() == 0


def test_training_is_ftrl_by_plain_loops():
    """Follow-the-regularised-leader, coordinate by coordinate."""
    s = quality.Settings(bits=10, epochs=2)
    texts = ["good clear words here", "BAD!! bad!! $$$", "more clear words", "", "$$$ BAD BAD", "clear here"] * 3
    labels = [1, 0, 1, 1, 0, 1] * 3
    z, n = {}, {}

    def weight(k):
        if k == "bias":
            return -z.get(k, 0.0) / ((s.beta + math.sqrt(n.get(k, 0.0))) / s.alpha)
        v = z.get(k, 0.0)
        if abs(v) <= s.l1:
            return 0.0
        return -(v - math.copysign(s.l1, v)) / ((s.beta + math.sqrt(n.get(k, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for t, y in zip(texts, labels):
            raw = t.encode()
            slot = quality.ngrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), s.bits)[0].tolist()
            x = {k: slot.count(k) * s.scale / len(slot) for k in set(slot)} | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            g = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - y
            for k, v in x.items():
                was = n.get(k, 0.0)
                n[k] = was + (g * v) ** 2
                z[k] = z.get(k, 0.0) + g * v - (math.sqrt(n[k]) - math.sqrt(was)) / s.alpha * w[k]
    weights, bias = quality.train(pa.array(texts), np.array(labels), s)
    assert bias == pytest.approx(weight("bias"), rel=1e-4)
    want = np.array([weight(k) if k in z else 0.0 for k in range(1 << s.bits)])
    np.testing.assert_allclose(weights, want, rtol=1e-3, atol=1e-5)

import zlib

import numpy as np
import pyarrow as pa
import pytest

from notegraph.llm.common import table
from notegraph.llm.quality import FEATURES, Additive, features, fit, score_quality, train
from helpers import CLASHING, awkward


def test_tables_learn_a_step_and_a_pair():
    r = np.random.default_rng(1)
    x = r.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0.2) ^ ((x[:, 1] > 0) & (x[:, 2] > 0.3))).astype(float)
    model = fit(x[:3000], y[:3000])
    assert (1, 2) in model.pairs or (0, 1) in model.pairs or (0, 2) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_without_labels_or_with_one():
    assert fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert fit(np.zeros((8, 3)), np.ones(8)).score(np.zeros((1, 3)))[0] == pytest.approx(0.9)


def test_features_do_not_depend_on_neighbours():
    texts = [t for _, t, *_ in awkward()] + ["a b a\nx\nx\n", "##% | |"]
    together = features(pa.array(texts))
    assert together.shape == (len(texts), len(FEATURES))
    for text, row in zip(texts, together):
        assert np.allclose(features(pa.array([text], pa.string()))[0], row)
    assert not together[0].any() and not together[1].any()
    assert features(pa.array([], pa.string())).shape == (0, len(FEATURES))


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t, *_ in awkward()], CLASHING)
    got = score_quality(docs, Additive(base=1.0)).collect()
    assert len(got) == docs.count() and all(r["predicted"] == 1 for r in got)
    assert score_quality(docs.limit(0), Additive()).count() == 0
    labels = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    assert train(docs, labels).score(np.zeros((1, len(FEATURES))))[0] == 0.5


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = score_quality(docs, train(docs, labels)).join(labels, "doc_id").collect()
    held = [(r["predicted"], r["quality"]) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.95

import numpy as np
import pyarrow as pa

from notegraph.llm import toxicity
from notegraph.llm.toxicity import Network, score_toxicity, scores, train_network, windows_of, words_of
from helpers import CLASHING, awkward, random_texts


def test_gradients():
    network = Network(3)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    codes, rows, words, grams = words_of(pa.array(["some bad words here", "and two", "a"]))
    x = network.inputs(words, grams).astype(np.float64)
    length = np.bincount(rows)
    start = np.cumsum(length) - length
    target = np.array([1.0, 0.0, 1.0])

    def loss():
        z = network.forward(x, codes, start, length)
        return (np.logaddexp(0, z) - target * z).sum()

    keep = {}
    z = network.forward(x, codes, start, length, keep)
    g, d_x = network.gradients(x, 1 / (1 + np.exp(-z)) - target, keep)
    r = np.random.default_rng(0)
    for k in ("xf", "uf", "cf", "xb", "ub", "cb", "v", "w", "b"):
        at = tuple(r.integers(0, n) for n in network.p[k].shape)
        old = network.p[k][at]
        network.p[k][at] = old + 1e-4
        up = loss()
        network.p[k][at] = old - 1e-4
        down = loss()
        network.p[k][at] = old
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3, k
    at = (1, 3)
    x[at] += 1e-4
    up = loss()
    x[at] -= 2e-4
    assert abs((up - loss()) / 2e-4 - d_x[at]) < 1e-3


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 118, 119, 500):
        first, length, _ = windows_of(np.zeros(n, int), 1)
        covered = {k for a, m in zip(first, length) for k in range(a, a + m)}
        assert covered == set(range(n))
    assert len(windows_of(np.zeros(5000, int), 1, 10)[0]) == 10


def test_learns_a_word_from_labels_of_texts():
    r = np.random.default_rng(1)
    texts = random_texts(400, 3, 28, 60)
    labels = (r.random(400) < 0.3).astype(int)
    texts = [t + " w1 grubbish w2 " + t if y else t for t, y in zip(texts, labels)]
    network = train_network(texts[:300], np.arange(300), labels[:300])
    assert ((scores(network, pa.array(texts[300:])) >= 0.5) == labels[300:]).mean() > 0.95


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t, *_ in awkward()], CLASHING)
    network = Network()
    got = score_toxicity(docs, network).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(docs.limit(0), network).count() == 0
    texts = [t for _, t, *_ in awkward()]
    together = scores(network, pa.array(texts))
    assert np.allclose(together, [scores(network, pa.array([t], pa.string()))[0] for t in texts], atol=1e-5)
    labels = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    assert toxicity.train(docs, labels).p.keys() == network.p.keys()

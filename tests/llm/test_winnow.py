import hashlib
import random

from pyspark.sql import functions as F

from notegraph.llm.winnow import GRAM, WINDOW, fingerprint, fingerprints, hash_of, position
from helpers import CLASHING, awkward, documents, random_texts


def prints(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", fingerprint(F.col("text")).alias("p"))
    rows = rows.select("k", F.transform("p", position).alias("pos"), F.transform("p", hash_of).alias("hash")).collect()
    return [list(zip(r["pos"], r["hash"])) for r in sorted(rows, key=lambda r: r["k"])]


def test_against_brute_force(spark):
    """Hashes of all runs come from texts that are one run each; what is chosen of them must be the same."""
    texts = random_texts(25, 3, 60, 3)
    units = [t.split() for t in texts]
    runs = sorted({tuple(u[i : i + GRAM]) for u in units for i in range(max(1, len(u) - GRAM + 1)) if u})
    of_run = {run: found[0][1] for run, found in zip(runs, prints(spark, [" ".join(r) for r in runs]))}
    for u, found in zip(units, prints(spark, texts)):
        h = [of_run[tuple(u[i : i + GRAM])] for i in range(max(1, len(u) - GRAM + 1))] if u else []
        chosen = set()
        for i in range(max(1, len(h) - WINDOW + 1)) if h else ():
            low = min(h[i : i + WINDOW])
            chosen.add(max(k for k in range(i, min(i + WINDOW, len(h))) if h[k] == low))
        assert found == [(k, h[k]) for k in sorted(chosen)]


def test_rightmost_ties_and_long_units(spark):
    equal, few, none, unbroken = prints(spark, ["a " * 20, "a b", " ", "x" * 400])
    assert [p for p, _ in equal] == list(range(WINDOW - 1, 20 - GRAM + 1))
    assert len(few) == 1 and none == [] and len(unbroken) > 1


def test_guarantee(spark):
    r = random.Random(4)
    passage = [f"p{k}" for k in range(WINDOW + GRAM - 1)]
    texts = []
    for _ in range(20):
        noise = [f"n{r.random()}" for _ in range(50)]
        at = r.randint(0, 50)
        texts.append(" ".join(noise[:at] + passage + noise[at:]))
    found = [{h for _, h in p} for p in prints(spark, texts)]
    assert all(a & b for a in found for b in found)


def edited(text, following):
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def check(spark, docs, rows):
    got = sorted(fingerprints(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]))
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    expected = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        expected.append((i, len(text), hashlib.sha256(edited(text, following).encode()).hexdigest()))
    expected.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == expected
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    return got


def test_edited_texts(spark):
    texts = random_texts(700, 5, 30, 400) + ["ñandú " * 40]
    got = check(spark, documents(spark, texts).repartition(5), list(enumerate(texts)))
    assert sum(r["near_edited"] for r in got) > sum(r["near_next"] for r in got)
    by_text = {}
    for t, r in zip(texts, sorted(got, key=lambda r: r["doc_id"])):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in awkward()] + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t in rows], CLASHING)
    check(spark, docs, rows)
    assert fingerprints(docs.limit(0)).count() == 0
    assert fingerprints(documents(spark, ["alone with itself"])).first()["near_next"] == 1.0

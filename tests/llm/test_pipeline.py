import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from notegraph.llm.common import written
from notegraph.llm.packing import word_ids
from notegraph.llm.pii import base_spans
from helpers import random_texts
from test_decontaminate import brute as hits
from test_jaccard import brute as groups

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # The planted cases of the other tests, among the documents.
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 100").first()["text"]
    extra = [(10_000 + k, t, "en", "s", len(t)) for k, t in enumerate([*random_texts(5, 1, 60, 200), f"start {item} end", "mail a9@mail.example.com " + "and the of " * 20])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    state = written(docs)
    kept = [state]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = written(stage(spark, state, FOLDER))
        assert state.columns == docs.columns
        kept.append(state)
    rows = [{r["doc_id"]: r["text"] for r in frame.collect()} for frame in kept]
    good, single, clean, masked = rows[1:]
    assert good.keys() <= rows[0].keys() and len(good) > 0.7 * len(rows[0])
    assert single.keys() == {i for i, _, c in groups(sorted(good.items())) if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    ids = sorted(single)
    assert clean.keys() == {i for i, h in zip(ids, hits([single[i] for i in ids], items)) if not h[4]}
    assert 10_005 not in clean and masked.keys() == clean.keys()
    assert all(not base_spans(t) for t in masked.values()) and any(masked[i] != clean[i] for i in clean)
    assert all(masked[i] == t for i, t in clean.items() if not any(c in t for c in "@+0123456789"))
    packed = corpus_pipeline.STAGES[-1][1](spark, state, FOLDER).collect()
    tokenizer = word_ids(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    _, counts = tokenizer.encode(pa.array(list(masked.values())))
    assert sum(r["length"] for r in packed) == counts.sum() + len(masked)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_awkward_rows_go_through_every_stage(spark):
    """Null, empty and repeated rows, null ids, and extra columns with the names that stages use themselves."""
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30).select("text").collect()
    rows = [(k, t["text"]) for k, t in enumerate(texts)] + [(3, texts[4]["text"]), (None, texts[5]["text"]), (3, texts[3]["text"]), (90, None), (91, ""), (None, None), (92, "x" * 50_000)]
    clashing = "1 AS score, 2 AS predicted, 'c' AS copy, 3 AS key, 4 AS window_id, 5 AS n, 'p' AS spans, 6 AS first, 7 AS label".split(", ")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", *clashing)
    for empty in (False, True):
        state = written(docs.limit(0) if empty else docs)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = written(stage(spark, state, FOLDER))
            assert state.columns == docs.columns
        left = {r["text"] for r in state.collect()}
        assert len(left) <= len(rows) and (not empty or not left)
        packed = corpus_pipeline.STAGES[-1][1](spark, state, FOLDER).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in state.collect()}

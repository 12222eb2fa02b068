"""The registered queries of the corpus operators: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from notegraph.llm import (
    decontaminate, gridcodes, jaccard, license, lm_score, merkle, packing, pii, polytope, quality, toxicity, warc, winnow,
)
from notegraph.llm.common import held_out, table

TOKENIZER = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality.train(documents, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("copy")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return lm_score.score(documents, *lm_score.train(documents))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(table(spark, sf_dir, "pages"))

    def page(column: str):
        return F.regexp_extract(column, r"<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")

    return found.where("reason IS NULL").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(documents, pii.train(documents))
    base = F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), base, "spans", (F.col("spans") != "").alias("has_personal_data"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("copy", "first")


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", digest, "folded_root", "verified")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridcodes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def vector_codes_sql(rounds: int = gridcodes.ROUNDS, entries: int = gridcodes.ENTRIES) -> str:
    """The codes as one statement: a pair of common tables (nearest entries, next codebook) for each round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT vec_id, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry FROM (
                SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{k} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL
            ) GROUP BY vec_id, part
        )""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
                SELECT part, entry, pos, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{k} JOIN p USING (vec_id, part) GROUP BY ALL
            ) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos
        )""")
    listed = ",\n        ".join(steps)
    return f"""
        WITH kept AS (
            SELECT vec_id, label, embedding AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (
            SELECT vec_id, i // (n // 4) AS part, i % (n // 4) AS pos, CAST(floor(1024 * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
            FROM (SELECT vec_id, v, len(v) AS n, unnest(range(len(v))) AS i FROM kept)
        ), b0 AS MATERIALIZED (
            SELECT part, r - 1 AS entry, pos, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM kept) USING (vec_id) WHERE r <= {entries}
        ), {listed}, coded AS (
            SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_lm_score": op3_lm_score,
    "op4_warc": op4_warc,
    "op5_license": op5_license,
    "op6_winnowing": op6_winnowing,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_jaccard": op10_jaccard,
    "op11_near_vectors": op11_near_vectors,
    "op12_merkle": op12_merkle,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), items AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS window_text
            FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)
        ), sizes AS (SELECT DISTINCT n FROM items
        ), places AS (
            SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS window_text
            FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)
        ), hits AS (SELECT doc_id, item_id, s, n FROM places JOIN items USING (n, window_text)
        ), covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, s + unnest(range(n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), k AS (SELECT payload, max(page_id) AS kept FROM p GROUP BY payload
        ), h AS (SELECT page_id, kept, strlen(payload) AS payload_bytes, sha1(payload) AS digest FROM p JOIN k USING (payload)
        )
        SELECT page_id, payload_bytes, (
                SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(digest, 1 + 5 * (i // 4), 5)) AS INTEGER) // CAST(pow(32, 3 - i % 4) AS INTEGER) % 32, 1), '' ORDER BY i)
                FROM range(32) AS t(i)
            ) AS payload_digest,
            CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM h
    """,
    "op10_jaccard": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
        ), near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) m USING (doc_id)
    """,
    "op11_near_vectors": """
        WITH RECURSIVE ok AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), near AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
        FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM near GROUP BY a) USING (vec_id)
            LEFT JOIN (SELECT a AS vec_id, min(b) AS low FROM reach GROUP BY a) USING (vec_id)
    """,
    "op12_merkle": r"""
        WITH RECURSIVE texts AS (
            SELECT *, CASE WHEN list_reduce(
                    list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ord(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END
                ) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents
        ), leaves AS MATERIALIZED (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c
            FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM texts)
        ), grown AS (
            SELECT source, 0 AS level, i, leaf AS h, c FROM leaves
            UNION ALL
            SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (c + 2) // 3 FROM grown WHERE c > 1 GROUP BY source, level, i // 3, c
        ), subroots AS MATERIALIZED (
            SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM grown WHERE c = 1
        ), above AS (
            SELECT 0 AS level, i, subroot AS h, c FROM subroots
            UNION ALL
            SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (c + 2) // 3 FROM above WHERE c > 1 GROUP BY level, i // 3, c
        ), beside AS MATERIALIZED (
            SELECT a.source, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM grown a JOIN grown b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.c > 1 GROUP BY ALL
        ), beside_above AS MATERIALIZED (
            SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
            FROM above a JOIN above b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.c > 1 GROUP BY ALL
        ), steps AS MATERIALIZED (
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, level) AS step, l, r FROM (
                SELECT d.doc_id, 0 AS part, b.level, b.l, b.r FROM leaves d JOIN beside b
                    ON d.source IS NOT DISTINCT FROM b.source AND b.i = d.i // CAST(pow(3, b.level) AS BIGINT)
                UNION ALL
                SELECT d.doc_id, 1, b.level, b.l, b.r FROM leaves d JOIN subroots s ON d.source IS NOT DISTINCT FROM s.source
                    JOIN beside_above b ON b.i = s.i // CAST(pow(3, b.level) AS BIGINT))
        ), folded AS (
            SELECT doc_id, CAST(0 AS BIGINT) AS step, tampered AS h FROM leaves
            UNION ALL
            SELECT f.doc_id, s.step, sha256(s.l || f.h || s.r) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step + 1
        ), ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM folded GROUP BY doc_id
        ), proofs AS (SELECT doc_id, string_agg(l || r, '' ORDER BY step) AS proof FROM steps GROUP BY doc_id
        ), top AS (SELECT h AS root FROM above WHERE c = 1)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM leaves JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id) JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source, top
    """,
    "op13_vector_codes": vector_codes_sql(),
}

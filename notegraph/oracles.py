"""DuckDB statements that give the registered queries' results from the same tables."""

from __future__ import annotations

from notegraph.catalog import NOW, PREFIXES, SUFFIXES, THRESHOLD
from notegraph.functions.text import WHITESPACE
from notegraph.operators import corpus, patches
from notegraph.operators.links import DECISION_AGENT, NO_REASON, PATCH_AGENT
from notegraph.sources.notes import UNREADABLE

HOUR = 3_600_000_000
_START = "epoch_us(TIMESTAMP '2024-01-01')"
_NOW = f"epoch_us(TIMESTAMP '{NOW}')"
# No time is -1 in results.
_TIMES = "coalesce(embedded_us, -1) AS embedded_us, coalesce(backlinked_us, -1) AS backlinked_us"
_CHUNK = "path, chunk_index, chunk_start, chunk_end, content_hash, modified_us, embedded_us, backlinked_us, chunk_hash"
_THROUGH = r"'(?si)\A(?:.*?\n)??## Backlinks\n'"


def _chunks(source: str, columns: str) -> str:
    """Chunk rows of a relation with `path` and `content`."""
    return f"""
    SELECT path, i::INT AS chunk_index, (i * 1000)::INT AS chunk_start,
        least(i * 1000 + 1000, length(content))::INT AS chunk_end,
        substring(content, i * 1000 + 1, 1000) AS raw_content, {columns}
    FROM (SELECT *, unnest(range((length(content) + 999) // 1000)) AS i FROM {source})"""


def _rows(relation: str) -> str:
    """Chunk rows as results."""
    return f"SELECT * REPLACE ({_TIMES}) FROM (SELECT {_CHUNK} FROM {relation})"


def _strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def _section(relation: str, mode: str) -> str:
    """Adds head, body and behind of the section to rows with `content`. In full mode the body is what is left when
    the first line that starts with a level-two heading and all below it are taken away, without the last line end."""
    left = r"regexp_replace(rest, '(?ms)^## .*\z', '')"
    body = {
        "full": f"CASE WHEN length({left}) < length(rest) THEN regexp_replace({left}, '\\n\\z', '') ELSE rest END",
        "reference": "split_part(rest, chr(10), 1)",
    }[mode]
    return f"""
    SELECT *, substr(rest, length(body) + 1) AS behind FROM (
        SELECT *, {body} AS body FROM (
            SELECT *, substr(content, length(head) + 1) AS rest FROM (
                SELECT *, regexp_extract(content, {_THROUGH}) AS head FROM {relation})))"""


def _targets(relation: str) -> str:
    return rf"""
    SELECT path, link AS similar_path FROM (
        SELECT path, regexp_extract(unnest(string_split(body, chr(10))), '-\s*\[\[([^\]]+)\]\]', 1) AS link
        FROM {relation} WHERE head <> '') WHERE link <> ''"""


def _merged(mode: str) -> str:
    """Text after merging `bullets` into rows with head, body, behind and content."""
    gap = "chr(10) || chr(10)"
    if mode == "reference":
        gap = (
            "CASE WHEN right(content, 1) <> chr(10) THEN chr(10) || chr(10) "
            "WHEN right(content, 2) = chr(10) || chr(10) THEN '' ELSE chr(10) END"
        )
    end_stripped = f"rtrim(content, '{WHITESPACE}')"
    return f"""
    CASE WHEN head <> '' THEN
        head || CASE WHEN {_strip('body')} <> '' THEN {_strip('body')} || chr(10) ELSE '' END || bullets || chr(10) || behind
    ELSE
        CASE WHEN {end_stripped} = '' THEN '' ELSE {end_stripped} || {gap} END
        || '## Backlinks' || chr(10) || bullets || chr(10)
    END"""


def _knn(vectors: str, level: str = "chunk", k: int = 5) -> str:
    """Nearest neighbours within a relation (path, chunk_index, e), e of length one or any other."""
    if level == "chunk":
        return f"""
        SELECT * REPLACE (round(similarity, 6) AS similarity) FROM (
            SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, similar_path, chunk_index) AS rank
            FROM (SELECT q.path, c.path AS similar_path, c.chunk_index, round(list_cosine_similarity(q.e, c.e), 12) AS similarity
                  FROM {vectors} q JOIN {vectors} c ON q.path <> c.path WHERE q.chunk_index = 0))
        WHERE rank <= {k}"""
    return f"""
    SELECT * REPLACE (round(similarity, 6) AS similarity) FROM (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY similarity DESC, similar_path) AS rank
        FROM (SELECT q.path, c.path AS similar_path, max(round(list_cosine_similarity(q.e, c.e), 12)) AS similarity
              FROM {vectors} q JOIN {vectors} c ON q.path <> c.path WHERE q.chunk_index = 0 GROUP BY ALL))
    WHERE rank <= {k}"""


# ---- relations by name; `needs` of each are found by the names it mentions

_RELATIONS: dict[str, str] = {}


def _relation(name: str, sql: str) -> None:
    _RELATIONS[name] = sql


def _with(select: str, recursive: bool = False) -> str:
    """The statement with the relations it needs, directly or through others, in order."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(sql: str) -> None:
        for name, text in _RELATIONS.items():
            if name not in seen and _mentions(sql, name):
                seen.add(name)
                visit(text)
                needed.append(name)

    visit(select)
    parts = ",\n".join(f"{n} AS ({_RELATIONS[n]})" for n in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{select}" if parts else select


def _mentions(sql: str, name: str) -> bool:
    words = "".join(c if c.isalnum() or c == "_" else " " for c in sql).split()
    return name in words


_relation(
    "x_disk",
    f"""SELECT source || '/' || lang || '/' || doc_id || '.md' AS path,
        replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS content,
        {_START} + doc_id * 60000000 AS modified_us, source, lang FROM documents""",
)
_relation("x_disk_chunks", _chunks("x_disk", "md5(content) AS content_hash, modified_us"))
_relation(
    "x_before",
    f"""SELECT path, CASE source WHEN 'src1' THEN content || ' (old)' WHEN 'src4' THEN content || content
            ELSE content END AS content, modified_us, source, lang FROM x_disk WHERE source <> 'src0'
        UNION ALL
        SELECT 'pages/' || page_id || '.md',
            replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
            {_START} + page_id * 60000000, 'pages', '' FROM pages""",
)
_relation(
    "x_stored",
    f"""SELECT path, chunk_index, chunk_start, chunk_end,
            CASE WHEN source = 'src5' AND chunk_index = 0 THEN 'old' ELSE hash END AS content_hash, modified_us,
            CASE source WHEN 'src2' THEN NULL WHEN 'src3' THEN modified_us - 60000000
                ELSE modified_us + 60000000 END AS embedded_us,
            CASE lang WHEN 'en' THEN modified_us + 60000000 WHEN 'fr' THEN modified_us - 60000000 END AS backlinked_us,
            md5(raw_content) AS chunk_hash, raw_content
        FROM ({_chunks('x_before', 'md5(content) AS hash, modified_us, source, lang')})""",
)
_relation(
    "x_meta",
    """SELECT path, max(content_hash) AS content_hash, min(content_hash) <> max(content_hash) AS mixed,
            CASE WHEN count(embedded_us) = count(*) THEN min(embedded_us) END AS embedded_us,
            max(chunk_index) AS last_chunk FROM x_stored GROUP BY path""",
)


def _changes(force: bool) -> str:
    return f"""
    SELECT * FROM (SELECT d.path, d.content, d.modified_us, m.last_chunk, CASE
            WHEN {force} THEN '{corpus.REASON_FORCED}'
            WHEN m.path IS NULL THEN '{corpus.REASON_NEW}'
            WHEN m.mixed OR m.content_hash <> md5(d.content) THEN '{corpus.REASON_CHANGED}'
            WHEN m.embedded_us IS NULL THEN '{corpus.REASON_NO_TIME}'
            WHEN d.modified_us > m.embedded_us THEN '{corpus.REASON_MODIFIED}' END AS reason
        FROM x_disk d LEFT JOIN x_meta m ON m.path = d.path WHERE length(d.content) > 0)
    WHERE reason IS NOT NULL"""


_relation("x_changes", _changes(False))
_relation("x_new", _chunks("x_changes", "md5(content) AS content_hash, modified_us, md5(raw_content) AS chunk_hash"))


_UNREAD = "regexp_extract({0}path, '([0-9]+)\\.md$', 1)::BIGINT % 97 = 5"


def _upserted(replace_stale: bool, populated: bool) -> str:
    """The table after an upsert; `populated`: of the notes that could be read, and without those that are gone."""
    readable = f"AND NOT ({_UNREAD.format('n.')})" if populated else ""
    stale = f"""AND NOT EXISTS (SELECT 1 FROM x_changes n WHERE n.path = s.path {readable}
            AND s.chunk_index >= (length(n.content) + 999) // 1000)"""
    present = f"AND s.path IN (SELECT path FROM x_disk n WHERE length(content) > 0 OR {_UNREAD.format('n.')})"
    return f"""SELECT * REPLACE ({_TIMES}) FROM (
    SELECT n.path, n.chunk_index, n.chunk_start, n.chunk_end, n.content_hash, n.modified_us, {_NOW} AS embedded_us,
        s.backlinked_us, n.chunk_hash
    FROM x_new n LEFT JOIN x_stored s ON s.path = n.path AND s.chunk_index = n.chunk_index WHERE TRUE {readable}
    UNION ALL
    SELECT {_CHUNK} FROM x_stored s
    WHERE NOT EXISTS (SELECT 1 FROM x_new n WHERE n.path = s.path AND n.chunk_index = s.chunk_index {readable})
    {stale if replace_stale else ''} {present if populated else ''})"""


def _vectors(prefix: str, chunks: str) -> None:
    """Registers the built-in vectors of a relation of chunks: tokens, weights, vectors of length one."""
    _relation(
        f"{prefix}tokens",
        rf"""SELECT path, chunk_index, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket, count(*) AS n FROM (
            SELECT path, chunk_index, unnest(string_split_regex(lower(raw_content), '[ \t\n\r]+')) AS token
            FROM {chunks}) WHERE token <> '' GROUP BY ALL""",
    )
    _relation(
        f"{prefix}weights",
        f"""SELECT path, chunk_index, bucket,
            (n / sqrt(sum(n * n) OVER (PARTITION BY path, chunk_index)))::FLOAT::DOUBLE AS weight FROM {prefix}tokens""",
    )
    _relation(
        f"{prefix}hashed",
        f"""SELECT path, chunk_index, list(coalesce(weight, 0.0) ORDER BY bucket) AS e FROM (
            SELECT DISTINCT path, chunk_index, b.bucket FROM {prefix}tokens, (SELECT unnest(range(64)) AS bucket) b)
        LEFT JOIN {prefix}weights USING (path, chunk_index, bucket) GROUP BY path, chunk_index""",
    )


_vectors("x_", "x_disk_chunks")
_vectors("x_text_", "x_text_chunks")
_relation(
    "x_vectors",
    """SELECT 'n' || (vec_id // 2) || '.md' AS path, (vec_id % 2)::INT AS chunk_index, embedding::DOUBLE[] AS e
        FROM embeddings
        UNION ALL
        SELECT 'c' || vec_id || '.md', 0, [(e[1] + 0.0001::DOUBLE)::FLOAT::DOUBLE] || e[2:]
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 25 = 0)""",
)
_relation("x_matches", _knn("x_vectors"))
_relation(
    "x_texts",
    """SELECT 'n' || doc_id || '.md' AS path, text || CASE doc_id % 7
            WHEN 0 THEN '' WHEN 1 THEN chr(10) WHEN 2 THEN chr(10) || chr(10)
            WHEN 3 THEN chr(10) || chr(10) || '## Backlinks' || chr(10)
            WHEN 4 THEN chr(10) || chr(10) || '## Backlinks' || chr(10) || '- [[n' || (doc_id + 1) || ']] - seen' || chr(10)
            WHEN 6 THEN chr(10) || '## Backlinks' || chr(10) || '## Next' || chr(10) || '- [[n' || (doc_id + 1) || '.md]] - other'
                || chr(10) || 'z' || chr(10)
            ELSE chr(10) || '## backlinks' || chr(10) || '- [[n' || (doc_id + 1) || '.md]] - seen' || chr(10)
                || '-  [[n' || (doc_id + 2) || '.md]] - seen' || chr(10) || '## Next' || chr(10) || 'more' || chr(10)
            END AS content FROM documents""",
)
_relation("x_text_chunks", _chunks("x_texts", "md5(content) AS content_hash"))
_relation("x_text_matches", _knn("x_text_hashed"))
_relation(
    "x_near",
    """SELECT 'n' || doc_id || '.md' AS path, 'n' || (doc_id + n) || '.md' AS similar_path, 'n' || (doc_id + n) AS stem,
            0.9::DOUBLE AS similarity, n AS rank FROM documents, (SELECT unnest([1, 2]) AS n)""",
)
_LINKED = (
    "(contains(t.content, '[[' || p.similar_path || ']]') OR "
    "contains(t.content, '[[' || regexp_replace(p.similar_path, '^(.+)\\.[^.]+$', '\\1') || ']]'))"
)


def _pairs(matches: str) -> str:
    return f"""
    SELECT p.path, p.similar_path, p.similarity, p.rank, left(t.content, 500) || '...' AS note_abstract,
        left(o.content, 500) || '...' AS similar_abstract
    FROM (SELECT path, similar_path, max(similarity) AS similarity, min(rank) AS rank FROM ({matches}) GROUP BY ALL) p
    JOIN x_texts t ON t.path = p.path JOIN x_texts o ON o.path = p.similar_path WHERE NOT {_LINKED}"""


def _decided(pairs: str) -> str:
    return f"""
    SELECT path, similar_path, rank, similarity >= {THRESHOLD} AS should_link,
        'similarity ' || printf('%.2f', similarity) AS reason, '{DECISION_AGENT}' AS agent_name FROM {pairs}"""


_relation(
    "x_pairs",
    _pairs(
        """SELECT path, similar_path, similarity, rank FROM x_matches
        UNION ALL SELECT path, similar_path, similarity, rank + 5 FROM x_near"""
    ),
)
_relation("x_match_pairs", _pairs("SELECT path, similar_path, similarity, rank FROM x_text_matches"))
_relation("x_match_links", f"SELECT * FROM ({_decided('x_match_pairs')}) WHERE should_link")
_relation("x_near_links", "SELECT path, similar_path, rank, 'near' AS reason FROM x_near")
for _mode in ("full", "reference"):
    _relation(f"x_sections_{_mode}", _section("x_texts", _mode))
    _relation(f"x_targets_{_mode}", _targets(f"x_sections_{_mode}"))


def _built(links: str, mode: str) -> str:
    return f"""
    SELECT path, md5(content) AS before_digest, md5(after) AS after_digest,
        'Agent ''{DECISION_AGENT}'' updated ''## Backlinks'' section in ''' || path || ''' with: ' || listing AS comment,
        '{PATCH_AGENT}' AS agent
    FROM (SELECT *, {_merged(mode)} AS after FROM x_sections_{mode} JOIN (
        SELECT path, string_agg('- [[' || similar_path || ']] - ' || reason, chr(10) ORDER BY rank) AS bullets,
            string_agg('[[' || similar_path || ']] (' || reason || ')', '; ' ORDER BY rank) AS listing
        FROM {links} l WHERE NOT EXISTS (
            SELECT 1 FROM x_targets_{mode} h WHERE h.path = l.path AND h.similar_path = l.similar_path)
        GROUP BY path) USING (path))
    WHERE {_strip('after')} <> {_strip('content')}"""


_relation(
    "x_patches",
    f"""SELECT conv_id * 100 + turn AS patch_id, p.path, turn AS ts, conv_id % 11 AS action, t.content AS current,
            CASE WHEN conv_id % 11 = 1 THEN 'old' ELSE t.content END AS before,
            CASE WHEN conv_id % 11 = 2 THEN t.content ELSE coalesce(t.content, '') || p.text END AS after,
            p.text AS content, CASE WHEN role = 'user' THEN md5('x') END AS seen_hash
        FROM (SELECT *, CASE WHEN conv_id % 11 IN (5, 8, 9, 10) THEN 'new/' ELSE '' END || 'n' || conv_id || '.md' AS path
              FROM conversations) p LEFT JOIN x_texts t ON t.path = p.path""",
)
# action: 0-2 and 10 replace, 3 append, 4-5 create, 6 and 8 delete, 7 and 9 something unknown
_relation("x_ordered", "SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, patch_id) AS nth FROM x_patches")
_NEXT = """CASE WHEN {0}.action IN (0, 1, 2, 10) AND {1} IS NOT NULL THEN {0}.after
    WHEN {0}.action IN (4, 5) AND {1} IS NULL THEN {0}.content
    WHEN {0}.action = 3 THEN coalesce({1}, '') || {0}.content
    WHEN {0}.action IN (6, 8) THEN NULL ELSE {1} END"""
# Each patch meets the text that the one before left.
_relation(
    "x_walk",
    f"""SELECT patch_id, path, nth, o.current AS now, {_NEXT.format('o', 'o.current')} AS next FROM x_ordered o WHERE nth = 1
        UNION ALL
        SELECT o.patch_id, o.path, o.nth, w.next, {_NEXT.format('o', 'w.next')}
        FROM x_walk w JOIN x_ordered o ON o.path = w.path AND o.nth = w.nth + 1""",
)
_relation(
    "x_resolved",
    f"""SELECT *, CASE WHEN status = 'ok' AND nth = max(CASE WHEN status = 'ok' THEN nth END) OVER (PARTITION BY path)
            THEN next END AS new_content
        FROM (SELECT o.* EXCLUDE (current), w.now AS current, w.next, CASE
                WHEN action IN (0, 1, 2, 10) AND now IS NULL THEN 'failed'
                WHEN action IN (0, 1, 2, 10) AND now = after THEN 'unchanged'
                WHEN action IN (4, 5) AND now IS NOT NULL THEN 'aborted'
                WHEN action IN (6, 8) AND now IS NULL THEN 'skipped'
                WHEN action IN (7, 9) THEN 'aborted' ELSE 'ok' END AS status,
            CASE
                WHEN action IN (0, 1, 2, 10) AND now IS NULL THEN 'target_missing'
                WHEN action IN (0, 1, 2, 10) AND now = after THEN '{patches.UNCHANGED}'
                WHEN action IN (4, 5) AND now IS NOT NULL THEN '{patches.CREATE_EXISTS}'
                WHEN action IN (6, 8) AND now IS NULL THEN 'delete_target_missing'
                WHEN action IN (7, 9) AND now IS NULL THEN '{patches.TARGET_GONE}'
                WHEN action IN (7, 9) AND md5(now) <> seen_hash THEN '{patches.TARGET_MODIFIED}'
                WHEN action IN (7, 9) THEN '{patches.UNKNOWN_ACTION}' END AS reason,
            action IN (0, 1, 2, 10) AND now IS NOT NULL AND now <> before AS before_mismatch
        FROM x_ordered o JOIN x_walk w USING (patch_id, path, nth))""",
)

_relation(
    "x_events",
    """SELECT event_id, 'u' || user_id || CASE WHEN user_id % 7 = 0 THEN '.txt' ELSE '.md' END AS path,
            CASE event_type WHEN 'click' THEN 'modified' WHEN 'view' THEN 'opened' WHEN 'signup' THEN 'created'
                WHEN 'error' THEN 'deleted' ELSE 'moved' END AS kind, epoch_us(ts) AS us FROM events""",
)


def _kinds(relation: str) -> str:
    return f"""SELECT event_id, path, CASE kind WHEN 'moved' THEN 'modified' ELSE kind END AS kind, us
    FROM {relation} WHERE kind IN ('created', 'modified', 'deleted', 'moved')"""


def _unsuppressed(ttl: int) -> str:
    return f"""SELECT event_id, path, kind, us FROM x_events e WHERE NOT EXISTS (SELECT 1 FROM x_events w
    WHERE w.kind = 'moved' AND w.path = e.path AND e.us BETWEEN w.us AND w.us + {ttl})"""


def _debounced(name: str, relation: str, window: int) -> None:
    """Registers `name`: events of a relation kept by the debounce, by walking each path in order."""
    _relation(
        f"{name}_ordered", f"SELECT *, row_number() OVER (PARTITION BY path ORDER BY us, event_id) AS nth FROM {relation}"
    )
    _relation(
        f"{name}_walk",
        f"""SELECT event_id, path, kind, us, nth, TRUE AS kept, us AS last FROM {name}_ordered WHERE nth = 1
        UNION ALL
        SELECT o.event_id, o.path, o.kind, o.us, o.nth, o.us - w.last >= {window},
            CASE WHEN o.us - w.last >= {window} THEN o.us ELSE w.last END
        FROM {name}_walk w JOIN {name}_ordered o ON o.path = w.path AND o.nth = w.nth + 1""",
    )
    _relation(name, f"SELECT event_id, path, kind, us FROM {name}_walk WHERE kept")


def _bursts(relation: str, breaks: str) -> str:
    """Bursts of a relation of events; `breaks` says when row (us, before) starts a new one."""
    return f"""
    SELECT max_by(event_id, (us, event_id)) AS event_id, path, max_by(kind, (us, event_id)) AS kind, max(us) AS us,
        min(us) AS first_us, count(*) AS n_events
    FROM (SELECT *, sum(CASE WHEN before IS NULL OR {breaks} THEN 1 ELSE 0 END)
            OVER (PARTITION BY path ORDER BY us, event_id) AS burst
        FROM (SELECT *, lag(us) OVER (PARTITION BY path ORDER BY us, event_id) AS before FROM {relation}) e)
    GROUP BY path, burst"""


def _flushed(relation: str, quiet: int, idle_us: int) -> str:
    """When row (us, before) starts a new burst by the two-timer rule; quiet in seconds."""
    quiet_us = quiet * 1_000_000
    return f"""NOT (us - before <= {quiet_us} OR (us - before <= {idle_us} AND NOT EXISTS (
                SELECT 1 FROM {relation} o WHERE o.us > e.before + {quiet_us} AND o.us < e.us)))"""


_debounced("x_debounced", "x_events", 6 * HOUR)
_relation("x_clean_input", _kinds(f"({_unsuppressed(HOUR)})"))
_debounced("x_clean", "x_clean_input", HOUR)
_relation("x_kinds", _kinds("x_events"))
_debounced("x_kept", "x_kinds", HOUR)

_PATCH = "patch_id, path, status, reason, before_mismatch"
_EVENT = "event_id, path, kind, us"


def _prefix_test() -> str:
    tests = [f"starts_with(path, '{p}')" for p in PREFIXES] + [f"ends_with(path, '{x}')" for x in SUFFIXES]
    return " OR ".join(tests)


def oracles() -> dict[str, str]:
    knn = f"SELECT path, similar_path, chunk_index, similarity, rank FROM ({_knn('x_vectors')})"
    knn_notes = f"SELECT path, similar_path, similarity, rank FROM ({_knn('x_vectors', 'note')})"
    merged = "SELECT path, md5({0}) AS merged_digest FROM (SELECT *, '- [[' || path || ']] - why' AS bullets FROM x_sections_{1})"
    plain = {
        "scan_notes": "SELECT path, modified_us, md5(content) AS content_hash, length(content) AS n_chars FROM x_disk",
        "scan_errors": f"SELECT path, '{UNREADABLE}' AS reason FROM x_disk WHERE {_UNREAD.format('')}",
        "filter_ignored": f"SELECT path FROM x_disk WHERE NOT ({_prefix_test()})",
        "fingerprint": "SELECT path, md5(content) AS content_hash FROM x_texts",
        "chunk_fixed": """SELECT path, chunk_index, chunk_start, chunk_end, content_hash, md5(raw_content) AS chunk_hash
            FROM x_disk_chunks""",
        "hash_embed": "SELECT path, chunk_index, bucket, round(weight, 6) AS weight FROM x_weights",
        "embedding_check": """SELECT count(*) AS total_rows, count(*) FILTER (label = 3) AS missing,
            count(*) FILTER (label = 4) AS wrong_length, count(*) FILTER (label NOT IN (3, 4)) AS valid FROM embeddings""",
        "note_metadata": "SELECT * REPLACE (coalesce(embedded_us, -1) AS embedded_us) FROM x_meta",
        "detect_changes": "SELECT path, reason FROM x_changes",
        "detect_changes_forced": f"SELECT path, reason FROM ({_changes(True)})",
        "upsert_notes": _upserted(True, False),
        "upsert_notes_keeping_stale": _upserted(False, False),
        "populate": _upserted(True, True),
        "populate_stored": _upserted(True, True),
        "prune_deleted": _rows("x_stored WHERE path IN (SELECT path FROM x_disk)"),
        "pruned_paths": "SELECT path, last_chunk FROM x_meta WHERE path NOT IN (SELECT path FROM x_disk)",
        "health_metrics": """SELECT count(*) AS total_rows, count(e) AS with_embedding, min(len(e))::INT AS min_dimension,
            max(len(e))::INT AS max_dimension FROM (
                SELECT CASE chunk_index WHEN 3 THEN NULL WHEN 4 THEN range(10) ELSE range(64) END AS e FROM x_stored)""",
        "sample_paths": "SELECT path, chunk_index FROM x_stored ORDER BY path, chunk_index LIMIT 5",
        "notes_needing_backlinks": """SELECT DISTINCT path FROM x_stored
            WHERE backlinked_us IS NULL OR modified_us > backlinked_us""",
        "mark_backlinked": f"""SELECT * REPLACE (CASE WHEN split_part(path, '/', 1) IN ('src6', 'src7') THEN {_NOW}
            ELSE backlinked_us END AS backlinked_us) FROM ({_rows('x_stored')})""",
        "similar_to_note": """SELECT similar_path, chunk_index, round(similarity, 6) AS similarity FROM (
            SELECT c.path AS similar_path, c.chunk_index, round(list_cosine_similarity(q.e, c.e), 12) AS similarity
            FROM x_vectors q JOIN x_vectors c ON c.path <> q.path WHERE q.path = 'n3.md' AND q.chunk_index = 0
            ORDER BY similarity DESC, similar_path, c.chunk_index LIMIT 5)""",
        "knn_exact": knn,
        "knn_small_queries": knn,
        "similar_notes_small_queries": knn_notes,
        "knn_blocked": knn,
        "knn_indexed": knn,
        "knn_stored": knn,
        "similar_notes_stored": knn_notes,
        "similar_notes_distinct": knn_notes,
        "similar_notes_indexed": knn_notes,
        "note_similarity": f"SELECT path, similar_path, similarity, rank FROM ({_knn('x_hashed', 'note')})",
        "link_exists": f"SELECT p.path, p.similar_path, {_LINKED} AS linked FROM x_near p JOIN x_texts t ON t.path = p.path",
        "candidate_pairs": """SELECT path, similar_path, similarity, rank, md5(note_abstract) AS note_digest,
            md5(similar_abstract) AS similar_digest FROM x_pairs""",
        "decide_links": f"""SELECT path, similar_path, should_link AND rank % 3 <> 0 AS should_link,
            CASE WHEN rank % 3 <> 0 THEN reason END AS reason,
            CASE WHEN should_link AND rank % 3 = 0 THEN '{NO_REASON}' END AS error, agent_name
            FROM ({_decided('x_pairs')})""",
        "section_links": "SELECT path, similar_path FROM x_targets_full",
        "section_links_reference": "SELECT path, similar_path FROM x_targets_reference",
        "new_section_links": """SELECT path, similar_path, reason FROM x_near_links l WHERE NOT EXISTS (
            SELECT 1 FROM x_targets_full h WHERE h.path = l.path AND h.similar_path = l.similar_path)""",
        "render_bullets": """SELECT path, string_agg('- [[' || similar_path || ']] - ' || reason, chr(10) ORDER BY rank)
            AS bullets, count(*) AS n_links FROM x_near_links GROUP BY path""",
        "merge_section": merged.format(_merged("full"), "full"),
        "merge_section_reference": merged.format(_merged("reference"), "reference"),
        "build_patches": _built("x_near_links", "full"),
        "build_patches_reference": _built("x_near_links", "reference"),
        "resolve_patches": f"SELECT {_PATCH}, md5(new_content) AS new_digest FROM x_resolved",
        "apply_patches": """SELECT path, md5(content) AS content_hash FROM x_texts
            WHERE path NOT IN (SELECT path FROM x_resolved WHERE status = 'ok')
            UNION ALL SELECT path, md5(new_content) FROM x_resolved WHERE status = 'ok' AND new_content IS NOT NULL""",
        "patch_log_summary": """SELECT CASE WHEN action IN (0, 1, 2, 10) THEN 'REPLACE' WHEN action = 3 THEN 'APPEND'
                WHEN action IN (4, 5) THEN 'CREATE' WHEN action IN (6, 8) THEN 'DELETE' ELSE 'RENAME' END AS action,
            status, reason, count(*) AS n, count(*) FILTER (before_mismatch) AS n_mismatch FROM x_resolved GROUP BY 1, 2, 3""",
        "suggest_links": _built("x_match_links", "full"),
        "link_notes": f"""SELECT path, chunk_index, CASE WHEN path IN (SELECT path FROM ({_built('x_match_links', 'full')}))
            THEN {_NOW} ELSE -1 END AS backlinked_us FROM x_text_chunks""",
        "event_kinds": _kinds("x_events"),
        "route_events": "SELECT event_id, path, 'backlinker' AS handler FROM x_events WHERE regexp_matches(path, '(?i)\\.md$')",
        "suppress_self_writes": _unsuppressed(HOUR),
        "coalesce_events": _bursts("x_events", f"us - before > {6 * HOUR}"),
        "coalesce_two_timer": _bursts("x_events", _flushed("x_events", 600, 3 * HOUR)),
    }
    walked = {
        "debounce_events": f"SELECT {_EVENT} FROM x_debounced",
        "debounce_stream": f"SELECT {_EVENT} FROM x_debounced",
        "clean_events": f"""SELECT event_id, path, kind, us, n_events, 'backlinker' AS handler
            FROM ({_bursts("x_clean", f"us - before > {3 * HOUR}")}) WHERE path LIKE '%.md'""",
        "clean_events_flush": f"""SELECT event_id, path, kind, us, n_events, 'backlinker' AS handler
            FROM ({_bursts("x_clean", _flushed("x_clean", HOUR // 1_000_000, 3 * HOUR))}) WHERE path LIKE '%.md'""",
    }
    plain["similar_to_stored"] = plain["similar_to_note"]
    # Streams are run until every row has left them and give what the batch queries give.
    twins = {"coalesce": "coalesce_events", "coalesce_two_timer": "coalesce_two_timer", "suppress": "suppress_self_writes"}
    plain |= {f"{k}_stream": plain[v] for k, v in twins.items()}
    plain |= {f"{k}_stream_ended": plain[f"{k}_stream"] for k in ("coalesce", "suppress")}
    walked |= {"clean_stream": walked["clean_events"], "clean_stream_ended": walked["clean_events"], "clean_stream_flush": walked["clean_events_flush"]}
    walked |= {k: plain.pop(k) for k in ("resolve_patches", "apply_patches", "patch_log_summary")}
    return {k: _with(v) for k, v in plain.items()} | {k: _with(v, recursive=True) for k, v in walked.items()}

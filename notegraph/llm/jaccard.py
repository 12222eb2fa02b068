"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, as components.

Shingles are hashed to 64 bits; equal hashes count as equal shingles. Documents with equal sets are one class, which
its smallest doc_id, a row of it and a number stand for. Hashing shingles into groups makes a point of each class: its count per group. The
sum of the smaller counts of two points bounds their overlap from above, and the larger counts of an R-tree node do
so for all points below it.

One tree over all points would cut off next to nothing: links may differ in a fifth of their shingles, which is more
than unrelated points differ in any few coordinates. So a tree is built for the classes that share a rare shingle.
Which shingles must be shared follows from the least overlap. Ordered by hash, two linked sets share at least
1 + n // 50 of the first n / 5 + n / 40 shingles (n: the size of either), so classes with fewer shingles that occur
elsewhere are dropped; the rest goes on with its rarest shingles. A shingle's leader is the smallest class that has it,
and classes are put together by the leaders of their shingles: classes that share a shingle share its leader, and
copies of one text share few leaders where they share hundreds of shingles. Hot leaders are met in three ways: each
class is first compared with its leaders (a linear number of pairs), leaders whose classes are all connected by then
are dropped, and what is left of large buckets is cut into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from notegraph.llm.common import BLANK_BYTES, LOWER_BYTES, hashes, mixed, numbered, shared_checkpoint, shingles, sliced, spans, utf8, written

SIZE, GROUPS = 5, 64
LEAF, FANOUT, BLOCK = 16, 8, 1024
STAR_ROUNDS = 1
#: Ids that are broadcast at most, with a hash of the text and a number; beyond it the join is a shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of such ids where they are texts.
BROADCAST_BYTES = 64 << 20


def distinct_shingles(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of each text in ascending order, one text after the other, and how many each has.

    Words are runs without ASCII white space, A-Z in lower case; with fewer words all of them are one shingle; null,
    empty and blank texts have none.
    """
    data, offsets = utf8(column)
    data = LOWER_BYTES[data]
    starts, lengths, rows = spans(data, offsets, BLANK_BYTES)
    found, rows = shingles(hashes(data, starts, lengths), rows, len(column), size)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])][: len(found)]
    return found[new], np.bincount(rows[new], minlength=len(column))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1 + n // 40, 0)


def shingle_sets(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, copy (a hash of the text), n, d1, d2 (a digest of the set), prefix (the smallest hashes, cut to 48 bits),
    point (counts per group)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found, n = distinct_shingles(batch.column("text"), size)
            ends = np.cumsum(n)
            begins = ends - n
            some = n > 0
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if some.any():
                d1[some] = np.add.reduceat(mixed(found ^ np.uint64(0x5851F42D4C957F2D)), begins[some])
                d2[some] = np.add.reduceat(mixed(found + np.uint64(0x14057B7EF767814F)), begins[some])
            kept = prefix_length(n)
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(found)) - begins[owner]
            prefix = (found[place < kept[owner]] >> np.uint64(16)).astype(np.int64)
            counts = np.bincount(owner * GROUPS + (found % np.uint64(GROUPS)).astype(np.int64), minlength=len(n) * GROUPS)
            points = [x.tobytes() for x in counts.reshape(-1, GROUPS).astype(np.uint32)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("copy"), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), pa.array(prefix)), pa.array(points, pa.binary()),
                ],
                ["doc_id", "copy", "n", "d1", "d2", "prefix", "point"],
            )

    return documents.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInArrow(
        measure, f"doc_id {id_type(documents)}, copy bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, point binary"
    )


def id_type(documents: DataFrame) -> str:
    return documents.schema["doc_id"].dataType.simpleString()


def full_sets(documents: DataFrame, picked: DataFrame, size: int = SIZE) -> DataFrame:
    """v, shingles (whole set) of the rows picked (v, doc_id, copy): a class and the row that stands for it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found, n = distinct_shingles(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("v"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(found.view(np.int64)))],
                ["v", "shingles"],
            )

    rows = with_keys(documents.select("doc_id", "text"), picked, "inner").select("v", "text")
    return rows.mapInArrow(measure, "v bigint, shingles array<bigint>")


def with_keys(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Join of rows with a text to a stored table of (doc_id, copy), which is counted before it is broadcast. Null ids are equal."""
    held = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("doc_id").cast("string"))), F.lit(0)).alias("bytes")).first()
    small = held["n"] <= BROADCAST_IDS and held["bytes"] <= BROADCAST_BYTES
    keys = keys.withColumnsRenamed({"doc_id": "key_id", "copy": "key_copy"})
    same = (F.xxhash64(rows["text"]) == keys["key_copy"]) & rows["doc_id"].eqNullSafe(keys["key_id"])
    return rows.join(F.broadcast(keys) if small else keys, same, how)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose similarity is 0.8 or more, by whole sets."""
    left = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("s")).where("100 * i >= 80 * (s - i)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """vertex, label (the smallest vertex of its component) of all vertices of the edges (a, b).

    Large-star and small-star in turn: every vertex is tied to the smallest one near it, until nothing changes. A
    vertex with very many edges is pre-aggregated for its minimum and split by adaptive execution in the join.
    """
    edges = shared_checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared_checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    labels = edges.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("label"))).groupBy("vertex").agg(F.min("label").alias("label"))


class Tree:
    """A packed R-tree over points: a node keeps the largest count of each group, and sizes, of what lies below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Neighbours in size, then in the groups where points differ most, come together.
        spread = np.argsort(-points.std(0))[:3]
        self.order = np.lexsort((*(points[:, k] for k in spread[::-1]), sizes * 8 // max(int(sizes.max()), 1)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        cuts = np.arange(0, len(points), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, cuts), np.minimum.reduceat(self.sizes, cuts), np.maximum.reduceat(self.sizes, cuts))]
        while len(self.levels[-1][0]) > FANOUT:
            high, low_size, high_size = self.levels[-1]
            cuts = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_size, cuts), np.maximum.reduceat(high_size, cuts)))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Numbers of the points that may have a similarity of 0.8 with a point."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in reversed(range(len(self.levels))):
            high, low_size, high_size = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(high, point).sum(1)
            # Overlap is at least 4/9 of both sizes, and the smaller size at least 4/5 of the larger.
            nodes = nodes[(9 * bound >= 4 * (size + low_size)) & (5 * size >= 4 * low_size) & (5 * high_size >= 4 * size)]
            width = FANOUT if depth else LEAF
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < below]
        bound, sizes = np.minimum(self.points[nodes], point).sum(1), self.sizes[nodes]
        fits = (9 * bound >= 4 * (size + sizes)) & (5 * size >= 4 * sizes) & (5 * sizes >= 4 * size)
        return self.order[nodes[fits]]


def bucket_pairs(ids: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a bucket that the bounds let through, of different labels. sides: 0 on its own, else 1 and 2 are two
    blocks and only pairs across count."""
    across = bool(sides.max() > 1)
    base = np.flatnonzero(sides == 2) if across else np.arange(len(ids))
    asking = np.flatnonzero(sides == 1) if across else base
    out_a, out_b = [], []
    if len(base) and len(asking):
        tree = Tree(points[base], sizes[base])
        for k in asking:
            other = base[tree.near(points[k], int(sizes[k]))]
            other = other[labels[other] != labels[k]]
            other = other if across else other[ids[other] > ids[k]]
            out_a.append(np.minimum(ids[k], ids[other]))
            out_b.append(np.maximum(ids[k], ids[other]))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def tree_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of all buckets. rows: bucket, rep, n, label, point, m (rows of the bucket).

    Buckets over BLOCK rows are cut into blocks, and each pair of blocks is a bucket of its own.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = rows.select("*", blocks.alias("blocks"), own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("*", other.alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "n", "label", side.cast("int").alias("side"), "point"
    )
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else np.zeros(0, int)
            # The last bucket may go on in the next batch.
            last = int(cuts[-1]) if len(cuts) else 0
            yield from found(table.slice(0, last), np.r_[0, cuts])
            rest = table.slice(last).combine_chunks().to_batches()[0] if len(keys) else None
        if rest is not None:
            yield from found(pa.Table.from_batches([rest]), np.array([0, rest.num_rows]))

    def found(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        ids, sizes, labels, sides = (table.column(c).to_numpy() for c in ("rep", "n", "label", "side"))
        points = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint32).reshape(-1, GROUPS).astype(np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2 or (labels[a:b] == labels[a]).all():
                continue
            x, y = bucket_pairs(ids[a:b], sizes[a:b], labels[a:b], sides[a:b], points[a:b])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return rows.mapInArrow(join, "a bigint, b bigint").distinct()


def jaccard_components(documents: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), copy, first of every row.

    copy is a hash of the text; first tells whether (doc_id, copy) is the smallest of its component, ids before null.
    Rows without shingles (null, empty or blank texts) are linked with nothing and are first. Rows that repeat a doc_id
    with another text are documents of their own. A row without a doc_id has the smallest id of its component, or
    null where there is none. Ids may have any type that has an order. Extra columns take no part. An empty table gives no rows.
    """
    measured = written(shingle_sets(documents, size))
    # The row that stands for a class: the smallest id that there is, and of that the smallest hash of a text.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    classes = measured.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(key).alias("key"))
    # Short numbers in the order of these rows: leaders are the smallest ids, which tend to be what others were copied from.
    classes = written(numbered(classes, F.asc("key")).withColumnRenamed("at", "v"))
    # One row per class: its representative's.
    # The id goes into the join by its hash, so that null ids meet and rows need no further shuffle to be made unique.
    keys = classes.select("d1", "d2", "key.copy", F.xxhash64("key.doc_id").alias("id_hash"), F.col("key.doc_id").alias("key_id"), "v")
    on = ["d1", "d2", "copy", "id_hash"]
    one = measured.withColumn("id_hash", F.xxhash64("doc_id")).join(keys, on).where(F.col("doc_id").eqNullSafe(F.col("key_id"))).dropDuplicates(on)
    tokens = one.select("v", "n", F.explode("prefix").alias("tok"))
    shared = tokens.groupBy("tok").agg(F.count("*").alias("df"), F.min("v").alias("leader")).where("df > 1")
    held = tokens.join(shared, "tok").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok", "leader"))).alias("toks"))
    held = written(held.where(F.size("toks") >= 1 + F.floor(F.col("n") / 50)))
    picked = classes.select("v", "key.doc_id", "key.copy").join(held.select("v").distinct(), "v", "left_semi")
    sets = written(full_sets(documents, written(picked), size))
    if sets.select("v").distinct().count() < sets.count():  # rows that are repeated as they are
        sets = written(sets.groupBy("v").agg(F.min("shingles").alias("shingles")))

    # Each class and the leader with whom it shares most shingles.
    stars = held.select("v", F.explode("toks.leader").alias("leader")).where("v <> leader").groupBy("v", "leader").agg(F.count("*").alias("c"))
    best = Window.partitionBy("v").orderBy(F.desc("c"), "leader")
    pairs = stars.withColumn("r", F.row_number().over(best)).where("r <= 2").select(F.col("leader").alias("a"), F.col("v").alias("b"))
    edges = written(linked(pairs, sets))
    tried = written(pairs)
    kept = F.slice("toks", F.lit(1), (F.size("toks") - F.floor(F.col("n") / 50)).cast("int"))
    rare = written(held.select("v", "n", F.explode(F.array_distinct(kept["leader"])).alias("bucket")))
    for turn in range(STAR_ROUNDS + 1):
        labels = components(edges).withColumnRenamed("vertex", "v")
        rows = rare.join(labels, "v", "left").select("bucket", "v", "n", F.coalesce("label", "v").alias("label"))
        mixed_buckets = rows.groupBy("bucket").agg(
            F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("label", "v")).alias("lead")
        )
        rows = rows.join(mixed_buckets.where("low < high"), "bucket")
        if turn < STAR_ROUNDS:
            # Classes that are not yet connected with the leading class of a bucket.
            candidates = rows.where("label <> lead.label").groupBy("v", F.col("lead.v").alias("leader")).agg(F.count("*").alias("c"))
            candidates = candidates.withColumn("r", F.row_number().over(best)).where("r <= 2")
            candidates = candidates.select(F.least("v", "leader").alias("a"), F.greatest("v", "leader").alias("b")).distinct()
        else:
            points = one.select("v", "n", "point")
            candidates = tree_pairs(rows.select("bucket", F.col("v").alias("rep"), "n", "label", "m").join(points.withColumnRenamed("v", "rep"), ["rep", "n"]))
        candidates = written(candidates.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(candidates)
        edges = written(edges.unionByName(linked(candidates, sets)))
    labels = components(edges).withColumnRenamed("vertex", "v")
    named = classes.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    # Most components are one class, which needs no look at others.
    several = named.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("key").alias("least"))
    named = named.join(several, "label", "left").select("d1", "d2", "n", F.coalesce("least", "key").alias("least"))
    rows = measured.select("doc_id", "copy", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    stands = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("copy") == F.col("least.copy"))
    first = F.col("least").isNull() | stands
    component = F.coalesce("least.doc_id", "doc_id").alias("component_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component, "copy", first.alias("first"))


def one_of_each(documents: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component; found: rows of `jaccard_components`.

    The one with the smallest (doc_id, hash of its text) stays, an id before none. Of rows that repeat both, that with the
    smallest other columns stays. Rows without shingles are in no component and all stay, repeated ones too. Columns are kept as they are.
    """
    found = written(found.select("doc_id", "copy", "first", (F.col("n_shingles") > 0).alias("some")))
    repeated = written(found.where("first AND some").groupBy("doc_id", "copy").count().where("count > 1").select("doc_id", "copy"))
    out = written(found.where("NOT first").select("doc_id", "copy").distinct().unionByName(repeated))
    rest = with_keys(documents, out, "left_anti")
    if repeated.isEmpty():
        return rest
    again = with_keys(documents, repeated, "left_semi")
    row = F.min(F.struct(*documents.columns)).alias("row")
    again = again.groupBy("doc_id", F.xxhash64("text").alias("copy")).agg(row).select("row.*")
    return rest.unionByName(again)

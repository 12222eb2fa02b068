"""Merkle manifest of a document table as a log of nodes in the order in which they are completed (postorder).

Every source has a tree whose leaves are its documents by ascending id; three consecutive nodes, or what is left of a
level, become the hash of their digests until one node remains, the subroot. The subroots, by source, grow the tree
above in the same way. H is the lowercase hex SHA-256 of its inputs, digests as hex text.

Trees are built in aligned blocks of 3 ** LEVELS neighbouring nodes, each by one task that appends a node to its
segment of the log as soon as the node is complete. The blocks' tops are the base of the next tier of blocks. Nothing but
the counts decides where a node lies: in postorder the nodes before it are those that end before its first leaf, which
are s // 3 ** k on level k when that leaf has number s, and those of its own subtree (`position`). So a proof is read
from the segments by computed positions, and a segment holds all siblings that a document needs up to its block's top.

A source with a third of all documents is many blocks, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from notegraph.llm.common import grouped, numbered, written
from notegraph.operators.sized import BROADCAST_ROWS

ARITY = 3
LEVELS = 8  # levels of a block: 6,561 nodes at its base, some 315 kB of log
DIGEST = 32
#: Bytes of source names that are broadcast at most.
BROADCAST_BYTES = 16 << 20

_SEGMENT = "tree bigint, block bigint, count bigint, size int, height int, nodes binary, top binary"
_PATH = "tree bigint, idx bigint, lefts array<string>, rights array<string>"


def hashed(*texts: bytes) -> bytes:
    """H: the hex digest of the inputs one after the other."""
    return hashlib.sha256(b"".join(texts)).hexdigest().encode()


def field(value: Column) -> Column:
    """A value as `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column | str = "text") -> Column:
    """The leaf of a document as 32 bytes; `text` may be another column in place of its text."""
    text = F.col(text) if isinstance(text, str) else text
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def without_newlines() -> Column:
    """The tampering to be found: the text without newlines where 2 divides the crc32 of the id, else the text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def position(level: int, index: np.ndarray | int, size: int, height: int) -> np.ndarray:
    """Places in the log, from 0, of nodes `index` of a level, in a tree of `size` base nodes and `height` levels above."""
    start = np.asarray(index, np.int64) * ARITY**level
    below = np.minimum(ARITY**level, size - start)
    before = sum(start // ARITY**k for k in range(height + 1))
    own = sum(-(-below // ARITY**k) for k in range(level + 1))
    return before + own - 1


def levels_above(size: int) -> int:
    """Levels above the base of a tree that ends in one node."""
    height = 0
    while size > 1:
        size, height = -(-size // ARITY), height + 1
    return height


def grow(base: list[bytes], height: int) -> list[bytes]:
    """All nodes in the order of their completion, digests as hex text. The last one is the top."""
    log: list[bytes] = []
    open_runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def put(level: int, digest: bytes) -> None:
        log.append(digest)
        open_runs[level].append(digest)
        if level < height and len(open_runs[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        put(level + 1, hashed(*run))

    for digest in base:
        put(0, digest)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


def siblings(nodes: bytes, size: int, height: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each level below the top and each of its nodes: the digests left and right of it in its run."""
    text = nodes.hex()
    width = 2 * DIGEST
    lefts, rights = [], []
    for level in range(height):
        count = -(-size // ARITY**level)
        places = position(level, np.arange(count), size, height) * width
        digests = [text[p : p + width] for p in places.tolist()]
        runs = [digests[j - j % ARITY : j - j % ARITY + ARITY] for j in range(count)]
        lefts.append(["".join(run[: j % ARITY]) for j, run in enumerate(runs)])
        rights.append(["".join(run[j % ARITY + 1 :]) for j, run in enumerate(runs)])
    return lefts, rights


def segments(nodes: DataFrame, levels: int) -> DataFrame:
    """One tier of blocks. nodes: tree, idx (from 0), count (nodes of the tree on this tier), digest."""
    width = ARITY**levels
    rows = nodes.withColumn("block", F.floor(F.col("idx") / width).cast("bigint"))
    rows = rows.select("tree", "block", "idx", "count", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tree", "block"):
            count = table.column("count")[0].as_py()
            base = [d.hex().encode() for d in table.column("digest").to_pylist()]
            height = levels if count > width else levels_above(count)
            log = [bytes.fromhex(d.decode()) for d in grow(base, height)]
            row = {
                "tree": table.column("tree")[0].as_py(), "block": table.column("block")[0].as_py(), "count": count,
                "size": len(base), "height": height, "nodes": b"".join(log), "top": log[-1],
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[k]], t) for k, t in (("tree", pa.int64()), ("block", pa.int64()), ("count", pa.int64()), ("size", pa.int32()), ("height", pa.int32()), ("nodes", pa.binary()), ("top", pa.binary()))],
                list(row),
            )

    return rows.mapInArrow(build, _SEGMENT)


def build(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The log of all trees: written segments, tier by tier. Each tier has 3 ** levels times fewer nodes."""
    tiers = []
    while True:
        tiers.append(written(segments(nodes, levels)))
        cut = tiers[-1].where(F.col("count") > ARITY**levels)
        if cut.isEmpty():
            return tiers
        nodes = cut.select("tree", F.col("block").alias("idx"), F.ceil(F.col("count") / ARITY**levels).alias("count"), F.col("top").alias("digest"))


def tops(tiers: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """tree, top: the one node that remains of each tree."""
    ends = [t.where(F.col("count") <= ARITY**levels).select("tree", "top") for t in tiers]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def opened(held: DataFrame) -> DataFrame:
    """The paths of all base nodes of segments that know the path above their top."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lefts, rights = siblings(row["nodes"], row["size"], row["height"])
                first = row["block"] * row["span"]
                out = []
                for k in range(row["size"]):
                    own = [(left[k // ARITY**level], right[k // ARITY**level]) for level, (left, right) in enumerate(zip(lefts, rights))]
                    out.append((row["tree"], first + k, [x for x, _ in own] + row["lefts"], [y for _, y in own] + row["rights"]))
                for at in range(0, len(out), 1024):
                    columns = list(zip(*out[at : at + 1024]))
                    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["tree", "idx", "lefts", "rights"])

    return held.mapInArrow(read, _PATH)


def base_tier(tiers: list[DataFrame], crown: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The segments of the first tier with the path above each top. crown: tree, lefts, rights above the trees."""
    span = ARITY**levels
    above = None
    for tier, held in reversed(list(enumerate(tiers))):
        held = held.withColumn("span", F.lit(span).cast("bigint"))
        ended = held.where(F.col("count") <= span).join(crown, "tree")
        if above is not None:
            ended = ended.unionByName(held.where(F.col("count") > span).join(above, ["tree", "block"]))
        if tier:
            above = written(opened(ended).withColumnRenamed("idx", "block"))
    return ended


@dataclass
class Manifest:
    """Leaves (tree, idx, count, doc_id, digest, tampered), their log, sources (tree, source, subroot, lefts, rights), root."""

    leaves: DataFrame
    log: list[DataFrame]
    sources: DataFrame
    root: str | None
    levels: int


def manifest(documents: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> Manifest:
    """Trees of all sources and of their subroots.

    Nulls in doc_id, source, lang, n_chars and text are `-`, empty texts `0:`; a null source is a source of its own and
    comes first. Ids that are null come first in their source; rows that repeat an id lie side by side, by their digest. Every row
    is a leaf, also repeated ones. Extra columns take no part. An empty table has no leaves and no root (None).
    """
    changed = leaf_digest(without_newlines() if tampered is None else tampered)
    rows = documents.select("source", "doc_id", leaf_digest().alias("digest"), changed.alias("tampered"))
    order = (F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("digest"))
    rows = numbered(rows, *order)
    sources = rows.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("count"))
    sources = written(numbered(sources, F.asc_nulls_first("source")).withColumnRenamed("at", "tree"))
    held = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    named = sources.select(F.col("source").alias("named"), "tree", "first", "count")
    named = F.broadcast(named) if held["n"] <= BROADCAST_ROWS and held["bytes"] <= BROADCAST_BYTES else named
    leaves = rows.join(named, rows["source"].eqNullSafe(F.col("named")))
    leaves = written(leaves.select("tree", (F.col("at") - F.col("first")).alias("idx"), "count", "doc_id", "digest", "tampered"))
    log = build(leaves.select("tree", "idx", "count", "digest"), levels)

    subroots = tops(log, levels).withColumnRenamed("top", "subroot").join(sources.select("tree", "source"), "tree")
    subroots = written(subroots)
    crown_log = build(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(held["n"]).cast("bigint").alias("count"), F.col("subroot").alias("digest")), levels)
    top = tops(crown_log, levels).first()
    none = F.array().cast("array<string>")
    crown = documents.sparkSession.range(1).select(F.col("id").alias("tree"), none.alias("lefts"), none.alias("rights"))
    paths = opened(base_tier(crown_log, crown, levels)).select(F.col("idx").alias("tree"), "lefts", "rights")
    sources = written(subroots.join(paths, "tree"))
    return Manifest(leaves, log, sources, bytes(top["top"]).hex() if top else None, levels)


def proofs(found: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the siblings one after the other), folded_root (from the tampered leaf and the siblings).

    The rows of a block and its segment come together in one task, which reads all siblings at their positions.
    """
    span = ARITY**found.levels
    crown = found.sources.select("tree", "lefts", "rights")
    held = base_tier(found.log, crown, found.levels).join(found.sources.select("tree", "subroot"), "tree")
    row = F.struct("size", "height", "nodes", "lefts", "rights", "subroot")
    held = held.select("tree", "block", F.lit(-1).cast("bigint").alias("idx"), row.alias("segment"))
    block = F.floor(F.col("idx") / span).cast("bigint")
    leaves = found.leaves.select("tree", block.alias("block"), "idx", "doc_id", "digest", "tampered")
    rows = leaves.unionByName(held, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    doc_id = found.leaves.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "tree", "block"):
            segment = table.column("segment")[0].as_py()
            docs = table.slice(1)
            first = table.column("block")[0].as_py() * span
            lefts, rights = siblings(segment["nodes"], segment["size"], segment["height"])
            above = list(zip(segment["lefts"], segment["rights"]))
            proof_above = "".join(left + right for left, right in above)
            above = [(left.encode(), right.encode()) for left, right in above]
            leaf, proof, folded = [], [], []
            for idx, own, digest in zip(*(docs.column(c).to_pylist() for c in ("idx", "digest", "tampered"))):
                path = [(x[(idx - first) // ARITY**level], y[(idx - first) // ARITY**level]) for level, (x, y) in enumerate(zip(lefts, rights))]
                node = digest.hex().encode()
                for left, right in path:
                    node = hashed(left.encode(), node, right.encode())
                for left, right in above:
                    node = hashed(left, node, right)
                leaf.append(own.hex())
                proof.append("".join(left + right for left, right in path) + proof_above)
                folded.append(node.decode())
            subroot = [segment["subroot"].hex()] * len(docs)
            names = ["doc_id", "leaf", "subroot", "proof", "folded_root"]
            columns = [docs.column("doc_id").combine_chunks(), *(pa.array(c, pa.string()) for c in (leaf, subroot, proof, folded))]
            for batch in pa.Table.from_arrays(columns, names).to_batches(max_chunksize=1024):
                yield batch

    out = rows.mapInArrow(read, f"doc_id {doc_id}, leaf string, subroot string, proof string, folded_root string")
    root = F.lit(found.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))

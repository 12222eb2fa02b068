"""LM scoring: online logistic mixing of bit predictors, and a unigram base score.

A text is read as bytes and an end, each coded by a few bits (a Huffman code of the training bytes). For every bit,
three predictors look up what followed a hash of their context (the last two bytes, the last four, the word so far)
and the bits before. This comes from counts of symbols by hashed context in all training rows, summed by Spark; the
tables have more rows the more bytes there are to learn from.
While a text is scored, the predictions are mixed in the logistic domain with weights that are chosen by how often each
context was met in training (the gate), and with shifts of them that learn from every block of the
text; a last stage corrects the mixed prediction by what came true at similar predictions in the same text. The gated
weights are fitted on all training rows, each against counts of those of the other half; tasks count which inputs meet,
and Spark sums the tasks. Texts do not influence each other, so results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from notegraph.llm.common import BLANK_BYTES, LOWER_BYTES, hashes, held_out, ragged, sliced, spans, utf8, written, _BYTE, _LOW

END = 256
#: Tables have a row per hashed context and a column per symbol (in training) or inner node of the code (in scoring).
CONTEXTS, SLOT_BITS, WIDTH = 3, 15, 257
SLOTS = 1 << SLOT_BITS
#: Rows grow with the root of the training bytes, times this, from SLOTS on: contexts that are new get rarer.
ROWS_PER_ROOT = 4
#: Nodes of a row that lie together when tables are read; a divisor of WIDTH - 1.
HEAD = 32
#: Log odds are held as small integers, in steps of 1 / SCALE.
SCALE = 15.0
START_WEIGHT, LEARN, REFINE, BUCKETS = 0.4, 0.02, 0.01, 24
#: A row's last column holds its level: how many of these its count reaches. A gate is the levels of all contexts.
LEVELS = (1, 3, 20)
GATES = (len(LEVELS) + 1) ** CONTEXTS
#: The gated weights are fitted on log odds of these sizes, the nearest ones of those that occur.
_SIZES = (2, 5, 9, 14, 21, 30, 43, 61, 86, 120)
STEPS = np.array([*(-s for s in reversed(_SIZES)), 0, *_SIZES])
#: Ways in which steps of all contexts can meet. In a cell turned round, all signs are changed.
MEETINGS = len(STEPS) ** CONTEXTS
#: Cells that a task sums before it hands them on.
HELD_CELLS = 4_000_000
#: Texts that are scored side by side, and the lengths of their first blocks; later ones are as long as the last.
LANES, BLOCKS = 256, (48, 48, 96, 192, 384, 768)
#: Places whose bits are worked off together: what the tables hold of them stays in the caches.
PLACES = 1 << 15
#: Bytes of texts whose contexts are found together.
PIECE = 1 << 15
#: Tokens whose counts are broadcast, most frequent first, and their most bytes; the others are joined.
FREQUENT, FREQUENT_BYTES = 1 << 18, 64

_NEAREST = np.abs(np.arange(256)[:, None] - STEPS[len(_SIZES) :]).argmin(1)
#: The step of each log odds, read as an unsigned byte.
_STEP = np.r_[len(_SIZES) + _NEAREST[:128], len(_SIZES) - _NEAREST[128:0:-1]].astype(np.int32)
_SIGN = np.r_[_BYTE >> np.uint64(32), 1].astype(np.uint32)
_PLACE = (_LOW >> np.uint64(32)).astype(np.uint32)
#: White space, and the end.
_BLANK = np.r_[BLANK_BYTES, True]


@dataclass
class Code:
    """A Huffman code of 257 symbols: length of each, and by depth and symbol the node reached and the next bit."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """Rare symbols count as one in 65536, which keeps the code short."""
    heap = [(float(c) + counts.sum() / 65536 + 1, k, (k,)) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[int]] = [[] for _ in counts]
    serial = len(heap)
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in ((0, left), (1, right)):
            for k in side:
                paths[k].append(bit)
        heapq.heappush(heap, (a + b, serial, left + right))
        serial += 1
    depth = max(map(len, paths))
    node, bits = np.zeros((depth, len(paths)), np.intp), np.zeros((depth, len(paths)), np.float32)
    # Nodes that most symbols pass come first, so that lookups of a row stay close together.
    passed: dict[tuple[int, ...], float] = {}
    for k, path in enumerate(paths):
        path.reverse()
        for d in range(len(path)):
            passed[tuple(path[:d])] = passed.get(tuple(path[:d]), 0.0) + float(counts[k])
    numbers = {p: i for i, p in enumerate(sorted(passed, key=lambda p: (-passed[p], len(p), p)))}
    for k, path in enumerate(paths):
        for d, bit in enumerate(path):
            node[d, k] = numbers[tuple(path[:d])]
            bits[d, k] = bit
    return Code(np.array([len(p) for p in paths], np.int8), node, bits)


def table_rows(n_bytes: int) -> int:
    """Rows of a table for so many training bytes, a power of two."""
    return max(SLOTS, 1 << math.ceil(math.log2(max(1.0, ROWS_PER_ROOT * math.sqrt(n_bytes)))))


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with an end behind each text, and where the texts start (and the last ends)."""
    starts = offsets + np.arange(len(offsets))
    out, inside = np.full(int(starts[-1]), END, np.uint16), np.ones(int(starts[-1]), bool)
    inside[starts[1:] - 1] = False
    out[inside] = data
    return out, starts


def pieces(data: np.ndarray, offsets: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """symbols and context_numbers of these texts, some texts at a time: their arrays stay in the caches."""
    starts = offsets + np.arange(len(offsets))
    text, rows = np.empty(int(starts[-1]), np.uint16), [np.empty(int(starts[-1]), np.uint32) for _ in range(CONTEXTS)]
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(text) + PIECE, PIECE)).clip(max=len(starts) - 1))
    for a, b in zip(cuts[:-1], cuts[1:]):
        here = slice(starts[a], starts[b])
        text[here], begin = symbols(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k, found in enumerate(context_numbers(text[here], begin, slots)):
            rows[k][here] = found
    return text, starts, rows


def context_rows(text: np.ndarray, starts: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    """For each place where the rows of three contexts start, in tables of that many rows (a power of two)."""
    return [rows.astype(np.int64) * WIDTH for rows in context_numbers(text, starts, slots)]


def context_numbers(text: np.ndarray, starts: np.ndarray, slots: int) -> list[np.ndarray]:
    """For each place the numbers of the rows of three contexts: of the two bytes before, the four before, the word so far."""
    n, size, first = len(text), np.diff(starts), starts[:-1]
    value = text.astype(np.uint32)
    value += np.uint32(1)
    two, rest = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    np.multiply(value[:-1], np.uint32(0x85EBCA6B), out=two[1:])
    two[2:] += value[:-2] * np.uint32(0xC2B2AE35)
    np.multiply(value[:-3], np.uint32(0x27D4EB2F), out=rest[3:])
    rest[4:] += value[:-4] * np.uint32(0x165667B1)
    # Nothing is seen of the text before.
    second, third, fourth = (first[size > k] + k for k in (1, 2, 3))
    two[first] = rest[first] = rest[second] = rest[third] = 0
    two[second] = value[second - 1] * np.uint32(0x85EBCA6B)
    rest[fourth] = value[fourth - 3] * np.uint32(0x27D4EB2F)
    four = np.bitwise_xor(two, rest, out=rest)
    # A word starts behind a blank and with the text; a running sum gives the hash of each beginning of a word.
    wide = text.astype(np.intp)
    begin = np.ones(n, bool)
    np.take(_BLANK, wide[:-1], out=begin[1:], mode="clip")
    begin[first] = True
    place = np.arange(n)
    begun = np.maximum.accumulate(place * begin)
    place -= begun
    place &= 0xFFFF
    summed = np.take(_SIGN, wide, mode="clip")
    summed *= np.take(_PLACE, place, mode="clip")
    word = np.zeros(n, np.uint32)
    np.cumsum(summed[:-1], dtype=np.uint32, out=word[1:])
    word -= np.take(word, begun)
    return [_slot(two, slots), _slot(four ^ np.uint32(0x5BD1E995), slots), _slot(word + np.uint32(77), slots)]


def _slot(x: np.ndarray, slots: int) -> np.ndarray:
    x = x ^ (x >> np.uint32(15))
    x *= np.uint32(0x2C1B3C6D)
    x >>= np.uint32(33 - slots.bit_length())
    return x


def count_symbols(data: np.ndarray, offsets: np.ndarray, totals: np.ndarray) -> None:
    """Adds the texts to totals[context, row and symbol]."""
    text, starts = symbols(data, offsets)
    for k, rows in enumerate(context_rows(text, starts, totals.shape[1] // WIDTH)):
        np.add.at(totals[k], rows + text, np.int32(1))


def log_odds(totals: np.ndarray, code: Code) -> np.ndarray:
    """For each context, row and node the log odds of a one, in steps of 1 / SCALE; 0 where nothing was met. The last
    column, which no node has, holds the level of the row."""
    flat = totals.reshape(-1)
    some = np.flatnonzero(flat)
    return sparse_log_odds(some, flat[some], totals.shape[1] // WIDTH, code)


def sparse_log_odds(cells: np.ndarray, counts: np.ndarray, slots: int, code: Code) -> np.ndarray:
    """log_odds from the cells of totals that are not 0, in order, and what they hold."""
    sides = [np.zeros((WIDTH, WIDTH), np.float32) for _ in range(2)]
    for d in range(len(code.node)):
        for k in np.flatnonzero(code.length > d):
            sides[int(code.bit[d, k])][k, code.node[d, k]] = 1
    out = np.zeros((CONTEXTS * slots, WIDTH), np.int8)
    row = cells // WIDTH
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.intp)
    del row
    size = np.diff(np.r_[first, len(cells)])
    for at in range(0, len(first), 8192):
        n = size[at : at + 8192]
        of = slice(first[at], first[at] + n.sum())
        part = np.zeros((len(n), WIDTH), np.float32)
        part[np.repeat(np.arange(len(n)), n), cells[of] % WIDTH] = counts[of]
        odds = np.clip(np.rint(np.log((part @ sides[1] + 0.4) / (part @ sides[0] + 0.4)) * SCALE), -127, 127)
        odds[:, -1] = np.digitize(part.sum(1), LEVELS)
        out[cells[first[at : at + 8192]] // WIDTH] = odds
    return out.reshape(CONTEXTS, -1)


def gates_of(tables: np.ndarray, contexts: list[np.ndarray]) -> np.ndarray:
    """The gate of each place: the levels of its rows as digits."""
    return _gates([table[WIDTH - 1 :: WIDTH].astype(np.uint8) for table in tables], [c // WIDTH for c in contexts])


def _gates(levels: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    gate = np.zeros(len(rows[0]), np.uint8)
    for k in range(CONTEXTS):
        gate *= np.uint8(len(LEVELS) + 1)
        gate += np.take(levels[k], rows[k])
    return gate


@dataclass
class Laid:
    """Tables in the order in which they are read: the first HEAD nodes of all rows of a context, which most bits ask for,
    then the next HEAD of all rows, and so on; and the levels of the rows by themselves."""

    slots: int
    nodes: list[np.ndarray]
    levels: list[np.ndarray]

    def node(self, node: np.ndarray) -> np.ndarray:
        """Where nodes lie, to be added to HEAD times the number of the row."""
        return node // HEAD * (self.slots * HEAD) + node % HEAD


def laid_out(tables: np.ndarray) -> Laid:
    slots = tables.shape[1] // WIDTH
    out = Laid(slots, [], [])
    for table in tables.reshape(CONTEXTS, slots, WIDTH):
        out.nodes.append(table[:, :-1].reshape(slots, -1, HEAD).transpose(1, 0, 2).reshape(-1))
        out.levels.append(table[:, -1].astype(np.uint8))
    return out


def equal_weights() -> np.ndarray:
    return np.full((CONTEXTS, GATES), START_WEIGHT / SCALE, np.float32)


def by_depth(left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of places with so many bits in which, at any depth, those that have a bit there come first; and by depth
    how many these are, and where their bits lie when those of a depth lie together."""
    reach = len(left) - np.cumsum(np.bincount(left))[:-1]
    ends = np.cumsum(reach)
    return np.argsort(-left, kind="stable"), [(int(m), slice(int(e - m), int(e))) for m, e in zip(reach, ends)]


def asked(node: np.ndarray, depths: list[tuple[int, slice]], deep: int = 0) -> tuple[np.ndarray, ...]:
    """Where bits ask when the first HEAD nodes of all places lie one after the other (`node` is turned into that); and the
    bits that ask for other nodes (at depths from `deep` on), their places and their nodes."""
    first = depths[deep][1].start if deep < len(depths) else len(node)
    other = np.flatnonzero(node[first:] >= HEAD) + first
    beyond = np.take(node, other)
    begin = np.arange(depths[0][0] if depths else 0) * HEAD
    for m, bits in depths:
        node[bits] += begin[:m]
    return node, other, (np.take(node, other) - beyond) // HEAD, beyond


def deep_from(nodes: np.ndarray) -> int:
    """The first depth at which a symbol asks for a node beyond HEAD."""
    beyond = (nodes >= HEAD).any(1)
    return int(beyond.argmax()) if beyond.any() else len(nodes)


def look_up(nodes: np.ndarray, rows: np.ndarray, node: np.ndarray, depths: list[tuple[int, slice]]) -> np.ndarray:
    """What a context's rows (by number) hold of all bits."""
    return _look_up(nodes, rows, *asked(node.copy(), depths))


def _look_up(nodes: np.ndarray, rows: np.ndarray, cell: np.ndarray, other: np.ndarray, place: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    # A row is fetched once for all bits of its place; what is fetched is read in order.
    out = np.take(np.take(nodes.reshape(-1, HEAD), rows, axis=0).reshape(-1), cell, mode="clip")
    out[other] = np.take(nodes, np.take(rows, place).astype(np.intp) * HEAD + beyond)
    return out


def path_bits(code: Code, nodes: np.ndarray, here: np.ndarray, depths: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
    """What `nodes` has for the nodes of all bits of these symbols, and the bits."""
    total = depths[-1][1].stop
    node, bit, here = np.empty(total, np.intp), np.empty(total, np.float32), here.astype(np.intp)
    for d, (m, bits) in enumerate(depths):
        np.take(nodes[d], here[:m], out=node[bits], mode="clip")
        np.take(code.bit[d], here[:m], out=bit[bits], mode="clip")
    return node, bit


def count_inputs(data: np.ndarray, offsets: np.ndarray, code: Code, tables: np.ndarray | Laid, totals: np.ndarray) -> None:
    """Adds to totals[gate and steps of all contexts] the bits of these texts, turned round so that each is a one.

    The tables must not have been counted on the same texts.
    """
    tables = laid_out(tables) if isinstance(tables, np.ndarray) else tables
    text, starts, rows = pieces(data, offsets, tables.slots)
    times = np.ones(len(text), np.int64)
    size = tables.slots.bit_length() - 1
    if CONTEXTS * size + 9 < 64:  # equal places are looked up once
        places = text.astype(np.int64)
        for k in range(CONTEXTS):
            places |= rows[k].astype(np.int64) << (9 + k * size)
        places.sort()
        first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else np.zeros(0, np.intp)
        times, places = np.diff(np.r_[first, len(places)]), places[first]
        text = places & 511
        rows = [places >> (9 + k * size) & (tables.slots - 1) for k in range(CONTEXTS)]
    nodes = tables.node(code.node)
    deep = deep_from(nodes)
    for at in range(0, len(text), PLACES):
        here = text[at : at + PLACES]
        longest, depths = by_depth(np.take(code.length, here))
        of = [np.take(r[at : at + PLACES], longest) for r in rows]
        node, bit = path_bits(code, nodes, np.take(here, longest), depths)
        cells = asked(node, depths, deep)
        steps = np.zeros(len(node), np.int64)
        for k in range(CONTEXTS):
            steps *= len(STEPS)
            steps += np.take(_STEP, _look_up(tables.nodes[k], of[k], *cells).view(np.uint8))
        steps = np.where(bit > 0, steps, MEETINGS - 1 - steps)
        gate, seen = _gates(tables.levels, of) * np.int64(MEETINGS), np.take(times[at : at + PLACES], longest)
        for m, bits in depths:
            steps[bits] += gate[:m]
        np.add.at(totals, steps, np.concatenate([seen[:m] for m, _ in depths]))


def fit_weights(cells: np.ndarray, counts: np.ndarray, rounds: int = 7) -> np.ndarray:
    """The weights by context and gate that code the counted bits best, by Newton's method, drawn towards those of all gates.

    `cells` are those of count_inputs that are not 0. Without any the weights are equal.
    """
    gates = cells // MEETINGS
    inputs = [STEPS[cells // len(STEPS) ** (CONTEXTS - 1 - k) % len(STEPS)] / SCALE for k in range(CONTEXTS)]

    def newton(weights: np.ndarray, gates: np.ndarray, prior: float) -> np.ndarray:
        """weights[context, gate] in units of log odds."""
        goal, n = weights.copy(), weights.shape[1]
        for _ in range(rounds):
            slope = prior * (weights - goal)
            bend = np.tile(np.eye(CONTEXTS) * prior, (n, 1, 1))
            odds = sum(weights[k][gates] * inputs[k] for k in range(CONTEXTS))
            p = 1 / (1 + np.exp(-np.clip(odds, -12, 12)))
            wrong, spread = (p - 1) * counts, p * (1 - p) * counts
            for k in range(CONTEXTS):
                slope[k] += np.bincount(gates, wrong * inputs[k], n)
                for j in range(k + 1):
                    bend[:, k, j] += np.bincount(gates, spread * inputs[k] * inputs[j], n)
            bend = np.tril(bend) + np.tril(bend, -1).transpose(0, 2, 1)
            weights = weights - np.linalg.solve(bend, slope.T[:, :, None])[:, :, 0].T
        return weights

    common = newton(np.full((CONTEXTS, 1), START_WEIGHT), np.zeros(len(cells), np.int64), 1.0)
    return (newton(np.repeat(common, GATES, 1), gates, 4.0) / SCALE).astype(np.float32)


def log_probabilities(
    data: np.ndarray, offsets: np.ndarray, code: Code, tables: np.ndarray | Laid, start: np.ndarray | None = None
) -> np.ndarray:
    """Natural logarithm of the probability of each text with its end. `start` holds weights by context and gate."""
    start = equal_weights() if start is None else start
    tables = laid_out(tables) if isinstance(tables, np.ndarray) else tables
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        beside = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in lanes])
        out[lanes] = _side_by_side(beside, np.r_[0, np.cumsum(sizes[lanes])], code, tables, start)
    return out


def _side_by_side(data: np.ndarray, offsets: np.ndarray, code: Code, tables: Laid, start: np.ndarray) -> np.ndarray:
    """log_probabilities of texts that come longest first. A block of so many of them at a time that PLACES are reached."""
    text, starts, rows = pieces(data, offsets, tables.slots)
    gates, nodes = _gates(tables.levels, rows), tables.node(code.node)
    deep = deep_from(nodes)
    sizes = np.diff(starts)
    out = np.zeros(len(sizes))
    weights = np.zeros((CONTEXTS, len(sizes)), np.float32)  # beyond those of the gate
    refined = np.zeros((len(sizes), BUCKETS), np.float32)
    done, block = 0, 0
    while live := int((sizes > done).sum()):
        step = BLOCKS[min(block, len(BLOCKS) - 1)]
        some = max(1, PLACES // step)
        for a in range(0, live, some):
            b = min(live, a + some)
            n, lengths = b - a, np.minimum(sizes[a:b] - done, step)
            at, lane = ragged(starts[a:b] + done, lengths), np.repeat(np.arange(n), lengths)
            left = np.take(code.length, np.take(text, at))
            first = np.r_[0, np.cumsum(lengths)[:-1]]
            counts = np.add.reduceat(left, first, dtype=np.int64)  # bits by lane
            longest, depths = by_depth(left)
            at, lane = np.take(at, longest), np.take(lane, longest)
            node, bit = path_bits(code, nodes, np.take(text, at), depths)
            cells = asked(node, depths, deep)
            gate = lane * GATES + np.take(gates, at)
            odds, part, inputs = np.zeros(len(node), np.float32), np.empty(len(node), np.float32), []
            for k in range(CONTEXTS):
                inputs.append(_look_up(tables.nodes[k], np.take(rows[k], at), *cells).astype(np.float32))
                weight = np.take((weights[k, a:b, None] + start[k]).ravel(), gate)
                for m, bits in depths:
                    np.multiply(weight[:m], inputs[k][bits], out=part[bits])
                odds += part
            # The refinement goes by the number of the text and what the mixture says.
            np.multiply(odds, np.float32(1.5), out=part)
            np.clip(part, -11.5, 11.5, out=part)
            bucket, middle = part.astype(np.intp), lane * BUCKETS + BUCKETS // 2
            for m, bits in depths:
                bucket[bits] += middle[:m]
            odds += np.take(refined[a:b].ravel(), bucket, out=part, mode="clip")
            np.clip(odds, -12, 12, out=odds)
            np.negative(odds, out=odds)
            np.exp(odds, out=odds)
            odds += 1
            np.reciprocal(odds, out=odds)
            error = np.subtract(bit, odds, out=bit)
            right = np.subtract(np.float32(1), np.abs(error, out=part), out=part)
            shift = np.bincount(bucket, error, n * BUCKETS).reshape(n, BUCKETS)
            for x in inputs:
                x *= error
            # All is summed by place, where the first bits lie. Six probabilities of at least 6e-6 have a product in single precision.
            logs = np.zeros(len(at))
            for d, (m, bits) in enumerate(depths):
                if d:
                    for x in inputs:
                        x[:m] += x[bits]
                if d % 6:
                    right[begin : begin + m] *= right[bits]
                else:
                    begin = bits.start
            for m, bits in depths[::6]:
                logs[:m] += np.log(right[bits])
            in_order = np.empty(len(at))
            in_order[longest] = logs
            out[a:b] += np.add.reduceat(in_order, first)
            pace = LEARN / (SCALE * SCALE) / (1 + counts / 64)
            for k in range(CONTEXTS):
                in_order[longest] = inputs[k][: len(at)]
                weights[k, a:b] += pace * np.add.reduceat(in_order, first)
            refined[a:b] = np.clip(refined[a:b] + np.clip(REFINE * shift, -0.05, 0.05), -2, 2)
        done, block = done + step, block + 1
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (A-Z in lower case, cut at ASCII white space) and their rows."""
    starts, lengths, rows = spans(data, offsets, BLANK_BYTES)
    ends = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    inside = data.tobytes().translate(LOWER_BYTES.tobytes(), bytes(np.flatnonzero(BLANK_BYTES)))  # the words one after the other
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(inside))
    return words, rows


def token_hashes(words: pa.Array) -> np.ndarray:
    data, offsets = utf8(words)
    return hashes(data, offsets[:-1], np.diff(offsets))


def positions(words: pa.Array, frequent: pa.Array, keys: np.ndarray) -> np.ndarray:
    """Where `frequent`, whose hashes are `keys` in ascending order, has each word, or -1. Words are compared; of frequent
    ones with the same hash only the first is found."""
    out = np.full(len(words), -1, np.int64)
    if not len(words) or not len(keys):
        return out
    wanted = token_hashes(words)
    order = np.argsort(wanted)  # hashes in order are found faster
    wanted = np.take(wanted, order)
    at = np.searchsorted(keys, wanted)
    met = np.flatnonzero(np.take(keys, at, mode="clip") == wanted)
    order, at = order[met], at[met]
    same = pc.equal(words.take(pa.array(order)), frequent.take(pa.array(at))).to_numpy(zero_copy_only=False)
    out[order[same]] = at[same]
    return out


@dataclass
class Model:
    code: Code
    tables: np.ndarray | Laid
    start: np.ndarray
    train_tokens: int
    distinct: int
    ends: int
    frequent: pa.Array
    frequent_counts: np.ndarray


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different cells in order, and the sums of what the parts hold of them."""
    cells, times = (np.concatenate(columns) for columns in zip(*parts))
    order = np.argsort(cells, kind="stable")  # the parts are in order and only have to be merged
    cells = np.take(cells, order)
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.intp)
    return cells[first], np.add.reduceat(np.take(times, order), first) if len(first) else times


def _cells(cells: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """slot, c and the part of c that is not of the fold, which is the lowest bit of a cell. A slot has one row."""
    slot, c = _summed([(cells >> cells.dtype.type(1), sums)])
    others = np.zeros(len(c), np.int64)
    rest = (cells & cells.dtype.type(1)) == 0
    others[np.searchsorted(slot, cells[rest] >> cells.dtype.type(1))] = sums[rest]
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(c), pa.array(others)], ["slot", "c", "others"])


def train(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all rows whose crc32 of the id does not leave 2 of 7, and the counts (token, c) of their tokens.

    Three passes over the rows: tokens and bytes are counted, then symbols by context, then what the weights are fitted
    on, each half against the counts of the other. Each task sums what it has read; Spark sums the tasks. Only the tables,
    sized by the bytes, GATES * MEETINGS sums at most and at most FREQUENT tokens go to the driver.
    """
    spark = documents.sparkSession
    learned = documents.where(~held_out(F.col("doc_id"), 7, 2)).select("text")

    def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_seen, ends = np.zeros(257, np.int64), 0
        for batch in sliced(batches, "text", 8_000_000):
            data, offsets = utf8(batch.column("text"))
            bytes_seen[:256] += np.bincount(data, minlength=256)
            ends += batch.num_rows
            words, _ = tokens(data, offsets)
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(found), pa.int32()), found.field(0).cast(pa.string()), found.field(1)], ["symbol", "token", "c"]
            )
        bytes_seen[END] = ends
        some = np.flatnonzero(bytes_seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.string()), pa.array(bytes_seen[some])], ["symbol", "token", "c"]
        )

    counted = learned.mapInArrow(count_tokens, "symbol int, token string, c bigint").groupBy("symbol", "token").agg(F.sum("c").alias("c"))
    counted = written(counted)
    seen = np.zeros(257, np.int64)
    for row in counted.where("symbol IS NOT NULL").collect():  # at most 257
        seen[row["symbol"]] = row["c"]
    counts = counted.where("token IS NOT NULL").select("token", "c")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = int(seen[END])
    short = counts.where(F.octet_length("token") <= FREQUENT_BYTES).orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    code = huffman(seen)
    slots = table_rows(int(seen[:END].sum()))

    def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only cells that occur are held, in order, and handed on when there are many: memory does not grow with the tables.
        kind = np.uint32 if CONTEXTS * slots * WIDTH * 2 <= 1 << 32 else np.int64
        held, new, waiting = (np.zeros(0, kind), np.zeros(0, np.int64)), [], 0
        for batch in sliced(batches, "text", 2_000_000):
            text, starts, numbers = pieces(*utf8(batch.column("text")), slots)
            fold = np.repeat(batch.column("fold").to_numpy(zero_copy_only=False), np.diff(starts))
            for k, rows in enumerate(numbers):
                cells = rows.astype(kind)
                cells += kind(k * slots)
                cells *= kind(WIDTH)
                cells += text
                cells <<= kind(1)
                cells |= fold
                cells.sort()
                first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                new.append((cells[first], np.diff(np.r_[first, len(cells)])))
                waiting += len(first)
            if waiting > max(HELD_CELLS // 4, len(held[0])):
                held, new, waiting = _summed([held, *new]), [], 0
                if len(held[0]) > HELD_CELLS:
                    yield _cells(*held)
                    held = (held[0][:0], held[1][:0])
        yield _cells(*_summed([held, *new]))

    half = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 7) % 2 == 0).alias("fold")
    marked = documents.where(~held_out(F.col("doc_id"), 7, 2)).select("text", half)
    summed = marked.mapInArrow(count_contexts, "slot bigint, c bigint, others bigint")
    summed = summed.groupBy("slot").agg(F.sum("c").alias("c"), F.sum("others").alias("others")).toArrow()
    order = np.argsort(summed["slot"].to_numpy())
    cells, sums_of, others = (summed[c].to_numpy()[order] for c in ("slot", "c", "others"))
    del summed, order

    def halves(fold: bool) -> tuple[np.ndarray, np.ndarray]:
        """The inputs that meet in the texts of a half, with counts of the other half."""
        other = others if fold else sums_of - others
        some = other > 0
        held = spark.sparkContext.broadcast((code, laid_out(sparse_log_odds(cells[some], other[some], slots, code))))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros(GATES * MEETINGS, np.int64)
            for batch in sliced(batches, "text", 4_000_000):
                count_inputs(*utf8(batch.column("text")), *held.value, totals)
            met = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(totals[met])], ["cell", "c"])

        inputs = marked.where(F.col("fold") == fold).select("text").mapInArrow(count, "cell bigint, c bigint")
        inputs = inputs.groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
        held.unpersist(blocking=True)
        return inputs["cell"].to_numpy(), inputs["c"].to_numpy()

    met = [halves(fold) for fold in (True, False)]
    start = fit_weights(np.concatenate([m[0] for m in met]), np.concatenate([m[1] for m in met]))
    model = Model(
        code, sparse_log_odds(cells, sums_of, slots, code), start, int(sums["n"]) + ends, int(sums["v"]) + (ends > 0), ends,
        short["token"].combine_chunks(), short["c"].to_numpy(),
    )
    return model, counts


def score(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row.

    Null texts count as empty; an empty text has its end only. Without training rows every count is 0 and the bits
    are even. Rows are told apart by their place in the table, so repeated rows are scored each for itself.
    """
    keys = token_hashes(model.frequent)
    order = np.argsort(keys, kind="stable")
    sorted_model = replace(model, tables=laid_out(model.tables), frequent=model.frequent.take(pa.array(order)), frequent_counts=model.frequent_counts[order])
    held = documents.sparkSession.sparkContext.broadcast((sorted_model, keys[order]))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, keys = held.value
        log_counts = np.log10(m.frequent_counts + 1.0)
        for batch in sliced(batches, "text", 4_000_000):
            data, offsets = utf8(batch.column("text"))
            n = batch.num_rows
            words, rows = tokens(data, offsets)
            coded = words.dictionary_encode()
            different, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
            place = positions(different, m.frequent, keys)
            known = place >= 0
            logs = np.where(known, log_counts[place] if len(log_counts) else 0.0, 0.0)
            base = np.bincount(rows, logs[codes], n) + np.log10(m.ends + 1.0)
            hits = np.bincount(rows, known[codes], n).astype(np.int64) + (m.ends > 0)
            rare = np.flatnonzero(~known[codes])
            pairs, times = np.unique(rows[rare] * len(different) + codes[rare], return_counts=True) if len(rare) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            owner, word = pairs // max(len(different), 1), pairs % max(len(different), 1)
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))].astype(np.int32)
            logp = log_probabilities(data, offsets, m.code, m.tables, m.start) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(np.bincount(rows, minlength=n) + 1), pa.array(hits), pa.array(base), pa.array(logp),
                    pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), different.take(pa.array(word))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64))),
                ],
                ["row", "doc_id", "n_tokens", "known", "logs", "score", "n_bytes", "rare", "times"],
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        measure,
        f"row bigint, doc_id {kind}, n_tokens bigint, known bigint, logs double, score double, n_bytes bigint, rare array<string>, times array<bigint>",
    )
    # An element of its own keeps each row; its token occurs nowhere, and no two rows have the same.
    own = F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).alias("token"), F.lit(0).cast("bigint").alias("k"))
    each = F.concat(F.array(own), F.transform(F.arrays_zip("rare", "times"), lambda x: F.struct(x["rare"].alias("token"), x["times"].alias("k"))))
    flat = rows.select("row", "doc_id", "n_tokens", "known", "logs", "score", "n_bytes", F.inline(each))
    joined = flat.join(counts, "token", "left")
    whole = [F.first(c).alias(c) for c in ("doc_id", "n_tokens", "known", "logs", "score", "n_bytes")]
    rest = F.sum(F.when(F.col("c").isNotNull(), F.col("k") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("rest")
    more = F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more")
    whole = joined.groupBy("row").agg(*whole, rest, more)
    below = F.lit(float(np.log10(model.train_tokens + model.distinct + 1)))
    return whole.select(
        "doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.col("rest") - F.col("n_tokens") * below).alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )

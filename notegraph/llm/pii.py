"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF that adds spans.

The network is trained in numpy on windows of a bounded sample of documents: with the spans that the patterns find, and
with made-up values (`made_up`) put between the words of the text, whose spans are known: keys and tokens, phone numbers
without a plus, spelled-out addresses, card numbers with other signs, long IP addresses; and with dates, prices, numbers,
versions and names that are no personal data. Whole texts are tagged in overlapping windows; where two windows overlap,
each decides up to the middle, and runs of one tag across windows are one span. A span is added if the network prefers it
by MARGIN (scores and transitions of the whole span against those of none), and if it has the digits and signs that a value of its kind needs at least (`likely`).
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from notegraph.llm.common import ragged, sliced, utf8

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans, in order: those of the patterns, and keys, tokens and passwords.
ALL_KINDS = (*KINDS, "secret")
TAGS = 1 + len(ALL_KINDS)
HIDDEN = 6
WINDOW, OVERLAP, BATCH = 512, 64, 1024
#: Documents that the network is trained on at most; windows per document; characters of a training window.
TRAINING_ROWS, WINDOWS_PER_ROW, TRAINING_WIDTH = 3000, 6, 96
#: Windows with made-up values per training document.
MADE_PER_ROW = 6
#: How much more log likelihood the network must give to an added span than to none in its place.
MARGIN = 2.0
#: Updates of the weights, about: rounds over the windows are as many as that takes, between the two bounds.
UPDATES, FEWEST_ROUNDS, MOST_ROUNDS, BATCH_ROWS, RATE = 1100, 4, 30, 96, 0.02
SIGNS = ".@+-_%():,/=\"'[]"
HEX = 0  # a to f, which digests and keys are made of
DIGIT, LOWER, UPPER, BEYOND, BLANK, LINE, MARK = 1, 2, 3, 4, 5, 6, 7
CLASSES = MARK + 1 + len(SIGNS)
CLASS = np.zeros(128, np.uint8)
for _x in range(128):
    _c = chr(_x)
    CLASS[_x] = (
        DIGIT if _c.isdigit() else HEX if _c in "abcdef" else LOWER if _c.islower() else UPPER if _c.isupper() else BLANK if _c == " "
        else LINE if _c in "\t\n\r" else MARK + 1 + SIGNS.index(_c) if _c in SIGNS else MARK
    )

# The patterns of the base spans.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The email pattern's matches, found from each @: a run of local signs before it may start no earlier than the
    last match ended. Linear in the text, where the pattern alone is not."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def valid(kind: str, part: str) -> bool:
    """The check that a match of a kind must pass."""
    if kind == "email":
        return "@" in part.strip("@")
    if kind == "ip":
        parts = part.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    digits = _digits(part)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return part.startswith("+") and 9 <= len(digits) <= 15


def base_spans(text: str, digits: int = 4) -> list[tuple[str, int, int]]:
    """Matches of the patterns that pass their checks: kind, start, end; by start, then kind. digits: how many the text
    has at most, if that is known; with fewer than four there is no address, card or phone."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if digits < 4:
        return found
    for kind, pattern in (("ip", IP), ("card", CARD)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if valid("phone", m[0])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def likely(kind: str, part: str) -> bool:
    """What a value of a kind has at least, however it is written. Spans that the network adds must have it."""
    digits = _digits(part)
    if kind == "email":
        return valid(kind, part) or re.search(r"(?i)[ (\[{]at[ )\]}].*[ (\[{.](dot[ )\]}])?", part) is not None
    if kind == "ip":
        return valid(kind, part) or (part.count(":") >= 3 and re.fullmatch("[0-9A-Fa-f:.]+", part) is not None)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15 and re.fullmatch(r"[0-9\x20()./+-]+", part) is not None and len(part) > len(digits)
    return len(part) >= 16 and not re.search(r"\s", part) and bool(digits) and re.search("[A-Za-z]", part) is not None


_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_KEYS = ("token", "api_key", "secret", "password", "key", "access_token", "Authorization: Bearer", "API key", "auth", "passwd")


def made_up(r: random.Random) -> tuple[str, str, str, str | None]:
    """A made-up passage: what is before the value, the value, what is behind it, and its kind (None: nothing personal)."""

    def signs(alphabet: str, n: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(n))

    def number(n: int) -> str:
        return signs("123456789", 1) + signs("0123456789", n - 1)

    def word() -> str:
        return signs("abcdefghijklmnopqrstuvwxyz", r.randint(2, 9))

    before, behind = r.choice([" ", " ", " ", "\n", " (", "## ", "!! "]), r.choice([" ", " ", " ", ". ", ", ", "\n", "### ", "%%% ", ") "])
    choice = r.randrange(12)
    if choice < 3:
        quote = r.choice(['"', '"', "'", ""])
        value = r.choice([
            lambda: signs(_HEX, r.choice([32, 40, 40, 64])), lambda: signs(_ALNUM, r.randint(20, 48)), lambda: "AKIA" + signs(_ALNUM[:26] + "234567", 16),
            lambda: r.choice(["ghp_", "sk-", "pk_live_", "xoxb-"]) + signs(_ALNUM, r.randint(24, 40)), lambda: signs(_ALNUM + "+/", 40) + r.choice(["", "=", "=="]),
        ])()
        head = r.choice([f"{r.choice(_KEYS)}{r.choice([' = ', '=', ': ', ' '])}", f"{r.choice(_KEYS)} = ", ""])
        return before + head + quote, value, quote + behind, "secret" if likely("secret", value) else None
    if choice < 5:
        a, b, c = number(3), number(3), number(4)
        value = r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"00{number(2)} {a} {number(7)}", f"0{number(3)} / {number(7)}", f"+{number(2)} {a} {b} {c}"])
        return before, value, behind, "phone"
    if choice == 5:
        at, dot = r.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
        return before, f"{word()}{r.choice(['', '.', '_'])}{number(r.randint(1, 3))}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}", behind, "email"
    if choice == 6:
        digits = number(15)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        between = r.choice([".", "/", "  ", ""])
        return before, between.join(digits[k : k + 4] for k in range(0, 16, 4)), behind, "card"
    if choice == 7:
        return before, ":".join(signs(_HEX, r.randint(1, 4)) for _ in range(r.choice([4, 6, 8]))), behind, "ip"
    nothing = r.choice([
        lambda: f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
        lambda: f"{r.randint(1, 999)},{signs('0123456789', 3)}.{signs('0123456789', 2)}", lambda: f"v{r.randint(0, 20)}.{r.randint(0, 40)}.{r.randint(0, 9)}",
        lambda: number(r.randint(1, 11)), lambda: f"{word()}_{word()}_{word()}", lambda: f"https://www.{word()}.org/{word()}/{word()}-{word()}.html",
        lambda: f"{word()}-{word()}-{word()}", lambda: f"{number(3)}-{number(3)}", lambda: f"{word()} at {word()}. {word().title()}", lambda: "".join(word() for _ in range(5)),
        lambda: f"{number(2)}/{number(2)}/{number(4)}", lambda: f"{word().title()}{number(2)}{word()}", lambda: f"{number(4)} {number(4)}", lambda: f'{word()} = "{word()}{word()}"',
    ])()
    return before, nothing, behind, None


def made_window(text: str, r: random.Random, width: int) -> tuple[str, int, int, str | None]:
    """A window of a text with a made-up passage between two of its words: the window, and the value's span and kind."""
    before, value, behind, kind = made_up(r)
    at = text.find(" ", r.randrange(len(text) + 1))
    at = len(text) if at < 0 else at
    lead = r.randrange(max(1, min(40, width - len(before) - 12)))
    left = text[max(0, at - lead) : at] + before
    return (left + value + behind + text[at + 1 : at + 1 + width])[:width], len(left), min(width, len(left) + len(value)), kind


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    return np.where(points < 128, CLASS[np.minimum(points, 127)], BEYOND).astype(np.uint8)


def _squash(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place: the network's hyperbolic tangent, at a sixth of its cost. Gates are half of it and 1 / 2."""
    np.abs(x, out=room)
    room += 1
    x /= room


class Tagger:
    """Weights by name, float32. Gates lie in rows (input, forget, output, new), sequences in columns."""

    def __init__(self, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))

        def normal(scale: float, *shape: int) -> np.ndarray:
            return (scale * r.standard_normal(shape)).astype(np.float32)

        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": normal(0.5, 4 * h, CLASSES), f"u{d}": normal(0.35, 4 * h, h), f"e{d}": normal(0.4, TAGS, h)}
            self.p[f"x{d}"][h : 2 * h] += 1.0  # forget gates start open
        self.p |= {"c": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["c"][0] = 1.0

    def emissions(self, codes: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """codes: steps x sequences, read forward and (in codes[::-1]) backward; the tags' scores of either way."""
        out = []
        h, h3, h4, n = HIDDEN, 3 * HIDDEN, 4 * HIDDEN, codes.shape[1]
        for d, way in (("f", codes), ("b", codes[::-1])):
            x = self.p[f"x{d}"]
            # States are held doubled, which saves halving the gates; one product feeds the gates and scores the step before.
            both = 0.5 * np.concatenate([self.p[f"u{d}"], self.p[f"e{d}"]])
            state, cell = np.zeros((h, n), x.dtype), np.zeros((h, n), x.dtype)
            scores = np.empty((len(way), TAGS, n), x.dtype)
            gates, fed, room = np.empty((h4, n), x.dtype), np.empty((h4 + TAGS, n), x.dtype), np.empty((h4, n), x.dtype)
            for t, code in enumerate(way):
                np.matmul(both, state, out=fed)
                if t:
                    scores[t - 1] = fed[h4:]
                np.take(x, code, axis=1, out=gates, mode="clip")
                gates += fed[:h4]
                _squash(gates, room)
                gates[:h3] += 1
                if keep is not None:
                    kept = gates.copy()
                    kept[:h3] *= 0.5
                    keep.append((d, t, code, 0.5 * state, cell.copy(), kept))
                cell *= gates[h : 2 * h]
                gates[:h] *= gates[h3:]
                cell += gates[:h]
                cell *= 0.5
                np.copyto(state, cell)
                _squash(state, room[:h])
                state *= gates[2 * h : h3]
            scores[-1] = both[h4:] @ state
            out.append(scores)
        return out[0], out[1]

    def gain(self, scores: np.ndarray) -> np.ndarray:
        """A bound from above on what a path other than all 0 gains in each sequence: the best run of steps outside
        tag 0, with the best transitions into, within and out of it."""
        moves = self.p["t"] - self.p["t"][0, 0]
        enter, leave, within = float(moves[0, 1:].max()), float(moves[1:, 0].max()), float(moves[1:, 1:].max())
        each = scores[:, 1:].max(1) - scores[:, 0] + within
        # A run that starts or ends with the sequence has no such transition.
        run = np.full(scores.shape[2], max(0.0, -enter))
        best = np.full(scores.shape[2], -np.inf)
        for step in each:
            run = np.maximum(run, 0) + step
            np.maximum(best, run, out=best)
        return np.maximum(best, run + max(0.0, -leave)) + enter + leave - within

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of every sequence, steps x sequences. Where no run of steps can gain from leaving tag 0 (see
        `gain`), the best path is all 0 and the search is left out."""
        steps, _, n = scores.shape
        tags = np.zeros((steps, n), np.uint8)
        moves = self.p["t"]
        rest = np.flatnonzero(self.gain(scores) >= 0)
        if not len(rest):
            return tags
        scores = scores[:, :, rest]
        best, back = scores[0], np.zeros((steps, TAGS, len(rest)), np.uint8)
        for t in range(1, steps):
            reach = best[:, None, :] + moves[:, :, None]
            top, where = reach[0], back[t]
            for k in range(1, TAGS):
                better = reach[k] > top
                where[better] = k
                top = np.maximum(top, reach[k])
            best = top + scores[t]
        at = best.argmax(0).astype(np.uint8)
        columns = np.arange(len(rest))
        for t in reversed(range(steps)):
            tags[t, rest] = at
            at = back[t, at, columns]
        return tags

    def tag(self, points: np.ndarray, offsets: np.ndarray, leads: np.ndarray | None = None) -> np.ndarray:
        """A tag for each code point of texts that lie one after the other. `leads`, if given, gets the score of each tag
        that is not 0 less that of tag 0."""
        kinds, sizes = classes(points), np.diff(offsets)
        step = WINDOW - OVERLAP
        per_row = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // step) + 1), 0)
        owner = np.repeat(np.arange(len(sizes)), per_row)
        k = ragged(np.zeros(len(sizes), np.int64), per_row)
        begin = np.minimum(k * step, np.maximum(sizes[owner] - WINDOW, 0))  # the last window ends with the text
        length = np.minimum(sizes[owner], WINDOW)
        same = np.r_[owner[1:] == owner[:-1], False] if len(owner) else np.zeros(0, bool)
        ahead = np.r_[begin[1:], 0] if len(owner) else begin
        # Each window answers for the places from the middle of one overlap to the middle of the next.
        until = np.where(same, (ahead + begin + length + 1) // 2, begin + length)
        since = np.where(np.r_[False, same[:-1]], np.r_[0, until[:-1]], begin) if len(owner) else begin
        tags = np.zeros(len(points), np.uint8)
        first = offsets[:-1][owner] + begin
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            longest = int(length[part].max())
            place = np.arange(longest)[:, None]
            codes = kinds[np.minimum(first[part] + place, len(kinds) - 1)].astype(np.intp)
            whole = int(length[part].min()) == longest
            if not whole:
                # Backward, a shorter sequence starts at its own end: its places come first in reversed order.
                mirrored = kinds[first[part] + np.maximum(length[part] - 1 - place, 0)].astype(np.intp)
                ahead_scores, _ = self.emissions(codes)
                _, back_scores = self.emissions(mirrored[::-1])
                index = np.maximum(length[part] - 1 - place, 0)[:, None, :]
                scores = ahead_scores + np.take_along_axis(back_scores, np.broadcast_to(index, back_scores.shape), 0)
                beyond = (place >= length[part])[:, None, :]
                scores += self.p["c"][:, None]
                scores = np.where(beyond, np.where(np.arange(TAGS)[:, None] == 0, 1e4, -1e4), scores)
            else:
                ahead_scores, back_scores = self.emissions(codes)
                scores = ahead_scores
                scores += back_scores[::-1]
                scores += self.p["c"][:, None]
            found = self.decode(scores)
            column, row = np.nonzero(found.T)
            inside = begin[part][column] + row
            own = (inside >= since[part][column]) & (inside < until[part][column])
            place, row, column = first[part][column[own]] + row[own], row[own], column[own]
            tags[place] = chosen = found[row, column]
            if leads is not None:
                leads[place] = scores[row, chosen, column] - scores[row, 0, column]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the negative log likelihood of tags (steps x sequences), and its mean."""
        keep: list = []
        steps, n = codes.shape
        ahead, back = self.emissions(codes, keep)
        scores = ahead + back[::-1] + self.p["c"][:, None]
        moves = self.p["t"]

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis)
            return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))

        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = total(alpha[t - 1][:, None, :] + moves[:, :, None], 0) + scores[t]
        for t in reversed(range(steps - 1)):
            beta[t] = total(moves[:, :, None] + (scores[t + 1] + beta[t + 1])[None], 1)
        whole = total(alpha[-1], 0)
        d_scores = np.exp(alpha + beta - whole)
        pairs = np.exp(alpha[:-1, :, None] + moves[:, :, None] + (scores[1:] + beta[1:])[:, None] - whole).sum((0, 3))
        rows, columns = np.arange(steps)[:, None], np.arange(n)[None, :]
        loss = whole.sum() - scores[rows, tags, columns].sum() - moves[tags[:-1], tags[1:]].sum()
        d_scores[rows, tags, columns] -= 1
        np.subtract.at(pairs, (tags[:-1], tags[1:]), 1)
        d_scores /= n
        g = {"c": d_scores.sum((0, 2)), "t": pairs / n}
        h, h3 = HIDDEN, 3 * HIDDEN
        for d in "fb":
            u, e = self.p[f"u{d}"], self.p[f"e{d}"]
            g |= {f"x{d}": np.zeros_like(self.p[f"x{d}"]), f"u{d}": np.zeros_like(u), f"e{d}": np.zeros_like(e)}
            d_way = d_scores if d == "f" else d_scores[::-1]
            d_state, d_cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for way, t, code, state, cell, gates in reversed(keep):
                if way != d:
                    continue
                i, f, o, new = gates[:h], gates[h : 2 * h], gates[2 * h : h3], gates[h3:]
                squashed = f * cell + i * new
                _squash(squashed, np.empty_like(squashed))
                g[f"e{d}"] += d_way[t] @ (o * squashed).T
                d_state = d_state + e.T @ d_way[t]
                d_cell = d_cell + d_state * o * (1 - np.abs(squashed)) ** 2
                slope = 0.5 * (1 - np.abs(2 * gates[:h3] - 1)) ** 2
                d_gates = np.concatenate([d_cell * new, d_cell * cell, d_state * squashed, d_cell * i * (1 - np.abs(new)) ** 2])
                d_gates[:h3] *= slope
                for k in range(CLASSES):
                    chosen = code == k
                    if chosen.any():
                        g[f"x{d}"][:, k] += d_gates[:, chosen].sum(1)
                g[f"u{d}"] += d_gates @ state.T
                d_state, d_cell = u.T @ d_gates, d_cell * f
        return g, float(loss / n)


def train_tagger(codes: np.ndarray, tags: np.ndarray) -> Tagger:
    """codes, tags: one training window per row. Without windows every text is left without spans."""
    from notegraph.llm.toxicity import Adam

    tagger = Tagger()
    if not len(codes):
        tagger.p["c"][0] = 1e3
        return tagger
    adam, r = Adam(tagger.p), np.random.Generator(np.random.PCG64(3))
    batches = max(1, len(codes) // BATCH_ROWS)
    rounds = min(max(-(-UPDATES // batches), FEWEST_ROUNDS), MOST_ROUNDS)
    for turn in range(rounds):
        for part in np.array_split(r.permutation(len(codes)), batches):
            g, _ = tagger.gradients(codes[part].T, tags[part].T)
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            adam.step({k: (x * min(1.0, 5 / norm)).astype(np.float32) for k, x in g.items()}, RATE * (1.0 if turn < 0.75 * rounds else 0.25))
    return tagger


def train(documents: DataFrame, rows: int = TRAINING_ROWS) -> Tagger:
    """A tagger from at most `rows` documents, chosen by a hash of the id: up to WINDOWS_PER_ROW windows of each, around the
    patterns' spans and in the middle, and MADE_PER_ROW windows with made-up values that depend on the text alone, so the
    driver gets a bounded amount."""
    width = TRAINING_WIDTH

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, codes, tags = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                found = base_spans(text)
                truth = np.zeros(len(text) + width, np.uint8)
                for kind, a, b in reversed(found):
                    truth[a:b] = 1 + KINDS.index(kind)
                kinds = np.full(len(text) + width, BLANK, np.uint8)
                kinds[: len(text)] = classes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
                places = [max(0, a - 17 * (1 + k % 4)) for k, (_, a, _) in enumerate(found)][: WINDOWS_PER_ROW - 1]
                for a in [*places, len(text) // 2]:
                    ids.append(doc_id)
                    codes.append(kinds[a : a + width].tobytes())
                    tags.append(truth[a : a + width].tobytes())
                r = random.Random(zlib.crc32(text.encode()))
                for _ in range(MADE_PER_ROW):
                    window, a, b, kind = made_window(text, r, width)
                    own = np.full(width, BLANK, np.uint8)
                    own[: len(window)] = classes(np.frombuffer(window.encode("utf-32-le"), np.uint32))
                    truth = np.zeros(width, np.uint8)
                    for known, x, y in base_spans(window):
                        truth[x:y] = 1 + KINDS.index(known)
                    if kind is not None:
                        truth[a:b] = 1 + ALL_KINDS.index(kind)
                    ids.append(doc_id)
                    codes.append(own.tobytes())
                    tags.append(truth.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column("doc_id").type), pa.array(codes, pa.binary()), pa.array(tags, pa.binary())], ["doc_id", "codes", "tags"]
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    # Half of the sample are documents with an @ or a +, which hold most of the spans.
    ids = documents.select("doc_id", F.coalesce(F.col("text").rlike("[@+]|[0-9]{2}"), F.lit(False)).alias("rich"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = ids.where("rich").orderBy(*order).limit(rows // 2).unionByName(ids.where("NOT rich").orderBy(*order).limit(rows - rows // 2))
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    found = sample.mapInArrow(cut, f"doc_id {kind}, codes binary, tags binary").toArrow().to_pandas().sort_values(["doc_id", "codes", "tags"])
    arrays = [np.frombuffer(b"".join(found[c]), np.uint8).reshape(-1, width) for c in ("codes", "tags")]
    return train_tagger(*arrays)


def added_spans(text: str, tags: np.ndarray, leads: np.ndarray, base: list[tuple[str, int, int]], moves: np.ndarray) -> list[tuple[str, int, int]]:
    """moves: the transitions. Runs of one tag that the network prefers by MARGIN, whole words, that are likely and overlap no base span or one
    another. A run is widened to the words that it begins and ends in, and loses blanks and stops at its ends."""
    cuts = np.flatnonzero(np.diff(np.r_[0, tags, 0]))
    out, last = [], 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if not tags[a]:
            continue
        k = tags[a]
        gained = leads[a:b].sum() + moves[0, k] + (b - a - 1) * moves[k, k] + moves[k, 0] - (b - a + 1) * moves[0, 0]
        if gained < MARGIN:
            continue
        kind, part = ALL_KINDS[tags[a] - 1], text[a:b]
        a, b = a + len(part) - len(part.lstrip(" .,;:\"'\n")), b - len(part) + len(part.rstrip(" .,;:\"'\n"))
        if a >= b:
            continue
        while a > last and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        if kind in ("phone", "card") and text[a] != "(" and text[a - 1 : a] == "(" and ")" in text[a:b]:
            a -= 1
        if a >= last and likely(kind, text[a:b]) and all(b <= x or a >= y for _, x, y in base):
            out.append((kind, a, b))
            last = b
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(tagger: Tagger, column: pa.Array) -> Iterator[tuple[str, list, list]]:
    """For each text: the text, its base spans, and all spans."""
    data, _ = utf8(column)
    texts = [x or "" for x in column.to_pylist()]
    offsets = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.zeros(len(points), np.float32)
    tags = tagger.tag(points, offsets, leads)
    tagged = np.r_[0, np.cumsum(tags > 0)]
    digits = np.r_[0, np.cumsum((points >= 48) & (points <= 57))]
    for i, text in enumerate(texts):
        base = base_spans(text, int(digits[offsets[i + 1]] - digits[offsets[i]]))
        found = base
        if tagged[offsets[i + 1]] > tagged[offsets[i]]:
            own = slice(offsets[i], offsets[i + 1])
            found = sorted(base + added_spans(text, tags[own], leads[own], base, tagger.p["t"]), key=lambda x: (x[1], ALL_KINDS.index(x[0])))
        yield text, base, found


def find_personal_data(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base (list of them), spans (all, kinds of ALL_KINDS), both as
    kind:start:end by start, comma-joined.

    Null and empty texts have none, nor has an empty table. Long texts are read whole, in windows. One row per row, so a row
    that is repeated is repeated here; spans that start at one place go by kind. Extra columns are left out, whatever
    their names.
    """
    held = documents.sparkSession.sparkContext.broadcast(tagger)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            counts, base, all_spans = [[] for _ in KINDS], [], []
            for _, own, found in find(held.value, batch.column("text")):
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(x[0] == kind for x in own))
                base.append(joined(own))
                all_spans.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(all_spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {counts}, base string, spans string")


def mask_personal_data(documents: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and n_chars as it is then. All columns as they are,
    whatever their names. Null and empty texts and an empty table stay as they are; repeated rows stay repeated."""
    held = documents.sparkSession.sparkContext.broadcast(tagger)
    names = documents.columns

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = []
            for text, _, found in find(held.value, batch.column("text")):
                parts, at = [], 0
                for kind, a, b in found:
                    if b > at:
                        parts += [text[at : max(a, at)], f"[{kind}]"] if a >= at else []
                        at = b
                texts.append("".join([*parts, text[at:]]) if found else text)
            kept = [t if was.is_valid else None for t, was in zip(texts, batch.column("text"))]
            columns = dict(zip(names, batch.columns)) | {"text": pa.array(kept, batch.column("text").type)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in kept], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return documents.mapInArrow(mask, documents.schema)

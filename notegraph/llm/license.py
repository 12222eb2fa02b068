"""License scan by conditional compression.

Blocks of words around license vocabulary are compressed alone and with each template as a raw zstandard dictionary.
Templates are ranked by how much smaller the block gets; the best are confirmed by the exact differences in wording.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from notegraph.llm.common import sliced

#: Words kept on both sides of license vocabulary; templates compared word by word at a time, down the ranking until one
#: is confirmed; share of a template's words that must be there in order.
MARGIN, COMPARED, CONFIRMED = 60, 3, 0.9
TRIGGER = re.compile(r"licen[sc]e|copyright|copyleft|spdx|permission is hereby|redistribut|public domain|all rights reserved", re.I)
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*", re.U)
# Words that tell licenses apart, besides versions: a notice with another one, or without one of its own, is another notice.
NAMES = frozenset(
    "affero apache bsd cc cc0 by-nc by-nd by-sa by-nc-nd by-nc-sa eclipse general gnu lesser library mit mozilla "
    "noncommercial non-commercial noderivatives sharealike".split()
)
VERSION = re.compile(r"v?\d+(?:\.\d+)*")

# Short notices and opening paragraphs of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def blocks(text: str, margin: int = MARGIN) -> list[list[str]]:
    """Words of the text near license vocabulary, as runs that do not touch. Only the surroundings of a trigger are cut
    into words; a very long text without any costs one search."""
    stretches: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        # The margin is some words; ten characters a word, and long words shorten it.
        a, b = max(0, m.start() - 10 * margin), min(len(text), m.end() + 10 * margin)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    return [[w for w, _, _ in words(text[a:b])] for a, b in stretches]


def deciding(template: list[str]) -> set[str]:
    """Words of a template that must all be there: names and versions."""
    return {w for w in template if w in NAMES or VERSION.fullmatch(w) or (w == "by" and "cc" in template)}


class Compressors:
    """Sizes of a block alone and given each template."""

    def __init__(self, templates: dict[str, str]):
        import zstandard

        self.words = {name: [w for w, _, _ in words(text)] for name, text in templates.items()}
        self.deciding = {name: deciding(found) for name, found in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=9)
        self.given = {
            name: zstandard.ZstdCompressor(
                level=9, dict_data=zstandard.ZstdCompressionDict(" ".join(found).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            )
            for name, found in self.words.items()
        }

    def ranked(self, block: list[str]) -> list[tuple[int, str]]:
        """(bytes saved, template) of those that save any, best first; ties by name."""
        data = " ".join(block).encode()
        size = len(self.alone.compress(data))
        saved = [(size - len(c.compress(data)), name) for name, c in self.given.items()]
        return sorted((x for x in saved if x[0] > 0), key=lambda x: (-x[0], x[1]))


def differences(template: list[str], block: list[str]) -> tuple[float, list[str], list[int]]:
    """Share of the template's words that the block has in order and close together, the wording that differs as
    -word (missing) and +word (put in between), and the places of the words that match."""
    runs = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    # A notice is one passage: runs far from the longest one do not belong to it.
    core = max(runs, key=lambda m: m.size, default=None)
    if core is None:
        return 0.0, [f"-{w}" for w in template], []
    reach = len(template)
    runs = [m for m in runs if core.b - reach <= m.b and m.b + m.size <= core.b + core.size + reach]
    inside = {m.a + k for m in runs for k in range(m.size)}
    places = sorted(m.b + k for m in runs for k in range(m.size))
    extra = [k for k in range(places[0], places[-1] + 1) if k not in set(places)]
    changes = [f"-{w}" for k, w in enumerate(template) if k not in inside] + [f"+{block[k]}" for k in extra]
    return (len(inside) - 0.5 * len(extra)) / len(template), changes, places


def confirm(template: list[str], must: set[str], block: list[str], confirmed: float) -> tuple[list[str], list[int]] | None:
    """Differences in wording and places of the passage that has that share of the template and none of whose
    differences is a name, or a version where the template has one. Other passages are passed over."""
    versioned = any(VERSION.fullmatch(w) for w in must)
    while True:
        share, changes, places = differences(template, block)
        if share < confirmed:
            return None
        other = [w for w in (c[1:] for c in changes) if w in must or w in NAMES or (versioned and VERSION.fullmatch(w))]
        if not other:
            return changes, places
        block = list(block)
        for k in places:
            block[k] = ""


def licenses(block: list[str], compressors: Compressors, compared: int = COMPARED, confirmed: float = CONFIRMED) -> list[tuple[str, int, list[str]]]:
    """(template, bytes saved, differences) of every notice of a block. A confirmed notice is taken out, and the rest
    is ranked again, until nothing is confirmed: neither one of the ranked templates nor one that saves no bytes."""
    out = []
    while block:
        best = None
        held = Counter(block)
        order = compressors.ranked(block)
        ranked = {name for _, name in order}
        order += [(0, name) for name in sorted(compressors.words) if name not in ranked]
        for at in range(0, len(order), compared):
            for saved, name in order[at : at + compared]:
                template, must = compressors.words[name], compressors.deciding[name]
                # What the block has of the template in any order is a bound on what it has in order.
                if not must <= held.keys() or (Counter(template) & held).total() / len(template) < confirmed:
                    continue
                found = confirm(template, must, block, confirmed)
                if found and (best is None or (len(found[0]), -len(template)) < best[0]):
                    best = ((len(found[0]), -len(template)), name, saved, *found)
            if best:
                break
        if best is None:
            return out
        out.append(best[1:4])
        gone = set(best[4])
        block = [w for k, w in enumerate(block) if k not in gone]
    return out


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_blocks, licenses (names, sorted, comma-joined, no doubles), n_exact (notices without any difference),
    n_found, bytes_saved, wording (all differences, joined) for every row. Null and empty texts have no blocks."""
    chosen = templates or TEMPLATES

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = Compressors(chosen)
        for batch in sliced(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                parts = blocks(text or "")
                found = [x for part in parts for x in licenses(part, compressors)]
                rows.append((
                    len(parts), ",".join(sorted({x[0] for x in found})), sum(not x[2] for x in found), len(found),
                    sum(x[1] for x in found), ";".join(f"{x[0]}: {' '.join(x[2])}" for x in found if x[2]),
                ))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            names = ["doc_id", "n_blocks", "licenses", "n_exact", "n_found", "bytes_saved", "wording"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        find, f"doc_id {kind}, n_blocks bigint, licenses string, n_exact bigint, n_found bigint, bytes_saved bigint, wording string"
    )

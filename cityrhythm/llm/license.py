"""Licence notices by conditional compression.

Passages that share word triples with a template are candidate blocks. Each is
compressed alone and with every template as a raw Zstandard dictionary; the
templates are ranked by how much of the size they save, and in that order
confirmed, or not, by the exact differences in wording.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Hits at most so many words apart are of one block.
GAP = 8
#: Share of a template's words that must be there, and of a block's words that may be none of it.
LEAST_FOUND, MOST_OTHER = 0.8, 0.3
LEVEL = 19

# Short notices and licence texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}

SCHEMA = ("start int, n_words int, template string, plain_size int, given_size int, reduction double, found int, missing int, "
          "other int, differences array<string>, confirmed boolean")


def word_list(text: bytes) -> list[str]:
    buf = np.frombuffer(text, np.uint8)
    s, e, _, _ = tx.words(buf, np.array([0, len(buf)]), tx.ALNUM)
    low = tx._LOWER[buf]
    return [low[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist())]


def confirmed(own: list[str], found: int, size: int) -> bool:
    """Whether ``found`` of a template's words in a passage of ``size`` are enough."""
    return found >= LEAST_FOUND * len(own) and size - found <= MOST_OTHER * size


def around(own: list[str], words: list[str]) -> tuple[int, int, int] | None:
    """Start, end and words found of a confirmed passage around a run of three words or more, the longest first, if there is one."""
    extra = int(len(own) * MOST_OTHER / (1 - MOST_OTHER))
    places: dict[tuple, list[int]] = {}
    for i in range(len(own) - 2):
        places.setdefault(tuple(own[i:i + 3]), []).append(i)
    runs = []
    for j in range(len(words) - 2):
        for i in places.get(tuple(words[j:j + 3]), ()):
            if not i or not j or own[i - 1] != words[j - 1]:
                k = next((k for k, (x, y) in enumerate(zip(own[i:], words[j:])) if x != y), min(len(own) - i, len(words) - j))
                runs.append((-k, j, i))
    for k, j, i in sorted(runs):
        k, lo, hi = -k, max(0, j - i - extra), j + len(own) - i + extra
        # backwards on the left, so that of equal words the nearest ones are taken
        left = difflib.SequenceMatcher(None, own[:i][::-1], words[lo:j][::-1], autojunk=False).get_matching_blocks()
        right = difflib.SequenceMatcher(None, own[i + k:], words[j + k:hi], autojunk=False).get_matching_blocks()
        same = [(j - m.b - m.size, m.size) for m in reversed(left) if m.size] + [(j, k)] + [(j + k + m.b, m.size) for m in right if m.size]
        best = None
        for x in range(len(same)):
            found = 0
            for at, size in same[x:]:
                found += size
                a, b = same[x][0], at + size
                if confirmed(own, found, b - a):
                    best = max(best or (0,), (found, a - b, -a))
        if best:
            return -best[2], -best[2] - best[1], best[0]
    return None


class Templates:
    """Templates as word lists, compressors with each as dictionary, and their word triples."""

    def __init__(self, texts: Mapping[str, str]):
        self.words = {k: word_list(v.encode()) for k, v in sorted(texts.items())}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(
            " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items()}
        triples = []
        for v in texts.values():
            buf = np.frombuffer(v.encode(), np.uint8)
            _, _, h, first = tx.words(buf, np.array([0, len(buf)]), tx.ALNUM)
            triples.append(tx.shingles(h, first, 3, short=False)[0])
        self.triples = np.unique(np.concatenate(triples)) if triples else np.zeros(0, np.uint64)
        longest = max((len(w) for w in self.words.values()), default=1)
        #: Words of a part; from a part's start, notices that begin among so many words lie in it whole.
        self.longest = 2 * longest
        self.whole = self.longest - int(longest / (1 - MOST_OTHER))

    def judge(self, words: list[str]) -> tuple:
        """The best template that is confirmed, or else the best: place and size of the passage that is compared with it, then the rest of a row.

        The passage reaches from the first word that the template has, in order, to the last; if that isn't
        confirmed, it is looked for around each run of words that both have.
        """
        data = " ".join(words).encode()
        plain = len(self.alone.compress(data))
        ranked = sorted(((1 - len(c.compress(data)) / plain, k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))
        had, best = Counter(words), None
        for saved, name in ranked:
            own = self.words[name]
            # no passage has more of the template's words than the block
            few = (had & self.counts[name]).total() < LEAST_FOUND * len(own)
            if few and best:
                continue
            same = [m for m in difflib.SequenceMatcher(None, own, words, autojunk=False).get_matching_blocks() if m.size]
            a, b = (same[0].b, same[-1].b + same[-1].size) if same else (0, len(words))
            found = sum(m.size for m in same)
            if not few and not confirmed(own, found, b - a):
                a, b, found = around(own, words) or (a, b, found)
            ok = confirmed(own, found, b - a)
            if best and not ok:
                continue
            ops = difflib.SequenceMatcher(None, own, words[a:b], autojunk=False).get_opcodes()
            diff = [x for op, i1, i2, j1, j2 in ops if op != "equal" for x in
                    ([f"-{' '.join(own[i1:i2])}"] if i2 > i1 else []) + ([f"+{' '.join(words[a + j1:a + j2])}"] if j2 > j1 else [])]
            row = (a, b - a, name, plain, round(plain * (1 - saved)), saved, found, len(own) - found, b - a - found, diff, ok)
            if ok:
                return row
            best = row
        return best

    def notices(self, words: list[str]) -> list[tuple]:
        """Rows of a block: its confirmed passages, in order, or else its best template."""
        out, todo, first = [], [(0, words)], None
        while todo and self.words:
            at, part = todo.pop()
            row = self.judge(part)
            first = first or row
            if row[-1]:
                a, b = row[0], row[0] + row[1]
                out.append((at + a, *row[1:]))
                todo += [(x, w) for x, w in ((at, part[:a]), (at + b, part[b:])) if len(w) >= 3]
        return sorted(out) or [first][:bool(first)]


def blocks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Word ranges from the word indices of hits (triples)."""
    for part in np.split(at, np.flatnonzero(np.diff(at) > GAP) + 1):
        yield int(part[0]), int(part[-1]) + 3


def walk(n: int, t: Templates, notices: Callable[[int, int], list[tuple]]) -> list[tuple]:
    """Rows of a block of ``n`` words, places from its start; ``notices`` gives those of a range of it.

    A longer block is taken in parts that overlap by the largest passage that can be confirmed. A confirmed
    passage is taken from the part in whose first words it starts, and the next part goes on behind it. A part of
    the block, end to end, that no confirmed passage reaches into gives its best template.
    """
    if n <= t.longest:
        return notices(0, n)
    out, at = [], 0
    while at < n:
        end = min(at + t.longest, n)
        own = [(at + r[0], *r[1:]) for r in notices(at, end) if r[-1] and (end == n or r[0] < t.whole)]
        out += own
        at = n if end == n else max([at + t.whole, *(r[0] + r[1] for r in own)])
    reached = {k for r in out for k in range(r[0] // t.longest, (r[0] + r[1] - 1) // t.longest + 1)}
    for a in range(0, n, t.longest):
        if a // t.longest not in reached:
            out += [(a + r[0], *r[1:]) for r in notices(a, min(a + t.longest, n))]
    return sorted(out)


def _scan(texts: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen = Templates(texts), {}
        for batch in batches:
            at_row, rows = [], []
            for row, _, buf, off in tx.texts(batch["text"]):
                s, e, h, first = tx.words(buf, off, tx.ALNUM)
                triples, at = tx.shingles(h, first, 3, short=False)
                k = np.minimum(np.searchsorted(t.triples, triples), max(len(t.triples) - 1, 0))
                at = at[t.triples[k] == triples] if len(t.triples) else at[:0]
                owner = np.searchsorted(first, at, "right") - 1
                for r in np.unique(owner).tolist():
                    for a, b in blocks(at[owner == r]):
                        def notices(i, j, a=a):
                            words = tuple(tx._LOWER[buf[x:y]].tobytes().decode("utf-8", "replace") for x, y in zip(s[a + i:a + j].tolist(), e[a + i:a + j].tolist()))
                            if words not in seen:
                                if len(seen) > 10_000:
                                    seen.clear()
                                seen[words] = t.notices(list(words))
                            return seen[words]

                        for found in walk(b - a, t, notices):
                            at_row.append(row + r)
                            rows.append((a - int(first[r]) + found[0], *found[1:]))
            at_row = pa.array(at_row, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(),
                     pa.list_(pa.string()), pa.bool_())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.record_batch([batch["id"].take(at_row), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))],
                                  names=["id", *names])
    return run


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows for the candidate blocks of each document: id_col and ``SCHEMA``.

    A block gives a row for each notice in it that is confirmed, or one row,
    unconfirmed, if none is.

    ``start`` and ``n_words`` place the passage that is like the template among the text's words
    (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased). The template is the best
    by size saved that the wording confirms, or else, unconfirmed, the best by
    size saved; ties go to the name that sorts first. ``found`` and ``missing``
    count its words, ``other`` the passage's words that are none of it, and
    ``differences`` lists them (- missing, + other). A block longer than twice
    the longest template is taken in parts of that length, which overlap so that
    each notice lies whole in one; every such length of it that no confirmed
    notice reaches into gives an unconfirmed row. Null and empty texts give no
    rows; rows that are repeated give theirs again.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(tx.trimmed(_scan(dict(templates))), f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)

"""License scans by conditional compression.

Candidate blocks are windows of words about as long as a template, around the
template's longest words; so many of these are looked for that no text with the
asked share of the template lacks all of them. Each window is compressed with
zstd alone and with the template as a raw dictionary, and ranked by the bytes
saved against those that the template saves of itself. The winners are compared
word by word, which confirms them: what they lack, add or have otherwise. Last,
whole blocks of lines with such words go the same way, which finds notices with
very many words between their own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

# Public license notices and texts. A word in angle brackets stands for any words.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "rights-reserved": "Copyright <year holder>. All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
           "conditions and the following disclaimer.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                      "or (at your option) any later version.",
}

_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
_PLACED = re.compile(r"[A-Za-z0-9]+(?:[.'-][A-Za-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Templates as compressors and word lists."""

    def __init__(self, templates: dict[str, str], level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level)
        self.words = {k: words(re.sub(r"<[^>]*>", " ", t)) for k, t in templates.items()}
        self.given = {k: zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(
            " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, w in self.words.items() if w}
        self.own = {k: self.gain(self.words[k], k)[0] for k in self.given}
        self._cues: dict[float, dict[str, list[tuple[str, int]]]] = {}

    def cues(self, share: float) -> dict[str, list[tuple[str, int]]]:
        """Word -> (template, place in it). What has ``share`` of a template's words in order lacks at most the
        others, so one more of its words than those, the longest, are enough to find it."""
        if share not in self._cues:
            out = defaultdict(list)
            for k in self.given:
                t = self.words[k]
                n = len(t) - max(math.ceil(share * len(t) - 1e-9), 1) + 1
                for i in sorted(range(len(t)), key=lambda i: (-len(t[i]), t[i], i))[:n]:
                    out[t[i]].append((k, i))
            self._cues[share] = dict(out)
        return self._cues[share]

    def share_saved(self, block: list[str], name: str) -> float:
        """Bytes that a template saves of a block, as a share of those that it saves of itself; 1 if that is nothing."""
        return self.gain(block, name)[0] / self.own[name] if self.own[name] > 0 else 1.0

    def gain(self, block: list[str], name: str) -> tuple[int, float]:
        """Bytes and share of the block's compressed size that a template saves."""
        raw = " ".join(block).encode()
        alone = len(self.plain.compress(raw))
        given = len(self.given[name].compress(raw))
        return alone - given, 1 - given / alone

    def ranked(self, block: list[str], least: float) -> list[tuple[float, str]]:
        """(share saved, template) of those that save ``least`` or more of what they save of themselves, best first."""
        raw = " ".join(block).encode()
        alone = len(self.plain.compress(raw))
        gains = ((alone - len(c.compress(raw)), k) for k, c in self.given.items())
        return sorted(((g / alone, k) for g, k in gains if g >= least * self.own[k]), key=lambda g: (-g[0], g[1]))

    def differences(self, block: list[str], name: str) -> tuple[float, list[str]]:
        """Share of the template's words that the block has in order, and what differs between first and last of them."""
        t = self.words[name]
        ops = [o for o in SequenceMatcher(None, t, block, autojunk=False).get_opcodes()]
        same = sum(b - a for op, a, b, _, _ in ops if op == "equal")
        while ops and ops[0][0] == "insert":
            ops = ops[1:]
        while ops and ops[-1][0] == "insert":
            ops = ops[:-1]
        diff = [f"-{' '.join(t[a:b])}+{' '.join(block[c:d])}" for op, a, b, c, d in ops if op != "equal"]
        return same / len(t), diff


def blocks(text: str, at: list[int], gap: int = 3) -> list[tuple[int, int]]:
    """(start, end) of runs of lines that hold one of the places ``at`` and are ``gap`` lines apart at most."""
    ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
    out, last = [], None
    for n in sorted({bisect_left(ends, a) for a in at}):
        if last is not None and n - last <= gap:
            out[-1] = (out[-1][0], ends[n])
        else:
            out.append((ends[n - 1] + 1 if n else 0, ends[n]))
        last = n
    return out


def windows(held: list[str], m: Matcher, share: float, extra: int) -> list[tuple[str, int, int]]:
    """(template, first, end) of the candidates: each reaches ``extra`` words beyond the template on both sides of a cue."""
    cues, cells = m.cues(share), set()
    step = max(extra, 1)
    for i, w in enumerate(held):
        for name, place in cues.get(w, ()):
            cells.add((name, max(i - place - extra, 0) // step))
    return [(k, c * step, min((c + 1) * step + len(m.words[k]) + 2 * extra, len(held))) for k, c in sorted(cells)]


def found_in(held: list[str], m: Matcher, least: float, share: float, extra: int) -> list[tuple[float, str, int, int]]:
    """(share saved, template, first, last word) of occurrences in the windows that compression ranks at ``least`` or more."""
    tried = ((m.share_saved(held[low:high], name), name, low, high) for name, low, high in windows(held, m, share, extra))
    out: dict[tuple[str, int, int], float] = {}
    for saved, name, low, high in sorted((t for t in tried if t[0] >= least), key=lambda t: (-t[0], *t[1:])):
        for places in occurrences(held[low:high], m, name, share, extra):
            out.setdefault((name, low + places[0], low + places[-1]), saved)
    return [(saved, *place) for place, saved in out.items()]


def occurrences(block: list[str], m: Matcher, name: str, share: float, extra: int) -> list[list[int]]:
    """Positions of the words that each occurrence of a template has in order, with ``extra`` words between them at most."""
    t, has = m.words[name], Counter(m.words[name])
    size, need, held = len(t) + extra, share * len(t), Counter(block)
    if sum(min(n, held[w]) for w, n in has.items()) < need:
        return []
    own = np.fromiter((w in has for w in block), bool, len(block))
    total = np.concatenate([[0], np.cumsum(own)])
    ends = np.minimum(np.arange(len(block)) + size, len(block))
    out, best, past = [], None, 0
    for i in np.flatnonzero(own & (total[ends] - total[:-1] >= need)).tolist():
        if best and i > best[1][0] + extra:
            out.append(best[1])
            best, past = None, best[1][-1] + 1
        if i < past:
            continue
        window = block[i:i + size]
        held = Counter(window)
        if sum(min(n, held[w]) for w, n in has.items()) < need:
            continue
        places = _places(t, window, i)
        if len(places) >= need:
            rank = (len(places), places[0] - places[-1])
            if not best or rank > best[0]:
                best = (rank, places)
    return out + [best[1]] if best else out


def _places(t: list[str], block: list[str], at: int = 0) -> list[int]:
    same = SequenceMatcher(None, t, block, autojunk=False).get_matching_blocks()
    return [at + x.b + k for x in same for k in range(x.size)]


def scan_text(text: str | None, m: Matcher, least: float, share: float, extra: int = 24) -> list[dict]:
    """Confirmed licenses of a text: at each place the best template, and all others with words of their own."""
    text = text or ""
    cues, lowered = m.cues(share), text.lower()
    if not any(c in lowered for c in cues):
        return []
    placed = [(x[0].lower(), x.start(), x.end()) for x in _PLACED.finditer(text)]
    all_words, starts = [x[0] for x in placed], [x[1] for x in placed]
    out, used = [], [False] * len(placed)
    found = [(m.gain(all_words[first:last + 1], name), name, first, last)
             for _, name, first, last in found_in(all_words, m, least, share, extra)]

    def add(name: str, share_saved: float, start: int, end: int, same: float, diff: list[str]) -> None:
        out.append({"license": name, "start": start, "end": end, "gain": round(share_saved, 6), "found": round(same, 6),
                    "differences": diff})

    for (_, saved), name, first, last in sorted(found, key=lambda f: (-f[0][0], f[1], f[2])):
        free = [i for i in range(first, last + 1) if not used[i]]
        left = [all_words[i] for i in free]
        same, diff = m.differences(left, name)
        if same >= share:
            places = [free[k] for k in _places(m.words[name], left)]
            for i in places:
                used[i] = True
            add(name, saved, starts[places[0]], placed[places[-1]][2], same, diff)
    for start, end in blocks(text, [s for w, s in zip(all_words, starts, strict=True) if w in cues]):
        left = [w for (w, s, e), u in zip(placed, used, strict=True) if not u and start <= s and e <= end]
        for saved, name in m.ranked(left, least) if left else ():
            same, diff = m.differences(left, name)
            if same >= share:
                add(name, saved, start, end, same, diff)
                left = _without(left, m.words[name])
    return sorted(out, key=lambda f: (f["start"], f["end"], f["license"]))


def _without(block: list[str], t: list[str]) -> list[str]:
    """The block's words that a template has not explained."""
    out, at = [], 0
    for x in SequenceMatcher(None, t, block, autojunk=False).get_matching_blocks():
        out += block[at:x.b]
        at = x.b + x.size
    return out + block[at:]


_FOUND = "array<struct<license:string,start:bigint,end:bigint,gain:double,found:double,differences:array<string>>>"


def _scan(templates: dict[str, str], least: float, share: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.float64()),
                               ("found", pa.float64()), ("differences", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(templates)
        for b in batches:
            rows = [scan_text(t.as_py(), m, least, share) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], [b.schema.names[0], "found"])
    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, least: float = 0.2, share: float = 0.9,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and ``found``, the licenses confirmed in it with place, saving and differences.

    A window is a candidate if the template, as dictionary, saves ``least`` or
    more of the bytes that it saves of itself. It is confirmed where its length
    and 24 words more have ``share`` of its words in order; each occurrence
    counts, and its place goes from its first word to its last. Whole blocks of
    lines are candidates by the same bar, with any number of words between;
    their place is the block. Words that a confirmed template explains are not
    used again. Templates may have any words (``read_templates`` takes them from
    a table); one without words matches nothing.

    Null and empty texts have none. Ids may be null or repeat; each row is
    scanned by itself. No rows give no rows. Other columns are not read.
    """
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(_scan(templates or TEMPLATES, least, share), f"`{id_col}` {kind}, found {_FOUND}")


def read_templates(templates: DataFrame, most: int = 5000, *, name_col: str = "license", text_col: str = "text") -> dict[str, str]:
    """Templates by name from a table of ``most`` rows at most; more are an error, as every task holds them all.

    Of rows that share a name the smallest text counts. Rows without name or text give none.
    """
    rows = templates.filter(F.col(name_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(name_col).alias("k")).agg(
        F.min(text_col).alias("t")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} templates")
    return {r.k: r.t for r in rows}


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"),
        F.array_join(F.flatten("found.differences"), "|").alias("differences"))

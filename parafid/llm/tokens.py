"""Token ids of whole texts, found unit by unit.

A unit is a stretch of text that no token goes over the end of. Units repeat, so
those of a run of texts are made distinct first, each worker keeps the ids of
short ones (two tables of bounded size), and only new ones go to the tokenizer.
Long texts are cut between units and worked on in parts.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from .common import by_size

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark spreads the work over cores

#: Units kept by a worker (twice as many at most), the longest one that is kept, and characters worked on at a time.
KEPT, LONGEST, PART = 1 << 18, 64, 1 << 21
#: White space, of which word tokenizers keep nothing.
WHITE = re.compile(r"[\x20\x09-\x0D]+")
#: A single space between characters that are not white: byte-level tokenizers start a token there.
SPACE, DOUBLE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")
#: Letters of Latin words: ASCII and the precomposed ones up to U+024F, but for one that lowers to two characters.
LETTERS = "".join(c for c in map(chr, range(65, 0x250)) if c.isalpha() and c not in "\xaa\xba\u0130")
#: ASCII marks but the apostrophe, which contractions begin with.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: A unit of a Latin word and marks.
PLAIN = re.compile(f"([{LETTERS}]+)([{re.escape(MARKS)}]*)")
#: What byte-level tokenizers write for each byte: itself if it is printable Latin-1, else the next character from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def parts(text: str, cut: re.Pattern, limit: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, without the matches of ``cut`` between them."""
    at = 0
    while len(text) - at > limit and (m := cut.search(text, at + limit)):
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


def at_white(texts: list[str]) -> pa.ListArray:
    """Each text cut at WHITE."""
    return pc.ascii_split_whitespace(pa.array(texts, pa.string()))


def at_spaces(texts: list[str]) -> pa.ListArray:
    """Each text cut at SPACE."""
    got = [t.split(" ") if not (t[:1].isspace() or t[-1:].isspace() or DOUBLE.search(t)) else SPACE.split(t) for t in texts]
    ends = list(accumulate(map(len, got), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(got)), pa.string()))


class Memo:
    """Values of units; ``find`` gives those of new ones. Units that stay unused go when two tables are full."""

    def __init__(self, find: Callable[[list[str]], list], most: int = KEPT, longest: int = LONGEST):
        self.find, self.most, self.longest, self.now, self.before = find, most, longest, {}, {}

    def of(self, units: list[str]) -> list:
        """Values of distinct units."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        out = list(map(now.get, units))
        for i, v in enumerate(out):
            if v is None and (v := before.get(units[i])) is not None:
                out[i] = now[units[i]] = v
        new = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(new, self.find([units[i] for i in new]), strict=True):
            out[i] = v
            if len(units[i]) <= self.longest:
                now[units[i]] = v
        return out


def as_bytes(lists: list[list[int]]) -> list[bytes]:
    """Each list as little-endian 32-bit numbers."""
    flat = np.fromiter(chain.from_iterable(lists), "<u4").tobytes()
    ends = list(accumulate((4 * len(x) for x in lists), initial=0))
    return [flat[s:e] for s, e in pairwise(ends)]


def _spread(units: pa.ListArray, index: pa.Array, values: list[bytes]) -> list[np.ndarray]:
    """Ids of each list of units, from those of the distinct ones."""
    ends = np.fromiter(accumulate(map(len, values), initial=0), np.int64) // 4
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4"))).take(index)
    at, flat = ids.offsets.to_numpy()[units.offsets.to_numpy()].tolist(), ids.values.to_numpy()
    return [flat[s:e] for s, e in pairwise(at)]


def ids_of(texts: list[str], cut: re.Pattern, split: Callable[[list[str]], pa.ListArray], memo: Memo, width: int) -> list[list[np.ndarray]]:
    """For each of the ``width`` values that ``memo`` has for a unit, the ids of each text."""
    out: list[list[list[np.ndarray]]] = [[[] for _ in texts] for _ in range(width)]
    cut_up = ((i, p) for i, t in enumerate(texts) for p in parts(t, cut))
    for run in by_size(cut_up, lambda x: len(x[1]), PART):
        units = split([p for _, p in run])
        d = units.values.dictionary_encode()
        found = memo.of(d.dictionary.to_pylist())
        for k in range(width):
            for (i, _), ids in zip(run, _spread(units, d.indices, [v[k] for v in found]), strict=True):
                out[k][i].append(ids)
    return [[x[0] if len(x) == 1 else np.concatenate(x) for x in of] for of in out]


def byte_level(word: str) -> str:
    """The word as a byte-level tokenizer hands it to its model."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LEVEL)


def _plain_words(tokenizer) -> bool:
    """Whether the tokenizer lowers Latin words and hands each to its model as one word of bytes, and marks behind it as another."""
    def one(u: str, *want: str) -> bool:
        made = tokenizer.normalizer.normalize_str(u) if tokenizer.normalizer else u
        return [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(made)] == list(want)
    ends = LETTERS[:26]
    return (all(one(a + b + m, (a + b).lower(), m) for a in ends for b in ends for m in ("!", ".,", ":;?!"))
            and all(one(x + y + m, byte_level((x + y).lower()), m) for x in LETTERS for y, m in (("a", "!"), ("\xe9", "#.")))
            and all(one("a" + m + n, "a", m + n) for m in MARKS for n in MARKS) and one(LETTERS + MARKS, byte_level(LETTERS.lower()), MARKS))


def word_ids(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by a tokenizer that drops white space; no special tokens are added, and none may hold white space."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[bytes]:
        return as_bytes([e.ids for run in by_size(texts, len, PART) for e in tokenizer.encode_batch_fast(run, add_special_tokens=False)])

    def spell(words: list[str]) -> list[bytes]:
        return as_bytes([[t.id for t in tokenizer.model.tokenize(byte_level(w))] for w in words])

    inner, model = Memo(spell), _plain_words(tokenizer)

    def find(units: list[str]) -> list[tuple[bytes]]:
        words, others = {}, []
        for u in units:
            m = PLAIN.fullmatch(u) if model and len(u) <= LONGEST else None
            if m:
                words[u] = (m[1].lower(), m[2])
            else:
                others.append(u)
        got = dict(zip(others, encode(others), strict=True))
        names, marks = (list({w[k] for w in words.values()}) for k in (0, 1))
        ids, mark = dict(zip(names, inner.of(names), strict=True)), dict(zip(marks, encode(marks), strict=True))
        got.update((u, ids[w] + mark[m]) for u, (w, m) in words.items())
        return [(got[u],) for u in units]

    memo = Memo(find)
    return lambda texts: ids_of(texts, WHITE, at_white, memo, 1)[0]


@contextmanager
def no_cycles():
    """Without cycle collection, which would walk through all kept units again and again; nothing here makes cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def row_keys() -> Iterator[int]:
    """Numbers that no other row of the job has; a task that runs again gives the same ones."""
    at = TaskContext.get().partitionId() << 40
    while True:
        yield at
        at += 1


_MADE: dict[tuple, object] = {}


def once_a_worker(make: Callable, *args):
    """``make(*args)``, kept for later tasks of this worker; the last two are kept."""
    if (make, args) not in _MADE:
        while len(_MADE) > 1:
            del _MADE[next(iter(_MADE))]
        _MADE[make, args] = make(*args)
    return _MADE[make, args]

"""Alignment of the tokens of two tokenizers, and how often their ids meet.

Both tokenizers spell the same bytes, so each gives an array of byte ends. They
are walked together: at the current shift between the two indexes, stretches of
equal ends (one token each) are compared in steps that double while they match
and are halved where they do not, so a stretch is jumped in a few comparisons.
Where the ends differ, the smaller one is moved on until both meet; that group
has several tokens on a side, and the shift behind it is the new one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, by_size, small_batches
from .registry import query, table
from .tokens import PART, SPACE, Memo, as_bytes, at_spaces, ids_of, no_cycles, once_a_worker, row_keys

#: Id pairs whose counts every task holds; the counts of all others are joined. Any number gives the same result.
HELD_PAIRS = 1 << 16


# ---------------------------------------------------------------- two tokenizers
def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(odd)}}


class Both:
    """Ids of ' ' + text by a byte-level tokenizer, and of text by a sentence piece model that adds the space."""

    def __init__(self, byte_path: str, piece_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a, self.b = Tokenizer.from_file(byte_path), SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        code = byte_level()
        added = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.bytes_a = [added[i].encode() if i in added else bytes(code[c] for c in t) for i, t in enumerate(names)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.memo = Memo(self._find)

    def _find(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of ' ' + unit by both; the model adds the space itself."""
        out = []
        for run in by_size(units, len, PART):
            a = self.a.encode_batch_fast([" " + u for u in run], add_special_tokens=False)
            out += zip(as_bytes([e.ids for e in a]), as_bytes(self.b.encode(run, num_threads=1)), strict=True)
        return out

    def _same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both spell ' ' + ``text``."""
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == f" {text}".encode() == b"".join(map(self.bytes_b.__getitem__, b.tolist()))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of A, ids of B) of each text; none if the text is empty or one of them does not spell it."""
        ids = ids_of(texts, SPACE, at_spaces, self.memo, 2)
        return [(a, b) if t and self._same(t, a, b) else (a[:0], b[:0]) for t, a, b in zip(texts, *ids, strict=True)]


# ------------------------------------------------------------------- the walk
def walk(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], list[int], list[int]]:
    """Two arrays of ends that finish alike: stretches (i, j, p, q) in order, and links inside groups (places in A, in B).

    p = q > 0: p tokens from i on each end where those from j on do, and link with them.
    Otherwise p is negative, and -p tokens of A from i and q of B from j are one group.
    """
    out, la, lb, i, j, n = [], [], [], 0, 0, len(a)
    while i < n:
        start, step = i, 1
        while i < n and a[i:i + step] == b[j:j + step]:
            i, j, step = min(i + step, n), min(j + step, len(b)), step * 2
        while step > 1 and i < n:
            step //= 2
            if a[i:i + step] == b[j:j + step]:
                i, j = min(i + step, n), min(j + step, len(b))
        if i > start:
            out.append((start, j - (i - start), i - start, i - start))
        if i < n:
            p, q, x, y = i, j, a[i], b[j]
            while x != y:
                la.append(p)
                lb.append(q)
                if x < y:
                    p += 1
                    x = a[p]
                else:
                    q += 1
                    y = b[q]
            la.append(p)
            lb.append(q)
            p, q = p + 1, q + 1
            out.append((i, j, i - p, q - j))
            i, j = p, q
    return out, la, lb


def _expand(runs: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Of the stretches: sizes of all groups on both sides, and the places of tokens that link one to one."""
    i, j, p, q = np.array(runs, np.int64).reshape(-1, 4).T
    even = p > 0
    times = np.where(even, p, 1)
    size_a, size_b = np.repeat(np.where(even, 1, -p), times), np.repeat(np.where(even, 1, q), times)
    one = times[even]
    step = np.arange(one.sum()) - np.repeat(np.cumsum(one) - one, one)
    return size_a, size_b, np.repeat(i[even], one) + step, np.repeat(j[even], one) + step


@cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, one row each with room for a sign behind, and how many there are."""
    text = [str(k).encode() for k in range(n)]
    width = max(map(len, text)) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


def spelled(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> bytes:
    """The groups as text: ``a1,a2|b1;a3|b2,b3``."""
    if not len(a):
        return b""
    groups = np.arange(len(size_a))
    side = np.concatenate([np.repeat(2 * groups, size_a), np.repeat(2 * groups + 1, size_b)])
    order = np.argsort(side, kind="stable")
    ids, side = np.concatenate([a, b])[order], side[order]
    digits, width = _digits(int(ids.max() | 0xFFFF) + 1)
    text, size = digits[ids], width[ids]
    last = np.concatenate([side[1:] != side[:-1], [True]])
    text[np.arange(len(ids)), size] = np.where(last, np.where(side % 2 == 0, ord("|"), ord(";")), ord(","))
    return text[np.arange(text.shape[1]) <= size[:, None]].tobytes()[:-1]


_LINKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))


def _align(byte_path: str, piece_path: str, tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, keys = once_a_worker(Both, byte_path, piece_path), row_keys()
        for b in batches:
            at = 0
            for part in by_size([t.as_py() or "" for t in b.column(1)], len, PART):  # what is held grows with a few texts only
                yield rows(both, keys, b.column(0).slice(at, len(part)), part)
                at += len(part)

    def rows(both: Both, keys: Iterator[int], ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        counts, digest, more, links = [], [], [], []
        with no_cycles():
            encoded = both.encode(texts)
        for x, y in encoded:
            runs, la, lb = walk(np.cumsum(both.size_a[x]).tolist(), np.cumsum(both.size_b[y]).tolist())
            size_a, size_b, ia, ib = _expand(runs)
            la, lb = (np.concatenate([np.array(u, np.int64), v]) for u, v in ((la, ia), (lb, ib)))
            links.append(np.unique(x[la].astype(np.int64) << 32 | y[lb], return_counts=True))
            counts.append((len(x), len(y), len(size_a), len(la)))
            text = spelled(x, y, size_a, size_b)
            digest.append(hashlib.sha256(text).hexdigest() if text else "")
            if tokens:
                more.append((x, y, size_a, size_b))
        pairs, times = (np.concatenate([v[k] for v in links]) for k in (0, 1))
        flat = pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (pairs >> 32, pairs & 0xFFFFFFFF, times)],
                                          fields=list(_LINKS.value_type))
        ends = np.cumsum([0] + [len(v[0]) for v in links])
        cols = [ids, pa.array([next(keys) for _ in texts], pa.int64()), *(pa.array(v, pa.int64()) for v in zip(*counts, strict=True)),
                pa.array(digest, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
        cols += [pa.array([m[k] for m in more], pa.list_(pa.int32())) for k in range(4)] if tokens else []
        return pa.RecordBatch.from_arrays(cols, _NAMES + _TOKENS * tokens)
    return run


_NAMES = ["id", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
_TOKENS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]


def align(docs: DataFrame, byte_path: str, piece_path: str, *, tokens: bool = True, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per document: its id, ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and ``links``.

    A is the byte-level tokenizer at ``byte_path`` on ' ' + text, B the sentence piece model at ``piece_path`` on the text;
    both files have the same path on all machines. ``links`` has (a, b, n): ids of tokens whose bytes overlap, and how
    often. With ``tokens`` also ``a_ids``, ``b_ids`` and ``a_sizes``, ``b_sizes``, the tokens of each group on either side.
    ``key`` tells rows apart.

    Texts that are null or empty, and those that a tokenizer does not spell byte for byte, have no tokens: counts are
    zero, arrays empty and the digest is ''. Ids may be null or repeat, and rows may repeat. No rows give no rows.
    Only the two named columns are read. A text is worked on in parts; a run without a space goes to the tokenizers whole.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = (f"id {d.schema[0].dataType.simpleString()}, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "links array<struct<a:int,b:int,n:int>>") + ", a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>" * tokens
    return d.mapInArrow(_align(byte_path, piece_path, tokens), kind).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold each linked id pair, and whether no other b has more of this a."""
    store = Store(aligned.sparkSession, "pairs")
    n = store.keep(aligned.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("docs")))
    most = n.groupBy("a").agg(F.max("docs").alias("most"))  # one row for each id of A's vocabulary
    return n.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """(key, count_sum, n_best) of rows with links: the sum of their pairs' counts, and links to the best b of their a.

    Most links are of few pairs: the counts of the ``held`` most frequent ones go to all tasks, and only links of other
    pairs are shuffled. What leaves a task of the former is one row for each document.
    """
    top = counts.orderBy(F.desc("docs"), "a", "b").limit(held)
    links = aligned.select("key", F.inline("links"))
    pair = [F.col("a").cast("long") * (1 << 32) + F.col("b")]
    near = links.select("key", pair[0].alias("pair"), "n").join(
        F.broadcast(top.select(pair[0].alias("pair"), "docs", "best")), "pair", "left")

    def total(df: DataFrame) -> DataFrame:
        return df.groupBy("key").agg(F.sum(F.col("n") * F.col("docs")).alias("count_sum"),
                                     F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    far = near.filter("docs is null").select("key", "pair", "n").join(
        counts.select(pair[0].alias("pair"), "docs", "best"), "pair")
    both = total(near.filter("docs is not null")).union(total(far))
    return both.groupBy("key").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    store = Store(spark, "alignment")
    got = store.keep(align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"), tokens=False))
    scores = link_scores(got, store.keep(pair_counts(got)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got.drop("links").join(scores, "key", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

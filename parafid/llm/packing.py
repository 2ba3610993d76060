"""Packing documents into sequences of a fixed number of tokens.

Documents are cut into pieces of the full length, which are sequences of their
own, and one shorter rest. Rests are dealt to groups by a hash of a row's key,
so no document, source or copy makes a group large, and each group is packed by
itself: first-fit decreasing, where a tournament tree over the bins' free places
(each node has the larger of its two below) leads to the first bin that a rest
fits into. Bins that stay too empty are then filled up with cuts of the rests in
the emptiest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, by_size, small_batches
from .registry import query, table
from .tokens import PART, no_cycles, once_a_worker, row_keys, word_ids

#: Tokens and rests of a group, about.
GROUP_TOKENS, GROUP_ROWS = 1 << 22, 1 << 16


# ----------------------------------------------------------------- one group
def first_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each size, largest sizes first (equal ones in order), each into the first bin with room."""
    leaves = 1
    while leaves < 2 * (int(sizes.sum()) // length + 1) + 1:  # two bins in a row hold more than one full
        leaves *= 2
    free = [length] * (2 * leaves)  # node k has the nodes 2k and 2k + 1 below it
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, k = int(sizes[i]), 1
        while k < leaves:
            k *= 2
            k += free[k] < size
        out[i] = k - leaves
        free[k] -= size
        while k > 1:
            k //= 2
            best = max(free[2 * k], free[2 * k + 1])
            if free[k] == best:
                break
            free[k] = best
    return out


def top_up(sizes: np.ndarray, bins: np.ndarray, length: int, least: float) -> list[tuple[int, int, int, int]]:
    """Pieces (place in ``sizes``, from, to, bin) after filling bins that are less than ``least`` full.

    The fullest of them take from the emptiest; a piece is cut where a bin is full.
    One bin at most stays below.
    """
    fill = np.bincount(bins, weights=sizes, minlength=1).astype(np.int64)
    low = [b for b in np.argsort(-fill, kind="stable").tolist() if 0 < fill[b] < least * length]
    move: dict[int, list] = {b: [] for b in low}
    out = []
    for i, (s, b) in enumerate(zip(sizes.tolist(), bins.tolist(), strict=True)):
        if b in move:
            move[b].append([i, 0, s])
        else:
            out.append((i, 0, s, b))
    take, give = 0, len(low) - 1
    while take < give:
        room, source = length - fill[low[take]], move[low[give]]
        if not room:
            take += 1
            continue
        if not source:
            give -= 1
            continue
        i, lo, hi = source.pop()
        n = int(min(room, hi - lo))
        out.append((i, lo, lo + n, low[take]))
        fill[low[take]] += n
        if lo + n < hi:
            source.append([i, lo + n, hi])
    return out + [(i, lo, hi, b) for b in low for i, lo, hi in move[b]]


def _pack(length: int, least: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("key")  # rows arrive in any order
        sizes = group["length"].to_numpy()
        cut = sorted(top_up(sizes, first_fit(sizes, length), length, least), key=lambda p: (p[3], p[0], p[1]))
        row, lo, hi, bins = np.array(cut, np.int64).reshape(-1, 4).T
        ends = np.cumsum(hi - lo)
        first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(bins)]])))
        offset = ends - (hi - lo)
        # a piece that begins inside a rest has no key of its own: no rest begins at its places
        key = group["key"].to_numpy()[row] + lo
        held = group["ids"].to_pylist()
        ids = pa.array([held[i][4 * s:4 * e] for i, s, e in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True)], pa.binary())
        out = {c: group[c].take(pa.array(row)) for c in group.column_names if c != "ids"}
        out |= {"start": pa.array(group["start"].to_numpy()[row] + lo), "length": pa.array(hi - lo), "ids": ids,
                "sequence_id": pa.array(key[first][of]), "offset": pa.array(offset - offset[first][of])}
        return pa.table({c: out[c] for c in _COLUMNS})
    return run


_COLUMNS = ("id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


# -------------------------------------------------------------------- pieces
def _cut(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, keys, end = once_a_worker(word_ids, path), row_keys(), np.array([end_id], np.int32)
        for b in batches:
            at = 0
            for texts in by_size([t.as_py() or "" for t in b.column(1)], len, PART):
                with no_cycles():
                    found = encode(texts)
                yield pieces(b.column(0).slice(at, len(texts)), [x for ids in found for x in (ids, end)], keys)
                at += len(texts)

    def pieces(ids: pa.Array, found: list[np.ndarray], keys: Iterator[int]) -> pa.RecordBatch:
        total = np.array([len(x) for x in found]).reshape(-1, 2).sum(1)
        count = -(-total // length)
        row = np.repeat(np.arange(len(total)), count)
        start = length * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
        size = np.minimum(length, total[row] - start)
        flat, ends = np.concatenate(found).astype("<u4", copy=False).tobytes(), (4 * np.cumsum(size)).tolist()
        held = pa.array([flat[s:e] for s, e in zip([0, *ends], ends, strict=False)], pa.binary())
        key = [next(keys) * length for _ in row]
        cols = [ids.take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (key, start, size, total[row])), held]
        return pa.RecordBatch.from_arrays(cols, ["id", "key", "start", "length", "doc_tokens", "ids"])
    return run


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 1, length: int = 2048, least_fill: float = 0.98,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens at most.

    ``tokenizer`` is the path, the same on all machines, of a ``tokenizers`` file
    whose tokens never go over white space. Per piece: the id, ``start`` (tokens of
    the document before it), ``length``, ``doc_tokens``, ``ids`` (little-endian 32-bit numbers),
    ``sequence_id`` and ``offset`` in the sequence, without gaps from 0. Each
    document ends with ``end_id`` and each of its ids lies in one piece. Rests are
    cut only to fill sequences that first-fit leaves below ``least_fill``.

    Null and empty texts are ``end_id`` alone. Ids may be null or repeat, and rows
    may repeat: each row is a document. No rows give no rows. Only the two named
    columns are read. ``sequence_id`` tells sequences apart and has no other meaning.
    """
    if length < 1 or length > 1 << 20:
        raise ValueError("a sequence has 1 to 2**20 tokens")
    small_batches(docs.sparkSession)
    store = Store(docs.sparkSession, "packing")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    pieces = store.keep(d.mapInArrow(_cut(tokenizer, end_id, length),
                                     f"id {kind}, key long, start long, length long, doc_tokens long, ids binary"))
    full = pieces.filter(F.col("length") == length).withColumn("sequence_id", F.col("key")).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < length)
    n, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, -(-tokens // GROUP_TOKENS), -(-n // GROUP_ROWS))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("group").applyInArrow(
        _pack(length, least_fill), f"id {kind}, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    both = full.select(*_COLUMNS).union(dealt)
    return both.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences of ``pack``, padded to ``length`` unless their size is a power of two."""
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    pad = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(length - F.col("n_tokens")).cast("int")
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return one.select("sequence_id", "n_tokens", F.concat(ids, F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), pad))).alias("ids"))


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    got = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

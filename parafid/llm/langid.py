"""Language identification of mixed-language text.

Words are runs of letters. The script of a word narrows its candidate
languages; hashed character n-grams give it a log-likelihood per candidate; and
a Viterbi pass with a penalty for each switch labels spans of words. A text's
language is the one that labels most of its letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size
from .registry import query, table

CELLS = 1 << 16
#: First code points of runs of one script; what follows 0x2E80 but Hangul is written without spaces.
SCRIPTS = (0x0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80,
           0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1380, 0x1780, 0x1800, 0x1E00, 0x1F00,
           0x2000, 0x2E80, 0x3040, 0x3100, 0xAC00, 0xD7B0, 0x10000)
#: Runs that belong to the script of an earlier one.
SAME = {0x250: 0x0, 0x1E00: 0x0, 0x1F00: 0x370, 0x1100: 0xAC00, 0x3100: 0x2E80}


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it part of a word (a letter or mark), is it a letter, its lower case, the number of its script."""
    word, letter, lower = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind in "LM":
            word[i], letter[i] = True, kind == "L"
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    script = (np.searchsorted(np.array(SCRIPTS), np.arange(0x110000), "right") - 1).astype(np.uint8)
    for run, of in SAME.items():
        script[script == SCRIPTS.index(run)] = SCRIPTS.index(of)
    return word, letter, lower, script


class Words:
    """Words and n-gram cells of several texts at once."""

    def __init__(self, texts: list[str]):
        word, letter, lower, script = _tables()
        code = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(sizes + 1) - sizes  # where each text starts
        is_word = word[code]
        before = np.concatenate([[False], is_word[:-1]])
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(~is_word & before)
        ahead = np.concatenate([[0], np.cumsum(letter[code])])
        self.letters = ahead[self.end] - ahead[self.start]
        self.text = np.searchsorted(self.base, self.start, "right") - 1
        self.script = script[code[self.start]]
        use = np.flatnonzero(is_word | before)  # each letter, and the place behind each word
        c = np.where(is_word, lower[code], np.uint32(0))
        c1 = np.concatenate([np.zeros(1, np.uint32), c[:-1]])
        c2 = np.where(c1 > 0, np.concatenate([np.zeros(2, np.uint32), c[:-2]]), np.uint32(0))
        a, b, d = (x[use] for x in (c, c1, c2))
        two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + np.uint32(1)
        three = two * np.uint32(0xC2B2AE3D) + d * np.uint32(0x27D4EB2F)
        self.cells = tuple(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64) for h in (two, three))
        self.first = np.searchsorted(use, self.start)  # of each word in cells

    def scores(self, logs: np.ndarray) -> np.ndarray:
        """(words, languages): summed log-likelihoods of each word's n-grams."""
        if not len(self.start):
            return np.zeros((0, logs.shape[1]), np.float32)
        return np.add.reduceat(logs[self.cells[0]] + logs[self.cells[1]], self.first, axis=0)


class Model:
    """``names``, ``logs`` (cells, languages) and ``scripts`` (scripts, languages): whether a language uses a script."""

    def __init__(self, names: list[str], logs: np.ndarray, scripts: np.ndarray):
        self.names, self.logs, self.scripts = names, logs, scripts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): n-gram cells, then CELLS + script for words of a script."""
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            n = counts.setdefault(lang, np.zeros(CELLS + len(SCRIPTS), np.int64))
            for run in by_size(texts, len, 1 << 20):
                w = Words(run)
                for cells in w.cells:
                    n += np.bincount(cells, minlength=len(n))
                n += np.bincount(CELLS + w.script.astype(np.int64), minlength=len(n))
    for lang, n in counts.items():
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(n[cells])],
                                         ["lang", "cell", "n"])


def train(docs: DataFrame, *, sample_docs: int = 20_000, smoothing: float = 0.5, script_share: float = 0.005,
          lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model of the labelled rows of ``docs``, from about ``sample_docs`` rows of each language at most.

    Rows are taken by a hash of id and text, so the sample is the same in each run. Rows
    without text or language are passed over. The driver gets one table of
    CELLS numbers per language.
    """
    d = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
                    F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).filter("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang"))
             .agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    share = F.lit(1.0)
    for k in names:
        if sizes[k] > sample_docs:
            share = F.when(F.col("lang") == k, F.lit(sample_docs / sizes[k])).otherwise(share)
    d = d.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")
    sums = d.mapInArrow(_count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    n = np.zeros((CELLS + len(SCRIPTS), len(names)))
    got = sums.toPandas()  # CELLS + scripts rows of each language at most
    n[got["cell"].to_numpy(np.int64), np.searchsorted(names, got["lang"].to_numpy(str))] = got["n"]
    grams, words = n[:CELLS], n[CELLS:]
    logs = np.log((grams + smoothing) / (grams.sum(0) + smoothing * CELLS)).astype(np.float32)
    return Model(names, logs, words > script_share * words.sum(0))


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """Best language of each word, by its text, when each switch costs ``penalty``.

    All texts go forward together, one word at a time; ``text`` is ascending.
    """
    k = scores.shape[1]
    size = np.bincount(text, minlength=n_texts)
    first = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    size, first = size[order], first[order]
    label = np.zeros(len(scores), np.int64)
    if not len(order):
        return label
    best_before = np.zeros(len(scores), np.int16)  # the best language at the word before
    switch = np.zeros((len(scores), k), bool)
    now = scores[first].astype(np.float64)
    active = len(order) - np.searchsorted(size[::-1], np.arange(size[0]), "right")  # texts longer than t words
    ends = np.empty(len(order), np.int64)
    for t in range(1, int(size[0])):
        m = active[t]
        if m < len(now):
            ends[m:len(now)] = now[m:].argmax(1)
            now = now[:m]
        at = first[:m] + t
        best = now.argmax(1)
        other = now[np.arange(m), best][:, None] - penalty
        moved = other > now
        best_before[at], switch[at] = best, moved
        now = np.where(moved, other, now) + scores[at]
    ends[:len(now)] = now.argmax(1)
    here = ends.copy()
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        label[at] = here[:m]
        here[:m] = np.where(switch[at, here[:m]], best_before[at], here[:m])
    return label


def label_words(texts: list[str], model: Model, penalty: float) -> tuple[Words, np.ndarray]:
    w = Words(texts)
    s = w.scores(model.logs)
    allowed = model.scripts[w.script]
    allowed |= ~allowed.any(1, keepdims=True)  # a script that no language uses narrows nothing
    s = np.maximum(s - np.where(allowed, s, -np.inf).max(1, keepdims=True), -30.0) if len(s) else s
    s = np.where(allowed, s, -60.0)
    return w, viterbi(s, w.text, len(texts), penalty)


def spans_of(w: Words, label: np.ndarray, k: int, names: list[str]) -> list[dict]:
    """Runs of words of one language of text ``k``: lang, start and end in code points."""
    own = np.flatnonzero(w.text == k)
    out: list[dict] = []
    for i in own:
        s, e, name = int(w.start[i] - w.base[k]), int(w.end[i] - w.base[k]), names[label[i]]
        if out and out[-1]["lang"] == name:
            out[-1]["end"] = e
        else:
            out.append({"lang": name, "start": s, "end": e})
    return out


def _predict(model: Model, penalty: float, with_spans: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit, k = max(1 << 16, (1 << 21) // max(len(model.names), 1)), len(model.names)  # characters at once
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            pred, score, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            # texts of like length go forward together
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]), reverse=True) if k else []
            for rows in by_size(order, lambda i: len(texts[i]), limit):
                w, label = label_words([texts[i] for i in rows], model, penalty)
                letters = np.zeros((len(rows), k))
                np.add.at(letters, (w.text, label), w.letters)
                total, best = letters.sum(1), letters.argmax(1)
                share = (letters.max(1) / np.maximum(total, 1)).tolist()
                for j, i in enumerate(rows):
                    if total[j]:
                        pred[i], score[i] = model.names[best[j]], share[j]
                    if with_spans:
                        spans[i] = spans_of(w, label, j, model.names)
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if with_spans:
                new.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
            n = b.num_columns if with_text else b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *new], [*b.schema.names[:n], "lang_pred", "score", "spans"][:n + len(new)])
    return run


def identify(docs: DataFrame, model: Model, *, penalty: float = 12.0, with_spans: bool = False, with_text: bool = False,
             id_cols=("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: the ``id_cols``, ``lang_pred``, ``score`` and, if asked for, ``spans`` and the text (as ``text``).

    ``score`` is the share of the text's letters in words labelled ``lang_pred``;
    ties go to the first name. A null text, one without letters, and any text
    under a model without languages are ``und`` with score 0. Only the text is
    looked at; ids may be null or repeat. No rows give no rows.
    """
    d = docs.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema[:-1])
    sql = head + "lang_pred string, score double" + ", spans array<struct<lang:string,start:bigint,end:bigint>>" * with_spans
    if not with_text:
        return d.mapInArrow(_predict(model, penalty, with_spans, False), sql)
    return d.mapInArrow(_predict(model, penalty, with_spans, True), sql.replace("lang_pred string,", "_text string, lang_pred string,")
                        ).withColumnRenamed("_text", "text")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

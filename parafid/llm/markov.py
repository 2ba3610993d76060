"""Secret scans: patterns, and Markov models of random strings against ordinary identifiers.

Two character models (first order, with a start state) are trained from labelled
samples taken from the whole corpus: what the patterns find is labelled random,
all other tokens are labelled ordinary. Transitions are counted per batch,
summed by Spark, and only the sums (a table of fixed size) reach the driver. A
long token, whatever its characters, is a secret when its log-likelihood ratio
is high enough, in all and per character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

# The patterns of the base spans and the least length of what they must hold.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Characters that the models know; 0 is what stands before the first one of a word. Signs that join words (+/_=-) are 0 too:
#: they count for neither model, so what is ordinary word by word is ordinary when joined.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
STATES = len(ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, STATES)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns find, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _ordinary(text: str, counts: np.ndarray) -> None:
    """Adds the transitions of all tokens."""
    code = _CODE[np.frombuffer(text.encode(), np.uint8)]
    before = np.concatenate([[0], code])[:-1]
    use = code > 0
    counts += np.bincount(before[use] * STATES + code[use], minlength=STATES * STATES)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, ordinary, random): transition counts of a partition."""
    plain, odd = (np.zeros(STATES * STATES, np.int64) for _ in range(2))
    for b in batches:
        held, size = [], 0
        for t in b.column(0):
            text, at, rest = t.as_py() or "", 0, []
            for kind, start, end in base_spans(text):
                found = text[start:end]
                tokens = _TOKEN.findall(ASSIGN.match(found)[2] if kind == "assign" else found)
                for token in tokens:
                    code = _CODE[np.frombuffer(token.encode(), np.uint8)]
                    np.add.at(odd, np.concatenate([[0], code[:-1]]) * STATES + code, 1)
                if end > at:
                    rest.append(text[at:max(start, at)])
                    at = end
            held.append(" ".join([*rest, text[at:]]))
            size += len(held[-1])
            if size > 1 << 20:
                _ordinary(" ".join(held), plain)
                held, size = [], 0
        _ordinary(" ".join(held), plain)
    cells = np.flatnonzero(plain + odd)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(plain[cells]), pa.array(odd[cells])], ["cell", "plain", "odd"])


def train(docs: DataFrame, *, uniform: tuple[float, float] = (0.001, 0.5), text_col: str = "text") -> np.ndarray:
    """log P(random) - log P(ordinary) of each transition, from all rows of ``docs``.

    Both models mix their counts with a uniform choice of the next character:
    ``uniform`` is its share in the ordinary and in the random one (high there,
    because samples of one alphabet stand for random strings over any).
    """
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_count, "cell long, plain long, odd long")
    sums = parts.groupBy("cell").agg(F.sum("plain").alias("plain"), F.sum("odd").alias("odd"))
    plain, odd = (np.zeros((STATES, STATES)) for _ in range(2))
    for r in sums.collect():  # STATES squared rows at most
        plain.flat[r.cell], odd.flat[r.cell] = r.plain, r.odd

    return ratios(plain, odd, uniform)


def ratios(plain: np.ndarray, odd: np.ndarray, uniform: tuple[float, float] = (0.001, 0.5)) -> np.ndarray:
    """The log-likelihood ratios that transition counts give.

    Ordinary words may stand in capitals: half of what follows a capital goes by
    the small letters. One in twenty small letters may end a word that the next
    joins with its capital (camel case). The first character of a word counts within its kind
    (capital, small letter, digit), so numbers beside words are no evidence.
    """
    big, small = slice(1, 27), slice(27, 53)
    plain, like = plain.copy(), plain[small, small]
    plain[big, big] += like * plain[big].sum(1, keepdims=True) / np.maximum(like.sum(1, keepdims=True), 1)
    plain[small, big] += plain[small].sum(1, keepdims=True) / 20 * plain[:1, big] / max(plain[0, big].sum(), 1)

    def logs(n: np.ndarray, share: float) -> np.ndarray:
        total, flat = n.sum(1, keepdims=True), 1 / n.shape[1]
        return np.log(np.where(total > 0, (1 - share) * n / np.maximum(total, 1) + share * flat, flat))

    out = np.zeros((STATES, STATES))
    out[1:, 1:] = logs(odd[1:, 1:], uniform[1]) - logs(plain[1:, 1:], uniform[0])
    for kind in (big, small, slice(53, STATES)):
        out[:1, kind] = logs(odd[:1, kind], uniform[1]) - logs(plain[:1, kind], uniform[0])
    return out


def random_spans(text: str, ratios: np.ndarray, least: int, total: float, mean: float) -> list[tuple[int, int]]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{%d,}" % least, text):
        code = _CODE[np.frombuffer(m[0].encode(), np.uint8)]
        score = ratios[np.concatenate([[0], code[:-1]]), code].sum()
        if score >= max(total, mean * len(code)):
            out.append(m.span())
    return out


def find_secrets(text: str | None, ratios: np.ndarray, least: int = 16, total: float = 12.0, mean: float = 0.5):
    """(base spans, all spans) of a text; spans of the models that touch a base span are left out."""
    text = text or ""
    base = base_spans(text)
    more = [("random", s, e) for s, e in random_spans(text, ratios, least, total, mean)
            if not any(s < y and x < e for _, x, y in base)]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(ratios: np.ndarray, options: dict, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(b.num_columns - 1):
                text = t.as_py()
                base, spans = find_secrets(text, ratios, **options)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans),
                             redact(text, spans) if with_text and text is not None else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 3
            new = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"][:5 + with_text]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new[:len(names)]], [*b.schema.names[:-1], *names])
    return run


_SQL = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, ratios: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text",
         with_text: bool = False, **options) -> DataFrame:
    """Per document: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (and ``clean_text``).

    ``spans`` lists kind:start:end in code points, end exclusive, by start and
    kind: what the patterns find, and what only the models find (``random``).
    ``clean_text`` has each span replaced. ``options``: least (token length),
    total and mean (log-likelihood ratio, in all and per character).

    Null text counts as empty (its ``clean_text`` is null). Ids may be null or
    repeat; each row is scanned by itself. No rows give no rows, and models of
    ratio 0 that add nothing. Other columns are not read.
    """
    if ratios is None:
        ratios = train(docs, text_col=text_col)
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(_scan(ratios, options, with_text), f"`{id_col}` {kind}, {_SQL}" + ", clean_text string" * with_text)


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

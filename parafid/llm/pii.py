"""Personal data: candidate spans judged by gradient-boosted trees.

Loose generators propose spans of four kinds, which may overlap. Strict patterns
with their checks (octets, Luhn, digit counts) give the base spans, which always
stay, and the labels of all candidates. Boosted trees learn format and
context from them, without seeing the checks; a threshold per kind is set
on held-out candidates; candidates above it that touch no base span are added,
the most probable first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store
from .registry import query, table

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Lookbehinds and the way emails are searched only avoid repeated scans.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Loose generators.
_AT = re.compile(r"@|\x20?[(\[]at[)\]]\x20?")
_USER = re.compile(r"[^\s@<>()\[\]{},;:\"']+\Z")
_HOST = re.compile(r"[^\s@<>()\[\]{},;:\"'#$%&*!]{2,255}")
_LOOSE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,5}(?:[.][0-9]{1,5}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|\(|00|0)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
}
_CUES = (re.compile(r"(?:e-?mail|contact|write|from|to|reply)\W*\Z", re.I), re.compile(r"(?:ip|host|server|address|addr)\W*\Z", re.I),
         re.compile(r"(?:card|visa|credit|iban|payment|account)\W*\Z", re.I),
         re.compile(r"(?:phone|tel|call|mobile|fax|number|no)\W*\Z", re.I))
FEATURES = ("email", "ip", "card", "phone", "length", "digits", "digit_share", "letters", "groups", "longest_group",
            "first_group", "last_group", "separators", "kinds_of_separator", "spaces", "dots", "plus", "parens", "distinct",
            "at", "domain_labels", "last_label", "before", "behind", "cue_email", "cue_ip", "cue_card", "cue_phone")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _AT.finditer(text):
        user = _USER.search(text, max(0, m.start() - 64), m.start())
        host = _HOST.match(text, m.end())
        if user and host:
            out.append(("email", user.start(), host.start() + len(host[0].rstrip(".-_"))))
    for kind, pattern in _LOOSE.items():
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def _side(text: str, i: int) -> int:
    """0 none, 1 white, 2 letter, 3 digit, 4 other."""
    if not 0 <= i < len(text):
        return 0
    c = text[i]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    sep = re.findall(r"[^0-9A-Za-z]", s)
    before = text[max(0, start - 24):start]
    domain = s.rpartition("@")[2].split(".") if "@" in s else []
    return [*(float(kind == k) for k in KINDS), len(s), len(digits), len(digits) / max(len(s), 1), sum(c.isalpha() for c in s),
            len(groups), max(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
            len(sep), len(set(sep)), s.count(" "), s.count("."), float(s[:1] == "+"), s.count("(") + s.count(")"),
            len(set(digits)), s.count("@"), len(domain), len(domain[-1]) if domain else 0, _side(text, start - 1), _side(text, end),
            *(float(bool(c.search(before))) for c in _CUES)]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column(0).to_pylist():
            base = {}
            for k, s, e in base_spans(t):
                base.setdefault(k, set()).update(((s, 0), (e, 1)))
            for kind, s, e in candidates(t):
                hit = base.get(kind, ())
                rows.append({"kind": kind, "label": float((s, 0) in hit and (e, 1) in hit), "features": features(t, kind, s, e),
                             "fold": int.from_bytes(hashlib.sha256(t[max(0, s - 20):e].encode()).digest()[:4], "big")})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("label", pa.float64()), (
                "features", pa.list_(pa.float64())), ("fold", pa.int64())]))


class Trees:
    """Boosted trees as plain arrays, and the probability from which a kind is redacted."""

    def __init__(self, trees: list[tuple[float, dict]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for weight, t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(t["depth"]):
                f = t["feature"][at]
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= t["cut"][at]
                at = np.where(f < 0, at, np.where(low, t["left"][at], t["right"][at]))
            margin += weight * t["value"][at]
        return 1 / (1 + np.exp(-2 * margin))


def _arrays(node) -> dict:
    """A fitted tree's nodes as arrays; feature -1 marks a leaf."""
    out: dict = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def add(n, depth: int) -> tuple[int, int]:
        at, leaf = len(out["feature"]), n.subtreeDepth() == 0
        for k, v in zip(out, (-1 if leaf else n.split().featureIndex(), 0.0 if leaf else n.split().threshold(), at, at,
                              n.prediction()), strict=True):
            out[k].append(v)
        if leaf:
            return at, depth
        out["left"][at], a = add(n.leftChild(), depth + 1)
        out["right"][at], b = add(n.rightChild(), depth + 1)
        return at, max(a, b)

    depth = add(node, 0)[1]
    return {**{k: np.array(v) for k, v in out.items()}, "depth": depth}


_CANDIDATE = "kind string, label double, features array<double>, fold long"


def _probabilities(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.probability(x)), b.column(3)],
                                                 ["kind", "label", "p", "n"])
    return run


def train(docs: DataFrame, *, trees: int = 12, depth: int = 4, precision: float = 0.98, seed: int = 5,
          text_col: str = "text") -> Trees | None:
    """Trees fitted to the candidates of all documents; candidates with equal features and label are one row with a weight.

    A quarter of the candidates is held out, by a hash of their text. A kind's threshold is the least probability from
    which held-out candidates are right with ``precision``; a kind without such a point adds nothing.
    Without both labels among the candidates there are no trees, and base spans alone.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9]{2}|@"))
    got = d.mapInArrow(_samples, _CANDIDATE).groupBy("kind", "label", "features", (F.col("fold") % 4 == 0).alias("held"))
    got = Store(spark, "pii").keep(got.agg(F.count("*").cast("double").alias("n")))
    fit = got.filter("not held")
    if fit.select("label").distinct().count() < 2:
        return None
    # few partitions for few rows; they grow with the rows
    frame = fit.select("label", "n", array_to_vector("features").alias("features"))
    frame = frame.repartition(max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), fit.count() // 20_000)), F.xxhash64("features"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.3, checkpointInterval=-1, weightCol="n").fit(frame)
    out = Trees([(w, _arrays(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True)], {})
    test = got.filter("held").select("kind", "label", "features", "n").mapInArrow(
        _probabilities(out), "kind string, label double, p double, n double")
    sums = test.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("y"), F.sum("n").alias("n"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    good = sums.select("kind", "p", (F.sum("y").over(down) / F.sum("n").over(down)).alias("right")).filter(F.col("right") >= precision)
    out.thresholds.update({r.kind: r.p for r in good.groupBy("kind").agg(F.min("p").alias("p")).collect()})
    return out


def find(text: str | None, model: Trees | None):
    """(base spans, all spans) of a text, by kind and start."""
    text = text or ""
    base = base_spans(text)
    more = [c for c in candidates(text) if c[0] in model.thresholds] if model else []
    more = [c for c in more if not any(c[1] < e and s < c[2] for _, s, e in base)]
    if more:
        p = model.probability(np.array([features(text, *c) for c in more]))
        taken: list[tuple[str, int, int]] = []
        for i in np.lexsort((np.array([c[1] for c in more]), -p)):
            c = more[i]
            if p[i] >= model.thresholds[c[0]] and not any(c[1] < e and s < c[2] for _, s, e in taken):
                taken.append(c)
        more = taken
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(model: Trees | None):
    names = ["n_" + k for k in KINDS] + ["base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, spans = find(t.as_py(), model)
                rows.append((*(sum(k == x for x, _, _ in base) for k in KINDS),
                             hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            new = [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], [b.schema.names[0], *names])
    return run


def scan(docs: DataFrame, model: Trees | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans`` (all).

    Spans are kind:start:end in code points, end exclusive, by kind and start.
    Null text counts as empty. Ids may be null or repeat; each row is scanned by
    itself. No rows give no rows. Other columns are not read.
    """
    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = d.schema[0].dataType.simpleString()
    return d.mapInArrow(_scan(model), f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                      "base_sha256 string, spans string")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))

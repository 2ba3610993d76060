"""Packing, cross-tokenizer alignment and importance resampling against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from parafid.llm import alignment, packing, resampling, tokens

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "alpha beta, gamma. delta " * 60_000
#: Signs that tokenizers treat specially: special tokens as text, control and white characters, marks, scripts, forms.
ODD = ["", " ", "  two  spaces ", "\n\ttabs\r\nand\x0blines \n x", "<|endoftext|> a <|startoftext|>x <s></s><unk>", "don't we'll I'M. O'Neil's,x",
       "\x00null\x1cunit\x1fsep", "́acute áb é É İstanbul ΣΑΣ. ǅ", "你好，世界。 今天 天气", "مرحبا بالعالم", "a b c　d\u0085e", "½² x². Ⅷ!",
       "▁piece ▁▁", "<0x41> <0x0A>", "🙂🙃.🙂 👩‍👩‍👧", "x" * 3000, "..,,;;::!!??", ",a .b !c", "ａｂｃ ﬁ", "a.b,c;d:e!f?g", "Ünï.cödé, straße! œuvre?", "1234.5 3,14 a1.b2"]
CLASH = "_text string, text string, id long, key long, doc_id long, n long, a int, bucket int, score double, rank long, ids string, group int, length int"


def frame(spark, rows):
    return spark.createDataFrame([("x", t, 1, 2, i, 3, 4, 5, .5, 6, "y", 7, 8) for i, t in rows], CLASH)


def mixed(n, seed):
    rng = random.Random(seed)
    pool = [u for t in ODD for u in (t, t.strip())] + ["the", "a", "Thing", "word.", "x,y", "\n", "  "]
    return ["".join(rng.choice(pool)[:40] + rng.choice([" ", " ", "", "\n", "  "]) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


EDGES = [(1, None), (2, ""), (None, "the cat sat on the mat"), (4, LONG), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (6, " \n\t"),
         *((100 + i, t) for i, t in enumerate(ODD)), (7, "nospace" * 30_000)]


# -------------------------------------------------------------------- encoding
def test_word_ids_unit_by_unit():
    from tokenizers import Tokenizer
    plain, encode = Tokenizer.from_file(WORD), tokens.word_ids(WORD)
    texts = ODD + mixed(3000, 1) + [LONG]
    for t, got in zip(texts, encode(texts), strict=True):
        assert got.tolist() == plain.encode(t, add_special_tokens=False).ids, t[:200]


def plain_tokens(text, a, b, both):
    x = a.encode(" " + text, add_special_tokens=False).ids if text else []
    y = b.encode(text) if text else []
    sx, sy = [both.bytes_a[i] for i in x], [both.bytes_b[i] for i in y]
    return (x, y, sx, sy) if b"".join(sx) == b"".join(sy) == (" " + text).encode() and text else ([], [], [], [])


@pytest.fixture(scope="module")
def two():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE), alignment.Both(BYTE, PIECE)


def test_both_ids_unit_by_unit(two):
    a, b, both = two
    texts = ODD + mixed(3000, 2) + [LONG]
    for t, (x, y) in zip(texts, both.encode(texts), strict=True):
        assert (x.tolist(), y.tolist()) == plain_tokens(t, a, b, both)[:2], t[:200]


def test_memo_gives_the_same_when_it_forgets():
    memo = tokens.Memo(lambda us: [u.upper() for u in us], most=5, longest=3)
    rng = random.Random(3)
    for _ in range(200):
        us = list({"abcdefghijklmnop"[k:k + rng.randrange(1, 6)] for k in (rng.randrange(12) for _ in range(4))})
        assert memo.of(us) == [u.upper() for u in us]
        assert len(memo.now) <= 5 + 4 and all(len(u) <= 3 for u in memo.now)


# --------------------------------------------------------------------- packing
def test_first_fit_by_hand():
    rng = np.random.default_rng(5)
    for n, cap in ((0, 8), (1, 8), (200, 8), (500, 100)):
        sizes = rng.integers(1, cap, n)
        bins, want = [], {}
        for i in np.argsort(-sizes, kind="stable").tolist():
            k = next((k for k, free in enumerate(bins) if free >= sizes[i]), len(bins))
            bins += [cap] if k == len(bins) else []
            bins[k] -= sizes[i]
            want[i] = k
        assert packing.first_fit(sizes, cap).tolist() == [want[i] for i in range(n)]


def test_top_up_fills():
    sizes = np.array([1100] * 50 + [3] * 7)
    cut = packing.top_up(sizes, packing.first_fit(sizes, 2048), 2048, 0.98)
    fill, parts = Counter(), defaultdict(list)
    for i, lo, hi, b in cut:
        fill[b] += hi - lo
        parts[i].append((lo, hi))
    assert sum(f < 0.98 * 2048 for f in fill.values()) <= 1 and max(fill.values()) <= 2048
    for i, p in parts.items():
        p.sort()
        assert p[0][0] == 0 and p[-1][1] == sizes[i] and all(x[1] == y[0] for x, y in zip(p, p[1:], strict=False))


def check_packed(rows, want, length):
    """Rows cover the ids of each document (a multiset of them: rows may repeat), and sequences have no gaps."""
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for i, docs in want.items():
        got = Counter((r.start, r.doc_tokens) for r in by[i])
        total = Counter()
        for r in by[i]:
            total[r.doc_tokens] += r.length
            assert any(len(d) == r.doc_tokens and d[r.start:r.start + r.length] == np.frombuffer(r.ids, "<u4").tolist() for d in docs)
        assert total == Counter({n: n * c for n, c in Counter(map(len, docs)).items()}) and sum(got.values()) == len(by[i])
    for p in seq.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= length
    assert set(by) == set(want)
    return seq


@pytest.mark.parametrize("length", [2048, 16])
def test_packing_edges(spark, length):
    from tokenizers import Tokenizer
    plain, want = Tokenizer.from_file(WORD), defaultdict(list)
    rows = [e for e in EDGES if length > 16 or len(e[1] or "") < 5000]
    for i, t in rows:
        want[i].append(plain.encode(t or "", add_special_tokens=False).ids + [1])
    got = packing.pack(frame(spark, rows).repartition(3), WORD, length=length)
    found = got.collect()
    seq = check_packed(found, want, length)
    total = sum(len(d) for ds in want.values() for d in ds)
    assert len(seq) * length - total < 2 * length
    whole = packing.sequences(got, length, 9).collect()
    assert sum(r.n_tokens for r in whole) == total
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens.bit_count() == 1 else length) for r in whole)
    assert packing.pack(frame(spark, []), WORD).count() == 0


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(WORD)
    rows = defaultdict(list)
    for r in packing.op11_packing(spark, sf_dir).collect():
        rows[r.doc_id].append(r)
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = np.array(plain.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        got = sorted(rows.pop(d.doc_id), key=lambda r: r.start)
        assert [r.start for r in got] == [sum(x.length for x in got[:k]) for k in range(len(got))] and sum(r.length for r in got) == len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in got)
    assert not rows


# ------------------------------------------------------------------- alignment
def plain_alignment(texts, two):
    out, count = [], Counter()
    for t in texts:
        x, y, sx, sy = plain_tokens(t or "", *two)
        ax, ay = np.cumsum([len(s) for s in sx]).tolist(), np.cumsum([len(s) for s in sy]).tolist()
        p, links, groups, (i0, j0) = 0, Counter(), [], (0, 0)
        ranges = [(s - len(b), s) for s, b in zip(ay, sy, strict=True)]
        for i, (s, b) in enumerate(zip(ax, sx, strict=True)):
            while p and ranges[p - 1][1] > s - len(b):
                p -= 1
            k = p
            while k < len(y) and ranges[k][0] < s:
                if ranges[k][1] > s - len(b):
                    links[x[i], y[k]] += 1
                k += 1
            p = max(k - 1, 0)
            if s in set(ay):
                j1 = ay.index(s) + 1
                groups.append(",".join(map(str, x[i0:i + 1])) + "|" + ",".join(map(str, y[j0:j1])))
                i0, j0 = i + 1, j1
        count.update(links.keys())
        out.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(n, m, g, sum(li.values()), sum(v for p, v in li.items() if count[p] == best[p[0]]), sum(v * count[p] for p, v in li.items()), s)
            for n, m, g, li, s in out]


def test_walk_against_sets():
    rng = np.random.default_rng(9)
    for n in (1, 2, 30, 300):
        for share in (0.05, 0.5, 0.95, 1.0):
            last = 4 * n
            common = rng.random(last) < share
            a, b = (sorted({*np.flatnonzero(common | (rng.random(last) < 0.3)).tolist(), last}) for _ in range(2))
            runs, la, lb = alignment.walk(a, b)
            size_a, size_b, ia, ib = alignment._expand(runs)
            assert np.cumsum(size_a).tolist() == [a.index(e) + 1 for e in sorted(set(a) & set(b))]
            assert np.cumsum(size_b).tolist() == [b.index(e) + 1 for e in sorted(set(a) & set(b))]
            union = sorted({*a, *b})
            want = {(int(np.searchsorted(a, e)), int(np.searchsorted(b, e))) for e in union}
            got = [*zip(la, lb, strict=True), *zip(ia.tolist(), ib.tolist(), strict=True)]
            assert set(got) == want and len(got) == len(want)


def test_alignment_edges(spark, two):
    small = [(i, t) for i, t in EDGES if len(t or "") < 5000] + [(900 + k, t) for k, t in enumerate(mixed(60, 4))]
    d = frame(spark, small).repartition(3)
    got = alignment.align(d, BYTE, PIECE)
    scores = {r.key: r for r in alignment.link_scores(got, alignment.pair_counts(got), held=20).collect()}
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, scores[r.key].n_best if r.key in scores else 0,
                    scores[r.key].count_sum if r.key in scores else 0, r.groups_sha256) for r in got.collect()))
    want = sorted((i if i is not None else -1, *w) for (i, _), w in zip(small, plain_alignment([t for _, t in small], two), strict=True))
    assert rows == want
    for r in got.collect():
        assert sum(r.a_sizes) == len(r.a_ids) == r.n_a and sum(r.b_sizes) == len(r.b_ids) == r.n_b and len(r.a_sizes) == len(r.b_sizes) == r.n_groups
    assert alignment.align(frame(spark, []), BYTE, PIECE).count() == 0
    long = alignment.align(frame(spark, [(1, LONG), (2, "nospace" * 30_000)]), BYTE, PIECE, tokens=False).collect()
    assert all(r.n_a > 10_000 for r in long)


def test_alignment_query(spark, sf_dir, two):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.op12_token_alignment(spark, sf_dir).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, plain_alignment([r.text for r in docs], two), strict=True)}


# ------------------------------------------------------------------ resampling
def plain_resample(docs, target, least, most, buckets, percent=10, least_words=20):
    def of(text):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(words) - n + 1)]
    s, t = Counter(b for _, x in docs for b in of(x)), Counter(b for x in target for b in of(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        f, h = of(x), int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return sorted(([*r, None][:5] for r in rows), key=str)


@pytest.mark.parametrize(("least", "most", "buckets"), [(1, 1, 10_000), (1, 3, 50), (2, 2, 999)])
def test_resampling_edges(spark, least, most, buckets):
    docs = EDGES + [(1000 + k, t * 3) for k, t in enumerate(mixed(80, 5))] + [(5, "the cat sat on the mat " * 9)] * 3
    target = [None, "", "the cat sat on the mat", "the cat", "Wörter und words"]
    items = spark.createDataFrame([(t, 1, "z") for t in target], "text string, key int, id string")
    got = resampling.resample(frame(spark, docs).repartition(3), items, least=least, most=most, buckets=buckets, percent=50).collect()
    want = plain_resample(docs, target, least, most, buckets, percent=50)
    strip = lambda rows: sorted(([*r] for r in rows), key=str)
    assert strip(map(tuple, got)) == want
    none = items.limit(0)
    assert resampling.resample(frame(spark, []), items).count() == 0
    assert strip(map(tuple, resampling.resample(frame(spark, docs[:9]), none).collect())) == plain_resample(docs[:9], [], 1, 1, 10_000)


def test_parts_do_not_change_features():
    text = " ".join(f"w{k % 37}" for k in range(5000))
    split = resampling.word_split()
    want = [" ".join(text.split()[i:i + n]) for n in (2, 3) for i in range(5001 - n)]
    old = tokens.parts.__defaults__
    tokens.parts.__defaults__ = (100,)
    try:
        assert Counter(resampling.features(text, split, 2, 3)) == Counter(want)
    finally:
        tokens.parts.__defaults__ = old


def test_ranks_of_equal_scores(spark):
    rows = spark.range(0, 5000).select((F.col("id") % 3).alias("score"), F.when(F.col("id") % 7 > 0, F.lit(4)).alias("id"), F.col("id").alias("key"))
    got = {r.key: r["rank"] for r in resampling.ranked(rows, 16).collect()}
    want = sorted(rows.collect(), key=lambda r: (-r.score, r.id is None, r.key))
    assert got == {r.key: k + 1 for k, r in enumerate(want)}

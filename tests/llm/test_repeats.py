"""Divergence, repeated byte strings and periodic runs against brute force and SQL, and on odd tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_corpus import SCHEMA, SF, odd_rows

from confluo.llm import divergence, periodic_runs, queries, suffix_dedup

text_of = lambda r: tuple(map(str, r))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_divergence(rows, least=10, top=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = "".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in (text or "").translate(fold)).split(" ")
        words = [w for w in words if w]
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        profile = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        mine = {s: profile(counts[x, s]) for x, s in groups if x == lang}
        whole = profile(sum((counts[g] for g in groups if g[0] == lang), collections.Counter()))
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in mine.items():
            pairs = [(-sum(apart(p[w], q[w]) for w in kept), o.encode()) for o, q in mine.items() if o != s]
            terms = [(-apart(p[w], whole[w]), w.encode()) for w in kept if counts[lang, s][w] and p[w] > whole[w]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, w.decode(), -v, k + 1) for k, (v, w) in enumerate(items)]
    return sorted(out)


def found_divergence(df, **kw):
    return sorted(map(tuple, divergence.divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()))


def test_divergence(spark, odd, none, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = brute_divergence(list(zip(t["text"], t["lang"], t["source"])))
    assert found_divergence(docs) == want
    duckdb.register("documents", pa.table(t))
    assert sorted(duckdb.sql(f"select lang, source, part, item, value, rank from ({queries.OP11_SQL})").fetchall()) == want
    # Small blocks, chunks and buckets: cells with two blocks, several chunks, ranges and sums of parts.
    for name, value in (("BLOCK", 3), ("TERMS", 7), ("RANGE", 2), ("HELD", 500), ("LOOSE", 300), ("CELLS", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert found_divergence(docs) == want
    rows = [(r[1], r[2], r[3]) for r in odd_rows()]
    for least in (1, 2, 10):
        assert found_divergence(odd, least_docs=least) == brute_divergence(rows, least)
    assert found_divergence(none) == []


def test_shares_are_exact():
    n, total = np.array([0, 1, 2, 9, 10**12, 3 * 10**15], np.int64), 4 * 10**15
    for terms in (1, 7, 10**6):
        got = divergence.shares(n, np.int64(total), np.int64(terms)).tolist()
        assert got == [1 + 10**9 * (int(x) + 2) // (total + 2 * terms) for x in n]
    assert divergence.shares(np.array([5]), np.int64(5), np.int64(1)).tolist() == [1 + 10**9]


def brute_repeats(rows, window=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=text_of)


def found_repeats(df, **kw):
    return sorted(map(tuple, suffix_dedup.dedup_repeats(df, texts=False, **kw).collect()), key=text_of)


def patchwork(seed):
    """Texts out of pieces of a few passages, around a window's length, some with one letter changed; repeats of one letter."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.randint(80, 300))) for _ in range(8)]
    rows = []
    for k in range(40):
        parts = []
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            a = r.randrange(len(b))
            p = b[a : a + r.choice([300, 395, 399, 400, 401, 410, 450, 480, 700, 1500])]
            if p and r.random() < 0.5:
                q = r.randrange(len(p))
                p = p[:q] + "X" + p[q + 1 :]
            parts += [p, " ".join(word() for _ in range(r.randint(0, 40)))]
        rows.append((k if r.random() < 0.9 else None, "".join(parts)))
    more = ["a" * 1000, "a" * 500 + "b", "ab" * 300, None, "", "xyz " * 180, "q" * 399, "q" * 400, "q" * 400]
    return rows + [(100 + k, t) for k, t in enumerate(more)] + [(200, base[0])] * 3 + [(None, base[1])] * 2


def test_suffix_dedup(spark, odd, none, monkeypatch):
    for seed in range(2):
        rows = patchwork(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert found_repeats(df) == brute_repeats(rows)
    # Blocks of a few documents, many buckets and an exchange of two levels; another window.
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    monkeypatch.setattr(suffix_dedup.X, "buckets_for", lambda d: 30)
    monkeypatch.setattr(suffix_dedup.X, "COARSE", 8)
    assert found_repeats(df) == brute_repeats(rows)
    assert found_repeats(df, window=230) == brute_repeats(rows, 230)
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.dedup_repeats(df, window=205)
    assert found_repeats(odd) == brute_repeats([r[:2] for r in odd_rows()])
    assert found_repeats(none) == []


def test_suffix_dedup_outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    assert found_repeats(docs) == brute_repeats(list(zip(t["doc_id"], t["text"])))
    texts = dict(zip(t["doc_id"], t["text"]))
    for r in suffix_dedup.dedup_repeats(docs).where("n_removed > 0").collect():
        left, end = b"", 0
        for s in r.spans:
            left, end = left + texts[r.doc_id].encode()[end : s.start], s.start + s.bytes
        assert bytes(r.kept) == left + texts[r.doc_id].encode()[end:] and len(r.spans) == r.n_spans


def brute_passages(rows, window, passage):
    """What ``brute_repeats`` finds for a window, with the bytes that passages cover."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    pairs = zip(sorted(brute_repeats(numbered, window)), sorted(brute_repeats(numbered, passage)))
    return sorted(((rows[a[0]][0], *a[1:], b[2]) for a, b in pairs), key=text_of)


def test_short_passages(spark, odd, none, monkeypatch, tmp_path):
    """Passages of 51 to 60 words that stand in two texts are found though they are shorter than a window; removed bytes are the window's."""
    r = random.Random(12)
    words = lambda n: [("%06x" % r.getrandbits(24))[: r.randint(2, 6)] for _ in range(n)]
    rows, planted = [(k, " ".join(words(r.randint(0, 150)))) for k in range(60)], set()
    for k in range(0, 20, 2):
        passage = " ".join(words(r.randint(51, 60)))
        assert 206 <= len(passage) < 400
        for i in (k, k + 1):
            w = rows[i][1].split(" ")
            at = r.randint(0, len(w))
            rows[i] = (i, " ".join([*w[:at], passage, *w[at:]]))
            planted.add(i)
    pq.write_table(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), tmp_path / "documents.parquet")
    found = queries.op12_suffix_dedup(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in found if x.n_repeated} == planted and not any(x.n_removed for x in found)
    assert sorted(map(tuple, found), key=text_of) == brute_passages(rows, 400, 206)
    # One passage in many texts of a block, each with other neighbours, and in other blocks.
    common = " ".join(words(45))[:220]
    rows = patchwork(3) + [(300 + k, " ".join([*words(40), common, *words(40)])) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    for block, window, passage in ((suffix_dedup.BLOCK, 400, 206), (5000, 400, 300)):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        assert found_repeats(df, window=window, passage=passage) == brute_passages(rows, window, passage)
    assert dict(suffix_dedup.dedup_repeats(none, passage=206).dtypes)["doc_id"] == dict(none.dtypes)["doc_id"]
    assert found_repeats(odd, passage=206) == brute_passages([x[:2] for x in odd_rows()], 400, 206)
    for passage in (205, 401):
        with pytest.raises(ValueError, match="window"):
            suffix_dedup.dedup_repeats(df, passage=passage)


def test_merged_transforms():
    """Any shards: the merged order is that of the symbols, each suffix once, with the right common prefixes."""
    rnd = np.random.default_rng(3)
    for _ in range(200):
        shards = [rnd.integers(0, 3, rnd.integers(1, 30)).astype(np.uint64) for _ in range(rnd.integers(1, 4))]
        depth = int(rnd.integers(1, 5))
        shard, suffix, common = suffix_dedup.merge([suffix_dedup.transform(s, depth) for s in shards], depth)
        read = [tuple(np.roll(shards[a], -b)[np.arange(depth) % len(shards[a])].tolist()) for a, b in zip(shard, suffix)]
        assert read == sorted(read) and sorted(zip(shard.tolist(), suffix.tolist())) == [(a, b) for a, s in enumerate(shards) for b in range(len(s))]
        for a, b, n in zip(read, read[1:], common[1:]):
            assert n == next((k for k in range(depth) if a[k] != b[k]), depth)


def test_long_texts_and_pieces(monkeypatch):
    """Anchors and hashes of a text that is read in pieces are those of the whole."""
    r = random.Random(7)
    text = np.frombuffer(("".join(r.choice("abc \n") for _ in range(9000)) + "z" * 700).encode(), np.uint8)
    ends = np.array([50, 3000, 3000, len(text)])
    whole = suffix_dedup.anchors(text, ends)
    start = np.sort(np.array([r.randrange(len(text) - 400) for _ in range(300)]))
    marks = suffix_dedup.hashes(text, start, start + 400, 2)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(text, ends)))
    assert (marks == suffix_dedup.hashes(text, start, start + 400, 2)).all()
    for d, place, first, last in zip(*whole):
        assert first <= place and last - first < suffix_dedup.SPAN and place - first < suffix_dedup.SPAN and place < ends[d]


def brute_runs(words, least=6, times=4):
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def periodic(r):
    """A text of few words with powers, copies of them, and a tail that may repeat."""
    w = [r.choice("ab" if r.random() < 0.5 else "abc").encode() for _ in range(r.choice([0, 1, 5, 20, 60, 120]))]
    if len(w) > 3 and r.random() < 0.7:
        at = r.randrange(len(w))
        w[at:at] = w[: r.randint(1, 6)] * r.randint(2, 9)
        w = [*w, *[b"x"] * r.randint(0, 2), *w[r.randint(0, 5) :]] if r.random() < 0.6 else w * r.randint(1, 4)
    return w


def test_periodic_runs():
    r = random.Random(1)
    for _ in range(80):
        docs = [periodic(r) for _ in range(r.randint(1, 6))]
        for least, times in ((6, 4), (2, 2), (3, 3)):
            assert periodic_runs.runs_of(docs, least, times) == [brute_runs(d, least, times) for d in docs]


def test_blocks_are_lz_blocks():
    """The longest previous factors, and blocks that are each as long as that and reach the end."""
    r = random.Random(2)
    for _ in range(50):
        w = [r.choice("ab") for _ in range(r.randint(1, 40))]
        index = periodic_runs.Index(np.array([*map(ord, w), 0], np.int64))
        length, source = periodic_runs.previous_factors(index)
        for i in range(len(w)):
            best = max([next((n for n in range(len(w) - i) if w[j + n] != w[i + n]), len(w) - i) for j in range(i)], default=0)
            assert length[i] == best and (best == 0 or w[source[i] : source[i] + best] == w[i : i + best] and source[i] < i)
        assert periodic_runs.blocks(length.tolist(), 0, len(w))[-1] == len(w)


def want_runs(rows):
    out = []
    for i, text in rows:
        words = queries.repeat_tail(i, (text or "").encode().split())
        runs = brute_runs(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        out.append((i, len(words), len(runs), *top, sha, hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    return sorted(out, key=text_of)


def test_periodic_runs_query(spark, odd, none, tmp_path):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = [(i, " ".join((x or "").split(" ")[:700])) for i, x in zip(t["doc_id"], t["text"])]
    r = random.Random(3)
    rows += [(1000 + k, b" ".join(periodic(r)).decode()) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=text_of) == want_runs(rows)
    short = [x[:2] for x in odd_rows() if len(x[1] or "") < 10000]
    got = periodic_runs.find_runs(odd.where(F.coalesce(F.length("text"), F.lit(0)) < 10000), texts=False, change=queries.repeat_tail)
    assert sorted(map(tuple, got.collect()), key=text_of) == want_runs(short)
    whole = periodic_runs.find_runs(odd).collect()
    assert len(whole) == len(odd_rows())
    r = next(x for x in whole if x.doc_id == 9)
    assert (r.n_runs, r.start, r.length, r.period, r.collapsed) == (1, 0, 30, 1, "idiot")
    assert periodic_runs.find_runs(none).count() == 0


def test_repeated_tail():
    """The contract's change: a tenth of the ids, the tail from a place on repeats its first period."""
    words = [str(k).encode() for k in range(97)]
    for i in range(200):
        h = zlib.crc32(str(i).encode())
        got = queries.repeat_tail(i, words)
        if h % 10:
            assert got == words
            continue
        g = h // 10
        a = g % 97
        p = 1 + (97 - a) // (3 + g % 8)
        assert got == [words[k] if k < a else words[a + (k - a) % p] for k in range(97)]
    assert queries.repeat_tail(None, words) == words and queries.repeat_tail(16, []) == []

"""The corpus operators against brute force, exact round trips and held-out labels, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from confluo.llm import decontamination, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, queries, substring_dedup, token_counts, token_output, toxicity, trees
from confluo.llm import exchange as X
from confluo.llm.common import KEY, narrow

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, label string, words string, b int"
LABELS = "doc_id long, quality int, toxic int"


def odd_rows():
    """Nulls in each column, empty and very long texts, ties, repeated rows and columns with names that operators use."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 6)))
    base = [word() for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (3, " ".join(base)), (3, "other text under one id " + " ".join(base[:20])), (4, None), (None, " ".join(base[10:90])), (None, None), (5, ""), (6, " \t\n"), (7, "All Rights Reserved. cc-by"), (8, " ".join(word() for _ in range(30000))), (9, "idiot " * 30), (10, "a"), (11, "a"), (12, "<|endoftext|> K İ ß ΑΣ é")]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "h", "l", "w", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def local():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_token_counts(docs, odd, none, local):
    want = dict(zip([i for i, _ in local], map(len, library_ids([t for _, t in local]))))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, queries.tokenizer_path()).collect()} == want
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, queries.tokenizer_path()).collect())
    texts = [r[1] or "" for r in odd_rows()]
    assert got == sorted((len(t.encode()), len(i)) for t, i in zip(texts, library_ids(texts)))
    assert token_counts.count_tokens(none, queries.tokenizer_path()).count() == 0


def test_token_output(docs, odd, none, local):
    at, want = 0, {}
    for (i, _), ids in zip(local, library_ids([t for _, t in local])):
        ids = [*ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_files(docs, queries.tokenizer_path()).collect()} == want
    got = token_output.token_files(odd, queries.tokenizer_path()).orderBy("start").collect()
    assert len(got) == len(odd_rows()) and [r.doc_id for r in got][-2:] == [None, None]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    assert token_output.token_files(none, queries.tokenizer_path()).count() == 0


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(grams)
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, labels, odd, none, local):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in local:
        n = brute_stats(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and (not r.kept or not r.base_failed)
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(marks[i], r.kept) for i, r in got.items() if i in marks]
    assert np.mean([k for q, k in judged if q]) > 0.9 and np.mean([k for q, k in judged if not q]) < 0.3
    assert quality_rules.quality_rules(odd, labels).count() == len(odd_rows())
    assert quality_rules.quality_rules(none, labels.limit(0)).count() == 0


def held_out(spark):
    """Documents of sf0.1, their labels, and the labels without a quarter of the ids."""
    big = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{big}/labels.parquet")
    out = "crc32(cast(doc_id as string)) % 4 = 2"
    marks = {r.doc_id: r.quality for r in lab.where(out).collect()}
    docs = spark.read.parquet(f"{big}/documents.parquet").join(lab.where(out).select("doc_id"), "doc_id", "left_semi")
    return spark.read.parquet(f"{big}/documents.parquet"), docs, lab.where(f"not {out}"), marks


def test_quality_held_out(spark):
    """Verdicts on labels that weren't used to fit."""
    everything, docs, labels, marks = held_out(spark)
    for judge in (quality_rules.quality_rules, quality_classifier.classify):
        got = {r.doc_id: r.kept for r in judge(everything, labels).collect() if r.doc_id in marks}
        assert np.mean([got[i] for i, q in marks.items() if q]) > 0.95, judge
        assert np.mean([got[i] for i, q in marks.items() if not q]) < 0.05, judge


def test_quality_ids_ties_and_columns(spark, odd):
    """Text ids, an id and a text with two labels, tables without the site's columns, labels of one class or none."""
    text = odd.withColumn("doc_id", F.concat(F.lit("d"), odd.doc_id.cast("string")))
    two = spark.createDataFrame([("d1", 1, 0), ("d1", 0, 1), ("d3", 0, 0), ("d8", 1, None)], "doc_id string, quality int, toxic int")
    for judge in (quality_rules.quality_rules, quality_classifier.classify, toxicity.toxicity):
        for lab in (two, two.where("doc_id = 'd3'"), two.limit(0), two.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))):
            assert judge(text, lab).count() == len(odd_rows())
    bare = text.select("doc_id", "text")
    assert quality_classifier.classify(bare, two).count() == len(odd_rows())
    a, b = ([str(r) for r in quality_rules.quality_rules(text, two).orderBy("doc_id", "score").collect()] for _ in range(2))
    assert a == b


def test_long_text_repeats_are_the_same(monkeypatch):
    from confluo.llm import doc_stats

    rnd = random.Random(1)
    words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(300)]
    plain = doc_stats.repeated_words(words)
    monkeypatch.setattr(doc_stats, "LONG", 10)
    assert doc_stats.repeated_words(words) == plain == brute_stats(" ".join(w.decode() for w in words))[4]


def test_title_rate_counts_all_words():
    from confluo.llm import doc_stats

    words = [b"a"] * (1 << 20) + [b"B"] * (1 << 20)
    raw = b" ".join(words)
    got = doc_stats.features(raw, raw.decode(), (words, len(words), 0, 0, 0))
    assert got[list(doc_stats.FEATURES).index("title_rate")] == 0.5


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, 2))
    y = (x[:, 0] + 0.3 * rng.random(800) < 0.6).astype(float)
    forest = trees.fit(x, y, [-1, 0], trees=20)
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], 1)
    assert (np.diff(forest.raw(line)) <= 1e-12).all() and ((forest.raw(x) > 0) == (y > 0)).mean() > 0.8


def test_quality_classifier(docs, labels, odd, none):
    marks = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(marks[r.doc_id], r.kept) for r in quality_classifier.classify(docs, labels).collect() if r.doc_id in marks]
    assert np.mean([k for q, k in judged if q]) > 0.9 and np.mean([k for q, k in judged if not q]) < 0.3
    decided = quality_classifier.classify(odd, labels)
    assert decided.count() == len(odd_rows())
    kept = quality_classifier.drop_rejected(odd, decided)
    assert kept.columns == odd.columns and kept.count() == decided.where("kept").count()
    assert quality_classifier.classify(none, labels).count() == 0


def brute_dedup(rows):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    order = lambda i: float("inf") if i is None else i
    for i, w in split:
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, order(i)), order(i))
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < order(i) for j in range(k, k + 13)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(docs, odd, none, local, monkeypatch):
    table = lambda d: sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(d).collect())
    assert table(docs) == brute_dedup(local)
    assert table(odd) == brute_dedup([r[:2] for r in odd_rows()])
    assert table(none) == []


def test_factors(spark):
    """A parse by hand: two stretches of one earlier document, one of another, and windows across the boundaries."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(40)]
    third = ["x", *a[5:35], *a[10:30], "y", *b[20:40]]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(third)), (4, " ".join(["z", *a[28:35], *a[10:18], "z"]))]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [(f.start, f.words, f.place) for f in got[3].factors] == [(1, 30, 5), (31, 20, 10), (52, 20, 48 + 20)]
    assert len({f.block for f in got[3].factors}) == 1 and not got[1].factors and not got[2].factors
    assert [(s.start, s.words) for s in got[3].spans] == [(1, 50), (52, 20)]
    # Across the boundary of the two factors of document 3 stand 15 words that are nowhere else.
    assert [(f.start, f.words) for f in got[4].factors] == [(1, 15)] and got[4].n_removed == 15


def brute_classes(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), str(low.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("frequent", [1000, 1])
def test_jaccard_join(spark, docs, odd, none, local, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4 if frequent == 1 else jaccard_join.BLOCK)
    table = lambda d: sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(d).collect())
    assert table(docs) == brute_classes(local)
    assert table(odd) == brute_classes([r[:2] for r in odd_rows()])
    assert table(none) == []
    rnd = random.Random(frequent)
    base = [str(rnd.random()) for _ in range(60)]
    rows = []
    for i in range(60):  # a family whose members link in chains
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(60)] = str(rnd.random())
        rows.append((i, " ".join(w)))
    assert table(spark.createDataFrame(rows, "doc_id long, text string")) == brute_classes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_outside_a_family(spark, monkeypatch, seed):
    """Sets that no hub reaches: groups around centres far from each other, with sets between them, in small blocks."""
    monkeypatch.setattr(jaccard_join, "HUBS", 1)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "PART", 2)
    rnd = random.Random(seed)
    base = [str(rnd.random()) for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 6)):
            w[at] = f"{at}-{rnd.randrange(3)}"
        rows.append((i, " ".join(w)))
    want = brute_classes(rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want
    assert 1 < len({c for _, _, c in want}) < 150


def test_keep_one(odd):
    kept = jaccard_join.keep_one(odd, jaccard_join.near_duplicates(odd))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and 1 in ids and 2 not in ids and ids.count(None) == 2


def test_keep_one_row_a_component(spark):
    """Equal rows at the representative, null ids, and unrelated texts under one id."""
    rnd = random.Random(9)
    a, b, c, d = (" ".join(str(rnd.random()) for _ in range(60)) for _ in range(4))
    near = lambda t: " ".join(["changed", *t.split()[1:]])
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (2, near(a), "x"), (None, near(a), "x"), (3, b, "x"), (3, c, "x"), (None, d, "x"), (None, near(d), "x"), (None, d, "z"), (5, "", "x"), (6, None, "x")]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__k", F.lit(1)).withColumn("k", F.lit(2))
    kept = jaccard_join.keep_one(t, jaccard_join.near_duplicates(t))
    assert kept.columns == t.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    of_d = [k for k in got if k[0] is None]
    assert len(of_d) == 1 and of_d[0][1] in (d, near(d))
    assert got == collections.Counter([(1, a), (3, b), (3, c), (5, ""), (6, None), *of_d])


def held_against_sql(spark, rows):
    """The mix of (doc_id, text, source) rows, in Spark and by the query's SQL, and what apply_mix makes of it."""
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(t)
    con = duckdb.connect()
    con.register("documents", t.toArrow())
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = con.sql(queries.OP5_SQL).project(", ".join(cols)).fetchall()
    got = [tuple(r) for r in mixed.select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    applied = mixing.apply_mix(t, mixed)
    assert applied.columns == t.columns
    assert applied.count() == (mixed.agg({"copies": "sum"}).first()[0] or 0)
    return mixed.toPandas(), applied.toPandas()


def test_mixing(spark, docs, odd, none):
    r, _ = held_against_sql(spark, [(x.doc_id, x.text, x.source) for x in docs.select("doc_id", "text", "source").collect()])
    assert (r.taken <= 3 * r["size"]).all() and (r.taken % r["size"].clip(lower=1) == 0).all()
    mixed = mixing.mix(odd)
    assert mixed.count() == len(odd_rows())
    out = mixing.apply_mix(odd, mixed)
    assert out.columns == odd.columns and mixing.mix(none).count() == 0 and mixing.apply_mix(none, mixing.mix(none)).count() == 0


def test_mixing_repeated_rows(spark):
    """Equal rows, null ids, one id with many texts and sources, a source without words: near the targets all the same."""
    rows = [(7, "w " * 10, "a")] * 400 + [(i, "x " * (i % 37), "a") for i in range(30)] + [(100 + i, "y " * (i % 50), "b") for i in range(40)]
    rows += [(200 + i, "z " * 5, None) for i in range(60)] + [(None, "q " * 9, "b")] * 50 + [(None, None, "c")] * 3
    rows += [(7, f"other words {i} " * 3, "a") for i in range(20)] + [(7, "w " * 10, "b")]
    r, applied = held_against_sql(spark, rows)
    per = r.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) <= 0.01 * per.target + 1).all()
    assert (r.copies <= 3).all()
    words = applied.text.fillna("").str.split().str.len().groupby(applied.source.fillna("-")).sum()
    assert sorted(words) == sorted(x for x in per.taken if x)


def test_mixing_probabilities():
    """Inclusion by length: with the draws of many mixes, documents of more digits are in oftener."""
    rows = [(i, "w " * (2 ** (1 + i % 6)), "a") for i in range(240)] + [(1000 + i, "v " * 40, "b") for i in range(60)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    n = {}
    for salt in range(40):
        sql = queries.OP5_SQL.replace("|| ':' ||", f"|| ':{salt}' ||")
        for size, extra in con.sql(f"select size, sum(taken / size) from ({sql}) where source_size > 2400 group by size").fetchall():
            n[size] = n.get(size, 0) + extra
    drawn = {s: k % 1600 for s, k in n.items()}  # beyond the whole copies
    assert drawn[64] > 2 * drawn[2] and drawn[64] > drawn[8] > drawn[2]


def test_mix_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 0)], "source string, source_size long")
    t = {r.source: r.target for r in mixing.targets(s).collect()}
    assert t["a"] == 30.0 and t[None] == 0.0 and t["c"] == 270.0 and abs(sum(t.values()) - 1100) < 1e-6


def test_license_scan(docs, odd, none, local):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        at = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))

    table = lambda d: sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(d).collect())))
    assert table(docs) == sorted(str((i, *brute(t))) for i, t in local)
    assert table(odd) == sorted(str((r[0], *brute(r[1]))) for r in odd_rows())
    assert table(none) == []


def brute_licenses(text):
    """Labels, score and spans of the method and the base, template by template over one text."""
    low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        found += [(k, k + len(p) - 1, label, 1.0) for k in range(len(w)) if w[k : k + len(p)] == p]
    for template, label in license_scan.TEMPLATES.items():
        t = template.split()
        pairs, good = len(t) - 1, []
        votes = sorted((q, p) for q in range(pairs) for p in range(len(w) - 1) if w[p : p + 2] == t[q : q + 2])
        for d in sorted({p - q for q, p in votes}):
            last, n, first = (-1, -1), 0, None
            for q, p in votes:
                if abs(p - q - d) <= license_scan.DRIFT and q > last[0] and p > last[1]:
                    last, n, first = (q, p), n + 1, p if first is None else first
            if n / pairs >= license_scan.AT:
                good.append((d, n / pairs, first, last[1] + 1))
        run = []
        for k, (d, score, start, stop) in enumerate(good):
            if k and d - good[k - 1][0] > license_scan.DRIFT:
                found.append((*max(run)[2:], label, max(run)[0]))
                run = []
            run.append((score, -d, start, stop))
        if run:
            found.append((*max(run)[2:], label, max(run)[0]))
    return ",".join(sorted({x[2] for x in found})), max((x[3] for x in found), default=0.0), sorted(found)


def test_license_diagonals(spark):
    """Labels, score and spans against brute force: repeats, gaps, drift, wrong order, two templates in one run."""
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    apache = "licensed under the apache license version 2 0"
    texts = ["the mit license the mit license", "released under the mit license", f"x y {mit} z", f"x {mit.replace('hereby', 'hereby now also')} z", f"x {mit.replace(' free of charge', '')}"]
    texts += [" ".join(reversed(mit.split())), f"{mit} {mit}", f"{apache} {apache} all rights reserved", "licensed under the mit license licensed under the apache license version 2 0", "mit license the the mit under license released"]
    texts += [mit[: len(mit) // 2], "granted free of charge to is hereby granted free of charge", "this work is licensed under the gnu general public license version 3", ""]
    rnd = random.Random(8)
    every = sorted({w for t in license_scan.TEMPLATES for w in t.split()})
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(1, 4)):
            t = rnd.choice(list(license_scan.TEMPLATES)).split()
            i = rnd.randrange(len(t))
            words += t[: i + 1] + [rnd.choice(every) for _ in range(rnd.choice([0, 0, 1, 2, 4]))] + t[i + rnd.choice([0, 1, 2]) :]
        texts.append(" ".join(words))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        labels, score, spans = brute_licenses(t)
        assert (got[k].labels, got[k].score) == (labels, score), t
        assert sorted((s.start, s.end, s.label, s.score) for s in got[k].spans or []) == spans, t
    assert got[0].labels == "" and got[0].score == 0 and got[1].labels == "mit" and got[3].labels == got[4].labels == "mit" and got[5].labels == ""


def test_decontamination(spark, docs, odd, none, local):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {(i, b.item_id) for i, t in local for b in bench.collect() if b.text in t}
    assert want == {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, bench).collect()}
    item = "the quick brown fox jumps over seventeen lazy dogs while nobody watches from windows"
    null = "every autumn some geese fly south across our wide valley toward warmer lakes"
    b = spark.createDataFrame([(1, item), (2, None), (3, "five words only, in order"), (4, ""), (None, null)], "item_id long, text string")
    text = [(1, "noise " * 50 + item.replace("lazy", "sleepy") + " noise" * 50), (2, "noise " * 90), (3, None), (4, ""), (None, f"x {null} y"), (None, f"x {null} y")]
    text += [(5, "here are Five words only, in order."), (6, "five words in order, only"), (7, "long " * 70000 + item + " long" * 9)]
    leaks = decontamination.find_leaks(spark.createDataFrame(text, "doc_id long, text string"), b)
    assert sorted(((r.doc_id, r.item_id) for r in leaks.collect()), key=str) == [(1, 1), (5, 3), (7, 1), (None, None)]
    assert decontamination.drop_leaks(odd, decontamination.find_leaks(odd, b)).count() == len(odd_rows())
    assert decontamination.drop_leaks(odd.withColumn("__leak", odd.doc_id), leaks).columns == [*odd.columns, "__leak"]
    assert decontamination.find_leaks(none, b).count() == 0 and decontamination.find_leaks(odd, b.limit(0)).count() == 0
    assert decontamination.find_leaks(odd, b.where("item_id = 2")).count() == 0


def longest_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_common_subsequence():
    for rnd in map(random.Random, range(60)):
        a, b = ([rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(1, 30))] for _ in range(2))
        at = decontamination.places(a)
        assert decontamination.in_order([at[w] for w in b if w in at]) == longest_in_order(a, b)


def test_altered_copies_leak(spark):
    """Recall on items of which a share of words is replaced by other words of the benchmark, the item at any place of a
    text; texts without an item are left alone. The directions are fewer than the passages."""
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    items = [tuple(r) for r in bench.orderBy("item_id").collect()]
    clean = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 7 = 0").collect() if not any(t in r.text for _, t in items)]
    words = sorted({w for _, t in items for w in t.split()})
    rnd, rows = random.Random(1), [(k, " ".join(w)) for k, w in enumerate(clean)]
    for share in (0, 10, 20, 30):
        for i, t in items:
            w, f = t.split(), rnd.choice(clean)
            for k in rnd.sample(range(len(w)), round(len(w) * share / 100)):
                w[k] = rnd.choice(words)
            cut = rnd.randint(0, len(f))
            rows.append((1000 * (1 + share) + i + 10**6, " ".join(f[:cut][-100:] + w + f[cut:][:100])))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    recall = {share: sum((1000 * (1 + share) + i + 10**6, i) in got for i, _ in items) / len(items) for share in (0, 10, 20, 30)}
    assert recall[0] == recall[10] == 1 and recall[20] >= 0.95 and recall[30] >= 0.9, recall
    assert not any(d < 10**6 for d, _ in got)
    found = decontamination.passages(bench, "item_id", "text")
    assert decontamination.RANK < found.count()


def test_part_of_a_long_item_leaks(spark):
    rnd = random.Random(3)
    item = [f"{rnd.choice('abcdefgh')}{rnd.randrange(400)}" for _ in range(300)]
    b = spark.createDataFrame([(1, " ".join(item))] + [(2 + k, " ".join(f"o{rnd.randrange(500)}" for _ in range(40))) for k in range(20)], "item_id long, text string")
    text = [(1, "y " * 40 + " ".join(item[101:141]) + " y" * 40), (2, "y " * 40 + " ".join(item[101:110]) + " y" * 40)]
    assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(text, "doc_id long, text string"), b).collect()] == [(1, 1)]


def test_toxicity(spark, labels, odd, none):
    big = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{big}/labels.parquet")
    r = toxicity.toxicity(spark.read.parquet(f"{big}/documents.parquet"), lab).toPandas().merge(lab.toPandas(), on="doc_id")
    out = r[r.held_out]
    assert (out.predicted == out.toxic).mean() > 0.95 and out[out.toxic == 1].predicted.mean() > 0.8
    assert toxicity.toxicity(odd, labels).count() == len(odd_rows())
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_toxic_folding():
    assert toxicity.fold("1d10t iDI0T іdiot ｉｄｉｏｔ $cum") == ["idiot", "idiot", "idiot", "idiot", "scum"]
    lex = toxicity.Lexicon({" idiot ": 5.0}, frozenset({"village idiot"}))
    a = lex.automaton()
    assert lex.strength(a, ["an", "idiot"]) > 0 and lex.strength(a, ["village", "idiot"]) == 0


def test_exchange_round_trip():
    rnd = np.random.default_rng(4)
    value, owner = rnd.integers(0, 1 << 63, 500).astype(np.uint64), rnd.integers(-(1 << 62), 1 << 62, 40)[rnd.integers(0, 40, 500)]
    mark, at, bucket = owner // 7, rnd.permutation(500), X.spread(owner, 17)
    want = sorted(zip(*(x.tolist() for x in (value, owner, mark, at, bucket))))
    for per in (1, 5, 17):
        table = pa.Table.from_batches([X.rows(X.pack(3, value, owner, mark, at, bucket, per))])
        assert table.num_rows <= -(-17 // per) and sorted(zip(*(x.tolist() for x in X.unpack(table, 3)))) == want
        assert len(X.unpack(table, 1)[0]) == 0


def test_exchange_bytes_a_window():
    """However many buckets there are, packed rows of a chunk keep about the same bytes a window."""
    rnd = np.random.default_rng(5)
    n = X.CHUNK
    h, owner, ids, at = rnd.integers(0, 1 << 63, n).astype(np.uint64), np.full(n, 77), np.sort(rnd.integers(0, 9999, n)), np.arange(n)
    each = {}
    for buckets in (80, 8000, 800_000, 8_000_000):
        out = X.pack(0, h, owner, ids, at, (h % np.uint64(buckets)).astype(np.int64), X.per_row(buckets))
        assert len(out) <= X.COARSE
        each[buckets] = sum(48 + sum(map(len, row[2:])) for row in out) / n
    assert each[80] < 10 and each[8_000_000] < 1.1 * each[8000] < 1.1 * 14, each


def test_exchange_of_two_levels(spark, docs, odd, local, monkeypatch):
    monkeypatch.setattr(X, "COARSE", 3)
    monkeypatch.setattr(X, "CHUNK", 2000)
    for module in (substring_dedup, jaccard_join):
        monkeypatch.setattr(module.X, "buckets_for", lambda d: 20)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect())
    assert got == brute_dedup(local)
    sets = {r.set: (r.n, sorted(np.frombuffer(r.toks, np.uint64).tolist())) for r in jaccard_join.shared_sets(narrow(docs), 20).collect()}
    every = {jaccard_join.set_id(t): t for _, text in local if len(t := jaccard_join.tokens(text.encode()))}
    times = collections.Counter(x for t in every.values() for x in t.tolist())
    shared = {i: [x for x in t.tolist() if times[x] > 1] for i, t in every.items()}
    assert sets == {i: (len(every[i]), sorted(x)) for i, x in shared.items() if 4 * len(x) >= 3 * len(every[i])}


def test_pipeline_stages_on_odd_tables(spark, odd, none):
    """Each stage on nulls, repeats and clashing names, and on an empty table, as the next one's documents."""
    import corpus_pipeline

    for start in (odd, none):
        t = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, t, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == odd.columns, name
                t = spark.createDataFrame(out.collect(), odd.schema)
                assert (t.count() == 0) == (start is none) or k > 0
            else:
                assert out.count() == t.count()


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert out and all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:]))
    assert KEY not in docs.columns


def test_op8_bytes_a_token_do_not_grow_with_buckets(spark, monkeypatch):
    """A packed token names its owner by a place in its chunk: many buckets cost no more a token (before: 15 bytes with 800 buckets, 10 with 10)."""
    rnd = np.random.default_rng(6)
    texts = [(i, " ".join(map(str, rnd.integers(0, 1 << 40, 400)))) for i in range(2000)]
    docs = narrow(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    each, real = {}, X.exchange

    def measure(sent, n_buckets, *rest):
        each[n_buckets] = sent.where("kind = 0").selectExpr("sum(length(value) + length(owner) + length(mark) + length(at) + length(fine))").first()[0] / (2000 * 396)
        return real(sent, n_buckets, *rest)

    monkeypatch.setattr(jaccard_join.X, "exchange", measure)
    for buckets in (10, 800):
        assert jaccard_join.shared_sets(docs, buckets).count() == 0
    assert each[800] < 10 and each[800] < 1.2 * each[10], each


def test_op8_first_look_loses_no_link(spark):
    """16-bit hashes of tokens never hide a common token, and turn away sets that have little in common."""
    rnd = np.random.default_rng(7)
    base = np.unique(rnd.integers(0, 1 << 63, 600).astype(np.uint64))
    near, half, few = (np.sort(np.r_[base[:k], rnd.integers(0, 1 << 63, 600 - k).astype(np.uint64)]) for k in (540, 300, 0))
    wide = np.array([5, 65535, 65535 + 65536, 300 + (1 << 20)], np.uint64)
    for t in (near, wide, wide[:0], np.arange(0, 1 << 16, 255, dtype=np.uint64), np.arange(0, 1 << 16, 511, dtype=np.uint64)):
        row = jaccard_join.thinned(spark.createDataFrame([(1, len(t), bytearray(t.tobytes()))], "set long, n long, toks binary")).first()
        want = np.unique(t % np.uint64(1 << 16), return_counts=True)
        assert all((x == y).all() for x, y in zip(jaccard_join.fattened(bytes(row.toks)), want))
    sets = spark.createDataFrame([(i, len(t), bytearray(t.tobytes())) for i, t in enumerate((base, near, half, few))], "set long, n long, toks binary")
    asks = spark.createDataFrame([(9, i, i) for i in (1, 2, 3)], "block long, set long, comp long")
    members = spark.createDataFrame([(9, 0, 0)], "block long, set long, comp long")
    assert [tuple(r) for r in jaccard_join.worth_asking(asks, members, sets).collect()] == [(9, 1, 1)]


def test_cut_leaves_no_shuffle_files(spark):
    """What was shuffled for a table that is cut goes with it; the session's own setting stays as it was."""
    from confluo.llm.common import CLEANUP, cut

    before = spark.conf.get(CLEANUP, None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    table = cut(spark.range(1000).repartition(7).groupBy("id").count())
    assert table.count() == 1000 and spark.conf.get(CLEANUP, None) == before
    assert tracker.shuffleStatuses().size() <= held + 1  # count()'s own


def test_token_worker_holds_its_own_stage_only(spark):
    """What an earlier stage kept in a worker process goes before an encoder is made; batches are met in slices."""
    from confluo.llm import bpe, common
    from confluo.llm.queries import tokenizer_path

    common.KEPT["earlier"] = bytearray(1 << 20)
    bpe.once(bpe.WordEncoder, tokenizer_path())
    assert list(common.KEPT) == [(bpe.WordEncoder, tokenizer_path())]
    common.release()
    b = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    got = list(common.slices([b, b.slice(0, 0)]))
    assert max(s.num_rows for s in got) <= 256 and sum((s.column(0).to_pylist() for s in got), []) == list(range(1000))


def test_resting_worker_holds_no_full_memo():
    """An encoder is gone at once when it is released, though its memos refer to it; after a task only small memos stay."""
    import gc
    import weakref

    from confluo.llm import bpe, common

    gc.disable()  # what follows mustn't wait for Python's own round
    try:
        encoder = weakref.ref(bpe.once(bpe.WordEncoder, queries.tokenizer_path()))
        small = encoder().encode(b"a few words")
        bpe.rest()
        assert encoder() is not None and encoder().encode(b"a few words") == small
        encoder().pieces.update((str(i), b"") for i in range(bpe.IDLE_BOUND))
        bpe.rest()
        assert encoder() is None and not common.KEPT
        encoder = weakref.ref(bpe.once(bpe.WordEncoder, queries.tokenizer_path()))
        common.release()
        assert encoder() is None
    finally:
        gc.enable()


def test_token_writer_sends_small_batches(spark, tmp_path, monkeypatch):
    """Texts reach the encoder, and frames the packer, a few MB at once; the dictionary's table starts no Python."""
    from pyspark.sql import DataFrameWriter

    from confluo.llm.common import BATCH, BATCH_BYTES

    before, seen, write = spark.conf.get(BATCH, None), {}, DataFrameWriter.parquet
    plan = lambda w: w._df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **b: seen.update({path.rpartition("/")[2]: (spark.conf.get(BATCH, None), plan(w))}) or write(w, path, *a, **b))
    rows = [(i, f"word{i} " * 50) for i in range(40)]
    token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), f"file://{tmp_path}/t")
    assert seen["blocks"][0] == str(BATCH_BYTES) and spark.conf.get(BATCH, None) == before
    assert "ExistingRDD" not in seen["dictionary"][1]
    assert [r.doc_id for r in token_output.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()] == list(range(40))


def test_bucket_of_tokens_is_compared_in_parts(spark, monkeypatch):
    """What a bucket's tokens take beside the packed rows is a few arrays of their own, whatever else is sorted for them."""
    import tracemalloc

    steps = {}
    monkeypatch.setattr(X, "exchange", lambda sent, n, find, gather, schema: steps.update(find=find) or spark.createDataFrame([], schema))
    jaccard_join.shared_sets(narrow(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")), 1)
    r, rows, k, chunks = np.random.default_rng(5), [], 50_000, 20
    for c in range(1, chunks + 1):
        h = X.stir(r.choice(600_000, k, replace=False).astype(np.uint64))  # many tokens in several chunks
        same = lambda x: np.full(k, x, np.int64)
        rows += X.pack(0, h, np.where(np.arange(k) % 9, c, 0), same(0), np.arange(k), same(0), 1)
    table = pa.Table.from_batches([X.rows(rows)])
    h, owner, _, at, _ = X.unpack(table, 0)
    holders = collections.defaultdict(set)
    for x in zip(h.tolist(), owner.tolist(), at.tolist()):
        holders[x[0]].add(x[1:])
    many = {x: jaccard_join.MANY if any(o == 0 for o, _ in got) else len(got) for x, got in holders.items()}
    want = sorted((x, o, many[x], a) for x, got in holders.items() for o, a in got if many[x] > 1 and o)
    del h, owner, at, holders, many
    tracemalloc.start()
    found = steps["find"](table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = X.unpack(found, 1)
    assert sorted(zip(*(x.tolist() for x in got[:4]))) == want
    assert peak < 100 * k * chunks  # bytes a token


def test_cut_sends_small_batches(spark):
    """A cut's Python functions get at most a few MB at once, groups as well; the session's own setting comes back."""
    from confluo.llm.common import BATCH, BATCH_BYTES, cut

    before = spark.conf.get(BATCH, None)
    big = spark.range(120).selectExpr("id % 2 as k", "cast(repeat('x', 200000) as binary) as v").repartition(2, "k")
    most = lambda t: max(b.nbytes for b in t.to_batches())
    groups = cut(big.groupBy("k").applyInArrow(lambda t: pa.table({"n": [most(t)], "rows": [t.num_rows]}), "n long, rows long")).collect()
    assert [g.rows for g in groups] == [60, 60] and max(g.n for g in groups) < 2 * BATCH_BYTES
    assert spark.conf.get(BATCH, None) == before

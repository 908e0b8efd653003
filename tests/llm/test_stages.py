"""The quality classifier, the toxicity scores and each stage of the pipeline against plain Python."""

import collections
import math
import zlib

import numpy as np
import pytest
import test_corpus as corpus
from test_corpus import docs, labels, odd  # noqa: F401 - fixtures

from confluo.llm import decontamination, mixing, quality_classifier, toxicity
from confluo.llm.common import KEY

SF = corpus.SF


def strength(groups):
    """Prior strength of (n, sum, sum of squares, parent's mean) groups, by the method of moments."""
    groups = [g for g in groups if g[0] >= 2]
    total = sum(g[0] for g in groups)
    if not total:
        return 10.0
    spread = sum(n * mu * (1 - mu) for n, _, _, mu in groups) / total
    between = sum(n * ((s / n - mu) ** 2 - max(q / n - (s / n) ** 2, 0.0) / n) for n, s, q, mu in groups) / total
    return min(max(spread / max(between, 1e-6) - 1, 1.0), 1e6)


def posteriors(rows):
    """(host mean, path mean, posterior) of each (host, path, evidence) row."""
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for host, path, p in rows:
        hosts[host].append(p)
        paths[host, path].append(p)
    mu = sum(p for _, _, p in rows) / len(rows)
    sums = lambda ps: (len(ps), math.fsum(ps), math.fsum(p * p for p in ps))
    m = strength([(*sums(ps), mu) for ps in hosts.values()])
    host_mean = {h: (sum(ps) + m * mu) / (len(ps) + m) for h, ps in hosts.items()}
    m = strength([(*sums(ps), host_mean[k[0]]) for k, ps in paths.items()])
    path_mean = {k: (sum(ps) + m * host_mean[k[0]]) / (len(ps) + m) for k, ps in paths.items()}
    odds = [logit(p) + quality_classifier.SITE_WEIGHT * (logit(path_mean[h, a]) - logit(mu)) for h, a, p in rows]
    return [(host_mean[h], path_mean[h, a], 1 / (1 + math.exp(-o))) for (h, a, _), o in zip(rows, odds)]


def test_posteriors(spark, docs, labels, odd):
    """Shrunk means, prior strengths and posteriors of all rows, sites with one document and null sites included."""
    for table in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        site = {r.doc_id: (r.source, r.lang) for r in table.select("doc_id", "source", "lang").collect()}
        got = quality_classifier.classify(table, labels).orderBy("doc_id").collect()
        want = posteriors([(*site[r.doc_id], r.evidence) for r in got])
        assert np.allclose([(r.host_mean, r.path_mean, r.posterior) for r in got], want, rtol=1e-9, atol=1e-12)
        assert [r.kept for r in got] == [w[2] >= quality_classifier.KEEP_AT for w in want]


def plain_score(lexicon, text):
    """A text's score by looking at each word's beginnings, one after the other."""
    words, total = toxicity.fold(text or ""), 0.0
    for before, word in zip(["", *words], words):
        if f"{before} {word}" in lexicon.exceptions:
            continue
        total += sum(lexicon.weights.get(f" {word[:k]}", 0.0) for k in range(1, len(word) + 1))
        total += lexicon.weights.get(f" {word} ", 0.0)
    x = lexicon.bias + lexicon.slope * total / math.sqrt(max(1, len(words)))
    return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


def test_scores(spark, odd):
    """Scores, verdicts and folds of all whole texts against plain matching with the fitted lexicon; exceptions take part."""
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon = toxicity.fit(big, labels)
    assert lexicon.weights
    text = {r.doc_id: r.text for r in big.select("doc_id", "text").collect()}
    got = toxicity.toxicity(big, labels).collect()
    assert len(got) == len(text)
    want = [plain_score(lexicon, text[r.doc_id]) for r in got]
    assert np.allclose([r.score for r in got], want, rtol=1e-9, atol=1e-12) and max(want) > 0.9
    assert [r.predicted for r in got] == [int(p >= 0.3) for p in want]
    assert [r.held_out for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got]
    word = next(t.strip() for t in lexicon.weights if t.endswith(" ") or len(t) > 4)
    lexicon.exceptions = frozenset({f"plain {word}"})
    a = lexicon.automaton()
    for t in (f"plain {word}", f"{word} plain {word} {word}", "", None, f"x{word} {word}y", corpus.odd_rows()[11][1]):
        assert lexicon.score(lexicon.strength(a, toxicity.fold(t or ""))) == pytest.approx(plain_score(lexicon, t))


def rows_of(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def test_each_stage(spark, docs, monkeypatch):
    """What each stage of a run keeps, from the rows that the one before it wrote: each against a plain rule."""
    import corpus_pipeline

    seen = []
    for name, stage in corpus_pipeline.STAGES:
        def noted(spark, table, sf_dir, stage=stage):
            seen.append(table)
            return stage(spark, table, sf_dir)

        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted if n == name else f) for n, f in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    start, judged, single, clean, mixed = seen
    columns = docs.columns
    assert rows_of(start) == rows_of(docs) and all(t.columns == columns for t in seen)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    decided = quality_classifier.classify(start, labels).collect()
    site = {r.doc_id: (r.source, r.lang) for r in start.collect()}
    good = {r.doc_id for r, w in zip(decided, posteriors([(*site[r.doc_id], r.evidence) for r in decided])) if w[2] >= quality_classifier.KEEP_AT}
    assert rows_of(judged) == [r for r in rows_of(start) if r[columns.index("doc_id")] in good] and len(good) < len(decided)

    text = {r.doc_id: r.text for r in judged.collect()}
    classes = corpus.brute_classes(list(text.items()))
    first = {int(i) for i, n, component in classes if not n or i == component}
    assert {r.doc_id for r in single.collect()} == first and rows_of(single) == [r for r in rows_of(judged) if r[columns.index("doc_id")] in first]

    passages = [decontamination.bare(decontamination.normal_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    passages = [p for item in passages if item for p in decontamination.pieces(item)]
    kept = {r.doc_id for r in clean.collect()}
    assert kept < first and rows_of(clean) == [r for r in rows_of(single) if r[columns.index("doc_id")] in kept]
    for i in first:
        words = decontamination.bare(decontamination.normal_words(text[i]))
        line = b" " + b" ".join(words) + b" "
        if i in kept:  # none of the passages stands in a document that stays
            assert not any(b" " + b" ".join(p) + b" " in line for p in passages), i
        else:  # and each that goes holds the share of one in order
            assert any(corpus.longest_in_order(p, words) >= decontamination.COMMON * len(p) for p in passages), i

    sizes = [(r.doc_id, r.text, r.source) for r in clean.select("doc_id", "text", "source").collect()]
    taken, _ = corpus.held_against_sql(spark, sizes)
    copies = dict(zip(taken.doc_id, taken.copies))
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {i: n for i, n in copies.items() if n}
    assert set(rows_of(mixed)) <= set(rows_of(clean)) and max(copies.values()) <= mixing.MOST

    whole = sorted((r.doc_id, r.text) for r in mixed.collect())
    ids = corpus.library_ids([t for _, t in whole])
    at, want = 0, []
    for (i, _), x in zip(whole, ids):
        x = [*x, 2]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last] == want
    assert KEY not in columns

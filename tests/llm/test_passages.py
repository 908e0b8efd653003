"""Recall of the decontamination by length of the passage and share of its words replaced, and clean documents."""

import collections
import random

import pyarrow.parquet as pq

from confluo.llm import decontamination


def test_recall_by_length(spark):
    """Verbatim passages of 8 words or more are all found; with up to 30 % of the words replaced, by words of the benchmark or others of
    the corpus, nine of ten are, whatever the length; texts without a passage stay."""
    t = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pydict()
    r = random.Random(23)
    texts = [x for x, lang in zip(t["text"], t["lang"]) if lang == "en" and x and len(x.split()) > 150][:1500]
    lengths, items = (8, 10, 12, 16, 20, 30, 40, 60), []
    for k in range(160):
        w = r.choice(texts[:700]).split()
        a = r.randrange(max(1, len(w) - lengths[k % 8]))
        items.append(w[a : a + lengths[k % 8]])
    ours, all_words = [w for i in items for w in i], [w for x in texts[:300] for w in x.split()]
    docs, planted = [], {}
    for share in (0, 10, 20, 30):
        for k, w in enumerate(items):
            w = list(w)
            for j in r.sample(range(len(w)), round(len(w) * share / 100)):
                w[j] = r.choice(ours if k % 16 < 8 else all_words)
            before, after = (r.choice(texts[700:]).split()[: r.randint(20, 100)] for _ in range(2))
            planted[len(docs)] = (k, share)
            docs.append((len(docs), " ".join([*before, *w, *after])))
    clean = [(10**6 + i, " ".join(r.sample(x.split()[:300], k=150))) for i, x in enumerate(texts[700:900])]
    df = spark.createDataFrame([*docs, *clean], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(df, bench).collect()}
    hit, all_ = collections.Counter(), collections.Counter()
    for i, (k, share) in planted.items():
        all_[share, len(items[k])] += 1
        hit[share, len(items[k])] += (i, k) in found
    assert all(hit[0, n] == all_[0, n] for n in lengths)
    assert all(hit[x] >= 0.85 * all_[x] for x in all_) and sum(hit.values()) >= 0.95 * sum(all_.values())
    assert not [p for p in found if p[0] >= 10**6]

"""Every query against its SQL, and the rules of single operators on hand-made rows."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from confluo.functions import repetition
from confluo.functions import text as T
from confluo.operators import cluster, context, joins, neighbours, vectors
from confluo.operators import service as service_ops
from confluo.plans import queries as engine
from confluo.plans import service  # noqa: F401 - adds its queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(found):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, duck, name):
    got = engine.Q[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(engine.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows(tuple(r) for r in got.select(*cols).collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repeats():
    assert repetition.collapse_repeats("we we go on, go on now") == "we go on now"
    assert repetition.collapse_between_markers("a a [00:01] a b b") == "a [00:01] a b"
    assert repetition.collapse_repeats("") == ""


def test_chunks():
    chunks = repetition.split_chunks("One short sentence here. " * 400, 300)
    assert len(chunks) > 1 and all(len(c) <= 2205 for c in chunks)
    assert chunks[1].startswith(chunks[0][-500:].strip())
    long = repetition.split_chunks("Short one. " + "x" * 4100 + ". Next sentence.", 300)
    assert long == ["Short one.", "x" * 2000, "x" * 2000, "x" * 100 + ".", "Next sentence."]
    assert repetition.split_chunks("  a   b ") == ["a b"] and repetition.split_chunks(" ") == []


def test_text_columns(spark):
    df = spark.createDataFrame([("  Do it.. ", 3661.9, 59.0, "x7", " 12 ")], "a string, s double, t double, bad string, good string")
    r = df.select(T.normal_action(df.a), T.hms(df.s), T.hms(df.t), T.hms(df.t, True), T.cue_time(df.s), T.reference_id(df.bad), T.reference_id(df.good), T.word_count(df.a)).first()
    assert tuple(r) == ("do it", "01:01:01", "00:59", "00:00:59", "01:01:01.900", None, 12, 2)


def test_boundary():
    """The three cases, their bounds, and what the third one loses."""
    long = " ".join(f"word{i}" for i in range(100))
    assert repetition.boundary(f"before {long}", f"{long} after", 120) == (f"before {long}", "after", 1)
    assert repetition.boundary(f"before {long}", f"{long} after", 80)[2] == 0
    assert repetition.boundary("we like apples", "Apples, grow") == ("we like apples", "grow", 1)
    assert repetition.boundary("so is it", "it is") == ("so is it", "it is", 0)
    assert repetition.boundary("open 24.", "24-7 shop") == ("open", "24-7 shop", 2)
    assert repetition.boundary("then it gets a random", "gets a randomized value") == ("then it", "randomized value", 3)
    assert repetition.boundary("", "x") == ("", "x", 0)


def test_boundary_query(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(100))
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("turn < 2").withColumn("text", F.when(F.col("turn") == 0, F.lit(f"before {long}")).otherwise(F.lit(f"{long} after")))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    assert {(r.after, r.case) for r in engine.Q["boundary_overlap"](spark, str(tmp_path)).collect()} == {("after", 1)}


def test_validated():
    source = "we will meet at nine on monday morning in the main hall of the building"
    assert repetition.accepted(source, source.replace("nine", "Nine").replace("hall", "hall,"))
    assert not repetition.accepted(source, "something else entirely") and not repetition.accepted(source, source[:20])
    assert not repetition.accepted(source, "") and repetition.accepted("", "new")
    assert repetition.clean_up("go go on , now [00:01] now now .") == "go on, now [00:01] now."


def test_mirrored_overlap(spark):
    w = spark.createDataFrame([(1, 1, "x a"), (1, 2, "A y"), (1, 3, "y z")], "stream_id long, window_id long, text string")
    assert [r.removed for r in context.word_overlap(w).orderBy("window_id").collect()] == [0, 1, 1]


def test_overlap_join_is_plain_join(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(int(k), i, int(s), int(s + d)) for i, (k, s, d) in enumerate(rng.integers(1, 60, (40, 3)) % [3, 60, 30] + [0, 0, 1])], "k long, i long, a0 long, a1 long")
    b = a.toDF("k", "j", "b0", "b1")
    got = joins.overlap_join(a, b, "k", ("a0", "a1"), ("b0", "b1"), 7).select("i", "j")
    want = a.join(b, "k").where("a0 < b1 and b0 < a1").select("i", "j")
    assert rows(map(tuple, got.collect())) == rows(map(tuple, want.collect()))


def plain_root(up, n):
    seen = set()
    while n not in seen:
        seen.add(n)
        if not up.get(n):
            return n
        n = up[n]
    return n


def test_chains(spark):
    """Random links with cycles, long chains and unknown parents, against following them one by one."""
    rng = np.random.default_rng(5)
    links = {n: (int(rng.integers(1, 60)) if rng.random() < 0.8 else None) for n in range(1, 41)}
    links |= {n: n + 1 for n in range(100, 300)}
    c = spark.createDataFrame([(1, n, p) for n, p in links.items()] + [(2, 1, None)], "stream_id long, n long, p long")
    got = {(r.stream_id, r.n): r.root for r in joins.chain_roots(c, "stream_id", "n", "p").collect()}
    assert got == {(1, n): plain_root(links, n) for n in links} | {(2, 1): 1}
    m = spark.createDataFrame([(2, 1), (1, 0), (7, 2)], "old long, new long")
    assert {(r.old, r.new) for r in joins.closed_merges(m).collect()} == {(2, 0), (1, 0), (7, 0)}


def turn(c, v, t, dur=1.0, **more):
    return c.identify(np.asarray(v, float), t, t, t + dur, duration=dur, **more)


def test_clusterer():
    rng = np.random.default_rng(42)
    a, b = np.eye(64)[0], np.eye(64)[1]
    noisy = lambda v: v + 0.03 * rng.standard_normal(64)
    c, seen = cluster.Clusterer(), []
    for i in range(20):
        seen.append(turn(c, noisy(a if i % 2 else b), i, chunk=i, label=i % 2)[0])
    assert len(set(seen)) == 2 and len(set(seen[::2])) == 1
    assert turn(c, np.zeros(64), 21)[0] is None and c.invalid == {"all_zeros": 1} and c.seen == 21
    assert c.statistics()["speakers"] == 2 and round(c.statistics()["valid"], 4) == round(20 / 21, 4)


def test_short_and_overlapped_turns():
    rng = np.random.default_rng(1)
    a, b = np.eye(64)[0] + 0.02 * rng.standard_normal(64), np.eye(64)[1] + 0.02 * rng.standard_normal(64)
    c = cluster.Clusterer()
    assert turn(c, a, 0, overlap=True) == (None, 0.0) and not c.speakers
    assert turn(c, a, 1) == (0, 1.0) and turn(c, b, 3) == (1, 1.0)
    assert c.moves == {}  # a new speaker is the last one before its move is noted
    k, conf = turn(c, a, 5, 0.2)
    assert k == 0 and 0.65 < conf < 0.75 and c.last == 0 and c.moves == {(1, 0): 1} and c.last_end == 5.2 and c.speakers[0].count == 1
    assert turn(c, np.eye(64)[2] + 0.02 * rng.standard_normal(64), 6, 0.2) == (None, 0.0)
    assert turn(c, np.eye(64)[3] + 0.02 * rng.standard_normal(64), 7, overlap=True) == (None, 0.0) and len(c.speakers) == 2
    turn(c, a, 8, onset=True)
    assert c.speakers[0].count == 1 and c.speakers[0].last_seen == 8


def test_merges_of_speakers():
    rng = np.random.default_rng(2)
    base = np.eye(64)[0]
    like = lambda x, i: x * base + np.sqrt(1 - x * x) * np.eye(64)[i] + 0.01 * rng.standard_normal(64)
    c = cluster.Clusterer(cluster.Settings(threshold=0.99))
    for i in range(4):
        c.speakers[i] = cluster.Speaker(i, cluster._unit(like(0.9 if i < 2 else 0.1, i + 1)), [], 3, 0.0)
        c.speakers[i].protos, c.next = [[c.speakers[i].centroid, 3]], i + 1
    c.speakers[0].chunks, c.speakers[1].chunks = [(7, "x")], [(7, "y")]
    assert [(x[1], x[2]) for x in c.similar(0.7)] == [(0, 1)]
    assert c.merge(0.7) == 0  # heard in one chunk under different labels
    assert c.merge(0.7, session=True) == 1 and c.speakers[0].count == 6 and 1 not in c.speakers and c.speakers[0].variance == 0
    assert c.merge_by_hand(2, 9) is False and c.merge_by_hand(3, 2) is True and 3 not in c.speakers
    c.speakers[0].centroid = np.zeros(64)
    assert c.clean_up() == [0]
    d = cluster.Clusterer()
    d.speakers = {i: cluster.Speaker(i, cluster._unit(like(0.9, i + 1)), [[cluster._unit(like(0.9, i + 1)), 2]], 2) for i in range(3)}
    assert sorted(d.consolidate()) == [(0, 1), (0, 2)] and list(d.speakers) == [0]


def test_merged_sections():
    sec = lambda h, a, b, t: {"heading": h, "start_ms": a, "end_ms": b, "content": t}
    have = [sec("Budget", 0, 120000, "one two three"), sec("", 200000, 260000, "x y")]
    out = cluster.merged(have, [sec("Budget [0:00:00 – 0:02:00]", 0, 180000, "one two"), sec("Risks", 400000, 460000, None)], 500000)
    assert [(x["heading"], x["end_ms"], x["content"]) for x in out] == [("Budget", 180000, "one two three"), ("", 260000, "x y"), ("Risks", 460000, "")]
    out = cluster.merged(have, [sec("budget ", 0, 60000, "four five six")], 500000)
    assert [(x["heading"], x["end_ms"], x["content"]) for x in out][0] == ("budget", 60000, "four five six")
    out = cluster.merged(have, [sec(None, 200000, 250000, "z")], 260000)  # the latest may shrink, an empty heading gets the default
    assert out[1]["heading"] == "Untitled Topic" and out[1]["content"] == "z"
    assert len(cluster.merged(have, [sec("", 900000, 900001, "new")])) == 3
    assert [x["content"] for x in cluster.spliced(have, [sec("v", 10000, 110000, "fixed"), sec("w", 900000, 900001, "lost")])] == ["fixed", "x y"]


def test_document():
    from confluo.operators import service as S

    rows = [(0, 2000, "we like green apples", "A"), (2000, 4000, "green apples grow", "B"), (4000, 5000, " ", "A"), (5000, 3723000, "grow tall", "C")]
    text, used = S.document(rows)
    assert text == "[0:00:00]\n\nwe like green apples\n\n[0:00:02]\n\ngrow\n\n[0:00:04]\n\ntall\n\n[1:02:03]" and used == ["A", "B", "C"]


def test_text_and_results_budgets(spark):
    w = spark.createDataFrame([(1, i, "x" * 40) for i in range(3)], "stream_id long, window_id long, text string")
    r = spark.createDataFrame([(1, i, "p", "y" * 40, True) for i in range(3)], "stream_id long, window_id long, plugin string, formatted string, include boolean")
    n = lambda tokens, plugins: [(x.text_tokens, sum(len(y.list) for y in x.results or [])) for x in context.text_and_results(w, r, tokens, plugins).collect()][0]
    assert n(50, {"p": 1000}) == (30, 3) and n(50, {"p": 10}) == (30, 1) and n(0, {"p": None}) == (30, 3)
    assert n(-1, {"p": None}) == (0, 3) and n(10, {"p": 20}) == (10, 2) and n(50, {}) == (30, 0)


def brute_nearest(vecs, queries, k):
    out = []
    for q, x in queries:
        d = np.round([max(0.0, float(((x - v) ** 2).sum())) for _, v in vecs], 6)
        out += [(q, i, float(e), n + 1) for n, (e, i) in enumerate(sorted((e, i) for (i, _), e in zip(vecs, d))[:k])]
    return rows(out)


def clustered(n, dim, seed):
    """Vectors around a few centres, a third of them one vector."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, dim)) * 5
    v = centres[rnd.integers(0, 8, n)] + rnd.normal(size=(n, dim)) * 0.1
    v[: n // 3] = v[0]
    return [(i, x) for i, x in enumerate(np.round(v, 3))]


def test_nearest_by_pivots(spark, monkeypatch):
    """Equal to brute force over few and many cells, parts and tiles; ties, copies, queries outside the table, fewer vectors than k."""
    schema = "vec_id long, v array<double>"
    df = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in x], schema)
    vecs = clustered(3000, 6, 1)
    asks = [x for x in vecs if x[0] % 100 == 0] + [(10**6 + i, v + 3) for i, v in vecs[:5]]
    want = brute_nearest(vecs, asks, 7)
    assert rows(map(tuple, neighbours.nearest(df(vecs), df(asks), 7).collect())) == want
    monkeypatch.setattr(neighbours, "PART_ROWS", 50)
    monkeypatch.setattr(neighbours, "TILE", 97)
    monkeypatch.setattr(neighbours, "ASK_ROWS", 4)
    assert rows(map(tuple, neighbours.nearest(df(vecs), df(asks), 7).collect())) == want
    assert rows(map(tuple, neighbours.nearest(df(vecs[:5]), df(asks), 7).collect())) == brute_nearest(vecs[:5], asks, 7)
    few = neighbours.nearest_distance(df(vecs[:200]), df(asks)).collect()
    assert rows(map(tuple, few)) == rows(brute_first(vecs[:200], asks))
    odd = spark.createDataFrame([(None, [0.0] * 6), (7, None), (1, [0.0] * 6), (1, [0.0] * 6)], schema)
    assert neighbours.nearest(odd, odd, 3).count() == 2
    assert neighbours.nearest(odd.limit(0), odd, 3).count() == 0 and neighbours.nearest(odd, odd.limit(0), 3).count() == 0
    assert neighbours.nearest_distance(df(vecs[:9]), odd.limit(0)).where("d is null").count() == 9


def test_within_a_distance(spark):
    vecs = clustered(600, 5, 9)[200:]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vecs], "vec_id long, v array<double>")
    got = sorted((r.query_id, r.vec_id) for r in neighbours.within(df, df.where("vec_id % 9 = 0"), 0.06).collect())
    assert got == sorted((q, i) for q, x in vecs if q % 9 == 0 for i, v in vecs if ((x - v) ** 2).sum() <= 0.06) and len(got) > 100
    assert neighbours.within(df.limit(0), df, 1.0).count() == 0


def test_dedup_paths(spark):
    """Windows with and without word times in any order: the kept text of one is what the next is held against."""
    w = [(1, 0, "a b c", 0.0, 2.0, True), (1, 1, "C b x", 2.0, 4.0, False), (1, 2, "X y", 4.0, 6.0, False), (1, 3, "p q r", 5.9, 8.0, True), (1, 4, "r s", 8.0, 10.0, False), (1, 5, None, 10.0, 12.0, False), (2, 9, "r s", 0.0, 2.0, False)]
    df = spark.createDataFrame(w, "stream_id long, window_id long, text string, ts_start double, ts_end double, timed boolean")
    got = [(r.window_id, r.text, r.path) for r in service_ops.timestamp_dedup(df.repartition(3), 100).orderBy("stream_id", "window_id").collect()]
    assert got == [(0, "a b c", "first"), (1, "x", "words"), (2, "y", "words"), (3, "q r", "timestamps"), (4, "s", "words"), (5, "", "words"), (9, "r s", "first")]


def brute_first(vecs, queries):
    for i, v in vecs:
        yield i, min(round(float(((x - v) ** 2).sum()), 6) for _, x in queries)


def test_pivots_leave_cells_out():
    """On clustered vectors most rings are beyond the bound, and no neighbour lies in one of them."""
    vecs = clustered(4000, 6, 2)
    v = np.array([x for _, x in vecs])
    c = neighbours.Cells(v[::250], np.zeros((16, 2)), np.zeros((0, 5)))
    pivot, far = c.home(v)
    c.spans[:] = [(far[pivot == p].min(initial=9), far[pivot == p].max(initial=0)) for p in range(16)]
    ring = c.rings_of(pivot, far)
    keys = sorted(set(zip(pivot.tolist(), ring.tolist())))
    mine = [far[(pivot == p) & (ring == r)] for p, r in keys]
    c = neighbours.Cells(c.pivots, c.spans, np.array([(p, r, len(m), m.min(), m.max()) for (p, r), m in zip(keys, mine)], float))
    cell, met = c.number[pivot, ring], 0
    for q in v[::97]:
        d = ((v - q) ** 2).sum(1)
        first = next(c.asked(q[None, :], 10, None))
        bound = np.sort(d[np.isin(cell, first)])[9]
        more = next(c.asked(q[None, :], 10, np.array([bound])))
        met += len(first) + len(more)
        assert set(cell[d <= np.sort(d)[9]]) <= set(first) | set(more)
    assert met < len(v[::97]) * len(keys) / 3


def test_many_queries_fit():
    """A part meets 65,536 queries in tiles: the memory is that of a few of them."""
    import tracemalloc

    rnd = np.random.default_rng(4)
    v, q = rnd.normal(size=(2000, 16)), rnd.normal(size=(65536, 16))
    peaks = []
    for n in (4096, 65536):
        tracemalloc.start()
        found = sum(len(a) for a, _, _ in neighbours._met(v, np.arange(2000), q[:n], np.arange(n), 15, np.full(n, np.inf)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 15 * n
    assert peaks[1] < 1.2 * peaks[0] < 300e6


def test_plane(spark):
    """Equal to a singular value decomposition; any number of labels; one label and none."""
    rnd = np.random.default_rng(5)
    scale = np.array([5.0, 3.0, 1.0, 0.5, 0.2])
    data = [(i, int(rnd.integers(0, 40)), (rnd.normal(size=5) * scale).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, k, v, i % 3 + 1) for i, k, v in data], "vec_id long, label long, v array<double>, heard int")
    got = {r.label: (r.x, r.y) for r in vectors.plane(df, "label", "heard").collect()}
    labels = sorted({k for _, k, _ in data})
    m = np.array([np.average([v for _, k, v in data if k == x], axis=0, weights=[i % 3 + 1 for i, k, _ in data if k == x]) for x in labels])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m = m - m.mean(0)
    axes = np.linalg.svd(m, full_matrices=False)[2][:2]
    axes = axes * np.where(axes[np.arange(2), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    assert sorted(got) == labels and np.allclose([got[x] for x in labels], m @ axes.T, atol=2e-6)
    one = vectors.plane(df.where("label = 3"), "label", "heard").collect()
    assert [(r.x, r.y) for r in one] == [(0.0, 0.0)]
    assert vectors.plane(df.limit(0), "label", "heard").count() == 0


def test_prefix_scan_equals_windows(spark):
    """Running sums, last and next values by segments: a stream of half the rows, streams of one row, nulls and ties of the first order."""
    import random

    from confluo.operators import dedup, scan

    r = random.Random(6)
    data = [(0 if k % 2 else r.randrange(40), r.randrange(60), k, r.randrange(9), r.choice([None, None, "a", "b", "c"])) for k in range(1200)]
    df = spark.createDataFrame(data, "stream_id long, ts long, window_id long, n long, v string").repartition(5)
    order = ["ts", "window_id"]
    for parts in (1, 7, 40):
        for itself in (True, False):
            a, b = (rows(map(tuple, scan.running_sum(df, "stream_id", [F.desc("ts"), F.desc("window_id")], F.col("n"), "s", p, itself).select("window_id", "s").collect())) for p in (None, parts))
            assert a == b
        for f in (scan.last_known, scan.next_value):
            a, b = (rows(map(tuple, f(df, "stream_id", order, "v", "x", p).select("window_id", "x").collect())) for p in (None, parts))
            assert a == b, f
    w = df.select("stream_id", F.col("window_id").alias("summary_id"), "window_id", F.col("n").alias("char_count"), F.lpad(F.lit("x"), F.col("n").cast("int"), "y").alias("text"), "ts", F.col("ts").cast("double").alias("ts_start"), (F.col("ts") + 5.0).alias("ts_end"))
    for limit in (0, 3, 100):
        assert rows(map(tuple, context.retain(w, limit, 9).select(w.columns).collect())) == rows(map(tuple, context.retain(w, limit).collect()))
        assert rows(map(tuple, context.recent(w, limit, 9).select(w.columns).collect())) == rows(map(tuple, context.recent(w, limit).collect()))
    assert rows(map(tuple, dedup.trimmed_cues(w, 9).select(w.columns).collect())) == rows(map(tuple, dedup.trimmed_cues(w).select(w.columns).collect()))
    # No segment, and so no task after it, holds more than a share of the long stream.
    sizes = [x["count"] for x in scan.segments(df, "stream_id", [F.col("ts"), F.col("window_id")], 12).groupBy("stream_id", scan.SEG).count().collect()]
    assert max(sizes) < 1200 / 4 and sum(sizes) == 1200
    assert scan.parts_for(df, "stream_id") is None and scan.parts_for(df, "stream_id", 100) == 12 and scan.parts_for(df.limit(0), "stream_id") is None
    assert scan.running_sum(df.limit(0), "stream_id", [F.col("ts")], F.col("n"), "s", 4).count() == 0


@pytest.mark.parametrize("name", sorted(set(engine.Q) - set(engine.SQL)))
def test_query_without_sql_runs(spark, name):
    """Queries that SQL can't express run over whole tables; their rules are tested below."""
    found = engine.Q[name](spark, SF)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_names_are_used_once():
    with pytest.raises(ValueError, match="two queries"):
        engine.query()(engine.Q["knn_top15"])


def test_stream_equals_batch(spark, tmp_path):
    from confluo.sources import adapters
    from confluo.streaming import pipelines

    src = str(tmp_path / "in")
    adapters.llm_requests(spark, SF).write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = str(tmp_path / "out")
    pipelines.run_once(pipelines.health_per_minute(pipelines.source(spark, src, schema)), str(tmp_path / "cp"), lambda df, _: df.write.mode("append").parquet(out), "append")
    got = spark.read.parquet(out).count()
    want = spark.read.parquet(src).selectExpr("date_trunc('minute', ts) m", "plugin").distinct().count()
    assert 0 < got <= want and got >= want - 2  # the watermark still holds the last minute


def streamed(spark, tmp_path, parts, make, name):
    """What ``make`` gives over files that come one a micro-batch, with a last one that moves the watermark if there is one."""
    from confluo.streaming import pipelines

    src, out = str(tmp_path / name), str(tmp_path / f"{name}-out")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(src)
    df = make(pipelines.source(spark, src, parts[0].schema, 1))
    pipelines.run_once(df, str(tmp_path / f"{name}-cp"), lambda b, _: b.write.mode("append").parquet(out), "append")
    return spark.read.parquet(out)


def test_stateful_windows_and_speakers(spark, tmp_path):
    """State carried over micro-batches gives what the batch operators give."""
    from confluo.sources import adapters
    from confluo.streaming import pipelines

    w = adapters.transcription_windows(spark, SF)
    cuts = [w.where("window_id < 3"), w.where("window_id between 3 and 4"), w.where("window_id > 4")]
    got = streamed(spark, tmp_path, cuts, lambda s: pipelines.count_windows(s, 2), "w")
    cols = ["stream_id", "summary_id", "text", "ts_start", "ts_end"]
    assert rows(map(tuple, got.select(*cols).collect())) == rows(map(tuple, context.count_windows(w, 2).select(*cols).collect()))
    t = adapters.speaker_turns(spark, SF).where("stream_id < 2")
    cuts = [t.where("turn_id % 100 < 30"), t.where("turn_id % 100 >= 30")]
    got = streamed(spark, tmp_path, cuts, pipelines.online_speakers, "t")
    cols = ["stream_id", "turn_id", "speaker", "confidence"]
    batch = cluster.online_speakers(t, "stream_id").select(*cols).collect()
    assert rows(map(tuple, got.select(*cols).collect())) == rows(map(tuple, batch)) and len({r.speaker for r in batch}) > 3


def test_windows_joins_and_actions_streamed(spark, tmp_path):
    from confluo.streaming import pipelines

    base = spark.range(0, 120).selectExpr("id % 2 as stream_id", "timestamp_seconds(1700000000 + id) as ts", "id / 100.0 as sample", "id as window_id", "concat('Do ', cast(id % 7 as string), '.') as text")
    late = spark.range(1).selectExpr("9 as stream_id", "timestamp_seconds(1700000000 + 90000) as ts", "0.0 as sample", "999 as window_id", "'end' as text").select(*[F.col(f.name).cast(f.dataType) for f in base.schema])
    for make, seconds, stride in ((pipelines.tumbling_energy, 10, 10), (pipelines.sliding_energy, 2.5, 2)):
        got = streamed(spark, tmp_path, [base.where("window_id < 60"), base.where("window_id >= 60"), late], make, make.__name__)
        want = base.groupBy("stream_id", F.window("ts", f"{int(seconds * 1000)} milliseconds", f"{stride * 1000} milliseconds")).count().select("stream_id", "window.start", "count")
        assert rows(map(tuple, got.where("stream_id < 9").select("stream_id", "start", "n").collect())) == rows(map(tuple, want.collect()))
    got = streamed(spark, tmp_path, [base.where("window_id < 60"), base.where("window_id >= 60")], pipelines.first_actions, "a")
    assert sorted(r.norm for r in got.collect()) == sorted([f"do {k}" for k in range(7)] * 2)
    src = str(tmp_path / "both")
    base.write.parquet(src)
    both = lambda s: pipelines.rendezvous(s, pipelines.source(spark, src, base.schema).where("window_id % 3 = 0"))
    assert streamed(spark, tmp_path, [base.where("window_id < 60"), base.where("window_id >= 60")], both, "r").count() == 40


def test_truncated_answers(spark):
    """Whole answers, cut ones with a whole, a failed and a cut retry, and null contexts."""
    rows = [("abcd", "one", 5, "two", 5), ("abcd", "one", 10, "two", 5), ("abcde", "one", 11, None, 5), ("abcd", "one", 10, "two", 10), ("abcd", "one", 10, "two", None), (None, "one", 10, "two", 9), ("abcd", "one", None, "two", 9)]
    t = spark.createDataFrame(rows, "p string, a string, n long, b string, m long")
    got = t.select(T.after_truncation(*(F.col(c) for c in "panbm"), 10).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("abcd", "one"), ("ab", "two"), ("ab", ""), ("ab", ""), ("ab", ""), ("", "two"), ("abcd", "one")]


def test_segments_text(spark):
    t = spark.createDataFrame([([("a",), (None,), ("",), ("b c",), (" ",)],), ([],), (None,)], "s array<struct<text: string>>")
    assert [r[0] for r in t.select(T.segments_text(F.col("s"))).collect()] == ["a b c  ", "", None]


def test_diagnostics(spark):
    """Each figure of a stream's diagnostics from its turns, in plain Python; nobody known and scores of zero included."""
    rnd = random.Random(3)
    rows = [(s, n, k, 0.0 if k < 0 else rnd.choice([0.0, round(rnd.random(), 3)]), -1 if k < 0 else k // 2) for s in (1, 2) for n in range(70) for k in [rnd.randrange(-1, 5)]]
    rows += [(3, n, -1, 0.0, -1) for n in range(3)]
    got = {r.stream_id: r for r in service_ops.diagnostics(spark.createDataFrame(rows, "stream_id long, turn_id long, speaker long, confidence double, final long"), {"threshold": 0.71}).collect()}
    for s in (1, 2, 3):
        known = [r for r in rows if r[0] == s and r[2] >= 0]
        scores = np.array([r[3] for r in known if r[3]])
        r, n = got[s], max(1, len({x[4] for x in known}))
        assert (r.speakers, r.turns, r.samples, r.unknown) == (len({x[4] for x in known}), 70 if s < 3 else 3, len(known), sum(x[0] == s and x[2] < 0 for x in rows))
        assert r.mean_samples == len(known) / n and r.merged == len({x[2] for x in known if x[2] != x[4]}) and r.timeline == [x[2] for x in known[-50:]]
        assert r.low_confidence_rate == sum(x[3] < 0.65 for x in known) / max(1, len(known)) and r.config.threshold == 0.71
        assert np.isclose(r.confidence, np.mean([x[3] for x in known[-20:]]) if known else 1.0)
        if not known:
            assert r.scores is None
            continue
        want = [len(scores), scores.mean(), scores.std(), scores.min(), scores.max(), *np.percentile(scores, [25, 50, 75])]
        assert np.allclose(list(r.scores), want)


def held_against_sql(spark, folder, name):
    """(rows of the query, rows of its SQL) over the tables in ``folder``."""
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    got, want = engine.Q[name](spark, str(folder)), c.sql(engine.SQL[name])
    return rows(tuple(r) for r in got.select(*want.columns).collect()), rows(want.fetchall())


def test_types_of_windows_at_one_time(spark, tmp_path):
    """Of windows of one time, a change counts from its own window on."""
    kinds = "['view', 'signup', 'click', 'purchase', 'view']"
    duckdb.sql(f"""copy (select i as event_id, timestamp '2024-01-01' + interval (i // 4) second as ts, i as user_id, ({kinds})[1 + i * i % 5] as event_type,
    1.5::double as value, '' as props from range(400) t(i)) to '{tmp_path}/events.parquet'""")
    got, want = held_against_sql(spark, tmp_path, "long_stream_types")
    assert len(got) == 400 and got == want


def test_cleanup_of_texts_that_hold_a_phrase(spark, tmp_path):
    """Only the planted lines go from ``lines``; without an item that is timed ``timed`` is null."""
    texts = ["It was an ain thing.\nThen more", "the output format", None, "x [0:00:00 - 0:00:00]", "", "a\n\nb", "This was an aim"]
    c = duckdb.connect()
    c.execute("create table t (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into t values (1, ?, 'user', ?)", [(k, x) for k, x in enumerate(texts + texts[1:] + texts[:2])])
    c.sql(f"copy t to '{tmp_path}/conversations.parquet'")
    got, want = held_against_sql(spark, tmp_path, "text_cleanup")
    assert len(got) == 15 and got == want


def test_leaked_lines_go(spark):
    """The general phrases, which text_cleanup doesn't use as its SQL keeps texts that hold one."""
    for phrase in T.LEAK_PHRASES:
        t = spark.createDataFrame([(f"first\nso {phrase.upper()} said\nlast",)], "t string")
        assert t.select(T.drop_lines_with(F.col("t"))).first()[0] == "first\nlast"

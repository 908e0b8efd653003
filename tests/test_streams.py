"""Streams that are recomputed, delivered, merged and ended: each against its batch form or plain Python."""

import collections
import contextlib
import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from confluo.operators import cluster, joins, resample
from confluo.sources import adapters
from confluo.streaming import delivery, formatting, pipelines, retries, speakers, types_in_force

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in found)


def stream_of(seed, streams=3, windows=14):
    """Windows whose text repeats the end of the one before, some blank, and changes of type, some unknown."""
    r = random.Random(seed)
    word = lambda: r.choice(["so", "we", "go", "on", "and", "then", "it", "is", "late", "now"])
    w, c = [], []
    for s in range(streams):
        text = []
        for k in range(windows):
            text = [*text[-r.randint(0, 4) :], *[word() for _ in range(r.randint(2, 8))]] if text else [word() for _ in range(5)]
            w.append((s, k, " ".join(text) if r.random() < 0.9 else r.choice(["", None, "  "]), k * 2.0, k * 2.0 + 2.5))
            if r.random() < 0.3:
                c.append((s, k, int(k * 2000), r.choice(["PODCAST", "DEBATE", "UNKNOWN"])))
    return w, c


def formatted_in_python(windows, changes):
    """The rule as a loop over one stream after another."""
    out = {}
    for s in sorted({w[0] for w in windows}):
        mine = sorted((c[2], c[1], c[3]) for c in changes if c[0] == s)
        for _, k, text, start, _ in sorted(w for w in windows if w[0] == s):
            if not (text or "").strip():
                continue
            kind = next((c[2] for c in reversed(mine) if c[0] <= int(start * 1000)), "UNKNOWN")
            if kind == "UNKNOWN" and mine:
                kind = mine[-1][2]
            tail = out[s, k - 1][1][-1000:] if (s, k - 1) in out else ""
            out[s, k] = (kind, formatting.plain(text.strip(), kind, tail))
    return sorted((*key, *v) for key, v in out.items())


def found(df):
    return sorted(tuple(r) for r in df.select("stream_id", "window_id", "content_type", "formatted").collect())


@pytest.mark.parametrize("seed", range(2))
def test_recompute_in_any_order(spark, tmp_path, seed):
    """Shuffled windows and changes in batches, one of them twice, end in the batch result; each batch writes a stream from one window on."""
    w, c = stream_of(seed)
    want = formatted_in_python(w, c)
    windows, changes = spark.createDataFrame(w, formatting.WINDOWS), spark.createDataFrame(c, formatting.CHANGES)
    assert found(formatting.format_windows(windows, changes)) == want
    r, root = random.Random(seed), str(tmp_path / "state")
    events = [("w", x) for x in w] + [("c", x) for x in c]
    r.shuffle(events)
    cuts = sorted(r.sample(range(1, len(events)), 3))
    seen_w, seen_c, before = [], [], []
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(events)])):
        part = events[a:b]
        new_w, new_c = [x for k, x in part if k == "w"], [x for k, x in part if k == "c"]
        give = (spark.createDataFrame(new_w, formatting.WINDOWS), spark.createDataFrame(new_c, formatting.CHANGES))
        formatting.recompute(spark, root, batch, *give)
        if batch == 1:
            formatting.recompute(spark, root, batch, *give)
        seen_w, seen_c = seen_w + new_w, seen_c + new_c
        now = formatted_in_python(seen_w, seen_c)
        assert found(formatting.current(spark, root)) == now
        written = spark.read.parquet(f"{root}/formatted/batch={batch}")
        if written.columns:
            got = {tuple(x) for x in written.select("stream_id", "window_id").collect()}
            for s in range(3):
                # All windows from the first that differs on, and none before it.
                differs = {x[1] for x in set(now) ^ set(before) if x[0] == s}
                mine = {k for t, k in got if t == s}
                assert differs <= mine and (not mine or mine >= {x[1] for x in now if x[0] == s and x[1] >= min(mine)})
        before = now
    assert before == want


def test_recompute_leaves_the_rest(spark, tmp_path):
    """A late change in the middle of one stream rewrites that stream from there on; a window that loses its text goes."""
    w, _ = stream_of(5, windows=8)
    w = [(s, k, f"text {s} {k}", a, b) for s, k, _, a, b in w]
    root = str(tmp_path / "state")
    first = [(s, 0, 0, "PODCAST") for s in range(3)]
    formatting.recompute(spark, root, 0, spark.createDataFrame(w, formatting.WINDOWS), spark.createDataFrame(first, formatting.CHANGES))
    formatting.recompute(spark, root, 1, None, spark.createDataFrame([(1, 5, 10000, "DEBATE")], formatting.CHANGES))
    rewritten = spark.read.parquet(f"{root}/formatted/batch=1").select("stream_id", "window_id").collect()
    assert sorted(map(tuple, rewritten)) == [(1, 5), (1, 6), (1, 7)]
    formatting.recompute(spark, root, 2, spark.createDataFrame([(2, 6, "", 12.0, 14.5)], formatting.WINDOWS))
    left = [x for x in w if x[:2] != (2, 6)]
    assert found(formatting.current(spark, root)) == formatted_in_python(left, [*first, (1, 5, 10000, "DEBATE")])
    # A batch that nobody committed isn't seen.
    delivery.put(spark.createDataFrame([(0, 0, "x", 0, 0, "X", "x", 0)], formatting.FORMATTED + ", folder int"), root, "formatted", 9, "folder")
    assert all(r.content_type != "X" for r in formatting.current(spark, root).collect())


def test_recompute_streamed(spark, tmp_path):
    """Over files, one a micro-batch, with windows and changes in one stream."""
    w, c = stream_of(8, streams=2, windows=9)
    tagged = [(*x, None) for x in w] + [(s, k, None, ms / 1000.0, None, kind) for s, k, ms, kind in c]
    random.Random(1).shuffle(tagged)
    src, root = str(tmp_path / "in"), str(tmp_path / "state")
    schema = formatting.WINDOWS + ", change string"
    for k in range(0, len(tagged), 12):
        spark.createDataFrame(tagged[k : k + 12], schema).coalesce(1).write.mode("append").parquet(src)
    s = pipelines.source(spark, src, spark.read.parquet(src).schema, 1)
    pipelines.run_once(s, str(tmp_path / "cp"), formatting.each_batch(root))
    assert found(formatting.current(spark, root)) == formatted_in_python(w, c)


def test_two_channels(spark, tmp_path):
    """A batch that runs twice, the second time with other rows, leaves one copy; bad rows go to the second channel."""
    root = str(tmp_path / "out")
    df = lambda x: spark.createDataFrame(x, "event_id long, payload string")
    each = delivery.two_channels(root, F.get_json_object("payload", "$.type").isNotNull())
    good, bad, null = (1, '{"type": "a"}'), (2, "broken"), (3, None)
    each(df([good, bad, null]), 0)
    each(df([(4, '{"type": "b"}')]), 1)
    each(df([good, bad, null]), 0)
    each(df([(4, '{"type": "b"}')]), 1)
    fields = df([good]).schema
    read = lambda name: sorted((r.event_id, r.batch) for r in delivery.committed(spark, root, name, fields).collect())
    assert read("data") == [(1, 0), (4, 1)] and read("monitoring") == [(2, 0), (3, 0)]
    delivery.put(df([good]), root, "data", 7)
    assert read("data") == [(1, 0), (4, 1)]
    assert delivery.committed(spark, str(tmp_path / "nothing"), "data", fields).count() == 0
    assert [r.event_id for r in delivery.committed(spark, root, "data", fields, before=1).collect()] == [1]


def lines(turns):
    """Turns as the operator's rows, in plain Python."""
    names = StructType.fromDDL(speakers.ROWS).names
    return [dict(zip(names, r)) for r in speakers.turn_rows(turns).orderBy("stream_id", "ts", "turn_id").collect()]


@contextlib.contextmanager
def state_store(spark):
    before = spark.conf.get(speakers.STORE[0], None)
    spark.conf.set(*speakers.STORE)
    try:
        yield
    finally:
        spark.conf.unset(speakers.STORE[0]) if before is None else spark.conf.set(speakers.STORE[0], before)


def through(spark, tmp_path, name, schema, parts, make):
    """What ``make`` gives over rows that come a part at a time, and the folder of its state."""
    src, out, cp = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "cp"))
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    with state_store(spark):
        df = make(pipelines.source(spark, src, StructType.fromDDL(schema), 1))
        pipelines.run_once(df, cp, lambda b, _: b.write.mode("append").parquet(out))
    return spark.read.schema(df.schema).parquet(out), cp


def heard(spark, tmp_path, name, parts, **kw):
    """What the streamed operator gives over files, one a micro-batch, and how many keys its state has at the end."""
    names = StructType.fromDDL(speakers.ROWS).names
    got, cp = through(spark, tmp_path, name, speakers.ROWS, [[tuple(r[f] for f in names) for r in p] for p in parts], lambda s: speakers.speakers(s, **kw))
    with state_store(spark):
        left = {v: spark.read.format("statestore").option("stateVarName", v).load(cp).count() for v in ("speakers", "moves", "counters")}
    return sorted(map(tuple, got.collect()), key=str), left


def heard_in_python(rows):
    """The same by one clusterer a stream, without state or batches."""
    out, by = [], {}
    for r in rows:
        s = r["stream_id"]
        c = by.setdefault(s, cluster.Clusterer())
        if r["kind"] == "turn":
            k, sure = c.identify(np.asarray(r["v"], float), r["start"], r["start"], r["end"], r["chunk"], r["label"], r["is_overlap"], r["is_onset"], r["duration"])
            out.append((s, "turn", r["turn_id"], -1 if k is None else k, None, round(sure, 6), None, 1))
        elif r["kind"] == "merge" and not c.merge_by_hand(r["target"], r["source"]):
            out.append((s, "warning", None, r["target"], r["source"], None, "unknown speaker", 1))
        elif r["kind"] == "end":
            c.consolidate()
            out += [(s, "ended", None, None, None, None, "end", c.seen), *log_of(s, c)]
            del by[s]
    return out + [x for s, c in by.items() for x in log_of(s, c)]


def log_of(s, c):
    return [(s, "merge", None, kept, lost, None, None, 1) for lost, kept in c.merges] + [(s, "invalid", None, None, None, None, rule, n) for rule, n in c.invalid.items()]


def added_up(found):
    """Rows with the drained counts of broken rules summed by stream."""
    total = collections.Counter()
    for r in found:
        total[r[:7]] += r[7]
    return sorted(((*k, n) for k, n in total.items()), key=str)


def control(stream, kind, at, target=None, source=None):
    return dict.fromkeys(StructType.fromDDL(speakers.ROWS).names) | {"stream_id": stream, "kind": kind, "ts": at, "target": target, "source": source}


def test_speakers_with_merges_and_end(spark, tmp_path):
    """Any cut gives the same turns and logs; a merge by hand changes later turns; an end leaves no state behind."""
    t = adapters.speaker_turns(spark, "/root/testdata/sf0.001").where("stream_id < 2")
    every = lines(t)
    for r in every[5::29]:
        r["v"] = [0.0] * len(r["v"])
    mine = [r for r in every if r["stream_id"] == 0]
    at = mine[60]["ts"]
    ids = sorted({x[3] for x in heard_in_python(mine[:60]) if x[1] == "turn" and x[3] >= 0})
    merge = [control(0, "merge", at, ids[0], ids[1]), control(0, "merge", at, 77, ids[0])]
    last = max(r["ts"] for r in every) + datetime.timedelta(seconds=1)
    ends = [control(s, "end", last) for s in (0, 1)]
    plain = heard_in_python(every)
    whole = sorted([*mine[:61], *merge, *mine[61:], *[r for r in every if r["stream_id"] == 1]], key=lambda r: (r["ts"], {"turn": 0, "merge": 1}[r["kind"]])) + ends
    want = heard_in_python(whole)
    assert sorted(map(str, plain)) != sorted(map(str, want)) and any(x[1] == "warning" for x in want) and any(x[1] == "invalid" for x in want)
    for k, cuts in enumerate(([], [40, 90, 91, 150])):
        parts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)])]
        got, left = heard(spark, tmp_path, f"c{k}", parts)
        assert added_up(got) == added_up(want)
        assert left == {"speakers": 0, "moves": 0, "counters": 0}
    # Without the ends the state is there: the same operator, one micro-batch less.
    got, left = heard(spark, tmp_path, "open", [whole[:-2]])
    assert left["speakers"] > 2 and left["counters"] == 2 and added_up(got) == added_up(heard_in_python(whole[:-2]))


def test_speakers_expire(spark, tmp_path):
    """A stream whose last turn lies a lifetime behind the watermark is consolidated and forgotten; one that goes on isn't."""
    t = adapters.speaker_turns(spark, "/root/testdata/sf0.001").where("stream_id < 2")
    every = lines(t)
    old, new = [r for r in every if r["stream_id"] == 0], [r for r in every if r["stream_id"] == 1]
    late = [r | {"ts": r["ts"] + datetime.timedelta(hours=2)} for r in new[:50]]
    # The watermark that a batch moves counts from the next one on.
    more = [[r | {"ts": r["ts"] + datetime.timedelta(hours=2)}] for r in new[50:53]]
    got, left = heard(spark, tmp_path, "x", [old, late, *more], lifetime=3600 * 1000)
    ended = [r for r in got if r[1] == "ended"]
    assert [(r[0], r[6], r[7]) for r in ended] == [(0, "lifetime", len(old))]
    assert left["counters"] == 1 and sum(r[1] == "turn" for r in got) == len(old) + 53
    c = cluster.Clusterer()
    for r in old:
        c.identify(np.asarray(r["v"], float), r["start"], r["start"], r["end"], r["chunk"], r["label"], r["is_overlap"], r["is_onset"], r["duration"])
    c.consolidate()
    assert sorted((r[4], r[3]) for r in got if r[0] == 0 and r[1] == "merge") == sorted(c.merges)


def test_types_in_force_streamed(spark, tmp_path):
    """Windows and changes shuffled within the watermark's delay give what the batch join gives; changes that can't matter are forgotten."""
    r, base = random.Random(3), 1_700_000_000_000
    windows = [(s, k, base + k * 2000 + r.randrange(3) * 500, None) for s in range(3) for k in range(60)] + [(1, 5, base + 11000, None)]
    changes = [(s, k, base + r.randrange(60) * 2000, r.choice("ABC")) for s in range(3) for k in range(12)]
    want = joins.type_in_force(
        spark.createDataFrame([w[:3] for w in windows], "stream_id long, window_id long, ms long"),
        spark.createDataFrame(changes, "stream_id long, change_window long, start_ms long, content_type string"), False,
    )
    # Each row is late by up to 20 seconds of event time; the delay is 30, and the last rows push the watermark.
    every = sorted([*windows, *changes], key=lambda x: x[2] + r.randrange(20000))
    ends = [(s, 1000 + j, base + 10**6 + j, None) for j in range(2) for s in range(3)]
    cuts = [0, 30, 31, 90, 160, len(every)]
    parts = [every[a:b] for a, b in zip(cuts, cuts[1:])] + [ends[:3], ends[3:]]

    def make(s):
        w = s.where("content_type is null").select("stream_id", "window_id", "ms")
        c = s.where("content_type is not null").select("stream_id", F.col("window_id").alias("change_window"), F.col("ms").alias("start_ms"), "content_type")
        return types_in_force.types_in_force(w, c, "30 seconds")

    got, cp = through(spark, tmp_path, "t", "stream_id long, window_id long, ms long, content_type string", parts, make)
    cols = ["stream_id", "window_id", "ms", "content_type"]
    assert rows(map(tuple, got.where("window_id < 1000").select(*cols).collect())) == rows(map(tuple, want.select(*cols).collect()))
    with state_store(spark):
        assert spark.read.format("statestore").option("stateVarName", "changes").load(cp).count() == 3


def direct(x, rate_in, rate_out):
    """Convolution with the windowed sinc, sample by sample."""
    share = min(1.0, rate_out / rate_in)
    k = np.arange(len(x))
    out = []
    for m in range(-(-len(x) * rate_out // rate_in)):
        t = m * rate_in / rate_out - k
        w = np.where(np.abs(t) < resample.HALF / share, 0.5 + 0.5 * np.cos(np.pi * t * share / resample.HALF), 0.0)
        out.append(float((x * share * np.sinc(share * t) * w).sum()))
    return np.array(out)


def framed(x, stream, sizes):
    at = np.r_[0, np.cumsum(sizes)]
    return [(stream, k, x[a:b].tolist()) for k, (a, b) in enumerate(zip(at, at[1:]))]


def joined(df, stream):
    got = sorted((r["first"], r["samples"]) for r in df.where(f"stream_id = {stream}").collect())
    at = 0
    for first, samples in got:
        assert first == at
        at += len(samples)
    return np.concatenate([s for _, s in got]) if got else np.zeros(0)


def test_resample(spark, tmp_path, monkeypatch):
    """Sines at 44.1, 48 and 8 kHz to 16 kHz: equal to direct convolution and close to the sine, for any frames, in blocks and as a stream."""
    r, schema = random.Random(4), "stream_id long, frame_id long, samples array<double>"
    for rate, n in ((44100, 3000), (48000, 3000), (8000, 700)):
        x = np.sin(2 * np.pi * 440 * np.arange(n) / rate)
        want = direct(x, rate, 16000)
        sine = np.sin(2 * np.pi * 440 * np.arange(len(want)) / 16000)
        assert np.abs(want - sine)[60:-60].max() < 2e-3
        cuts = []
        while sum(cuts) < n:
            cuts.append(min(n - sum(cuts), r.choice([0, 1, 7, 160, 441, 900])))
        data = framed(x, 1, [n]) + framed(x, 2, cuts)
        df = spark.createDataFrame([*data, (3, 0, None), (3, 1, [])], schema)
        for block in (1 << 16, 700):
            monkeypatch.setattr(resample, "BLOCK", block)
            got = resample.resample(df, rate, parts=None if block > 700 else 3)
            assert np.allclose(joined(got, 1), want, atol=1e-12) and np.allclose(joined(got, 2), want, atol=1e-12) and not len(joined(got, 3))
        ends = [(1, 10**6, None), (2, 10**6, None)]
        whole = sorted([*data, *ends], key=lambda f: f[1])
        parts = [whole[:3], whole[3:9], whole[9:]] if rate == 44100 else [whole]
        streamed, cp = through(spark, tmp_path, f"r{rate}", schema, [p for p in parts if p], lambda s, rate=rate: resample.resample_stream(s, rate))
        assert np.allclose(joined(streamed, 1), want, atol=1e-12) and np.allclose(joined(streamed, 2), want, atol=1e-12)
        with state_store(spark):
            assert spark.read.format("statestore").option("stateVarName", "held").load(cp).count() == 0


def test_retries(spark, tmp_path):
    """Three failures wait, the fourth is given up; hopeless errors at once; a success takes all that waited; streams don't mix."""

    def flaky(payloads):
        """Errors as the payloads say: the worst of what is waiting."""
        if "hopeless" in payloads:
            return "Error: maximum context length is 8192"
        return "timeout" if payloads and payloads[-1] == "bad" else None

    tries = [["ok", "bad", "bad", "ok", "bad", "hopeless", "ok"], ["bad"] * 9 + ["ok"], ["bad", "bad", "bad", "ok", "bad"]]
    parts = [[(s, 10 * k + j, p) for s, t in enumerate(tries) if k < len(t) for j, p in enumerate(["x", t[k]])] for k in range(10)]
    want = []
    for s, t in enumerate(tries):
        waiting, failures = [], 0
        for k, p in enumerate(t):
            waiting += [(10 * k, "x"), (10 * k + 1, p)]
            error = flaky([x for _, x in waiting])
            failures += error is not None
            keep = error == "timeout" and failures <= 3
            want += [(s, i, "waits" if keep else "dead" if error else "done", failures, error) for i, _ in waiting]
            if not keep:
                waiting, failures = [], 0
    got, cp = through(spark, tmp_path, "r", "stream_id long, item_id long, payload string", parts, lambda s: retries.retried(s, flaky))
    assert rows(map(tuple, got.collect())) == rows(want) and {x[2] for x in want} == {"waits", "dead", "done"}
    last = {(s, i): o for s, i, o, _, _ in want}
    with state_store(spark):
        assert spark.read.format("statestore").option("stateVarName", "failures").load(cp).count() == 1
    assert sum(o == "waits" for o in last.values()) == 2

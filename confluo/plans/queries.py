"""The engine's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.functions import repetition, text as T
from confluo.operators import cluster, context, dedup, health, joins, neighbours, rules, scan, vectors
from confluo.sources import adapters as A
from confluo.sources import sinks

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The adapters in SQL.
TW = "tw as (select conv_id as stream_id, turn as window_id, text, turn * 2.0::double as ts_start, turn * 2.0::double + 2.5::double as ts_end, role as speaker from conversations)"
SW = TW + """, g as (select *, (row_number() over (partition by stream_id order by window_id) - 1) // 2 as summary_id from tw),
sw as (select stream_id, summary_id, string_agg(text, ' ' order by ts_start, window_id) as text, min(ts_start) as ts_start, arg_max(ts_end, ts_start) as ts_end, length(string_agg(text, ' ' order by ts_start, window_id)) as char_count from g group by 1, 2 having count(*) = 2)"""
REQ = """req as (select event_id, user_id as stream_id, ts, case when event_type in ('view', 'click') then 'rapid_summary' else 'context_summary'
end as plugin,
case when event_type in ('view', 'click') then 'fast' else 'reasoning' end as model_type, event_type <> 'error' as success,
case when event_type = 'error' then case event_id % 3 when 0 then 'parse_failure' when 1 then 'timeout_failure' else 'truncation_failure'
end end as failure_type from events)"""
COUNTS = """count(*) as total, count(*) filter (success) as ok, count(*) filter (failure_type = 'parse_failure') as parse_failure, count(*) filter
(failure_type = 'timeout_failure') as timeout_failure,
count(*) filter (failure_type = 'truncation_failure') as truncation_failure, round(100.0::double * count(*) filter (success) / count(*),
2) as rate"""
SEC = TW + ", sec as (select stream_id, window_id, window_id * 2000 as start_ms, window_id * 2000 + 5000 + length(text) % 3 * 2000 as end_ms, substr(text, 1, 12) as heading, text as content from tw)"
INS = TW + """, ins as (select stream_id, window_id // 2 as window_id, window_id as insight_id, (['KEY POINT', 'ACTION', 'DECISION', 'QUESTION', 'RISK', 'SENTIMENT', 'PARTICIPANTS', 'NOTES'])[length(text) % 8 + 1] as insight_type,
text as insight_text, length(text) % 100 / 100.0::double as confidence, case when window_id % 3 <> 0 then window_id - 1 end as continuation_of,
case when window_id % 6 = 3 then window_id - 2 end as correction_of, 'class ' || (window_id % 4) as classification from tw)"""
CHG = TW + ", chg as (select stream_id, window_id as change_window, (ts_start * 1000)::bigint as start_ms, ([" + ", ".join(f"'{c}'" for c in A.CONTENT_TYPES) + "])[(stream_id + window_id) % 11 + 1] as content_type from tw where window_id % 3 = 0)"
VEC = "vec as (select vec_id, embedding::double[] as v, label::bigint as label, vec_id // 10 as chunk_id from embeddings)"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in Q:
            raise ValueError(f"two queries are named {f.__name__}")
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sw(spark, d):
    return context.count_windows(A.transcription_windows(spark, d), 2)


@query(f"""with {SW}, k as (select *, sum(char_count) over (partition by stream_id order by summary_id desc rows unbounded preceding) as s,
row_number() over (partition by stream_id order by summary_id desc) as rn from sw) select stream_id, min(ts_start) as first_start,
arg_max(ts_end, summary_id) as last_end, sum(char_count)::bigint as chars, count(*) as windows, sum(char_count) < 500 as is_minimal from k
where s <= 1500 or rn = 1 group by 1""")
def summary_window_availability(spark, d):
    return context.availability(context.retain(_sw(spark, d), 1500))


@query(f"with {SW} select stream_id, summary_id, text, ts_start, ts_end, char_count from sw")
def summary_windows(spark, d):
    return _sw(spark, d).drop("n_windows")


@query(f"""with {TW}, b as (select *, coalesce(sum(length(text)) over (partition by stream_id order by window_id desc rows between unbounded
preceding and 1 preceding), 0) as p from tw) select stream_id, string_agg(text, ' ' order by window_id) as text, count(*) as n from b
where p < 600 group by 1""")
def recent_text_budget(spark, d):
    r = context.recent(A.transcription_windows(spark, d), 600)
    return r.groupBy("stream_id").agg(context.ordered_text("text", "window_id").alias("text"), F.count("*").alias("n"))


@query(f"""with recursive {TW}, o as (select stream_id, window_id, length(text) // 4 as cost, row_number() over (partition by stream_id order by
window_id desc) as rn from tw),
f as (select stream_id, 0::bigint as rn, 0::bigint as used, ''::varchar as ids from (select distinct stream_id from tw) union all
select f.stream_id, o.rn, case when f.used + o.cost <= 150 then f.used + o.cost else f.used end, case when f.used + o.cost <= 150 then
case when f.ids = '' then o.window_id::varchar else o.window_id::varchar || ',' || f.ids end else f.ids end from f join o on o.stream_id =
f.stream_id and o.rn = f.rn + 1)
select stream_id, arg_max(used, rn) as tokens_used, arg_max(ids, rn) as window_ids from f group by 1""")
def token_budget_fold(spark, d):
    f = context.budget_fold(A.transcription_windows(spark, d), ["stream_id"], "window_id", F.floor(F.length("text") / 4), 150)
    ids = F.array_join(F.transform(F.array_sort("taken"), lambda i: i.cast("string")), ",")
    return f.select("stream_id", F.col("used").alias("tokens_used"), ids.alias("window_ids"))


@query(f"with {TW} select stream_id, string_agg(text, ' ' order by window_id) as text, count(*) as n from tw where ts_end >= 6.0 group by 1")
def summary_since(spark, d):
    return context.since(A.transcription_windows(spark, d), 6.0, True).groupBy("stream_id").agg(context.ordered_text("text", "window_id").alias("text"), F.count("*").alias("n"))


@query(f"with {TW} select stream_id, window_id, ts_start, ts_end from tw where ts_start >= 6.0")
def transcription_since(spark, d):
    return context.since(A.transcription_windows(spark, d), 6.0, False).select("stream_id", "window_id", "ts_start", "ts_end")


@query(f"with {TW} select stream_id, window_id, ts_start, ts_end from tw where ts_start < 8.0 and ts_end > 4.0")
def segment_time_range(spark, d):
    return context.between(A.transcription_windows(spark, d), 4.0, 8.0).select("stream_id", "window_id", "ts_start", "ts_end")


@query(f"""with {TW}, l as (select *, min(ts_start) over (partition by stream_id) as f from tw), n as (select *, row_number() over (partition by
stream_id order by window_id) as rn from l where ts_start - f >= 2.0) select stream_id, window_id from n where rn % 2 = 0""")
def every_nth_window(spark, d):
    return context.every_nth(A.transcription_windows(spark, d), 2, 2.0).select("stream_id", "window_id")


@query(f"""with {TW}, n as (select *, row_number() over (partition by stream_id order by window_id) as rn from tw), p as (select * from n where rn %
3 = 0) select stream_id, window_id, coalesce(lag(window_id) over (partition by stream_id order by window_id) + 1, greatest(0, window_id -
2)) as from_id from p""")
def detection_range(spark, d):
    return context.detection_ranges(A.transcription_windows(spark, d), 3)


@query(f"""with {SEC}, l as (select *, max(end_ms) over (partition by stream_id) as m, row_number() over (partition by stream_id order by end_ms
desc, start_ms desc) as rn from sec) select stream_id, window_id, start_ms, end_ms, end_ms = m as is_latest from l where end_ms >= m -
4000 or rn = 1""")
def sliding_section_context(spark, d):
    s = context.sliding_sections(A.sections(spark, d), 4000)
    return s.select("stream_id", "window_id", "start_ms", "end_ms", (F.col("end_ms") == F.max("end_ms").over(W.partitionBy("stream_id"))).alias("is_latest"))


@query(f"with {REQ} select plugin, {COUNTS} from req group by 1")
def health_by_plugin(spark, d):
    return health.by(A.llm_requests(spark, d), "plugin")


@query(f"with {REQ} select plugin, model_type, {COUNTS} from req group by grouping sets ((plugin), (model_type), ())")
def health_breakdowns(spark, d):
    return health.breakdowns(A.llm_requests(spark, d))


@query(f"with {REQ} select date_trunc('minute', ts)::timestamp as minute, {COUNTS} from req group by 1")
def health_per_minute(spark, d):
    return health.per_minute(A.llm_requests(spark, d)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(f"with {REQ} select stream_id, {COUNTS} from req group by 1")
def health_by_stream(spark, d):
    return health.by(A.llm_requests(spark, d), "stream_id")


@query("""with f as (select user_id as stream_id, (floor(epoch(ts))::bigint - 1704067200) // 60 as win, avg((value / 500) * (value / 500)) as ms
from events group by 1, 2) select stream_id, win, round(20 * log10(greatest(sqrt(ms), 1e-12)), 6) as dbfs from f where 20 *
log10(greatest(sqrt(ms), 1e-12)) >= -45""")
def frame_dbfs_gate(spark, d):
    f = A.frames(spark, d).groupBy("stream_id", F.floor(F.col("media_s") / 60).alias("win")).agg(F.avg(F.col("sample") * F.col("sample")).alias("ms"))
    level = T.dbfs(F.col("ms"))
    return f.where(level >= -45).select("stream_id", "win", F.round(level, 6).alias("dbfs"))


@query(f"""with {VEC}, c as (select vec_id, case when len(v) = 0 then 'empty' when list_max(list_transform(v, lambda x: abs(x))) <= 1e-8 then
'all_zeros' when {DOT.format(a='v', b='v')} < 1e-8 then 'zero_norm' when list_max(v) > 100 then 'extreme' when
sqrt({DOT.format(a='v', b='v')}) < 0.1 then 'low_norm' when list_sum(list_transform(v, lambda x: abs(x))) / len(v) < 1e-6 then 'low_mean'
when len(list_filter(v, lambda x: abs(x) <= 1e-8)) / len(v)::double > 0.5 then 'sparse' else 'valid' end as reason from vec) select
reason, count(*) as n from c group by 1""")
def embedding_validity(spark, d):
    return A.vectors(spark, d).select(vectors.validity(F.col("v")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""with {VEC}, j as (select q.vec_id as query_id, vec.vec_id, round(list_sum(list_transform(list_zip(vec.v, q.v), lambda p: (p[1] - p[2]) *
(p[1] - p[2]))), 6) as d from vec, (select vec_id, v from vec where vec_id % 100 = 0) q), r as (select *, row_number() over (partition by
query_id order by d, vec_id) as rank from j) select query_id, vec_id, d, rank::int as rank from r where rank <= 15""")
def knn_top15(spark, d):
    v = A.vectors(spark, d)
    return neighbours.nearest(v, v.where("vec_id % 100 = 0"), 15)


@query(f"""with {VEC}, j as (select vec.vec_id, min(list_sum(list_transform(list_zip(vec.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) as d
from vec, (select v from vec where vec_id % 100 = 0) q group by 1) select vec_id, round(d, 6) as d, 1 - d * d / 2 >= 0.35 as passes, 1 - d
/ 2 >= 0.35 as passes_cosine from j""")
def relevance_gate(spark, d):
    v = A.vectors(spark, d)
    m = neighbours.nearest_distance(v, v.where("vec_id % 100 = 0"))
    return m.select("vec_id", F.round("d", 6).alias("d"), vectors.relevance_gate(F.col("d")).alias("passes"), vectors.relevance_gate(F.col("d"), faithful=False).alias("passes_cosine"))


@query(f"""with {VEC}, m as (select label, i as dim, sum(v[i + 1] * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1) as m from vec, range(64) t(i) group by 1,
2) select label, dim::int as dim, round(m / sqrt(sum(m * m) over (partition by label)), 6) as x from m""")
def label_centroids(spark, d):
    return vectors.centroids(A.vectors(spark, d).withColumn("heard", F.col("vec_id") % 5 + 1), "label", "heard").withColumn("x", F.round("x", 6))


@query(f"""with {VEC} select a.chunk_id, a.vec_id as a, b.vec_id as b, round({DOT.format(a='a.v', b='b.v')} / (sqrt({DOT.format(a='a.v', b='a.v')}) *
sqrt({DOT.format(a='b.v', b='b.v')})), 6) as cos from vec a join vec b on a.chunk_id = b.chunk_id and a.vec_id < b.vec_id""")
def pairwise_cosine(spark, d):
    return vectors.pairs_within(A.vectors(spark, d), "chunk_id").withColumn("cos", F.round("cos", 6))


@query(f"""with {VEC}, p as (select a.chunk_id, {DOT.format(a='a.v', b='b.v')} / (sqrt({DOT.format(a='a.v', b='a.v')}) *
sqrt({DOT.format(a='b.v', b='b.v')})) as c from vec a join vec b on a.chunk_id = b.chunk_id and a.vec_id < b.vec_id) select chunk_id,
round(1 - avg(c), 6) as variance, round(min(c), 6) as least, round(avg(c), 6) as mean, round(stddev_pop(c), 6) as sd,
round(quantile_cont(c, 0.25), 6) as p25, round(quantile_cont(c, 0.5), 6) as p50, round(quantile_cont(c, 0.75), 6) as p75 from p group by 1""")
def intra_variance(spark, d):
    p = vectors.pairs_within(A.vectors(spark, d), "chunk_id")
    q = lambda x: F.round(F.percentile("cos", F.lit(x)), 6)
    return p.groupBy("chunk_id").agg(F.round(1 - F.avg("cos"), 6).alias("variance"), F.round(F.min("cos"), 6).alias("least"), F.round(F.avg("cos"), 6).alias("mean"), F.round(F.stddev_pop("cos"), 6).alias("sd"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))


@query(f"""with {VEC}, s as (select chunk_id, label as candidate, max(v[1]) as score from vec group by 1, 2), e as (select *, exp(score - max(score)
over (partition by chunk_id)) as e from s), p as (select *, e / sum(e) over (partition by chunk_id) as p, row_number() over (partition by
chunk_id order by score desc, candidate) as r from e), t as (select chunk_id, max(case when r = 1 then candidate end) as best, max(case
when r = 1 then p end) as p1, max(case when r = 2 then p end) as p2 from p group by 1) select chunk_id, best, round(p1 * (0.7 + 0.3 *
coalesce(p1 - p2, 1.0)), 6) as confidence from t""")
def softmax_confidence(spark, d):
    s = A.vectors(spark, d).groupBy("chunk_id", F.col("label").alias("candidate")).agg(F.max(F.col("v")[0]).alias("score"))
    return vectors.softmax_confidence(s, "chunk_id", "score").withColumn("confidence", F.round("confidence", 6))


@query(f"""with {TW}, l as (select *, lag(speaker) over (partition by stream_id order by window_id) as f from tw), t as (select f as from_speaker,
speaker as to_speaker, count(*) as n from l where f <> speaker group by 1, 2) select from_speaker, to_speaker, n, round(least(n / sum(n)
over (partition by from_speaker)::double * 0.03, 0.03), 8) as bonus from t""")
def speaker_transitions(spark, d):
    return vectors.transitions(A.transcription_windows(spark, d)).withColumn("bonus", F.round("bonus", 8))


@query(f"""with {CHG}, l as (select stream_id, arg_max(content_type, change_window) as latest from chg where change_window > 0 group by 1)
select tw.stream_id, tw.window_id, coalesce(chg.content_type, 'UNKNOWN') as online,
case when coalesce(chg.content_type, 'UNKNOWN') = 'UNKNOWN' then coalesce(l.latest, 'UNKNOWN') else chg.content_type end as recomputed
from (select *, (ts_start * 1000)::bigint as ms from tw) tw asof left join (select * from chg where change_window > 0) chg on tw.stream_id
= chg.stream_id and tw.ms >= chg.start_ms left join l on l.stream_id = tw.stream_id""")
def content_type_asof(spark, d):
    """The first change is left out, so that windows before any change occur."""
    w = A.transcription_windows(spark, d).select("stream_id", "window_id", T.to_ms(F.col("ts_start")).alias("ms"))
    changes = A.content_changes(spark, d).where("change_window > 0")
    a, b = (joins.type_in_force(w, changes, mode).select("stream_id", "window_id", F.col("content_type").alias(name)) for mode, name in ((False, "online"), (True, "recomputed")))
    return a.join(b, ["stream_id", "window_id"])


@query(f"""with {SEC}, seg as (select stream_id, window_id as segment_id, (ts_start * 1000)::bigint as s0, (ts_end * 1000)::bigint as s1 from tw)
select sec.stream_id, sec.window_id, seg.segment_id, round((least(end_ms, s1) - greatest(start_ms, s0)) / greatest(least(end_ms -
start_ms, s1 - s0), 1)::double, 6) as ratio from sec join seg on sec.stream_id = seg.stream_id and start_ms < s1 and s0 < end_ms""")
def section_overlap(spark, d):
    j = joins.overlap_join(A.sections(spark, d), A.segments(spark, d), "stream_id", ("start_ms", "end_ms"), ("seg_start_ms", "seg_end_ms"), 10000)
    return j.select("stream_id", "window_id", "segment_id", F.round(joins.overlap_ratio("start_ms", "end_ms", "seg_start_ms", "seg_end_ms"), 6).alias("ratio"))


@query(f"""with {SEC}, old as (select * from sec where window_id % 2 = 0), j as (select n.stream_id, n.window_id, n.content, o.content as oc,
row_number() over (partition by n.stream_id, n.window_id order by o.window_id) as rn from sec n join old o on n.stream_id = o.stream_id
and n.start_ms < o.end_ms and o.start_ms < n.end_ms and (least(n.end_ms, o.end_ms) - greatest(n.start_ms, o.start_ms)) /
greatest(least(n.end_ms - n.start_ms, o.end_ms - o.start_ms), 1)::double >= 0.5) select stream_id, window_id from sec where not exists
(select 1 from j where j.rn = 1 and trim(j.oc) = trim(j.content) and j.stream_id = sec.stream_id and j.window_id = sec.window_id)""")
def changed_sections(spark, d):
    s = A.sections(spark, d)
    return joins.changed_sections(s, s.where("window_id % 2 = 0"), 10000).select("stream_id", "window_id")


@query(f"""with {TW} select a.stream_id, a.window_id, exists (select 1 from tw b where b.stream_id = a.stream_id and b.speaker <> a.speaker and
least(a.ts_end, b.ts_end) > greatest(a.ts_start, b.ts_start)) as is_overlap, exists (select 1 from tw b where b.stream_id = a.stream_id
and b.speaker <> a.speaker and a.ts_start - b.ts_end between 0 and 0.5) as is_onset from tw a""")
def overlap_onset_flags(spark, d):
    return joins.turn_flags(A.transcription_windows(spark, d)).select("stream_id", "window_id", "is_overlap", "is_onset")


@query(f"""with {TW} select distinct a.stream_id, a.window_id from tw a join tw b on a.stream_id = b.stream_id and a.window_id = b.window_id where
length(a.text) % 2 = 0 and length(b.text) % 3 = 0""")
def rendezvous_join(spark, d):
    w = A.transcription_windows(spark, d)
    return joins.rendezvous(w.where(F.length("text") % 2 == 0), w.where(F.length("text") % 3 == 0))


@query(f"""with {TW}, n as (select stream_id, window_id, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\.+$', '') as norm
from tw), r as (select *, row_number() over (partition by stream_id, norm order by window_id) as rn from n where norm <> '') select
stream_id, window_id, norm from r where rn = 1""")
def first_seen_actions(spark, d):
    w = A.transcription_windows(spark, d)
    return dedup.first_seen(w, "stream_id", "text", "window_id").select("stream_id", "window_id", T.normal_action(F.col("text")).alias("norm"))


_OPEN = "coalesce(continuation_of, 0) = 0 and coalesce(correction_of, 0) = 0"


@query(f"with {INS} select stream_id, window_id // 4 as window_id, insight_type, count(*) as n from ins where {_OPEN} group by 1, 2, 3 having count(*) > 1")
def duplicate_types(spark, d):
    return dedup.duplicate_types(A.insights(spark, d).withColumn("window_id", F.floor(F.col("window_id") / 4)))


@query(f"""with {INS}, g as (select stream_id, window_id // 4 as window_id, insight_type, max(confidence) as confidence, arg_min(insight_text,
insight_id) as insight_text,
arg_min(classification, insight_id) as classification, count(*) as n from ins where {_OPEN} group by 1, 2, 3 having count(*) > 1), l as
(select stream_id, max(insight_id) as last from ins group by 1)
select g.*, last + row_number() over (partition by g.stream_id order by window_id, insight_type) as insight_id from g join l on
g.stream_id = l.stream_id""")
def consolidated_insights(spark, d):
    return dedup.consolidate(A.insights(spark, d).withColumn("window_id", F.floor(F.col("window_id") / 4)))


@query(f"""with recursive {INS}, r as (select stream_id, insight_id, coalesce(nullif(continuation_of, 0), nullif(correction_of, 0)) as ref from ins),
up as (select stream_id, insight_id, insight_id as here, ref as nxt from r union all select up.stream_id, up.insight_id, up.nxt, i.ref
from up left join r i on i.stream_id = up.stream_id and i.insight_id = up.nxt where up.nxt is not null)
select stream_id, insight_id, here as root from up where nxt is null""")
def chain_root(spark, d):
    return joins.chain_roots(A.insights(spark, d), "stream_id", "insight_id", "continuation_of", "correction_of")


@query(f"""with {TW}, m(old, new) as (values ('user', 'assistant'), ('assistant', 'system')) select stream_id, window_id, coalesce(m.new, speaker) as
speaker from tw left join m on speaker = m.old""")
def speaker_remap(spark, d):
    m = spark.createDataFrame([("user", "assistant"), ("assistant", "system")], "old string, new string")
    return joins.remap(A.transcription_windows(spark, d), "speaker", m).select("stream_id", "window_id", "speaker")


_RULES_SQL = "rules(content_type, emphasize, deemphasize, sentiment, participants) as (values " + ", ".join(f"('{t}', '{e}', '{n}', {str(s).lower()}, {str(p).lower()})" for t, e, n, s, p, _, _ in rules.RULES) + ")"
_TYPED = f"{INS}, {CHG.split('), ', 1)[1]}, {_RULES_SQL}, typed as (select ins.*, chg.content_type from ins asof left join chg on ins.stream_id = chg.stream_id and ins.insight_id >= chg.change_window)"


def _typed(spark, d):
    """Insights with the content type in force at their window."""
    j = joins.as_of(A.insights(spark, d), A.content_changes(spark, d), "stream_id", "insight_id", "change_window", "content_type", "change_window")
    return j


@query(f"""with {_TYPED} select stream_id, insight_id, insight_type from typed left join rules using (content_type) where not (insight_type =
'SENTIMENT' and not coalesce(sentiment, true)) and not (insight_type = 'PARTICIPANTS' and not coalesce(participants, true))""")
def rule_filtered_insights(spark, d):
    return rules.filtered(_typed(spark, d), spark).select("stream_id", "insight_id", "insight_type")


@query(f"""with {_TYPED} select stream_id, insight_id, case when list_contains(string_split(coalesce(emphasize, ''), ','), insight_type) then 1 when
list_contains(string_split(coalesce(deemphasize, ''), ','), insight_type) then -1 else 0 end as weight from typed left join rules using
(content_type)""")
def rule_weights(spark, d):
    return rules.weighed(_typed(spark, d), spark).select("stream_id", "insight_id", "weight")


@query(f"""with {TW} select stream_id, sum(length(text))::bigint as chars, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <>
'')))::bigint as words, count(*) as windows, max(ts_start + 2.5) as position, sum(2.5::double) as duration from tw group by 1""")
def window_stats(spark, d):
    g = A.transcription_windows(spark, d).groupBy("stream_id")
    return g.agg(F.sum(F.length("text")).alias("chars"), F.sum(T.word_count(F.col("text"))).alias("words"), F.count("*").alias("windows"), F.max(F.col("ts_start") + 2.5).alias("position"), F.sum(F.lit(2.5)).alias("duration"))


@query(f"""with {TW} select stream_id, window_id, lpad((ts_start::bigint // 60)::varchar, 2, '0') || ':' || lpad((ts_start::bigint % 60)::varchar, 2,
'0') as label, length(text) // 4 as tokens, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\.+$', '') as action
from tw""")
def text_functions(spark, d):
    return A.transcription_windows(spark, d).select("stream_id", "window_id", T.hms(F.col("ts_start")).alias("label"), T.token_estimate(F.col("text")).alias("tokens"), T.normal_action(F.col("text")).alias("action"))


@query(f"""with {TW}, l as (select *, lead(ts_start) over (partition by stream_id order by ts_start, window_id) as nx from tw) select stream_id,
window_id, round(least(ts_end, coalesce(nx - 0.001, ts_end)), 6) as ts_end from l""")
def cue_trim(spark, d):
    return dedup.trimmed_cues(A.transcription_windows(spark, d)).select("stream_id", "window_id", F.round("ts_end", 6).alias("ts_end"))


@query(f"""with {TW}, l as (select *, lag(speaker) over (partition by stream_id order by window_id) as p from tw) select stream_id, window_id,
speaker from l where p is distinct from speaker""")
def speaker_changes(spark, d):
    line = W.partitionBy("stream_id").orderBy("window_id")
    w = A.transcription_windows(spark, d).withColumn("p", F.lag("speaker").over(line))
    return w.where(~F.col("p").eqNullSafe(F.col("speaker"))).select("stream_id", "window_id", "speaker")


@query(f"with {TW} select stream_id, arg_max(text, window_id) as text, max(window_id) as window_id from tw group by 1")
def last_write_wins(spark, d):
    return dedup.last_write(A.transcription_windows(spark, d).select("stream_id", "window_id", "text"), ["stream_id"], "window_id").select("stream_id", "text", "window_id")


@query(f"""with {TW} select a.stream_id, a.window_id, case when coalesce(b.text, '') <> '' then '## Previous Summary Window Transcript' || chr(10) ||
b.text || chr(10) || chr(10) || '## Current Summary Window Transcript' || chr(10) || a.text else a.text end as content
from tw a left join tw b on a.stream_id = b.stream_id and b.window_id = a.window_id - 1 and a.window_id > 0""")
def prior_window_pair(spark, d):
    w = A.transcription_windows(spark, d)
    p = w.select("stream_id", (F.col("window_id") + 1).alias("window_id"), F.col("text").alias("prior")).where("window_id > 0 and prior <> ''")
    both = F.concat(F.lit("## Previous Summary Window Transcript\n"), "prior", F.lit("\n\n## Current Summary Window Transcript\n"), "text")
    return w.join(p, ["stream_id", "window_id"], "left").select("stream_id", "window_id", F.coalesce(both, "text").alias("content"))


_ACTIONS = """n as (select stream_id, window_id, text, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\.+$', '') as norm from tw),
r as (select *, row_number() over (partition by stream_id, norm order by window_id) as rn from n where norm <> '')"""


@query(f"""with {TW}, {_ACTIONS} select stream_id, window_id, string_agg(text, ' | ') over (partition by stream_id order by window_id rows unbounded
preceding) as so_far from r where rn = 1""")
def accumulated_actions(spark, d):
    """A snapshot of all actions so far, where a window has a new one."""
    line = W.partitionBy("stream_id").orderBy("window_id").rowsBetween(W.unboundedPreceding, 0)
    new = dedup.first_seen(A.transcription_windows(spark, d), "stream_id", "text", "window_id")
    return new.select("stream_id", "window_id", F.array_join(F.collect_list("text").over(line), " | ").alias("so_far"))


@query(f"""with {TW} select stream_id, window_id, (window_id + 1)::varchar || chr(10) || '00:00:' || lpad((ts_start::bigint)::varchar, 2, '0') ||
'.000 --> 00:00:' || lpad(floor(ts_end)::bigint::varchar, 2, '0') || '.500' || chr(10) || text as cue from tw""")
def vtt_export(spark, d):
    w = A.transcription_windows(spark, d).withColumn("n", F.col("window_id") + 1)
    return w.select("stream_id", "window_id", sinks.vtt_cue("n", "ts_start", "ts_end", "text").alias("cue"))


@query(f"with {TW} select stream_id, window_id, '\"' || window_id || '\",\"' || speaker || '\",\"' || replace(text, '\"', '\"\"') || '\"' as line from tw")
def csv_export(spark, d):
    return A.transcription_windows(spark, d).select("stream_id", "window_id", sinks.csv_line("window_id", "speaker", "text").alias("line"))


@query(f"""with recursive {TW}, o as (select stream_id, window_id, row_number() over (partition by stream_id order by window_id) as rn,
list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as words from tw),
f as (select distinct stream_id, 0::bigint as rn, null::bigint as window_id, []::varchar[] as kept, 0::bigint as removed from tw union all
select stream_id, rn, window_id, words[cut + 1:], cut from (select o.stream_id, o.rn, o.window_id, o.words,
coalesce(nullif(list_position(list_transform(range(1, least(len(f.kept), len(o.words)) + 1), lambda i: lower(f.kept[-i]) =
lower(o.words[i])), false), 0) - 1, least(len(f.kept), len(o.words)))::bigint as cut
from f join o on o.stream_id = f.stream_id and o.rn = f.rn + 1)) select stream_id, window_id, removed from f where rn > 0""")
def word_overlap_dedup(spark, d):
    return context.word_overlap(A.transcription_windows(spark, d))


@query()
def transcript_dedupe(spark, d):
    return A.transcription_windows(spark, d).select("stream_id", "window_id", repetition.repeats_collapsed()("text").alias("text"))


@query(f"""with recursive {TW}, t as (select stream_id, trim(regexp_replace(string_agg(text, ' ' order by window_id), '\\s+', ' ', 'g')) as text from
tw group by 1),
l as (select stream_id, length(text) <= 2000 as whole, case when length(text) <= 2000 then [text] else
regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) end as s from t),
f as (select stream_id, s, 1::bigint as i, 0::bigint as chunk, s[1] as text, length(s[1]) + 1 as held from l union all
select stream_id, s, i + 1, case when held + length(s[i + 1]) + 1 <= 2000 then chunk else chunk + 1 end,
case when held + length(s[i + 1]) + 1 <= 2000 then text || ' ' || s[i + 1] else trim(right(text, 500)) || ' ' || s[i + 1] end,
case when held + length(s[i + 1]) + 1 <= 2000 then held + length(s[i + 1]) + 1 else length(trim(right(text, 500))) + length(s[i + 1]) + 2
end from f where i < len(s))
select stream_id, chunk::int as chunk, arg_max(text, i) as text from f group by 1, 2""")
def chunk_split(spark, d):
    s = A.transcription_windows(spark, d).groupBy("stream_id").agg(context.ordered_text("text", "window_id").alias("text"))
    return s.select("stream_id", F.posexplode(repetition.chunks_of()("text")).alias("chunk", "text"))


@query()
def boundary_overlap(spark, d):
    """Each text and the one before it, without what they repeat at their boundary."""
    line = W.partitionBy("stream_id").orderBy("window_id")
    w = A.transcription_windows(spark, d).withColumn("prior", F.lag("text").over(line)).where("prior is not null")
    return w.select("stream_id", "window_id", repetition.boundaries(120)("prior", "text").alias("x")).select("stream_id", "window_id", "x.*")


@query()
def validated_text(spark, d):
    """A window's text as a rewriting of the one before it, kept where it is close enough."""
    line = W.partitionBy("stream_id").orderBy("window_id")
    w = A.transcription_windows(spark, d).withColumn("source", F.lag("text").over(line)).where("source is not null")
    both = repetition.validated()("source", "text").alias("text"), F.round(repetition.similarity()("source", "text"), 6).alias("similarity")
    return w.select("stream_id", "window_id", *both)


@query()
def online_speakers(spark, d):
    return cluster.online_speakers(A.speaker_turns(spark, d), "stream_id")


@query()
def spliced_sections(spark, d):
    s = A.sections(spark, d)
    return cluster.splice_sections(s.where("window_id % 2 = 0"), s.where("window_id % 2 = 1"))


@query()
def merged_sections(spark, d):
    s = A.sections(spark, d)
    return cluster.merge_sections(s.where("window_id % 2 = 0"), s.where("window_id % 2 = 1"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_lineitem(spark, d):
    return A.table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


@query("""select n_name, round(sum(o_totalprice), 2) as total, count(*) as n from orders join customer on o_custkey = c_custkey join nation on
c_nationkey = n_nationkey group by rollup (n_name)""")
def rollup_orders(spark, d):
    o, c, n = (A.table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("select c_custkey as custkey from customer except select o_custkey from orders")
def customers_without_orders(spark, d):
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"))
    return c.join(A.table(spark, d, "orders"), F.col("custkey") == F.col("o_custkey"), "left_anti")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new
from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select
user_id, min(ts)::timestamp as start, count(*) as n from s group by user_id, k""")
def session_windows(spark, d):
    g = A.table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


#: Segments of the queries over one long stream; on a table of any size scan.parts_for gives the number.
PARTS = 16
ONE = "one as (select event_id as window_id, props as text, epoch_us(ts) / 1000000.0::double as ts_start, epoch_us(ts) / 1000000.0::double + value as ts_end, case when event_type in ('purchase', 'signup') then event_type end as change from events)"


@query(f"""with {ONE}, s as (select *, sum(length(text)) over (order by window_id desc rows unbounded preceding) as s, row_number() over (order by window_id
desc) as rn from one) select window_id, text, length(text)::bigint as char_count from s where s <= 50000 or rn = 1""")
def long_stream_retained(spark, d):
    """Windows of one long stream that a budget of characters keeps."""
    w = A.one_stream(spark, d).select("stream_id", F.col("window_id").alias("summary_id"), "text", F.length("text").cast("long").alias("char_count"))
    return context.retain(w, 50000, PARTS).select(F.col("summary_id").alias("window_id"), "text", "char_count")


@query(f"""with {ONE}, s as (select *, coalesce(sum(length(text)) over (order by window_id desc rows between unbounded preceding and 1 preceding), 0) as s
from one) select window_id, text from s where s < 20000""")
def long_stream_recent(spark, d):
    return context.recent(A.one_stream(spark, d), 20000, PARTS).select("window_id", "text")


@query(f"""with {ONE} select window_id, round(least(ts_end, coalesce(lead(ts_start) over (order by ts_start, window_id) - 0.001, ts_end)), 6) as ts_end
from one""")
def long_stream_cues(spark, d):
    c = dedup.trimmed_cues(A.one_stream(spark, d).select("stream_id", "window_id", "ts_start", "ts_end"), PARTS)
    return c.select("window_id", F.round("ts_end", 6).alias("ts_end"))


@query(f"""with {ONE} select window_id, coalesce(last_value(change ignore nulls) over (order by ts_start, window_id), 'none') as kind from one""")
def long_stream_types(spark, d):
    """The type in force at each window of one long stream: an as-of join with its changes; windows of one time follow by number."""
    w = A.one_stream(spark, d)
    changes = w.where("change is not null").select("stream_id", "ts_start", "window_id", F.col("change").alias("kind"))
    j = joins.as_of(w.select("stream_id", "window_id", "ts_start"), changes, "stream_id", "ts_start", "ts_start", "kind", "window_id", PARTS, "window_id")
    return j.select("window_id", F.coalesce("kind", F.lit("none")).alias("kind"))


@query(f"""with {ONE} select window_id, (sum(case when ts_end - ts_start > 100 then 1 else 0 end) over (order by ts_start, window_id rows unbounded
preceding))::bigint as long_ones from one""")
def long_stream_counts(spark, d):
    """A running count along one long stream."""
    n = F.when(F.col("ts_end") - F.col("ts_start") > 100, 1).otherwise(0)
    r = scan.running_sum(A.one_stream(spark, d), "stream_id", [F.col("ts_start"), F.col("window_id")], n, "long_ones", PARTS)
    return r.select("window_id", F.col("long_ones").cast("long").alias("long_ones"))

"""As-of, interval, band, rendezvous, chain and remap joins, written so that Catalyst can hash or sort them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.operators import scan
from confluo.operators.shared import cut


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, tie: str, parts: int | None = None, left_tie: str | None = None) -> DataFrame:
    """The last ``value`` of ``right`` at or before each left row: one union, one sort, no join of the tables; ``parts`` as in scan.py.

    All of ``right`` at a left row's time count, or with ``left_tie`` those whose ``tie`` isn't above it.
    """
    cols = left.columns
    mine = F.lit(None) if left_tie is None else F.col(left_tie)
    a = left.select(*cols, F.col(left_ts).cast("double").alias("__ts"), F.lit(1).alias("__kind"), mine.cast("long").alias("__tie"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(*[F.col(c) if c == key else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], F.col(right_ts).cast("double").alias("__ts"), F.lit(0).alias("__kind"), F.col(tie).cast("long").alias("__tie"), F.col(value).alias("__v"))
    order = ["__ts", "__kind", "__tie"] if left_tie is None else ["__ts", "__tie", "__kind"]
    known = scan.last_known(a.unionByName(b), key, order, "__v", "__last", parts)
    return known.where("__kind = 1").select(*cols, F.col("__last").alias(value))


def type_in_force(left: DataFrame, changes: DataFrame, recompute: bool, unknown: str = "UNKNOWN") -> DataFrame:
    """``left`` (stream_id, ms, ..) with content_type: the change in force at ms, or unknown.

    With ``recompute`` a window before the first change, or under an unknown type, has the latest type of its stream.
    """
    j = as_of(left, changes, "stream_id", "ms", "start_ms", "content_type", "change_window")
    held = F.coalesce("content_type", F.lit(unknown))
    if not recompute:
        return j.withColumn("content_type", held)
    latest = changes.groupBy("stream_id").agg(F.max_by("content_type", F.struct("start_ms", "change_window")).alias("__latest"))
    j = j.join(latest, "stream_id", "left")
    return j.withColumn("content_type", F.when(held == unknown, F.coalesce("__latest", held)).otherwise(held)).drop("__latest")


def overlap_join(a: DataFrame, b: DataFrame, key: str, a_span: tuple[str, str], b_span: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of one key whose intervals overlap: an equi-join on time buckets, each pair kept in its first common bucket."""
    (a0, a1), (b0, b1) = a_span, b_span
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket)))
    x, y = a.withColumn("__b", cells(a0, a1)), b.withColumn("__b", cells(b0, b1))
    first = F.greatest(F.floor(F.col(a0) / bucket), F.floor(F.col(b0) / bucket))
    return x.join(y, [key, "__b"]).where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("__b") == first)).drop("__b")


def overlap_ratio(a0: str, a1: str, b0: str, b1: str):
    both = F.least(a1, b1) - F.greatest(a0, b0)
    return F.greatest(both, F.lit(0)) / F.greatest(F.least(F.col(a1) - F.col(a0), F.col(b1) - F.col(b0)), F.lit(1))


def changed_sections(new: DataFrame, old: DataFrame, bucket: int, at: float = 0.5) -> DataFrame:
    """New sections but those whose first prior section with enough overlap has the same trimmed content."""
    prior = old.select("stream_id", F.col("window_id").alias("old_id"), F.col("start_ms").alias("old_start"), F.col("end_ms").alias("old_end"), F.col("content").alias("old_content"))
    j = overlap_join(new, prior, "stream_id", ("start_ms", "end_ms"), ("old_start", "old_end"), bucket).where(overlap_ratio("start_ms", "end_ms", "old_start", "old_end") >= at)
    first = j.groupBy("stream_id", "window_id").agg(F.min_by(F.struct("old_content", "content"), "old_id").alias("m"))
    same = first.where(F.trim("m.old_content") == F.trim("m.content"))
    return new.join(same, ["stream_id", "window_id"], "left_anti")


def turn_flags(turns: DataFrame, onset: float = 0.5) -> DataFrame:
    """(.., is_overlap, is_onset): another label speaks during the turn, or ended within ``onset`` before it."""
    o = turns.select("stream_id", F.col("window_id").alias("o_id"), F.col("ts_start").alias("o_start"), F.col("ts_end").alias("o_end"), F.col("speaker").alias("o_speaker"))
    near = overlap_join(turns.withColumn("w_start", F.col("ts_start") - onset - 0.001), o.withColumn("o_reach", F.col("o_end") + 0.001), "stream_id", ("w_start", "ts_end"), ("o_start", "o_reach"), 10).where("speaker <> o_speaker")
    lap = (F.least("ts_end", "o_end") > F.greatest("ts_start", "o_start"))
    on = (F.col("ts_start") - F.col("o_end")).between(0.0, onset)
    flags = near.groupBy("stream_id", "window_id").agg(F.max(lap).alias("is_overlap"), F.max(on).alias("is_onset"))
    return turns.join(flags, ["stream_id", "window_id"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_overlap", "is_onset")})


def rendezvous(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a (stream, window) that both sides completed."""
    return a.select("stream_id", "window_id").distinct().join(b.select("stream_id", "window_id").distinct(), ["stream_id", "window_id"])


def _ancestors(state: DataFrame, key: str, steps: int) -> DataFrame:
    """(key, n, p) with p moved 2 ** steps links up, or to the last node; a parent that isn't a node is the last."""
    for _ in range(steps):
        up = state.select(key, F.col("n").alias("p"), F.col("p").alias("pp"))
        state = cut(state.join(up, [key, "p"], "left").select(key, "n", F.coalesce("pp", "p").alias("p")))
    return state


def chain_roots(links: DataFrame, key: str, node: str, parent: str, other: str | None = None) -> DataFrame:
    """The root that each node's chain of parents ends in: pointer doubling, as many rounds as the digits of the largest chain.

    ``other`` is a second reference that counts where ``parent`` is null or 0. A parent that isn't a node is the root; a chain that
    comes to a cycle ends at the node that it visits again, so a node on a cycle is its own root.
    """
    ref = F.when(F.col(parent) != 0, F.col(parent))
    ref = ref if other is None else F.coalesce(ref, F.when(F.col(other) != 0, F.col(other)))
    state = cut(links.select(key, F.col(node).alias("n"), F.coalesce(ref, node).alias("p")))
    most = state.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    steps = max(1, most).bit_length()
    far = _ancestors(state, key, steps)
    # After so many steps a chain stands at its root or on its cycle, and every node of a cycle is stood on.
    up = state.select(key, F.col("n").alias("p"), F.col("p").alias("next"))
    on_cycle = far.join(up, [key, "p"]).where(F.col("next") != F.col("p")).select(key, F.col("p").alias("n")).distinct().withColumn("cycle", F.lit(True))
    on_cycle = cut(on_cycle)
    if on_cycle.isEmpty():
        return far.select(key, F.col("n").alias(node), F.col("p").alias("root"))
    open_ = state.join(on_cycle, [key, "n"], "left").select(key, "n", F.when(F.col("cycle"), F.col("n")).otherwise(F.col("p")).alias("p"))
    return _ancestors(cut(open_), key, steps).select(key, F.col("n").alias(node), F.col("p").alias("root"))


def closed_merges(merges: DataFrame) -> DataFrame:
    """(old, new) with every merge followed to its end."""
    one = merges.select(F.lit(0).alias("k"), "old", "new")
    last = merges.select(F.lit(0).alias("k"), F.col("new").alias("old"), F.lit(None).cast(merges.schema["new"].dataType).alias("new"))
    every = one.unionByName(last.join(one, ["k", "old"], "left_anti")).distinct()
    state = every.select("k", F.col("old").alias("n"), F.coalesce("new", "old").alias("p"))
    most = merges.count() + 1
    return _ancestors(state, "k", most.bit_length()).where("n <> p").select(F.col("n").alias("old"), F.col("p").alias("new"))


def remap(rows: DataFrame, col: str, merges: DataFrame) -> DataFrame:
    """One hop of merges (old, new)."""
    return rows.join(merges, rows[col] == merges["old"], "left").withColumn(col, F.coalesce("new", col)).drop("old", "new")

"""Mixing sources to target weights by Pareto order sampling.

Each source's target T of S words means T / S copies of each document: floor(T / S) whole copies are certain. What
they leave open is drawn without replacement and with unequal probabilities: a document of g binary digits of words
has the inclusion probability p = min(1, level * g), with the level that gives the open words in expectation, so longer
documents are likelier and the longest may be certain. Documents are ranked by random odds u / (1 - u) over
inclusion odds p / (1 - p); the sample is the longest head of that order whose words don't exceed what is open, and one further
row for the rest. The head is found without sorting a source in one task: sums over ranges of the rank, then over ranges inside
the range that holds the end, then a running sum over what is left there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluo.llm.common import ID, KEY, TEXT, cut, narrow, row_key

#: The weights of sources in order, repeating, and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
RANGES, SALT = 1024, 16
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text, natively: starts of runs without ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the weighted share of the total, stopped at ``most``
    times the size, the excess shared again. One row a source: the windows without a key run over sources only.

    Where a source stops is its cap over its weight, in rising order: the first one whose level (what is left over the
    weights left) is no more than its own stop gives the level for it and all after it.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("stop", F.col("cap") / F.col("w").cast("double"))
    rising = W.orderBy("stop", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("open_words", F.sum("source_size").over(whole) - (F.sum("cap").over(rising) - F.col("cap")))
    s = s.withColumn("open_weight", F.sum("w").over(whole) - (F.sum("w").over(rising) - F.col("w")))
    s = s.withColumn("level", F.col("open_words").cast("double") / F.col("open_weight").cast("double"))
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(whole)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w").cast("double") * F.col("final")).alias("target"))


def draw(id_col: Column, text_col: Column) -> Column:
    """A number in (0, 1) that depends on the id and the text alone: the first 52 bits of their md5."""
    said = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text_col, F.lit("")))
    return (F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix_key(id_col: Column, text_col: Column, source_col: Column) -> Column:
    """64 bits over what tells two rows of a mix apart; equal rows share it."""
    return F.xxhash64(row_key(id_col, text_col), source_col)


def digits(number: Column) -> Column:
    """Binary digits of a whole number from 1 on; 1 for 0."""
    return F.length(F.bin(number)).cast("long")


def inclusion(open_words: DataFrame, words: DataFrame) -> DataFrame:
    """(source, level): a document of g binary digits is drawn with probability min(1, level * g).

    ``open_words`` (source, open) has what the draw shall give, ``words`` (source, g, words) what the classes hold. The classes of
    the longest documents become certain first; the first class in falling order that the level of all from it on
    leaves at 1 or below gives the level.
    """
    falling = W.partitionBy("source").orderBy(F.desc("g"))
    above = falling.rowsBetween(W.unboundedPreceding, -1)
    below = falling.rowsBetween(W.currentRow, W.unboundedFollowing)
    c = words.join(open_words.select(F.col("source").alias("s1"), "open"), F.col("source").eqNullSafe(F.col("s1")))
    c = c.withColumn("certain", F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double"))
    c = c.withColumn("drawn", F.sum(F.col("g") * F.col("words")).over(below).cast("double"))
    c = c.withColumn("level", F.try_divide(F.col("open") - F.col("certain"), F.col("drawn")))
    fits = c.where((F.col("level") >= 0) & (F.col("level") * F.col("g").cast("double") <= 1.0))
    return fits.groupBy("source").agg(F.max_by("level", "g").alias("level"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row; ``taken`` = copies * size; the row's key is in KEY.

    Null texts have size 0; null sources are one source, the last; a null id draws as the text 'null'; rows with one
    id draw by their own texts; equal rows draw once and enter together, but those at the end of the sample enter only as
    far as they fit, so copies may differ among them; the result is the same on each run; an empty table gives no
    rows; other columns are ignored. No document is taken more than ``most`` times.
    """
    d = docs.select(docs[id_col].alias(ID), docs[text_col].alias(TEXT), docs[source_col].alias("source"))
    key, u = mix_key(F.col(ID), F.col(TEXT), F.col("source")), draw(F.col(ID), F.col(TEXT))
    d = d.select(ID, key.alias(KEY), "source", size_of(F.col(TEXT)).alias("size"), u.alias("u"))
    # Equal rows are one weighted row from here on, however many they are.
    d = cut(d.groupBy(ID, KEY, "source", "size", "u").agg(F.count("*").alias("rows")))
    words = F.col("rows") * F.col("size")
    t = targets(d.groupBy("source").agg(F.sum(words).alias("source_size")), weights, most)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    t = t.withColumn("whole", F.floor(ratio))
    t = cut(t.withColumn("open", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")))
    levels = inclusion(t, d.groupBy("source", digits(F.col("size")).alias("g")).agg(F.sum(words).alias("words")))
    levels = levels.select(F.col("source").alias("s0"), "level")
    facts = t.join(levels, F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0")
    facts = cut(facts.withColumn("level", F.coalesce("level", F.lit(0.0))))

    # A source may hold a third of all rows: its rows are dealt over SALT keys, the row a source is repeated.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    mine = F.pmod(F.col(KEY), F.lit(SALT)).cast("int")

    def told(rows: DataFrame, what: DataFrame, how: str = "inner") -> DataFrame:
        """``rows`` with the columns of ``what``, a row a source, but its source."""
        what = what.withColumnRenamed("source", "s1").withColumn("salt1", salts)
        same = F.col("source").eqNullSafe(F.col("s1")) & (F.col("salt0") == F.col("salt1"))
        return rows.withColumn("salt0", mine).join(what, same, how).drop("s1", "salt0", "salt1")

    # Random odds over inclusion odds, as a place in (0, 1); certain documents come first.
    p = F.least(F.lit(1.0), F.col("level") * digits(F.col("size")).cast("double"))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    placed = told(d, facts.select("source", "level")).withColumn("p", p)
    placed = placed.withColumn("v", F.when(F.col("p") <= 0, 1.0).otherwise(odds / (1 + odds))).drop("level", "p")
    step = lambda n: F.least(F.floor(F.col("v") * n), F.lit(n - 1)).cast("int")
    placed = cut(placed.withColumn("a", step(RANGES)).withColumn("b", step(RANGES * RANGES)))
    upto = lambda *by: W.partitionBy("source").orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow)

    def boundary(rows: DataFrame, step: str, ends: DataFrame) -> DataFrame:
        """(source, at, before, open): the range that holds the end, and the words before it."""
        sums = rows.groupBy("source", step).agg(F.sum(words).alias("words"))
        run = sums.join(ends.withColumnRenamed("source", "s1"), F.col("source").eqNullSafe(F.col("s1")))
        run = run.withColumn("upto", F.sum("words").over(upto(step)) + F.col("before"))
        first = F.min(F.struct(F.col(step).alias("at"), (F.col("upto") - F.col("words")).alias("before"), "open"))
        return run.where(F.col("upto").cast("double") >= F.col("open")).groupBy("source").agg(first.alias("m")).select("source", "m.*")

    ends = facts.where("open > 0").select("source", F.lit(0).cast("long").alias("before"), "open")
    first = cut(boundary(placed, "a", ends))
    inside = told(placed, first.select("source", "at")).where("a = at").drop("at")
    second = cut(boundary(inside, "b", first.drop("at")))
    last = told(inside, second).where("b = at")
    last = last.withColumn("upto", F.sum(words).over(upto("v", "u", KEY)) + F.col("before"))
    fits = F.col("upto").cast("double") <= F.col("open")
    place = F.struct("v", "u", KEY)
    # The last rows that enter whole, and those after them, of which as many enter as fit.
    left = F.col("open") - (F.col("upto") - words).cast("double")
    part = F.coalesce(F.floor(F.try_divide(left, F.col("size").cast("double"))), F.lit(0))
    end = F.max(F.when(fits, F.struct(place.alias("end"), F.col("upto").alias("held")))).alias("m")
    split = F.min(F.when(~fits, F.struct(place.alias("split"), part.alias("part"), F.col("size").alias("split_size")))).alias("n")
    ended = last.groupBy("source").agg(end, split).select(F.col("source").alias("s2"), "m.*", "n.*")
    limits = facts.select("source", "source_size", "target", "whole", "open").join(second.select(F.col("source").alias("s1"), "at", "before"), F.col("source").eqNullSafe(F.col("s1")), "left")
    limits = limits.join(ended, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s1", "s2")
    held = F.coalesce("held", "before", F.lit(0)) + F.coalesce(F.col("part") * F.col("split_size"), F.lit(0))
    limits = cut(limits.withColumn("rest", F.col("open") - held.cast("double")))
    ranges = F.when(F.col("at").isNull(), F.lit(True)).when(F.col("b") != F.col("at"), F.col("b") < F.col("at"))
    entered = (F.col("open") > 0) & ranges.otherwise(F.coalesce(place <= F.col("end"), F.lit(False)))
    extra = F.when(entered, F.col("rows")).when(place == F.col("split"), F.coalesce("part", F.lit(0))).otherwise(F.lit(0))
    j = told(placed, limits).withColumn("extra", extra.cast("long"))
    # What is still open is filled by one more row, if that lessens the gap: of those that leave a gap of the fewest binary
    # digits, the first in rank.
    gap = F.abs(F.col("size").cast("double") - F.col("rest"))
    may = j.where((F.col("open") > 0) & (F.col("extra") < F.col("rows")) & (gap < F.col("rest")))
    best = F.min(F.struct(digits(F.floor(gap)).alias("digits"), "v", "u", KEY)).alias("m")
    fill = cut(may.groupBy("source").agg(best).select("source", F.col(f"m.{KEY}").alias("fill")))
    j = told(j, fill, "left").withColumn("extra", F.col("extra") + F.coalesce((F.col(KEY) == F.col("fill")).cast("long"), F.lit(0)))
    # Equal rows part again; the first ``extra`` of them have one copy more.
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("rows") - 1, 10)))
    j = j.withColumn("page", thousands)
    inner = F.explode(F.sequence(F.col("page") * 1024 + 1, F.least(F.col("rows"), (F.col("page") + 1) * 1024)))
    copies = F.col("whole") + (F.col("nth") <= F.col("extra")).cast("long")
    j = j.withColumn("nth", inner).withColumn("copies", copies)
    return j.select(F.col(ID).alias(id_col), KEY, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def apply_mix(docs: DataFrame, mixed: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, each row as many times as the mix takes it; columns of any name stay as they are.

    Of equal rows that the mix takes unequally, those that stand first in ``docs`` have the copy more; which they are
    is told by partition sums and by the place in one partition, never by sorting the rows together. ``docs`` must
    give its rows in the same partitions each time, as a table that is read does. Empty tables give no rows.
    """
    taken = mixed.groupBy(KEY).agg(F.min("copies").alias("few"), F.max("copies").alias("many"), F.sum("copies").alias("n"), F.count("*").alias("rows"))
    taken = cut(taken.where("many > 0"))
    names = {n: f"__mix_{i}" for i, n in enumerate(docs.columns)}
    own = [mix_key(docs[id_col], docs[text_col], docs[source_col]).alias("__mix_key"), F.monotonically_increasing_id().alias("__mix_at")]
    keyed = docs.select(*[F.col(f"`{n}`").alias(x) for n, x in names.items()], *own)
    uneven = taken.where("many > few").select(F.col(KEY).alias("k"), (F.col("n") - F.col("rows") * F.col("few")).alias("extra"))
    # At most two groups of equal rows a source are uneven.
    here = keyed.select("__mix_key", "__mix_at", F.shiftright("__mix_at", 33).alias("part")).join(uneven.where("extra > 0"), F.col("__mix_key") == F.col("k"))
    sums = here.groupBy("k", "extra", "part").agg(F.count("*").alias("n"))
    run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("k").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = run.where("upto >= extra").groupBy("k").agg(F.min(F.struct("part", (F.col("extra") - F.col("upto") + F.col("n")).alias("nth"))).alias("m"))
    ends = ends.select(F.col("k").alias("k2"), F.col("m.part").alias("part2"), "m.nth")
    inside = here.join(ends, (F.col("k") == F.col("k2")) & (F.col("part") == F.col("part2")))
    inside = inside.withColumn("i", F.row_number().over(W.partitionBy("k").orderBy("__mix_at"))).where("i = nth")
    to = cut(inside.select(F.col("k").alias("k3"), F.col("__mix_at").alias("to")))
    plan = taken.join(to, F.col(KEY) == F.col("k3"), "left").select(F.col(KEY).alias("__mix_k"), "few", "many", "to")
    times = F.when(F.col("to").isNull() | (F.col("__mix_at") <= F.col("to")), F.col("many")).otherwise(F.col("few"))
    j = keyed.join(plan, F.col("__mix_key") == F.col("__mix_k")).withColumn("__mix_n", times).where("__mix_n > 0")
    j = j.withColumn("__mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n"))))
    return j.select(*[F.col(x).alias(n) for n, x in names.items()])

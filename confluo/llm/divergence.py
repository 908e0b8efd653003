"""Divergence of the sources of each language: every pair of them, and the terms by which one stands out.

A group is a (language, source); its profile gives each kept term a smoothed share (``shares``), and two profiles differ in a
term by ``floor((p - q) ** 2 / (p + q))``, in whole numbers throughout.

Counting: a task sums the words it reads and sends one packed row a bucket of terms; a bucket sums these by group and
term, settles which terms stay, and packs each group's counts by chunks of TERMS terms (``profiles``).

Pairs are met in a grid: a language's groups lie in blocks of about BLOCK, and the packed counts of a group in a chunk are
sent to each cell (block, block) that the group's block is part of. A task holds one cell of one range of chunks and adds, chunk
by chunk, to the cell's matrix; only terms that a group of the cell has are laid out, as terms that both groups lack
differ alike. The ranges' sums meet in one aggregate.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from confluo.llm.common import cut, cyclic_parts, release, text_bytes

#: Groups of a block, about (dealt by hash); terms of a chunk and chunks of a range, at most.
BLOCK, TERMS, RANGE = 64, 1024, 16
#: Words that a task holds before it passes their counts on; text a bucket of terms is made for; counts that a bucket holds
#: unsummed; cells of a matrix that are worked on at once.
HELD, BUCKET_BYTES, LOOSE, CELLS = 1 << 20, 64 << 20, 1 << 20, 1 << 21
#: Fixed values of the profile: a share's unit, what each term's count is raised by, and the documents that keep a term.
UNIT, RAISE, LEAST_DOCS = 1_000_000_000, 2, 10
#: Terms listed of each group.
TOP = 10
#: Bytes of words: ASCII letters, lower-cased, and whatever isn't ASCII; all others part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shares(n: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + RAISE) / (total + RAISE * terms)), three decimal digits at a time: exact for totals under 9 * 10 ** 15."""
    whole = total + RAISE * terms
    out, rest = np.divmod(n + RAISE, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


COUNTED = "bucket int, langs array<string>, sources array<string>, sizes array<long>, terms binary, n binary, docs binary"


def term_counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Packed counts of ``docs`` (lang, source, text): for each bucket of terms the groups, how many terms each has, the terms joined by
    a blank, their occurrences and the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[list[bytes], list[bytes]]] = {}
        size = 0

        def passed() -> pa.RecordBatch:
            out: list[list[tuple]] = [[] for _ in range(n_buckets)]
            for (lang, source), (every, once) in held.items():
                n, d = Counter(every), Counter(once)
                terms = list(n)
                bucket = np.fromiter(map(xxh3_64_intdigest, terms), np.uint64, len(terms)) % np.uint64(n_buckets)
                counts, docs = np.fromiter(n.values(), np.int64, len(n)), np.fromiter(map(d.__getitem__, terms), np.int64, len(n))
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(n_buckets, dtype=np.uint64), "right").tolist()
                at = 0
                for k, e in enumerate(ends):
                    if e > at:
                        mine = order[at:e]
                        out[k].append((lang, source, e - at, b" ".join([terms[i] for i in mine.tolist()]), counts[mine].tobytes(), docs[mine].tobytes()))
                    at = e
            held.clear()
            rows = [(k, *zip(*parts)) for k, parts in enumerate(out) if parts]
            cols = [pa.array([r[0] for r in rows], pa.int32())]
            cols += [pa.array([list(r[c]) for r in rows], pa.list_(t)) for c, t in ((1, pa.string()), (2, pa.string()), (3, pa.int64()))]
            cols += [pa.array([sep.join(r[c]) for r in rows], pa.binary()) for c, sep in ((4, b" "), (5, b""), (6, b""))]
            return pa.RecordBatch.from_arrays(cols, names=["bucket", "langs", "sources", "sizes", "terms", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                mine = words(text)
                every, once = held.setdefault((lang, source), ([], []))
                every += mine
                once += set(mine)
                size += len(mine)
                if size > HELD:
                    yield passed()
                    size = 0
        yield passed()
        release()

    return docs.select("lang", "source", "text").mapInArrow(run, COUNTED)


def profiles(counted: DataFrame, n_buckets: int, least_docs: int) -> DataFrame:
    """(lang, source, chunk, rng, m, q_sum, n_sum, at, term, n, q): a row for each group and chunk of kept terms that it has some of.

    ``m`` terms are in the chunk, with ``q_sum`` occurrences in the language; of them the group has those at places ``at``, ``n``
    times; the language has them ``q`` times. A bucket is summed as its rows come, so a term that is in every row takes no
    more room than one that isn't.
    """
    keys = ["lang", "source", "term"]

    def summed(tables: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(tables).combine_chunks().group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return got.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    def opened(langs: list[str], sources: list[str], sizes: list[int], terms: bytes, n: bytes, docs: bytes) -> pa.Table:
        spread = np.repeat(np.arange(len(sizes)), sizes)
        cols = [pa.array(langs).take(pa.array(spread)), pa.array(sources).take(pa.array(spread)), pa.array(terms.split(b" "), pa.binary())]
        return pa.table([*cols, pa.array(np.frombuffer(n, np.int64)), pa.array(np.frombuffer(docs, np.int64))], names=[*keys, "n", "docs"])

    def settled(bucket: int, tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = summed(tables)
        by_term = t.group_by(["lang", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        by_term = by_term.filter(pa.compute.greater_equal(by_term.column("docs_sum"), least_docs)).sort_by([("lang", "ascending"), ("term", "ascending")])
        langs = by_term.column("lang").to_pylist()
        first = {lang: k for k, lang in reversed(list(enumerate(langs)))}
        place = np.arange(len(langs)) - np.array([first[x] for x in langs], np.int64)
        by_term = pa.table([by_term.column("lang"), by_term.column("term"), by_term.column("n_sum"), pa.array(place)], names=["lang", "term", "q", "place"])
        t = t.join(by_term, ["lang", "term"], join_type="inner").sort_by([("lang", "ascending"), ("place", "ascending")])
        if not len(t):
            return
        # Chunks of a language hold its places TERMS by TERMS.
        lang, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        code = lambda x: (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).indices.to_numpy(zero_copy_only=False).astype(np.int64)
        chunk, q, n, at = (t.column(c).to_numpy() for c in ("place", "q", "n", "place"))
        chunk, at = chunk // TERMS, at % TERMS
        span = int(chunk.max()) + 1
        in_chunk = code(lang) * span + chunk
        heads = np.flatnonzero(np.r_[True, (in_chunk[1:] != in_chunk[:-1]) | (at[1:] != at[:-1])])
        cells, which = np.unique(in_chunk[heads], return_inverse=True)
        m, q_sum = np.bincount(which), np.zeros(len(cells), np.int64)
        np.add.at(q_sum, which, q[heads])
        order = np.lexsort((at, code(source), in_chunk))
        own = code(source)[order]
        cell = in_chunk[order]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (own[1:] != own[:-1])])
        pick = order[starts]
        nth = np.searchsorted(cells, in_chunk[pick])
        lists = pa.array(np.r_[starts, len(order)], pa.int32())
        listed = lambda x, kind: pa.ListArray.from_arrays(lists, x.cast(kind))
        term = t.column("term").combine_chunks().take(pa.array(order))
        number = bucket * (1 << 20) + chunk[pick]
        cols = [
            t.column("lang").combine_chunks().take(pa.array(pick)), t.column("source").combine_chunks().take(pa.array(pick)), pa.array(number), pa.array(bucket * (1 << 20) + chunk[pick] // RANGE),
            pa.array(m[nth]), pa.array(q_sum[nth]), pa.array(np.add.reduceat(n[order], starts)), listed(pa.array(at[order]), pa.int64()), listed(term, pa.string()),
            listed(pa.array(n[order]), pa.int64()), listed(pa.array(q[order]), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "chunk", "rng", "m", "q_sum", "n_sum", "at", "term", "n", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tables, loose = None, [], 0
        for b in batches:
            for bucket, *packed in zip(*(b.column(c).to_pylist() for c in range(7))):
                if bucket != here and tables:
                    yield from settled(here, tables)
                    tables, loose = [], 0
                here = bucket
                tables.append(opened(*packed))
                loose += len(tables[-1])
                if loose > LOOSE:
                    tables, loose = [summed(tables)], 0
        if tables:
            yield from settled(here, tables)
        tables = None
        release()

    schema = "lang string, source string, chunk long, rng long, m long, q_sum long, n_sum long, at array<long>, term array<string>, n array<long>, q array<long>"
    return counted.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


class Cell:
    """Two blocks of groups and a range of chunks: the sum of all terms' differences for each pair of groups."""

    def __init__(self):
        self.rows: dict[tuple[bool, str], int] = {}
        self.total, self.terms, self.open_terms = [], 0, 0
        self.sums = None

    def header(self, first: bool, source: str, total: int, terms: int, in_range: int) -> None:
        self.rows[first, source] = len(self.total)
        self.total.append(total)
        self.terms, self.open_terms = terms, in_range

    def chunk(self, members: list[tuple[bool, str, np.ndarray, np.ndarray]]) -> None:
        """Counts of one chunk: (is of the first block, source, the terms' places, their counts)."""
        seen = np.unique(np.concatenate([m[2] for m in members]))
        self.open_terms -= len(seen)
        counts = np.zeros((len(self.total), len(seen)), np.int64)
        for first, source, at, n in members:
            counts[self.rows[first, source], np.searchsorted(seen, at)] = n
        self._add(shares(counts, np.array(self.total)[:, None], np.int64(self.terms)), 1)

    def _sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the first and the second block; a block met with itself has rows of the first alone."""
        first = np.array([k for (f, _), k in self.rows.items() if f], np.int64)
        second = np.array([k for (f, _), k in self.rows.items() if not f], np.int64)
        return first, second if len(second) else first

    def _add(self, p: np.ndarray, times: int) -> None:
        first, second = self._sides()
        if self.sums is None:
            self.sums = np.zeros((len(first), len(second)), np.int64)
        step = max(1, CELLS // max(1, len(second) * max(1, p.shape[1])))
        for k in range(0, len(first), step):
            part = first[k : k + step]
            self.sums[k : k + step] += times * apart(p[part][:, None, :], p[second][None, :, :]).sum(2)

    def pairs(self, diagonal: bool) -> list[tuple[str, str, int]]:
        if self.terms:
            # Terms that no group of the cell has: all of them differ alike.
            self._add(shares(np.zeros((len(self.total), 1), np.int64), np.array(self.total)[:, None], np.int64(self.terms)), self.open_terms)
        first, second = self._sides()
        if self.sums is None:
            self.sums = np.zeros((len(first), len(second)), np.int64)
        names = [s for _, s in self.rows]
        got = [(names[a], names[b], int(self.sums[i, j])) for i, a in enumerate(first.tolist()) for j, b in enumerate(second.tolist())]
        return [g for g in got if g[0] < g[1]] if diagonal else got


def pair_sums(groups: DataFrame, packed: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lang, a, b, value): the difference of each two sources of a language, summed over its kept terms; each pair once.

    ``groups`` (lang, source, total, terms, blocks), ``packed`` the profiles, ``ranges`` (lang, rng, in_range): each
    language's ranges of chunks and their terms.
    """
    placed = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("long")
    # A language without kept terms has one empty range.
    heads = placed.join(ranges, "lang", "left").select("lang", "source", "total", "terms", F.coalesce("in_range", zero).alias("in_range"), F.coalesce("rng", zero).alias("rng"), F.lit(-1).cast("long").alias("chunk"), none.alias("at"), none.alias("n"), "block", other)
    counts = packed.select("lang", "source", "rng", "chunk", "at", "n").join(placed.select("lang", "source", "blocks", "block"), ["lang", "source"])
    counts = counts.select("lang", "source", zero.alias("total"), zero.alias("terms"), zero.alias("in_range"), "rng", "chunk", "at", "n", "block", other)
    cell = ("lang", "i", "j", "rng")
    sent = heads.unionByName(counts).select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rng", "chunk", (F.col("block") <= F.col("other")).alias("first"), "source", "total", "terms", "in_range", "at", "n")
    dealt = sent.repartition(*cell).sortWithinPartitions(*cell, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, cell, members = None, None, None, []

        def settled() -> pa.RecordBatch:
            if members:
                cell.chunk(members)
                members.clear()
            got = cell.pairs(at[1] == at[2])
            cols = [pa.array([at[0]] * len(got), pa.string()), *(pa.array([g[x] for g in got], t) for x, t in enumerate((pa.string(), pa.string(), pa.int64())))]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "a", "b", "value"])

        for batch in batches:
            places, numbers = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (10, 11))
            ends = np.cumsum(batch.column(10).value_lengths().to_numpy(zero_copy_only=False))
            for k, (lang, i, j, rng, chunk, first, source, total, terms, in_range) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(10)))):
                if (lang, i, j, rng) != at:
                    if cell is not None:
                        yield settled()
                    at, here, cell = (lang, i, j, rng), None, Cell()
                if chunk < 0:
                    cell.header(first, source, total, terms, in_range)
                    continue
                if chunk != here and members:
                    cell.chunk(members)
                    members.clear()
                here = chunk
                part = slice(ends[k - 1] if k else 0, ends[k])
                members.append((first, source, places[part], numbers[part]))
        if cell is not None:
            yield settled()
        release()

    sums = dealt.mapInArrow(run, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def leading_terms(packed: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value): of each row of profiles, with its group's and language's totals, the ``top`` terms that the group
    uses more than its language; the group's own leaders are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, n, q = (b.column(c).flatten() for c in (5, 6, 7))
            size = b.column(5).value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), size)
            total, terms, every = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in (2, 3, 4))
            p, q = shares(n.to_numpy(zero_copy_only=False), total, terms), shares(q.to_numpy(zero_copy_only=False), every, terms)
            value = apart(p, q)
            # Terms come in order of their bytes, so a stable sort settles ties.
            order = np.lexsort((-value, row))
            order = order[(p > q)[order]]
            starts = np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]][: len(order)])
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
            best = order[rank < top]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[best])), b.column(1).take(pa.array(row[best])), term.take(pa.array(best)), pa.array(value[best], pa.int64())], names=["lang", "source", "item", "value"])

    return packed.select("lang", "source", "total", "terms", "all", "term", "n", "q").mapInArrow(run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group and part, ranked by value, ties by the item's bytes.

    Part 'pair': each other source of the language, by the sum of all kept terms' differences; part 'term': the ``top`` terms that
    the group has and uses more than its language does, by their difference from the language's profile. Null texts,
    languages and sources count as ''; groups without terms have pairs; a language without kept terms has pairs of value 0; a
    language of one source has none; repeated rows count as often as they stand; an empty table gives no rows; other columns
    are ignored. Kept are the terms of ``least_docs`` documents of the language or more.
    """
    d = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    n_buckets = cyclic_parts(d.sparkSession, text_bytes(d, "text"), BUCKET_BYTES)
    packed = cut(profiles(term_counts(d, n_buckets), n_buckets, least_docs))
    chunks = packed.groupBy("lang", "rng", "chunk").agg(F.first("m").alias("m"), F.first("q_sum").alias("q_sum"))
    ranges = cut(chunks.groupBy("lang", "rng").agg(F.sum("m").alias("in_range"), F.sum("q_sum").alias("all")))
    sized = ranges.groupBy("lang").agg(F.sum("in_range").alias("terms"), F.sum("all").alias("all"))
    totals = packed.groupBy("lang", "source").agg(F.sum("n_sum").alias("total"))
    groups = d.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(sized, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.join(langs, "lang").join(totals, ["lang", "source"], "left")
    groups = cut(groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"), F.coalesce("all", zero).alias("all"), "blocks"))
    sums = pair_sums(groups.drop("all"), packed, ranges.select("lang", "rng", "in_range"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    line = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", both.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(line))
    best = leading_terms(packed.select("lang", "source", "term", "n", "q").join(groups, ["lang", "source"]), top)
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)
    return pairs.unionByName(best)

"""Exact Jaccard join of documents on distinct word shingles, by prefixes and token combinations.

Tokens are hashes of five-word shingles; equal sets are one set from the start. A packed exchange tells each set which
of its n tokens another set shares; at least a = ceil(t * n) must be, or the set has no partner. Tokens in global order
are the unshared ones, then the shared ones by hash, so a prefix is the unshared tokens and the first shared ones.
Two sets over the threshold share c tokens or more among their first n - a + c (for each c up to a).

Signatures: shared tokens of the plain prefix (c = 1), if few prefixes hold them. A set whose plain prefix has a
frequent token extends it to c = g + 1 and indexes its rare tokens alone and its frequent tokens in pairs, both of one
of g hash classes: among g + 1 shared frequent tokens two are in one class. g is a power of two by set size; a
set indexes for each g that a partner of no larger size may have. Sets under one signature are verified by their token
arrays: first each set with HUBS sets, those of its signatures with the least share of unshared tokens, the likely centres of
groups of near copies; then, where a signature's sets are not yet in one component, each set with the blocks of sets that
hold higher components there, all sets of a block at once by a token index. Links inside a component add nothing to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.llm import exchange as X
from confluo.llm.common import ID, KEY, TEXT, cut, narrow, release, row_key, slices
from confluo.llm.components import components

SHINGLE, NUM, DEN = 5, 3, 4
#: A token in the plain prefixes of more sets than this is frequent.
FREQUENT = 1000
#: Hubs that a set meets before sets that are left meet blocks.
HUBS = 3
#: Sets of a block, askers of a part of a block; copies of a row that a hot key may meet.
BLOCK, PART, SALTS = 256, 256, 16
#: Sets of a chunk that gather in one bucket; stands for any number of owners that isn't known.
HOME, MANY = 128, (1 << 32) - 1
#: Tokens of a bucket that are compared at once.
AT_ONCE = 1 << 18
#: Hashes of tokens that a first look at a set and a block compares.
FEW = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text: bytes | None) -> np.ndarray:
    """Sorted distinct token hashes of a text: of its five-word shingles, or of all its words if there are fewer."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = X.word_codes(words)
    if len(words) < SHINGLE:
        return X.windows(np.r_[codes, np.full(1, len(words), np.uint64)], len(words) + 1, X.M3)
    return np.unique(X.windows(codes, SHINGLE))


def set_id(t: np.ndarray) -> int:
    """64 bits over a token set, as a signed number; never the one that stands for the empty set."""
    return int(np.int64(np.uint64(X.xxh3_64_intdigest(t.tobytes())))) if len(t) else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def shared_sets(d: DataFrame, n_buckets: int) -> DataFrame:
    """(set, n, toks): the sets with enough shared tokens to have a partner, with those tokens, sorted, as bytes.

    A token's owner is a place in its chunk, a small number beside the chunk's own, so that a packed row costs the same a token
    however many buckets there are; the chunk's home buckets know its sets. A set that k chunks hold has k owners: a token of it
    that has k owners too is no other set's.
    """
    per = X.per_row(n_buckets)

    def home(chunk: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The buckets where HOME sets of a chunk gather their replies."""
        return X.spread((chunk.view(np.uint64) + (at // HOME).astype(np.uint64) * X.M2).view(np.int64), n_buckets)

    def settle(chunk: dict[int, np.ndarray]) -> pa.RecordBatch:
        sets = np.fromiter(chunk, np.int64, len(chunk))
        n = np.array([len(t) for t in chunk.values()], np.int64)
        number = np.int64(np.uint64(X.xxh3_64_intdigest(sets.tobytes()) | 1))
        same = lambda x, k: np.broadcast_to(np.int64(x), k)
        here = lambda k: same(number, k)
        h, doc = np.concatenate(list(chunk.values())), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(h, kind="stable")
        s, e = X.slices(h[order])
        at = order[np.repeat(e - s > 1, e - s)]
        every = np.arange(len(sets))
        out = X.pack(2, sets.view(np.uint64), here(len(sets)), n, every, home(here(len(sets)), every), per)
        # Known as shared here; one entry without an owner tells the other chunks.
        out += X.pack(1, h[at], here(len(at)), same(MANY, len(at)), doc[at], home(here(len(at)), doc[at]), per)
        first, several = order[s], e - s > 1
        del at, order, s, e
        place = doc[first]
        place[several] = 0
        h = h[first]
        del doc, first
        return X.rows(out + X.pack(0, h, np.where(several, 0, number), same(0, len(h)), place, X.spread(h, n_buckets), per))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        chunk, size = {}, 0
        for b in slices(batches):
            for text in b.column(0).cast(pa.binary()).to_pylist():
                t = tokens(text)
                if len(t) and (i := set_id(t)) not in chunk:
                    chunk[i] = t
                    size += len(t)
                if size >= X.CHUNK:
                    yield settle(chunk)
                    chunk, size = {}, 0
        if chunk:
            yield settle(chunk)
        chunk = None
        release()

    def find(table: pa.Table) -> pa.Table:
        release()
        all_h, all_owner, _, all_at, _ = X.unpack(table, 0, ("value", "owner", "at"))
        found = [(all_h[:0], all_owner[:0], all_owner[:0], all_at[:0])]
        for part in X.parts(all_h, AT_ONCE):
            if not len(part):
                continue
            h, owner, at = all_h[part], all_owner[part], all_at[part]
            order = np.lexsort((at, owner, h))
            h, owner, at = h[order], owner[order], at[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])]  # copies of a chunk fall away
            h, owner, at = h[new], owner[new], at[new]
            s, e = X.slices(h)
            owners = np.where(np.add.reduceat((owner == 0).astype(np.int64), s) > 0, MANY, e - s)
            owners = np.repeat(owners, e - s)
            several = (owners > 1) & (owner != 0)
            found.append((h[several], owner[several], owners[several], at[several]))
        del all_h, all_owner, all_at
        h, owner, owners, at = map(np.concatenate, zip(*found))
        del found
        out = X.pack(1, h, owner, owners, at, home(owner, at), per)
        return pa.concat_tables([X.of_kind(table, 1, 2), pa.Table.from_batches([X.rows(out)])])

    def gather(table: pa.Table) -> pa.Table:
        release()
        sets, chunk, n, place, _ = X.unpack(table, 2, ("value", "owner", "mark", "at"))
        order = np.lexsort((place, chunk))
        order = order[np.r_[True, (chunk[order][1:] != chunk[order][:-1]) | (place[order][1:] != place[order][:-1])][: len(order)]]
        at_row = {x: i for i, x in enumerate(zip(chunk[order].tolist(), place[order].tolist()))}
        sets, n = sets[order].view(np.int64), n[order]
        h, owner, owners, at, _ = X.unpack(table, 1, ("value", "owner", "mark", "at"))
        order = np.lexsort((h, at, owner))
        h, owner, owners, at = h[order], owner[order], owners[order], at[order]
        other = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])
        new = np.r_[True, other | (h[1:] != h[:-1])][: len(h)]
        h, owner, owners, at = h[new], owner[new], owners[new], at[new]
        s = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1])][: len(h)])
        e = np.r_[s[1:], len(h)][: len(s)]
        row = np.array([at_row[x] for x in zip(owner[s].tolist(), at[s].tolist())], np.int64)
        keep = DEN * (e - s) >= NUM * n[row]
        s, e, row = s[keep], e[keep], row[keep]
        toks, times = ([x[i:j].tobytes() for i, j in zip(s, e)] for x in (h, owners.astype(np.uint32)))
        return pa.table([pa.array(sets[row]), pa.array(n[row]), pa.array(toks, pa.binary()), pa.array(times, pa.binary())], names=["set", "n", "toks", "owners"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without the tokens that only the set's own copies have."""
        for b in batches:
            rows = []
            for i, n, toks, owners, k in zip(*(c.to_pylist() for c in b.columns)):
                if k > 1:
                    toks = np.frombuffer(toks, np.uint64)[np.frombuffer(owners, np.uint32) > k].tobytes()
                if DEN * (len(toks) // 8) >= NUM * n:
                    rows.append((i, n, toks))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["set", "n", "toks"])

    schema = "set long, n long, toks binary"
    found = X.exchange(d.select(TEXT).mapInArrow(send, X.SCHEMA), n_buckets, find, gather, schema + ", owners binary")
    once = found.groupBy("set").agg(*(F.first(c).alias(c) for c in ("n", "toks", "owners")), F.count("*").alias("k"))
    return once.mapInArrow(others, schema)


def prefix(n: int, toks: np.ndarray, c: int = 1) -> np.ndarray:
    """The shared tokens among the first n - ceil(t * n) + c of a set."""
    need = -(-NUM * n // DEN)
    return toks[: max(0, n - need + c - (n - len(toks)))]


def classes(n: int) -> list[int]:
    """Numbers of hash classes to index a set under: those of each smaller size a partner may have, its own first.

    The number is about the plain prefix's length of the smallest size with the same bit length, so pairs stay few.
    """
    one = lambda m: max(1, min((1 << m.bit_length() - 1) // DEN, -(-NUM * m // DEN) - 1))
    least = -(-NUM * n // DEN)
    powers = [1 << k for k in range(least.bit_length(), n.bit_length())]
    sizes = {n, least, *powers, *(p - 1 for p in powers)}
    return sorted({one(m) for m in sizes if least <= m <= n and m >= 2})


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return _signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)


def _batch(**columns) -> pa.RecordBatch:
    """A batch of 64-bit numbers."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def plain_rows(sets: DataFrame) -> DataFrame:
    """(tok, set, n, s, pos) for the plain prefixes; s is the number of shared tokens, pos the token's place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(s, n, prefix(n, np.frombuffer(t, np.uint64)), len(t) // 8) for s, n, t in zip(*(c.to_pylist() for c in b.columns))]
            k = [len(g[2]) for g in got]
            each = lambda i, got=got, k=k: np.repeat(np.array([g[i] for g in got], np.int64), k)
            place = _joined([np.arange(len(g[2]), dtype=np.int64) + g[1] - g[3] for g in got])
            yield _batch(tok=_joined([g[2] for g in got]), set=each(0), n=each(1), s=each(3), pos=place)

    return sets.mapInArrow(run, "tok long, set long, n long, s long, pos long")


def combination_rows(hot: DataFrame) -> DataFrame:
    """(sig, set, n, s) for sets with frequent tokens; ``hot`` has set, n, toks and frequent: the frequent ones among its
    longest prefix. Rare tokens are signatures by themselves, frequent ones in pairs of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, owner, size, shared = [], [], [], []
            for s, n, t, frequent in zip(*(c.to_pylist() for c in b.columns)):
                toks, often = np.frombuffer(t, np.uint64), np.array(sorted(frequent or []), np.int64).view(np.uint64)
                mine = []
                for g in classes(n):
                    p = prefix(n, toks, g + 1)
                    isin = np.isin(p, often)
                    mine.append(p[~isin])
                    q = p[isin]
                    kind = X.stir(q * X.M2) % np.uint64(g)
                    order = np.argsort(kind, kind="stable")
                    q, kind = q[order], kind[order]
                    for i, j in zip(*X.slices(kind)):
                        x, y = np.triu_indices(j - i, 1)
                        lo, hi = np.minimum(q[i:j][x], q[i:j][y]), np.maximum(q[i:j][x], q[i:j][y])
                        mine.append(X.stir(X.stir(lo * X.M3 + np.uint64(g)) ^ hi))
                mine = np.unique(np.concatenate(mine)) if mine else np.zeros(0, np.uint64)
                sig.append(mine)
                owner += [s] * len(mine)
                size += [n] * len(mine)
                shared += [len(toks)] * len(mine)
            yield _batch(sig=_joined(sig), set=owner, n=size, s=shared)

    return hot.select("set", "n", "toks", "frequent").mapInArrow(run, "sig long, set long, n long, s long")


def longest_rows(hot: DataFrame) -> DataFrame:
    """(tok, set) for the longest prefixes of sets with frequent tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(s, prefix(n, np.frombuffer(t, np.uint64), max(classes(n), default=0) + 1)) for s, n, t in zip(*(c.to_pylist() for c in b.columns))]
            yield _batch(tok=_joined([g[1] for g in got]), set=np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1]) for g in got]))

    return hot.select("set", "n", "toks").mapInArrow(run, "tok long, set long")


def may(x: str, y: str) -> Column:
    """J >= 3/4 asks for 3 (n + m) <= 7 * intersection. No more than the shared tokens of either set can be in both, and
    none before their first common one; a pair that this rejects at a later common token is met at the first."""
    c = lambda of, name: F.col(f"{of}{name}")
    most = F.least(c(x, "s"), c(y, "s"), c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    return (NUM + DEN) * most >= NUM * (c(x, "n") + c(y, "n"))


def met(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, part, asker, set, comp, n, toks): a row an ask and a member, those of a part together, members first. A block that
    very many sets ask is met in parts of PART askers."""
    parts = asks.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    # A block may be asked by a third of all sets: its number of parts reaches them by a salted join.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = asks.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int"))
    part = F.pmod(F.xxhash64("set", F.lit("part")), "parts").cast("int").alias("part")
    asking = salted.join(parts.select("block", "parts", salts), ["block", "salt"]).select("block", part, F.lit(1).alias("asker"), "set", "comp")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = members.join(parts, "block").select("block", every, F.lit(0).alias("asker"), "set", "comp")
    rows = asking.unionByName(asked).join(sets, "set").select("block", "part", "asker", "set", "comp", "n", "toks")
    return rows.repartition("block", "part").sortWithinPartitions("block", "part", "asker")


def thinned(sets: DataFrame) -> DataFrame:
    """``sets`` with the 16-bit hashes of their tokens in place of these, ascending, their differences packed: about a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = []
            for t in b.column(2).to_pylist():
                few = np.sort((np.frombuffer(t, np.uint64) % np.uint64(FEW)).astype(np.uint16))
                step = np.diff(few, prepend=np.uint16(0))
                wide = step > 254  # a step is a byte, or 255 and two
                size = np.where(wide, 3, 1)
                at, out = np.cumsum(size) - size, np.empty(size.sum(), np.uint8)
                out[at] = np.where(wide, 255, step)
                out[at[wide] + 1], out[at[wide] + 2] = step[wide] & 255, step[wide] >> 8
                toks.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(toks, pa.binary())], names=["set", "n", "toks"])

    return sets.select("set", "n", "toks").mapInArrow(run, "set long, n long, toks binary")


def fattened(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct hashes of ``thinned``, how often each stands)."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    marks = np.flatnonzero(x == 255)
    if len(marks):
        # A mark's two bytes may be 255 themselves: marks are taken from the left.
        true, upto = [], -1
        for m in marks.tolist():
            if m > upto:
                true.append(m)
                upto = m + 2
        true = np.array(true)
        x[true] = x[true + 1] + 256 * x[true + 2]
        x = np.delete(x, np.r_[true + 1, true + 2])
    return np.unique(np.cumsum(x), return_counts=True)


def worth_asking(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``asks`` that may have a link: with some member of another component the asker has enough 16-bit hashes in
    common, each as often as it stands in both, which is never less than the tokens that they have in common. No link is lost, and an ask
    costs a byte a token here, not eight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, index = None, [], None
        for batch in batches:
            blocks, sets_, comps_ = [], [], []
            for block, part, asker, s, comp, n, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, part) != key:
                    key, members, index = (block, part), [], None
                hashes, times = fattened(t)
                if not asker:
                    members.append((comp, n, hashes, times))
                    continue
                if index is None:
                    comps, sizes = (np.array([m[i] for m in members], np.int64) for i in range(2))
                    every, often = (np.concatenate([m[i] for m in members]) for i in (2, 3))
                    owner = np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], often[order]
                at, to = np.searchsorted(index[0], hashes, "left"), np.searchsorted(index[0], hashes, "right")
                hit = np.repeat(at - np.r_[0, np.cumsum(to - at)[:-1]], to - at) + np.arange((to - at).sum())
                least = np.minimum(index[2][hit], np.repeat(times, to - at))
                both = np.bincount(index[1][hit], least, minlength=len(comps))
                if ((DEN * both >= NUM * (n + sizes - both)) & (comps != comp)).any():
                    blocks.append(block)
                    sets_.append(s)
                    comps_.append(comp)
            yield _batch(block=blocks, set=sets_, comp=comps_)

    found = met(asks, members, thinned(sets)).mapInArrow(run, "block long, set long, comp long")
    return cut(found)


def asked_links(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for each (set, block) of ``asks``, a link of the set with each component that the block's members over the threshold have.

    ``members`` (block, set) deals sets into blocks; both have ``comp``, the component a set is known to be in.
    A token index over the members answers each asker, so no pair becomes a row unless it is a link between components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, index = None, [], None
        for batch in batches:
            a, b = [], []
            for block, part, asker, s, comp, n, t in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, part) != key:
                    key, members, index = (block, part), [], None
                toks = np.frombuffer(t, np.uint64)
                if not asker:
                    members.append((s, comp, n, toks))
                    continue
                if index is None:
                    ids, comps, sizes = (np.array([m[i] for m in members], np.int64) for i in range(3))
                    every = np.concatenate([m[3] for m in members])
                    owner = np.repeat(np.arange(len(members)), [len(m[3]) for m in members])
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order]
                at, to = np.searchsorted(index[0], toks, "left"), np.searchsorted(index[0], toks, "right")
                hit = np.repeat(at - np.r_[0, np.cumsum(to - at)[:-1]], to - at) + np.arange((to - at).sum())
                both = np.bincount(index[1][hit], minlength=len(ids))
                good = np.flatnonzero((DEN * both >= NUM * (n + sizes - both)) & (comps != comp))
                good = good[np.unique(comps[good], return_index=True)[1]]
                a += [s] * len(good)
                b += ids[good].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met(asks, members, sets).mapInArrow(run, "a long, b long")


def hub_links(sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each set with a few hubs: of its signatures' sets with the least share of unshared tokens, the HUBS least."""
    apart = ((F.col("n") - F.col("s")) / F.col("n")).alias("apart")
    hubs = sigs.groupBy("sig").agg(F.min(F.struct(apart, "set", "n", "s", "pos")).alias("hub"), F.count("*").alias("size"))
    stars = sigs.join(hubs.where("size > 1"), "sig").where((F.col("set") != F.col("hub.set")) & may("", "hub."))
    best = F.slice(F.array_sort(F.collect_set(F.struct("hub.apart", "hub.set"))), 1, HUBS)  # of one set's signatures
    asks = cut(stars.groupBy("set").agg(best.alias("best")).select("set", F.explode("best.set").alias("block")))
    members = asks.select("block").distinct().select("block", F.col("block").alias("set"), F.col("block").alias("comp"))
    return asked_links(asks.withColumn("comp", F.col("set")), members, sets)


def across_links(sigs: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets of one signature that ``comp`` has in different components.

    A component's rank is its size, then its number. A set is dealt into the cell of the highest component that its
    signatures lead to, a cell into blocks of about BLOCK sets. Under each signature a set asks for the blocks
    that hold a set of higher rank, and meets each block once whatever the number of signatures that lead to it: a set that
    stays outside a large family costs a row a block, not a row a member, and a family of sets without links no more.
    """
    member = sigs.join(comp.withColumnRenamed("node", "set"), "set", "left").withColumn("comp", F.coalesce("component", F.col("set")))
    mixed = member.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    rest = cut(member.join(mixed, "sig").select("sig", "set", "n", "s", "pos", "comp"))
    # One component may be that of a third of all rows: counts are partial sums, joins on components and cells are salted.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salt = F.pmod(F.xxhash64("set"), F.lit(SALTS)).cast("int")
    who = rest.select("set", "comp").distinct()
    size = who.groupBy("comp").agg(F.count("*").alias("k"))
    ranked = who.withColumn("salt", salt).join(size.select("comp", "k", salts), ["comp", "salt"]).select("set", F.struct("k", "comp").alias("rank"))
    known = cut(rest.drop("comp").join(ranked, "set"))
    top = known.groupBy("sig").agg(F.max("rank").alias("top"))
    cells = known.join(top, "sig").groupBy("set", "rank").agg(F.max("top").getField("comp").alias("cell"))
    blocks = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    number = F.pmod(F.xxhash64("set", F.lit("block")), F.col("blocks"))
    dealt = cells.withColumn("salt", salt).join(blocks.select("cell", "blocks", salts), ["cell", "salt"])
    placed = cut(dealt.select("set", "rank", "cell", number.alias("number"), F.xxhash64("cell", number).alias("block")))
    held = known.drop("rank").join(placed, "set")
    left = F.col("n") - F.col("pos")
    best = [F.max("rank").alias("most"), F.min("n").alias("o_n"), F.max(F.least("s", left)).alias("o_s")]
    there = held.groupBy("sig", "block", F.shiftright("number", 10).alias("page")).agg(*best)
    # The blocks of a signature as lists, a page of a cell each, so the join below has as many rows as sets have signatures.
    lists = there.groupBy("sig", "page").agg(F.collect_list(F.struct("block", "most", "o_n", "o_s")).alias("list"), F.max("most").alias("most"))
    # The bound of may(), for what the block's sets have at most.
    fits = lambda x: (NUM + DEN) * F.least("s", left, x["o_s"]) >= NUM * (F.col("n") + x["o_n"])
    higher = F.transform(F.filter("list", lambda x: (x["most"] > F.col("rank")) & fits(x)), lambda x: x["block"])
    led = held.join(lists, "sig").where(F.col("rank") < F.col("most"))
    each = led.select("set", F.array_sort(higher).alias("mine"), F.col("rank.comp").alias("comp")).where(F.size("mine") > 0).distinct()
    asks = each.groupBy("set", "comp").agg(F.array_distinct(F.flatten(F.collect_set("mine"))).alias("mine"))
    asks = cut(asks.select("set", "comp", F.explode("mine").alias("block")))
    members = placed.select("block", "set", F.col("rank.comp").alias("comp"))
    asks = worth_asking(asks, members, sets)
    return asked_links(asks, members.join(asks.select("block").distinct(), "block"), sets)


def signatures(sets: DataFrame) -> DataFrame:
    """(sig, set, n, s, pos), for signatures of two sets or more but for combinations."""
    plain = plain_rows(sets)
    count = plain.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1")
    classed = cut(plain.join(count, "tok"))
    often = classed.where(F.col("c") > FREQUENT)
    single = classed.where(F.col("c") <= FREQUENT).select(F.col("tok").alias("sig"), "set", "n", "s", "pos")
    if often.isEmpty():
        return single
    hot = cut(sets.join(often.select("set").distinct(), "set"))
    marks = longest_rows(hot).join(often.select("tok").distinct(), "tok").groupBy("set").agg(F.collect_list("tok").alias("frequent"))
    # Signatures of extended prefixes have no place: they needn't be the first that two sets share.
    return cut(single.unionByName(combination_rows(hot.join(marks, "set")).withColumn("pos", F.lit(0).cast("long"))))


def linked(sets: DataFrame) -> DataFrame:
    """(node, component) over ``sets`` (set, n, toks), for sets with a link."""
    sigs = signatures(sets)
    comp = components(hub_links(sigs, sets))
    second = cut(across_links(sigs, comp, sets))
    if second.isEmpty():
        return comp
    # The few links between components join them: the components are the nodes now.
    of = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = second.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = cut(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")))
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    alone = ends.select(F.col("ca").alias("node")).union(ends.select("cb")).distinct()
    every = comp.union(alone.select("node", F.col("node").alias("component"))).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    last = joined.select(F.col("node").alias("component"), F.col("component").alias("root"), salts)
    every = every.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(last, ["component", "salt"], "left")
    return every.select("node", F.coalesce("root", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, component) for each row; the row's key is in KEY.

    The class of a document is the smallest id that links reach; unrelated texts under one id may share it, so the component
    itself, a number of its sets, stands beside it (null without shingles). Texts without words, and null texts, have no shingles
    and are alone; such rows, like rows with a null id that reach no id, have their own id as class. Rows with one id are judged by
    their own texts, repeated rows too; an empty table gives no rows; other columns are ignored. The id is an integer.
    """
    d = narrow(docs, id_col, text_col)
    kind = d.schema[ID].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, 1024):
            got = [tokens(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
            size, name = pa.array([len(t) for t in got], pa.int64()), pa.array([set_id(t) for t in got], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, name], names=[ID, KEY, "n_shingles", "set"])

    sized = cut(d.withColumn(KEY, row_key(F.col(ID), F.col(TEXT))).select(ID, KEY, TEXT).mapInArrow(digest, f"{ID} {kind.simpleString()}, {KEY} long, n_shingles long, set long"))
    sets = cut(shared_sets(d, X.buckets_for(d)))
    comp = linked(sets)
    full = sized.where("n_shingles > 0")
    # A set may be that of a third of all rows: its rows meet in partial minima, and in a salted join.
    least = full.groupBy("set").agg(F.min(ID).alias("low"))
    group = least.join(comp, least["set"] == comp["node"], "left").select("set", "low", F.coalesce("component", F.col("set")).alias("component"))
    lows = group.groupBy("component").agg(F.min("low").alias("component_id"))
    named = group.join(lows, "component").select("set", "component_id", "component", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    j = sized.withColumn("salt", F.pmod(F.col(KEY), F.lit(16)).cast("int")).join(named, ["set", "salt"], "left")
    some = F.col("n_shingles") > 0
    least_id = F.when(some, F.coalesce("component_id", F.col(ID))).otherwise(F.col(ID)).alias("component_id")
    return j.select(F.col(ID).alias(id_col), KEY, "n_shingles", least_id, F.when(some, F.col("component")).alias("component"))


def keep_one(docs: DataFrame, classes_: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, columns of any name as they are, with exactly one row of each component: the smallest id (nulls last), then key.

    Of equal rows, which may differ in other columns, the one of the smallest hash of all columns, then the first stays; they meet
    in a grouped minimum, never in one sort. ``docs`` must give its rows in the same partitions each time, as a table that is
    read does. Rows without shingles are in no component and stay; an empty table gives no rows.
    """
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(KEY).alias("key")))
    classes_ = cut(classes_.select(id_col, KEY, "component"))  # read three times
    best = classes_.where("component is not null").groupBy("component").agg(first.alias("first")).select(F.col("first.key").alias("k"))
    alone = classes_.where("component is null").select(F.col(KEY).alias("k"), F.lit(0).cast("long").alias("rows")).distinct()
    rows = classes_.groupBy(KEY).agg(F.count("*").alias("rows"))
    kept = best.join(rows, F.col("k") == F.col(KEY)).select("k", "rows")
    names = {n: f"__keep_{i}" for i, n in enumerate(docs.columns)}
    # Maps can't be hashed.
    tie = F.xxhash64(*[docs[n] for n, t in docs.dtypes if "map<" not in t])
    own = [row_key(docs[id_col], docs[text_col]).alias("__keep_key"), F.monotonically_increasing_id().alias("__keep_at"), tie.alias("__keep_tie")]
    keyed = docs.select(*[F.col(f"`{n}`").alias(x) for n, x in names.items()], *own)
    several = keyed.select("__keep_key", "__keep_at", "__keep_tie").join(kept.where("rows > 1"), F.col("__keep_key") == F.col("k"))
    one = several.groupBy("k").agg(F.min(F.struct("__keep_tie", "__keep_at")).alias("m")).select(F.col("k").alias("k1"), F.col("m.__keep_at").alias("only"))
    plan = cut(kept.join(one, F.col("k") == F.col("k1"), "left").select("k", "only").unionByName(alone.select("k", F.lit(None).cast("long").alias("only"))))
    chosen = keyed.join(plan, F.col("__keep_key") == F.col("k")).where(F.col("only").isNull() | (F.col("only") == F.col("__keep_at")))
    return chosen.select(*[F.col(x).alias(n) for n, x in names.items()])

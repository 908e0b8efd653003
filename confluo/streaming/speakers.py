"""Online speakers of streams that end: typed state, merges by hand, logs that are drained each micro-batch, a lifetime.

One operator takes rows of three kinds: 'turn' (a turn to identify), 'merge' (join ``source`` into ``target``, both speakers' numbers)
and 'end' (the stream is over). It gives rows of kind 'turn' (speaker, confidence), 'merge' (other became speaker), 'invalid' (a rule that
vectors broke, and how often), 'warning' (a merge of speakers that aren't known) and 'ended'. Merges and broken rules
come once, in the micro-batch that made them, so they add up to the log of the whole stream wherever it is cut.

State is a map of speakers, a map of moves between them and one row of counters. It goes when the stream ends, or when the
watermark passes LIFETIME after its last turn; then the speakers are consolidated first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from confluo.operators import cluster

#: Milliseconds of event time after its last turn that a stream's state is kept.
LIFETIME = 6 * 3600 * 1000
#: Micro-batches of such a stream need this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROWS = "stream_id long, kind string, ts timestamp, turn_id long, v array<double>, start double, end double, duration double, chunk long, label long, is_overlap boolean, is_onset boolean, target long, source long"
OUT = "stream_id long, kind string, turn_id long, speaker long, other long, confidence double, note string, n long"
_SPEAKER = "centroid array<double>, protos array<array<double>>, weights array<long>, count long, last_seen double, chunks array<long>, labels array<long>, variance double"
_ORDER = {"turn": 0, "merge": 1, "end": 2}


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def turn_rows(turns: DataFrame, begin: int = 1704067200) -> DataFrame:
    """Turns (stream_id and the columns of cluster.SPEAKER_TURNS) as rows of the operator; their event time is the start, in seconds
    from ``begin`` on (a stream's watermark begins at the epoch, so nothing at the epoch itself would be in time)."""
    none = [F.lit(None).cast("long").alias(c) for c in ("target", "source")]
    return turns.select("stream_id", F.lit("turn").alias("kind"), F.timestamp_millis(((F.col("start") + begin) * 1000).cast("long")).alias("ts"), *cluster.SPEAKER_TURNS, *none).select(*_names(ROWS))


class Speakers(StatefulProcessor):
    def __init__(self, settings: cluster.Settings | None = None, lifetime: int = LIFETIME):
        self.settings, self.lifetime = settings, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.speakers = handle.getMapState("speakers", "number long", _SPEAKER)
        self.moves = handle.getMapState("moves", "a long, b long", "n long")
        self.counters = handle.getValueState("counters", "next long, seen long, last long, last_end double, timer long")

    def _loaded(self) -> tuple[cluster.Clusterer, int]:
        c, timer = cluster.Clusterer(self.settings), 0
        if self.counters.exists():
            c.next, c.seen, last, c.last_end, timer = self.counters.get()
            c.last = None if last < 0 else last
        for (number,), (centroid, protos, weights, count, seen, chunks, labels, variance) in self.speakers.iterator():
            held = [[np.array(p, float), n] for p, n in zip(protos, weights)]
            c.speakers[number] = cluster.Speaker(number, np.array(centroid, float), held, count, seen, list(zip(chunks, labels)), variance)
        c.speakers = dict(sorted(c.speakers.items()))
        c.moves = {(a, b): n for (a, b), (n,) in self.moves.iterator()}
        return c, timer

    def _store(self, c: cluster.Clusterer, had: tuple[set, set], timer: int) -> None:
        for number in had[0] - set(c.speakers):
            self.speakers.removeKey((number,))
        for move in had[1] - set(c.moves):
            self.moves.removeKey(move)
        for k, p in c.speakers.items():
            chunks, labels = zip(*p.chunks) if p.chunks else ((), ())
            value = (p.centroid.tolist(), [q.tolist() for q, _ in p.protos], [int(n) for _, n in p.protos], int(p.count), float(p.last_seen), [int(x) for x in chunks], [int(x) for x in labels], float(p.variance))
            self.speakers.updateValue((k,), value)
        for move, n in c.moves.items():
            self.moves.updateValue(move, (n,))
        self.counters.update((c.next, c.seen, -1 if c.last is None else c.last, float(c.last_end), timer))

    def _clear(self) -> None:
        self.speakers.clear()
        self.moves.clear()
        self.counters.clear()

    def _drained(self, stream: int, c: cluster.Clusterer) -> list[tuple]:
        """What the clusterer did since its state was loaded."""
        out = [(stream, "merge", None, kept, lost, None, None, 1) for lost, kept in c.merges]
        return out + [(stream, "invalid", None, None, None, None, rule, n) for rule, n in sorted(c.invalid.items())]

    def _timed(self, timer: int, latest: int) -> int:
        """One timer a stream: a lifetime after its latest turn."""
        due = latest + self.lifetime
        if due <= timer:
            return timer
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        return due

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=_names(OUT)).astype({c: "Int64" for c in ("turn_id", "speaker", "other", "n")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stream, (c, timer) = int(key[0]), self._loaded()
        had, out, log = (set(c.speakers), set(c.moves)), [], []
        every = pd.concat(list(rows))
        every = every.assign(order=every["kind"].map(_ORDER)).sort_values(["ts", "order", "turn_id"], kind="stable")
        for r in every.itertuples():
            if r.kind == "turn":
                number, sure = c.identify(np.asarray(r.v, float), r.start, r.start, r.end, r.chunk, r.label, bool(r.is_overlap), bool(r.is_onset), r.duration)
                out.append((stream, "turn", int(r.turn_id), -1 if number is None else number, None, round(sure, 6), None, 1))
            elif r.kind == "merge":
                if not c.merge_by_hand(int(r.target), int(r.source)):
                    out.append((stream, "warning", None, int(r.target), int(r.source), None, "unknown speaker", 1))
            else:
                # What comes after the end, even in the same micro-batch, is a new stream.
                c.consolidate()
                log += [*self._drained(stream, c), (stream, "ended", None, None, None, None, "end", c.seen)]
                c = cluster.Clusterer(self.settings)
        log += self._drained(stream, c)
        if c.seen:
            self._store(c, had, self._timed(timer, int(every["ts"].max().timestamp() * 1000)))
        else:
            if timer:
                self.handle.deleteTimer(timer)
            self._clear()
        yield self._frame(out + log)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c, _ = self._loaded()
        c.consolidate()
        self._clear()
        yield self._frame([*self._drained(int(key[0]), c), (int(key[0]), "ended", None, None, None, None, "lifetime", c.seen)])

    def close(self) -> None:
        pass


def speakers(rows: DataFrame, settings: cluster.Settings | None = None, lifetime: int = LIFETIME, delay: str = "10 seconds") -> DataFrame:
    """``rows`` (as ROWS, a stream) to OUT. Turns of a micro-batch are taken in order of event time, then merges, then ends."""
    timed = rows.withWatermark("ts", delay)
    return timed.groupBy("stream_id").transformWithStateInPandas(Speakers(settings, lifetime), OUT, "Append", "EventTime")

"""Rate conversion of sampled streams by a polyphase windowed sinc.

Output sample m stands at input position m * rate_in / rate_out and is the sum of the input samples within HALF zero crossings
of the sinc (of the lower of the two rates), each weighed by the sinc under a Hann window; there is silence before and after a stream. The
weights depend on m modulo the reduced output rate alone, so they are a table of that many phases.

In a batch, frames are cut anew into blocks of BLOCK input samples, each with the margin that its output needs, so a stream of any
length is many tasks and the cut into frames doesn't matter. In a stream, ``Resampled`` carries the samples that later output
needs from frame to frame, and gives the rest when the stream ends.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from confluo.operators import scan

#: Fixed value: the rate that speech is taken at.
TARGET = 16000
#: Zero crossings on each side, input samples of a block.
HALF, BLOCK = 16, 1 << 16


@functools.cache
def phases(rate_in: int, rate_out: int) -> tuple[int, int, int, np.ndarray]:
    """(up, down, reach, weights): output m is at input position m * down / up; weights[p, j] is that of the input sample ``j - reach``
    after the integer part of the position, for phase p = m * down modulo up."""
    up, down = rate_out // gcd(rate_in, rate_out), rate_in // gcd(rate_in, rate_out)
    share = min(1.0, up / down)
    width = HALF / share
    reach = int(np.ceil(width))
    t = np.arange(up)[:, None] / up - np.arange(-reach, reach + 1)[None, :]
    window = np.where(np.abs(t) < width, 0.5 + 0.5 * np.cos(np.pi * t / width), 0.0)
    return up, down, reach, share * np.sinc(share * t) * window


def outputs(samples: np.ndarray, first: int, lo: int, hi: int, rate_in: int, rate_out: int) -> np.ndarray:
    """Output samples lo to hi; ``samples`` are the input from number ``first`` on, silence elsewhere."""
    up, down, reach, weights = phases(rate_in, rate_out)
    m = np.arange(lo, hi)
    whole, phase = np.divmod(m * down, up)
    out = np.zeros(len(m))
    step = max(1, (1 << 20) // (2 * reach + 1))
    for k in range(0, len(m), step):
        at = whole[k : k + step, None] + np.arange(-reach, reach + 1)[None, :] - first
        inside = (at >= 0) & (at < len(samples))
        x = np.where(inside, samples[np.clip(at, 0, max(0, len(samples) - 1))], 0.0) if len(samples) else np.zeros(at.shape)
        out[k : k + step] = (x * weights[phase[k : k + step]]).sum(1)
    return out


def count_out(n: int, rate_in: int, rate_out: int) -> int:
    """Output samples whose position is before input sample n."""
    up, down, _, _ = phases(rate_in, rate_out)
    return -(-n * up // down)


def resample(frames: DataFrame, rate_in: int, rate_out: int = TARGET, parts: int | None = None) -> DataFrame:
    """(stream_id, first, samples): blocks of output samples from number ``first`` on. ``frames`` (stream_id, frame_id, samples: array of
    double) are in order of frame_id; a null frame is empty, a null sample silence; ``parts`` as in scan.py."""
    reach = phases(rate_in, rate_out)[2]
    sized = frames.select("stream_id", "frame_id", F.coalesce("samples", F.array().cast("array<double>")).alias("samples"))
    at = scan.running_sum(sized.withColumn("n", F.size("samples").cast("long")), "stream_id", [F.col("frame_id")], F.col("n"), "before", parts, itself=False).where("n > 0")
    total = at.groupBy("stream_id").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    # A frame's samples go to each block that they or a margin of it lie in.
    block = lambda x: F.floor(x / BLOCK)
    cut = F.explode(F.sequence(F.greatest(F.lit(0), block(F.col("before") - reach)), block(F.col("before") + F.col("n") - 1 + reach))).alias("block")
    pieces = at.select("stream_id", "before", "n", "samples", cut)
    start = F.greatest(F.col("before"), F.col("block") * BLOCK - reach)
    end = F.least(F.col("before") + F.col("n"), (F.col("block") + 1) * BLOCK + reach)
    part = F.slice("samples", (start - F.col("before") + 1).cast("int"), (end - start).cast("int"))
    pieces = pieces.where(end > start).select("stream_id", "block", start.alias("start"), part.alias("samples")).join(total, "stream_id").where(F.col("block") * BLOCK < F.col("total"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        stream, block, total = (int(pdf[c].iloc[0]) for c in ("stream_id", "block", "total"))
        x = np.nan_to_num(np.concatenate([np.array(s, float) for s in pdf["samples"]]))
        lo, hi = (count_out(min(total, b * BLOCK), rate_in, rate_out) for b in (block, block + 1))
        return pd.DataFrame([(stream, lo, outputs(x, int(pdf["start"].iloc[0]), lo, hi, rate_in, rate_out))], columns=["stream_id", "first", "samples"])

    return pieces.groupBy("stream_id", "block").applyInPandas(run, "stream_id long, first long, samples array<double>")


class Resampled(StatefulProcessor):
    """Rows (stream_id, frame_id, samples); a row without samples ends the stream. Frames of a micro-batch are taken in order."""

    def __init__(self, rate_in: int, rate_out: int = TARGET):
        self.rates = (rate_in, rate_out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "first long, done long, samples array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        up, down, reach, _ = phases(*self.rates)
        first, done, x = self.held.get() if self.held.exists() else (0, 0, [])
        x, out, over = np.array(x, float), [], False
        for r in pd.concat(list(rows)).sort_values("frame_id").itertuples():
            over = r.samples is None
            if not over:
                x = np.concatenate([x, np.nan_to_num(np.array(r.samples, float))])
            # Output whose whole reach is there; all that is left once the stream is over.
            upto = first + len(x) if over else max(0, first + len(x) - reach)
            hi = max(done, count_out(upto, *self.rates))
            if hi > done:
                out.append((int(key[0]), done, outputs(x, first, done, hi, *self.rates)))
            done = hi
            keep = max(first, done * down // up - reach)
            x, first = x[keep - first :], keep
            if over:
                first, done, x = 0, 0, np.zeros(0)
        if over:
            self.held.clear()
        else:
            self.held.update((first, done, x.tolist()))
        yield pd.DataFrame(out, columns=["stream_id", "first", "samples"])

    def close(self) -> None:
        pass


def resample_stream(frames: DataFrame, rate_in: int, rate_out: int = TARGET) -> DataFrame:
    """The same of a stream of frames; a frame of null samples ends its stream. State is the tail of 2 * reach samples or so."""
    return frames.groupBy("stream_id").transformWithStateInPandas(Resampled(rate_in, rate_out), "stream_id long, first long, samples array<double>", "Append", "None")

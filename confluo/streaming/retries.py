"""Work that is tried again: items wait in a stream's state until an attempt on all of them succeeds, or is given up.

An attempt is made when items come. If it fails, the items stay, in front of those that come later, and the next attempt takes
them all; after TRIES failures in a row that could have been mended, or at once where the error can't be, they become dead letters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from confluo.functions.text import HOPELESS

#: Fixed value: failures in a row after which items are kept once more.
TRIES = 3
OUT = "stream_id long, item_id long, outcome string, failures long, note string"
#: From the items' payloads, oldest first, to an error's message, or None where all went well.
Attempt = Callable[[list[str]], str | None]


class Retries(StatefulProcessor):
    def __init__(self, attempt: Attempt, tries: int = TRIES):
        self.attempt, self.tries = attempt, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "item_id long, payload string")
        self.failures = handle.getValueState("failures", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("item_id", kind="stable")
        items = [*self.items.get(), *((int(r.item_id), r.payload) for r in new.itertuples())]
        failures = self.failures.get()[0] if self.failures.exists() else 0
        error = self.attempt([payload for _, payload in items])
        if error is not None:
            failures += 1
        hopeless = error is not None and any(p in error.lower() for p in HOPELESS)
        if error is not None and not hopeless and failures <= self.tries:
            self.items.put(items)
            self.failures.update((failures,))
            out = [(int(key[0]), i, "waits", failures, error) for i, _ in items]
        else:
            self.items.clear()
            self.failures.clear()
            out = [(int(key[0]), i, "done" if error is None else "dead", failures, error) for i, _ in items]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def retried(items: DataFrame, attempt: Attempt, tries: int = TRIES) -> DataFrame:
    """(stream_id, item_id, outcome, failures, note) for each item and attempt; ``items`` (stream_id, item_id, payload). The last outcome
    of an item is 'done' or 'dead', or 'waits' while the stream has nothing new; 'dead' ones are the dead letters."""
    return items.groupBy("stream_id").transformWithStateInPandas(Retries(attempt, tries), OUT, "Append", "None")

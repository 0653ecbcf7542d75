"""Sync state of records over a stream of pushes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class PushProcessor(StatefulProcessor):
    """A record's state is the push that went through, or nothing: two short strings at most, however many pushes come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.won = handle.getValueState("won", "push string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        won = self.won.get()[0] if self.won.exists() else None
        before = won
        for r in sorted(rows, key=lambda r: r.seq):
            if won is None and r.ok:
                won = r.push
            yield Row(k=key[0], seq=r.seq, push=r.push, outcome="failed" if won is None else "pushed" if r.push == won else "conflict")
        if won != before:
            self.won.update((won,))

    def close(self) -> None:
        pass


def push_outcomes(pushes: DataFrame, key: str) -> DataFrame:
    """(k, seq, push, outcome) of a stream of pushes (key long, seq, push, ok): ``records.push_outcomes`` as they arrive, keyed by record. Late
    repeats of the push that went through are told from conflicts. Needs the RocksDB state store."""
    return pushes.groupBy(key).transformWithState(PushProcessor(), "k long, seq long, push string, outcome string", "Append", "None")

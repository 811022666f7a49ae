"""Streams: detection is row-local and needs no state; labels that stay the same over a conversation do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.api import active_spans
from maskwright.config import RedactionConfig
from maskwright.functions.text import normalised
from maskwright.operators.replace import spliced

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def redact_stream(stream: DataFrame, config: RedactionConfig | None = None, text: str = "text") -> DataFrame:
    """A stream with its texts redacted one by one; append mode, no shuffle, no state."""
    from maskwright.api import redact

    return redact(stream, config=config, text=text)


class _Labels(StatefulProcessor):
    """Numbers of one conversation's values. State, by key and entry, so that a batch reads and writes what it meets alone: the
    number of each (type, value) and the last number of each type."""

    def __init__(self, key: str, order: str, text: str, idle_ms: int | None, ttl_ms: int | None):
        self.key, self.order, self.text, self.idle_ms, self.ttl_ms = key, order, text, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getMapState("numbers", "type string, value string", "n int", self.ttl_ms)
        self.last = handle.getMapState("last", "type string", "n int", self.ttl_ms)

    def number(self, kind: str, value: str) -> int:
        if self.numbers.containsKey((kind, value)):
            n = self.numbers.getValue((kind, value))[0]
            if self.ttl_ms is not None:  # written again, it lives on
                self.numbers.updateValue((kind, value), (n,))
            return n
        n = self.last.getValue((kind,))[0] + 1 if self.last.containsKey((kind,)) else 1
        self.numbers.updateValue((kind, value), (n,))
        self.last.updateValue((kind,), (n,))
        return n

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        batch = pd.concat(list(rows)).sort_values(self.order)  # what one micro-batch has of the conversation
        for turn, t, spans in zip(batch[self.order], batch[self.text], batch["s"], strict=True):
            new = [{"start": int(s["start"]), "end": int(s["end"]), "new": f"[{s['type']}_{self.number(s['type'], s['value'])}]"} for s in (spans if spans is not None else [])]
            out.append((key[0], turn, t, new))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[self.key, self.order, self.text, "p"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.numbers.clear()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def labelled_stream(
    stream: DataFrame, config: RedactionConfig | None = None, key: str = "conv_id", order: str = "turn", text: str = "text", idle_ms: int | None = None, ttl_ms: int | None = None
) -> DataFrame:
    """key, order, text of a stream, with labels that number each conversation's values by arrival; texts that come late get
    later numbers. Needs the state store of RocksDB (`ROCKSDB`). A stream of ever new conversations needs a bound on its
    state: after idle_ms without a text a timer drops a conversation's whole state, and its later texts start anew; after
    ttl_ms without an occurrence a single value's number goes, and a later occurrence gets a new one."""
    config = config or RedactionConfig()
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}
    found = stream.select(key, order, text, active_spans(F.col(text), config).alias("s"))
    shaped = found.select(key, order, text, F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), normalised(s["text"]).alias("value"))).alias("s"))
    shape = f"{key} {kinds[key]}, {order} {kinds[order]}, {text} string, p array<struct<start:int,end:int,new:string>>"
    timed = "None" if idle_ms is None and ttl_ms is None else "ProcessingTime"
    done = shaped.groupBy(key).transformWithStateInPandas(_Labels(key, order, text, idle_ms, ttl_ms), shape, "Append", timed)
    return done.select(key, order, spliced(F.col(text), F.col("p")).alias(text))

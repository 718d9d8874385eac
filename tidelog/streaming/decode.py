"""Messages with absolute times from a stream of packages, in whatever order these arrive."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelog.runtime import ship
from tidelog.schema import MESSAGE

#: Keyed state of this kind lives in RocksDB.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = "acquisition_time decimal(20,0), serialized_data binary"


class OnsetDecoder(StatefulProcessor):
    """The onset of a source is a value; packages that come before it wait in a list, and leave with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.onset = handle.getValueState("onset", "onset_us decimal(20,0)")
        self.waiting = handle.getListState("waiting", _ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        onset = self.onset.get()[0] if self.onset.exists() else None
        for part in rows:
            first = part["acquisition_time"] == 0
            if onset is None and first.any():
                onset = Decimal(int.from_bytes(bytes(part.loc[first, "serialized_data"].iloc[0])[:8], "little"))
                self.onset.update((onset,))
                if self.waiting.exists():
                    held = [(time, bytes(data)) for time, data in self.waiting.get()]
                    self.waiting.clear()
                    yield self._messages(key[0], onset, held)
            others = list(zip(part.loc[~first, "acquisition_time"], map(bytes, part.loc[~first, "serialized_data"]), strict=True))
            if not others:
                continue
            if onset is None:
                self.waiting.appendList(others)
            else:
                yield self._messages(key[0], onset, others)

    @staticmethod
    def _messages(source: int, onset: Decimal, entries: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"source_id": source, "timestamp_us": [onset + time for time, _ in entries], "payload": [data for _, data in entries]})

    def close(self) -> None:
        pass


def decoded(packages: DataFrame) -> DataFrame:
    """A stream of packages -> its messages (source_id, timestamp_us, payload), each as soon as its source's onset is known.

    The first entry at time 0 that arrives is a source's onset; others at time 0 are no messages. Over all batches the rows
    are those of archive.messages() over all packages, whatever the order. What waits for an onset is state of the query.
    """
    spark = packages.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = packages.select("source_id", "acquisition_time", "serialized_data").groupBy("source_id")
    return rows.transformWithStateInPandas(OnsetDecoder(), MESSAGE, "Append", "None")

"""Stateful processors of keyed streams."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Send the classes with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class EarlierDays(StatefulProcessor):
    """Holds each closed day of a metric against the days before it.

    Input rows have ``day`` and ``value``; a key's days come in order over batches and in
    any order within one. The state of a key is the count, mean and sum of
    squared deviations of its days so far, whatever their number.
    """

    def __init__(self, z: float) -> None:
        self._z = z

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "n BIGINT, mean DOUBLE, squares DOUBLE")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, mean, squares = self._seen.get() if self._seen.exists() else (0, 0.0, 0.0)
        for row in sorted(rows, key=lambda r: r["day"]):
            value = row["value"]
            if n > 1 and squares > 0:
                score = (value - mean) / math.sqrt(squares / (n - 1))
                if abs(score) >= self._z:
                    yield Row(day=row["day"], metric=key[0], value=value, z_score=score,
                              direction="high" if score > 0 else "low")
            n += 1
            change = value - mean
            mean += change / n
            squares += change * (value - mean)
        self._seen.update((n, mean, squares))

    def close(self) -> None:
        pass

"""Images that are functions of their coordinates, as a Spark data source.

Format "function": x, y, z, v, where v = f(x, y, z) by the option function
("package.module:name"), which takes three numpy arrays and returns one. An
unbounded function is read over the box of options low and high ("0,0,0" and
"99,99,99", closed), chunk by chunk (option cell, "64,64,64"). Filters that
bound x, y or z cut the box first and then leave out chunks, so the function
is evaluated only where something is asked for; constants are functions too.
"""

from __future__ import annotations

import importlib
import operator
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from voxfabric.sources.pruning import Wanted


@dataclass
class Part(InputPartition):
    """Chunks by their number among those that have wanted coordinates: per axis the coordinates of each chunk that has any."""

    axes: list[list[list[int]]]
    start: int
    stop: int


def _numbers(text: str) -> list[int]:
    return [int(v) for v in text.split(",")]


class FunctionReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.function = options["function"]
        self.low, self.high, self.cell = (_numbers(options[k]) if k in options else d for k, d in (("low", None), ("high", None), ("cell", [64, 64, 64])))
        self.per_task = int(options.get("chunksPerTask", 16))
        self.wanted = Wanted(("x", "y", "z"))
        if self.low is None or self.high is None:
            raise ValueError("a function has no bounds of its own: options low and high are needed")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.wanted.take(filters)

    def _range(self, axis: str, low: int, high: int) -> tuple[int, int]:
        """The box cut by what bounds the axis."""
        for op, v in self.wanted.bounds.get(axis, ()):
            if op in (operator.ge, operator.gt, operator.eq):
                low = max(low, v + (op is operator.gt))
            if op in (operator.le, operator.lt, operator.eq):
                high = min(high, v - (op is operator.lt))
        return low, high

    def partitions(self) -> Sequence[InputPartition]:
        axes = []
        for axis, first, last, c in zip("xyz", self.low, self.high, self.cell):
            low, high = self._range(axis, first, last)
            chunks: dict[int, list[int]] = {}
            for v in self.wanted.among(axis, range(low, high + 1)):
                chunks.setdefault((v - first) // c, []).append(v)
            axes.append(list(chunks.values()))
        total = len(axes[0]) * len(axes[1]) * len(axes[2])
        return [Part(axes, i, min(i + self.per_task, total)) for i in range(0, total, self.per_task)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was nothing to plan
            return
        module, _, name = self.function.partition(":")
        f = getattr(importlib.import_module(module), name)
        for number in range(partition.start, partition.stop):
            own = []
            for chunks in partition.axes:
                number, k = divmod(number, len(chunks))
                own.append(np.array(chunks[k], np.int64))
            z, y, x = (g.reshape(-1) for g in np.meshgrid(own[2], own[1], own[0], indexing="ij"))
            v = np.broadcast_to(np.asarray(f(x, y, z), np.float64), x.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (x, y, z, v)], names=["x", "y", "z", "v"])


class FunctionSource(DataSource):
    """register(spark); then format "function"."""

    @classmethod
    def name(cls) -> str:
        return "function"

    def schema(self) -> str:
        return "x long, y long, z long, v double"

    def reader(self, schema: StructType) -> FunctionReader:
        return FunctionReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FunctionSource)

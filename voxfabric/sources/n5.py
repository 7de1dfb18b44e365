"""N5 chunk stores as a Spark data source, batch read and write.

A dataset lies at setup%d/timepoint%d/s%d below the store; attributes.json
files give pixel type, sizes and chunk sizes. Each chunk is a file named by its
place in the grid: a big-endian header (mode 0, number of axes, sizes) and
the values, big-endian, raw or gzip-compressed.

A read has one task per dataset and range of chunk numbers, and filters on
setup_id, timepoint_id, level and grid place skip datasets and chunks before
any file is opened. Chunks that aren't stored give no row: they are zeros, and
blocks.fill_missing() puts them in.

Options: path, a folder or a URI of a file system that pyarrow knows; element,
the values' type ("double"; "long" or "decimal(20,0)" keep 64-bit values
whole); layout, the three folders of a dataset if they have other names;
chunksPerTask.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import struct
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_SCHEMA = "timepoint_id int, setup_id int, level int, gx int, gy int, gz int, size array<int>, data array<%s>"
SCHEMA = _SCHEMA % "double"
ELEMENTS = {"double": pa.float64(), "long": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
LAYOUT = "setup%d/timepoint%d/s%d"
#: Chunks that are published at a time.
RENAMES = 32
TYPES = ("int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64")
_KEYS = ("setup_id", "timepoint_id", "level", "gx", "gy", "gz")


def encode_chunk(data: Sequence[float], size: Sequence[int], dtype: str, compression: str = "gzip") -> bytes:
    body = np.asarray(data).astype(np.dtype(dtype).newbyteorder(">")).tobytes()
    head = struct.pack(f">HH{len(size)}I", 0, len(size), *size)
    return head + (gzip.compress(body, mtime=0) if compression == "gzip" else body)


def decode_chunk(blob: bytes, dtype: str, compression: str) -> tuple[list[int], np.ndarray]:
    mode, n = struct.unpack_from(">HH", blob)
    if mode:
        raise ValueError("only chunks of the default mode can be read")
    size = list(struct.unpack_from(f">{n}I", blob, 4))
    body = blob[4 + 4 * n :]
    if compression == "gzip":
        body = gzip.decompress(body)
    elif compression != "raw":
        raise ValueError(f"compression {compression} is not known")
    return size, np.frombuffer(body, np.dtype(dtype).newbyteorder(">"))


@dataclass
class ChunkRange(InputPartition):
    """Chunks of a dataset by their number among those that the axes allow, x fastest."""

    setup: int
    timepoint: int
    level: int
    axes: list[list[int]]
    start: int
    stop: int


def file_system(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a folder or URI, and the path in it."""
    return files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), os.path.abspath(path))


def reached(path: str) -> tuple[files.FileSystem, str] | None:
    """The same for a store that is there; None where its file system isn't known or can't be reached, or there is no such folder."""
    try:
        store, root = file_system(path)
        return (store, root) if store.get_file_info(root).type == files.FileType.Directory else None
    except (OSError, ValueError, pa.ArrowException):
        return None


def attributes(store: files.FileSystem, path: str) -> dict:
    """The attributes of a folder, none if it has no such file."""
    try:
        with store.open_input_file(f"{path}/attributes.json") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {}


def properties(path: str, setup: int, timepoint: int = 0, level: int = 0) -> dict:
    """dtype and resolutions of a setup, dimensions of one of its datasets."""
    store, root = file_system(path)
    own = attributes(store, f"{root}/setup{setup}")
    return {"dtype": own.get("dataType"), "resolutions": own.get("downsamplingFactors"), "dimensions": attributes(store, f"{root}/" + LAYOUT % (setup, timepoint, level)).get("dimensions")}


class N5Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.per_task = options["path"], int(options.get("chunksPerTask", 256))
        self.element, self.folders = options.get("element", "double"), options.get("layout", LAYOUT).split("/")
        if self.element not in ELEMENTS:
            raise ValueError(f"no element type {self.element}")
        self.wanted: dict[str, set[int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in _KEYS:
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def _wants(self, name: str, value: int) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def _listed(self, store: files.FileSystem, path: str, depth: int, name: str) -> list[int]:
        pattern = re.escape(self.folders[depth]).replace("%d", r"(\d+)")
        inside = store.get_file_info(files.FileSelector(path, allow_not_found=True))
        found = [int(m[1]) for f in inside if (m := re.fullmatch(pattern, f.base_name))]
        return sorted(n for n in found if self._wants(name, n))

    def _base(self, root: str, *numbers: int) -> str:
        return "/".join([root, *[f % n for f, n in zip(self.folders, numbers)]])

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        store, root = file_system(self.path)
        for s in self._listed(store, root, 0, "setup_id"):
            for t in self._listed(store, self._base(root, s), 1, "timepoint_id"):
                for level in self._listed(store, self._base(root, s, t), 2, "level"):
                    a = attributes(store, self._base(root, s, t, level))
                    counts = [-(-d // b) for d, b in zip(a["dimensions"], a["blockSize"])]
                    axes = [[g for g in range(n) if self._wants(name, g)] for n, name in zip(counts, ("gx", "gy", "gz"))]
                    total = prod(map(len, axes))
                    out += [ChunkRange(s, t, level, axes, i, min(i + self.per_task, total)) for i in range(0, total, self.per_task)]
        return out

    def read(self, partition: ChunkRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was nothing to plan
            return
        p = partition
        store, root = file_system(self.path)
        base = self._base(root, p.setup, p.timepoint, p.level)
        a = attributes(store, base)
        kind = ELEMENTS[self.element]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for number in range(p.start, p.stop):
            chunk = []
            for axis in p.axes:
                number, g = divmod(number, len(axis))
                chunk.append(axis[g])
            try:
                with store.open_input_file("/".join([base, *map(str, chunk)])) as f:
                    blob = f.read()
            except FileNotFoundError:
                continue
            size, data = decode_chunk(blob, a["dataType"], a.get("compression", {}).get("type", "raw"))
            values = pa.array([Decimal(v) for v in data.tolist()], kind) if pa.types.is_decimal(kind) else pa.array(data.astype(kind.to_pandas_dtype()), kind)
            whole = lambda v: pa.array([v], pa.int32())
            columns = [*map(whole, (p.timepoint, p.setup, p.level, *chunk)), pa.array([size], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: its folder, the chunks' places below it, the datasets."""

    folder: str
    files: list[str]
    datasets: set


class N5Writer(DataSourceArrowWriter):
    """Each task stages its chunks in a folder of its own; they become part of the store once all tasks have ended, and go if one fails.

    Publishing is a rename per chunk, RENAMES at a time; what is common to a
    dataset is written after that.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dtype, self.compression = options["path"], options.get("dataType", "uint16"), options.get("compression", "gzip")
        self.block = json.loads(options.get("blockSize", "[64,64,64]"))
        self.dimensions = json.loads(options["dimensions"])  # of level 0
        self.factors = json.loads(options.get("downsamplingFactors", "[[1,1,1]]"))
        self.folders = options.get("layout", LAYOUT).split("/")
        if self.dtype not in TYPES:
            raise ValueError(f"pixel type {self.dtype} can't be written")
        if len(self.folders) != 3 or any("%d" not in f for f in self.folders):
            raise ValueError("a layout names three folders, each with a number: " + LAYOUT)
        self.job = f".staged-{uuid.uuid4().hex}"

    def _dataset(self, *numbers: int) -> str:
        return "/".join(f % n for f, n in zip(self.folders, numbers))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        done = Written(folder, [], set())
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in (*_KEYS, "size")}
            data = batch.column("data")
            ends, values = data.offsets.to_numpy(), data.values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                ids = tuple(columns[k][i] for k in ("setup_id", "timepoint_id", "level"))
                done.datasets.add(ids)
                place = "/".join(map(str, [self._dataset(*ids), *(columns[g][i] for g in ("gx", "gy", "gz"))]))
                store.create_dir(f"{folder}/{place}".rpartition("/")[0])
                with store.open_output_stream(f"{folder}/{place}") as f:
                    f.write(encode_chunk(values[ends[i] : ends[i + 1]], columns["size"][i], self.dtype, self.compression))
                done.files.append(place)
        return done

    def _discard(self) -> bool:
        """Whether there was something."""
        store, root = file_system(self.path)
        found = store.get_file_info(f"{root}/{self.job}").type != files.FileType.NotFound
        if found:
            store.delete_dir(f"{root}/{self.job}")
        return found

    def commit(self, messages) -> None:
        store, root = file_system(self.path)
        staged = [(m.folder, f) for m in messages if m for f in m.files]
        for d in {f.rpartition("/")[0] for _, f in staged}:
            store.create_dir(f"{root}/{d}")
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda x: store.move(f"{x[0]}/{x[1]}", f"{root}/{x[1]}"), staged))
        self._discard()

        def put(path: str, value: dict) -> None:
            store.create_dir(path)
            with store.open_output_stream(f"{path}/attributes.json") as f:
                f.write(json.dumps(value).encode())

        for s, t, level in set().union(*[m.datasets for m in messages if m]):
            size = [max(1, d // f) for d, f in zip(self.dimensions, self.factors[level])]
            at = self._dataset(s, t, level)
            put(f"{root}/{at}", {"dimensions": size, "blockSize": self.block, "dataType": self.dtype, "compression": {"type": self.compression}, "downsamplingFactors": self.factors[level]})
            put(f"{root}/{at.rsplit('/', 1)[0]}", {"multiScale": True})
            put(f"{root}/{at.split('/')[0]}", {"downsamplingFactors": self.factors, "dataType": self.dtype})
        put(root, {"n5": "2.5.1"})

    def abort(self, messages) -> None:
        for _ in range(6):  # tasks that are being stopped may write a little longer
            try:
                if not self._discard():
                    time.sleep(0.5)
            except OSError:
                time.sleep(0.1)


class N5DataSource(DataSource):
    """spark.dataSource.register(N5DataSource); then format "n5" with option path."""

    @classmethod
    def name(cls) -> str:
        return "n5"

    def schema(self) -> str:
        return _SCHEMA % self.options.get("element", "double")

    def reader(self, schema: StructType) -> N5Reader:
        return N5Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> N5Writer:
        return N5Writer(self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(N5DataSource)

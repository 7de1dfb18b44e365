"""HDF5 chunk stores as a Spark data source, in one file or in partition files, batch read and write.

A dataset lies at t%05d/s%02d/<level>/cells, slowest axis first; s%02d holds
resolutions and subdivisions of a setup and its pixel type as attribute
dataType. Without that attribute, 16-bit values are unsigned.

A read has one task per dataset and range of chunk numbers. The driver reads
headers alone; a task walks the part of the chunk index that its range lies
under and fetches those chunks by their place in the file. Filters on
setup_id, timepoint_id, level and grid place skip datasets and chunks. Where
views are dealt to partition files, filters go through each file's maps of
ids first, and files that hold none of what is asked for are not opened. Files
that are missing, and chunks that aren't stored, give no rows: they are zeros,
and blocks.fill_missing() puts them in.

Options of reads: path, a file or URI of a file system that pyarrow knows, or
partitions, JSON of [{"path", "timepoints": {id: id in the file}, "setups":
the same}]; element, the values' type ("double"; "long" or "decimal(20,0)" keep
64-bit values whole); chunksPerTask.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from voxfabric.sources import hdf5_format as h5
from voxfabric.sources.n5 import ELEMENTS, TYPES, file_system
from voxfabric.sources.pruning import Wanted

_SCHEMA = "timepoint_id int, setup_id int, level int, gx int, gy int, gz int, size array<int>, data array<%s>"
_KEYS = ("setup_id", "timepoint_id", "level", "gx", "gy", "gz")


def opened(path: str) -> tuple[h5.File, object]:
    """The file's structure, and the stream to close."""
    store, at = file_system(path)
    stream = store.open_input_file(at)
    return h5.File(lambda offset, length: stream.read_at(length, offset)), stream


def mipmaps(path: str, setup: int) -> dict:
    """dtype, resolutions and subdivisions of a setup, axes x, y, z; None for what the file lacks."""
    file, stream = opened(path)
    with stream:
        at = file.find(f"s{setup:02d}")
        found = {k: file.matrix(f"s{setup:02d}/{k}") for k in ("resolutions", "subdivisions")}
        return {"dtype": None if at is None else file.attribute(at, "dataType"), **{k: None if v is None else v.tolist() for k, v in found.items()}}


def cells_path(timepoint: int, setup: int, level: int) -> str:
    return f"t{timepoint:05d}/s{setup:02d}/{level}/cells"


@dataclass
class Cells(InputPartition):
    """Chunks of a dataset by their number among those that the axes allow, x fastest. ids are the sequence's, dataset lies at the file's."""

    path: str
    ids: tuple[int, int, int]
    dataset: h5.Dataset
    block: tuple[int, int, int]
    dtype: str
    axes: list[list[int]]
    start: int
    stop: int


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.per_task, self.element = int(options.get("chunksPerTask", 256)), options.get("element", "double")
        if self.element not in ELEMENTS:
            raise ValueError(f"no element type {self.element}")
        self.files = json.loads(options["partitions"]) if options.get("partitions") else [{"path": options["path"]}]
        self.wanted = Wanted(_KEYS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.wanted.take(filters)

    def _own(self, name: str, ids: Mapping[str, int] | None, found: Iterable[int] | None = None) -> list[tuple[int, int]]:
        """Pairs of a wanted id and its id in the file, by a file's map or, without one, by what the file holds."""
        pairs = [(int(a), b) for a, b in ids.items()] if ids is not None else [(a, a) for a in found or ()]
        return sorted(p for p in pairs if self.wanted(name, p[0]))

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for f in self.files:
            times, setups = f.get("timepoints"), f.get("setups")
            if times is not None and not self._own("timepoint_id", times) or setups is not None and not self._own("setup_id", setups):
                continue
            try:
                file, stream = opened(f["path"])
            except FileNotFoundError:
                if times is None:
                    raise
                continue
            with stream:
                out += self._datasets(f["path"], file, times, setups)
        return out

    def _datasets(self, path: str, file: h5.File, times: Mapping | None, setups: Mapping | None) -> Iterator[InputPartition]:
        numbers = lambda found, pattern: {int(m[1]): a for name, a in found.items() if (m := re.fullmatch(pattern, name))}
        top = file.children(file.root)
        in_file, kinds = numbers(top, r"t(\d{5,})"), numbers(top, r"s(\d{2,})")
        for t, own_t in self._own("timepoint_id", times, in_file):
            views = numbers(file.children(in_file[own_t]), r"s(\d{2,})") if own_t in in_file else {}
            for s, own_s in self._own("setup_id", setups, views):
                levels = numbers(file.children(views[own_s]), r"(\d+)") if own_s in views else {}
                stated = file.attribute(kinds[own_s], "dataType") if own_s in kinds else None
                for level in sorted(n for n in levels if self.wanted("level", n)):
                    at = file.children(levels[level]).get("cells")
                    d = None if at is None else file.dataset(at)
                    if d is None:
                        continue
                    block = d.chunk or tuple(file.matrix(f"s{own_s:02d}/subdivisions")[level].tolist()[::-1])
                    counts = [-(-n // b) for n, b in zip(d.dims, block)][::-1]
                    axes = [self.wanted.among(name, range(n)) for n, name in zip(counts, ("gx", "gy", "gz"))]
                    # Without the attribute, 16 bits are unsigned, whatever the file says.
                    dtype = stated or ("uint16" if np.dtype(d.dtype).itemsize == 2 else np.dtype(d.dtype).name)
                    total = prod(map(len, axes))
                    for i in range(0, total, self.per_task):
                        yield Cells(path, (t, s, level), d, block, dtype, axes, i, min(i + self.per_task, total))

    def read(self, partition: Cells) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was nothing to plan
            return
        p = partition
        file, stream = opened(p.path)
        kind = ELEMENTS[self.element]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]

        def place(number: int) -> tuple[int, int, int]:
            """gz, gy, gx of a chunk number."""
            out = []
            for axis in p.axes:
                number, g = divmod(number, len(axis))
                out.append(axis[g])
            return tuple(out[::-1])

        def chunks() -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
            asked = [place(n) for n in range(p.start, p.stop)]  # chunksPerTask at most
            shape = lambda g: [min(b, n - i * b) for i, b, n in zip(g, p.block, p.dataset.dims)]
            if p.dataset.chunk is None:
                for g in asked:
                    yield g, file.box(p.dataset, [i * b for i, b in zip(g, p.block)], shape(g)).reshape(shape(g))
                return
            offset, some = lambda g: [i * b for i, b in zip(g, p.block)], set(asked)
            for at, address, size, mask in file.chunks(p.dataset, offset(asked[0]), offset(asked[-1])):
                g = tuple(o // b for o, b in zip(at, p.block))
                if g in some:
                    whole = file.values(p.dataset, address, size, mask).reshape(p.block)
                    yield g, whole[tuple(slice(0, n) for n in shape(g))]

        with stream:
            for (gz, gy, gx), data in chunks():
                size = list(data.shape[::-1])
                found = data.reshape(-1).astype(p.dtype, copy=False) if data.dtype.kind == "f" else data.reshape(-1).astype(data.dtype.newbyteorder("=")).view(p.dtype)
                values = pa.array([Decimal(v) for v in found.tolist()], kind) if pa.types.is_decimal(kind) else pa.array(found.astype(kind.to_pandas_dtype()), kind)
                numbers = [pa.array([v], pa.int32()) for v in (*p.ids, gx, gy, gz)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array([size], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=names)


@dataclass
class WrittenFiles(WriterCommitMessage):
    moves: list[tuple[str, str]] = field(default_factory=list)


class Hdf5Writer(DataSourceWriter):
    """Rows of encoded chunks, sorted by file and place (see write()); each file is written by one task under another name and published once all tasks have ended."""

    def __init__(self, options: Mapping[str, str]):
        self.path, self.setups = options["path"], {int(k): v for k, v in json.loads(options["setups"]).items()}
        self.deflate = int(options["deflate"]) if options.get("deflate") else None

    def write(self, rows) -> WrittenFiles:
        store, root = file_system(self.path)
        store.create_dir(root)
        done, open_ = WrittenFiles(), None
        try:
            for r in rows:
                if open_ is None or open_.name != r.file:
                    if open_:
                        done.moves.append(open_.close())
                    open_ = _OpenFile(self, store, root, r.file)
                open_.put(r)
            if open_:
                done.moves.append(open_.close())
                open_ = None
        finally:
            if open_:
                open_.drop()
        return done

    def commit(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            for staged, target in m.moves if m else ():
                store.move(staged, target)

    def abort(self, messages) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            for staged, _ in m.moves if m else ():
                store.delete_file(staged)


class _OpenFile:
    """One file being written: what it holds in memory is some 50 bytes a chunk."""

    def __init__(self, job: Hdf5Writer, store, root: str, name: str):
        self.job, self.store, self.name = job, store, name
        self.target, self.staged = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
        self.stream = store.open_output_stream(self.staged)
        self.out = h5.Writer(self.stream.write)
        self.index: dict[tuple[int, int, int], list] = {}
        self.dims: dict[tuple[int, int, int], list[int]] = {}

    def put(self, r) -> None:
        key = (r.timepoint, r.setup, r.level)
        block = self.job.setups[r.sequence_setup]["subdivisions"][r.level]
        offset = tuple(g * b for g, b in zip((r.gz, r.gy, r.gx), block[::-1]))
        self.index.setdefault(key, []).append((offset, self.out.append(bytes(r.payload)), len(r.payload)))
        self.dims[key] = list(r.dims)
        self.kinds = getattr(self, "kinds", {}) | {r.setup: r.sequence_setup}

    def close(self) -> tuple[str, str]:
        w, tree = self.out, {}
        for (t, s, level), index in self.index.items():
            setup = self.job.setups[self.kinds[s]]
            index.sort()
            cells = w.chunked(self.dims[t, s, level][::-1], setup["subdivisions"][level][::-1], np.dtype(setup["dtype"]).newbyteorder("<").str, self.job.deflate, index)
            tree.setdefault(t, {}).setdefault(s, {})[str(level)] = w.group({"cells": cells})
        top = {f"t{t:05d}": w.group({f"s{s:02d}": w.group(levels) for s, levels in views.items()}) for t, views in tree.items()}
        for s, sequence in self.kinds.items():
            setup = self.job.setups[sequence]
            parts = {"resolutions": w.matrix(np.array(setup["resolutions"], "<f8")), "subdivisions": w.matrix(np.array(setup["subdivisions"], "<i4"))}
            top[f"s{s:02d}"] = w.group(parts, {"dataType": setup["dtype"]})
        head = w.finish(w.group(top))
        self.stream.close()
        with self.store.open_input_stream(self.staged) as body, self.store.open_output_stream(self.staged + "2") as whole:
            body.read(len(head))
            whole.write(head)
            while piece := body.read(1 << 22):
                whole.write(piece)
        self.store.delete_file(self.staged)
        return self.staged + "2", self.target

    def drop(self) -> None:
        self.stream.close()
        self.store.delete_file(self.staged)


class Hdf5DataSource(DataSource):
    """register(spark); then format "hdf5"."""

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        return _SCHEMA % self.options.get("element", "double")

    def reader(self, schema: StructType) -> Hdf5Reader:
        return Hdf5Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Hdf5Writer:
        return Hdf5Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Hdf5DataSource)


def split(timepoints: Sequence[int], setups: Sequence[int], per_file: tuple[int, int] | None, base: str) -> list[dict]:
    """Partition files of so many timepoints and setups each, base-TT-SS.h5 with ids that count from 0 in each; without a number one file, base.h5, with ids as they are."""
    if per_file is None:
        return [{"path": f"{base}.h5", "timepoints": {t: t for t in timepoints}, "setups": {s: s for s in setups}}]
    cut = lambda ids, n: [sorted(ids)[i : i + n] for i in range(0, len(ids), n)]
    own = lambda ids: {x: i for i, x in enumerate(ids)}
    return [{"path": f"{base}-{i:02d}-{j:02d}.h5", "timepoints": own(ts), "setups": own(ss)} for i, ts in enumerate(cut(timepoints, per_file[0])) for j, ss in enumerate(cut(setups, per_file[1]))]


def write(blocks: DataFrame, folder: str, setups: Mapping[int, dict], dims: DataFrame, base: str = "export", per_file: tuple[int, int] | None = None, deflate: int | None = 6) -> list[dict]:
    """Chunks (timepoint_id, setup_id, level, gx, gy, gz, data) as HDF5 files below folder; returns their partitions, as reads take them.

    setups: by id, {"dtype", "resolutions", "subdivisions"} by level, axes x,
    y, z. dims: setup_id, level, dims (x, y, z of the image). data are whole
    chunks or, at the image's edge, cut ones; these are filled up with zeros.
    Chunks are compressed where they lie; then each file's go to one task, so
    files should be many: per_file says how many timepoints and setups each
    holds.
    """
    for setup in setups.values():
        if setup["dtype"] not in TYPES:
            raise ValueError(f"pixel type {setup['dtype']} can't be written")
    spark = blocks.sparkSession
    ids = blocks.select("timepoint_id", "setup_id").distinct().collect()
    files = split(sorted({r.timepoint_id for r in ids}), sorted({r.setup_id for r in ids}), per_file, base)
    where = spark.createDataFrame([(f["path"], t, ft, s, fs) for f in files for t, ft in f["timepoints"].items() for s, fs in f["setups"].items()], "file string, t int, timepoint int, s int, setup int")
    plan = dict(setups)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                setup = plan[r["sequence_setup"]]
                block = setup["subdivisions"][r["level"]][::-1]
                shape = [min(b, n - g * b) for b, n, g in zip(block, r["dims"][::-1], (r["gz"], r["gy"], r["gx"]))]
                whole, data = np.zeros(block, np.dtype(setup["dtype"]).newbyteorder("<")), np.asarray(r["data"])
                if len(data) == whole.size:
                    whole[:] = data.reshape(block)
                else:
                    whole[tuple(slice(0, n) for n in shape)] = data.reshape(shape)
                out.append(h5.encode(whole, deflate))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "payload"])

    # The tables of files and of sizes have a row per view and level.
    placed = blocks.join(F.broadcast(where), (F.col("timepoint_id") == F.col("t")) & (F.col("setup_id") == F.col("s"))).join(F.broadcast(dims), ["setup_id", "level"])
    columns = ["file", "timepoint", "setup", F.col("setup_id").alias("sequence_setup"), "level", "gx", "gy", "gz", F.col("dims").cast("array<long>").alias("dims")]
    payload = placed.select(*columns, "data").mapInArrow(encode, "file string, timepoint int, setup int, sequence_setup int, level int, gx int, gy int, gz int, dims array<long>, payload binary")
    sorted_ = payload.repartition(len(files), "file").sortWithinPartitions("file", "timepoint", "setup", "level", "gz", "gy", "gx")
    options = {"path": folder, "setups": json.dumps(plan)} | ({} if deflate is None else {"deflate": str(deflate)})
    sorted_.write.format("hdf5").options(**options).mode("append").save()
    return [f | {"path": f"{folder}/{f['path']}"} for f in files]

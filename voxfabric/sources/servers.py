"""Scans of image servers as Spark data sources: tiles, cutouts and cells, fetched inside tasks.

Formats: "tiles", a pyramid of image tiles whose levels average slabs of
slices; "cutouts", blocks of a volume service; "cells", chunks of a chunk
server. Rows are chunks like those of other stores: timepoint_id, setup_id,
level, gx, gy, gz, size, data (tiles: packed ARGB; cutouts: bytes; cells:
unsigned 16 bits).

A task is a run of chunks of one level; filters on ids, level and grid place
leave chunks out before anything is fetched. Bytes come from a fetcher, a
function of a URL: the option fetcher names it ("package.module:function"); by
default URLs are files and URIs of file systems that pyarrow knows. What a
server lacks (FileNotFoundError) or fails to send in all attempts is black, or
0, as in a viewer; with failures "error" the latter ends the scan.

Options of all: fetcher, attempts (3; of descriptions 20), pause (seconds
between attempts, 0.1), failures ("zero", "error"), chunksPerTask (64).
tiles: url, a format of level, scale, x, y, z, tile width and height, row and
column by number ("%9$d"); width, height, depth, zScale, tileWidth,
tileHeight; blockWidth, blockHeight, blockDepth, levels if they differ from
tiles and what the size gives. cutouts: url, token, mode. cells: url.
"""

from __future__ import annotations

import importlib
import io
import json
import math
import re
import struct
import time
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from voxfabric.plans.pyramids import tile_levels
from voxfabric.sources.n5 import file_system
from voxfabric.sources.pruning import Wanted

_SCHEMA = "timepoint_id int, setup_id int, level int, gx int, gy int, gz int, size array<int>, data array<int>"
_KEYS = ("timepoint_id", "setup_id", "level", "gx", "gy", "gz")
Fetcher = Callable[[str], bytes]


def from_files(url: str) -> bytes:
    """The fetcher of files and URIs of file systems."""
    store, path = file_system(url)
    with store.open_input_stream(path) as f:
        return f.read()


def fetcher_of(name: str | None) -> Fetcher:
    if not name:
        return from_files
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def attempted(fetch: Fetcher, url: str, attempts: int, pause: float) -> bytes:
    """The bytes of a URL; errors but a missing file are tried again."""
    for left in reversed(range(attempts)):
        try:
            return fetch(url)
        except FileNotFoundError:
            raise
        except OSError:
            if not left:
                raise
            time.sleep(pause)
    raise ValueError("attempts must be at least 1")


def formatted(pattern: str, *values: object) -> str:
    """A format whose places are numbered from 1 ("%3$d", "%2$.3f", "%8$04d")."""
    return re.sub(r"%(\d+)\$([\d.]*[dfsg])", lambda m: f"%{m[2]}" % values[int(m[1]) - 1], pattern).replace("%%", "%")


def decode_image(blob: bytes) -> np.ndarray:
    """Rows of red, green and blue of an image file: PNG of 8 bits by itself, other kinds if PIL is at hand."""
    if blob[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, depth, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", blob, 16)
        if depth == 8 and kind in (0, 2, 4, 6) and not interlaced:
            return _png(blob, width, height, {0: 1, 2: 3, 4: 2, 6: 4}[kind])
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("this kind of image can't be decoded without PIL") from None
    return np.asarray(Image.open(io.BytesIO(blob)).convert("RGB"))


def _png(blob: bytes, width: int, height: int, n: int) -> np.ndarray:
    at, packed = 8, []
    while at < len(blob):
        size, kind = struct.unpack_from(">I4s", blob, at)
        if kind == b"IDAT":
            packed.append(blob[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width, n), np.uint8)
    for y, line in enumerate(lines):
        kind, raw, above = int(line[0]), line[1:].reshape(width, n), out[y]
        row = out[y + 1]
        if kind == 0:
            row[:] = raw
        elif kind == 1:
            row[:] = np.cumsum(raw, axis=0, dtype=np.uint8)
        elif kind == 2:
            row[:] = raw + above
        else:  # each pixel needs the one before it
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                up = above[x].astype(np.int64)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                left, corner = (raw[x] + guess) & 255, up
                row[x] = left
    pixels = out[1:]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3]


@dataclass(frozen=True)
class Level:
    """A level's image: ids, size and chunk size, x, y, z; extra is what its kind of server needs."""

    ids: tuple[int, int, int]
    dims: tuple[int, int, int]
    block: tuple[int, int, int]
    extra: tuple = ()


@dataclass
class Run(InputPartition):
    """Chunks of a level by their number among those that the axes allow, x fastest."""

    level: Level
    axes: list[list[int]]
    start: int
    stop: int


class ServedReader(DataSourceReader):
    """What all kinds have in common; levels() and chunk() are their own."""

    def __init__(self, options: Mapping[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.fetcher, self.url = self.options.get("fetcher"), self.options["url"]
        self.attempts, self.pause = int(self.options.get("attempts", 3)), float(self.options.get("pause", 0.1))
        self.strict, self.per_task = self.options.get("failures", "zero") == "error", int(self.options.get("chunkspertask", 64))
        self.wanted = Wanted(_KEYS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.wanted.take(filters)

    def levels(self) -> Iterator[Level]:
        raise NotImplementedError

    def chunk(self, level: Level, low: Sequence[int], size: Sequence[int]) -> np.ndarray:
        raise NotImplementedError

    def description(self, url: str) -> dict:
        return json.loads(attempted(fetcher_of(self.fetcher), url, int(self.options.get("attempts", 20)), self.pause))

    def get(self, url: str) -> bytes | None:
        """None for what the server lacks or fails to send."""
        try:
            return attempted(fetcher_of(self.fetcher), url, self.attempts, self.pause)
        except FileNotFoundError:
            return None
        except OSError:
            if self.strict:
                raise
            return None

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for level in self.levels():
            if not all(self.wanted(name, v) for name, v in zip(_KEYS, level.ids)):
                continue
            axes = [self.wanted.among(g, range(-(-n // b))) for g, n, b in zip(("gx", "gy", "gz"), level.dims, level.block)]
            total = prod(map(len, axes))
            out += [Run(level, axes, i, min(i + self.per_task, total)) for i in range(0, total, self.per_task)]
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was nothing to plan
            return
        level = partition.level
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for number in range(partition.start, partition.stop):
            place = []
            for axis in partition.axes:
                number, g = divmod(number, len(axis))
                place.append(axis[g])
            low = [g * b for g, b in zip(place, level.block)]
            size = [min(b, n - a) for a, b, n in zip(low, level.block, level.dims)]
            data = pa.array(self.chunk(level, low, size).reshape(-1).astype(np.int32), pa.int32())
            numbers = [pa.array([v], pa.int32()) for v in (*level.ids, *place)]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([size], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), data)], names=names)


class TileReader(ServedReader):
    def levels(self) -> Iterator[Level]:
        number = lambda name, default=None: int(self.options.get(name, default))
        width, height, depth, z_scale = number("width"), number("height"), number("depth"), float(self.options.get("zscale", 1))
        self.tile = number("tilewidth"), number("tileheight")
        block = number("blockwidth", self.tile[0]), number("blockheight", self.tile[1]), number("blockdepth", 1)
        for level in range(number("levels", tile_levels(width, height, *self.tile))):
            slab = max(1, math.floor((1 << level) / z_scale + 0.5))
            yield Level((0, 0, level), (width >> level, height >> level, depth // slab), block, (slab, *self.tile))

    def chunk(self, level: Level, low: Sequence[int], size: Sequence[int]) -> np.ndarray:
        """Each slice is the mean, rounded down, of its slab's slices."""
        slab, (w, h, d) = level.extra[0], size
        out = np.zeros((d, h, w), np.int64)
        for z in range(d):
            total = np.zeros((h, w, 3), np.int64)
            for k in range(slab):
                total += self._slice(level, low, (low[2] + z) * slab + k, w, h)
            r, g, b = np.moveaxis(total // slab, 2, 0)
            out[z] = ((r << 16) | (g << 8) | b) - (1 << 24)  # opaque, as a signed number
        return out

    def _slice(self, level: Level, low: Sequence[int], z: int, w: int, h: int) -> np.ndarray:
        _, tile_w, tile_h = level.extra
        out = np.zeros((h, w, 3), np.int64)
        for column in range(low[0] // tile_w, -(-(low[0] + w) // tile_w)):
            for row in range(low[1] // tile_h, -(-(low[1] + h) // tile_h)):
                x, y = column * tile_w, row * tile_h
                blob = self.get(formatted(self.url, level.ids[2], 0.5 ** level.ids[2], x, y, z, tile_w, tile_h, row, column))
                if blob is None:
                    continue
                pixels = decode_image(blob)
                x0, y0 = max(x, low[0]), max(y, low[1])
                x1, y1 = min(x + pixels.shape[1], low[0] + w), min(y + pixels.shape[0], low[1] + h)
                if x0 < x1 and y0 < y1:
                    out[y0 - low[1] : y1 - low[1], x0 - low[0] : x1 - low[0]] = pixels[y0 - y : y1 - y, x0 - x : x1 - x]
        return out


class CutoutReader(ServedReader):
    def levels(self) -> Iterator[Level]:
        base, token, mode = self.url.rstrip("/"), self.options["token"], self.options.get("mode", "")
        info = self.description(f"{base}/{token}/info/")["dataset"]
        prefix = "neariso_" if mode == "neariso" else ""
        offsets = [info[f"{prefix}offset"][str(r)][2] for r in info["resolutions"]]
        for i, r in enumerate(info["resolutions"]):
            x, y, z = info[f"{prefix}imagesize"][str(r)]
            yield Level((0, 0, i), (x, y, int(z - offsets[i])), tuple(info["cube_dimension"][str(r)]), (math.floor(offsets[0] + 0.5),))

    def chunk(self, level: Level, low: Sequence[int], size: Sequence[int]) -> np.ndarray:
        mode, out = self.options.get("mode", ""), np.zeros(prod(size), np.uint8)
        spans = [f"{a},{a + n}" for a, n in zip((low[0], low[1], low[2] + level.extra[0]), size)]
        blob = self.get("/".join([self.url.rstrip("/"), self.options["token"], "zip", str(level.ids[2]), *spans]) + (f"/{mode}/" if mode else "/"))
        if blob is not None:
            try:
                found = np.frombuffer(zlib.decompressobj().decompress(blob, len(out)), np.uint8)
                out[: len(found)] = found
            except zlib.error:
                if self.strict:
                    raise
        return out


def _by_view(found: dict | list) -> Iterator[tuple[tuple[int, int, int], dict]]:
    """Sizes by timepoint, setup and level: pairs of an id and a size, or one object whose names hold the three numbers."""
    for key, value in found.items() if isinstance(found, dict) else found:
        ids = (key["timepointId"], key["setupId"], key["level"]) if isinstance(key, dict) else map(int, re.findall(r"\d+", key)[:3])
        yield tuple(ids), value


class CellReader(ServedReader):
    def levels(self) -> Iterator[Level]:
        info = self.description(f"{self.url}?p=init")
        for (t, s, level), found in sorted(_by_view(info["dimsAndExistence"]), key=lambda x: x[0]):
            if found["exists"]:
                block = info["perSetupMipmapInfo"][str(s)]["subdivisions"][level]
                yield Level((t, s, level), tuple(found["dimensions"]), tuple(block))

    def chunk(self, level: Level, low: Sequence[int], size: Sequence[int]) -> np.ndarray:
        counts, place = [-(-n // b) for n, b in zip(level.dims, level.block)], [a // b for a, b in zip(low, level.block)]
        index = place[0] + counts[0] * (place[1] + counts[1] * place[2])
        out = np.zeros(prod(size), np.uint16)
        blob = self.get("/".join(map(str, [f"{self.url}?p=cell", index, *level.ids, *size, *low])))
        if blob is not None:
            found = np.frombuffer(blob[: 2 * len(out)], ">u2")
            out[: len(found)] = found
        return out


class _Served(DataSource):
    reader_class = ServedReader

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> ServedReader:
        return self.reader_class(self.options)


class TileSource(_Served):
    reader_class = TileReader

    @classmethod
    def name(cls) -> str:
        return "tiles"


class CutoutSource(_Served):
    reader_class = CutoutReader

    @classmethod
    def name(cls) -> str:
        return "cutouts"


class CellSource(_Served):
    reader_class = CellReader

    @classmethod
    def name(cls) -> str:
        return "cells"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TileSource, CutoutSource, CellSource):
        spark.dataSource.register(source)

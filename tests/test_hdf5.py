import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfabric.sources import hdf5
from voxfabric.sources import hdf5_format as h5

SETUPS = {
    0: {"dtype": "uint16", "resolutions": [[1, 1, 1], [2, 2, 1]], "subdivisions": [[4, 3, 2], [4, 4, 4]]},
    3: {"dtype": "float32", "resolutions": [[1, 1, 1]], "subdivisions": [[5, 4, 3]]},
}
DIMS = {(0, 0): [10, 7, 5], (0, 1): [5, 3, 5], (3, 0): [9, 4, 7]}


def volumes():
    r = np.random.default_rng(6)
    out = {}
    for (s, level), (x, y, z) in DIMS.items():
        for t in (0, 1, 4):
            v = r.integers(0, 65536, (z, y, x)) if s == 0 else r.standard_normal((z, y, x)).astype("f4")
            out[t, s, level] = v
    return out


def chunk_rows(vols, skip=lambda *k: False):
    rows = []
    for (t, s, level), v in vols.items():
        bx, by, bz = SETUPS[s]["subdivisions"][level]
        for gz in range(-(-v.shape[0] // bz)):
            for gy in range(-(-v.shape[1] // by)):
                for gx in range(-(-v.shape[2] // bx)):
                    if not skip(gx, gy, gz):
                        part = v[gz * bz : gz * bz + bz, gy * by : gy * by + by, gx * bx : gx * bx + bx]
                        rows.append((t, s, level, gx, gy, gz, list(part.shape[::-1]), [float(c) for c in part.reshape(-1)]))
    return rows


@pytest.fixture(scope="module", params=[None, (2, 1)])
def store(spark, tmp_path_factory, request):
    hdf5.register(spark)
    folder = str(tmp_path_factory.mktemp("h5"))
    rows = chunk_rows(volumes(), lambda x, y, z: (x + y + z) % 4 == 3)
    df = spark.createDataFrame(rows, hdf5._SCHEMA % "double")
    dims = spark.createDataFrame([(s, level, d) for (s, level), d in DIMS.items()], "setup_id int, level int, dims array<int>")
    return folder, rows, hdf5.write(df, folder, SETUPS, dims, per_file=request.param)


def load(spark, parts, **options):
    import json

    return spark.read.format("hdf5").options(partitions=json.dumps(parts), **options).load()


def test_round_trip_with_cut_and_missing_chunks(spark, store):
    folder, rows, parts = store
    for per_task in (1, 5, 256):
        got = load(spark, parts, chunksPerTask=per_task).collect()
        assert sorted(map(tuple, got)) == sorted(rows)
    found = hdf5.mipmaps(parts[-1]["path"], list(parts[-1]["setups"].values())[-1])
    assert found == {"dtype": "float32", "resolutions": [[1.0, 1.0, 1.0]], "subdivisions": [[5, 4, 3]]}
    if len(parts) == 1:
        single = spark.read.format("hdf5").option("path", parts[0]["path"]).load()
        assert sorted(map(tuple, single.collect())) == sorted(rows)


def test_filters_prune_files_datasets_and_chunks(spark, store, monkeypatch):
    folder, rows, parts = store
    some = load(spark, parts).where("setup_id = 0 and timepoint_id in (1, 4) and gx > 0 and gz < 2 and data[0] >= 0")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[1] == 0 and r[0] in (1, 4) and r[3] > 0 and r[5] < 2)
    reader = hdf5.Hdf5Reader({"partitions": __import__("json").dumps(parts)})
    kept = list(reader.pushFilters([hdf5_filter("EqualTo", "setup_id", 3), hdf5_filter("LessThan", "timepoint_id", 2), hdf5_filter("EqualTo", "size", 3)]))
    assert len(kept) == 1
    opened, real = [], hdf5.opened
    monkeypatch.setattr(hdf5, "opened", lambda path: opened.append(path) or real(path))
    tasks = reader.partitions()
    assert {p.ids for p in tasks} == {(0, 3, 0), (1, 3, 0)}
    if len(parts) == 4:  # two timepoints and one setup to a file: one file has both
        assert opened == [parts[1]["path"]]


def hdf5_filter(kind, name, value):
    from pyspark.sql import datasource

    return getattr(datasource, kind)((name,), value)


def test_tasks_fetch_their_part_of_the_index(tmp_path):
    """A tree of three levels: what is fetched for one chunk is the way down to it, not the index."""
    data, n = bytearray(), 6000
    w = h5.Writer(data.extend)
    index = []
    for i in range(n):
        body = h5.encode(np.arange(i, i + 4, dtype="<i4"), None)
        index.append(((i * 4,), w.append(body), len(body)))
    root = w.group({"d": w.chunked([n * 4], [4], "<i4", None, index)})
    data[:96] = w.finish(root)
    fetched = []

    def fetch(at, length):
        fetched.append(length)
        return bytes(data[at : at + length])

    f = h5.File(fetch)
    d = f.dataset(f.find("d"))
    assert (d.dims, d.chunk, d.dtype) == ((4 * n,), (4,), "<i4")
    fetched.clear()
    (offset, at, size, mask), = f.chunks(d, (4 * 4321,), (4 * 4321,))
    assert f.values(d, at, size, mask).tolist() == [4321, 4322, 4323, 4324] and offset == (4 * 4321,)
    assert sum(fetched) < 10_000
    assert [o[0] // 4 for o, *_ in f.chunks(d, (4 * 100,), (4 * 400,))] == list(range(100, 401))
    assert sum(1 for _ in f.chunks(d, (0,), (4 * n,))) == n


def test_large_groups_and_names():
    data = bytearray()
    w = h5.Writer(data.extend)
    members = {f"t{i:05d}": w.matrix(np.array([[i]], "<f8")) for i in range(700)}
    data[:96] = w.finish(w.group(members | {"ü": w.group({}, {"dataType": "int8"})}))
    f = h5.File(lambda at, n: bytes(data[at : at + n]))
    assert len(f.children(f.root)) == 701 and f.matrix("t00699").tolist() == [[699.0]]
    assert f.attribute(f.find("ü"), "dataType") == "int8" and f.find("none/at/all") is None and f.children(f.find("ü")) == {}


def later_file() -> bytes:
    """Bytes in the later layout, put together by hand: superblock 2, object headers 2 with links and a continuation, a text of variable length, shuffled and deflated signed 16-bit chunks."""
    data = bytearray(48)

    def put(b):
        at = len(data)
        data.extend(b + bytes(-len(b) % 8))
        return at

    def header(messages, more=()):
        pack = lambda ms: b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in ms)
        body = pack(messages)
        if more:
            block = b"OCHK" + pack(more) + bytes(4)
            body += pack([(0x10, struct.pack("<QQ", put(block), len(block)))])
        return put(b"OHDR" + bytes([2, 1]) + struct.pack("<H", len(body)) + body + bytes(4))

    link = lambda name, at: (6, bytes([1, 0, len(name)]) + name.encode() + struct.pack("<Q", at))
    info = (2, struct.pack("<BBQQ", 0, 0, h5.UNDEFINED, h5.UNDEFINED))
    values = np.arange(-3, 61, dtype="<i2").reshape(1, 4, 16)
    body = zlib.compress(np.frombuffer(values.tobytes(), np.uint8).reshape(-1, 2).T.tobytes())
    chunk = put(body)
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, 1, h5.UNDEFINED, h5.UNDEFINED) + struct.pack("<II4Q", len(body), 0, 0, 0, 0, 0) + struct.pack("<Q", chunk) + struct.pack("<II4Q", 0, 0, 1, 0, 0, 0))
    space = (1, struct.pack("<BBBB3Q", 2, 3, 0, 1, 1, 4, 15))
    kind = (3, struct.pack("<BBBBIHH", 0x10, 8, 0, 0, 2, 0, 16))
    filters = (0xB, bytes([2, 2]) + struct.pack("<HHHI", 2, 0, 1, 2) + struct.pack("<HHHI", 1, 1, 1, 6))
    cells = header([space, kind], [filters, (8, struct.pack("<BBBQ4I", 3, 2, 4, tree, 1, 4, 16, 2))])
    text = b"int16"
    heap = put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + 24) + struct.pack("<HHIQ", 1, 1, 0, len(text)) + text.ljust(8, b"\0"))
    attribute = (0xC, struct.pack("<BBHHHB", 3, 0, 9, 8, 4, 0) + b"dataType\0" + struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + bytes([2, 0, 0, 0]) + struct.pack("<IQI", len(text), heap, 1))
    root = header([info, link("t00000", header([link("s00", header([link("0", header([link("cells", cells)]))]))])), link("s00", header([info, attribute]))])
    data[:48] = h5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<4QI", 0, h5.UNDEFINED, len(data), root, 0)
    return bytes(data)


def test_later_layout_and_pixel_types(spark, tmp_path):
    hdf5.register(spark)
    (tmp_path / "later.h5").write_bytes(later_file())
    got = spark.read.format("hdf5").option("path", str(tmp_path / "later.h5")).option("element", "long").load().collect()
    rows = np.arange(-3, 61).reshape(1, 4, 16)[:, :, :15].reshape(-1).tolist()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, 0, 0, [15, 4, 1], rows)]


def test_16_bits_without_type_are_unsigned_and_contiguous_cells(spark, tmp_path):
    """Cells in one piece are cut by the subdivisions."""
    hdf5.register(spark)
    data = bytearray()
    w = h5.Writer(data.extend)
    v = (np.arange(3 * 4 * 5, dtype="<i2") - 10).reshape(3, 4, 5)
    sub = w.group({"subdivisions": w.matrix(np.array([[2, 3, 2]], "<i4")), "resolutions": w.matrix(np.array([[1, 1, 1]], "<f8"))})
    data[:96] = w.finish(w.group({"t00007": w.group({"s00": w.group({"0": w.group({"cells": w.matrix(v)})})}), "s00": sub}))
    (tmp_path / "a.h5").write_bytes(data)
    got = spark.read.format("hdf5").option("path", str(tmp_path / "a.h5")).load().where("gy = 1").collect()
    want = {(x, 1, z): v.view("<u2")[2 * z : 2 * z + 2, 3:4, 2 * x : 2 * x + 2].reshape(-1).astype(float).tolist() for x in range(3) for z in range(2)}
    assert {(r.gx, r.gy, r.gz): r.data for r in got} == want and {r.timepoint_id for r in got} == {7}


def test_missing_files_and_failing_tasks(spark, tmp_path):
    hdf5.register(spark)
    missing = [{"path": str(tmp_path / "none.h5"), "timepoints": {"0": 0}, "setups": {"0": 0}}]
    assert load(spark, missing).collect() == []
    bad = spark.createDataFrame(chunk_rows({k: v for k, v in volumes().items() if k[1] == 3}), hdf5._SCHEMA % "double")
    bad = bad.withColumn("data", F.when(F.col("gx") == 1, F.raise_error(F.lit("broken")).cast("array<double>")).otherwise(F.col("data")))
    dims = spark.createDataFrame([(3, 0, DIMS[3, 0])], "setup_id int, level int, dims array<int>")
    with pytest.raises(Exception, match="broken"):
        hdf5.write(bad, str(tmp_path / "out"), SETUPS, dims, per_file=(1, 1))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfabric.sources import blocks, datasets, formats, n5

LEGACY = """<SequenceDescription><ImageLoader format="chunks.hdf5"/><ViewSetup><id>0</id><angle>1</angle><illumination>0</illumination><channel>2</channel>
<width>30</width><height>20</height><depth>10</depth><pixelWidth>1.0</pixelWidth><pixelHeight>1.0</pixelHeight><pixelDepth>4.0</pixelDepth></ViewSetup>
<Timepoints type="{}"><first>3</first><last>5</last></Timepoints>
<ViewRegistrations><ReferenceTimepoint>0</ReferenceTimepoint><ViewRegistration><timepoint>0</timepoint><setup>0</setup>
<affine>1.0 0.0 0.0 5.0
  0.0 1.0 0.0 0.0 0.0 0.0 2.0 0.0</affine></ViewRegistration></ViewRegistrations></SequenceDescription>"""


def rows(df):
    return sorted(str(r.asDict(True)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    model = [1.0, 0.0, 0.5, 3.0, 0.0, 2.0, 0.0, -1.25, 0.0, 0.0, 1.0, 0.0]
    return {
        "setups": spark.createDataFrame([(0, [40, 30, 5], ("um", [1.0, 1.0, 2.5])), (2, [41, 31, 6], ("<px>", [0.5, 0.5, 1.0]))], "setup_id int, size array<bigint>, voxel struct<unit:string,size:array<double>>"),
        "timepoints": spark.createDataFrame([(0, 3), (1, 4), (2, 9)], "t_index int, timepoint_id int"),
        "missing": spark.createDataFrame([(4, 2)], "timepoint_id int, setup_id int"),
        "registrations": spark.createDataFrame([(t, s, model) for t in (3, 4, 9) for s in (0, 2)], "timepoint_id int, setup_id int, model array<double>"),
    }


def test_xml_round_trip(spark, tables, tmp_path):
    datasets.write_dataset_xml(tables, "chunks.n5", "images & more.n5", f"{tmp_path}/xml")
    got = formats.read_dataset_xml(spark, f"{tmp_path}/xml")
    for name, want in tables.items():
        assert rows(got[name].select(want.columns)) == rows(want), name


def test_xml_partitions(spark, tables):
    same, other = {3: 3, 4: 4}, {3: 0, 4: 1}
    parts = spark.createDataFrame([("a.h5", same, {0: 0}), ("b.h5", other, {2: 0})], "path string, timepoint_map map<int,int>, setup_map map<int,int>")
    xml = datasets.dataset_xml(tables, "chunks.hdf5", "all.h5", parts).first().xml
    assert "<partition><path>a.h5</path></partition>" in xml and "<timepointsMapped>3:0 4:1</timepointsMapped><setupsMapped>2:0</setupsMapped>" in xml


def test_legacy_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(LEGACY.format("range"))
    got = datasets.read_legacy_xml(spark, f"{tmp_path}/a.xml")
    assert [r.timepoint_id for r in got["timepoints"].collect()] == [0, 1, 2]
    assert got["registrations"].first().model == [1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 2, 0] and got["missing"].count() == 0
    assert list(got["setups"].first()["size"]) == [30, 20, 10]
    (tmp_path / "b.xml").write_text(LEGACY.format("pattern"))
    with pytest.raises(Exception, match="unknown timepoints"):
        datasets.read_legacy_xml(spark, f"{tmp_path}/b.xml")["timepoints"].collect()


@pytest.fixture(scope="module")
def images(spark):
    k = F.col("id")
    one = spark.range(70 * 66 * 3).select((k % 70).alias("x"), (F.floor(k / 70) % 66).alias("y"), F.floor(k / (70 * 66)).alias("z"), (k % 60_000).alias("v"))
    return one.join(spark.createDataFrame([(0, 0), (1, 4)], "setup_id int, timepoint_id int"))


def whole(df, size):
    out = np.zeros(size[::-1])
    for r in df.collect():
        x, y, z = r["size"]
        out[r.gz * 64 : r.gz * 64 + z, r.gy * 64 : r.gy * 64 + y, r.gx * 64 : r.gx * 64 + x] = np.array(r.data).reshape(z, y, x)
    return out


def test_crop_export(spark, images, tables, tmp_path):
    got = datasets.export_crop(images, [(2, 68), (1, 65), (0, 1)], (3, 4), tables["registrations"], f"{tmp_path}/crop.n5")
    image = whole(spark.read.format("n5").option("path", f"{tmp_path}/crop.n5").load(), (67, 65, 2))
    want = (np.arange(70 * 66 * 3) % 60_000).reshape(3, 66, 70)[0:2, 1:66, 2:69]
    assert (image == want).all()
    moved = {(r.timepoint_id, r.setup_id): r.model for r in got["registrations"].collect()}
    assert moved.keys() == {(t, s) for t in (0, 1) for s in (0, 2)} and moved[0, 0][3] == 3 + 2 and moved[0, 0][7] == -1.25 + 2


def test_resave(spark, images, tmp_path):
    """Levels come out of the store, as an own heuristic names them; progress is told."""
    from voxfabric.operators.boxes import image_of

    keys = ["setup_id", "timepoint_id"]
    image = image_of(blocks.collect_blocks(images, (32, 16, 2), keys), (32, 16, 2), (70, 66, 3), keys)
    told, asked = [], []
    levels = datasets.resave_n5(image, (1.0, 1.0, 1.0), f"{tmp_path}/all.n5", plane_done=lambda k, n: told.append((k, n)), finer=lambda r, k: asked.append(k))
    assert told == [(k, len(levels)) for k in range(len(levels))] and asked == list(range(1, len(levels)))
    got = spark.read.format("n5").option("path", f"{tmp_path}/all.n5").load()
    assert {(r.setup_id, r.timepoint_id) for r in got.collect()} == {(r.setup_id, r.timepoint_id) for r in images.select(*keys).distinct().collect()}
    first = images.select(*keys).first()
    for k, level in enumerate(levels):
        size = [max(1, n // f) for n, f in zip((70, 66, 3), level["resolution"])]
        part = got.where((F.col("setup_id") == first.setup_id) & (F.col("timepoint_id") == first.timepoint_id) & (F.col("level") == k))
        assert part.agg(F.sum(F.size("data"))).first()[0] == size[0] * size[1] * size[2]
    assert n5.properties(f"{tmp_path}/all.n5", first.setup_id, first.timepoint_id)["resolutions"] == [list(x["resolution"]) for x in levels]


def test_failing_tasks_leave_no_chunk_and_layouts_are_kept(spark, tmp_path):
    n5.register(spark)
    rows = [(0, 0, 0, x, 0, 0, [2, 1, 1], [float(x), 1.0]) for x in range(8)]
    df = spark.createDataFrame(rows, n5.SCHEMA).repartition(4)
    options = {"dimensions": "[16,1,1]", "blockSize": "[2,1,1]", "layout": "s%d/t%d/lod%d"}
    bad = df.withColumn("data", F.when(F.col("gx") == 5, F.raise_error(F.lit("broken")).cast("array<double>")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("n5").options(path=f"{tmp_path}/a", **options).mode("append").save()
    assert [p for p in (tmp_path / "a").glob("[!.]*")] == []
    df.write.format("n5").options(path=f"{tmp_path}/a", **options).mode("append").save()
    assert {p.name for p in (tmp_path / "a").iterdir()} == {"s0", "attributes.json"}
    got = spark.read.format("n5").options(path=f"{tmp_path}/a", layout="s%d/t%d/lod%d").load()
    assert sorted(map(tuple, got.collect())) == rows
    with pytest.raises(Exception, match="three folders"):
        df.write.format("n5").options(path=f"{tmp_path}/b", **options | {"layout": "s%d"}).mode("append").save()


def png(pixels):
    """An RGB image file."""
    h, w, _ = pixels.shape
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_tiles(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "2_3_1.png").write_bytes(png(pixels))
    (tmp_path / "7" / "2_4_1.png").write_bytes(b"broken")
    got = datasets.read_tiles(spark, f"{tmp_path}/7", r"/(?P<z>\d+)/(?P<row>\d+)_(?P<column>\d+)_(?P<level>\d+)\.png$").collect()
    assert {(r.z, r.row, r.column, r.level) for r in got} == {(7, 2, 3, 1)}
    assert {(r.px, r.py): (r.r, r.g, r.b) for r in got} == {(x, y): tuple(pixels[y, x].tolist()) for x in range(5) for y in range(4)}
    path = spark.range(1).select(datasets.tile_path("http://t/%5$d/%8$d_%9$d_%1$d.jpg", *[F.lit(v) for v in (1, 0.5, 0, 0, 7)], 256, 256, F.lit(2), F.lit(3)).alias("p")).first().p
    assert path == "http://t/7/2_3_1.jpg"


def test_cutouts_and_remote_levels(spark):
    df = spark.createDataFrame([(1, bytearray(zlib.compress(bytes([0, 200, 255]))))], "k int, content binary")
    assert datasets.cutouts(df).first().data == [0, 200, 255]
    lit = lambda *v: [F.lit(x) for x in v]
    assert spark.range(1).select(datasets.cutout_path("http://c", F.lit(2), lit(0, 64, 3), lit(64, 32, 16), 1).alias("p")).first().p == "http://c/2/0,64/64,96/4,20/neariso/"
    reply = json.dumps({"maxNumLevels": 2, "perSetupMipmapInfo": {"3": {"resolutions": [[1, 1, 1], [2, 2, 1]], "subdivisions": [[16, 16, 16], [8, 8, 8]]}}})
    got = datasets.remote_levels(spark.createDataFrame([(reply,)], "json string")).orderBy("level").collect()
    assert [(r.setup_id, r.level, r.resolution, r.subdivision) for r in got] == [(3, 0, [1, 1, 1], [16, 16, 16]), (3, 1, [2, 2, 1], [8, 8, 8])]


def test_chunks_of_sparse_voxels(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (3, 1, 0, 7), (4, 0, 1, 9)], "x long, y long, z long, v long")
    got = {r.gx: r.data for r in blocks.collect_blocks(df, (4, 2, 2)).collect()}
    assert got == {0: [5, 0, 0, 0, 0, 0, 0, 7] + [0] * 8, 1: [0] * 8 + [9] + [0] * 7}


def test_settings_round_trip(spark, tmp_path):
    from voxfabric.sources import settings

    one = [float(i) for i in range(12)]
    want = {
        "state": spark.createDataFrame([(1, 0, 4, "FUSEDGROUP", "LINEAR")], "source long, group long, timepoint long, mode string, interpolation string"),
        "sources": spark.createDataFrame([(i, i % 2 == 0, 1.5 * i, 200.0, -i, [v + i for v in one]) for i in range(3)], "source_id long, active boolean, cmin double, cmax double, color int, fixed array<double>"),
        "groups": spark.createDataFrame([(0, "all & one", True, [0, 2]), (1, "b", False, [1])], "group_id long, name string, active boolean, members array<bigint>"),
        "bookmarks": spark.createDataFrame([("F1", one), ("<x>", one[::-1])], "key string, model array<double>"),
    }
    settings.settings_xml(**want).coalesce(1).write.text(f"{tmp_path}/s")
    got = settings.read_settings(spark, f"{tmp_path}/s")
    for name, df in want.items():
        assert rows(got[name].select(df.columns)) == rows(df), name

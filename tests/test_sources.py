import gzip
import json
import struct
import time

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxfabric.operators import catalog
from voxfabric.sources import blocks, formats, n5
from voxfabric.streaming import state


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    n5.register(spark)
    path = str(tmp_path_factory.mktemp("store"))
    rows = [(t, s, 0, x, y, 0, [4, 4, 2], [float(1000 * t + 100 * s + 10 * x + y + i) for i in range(32)]) for t in (0, 1) for s in (0, 3) for x in range(3) for y in range(2) if (x, y) != (1, 1)]
    df = spark.createDataFrame(rows, n5.SCHEMA)
    options = {"dimensions": "[12,8,2]", "blockSize": "[4,4,2]", "dataType": "uint16", "compression": "gzip"}
    df.write.format("n5").options(path=path, **options).mode("append").save()
    return path, rows


def test_n5_round_trip(spark, store):
    path, rows = store
    got = spark.read.format("n5").option("path", path).option("chunksPerTask", 2).load()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    some = got.where("setup_id = 3 and gx in (0, 2) and level = 0 and data[0] > 0")
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[1] == 3 and r[3] in (0, 2))
    assert json.load(open(f"{path}/setup3/attributes.json")) == {"downsamplingFactors": [[1, 1, 1]], "dataType": "uint16"}
    blob = open(f"{path}/setup0/timepoint0/s0/2/1/0", "rb").read()
    assert struct.unpack(">HH3I", blob[:16]) == (0, 3, 4, 4, 2) and len(gzip.decompress(blob[16:])) == 64


def test_n5_whole_64_bit_values(spark, tmp_path):
    big = 2**53 + 1
    blob = n5.encode_chunk(np.array([big, 2**64 - 1], np.uint64), [2, 1, 1], "uint64", "raw")
    base = tmp_path / "a7" / "b1" / "c0"
    (base / "0" / "0").mkdir(parents=True)
    (base / "0" / "0" / "0").write_bytes(blob)
    (base / "attributes.json").write_text(json.dumps({"dimensions": [2, 1, 1], "blockSize": [2, 1, 1], "dataType": "uint64", "compression": {"type": "raw"}}))
    n5.register(spark)
    got = spark.read.format("n5").options(path=f"file://{tmp_path}", element="decimal(20,0)", layout="a%d/b%d/c%d").load().collect()
    assert [int(v) for v in got[0].data] == [big, 2**64 - 1] and (got[0].setup_id, got[0].timepoint_id, got[0].level) == (7, 1, 0)


def test_n5_properties(store):
    assert n5.properties(store[0], 3) == {"dtype": "uint16", "resolutions": [[1, 1, 1]], "dimensions": [12, 8, 2]}
    assert n5.properties(store[0], 9) == {"dtype": None, "resolutions": None, "dimensions": None}


def test_n5_missing_chunks_are_zeros(spark, store):
    path, _ = store
    stored = spark.read.format("n5").option("path", path).load().where("setup_id = 0 and timepoint_id = 1").select("gx", "gy", "gz", F.transform("data", lambda v: v.cast("int")).alias("data"))
    grid = blocks.grid_of(spark.createDataFrame([(1, 12, 8, 2)], "k int, dim_x long, dim_y long, dim_z long"), (4, 4, 2), []).select(*[F.col(g).cast("int").alias(g) for g in ("gx", "gy", "gz")])
    whole = {(r.gx, r.gy): r.data for r in blocks.fill_missing(stored, grid, (4, 4, 2)).collect()}
    assert len(whole) == 6 and whole[1, 1] == [0] * 32 and whole[2, 1][0] == 1021


@pytest.mark.parametrize("dtype", n5.TYPES)
def test_chunk_types(dtype):
    size, data = n5.decode_chunk(n5.encode_chunk([0, 1, 100], [3, 1, 1], dtype, "raw"), dtype, "raw")
    assert size == [3, 1, 1] and data.tolist() == [0, 1, 100]


def test_attribute_tree(spark, store):
    paths = [r.path for r in formats.attribute_tree(spark, store[0]).collect()]
    assert len(paths) == 1 + 2 + 4 + 4


XML = """<SpimData version="0.2"><SequenceDescription><ViewSetups>
<ViewSetup><id>0</id><size>40 30 5</size><voxelSize><unit>um</unit><size>1.0 1.0 2.5</size></voxelSize></ViewSetup>
<ViewSetup><id>2</id><size>41 31 6</size><voxelSize><unit>um</unit><size>0.5 0.5 1</size></voxelSize></ViewSetup></ViewSetups>
<Timepoints type="range"><first>3</first><last>5</last></Timepoints>
<MissingViews><MissingView timepoint="4" setup="2"/></MissingViews></SequenceDescription>
<ViewRegistrations><ViewRegistration timepoint="3" setup="0"><ViewTransform type="affine"><affine>1.0 0 0 7 0 1 0 8 0 0 2.5 9</affine></ViewTransform></ViewRegistration></ViewRegistrations></SpimData>"""


def test_dataset_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML)
    t = formats.read_dataset_xml(spark, str(tmp_path / "d.xml"))
    assert [(r.setup_id, r["size"], r.voxel.unit, r.voxel["size"]) for r in t["setups"].collect()] == [(0, [40, 30, 5], "um", [1, 1, 2.5]), (2, [41, 31, 6], "um", [0.5, 0.5, 1])]
    assert [tuple(r) for r in t["timepoints"].collect()] == [(0, 3), (1, 4), (2, 5)]
    assert [tuple(r) for r in t["missing"].collect()] == [(4, 2)]
    assert t["registrations"].first().model == [1, 0, 0, 7, 0, 1, 0, 8, 0, 0, 2.5, 9]


def test_cutout_levels(spark):
    token = {"dataset": {"imagesize": {"1": [200, 100], "2": [100, 50]}, "slicerange": [1, 40], "cube_dimension": {"1": [64, 64, 16], "2": [64, 64, 16]}, "resolutions": [1, 2], "zscale": {"1": 3.0, "2": 1.5}}}
    rows = formats.cutout_levels(spark.createDataFrame([(json.dumps(token),)], "json string")).orderBy("resolution").collect()
    assert [tuple(r) for r in rows] == [(1, 200, 100, 40, [64, 64, 16], [1, 1, 3]), (2, 100, 50, 40, [64, 64, 16], [2, 2, 1.5])]


def test_double_registration_is_an_error(spark):
    rows = spark.createDataFrame([(0, 0, [1.0] * 12), (0, 0, [2.0] * 12)], "setup_id int, timepoint_id int, model array<double>")
    with pytest.raises(PySparkException, match="registered twice"):
        catalog.merge_registrations(rows).collect()


def test_change_stream(spark, tmp_path):
    log = [(1, 1, "add", 5), (2, 1, "add", 5), (3, 1, "add", 7), (4, 1, "source", 7), (5, 1, "remove", 7), (6, 1, "remove", 5), (7, 1, "timepoint", 99), (8, 2, "mode", 0), (9, 2, "timepoint", 0), (10, 2, "source", 4)]
    df = spark.createDataFrame([(e, s, k, a) for e, s, k, a in log], "event_id long, session long, kind string, arg long").withColumn("ts", F.timestamp_seconds("event_id"))
    df.where("event_id <= 4").write.parquet(f"{tmp_path}/in", mode="append")
    df.where("event_id > 4").write.parquet(f"{tmp_path}/in", mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    q = state.change_stream(stream, 7).writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.table("changes").orderBy("session", "event_id", F.desc("change")).collect()]
    assert got == [
        (1, 1, "NUM_SOURCES_CHANGED", "[5]"), (1, 1, "CURRENT_SOURCE_CHANGED", "5"), (1, 3, "NUM_SOURCES_CHANGED", "[5, 7]"), (1, 4, "CURRENT_SOURCE_CHANGED", "7"),
        (1, 5, "NUM_SOURCES_CHANGED", "[5]"), (1, 5, "CURRENT_SOURCE_CHANGED", "5"), (1, 6, "NUM_SOURCES_CHANGED", "[]"), (1, 6, "CURRENT_SOURCE_CHANGED", "null"),
        (1, 7, "CURRENT_TIMEPOINT_CHANGED", "6"), (2, 8, "DISPLAY_MODE_CHANGED", '"GROUP"'),
    ]
    assert np.isfinite(q.lastProgress["batchId"])


def run_stream(spark, path, df, batches, first=None, trigger=None):
    """The changes of a stream of files, one batch of sessions after the other."""
    for k in range(batches):
        df.where(F.col("event_id") % batches == k if trigger else (F.col("event_id") * batches >= k * 1000) & (F.col("event_id") * batches < (k + 1) * 1000)).coalesce(1).write.parquet(f"{path}/in", mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = state.change_stream(stream, 7, first, trigger is not None).writeStream.format("memory").queryName("agreed").option("checkpointLocation", f"{path}/ck").trigger(**(trigger or {"availableNow": True})).start()
    return q


def test_stream_and_fold_agree_on_all_fields(spark, tmp_path):
    """Random actions of all kinds in three micro-batches; the last value of each change is the state that fold() finds."""
    import random

    r = random.Random(4)
    kinds = "timepoint next previous source mode fused grouping interpolation add add add remove activate deactivate add_group remove_group group select toggle".split()
    rows = [(i, i % 5, r.choice(kinds), r.randint(0, 5)) for i in range(1000)]
    df = spark.createDataFrame(rows, "event_id long, session long, kind string, arg long").withColumn("ts", F.timestamp_seconds("event_id"))
    run_stream(spark, tmp_path, df, 3).awaitTermination(180)
    last, count = {}, {}
    for c in spark.table("agreed").orderBy("event_id").collect():
        count[c.session] = count.get(c.session, 0) + 1
        last[c.session, c.change] = json.loads(c.value)
    ends = state.fold(df, 7).collect()
    assert len(ends) == 5
    for e in ends:
        assert e.changes == count[e.session]
        for change, field, default in (("CURRENT_TIMEPOINT_CHANGED", "timepoint", 0), ("CURRENT_SOURCE_CHANGED", "source", None), ("DISPLAY_MODE_CHANGED", "mode", "SINGLE"), ("INTERPOLATION_CHANGED", "interpolation", "NEAREST"), ("NUM_SOURCES_CHANGED", "sources", []), ("NUM_GROUPS_CHANGED", "groups", []), ("CURRENT_GROUP_CHANGED", "group", None)):
            assert getattr(e, field) == last.get((e.session, change), default), (e.session, field)


def test_initial_state_and_bookmarks(spark, tmp_path):
    """A stream that starts from folded states; a recalled bookmark is reached by a timer."""
    old = [(1, 1, "add", 5), (2, 1, "add", 6), (3, 1, "bookmark", 2), (4, 1, "timepoint", 3), (5, 2, "add", 9)]
    make = lambda rows: spark.createDataFrame(rows, "event_id long, session long, kind string, arg long").withColumn("ts", F.timestamp_seconds("event_id"))
    first = state.fold(make(old), 7)
    new = make([(10, 1, "remove", 5), (11, 1, "recall", 2), (12, 1, "recall", 3), (13, 2, "next", 0), (14, 3, "add", 1)])
    q = run_stream(spark, tmp_path, new, 1, first, {"processingTime": "200 milliseconds"})
    for _ in range(120):
        got = {tuple(x) for x in spark.table("agreed").collect()}
        if (1, 3, "BOOKMARK_REACHED", "3") in got:
            break
        time.sleep(0.5)
    q.stop()
    assert got == {
        (1, 10, "NUM_SOURCES_CHANGED", "[6]"), (1, 10, "CURRENT_SOURCE_CHANGED", "6"), (1, 11, "BOOKMARK_RECALLED", "3"), (1, 3, "BOOKMARK_REACHED", "3"),
        (2, 13, "CURRENT_TIMEPOINT_CHANGED", "1"), (3, 14, "NUM_SOURCES_CHANGED", "[1]"), (3, 14, "CURRENT_SOURCE_CHANGED", "1"),
    }


def test_checked_actions(spark):
    log = [(1, "add", 5), (2, "source", 5), (3, "remove", 5), (4, "activate", 5), (5, "timepoint", 7), (6, "group", 1), (7, "timepoint", None), (8, "next", None), (9, None, 1)]
    df = spark.createDataFrame([(1, e, k, a) for e, k, a in log], "session long, event_id long, kind string, arg long").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {(r.event_id, r.reason) for r in state.rejected(df, 7).collect()} == {(4, "no such source"), (5, "no such timepoint"), (6, "no such group"), (7, "no number"), (9, "no number")}
    assert state.checked(df.where("event_id <= 3"), 7).count() == 3 and state.checked(df.limit(0), 7).collect() == []
    with pytest.raises(PySparkException, match="no such timepoint"):
        state.checked(df.where("event_id = 5"), 7).collect()
    with pytest.raises(ValueError, match="at least one"):
        state.rejected(df, 0)


def test_stores_by_uri(tmp_path):
    """Folders and file URIs open alike; what can't be reached is none."""
    assert n5.reached(str(tmp_path))[1] == n5.reached(f"file://{tmp_path}")[1] == str(tmp_path)
    for uri in (str(tmp_path / "none"), f"file://{tmp_path}/none", "nowhere://host/store", "odd://"):
        assert n5.reached(uri) is None

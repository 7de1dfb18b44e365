import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from voxfabric.sources import generated


def plane(x, y, z):
    return x + 10 * y + 100 * z


def seven(x, y, z):
    return 7


def test_values_and_crops(spark):
    generated.register(spark)
    options = {"function": "tests.test_generated:plane", "low": "-2,0,3", "high": "7,4,5", "cell": "4,3,2", "chunksPerTask": "3"}
    df = spark.read.format("function").options(**options).load()
    want = {(x, y, z): float(x + 10 * y + 100 * z) for x in range(-2, 8) for y in range(5) for z in range(3, 6)}
    assert {(r.x, r.y, r.z): r.v for r in df.collect()} == want and df.count() == len(want)
    some = df.where("x between 1 and 3 and y in (0, 4) and z > 3 and v < 431")
    assert {(r.x, r.y, r.z): r.v for r in some.collect()} == {k: v for k, v in want.items() if 1 <= k[0] <= 3 and k[1] in (0, 4) and k[2] > 3 and v < 431}
    assert df.where("x = 9").collect() == []
    const = spark.read.format("function").options(**options | {"function": "tests.test_generated:seven"}).load()
    assert const.agg(F.sum("v")).first()[0] == 7.0 * len(want)


def test_chunks_are_left_out(monkeypatch):
    reader = generated.FunctionReader({"function": "tests.test_generated:plane", "low": "0,0,0", "high": "999999999,999,99", "cell": "10,10,10"})
    assert list(reader.pushFilters([GreaterThan(("x",), 500_000_004), LessThanOrEqual(("x",), 500_000_011), In(("y",), (3, 995)), EqualTo(("z",), 50), EqualTo(("v",), 1.0)])) == [EqualTo(("v",), 1.0)]
    evaluated = []
    monkeypatch.setattr("tests.test_generated.plane", lambda x, y, z: evaluated.append(len(x)) or x)
    rows = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert rows == 7 * 2 and sum(evaluated) == rows and len(evaluated) == 4
    with pytest.raises(ValueError, match="bounds"):
        generated.FunctionReader({"function": "f:g"})

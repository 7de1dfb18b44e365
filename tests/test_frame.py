import numpy as np
from pyspark.sql import functions as F

from voxfabric.operators import frame


def test_render_against_numpy(spark):
    r = np.random.default_rng(4)
    cell, n = 4, 8
    volumes = r.integers(0, 256, (3, n, n, n))  # z, y, x
    models = [[1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0], [1, 0, 0, 5, 0, 1, 0, 3, 0, 0, 1, -2], [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 100]]
    rows = [(k, [float(v) for v in m], [-1, -65536, -1][k]) for k, m in enumerate(models)]
    sources = spark.createDataFrame(rows, "source_id int, model array<double>, color int")
    sources = sources.withColumns({**{f"min_{a}": F.lit(0) for a in "xyz"}, **{f"max_{a}": F.lit(n - 1) for a in "xyz"}, "culled": F.lit(True), "cmin": F.lit(0.0), "cmax": F.lit(255.0)})
    chunks = [(k, x, y, z, volumes[k, z * cell : z * cell + cell, y * cell : y * cell + cell, x * cell : x * cell + cell].reshape(-1).tolist()) for k in range(3) for x in range(2) for y in range(2) for z in range(2)]
    blocks = spark.createDataFrame(chunks, "source_id int, gx int, gy int, gz int, data array<int>")
    viewer = np.array([[0, -2, 0, 16], [2, 0, 0, 1], [0.5, 0, 1, -3], [0, 0, 0, 1]])
    got = {(p.px, p.py): (p.a, p.r, p.g, p.b) for p in frame.render(sources, blocks, viewer[:3].reshape(-1).tolist(), 24, 20, (cell,) * 3).collect()}
    want = {}
    for px in range(24):
        for py in range(20):
            total = np.zeros(4, int)
            for k, m in enumerate(models):
                at = np.linalg.inv(viewer @ np.vstack([np.reshape(m, (3, 4)), [0, 0, 0, 1]])) @ [px, py, 0, 1]
                x, y, z = np.floor(at[:3] + 0.5).astype(int)
                if all(0 <= c < n for c in (x, y, z)):
                    v = volumes[k, z, y, x]
                    total += [255, v, v if k != 1 else 0, v if k != 1 else 0]
            if total[0]:
                want[px, py] = tuple(np.minimum(255, total).tolist())
    assert got == want and len(want) > 50


def test_lines_give_the_pixels_of_points(spark):
    """Oblique, axis-parallel and magnified planes, steps that meet chunk borders exactly, boxes smaller than their chunks."""
    from voxfabric.operators import sampling

    r = np.random.default_rng(2)
    cell, n = (4, 3, 5), (3, 4, 2)
    chunks = [(x, y, z, r.integers(1, 1000, 60).tolist()) for x in range(n[0]) for y in range(n[1]) for z in range(n[2]) if (x, y, z) != (1, 1, 1)]
    blocks = spark.createDataFrame(chunks, "gx int, gy int, gz int, data array<int>")
    box = {"min_x": 0, "max_x": 10, "min_y": 1, "max_y": 11, "min_z": 0, "max_z": 9}
    backs = [(0.5, 0.25, 0.0, -2.0, -0.25, 0.5, 0.0, 8.0, 0.125, 0.25, 1.0, 0.5), (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 4), (0, 0.5, 0, -1, 0.5, 0, 0, -3, 0.5, 0.5, 0, -4), (0.001, 0, 0, 3.4, 0, 0.002, 0, 2.4, 0.0005, 0, 0, 4.4), (-1.7, 0.3, 0, 30, 0.9, 0.1, 0, -9, 0.33, -0.4, 0, 6), (3, 0, 0, -5, 3, 0, 0, -4, 2, 0, 0, 0)]
    width, height = 48, 40
    for back in backs:
        points = sampling.into_source(sampling.pixels(spark, width, height), back)
        for a in "xyz":
            points = points.where(F.floor(F.col(f"s{a}") + 0.5).between(box[f"min_{a}"], box[f"max_{a}"]))
        want = {(p.px, p.py): p.v for p in sampling.nearest_in_blocks(points, blocks, cell).where("mask = 1").collect()}
        lines = spark.range(height).select(F.col("id").alias("py"), F.lit(0).cast("long").alias("x0"), F.lit(width - 1).cast("long").alias("x1"), *[F.lit(v).alias(k) for k, v in box.items()], *[(F.lit(float(back[4 * i + 1])) * F.col("id") + float(back[4 * i + 3])).alias(f"o_{a}") for i, a in enumerate("xyz")], *[F.lit(float(back[4 * i])).alias(f"d_{a}") for i, a in enumerate("xyz")])
        found = sampling.nearest_on_lines(lines, blocks, cell).collect()
        got = {(p.px, p.py): p.v for p in found}
        assert len(found) == len(got) and len(want) > 20
        wrong = {k for k in want.keys() | got.keys() if want.get(k) != got.get(k)}
        assert len(wrong) <= 2, back  # sums are rounded in another order

import json
import struct
import zlib

import numpy as np
import pytest

from voxfabric.sources import servers

SEEN: dict[str, int] = {}


def flaky(url):
    """Fails twice for each URL, then reads the file."""
    SEEN[url] = SEEN.get(url, 0) + 1
    if SEEN[url] % 3:
        raise OSError("not now")
    return servers.from_files(url)


def broken(url):
    raise OSError("never")


def png(pixels, filters=(0,)):
    """An image file whose lines take filters in turn."""
    h, w, n = pixels.shape
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    padded = np.zeros((h + 1, w + 1, n), int)
    padded[1:, 1:] = pixels
    raw = b""
    for y in range(h):
        line, up, left, corner = padded[y + 1, 1:], padded[y, 1:], padded[y + 1, :-1], padded[y, :-1]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * line, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))]
        k = filters[y % len(filters)]
        raw += bytes([k]) + ((line - guess[k]) & 255).astype(np.uint8).tobytes()
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_decoding_all_line_filters(n):
    pixels = np.random.default_rng(n).integers(0, 256, (11, 7, n))
    got = servers.decode_image(png(pixels, (0, 1, 2, 3, 4)))
    assert (got == (np.repeat(pixels[:, :, :1], 3, 2) if n < 3 else pixels[:, :, :3])).all()


def test_formats():
    assert servers.formatted("http://t/%5$d/%8$03d_%9$d_%1$d_%2$.2f%%.jpg", 1, 0.5, 0, 0, 7, 256, 256, 2, 3) == "http://t/7/002_3_1_0.50%.jpg"


def test_tiles_with_slabs_cut_blocks_and_missing_tiles(spark, tmp_path):
    """Blocks of another size than tiles, over two levels; one tile is missing, others have rest at the edge."""
    servers.register(spark)
    r = np.random.default_rng(1)
    image = {0: r.integers(0, 256, (7, 21, 30, 3)), 1: r.integers(0, 256, (7, 10, 15, 3))}
    for level, v in image.items():
        for z, plane in enumerate(v):
            for row in range(-(-plane.shape[0] // 8)):
                for column in range(-(-plane.shape[1] // 8)):
                    if (level, z, row, column) != (0, 2, 1, 1):
                        (tmp_path / f"{level}_{z}_{row}_{column}.png").write_bytes(png(plane[8 * row : 8 * row + 8, 8 * column : 8 * column + 8]))
    image[0][2, 8:16, 8:16] = 0
    url, options = f"{tmp_path}/%1$d_%5$d_%8$d_%9$d.png", {"width": 30, "height": 21, "depth": 7, "zScale": 1, "tileWidth": 8, "tileHeight": 8, "blockWidth": 12, "blockHeight": 5, "blockDepth": 2, "levels": 2, "chunksPerTask": 7}
    want = {}
    for level, slab in ((0, 1), (1, 2)):
        v = image[level]
        depth = 7 // slab
        v = v[: depth * slab].reshape(depth, slab, *v.shape[1:]).sum(1) // slab
        v = (v[..., 0] << 16) + (v[..., 1] << 8) + v[..., 2] - (1 << 24)
        for gz in range(-(-depth // 2)):
            for gy in range(-(-v.shape[1] // 5)):
                for gx in range(-(-v.shape[2] // 12)):
                    part = v[2 * gz : 2 * gz + 2, 5 * gy : 5 * gy + 5, 12 * gx : 12 * gx + 12]
                    want[level, gx, gy, gz] = (list(part.shape[::-1]), part.reshape(-1).tolist())
    df = spark.read.format("tiles").options(url=url, **options).load()
    assert {(x.level, x.gx, x.gy, x.gz): (x["size"], x.data) for x in df.collect()} == want
    some = df.where("level = 0 and gx >= 1 and gz in (1, 2)")
    assert {(x.level, x.gx, x.gy, x.gz): (x["size"], x.data) for x in some.collect()} == {k: v for k, v in want.items() if k[0] == 0 and k[1] >= 1 and k[3] in (1, 2)}
    assert df.where("level = 9").collect() == []


def test_fetchers_attempts_and_failures(spark, tmp_path, monkeypatch):
    servers.register(spark)
    info = {"dataset": {"resolutions": [1, 2], "imagesize": {"1": [10, 6, 8], "2": [5, 3, 8]}, "offset": {"1": [0, 0, 1], "2": [0, 0, 1]}, "cube_dimension": {"1": [4, 4, 4], "2": [4, 4, 7]}}}
    (tmp_path / "tok" / "info").mkdir(parents=True)
    reader = servers.CutoutReader({"url": "base", "token": "tok", "attempts": "3", "pause": "0", "fetcher": "tests.test_servers:flaky"})
    calls = []
    monkeypatch.setattr(servers, "fetcher_of", lambda name: lambda url: calls.append(url) or (json.dumps(info).encode() if len(calls) > 2 else (_ for _ in ()).throw(OSError("not now"))))
    levels = list(reader.levels())
    assert len(calls) == 3 and calls[0] == "base/tok/info/"
    assert [(x.dims, x.block, x.extra) for x in levels] == [((10, 6, 7), (4, 4, 4), (1,)), ((5, 3, 7), (4, 4, 7), (1,))]
    values = np.arange(4 * 2 * 3, dtype=np.uint8)
    asked = []
    monkeypatch.setattr(servers, "fetcher_of", lambda name: lambda url: asked.append(url) or zlib.compress(values.tobytes()))
    assert reader.chunk(levels[0], [4, 4, 4], [4, 2, 3]).tolist() == values.tolist() and asked == ["base/tok/zip/0/4,8/4,6/5,8/"]
    monkeypatch.setattr(servers, "fetcher_of", lambda name: lambda url: b"no stream")
    assert not reader.chunk(levels[0], [0, 0, 0], [4, 4, 4]).any()
    reader.strict = True
    with pytest.raises(zlib.error):
        reader.chunk(levels[0], [0, 0, 0], [4, 4, 4])
    monkeypatch.setattr(servers, "fetcher_of", lambda name: broken)
    with pytest.raises(OSError, match="never"):
        reader.get("x")
    reader.strict = False
    assert reader.get("x") is None


def test_cells_by_files(spark, tmp_path):
    servers.register(spark)
    views = {"{1,0,0}": {"dimensions": [3, 2, 1], "exists": True}, "{2,0,0}": {"dimensions": [1, 1, 1], "exists": False}}
    (tmp_path / "s?p=init").write_text(json.dumps({"perSetupMipmapInfo": {"0": {"subdivisions": [[2, 2, 2]]}}, "dimsAndExistence": views}))
    at = tmp_path / "s?p=cell" / "1" / "1" / "0" / "0" / "1" / "2" / "1" / "2" / "0"
    at.mkdir(parents=True)
    (at / "0").write_bytes(b"\xff\xfe\x00\x01")
    got = spark.read.format("cells").option("url", f"{tmp_path}/s").load().orderBy("gx").collect()
    assert [(r.timepoint_id, r.gx, r["size"], r.data) for r in got] == [(1, 0, [2, 2, 1], [0, 0, 0, 0]), (1, 1, [1, 2, 1], [65534, 1])]

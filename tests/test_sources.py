import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.sources import geotiff, layers, outlets, shapefile, sinks
from thalweg.operators.validate import InvalidOutlets


def write_layer(base, rows, fields):
    """rows: (values, parts); parts of None make a null shape."""
    shp, shx, dbf = b"", b"", b""
    at = 50
    for k, (values, parts) in enumerate(rows):
        if parts is None:
            content = struct.pack("<i", 0)
        else:
            pts = [p for part in parts for p in part]
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]]).tolist()
            content = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(parts), len(pts)) + struct.pack(f"<{len(parts)}i", *starts)
            content += b"".join(struct.pack("<2d", *p) for p in pts)
        shp += struct.pack(">2i", k + 1, len(content) // 2) + content
        shx += struct.pack(">2i", at, len(content) // 2)
        at += 4 + len(content) // 2
        dbf += b" " + b"".join(("" if v is None else str(v)).encode("utf-8").ljust(w)[:w] if t == "C" else ("" if v is None else str(v)).encode().rjust(w) for v, (_, t, w, _) in zip(values, fields))
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + n // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    base.with_suffix(".shp").write_bytes(head(len(shp)) + shp)
    base.with_suffix(".shx").write_bytes(head(len(shx)) + shx)
    width = 1 + sum(f[2] for f in fields)
    desc = b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields)
    dbf = bytes([3, 124, 1, 1]) + struct.pack("<IHH", len(rows), 33 + len(desc), width) + b"\0" * 20 + desc + b"\r" + dbf
    base.with_suffix(".dbf").write_bytes(dbf)
    base.with_suffix(".cpg").write_text("UTF-8")


def test_shapefile_round_trip(spark, tmp_path):
    fields = [("COMID", "N", 12, 0), ("area", "N", 12, 3), ("name", "C", 20, 0), ("ok", "L", 1, 0)]
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
    rows = [([k, k / 8, f"Bróun {k}", "T"], [square, hole] if k % 2 else [square]) for k in range(25)] + [([None, None, None, None], None)]
    write_layer(tmp_path / "layer", rows, fields)
    spark.dataSource.register(shapefile.ShapefileSource)
    df = spark.read.format("shapefile").option("recordsPerTask", 4).load(str(tmp_path / "layer.shp"))
    assert df.rdd.getNumPartitions() == 7
    got = df.orderBy("COMID").collect()
    assert got[0]["COMID"] is None and got[0]["xs"] == [] and got[0]["shape_type"] == 0
    assert [(r["COMID"], r["area"], r["name"], r["ok"], len(r["xs"])) for r in got[1:]] == [(k, k / 8, f"Bróun {k}", True, 1 + k % 2) for k in range(25)]
    assert got[2]["xs"][1] == [p[0] for p in hole] and got[2]["ys"][0] == [p[1] for p in square]
    assert shapefile.write_missing_prj(str(tmp_path)) == [str(tmp_path / "layer.prj")] and not shapefile.write_missing_prj(str(tmp_path))


def pack_lzw(data):
    codes, table, w = [256], {bytes([i]): i for i in range(256)}, b""
    widths, size = [9], 258
    out = []
    width = 9

    def put(code):
        out.append((code, width))

    put(256)
    for byte in data:
        b = bytes([byte])
        if w + b in table:
            w += b
            continue
        put(table[w])
        table[w + b] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = b
    put(table[w])
    size += 1
    width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    bits = "".join(format(c, f"0{n}b") for c, n in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def write_tiff(path, a, compression, tile=None, predictor=1, nodata="0", order="<", scale=0.5, corner=(10.0, 20.0)):
    h, w = a.shape
    blocks = []
    th, tw = tile or (5, w)
    for r in range(0, h, th):
        for c in range(0, w, tw):
            b = a[r : r + th, c : c + tw]
            if tile:
                full = np.zeros((th, tw), a.dtype)
                full[: b.shape[0], : b.shape[1]] = b
                b = full
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(a.dtype)
            raw = b.astype(a.dtype.newbyteorder(order)).tobytes()
            blocks.append({1: raw, 8: zlib.compress(raw), 5: pack_lzw(raw)}[compression])
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [a.dtype.itemsize * 8]), (259, 3, [compression]), (277, 3, [1])]
    where = (324, 325) if tile else (273, 279)
    tags += [(where[0], 4, None), (where[1], 4, [len(b) for b in blocks]), (317, 3, [predictor]), (339, 3, [kind])]
    tags += [(322, 3, [tw]), (323, 3, [th])] if tile else [(278, 3, [th])]
    tags += [(33550, 12, [scale, scale, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *corner, 0.0]), (42113, 2, nodata)]
    tags.sort()
    data_at = 8 + sum(map(len, blocks))
    offs = np.cumsum([8] + [len(b) for b in blocks[:-1]]).tolist()
    extra, ifd = b"", struct.pack(order + "H", len(tags))
    extra_at = data_at + 2 + 12 * len(tags) + 4
    for tag, t, v in tags:
        v = offs if v is None else v
        raw = v.encode() + b"\0" if t == 2 else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[t] }", *v)
        n = len(raw) if t == 2 else len(v)
        if len(raw) <= 4:
            ifd += struct.pack(order + "HHI", tag, t, n) + raw.ljust(4, b"\0")
        else:
            ifd += struct.pack(order + "HHII", tag, t, n, extra_at + len(extra))
            extra += raw
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, data_at) + b"".join(blocks) + ifd + struct.pack(order + "I", 0) + extra)


@pytest.mark.parametrize("compression, tile, predictor, dtype, order", [(1, None, 1, "u1", "<"), (8, (16, 16), 2, "i4", "<"), (5, (16, 16), 1, "u1", ">"), (5, None, 2, "i2", ">"), (8, None, 1, "f4", "<")])
def test_geotiff_round_trip(spark, tmp_path, compression, tile, predictor, dtype, order):
    rng = np.random.default_rng(1)
    a = (rng.integers(0, 9, (37, 53)) * rng.integers(0, 2, (37, 53))).astype(dtype)
    write_tiff(tmp_path / "a.tif", a, compression, tile, predictor, order=order)
    spark.dataSource.register(geotiff.GeoTiffSource)
    load = lambda **o: {(r["r"], r["c"]): r["value"] for r in spark.read.format("geotiff").options(**o).load(str(tmp_path / "a.tif")).collect()}
    assert load() == {(r, c): float(a[r, c]) for r, c in zip(*np.nonzero(a))}
    part = load(window="12.0,10.0,20.0,18.0")  # columns 4..19, rows 4..19
    assert part == {(r, c): float(a[r, c]) for r, c in zip(*np.nonzero(a)) if 4 <= r < 20 and 4 <= c < 20}
    assert load(window="500,500,600,600") == {}


def test_lzw_over_all_widths():
    rng = np.random.default_rng(3)
    for n in (1, 300, 5000, 60_000):
        data = rng.integers(0, 7, n).astype("u1").tobytes() + rng.integers(0, 256, n).astype("u1").tobytes()
        assert geotiff.lzw(pack_lzw(data)) == data


def test_outlet_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text('id, lat, lng, name, area, note\n007, 64.5, -20.5,"a, ""b""", 12, x\nb,bad,1,,,\n')
    rows = outlets.read_outlets(spark, str(tmp_path / "o.csv")).collect()
    assert [(r["id"], r["lat"], r["lng"], r["area"], r["name"]) for r in rows] == [("007", 64.5, -20.5, 12.0, 'a, "b"'), ("b", None, 1.0, None, None)]
    (tmp_path / "p.csv").write_text("id,lat\n1,2\n")
    with pytest.raises(InvalidOutlets):
        outlets.read_outlets(spark, str(tmp_path / "p.csv"))


def write_world(folder):
    """Two basins of two catchments each, 6 x 6 cells a catchment, with their rivers and rasters, as files."""
    west, north = 2000, 30000  # the world grid's column and row of the corner
    x, y = (lambda c: -180 + (west + c) / 1200), (lambda r: 90 - (north + r) / 1200)
    box = lambda a, b: [(x(a), y(0)), (x(b), y(0)), (x(b), y(6)), (x(a), y(6)), (x(a), y(0))]
    fields = [("COMID", "N", 12, 0), ("unitarea", "N", 12, 3)]
    river = [("COMID", "N", 12, 0), ("up1", "N", 12, 0), ("up2", "N", 12, 0), ("up3", "N", 12, 0), ("up4", "N", 12, 0), ("uparea", "N", 16, 4), ("lengthkm", "N", 12, 3), ("order", "N", 4, 0)]
    write_layer(folder / "mega", [([11], [box(0, 12)]), ([12], [box(12, 24)]), ([13], [box(40, 41)])], [("BASIN", "N", 4, 0)])
    for b, at in ((11, 0), (12, 12)):
        write_layer(folder / f"cat_{b}", [([b * 10 + 1, 1.0], [box(at, at + 6)]), ([b * 10 + 2, 1.0], [box(at + 6, at + 12)])], fields)
        line = lambda c: [[(x(c + 2), y(5)), (x(c + 2), y(2))]]
        write_layer(folder / f"riv_{b}", [([b * 10 + 1, b * 10 + 2, 0, 0, 0, 90.5, 1.25, 2], line(at)), ([b * 10 + 2, 0, 0, 0, 0, 40.0, 0.5, 1], line(at + 6))], river)
        shapefile.write_missing_prj(str(folder))
        r, c = np.indices((6, 12))
        fdir = np.where(c % 6 == 2, 4, np.where(c % 6 < 2, 1, 16)).astype("u1")
        acc = np.where((c % 6 == 2) & (r > 1), 6000, 1).astype("i4")
        for name, a in (("dir", fdir), ("acc", acc)):
            write_tiff(folder / f"{name}_{b}.tif", a, 8, scale=1 / 1200, corner=(x(at), y(0)))
    (folder / "outlets.csv").write_text(f"id,lat,lng,name,area\na/b,{y(4.2)},{x(3.2)},Upper mill,0.5\na_b,{y(4.2)},{x(14.2)},,\nfar,10,10,,\n")


def test_from_files_to_files(spark, tmp_path):
    from thalweg.config import Settings
    from thalweg.plans import run

    write_world(tmp_path)
    p = lambda n: str(tmp_path / n)
    files = run.Files(p("outlets.csv"), p("mega.shp"), p("cat_{basin}.shp"), p("riv_{basin}.shp"), direction=p("dir_{basin}.tif"), accumulation=p("acc_{basin}.tif"), cache=p("cache"))
    high = Settings(output_dir=p("out"), map_folder=p("map"))
    done = run.delineate(spark, files, high)
    got = {r["id"]: r for r in done.summary.collect()}
    assert {k: r["result"] for k, r in got.items()} == {"a/b": "high res", "a_b": "high res", "far": "failed"}
    assert {r["id"]: r["explanation"] for r in done.failed.collect()} == {"far": "not in any level 2 basin"}
    low = {r["id"]: r for r in run.delineate(spark, files, Settings(high_res=False)).summary.collect()}
    assert low["a/b"]["result"] == "low res" and 0 < got["a/b"]["area_calc"] < low["a/b"]["area_calc"]  # the split catchment is smaller
    assert (tmp_path / "cache" / "catchments" / "basin=11").is_dir() and not (tmp_path / "cache" / "catchments" / "basin=13").exists()
    run.write(done, high)
    assert sorted(f.name for f in (tmp_path / "out").glob("*.geojson")) == ["a_b.geojson", "a~2Fb.geojson"]
    doc = json.loads((tmp_path / "out" / "a~2Fb.geojson").read_text())
    assert doc["properties"]["name"] == "Upper mill" and doc["properties"]["result"] == "High Res" and doc["geometry"]["type"] == "MultiPolygon"
    layer = (tmp_path / "map" / "a~2Fb.js").read_text()
    assert layer.startswith("gage_coords = [") and "snapped_coords = [" in layer and "basin = {" in layer
    assert (tmp_path / "map" / "a~2Fb_rivers.js").read_text().startswith("rivers = {") and 'data-file="a~2Fb"' in (tmp_path / "map" / "_viewer.html").read_text()
    assert spark.read.option("header", True).csv(p("out/OUTPUT.csv")).count() == 3 and spark.read.option("header", True).csv(p("out/FAILED.csv")).count() == 1
    run.write(done, Settings(output_dir=p("shp"), output_ext="SHP", output_csv=False, make_map=False))
    again = layers.read_layer(spark, p("shp/a~2Fb.shp")).collect()
    rings = [r for r in done.boundaries.collect() if r["id"] == "a/b"]
    assert len(again) == 1 and again[0]["id"] == "a/b" and abs(again[0]["area_calc"] - got["a/b"]["area_calc"]) < 1e-6
    assert sorted(map(len, again[0]["ring_lng"])) == sorted(len(r["xs"]) for r in rings) and not (tmp_path / "shp" / "OUTPUT.csv").exists()
    with pytest.raises(ValueError, match="output_ext"):
        run.write(done, Settings(output_dir=p("x"), output_ext="kml", output_csv=False, make_map=False))
    (tmp_path / "mega.prj").write_text('PROJCS["UTM", GEOGCS["GCS_WGS_1984"]]')
    with pytest.raises(layers.WrongProjection):
        run.delineate(spark, files, high)


def test_names_of_files_are_apart(spark):
    keys = ["a/b", "a_b", "a b", "a+b", "a%2Fb", "a~2Fb", "A*", "å"]
    names = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(sinks.file_name(F.col("k"))).collect()]
    assert len(set(names)) == len(keys) and not any(set(n) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-_+~") for n in names)


def test_a_layer_dissolved_and_pictures(spark, tmp_path):
    from thalweg.plans import run
    from thalweg.sources import plots

    write_world(tmp_path)
    rings = run.dissolve_layer(spark, str(tmp_path / "cat_11.shp"))
    rows = rings.collect()
    assert len(rows) == 1 and len(rows[0]["xs"]) == 7  # two squares side by side: six corners
    svg = plots.vector_picture([("black", rings)], [("red", rows[0]["xs"][0], rows[0]["ys"][0])])
    assert svg.startswith("<svg") and svg.count("<path") == 1 and svg.count("<circle") == 1
    cells = layers.on_world_grid(spark, str(tmp_path / "dir_11.tif"))
    for codes, height in ((False, 24), (True, 32)):
        picture = plots.raster_picture(cells, "value", 4, codes)
        assert picture[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", picture[16:24]) == (48, height)
    raw = zlib.decompress(plots.raster_picture(cells, "value", 1, True)[41:].split(b"IEND")[0][:-8])
    assert {tuple(raw[1 + 3 * c : 4 + 3 * c]) for c in range(12)} == {tuple(plots._HUES[plots.CODES.index(k)]) for k in (1, 4, 16)}
    assert plots.CODES == [1, 2, 4, 8, 16, 32, 64, 128]
    with pytest.raises(ValueError, match="too large"):
        plots.raster_picture(cells, "value", 4000)

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.config import Settings
from thalweg.functions import geometry as G
from thalweg.functions import numeric as N
from thalweg.functions.rings import area as ring_area
from thalweg.functions.rings import polygons, stitch
from thalweg.operators import dissolve, network, raster, relocate, validate
from thalweg.plans import pipeline
from thalweg.sources import sinks, viewer

from pyspark.sql import functions as F

RIVER = "comid long, up1 long, up2 long, up3 long, up4 long"


def cells_of(pairs, o=1):
    return [(o, r, c) for r, c in pairs]


def rings_of(spark, pairs):
    df = spark.createDataFrame(cells_of(pairs), "o long, r long, c long")
    return dissolve.stitch_rings(dissolve.border_edges(raster.cell_edges(df, ["o"]), ["o"]), "o")


def test_settings():
    assert Settings().search_ladder()[-1] > 0.075 and len(Settings().search_ladder()) == 8
    for bad in (-0.1, 0.3):
        with pytest.raises(ValueError):
            Settings(search_dist=bad)
    with pytest.raises(TypeError):
        Settings(search_dist="0")


def test_closure_of_tree_diamond_and_cycle(spark):
    rivers = spark.createDataFrame([(1, 2, 3, 0, 0), (2, 4, 0, 0, 0), (3, 4, 9, 0, 0), (4, 0, 0, 0, 0), (5, 6, 0, 0, 0), (6, 5, 0, 0, 0), (7, 0, 0, None, 0)], RIVER)
    tables = network.jump_tables(network.drains(rivers))
    starts = spark.createDataFrame([("a", 1), ("b", 4), ("c", 5), ("d", 7), ("e", None)], "o string, comid long")
    got = sorted(tuple(r) for r in network.upstream(starts, "o", "comid", tables).collect())
    assert got == [("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 4, 0), ("c", 5, 0), ("c", 6, 1), ("d", 7, 0)]
    assert sorted(tuple(r) for r in network.network_faults(rivers).collect()) == [(4, "several ways down"), (9, "missing")]
    none = network.upstream(starts, "o", "comid", network.jump_tables(network.drains(rivers.where("false"))))
    assert none.count() == 4


def test_totals_above_every_reach(spark, small):
    from thalweg.plans import fixtures, survey_queries

    def walked(ups):
        out = {}
        for start in ups:
            seen, edge, depth = {start}, [start], 0
            while edge := [u for u in {u for e in edge for u in ups[e] if u in ups} - seen]:
                seen |= set(edge)
                depth += 1
            out[start] = (len(seen), depth)
        return out

    read = lambda rows: {r["comid"]: (r["n_upstream"], r["levels"]) for r in rows.collect()}
    comb = {r["comid"]: [u for u in r[1:] if u] for r in fixtures.comb(spark, small).select("comid", "up1", "up2", "up3", "up4").collect()}
    got = read(survey_queries.QUERIES["upstream_closure_deep"](spark, small))
    assert got == walked(comb) and [got[k][0] for k in (1, 6, 60)] == [40, 20, 3]
    diamond = spark.createDataFrame([(1, 2, 3, 0, 0), (2, 4, 0, 0, 0), (3, 4, 0, 0, 0), (4, 0, 0, 0, 0)], RIVER)
    ones = diamond.select("comid", F.lit(1).alias("n_upstream"))
    assert read(network.upstream_totals(ones, network.jump_tables(network.drains(diamond)), sums=("n_upstream",), levels="levels")) == {1: (4, 2), 2: (2, 1), 3: (2, 1), 4: (1, 0)}


@given(st.integers(2, 60), st.integers(0, 10_000))
@settings(max_examples=5, deadline=None)
def test_closure_of_random_forests(spark, n, seed):
    rng = random.Random(seed)
    below = {i: rng.randrange(1, i) for i in range(2, n + 1)}
    ups = {i: [k for k, v in below.items() if v == i] for i in range(1, n + 1)}
    if max(map(len, ups.values())) > 4:
        ups = {i: u[:4] for i, u in ups.items()}
    rivers = spark.createDataFrame([(i, *(u + [0] * 4)[:4]) for i, u in ups.items()], RIVER)

    def walk(i, d=0):
        return [(i, d)] + [x for u in ups[i] for x in walk(u, d + 1)]

    got = network.upstream(spark.createDataFrame([(1, 1)], "o long, comid long"), "o", "comid", network.jump_tables(network.drains(rivers)))
    assert sorted((r["comid"], r["depth"]) for r in got.collect()) == sorted(walk(1))


def test_dissolve_shell_hole_and_corner(spark):
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    got = {(r["part"], r["ring"]): abs(sum(a * d - b * c for a, b, c, d in zip(r["xs"], r["xs"][1:], r["ys"], r["ys"][1:]))) / 2 for r in rings_of(spark, ring).collect()}
    assert got == {(0, 0): 9.0, (0, 1): 1.0}
    corner = rings_of(spark, {(0, 0), (1, 1)}).collect()
    assert sorted((r["part"], r["ring"]) for r in corner) == [(0, 0), (1, 0)]
    blob = {(r, c) for r in range(12) for c in range(12) if random.Random(r * 31 + c).random() < 0.6}
    rows = rings_of(spark, blob).withColumn("a", G.shoelace(F.col("xs"), F.col("ys"))).collect()
    assert round(sum(r["a"] for r in rows)) == len(blob)
    assert all((r["a"] > 0) == (r["ring"] == 0) for r in rows)


def test_rings_that_touch_twice_never_cross():
    for seed in range(150):
        rng = random.Random(seed)
        blob = {(r, c) for r in range(7) for c in range(7) if rng.random() < 0.55}
        sides = {}
        for r, c in blob:
            for e in ((c, r, c + 1, r), (c + 1, r, c + 1, r + 1), (c, r + 1, c + 1, r + 1), (c, r, c, r + 1)):
                sides[e] = sides.get(e, 0) + 1
        border = [e for e, n in sides.items() if n == 1]
        rng.shuffle(border)
        rows = polygons(stitch(np.array(border, float)))
        assert round(sum(ring_area(c) for _, _, c in rows)) == len(blob), seed


def test_holes_and_largest_part(spark):
    r = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.5), (1, 2, 0.2), (2, 0, 1.0), (2, 1, 1.0)], "p long, ring long, a double")
    keep = lambda t: sorted((x["p"], x["ring"]) for x in dissolve.fill_holes(r, F.col("a"), t).collect())
    assert keep(0.5) == [(1, 0), (2, 0), (2, 1)] and keep(0.0) == [(1, 0), (2, 0)] and keep(0.1) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]
    best = dissolve.largest_part(r.where("p = 2"), "p", F.col("a"), "ring").collect()
    assert [x["ring"] for x in best] == [0]


def test_simplify_never_below_a_triangle():
    a = np.linspace(0, 2 * np.pi, 200)
    x, y = dissolve.douglas_peucker(np.cos(a), np.sin(a), 0.01)
    assert 8 < len(x) < 60 and (x[0], y[0]) == (1, 0)
    x, y = dissolve.douglas_peucker(np.cos(a), np.sin(a), 5)
    assert len(x) == 4


def test_areas_and_distances(spark):
    n = 361
    top = [(-180.0 + i, 90.0) for i in range(n)]
    ring = [(-180.0, -90.0), (180.0, -90.0), *top[::-1], (-180.0, -90.0)]
    rows = [([p[0] for p in ring], [p[1] for p in ring]), ([0.0, 1.0, 1.0, 0.0, 0.0], [64.0, 64.0, 65.0, 65.0, 64.0]), ([], []), (None, None)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    globe, degree, empty, null = [r[0] for r in df.select(G.equal_area_km2(F.col("x"), F.col("y"))).collect()]
    assert abs(globe - 510_065_621.7) < 1 and abs(degree - 5357.4) < 0.1 and empty == 0 and not null
    assert abs(G.vincenty_m([50.0663], [-5.7148], [58.6440], [-3.0701])[0] - 969_954.1) < 1
    assert G.vincenty_m([1.0], [2.0], [1.0], [2.0])[0] == 0 and math.isnan(G.vincenty_m([float("nan")], [0], [0], [0])[0])


def test_numbers(spark):
    df = spark.createDataFrame([(0.0, 2.0), (0.00123, None), (98765.0, 0.0), (-1234.0, 4.0)], "x double, y double")
    got = df.select(N.significant(F.col("x"), 2), N.relative_difference(F.col("x"), F.col("y")), N.display(F.col("x"), 0)).collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 0.0012, 99000.0, -1200.0])
    assert [r[1] for r in got] == [1.0, None, None, 309.5] and got[2][2] == "98,765"


def test_validation(spark):
    good = spark.createDataFrame([("a", 1.0, 2.0)], "id string, lat double, lng double")
    validate.validate(good)
    for rows, word in ((good.union(good), "unique"), (spark.createDataFrame([("a", None, 2.0)], good.schema), "numbers"), (spark.createDataFrame([("a", 85.0, 2.0)], good.schema), "lat"), (spark.createDataFrame([("a", 1.0, 180.0)], good.schema), "lng"), (spark.createDataFrame([(" ", 1.0, 2.0)], good.schema), "empty")):
        with pytest.raises(validate.InvalidOutlets, match=word):
            validate.validate(rows)
    with pytest.raises(validate.InvalidOutlets, match="lat"):
        validate.check_columns(good.drop("lat"))
    basins = spark.createDataFrame([(11,), (12,)], "basin int")
    validate.check_megabasins(basins)
    with pytest.raises(validate.InvalidOutlets, match="11"):
        validate.check_megabasins(basins.where("basin = 12"))
    shaped = validate.shape_outlets(good)
    assert shaped.columns == ["id", "lat", "lng", "area_reported", "name", "area_calc", "result"] and shaped.first()["result"] == "failed"


def test_relocation_thresholds(spark):
    settings_ = Settings(match_areas=True)
    o = spark.createDataFrame([("eq", 100.0, 125.0), ("null", None, 5.0), ("far", 100.0, 126.0)], "id string, area double, uparea double")
    assert {r["id"]: r["accepted"] for r in relocate.accept_terminal(o, settings_).collect()} == {"eq": True, "null": True, "far": False}
    outlets = spark.createDataFrame([("a", 0.0, 0.0, 100.0), ("b", 0.0, 0.0, 200.0), ("c", 5.0, 5.0, 100.0)], "id string, lat double, lng double, area double")
    rivers = spark.createDataFrame([(1, 125.0, [0.005, 0.005], [-1.0, 1.0]), (2, 110.5, [0.015, 0.015], [-1.0, 1.0]), (3, 101.0, [0.016, 0.016], [0.0, 1.0]), (4, 100.0, [0.085, 0.085], [-1.0, 1.0])], "comid long, uparea double, line_lng array<double>, line_lat array<double>")
    got = {r["id"]: (r["comid"], r["ring"], r["uparea"]) for r in relocate.search_reaches(outlets, rivers, settings_).collect()}
    assert got == {"a": (3, 2, 101.0)}  # reach 1 is off by exactly the threshold, and 4 lies beyond the last box


def test_run_on_two_squares(spark, tmp_path):
    sq = lambda x: ([x, x + 1.0, x + 1.0, x, x], [0.0, 0.0, 1.0, 1.0, 0.0])
    mega = spark.createDataFrame([(11, *sq(0.0)), (12, *sq(1.0))], "basin int, ring_lng array<double>, ring_lat array<double>")
    cats = spark.createDataFrame([(1, 11, [0.0, 0.5, 0.5, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0, 0.0]), (2, 12, *sq(1.0))], "comid long, basin int, ring_lng array<double>, ring_lat array<double>")
    reach = spark.createDataFrame([(1, 2, 0, 0, 0, 50.0, [0.2, 0.3], [0.2, 0.3]), (2, 0, 0, 0, 0, 9.0, [1.2, 1.3], [0.2, 0.3])], RIVER + ", uparea double, line_lng array<double>, line_lat array<double>")
    outlets = spark.createDataFrame([("in", 0.25, 0.25, "A, \"b\"", 100.0), ("gap", 0.25, 0.75, "B", None), ("sea", 9.0, 9.0, None, 0.0), ("none", None, None, None, None)], "id string, lat double, lng double, name string, area double")
    inputs = pipeline.Inputs(outlets, mega, cats, reach)
    run = pipeline.run_batch(inputs, Settings(high_res=False))
    failed = {r["id"]: r["explanation"] for r in run.failed.collect()}
    assert failed == {"gap": pipeline.NO_CATCHMENT, "sea": pipeline.NO_BASIN, "none": pipeline.NO_BASIN}
    table = pipeline.summary(run, inputs, Settings(high_res=False), with_distance=True).cache()
    rows = {r["id"]: r for r in table.collect()}
    assert set(rows) == {"in", *failed} and rows["in"]["n_catchments"] == 2 and rows["in"]["area_calc"] == 18500.0
    assert rows["in"]["result"] == "low res" and rows["sea"]["area_calc"] == 0.0 and rows["sea"]["perc_diff"] is None and 7000 < rows["in"]["snap_dist"] < 8500
    sinks.write_summary(table, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 4
    assert sinks.write_failures(run.failed, str(tmp_path / "f")) and not sinks.write_failures(run.failed.where("false"), str(tmp_path / "g"))
    viewer.write_viewer(viewer.viewer_table(table), str(tmp_path / "v.html"))
    assert "18,500" in (tmp_path / "v.html").read_text() and "A, &quot;b&quot;" in (tmp_path / "v.html").read_text()


def test_run_fills_holes_and_simplifies(spark):
    def world(step):  # eight squares round a hole that no catchment covers, with a kink on the southern border
        x = [20.0, 20.5, 20.5 + step, 21.0 + step]
        y = [40.0, 40.5, 40.5 + step, 41.0 + step]
        box = lambda r, c: ([x[c], x[c + 1], x[c + 1], x[c], x[c]], [y[r], y[r], y[r + 1], y[r + 1], y[r]])
        at = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
        shapes = [(k + 1, 11, *box(r, c)) for k, (r, c) in enumerate(at)]
        xs, ys = shapes[0][2:]
        shapes[0] = (1, 11, [xs[0], 20.2, *xs[1:]], [ys[0], 39.9995, *ys[1:]])
        shapes[1] = (2, 11, [shapes[1][2][0] + 4e-6, *shapes[1][2][1:4], shapes[1][2][4] + 4e-6], shapes[1][3])  # a sliver
        shape = "comid long, basin int, ring_lng array<double>, ring_lat array<double>"
        mega = spark.createDataFrame([(11, [19.0, 23.0, 23.0, 19.0, 19.0], [39.0, 39.0, 43.0, 43.0, 39.0])], "basin int, ring_lng array<double>, ring_lat array<double>")
        reach = spark.createDataFrame([(k, k + 1 if k < 8 else 0, 0, 0, 0, 50.0, [20.1], [40.1]) for k in range(1, 9)], RIVER + ", uparea double, line_lng array<double>, line_lat array<double>")
        outlets = spark.createDataFrame([("a", 40.1, 20.1)], "id string, lat double, lng double")
        return pipeline.Inputs(outlets, mega, spark.createDataFrame(shapes, shape), reach)

    low = lambda **k: Settings(high_res=False, **k)
    worlds = {w: world(w) for w in (0.008, 0.009, 0.3)}
    runs = {w: pipeline.run_batch(i, low()) for w, i in worlds.items()}

    def rings(w, s):
        return {(r["part"], r["ring"]): len(r["xs"]) - 1 for r in pipeline.boundaries(runs[w], worlds[w], s).collect()}

    # holes of 6.4e-5 and 8.1e-5 square degrees; the limit is 6.95e-5
    assert rings(0.008, low(fill=False)) == {(0, 0): 13, (0, 1): 4} and rings(0.008, low()) == {(0, 0): 13}
    assert set(rings(0.009, low())) == {(0, 0), (0, 1)} and set(rings(0.009, low(fill_threshold=0))) == {(0, 0)}
    assert 4 <= rings(0.008, low(simplify=True))[0, 0] <= 6  # where a ring starts stays
    area = lambda s: pipeline.summary(runs[0.3], worlds[0.3], s).first()["area_calc"]
    assert area(low(fill_threshold=200_000)) > area(low()) > 0  # a large hole under a higher limit shows in three digits


def test_every_cell_is_traced(spark, monkeypatch):
    from thalweg.plans import fixtures, survey_queries

    rng = random.Random(3)
    flow = {(r, c): 0 if (r, c) == (5, 5) else 4 if c == 5 or (r < 5 and rng.random() < 0.5) else 1 for r in range(6) for c in range(6)}
    cells = spark.createDataFrame([(64 * r + c, r, c, f) for (r, c), f in flow.items()], "k long, r long, c long, fdir int")
    monkeypatch.setattr(fixtures, "cells", lambda *_: cells)
    want = set()
    for r, c in flow:
        at, depth = (r, c), 0
        while True:
            want.add((64 * at[0] + at[1], 64 * r + c, depth))
            if not flow[at]:
                break
            at, depth = (at[0] + (flow[at] == 4), at[1] + (flow[at] == 1)), depth + 1
    run = lambda n: survey_queries.QUERIES[n](spark, "").collect()
    assert sorted(map(tuple, run("d8_upstream"))) == sorted(want)
    size = {o: sum(a == o for a, _, _ in want) for o in (64 * r + c for r, c in flow)}
    assert {r["o"]: r["area"] for r in run("split_terminal")} == size  # each part hangs together by edges
    area = dict.fromkeys(size, 0)
    for o in area:  # a vertical side has the traced cells to one side: sweep each row
        mine = {k for a, k, _ in want if a == o}
        area[o] = {(c + e, r) for r in range(6) for c in range(6) for e in (0, 1) if (64 * r + c in mine) != (0 <= c + 2 * e - 1 < 6 and 64 * r + c + 2 * e - 1 in mine)}
    got = {o: set() for o in area}
    for r in run("polygonize_cells"):
        if r["x1"] == r["x2"]:
            got[r["o"]].add((r["x1"], r["y1"]))
    assert got == area


def test_geojson(spark, tmp_path):
    ring = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    features = sinks.geojson_features(rings_of(spark, ring).withColumn("o", F.col("o").cast("string")), "o")
    doc = json.loads(features.first()["geojson"])
    assert doc["geometry"]["type"] == "MultiPolygon" and [len(p) for p in doc["geometry"]["coordinates"]] == [2] and doc["properties"] == {"o": "1"}
    viewer.write_layers(features.withColumnRenamed("o", "id"), str(tmp_path / "map"))
    assert (tmp_path / "map" / "1.js").read_text().startswith("basin = {")


def test_raster_rules(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 1, 4), (2, 1, 0, 128), (3, 1, 1, 0)], "k long, r long, c long, fdir int")
    acc = {r["k"]: r["acc"] for r in raster.accumulate(cells).collect()}
    assert acc == {0: 1, 1: 3, 2: 1, 3: 4}
    table = cells.join(raster.accumulate(cells), "k")
    s = raster.streams(table, F.lit(1), Settings(threshold_single=3))
    assert [r["k"] for r in s.collect()] == [3]  # the threshold itself is no stream
    points = spark.createDataFrame([("a", 0, 0, 0), ("b", 0, 0, 9)], "id string, pr int, pc int, tile int")
    tie = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "r int, c int, tile int")
    assert [tuple(r) for r in raster.snap_points(points, tie, ["tile"]).collect()] == [("a", 0, 1)]


@given(st.lists(st.lists(st.lists(st.tuples(st.floats(-180, 180), st.floats(-90, 90)), min_size=4, max_size=6), min_size=1, max_size=3), min_size=1, max_size=3))
@settings(max_examples=50, deadline=None)
def test_wkb_round_trip(shapes):
    from thalweg.functions import wkb

    parts = [[(tuple(p[0] for p in ring), tuple(p[1] for p in ring)) for ring in part] for part in shapes]
    flat = lambda ps: [[(list(a), list(b)) for a, b in p] for p in ps]
    assert wkb.decode(wkb.encode(wkb.MULTI_POLYGON, parts)) == (wkb.MULTI_POLYGON, flat(parts))
    assert wkb.decode(wkb.encode(wkb.POLYGON, parts[:1])) == (wkb.POLYGON, flat(parts[:1]))
    assert wkb.decode(wkb.encode(wkb.LINE, [[parts[0][0]]])) == (wkb.LINE, flat([[parts[0][0]]]))
    assert wkb.decode(wkb.encode(wkb.POINT, [[((1.5,), (2.5,))]])) == (wkb.POINT, [[([1.5], [2.5])]])
    with pytest.raises(ValueError):
        wkb.encode(7, parts)


def test_terminal_is_split_or_fails(spark):
    from thalweg.plans import high_resolution as H

    acc = {(r, c): 600 if c == 2 else 1 for r in range(6) for c in range(6)}
    rows = [(1, 1000 + r, 2000 + c, 4 if c == 2 and r < 5 else 1 if c < 2 else 16 if c > 2 else 4, acc[r, c]) for r, c in acc]
    cells = spark.createDataFrame(rows, "basin int, r long, c long, fdir int, acc long")
    x, y = (lambda c: H.WEST + (2000 + c) / 1200), (lambda r: H.NORTH - (1000 + r) / 1200)
    ring = [x(0), x(6), x(6), x(0), x(0)], [y(6), y(6), y(0), y(0), y(6)]
    far = [x(100), x(101), x(101), x(100), x(100)], [y(1), y(1), y(0), y(0), y(1)]
    cats = spark.createDataFrame([(1, *ring), (2, *far)], "comid long, ring_lng array<double>, ring_lat array<double>")
    outlets = spark.createDataFrame([("a", x(4), y(3), 1, 1), ("b", x(4), y(3), 1, 2), ("c", x(100), y(0), 2, 1)], "id string, lng double, lat double, comid long, n_catchments int")
    split = H.split_terminals(outlets, cats, cells, Settings())
    got = split.terminals.collect()
    assert [(r["id"], r["n_cells"]) for r in got] == [("a", 24)]  # rows 0..3 above the snapped cell in row 3
    assert {r["id"] for r in split.failed.collect()} == {"b", "c"}
    assert abs(got[0]["lng_snap"] - x(2) - 0.000416667) < 1e-9 and abs(got[0]["lat_snap"] - y(3) + 0.000416667) < 1e-9
    members = spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "id string, comid long, depth int")
    km2 = {r["id"]: r["km2"] for r in H.split_area(members, cats, split).collect()}
    assert set(km2) == {"a"} and km2["a"] > 0


def test_run_in_high_resolution(spark):
    from thalweg.plans import high_resolution as H

    x, y = (lambda c: H.WEST + (2000 + c) / 1200), (lambda r: H.NORTH - (1000 + r) / 1200)
    rows = [(1, 1000 + r, 2000 + c, 4 if c == 2 else 1 if c < 2 else 16, 600 * (r + 1) if c == 2 and r > 1 else 1) for r in range(6) for c in range(12)]
    cells = spark.createDataFrame(rows, "basin int, r long, c long, fdir int, acc long")
    box = lambda a, b: ([x(a), x(b), x(b), x(a), x(a)], [y(6), y(6), y(0), y(0), y(6)])
    mega = spark.createDataFrame([(11, *box(0, 12))], "basin int, ring_lng array<double>, ring_lat array<double>")
    cats = spark.createDataFrame([(1, 11, *box(0, 6)), (2, 11, *box(6, 12))], "comid long, basin int, ring_lng array<double>, ring_lat array<double>")
    reach = spark.createDataFrame([(1, 0, 0, 0, 0, 50.0, [x(1)], [y(1)]), (2, 0, 0, 0, 0, 90_000.0, [x(7)], [y(1)])], RIVER + ", uparea double, line_lng array<double>, line_lat array<double>")
    outlets = spark.createDataFrame([("fine", y(3.1), x(3.1)), ("coarse", y(3.1), x(8.1))], "id string, lat double, lng double")
    inputs, settings_ = pipeline.Inputs(outlets, mega, cats, reach), Settings()
    run, split = pipeline.refine(pipeline.run_batch(inputs, settings_), inputs, cells, settings_)
    got = {r["id"]: r for r in pipeline.summary(run, inputs, settings_, split=split).collect()}
    whole = {r["id"]: r for r in pipeline.summary(run, inputs, settings_).collect()}
    assert (got["fine"]["result"], got["coarse"]["result"]) == ("high res", "low res")
    assert 0 < got["fine"]["area_calc"] < whole["fine"]["area_calc"] and got["coarse"]["area_calc"] == whole["coarse"]["area_calc"]
    assert abs(got["fine"]["lng_snap"] - x(2.5)) < 1e-3 and run.failed.count() == 0
    bare = cells.withColumn("acc", F.lit(1))
    run, split = pipeline.refine(pipeline.run_batch(inputs, settings_), inputs, bare, settings_)
    got = {r["id"]: r for r in pipeline.summary(run, inputs, settings_, split=split).collect()}
    assert got["fine"]["result"] == "failed" and {r["id"] for r in run.failed.collect()} == {"fine"}

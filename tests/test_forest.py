"""Flow traced block by block, against the network and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg.functions.forest import SIDES, Forest
from thalweg.functions.rings import area, polygons, stitch
from thalweg.operators import dissolve, network, raster

CODES = list(raster.STEPS)


def flows(rng, places, codes=(*CODES, 0)):
    return {p: rng.choice(codes) for p in places}


def above(flow):
    """What drains to each cell, by walking down from every cell."""
    found = {p: {p} for p in flow}
    for p in flow:
        at, seen = p, set()
        while flow[at] and at not in seen:
            seen.add(at)
            to = (at[0] + raster.STEPS[flow[at]][0], at[1] + raster.STEPS[flow[at]][1])
            if to not in flow:
                break
            found[to].add(p)
            at = to
    return found


def loops(flow):
    bad = set()
    for p in flow:
        at, seen = p, []
        while at in flow and at not in seen:
            seen.append(at)
            at = (at[0] + raster.STEPS[flow[at]][0], at[1] + raster.STEPS[flow[at]][1]) if flow[at] else None
        bad |= {p} if at in flow else set()
    return bad


def border(cells):
    return {(c + x1, r + y1, c + x2, r + y2) for r, c in cells for dr, dc, (x1, y1, x2, y2) in SIDES if (r + dr, c + dc) not in cells}


def shell(cells):
    rings = [ring for _, k, ring in polygons(stitch(np.array(sorted(border(cells)), float))) if k == 0]
    return max((abs(area(r)), len(r) - 1) for r in rings)


@pytest.mark.parametrize("seed", range(60))
def test_borders_and_shapes_of_a_block(seed):
    rng = random.Random(seed)
    h, w = rng.randint(1, 9), rng.randint(1, 9)
    places = [(r + 40, c - 24) for r in range(h) for c in range(w) if rng.random() < 0.9]  # the block's last columns are left out
    rng.shuffle(places)
    east = [1, 2, 128, 4, 64] if seed % 2 else CODES  # half of them without many loops, so that rivers are long
    flow = flows(rng, places, (*east, 0))
    r, c = np.array([p[0] for p in places], np.int64), np.array([p[1] for p in places], np.int64)
    step = np.array([raster.STEPS.get(flow[p], (0, 0)) for p in places], np.int64).reshape(-1, 2)
    f = Forest(r, c, step[:, 0], step[:, 1], (r[:1], c[:1]) if seed % 3 else (r[:0], c[:0]), (40, -24), 16)
    want, bad = above(flow), loops(flow)
    enters = places[:1] if seed % 3 else []
    whole = {p for p in places if p not in bad and not want[p] & set(enters)}
    assert {p for p, ok in zip(places, f.whole) if ok} == whole
    got = {p: [] for p in whole}
    for at, cell, side in f.borders():
        for o, k, s in zip(at, cell, side):
            x1, y1, x2, y2 = SIDES[s][2]
            got[places[o]].append((c[k] + x1, r[k] + y1, c[k] + x2, r[k] + y2))
    assert all(len(v) == len(set(v)) for v in got.values()) and {p: set(v) for p, v in got.items()} == {p: border(want[p]) for p in whole}
    size, sides, plain = f.shapes()
    for i, p in enumerate(places):
        if p in whole:
            assert (size[i], sides[i]) == (len(want[p]), len(border(want[p])))
            assert shell(want[p]) == (abs(area(f.shell(i))), len(f.shell(i)) - 1)
            assert plain[i] == (shell(want[p]) == (size[i], sides[i]))


def raster_of(spark, rng, extra=()):
    """Cells where four blocks meet, with long rivers over their borders, a loop and (extra) cells that occur twice."""
    b = raster.BLOCK
    flow = {}
    for r in range(b - 6, b + 6):
        for c in range(b - 6, b + 6):
            flow[r, c] = rng.choice([1, 1, 2, 4, 4, 8, 128]) if rng.random() < 0.9 else 0
    flow[b - 6, b + 5], flow[b - 5, b + 5] = 4, 64
    rows = [(i, r, c, f) for i, ((r, c), f) in enumerate(flow.items())]
    rows += [(1000 + i, *rows[k][1:]) for i, k in enumerate(extra)]
    return spark.createDataFrame(rows, "k long, r long, c long, fdir int")


@pytest.mark.parametrize("extra", [(), (5, 140)])
def test_blocks_agree_with_the_network(spark, extra):
    cells = raster_of(spark, random.Random(len(extra)), extra)
    up = network.upstream(cells.select(F.col("k").alias("o"), "k"), "o", "k", network.jump_tables(raster.cell_drains(cells)), "k").cache()
    acc = {r["o"]: r["n"] for r in up.groupBy("o").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["k"]: r["acc"] for r in raster.accumulate(cells).collect()} == acc
    open_ = raster._open_outlets(cells, "k").count()
    assert 0 < open_ < len(acc)
    border = dissolve.border_edges(raster.cell_edges(up.join(cells, "k").select("o", "r", "c"), ["o"]), ["o"]).cache()
    assert sorted(map(tuple, raster.upstream_borders(cells).collect())) == sorted(map(tuple, border.collect()))
    rings = {}
    for r in dissolve.stitch_rings(border, "o").where("ring = 0").collect():
        ring = np.stack([r["xs"], r["ys"]], axis=1)
        rings.setdefault(r["o"], []).append((-abs(area(ring)), r["part"], len(ring) - 1))
    assert {r["o"]: (-r["area"], r["n_corners"]) for r in raster.upstream_shells(cells).collect()} == {o: min(v)[::2] for o, v in rings.items()}


def test_cells_without_place_or_key(spark):
    rows = [(1, 0, 0, 1), (2, 0, 1, 0), (3, None, 1, 1), (None, 1, 0, 128)]
    cells = spark.createDataFrame(rows, "k long, r long, c long, fdir int")
    assert {r["k"]: r["acc"] for r in raster.accumulate(cells).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["o"]: (r["area"], r["n_corners"]) for r in raster.upstream_shells(cells).collect()} == {1: (1.0, 4), 2: (2.0, 6)}


def winding(spark, n):
    """One river through all of n x n cells, row by row to and fro."""
    rows = [(n * r + c, r, c, 0 if (r, c) == (n - 1, 0 if n % 2 == 0 else n - 1) else 4 if c == (0 if r % 2 else n - 1) else 16 if r % 2 else 1) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "k long, r long, c long, fdir int")


def test_shells_list_no_pairs(spark, monkeypatch):
    """14,400 cells one below the other: the pairs would be a hundred million."""
    from thalweg.plans import fixtures, survey_queries

    monkeypatch.setattr(fixtures, "cells", lambda *_: winding(spark, 120))
    got = survey_queries.QUERIES["split_terminal"](spark, "")
    assert "Join" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    rows = got.collect()
    assert sorted(r["area"] for r in rows) == list(range(1, 14_401))
    assert all(r["n_corners"] == 2 * (-(-r["area"] // 120) + min(r["area"], 120)) for r in rows)


def test_borders_list_no_pairs(spark, monkeypatch):
    """Borders of nested watersheds come from cells; neither pairs nor edges are exchanged or joined."""
    from thalweg.plans import fixtures, survey_queries

    monkeypatch.setattr(fixtures, "cells", lambda *_: winding(spark, 12))
    got = survey_queries.QUERIES["polygonize_cells"](spark, "")
    assert "Join" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan
    n = {r["o"]: r["count"] for r in got.groupBy("o").count().collect()}
    assert sorted(n.values()) == sorted(2 * (-(-a // 12) + min(a, 12)) for a in range(1, 145))


def test_pour_points_are_the_nearest(spark):
    """Streams far from some outlets, with ties, two limits, and catchments without a stream."""
    from thalweg.config import Settings
    from thalweg.plans import high_resolution as H

    rng = random.Random(8)
    cells = {(k, rng.randrange(300), rng.randrange(300)): rng.choice([10, 60, 600]) for k in (1, 2) for _ in range(25)}
    cells |= {(2, 200 + r, 7): 60 for r in range(20)} | {(3, 5, 5): 50, (4, 0, 250): 600}
    mask = spark.createDataFrame([(k, r, c, 0, a) for (k, r, c), a in cells.items()], "comid long, r long, c long, fdir int, acc long")
    points = [(f"{k}-{i}", k, rng.randrange(300), rng.randrange(300), 1 + i % 2) for k in (1, 2, 3, 4, 5) for i in range(12)]
    rows = [(i, H.WEST + c / 1200, H.NORTH - r / 1200, k, n) for i, k, r, c, n in points] + [("nowhere", None, None, 1, 1)]
    outlets = spark.createDataFrame(rows, "id string, lng double, lat double, comid long, n_catchments int")
    want = {}
    for i, k, r, c, n in points:
        near = [((y - r) ** 2 + (x - c) ** 2, y, x) for (at, y, x), a in cells.items() if at == k and a > (50 if n == 1 else 500)]
        want |= {i: (k, *min(near)[1:])} if near else {}
    got = H.pour_points(outlets, mask, Settings(threshold_single=50, threshold_multiple=500)).collect()
    assert {r["id"]: (r["comid"], r["r"], r["c"]) for r in got} == want and len(got) == len(want)


def test_split_across_blocks(spark):
    """A catchment wider than a block: one outlet's cells lie in one, another's in two."""
    from thalweg.config import Settings
    from thalweg.plans import high_resolution as H

    wide = raster.BLOCK + 4
    rows = [(1, 1000 + r, 2000 + c, 64 if r else 1, 2 * c + 2 if r == 0 else 1) for r in range(2) for c in range(wide)]
    cells = spark.createDataFrame(rows, "basin int, r long, c long, fdir int, acc long")
    x, y = (lambda c: H.WEST + (2000 + c) / 1200), (lambda r: H.NORTH - (1000 + r) / 1200)
    cats = spark.createDataFrame([(1, [x(0), x(wide), x(wide), x(0), x(0)], [y(2), y(2), y(0), y(0), y(2)])], "comid long, ring_lng array<double>, ring_lat array<double>")
    ends = {"near": 9, "far": raster.BLOCK + 2}
    outlets = spark.createDataFrame([(i, x(c), y(0), 1, 1) for i, c in ends.items()], "id string, lng double, lat double, comid long, n_catchments int")
    split = H.split_terminals(outlets, cats, cells, Settings(threshold_single=1))
    got = {r["id"]: r for r in split.terminals.collect()}
    for i, c in ends.items():
        assert got[i]["n_cells"] == 2 * c + 2
        assert (round(max(got[i]["xs"]) - x(c + 1), 9), round(min(got[i]["xs"]) - x(0), 9)) == (0, 0)
        assert (round(max(got[i]["ys"]) - y(0), 9), round(min(got[i]["ys"]) - y(2), 9)) == (0, 0)
    kept = sorted((r["id"], r["r"], r["c"]) for r in split.cells.collect())
    assert kept == sorted((i, 1000 + r, 2000 + k) for i, c in ends.items() for r in range(2) for k in range(c + 1))

import math
import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.functions.triangles import clean_ring, triangulate, triangulate_many
from thalweg.operators import proximity as P
from thalweg.operators import regions as R

REGION = "comid long, ring_lng array<double>, ring_lat array<double>, rec_no string, level string"
POINT = "rec_no long, id string, lat double, lng double, comid string, cx string"


def star(rng, n, x0, y0, size):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [(x0 + size * rng.uniform(0.3, 1) * math.cos(a), y0 + size * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]
    return [*pts, pts[0]]


def inside(ring, px, py):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=12, unique=True), st.integers(0, 1000))
@settings(max_examples=400, deadline=None)
def test_triangles_hold_what_the_ring_holds(pts, seed):
    ring = [*pts, pts[0]]
    triangles = triangulate(*zip(*ring))
    rng = random.Random(seed)
    for _ in range(20):
        px, py = rng.uniform(-1, 21), rng.uniform(-1, 21)
        hit = False
        for x1, y1, x2, y2, x3, y3, _ in triangles:
            s = [(x2 - x1) * (py - y1) - (y2 - y1) * (px - x1), (x3 - x2) * (py - y2) - (y3 - y2) * (px - x2), (x1 - x3) * (py - y3) - (y1 - y3) * (px - x3)]
            hit = hit or min(s) >= 0 or max(s) <= 0
        assert hit == inside(ring, px, py)


def areas(t):
    return np.abs((t[:, 2] - t[:, 0]) * (t[:, 5] - t[:, 1]) - (t[:, 3] - t[:, 1]) * (t[:, 4] - t[:, 0])).sum() / 2


def test_rings_that_cross_themselves_and_each_other_by_the_even_odd_rule():
    rng = random.Random(5)
    for _ in range(40):
        rings = [[(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(3, 40))] for _ in range(rng.randrange(1, 4))]
        _, t, _ = triangulate_many([[clean_ring(*np.array(r, float).T) for r in rings]])
        for _ in range(30):
            px, py = rng.uniform(-1, 31), rng.uniform(-1, 31)
            s = [(t[:, c] - t[:, a]) * (py - t[:, b]) - (t[:, d] - t[:, b]) * (px - t[:, a]) for a, b, c, d in ((0, 1, 2, 3), (2, 3, 4, 5), (4, 5, 0, 1))]
            hit = ((np.min(s, axis=0) >= 0) | (np.max(s, axis=0) <= 0)).any()
            assert hit == (sum(inside([*r, r[0]], px, py) for r in rings) % 2 == 1)


def test_a_ring_of_100_000_corners_with_holes_takes_seconds():
    a = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    r = 1 + 0.3 * np.sin(17 * a) + 0.001 * np.sin(9000 * a)
    shell = np.column_stack([r * np.cos(a), r * np.sin(a)])
    h = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    holes = [np.column_stack([0.5 * np.cos(k) + 0.02 * np.cos(h), 0.5 * np.sin(k) + 0.02 * np.sin(h)]) for k in range(6)]
    began = time.perf_counter()
    _, t, _ = triangulate_many([[shell, *holes]])
    assert time.perf_counter() - began < 60
    ring = lambda p: abs((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()) / 2
    assert abs(areas(t) - ring(shell) + sum(map(ring, holes))) < 1e-9


def test_large_rings_and_rings_without_area():
    a = np.linspace(0, 2 * np.pi, 301)
    r = np.where(np.arange(301) % 2, 1.0, 0.4)
    r[-1] = r[0]
    x, y = r * np.cos(a), r * np.sin(a)
    x[-1], y[-1] = x[0], y[0]
    t = triangulate(x, y)
    assert len(t) >= 298 and abs(areas(np.array(t)) - abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2) < 1e-9
    assert triangulate([0, 1, 0], [0, 1, 0]) == [] and triangulate([], []) == [] and triangulate([0, 1, 2, 0], [0, 1, 2, 0]) == []


def test_regions_with_holes_and_parts_and_a_key_to_agree_in(spark):
    square = lambda x, y, s: ([x, x + s, x + s, x, x], [y, y, y + s, y + s, y])
    shapes = {1: [square(0.0, 0.0, 4.0), square(1.0, 1.0, 1.0)], 2: [square(1.0, 1.0, 1.0), square(10.0, 0.0, 1.0)], 3: [square(0.0, 0.0, 40.0)]}
    rows = [(k, "a" if k < 3 else "b", [x for x, _ in r], [y for _, y in r]) for k, r in shapes.items()]
    regions = spark.createDataFrame([*rows, (4, "a", None, None), (5, "a", [None, [0.0]], [None, [0.0, 1.0]])], "comid long, basin string, xs array<array<double>>, ys array<array<double>>")
    points = spark.createDataFrame([(1, "a", 0.5, 0.5), (2, "a", 1.5, 1.5), (3, "a", 10.5, 0.5), (4, "b", 1.5, 1.5), (5, "b", 10.5, 30.0), (6, "a", 2.0, 1.5)], "rec_no long, basin string, lng double, lat double")
    got = sorted(tuple(r) for r in P.containing_regions(points, "rec_no", "lng", "lat", regions, "comid", "xs", "ys", within="basin").collect())
    assert got == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 1)]
    near = spark.createDataFrame([(7, "a", 4.2, 1.0), (8, "b", 40.2, 1.0), (9, "a", 40.2, 1.0)], points.schema)
    found = R.locate(near, "rec_no", "lng", "lat", regions, "comid", "xs", "ys", 0.5, within="basin")
    assert sorted((r["rec_no"], r["comid"]) for r in found.collect()) == [(7, 1), (8, 3)]


def test_regions_against_brute_force(spark):
    rng = random.Random(3)
    rings = {i: star(rng, rng.randrange(3, 30), rng.uniform(-5, 5), rng.uniform(-5, 5), 10 ** rng.uniform(-2, 1)) for i in range(60)}
    pts = [(i, rng.uniform(-6, 6), rng.uniform(-6, 6)) for i in range(800)]
    pts += [(1000 + i, *(np.array(rings[i][0]) * 0.3 + np.array(rings[i][1]) * 0.3 + np.array(rings[i][2]) * 0.4)) for i in range(60)]
    regions = spark.createDataFrame([(i, [p[0] for p in r], [p[1] for p in r], "x", "y") for i, r in rings.items()], REGION)
    points = spark.createDataFrame([(i, "a", float(y), float(x), "c", "d") for i, x, y in pts], POINT)
    got = {tuple(r) for r in P.containing_regions(points, "rec_no", "lng", "lat", regions.union(regions), "comid", "ring_lng", "ring_lat").collect()}
    assert got == {(i, k) for i, x, y in pts for k, r in rings.items() if inside(r, x, y)}


def test_borders_nulls_and_empty_tables(spark):
    square = lambda i, x: (i, [x, x + 1.0, x + 1.0, x, x], [0.0, 0.0, 1.0, 1.0, 0.0], "x", "y")
    regions = spark.createDataFrame([square(2, 1.0), square(1, 0.0), (3, None, None, "x", "y"), (None, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 0.0], None, None), (4, [], [], "", ""), (5, [1.0], [1.0, 2.0], "", "")], REGION)
    rows = [(1, "a", 0.5, 1.0, "", ""), (2, "a", 0.5, 0.5, "", ""), (3, "a", 0.0, 2.0, "", ""), (4, "a", None, 1.0, "", ""), (None, "a", 0.5, 0.5, "", ""), (6, "a", float("nan"), 0.5, "", ""), (7, "a", 5.0, 5.0, "", ""), (8, "a", 0.25, 0.25, "", ""), (9, "a", 0.75, 0.25, "", "")]
    points = spark.createDataFrame(rows + rows, POINT)
    find = lambda p, r: sorted(tuple(x) for x in P.containing_regions(p, "rec_no", "lng", "lat", r, "comid", "ring_lng", "ring_lat").collect())
    assert find(points, regions) == [(1, 1), (2, 1), (3, 2), (8, 1), (9, 1)]
    assert find(points.where("false"), regions) == [] and find(points, regions.where("false")) == []


def test_coordinates_beyond_all_bounds(spark):
    inf = float("inf")
    rings = [(1, [0.0, 1.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 1.0, 0.0]), (2, [2.0, 1e300, 1e300, 2.0, 2.0], [0.0, 0.0, 1.0, 1.0, 0.0]), (3, [0.0, inf, 3.0, 0.0], [5.0, 5.0, -inf, 5.0]), (4, [inf] * 4, [inf] * 4)]
    regions = spark.createDataFrame([(*r, "", "") for r in rings], REGION)
    points = spark.createDataFrame([(1, "", 0.5, 0.5, "", ""), (2, "", 0.5, 400.0, "", ""), (3, "", inf, 0.5, "", ""), (4, "", 0.5, 1.2, "", ""), (5, "", 9e9, 9e9, "", "")], POINT)
    got = sorted(tuple(r) for r in P.containing_regions(points, "rec_no", "lng", "lat", regions, "comid", "ring_lng", "ring_lat").collect())
    assert got == [(1, 1), (2, 2)]
    near = R.locate(points, "rec_no", "lng", "lat", regions, "comid", "ring_lng", "ring_lat", 0.3).collect()
    assert sorted((r["rec_no"], r["comid"]) for r in near) == [(1, 1), (2, 2), (4, 1)]


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[2], a[3], b[2], b[3]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * P.EARTH_KM * math.asin(math.sqrt(min(1, h)))


def test_near_pairs_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for lat, lng in ((0, 0), (60, 10), (-59.9, 179.999), (84.9, -179.999), (89.9995, 5), (-89.999, 100), (45, -180), (45, 180)):
        for _ in range(45):
            la = max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02)))
            lo = lng + rng.uniform(-0.03, 0.03) * (3000 if abs(lat) > 89 else 1)
            lo = (lo + 180) % 360 - 180
            rows.append((len(rows), rng.choice("abcdefgh"), la, lo, "c", "d"))
    rows += [(10_000 + i, rng.choice(["x", "y", None]), *rows[0][2:4], "c", "d") for i in range(20)]
    rows += [(20_000, "n", None, 1.0, "c", "d"), (None, "n", 0.0, 0.0, "c", "d")]
    points = spark.createDataFrame(rows + rows[:50], POINT)
    got = sorted(tuple(r) for r in P.near_pairs(points, "rec_no", "id", "lat", "lng", 0.75).collect())
    ok = [r for r in rows if r[0] is not None and r[2] is not None]
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(ok) for b in ok[:i] if a[1] != b[1] and km(a, b) < 0.75)
    assert got == want and len(want) > 1000
    assert P.near_pairs(points.where("false"), "rec_no", "id", "lat", "lng", 0.75).count() == 0


def test_nearest_region_and_lines_in_box(spark):
    rng = random.Random(4)
    rings = {i: star(rng, 8, rng.uniform(-1, 1), rng.uniform(-1, 1), 0.2) for i in range(25)}
    regions = spark.createDataFrame([(i, [p[0] for p in r], [p[1] for p in r], "x", "y") for i, r in rings.items()], REGION)
    pts = [(i, "a", rng.uniform(-1.3, 1.3), rng.uniform(-1.3, 1.3), "", "") for i in range(200)]
    points = spark.createDataFrame(pts, POINT)

    def apart(ring, x, y):
        best = 9.0
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            t = ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)
            t = min(1, max(0, t))
            best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        return best

    got = {r["rec_no"]: (r["comid"], round(r["distance"], 9)) for r in R.locate(points, "rec_no", "lng", "lat", regions, "comid", "ring_lng", "ring_lat", 0.1).collect()}
    want = {}
    for i, _, y, x, *_ in pts:
        held = [k for k, r in rings.items() if inside(r, x, y)]
        near = min((apart(r, x, y), k) for k, r in rings.items())
        if held:
            want[i] = (min(held), 0.0)
        elif near[0] <= 0.1:
            want[i] = (near[1], round(near[0], 9))
    assert got == want

    def box(ring, x, y):
        steps = np.linspace(0, 1, 20001)
        return min(np.maximum(abs(x1 + steps * (x2 - x1) - x), abs(y1 + steps * (y2 - y1) - y)).min() for (x1, y1), (x2, y2) in zip(ring, ring[1:]))

    got = {(r["rec_no"], r["comid"]): r["half_width"] for r in R.lines_in_box(points.limit(30), "rec_no", "lng", "lat", regions, "comid", "ring_lng", "ring_lat", 0.08).collect()}
    for i, _, y, x, *_ in pts[:30]:
        for k, r in rings.items():
            w = box(r, x, y)
            assert ((i, k) in got) == (w <= 0.08) or abs(w - 0.08) < 1e-3
            if (i, k) in got:
                assert abs(got[i, k] - w) < 1e-3

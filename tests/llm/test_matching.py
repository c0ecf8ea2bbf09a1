import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from thalweg.llm import matching as M

OUTLET = "rec_no long, id string, lat double, lng double, name string, area double, comid string"
RIVER = "comid long, uparea double, riv_name string, line_lng array<double>, line_lat array<double>, name string"


def world(seed, n=150):
    rng = random.Random(seed)
    names = ["".join(rng.choice(["ka", "to", "ri", "mel", "sun", "vo", "dra"]) for _ in range(3)) for _ in range(60)]
    rivers, truth, outlets = [], {}, []
    for k in range(n):
        x, y = rng.uniform(0, 1.2), rng.uniform(0, 1.2)
        line = [x, x + rng.uniform(-0.03, 0.03), x + rng.uniform(-0.06, 0.06)], [y, y + 0.03, y + 0.06]
        rivers.append((k + 1, 10 ** rng.uniform(1, 4), None if rng.random() < 0.2 else rng.choice(names), *line, "x"))
    for k in range(n):
        r = rng.choice(rivers)
        t = rng.random()
        far = rng.choice([0.003, 0.003, 0.003, 0.02])
        lng, lat = r[3][0] + t * (r[3][1] - r[3][0]) + rng.gauss(0, far), r[4][0] + t * 0.03 + rng.gauss(0, far)
        area = None if rng.random() < 0.15 else round(r[1] * rng.gauss(1, 0.02), 1)
        name = None if rng.random() < 0.1 else f"{r[2] or 'somewhere'} River at Bridge".upper()
        if k % 5 == 4:  # belongs to none
            lng, lat, area, name = lng + 5, lat, area, name
        else:
            truth[f"o{k}"] = r[0]
        outlets.append((k, f"o{k}", lat, lng, name, area, "x"))
    return outlets, rivers, truth


def test_matches_of_a_made_up_world(spark):
    outlets, rivers, truth = world(1)
    extra = [(900, None, 0.5, 0.5, "a", 1.0, "x"), (901, "nowhere", None, None, "a", 1.0, "x"), (902, "bad", 95.0, 0.5, "a", 1.0, "x"), *outlets[:20]]
    more = [(None, 5.0, "a", [0.1], [0.1], "x"), (9000, 5.0, "a", None, None, "x"), (9001, None, None, [], [], "x"), (9002, 1e12, "a", [0.5], [0.5], "x"), *rivers[:20]]
    o, r = spark.createDataFrame(outlets + extra, OUTLET), spark.createDataFrame(rivers + more, RIVER)
    scored = M.match_outlets(o, r)
    best = {x["id"]: x["comid"] for x in M.best_matches(scored).collect()}
    right = sum(truth.get(i) == c for i, c in best.items())
    assert right / len(best) > 0.9 and right / len(truth) > 0.85 and not {"nowhere", "bad"} & set(best)
    per = defaultdict(float)
    for x in scored.collect():
        assert 0 <= x["confidence"] <= 1
        per[x["id"]] += x["confidence"]
    assert max(per.values()) <= 1 + 1e-9  # an outlet cannot be two reaches
    assert M.match_outlets(o.where("false"), r).count() == 0 and M.match_outlets(o, r.where("false")).count() == 0


def test_candidates_are_all_within_the_distance(spark):
    outlets, rivers, _ = world(2, 80)
    o, r = spark.createDataFrame(outlets, OUTLET), spark.createDataFrame(rivers, RIVER)

    def apart(x, y, xs, ys):
        best = 9.0
        for x1, y1, x2, y2 in zip(xs, ys, xs[1:], ys[1:]):
            t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            best = min(best, math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)))
        return best

    got = {(x["id"], x["comid"]): x["near"] for x in M.candidates(o, r).collect()}
    want = {(a[1], b[0]): 1 - apart(a[3], a[2], b[3], b[4]) / 0.1 for a in outlets for b in rivers if apart(a[3], a[2], b[3], b[4]) <= 0.1}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_similarities(spark):
    rows = [("Kalren River at Mill", "Kalren"), ("KALREN NR MILL", "Kalren"), ("Kalern R. at X", "Kalren"), ("Mill (Bróun)", "Broun"), ("a", None), (None, "b"), ("--", "b"), ("Kal ren at X", "Kalren"), ("Mill", "Kalrenvatn")]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, r string").select(M.name_similarity(F.col("n"), F.col("r"))).collect()]
    assert got[0] == got[1] == got[3] == got[7] == 1.0 and abs(got[2] - 5 / 6) < 1e-9 and got[4:7] == [None] * 3 and got[8] == 0.0
    rows = [(1.0, 2.0), (2.0, 1.0), (0.0, 1.0), (None, 1.0), (float("nan"), 1.0)]
    assert [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(M.area_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.5, None, None, None]


def test_posteriors_share_one_belief():
    p = M.posteriors(np.array([0.0, 0.0, 800.0, 799.0, -900.0]), np.array([0, 2, 4]))
    assert np.allclose(p[:2], 1 / 3) and abs(p[2:4].sum() - 1) < 1e-9 and p[4] == 0


def test_repeated_rows_become_one_whatever_is_missing(spark):
    rows = [(2, "a", 1.0, 1.0, "late", 5.0, "x"), (1, "a", None, 3.0, None, 4.0, "x"), (None, "a", 9.0, 9.0, "never", 9.0, "x"), (None, "b", 2.0, 2.0, "z", None, "x"), (None, "b", 2.0, 2.0, "y", None, "x"), (3, "c", None, None, None, None, "x")]
    got = {r["id"]: tuple(r)[1:] for r in M.one_per_outlet(spark.createDataFrame(rows, OUTLET)).collect()}
    assert got == {"a": (1.0, 1.0, "late", 4.0), "b": (2.0, 2.0, "y", None), "c": (None, None, None, None)}
    rivers = [(1, None, "n", [0.0], [0.0], "x"), (1, 7.0, None, [0.0], [0.0], "x"), (2, 1.0, "m", [0.0, 1.0], [0.0], "x"), (3, None, None, [0.0, None], [0.0, 1.0], "x")]
    r = spark.createDataFrame(rivers, RIVER)
    assert {x["comid"]: (x["uparea"], x["riv_name"]) for x in M.one_per_reach(r).collect()} == {1: (7.0, "n"), 2: (1.0, "m"), 3: (None, None)}
    assert [tuple(x) for x in M.segments(r.where("riv_name is null or riv_name = 'm'")).collect()] == [(1, 0.0, 0.0, 0.0, 0.0)]  # 2 and 3 have no whole line
    near = spark.createDataFrame([(1, "p", 0.01, 0.01, None, None, "x")], OUTLET)
    assert [x["comid"] for x in M.candidates(near, r).collect()] == [1]


def test_candidates_across_the_date_line(spark):
    o = spark.createDataFrame([(1, "w", 0.0, -179.99, None, None, "x"), (2, "e", 0.05, 179.95, None, None, "x"), (3, "far", 0.0, 0.0, None, None, "x")], OUTLET)
    r = spark.createDataFrame([(1, None, None, [179.99, 179.97], [0.0, 0.0], "x"), (2, None, None, [179.98, -179.98], [0.06, 0.06], "x"), (3, None, None, [-179.97, 179.99], [0.02, 0.02], "x")], RIVER)
    got = {(x["id"], x["comid"]): round((1 - x["near"]) / 10, 6) for x in M.candidates(o, r).collect()}
    assert got == {("w", 1): 0.02, ("w", 2): 0.06, ("w", 3): 0.02, ("e", 1): round(math.hypot(0.02, 0.05), 6), ("e", 2): round(math.hypot(0.03, 0.01), 6), ("e", 3): 0.05}


def test_the_mixture_ends_in_the_same_place_from_another_start(spark):
    outlets, rivers, _ = world(4, 300)
    o, r = spark.createDataFrame(outlets, OUTLET), spark.createDataFrame(rivers, RIVER)
    groups = M._grouped(M.candidates(o, r))

    def by_distance(x):  # knows of nothing but the distance
        p = np.clip(x[:, 0], 0.05, 0.95)
        return np.stack([1 - p, p * p, p * (1 - p)], axis=1)

    a, b = M.fit(groups), M.fit(groups, first=by_distance, tolerance=1e-4)
    assert a.converged and b.converged and a.steps < M.MAX_STEPS
    assert np.abs(a.mixture.means - b.mixture.means).max() < 0.05 and not M.fit(groups, steps=1).converged


def test_what_stands_on_one_spot_agrees(spark):
    outlets, rivers, truth = world(5, 200)
    # a second id for every site, of which nothing is known but where it is, a little off
    twins = [(1000 + k, f"t{k}", lat + 1e-5, lng - 1e-5, None, None, "x") for k, _, lat, lng, *_ in outlets]
    o, r = spark.createDataFrame(outlets + twins, OUTLET), spark.createDataFrame(rivers, RIVER)
    groups = M._grouped(M.candidates(o, r))
    found = M.fit(groups)
    linked = M._with_neighbours(groups, found.mixture)
    right = lambda g: sum(truth.get("o" + x["id"][1:]) == x["comid"] for x in M.best_matches(M._believed(g, found.mixture)).collect() if x["id"][0] == "t")
    assert right(linked) > right(groups)

import random
from collections import Counter, defaultdict

from thalweg.operators import skew as S

RUN = "id string, n long, _task string, k string"


def rows(n=4000):
    rng = random.Random(1)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else None if i % 17 == 0 else rng.choice(["warm", *[f"k{j}" for j in range(200)]])
        out.append((key, None if i % 13 == 0 else i, "x", "y"))
    return out + out[:100]


def test_totals_and_dominant_values_against_counters(spark):
    data = rows()
    df = spark.createDataFrame(data, RUN)
    got = {r["keyval"]: (r["n_rows"], r["s"]) for r in S.balanced_totals(df, "id", {"s": "n"}).collect()}
    n, s = Counter(), defaultdict(float)
    for k, v, *_ in data:
        if k is not None:
            n[k] += 1
            s[k] += v or 0
    assert got == {k: (n[k], s[k]) for k in n}
    assert {r["keyval"] for r in S.dominant_values(df, "id", 20).collect()} == {k for k in n if n[k] >= len(data) / 20}
    exact = spark.createDataFrame([("a",)] * 7 + [(None,)] * 133, "id string")  # 140 * 0.05 is a little over 7 in floats
    assert {r["keyval"] for r in S.dominant_values(exact, "id").collect()} == {"a"}
    edge = spark.createDataFrame([("a",)] + [("b",)] * 19, "id string")
    assert {r["keyval"] for r in S.dominant_values(edge, "id", 20).collect()} == {"a", "b"}


def test_placement_is_even_and_splits_the_hot_key(spark):
    df = spark.createDataFrame(rows(), RUN)
    p = S.plan_placement(df, "id", 8)
    assert p.total == 4100 and len(set(p.heavy["id", "hot"][1])) > 1
    assert max(p.loads) < 1.25 * sum(p.loads) / 8
    per_task = S.route(df, "id", p).groupBy("_task").count().collect()
    assert max(r["count"] for r in per_task) < 1.5 * sum(r["count"] for r in per_task) / 8
    where, loads = S.pack([5, 4, 3, 3, 3], 2)
    assert sorted(loads) == [8, 10] and len(where) == 5


def test_hot_keys_are_counted_at_their_shards(spark):
    df = spark.createDataFrame([(i, *r[:1], "b" if i % 2 else str(i % 300)) for i, r in enumerate(rows())], "run_no long, id string, basin string")
    p = S.plan_placement(df, ["id", "basin"], 8)
    got = {(r["field"], r["keyval"]): (r["n_rows"], r["n_shards"]) for r in S.dominant_values(df, ["id", "basin"], 20, p, ["run_no"]).collect()}
    assert set(got) == {("id", "hot"), ("basin", "b")} | {k for k in got if k[1] == "warm"}
    for key, (n, shards) in got.items():
        assert shards == len(p.heavy[key][1]) and abs(n - p.heavy[key][0]) <= 0.02 * n
    assert min(got["id", "hot"][1], got["basin", "b"][1]) > 1
    all_of = {(r["field"], r["keyval"]): r["n_shards"] for r in S.balanced_totals(df.select("id"), "id", {}).collect()}
    assert len(all_of) == 202  # without another column to spread by, a key's rows share a shard and are counted all the same


def test_no_session_setting_is_left_changed(spark):
    before = spark.conf.get(S.SUBSET_KEYS)
    df = spark.createDataFrame(rows(), RUN)
    for value in ("true", "false"):
        spark.conf.set(S.SUBSET_KEYS, value)
        assert S.fragment_join(df, df.select("id").distinct(), "id").count() == 4100 and spark.conf.get(S.SUBSET_KEYS) == value
    spark.conf.set(S.SUBSET_KEYS, before)


def test_join_keeps_all_rows_and_names(spark):
    data = rows()
    side = [("hot", 1, "s"), ("warm", 2, "s"), ("warm", 3, "s"), ("none", 4, "s"), (None, 5, "s")]
    df, right = spark.createDataFrame(data, RUN), spark.createDataFrame(side, "id string, n long, extra string")
    left = S.fragment_join(df, right, "id")
    assert left.columns == ["id", "n", "_task", "k", "n_side", "extra"]
    by = defaultdict(list)
    for k, v, _ in side:
        by[k].append(v)
    want = Counter((k, v, w) for k, v, *_ in data for w in (by[k] if k is not None and k in by else [None]))
    assert Counter((r["id"], r["n"], r["n_side"]) for r in left.collect()) == want
    inner = S.fragment_join(df, right, "id", "inner")
    assert inner.count() == sum(c for (_, _, w), c in want.items() if w is not None)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], RUN)
    assert S.balanced_totals(df, "id", {"s": "n"}).count() == 0 and S.dominant_values(df, "id").count() == 0
    nulls = spark.createDataFrame([(None, 1, "", "")] * 5, RUN)
    assert S.balanced_totals(nulls, "id", {"s": "n"}).count() == 0 and S.fragment_join(nulls, df.select("id", "n"), "id").count() == 5

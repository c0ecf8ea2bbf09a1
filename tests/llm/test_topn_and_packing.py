import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thalweg.llm import packing, topn
from thalweg.llm.tokens import encoder


def brute(rows, n):
    best = defaultdict(dict)
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = min(s, best[g].get(i, s))
    return sorted((g, i, k + 1) for g, items in best.items() for k, (s, i) in enumerate(sorted((s, i) for i, s in items.items())[:n]))


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    rows = [("hot" if k % 3 == 0 else rng.choice("abcdefg"), rng.randrange(60), float(rng.randrange(12))) for k in range(6000)]
    rows += [(None, 1, 1.0), ("a", None, 1.0), ("a", 1, None), ("a", 1, float("nan")), ("solo", 5, 1.0)] + rows[:50]
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "grp string, item long, s double, g string, r int").repartition(7)
    for n in (1, 3, 100):
        assert sorted(tuple(r) for r in topn.top_n(df, "grp", "item", F.col("s"), n).collect()) == brute(rows, n)
    assert topn.top_n(df.where("false"), "grp", "item", F.col("s"), 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "grp", "item", F.col("s"), 0)


def test_top_n_streams_over_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"g{k % 5}", k, float((k * 7919) % 101)) for k in range(500)]
        df = spark.createDataFrame(rows, "g string, i long, s double")
        assert sorted(tuple(r) for r in topn.top_n(df, "g", "i", F.col("s"), 3).collect()) == brute(rows, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_n_of_groups_that_are_no_number(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan, k, float(k % 7)) for k in range(40)] + [(1.0, 5, 2.0)], "g double, i long, s double").repartition(5)
    got = sorted((r["rnk"], r["i"]) for r in topn.top_n(df, "g", "i", F.col("s"), 3).where("isnan(g)").collect())
    assert got == [(1, 0), (2, 7), (3, 14)]


def plain_ffd(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        for b, left in enumerate(room):
            if left >= sizes[k]:
                break
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= sizes[k]
        out[k] = b
    return out


@given(st.lists(st.integers(0, 50), max_size=200), st.integers(50, 120))
@settings(max_examples=150, deadline=None)
def test_tournament_tree_is_first_fit_decreasing(sizes, capacity):
    assert packing.first_fit_decreasing(sizes, capacity).tolist() == plain_ffd(sizes, capacity)


def test_sizes_beyond_the_capacity_are_refused():
    with pytest.raises(ValueError):
        packing.first_fit_decreasing([5, 11], 10)
    assert packing.first_fit_decreasing([], 10).tolist() == []


def test_packing_keeps_every_token_in_its_place(spark):
    enc = encoder()
    rng = random.Random(3)
    words = "river stone gate <|endoftext|> mill naïve 水 🙂 \n\n   12345 don't".split(" ")
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 60, 400, 3000]))) for i in range(120)}
    texts |= {500: None, 501: "", 502: "a" * 50_000}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(7, texts[7], "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, grp int")
    out = packing.pack(df, "doc_id", "text", capacity=128, group_size=50)
    got = out.collect()
    per = defaultdict(int)
    parts = defaultdict(list)
    for r in got:
        per[r["container"]] += r["n_tokens"]
        if r["doc_id"] != 7:
            parts[r["doc_id"]].append((r["part"], r["first_token"], r["n_tokens"]))
    assert max(per.values()) <= 128
    for i, t in texts.items():
        n = len(enc.encode_ordinary(t or ""))
        if i != 7:
            p = sorted(parts[i])
            assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and len(p) == max(1, -(-n // 128))
            assert all(x[2] == 128 for x in p[:-1]) and [x[1] for x in p] == [128 * k for k in range(len(p))]
    assert sum(1 for r in got if r["doc_id"] == 7 and r["part"] == 0) == 3
    report = packing.fill_report(out, 128).first()
    assert tuple(packing.check_report(out, df, "doc_id", 128).first()) == (len(rows), 0, 0, 0, 0)
    bad = out.where("doc_id <> 500").withColumn("container", F.lit("one"))
    assert tuple(packing.check_report(bad, df, "doc_id", 128).first()) == (len(rows) - 1, 0, 0, 1, 1)
    again = packing.pack(df, "doc_id", "text", capacity=128, group_size=50)
    assert again.groupBy("container").count().orderBy("container").collect() == out.groupBy("container").count().orderBy("container").collect()
    assert report["fullest"] <= 128 and report["filled"] > 0.9 and report["n_containers"] == len(per)
    assert packing.pack(df.where("false"), "doc_id", "text").count() == 0


def test_packing_is_near_the_lower_bound(spark, small):
    out = packing.pack(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text")
    assert packing.fill_report(out).first()["filled"] > 0.93

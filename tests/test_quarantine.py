import csv
import io
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thalweg.operators import quarantine as Q


def brute(line):
    """The rules read character by character."""
    line = line or ""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            at += 1
            out = ""
            while True:
                if at >= n:
                    return "quoting"
                if line[at] == '"':
                    if line[at + 1 : at + 2] == '"':
                        out += '"'
                        at += 2
                        continue
                    at += 1
                    break
                out += line[at]
                at += 1
            if at < n and line[at] != ",":
                return "quoting"
            fields.append(out)
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return "quoting"
            fields.append(line[at:end])
            at = end
        if at >= n:
            break
        at += 1
    if len(fields) != 5:
        return "columns"
    if not fields[0].strip():
        return "id"
    for name, text, lo, hi in (("lat", fields[1], -60, 85), ("lng", fields[2], -180, 180)):
        try:
            v = float(text.strip()) if not set(text.strip().lower()) & set("_nif") else math.nan
        except ValueError:
            v = math.nan
        if not (math.isfinite(v) and lo < v < hi):
            return name
    return None


def reasons(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")
    failed = Q.failures(df)
    return {r["line_no"]: r["reason"] for r in failed.collect()}, Q.clean_rows(df, failed)


CASES = [
    "a,1,2,n,3", '"a","1","2","n","3"', '"a"x,1,2,n,3', 'a,1,2,n"x,3', '"a,1,2,n,3', "a,1,2,n", "a,1,2,n,3,4", ",1,2,n,3", "  ,1,2,n,3", '"  ",1,2,n,3',
    "a,85,2,n,", "a,-60,2,n,", "a,84.999,2,n,", "a,1,180,n,", "a,1,-180,n,", "a, 1 , 2 ,n,", "a,1e1,2E0,n,", "a,nan,2,n,", "a,1e999,2,n,", "a,.5,-.5,n,", "a,1.,2.,n,",
    'a,1,2,"say ""x"", y",3', 'a,1,2,"""",3', 'a,1,2,"""x""",', 'a,1,2,"",', 'a,1,2,"x"",3', "", ",,,,", '""', None, "id,lat,lng,name,area", "# note", "a,1,2,n,junk", "a,1d,2,n,3",
]


def test_cases(spark):
    got, clean = reasons(spark, CASES)
    assert got == {i: brute(x) for i, x in enumerate(CASES) if brute(x)}
    rows = {r["line_no"]: r for r in clean.collect()}
    assert set(rows) == {i for i, x in enumerate(CASES) if not brute(x)}
    i = CASES.index('a,1,2,"say ""x"", y",3')
    assert (rows[i]["name"], rows[i]["area"], rows[i]["lat"]) == ('say "x", y', 3.0, 1.0)
    assert rows[CASES.index("a,1,2,n,junk")]["area"] is None


def test_random_lines_against_brute_force(spark):
    import random

    rng = random.Random(5)
    lines = ["".join(rng.choice('",,a1 .-"') for _ in range(rng.randrange(0, 26))) for _ in range(3000)]
    lines += [",".join(rng.choice(['"1"', "1", ' 1', '"x,""y"', '""', '"']) for _ in range(5)) for _ in range(1500)]
    got, clean = reasons(spark, lines)
    assert got == {i: brute(x) for i, x in enumerate(lines) if brute(x)}
    assert clean.count() + len(got) == len(lines)


def test_long_lines_nulls_repeats_and_clashing_names(spark):
    long = 'a,1,2,"' + 'x""' * 200_000 + '",3'
    many = "," * 50_000
    rows = [(1, long, "p", "q"), (2, many, "p", "q"), (None, "bad", "p", "q"), (None, "bad", "r", "s"), (3, None, None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "line_no long, line string, reason string, value string")
    failed = Q.failures(df)
    assert sorted((r["line_no"] or 0, r["reason"]) for r in failed.collect()) == [(0, "columns"), (2, "columns"), (3, "columns")]
    assert [r["line_no"] for r in Q.clean_rows(df, failed).collect()] == [1]
    assert Q.failures(df.where("false")).count() == 0


def test_round_trip_of_written_csv(spark):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    names = ['plain', 'with, comma', 'with "quote"', '""', "", " "]
    lines = []
    for i, n in enumerate(names):
        out.seek(0)
        out.truncate()
        w.writerow([f"id{i}", 1.5, -2.5, n, 7])
        lines.append(out.getvalue().rstrip("\n"))
    got, clean = reasons(spark, lines)
    assert not got
    assert [r["name"] for r in clean.orderBy("line_no").collect()] == ["plain", "with, comma", 'with "quote"', '""', None, None]


def test_stream_gives_what_a_batch_gives(spark, small, tmp_path):
    from thalweg.streaming.intake import outlet_stream

    raw = spark.read.parquet(f"{small}/outlets_raw.parquet")
    raw.write.parquet(str(tmp_path / "in"))
    good, bad = outlet_stream(spark, str(tmp_path / "in"), raw.schema)
    for df, name in ((good, "good"), (bad, "bad")):
        q = df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    failed = Q.failures(raw)
    assert {tuple(r) for r in spark.table("bad").select("line_no", "reason").collect()} == {tuple(r) for r in failed.select("line_no", "reason").collect()}
    assert spark.table("good").count() == Q.clean_rows(raw, failed).count()

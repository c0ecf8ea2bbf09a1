"""Queries of the data-preparation operators of the core: failing rows, proximity, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.operators import proximity, quarantine, skew
from thalweg.sources.tables import table

NEAR_KM = 0.75
DOMINANT_ONE_IN = 20


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.failures(table(spark, d, "outlets_raw")).select("line_no", "reason")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "outlets_raw")
    return quarantine.clean_rows(raw, quarantine.failures(raw))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    outlets = table(spark, d, "outlets_sample")
    inside = proximity.containing_regions(outlets, "rec_no", "lng", "lat", table(spark, d, "catchments"), "comid", "ring_lng", "ring_lat")
    near = proximity.near_pairs(outlets, "rec_no", "id", "lat", "lng", NEAR_KM)
    return inside.select(F.lit("inside").alias("kind"), F.col("rec_no").alias("key1"), F.col("comid").alias("key2")).unionByName(
        near.select(F.lit("near").alias("kind"), "key1", "key2")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "split_runs").select("run_no", "id", "basin")
    return skew.dominant_values(runs, ["id", "basin"], DOMINANT_ONE_IN, spread=["run_no"]).select("field", "keyval")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums per id and per basin."""
    runs = table(spark, d, "split_runs").select("run_no", "id", "basin", "n_cells", "n_catchments")
    sums = {"sum_cells": "n_cells", "sum_catchments": "n_catchments"}
    return skew.balanced_totals(runs, ["id", "basin"], sums, spread=["run_no"]).drop("n_shards")


def p5_outlet_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs joined to the station they belong to, per result: the matching side goes to the shards of hot ids only."""
    stations = table(spark, d, "standing_outlets").select("id", "area")
    joined = skew.fragment_join(table(spark, d, "split_runs").select("run_no", "id", "run_result", "n_cells"), stations, "id")
    return joined.groupBy("run_result", F.col("area").isNotNull().alias("at_station")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n_cells").alias("sum_cells"), F.round(F.sum("area"), 3).alias("sum_area")
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_clean, p3_found, p5_found, p5_totals, p5_outlet_runs)}

_FIELD = '("([^"]|"")*"|[^",]*)'
_LINE = f"^{_FIELD}(,{_FIELD})*$"
_NUM = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_PARSED = rf"""
fields as (
  select line_no, coalesce(line, '') line, regexp_matches(coalesce(line, ''), '{_LINE}') sound,
    length(regexp_replace(regexp_replace(coalesce(line, ''), '"([^"]|"")*"', 'q', 'g'), '[^,]', '', 'g')) + 1 n,
    regexp_extract(line, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 1) c1,
    regexp_extract(line, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 3) c2,
    regexp_extract(line, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 5) c3,
    regexp_extract(line, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 7) c4,
    regexp_extract(line, '^{_FIELD},{_FIELD},{_FIELD},{_FIELD},{_FIELD}$', 9) c5
  from outlets_raw),
cells as (
  select line_no, line, sound, n, {", ".join(f"case when c{i} like '\"%' then replace(substr(c{i}, 2, length(c{i}) - 2), '\"\"', '\"') else c{i} end v{i}" for i in range(1, 6))}
  from fields),
judged as (
  select *, case when not sound then 'quoting' when n <> 5 then 'columns' when trim(v1) = '' then 'id'
    when not (regexp_matches(v2, '{_NUM}') and coalesce(try_cast(trim(v2) as double) > -60 and try_cast(trim(v2) as double) < 85, false)) then 'lat'
    when not (regexp_matches(v3, '{_NUM}') and coalesce(try_cast(trim(v3) as double) > -180 and try_cast(trim(v3) as double) < 180, false)) then 'lng' end reason
  from cells)"""

SQL = {
    "p2_found": f"with {_PARSED} select line_no, reason from judged where reason is not null",
    "p2_clean": f"""with {_PARSED} select line_no, trim(v1) id, try_cast(trim(v2) as double) lat, try_cast(trim(v3) as double) lng,
        nullif(trim(v4), '') "name", try_cast(trim(v5) as double) area from judged where reason is null""",
    "p3_found": """
with pts as (select distinct rec_no, id, lat, lng from outlets_sample where lat is not null and lng is not null),
ring as (select distinct comid, xmin, ymin, xmax, ymax, ring_lng, ring_lat from catchments),
cand as (select rec_no, comid, lat py, lng px, ring_lng rx, ring_lat ry from pts join ring on lng between xmin and xmax and lat between ymin and ymax),
edge as (select rec_no, comid, px, py, unnest(rx[:-2]) x1, unnest(ry[:-2]) y1, unnest(rx[2:]) x2, unnest(ry[2:]) y2 from cand)
select 'inside' kind, rec_no key1, comid key2 from edge group by rec_no, comid
  having sum(case when (y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1 then 1 else 0 end) % 2 = 1
union all
select 'near', least(a.rec_no, b.rec_no), greatest(a.rec_no, b.rec_no) from pts a join pts b on a.rec_no < b.rec_no
  and a.id is distinct from b.id and abs(a.lat - b.lat) < 0.01
  and 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) < 0.75""",
    "p5_found": """
select 'id' field, id keyval from split_runs where id is not null group by id having count(*) * 20 >= (select count(*) from split_runs)
union all
select 'basin', cast(basin as varchar) from split_runs where basin is not null group by basin having count(*) * 20 >= (select count(*) from split_runs)""",
    "p5_totals": """
select 'id' field, id keyval, count(*) n_rows, cast(sum(n_cells) as double) sum_cells, cast(sum(n_catchments) as double) sum_catchments
from split_runs where id is not null group by id
union all
select 'basin', cast(basin as varchar), count(*), cast(sum(n_cells) as double), cast(sum(n_catchments) as double)
from split_runs where basin is not null group by basin""",
    "p5_outlet_runs": """
select run_result, s.area is not null at_station, count(*) n_runs, cast(sum(n_cells) as bigint) sum_cells, round(sum(s.area), 3) sum_area
from split_runs r left join standing_outlets s on s.id = r.id group by 1, 2""",
}

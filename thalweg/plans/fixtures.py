"""Lattice networks and rasters derived from the relational tables by arithmetic both engines share.

The statements are the fixtures' definition; Spark runs them with tables bound by name, DuckDB as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thalweg.sources.tables import table

LATTICE = """
select comid, basin, r, c, unitarea,
  cast(c*100-20000 as double)/cast(1000 as double) xmin, cast(c*100-19900 as double)/cast(1000 as double) xmax,
  cast(r*100+10000 as double)/cast(1000 as double) ymin, cast(r*100+10100 as double)/cast(1000 as double) ymax
from (select p_partkey+1 comid, cast(floor(p_partkey/50) as bigint) r, p_partkey%50 c,
        cast(11+floor((p_partkey%50)/10) as int) basin, cast(p_size as bigint) unitarea from {part}) z"""
COMB = """
select k.comid, k.basin, k.r, k.c,
  case when k.comid+50<=n.n then k.comid+50 else 0 end up1,
  case when k.r=0 and k.c%10<9 and k.comid+1<=n.n then k.comid+1 else 0 end up2,
  cast(0 as bigint) up3, cast(0 as bigint) up4
from {lattice} k cross join (select count(*) n from {part}) n"""
TREE = """
select k comid, case when 4*k-2<=n then 4*k-2 else 0 end up1, case when 4*k-1<=n then 4*k-1 else 0 end up2,
  case when 4*k<=n then 4*k else 0 end up3, case when 4*k+1<=n then 4*k+1 else 0 end up4
from (select p_partkey+1 k from {part}) p cross join (select count(*) n from {part}) n"""
RINGS = """
select cast(floor(o_orderkey/8) as bigint) poly_id, o_orderkey%8 ring,
  case when o_orderkey%8=0 then cast(1 as double) else cast(o_custkey%100+1 as double)/cast(100000 as double) end ring_area from {orders}"""
CELLS = """
select k, r, c, case when c=63 and last then 0 when c=63 then 4 when last then 1 when ck%2=0 then 4 else 1 end fdir
from (select o_orderkey k, cast(floor(o_orderkey/64) as bigint) r, o_orderkey%64 c, o_custkey ck,
        cast(floor(o_orderkey/64) as bigint)%64 = 63 or cast(floor(o_orderkey/64) as bigint) = h.h-1 last
  from {orders} cross join (select cast(floor(count(*)/64) as bigint) h from {orders}) h where o_orderkey < 64*h.h) z"""


def lattice(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(LATTICE, part=table(spark, d, "part"))


def comb(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(COMB, part=table(spark, d, "part"), lattice=lattice(spark, d))


def tree(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(TREE, part=table(spark, d, "part"))


def rings(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(RINGS, orders=table(spark, d, "orders"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CELLS, orders=table(spark, d, "orders"))


#: The same as common table expressions.
SQL = {
    "f3": f"f3 as ({LATTICE.format(part='part')})",
    "f4": f"f4 as ({COMB.format(part='part', lattice='f3')})",
    "f5": f"f5 as ({TREE.format(part='part')})",
    "f6": f"f6 as ({RINGS.format(orders='orders')})",
    "f7": f"f7 as ({CELLS.format(orders='orders')})",
}

"""The watershed queries in DuckDB's SQL: brute force where Spark uses hierarchies, recursion where it doubles."""

from __future__ import annotations

from thalweg.plans.domain import SQL as D
from thalweg.plans.fixtures import SQL as X

_RAY = "sum(case when (y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1 then 1 else 0 end) % 2 = 1"
_RING_EDGES = "unnest(rx[:-2]) x1, unnest(ry[:-2]) y1, unnest(rx[2:]) x2, unnest(ry[2:]) y2"


def _inside(name: str, layer: str, key: str) -> str:
    return f"""{name}_e as (select id, {key}, lng px, lat py, {_RING_EDGES} from o join {layer}
      on lng between list_min(rx) and list_max(rx) and lat between list_min(ry) and list_max(ry)),
{name}_i as (select id, {key} from {name}_e group by id, {key} having {_RAY}),
{name} as (select id, min({key}) {key} from {name}_i group by id)"""


def _nearest(layer: str, key: str, reach: float) -> str:
    d = "sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2))"
    return f"""out_ as (select * from o where lng is not null and lat is not null and id not in (select id from w)),
n_e as (select id, {key}, lng px, lat py, {_RING_EDGES} from out_ join {layer} on lng between list_min(rx) - {reach} and list_max(rx) + {reach}
  and lat between list_min(ry) - {reach} and list_max(ry) + {reach}),
n_t as (select *, greatest(0.0, least(1.0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0.0))) t from n_e),
n_d as (select id, {key}, min({d}) d from n_t group by id, {key}),
n as (select id, arg_min({key}, (d, {key})) {key}, min(d) d from n_d where d <= {reach} group by id)
select id, {key}, cast(0 as double) distance from w union all select id, {key}, round(d, 6) from n"""


_BASIN = f"with {D['o']}, {D['mb']}, {_inside('w', 'mb', 'basin')}"
_UNIT = f"with recursive {D['o']}, {D['ca']}, {D['rv']}, {_inside('w', 'ca', 'comid')}"
_EDGES = """e as (select distinct comid dst, src from (select comid, unnest([up1, up2, up3, up4]) src from rv) where src <> 0 and src in (select comid from rv))"""
_UP = f"""{_EDGES},
up(id, comid, depth) as (select id, comid, 0 from w where comid in (select comid from rv) union all select up.id, e.src, up.depth + 1 from up join e on e.dst = up.comid)"""


def _closure(net: str, start: str) -> str:
    return f"""e as (select distinct comid dst, src from (select comid, unnest([up1, up2, up3, up4]) src from {net}) where src <> 0 and src in (select comid from {net})),
up(o, comid, depth) as ({start} union all select up.o, e.src, up.depth + 1 from up join e on e.dst = up.comid)"""


def _sig(x: str, n: int) -> str:
    scale = f"pow(10.0, floor(log10(abs({x}))) - {n} + 1)"
    return f"case when {x} = 0 then 0.0 when {x} is not null then round(({x}) / {scale}) * {scale} end"


_A, _INV = 6378137.0, 298.257223563
_E2 = (2 - 1 / _INV) / _INV
_E = _E2**0.5


def _north(lat: str) -> str:
    s = f"sin(radians({lat}))"
    es = f"({_E!r}::double * {s})"
    return f"({_A / 2!r}::double * ({1 - _E2!r}::double * ({s} / (1 - {es} * {es}) - ln((1 - {es}) / (1 + {es})) / (2 * {_E!r}::double))))"


_KM2 = f"""km as (select comid, abs(sum({_A!r}::double * radians(x1) * {_north('y2')} - {_A!r}::double * radians(x2) * {_north('y1')})) / 2 / 1e6 km2
  from (select comid, {_RING_EDGES} from ca) group by comid)"""


def _sides(rel: str, by: str) -> str:
    return f"""sides as (select {by}, unnest([{{'x1': c, 'y1': r, 'x2': c + 1, 'y2': r}}, {{'x1': c + 1, 'y1': r, 'x2': c + 1, 'y2': r + 1}},
  {{'x1': c, 'y1': r + 1, 'x2': c + 1, 'y2': r + 1}}, {{'x1': c, 'y1': r, 'x2': c, 'y2': r + 1}}]) s from {rel}),
border as (select {by}, cast(s.x1 as bigint) x1, cast(s.y1 as bigint) y1, cast(s.x2 as bigint) x2, cast(s.y2 as bigint) y2 from sides group by {by}, s having count(*) % 2 = 1)"""


_SHEDS = f"""with recursive {X['f3']}, {X['f4']}, {_closure('f4', 'select comid, comid, 0 from f4 where r = 0')},
sheds as (select up.o, f3.r, f3.c from up join f3 using (comid)), {_sides('sheds', 'o')}"""
_FLOW = """e as (select a.k src, b.k dst from f7 a join f7 b on b.r = a.r + case a.fdir when 4 then 1 else 0 end and b.c = a.c + case a.fdir when 1 then 1 else 0 end where a.fdir <> 0)"""
_ACC = f"""with recursive {X['f7']}, {_FLOW},
up(o, k) as (select k, k from f7 union all select up.o, e.src from up join e on e.dst = up.k),
acc as (select o k, count(*) acc from up group by o), cells as (select f7.r, f7.c, acc.acc from f7 join acc using (k))"""
_TRACE = f"""with recursive {X['f7']}, {_FLOW},
up(o, k, depth) as (select k, k, 0 from f7 union all select up.o, e.src, up.depth + 1 from up join e on e.dst = up.k),
traced as (select up.o, f7.r, f7.c from up join f7 using (k)), {_sides('traced', 'o')}"""
_LINE = "unnest(line_lng[:-2]) x1, unnest(line_lat[:-2]) y1, unnest(line_lng[2:]) x2, unnest(line_lat[2:]) y2"


def _box(reach: float, where: str = "true") -> str:
    """Smallest square around each outlet that meets each reach."""
    t = lambda n, d: f"greatest(0.0, least(1.0, coalesce(({n}) / nullif({d}, 0), 0.0)))"
    ax, ay, dx, dy = "(x1 - px)", "(y1 - py)", "(x2 - x1)", "(y2 - y1)"
    at = lambda s: f"greatest(abs({ax} + {s} * {dx}), abs({ay} + {s} * {dy}))"
    places = ["0.0", "1.0", t(f"-{ax}", dx), t(f"-{ay}", dy), t(f"{ay} - {ax}", f"{dx} - {dy}"), t(f"-{ay} - {ax}", f"{dx} + {dy}")]
    return f"""b_e as (select id, comid, lng px, lat py, {_LINE} from o join rv on lng between list_min(line_lng) - {reach} and list_max(line_lng) + {reach}
  and lat between list_min(line_lat) - {reach} and list_max(line_lat) + {reach} where {where}),
b as (select id, comid, min(least({', '.join(at(p) for p in places)})) half_width from b_e group by id, comid),
bx as (select * from b where half_width <= {reach})"""


def _ladder(max_dist: float = 0.075) -> list[float]:
    steps, w = [0.01], 0.01
    while w <= max_dist:
        w += 0.01
        steps.append(w)
    return steps


_LADDER = _ladder()
_SUMMARY = f"""{_UNIT.replace('with recursive', 'with recursive ' + D['mb'] + ', ')}, {_inside('m', 'mb', 'basin')}, {_KM2},
loc as (select o.*, m.basin, w.comid from o join m using (id) join w using (id) join ca on ca.comid = w.comid and ca.basin = m.basin where w.comid in (select comid from rv)),
{_EDGES},
up(id, comid) as (select id, comid from loc union all select up.id, e.src from up join e on e.dst = up.comid),
shed as (select id, count(*) n_catchments, sum(km2) km2 from up left join km using (comid) group by id),
res as (select o.id, o.lat, o.lng, o.name as "name", o.area area_reported, loc.basin, loc.comid, n_catchments,
  round_even(rv.line_lat[1], 3) lat_snap, round_even(rv.line_lng[1], 3) lng_snap, coalesce({_sig('km2', 3)}, 0.0) area_calc,
  case when loc.comid is null then 'failed' else 'low res' end result
  from o left join loc using (id) left join rv on rv.comid = loc.comid left join shed on shed.id = o.id),
pct as (select *, case when result <> 'failed' then (area_calc - area_reported) / nullif(area_reported, 0) * 100 end p from res),
summary as (select * exclude (p), {_sig('p', 2)} perc_diff from pct)"""


def _geodesic(rel: str, steps: int = 12) -> str:
    """Relation g: rel (key, la1, lo1, la2, lo2) with metres on the ellipsoid; Vincenty's iteration written out step by step."""
    f, b = 1 / _INV, _A * (1 - 1 / _INV)
    start = f"""g0 as (select *, sin(u1) s1, cos(u1) c1, sin(u2) s2, cos(u2) c2, dl lam from (select *, atan({1 - f!r}::double * tan(radians(la1))) u1,
  atan({1 - f!r}::double * tan(radians(la2))) u2, radians(lo2) - radians(lo1) dl from {rel}))"""
    one = """select *, coalesce(c1 * c2 * sin(lam) / nullif(ss, 0), 0.0) sa from (select *, atan2(ss, cs) sig from
  (select *, sqrt(pow(c2 * sin(lam), 2) + pow(c1 * s2 - s1 * c2 * cos(lam), 2)) ss, s1 * s2 + c1 * c2 * cos(lam) cs from {}))"""
    full = "select *, 1 - sa * sa ca2, case when 1 - sa * sa = 0 then 0.0 else cs - 2 * s1 * s2 / (1 - sa * sa) end c2m from (" + one + ")"
    parts = [start]
    for k in range(steps):
        c = f"({f / 16!r}::double * ca2 * (4 + {f!r}::double * (4 - 3 * ca2)))"
        new = f"dl + (1 - {c}) * {f!r}::double * sa * (sig + {c} * ss * (c2m + {c} * cs * (2 * c2m * c2m - 1)))"
        keep = "la1, lo1, la2, lo2, key, s1, c1, s2, c2, dl"
        parts.append(f"g{k + 1} as (select {keep}, {new} lam from ({full.format(f'g{k}')}))")
    k2 = f"(ca2 * {(_A**2 - b**2) / b**2!r}::double)"
    big_a = f"(1 + {k2} / 16384 * (4096 + {k2} * (-768 + {k2} * (320 - 175 * {k2}))))"
    big_b = f"({k2} / 1024 * (256 + {k2} * (-128 + {k2} * (74 - 47 * {k2}))))"
    ds = f"{big_b} * ss * (c2m + {big_b} / 4 * (cs * (2 * c2m * c2m - 1) - {big_b} / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))"
    parts.append(f"g as (select key, {b!r}::double * {big_a} * (sig - {ds}) metres from ({full.format(f'g{steps}')}))")
    return ",\n".join(parts)


def _within_reach(name: str, layer: str, key: str, reach: float, points: str = "o", same: str = "") -> str:
    """Relation name(id, key): the region that holds a point, or else the nearest within reach. same: a further condition on p and r."""
    also = f" and {same}" if same else ""
    d = "sqrt(pow(px - x1 - t * (x2 - x1), 2) + pow(py - y1 - t * (y2 - y1), 2))"
    return f"""{name}_e as (select p.id, r.{key}, lng px, lat py, {_RING_EDGES} from {points} p join {layer} r on lng between list_min(rx) - {reach} and list_max(rx) + {reach}
  and lat between list_min(ry) - {reach} and list_max(ry) + {reach}{also}),
{name}_i as (select id, min({key}) {key} from (select id, {key} from {name}_e group by id, {key} having {_RAY}) group by id),
{name}_t as (select *, greatest(0.0, least(1.0, coalesce(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0.0))) t from {name}_e where id not in (select id from {name}_i)),
{name}_d as (select id, {key}, min({d}) d from {name}_t group by id, {key}),
{name} as (select id, {key} from {name}_i union all select id, arg_min({key}, (d, {key})) from {name}_d where d <= {reach} group by id)"""


_SEARCHED = f"""f as (select bx.id, bx.comid, rv.uparea, {' + '.join(f'case when half_width > {w!r}::double then 1 else 0 end' for w in _LADDER)} + 1 ring,
  abs((rv.uparea - a.area) / a.area) pd from bx join rv using (comid) join turned a using (id)),
k as (select *, row_number() over (partition by id order by ring, pd, comid) n from f where pd < 0.25 and ring <= {len(_LADDER)})"""
_MATCHED = f"""with recursive {D['o']}, {D['mb']}, {D['ca']}, {D['rv']}, {_KM2},
{_within_reach('m', 'mb', 'basin', 0.025)}, om as (select o.*, m.basin from o join m using (id)),
{_within_reach('w', 'ca', 'comid', 0.025, 'om', 'p.basin = r.basin')},
loc0 as (select om.*, w.comid, rv.uparea, abs((rv.uparea - area) / nullif(area, 0)) pd from om join w using (id) join rv using (comid)),
turned as (select * from loc0 where not (pd is null or pd <= 0.25)),
{_box(_LADDER[-1], 'o.id in (select id from turned)')}, {_SEARCHED},
loc as (select id, basin, comid from loc0 where pd is null or pd <= 0.25 union all select k.id, turned.basin, k.comid from k join turned using (id) where n = 1),
{_EDGES},
up(id, comid) as (select id, comid from loc union all select up.id, e.src from up join e on e.dst = up.comid),
shed as (select id, count(*) n_catchments, sum(km2) km2 from up left join km using (comid) group by id),
ends as (select loc.id key, o.lat la1, o.lng lo1, rv.line_lat[1] la2, rv.line_lng[1] lo2 from loc join o using (id) join rv on rv.comid = loc.comid),
{_geodesic('ends')},
res as (select o.id, o.lat, o.lng, o.name as "name", o.area area_reported, loc.basin, loc.comid, n_catchments,
  round_even(ends.la2, 3) lat_snap, round_even(ends.lo2, 3) lng_snap, coalesce({_sig('km2', 3)}, 0.0) area_calc,
  case when loc.comid is null then 'failed' else 'low res' end result, {_sig('metres', 2)} snap_dist
  from o left join loc using (id) left join ends on ends.key = o.id left join g on g.key = o.id left join shed on shed.id = o.id),
pct as (select *, case when result <> 'failed' then (area_calc - area_reported) / nullif(area_reported, 0) * 100 end p from res)
select * exclude (p), {_sig('p', 2)} perc_diff from pct"""
_CANON = """canon as (select distinct comid, case when (x1, y1) < (x2, y2) then x1 else x2 end x1, case when (x1, y1) < (x2, y2) then y1 else y2 end y1,
  case when (x1, y1) < (x2, y2) then x2 else x1 end x2, case when (x1, y1) < (x2, y2) then y2 else y1 end y2 from (select comid, unnest(rx[:-2]) x1, unnest(ry[:-2]) y1, unnest(rx[2:]) x2, unnest(ry[2:]) y2 from ca))"""
_POLYGONS = f"""{_UNIT.replace('with recursive', 'with recursive ' + D['mb'] + ', ')}, {_inside('m', 'mb', 'basin')}, {_CANON},
loc as (select o.id, w.comid from o join m using (id) join w using (id) join ca on ca.comid = w.comid and ca.basin = m.basin where w.comid in (select comid from rv)),
{_EDGES},
up(id, comid) as (select id, comid from (select distinct comid id, comid from loc) union all select up.id, e.src from up join e on e.dst = up.comid),
mem as (select distinct up.* from up join ca using (comid)),
border as (select id, x1, y1, x2, y2 from mem join canon using (comid) group by all having count(*) % 2 = 1),
beside as (select distinct a.comid, b.comid other from canon a join canon b using (x1, y1, x2, y2) where a.comid <> b.comid),
comp(id, root, comid) as (select id, comid, comid from mem union select comp.id, comp.root, beside.other from comp join beside using (comid) join mem on mem.id = comp.id and mem.comid = beside.other),
parts as (select id, count(distinct root) n_parts from (select id, comid, min(root) root from comp group by id, comid) group by id),
flat as (select comid, abs(sum(x1 * y2 - x2 * y1)) / 2 a from (select comid, {_RING_EDGES} from ca) group by comid),
size as (select id, sum(a) a from mem join flat using (comid) group by id),
edge as (select id, count(*) n_edges, min(x1) xmin, min(least(y1, y2)) ymin, max(x2) xmax, max(greatest(y1, y2)) ymax from border group by id)
select loc.id, n_parts, n_edges, round(a, 11) deg2, xmin, ymin, xmax, ymax from loc join parts on parts.id = loc.comid join size on size.id = loc.comid join edge on edge.id = loc.comid"""


def _coordinates(xs: str, ys: str) -> str:
    def text(v: str) -> str:
        v = f"round({v}, 5)"
        return f"case when abs({v}) < 1e-3 and {v} <> 0 then rtrim(cast(cast({v} as decimal(10, 5)) as varchar), '0') else cast({v} as varchar) end"

    return f"""'[' || array_to_string(list_transform(list_zip({xs}, {ys}), lambda p: '[' || {text('p[1]')} || ',' || {text('p[2]')} || ']'), ',') || ']'"""


_OFF = """sqrt(pow(xs[i] - xs[a] - t * (xs[b] - xs[a]), 2) + pow(ys[i] - ys[a] - t * (ys[b] - ys[a]), 2))"""
_SIMPLIFIED = f"""with recursive {D['ca']},
far as (select comid, rx xs, ry ys, len(rx) n, list_transform(range(1, len(rx) + 1), lambda i: pow(rx[i] - rx[1], 2) + pow(ry[i] - ry[1], 2)) d from ca),
start as (select comid, n, list_position(d, list_max(d)) f from far),
seg(comid, a, b) as (select comid, unnest([1, f]), unnest([f, n]) from start union all
  select comid, unnest([a, k]), unnest([k, b]) from (
    select comid, a, b, arg_max(i, (d, -i)) k, max(d) d from (
      select *, {_OFF} d from (
        select seg.comid, seg.a, seg.b, rx xs, ry ys, i, greatest(0.0, least(1.0, coalesce(((rx[i] - rx[a]) * (rx[b] - rx[a]) + (ry[i] - ry[a]) * (ry[b] - ry[a]))
          / nullif(pow(rx[b] - rx[a], 2) + pow(ry[b] - ry[a], 2), 0), 0.0))) t
        from seg join ca using (comid), lateral (select unnest(range(a + 1, b)) i))) group by comid, a, b) where d > 0.0008)
select comid, n before, cast(greatest(4, count(distinct a) + 1) as int) after from seg join start using (comid) group by comid, n"""


def _shown(x: str, digits: int) -> str:
    return f"case when {x} is null then '' else format('{{:,.{digits}f}}', {x}) end"


SQL = {
    "validate_outlets": """
with v as (select
  (select coalesce(sum(n - 1), 0) from (select count(*) n from outlets_sample where id is not null group by id)) "unique",
  count_if(lat is null or lng is null) "numeric", count_if(not (lat > -60 and lat < 85)) lat, count_if(not (lng > -180 and lng < 180)) lng,
  count_if(id is null or trim(id) = '') id from outlets_sample)
select 'unique' rule, cast("unique" as bigint) n from v union all select 'numeric', "numeric" from v union all select 'lat', lat from v
union all select 'lng', lng from v union all select 'id', id from v""",
    "shape_outlets": "select rec_no, id, lat, lng, \"name\", area area_reported, cast(0 as double) area_calc, 'failed' result from outlets_sample",
    "megabasin_join": f"{_BASIN} select o.id, w.basin from o left join w using (id)",
    "megabasin_nearest": f"{_BASIN}, {_nearest('mb', 'basin', 0.25)}",
    "catchment_join": f"{_UNIT} select o.id, w.comid from o left join w using (id)",
    "catchment_nearest": f"{_UNIT}, {_nearest('ca', 'comid', 0.05)}",
    "box_search": f"with {D['o']}, {D['rv']}, {_box(_LADDER[-1])} select id, comid, round(half_width, 6) half_width from bx",
    "basin_counts": f"{_BASIN} select basin, count(distinct id) n_outlets from w group by basin",
    "failed_outlets": f"""{_UNIT.replace('with recursive', 'with recursive ' + D['mb'] + ', ')}, {_inside('m', 'mb', 'basin')}
select id, 'not in any level 2 basin' explanation from o where id not in (select id from m)
union all select id, 'not in any unit catchment' from m where id not in (select id from w where comid in (select comid from rv))""",
    "upstream_closure": f"{_UNIT}, {_UP} select id, comid, min(depth) depth from up group by id, comid",
    "upstream_closure_wide": f"""with recursive {X['f5']}, {_closure('f5', 'select comid, comid, 0 from f5')}
select o comid, count(*) n_upstream, max(depth) levels from up group by o""",
    "upstream_closure_deep": f"""with recursive {X['f3']}, {X['f4']}, {_closure('f4', 'select comid, comid, 0 from f4')}
select o comid, count(*) n_upstream, max(depth) levels from up group by o""",
    "network_faults": f"""with {D['rv']}, n as (select distinct comid dst, src from (select comid, unnest([up1, up2, up3, up4]) src from rv) where src <> 0)
select distinct src comid, 'missing' fault from n where src not in (select comid from rv)
union all select src, 'several ways down' from n group by src having count(*) > 1""",
    "network_faults_trunk": f"""with {D['rv']}, t as (select * from rv where ord >= 2), n as (select distinct comid dst, src from (select comid, unnest([up1, up2, up3, up4]) src from t) where src <> 0)
select distinct src comid, 'missing' fault from n where src not in (select comid from t)
union all select src, 'several ways down' from n group by src having count(*) > 1""",
    "reach_lookup": f"{_UNIT} select w.id, w.comid, uparea, ord, riv_name, line_lng[1] lng_snap, line_lat[1] lat_snap from w join rv using (comid)",
    "watershed_catchments": f"""{_UNIT}, {_UP}
select id, count(*) n_catchments, round(sum(unitarea), 3) sum_unitarea, max(depth) longest from up join ca using (comid) group by id""",
    "area_match_accept": f"""{_UNIT}, a as (select w.id, w.comid, abs((uparea - area) / nullif(area, 0)) pd from w join o using (id) join rv using (comid))
select id, comid, round(pd, 6) pd, pd is null or pd <= 0.25 accepted from a""",
    "area_match_search": f"""with {D['o']}, {D['rv']}, {_box(_LADDER[-1], 'area > 0')},
f as (select bx.id, bx.comid, rv.uparea, {' + '.join(f'case when half_width > {w!r}::double then 1 else 0 end' for w in _LADDER)} + 1 ring,
  abs((rv.uparea - o.area) / o.area) pd from bx join rv using (comid) join o using (id)),
k as (select *, row_number() over (partition by id order by ring, pd, comid) n from f where pd < 0.25 and ring <= {len(_LADDER)})
select id, comid, round_even(uparea, 0) uparea, cast(ring as int) ring, round(pd, 6) pd from k where n = 1""",
    "resolution_switch": f"{_UNIT} select w.id, w.comid, case when uparea > 500 then 'low res' else 'high res' end result from w join rv using (comid)",
    "dissolve_edges": f"{_SHEDS} select o, x1, y1, x2, y2 from border",
    "dissolve_bounds": f"{_SHEDS} select o, min(x1) xmin, min(least(y1, y2)) ymin, max(x2) xmax, max(greatest(y1, y2)) ymax, count(*) n_edges from border group by o",
    "dissolve_rings": f"{_SHEDS} select o, cast(1 as bigint) n_parts, count(*) area from sheds group by o",
    "fill_holes": f"""with {X['f6']} select poly_id, count(*) n_rings, round(sum(case when ring > 0 then ring_area end), 8) hole_area
from f6 where ring = 0 or ring_area > 6.95e-4 group by poly_id""",
    "largest_part": f"with {X['f6']} select poly_id, ring, ring_area from f6 where ring > 0 qualify row_number() over (partition by poly_id order by ring_area desc, ring) = 1",
    "equal_area": f"with {D['ca']}, {_KM2} select comid, round(km2, 4) km2 from km",
    "planar_area": f"with {D['ca']} select comid, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 9) deg2 from (select comid, {_RING_EDGES} from ca) group by comid",
    "layer_bounds": f"with {D['ca']} select basin, min(list_min(rx)) xmin, min(list_min(ry)) ymin, max(list_max(rx)) xmax, max(list_max(ry)) ymax from ca group by basin",
    "sigfig_round": f"""with p as (select o_orderkey, cast(o_totalprice as double) x, -cast(o_totalprice as double) / 1000 y from orders)
select o_orderkey, {_sig('x', 3)} three, {_sig('y', 2)} two, round_even(x / 1000, 0) whole from p""",
    "percent_differences": f"""{_UNIT}, a as (select w.id, {_sig('uparea', 3)} u, uparea, area from w join o using (id) join rv using (comid)),
b as (select id, (u - area) / nullif(area, 0) * 100 p, abs((uparea - area) / nullif(area, 0)) pd from a)
select id, {_sig('p', 2)} perc_diff, round(pd, 6) pd from b""",
    "window_align": f"""with {D['ca']} select comid, round(floor(list_min(rx) * 1200) / 1200 - 0.000416667, 9) xmin, round(floor(list_min(ry) * 1200) / 1200 - 0.000416667, 9) ymin,
round(ceil(list_max(rx) * 1200) / 1200 + 0.000416667, 9) xmax, round(ceil(list_max(ry) * 1200) / 1200 + 0.000416667, 9) ymax from ca""",
    "raster_mask": f"with {X['f7']} select r, count(*) n_cells, cast(sum(fdir) as bigint) sum_fdir, min(c) \"first\", max(c) \"last\" from f7 where c + r % 64 * 2 >= 24 group by r",
    "raster_accumulation": f"{_ACC} select r, c, acc from cells",
    "raster_streams": f"{_ACC} select r, c, acc from cells where acc > 20",
    "snap_pour_point": f"""{_ACC}, p as (select cast(s_suppkey as varchar) id, s_suppkey * 37 % 64 pc, s_suppkey * 53 % (select max(r) + 1 from f7) pr from supplier)
select id, r, c from p join cells on pr // 64 = r // 64 where acc > 20 qualify row_number() over (partition by id order by pow(r - pr, 2) + pow(c - pc, 2), r, c) = 1""",
    "d8_upstream": f"{_TRACE} select o, k, depth from up",
    "polygonize_cells": f"{_TRACE} select o, x1, y1, x2, y2 from border",
    "split_terminal": f"""{_TRACE}, n as (select o, count(*) area from traced group by o)
select o, n.area, n_corners from n join (select o, count(*) n_corners from border group by o) using (o)""",
    "high_res_split": f"""{_ACC}, p as (select cast(s_suppkey as varchar) id, s_suppkey * 37 % 64 pc, s_suppkey * 53 % (select max(r) + 1 from f7) pr from supplier),
fd as (select r, c, fdir from f7 where fdir <> 0),
ms as (select cells.*, fdir, c // 16 comid from cells join fd using (r, c)),
sn as (select id, r, c, comid from p join ms on ms.comid = pc // 16 where acc > 20 qualify row_number() over (partition by id order by pow(r - pr, 2) + pow(c - pc, 2), r, c) = 1),
me as (select a.r sr, a.c sc, b.r dr, b.c dc from ms a join ms b on a.comid = b.comid and b.r = a.r + case a.fdir when 4 then 1 else 0 end and b.c = a.c + case a.fdir when 1 then 1 else 0 end),
tr(id, r, c) as (select id, r, c from sn union all select tr.id, me.sr, me.sc from tr join me on me.dr = tr.r and me.dc = tr.c)
select id, n_cells, n_cells size, round(-180 + sn.c / 1200 + 0.000416667, 6) lng_snap, round(90 - sn.r / 1200 - 0.000416667, 6) lat_snap
from sn join (select id, count(*) n_cells from tr group by id) using (id)""",
    "river_map_filter": f"""{_UNIT}, {_UP}, m as (select id, comid, ord, lengthkm, max(ord) over (partition by id) top from (select id, comid, min(depth) from up group by id, comid) join rv using (comid))
select id, comid, ord, round_even(lengthkm, 1) lengthkm, round(sqrt(ord), 6) width from m where ord >= top - 3""",
    "watershed_summary": f"{_SUMMARY} select * from summary",
    "watershed_summary_matched": _MATCHED,
    "watershed_polygons": _POLYGONS,
    "simplify_rings": _SIMPLIFIED,
    "snap_distance": f"""{_UNIT}, ends as (select w.id key, o.lat la1, o.lng lo1, line_lat[1] la2, line_lng[1] lo2 from w join o using (id) join rv using (comid)),
{_geodesic('ends')} select key id, w.comid, round(metres, 3) metres from g join w on w.id = g.key""",
    "close_slivers": f"""with {D['ca']}, e as (select comid, round(x1 / 2e-5::double) x1, round(y1 / 2e-5::double) y1, round(x2 / 2e-5::double) x2, round(y2 / 2e-5::double) y2 from (select comid, {_RING_EDGES} from ca))
select comid, count(*) n_edges from e where x1 <> x2 or y1 <> y2 group by comid""",
    "geojson_features": f"""with {D['ca']} select comid, '{{"type":"Feature","properties":{{"comid":' || comid || '}},"geometry":{{"type":"MultiPolygon","coordinates":[[' || {_coordinates('rx', 'ry')} || ']]}}}}' geojson from ca""",
    "river_map_features": f"""{_UNIT}, {_UP}, m as (select id, comid, ord, lengthkm, line_lng, line_lat, max(ord) over (partition by id) top from (select id, comid, min(depth) from up group by id, comid) join rv using (comid)),
fs as (select id, comid, '{{"type":"Feature","properties":{{"comid":' || comid || ',"ord":' || ord || coalesce(',"lengthkm":' || cast(lengthkm as varchar), '') || '}},"geometry":{{"type":"LineString","coordinates":' || {_coordinates('line_lng', 'line_lat')} || '}}}}' f from m where ord >= top - 3)
select id, '{{"type":"FeatureCollection","features":[' || string_agg(f, ',' order by comid) || ']}}' geojson from fs group by id""",
    "viewer_table": f"""{_SUMMARY} select id, coalesce("name", '') as "name", result, {_shown('lat', 3)} lat, {_shown('lng', 3)} lng, {_shown('lat_snap', 3)} lat_snap,
{_shown('lng_snap', 3)} lng_snap, {_shown('area_reported', 0)} area_reported, {_shown('area_calc', 0)} area_calc, {_shown('perc_diff', 0)} perc_diff from summary where result <> 'failed'""",
    "display_formats": f"with {D['o']} select id, {_shown('area', 0)} area, {_shown('lat', 3)} lat, {_shown('lng', 3)} lng from o",
}

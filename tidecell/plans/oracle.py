"""The same queries as DuckDB SQL."""

from __future__ import annotations


def _pattern(name: str, a: int, b: int) -> str:
    return f"""
 {name}2 as (select "row", "col", case when ("row" * {a} + "col" * {b}) % 10 < 6 then value + 50 end as value from blk),
 {name}n as (select dem."row", dem."col", w.value from dem join {name}2 w on w."row" = cast(floor(dem."row" / 5) as int) and w."col" = cast(floor(dem."col" / 5) as int)),
 {name}1 as (select dem."row", dem."col", case when n.value > dem.value then n.value end as value from dem join {name}n n using ("row", "col")),
 {name}h as (select dem."row", dem."col", greatest(coalesce(w.value - dem.value, 0), 0) as value from dem join {name}1 w using ("row", "col"))"""


#: dem; blk: block means; for each pattern p, q: p2 coarse water, pn nearest, p1 filtered, ph depth.
BASE = (
    """with recursive dem as (select cast(floor(o_orderkey / 100) as int) as "row", cast(o_orderkey % 100 as int) as "col", o_totalprice / 1000 as value from orders),
 blk as (select cast(floor("row" / 5) as int) as "row", cast(floor("col" / 5) as int) as "col", avg(value) as value from dem group by 1, 2),"""
    + _pattern("p", 7, 3)
    + ","
    + _pattern("q", 3, 7)
    + """,
 pair as (select p."row", p."col", q.value is not null as t, p.value is not null as p from p1 p join q1 q using ("row", "col")),
 code as (select "row", "col", case when t and p then 111 when t then 100 when p then 101 else 110 end as code from pair),
 marks as (select c_custkey as id, c_custkey % 100 + 0.5 as x, -(floor(c_custkey / 100) + 0.5) as y, greatest(c_acctbal / 100, 0) as water_depth,
   cast(floor(c_custkey / 100) as int) as "row", cast(c_custkey % 100 as int) as "col" from customer),
 sh(i, j) as (values (0, 1), (0, -1), (1, 0), (-1, 0)),
 lin as (select f."row", f."col", sum(case when c.value is not null then w * c.value else 0 end) / sum(case when c.value is not null then w else 0 end) as value
   from (select d."row", d."col", r2, c2, greatest(0, 1 - abs((d."row" + 0.5) / 5 - 0.5 - r2)) * greatest(0, 1 - abs((d."col" + 0.5) / 5 - 0.5 - c2)) as w
     from dem d, lateral (select cast(floor(d."row" / 5) as int) + a as r2, cast(floor(d."col" / 5) as int) + b as c2 from (values (-1), (0), (1)) t1(a), (values (-1), (0), (1)) t2(b)) n) f
   join p2 c on c."row" = r2 and c."col" = c2
   join p2 o on o."row" = cast(floor(f."row" / 5) as int) and o."col" = cast(floor(f."col" / 5) as int) and o.value is not null
   group by 1, 2),
 sf as (select dem."row", dem."col", case when lin.value > dem.value then lin.value end as value from dem left join lin using ("row", "col"))"""
)


def _b(sql: str) -> str:
    return BASE + "\n" + sql


def _cells(source: str, value: str = "round(value, 6)") -> str:
    return _b(f'select "row", "col", {value} as value from {source}')


def _buffer(name: str, source: str, filtered: bool = True) -> str:
    value = "case when coalesce(s.value, n.near) > d.value then coalesce(s.value, n.near) end" if filtered else "coalesce(s.value, n.near)"
    return f""" {name} as (select s."row", s."col", {value} as value from {source} s join dem d using ("row", "col")
   left join (select w."row" + i as "row", w."col" + j as "col", avg(value) as near from {source} w, sh where value is not null group by 1, 2) n using ("row", "col"))"""


def _clumps(source: str) -> str:
    """Labels by a recursion that keeps the least label known of each cell."""
    return f""" node as (select "row" * 100 + "col" as id, "row", "col" from {source} where value is not null),
 edge as (select a.id as a, b.id as b from node a, sh, node b where b."row" = a."row" + i and b."col" = a."col" + j),
 lab(id, root) using key (id) as (select id, id from node union
   select e.b, min(lab.root) from lab join edge e on e.a = lab.id join recurring.lab cur on cur.id = e.b group by e.b, cur.root having min(lab.root) < cur.root)"""


#: The same with eight neighbours.
_EIGHT = _clumps("p1").replace("node a, sh, node b", "node a, sh8, node b")
_SH8 = " sh8(i, j) as (select i, j from range(-1, 2) a(i), range(-1, 2) b(j) where i <> 0 or j <> 0),"
_TOP = "(select root from lab group by root order by count(*) desc, root limit 1)"
#: Pairs of a dry cell and a source within 16 cells, by tiles of 16.
_OCTILE = """ edgec as (select s.* from {src} s where value > 0),
 dry as (select "row", "col" from {src} where value is null),
 met as (select d."row", d."col", s.value, s."row" as sr, s."col" as sc, round(greatest(abs(d."row" - s."row"), abs(d."col" - s."col")) + (sqrt(2) - 1) * least(abs(d."row" - s."row"), abs(d."col" - s."col")), 9) as dist
   from dry d, lateral (select floor(d."row" / 16) + a as tr, floor(d."col" / 16) + b as tc from (values (-1), (0), (1)) t1(a), (values (-1), (0), (1)) t2(b)) n
   join edgec s on floor(s."row" / 16) = tr and floor(s."col" / 16) = tc),
 near as (select "row", "col", value from met where dist <= 16 qualify row_number() over (partition by "row", "col" order by dist, sr, sc) = 1),
 alloc as (select "row", "col", value from edgec union all select "row", "col", value from near)"""
_DONUT = """ ring as (select distinct d."row", d."col" from (select "row", "col" from pn where value is null) d
   join (select "row", "col" from pn where value is not null) w on w."row" between d."row" - 7 and d."row" + 7 and w."col" between d."col" - 7 and d."col" + 7
     and (w."row" - d."row") * (w."row" - d."row") + (w."col" - d."col") * (w."col" - d."col") <= 56.25),
 fill as (select r."row", r."col", s.value from ring r join p2 s on s.value is not null and abs(s."row" - floor(r."row" / 5)) <= 6 and abs(s."col" - floor(r."col" / 5)) <= 6
   qualify row_number() over (partition by r."row", r."col" order by round(abs(r."row" + 0.5 - (s."row" + 0.5) * 5) + abs(r."col" + 0.5 - (s."col" + 0.5) * 5), 9), s."row", s."col") = 1)"""
_SCORES = """cast(count(*) filter (t and p) as bigint) as "TP", cast(count(*) filter (not t and not p) as bigint) as "TN", cast(count(*) filter (not t and p) as bigint) as "FP", cast(count(*) filter (t and not p) as bigint) as "FN" from pair"""
_RATIOS = """select "TP", "TN", "FP", "FN", round("TP" / nullif("TP" + "FN", 0), 6) as "hitRate", round("FP" / nullif("TP" + "FP", 0), 6) as "falseAlarms",
  round("TP" / nullif("TP" + "FP" + "FN", 0), 6) as "criticalSuccessIndex", round("FP" / nullif("FN", 0), 6) as "errorBias" from counts"""
_ERRORS = """round(sum(p) / nullif(sum(t), 0), 6) as bias, round(sum(p) / nullif(sum(t), 0) - 1, 6) as bias_shift, round(avg(p - t), 6) as "meanError", round(avg(abs(p - t)), 6) as "meanErrorAbs",
  round(sqrt(avg((p - t) * (p - t))), 6) as "RMSE", round(corr(t, p), 6) as pearson, count(*) filter (t > 0 and p > 0) as "TP", count(*) filter (t <= 0 and p > 0) as "FP",
  count(*) filter (t <= 0 and p <= 0) as "TN", count(*) filter (t > 0 and p <= 0) as "FN" """
_EDGES = """ ring(n, x, y) as (values (0, 10.2, -1.3), (1, 70.7, -2.1), (2, 90.4, -9.6), (3, 40.1, -13.9), (4, 5.3, -8.2)),
 seg as (select cast(a.x as double) as x1, cast(a.y as double) as y1, cast(b.x as double) as x2, cast(b.y as double) as y2 from ring a join ring b on b.n = (a.n + 1) % 5),
 hit as (select d."row", d."col", d.value, count(*) filter ((y1 > -(d."row" + 0.5)) <> (y2 > -(d."row" + 0.5)) and d."col" + 0.5 < x1 + (-(d."row" + 0.5) - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1 as wet from dem d, seg group by 1, 2, 3)"""
#: Zones and their holes as boxes, and the unit squares of each.
_ZONES = """zone as (select s_suppkey as poly_id, s_name as name, cast(s_nationkey as bigint) as nation, cast((s_suppkey * 37) % 90 as double) as x, cast(-((s_suppkey * 11) % 12) - 12 as double) as y, cast(6 + s_nationkey % 5 as double) as s from supplier),
 unit as (select poly_id, nation, cast(x as int) + i as ux, cast(y as int) + j as uy from zone, lateral (select unnest(range(cast(s as int))) as i), lateral (select unnest(range(cast(s as int))) as j) where not (i in (1, 2) and j in (1, 2)))"""


def _shared(z: str, x0, y0, x1, y1) -> str:
    """The area that a zone shares with a box, its hole taken off."""
    part = lambda x, y, s: f"greatest(0, least({z}.{x}, {x1}) - greatest({z}.{s[0]}, {x0})) * greatest(0, least({z}.{y}, {y1}) - greatest({z}.{s[1]}, {y0}))"
    whole = part("x + " + z + ".s", "y + " + z + ".s", ("x", "y"))
    hole = part("x + 3", "y + 3", ("x + 1", "y + 1"))
    return f"({whole} - {hole})"


def _pvalue(pairs: str) -> str:
    """A line for each flag of (l_returnflag, x, y), and the two-sided tail of Student's t by Simpson's rule."""
    return f"""with r as (select l_returnflag, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, corr(x, y) as rvalue, cast(regr_count(y, x) as bigint) as n,
   sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (regr_sxx(y, x) * (regr_count(y, x) - 2))) as stderr from ({pairs}) group by 1),
 a as (select *, n - 2 as dof, atan(abs(slope / stderr) / sqrt(n - 2)) as low from r),
 area as (select l_returnflag, (pi() / 2 - any_value(low)) / 6000 * sum(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * pow(cos(low + i * (pi() / 2 - low) / 2000), dof - 1)) as v
   from a, range(2001) t(i) group by 1)
select l_returnflag, round(slope, 6) as slope, round(intercept, 6) as intercept, round(rvalue, 6) as rvalue, round(stderr, 6) as stderr, n,
  round(least(1, 2 * v * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi())), 6) as pvalue from a join area using (l_returnflag)"""


ORACLES = {
    "resample_nearest": _cells("pn"),
    "resample_bilinear": _cells("lin"),
    "aggregate_mean": _cells("blk"),
    "block_reduce_minmax": _b('select cast(floor("row" / 5) as int) as "row", cast(floor("col" / 5) as int) as "col", round(min(value), 6) as low, round(max(value), 6) as high from dem group by 1, 2'),
    "clip_window": _b('select "row" - 5 as "row", "col" - 20 as "col", round(value, 6) as value from dem where "row" between 5 and 14 and "col" between 20 and 79'),
    "clip_pair_extent": _b("""select 'wse2' as grid, "row" - 1 as "row", "col" - 4 as "col", round(value, 6) as value from p2 where "row" between 1 and 2 and "col" between 4 and 15
      union all select 'dem', "row" - 5, "col" - 20, round(value, 6) from dem where "row" between 5 and 14 and "col" between 20 and 79"""),
    "cell_centres": _b('select "row", "col", round(value, 6) as value, 100 + ("col" + 0.5) * 4.0 as x, 900 - ("row" + 0.5) * 4.0 as y from dem').replace("100 + (", "cast(100 as double) + (").replace("900 - (", "cast(900 as double) - ("),
    "merge_grids": _b('select "row", "col", round(coalesce(p.value, q.value), 6) as value from p1 p join q1 q using ("row", "col")'),
    "terrain_filter": _cells("p1"),
    "terrain_violations": _b('select count(n.value) as wet_before, count(*) filter (n.value > d.value) as wet_after, count(*) filter (n.value <= d.value) as violations from pn n join dem d using ("row", "col")'),
    "depth_from_wse": _cells("ph"),
    "wse_from_depth": _b('select "row", "col", round(case when h.value > 0 then h.value + d.value end, 6) as value from ph h join dem d using ("row", "col")'),
    "inundation_mask": _b('select "row", "col", value > 0 as wet from ph'),
    "clean_depth": _b('select "row", "col", round(case when w.value is not null then greatest(w.value - d.value - 30, 0) end, 6) as value from p1 w join dem d using ("row", "col")'),
    "mask_apply": _b('select "row", "col", round(case when q.value is not null then p.value end, 6) as value from p1 p join q1 q using ("row", "col")'),
    "mosaic": _cells("p1"),
    "raster_calc": _cells("dem", "round(sqrt(value) * 2 - 1, 6)"),
    "confusion_grid": _b('select "row", "col", code from code'),
    "element_bias": _b('select "row", "col", round(case when q.value = 0 and p.value = 0 then 1.0 when q.value <> 0 and p.value <> 0 then p.value / q.value end, 6) as bias from ph p join qh q using ("row", "col")'),
    "threshold_mask": _cells("dem", "case when value >= 100 - 0.001 and value <= 200 + 0.001 then cast(1 as double) end"),
    "display_depths": _cells("ph", "round(nullif(value, 0), 6)"),
    "round_to_multiple": _cells("dem", "round(5.0 * round_even(value / 5.0, 0), 6)"),
    "mask_invert": _cells("p1", "case when value is null then cast(1 as double) end"),
    "boolean_select": "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')",
    "buffer_d4": BASE + "," + _buffer("g1", "p1", False) + '\nselect "row", "col", round(value, 6) as value from g1',
    "buffer_grow_3": BASE + "," + ",".join([_buffer("g1", "p1"), _buffer("g2", "g1"), _buffer("g3", "g2")]) + '\nselect "row", "col", round(value, 6) as value from g3',
    "clumps": BASE + "," + _clumps("p1") + '\nselect n."row", n."col", cast(l.root as bigint) as label from lab l join node n using (id)',
    "largest_clump": BASE + "," + _clumps("p1") + f"""\nselect p."row", p."col", round(case when l.root = {_TOP} then p.value end, 6) as value from p1 p left join lab l on l.id = p."row" * 100 + p."col" """,
    "search_donut": BASE + "," + _DONUT + '\nselect "row", "col" from ring',
    "knn_fill": BASE + "," + _DONUT + '\nselect "row", "col", round(value, 6) as value from fill',
    "cost_allocation": BASE + "," + _OCTILE.format(src="p1") + '\nselect "row", "col", round(value, 6) as value from alloc',
    "focal_mean": _b('select d."row", d."col", round(avg(n.value), 6) as value from dem d join dem n on n."row" between d."row" - 1 and d."row" + 1 and n."col" between d."col" - 1 and d."col" + 1 group by 1, 2'),
    "pixels_to_points": _b('select "col" + 0.5 as x, -("row" + 0.5) as y, round(value, 6) as value from p1 where value is not null').replace('"col" + 0.5 as x, -("row" + 0.5) as y', 'cast("col" + 0.5 as double) as x, cast(-("row" + 0.5) as double) as y'),
    "idw_interpolation": _b("""select b."row", b."col", round(sum(water_depth / pow(greatest(d, 1e-9), 2)) / sum(1 / pow(greatest(d, 1e-9), 2)), 6) as value from (
      select b."row", b."col", m.water_depth, sqrt(pow((b."col" + 0.5) * 5 - m.x, 2) + pow((b."row" + 0.5) * 5 + m.y, 2)) as d from blk b join marks m on abs((b."col" + 0.5) * 5 - m.x) <= 6 and abs((b."row" + 0.5) * 5 + m.y) <= 6) b where d <= 6 group by 1, 2"""),
    "method_basic": _b('select dem."row", dem."col", round(lin.value, 6) as value from dem left join lin using ("row", "col")'),
    "method_simple_filter": _cells("sf"),
    "method_buffer_grow": BASE + "," + ",".join([_buffer("g1", "sf"), _buffer("g2", "g1")]) + '\nselect "row", "col", round(value, 6) as value from g2',
    "method_cost_grow": BASE + "," + _OCTILE.format(src="p1") + """,
 top as (select d."row", d."col", case when a.value > d.value then a.value end as value from dem d join alloc a using ("row", "col")),""" + _clumps("top") + f"""
select t."row", t."col", round(case when l.root = {_TOP} then t.value end, 6) as value from top t left join lab l on l.id = t."row" * 100 + t."col" """,
    "method_cost_grow_bilinear": BASE + "," + _OCTILE.format(src="sf").replace("/ 16", "/ 32").replace("<= 16", "<= 32") + """,
 top as (select d."row", d."col", case when a.value > d.value then a.value end as value from dem d join alloc a using ("row", "col")),""" + _clumps("top") + f"""
select t."row", t."col", round(case when l.root = {_TOP} then t.value end, 6) as value from top t left join lab l on l.id = t."row" * 100 + t."col" """,
    "method_buffer_grow_loop": BASE + """,
 grow as (select 0 as n, "row", "col", value from sf union all
   select s.n + 1, s."row", s."col", case when coalesce(s.value, m.near) > d.value then coalesce(s.value, m.near) end from grow s join dem d using ("row", "col")
   left join (select w."row" + i as "row", w."col" + j as "col", avg(value) as near from grow w, sh where value is not null group by 1, 2) m using ("row", "col") where s.n < 30)
select "row", "col", round(value, 6) as value from grow where n = 30""",
    "fill_nodata": _b("""select p."row", p."col", round(coalesce(p.value, n.near), 6) as value from p1 p left join (
      select a."row", a."col", sum(b.value / (pow(a."row" - b."row", 2) + pow(a."col" - b."col", 2))) / sum(1 / (pow(a."row" - b."row", 2) + pow(a."col" - b."col", 2))) as near
      from p1 a join p1 b on b."row" between a."row" - 3 and a."row" + 3 and b."col" between a."col" - 3 and a."col" + 3
      where a.value is null and b.value is not null and pow(a."row" - b."row", 2) + pow(a."col" - b."col", 2) <= 9 group by 1, 2) n using ("row", "col")"""),
    "method_schumann": BASE + "," + _DONUT + """
select d."row", d."col", round(case when coalesce(n.value, f.value) > d.value then coalesce(n.value, f.value) end, 6) as value from dem d join pn n using ("row", "col") left join fill f using ("row", "col")""",
    "sample_points": _b('select id, water_depth, round(h.value, 6) as value from (select id, round(water_depth, 6) as water_depth, "row", "col" from marks) m left join ph h using ("row", "col")'),
    "sample_confusion": _b("""select case code when 111 then 'TP' when 110 then 'TN' when 101 then 'FP' else 'FN' end as label, count(*) as n from marks join code using ("row", "col") group by 1"""),
    "hillshade": _b("""select "row", "col", round(255 * case when shade < 0 then 0 else shade end, 6) as value from (
  select "row", "col", (sin(pi() / 4) - cos(pi() / 4) * (dx * cos(pi() * 3 / 4) + dy * sin(pi() * 3 / 4))) / sqrt(1 + dx * dx + dy * dy) as shade from (
  select "row", "col", (lead(value) over across - lag(value) over across) / 20 as dx, (lag(value) over down - lead(value) over down) / 20 as dy from dem
  window across as (partition by "row" order by "col"), down as (partition by "col" order by "row")))"""),
    "points_in_polygon": BASE + "," + _EDGES + '\nselect id from marks join hit using ("row", "col") where wet',
    "rasterize_polygon": BASE + "," + _EDGES + '\nselect "row", "col", wet from hit',
    "zonal_stats": BASE + "," + _EDGES + """\nselect cast(0 as bigint) as poly_id, count(value) as count, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(sum(value), 6) as sum,
  round(stddev_pop(value), 6) as std, round(median(value), 6) as median from hit where wet""",
    "polygon_areas": BASE + "," + _clumps("p1") + "\nselect cast(root as bigint) as poly_id, cast(count(*) as double) as area from lab group by root",
    "polygon_clip_area": f"with {_ZONES} select * from (select cast(poly_id as bigint) as poly_id, round({_shared('zone', 20.5, -19.25, 60.25, -9.5)}, 6) as area from zone) where area > 0",
    "polygon_intersection": f"with {_ZONES} select * from (select cast(poly_id as bigint) as poly_id, round({_shared('zone', 30.25, -20.5, 70.5, -11.25)}, 6) as area from zone) where area > 0",
    "polygon_centroid": f"with {_ZONES} select cast(poly_id as bigint) as poly_id, s * s - 4 as area, round((s * s * (x + s / 2) - 4 * (x + 2)) / (s * s - 4), 6) as x, round((s * s * (y + s / 2) - 4 * (y + 2)) / (s * s - 4), 6) as y from zone",
    "overlay_intersection": f"with {_ZONES} select cast(a.poly_id as bigint) as a, cast(b.poly_id as bigint) as b, cast(count(*) as double) as area, round(avg(a.ux + 0.5), 6) as x, round(avg(a.uy + 0.5), 6) as y from unit a join unit b using (ux, uy) where a.poly_id % 2 = 0 and b.poly_id % 2 = 1 group by 1, 2",
    "overlay_symmetric_difference": f"""with {_ZONES}, u0 as (select * from unit where poly_id % 3 = 0), u1 as (select * from unit where poly_id % 3 = 1)
select 'a' as side, cast(poly_id as bigint) as poly_id, cast(count(*) as double) as area from u0 anti join u1 using (ux, uy) group by 2 union all select 'b', cast(poly_id as bigint), cast(count(*) as double) from u1 anti join u0 using (ux, uy) group by 2""",
    "simplified_zones": f"""with {_ZONES}, corner(n, i, j) as (values (0, 0, 0), (2, 1, 0), (4, 1, 1), (6, 0, 1)), inner_(n, i, j) as (values (0, 1, 1), (2, 1, 3), (4, 3, 3), (6, 3, 1))
select cast(poly_id as bigint) as poly_id, 0 as ring, n as seq, x + i * s as x, y + j * s as y from zone, corner union all select cast(poly_id as bigint), 1, n, x + i, y + j from zone, inner_""",
    "poles_of_zones": f"with {_ZONES} select cast(poly_id as bigint) as poly_id, x + s / 2 as x, y + s / 2 as y, s / 2 as distance from zone",
    "metadata_write_read": _b("""select 'dem' as tab, cast(max("row") + 1 as int) as height, cast(max("col") + 1 as int) as width from dem union all select 'wse2', cast(max("row") + 1 as int), cast(max("col") + 1 as int) from blk"""),
    "zone_relations": f"""with {_ZONES}, rim as (select poly_id, x + i as px, y + j as py from zone, lateral (select unnest(range(cast(s as int) + 1)) as i), lateral (select unnest(range(cast(s as int) + 1)) as j) where i in (0, s) or j in (0, s) or (i in (1, 3) and j between 1 and 3) or (j in (1, 3) and i between 1 and 3)),
 size as (select poly_id, count(*) as n from unit group by 1),
 ii as (select a.poly_id as a, b.poly_id as b, count(*) as n from unit a join unit b using (ux, uy) where a.poly_id % 2 = 0 and b.poly_id % 2 = 1 group by 1, 2),
 bb as (select distinct a.poly_id as a, b.poly_id as b from rim a join rim b using (px, py) where a.poly_id % 2 = 0 and b.poly_id % 2 = 1),
 every as (select coalesce(ii.a, bb.a) as a, coalesce(ii.b, bb.b) as b, coalesce(n, 0) as n, bb.a is not null as bb from ii full join bb on ii.a = bb.a and ii.b = bb.b)
select cast(a as bigint) as a, cast(b as bigint) as b, every.n > 0 as ii, every.n < x.n as ie, every.n < y.n as ei, bb from every join size x on x.poly_id = a join size y on y.poly_id = b""",
    "zones_that_overlap": f"""with {_ZONES}, size as (select poly_id, count(*) as n from unit group by 1),
 ii as (select a.poly_id as a, b.poly_id as b, count(*) as n from unit a join unit b using (ux, uy) where a.poly_id % 2 = 0 and b.poly_id % 2 = 1 group by 1, 2)
select distinct cast(a as bigint) as poly_id from ii join size x on x.poly_id = a join size y on y.poly_id = b where ii.n < x.n and ii.n < y.n""",
    # a side of a hull: two points with none on its right; none between them on it
    "hulls_of_nations": """with p as (select distinct c_nationkey as k, cast(c_custkey % 100 as double) as x, cast(floor(c_custkey / 100) as double) as y from customer),
 side as (select a.k, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from p a join p b on a.k = b.k and (a.x <> b.x or a.y <> b.y) where not exists (
   select 1 from p c where c.k = a.k and ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 or ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 and ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 or (c.x - b.x) * (a.x - b.x) + (c.y - b.y) * (a.y - b.y) < 0)))))
select cast(k as bigint) as poly_id, round(sum(x1 * y2 - x2 * y1) / 2, 6) as area, count(*) as corners from side group by k""",
    "dissolved_zones": f"""with {_ZONES}, spot as (select distinct nation, ux, uy from unit), sh(i, j) as (values (0, 1), (0, -1), (1, 0), (-1, 0)),
 met as (select a.nation, count(*) as n from spot a, sh join spot b on b.nation = a.nation and b.ux = a.ux + i and b.uy = a.uy + j group by 1)
select nation, cast(count(*) as double) as area, cast(4 * count(*) - coalesce(any_value(met.n), 0) as double) as length from spot left join met using (nation) group by nation""",
    "zonal_order_statistics": BASE + ", " + _ZONES + """, v as (select poly_id, floor(value / 10) as v from unit join dem on dem."col" = ux and dem."row" = -uy - 1),
 n as (select poly_id, v, count(*) as n from v group by 1, 2)
select cast(poly_id as bigint) as poly_id, count(*) as count, count(distinct v) as unique, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr,
  (select arg_min(n.v, (n.n, n.v)) from n where n.poly_id = v.poly_id) as minority, (select arg_min(n.v, (-n.n, n.v)) from n where n.poly_id = v.poly_id) as majority from v group by poly_id""",
    "location_summaries": BASE + ", " + _ZONES + """, v as (select poly_id, round(water_depth, 0) as v from unit join marks on marks."col" = ux and marks."row" = -uy - 1),
 n as (select poly_id, v, count(*) as n from v group by 1, 2)
select cast(z.poly_id as bigint) as poly_id, count(v.v) as count, round(sum(v.v), 6) as sum, round(avg(v.v), 6) as mean, min(v.v) as min, max(v.v) as max, round(stddev_pop(v.v), 6) as stddev, max(v.v) - min(v.v) as range, case when count(v.v) > 0 then count(distinct v.v) end as unique,
  quantile_cont(v.v, 0.25) as q1, quantile_cont(v.v, 0.5) as median, quantile_cont(v.v, 0.75) as q3, quantile_cont(v.v, 0.75) - quantile_cont(v.v, 0.25) as iqr,
  (select arg_min(n.v, (n.n, n.v)) from n where n.poly_id = z.poly_id) as minority, (select arg_min(n.v, (-n.n, n.v)) from n where n.poly_id = z.poly_id) as majority from zone z left join v on v.poly_id = z.poly_id group by z.poly_id""",
    "polygons_write_read": f"with {_ZONES} select cast(poly_id as bigint) as poly_id, cast(2 as int) as rings, name, nation from zone where x <= 40.5 and x + s >= 20.5",
    "resolution_ratio": _b('select cast((select max("col") + 1 from dem) as double) / (select max("col") + 1 from blk) as ratio, cast(5 as double) as support, (select max("row") + 1 from dem) % 5 = 0 and (select max("col") + 1 from dem) % 5 = 0 as divisible'),
    "grid_extents": _b("""select grid_id, cast(100 as double) as xmin, 900.0 - h * res as ymin, cast(100 + w * res as double) as xmax, cast(900 as double) as ymax, true as simple, (select count(distinct w * res) from (
      select max("col") + 1 as w, 1 as res from dem union all select max("col") + 1, 5 from blk)) = 1 as same_width, true as same_crs
      from (select 'dem' as grid_id, max("row") + 1 as h, max("col") + 1 as w, cast(1 as double) as res from dem union all select 'wse2', max("row") + 1, max("col") + 1, 5 from blk)""").replace("900.0 - h", "cast(900 as double) - h"),
    "layer_checks": "select unnest(['marks', 'both']) as layer, unnest([true, (select count(*) from supplier) = 0]) as points_only",
    "random_points_in_box": 'select count(*) as n, true as "left", true as "right", true as low, true as high, true as spread from customer',
    "ols_with_dummies": """with p as (select l_returnflag as g, cast(l_quantity as double) as x, cast(l_extendedprice as double) / 1000 as y from lineitem),
 f as (select g, count(*) as n, avg(x) as mx, avg(y) as my, regr_sxx(y, x) as sxx, regr_sxy(y, x) as sxy, regr_syy(y, x) as syy from p group by 1),
 t as (select sum(sxy) / sum(sxx) as b, sum(sxx) as sxx, (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) as v from f),
 base as (select f.* from f where g = (select min(g) from f)),
 r as (select 'x' as name, b as coef, sqrt(v / sxx) as stderr from t
  union all select 'l_returnflag[' || f.g || ']', (f.my - b * f.mx) - (base.my - b * base.mx), sqrt(v * (1 / f.n + 1 / base.n + (f.mx - base.mx) * (f.mx - base.mx) / t.sxx)) from f, base, t where f.g <> base.g
  union all select 'intercept', base.my - b * base.mx, sqrt(v * (1 / base.n + base.mx * base.mx / t.sxx)) from base, t)
select name, round(coef, 6) as coef, round(stderr, 6) as stderr, round(coef / stderr, 6) as t from r""",
    "logit_of_labels": """with c as (select count(*) filter (quality = 1 and toxic = 1) as a, count(*) filter (quality = 0 and toxic = 1) as b, count(*) filter (quality = 1 and toxic = 0) as c, count(*) filter (quality = 0 and toxic = 0) as d from labels)
select '1:toxic' as name, round(ln(a * d / (b * c)), 4) as coef, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 4) as stderr from c union all select '1:intercept', round(ln(c / d), 4), round(sqrt(1 / c + 1 / d), 4) from c""",
    "results_wide": BASE + f""", one as (select p as p, t as t from pair), two as (select t as p, t as t from pair),
 s1 as ({_RATIOS.replace("from counts", "from (select " + _SCORES.replace("from pair", "from one") + ")")}), s2 as ({_RATIOS.replace("from counts", "from (select " + _SCORES.replace("from pair", "from two") + ")")}),
 u as (select 'one' as sim, * from (unpivot (select columns(*)::double from s1) on columns(*) into name var_name value val) union all select 'two', * from (unpivot (select columns(*)::double from s2) on columns(*) into name var_name value val))
select var_name, max(val) filter (sim = 'one') as one, max(val) filter (sim = 'two') as two from u group by 1""",
    # corners and holes from the 2 x 2 squares that an area's cells are in, by how many and which of the four they are
    "outlines_with_holes": BASE + "," + _SH8 + _EIGHT + """,
 spot as (select l.root, n."row", n."col" from lab l join node n using (id)),
 quad as (select root, "row" + i as r, "col" + j as c, count(*) as n, sum(1 << (2 * i + j)) as b from spot, range(2) s(i), range(2) t(j) group by 1, 2, 3),
 quads as (select root, sum(case when n % 2 = 1 then 1 when n = 2 and b in (6, 9) then 2 else 0 end) as corners, sum(case when n = 1 then 1 when n = 3 then -1 when n = 2 and b in (6, 9) then -2 else 0 end) / 4 as euler from quad group by 1),
 sides as (select a.root, count(b.root) as met from spot a cross join sh left join spot b on b.root = a.root and b."row" = a."row" + i and b."col" = a."col" + j group by 1)
select cast(root as bigint) as poly_id, cast(count(*) as double) as area, cast(4 * count(*) - any_value(met) as bigint) as perimeter, cast(any_value(corners) as bigint) as corners, cast(1 - any_value(euler) as bigint) as holes
  from spot join quads using (root) join sides using (root) group by root""",
    "filled_terrain": BASE + "," + _SH8 + """
 cell as (select "row" * 100 + "col" as id, d.* from dem d),
 nxt as (select a.id as a, b.id as b, b.value from cell a, sh8, cell b where b."row" = a."row" + i and b."col" = a."col" + j),
 rim as (select a as id from nxt group by a having count(*) < 8),
 lev(id, level) using key (id) as (select id, case when id in (select id from rim) then value else 1e300 end from cell union
   select n.b, min(greatest(lev.level, n.value)) from lev join nxt n on n.a = lev.id join recurring.lev cur on cur.id = n.b where lev.level < 1e300 group by n.b, cur.level having min(greatest(lev.level, n.value)) < cur.level)
select c."row", c."col", round(l.level, 6) as value from lev l join cell c using (id)""",
    "breached_terrain": _b("select count(*) as n, cast(0 as bigint) as to_fill, cast(0 as bigint) as lifted, true as lowered, round(min(value), 6) as least from dem"),
    "area_of_clumps": BASE + "," + _clumps("p1") + """\nselect cast(l.root as bigint) as label, cast(count(*) as double) as area, round(avg(n."col" + 0.5), 6) as x, round(avg(-(n."row" + 0.5)), 6) as y from lab l join node n using (id) group by 1""",
    "observed_extent": BASE + "," + _EDGES + '\nselect "row", "col", wet from hit',
    "points_outside_polygon": BASE + "," + _EDGES + '\nselect m.id from marks m left join hit h using ("row", "col") where not coalesce(h.wet, false)',
    "join_by_location": BASE + "," + _EDGES + """\nselect cast(0 as bigint) as poly_id, count(*) as count, round(sum(water_depth), 6) as sum, round(avg(water_depth), 6) as mean, round(min(water_depth), 6) as min, round(max(water_depth), 6) as max
      from marks join hit using ("row", "col") where wet""",
    "bbox_of_points": _b("select cast(min(x) as double) as xmin, min(y) as ymin, cast(max(x) as double) as xmax, max(y) as ymax from marks"),
    "bbox_overlap": _b("""select cast(max(a) as double) as xmin, max(b) as ymin, cast(min(c) as double) as xmax, min(d) as ymax from (select min(x) as a, min(y) as b, max(x) as c, max(y) as d from marks group by id % 3) having min(c) > max(a) and min(d) > max(b)"""),
    "inundation_metrics": BASE + f", counts as (select {_SCORES})\n{_RATIOS}",
    "confusion_selfcheck": _b("""select label, n as by_grid, n as by_count, true as equal from (select unnest(['TP', 'TN', 'FP', 'FN']) as label, unnest([count(*) filter (code = 111), count(*) filter (code = 110), count(*) filter (code = 101), count(*) filter (code = 100)]) as n from code)"""),
    "wsh_stats": _b("select round(avg(value), 6) as mean, cast(count(*) filter (value > 0) * 16 as double) as posi_area, round(sum(value) * 16, 6) as vol from ph"),
    "raster_stats": _b("""select round(max(value), 3) as max, round(min(value), 3) as min, round(avg(value), 3) as mean, count(*) filter (value is null) as null_cnt, count(value) as real_cnt, count(*) as size, round(sum(value), 3) as sum, round(sum(value), 3) as volume from p1"""),
    "unique_values": _b("select distinct round(value, 0) as value from dem"),
    "grid_checks": _b("""select grid, count(value) = count(*) as is_dem, count(value) > 0 and count(value) < count(*) as is_wse, count(value) = count(*) and min(value) = 0 and max(value) > 0 as is_wsh from (
      select 'dem' as grid, value from dem union all select 'wse', value from p1 union all select 'wsh', value from ph) group by grid"""),
    "partial_wet": _b("select bool_or(p) and not bool_and(p) as partial from pair"),
    "error_metrics": f"select {_ERRORS} from (select l_extendedprice / 1000 as t, l_quantity * l_tax * 20 - 5 as p from lineitem)",
    "hwm_validation": _b(f'select {_ERRORS} from (select water_depth as t, h.value as p from marks join ph h using ("row", "col"))'),
    "label_confusion": "select cast(quality as varchar) as \"true\", count(*) filter (toxic = 0) as pred_0, count(*) filter (toxic = 1) as pred_1 from labels group by 1",
    "linear_regression": """select l_returnflag, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(corr(x, y), 6) as rvalue,
      round(sqrt((1 - regr_r2(y, x)) * regr_syy(y, x) / (regr_sxx(y, x) * (regr_count(y, x) - 2))), 6) as stderr, cast(regr_count(y, x) as bigint) as n from (select l_returnflag, l_quantity as x, l_extendedprice / 1000 as y from lineitem) group by 1""",
    "histogram_diff": "select cast(greatest(least(floor(value / 2.0), 29), 0) as int) as bin, count(*) as n from events where value is not null group by 1",
    "quantile_range": _b("select round(quantile_cont(value, 0.02), 6) as low, round(quantile_cont(value, 0.98), 6) as high, round(quantile_cont(value, 0.98) - quantile_cont(value, 0.02), 6) as spread from dem"),
    "density_of_values": "select event_type, x, round(avg(exp(-0.5 * pow((x - value) / 2.5, 2)) / (2.5 * sqrt(2 * pi()))), 6) as density from events, (select unnest([cast(1 as double), 5, 20]) as x) where value is not null group by 1, 2",
    "random_analog_share": _b("select count(*) as n, cast(ceil(count(*) * 0.37) as bigint) as dry, true as within from dem"),
    "histogram_of_errors": _b('select cast(greatest(least(floor((h.value - water_depth + 150) / 10), 29), 0) as int) as bin, count(*) as n from marks join ph h using ("row", "col") where h.value > 0 group by 1'),
    "line_through_origin": "select l_returnflag, round(greatest(sum(x * y) / sum(x * x), 0), 6) as slope, count(*) as n from (select l_returnflag, cast(l_quantity as double) as x, cast(l_extendedprice as double) / 1000 as y from lineitem) group by 1",
    "distance_pairs": _b("select a.id as a, b.id as b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) as distance from marks a join marks b on a.id < b.id and abs(a.x - b.x) <= 1.5 and abs(a.y - b.y) <= 1.5 and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2.25"),
    "asc_write_read": _b("""select r."row", c."col", round(dem.value, 6) as value from (select cast(unnest(range((select max("row") + 1 from dem))) as int) as "row") r
      cross join (select cast(unnest(range((select max("col") + 1 from dem))) as int) as "col") c left join dem using ("row", "col")"""),
    "asc_window": _b('select "row", "col", round(value, 6) as value from p1 where "row" between 2 and 8 and "col" between 10 and 59'),
    "tiled_depth": _cells("ph"),
    "tiled_window": _b('select "row", "col", round(value, 6) as value from p1 where "row" between 2 and 8 and "col" between 10 and 59'),
    "grid_write_read": _b('select "row", "col", round(value, 6) as value from p1 where "row" between 2 and 8 and "col" between 10 and 59'),
    "points_write_read": _b("select id, cast(x as double) as x, cast(y as double) as y, round(water_depth, 6) as water_depth from marks where x between 10 and 40"),
    "mask_kinds": _b('select "row", "col", value is null as binary, value is null as native from p1'),
    "inundation_raster": _b('select "row", "col", cast(case when p then 0 else 1 end as double) as value from pair'),
    "sentinel_values": _b('select "row", "col", round(cast(cast(coalesce(value, -9999) as float) as double), 2) as value from p1'),
    "dry_cells": _b('select "row", "col", value = 0 as dry from ph'),
    "mask_replace": _b('select "row", "col", round(case when q.value is not null then coalesce(p.value, -1) end, 6) as value from p1 p join q1 q using ("row", "col")'),
    "mask_multiply": _cells("dem", "case when value >= 100 - 0.001 and value <= 200 + 0.001 then round(value, 6) end"),
    "basic_stats": _b("select round(min(value), 6) as min, round(avg(value), 6) as mean, round(max(value), 6) as max from p1"),
    "error_metrics_normed": f"""select l_returnflag, bias, bias_shift, "meanError", "meanErrorAbs", "RMSE", pearson, round("TP" / n, 6) as "TP", round("FP" / n, 6) as "FP", round("TN" / n, 6) as "TN", round("FN" / n, 6) as "FN"
      from (select l_returnflag, count(*) as n, {_ERRORS} from (select l_returnflag, l_extendedprice / 1000 as t, l_quantity * l_tax * 20 - 5 as p from lineitem) group by 1)""",
    "mask_checks": _b("""select grid, count(value) = count(*) and count(*) filter (value not in (0, 1)) = 0 and count(*) filter (value = 0) > 0 as is_inun,
      count(value) = count(*) and count(*) filter (value not in (0, 1)) = 0 as is_binary_mask, count(*) filter (value <> 1) = 0 as is_native_mask from (
      select 'inun' as grid, case when p then 0 else 1 end as value from pair union all select 'native', case when value between 100 - 0.001 and 200 + 0.001 then 1 end from dem union all select 'wsh', value from ph) group by 1"""),
    "identical_pair": _b("select count(*) filter (t <> p) = 0 as identical from pair union all select true"),
    "nodata_points": _b("select id, round(water_depth, 6) as value from marks where id % 7 <> 0"),
    "unknown_words": "select distinct o_orderpriority from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "regression_pvalue": _pvalue("select l_returnflag, l_quantity as x, l_extendedprice / 1000 as y from lineitem"),
    "regression_weak": _pvalue("select l_returnflag, cast(l_tax as double) * 100 as x, l_quantity as y from lineitem"),
    "grid_profiles": _b("""select grid_id, 3857 as crs_epsg, cast(max("row") + 1 as int) as height, cast(max("col") + 1 as int) as width, cast(100 as double) as x0, cast(900 as double) as y0, cast(2 as double) as res, cast(-9999 as double) as nodata
      from (select 'dem' as grid_id, "row", "col" from dem union all select 'wse2', "row", "col" from p2) group by 1"""),
    "converted_grids": _b('select "row", "col", round(case when h.value > 0 then h.value + d.value end, 6) as value, h.value > 0 as wet, w.value is not null as also from ph h join dem d using ("row", "col") join p1 w using ("row", "col")'),
    "set_report": """select count(*) filter (s = 1) as diff_left, count(*) filter (s = 2) as diff_right, count(*) as "union", count(*) filter (s = 3) as intersection, count(*) filter (s < 3) as symdiff
      from (select k, bit_or(s) as s from (select c_custkey as k, 1 as s from customer union all select o_custkey, 2 from orders) group by k)""",
    "multires_volume_pivot": _b("""select sim, round(sum(h) filter (dscale = 1), 3) as d10, round(sum(h) filter (dscale = 5), 3) as d50 from (
      select 'Basic' as sim, 1 as dscale, greatest(coalesce(lin.value - dem.value, 0), 0) as h from dem left join lin using ("row", "col")
      union all select 'SimpleFilter', 1, greatest(coalesce(sf.value - dem.value, 0), 0) from dem join sf using ("row", "col")
      union all select m, 5, greatest(coalesce(p2.value - blk.value, 0), 0) * 25 from blk join p2 using ("row", "col"), (values ('Basic'), ('SimpleFilter')) t(m)) group by sim"""),
    "validation_in_aoi": BASE + """, sims as (select 'Basic' as sim_name, lin."row", lin."col", lin.value from dem join lin using ("row", "col") union all select 'SimpleFilter', "row", "col", value from sf),
 cmp as (select k.sim_name, d."row", d."col", coalesce(s.value > d.value, false) as p, q.value is not null as t from (select distinct sim_name from sims) k cross join dem d join q1 q using ("row", "col") left join sims s on s.sim_name = k.sim_name and s."row" = d."row" and s."col" = d."col"
   where d."row" between 2 and 11 and d."col" between 20 and 79),
 counts as (select sim_name, cast(count(*) filter (t and p) as double) as "TP", cast(count(*) filter (not t and not p) as double) as "TN", cast(count(*) filter (not t and p) as double) as "FP", cast(count(*) filter (t and not p) as double) as "FN" from cmp group by 1),
 scores as (select *, round("TP" / nullif("TP" + "FN", 0), 6) as "hitRate", round("FP" / nullif("TP" + "FP", 0), 6) as "falseAlarms", round("TP" / nullif("TP" + "FP" + "FN", 0), 6) as "criticalSuccessIndex", round("FP" / nullif("FN", 0), 6) as "errorBias" from counts)
select 'inun' as analysis, sim_name, var_name, val from (unpivot scores on "TP", "TN", "FP", "FN", "hitRate", "falseAlarms", "criticalSuccessIndex", "errorBias" into name var_name value val)""",
    "depth_stats": _b("""select method, dscale, round(avg(h), 3) as mean, round(sum(case when h > 0 then dscale * dscale else 0 end), 3) as posi_area, round(sum(h * dscale * dscale), 3) as vol from (
      select 'Basic' as method, 1 as dscale, greatest(coalesce(lin.value - dem.value, 0), 0) as h from dem left join lin using ("row", "col")
      union all select 'SimpleFilter', 1, greatest(coalesce(sf.value - dem.value, 0), 0) from dem join sf using ("row", "col")
      union all select m, 5, greatest(coalesce(p2.value - blk.value, 0), 0) from blk join p2 using ("row", "col"), (values ('Basic'), ('SimpleFilter')) t(m)) group by 1, 2"""),
    "results_long": BASE + f", counts as (select {_SCORES}), scores as ({_RATIOS})" + """
select 'inun' as analysis, 'metric' as data_type, 'sim' as sim_name, var_name, val from (unpivot (select cast("TP" as double) as "TP", cast("TN" as double) as "TN", cast("FP" as double) as "FP", cast("FN" as double) as "FN", "hitRate", "falseAlarms", "criticalSuccessIndex", "errorBias" from scores) on columns(*) into name var_name value val)""",
    "sim_wide_points": _b('select id, round(p.value, 6) as one, round(q.value, 6) as two, round(water_depth, 6) as "true", true as agree from marks m join ph p using ("row", "col") join qh q using ("row", "col")'),
    "hwm_windowed": _b("""select date_trunc('day', ts) as window_start, count(*) as n, round(avg(h.value - e.value), 6) as "meanError", round(sqrt(avg((h.value - e.value) * (h.value - e.value))), 6) as "RMSE"
      from events e join ph h on h."col" = event_id % 100 and h."row" = floor(event_id / 100) % 15 group by 1"""),
}

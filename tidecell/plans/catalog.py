"""Registered queries of the grid engine: each applies operators to the bridge grids or to the tables themselves."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.operators import algebra, checks, drainage, methods, metrics, neighbourhood, outlines, overlay, regression, relations, resample, shapes, shaping, vector
from tidecell.functions import stage
from tidecell.sources import asc, geojson, synth, tables, tiles
from tidecell.streaming import hwm

from . import bridge
from .bridge import K, WIDTH, table
from .oracle import ORACLES

_Q: dict[str, Callable] = {}


def query(f: Callable) -> Callable:
    _Q[f.__name__] = f
    return f


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums differ in their last bits by order."""
    return df.withColumns({c: F.round(c, digits) for c in (columns or [c for c, t in df.dtypes if t == "double"])})


def _wsh(s, d, a=7, b=3):
    t = bridge.dem(s, d)
    return algebra.depth(bridge.wse1(t, K, a, b), t)


def _true(s, d):
    return algebra.wet_of_wse(bridge.wse1(bridge.dem(s, d), K, 3, 7))


def _pred(s, d):
    return algebra.wet_of_wse(bridge.wse1(bridge.dem(s, d)))


def _ring(s, d):
    """A pentagon in cell units, y up."""
    ring = "array(named_struct('x', 10.2D, 'y', -1.3D), named_struct('x', 70.7D, 'y', -2.1D), named_struct('x', 90.4D, 'y', -9.6D), named_struct('x', 40.1D, 'y', -13.9D), named_struct('x', 5.3D, 'y', -8.2D))"
    return s.range(1).select(F.col("id").alias("poly_id"), F.expr(f"array({ring})").alias("rings"))


# resampling


@query
def resample_nearest(s, d):
    return _r(resample.nearest(bridge.wse2(bridge.dem(s, d)), K))


@query
def resample_bilinear(s, d):
    return _r(resample.bilinear(bridge.wse2(bridge.dem(s, d)), K))


@query
def aggregate_mean(s, d):
    return _r(resample.block_reduce(bridge.dem(s, d), K))


@query
def block_reduce_minmax(s, d):
    return _r(resample.block_reduce(bridge.dem(s, d), K, {"low": F.min("value"), "high": F.max("value")}))


@query
def clip_window(s, d):
    return _r(resample.clip(bridge.dem(s, d), 5, 15, 20, 80))


@query
def clip_pair_extent(s, d):
    t = bridge.dem(s, d)
    a, b = resample.clip_pair(bridge.wse2(t), t, K, 1, 3, 4, 16)
    tag = lambda df, n: df.select(F.lit(n).alias("grid"), "row", "col", "value")
    return _r(tag(a, "wse2").unionAll(tag(b, "dem")))


@query
def cell_centres(s, d):
    return _r(resample.centres(bridge.dem(s, d), 100.0, 900.0, 4.0))


@query
def merge_grids(s, d):
    t = bridge.dem(s, d)
    return _r(resample.merge(bridge.wse1(t), bridge.wse1(t, K, 3, 7)))


# cell algebra


@query
def terrain_filter(s, d):
    t = bridge.dem(s, d)
    return _r(algebra.terrain_filter(resample.nearest_onto(t, bridge.wse2(t), K), t))


@query
def terrain_violations(s, d):
    t = bridge.dem(s, d)
    return algebra.violations(resample.nearest_onto(t, bridge.wse2(t), K), t)


@query
def depth_from_wse(s, d):
    return _r(_wsh(s, d))


@query
def wse_from_depth(s, d):
    return _r(algebra.wse_from_depth(_wsh(s, d), bridge.dem(s, d)))


@query
def inundation_mask(s, d):
    return algebra.wet_of_depth(_wsh(s, d))


@query
def clean_depth(s, d):
    t = bridge.dem(s, d)
    raw = algebra.pair(bridge.wse1(t), t).select("row", "col", (F.col("a") - F.col("b") - 30).alias("value"))
    return _r(algebra.clean_depth(raw))


@query
def mask_apply(s, d):
    mask = _true(s, d).select("row", "col", (~F.col("wet")).alias("masked"))
    return _r(algebra.apply_mask(bridge.wse1(bridge.dem(s, d)), mask))


@query
def mosaic(s, d):
    w = bridge.wse1(bridge.dem(s, d))
    even, odd = (w.select("row", "col", F.when(F.col("col") % 2 == i, F.col("value")).alias("value")) for i in (0, 1))
    return _r(algebra.mosaic(even, odd))


@query
def raster_calc(s, d):
    return _r(algebra.calc(bridge.dem(s, d), "sqrt(value) * 2 - 1"))


@query
def confusion_grid(s, d):
    return algebra.confusion_grid(_true(s, d), _pred(s, d))


@query
def element_bias(s, d):
    p = algebra.pair(_wsh(s, d, 3, 7), _wsh(s, d), "t", "p")
    return _r(p.select("row", "col", algebra.element_bias(F.col("t"), F.col("p")).alias("bias")))


@query
def threshold_mask(s, d):
    return algebra.threshold(bridge.dem(s, d), 100.0, 200.0)


@query
def display_depths(s, d):
    return _r(algebra.display(_wsh(s, d), "WSH"))


@query
def round_to_multiple(s, d):
    return _r(algebra.round_to(bridge.dem(s, d), 5.0))


@query
def mask_invert(s, d):
    return algebra.invert_mask(bridge.wse1(bridge.dem(s, d)))


@query
def boolean_select(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return algebra.select_where(o, {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"]})


# neighbourhoods


@query
def buffer_d4(s, d):
    return _r(neighbourhood.buffer_d4(bridge.wse1(bridge.dem(s, d))))


@query
def buffer_grow_3(s, d):
    t = bridge.dem(s, d)
    return _r(neighbourhood.buffer_rounds(bridge.wse1(t), t, 3))


@query
def clumps(s, d):
    return neighbourhood.clumps(bridge.wse1(bridge.dem(s, d)), WIDTH)


@query
def largest_clump(s, d):
    return _r(neighbourhood.largest_clump(bridge.wse1(bridge.dem(s, d)), WIDTH))


@query
def search_donut(s, d):
    t = bridge.dem(s, d)
    return neighbourhood.donut(resample.nearest_onto(t, bridge.wse2(t), K), 1.5 * K)


@query
def knn_fill(s, d):
    t = bridge.dem(s, d)
    coarse = bridge.wse2(t)
    return _r(neighbourhood.knn_fill(neighbourhood.donut(resample.nearest_onto(t, coarse, K), 1.5 * K), coarse, K))


@query
def cost_allocation(s, d):
    return _r(neighbourhood.cost_allocation(bridge.wse1(bridge.dem(s, d))))


@query
def focal_mean(s, d):
    return _r(neighbourhood.focal(bridge.dem(s, d)))


@query
def hillshade(s, d):
    return _r(neighbourhood.hillshade(bridge.dem(s, d), 10.0))


@query
def pixels_to_points(s, d):
    return _r(neighbourhood.to_points(bridge.wse1(bridge.dem(s, d))))


@query
def idw_interpolation(s, d):
    q = resample.block_reduce(bridge.dem(s, d), K).select("row", "col", ((F.col("row") + 0.5) * K).alias("y"), ((F.col("col") + 0.5) * K).alias("x"))
    p = bridge.marks(s, d).select("id", "x", (-F.col("y")).alias("y"), F.col("water_depth").alias("value"))
    return _r(neighbourhood.idw(q, p, 6.0))


# methods


@query
def method_basic(s, d):
    t = bridge.dem(s, d)
    return _r(methods.basic(t, bridge.wse2(t), K))


@query
def method_simple_filter(s, d):
    t = bridge.dem(s, d)
    return _r(methods.simple_filter(t, bridge.wse2(t), K))


@query
def method_buffer_grow(s, d):
    t = bridge.dem(s, d)
    return _r(neighbourhood.buffer_rounds(methods.simple_filter(t, bridge.wse2(t), K), t, 2))


@query
def method_buffer_grow_loop(s, d):
    t = bridge.dem(s, d)
    return _r(methods.buffer_grow_loop(t, bridge.wse2(t), K))


@query
def method_cost_grow(s, d):
    t = bridge.dem(s, d)
    return _r(methods.cost_grow(t, bridge.wse2(t), K, WIDTH, "nearest"))


@query
def method_cost_grow_bilinear(s, d):
    t = bridge.dem(s, d)
    return _r(methods.cost_grow(t, bridge.wse2(t), K, WIDTH))


@query
def method_schumann(s, d):
    t = bridge.dem(s, d)
    return _r(methods.schumann14(t, bridge.wse2(t), K))


# points and polygons


@query
def sample_points(s, d):
    p = vector.sample(bridge.marks(s, d), _wsh(s, d))
    return _r(p.select("id", "water_depth", "value"))


@query
def sample_confusion(s, d):
    codes = algebra.confusion_grid(_true(s, d), _pred(s, d)).withColumnRenamed("code", "value")
    at = vector.sample(bridge.marks(s, d), codes).filter("value is not null").select(F.col("value").alias("code"))
    return vector.confusion_labels(at)


@query
def rasterize_polygon(s, d):
    return vector.rasterize(bridge.dem(s, d), _ring(s, d))


@query
def zonal_stats(s, d):
    return _r(vector.zonal_stats(bridge.dem(s, d), _ring(s, d)))


@query
def polygon_areas(s, d):
    """Areas of the polygons around each wet area."""
    labels = neighbourhood.clumps(bridge.wse1(bridge.dem(s, d)), WIDTH)
    return _r(outlines.summary(outlines.outlines(labels, 4)).select("poly_id", "area"))


@query
def outlines_with_holes(s, d):
    """Of the polygons around eight-connected wet areas: area, length of the outline, corners, holes."""
    labels = neighbourhood.clumps(bridge.wse1(bridge.dem(s, d)), WIDTH, connect=8)
    return outlines.summary(outlines.outlines(labels, 8, 64))


@query
def filled_terrain(s, d):
    """The terrain with its depressions filled."""
    return _r(drainage.filled(bridge.dem(s, d), 64))


@query
def breached_terrain(s, d):
    """Of the breached terrain: that nothing is left to fill, how many cells were lowered, none was lifted, and the least value."""
    t = bridge.dem(s, d)
    low = drainage.breached(t, 64)
    both = algebra.pair(t, low).join(drainage.filled(low, 64).withColumnRenamed("value", "full"), ["row", "col"])
    return _r(both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("full") > F.col("b")).alias("to_fill"), F.count_if(F.col("b") > F.col("a")).alias("lifted"), (F.count_if(F.col("b") < F.col("a")) > 0).alias("lowered"), F.min("b").alias("least")))


@query
def area_of_clumps(s, d):
    return _r(vector.areas_of(neighbourhood.clumps(bridge.wse1(bridge.dem(s, d)), WIDTH)))


@query
def observed_extent(s, d):
    """The second time from the cache."""
    t, cache = bridge.dem(s, d), {}
    grid = {"crs_epsg": 3857, "height": None, "width": WIDTH, "x0": 0.0, "y0": 0.0, "res": 1.0}
    methods.observed_extent(_ring(s, d), t, grid, cache)
    return methods.observed_extent(_ring(s, d).limit(0), t, grid, cache)


@query
def points_outside_polygon(s, d):
    return vector.select_by_location(bridge.marks(s, d), _ring(s, d), "disjoint").select("id")


@query
def join_by_location(s, d):
    return _r(vector.join_by_location(bridge.marks(s, d), _ring(s, d), "water_depth"))


@query
def polygon_clip_area(s, d):
    """The areas of zones cut to a box."""
    cut = vector.area_and_centroid(vector.clip_polygons(bridge.zones(s, d), 20.5, -19.25, 60.25, -9.5))
    return _r(cut.filter("area > 1e-9").select("poly_id", "area"))


@query
def polygon_intersection(s, d):
    """What zones share with each of two boxes at once."""
    box = lambda a, b, c, e: [(a, b), (c, b), (c, e), (a, e)]
    return _r(vector.area_and_centroid(vector.intersection_of(bridge.zones(s, d), [box(10.5, -20.5, 70.5, -8.5), box(30.25, -30.0, 90.0, -11.25)])).select("poly_id", "area"))


@query
def overlay_intersection(s, d):
    """What each zone with an even number shares with each that has an odd one."""
    z = bridge.zones(s, d)
    return _r(overlay.shared_areas(z.filter("poly_id % 2 = 0"), z.filter("poly_id % 2 = 1"), 8.0))


@query
def overlay_symmetric_difference(s, d):
    z = bridge.zones(s, d)
    return _r(overlay.areas(overlay.symmetric_difference(z.filter("poly_id % 3 = 0"), z.filter("poly_id % 3 = 1"), 8.0), "side", "poly_id").select("side", "poly_id", "area"))


@query
def zone_relations(s, d):
    """How zones with even and odd numbers lie to one another."""
    z = bridge.zones(s, d)
    return relations.relate(z.filter("poly_id % 2 = 0"), z.filter("poly_id % 2 = 1"), 8.0)


@query
def zones_that_overlap(s, d):
    z = bridge.zones(s, d)
    return relations.select_by_location(z.filter("poly_id % 2 = 0"), z.filter("poly_id % 2 = 1"), "overlaps", 8.0).select("poly_id")


@query
def simplified_zones(s, d):
    """Outlines of zones with a point amid each side, which goes again."""
    mid = lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    dense = lambda r: F.flatten(F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), lambda a, b: F.array(a, mid(a, b))))
    z = bridge.zones(s, d).withColumn("rings", F.transform("rings", dense))
    return shapes.simplified(shapes.ring_points(z), 0.25)


@query
def poles_of_zones(s, d):
    """The points farthest inside of zones without their holes."""
    return _r(shapes.poles(bridge.zones(s, d).withColumn("rings", F.slice("rings", 1, 1)), 0.5))


@query
def metadata_write_read(s, d):
    """Profiles of grids as metadata, written by kind and read again."""
    path, t = _folder(s), bridge.dem(s, d)
    grids = {"dem": t, "wse2": bridge.wse2(t)}
    rows = [tables.profile(g).select(F.lit(n).alias("tab"), "height", "width") for n, g in grids.items()]
    tables.write_meta(rows[0].unionByName(rows[1]), path)
    return s.read.parquet(path).select("tab", "height", "width")


@query
def hulls_of_nations(s, d):
    """The area of the convex hull of each nation's customers."""
    c = table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("poly_id"), (F.col("c_custkey") % WIDTH).cast("double").alias("x"), F.floor(F.col("c_custkey") / WIDTH).cast("double").alias("y"))
    h = shapes.hulls(c)
    nxt = h.join(h.groupBy("poly_id").agg(F.count(F.lit(1)).cast("int").alias("n")), "poly_id").select("poly_id", ((F.col("seq") - 1 + F.col("n")) % F.col("n")).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = h.join(nxt, ["poly_id", "seq"])
    return _r(both.groupBy("poly_id").agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"), F.count(F.lit(1)).alias("corners")))


@query
def dissolved_zones(s, d):
    """The zones of each nation as one: area, and length of the outline."""
    pieces = overlay.dissolve(bridge.zones(s, d), "nation", 8.0)
    length = overlay.outline(pieces, "nation").groupBy("nation").agg(F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("length"))
    return _r(overlay.areas(pieces, "nation").join(length, "nation").select("nation", "area", "length"))


@query
def zonal_order_statistics(s, d):
    t = bridge.dem(s, d).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return _r(vector.zonal_order_statistics(t, bridge.zones(s, d)))


@query
def location_summaries(s, d):
    """Of the marks in each zone, with order statistics."""
    p = bridge.marks(s, d).withColumn("water_depth", F.round("water_depth", 0))
    return _r(vector.join_by_location(p, bridge.zones(s, d), "water_depth", order=True))


@query
def polygons_write_read(s, d):
    """Zones written as GeoJSON with their attributes, and those of a box read again."""
    path = _folder(s)
    geojson.write_polygons(bridge.zones(s, d), path)
    got = geojson.read_polygons(s, path, bbox=(20.5, -100.0, 40.5, 0.0), properties=True)
    return got.select("poly_id", F.size("rings").alias("rings"), got["properties"]["name"].alias("name"), got["properties"]["nation"].cast("long").alias("nation"))


@query
def grid_profiles(s, d):
    t = bridge.dem(s, d)
    both = t.select(F.lit("dem").alias("grid_id"), "*").unionByName(bridge.wse2(t).select(F.lit("wse2").alias("grid_id"), "*"))
    return tables.profile(both, 2.0, 100.0, 900.0, 3857)


@query
def converted_grids(s, d):
    """Levels to depths, depths back to levels, and both to what is wet."""
    t = bridge.dem(s, d)
    w = bridge.wse1(t)
    h = algebra.convert(w, "WSE", "WSH", t)
    wet = algebra.convert(h, "WSH", "INUN").join(algebra.convert(w, "WSE", "INUN").withColumnRenamed("wet", "also"), ["row", "col"])
    return _r(algebra.convert(h, "WSH", "WSE", t).join(wet, ["row", "col"]))


@query
def points_in_polygon(s, d):
    return vector.select_by_location(bridge.marks(s, d), _ring(s, d)).select("id")


@query
def bbox_of_points(s, d):
    return vector.bbox(bridge.marks(s, d))


@query
def bbox_overlap(s, d):
    boxes = bridge.marks(s, d).withColumn("g", F.col("id") % 3).groupBy("g").agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    return vector.bbox_intersection(boxes)


# scores


@query
def inundation_metrics(s, d):
    return _r(metrics.inundation_metrics(_true(s, d), _pred(s, d)))


@query
def confusion_selfcheck(s, d):
    t, p = _true(s, d), _pred(s, d)
    both = t.withColumnRenamed("wet", "t").join(p.withColumnRenamed("wet", "p"), ["row", "col"])
    return metrics.confusion_selfcheck(algebra.confusion_grid(t, p), metrics.confusion_counts(both))


@query
def wsh_stats(s, d):
    return _r(metrics.wsh_stats(_wsh(s, d), 4.0))


@query
def raster_stats(s, d):
    return _r(metrics.raster_stats(bridge.wse1(bridge.dem(s, d))), digits=3)


@query
def unique_values(s, d):
    return metrics.unique_values(bridge.dem(s, d))


@query
def grid_checks(s, d):
    t = bridge.dem(s, d)
    parts = [(n, checks.facts(g)) for n, g in (("dem", t), ("wse", bridge.wse1(t)), ("wsh", _wsh(s, d)))]
    out = [f.select(F.lit(n).alias("grid"), "is_dem", "is_wse", "is_wsh") for n, f in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query
def partial_wet(s, d):
    return checks.partial_wet(_pred(s, d))


@query
def error_metrics(s, d):
    pairs = table(s, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("true"), (F.col("l_quantity") * F.col("l_tax") * 20 - 5).alias("pred"))
    return _r(metrics.error_metrics(pairs))


@query
def hwm_validation(s, d):
    return _r(methods.validate_points(bridge.marks(s, d), _wsh(s, d)))


@query
def label_confusion(s, d):
    docs = table(s, d, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("string").alias("t"))
    m = metrics.label_confusion(docs, "q", "t", ["0", "1"])
    return m.select("true", F.col("0").alias("pred_0"), F.col("1").alias("pred_1"))


@query
def linear_regression(s, d):
    li = table(s, d, "lineitem").withColumns({"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice").cast("double") / 1000})
    return _r(metrics.linear_regression(li, "x", "y", ["l_returnflag"]))


@query
def histogram_diff(s, d):
    return metrics.histogram(table(s, d, "events"), F.col("value"), 2.0, 30)


@query
def quantile_range(s, d):
    return _r(metrics.quantile_range(bridge.dem(s, d), "value"))


@query
def histogram_of_errors(s, d):
    """Predicted minus observed depths in 30 bins, without the points where nothing is predicted."""
    at = vector.sample(bridge.marks(s, d), _wsh(s, d), name="pred").filter("pred > 0")
    return metrics.histogram(at, F.col("pred") - F.col("water_depth"), 10.0, 30, -150.0)


@query
def line_through_origin(s, d):
    li = table(s, d, "lineitem").withColumns({"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice").cast("double") / 1000})
    return _r(metrics.through_origin(li, "x", "y", ["l_returnflag"]))


@query
def distance_pairs(s, d):
    return _r(vector.distance_matrix(bridge.marks(s, d), 1.5))


@query
def polygon_centroid(s, d):
    return _r(vector.area_and_centroid(bridge.zones(s, d)))


@query
def density_of_values(s, d):
    return _r(metrics.kde(table(s, d, "events"), "value", [1.0, 5.0, 20.0], 2.5, ["event_type"]))


@query
def set_report(s, d):
    keys = lambda t, c: table(s, d, t).select(F.col(c).alias("k"))
    return metrics.set_report(keys("customer", "c_custkey"), keys("orders", "o_custkey"), "k")


@query
def fill_nodata(s, d):
    return _r(neighbourhood.fill_nodata(bridge.wse1(bridge.dem(s, d)), 3.0))


# results


@query
def validation_in_aoi(s, d):
    """Two methods scored within a box; the rows of results as numbers."""
    t = bridge.dem(s, d)
    w = bridge.wse2(t)
    grid = {"x0": 0.0, "y0": 0.0, "res": 1.0, "height": 1 << 30, "width": WIDTH}
    sims = {"Basic": methods.run(t, w, "Basic", K, validate=False), "SimpleFilter": methods.run(t, w, "SimpleFilter", K, validate=False)}
    rows = methods.validate_downscaled(sims, t, grid, _true(s, d), bridge.marks(s, d), (20.0, -12.0, 80.0, -2.0))
    return _r(rows.select("analysis", "sim_name", "var_name", F.col("val").cast("double").alias("val")))


@query
def depth_stats(s, d):
    t = bridge.dem(s, d)
    return _r(methods.depth_stats(t, bridge.wse2(t), K, {"Basic": {}, "SimpleFilter": {}}, [1, K])[1], digits=3)


@query
def resolution_ratio(s, d):
    """Of the coarse grid over the terrain: the ratio that methods use where none is given, from the sizes of cells that the
    same width has, and whether whole blocks fill the terrain."""
    t = bridge.dem(s, d)
    fine, low = (tables.profile(g).first() for g in (t, bridge.wse2(t)))
    ratio = resample.resolution_ratio({"res": fine["width"] / low["width"]}, {"res": 1.0})
    support = resample.support_ratio((low["height"] * K, fine["width"]), (low["height"], low["width"]))
    return s.range(1).select(F.lit(ratio).alias("ratio"), F.lit(support).alias("support"), F.lit(resample.divisible((fine["height"], fine["width"]), K)).alias("divisible"))


@query
def multires_volume_pivot(s, d):
    t = bridge.dem(s, d)
    w = bridge.wse2(t)
    runs = methods.run_multires(t, w, K, {"Basic": {}, "SimpleFilter": {}}, [1, K])
    terrain = t.withColumn("dscale", F.lit(1)).unionByName(resample.block_reduce(t, K).withColumn("dscale", F.lit(K)))
    both = runs.join(terrain.withColumnRenamed("value", "d"), ["dscale", "row", "col"])
    depth = both.select("method", "dscale", F.greatest(F.coalesce(F.col("value") - F.col("d"), F.lit(0.0)), F.lit(0.0)).alias("h"))
    vol = depth.groupBy(F.col("method").alias("sim"), "dscale").agg(F.sum(F.col("h") * F.col("dscale") * F.col("dscale")).alias("vol"))
    m = shaping.multires(vol, [1, K])
    return _r(m.select("sim", F.col("1").alias("d10"), F.col(str(K)).alias("d50")), digits=3)


@query
def results_long(s, d):
    m = metrics.inundation_metrics(_true(s, d), _pred(s, d))
    long = m.select(*[F.col(c).cast("double").alias(c) for c in m.columns]).unpivot([], m.columns, "var_name", "val")
    return _r(shaping.with_level(long, analysis="inun", data_type="metric", sim_name="sim"))


@query
def sim_wide_points(s, d):
    at = [vector.sample(bridge.marks(s, d), _wsh(s, d, a, b), name="pred").filter("pred is not null").select("id", F.lit(n).alias("sim"), F.col("water_depth").alias("true"), "pred") for n, a, b in (("one", 7, 3), ("two", 3, 7))]
    return _r(shaping.sim_points(at[0].unionAll(at[1]), ["one", "two"]))


# sources, masks and checks


def _folder(s):
    return f"{stage.shared_dir(s)}/tidecell/out-{uuid.uuid4().hex}"


def _whole(s, d):
    """The terrain over its whole rectangle, NULL where orders leave gaps."""
    t = bridge.dem(s, d)
    h, w = (n + 1 for n in t.agg(F.max("row"), F.max("col")).first())
    return synth.constant_grid(s, h, w, None).drop("value").join(t, ["row", "col"], "left").select("row", "col", "value")


@query
def asc_write_read(s, d):
    """Written as an ASCII grid by many tasks and read again by ranges."""
    path = _folder(s)
    asc.write_asc(bridge.dem(s, d), path)
    return _r(s.read.format("asc").load(path).drop("grid_id"))


@query
def asc_window(s, d):
    """A window of an ASCII grid: only the ranges of bytes that hold its rows are read."""
    path = _folder(s)
    asc.write_asc(bridge.wse1(bridge.dem(s, d)), path, split=1 << 14)
    return _r(s.read.format("asc").load(path).filter("row between 2 and 8 and col between 10 and 59").drop("grid_id"))


def _tiled(s, cells, name):
    """Written by tile in the shared folder; small tiles, as the grids here are narrow."""
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{_folder(s)}-{name}"
    tiles.write_tiled(cells, name, path, 16, 16, 8)
    return name, path


@query
def tiled_depth(s, d):
    """Depths of two grids stored by tile: terrain filter and depth without an exchange."""
    t = bridge.dem(s, d)
    near = resample.nearest_onto(t, bridge.wse2(t), K)
    w, h = (tiles.read_tiled(s, _tiled(s, g, n)[0]) for g, n in ((near, "wse"), (t, "dem")))
    return _r(algebra.depth(algebra.terrain_filter(w, h), h).drop("part", "tile"))


@query
def tiled_window(s, d):
    """A window of a grid stored by tile."""
    name, path = _tiled(s, bridge.wse1(bridge.dem(s, d)), "wse")
    return _r(tiles.read_tiled(s, name, (2, 9, 10, 60), tiles.layout(s, path)).drop("part", "tile"))


@query
def grid_write_read(s, d):
    """Written as parquet by grid, and a window read again."""
    path = _folder(s)
    tables.write_grid(bridge.wse1(bridge.dem(s, d)).select(F.lit("one").alias("grid_id"), "*"), path)
    return _r(tables.read_grid(s, path, (2, 9, 10, 60)).drop("grid_id"))


@query
def points_write_read(s, d):
    """Written as GeoJSON by many tasks and read again within a box, from the files that meet it."""
    path = _folder(s)
    geojson.write_points(bridge.marks(s, d), path)
    return _r(geojson.read_points(s, path, bbox=(10.0, -1e9, 40.0, 1e9)))


@query
def mask_kinds(s, d):
    """The binary and the native mask of a grid, each read back as which cells are masked."""
    m = tables.extract_mask(bridge.wse1(bridge.dem(s, d)))
    kinds = [tables.read_mask(tables.mask_values(m, k), k).withColumnRenamed("masked", k) for k in ("binary", "native")]
    return kinds[0].join(kinds[1], ["row", "col"])


@query
def inundation_raster(s, d):
    """As files hold it: 0 is wet."""
    return tables.inundation_values(_pred(s, d))


@query
def sentinel_values(s, d):
    return tables.filled(bridge.wse1(bridge.dem(s, d))).select("row", "col", F.round(F.col("value").cast("double"), 2).alias("value"))


@query
def dry_cells(s, d):
    return algebra.dry_of_depth(_wsh(s, d))


@query
def mask_replace(s, d):
    mask = _true(s, d).select("row", "col", (~F.col("wet")).alias("masked"))
    return _r(algebra.apply_mask(bridge.wse1(bridge.dem(s, d)), mask, True, -1.0))


@query
def mask_multiply(s, d):
    t = bridge.dem(s, d)
    return _r(algebra.masked_by(t, algebra.threshold(t, 100.0, 200.0)))


@query
def basic_stats(s, d):
    return _r(metrics.basic_stats(bridge.wse1(bridge.dem(s, d))))


@query
def error_metrics_normed(s, d):
    pairs = table(s, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("true"), (F.col("l_quantity") * F.col("l_tax") * 20 - 5).alias("pred"))
    return _r(metrics.error_metrics(pairs, by=["l_returnflag"], normed=True))


@query
def mask_checks(s, d):
    """Which kinds of grid an inundation raster, a native mask and a depth grid may be."""
    t = bridge.dem(s, d)
    grids = (("inun", tables.inundation_values(_pred(s, d))), ("native", algebra.threshold(t, 100.0, 200.0)), ("wsh", _wsh(s, d)))
    out = [checks.facts(g).select(F.lit(n).alias("grid"), "is_inun", "is_binary_mask", "is_native_mask") for n, g in grids]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query
def identical_pair(s, d):
    return checks.identical(_true(s, d), _pred(s, d), ["row", "col"]).unionAll(checks.identical(_true(s, d), _true(s, d), ["row", "col"]))


@query
def nodata_points(s, d):
    p = bridge.marks(s, d).withColumns({"z": F.lit(1.0), "value": F.when(F.col("id") % 7 == 0, -9999.0).otherwise(F.col("water_depth"))})
    return _r(vector.drop_nodata_points(p).select("id", "value"))


@query
def unknown_words(s, d):
    return checks.vocabulary(table(s, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query
def grid_extents(s, d):
    """The boxes of the terrain and of the coarse grid, whether they agree, and whether their pixels have whole sizes."""
    t = bridge.dem(s, d)
    g = tables.profile(t.withColumn("grid_id", F.lit("dem")), 1.0, 100.0, 900.0).unionByName(tables.profile(bridge.wse2(t).withColumn("grid_id", F.lit("wse2")), float(K), 100.0, 900.0))
    g = tables.with_crs(g, 3857)
    same = checks.same(g, ("crs_epsg", "xmin", "xmax")).first()["same"]
    crs = checks.attributes_match(g, crs_epsg=3857).first()["match"]
    return checks.bounds(g).join(checks.simple_pixels(g), "grid_id").select("grid_id", "xmin", "ymin", "xmax", "ymax", "simple", F.lit(same).alias("same_width"), F.lit(crs).alias("same_crs"))


@query
def layer_checks(s, d):
    """Whether layers hold points alone."""
    kind = lambda df, n, t: df.select(F.lit(n).alias("layer"), F.struct(F.lit(t).alias("type")).alias("geometry"))
    layers = [kind(bridge.marks(s, d), "marks", "Point"), kind(bridge.zones(s, d), "zones", "Polygon")]
    return layers[0].limit(0).unionAll(layers[0]).transform(checks.points_only).select(F.lit("marks").alias("layer"), "points_only").unionAll(checks.points_only(layers[0].unionAll(layers[1])).select(F.lit("both").alias("layer"), "points_only"))


@query
def random_points_in_box(s, d):
    """As many random points as there are marks, in the box of these."""
    marks = bridge.marks(s, d)
    b, n = vector.bbox(marks).first(), marks.count()
    p = synth.random_points(s, (b["xmin"], b["ymin"], b["xmax"], b["ymax"]), n)
    return p.agg(F.count(F.lit(1)).alias("n"), (F.min("x") >= b["xmin"]).alias("left"), (F.max("x") <= b["xmax"]).alias("right"), (F.min("y") >= b["ymin"]).alias("low"), (F.max("y") <= b["ymax"]).alias("high"), (F.countDistinct("x") > 0.98 * n).alias("spread"))


# no SQL


@query
def random_analog(s, d):
    return metrics.wsh_stats(synth.random_depths(bridge.dem(s, d)))


@query
def random_analog_share(s, d):
    """How many cells of the random analogue are dry, and whether its depths keep within the reference's range."""
    t = bridge.dem(s, d)
    low, high = metrics.quantiles(t, "value", [0.02, 0.98])
    got = synth.random_depths(t, 0.37).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") == 0).alias("dry"), F.max("value").alias("top"))
    return got.select("n", "dry", ((F.col("top") > 0) & (F.col("top") <= high - low)).alias("within"))


@query
def hwm_windowed(s, d):
    e = table(s, d, "events").select("ts", (F.col("event_id") % WIDTH + 0.5).alias("x"), (-(F.floor(F.col("event_id") / WIDTH) % 15 + 0.5)).alias("y"), F.col("value").cast("double").alias("water_depth"))
    return _r(hwm.scored(e, _wsh(s, d), window="1 day"))


@query
def regression_pvalue(s, d):
    li = table(s, d, "lineitem").withColumns({"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice").cast("double") / 1000})
    return _r(metrics.with_pvalue(metrics.linear_regression(li, "x", "y", ["l_returnflag"])))


@query
def regression_weak(s, d):
    """Two columns that have nothing to do with each other, so the chance is not next to 0."""
    li = table(s, d, "lineitem").withColumns({"x": F.col("l_tax").cast("double") * 100, "y": F.col("l_quantity").cast("double")})
    return _r(metrics.with_pvalue(metrics.linear_regression(li, "x", "y", ["l_returnflag"])))


@query
def ols_with_dummies(s, d):
    """Price by quantity, with an intercept for each flag."""
    li = table(s, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), "l_returnflag")
    return _r(regression.least_squares(li, "y", ["x"], ["l_returnflag"]).table(s).select("name", "coef", "stderr", "t"))


@query
def logit_of_labels(s, d):
    """Quality by toxicity: with one dummy the fit has a closed form."""
    t = table(s, d, "labels").select(F.col("quality").cast("string").alias("q"), F.col("toxic").cast("double").alias("toxic"))
    return _r(regression.multinomial(t, "q", ["toxic"]).table(s).select("name", "coef", "stderr"), digits=4)


@query
def results_wide(s, d):
    """The scores of two simulations as a library of results, loaded, collected and laid out by simulation."""
    t = bridge.dem(s, d)
    long = []
    for name, a, b in (("one", 7, 3), ("two", 3, 7)):
        m = metrics.inundation_metrics(_true(s, d), algebra.wet_of_wse(bridge.wse1(t, K, a, b)))
        rows = m.select(*[F.col(c).cast("double").alias(c) for c in m.columns]).unpivot([], m.columns, "var_name", "val")
        long.append(shaping.with_level(rows, analysis="inun", data_type="metric", sim_name=name).select("analysis", "data_type", "sim_name", "var_name", F.round("val", 6).cast("string").alias("val")))
    library = shaping.load(long[0].unionAll(long[1]), ["inun"])
    got = shaping.wide(shaping.collect(library, data_type="metric"), ["var_name"], "sim_name", "val", ["one", "two"])
    return got.select("var_name", F.col("one").cast("double").alias("one"), F.col("two").cast("double").alias("two"))


def queries() -> dict[str, Callable]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in _Q}

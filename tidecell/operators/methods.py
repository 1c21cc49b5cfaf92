"""The downscaling methods that users call, and the registry that dispatches them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import materialize

from . import algebra, checks, metrics, neighbourhood, resample, vector


def basic(dem: DataFrame, wse2: DataFrame, k: int) -> DataFrame:
    at = algebra.key(dem, wse2)
    return resample.bilinear(wse2, k).join(dem.select(*at), at, "right").select(*at, "value")


def simple_filter(dem: DataFrame, wse2: DataFrame, k: int, resampling: str = "bilinear") -> DataFrame:
    fine = resample.bilinear(wse2, k) if resampling == "bilinear" else resample.nearest(wse2, k)
    at = algebra.key(dem, fine)
    p = dem.select(*at, F.col("value").alias("d")).join(fine, at, "left")
    return p.select(*at, F.when(F.col("value") > F.col("d"), F.col("value")).alias("value"))


def buffer_grow_loop(dem: DataFrame, wse2: DataFrame, k: int, rounds: int = 30, resampling: str = "bilinear") -> DataFrame:
    return neighbourhood.buffer_grow(simple_filter(dem, wse2, k, resampling), dem, rounds)[0]


def cost_grow(dem: DataFrame, wse2: DataFrame, k: int, width: int = 1 << 31, resampling: str = "bilinear") -> DataFrame:
    """Filter, allocate every dry cell to its nearest water, filter again, keep the largest connected area."""
    start = simple_filter(dem, wse2, k, resampling)
    filled = algebra.terrain_filter(neighbourhood.cost_allocation(start), dem)
    return neighbourhood.largest_clump(filled, width)


def schumann14(dem: DataFrame, wse2: DataFrame, k: int, buffer_size: float = 1.5) -> DataFrame:
    """Nearest-neighbour start; dry cells around the water take the nearest coarse level if it tops their terrain."""
    start = resample.nearest_onto(dem, wse2, k)
    ring = neighbourhood.donut(start, buffer_size * k)
    filled = neighbourhood.knn_fill(ring, wse2, k)
    p = algebra.pair(dem, filled, "d", "w").filter("w > d").select(*algebra.key(dem, filled), F.col("w").alias("value"))
    return algebra.terrain_filter(algebra.mosaic(start, p), dem)


METHODS: dict[str, Callable[..., DataFrame]] = {"Basic": basic, "SimpleFilter": simple_filter, "BufferGrowLoop": buffer_grow_loop, "CostGrow": cost_grow, "Schumann14": schumann14}
NICKNAMES = {"rsmp": "Basic", "rsmpF": "SimpleFilter", "bgl": "BufferGrowLoop", "cgs": "CostGrow", "s14": "Schumann14"}


def _shape(cells: DataFrame) -> tuple[int, int]:
    return tuple(n + 1 for n in cells.agg(F.max("row"), F.max("col")).first())


def run(dem: DataFrame, wse2: DataFrame, method: str = "CostGrow", k: int | None = None, validate: bool = True, grids: tuple[dict, dict] | None = None, **pars) -> DataFrame:
    """One method by name or nickname, with the kinds of its inputs checked before. Where k isn't given it is the ratio of the
    resolutions of grids (the terrain's, the water's), or else of the two tables' shapes; it must be whole."""
    if k is None:
        k = resample.resolution_ratio(grids[1], grids[0]) if grids else resample.support_ratio(_shape(dem), _shape(wse2))
        if k != int(k):
            raise ValueError(f"the ratio of the grids is {k}, not a whole number")
    if validate:
        checks.require(dem, "DEM"), checks.require(wse2, "WSE")
    return METHODS[NICKNAMES.get(method, method)](dem, wse2, int(k), **pars)


def run_many(dem: DataFrame, wse2: DataFrame, k: int, method_pars: dict[str, dict]) -> DataFrame:
    """(method, row, col, value) of several methods."""
    if unknown := set(method_pars) - set(METHODS) - set(NICKNAMES):
        raise KeyError(f"unknown methods: {sorted(unknown)}")
    return reduce(DataFrame.unionByName, [run(dem, wse2, m, k, **p).select(F.lit(m).alias("method"), "row", "col", "value") for m, p in method_pars.items()])


def aggregated_dems(dem: DataFrame, scales: list[int]) -> dict[str, DataFrame]:
    from .shaping import scale_key

    return {scale_key(s): dem if s == 1 else resample.block_reduce(dem, s) for s in scales}


def run_multires(dem: DataFrame, wse2: DataFrame, k: int, method_pars: dict[str, dict], scales: list[int]) -> DataFrame:
    """(method, dscale, row, col, value): the methods towards terrain at each scale; at the coarse grid's own scale the
    water surface is passed through."""
    out = []
    for s in scales:
        own = dem if s == 1 else resample.block_reduce(dem, s)
        for m, p in method_pars.items():
            part = wse2.select("row", "col", "value") if s == k else run(own, wse2, m, k // s, validate=False, **p)
            out.append(part.select(F.lit(m).alias("method"), F.lit(s).alias("dscale"), "row", "col", "value"))
    return reduce(DataFrame.unionByName, out)


def observed_extent(observed: DataFrame, cells: DataFrame, grid: dict, cache: dict | None = None) -> DataFrame:
    """(row, col, wet) of the observed inundation on a grid: what the cache has for a grid of the same description, else
    polygons (poly_id, rings) rasterised onto the cells, or a raster (row, col, wet) of these very cells. It must be partly
    wet. What is built is written once and goes into the cache."""
    profile = tuple(grid.get(c) for c in ("crs_epsg", "height", "width", "x0", "y0", "res"))
    cache = {} if cache is None else cache
    if profile not in cache:
        if "rings" in observed.columns:
            wet = vector.rasterize(cells, observed, grid["x0"], grid["y0"], grid["res"])
        else:
            k = algebra.key(cells, observed)
            other = cells.select(*k).join(observed.select(*k), k, "left_anti").limit(1).count()
            if other or observed.select(*k).join(cells.select(*k), k, "left_anti").limit(1).count():
                raise ValueError("the observed raster isn't on the cells of the grid")
            wet = observed.select(*k, "wet")
        wet = materialize(wet, "observed")
        if not checks.partial_wet(wet).first()["partial"]:
            raise ValueError("the observed inundation is all wet or all dry")
        cache[profile] = wet
    return cache[profile]


def validate_inundation(true_wet: DataFrame, pred_wet: DataFrame, reject_identical: bool = False) -> dict[str, DataFrame]:
    """Scores and confusion grid. A prediction that equals the observation says nothing, and can be rejected."""
    if reject_identical and checks.identical(true_wet, pred_wet, algebra.key(true_wet, pred_wet)).first()["identical"]:
        raise ValueError("the prediction is identical to the observation")
    codes = algebra.confusion_grid(true_wet, pred_wet)
    return {"metrics": metrics.inundation_metrics(true_wet, pred_wet), "confusion": codes}


def validate_points(points: DataFrame, wsh: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0, depth: str = "water_depth") -> DataFrame:
    """Observed depths against the depth grid at their place; outside the grid and on no-data there is no pair."""
    at = vector.sample(points.filter(F.col(depth).isNotNull()), wsh, x0, y0, res, "pred").filter("pred is not null")
    return metrics.error_metrics(at, depth, "pred")


def validate_many(preds: dict[str, DataFrame], true_wet: DataFrame | None = None, points: DataFrame | None = None, **where) -> DataFrame:
    """(analysis, data_type, sim_name, var_name, val) of every depth grid against either or both observations."""
    out = []
    for sim, wsh in preds.items():
        if points is not None:
            out.append(("hwm", sim, validate_points(points, wsh, **where)))
        if true_wet is not None:
            out.append(("inun", sim, validate_inundation(true_wet, algebra.wet_of_depth(wsh))["metrics"]))
    rows = [m.select(F.lit(a).alias("analysis"), F.lit("metric").alias("data_type"), F.lit(s).alias("sim_name"), F.explode(F.map_entries(F.create_map(*[x for c in m.columns for x in (F.lit(c), F.col(c).cast("string"))]))).alias("e")).select("analysis", "data_type", "sim_name", F.col("e.key").alias("var_name"), F.col("e.value").alias("val")) for a, s, m in out]
    return reduce(DataFrame.unionByName, rows)


def validate_downscaled(sims: dict[str, DataFrame], dem: DataFrame, grid: dict, true_wet: DataFrame | None = None, points: DataFrame | None = None, aoi: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Water surfaces of several methods, as ``run`` gives them -> the rows of ``validate_many``. With an area of interest
    (xmin, ymin, xmax, ymax) all grids are cut to it first, and the points, which it leaves out, are not scored."""
    depths = {sim: algebra.depth(wse, dem) for sim, wse in sims.items()}
    if not aoi:
        return validate_many(depths, true_wet, points, x0=grid["x0"], y0=grid["y0"], res=grid["res"])
    depths = {sim: resample.clip_bbox(d, grid, aoi)[0] for sim, d in depths.items()}
    return validate_many(depths, None if true_wet is None else resample.clip_bbox(true_wet, grid, aoi)[0])


def depth_stats(dem: DataFrame, wse2: DataFrame, k: int, method_pars: dict[str, dict], scales: list[int], res: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The depth grids (method, dscale, row, col, value) of each method at each scale, and their statistics (method, dscale,
    mean, posi_area, vol) over cells of that scale's size."""
    levels = run_multires(dem, wse2, k, method_pars, scales)
    terrain = reduce(DataFrame.unionByName, [(dem if s == 1 else resample.block_reduce(dem, s)).select("row", "col", F.col("value").alias("d"), F.lit(s).alias("dscale")) for s in scales])
    depth = F.greatest(F.coalesce(F.col("value") - F.col("d"), F.lit(0.0)), F.lit(0.0))
    depths = levels.join(terrain, ["dscale", "row", "col"]).select("method", "dscale", "row", "col", depth.alias("value"))
    pixel = F.pow(F.col("dscale") * F.lit(res), 2)
    return depths, depths.groupBy("method", "dscale").agg(F.avg("value").alias("mean"), F.sum(F.when(F.col("value") > 0, pixel).otherwise(F.lit(0.0))).alias("posi_area"), F.sum(F.col("value") * pixel).alias("vol"))

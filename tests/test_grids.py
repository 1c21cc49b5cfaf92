"""The toy grids of FIXTURES.md, with the values derived there, and properties on random grids."""

import random

import pytest
from pyspark.sql import functions as F

from tidecell.operators import algebra, checks, methods, metrics, neighbourhood, resample, shaping, vector
from tidecell.sources import asc, geojson, synth, tables
from tidecell.streaming import hwm

N = None
DEM1 = [[1, 1, 1, 9, 9, 9], [1, 1, 1, 9, 9, 9], [1, 1, 1, 2, 2, 9], [2, 2, 2, 9, 2, 9], [6, 2, 2, 9, 2, 9], [2, 2, 2, 9, 2, 9], [4, 4, 4, 2, 2, 9], [4, 4, 4, 9, 9, 9], [4, 4, 4, 9, 1, 1]]
WSE2 = [[3, N], [4, N], [5, N]]
WSE1V = [[3, 3, 3, N, N, N], [3, 3, 3, N, N, N], [3, 3, 3, 3, 3, N], [4, 4, 4, N, 3, N], [N, 4, 4, N, 3, N], [4, 4, 4, N, 3, N], [5, 5, 5, 5, 5, N], [5, 5, 5, N, N, 5], [5, 5, 5, N, N, N]]
WSE13 = [[3, 3, 3, N, N, N], [3, 3, 3, N, N, N], [3, 3, 3, 3, 3, N], [4, 4, 4, N, 4, N], [N, 4, 4, N, 4, N], [4, 4, 4, N, 4, N], [5, 5, 5, 5, 5, N], [5, 5, 5, N, N, N], [5, 5, 5, N, N, 5]]


def grid(spark, rows):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "row int, col int, value double")


def values(df, column="value"):
    return {(x["row"], x["col"]): x[column] for x in df.collect()}


def dense(rows):
    return {(i, j): None if v is None else float(v) for i, r in enumerate(rows) for j, v in enumerate(r)}


@pytest.fixture(scope="module")
def toy(spark):
    return {k: grid(spark, v) for k, v in {"dem1": DEM1, "wse2": WSE2, "true": WSE1V, "pred": WSE13}.items()}


def test_scores(toy):
    t, p = algebra.wet_of_wse(toy["true"]), algebra.wet_of_wse(toy["pred"])
    m = metrics.inundation_metrics(t, p).first()
    assert (m.TP, m.TN, m.FP, m.FN) == (33, 19, 1, 1)
    assert (m.hitRate, m.falseAlarms, m.criticalSuccessIndex, m.errorBias) == (33 / 34, 1 / 34, 33 / 35, 1.0)
    both = t.withColumnRenamed("wet", "t").join(p.withColumnRenamed("wet", "p"), ["row", "col"])
    check = metrics.confusion_selfcheck(algebra.confusion_grid(t, p), metrics.confusion_counts(both)).collect()
    assert len(check) == 4 and all(x.equal for x in check)
    assert not checks.identical(t, p, ["row", "col"]).first()[0] and checks.identical(t, t, ["row", "col"]).first()[0]


def test_depth(toy):
    h = algebra.depth(toy["pred"], toy["dem1"])
    s = metrics.wsh_stats(h).first()
    assert (round(s["mean"], 6), s.posi_area, s.vol) == (1.12963, 34.0, 61.0)
    assert checks.facts(h).first().is_wsh and checks.facts(toy["dem1"]).first().is_dem and checks.facts(toy["pred"]).first().is_wse
    back = values(algebra.wse_from_depth(h, toy["dem1"]))
    assert back == dense(WSE13)
    with pytest.raises(ValueError):
        checks.require(toy["pred"], "DEM")


def test_resampling(toy):
    near = methods.simple_filter(toy["dem1"], toy["wse2"], 3, "nearest")
    wet = {k for k, v in values(near).items() if v is not None}
    assert len(wet) == 26 and wet == {(i, j) for i in range(9) for j in range(3)} - {(4, 0)}
    assert values(resample.nearest(toy["wse2"], 3)) == values(resample.nearest_onto(toy["dem1"], toy["wse2"], 3))
    lin = values(resample.bilinear(toy["wse2"], 3))
    assert [round(lin[(i, 0)], 4) for i in range(9)] == [3, 3, 3.3333, 3.6667, 4, 4.3333, 4.6667, 5, 5]
    assert sum(v is not None for v in values(methods.basic(toy["dem1"], toy["wse2"], 3)).values()) == 27
    assert sum(v is not None for v in values(methods.simple_filter(toy["dem1"], toy["wse2"], 3)).values()) == 26
    mean = values(resample.block_reduce(toy["dem1"], 3))
    assert mean[(0, 0)] == 1.0 and abs(mean[(0, 1)] - (7 * 9 + 2 * 2) / 9) < 1e-9
    assert values(resample.clip(toy["dem1"], 3, 5, 0, 2)) == {(0, 0): 2, (0, 1): 2, (1, 0): 6, (1, 1): 2}
    assert resample.support_ratio((9, 6), (3, 2)) == 3
    with pytest.raises(ValueError):
        resample.support_ratio((9, 6), (3, 3))


def test_growth(toy):
    start = methods.simple_filter(toy["dem1"], toy["wse2"], 3)
    out, log = neighbourhood.buffer_grow(start, toy["dem1"])
    assert [x["pre_null"] for x in log] == [28, 26, 24, 22, 21] and log[-1]["post_null"] == 21
    assert sum(v is not None for v in values(out).values()) == 33


def test_neighbours_are_dealt_to_all_tasks(spark):
    """However small Spark thinks the shuffled rows are, as each takes far more memory than bytes of the shuffle."""
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("value"))
    assert neighbourhood.buffer_d4(cells).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = cells.select("row", "col", F.col("row").cast("double").alias("y"), F.col("col").cast("double").alias("x"))
    got = neighbourhood.idw(at, at.select("x", "y", F.lit(2.0).alias("value")), 3.0)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().toString() and got.count() == 400 and got.filter("abs(value - 2) > 1e-9").isEmpty()


def test_growth_goes_on_while_cells_are_filled(spark):
    """A few cells a round, too few beside the dry ones to count as growth: a channel fills all the same, three rounds long."""
    low, wide = {(0, c) for c in range(4)}, 60_000
    cells = spark.range(4 * wide).select(F.floor(F.col("id") / wide).cast("int").alias("row"), (F.col("id") % wide).cast("int").alias("col"))
    dem = cells.withColumn("value", F.when((F.col("row") == 0) & (F.col("col") < 4), 1.0).otherwise(9.0))
    start = cells.withColumn("value", F.when((F.col("row") == 0) & (F.col("col") == 0), 5.0))
    out, log = neighbourhood.buffer_grow(start, dem)
    assert {(x.row, x.col) for x in out.filter("value is not null").collect()} == low
    assert [x["pre_null"] - x["post_null"] for x in log] == [1, 1, 1, 0]


def test_clumps(toy):
    labels = values(neighbourhood.clumps(toy["pred"], 6), "label")
    assert sorted(list(labels.values()).count(x) for x in set(labels.values())) == [1, 33]
    assert sum(v is not None for v in values(neighbourhood.largest_clump(toy["true"], 6)).values()) == 33


def test_cost_grow(toy):
    out = values(methods.run(toy["dem1"], toy["wse2"], "cgs", 3, width=6))
    assert sum(v is not None for v in out.values()) == 33 and out[(8, 4)] is None and out[(8, 5)] is None


def test_cost_allocation_against_all_pairs(spark):
    r = random.Random(3)
    rows = [[r.choice([N, N, N, N, N, round(r.uniform(1, 9), 3)]) for _ in range(17)] for _ in range(13)]
    rows[0][0] = 4.5
    src = {k: v for k, v in dense(rows).items() if v is not None}
    got = values(neighbourhood.cost_allocation(grid(spark, rows)))
    for (i, j), v in got.items():
        best = min((round(max(abs(i - a), abs(j - b)) + (2**0.5 - 1) * min(abs(i - a), abs(j - b)), 9), a, b) for a, b in src)
        assert v == src[best[1:]]
    assert len(got) == 13 * 17
    empty = grid(spark, [[N, N], [N, N]])
    assert values(neighbourhood.cost_allocation(empty)) == values(empty)


def test_schumann(toy):
    out = values(methods.run(toy["dem1"], toy["wse2"], "Schumann14", 3))
    assert all(v is None or v > DEM1[i][j] for (i, j), v in out.items())
    assert {k for k, v in out.items() if v is not None} >= {(i, j) for i in range(9) for j in range(3)} - {(4, 0)}
    with pytest.raises(KeyError):
        methods.run_many(toy["dem1"], toy["wse2"], 3, {"none": {}})
    many = methods.run_many(toy["dem1"], toy["wse2"], 3, {"Basic": {}, "rsmpF": {}})
    assert many.count() == 108


def test_algebra(toy, spark):
    w = toy["pred"]
    mask = w.select("row", "col", (F.col("col") < 2).alias("masked"))
    assert values(algebra.apply_mask(w, mask))[(0, 0)] is None
    assert values(algebra.apply_mask(w, mask, replace=True))[(0, 5)] == 0.0
    left, right = (w.select("row", "col", F.when((F.col("col") < 2) == b, F.col("value")).alias("value")) for b in (True, False))
    assert values(algebra.mosaic(left, right)) == values(w) and algebra.overlap(left, right).first()[0] == 0
    assert values(algebra.round_to(toy["dem1"], 2.0))[(0, 3)] == 8.0 and values(algebra.round_to(toy["dem1"], 2.0))[(0, 0)] == 0.0
    assert values(algebra.invert_mask(w)) == {k: (1.0 if v is None else None) for k, v in values(w).items()}
    assert values(algebra.masked_by(toy["dem1"], algebra.data_mask(w)))[(0, 5)] is None
    assert values(algebra.threshold(toy["dem1"], 2, 4))[(3, 0)] == 1 and values(algebra.threshold(toy["dem1"], 2, strict=True))[(3, 0)] is None
    assert sum(v == 1 for v in values(algebra.value_mask(toy["dem1"], 6)).values()) == 1
    assert values(algebra.clean_depth(grid(spark, [[-1, 2, N]]))) == {(0, 0): 0.0, (0, 1): 2.0, (0, 2): None}
    b = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 1.0), (1.0, 0.0)], "t double, p double").select(algebra.element_bias(F.col("t"), F.col("p")).alias("b"))
    assert [x.b for x in b.collect()] == [1.0, None, 0.5, None]
    assert algebra.select_where(toy["dem1"], {"row": [0, 1], "col": 5}).count() == 2
    assert algebra.select_where(toy["dem1"], {"row": 0, "col": 5}, any_of=True).count() == 14
    many = toy["dem1"].withColumn("grid_id", F.lit("a")).unionByName(toy["dem1"].withColumn("grid_id", F.lit("b")))
    assert algebra.terrain_filter(many, many).count() == 108


def test_vectors(toy, spark):
    square = spark.range(1).selectExpr("id + 7 as poly_id", "array(array(named_struct('x', 1D, 'y', 8D), named_struct('x', 4D, 'y', 8D), named_struct('x', 4D, 'y', 5D), named_struct('x', 1D, 'y', 5D))) as rings")
    wet = values(vector.rasterize(toy["dem1"], square, 0, 9, 1), "wet")
    assert {k for k, v in wet.items() if v} == {(i, j) for i in range(1, 4) for j in range(1, 4)}
    z = vector.zonal_stats(toy["dem1"], square, y0=9.0).first()
    inside = [DEM1[i][j] for i in range(1, 4) for j in range(1, 4)]
    assert (z["count"], z["min"], z["max"], z["sum"], z["median"]) == (9, 1, 9, sum(inside), sorted(inside)[4])
    a = vector.area_and_centroid(square).first()
    assert (a.area, a.x, a.y) == (9.0, 2.5, 6.5)
    points = spark.createDataFrame([(0, 2.5, 6.5), (1, 9.0, 6.0), (2, 1.5, 1.5)], "id long, x double, y double")
    assert [x.id for x in vector.select_by_location(points, square).collect()] == [0]
    ring = vector.polygonize(neighbourhood.clumps(toy["true"], 6))
    areas = sorted(x.area for x in vector.area_and_centroid(ring).collect())
    assert areas == [1.0, 33.0]
    again = values(vector.rasterize(toy["true"], ring), "wet")
    assert again == values(algebra.wet_of_wse(toy["true"]), "wet")
    assert vector.bbox_intersection(vector.bbox_of_polygons(square)).count() == 1


def test_sampling_matches_published_pairs(toy, spark):
    """Depths that were sampled at five points of the toy grid."""
    pts = [(0, 1.876641336678633, 2.885206530643816), (1, 1.006660666098243, 7.529539776994691), (2, 3.799995779298283, 3.743023226932157), (3, 3.542666027686412, 5.731736650492932), (4, 2.708325547885493, 0.766349380832619)]
    points = spark.createDataFrame([(*p, 1.0) for p in pts] + [(9, 50.0, 50.0, 1.0)], "id long, x double, y double, water_depth double")
    got = {x.id: x.value for x in vector.sample(points, algebra.depth(toy["pred"], toy["dem1"]), 0, 9, 1).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 0.0, 3: 0.0, 4: 1.0, 9: None}
    m = methods.validate_points(points, algebra.depth(toy["pred"], toy["dem1"]), 0, 9, 1).first()
    assert m.TP == 3 and m.FN == 2 and abs(m.bias - 4 / 5) < 1e-9


def test_error_metrics(spark):
    df = spark.range(20000).select(F.lit(10.0).alias("true"), (F.lit(10.0) + 7 + F.randn(3)).alias("pred"))
    m = metrics.error_metrics(df).first()
    assert abs(m.meanError - 7) < 0.05 and abs(m.meanErrorAbs - 7) < 0.05 and abs(m.RMSE - 50**0.5) < 0.05 and abs(m.bias - 1.7) < 0.01 and m.TP == 20000
    shares = metrics.error_metrics(df, normed=True).first()
    assert shares.TP == 1.0 and abs(metrics.retrieve(df, "bias_shift").first()[0] - 0.7) < 0.01
    line = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1 + F.pmod(F.col("id") * 7, F.lit(5))).alias("y"))
    r = metrics.with_pvalue(metrics.linear_regression(line, "x", "y")).first()
    assert abs(r.slope - 2) < 0.02 and r.rvalue > 0.99 and r.pvalue < 1e-10
    assert abs(metrics._student_p(2.0, 10) - 0.07339) < 1e-4 and abs(metrics._student_p(0.5, 3) - 0.6514) < 1e-3
    model = metrics.ols(line.withColumn("k", F.when(F.col("x") > 20, "a").otherwise("b")), "y", ["x"], ["k"])
    assert model.stages[-1].summary.r2 > 0.99
    assert metrics.histogram(line, F.col("x"), 10.0, 4).orderBy("bin").collect()[-1].n == 20


def test_shaping(spark):
    nested = {"a": {"hwm": {"metric": {"bias": 1.0, "RMSE": 2}}, "raw": {"meta": {"x": "y"}}}, "b": {"hwm": {"metric": {"bias": 3.0}, "meta": {"tdelta": "1.5"}}}}
    lib = shaping.library(spark, nested)
    assert lib.count() == 5 and shaping.load(lib).count() == 4
    wide = {x.var_name: x for x in shaping.wide(shaping.collect(lib, data_type="metric"), ["var_name"], "sim_name", "val", ["a", "b"]).collect()}
    assert wide["bias"].a == "1.0" and wide["bias"].b == "3.0" and wide["RMSE"].b is None
    assert shaping.runtimes(lib).collect()[0].tdelta == 1.5
    assert shaping.metric_set(spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0), ("a", "n", 1.0)], "run string, metric string, val double"), ["a", "b"]).count() == 1
    assert shaping.scale_key(2.5) == "d25"
    p = shaping.relative(spark.createDataFrame([("/x/y/z.tif",), ("/other",)], "fp string"), "fp", "/x")
    assert [x.fp for x in p.collect()] == ["y/z.tif", "/other"]
    assert checks.vocabulary(lib, "analysis", ["hwm"]).collect()[0][0] == "raw"


def test_files(toy, spark, tmp_path):
    lines = ["ncols 3", "nrows 2", "xllcorner 10", "yllcorner 20", "cellsize 2", "NODATA_value -9999", "1 2 -9999", "4 5 6"]
    (tmp_path / "g.asc").write_text("\n".join(lines))
    cells, grids = asc.read_asc(spark, str(tmp_path / "g.asc"))
    want = {(0, 0): 1.0, (0, 1): 2.0, (0, 2): None, (1, 0): 4.0, (1, 1): 5.0, (1, 2): 6.0}
    assert values(cells) == want
    g = grids.first()
    assert (g.height, g.width, g.x0, g.y0, g.res) == (2, 3, 10.0, 24.0, 2.0) and checks.simple_pixels(grids).first().simple
    asc.register(spark)
    assert values(spark.read.format("asc").load(str(tmp_path / "*.asc"))) == want
    asc.write_asc(cells.drop("grid_id"), str(tmp_path / "out"), res=2.0, x0=10.0, y0=24.0)
    text = [x.line for x in asc.asc_lines(cells.drop("grid_id"), 2.0, 10.0, 24.0).orderBy("n").collect()]
    (tmp_path / "again.asc").write_text("\n".join(text))
    assert values(asc.read_asc(spark, str(tmp_path / "again.asc"))[0]) == want
    tables.write_grid(toy["dem1"], str(tmp_path / "grid"))
    assert tables.read_grid(spark, str(tmp_path / "grid"), (0, 2, 0, 6)).count() == 12
    masked = tables.extract_mask(toy["pred"])
    assert values(tables.read_mask(tables.mask_values(masked)), "masked") == values(masked, "masked")
    assert values(tables.inundation_values(algebra.wet_of_wse(toy["pred"])))[(0, 0)] == 0.0
    made = []
    for _ in range(2):
        tables.stage(spark, str(tmp_path / "stage"), lambda: (made.append(1), toy["dem1"])[1])
    assert len(made) == 1


def test_geojson(spark, tmp_path):
    points = spark.createDataFrame([(1, 2.0, 3.0, 0.5), (2, 9.0, 9.0, 1.5)], "id long, x double, y double, water_depth double")
    feats = ",".join(x.value for x in geojson.point_features(points, ["id", "water_depth"]).collect())
    crs = '"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}'
    (tmp_path / "p.geojson").write_text(f'{{"type": "FeatureCollection", {crs}, "features": [{feats}]}}')
    back = geojson.read_points(spark, str(tmp_path / "p.geojson"), bbox=(0, 0, 5, 5)).collect()
    assert [tuple(x) for x in back] == [(1, 2.0, 3.0, 0.5)] and "3857" in geojson.crs(spark, str(tmp_path / "p.geojson"))
    poly = spark.range(1).selectExpr("id as poly_id", "array(array(named_struct('x', 1D, 'y', 8D), named_struct('x', 4D, 'y', 8D), named_struct('x', 4D, 'y', 5D))) as rings")
    feats = geojson.polygon_features(poly).first().value
    (tmp_path / "q.geojson").write_text(f'{{"type": "FeatureCollection", {crs}, "features": [{feats}]}}')
    assert geojson.read_polygons(spark, str(tmp_path / "q.geojson")).collect() == poly.collect()


def test_random_grids(spark):
    g = synth.random_grid(spark, 20, 30, 0.2)
    nulls = g.filter("value is null").count()
    assert g.count() == 600 and 60 < nulls < 180 and sorted(map(str, g.collect())) == sorted(map(str, synth.random_grid(spark, 20, 30, 0.2).collect()))
    h = synth.random_depths(synth.constant_grid(spark, 10, 10, 1.0).withColumn("value", F.col("row") + F.col("col") * 0.1), 0.3)
    assert h.filter("value = 0").count() == 30
    box = vector.bbox(synth.random_points(spark, (1, 2, 3, 4), 200)).first()
    assert 1 <= box.xmin and box.xmax <= 3 and 2 <= box.ymin and box.ymax <= 4


def test_stream(spark, toy, tmp_path):
    rows = [("2024-01-01 00:10:00", 0.5, 8.5, 1.0), ("2024-01-01 00:20:00", 1.5, 8.5, 2.5), ("2024-01-01 03:00:00", 0.5, 7.5, 2.0), ("2024-01-02 00:00:00", 0.5, 7.5, 2.0)]
    df = spark.createDataFrame(rows, "ts string, x double, y double, water_depth double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    wsh = algebra.depth(toy["pred"], toy["dem1"])
    out = hwm.scored(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), wsh, y0=9.0)
    q = out.writeStream.format("memory").queryName("hwm").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("hwm").orderBy("window_start").collect()
    assert [x.n for x in got] == [2, 1] and abs(got[0].meanError - 0.25) < 1e-9
    assert hwm.scored(df, wsh, y0=9.0).count() == 3


def test_growth_of_one_round_against_the_definition(spark):
    r = random.Random(7)
    rows = [[r.choice([N, N, round(r.uniform(1, 9), 3)]) for _ in range(9)] for _ in range(8)]
    v = dense(rows)
    for (i, j), x in values(neighbourhood.buffer_d4(grid(spark, rows))).items():
        near = [v[k] for k in ((i, j + 1), (i, j - 1), (i + 1, j), (i - 1, j)) if v.get(k) is not None]
        want = v[(i, j)] if v[(i, j)] is not None else sum(near) / len(near) if near else None
        assert (x is None) == (want is None) and (x is None or abs(x - want) < 1e-9)


def brute_areas(wet):
    left, out = set(wet), {}
    while left:
        todo = [min(left)]
        first, area = todo[0], set()
        while todo:
            r, c = todo.pop()
            if (r, c) in left:
                left.remove((r, c))
                area.add((r, c))
                todo += [(r + i, c + j) for i, j in neighbourhood.D4]
        out |= dict.fromkeys(area, first)
    return out


@pytest.mark.parametrize("tile", [512, 4, 1])
def test_clumps_over_tiles_and_grids(spark, monkeypatch, tile):
    import random

    monkeypatch.setattr(neighbourhood, "TILE", tile)
    r = random.Random(tile)
    rows, want = [], set()
    for g in ("a", "b", "c"):
        wet = {(i, j) for i in range(11) for j in range(13) if r.random() < 0.6}
        rows += [(g, i, j, 1.5 if (i, j) in wet else None) for i in range(11) for j in range(13)]
        want |= {(g, i, j, 13 * a + b) for (i, j), (a, b) in brute_areas(wet).items()}
    cells = spark.createDataFrame(rows, "grid_id string, row int, col int, value double")
    assert {tuple(x) for x in neighbourhood.clumps(cells, 13).collect()} == want
    one = cells.filter("grid_id = 'b'").drop("grid_id")
    assert {tuple(x) for x in neighbourhood.clumps(one, 13).collect()} == {x[1:] for x in want if x[0] == "b"}
    kept = {(x.grid_id, x.row, x.col) for x in neighbourhood.largest_clump(cells, 13).filter("value is not null").collect()}
    for g in ("a", "b", "c"):
        sizes = {}
        for x in want:
            if x[0] == g:
                sizes.setdefault(x[3], []).append(x[:3])
        best = min(sizes, key=lambda k: (-len(sizes[k]), k))
        assert {x for x in kept if x[0] == g} == set(sizes[best])


@pytest.mark.parametrize("metric", ["octile", "manhattan", "euclidean"])
def test_nearest_cell_at_any_distance(spark, metric):
    import random

    import numpy as np

    r = random.Random(3)
    dist = lambda dy, dx: round(float(neighbourhood.METRICS[metric](np.float64(dy), np.float64(dx))), 9)
    rows, want = [], set()
    for g, share, h, w in (("a", 0.03, 40, 30), ("b", 0.5, 9, 7), ("c", 0.0, 3, 3), ("d", 1.0, 2, 2)):
        src = {(i, j) for i in range(h) for j in range(w) if r.random() < share}
        rows += [(g, i, j, 10.0 * i + j if (i, j) in src else None) for i in range(h) for j in range(w)]
        for i in range(h):
            for j in range(w):
                if (i, j) not in src and src:
                    d, a, b = min((dist(abs(i - a), abs(j - b)), a, b) for a, b in src)
                    want.add((g, i, j, d, a, b, 10.0 * a + b))
    cells = spark.createDataFrame(rows, "grid_id string, row int, col int, value double")
    got = neighbourhood.nearest_cell(cells, F.col("value").isNotNull(), metric)
    assert {tuple(x) for x in got.collect()} == want
    near = neighbourhood.nearest_cell(cells, F.col("value").isNotNull(), metric, 4.0)
    assert {tuple(x) for x in near.collect()} == {x for x in want if x[3] <= 4.0}


def test_fill_nodata(spark):
    rows = [(0, c, v) for c, v in enumerate([2.0, None, 6.0, None, None, None, None])]
    got = neighbourhood.fill_nodata(spark.createDataFrame(rows, "row int, col int, value double"), 2.0).orderBy("col").collect()
    assert [x.value for x in got] == [2.0, 4.0, 6.0, 6.0, 6.0, None, None]


def wide(spark, text):
    return spark.createDataFrame([(i, j, None if v == "." else float(v)) for i, row in enumerate(text.split("/")) for j, v in enumerate(row.split())], "row int, col int, value double")


GRID = {"crs_epsg": 3857, "x0": 0.0, "y0": 9.0, "res": 1.0, "height": 9, "width": 6}


def test_many_polygons_over_one_row(spark):
    """Every cell meets the polygon of its own column only, and a polygon with a hole counts each crossing."""
    boxes = [(i, [[{"x": i + 0.1, "y": 0.0}, {"x": i + 0.9, "y": 0.0}, {"x": i + 0.9, "y": -2.0}, {"x": i + 0.1, "y": -2.0}]]) for i in range(1000)]
    cells = spark.createDataFrame([(r, c, float(c)) for r in range(3) for c in range(1000)], "row int, col int, value double")
    kind = "poly_id long, rings array<array<struct<x:double,y:double>>>"
    got = vector.inside(cells, spark.createDataFrame(boxes, kind))
    assert {tuple(x) for x in got.select("row", "col", "poly_id").collect()} == {(r, c, c) for r in range(2) for c in range(1000)}
    points = spark.createDataFrame([(i, i + 0.5, -0.5) for i in range(1000)] + [(2000, 5.95, -0.5), (2001, 5.5, 3.0)], "id long, x double, y double")
    assert {x.id for x in vector.select_by_location(points, spark.createDataFrame(boxes, kind)).collect()} == set(range(1000))
    assert {x.id for x in vector.select_by_location(points, spark.createDataFrame(boxes, kind), "disjoint").collect()} == {2000, 2001}
    joined = vector.join_by_location(points.withColumn("v", F.col("x")), spark.createDataFrame([*boxes, (5000, [[{"x": -9.0, "y": 0.0}, {"x": -8.0, "y": 0.0}, {"x": -8.0, "y": 1.0}]])], kind), "v").collect()
    assert {(x.poly_id, x["count"], x["mean"]) for x in joined} == {(i, 1, i + 0.5) for i in range(1000)} | {(5000, 0, None)}


def test_polygons_cut_at_tiles_keep_their_area(spark):
    labels = spark.createDataFrame([(r, c, 1 if r < 7 else 2) for r in range(10) for c in range(9)], "row int, col int, label long")
    whole = {x.poly_id: x.area for x in vector.area_and_centroid(vector.polygonize(labels)).collect()}
    parts = vector.polygonize(labels, 4)
    assert parts.count() == 12 and whole == {1: 63.0, 2: 27.0}
    tiles = vector.area_and_centroid(parts.withColumnRenamed("poly_id", "area_of").withColumn("poly_id", F.monotonically_increasing_id())).agg(F.sum("area")).first()[0]
    assert tiles == 90.0
    assert {x.label: (x.area, x.x, x.y) for x in vector.areas_of(labels).collect()} == {1: (63.0, 4.5, -3.5), 2: (27.0, 4.5, -8.5)}


def test_windows_must_lie_in_the_grid(spark):
    cells = grid(spark, DEM1)
    out, where = resample.clip_bbox(cells, GRID, (1.2, 2.0, 4.0, 7.4))
    assert where == GRID | {"x0": 1.0, "y0": 7.0, "height": 5, "width": 3} and out.count() == 15
    for bbox in ((-1.0, 0.0, 3.0, 3.0), (0.0, 0.0, 7.0, 3.0), (2.0, 2.0, 2.2, 2.2)):
        with pytest.raises(ValueError):
            resample.clip_bbox(cells, GRID, bbox)
    low, high = resample.clip_pair_bbox(grid(spark, WSE2), GRID | {"height": 3, "width": 2, "res": 3.0}, cells, GRID, (0.4, 2.9, 3.3, 9.0))
    assert low[1]["height"] == 2 and high[1] == GRID | {"height": 6, "width": 3} and high[0].count() == 18


def test_ratio_where_none_is_given(spark):
    dem, wse = grid(spark, DEM1), grid(spark, WSE2)
    want = values(methods.run(dem, wse, "SimpleFilter", 3))
    assert values(methods.run(dem, wse, "SimpleFilter")) == want
    assert values(methods.run(dem, wse, "rsmpF", grids=({"res": 1.0}, {"res": 3.0}))) == want
    for bad in (({"res": 2.0}, {"res": 3.0}), ({"res": 3.0}, {"res": 1.0})):
        with pytest.raises(ValueError):
            methods.run(dem, wse, "Basic", grids=bad)


def test_grids_that_overlap_are_no_mosaic(spark):
    with pytest.raises(Exception, match="the grids overlap"):
        algebra.mosaic(grid(spark, WSE13), grid(spark, WSE1V)).collect()


def test_observed_extent_and_area_of_interest(spark):
    dem = grid(spark, DEM1)
    ring = spark.createDataFrame([(1, [[{"x": 0.0, "y": 9.0}, {"x": 3.0, "y": 9.0}, {"x": 3.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]])], "poly_id long, rings array<array<struct<x:double,y:double>>>")
    cache = {}
    wet = methods.observed_extent(ring, dem, GRID, cache)
    assert wet.filter("wet").count() == 27 and methods.observed_extent(ring.limit(0), dem, GRID, cache) is wet
    with pytest.raises(ValueError):
        methods.observed_extent(ring.limit(0), dem, GRID)
    assert methods.observed_extent(wet, dem, GRID).filter("wet").count() == 27
    with pytest.raises(ValueError):
        methods.observed_extent(wet.filter("row > 2"), dem, GRID)
    true = algebra.wet_of_wse(grid(spark, WSE1V))
    with pytest.raises(ValueError):
        methods.validate_inundation(true, true, reject_identical=True)
    sims = {"a": grid(spark, WSE13), "b": grid(spark, WSE1V)}
    points = spark.createDataFrame([(1, 0.5, 8.5, 2.0), (2, 4.5, 0.5, 1.0)], "id long, x double, y double, water_depth double")
    every = methods.validate_downscaled(sims, dem, GRID, true, points).collect()
    assert {(x.analysis, x.sim_name) for x in every} == {(a, s) for a in ("hwm", "inun") for s in "ab"}
    got = {(x.sim_name, x.var_name): x.val for x in every if x.analysis == "inun"}
    assert got["a", "TP"] == "33" and got["a", "FP"] == "1" and got["b", "FP"] == "0"
    cut = methods.validate_downscaled(sims, dem, GRID, true, points, (0.0, 3.0, 6.0, 9.0)).collect()
    assert {(x.analysis, x.sim_name) for x in cut} == {("inun", "a"), ("inun", "b")}
    assert {(x.sim_name, x.var_name): x.val for x in cut}["a", "FP"] == "0"


def test_methods_keep_grids_apart(spark):
    """Two grids in one table give what each gives alone."""
    one, two = (grid(spark, WSE2), grid(spark, DEM1)), (grid(spark, [[N, 4], [N, N], [6, N]]), grid(spark, [list(reversed(r)) for r in DEM1]))
    tag = lambda pair, n: [df.select(F.lit(n).alias("grid_id"), "*") for df in pair]
    wse, dem = (a.unionAll(b) for a, b in zip(tag(one, "one"), tag(two, "two")))
    for name, pars in (("Basic", {}), ("SimpleFilter", {}), ("BufferGrowLoop", {}), ("CostGrow", {"width": 6}), ("Schumann14", {})):
        both = methods.run(dem, wse, name, 3, validate=False, **pars)
        for n, (w, d) in (("one", one), ("two", two)):
            alone = values(methods.run(d, w, name, 3, validate=False, **pars))
            assert values(both.filter(F.col("grid_id") == n)) == alone, (name, n)


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    from tidecell.functions import stage

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda s: False})()})()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_dir(session)


def test_checks_of_metadata(spark):
    row = lambda n, w, res: (n, 3857, 9, w, 0.0, 9.0, res, -9999.0)
    grids = lambda *rows: spark.createDataFrame(rows, "grid_id string, crs_epsg int, height int, width int, x0 double, y0 double, res double, nodata double")
    assert checks.same(grids(row("a", 6, 1.0), row("b", 6, 1.0))).first()["same"]
    assert not checks.same(grids(row("a", 6, 1.0), row("b", 5, 1.0))).first()["same"]
    assert [x.simple for x in checks.simple_pixels(grids(row("a", 6, 1.0), row("b", 6, 0.5))).orderBy("grid_id").collect()] == [True, False]
    assert resample.divisible((9, 6), 3) and not resample.divisible((9, 6), 2)


def test_quantiles_without_sorting_all(spark, monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(metrics, "SORTED", 20)
    monkeypatch.setattr(metrics, "BINS", 7)
    r = random.Random(4)
    values_ = [r.choice([1.0, 2.0, r.gauss(0, 50)]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in [*values_, None]], "v double")
    probs = [0.0, 0.02, 0.333, 0.5, 0.98, 1.0]
    assert np.allclose(metrics.quantiles(df, "v", probs), np.quantile(values_, probs))
    assert metrics.quantiles(df.filter("v > 1e9"), "v", [0.5]) == [None]


def test_ols_intervals_hold_the_coefficients(spark):
    import random

    r = random.Random(6)
    rows = [(x := r.uniform(0, 10), y := r.uniform(0, 5), 3 + 2 * x - y + r.gauss(0, 0.5)) for _ in range(300)]
    got = metrics.ols_intervals(metrics.ols(spark.createDataFrame(rows, "x double, y double, z double"), "z", ["x", "y"]), ["x", "y"])
    assert [g["name"] for g in got] == ["x", "y", "intercept"]
    assert all(g["low"] < want < g["high"] and g["high"] - g["low"] < 0.5 and g["p"] < 1e-6 for g, want in zip(got, (2, -1, 3)))
    assert abs(metrics.student_quantile(0.95, 10) - 2.2281) < 1e-3


def test_multinomial(spark):
    rows = [(k, 3.0 * "abc".index(k) + d / 10) for k in "abc" for d in range(-8, 9)]
    df = spark.createDataFrame(rows, "k string, x double")
    out = metrics.multinomial(df, "k", ["x"]).transform(df)
    assert out.filter("prediction = label_i").count() == len(rows)


def test_result_libraries(spark):
    nested = {"Basic": {"inun": {"metric": {"TP": 3}, "fp": {"a.tif": "/old/a.tif", "b.tif": "/old/b.tif"}}, "raw": {"meta": {"x": 1}}}, "Schumann14": {"inun": {"fp": {"a.tif": "/else/a.tif"}}}}
    long = shaping.library(spark, nested)
    out = shaping.load(long, moved=("/old", "/new/place"))
    assert {(x.sim_name, x.var_name, x.val) for x in out.collect()} == {("Basic", "TP", "3"), ("Basic", "a.tif", "/new/place/a.tif"), ("Basic", "b.tif", "/new/place/b.tif"), ("Schumann14", "a.tif", "/else/a.tif")}
    assert [x.sim_name for x in shaping.inundation_files(out.filter("data_type = 'fp'"), ["a.tif", "b.tif"]).collect()] == ["Basic"]
    for bad in ({"Basic": {"other": {"fp": {"a": 1}}}}, {"Basic": {"inun": {"kind": {"a": 1}}}}):
        with pytest.raises(Exception, match="not a result"):
            shaping.load(shaping.library(spark, bad)).collect()
    named = shaping.renamed(long, "sim_name", {"Basic": "rsmp"})
    assert {x.sim_name for x in named.collect()} == {"rsmp", "Schumann14"}
    assert [x.sim_name for x in shaping.in_order(named.select("sim_name").distinct(), "sim_name", ["Schumann14", "rsmp"]).collect()] == ["Schumann14", "rsmp"]
    table = shaping.grid_table(grid(spark, [[1.23, 4], [N, 5]]), [0, 1]).orderBy("row").collect()
    assert [(x.row, x["0"], x["1"]) for x in table] == [(0, 1.2, 4.0), (1, None, 5.0)]


def test_normal_grids_and_clusters(spark):
    v = [x.value for x in synth.normal_grid(spark, 60, 60, 5.0, 2.0).collect()]
    mean = sum(v) / len(v)
    assert abs(mean - 5) < 0.15 and abs((sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5 - 2) < 0.15
    points = spark.createDataFrame([(i, 10.0 * (i % 3) + i / 100, 0.0) for i in range(30)], "id long, x double, y double")
    assert len({(x.id % 3, x.cluster) for x in vector.clusters(points, 3).collect()}) == 3


def test_stages_are_deleted_when_spent(spark):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from tidecell.functions import stage

    here = lambda df: os.path.exists(df.stage_path.removeprefix("file://").removeprefix("file:"))
    with stage.tracked() as outer:
        a = stage.materialize(spark.range(1), "t")
        with ThreadPoolExecutor(1) as other:  # another thread's stages are its own
            d = other.submit(lambda: stage.materialize(spark.range(4), "t")).result()
        with stage.tracked() as inner:
            b, c = (stage.materialize(spark.range(n), "t") for n in (2, 3))
    assert outer == [a.stage_path, b.stage_path, c.stage_path] and inner == outer[1:]
    stage.discard(a, spark.range(1))
    assert not here(a) and here(b) and here(c)
    stage.discard_but(inner, c)
    assert not here(b) and here(c) and here(d) and c.count() == 3


@pytest.mark.parametrize("together", [1, 50])
def test_nearest_cell_in_small_portions(spark, monkeypatch, together):
    """Rows that come in several portions, one row alone or a few together."""
    import random

    monkeypatch.setattr(neighbourhood, "_TOGETHER", together)
    r = random.Random(13)
    src = {(i, j) for i in range(12) for j in range(9) if r.random() < 0.1}
    cells = spark.createDataFrame([(i, j, 1.0 if (i, j) in src else None) for i in range(12) for j in range(9)], "row int, col int, value double")
    got = {(x.row, x.col): (x.dist, x.srow, x.scol) for x in neighbourhood.nearest_cell(cells, F.col("value").isNotNull(), "manhattan").collect()}
    assert got == {(i, j): min((float(abs(i - a) + abs(j - b)), a, b) for a, b in src) for i in range(12) for j in range(9) if (i, j) not in src}


def test_kinds_and_masks_that_are_refused(spark):
    poly = "poly_id long, rings array<array<struct<x:double,y:double>>>"
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    checks.require(spark.createDataFrame([(1, [ring])], poly), "INUN_POLY")
    for bad in ([], [(1, [ring[:2]])], [(1, [])], [(1, None)]):
        with pytest.raises(ValueError):
            checks.require(spark.createDataFrame(bad, poly), "INUN_POLY")
    with pytest.raises(ValueError):
        tables.extract_mask(grid(spark, DEM1), require_some=True)
    assert tables.extract_mask(grid(spark, WSE13), require_some=True).filter("masked").count() == 20
    with pytest.raises(KeyError):
        algebra.convert(grid(spark, DEM1), "DEM", "WSH")
    grids = tables.profile(grid(spark, DEM1), crs_epsg=3857)
    assert checks.attributes_match(grids, height=9, width=6).first()["match"] and not checks.attributes_match(grids, crs_epsg=4326).first()["match"]
    away = vector.clip_polygons(spark.createDataFrame([(1, [ring]), (2, [[{"x": 5.0, "y": 5.0}, {"x": 6.0, "y": 5.0}, {"x": 6.0, "y": 6.0}]])], poly), 0.0, 0.0, 2.0, 0.5)
    assert [(x.poly_id, x.area) for x in vector.area_and_centroid(away).collect()] == [(1, 0.375)]


def test_points_look_into_their_own_grid(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, 2.0), ("b", 0, 1, 3.0)], "grid_id string, row int, col int, value double")
    points = spark.createDataFrame([("a", 1, 0.5, -0.5), ("b", 1, 0.5, -0.5), ("a", 2, 1.5, -0.5), ("b", 2, 1.5, -0.5)], "grid_id string, id long, x double, y double")
    got = vector.sample(points, cells)
    assert got.columns == ["grid_id", "id", "x", "y", "value"]
    assert {(x.grid_id, x.id): x.value for x in got.collect()} == {("a", 1): 1.0, ("b", 1): 2.0, ("a", 2): None, ("b", 2): 3.0}
    near = neighbourhood.idw(cells.select("grid_id", "row", "col", F.lit(0.0).alias("y"), F.lit(0.0).alias("x")).filter("col = 0"), spark.createDataFrame([("a", 1, 1.0, 0.0, 5.0), ("b", 1, 1.0, 0.0, 7.0)], "grid_id string, id long, x double, y double, value double"), 3.0)
    assert {(x.grid_id, x.row, x.col): x.value for x in near.collect()} == {("a", 0, 0): 5.0, ("b", 0, 0): 7.0}


def test_tails_of_many():
    import numpy as np

    t, dof = np.array([0.0, 2.0, 0.5, -2.0, 40.0, 1.0] * 300), np.array([5.0, 10, 3, 10, 100, 1] * 300)
    got = metrics.student_tails(t, dof)
    assert got[:6] == pytest.approx([1.0, 0.07339, 0.6514, 0.07339, 0.0, 0.5], abs=1e-3) and (got == np.tile(got[:6], 300)).all()

"""Grids stored by tile, rasters and features read by parts and written by tasks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidecell.operators import algebra
from tidecell.sources import asc, geojson, tiles


def cells_of(spark, values, **more):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for (r, c), v in values.items()], "row int, col int, value double")


def values_of(df):
    rows = df.collect()
    out = {(x["row"], x["col"]): x["value"] for x in rows}
    assert len(out) == len(rows)
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_curve(spark):
    r = random.Random(1)
    at = [(r.randrange(1 << k), r.randrange(1 << k)) for k in range(31) for _ in range(3)] + [(0, 0), ((1 << 31) - 1, (1 << 31) - 1)]
    got = spark.createDataFrame(at, "r long, c long").select("r", "c", tiles.morton(F.col("r"), F.col("c")).alias("m")).collect()
    for x in got:
        bits = "".join(a + b for a, b in zip(f"{x.r:031b}", f"{x.c:031b}"))
        assert x.m == int(bits, 2) == tiles._morton(x.r, x.c)


def test_tiled_grids(spark, tmp_path):
    r = random.Random(2)
    at = {(i, j): r.choice([None, r.uniform(0, 9)]) for i in range(70) for j in range(90) if r.random() < 0.9}
    other = {k: r.uniform(0, 9) for k in at if r.random() < 0.8}
    a, b = cells_of(spark, at), cells_of(spark, other)
    tiles.write_tiled(a, "tiled_a", str(tmp_path / "a"), 8, 16, 6)
    tiles.write_tiled(b, "tiled_b", str(tmp_path / "b"), 8, 16, 6)
    ta, tb = tiles.read_tiled(spark, "tiled_a"), tiles.read_tiled(spark, "tiled_b")
    assert values_of(ta) == at
    deep = algebra.depth(algebra.terrain_filter(ta, tb), tb)
    assert "Exchange" not in plan_of(deep) and plan_of(deep).count("SortMergeJoin") == 2
    assert values_of(deep) == values_of(algebra.depth(algebra.terrain_filter(a, b), b))
    spec = tiles.layout(spark, str(tmp_path / "a"))
    assert spec == (8, 16, 6)
    for window in ((0, 70, 0, 90), (30, 45, 10, 71), (69, 70, 89, 90), (5, 5, 0, 9), (60, 200, 80, 300)):
        want = {k: v for k, v in at.items() if window[0] <= k[0] < window[1] and window[2] <= k[1] < window[3]}
        got = tiles.read_tiled(spark, "tiled_a", window, spec)
        assert values_of(got) == want
    few = tiles.read_tiled(spark, "tiled_a", (0, 8, 0, 8), spec)
    assert "(part" in plan_of(few).split("PushedFilters")[1]
    tiles.open_tiled(spark, "tiled_again", str(tmp_path / "a"))
    again = algebra.pair(tiles.read_tiled(spark, "tiled_again"), tb)
    assert again.count() == len(other) and "Exchange" not in plan_of(again.select("a", "b"))
    for name in ("tiled_a", "tiled_b", "tiled_again"):
        spark.sql(f"drop table {name}")


def test_tiled_edges(spark, tmp_path):
    many = spark.createDataFrame([("one", 0, 0, 1.0), ("two", 0, 0, 2.0), ("two", 300, 5, None)], "grid_id string, row int, col int, value double")
    tiles.write_tiled(many, "tiled_many", str(tmp_path / "m"))
    got = tiles.read_tiled(spark, "tiled_many")
    both = algebra.pair(got, got.withColumn("value", F.col("value") + 1))
    assert sorted((x.grid_id, x.row, x.a, x.b) for x in both.collect()) == [("one", 0, 1.0, 2.0), ("two", 0, 2.0, 3.0), ("two", 300, None, None)]
    tiles.write_tiled(many.limit(0), "tiled_none", str(tmp_path / "n"))
    assert tiles.read_tiled(spark, "tiled_none").count() == 0
    with pytest.raises(Exception, match="in no tile"):
        tiles.placed(spark.createDataFrame([(-1, 0, 1.0)], "row int, col int, value double")).collect()
    for name in ("tiled_many", "tiled_none"):
        spark.sql(f"drop table {name}")


def asc_file(path, grid, nodata=-9999, end="\n", blank=False, head=True):
    lines = [f"ncols {len(grid[0])}", f"NROWS {len(grid)}", "xllcorner 10", "yllcorner 20", "cellsize 2", f"NODATA_value {nodata}"] if head else []
    lines += [" " + " ".join(str(nodata) if v is None else repr(v) for v in row) + " " for row in grid]
    if blank:
        lines.insert(8, "   ")
    path.write_bytes((end.join(lines) + (end if blank else "")).encode())


@pytest.mark.parametrize("split", [1, 7, 64, 500, 1 << 20])
def test_asc_by_ranges(spark, tmp_path, split):
    r = random.Random(split)
    grid = [[r.choice([None, 0.0, -1.5, r.uniform(0, 1e6)]) for _ in range(7)] for _ in range(12)]
    asc_file(tmp_path / "one.asc", grid, -9999, "\n")
    asc_file(tmp_path / "two.asc", grid[:5], -1, "\r\n", True)
    want = {(i, j): v for i, row in enumerate(grid) for j, v in enumerate(row)}
    every = asc.scan_asc(spark, str(tmp_path / "*.asc"), split) if split > 1 else asc.scan_asc(spark, f"file://{tmp_path}", 3)
    assert values_of(every.filter("grid_id = 'one'")) == want
    assert values_of(every.filter("grid_id = 'two'")) == {k: v for k, v in want.items() if k[0] < 5}
    got = every.filter("grid_id in ('one') and row between 3 and 7 and col > 1 and col < 5")
    assert values_of(got) == {k: v for k, v in want.items() if 3 <= k[0] <= 7 and 1 < k[1] < 5}
    assert values_of(every.filter("grid_id = 'one' and row in (2, 9) and value is not null")) == {k: v for k, v in want.items() if k[0] in (2, 9) and v is not None}
    assert every.filter("row > 5 and row < 3").count() == 0 and every.filter("col = 99").count() == 0


def test_asc_ranges_that_are_read(tmp_path):
    """A window opens the ranges that hold its rows, and no other."""
    index = {"grids": {"g": {"nodata_value": -1}}, "ranges": [["g.asc", "g", 100 * i, 100 * i + 100, 10 * i, 10] for i in range(50)]}
    (tmp_path / "i.json").write_text(json.dumps(index))
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    def read(*filters):
        reader = asc._Reader({"path": str(tmp_path), "index": str(tmp_path / "i.json")})
        left = list(reader.pushFilters(list(filters)))
        return left, [p.first for p in reader.partitions()]

    assert read(GreaterThanOrEqual(("row",), 95), LessThan(("row",), 121)) == ([], [90, 100, 110, 120])
    assert read(EqualTo(("row",), 9))[1] == [0] and read(EqualTo(("grid_id",), "h"))[1] == []
    some, value = In(("row",), (5, 22)), EqualTo(("value",), 3.0)
    assert read(some, value) == ([some, value], [0, 10, 20])


def test_asc_written_by_tasks(spark, tmp_path):
    r = random.Random(9)
    at = {(i, j): r.choice([None, r.uniform(-5, 5)]) for i in range(40) for j in range(11) if r.random() < 0.8 and i not in (0, 17, 18)}
    at[(39, 10)] = 1.0
    path = tmp_path / "out"
    asc.write_asc(cells_of(spark, at).repartition(5), str(path), 2.0, 10.0, 100.0, split=200)
    whole = {(i, j): at.get((i, j)) for i in range(40) for j in range(11)}
    back = spark.read.format("asc").load(str(path))
    assert values_of(back) == whole and back.first().grid_id == "grid"
    assert values_of(back.filter("row >= 30 and col = 4")) == {k: v for k, v in whole.items() if k[0] >= 30 and k[1] == 4}
    text = b"".join(f.read_bytes() for f in sorted((path / "grid").iterdir()))  # the files one after the other
    (tmp_path / "joined.asc").write_bytes(text)
    cells, grids = asc.read_asc(spark, str(tmp_path / "joined.asc"))
    assert values_of(cells) == whole
    assert (grids.first().height, grids.first().width, grids.first().y0) == (40, 11, 100.0)
    with pytest.raises(Exception, match="out"):
        asc.write_asc(cells_of(spark, at), str(path))
    asc.write_asc(cells_of(spark, {(0, 0): 7.0}).selectExpr("'a b' as grid_id", "*").unionByName(cells_of(spark, {(1, 1): 8.0}).selectExpr("'c' as grid_id", "*")), str(path), mode="overwrite")
    assert sorted(map(tuple, spark.read.format("asc").load(str(path)).filter("value is not null").collect())) == [("a b", 0, 0, 7.0), ("c", 1, 1, 8.0)]


def test_asc_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).selectExpr("'g' as grid_id", "cast(id as int) as row", "0 as col", "if(id = 77, double(raise_error('no')), 1D) as value")
    asc.register(spark)
    sorted_ = bad.repartitionByRange(4, "row").sortWithinPartitions("row")
    head = json.dumps({"g": {"ncols": 1, "nrows": 100, "cellsize": 1.0, "nodata_value": -9999.0}})
    with pytest.raises(Exception, match="no"):
        sorted_.write.format("asc").option("grids", head).mode("append").save(str(tmp_path / "bad"))
    assert list(tmp_path.iterdir()) == []
    gap = spark.range(100).filter("id <> 50").selectExpr("'g' as grid_id", "cast(id as int) as row", "0 as col", "1D as value").repartition(7, "row").sortWithinPartitions("row")
    with pytest.raises(Exception, match="missing or repeated"):
        gap.write.format("asc").option("grids", head).mode("append").save(str(tmp_path / "gap"))
    assert list(tmp_path.iterdir()) == []


def test_features_written_by_tasks(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.uniform(-50, 50), r.uniform(-50, 50), r.choice([None, r.uniform(0, 3)]), f'name "{i}"') for i in range(500)]
    points = spark.createDataFrame(rows, "id long, x double, y double, water_depth double, label string")
    path = str(tmp_path / "points")
    geojson.write_points(points, path, "EPSG:3857", most=40)
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = sorted(x[:4] for x in rows)
    assert plain(geojson.read_points(spark, path)) == want
    box = (-50, -50, -30, -35)
    assert plain(geojson.read_points(spark, path, bbox=box)) == [w for w in want if box[0] <= w[1] <= box[2] and box[1] <= w[2] <= box[3]]
    every, few = geojson._files(path, None), geojson._files(path, box)
    assert 0 < len(few) < len(every)
    for f in every:  # each is a whole document
        got = json.loads(open(f).read())
        assert got["type"] == "FeatureCollection" and got["crs"]["properties"]["name"] == "EPSG:3857" and {"id", "label"} <= set(got["features"][0]["properties"])
    assert geojson.read_points(spark, path, bbox=(900, 900, 901, 901)).count() == 0
    with pytest.raises(Exception, match="points"):
        geojson.write_points(points, path)
    geojson.write_points(points.limit(0), path, mode="overwrite")
    assert geojson.read_points(spark, path).count() == 0
    bad = points.select(F.when(F.col("id") == 250, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"), "x", "y")
    with pytest.raises(Exception, match="stop"):
        geojson.write_points(bad, str(tmp_path / "bad"))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("bad")]


def test_polygons_keep_their_properties(spark, tmp_path):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [(i, [[{"x": float(a), "y": float(b)} for a, b in ring] for ring in ([square(10 * i, 0, 8), square(10 * i + 2, 2, 3)] if i % 2 else [square(10 * i, 0, 8)])], f"p{i}", i / 2) for i in range(8)]
    polygons = spark.createDataFrame(rows, "poly_id long, rings array<array<struct<x:double,y:double>>>, name string, level double")
    path = str(tmp_path / "polygons")
    geojson.write_polygons(polygons, path)
    got = geojson.read_polygons(spark, path, properties=True)
    back = got.select("poly_id", "rings", got["properties"]["name"].alias("name"), got["properties"]["level"].cast("double").alias("level"))
    assert sorted(back.collect()) == sorted(polygons.collect())
    assert sorted(x.poly_id for x in geojson.read_polygons(spark, path, bbox=(12, 1, 31, 2)).collect()) == [1, 2, 3]


def test_geojson_is_read_by_lines(spark, tmp_path):
    """A file of many features is split over tasks, and names that look like other lines are read as they were written."""
    names = ["a,", "]}", "x\ny", '{"type":"Feature",', None]
    rows = [(i if i % 5 else None, names[i % 5], float(i), 1.0) for i in range(2000)]
    points = spark.createDataFrame(rows, "id long, name string, x double, y double").withColumn("water_depth", F.col("x") / 2)
    geojson.write_points(points.coalesce(1), str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        got = geojson.read_points(spark, str(tmp_path / "p"))
        assert got.rdd.getNumPartitions() > 8
        assert sorted((-1 if x.id is None else x.id, x.x, x.water_depth) for x in got.collect()) == sorted((-1 if i is None else i, x, x / 2) for i, _, x, _ in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ring = "array(array(named_struct('x', 0D, 'y', 0D), named_struct('x', 1D, 'y', 0D), named_struct('x', 1D, 'y', 1D)))"
    geojson.write_polygons(spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).withColumn("rings", F.expr(ring)), str(tmp_path / "q"))
    back = geojson.read_polygons(spark, str(tmp_path / "q"), properties=True).collect()
    assert {x.properties.get("name") for x in back} == set(names) and all(len(x.rings[0]) == 3 for x in back)

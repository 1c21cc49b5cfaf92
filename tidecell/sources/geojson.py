"""GeoJSON in and out: features by Spark's JSON reader, filters before geometry is touched, and a sink of part files.

``write_points`` and ``write_polygons`` give each task's features a file that is a FeatureCollection by itself, in a folder
that readers do not see; the commit adds an index with the box of each file and renames the folder, so a write that fails
leaves nothing. Features are sorted along a Z-order curve first, which keeps the boxes small: a reader with a bbox opens
only the files whose boxes it meets.

Edge cases: a feature without geometry is read with a null geometry, and is in no bbox; properties that are null stay null;
an empty table is a folder with an index and no file, read as no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .store import drop, exists, opened, read_text
from .tiles import morton

_POINT = "properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>"
_POLYGON = "properties:map<string,string>,geometry:struct<type:string,coordinates:string>"
_CRS = ", crs struct<properties:struct<name:string>>"
INDEX = "_index.json"
#: What a feature's line begins with.
_START = '{"type":"Feature",'
#: Features of a file, at most.
MOST = 1 << 20

Box = tuple[float, float, float, float]


def _index(path: str) -> dict | None:
    text = read_text(f"{path.rstrip('/')}/{INDEX}")
    return None if text is None else json.loads(text)


def _files(path: str, bbox: Box | None) -> list[str] | str:
    """What to read: of a folder with an index the files whose boxes meet bbox."""
    index = _index(path)
    if index is None:
        return path
    meets = lambda b: bbox is None or (b[0] <= bbox[2] and b[2] >= bbox[0] and b[1] <= bbox[3] and b[3] >= bbox[1])
    return [f"{path.rstrip('/')}/{name}" for name, _, box in index["files"] if bbox is None or box and meets(box)]


def _features(spark: SparkSession, path: str, kind: str, bbox: Box | None) -> DataFrame:
    """(pos, f): the place of each feature in its file, and the feature."""
    found = _files(path, bbox)
    if not found:
        return spark.createDataFrame([], f"pos int, f struct<{kind}>")
    if not (_index(path) or {}).get("lines"):
        return spark.read.schema(f"features array<struct<{kind}>>{_CRS}").json(found, multiLine=True).select(F.posexplode("features").alias("pos", "f"))
    line = spark.read.text(found).filter(F.col("value").startswith(_START)).select(F.regexp_replace("value", ",$", "").alias("value"))
    return line.select(F.from_json("value", f"struct<id:int,{kind}>").alias("f")).select(F.col("f.id").alias("pos"), "f")


def read_points(spark: SparkSession, path: str, depth: str = "water_depth", bbox: Box | None = None) -> DataFrame:
    """(id, x, y, water_depth); only points may be there."""
    f = _features(spark, path, _POINT, bbox)
    kinds = F.when(F.col("f.geometry.type") == "Point", F.col("f.geometry.coordinates")).when(F.col("f.geometry").isNotNull(), F.raise_error(F.lit("not a point")).cast("array<double>"))
    out = f.select(F.col("f.properties")["id"].cast("long").alias("id"), kinds.alias("c"), F.col("f.properties")[depth].cast("double").alias(depth))
    out = out.select("id", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), depth)
    return out.filter(F.col("x").between(bbox[0], bbox[2]) & F.col("y").between(bbox[1], bbox[3])) if bbox else out


def read_polygons(spark: SparkSession, path: str, bbox: Box | None = None, properties: bool = False) -> DataFrame:
    """(poly_id, rings), with properties also a map of these: rings of Polygon and MultiPolygon features, the closing point
    left out. poly_id is the property of that name, or else the feature's place in its file."""
    f = _features(spark, path, _POLYGON, bbox)
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("f.geometry.type") == "Polygon", one).otherwise(many)
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    open_ = F.transform(rings, lambda r: F.transform(F.slice(r, 1, F.size(r) - 1), point))
    own = F.coalesce(F.try_element_at(F.col("f.properties"), F.lit("poly_id")).cast("long"), F.col("pos").cast("long"))
    out = f.select(own.alias("poly_id"), open_.alias("rings"), F.col("f.properties").alias("properties"))
    if bbox:
        flat = F.flatten("rings")
        side = lambda k, how: how(F.transform(flat, lambda p: p[k]))
        out = out.filter((side("x", F.array_min) <= bbox[2]) & (side("x", F.array_max) >= bbox[0]) & (side("y", F.array_min) <= bbox[3]) & (side("y", F.array_max) >= bbox[1]))
    return out if properties else out.drop("properties")


def crs(spark: SparkSession, path: str) -> str | None:
    row = spark.read.schema("crs struct<properties:struct<name:string>>").json(path, multiLine=True).first()
    return row and row["crs"] and row["crs"]["properties"]["name"]


def _feature(properties: list[str], geometry: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def _point() -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))


def _polygon() -> Column:
    ring = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    return F.struct(F.lit("Polygon").alias("type"), F.transform("rings", ring).alias("coordinates"))


def point_features(points: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per line."""
    return points.select(_feature(properties, _point()).alias("value"))


def polygon_features(polygons: DataFrame, properties: list[str] | None = None) -> DataFrame:
    return polygons.select(_feature(properties or ["poly_id"], _polygon()).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    features.write.text(path)


def _written(features: DataFrame, path: str, crs: str | None, mode: str, most: int) -> None:
    """features: (feature, xmin, ymin, xmax, ymax)."""
    register(features.sparkSession)
    step = F.greatest(F.lit(1e-9), F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")) / 65536
    size = features.agg(F.min("xmin").alias("x0"), F.min("ymin").alias("y0"), F.max("xmax").alias("x1"), F.max("ymax").alias("y1")).agg(F.first("x0").alias("x0"), F.first("y0").alias("y0"), step.alias("step")).first()
    at = lambda c, low: F.floor((F.col(c) - F.lit(low)) / F.lit(size["step"]))
    place = morton(at("ymin", size["y0"]), at("xmin", size["x0"])) if size["x0"] is not None else F.lit(0).cast("long")
    out = features.withColumn("__at", place).repartitionByRange("__at", F.xxhash64("feature")).sortWithinPartitions("__at").drop("__at")
    out.write.format("geojson").option("crs", crs or "").option("most", most).mode(mode).save(path)


def write_points(points: DataFrame, path: str, crs: str | None = None, mode: str = "append", most: int = MOST) -> None:
    """(x, y, ...): all other columns are properties."""
    rest = [c for c in points.columns if c not in ("x", "y")]
    _written(points.select(_feature(rest, _point()).alias("feature"), *[F.col(c).cast("double").alias(n) for n, c in (("xmin", "x"), ("ymin", "y"), ("xmax", "x"), ("ymax", "y"))]), path, crs, mode, most)


def write_polygons(polygons: DataFrame, path: str, crs: str | None = None, mode: str = "append", most: int = MOST) -> None:
    """(rings, ...): all other columns are properties."""
    rest, flat = [c for c in polygons.columns if c != "rings"], F.flatten("rings")
    side = lambda k, how, n: how(F.transform(flat, lambda p: p[k])).cast("double").alias(n)
    _written(polygons.select(_feature(rest, _polygon()).alias("feature"), side("x", F.array_min, "xmin"), side("y", F.array_min, "ymin"), side("x", F.array_max, "xmax"), side("y", F.array_max, "ymax")), path, crs, mode, most)


@dataclass
class _Parts(WriterCommitMessage):
    """Of a task's files: [name, features, box]."""

    files: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.crs = options["path"].rstrip("/"), overwrite, options.get("crs")
        self.most = int(options.get("most", MOST))
        self.hidden = f"{self.path}.{uuid.uuid4().hex}.writing"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Parts:
        fs, top = opened(self.hidden)
        fs.create_dir(top, recursive=True)
        done, out, n, box = _Parts(), None, 0, None
        named = f', "crs": {json.dumps({"type": "name", "properties": {"name": self.crs}})}' if self.crs else ""

        def close() -> None:
            if out:
                out.write(b"\n]}\n")
                out.close()
                done.files[-1][1:] = [n, box]

        for batch in iterator:
            columns = [c.to_pylist() for c in batch.columns]
            for feature, *own in zip(*columns):
                if out is None or n >= self.most:
                    close()
                    name = f"{uuid.uuid4().hex}.json"
                    done.files.append([name, 0, None])
                    out, n, box = fs.open_output_stream(f"{top}/{name}"), 0, None
                    out.write(f'{{"type": "FeatureCollection"{named}, "features": [\n'.encode())
                out.write(((",\n" if n else "") + f'{_START}"id":{n},' + feature.removeprefix(_START)).encode())
                n += 1
                if None not in own:
                    box = own if box is None else [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        close()
        return done

    def commit(self, messages: list) -> None:
        fs, top = opened(self.hidden)
        _, final = opened(self.path)
        fs.create_dir(top, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[0])
        kept = {f[0] for f in files}
        from pyarrow.fs import FileSelector

        for info in fs.get_file_info(FileSelector(top)):
            if info.base_name not in kept:  # of an attempt that failed
                fs.delete_file(info.path)
        with fs.open_output_stream(f"{top}/{INDEX}") as out:
            out.write(json.dumps({"files": files, "lines": True}).encode())
        if exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            drop(self.path)
        fs.move(top, final)

    def abort(self, messages: list) -> None:
        drop(self.hidden)


class GeoJsonDataSource(DataSource):
    """For writing; ``read_points`` and ``read_polygons`` read what it writes."""

    @classmethod
    def name(cls):
        return "geojson"

    def schema(self):
        return "feature string, xmin double, ymin double, xmax double, ymax double"

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoJsonDataSource)

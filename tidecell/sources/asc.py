"""ESRI ASCII grids: a data source that reads files by ranges of bytes and writes them by tasks.

``spark.read.format("asc").load(path)`` gives (grid_id, row, col, value) of the files at path. A range of bytes yields the
lines that begin in it; what row its first line is comes from the lines of the ranges before, which an index holds: one
entry for each SPLIT bytes. ``scan_asc`` counts them in a Spark job; what this source has written carries its index along.
Conditions on row, col and grid_id are pushed down: ranges and files beyond them are not opened, columns beyond them not
parsed. Without an index a file is one range.

``write_asc`` writes a grid as a folder of part files, which one after the other are the file: each task writes its rows
into a folder that readers do not see; the commit drops what failed attempts have left, adds header and index and renames
the folder. A write that fails leaves nothing.

``read_asc`` reads whole files by Spark's own text reader, from any store that Spark reads; the data source wants one that
Arrow's file systems reach (local or mounted folders, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from tidecell.functions.stage import shared_dir
from tidecell.schemas import CELLS, NODATA

from .store import drop, exists, listed, opened, read_text, write_text

_HEADER = r"^\s*(ncols|nrows|xllcorner|yllcorner|xllcenter|yllcenter|cellsize|nodata_value)\s+(\S+)"


def read_asc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """-> (cells, grids), on the JVM. A file's lines are numbered within the file, whose order Spark keeps as a whole."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1).alias("grid_id"), F.split("value", r"\r?\n").alias("lines"))
    head = F.filter("lines", lambda x: F.lower(x).rlike(_HEADER))
    pairs = F.map_from_entries(F.transform(head, lambda x: F.struct(F.regexp_extract(F.lower(x), _HEADER, 1).alias("k"), F.regexp_extract(x, r"(\S+)\s*$", 1).cast("double").alias("v"))))
    body = F.filter("lines", lambda x: ~F.lower(x).rlike(_HEADER) & (F.trim(x) != ""))
    f = files.select("grid_id", pairs.alias("h"), body.alias("body"))
    h = lambda k, other=None: F.coalesce(F.col("h")[k], F.lit(other).cast("double"))
    res = h("cellsize")
    x0 = F.coalesce(h("xllcorner"), h("xllcenter") - res / 2)
    low = F.coalesce(h("yllcorner"), h("yllcenter") - res / 2)
    grids = f.select("grid_id", F.lit(None).cast("int").alias("crs_epsg"), h("nrows").cast("int").alias("height"), h("ncols").cast("int").alias("width"), x0.alias("x0"), (low + h("nrows") * res).alias("y0"), res.alias("res"), h("nodata_value", NODATA).alias("nodata"))
    rows = f.select("grid_id", h("nodata_value", NODATA).alias("nodata"), F.posexplode("body").alias("row", "line"))
    cells = rows.select("grid_id", "nodata", "row", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "v"))
    v = F.col("v").cast("double")
    return cells.select("grid_id", "row", "col", F.when((v != F.col("nodata")) & ~F.isnan(v), v).alias("value")), grids


def asc_lines(cells: DataFrame, res: float = 1.0, x0: float = 0.0, y0: float = 0.0, nodata: float = NODATA) -> DataFrame:
    """(n, line): the file's lines; a row of the grid is gathered in one group, never the grid. n orders the lines."""
    v = F.coalesce(F.col("value"), F.lit(nodata))
    body = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", v.alias("v")))).alias("c"))
    lines = body.select((F.col("row") + 6).alias("n"), F.array_join(F.transform("c", lambda s: s["v"].cast("string")), " ").alias("line"))
    size = cells.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    text = [("ncols", F.col("w").cast("string")), ("nrows", F.col("h").cast("string")), ("xllcorner", F.lit(str(x0))), ("yllcorner", (F.lit(y0) - F.col("h") * res).cast("string")), ("cellsize", F.lit(str(res))), ("NODATA_value", F.lit(str(nodata)))]
    head = size.select(F.posexplode(F.array(*[F.concat(F.lit(k + " "), t) for k, t in text])).alias("n", "line"))
    return head.unionAll(lines)


#: Bytes of a range, and cells of a batch.
SPLIT, BATCH = 32 << 20, 1 << 16
INDEX = "_index.json"
_KEYS = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def lines_of(path: str, start: int, stop: int) -> list[bytes]:
    """The lines that begin in the range of bytes, without blank ones."""
    fs, at = opened(path)
    with fs.open_input_file(at) as f:
        size, begin = f.size(), max(start - 1, 0)
        f.seek(begin)
        data = f.read(min(stop, size) - begin)
        if start:
            cut = data.find(b"\n")
            data = data[cut + 1 :] if cut >= 0 else b""
        if data and not data.endswith(b"\n"):
            more = []
            while not (more and b"\n" in more[-1]) and f.tell() < size:
                more.append(f.read(1 << 16))
            data += b"".join(more).partition(b"\n")[0]
    return [x for x in data.split(b"\n") if x.strip()]


def _is_header(line: bytes) -> bool:
    return line.split(None, 1)[0].decode("ascii", "replace").lower() in _KEYS


def _header(lines: list[bytes]) -> dict:
    return {k.lower(): float(v) for k, v in (x.decode().split()[:2] for x in lines)}


@dataclass
class Range(InputPartition):
    """Lines of a file, the first of which is row ``first``; rows is None if they were not counted."""

    file: str
    grid_id: str
    start: int
    stop: int
    first: int
    rows: int | None
    nodata: float = NODATA


def _named(path: str) -> str:
    return re.sub(r"\.\w+$", "", path.rstrip("/").rpartition("/")[2])


def index_asc(spark: SparkSession, path: str, split: int = SPLIT) -> dict:
    """{"grids": header by grid_id, "ranges": [file, grid_id, start, stop, first, rows]} of the files at path, a glob perhaps.
    The ranges are read and counted by tasks; the driver gets one row for each."""
    cut = [(f, s, min(s + split, size)) for f, size in listed(path) for s in range(0, max(size, 1), split)]
    if not cut:
        return {"grids": {}, "ranges": []}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                lines = lines_of(file, start, stop)
                head = [x for x in lines[: len(_KEYS)] if _is_header(x)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([file], [start], [stop], [len(lines) - len(head)], [json.dumps(_header(head))])], ["file", "start", "stop", "rows", "head"])

    asked = spark.createDataFrame(cut, "file string, start long, stop long").repartition(len(cut))
    found = sorted(asked.mapInArrow(count, "file string, start long, stop long, rows long, head string").collect())
    grids, ranges, before = {}, [], {}
    for file, start, stop, rows, head in found:
        name = _named(file)
        grids[name] = grids.get(name, {}) | json.loads(head)
        ranges.append([file, name, start, stop, before.get(file, 0), rows])
        before[file] = before.get(file, 0) + rows
    return {"grids": grids, "ranges": ranges}


def scan_asc(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(grid_id, row, col, value) of the files at path, read by ranges; the index goes to the shared folder."""
    register(spark)
    at = f"{shared_dir(spark)}/tidecell/asc-index-{uuid.uuid4().hex}.json"
    write_text(at, json.dumps(index_asc(spark, path, split)))
    return spark.read.format("asc").option("index", at).load(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index = options["path"], options.get("index")
        self.low, self.high = {"row": 0, "col": 0}, {"row": 1 << 31, "col": 1 << 31}
        self.grids: set | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and name in ("grid_id", "row", "col"):
                continue
            if name == "grid_id" and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.grids = some if self.grids is None else self.grids & some
            elif name in self.low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value + (not isinstance(f, LessThan)))
            elif name in self.low and isinstance(f, In) and f.value:
                self.low[name], self.high[name] = max(self.low[name], min(f.value)), min(self.high[name], max(f.value) + 1)
                yield f
            else:
                yield f

    def partitions(self):
        text = read_text(self.index or f"{self.path.rstrip('/')}/{INDEX}")
        if text is None:
            every = [Range(f, _named(f), 0, size, 0, None) for f, size in listed(self.path)]
        else:
            found = json.loads(text)
            base = "" if self.index else f"{self.path.rstrip('/')}/"
            every = [Range(base + f, g, a, b, first, rows, found["grids"][g].get("nodata_value", NODATA)) for f, g, a, b, first, rows in found["ranges"]]
        kept = [x for x in every if (self.grids is None or x.grid_id in self.grids) and (x.rows is None or x.first < self.high["row"] and x.first + x.rows > self.low["row"])]
        return kept if self.low["col"] < self.high["col"] else []

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there is no range
            return
        lines = lines_of(partition.file, partition.start, partition.stop)
        nodata = partition.nodata
        while lines and _is_header(lines[0]):
            nodata = _header([lines[0]]).get("nodata_value", nodata)
            lines.pop(0)
        first, c0, c1 = max(self.low["row"] - partition.first, 0), self.low["col"], self.high["col"]
        lines = lines[first : max(self.high["row"] - partition.first, 0)]
        rows, cols, values, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            v = np.concatenate(values)
            columns = [pa.array([partition.grid_id] * len(v)), pa.array(np.concatenate(rows), pa.int32()), pa.array(np.concatenate(cols), pa.int32()), pa.array(v, pa.float64(), mask=(v == nodata) | np.isnan(v))]
            rows.clear(), cols.clear(), values.clear()
            return pa.RecordBatch.from_arrays(columns, CELLS.fieldNames())

        for i, line in enumerate(lines):
            v = np.array(line.split(None, c1)[c0:c1] if c1 < 1 << 31 else line.split()[c0:], np.float64)
            rows.append(np.full(len(v), partition.first + first + i, np.int32)), cols.append(np.arange(c0, c0 + len(v), dtype=np.int32)), values.append(v)
            held += len(v)
            if held >= BATCH:
                yield batch()
                held = 0
        if held:
            yield batch()


@dataclass
class _Parts(WriterCommitMessage):
    """Of a task's files: (name in the hidden folder, grid_id, first row, rows, ranges (start, stop, first, rows))."""

    files: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        if schema.fieldNames() != CELLS.fieldNames():
            raise ValueError(f"an ASCII grid wants the columns {', '.join(CELLS.fieldNames())}")
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.grids, self.split = json.loads(options["grids"]), int(options.get("split", SPLIT))
        self.hidden = f"{self.path}.{uuid.uuid4().hex}.writing"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Parts:
        fs, top = opened(self.hidden)
        fs.create_dir(top, recursive=True)
        done, out, file, line, now = _Parts(), None, None, None, None

        def put(text: str) -> None:
            nonlocal out
            raw = text.encode()
            ranges = file[4]
            if not ranges or ranges[-1][1] - ranges[-1][0] + len(raw) > self.split:
                at = ranges[-1][1] if ranges else 0
                ranges.append([at, at, file[2] + file[3], 0])
            ranges[-1][1] += len(raw)
            ranges[-1][3] += 1
            file[3] += 1
            out.write(raw)

        def shown(values: np.ndarray, nodata: float) -> str:
            return " ".join(map(str, np.where(np.isnan(values), nodata, values).tolist())) + "\n"

        def end_row() -> None:
            if now is not None:
                put(shown(line, self.grids[now[0]]["nodata_value"]))

        for batch in iterator:
            grid, row, col, value = batch.columns
            grid, row, col = grid.to_pylist(), row.to_numpy(), col.to_numpy()
            value = value.cast(pa.float64()).to_numpy(zero_copy_only=False)
            cuts = [0, *[i for i in range(1, len(grid)) if grid[i] != grid[i - 1] or row[i] != row[i - 1]], len(grid)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                key = (grid[i], int(row[i]))
                if key != now:
                    head = self.grids[key[0]]
                    end_row()
                    if now is not None and (key[0] == now[0] and key[1] < now[1]):
                        raise ValueError("rows must come in order")
                    if now is None or key[0] != now[0]:
                        if out:
                            out.close()
                        file = [f"{uuid.uuid4().hex}.part", key[0], key[1], 0, []]
                        done.files.append(file)
                        out = fs.open_output_stream(f"{top}/{file[0]}")
                    else:
                        for _ in range(now[1] + 1, key[1]):
                            put(shown(np.full(int(head["ncols"]), np.nan), head["nodata_value"]))
                    line, now = np.full(int(head["ncols"]), np.nan), key
                inside = col[i:j] >= 0  # a row may be told to be there by a column of -1
                line[col[i:j][inside]] = value[i:j][inside]
        end_row()
        if out:
            out.close()
        return done

    def commit(self, messages: list) -> None:
        fs, top = opened(self.hidden)
        _, final = opened(self.path)
        fs.create_dir(top, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[1], f[2]))
        index, used = {"grids": self.grids, "ranges": []}, set()
        for grid, head in self.grids.items():
            fs.create_dir(f"{top}/{grid}")
            with fs.open_output_stream(f"{top}/{grid}/header.asc") as out:
                out.write("".join(f"{k} {v}\n" for k, v in head.items()).encode())
            next_row = 0
            for name, _, first, rows, ranges in (f for f in files if f[1] == grid):
                if first != next_row:
                    self.abort(messages)
                    raise ValueError(f"rows {next_row} to {first - 1} of {grid} are missing or repeated")
                at = f"{grid}/row-{first:012d}.asc"
                fs.move(f"{top}/{name}", f"{top}/{at}")
                index["ranges"] += [[at, grid, *r] for r in ranges]
                used.add(name)
                next_row += rows
            if next_row != int(head["nrows"]):
                self.abort(messages)
                raise ValueError(f"{grid} has {next_row} rows, not {int(head['nrows'])}")
        from pyarrow.fs import FileSelector

        for info in fs.get_file_info(FileSelector(top)):
            if info.path.endswith(".part"):  # of an attempt that failed
                fs.delete_file(info.path)
        with fs.open_output_stream(f"{top}/{INDEX}") as out:
            out.write(json.dumps(index).encode())
        if exists(self.path):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            drop(self.path)
        fs.move(top, final)

    def abort(self, messages: list) -> None:
        drop(self.hidden)


def write_asc(cells: DataFrame, path: str, res: float = 1.0, x0: float = 0.0, y0: float = 0.0, nodata: float = NODATA, mode: str = "append", split: int = SPLIT) -> None:
    """Writes (row, col, value), or with grid_id many grids, as a folder for each grid whose files, in order of name, are the
    raster. x0, y0 is the upper left corner. A cell that is not there is written as no-data."""
    register(cells.sparkSession)
    named = cells if "grid_id" in cells.columns else cells.withColumn("grid_id", F.lit("grid"))
    size = named.groupBy("grid_id").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    grids = {r["grid_id"]: {"ncols": int(r["w"]), "nrows": int(r["h"]), "xllcorner": x0, "yllcorner": y0 - r["h"] * res, "cellsize": res, "nodata_value": nodata} for r in size.collect()}
    rows = size.select("grid_id", F.explode(F.sequence(F.lit(0), F.col("h").cast("int") - 1)).alias("row"), F.lit(-1).alias("col"), F.lit(None).cast("double").alias("value"))
    every = named.select("grid_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value")).unionByName(rows)
    sorted_ = every.repartitionByRange("grid_id", "row").sortWithinPartitions("grid_id", "row", "col")
    sorted_.write.format("asc").option("grids", json.dumps(grids)).option("split", split).mode(mode).save(path)


class AscDataSource(DataSource):
    @classmethod
    def name(cls):
        return "asc"

    def schema(self):
        return CELLS

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand conditions to data sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AscDataSource)

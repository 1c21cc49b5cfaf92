"""Fill-in-middle transformation by DuckDB inside Spark's tasks.

A text is cut into units, runs of A-Za-z or single other characters, and two cuts at hashed places make a prefix, a
middle and a suffix. They are put together with three sentinels as prefix, suffix, middle (psm) or suffix, prefix, middle
(spm); a share of the documents, empty texts and texts that hold a sentinel stay plain. Every choice hangs on doc_id
alone, so reruns and lost tasks agree.

Each Arrow batch is cut into slices of about a megabyte of text, and each slice is registered with the task's own DuckDB
and answered by one statement: no row passes through Python. A task holds one slice and the units of its texts, some 100
bytes for each unit of the slice or of one longer text. The transformation is a projection: nothing is shuffled.

Edge cases: a null text counts as empty; a null doc_id hashes as the empty string; documents that repeat are all returned,
alike if doc_id and text are; an empty table gives an empty result; columns but doc_id and text play no part, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_of

#: Seed of the hash, of 100 documents those that are transformed, of 100 of these those that put the suffix first.
SEED, RATE, SPM = 1, 90, 20
SENTINELS = ("<P>", "<S>", "<M>")
_UNIT = "[A-Za-z]+|[^A-Za-z]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cut_sql(seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """DuckDB SQL: batch (doc_id, text) -> (doc_id, n, form, prefix_chars, middle_chars, output)."""
    p, s, m = map(_quoted, sentinels)
    word = lambda i: f"cast('0x' || substr(h, {8 * i + 1}, 8) as bigint)"
    join = lambda a, b: f"coalesce(array_to_string(list_slice(u, {a}, {b}), ''), '')"
    return f"""
      select doc_id, n, form,
        case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
        case form when 'plain' then t when 'psm' then {p} || p || {s} || s || {m} || m else {s} || s || {p} || p || {m} || m end as output
      from (
        select doc_id, t, n, form, {join("1", "lo")} as p, {join("lo + 1", "hi")} as m, {join("hi + 1", "n")} as s
        from (
          select doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
            case when t = '' or contains(t, {p}) or contains(t, {s}) or contains(t, {m}) or h3 % 100 >= {int(rate)} then 'plain' when h4 % 100 < {int(spm)} then 'spm' else 'psm' end as form
          from (
            select doc_id, t, u, cast(len(u) as bigint) as n, {word(0)} as h1, {word(1)} as h2, {word(2)} as h3, {word(3)} as h4
            from (
              select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') as u, sha256({_quoted(f"{seed}:")} || coalesce(cast(doc_id as varchar), '')) as h from batch))))"""


def restored(sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """SQL expression of form and output: the text they were made from. No part holds a sentinel, so each stands once."""
    p, s, m = map(_quoted, sentinels)
    between = lambda a, b: f"split_part(split_part(output, {a}, 2), {b}, 1)"
    middle = f"split_part(output, {m}, 2)"
    return f"case form when 'plain' then output when 'psm' then {between(p, s)} || {middle} || {between(s, m)} else {between(p, m)} || {middle} || {between(s, p)} end"


def through_duckdb(rows: DataFrame, text: str, sql: str, schema: str) -> DataFrame:
    """What the SQL gives for each slice of the rows, called batch there; slices are cut by the size of the column text."""
    at = rows.columns.index(text)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(name, kinds[x.split()[1]]) for name, x in zip(names, schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as db:
            for batch in batches:
                _, starts, ends = utf8_of(batch.column(at))
                for i, j in slices(starts, ends):
                    db.register("batch", pa.Table.from_batches([batch.slice(i, j - i)]))
                    found = db.sql(sql).to_arrow_table()
                    db.unregister("batch")
                    yield from found.select(names).cast(arrow).to_batches()

    return rows.mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output): the training text of each document."""
    return through_duckdb(_texts(docs), "text", cut_sql(seed, rate, spm, sentinels), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, form, output) -> (doc_id, text): the way back."""
    sql = f"select doc_id, {restored(sentinels)} as text from batch"
    return through_duckdb(outputs.select("doc_id", "form", "output"), "output", sql, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): both ways in one statement."""
    sql = f"select doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256({restored()}) as restored_sha256 from ({cut_sql()})"
    return through_duckdb(_texts(docs), "text", sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")

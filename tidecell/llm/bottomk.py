"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct four-word shingles; its sketch is the SKETCH least of them (the
whole set, if it has no more). Documents with equal sets are combined first. The LISTED least values of a sketch are in
inverted lists: of the 8 least values of a union at a similarity of 0.8 each is shared with probability 0.8, so two such
sets miss each other in all lists with probability 0.2^8 = 3e-6. A list of more than BLOCK sets, as common phrases have, is
replaced by lists for two long-listed values together and a class of set sizes, as sets of similarity 0.8 differ by a
factor of 1.25 at most and stand in the own or the next class; what is still longer is dealt out over pairs of blocks.

Within a list the overlap of the sketches, and for those with enough of it the sketch of the union, estimate the
similarity: the share of the SKETCH least values of the union that are in both. A pair passes at PASS of 64, five standard
deviations below 0.8 (3e-6 of such pairs do not pass); where both sets lie within their sketches, the estimate is the
similarity itself and must reach 0.8. A list gives a spanning forest of the pairs that pass, never all pairs.

The components of these get their full sets, read again from the documents, and the exact similarity decides: 100 times
the shared shingles must reach 80 times those of the union (``verify``).

Edge cases: a null or empty text and one without words has an empty set and is linked with nothing, so its component_id
is its doc_id; fewer than four words are one shingle; null ids do not count as a component's least id unless all are null,
and kept is true for null ids only there; rows that repeat share a component; an empty table gives an empty result;
columns but doc_id and text play no part. Sets are told apart by 128 bits, shingles by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.operators.components import connected_components

from .common import materialize, utf8_of
from .paragraphs import hashed_words
from .simhash import deal
from .verify import OF, SHARED, digests, edges_of, groups_of, rows_of, sets_of, spanning, texts_of, verified

SHINGLE, SKETCH, LISTED, PASS = 4, 64, 8, 36
#: Sets of a list that one task compares.
BLOCK = 1024
#: A little over 100 / 80, so that rounded logarithms lose nothing.
_CLASS = 1.2501
_PAD = np.uint32(0xFFFFFFFF)
_U = np.uint64


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, d1, d2, n, low, sketch): n the set's size, low its LISTED least values, sketch the upper halves of the
    SKETCH least ones in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in texts_of(*utf8_of(batch.column(2))):
                line, hashes, n = sets_of(hashed_words(text), SHINGLE)
                bound = np.searchsorted(line, np.arange(n + 1))
                size = np.diff(bound)
                rank = np.arange(len(line)) - bound[line]
                least = lambda k: (hashes[rank < k], np.concatenate([[0], np.cumsum(np.minimum(size, k))]).astype(np.int32))
                low, at = least(LISTED)
                top, cut = least(SKETCH)
                half = (top >> _U(32)).astype("<u4").tobytes()
                binary = pa.array([half[4 * a : 4 * b] for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(low.view(np.int64)))
                d1, d2 = digests(line, hashes, n)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(d1), pa.array(d2), pa.array(size.astype(np.int64)), lists, binary]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "d1", "d2", "n", "low", "sketch"])

    return rows_of(docs).mapInArrow(run, "doc_id long, key long, d1 long, d2 long, n long, low array<long>, sketch binary")


def union_share(a: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the SKETCH least values of the union of a with each row, how many are in both, and how many there are."""
    both = np.sort(np.concatenate([np.broadcast_to(a, rows.shape), rows], axis=1), axis=1)
    real = both != _PAD
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    nth = np.cumsum(real & ~twice, axis=1)
    return (twice & (nth <= SKETCH)).sum(axis=1), np.minimum(nth[:, -1], SKETCH)


def candidates_of(sketch: list[bytes], size: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the sets whose union sketches pass."""
    rows = np.full((len(sketch), SKETCH), _PAD, np.uint32)
    rows[np.arange(SKETCH) < np.array([len(s) // 4 for s in sketch])[:, None]] = np.frombuffer(b"".join(sketch), "<u4")
    values, ids, often = np.unique(rows, return_inverse=True, return_counts=True)
    ids, often = ids.reshape(rows.shape), np.where(values == _PAD, 0, often)
    mark = np.zeros(len(values), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        mark[ids[i]] = values[ids[i]] != _PAD
        overlap = mark[ids[others]].sum(axis=1)
        mark[ids[i]] = False
        small, large = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        found = (OF * small >= SHARED * large) & (overlap >= np.where(large <= SKETCH, 2 * SHARED * small / (OF + SHARED), PASS))
        at = np.flatnonzero(found)
        shared, of = union_share(rows[i], rows[others[at]])
        found[at] = np.where(of < SKETCH, OF * shared >= SHARED * of, shared >= PASS)
        return found

    return spanning(np.argsort(-often[ids].sum(axis=1), kind="stable"), len(rows), near)


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from edges_of((ids, candidates_of(sketch, np.array(n))) for ids, n, sketch in groups_of(batches) if len(ids) > 1)


def candidates(known: DataFrame) -> DataFrame:
    """Distinct sets (id, n, low, sketch) -> pairs (a, b) of ids with the same components as all pairs that pass."""
    members = known.select("id", "n", F.explode("low").alias("v"))
    sizes = materialize(members.groupBy("v").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "bottomk-lists")
    shared = members.join(sizes, "v")
    short = shared.filter(F.col("many") <= BLOCK).select("id", F.col("v").alias("key"), F.lit(1).alias("blocks"))
    long = shared.filter(F.col("many") > BLOCK).groupBy("id", "n").agg(F.array_sort(F.collect_list("v")).alias("v"))
    size = F.floor(F.ln("n") / float(np.log(_CLASS)))
    twos = F.flatten(F.transform("v", lambda x: F.transform(F.filter("v", lambda y: y > x), lambda y: F.xxhash64(x, y))))
    pairs = long.select("id", "n", F.explode(twos).alias("two")).select("id", "two", F.explode(F.array(size, size + 1)).alias("class"))
    pairs = materialize(pairs.select("id", F.xxhash64("two", "class").alias("key")), "bottomk-twos")
    many = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("blocks"))
    keys = short.unionByName(pairs.join(many, "key").select("id", "key", "blocks"))
    dealt = deal(keys.join(known.select("id", "n", "sketch"), "id").select("key", "blocks", "id", "n", "sketch"), "id", "key")
    return dealt.mapInArrow(_passing, "a long, b long").distinct()


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, n, component_id) of every row; n is the set's size."""
    rows = materialize(sketches(docs), "bottomk-sketches")
    read = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("read")
    known = rows.filter("n > 0").groupBy("d1", "d2").agg(read, *(F.first(c).alias(c) for c in ("n", "low", "sketch")))
    known = materialize(known.withColumn("id", F.monotonically_increasing_id()), "bottomk-sets")
    rooted = verified(docs, known, connected_components(candidates(known)), SHINGLE)
    labels = materialize(known.join(rooted, known["id"] == rooted["node"], "left").select("d1", "d2", F.coalesce("root", "id").alias("root"), "read.doc_id"), "bottomk-roots")
    least = labels.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = materialize(labels.join(least, "root").select("d1", "d2", "component_id"), "bottomk-labels")
    some = rows.filter("n > 0").join(labels, ["d1", "d2"]).select("doc_id", "n", "component_id")
    return some.unionAll(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): kept is the document with the least id of each component."""
    return group(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

"""Links between shingle sets, exactly verified within the components of candidates.

Candidates come as components; their texts are read again and make their full sets of shingles. A component of up to
SETS sets is searched by one task. In a larger one all sets are first held against one hub, the set with the most common
values, as copies of one text link to it; only those that do not are then held against the whole component, by pairs
of blocks. So a group of near copies of one text costs as many comparisons as it has members, and no link is lost. What
comes out is a spanning forest of the links, never all pairs.

Texts are told apart by 128 bits of their sets, shingles by 64. They are read by (doc_id, hash of the text), so null and
repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import discard
from tidecell.operators.components import connected_components

from .common import materialize, slices, utf8_of
from .paragraphs import _mix, hashed_words, shingled

#: The similarity is SHARED / OF.
SHARED, OF = 80, 100
#: Sets and shingles of a component that one task compares.
SETS, SET_WORDS = 1024, 1 << 20
_LEAST = 8
_U = np.uint64


def texts_of(data, starts, ends) -> Iterator[tuple[int, int, np.ndarray]]:
    """Slices (i, j, bytes) of texts, one to a line."""
    for i, j in slices(starts, ends):
        parts = [x for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist()) for x in (np.where(data[s:e] == 10, np.uint8(32), data[s:e]), np.array([10], np.uint8))]
        yield i, j, np.concatenate(parts)[:-1]


def sets_of(hashed: tuple, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What ``hashed_words`` gives of texts, one to a line -> (line of each distinct shingle of size words, its hash), by line
    and hash, and the lines. A text of fewer words is one shingle."""
    of, words, n_words, digest = hashed
    line, hashes = shingled(of, words, size)
    few = np.flatnonzero((n_words > 0) & (n_words < size))
    line, hashes = np.concatenate([line, few]), np.concatenate([hashes, digest[few]])
    order = np.lexsort((hashes, line))
    line, hashes = line[order], hashes[order]
    new = np.concatenate([[True], (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])])[: len(line)]
    return line[new], hashes[new], len(n_words)


def digests(line: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each line's set, as two rows of longs."""
    out = np.zeros((2, n), np.uint64)
    if len(line):
        head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            out[k, line[head]] = np.add.reduceat(_mix(hashes * _U(2 * k + 1) + _U(seed)), head)
    return out.view(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key is the text's hash."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def spanning(order: np.ndarray, n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links of the places in order with any of n places; near tells which of others link to i.
    What is connected already is not compared again."""
    label, out = np.arange(n), []
    for i in order:
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        hit = others[near(i, others)]
        if len(hit):
            met, at = np.unique(label[hit], return_index=True)
            out += [(int(i), int(k)) for k in hit[at]]
            label[np.isin(label, met)] = label[i]
    return out


def links_of(sets: list[np.ndarray], first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the sets of the exact similarity; first: the places that are held against all, or all."""
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    size = np.array([len(s) for s in sets])
    stop = np.cumsum(size)
    mark = np.zeros(len(often), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = ids[stop[i] - size[i] : stop[i]]
        mark[own] = True
        hit = np.concatenate([[0], np.cumsum(mark[ids])])
        mark[own] = False
        both = hit[stop[others]] - hit[stop[others] - size[others]]
        return OF * both >= SHARED * (size[others] + size[i] - both)

    order = np.argsort(-np.add.reduceat(often[ids], stop - size) / size, kind="stable") if first is None else np.flatnonzero(first)
    return spanning(order, len(sets), near)


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Sorted rows (key, pair, columns...) -> the columns, as lists, of the rows of each (key, pair)."""
    held, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, pair = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        rest = [c.to_pylist() if not pa.types.is_list(c.type) else [x.values.to_numpy() for x in c] for c in batch.columns[2:]]
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(key)]
        for i, j in zip(bounds, bounds[1:]):
            if held and (key[i], pair[i]) == last:
                for h, c in zip(held, rest):
                    h.extend(c[i:j])
                continue
            if held:
                yield held
            held, last = [c[i:j] for c in rest], (key[i], pair[i])
    if held:
        yield held


def edges_of(found: Iterator[tuple[list, list]]) -> Iterator[pa.RecordBatch]:
    """(ids, pairs of places) of each group -> rows (a, b)."""
    a, b = [], []
    for ids, pairs in found:
        a += [ids[i] for i, _ in pairs]
        b += [ids[j] for _, j in pairs]
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted: (doc_id, key, d1, d2, id, root, blocks). -> (root, blocks, id, shingles). Of rows that repeat, those that a
    task reads give one set."""
    # by shuffle at every size: what is wanted grows with the documents
    want = wanted.select(F.col("doc_id").alias("want_id"), F.col("key").alias("want_key"), "d1", "d2", "id", "root", "blocks").hint("merge")
    texts = rows_of(docs)
    met = texts.join(want, texts["doc_id"].eqNullSafe(F.col("want_id")) & (texts["key"] == F.col("want_key"))).select("text", "d1", "d2", "id", "root", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            d1, d2, ids = (batch.column(k).to_numpy() for k in (1, 2, 3))
            for i, j, text in texts_of(*utf8_of(batch.column(0))):
                line, hashes, n = sets_of(hashed_words(text), size)
                bound = np.searchsorted(line, np.arange(n + 1))
                own = digests(line, hashes, n)
                rows = [r for r in np.flatnonzero((own[0] == d1[i:j]) & (own[1] == d2[i:j])).tolist() if ids[i + r] not in seen and not seen.add(ids[i + r])]
                at = pa.array([i + r for r in rows], pa.int64())
                sets = pa.array([hashes[bound[r] : bound[r + 1]].view(np.int64) for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(4).take(at), batch.column(5).take(at), batch.column(3).take(at), sets], ["root", "blocks", "id", "shingles"])

    return met.mapInArrow(run, "root long, blocks int, id long, shingles array<long>")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from edges_of((ids, links_of(sets)) for ids, sets in groups_of(batches) if len(ids) > 1)


def _held_against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from edges_of((ids, links_of(sets, np.array(rest))) for ids, rest, sets in groups_of(batches) if len(ids) > 1)


def _tasks() -> Column:
    """Into how many blocks sets of sizes n go."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / SETS), F.ceil(F.sum("n") / SET_WORDS)).cast("int")


def _large(sets: DataFrame) -> DataFrame:
    """sets: (root, blocks, id, shingles) of components of several blocks -> links (a, b): hubs first, then the rest."""
    low = sets.select("root", "id", F.explode(F.slice(F.array_sort("shingles"), 1, _LEAST)).alias("v"))
    often = materialize(low.groupBy("root", "v").agg(F.count(F.lit(1)).alias("often")), "verify-often")
    score = low.join(often, ["root", "v"]).groupBy("root", "id").agg(F.sum("often").alias("score"))
    hubs = score.groupBy("root").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"))
    hubs = materialize(hubs.join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("of_hub")), "hub"), "verify-hubs")
    both = F.size(F.array_intersect("shingles", "of_hub"))
    held = sets.join(hubs, "root").select("root", "id", "hub", F.size("shingles").alias("n"), (OF * both >= SHARED * (F.size("shingles") + F.size("of_hub") - both)).alias("linked"))
    held = materialize(held, "verify-held")
    rest = held.filter(~F.col("linked"))
    parts = materialize(rest.groupBy("root").agg(_tasks().alias("parts")), "verify-rest")
    # block i of all sets meets part j of the rest in group i * parts + j
    block, part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    sided = sets.join(parts, "root").join(rest.select("id", F.lit(True).alias("rest")), "id", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
    all_of = sided.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: block * F.col("parts") + j)).alias("pair"), "id", F.lit(False).alias("rest"), "shingles")
    these = sided.filter("rest").select("root", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i * F.col("parts") + part)).alias("pair"), "id", "rest", "shingles")
    dealt = all_of.unionByName(these).repartition("root", "pair").sortWithinPartitions("root", "pair")
    found = dealt.mapInArrow(_held_against_all, "a long, b long")
    return held.filter("linked").select(F.col("hub").alias("a"), F.col("id").alias("b")).unionAll(found)


def verified(docs: DataFrame, known: DataFrame, met: DataFrame, size: int) -> DataFrame:
    """known: distinct texts (id, d1, d2, n, read (.., doc_id, key)), met: components of candidates (node, root). -> (node,
    root): components of the links."""
    sized = known.select("d1", "d2", "read", "n", "id").join(met, known["id"] == met["node"])
    blocks = materialize(sized.groupBy("root").agg(_tasks().alias("blocks")), "verify-sizes")
    wanted = materialize(sized.join(blocks, "root").select("read.doc_id", "read.key", "d1", "d2", "id", "root", "blocks"), "verify-wanted")
    sets = materialize(shingle_sets(docs, wanted, size), "verify-sets")
    small = sets.filter("blocks = 1").select("root", F.lit(0).alias("pair"), "id", "shingles").repartition("root").sortWithinPartitions("root")
    links = small.mapInArrow(_linked, "a long, b long")
    large = sets.filter("blocks > 1")
    if not large.isEmpty():
        links = links.unionAll(_large(large))
    rooted = connected_components(links)
    discard(sets, wanted, blocks)
    return rooted

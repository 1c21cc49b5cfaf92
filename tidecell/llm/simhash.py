"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is the majority of the bits of the XXH64 hashes of a text's three-word shingles. Two fingerprints link if
at most TAU = 3 of 64 bits differ. The 64 bits form a ring of four segments. If at most 3 bits differ in all, some
chain of consecutive segments starts with 0 differences and has at most 1, 2 and 3 after its second, third and fourth
(l segments: at most floor(3 l / 4)). So the first segment is equal, and of the second at least one half is equal:
these 24 bits are the key under which candidates meet, the rest of the chain prunes them, the full distance decides.

Exact copies are combined before: only distinct fingerprints are compared. Within a key, a breadth-first search gives a
spanning forest of the links, never all pairs. A key with more than BLOCK fingerprints is dealt out over pairs of blocks.

Edge cases: a null or empty text has fingerprint zero and links like any other; fewer than three words are one shingle;
rows that repeat share a fingerprint; null ids stay null, and don't count as a component's smallest id unless all are
null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.operators.components import connected_components

from .common import materialize

SHINGLE, SEED, TAU, SEGMENTS, BLOCK = 3, 42, 3, 4, 8192
_PIECE = 1 << 20


def _word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words, in pieces that overlap by SHINGLE - 1 words, so a long text is never held as words at once."""
    if len(data) <= _PIECE:
        yield data.split()
        return
    at, carry = 0, []
    while at < len(data):
        stop = at + _PIECE
        gap = re.compile(rb"[\x20\x09-\x0D]").search(data, stop)
        stop = gap.end() if gap else len(data)
        words = carry + data[at:stop].split()
        yield words
        carry, at = words[-(SHINGLE - 1) :], stop


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    data, counts, n, few = (text or "").encode().lower(), np.zeros(64, np.int64), 0, []
    for words in _word_lists(data):
        few = words
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            n += len(hashes)
    if not n:
        # one or two words in all are one shingle; the hash's own bits are the majority
        return xxhash.xxh64_intdigest(b" ".join(few), SEED) if few else 0
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For the chain from segment ``start``: the bits of its first l segments, and how many of them may differ."""
    width, bits, out = 64 // SEGMENTS, 0, []
    for size in range(1, SEGMENTS + 1):
        bits |= ((1 << width) - 1) << (width * ((start + size - 1) % SEGMENTS))
        out.append((np.uint64(bits), TAU * size // SEGMENTS))
    return out


def within(diff: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Where a row of the 2-d differences keeps within each budget of the chain; the last is the full distance."""
    at = np.flatnonzero(np.bitwise_count(diff.ravel() & masks[1][0]) <= masks[1][1])
    for bits, budget in masks[2:]:
        at = at[np.bitwise_count(diff.ravel()[at] & bits) <= budget]
    found = np.zeros(diff.shape[1], bool)
    found[at % diff.shape[1]] = True
    return found


def forest(fps: np.ndarray, start_segment: int) -> list[tuple[int, int]]:
    """(first, member) for each fingerprint that links of this chain reach from a first one: breadth-first, each fingerprint
    is expanded once."""
    masks, fps = chain_masks(start_segment), fps.view(np.uint64)  # counts of bits want them unsigned
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        start, left = left[0], left[1:]
        front = np.array([start])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 64):
                near |= within(fps[front[i : i + 64], None] ^ fps[left][None, :], masks)
            front, left = left[near], left[~near]
            out += [(int(start), int(v)) for v in front]
    return out


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted rows (key, pair, longs...) -> the key and the longs, a row each, of each (key, pair); runs may span batches."""
    held: list[np.ndarray] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, pair, *longs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        longs = np.column_stack(longs)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
        bounds = [0, *cut.tolist(), len(key)]
        for i, j in zip(bounds, bounds[1:]):
            now = (key[i], pair[i])
            if held and now != last:
                yield int(last[0]), np.concatenate(held)
                held = []
            held.append(longs[i:j])
            last = now
    if held:
        yield int(last[0]), np.concatenate(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a.clear(), b.clear()
        return out

    for key, fps in runs(batches):
        fps = np.unique(fps)
        for i, j in forest(fps, key >> 25):
            a.append(int(fps[i])), b.append(int(fps[j]))
        if len(a) > 50_000:
            yield flush()
    yield flush()


def deal(members: DataFrame, what: str, *by: str) -> DataFrame:
    """Members of a group of several blocks go to every pair of blocks that has theirs: (by, pair, other columns), sorted."""
    own = F.pmod(F.xxhash64(what), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != own)
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(others, lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own)))
    rest = [c for c in members.columns if c not in (*by, "blocks")]
    return members.select(*by, F.explode(pairs).alias("pair"), *rest).repartition(*by, "pair").sortWithinPartitions(*by, "pair")


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a, b) with the same components as all links."""
    width = 64 // SEGMENTS
    segment = lambda i: F.shiftrightunsigned("fp", width * (i % SEGMENTS)).bitwiseAND((1 << width) - 1)
    half = lambda i, h: F.shiftrightunsigned("fp", width * (i % SEGMENTS) + h * width // 2).bitwiseAND((1 << width // 2) - 1)
    keys = [F.lit(i * 2 + h) * (1 << 24) + segment(i) * (1 << 8) + half(i + 1, h) for i in range(SEGMENTS) for h in range(2)]
    members = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys")
    met = members.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = deal(met.select("key", "blocks", "fp"), "fp", "key")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): one row per document, component_id the smallest doc_id that links reach."""
    known = materialize(fingerprints(docs), "simhash-fp")
    ids = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    rooted = connected_components(links(ids.select("fp")))
    rooted = materialize(ids.join(rooted, ids["fp"] == rooted["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id"), "simhash-roots")
    smallest = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    labels = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-labels")
    return known.join(labels, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    out = group(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

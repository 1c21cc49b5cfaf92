"""SimHash near-duplicates by similarity: five-word shingles with a Jaccard similarity of SIMILARITY or more.

``simhash`` links fingerprints within 3 bits. Texts of similarity 0.8 lie further apart, so here a fingerprint is wider
and its pairs are verified. It is the majority of WORDS x 64 hash bits of a text's distinct two-word shingles: an edit
touches no more of these than of five-word ones. At similarity 0.8 scattered single words change about 9 % of the bits,
one block that is appended, cut off or replaced changes 15 %, as it touches both kinds alike; other texts differ in half.
The keys are sized for the block: candidates meet where one of some keys of bits is equal. 14 bits and 48 keys do so with
probability 1 - (1 - 0.85^14)^48 = 0.994; of more than 2^20 texts keys have as many bits as leave some 64 texts to a value
of evenly spread keys, and there are so many keys that this probability stays (``key_plan``). Among those that meet, the
pigeonring filter decides: the first 128 bits form a ring of eight segments, and some chain of consecutive segments must
keep within TAU l / 8 differences after each l segments. That is so just where all segments together keep within TAU, which
is tested first, over many keys at once.

Texts with equal sets of five-word shingles are combined first. Within a key only a spanning forest is kept, never all
pairs; a key with more than BLOCK texts is dealt out over pairs of blocks. Within the components of these candidates the
exact similarity decides (``verify``).

Edge cases: null texts and texts without words are one group; with fewer than five words a text equals only its copies;
rows that repeat share a group; null ids don't count as a group's smallest id unless all are null, and of such a group the
text with the least hash stays; an empty table gives an empty result. Texts are told apart by 128 bits of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.operators.components import connected_components

from .common import materialize, utf8_of
from .paragraphs import SHINGLE, hashed_words, shingled
from .simhash import deal, runs
from .verify import digests, rows_of, sets_of, texts_of, verified

WORDS, KEY_BITS, SEGMENTS, TAU, BLOCK = 12, 14, 8, 32, 1 << 15
#: The share of bits that near copies have in common, and the share of them that is to meet in some key.
SAME, MET = 0.85, 0.994
#: Runs of up to _RUN rows are compared together, _CHUNK rows at a time, while they give no more than _HITS pairs.
_RUN, _CHUNK, _HITS = 4096, 1 << 15, 1 << 18
_FEATURE, _SEED, _ROWS = 2, 42, 255
_LANES = [f"w{i}" for i in range(WORDS)]
#: A byte's eight bits, one in each byte of a word: sums of up to 255 of them don't overflow.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _hash_lanes(hashes: np.ndarray) -> np.ndarray:
    """WORDS independent 64-bit hashes of each hash, as rows of bytes."""
    seeds = np.random.default_rng(_SEED).integers(1, 1 << 63, WORDS, dtype=np.uint64)
    x = hashes[:, None] ^ seeds
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.uint8)


def fingerprints_of(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints, WORDS unsigned longs a row, of n texts with the shingle hashes whose texts are in ``of``, ascending."""
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])])[: len(of)]
    of, hashes = of[new], hashes[new]
    counts = np.zeros((n, WORDS * 64), np.int64)
    step = 64 * _ROWS
    for i in range(0, len(of), step):
        at = of[i : i + step]
        change = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        cuts = np.union1d(change, np.arange(0, len(at), _ROWS))
        sums = np.add.reduceat(_SPREAD[_hash_lanes(hashes[i : i + step])], cuts, axis=0).view(np.uint8)
        np.add.at(counts, at[cuts], sums)
    total = np.bincount(of, minlength=n)[:, None]
    return np.packbits(2 * counts > total, axis=1, bitorder="little").view(np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, d1, d2, n, n_words, w0, w1, ...): the set's digest and size, and the fingerprint's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in texts_of(*utf8_of(batch.column(2))):
                hashed = hashed_words(text)
                of, words, n_words, _ = hashed
                line, hashes, n = sets_of(hashed, SHINGLE)
                fps = fingerprints_of(*shingled(of, words, _FEATURE), n).view(np.int64)
                size = np.bincount(line, minlength=n)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(x) for x in digests(line, hashes, n)), pa.array(size, pa.int64()), pa.array(n_words, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "d1", "d2", "n", "n_words", *_LANES])

    schema = "doc_id long, key long, d1 long, d2 long, n long, n_words long, " + ", ".join(f"{c} long" for c in _LANES)
    return rows_of(docs).mapInArrow(run, schema)


def pigeonring(diff: np.ndarray) -> np.ndarray:
    """Where the 128 differing bits, two unsigned longs a row, have a chain that keeps within its budgets all round."""
    counts = np.bitwise_count(np.ascontiguousarray(diff).view(np.uint16)).astype(np.uint8)
    found = np.zeros(len(diff), bool)
    for start in range(SEGMENTS):
        at = np.flatnonzero(counts[:, start] <= TAU // SEGMENTS)
        spent = counts[at, start]
        for size in range(2, SEGMENTS + 1):
            spent = spent + counts[at, (start + size - 1) % SEGMENTS]
            inside = spent <= TAU * size // SEGMENTS
            at, spent = at[inside], spent[inside]
        found[at] = True
    return found


def _bits(diff: np.ndarray) -> np.ndarray:
    return np.bitwise_count(diff[:, 0]) + np.bitwise_count(diff[:, 1])


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """(first, member) for each fingerprint that a first one reaches: breadth-first, each is expanded once."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        start = int(front[0])
        while front and len(left):
            diff = fps[left] ^ fps[front.pop()]
            near = _bits(diff) <= TAU
            near[near] = pigeonring(diff[near])
            out += [(start, int(v)) for v in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return out


def forests(fps: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of fingerprints, one after the other -> places (first, member) of a spanning forest of each."""
    end = np.repeat(np.cumsum(sizes), sizes)
    a, b, n, at = [], [], 0, np.arange(len(fps))
    for lag in range(1, max(sizes)):
        at = at[at + lag < end[at]]
        diff = fps[at] ^ fps[at + lag]
        near = np.flatnonzero(_bits(diff) <= TAU)
        near = near[pigeonring(diff[near])]
        a.append(at[near]), b.append(at[near] + lag)
        n += len(near)
        if n > _HITS:  # large groups of near copies: one search for each run
            begin = np.cumsum([0, *sizes])
            found = [(s + i, s + j) for s, e in zip(begin, begin[1:]) for i, j in forest(fps[s:e])]
            return tuple(np.array(found).T)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    first = np.arange(len(fps))
    while (first[a] != first[b]).any():
        least = np.minimum(first[a], first[b])
        np.minimum.at(first, first[a], least), np.minimum.at(first, first[b], least)
        first = first[first]
    member = np.flatnonzero(first != np.arange(len(fps)))
    return first[member], member


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        rows = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
        fps = rows[:, 1:].astype(np.int64).view(np.uint64)
        if len(held) == 1:
            a, b = np.array(forest(fps), np.int64).reshape(-1, 2).T
        else:
            a, b = forests(fps, [len(h) for h in held]) if held else (np.zeros(0, np.int64),) * 2
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 0], pa.int64()), pa.array(rows[b, 0], pa.int64())], ["a", "b"])

    size = 0
    for _, rows in runs(batches):
        if len(rows) < 2:
            continue
        if held and (len(rows) > _RUN or size + len(rows) > _CHUNK):
            yield flush()
            size = 0
        held.append(rows)
        size += len(rows)
        if len(rows) > _RUN:
            yield flush()
            size = 0
    yield flush()


def key_plan(n: int) -> np.ndarray:
    """For n texts: which bits of the fingerprint each key takes, a row for each key. Every bit is taken before any is taken
    again."""
    bits = max(KEY_BITS, math.ceil(math.log2(max(n, 2))) - 6)
    keys = math.ceil(math.log(1 - MET) / math.log(1 - SAME**bits))
    r = np.random.default_rng(_SEED)
    rounds = -(-keys * bits // (WORDS * 64))
    return np.concatenate([r.permutation(WORDS * 64) for _ in range(rounds)])[: keys * bits].reshape(keys, bits)


def keyed(texts: DataFrame, plan: np.ndarray) -> DataFrame:
    """(key, id, w0, w1): a row for each text and key."""
    keys, bits = plan.shape
    wide = next(w for w in (16, 32, 64) if w >= bits)
    # bits beyond a key's own are taken from a column of zeros behind the fingerprint
    place = np.full((keys, wide), WORDS * 64)
    place[:, :bits] = plan
    step = max(1, (1 << 21) // place.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            for i in range(0, len(lanes), step):
                part = np.unpackbits(np.pad(np.ascontiguousarray(lanes[i : i + step]), ((0, 0), (0, 1))).view(np.uint8), axis=1, bitorder="little")
                packed = np.ascontiguousarray(np.packbits(part[:, place.ravel()], axis=1, bitorder="little"))
                key = packed.view(f"<u{wide // 8}").astype(np.int64) + (np.arange(keys, dtype=np.int64) << bits)
                same = pa.array(np.repeat(np.arange(i, i + len(part)), keys))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(batch.column(k).take(same) for k in (0, 1, 2))], ["key", "id", "w0", "w1"])

    return texts.select("id", *_LANES).mapInArrow(run, "key long, id long, w0 long, w1 long")


def candidates(texts: DataFrame) -> DataFrame:
    """Distinct texts (id, w0, w1, ...) -> pairs (a, b) of ids with the same components as all candidates."""
    members = keyed(texts, key_plan(texts.count()))
    large = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "near-large")
    met = members.join(large, "key", "left").select("key", F.coalesce("blocks", F.lit(1)).alias("blocks"), "id", "w0", "w1")
    return deal(met, "id", "key").mapInArrow(_ties, "a long, b long").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, d1, d2) of every row, (d1, d2, root, read) of every text, and (root, least) of every group: least and read
    are (whether the id is null, doc_id, key) of the row that comes first."""
    rows = materialize(sketches(docs), "near-sketches")
    read = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("read")
    known = rows.groupBy("d1", "d2").agg(read, *(F.first(c).alias(c) for c in ("n", "n_words", *_LANES)))
    known = materialize(known.withColumn("id", F.monotonically_increasing_id()), "near-texts")
    rooted = verified(docs, known, connected_components(candidates(known.filter(F.col("n_words") >= SHINGLE))), SHINGLE)
    labels = materialize(known.join(rooted, known["id"] == rooted["node"], "left").select("d1", "d2", F.coalesce("root", "id").alias("root"), "read"), "near-labels")
    return rows.select("doc_id", "d1", "d2"), labels, labels.groupBy("root").agg(F.min("read").alias("least"))


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): one row per document, component_id the smallest doc_id of its group."""
    rows, labels, groups = _grouped(docs)
    return rows.join(labels.join(groups, "root").select("d1", "d2", F.col("least.doc_id").alias("component_id")), ["d1", "d2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each group, and if ids repeat the text with the least hash; rows that repeat it
    stay too."""
    kept = _grouped(docs)[2].select(F.col("least.doc_id").alias("__kept"), F.col("least.key").alias("__key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__kept")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__key"))
    return docs.join(kept, same, "left_semi").select(*[docs[c] for c in docs.columns])

"""Exact substring dedup: every byte of a 200-byte string that starts elsewhere too is removed.

Equal strings must meet without sorting all suffixes of the corpus. Each 200-byte string is led to its anchor, its
leftmost least GRAM-byte hash, which is the same wherever the string occurs. Anchors whose gram occurs once go. Around
the others, strings are taken by SPAN starts: they share a middle of 200 - SPAN + 1 bytes, and differ in up to SPAN - 1
bytes to its left and right. Contexts that are equal are one context with a count. Where one middle has several
contexts, each is a string (left, the middle as one symbol, right); shards of these strings have Burrows-Wheeler
transforms, which are merged by interleave refinement (``bwt``); after SPAN symbols the blocks of the merged order are
the repeated 200-byte strings. Up to there contexts are known by hashes alone, and only those that share a middle with
others are cut out of their texts, which lie in buckets that no later join moves. A middle with more than GROUP contexts is refined first: halves of the span have longer
middles, down to a single start, where equal contexts are equal strings. So no group grows with the corpus.

Copies of a whole text are one text. Texts and middles are compared by 128-bit hashes; grams, by 64, only lead strings
together.

Edge cases: a null text is empty; a text under 200 bytes loses nothing; rows that repeat are removed wholly, as each
has the other; overlaps within a text count; an empty table gives an empty result; long texts are read in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import bucketed, discard

from . import bwt
from .common import materialize, slices, utf8_of

LENGTH, GRAM, SPAN, GROUP, SEED = 200, 40, 41, 1024, 42
WINDOW = LENGTH - GRAM + 1
MIDDLE = LENGTH - SPAN + 1
_U, _PLACE = np.uint64, 24
_PIECE, _BATCH, _TASK = 1 << 22, 4096, 8192
_TEXT = ["tid", "tid2"]
_PLACED = [*_TEXT, "nid"]


class Hasher:
    """Hashes of all windows of a byte string, by prefix sums modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.symbol = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        self.base = (int(rng.integers(0, 1 << 60)) << 3) | 3
        self.power = self.inverse = np.ones(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(data) > len(self.power):
            n = 1 << (len(data) - 1).bit_length()
            self.power, self.inverse = (np.concatenate([[_U(1)], np.multiply.accumulate(np.full(n, b, np.uint64))]) for b in (self.base % (1 << 64), pow(self.base, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.symbol[data] * self.power[: len(data)])])

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        x = (self.sums[starts + size] - self.sums[starts]) * self.inverse[starts]
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))


def anchors(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its gram's hash, first start, last start) for all 200-byte strings of data."""
    hasher.load(data)
    grams = hasher.of(np.arange(len(data) - GRAM + 1), GRAM)
    low = _U((1 << _PLACE) - 1)
    least, size = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * size <= WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    n = len(grams) - WINDOW + 1
    least = np.minimum(least[:n], least[WINDOW - size : WINDOW - size + n])
    at = (least & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [n - 1]])
    return at[first], grams[at[first]], first, last


def _stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
    """(bytes, i, j, where each row i to j begins in them, what precedes them of the row); long rows in pieces."""
    for i, j in slices(starts, ends):
        if j - i == 1 and ends[i] - starts[i] > _PIECE:
            for s in range(int(starts[i]), int(ends[i]) - LENGTH + 1, _PIECE):
                yield data[s : min(s + _PIECE + LENGTH - 1, int(ends[i]))], i, j, np.zeros(1, np.int64), np.array([s - starts[i]])
        else:
            size = (ends - starts)[i:j]
            yield np.concatenate([data[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())]), i, j, np.cumsum(size) - size, np.zeros(j - i, np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(SEED)
    for batch in batches:
        tids, more_tids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for data, i, j, begin, skip in _stretches(*utf8_of(batch.column(2))):
            if len(data) < LENGTH:
                continue
            at, gram, first, last = anchors(data, hasher)
            # rows stand one after the other: strings across two of them go
            row = np.searchsorted(begin, first, side="right") - 1
            stop = np.append(begin[1:], len(data))[row] - LENGTH
            ok = first <= stop
            after = np.minimum(last, stop)
            # a run that reaches into the next row goes on there
            more = np.flatnonzero(np.searchsorted(begin, last, side="right") - 1 > row)
            extra = [(k, int(begin[r]), int(min(last[k], (np.append(begin[1:], len(data))[r]) - LENGTH)), r) for k in more for r in range(row[k] + 1, int(np.searchsorted(begin, last[k], side="right"))) if begin[r] <= min(last[k], np.append(begin[1:], len(data))[r] - LENGTH)]
            key = np.concatenate([gram[ok], gram[[e[0] for e in extra]]]).view(np.int64)
            a = np.concatenate([at[ok], at[[e[0] for e in extra]]])
            lo, hi = np.concatenate([first[ok], [e[1] for e in extra]]).astype(np.int64), np.concatenate([after[ok], [e[2] for e in extra]]).astype(np.int64)
            r = np.concatenate([row[ok], [e[3] for e in extra]]).astype(np.int64)
            shift = skip[r] - begin[r]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tids[i + r]), pa.array(more_tids[i + r]), pa.array((lo + shift) << 32 | (hi - lo) << 16 | (a - lo))], ["key", "tid", "tid2", "run"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, runs of starts) -> a row for each span of starts: its middle's hashes and place, left and right bytes. A run
    is packed: its first start, and 16 bits each for how many more there are and how far the anchor is."""
    one, two = Hasher(SEED + 1), Hasher(SEED + 2)
    for batch in batches:
        tids = batch.column(0).to_pylist()
        for tid, text, runs in zip(tids, batch.column(1), batch.column(2)):
            raw = text.as_py().encode()
            data = np.frombuffer(raw, np.uint8)
            runs = runs.values.to_numpy()
            lo = runs >> 32
            hi, at = lo + (runs >> 16 & 0xFFFF), lo + (runs & 0xFFFF)
            out = []
            for k in range(-(-WINDOW // SPAN)):
                middle = at - k * SPAN
                x, y = np.maximum(lo, middle - SPAN + 1), np.minimum(hi, middle)
                ok = x <= y
                out.append((middle[ok], x[ok], y[ok]))
            middle, x, y = (np.concatenate(c) for c in zip(*out))
            one.load(data), two.load(data)
            left = [raw[a:b] for a, b in zip(x.tolist(), middle.tolist())]
            right = [raw[m + MIDDLE : b + LENGTH] for m, b in zip(middle.tolist(), y.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(one.of(middle, MIDDLE).view(np.int64)), pa.array(two.of(middle, MIDDLE).view(np.int64)), pa.array(np.full(len(x), tid)), pa.array(middle.astype(np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["m1", "m2", "uid", "middle", "l", "r"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m1, m2, lo, hi) -> the mask of repeated starts of each context; bit i is the start i bytes before the middle."""
    held: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        masks = np.zeros(len(rows), np.int64)
        for depth in sorted({r[3] - r[2] + 1 for r in rows}):
            own = [i for i, r in enumerate(rows) if r[3] - r[2] + 1 == depth]
            groups: dict[tuple, int] = {}
            strings = []
            for i in own:
                g = groups.setdefault(rows[i][:4], len(groups))
                strings.append(np.concatenate([np.frombuffer(rows[i][4], np.uint8) + np.uint16(1), [257 + g], np.frombuffer(rows[i][5], np.uint8) + np.uint16(1)]).astype(np.uint16))
            string, place = bwt.repeated(strings, np.array([rows[i][6] for i in own]), depth)
            reach = np.array([len(rows[i][4]) + rows[i][2] for i in own])[string] - place
            ok = reach >= np.array([rows[i][2] for i in own])[string]
            np.bitwise_or.at(masks, np.array(own)[string[ok]], np.int64(1) << reach[ok])
        return pa.RecordBatch.from_arrays([pa.array([r[7] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array(masks)], ["eid", "m1", "mask"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= _BATCH and row[:4] != held[-1][:4]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


_ITEM = ["m1", "m2", "lo", "hi"]
_WANTED = ["eid", "m1", "m2", "c", "n"]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, contexts by place and lengths) -> the contexts with their left and right bytes."""
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1)):
            raw, rows = text.as_py().encode(), wanted.values
            at = [rows.field(c).to_pylist() for c in ("middle", "ll", "rl")]
            left = [raw[m - a : m] for m, a, _ in zip(*at)]
            right = [raw[m + MIDDLE : m + MIDDLE + b] for m, _, b in zip(*at)]
            yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in _WANTED), pa.array(left, pa.binary()), pa.array(right, pa.binary())], [*_WANTED, "l", "r"])


def _with_text(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Joins rows of a uid each to the text; these are led to the buckets of the texts."""
    return rows.join(texts.select("uid", *_PLACED), "uid").drop("uid").join(texts.drop("uid", "runs"), _PLACED)


def _masks(contexts: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct contexts (cid, m1, m2, ll, rl, c, and uid and middle, one of the places) -> (cid, root, mask), root the
    context's m1. Of a context l ends at the middle, r starts behind it; ll and rl are their lengths. eid names what is
    distinct at each level; at the first these are the contexts themselves."""
    each = contexts.withColumnRenamed("cid", "eid").withColumns({"lo": F.lit(0), "hi": F.lit(SPAN - 1)})
    items, out, span = None, None, SPAN
    while True:
        sizes = materialize(each.groupBy(*_ITEM).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "suffix-sizes")
        several = each.join(sizes, _ITEM)
        if items is None:
            wanted = several.groupBy("uid").agg(F.collect_list(F.struct(*_WANTED, "middle", "ll", "rl")).alias("wanted"))
            cut = _with_text(wanted, texts).select("text", "wanted").mapInArrow(_cut_out, "eid long, m1 long, m2 long, c long, n long, l binary, r binary")
            several = materialize(cut.withColumns({"lo": F.lit(0), "hi": F.lit(SPAN - 1)}), "suffix-several")
        # so many tasks that none merges much more than _TASK contexts, whatever they weigh
        tasks = 1 + (sizes.filter(f"n <= {GROUP}").agg(F.sum("n")).first()[0] or 0) // _TASK
        dealt = several.filter(f"n <= {GROUP}").select(*_ITEM, "l", "r", "c", "eid").repartition(tasks, *_ITEM).sortWithinPartitions(*_ITEM)
        merged = dealt.mapInArrow(_merged, "eid long, m1 long, mask long").filter("mask <> 0")
        # a context that occurs twice is repeated wherever its bytes reach
        reach = F.expr("shiftleft(1L, least(hi, lo + ll) + 1) - shiftleft(1L, greatest(lo, hi - rl))")
        known = merged.unionByName(each.filter("c > 1").select("eid", "m1", reach.alias("mask")))
        if items is None:
            part = known.select(F.col("eid").alias("cid"), F.col("m1").alias("root"), "mask")
        else:
            part = items.select("cid", "root", "eid", "m1").join(materialize(known, "suffix-known"), ["eid", "m1"]).select("cid", "root", "mask")
        part = materialize(part, "suffix-part")
        out = part if out is None else out.unionAll(part)
        large = sizes.filter(f"n > {GROUP}").drop("n")
        if span == 1 or not large.limit(1).count():
            return out.groupBy("cid", "root").agg(F.bit_or("mask").alias("mask"))
        span = -(-span // 2)
        mine = several.drop("n").select("*", F.col("eid").alias("cid"), F.col("m1").alias("root")) if items is None else items
        mid = F.expr("int((lo + hi) div 2)")
        halves = mine.join(large, _ITEM).withColumn("__half", F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b")))))
        # of l the bytes up to a go into the middle, those beyond b go; of r the other way round
        cut = halves.filter("__half.a <= __half.b and lo + length(l) >= __half.a and hi - length(r) <= __half.b").selectExpr(
            "cid", "root", "m1", "m2", "c", "__half.a as lo", "__half.b as hi",
            "substring(l, greatest(length(l) - (__half.b - lo), 0) + 1, greatest(least(length(l), __half.b - lo) - (__half.a - lo), 0)) as l",
            "substring(l, length(l) - (__half.a - lo) + 1, __half.a - lo) as l_in",
            "substring(r, 1, hi - __half.b) as r_in",
            "substring(r, hi - __half.b + 1, __half.b - __half.a) as r")
        longer = cut.select("cid", "root", F.xxhash64("m1", "l_in", "r_in").alias("m1"), F.xxhash64("m2", "r_in", "l_in", F.lit(1)).alias("m2"), "l", "r", "c", "lo", "hi")
        items = materialize(longer.withColumn("eid", F.xxhash64("m2", "lo", "hi", "l", "r")), "suffix-items")
        each = materialize(items.groupBy("eid", *_ITEM, "l", "r").agg(F.sum("c").alias("c")).withColumns({"ll": F.length("l"), "rl": F.length("r")}), "suffix-each")


def _hashes(text) -> list:
    """The 128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("tid"), F.xxhash64(F.lit(1), text).alias("tid2")]


def removals(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (tid, tid2, text, hits): of each text with repeated strings, its (middle, mask) runs; texts that
    occur once only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *_hashes(text)).filter(f"octet_length(text) >= {LENGTH}")
    found = materialize(long.select(*_TEXT, "text").mapInArrow(_anchor_rows, "key long, tid long, tid2 long, run long"), "suffix-anchors")
    keys = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "suffix-keys")
    runs = found.join(keys, "key").groupBy(*_TEXT).agg(F.collect_set("run").alias("runs"))
    # a text stands at the first of its rows, found by its hashes and its id; a null id counts as 0 there
    nid = F.coalesce("doc_id", F.lit(0).cast("long"))
    first = long.groupBy(*_TEXT).agg(F.min(nid).alias("nid"), F.count(F.lit(1)).alias("copies"))
    need = materialize(runs.join(first, _TEXT), "suffix-need")
    discard(found, keys)
    one = long.select(*_TEXT, nid.alias("nid"), "text").join(need.hint("merge"), _PLACED)
    once = one.groupBy(*_PLACED).agg(*[F.first(c).alias(c) for c in ("text", "runs", "copies")])
    texts = bucketed(once.withColumn("uid", F.monotonically_increasing_id()), "suffix-texts", _PLACED)
    discard(need)
    rows = texts.select("uid", "text", "runs").mapInArrow(_contexts, "m1 long, m2 long, uid long, middle int, l binary, r binary")
    lengths = {"ll": F.length("l").cast("byte"), "rl": F.length("r").cast("byte")}
    spans = materialize(rows.withColumns({"cid": F.xxhash64("m2", "l", "r"), **lengths}).drop("l", "r"), "suffix-spans")
    counted = spans.groupBy("cid", "m1", "m2", "ll", "rl").agg(F.count(F.lit(1)).alias("c"), F.first("uid").alias("uid"), F.first("middle").alias("middle"))
    contexts = materialize(counted, "suffix-contexts")
    masks = materialize(_masks(contexts, texts), "suffix-masks")
    discard(contexts)
    hits = spans.select("uid", "middle", "cid", F.col("m1").alias("root")).join(masks, ["cid", "root"]).groupBy("uid").agg(F.collect_list(F.struct("middle", "mask")).alias("hits"))
    return _with_text(hits, texts.filter("copies = 1")).select(*_TEXT, "text", "hits")


def keep(raw: bytes, hits) -> list[tuple[int, int]]:
    """The stretches that go: maximal, in order."""
    starts = np.zeros(len(raw) + 1, np.int32)
    for middle, mask in hits:
        for i in range(SPAN):
            if mask >> i & 1:
                starts[middle - i] += 1
                starts[middle - i + LENGTH] -= 1
    gone = np.cumsum(starts[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tid, tid2, text, hits in zip(*(batch.column(i).to_pylist() for i in (0, 1)), *(batch.column(i) for i in (2, 3))):
            raw = text.as_py().encode()
            gone = keep(raw, zip(hits.values.field("middle").to_pylist(), hits.values.field("mask").to_pylist()))
            bounds = [0, *[x for span in gone for x in span], len(raw)]
            rest = b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            rows.append((tid, tid2, sum(b - a for a, b in gone), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"), gone))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        cols[6] = [[{"start": a, "end": b} for a, b in g] for g in cols[6]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tid", "tid2", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def dedup(docs: DataFrame) -> DataFrame:
    """tid, tid2 (hashes of the text), n_removed, n_spans, kept_sha256, kept (text), spans: of texts that occur once and lose bytes."""
    return removals(docs).select(*_TEXT, "text", "hits").mapInArrow(_cut, "tid long, tid2 long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(whole), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha")), "suffix-docs")
    lost = dedup(docs).select(*_TEXT, "n_removed", "n_spans", "kept_sha256")
    copies = every.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("copies"))
    facts = materialize(copies.join(lost, _TEXT, "left"), "suffix-facts")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, some, none: F.when(copied, all_).otherwise(F.coalesce(some, none))
    zero = F.lit(0).cast("long")
    return every.join(facts, _TEXT).select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), zero).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )

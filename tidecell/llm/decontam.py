"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The CGK walk copies a string's characters one at a time, and moves on or stays by a random bit of the step and the
character. Two walks over strings a small edit distance apart soon meet again, so their copies differ in few places: edit
distance becomes Hamming distance. REPEATS walks, with samples of a few places from each, give the keys of a window.

A window starts at every word of an item and of a document, and is as long as its item's size allows: CLASSES gives, by
the items' length, the steps of the walk and the places and samples taken of them; a walk of n steps reads n characters
at most. Of an exact copy that starts at a word all keys are equal, as no walk leaves an item from its first word on. Of
edited copies any window that the edits spare is enough: recall is 0.9 or more down to similarity 0.8 for items of 6 words
or more (see the README, by length and edits). Long items need a window at every other word of a document only.

A hit places the item in the document. Places of an item within ``room`` (the edits allowed) of each other are verified
together, in the stretch that holds the window of each of them with room on either side. Before the exact edit distance
comes a test for all candidates at once, which only drops what can't be found: an item is cut into pieces of 64
characters; in any alignment each piece lies in its part of the stretch, and the pieces' least edits there, summed, are at
most the item's. An item is found if the best part of the stretch is similar by SIMILARITY (1 - edits / item's length).

Text is compared in lower case, with white space runs as one blank. Keys and the test read characters folded to a byte,
which can only make them more alike; the edit distance reads the characters. Items are sent to the tasks in blocks of
ITEM_BLOCK; each block is one pass over the documents, without a shuffle.

Items under MIN_CHARS characters have no room for samples, and as many characters of prose as there are would be similar by
SIMILARITY somewhere, so these are found where they stand word for word.

Edge cases: a null or empty document holds no item; an item that is null or without a character matches nothing;
repeated rows are reported as often as they are there; an empty table on either side gives no match; a long text is cut
into pieces that overlap by more than an item and its room.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPEATS, SEED = 2, 42
#: Least item length in characters -> (steps of the walk, places of a sample, samples of a walk, a window at each nth word
#: of a document).
CLASSES = {16: (16, 9, 10, 1), 56: (40, 12, 6, 1), 160: (48, 12, 4, 2)}
SIMILARITY, MIN_CHARS, ITEM_BLOCK = 0.8, min(CLASSES), 5_000
_SLICE, _WINDOWS, _HITS, _PIECE, _MOST_STEPS = 1 << 22, 1 << 15, 1 << 21, 64, 64
_U = np.uint64


class Table(NamedTuple):
    """The keys of one class of items."""

    steps: int
    every: int  # nth word of a document
    places: list  # by walk and sample
    keys: np.ndarray  # sorted
    item: np.ndarray
    offset: np.ndarray  # the window's first character within the item
    filter: np.ndarray
    shift: np.uint64


class Index(NamedTuple):
    ids: list[int]
    items: list[str]
    size: np.ndarray
    room: np.ndarray
    tables: list[Table]
    short: dict[str, list[int]]  # items under MIN_CHARS, by text
    pieces: np.ndarray  # each item's first piece
    masks: np.ndarray  # of each piece, by character


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def folded(text: str) -> np.ndarray:
    """A byte for each character; blanks and ASCII stay themselves."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, code, 128 + (code * np.uint32(2654435761) >> np.uint32(25))).astype(np.uint8)


@lru_cache(1)
def _coins() -> np.ndarray:
    """For each walk and step an odd factor and a summand: the top bit of factor * character + summand is the coin."""
    return np.random.default_rng(SEED).integers(0, 1 << 16, (REPEATS, _MOST_STEPS, 2), dtype=np.uint16) | np.array([1, 0], np.uint16)


def walks(data: np.ndarray, starts: np.ndarray, steps: int, stand: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each walk the characters copied, step by step; stand gets where they are. data: padded by steps."""
    for coins in _coins():
        at, copied = starts.astype(np.int64), np.empty((steps, len(starts)), np.uint8)
        for step, (factor, summand) in enumerate(coins[:steps]):
            if stand is not None:
                stand[step] = at
            char = np.take(data, at, out=copied[step], mode="clip").astype(np.uint16)
            char *= factor
            char += summand
            char >>= np.uint16(15)
            at += char
        yield copied


def _key(copied: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    packed = np.zeros((copied.shape[1], -(-len(places) // 8) * 8), np.uint8)
    for i, p in enumerate(places):
        packed[:, i] = copied[p]
    key = np.full(len(packed), seed, np.uint64)
    for word in packed.view(np.uint64).T:
        key = (key ^ word) * _U(0xD6E8FEB86659FD93)
        key ^= key >> _U(29)
    return key * _U(0xFF51AFD7ED558CCD)


def _words(data: np.ndarray) -> np.ndarray:
    """Where words start in texts that NULs separate."""
    return np.concatenate([[0], np.flatnonzero((data[:-1] == 32) | (data[:-1] == 0)) + 1])


def _table(chosen: list[int], texts: list[np.ndarray], steps: int, picks: int, samples: int, every: int) -> Table:
    rng = np.random.default_rng(SEED + steps)
    places = [[np.sort(rng.choice(steps, picks, replace=False)) for _ in range(samples)] for _ in range(REPEATS)]
    data = np.concatenate([x for n in chosen for x in (texts[n], np.zeros(1, np.uint8))] + [np.zeros(steps, np.uint8)])
    size = np.array([len(texts[n]) for n in chosen])
    begin = np.cumsum(size + 1) - size - 1
    starts = _words(data[: len(data) - steps - 1])
    own = np.searchsorted(begin, starts, side="right") - 1
    keys, item, offset = [], [], []
    stand = np.empty((steps, len(starts)), np.int64)
    for r, copied in enumerate(walks(data, starts, steps, stand)):
        for s, p in enumerate(places[r]):
            inside = stand[p[-1]] < (begin + size)[own]  # walks only go on
            keys.append(_key(copied, p, r * samples + s)[inside])
            item.append(np.array(chosen)[own[inside]])
            offset.append((starts - begin[own])[inside])
    keys, item, offset = np.concatenate(keys), np.concatenate(item), np.concatenate(offset)
    order = np.argsort(keys, kind="stable")
    bits = min(26, max(16, len(keys).bit_length() + 4))
    seen = np.zeros(1 << bits, bool)
    seen[keys >> _U(64 - bits)] = True
    return Table(steps, every, places, keys[order], item[order], offset[order], seen, _U(64 - bits))


def build_index(items: list[tuple[int, str | None]]) -> Index:
    every = [(i, normal(t)) for i, t in items]
    kept = [(i, t) for i, t in every if len(t) >= MIN_CHARS]
    few, short = [(i, t) for i, t in every if 0 < len(t) < MIN_CHARS], defaultdict(list)
    for n, (_, t) in enumerate(few, len(kept)):
        short[t].append(n)
    texts = [folded(t) for _, t in kept]
    size = np.array([len(t) for t in texts], np.int64)
    least = np.array(sorted(CLASSES))
    of = np.searchsorted(least, size, side="right") - 1
    tables = [_table(np.flatnonzero(of == c).tolist(), texts, *CLASSES[k]) for c, k in enumerate(least.tolist()) if (of == c).any()]
    first = np.cumsum([0, *[-(-len(t) // _PIECE) for t in texts]])
    masks = np.zeros((int(first[-1]), 256), np.uint64)
    for n, t in enumerate(texts):
        for i in range(0, len(t), _PIECE):
            part = t[i : i + _PIECE]
            np.bitwise_or.at(masks[first[n] + i // _PIECE], part, _U(1) << np.arange(len(part), dtype=np.uint64))
    room = ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)
    return Index([i for i, _ in kept + few], [t for _, t in kept + few], size, room, tables, dict(short), first, masks)


def short_items(text: str, index: Index) -> dict[int, int]:
    """The items under MIN_CHARS that a normal text holds word for word, without edits."""
    words, found = text.split(" "), {}
    for n in {t.count(" ") + 1 for t in index.short}:
        for item in index.short.keys() & (set(words) if n == 1 else {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}):
            found |= dict.fromkeys(index.short[item], 0)
    return found


def edits(item: str, text: str) -> int:
    """The least edit distance of item to any stretch of text (bit-parallel over the item)."""
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(item):
        masks[ch] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    least = score
    for ch in text:
        eq = masks.get(ch, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        score += bool(up & top) - bool(down & top)
        least = min(least, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(diag | up)), up & diag
    return least


def _piece_edits(masks: np.ndarray, size: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """The same for many pieces at once: masks (piece, character), size of each piece, chars (step, piece)."""
    each = np.arange(len(size)) * 256
    masks, one, high = masks.ravel(), _U(1), (size - 1).astype(np.uint64)
    plus, minus, score = np.full(len(size), ~_U(0)), np.zeros(len(size), np.uint64), size.astype(np.int64)
    least = score.copy()
    for row in chars:
        eq = masks[each + row]
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diag | plus), plus & diag
        score += ((up >> high) & one).astype(np.int64) - ((down >> high) & one).astype(np.int64)
        np.minimum(least, score, out=least)
        up, down = up << one, down << one
        plus, minus = down | ~(diag | up), up & diag
    return least


class Candidates(NamedTuple):
    text: np.ndarray
    item: np.ndarray
    near: np.ndarray  # first and
    far: np.ndarray  # end of the stretch, which may reach beyond the text


def candidates(data: np.ndarray, begin: np.ndarray, index: Index) -> Candidates:
    """data: folded texts, each with a NUL behind it, padded; begin: where they start, and the end of the last."""
    starts = _words(data[: begin[-1]])
    starts = starts[starts < begin[-1]]
    width = index.room + 1
    found = []

    def hits(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, table: Table) -> np.ndarray:
        row = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        at, item = np.repeat(at, hi - lo), table.item[row]
        own = np.searchsorted(begin, at, side="right") - 1
        bucket = (at - begin[own] - table.offset[row]) // width[item]
        return np.unique(((own * len(index.ids) + item) << 24) + bucket + 1024)

    often = [t for t in index.tables if t.every == 1]
    parts = [(starts[i : i + 2 * _WINDOWS][k::2], tables) for i in range(0, len(starts), 2 * _WINDOWS) for k, tables in enumerate((index.tables, often)) if tables]
    for part, tables in parts:
        for r, copied in enumerate(walks(data, part, max(t.steps for t in tables))):
            for t in tables:
                for s, p in enumerate(t.places[r]):
                    key = _key(copied, p, r * len(t.places[r]) + s)
                    at = np.flatnonzero(t.filter[key >> t.shift])
                    lo, hi = np.searchsorted(t.keys, key[at], "left"), np.searchsorted(t.keys, key[at], "right")
                    at, lo, hi = (x[lo < hi] for x in (at, lo, hi))
                    cut = np.searchsorted(np.cumsum(hi - lo), np.arange(0, int((hi - lo).sum()) + 1, _HITS))
                    for a, b in zip(cut, [*cut[1:], len(at)]):
                        found.append(hits(part[at[a:b]], lo[a:b], hi[a:b], t))
    every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    text, item = np.divmod(every >> 24, max(len(index.ids), 1))
    bucket = (every & ((1 << 24) - 1)) - 1024
    room = index.room[item]
    near = bucket * width[item] - room
    return Candidates(text, item, near, near + index.size[item] + 3 * room)


def possible(found: Candidates, data: np.ndarray, begin: np.ndarray, index: Index) -> np.ndarray:
    """Which candidates the pieces' edits don't rule out.

    A stretch has len + 3 room characters. If d <= room edits place the item from s on, then s <= 3 room + d, and a piece
    from character i on starts at i - d or later and ends at i + 64 + 3 room + d or earlier.
    """
    need = np.zeros(len(found.item), np.int64)
    room, size = index.room[found.item], index.size[found.item]
    low, high = begin[found.text], begin[found.text + 1] - 1
    for p in range(-(-int(size.max(initial=0)) // _PIECE)):
        alive = np.flatnonzero((need <= room) & (p * _PIECE < size))
        alive = alive[np.argsort(room[alive], kind="stable")]  # those of like room together
        for i in range(0, len(alive), 4096):
            at = alive[i : i + 4096]
            steps = _PIECE + 5 * int(room[at].max())
            place = (low + found.near)[at] + p * _PIECE - room[at]
            where = place + np.arange(steps)[:, None]
            inside = (where >= low[at]) & (where < high[at])
            chars = np.where(inside, data[np.where(inside, where, 0)], 0)
            need[at] += _piece_edits(index.masks[index.pieces[found.item[at]] + p], np.minimum(size[at] - p * _PIECE, _PIECE), chars)
    return need <= room


def matches_of(texts: list[str], index: Index) -> list[dict[int, int]]:
    """For each normal text, item -> least edits."""
    out: list[dict[int, int]] = [{} for _ in texts]
    if not index.tables:
        return out
    parts = [folded(t) for t in texts]
    begin = np.cumsum([0, *[len(p) + 1 for p in parts]])
    data = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.uint8))] + [np.zeros(_MOST_STEPS, np.uint8)])
    found = candidates(data, begin, index)
    for n in np.flatnonzero(possible(found, data, begin, index)).tolist():
        text, item, near, far = (int(x[n]) for x in found)
        best, want = out[text], index.items[item]
        if best.get(item) == 0:
            continue
        stretch = texts[text][max(near, 0) : max(far, 0)]
        d = 0 if want in stretch else edits(want, stretch)
        if d <= index.room[item]:
            best[item] = min(d, best.get(item, d))
    return out


def matches(texts: list[str | None], index: Index) -> Iterator[dict[int, int]]:
    """For each text, item -> edits; four million characters at a time, longer texts in pieces."""
    overlap = int((index.size + 4 * index.room).max(initial=0))
    held: list[tuple[int, str]] = []
    done, size = 0, 0

    def flush(upto: int) -> Iterator[dict[int, int]]:
        got: dict[int, dict[int, int]] = defaultdict(dict)
        for (n, _), best in zip(held, matches_of([t for _, t in held], index)):
            for item, d in best.items():
                got[n][item] = min(d, got[n].get(item, d))
        for n in range(done, upto):
            yield got[n] | few.pop(n, {})

    few: dict[int, dict[int, int]] = {}
    for n, text in enumerate(texts):
        text = normal(text)
        if index.short:
            few[n] = short_items(text, index)
        held += [(n, text[i : i + _SLICE + overlap]) for i in range(0, max(len(text), 1), _SLICE)]
        size += len(text)
        if size > _SLICE:
            yield from flush(n + 1)
            held, done, size = [], n + 1, 0
    yield from flush(len(texts))


@lru_cache(1)
def _index_of(items: tuple) -> Index:
    """A worker builds the index of a block once and keeps it for its next tasks."""
    return build_index(list(items))


def _blocks(benchmark: DataFrame) -> Iterator[tuple]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    blocks = math.ceil(items.count() / ITEM_BLOCK)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield tuple((r["item_id"], r["text"]) for r in part.collect())


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, similarity: each item that a document holds, at its best place."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, edits int, similarity double")
    for block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], block: tuple = block) -> Iterator[pa.RecordBatch]:
            index = _index_of(block)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[n], index.ids[i], d, 1 - d / len(index.items[i])) for n, got in enumerate(matches(batch.column(1).to_pylist(), index)) for i, d in sorted(got.items())]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["doc_id", "item_id", "edits", "similarity"])

        out = out.unionAll(texts.mapInArrow(run, out.schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for block in _blocks(benchmark):
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], block: tuple = block, at: int = at) -> Iterator[pa.RecordBatch]:
            index = _index_of(block)
            for batch in batches:
                yield batch.filter(pa.array([not got for got in matches(batch.column(at).to_pylist(), index)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Burrows-Wheeler transforms of string collections, and their merge by iterative interleave refinement.

A shard is a collection of strings, each with an end mark of its own (symbol 0, ordered by string). Its transform has a
row for each suffix. Shards merge without sorting their suffixes anew: an interleave says, row by row, which shard the
next row comes from. One pass reads the transforms' symbols in interleave order and deals the rows out stably by symbol,
after which the interleave is right by one more symbol. Rows that the pass leaves in one block agree in all symbols so
far: the block bounds are where common prefixes end.
"""

from __future__ import annotations

import numpy as np


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One shard -> (transform, string of each row, place of each row)."""
    size = np.array([len(s) + 1 for s in strings])
    depth = int(size.max())
    text = np.concatenate([x for s in strings for x in (s, np.zeros(1, np.uint16))] + [np.zeros(depth, np.uint16)]).astype(">u2")
    begin = np.cumsum(size) - size
    string = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(string)) - begin[string]
    # nothing beyond a string's end may count, so the window of each suffix is blanked from its end on
    window = np.lib.stride_tricks.sliding_window_view(text, depth)[: len(string)].copy()
    window[np.arange(depth)[None, :] >= (size[string] - place)[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(window).view(f"V{2 * depth}").ravel(), kind="stable")
    ends = place == size[string] - 1
    order = np.concatenate([np.flatnonzero(ends), order[~ends[order]]])  # end marks first, by string
    before = np.where(place == 0, 0, text[np.arange(len(string)) - 1]).astype(np.uint16)
    return before[order], string[order], place[order]


def merge(transforms: list[np.ndarray], strings: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Transforms of shards of so many strings -> (shard of each row, whether a row starts a new block), by depth symbols."""
    marks = np.repeat(np.arange(len(strings)), strings)
    shard = np.concatenate([marks, *[np.full(len(t) - n, i) for i, (t, n) in enumerate(zip(transforms, strings))]])
    n_marks = len(marks)
    new = np.zeros(len(shard), bool)  # by no symbols all agree, end marks included
    new[:1] = True
    flat, base = np.concatenate(transforms), np.cumsum([0, *[len(t) for t in transforms]])[:-1]
    for _ in range(depth):
        by_shard = np.argsort(shard.astype(np.uint8), kind="stable")
        row = np.empty(len(shard), np.int64)
        row[by_shard] = np.arange(len(shard))  # the shards' rows are read in their own order
        symbol = flat[row]
        block = np.cumsum(new)
        order = np.argsort(symbol, kind="stable")[n_marks:]  # each string has one end mark: those rows stay in front
        step = np.ones(len(order), bool)
        step[1:] = (symbol[order[1:]] != symbol[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
        shard = np.concatenate([marks, shard[order]])
        new = np.concatenate([np.ones(n_marks, bool), step])
    return shard, new


def repeated(strings: list[np.ndarray], counts: np.ndarray, depth: int, per_shard: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of every suffix whose first depth symbols occur elsewhere; a string stands for counts of it."""
    shards = [list(range(i, min(i + per_shard, len(strings)))) for i in range(0, len(strings), per_shard)]
    done = [transform([strings[i] for i in s]) for s in shards]
    shard, new = merge([d[0] for d in done], [len(s) for s in shards], depth)
    row = np.empty(len(shard), np.int64)
    row[np.argsort(shard, kind="stable")] = np.arange(len(shard))
    string = np.concatenate([d[1] + s[0] for d, s in zip(done, shards)])[row]
    place = np.concatenate([d[2] for d in done])[row]
    size = np.array([len(s) for s in strings])
    whole = place + depth <= size[string]
    block = np.cumsum(new) - 1
    total = np.bincount(block[whole], counts[string[whole]], block[-1] + 1)
    hit = whole & (total[block] > 1)
    return string[hit], place[hit]

"""Substring dedup over paragraphs: MinHash banding, exact Jaccard, removal by connected components.

A paragraph is a line of MIN_WORDS words or more, or a block of shorter lines up to a blank or a longer line, if it has as
many words together. It is compared in lower case by its set of five-word shingles. BANDS bands of ROWS minima bring a
pair with Jaccard 0.8 together with probability 1 - (1 - 0.8^4)^12 = 0.998.

Exact copies are combined first. In each band's bucket every paragraph is tied to the bucket's least one, so a bucket
costs one row for each member; the components of these ties hold every colliding pair. Only for their members are the
shingles built, once each, and within a component an exact Jaccard search keeps a spanning forest of the links of
SIMILARITY or more. Components with more than BLOCK members are dealt out over pairs of blocks. Of each component of
verified links the first paragraph (least doc_id, then row and place) stays.

Passages may begin and end anywhere, so every run of PASSAGE words is taken for a paragraph too, with one band of one
minimum, over its shingles of WINDOW words: the run's key is the shingle with the least hash, and consecutive runs mostly
share it, so a document has about one key for every thirteen words. Two runs that are equal have the same key. Where keys
collide, the runs are verified: a run of PASSAGE words around its key goes so far to the left or to the right of it that
one of three longer stretches (EXTENSIONS) lies inside, and one of these must be equal too. So any PASSAGE words that
stand twice are found, and what is reported shares SURE words at least. Stretches of a document that touch are
one passage; of equal stretches the one with the least (doc_id, row, place) stays. A passage's para is its key's line.

Edge cases: a null or empty text has no paragraph; rows that repeat an id count as separate copies; a null id sorts first,
and is read by its text's hash; 50 times the same word is no passage; where a phrase is repeated so that copies of a
passage overlap, WINDOW words of the first stay at least; an empty table gives an empty result; columns but
doc_id and text play no part.
Paragraphs and passages are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecell.functions.stage import discard
from tidecell.operators.components import connected_components

from .common import materialize, slices, utf8_of
from .simhash import deal

SHINGLE, SIMILARITY, BANDS, ROWS, MIN_WORDS, BLOCK, SEED = 5, 0.8, 12, 4, 30, 1024, 42
WINDOW, PASSAGE = 25, 50
_SPARE = PASSAGE - WINDOW
#: Words to the left and to the right of a key. However a run splits its spare words, one of the three fits.
EXTENSIONS = ((-(-2 * _SPARE // 3), 0), (0, -(-2 * _SPARE // 3)), (_SPARE // 3, _SPARE // 3))
SURE = WINDOW + min(a + b for a, b in EXTENSIONS)
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def hashed_words(data: np.ndarray):
    """Bytes of lines -> (line of each word, word hashes, words of each line, digest of each line)."""
    blank = _BLANK[data]
    line = np.cumsum(data == 10)
    n_lines = int(line[-1]) + 1 if len(line) else 1
    word = ~blank
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(n_lines, np.int64), np.zeros(n_lines, np.uint64)
    size = stop - start
    first = np.cumsum(size) - size
    byte = _FOLD[data[word]].astype(np.uint64) + _U(1)
    place = np.arange(len(byte)) - np.repeat(first, size)
    words = _mix(np.add.reduceat(byte * _powers(0x100000001B3, int(size.max()))[place], first))
    of = line[start]
    n_words = np.bincount(of, minlength=n_lines)
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    nth = np.arange(len(of)) - np.repeat(head, np.diff(np.concatenate([head, [len(of)]])))
    digest = np.zeros(n_lines, np.uint64)
    digest[of[head]] = _mix(np.add.reduceat(words * _powers(0x9E3779B97F4A7C15, int(nth.max()) + 1)[nth], head) + n_words[of[head]].astype(np.uint64))
    return of, words, n_words, digest


def shingled(of: np.ndarray, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(line of each shingle, shingle hashes) of the words of lines."""
    if len(words) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(words) - size + 1
    sums, factor = np.zeros(n, np.uint64), _powers(0xD6E8FEB86659FD93, size)
    for k in range(size):
        sums += words[k : k + n] * factor[k]
    whole = of[:n] == of[size - 1 :]
    return of[:n][whole], _mix(sums)[whole]


def joined(doc: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Which paragraph each line belongs to: blocks of short lines are one, up to a blank or a long line or the text's end."""
    alone = (n_words >= MIN_WORDS) | (n_words == 0)
    new = np.ones(len(doc), bool)
    new[1:] = alone[1:] | alone[:-1] | (doc[1:] != doc[:-1])
    return np.cumsum(new) - 1


def hashed_paragraphs(hashed: tuple, doc: np.ndarray):
    """What ``hashed_words`` gives, and the document of each line -> (paragraph of each shingle, shingle hashes, and of each
    paragraph: its first line, first word, words, digest, second digest)."""
    line, words, n_words, _ = hashed
    para = joined(doc, n_words)
    n, of = int(para[-1]) + 1 if len(para) else 0, para[line]
    size = np.bincount(of, minlength=n)
    begin = np.cumsum(size) - size
    nth = np.arange(len(of)) - begin[of]
    full = np.flatnonzero(size)
    digests = np.zeros((2, n), np.uint64)
    for k, base in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93) if len(of) else ()):
        digests[k, full] = _mix(np.add.reduceat(words * _powers(base, int(nth.max()) + 1)[nth], begin[full]) + size[full].astype(np.uint64))
    return *shingled(of, words), np.searchsorted(para, np.arange(n)), begin, size, *digests.view(np.int64)


def _documents(data, starts, ends) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the lines of many documents: (bytes, document of each line, its place in the document)."""
    for i, j in slices(starts, ends):
        parts = [x for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist()) for x in (data[s:e], np.array([10], np.uint8))]
        text = np.concatenate(parts)[:-1]
        n = np.array([int((data[s:e] == 10).sum()) + 1 for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())])
        yield text, np.repeat(np.arange(i, j), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _signatures(of: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Band keys of each run of lines in of, as rows."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | _U(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    keys = np.zeros((len(head), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        keys[:, k // ROWS] = _mix(keys[:, k // ROWS] + np.minimum.reduceat((shingles * a[k] + b[k]) >> _U(16), head) + _U(k // ROWS + 1))
    return keys


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, text): row tells rows apart within one reading, key is the text's hash."""
    text = F.col("text").cast("string")
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


_SCAN = "unit int, row long, doc_id long, key long, para int, word int, n_words int, digest long, digest2 long, lists array<long>"
_PARAGRAPH, _PASSAGE_KEY = 0, 1


def scanned(docs: DataFrame) -> DataFrame:
    """One reading of the texts: every paragraph of MIN_WORDS or more, with its band keys, and every passage key, whose digest
    is its window's and whose lists are its extensions."""
    names = [x.split()[0] for x in _SCAN.split(", ")]

    def listed(keys: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.view(np.int64).ravel()))

    def rows(batch: pa.RecordBatch, unit: int, own: np.ndarray, ints: tuple, digests: tuple, keys: np.ndarray) -> pa.RecordBatch:
        at = pa.array(own)
        columns = [pa.array(np.full(len(own), unit, np.int32)), *(batch.column(i).take(at) for i in range(3)), *(pa.array(x, pa.int32()) for x in ints), *(pa.array(x) for x in digests), listed(keys)]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, doc, line in _documents(*utf8_of(batch.column(3))):
                hashed = hashed_words(text)
                of, shingles, first, word, n_words, *digests = hashed_paragraphs(hashed, doc)
                long = n_words[of] >= MIN_WORDS
                of, shingles = of[long], shingles[long]
                if len(of):
                    some = of[np.concatenate([[True], of[1:] != of[:-1]])]
                    own = doc[first]
                    nth = word - word[np.searchsorted(own, own)]
                    yield rows(batch, _PARAGRAPH, own[some], (line[first][some], nth[some], n_words[some]), (digests[0][some], digests[1][some]), _signatures(of, shingles))
                place, words, _, _ = hashed
                at, hashes, more = windows(doc[place], words)
                if len(at):
                    nth = at - np.searchsorted(doc[place], doc[place[at]])
                    yield rows(batch, _PASSAGE_KEY, doc[place[at]], (line[place[at]], nth, np.full(len(at), WINDOW)), (hashes.view(np.int64), np.zeros(len(at), np.int64)), more)

    return _rows(docs).mapInArrow(run, _SCAN)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (doc_id, key, digest, id, root, blocks). -> (root, blocks, id, shingles): each wanted paragraph's distinct shingles."""
    lists = wanted.select(F.col("doc_id").alias("want_id"), F.col("key").alias("want_key"), "digest", "id", "root", "blocks").groupBy("want_id", "want_key").agg(F.collect_list(F.struct("digest", "id", "root", "blocks")).alias("want"))
    texts = _rows(docs).drop("row")
    met = texts.join(lists, texts["doc_id"].eqNullSafe(F.col("want_id")) & (texts["key"] == F.col("want_key"))).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_pylist()
            for text, doc, _ in _documents(*utf8_of(batch.column(0))):
                of, shingles, first, _, n_words, digest, _ = hashed_paragraphs(hashed_words(text), doc)
                bound = np.searchsorted(of, np.arange(len(n_words) + 1))
                at = {(int(d), int(x)): i for i, (d, x) in enumerate(zip(doc[first], digest))}
                rows = [(w["root"], w["blocks"], w["id"], np.unique(shingles[bound[i] : bound[i + 1]]).view(np.int64)) for d in np.unique(doc).tolist() for w in want[d] if (i := at.get((d, w["digest"]))) is not None]
                if rows:
                    root, blocks, ids, sets = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(blocks, pa.int32()), pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["root", "blocks", "id", "shingles"])

    return met.mapInArrow(run, "root long, blocks int, id long, shingles array<long>")


def forest(digests: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, member) for each set that links of SIMILARITY reach from a first one: breadth-first, one set against all the
    rest at a time."""
    digests, keep = np.unique(digests, return_index=True)
    sets = [sets[i] for i in keep]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        start = front[0]
        mark = np.zeros(ids.max() + 1, bool)
        while front and len(left):
            i = front.pop()
            own = ids[begin[i] : begin[i] + size[i]]
            mark[own] = True
            hit = np.concatenate([[0], np.cumsum(mark[np.concatenate([ids[begin[k] : begin[k] + size[k]] for k in left])])])
            stop = np.cumsum(size[left])
            both = hit[stop] - hit[stop - size[left]]
            mark[own] = False
            near = both >= SIMILARITY * (size[left] + size[i] - both) - 1e-9
            out += [(int(digests[start]), int(digests[k])) for k in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return out


def links_of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (root, pair, digest, shingles) -> a spanning forest (a, b) of the links within each (root, pair)."""
    last, digests, sets = None, [], []

    def flush() -> pa.RecordBatch:
        found = forest(np.array(digests), sets) if len(digests) > 1 else []
        a, b = zip(*found) if found else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for root, pair, digest, shingles in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            if (root, pair) != last:
                yield flush()
                last, digests, sets = (root, pair), [], []
            digests.append(digest)
            sets.append(shingles.values.to_numpy())
    yield flush()


def group(docs: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, para, word, n_words, rep_doc_id, rep_para, removed) of every paragraph with a near or exact copy elsewhere."""
    scan = scan or materialize(scanned(docs), "para-scan")
    known = scan.filter(F.col("unit") == _PARAGRAPH).drop("unit").withColumnRenamed("lists", "bands")
    same = ["digest", "digest2"]
    first, read = F.min(F.struct("doc_id", "row", "para")).alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("read")
    distinct = materialize(known.groupBy(*same).agg(first, read, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()), "para-distinct")
    keys = distinct.select("id", F.explode("bands").alias("key"))
    stars = materialize(keys.groupBy("key").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "m"), "para-stars")
    ties = keys.join(stars, "key").filter("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    near = connected_components(ties)
    sizes = materialize(near.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "para-sizes")
    ids = materialize(near.join(sizes, "root").select(F.col("node").alias("id"), "root", "blocks"), "para-near")
    wanted = distinct.select("id", "digest", "read.doc_id", "read.key").join(ids, "id")
    dealt = deal(shingle_sets(docs, wanted), "id", "root")
    rooted = connected_components(dealt.mapInArrow(links_of_sets, "a long, b long"))
    labelled = materialize(distinct.join(rooted, distinct["id"] == rooted["node"], "left").select(*same, F.coalesce("root", "id").alias("root"), "first", "n"), "para-roots")
    groups = materialize(labelled.groupBy("root").agg(F.min("first").alias("rep"), F.sum("n").alias("copies")).filter("copies > 1"), "para-groups")
    labels = materialize(labelled.join(groups, "root").select(*same, "rep"), "para-labels")
    removed = (F.col("row") != F.col("rep.row")) | (F.col("para") != F.col("rep.para"))
    return known.drop("bands").join(labels, same).select("doc_id", "key", "para", "word", "n_words", F.col("rep.doc_id").alias("rep_doc_id"), F.col("rep.para").alias("rep_para"), removed.alias("removed"))


class _Stretches:
    """Hashes of stretches of words, by prefix sums modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(self.BASE, len(words))[: len(words)])])
        self.inverse = _powers(pow(self.BASE, -1, 1 << 64), len(words) + 1)

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.inverse[start] + _U(size))


def windows(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, hash, hashes of the extensions or 0) of the keys of the documents' words; doc ascends."""
    size = _SPARE + 1
    if len(words) < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(EXTENSIONS)), np.uint64)
    all_of = _Stretches(words)
    hashes = all_of.of(np.arange(len(words) - WINDOW + 1), WINDOW)
    inside = np.flatnonzero(doc[: len(words) - PASSAGE + 1] == doc[PASSAGE - 1 :])
    change = np.concatenate([[0], np.cumsum(words[1:] != words[:-1])])
    inside = inside[change[inside + PASSAGE - 1] != change[inside]]  # one word over and over is no passage
    view = np.lib.stride_tricks.sliding_window_view(hashes, size)
    at = np.unique(np.concatenate([part + view[part].argmin(axis=1) for i in range(0, max(len(inside), 1), 1 << 16) if len(part := inside[i : i + (1 << 16)])] or [inside]))
    more = np.zeros((len(at), len(EXTENSIONS)), np.uint64)
    for i, (left, right) in enumerate(EXTENSIONS):
        start, stop = at - left, at + WINDOW + right - 1
        ok = (start >= 0) & (stop < len(words))
        ok[ok] = (doc[start[ok]] == doc[at[ok]]) & (doc[stop[ok]] == doc[at[ok]])
        more[ok, i] = all_of.of(start[ok], left + WINDOW + right)
    return at, hashes[at], more


def passages(scan: DataFrame) -> DataFrame:
    """The columns of ``group`` for every passage that stands elsewhere too."""
    known = scan.filter(F.col("unit") == _PASSAGE_KEY).select("row", "doc_id", "key", "para", "word", "digest", F.col("lists").alias("more"))
    twice = materialize(known.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "para-twice")
    met = materialize(known.join(twice, "digest"), "para-met")
    discard(twice)
    lefts, rights = ([F.lit(e[k]) for e in EXTENSIONS] for k in (0, 1))
    parts = met.select("*", F.posexplode("more").alias("i", "one")).filter("one <> 0").drop("more")
    parts = parts.withColumn("lo", F.col("word") - F.get(F.array(*lefts), F.col("i"))).withColumn("hi", F.col("word") + WINDOW + F.get(F.array(*rights), F.col("i")))
    by = ["digest", "i", "one"]
    groups = materialize(parts.groupBy(*by).agg(F.min(F.struct("doc_id", "row", "word", "para")).alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "para-passages")
    sure = parts.join(groups, by).withColumn("removed", (F.col("rep.row") != F.col("row")) | (F.col("rep.word") != F.col("word")))
    # a phrase over and over overlaps its own copies, of which the first one stays
    stays = F.col("rep.word") + F.col("hi") - F.col("word")
    sure = sure.withColumn("lo", F.when(F.col("removed") & (F.col("rep.row") == F.col("row")), F.greatest("lo", stays)).otherwise(F.col("lo"))).filter("lo < hi")
    order = Window.partitionBy("row", "removed").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = sure.withColumn("new", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("lo", "doc_id", "key", "para", "rep")).alias("f")
    each = runs.groupBy("row", "removed", "run").agg(first, (F.max("hi") - F.min("lo")).cast("int").alias("n_words"))
    return each.select("f.doc_id", "f.key", "f.para", F.col("f.lo").alias("word"), "n_words", F.col("f.rep.doc_id").alias("rep_doc_id"), F.col("f.rep.para").alias("rep_para"), "removed")


def _both(docs: DataFrame) -> DataFrame:
    scan = materialize(scanned(docs), "para-scan")
    return group(docs, scan).withColumn("unit", F.lit("paragraph")).unionByName(passages(scan).withColumn("unit", F.lit("passage")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, para (its first line), word (its first word's place in the text), n_words, rep_doc_id, rep_para, removed, unit:
    the paragraphs with a near or exact copy elsewhere, and the passages that stand elsewhere too."""
    return _both(docs).drop("key")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, texts, gone = batch.schema.get_field_index("text"), [], batch.column(batch.num_columns - 1).to_pylist()
        for text, spans in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), gone):
            if spans:
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], ~_BLANK[data], [False]]).astype(np.int8)))
                drop, edge = np.zeros(len(data) + 1, np.int32), np.append(edge[::2], len(data))
                for s in spans:
                    drop[edge[s["word"]]] += 1
                    drop[edge[s["word"] + s["n_words"]]] -= 1
                text = data[np.cumsum(drop[:-1]) == 0].tobytes().decode()
            texts.append(text)
        columns = batch.columns[:-1]
        columns[at] = pa.array(texts, batch.column(at).type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def remove(docs: DataFrame) -> DataFrame:
    """The documents without the words of paragraphs and passages that repeat an earlier one, and without the white space
    behind these words."""
    gone = _both(docs).filter("removed").groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set(F.struct("word", "n_words")).alias("__gone"))
    typed = docs.withColumn("text", F.col("text").cast("string"))
    met = typed.join(gone, typed["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(typed["text"]) == F.col("__key")), "left")
    return met.select(*[typed[c] for c in docs.columns], "__gone").mapInArrow(_cut, typed.schema)

"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte bigrams and trigrams (letters lower-cased, all else a blank), normalised.
Each language has several centroids from spherical k-means, and the nearest by cosine names the language. Where even
that one is further than any training text of its kind by a wide margin, the text is rejected.

Document frequencies count every training text. The centroids are fitted on a sample of SAMPLE labelled texts in
expectation, dealt evenly over the languages by a hash of the id, but of LEAST_TEXTS texts for each language at least. So
what reaches the driver grows with the number of labels, never with the corpus: the sample's counts, and the model of
CENTROIDS vectors for each language. A length class of which a language has too few texts takes the texts of all languages.

Edge cases: a null text or one without letters is ``und`` with score 0, and rejected; a null id is never held out and
never learned from; rows that repeat get the same answer; if there is nothing to learn from, all texts are ``und``; an
empty table gives an empty result; a long text is read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_of

DIM, CENTROIDS, SAMPLE, LEAST_TEXTS, ROUNDS, SEED = 1 << 13, 3, 1600, 50, 12, 42
#: A text is rejected below this share of the lowest cosine of its language's training texts of its length class.
REJECT_SHARE, REJECT_QUANTILE, LENGTHS = 0.3, 0.01, (4, 16, 64, 256)
#: And below this cosine in any case, as no n-gram of weight is shared.
LEAST_COSINE, _CLASS_TEXTS = 0.02, 20
_ROWS, _PIECE = 128, 1 << 18


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # one for each centroid
    floors: np.ndarray  # centroid x length class


def _fold_table() -> np.ndarray:
    """Bytes: A-Z to a-z, other ASCII but a-z to a blank, the rest as it is."""
    t = np.arange(256, dtype=np.uint8)
    t[:128] = 32
    t[97:123] = t[65:91] = np.arange(97, 123)
    return t


_FOLD = _fold_table()


def _pieces(starts, ends):
    """(row, start, end): long texts in pieces that overlap by two bytes."""
    for r, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        while e - s > _PIECE:
            yield r, s, s + _PIECE
            s += _PIECE - 2
        yield r, s, e


def counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, counts of n-grams for rows i to j); a row's bytes are the slice of data from its start to its end."""
    for a in range(0, len(starts), _ROWS):
        b = min(a + _ROWS, len(starts))
        total = np.zeros((b - a, DIM), np.float32)
        parts = list(_pieces(starts[a:b], ends[a:b]))
        s, e = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
        for i, j in slices(s, e):
            text = np.concatenate([data[x:y] for x, y in zip(s[i:j], e[i:j])]) if j > i else data[:0]
            row = np.repeat(np.array([p[0] for p in parts[i:j]]), (e - s)[i:j])
            piece = np.repeat(np.arange(j - i), (e - s)[i:j])
            small = _FOLD[text]
            small[1:] += np.where((text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E), 32, 0).astype(np.uint8)  # accented capitals
            g = small.astype(np.uint32)
            for n in (2, 3):
                if len(g) < n:
                    continue
                code = (g[: len(g) - n + 1] << 8) | g[1 : len(g) - n + 2]
                if n == 3:
                    code = (code << 8) | g[2:]
                slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
                same = (piece[: len(code)] == piece[n - 1 :]) & ((g[: len(code)] != 32) | (g[n - 1 :] != 32))
                key = row[: len(code)].astype(np.int64) * DIM + slot
                total += np.bincount(key[same], minlength=(b - a) * DIM).reshape(b - a, DIM).astype(np.float32)
        yield a, b, total


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _length_class(tf: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, (tf > 0).sum(axis=1))


def _learned(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("text").rlike(r"\p{L}"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(DIM, np.int64)
    for batch in batches:
        for _, _, tf in counts(*utf8_of(batch.column(0))):
            df += (tf > 0).sum(axis=0)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["slot", "df"])


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, starts, ends = utf8_of(batch.column(1))
        for a, b, tf in counts(data, starts, ends):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in np.minimum(tf, 65_535).astype("<u2")], pa.binary())], ["lang", "tf"])


def _kmeans(v: np.ndarray, k: int, rng) -> np.ndarray:
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(axis=1)
        c = np.array([v[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame) -> Model | None:
    """Learns from text and lang of documents whose crc32 leaves no 2; None if there are none."""
    known = _learned(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    found = known.select("text").mapInArrow(_frequencies, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIM)
    df[[r["slot"] for r in found]] = [r["df"] for r in found]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + 1
    share = max(LEAST_TEXTS, SAMPLE // len(sizes))
    bounds = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, int(min(1.0, share / n) * (1 << 30)))])
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < F.element_at(bounds, F.col("lang")))
    rows = sorted((r["lang"], bytes(r["tf"])) for r in sample.select("lang", "text").mapInArrow(_raw, "lang string, tf binary").collect())
    if not rows:
        return None
    rng, centroids, langs, cosines = np.random.default_rng(SEED), [], [], []
    for lang in sorted({r[0] for r in rows}):
        tf = np.array([np.frombuffer(t, "<u2") for x, t in rows if x == lang], np.float32)
        v = _vectors(tf, idf)
        c = _kmeans(v, CENTROIDS, rng)
        centroids.append(c)
        langs += [lang] * len(c)
        cosines.append(((v @ c.T).max(axis=1), _length_class(tf)))
    every = tuple(np.concatenate(x) for x in zip(*cosines))

    def floor(k: int, own: tuple) -> float:
        for best, kind in (own, every):
            if (kind == k).sum() >= _CLASS_TEXTS:
                return max(LEAST_COSINE, REJECT_SHARE * float(np.quantile(best[kind == k], REJECT_QUANTILE)))
        return LEAST_COSINE

    floors = [[floor(k, own) for k in range(len(LENGTHS) + 1)] for own, c in zip(cosines, centroids) for _ in c]
    return Model(idf, np.concatenate(centroids).astype(np.float32), langs, np.array(floors))


def predict(docs: DataFrame, model: Model | None, columns: list[str], prefix: str = "") -> DataFrame:
    """columns of docs, and lang_pred, score (the cosine), rejected, their names with the prefix."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + f", {prefix}lang_pred string, {prefix}score double, {prefix}rejected boolean"
    names = [*columns, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    full = docs.select(*columns, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"), F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            letters = batch.column(n - 2).to_numpy(zero_copy_only=False).astype(bool)
            pred, score, far = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.ones(batch.num_rows, bool)
            if model is not None:
                for a, b, tf in counts(*utf8_of(batch.column(n - 1))):
                    cos = _vectors(tf, model.idf) @ model.centroids.T
                    best = cos.argmax(axis=1)
                    ok = letters[a:b]
                    pred[a:b][ok] = np.array(model.langs, object)[best[ok]]
                    score[a:b] = np.where(ok, np.clip(cos.max(axis=1), 0, 1), 0)
                    far[a:b] = ~ok | (cos.max(axis=1) < model.floors[best, _length_class(tf)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(pred, pa.string()), pa.array(score), pa.array(far)], names)

    return full.mapInArrow(run, shape)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(docs.withColumn("held_out", held), fit(docs), ["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with all their columns; no shuffle."""
    return predict(docs, fit(docs), docs.columns, "__").filter("not __rejected").select(*docs.columns)

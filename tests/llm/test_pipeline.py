"""The stages one after the other, each against what it should keep of the stage before."""

import random

import corpus_pipeline
from tidecell.llm import sharding

WORDS = {"de": "der die und ist nicht eine von zu mit sich auf das dem den ein im".split(), "en": "the and of to in is that for with was are this from by at or".split()}


def prose(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "al", "on", "er"]) for _ in range(n))


def linked(texts):
    """The least id that links of five-word similarity 0.8 reach, for each id."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, t in texts.items() for w in [t.lower().split()]}
    first = {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and first[a] != first[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((first[a], first[b]))
                first = {d: low if f == high else f for d, f in first.items()}
    return first


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    items = [(i, prose(r, "en", 40)) for i in range(5)]
    rows = []
    for i in range(240):
        lang = r.choice(["de", "en"])
        rows.append((i, prose(r, lang, r.randint(20, 120)), lang, f"src{i % 3}", 0))
    rows += [(300 + i, rows[i][1], rows[i][2], rows[i][3], 0) for i in range(20)]
    near = {}
    for i in range(40):
        words = rows[i][1].split()
        if len(words) > 60:
            near[340 + i] = i
            words[len(words) // 2] = "uv"
            rows.append((340 + i, " ".join(words), rows[i][2], rows[i][3], 0))
    rows += [(400 + i, prose(r, "en", 30) + " " + t + " " + prose(r, "en", 30), "en", "src1", 0) for i, t in items]
    rows += [(500, None, "en", "src0", 0), (501, "12345", "en", "src0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = corpus_pipeline.materialize(stage(spark, at, str(tmp_path)), name)
        kept[name] = [x.doc_id for x in at.collect()]
        if name != "shard":
            assert at.columns == before.columns == docs.columns
    assert set(kept["language"]) == {d for d, *_ in rows} - {500, 501}
    groups = linked({d: t for d, t, *_ in rows if d < 500})
    assert near and all(groups[d] == i for d, i in near.items())
    assert sorted(kept["near_duplicates"]) == sorted(set(groups.values())) == [*range(240), *range(400, 405)]
    leaked = {d for d, t, *_ in rows if any(item in (t or "") for _, item in items)}
    assert leaked == set(range(400, 405)) and set(kept["decontaminate"]) == set(kept["near_duplicates"]) - leaked
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and sorted(kept["shard"]) == sorted(kept["mix"])
    assert "shard" in at.columns and all(0 <= x.shard < sharding.SHARDS for x in at.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["shard"])


CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long, score double, rejected boolean, copies int, size int, m int, key string, value string"


def test_stages_on_odd_tables(spark, tmp_path):
    """No rows; nulls everywhere, repeated rows, ties, and columns that are called like those of the operators."""
    spark.createDataFrame([(0, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], CLASH)
    r = random.Random(1)
    some = [(i, prose(r, "en", 40), "en", "s", 0, *[None] * 9) for i in range(30)]
    some += [some[3], some[3], (None, None, None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9), (None, prose(r, "en", 30), None, None, 1, *[None] * 9), (7, "", "de", "t", 0, *[None] * 9)]
    odd = spark.createDataFrame(some, CLASH)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        again = stage(spark, odd, str(tmp_path))
        assert again.columns[: len(odd.columns)] == odd.columns
        rows = [x.doc_id for x in again.collect()]
        if name == "language":
            assert sorted(map(str, rows)) == sorted([*map(str, range(30)), "3", "3", "None"])
        elif name == "near_duplicates":
            assert rows.count(3) == 3 and rows.count(0) == 1
        elif name == "mix":
            # 1,310 words in all: the sources without a name and "t" stop at 3 times 30 and 0 words, so "s" gives 60 of its 1,280
            assert set(map(str, rows)) <= {*map(str, range(30)), "None"} and rows.count(None) == 3
            assert abs(sum(x != None for x in rows) * 40 - 1220) <= 40  # noqa: E711
        else:
            assert len(rows) == len(some)

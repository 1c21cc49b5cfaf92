"""Merkle manifest of a dataset: leaves, roots and authentication paths by fractal traversal of aligned blocks.

A row is a leaf, the hash of its fields. The leaves of a source, in order of doc_id, are the bottom of a tree whose nodes
have FAN children; the roots of the sources, in order of source, are the bottom of a tree above, whose root stands for the
dataset. Anyone who holds a row, its path and the root can check the row without any other (``fold``).

Places in the order come from a sort in ranges, so no source is sorted by one task: what a source has in earlier ranges is
added up from one number for each source and range. Aligned blocks of BLOCK = FAN^HEIGHT nodes are hashed side by side;
their roots are the nodes of the next table, with a BLOCK-th of the rows, until one block holds all. Paths then come down
the same tables. A block's task walks over its leaves in order and keeps, for each level of the block, two stacked
subtrees: the existing one, which gives the siblings of the current leaf, and the desired one beside it, which grows by a
leaf a step and takes the existing one's place when the walk gets there. So beside the block's own digests it holds 2 FAN
nodes and FAN open ones for each level. What lies above the block comes with one row that is sorted before the block's leaves, and is
appended to each path. Text takes part in the first step only; all others move digests.

Edge cases: a null field is hashed as '-', unlike an empty one; a null doc_id comes first in its source, and of equal ids
the lesser leaf does; rows that repeat are leaves of their own; a null source is a source, first in order; a lone leaf is
its source's root, a lone source's root is the dataset's, and both have an empty path; an empty table gives an empty
result; columns but FIELDS play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecell.functions.stage import discard

from .common import materialize

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
_ROWS = 512  # of a batch with paths
_PROOF = "array<struct<left: string, right: string>>"
_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(fields: list[Column]) -> Column:
    """The leaf of a row with these fields, all strings."""
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in fields]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Subtree:
    """The nodes of one level over leaves that are added in order; open holds what is not yet hashed on the way up."""

    def __init__(self, level: int):
        self.nodes: list[str] = []
        self.open: list[list[str]] = [[] for _ in range(level)]

    def add(self, node: str, below: int = 0) -> None:
        while below < len(self.open):
            self.open[below].append(node)
            if len(self.open[below]) < FAN:
                return
            node, self.open[below] = _hash(self.open[below]), []
            below += 1
        self.nodes.append(node)

    def over(self, leaves: list[str]) -> Subtree:
        """With these leaves, and closed: the last runs may be short."""
        for leaf in leaves:
            self.add(leaf)
        return self.closed()

    def closed(self) -> Subtree:
        for level in range(len(self.open)):
            if run := self.open[level]:
                self.open[level] = []
                self.add(_hash(run), level + 1)
        return self


def levels(n: int) -> int:
    """Of a block in a row of n nodes."""
    return next(h for h in range(HEIGHT + 1) if h == HEIGHT or FAN**h >= n)


def paths(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """The path of each leaf in turn up to the block's root: what stands left and right in its run at each level."""
    width = [FAN ** (level + 1) for level in range(height)]  # of a subtree, in leaves
    exist = [Subtree(level).over(leaves[:w]) for level, w in enumerate(width)]
    desired = [Subtree(level) for level in range(height)]
    path: list[tuple[str, str]] = [("", "")] * height
    for i in range(len(leaves)):
        for level, w in enumerate(width):
            if i and i % w == 0:
                exist[level], desired[level] = desired[level].closed(), Subtree(level)
            if i + w < len(leaves):
                desired[level].add(leaves[i + w])
            if i % (w // FAN) == 0:
                place = i // (w // FAN) % FAN
                path[level] = "".join(exist[level].nodes[:place]), "".join(exist[level].nodes[place + 1 :])
        yield list(path)


def _blocks(batches: Iterator[pa.RecordBatch], first: str) -> Iterator[pa.Table]:
    """The rows of each block; one begins where the column ``first`` is 0."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cuts = np.flatnonzero(batch.column(batch.schema.get_field_index(first)).to_numpy() == 0).tolist()
        begin = 0
        for cut in [*cuts, batch.num_rows]:
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if cut < batch.num_rows and held:
                yield pa.Table.from_batches(held)
                held = []
            begin = cut
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds r, the row's place in its group from 0, and n, the group's rows; nulls are values, and come first."""
    sort = [F.col(c).asc_nulls_first() for c in (*by, *order, "__row")]
    cut = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*sort).sortWithinPartitions(*sort).drop("__row").withColumn("__at", F.monotonically_increasing_id())
    cut = materialize(cut.withColumn("__range", F.shiftright("__at", 33)), "merkle-ranges")
    of = Window.partitionBy(*[c + "__" for c in by]) if by else Window.partitionBy(F.lit(0))
    sizes = cut.groupBy(F.col("__range").alias("range__"), *[F.col(c).alias(c + "__") for c in by]).agg(F.min("__at").alias("first__"), F.count(F.lit(1)).alias("size__"))
    before = F.sum("size__").over(of.orderBy("range__")) - F.col("size__") - F.col("first__")
    sizes = materialize(sizes.select("range__", *[c + "__" for c in by], before.alias("shift__"), F.sum("size__").over(of).alias("n")), "merkle-places")
    same = cut["__range"] == sizes["range__"]
    for c in by:
        same = same & cut[c].eqNullSafe(sizes[c + "__"])
    return cut.join(sizes, same).withColumn("r", F.col("__at") + F.col("shift__")).select(*rows.columns, "r", "n")


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def _placed(nodes: DataFrame, first: int) -> DataFrame:
    """With the node's block and its place in it, from first on."""
    return nodes.withColumns({"block": F.floor(F.col("r") / BLOCK), "at": F.col("r") % BLOCK + first})


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, "at"):
        n = block.column("n")[0].as_py()
        node = Subtree(levels(n)).over(block.column("leaf").to_pylist()).nodes[0]
        yield pa.RecordBatch.from_arrays([block.column("tree").combine_chunks().slice(0, 1), pa.array([block.column("block")[0].as_py()]), pa.array([n]), pa.array([node])], ["tree", "r", "n", "leaf"])


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes: (tree string, r, n, leaf, ...) -> the tables of nodes a block's height apart, and (tree, step, root): each
    tree's root and the number of the table whose one block it stands over."""
    tables, roots = [nodes], None
    while True:
        inner = _placed(tables[-1], 0).select("tree", "block", "at", "n", "leaf")
        up = materialize(_dealt(inner).mapInArrow(_roots, "tree string, r long, n long, leaf string"), "merkle-nodes")
        done = up.filter(F.col("n") <= BLOCK).select("tree", F.lit(len(tables) - 1).alias("step"), F.col("leaf").alias("root"))
        roots = done if roots is None else roots.unionAll(done)
        more = up.filter(F.col("n") > BLOCK).withColumn("n", F.ceil(F.col("n") / BLOCK))
        if more.isEmpty():
            return tables, roots
        tables.append(more)


def descend(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """above: (tree, step, upper, ...): the path from each tree's root on. -> the first table's rows with proof, the path
    of each, and the columns of above that are not named here."""
    given = [c for c in above.columns if c not in ("tree", "step", "upper")]
    found = None
    for step in reversed(range(len(tables))):
        heads = above.filter(F.col("step") == step).select("tree", F.lit(0).cast("long").alias("block"), "upper", *given)
        if found is not None:
            heads = heads.unionByName(found.select("tree", F.col("r").alias("block"), F.col("proof").alias("upper"), *given))
        own = [c for c in tables[step].columns if c != "tree"]
        rows = _placed(tables[step], 1).unionByName(heads.withColumn("at", F.lit(0).cast("long")), allowMissingColumns=True)
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("tree", *own, *given).schema] + [f"proof {_PROOF}"])
        found = _dealt(rows.select("tree", "block", "at", *own, "upper", *given)).mapInArrow(_proofs(own, given), schema)
        found = materialize(found, "merkle-paths") if step else found
    return found


def _proofs(own: list[str], given: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "at"):
            upper = [(s["left"], s["right"]) for s in block.column("upper")[0].as_py()]
            head = [block.column(c)[0] for c in given]
            rows = block.slice(1).combine_chunks()
            if not rows.num_rows:
                continue
            leaves = rows.column("leaf").to_pylist()
            walk = paths(leaves, levels(rows.column("n")[0].as_py()))
            for i in range(0, len(leaves), _ROWS):
                part = rows.slice(i, _ROWS)
                proof = pa.array([[dict(zip(("left", "right"), s)) for s in (*next(walk), *upper)] for _ in range(part.num_rows)], _STEP)
                columns = [part.column(c).combine_chunks() for c in ("tree", *own)] + [pa.array([h.as_py()] * part.num_rows, h.type) for h in head] + [proof]
                yield pa.RecordBatch.from_arrays(columns, ["tree", *own, *given, "proof"])

    return run


def prove(leaves: DataFrame) -> DataFrame:
    """leaves: (source, doc_id, leaf, ...) -> the same with subroot, root and proof, the path of each leaf to the root."""
    hashed = materialize(leaves, "merkle-leaves")  # the sort samples its input: no text is hashed twice
    nodes = numbered(hashed.withColumn("tree", F.col("source")), ["tree"], ["doc_id", "leaf"])
    discard(hashed)
    tables, subroots = climb(nodes)
    top = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "step", F.col("root").alias("leaf")), [], ["source"])
    tops, roots = climb(top)
    heads = descend(tops, roots.select("tree", "step", F.array().cast(_PROOF).alias("upper"), "root"))
    above = materialize(heads.select(F.col("source").alias("tree"), "step", F.col("proof").alias("upper"), F.col("leaf").alias("subroot"), "root"), "merkle-above")
    return descend(tables, above).drop("tree", "r", "n")


def leaves_of(docs: DataFrame, tamper: bool = False) -> DataFrame:
    """(source, doc_id, leaf) of each row; with tamper also claim, the leaf of what the row is said to be: of one document
    in five the text in lower case."""
    typed = {c: F.col(c).cast(kind) for c, kind in FIELDS.items()}
    text = {c: x.cast("string") for c, x in typed.items()}
    own = digest(list(text.values()))
    out = [typed["source"].alias("source"), typed["doc_id"].alias("doc_id"), own.alias("leaf")]
    if tamper:
        upper = "".join(map(chr, range(65, 91)))
        changed = digest([*list(text.values())[:-1], F.translate(text["text"], upper, upper.lower())])
        out.append(F.when(F.crc32(text["doc_id"]) % 5 == 0, changed).otherwise(own).alias("claim"))
    return docs.select(*out)


def manifest(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, subroot, root, proof)."""
    return prove(leaves_of(docs))


def report(docs: DataFrame) -> DataFrame:
    found = prove(leaves_of(docs, tamper=True))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("claim"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""A Merkle manifest of a dataset: every row gets a leaf, a proof, and the roots of its source and of the whole.

A leaf hashes doc_id, source, lang, n_chars and text, each as `-` where null, else as UTF-8 byte count, `:`, value. Leaves of a source ascend by
doc_id; every FAN consecutive nodes become the hash of their digests, until one is left, the source's subroot (a lone leaf itself). Subroots, null source
first, then bytewise, give the root in the same way. A proof lists for each level the digests left and right of the own node in its run.

Positions come from ranges of (source, doc_id), numbered inside each range and shifted by the totals of the ranges before, so no source meets in one task.
A superblock is FAN ** STEP consecutive nodes: upwards each is reduced to one node, STEP levels a shuffle; downwards its nodes and the one path
that leads on from it are cogrouped, and one function reduces again, joins the inner to the outer proof, hashes and folds. A task holds one superblock
at a time, whatever the size of a source.

Null doc_ids come first. Rows that share source and doc_id are leaves of their own, in the order of their digests; equal rows are equal leaves. A null
text is `-`, an empty one `0:`. Other columns of the documents, whatever their names, count for nothing. Texts are hashed whole. An empty table has no leaf.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import cut

FAN, STEP = 16, 3  # digests of a run, levels of a superblock
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, with another text if given."""

    def part(name: str) -> Column:
        value = (text if name == "text" and text is not None else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in FIELDS)), 256)


def folded(own: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (array of structs of left and right) lead to."""
    return F.aggregate(proof, own, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def depth(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _levels(digests: list[str], up: int) -> list[list[str]]:
    out = [digests]
    for _ in range(up):
        below = out[-1]
        out.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def _sides(level: list[str]) -> list[tuple[str, str]]:
    """For each node what is left and right of it in its run."""
    out = []
    for low in range(0, len(level), FAN):
        run = level[low : low + FAN]
        text, size = "".join(run), len(run[0])
        out += [(text[: i * size], text[(i + 1) * size :]) for i in range(len(run))]
    return out


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with pos, from 0 in each tree, and n, the rows of the tree; `order` starts with the tree."""
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    placed = ranged.withColumn("_range", F.shiftright("_i", 33))
    sizes = placed.groupBy("tree", "_range").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    # One row for each range that a tree reaches into.
    before = sizes.select("tree", "_range", "_first", F.expr("sum(_n) OVER (PARTITION BY tree ORDER BY _range) - _n").alias("_before"), F.expr("sum(_n) OVER (PARTITION BY tree)").alias("n"))
    return placed.join(before, ["tree", "_range"]).withColumn("pos", F.col("_i") - F.col("_first") + F.col("_before")).drop("_i", "_first", "_before", "_range")


def _block(step: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FAN**step)).alias("block")


def _reduced(step: int):
    """One superblock as a node of the tree above."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        up = min(step, depth(n))
        return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "pos": [int(rows["pos"].iloc[0]) // FAN**step], "n": [-(-n // FAN**up)], "digest": [_levels(rows["digest"].tolist(), up)[-1][0]]})

    return run


def _climbed(nodes: DataFrame, step: int) -> list[DataFrame]:
    """nodes (tree, pos, n, digest), and above them one frame for each `step` levels, until every tree has a single node."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    out = [nodes]
    for _ in range(max(1, -(-depth(most) // step))):
        out.append(cut(out[-1].groupBy("tree", _block(step)).applyInPandas(_reduced(step), "tree string, pos long, n long, digest string")))
    return out


def _joined(nodes: DataFrame, outer: DataFrame, step: int, finish, schema: str) -> DataFrame:
    """Cogroups each superblock with the path that leads on from it. finish(rows, sides of the inner levels, path, subroot, root) gives the rows of schema."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, on = rows.sort_values("pos"), above.iloc[0]
        inner = _levels(rows["digest"].tolist(), min(step, depth(int(rows["n"].iloc[0]))))[:-1]
        return finish(rows, [_sides(x) for x in inner], list(zip(on["left"], on["right"], strict=True)), on["subroot"], on["root"])

    return nodes.groupBy("tree", _block(step)).cogroup(outer.groupBy("tree", "pos")).applyInPandas(run, schema)


def _passed_on(bottom: bool):
    """The paths of nodes that are superblocks of the level below; a node at the bottom of the tree of sources is a subroot."""

    def finish(rows, sides, path, subroot, root):
        paths = [[*(side[i // FAN**level] for level, side in enumerate(sides)), *path] for i in range(len(rows))]
        out = pd.DataFrame({"tree": rows["name" if bottom else "tree"], "pos": 0 if bottom else rows["pos"], "left": [[a for a, _ in p] for p in paths], "right": [[b for _, b in p] for p in paths]})
        return out.assign(subroot=rows["digest"] if bottom else subroot, root=root)

    return finish


def _finished(proofs: bool):
    def finish(rows, sides, path, subroot, root):
        above = ["".join(a + b for a, b in path)]  # the text of the proof from a level upwards, for each node of that level
        for side in reversed(sides[1:]):
            above = [a + b + above[i // FAN] for i, (a, b) in enumerate(side)]
        own = [x if isinstance(x, str) else d for d, x in zip(rows["digest"], rows["altered"], strict=True)]
        hashes, roots, paths = [], [], []
        for i, at in enumerate(own):
            steps = [side[i // FAN**level] for level, side in enumerate(sides)]
            hashes.append(digest("".join(steps[0]) + above[i // FAN] if steps else above[0]))
            steps += path
            for a, b in steps:
                at = digest(a + at + b)
            roots.append(at)
            if proofs:
                paths.append(steps)
        out = rows[["doc_id", "source", "pos"]].assign(leaf=rows["digest"], subroot=subroot, root=root, proof_sha256=hashes, folded_root=roots)
        return out.assign(left=[[a for a, _ in p] for p in paths], right=[[b for _, b in p] for p in paths]) if proofs else out

    return finish


def manifest(docs: DataFrame, altered: Column | None = None, proofs: bool = False, step: int = STEP) -> DataFrame:
    """doc_id, source, pos (in its source, from 0), leaf, subroot, root, proof_sha256 and folded_root of every row, and proof if asked for.

    `altered` gives another text for some rows (null: none): folded_root is what the leaf with that text and the row's proof lead to, and differs
    from root where the text does."""
    kinds = dict(docs.dtypes)
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(altered))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("order"), "source", leaf().alias("digest"), other.alias("altered"))
    rows = cut(rows)  # ranges are sampled first: the texts are read once only
    leaves = cut(_numbered(rows, [F.col("tree"), F.col("order").asc_nulls_first(), F.col("digest")]).drop("order"))  # a null would make pandas count in floats
    below = _climbed(leaves, step)
    subroots = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    above = _climbed(cut(_numbered(subroots, [F.col("tree"), F.col("name")])), step)
    none = F.array().cast("array<string>")
    outer = above[-1].select("tree", "pos", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed([*below[1:-1], *above[:-1]]):
        outer = _joined(nodes, outer, step, _passed_on(nodes is above[0]), "tree string, pos long, left array<string>, right array<string>, subroot string, root string")
    more = ", left array<string>, right array<string>" if proofs else ""
    out = _joined(leaves, outer, step, _finished(proofs), f"doc_id string, source string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string{more}")
    out = out.withColumn("doc_id", F.col("doc_id").cast(kinds["doc_id"]))
    return out.withColumn("proof", F.arrays_zip("left", "right")).drop("left", "right") if proofs else out

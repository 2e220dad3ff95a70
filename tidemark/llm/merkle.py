"""A Merkle manifest of a data set: leaf digests, proofs and their checks, in DataFrame functions.

Every row is a leaf, every group of rows (a source) a tree of its leaves in the order of ids, and the trees' roots, in the
order of sources, are the leaves of one more tree.  Nodes are joined in runs of ``ARITY``.

Trees are reduced from below in large blocks: nodes get their places in their tree by counts of ranges, ``ARITY`` **
``HEIGHT`` consecutive ones are one row with all their levels, and only the block's own root goes on as a node of the next
pass.  A pass leaves one node in some thousands, so soon at most ``TOP`` nodes are left, whatever the size; those go to the driver, which builds
the rest of the trees and returns each node's path to the root (its suffix).  Suffixes, bounded by ``TOP`` times the few
levels above, are broadcast to the blocks of the last pass; executors finish the proofs pass by pass downwards.  A path is a
list of steps (left, right): the siblings of a node before and behind it.  Folding a leaf along its path gives the root,
row by row.

Defined cases: a null value of a field is marked as such and differs from an empty one; rows of one id and source are
separate leaves, ordered by their digest; a null id comes last in its source; a null source is a source, the first; a
single leaf is its tree's root, and a single tree's root is the root; an empty table gives an empty result; columns that
are not fields are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import prefixed
from .scratch import narrowed, table

ARITY = 3
#: A block has ARITY ** HEIGHT nodes.
HEIGHT = 7
#: Nodes that the driver takes at most.
TOP = 2_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value so that no two different lists of values are the same characters: byte count, colon, value; or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, start, lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], arity: int = ARITY) -> list[list[str]]:
    """All levels of a small tree, from its leaves to its root."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([_digest(found[-1][i : i + arity]) for i in range(0, len(found[-1]), arity)])
    return found


def steps(tree: list[list[str]], at: int, arity: int = ARITY) -> list[tuple[str, str]]:
    """The path from leaf ``at`` of a small tree to its root."""
    path = []
    for level in tree[:-1]:
        run = at - at % arity
        path.append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
        at //= arity
    return path


def upper(nodes: list[tuple], arity: int = ARITY) -> tuple[list[tuple], str | None]:
    """The driver's part: (tree, place, digest) of at most TOP nodes -> a row (tree, place, suffix, subroot) for each, and the root."""
    trees: dict[int, list[tuple]] = {}
    for tree, place, digest in sorted(nodes):
        trees.setdefault(tree, []).append((place, digest))
    own = {tree: levels([d for _, d in rows], arity) for tree, rows in trees.items()}
    top = levels([own[tree][-1][0] for tree in own], arity) if own else [[None]]
    above = {tree: steps(top, i, arity) for i, tree in enumerate(own)}
    return [(tree, place, steps(own[tree], i, arity) + above[tree], own[tree][-1][0]) for tree, rows in trees.items() for i, (place, _) in enumerate(rows)], top[-1][0]


def _level(nodes: Column, open_: Column, arity: int) -> Column:
    """The next level of a block, or the same where its tree is already one node."""
    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / arity).cast("int") - 1), lambda i: F.sha2(F.array_join(F.slice(nodes, i * arity + 1, arity), "").cast("binary"), 256))
    return F.when(open_, runs).otherwise(F.array().cast("array<string>"))


def _blocks(spark: SparkSession, nodes: DataFrame, carried: list[str], arity: int, height: int) -> DataFrame:
    """``nodes`` (tree, place, size of the tree, digest and more) in rows of a block each: its rows, all levels below its root, and the root."""
    row = F.struct("place", "digest", *carried)
    found = nodes.groupBy("tree", "size", F.floor(F.col("place") / arity**height).cast("long").alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = found.withColumn("level0", F.transform("rows", lambda r: r["digest"]))
    for i in range(height):
        # A level is open while the whole tree, of which the block is a part, has several nodes at it.
        found = found.withColumn(f"level{i + 1}", _level(F.col(f"level{i}"), F.col("size") > arity**i, arity))
    reached = [F.col(f"level{i}") for i in reversed(range(height + 1))]
    last = F.coalesce(*[F.when(F.size(c) > 0, c[0]) for c in reached])
    return table(spark, found.select("tree", "size", "block", "rows", *[f"level{i}" for i in range(height)], last.alias("root")), "blocks")


def _paths(blocks: DataFrame, suffixes: DataFrame, carried: list[str], arity: int, height: int, broadcast: bool) -> DataFrame:
    """The rows of ``blocks`` with their paths: the steps within the block, and then those of the block's own node."""
    suffixes = suffixes.select("tree", F.col("place").alias("block"), "suffix", "subroot")
    joined = blocks.join(F.broadcast(suffixes) if broadcast else suffixes, ["tree", "block"])

    def step(i: int, place: Column) -> Column:
        level, width = F.col(f"level{i}"), F.lit(arity**i)
        at = F.floor((place % arity**height) / width).cast("int")
        run = at - at % arity
        one = F.struct(F.array_join(F.slice(level, run + 1, at - run), "").alias("left"), F.array_join(F.slice(level, at + 2, run + arity - 1 - at), "").alias("right"))
        return F.when(F.col("size") > width, F.array(one)).otherwise(F.array().cast(STEPS))

    own = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("place", "digest", *carried)], F.concat(*[step(i, r["place"]) for i in range(height)], F.col("suffix")).alias("path")))
    return joined.select("tree", "subroot", F.explode(own).alias("r")).select("tree", "subroot", "r.*")


def manifest(spark: SparkSession, df: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", other: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """A row for each row of ``df``: doc_id, leaf, subroot, root, path.

    ``other`` gives names and expressions over ``fields`` that are carried along, as digests of other versions of a row."""
    other = other or {}
    rows = narrowed(df, **{f: (f, None) for f in fields}, **{"leaf id": (id_col, None), "leaf tree": (tree_col, "string")})
    carried = ["doc_id", *other]
    leaves = rows.select(
        F.col("leaf tree").isNotNull().alias("named"), F.coalesce("leaf tree", F.lit("")).alias("name"), F.col("leaf id").isNull().alias("last"),
        F.col("leaf id").alias("doc_id"), leaf([F.col(f) for f in fields]).alias("digest"), *[v.alias(k) for k, v in other.items()],
    )
    # Written before ranges are sought, so that texts are read and digested once.
    leaves = table(spark, leaves, "leaves")
    placed = table(spark, prefixed(spark, leaves, ["named", "name", "last", "doc_id", "digest"], {"upto": F.lit(1)}), "placed")
    per = placed.groupBy("named", "name").agg(F.min("upto").alias("first"), F.count("*").alias("size"))
    per = table(spark, prefixed(spark, per, ["named", "name"], {"tree": F.lit(1)}), "trees")
    nodes = placed.join(per, ["named", "name"]).select("tree", "size", (F.col("upto") - F.col("first")).alias("place"), "digest", *carried)

    passes, left = [], None
    while left is None or left > top:
        more = carried if not passes else []
        if left is not None and left == nodes.agg(F.countDistinct("tree")).first()[0]:
            # Only roots of trees are left, more than the driver takes: they are the leaves of one tree.
            nodes = nodes.select(F.lit(0).cast("long").alias("tree"), F.lit(left).cast("long").alias("size"), F.col("tree").alias("place"), "digest", F.col("tree").alias("of"))
            more = ["of"]
        found = _blocks(spark, nodes, more, arity, height)
        passes.append((found, more))
        nodes = found.select("tree", F.ceil(F.col("size") / arity**height).cast("long").alias("size"), F.col("block").alias("place"), F.col("root").alias("digest"))
        left = found.count()

    suffix, root = upper([tuple(r) for r in nodes.select("tree", "place", "digest").collect()], arity)
    paths = spark.createDataFrame(suffix, f"tree long, place long, suffix {STEPS}, subroot string")
    for i, (found, more) in enumerate(reversed(passes)):
        paths = _paths(found, paths, more, arity, height, broadcast=i == 0)
        if i < len(passes) - 1:
            # Roots of trees, where they were joined, get back their tree; their digest is the subroot of all below.
            own = [F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("digest").alias("subroot")] if more == ["of"] else ["tree", "place", "subroot"]
            paths = table(spark, paths.select(*own, F.col("path").alias("suffix")), "paths")
    return paths.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path", *other)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the crc32 of the id's digits."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def checked(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The manifest of documents, and what a check of the documents against it finds after some texts were tampered with."""
    seen = [tampered_text(F.col("doc_id"), F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    found = manifest(spark, df, other={"seen": leaf(seen)})
    fold = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return fold.withColumn("verified", F.col("folded_root") == F.col("root"))

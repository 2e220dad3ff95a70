"""Embedding near-deduplication by an epsilon grid order join.

Equal vectors form one class.  Unit vectors at a cosine of at least ``COSINE`` are at most EPS apart, and a projection on
orthonormal axes never takes them farther.  Vectors are sorted by their cells on the leading principal axes (epsilon grid
order) and the sequence is cut into strips.  Strips are joined recursively: a pair of nodes is followed only if the
bounding boxes of their projections are within EPS, otherwise all that is below them is provably distant.  A pair of
strips is joined the same way down to small tiles, whose cosines are computed in double precision.  A strip pair returns
counts of links and a spanning forest of its links, never the pairs themselves.

A vector is moved once for each pair that its strip is in.  Strips hold up to ``STRIP_BYTES``; below STRIPS times as much
there are ``STRIPS`` of them, so that all of a small table is moved STRIPS + 1 times at most, whatever its size, and only
tables beyond that are moved more often, by the strips that are near.

Principal axes are fitted on a sample of at most ``SAMPLE`` vectors; they only steer what is skipped, never the result.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components link with nothing, themselves
included; vectors of different lengths never link; rows with the same id count as vectors of their own and share a
component; a null id takes part in counts of links but never names a component; columns other than id and vector are not
read, whatever their names; components of double precision stay so; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, NullType

from .components import components
from .scratch import narrowed, place, slices, table

COSINE, AXES, SAMPLE, TILE, FAN = 0.9, 8, 4096, 256, 16
STRIP_BYTES, STRIPS, RANGE_ROWS = 16 << 20, 6, 8192
EPS = float(np.sqrt(2 - 2 * COSINE))
SLACK = 1e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(sample: np.ndarray, n: int = AXES) -> np.ndarray:
    """Orthonormal columns: the leading principal directions of a sample's unit vectors, or of the space if it is small."""
    dim = sample.shape[1]
    spread = unit_rows(sample)
    spread = spread - spread.mean(0)
    values, vectors = np.linalg.eigh(spread.T @ spread + 1e-12 * np.eye(dim))
    return vectors[:, np.argsort(-values)[:n]]


def box_gap2(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Squared distance between boxes."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (gap * gap).sum(-1)


def close_tiles(a: np.ndarray, b: np.ndarray, same: bool, tile: int = TILE) -> Iterator[tuple[slice, slice]]:
    """Pairs of tiles of two sequences of projections that aren't provably distant, by recursive halving."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i >= j or k >= m or (same and k + (m - k) <= i):
            continue
        if box_gap2(a[i:j].min(0), a[i:j].max(0), b[k:m].min(0), b[k:m].max(0)) > EPS * EPS + SLACK:
            continue
        if j - i <= tile and m - k <= tile:
            yield slice(i, j), slice(k, m)
            continue
        rows = [(i, j)] if j - i <= tile else [(i, (i + j) // 2), ((i + j) // 2, j)]
        columns = [(k, m)] if m - k <= tile else [(k, (k + m) // 2), ((k + m) // 2, m)]
        todo += [(*r, *c) for r in rows for c in columns]


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of a tile's links; rows are numbered first, then columns."""
    n, m = hit.shape
    label, big = np.arange(n + m), n + m
    while True:
        before = label
        rows = np.minimum(label[:n], np.where(hit, label[n:], big).min(1))
        columns = np.minimum(label[n:], np.where(hit, rows[:, None], big).min(0))
        label = np.r_[rows, columns]
        label = label[label]
        if (label == before).all():
            child = np.flatnonzero(label != np.arange(n + m))
            return child, label[child]


def join_strips(n_a: np.ndarray, raw_a: np.ndarray, n_b: np.ndarray, raw_b: np.ndarray, axes: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of linked vectors for the rows of a and then of b, and a spanning forest (x, y) of the links by row.

    ``n_a`` and ``n_b``: how many vectors a row stands for.  For ``same``, both sides are one strip, and rows are those of a."""
    a, b = unit_rows(raw_a.astype(np.float64)), unit_rows(raw_b.astype(np.float64))
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    shift = 0 if same else len(a)
    counts, parent = np.zeros(len(a) + (0 if same else len(b))), np.arange(len(a) + (0 if same else len(b)))
    edges: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    for rows, columns in close_tiles(a @ axes, b @ axes, same):
        hit = a[rows] @ b[columns].T >= COSINE
        alone = same and rows == columns
        if alone:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        counts[rows] += hit.astype(np.float64) @ n_b[columns]
        if not alone:
            counts[columns.start + shift : columns.stop + shift] += n_a[rows] @ hit.astype(np.float64)
        number = np.r_[np.arange(rows.start, rows.stop), np.arange(columns.start, columns.stop) + shift]
        for x, y in zip(*(number[i].tolist() for i in _forest(hit))):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((x, y))
    x, y = np.array(edges, np.int64).reshape(-1, 2).T
    return counts.astype(np.int64), x, y


_STRIP = "node long, dim int, reps binary, sizes binary, raw binary, lo array<double>, hi array<double>"


def _strip(axes: dict[int, np.ndarray], dims: list[int], kind: type):
    """One row for a strip, an interval of the sequence with vectors of one length."""
    kinds = pa.schema([("node", pa.int64()), ("dim", pa.int32()), ("reps", pa.binary()), ("sizes", pa.binary()), ("raw", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("seq")
        dim, strip = group.column("dim")[0].as_py(), group.column("strip")[0].as_py()
        raw = group.column("embedding").combine_chunks().flatten().to_numpy().astype(kind).reshape(-1, dim)
        p = unit_rows(raw.astype(np.float64)) @ axes[dim]
        box = np.zeros((2, AXES))
        box[:, : p.shape[1]] = p.min(0), p.max(0)
        packed = [group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("rep", "size")]
        return pa.Table.from_pydict({"node": [strip * len(dims) + dims.index(dim)], "dim": [dim], "reps": packed[:1], "sizes": packed[1:], "raw": [raw.tobytes()], "lo": [box[0].tolist()], "hi": [box[1].tolist()]}, kinds)

    return run


def _cells(axes: dict[int, np.ndarray]):
    """The cell numbers of each vector on the leading axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for dim, v in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                cell = np.zeros(AXES, np.int32)
                x = np.array(v, np.float64)
                p = x @ axes[dim] / np.linalg.norm(x)
                cell[: len(p)] = np.floor(4 * p / EPS)  # quarters of a cell keep the intervals' boxes narrow
                out.append(cell)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in out], pa.list_(pa.int32()))], ["dim", "rep", "size", "embedding", "cells"])

    return run


def _pairs(spark: SparkSession, strips: DataFrame) -> DataFrame:
    """(one, two) for the pairs of strips that aren't provably distant, by recursion over intervals of the sequence."""
    flat = [F.col("lo")[i].alias(f"lo{i}") for i in range(AXES)] + [F.col("hi")[i].alias(f"hi{i}") for i in range(AXES)]
    nodes = strips.select("node", F.col("dim").alias("dim_lo"), F.col("dim").alias("dim_hi"), *flat)
    levels = [table(spark, nodes, "nodes0")]
    while levels[-1].limit(2).count() > 1:
        low = [F.min(c).alias(c) for c in ["dim_lo"] + [f"lo{i}" for i in range(AXES)]]
        high = [F.max(c).alias(c) for c in ["dim_hi"] + [f"hi{i}" for i in range(AXES)]]
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(*low, *high)
        levels.append(table(spark, up, f"nodes{len(levels)}"))
    pairs = levels[-1].select(F.col("node").alias("one"), F.col("node").alias("two"))
    for level in range(len(levels) - 2, -1, -1):
        child = levels[level].withColumn("up", F.floor(F.col("node") / FAN).cast("long"))
        a = child.select(*[F.col(c).alias(f"a_{c}") for c in child.columns])
        b = child.select(*[F.col(c).alias(f"b_{c}") for c in child.columns])
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")) for i in range(AXES)]
        gap2 = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
        meet = (F.col("a_node") <= F.col("b_node")) & (F.col("a_dim_lo") <= F.col("b_dim_hi")) & (F.col("b_dim_lo") <= F.col("a_dim_hi")) & (gap2 <= EPS * EPS + SLACK)
        joined = pairs.join(a, F.col("one") == F.col("a_up")).join(b, F.col("two") == F.col("b_up")).where(meet)
        pairs = table(spark, joined.select(F.col("a_node").alias("one"), F.col("b_node").alias("two")), f"pairs{level}")
    return pairs


def _joined(axes: dict[int, np.ndarray], kind: type):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["side", "dim", "reps", "sizes", "raw"]).to_pylist(), key=lambda r: r["side"])
        first, last, same = rows[0], rows[-1], len(rows) == 1
        parts = [(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["raw"], kind).reshape(-1, r["dim"])) for r in (first, last)]
        counts, x, y = join_strips(*parts[0], *parts[1], axes[first["dim"]], same)
        reps = np.concatenate([np.frombuffer(r["reps"], np.int64) for r in rows])
        some = np.flatnonzero(counts)
        none = np.zeros(len(some), np.int64)
        return pa.table({"a": np.r_[reps[some], reps[x]], "b": pa.array(np.r_[none, reps[y]], mask=np.arange(len(some) + len(x)) < len(some)), "n": np.r_[counts[some], np.zeros(len(x), np.int64)]})

    return run


def near_dedup(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id and kept (vec_id = component_id)."""
    held = df.schema.fields[place(df, vector_col)].dataType
    single = isinstance(held, ArrayType) and isinstance(held.elementType, (FloatType, NullType))
    number, kind = ("float", np.float32) if single else ("double", np.float64)
    rows = narrowed(df, vec_id=(id_col, "long"), embedding=(vector_col, f"array<{number}>"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    # A class is named by its own number, as ids may repeat or be null; classes of equal least ids meet in the end.
    classes = table(spark, classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r.embedding), []).append(r.embedding)
    dims = [r.dim for r in classes.select(F.size("embedding").alias("dim")).distinct().collect()]
    axes = {d: principal_axes(np.array(by_dim[d])) if d in by_dim else np.eye(d)[:, :AXES] for d in dims}
    placed = classes.select(F.size("embedding").alias("dim"), F.col("class").alias("rep"), "size", "embedding").mapInArrow(_cells(axes), f"dim int, rep long, size long, embedding array<{number}>, cells array<int>")
    total = classes.count()
    n = max(1, round(total / RANGE_ROWS))
    order = ["dim", *[F.col("cells")[i] for i in range(AXES)], "rep"]
    placed = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # Strips are intervals of the whole sequence, whatever its partitions: the id holds the partition and the place in it.
    placed = table(spark, placed.select(F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"), "dim", "rep", "size", "embedding"), "placed")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"))
    height = max(1, min(-(-total // STRIPS), STRIP_BYTES // (np.dtype(kind).itemsize * max(dims, default=1))))
    numbered = placed.join(before, "part").withColumn("seq", F.col("before") + F.col("place")).withColumn("strip", F.floor(F.col("seq") / height).cast("long"))
    strips = table(spark, numbered.select("strip", "seq", "dim", "rep", "size", "embedding").groupBy("strip", "dim").applyInArrow(_strip(axes, sorted(dims), kind), _STRIP), "strips")
    pairs = table(spark, _pairs(spark, strips), "pairs")
    data = strips.select("node", "dim", "reps", "sizes", "raw")
    left = pairs.join(data, F.col("one") == F.col("node")).withColumn("side", F.lit(0))
    right = pairs.where("one <> two").join(data, F.col("two") == F.col("node")).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("one", "two", "side", "dim", "reps", "sizes", "raw")
    found = table(spark, both.groupBy("one", "two").applyInArrow(_joined(axes, kind), "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("others"))
    labels = components(spark, found.where("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    named = classes.join(labels, "class", "left").join(counts, "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = table(spark, named.select("embedding", "rep", "label", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links")), "named")
    least = table(spark, named.groupBy("label").agg(F.min("rep").alias("component_id")), "least")
    named = table(spark, named.join(least, "label").select("embedding", "n_links", "component_id"), "results")
    out = rows.join(named, "embedding", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

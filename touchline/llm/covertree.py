"""Exact cosine links between vectors of equal label, by dual traversal of cover trees.

The upper levels are one bounded tree's leaves: pivots from a sample, to which every vector is dealt with the distance
to its pivot. Cells of vectors become blocks of bounded size, and each block a cover tree in a task: nested nets with
halving radii, every node with the covering radius of what lies below it. Pairs of cells, then of nodes, are left out
when their centres are farther apart than both radii and the link distance; the rest is traversed down to vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.minhash import _groups
from touchline.session import cut_lineage

#: Vectors of a block; a task holds two blocks.
BLOCK = 512
#: Vectors sampled as pivots at most (all labels together), and the rows looked at for each.
PIVOTS, ROWS_PER_PIVOT = 2048, 4096
#: Pairs of points that are compared at once instead of going on below their nodes.
FEW = 1024
#: Added to bounds, so that rounding never prunes a link; links themselves are judged by the cosine alone.
SLACK = 1e-7


class Tree:
    """A cover tree over the rows of ``points`` (unit vectors), as arrays.

    Node i has the centre point[i], a covering radius[i] (largest distance to a point below it) and children
    first[i]..last[i]; a leaf (first = last = 0) is one point. Level by level, the radius of nets halves: each node's
    points are covered greedily by centres at least that far apart, of which its own centre is the first.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        centre, radius, first, last, depth, below = [0], [0.0], [0], [0], [2.0], [np.arange(len(points))]
        i = 0
        while i < len(centre):
            own, scale = below[i], depth[i]
            if len(own) > 1:
                far = _distance(points[own], points[centre[i]])
                radius[i] = float(far.max())
                # Skip levels at which the net would be this node's centre alone.
                while radius[i] <= scale / 2 and scale > 1e-9:
                    scale /= 2
                parts = self._net(own, centre[i], scale / 2) if scale > 1e-9 else [(p, np.array([p])) for p in own]
                first[i], last[i] = len(centre), len(centre) + len(parts)
                for c, members in parts:
                    centre.append(int(c))
                    radius.append(0.0)
                    first.append(0)
                    last.append(0)
                    depth.append(scale / 2)
                    below.append(members)
            i += 1
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.first, self.last, self.below = first, last, below

    def _net(self, own: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
        left, parts, c = own, [], centre
        while len(left):
            near = _distance(self.points[left], self.points[c]) <= radius
            near |= left == c
            parts.append((c, left[near]))
            left = left[~near]
            if len(left):
                c = int(left[0])
        return parts


def _distance(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (points @ centre)))


def links_between(one: Tree, two: Tree, w_one: np.ndarray, w_two: np.ndarray,
                  least: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weight of the partners (cosine >= ``least``) of each point of either tree, and links that connect the same points.

    With ``one is two`` the pairs of a point with itself do not count, and the second array stays zero. Of all links only
    as many as connect their points are returned.
    """
    same, reach = one is two, math.sqrt(2 - 2 * least) + SLACK
    n_one, n_two = np.zeros(len(one.points), np.int64), np.zeros(len(two.points), np.int64)
    parent = list(range(len(one.points) + (0 if same else len(two.points))))
    shift, spanning = 0 if same else len(one.points), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        if same and b < a:
            continue
        if not (one.last[a] or two.last[b]) or len(one.below[a]) * len(two.below[b]) <= FEW:
            # Two points, or few pairs of points below: the traversal ends with their cosines.
            rows, cols = one.below[a], two.below[b]
            hit = one.points[rows] @ two.points[cols].T >= least
            if same and a == b:
                hit &= rows[:, None] != cols[None, :]
            n_one[rows] += hit @ w_two[cols]
            if not same:
                n_two[cols] += w_one[rows] @ hit
            elif a != b:
                n_one[cols] += w_one[rows] @ hit
            for i in np.flatnonzero(hit.any(axis=1)):
                for j in np.flatnonzero(hit[i]):
                    x, y = root(int(rows[i])), root(int(cols[j]) + shift)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        spanning.append((int(rows[i]), int(cols[j])))
            continue
        left = range(one.first[a], one.last[a]) if one.last[a] else (a,)
        right = range(two.first[b], two.last[b]) if two.last[b] else (b,)
        left, right = np.array(left), np.array(right)
        apart = np.sqrt(np.maximum(
            0, 2 - 2 * (one.points[one.centre[left]] @ two.points[two.centre[right]].T)))
        open_ = apart <= one.radius[left][:, None] + two.radius[right][None, :] + reach
        if same and a == b:
            open_ &= left[:, None] <= right[None, :]
        i, j = np.nonzero(open_)
        stack += zip(left[i].tolist(), right[j].tolist(), strict=True)
    return n_one, n_two, spanning


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows as double-precision unit vectors (rows have equal lengths)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    points = flat.reshape(len(vectors), -1)
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def cosine_links(vectors: DataFrame, id: str, embedding: str, label: str, least: float = 0.98,
                 block: int = BLOCK) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id reachable, itself included), kept.

    Rows of equal, non-null label and equal dimension are linked if the cosine of their vectors, in double precision, is
    ``least`` or more. Null, empty or zero vectors and those with null or non-finite components link with nothing. Ids
    are integers and tell rows apart: rows that repeat an id are one node whose links are summed over distinct vectors; a
    null id links with nothing. Other columns are ignored; an empty table gives an empty one.

    Equal vectors of a label form one class whose copies are counted, not paired.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id].cast("long").alias("_id"), vectors[label].alias("_label"),
                          vectors[embedding].cast("array<double>").alias("_v"))
    sound = (
        F.col("_label").isNotNull() & F.col("_id").isNotNull() & (F.size("_v") > 0)
        & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("_v", lambda x: x != 0)
    )
    # -0.0 and 0.0 are one value; the class key is the vector as it is written.
    usable = rows.where(sound).withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0)))
    classes = cut_lineage(
        usable.distinct().groupBy("_label", "_v").agg(F.count("*").alias("_n"), F.min("_id").alias("rep")))
    total = classes.count()
    cells = _cells(spark, classes, total)
    blocks = _blocks(cells, block)
    pairs = _pairs(blocks, least)
    found = _traverse(blocks, pairs, least)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    same_class = cut_lineage(usable.distinct().join(classes, ["_label", "_v"]).select("_id", "rep", "_n"))
    comp = components(
        found.where("b is not null").select("a", "b")
        .union(same_class.where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b"))))
    linked = (
        same_class.join(counts, F.col("rep") == F.col("a"), "left")
        .groupBy("_id").agg(F.sum(F.col("_n") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    )
    return (
        rows.select("_id").join(linked, "_id", "left").join(comp, F.col("_id") == F.col("node"), "left")
        .select(
            F.col("_id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "_id").alias("component_id"),
            (F.coalesce("component", "_id").eqNullSafe(F.col("_id"))).alias("kept"))
    )


def _cells(spark, classes: DataFrame, total: int) -> DataFrame:
    """``classes`` with the pivot of the same label and dimension that is nearest, and the distance to it.

    Pivots are a sample of at most about ``PIVOTS`` rows by a hash of the id, so they fit any task. A label without a
    pivot (few rows: the sample takes one row in ``ROWS_PER_PIVOT``, or all labels are rare) is one cell of its own.
    """
    share = min(1.0 / ROWS_PER_PIVOT, PIVOTS / max(total, 1))
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(share * (1 << 30)))
    pivots: dict = {}
    for r in sample.select(F.col("_label").cast("string"), "_v", "rep").orderBy("rep").limit(PIVOTS).collect():
        v = np.array(r[1])
        v /= np.abs(v).max()
        pivots.setdefault((r[0], len(v)), []).append((r[2], v / np.sqrt(v @ v)))
    table = spark.sparkContext.broadcast(
        {k: (np.array([p for p, _ in v]), np.stack([x for _, x in v])) for k, v in pivots.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, v, rep, n = (batch.column(i) for i in range(4))
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            cell, far = np.full(len(rep), -1, np.int64), np.full(len(rep), 2.0)
            names = np.array(label.to_pylist(), object)
            for name in set(names):
                for size in set(sizes[names == name]):
                    at = np.flatnonzero((names == name) & (sizes == size))
                    if (key := (name, int(size))) in table.value:
                        ids, centres = table.value[key]
                        cosine = _unit(v.take(pa.array(at))) @ centres.T
                        best = cosine.argmax(axis=1)
                        cell[at] = ids[best]
                        far[at] = np.sqrt(np.maximum(0, 2 - 2 * cosine[np.arange(len(at)), best]))
            yield pa.RecordBatch.from_arrays(
                [label, pa.array(sizes, pa.int32()), pa.array(cell), pa.array(far), rep, n, v],
                ["label", "size", "cell", "far", "rep", "n", "v"])

    return cut_lineage(classes.select(F.col("_label").cast("string").alias("_label"), "_v", "rep", "_n").mapInArrow(
        run, "label string, size int, cell bigint, far double, rep bigint, n bigint, v array<double>"))


def _blocks(cells: DataFrame, block: int) -> DataFrame:
    """Vectors with the number of their block; a block is a share of a cell, of about ``block`` vectors."""
    sizes = cells.groupBy("label", "size", "cell").agg(F.count("*").alias("_n"))
    # Dealt by another key than the sums, so that adaptive execution can split a large cell.
    key = F.xxhash64("label", "size", "cell")
    parts = sizes.select(key.alias("_k"), F.ceil(F.col("_n") / block).alias("_parts"))
    number = F.xxhash64("label", "size", "cell", F.pmod(F.xxhash64("rep"), "_parts"))
    return cut_lineage(
        cells.withColumn("_k", key).join(parts, "_k")
        .select("label", "size", "cell", "far", number.alias("block"), "rep", "n", "v"))


def _pairs(blocks: DataFrame, least: float) -> DataFrame:
    """(x, y) with x <= y: blocks that may hold a link, by the distance of their pivots and their covering radii.

    Cells number at most ``PIVOTS`` plus one for each label and dimension, and only cells of one label meet.
    """
    cells = blocks.groupBy("label", "size", "cell").agg(F.max("far").alias("r"))
    pivots = blocks.where("cell = rep").select(
        "label", "size", "cell", F.col("v").alias("c")).dropDuplicates(["label", "size", "cell"])
    keys = ["label", "size"]
    one = cells.join(pivots, [*keys, "cell"], "left")
    two = one.select(*keys, F.col("cell").alias("cell2"), F.col("r").alias("r2"), F.col("c").alias("c2"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with("c", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (norm(F.col("c")) * norm(F.col("c2")))))
    reach = math.sqrt(2 - 2 * least) + SLACK
    near = one.join(two, keys).where("cell <= cell2").where(
        F.col("c").isNull() | F.col("c2").isNull() | (apart <= F.col("r") + F.col("r2") + reach))
    names = blocks.select(*keys, "cell", "block").distinct()
    other = names.select(*keys, F.col("cell").alias("cell2"), F.col("block").alias("y"))
    return (
        near.select(*keys, "cell", "cell2").join(names.withColumnRenamed("block", "x"), [*keys, "cell"])
        .join(other, [*keys, "cell2"]).where("cell < cell2 or x <= y")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    )


def _traverse(blocks: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(a, n, null): n rows of other classes are linked with class a; (a, null, b): links that connect classes."""
    pairs = cut_lineage(pairs)
    sides = pairs.select("x", "y", F.col("x").alias("block")).union(
        pairs.where("x <> y").select("x", "y", F.col("y").alias("block")))
    # Every block goes to each pair that it is in. Ids may repeat in different labels only as classes of their own.
    dealt = (
        blocks.select("block", "rep", "n", "v").join(sides, "block").select("x", "y", "block", "rep", "n", "v")
        .repartition("x", "y").sortWithinPartitions("x", "y", "block", "rep")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            x, own, rep, n = (group.column(i).to_numpy() for i in (0, 2, 3, 4))
            points = _unit(group.column(5))
            left, right = np.flatnonzero(own == x), np.flatnonzero(own != x)
            one = Tree(points[left])
            two = Tree(points[right]) if len(right) else one
            if not len(right):
                right = left
            n_one, n_two, spanning = links_between(one, two, n[left], n[right], least)
            ids, counts = rep[left], n_one
            if two is not one:
                ids, counts = np.concatenate([ids, rep[right]]), np.concatenate([n_one, n_two])
            some = counts > 0
            if some.any():
                a = ids[some].tolist() + [int(rep[left[i]]) for i, _ in spanning]
                b = [None] * int(some.sum()) + [int(rep[right[j]]) for _, j in spanning]
                c = counts[some].tolist() + [None] * len(spanning)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(b, pa.int64())], ["a", "n", "b"])

    return cut_lineage(dealt.mapInArrow(run, "a bigint, n bigint, b bigint"))

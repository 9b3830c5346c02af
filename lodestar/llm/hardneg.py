"""Hard-negative mining on vantage-point trees over norm-augmented vectors.

Rows are range-sorted by (length, label) and cut into groups of bounded size; each group becomes a vantage-point tree. A vector v gets
one more coordinate, sqrt(M^2 - |v|^2) with M the group's largest norm, and a query q is stretched to norm M and gets 0.
All then lie on one sphere, where q and v are arccos(q.v / (|q| M)) apart along the great circle: the nearest vectors have the highest
scores, and a window of scores is an annulus of distances. (Straight distances would do too, but bound worse.) A tree's node
keeps the distances that its members have from its vantage point, so a leaf's distance from a query is bounded from both sides. A
query visits leaves nearest first and skips those outside its annuli, or that cannot beat the k-th row it has;
scores themselves are exact integer products. Many queries walk a tree at once: each takes its next leaves, and the queries that
want a leaf meet it in one matrix product.

Anchors are the stated query set. They are packed in blocks, in the same order, so that a block has few labels: the search for positives
takes a block to the groups that hold one of its labels, the search for negatives to all but those of its one label. The best
of all groups are merged by score, then id. Blocks stream past one tree at a time, so memory does not grow with the anchors; blocks and
trees are dealt by (group, cell), where a cell has at most ``CELL`` blocks. The work is anchors times rows less what
trees cut off, which is little where dimensions are many.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take no part. Components saturate at
2^25 (entries beyond 131072), so that scores fit a long up to 8192 dimensions. Vectors of different length never meet.
A row with a null id is no anchor; among equal scores it comes last. Repeated rows each count; a row with the anchor's
id is not another row when positives are sought. An anchor without positives or without rows in its windows has no result rows;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.blocks import groups
from lodestar.llm.resident import trim
from lodestar.runtime import Scratch, arrow_rows, bound_arrow, small

SCALE, LARGEST = 256, 2**25
LEAF, QUERIES, CELL = 128, 512, 128
LEAST_GROUP, GROUP_BYTES = 4096, 16 << 20
MOST_TASKS = 100_000
NONE = -(1 << 62)


def _lists(col: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two integer matrices."""
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Tree:
    """A complete vantage-point tree: inner nodes in level order, then leaves; rows lie in the order of the leaves."""

    x: np.ndarray
    ids: np.ndarray
    null: np.ndarray
    labels: np.ndarray
    rank: np.ndarray  # place in the order of ids, null last
    square: float  # M^2
    points: np.ndarray  # vantage points, as places of rows
    ranges: np.ndarray  # node, side, (least, most) distance of the side's members from the point
    cuts: np.ndarray  # where leaves begin, and the end

    @property
    def leaves(self) -> int:
        return len(self.cuts) - 1


def grow(x: np.ndarray, ids: np.ndarray, null: np.ndarray, labels: np.ndarray) -> Tree:
    f = x.astype(np.float64)
    norms = (f * f).sum(axis=1)
    square = float(norms.max())
    lift = np.sqrt(np.maximum(square - norms, 0.0))
    depth = max(0, math.ceil(math.log2(len(x) / LEAF)))
    nodes = 2**depth - 1
    points, ranges = np.zeros(nodes, np.int64), np.zeros((nodes, 2, 2))
    away = lambda rows, p: np.arccos(np.clip((f[rows] @ f[p] + lift[rows] * lift[p]) / max(square, 1.0), -1.0, 1.0))
    at = [np.arange(len(x))]
    for node in range(nodes):
        rows = at[node]
        point = rows[away(rows, rows[0]).argmax()]  # a row at the edge tells the others apart best
        d = away(rows, point)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        points[node] = point
        for side, part in enumerate((order[:half], order[half:])):
            ranges[node, side] = d[part].min(), d[part].max()
            at.append(rows[part])
    rank = np.empty(len(x), np.int64)
    rank[np.lexsort((ids, null))] = np.arange(len(x))
    leaves = [rows[np.argsort(rank[rows])] for rows in at[nodes:]]  # in a leaf, rows lie by id
    order = np.concatenate(leaves)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    return Tree(x[order], ids[order], null[order], labels[order], rank[order], square, place[points], ranges, np.cumsum([0, *map(len, leaves)]))


def leaf_bounds(tree: Tree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a member of each leaf can have with each query."""
    nodes = len(tree.points)
    f = q.astype(np.float64)
    length = np.sqrt((f * f).sum(axis=1) * tree.square)[:, None]  # |q| M
    d = np.arccos(np.clip(f @ tree.x[tree.points].astype(np.float64).T / np.maximum(length, 1.0), -1.0, 1.0))
    near, far = np.zeros((len(q), 2 * nodes + 1)), np.full((len(q), 2 * nodes + 1), np.pi)
    for node in range(nodes):
        for side in (0, 1):
            least, most = tree.ranges[node, side]
            child, at = 2 * node + 1 + side, d[:, node]
            near[:, child] = np.maximum(near[:, node], np.maximum(at - most, least - at))
            # around the sphere both ways: the distance is at most the sum, and at most the rest of the circle
            far[:, child] = np.minimum(far[:, node], np.minimum(at + most, 2 * np.pi - at - least))
    slack = 1e-7 * length + 0.001  # for the rounding of small distances; scores are whole numbers
    return length * np.cos(far[:, nodes:]) - slack, length * np.cos(near[:, nodes:]) + slack


def _best(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest allowed scores along the last axis and their places, ties by place; ``NONE`` where there are fewer."""
    n = scores.shape[-1]
    k = min(k, n)
    if float(np.abs(scores).max(initial=0)) * n < 1 << 61:
        keys = np.where(ok, scores * n + (n - 1 - np.arange(n)), NONE)
        at = np.argpartition(keys, n - k, axis=-1)[..., n - k :]
    else:
        at = np.argsort(np.where(ok, -scores, -NONE), axis=-1, kind="stable")[..., :k]
    found = np.take_along_axis(np.broadcast_to(ok, at.shape[:-1] + (n,)), at, -1)
    return np.where(found, np.take_along_axis(np.broadcast_to(scores, at.shape[:-1] + (n,)), at, -1), NONE), at


def search(tree: Tree, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """For each query and window [low, high] (queries x windows) the first k rows of the same label and another id, or of another label.

    Scores (``NONE`` where there are fewer) and rows, best first, and how many leaves were visited.
    """
    m, w = low.shape
    least, most = leaf_bounds(tree, q)
    order = np.argsort(-most, axis=1, kind="stable")  # nearest first
    best, row = np.full((m, w, k), NONE), np.zeros((m, w, k), np.int64)
    begin, beam, visited = 0, 2, 0
    while begin < tree.leaves:
        leaf = order[:, begin : begin + beam]
        top, bottom = np.take_along_axis(most, leaf, 1)[:, :, None], np.take_along_axis(least, leaf, 1)[:, :, None]
        wanted = (np.minimum(top, high[:, None, :]) >= np.maximum(low, best[:, :, -1])[:, None, :]) & (bottom <= high[:, None, :])
        who, which = np.nonzero(wanted.any(axis=2))
        where = leaf[who, which]
        by = np.argsort(where, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(where[by])) + 1) if len(by) else []:
            at, a, b = who[part], tree.cuts[where[part[0]]], tree.cuts[where[part[0]] + 1]
            scores = _product(q[at], tree.x[a:b])
            match = labels[at][:, None] == tree.labels[a:b]
            ok = match & ((ids[at][:, None] != tree.ids[a:b]) | tree.null[a:b]) if same else ~match
            if not ok.any():
                continue
            inside = ok[:, None, :] & (scores[:, None, :] >= low[at][:, :, None]) & (scores[:, None, :] <= high[at][:, :, None])
            now, place = _best(scores[:, None, :], inside, k)
            all_best, all_row = np.concatenate([best[at], now], axis=2), np.concatenate([row[at], place + a], axis=2)
            first = np.lexsort((tree.rank[all_row], -all_best), axis=-1)[..., :k]
            best[at], row[at] = np.take_along_axis(all_best, first, 2), np.take_along_axis(all_row, first, 2)
        visited += len(by)
        begin, beam = begin + beam, beam * 2
    return best, row, visited


PACKED = "id long, dim int, low long, high long, data binary"


def _rows(table: DataFrame, vec_id: str, embedding: str, label: str, is_anchor: Column) -> DataFrame:
    """(uid, vec_id, label, anchor, dim, x) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    rows = table.select(F.monotonically_increasing_id().alias("uid"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), v.alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & (F.size("v") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(4)
            sizes = v.value_lengths().to_numpy()
            flat = v.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            good = np.logical_and.reduceat(np.isfinite(flat), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, bool)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.clip(np.nan_to_num(np.floor(SCALE * flat)), -LARGEST, LARGEST).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int32()), out], names=["uid", "vec_id", "label", "anchor", "dim", "x"]).filter(pa.array(good))

    return rows.mapInArrow(run, "uid long, vec_id long, label long, anchor boolean, dim int, x array<int>")


def _pack(rows: DataFrame, n: int, size: int, trees: bool) -> DataFrame:
    """Groups of up to about ``size`` rows that lie next to each other by length and label, as trees or as blocks of queries."""
    order = ["dim", "label", "uid"]
    dealt = rows.repartitionByRange(max(1, math.ceil(n / size)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for g in groups(batches, ("dim",)):
            most = min(size, max(256, GROUP_BYTES // (4 * g.column("dim")[0].as_py()))) if trees else size
            pieces = math.ceil(g.num_rows / most)
            for i in range(pieces):
                t = g.slice(g.num_rows * i // pieces, g.num_rows * (i + 1) // pieces - g.num_rows * i // pieces).combine_chunks()
                one = lambda c: t.column(c).combine_chunks()  # noqa: B023, E731
                null = one("vec_id").is_null().to_numpy(zero_copy_only=False)
                ids, labels, x = one("vec_id").fill_null(0).to_numpy(), one("label").to_numpy(), _lists(one("x"))
                held = grow(x, ids, null, labels) if trees else (one("uid").to_numpy(), ids, labels, x, one("asked").to_pylist() if "asked" in t.column_names else None)
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (number, t.column("dim")[0].as_py(), int(labels.min()), int(labels.max()), pickle.dumps(held))], names=["id", "dim", "low", "high", "data"]).cast(pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("data", pa.binary())]))
                number += 1
        trim()

    return dealt.mapInArrow(run, PACKED)


def _meet(blocks: DataFrame, trees: DataFrame, condition: Column, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(uid, asked, score, found): of every block's queries and windows the best k rows of every tree that the condition (b, t) leaves.

    Without ``asked`` scores of positives, there is one window with all scores.
    """
    meta = trees.select("id", "dim", "low", "high")
    n_trees, n_blocks = meta.count(), blocks.count()
    cells = max(1, math.ceil(n_blocks / CELL))
    meta = small(meta, n_trees, 64).alias("t")
    asks = blocks.alias("b").join(meta, (F.col("b.dim") == F.col("t.dim")) & condition)
    asks = asks.select(F.col("t.id").alias("tree"), F.pmod(F.xxhash64("b.id"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("kind"), F.col("b.id").alias("block"), F.col("b.data").alias("data"))
    offers = trees.select(F.col("id").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), "data")
    dealt = offers.unionByName(asks).repartition(min(MOST_TASKS, 2 * max(1, n_trees) * cells), "tree", "cell").sortWithinPartitions("tree", "cell", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree | None = None
        for batch in batches:
            for kind, data in zip(batch.column(2).to_pylist(), batch.column(4), strict=True):
                held = pickle.loads(data.as_buffer())
                if kind == 0:
                    tree = held
                    continue
                uid, ids, labels, x, asked = held
                if asked is None:
                    said = np.zeros((len(uid), 1), np.int64)
                    lows, highs = said + NONE + 1, said - NONE
                else:
                    width = max(map(len, asked))
                    said = np.array([a + [-1] * (width - len(a)) for a in asked], np.int64)  # a window of -1 is empty
                    lows, highs = -(-low * said // 100), high * said // 100
                best, row, _ = search(tree, x, ids, labels, lows, highs, k, same)
                q, slot, _ = at = np.nonzero(best > NONE)
                found = pa.array(tree.ids[row[at]], pa.int64(), mask=tree.null[row[at]])
                yield pa.RecordBatch.from_arrays([pa.array(uid[q]), pa.array(said[q, slot]), pa.array(best[at]), found], names=["uid", "asked", "score", "found"])
        trim()

    return dealt.mapInArrow(run, "uid long, asked long, score long, found long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("uid", "asked").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(table: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = 5, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors of ``table``.

    A negative's score is between ``low`` and ``high`` per cent of the positive's.
    """
    spark = table.sparkSession
    bound_arrow(spark)
    scratch = Scratch(spark, "hardneg")
    rows = scratch.write(_rows(table, vec_id, embedding, label, is_anchor), "rows")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
    size = max(LEAST_GROUP, math.isqrt(n * 1024))  # so that trees and blocks of queries grow alike
    anchors = rows.filter("anchor").drop("anchor")
    trees = scratch.write(_pack(rows, n, size, True), "trees")
    blocks = scratch.write(_pack(anchors, n_anchors, QUERIES, False), "blocks")
    b, t = (lambda c: F.col(f"b.{c}")), (lambda c: F.col(f"t.{c}"))
    with arrow_rows(spark, 4):  # a row is a tree or a block
        first = scratch.write(_meet(blocks, trees, (b("low") <= t("high")) & (t("low") <= b("high")), positives, True, low, high), "near")
    pos = scratch.write(_first(first, positives).select("uid", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = pos.filter("positive_score >= 0").groupBy("uid").agg(F.sort_array(F.collect_set("positive_score")).alias("asked"))  # at most ``positives`` scores an anchor
    asking = scratch.write(_pack(anchors.join(windows, "uid"), n_anchors, QUERIES, False), "asking")
    several = (t("low") != t("high")) | (b("low") != b("high")) | (t("low") != b("low"))
    with arrow_rows(spark, 4):
        found = scratch.write(_meet(asking, trees, several, k, False, low, high), "negatives")
    scratch.drop("near", "blocks", "asking", "trees")
    neg = _first(found, k).select("uid", F.col("asked").alias("positive_score"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pos.join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid").join(neg, ["uid", "positive_score"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    table = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(table, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
             list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS a, a.label = b.label AS same, b.vec_id AS b, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
      FROM e a JOIN e b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same) t WHERE n <= 5),
w AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, pos AS positive_id, CAST(rank AS INTEGER) AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM w WHERE rank <= 3
"""

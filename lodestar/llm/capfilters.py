"""Embedding near-duplicates by spherical-cap filters from random product codes.

A filter is a direction on the sphere; a vector is in its cap if their inner product exceeds a bound. Directions
come from a structured code: a seeded random rotation splits the space into two or more parts, each with a seeded set
of random unit vectors, and every combination of one vector from each part is a direction. A vector lists all
directions beyond the bound by *list decoding*: part by part, a choice is extended only by those vectors of the next
part with which the bound can still be reached, a prefix of the part's scores in falling order.

``plan`` chooses the bound from the number of vectors, so that a cap holds about ``CAP_SIZE`` of them however many there
are, and a number of directions at which a pair at the threshold meets about once; as that number grows, so does the
number of parts, so that no part has more than ``MAX_WORDS`` vectors. It then takes independent codes (tables) until
``RECALL`` of random pairs exactly at the threshold meet in some cap. Closer pairs meet more often. Where
``MAX_TABLES`` do not reach it (few dimensions: a score cannot pass sqrt(dim)), the bound is lowered until they do;
where the caps are then so wide that they cost more than all pairs, one cap holds everything (``EXACT``) and all
pairs are compared in blocks. No plan with less recall is returned. Vectors of a
cap are verified in blocks by exact cosine in double precision, so no link is below the threshold.

Equal vectors collapse first. Links count vectors; ``component_id`` is the smallest vec_id that links reach.

Scale: each vector goes to some tens of caps, whatever the input's size (lengths of vectors, of which there are
few, are planned one by one); hot caps are cut into blocks; pairs are never emitted (see ``blocks``).

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing;
vectors of different length do not link; null vec_ids take part, and a component's id is its smallest non-null
one; repeated rows are equal vectors. Other columns, ``label`` among them, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import BLOCK, in_blocks, link_groups
from lodestar.operators.graph import connected_components
from lodestar.runtime import Scratch, bound_arrow

THRESHOLD = 0.9
CAP_SIZE, RECALL = 256, 0.99
PROBES, MAX_TABLES, MAX_WORDS = 1000, 200, 128
LOWER, LEAST_BOUND, EARLY = 0.9, 0.1, 10
SEED = 20240607


def _tail(t: float) -> float:
    return 0.5 * math.erfc(t / math.sqrt(2))


def _both(t: float, rho: float) -> float:
    """P(X > t and Y > t) of standard normals with correlation rho."""
    x = np.linspace(t, t + 8, 4001)
    y = (t - rho * x) / math.sqrt(1 - rho * rho)
    f = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * np.array([_tail(v) for v in y])
    return float((f[1:] + f[:-1]).sum() / 2 * (x[1] - x[0]))


@dataclass(frozen=True)
class Plan:
    """``tables`` independent codes of ``words``**``parts`` directions each; a cap's bound in standard deviations of a score."""

    bound: float
    words: int
    parts: int
    tables: int

    @property
    def directions(self) -> int:
        return self.words**self.parts


#: One cap with every vector: all pairs are compared, in blocks.
EXACT = Plan(-math.inf, 1, 2, 1)


def plan(n: int, dim: int, threshold: float = THRESHOLD, cap_size: int = CAP_SIZE, recall: float = RECALL) -> Plan:
    """The cheapest plan of this family that finds random pairs at the threshold with the wanted recall, else ``EXACT``."""
    low, high = 0.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if n * _tail(mid) > cap_size else (low, mid)
    bound = low
    rng = np.random.default_rng(SEED)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    x, z = (unit(rng.standard_normal((PROBES, dim))) for _ in range(2))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = threshold * x + math.sqrt(1 - threshold * threshold) * unit(z) if dim > 1 else x
    first = True
    while bound > LEAST_BOUND or first:
        wanted = 1 / _both(bound, threshold)  # about one meeting a table
        parts = 2
        while parts < dim // 2 and wanted ** (1 / parts) > MAX_WORDS:
            parts += 1
        how, entries = _tables(x, y, Plan(bound, max(2, math.ceil(wanted ** (1 / parts))), parts, 0), recall)
        # vectors that one is compared with, over all its caps, as a share of all vectors
        if how is not None and (first or entries * entries / (how.tables * how.directions) < 1):
            return how
        bound, first = bound * LOWER, False
    return EXACT


def _tables(x: np.ndarray, y: np.ndarray, how: Plan, recall: float) -> tuple[Plan | None, float]:
    """The plan with as many tables as the recall of the probe pairs needs, if any, and the caps that a probe is in."""
    met, entries = np.zeros(len(x), bool), 0
    for table in range(MAX_TABLES):
        (ri, ci), (rj, cj) = (decode_table(v, how, table) for v in (x, y))
        both = np.intersect1d(ri * how.directions + ci, rj * how.directions + cj)
        met[both // how.directions] = True
        entries += len(ri)
        if met.mean() >= recall:
            return Plan(how.bound, how.words, how.parts, table + 1), entries / len(x)
        # even if all pairs met as easily as those so far, the tables would not do
        if table + 1 == EARLY and 1 - (1 - met.mean()) ** (MAX_TABLES / EARLY) < recall:
            break
    return None, entries / len(x)


@lru_cache(maxsize=256)
def codes(dim: int, words: int, parts: int, table: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A table's rotation and the code words of its parts, the same on every executor."""
    rng = np.random.default_rng([SEED, dim, words, table])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    ends = [round(dim * (k + 1) / parts) for k in range(parts)]
    return turn, [unit(rng.standard_normal((words, max(1, b - a)))) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def decode_table(vectors: np.ndarray, how: Plan, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all caps of one table that unit vectors are in, by row."""
    n, dim = vectors.shape
    turn, words = codes(dim, how.words, how.parts, table)
    x = vectors @ turn
    scale = math.sqrt(dim / how.parts)  # a score, the sum over the parts of <x_k, word_k>, has variance parts / dim over random code words
    scores, at = [], 0
    for w in words:
        part = x[:, at : at + w.shape[1]]
        scores.append(part @ w[:, : part.shape[1]].T * scale)
        at += w.shape[1]
    best = [s.max(axis=1) if n else np.zeros(0) for s in scores]
    row, direction, so_far = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for k, s in enumerate(scores):
        order = np.argsort(-s, axis=1, kind="stable")
        ranked = np.take_along_axis(s, order, axis=1)
        need = how.bound - so_far - sum((b[row] for b in best[k + 1 :]), np.zeros(len(row)))
        # how long a prefix of this part's words each choice so far can still take
        reach = _reach(ranked, row, need)
        which = np.repeat(np.arange(len(row)), reach)
        place = np.arange(len(which)) - np.repeat(np.cumsum(reach) - reach, reach)
        so_far = so_far[which] + ranked[row[which], place]
        direction = direction[which] * how.words + order[row[which], place]
        row = row[which]
    return row, direction


def _reach(ranked: np.ndarray, row: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each choice the number of its row's scores (falling) of at least ``need``, by bisection over all at once."""
    low, high = np.zeros(len(row), np.int64), np.full(len(row), ranked.shape[1])
    while (low < high).any():
        mid = (low + high) // 2
        ok = ranked[row, np.minimum(mid, ranked.shape[1] - 1)] >= need
        low, high = np.where((low < high) & ok, mid + 1, low), np.where((low < high) & ~ok, mid, high)
    return low


def list_decode(vectors: np.ndarray, how: Plan) -> list[np.ndarray]:
    """Numbers of the caps that each unit vector is in, over all tables."""
    rows, caps = [], []
    for table in range(how.tables):
        r, c = decode_table(vectors, how, table)
        rows.append(r)
        caps.append(c + table * how.directions)
    row, cap = np.concatenate(rows), np.concatenate(caps)
    cap = cap[np.argsort(row, kind="stable")]
    return np.split(cap, np.cumsum(np.bincount(row, minlength=len(vectors)))[:-1])


def _unit(table: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    col = table.column(name) if isinstance(table, pa.Table) else table.column(table.schema.get_field_index(name))
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    m = col.flatten().to_numpy().reshape(len(col), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _caps(vectors: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """(item, copies, dim, vector, caps) of the caps that each vector is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                lists = [c * 65536 + int(d) for c in list_decode(_unit(part), plans[int(d)])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int64()))], names=["item", "copies", "dim", "vector", "caps"])

    return vectors.select("item", "copies", "dim", "vector").mapInArrow(run, "item long, copies long, dim int, vector array<double>, caps array<long>")


def linked(g: pa.Table, threshold: float) -> np.ndarray:
    dims = g.column("dim").to_numpy()
    out = np.zeros((len(dims), len(dims)), bool)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        u = _unit(g.take(pa.array(at)))
        out[np.ix_(at, at)] = u @ u.T >= threshold
    return out


def near_vectors(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    spark = table.sparkSession
    bound_arrow(spark)
    scratch = Scratch(spark, "caps")
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    classes = rows.filter(usable).groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = scratch.write(classes.withColumn("item", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "classes")
    plans = {r["dim"]: plan(r["count"], r["dim"], threshold) for r in classes.groupBy("dim").count().collect()}
    capped = scratch.write(_caps(classes, plans), "capped")
    sizes = capped.select(F.explode("caps").alias("bucket")).groupBy("bucket").count().filter("count > 1")
    sizes = scratch.write(sizes.select("bucket", F.ceil(F.col("count") / BLOCK).cast("long").alias("n_blocks")), "sizes")
    members = capped.withColumn("bucket", F.explode("caps")).withColumnRenamed("caps", "buckets").join(sizes, "bucket")
    found = scratch.write(link_groups(in_blocks(members.select("bucket", "n_blocks", "item", "copies", "buckets", "dim", "vector")), lambda g: linked(g, threshold)), "links")
    scratch.drop("capped", "sizes")
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("item <> root"), "item", "root")
    per = classes.select("vector", "item", "copies", "least").join(links, "item", "left").join(groups.withColumnRenamed("node", "item"), "item", "left")
    per = per.withColumn("component", F.coalesce("component", "item"))
    head = per.groupBy("component").agg(F.min("least").alias("component_id"))
    per = per.join(head, "component").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    # the vector itself is the key of its copies; unusable rows find no partner
    out = rows.join(per, "vector", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP4_SQL = """
WITH RECURSIVE x AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
      AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.9),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, least(v.vec_id, coalesce(m.b, v.vec_id)) AS component_id, least(v.vec_id, coalesce(m.b, v.vec_id)) = v.vec_id AS kept
FROM embeddings v LEFT JOIN m ON m.a = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""

"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its runs of ``n`` words (lower case, ``\\w`` words), each as a 64-bit hash; fewer than
``n`` words make one run. Documents with equal sets form a class, and one stands for all.

Forest: each of ``TREES`` trees gives a class a path of ``DEPTH`` MinHash values. The paths of a tree, range-sorted,
are its prefix trie: a node is a stretch of the sorted paths that share a prefix, and one pass over the sorted rows
gives the size of every node of two classes or more. A pair at the threshold t shares a prefix of d values with
chance t**d, so a class that has looked at depth d_i in tree i has missed such a partner with chance
prod(1 - t**d_i). Every class starts at its full paths (deeper than needed, and free where it is alone) and shortens
its matched prefixes, the smallest node first, until that chance is at most 1 - ``RECALL``: crowded regions
are left at long prefixes in many trees, sparse ones are searched at short prefixes at little cost. A node that any
class wants is a bucket of all its classes; nodes inside a wanted node of their tree, and nodes with the same classes
as another, are dropped. Verification compares the sets of a bucket's classes exactly (``blocks``), so the links
are exact; a link can be missed only where all trees separate the pair (0.05 % of pairs at the threshold, fewer above).

Links count documents: copies link to each other and to every copy of a linked class. Groups are connected
components of links; ``class_id`` is the smallest doc_id of the group.

Scale: paths and hashes are shuffled, not texts; only classes that share a bucket are read again. The sorted tries
are dealt by range and node sizes added up from pieces, so a hot prefix never meets in one task; hot buckets are cut
into blocks, copies collapse before any pair is formed, pairs are never emitted.

Defined cases: a text without words (or null) links with nothing and is its own group; repeated rows are copies;
null doc_ids take part and their groups get the smallest non-null id, if any; of each group the row with the
smallest (doc_id, place in the input) is ``kept``; an empty table gives an empty one. Columns named ``nd_*`` are
replaced, ``ld_file`` and ``ld_row`` dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import BLOCK, in_blocks, link_groups
from lodestar.llm.linededup import with_place
from lodestar.llm.resident import resident, trim
from lodestar.llm.textcut import mix64, words
from lodestar.operators.graph import connected_components
from lodestar.runtime import Scratch, arrow_rows, bound_arrow, small

N, THRESHOLD = 5, 0.8
TREES, DEPTH, LEAST_DEPTH, RECALL = 16, 6, 3, 0.9995
#: Bits of one MinHash value in a path; values that agree by chance only make a bucket larger.
LEVEL_BITS = 10
#: Run hashes that one block of a bucket may hold.
BLOCK_RUNS = 1 << 21


def run_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word runs."""
    distinct, which, first = words([t.lower() for t in texts])
    name = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    h = name[which] if len(which) else np.zeros(0, np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for j in range(n):
            acc = acc * mult + h[j : j + len(acc)]
        acc = mix64(acc)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(acc[a : b - n + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = short * mult + x
                out.append(mix64(np.array([short])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def tree_paths(sets: list[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """For each set its path in each tree, the first value in the highest bits; zeros for empty sets."""
    rng = np.random.default_rng(20240501)
    odd = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, trees * depth, dtype=np.uint64)
    out = np.zeros((len(sets), trees), np.uint64)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some])[:-1]])
        with np.errstate(over="ignore"):
            for t in range(trees):
                path = np.zeros(len(some), np.uint64)
                for k in range(t * depth, (t + 1) * depth):
                    path = path << np.uint64(LEVEL_BITS) | mix64(np.minimum.reduceat(flat * odd[k] + add[k], starts)) >> np.uint64(64 - LEVEL_BITS)
                out[some, t] = path
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(ld_file, ld_row, doc_id, k1, k2, n_runs, paths): k1 and k2 name the set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("neardup", object)
        for batch in batches:
            sets = run_sets([t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], n)
            paths = tree_paths(sets).view(np.int64)
            keys = [divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64) if len(s) else None for s in sets]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("ld_file", "ld_row", "doc_id")]
            cols += [pa.array([k and _signed(k[i]) for k in keys], pa.int64()) for i in (0, 1)]
            cols += [pa.array([len(s) for s in sets], pa.int64()), pa.array(list(paths), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["ld_file", "ld_row", "doc_id", "k1", "k2", "n_runs", "paths"])
        trim()

    return docs.select("ld_file", "ld_row", "doc_id", "text").mapInArrow(run, "ld_file long, ld_row long, doc_id long, k1 long, k2 long, n_runs long, paths array<long>")


def _at(path, depth):
    """The prefix of that many values of a path (columns, or numpy and int)."""
    if isinstance(path, np.ndarray):
        return path >> (LEVEL_BITS * (DEPTH - depth))
    return F.call_function("shiftright", path, (LEVEL_BITS * (DEPTH - depth)).cast("int"))


def _trie_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (tree, path, item, n_runs) in order: pieces of nodes, and (depth 0, the path as prefix) their members.

    A piece at a batch's edge is kept whatever its size, for its node may go on elsewhere.
    """
    names = ["tree", "depth", "prefix", "n", "x", "y", "mass", "item"]
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, path, item, runs = (batch.column(i).to_numpy() for i in range(4))
        tag = mix64(item.astype(np.uint64)).view(np.int64)
        out = []
        for depth in range(LEAST_DEPTH, DEPTH + 1):
            key = _at(path, depth)
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])]))
            n = np.diff(np.append(start, len(key)))
            wide = n > 1
            wide[[0, -1]] = True
            if depth == LEAST_DEPTH:
                at = np.flatnonzero(np.repeat(wide, n))
                zero = np.zeros(len(at), np.int64)
                out.append((tree[at], zero, path[at], zero, zero, zero, zero, item[at]))
            sums = [np.add.reduceat(v, start)[wide] for v in (tag & 0x7FFFFFFF, runs)]
            first = start[wide]
            out.append((tree[first], np.full(len(first), depth), key[first], n[wide], np.bitwise_xor.reduceat(tag, start)[wide], *sums, np.zeros(len(first), np.int64)))
        cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _wanted(nodes_of: DataFrame, threshold: float) -> DataFrame:
    """(tree, depth, prefix) that some class wants, from its shared nodes (item, tree, depth, prefix, size)."""
    miss = [0.0, *(math.log1p(-min(threshold**d, 1 - 1e-12)) for d in range(1, DEPTH + 2))]
    table = F.array(*[F.lit(x) for x in miss])
    at = lambda d: F.get(table, d)
    step = F.struct("size", (-F.col("depth")).alias("up"), "tree", "prefix")
    per = nodes_of.groupBy("item").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    # a tree without a shared node is searched at the least depth for nothing; one whose deepest shared node is at d, at d + 1
    one = F.transform(F.filter("steps", lambda s: ~F.exists("steps", lambda o: (o["tree"] == s["tree"]) & (o["up"] < s["up"]))), lambda s: s["up"])
    deepest = per.withColumn("ends", one)
    base = F.aggregate("ends", F.lit(0.0), lambda acc, up: acc + at(F.least(F.lit(1) - up, F.lit(DEPTH)))) + (F.lit(TREES) - F.size("ends")) * at(F.lit(LEAST_DEPTH))
    start = F.struct(base.alias("miss"), F.array().cast("array<struct<tree:long,depth:long,prefix:long>>").alias("taken"))

    def take(acc, s):
        depth = -s["up"]
        node = F.struct(s["tree"].alias("tree"), depth.alias("depth"), s["prefix"].alias("prefix"))
        better = acc["miss"] + F.when(depth == DEPTH, F.lit(0.0)).otherwise(at(depth) - at(depth + 1))
        go = (depth == DEPTH) | (acc["miss"] > math.log(1 - RECALL))
        return F.struct(F.when(go, better).otherwise(acc["miss"]).alias("miss"), F.when(go, F.concat(acc["taken"], F.array(node))).otherwise(acc["taken"]).alias("taken"))

    chosen = deepest.select(F.explode(F.aggregate("steps", start, take, lambda acc: acc["taken"])).alias("w"))
    return chosen.select("w.tree", "w.depth", "w.prefix").distinct()


def forest_buckets(classes: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(item, memberships: array of bucket, n_blocks) of the classes (item, n_runs, paths) that share a bucket."""
    spark = classes.sparkSession
    rows = classes.select(F.posexplode("paths").alias("tree", "path"), "item", "n_runs").select(F.col("tree").cast("long"), "path", "item", "n_runs")
    tries = rows.repartitionByRange("tree", "path").sortWithinPartitions("tree", "path")
    with arrow_rows(spark, 10_000):  # rows are small
        trie = scratch.write(tries.mapInArrow(_trie_pass, "tree long, depth long, prefix long, n long, x long, y long, mass long, item long"), "trie")
    nodes = trie.filter("depth > 0").groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("size"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"), F.sum("mass").alias("mass")).filter("size > 1")
    nodes = scratch.write(nodes, "nodes")
    depths = F.array(*[F.lit(d).cast("long") for d in range(LEAST_DEPTH, DEPTH + 1)])
    members = trie.filter("depth = 0").select("item", "tree", F.col("prefix").alias("path"), F.explode(depths).alias("depth"))
    members = members.select("item", "tree", "depth", _at(F.col("path"), F.col("depth")).alias("prefix"))
    inside = scratch.write(members.join(nodes.select("tree", "depth", "prefix", "size"), ["tree", "depth", "prefix"]), "inside")
    wanted = scratch.write(_wanted(inside, threshold), "wanted_nodes")
    above = wanted.filter(F.col("depth") > LEAST_DEPTH).withColumn("up", F.explode(F.sequence(F.lit(LEAST_DEPTH).cast("long"), F.col("depth") - 1)))
    above = above.withColumn("over", F.call_function("shiftright", F.col("prefix"), (LEVEL_BITS * (F.col("depth") - F.col("up"))).cast("int")))
    roof = wanted.select("tree", F.col("depth").alias("up"), F.col("prefix").alias("over"))
    covered = above.join(roof, ["tree", "up", "over"], "left_semi").select("tree", "depth", "prefix").distinct()
    outer = nodes.join(wanted.join(covered, ["tree", "depth", "prefix"], "left_anti"), ["tree", "depth", "prefix"])
    # nodes with the same classes are kept once
    once = outer.groupBy("size", "x", "y", "mass").agg(F.min(F.struct("tree", "depth", "prefix")).alias("b")).select("size", "mass", "b.*")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("mass") / BLOCK_RUNS)).cast("long")
    once = scratch.write(once.select("tree", "depth", "prefix", blocks.alias("n_blocks")).withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    return inside.drop("size").join(once, ["tree", "depth", "prefix"]).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("bucket", "n_blocks"))).alias("memberships"))


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """(item, copies, memberships, text) -> (item, copies, memberships, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = run_sets([t or "" for t in batch.column(3).to_pylist()], n)
            runs = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], runs], names=["item", "copies", "memberships", "runs"])
        trim()

    return rows.mapInArrow(run, "item long, copies long, memberships array<struct<bucket:long,n_blocks:long>>, runs array<long>")


def linked(g: pa.Table, threshold: float = THRESHOLD) -> np.ndarray:
    """Which rows of a group have sets of at least that Jaccard similarity."""
    runs = g.column("runs").combine_chunks()
    n = runs.value_lengths().to_numpy().astype(np.int64)
    flat = runs.flatten().to_numpy()
    m = len(n)
    near = np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
    if m <= 12:
        sets, link = np.split(flat, np.cumsum(n)[:-1]), np.zeros((m, m), bool)
        for i in range(m):
            for j in range(i + 1, m):
                if near[i, j]:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    link[i, j] = link[j, i] = common / (n[i] + n[j] - common) >= threshold
        return link
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)
    use = count[col] > 1
    cols, col = np.unique(col[use], return_inverse=True)
    row = row[use]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((m, m), np.float32)
    for a in range(0, len(cols), 4096):
        lo, hi = np.searchsorted(col, [a, a + 4096])
        part = np.zeros((m, min(4096, len(cols) - a)), np.float32)
        part[row[lo:hi], col[lo:hi] - a] = 1
        common += part @ part.T
    common = common.astype(np.float64)  # exact: counts stay far below 2**24
    return near & (common / np.maximum(n[:, None] + n[None, :] - common, 1) >= threshold)


def near_duplicates(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, Scratch]:
    """Per row (ld_file, ld_row, doc_id, nd_n_links, nd_class_id, nd_kept); also ``docs`` with the places, and the scratch."""
    spark = docs.sparkSession
    bound_arrow(spark)
    scratch = Scratch(spark, "neardup")
    docs = with_place(docs.drop("ld_file", "ld_row"), scratch)
    thin = scratch.write(signatures(docs, n), "signatures")
    loc = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("ld_file"), F.col("ld_row"))
    named = thin.filter("k1 is not null")
    classes = named.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(loc).alias("least"), F.first("n_runs").alias("n_runs"), F.first("paths").alias("paths"))
    classes = scratch.write(classes.withColumn("item", F.monotonically_increasing_id()), "classes")

    inside = forest_buckets(classes.select("item", "n_runs", "paths"), scratch, threshold)
    wanted = inside.join(classes.select("item", "copies", F.col("least.ld_file").alias("ld_file"), F.col("least.ld_row").alias("ld_row")), "item")
    wanted = scratch.write(wanted, "wanted")
    stat = wanted.agg(F.count("*").alias("n"), F.sum(F.size("memberships")).alias("m")).first()
    rows = docs.select("ld_file", "ld_row", "text").join(small(wanted, stat.n * 96 + (stat.m or 0) * 32, 1), ["ld_file", "ld_row"])
    sets = _with_sets(rows.select("item", "copies", "memberships", "text"), n)
    members = sets.withColumn("at", F.explode("memberships")).select(
        F.col("at.bucket").alias("bucket"), F.col("at.n_blocks").alias("n_blocks"), "item", "copies", F.transform("memberships", lambda x: x["bucket"]).alias("buckets"), "runs"
    )
    found = scratch.write(link_groups(in_blocks(members), lambda g: linked(g, threshold)), "links")
    scratch.drop("wanted", "buckets", "trie", "nodes", "inside", "wanted_nodes")
    links = found.groupBy("item").agg(F.sum("links").alias("links"))
    groups = connected_components(found.filter("item <> root"), "item", "root")
    per_class = classes.select("k1", "k2", "item", "copies", "least").join(links, "item", "left").join(groups.withColumnRenamed("node", "item"), "item", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "item"))
    head = per_class.groupBy("component").agg(F.min("least").alias("head"))
    per_class = scratch.write(per_class.join(head, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("nd_n_links"), "head"), "per_class")
    out = thin.drop("paths", "n_runs").join(per_class, ["k1", "k2"], "left")
    alone = F.col("head").isNull()
    kept = alone | (F.col("head.ld_file") == F.col("ld_file")) & (F.col("head.ld_row") == F.col("ld_row"))
    result = out.select(
        "ld_file", "ld_row", "doc_id", F.coalesce("nd_n_links", F.lit(0)).alias("nd_n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("nd_class_id"), kept.alias("nd_kept"),
    )
    return result, docs, scratch


def keep_one_of_each(docs: DataFrame, *, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the rows that another document of their group stands for."""
    columns = [c for c in docs.columns if c not in ("ld_file", "ld_row")]
    result, placed, scratch = near_duplicates(docs, n=n, threshold=threshold)
    gone = scratch.write(result.filter(~F.col("nd_kept")).select("ld_file", "ld_row"), "gone")
    return placed.join(small(gone, gone.count(), 48), ["ld_file", "ld_row"], "left_anti").select(*columns)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    result, _, _ = near_duplicates(docs)
    return result.select("doc_id", F.col("nd_class_id").alias("class_id"), F.col("nd_n_links").alias("n_links"), F.col("nd_kept").alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(t, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 4))) AS i FROM w WHERE len(t) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= 0.8),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT d.doc_id, least(d.doc_id, coalesce(m.b, d.doc_id)) AS class_id, coalesce(k.n, 0) AS n_links, least(d.doc_id, coalesce(m.b, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN m ON m.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""

"""Removal of repeated line runs with a distributed suffix array over line ids.

The corpus is one sequence of line ids: documents in the order of doc_id (nulls last, then place in the input),
a gap after each. A *run* is a stretch of whole lines of one document with at least ``min_words`` words. A run is
deleted if the same run starts earlier in the sequence; maximal repeated runs are the unions of such runs.

1. Every line is hashed to 128 bits; only lines that occur twice can be in a repeated run, so others become
   gaps. The rest get ids by rank.
2. Prefix doubling: the rank of the 2^(k+1) lines at a place comes from the pair of ranks of the 2^k lines at it
   and 2^k further on. Distinct pairs, pre-aggregated, are range-sorted and numbered, so equal ranks are the
   suffix-array intervals whose longest common prefix reaches 2^k lines, in suffix order. A pair that occurs
   once is resolved and leaves; doubling stops at the longest window that is asked for.
3. A run of n lines is named by two overlapping 2^k ranks, k = floor(log2 n): its interval in the suffix array.
   Each place asks for the shortest run of ``min_words`` that starts there and the shortest that ends there; doubling
   stops at the longest of these, for longer common prefixes decide nothing: a run of a longest-common-prefix
   interval is the union of those that start and end inside it. Every later copy in an interval is deleted.
4. The deleted stretches of a document, as [start, end) intervals, are merged by a running maximum of their ends, so
   overlapping and long ones cost one row each, and the merged ones are its maximal repeated runs.

Scale: only 64-bit ids and places are shuffled, after pre-aggregation; no document or group of copies meets in
one task. The text is read twice and, while the table of deletions fits a checked broadcast, never shuffled.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; lines are split at
"\\n" and compared by two 64-bit hashes (n lines collide with chance n**2 / 2**129); runs below ``min_words`` words stay
however often they occur (short common lines such as licenses are not copies of a document); repeated rows are documents of their own, in input order, so a later copy loses all
its lines; a document may end up empty (the caller may drop it, see ``n_removed``). Columns named ``ld_*`` are
replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.mixing import n_words
from lodestar.runtime import Scratch, small

MIN_WORDS = 50


def with_place(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with (ld_file, ld_row), which name a stored row for good.

    File and row number come from the file scan itself, so they do not change when a lost executor alters how
    the scan is split. A frame that is not a plain scan is written to the shared folder first.
    """
    place = lambda df: df.select("*", F.xxhash64("_metadata.file_path").alias("ld_file"), F.col("_metadata.row_index").alias("ld_row"))
    try:
        return place(docs)
    except AnalysisException:
        return place(scratch.write(docs, "input"))


def _ranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys with order-preserving numbers."""
    return pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id())


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line of a segment the length of the shortest run of ``least`` words that starts, or ends, there (0: none)."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    end = np.searchsorted(total, total[:-1] + least, side="left")  # first prefix that reaches the sum
    forward = np.where(end <= n, end - np.arange(n), 0)
    begin = np.searchsorted(total, total[1:] - least, side="right") - 1
    backward = np.where(total[1:] >= least, np.arange(1, n + 1) - begin, 0)
    return forward, backward


def _number(rows: DataFrame, least: int) -> DataFrame:
    """Places g in the sequence (adjacent lines differ by 1, others by more) with the windows that start or end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table, base: int) -> tuple[pa.RecordBatch, int]:
            f, r, pos, words = (table.column(c).to_numpy() for c in ("ld_file", "ld_row", "pos", "nw"))
            n = len(pos)
            cut = np.ones(n, bool)
            cut[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1]) | (pos[1:] != pos[:-1] + 1)
            g = base + np.arange(n) + np.cumsum(cut)
            at = np.append(np.flatnonzero(cut), n)
            fwd, bwd = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                fwd[a:b], bwd[a:b] = windows(words[a:b], least)
            out = pa.RecordBatch.from_arrays([pa.array(f), pa.array(r), pa.array(pos), pa.array(g), table.column("id").combine_chunks(), pa.array(fwd), pa.array(bwd)], names=["ld_file", "ld_row", "pos", "g", "id", "fwd", "bwd"])
            return out, int(g[-1]) + 1

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < 4096:
                continue
            f, r = table.column("ld_file").to_numpy(), table.column("ld_row").to_numpy()
            last = np.flatnonzero((f != f[-1]) | (r != r[-1]))
            if len(last):  # the last document may go on in the next batch
                done = int(last[-1]) + 1
                out, base = flush(table.slice(0, done).combine_chunks(), base)
                yield out
                held = table.slice(done).combine_chunks().to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield flush(table.combine_chunks(), base)[0]

    return rows.mapInArrow(run, "ld_file long, ld_row long, pos long, g long, id long, fwd long, bwd long")


def repeated_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete, (ld_file, ld_row, pos), from documents that have ``with_place``."""
    cut = docs.select("doc_id", "ld_file", "ld_row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = scratch.write(
        cut.select("doc_id", "ld_file", "ld_row", F.col("pos").cast("long"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), n_words(F.col("line")).alias("nw")),
        "lines",
    )
    shared = lines.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    ids = scratch.write(_ranked(shared, ["h1", "h2"], "id"), "ids")
    kept = lines.join(ids, ["h1", "h2"])
    order = [F.col("doc_id").isNull(), "doc_id", "ld_file", "ld_row"]
    placed = kept.repartitionByRange(*order).sortWithinPartitions(*order, "pos").select("ld_file", "ld_row", "pos", "nw", "id")
    places = scratch.write(_number(placed, min_words), "places")
    scratch.drop("lines", "ids")

    asked = places.filter("fwd > 0").select(F.col("g").alias("s"), F.col("fwd").alias("n")).union(places.filter("bwd > 0").select((F.col("g") - F.col("bwd") + 1).alias("s"), F.col("bwd").alias("n"))).distinct()
    asked = scratch.write(asked.withColumn("k", F.floor(F.log2(F.col("n").cast("double"))).cast("int")), "asked")
    longest = asked.agg(F.max("n")).first()[0] or 0
    level = places.select("g", F.col("id").alias("rank"))
    levels = level.withColumn("k", F.lit(0))
    for k in range(1, int(longest).bit_length()):
        half = 1 << (k - 1)
        pairs = level.withColumnRenamed("rank", "a").join(level.select((F.col("g") - half).alias("g"), F.col("rank").alias("b")), "g")
        distinct = pairs.groupBy("a", "b").count().filter("count > 1").select("a", "b")
        names = scratch.write(_ranked(distinct, ["a", "b"], "rank"), f"names{k}")
        level = scratch.write(pairs.join(names, ["a", "b"]).select("g", "rank"), f"level{k}")
        scratch.drop(f"names{k}")
        levels = levels.union(level.withColumn("k", F.lit(k)))
    first = levels.select("k", F.col("g").alias("s"), F.col("rank").alias("ra"))
    second = levels.select("k", F.col("g").alias("t"), F.col("rank").alias("rb"))
    runs = asked.join(first, ["k", "s"]).withColumn("t", F.expr("s + n - shiftleft(1L, k)")).join(second, ["k", "t"]).select("s", "n", "ra", "rb")
    runs = scratch.write(runs, "runs")
    intervals = runs.groupBy("n", "ra", "rb").agg(F.min("s").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    intervals = scratch.write(intervals, "intervals")  # so that the join below can split the rows of a hot interval
    later = runs.join(intervals, ["n", "ra", "rb"]).filter("s > first").groupBy("s").agg(F.max("n").alias("n"))
    # merged by the running maximum of the ends of the intervals so far; places of a document are consecutive but for gaps, which no run crosses
    begun = places.join(later, places["g"] == later["s"], "left").select("ld_file", "ld_row", "pos", "g", (F.col("s") + F.col("n")).alias("end"))
    upto = F.max("end").over(W.partitionBy("ld_file", "ld_row").orderBy("g").rowsBetween(W.unboundedPreceding, 0))
    return begun.withColumn("upto", upto).filter("upto > g").select("ld_file", "ld_row", "pos")


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text less the later copies of repeated runs, and ld_n_lines, ld_n_removed, ld_removed.

    ``ld_removed`` lists the deleted stretches as first-last line numbers of the input text, from 0.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = with_place(docs.drop("ld_n_lines", "ld_n_removed", "ld_removed", "ld_file", "ld_row"), scratch)
    gone = repeated_lines(docs.select("doc_id", "text", "ld_file", "ld_row"), scratch, min_words)
    island = F.col("pos") - F.row_number().over(W.partitionBy("ld_file", "ld_row").orderBy("pos"))
    spans = gone.withColumn("i", island).groupBy("ld_file", "ld_row", "i").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    cuts = spans.groupBy("ld_file", "ld_row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ld_cuts"))
    cuts = scratch.write(cuts, "cuts")
    size = cuts.agg(F.count("*").alias("n"), F.sum(F.size("ld_cuts")).alias("m")).first()
    out = docs.join(small(cuts, size.n * 64 + (size.m or 0) * 32, 1), ["ld_file", "ld_row"], "left")
    lines, cut = F.split("text", "\n", -1), F.col("ld_cuts")
    n = F.size(cut)
    keep = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.slice(
                lines,
                (F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["b"] + 1) + 1).cast("int"),
                (F.when(i == n, F.size(lines)).otherwise(F.get(cut, i)["a"]) - F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["b"] + 1)).cast("int"),
            ),
        )
    )
    removed = F.aggregate(cut, F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"] + 1)
    out = out.withColumn("ld_n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long"))
    out = out.withColumn("ld_n_removed", F.coalesce(removed, F.lit(0)))
    out = out.withColumn("ld_removed", F.coalesce(F.array_join(F.transform(cut, lambda x: F.concat_ws("-", x["a"].cast("string"), x["b"].cast("string"))), ","), F.lit("")))
    out = out.withColumn("text", F.when(cut.isNotNull(), F.array_join(keep, "\n")).otherwise(F.col("text")))
    return out.drop("ld_file", "ld_row", "ld_cuts")


def drop_emptied(docs: DataFrame) -> DataFrame:
    """Without the documents of which every line was a later copy."""
    return docs.filter("ld_n_removed = 0 or ld_n_removed < ld_n_lines")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_removed").alias("n_removed"), F.col("ld_removed").alias("removed"), "text")


OP10_SQL = r"""
WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents),
w AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM cut),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM w),
u AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 GROUP BY 1, 2
      UNION SELECT a.doc_id, max(a.i) AS a, b.i AS b FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - a.c + a.n >= 50 GROUP BY 1, 3),
k AS (SELECT u.doc_id, u.a, u.b, string_agg(p.line, chr(10) ORDER BY p.i) AS run FROM u JOIN p ON p.doc_id = u.doc_id AND p.i BETWEEN u.a AND u.b GROUP BY 1, 2, 3),
later AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS r FROM k) x WHERE r > 1),
g AS (SELECT DISTINCT p.doc_id, p.i FROM later l JOIN p ON p.doc_id = l.doc_id AND p.i BETWEEN l.a AND l.b),
isl AS (SELECT doc_id, min(i) - 1 AS a, max(i) - 1 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS z FROM g) y GROUP BY doc_id, z),
rem AS (SELECT doc_id, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ',' ORDER BY a) AS removed, CAST(sum(b - a + 1) AS BIGINT) AS n FROM isl GROUP BY 1),
txt AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.i) AS text FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(rem.n, 0) AS n_removed, coalesce(rem.removed, '') AS removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(txt.text, '') END AS text
FROM documents d LEFT JOIN rem USING (doc_id) LEFT JOIN txt USING (doc_id)
"""

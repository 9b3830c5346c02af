"""Ordered folds in waves of blocks: a sequential greedy fold at scale, without a component in one task.

A greedy fold takes rows in order; each goes into a survivor of earlier rows or becomes one, and a survivor changes with what it takes in. A row
depends only on earlier rows of its component (of linked rows), so components are independent and, inside one, a block of
consecutive rows can be decided as soon as the blocks before it are. Components of up to ``BLOCK`` rows are packed into shared blocks, of
``BLOCK`` rows at most, and decided at once. A larger one is cut into blocks of consecutive rows; wave k decides the k-th block of every such component at the same
time. From wave to wave goes only a table of survivors: those whose keys a later block will still ask for. So a task holds one block,
what it asks for, and the survivors that answer; the number of waves is the largest component's rows over ``BLOCK``; rows that one wave
decides are not read again. What a block asks for is held as arrays, a few bytes for each ask, or not at all where ``decide`` finds out by itself which
survivors a row is like: linked rows can ask for a multiple of their number. Every wave is a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.graph import connected_components
from lodestar.operators.ranking import numbered
from lodestar.runtime import Scratch, small, spread

#: Rows that one call decides.
BLOCK = 20_000


def with_component(rows: DataFrame, edges: DataFrame, node: str = "idx") -> DataFrame:
    """``rows`` with comp: the smallest node linked to theirs by edges (a, b). Nodes must be unique over all groups."""
    comps = connected_components(edges, "a", "b").withColumnRenamed("node", node).withColumnRenamed("component", "comp")
    return rows.join(comps, node, "left").withColumn("comp", F.coalesce("comp", node))


class Asks(dict):
    """What a block asks for: by who, an array for each column of the asks."""

    def of(self, who: int) -> Iterator[tuple]:
        """(key, ...) of each ask."""
        return zip(*(c.tolist() for c in self.get(who, ())), strict=True)

    def add(self, key: int) -> None:
        """A survivor speaks under ``key`` from now on; asks that are given need not know."""

    def drop(self, key: int) -> None:
        """No survivor speaks under ``key`` any more."""


def _packed(sizes: DataFrame) -> DataFrame:
    """(comp, block) of components (comp, count) of up to ``BLOCK`` rows: as many of about one size as surely fit into a block."""
    classed = sizes.withColumn("k", F.ceil(F.log2("count")).cast("int"))
    fit = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.pow(F.lit(2), F.col("k"))))
    return numbered(classed, "k", ["comp"]).select("comp", (F.col("k") * F.lit(1 << 40) + F.floor((F.col("n") - 1) / fit)).alias("block"))


def _blocked(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with wave and block, and the number of waves."""
    sizes = scratch.write(rows.groupBy("comp").count(), "sizes")
    large = sizes.filter(F.col("count") > BLOCK).select("comp", F.lit(True).alias("large"))
    n_large, n_comps = large.count(), sizes.count()
    packed = small(scratch.write(_packed(sizes.filter(F.col("count") <= BLOCK)), "packed"), n_comps, 32)
    if not n_large:
        return scratch.write(rows.join(packed, "comp").withColumn("wave", F.lit(0)), "blocked"), 1
    marked = rows.join(small(large, n_large, 32), "comp", "left")
    rest = marked.filter("large is null").drop("large").join(packed, "comp").withColumn("wave", F.lit(0))
    cut = numbered(marked.filter("large").drop("large"), "comp", ["idx"]).withColumn("wave", F.floor((F.col("n") - 1) / BLOCK).cast("int")).drop("n")
    cut = cut.withColumn("block", -1 - F.col("comp"))
    blocked = scratch.write(rest.unionByName(cut), "blocked")
    return blocked, blocked.agg(F.max("wave")).first()[0] + 1


def fold(
    rows: DataFrame, asks: DataFrame, decide: Callable[[list[dict], Asks, list[dict]], tuple[list[dict], list[dict]]], decision: str, survivor: str, told: bool = True,
) -> DataFrame:
    """The decisions (columns ``decision``) of a fold over ``rows`` (comp, idx, who, ...), in the order of idx.

    ``asks`` (who, key, ...) says under which keys a row's kind ``who`` looks for survivors. ``decide`` gets a block's rows in order, asks by who,
    and the survivors of earlier blocks (columns ``survivor``: sid, which tells them apart in a component, keys, ...; with comp) that have
    one of these keys; it gives decisions, and the survivors that are new or changed. Without ``told`` it gets no asks; they only say which survivors it gets.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "waves")
    blocked, waves = _blocked(rows, scratch)
    asking = blocked.select("wave", "block", "comp", "who")
    wanted = (asking if told else asking.filter("wave > 0")).distinct().join(asks, "who")
    wanted = scratch.write(wanted if told else wanted.select("wave", "block", "comp", "key").distinct(), "wanted") if told or waves > 1 else None
    said, kept = T.StructType.fromDDL(decision), T.StructType.fromDDL("comp long, " + survivor)
    asked = [f for f in asks.schema if f.name != "who"] if told else []
    out_type = T.StructType([T.StructField("said", said), T.StructField("kept", kept)])
    last = scratch.write(wanted.groupBy("comp", "key").agg(F.max("wave").alias("until")), "last") if waves > 1 else None

    def run(block: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
        by, hosts = Asks(), []
        for who, host, *cols in zip(context["who"], context["host"], *(context[f.name] for f in asked), strict=True) if len(context) else ():
            if host is not None:
                hosts.append(host)
            else:
                by[who] = [np.asarray(c) for c in cols]
        if not len(block):
            return pd.DataFrame({"said": [], "kept": []})
        decisions, changed = decide(block.sort_values("idx").to_dict("records"), by, hosts)
        return pd.DataFrame({"said": decisions + [None] * len(changed), "kept": [None] * len(decisions) + changed})

    state, done = None, []
    for wave in range(waves):
        parts = []
        if told:
            each = wanted.filter(F.col("wave") == wave).dropDuplicates(["block", "who", "key"])
            grouped = each.groupBy("block", "who").agg(F.collect_list(F.struct(*[f.name for f in asked])).alias("x"))
            parts.append(grouped.select("block", "who", F.lit(None).cast(kept).alias("host"), *[F.col(f"x.{f.name}").alias(f.name) for f in asked]))
        if state is not None:
            now = wanted.filter(F.col("wave") == wave).select("block", "comp", "key").distinct()
            held = state.withColumn("key", F.explode("keys")).join(now, ["comp", "key"]).dropDuplicates(["block", "comp", "sid"])
            none = [F.lit(None).cast(T.ArrayType(f.dataType)).alias(f.name) for f in asked]
            parts.append(held.select("block", F.lit(0).cast("long").alias("who"), F.struct(*[f.name for f in kept]).alias("host"), *none))
        context = parts[0] if parts else blocked.select("block", F.lit(0).cast("long").alias("who"), F.lit(None).cast(kept).alias("host")).limit(0)
        for more in parts[1:]:
            context = context.unionByName(more)
        here = blocked.filter(F.col("wave") == wave)
        made = scratch.write(spread(here, "block").groupBy("block").cogroup(spread(context, "block").groupBy("block")).applyInPandas(run, out_type), f"wave{wave}")
        done.append(made.filter("said is not null").select("said.*"))
        if wave + 1 < waves:
            fresh = made.filter("kept is not null").select("kept.*")
            every = fresh if state is None else state.join(fresh.select("comp", "sid"), ["comp", "sid"], "left_anti").unionByName(fresh)
            still = every.select("comp", "sid", F.explode("keys").alias("key")).join(last.filter(F.col("until") > wave), ["comp", "key"]).select("comp", "sid").distinct()
            state = scratch.write(every.join(still, ["comp", "sid"], "left_semi"), f"state{wave}")
            scratch.drop(f"state{wave - 1}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out

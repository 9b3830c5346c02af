"""Evaluation corpora: gold requirements, splits and baselines as relations, with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx

GOLD = (
    "domain string, requirements array<struct<id:string,statement:string,rtype:string,nfr_category:string,feature:string,difficulty:array<string>,"
    "implicit:boolean,duplicate_of:string,conflicts_with:array<string>,source:array<struct<doc_id:string,quote:string>>>>"
)
BASELINE = "recall double, minutes double, reviewer string, notes string, pending boolean"


def requirements(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``folder``/gold.json with their domain."""
    return spark.read.schema(GOLD).json(f"{folder}/gold.json", multiLine=True).select("domain", F.explode("requirements").alias("r")).select("domain", "r.*")


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """(split, id) of ``folder``/splits.json."""
    raw = spark.read.schema("dev array<string>, test array<string>").json(f"{folder}/splits.json", multiLine=True)
    one = lambda name: raw.select(F.lit(name).alias("split"), F.explode(name).alias("id"))
    return one("dev").unionByName(one("test"))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The human baseline; without a ``pending`` it is not pending."""
    return spark.read.schema(BASELINE).json(f"{folder}/human_baseline.json", multiLine=True).withColumn("pending", F.coalesce("pending", F.lit(False)))


def split_faults(gold: DataFrame, split: DataFrame) -> DataFrame:
    """(id, fault) of ids in several splits (``shared``), in none (``missing``) or without a gold row (``unknown``); none if the splits partition the gold rows."""
    used = split.groupBy("id").agg(F.count_distinct("split").alias("n"))
    rows = gold.select("id", F.lit(True).alias("known")).distinct().join(used, "id", "full")
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "shared")
    return rows.select("id", fault.alias("fault")).filter("fault is not null")


def tag_index(gold: DataFrame) -> DataFrame:
    """(tag, ids): sorted ids of the rows that carry each difficulty tag."""
    return gold.select("id", F.explode("difficulty").alias("tag")).groupBy("tag").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def untraceable(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, doc_id, reason) of rows without a source, of an unknown document, or of a quote that is not verbatim in it."""
    bare = gold.filter(F.coalesce(F.size("source"), F.lit(0)) <= 0).select("id", F.lit(None).cast("string").alias("doc_id"), F.lit("no source spans").alias("reason"))
    cited = gold.select("id", F.explode("source").alias("s")).select("id", "s.*").join(docs.select("doc_id", "text", F.lit(True).alias("known")), "doc_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown document").when(~F.coalesce(F.contains(tx.normalize(F.col("text")), tx.normalize(F.col("quote"))), F.lit(False)), "quote not found verbatim")
    return bare.unionByName(cited.select("id", "doc_id", reason.alias("reason")).filter("reason is not null"))


def dangling(gold: DataFrame) -> DataFrame:
    """(id, relation, target) of duplicates and conflicts that name no gold row."""
    links = gold.filter("duplicate_of <> ''").select("id", F.lit("duplicate_of").alias("relation"), F.col("duplicate_of").alias("target"))
    links = links.unionByName(gold.select("id", F.lit("conflicts_with").alias("relation"), F.explode("conflicts_with").alias("target")))
    return links.join(gold.select(F.col("id").alias("target")).distinct(), "target", "left_anti").select("id", "relation", "target")

"""Table store on Parquet, partitioned by project: upsert, replace, append, cascade."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders over which a project's documents are dealt.
BUCKETS = 64


class Store:
    """Tables under one folder. A write replaces whole project partitions, so readers never see half a project."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _replace(self, df: DataFrame, table: str, by: tuple[str, ...] = ("project_id",)) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(table))

    def append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").partitionBy("project_id").parquet(self.path(table))

    def upsert(self, rows: DataFrame, table: str, key: str = "id") -> None:
        """Rows replace those of equal key; a key may not move to another project. Within ``rows`` the last ``seq`` counts."""
        if "seq" in rows.columns:
            rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("seq")))).filter("_n = 1").drop("_n", "seq")
        old = self.read(table)
        if old is not None:
            moved = rows.select(key, "project_id").join(old.select(key, F.col("project_id").cast("string").alias("was")), key).filter("project_id <> was")
            if moved.limit(1).count():
                raise ValueError(f"a {key} belongs to another project")
            touched = rows.select("project_id").distinct()
            kept = old.withColumn("project_id", F.col("project_id").cast("string")).join(touched, "project_id", "left_semi").join(rows.select(key), key, "left_anti")
            from lodestar.runtime import Scratch

            rows = Scratch(self.spark, "upsert").write(kept.unionByName(rows, allowMissingColumns=True), "rows")
        self._replace(rows, table)

    def replace_docs(self, chunks: DataFrame, table: str = "chunks", docs: DataFrame | None = None) -> None:
        """Chunks replace those of the same (project_id, doc_id); ``docs`` names documents that may have none any more.

        A project's documents are dealt to ``BUCKETS`` folders by hash, and only the buckets that are touched are rewritten.
        """
        from lodestar.runtime import Scratch

        keys = ["project_id", "doc_id"]
        bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BUCKETS)).cast("int")
        new, scratch = chunks.withColumn("bucket", bucket), Scratch(self.spark, "replace")
        gone = scratch.write((chunks if docs is None else docs).select(*keys).distinct().withColumn("bucket", bucket), "gone")
        old = self.read(table)
        if old is not None:
            old = old.withColumn("project_id", F.col("project_id").cast(chunks.schema["project_id"].dataType))
            kept = old.join(gone.select("project_id", "bucket").distinct(), ["project_id", "bucket"], "left_semi").join(gone.select(*keys), keys, "left_anti")
            new = scratch.write(kept.unionByName(new, allowMissingColumns=True), "rows")
            emptied = gone.select("project_id", "bucket").distinct().join(new.select("project_id", "bucket").distinct(), ["project_id", "bucket"], "left_anti")
            for r in emptied.collect():  # at most the buckets of the projects that this write touches
                from lodestar.runtime import delete_path

                delete_path(self.spark, f"{self.path(table)}/project_id={r.project_id}/bucket={r.bucket}")
        self._replace(new, table, ("project_id", "bucket"))

    def delete_project(self, project: str, *tables: str) -> None:
        from lodestar.runtime import delete_path

        for t in tables:
            delete_path(self.spark, f"{self.path(t)}/project_id={project}")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent: what a cascade removes, or a referential check reports."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")

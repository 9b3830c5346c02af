"""Seed diagrams of a project's approved requirements, as Mermaid text: use cases by actor, and candidate entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import classify as cl
from lodestar.functions import text as tx
from lodestar.operators.reporting import approved

#: Caps that are features: a seed is for a start.
USE_CASES, ENTITIES, NAME = 20, 15, 40
NOTE = "%% Draft seed model, derived from the approved requirements; to be confirmed."


def _features(reqs: DataFrame, cap: int) -> DataFrame:
    """(project_id, features): a project's functional features in the order of their first id; every project with something approved has a row."""
    rows = approved(reqs)
    each = rows.filter("rtype = 'functional'").groupBy("project_id", cl.canonical_feature(F.col("feature")).alias("f")).agg(F.min("id").alias("first"))
    listed = each.groupBy("project_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("first", "f"))), 1, cap), lambda x: x["f"]).alias("features"))
    return rows.select("project_id").distinct().join(listed, "project_id", "left").withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


def _text(*lines: Column) -> Column:
    return F.array_join(F.concat(*lines), "\n")


def _lines(*lines: str) -> Column:
    return F.array(*[F.lit(x) for x in lines])


def entity_diagram(reqs: DataFrame) -> DataFrame:
    """(project_id, text): an entity for each feature, managed by a user."""
    names = F.array_distinct(F.transform("features", lambda f: F.left(F.upper(tx.pascal(f)), F.lit(NAME))))
    rows = _features(reqs, ENTITIES).withColumn("names", names)
    links = F.transform("names", lambda e: F.concat(F.lit("  USER ||--o{ "), e, F.lit(" : manages")))
    bodies = F.flatten(F.transform("names", lambda e: F.array(F.concat(F.lit("  "), e, F.lit(" {")), F.lit("    string id"), F.lit("    string status"), F.lit("  }"))))
    head = _lines("erDiagram", f"  {NOTE}")
    some = _text(head, links, _lines("  USER {", "    string id", "    string name", "  }"), bodies)
    return rows.select("project_id", F.when(F.size("names") > 0, some).otherwise(_text(head, _lines("  USER {", "    string id", "  }"))).alias("text"))


def use_case_diagram(reqs: DataFrame, actors: DataFrame) -> DataFrame:
    """(project_id, text): every actor (project_id, rank, name) with every feature; without actors a user."""
    who = actors.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("actors"))
    rows = _features(reqs, USE_CASES).join(who, "project_id", "left").withColumn("actors", F.coalesce("actors", _lines("User")))
    node = lambda shape: lambda x, i: F.concat(F.lit(shape[0]), i.cast("string"), F.lit(shape[1]), x, F.lit(shape[2]))
    people = F.transform("actors", node(("  actor", '(["', '"])')))
    cases = F.when(F.size("features") == 0, _lines('  UC0["No functional requirements approved yet"]')).otherwise(F.transform(F.transform("features", tx.safe_label), node(("  UC", '["', '"]'))))
    edge = lambda i: F.transform(F.sequence(F.lit(0), F.greatest(F.size("features"), F.lit(1)) - 1), lambda j: F.concat(F.lit("  actor"), i.cast("string"), F.lit(" --> UC"), j.cast("string")))
    links = F.flatten(F.transform(F.sequence(F.lit(0), F.size("actors") - 1), edge))
    return rows.select("project_id", _text(_lines("flowchart LR", f"  {NOTE}"), people, cases, links).alias("text"))

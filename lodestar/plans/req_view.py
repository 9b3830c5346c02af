"""A requirement table derived from ``part``, by the same SQL text in Spark and DuckDB, so that rule queries are not vacuous."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.runtime import spread

#: Statements by p_partkey; {n} is the part's name, {k} its size.
TEMPLATES = [
    "The system shall store the {n} record within {k} seconds.",
    "The system shall not store the {n} record within {k} seconds.",
    "Users must authenticate with a password before they export the {n} report.",
    "The platform should quickly show many {n} items in a user-friendly list, etc.",
    "When a shopper adds a {n} to the cart, the system shall reserve the stock.",
    "While payment is pending, the system shall lock the {n} order.",
    "Where possible the service may optionally suggest a {n} bundle.",
    "If the {n} import fails, then the system shall notify the administrator by email.",
    "The list shall sort {n} prices from low to high.",
    "The list shall sort {n} prices from high to low.",
    "The system shall comply with NFR-SEC-0{k}.",
    "The system shall encrypt {n} data at rest in accordance with NFR-SEC-05.",
    "This document describes the {n} module.",
    "Version 0.{k} - DRAFT for {n}",
    "Present: the {n} team",
    "SHOP-{k},Story,As a shopper I want a {n}",
    "Reviewed on 13 Feb 2026 with the {n} group",
    "The {n} wishlist is out of scope for this release.",
    "It is disputed whether the {n} ratings ship either in 5 days or later.",
    "The {n} loyalty scheme is to be decided, decision pending.",
    "The {n} recommendations are deferred to phase 2 release.",
    "The {n} dashboard could load for every manager.",
    "Consent for {n} cookies shall be retained with an audit log.",
    "Invoices for {n} shall include GST and the SKU of each product.",
    "The API shall return {n} search results with robust latency and uptime monitoring.",
    "The courier will deliver each {n} to the customer after checkout.",
    "The {n} page is nice to have.",
    "The system shall enable the {n} coupon for every patient account.",
    "The system shall disable the {n} coupon for every patient account.",
    "The app is built on Django with PostgreSQL and Redis for {n} analytics.",
]


def _case() -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("{n}", "' || p_name || '").replace("{k}", "' || CAST(p_size % 9 + 1 AS STRING) || '") + "'"
    return "CASE p_partkey % 30 " + " ".join(f"WHEN {i} THEN {quote(t)}" for i, t in enumerate(TEMPLATES)) + " END"


COLUMNS = {
    "idx": "p_partkey",
    "id": "'R-' || lpad(CAST(p_partkey AS STRING), 9, '0')",
    "project_id": "p_brand",
    "statement": _case(),
    "rtype": "CASE p_size % 5 WHEN 0 THEN 'functional' WHEN 1 THEN 'non_functional' WHEN 2 THEN 'business' WHEN 3 THEN 'constraint' ELSE 'assumption' END",
    "nfr_category": "CASE WHEN p_size % 5 = 1 THEN CASE p_partkey % 4 WHEN 0 THEN 'performance' WHEN 1 THEN 'security' WHEN 2 THEN 'usability' ELSE 'other' END END",
    "feature": "CASE WHEN p_size % 5 = 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'Search ' || p_type WHEN 1 THEN 'Cart ' || p_type WHEN 2 THEN p_type WHEN 3 THEN 'Email alerts' ELSE ' ' END END",
    "inferred": "p_partkey % 13 = 0",
    "confidence": "(p_size % 11) / CAST(10 AS DOUBLE)",
    "status": "CASE p_partkey % 7 WHEN 4 THEN 'candidate' WHEN 5 THEN 'needs_review' WHEN 6 THEN 'rejected' ELSE 'approved' END",
    "doc_id": "'doc' || CAST(p_partkey % 4 AS STRING)",
    "source_type": "CASE p_partkey % 4 WHEN 0 THEN 'brd' WHEN 1 THEN 'form' WHEN 2 THEN 'transcript' ELSE 'mail' END",
    "location": "CASE p_partkey % 6 WHEN 0 THEN '(top)' WHEN 1 THEN 'Objectives' WHEN 2 THEN '' ELSE 'Section ' || CAST(p_size % 10 AS STRING) END",
    "twin": "CASE WHEN p_partkey % 17 = 0 THEN 'R-' || lpad(CAST(p_partkey + 1 AS STRING), 9, '0') END",
}

VIEW_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM part"


def req_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few MB on disk hold millions of rows, and reading their texts costs far more than a shuffle of them
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


def with_view(sql: str) -> str:
    """DuckDB SQL that reads the view as ``rv``."""
    return f"WITH rv AS ({VIEW_SQL})" + (", " + sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else " " + sql)

"""The technology stack of a project: adopted where its requirements state one, else proposed from what they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import classify as cl

#: Groups of technology tokens as aspects; hosting is switched off (see ``classify.is_excluded_aspect``).
ADOPTED = (("frontend", "frontend"), ("backend", "backend"), ("data", "database"))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def signals(reqs: DataFrame) -> DataFrame:
    """(project_id, tokens, stated, py, js, search, notify) of requirements (project_id, statement); tokens in the order of the lexicon."""
    low = F.lower(F.coalesce("statement", F.lit("")))
    every = [*dict.fromkeys([t for g in lex.TECH_TOKENS.values() for t in g]), *lex.STACK_NAMES]
    rows = reqs.select("project_id", low.alias("low"), cl.stated_tokens(low).alias("found"))
    out = rows.groupBy("project_id").agg(
        F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), F.bool_or(cl.contains_any(F.col("low"), lex.STACK_CUES)).alias("cue"),
        F.sum(cl.signal_count(F.col("low"), lex.PYTHON_SIGNALS)).alias("py"), F.sum(cl.signal_count(F.col("low"), lex.SCRIPT_SIGNALS)).alias("js"),
        F.bool_or(cl.contains_any(F.col("low"), lex.SEARCH_SIGNALS)).alias("search"), F.bool_or(cl.contains_any(F.col("low"), lex.NOTIFY_SIGNALS)).alias("notify"),
    )
    tokens = F.filter(_words(every), lambda t: F.array_contains("found", t))  # found has at most the lexicon's tokens
    named = F.exists("tokens", lambda t: F.array_contains(_words(lex.STACK_NAMES), t))
    return out.withColumn("tokens", tokens).withColumn("stated", named | ((F.size("tokens") > 0) & F.col("cue"))).drop("found", "cue")


def _row(key: str, pos: int, name: Column, recommended: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(pos).alias("pos"), name.alias("name"), recommended.alias("recommended"))


def proposal(reqs: DataFrame) -> DataFrame:
    """(project_id, stated, key, pos, name, recommended): one adopted candidate an aspect, or up to three with one recommended.

    A project states a stack if it names one, or names a technology beside a cue. Otherwise the backend leans to where more signals are
    (Python on a tie), and search and notifications are proposed where they are asked for.
    """
    part = lambda g: F.filter("tokens", lambda t: F.array_contains(_words(lex.TECH_TOKENS[g]), t))
    adopted = [F.when(F.size(part(g)) > 0, _row(key, 1, F.array_join(part(g), ", "), F.lit(True))) for g, key in ADOPTED]
    bare = F.forall("tokens", lambda t: F.array_contains(_words(lex.STACK_NAMES), t))
    alone = F.when(bare, _row("stack", 1, F.upper(F.coalesce(F.get("tokens", F.lit(0)), F.lit(lex.STACK_UNNAMED))), F.lit(True)))
    proposed = []
    for key, names, when in lex.STACK_PROPOSALS:
        for pos, name in enumerate(names, 1):
            lead = F.lit(pos == 1)
            if key == "backend":
                lead = F.when(F.col("py") >= F.col("js"), F.lit(pos == 2)).otherwise(F.lit(pos == 1))
            row = _row(key, pos, F.lit(name), lead)
            proposed.append(F.when(F.col(when), row) if when else row)
    rows = F.array_compact(F.when(F.col("stated"), F.array(*adopted, alone)).otherwise(F.array(*proposed)))
    return signals(reqs).select("project_id", "stated", F.inline(rows))


def unique_keys(aspects: DataFrame) -> DataFrame:
    """``aspects`` (project_id, pos, key, ...) with keys in lower case, told apart in a project: a blank one is named by its place, a repeated one gets a ``_`` more each time."""
    place = F.row_number().over(W.partitionBy("project_id").orderBy("pos")).cast("string")
    named = aspects.withColumn("key", F.coalesce(F.nullif(F.lower(F.trim("key")), F.lit("")), F.concat(F.lit("aspect-"), place)))
    nth = F.row_number().over(W.partitionBy("project_id", "key").orderBy("pos"))
    return named.withColumn("_nth", nth).withColumn("key", F.concat("key", F.repeat(F.lit("_"), F.col("_nth") - 1))).drop("_nth")

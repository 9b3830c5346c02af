"""Design tokens of a project: hues by domain words, colour roles held to a contrast, type and spacing scales.

What a role's colour is depends on its hue alone, so the fits are one small constant relation (a row per role and hue)
that projects join by hue; nothing is computed per project but the domain words of its requirements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import lexicons as lex
from lodestar.functions import numeric as nu
from lodestar.functions import text as tx

PROPOSED = "_Proposed design system, generated from the requirements; the inputs specify no visual design, so Design is to confirm it before build._"
ADOPTED = "_Proposed design system, adopted from the organisation's brand; Design is to confirm its application before build._"


def personality(reqs: DataFrame) -> DataFrame:
    """(project_id, primary, secondary, words, rationale): the first domain with a word in the project's name or statements, else the default."""
    keys = sorted({k for keys, *_ in lex.DOMAIN_HUES for k in keys})
    hit = lambda k: F.bool_or(F.contains(F.lower("statement"), F.lit(k))) | F.contains(F.lower("project_id"), F.lit(k))
    found = reqs.groupBy("project_id").agg(F.array_compact(F.array(*[F.when(hit(k), k) for k in keys])).alias("found"))
    pick: Column | None = None
    for keys_, primary, secondary, words in lex.DOMAIN_HUES:
        mine = F.array_intersect(F.array(*[F.lit(k) for k in keys_]), "found")
        why = F.concat(F.lit("Domain signals ("), F.substring(F.array_join(mine, ", "), 1, 60), F.lit(f") suggest a {words} identity."))
        row = F.struct(F.lit(primary).alias("primary"), F.lit(secondary).alias("secondary"), F.lit(words).alias("words"), why.alias("rationale"))
        pick = F.when(F.size(mine) > 0, row) if pick is None else pick.when(F.size(mine) > 0, row)
    primary, secondary = lex.HUE_DEFAULT
    rest = F.struct(F.lit(primary).alias("primary"), F.lit(secondary).alias("secondary"), F.lit(lex.WORDS_DEFAULT).alias("words"), F.lit(lex.RATIONALE_DEFAULT).alias("rationale"))
    return found.select("project_id", pick.otherwise(rest).alias("p")).select("project_id", "p.*")


def fitting_step(starts: DataFrame, ramps: DataFrame) -> DataFrame:
    """``starts`` (hue, step, least, backgrounds ...) with hex: the first ramp step from ``step`` on whose contrast is
    ``least`` on all ``backgrounds``, else the darkest. ``ramps`` is (hue, step, hex)."""
    keys = starts.columns
    rows = starts.join(F.broadcast(ramps.withColumnsRenamed({"step": "at"})), "hue").filter("at >= step")  # ramps are fixed values
    passes = F.forall("backgrounds", lambda b: nu.contrast(F.col("hex"), b) >= F.col("least"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(passes, F.col("hex")), F.when(passes, F.col("at"))), F.max_by("hex", "at")).alias("hex"))


def ramps(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h, i, c) for h, cs in lex.RAMPS.items() for i, c in enumerate(cs)], "hue string, step int, hex string")


def role_fits(spark: SparkSession) -> DataFrame:
    """(pos, token, usage, part, hue, hex): a role of the project's hues has a row for every hue, others have one with part ``fixed``."""
    canvas, rows, flat = lex.RAMPS["gray"][0], [], []
    for pos, (token, hue, step, least, on_surface, on_canvas, usage) in enumerate(lex.COLOUR_ROLES):
        backgrounds = [c for c, on in ((lex.SURFACE, on_surface), (canvas, on_canvas)) if on]
        if hue is None:
            flat.append((pos, token, usage, "fixed", "", lex.SURFACE))
        elif hue in lex.RAMPS:
            rows.append((pos, token, usage, "fixed", hue, step, least, backgrounds))
        else:
            rows += [(pos, token, usage, hue, h, step, least, backgrounds) for h in lex.RAMPS]
    starts = spark.createDataFrame(rows, "pos int, token string, usage string, part string, hue string, step int, least double, backgrounds array<string>")
    fitted = fitting_step(starts, ramps(spark)).select("pos", "token", "usage", "part", F.when(F.col("part") == "fixed", "").otherwise(F.col("hue")).alias("hue"), "hex")
    return fitted.unionByName(spark.createDataFrame(flat, fitted.schema))


def brand_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token, hex, usage) of a brand profile's ``colour_tokens``; hex in lower case without its mark."""
    profile = spark.read.schema("colour_tokens array<struct<token:string,hex:string,usage:string>>").json(path, multiLine=True)
    return profile.select(F.posexplode("colour_tokens")).select("pos", "col.token", F.lower(F.ltrim(F.col("col.hex"), F.lit("#"))).alias("hex"), "col.usage")


def tokens(person: DataFrame, brand: DataFrame | None = None) -> DataFrame:
    """(project_id, section, pos, token, cells) of every project of ``person``: colours, then type and spacing scales.

    With ``brand`` (see ``brand_tokens``: a profile's few rows) its colours are taken as they are for all projects.
    """
    spark = person.sparkSession
    if brand is None:
        uses = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), h.alias("hue")) for p, h in (("primary", F.col("primary")), ("secondary", F.col("secondary")), ("fixed", F.lit("")))]))
        colours = person.select("project_id", uses.alias("u")).select("project_id", "u.*").join(F.broadcast(role_fits(spark)), ["part", "hue"])
    else:
        colours = person.select("project_id").withColumn("all", F.lit(1)).join(F.broadcast(brand.withColumn("all", F.lit(1))), "all")
    colours = colours.select("project_id", F.lit("3.1.2").alias("section"), "pos", "token", F.array(F.concat(F.lit("`#"), "hex", F.lit("`")), "usage").alias("cells"))
    scales = [("3.1.3", i, t, cells) for i, (t, *cells) in enumerate(lex.TYPE_TOKENS)] + [("3.1.4", i, t, cells) for i, (t, *cells) in enumerate(lex.SPACE_TOKENS)]
    literal = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("pos"), F.lit(t).alias("token"), F.array(*[F.lit(c) for c in cells]).alias("cells")) for s, i, t, cells in scales])
    fixed = person.select("project_id", F.explode(literal).alias("x")).select("project_id", "x.*")
    return colours.unionByName(fixed)


def elements(rows: DataFrame) -> DataFrame:
    """The matrix rows (project_id, section, pos, row_id, requirement) of ``tokens``: the token is the id, the text its cells."""
    names = F.create_map(*[F.lit(x) for kv in lex.DESIGN_SECTIONS.items() for x in kv])
    bare = F.transform("cells", lambda c: F.btrim(c, F.lit("`")))
    return rows.select("project_id", names[F.col("section")].alias("section"), "pos", F.col("token").alias("row_id"), F.array_join(F.filter(bare, lambda c: c != ""), " · ").alias("requirement"))


LAYOUT = """- **Accessibility:** text meets WCAG 2.1 AA contrast (at least 4.5:1 for body text, 3:1 for large text, controls and borders); the colour tokens are chosen for it.
- **Status is never colour alone:** success, warning and error always have an icon and a label.
- **Touch targets:** interactive controls measure at least 44 × 44 px.
- **Focus:** every interactive element shows keyboard focus in `color-primary`.
- **Responsive:** layouts use the spacing scale, from one column on small screens to several on large ones.
- **Motion:** transitions are subtle and respect `prefers-reduced-motion`."""


def blocks(person: DataFrame, rows: DataFrame, adopted: bool = False) -> DataFrame:
    """(project_id, num, block) of sections 3.1.1 to 3.1.5; a section's table has at most a dozen rows, or the brand's."""
    mark = F.lit((ADOPTED if adopted else PROPOSED) + "\n\n")
    header = F.create_map(*[F.lit(x) for num, names in lex.DESIGN_HEADERS.items() for x in (num, "| " + " | ".join(names) + " |\n|" + "---|" * len(names) + "\n")])
    line = F.concat(F.lit("| "), "token", F.lit(" | "), F.array_join(F.transform("cells", tx.md_cell), " | "), F.lit(" |"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")
    tables = rows.groupBy("project_id", F.col("section").alias("num")).agg(lines.alias("lines")).select("project_id", "num", F.concat(mark, header[F.col("num")], "lines").alias("block"))
    theme = F.concat(
        mark, F.lit("The product's visual personality is **"), "words", F.lit("**. "), "rationale",
        F.lit(" Every colour, type step and spacing value below is a named token; the brand hue is an accent, and status always has an icon or a label besides its colour."),
    )
    return tables.unionByName(person.select("project_id", F.lit("3.1.1").alias("num"), theme.alias("block"))).unionByName(
        person.select("project_id", F.lit("3.1.5").alias("num"), F.concat(mark, F.lit(LAYOUT)).alias("block"))
    )

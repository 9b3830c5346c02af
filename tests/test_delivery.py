"""Design tokens, the technology section, packs, gold corpora and job logs on small fixtures."""

import csv
import json
from pathlib import Path

from lodestar import lexicons as lex
from lodestar.operators import design, document, jobs, reporting
from lodestar.sources import corpus, gold, pack

REQ = "project_id string, id string, statement string, rtype string, nfr_category string, feature string, doc_id string, location string, status string, priority string"


def contrast(a, b):
    def lum(h):
        c = [int(h[i : i + 2], 16) / 255 for i in (0, 2, 4)]
        return sum(w * (v / 12.92 if v <= 0.03928 else ((v + 0.055) / 1.055) ** 2.4) for w, v in zip((0.2126, 0.7152, 0.0722), c, strict=True))

    lo, hi = sorted((lum(a), lum(b)))
    return (hi + 0.05) / (lo + 0.05)


def test_every_role_fits_in_every_hue(spark):
    got = {(r.token, r.part, r.hue): r.hex for r in design.role_fits(spark).collect()}
    for token, hue, step, least, on_surface, on_canvas, _ in lex.COLOUR_ROLES:
        for h in lex.RAMPS if hue in ("primary", "secondary") else [hue]:
            back = ["ffffff"] * on_surface + ["f8f9fa"] * on_canvas
            want = "ffffff" if h is None else next((c for c in lex.RAMPS[h][step:] if all(contrast(c, b) >= least for b in back)), lex.RAMPS[h][-1])
            assert got.pop((token, hue, h) if hue in ("primary", "secondary") else (token, "fixed", "")) == want
    assert not got


def test_personality_first_domain_and_default(spark):
    rows = [("p", "Every bank order"), ("p", "A TAX menu"), ("school", "none"), ("x", "nothing here"), ("n", None)]
    got = {r.project_id: r for r in design.personality(spark.createDataFrame(rows, "project_id string, statement string")).collect()}
    assert (got["p"].primary, got["p"].secondary) == ("orange", "red") and got["p"].rationale.startswith("Domain signals (menu) suggest a warm")
    assert got["school"].primary == "violet" and got["x"].words == got["n"].words == lex.WORDS_DEFAULT


def test_brand_is_adopted(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"name": "n", "colour_tokens": [{"token": "ink", "hex": "#AABBCC", "usage": "Text | all."}]}))
    person = design.personality(spark.createDataFrame([("p", "x")], "project_id string, statement string"))
    rows = design.tokens(person, design.brand_tokens(spark, str(tmp_path / "b.json")))
    assert [(r.token, r.cells) for r in rows.filter("section = '3.1.2'").collect()] == [("ink", ["`#aabbcc`", "Text | all."])]
    text = {r.num: r.block for r in design.blocks(person, rows, adopted=True).collect()}
    assert set(text) == {"3.1.1", "3.1.2", "3.1.3", "3.1.4", "3.1.5"} and "| ink | `#aabbcc` | Text \\| all. |" in text["3.1.2"] and text["3.1.1"].startswith(design.ADOPTED)


def test_technology_section(spark):
    aspects = [("p", "frontend", "Frontend", "why\nso", 1), ("p", "db", "Database", None, 2), ("p", "cache", "Cache", "", 3), ("p", "hosting", "Hosting", "", 4)]
    cands = [("p", "frontend", "React", "r", True, 1), ("p", "frontend", "Vue", "v", False, 2), ("p", "db", "MySQL", None, False, 1), ("p", "db", "MongoDB", "m", True, 2), ("p", "cache", "Redis", "", True, 1), ("p", "hosting", "AWS", "", True, 1)]
    wish = [("p", "frontend", " vue "), ("p", "cache", "Valkey"), ("p", "db", " ")]
    df = document.technology_section(
        spark.createDataFrame(aspects, "project_id string, key string, title string, rationale string, pos int"), spark.createDataFrame(cands, "project_id string, key string, name string, reason string, recommended boolean, pos int"),
        spark.createDataFrame(wish, "project_id string, key string, choice string"), spark.createDataFrame([("p", False, ""), ("q", True, "x")], "project_id string, stated boolean, basis string"),
    )
    got = {(r.project_id, r.pos): r.block for r in df.collect()}
    assert len(got) == 8 and got["q", 0].startswith("The technology stack comes from")
    assert got["p", 0].endswith("**Selected stack:** Vue · MongoDB · Valkey.")
    assert got["p", 1] == "### 7.1 Client Applications\n\n**Vue** — why so v"
    assert got["p", 3] == f"### 7.3 Data Storage\n\n**MongoDB** — m  \n**Valkey** — {document.CUSTOM}"
    assert got["p", 2].endswith(document.LAYER_NONE) and got["p", 6].endswith(document.DEVICE_NONE)


def test_pack_holds_open_projects_only_and_drops_old_ones(spark, tmp_path):
    row = lambda p, i, status="approved", text='Say "a, b"\nor | c', doc="d": (p, i, text, "functional", None, "F", doc, "", status, None)
    reqs = spark.createDataFrame([row("open", "R-2", text="x"), row("open", "R-1"), row("shut", "R-3"), row("shut", "R-4", "candidate"), row("none", "R-5", "rejected"), row("bare", "R-6", doc="")], REQ)
    old = tmp_path / "pack" / "srs" / "project_id=gone"
    old.mkdir(parents=True)
    delivered = reporting.rtm_delivered(reqs)
    about = pack.manifest(reqs, delivered, reqs.limit(0))
    docs = spark.createDataFrame([(p, f"# {p}\n\nline") for p in ("open", "shut", "bare")], "project_id string, text string")
    refused = {r.project_id: r.reason for r in pack.write_pack(str(tmp_path / "pack"), reqs, docs, delivered, about).collect()}
    assert set(refused) == {"shut", "none", "bare"} and "without a source" in refused["bare"] and not old.exists()
    (srs,) = (tmp_path / "pack" / "srs").glob("project_id=*")
    assert srs.name == "project_id=open" and next(srs.glob("*.txt")).read_text() == "# open\n\nline\n"
    (rtm,) = (tmp_path / "pack" / "rtm").glob("project_id=open/*.csv")
    with rtm.open(newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0] == list(lex.RTM_CSV_HEADER) and [r[0] for r in rows[1:]] == ["REQ-1", "REQ-2"] and rows[1][3] == 'Say "a, b"\nor | c' and rows[1][4:] == [""] * 4
    said = json.loads(next((tmp_path / "pack" / "manifest").glob("project_id=open/*.json")).read_text())
    assert (said["pid"], said["approved"], said["functional"], said["matrix_rows"], said["open_items"]) == ("open", 2, 2, 2, 0)
    lines = [r.line for r in reporting.rtm_markdown(reporting.rtm_rows(reqs.filter("project_id = 'open'"))).orderBy("pos").collect()]
    assert lines[1] == "|" + "---|" * 8 and lines[2] == '| REQ-1 | R-1 | Say "a, b" or \\| c | functional | — | ' + lines[2].split(" | ")[5] + ' | d | "Say "a, b" or \\| c" |'


def test_gold_corpus(spark, tmp_path):
    req = lambda i, **k: {"id": i, "statement": "s", "rtype": "functional", "difficulty": [], "conflicts_with": [], "source": []} | k
    rows = [req("A", difficulty=["t", "u"], source=[{"doc_id": "d", "quote": "One “two”"}]), req("B", difficulty=["t"], duplicate_of="Z", source=[{"doc_id": "e", "quote": "x"}]), req("C", conflicts_with=["A", "Y"])]
    (tmp_path / "gold.json").write_text(json.dumps({"domain": "m", "requirements": rows}))
    (tmp_path / "splits.json").write_text(json.dumps({"dev": ["A", "Q"], "test": ["A", "B"]}))
    (tmp_path / "human_baseline.json").write_text(json.dumps({"recall": 0.5, "minutes": 3}))
    g, docs = gold.requirements(spark, str(tmp_path)), spark.createDataFrame([("d", "say one  \"TWO\" now")], "doc_id string, text string")
    assert {(r.id, r.fault) for r in gold.split_faults(g, gold.splits(spark, str(tmp_path))).collect()} == {("A", "shared"), ("C", "missing"), ("Q", "unknown")}
    assert {r.tag: r.ids for r in gold.tag_index(g).collect()} == {"t": ["A", "B"], "u": ["A"]}
    assert {(r.id, r.reason) for r in gold.untraceable(g, docs).collect()} == {("B", "unknown document"), ("C", "no source spans")}
    assert {tuple(r) for r in gold.dangling(g).collect()} == {("B", "duplicate_of", "Z"), ("C", "conflicts_with", "Y")}
    assert gold.baseline(spark, str(tmp_path)).first().asDict() == {"recall": 0.5, "minutes": 3.0, "reviewer": None, "notes": None, "pending": False}


def test_corpora_and_upload_manifest(spark, tmp_path):
    for name, text in (("a b", '{"docs": [{"doc_id": "d", "file": "docs/x.csv"}]}'), ("bad", "not json"), ("void", "{}")):
        (tmp_path / name).mkdir()
        Path(tmp_path / name / "manifest.json").write_text(text)
    (tmp_path / "plain").mkdir()
    got = {(r.id, r.doc_id, r.source_type) for r in corpus.corpora(spark, str(tmp_path), "dataset").collect()}
    assert got == {("a b", "d", lex.INGEST_TYPES["csv"]), ("bad", None, None), ("void", None, None)}
    up = corpus.upload_manifest(spark.createDataFrame([("m", "c:\\x\\Notes.v2.md"), ("m", ".env")], "domain string, name string")).first()
    assert [(d.doc_id, d.file) for d in up.docs] == [(".env", "docs/.env"), ("Notes.v2", "docs/Notes.v2.md")]


def test_jobs_cache_and_settings(spark):
    log = spark.createDataFrame([("p", 1, "running", "x"), ("p", 2, "done", "y"), ("q", 3, "running", "z")], "project_id string, seq long, state string, stage string")
    asked = spark.createDataFrame([("p", 5), ("p", 6), ("q", 7), ("r", 8)], "project_id string, seq long")
    assert {(r.project_id, r.seq) for r in jobs.admit(asked, log).filter("admitted").collect()} == {("p", 5), ("r", 8)}
    want = spark.createDataFrame([("k",), ("k",), ("m",), ("m",)], "key string")
    cache = spark.createDataFrame([("k", 2, "new"), ("k", 1, "old")], "key string, seq int, answer string")
    assert [r.key for r in jobs.unanswered(want, cache).collect()] == ["m"] and [tuple(r) for r in jobs.answered(want, cache).collect()] == [("k", "old")] * 2
    assert pack.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 4, "e": {}}, "d": {"f": 5}}) == {"a": {"b": 1, "c": 4, "e": {}}, "d": {"f": 5}}

"""Operators over the whole small tables against plain counts."""

from collections import Counter, defaultdict
from itertools import combinations

from lodestar.llm import linededup, neardup
from test_neardup import run_set

SF = "/root/testdata/sf0.001"


def test_every_link_of_the_documents_is_found(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets, by = [run_set(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    common = Counter(p for at in by.values() for p in combinations(at, 2))
    links = Counter()
    for (a, b), c in common.items():
        if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8:
            links[rows[a][0]] += 1
            links[rows[b][0]] += 1
    got = {r.doc_id: r.n_links for r in neardup.op6_ngram_jaccard_join(spark, SF).collect()}
    assert got == {i: links.get(i, 0) for i, _ in rows}


def test_no_run_of_50_words_is_left_twice(spark):
    seen = defaultdict(set)
    for r in linededup.op10_line_dedup(spark, SF).collect():
        lines = r.text.split("\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= 50:
                    seen["\n".join(lines[a : b + 1])].add(r.doc_id)
                    break
    assert not [x for x in seen.values() if len(x) > 1]

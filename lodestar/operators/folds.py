"""Ordered, lossless folds over requirements and open items.

Each fold says for one row after the other what becomes of it; ``waves`` runs it over blocks of linked rows. Decisions are plain rows
(which survivor a row went into, and whether that took its wording), and the survivors' columns are aggregated from them afterwards.
Wordings are compared by form, the class of equal normal forms, so copies cost nothing but their row.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar import lexicons as lex
from lodestar.functions import text as tx
from lodestar.operators import waves
from lodestar.operators.similarity import form_components, forms_of, overlap_pairs, ratio, with_form
from lodestar.operators.waves import Asks, with_component
from lodestar.runtime import Scratch

DEDUP, SAME_ANY_TYPE, COLLAPSE, ALIKE = 0.72, 0.9, 0.85, 0.5
#: The key under which a block asks for all survivors of its components.
ANY = -1
#: Survivors that one block notes for its wordings; beyond that it finds them again.
NOTED = 1 << 22


def _formed(rows: DataFrame, label: str) -> tuple[Scratch, DataFrame]:
    scratch = Scratch(rows.sparkSession, label)
    return scratch, scratch.write(with_form(rows.withColumn("idx", F.col("idx").cast("long"))), "rows")


def decide_duplicates(rows: list[dict], asks: Asks, hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """Each row goes into the survivor it is most like (the earliest of equals), if they are of one type (or nearly equal) and not opposite.

    The survivor takes the wording of the higher authority.
    """
    voices = {(h["comp"], h["keys"][0]): dict(h) for h in hosts}  # component and form -> the one survivor that speaks so
    for _, form in voices:
        asks.add(form)
    out, changed = [], {}
    for r in rows:
        comp, own = r["comp"], voices.get((r["comp"], r["form"]))
        near = [(own, 1.0)] if own else [(voices[comp, key], sim) for key, sim in asks.of(r["form"]) if (comp, key) in voices]
        host, sim = max(near, key=lambda x: (x[1], -x[0]["sid"]), default=(None, 0.0))
        fits = host is not None and sim >= DEDUP and (sim >= SAME_ANY_TYPE or host["rtype"] == r["rtype"])
        if not fits or tx.opposite(r["statement"], host["statement"]):
            host = {"comp": comp, "sid": r["idx"], "keys": [r["form"]], "statement": r["statement"], "authority": r["authority"], "rtype": r["rtype"], "wording": r["idx"]}
            if own is None:
                asks.add(r["form"])
            voices[comp, r["form"]] = changed[r["idx"]] = host
            out.append({"idx": r["idx"], "host": r["idx"], "took": True, "lost": None})
            continue
        took = r["authority"] > host["authority"]
        out.append({"idx": r["idx"], "host": host["sid"], "took": took, "lost": host["wording"] if took else r["idx"]})
        if took:
            voices.pop((comp, host["keys"][0]))
            if own is None:
                asks.drop(host["keys"][0])
                asks.add(r["form"])
            host.update(keys=[r["form"]], statement=r["statement"], authority=r["authority"], wording=r["idx"])
            voices[comp, r["form"]] = changed[host["sid"]] = host
    return out, list(changed.values())


class Alike(Asks):
    """Asks of a component's forms that are found as they come: the voices that a form is most like, at ``threshold`` at least.

    Voices are scored by falling bounds (common characters, and token sets exactly) until no bound reaches the best, so few of them are. What a form
    has found stays, and later only new voices are looked at.
    """

    def __init__(self, spelled: dict[int, str], threshold: float) -> None:
        super().__init__()
        self.threshold, self.place = threshold, {f: i for i, f in enumerate(spelled)}
        self.text, self.words = list(spelled.values()), [frozenset(s.split()) for s in spelled.values()]
        known = {c: i for i, c in enumerate(sorted(set().union(*self.text)))}
        self.letters = np.zeros((len(self.text), len(known)), np.int16)
        for i, s in enumerate(self.text):
            for c, n in Counter(s).items():
                self.letters[i, known[c]] = n
        self.size, self.n_words = np.array([len(s) for s in self.text]), np.array([len(w) for w in self.words])
        self._clear([])

    def _clear(self, voices: list[int]) -> None:
        """Slots for these voices (keys) only; what forms have found goes."""
        self.keys, self.slot, self.found, self.matchers, self.holds = [], {}, {}, {}, {}
        self.at, self.lives = np.zeros(64, np.int64), np.zeros(64, bool)
        for key in voices:
            self.add(key)

    def add(self, key: int) -> None:
        k, i = len(self.keys), self.place[key]
        if k == len(self.at):
            self.at, self.lives = np.resize(self.at, 2 * k), np.concatenate([self.lives, np.zeros(k, bool)])
        self.keys.append(key)
        self.at[k], self.lives[k], self.slot[key] = i, True, k
        for w in self.words[i]:
            self.holds.setdefault(w, array("i")).append(k)

    def drop(self, key: int) -> None:
        self.lives[self.slot.pop(key)] = False
        if len(self.keys) > 64 and len(self.slot) * 2 < len(self.keys):
            self._clear(list(self.slot))

    def _best(self, i: int, start: int, best: float, ties: list[int]) -> tuple[float, list[int]]:
        """The largest score of form i and its slots, after those from ``start`` on."""
        n = len(self.keys) - start
        common = np.zeros(n)
        for w in self.words[i]:
            held = self.holds.get(w)
            if held is not None:
                common += np.bincount(np.array(held[bisect_left(held, start) :], np.int64) - start, minlength=n)
        at = self.at[start : start + n]
        joint = common / (self.n_words[at] + self.n_words[i] - common)
        most = np.maximum(joint, np.minimum(self.letters[at], self.letters[i]).sum(axis=1) * 2.0 / (self.size[at] + self.size[i]))
        may = np.flatnonzero(self.lives[start : start + n] & (most >= max(best, self.threshold) - 1e-9))
        for k in may[np.argsort(-most[may], kind="stable")].tolist():
            if most[k] < best - 1e-9:
                break
            j = int(at[k])
            sim = max(float(joint[k]), ratio(self.text[i], self.text[j], self._matcher(j)))
            if sim >= self.threshold and sim >= best:
                ties = [*ties, start + k] if sim == best else [start + k]
                best = sim
        return best, ties

    def _matcher(self, j: int) -> SequenceMatcher:
        if j not in self.matchers:
            if len(self.matchers) >= 1024:
                self.matchers.clear()
            self.matchers[j] = SequenceMatcher(None, "", self.text[j])
        return self.matchers[j]

    def of(self, who: int) -> Iterator[tuple]:
        """(key, sim) of the voices that are most like ``who``."""
        i = self.place[who]
        if not self.text[i] or not self.keys:
            return iter(())
        upto, best, ties = self.found.get(who, (0, 0.0, []))
        alive = [k for k in ties if self.lives[k]]
        if ties and not alive:
            upto, best = 0, 0.0
        if upto < len(self.keys):
            best, alive = self._best(i, upto, best, alive)
        self.found[who] = len(self.keys), best, alive
        return iter([(self.keys[k], best) for k in alive])


class Near(Alike):
    """All voices that a form is like, at ``threshold`` at least."""

    def of(self, who: int) -> Iterator[tuple]:
        i = self.place[who]
        if not self.text[i]:
            return iter(())
        upto, like = self.found.get(who, (0, []))
        at, like = self.at[upto : len(self.keys)], [k for k in like if self.lives[k]]
        least = self.threshold - 1e-9
        fit = np.minimum(self.letters[at], self.letters[i]).sum(axis=1) * 2.0 / (self.size[at] + self.size[i]) >= least
        held = [np.array(h[bisect_left(h, upto) :], np.int64) - upto for w in self.words[i] if (h := self.holds.get(w)) is not None]
        common = np.bincount(np.concatenate(held), minlength=len(at)) if held else np.zeros(len(at))
        joint = common / (self.n_words[at] + self.n_words[i] - common)
        for k in np.flatnonzero(self.lives[upto : len(self.keys)] & (fit | (joint >= least))).tolist():
            j = int(at[k])
            if joint[k] >= self.threshold or ratio(self.text[i], self.text[j], self._matcher(j)) >= self.threshold:
                like.append(upto + k)
        self.found[who] = len(self.keys), like
        return iter([(self.keys[k], None) for k in like])


def _by_component(decide, kind: type[Alike], threshold: float, rows: list[dict], hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """``decide`` for one component after the other, with asks that find out by themselves whom rows are like."""
    by: dict[int, tuple[list[dict], list[dict]]] = {}
    for k, some in enumerate((rows, hosts)):
        for r in some:
            by.setdefault(r["comp"], ([], []))[k].append(r)
    out, changed = [], []
    for mine, known in by.values():
        spelled = {h["keys"][0]: h["statement"] for h in known} | {r["form"]: r["statement"] for r in mine}
        alike = kind({f: " ".join(sorted(tx.token_list(s))) for f, s in spelled.items()}, threshold)
        said, new = decide(mine, alike, sorted(known, key=lambda h: h["sid"]))
        out += said
        changed += [{**h, "keys": [h["keys"][0], ANY]} for h in new]
    return out, changed


def decide_alike(rows: list[dict], asks: Asks, hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """``decide_duplicates`` without given asks."""
    return _by_component(decide_duplicates, Alike, DEDUP, rows, hosts)


def _members(order: str, value: str, keep=None):
    """The values of a survivor's rows, in order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value) if keep is None else F.when(keep, F.struct(order, value))))
    return F.transform(pairs, lambda x: x[value])


def dedup_fold(reqs: DataFrame) -> DataFrame:
    """Fold (project_id, idx, id, statement, rtype, authority, refs) of every project.

    (project_id, idx, id, statement, rtype, refs, duplicate_of, absorbed): a survivor's ids of merged rows and displaced wordings are lists
    in the order of merging; they are part of the result, so a survivor's row is as long as what it absorbed.
    """
    scratch, named = _formed(reqs.select("project_id", "idx", "id", "statement", "rtype", "authority", "refs"), "dedup")
    comps = form_components(scratch.write(forms_of(named), "forms"), DEDUP)
    rows = named.join(comps, "form", "left").select(F.coalesce("comp", "form").alias("comp"), "idx", F.col("form").alias("who"), "form", "statement", F.col("authority").cast("long").alias("authority"), "rtype")
    asks = named.select(F.col("form").alias("who"), F.lit(ANY).cast("long").alias("key")).distinct()
    said = scratch.write(waves.fold(rows, asks, decide_alike, "idx long, host long, took boolean, lost long", "sid long, keys array<long>, statement string, authority long, rtype string, wording long", told=False), "said")
    joined = said.join(named.select("idx", "id", "statement", "refs"), "idx").join(named.select(F.col("idx").alias("lost"), F.col("statement").alias("lost_text")), "lost", "left")
    merged = F.col("idx") != F.col("host")
    told = joined.groupBy("host").agg(
        F.max_by("statement", F.when(F.col("took"), F.col("idx"))).alias("statement"), F.array_distinct(F.flatten(_members("idx", "refs"))).alias("refs"),
        F.array_distinct(_members("idx", "id", merged)).alias("duplicate_of"), _members("idx", "lost_text", merged).alias("absorbed"),
    )
    head = named.select("project_id", F.col("idx").alias("host"), "id", "rtype")
    return told.join(head, "host").select("project_id", F.col("host").alias("idx"), "id", "statement", "rtype", "refs", "duplicate_of", "absorbed")


def unaccounted(original: DataFrame, survivors: DataFrame) -> DataFrame:
    """Original statements that neither survive nor stand in an absorbed trail, by normal form: must be empty."""
    trail = survivors.select("project_id", F.explode(F.concat(F.array("statement"), "absorbed")).alias("s"))
    known = trail.select("project_id", tx.normalize_exact("s").alias("norm"))
    return original.withColumn("norm", tx.normalize_exact("statement")).join(known, ["project_id", "norm"], "left_anti").drop("norm")


def decide_items(rows: list[dict], asks: Asks, hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """Near-verbatim open items go into the first survivor that is not opposite; the longest text speaks for it from then on."""
    voices: dict[tuple, dict[int, dict]] = {}  # several survivors may come to speak alike
    for h in hosts:
        voices.setdefault((h["comp"], h["keys"][0]), {})[h["sid"]] = dict(h)
    for _, form in voices:
        asks.add(form)
    out, changed = [], {}

    def speak(comp: int, form: int, host: dict) -> None:
        if not voices.get((comp, form)):
            asks.add(form)
        voices.setdefault((comp, form), {})[host["sid"]] = changed[host["sid"]] = host

    for o in rows:
        comp, text = o["comp"], (o["statement"] or "").strip()
        near = {sid: h for key, _ in asks.of(o["form"]) for sid, h in voices.get((comp, key), {}).items()} if text else {}
        host = next((near[sid] for sid in sorted(near) if not tx.opposite(text, near[sid]["statement"] or "")), None)
        if host is None:
            host = {"comp": comp, "sid": o["idx"], "keys": [o["form"]], "statement": o["statement"]}
            speak(comp, o["form"], host)
            out.append({"idx": o["idx"], "host": o["idx"], "text": o["statement"]})
            continue
        longer = len(text) > len(host["statement"] or "")
        out.append({"idx": o["idx"], "host": host["sid"], "text": text if longer else None})
        if longer:
            del voices[comp, host["keys"][0]][host["sid"]]
            if not voices[comp, host["keys"][0]]:
                asks.drop(host["keys"][0])
            host.update(keys=[o["form"]], statement=text)
            speak(comp, o["form"], host)
    return out, list(changed.values())


def decide_items_alike(rows: list[dict], asks: Asks, hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """``decide_items`` without given asks."""
    return _by_component(decide_items, Near, COLLAPSE, rows, hosts)


def openq_collapse(items: DataFrame) -> DataFrame:
    """Fold (project_id, idx, kind, statement, reason) of every project; the most decisive kind, the first of equals, stays with its reason."""
    scratch, named = _formed(items.select("project_id", "idx", "kind", "statement", "reason"), "items")
    forms = scratch.write(forms_of(named), "forms")
    rows = named.join(form_components(forms, COLLAPSE), "form", "left").select(F.coalesce("comp", "form").alias("comp"), "idx", F.col("form").alias("who"), "form", "statement")
    asks = named.select(F.col("form").alias("who"), F.lit(ANY).cast("long").alias("key")).distinct()  # without a token nothing is alike, not even an equal text
    said = scratch.write(waves.fold(rows, asks, decide_items_alike, "idx long, host long, text string", "sid long, keys array<long>, statement string", told=False), "said")
    known = F.create_map(*[F.lit(x) for k in lex.OPEN_KINDS if k[3] is not None for x in (k[0], k[3])])
    each = said.join(named.select("project_id", "idx", "kind", "reason"), "idx").withColumn("rank", F.coalesce(F.try_element_at(known, F.col("kind")), F.lit(99)))
    lead = F.min_by(F.struct("kind", "reason"), F.struct("rank", "idx"))
    told = each.groupBy("project_id", "host").agg(lead.alias("x"), F.max_by("text", F.when(F.col("text").isNotNull() | (F.col("idx") == F.col("host")), F.col("idx"))).alias("statement"))
    return told.select("project_id", F.col("host").alias("idx"), "x.kind", "statement", "x.reason")


def _words(norm: str) -> set[str]:
    return set(norm.split(" ")) if norm else set()


class _Survivors:
    """A component's survivors in their order, the spans (start, end) of each by document, and which of them are worded like a form."""

    def __init__(self) -> None:
        self.hosts, self.sizes, self.places, self.own, self.like, self.noted = [], [], {}, {}, {}, 0

    def add(self, host: dict) -> None:
        words = _words(host["norm"])
        for w in words:
            self.places.setdefault(w, array("i")).append(len(self.hosts))
        self.own[host["keys"][0]] = host
        self.hosts.append(host)
        self.sizes.append(len(words))

    def alike(self, form: int, norm: str) -> Iterator[dict]:
        """Survivors, in their order, whose words overlap with the form's; each form and survivor are compared once."""
        at, found = self.like.get(form, (0, array("i")))
        if at < len(self.hosts):
            common, words = Counter(), _words(norm)
            for w in words:
                places = self.places.get(w, ())
                common.update(places[bisect_left(places, at) :])
            new = sorted(i for i, c in common.items() if c / (len(words) + self.sizes[i] - c) >= ALIKE)
            self.noted += len(new)
            if self.noted > NOTED:
                self.like, self.noted = {}, len(found) + len(new)
            found.extend(new)
            self.like[form] = len(self.hosts), found
        return (self.hosts[i] for i in found)


def _meets(s: int, e: int, spans: dict[tuple, None], least: float = 0.6) -> bool:
    """Whether a span and one of ``spans`` cover that part of their hull."""
    return (s < e and (s, e) in spans) or any(max(e, e2) > min(s, s2) and min(e, e2) - max(s, s2) >= least * (max(e, e2) - min(s, s2)) for s2, e2 in spans)


def decide_near(rows: list[dict], asks: Asks, hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """Rows go into the first survivor of equal wording, or of alike wording and a span that meets one of theirs.

    Nothing is asked for: the words of rows and survivors are compared here, for the pairs of alike wordings are many times the rows.
    """
    earlier: dict[int, list[dict]] = {}
    for h in sorted(hosts, key=lambda h: h["sid"]):
        spans: dict[str, dict[tuple, None]] = {}
        for x in h["spans"]:
            spans.setdefault(x["doc"], {})[x["s"], x["e"]] = None
        earlier.setdefault(h["comp"], []).append({**h, "spans": spans})
    out, changed, known, comp = [], {}, _Survivors(), None
    for r in sorted(rows, key=lambda r: (r["comp"], r["idx"])):  # one component after the other, so that notes are kept for one only
        if r["comp"] != comp:
            known, comp = _Survivors(), r["comp"]
            for h in earlier.get(comp, ()):
                known.add(h)
        doc, span = r["doc_id"], (r["start"], r["end"])
        own = known.own.get(r["form"])
        host = next((h for h in known.alike(r["form"], r["norm"]) if h is own or (doc in h["spans"] and _meets(*span, h["spans"][doc]))), own)
        if host is None:
            host = {"comp": r["comp"], "sid": r["idx"], "keys": [r["form"]], "norm": r["norm"], "spans": {}}
            known.add(host)
        if span not in host["spans"].setdefault(doc, {}):
            host["spans"][doc][span] = None
            changed[host["sid"]] = host
        out.append({"idx": r["idx"], "host": host["sid"]})
    return out, [{**h, "spans": [{"doc": doc, "s": s, "e": e} for doc, spans in h["spans"].items() for s, e in spans]} for h in changed.values()]


def near_dup_merge(reqs: DataFrame) -> DataFrame:
    """(project_id, idx, statement, merged) from rows with one span (doc_id, start, end) each."""
    scratch, named = _formed(reqs.select("project_id", "idx", "statement", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "near")
    forms = named.groupBy("project_id", "form").agg(F.first("norm").alias("norm"))
    words = F.when(F.col("norm") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split("norm", " ")))
    alike = scratch.write(overlap_pairs(forms.select("project_id", F.col("form").alias("idx"), words.alias("terms")), ALIKE).select("a", "b"), "links")
    ways = alike.select(F.col("a").alias("who"), F.col("b").alias("key")).union(alike.select("b", "a")).union(forms.select("form", "form"))
    rows = with_component(named, alike, "form").select("comp", "idx", F.col("form").alias("who"), "form", "norm", "doc_id", "start", "end")
    said = scratch.write(waves.fold(rows, ways, decide_near, "idx long, host long", "sid long, keys array<long>, norm string, spans array<struct<doc:string,s:long,e:long>>", told=False), "said")
    merged = said.filter("idx <> host").groupBy("host").agg(F.sort_array(F.collect_list("idx")).alias("merged"))
    heads = said.filter("idx = host").join(named.select("project_id", "idx", "statement"), "idx").join(merged, "host", "left")
    return heads.select("project_id", "idx", "statement", F.coalesce("merged", F.array().cast("array<long>")).alias("merged"))


def decide_clusters(rows: list[dict], asks: Asks, hosts: list[dict]) -> tuple[list[dict], list[dict]]:
    """A row's cluster is that of the earliest opener that has seen any of its terms; then that has seen them all."""
    opened = {(h["comp"], h["sid"]): h["opener"] for h in hosts}
    out, changed = [], set()
    for r in rows:
        terms = [(r["comp"], t) for (t,) in asks.of(r["idx"])]
        at = min((opened[t] for t in terms if t in opened), default=r["idx"])
        for t in terms:
            if at < opened.get(t, at + 1):
                opened[t] = at
                changed.add(t)
        out.append({"idx": r["idx"], "cluster": at})
    return out, [{"comp": c, "sid": t, "keys": [t], "opener": opened[c, t]} for c, t in changed]


def scope_clusters(items: DataFrame) -> DataFrame:
    """(project_id, idx, cluster, representative) of open scope items (project_id, idx, statement); the longest statement represents, the first of equals."""
    scratch = Scratch(items.sparkSession, "scope")
    termed = scratch.write(items.select("project_id", F.col("idx").cast("long").alias("idx"), "statement", tx.distinctive(tx.decision_terms(F.col("statement"))).alias("terms")), "rows")
    each = termed.select("project_id", "idx", F.explode("terms").alias("t"))
    hubs = each.groupBy("project_id", "t").agg(F.min("idx").alias("b"))  # sharing a term is transitive through its first item
    edges = each.join(hubs, ["project_id", "t"]).filter("idx <> b").select(F.col("idx").alias("a"), "b").distinct()
    rows = with_component(termed.select("idx"), edges).withColumn("who", F.col("idx"))
    asks = each.select(F.col("idx").alias("who"), F.col("t").alias("key"))
    said = waves.fold(rows, asks, decide_clusters, "idx long, cluster long", "sid string, keys array<string>, opener long")
    out = scratch.write(said.join(termed.select("project_id", "idx", F.coalesce(F.length("statement"), F.lit(0)).alias("size")), "idx"), "said")
    shown = out.groupBy("cluster").agg(F.max_by("idx", F.struct("size", (-F.col("idx")).alias("m"))).alias("shown"))
    return out.join(shown, "cluster").select("project_id", "idx", "cluster", (F.col("idx") == F.col("shown")).alias("representative"))


def windows_of(rows: DataFrame, threshold: float, size: int = 40, by_text: bool = False) -> DataFrame:
    """``rows`` with comp, window and pos (from 0): components of similar statements, cut into windows of ``size``."""
    from pyspark.sql import Window as W

    scratch, named = _formed(rows, "windows")
    forms = scratch.write(forms_of(named), "forms")
    # the score counts from the earlier row to the later one; the later form's rows come first only if the other form goes on after them
    comps = scratch.write(form_components(forms, threshold, either=False), "comps")
    placed = named.join(comps, "form", "left").withColumn("comp", F.coalesce("comp", "form")).drop("norm", "form")
    order = [tx.normalize(F.col("statement")), "idx"] if by_text else ["idx"]
    n = F.row_number().over(W.partitionBy("project_id", "comp").orderBy(*order)) - 1
    return placed.withColumn("_n", n).withColumn("window", F.floor(F.col("_n") / size).cast("int")).withColumn("pos", (F.col("_n") % size).cast("int")).drop("_n")


def _absorb(rows: list[dict], rep: int, members: list[int], gone: set[int]) -> None:
    """The representative takes over ids, wordings and references of the other members."""
    host = rows[rep]
    for p in members:
        if p != rep:
            host["duplicate_of"] += [x for x in [rows[p]["id"], *rows[p]["duplicate_of"]] if x not in host["duplicate_of"]]
            host["absorbed"] += [rows[p]["statement"], *rows[p]["absorbed"]]
            host["refs"] += [x for x in rows[p]["refs"] if x not in host["refs"]]
            gone.add(p)


def consolidate(rows: list[dict], groups: list[list[int]]) -> list[dict]:
    """Merge verdict groups (positions); the representative has the highest authority, then consensus, then length."""
    gone: set[int] = set()
    stop = set(lex.EMPTY_WORDS)
    for group in groups:
        members = [p for p in sorted(set(group)) if 0 <= p < len(rows) and p not in gone]
        if len(members) < 2:
            continue
        terms = {p: {w for w in tx._TOKEN.findall(rows[p]["statement"].lower()) if w not in stop and len(w) > 2} for p in members}
        shared = {t for p in members for t in terms[p] if sum(t in terms[x] for x in members) >= 2}
        _absorb(rows, max(members, key=lambda p: (rows[p]["authority"], len(terms[p] & shared), len(rows[p]["statement"]))), members, gone)
    return [r for p, r in enumerate(rows) if p not in gone]


def merge_confirmed(rows: list[dict], groups: list[list[int]]) -> list[dict]:
    """Merge confirmed duplicates (positions); the longest wording, the first of equals, represents."""
    gone: set[int] = set()
    for group in groups:
        members = [p for p in sorted(set(group)) if 0 <= p < len(rows) and p not in gone]
        if len(members) >= 2:
            _absorb(rows, max(members, key=lambda p: len(rows[p]["statement"] or "")), members, gone)
    return [r for p, r in enumerate(rows) if p not in gone]


_TRAIL = ("duplicate_of", "absorbed", "refs")


def _by_verdicts(placed: DataFrame, verdicts: DataFrame, merge) -> DataFrame:
    """Windows merged by the verdicts (project_id, comp, window, group_id, pos) on them, trails included."""
    keys = ["project_id", "comp", "window"]
    said = verdicts.groupBy(*keys, "group_id").agg(F.sort_array(F.collect_set("pos")).alias("g")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("group_id", "g"))).alias("groups"))
    empty = F.array().cast("array<string>")
    for c in _TRAIL:
        placed = placed.withColumn(c, F.coalesce(c, empty) if c in placed.columns else empty)
    ready = placed.join(said, keys, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = [{**r, **{c: list(r[c]) for c in _TRAIL}} for r in pdf.drop(columns=["groups"]).to_dict("records")]
        groups = pdf["groups"].iloc[0]
        kept = merge(rows, [list(g["g"]) for g in groups] if groups is not None else [])
        return pd.DataFrame(kept, columns=["project_id", "idx", "id", "statement", *_TRAIL])

    return ready.groupBy(*keys).applyInPandas(run, "project_id string, idx long, id string, statement string, duplicate_of array<string>, absorbed array<string>, refs array<string>")


def consolidated(reqs: DataFrame, verdicts: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Merge (project_id, idx, id, statement, authority, and trails if there are) by external verdicts over windows of ``windows_of``, or ``placed`` in them.

    Lossless: every input id is a result's id or in its duplicate_of.
    """
    return _by_verdicts(windows_of(reqs, 0.5, by_text=True) if placed is None else placed, verdicts, consolidate)


def confirmed_dedup(reqs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Merge rows of one meaning, of whatever types, by external verdicts over windows of similar statements (0.45) in their order."""
    return _by_verdicts(windows_of(reqs, 0.45), verdicts, merge_confirmed)


@F.pandas_udf(T.BooleanType())
def _variant(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([tx.modality_variant(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def conflicts(reqs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Conflicting pairs by external verdicts (project_id, comp, window, a, b, is_conflict, reason), positions from 0.

    Self pairs, unknown positions, denied verdicts and mere modality variants are dropped; each pair once.
    """
    placed = windows_of(reqs, 0.45)
    side = lambda s: placed.select("project_id", "comp", "window", F.col("pos").alias(s), F.col("id").alias(f"{s}_id"), F.col("statement").alias(f"{s}_text"))
    keys = ["project_id", "comp", "window"]
    pairs = verdicts.filter("is_conflict and a <> b").join(side("a"), [*keys, "a"]).join(side("b"), [*keys, "b"])
    real = pairs.filter(~_variant("a_text", "b_text"))
    real = real.withColumn("k1", F.least("a_id", "b_id")).withColumn("k2", F.greatest("a_id", "b_id"))
    first = real.groupBy("project_id", "k1", "k2").agg(F.min(F.struct("comp", "window", "a", "b", "a_id", "b_id", "reason")).alias("x"))
    return first.select("project_id", "x.a_id", "x.b_id", tx.first_line(F.col("x.reason")).alias("reason"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(project_id, id, conflicts_with): both directions of conflict pairs."""
    both = pairs.select("project_id", F.col("a_id").alias("id"), F.col("b_id").alias("o")).union(pairs.select("project_id", "b_id", "a_id"))
    return both.groupBy("project_id", "id").agg(F.sort_array(F.collect_set("o")).alias("conflicts_with"))


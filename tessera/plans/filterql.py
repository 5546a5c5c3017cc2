"""The JSON filter language, compiled to Spark columns.

An expression is an object of one predicate or combinator (several keys are a
conjunction; an array is one too).  Predicates become null-free boolean columns
over the node table; walks become id sets joined as flags.  After the whole
expression, every matched arrow adds those of its ends that exist.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import saved
from .model import ARROW_KINDS, LEVELS, TAXA

#: Predicates with their argument and what they keep.
PREDICATES = {
    "level": ("kind | instance", "one level: the boxes and the arrows between them"),
    "kind-of": ("<obj- id>", "the instances of one kind"),
    "arrow-kind": (" | ".join(ARROW_KINDS), "arrows of one kind"),
    "tied-to": ("<obj- or mor- id>", "everything hanging off one structure"),
    "in-data-of": ("<obj- id>", "one kind's defining diagram"),
    "region": ("<token>", "one region of the canvas"),
    "about": ("<id of any tree>", "the `about` bridge, both ways"),
    "taxon": (" | ".join(TAXA), "trees of one taxon"),
    "id": ("<id>", "exactly one tree"),
    "text": ("<substring>", "id or title contains the text"),
    "and": ("[expr, …]", "all must hold"),
    "or": ("[expr, …]", "at least one must hold"),
    "not": ("expr", "the opposite"),
}
MAX_DEPTH = 12
_CLOSED = {"level": LEVELS, "arrow-kind": ARROW_KINDS, "taxon": list(TAXA)}


@dataclass(frozen=True)
class Problem:
    code: str
    detail: str = ""
    fatal: bool = False

    def __str__(self) -> str:
        says = {
            "not-an-object": 'a filter must be a JSON object, e.g. {"level": "instance"}', "empty": "empty filter", "unknown-predicate": "unknown predicate: {}",
            "bad-argument": "predicate {} was given the wrong kind of value", "bad-value": "value not allowed: {}", "too-deep": "the filter is nested too deeply",
            "unknown-id": "no tree has the id {}", "no-data": "{} is not a kind with a defining diagram", "bad-json": "invalid JSON: {}",
        }
        return says[self.code].format(self.detail)


@dataclass
class Graph:
    """``nodes`` (id, title, taxon, level, of, region, kind, src, dst), ``arrows`` (id, kind, src, dst),
    ``data`` (kind, member), ``about`` (src, dst) and declared regions (id, title)."""

    nodes: DataFrame
    arrows: DataFrame
    data: DataFrame
    about: DataFrame
    regions: list[tuple[str, str]] = field(default_factory=list)

    @functools.cached_property
    def with_ends(self) -> DataFrame:
        """Nodes with level and region of an arrow's ends."""
        placed = self.nodes.where("level is not null or region is not null")  # others have nothing to give
        end = lambda side: placed.select(F.col("id").alias(f"{side}_id"), F.col("level").alias(f"{side}_level"), F.col("region").alias(f"{side}_region"))
        src, dst = end("src"), end("dst")
        arrows = self.nodes.where("taxon = 'morphism'").join(src, F.col("src") == F.col("src_id"), "left").join(dst, F.col("dst") == F.col("dst_id"), "left")
        return self.nodes.where("taxon != 'morphism'").unionByName(arrows, allowMissingColumns=True)

    def arrow_ends(self, arrows: DataFrame) -> DataFrame:
        """Ids of the ends of some arrows."""
        return arrows.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null")

    def tied_to(self, node: str) -> DataFrame:
        """Everything around an object or arrow."""
        me = self.nodes.where(F.col("id") == node)
        # Only an object has surroundings: a one-row look-up decides which plan is built.
        found = me.select("taxon", "level", "of").limit(1).collect()
        if not found:
            return me.select("id")
        if found[0].taxon != "object":
            own_ends = self.arrow_ends(me.where("taxon = 'morphism'")).join(self.nodes.select("id"), "id", "left_semi")
            return me.select("id").union(own_ends).distinct()
        touching = self.arrows.where((F.col("src") == node) | (F.col("dst") == node)).select("id")
        members = self.data.where(F.col("kind") == node).select(F.col("member").alias("id"))
        drawn = self.arrow_ends(self.arrows.join(members, "id", "left_semi"))
        instances = self.nodes.where((F.col("level") == "instance") & (F.col("of") == node)).select("id")
        around = me.select("id").union(members).union(drawn).union(instances).union(touching)
        if found[0].level == "instance" and found[0].of is not None:
            around = around.union(self.nodes.where(F.col("id") == found[0].of).select("id"))
        around = saved(around.distinct())
        both = self.arrows.join(around.withColumnRenamed("id", "src"), "src", "left_semi").join(around.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id")
        return around.union(both).distinct().join(self.nodes.select("id"), "id", "left_semi")

    def in_data_of(self, node: str) -> DataFrame:
        """A kind with the members of its diagram and the ends of its arrows."""
        members = self.data.where(F.col("kind") == node).select(F.col("member").alias("id"))
        ends = self.arrow_ends(self.arrows.join(members, "id", "left_semi"))
        return self.nodes.where(F.col("id") == node).select("id").union(members).union(ends).distinct()

    def about_set(self, node: str) -> DataFrame:
        """A node and its neighbours over ``about``, both ways."""
        there = self.about.where(F.col("src") == node).select(F.col("dst").alias("id"))
        back = self.about.where(F.col("dst") == node).select(F.col("src").alias("id"))
        return self.nodes.where(F.col("id") == node).select("id").union(there).union(back).distinct()


class _Compiled:
    def __init__(self, graph: Graph):
        self.graph, self.problems, self.sets, self.asked = graph, [], [], []

    def fail(self, code: str, detail: str = "") -> Column:
        self.problems.append(Problem(code, detail, True))
        return F.lit(False)

    def member(self, ids: DataFrame) -> Column:
        self.sets.append(ids)
        return F.coalesce(F.col(f"_set{len(self.sets) - 1}"), F.lit(False))

    def of(self, expr, depth: int = 0) -> Column:
        if depth > MAX_DEPTH:
            return self.fail("too-deep")
        if isinstance(expr, list):
            expr = {"and": expr}
        if not isinstance(expr, dict):
            return self.fail("not-an-object")
        if not expr:
            return self.fail("empty")
        if len(expr) > 1:
            return self.of({"and": [{k: v} for k, v in expr.items()]}, depth)
        ((name, value),) = expr.items()
        if name == "not":
            return ~self.of(value, depth + 1)
        if name in ("and", "or"):
            if not isinstance(value, list):
                return self.fail("bad-argument", json.dumps(name))
            parts = [self.of(x, depth + 1) for x in value]
            join = (lambda a, b: a & b) if name == "and" else (lambda a, b: a | b)
            return functools.reduce(join, parts, F.lit(name == "and"))
        if name not in PREDICATES:
            return self.fail("unknown-predicate", json.dumps(name))
        if not isinstance(value, str):
            return self.fail("bad-argument", json.dumps(name))
        if name in _CLOSED and value not in _CLOSED[name]:
            listed = " (" + ", ".join(LEVELS if name == "level" else ARROW_KINDS) + ")" if name != "taxon" else ""
            return self.fail("bad-value", f"{name}={json.dumps(value)}{listed}")
        return F.coalesce(getattr(self, "_" + name.replace("-", "_"))(value), F.lit(False))

    def _level(self, v: str) -> Column:
        return F.when(F.col("taxon") == "object", F.col("level") == v).when(F.col("taxon") == "morphism", (F.col("src_level") == v) & (F.col("dst_level") == v))

    def _kind_of(self, v: str) -> Column:
        self.asked.append(v)
        return (F.col("level") == "instance") & (F.col("of") == v)

    def _arrow_kind(self, v: str) -> Column:
        return (F.col("taxon") == "morphism") & (F.col("kind") == v)

    def _tied_to(self, v: str) -> Column:
        self.asked.append(v)
        return self.member(self.graph.tied_to(v))

    def _in_data_of(self, v: str) -> Column:
        self.asked.append(v)
        return self.member(self.graph.in_data_of(v))

    def _about(self, v: str) -> Column:
        self.asked.append(v)
        return self.member(self.graph.about_set(v))

    def _region(self, v: str) -> Column:
        own = F.col("region") == v
        ends = (F.col("src_region") == v) & (F.col("dst_region") == v)
        return F.when(F.col("region").isNotNull(), own).when(F.col("taxon") == "morphism", ends)

    def _taxon(self, v: str) -> Column:
        return F.col("taxon") == v

    def _id(self, v: str) -> Column:
        self.asked.append(v)
        return F.col("id") == v

    def _text(self, v: str) -> Column:
        low = v.lower()
        return F.contains(F.lower("id"), F.lit(low)) | F.contains(F.lower("title"), F.lit(low)) if low else F.lit(True)


@dataclass
class Result:
    """``ids`` (id, taxon) after the endpoint closure, and problems; empty where one is fatal."""

    ids: DataFrame
    problems: list[Problem]

    @property
    def fatal(self) -> bool:
        return any(p.fatal for p in self.problems)

    def counts(self) -> DataFrame:
        """One row: objects, arrows, trees, total."""
        t = F.col("taxon")
        return self.ids.agg(F.count_if(t == "object").alias("objects"), F.count_if(t == "morphism").alias("arrows"), F.count_if(~t.isin("object", "morphism")).alias("trees"), F.count("*").alias("total"))


def parse(text: str) -> tuple[object, list[Problem]]:
    """The expression in a text, or why there is none."""
    if not text.strip():
        return None, [Problem("empty", "", True)]
    try:
        return json.loads(text), []
    except ValueError as e:
        return None, [Problem("bad-json", str(e), True)]


def close_endpoints(matched: DataFrame, graph: Graph) -> DataFrame:
    """``matched`` (id, taxon, src, dst) and the existing ends of its arrows: (id, taxon)."""
    ends = graph.arrow_ends(matched.where("taxon = 'morphism'")).distinct()
    return matched.select("id", "taxon").union(graph.nodes.join(ends, "id", "left_semi").select("id", "taxon")).distinct()


def evaluate(expr, graph: Graph, notes: bool = False) -> Result:
    """Evaluate an expression (a value or JSON text).  ``notes`` also looks up ids that don't exist (one small read)."""
    problems: list[Problem] = []
    if isinstance(expr, str):
        expr, problems = parse(expr)
    compiled = _Compiled(graph)
    test = compiled.of(expr) if not problems else F.lit(False)
    problems = problems + compiled.problems
    if any(p.fatal for p in problems):
        return Result(graph.nodes.select("id", "taxon").limit(0), problems)
    rows = graph.with_ends
    for i, ids in enumerate(compiled.sets):
        rows = rows.join(ids.select("id").withColumn(f"_set{i}", F.lit(True)), "id", "left")
    if notes and compiled.asked:
        known = {r.id for r in graph.nodes.where(F.col("id").isin(compiled.asked)).select("id").distinct().collect()}
        problems += [Problem("unknown-id", json.dumps(x)) for x in compiled.asked if x not in known]
        problems += [Problem("no-data", json.dumps(x)) for x in _named(expr, "in-data-of") if x in known and graph.data.where(F.col("kind") == x).isEmpty()]
    return Result(close_endpoints(rows.where(test), graph), problems)


def _named(expr, name: str) -> list[str]:
    if isinstance(expr, list):
        return [y for x in expr for y in _named(x, name)]
    if isinstance(expr, dict):
        return [v for k, v in expr.items() if k == name and isinstance(v, str)] + [y for k, v in expr.items() if k in ("and", "or", "not") for y in _named(v, name)]
    return []


def describe(expr, titles: dict[str, str] | None = None, regions: dict[str, str] | None = None) -> str:
    """An expression as English."""
    titles, regions = titles or {}, regions or {}
    if isinstance(expr, list):
        expr = {"and": expr}
    if not isinstance(expr, dict) or not expr:
        return "?"
    if len(expr) > 1:
        return " and ".join(describe({k: v}, titles, regions) for k, v in expr.items())
    ((name, value),) = expr.items()
    if name == "not":
        return "not " + describe(value, titles, regions)
    if name in ("and", "or"):
        parts = [f"({describe(x, titles, regions)})" if isinstance(x, dict) and len(x) > 1 else describe(x, titles, regions) for x in (value if isinstance(value, list) else [])]
        return f" {name} ".join(parts) if parts else "everything" if name == "and" else "nothing"
    title = titles.get(value, value) if isinstance(value, str) else value
    says = {
        "level": "kinds of structure and the relations between them" if value == "kind" else "instances and the maps between them", "kind-of": f"instances of the kind {title}", "arrow-kind": f"arrows of kind {value}",
        "tied-to": f"everything around {title}", "in-data-of": f"the definition of the kind {title}", "region": f"region {regions.get(value, value) if isinstance(value, str) else value}",
        "about": f"around {title} (via about)", "taxon": f"taxon {value}", "id": str(title), "text": f'text "{value}"',
    }
    return says.get(name, f"{name}={value}")


def present(graph: Graph) -> DataFrame:
    """``what, value, rank``: levels, arrow kinds and taxa that occur, in closed-set order, and declared regions."""
    out = None
    for what, col, order in (("level", "level", LEVELS), ("arrow-kind", "kind", ARROW_KINDS), ("taxon", "taxon", list(TAXA))):
        rows = graph.nodes.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct().select(F.lit(what).alias("what"), "value", F.array_position(F.array(*[F.lit(x) for x in order]), F.col("value")).cast("int").alias("rank"))
        out = rows if out is None else out.union(rows)
    if graph.regions:
        declared = graph.nodes.sparkSession.createDataFrame([("region", r, i + 1) for i, (r, _) in enumerate(graph.regions)], "what string, value string, rank int")
        out = out.union(declared)
    return out


def chips(graph: Graph, kind_labels: dict[str, str] | None = None, taxon_labels: dict[str, str] | None = None) -> list[dict]:
    """Ready-made expressions for what occurs in the graph."""
    found: dict[str, list[str]] = {"level": [], "arrow-kind": [], "taxon": [], "region": []}
    for r in sorted(present(graph).collect(), key=lambda r: r.rank):
        found[r.what].append(r.value)
    kind_labels, taxon_labels, titles = kind_labels or {}, taxon_labels or {}, dict(graph.regions)
    chip = lambda i, group, label, expr: {"id": i, "group": group, "label": label, "expr": expr}
    out = [chip(f"level-{v}", "levels", label, {"level": v}) for v, label in (("kind", "structures and the relations between them"), ("instance", "instances and the maps between them")) if v in found["level"]]
    out += [chip("only-hom", "levels", "morphisms only", {"arrow-kind": "hom"})] if "hom" in found["arrow-kind"] else []
    out += [chip(f"region-{v}", "regions", titles.get(v, v), {"region": v}) for v in found["region"]]
    out += [chip(f"kind-{v}", "arrow kinds", kind_labels.get(v, v), {"arrow-kind": v}) for v in found["arrow-kind"]]
    return out + [chip(f"taxon-{v}", "taxa", taxon_labels.get(v, v), {"taxon": v}) for v in found["taxon"]]


def vocabulary(graph: Graph) -> DataFrame:
    """The grammar and the values that occur: ``part, name, detail``."""
    grammar = graph.nodes.sparkSession.createDataFrame([("predicate", n, f"{a}: {d}") for n, (a, d) in PREDICATES.items()], "part string, name string, detail string")
    values = present(graph).select(F.col("what").alias("part"), F.col("value").alias("name"), F.lit("").alias("detail"))
    objects = graph.nodes.where("taxon in ('object', 'morphism')").select(F.col("taxon").alias("part"), F.col("id").alias("name"), F.col("title").alias("detail"))
    return grammar.union(values).union(objects)


class Session:
    """The public face: apply, clear, hide, select, back and forward, with the rule that a filter that
    cannot be read or matches nothing leaves the one in force."""

    def __init__(self, graph: Graph):
        self.graph, self.expr, self.hidden, self.selected = graph, None, False, None
        self.steps, self.at = [(None, False, None)], 0

    def _step(self) -> None:
        now = (json.dumps(self.expr) if self.expr is not None else None, self.hidden, self.selected)
        if now != self.steps[self.at]:
            self.steps = [*self.steps[: self.at + 1], now]
            self.at += 1

    def _restore(self) -> None:
        text, self.hidden, self.selected = self.steps[self.at]
        self.expr = json.loads(text) if text else None

    def apply(self, expr) -> dict:
        result = evaluate(expr, self.graph, notes=True)
        parsed = parse(expr)[0] if isinstance(expr, str) else expr
        matched = [] if result.fatal else [r.id for r in result.ids.orderBy("id").toLocalIterator()]
        if matched:
            self.expr = parsed
            self._step()
        return {"ok": bool(matched), "matched": matched, "count": len(matched), "describe": describe(parsed), "errors": [str(p) for p in result.problems]}

    def clear(self) -> None:
        self.expr = None
        self._step()

    def hide(self, on: bool = True) -> None:
        self.hidden = on
        self._step()

    def select(self, node: str | None) -> None:
        self.selected = None if node == self.selected else node
        self._step()

    def close(self) -> None:
        self.select(None) if self.selected is not None else None

    def back(self) -> bool:
        moved = self.at > 0
        self.at -= moved
        self._restore()
        return moved

    def forward(self) -> bool:
        moved = self.at + 1 < len(self.steps)
        self.at += moved
        self._restore()
        return moved

    def link(self) -> str:
        """The state as a URL fragment."""
        from urllib.parse import quote

        parts = [f"filter={quote(json.dumps(self.expr, ensure_ascii=False, separators=(',', ':')))}"] if self.expr is not None else []
        parts += ["hide=1"] if self.hidden else []
        parts += [f"tree={quote(self.selected)}"] if self.selected else []
        return "#" + "&".join(parts) if parts else ""

    @staticmethod
    def read_link(link: str) -> dict:
        from urllib.parse import parse_qs

        got = {k: v[0] for k, v in parse_qs(link.lstrip("#")).items()}
        expr, problems = parse(got["filter"]) if "filter" in got else (None, [])
        return {"filter": expr, "hide": got.get("hide") == "1", "tree": got.get("tree"), "errors": [str(p) for p in problems]}


def paint(graph: Graph, matched: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """``id, state``: link set before filter; a half (trees or structure) without a match is not dimmed."""
    half = F.when(F.col("taxon").isin("object", "morphism"), F.lit("structure")).otherwise(F.lit("trees"))
    rows = graph.nodes.select("id", "taxon", half.alias("half")).join(matched.select("id", F.lit(True).alias("hit")), "id", "left")
    has = rows.where("hit").select("half").distinct().withColumn("some", F.lit(True))
    rows = rows.join(F.broadcast(has), "half", "left")
    if linked is not None:
        rows = rows.join(linked.select("id", F.lit(True).alias("linked")), "id", "left")
    else:
        rows = rows.withColumn("linked", F.lit(None).cast("boolean"))
    return rows.select("id", F.when(F.col("linked"), "link").when(F.col("hit"), "match").when(F.col("some"), "out").otherwise("plain").alias("state"))

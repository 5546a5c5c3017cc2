"""Projections that pages, indexes and the canvas are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor
from .ordering import place

#: Taxa that can be a statement, and words by readiness.
STATEMENTS = ("theorem", "lemma", "proposition", "corollary", "exercise", "example")
READY_LABELS = {"done": "mastered", "ready": "ready to read", "not": "not ready"}


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def index_items(trees: DataFrame, groups: DataFrame, dims: int, scales: DataFrame | None = None) -> DataFrame:
    """The items of a retrieval index in order of id, with the place of each one's vector.

    ``trees(id, taxon, title, teaches, requires, depends, standalone)``,
    ``groups(id, group)``, ``scales(id, scale)`` (none: not embedded).  Missing
    lists are empty, and a tree stands alone unless it says that it doesn't.
    """
    rows = place(trees, [], ["id"], "row").join(groups, "id", "left")
    rows = rows.join(scales, "id", "left") if scales is not None else rows.withColumn("scale", F.lit(None).cast("double"))
    return rows.select("id", "taxon", "title", *[_list(c).alias(c) for c in ("teaches", "requires", "depends")], "group", F.coalesce("standalone", F.lit(True)).alias("standalone"), (F.col("row") * dims).alias("offset"), "scale")


def page_nodes(trees: DataFrame, groups: DataFrame, dependencies: DataFrame, about: DataFrame) -> DataFrame:
    """``id, taxon, language, title, region, group, deps, about``: a node of the page, with references that exist only.

    ``trees(id, taxon, language, title, region)``, ``groups(id, group)``, ``dependencies(id, ref)``, ``about(id, pos, ref)``.
    """
    known = trees.select(F.col("id").alias("ref"))
    deps = dependencies.join(known, "ref", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("ref")).alias("deps"))
    told = about.join(known, "ref", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x["ref"]).alias("about"))
    rows = trees.join(groups, "id", "left").join(deps, "id", "left").join(told, "id", "left")
    return rows.select("id", "taxon", "language", "title", "region", "group", _list("deps").alias("deps"), _list("about").alias("about"))


def special_cases(arrows: DataFrame) -> DataFrame:
    """``id, special``: for each arrow that others name as ``generalized_by`` the ids of those, sorted."""
    return arrows.select(F.col("id").alias("of"), F.explode("generalized_by").alias("id")).groupBy("id").agg(F.array_sort(F.collect_set("of")).alias("special"))


def pair_up_to(arrows: DataFrame, known: DataFrame) -> DataFrame:
    """``id, inverse, up_to``: an arrow's own ``up_to`` if that tree exists, else its inverse's."""
    there = known.select(F.col("id").alias("up_to"))
    named = arrows.where("inverse is not null")
    own = named.join(there, "up_to", "left_semi").select("id", F.col("up_to").alias("own"))
    other = arrows.join(there, "up_to", "left_semi").select(F.col("id").alias("inverse"), F.col("up_to").alias("other"))
    return named.select("id", "inverse").join(own, "id", "left").join(other, "inverse", "left").select("id", "inverse", F.coalesce("own", "other").alias("up_to"))


def labelled(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts(id, part, token)`` with ``label`` from ``labels(token, label)``, else the token itself."""
    return facts.join(labels, "token", "left").select("id", "part", "token", F.coalesce("label", "token").alias("label"))


# The canvas: boxes(canvas, id, x, y, w, h), edges(canvas, id, src, dst)

def extent(frames: DataFrame) -> DataFrame:
    """``canvas, w, h``: how far the frames reach that are not ``gone`` (0 if none is left)."""
    shown = lambda at: F.coalesce(F.max(F.when(~F.coalesce("gone", F.lit(False)), at)), F.lit(0.0))
    return frames.groupBy("canvas").agg(F.greatest(F.lit(0.0), shown(F.col("x") + F.col("w"))).alias("w"), F.greatest(F.lit(0.0), shown(F.col("y") + F.col("h"))).alias("h"))


def local_positions(boxes: DataFrame, origins: DataFrame) -> DataFrame:
    """``id, x, y``: places as they are saved, relative to the region's origin (0 where it has none), rounded half up."""
    rows = boxes.join(origins.select("region", F.col("x").alias("ox"), F.col("y").alias("oy")), "region", "left")
    near = lambda a, o: F.floor(F.col(a) - F.coalesce(o, F.lit(0.0)) + 0.5).cast("long")
    return rows.select("id", near("x", "ox").alias("x"), near("y", "oy").alias("y"))


def ports(boxes: DataFrame, edges: DataFrame, height: float = 46.0) -> DataFrame:
    """``canvas, id, end, side, x, y``: where each edge leaves (end 0) and enters (1) its boxes.

    An edge leaves on the side where the other box lies, on the right where
    both are in one column; along a side ports stand in the order of the other
    ends' height, then of the edges.  Loops have none.
    """
    side = lambda p: boxes.select("canvas", F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "w")])
    rows = edges.where("src != dst").join(side("src"), ["canvas", "src"]).join(side("dst"), ["canvas", "dst"])
    mid = lambda p: F.col(f"{p}_x") + F.col(f"{p}_w") / 2

    def end(k: int, own: str, other: str) -> DataFrame:
        away = F.when(mid(other) < mid(own), "l").otherwise("r") if k == 0 else F.when(mid(own) > mid(other), "l").otherwise("r")
        return rows.select("canvas", "id", F.lit(k).alias("end"), away.alias("side"), F.col(own).alias("box"), F.col(f"{own}_x").alias("bx"), F.col(f"{own}_y").alias("by"), F.col(f"{own}_w").alias("bw"), F.col(f"{other}_y").alias("other"))

    of = Window.partitionBy("canvas", "box", "side")
    both = end(0, "src", "dst").union(end(1, "dst", "src")).withColumn("n", F.row_number().over(of.orderBy("other", "id", "end"))).withColumn("m", F.count("*").over(of))
    return both.select("canvas", "id", "end", "side", (F.col("bx") + F.when(F.col("side") == "r", F.col("bw")).otherwise(F.lit(0.0))).alias("x"), (F.col("by") + height * F.col("n") / (F.col("m") + 1)).alias("y"))


def loop_slots(boxes: DataFrame, loops: DataFrame, pitch: float = 30.0) -> DataFrame:
    """``canvas, id, right``: the right foot of each loop on its box's top side, closer where there are many."""
    of = Window.partitionBy("canvas", "box")
    rows = loops.where("src = dst").select("canvas", "id", F.col("src").alias("box")).withColumn("n", F.row_number().over(of.orderBy("id")) - 1).withColumn("m", F.count("*").over(of))
    step = F.least(F.lit(pitch), (F.col("w") - 28) / F.col("m"))
    return rows.join(boxes.select("canvas", F.col("id").alias("box"), "x", "w"), ["canvas", "box"]).select("canvas", "id", (F.col("x") + F.col("w") - 12 - F.col("n") * step).alias("right"))


def tag_room(boxes: DataFrame, tag: float = 18.0, gap: float = 6.0) -> DataFrame:
    """``canvas, id, room``: how wide a tag under a box may be before it meets the next box to the right; null without one.

    A canvas is what is seen at once, so its boxes are compared with each other.
    """
    other = boxes.select("canvas", F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("w").alias("qw"), F.col("h").alias("qh"))
    top = F.col("y") + F.col("h") + 2
    near = boxes.join(other, "canvas").where((F.col("q") != F.col("id")) & (top <= F.col("qy") + F.col("qh")) & (F.col("qy") <= top + tag) & (F.col("qx") + F.col("qw") > F.col("x")))
    room = near.groupBy("canvas", "id").agg(F.min(F.col("qx") - gap - F.col("x")).alias("room"))
    return boxes.select("canvas", "id").join(room, ["canvas", "id"], "left")


def overlay(asked: DataFrame, instances: DataFrame, arrows: DataFrame) -> DataFrame:
    """``view, what, ref``: ties and type edges that are raised on demand.

    ``asked(view, how, ref)``: a hovered or selected ``box``, a hovered or
    selected ``edge``, a hovered or pinned ``type`` (``k1>k2``); a view with
    ``focus`` shows none.  An edge raises its type and the ties of its ends.
    """
    quiet = asked.where("how = 'focus'").select("view")
    asked = asked.join(quiet, "view", "left_anti")
    of = lambda p: instances.select(F.col("id").alias(p), F.col("of").alias(f"{p}_of"))
    ends = asked.where("how = 'edge'").join(arrows.select(F.col("id").alias("ref"), "src", "dst"), "ref").join(of("src"), "src").join(of("dst"), "dst")
    boxes = asked.where("how = 'box'").select("view", "ref").union(ends.select("view", F.explode(F.array("src", "dst")).alias("ref")))
    ties = boxes.join(instances.select(F.col("id").alias("ref")), "ref", "left_semi").select("view", F.lit("tie").alias("what"), "ref")
    types = ends.select("view", F.concat_ws(">", "src_of", "dst_of").alias("ref")).union(asked.where("how = 'type'").select("view", "ref"))
    return ties.union(types.select("view", F.lit("type").alias("what"), "ref")).distinct()


def pair_state(pairs: DataFrame, lit: DataFrame, hide: bool = False) -> DataFrame:
    """``pairs(a, b)`` with ``state``: ``lit`` where both ends are lit, else ``dim``, or not there if ``hide``."""
    end = lambda p: lit.select(F.col("id").alias(p), F.lit(True).alias(f"_{p}"))
    rows = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").withColumn("state", F.when(F.col("_a") & F.col("_b"), "lit").otherwise("dim")).drop("_a", "_b")
    return rows.where("state = 'lit'") if hide else rows


# Figures, bundles, sessions

def definition_figures(members: DataFrame, arrows: DataFrame) -> DataFrame:
    """``kind, source``: the diagram of each kind's definition, three instances in a row, with the arrows between them.

    ``members(kind, pos, id, taxon, symbol)``, ``arrows(id, src, dst, label)``.
    """
    of = Window.partitionBy("kind").orderBy("pos")
    boxes = members.where("taxon = 'object'").withColumn("n", F.row_number().over(of) - 1)
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    corner = F.concat(F.lit("C"), F.col("n"), F.lit(" @ "), F.col("n") % 3, F.lit(","), F.floor(F.col("n") / 3), F.lit(" : "), squeezed(F.coalesce("symbol", "id")))
    name = lambda p: boxes.select("kind", F.col("id").alias(p), F.concat(F.lit("C"), "n").alias(f"{p}_name"))
    drawn = members.where("taxon = 'morphism'").select("kind", "pos", "id").join(arrows, "id").join(name("src"), ["kind", "src"]).join(name("dst"), ["kind", "dst"])
    label = squeezed(F.coalesce("label", F.lit("")))
    line = F.concat("src_name", F.lit(" -> "), "dst_name", F.when(label != "", F.concat(F.lit(" : "), label, F.lit(" [above]"))).otherwise(F.lit("")))
    lines = boxes.select("kind", F.lit(0).alias("part"), F.col("n").cast("long").alias("at"), corner.alias("line")).union(drawn.select("kind", F.lit(1), F.col("pos").cast("long"), line))
    source = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("kind").agg(F.concat(F.lit("% title: Defining diagram\n"), source).alias("source"))


def chain_figure(symbol: Column, label: Column) -> Column:
    """The diagram of an arrow from a box to itself, unrolled into a chain."""
    x, f = (F.trim(F.regexp_replace(F.coalesce(c, F.lit(d)), r"\s+", " ")) for c, d in ((symbol, "X"), (label, "f")))
    rows = [F.concat(F.lit(f"{n} @ {k},0 : "), x) for k, n in enumerate("ABC")] + [F.lit("D @ 3,0 : \\cdots")] + [F.concat(F.lit(f"{a} -> {b} : "), f, F.lit(" [above]")) for a, b in ("AB", "BC", "CD")]
    return F.concat_ws("\n", F.lit("% title: As a chain"), *rows)


def statement_and_second(pairs: DataFrame) -> DataFrame:
    """``pairs(pair, first, first_taxon, second, second_taxon)`` with ``statement`` and ``proof``: by taxon, else in the given order; null if neither tells."""
    states = lambda c: F.col(c).isin(*STATEMENTS)
    a, b = states("first_taxon"), states("second_taxon")
    turned = (F.col("first_taxon") == "proof") & b
    clear = turned | a
    return pairs.select("pair", F.when(turned, F.col("second")).when(clear, F.col("first")).alias("statement"), F.when(turned, F.col("first")).when(clear, F.col("second")).alias("proof"))


def blog_sections(picked: DataFrame) -> DataFrame:
    """``blog, title, concepts, verdicts`` for ``picked(blog, place, title, taxon, standalone, teaches)``: the first title, and concepts and verdict of each section by anchor."""
    of = F.array_sort(F.collect_list(F.struct("place", "title", anchor(F.col("title")).alias("at"), F.array_sort(_list("teaches")).alias("teaches"), F.struct("taxon", F.coalesce("standalone", F.lit(False)).alias("standalone")).alias("verdict"))))
    rows = picked.groupBy("blog").agg(of.alias("rows"))
    return rows.select("blog", F.col("rows")[0]["title"].alias("title"), F.transform("rows", lambda r: F.struct(r["at"].alias("at"), r["teaches"].alias("teaches"))).alias("concepts"), F.transform("rows", lambda r: F.struct(r["at"].alias("at"), r["verdict"]["taxon"].alias("taxon"), r["verdict"]["standalone"].alias("standalone"))).alias("verdicts"))


def flattened_links(bodies: DataFrame, resolved: DataFrame, pattern: str = r"\[\[([^\[\]|#]+)(?:\|([^\]]*))?\]\]") -> tuple[DataFrame, DataFrame]:
    """Bodies with links renamed, or as plain text where they don't resolve, and the notes on these.

    ``bodies(id, body)``, ``resolved(target, new)``.  Returns ``(id, body)`` and ``(id, target)``.
    """
    pieces = F.split("body", pattern, -1)
    rows = bodies.select("id", pieces.alias("pieces"), F.transform(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)), lambda x: F.trim(x)).alias("targets"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("labels"), F.regexp_extract_all("body", F.lit(pattern), F.lit(0)).alias("whole"))
    each = rows.select("id", F.posexplode(F.arrays_zip("targets", "labels", "whole")).alias("pos", "l")).select("id", "pos", F.col("l.targets").alias("target"), F.col("l.labels").alias("label"), F.contains("l.whole", F.lit("|")).alias("has_label"))
    each = each.join(resolved, "target", "left")
    put = F.when(F.col("new").isNotNull(), F.concat(F.lit("[["), F.col("new"), F.when(F.col("has_label"), F.concat(F.lit("|"), F.col("label"))).otherwise(F.lit("")), F.lit("]]"))).otherwise(F.when(F.col("has_label"), F.col("label")).otherwise(F.col("target")))
    made = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", put.alias("put")))), lambda x: x["put"]).alias("puts"))
    out = rows.join(made, "id", "left").select("id", F.array_join(F.flatten(F.zip_with("pieces", F.coalesce("puts", F.array().cast("array<string>")), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "").alias("body"))
    return out, each.where("new is null").select("id", "target")


def figures(bodies: DataFrame, about: DataFrame) -> DataFrame:
    """``tree, from, at``: the diagrams of each tree, its own first (from null), then those of trees about it in order of id."""
    drawn = bodies.select("id", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)```cd\n(.*?)```"), F.lit(1))).alias("at", "source"))
    own = drawn.select(F.col("id").alias("tree"), F.lit(None).cast("string").alias("from"), "at", "source")
    told = drawn.join(about.select(F.col("src").alias("id"), F.col("dst").alias("tree")), "id").select("tree", F.col("id").alias("from"), "at", "source")
    return own.union(told)


def last_section(notes: Column) -> Column:
    """The last second-level section of notes with its heading; all of them without one."""
    parts = F.split(F.concat(F.lit("\n"), notes), "\n## ")
    return F.when(F.size(parts) > 1, F.concat(F.lit("## "), F.element_at(parts, -1))).otherwise(notes)


def status_fallback(polls: DataFrame, key: str, order: str) -> DataFrame:
    """``polls`` (status null where a state can't be read, ``unchanged`` polls left out) with ``shown``: the last status that was read, at first ``active``."""
    seen = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return polls.where("not unchanged").withColumn("shown", F.coalesce(F.last("status", ignorenulls=True).over(seen), F.lit("active")))


def changed_since(files: DataFrame, since: DataFrame) -> DataFrame:
    """``session, rev``: sessions whose revision differs from what was seen.

    ``files(session, file, mtime)`` (one row for each of state and notes that
    is there), ``since(session, rev)``.  A revision is the two times, ``-`` for
    a missing file.
    """
    time = lambda name: F.coalesce(F.max(F.when(F.col("file") == name, F.col("mtime"))).cast("string"), F.lit("-"))
    now = files.groupBy("session").agg(F.concat_ws("/", time("state.json"), time("notes.md")).alias("rev"))
    return now.join(since.select("session", "rev"), ["session", "rev"], "left_anti")


def scoped_key(title: Column, created: Column) -> Column:
    """The key under which one corpus keeps its progress, session and view."""
    return F.concat_ws("|", title, created)


def request_id(at: Column, seed: Column) -> Column:
    """Fourteen digits of UTC, a dash, six hexadecimal digits."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.md5(seed), 1, 6))


def proposed_slug(stamp: Column, previous: Column) -> Column:
    """``sesija-`` and the minute; a number is added where the last session began in that minute."""
    base = F.concat(F.lit("sesija-"), stamp)
    last = F.regexp_extract(F.substr(previous, F.length(base) + 1), r"^-([0-9]+)$", 1)
    again = F.coalesce(F.startswith(previous, base), F.lit(False))
    return F.when(~again, base).otherwise(F.concat(base, F.lit("-"), F.when(last != "", last.cast("int") + 1).otherwise(F.lit(2)).cast("string")))


def ready_label(state: Column) -> Column:
    """A state in words."""
    return F.coalesce(*[F.when(state == k, F.lit(v)) for k, v in READY_LABELS.items()], F.lit(READY_LABELS["not"]))


def resume_at(inventory: DataFrame) -> DataFrame:
    """``chapter, ref, pending, authored, skipped``: where to go on in each chapter (null if all is done) and how far it is."""
    count = lambda what: F.count_if(F.col("status").startswith(what)).alias(what)
    return inventory.groupBy("chapter").agg(F.min_by("ref", F.when(F.col("status") == "pending", F.col("place"))).alias("ref"), count("pending"), count("authored"), count("skipped"))


def grow_candidates(trees: DataFrame, derivative: bool) -> DataFrame:
    """Trees that may be offered to a library: not yet there, and of a derived corpus only what its members or agents made."""
    free = trees.where("x_library is null")
    return free.where("origin in ('member', 'agent')") if derivative else free

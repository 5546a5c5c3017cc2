"""Derived views: type edges, propagation, reading groups, readiness, concepts, pages of structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import ARROW_KINDS, PROVABLE
from .graph import saved
from .ordering import place, running


def kind_rank(kind: Column) -> Column:
    """Place in the palette order of arrow kinds."""
    return F.array_position(F.array(*[F.lit(k) for k in ARROW_KINDS]), kind).cast("int")


def type_edge_arrows(arrows: DataFrame, instances: DataFrame) -> DataFrame:
    """Arrows between two instances with the kinds of these: ``id, kind, k1, k2, n``."""
    of = lambda side, k: instances.select(F.col("id").alias(side), F.col("of").alias(k))
    return arrows.join(of("src", "k1"), "src").join(of("dst", "k2"), "dst").select("id", "kind", "k1", "k2", "n")


def type_edges(arrows: DataFrame, instances: DataFrame) -> DataFrame:
    """``k1, k2, arrows, lines``: the projection of arrows on kinds."""
    return type_edge_arrows(arrows, instances).groupBy("k1", "k2").agg(F.count("*").alias("arrows"), F.sum("n").alias("lines"))


def kind_level_between(arrows: DataFrame, edges: DataFrame) -> DataFrame:
    """Arrows between two kinds that a type edge joins too: ``id, kind, k1, k2, arrows``."""
    return arrows.join(edges, (F.col("src") == F.col("k1")) & (F.col("dst") == F.col("k2"))).select("id", "kind", "k1", "k2", "arrows")


def inverse_pairs(arrows: DataFrame) -> DataFrame:
    """Arrows that name each other as ``inverse`` as one edge, kept by the smaller id: ``id, inverse, a, b, up_to``.

    ``arrows(id, kind, src, dst, inverse, up_to)``; arrows of kind ``instance``
    and one-sided or own inverses make no pair; the edge is up to something if
    either arrow is.
    """
    drawn = arrows.where("kind != 'instance'")
    back = drawn.select(F.col("id").alias("inverse"), F.col("inverse").alias("named"), F.col("up_to").alias("back_up_to"))
    joined = drawn.join(back, "inverse").where("named = id and id < inverse")
    return joined.select("id", "inverse", F.col("src").alias("a"), F.col("dst").alias("b"), (F.coalesce("up_to", F.lit(False)) | F.coalesce("back_up_to", F.lit(False))).alias("up_to"))


def box_arrows(arrows: DataFrame) -> DataFrame:
    """For each box the arrows out of and into it, by kind: ``box, way, kind, rank, n, first``."""
    out = arrows.select(F.col("src").alias("box"), F.lit("out").alias("way"), "kind", "id").union(arrows.select(F.col("dst").alias("box"), F.lit("in").alias("way"), "kind", "id"))
    return out.groupBy("box", "way", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("rank", kind_rank(F.col("kind")))


def instance_page(instances: DataFrame, arrows: DataFrame, kind_data: DataFrame, about: DataFrame) -> DataFrame:
    """``id, part, ref``: for each instance its kind's arrows, maps out and in (loops only out), kinds whose diagram has it, and what is about it or its kind."""
    me = instances.select("id", "of")
    part = lambda rows, name: rows.select("id", F.lit(name).alias("part"), "ref")
    kinds = arrows.where("kind != 'hom'").select(F.col("src").alias("of"), F.col("id").alias("ref"))
    return (
        part(me.join(kinds, "of"), "kind-arrow")
        .union(part(arrows.select(F.col("src").alias("id"), F.col("id").alias("ref")).join(me, "id"), "out"))
        .union(part(arrows.where("src != dst").select(F.col("dst").alias("id"), F.col("id").alias("ref")).join(me, "id"), "in"))
        .union(part(kind_data.select(F.col("member").alias("id"), F.col("kind").alias("ref")).join(me, "id"), "in-data"))
        .union(part(about.select(F.col("dst").alias("id"), F.col("src").alias("ref")).join(me, "id"), "about"))
        .union(part(about.select(F.col("dst").alias("of"), F.col("src").alias("ref")).join(me, "of"), "about-kind"))
    )


def instance_page_counts(instances: DataFrame, arrows: DataFrame, kind_data: DataFrame, about: DataFrame) -> DataFrame:
    """``id, part, n, first``: how many refs each part of ``instance_page`` has, and the least.

    What the instances of a kind share is counted once for the kind, and what
    names an instance before it is joined, so no row stands for a pair of an
    instance and a ref of its kind.  Arrows are read once for both ends.
    """
    me = instances.select("id", "of")
    rows = lambda df, key, name: df.select(F.col(key).alias("key"), F.lit(name).alias("part"), "ref")
    counted = lambda df, key: df.where("key is not null").groupBy(F.col("key").alias(key), "part").agg(F.count("*").alias("n"), F.min("ref").alias("first"))
    ends = F.array(F.struct(F.col("src").alias("key"), F.lit("out").alias("part")), F.struct(F.when(F.expr("src != dst"), F.col("dst")).alias("key"), F.lit("in").alias("part")))
    told = about.select("dst", F.col("src").alias("ref"))
    of_id = counted(arrows.select(F.inline(ends), F.col("id").alias("ref")).union(rows(kind_data.withColumn("ref", F.col("kind")), "member", "in-data")).union(rows(told, "dst", "about")), "id")
    of_kind = counted(rows(arrows.where("kind != 'hom'").withColumn("ref", F.col("id")), "src", "kind-arrow").union(rows(told, "dst", "about-kind")), "of")
    page = me.join(of_id, "id").select("id", "part", "n", "first").union(me.join(of_kind, "of").select("id", "part", "n", "first"))
    # An instance listed twice has each ref twice.
    return page.groupBy("id", "part").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def generalizes_propagation(arrows: DataFrame, instances: DataFrame, about: DataFrame) -> DataFrame:
    """One hop over ``generalizes``: instances go up to the target, theorems down to the source: ``kind, what, ref, via``."""
    up = arrows.where("kind = 'generalizes'").select(F.col("src").alias("low"), F.col("dst").alias("high"))
    none = F.lit(None).cast("string")
    own = instances.select(F.col("of").alias("kind"), F.lit("instance").alias("what"), F.col("id").alias("ref"), none.alias("via"))
    lifted = instances.join(up, F.col("of") == F.col("low")).select(F.col("high").alias("kind"), F.lit("instance").alias("what"), F.col("id").alias("ref"), F.col("low").alias("via"))
    told = about.select(F.col("dst").alias("kind"), F.lit("theorem").alias("what"), F.col("src").alias("ref"), none.alias("via"))
    lowered = about.join(up, F.col("dst") == F.col("high")).select(F.col("low").alias("kind"), F.lit("theorem").alias("what"), F.col("src").alias("ref"), F.col("high").alias("via"))
    return own.union(lifted).union(told).union(lowered)


def proof_anchor(proofs: DataFrame, dependencies: DataFrame, trees: DataFrame) -> DataFrame:
    """``id, anchor``: what each proof proves: ``proves`` where it resolves, else the first provable dependency in list order.

    ``proofs(id, proves)``, ``dependencies(id, pos, ref)``, ``trees(id, taxon)``.
    """
    provable = trees.where(F.col("taxon").isin(PROVABLE)).select(F.col("id").alias("ref"))
    first = dependencies.join(provable, "ref").groupBy("id").agg(F.min_by("ref", "pos").alias("first"))
    named = proofs.join(trees.select(F.col("id").alias("proves"), F.col("id").alias("named")), "proves", "left")
    return named.join(first, "id", "left").select("id", F.coalesce("named", "first").alias("anchor"))


def theorems_by_field(theorems: DataFrame) -> DataFrame:
    """``field, last, n, first``: theorems by field, those without under ``other``, which sorts last."""
    each = theorems.dropDuplicates(["id"]).withColumn("field", F.explode(F.when(F.size("fields") > 0, F.col("fields")).otherwise(F.array(F.lit("other")))))
    return each.groupBy("field").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("last", (F.col("field") == "other").cast("int"))


def readiness(trees: DataFrame, dependencies: DataFrame, done: DataFrame) -> DataFrame:
    """``id, state``: done; ready where all dependencies are done (so where there are none); else not."""
    marks = done.select("id", F.lit(True).alias("done"))
    met = dependencies.join(marks.select(F.col("id").alias("ref"), "done"), "ref", "left").groupBy("id").agg(F.every(F.coalesce("done", F.lit(False))).alias("met"))
    rows = trees.select("id").join(marks, "id", "left").join(met, "id", "left")
    return rows.select("id", F.when(F.col("done"), "done").when(F.coalesce("met", F.lit(True)), "ready").otherwise("not").alias("state"))


def group_progress(states: DataFrame, groups: DataFrame) -> DataFrame:
    """``section, total, mastered, any_ready, outline`` for groups(id, section)."""
    rows = groups.join(states, "id").groupBy("section").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "done").alias("mastered"), F.some(F.col("state") == "ready").alias("any_ready"))
    return rows.withColumn("outline", F.when(F.col("total") == F.col("mastered"), "mastered").when(F.col("any_ready"), "ready").otherwise("muted"))


def first_section(links: DataFrame) -> DataFrame:
    """``id, section, link``: of the sections that list a tree, the first wins."""
    row = F.row_number().over(Window.partitionBy("id").orderBy("section", "link"))
    return links.withColumn("row", row).where("row = 1").select("id", "section", "link")


def build_groups(links: DataFrame, trees: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Reading groups ``id, section, pass, place``: listed members, then proofs, instances, morphisms, then the rest.

    A proof joins the group of what it proves (``proves``, else its first
    provable dependency), which may be another proof with a smaller id; an
    instance that of its kind; an arrow that of its source, else its target.
    Whoever is left is in section null.  ``trees(id, taxon, proves, instance_of, src, dst)``.
    """
    have = saved(first_section(links).join(trees.select("id"), "id", "left_semi").select("id", "section", F.lit(0).alias("pass"), F.col("link").cast("string").alias("key")))
    anchors = proof_anchor(trees.where("taxon = 'proof'").select("id", "proves"), dependencies, trees.select("id", "taxon")).where("anchor is not null")
    waiting = saved(anchors.join(have.select("id"), "id", "left_anti"))
    new = have.select("id", "section", "pass")
    # Each round only what was placed in the one before can place more.
    while True:
        new = saved(waiting.join(new.select(F.col("id").alias("anchor"), "section", F.col("pass").alias("p")), "anchor").where("p = 0 or anchor < id").select("id", "section", F.lit(1).alias("pass"), F.col("id").alias("key")))
        if new.isEmpty():
            break
        have = have.union(new)
    for number, cond, refs in ((2, "taxon = 'object' and instance_of is not null", ("instance_of",)), (3, "taxon = 'morphism'", ("src", "dst"))):
        free = trees.where(cond).join(have.select("id"), "id", "left_anti")
        for ref in refs:
            free = free.join(have.select(F.col("id").alias(ref), F.col("section").alias(f"{ref}_section")), ref, "left")
        placed = free.withColumn("section", F.coalesce(*[F.col(f"{r}_section") for r in refs])).where("section is not null")
        have = have.union(placed.select("id", "section", F.lit(number).alias("pass"), F.col("id").alias("key")))
    rest = trees.select("id").join(have.select("id"), "id", "left_anti").select("id", F.lit(None).cast("int").alias("section"), F.lit(4).alias("pass"), F.col("id").alias("key"))
    every = have.union(rest).withColumn("link", F.when(F.col("pass") == 0, F.col("key").cast("int")))
    return place(every, ["section"], ["pass", "link", "key", "id"], "before").select("id", "section", "pass", (F.col("before") + 1).cast("int").alias("place"))


def index_groups(links: DataFrame, trees: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The index's variant ``id, title``: sections merged by title; instances first, then proofs and arrows in one pass in id order,
    a proof by its first grouped dependency of any taxon."""
    have = first_section(links.withColumn("title", F.col("title"))).join(links.select("section", "title").distinct(), "section").select("id", "title")
    free = trees.where("taxon = 'object' and instance_of is not null").join(have.select("id"), "id", "left_anti")
    have = have.union(free.join(have.select(F.col("id").alias("instance_of"), "title"), "instance_of").select("id", "title"))
    arrows = trees.where("taxon = 'morphism'").join(have.select("id"), "id", "left_anti")
    src, dst = (have.select(F.col("id").alias(s), F.col("title").alias(f"{s}_title")) for s in ("src", "dst"))
    have = saved(have.union(arrows.join(src, "src", "left").join(dst, "dst", "left").withColumn("title", F.coalesce("src_title", "dst_title")).where("title is not null").select("id", "title")))
    while True:
        proofs = trees.where("taxon = 'proof'").join(have.select("id"), "id", "left_anti")
        near = dependencies.join(have.select(F.col("id").alias("ref"), "title"), "ref").groupBy("id").agg(F.min_by(F.struct("title", "ref"), "pos").alias("g"))
        new = saved(proofs.join(near, "id").select("id", "g.title"))
        if new.isEmpty():
            return have
        have = have.union(new)


def group_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b, name``: dependencies between different sections, distinct; sorted by the text ``a>b``."""
    side = lambda end, name: groups.select(F.col("id").alias(end), F.col("section").alias(name))
    rows = edges.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a != b").select("a", "b").distinct()
    return rows.withColumn("name", F.concat_ws(">", F.col("a").cast("string"), F.col("b").cast("string")))


def by_concept(teaches: DataFrame, walk: DataFrame) -> DataFrame:
    """``concept, first, trees``: trees that teach a concept in walk order; concepts by first appearance."""
    rows = teaches.join(walk, "id").groupBy("concept").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "id"))).alias("rows"))
    return rows.select("concept", "first", F.transform("rows", lambda r: r["id"]).alias("trees"))


def last_heading(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``lines`` with ``heading`` filled from the nearest line at or before that has one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last("heading", ignorenulls=True).over(w))


def chunked(rows: DataFrame, by: list[str], order: list[str], size: int = 15, step: int = 64) -> DataFrame:
    """``rows`` with ``chunk`` and ``offset`` by their place in a group."""
    ranked = place(rows, by, order, "_place")
    return ranked.withColumn("chunk", F.floor(F.col("_place") / size)).withColumn("offset", (F.col("_place") * step).cast("long")).drop("_place")


def references(pages: DataFrame, known: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """Each reference that ``pattern`` finds in a text, ``(id, target, alive)``: whether ``known(target)`` has it."""
    found = pages.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1))).alias("target"))
    return found.join(known.select("target").distinct().withColumn("alive", F.lit(True)), "target", "left").select(id_col, "target", F.coalesce("alive", F.lit(False)).alias("alive"))


def unknown_keys(rows: DataFrame, id_col: str, json_col: str, known: list[str], own: str = "x_") -> DataFrame:
    """``(id, key)`` of the keys of JSON objects that are not known and no extension."""
    keys = F.array_except(F.json_object_keys(json_col), F.array(*[F.lit(k) for k in known]))
    return rows.select(id_col, F.explode(F.filter(keys, lambda k: ~F.startswith(k, F.lit(own)))).alias("key"))


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys on several rows, with ``n``."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def stacked(heights: DataFrame, by: list[str], gap: float = 26.0) -> DataFrame:
    """``heights`` with the running offset ``y`` of what stands before."""
    return running(heights, by, ["place"], F.col("height") + gap, "y")


def parallel_offsets(arrows: DataFrame, step: float = 15.0, most: float = 45.0) -> DataFrame:
    """``id, offset``: arrows between one unordered pair spread around its middle."""
    pair = [F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")]
    w = Window.partitionBy("lo", "hi")
    rows = arrows.select("id", *pair).withColumn("n", F.row_number().over(w.orderBy("id")) - 1).withColumn("m", F.count("*").over(w))
    return rows.select("id", F.greatest(F.lit(-most), F.least(F.lit(most), (F.col("n") - (F.col("m") - 1) / 2) * step)).alias("offset"))


def component_anchors(kind_data: DataFrame, arrows: DataFrame) -> DataFrame:
    """``id, kinds``: for each arrow the kinds whose diagram lists it."""
    return kind_data.join(arrows.select(F.col("id").alias("member")), "member", "left_semi").groupBy(F.col("member").alias("id")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def visible(nodes: DataFrame, proofs: bool = False, exercises: bool | None = None, few: int = 8) -> DataFrame:
    """Trees that show: proofs and exercises only if asked for; exercises without asking where there are few."""
    if exercises is None:
        exercises = nodes.where("taxon = 'exercise'").limit(few + 1).count() <= few
    hidden = [t for t, on in (("proof", proofs), ("exercise", exercises)) if not on]
    return nodes.where(~F.col("taxon").isin(hidden)) if hidden else nodes


def lit_groups(groups: DataFrame, matched: DataFrame) -> DataFrame:
    """``section, lit``: whether any member is matched."""
    return groups.join(matched.select("id", F.lit(True).alias("hit")), "id", "left").groupBy("section").agg(F.some(F.coalesce("hit", F.lit(False))).alias("lit"))


def values_on_instances(instances: DataFrame, arrow: str, source: str) -> DataFrame:
    """``id, value``: instances of an arrow's source that give it a value."""
    return instances.where((F.col("of") == source) & F.map_contains_key("values", arrow)).select("id", F.element_at("values", arrow).alias("value"))

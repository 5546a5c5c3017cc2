"""Registered queries over page projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import merge as M
from ..operators import pages as P
from .model import Model, keyed
from .registry import _TARGET, _merge_sides, query


@query("""SELECT t.id, t.taxon, t.title, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [language] END AS teaches, [] ::VARCHAR[] AS requires, coalesce(d.refs, []) AS depends, section AS group, doc_id % 7 != 0 AS standalone,
(row_number() OVER (ORDER BY t.id) - 1) * 64 AS "offset", round(s.scale, 8) AS scale
FROM trees t LEFT JOIN (SELECT i, list('doc-' || j ORDER BY pos) AS refs FROM dependencies GROUP BY i) d ON d.i = t.doc_id
LEFT JOIN (SELECT vec_id, CASE WHEN m = 0 THEN 1.0 ELSE m / 127 END AS scale FROM (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings)) s ON s.vec_id = t.doc_id""", "trees", "dependencies")
def index_items(m: Model) -> DataFrame:
    depends = m.dependencies.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: keyed("doc", x["j"])).alias("depends"))
    none = F.lit(None).cast("array<string>")
    trees = m.trees.join(depends, F.col("doc_id") == F.col("i"), "left").select("id", "taxon", "title", F.when(F.col("doc_id") % 4 != 0, F.array("language")).alias("teaches"), none.alias("requires"), "depends", F.when(F.col("doc_id") % 7 == 0, F.lit(False)).alias("standalone"))
    scales = m.table("embeddings").select(keyed("doc", "vec_id").alias("id"), F.round(V.scale(F.col("embedding")), 8).alias("scale"))
    return P.index_items(trees, m.trees.select("id", F.col("section").alias("group")), 64, scales)


@query("""SELECT t.id, t.taxon, t.language, t.title, CASE WHEN doc_id % 5 = 0 THEN 'EUROPE' END AS region, section AS group, coalesce(list_sort(d.refs), []) AS deps, CASE WHEN t.taxon IN ('theorem', 'lemma', 'proposition', 'corollary') AND doc_id % 2 = 0 THEN ['doc-' || doc_id // 2] ELSE [] END AS about
FROM trees t LEFT JOIN (SELECT i, list('doc-' || j) AS refs FROM dependencies WHERE j % 3 != 1 GROUP BY i) d ON d.i = t.doc_id""", "trees", "dependencies")
def page_nodes(m: Model) -> DataFrame:
    """Dependencies on documents of one class are renamed to ids that don't exist, and so is every second ``about``."""
    lost = lambda c, gone: F.when(gone, F.concat(F.lit("lost-"), c.cast("string"))).otherwise(keyed("doc", c))
    deps = m.dependencies.select(keyed("doc", "i").alias("id"), lost(F.col("j"), F.col("j") % 3 == 1).alias("ref"))
    provable = m.trees.join(m.about.select(F.col("src").alias("id")), "id", "left_semi")
    about = provable.select("id", F.lit(0).alias("pos"), lost(F.floor(F.col("doc_id") / 2), F.col("doc_id") % 2 == 1).alias("ref"))
    trees = m.trees.select("id", "taxon", "language", "title", F.when(F.col("doc_id") % 5 == 0, "EUROPE").alias("region"))
    return P.page_nodes(trees, m.trees.select("id", F.col("section").alias("group")), deps, about)


@query("SELECT 'nat-' || c_nationkey AS id, list_sort(list(DISTINCT 'cus-' || c_custkey)) AS special FROM customer GROUP BY c_nationkey")
def special_cases(m: Model) -> DataFrame:
    return P.special_cases(m.table("customer").select(keyed("cus", "c_custkey").alias("id"), F.array(keyed("nat", "c_nationkey"), keyed("nat", "c_nationkey")).alias("generalized_by")))


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE doc_id - 1 END AS inv, CASE doc_id % 5 WHEN 0 THEN doc_id // 2 WHEN 1 THEN -1 END AS up FROM documents),
k AS (SELECT a.*, CASE WHEN up IN (SELECT doc_id FROM documents) THEN 'doc-' || up END AS own FROM a)
SELECT 'mor-' || x.doc_id AS id, 'mor-' || x.inv AS inverse, coalesce(x.own, y.own) AS up_to FROM k x LEFT JOIN k y ON y.doc_id = x.inv""")
def pair_up_to(m: Model) -> DataFrame:
    d = F.col("doc_id")
    arrows = m.table("documents").select(keyed("mor", d).alias("id"), keyed("mor", F.when(d % 2 == 0, d + 1).otherwise(d - 1)).alias("inverse"), F.when(d % 5 == 0, keyed("doc", F.floor(d / 2))).when(d % 5 == 1, "gone").alias("up_to"))
    return P.pair_up_to(arrows, m.trees)


@query("SELECT id, 'lang' AS part, language AS token, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE language END AS label FROM trees", "trees")
def label_rows(m: Model) -> DataFrame:
    labels = m.spark.createDataFrame([("en", "English"), ("fr", "French")], "token string, label string")
    return P.labelled(m.trees.select("id", F.lit("lang").alias("part"), F.col("language").alias("token")), labels)


_BOXES = "SELECT r_name AS canvas, 'nat-' || n_nationkey AS id, (n_nationkey * 7 % 5) * 190.0 AS x, (n_nationkey * 3 % 7) * 90.0 AS y, 150.0 + n_nationkey AS w, 46.0 + n_nationkey % 4 AS h, n_nationkey % 6 = 5 AS gone FROM nation JOIN region ON n_regionkey = r_regionkey"


def _boxes(m: Model) -> DataFrame:
    k = F.col("n_nationkey")
    return m.table("nation").join(m.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("canvas"), keyed("nat", k).alias("id"), ((k * 7 % 5) * 190.0).alias("x"), ((k * 3 % 7) * 90.0).alias("y"), (k + 150.0).alias("w"), (k % 4 + 46.0).alias("h"), (k % 6 == 5).alias("gone"))


@query(f"WITH b AS ({_BOXES}) SELECT canvas, CAST(greatest(0, coalesce(max(x + w) FILTER (NOT gone), 0)) AS DOUBLE) AS w, CAST(greatest(0, coalesce(max(y + h) FILTER (NOT gone), 0)) AS DOUBLE) AS h FROM b GROUP BY canvas")
def canvas_extent(m: Model) -> DataFrame:
    return P.extent(_boxes(m))


@query(f"WITH b AS ({_BOXES}) SELECT id, CAST(floor(x - CASE canvas WHEN 'ASIA' THEN 100.4 ELSE 0 END + 0.5) AS BIGINT) AS x, CAST(floor(y - CASE canvas WHEN 'ASIA' THEN -20.5 ELSE 0 END + 0.5) AS BIGINT) AS y FROM b")
def local_positions(m: Model) -> DataFrame:
    origins = m.spark.createDataFrame([("ASIA", 100.4, -20.5)], "region string, x double, y double")
    return P.local_positions(_boxes(m).withColumnRenamed("canvas", "region"), origins)


@query(f"""WITH b AS ({_BOXES}), e AS (SELECT t.id, s.canvas, s.id AS src, d.id AS dst, s.x AS sx, s.y AS sy, s.w AS sw, d.x AS dx, d.y AS dy, d.w AS dw FROM transforms t JOIN b s ON t.src = s.id JOIN b d ON t.dst = d.id AND d.canvas = s.canvas WHERE t.src != t.dst),
p AS (SELECT canvas, id, 0 AS "end", CASE WHEN dx + dw / 2 < sx + sw / 2 THEN 'l' ELSE 'r' END AS side, src AS box, sx AS bx, sy AS b_y, sw AS bw, dy AS other FROM e
UNION ALL SELECT canvas, id, 1, CASE WHEN dx + dw / 2 > sx + sw / 2 THEN 'l' ELSE 'r' END, dst, dx, dy, dw, sy FROM e)
SELECT canvas, id, "end", side, CAST(bx + CASE WHEN side = 'r' THEN bw ELSE 0 END AS DOUBLE) AS x, CAST(b_y + 46.0::DOUBLE * row_number() OVER (PARTITION BY canvas, box, side ORDER BY other, id, "end") / (count(*) OVER (PARTITION BY canvas, box, side) + 1) AS DOUBLE) AS y FROM p""", "transforms")
def edge_ports(m: Model) -> DataFrame:
    boxes = _boxes(m)
    side = lambda p: boxes.select(F.col("id").alias(p), F.col("canvas").alias(f"{p}_canvas"))
    edges = m.transforms.join(side("src"), "src").join(side("dst"), "dst").where("src_canvas = dst_canvas").select(F.col("src_canvas").alias("canvas"), "id", "src", "dst")
    return P.ports(boxes, edges)


@query(f"""WITH b AS ({_BOXES}), l AS (SELECT c_custkey AS k, 'nat-' || c_nationkey AS box FROM customer WHERE c_custkey % 9 = 0),
o AS (SELECT k, box, row_number() OVER (PARTITION BY box ORDER BY 'loop-' || k) - 1 AS n, count(*) OVER (PARTITION BY box) AS m FROM l)
SELECT canvas, 'loop-' || k AS id, round(CAST(x + w - 12 - n * least(30.0, (w - 28) / m) AS DOUBLE), 6) AS "right" FROM o JOIN b ON b.id = box""")
def loop_slots(m: Model) -> DataFrame:
    boxes = _boxes(m)
    loops = m.table("customer").where("c_custkey % 9 = 0").select(keyed("loop", "c_custkey").alias("id"), keyed("nat", "c_nationkey").alias("src")).withColumn("dst", F.col("src")).join(boxes.select("canvas", F.col("id").alias("src")), "src")
    return P.loop_slots(boxes, loops).withColumn("right", F.round("right", 6))


@query(f"""WITH b AS ({_BOXES}) SELECT a.canvas, a.id, CAST(min(q.x - 6 - a.x) AS DOUBLE) AS room FROM b a LEFT JOIN b q ON a.canvas = q.canvas AND a.id != q.id AND a.y + a.h + 2 <= q.y + q.h AND q.y <= a.y + a.h + 2 + 18 AND q.x + q.w > a.x GROUP BY a.canvas, a.id""")
def tag_room(m: Model) -> DataFrame:
    return P.tag_room(_boxes(m))


@query("""WITH asked AS (SELECT c_custkey AS view, 'box' AS how, 'cus-' || c_custkey AS ref FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c % 50, 'edge', 'hom-' || c || '-' || s FROM pairs WHERE s % 5 = 0 UNION ALL SELECT c_custkey, 'type', 'nat-1>nat-2' FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'focus', NULL FROM customer WHERE c_custkey % 6 = 0),
a AS (SELECT * FROM asked WHERE view NOT IN (SELECT view FROM asked WHERE how = 'focus')),
e AS (SELECT view, src, dst, s.of AS so, d.of AS d_of FROM a JOIN arrows r ON r.id = a.ref AND how = 'edge' JOIN instances s ON s.id = r.src JOIN instances d ON d.id = r.dst)
SELECT view, 'tie' AS what, ref FROM a WHERE how = 'box' AND ref IN (SELECT id FROM instances) UNION SELECT view, 'tie', unnest([src, dst]) FROM e UNION SELECT view, 'type', so || '>' || d_of FROM e UNION SELECT view, 'type', ref FROM a WHERE how = 'type'""", "pairs", "arrows", "instances")
def overlay(m: Model) -> DataFrame:
    cus, k = m.table("customer"), F.col("c_custkey")
    asked = cus.where(k % 3 == 0).select(k.alias("view"), F.lit("box").alias("how"), keyed("cus", k).alias("ref"))
    asked = asked.union(m.pairs.where("s % 5 = 0").select(F.col("c") % 50, F.lit("edge"), F.concat_ws("-", F.lit("hom"), "c", "s")))
    asked = asked.union(cus.where(k % 4 == 0).select(k, F.lit("type"), F.lit("nat-1>nat-2"))).union(cus.where(k % 6 == 0).select(k, F.lit("focus"), F.lit(None).cast("string")))
    return P.overlay(asked, m.instances, m.arrows)


@query("SELECT 'nat-' || a AS a, 'nat-' || b AS b, CASE WHEN a % 3 != 0 AND b % 3 != 0 THEN 'lit' ELSE 'dim' END AS state FROM nation_pairs", "nation_pairs")
def pair_state(m: Model) -> DataFrame:
    lit = m.table("nation").where("n_nationkey % 3 != 0").select(keyed("nat", "n_nationkey").alias("id"))
    return P.pair_state(m.nation_pairs.select(keyed("nat", "a").alias("a"), keyed("nat", "b").alias("b")), lit)


@query("""WITH o AS (SELECT kind, member, row_number() OVER (PARTITION BY kind ORDER BY member) - 1 AS n FROM kind_data WHERE starts_with(member, 'sup-')),
l AS (SELECT kind, 0 AS part, n AS at_, 'C' || n || ' @ ' || n % 3 || ',' || n // 3 || ' : ' || member AS line FROM o
UNION ALL SELECT a.kind, 1, a.n, 'C' || a.n || ' -> C' || b.n || ' : f' || ' [above]' FROM o a JOIN o b ON a.kind = b.kind AND b.n = a.n + 1)
SELECT kind, '% title: Defining diagram' || chr(10) || string_agg(line, chr(10) ORDER BY part, at_) AS source FROM l GROUP BY kind""", "kind_data")
def definition_figures(m: Model) -> DataFrame:
    """Members that are suppliers, and an arrow from each to the next one."""
    from pyspark.sql import Window

    boxes = m.kind_data.where("member like 'sup-%'")
    of = Window.partitionBy("kind").orderBy("member")
    ordered = boxes.withColumn("pos", F.row_number().over(of)).withColumn("next", F.lead("member").over(of))
    arrow = F.concat_ws(">", "kind", "member", "next")
    members = ordered.select("kind", "pos", F.col("member").alias("id"), F.lit("object").alias("taxon"), F.lit(None).cast("string").alias("symbol"))
    drawn = ordered.where("next is not null")
    members = members.union(drawn.select("kind", "pos", arrow, F.lit("morphism"), F.lit(None).cast("string")))
    return P.definition_figures(members, drawn.select(arrow.alias("id"), F.col("member").alias("src"), F.col("next").alias("dst"), F.lit(" f ").alias("label")))


@query("SELECT n_nationkey, concat_ws(chr(10), '% title: As a chain', 'A @ 0,0 : ' || n_name, 'B @ 1,0 : ' || n_name, 'C @ 2,0 : ' || n_name, 'D @ 3,0 : \\cdots', 'A -> B : f [above]', 'B -> C : f [above]', 'C -> D : f [above]') AS source FROM nation")
def chain_figures(m: Model) -> DataFrame:
    return m.table("nation").select("n_nationkey", P.chain_figure(F.col("n_name"), F.lit(None).cast("string")).alias("source"))


@query("""WITH p AS (SELECT a.doc_id AS pair, a.id AS first, a.taxon AS ft, b.id AS second, b.taxon AS st FROM trees a JOIN trees b ON b.doc_id = a.doc_id + 1)
SELECT pair, CASE WHEN ft = 'proof' AND st IN ('theorem', 'lemma', 'proposition', 'corollary', 'exercise', 'example') THEN second WHEN ft IN ('theorem', 'lemma', 'proposition', 'corollary', 'exercise', 'example') THEN first END AS statement,
CASE WHEN ft = 'proof' AND st IN ('theorem', 'lemma', 'proposition', 'corollary', 'exercise', 'example') THEN first WHEN ft IN ('theorem', 'lemma', 'proposition', 'corollary', 'exercise', 'example') THEN second END AS proof FROM p""", "trees")
def statement_and_second(m: Model) -> DataFrame:
    first = m.trees.select(F.col("doc_id").alias("pair"), F.col("id").alias("first"), F.col("taxon").alias("first_taxon"))
    second = m.trees.select((F.col("doc_id") - 1).alias("pair"), F.col("id").alias("second"), F.col("taxon").alias("second_taxon"))
    return P.statement_and_second(first.join(second, "pair"))


@query("""SELECT source AS blog, arg_min(lang || ' ' || doc_id, doc_id) AS title, list('#' || lang || '-' || doc_id ORDER BY doc_id) AS anchors, list(lang ORDER BY doc_id) AS concepts, list(doc_id % 2 = 0 ORDER BY doc_id) AS standalone FROM documents GROUP BY source""")
def blog_sections(m: Model) -> DataFrame:
    picked = m.table("documents").select(F.col("source").alias("blog"), F.col("doc_id").alias("place"), F.concat_ws(" ", "lang", "doc_id").alias("title"), F.lit("remark").alias("taxon"), F.when(F.col("doc_id") % 2 == 0, F.lit(True)).alias("standalone"), F.array("lang").alias("teaches"))
    return P.blog_sections(picked).select("blog", "title", F.col("concepts.at").alias("anchors"), F.transform("concepts", lambda c: c["teaches"][0]).alias("concepts"), F.col("verdicts.standalone").alias("standalone"))


@query("""WITH d AS (SELECT i, 'see [[doc-' || i // 2 || '|half]], [[doc-' || i // 3 || ']] and [[ doc-' || i // 4 || ' |]].' AS body FROM (SELECT DISTINCT i FROM dependencies))
SELECT 'doc-' || i AS id, 'see ' || CASE WHEN (i // 2) % 3 = 0 THEN '[[new-' || i // 2 || '|half]]' ELSE 'half' END || ', ' || CASE WHEN (i // 3) % 3 = 0 THEN '[[new-' || i // 3 || ']]' ELSE 'doc-' || i // 3 END || ' and ' || CASE WHEN (i // 4) % 3 = 0 THEN '[[new-' || i // 4 || '|]]' ELSE '' END || '.' AS body FROM d""", "dependencies")
def flattened_links(m: Model) -> DataFrame:
    i = F.col("doc_id")
    part = lambda k: F.floor(i / k).cast("string")
    bodies = m.table("documents").where("doc_id > 0").select(keyed("doc", i).alias("id"), F.concat(F.lit("see [[doc-"), part(2), F.lit("|half]], [[doc-"), part(3), F.lit("]] and [[ doc-"), part(4), F.lit(" |]].")).alias("body"))
    resolved = m.table("documents").where("doc_id % 3 = 0").select(keyed("doc", i).alias("target"), keyed("new", i).alias("new"))
    return P.flattened_links(bodies, resolved)[0]


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 != 1 THEN role END AS status, coalesce(last_value(CASE WHEN turn % 3 != 1 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'active') AS shown FROM conversations WHERE turn % 5 != 4""")
def status_fallback(m: Model) -> DataFrame:
    polls = m.table("conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.col("role")).alias("status"), (F.col("turn") % 5 == 4).alias("unchanged"))
    return P.status_fallback(polls, "conv_id", "turn").select("conv_id", "turn", "status", "shown")


@query("""WITH f AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS a, max(turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, coalesce(CAST(a AS VARCHAR), '-') || '/' || coalesce(CAST(b AS VARCHAR), '-') AS rev FROM f)
SELECT conv_id AS session, rev FROM r WHERE conv_id % 2 = 0 OR rev != '4/3'""")
def changed_since(m: Model) -> DataFrame:
    files = m.table("conversations").select(F.col("conv_id").alias("session"), F.when(F.col("role") == "user", "state.json").when(F.col("role") == "assistant", "notes.md").alias("file"), F.col("turn").alias("mtime"))
    since = m.table("conversations").where("conv_id % 2 != 0").select(F.col("conv_id").alias("session"), F.lit("4/3").alias("rev")).distinct()
    return P.changed_since(files, since)


@query("SELECT doc_id, CASE WHEN contains(chr(10) || text, chr(10) || 'De') THEN 'x' END AS marked, CASE WHEN len(string_split(chr(10) || '## ' || replace(coalesce(text, ''), '. ', chr(10) || '## '), chr(10) || '## ')) > 1 THEN '## ' || list_last(string_split(chr(10) || '## ' || replace(coalesce(text, ''), '. ', chr(10) || '## '), chr(10) || '## ')) END AS last FROM documents")
def last_section(m: Model) -> DataFrame:
    """Sentences as sections."""
    notes = F.concat(F.lit("## "), F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\n## ")))
    marked = F.when(F.contains(F.concat(F.lit("\n"), F.col("text")), F.lit("\nDe")), "x")
    return m.table("documents").select("doc_id", marked.alias("marked"), P.last_section(notes).alias("last"))


@query("""SELECT source AS chapter, arg_min(doc_id, doc_id) FILTER (doc_id % 3 = 1) AS ref, count(*) FILTER (doc_id % 3 = 1) AS pending, count(*) FILTER (doc_id % 3 = 0) AS authored, count(*) FILTER (doc_id % 3 = 2) AS skipped FROM documents GROUP BY source""")
def inventory_resume(m: Model) -> DataFrame:
    k = F.col("doc_id")
    rows = m.table("documents").select(F.col("source").alias("chapter"), k.alias("ref"), k.alias("place"), F.when(k % 3 == 1, "pending").when(k % 3 == 0, "authored").otherwise("skipped(known)").alias("status"))
    return P.resume_at(rows)


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || '-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 6) AS id, 'sesija-' || strftime(ts, '%Y%m%d-%H%M') || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-2' ELSE '-8' END AS slug FROM events")
def request_ids(m: Model) -> DataFrame:
    stamp = F.date_format("ts", "yyyyMMdd-HHmm")
    base = F.concat(F.lit("sesija-"), stamp)
    previous = F.when(F.col("event_id") % 3 == 0, F.lit("other")).when(F.col("event_id") % 3 == 1, base).otherwise(F.concat(base, F.lit("-7")))
    return m.table("events").select("event_id", P.request_id(F.col("ts"), F.col("event_id").cast("string")).alias("id"), P.proposed_slug(stamp, previous).alias("slug"))


@query(f"""SELECT 'doc-' || i AS id, 'dropped' AS what, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT i, {_TARGET} AS t FROM dependencies) WHERE t IS NULL GROUP BY i
UNION ALL SELECT 'doc-' || j, 'unresolved from', 'doc-' || j FROM (SELECT doc_id AS j, {_TARGET.replace("j", "doc_id")} AS t FROM documents) WHERE t IS NULL
UNION ALL SELECT 'doc-' || doc_id, 'flattened link', 'gone' FROM documents WHERE doc_id % 11 = 0""", "dependencies")
def merge_notes(m: Model) -> DataFrame:
    sides, docs = _merge_sides(m), m.table("documents").select(keyed("doc", "doc_id").alias("id"), "doc_id")
    lists = M.rewritten_lists(m.dependencies.select(keyed("doc", "i").alias("id"), "pos", keyed("doc", "j").alias("ref")), *sides)
    ends = M.flagged_refs(docs.select("id", F.lit("from").alias("field"), F.col("id").alias("ref")), *sides)
    bodies = docs.where("doc_id % 11 = 0").select("id", F.lit("see [[gone]]").alias("body"))
    links = P.flattened_links(bodies, m.spark.createDataFrame([], "target string, new string"))[1]
    return M.notes(lists, ends, links)

"""The registered queries over the model views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import merge as M
from ..operators import search as S
from ..operators import views as W
from ..streaming import mailbox as Z
from .filterql import describe, evaluate, paint, present
from .model import PROSE, PROVABLE, Model, keyed, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register a function of a Model under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Model(spark, folder))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views, recursive=recursive)
        return f

    return add


# The filter language

def _filter(name: str, expr, where: str, *views: str, ctes: str = "") -> None:
    def run(m: Model) -> DataFrame:
        return evaluate(expr, m.graph()).ids

    run.__name__ = name
    closed = f"""WITH {ctes}hit AS (SELECT * FROM ends WHERE {where})
SELECT id, taxon FROM hit UNION
SELECT n.id, n.taxon FROM nodes n JOIN (SELECT src_id AS id FROM hit WHERE taxon = 'morphism' UNION SELECT dst_id FROM hit WHERE taxon = 'morphism') e ON n.id = e.id"""
    query(closed, "ends", *views)(run)


_LEVEL = "coalesce(CASE WHEN taxon = 'object' THEN level = '{0}' WHEN taxon = 'morphism' THEN src_level = '{0}' AND dst_level = '{0}' END, false)"
_REGION = "coalesce(CASE WHEN region IS NOT NULL THEN region = '{0}' WHEN taxon = 'morphism' THEN src_region = '{0}' AND dst_region = '{0}' END, false)"
_TIED = """m AS (SELECT member AS id FROM kind_data WHERE kind = 'nat-3'),
around AS (SELECT of AS id FROM nodes WHERE id = 'nat-3' AND level = 'instance' UNION SELECT id FROM m UNION SELECT unnest([src, dst]) FROM arrows WHERE id IN (SELECT id FROM m)
  UNION SELECT id FROM nodes WHERE level = 'instance' AND of = 'nat-3' UNION SELECT id FROM arrows WHERE src = 'nat-3' OR dst = 'nat-3' UNION SELECT 'nat-3'),
tied AS (SELECT id FROM around UNION SELECT id FROM arrows WHERE src IN (SELECT id FROM around) AND dst IN (SELECT id FROM around)),
"""
_DATA = """m AS (SELECT member AS id FROM kind_data WHERE kind = 'nat-3'),
drawn AS (SELECT 'nat-3' AS id UNION SELECT id FROM m UNION SELECT unnest([src, dst]) FROM arrows WHERE id IN (SELECT id FROM m)),
"""
_filter("filter_level_kind", {"level": "kind"}, _LEVEL.format("kind"))
_filter("filter_level_instance", {"level": "instance"}, _LEVEL.format("instance"))
_filter("filter_kind_of", {"kind-of": "nat-7"}, "level = 'instance' AND of = 'nat-7'")
_filter("filter_arrow_kind", {"arrow-kind": "transform"}, "taxon = 'morphism' AND kind = 'transform'")
_filter("filter_tied_to", {"tied-to": "nat-3"}, "id IN (SELECT id FROM tied)", "kind_data", ctes=_TIED)
_filter("filter_in_data_of", {"in-data-of": "nat-3"}, "id IN (SELECT id FROM drawn)", "kind_data", ctes=_DATA)
_filter("filter_about", {"about": "nat-3"}, "id = 'nat-3' OR id IN (SELECT src FROM about WHERE dst = 'nat-3') OR id IN (SELECT dst FROM about WHERE src = 'nat-3')", "about")
_filter("filter_region", {"region": "EUROPE"}, _REGION.format("EUROPE"))
_filter("filter_taxon_text", {"taxon": "theorem", "text": "the"}, "taxon = 'theorem' AND (contains(lower(id), 'the') OR contains(lower(title), 'the'))")
_filter("filter_and_or_not", {"or": [{"and": [{"level": "instance"}, {"not": {"region": "ASIA"}}]}, {"taxon": "lemma"}]}, f"({_LEVEL.format('instance')} AND NOT {_REGION.format('ASIA')}) OR taxon = 'lemma'")


@query(f"""WITH hit AS (SELECT * FROM ends WHERE {_LEVEL.format("instance")} AND {_REGION.format("EUROPE")}),
closed AS (SELECT id, taxon FROM hit UNION SELECT n.id, n.taxon FROM nodes n JOIN (SELECT src_id AS id FROM hit UNION SELECT dst_id FROM hit) e ON n.id = e.id)
SELECT count(*) FILTER (taxon = 'object') AS objects, count(*) FILTER (taxon = 'morphism') AS arrows, count(*) FILTER (taxon NOT IN ('object', 'morphism')) AS trees, count(*) AS total FROM closed""", "ends")
def filter_counts(m: Model) -> DataFrame:
    return evaluate({"and": [{"level": "instance"}, {"region": "EUROPE"}]}, m.graph()).counts()


@query("""SELECT 'level' AS what, level AS value, CASE level WHEN 'kind' THEN 1 ELSE 2 END AS rank FROM nodes WHERE level IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'arrow-kind', kind, list_position(['data', 'transform', 'extract', 'property', 'instance', 'generalizes', 'construction', 'hom'], kind) FROM nodes WHERE kind IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'taxon', taxon, list_position(['theorem', 'lemma', 'proposition', 'corollary', 'definition', 'axiom', 'proof', 'example', 'exercise', 'exposition', 'motivation', 'intuition', 'remark', 'connection', 'object', 'morphism'], taxon) FROM nodes GROUP BY ALL
UNION ALL SELECT 'region', r_name, row_number() OVER (ORDER BY r_name) FROM region""", "nodes")
def filter_chips(m: Model) -> DataFrame:
    return present(m.graph())


@query(f"""WITH hit AS (SELECT id FROM kinds WHERE region = 'ASIA')
SELECT n.id, CASE WHEN n.id IN (SELECT src FROM about WHERE dst = 'nat-3') OR n.id = 'nat-3' THEN 'link' WHEN n.id IN (SELECT id FROM hit) THEN 'match' WHEN n.taxon IN ('object', 'morphism') THEN 'out' ELSE 'plain' END AS state FROM nodes n""", "nodes", "about")
def paint_state(m: Model) -> DataFrame:
    g = m.graph()
    return paint(g, m.kinds.where("region = 'ASIA'").select("id"), g.about_set("nat-3"))


@query("""SELECT * FROM (VALUES (0, 'kinds of structure and the relations between them'), (1, 'instances of the kind ' || (SELECT n_name FROM nation WHERE n_nationkey = 7)),
(2, 'instances and the maps between them and not region ASIA'), (3, 'everything'), (4, 'nothing')) AS t(i, says)""")
def describe_filter(m: Model) -> DataFrame:
    titles = {r.id: r.title for r in m.kinds.collect()}  # kinds: at most one row for each nation and region
    exprs = [{"level": "kind"}, {"kind-of": "nat-7"}, {"and": [{"level": "instance"}, {"not": {"region": "ASIA"}}]}, [], {"or": []}]
    return m.spark.createDataFrame([(i, describe(e, titles)) for i, e in enumerate(exprs)], "i int, says string")


# The structure graph

@query("SELECT a.of AS k1, b.of AS k2, count(*) AS arrows, CAST(sum(n) AS BIGINT) AS lines FROM arrows JOIN instances a ON src = a.id JOIN instances b ON dst = b.id GROUP BY ALL", "arrows", "instances")
def type_edges(m: Model) -> DataFrame:
    return W.type_edges(m.arrows, m.instances)


@query("SELECT r.id, r.kind, a.of AS k1, b.of AS k2, n FROM arrows r JOIN instances a ON src = a.id JOIN instances b ON dst = b.id", "arrows", "instances")
def type_edge_arrows(m: Model) -> DataFrame:
    return W.type_edge_arrows(m.arrows, m.instances)


@query("""WITH e AS (SELECT a.of AS k1, b.of AS k2, count(*) AS arrows FROM arrows JOIN instances a ON src = a.id JOIN instances b ON dst = b.id GROUP BY ALL)
SELECT t.id, t.kind, k1, k2, e.arrows FROM arrows t JOIN e ON src = k1 AND dst = k2""", "arrows", "instances")
def kind_level_between(m: Model) -> DataFrame:
    return W.kind_level_between(m.arrows, W.type_edges(m.arrows, m.instances))


@query("""WITH t AS (SELECT id, CASE WHEN n % 5 != 0 THEN 'tra-' || split_part(id, '-', 3) || '-' || split_part(id, '-', 2) END AS inverse, src, dst, n % 2 = 0 AS up_to FROM transforms)
SELECT a.id, b.id AS inverse, a.src AS a, a.dst AS b, a.up_to OR b.up_to AS up_to FROM t a JOIN t b ON a.inverse = b.id AND b.inverse = a.id WHERE a.id < b.id""", "transforms")
def inverse_pairs(m: Model) -> DataFrame:
    part = lambda k: F.split("id", "-")[k]
    named = m.transforms.withColumn("inverse", F.when(F.col("n") % 5 != 0, F.concat_ws("-", F.lit("tra"), part(2), part(1)))).withColumn("up_to", F.col("n") % 2 == 0)
    return W.inverse_pairs(named)


@query("""SELECT box, way, kind, count(*) AS n, min(id) AS first, list_position(['data', 'transform', 'extract', 'property', 'instance', 'generalizes', 'construction', 'hom'], kind) AS rank
FROM (SELECT src AS box, 'out' AS way, kind, id FROM arrows UNION ALL SELECT dst, 'in', kind, id FROM arrows) GROUP BY box, way, kind""", "arrows")
def box_arrows(m: Model) -> DataFrame:
    return W.box_arrows(m.arrows)


@query("""WITH page AS (
SELECT i.id, 'kind-arrow' AS part, a.id AS ref FROM instances i JOIN arrows a ON a.src = i.of WHERE a.kind != 'hom'
UNION ALL SELECT i.id, 'out', a.id FROM instances i JOIN arrows a ON a.src = i.id
UNION ALL SELECT i.id, 'in', a.id FROM instances i JOIN arrows a ON a.dst = i.id WHERE a.src != a.dst
UNION ALL SELECT i.id, 'in-data', k.kind FROM instances i JOIN kind_data k ON k.member = i.id
UNION ALL SELECT i.id, 'about', b.src FROM instances i JOIN about b ON b.dst = i.id
UNION ALL SELECT i.id, 'about-kind', b.src FROM instances i JOIN about b ON b.dst = i.of)
SELECT id, part, count(*) AS n, min(ref) AS first FROM page GROUP BY ALL""", "instances", "arrows", "kind_data", "about")
def instance_page(m: Model) -> DataFrame:
    m.keep_pairs()
    return W.instance_page_counts(m.instances, m.arrows, m.kind_data, m.about)


@query("""WITH up AS (SELECT src AS low, dst AS high FROM arrows WHERE kind = 'generalizes')
SELECT of AS kind, 'instance' AS what, id AS ref, NULL AS via FROM instances UNION ALL SELECT high, 'instance', id, low FROM instances JOIN up ON of = low
UNION ALL SELECT dst, 'theorem', src, NULL FROM about UNION ALL SELECT low, 'theorem', src, high FROM about JOIN up ON dst = high""", "arrows", "instances", "about")
def generalizes_propagation(m: Model) -> DataFrame:
    return W.generalizes_propagation(m.arrows, m.instances, m.about)


@query("""SELECT id, greatest(-45.0, least(45.0, (n - (c - 1) / 2.0) * 15.0)) AS "offset" FROM (SELECT id, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS c FROM arrows WINDOW w AS (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY id))""", "arrows")
def parallel_offsets(m: Model) -> DataFrame:
    return W.parallel_offsets(m.arrows)


@query("SELECT member AS id, list_sort(list(DISTINCT kind)) AS kinds FROM kind_data WHERE member IN (SELECT id FROM arrows) GROUP BY member", "kind_data", "arrows")
def component_anchors(m: Model) -> DataFrame:
    return W.component_anchors(m.kind_data, m.arrows)


# The prerequisite graph

def _dep(m: Model) -> DataFrame:
    return m.dependencies.select(keyed("doc", "j").alias("src"), keyed("doc", "i").alias("dst"))


@query("SELECT 'doc-' || j AS src, 'doc-' || i AS dst FROM dependencies WHERE j IN (SELECT doc_id FROM documents)", "dependencies")
def dep_edges(m: Model) -> DataFrame:
    return _dep(m).join(m.trees.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst")


_HREF = 'href="/([^"]*)"'
_LANGUAGES = "SELECT DISTINCT regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) FROM pages"


def _page_links(m: Model) -> DataFrame:
    pages = m.table("pages")
    return W.references(pages, pages.select(F.regexp_extract("url", "://[^/]+/([a-z]{2})/", 1).alias("target")), _HREF, "page_id", "html")


@query(f"""SELECT l.page_id, l.target, l.target IN ({_LANGUAGES}) AS alive
FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS target FROM pages) l""")
def links_status(m: Model) -> DataFrame:
    return _page_links(m)


@query(f"""SELECT l.page_id, l.target FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS target FROM pages) l
WHERE l.target NOT IN ({_LANGUAGES})""")
def dangling_refs(m: Model) -> DataFrame:
    return _page_links(m).where("not alive").select("page_id", "target")


_REACH = "WITH e AS (SELECT DISTINCT j AS src, i AS dst FROM dependencies), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)\n"


@query(_REACH + "SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM e f JOIN reach r ON f.dst = r.src WHERE f.src = e.src AND r.dst = e.dst)", "dependencies", recursive=True)
def transitive_reduction(m: Model) -> DataFrame:
    return G.transitive_reduction(m.dependencies.select(F.col("j").alias("src"), F.col("i").alias("dst")))


@query(_REACH + "SELECT src, count(*) AS n FROM reach GROUP BY src", "dependencies", recursive=True)
def reachable_pairs(m: Model) -> DataFrame:
    return G.reachable(m.dependencies.select(F.col("j").alias("src"), F.col("i").alias("dst"))).groupBy("src").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id AS id, 0 AS depth FROM documents UNION SELECT i, depth + 1 FROM d JOIN dependencies ON j = id)
SELECT id, max(depth) AS depth FROM d GROUP BY id""", "dependencies", recursive=True)
def longest_path_depth(m: Model) -> DataFrame:
    return G.longest_path_depth(m.table("documents").select(F.col("doc_id").alias("id")), m.dependencies.select(F.col("j").alias("src"), F.col("i").alias("dst")))


@query("""WITH r AS (SELECT src, dst FROM transforms UNION SELECT r.src, t.dst FROM r JOIN transforms t ON r.dst = t.src)
SELECT 'dependencies' AS name, false AS cyclic UNION ALL SELECT 'transforms', count(*) > 0 FROM r WHERE src = dst""", "transforms", recursive=True)
def has_cycle(m: Model) -> DataFrame:
    docs = m.table("documents").select(F.col("doc_id").alias("id"))
    a = G.has_cycle(docs, m.dependencies.select(F.col("j").alias("src"), F.col("i").alias("dst")))
    b = G.has_cycle(m.kinds.select("id"), m.transforms.select("src", "dst"))
    return m.spark.createDataFrame([("dependencies", a), ("transforms", b)], "name string, cyclic boolean")


@query("""WITH r AS (SELECT src, dst FROM transforms WHERE src != dst UNION SELECT r.src, t.dst FROM r JOIN transforms t ON r.dst = t.src AND t.src != t.dst),
live AS MATERIALIZED (SELECT src AS id FROM r WHERE src = dst UNION SELECT src FROM r WHERE dst IN (SELECT src FROM r WHERE src = dst)),
f AS MATERIALIZED (SELECT src AS id, min(dst) AS nxt FROM transforms WHERE src != dst AND src IN (SELECT id FROM live) AND dst IN (SELECT id FROM live) GROUP BY src),
w AS (SELECT 0 AS place, min(id) AS id FROM f HAVING min(id) IS NOT NULL UNION ALL SELECT place + 1, nxt FROM w JOIN f USING (id) WHERE place <= (SELECT count(*) FROM f)),
c AS (SELECT id, min(place) AS first, count(*) AS n FROM w GROUP BY id),
s AS (SELECT min(first) AS a, (SELECT min(w.place) FROM w JOIN c USING (id) WHERE c.first = (SELECT min(first) FROM c WHERE n > 1) AND w.place > c.first) AS z FROM c WHERE n > 1)
SELECT CAST(place - a AS INTEGER) AS place, id FROM w, s WHERE place BETWEEN a AND z""", "transforms", recursive=True)
def first_cycle(m: Model) -> DataFrame:
    return G.first_cycle_path(m.kinds.select("id"), m.transforms.where("src != dst").select("src", "dst")).select(F.col("place").cast("int").alias("place"), "id")


@query()
def break_cycles(m: Model) -> DataFrame:
    from ..operators.layout import break_cycles as turned

    arrows = [{"id": r.id, "kind": r.kind, "from": r.src, "to": r.dst} for r in m.transforms.collect()]  # pairs of nations
    return m.spark.createDataFrame([(x,) for x in sorted(turned([r.id for r in m.kinds.collect()], arrows))], "id string")


@query()
def region_layout(m: Model) -> DataFrame:
    from ..operators.layout import object_box_height, plane

    kinds = m.kinds.collect()  # nations and regions
    count = {r["of"]: r["count"] for r in m.instances.groupBy("of").count().collect()}
    sizes = {r.id: (180.0, float(object_box_height(count.get(r.id, 0)))) for r in kinds}
    out = plane(sorted({r.region for r in kinds if r.region}), {r.id: r.region for r in kinds}, sizes, [{"id": r.id, "from": r.src, "to": r.dst} for r in m.transforms.collect()])
    return m.spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in sorted(out["at"].items())], "id string, x double, y double")


@query()
def group_layout(m: Model) -> DataFrame:
    from ..operators.layout import layered_groups

    members = m.trees.select(F.col("section").alias("group"), "id")
    side = lambda end, name: m.trees.select(F.col("id").alias(end), F.col("section").alias(name))
    edges = _dep(m).join(side("src", "group"), "src").join(side("dst", "g2"), "dst").where("group = g2").select("group", "src", "dst")
    return layered_groups(members, edges)


# Groups, progress, concepts

def _states(m: Model) -> DataFrame:
    done = m.table("labels").where("quality = 1").select(keyed("doc", "doc_id").alias("id"))
    return W.readiness(m.trees.select("id"), m.dependencies.select(keyed("doc", "i").alias("id"), keyed("doc", "j").alias("ref")), done)


_READY = """WITH done AS (SELECT doc_id FROM labels WHERE quality = 1),
met AS (SELECT i, bool_and(j IN (SELECT doc_id FROM done)) AS ok FROM dependencies GROUP BY i),
s AS (SELECT d.doc_id, d.source AS section, CASE WHEN d.doc_id IN (SELECT doc_id FROM done) THEN 'done' WHEN coalesce(ok, true) THEN 'ready' ELSE 'not' END AS state FROM documents d LEFT JOIN met ON met.i = d.doc_id)
"""


@query(_READY + "SELECT 'doc-' || doc_id AS id, state FROM s", "dependencies")
def readiness(m: Model) -> DataFrame:
    return _states(m)


@query(_READY + """SELECT section, count(*) AS total, count(*) FILTER (state = 'done') AS mastered, bool_or(state = 'ready') AS any_ready,
CASE WHEN count(*) = count(*) FILTER (state = 'done') THEN 'mastered' WHEN bool_or(state = 'ready') THEN 'ready' ELSE 'muted' END AS outline FROM s GROUP BY section""", "dependencies")
def group_progress(m: Model) -> DataFrame:
    return W.group_progress(_states(m), m.trees.select("id", "section"))


@query(f"""WITH p AS (SELECT d.i, d.pos, d.j FROM dependencies d JOIN trees t ON d.j = t.doc_id WHERE t.taxon IN {tuple(PROVABLE)})
SELECT t.id, 'doc-' || (SELECT arg_min(j, pos) FROM p WHERE p.i = t.doc_id) AS anchor FROM trees t WHERE taxon = 'proof'""", "trees", "dependencies")
def proof_anchor(m: Model) -> DataFrame:
    proofs = m.trees.where("taxon = 'proof'").select("id", F.lit(None).cast("string").alias("proves"))
    return W.proof_anchor(proofs, m.dependencies.select(keyed("doc", "i").alias("id"), "pos", keyed("doc", "j").alias("ref")), m.trees.select("id", "taxon"))


@query(f"""SELECT CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE language END AS field, count(*) AS n, min(id) AS first, CAST(CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE language END = 'other' AS INTEGER) AS last
FROM trees WHERE taxon IN {tuple(PROVABLE)} GROUP BY field, last""", "trees")
def theorems_by_field(m: Model) -> DataFrame:
    rows = m.trees.where(F.col("taxon").isin(PROVABLE)).withColumn("fields", F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("language")))
    return W.theorems_by_field(rows)


def _links(m: Model) -> DataFrame:
    """Sections by source, in order of name; one tree in five is listed nowhere, one in seven twice."""
    listed = m.trees.where("doc_id % 5 != 4 and taxon != 'proof'").select("id", "doc_id", F.substring("section", 4, 9).cast("int").alias("section"))
    twice = listed.where("doc_id % 7 = 0").withColumn("section", F.col("section") + 1)
    return listed.union(twice).select("id", "section", F.col("doc_id").alias("link"))


@query(f"""WITH l AS (SELECT id, CAST(substr(section, 4, 9) AS INTEGER) AS section, doc_id AS link FROM trees WHERE doc_id % 5 != 4 AND taxon != 'proof'),
two AS (SELECT * FROM l UNION ALL SELECT id, section + 1, link FROM l WHERE link % 7 = 0),
f AS (SELECT id, min(section) AS section FROM two GROUP BY id),
a AS (SELECT t.doc_id, t.id, (SELECT 'doc-' || arg_min(d.j, d.pos) FROM dependencies d JOIN trees u ON d.j = u.doc_id WHERE d.i = t.doc_id AND u.taxon IN {tuple(PROVABLE)}) AS anchor FROM trees t WHERE t.taxon = 'proof'),
g AS (SELECT id, section, 0 AS pass FROM f UNION ALL SELECT a.id, f.section, 1 FROM a JOIN f ON a.anchor = f.id),
e AS (SELECT id, section, pass FROM g UNION ALL SELECT id, NULL, 4 FROM trees WHERE id NOT IN (SELECT id FROM g)),
k AS (SELECT e.*, CASE WHEN pass = 0 THEN CAST(substr(e.id, 5) AS BIGINT) END AS n FROM e)
SELECT id, section, pass, row_number() OVER (PARTITION BY section ORDER BY pass, n NULLS FIRST, id) AS place FROM k""", "trees", "dependencies")
def groups(m: Model) -> DataFrame:
    none = F.lit(None).cast("string")
    trees = m.trees.select("id", "taxon", none.alias("proves"), none.alias("instance_of"), none.alias("src"), none.alias("dst"))
    return W.build_groups(_links(m), trees, m.dependencies.select(keyed("doc", "i").alias("id"), "pos", keyed("doc", "j").alias("ref")))


@query("SELECT DISTINCT a.section AS a, b.section AS b, a.section || '>' || b.section AS name FROM dependencies JOIN trees a ON a.doc_id = j JOIN trees b ON b.doc_id = i WHERE a.section != b.section", "dependencies", "trees")
def group_edges(m: Model) -> DataFrame:
    return W.group_edges(_dep(m), m.trees.select("id", "section"))


@query("""WITH c AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x != ''))) AS concept FROM documents)
SELECT concept, min(doc_id) AS first, list('doc-' || doc_id ORDER BY doc_id) AS trees FROM c GROUP BY concept""")
def by_concept(m: Model) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != ""))
    teaches = m.table("documents").select(keyed("doc", "doc_id").alias("id"), F.explode(words).alias("concept"))
    return W.by_concept(teaches, m.trees.select("id", F.col("doc_id").alias("place")))


@query("""SELECT source AS section, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 15 AS BIGINT) AS chunk, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * 64 AS "offset" FROM documents""")
def dag_chunks(m: Model) -> DataFrame:
    return W.chunked(m.table("documents").select(F.col("source").alias("section"), "doc_id"), ["section"], ["doc_id"])


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS heading FROM events")
def section_fill(m: Model) -> DataFrame:
    lines = m.table("events").withColumn("heading", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return W.last_heading(lines, ["user_id"], ["ts", "event_id"]).select("event_id", "heading")


@query("SELECT doc_id, coalesce(sum(CAST(n_chars AS DOUBLE) + 26.0) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS y FROM documents")
def stacked_sections(m: Model) -> DataFrame:
    rows = m.table("documents").select("doc_id", "source", F.col("doc_id").alias("place"), F.col("n_chars").cast("double").alias("height"))
    return W.stacked(rows, ["source"]).select("doc_id", "y")


# Text, search, vectors, matching

_FOLD = "translate(strip_accents(lower({})), 'đ', 'd')"
QUERY_TEXT = "The anonat ration"


@query(f"SELECT doc_id, list_filter(string_split_regex({_FOLD.format('text')}, '[^a-z0-9]+'), lambda t: len(t) >= 2) AS tokens FROM documents")
def fold_tokens(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))


def _lexical_sql(query_text: str = QUERY_TEXT) -> str:
    words = S.query_words(query_text)
    parts = [f"CASE WHEN list_contains(own, '{w}') THEN 3 WHEN contains(f, '{w}') THEN 1 ELSE 0 END" for w in words]
    return f"f AS (SELECT doc_id, {_FOLD.format('text')} AS f FROM documents), o AS (SELECT *, string_split_regex(f, '[^a-z0-9]+') AS own FROM f), s AS (SELECT doc_id, CAST({' + '.join(parts)} + CASE WHEN contains(f, '{T.fold_text(query_text)}') THEN 5 ELSE 0 END AS BIGINT) AS lexical FROM o)"


@query(f"WITH {_lexical_sql()} SELECT doc_id, lexical FROM s")
def lexical_search(m: Model) -> DataFrame:
    return S.lexical_search(m.table("documents").select("doc_id", "text"), QUERY_TEXT).select("doc_id", "lexical")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"""WITH {_lexical_sql()}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
v AS (SELECT s.doc_id, lexical, coalesce({_DOT.format("q.e", "x.embedding")} / sqrt({_DOT.format("x.embedding", "x.embedding")}), -1) AS cosine FROM s LEFT JOIN embeddings x ON x.vec_id = s.doc_id CROSS JOIN q),
r AS (SELECT *, 1.0::DOUBLE / (60 + rank() OVER (ORDER BY lexical DESC)) + 1.0::DOUBLE / (60 + rank() OVER (ORDER BY cosine DESC)) AS score FROM v)
SELECT 'doc-' || doc_id AS id, round(score, 6) AS score, lexical, round(cosine, 4) AS cosine FROM r ORDER BY r.score DESC, id LIMIT 20""")
def hybrid_search(m: Model) -> DataFrame:
    vector = m.table("embeddings").where("vec_id = 7").select("embedding").first()[0]
    items = m.table("documents").join(m.table("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left").select(keyed("doc", "doc_id").alias("id"), "text", "vector")
    return S.hybrid_search(items, QUERY_TEXT, vector, 20)


@query("""WITH s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM embeddings),
t AS (SELECT *, CASE WHEN m = 0 THEN 1.0 ELSE m / 127 END AS scale FROM s)
SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, CAST(floor(CAST(x AS DOUBLE) / scale + 0.5) AS INTEGER))))) AS BIGINT) AS total,
CAST(greatest(-127, least(127, CAST(floor(CAST(embedding[1] AS DOUBLE) / scale + 0.5) AS INTEGER))) AS INTEGER) AS first, round(scale, 8) AS scale FROM t""")
def quantize_vectors(m: Model) -> DataFrame:
    rows = m.table("embeddings").select("vec_id", V.quantized(F.col("embedding")).alias("q"), V.scale(F.col("embedding")).alias("s"))
    return rows.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("q", 1).cast("int").alias("first"), F.round("s", 8).alias("scale"))


@query(f"""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT query, x.vec_id, round({_DOT.format("q.e", "x.embedding")} / sqrt({_DOT.format("x.embedding", "x.embedding")}), 6) AS cosine FROM q, embeddings x WHERE query != vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec_id) AS place FROM c) WHERE place <= 5""")
def cosine_topk(m: Model) -> DataFrame:
    rows = m.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.vector_topk(rows.where("id % 50 = 0"), rows, 5).select("query", F.col("id").alias("vec_id"), "cosine", "place")


_MATCH_WORDS = "list_distinct(list_filter(string_split_regex(translate(lower({}), 'čćšžđ', 'ccszd'), '[^a-z0-9]+'), lambda t: len(t) > 2))"
_MATCH = f"""WITH c AS (SELECT 'item-' || item_id AS candidate, {_MATCH_WORDS.format("text")} AS w, {_MATCH_WORDS.format("split_part(text, chr(10), 1)")} AS t, x.embedding AS v FROM benchmark LEFT JOIN embeddings x ON vec_id = item_id AND item_id % 3 != 0),
d AS (SELECT 'doc-' || doc_id AS id, {_MATCH_WORDS.format("text")} AS w, {_MATCH_WORDS.format("substr(text, 1, 60)")} AS t, x.embedding AS v FROM documents LEFT JOIN embeddings x ON vec_id = doc_id AND doc_id % 4 != 0),
p AS (SELECT candidate, id, {_DOT.format("c.v", "d.v")} / sqrt({_DOT.format("d.v", "d.v")}) / sqrt({_DOT.format("c.v", "c.v")}) AS cosine,
  CASE WHEN len(c.w) + len(d.w) = 0 THEN 0 ELSE len(list_intersect(c.w, d.w)) / len(list_distinct(list_concat(c.w, d.w)))::DOUBLE END AS concepts,
  CASE WHEN least(len(c.t), len(d.t)) = 0 THEN 0 ELSE len(list_intersect(c.t, d.t)) / least(len(c.t), len(d.t))::DOUBLE END AS title_overlap FROM c, d),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY round(coalesce(cosine, 0) + 0.5 * concepts + 0.3 * title_overlap, 9) DESC, id) AS place FROM p),
b AS (SELECT candidate, CASE WHEN cosine >= 0.92 OR (title_overlap >= 0.9 AND concepts >= 0.5) THEN 'duplicate' WHEN cosine >= 0.86 OR concepts >= 0.5 THEN 'related' ELSE 'novel' END AS hint FROM r WHERE place = 1)
"""


def _matches(m: Model) -> DataFrame:
    """Benchmark items against documents: concepts from whole texts, a title in the first line (60 characters of a document), vectors of some."""
    vectors = m.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
    side = lambda rows, key, least: rows.join(vectors.where(F.col("vec_id") % least != 0), F.col(key) == F.col("vec_id"), "left")
    unit = F.transform("vector", lambda x: x / V.norm(F.col("vector"))).alias("vector")
    items = side(m.table("benchmark"), "item_id", 3).select(keyed("item", "item_id").alias("id"), T.title_tokens(F.substring_index("text", "\n", 1)).alias("words"), T.title_tokens(F.col("text")).alias("concepts"), unit)
    trees = side(m.table("documents"), "doc_id", 4).select(keyed("doc", "doc_id").alias("id"), T.title_tokens(F.substring("text", 1, 60)).alias("words"), T.title_tokens(F.col("text")).alias("concepts"), "vector")
    return S.match(items, trees)


@query(_MATCH + "SELECT r.candidate, r.id, r.place, round(r.cosine, 4) AS cosine, round(r.concepts, 6) AS concepts, round(r.title_overlap, 6) AS title_overlap, b.hint FROM r JOIN b ON r.candidate = b.candidate WHERE r.place <= 5")
def match_candidates(m: Model) -> DataFrame:
    return _matches(m)


@query(_MATCH + "SELECT hint, count(*) AS n FROM b GROUP BY hint")
def match_hint(m: Model) -> DataFrame:
    return _matches(m).where("place = 1").groupBy("hint").agg(F.count("*").alias("n"))


def _steps(text: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


_PLAIN = _steps(
    "text", (r"(?s)\x60\x60\x60.*?\x60\x60\x60", " "), (r"(?s)\$\$(.*?)\$\$", r" \1 "), (r"\\\$", "\x01"), (r"\$([^$\n]*)\$", r" \1 "), ("\x01", r"\\$"),
    (r"\[\[[^\[\]|#]+(?:#[^\]|]*)?\|([^\]]*)\]\]", r"\1"), (r"\[\[([^\[\]|#]+)(?:#[^\]|]*)?\]\]", r"\1"), (r"[*_\x60#>]", ""), (r"[ \t\r\n\x0b\f]+", " "),
)


@query(f"SELECT doc_id, trim({_PLAIN}) AS plain FROM documents")
def body_to_text(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", T.body_to_text(F.col("text")).alias("plain"))


# Integrity and merging over the model views

_RULES = ("T12", "T24", "T29", "T30", "U03", "U08", "U09", "O08", "O14", "M07", "M12", "M18", "M23", "M30", "M31", "M32")


def _corpus(m: Model) -> DataFrame:
    """The model as parsed trees of a corpus: documents as prose, kinds and instances as objects, arrows as arrows.

    Some arrows between kinds name an inverse (every third one that there is none), some act on an arrow.
    """
    from ..operators.graph import saved
    from ..sources.vault import TREE

    if "pairs" not in m.__dict__:
        m.pairs = saved(m.pairs)
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in m.spark.createDataFrame([], TREE).schema}
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))

    def rows(of: DataFrame, **fields) -> DataFrame:
        given = {"file": F.concat("id", F.lit(".md")), "stem": F.col("id"), "has_header": F.lit(True), "id": F.col("id"), "title": F.col("id"), "teaches": texts(F.lit(None)), "requires": texts(F.lit(None)), "depends": texts(F.lit(None)), "standalone": F.lit(True), "body": F.lit("")} | fields
        shown = F.to_json(F.struct(*[c.alias(k) for k, c in given.items() if k not in ("file", "stem", "has_header", "body")]))
        return of.select(*[(shown if k == "raw" else given.get(k, c)).cast(c_type).alias(k) for (k, c), c_type in zip(nothing.items(), (f.dataType for f in m.spark.createDataFrame([], TREE).schema), strict=True)])

    listed = m.dependencies.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda x: keyed("doc", x["j"])).alias("depends"))
    about = m.about.select(F.col("src").alias("id"), F.array("dst").alias("about"))
    prose = m.trees.join(listed, F.col("doc_id") == F.col("i"), "left").join(about, "id", "left")
    members = m.kind_data.groupBy(F.col("kind").alias("id")).agg(F.collect_list("member").alias("data"))
    objects = m.kinds.join(members, "id", "left")
    part = lambda k: F.split("id", "-")[k]
    n, general = F.coalesce(F.col("n"), F.lit(1)), F.col("kind") == "generalizes"
    inverse = F.when((F.col("kind") == "transform") & (n % 3 == 0), F.concat_ws("-", F.lit("tra"), part(2), part(1))).when((F.col("kind") == "transform") & (n % 3 == 1), F.lit("gen-0"))
    arrows = m.arrows.withColumn("inverse", inverse)
    return (
        rows(prose, taxon=F.col("taxon"), title=F.col("title"), depends=texts(F.col("depends")), about=F.col("about"), body=F.col("body"))
        .union(rows(objects, taxon=F.lit("object"), title=F.col("title"), symbol=F.lit("K"), hom=F.lit("maps"), data=F.col("data")))
        .union(rows(m.instances, taxon=F.lit("object"), symbol=F.lit("I"), instance_of=F.col("of")))
        .union(rows(arrows, taxon=F.lit("morphism"), kind=F.col("kind"), statement=F.lit("f"), needs=F.array(F.lit("x")), **{"from": F.col("src"), "to": F.col("dst")}, inverse=F.col("inverse"), acts_on=F.when(~general & (F.col("kind") != "hom"), F.array(F.lit("gen-1"), F.lit("nat-1"))), functorial=F.when(general, F.lit(True))))
    )


@query("""WITH inv AS (SELECT id, src, dst, CASE WHEN kind = 'transform' AND n % 3 = 0 THEN 'tra-' || split_part(id, '-', 3) || '-' || split_part(id, '-', 2) WHEN kind = 'transform' AND n % 3 = 1 THEN 'gen-0' END AS inverse FROM arrows),
twin AS (SELECT a.*, b.id AS named, b.inverse AS back, b.src AS bs, b.dst AS bd FROM inv a LEFT JOIN inv b ON a.inverse = b.id WHERE a.inverse IS NOT NULL)
SELECT 'T12' AS rule, id AS ref FROM trees WHERE trim(title, ' ' || chr(9) || chr(10) || chr(13)) = '' UNION ALL
SELECT 'T24', 'doc-' || i FROM dependencies WHERE j NOT IN (SELECT doc_id FROM documents) UNION ALL
SELECT 'T29', t.id FROM trees t WHERE taxon = 'proof' AND NOT EXISTS (SELECT 1 FROM dependencies d JOIN trees u ON d.j = u.doc_id WHERE d.i = t.doc_id AND u.taxon IN ('theorem', 'lemma', 'proposition', 'corollary')) UNION ALL
SELECT 'T30', 'doc-' || i FROM dependencies d JOIN trees u ON d.j = u.doc_id JOIN trees t ON t.doc_id = d.i WHERE t.taxon = 'proof' AND u.taxon IN ('theorem', 'lemma', 'proposition', 'corollary') GROUP BY i HAVING count(*) > 1 UNION ALL
SELECT 'U08', id FROM kinds WHERE id NOT IN (SELECT of FROM instances) UNION ALL
SELECT 'U09', id FROM kinds WHERE id NOT IN (SELECT unnest([src, dst]) FROM arrows WHERE kind = 'generalizes') UNION ALL
SELECT 'O08', k.kind FROM kind_data k JOIN instances i ON k.member = i.id WHERE i.of = k.kind UNION ALL
SELECT 'M12', a.id FROM arrows a JOIN nodes s ON a.src = s.id JOIN nodes d ON a.dst = d.id WHERE (a.kind = 'hom') != (s.level = 'instance' AND d.level = 'instance') UNION ALL
SELECT 'M18', a.id FROM arrows a JOIN instances s ON a.src = s.id JOIN instances d ON a.dst = d.id WHERE a.kind = 'hom' AND s.of != d.of AND NOT EXISTS (SELECT 1 FROM kind_data k WHERE k.member = a.id AND k.kind != s.of AND k.kind != d.of) UNION ALL
SELECT 'M23', id FROM arrows WHERE kind = 'transform' UNION ALL
SELECT 'M30', id FROM twin WHERE named IS NULL UNION ALL
SELECT 'M31', id FROM twin WHERE named IS NOT NULL AND back IS DISTINCT FROM id UNION ALL
SELECT 'M32', id FROM twin WHERE named IS NOT NULL AND NOT (bs = dst AND bd = src)""", "trees", "dependencies", "kinds", "instances", "arrows", "kind_data", "nodes")
def rule_violations(m: Model) -> DataFrame:
    from ..operators.graph import saved
    from ..operators.rules import violations

    header = {"schema_version": "forest-0.3", "source": {"title": "T", "authors": [], "year": 2020, "kind": "book", "license": "CC0"}, "language": "en", "created": "2024-01-01", "tool": "t", "tool_version": "1", "derivative": False}
    found = violations(saved(_corpus(m)), header, only=_RULES)
    return found.select("rule", F.regexp_replace("file", r"\.md$", "").alias("ref"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(m: Model) -> DataFrame:
    return W.repeated(m.table("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, k AS key FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) WHERE k NOT IN ('id', 'taxon') AND NOT starts_with(k, 'x_')")
def unknown_keys(m: Model) -> DataFrame:
    return W.unknown_keys(m.table("events"), "event_id", "props", ["id", "taxon"])


def _merge_sides(m: Model):
    docs = m.table("documents").select("doc_id")
    grown = docs.where("doc_id % 10 = 1").select(keyed("doc", "doc_id").alias("old"), keyed("new", "doc_id").alias("new"))
    remap = docs.where("doc_id % 10 = 2").select(keyed("doc", "doc_id").alias("old"), keyed("map", "doc_id").alias("new"))
    forest = docs.where("doc_id % 10 in (1, 2, 3, 4)").select(keyed("doc", "doc_id").alias("id"))
    return grown, remap, forest


_TARGET = "CASE j % 10 WHEN 1 THEN 'new-' || j WHEN 2 THEN 'map-' || j WHEN 3 THEN 'doc-' || j WHEN 4 THEN 'doc-' || j END"


@query(f"SELECT 'doc-' || i AS id, pos, 'doc-' || j AS ref, {_TARGET} AS target FROM dependencies", "dependencies")
def resolve_refs(m: Model) -> DataFrame:
    return M.resolve(m.dependencies.select(keyed("doc", "i").alias("id"), "pos", keyed("doc", "j").alias("ref")), *_merge_sides(m)).select("id", "pos", "ref", "target")


@query(f"SELECT 'doc-' || i AS id, coalesce(list(DISTINCT t ORDER BY t) FILTER (t IS NOT NULL), []) AS refs, count(*) FILTER (t IS NULL) AS dropped FROM (SELECT i, {_TARGET} AS t FROM dependencies) GROUP BY i", "dependencies")
def merge_edges(m: Model) -> DataFrame:
    rows = M.rewritten_lists(m.dependencies.select(keyed("doc", "i").alias("id"), "pos", keyed("doc", "j").alias("ref")), *_merge_sides(m))
    return rows.select("id", F.array_sort("refs").alias("refs"), "dropped")


@query("""SELECT doc_id, CASE WHEN coalesce(origin, 'digest') NOT IN ('member', 'agent') THEN 'derived' WHEN pages IS NOT NULL THEN 'has-pages' ELSE 'pass' END AS verdict
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'member' WHEN 1 THEN 'agent' WHEN 2 THEN 'digest' END AS origin, CASE WHEN doc_id % 3 = 0 THEN '1-2' END AS pages FROM documents)""")
def firewall(m: Model) -> DataFrame:
    k = F.col("doc_id") % 4
    rows = m.table("documents").select("doc_id", F.when(k == 0, "member").when(k == 1, "agent").when(k == 2, "digest").alias("origin"), F.when(F.col("doc_id") % 3 == 0, "1-2").alias("source_pages"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("attribution"))
    return M.firewall(rows, True).select("doc_id", "verdict")


@query("""SELECT d.source AS section, list_sort(list(DISTINCT d.lang)) AS teaches, list_filter(list_sort(list(DISTINCT p.lang)), lambda x: NOT list_contains(list(DISTINCT d.lang), x)) AS requires
FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id // 2 GROUP BY d.source""")
def concept_union(m: Model) -> DataFrame:
    docs = m.table("documents").select("doc_id", "lang", "source")
    pre = docs.select(F.col("doc_id").alias("half"), F.col("lang").alias("before"))
    each = docs.join(pre, F.floor(F.col("doc_id") / 2) == F.col("half"), "left").select(F.col("source").alias("section"), F.array("lang").alias("teaches"), F.array_compact(F.array("before")).alias("requires"))
    return M.concept_union(each, "section")


@query("""WITH p AS (SELECT doc_id AS id, lang AS title, source AS note FROM documents WHERE doc_id % 3 != 2), n AS (SELECT doc_id AS id, upper(lang) AS title, 'new' AS note FROM documents WHERE doc_id % 3 != 1)
SELECT coalesce(p.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE p.title END AS title, coalesce(p.note, n.note) AS note FROM p FULL JOIN n ON p.id = n.id""")
def upsert_preserve(m: Model) -> DataFrame:
    """A third of the documents on either side alone and a third on both: all are in the result."""
    docs = m.table("documents")
    prior = docs.where("doc_id % 3 != 2").select(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("note"))
    new = docs.where("doc_id % 3 != 1").select(F.col("doc_id").alias("id"), F.upper("lang").alias("title"), F.lit("new").alias("note"))
    return M.upsert(prior, new, ["title"])


# Streams, in their batch form

def _requests(m: Model) -> tuple[DataFrame, DataFrame]:
    events = m.table("events")
    return events.where("event_type = 'view'"), events.where("event_type in ('purchase', 'error')")


def _mailbox(m: Model) -> tuple[DataFrame, DataFrame]:
    """Views as requests, and each purchase or error as a status of the request with the id before it."""
    events = m.table("events")
    return events.where("event_type = 'view'").withColumnRenamed("event_id", "id"), events.where("event_type in ('purchase', 'error')").select((F.col("event_id") - 1).alias("id"))


@query("SELECT event_id AS id, user_id FROM events WHERE event_type = 'view' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type IN ('purchase', 'error'))")
def unhandled_requests(m: Model) -> DataFrame:
    return Z.unhandled(*_mailbox(m)).select("id", "user_id")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS id FROM events WHERE event_type = 'view' AND event_id NOT IN (SELECT event_id - 1 FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY user_id")
def next_request(m: Model) -> DataFrame:
    return Z.next_request(*_mailbox(m), by="ts", per="user_id").select("user_id", "id")


@query("SELECT user_id, max(ts) AS last, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) < 90000000 AS alive FROM events WHERE event_type = 'click' GROUP BY user_id")
def watcher_liveness(m: Model) -> DataFrame:
    events = m.table("events")
    now = events.agg(F.max("ts")).first()[0]
    return Z.liveness(events.where("event_type = 'click'"), F.lit(now))


@query("""SELECT event_id, user_id, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE event_type IN ('view', 'purchase', 'error')) WHERE event_type IS DISTINCT FROM b""")
def status_changes(m: Model) -> DataFrame:
    rows = m.table("events").where("event_type in ('view', 'purchase', 'error')").select("event_id", "user_id", F.col("event_type").alias("state"), "ts")
    return Z.status_changes(rows, "user_id", "state", ("ts", "event_id")).select("event_id", "user_id", "state")


@query("""SELECT conv_id, turn, question, text AS answer, reply FROM (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question,
first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply FROM conversations) WHERE role = 'user'""")
def session_log(m: Model) -> DataFrame:
    return Z.session_log(m.table("conversations"))


@query("""SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') >= 3 THEN 'done' ELSE 'active' END AS status, CAST(least(3, count(*) FILTER (role = 'user') + 1) AS INTEGER) AS turn FROM conversations GROUP BY conv_id""")
def session_status(m: Model) -> DataFrame:
    turns = m.table("conversations").select("conv_id", F.col("turn").alias("at"), F.when(F.col("role") == "user", "answer").otherwise("other").alias("action"))
    begun = turns.select("conv_id", F.lit(-1).cast(turns.schema["at"].dataType).alias("at"), F.lit("start").alias("action")).distinct()
    return Z.session_states(turns.union(begun), key="conv_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL")
def tumbling_requests(m: Model) -> DataFrame:
    return Z.windowed_requests(_requests(m)[0])


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessionize_events(m: Model) -> DataFrame:
    rows = m.table("events").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("""WITH b AS (SELECT n_nationkey AS k, (n_nationkey % 5) * 200.0 AS x, (n_nationkey // 5) * 120.0 AS y FROM nation),
a AS (SELECT t.id, t.src, t.dst, s.x AS px, s.y AS py, d.x AS qx, d.y AS qy FROM transforms t JOIN b s ON t.src = 'nat-' || s.k JOIN b d ON t.dst = 'nat-' || d.k WHERE t.src != t.dst),
c AS (SELECT a.id, 'nat-' || b.k AS box, qx - px AS dx, qy - py AS dy, b.x - 40 - px AS x0, b.x + 40 - px AS x1, b.y - 20 - py AS y0, b.y + 20 - py AS y1 FROM a, b WHERE 'nat-' || b.k NOT IN (a.src, a.dst)),
t AS (SELECT id, box, CASE WHEN dx = 0 THEN CASE WHEN x0 <= 0 AND x1 >= 0 THEN 0 ELSE 2 END ELSE least(x0 / dx, x1 / dx) END AS a0, CASE WHEN dx = 0 THEN 1 ELSE greatest(x0 / dx, x1 / dx) END AS a1,
  CASE WHEN dy = 0 THEN CASE WHEN y0 <= 0 AND y1 >= 0 THEN 0 ELSE 2 END ELSE least(y0 / dy, y1 / dy) END AS b0, CASE WHEN dy = 0 THEN 1 ELSE greatest(y0 / dy, y1 / dy) END AS b1 FROM c)
SELECT id, box FROM t WHERE greatest(0, a0, b0) <= least(1, a1, b1)""", "transforms")
def crossing_boxes(m: Model) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = m.table("nation").select(keyed("nat", "n_nationkey").alias("box"), ((k % 5) * 200.0).alias("x"), (F.floor(k / 5) * 120.0).alias("y"))
    end = lambda side, p: boxes.select(F.col("box").alias(side), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    arrows = m.transforms.where("src != dst").join(end("src", "p"), "src").join(end("dst", "q"), "dst")
    rows = arrows.join(F.broadcast(boxes), (F.col("box") != F.col("src")) & (F.col("box") != F.col("dst")))

    def clip(p: str, q: str, at: str, half: float):
        d, lo, hi = F.col(q) - F.col(p), F.col(at) - half - F.col(p), F.col(at) + half - F.col(p)
        flat = F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(2.0)
        return F.when(d == 0, flat).otherwise(F.least(lo / d, hi / d)), F.when(d == 0, 1.0).otherwise(F.greatest(lo / d, hi / d))

    (a0, a1), (b0, b1) = clip("px", "qx", "x", 40.0), clip("py", "qy", "y", 20.0)
    return rows.where(F.greatest(F.lit(0.0), a0, b0) <= F.least(F.lit(1.0), a1, b1)).select("id", "box")


@query("""SELECT n_nationkey, 'T ' || n_name AS title, 3 AS corners, list_value('A', 'B', 'C') AS names, n_name AS first, 3 AS arrows, 'iso' AS head, CASE WHEN n_nationkey % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS bend,
CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'the paths do not share their ends' END AS equation, CASE WHEN n_nationkey % 3 = 1 THEN 3 ELSE 2 END AS errors FROM nation""")
def parse_cd(m: Model) -> DataFrame:
    from ..functions.diagram import parsed

    k = F.col("n_nationkey")
    bend = F.when(k % 3 == 0, "0.5").when(k % 3 == 1, "7").otherwise("0")
    source = F.concat(
        F.lit("% title: T "), F.col("n_name"), F.lit("\nA @ 0,0 : "), F.col("n_name"), F.lit("\nB @ 1,0\nC @ 1,1 : {[a]}\nD @ -1,0 : no\nf: A -> B : f [iso, above, bend="), bend,
        F.lit("]\ng: B -> C : g\nh: A -> C : h [dashed]\nh: A -> B : twice\nf g = "), F.when(k % 2 == 0, "h").otherwise("g"), F.lit(" : [[def-x|by it]]"),
    )
    d = m.table("nation").select("n_nationkey", "n_name", parsed(source).alias("d"))
    return d.select(
        "n_nationkey", F.col("d.title").alias("title"), F.size("d.corners").alias("corners"), F.col("d.corners.name").alias("names"), F.col("d.corners")[0]["tex"].alias("first"), F.size("d.arrows").alias("arrows"),
        F.col("d.arrows")[0]["head"].alias("head"), F.col("d.arrows")[0]["bend"].alias("bend"), F.col("d.equations")[0]["error"].alias("equation"), F.size("d.errors").alias("errors"),
    )


assert len(PROSE) == 14

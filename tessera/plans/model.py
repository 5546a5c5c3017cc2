"""Model views over the driver tables: kinds, instances, arrows, trees, dependencies.

Each view exists as a DataFrame (for the engine) and as SQL text (for checks).
Views are plain plans: nothing is cached, so that filters and column pruning
reach the scans.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Taxa with their id prefixes, in closed-set order; the last two are structure.
TAXA = {
    "theorem": "thm", "lemma": "lem", "proposition": "prp", "corollary": "cor", "definition": "def", "axiom": "axm", "proof": "prf", "example": "exm",
    "exercise": "exr", "exposition": "exp", "motivation": "mot", "intuition": "int", "remark": "rem", "connection": "con", "object": "obj", "morphism": "mor",
}
PROSE = [t for t in TAXA if t not in ("object", "morphism")]
PROVABLE = ["theorem", "lemma", "proposition", "corollary"]
#: Kinds of arrows in palette order, and levels.
ARROW_KINDS = ["data", "transform", "extract", "property", "instance", "generalizes", "construction", "hom"]
LEVELS = ["kind", "instance"]


def keyed(prefix: str, col: Column | str) -> Column:
    return F.concat(F.lit(prefix + "-"), (F.col(col) if isinstance(col, str) else col).cast("string"))


class Model:
    """The views of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @functools.cached_property
    def kinds(self) -> DataFrame:
        """``id, title, region``: nations in their region, and regions."""
        nations = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return nations.select(keyed("nat", "n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("r_name").alias("region")).unionByName(
            self.table("region").select(keyed("reg", "r_regionkey").alias("id"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("region"))
        )

    @functools.cached_property
    def instances(self) -> DataFrame:
        """``id, title, of, region``: customers and suppliers of their nation."""
        both = self.table("customer").select(keyed("cus", "c_custkey").alias("id"), F.col("c_name").alias("title"), keyed("nat", "c_nationkey").alias("of")).unionByName(
            self.table("supplier").select(keyed("sup", "s_suppkey").alias("id"), F.col("s_name").alias("title"), keyed("nat", "s_nationkey").alias("of"))
        )
        return both.join(self.kinds.select(F.col("id").alias("of"), "region"), "of").select("id", "title", "of", "region")

    @functools.cached_property
    def pairs(self) -> DataFrame:
        """``c, s, n``: lines ordered by a customer from a supplier."""
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return lines.groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("n"))

    @functools.cached_property
    def nation_pairs(self) -> DataFrame:
        """``a, b, n``: lines between nations (at most one row for each pair of nations)."""
        c, s = self.table("customer").select("c_custkey", "c_nationkey"), self.table("supplier").select("s_suppkey", "s_nationkey")
        joined = self.pairs.join(c, F.col("c") == F.col("c_custkey")).join(s, F.col("s") == F.col("s_suppkey"))
        return joined.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("n").alias("n"))

    @functools.cached_property
    def transforms(self) -> DataFrame:
        over = self.nation_pairs.withColumn("mean", F.avg("n").over(Window.partitionBy(F.lit(1)))).where("n > mean")
        return over.select(F.concat_ws("-", F.lit("tra"), "a", "b").alias("id"), F.lit("transform").alias("kind"), keyed("nat", "a").alias("src"), keyed("nat", "b").alias("dst"), "n")

    @functools.cached_property
    def homs(self) -> DataFrame:
        return self.pairs.select(F.concat_ws("-", F.lit("hom"), "c", "s").alias("id"), F.lit("hom").alias("kind"), keyed("cus", "c").alias("src"), keyed("sup", "s").alias("dst"), "n")

    @functools.cached_property
    def arrows(self) -> DataFrame:
        """``id, kind, src, dst, n``: homs between instances, transforms and generalizations between kinds."""
        general = self.table("nation").select(keyed("gen", "n_nationkey").alias("id"), F.lit("generalizes").alias("kind"), keyed("nat", "n_nationkey").alias("src"), keyed("reg", "n_regionkey").alias("dst"), F.lit(1).cast("long").alias("n"))
        return general.unionByName(self.homs).unionByName(self.transforms)

    @functools.cached_property
    def trees(self) -> DataFrame:
        """``doc_id, id, taxon, title, section, language, body``: documents as prose trees."""
        taxa = F.array(*[F.lit(t) for t in PROSE])
        return self.table("documents").select("doc_id", keyed("doc", "doc_id").alias("id"), F.element_at(taxa, (F.col("doc_id") % len(PROSE) + 1).cast("int")).alias("taxon"), F.substring("text", 1, 60).alias("title"), F.col("source").alias("section"), F.col("lang").alias("language"), F.col("text").alias("body"))

    @functools.cached_property
    def dependencies(self) -> DataFrame:
        """``i, pos, j``: document i depends on j; listed in order, without repeats."""
        listed = F.array_distinct(F.array(*[F.floor(F.col("doc_id") / k).cast("long") for k in (2, 3, 4, 6)]))
        rows = self.table("documents").where("doc_id > 0").select(F.col("doc_id").alias("i"), F.posexplode(listed).alias("pos", "j"))
        return rows

    @functools.cached_property
    def about(self) -> DataFrame:
        """``src, dst``: provable trees are about a nation."""
        return self.trees.where(F.col("taxon").isin(PROVABLE)).select(F.col("id").alias("src"), keyed("nat", F.col("doc_id") % 25).alias("dst"))

    @functools.cached_property
    def kind_data(self) -> DataFrame:
        """``kind, member``: members of other kinds and the homs between them."""
        sup = self.table("supplier").where("s_acctbal > 0").select(((F.col("s_nationkey") + 24) % 25).alias("k"), F.col("s_suppkey").alias("s"))
        cus = self.table("customer").where("c_acctbal > 5000").select(((F.col("c_nationkey") + 23) % 25).alias("k"), F.col("c_custkey").alias("c"))
        sup, cus = sup.where("k != 24"), cus.where("k != 24")
        homs = self.pairs.join(cus, "c").join(sup, ["s", "k"]).select("k", F.concat_ws("-", F.lit("hom"), "c", "s").alias("member"))
        return sup.select("k", keyed("sup", "s").alias("member")).unionByName(cus.select("k", keyed("cus", "c").alias("member"))).unionByName(homs).select(keyed("nat", "k").alias("kind"), "member")

    @functools.cached_property
    def nodes(self) -> DataFrame:
        """``id, title, taxon, level, of, region, kind, src, dst``: all objects, arrows and trees."""
        none = lambda name: F.lit(None).cast("string").alias(name)
        objects = self.kinds.select("id", "title", F.lit("object").alias("taxon"), F.lit("kind").alias("level"), none("of"), "region", none("kind"), none("src"), none("dst"))
        things = self.instances.select("id", "title", F.lit("object").alias("taxon"), F.lit("instance").alias("level"), "of", "region", none("kind"), none("src"), none("dst"))
        arrows = self.arrows.select("id", F.col("id").alias("title"), F.lit("morphism").alias("taxon"), none("level"), none("of"), none("region"), "kind", "src", "dst")
        prose = self.trees.select("id", "title", "taxon", none("level"), none("of"), none("region"), none("kind"), none("src"), none("dst"))
        return objects.union(things).union(arrows).union(prose)

    def keep_pairs(self) -> None:
        """From here on the joins behind these views run once, however often a plan asks."""
        from ..operators.graph import saved

        if "pairs" not in self.__dict__:
            self.pairs = saved(self.pairs)

    def graph(self):
        from ..operators.graph import saved
        from .filterql import Graph

        self.keep_pairs()
        regions = [(r.r_name, r.r_name) for r in self.table("region").orderBy("r_name").collect()]
        return Graph(saved(self.nodes), self.arrows.select("id", "kind", "src", "dst"), self.kind_data, self.about, regions)


_TAXA_SQL = "[" + ", ".join(f"'{t}'" for t in PROSE) + "]"
_PROVABLE_SQL = "(" + ", ".join(f"'{t}'" for t in PROVABLE) + ")"

#: SQL of the views, each after those it uses.
SQL_VIEWS = {
    "kinds": "SELECT 'nat-' || n_nationkey AS id, n_name AS title, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'reg-' || r_regionkey, r_name, NULL FROM region",
    "instances": "SELECT i.id, i.title, i.of, k.region FROM (SELECT 'cus-' || c_custkey AS id, c_name AS title, 'nat-' || c_nationkey AS of FROM customer UNION ALL SELECT 'sup-' || s_suppkey, s_name, 'nat-' || s_nationkey FROM supplier) i JOIN kinds k ON i.of = k.id",
    "pairs": "SELECT o_custkey AS c, l_suppkey AS s, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "nation_pairs": "SELECT c_nationkey AS a, s_nationkey AS b, CAST(sum(n) AS BIGINT) AS n FROM pairs JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey GROUP BY ALL",
    "transforms": "SELECT 'tra-' || a || '-' || b AS id, 'transform' AS kind, 'nat-' || a AS src, 'nat-' || b AS dst, n FROM nation_pairs WHERE n > (SELECT avg(n) FROM nation_pairs)",
    "homs": "SELECT 'hom-' || c || '-' || s AS id, 'hom' AS kind, 'cus-' || c AS src, 'sup-' || s AS dst, n FROM pairs",
    "arrows": "SELECT 'gen-' || n_nationkey AS id, 'generalizes' AS kind, 'nat-' || n_nationkey AS src, 'reg-' || n_regionkey AS dst, CAST(1 AS BIGINT) AS n FROM nation UNION ALL SELECT * FROM homs UNION ALL SELECT * FROM transforms",
    "trees": f"SELECT doc_id, 'doc-' || doc_id AS id, {_TAXA_SQL}[doc_id % 14 + 1] AS taxon, substr(text, 1, 60) AS title, source AS section, lang AS language, text AS body FROM documents",
    "dependencies": """SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY p) - 1 AS INTEGER) AS pos, j FROM
      (SELECT i, j, min(p) AS p FROM (SELECT doc_id AS i, unnest([1, 2, 3, 4]) AS p, unnest([doc_id // 2, doc_id // 3, doc_id // 4, doc_id // 6]) AS j FROM documents WHERE doc_id > 0) GROUP BY ALL)""",
    "about": f"SELECT id AS src, 'nat-' || (doc_id % 25) AS dst FROM trees WHERE taxon IN {_PROVABLE_SQL}",
    "data_sup": "SELECT (s_nationkey + 24) % 25 AS k, s_suppkey AS s FROM supplier WHERE s_acctbal > 0 AND s_nationkey != 0",
    "data_cus": "SELECT (c_nationkey + 23) % 25 AS k, c_custkey AS c FROM customer WHERE c_acctbal > 5000 AND c_nationkey != 1",
    "kind_data": "SELECT 'nat-' || k AS kind, 'sup-' || s AS member FROM data_sup UNION ALL SELECT 'nat-' || k, 'cus-' || c FROM data_cus UNION ALL SELECT 'nat-' || c.k, 'hom-' || p.c || '-' || p.s FROM pairs p JOIN data_cus c ON p.c = c.c JOIN data_sup s ON p.s = s.s AND c.k = s.k",
    "nodes": """SELECT id, title, 'object' AS taxon, 'kind' AS level, NULL AS of, region, NULL AS kind, NULL AS src, NULL AS dst FROM kinds
      UNION ALL SELECT id, title, 'object', 'instance', of, region, NULL, NULL, NULL FROM instances
      UNION ALL SELECT id, id, 'morphism', NULL, NULL, NULL, kind, src, dst FROM arrows
      UNION ALL SELECT id, title, taxon, NULL, NULL, NULL, NULL, NULL, NULL FROM trees""",
    "ends": "SELECT n.*, a.level AS src_level, b.level AS dst_level, a.region AS src_region, b.region AS dst_region, a.id AS src_id, b.id AS dst_id FROM nodes n LEFT JOIN nodes a ON n.src = a.id LEFT JOIN nodes b ON n.dst = b.id",
}
_USES = {
    "kinds": [], "instances": ["kinds"], "pairs": [], "nation_pairs": ["pairs"], "transforms": ["nation_pairs"], "homs": ["pairs"], "arrows": ["homs", "transforms"], "trees": [], "dependencies": [],
    "about": ["trees"], "data_sup": [], "data_cus": [], "kind_data": ["pairs", "data_sup", "data_cus"], "nodes": ["kinds", "instances", "arrows", "trees"], "ends": ["nodes"],
}


def with_views(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` (further CTEs and a final SELECT, or only the SELECT) after the named views."""
    order: list[str] = []

    def add(name: str) -> None:
        for used in _USES[name]:
            add(used)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
    tail = body.strip()
    joined = (f"{ctes},\n{tail[5:]}" if ctes else tail[5:]) if tail[:5].upper() == "WITH " else f"{ctes}\n{tail}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}" if ctes or tail[:5].upper() == "WITH " else tail

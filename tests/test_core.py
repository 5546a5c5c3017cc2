"""Operators outside the corpus package, on small fixtures."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import diagram, text, vectors
from tessera.operators import graph, layout, merge, rules, search, views
from tessera.plans.filterql import Graph, Session, chips, describe, evaluate, paint, parse, vocabulary
from tessera.streaming import mailbox

NODE = "id string, title string, taxon string, level string, of string, region string, kind string, src string, dst string"


@pytest.fixture(scope="module")
def small(spark):
    obj = lambda i, level, of=None, region=None: (i, f"Title {i}", "object", level, of, region, None, None, None)
    mor = lambda i, kind, a, b, region=None: (i, f"Title {i}", "morphism", None, None, region, kind, a, b)
    tree = lambda i, taxon: (i, f"Title {i}", taxon, None, None, None, None, None, None)
    nodes = [
        obj("obj-a", "kind", region="r1"), obj("obj-b", "kind"), obj("obj-c", "kind", region="r2"), obj("obj-a1", "instance", "obj-a", "r1"), obj("obj-a2", "instance", "obj-a"), obj("obj-b1", "instance", "obj-b"), obj("obj-c1", "instance", "obj-c"),
        mor("mor-f", "hom", "obj-a1", "obj-b1"), mor("mor-g", "generalizes", "obj-a", "obj-b"), mor("mor-h", "construction", "obj-a", "obj-c"), mor("mor-x", "hom", "obj-b1", "obj-gone"), tree("thm-one", "theorem"), tree("def-two", "definition"),
    ]
    arrows = [(n[0], n[6], n[7], n[8]) for n in nodes if n[2] == "morphism"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Graph(frame(nodes, NODE), frame(arrows, "id string, kind string, src string, dst string"), frame([("obj-c", "obj-a1"), ("obj-c", "obj-b1"), ("obj-c", "mor-f")], "kind string, member string"), frame([("thm-one", "mor-f"), ("thm-one", "obj-a")], "src string, dst string"), [("r1", "First"), ("r2", "Second")])


def ids(result):
    return sorted(r.id for r in result.ids.collect())


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ({"level": "kind"}, "mor-g mor-h obj-a obj-b obj-c"),
        ({"level": "instance"}, "mor-f obj-a1 obj-a2 obj-b1 obj-c1"),
        ({"kind-of": "obj-a"}, "obj-a1 obj-a2"),
        ({"arrow-kind": "hom"}, "mor-f mor-x obj-a1 obj-b1"),
        ({"tied-to": "obj-a"}, "mor-g mor-h obj-a obj-a1 obj-a2 obj-b obj-c"),
        ({"tied-to": "mor-f"}, "mor-f obj-a1 obj-b1"),
        ({"tied-to": "thm-one"}, "thm-one"),
        ({"tied-to": "obj-none"}, ""),
        ({"in-data-of": "obj-c"}, "mor-f obj-a1 obj-b1 obj-c"),
        ({"about": "thm-one"}, "mor-f obj-a obj-a1 obj-b1 thm-one"),
        ({"about": "obj-a"}, "obj-a thm-one"),
        ({"region": "r1"}, "obj-a obj-a1"),
        ({"taxon": "theorem"}, "thm-one"),
        ({"id": "def-two"}, "def-two"),
        ({"text": "TITLE thm"}, "thm-one"),
        ({"and": []}, None),
        ({"or": []}, ""),
        ([{"level": "instance"}, {"not": {"kind-of": "obj-a"}}], "mor-f obj-a1 obj-b1 obj-c1"),
        ({"taxon": "object", "region": "r2"}, "obj-c"),
    ],
)
def test_filters(small, expr, want):
    got = ids(evaluate(expr, small))
    assert got == (sorted(want.split()) if want is not None else sorted(r.id for r in small.nodes.collect()))


@pytest.mark.parametrize(("expr", "code"), [("", "empty"), ("{", "bad-json"), ("7", "not-an-object"), ({}, "empty"), ({"no": "x"}, "unknown-predicate"), ({"id": 3}, "bad-argument"), ({"level": "x"}, "bad-value"), ({"and": {}}, "bad-argument")])
def test_filter_problems(small, expr, code):
    result = evaluate(expr, small)
    assert result.fatal and [p.code for p in result.problems] == [code] and result.ids.count() == 0


def test_filter_depth_notes_and_counts(small):
    deep = {"id": "def-two"}
    for _ in range(12):
        deep = {"not": deep}
    assert not evaluate(deep, small).fatal and evaluate({"not": deep}, small).fatal
    assert [p.code for p in evaluate({"id": "zzz"}, small, notes=True).problems] == ["unknown-id"]
    assert [p.code for p in evaluate({"in-data-of": "obj-a"}, small, notes=True).problems] == ["no-data"]
    assert evaluate({"level": "instance"}, small).counts().first().asDict() == {"objects": 4, "arrows": 1, "trees": 0, "total": 5}


def test_describe_chips_session(small):
    assert describe({"and": [{"level": "kind"}, {"not": {"kind-of": "obj-a"}}]}, {"obj-a": "A"}) == "kinds of structure and the relations between them and not instances of the kind A"
    assert describe({"or": []}) == "nothing" and describe([]) == "everything" and parse("[]")[0] == []
    assert [c["id"] for c in chips(small)][:3] == ["level-kind", "level-instance", "only-hom"]
    assert vocabulary(small).where("part = 'predicate'").count() == 13
    s = Session(small)
    assert s.apply({"kind-of": "obj-a"})["count"] == 2 and not s.apply({"id": "zzz"})["ok"] and s.expr == {"kind-of": "obj-a"}
    s.hide()
    assert Session.read_link(s.link()) == {"filter": {"kind-of": "obj-a"}, "hide": True, "tree": None, "errors": []}
    assert s.back() and not s.hidden and s.back() and s.expr is None and not s.back() and s.forward()
    states = {r.id: r.state for r in paint(small, small.nodes.where("id = 'obj-a'").select("id")).collect()}
    assert states["obj-a"] == "match" and states["obj-b"] == "out" and states["thm-one"] == "plain"


def test_text(spark):
    def one(col):
        return spark.range(1).select(col.alias("x")).first().x

    lit = F.lit
    assert one(text.fold(lit("Őř Ǖ x\u0301 Ł"))) == text.fold_text("Őř Ǖ x\u0301 Ł") == "or u x ł"
    assert one(text.fold(lit("Čevapi Đ É"))) == "cevapi d e" and one(text.tokens(lit("a bb, Bb c3"))) == ["bb", "bb", "c3"]
    assert one(text.body_to_text(lit("# T **b** [[def-x|lab]] [[def-y#a]]\n```cd\nA\n``` $x$ $$y$$"))) == "T b lab def-y x y"
    assert one(text.links(lit("[[a]] [[b#c|d]] [[a]]"))) == ["a", "b", "a"] and one(text.plain_title(lit(r"On $\mathbb{R}$"))) == "On R"
    assert one(text.scrollback(lit("Kao: vidjeli smo."))) and not one(text.scrollback(lit("xvidjeli smox")))
    assert one(text.anchor(lit("Šuma i More!"))) == "#suma-i-more" and one(text.escape_html(lit("<a'b>"))) == "&lt;a&#39;b&gt;"
    assert one(text.rewritten_links(lit("x [[a]] [[b|L]] [[c]]"), F.create_map(lit("a"), lit("A")))) == "x *A* *L* *c*"
    assert text.wrap_label("one two three four", 7, 2) == ["one two", "three…"]
    v = F.array(lit(0.5), lit(-1.0), lit(0.25))
    assert one(vectors.quantized(v)) == [64, -127, 32] and one(vectors.scale(F.array(lit(0.0)))) == 1.0
    assert one(vectors.jaccard(F.array(lit("a")), F.array(lit("a"), lit("b")))) == 0.5 and one(vectors.cosine(v, F.array(lit(0.0), lit(0.0), lit(0.0)))) == 0
    assert one(vectors.hint(lit(None).cast("double"), lit(0.5), lit(0.0))) == "related"


def test_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("a", "d")], "src string, dst string")
    assert sorted(map(tuple, graph.transitive_reduction(edges).collect())) == [("a", "b"), ("b", "c"), ("c", "d")]
    assert {r.id: r.depth for r in graph.longest_path_depth(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0}
    assert not graph.has_cycle(nodes, edges)
    assert graph.first_cycle(nodes, edges.union(spark.createDataFrame([("d", "b")], edges.schema))) == ["b", "c", "d", "b"]


def test_layout():
    arrows = [{"id": i, "from": a, "to": b, "kind": "hom"} for i, a, b in (("m1", "x", "y"), ("m2", "y", "x"), ("m3", "x", "x"), ("m4", "y", "z"))]
    assert layout.break_cycles(["x", "y", "z"], arrows) in ({"m1"}, {"m2"})
    assert layout.break_cycles(["z", "y", "x"], arrows[::-1]) == layout.break_cycles(["x", "y", "z"], arrows)
    assert layout.layers(list("abcd"), [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("a", "d")]) == {"a": 0, "b": 1, "c": 1, "d": 2}
    sizes = {i: (180.0, 56.0) for i in "abcdefgh"}
    one = layout.placed_region(list("abcdefgh"), [("a", "b"), ("b", "c")], sizes, {"a": (10.0, 10.0)})
    assert one == layout.placed_region(list("hgfedcba"), [("b", "c"), ("a", "b")], sizes, {"a": (10.0, 10.0)}) and one["a"] == (10, 10)
    assert layout.segment_hits_box((0, 0), (10, 0), (4, -1, 6, 1)) and not layout.segment_hits_box((0, 5), (10, 5), (4, -1, 6, 1))
    got = layout.plane(["r"], {"a": "r", "b": "q"}, sizes, arrows)
    assert set(got["at"]) == set(sizes) and list(got["frames"]) == ["r", "q", ""]


def test_group_layout_places_every_document(spark, tmp_path):
    from tessera.plans.registry import QUERIES

    rows = [(4, "s"), (2, "s"), (2_000_000_000, "s"), (3_000_000_000, "t"), (None, "s"), (None, "s")]
    spark.createDataFrame([(i, "x", "en", s, 1) for i, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["group_layout"](spark, str(tmp_path)).collect()
    assert sorted((r.group, r.id or "") for r in got) == sorted((s, f"doc-{i}" if i is not None else "") for i, s in rows)
    assert len({(r.group, r.x, r.y) for r in got}) == len(rows) and {r.id: r.x for r in got}["doc-2"] < {r.id: r.x for r in got}["doc-4"]


def test_views(spark):
    trees = spark.createDataFrame([("thm-a", "theorem", None, None, None, None), ("prf-a", "proof", "thm-a", None, None, None), ("prf-b", "proof", None, None, None, None), ("obj-k", "object", None, None, None, None), ("obj-i", "object", None, "obj-k", None, None), ("mor-f", "morphism", None, None, "obj-i", "obj-k"), ("rem-x", "remark", None, None, None, None)], "id string, taxon string, proves string, instance_of string, src string, dst string")
    links = spark.createDataFrame([(1, 1, "thm-a"), (2, 1, "obj-k"), (2, 2, "thm-a")], "section int, link int, id string")
    deps = spark.createDataFrame([("prf-b", 0, "rem-x"), ("prf-b", 1, "thm-a")], "id string, pos int, ref string")
    got = {r.id: (r.section, r["pass"], r.place) for r in views.build_groups(links, trees, deps).collect()}
    assert got == {"thm-a": (1, 0, 1), "prf-a": (1, 1, 2), "prf-b": (1, 1, 3), "obj-k": (2, 0, 1), "obj-i": (2, 2, 2), "mor-f": (2, 3, 3), "rem-x": (None, 4, 1)}
    # A chain of proofs of proofs of any length is followed to its end.
    long = [("thm-a", "theorem", None)] + [(f"prf-{k:03}", "proof", f"prf-{k - 1:03}" if k else "thm-a") for k in range(70)]
    chain = spark.createDataFrame([(*x, None, None, None) for x in long], trees.schema)
    assert {r.section for r in views.build_groups(links.where("id = 'thm-a' and section = 1"), chain, deps.limit(0)).collect()} == {1}
    done = spark.createDataFrame([("thm-a",)], "id string")
    assert {r.id: r.state for r in views.readiness(trees, deps, done).collect()} == {"thm-a": "done", "prf-a": "ready", "prf-b": "not", "obj-k": "ready", "obj-i": "ready", "mor-f": "ready", "rem-x": "ready"}
    named = links.withColumn("title", F.concat(F.lit("S"), F.col("section").cast("string")))
    assert {r.id: r.title for r in views.index_groups(named, trees, deps).collect()} == {"thm-a": "S1", "obj-k": "S2", "obj-i": "S2", "mor-f": "S2", "prf-b": "S1"}


def test_instance_page_counts(spark):
    """Equal to the grouped page on odd rows; a kind with many instances and many refs is not multiplied out."""
    rows = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} string" for n in names.split()))
    instances = rows([("a", "k"), ("a", "k"), ("a", "l"), ("b", "k"), ("c", None), (None, "k"), ("d", "m")], "id of")
    arrows = rows([("f", "hom", "a", "b"), ("g", "hom", "a", "a"), ("e", "hom", None, "b"), ("h", "hom", "b", None), ("k1", "data", "k", "l"), ("k2", None, "k", "a"), ("l1", "hom", "k", "b"), ("m1", "transform", "m", "m"), (None, "data", "m", "a")], "id kind src dst")
    kind_data, about = rows([("k", "a"), ("k", "a"), ("l", "f"), (None, "b"), ("m", None)], "kind member"), rows([("t", "k"), ("u", "k"), ("t", "a"), ("v", None), (None, "m")], "src dst")
    want = views.instance_page(instances, arrows, kind_data, about).groupBy("id", "part").agg(F.count("*").alias("n"), F.min("ref").alias("first"))
    got = views.instance_page_counts(instances, arrows, kind_data, about)
    key = lambda r: tuple((x is None, x) for x in r)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    many = 50_000
    members, told = spark.range(many).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("k").alias("of")), spark.range(many).select(F.concat(F.lit("t"), "id").alias("src"), F.lit("k").alias("dst"))
    page = views.instance_page_counts(members, arrows.limit(0), kind_data.limit(0), told)
    assert page.groupBy("part", "n", "first").count().collect() == [("about-kind", many, "t0", many)]


def test_search_and_merge(spark):
    items = spark.createDataFrame([("a", "the red fox", [1.0, 0.0]), ("b", "a fox", [0.0, 1.0]), ("c", "nothing", None)], "id string, text string, vector array<double>")
    assert [r.id for r in search.hybrid_search(items, "red fox", [0.9, 0.1], 3).collect()] == ["a", "b", "c"]
    ranks = {r.id: r.k for r in search.competition_rank(spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 2.0), ("d", 0.0)], "id string, s double"), "s", "k").collect()}
    assert ranks == {"a": 1, "b": 3, "c": 1, "d": 4}
    assert merge.free_ids(["thm-a", "thm-a2"], {"thm-x-a", "thm-x-a-2"}, "x") == {"thm-a": "thm-x-a-3", "thm-a2": "thm-x-a2"}
    rows = spark.createDataFrame([("t1", "digest", None, None, None), ("t2", "member", None, None, None), ("t3", "agent", "1-2", None, None)], "id string, origin string, source_pages string, license string, attribution string")
    verdicts = {r.id: r.verdict for r in merge.firewall(rows, True).collect()}
    assert verdicts == {"t1": "derived", "t2": "pass", "t3": "has-pages"} and {r.verdict for r in merge.firewall(rows, "yes").collect()} == {"unknown-provenance"}
    assert merge.first_refused(merge.firewall(rows, True), "id").first().id == "t1"
    proofs = spark.createDataFrame([("p", None), ("q", "t")], "id string, target string")
    lists = spark.createDataFrame([("p", ["x", "y"], ["y"]), ("q", ["x"], ["x"])], "id string, refs array<string>, provable array<string>")
    assert {r.id: (r.proves, r.refs) for r in merge.resolved_proofs(proofs, lists).collect()} == {"p": ("y", ["x", "y"]), "q": ("t", ["x", "t"])}
    assert merge.manifest([{"id": "a", "teaches": ["x"], "requires": ["x", "y"]}], "blog", "My Title", "en", "me", "CC0", "2024-01-01")["requires"] == ["y"]


def test_diagram(spark):
    got = diagram.parse("% title: Square\nA @ 0,0 : X\nB @ 1,0 : Y\nC @ 1,1 : Z\nf: A -> B : f [left, bend=0.5]\ng: B -> C : g\nh: A -> C : h\nf g = h : def\nf h = g : [[thm-x]]\nwhat is this?")
    assert got["title"] == "Square" and len(got["arrows"]) == 3 and got["arrows"][0]["bend"] == 0.5 and not got["equations"][0]["error"] and got["equations"][1]["error"]
    assert len(got["errors"]) == 1 and diagram.composite(["f", "g"], got["arrows"]) == r"g \circ f"
    # A corner and an arrow need no label, names may begin with an underscore, a title only counts on the first line.
    got = diagram.parse("_a @ 0,1\n% title: late\nB' @ 2,0:\n_a -> B'\nx: _a -> B' : {[k]} [iso, above, dotted, shift=-2]\nid = x : def")
    assert got["title"] == "" and [c["name"] for c in got["corners"]] == ["_a", "B'"] and got["arrows"][0]["name"] is None and got["errors"] == []
    assert [got["arrows"][1][k] for k in ("tex", "head", "side", "line", "shift")] == ["{[k]}", "iso", "above", "dotted", -2] and got["equations"][0]["error"]
    head = "A @ 0,0\nB @ 1,0\nf: A -> B : f"
    for line, errors, arrows in (
        ("A @ 1,1", 1, 1), ("C @ -1,0", 1, 1), ("C @ 0.5,0", 1, 1), ("f: B -> A : again", 1, 1), ("g: A -> C", 1, 1), ("g: A -> A", 1, 1), ("g: A -> B : x [bend=2]", 1, 2), ("g: A -> B : x [shift=1.5]", 1, 2),
        ("g: A -> B : x [solid]", 1, 2), ("g: A -> B : x [double, mono]", 1, 2), ("g: A -> B : x [hook, mapsto]", 0, 2), (r"g: A -> B : [\alpha]", 0, 2), ("g: A -> B : x [bend=-1, equal]", 0, 2),
    ):
        got = diagram.parse(f"{head}\n{line}")
        assert (len(got["errors"]), len(got["arrows"])) == (errors, arrows), line
    loop = "A @ 0,0\nB @ 1,0\nf: A -> B\ng: B -> A\n"
    for line, fine in (("f g = id : def", True), ("id = g f : [[thm-a|by it]]", True), ("f = id : def", False), ("f g = f g", False), ("f f = f : def", False), ("f x = f : def", False), ("f g f = f : because", False), ("id id = id : def", True)):
        assert (diagram.parse(loop + line)["equations"][0]["error"] is None) == fine, line
    links = {"[[a]]": True, "[[a#b]]": True, "[[a|b#c]]": True, "[[a#b|c]]": True, "[[#b]]": False, "[[]]": False, "[[a]b]]": False, "[a]": False, "[[a[b]]": False, "x [[a]]": False, "[[ a ]]": True}
    assert {x: diagram.is_reference(x) for x in links} == links
    for line in ("A @ 0", "A 0,0", "1A @ 0,0", "A @ 0,0 tex", "A -> ", "f: g: A -> B", "-> B", "= f", "f =", "f = g = h", "f+g = h", "A @ 0,0,0", "ä -> B"):
        assert len(diagram.parse(line)["errors"]) == 1 and not diagram.parse(line)["arrows"], line
    got = diagram.parse("%title:  T: x \r\nA@0,1:a:b\r\nB@1,1\r\nf:A->B:x [ bend = -0.25 , left ]\r\n% title: no\r\nf   2f'=id:def")
    assert (got["title"], got["corners"][0]["tex"], got["arrows"][0]["bend"], got["arrows"][0]["side"], got["arrows"][0]["tex"]) == ("T: x", "a:b", -0.25, "left", "x") and got["equations"][0]["lhs"] == ["f", "2f'"]
    rows = spark.createDataFrame([(head,), (None,)], "s string").select(diagram.parsed("s").alias("d"))
    assert [len(r.d.arrows) for r in rows.collect()] == [1, 0]


def brute_reach(pairs):
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    return reach


def test_graph_against_brute_force(spark):
    import random

    rng = random.Random(4)
    for cyclic in (False, True):
        pairs = {(a, b) for a, b in ((rng.randrange(14), rng.randrange(14)) for _ in range(26)) if cyclic or a < b}
        edges, nodes = spark.createDataFrame(sorted(pairs), "src int, dst int"), spark.createDataFrame([(i,) for i in range(15)], "id int")
        reach = brute_reach(pairs)
        assert set(map(tuple, graph.reachable(edges).collect())) == reach
        if not cyclic:
            assert set(map(tuple, graph.transitive_reduction(edges).collect())) == {(a, b) for a, b in pairs if not any((a, w) in pairs and (w, b) in reach for w in range(15))}
        bad = {i for i in range(15) if any((c, c) in reach and (c == i or (c, i) in reach) for c in range(15))}
        depth = {}
        for i in range(15):
            depth[i] = None if i in bad else 0
        for _ in range(15):
            for a, b in pairs:
                if depth[a] is not None and depth[b] is not None:
                    depth[b] = max(depth[b], depth[a] + 1)
        assert {r.id: r.depth for r in graph.longest_path_depth(nodes, edges).collect()} == depth
        assert graph.has_cycle(nodes, edges) == bool(bad)
    chain = spark.range(40).selectExpr("id as src", "id + 1 as dst")
    assert graph.longest_path_depth(spark.range(41), chain).agg({"depth": "max"}).first()[0] == 40
    three = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {r.depth for r in graph.longest_path_depth(spark.range(1, 5), three).collect()} == {None}
    empty = edges.limit(0)
    assert graph.reachable(empty).count() == 0 and graph.transitive_reduction(empty).count() == 0 and graph.longest_path_depth(nodes.limit(0), empty).count() == 0


def test_cycles_are_turned_against_the_grain():
    def turned(*arrows):
        return layout.break_cycles(list("abcd"), [{"id": i, "kind": k, "from": x, "to": y} for i, k, x, y in arrows])

    # The node with more forward arrows out of it begins, so the arrow back to it is turned; other kinds have no say.
    assert turned(("1", "hom", "b", "a"), ("2", "construction", "a", "b")) == {"2"}
    assert turned(("1", "construction", "b", "a"), ("2", "construction", "a", "b")) == {"1"}
    assert turned(("1", "instance", "a", "b"), ("2", "hom", "b", "a"), ("3", "data", "a", "a")) == set()
    assert turned(("1", "generalizes", "a", "b"), ("2", "data", "a", "c"), ("3", "hom", "c", "a"), ("4", "hom", "b", "c")) == {"1", "2"}


def test_match_and_vector_topk(spark):
    import random

    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(40)}" for _ in range(n)]
    rows = [(f"i{k:03}", sorted(set(word(4))), sorted(set(word(rng.choice([0, 3, 9])))), [rng.gauss(0, 1) for _ in range(4)] if k % 3 else None) for k in range(60)]
    schema = "id string, words array<string>, concepts array<string>, vector array<double>"
    asked = [("c1", rows[3][1], rows[3][2], [1.0, 0.0, 0.0, 0.0]), ("c2", [], [], None), ("c3", ["none"], ["none"], [0.0] * 4)]
    got = search.match(spark.createDataFrame(asked, schema), spark.createDataFrame(rows, schema).repartition(3), 4).collect()

    def scored(c, i):
        both, least = len(set(c[2]) | set(i[2])), min(len(c[1]), len(i[1]))
        cos = sum(a * b for a, b in zip(c[3], i[3])) / sum(b * b for b in i[3]) ** 0.5 if c[3] and any(c[3]) and i[3] else None
        concepts, title = len(set(c[2]) & set(i[2])) / both if both else 0, len(set(c[1]) & set(i[1])) / least if least else 0
        return round((cos or 0) + 0.5 * concepts + 0.3 * title, 9), cos, concepts, title

    for c in asked:
        want = sorted(rows, key=lambda i: (-scored(c, i)[0], i[0]))[:4]
        mine = sorted((r for r in got if r.candidate == c[0]), key=lambda r: r.place)
        assert [r.id for r in mine] == [w[0] for w in want]
        for r, w in zip(mine, want, strict=True):
            _, cos, concepts, title = scored(c, w)
            assert (r.cosine is None) == (cos is None) and abs((r.cosine or 0) - (cos or 0)) < 1e-4 and abs(r.concepts - concepts) < 1e-6 and abs(r.title_overlap - title) < 1e-6
    vectors = spark.createDataFrame([(k, r[3]) for k, r in enumerate(rows)], "id long, vector array<double>")
    top = search.vector_topk(vectors.where("id % 20 = 1"), vectors.repartition(3), 3).collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / sum(y * y for y in b) ** 0.5, 6)
    for q in (1, 41):
        want = sorted((k for k in range(60) if k != q and rows[k][3]), key=lambda k: (-cos(rows[q][3], rows[k][3]), k))[:3]
        assert [r.id for r in sorted((r for r in top if r.query == q), key=lambda r: r.place)] == want
    assert search.vector_topk(vectors.limit(0), vectors, 3).count() == 0 and search.match(spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)).count() == 0


HEADER = {"schema_version": "forest-0.3", "source": {"title": "T", "authors": [], "year": 2020, "kind": "book", "license": "CC0"}, "language": "en", "created": "2024-01-01", "tool": "t", "tool_version": "1", "derivative": False}


def tree_file(folder, stem, body="Text.", **header):
    taxa = {"thm": "theorem", "def": "definition", "prf": "proof", "obj": "object", "mor": "morphism"}
    base = {"id": stem, "taxon": taxa[stem[:3]], "title": stem, "teaches": [], "requires": [], "depends": [], "standalone": True} | header
    (folder / f"{stem}.md").write_text("---\n" + "\n".join(f"{k}: {json.dumps(v)}" for k, v in base.items()) + f"\n---\n{body}\n")


def test_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    from tessera.sources import vault

    folder = tmp_path / "trees"
    folder.mkdir()
    definition = "## Definition\n"
    tree_file(folder, "def-a", depends=["thm-b"])
    tree_file(folder, "thm-b", depends=["def-a", "def-gone"], body="See [[def-a]] and [[def-none]]. As we saw.")
    tree_file(folder, "prf-c")
    tree_file(folder, "obj-k", body=definition, symbol="K", hom="maps")
    tree_file(folder, "obj-l", body=definition, symbol="$L$", hom="maps", data=["obj-i", "mor-f", "thm-b"])
    tree_file(folder, "obj-i", symbol="I", instance_of="obj-k")
    tree_file(folder, "obj-j", symbol="J", instance_of="obj-i")
    tree_file(folder, "mor-f", kind="hom", statement="f", needs=["x"], **{"from": "obj-i", "to": "obj-k"})
    tree_file(folder, "mor-g", kind="generalizes", statement="g", needs=["x"], acts_on="all", functorial=True, inverse="mor-f", **{"from": "obj-k", "to": "obj-l"})
    (folder / "thm-bad.md").write_text("no header")
    (folder / "thm-worse.md").write_text("---\na: [\n---\n")
    found = rules.violations(vault.read_trees(spark, str(tmp_path)), HEADER, index_links=spark.createDataFrame([("zzz",)], "id string"))
    got = {(r.rule, r.file) for r in found.collect()}
    for want in (("T24", "thm-b.md"), ("T31", "thm-b.md"), ("T32", "thm-b.md"), ("T29", "prf-c.md"), ("O01", "obj-l.md"), ("O11", "obj-l.md"), ("O10", "obj-l.md"), ("O14", "obj-j.md"), ("M12", "mor-f.md"), ("M31", "mor-g.md"), ("T03", "thm-bad.md"), ("T04", "thm-worse.md"), ("I02", "index.md"), ("D01", "def-a.md"), ("U08", "obj-l.md")):
        assert want in got, want
    assert rules.check_header(HEADER) == [] and {r for r, _ in rules.check_header({"schema_version": "x"})} >= {"V12", "V13", "V23", "V27"}
    assert vault.core_yaml("a: yes\nb: 2024-01-01\nc: true\nd: 1") == {"a": "yes", "b": "2024-01-01", "c": True, "d": 1}


def objects(**more):
    return {"id": "obj-a", "taxon": "object", "title": "A", "teaches": [], "requires": [], "depends": [], "standalone": True, "symbol": "A", "hom": "maps"} | more


def arrows(**more):
    return {"id": "mor-a", "taxon": "morphism", "title": "A", "teaches": [], "requires": [], "depends": [], "standalone": True, "kind": "property", "from": "obj-a", "to": "obj-b", "statement": "s", "acts_on": "all", "needs": ["x"]} | more


def prose(**more):
    return {"id": "thm-a", "taxon": "theorem", "title": "A", "teaches": [], "requires": [], "depends": [], "standalone": True} | more


def less(row, *keys):
    return {k: v for k, v in row.items() if k not in keys}


V1, V2, V3 = rules.VERSIONS
ROWS = [
    # (rule, tree, stem, version, derivative): the one rule that each tree breaks
    ("T06", prose(zzz=1), "thm-a", V3, False), ("T06", prose(region="r"), "thm-a", V2, False), ("T07", prose(id="thm-b"), "thm-a", V3, False), ("T08", prose(id="thm-A"), "thm-A", V3, False), ("T08", prose(id="zzz-a"), "zzz-a", V3, False),
    ("T09", prose(taxon="saga"), "thm-a", V3, False), ("T10", prose(taxon="lemma"), "thm-a", V3, False), ("T12", prose(title=" "), "thm-a", V3, False), ("T13", prose(teaches="x"), "thm-a", V3, False), ("T13", less(prose(), "requires"), "thm-a", V3, False),
    ("T15", prose(depends=[1]), "thm-a", V3, False), ("T16", prose(standalone="yes"), "thm-a", V3, False), ("T17", prose(source={"pages": 3}), "thm-a", V3, False), ("T17", prose(source={"zzz": "3"}), "thm-a", V3, False), ("T18", prose(language="de"), "thm-a", V3, False),
    ("T19", prose(adapted_from=""), "thm-a", V3, False), ("T20", prose(digested_from="book/x"), "thm-a", V3, False), ("T21", prose(origin="alien"), "thm-a", V3, False), ("T22", prose(), "thm-a", V3, True), ("T23", prose(origin="member", source={"pages": "1"}), "thm-a", V3, True),
    ("T25", prose(proves="thm-b"), "thm-a", V3, False), ("T28", prose(id="prf-a", taxon="proof", proves="thm-b"), "prf-a", V3, False), ("U01", prose(about="x"), "thm-a", V3, False), ("U04", prose(fields=["A B"]), "thm-a", V3, False), ("U05", prose(assumes=[1]), "thm-a", V3, False),
    ("U06", prose(region="Not Kebab"), "thm-a", V3, False), ("O01", objects(symbol="$A$"), "obj-a", V3, False), ("O02", objects(type="obj-b", instance_of="obj-c"), "obj-a", V3, False), ("O03", less(objects(), "hom"), "obj-a", V3, False), ("O04", objects(values={"a": "b"}), "obj-a", V3, False),
    ("O05", objects(data="x"), "obj-a", V3, False), ("O13", less(objects(instance_of="obj-a"), "hom"), "obj-a", V3, False), ("O15", objects(instance_of="obj-b", hom=" "), "obj-a", V3, False), ("O16", objects(instance_of="obj-b", data=[]), "obj-a", V3, False), ("O17", objects(instance_of="obj-b", values=[1]), "obj-a", V3, False),
    ("O20", objects(instance_of="obj-b", values={"a": 1}), "obj-a", V3, False), ("O21", objects(pos=[1]), "obj-a", V3, False), ("O21", objects(pos=[1, True]), "obj-a", V3, False), ("O22", objects(same_as="mor-b"), "obj-a", V3, False), ("O23", objects(nlab={"title": "x"}), "obj-a", V3, False),
    ("M01", arrows(kind="zzz"), "mor-a", V3, False), ("M02", arrows(**{"from": 1}), "mor-a", V3, False), ("M03", arrows(**{"from": "pt"}), "mor-a", V3, False), ("M04", arrows(**{"from": "pt"}), "mor-a", V2, False), ("M05", less(arrows(kind="instance"), "acts_on"), "mor-a", V2, False), ("M08", arrows(statement="$s$"), "mor-a", V3, False),
    ("M09", arrows(label="$l$"), "mor-a", V3, False), ("M10", arrows(needs=[""]), "mor-a", V3, False), ("M11", arrows(values={}), "mor-a", V3, False), ("M13", arrows(kind="instance", **{"from": "pt"}), "mor-a", V2, False), ("M15", arrows(kind="hom"), "mor-a", V3, False),
    ("M16", less(arrows(kind="hom"), "acts_on", "needs"), "mor-a", V3, False), ("M19", less(arrows(kind="hom", invertible="x"), "acts_on"), "mor-a", V3, False), ("M20", arrows(values={"a": "b"}), "mor-a", V2, False), ("M21", less(arrows(), "acts_on"), "mor-a", V3, False), ("M22", arrows(acts_on="some"), "mor-a", V3, False),
    ("M25", less(arrows(), "needs"), "mor-a", V3, False), ("M26", arrows(on_homomorphisms=""), "mor-a", V3, False), ("M27", arrows(functorial="x"), "mor-a", V3, False), ("M28", arrows(kind="generalizes"), "mor-a", V3, False), ("M29", arrows(invertible=True), "mor-a", V3, False), ("M34", arrows(up_to="def-x"), "mor-a", V3, False),
    ("M36", arrows(generalized_by="x"), "mor-a", V3, False),
]


@pytest.mark.parametrize(("rule", "tree", "stem", "version", "derivative"), ROWS)
def test_rule_on_one_tree(rule, tree, stem, version, derivative):
    got = {r for r, *_ in rules.check_tree(tree, stem, version, derivative)}
    assert got == {rule}


def test_trees_without_a_fault():
    for version in rules.VERSIONS:
        assert rules.check_tree(prose(), "thm-a", version, False) == []
    for tree, stem in ((objects(), "obj-a"), (objects(instance_of="obj-b", values={"mor-x": "v"}, pos=[0, 1.5]), "obj-a"), (arrows(), "mor-a"), (arrows(kind="generalizes", functorial=True), "mor-a"), (less(arrows(kind="hom", invertible=True), "acts_on"), "mor-a")):
        assert rules.check_tree(tree, stem, V3, False) == []
    assert {r for r, *_ in rules.check_tree(objects(), "obj-a", V1, False)} >= {"T11"}


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("V05", {"zzz": 1}), ("V06", {"regions": "x"}), ("V07", {"regions": ["x"]}), ("V08", {"regions": [{"id": "a", "title": "A", "zzz": 1}]}), ("V09", {"regions": [{"id": "A B", "title": "A"}]}), ("V10", {"regions": [{"id": "a", "title": "A"}] * 2}), ("V11", {"regions": [{"id": "a"}]}), ("V12", {"schema_version": "forest-9"}),
        ("V13", {"source": 1}), ("V14", {"source": {"zzz": 1}}), ("V15", {"source": {"title": ""}}), ("V16", {"source": {"authors": "x"}}), ("V17", {"source": {"year": "x"}}), ("V17", {"source": {"year": True}}), ("V18", {"source": {"kind": "film"}}), ("V19", {"source": {"file": "", "pages": "1"}}), ("V20", {"source": {"license": ""}}),
        ("V21", {"source": {"pages": 1}}), ("V22", {"source": {"file": "x.pdf"}}), ("V23", {"language": "de"}), ("V24", {"created": "1.1.2024"}), ("V25", {"tool": ""}), ("V26", {"tool_version": ""}), ("V27", {"derivative": "x"}), ("V28", {"source": {"redistribution": "all"}}), ("V29", {"derivative": True}), ("V30", {"notice": "x"}),
    ],
)
def test_rule_on_the_header(rule, change):
    header = dict(HEADER)
    if isinstance(change.get("source"), dict):
        change = {"source": HEADER["source"] | change["source"]}
    assert {r for r, _ in rules.check_header(header | change)} == {rule}
    assert rules.check_header(HEADER | {"regions": [{"id": "a", "title": "A"}]}) == [] and [r for r, _ in rules.check_header([])] == ["V04"]
    assert rules.check_header(HEADER | {"derivative": True, "notice": rules.NOTICES[0]}) == []


def test_rules_on_references(spark, tmp_path):
    """A corpus without a fault, and one where each reference rule is broken by a tree of its own."""
    pytest.importorskip("yaml")
    from tessera.sources import vault

    def trees(folder, broken):
        (folder / "trees").mkdir(parents=True)
        put = lambda stem, body="Text.", **h: tree_file(folder / "trees", stem, body, **h)
        define = "## Definition\n"
        put("thm-a", about=["obj-k"], teaches=["known"])
        put("prf-a", depends=["thm-a"])
        put("obj-k", define, symbol="K", hom="maps", data=["obj-l1", "mor-up", "obj-l2"])
        put("obj-l", define, symbol="L", hom="maps")
        put("obj-k1", symbol="k", instance_of="obj-k", values={"mor-p": "yes"})
        put("obj-l1", symbol="l", instance_of="obj-l")
        put("obj-l2", symbol="l", instance_of="obj-l")
        put("mor-p", kind="property", statement="p", acts_on="all", needs=["x"], **{"from": "obj-k", "to": "obj-l"})
        put("mor-d", kind="data", statement="d", acts_on="all", needs=["x"], **{"from": "obj-k", "to": "obj-l"})
        put("mor-t", kind="transform", statement="t", acts_on=["mor-d"], needs=["x"], inverse="mor-u", **{"from": "obj-k", "to": "obj-l"})
        put("mor-u", kind="transform", statement="u", acts_on="all", needs=["x"], inverse="mor-t", up_to="thm-a", **{"from": "obj-l", "to": "obj-k"})
        put("mor-g", kind="generalizes", statement="g", acts_on="all", functorial=True, needs=["x"], generalized_by=["mor-p"], **{"from": "obj-k", "to": "obj-l"})
        put("mor-up", kind="hom", statement="h", needs=["x"], **{"from": "obj-l1", "to": "obj-l2"})
        if not broken:
            return
        put("thm-t24", depends=["gone"])
        put("prf-t26", depends=["gone2"], proves="gone2")
        put("prf-t27", depends=["obj-k"], proves="obj-k")
        put("prf-t29")
        put("prf-t30", depends=["thm-a", "thm-t24"])
        put("thm-1")
        put("thm-t31", "See [[thm-1]], [[ thm-1 ]], [[thm-1]] and [[gone]].")
        put("thm-t32", "Kao, vidjeli smo.")
        put("thm-t14", teaches=["unknown"])
        put("thm-u02", about=["gone"])
        put("thm-u03", about=["thm-a"])
        put("thm-u07", region="far")
        put("obj-u8", symbol="U", hom="maps")
        put("obj-o06", define, symbol="O", hom="maps", data=["gone", "obj-k", "thm-a", "mor-up"])
        put("obj-o61", symbol="o", instance_of="obj-o06", values={"mor-p": "x", "gone": "y"})
        put("obj-o08", define, symbol="O", hom="maps", data=["obj-o81", "obj-k2"])
        put("obj-o81", symbol="o", instance_of="obj-o08")
        put("obj-k2", symbol="k", instance_of="obj-k", about=["obj-l2"])
        put("obj-o12", symbol="o", instance_of="gone")
        put("obj-o14", symbol="o", instance_of="obj-l1")
        put("mor-m06", kind="property", statement="m", acts_on="all", needs=["x"], **{"from": "gone", "to": "thm-a"})
        put("mor-m12", kind="hom", statement="m", needs=["x"], **{"from": "obj-k", "to": "obj-l1"})
        put("mor-m18", kind="hom", statement="m", needs=["x"], **{"from": "obj-k1", "to": "obj-l1"})
        put("mor-m23", kind="property", statement="m", acts_on=["gone"], needs=["x"], **{"from": "obj-k", "to": "obj-l"})
        put("mor-m24", kind="property", statement="m", acts_on=["mor-p"], needs=["x"], **{"from": "obj-k", "to": "obj-l"})
        put("mor-m30", kind="transform", statement="m", acts_on="all", needs=["x"], inverse="thm-a", up_to="gone", generalized_by=["obj-k"], **{"from": "obj-k", "to": "obj-l"})
        put("mor-m31", kind="transform", statement="m", acts_on="all", needs=["x"], inverse="mor-u", **{"from": "obj-l", "to": "obj-k"})
        put("mor-m33", kind="hom", statement="m", needs=["x"], inverse="mor-up", invertible=False, **{"from": "obj-l2", "to": "obj-l1"})

    known = spark.createDataFrame([("known",)], "id string")
    header = HEADER | {"regions": [{"id": "near", "title": "Near"}]}
    trees(tmp_path / "good", False)
    assert [tuple(r) for r in rules.violations(vault.read_trees(spark, str(tmp_path / "good")), header, known).collect()] == []
    trees(tmp_path / "bad", True)
    got = {(r.rule, r.file.removesuffix(".md")) for r in rules.violations(vault.read_trees(spark, str(tmp_path / "bad")), header, known).collect()}
    want = {
        ("T24", "thm-t24"), ("T24", "prf-t26"), ("T26", "prf-t26"), ("T27", "prf-t27"), ("T29", "prf-t29"), ("T30", "prf-t30"), ("T31", "thm-t31"), ("T32", "thm-t32"), ("T14", "thm-t14"), ("U02", "thm-u02"), ("U03", "thm-u03"), ("U07", "thm-u07"),
        ("U08", "obj-u8"), ("U09", "obj-u8"), ("U10", "obj-u8"), ("U09", "obj-o06"), ("U09", "obj-o08"), ("O06", "obj-o06"), ("O07", "obj-o06"), ("O11", "obj-o06"), ("O10", "obj-o06"), ("O18", "obj-o61"), ("O19", "obj-o61"), ("O08", "obj-o08"), ("O09", "obj-o08"),
        ("O12", "obj-o12"), ("O14", "obj-o14"), ("M06", "mor-m06"), ("M07", "mor-m06"), ("M12", "mor-m12"), ("M18", "mor-m18"), ("M23", "mor-m23"), ("M24", "mor-m24"), ("M30", "mor-m30"), ("M35", "mor-m30"), ("M37", "mor-m30"), ("M31", "mor-m31"),
        ("M32", "mor-m31"), ("M31", "mor-m33"), ("M33", "mor-m33"),
    }
    assert got == want


def test_rules_on_files(spark, tmp_path):
    pytest.importorskip("yaml")

    def found(folder, **how):
        return {(r.rule, r.file) for r in rules.check_vault(spark, str(folder), **how).collect()}

    assert found(tmp_path / "none") == {("V01", str(tmp_path / "none"))}
    one = tmp_path / "one"
    one.mkdir()
    assert found(one) == {("V02", "forest.json"), ("T01", "trees"), ("I01", "index.md"), ("W02", "views/dag.md"), ("W02", "views/by-concept.md")}
    (one / "trees").mkdir()
    (one / "views").mkdir()
    (one / "forest.json").write_text("{")
    (one / "index.md").write_text("[[thm-a]] [[gone]] [[gone]]")
    (one / "views" / "dag.md").write_text("[[lost|x]]")
    (one / "views" / "by-concept.md").write_text("")
    (one / "views" / "forest.html").write_text(" \n")
    (one / "registry.yaml").write_text("a: b")
    assert found(one, registry=str(one / "registry.yaml")) == {("C02", str(one / "registry.yaml")), ("V03", "forest.json"), ("T02", "trees"), ("I02", "index.md"), ("W01", "views/forest.html"), ("W03", "views/dag.md")}
    tree_file(one / "trees", "thm-a", teaches=["k"])
    (one / "forest.json").write_text(json.dumps(HEADER))
    (one / "views" / "forest.html").write_text("<p>")
    (one / "index.md").write_text("[[thm-a]]")
    (one / "registry.yaml").write_text("- id: k\n- x\n")
    assert found(one, registry=str(one / "registry.yaml")) == {("W03", "views/dag.md")}
    (one / "registry.yaml").write_text("- [")
    assert ("C01", str(one / "registry.yaml")) in found(one, registry=str(one / "registry.yaml")) and ("V02", "forest.json") not in found(one)
    (one / "forest.json").write_text("[]")
    assert ("V04", "forest.json") in found(one)


def test_sources(spark, tmp_path):
    from tessera.sources import vault

    (tmp_path / "index.md").write_text("# T\n[[lost]]\n## One\n- [[a]] [[b|x]]\n## Two\n- [[c#d]]\n")
    assert [tuple(r) for r in vault.read_sections(spark, str(tmp_path / "index.md")).orderBy("section", "link").collect()] == [(1, "One", 1, "a"), (1, "One", 2, "b"), (2, "Two", 1, "c")]
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "index.json").write_text(json.dumps({"dims": 2, "items": [{"id": "a", "offset": 0, "scale": 0.5}, {"id": "b", "offset": 4, "scale": 0.5}]}))
    (tmp_path / "index" / "vectors.i8.bin").write_bytes(bytes([1, 255, 3]))
    assert {r.id: r.vector for r in vault.read_index(spark, str(tmp_path)).collect()} == {"a": [1, -1], "b": None}
    assert vault.replace_block("x\n", "m", "new") == "x\n\n<!-- m:start -->\nnew\n<!-- m:end -->\n"


def test_streams(spark, tmp_path):
    rows = [("r1", "thinking", 1), ("r1", "thinking", 2), ("r1", "done", 3), ("r1", "writing", 4), ("r2", "writing", 1)]
    frame = spark.createDataFrame([(i, s, datetime(2024, 1, 1, 0, 0, t)) for i, s, t in rows], "id string, state string, at timestamp")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = mailbox.status_stream(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.id, r.state, r.ended) for r in spark.table("changes").collect()) == [("r1", "done", True), ("r1", "thinking", False), ("r2", "writing", False)]
    assert [mailbox.advance(None, 0, "start"), mailbox.advance("active", 3, "answer"), mailbox.advance("active", 1, "pause"), mailbox.advance("paused", 1, "resume")] == [("active", 1), ("done", 3), ("paused", 1), ("active", 1)]
    marks = spark.createDataFrame([(1, "a", "mark", 1), (1, None, "reset", 2), (1, "b", "mark", 3), (1, "c", "mark", 4), (1, "c", "unmark", 5)], "user_id long, id string, action string, at int")
    assert [tuple(r) for r in mailbox.progress_marks(marks).collect()] == [(1, "b")]


def test_watch_claims_and_times_out(spark, tmp_path):
    box, folder = tmp_path / "box", str(tmp_path / "status")

    def put(i, **more):
        (box / i).mkdir(parents=True)
        (box / i / "request.json").write_text(json.dumps({"id": i, "question": "q" * 5000, "trail": ["b", "gone", "a"]} | more))

    put("r1")
    put("r2", trail=[f"a{k}" for k in range(20)] + ["a"])
    spark.createDataFrame([("r2", "claimed", None, None)], mailbox.STATUS).write.parquet(folder)
    seen = []

    def work(rows):
        seen.extend(rows.select("id", F.length("question").alias("n"), "trail").collect())
        return rows.select("id", F.lit("done").alias("state"), F.lit("ok").alias("message"))

    known = spark.createDataFrame([("a",), ("b",)], "id string")
    run = lambda seconds: mailbox.watch(spark, mailbox.read_requests(spark, str(box)), folder, work, str(tmp_path / "cp"), seconds, "1 second", known)
    assert run(60) == 1 and [tuple(r) for r in seen] == [("r1", 4000, ["b", "a"])]
    assert run(3) is None and len(seen) == 1
    put("r3", trail=None)
    assert run(60) == 1 and tuple(seen[-1]) == ("r3", 4000, None)
    assert sorted((r.id, r.state) for r in spark.read.parquet(folder).collect()) == [("r1", "claimed"), ("r1", "done"), ("r2", "claimed"), ("r3", "claimed"), ("r3", "done")]
    events = spark.createDataFrame([("s", "start", 1), ("s", "answer", 2), ("s", "pause", 3), ("s", "answer", 4), ("s", "resume", 5), ("s", "answer", 6), ("s", "answer", 7), ("t", "answer", 1)], "slug string, action string, at int")
    assert {r.slug: (r.status, r.turn) for r in mailbox.session_states(events).collect()} == {"s": ("done", 3), "t": (None, 0)}


def test_whole_files(spark, tmp_path):
    from tessera.sources import vault

    known = spark.createDataFrame([("obj-a",), ("obj-b",)], "id string")
    assert vault.write_layout(spark, str(tmp_path), {"obj-b": [1.5, -0.5], "obj-a": (2, 3)}, known) == 2
    assert json.loads((tmp_path / "structure-layout.json").read_text()) == {"pos": {"obj-a": [2, 3], "obj-b": [2, 0]}}
    for bad in ({}, {"obj-z": [1, 2]}, {"def-a": [1, 2]}, {"obj-a": [1]}, {"obj-a": [1, float("nan")]}, {f"obj-{k}": [0, 0] for k in range(501)}):
        with pytest.raises(ValueError):
            vault.write_layout(spark, str(tmp_path), bad, known)
    (tmp_path / "index").mkdir()
    items = spark.createDataFrame([("b", 2, 0.5), ("a", 0, 0.25)], "id string, offset long, scale double")
    vault.write_index(spark, str(tmp_path / "index"), items, spark.createDataFrame([("a", [1, -1]), ("b", [-128, 127])], "id string, vector array<int>"), 2, "m")
    assert {r.id: r.vector for r in vault.read_index(spark, str(tmp_path)).collect()} == {"a": [1, -1], "b": [-128, 127]}


def test_running_sums_in_large_groups(spark):
    import random

    from tessera.operators.ordering import place, running

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(9)) for k in range(300)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, at int, v int").repartition(5)
    want = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        mine = [r for r in rows if r[0] == g and r[1] < k]
        want[k] = (sum(r[2] for r in mine), len(mine))
    got = place(running(frame, ["g"], ["at"], F.col("v"), "y"), ["g"], ["at"], "n")
    assert {r.at: (r.y, r.n) for r in got.collect()} == want and got.columns == ["g", "at", "v", "y", "n"]
    assert [r.n for r in place(frame, [], ["at"], "n").orderBy("at").collect()] == list(range(300)) and place(frame.limit(0), ["g"], ["at"], "n").count() == 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

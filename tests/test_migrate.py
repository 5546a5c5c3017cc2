"""A corpus of format 0.2 moved to 0.3."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import migrate

TREES = "id string, file string, taxon string, kind string, `from` string, to string, statement string, label string, symbol string, type string, instance_of string, hom string, about array<string>, depends array<string>, needs array<string>, body string, more int"


def test_migrated(spark):
    tree = lambda **k: tuple(k.get(c.split()[0].strip("`")) for c in TREES.split(", "))
    rows = [
        tree(id="obj-k", file="obj-k.md", taxon="object", symbol="K", body="See [[mor-x]] and [[ mor-x#a|that]], [[obj-k]], [[mor-y|y]].", more=1),
        tree(id="obj-t", file="obj-t.md", taxon="object", type="obj-k", symbol="T", about=[], body=None, more=2),
        tree(id="mor-x", file="mor-x.md", taxon="morphism", kind="instance", **{"from": "obj-t"}, to="obj-k", statement="X", label="l", needs=["n"], depends=["mor-y", "thm-a"], body="[[mor-x]]", more=3),
        tree(id="mor-y", file="mor-y.md", taxon="morphism", kind="instance", to="obj-k", statement="Y", more=4), tree(id="obj-y", file="obj-y.md", taxon="object", more=5),
        tree(id="mor-h", file="mor-h.md", taxon="morphism", kind="hom", **{"from": "mor-x"}, to="obj-t", statement="h", label="h", needs=["mor-x"], body="plain", more=6),
        tree(id="thm-a", file="thm-a.md", taxon="theorem", about=["obj-k", "mor-y", "mor-x", "mor-x"], body="", more=7),
    ]
    got = {r.id: r for r in migrate.migrated(spark.createDataFrame(rows, TREES)).collect()}
    assert set(got) == {"obj-k", "obj-t", "obj-x", "obj-y-instance", "obj-y", "mor-h", "thm-a"} and sorted(r.more for r in got.values()) == [1, 2, 3, 4, 5, 6, 7]
    assert got["obj-k"].body == "See [[obj-x]] and [[obj-x#a|that]], [[obj-k]], [[obj-y-instance|y]]."
    x = got["obj-x"]
    assert (x.taxon, x.symbol, x.instance_of, x.file, x.body, x.depends) == ("object", "X", "obj-k", "obj-x.md", "[[obj-x]]", ["obj-y-instance", "thm-a"])
    assert [x[c] for c in ("kind", "from", "to", "statement", "label", "needs", "type")] == [None] * 7
    assert (got["obj-t"].instance_of, got["obj-t"].type, got["obj-t"].about, got["obj-t"].body) == ("obj-k", None, [], None)
    assert (got["mor-h"]["from"], got["mor-h"].to, got["mor-h"].statement, got["mor-h"].body) == ("obj-x", "obj-t", "h", "plain")
    assert got["thm-a"].about == ["obj-k", "obj-y-instance", "obj-x", "obj-x"] and got["thm-a"].depends is None and got["thm-a"].body == ""
    assert migrate.migrated(spark.createDataFrame([], TREES)).count() == 0


def test_chains_of_renames(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(100)] + [("a", "b"), ("c", "b"), ("d", "d"), ("e", None)]
    ends = {r.old: r.new for r in migrate.resolved(spark.createDataFrame(chain, "old string, new string")).collect()}
    assert ends == {f"n{k}": "n100" for k in range(100)} | {"a": "b", "c": "b"}
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "old string, new string")
    with pytest.raises(ValueError, match="circle"):
        migrate.resolved(circle)
    bodies = spark.createDataFrame([("1", "[[a]] [[q]] [a] [[a|a]]"), ("2", None), ("3", "no link")], "id string, body string")
    assert {r.id: r.body for r in migrate.rewritten_links(bodies, spark.createDataFrame([("a", "b")], "old string, new string")).orderBy(F.col("id")).collect()} == {"1": "[[b]] [[q]] [a] [[b|a]]", "2": None, "3": "no link"}

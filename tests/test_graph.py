"""Cycles against a search in depth."""

import random

import pytest

from tessera.operators import graph

EDGES = "src string, dst string"


def searched(ids, pairs):
    """The first back edge of a depth-first search, nodes and successors in code-unit order."""
    after = {}
    for a, b in sorted(set(pairs)):
        if a in ids and b in ids:
            after.setdefault(a, []).append(b)
    done = set()

    def visit(node, path):
        path.append(node)
        for nxt in after.get(node, ()):
            if nxt in path:
                return path[path.index(nxt) :] + [nxt]
            if nxt not in done and (found := visit(nxt, path)):
                return found
        done.add(node)
        path.pop()
        return None

    return next((found for root in sorted(ids) if root not in done and (found := visit(root, []))), None)


@pytest.mark.parametrize("seed", [1, 2, 4, 5, 6])
def test_first_cycle(spark, seed):
    rng = random.Random(seed)
    ids = [f"{rng.choice('aAß-_')}{i}" for i in range(30)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range([6, 20, 26, 30, 34, 60, 34, 30][seed])]
    pairs = pairs if seed % 2 else [(a, b) for a, b in pairs if a != b]
    nodes = spark.createDataFrame([(i,) for i in ids[:-2]], "id string")
    assert graph.first_cycle(nodes, spark.createDataFrame(pairs, EDGES)) == searched(set(ids[:-2]), pairs)


def test_first_cycle_of_long_paths(spark):
    """A path of 300 into a cycle of 200, with dead ends beside it and a smaller cycle that is not reached first."""
    name = lambda k: f"n{k:04d}"
    pairs = [(name(k), name(k + 1)) for k in range(1, 500)] + [(name(500), name(301)), (name(700), name(699)), (name(699), name(700)), (name(0), name(900)), (name(1), name(0))] + [(name(k), name(600 + k)) for k in range(2, 90)]
    nodes = spark.createDataFrame([(name(k),) for k in range(901)], "id string")
    assert graph.first_cycle(nodes, spark.createDataFrame(pairs, EDGES)) == [name(k) for k in range(301, 501)] + [name(301)]

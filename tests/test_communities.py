"""Communities against a plain implementation of the same rounds."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from kbspark.operators import communities as C


def strengths(graph):
    return {u: sum(vs.values()) for u, vs in graph.items()}


def quality(graph, label):
    k = strengths(graph)
    double, total = sum(k.values()), defaultdict(int)
    for u in graph:
        total[label[u]] += k[u]
    inside = sum(w for u, vs in graph.items() for v, w in vs.items() if label[u] == label[v])
    return (double * inside - sum(t * t for t in total.values())) / double**2 if double else 0.0


def wanted(graph, label):
    """(gain, node, from, to) of each node that gains."""
    k = strengths(graph)
    double, total = sum(k.values()), defaultdict(int)
    for u in graph:
        total[label[u]] += k[u]
    for u in graph:
        to = defaultdict(int)
        for v, w in graph[u].items():
            if v != u:
                to[label[v]] += w
        worth = {c: double * w - k[u] * (total[c] - (k[u] if c == label[u] else 0)) for c, w in to.items()}
        stay = worth.pop(label[u], -k[u] * (total[label[u]] - k[u]))
        if worth:
            best = min(worth, key=lambda c: (-worth[c], c))
            if worth[best] > stay:
                yield worth[best] - stay, u, label[u], best


def settled(graph, label):
    turn, k = 0, strengths(graph)
    half = lambda c: zlib.crc32(f"{c}:{turn}".encode()) % 2
    while True:
        moves = sorted(wanted(graph, label), key=lambda m: (-m[0], m[1]))
        if not moves:
            return label, turn > 0
        out, into, taken = defaultdict(int), defaultdict(int), []
        for gain, u, a, b in moves:
            if half(a) == 0 and half(b) == 1:
                if gain > k[u] * (out[a] + into[b]):
                    taken.append((u, b))
                out[a] += k[u]
                into[b] += k[u]
        if not taken:
            first = {}
            for gain, u, a, b in moves:
                first.setdefault(a, u)
                first.setdefault(b, u)
            taken = [(u, b) for _, u, a, b in moves if first[a] == u == first[b]]
        before = quality(graph, label)
        label = label | dict(taken)
        assert quality(graph, label) > before
        turn += 1


def plainly(graph):
    base, found = graph, {u: u for u in graph}
    while True:
        label, moved = settled(graph, {u: u for u in graph})
        if not moved:
            break
        found = {u: label[c] for u, c in found.items()}
        above = defaultdict(lambda: defaultdict(int))
        for u, vs in graph.items():
            for v, w in vs.items():
                above[label[u]][label[v]] += w
        graph = {u: dict(vs) for u, vs in above.items()}
    found, _ = settled(base, found)
    least = defaultdict(lambda: "~")
    for u, c in found.items():
        least[c] = min(least[c], u)
    return {u: least[c] for u, c in found.items()}


def graph_of(edges):
    graph = defaultdict(lambda: defaultdict(int))
    for u, v, w in edges:
        graph[u][v] += w
        graph[v][u] += w
    return {u: dict(vs) for u, vs in graph.items()}


@pytest.mark.parametrize("seed,nodes,edges", [(1, 24, 50), (2, 40, 70)])
def test_as_plain_rounds(spark, seed, nodes, edges):
    r = random.Random(seed)
    rows = [(f"v{r.randrange(nodes)}", f"v{r.randrange(nodes)}", r.randrange(1, 4)) for _ in range(edges)]
    graph = graph_of(rows)
    frame = spark.createDataFrame(rows, "src string, dst string, w long").repartition(3)
    found = C.communities(frame, weight="w")
    got = {x.node: x.label for x in found.collect()}
    assert got == plainly(graph)
    assert C.modularity(frame, found, weight="w") == pytest.approx(quality(graph, got)) and not list(wanted(graph, got))


def test_cliques_nulls_loops_and_nothing(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 1) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 1), ("z", "z", 3), ("y", None, 1), ("x", "w", 0), ("x", "w", None)]
    got = {x.node: x.label for x in C.communities(spark.createDataFrame(rows, "src string, dst string, w long"), weight="w").collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "ab" for i in range(5)} | {"z": "z"}
    none = spark.createDataFrame([], "src string, dst string")
    assert C.communities(none).collect() == [] and C.modularity(none, spark.createDataFrame([], "node string, label string")) == 0.0


def test_leaves_of_hubs_join_at_once(spark, monkeypatch):
    """Rounds do not grow with the leaves: halves by a checksum left half of the pairs together, for one move a hub and round."""
    rounds, gains = [], C.gains
    monkeypatch.setattr(C, "gains", lambda *a: rounds.append(1) or gains(*a))
    rows = [(f"h{h}", f"l{h}x{i}", 9) for h in range(3) for i in range(40)] + [(f"l{h}x{i}", f"l{(h + 1) % 3}x{i}", 1) for h in range(3) for i in range(40)]
    got = {x.node: x.label for x in C.communities(spark.createDataFrame(rows, "src string, dst string, w long"), weight="w").collect()}
    assert got == {u: f"h{u[1]}" for u in got} and len(got) == 123 and len(rounds) < 8


def test_many_moves_end_in_a_local_optimum(spark, monkeypatch):
    """Rounds of many moves, each raising modularity, and the weights beside nodes kept right from round to round."""
    monkeypatch.setattr(C, "FEW", 3)
    r = random.Random(5)
    rows = [(f"v{r.randrange(60)}", f"v{r.randrange(60)}", r.randrange(1, 4)) for _ in range(110)]
    graph, gains = graph_of(rows), C.gains
    seen, nodes_seen = [], []

    def watched(nodes, near, labels, double):
        now = {x.node: x.label for x in labels.collect()}
        if now.keys() == graph.keys():
            want = defaultdict(int)
            for u in graph:
                for v, w in graph[u].items():
                    if u != v:
                        want[u, now[v]] += w
            assert {(x.node, x.to): x.w for x in near.collect()} == want
            seen.append(quality(graph, now))
        nodes_seen.append(len(now))
        return gains(nodes, near, labels, double)

    monkeypatch.setattr(C, "gains", watched)
    got = {x.node: x.label for x in C.communities(spark.createDataFrame(rows, "src string, dst string, w long"), weight="w").collect()}
    first = seen[: next((i for i, n in enumerate(nodes_seen) if n < len(graph)), len(seen))]
    assert len(first) > 2 and all(a < b for a, b in zip(first, first[1:]))
    assert not list(wanted(graph, got)) and quality(graph, got) > 0.9 * quality(graph, plainly(graph))

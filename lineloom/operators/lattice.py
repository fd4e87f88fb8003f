"""Weighted lattices as tables of edges (lattice_id, start, stop, cost, cls): shortest path, beam search, alignment."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.operators.grouping import per_group

#: A model of more n-graphs isn't sent to every task.
MODEL_ROWS = 1_000_000
EDGE = "start long, stop long, cost double, cls string"
_SPACES = re.compile(r"\s+", re.ASCII)
SEGMENT = re.compile(r"^segment\s+(\d+)\s+(\d+):(\d+)\s+(\d+):(\d+):(\d+):(\d+)(?:\s+(\S+)\s+(\S+))?")


def edges_of(lines: Iterable[str | None]) -> list[tuple[int | None, int | None, float | None, str]]:
    """A lattice's edges (start, stop, cost, cls) from its text lines in their order."""
    out, span = [], (None, None)
    for line in lines:
        if line is None:
            continue
        if line.startswith("segment "):
            f = _SPACES.split(line)
            ends = f[2].split(":") if len(f) > 2 else None
            span = span if ends is None else (int(ends[0]), int(ends[1]) + 1 if len(ends) > 1 else None)
        elif line.startswith("chr "):
            f = _SPACES.split(line)
            out.append((*span, float(f[3]) if len(f) > 3 and f[3] != "null" else None, f[4] if len(f) > 4 else ""))
    return out


def lines_of(edges: list[tuple[int, int, float, str]]) -> list[tuple[int, str]]:
    """(pos, line) of a lattice: a segment line for every pair of ends, in their order, and its edges by cost as chr lines."""
    spans: dict[tuple[int, int], list] = {}
    for a, b, c, s in edges:
        spans.setdefault((a, b), []).append((c, s or ""))
    out = []
    for i, (a, b) in enumerate(sorted(spans)):
        out.append((i << 20, f"segment {i} {a}:{b - 1} 0:0:0:0"))
        out += [((i << 20) + j, f"chr {i} {j - 1} {'null' if c is None else repr(c)} {s}") for j, (c, s) in enumerate(sorted(spans[a, b], key=lambda e: (e[0] is not None, e)), 1)]
    return out


def read_lattices(lines: DataFrame) -> DataFrame:
    """Edges from text lines (lattice_id, pos, line) of "segment i first:last ... sp0 sp1" and "chr i j cost cls".

    A chr line belongs to the last segment line before it; the class may be missing ("" is epsilon).
    """
    return per_group(lines, "lattice_id", ["pos", "line"], lambda group: edges_of(line for _, line in sorted(group, key=lambda g: (g[0] is not None, g))), EDGE)


def lattice_lines(edges: DataFrame, bridge: float | None = None) -> DataFrame:
    """(lattice_id, pos, line) of each lattice; bridge as of shortest_paths."""
    return _per_lattice(edges, lambda group: lines_of(group if bridge is None else bridged(group, bridge)), "pos long, line string")


def round_trip(edges: DataFrame, bridge: float | None = None) -> DataFrame:
    """read_lattices of lattice_lines: a lattice's lines are written and read where its edges are, so no line is moved or sorted again."""
    return _per_lattice(edges, lambda group: edges_of(line for _, line in lines_of(group if bridge is None else bridged(group, bridge))), EDGE)


def bridged(edges: list[tuple[int, int, float, str]], cost: float = 10.0) -> list[tuple[int, int, float, str]]:
    """A lattice's edges with an epsilon edge from node to node wherever it has none, so that its end can be reached."""
    have = {(a, b) for a, b, _, _ in edges if a is not None and b is not None}
    if not have:
        return edges
    return edges + [(k, k + 1, cost, "") for k in range(min(a for a, _ in have), max(b for _, b in have)) if (k, k + 1) not in have]


def connected(edges: DataFrame, cost: float = 10.0) -> DataFrame:
    """edges with all lattices bridged; searches do that themselves where they are told the cost."""
    return _per_lattice(edges, lambda group: bridged(group, cost), EDGE)


def _per_lattice(edges: DataFrame, f: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    e = edges.select("lattice_id", F.col("start").cast("long"), F.col("stop").cast("long"), F.col("cost").cast("double"), "cls")
    return per_group(e, "lattice_id", ["start", "stop", "cost", "cls"], f, schema)


def with_space_edges(edges: DataFrame, cost: str = "space_cost") -> DataFrame:
    """Each edge also with a space after its class, where the edge has a cost for that."""
    plain = edges.drop(cost)
    return plain.unionByName(edges.where(F.col(cost).isNotNull()).withColumn("cls", F.concat("cls", F.lit(" "))).withColumn("cost", F.col("cost") + F.col(cost)).drop(cost))


def best_path(edges: list[tuple[int, int, float, str]], start: int, end: int) -> tuple[float, str] | None:
    """(cost, text) of the cheapest path, found from the end; of equal costs the smaller text. None: no way.

    Costs are above 0. Going backwards, the smaller rest is the smaller text whatever comes before it. Where all edges go
    forward, as a lattice's do, nodes are settled in their order; else by Dijkstra.
    """
    best: dict[int, tuple[float, str]] = {end: (0.0, "")}
    for a, b, c, s in sorted(edges, reverse=True):  # a node's own edges come after those of all later nodes
        if b <= a:
            return _dijkstra(edges, start, end)
        rest = best.get(b)
        if rest and a != end:
            way = (round(rest[0] + c, 9), s + rest[1])
            if a not in best or way < best[a]:
                best[a] = way
    return best.get(start)


def _dijkstra(edges: list[tuple[int, int, float, str]], start: int, end: int) -> tuple[float, str] | None:
    into: dict[int, list] = {}
    for a, b, c, s in edges:
        into.setdefault(b, []).append((a, c, s))
    heap, done = [(0.0, "", end)], set()
    while heap:
        cost, text, node = heapq.heappop(heap)
        if node == start:
            return cost, text
        if node in done:
            continue
        done.add(node)
        for a, c, s in into.get(node, ()):
            if a not in done:
                heapq.heappush(heap, (round(cost + c, 9), s + text, a))
    return None


def shortest_paths(edges: DataFrame, reject: str | None = None, bridge: float | None = None) -> DataFrame:
    """(lattice_id, cost, text) from the least start to the greatest stop of each lattice; reject names a class to leave out.

    bridge: the cost of epsilon edges where none goes from a node to the next. Lattices whose end can't be reached are missing.
    """

    def solve(group: list[tuple]) -> list[tuple]:
        own = [(a, b, c, s or "") for a, b, c, s in (group if bridge is None else bridged(group, bridge)) if not reject or s != reject]
        found = best_path(own, min(e[0] for e in own), max(e[1] for e in own)) if own else None
        return [found] if found else []

    return _per_lattice(edges, solve, "cost double, text string")


def beam(edges: list[tuple[int, int, float, str]], model: dict[str, dict[str, float]], order: int, width: int, missing: float, weight: float, rewrites: dict[str, list[tuple[str, float]]] | None = None) -> tuple[float, str] | None:
    """Cheapest path by edge cost plus weighted n-graph cost; at each node the `width` best of different suffix stay."""
    rewrites = rewrites or {}
    start, end = min(e[0] for e in edges), max(e[1] for e in edges)
    by: dict[int, list] = {}
    for a, b, c, s in edges:
        by.setdefault(a, []).extend((b, c + extra, t) for t, extra in [(s, 0.0), *rewrites.get(s, [])])
    at: dict[int, list[tuple[float, str]]] = {start: [(0.0, "_" * (order - 1))]}
    for node in sorted({e[0] for e in edges} | {end}):
        best: dict[str, tuple[float, str]] = {}
        for cost, text in sorted(at.get(node, [])):
            best.setdefault(text[1 - order :] if order > 1 else "", (cost, text))
        kept = sorted(best.values())[:width]
        at[node] = kept
        for b, c, s in by.get(node, ()):
            for cost, text in kept:
                total = cost + c
                for ch in s:
                    total += weight * model.get(text[1 - order :] if order > 1 else "", {}).get(ch, missing)
                    text += ch
                at.setdefault(b, []).append((total, text))
    return (at[end][0][0], at[end][0][1][order - 1 :]) if at.get(end) else None


def beam_search(edges: DataFrame, model: DataFrame, order: int = 3, width: int = 100, missing: float = 15.0, weight: float = 1.0, rewrites: DataFrame | None = None, bridge: float | None = None) -> DataFrame:
    """(lattice_id, cost, text) with an n-graph model (prefix, ch, neglogp); bridge as of shortest_paths.

    A model of MODEL_ROWS n-graphs at most is sent to the tasks. Of a larger one each lattice gets the n-graphs that end in
    one of its characters, joined by character.
    """
    rows = model.select("prefix", "ch", "neglogp").limit(MODEL_ROWS + 1).toArrow()  # the model is made once
    if rows.num_rows > MODEL_ROWS:
        return _beam_search_joined(edges if bridge is None else connected(edges, bridge), model, order, width, missing, weight, rewrites)
    table: dict[str, dict[str, float]] = {}
    for prefix, ch, cost in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
        table.setdefault(prefix, {})[ch] = cost
    changes: dict[str, list] = {}
    for r in rewrites.collect() if rewrites is not None else ():
        changes.setdefault(r["src"], []).append((r["dst"], r["cost"]))
    sent = edges.sparkSession.sparkContext.broadcast((table, changes))

    def solve(group: list[tuple]) -> list[tuple]:
        t, c = sent.value
        found = beam(group if bridge is None else bridged(group, bridge), t, order, width, missing, weight, c)
        return [found] if found else []

    return _per_lattice(edges, solve, "cost double, text string")


def _beam_search_joined(edges: DataFrame, model: DataFrame, order: int, width: int, missing: float, weight: float, rewrites: DataFrame | None) -> DataFrame:
    """beam_search with a model too large to send: only n-graphs all of whose characters a lattice has can be asked for."""
    changes: dict[str, list] = {}
    for r in rewrites.collect() if rewrites is not None else ():
        changes.setdefault(r["src"], []).append((r["dst"], r["cost"]))
    own = edges.select("lattice_id", "cls").distinct()
    if changes:
        more = edges.sparkSession.createDataFrame([(k, t) for k, v in changes.items() for t, _ in v], "cls string, to string")
        own = own.union(own.join(F.broadcast(more), "cls").select("lattice_id", "to"))
    chars = own.select("lattice_id", F.explode(F.split("cls", "")).alias("ch")).where("ch <> ''").distinct()
    have = chars.groupBy("lattice_id").agg(F.collect_set("ch").alias("has"))
    asked = chars.join(model.select("prefix", "ch", "neglogp"), "ch").join(have, "lattice_id")
    asked = asked.where(F.forall(F.split("prefix", ""), lambda c: (c == "_") | (c == "") | F.array_contains("has", c))).select((F.col("lattice_id") + 0).alias("id"), "prefix", "ch", "neglogp")

    def solve(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        table: dict[str, dict[str, float]] = {}
        for prefix, ch, cost in zip(m["prefix"], m["ch"], m["neglogp"], strict=True):
            table.setdefault(prefix, {})[ch] = cost
        found = beam(list(zip(g["start"], g["stop"], g["cost"], g["cls"], strict=True)), table, order, width, missing, weight, changes) if len(g) else None
        return pd.DataFrame([(int(g["lattice_id"].iloc[0]), *found)] if found else [], columns=["lattice_id", "cost", "text"])

    return edges.select("lattice_id", "start", "stop", "cost", "cls").groupBy("lattice_id").cogroup(asked.groupBy("id")).applyInPandas(solve, "lattice_id long, cost double, text string")


def align_to_truth(edges: list[tuple[int, int, float, str]], truth: str, skip: float = 5.0) -> list[tuple[int, int, str]] | None:
    """(start, stop, cls) of the cheapest path whose text is the truth; a character may be skipped, or an edge used for none, at cost `skip`."""
    start, end = min(e[0] for e in edges), max(e[1] for e in edges)
    by: dict[int, list] = {}
    for a, b, c, s in edges:
        by.setdefault(a, []).append((b, c, s))
    heap: list[tuple[float, int, int, tuple]] = [(0.0, start, 0, ())]
    done = set()
    while heap:
        cost, node, k, path = heapq.heappop(heap)
        if node == end and k == len(truth):
            return list(path)
        if (node, k) in done:
            continue
        done.add((node, k))
        if k < len(truth):
            heapq.heappush(heap, (cost + skip, node, k + 1, path))
        for b, c, s in by.get(node, ()):
            if s and truth.startswith(s, k):
                heapq.heappush(heap, (cost + c, b, k + len(s), (*path, (node, b, s))))
            heapq.heappush(heap, (cost + c + skip, b, k, path))
    return None

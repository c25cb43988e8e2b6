"""Leaf-wise growth of trees in few Spark jobs.

A node's best split does not depend on the order in which leaves are grown, only the choice does. The driver keeps the
heap of leaves (largest gain first, then first come) and replays it; whenever a chosen leaf's children are unknown, one job
gets the histograms of the children of all leaves in the heap, of all trees of the round (classes) at once.
"""

from __future__ import annotations

import heapq
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators.split import Rules, Split, best_binned, best_exact, blocks, leaf_value
from sylvan.sources.ingest import cut


@dataclass
class Node:
    node_id: int
    depth: int
    value: float
    n_samples: int
    gain: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    shrinkage: float = 1.0

    def to_dict(self) -> dict:
        return {"shrinkage": self.shrinkage, "nodes": [asdict(n) for n in self.nodes]}

    @classmethod
    def from_dict(cls, d: dict) -> Tree:
        return cls([Node(**n) for n in d["nodes"]], d["shrinkage"])

    @property
    def n_leaves(self) -> int:
        return sum(n.is_leaf for n in self.nodes)

    @property
    def max_depth(self) -> int:
        return max((n.depth for n in self.nodes), default=0)

    def feature_importances(self, n_features: int) -> np.ndarray:
        """Gain by feature, as shares of their sum."""
        out = np.zeros(n_features)
        for n in self.nodes:
            if not n.is_leaf:
                out[n.feature] += n.gain
        return out / out.sum() if out.sum() > 0 else out

    def sql(self, leaf=lambda n: f"{n.value!r}D") -> str:
        """A CASE expression over column x, NaN to the left; as text, since nested column calls are slow to build."""

        def at(i: int) -> str:
            n = self.nodes[i]
            if n.is_leaf:
                return leaf(n)
            v = f"x[{n.feature}]"
            return f"IF(isnan({v}) OR {v} <= {n.threshold!r}D, {at(n.left)}, {at(n.right)})"

        return at(0)


@dataclass
class Growth:
    """A tree on its way: every node known so far by its path, and best splits by path."""

    splits: dict[str, Split | None]
    total: tuple[float, float, int] = (0.0, 0.0, 0)
    wanted: set[str] = field(default_factory=set)

    def route(self) -> str:
        """SQL for the path of a row as far as splits are known."""

        def at(path: str) -> str:
            s = self.splits.get(path)
            if s is None:
                return f"'{path}'"
            v = f"x[{s.feature}]"
            return f"IF(isnan({v}) OR {v} <= {s.threshold!r}D, {at(path + 'L')}, {at(path + 'R')})"

        return at("")

    def places(self, edges: list[list[float]]) -> tuple[list[tuple[int, int, int, int, int]], list[str]]:
        """The known splits as places for routed_codes(), and the path of each slot: the wanted ones."""
        out, slots, todo = [(-1, 0, 0, 0, -1)], [], [(0, "")]
        for i, path in todo:
            s = self.splits.get(path)
            if path in self.wanted:
                out[i] = (-1, 0, 0, 0, len(slots))
                slots.append(path)
            elif s is not None:
                out[i] = (s.feature, int(np.searchsorted(edges[s.feature], s.threshold)), len(out), len(out) + 1, -1)
                todo += [(len(out), path + "L"), (len(out) + 1, path + "R")]
                out += [(-1, 0, 0, 0, -1)] * 2
        return out, slots


def replay(g: Growth, rules: Rules, num_leaves: int, max_depth: int, min_gain: float) -> tuple[Tree, set[str]]:
    """The tree as far as it is known, and the paths whose best splits are needed to go on (empty: it is complete)."""
    tree = Tree([Node(0, 0, leaf_value(*g.total[:2], rules), g.total[2])])
    paths, heap, count, leaves = [""], [], 0, 1

    def may(path: str, rows: int) -> bool:
        return rows >= 2 * rules.min_data and (max_depth < 0 or len(path) < max_depth)

    def push(i: int) -> bool:
        """False if the node's split is unknown."""
        nonlocal count
        path, n = paths[i], tree.nodes[i]
        if path and not may(path, n.n_samples) or max_depth == 0:
            return True
        if path not in g.splits:
            return False
        s = g.splits[path]
        if s and s.gain > min_gain:
            heapq.heappush(heap, (-s.gain, count, i))
            count += 1
        return True

    if not push(0):
        return tree, {""}
    while heap and leaves < num_leaves:
        _, _, i = heapq.heappop(heap)
        s, n = g.splits[paths[i]], tree.nodes[i]
        n.gain, n.feature, n.threshold = s.gain, s.feature, s.threshold
        children = []
        for side, part in (("L", s.left), ("R", s.right)):
            tree.nodes.append(Node(len(tree.nodes), n.depth + 1, leaf_value(*part[:2], rules), part[2]))
            paths.append(paths[i] + side)
            children.append(len(tree.nodes) - 1)
        n.left, n.right = children
        leaves += 1
        if leaves < num_leaves and not all([push(c) for c in children]):
            need = {paths[c] for c in children if may(paths[c], tree.nodes[c].n_samples) and paths[c] not in g.splits}
            for _, _, k in heapq.nsmallest(max(0, num_leaves - leaves), heap):
                s = g.splits[paths[k]]
                need |= {p for side, part in (("L", s.left), ("R", s.right)) if may(p := paths[k] + side, part[2]) and p not in g.splits}
            return tree, need
    return tree, set()


def grow(df: DataFrame, n_trees: int, n_features: int, rules: Rules, *, edges: list[list[float]] | None, features: list[int] | None = None, num_leaves: int = 31, max_depth: int = -1, min_gain: float = 0.0, sums: tuple | None = None) -> list[Tree]:
    """n_trees trees on rows with columns x, g array<double>, h array<double> (an entry per tree) and, with edges, codes.

    With edges splits are sought over bins, without over all distinct values. With edges df may also be blocks(), and sums
    (rows, then G and H of each tree) are taken from the caller if given.
    """
    features = list(range(n_features)) if features is None else features
    if sums is None:
        sums = df.agg(F.count("*"), *(F.sum(F.get(c, F.lit(k))) for k in range(n_trees) for c in ("g", "h"))).first()
    if edges is not None and "v" not in df.columns:
        df = cut(blocks(df.withColumn("v", F.lit(0.0)), len(edges), n_trees), "blocks")
    growth = [Growth({}, (sums[1 + 2 * k] or 0.0, sums[2 + 2 * k] or 0.0, sums[0])) for k in range(n_trees)]
    trees: list[Tree | None] = [None] * n_trees
    while True:
        for k, g in enumerate(growth):
            if trees[k] is None:
                tree, g.wanted = replay(g, rules, num_leaves, max_depth, min_gain)
                if not g.wanted:
                    trees[k] = tree
        open_ = [k for k in range(n_trees) if trees[k] is None]
        if not open_:
            return trees
        if edges is not None:
            routes = {k: growth[k].places(edges) for k in open_}
            got = best_binned(df, {k: v[0] for k, v in routes.items()}, edges, features, rules).collect()  # a row per node
            for k in open_:
                growth[k].splits.update({p: None for p in growth[k].wanted})
                growth[k].wanted = set()
            for b in got:
                growth[b["tree"]].splits[routes[b["tree"]][1][b["slot"]]] = Split(b["gain"], b["feature"], float(edges[b["feature"]][b["cut"]]), (b["GL"], b["HL"], b["nl"]), (b["G"] - b["GL"], b["H"] - b["HL"], b["n"] - b["nl"]))
            continue
        cells = [F.struct(F.lit(k).alias("tree"), F.expr(growth[k].route()).alias("path"), F.get("g", F.lit(k)).alias("g"), F.get("h", F.lit(k)).alias("h")) for k in open_]
        wanted = [f"(tree = {k} AND path IN ({', '.join(repr(p) for p in sorted(growth[k].wanted))}))" for k in open_]
        rows = df.select("x", F.explode(F.array(*cells)).alias("c")).select("x", "c.*").where(" OR ".join(wanted))
        for k in open_:
            growth[k].splits.update({p: None for p in growth[k].wanted})
        for b in best_exact(rows, ["tree", "path"], features, rules).collect():  # a row per node
            growth[b["tree"]].splits[b["path"]] = Split(b["gain"], b["feature"], b["threshold"], (b["GL"], b["HL"], b["nl"]), (b["G"] - b["GL"], b["H"] - b["HL"], b["n"] - b["nl"]))
        for g in growth:
            g.wanted = set()

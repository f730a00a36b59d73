"""Pose-graph operators: edges both ways, components, spanning forests, path lengths, pose propagation, visual index."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessara.functions import vectors as V
from tessara.operators import aggs, topk
from tessara.operators.sizes import stored


def both_ways(edges: DataFrame, transform: str | None = None) -> DataFrame:
    """Each edge and its reverse, with the inverse transform."""
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    if transform:
        back = back.withColumn(transform, V.inverse_pose(F.col(transform)))
    return edges.unionByName(back)


def local_edges(candidates: DataFrame, path_lengths: DataFrame) -> DataFrame:
    """Edges of accepted candidates (ref, cur, transform, cost) both ways; the cost is multiplied by the path length of ref."""
    weighed = candidates.join(path_lengths.withColumnRenamed("node", "ref"), "ref")
    return both_ways(weighed.select(F.col("ref").alias("src"), F.col("cur").alias("dst"), "transform", (F.col("path_len") * F.col("cost")).alias("cost")), "transform")


def global_edges(pairs: DataFrame) -> DataFrame:
    """Edges between clusters: node, other, ref_pose, edge (ref to cur), cur_pose, path lengths node_len, ref_len, cur_len,
    cost. The transform is ref_pose * edge * cur_pose^-1, and the cost is times the sum of the path lengths + 1."""
    t = V.compose(V.compose(F.col("ref_pose"), F.col("edge")), V.inverse_pose(F.col("cur_pose")))
    weight = F.col("node_len") + F.col("ref_len") + F.col("cur_len") + 1
    return both_ways(pairs.select(F.col("node").alias("src"), F.col("other").alias("dst"), t.alias("transform"), (weight * F.col("cost")).alias("cost")), "transform")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, root: the smallest node that each can reach. edges: src, dst; nodes: node, for those without edges.

    Each round hands larger neighbours to the smallest neighbour and then smaller ones, until all edges are stars. A
    round is a written table; the number of rounds grows with the logarithm of the size."""
    now = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = stored(small.select(F.explode(pairs).alias("e")).select("e.*").where("u != v").distinct())
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
    label = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    if nodes is None:
        ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
        nodes = ends.distinct()
    return nodes.select("node").distinct().join(label, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def largest(labelled: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties: the smallest root."""
    sizes = labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
    return labelled.join(F.broadcast(main), "root", "left_semi")  # one row


def path_lengths(edges: DataFrame, labelled: DataFrame, directed: bool = False) -> DataFrame:
    """node, root, path_len: steps from the root, breadth first; a round of joins per step. directed: edges src (parent) to
    dst (child) only."""
    steps = edges.select("src", "dst") if directed else edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = front = stored(labelled.where("node = root").withColumn("path_len", F.lit(0)))
    while True:
        reached = front.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "root", (F.col("path_len") + 1).alias("path_len")).distinct()
        front = stored(reached.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def propagate_poses(forest: DataFrame, edges: DataFrame) -> DataFrame:
    """node, pose: the root's is the identity, a child's its parent's times the edge's. forest: node, parent (null at
    roots); edges: src (parent), dst (child), transform. A join per level."""
    children = forest.where("parent IS NOT NULL").join(edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "transform"), ["parent", "node"])
    front = stored(forest.where("parent IS NULL").select("node", V.identity_pose().alias("pose")))
    out = front
    while True:
        up = front.select(F.col("node").alias("parent"), F.col("pose").alias("up"))
        front = stored(children.join(up, "parent").select("node", V.compose(F.col("up"), F.col("transform")).alias("pose")))
        if front.isEmpty():
            return out
        out = out.unionByName(front)


def frame_poses(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """frames (frame_index, node, pose) with the world pose: the node's times the frame's."""
    return frames.join(nodes.select("node", F.col("pose").alias("node_pose")), "node").withColumn("world", V.compose(F.col("node_pose"), F.col("pose"))).drop("node_pose")


def covisible_top(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k neighbours of each node with most neighbours themselves; ties to the smaller id. edges: both ways."""
    degrees = edges.groupBy(F.col("src").alias("dst")).agg(F.countDistinct("dst").alias("degree"))
    return topk.top_k(edges.select("src", "dst").distinct().join(degrees, "dst"), ["src"], [F.desc("degree"), F.col("dst")], k)


def densify(reprojected: DataFrame, most: float, least: int = 100) -> DataFrame:
    """Frame pairs with over `least` matches whose reprojection error is below `most`."""
    return reprojected.where(F.col("error") < most).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def visible(nodes: DataFrame, main: Column, frame_visible: Column) -> DataFrame:
    return nodes.where((F.col("root") == main) & frame_visible)


class Forest:
    """A spanning forest that nodes join one after the other; one sequence of nodes is one fold.

    A new node comes with edges to nodes of one or more trees. Each edge closes a way: over the edge itself, or over what
    leads from its end to that end's parent. Of a tree, one edge stays with both its ways, the one whose dearer way is
    cheapest (the last of equals); of every other edge the dearer way is cut, the edge itself if both cost the same. So
    what is left costs least. The new node joins the tree of the largest root's if it touches it, else that of the
    smallest root among those touched; other trees are turned round to hang under it.

    Trees only ever grow together, so their names are a union-find. A new node costs the walk from its link to the ends
    that may move, and the nodes that come to hang below it; no node costs a pass over its sequence."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.main = 0
        self._toll: list[float] = []
        self._below: list[set[int] | None] = []
        self._name: list[int] = []
        self._size: dict[int, int] = {}

    @property
    def root(self) -> list[int]:
        return [self.tree(i) for i in range(len(self.parent))]

    def tree(self, node: int) -> int:
        """The root of the node's tree."""
        name = self._name
        while name[node] != node:
            name[node] = node = name[name[node]]
        return node

    def path(self, node: int) -> list[int]:
        out = []
        while node != -1:
            out.append(node)
            node = self.parent[node]
        return out

    def add(self, edges: Iterable[tuple[int, float]]) -> int:
        """The place of the new node. edges: earlier nodes and costs; of edges to one node the cheapest counts."""
        new = len(self.parent)
        self.parent.append(-1)
        self.depth.append(0)
        self._toll.append(0.0)
        self._below.append(None)
        self._name.append(new)
        self._size[new] = 1
        touched: dict[int, dict[int, float]] = defaultdict(dict)
        for node, cost in sorted(edges):
            touched[self.tree(node)].setdefault(node, cost)
        if touched:
            target = self.main if self.main in touched else min(touched)
            for root, ends in touched.items():
                self._join(new, root, ends, target)
            self._size[target] += 1 + sum(self._size.pop(r) for r in touched if r != target)
            del self._size[new]
            for r in (new, *touched):
                self._name[r] = target
            self._deepen(new)
            new_main = target
        else:
            new_main = new
        if (self._size[new_main], -new_main) > (self._size.get(self.main, 0), -self.main):
            self.main = new_main
        return new

    def _hang(self, node: int, under: int, toll: float) -> None:
        up = self.parent[node]
        if up != -1:
            self._below[up].discard(node)
        self.parent[node], self._toll[node] = under, toll
        if self._below[under] is None:
            self._below[under] = set()
        self._below[under].add(node)

    def _join(self, new: int, root: int, ends: dict[int, float], target: int) -> None:
        def other_way(node: int) -> float:
            if self.parent[node] != -1:
                return self._toll[node]
            return 0.0 if node == target else float("inf")

        ways = {node: other_way(node) for node in ends}
        link = min(reversed(ends), key=lambda node: max(ends[node], ways[node]))
        moving = [node for node in ends if node != link and ways[node] > ends[node]]
        if root != target:
            chain = self.path(link)
            tolls = [self._toll[node] for node in chain]
            moving = set(moving).difference(chain)
            self._hang(link, new, ends[link])
            for lower, upper, toll in zip(chain, chain[1:], tolls):
                self._hang(upper, lower, toll)
        else:
            if moving:
                moving, least, at = set(moving), min(self.depth[node] for node in moving), link
                while at != -1 and self.depth[at] >= least:
                    moving.discard(at)
                    at = self.parent[at]
            self._hang(new, link, ends[link])
        for node in moving:
            self._hang(node, new, ends[node])

    def _deepen(self, top: int) -> None:
        todo = [top]
        while todo:
            node = todo.pop()
            up = self.parent[node]
            self.depth[node] = 0 if up == -1 else self.depth[up] + 1
            todo += self._below[node] or ()

    def reroot(self) -> int:
        """Makes the node with the least sum of distances in the largest tree its root; ties to the smaller node.

        One pass up adds sizes and distances from the root; one pass down follows how the sum changes from parent to
        child: a child is nearer by one to its own subtree and farther by one from all others."""
        start = self.main
        order = [start]
        for node in order:
            order += sorted(self._below[node] or ())
        size = dict.fromkeys(order, 1)
        for node in reversed(order[1:]):
            size[self.parent[node]] += size[node]
        far = {start: sum(self.depth[node] for node in order)}
        for node in order[1:]:
            far[node] = far[self.parent[node]] + len(order) - 2 * size[node]
        best = min(order, key=lambda i: (far[i], i))
        chain = self.path(best)
        tolls = [self._toll[node] for node in chain]
        if len(chain) > 1:
            self._below[chain[1]].discard(best)
        self.parent[best] = -1
        for lower, upper, toll in zip(chain, chain[1:], tolls):
            self._hang(upper, lower, toll)
        self._name[best] = self._name[start] = best
        self._size[best] = self._size.pop(start)
        self._deepen(best)
        self.main = best
        return best


def spanning_forest(edges: DataFrame, sequence: list[str], nodes: DataFrame, reroot: bool = False) -> DataFrame:
    """sequence..., node_index, parent (null at roots), root, path_len, main. nodes: sequence..., node_index (0 ..);
    edges: sequence..., src, dst (earlier), cost.

    Order matters, so a sequence is one fold; sequences are parallel. Nodes and edges move once, by sequence, and each
    task walks its sorted rows and holds the forest of one sequence at a time, however many sequences it has."""
    at = nodes.select(*sequence, F.col("node_index").cast("long").alias("__at"), F.lit(None).cast("long").alias("__to"), F.lit(None).cast("double").alias("__cost"))
    es = edges.select(*sequence, F.col("src").cast("long").alias("__at"), F.col("dst").cast("long").alias("__to"), F.col("cost").cast("double").alias("__cost"))
    order = [F.col(c) for c in (*sequence, "__at")] + [F.asc_nulls_first("__to"), F.col("__cost")]
    rows = at.unionByName(es).repartition(*sequence).sortWithinPartitions(*order)

    def table(done: list[tuple[list, Forest]]) -> pa.RecordBatch:
        cols: dict[str, list] = {c: [] for c in (*sequence, "node_index", "parent", "root", "path_len", "main")}
        for key, forest in done:
            n, roots = len(forest.parent), forest.root
            for c, v in zip(sequence, key):
                cols[c] += [v] * n
            cols["node_index"] += range(n)
            cols["parent"] += [None if p == -1 else p for p in forest.parent]
            cols["root"] += roots
            cols["path_len"] += forest.depth
            cols["main"] += [r == forest.main for r in roots]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], list(cols))

    own = "".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}, " for c in sequence)
    schema = f"{own}node_index long, parent long, root long, path_len int, main boolean"
    types = [to_arrow_type(nodes.schema[c].dataType) for c in sequence] + [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values, forest, here, ends = None, None, Forest(), None, []

        def finish() -> Forest:
            if here is not None:
                forest.add(ends)
            if reroot and forest.parent:
                forest.reroot()
            return forest

        for batch in batches:
            done, columns = [], [c.to_pylist() for c in batch.columns]
            for *k, node, to, cost in zip(*columns):
                named = tuple("NaN" if x != x else x for x in k)
                if named != key:
                    if key is not None:
                        done.append((values, finish()))
                    key, values, forest, here, ends = named, k, Forest(), None, []
                if to is None:
                    if here is not None:
                        forest.add(ends)
                    here, ends = node, []
                elif node == here:
                    ends.append((to, cost))
            if done:
                yield table(done)
        if key is not None:
            yield table([(values, finish())])

    return rows.mapInArrow(run, schema)


def minimum_forest(edges: DataFrame) -> DataFrame:
    """Edges src < dst, cost of a spanning forest of least total cost, whatever the order (ties by src, dst): in each round
    every component takes its cheapest edge out."""
    label = stored(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().withColumn("root", F.col("node")))
    rest = stored(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cost").where("src != dst"))
    chosen: DataFrame | None = None
    while True:
        s, d = label.select(F.col("node").alias("src"), F.col("root").alias("a")), label.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        rest = stored(rest.join(s, "src").join(d, "dst").where("a != b").select("src", "dst", "cost", "a", "b"))
        if rest.isEmpty():
            return chosen if chosen is not None else edges.select("src", "dst", "cost").limit(0)
        ends = rest.withColumn("c", F.explode(F.array("a", "b")))
        now = stored(ends.groupBy("c").agg(F.min(F.struct("cost", "src", "dst", "a", "b")).alias("e")).select("e.*").distinct())
        chosen = now.select("src", "dst", "cost") if chosen is None else chosen.unionByName(now.select("src", "dst", "cost"))
        joined = components(now.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("root"), F.col("root").alias("to"))
        label = stored(label.join(joined, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        rest = rest.select("src", "dst", "cost")


def correspondence_sets(links: DataFrame) -> DataFrame:
    """Sets of observations linked directly or through others: components of links."""
    return components(links)


def consistent_groups(candidates: DataFrame, groups: DataFrame, least: int = 7) -> DataFrame:
    """Candidates whose covisible group overlaps the groups of `least` steps before without a gap. candidates: step,
    candidate; groups: step, candidate, member.

    A candidate's count is one more than the largest count of a candidate of the step before that shares a member."""
    g = stored(groups.select("step", "candidate", "member"))
    now = stored(candidates.select("step", "candidate").withColumn("n", F.lit(0)))
    for _ in range(least):
        before = now.join(g, ["step", "candidate"]).select((F.col("step") + 1).alias("step"), "member", F.col("n").alias("m"))
        best = g.join(before, ["step", "member"]).groupBy("step", "candidate").agg((F.max("m") + 1).alias("m"))
        now = stored(now.join(best, ["step", "candidate"], "left").select("step", "candidate", F.coalesce("m", F.lit(0)).alias("n")))
    return now.where(F.col("n") >= least)


# the visual index: image, cx, cy, cz (null while lost)


def index_add(index: DataFrame, images: DataFrame, size: float = 2.0) -> DataFrame:
    """index with images (image, position array of 3 or null): located ones in their cell, others lost."""
    at = [F.floor(F.col("position")[i] / size).cast("long").alias(c) for i, c in enumerate(("cx", "cy", "cz"))]
    return index.unionByName(images.select("image", *at))


def index_remove(index: DataFrame, images: DataFrame) -> DataFrame:
    return index.join(images, "image", "left_anti")


def index_locate(index: DataFrame, poses: DataFrame, size: float = 2.0) -> DataFrame:
    """Lost images that now have a position go to its cell; others stay."""
    lost = poses.join(index.where("cx IS NULL").select("image"), "image", "left_semi")
    return index_add(index_remove(index, lost.select("image")), lost, size)


def lost_images(index: DataFrame) -> DataFrame:
    return index.where("cx IS NULL").select("image")


def select_neighbours(votes: DataFrame, query: list[str], last: Column, k: int) -> DataFrame:
    """Nodes to match a new cluster with: the last one, then by votes."""
    return topk.votes_top_k(votes, query, last, k)


def tree_sizes(labelled: DataFrame) -> DataFrame:
    """root, n, the largest first; ties to the smaller root."""
    return labelled.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root")


lost_count = aggs.lost_count

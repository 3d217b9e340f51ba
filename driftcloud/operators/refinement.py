"""Refinement of dynamic points: clusters per sweep, noise removal, growth to the clusters' hulls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import DYNAMIC, UNDETERMINED, Params
from ..session import discard, saved, unsent
from .images import PLACE, POINT

SWEEP = ["scene_id", "sweep_idx"]
#: Metres by which a point may be outside a plane of a hull and still be on it.
HULL_TOLERANCE = 1e-9
#: Links up to which Spark may broadcast what they say about nodes.
MANY = 100_000
#: Comparisons that two boxes of points may take before they are cut.
FEW = 4096
#: Directions of the outer polytope: axes, face and space diagonals.
DIRECTIONS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]


def _near(a: str, b: str, eps: float | Column) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= eps * eps


def _bounds() -> list[Column]:
    return [f(c).alias(f"{e}{c}") for c in "xyz" for f, e in ((F.min, "lo"), (F.max, "hi"))]


def _gap(a: str, b: str) -> Column:
    """Square of the least distance that points of two boxes can have."""
    d = [F.greatest(F.lit(0.0), F.col(f"{a}lo{c}") - F.col(f"{b}hi{c}"), F.col(f"{b}lo{c}") - F.col(f"{a}hi{c}")) for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _span(a: str, b: str) -> Column:
    """Square of the greatest one."""
    d = [F.greatest(F.col(f"{a}hi{c}") - F.col(f"{b}lo{c}"), F.col(f"{b}hi{c}") - F.col(f"{a}lo{c}")) for c in "xyz"]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _renamed(df: DataFrame, prefix: str, to: dict[str, str]) -> DataFrame:
    """Columns but the sweep's with a prefix, those in ``to`` with names of their own."""
    return df.select(*SWEEP, *[F.col(c).alias(to.get(c, f"{prefix}{c}")) for c in df.columns if c not in SWEEP])


def _named(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes in different components, with these (a_in, b_in)."""
    for n in "ab":
        pairs = pairs.join(unsent(components.select(*SWEEP, F.col("node").alias(n), F.col("component").alias(f"{n}_in"))), [*SWEEP, n])
    return pairs.where("a_in <> b_in")


def _join_cells(points: DataFrame, pairs: DataFrame, components: DataFrame, eps: float | Column, size: float | Column) -> DataFrame:
    """``components`` (node, component) after those of dense cells in ``pairs`` (a, b) that hold points within ``eps`` became one.

    Cells are cut into ever smaller boxes.  Boxes that are near as a whole link their cells, boxes too far apart are dropped, and of
    the others those with few points are compared point by point and the rest is cut further, while their components differ.
    """
    box = ["sx", "sy", "sz"]
    for n in "ab":
        pairs = pairs.withColumns({f"{n}_{c}": F.lit(0).cast("long") for c in box})
    asked = pairs.select(*SWEEP, F.explode(F.array("a", "b")).alias("node")).distinct()
    own = saved(points.join(asked, [*SWEEP, "node"], "left_semi").select(*SWEEP, "node", "x", "y", "z", *[F.lit(0).cast("long").alias(c) for c in box]))
    while True:
        size = size / 4
        inner = _in_cells(own.select(*SWEEP, "node", *[F.col(c).alias(f"of_{c}") for c in box], "x", "y", "z"), size, "s")
        boxes = saved(inner.groupBy(*SWEEP, "node", *[f"of_{c}" for c in box], *box).agg(F.count("*").alias("n"), *_bounds()))
        for n in "ab":
            within = _renamed(boxes, f"{n}__", {"node": n, **{f"of_{c}": f"{n}_{c}" for c in box}})
            pairs = pairs.join(within, [*SWEEP, n, *[f"{n}_{c}" for c in box]])
        level = pairs.where(_gap("a__", "b__") <= eps * eps).select(
            *SWEEP, "a", "b", *[F.col(f"{n}__{c}").alias(f"{n}_{c}") for n in "ab" for c in box],
            (_span("a__", "b__") <= eps * eps).alias("sure"), (F.col("a__n") * F.col("b__n") <= FEW).alias("few"),
        )
        level = saved(level)
        found, few = level.where("sure").select(*SWEEP, "a", "b"), level.where("few and not sure").drop("few", "sure")
        for n in "ab":
            few = few.join(unsent(_renamed(inner.drop(*[f"of_{c}" for c in box]), n, {"node": n, **{c: f"{n}_{c}" for c in box}})), [*SWEEP, n, *[f"{n}_{c}" for c in box]])
        found = found.unionByName(few.where(_near("a", "b", eps)).select(*SWEEP, "a", "b")).distinct()
        links = saved(_named(found, components).select(*SWEEP, F.col("a_in").alias("a"), F.col("b_in").alias("b")).distinct())
        components = _merged(components, links)
        pairs = saved(_named(level.where("not few and not sure"), components).select(*SWEEP, "a", "b", *[f"{n}_{c}" for n in "ab" for c in box]))
        if pairs.isEmpty():
            return components
        own = inner.drop(*[f"of_{c}" for c in box])


def cluster_density(points: DataFrame, p: Params) -> DataFrame:
    """DBSCAN per sweep: points with ``cluster_least`` others (itself included) within ``cluster_epsilon`` are cores; clusters are the
    cores' components and the points near them; the cluster is its smallest core's point_idx; noise is absent.

    A cell whose points are all within the radius of each other and enough is dense: its points are cores of one cluster, so it is one
    node of the graph, as is each core elsewhere.  Only the points outside dense cells, fewer than ``cluster_least`` a cell, look
    for their neighbours one by one; dense cells are joined by boxes.  So pairs grow with the points and not with their density.
    Radius and least number may be columns that depend on the sweep.
    """
    eps, size, box = p.cluster_epsilon, p.cluster_epsilon / 1.8, ["sx", "sy", "sz"]  # the radius reaches over two cells, with room for rounding
    finite = F.lit(True)
    for c in ("gx", "gy", "gz"):
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    base = saved(_in_cells(points.where(finite).select(*POINT, *[F.col(f"g{c}").alias(c) for c in "xyz"]), size, "s"))
    cells = base.groupBy(*SWEEP, *box).agg(F.count("*").alias("n"), F.min("point_idx").alias("node"), *_bounds())
    dense = saved(cells.where((F.col("n") >= p.cluster_least) & (_span("", "") <= eps * eps)).drop("n"))
    marked = saved(base.join(unsent(dense.select(*SWEEP, *box, "node")), [*SWEEP, *box], "left").drop(*box))
    discard(base)

    # points outside dense cells: how many neighbours in each dense cell, and which others
    lone = _cells_around(_in_cells(marked.where("node is null").select(*POINT, *[F.col(c).alias(f"a{c}") for c in "xyz"]), eps, x="a"))
    every = _in_cells(marked.select(*SWEEP, F.coalesce("node", "point_idx").alias("target"), *[F.col(c).alias(f"b{c}") for c in "xyz"]), eps, x="b")
    near = saved(unsent(lone).join(every, [*SWEEP, "cx", "cy", "cz"]).where(_near("a", "b", eps)).groupBy(*POINT, "target").agg(F.count("*").alias("n")))
    cores = near.groupBy(*POINT).agg(F.sum("n").alias("n")).where(F.col("n") >= p.cluster_least)
    nodes = saved(dense.select(*SWEEP, "node").unionByName(cores.select(*SWEEP, F.col("point_idx").alias("node"))).withColumn("component", F.col("node")))
    node_of = lambda name: unsent(nodes.select(*SWEEP, F.col("node").alias(name)))
    links = near.where("point_idx <> target").select(*SWEEP, F.col("point_idx").alias("a"), F.col("target").alias("b"))
    links = links.join(node_of("a"), [*SWEEP, "a"], "left_semi").join(node_of("b"), [*SWEEP, "b"], "left_semi")

    # dense cells: near as a whole, or at least in one inner box of each
    inner = _in_cells(marked.where("node is not null"), size / 4, "s").groupBy(*SWEEP, "node", *box).agg(F.count("*").alias("n"), *_bounds())
    bounds = [f"{e}{c}" for c in "xyz" for e in ("lo", "hi")]
    fullest = inner.groupBy(*SWEEP, "node").agg(F.max_by(F.struct(*bounds), "n").alias("i")).select(*SWEEP, "node", *[F.col(f"i.{c}").alias(f"i_{c}") for c in bounds])
    dense = saved(dense.join(fullest, [*SWEEP, "node"]))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    ahead = dense.withColumn("_s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s)]) for s in steps]))).withColumns({f"s{c}": F.col(f"s{c}") + F.col(f"_s.{c}") for c in "xyz"}).drop("_s")
    same = {c: c for c in box}
    pairs = unsent(_renamed(ahead, "a_", {"node": "a", **same})).join(_renamed(dense, "b_", {"node": "b", **same}), [*SWEEP, *box]).where(_gap("a_", "b_") <= eps * eps)
    pairs = saved(pairs.select(*SWEEP, "a", "b", ((_span("a_", "b_") <= eps * eps) | (_span("a_i_", "b_i_") <= eps * eps)).alias("sure")))
    components = _merged(nodes, saved(links.unionByName(pairs.where("sure").drop("sure"))))
    left = saved(_named(pairs.where("not sure"), components).select(*SWEEP, "a", "b"))
    if not left.isEmpty():
        components = _join_cells(marked.where("node is not null"), left, components, eps, size)
    inside = marked.where("node is not null").join(unsent(components), [*SWEEP, "node"]).select(*POINT, F.col("component").alias("cluster"))
    beside = near.join(unsent(components.withColumnRenamed("node", "target")), [*SWEEP, "target"]).groupBy(*POINT).agg(F.min("component").alias("cluster"))
    return inside.unionByName(beside)


def _distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _cells_around(df: DataFrame, n: str = "c") -> DataFrame:
    """A row for each of the 27 cells around a row's own (columns cx, cy, cz)."""
    steps = [F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return df.withColumn("_s", F.explode(F.array(*steps))).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"_s.{a}") for a in "xyz"}).drop("_s")


def _in_cells(df: DataFrame, size: float | Column, prefix: str = "c", x: str = "") -> DataFrame:
    return df.withColumns({f"{prefix}{a}": F.floor(F.col(f"{x}{a}") / size) for a in "xyz"})


def _within(points: DataFrame, every: DataFrame, radius: float) -> DataFrame:
    """Pairs of points and others of their sweep (x, y, z) at most ``radius`` away, themselves included: the point's columns without its place, and d.

    A cell is two radii wide, so a point meets the others of two cells an axis.
    """
    reach, size = radius * (1 + 1e-9), 2 * radius
    asked = points.withColumnsRenamed({c: f"a{c}" for c in "xyz"})
    for c in "xyz":
        asked = asked.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"a{c}") - reach) / size), F.floor((F.col(f"a{c}") + reach) / size))))
    others = _in_cells(every.select(*SWEEP, "x", "y", "z"), size).withColumnsRenamed({c: f"b{c}" for c in "xyz"})
    pairs = unsent(asked).join(others, [*SWEEP, "cx", "cy", "cz"])
    return pairs.select(*[c for c in points.columns if c not in ("x", "y", "z")], _distance("a", "b").alias("d")).where(F.col("d") <= radius)


def core_distances(points: DataFrame, near: int, radius: float) -> DataFrame:
    """Points (x, y, z) with the distance to their ``near``-th neighbour, themselves included (the farthest, where a sweep has fewer).

    Points are asked for within a radius that doubles until it holds enough; those that have enough ask no more, so that only
    the lone ones look far.  The first radius is so small that no cell holds more than a few times ``near`` points (1 / 1,024 of
    ``radius`` at the least, where points are repeated): pairs grow with the points, not with their density.
    """
    counted = points.withColumn("k", F.least(F.lit(near), F.count("*").over(Window.partitionBy(*SWEEP))).cast("int"))
    every = saved(counted)
    for _ in range(10):
        cells = _in_cells(every.select(*SWEEP, "x", "y", "z"), 2 * radius).groupBy(*SWEEP, "cx", "cy", "cz").count()
        if cells.where(F.col("count") > 8 * near).isEmpty():
            break
        radius /= 2
    left, found = every, None
    while True:
        within = _within(left, every, radius).groupBy(*POINT, "k").agg(F.sort_array(F.collect_list("d")).alias("ds"))
        settled = saved(within.where(F.size("ds") >= F.col("k")).select(*POINT, F.get("ds", F.col("k") - 1).alias("core")))
        found = settled if found is None else found.unionByName(settled)
        left = saved(left.join(unsent(settled), POINT, "left_anti"))
        if left.isEmpty():
            return saved(every.drop("k").join(unsent(found), POINT))
        radius *= 2


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components (of points) after those linked (a, b) became one, named after the least.

    Large and small stars by turns: what is linked with a node is linked with the node's least neighbour instead, first the greater
    neighbours, then the smaller ones.  A chain halves each round, in whatever order its names are, and there are never more links than at first.
    """
    edges = saved(links.select(*SWEEP, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    many = unsent if edges.count() > MANY else lambda df: df
    while True:
        both = edges.select(*SWEEP, F.col("a").alias("b"), F.col("b").alias("other")).unionByName(edges.select(*SWEEP, "b", F.col("a").alias("other")))
        least = both.groupBy(*SWEEP, "b").agg(F.min("other").alias("other")).select(*SWEEP, "b", F.least("b", "other").alias("least"))
        large = edges.join(many(least), [*SWEEP, "b"]).select(*SWEEP, "a", F.col("least").alias("b"), (F.col("b") != F.col("least")).alias("moved"))
        low = large.groupBy(*SWEEP, "a").agg(F.min("b").alias("low"))
        small = large.join(many(low), [*SWEEP, "a"]).withColumn("moved", F.col("moved") | (F.col("b") != F.col("low"))).withColumn("a", F.explode(F.array("a", "b"))).where("a <> low")
        step = saved(small.groupBy(*SWEEP, "a", F.col("low").alias("b")).agg(F.bool_or("moved").alias("moved")))
        discard(edges)
        edges = step.drop("moved")
        edges._saved_at = step._saved_at
        if step.where("moved").isEmpty():
            break
    names = edges.select(*SWEEP, F.col("a").alias("component"), F.col("b").alias("name"))
    out = saved(components.join(many(names), [*SWEEP, "component"], "left").withColumn("component", F.coalesce("name", "component")).drop("name"))
    discard(edges)
    return out


def reachability_edges(points: DataFrame, near: int, radius: float) -> DataFrame:
    """Edges that hold a minimum spanning tree over mutual reachability distances: sweep, w, p, q.

    Radii grow fourfold.  At each, the least edge between any two components of the radius before is an edge, and what these join
    becomes one component (Kruskal's order, by ranges of weight).  Components are compared by boxes first: of each pair of
    components only the boxes that can hold its least edge, by the bounds of all, meet point by point.
    """
    cored = core_distances(points, near, radius)
    (least,) = cored.agg(F.percentile_approx("core", 0.1)).first()
    if least is None:
        return cored.select(*SWEEP, F.lit(0.0).alias("w"), F.col("point_idx").alias("p"), F.col("point_idx").alias("q")).limit(0)
    components, radius, edges = saved(cored.withColumn("component", F.col("point_idx"))), max(least, radius / 64), None
    while not components.groupBy(*SWEEP).agg(F.count_distinct("component").alias("n")).where("n > 1").isEmpty():
        reached = _in_cells(components.where(F.col("core") <= radius), radius / 4, "s")
        box = ["sx", "sy", "sz"]
        boxes = reached.groupBy(*SWEEP, "component", *box).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))], F.min("core").alias("core"))
        boxes = saved(boxes.withColumns({f"c{a}": F.floor(F.col(f"s{a}") / 4) for a in "xyz"}))
        side = lambda df, n: df.select(*SWEEP, "cx", "cy", "cz", *[F.col(c).alias(f"{n}_{c}") for c in ("component", *box, "core", *[f"{e}{c}" for c in "xyz" for e in ("lo", "hi")])])
        pairs = unsent(side(_cells_around(boxes), "a")).join(side(boxes, "b"), [*SWEEP, "cx", "cy", "cz"]).where("a_component < b_component")
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}")) for c in "xyz"]
        spans = [F.greatest(F.col(f"a_hi{c}") - F.col(f"b_lo{c}"), F.col(f"b_hi{c}") - F.col(f"a_lo{c}")) for c in "xyz"]
        norm_of = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        pairs = pairs.select(*SWEEP, *[f"{n}_{c}" for n in "ab" for c in ("component", *box)], F.greatest(norm_of(gaps), "a_core", "b_core").alias("lower"), F.greatest(norm_of(spans), "a_core", "b_core").alias("upper")).where(F.col("lower") <= radius * (1 + 1e-9))
        bound = F.min("upper").over(Window.partitionBy(*SWEEP, "a_component", "b_component"))
        close = pairs.withColumn("bound", bound).where(F.col("lower") <= F.col("bound") * (1 + 1e-9)).drop("lower", "upper", "bound")
        for n in "ab":
            own = reached.select(*SWEEP, *[F.col(c).alias(f"{n}_{c}") for c in ("component", *box)], F.col("point_idx").alias(f"{n}_point"), F.col("core").alias(f"{n}_core"), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
            close = close.join(unsent(own), [*SWEEP, f"{n}_component", *[f"{n}_{c}" for c in box]])
        weighed = close.select(*SWEEP, F.col("a_component").alias("a"), F.col("b_component").alias("b"), F.greatest(_distance("a", "b"), "a_core", "b_core").alias("w"), F.col("a_point").alias("p"), F.col("b_point").alias("q")).where(F.col("w") <= radius)
        level = saved(weighed.groupBy(*SWEEP, "a", "b").agg(F.min(F.struct("w", "p", "q")).alias("e")).select(*SWEEP, "a", "b", "e.*"))
        discard(boxes)
        if not level.isEmpty():
            edges = level if edges is None else edges.unionByName(level)
            old, components = components, _merged(components, level)
            discard(old)
        radius *= 4
    return (edges if edges is not None else cored.select(*SWEEP, F.lit(0.0).alias("w"), F.col("point_idx").alias("p"), F.col("point_idx").alias("q")).limit(0)).select(*SWEEP, "w", "p", "q")


def tree_clusters(n: int, edges: list[tuple[float, int, int]], least: int, epsilon: float) -> np.ndarray:
    """Cluster number of each of n points, -1 for noise: the stable clusters of the density hierarchy, none born below ``epsilon``.

    ``edges`` (weight, point, point; shortest first) hold a minimum spanning tree.  What edges of one weight join is one node of
    the hierarchy, with as many branches as it takes, so that ties don't depend on which tree is given.
    """
    out = np.full(n, -1)
    if n < max(least, 2):
        return out
    kids: dict[int, list[int]] = {}
    height: dict[int, float] = {}
    size, top = [1] * n, list(range(n))

    def root(a: int) -> int:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    for d, a, b in edges:
        x, y = root(a), root(b)
        if x == y:
            continue
        branches = [k for z in (x, y) for k in (kids.pop(z) if height.get(z) == d else [z])]
        new = len(top)
        top.append(new)
        top[x] = top[y] = new
        size.append(size[x] + size[y])
        kids[new], height[new] = branches, d
    whole = root(0)

    def leaves(a: int) -> list[int]:
        stack, found = [a], []
        while stack:
            b = stack.pop()
            stack.extend(kids[b]) if b >= n else found.append(b)
        return found

    # condense: walk down from the whole; a split counts when two branches or more have ``least`` points
    stability: dict[int, float] = {}
    below: dict[int, list[int]] = {}
    splits: dict[int, float] = {}
    order, stack = [], [(whole, whole, 0.0)]
    while stack:
        node, cluster, birth = stack.pop()
        if node == cluster:
            order.append(cluster)
            stability[cluster], below[cluster] = 0.0, []
        if node < n:
            continue
        lam = 1 / max(height[node], 1e-12)
        big = [c for c in kids[node] if size[c] >= least]
        if len(big) >= 2:
            stability[cluster] += (lam - birth) * size[node]
            below[cluster] = big
            splits[cluster] = height[node]
            stack += [(c, c, lam) for c in big]
        else:
            stability[cluster] += sum((lam - birth) * size[c] for c in kids[node] if c not in big)
            stack += [(c, cluster, birth) for c in big]
    value: dict[int, float] = {}
    pick: dict[int, list[int]] = {}
    for cluster in reversed(order):
        inner = sum(value[c] for c in below[cluster])
        if below[cluster] and (cluster == whole or inner > stability[cluster] and splits[cluster] >= epsilon):
            value[cluster], pick[cluster] = inner, [q for c in below[cluster] for q in pick[c]]
        else:
            # the whole is no cluster of its own: points that never split in two are noise
            value[cluster], pick[cluster] = stability[cluster], [cluster] if cluster != whole else []
    for number, c in enumerate(pick[whole]):
        out[leaves(c)] = number
    return out


def cluster_hdbscan(points: DataFrame, p: Params, least: int | None = None) -> DataFrame:
    """Density-hierarchy clusters of each sweep's points; the cluster is its smallest point_idx, noise is absent.

    Core distances and the edges of the hierarchy come from joins over cells.  Only the edges of a sweep, about one a point,
    meet in a task, which sorts them and walks the tree.  Points that aren't finite are noise.
    """
    least, near, epsilon = least or p.cluster_size or p.cluster_least, p.cluster_least, p.cluster_epsilon
    finite = F.lit(True)
    for c in ("gx", "gy", "gz"):
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bare = points.where(finite).select(*POINT, *[F.col(f"g{c}").alias(c) for c in "xyz"])

    def one_sweep(rows: pa.Table) -> pa.Table:
        w, p_, q = (rows[c].to_numpy() for c in ("w", "p", "q"))
        names, at = np.unique(np.concatenate([p_, q]), return_inverse=True)
        order = np.argsort(w, kind="stable")
        number = tree_clusters(len(names), list(zip(w[order].tolist(), at[: len(p_)][order].tolist(), at[len(p_) :][order].tolist())), least, epsilon)
        kept = number >= 0
        first = np.full(number.max(initial=-1) + 1, np.iinfo(np.int32).max, np.int64)
        np.minimum.at(first, number[kept], names[kept])
        n = int(kept.sum())
        columns = [np.full(n, rows["scene_id"][0].as_py(), np.int64), np.full(n, rows["sweep_idx"][0].as_py(), np.int32), names[kept].astype(np.int32), first[number[kept]].astype(np.int32)]
        return pa.table([pa.array(c) for c in columns], names=[*POINT, "cluster"])

    edges = reachability_edges(bare, near, epsilon / 4 if epsilon > 0 else 0.1)
    return edges.groupBy(*SWEEP).applyInArrow(one_sweep, "scene_id long, sweep_idx int, point_idx int, cluster int")


def drop_noise(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """Dynamic points without a cluster become undetermined; places that labels have stay with them.  Other points don't move."""
    kept, dynamic = [*POINT, *_placed(labels)], F.col("label").eqNullSafe(DYNAMIC)
    joined = labels.where(dynamic).join(unsent(clusters.select(*POINT, "cluster")), POINT, "left")
    asked = joined.select(*kept, F.when(F.col("cluster").isNull(), UNDETERMINED).otherwise(DYNAMIC).cast("byte").alias("label"))
    return labels.where(~dynamic).select(*kept, F.col("label").cast("byte").alias("label")).unionByName(asked)


def _placed(df: DataFrame) -> tuple[str, ...]:
    """The places' columns, if ``df`` has them."""
    return PLACE if set(PLACE) <= set(df.columns) else ()


def _grown(labels: DataFrame, hulls: DataFrame, gpoints: DataFrame, cell: float, inside: Column) -> DataFrame:
    """Labels after points ``inside`` any of their sweep's ``hulls`` (bounds lo0, hi0, lo1, hi1) became dynamic.

    Points meet only the hulls whose bounds touch their cell of the ground, and dynamic ones none: they stay so.
    """
    for i, a in enumerate("xy"):
        hulls = hulls.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col(f"lo{i}") - 1e-6) / cell), F.floor((F.col(f"hi{i}") + 1e-6) / cell))))
    dynamic = F.col("label").eqNullSafe(DYNAMIC)
    others = labels.where(~dynamic)
    points = others if _placed(labels) else gpoints
    keyed = points.select(*POINT, *PLACE).withColumns({f"c{a}": F.floor(F.col(f"g{a}") / cell) for a in "xy"})
    hit = keyed.join(hulls, [*SWEEP, "cx", "cy"]).where(inside).select(*POINT, F.lit(DYNAMIC).cast("byte").alias("_new")).distinct()
    grown = others.select(*POINT, "label").join(hit, POINT, "left").select(*POINT, F.coalesce("_new", "label").alias("label"))
    return labels.where(dynamic).select(*POINT, "label").unionByName(grown)


def expand_hull(labels: DataFrame, clusters: DataFrame, gpoints: DataFrame, cell: float = 8.0) -> DataFrame:
    """Points of a sweep inside a cluster's outer polytope become dynamic; clusters of under 4 points or without volume don't grow.

    Clusters and labels that have places (gx, gy, gz) need no join with ``gpoints``.
    """
    at = lambda d: d[0] * F.col("gx") + d[1] * F.col("gy") + d[2] * F.col("gz")
    bounds = [f(at(d)).alias(f"{n}{i}") for i, d in enumerate(DIRECTIONS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    own = clusters if _placed(clusters) else gpoints.join(clusters, POINT)
    hulls = own.groupBy(*SWEEP, "cluster").agg(F.count("*").alias("n"), *bounds).where("n >= 4 and " + " and ".join(f"hi{i} > lo{i}" for i in range(3)))
    inside = F.lit(True)
    for i, d in enumerate(DIRECTIONS):
        inside = inside & at(d).between(F.col(f"lo{i}") - 1e-9, F.col(f"hi{i}") + 1e-9)
    return _grown(labels, hulls, gpoints, cell, inside)


def _from_plane(points: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    return points @ normal - offset


def hull_planes(points: np.ndarray, tolerance: float = HULL_TOLERANCE) -> np.ndarray:
    """Planes (nx, ny, nz, d: inside is n . x <= d) of the convex hull of points; none if they lie in a plane.

    A tetrahedron of far points grows by the farthest point outside one of its faces, which replaces the faces that see it.
    """
    first = points[np.argmin(points[:, 0])]
    second = points[np.argmax(((points - first) ** 2).sum(axis=1))]
    third = points[np.argmax((np.cross(points - first, second - first) ** 2).sum(axis=1))]
    normal = np.cross(second - first, third - first)
    if not (size := np.sqrt(normal @ normal)) > 0:
        return np.zeros((0, 4))
    away = _from_plane(points, normal / size, first @ normal / size)
    fourth = points[np.argmax(np.abs(away))]
    if not np.abs(away).max() > tolerance:
        return np.zeros((0, 4))
    corners = [first, second, third, fourth]
    centre = np.mean(corners, axis=0)
    faces: list[tuple[tuple[int, int, int], np.ndarray, float, np.ndarray]] = []

    def add(face: tuple[int, int, int], outside: np.ndarray) -> np.ndarray:
        """Puts a face in, with the points outside it; returns the others."""
        a, b, c = (corners[k] for k in face)
        n = np.cross(b - a, c - a)
        if not (length := np.sqrt(n @ n)) > 0:
            return outside
        n = n / length
        if n @ centre > n @ a:
            n, face = -n, (face[0], face[2], face[1])
        out = _from_plane(points[outside], n, n @ a) > tolerance
        faces.append((face, n, float(n @ a), outside[out]))
        return outside[~out]

    left = np.arange(len(points))
    for face in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        left = add(face, left)
    while (at := next((f for f in faces if len(f[3])), None)) is not None:
        far = points[at[3][np.argmax(_from_plane(points[at[3]], at[1], at[2]))]]
        seen = [f for f in faces if f[1] @ far - f[2] > tolerance]
        faces = [f for f in faces if not f[1] @ far - f[2] > tolerance]
        edges = {e for f in seen for e in ((f[0][0], f[0][1]), (f[0][1], f[0][2]), (f[0][2], f[0][0]))}
        corners.append(far)
        left = np.unique(np.concatenate([f[3] for f in seen]))
        for a, b in edges:
            if (b, a) not in edges:  # the rim of what the point sees
                left = add((a, b, len(corners) - 1), left)
    return np.array([(*f[1], f[2]) for f in faces])


def expand_hull_exact(labels: DataFrame, clusters: DataFrame, gpoints: DataFrame, cell: float = 8.0) -> DataFrame:
    """Points of a sweep inside or on a cluster's convex hull become dynamic; clusters of under 4 points or within a plane don't grow.

    Only points that are the farthest of their cluster in one of many directions, or beyond all of these, can be corners: the
    inner polytope of a cluster's extreme points drops the others before its hull is built, one cluster a row of a task.
    """
    own = (clusters if _placed(clusters) else gpoints.join(clusters, POINT)).select(*SWEEP, "cluster", *PLACE)

    def hulls(rows: pa.Table) -> pa.Table:
        p = np.stack([rows[c].to_numpy() for c in ("gx", "gy", "gz")], axis=1)
        far = np.unique([f(p @ np.array(d, float)) for d in DIRECTIONS for f in (np.argmin, np.argmax)])
        inner = hull_planes(p[far])
        if len(inner):  # what is well inside is no corner
            deep = (p @ inner[:, :3].T - inner[:, 3] < -HULL_TOLERANCE).all(axis=1)
            deep[far] = False
            p = p[~deep]
        planes = hull_planes(p)
        low, high = p.min(axis=0), p.max(axis=0)
        lists = pa.array([[{"x": a, "y": b, "z": c, "d": d} for a, b, c, d in planes.tolist()]], pa.list_(pa.struct([(n, pa.float64()) for n in "xyzd"])))
        return pa.table({**{c: rows[c][:1] for c in (*SWEEP, "cluster")}, **{f"lo{i}": pa.array([low[i]]) for i in range(3)}, **{f"hi{i}": pa.array([high[i]]) for i in range(3)}, "planes": lists})

    enough = own.withColumn("_n", F.count("*").over(Window.partitionBy(*SWEEP, "cluster"))).where("_n >= 4").drop("_n")
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in (*SWEEP, "cluster"))
    found = enough.groupBy(*SWEEP, "cluster").applyInArrow(hulls, f"{kinds}, " + ", ".join(f"{n}{i} double" for n in ("lo", "hi") for i in range(3)) + ", planes array<struct<x: double, y: double, z: double, d: double>>")
    found = found.where("size(planes) > 0").drop("cluster")
    bounded = F.lit(True)
    for i, a in enumerate("xyz"):
        bounded = bounded & F.col(f"g{a}").between(F.col(f"lo{i}") - HULL_TOLERANCE, F.col(f"hi{i}") + HULL_TOLERANCE)
    inside = F.forall("planes", lambda f: f.x * F.col("gx") + f.y * F.col("gy") + f.z * F.col("gz") - f.d <= HULL_TOLERANCE)
    return _grown(labels, found, gpoints, cell, bounded & inside)


def refinable(dynamic: DataFrame, p: Params) -> DataFrame:
    """Sweeps whose dynamic points are at least ``cluster_least`` and all finite; others keep their labels."""
    finite = F.lit(True)
    for c in ("gx", "gy", "gz"):
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return dynamic.groupBy(*SWEEP).agg(F.count("*").alias("n"), F.bool_and(finite).alias("finite")).where((F.col("n") >= p.cluster_least) & F.col("finite")).select(*SWEEP)


def refine(labels: DataFrame, gpoints: DataFrame, p: Params) -> DataFrame:
    """``p.refine``: "density" or "hdbscan" with growth to hulls (``p.hull``: "outer" or "exact"); anything else leaves the labels.

    Labels that have places need no join with ``gpoints``.
    """
    methods = {"density": cluster_density, "hdbscan": cluster_hdbscan}
    if p.refine not in methods:
        return labels.select(*POINT, "label")
    dynamic = labels.where(F.col("label") == DYNAMIC)
    dynamic = dynamic.select(*POINT, *PLACE) if _placed(labels) else gpoints.select(*POINT, *PLACE).join(dynamic.select(*POINT), POINT, "left_semi")
    sweeps = saved(refinable(dynamic, p))
    clusters = methods[p.refine](dynamic.join(sweeps, SWEEP, "left_semi"), p)
    if p.cluster_size is not None:  # smaller clusters are noise
        clusters = clusters.withColumn("_n", F.count("*").over(Window.partitionBy(*SWEEP, "cluster"))).where(F.col("_n") >= p.cluster_size).drop("_n")
    clusters = saved(dynamic.join(clusters, POINT))
    grow = {"outer": expand_hull, "exact": expand_hull_exact}[p.hull]
    refined = grow(drop_noise(labels.join(sweeps, SWEEP, "left_semi"), clusters), clusters, gpoints)
    return refined.unionByName(labels.join(sweeps, SWEEP, "left_anti").select(*POINT, "label"))

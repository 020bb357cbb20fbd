"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree cuts the unit vectors by random directions at a random quantile near the middle,
again and again until a leaf is small; a vector near a cut goes to both sides (spill). The
upper cuts are fitted on a bounded sample, those below are quantiles over all vectors of a
node, and every vector is routed through every tree. Within a leaf all pairs are compared,
block by block, in double precision.

A pair may share leaves in several trees. It is counted in the first of them only, which
both vectors know from the leaves they carry, so link counts are exact sums and no pair is
ever written out; for the components a leaf emits a spanning set of its links.

Leaves cannot hold a group much larger than themselves, so dense groups do not depend on
them. Vectors with many links in a leaf of the first tree name pivots; every vector within
REACH of the threshold's angle of a pivot belongs to the ball of its nearest one, in a ring by
its angle. Links between two members of balls are exact: rings that the triangle inequality
decides are counted in bulk, the others are compared, block by block, in tasks of their own.
Leaves count what is left, the pairs with at least one vector outside all balls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import materialize, small, spread
from quadrille.llm.graph import connected_components

TREES = 6
#: Vectors that a leaf holds on average.
LEAF = 2048
#: Cuts from root to leaf that are fitted on the sample, at most; those below are fitted on all vectors.
MOST_CUTS = 12
#: Share of a node's vectors on either side of a cut that go both ways.
SPILL = 0.03
#: Vectors that the cuts are fitted on, at most.
SAMPLE = 100_000
THRESHOLD = 0.9
#: Links in a leaf, as a share of LEAF, that make a vector the seed of a pivot.
DENSE = 0.0625
#: Vectors of one leaf that pivots are sought among, at most; of more, every k-th.
SEEDS = 4096
#: Angle of a ball as a multiple of the threshold's angle. Links of a vector within (REACH - 1) of it are all inside.
REACH = 1.5
#: Rings from a pivot to the threshold's angle.
RINGS = 48
#: Radians by which a bound must hold before the triangle inequality decides.
SLACK = 1e-6
#: Components of the vectors in a block of ring members to compare.
BLOCK_CELLS = 1 << 19
#: Rows of a block of similarities.
BLOCK = 512


class Tree:
    """A complete binary tree of cuts. All nodes of a level share a random direction; each has its own
    cut and spill margins, fitted on a sample down to `top` levels."""

    def __init__(self, sample: np.ndarray, top: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.top, self.direction = top, rng.standard_normal((depth, sample.shape[1]))
        self.quantiles = rng.uniform(0.45, 0.55, depth)
        inner = (1 << top) - 1
        self.low, self.high = np.zeros(inner), np.zeros(inner)
        x, held = self.project(sample), {0: np.arange(len(sample))}
        for level in range(top):
            for i in range((1 << level) - 1, (2 << level) - 1):
                own = held.pop(i)
                if len(own):
                    self.low[i], self.high[i] = np.quantile(x[own, level], self.at(level))
                held[2 * i + 1], held[2 * i + 2] = own[x[own, level] <= self.high[i]], own[x[own, level] > self.low[i]]

    def at(self, level: int) -> list[float]:
        """Quantiles between which a node's vectors go both ways."""
        return [float(self.quantiles[level] + s) for s in (-SPILL, SPILL)]

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.direction.T

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of projected vectors: every row has one leaf or more."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(self.top):
            v = x[rows, level]
            left, right = v <= self.high[node], v > self.low[node]
            rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return rows, node - ((1 << self.top) - 1)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of the usable vectors as bytes; null for the others."""
    for b in batches:
        lists = b.column(1)
        flat, offsets = lists.values, lists.offsets.to_numpy()
        values = flat.to_numpy(zero_copy_only=False)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null component reads as NaN
        some = np.concatenate([[0], np.cumsum(np.nan_to_num(values) != 0)])
        lo, hi = offsets[:-1], offsets[1:]
        good = np.array(lists.is_valid()) & (bad[hi] == bad[lo]) & (some[hi] > some[lo])
        raw = values.tobytes()
        w = values.itemsize
        held = [raw[i * w : j * w] if ok else None for i, j, ok in zip(lo.tolist(), hi.tolist(), good.tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array((hi - lo).astype(np.int32), mask=~good), pa.array(held, pa.binary())], ["vec_id", "dim", "unit"])


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, of components held in single or double precision."""
    held = column.to_pylist()
    x = np.frombuffer(b"".join(held), np.float32 if held and len(held[0]) == 4 * dim else np.float64).reshape(len(held), dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _router(shared, dim: int, with_rest: bool = False):
    """Adds the leaves of each vector as leaf numbers (tree << top) + leaf; with_rest gives a row for
    each leaf instead, with the projections that the levels below `top` cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x = _stack(b.column("unit"), dim)
                all_rows, all_leaves, rest = [], [], []
                for t, tree in enumerate(shared.value):
                    v = tree.project(x)
                    rows, leaf = tree.leaves(v)
                    all_rows.append(rows)
                    all_leaves.append((t << tree.top) + leaf)
                    if with_rest:
                        rest.append(v[rows, tree.top :])
                rows, leaves = np.concatenate(all_rows), np.concatenate(all_leaves)
                if with_rest:
                    left = np.concatenate(rest)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * left.shape[1], pa.int32()), pa.array(left.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(rows)), pa.array(leaves), lists], ["rep", "leaf", "rest"])
                    continue
                order = np.lexsort((leaves, rows))
                rows, leaves = rows[order], leaves[order]
                offsets = np.searchsorted(rows, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves))], [*b.schema.names, "leaves"])

    return run


def _deeper(vectors: DataFrame, grown: list[Tree], forest, dim: int, depth: int) -> DataFrame:
    """(rep, leaves) by all levels of the trees: below `top` a level's cuts are quantiles over all
    vectors of each node, found by an aggregate that holds a few thousand values of a node at most."""
    top = grown[0].top
    placed = materialize(vectors.select("rep", "unit").mapInArrow(_router(forest, dim, True), "rep long, leaf long, rest array<double>"), "placed")
    for level in range(depth - top):
        value = F.element_at("rest", level + 1)
        # A node's summary is asked for the quantiles of all trees, and those of its own are taken.
        wanted = [q for t in grown for q in t.at(top + level)]
        own = 2 * F.shiftright("leaf", top + level).cast("int")
        cuts = placed.groupBy("leaf").agg(F.percentile_approx(value, wanted, 2000).alias("cuts"))
        cuts = materialize(cuts.select("leaf", F.element_at("cuts", own + 1).alias("low"), F.element_at("cuts", own + 2).alias("high")), "cuts")
        sides = F.filter(F.array(F.when(value <= F.col("high"), 0), F.when(value > F.col("low"), 1)), lambda x: x.isNotNull())
        placed = placed.join(small(cuts, 24), "leaf").select("rep", F.explode(sides).alias("side"), "leaf", "rest")
        placed = materialize(placed.select("rep", (2 * F.col("leaf") + F.col("side")).alias("leaf"), "rest"), "placed")
    return placed.groupBy("rep").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the least value that two padded sorted tables share."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(a.shape[1]):
        same = (b == a[:, i : i + 1]).any(axis=1) & (a[:, i] >= 0)
        out = np.where(same, np.minimum(out, a[:, i]), out)
    return out


class _Tally:
    """Link counts by row, and spanning edges, of the links added so far."""

    def __init__(self, ids: np.ndarray, size: np.ndarray):
        self.ids, self.size = ids, size
        self.counts, self.root, self.edges = np.zeros(len(ids), np.int64), np.arange(len(ids)), []

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        n = len(self.ids)
        self.counts += np.bincount(p, self.size[q], n).astype(np.int64) + np.bincount(q, self.size[p], n).astype(np.int64)
        for i, j in _joins(p, q, self._find, self.root):
            self.edges.append((self.ids[i], self.ids[j]))

    def batch(self) -> pa.RecordBatch:
        own = self.counts > 0
        rep = np.concatenate([self.ids[own], np.array([e[0] for e in self.edges], np.int64)])
        links = np.concatenate([self.counts[own], np.zeros(len(self.edges), np.int64)])
        other = pa.array([None] * int(own.sum()) + [int(e[1]) for e in self.edges], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(links, pa.int64()), other], ["rep", "links", "other"])


def _compare(unit: np.ndarray, ids: np.ndarray, size: np.ndarray, dense: np.ndarray, leaves: list[np.ndarray], leaf: int, threshold: float) -> _Tally:
    """The pairs that this leaf owns, without those of two members of balls."""
    n, tally = len(ids), _Tally(ids, size)
    wide = max(map(len, leaves))
    table = np.full((n, wide), -1, np.int64)
    for i, own in enumerate(leaves):
        table[i, : len(own)] = own
    for lo in range(0, n, BLOCK):
        for lo2 in range(lo, n, BLOCK):
            s = unit[lo : lo + BLOCK] @ unit[lo2 : lo2 + BLOCK].T
            a, b = np.nonzero((s >= threshold) & ~(dense[lo : lo + BLOCK, None] & dense[None, lo2 : lo2 + BLOCK]))
            a, b = a + lo, b + lo2
            keep = a < b
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 1 << 16):
                p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
                mine = _first_common(table[p], table[q]) == leaf
                tally.add(p[mine], q[mine])
    return tally


def _joins(p: np.ndarray, q: np.ndarray, find, root: np.ndarray):
    """Pairs that join two parts so far apart; most pairs of a dense group are passed over in bulk."""
    while len(p):
        while True:  # flatten
            up = root[root]
            if (up == root).all():
                break
            root[:] = up
        apart = root[p] != root[q]
        p, q = p[apart], q[apart]
        if not len(p):
            return
        # one join for each part at a time
        _, first = np.unique(root[q], return_index=True)
        for i, j in zip(p[first].tolist(), q[first].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                yield i, j


_LINKS = "rep long, links long, other long"


def _leaf_links(threshold: float, dim: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("rep")
        ids, size, dense = (rows.column(c).to_numpy() for c in ("rep", "size", "dense"))
        if dense.all():
            return
        lists = rows.column("leaves").combine_chunks()
        leaves = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1])
        yield _compare(_stack(rows.column("unit"), dim), ids, size, dense, leaves, key[0].as_py(), threshold).batch()

    return run


def _direction(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x) or 1.0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _seeds(threshold: float, least: float, dim: int):
    """The mean directions of the dense groups in a leaf, with their numbers of vectors."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("rep")
        x = _stack(rows.column("unit"), dim)
        step = -(-len(x) // SEEDS)
        x = x[::step]
        near = np.empty((len(x), len(x)), bool)
        for lo in range(0, len(x), BLOCK):
            near[lo : lo + BLOCK] = x[lo : lo + BLOCK] @ x.T >= threshold
        alive, pivots, held = np.ones(len(x), bool), [], []
        degree = near.sum(axis=1) - 1
        while degree.max() * step >= least:
            own = near[degree.argmax()] & alive
            own[degree.argmax()] = True
            own |= (x @ _direction(x[own].mean(axis=0)) >= threshold) & alive
            pivots.append(_direction(x[own].mean(axis=0)).tobytes())
            held.append(int(own.sum()) * step)
            alive &= ~own
            degree = np.where(alive, near[:, alive].sum(axis=1) - 1, -1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(held), pa.int64()), pa.array(pivots, pa.binary()), pa.array(held, pa.int64())], ["leaf", "unit", "held"])

    return run


def _merged(pivots: np.ndarray, held: np.ndarray, angle: float) -> np.ndarray:
    """Slices of one group, found in many leaves, become one pivot."""
    out = []
    while len(pivots):
        near = pivots @ pivots[0] >= np.cos(angle)
        near[0] = True
        out.append(_direction(held[near] @ pivots[near]))
        pivots, held = pivots[~near], held[~near]
    return np.array(out)


def _pivots(vectors: DataFrame, tree, threshold: float, theta: float, dim: int) -> np.ndarray:
    """The pivots of dense groups, at most one for DENSE * LEAF vectors."""
    found = vectors.mapInArrow(_router(tree, dim), "rep long, size long, unit binary, leaves array<long>").select("rep", "unit", F.explode("leaves").alias("leaf"))
    found = found.groupBy("leaf").applyInArrow(_seeds(threshold, DENSE * LEAF, dim), "leaf long, unit binary, held long").toArrow()
    if not found.num_rows:
        return np.zeros((0, 0))
    found = found.sort_by([("held", "descending"), ("leaf", "ascending"), ("unit", "ascending")])
    return _merged(_stack(found.column("unit"), dim), found.column("held").to_numpy(), theta / 2)


def _ringed(shared, reach: float, step: float, dim: int):
    """Adds the ball of each vector, -1 outside all, and its ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                s = _stack(b.column(2), dim) @ shared.value.T
                ball = s.argmax(axis=1)
                angle = _angle(s[np.arange(len(s)), ball])
                ball = np.where(angle <= reach, ball, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball), pa.array((angle / step).astype(np.int32))], ["rep", "size", "unit", "ball", "ring"])

    return run


def _rings_plan(pivots: np.ndarray, cells: dict[str, np.ndarray], theta: float, step: float, block: int):
    """What the triangle inequality says of the cells (ball, ring), which are sorted.

    Gives by cell the vectors that all its members surely link with, the cell's own ones
    included where they do (own), a cell whose rep they all link with (-1: none), and its
    first block and number of blocks (0: nothing to compare); then the edges between balls,
    and the tasks (first block, second block, angle between their pivots).
    """
    ball, ring, n, size, rep = (cells[c] for c in ("ball", "ring", "n", "size", "rep"))
    sure, own, partner = np.zeros(len(ball), np.int64), np.zeros(len(ball), bool), np.full(len(ball), -1, np.int64)
    at = np.searchsorted(ball, np.arange(len(pivots) + 1))
    radius = np.array([(ring[hi - 1] + 1) * step if hi > lo else -np.inf for lo, hi in zip(at, at[1:])])
    open_, edges, compared = [], [], np.zeros(len(ball), bool)
    for a in np.flatnonzero(np.isfinite(radius)):
        gaps = _angle(pivots[a:] @ pivots[a])
        gaps[0] = 0.0
        for b in a + np.flatnonzero(gaps - radius[a] - radius[a:] <= theta + SLACK):
            gap, i, j = float(gaps[b - a]), np.arange(at[a], at[a + 1]), np.arange(at[b], at[b + 1])
            x, y = ring[i][:, None], ring[j][None, :]
            always = _surely(x, y, gap, theta, step)
            low = np.maximum(gap - (x + y + 2) * step, np.maximum(x - y - 1, y - x - 1) * step - gap)
            maybe = ~always & (low <= theta + SLACK)
            sure[i] += always @ size[j]
            if a == b:
                own[i] = np.diag(always)
                partner[i[always[:, 0]]] = j[0]
            elif always.any():  # then the innermost rings of both link
                sure[j] += always.T @ size[i]
                edges.append((int(rep[i[0]]), int(rep[j[0]])))
                for k, to in ((i[always[:, 0]], j[0]), (j[always[0]], i[0])):
                    partner[k[partner[k] < 0]] = to
            p, q = np.nonzero(maybe)
            if len(p):
                open_.append((gap, i[p], j[q]))
                compared[i[p]] = compared[j[q]] = True
    # Rings of one ball share a block while they fit; a ring beyond that takes several.
    first, blocks, spans, next_, room, last = np.zeros(len(ball), np.int64), np.zeros(len(ball), np.int64), {}, 0, 0, -1
    for c in np.flatnonzero(compared):
        if ball[c] == last and n[c] <= room:
            first[c], blocks[c], room = next_ - 1, 1, room - n[c]
        else:
            first[c], blocks[c] = next_, -(-n[c] // block)
            next_ += int(blocks[c])
            room, last = (block - n[c], ball[c]) if blocks[c] == 1 else (0, -1)
        spans[int(first[c])] = int(blocks[c])
    tasks = []
    for gap, i, j in open_:
        pairs = np.unique(np.sort(np.stack([first[i], first[j]], axis=1), axis=1), axis=0)
        for u, v in pairs.tolist():
            tasks += [(x, y, gap) for x in range(u, u + spans[u]) for y in range(v, v + spans[v]) if x <= y]
    return sure, own, partner, first, blocks, edges, tasks


def _surely(x, y, gap: float, theta: float, step: float):
    """Whether all vectors of ring x of a ball link with all of ring y of a ball so far away."""
    return (x + y + 2) * step + gap <= theta - SLACK


def _ring_links(threshold: float, theta: float, step: float, dim: int):
    """Links between two blocks of ring members, without those counted in bulk."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("second", "ascending"), ("rep", "ascending")])
        ids, size, ring, second = (rows.column(c).to_numpy() for c in ("rep", "size", "ring", "second"))
        unit, gap = _stack(rows.column("unit"), dim), rows.column("gap")[0].as_py()
        n, split, tally = len(ids), int((~second).sum()), _Tally(ids, size)
        alone = rows.column("alone")[0].as_py()
        for lo in range(0, n if alone else split, BLOCK):
            hi = min(lo + BLOCK, n if alone else split)
            for lo2 in range(lo if alone else split, n, BLOCK):
                s = unit[lo:hi] @ unit[lo2 : lo2 + BLOCK].T
                a, b = np.nonzero((s >= threshold) & ~_surely(ring[lo:hi, None], ring[None, lo2 : lo2 + BLOCK], gap, theta, step))
                a, b = a + lo, b + lo2
                tally.add(a[a < b], b[a < b])
        yield tally.batch()

    return run


def _ball_links(members: DataFrame, pivots: np.ndarray, threshold: float, theta: float, step: float, block: int) -> DataFrame:
    """All links between members (rep, size, unit, ball, ring) of balls."""
    spark = members.sparkSession
    cells = members.groupBy("ball", "ring").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("rep").alias("rep")).toArrow().sort_by([("ball", "ascending"), ("ring", "ascending")])
    cells = {c: cells.column(c).to_numpy() for c in cells.column_names}
    sure, own, partner, first, blocks, edges, tasks = _rings_plan(pivots, cells, theta, step, block)
    names = pa.array(cells["rep"][partner], pa.int64(), mask=partner < 0)
    told = spark.createDataFrame(pa.table({"ball": cells["ball"], "ring": cells["ring"], "sure": sure, "own": own, "partner": names, "first": first, "blocks": blocks}))
    placed = members.join(small(told, 48), ["ball", "ring"])
    links = F.col("sure") - F.when(F.col("own"), F.col("size")).otherwise(0)
    out = placed.where("sure > 0").select("rep", links.alias("links"), F.when(F.col("partner") != F.col("rep"), F.col("partner")).alias("other"))
    if edges:
        out = out.unionByName(spark.createDataFrame([(a, 0, b) for a, b in edges], _LINKS))
    if tasks:
        sides = [(t, x, gap, False, x == y) for t, (x, y, gap) in enumerate(tasks)] + [(t, y, gap, True, False) for t, (x, y, gap) in enumerate(tasks) if x != y]
        sides = spark.createDataFrame(sides, "task long, block long, gap double, second boolean, alone boolean")
        at = F.col("first") + F.pmod(F.xxhash64("rep"), F.greatest("blocks", F.lit(1)))
        each = placed.where("blocks > 0").select("rep", "size", "unit", "ring", at.alias("block")).join(small(sides, 48), "block")
        out = out.unionByName(each.groupBy("task").applyInArrow(_ring_links(threshold, theta, step, pivots.shape[1]), _LINKS))
    return out


def embedding_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors link at a cosine of the threshold or more, in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and so do
    vectors of different lengths with each other. Vectors equal bit by bit are one class,
    compared once and counted as many. trees are grown, or as many as cuts from root
    to leaf if that is more. Ids are taken to be unique; other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    held = F.col(vector_col).cast("array<float>" if single else "array<double>")
    unit = materialize(vectors.select(F.col(id_col).alias("vec_id"), held.alias("v")).mapInArrow(_usable, "vec_id long, dim int, unit binary"), "unit")
    usable = unit.where("unit is not null")
    classes = materialize(usable.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("dim").alias("dim")), "classes")
    edges = counts = None
    theta = float(_angle(np.float64(threshold)))
    step = max(theta, 1e-3) / RINGS
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):
        own = classes.where(F.col("dim") == dim)
        depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        top = min(depth, MOST_CUTS)
        drawn = min(SAMPLE, 128 << top)
        sample = own.where(F.pmod(F.xxhash64("unit"), F.lit(n)) < drawn).select("unit").toArrow()
        points = _stack(sample.column("unit"), dim)
        grown = [Tree(points, top, depth, 7919 * t + 1) for t in range(max(trees, depth))]
        forest = spark.sparkContext.broadcast(grown)
        vectors_ = own.select("rep", "size", "unit").repartition(spread(n, 4096))
        pivots = _pivots(vectors_, spark.sparkContext.broadcast(grown[:1]), threshold, theta, dim) if depth else []
        if len(pivots):
            vectors_ = materialize(vectors_.mapInArrow(_ringed(spark.sparkContext.broadcast(pivots), REACH * theta, step, dim), "rep long, size long, unit binary, ball int, ring int"), "ringed")
            balls = _ball_links(vectors_.where("ball >= 0"), pivots, threshold, theta, step, max(BLOCK, BLOCK_CELLS // dim))
            balls = materialize(balls, "balls")
            counts = balls if counts is None else counts.unionByName(balls)
        routed = vectors_.select("rep", "size", "unit", (F.col("ball") >= 0 if len(pivots) else F.lit(False)).alias("dense"))
        if depth > top:
            routed = materialize(routed.join(_deeper(vectors_, grown, forest, dim, depth), "rep"), "routed")
        else:
            routed = routed.mapInArrow(_router(forest, dim), "rep long, size long, unit binary, dense boolean, leaves array<long>")
        found = routed.withColumn("leaf", F.explode("leaves")).groupBy("leaf").applyInArrow(_leaf_links(threshold, dim), _LINKS)
        found = materialize(found, "found")
        counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        return unit.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    edges = counts.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    parts = connected_components(edges).withColumnRenamed("node", "rep")
    links = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = classes.join(links, "rep", "left").join(parts, "rep", "left")
    classes = materialize(
        classes.select("unit", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")).where("n_links > 0"), "linked"
    )
    out = unit.join(small(classes, 700), "unit", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


#: All pairs, which SQL can afford on a small table only.
ORACLE = """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
    reach(vec_id, other) AS (
        SELECT DISTINCT a, a FROM links UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
    least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(least.component_id, e.vec_id) AS component_id,
           coalesce(least.component_id, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN n ON e.vec_id = n.vec_id LEFT JOIN least ON e.vec_id = least.vec_id"""

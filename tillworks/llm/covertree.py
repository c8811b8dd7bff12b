"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors of one label are compared by cosine; on unit vectors cosine >= c is distance <= sqrt(2 - 2c).  Equal vectors are
folded into one with a weight first.  The top of the tree is a set of pivots, ``PIVOTS`` at most over all labels; every
vector belongs to the cell of its nearest pivot, and a cell larger than ``BLOCK`` is cut by hash into blocks; labels of one
block need no pivots.  A vector goes to a partner cell only if it lies within the cell's covering radius and the
threshold, so cells that are far apart never meet.  For each pair of blocks a task builds the lower levels (nested centres with halving radii, each node with its covering radius)
and descends both trees at once, dropping node pairs whose distance exceeds the sum of their radii and the threshold.

Links are counted in the task, and only a spanning forest of them leaves it, so a dense group of g vectors costs g rows, not
g squared.  Components come from the distributed edge list.

Cases: vectors that are NULL, empty, zero or hold NULL or non-finite parts, and those without label, link with nothing; vectors
of different lengths do not compare; rows that repeat an id, and those with NULL id, are vectors of their own, and a NULL id
names a component only where there is no other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import bounded_batches, staged
from tillworks.llm.components import components, forest, smallest_keys

COSINE = 0.98
PIVOTS = 2_048
BLOCK = 2_048
SLACK = 1e-7  # on distances: pruning must never lose a pair to rounding
LEVELS = 12
DENSE = 16


class CoverTree:
    """Levels of centres over unit vectors: radius 2 at the top, halved at each level, centres of a level stay centres
    below.  The last level holds every vector.  A node's covering radius is the distance of its farthest descendant."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        self.x = x
        n = len(x)
        centres = np.zeros(min(n, 1), np.int64)
        self.nodes, self.children, self.radii = [centres], [], []
        near, how_far = np.zeros(n, np.int64), self._distance(x, x[centres]).ravel() if n else np.zeros(0)
        belongs = [near]
        for level in range(1, levels):
            radius = 2.0 ** (1 - level)
            centres, near, how_far = self._refine(centres, near, how_far, radius)
            self.nodes.append(centres)
            belongs.append(near)
            if len(centres) == n:
                break
        if len(self.nodes[-1]) < n:
            self.nodes.append(np.arange(n))
            belongs.append(np.arange(n))
        for level, centres in enumerate(self.nodes):
            # a parent is the centre that the node's own vector belongs to one level up
            if level:
                parent = belongs_up[centres]
                order = np.argsort(parent, kind="stable")
                counts = np.bincount(parent, minlength=len(self.nodes[level - 1]))
                self.children.append((order, np.concatenate([[0], np.cumsum(counts)])))
            belongs_up = belongs[level]
        self._cover()

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))

    def _refine(self, centres, near, how_far, radius):
        """Add centres until every vector is within ``radius`` of one: greedily, a chunk of uncovered vectors at a time."""
        centres, near, how_far = list(centres), near.copy(), how_far.copy()
        open_ = np.flatnonzero(how_far > radius)
        while len(open_):
            chunk = open_[:256]
            among = self._distance(self.x[chunk], self.x[chunk])
            chosen, covered = [], np.zeros(len(chunk), bool)
            for i in range(len(chunk)):
                if not covered[i]:
                    chosen.append(i)
                    covered |= among[i] <= radius
            new = chunk[chosen]
            far = self._distance(self.x, self.x[new])
            best = far.argmin(axis=1)
            closer = far[np.arange(len(best)), best] < how_far
            closer[new] = True
            near[closer] = len(centres) + best[closer]
            near[new] = len(centres) + np.arange(len(new))
            how_far = np.where(closer, far[np.arange(len(best)), best], how_far)
            how_far[new] = 0
            centres.extend(new.tolist())
            open_ = np.flatnonzero(how_far > radius)
        return np.array(centres), near, how_far

    def _cover(self) -> None:
        """Covering radii from the leaves up: the farthest descendant, measured."""
        owner = np.arange(len(self.nodes[-1]))  # node of the level that each vector descends from
        vector = self.nodes[-1]
        self.radii = [np.zeros(len(self.nodes[-1]))]
        for level in range(len(self.nodes) - 2, -1, -1):
            order, first = self.children[level]
            parent = np.empty(len(order), np.int64)
            parent[order] = np.repeat(np.arange(len(first) - 1), np.diff(first))
            owner = parent[owner]
            gap = self.x[vector] - self.x[self.nodes[level][owner]]
            radii = np.zeros(len(self.nodes[level]))
            np.maximum.at(radii, owner, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            self.radii.insert(0, radii)


def _expand(tree: CoverTree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``nodes``, child) for the children of nodes of a level; the last level stays."""
    if level >= len(tree.children):
        return np.arange(len(nodes)), nodes
    order, first = tree.children[level]
    counts = first[nodes + 1] - first[nodes]
    ends = np.cumsum(counts)
    at = np.repeat(first[nodes] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    return np.repeat(np.arange(len(nodes)), counts), order[at]


def dual_pairs(a: CoverTree, b: CoverTree, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) with cosine of at least the threshold; i < j if both trees are the same."""
    reach = math.sqrt(max(2 - 2 * cosine, 0)) + SLACK
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    deepest = max(len(a.nodes), len(b.nodes))
    for level in range(deepest):
        la, lb = min(level, len(a.nodes) - 1), min(level, len(b.nodes) - 1)
        if level:
            one = u == v
            keep, child = _expand(a, level - 1, u)
            u, v, one = child, v[keep], one[keep]
            keep, child = _expand(b, level - 1, v)
            u, v, one = u[keep], child, one[keep]
            if same:  # children of one node meet each other twice
                once = ~one | (u <= v)
                u, v = u[once], v[once]
        xa, xb = a.x[a.nodes[la]], b.x[b.nodes[lb]]
        # where most nodes of a level meet, all of them in one product cost less than pair by pair
        dots = xa @ xb.T if len(u) * DENSE >= len(xa) * len(xb) else None
        alive = []
        for at in range(0, len(u), 1 << 18):
            p, q = u[at:at + (1 << 18)], v[at:at + (1 << 18)]
            dot = np.einsum("ij,ij->i", xa[p], xb[q]) if dots is None else dots[p, q]
            alive.append(np.sqrt(np.maximum(2 - 2 * dot, 0)) <= a.radii[la][p] + b.radii[lb][q] + reach)
        alive = np.concatenate(alive) if alive else np.zeros(0, bool)
        u, v = u[alive], v[alive]
    i, j = a.nodes[-1][u], b.nodes[-1][v]
    if same:
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
    hit = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= cosine
    return i[hit], j[hit]


def usable(vectors: DataFrame, vector: str, label: str):
    """Condition: the row can link at all."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


def _unit(values: pd.Series | list) -> np.ndarray:
    """Rows of double precision and length 1; scaled by the largest part first, so squares neither over- nor underflow."""
    x = np.array(list(values), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _choose_pivots(classes: DataFrame, groups: DataFrame, most: int, block: int) -> pd.DataFrame:
    """(grp, id, vector) of at most twice ``most`` pivots, in hash order: the largest of the groups that need several blocks
    get them, at least one each."""
    large = groups.where(F.col("n") > block).orderBy(F.col("n").desc(), "grp").limit(most)
    total = large.agg(F.sum("n")).first()[0] or 0
    share = F.greatest(F.lit(1), F.ceil(F.col("n") / max(block, -(-total // most)))) / F.col("n")
    marked = classes.drop("n", "key").join(F.broadcast(large), "grp")  # ``most`` rows at most
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    first = marked.groupBy("grp").agg(F.min(F.struct(lot.alias("lot"), "id", "vector")).alias("one")).select(
        "grp", "one.id", "one.vector")
    drawn = marked.where(lot < share).orderBy(lot).limit(most).select("grp", "id", "vector")
    return first.unionByName(drawn).distinct().toPandas()


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
          cosine: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes: id, key, weight, grp, vector, n; counts: id, n_linked; edges: u, v) where a class is a set of
    equal vectors of one label under a number of its own, ``key`` its smallest key, ``n`` the classes of its label, ``n_linked`` the vectors of other
    classes that it links with, and the edges connect what the links connect."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where(usable(vectors, vector, label)).select(
        F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector"),
        F.concat_ws(":", F.col(label).cast("string"), F.size(vector)).alias("grp"))
    # numbered once, as it is written: keys may be NULL or come with several vectors
    found = staged(rows.groupBy("grp", "vector").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight")).withColumn(
        "id", F.monotonically_increasing_id()), "cover-found")
    groups = staged(found.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "cover-groups")
    classes = staged(found.join(groups, "grp"), "cover-classes")
    held = {g: _unit(f["vector"]) for g, f in _choose_pivots(classes, groups, pivots, block).groupby("grp")}
    shared = spark.sparkContext.broadcast(held)  # bounded: see _choose_pivots

    def assign(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            frame = batch.to_pandas()
            cell, far = np.full(len(frame), -1, np.int32), np.zeros(len(frame))
            for g, at in frame.groupby("grp").indices.items():
                if g in shared.value:
                    d = CoverTree._distance(_unit(frame["vector"].iloc[at]), shared.value[g])
                    cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            frame["cell"], frame["far"] = cell, far
            yield pa.RecordBatch.from_pandas(frame[["grp", "vector", "id", "weight", "n", "cell", "far"]],
                                             preserve_index=False)

    placed = staged(classes.drop("key").mapInArrow(
        assign, "grp string, vector array<double>, id bigint, weight bigint, n bigint, cell int, far double"), "cover-cells")
    # one row per pivot
    cells = placed.where("cell >= 0").groupBy("grp", "cell").agg(
        F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
    reach = math.sqrt(max(2 - 2 * cosine, 0)) + SLACK
    cover = {}
    for g, f in cells.groupby("grp"):
        f = f.set_index("cell").reindex(range(len(held[g])))
        cover[g] = f["radius"].fillna(-10.0).to_numpy(), np.ceil(f["n"].fillna(0).to_numpy() / block).astype(int)
    radii = spark.sparkContext.broadcast(cover)

    def partners(vectors, cell, n, g):
        """(first block of each cell, reachable cells of each vector, own cell); a group without pivots is one cell."""
        if g not in radii.value:
            return np.array([0, -(-int(n[0]) // block)]), np.ones((len(n), 1), bool), np.zeros(len(n), np.int64)
        radius, n_blocks = radii.value[g]
        near = CoverTree._distance(_unit(vectors), shared.value[g]) <= radius[None, :] + reach
        near[np.arange(len(n)), cell] = True
        return np.concatenate([[0], np.cumsum(n_blocks)]), near, cell

    def deal(batches: Iterator[pa.RecordBatch]):
        """Each vector to the pairs of blocks in which it can have a partner."""
        for batch in batches:
            frame = batch.to_pandas()
            ids, cells_of, n = (frame[c].to_numpy() for c in ("id", "cell", "n"))
            out = {"row": [], "lo": [], "hi": [], "mine": []}
            for g, at in frame.groupby("grp").indices.items():
                first, near, own = partners(frame["vector"].iloc[at], cells_of[at], n[at], g)
                width = np.maximum(first[own + 1] - first[own], 1)
                block_no = first[own] + ids[at] * 2654435761 % (1 << 32) % width
                for c in range(near.shape[1]):
                    who = np.flatnonzero(near[:, c])
                    for other in range(first[c], first[c + 1]):
                        out["row"].append(at[who])
                        out["lo"].append(np.minimum(block_no[who], other))
                        out["hi"].append(np.maximum(block_no[who], other))
                        out["mine"].append(block_no[who])
            if not out["row"]:
                continue
            row, lo, hi, mine = (np.concatenate(out[c]).astype(np.int64) for c in ("row", "lo", "hi", "mine"))
            for a in range(0, len(row), 10_000):
                some = slice(a, a + 10_000)
                dealt = frame[["grp", "vector", "id", "weight"]].iloc[row[some]].reset_index(drop=True)
                yield pa.RecordBatch.from_pandas(dealt.assign(lo=lo[some], hi=hi[some], mine=mine[some]),
                                                 preserve_index=False)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        ids, weight = frame["id"].to_numpy(), frame["weight"].to_numpy()
        same = frame["lo"].iloc[0] == frame["hi"].iloc[0]
        left = np.flatnonzero(frame["mine"] == frame["lo"])
        right = np.flatnonzero(frame["mine"] == frame["hi"])
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
        x = _unit(frame["vector"])
        tree = CoverTree(x[left])
        i, j = dual_pairs(tree, tree if same else CoverTree(x[right]), cosine, same)
        i, j = left[i], right[j]
        n = (np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))).astype(np.int64)
        some = np.flatnonzero(n)
        a, b = forest(len(ids), i, j)
        return pd.DataFrame({"u": np.concatenate([ids[some], ids[a]]),
                             "v": np.concatenate([np.full(len(some), -1), ids[b]]),
                             "n": np.concatenate([n[some], np.full(len(a), -1)])})

    dealt = placed.mapInArrow(
        deal, "grp string, vector array<double>, id bigint, weight bigint, lo bigint, hi bigint, mine bigint")
    linked = staged(dealt.groupBy("grp", "lo", "hi").applyInPandas(compare, "u bigint, v bigint, n bigint"), "cover-links")
    counts = linked.where("n >= 0").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n_linked"))
    return classes, counts, linked.where("n < 0").select("u", "v")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id (smallest key reachable by links), kept (this is the row's
    key)."""
    classes, counts, edges = links(vectors, key, vector, label, cosine, pivots, block)
    groups = smallest_keys(components(edges), classes, "id", "key", "least")
    known = staged(classes.join(counts, "id", "left").join(groups, "id", "left").select(
        "grp", "vector", F.col("weight") - 1 + F.coalesce("n_linked", F.lit(0)), F.coalesce("least", "key")).toDF(
        "_grp", "_vector", "n_links", "component_id"), "cover-result")
    able = usable(vectors, vector, label)
    rows = vectors.where(able).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"),
                                      F.concat_ws(":", F.col(label).cast("string"), F.size(vector)).alias("grp"))
    joined = rows.join(known, (F.col("grp") == F.col("_grp")) & (F.col("vector") == F.col("_vector")), "left").select(
        "key", "n_links", "component_id")
    # vectors that link with nothing take no part in the join, where their NULL keys would meet in one task
    none = F.lit(None).cast("bigint")
    joined = joined.unionByName(vectors.where(~able).select(
        F.col(key).alias("key"), none.alias("n_links"), none.alias("component_id")))
    component = F.coalesce("component_id", F.col("key").cast("bigint"))
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))

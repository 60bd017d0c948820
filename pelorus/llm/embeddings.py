"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated to principal axes (of a bounded sample), the axes are
dealt to low-dimensional blocks, and the squared distance that the cosine
threshold allows is shared among the blocks in proportion to their variance: a
linked pair stays within the share of at least one block.  Each block is
range-joined on its own in k-d cells, where points are at home and to which they
come as probes wherever their ball reaches and the cell is numbered after their
own; within a cell, tiles that a ball doesn't reach are passed over.  Candidates
are verified exactly, and a pair counts in the first block that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import Scratch, components, id_hash, join_counted, lean, local_roots, pick

#: The rotation and the cells are fitted on at most so many vectors, those of the least hash of their id.
SAMPLE = 4096
#: Rows that a cell holds at home, and about as many probes as meet them in one task.
HOMES, PROBES = 32_768, 65_536
#: Rows of a tile within a task.
TILE = 256


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows as doubles, scaled by powers of two so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


@dataclass
class Cell:
    """A box of a block's k-d tree; a leaf has no halves, and is salted into
    ``parts`` numbered from ``first``, to each of which ``chunks`` lots of probes
    come, in groups numbered from ``key``."""

    low: np.ndarray
    high: np.ndarray
    halves: list[Cell]
    first: int = 0
    parts: int = 1
    chunks: int = 1
    key: int = 0

    def leaves(self) -> Iterator[Cell]:
        if not self.halves:
            yield self
        for half in self.halves:
            yield from half.leaves()

    def reached(self, p: np.ndarray, rows: np.ndarray, budget: float) -> Iterator[tuple[Cell, np.ndarray]]:
        """Leaves, and which of the rows (points ``p``) have a ball that reaches them."""
        gap = np.maximum(np.maximum(self.low - p[rows], p[rows] - self.high), 0)
        rows = rows[np.einsum("nk,nk->n", gap, gap) <= budget * (1 + 1e-6) + 1e-9]
        if not len(rows):
            return
        if not self.halves:
            yield self, rows
        for half in self.halves:
            yield from half.reached(p, rows, budget)


@dataclass
class Plan:
    """Rotation, blocks of axes, squared budgets, and a tree of cells for each block."""

    turn: np.ndarray
    blocks: list[np.ndarray]
    budget: np.ndarray
    trees: list[Cell]

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("nd,dk->nk", unit(x), self.turn)


def _grow(points: np.ndarray, low: np.ndarray, high: np.ndarray, share: float, homes: int, depth: int = 24) -> Cell:
    """A tree whose leaves have about ``homes`` rows, ``share`` rows for each sampled point."""
    d = int(np.argmax(points.var(0))) if len(points) else 0
    cut = float(np.median(points[:, d])) if len(points) else 0.0
    left = points[:, d] < cut
    if len(points) * share <= homes or len(points) < 8 or not depth or not left.any():
        return Cell(low, high, [], parts=max(1, round(len(points) * share / homes)))
    right_of, left_of = low.copy(), high.copy()
    right_of[d] = left_of[d] = cut
    return Cell(low, high, [_grow(points[left], low, left_of, share, homes, depth - 1), _grow(points[~left], right_of, high, share, homes, depth - 1)])


def make_plan(sample: np.ndarray, rows: int, threshold: float, n_blocks: int, homes: int, probes: int) -> Plan:
    u = unit(scaled(sample))
    dim = u.shape[1]
    value, axes = np.linalg.eigh(np.cov(u.T).reshape(dim, dim) if len(u) > 1 else np.eye(dim))
    turn = np.ascontiguousarray(axes[:, ::-1])
    value = np.maximum(value[::-1], 1e-12)
    m = min(n_blocks, dim)
    blocks = [np.arange(b, dim, m) for b in range(m)]
    share = np.array([value[b].sum() for b in blocks])
    allowed = 2 - 2 * threshold
    budget = (allowed * (1 + 1e-9) + 1e-9) * share / share.sum()
    z = u @ turn
    trees, key = [], 0
    for axis, most in zip(blocks, budget):
        p, each = np.ascontiguousarray(z[:, axis]), rows / len(z)
        tree = _grow(p, np.full(len(axis), -np.inf), np.full(len(axis), np.inf), each, homes)
        come = {id(leaf): len(at) * each for leaf, at in tree.reached(p, np.arange(len(p)), most)}
        first = 0
        for leaf in tree.leaves():
            leaf.first, leaf.key, leaf.chunks = first, key, max(1, -(-int(come.get(id(leaf), 0)) // probes))
            first, key = first + leaf.parts, key + leaf.parts * leaf.chunks
        trees.append(tree)
    return Plan(turn, blocks, budget, trees)


def route(plan: Plan, x: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Group numbers, whether its rows are at home there, and the rows' places.  A
    row probes only parts that are numbered after its own: of two rows that are
    near each other, one comes to the other."""
    z = plan.coordinates(x)
    salt = np.array([xxhash.xxh3_64_intdigest(str(n).encode()) for n in nodes.tolist()], np.uint64)
    every = np.arange(len(x))
    for axis, budget, tree in zip(plan.blocks, plan.budget, plan.trees):
        p = np.ascontiguousarray(z[:, axis])
        reached = list(tree.reached(p, every, budget))
        home = np.full(len(x), -1)
        for leaf, at in reached:
            own = at[((p[at] >= leaf.low) & (p[at] < leaf.high)).all(1)]
            home[own] = leaf.first + (salt[own] % np.uint64(leaf.parts)).astype(np.int64)
        for leaf, at in reached:
            lot = ((salt[at] >> np.uint64(20)) % np.uint64(leaf.chunks)).astype(np.int64)
            for part in range(leaf.parts):
                own, come = at[home[at] == leaf.first + part], home[at] < leaf.first + part
                for c in range(leaf.chunks):
                    yield leaf.key + part * leaf.chunks + c, True, own
                    yield leaf.key + part * leaf.chunks + c, False, at[come & (lot == c)]


def group_of(plan: Plan, key: int) -> tuple[int, int]:
    """Block and lot of a group."""
    for block, tree in enumerate(plan.trees):
        for leaf in tree.leaves():
            if key < leaf.key + leaf.parts * leaf.chunks:
                return block, (key - leaf.key) % leaf.chunks
    raise ValueError("no such group")


def tiles(p: np.ndarray, rows: np.ndarray, size: int = TILE) -> Iterator[np.ndarray]:
    """Rows in halves along their widest axis, down to tiles."""
    if len(rows) <= size:
        yield rows
        return
    own = p[rows]
    order = rows[np.argsort(own[:, int(np.argmax(own.max(0) - own.min(0)))], kind="stable")]
    yield from tiles(p, order[: len(order) // 2], size)
    yield from tiles(p, order[len(order) // 2 :], size)


def match(plan: Plan, block: int, x: np.ndarray, homes: int, among: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places among ``x``, of which the first ``homes`` are at home and meet
    each other (if ``among``) and all others, in portions: pairs whose first block
    within its budget is this one."""
    z = plan.coordinates(x)
    norm = np.sqrt(np.einsum("nd,nd->n", x, x))
    p = np.ascontiguousarray(z[:, plan.blocks[block]]).astype(np.float32)
    runs = list(tiles(p, np.arange(homes)))
    order = np.concatenate([*runs, np.arange(homes, len(x))])
    p = p[order]
    square = np.einsum("nk,nk->n", p, p)
    ones = np.ones(len(p), np.float32)
    left, right = np.column_stack([-2 * p, square, ones]), np.column_stack([p, ones, square])
    limit = np.float32(plan.budget[block] + 1e-5)
    at = 0
    for run in runs:
        end = at + len(run)
        low, high = p[at:end].min(0), p[at:end].max(0)
        start = at if among else homes
        gap = np.maximum(np.maximum(low - p[start:], p[start:] - high), 0)
        others = start + np.flatnonzero(np.einsum("nk,nk->n", gap, gap) <= limit)
        for lo in range(0, len(others), 65_536):
            own = others[lo : lo + 65_536]
            near = np.flatnonzero(right[own] @ left[at:end].T <= limit)
            j, i = own[near // len(run)], at + near % len(run)
            i, j = i[j > i], j[j > i]
            for k in range(0, len(i), 200_000):
                a, b = order[i[k : k + 200_000]], order[j[k : k + 200_000]]
                good = np.einsum("nd,nd->n", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
                a, b = a[good], b[good]
                if not len(a):
                    continue
                apart = (z[a] - z[b]) ** 2
                within = np.stack([apart[:, axis].sum(1) <= most for axis, most in zip(plan.blocks, plan.budget)], 1)
                first = within.argmax(1) == block
                yield a[first], b[first]
        at = end


def _join_groups(plan: Plan, dim: int, kind: np.dtype, threshold: float, schema: T.StructType):
    def group(key: tuple, table: pa.Table) -> pa.Table:
        block, lot = group_of(plan, key[0].as_py())
        at_home = table["home"].to_numpy()
        order = np.concatenate([np.flatnonzero(at_home), np.flatnonzero(~at_home)])
        table = table.take(pa.array(order))
        x = scaled(np.frombuffer(b"".join(table["raw"].to_pylist()), kind).reshape(-1, dim))
        copies, ids = table["copies"].to_numpy(), table["node"].to_numpy()
        names, local = np.unique(ids, return_inverse=True)
        links = np.zeros(len(names), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        homes = int(at_home.sum())
        for i, j in match(plan, block, x, homes, lot == 0, threshold) if homes else ():
            other = local[i] != local[j]
            i, j = i[other], j[other]
            np.add.at(links, local[i], copies[j])
            np.add.at(links, local[j], copies[i])
            # a few pairs at a time come down to a tree
            root = local_roots(local[i], local[j], len(names))
            moved = np.flatnonzero(root != np.arange(len(names)))
            ends.append((moved, root[moved]))
        root = local_roots(*(np.concatenate(e) for e in zip(*ends)), len(names)) if ends else np.arange(len(names))
        moved, own = np.flatnonzero(root != np.arange(len(names))), np.flatnonzero(links)
        node, to = np.concatenate([names[own], names[moved]]), np.concatenate([names[own], names[root[moved]]])
        return pa.table({"node": pa.array(node), "to": pa.array(to), "n": pa.array(np.concatenate([links[own], np.zeros(len(moved), np.int64)]))})

    return group


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, n_blocks: int = 8, homes: int = HOMES, probes: int = PROBES) -> DataFrame:
    """Links of cosine ``threshold`` or more, in double precision.

    One row per row of ``df``: ``id_col``, ``n_links`` (other rows linked
    directly), ``component_id`` (the smallest id reachable) and ``kept`` (the id
    is its component's).  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different length don't
    link; equal vectors are collapsed first and count as links of each other;
    rows of one id are one node, and the links of its vectors add up; a null id has component null; an empty table
    gives an empty table.  On vectors without low-dimensional structure a ball
    reaches most of a few cells, fewer of many; no task holds more than about
    ``homes`` rows and ``probes`` probes, and homes are copied only where more
    probes than that come, as the sample tells.
    """
    spark, s = df.sparkSession, Scratch(df.sparkSession)
    rows = pick(df, node=id_col, v=vector_col)
    kind = np.dtype(np.float32 if rows.schema["v"].dataType.elementType == T.FloatType() else np.float64)
    rows = rows.withColumn("v", F.col("v").cast("array<float>" if kind == np.float32 else "array<double>"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    id_type = rows.schema["node"].dataType
    packed_schema = T.StructType([T.StructField("node", id_type), T.StructField("dim", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("raw", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            at, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no negative zeros
            raw = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(at).astype(np.int32)), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["node", "dim", "digest", "raw"])

    packed = s.save(rows.where(fine & F.col("node").isNotNull()).mapInArrow(lean(pack), packed_schema))
    classes = s.save(packed.groupBy("dim", "digest").agg(F.min("node").alias("rep"), F.count("*").alias("copies")))
    members = packed.select("node", "dim", "digest").join(classes, ["dim", "digest"]).select("node", "rep", "copies")
    reps = packed.join(classes.withColumnRenamed("rep", "node"), ["dim", "digest", "node"]).groupBy("dim", "node", "digest").agg(F.first("raw").alias("raw"), F.max("copies").alias("copies"))
    reps = s.save(reps)
    found = None
    for dim, n in reps.groupBy("dim").count().collect():  # a table has few vector lengths
        own = reps.where(F.col("dim") == dim)
        sample = [r[0] for r in own.orderBy(id_hash("node", "pigeonhole"), "digest").limit(SAMPLE).select("raw").collect()]
        plan = make_plan(np.frombuffer(b"".join(map(bytes, sample)), kind).reshape(-1, dim), n, threshold, n_blocks, homes, probes)
        shared = spark.sparkContext.broadcast(plan)
        routed_schema = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("home", T.BooleanType()), T.StructField("node", id_type), T.StructField("copies", T.LongType()), T.StructField("raw", T.BinaryType())])

        def send(batches: Iterator[pa.RecordBatch], dim=dim, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = scaled(np.frombuffer(b"".join(batch.column("raw").to_pylist()), kind).reshape(-1, dim))
                for key, home, at in route(shared.value, x, batch.column("node").to_numpy()):
                    if len(at):
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key, np.int32)), pa.array(np.full(len(at), home)), *part.columns], names=["key", "home", "node", "copies", "raw"])

        out_schema = T.StructType([T.StructField("node", id_type), T.StructField("to", id_type), T.StructField("n", T.LongType())])
        sent = own.select("node", "copies", "raw").mapInArrow(lean(send), routed_schema)
        one = sent.groupBy("key").applyInArrow(_join_groups(plan, dim, kind, threshold, out_schema), out_schema)
        found = one if found is None else found.union(one)
    if found is None:
        return rows.select(F.col("node").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"), F.col("node").isNotNull().alias("kept"))
    found = s.save(found)
    comps = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), s)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    facts = members.join(links.withColumnRenamed("node", "l"), F.col("rep") == F.col("l"), "left").join(comps.withColumnRenamed("node", "k"), F.col("rep") == F.col("k"), "left")
    facts = facts.select(F.col("node").alias("f"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root", "rep").alias("c"))
    facts = s.save(facts.groupBy("f").agg(F.max("n").alias("n"), F.min("c").alias("c")))
    out = join_counted(rows.select("node"), facts, F.col("node") == F.col("f"), "left")
    comp = F.coalesce("c", "node")
    return out.select(F.col("node").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("node") == comp, F.lit(False)).alias("kept"))

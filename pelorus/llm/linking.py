"""Linking by shared tokens: candidate pairs, exact verification, components.

Shared by the similarity joins.  A posting says that a node carries a token;
nodes that are similar enough share at least one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import Scratch, components, join_counted, lean, trim

#: Nodes of one token that are compared in one cell; a token with more is dealt into parts, and cells hold two parts each.
CELL = 2048
#: 64-bit words of a sketch.
WORDS = 32


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Bitmaps of sets of 64-bit hashes.  Two sets differ in at least as many
    elements as their bitmaps in bits, so that a pair ruled out is not linked."""
    bits = np.zeros((len(sets), 64 * WORDS), np.uint8)
    if sets:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bits[row, (np.concatenate(sets) >> np.uint64(20)) & np.uint64(64 * WORDS - 1)] = 1
    return [r.tobytes() for r in np.packbits(bits, axis=1)]


def _bits(sketches: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(-1, WORDS)


def most_apart(size: np.ndarray, other: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """What linked sets of these sizes share at least, and in how many elements they differ at most."""
    both = size + other
    least = -(-both * num // (num + den))
    return least, both - 2 * least


def _with_sketches(texts: DataFrame, sets_of: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """``(node, said, size, sketch)`` from ``(node, said)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = sets_of(part.column("said").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(s) for s in sets], pa.int32()), pa.array(sketches(sets), pa.binary())], names=["node", "said", "size", "sketch"])
        trim()

    return texts.mapInArrow(lean(run), T.StructType([*texts.schema, T.StructField("size", T.IntegerType()), T.StructField("sketch", T.BinaryType())]))


def _verify(pairs: DataFrame, texts: DataFrame, sets_of: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, scratch: Scratch) -> DataFrame:
    """Those pairs ``(a, b)`` whose sets are linked: pairs that their sketches rule
    out are left at that, the others compared exactly."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            least, most = most_apart(*(batch.column(c).to_numpy().astype(np.int64) for c in ("m", "n")), num, den)
            able = np.bitwise_count(_bits(batch.column("u")) ^ _bits(batch.column("v"))).sum(1, dtype=np.int64) <= most
            keep = np.zeros(batch.num_rows, bool)
            rows = np.flatnonzero(able)
            for lo in range(0, len(rows), 128):
                own = rows[lo : lo + 128]
                x, y = (batch.column(c).take(pa.array(own)).to_pylist() for c in ("x", "y"))
                once = list(dict.fromkeys(x + y))
                sets = dict(zip(once, sets_of(once)))
                keep[own] = [0 < n <= overlap(sets[a], sets[b]) for n, a, b in zip(least[own].tolist(), x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        trim()

    x = texts.select(F.col("node").alias("a"), F.col("said").alias("x"), F.col("size").alias("m"), F.col("sketch").alias("u"))
    y = texts.select(F.col("node").alias("b"), F.col("said").alias("y"), F.col("size").alias("n"), F.col("sketch").alias("v"))
    return scratch.save(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "m", "u", "y", "n", "v").mapInArrow(lean(exact), pairs.select("a", "b").schema))


def _shared(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings of the tokens that lie in several components (without ``comp``: of the
    tokens that stand more than once), saved, for tokens that are many: the join shuffles
    at any size and splits a token of very many nodes.  Only a token and what tells whether
    it stays are shuffled to find those, and each shuffle's files go before the next ones are made."""
    lone = "comp" not in postings.columns  # each node is a component yet
    if not lone:
        spread = postings.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    else:
        spread = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    spread = scratch.save(spread.select("token"))
    scratch.free()
    out = postings.join(spread, "token", "left_semi")
    out = scratch.save(out.withColumn("comp", F.col("node")) if lone else out)
    scratch.drop(spread)
    scratch.free()
    return out


def _meeting(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings ``(token, node, comp, need, pos)`` of the tokens whose nodes
    lie in several components (without ``comp``: the tokens of several nodes), saved,
    with ``lo`` and ``hi``: the token's first and last ``(comp, node)``.  The extremes are combined before the shuffle, and the
    join splits a token of very many nodes."""
    if "comp" in postings.columns:
        here = F.struct("comp", "node")
        spread = postings.groupBy("token").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where("lo.comp <> hi.comp")
    else:  # each node is a component yet
        ends = postings.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
        spread = ends.select("token", *[F.struct(F.col(k).alias("comp"), F.col(k).alias("node")).alias(n) for n, k in (("lo", "x"), ("hi", "y"))])
        postings = postings.withColumn("comp", F.col("node"))
    spread = scratch.save(spread)
    out = scratch.save(join_counted(postings, spread, "token", "inner"))
    scratch.drop(spread)
    return out


def _able(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """Those postings whose nodes have as many as they need; a node with fewer can join nothing."""
    able = scratch.save(postings.groupBy("node").agg(F.count("*").alias("n"), F.max("need").alias("m")).where("n >= m").select("node"))
    return join_counted(postings, able, "node", "left_semi")


def _stars(postings: DataFrame) -> DataFrame:
    """One pair for each node: with that node of another component which most of its
    tokens propose (each its first node, or to that one's component its last)."""
    dealt = postings.select("node", F.when(F.col("comp") != F.col("lo.comp"), F.col("lo.node")).otherwise(F.col("hi.node")).alias("p")).where("node <> p").repartition("node")  # one exchange for both groupings
    votes = dealt.groupBy("node", "p").agg(F.count("*").alias("n"))
    return votes.groupBy("node").agg(F.max(F.struct("n", "p"))["p"].alias("p")).select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b"))


def link(postings: DataFrame, read: Callable[[DataFrame], DataFrame], sets_of: Callable[[list[bytes]], list[np.ndarray]], num: int, den: int, scratch: Scratch, needs: bool = True) -> DataFrame:
    """Components ``(node, root)`` of all links among nodes that share tokens.

    ``postings`` are ``(token, node, need, pos)``, read several times (a saved table
    of them is dropped as soon as that is done): ``need`` is how many tokens a node
    shares, at least, with any node that it may be linked to (``needs`` says that
    some need more than one; else a node has few tokens), and ``pos`` the token's
    place in the node's order, from 0.  ``read`` gives the contents ``(node, said)``
    of nodes, and ``sets_of`` the sorted sets of some.

    First each node is compared with one node that it shares tokens with, so that
    groups of near copies fall together in a number of pairs linear in their size;
    then with the one that its sketch is nearest to in each token.  At last the
    pairs that lie in different components and share a token early enough in both
    orders are told apart by sketches where the token's nodes meet, and only those
    that may be linked are verified; pairs in one component already can add nothing
    to the components.
    """
    columns = ["token", "node", "comp", "need", "pos"]

    def settle(known: DataFrame) -> DataFrame:
        known = known.select(*[c for c in columns if c in known.columns])
        if not needs:
            return _meeting(known, scratch)
        met = _shared(known, scratch)
        out = _meeting(_able(met, scratch).select(*columns), scratch)
        scratch.drop(met)
        return out

    open_, edges = settle(postings), None
    if hasattr(postings, "_scratch_path"):
        scratch.drop(postings)
    scratch.free()
    texts = scratch.save(_with_sketches(read(open_.select("node").distinct()), sets_of))
    for step in ("star", "nearest", "all"):
        pairs = scratch.save(_stars(open_) if step == "star" else _cross_pairs(open_.select(*columns), texts, num, den, scratch, not needs, step == "nearest"))
        found = _verify(pairs, texts, sets_of, num, den, scratch)
        edges = found if edges is None else edges.union(found)
        comps = components(edges, scratch)
        scratch.drop(pairs)
        if step != "all":
            known = join_counted(open_, comps.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left")
            left = settle(known.withColumn("comp", F.coalesce("root", "node")))
            scratch.drop(open_)
            open_ = left
            scratch.free()
            if open_.isEmpty():
                break
    scratch.drop(texts, open_)
    return comps


def near_pairs(g: np.ndarray, part: np.ndarray, comp: np.ndarray, size: np.ndarray, pos: np.ndarray, bits: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows of one group (``g``, in order) that may be linked, and the
    bits in which they differ: rows of different components and, where parts are
    given (0 and more), of different parts, each at a place from which their sets
    can share enough, and with bitmaps that differ in no more bits than linked
    sets do in elements."""
    at = np.arange(len(g))
    for d in range(1, len(g)):
        at = at[at + d < len(g)]
        at = at[g[at] == g[at + d]]
        if not len(at):
            return
        for lo in range(0, len(at), 20_000):
            i = at[lo : lo + 20_000]
            j = i + d
            least, most = most_apart(size[i], size[j], num, den)
            ok = (comp[i] != comp[j]) & ((part[i] != part[j]) | (part[i] < 0)) & (np.minimum(size[i], size[j]) >= least)
            ok &= (pos[i] <= size[i] - least) & (pos[j] <= size[j] - least)
            i, j = i[ok], j[ok]
            apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            few = apart <= most[ok]
            if few.any():
                yield i[few], j[few], apart[few]


def _first_common(lists: np.ndarray, token: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair's token is the first that both rows' sorted lists hold."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 10_000):
        a, b = lists[i[lo : lo + 10_000]], lists[j[lo : lo + 10_000]]
        common = (a[:, :, None] == b[:, None, :]).any(2)
        out[lo : lo + 10_000] = a[np.arange(len(a)), common.argmax(1)] == token[i[lo : lo + 10_000]]
    return out


def _cross_pairs(postings: DataFrame, texts: DataFrame, num: int, den: int, scratch: Scratch, lists: bool, nearest: bool) -> DataFrame:
    """Pairs of different components that may be linked, and that have a common
    token among the first ``size - overlap + 1`` of both, ``overlap`` being what
    sets of these sizes must share; of each node and token only the nearest by
    sketch if ``nearest``.

    A token of more than CELL nodes is dealt into parts by the node's hash, and
    each two parts meet in a cell of their own: no task holds more than about two
    parts, and only near pairs leave it.  With ``lists`` the nodes' tokens, which
    must be few, come along, and a pair leaves only the first cell that has it;
    without, a node's tokens that stand too late for any partner stay at home."""
    own = texts.select("node", "size", "sketch")
    if lists:
        own = own.join(postings.groupBy("node").agg(F.sort_array(F.collect_set("token")).alias("tokens")), "node")
    hot = scratch.save(postings.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select(F.col("token").alias("t"), F.ceil(F.col("n") / CELL).cast("int").alias("parts")))
    rows = join_counted(postings, hot, F.col("token") == F.col("t"), "left")
    rows = rows.withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    # part p meets all others in the cells (p, q) and, with itself, in (p, p)
    rows = rows.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    rows = rows.select("token", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("part"), "node", "comp", "pos")
    rows = rows.join(own, "node")
    if not lists:  # the smallest partner of a set shares num / den of it
        rows = rows.where(F.col("pos").cast("long") * den <= F.col("size").cast("long") * (den - num))
    rows = rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "node", "pos")
    kind = postings.schema["node"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            token, x, y, node, size = (t[c].to_numpy() for c in ("token", "x", "y", "node", "size"))
            new = (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            again = ~new & (node[1:] == node[:-1]) & (size[1:] == size[:-1])  # lines stand in several chunks
            if again.any():
                t = t.filter(pa.array(np.concatenate([[True], ~again])))
                token, x, y = (t[c].to_numpy() for c in ("token", "x", "y"))
                new = (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            part, size, pos = (t[c].to_numpy().astype(np.int64) for c in ("part", "size", "pos"))
            comp = np.unique(t["comp"].to_numpy(), return_inverse=True)[1]
            if lists:
                own = t["tokens"].combine_chunks()
                many = np.diff(own.offsets.to_numpy())
                table = np.broadcast_to(np.arange(len(many))[:, None], (len(many), many.max())).astype(np.int64)  # no two rows' fillings are alike
                table[np.arange(many.max()) < many[:, None]] = own.flatten().to_numpy()
            nodes = t["node"].combine_chunks()
            best = [np.full(t.num_rows, 1 << 40), np.full(t.num_rows, -1)]
            for i, j, apart in near_pairs(np.cumsum(np.concatenate([[0], new])), part, comp, size, pos, _bits(t["sketch"]), num, den):
                if nearest:  # the offset is one, so that i are different, and j are
                    for one, other in ((i, j), (j, i)):
                        nearer = apart < best[0][one]
                        best[0][one[nearer]], best[1][one[nearer]] = apart[nearer], other[nearer]
                    continue
                if lists:
                    first = _first_common(table, token, i, j)
                    i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), nodes.take(pa.array(j))], names=["p", "q"])
            if nearest:
                i = np.flatnonzero(best[1] >= 0)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(i)), nodes.take(pa.array(best[1][i]))], names=["p", "q"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 20_000:
                continue
            token, x, y = (held[c].to_numpy() for c in ("token", "x", "y"))
            last = np.flatnonzero((token != token[-1]) | (x != x[-1]) | (y != y[-1]))
            if len(last):  # the last group may go on
                yield from compare(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield from compare(held)
        trim()

    near = rows.mapInArrow(lean(run), T.StructType([T.StructField("p", kind), T.StructField("q", kind)]))
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct()

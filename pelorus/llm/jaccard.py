"""N-gram Jaccard join: size-aware, heavy and light.

Small sets enumerate their subsets of the sizes that a partner must share;
large sets are found through inverted lists.  Where small ends is chosen by
cost.  Lists are scanned only for a set's first tokens in a global order, light
tokens before heavy ones, as many as a partner cannot miss (prefix filter), so
that common passages make no candidates.  Every candidate is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import BATCH_BYTES, Scratch, chunks, components, join_counted, lean, pick, text_bytes
from pelorus.llm.linking import link

#: Small sets are never larger than this, whatever the costs.
MOST_SMALL = 24
#: Tokens of at least so many documents, of those that a chunk has twice, may be ordered last; so many of them, the heaviest, are.  The order changes costs, never results.
HEAVY_DOCS, HEAVY_TOKENS = 4, 1 << 19
_U = np.uint64
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class _WordHash(dict):
    """64-bit hashes of words, forgotten when ``limit`` are held."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], n: int, words: _WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles; A-Z count as a-z, words end at ASCII white space."""
    out = []
    for raw in texts:
        own = raw.lower().split()
        if not own:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
        k = min(n, len(own))
        acc = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            acc = acc * _ODD[0] + h[j : len(h) - k + 1 + j]
        out.append(np.unique(_mix(acc + _U(k))))
    return out


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def subset_tokens(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the subsets, of every size from the least overlap that a partner needs."""
    each = _mix(s ^ _ODD[1])
    total, n, out = int(each.sum(dtype=np.uint64)), len(s), []
    values = each.tolist()
    for gone in range(n - _ceil(num * n, den) + 1):
        out += [((total - sum(x)) + (n - gone) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for x in combinations(values, gone)]
    return _mix(np.array(out, np.uint64) ^ _ODD[2])


def subset_count(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, gone) for gone in range(n - _ceil(num * n, den) + 1))


def prefix_size(n: int, num: int, den: int) -> int:
    return n - _ceil(num * n, den) + 1


def shared_need(n: int) -> int:
    """How many tokens two linked sets are made to share: prefixes are longer by one less."""
    return 1 if n <= 32 else 1 + n // 16


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """The size up to which enumerating subsets costs no more than scanning lists
    of ``list_length`` for a set's prefix, counted over all sets of each size."""
    best, gain, at = 0, 0.0, 0.0
    for n in range(1, MOST_SMALL + 1):
        at += sizes.get(n, 0) * (prefix_size(n, num, den) * (1 + list_length) - subset_count(n, num, den))
        if at >= gain:
            best, gain = n, at
    return best


def _i64(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


class Join:
    """The join of one table; ``n`` words a shingle, links at ``den * overlap >= num * union``."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den
        self.scratch = Scratch(df.sparkSession)
        self.docs = pick(df, node=id_col, text=text_col).select("node", F.xxhash64("text").alias("h"), text_bytes().alias("text"))  # rows are told by id and text
        self.kind = self.docs.schema["node"].dataType
        self.spark = df.sparkSession

    def _survey(self) -> DataFrame:
        """For each row (part 0) its set's size and digest; for each chunk (part 1) the shingles of several of its distinct sets, with counts."""
        n = self.n
        fields = [T.StructField("part", T.IntegerType()), T.StructField("node", self.kind), T.StructField("h", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _WordHash()
            for rows in chunks(batches, BATCH_BYTES):  # one list for a batch, as tokens are counted in each
                sets = shingle_sets([r[2] for r in rows], n, words)
                digests = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
                one = list({d: s for d, s in zip(digests, sets) if d}.values())
                tokens, count = np.unique(np.concatenate(one), return_counts=True) if one else (np.zeros(0, np.uint64), np.zeros(0, int))
                often = count > 1
                k = len(rows)
                cols = [
                    pa.array([0] * k + [1], pa.int32()),
                    pa.concat_arrays([a := pa.array([r[0] for r in rows]), pa.nulls(1, a.type)]),
                    pa.array([r[1] for r in rows] + [None], pa.int64()),
                    pa.array([len(s) for s in sets] + [None], pa.int32()),
                    pa.array(digests + [None], pa.binary()),
                    pa.array([None] * k + [tokens[often].view(np.int64)], pa.list_(pa.int64())),
                    pa.array([None] * k + [count[often].astype(np.int32)], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

        return self.docs.mapInArrow(lean(run), T.StructType(fields))

    def _heavy(self, survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Heavy tokens, sorted, and their counts."""
        pairs = survey.where("part = 1").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select("x.tokens", "x.counts")
        top = pairs.groupBy("tokens").agg(F.sum("counts").alias("c")).where(F.col("c") >= HEAVY_DOCS).orderBy(F.desc("c"), "tokens").limit(HEAVY_TOKENS)
        got = top.toArrow()
        tokens = got["tokens"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        return tokens[order], got["c"].to_numpy().astype(np.int64)[order]

    def _postings(self, docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], small: int) -> DataFrame:
        n, num, den = self.n, self.num, self.den
        shared = self.spark.sparkContext.broadcast(heavy)  # at most HEAVY_TOKENS
        fields = [T.StructField("token", T.LongType()), T.StructField("node", self.kind), T.StructField("need", T.IntegerType()), T.StructField("pos", T.IntegerType())]

        def prefix(s: np.ndarray) -> np.ndarray:
            tokens, count = shared.value
            p = prefix_size(len(s), num, den) + shared_need(len(s)) - 1
            if not len(tokens):
                return s[:p]
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            level = np.where(tokens[at] == s, count[at], 0)
            return s[np.argsort(level, kind="stable")[:p]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _WordHash()
            for rows in chunks(batches, 2_000_000):
                sets = shingle_sets([r[2] for r in rows], n, words)
                own, places = [], [np.zeros(0, np.int32)]
                for s in sets:
                    got = [np.zeros(0, np.uint64)]
                    if 0 < len(s) <= small:
                        got.append(subset_tokens(s, num, den))
                        places.append(np.zeros(len(got[-1]), np.int32))
                    if len(s) > small or (len(s) and len(s) * den >= (small + 1) * num):
                        got.append(prefix(s))
                        places.append(np.arange(len(got[-1]), dtype=np.int32))
                    own.append(np.concatenate(got))
                many = [len(x) for x in own]
                ids = pa.array([r[0] for r in rows]).take(pa.array(np.repeat(np.arange(len(rows)), many)))
                needs = np.array([shared_need(_ceil(num * len(s), den)) for s in sets], np.int32)  # of the smallest partner
                yield pa.RecordBatch.from_arrays([_i64(np.concatenate(own)), ids, pa.array(np.repeat(needs, many)), pa.array(np.concatenate(places))], names=[f.name for f in fields])

        return docs.mapInArrow(lean(run), T.StructType(fields))

    def run(self) -> DataFrame:
        s = self.scratch
        survey = s.save(self._survey())
        rows = survey.where("part = 0").select("node", "h", "size", "digest")
        whole = rows.where("digest is not null and node is not null")
        classes = whole.groupBy("digest").agg(F.min("node").alias("rep"), F.count("*").alias("copies"))
        several = s.save(classes.where("copies > 1").select("digest", "rep"))
        rows = s.save(join_counted(rows, several, "digest", "left").select("node", "h", "size", F.coalesce("rep", "node").alias("rep")))
        copies = rows.where("node <> rep").select("node", "h").distinct()
        docs = join_counted(self.docs.where("node is not null"), copies, ["node", "h"], "left_anti")
        heavy = self._heavy(survey)
        tally = whole.groupBy(F.least("size", F.lit(MOST_SMALL + 1)).alias("k")).agg(F.count("*").alias("n"), F.sum("size").alias("t")).collect()
        sizes, total = {r[0]: r[1] for r in tally}, sum(r[2] for r in tally) or 1
        small = boundary(sizes, float((heavy[1].astype(float) ** 2).sum()) / total, self.num, self.den)
        s.drop(survey)
        postings = s.save(self._postings(docs, heavy, small))
        words, n = _WordHash(), self.n
        read = lambda nodes: join_counted(docs, nodes, "node", "left_semi").select("node", F.col("text").alias("said"))
        comps = link(postings, read, lambda said: shingle_sets(said, n, words), self.num, self.den, s)
        # an id that stands in several classes joins them
        ids = s.save(rows.where("node is not null").groupBy("node").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("node"))
        if not ids.isEmpty():
            across = join_counted(rows.where("node <> rep"), ids, "node", "left_semi").select(F.col("node").alias("a"), F.col("rep").alias("b"))
            comps = components(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).union(across), s)
        out = join_counted(rows, comps.withColumnRenamed("node", "k"), F.col("rep") == F.col("k"), "left")
        return out.select("node", F.col("size").cast("long").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Components of documents by n-gram Jaccard similarity.

    One row per row of ``df``: ``id_col``, ``n_shingles`` (size of the set of
    distinct ``n``-word shingles; a shorter text is one shingle) and
    ``component_id`` (the smallest id reachable by links, the row's own
    included).  Two rows link when ``den * overlap >= num * union``.  Null, empty
    and wordless texts have 0 shingles and link with nothing; rows with one id
    count as linked; a null id has component null; an empty table gives an empty
    table.  Equal sets are collapsed by digest first.
    """
    return Join(df, id_col, text_col, n, num, den).run().withColumnRenamed("node", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``df`` with one document of each component: that of the smallest id (null ids and repeated rows of a kept id stay)."""
    gone = join(df, id_col, text_col, n, num, den).toDF("gone", "size", "keep").where("gone <> keep").select("gone").distinct()
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return join_counted(flat, Scratch(df.sparkSession).save(gone), F.col(f"_{df.columns.index(id_col)}") == F.col("gone"), "left_anti").toDF(*df.columns)

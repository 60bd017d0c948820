"""Shared helpers: column picking, text chunks, scratch tables, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the Arrow batches that Python workers get, whatever the length of texts.
BATCH_BYTES = 4 << 20
#: Sides of a join are broadcast only when they are counted at up to so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """Only the given columns, matched by exact name (first match wins), so that
    extra columns, also ones that differ by case or repeat a name, do no harm.
    ``renamed`` maps a new name to the name in ``df``.  All operators come here
    first, so that this also bounds the bytes of the session's Arrow batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    wanted = {n: n for n in names} | renamed
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    out = []
    for new, old in wanted.items():
        if old not in df.columns:
            raise ValueError(f"column {old!r} is missing; there are {df.columns}")
        out.append(F.col(f"_{df.columns.index(old)}").alias(new))
    return flat.select(*out)


def _width(col: F.Column, kind: T.DataType) -> F.Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_width(col[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            return F.coalesce(F.aggregate(col, F.lit(8).cast("long"), lambda a, x: a + _width(x, kind.elementType)), F.lit(8))
        return 8 * F.greatest(F.size(col), F.lit(0)) + 8
    return F.lit(8)


def is_small(df: DataFrame) -> bool:
    """Whether ``df``, counted and measured, may be broadcast."""
    rows, held = df.agg(F.count("*"), F.sum(sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(8)).cast("long"))).first()
    return rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES


def join_counted(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """A join that broadcasts ``small`` only if it is counted and measured as small; else Spark shuffles, and splits skewed keys as it runs."""
    return big.join(F.broadcast(small) if is_small(small) else small, on, how)


def text_bytes(col: str = "text") -> F.Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def chunks(batches: Iterator[pa.RecordBatch], budget: int = 2_000_000) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as tuples, in lists whose byte columns hold about ``budget`` bytes; a longer row comes alone."""
    for batch in batches:
        rows, held = [], 0
        cols = [batch.column(i) for i in range(batch.num_columns)]
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.slice(at, 256).to_pylist() for c in cols)):
                held += sum(len(x) for x in row if isinstance(x, bytes))
                rows.append(row)
                if held >= budget:
                    yield rows
                    rows, held = [], 0
        if rows:
            yield rows


def lean(run: Callable) -> Callable:
    """A function for ``mapInArrow`` that gives its memory back when a task ends and
    its tables, caches and last batch are gone; a Python worker lives on, and would
    hold what the largest of its tasks needed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    """Gives freed memory back to the system: of Python, of Arrow and of the C library."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def id_hash(doc_id: str = "doc_id", salt: str = "") -> F.Column:
    """A stable pseudo-random long for sampling and ordering."""
    return F.xxhash64(F.lit(salt), F.col(doc_id))


def crc_text(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF


class Scratch:
    """Parquet tables in the shared checkpoint folder; they cut lineage and
    outlive executors.  All tables go when the Python process ends."""

    _made: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="pelorus-")
            spark.conf.set("spark.checkpoint.dir", where)
        self.root = f"{where.rstrip('/')}/pelorus-{uuid.uuid4().hex}"
        if not Scratch._made:
            atexit.register(Scratch._clean)
        Scratch._made.append((spark, self.root))
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables."""
        for t in tables:
            self._delete(self.spark, t._scratch_path)

    def free(self) -> None:
        """Lets Spark delete the shuffle files of plans that are no longer referenced; those of the last plan need two collections."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    @staticmethod
    def _delete(spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    @classmethod
    def _clean(cls) -> None:
        for spark, root in cls._made:
            try:
                cls._delete(spark, root)
            except Exception:  # noqa: BLE001  the session may have stopped already
                return


#: Edges up to so many (16 MB of pairs) are joined up in one task; more in distributed rounds.
FEW_EDGES = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of 0..n-1 by links (a, b)."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, ra, rb)
        np.minimum.at(root, rb, ra)
        while (root != root[root]).any():
            root = root[root]


def components(edges: DataFrame, scratch: Scratch, few: int = FEW_EDGES, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of any orderable type:
    one row ``(node, root)`` for each node that has an edge, ``root`` the smallest
    node of its component.  Null ends and loops are ignored.

    Counted edges of at most ``few`` go through one task's union-find, which
    spares the rounds' shuffles; beyond that, large-star and small-star rounds
    alternate, each a grouped minimum (combined before the shuffle) and a join,
    and no component is ever gathered in one place."""
    e = scratch.save(edges.select("a", "b").where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")))
    if e.count() <= few:
        kind = e.schema["x"].dataType

        def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
            if got:
                x, y = (np.concatenate(c) for c in zip(*got))
                names, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                root = local_roots(at[: len(x)], at[len(x) :], len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])

        done = scratch.save(e.coalesce(1).mapInArrow(lean(join_up), T.StructType([T.StructField("node", kind), T.StructField("root", kind)])))
        scratch.drop(e)
        return done
    mark = None
    for _ in range(most_rounds):
        both = e.select("x", "y").union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, F.col("x") == F.col("k")).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low.withColumnRenamed("x", "k"), F.col("x") == F.col("k")).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        done = scratch.save(small.union(low.select("x", "m")).distinct())
        scratch.drop(e)
        e = done
        now = e.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("x").alias("node"), F.col("y").alias("root")).union(e.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())

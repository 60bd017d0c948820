"""Fuzzy line dedup by MinHash.

Signatures of character shingles are banded with high recall, lines that share
a band are verified by exact Jaccard similarity, and distributed union-find
keeps one line of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import Scratch, chunks, decode, join_counted, lean, pick, text_bytes
from pelorus.llm.linking import link

#: Characters of a shingle; bands and rows: at similarity 0.8 a pair shares a band in 995 of 1,000 cases.
SHINGLE, BANDS, ROWS = 8, 10, 4
#: Lines of up to LONG distinct shingles have signatures of as many hash functions as rows; lines of SHORT and more have one-permutation signatures.  Between them both: at similarity 0.8 the smaller set is at least 0.8 of the larger, so that two similar lines share a family.
SHORT, LONG = 192, 240
#: So many digests of lines are remembered by a task, which makes band hashes of each but once.
MET = 400_000
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_A = (np.random.default_rng(7).integers(1, 2**32, BANDS * ROWS, np.uint64) | _U(1)).astype(np.uint32)
_B = np.random.default_rng(8).integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(29))


def shingle_hashes(cp: np.ndarray) -> np.ndarray:
    """Hash of the shingle that begins at each code point but the last few."""
    with np.errstate(over="ignore"):
        h, p, width = cp.astype(np.uint64), _P, 1
        while width < SHINGLE:
            h = h[:-width] * p + h[width:]
            p, width = p * p, width * 2
    return _mix(h)


def line_sets(lines: list[str]) -> list[np.ndarray]:
    """Distinct shingles of lines, sorted; a line shorter than one is one shingle."""
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, at, out = shingle_hashes(cp) if len(cp) >= SHINGLE else cp[:0], 0, []
    for line in lines:
        if len(line) < SHINGLE:
            out.append(np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))], np.uint64))
        else:
            s = np.sort(h[at : at + len(line) - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        at += len(line)
    return out


def _bands(sig: np.ndarray, family: int) -> np.ndarray:
    """Band hashes, a row of BANDS for each row of signatures."""
    with np.errstate(over="ignore"):
        grid = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
        h = np.full(grid.shape[:2], _U(family + 1)) + (np.arange(BANDS, dtype=np.uint64) * _P)[None, :]
        for r in range(ROWS):
            h = _mix(h * _P + grid[:, :, r])
    return h


def classic(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """MinHash by one linear function for each row; ``hashes`` of all lines one after another."""
    at = np.cumsum(size) - size
    return np.stack([np.minimum.reduceat(hashes * a + b, at) for a, b in zip(_A, _B)], 1)


def one_permutation(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least hash of each of BANDS * ROWS bins; an empty bin takes the next filled one's, marked by the distance."""
    k = BANDS * ROWS
    none = np.uint32(0xFFFFFFFF)
    sig = np.full(len(size) * k, none)
    place = np.repeat(np.arange(len(size)) * k, size) + ((hashes.astype(np.uint64) * _U(k)) >> _U(32)).astype(np.int64)
    np.minimum.at(sig, place, hashes * np.uint32(0x9E3779B1))
    sig = sig.reshape(-1, k)
    for row in np.flatnonzero((sig == none).any(1)):
        own = sig[row].copy()
        full = np.flatnonzero(own != none)
        nxt = full[np.searchsorted(full, np.arange(k)) % len(full)]
        sig[row] = own[nxt] + (((nxt - np.arange(k)) % k) * 0x85EBCA6B & 0xFFFFFFFF).astype(np.uint32)
    return sig


def _distinct(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each line, one after another, and how many each has."""
    flat = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    both = np.sort((np.repeat(np.arange(len(size), dtype=np.uint64), size) << _U(32)) | h[flat])
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]  # np.unique takes many times as long
    return both.astype(np.uint32), np.bincount((both >> _U(32)).astype(np.int64), minlength=len(size))


def _at_most(h: np.ndarray, start: np.ndarray, size: np.ndarray, bins: int = 1024) -> np.ndarray:
    """Whether a line may have no more than LONG different hashes: those that fill more bins have more."""
    if not len(size):
        return np.zeros(0, bool)
    full = np.zeros(len(size) * bins, bool)
    flat = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    full[np.repeat(np.arange(len(size)) * bins, size) + (h[flat] >> np.uint32(22))] = True
    return full.reshape(-1, bins).sum(1) <= LONG


def signatures(texts: list[str], met: set[int] | None = None) -> list[tuple[int, int, int, np.ndarray | None]]:
    """For each line that is not blank: its text's place, its number, its 64-bit
    digest, and its band hashes, or none if it is shorter than a shingle or was
    ``met`` before; its digest is added there."""
    lines: list = []
    met = set() if met is None else met
    fresh, spans, base, parts = [], [], 0, []
    for t, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            if not line or line.isspace():
                continue
            digest = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
            if digest not in met and len(line) >= SHINGLE:
                fresh.append(len(lines))
                spans.append((base, len(line) - SHINGLE + 1))
                parts.append(line)
                base += len(line)
            met.add(digest)
            lines.append([t, i, digest, None])
    if fresh:
        h = (shingle_hashes(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)) >> _U(32)).astype(np.uint32)
        start, size = np.array(spans).T
        long = np.flatnonzero(size >= SHORT)  # a line that repeats itself has fewer shingles than places for them
        long = long[_at_most(h, start[long], size[long])]
        if len(long):
            sets, own = _distinct(h, start[long], size[long])
            start[long], size[long] = len(h) + np.cumsum(own) - own, own
            h = np.concatenate([h, sets])
        for family, chosen, make in ((0, size <= LONG, classic), (1, size >= SHORT, one_permutation)):
            rows = np.flatnonzero(chosen)
            if not len(rows):
                continue
            own = size[rows]
            flat = np.repeat(start[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())
            for k, band in zip(rows.tolist(), _bands(make(h[flat], own), family)):
                held = lines[fresh[k]]
                held[3] = band if held[3] is None else np.concatenate([held[3], band])
    return lines


class Dedup:
    """``docs`` has ``id``, ``h`` (hash of the text; rows are told by id and text) and ``text``."""

    def __init__(self, docs: DataFrame, num: int, den: int):
        self.spark, self.num, self.den = docs.sparkSession, num, den
        self.scratch = Scratch(self.spark)
        self.docs = docs.where("id is not null")
        self.kind = self.docs.schema["id"].dataType

    def _lines(self) -> DataFrame:
        fields = [T.StructField("id", self.kind), T.StructField("h", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("head", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: set[int] = set()
            for rows in chunks(batches, 500_000):  # small enough for the processor's cache
                if len(met) > MET:
                    met.clear()
                got = signatures([decode(r[2]) for r in rows], met)
                place = np.array([g[0] for g in got], np.int64)
                head = np.diff(place, prepend=-1) != 0  # a text's first line that is not blank
                place = pa.array(place)
                ids, hashes = pa.array([r[0] for r in rows]).take(place), pa.array([r[1] for r in rows], pa.int64()).take(place)
                nodes = np.array([g[2] for g in got], np.uint64).view(np.int64)
                bands = pa.array([None if g[3] is None else g[3].view(np.int64) for g in got], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, hashes, pa.array([g[1] for g in got], pa.int32()), pa.array(head), pa.array(nodes), bands], names=[f.name for f in fields])

        return self.docs.mapInArrow(lean(run), T.StructType(fields))

    def _read(self, lines: DataFrame, classes: DataFrame):
        """Gives ``(node, said)`` of given nodes, each read again where it first stands; a text is split once for all its lines."""

        def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                    parts, wanted = decode(text.as_py()).split("\n"), wanted.as_py()
                    out = [parts[w["line"]].encode("utf-8", "surrogatepass") for w in wanted]
                    yield pa.RecordBatch.from_arrays([pa.array([w["node"] for w in wanted], pa.int64()), pa.array(out, pa.binary())], names=["node", "said"])

        def read(nodes: DataFrame) -> DataFrame:
            first = join_counted(classes.select("node", "first"), nodes, "node", "left_semi")
            wanted = self.scratch.save(first.groupBy("first.id", "first.h").agg(F.collect_list(F.struct("node", "first.line")).alias("wanted")))
            again = lines.where("head").groupBy("id", "h").count().where("count > 1")
            once = self.docs if again.isEmpty() else self.docs.dropDuplicates(["id", "h"])
            found = join_counted(once, wanted, ["id", "h"], "inner").select("text", "wanted")
            return found.mapInArrow(lean(said), "node long, said binary")

        return read

    def run(self) -> DataFrame:
        """``(id, h, line)`` of the lines to drop."""
        s = self.scratch
        lines = s.save(self._lines())
        classes = s.save(lines.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("id", "h", "line")).alias("first")))
        postings = lines.where("bands is not null").select(F.explode("bands").alias("token"), "node", F.lit(1).alias("need"), F.lit(0).alias("pos"))
        comps = link(postings, self._read(lines, classes), lambda said: line_sets([decode(x) for x in said]), self.num, self.den, s, needs=False)
        known = join_counted(classes, comps.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").where("copies > 1 or root is not null")
        known = s.save(known.select("node", F.coalesce("root", "node").alias("comp"), "first"))
        kept = known.groupBy("comp").agg(F.min("first").alias("keep")).select(F.col("comp").alias("c"), "keep")
        verdict = s.save(known.join(kept, F.col("comp") == F.col("c")).select("node", "keep"))
        gone = join_counted(lines.select("id", "h", "line", "node"), verdict, "node", "inner").where("id <> keep.id or h <> keep.h or line <> keep.line")
        out = s.save(gone.select("id", "h", "line").distinct())
        s.drop(lines, classes, known, verdict)
        return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(df, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("h"), text_bytes().alias("text"))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100) -> DataFrame:
    """``id_col``, ``text_hash``, ``line`` (from 0): lines that repeat another one.

    Lines end at line feeds; blank ones are left alone.  Lines are linked when
    the Jaccard similarity of their sets of 8-character shingles is ``num / den``
    or more (shorter lines: when they are equal); of each component the first
    line by id, ``text_hash`` (xxhash64 of the text) and number stays.  Equal
    lines are told by 64-bit digests.  Null and empty texts have no lines; rows
    of one id and different texts are documents of their own, and rows that are
    alike in both count as one; rows with a null id are left alone; an empty
    table gives an empty table.
    """
    return Dedup(_keyed(df, id_col, text_col), num, den).run().select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "line")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, dropped_col: str = "dropped_lines") -> DataFrame:
    """``df`` without repeated lines: ``text_col`` keeps its other lines, joined by
    line feeds, and ``dropped_col`` (sorted array of numbers, null where there
    are none) is appended, with underscores where its name is taken.  Rows stay,
    also those left with an empty text."""
    gone = Dedup(_keyed(df, id_col, text_col), num, den).run()
    by_doc = gone.groupBy(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).agg(F.array_sort(F.collect_list("line")).alias("gone"))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lines in batch.column("gone"):
                at = np.array(lines.as_py())
                mask = np.ones(at[-1] + 1, np.uint8)
                mask[at] = 0
                out.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "mask"])

    by_doc = Scratch(df.sparkSession).save(by_doc.mapInArrow(lean(masks), T.StructType([*by_doc.schema, T.StructField("mask", T.BinaryType())])))
    names, at, key = df.columns, df.columns.index(text_col), df.columns.index(id_col)
    while dropped_col.lower() in {n.lower() for n in names}:
        dropped_col += "_"
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    out = join_counted(flat, by_doc, (F.col(f"_{key}") == F.col("gone_id")) & (F.xxhash64(f"_{at}") == F.col("gone_h")), "left")
    # a mask has a byte for each line up to the last that goes, 0 for those that go
    rest = F.filter(F.split(F.col(f"_{at}"), "\n", -1), lambda x, i: F.substring(F.col("mask"), i + 1, F.lit(1)) != F.lit(b"\0"))
    text = F.when(F.col("mask").isNull(), F.col(f"_{at}")).otherwise(F.array_join(rest, "\n"))
    return out.select(*[text if i == at else F.col(f"_{i}") for i in range(len(names))], "gone").toDF(*names, dropped_col)


def report(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What became of each document (of :func:`dedup`, whose last column has the
    dropped lines): its lines now, the numbers of those dropped, and a digest of the rest."""
    rows = deduped.toDF(*[f"_{i}" for i in range(len(deduped.columns) - 1)], "gone")
    text = F.col(f"_{deduped.columns.index(text_col)}")
    return rows.select(
        F.col(f"_{deduped.columns.index(id_col)}").alias(id_col),
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("dropped"),
        F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )

"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in
numpy.

A word is the mean of its character n-grams' vectors and a text the mean of its
words', which the softmax reads.  Misspellings share n-grams with what was
learned.  The whole model is linear, so that for scoring each word comes to one
number.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import BROADCAST_ROWS, chunks, decode, held_out, id_hash, lean, pick, text_bytes, trim

BUCKETS = 1 << 16
#: Harmless texts also count by stretches of so many words, drawn anew each round: any part of one is harmless, and short texts vary most.
PARTS = (4, 60)
#: Longer words are taken in pieces of so many characters, which overlap.
LONGEST, PIECE, OVERLAP = 120, 12, 4
_WORD = re.compile(r"\w+")


def pieces(word: str) -> list[str]:
    """A word of up to LONGEST characters as it is; a longer one, such as text
    without spaces, in pieces of PIECE characters that overlap by OVERLAP, so
    that each n-gram is within one of them."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - OVERLAP, PIECE - OVERLAP)]


def words_of(text: str) -> list[str]:
    """Words in lower case, long ones in pieces; of a word said several times in a row, one."""
    return [w for w, _ in groupby(p for w in _WORD.findall(text.lower()) for p in pieces(w))]


def grams(word: str) -> list[int]:
    """Buckets of the word's n-grams of 3 to 5 characters, and of the whole."""
    w = f"<{word}>".encode("utf-8", "surrogatepass") if word.isascii() else f"<{word}>"
    out = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] + [w]
    if isinstance(w, str):
        out = [x.encode("utf-8", "surrogatepass") for x in out]
    return [zlib.crc32(x) % BUCKETS for x in out]


class Trainer:
    """Embeddings and softmax under Adam."""

    def __init__(self, texts: list[str], labels: list[int], width: int = 8, seed: int = 1, floor: float = 0.001):
        rng = np.random.default_rng(seed)
        vocab: dict[str, int] = {}
        self.docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
        self.y = np.array(labels, np.int64)
        ids, size = array("i"), array("i")
        for w in vocab:
            own = grams(w)
            ids.extend(own)
            size.append(len(own))
        self.size, self.ids = np.array(size, np.int64), np.array(ids, np.int32)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.emb = rng.normal(0, 0.1, (BUCKETS, width)).astype(np.float32)
        self.soft = rng.normal(0, 1.0, (width, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.state: dict[str, list] = {}
        self.step, self.floor, self.rng = 0, floor, rng

    def words(self, keep: np.ndarray) -> np.ndarray:
        """Vectors of the kept words."""
        out = np.empty((len(keep), self.emb.shape[1]), np.float32)
        for lo in range(0, len(keep), 20_000):
            part = keep[lo : lo + 20_000]
            size = self.size[part]
            ends = np.cumsum(size)
            flat = np.repeat(self.at[part] - ends + size, size) + np.arange(ends[-1])
            out[lo : lo + 20_000] = np.add.reduceat(self.emb[self.ids[flat]], ends - size, axis=0) / size[:, None]
        return out

    def _adam(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m, v = self.state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        root = np.sqrt(v / (1 - 0.999**self.step))
        # a floor in proportion to the largest: what is seen once or twice must not move as far as what tells the classes apart
        value -= rate * (m / (1 - 0.9**self.step)) / (root + self.floor * root.max() + 1e-12)

    def learn(self, bags: list[np.ndarray], y: np.ndarray, rate: float, decay: float = 1e-6) -> float:
        """One step on bags of words; classes weigh alike."""
        sizes = np.array([len(b) for b in bags])
        keep, place = np.unique(np.concatenate(bags), return_inverse=True)
        vec = self.words(keep)
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(vec[place], starts, axis=0) / sizes[:, None]
        z = mean @ self.soft + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = (0.5 / np.maximum(1, np.bincount(y, minlength=2)))[y].astype(np.float32)
        loss = float(-(weight * np.log(p[np.arange(len(y)), y] + 1e-12)).sum())
        p[np.arange(len(y)), y] -= 1
        g = (p * weight[:, None]).astype(np.float32)
        back = np.repeat((g @ self.soft.T) / sizes[:, None], sizes, axis=0)
        grad_word = np.stack([np.bincount(place, back[:, d], len(keep)) for d in range(back.shape[1])], 1) / self.size[keep][:, None]
        grad = np.zeros_like(self.emb)
        for lo in range(0, len(keep), 20_000):
            part = keep[lo : lo + 20_000]
            size = self.size[part]
            ends = np.cumsum(size)
            flat = self.ids[np.repeat(self.at[part] - ends + size, size) + np.arange(ends[-1])]
            rows = np.repeat(grad_word[lo : lo + 20_000], size, axis=0)
            for d in range(grad.shape[1]):
                grad[:, d] += np.bincount(flat, rows[:, d], BUCKETS)
        self.step += 1
        self._adam("emb", self.emb, grad + decay * self.emb, rate)
        self._adam("soft", self.soft, mean.T @ g + decay * self.soft, rate)
        self._adam("bias", self.bias, g.sum(0), rate)
        return loss

    def fit(self, rounds: int = 200, batch: int = 600, rate: float = 0.2) -> None:
        """Embeddings and softmax together, from a random start, on ``batch`` texts
        a round and a stretch of each of the harmless ones among them."""
        full = np.array([i for i, d in enumerate(self.docs) if len(d)], np.int64)
        if len(set(self.y[full].tolist())) < 2:
            return
        for k in range(rounds):
            part = self.rng.permutation(full)[:batch]
            bags = [self.docs[i] for i in part]
            for d in [d for d, y in zip(bags, self.y[part]) if y == 0]:
                n = int(self.rng.integers(*PARTS))
                at = int(self.rng.integers(0, max(1, len(d) - n + 1)))
                bags.append(d[at : at + n])
            y = np.concatenate([self.y[part], np.zeros(len(bags) - len(part), np.int64)])
            self.learn(bags, y, rate if k < rounds * 2 // 3 else rate / 4)

    def model(self) -> tuple[np.ndarray, float]:
        """One number for each n-gram, and the bias."""
        return (self.emb @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


class Words(dict):
    """Word to its number, worked out when first met."""

    def __init__(self, grams_value: np.ndarray, limit: int = 100_000):
        super().__init__()
        self.value, self.limit = grams_value.tolist(), limit

    def __missing__(self, word: str) -> float:
        own = grams(word)
        out = sum(map(self.value.__getitem__, own)) / len(own)
        if len(self) >= self.limit:
            self.clear()
        self[word] = out
        return out


class Judge:
    """Score of UTF-8 texts, and the place of the word that speaks most for it."""

    def __init__(self, value: np.ndarray, bias: float):
        self.known, self.bias = Words(value), bias

    def __call__(self, raw: bytes) -> tuple[float, int | None]:
        z = list(map(self.known.__getitem__, words_of(decode(raw))))
        p = 1 / (1 + math.exp(-max(-40.0, min(40.0, (sum(z) / len(z) if z else 0.0) + self.bias))))
        return (p, max(range(len(z)), key=z.__getitem__)) if z else (min(p, 0.49), None)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1500) -> DataFrame:
    """``text`` (bytes) and ``y``: at most ``per_class`` labelled texts of each
    class, those with the least hash of their id among ids that are not held out.  Labels that are null or
    neither 0 nor 1, and labels without a document, are passed over."""
    marks = pick(labels, id="doc_id", y=label_col).where(~held_out("id") & F.col("y").isin(0, 1))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).orderBy(id_hash("id", "toxicity"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    assert 2 * per_class <= BROADCAST_ROWS
    texts = pick(docs, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, **names) -> tuple[np.ndarray, float]:
    """Learns from :func:`sample`, in one task, which returns one number for each
    n-gram and the bias; of one class only, or of nothing, every score is 0.5 or
    less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(row[0], row[1]) for rows in chunks(batches) for row in rows})
        if len({y for _, y in got}) == 2:
            t = Trainer([decode(x) for x, _ in got], [y for _, y in got])
            t.fit()
            value, bias = t.model()
            del t
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["value", "bias"])

    learned = sample(docs, labels, **names).repartition(1).mapInArrow(lean(run), "value binary, bias double").collect()
    if not learned:
        return np.zeros(BUCKETS), -1.0
    return np.frombuffer(bytes(learned[0][0]), np.float64), learned[0][1]


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 where the score is 0.5 or
    more) and ``worst`` (the word of the highest logit, from 0, words repeated in a
    row being one; each piece of a long word counts as one).
    Null, empty and wordless texts get the score of the bias alone, at most
    0.49; repeated rows are kept; an empty table gives an empty table."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = pick(df, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("worst", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for rows in chunks(batches):
            scores, places = zip(*(judge(raw) for _, raw in rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(places, pa.int64())], names=["id", "score", "predicted", "worst"])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def keep_harmless(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns as they are, whose text is not predicted toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(at).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([judge(t or b"")[0] < 0.5 for t in texts], pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)

"""Language identification by cross-parsing entropy.

Labelled text of each language gives a suffix automaton.  A text is parsed
greedily into the longest phrases that an automaton knows; the language that
needs the fewest phrases for each character wins.  Automata are completed to
transducers whose edges say where phrases end, so that many texts are parsed
side by side with one table look-up for each character and language.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import chunks, decode, held_out, id_hash, lean, pick, text_bytes

#: Symbols: no letter, a letter that no sample holds, then the alphabet.
GAP, RARE = 0, 1
#: So many of the commonest letters are one symbol each; each other one is a lead and as many digits, to this base, as tell them all apart.
FEW, BASE = 60, 16
#: Texts are parsed in stretches of so many characters, each from the start state.
STRETCH = 1024


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), np.uint8, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet_of(texts: list[str]) -> list[str]:
    """All letters of the texts: the FEW commonest in order, then the others."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    ranked = sorted(seen, key=lambda c: (-seen[c], c))
    return sorted(ranked[:FEW]) + ranked[FEW:]


def place_table(alphabet: list[str]) -> np.ndarray:
    """Code points to GAP, RARE or the letter's place in the alphabet and 2."""
    table = _letters().astype(np.int32)
    for i, c in enumerate(alphabet):
        for form in {c, c.upper(), c.title()}:
            if len(form) == 1:
                table[ord(form)] = i + 2
    return table


def width_of(letters: int) -> int:
    """Number of symbols for an alphabet of so many letters."""
    return letters + 2 if letters <= FEW else FEW + 2 + 2 * BASE


def symbols_of(places: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of places of an alphabet of so many letters, and how many each place has."""
    digits = 1
    while BASE ** (digits + 1) < letters - FEW:
        digits += 1
    far = np.flatnonzero(places >= FEW + 2)
    count = np.ones(len(places), np.int64)
    count[far] += digits
    out = np.repeat(places, count)
    at, rest = (np.cumsum(count) - count)[far], places[far] - FEW - 2
    for k in range(digits + 1):
        out[at + k] = FEW + 2 + (BASE if k else 0) + rest // BASE ** (digits - k) % BASE
    return out.astype(np.uint8), count


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Edges of the automaton of all substrings, state 0 first."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[cur] = twin
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = twin
                    p = link[p]
        last = cur
    return edges


def transducer(edges: list[dict[int, int]], width: int) -> np.ndarray:
    """Flat table by state and symbol: the next state's row offset times 4, plus
    the phrases that end: the one before the symbol where no edge goes on, and the
    symbol itself where the start state does not know it."""
    n = len(edges)
    root = np.array([edges[0].get(c, 0) * width * 4 for c in range(width)], np.int64)
    new = np.array([c not in edges[0] for c in range(width)], np.int64)
    table = np.tile(root + 1 + new, (n, 1))
    table[0] = root + new
    states = np.fromiter((s for s, e in enumerate(edges) for _ in e), np.int64)
    chars = np.fromiter((c for e in edges for c in e), np.int64)
    ends = np.fromiter((t for e in edges for t in e.values()), np.int64)
    table[states, chars] = ends * width * 4
    return table.ravel()


def stretches(text: str, share: int, parts: int = 4) -> list[str]:
    """A text of up to ``share`` characters; of a longer one as many in all, a
    stretch from each of ``parts`` equal sections, its place drawn by a hash."""
    if len(text) <= share:
        return [text]
    section, size = len(text) // parts, share // parts - 1  # a gap goes with each
    seed = text.encode("utf-8", "surrogatepass")
    starts = [k * section + zlib.crc32(b"%d" % k, zlib.crc32(seed)) % max(1, section - size + 1) for k in range(parts)]
    return [text[a : a + size] for a in starts]


class Model:
    """``languages`` in order, the symbol table and the joined transducer tables."""

    def __init__(self, samples: dict[str, list[str]], chars: int):
        self.languages = sorted(samples)
        self.alphabet = alphabet_of([t for x in samples.values() for t in x])
        self.width = width_of(len(self.alphabet))
        table = place_table(self.alphabet)
        tables, self.base, at = [], [], 0
        for lang in self.languages:
            run: list[int] = []
            share = max(200, chars // max(1, len(samples[lang])))
            for t in samples[lang]:
                for part in stretches(t, share):
                    run += table[_points(part)].tolist() + [GAP]
            one = transducer(suffix_automaton(symbols_of(np.array(run[:chars], np.int32), len(self.alphabet))[0].tolist()), self.width)
            self.base.append(at)
            tables.append(one)
            at += len(one)
        flat = np.concatenate([t + 4 * b for t, b in zip(tables, self.base)]) if tables else np.zeros(0, np.int64)
        self.flat = flat.astype(np.int32) if 4 * len(flat) < 1 << 31 else flat

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language and text, and the number of letters of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        places = _table_of(tuple(self.alphabet))[_points("".join(texts))]
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(places > GAP)])
        letters = total[ends] - total[ends - sizes]
        sym, count = symbols_of(places, len(self.alphabet))
        total = np.concatenate([[0], np.cumsum(count)])
        sizes, ends = total[ends] - total[ends - sizes], total[ends]
        lanes = (sizes + STRETCH - 1) // STRETCH
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = (ends - sizes)[owner] + nth * STRETCH
        length = np.minimum(sizes[owner] - nth * STRETCH, STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        n_lang = len(self.languages)
        count = np.zeros((n_lang, len(owner)), np.int32)
        if len(owner):
            steps = int(length[0])
            grid = np.zeros(len(sym) + STRETCH, np.uint8)
            grid[: len(sym)] = sym
            grid = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(grid, steps)[start].T)
            active = np.searchsorted(-length, -np.arange(steps), "left")  # lanes longer than the step
            root = np.array(self.base, self.flat.dtype)[:, None]
            state = np.repeat(root, len(owner), 1)
            for t in range(steps):
                k = int(active[t])
                v = self.flat[state[:, :k] + grid[t, :k]]
                count[:, :k] += v & 3
                state[:, :k] = v >> 2
            count += state != root
        out = np.zeros((n_lang, len(texts)), np.int64)
        for i in range(n_lang):
            out[i] = np.bincount(owner, count[i], len(texts))
        return out, letters


@lru_cache(2)
def _table_of(alphabet: tuple[str, ...]) -> np.ndarray:
    return place_table(list(alphabet))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 64, chars: int = 30_000) -> Model:
    """Learns from a bounded sample: about ``per_language`` documents of each
    language, drawn by a hash of the id from those that are not held out, and at
    most ``chars`` characters of them, in stretches from all over each text.  Null texts and labels are passed over;
    texts without letters teach only gaps; without labels no language is known.
    All letters of the sampled texts are told apart, in whatever scripts."""
    rows = pick(df, id=id_col, text=text_col, lang=lang_col).where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    there = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not there:
        return Model({}, chars)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    drawn = rows.where(F.pmod(id_hash("id", "langid"), F.lit(1 << 30)) < share * (1 << 30))
    got = drawn.select("lang", id_hash("id", "langid").alias("h"), text_bytes().alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r[0], r[1], bytes(r[2]))):
        if len(held := samples.setdefault(r[0], [])) < per_language:
            held.append(decode(bytes(r[2])))
    return Model(samples, chars)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` (0 to 1: one less the winner's share
    of the runner-up's phrases) and ``phrases`` (of the winner for each letter).
    Null texts, texts without a letter and a model of no language give ``und``
    and 0; ties go to the first language in order; repeated rows are kept; an
    empty table gives an empty table."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = pick(df, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrases", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows in chunks(batches):
            count, letters = model.phrases([decode(t) for _, t in rows])
            lang, score, rate = [], [], []
            for k in range(len(rows)):
                if not letters[k] or not len(count):
                    lang.append("und")
                    score.append(0.0)
                    rate.append(None)
                    continue
                own = count[:, k]
                best = int(own.argmin())
                rest = np.delete(own, best)
                lang.append(model.languages[best])
                score.append(float(1 - own[best] / rest.min()) if len(rest) else 1.0)
                rate.append(float(own[best] / letters[k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(lang), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["id", "lang_pred", "score", "phrases"])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)

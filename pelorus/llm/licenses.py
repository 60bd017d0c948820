"""License scans by a positional rare-token index.

Templates are short passages of licence notices.  The index posts each
template's words with their positions; a file's rarest licence words (by
inverse template frequency) are looked up first, the postings are intersected
by relative position, and the template's key phrases must then stand in the
text word for word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelorus.llm.common import chunks, lean, pick, text_bytes

# Label, notice; words between ^ signs are a mandatory key phrase.
BASE = [
    ("mit", "^under the mit license^"),
    ("apache-2", "^apache license version 2^"),
    ("cc-by-nc", "^cc by nc^"),
]
TEMPLATES = BASE + [
    ("mit", "^permission is hereby granted free of charge^ to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the ^apache license version 2 0^ the license you may not use this file except in compliance"),
    ("gpl-2", "^gnu general public license version 2^"),
    ("gpl-3", "^gnu general public license version 3^"),
    ("gpl", "under the terms of the ^gnu general public license^ as published by the free software foundation"),
    ("lgpl", "^gnu lesser general public license^"),
    ("agpl", "^gnu affero general public license^"),
    ("mpl-2", "^mozilla public license^ version 2 0"),
    ("bsd", "^redistribution and use in source and binary forms^ with or without modification are permitted"),
    ("isc", "^permission to use copy modify and or distribute this software^ for any purpose"),
    ("unlicense", "this is free and unencumbered software ^released into the public domain^"),
    ("cc-by", "^creative commons attribution^ 4 0 international"),
    ("cc0", "^cc0 1 0 universal^"),
    ("epl-2", "^eclipse public license^ v 2 0"),
]

#: ASCII letters to lower case, other ASCII but digits to spaces; bytes above are parts of words.
_TABLE = bytes(i if chr(i).isdigit() or chr(i).islower() or i >= 0x80 else i + 32 if chr(i).isupper() and i < 0x80 else 32 for i in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Index:
    """Templates, their key phrases by relative position, and postings of every template's ``anchors`` rarest key words."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, anchors: int = 2):
        self.labels, self.words, self.keys = [], [], []
        for label, notice in templates:
            keys = self._pairs(notice)
            if not keys:
                raise ValueError(f"no key phrase: {notice}")
            words = [w.encode() for w in notice.replace("^", " ").split()]
            self.labels.append(label)
            self.words.append(words)
            self.keys.append(keys)
        n = len(templates)
        seen = Counter(w for words in self.words for w in set(words))
        self.idf = {w: math.log((1 + n) / c) for w, c in seen.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.wanted = []
        for t, (words, keys) in enumerate(zip(self.words, self.keys)):
            places = sorted((-self.idf[words[q]], q) for a, b in keys for q in range(a, b))[:anchors]
            self.wanted.append(len(places))
            for _, q in places:
                self.postings[words[q]].append((t, q))

    @staticmethod
    def _pairs(notice: str) -> list[tuple[int, int]]:
        out, n = [], 0
        for i, part in enumerate(notice.split("^")):
            k = len(part.split())
            if i % 2:
                out.append((n, n + k))
            n += k
        return out

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All places ``(template, start, share of its words that stand in place)`` whose key phrases are there."""
        if self.postings.keys().isdisjoint(words):
            return []
        lines: Counter = Counter()
        for p, w in enumerate(words):
            for t, q in self.postings.get(w, ()):
                lines[t, p - q] += 1
        found = []
        for (t, at), n in lines.items():
            if n < self.wanted[t]:
                continue
            if all(at + a >= 0 and words[at + a : at + b] == self.words[t][a:b] for a, b in self.keys[t]):
                own = self.words[t]
                there = sum(0 <= at + i < len(words) and words[at + i] == w for i, w in enumerate(own))
                found.append((t, at + self.keys[t][0][0], there / len(own)))
        return sorted(found)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Finds licence notices in whole texts.

    ``id_col``, ``n_words`` and ``hits``: an array of (label, phrase, start,
    share), a place each, where ``start`` is the word at which the first key
    phrase begins (from 0).  Null and empty texts have no words and no hits;
    repeated rows are scanned one by one; an empty table gives an empty table.
    """
    index = Index(templates)
    rows = pick(df, id=id_col, text=text_col).select("id", text_bytes().alias("text"))
    hit = T.StructType([T.StructField("label", T.StringType()), T.StructField("phrase", T.StringType()), T.StructField("start", T.LongType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit))])
    phrase = [" ".join(w.decode() for w in index.words[t][a:b]) for t, ((a, b), *_) in enumerate(index.keys)]
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            sizes, hits = [], []
            for _, raw in rows:
                words = words_of(raw)
                sizes.append(len(words))
                hits.append([(index.labels[t], phrase[t], at, share) for t, at, share in index.scan(words)])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(sizes, pa.int64()), pa.array([[dict(zip(("label", "phrase", "start", "share"), h)) for h in x] for x in hits], kind)], names=["id", "n_words", "hits"])

    return rows.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def report(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, extremes and labels of the base phrases, and the labels and best share of all."""
    base = [notice.strip("^") for _, notice in BASE]
    own = F.filter("hits", lambda h: h.phrase.isin(base))
    starts = F.transform(own, lambda h: h.start)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda h: h.label))), ",")
    return hits.select(
        id_col,
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h.share)), F.lit(0.0)).alias("score"),
    )

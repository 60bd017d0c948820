"""Similarity joins, line dedup, components and embeddings, against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.llm import common, embeddings, jaccard, lines, linking
from pelorus.llm.common import Scratch, components


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, few, kind):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3), (5, 4)], "a long, b long").select(*[F.lpad(F.col(c).cast("string"), 4, "0").alias(c) if kind == "string" else F.col(c) for c in "ab"])
    want = roots({x for e in edges for x in e}, edges)
    own = {int(a): int(b) for a, b in components(df, Scratch(spark), few).collect()}
    assert own == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0), Scratch(spark), few).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, []).append(shingles(t, n))
    links = [(a, b) for a, b in itertools.combinations(by, 2) for x in by[a] for y in by[b] if x and y and den * len(x & y) >= num * len(x | y)]
    return roots(by, links)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for base in range(30):
        size = rng.choice([1, 3, 5, 8, 12, 18, 25, 60, 200, 400])
        words = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, size // 40))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own) if base % 3 else " ".join(own[: size // 2]) + " " + passage + " " + " ".join(own[size // 2 :]))
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(60):  # a chain of near copies
        hot[k] = rng.choice(vocabulary)
        rows.append(" ".join(hot))
    rows += [None, "", "  \n", "one", "ONE", "one two three", "x " * 30_000, rows[0], rows[0]]
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_jaccard_join(docs, n, num, den):
    rows = [*corpus(n), (None, "one two three"), (10, "a row of the same id")]
    got = jaccard.join(docs(rows), n=n, num=num, den=den).collect()
    assert len(got) == len(rows)
    want = brute(rows, n, num, den)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, want.get(i)) for i, _ in rows}
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, n)) for _, t in rows)


def test_jaccard_without_documents(docs):
    assert jaccard.join(docs([])).count() == 0
    assert sorted(tuple(r) for r in jaccard.join(docs([(1, None), (2, "")])).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_keep_one_keeps_columns(docs):
    rows = corpus(8)
    df = docs(rows)
    want = brute(rows, 5, 80, 100)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in want.items() if i == r)


def test_subsets_and_prefixes_miss_nothing():
    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(1, 20))
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - int(rng.integers(0, 3))], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)]))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert set(jaccard.subset_tokens(a, 85, 100)) & set(jaccard.subset_tokens(b, 85, 100))
            assert set(a[: jaccard.prefix_size(len(a), 85, 100)]) & set(b[: jaccard.prefix_size(len(b), 85, 100)])
    assert jaccard.boundary({5: 100, 8: 100}, 1000.0, 85, 100) == jaccard.MOST_SMALL and jaccard.boundary({20: 100}, 0.0, 85, 100) < 20


# lines


def line_rows():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(n) for n in (3, 12, 12, 40, 60, 90)]
    rows = []
    for i in range(60):
        own = [line(rng.choice([1, 4, 15, 50, 80])) for _ in range(4)]
        words = rng.choice(shared).split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        own.insert(rng.randrange(4), " ".join(words))
        rows.append("\n".join(own))
    rows += [None, "", "\n\n", "short", "short\nshort", " \n", "x" * 50_000, "x" * 50_001, rows[0]]
    return list(enumerate(rows))


def brute_lines(rows):
    at = [(i, k, s) for i, t in rows if i is not None for k, s in enumerate((t or "").split("\n")) if s.strip()]
    own = lambda s: {s[k : k + 8] for k in range(len(s) - 7)} if len(s) >= 8 else {("short", s)}
    texts = list(dict.fromkeys(s for _, _, s in at))
    sets = [own(s) for s in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root, place = roots(range(len(texts)), links), {s: k for k, s in enumerate(texts)}
    keep = {}
    for i, k, s in at:
        r = root[place[s]]
        keep[r] = min(keep.get(r, (i, k)), (i, k))
    return {(i, k) for i, k, s in at if keep[root[place[s]]] != (i, k)}


def test_repeated_lines(docs):
    rows = [*line_rows(), (None, "short\nother line that stays")]
    want = brute_lines(rows)
    got = {(r.doc_id, r.line) for r in lines.repeated_lines(docs(rows)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)  # banding finds 995 of 1,000 at the threshold itself
    done = lines.dedup(docs(rows))
    for r in done.collect():
        text = dict(rows)[r.doc_id]
        gone = {k for i, k in got if i == r.doc_id}
        assert r.text == (text if not gone else "\n".join(s for k, s in enumerate(text.split("\n")) if k not in gone))
    assert lines.dedup(docs([])).count() == 0


def test_signature_families_meet():
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ij") for _ in range(215))
    near = [text, text[:212] + "xyz"]
    got = lines.signatures(["\n".join(near)])
    assert set(got[0][3]) & set(got[1][3]) and len(got[0][3]) == 2 * lines.BANDS


# embeddings


def brute_vectors(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, many = [], {}
    for (k, (i, x)), (m, (j, y)) in itertools.combinations(enumerate(good), 2):
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            links.append((i, j))
            many[i], many[j] = many.get(i, 0) + 1, many.get(j, 0) + 1
    return roots({i for i, _ in rows if i is not None}, links), many


@pytest.mark.parametrize("homes, probes", [(32_768, 65_536), (40, 60)])
def test_embeddings(spark, homes, probes):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * s for s in (0, 0.1, 0.2, 0.3)]
    hot = rng.normal(size=16)
    rows += [hot + rng.normal(size=16) * 0.1 for _ in range(60)]
    vectors = [[float(np.float32(x)) for x in r] for r in rows]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 0.0], [0.9, 0.4358898943540674], [3.0, 0.0]]
    table = [*enumerate(vectors), (None, vectors[0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in table], "vec_id long, embedding array<double>, node int, raw int")
    root, many = brute_vectors(table)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, homes=homes, probes=probes).collect()}
    assert len(got) == len(table)
    for i, _ in table:
        if i is None:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, None, False)
        else:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (many.get(i, 0), root[i], root[i] == i), i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_counted_join(spark, monkeypatch):
    a, b = spark.range(10), spark.range(3)
    assert common.is_small(b) and common.join_counted(a, b, "id", "left_anti").count() == 7
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    wide = b.select("id", F.array(F.repeat(F.lit("x"), 60)).alias("w"), F.struct("id").alias("s"))
    assert common.is_small(b) and not common.is_small(wide) and common.is_small(wide.limit(0))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert not common.is_small(b) and common.join_counted(a, b, "id", "left_semi").count() == 3


# near pairs within a token


@pytest.mark.parametrize("cell", [2048, 7])
def test_cross_pairs_lose_no_link(spark, monkeypatch, cell):
    monkeypatch.setattr(linking, "CELL", cell)
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = {k: np.unique(np.concatenate([base[rng.random(200) < 0.93], rng.integers(0, 2**63, 6).astype(np.uint64)])) for k in range(60)}
    sets |= {100 + k: base[:n] for k, n in enumerate((1, 3, 150, 190))}
    rows = [(token, k, k, 1, 0) for token in (1, 2) for k, s in sets.items()]
    postings = spark.createDataFrame(rows, "token long, node long, comp long, need int, pos int")
    texts = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "node long, said binary")
    texts = linking._with_sketches(texts, lambda said: [np.frombuffer(raw, np.uint64) for raw in said])
    pairs = {(lists, near): linking._cross_pairs(postings, texts, 80, 100, Scratch(spark), lists, near).collect() for lists in (False, True) for near in (False, True)}
    got = {tuple(r) for r in pairs[False, False]}
    assert got == {tuple(r) for r in pairs[True, False]} and {tuple(r) for r in pairs[True, True]} <= got
    assert {n for p in pairs[False, True] for n in p} == {n for p in got for n in p}  # each node's nearest is there
    linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= got and len(got) < 0.9 * len(sets) * (len(sets) - 1) / 2


def test_jaccard_ids_of_several_texts(docs):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (8, None), (9, ""), (9, a + " x"), (11, "alone here")]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.join(docs(order)).collect()}
        assert got == {(1, 57): 1, (5, 57): 1, (7, 58): 1, (8, 0): 8, (9, 0): 1, (9, 58): 1, (11, 1): 11}


def test_lines_of_ids_with_several_texts(docs):
    x, y, z = "a line that is said in both of the texts", "important unique text that must be kept in place", "other words of the second text, only there"
    rows = [(1, x + "\n" + y), (1, z + "\n" + x), (2, x), (2, x), (3, None), (4, "")]
    want = None
    for order in (rows, rows[::-1], rows[1:3] + rows[:1] + rows[3:]):
        done = sorted((r.doc_id, r.text or "") for r in lines.dedup(docs(order)).collect())
        assert len(done) == 6 and [sum(t.count(s) for _, t in done) for s in (x, y, z)] == [1, 1, 1]
        want = want or done
        assert done == want


def test_dedup_beside_clashing_columns(docs):
    df = docs([(1, "one line that is repeated\nown words of the first"), (2, "one line that is repeated")])
    df = df.select("*", *[F.lit(1).alias(n) for n in ("TEXT", "_id", "dropped_lines", "gone", "DOC_ID", "h", "line")])
    done = lines.dedup(df)
    assert done.columns == [*df.columns, "dropped_lines_"]
    flat = done.toDF(*[f"c{i}" for i in range(len(done.columns))]).orderBy("c0").collect()
    assert [(r[0], r[1], r[-1]) for r in flat] == [(1, "one line that is repeated\nown words of the first", None), (2, "", [0])]
    assert [(r.n_lines, r.n_dropped) for r in lines.report(done).orderBy("doc_id").collect()] == [(2, 0), (0, 1)]
    assert jaccard.keep_one(df).columns == df.columns and jaccard.keep_one(df).count() == 2

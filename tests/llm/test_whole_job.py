"""Operators on input that a narrower sample, alphabet or size would miss."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelorus.llm import langid, lines, secrets, toxicity

UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits


# secrets


@pytest.fixture(scope="module")
def pairs(spark):
    return secrets.train(secrets.labelled_samples(spark))


def found(docs, texts, model):
    """Share of the texts in which a random string is found."""
    got = secrets.scan(docs(list(enumerate(texts))), model=model)
    return got.where(F.exists("spans", lambda s: s["kind"] == "random")).count() / len(texts)


def test_random_keys_of_each_alphabet_and_length(docs, pairs):
    rng = random.Random(11)
    kinds = {"base36": UPPER + DIGITS, "lower": LOWER + DIGITS, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "url": UPPER + LOWER + DIGITS + "-_", "hex": "ABCDEF" + DIGITS, "base32": UPPER + "234567"}
    least = {20: 0.7, 24: 0.85, 32: 0.95, 40: 0.95}
    got = {(k, n): found(docs, ["the key " + "".join(rng.choice(al) for _ in range(n)) for _ in range(400)], pairs) for k, al in kinds.items() for n in least}
    assert {k: v for k, v in got.items() if v < least[k[1]]} == {}


def test_identifiers_of_other_words_are_left_alone(docs, pairs):
    words = "quarantine unfold whisper jigsaw tunnel overlap mirror puzzle glyph snapshot rebase heuristic yaw zenith keyring lattice nudge ivory".split()
    rng = random.Random(12)
    names = ["_".join(rng.choice(words) for _ in range(4)) + "_25" for _ in range(400)]
    assert found(docs, names, pairs) < 0.02 and found(docs, [n.upper() for n in names], pairs) < 0.1


# lines


def test_similar_lines_of_different_lengths(docs):
    rng = random.Random(13)
    make = lambda n: "".join(rng.choice(LOWER + "   ") for _ in range(n))
    once = make(150)
    groups = [["-" * 100, "-" * 300, "-" * 5000], [once, once + once], ["junk" * 20, "junk" * 900], ["ab" * 90, "ab" * 130]]
    for n in (193, 215, 240, 400):
        body = make(n)
        groups.append([body, body * 3, body + body[: n // 2]])
    for group in groups:  # what is promised
        a, *rest = lines.line_sets(group)
        assert all(len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in rest)
    rows = [(i, line) for i, line in enumerate(line for g in groups for line in g)]
    got = {(r.doc_id, r.line) for r in lines.repeated_lines(docs(rows)).collect()}
    first = [sum(map(len, groups[:k])) for k in range(len(groups))]
    assert got == {(i, 0) for i, _ in rows} - {(i, 0) for i in first}


def test_signatures_are_those_of_the_set():
    rng = random.Random(14)
    body = "".join(rng.choice(LOWER) for _ in range(230))
    for text, families in ((body, 2), (body * 2 + body[:7], 2), ("ab" * 400, 1), ("".join(rng.choice(LOWER) for _ in range(500)), 1)):
        assert len(lines.signatures([text])[0][3]) == families * lines.BANDS


# toxicity


def test_pieces_hold_every_gram():
    rng = random.Random(15)
    for n in (1, 120, 121, 127, 128, 129, 133, 1000):
        word = "".join(rng.choice(LOWER) for _ in range(n))
        whole = {word[i : i + k] for k in (3, 4, 5) for i in range(n - k + 1)}
        assert whole == {p[i : i + k] for p in toxicity.pieces(word) for k in (3, 4, 5) for i in range(len(p) - k + 1)}


def test_toxic_middle_of_text_without_spaces(spark, docs):
    rng = random.Random(16)
    calm, rude = ["stone", "river", "green", "table", "paper", "cloud", "window", "garden"], ["vilegrub", "nastoid", "grubvile"]
    text = lambda bad, n: " ".join(rng.choice(rude) if bad and k % 9 == 3 else rng.choice(calm) + rng.choice(calm) for k in range(n))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs([(i, text(i % 4 == 0, 60)) for i in range(400)]), labels)
    around = ["".join(rng.choice(calm) for _ in range(60)) for _ in range(2)]
    middle = "".join(rng.choice(rude) for _ in range(12))
    rows = [(0, around[0] + around[1]), (1, around[0] + middle + around[1]), (2, "_".join([around[0], middle, around[1]]))]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs(rows), model).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
    assert [r.doc_id for r in toxicity.keep_harmless(docs(rows), model).collect()] == [0]


# languages


def test_letters_of_many_scripts(docs):
    rng = random.Random(17)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    words = {k: [rng.choice(letters) + rng.choice(letters) for _ in range(60)] for k in ("aa", "bb", "cc")}
    words |= {"el": "και το να του της με για στην είναι που από".split(), "ru": "и в не на что как по это она так его".split(), "en": "the of and to in is that for it was".split()}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(i, make(lang), lang) for i in range(180) for lang in [sorted(words)[i % 6]]]
    model = langid.fit(docs(rows))
    assert set(letters) & set("".join(words["aa"])) <= set(model.alphabet) and len(model.alphabet) > 250
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(rows), model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.98


def test_every_letter_has_its_own_symbols():
    for n in (10, 60, 61, 76, 315, 316, 317, 5000):
        got = [tuple(langid.symbols_of(np.array([p], np.int32), n)[0].tolist()) for p in range(n + 2)]
        assert len(set(got)) == n + 2 and max(map(max, got)) < langid.width_of(n)


def test_shared_openings_do_not_hide_the_rest(docs):
    rng = random.Random(18)
    sound = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "err", "ung"], "cc": ["tro", "veb", "siq"]}
    make = lambda lang, n: " ".join("".join(rng.choice(sound[lang]) for _ in range(3)) for _ in range(n))
    opening = "all rights are reserved by the owners of this page " * 20
    rows = [(i, opening + make(lang, 900), lang) for i in range(180) for lang in [sorted(sound)[i % 3]]]
    model = langid.fit(docs(rows))
    new = [(1000 + i, make(lang, 30), lang) for i in range(60) for lang in [sorted(sound)[i % 3]]]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs(new), model).collect()}
    assert [got[i] for i, _, lang in new] == [lang for _, _, lang in new]


def test_stretches_come_from_every_quarter():
    text = "".join(chr(0x4E00 + i) for i in range(4001))
    got = langid.stretches(text, 468)
    assert [(ord(p[0]) - 0x4E00) // 1000 for p in got] == [0, 1, 2, 3] and sum(map(len, got)) + 4 == 468
    assert langid.stretches("short", 468) == ["short"] and len(langid.stretches(text[:470], 468)) == 4

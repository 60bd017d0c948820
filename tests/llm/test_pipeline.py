"""The pipeline's stages against brute force, and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pelorus.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and {"pipeline", *queries.QUERIES} <= set(entry.queries())


def test_stages(spark, docs):
    text = "\n".join(" ".join(f"w{k}x{i}" for i in range(30)) for k in range(3))
    other = "\n".join(" ".join(f"v{k}x{i}" for i in range(30)) for k in range(3))
    near = "\n".join(f"{a}" for a in other.split("\n")[:1]) + "\nsomething else stands here and it is not short at all"
    rows = [(1, text), (2, text), (3, other), (4, near), (5, None), (6, ""), (7, "a single line of its own\n\nand one more")]
    done = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs(rows, extra=False), FOLDER).collect()}
    assert set(done) == {1, 3, 4, 5, 6, 7}
    assert done[4].text == near.split("\n")[1] and done[7].text == rows[6][1] and done[4].n_chars == len(done[4].text)
    mixed = corpus_pipeline.mixing_stage(spark, docs(rows, extra=False), FOLDER)
    assert mixed.columns == corpus_pipeline.COLUMNS
    kept = corpus_pipeline.jaccard_stage(spark, docs(rows, extra=False), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50

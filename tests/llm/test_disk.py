"""What the similarity joins leave on disk while they run."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from pelorus.llm import linking
from pelorus.llm.common import Scratch


def shuffle_bytes(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_shuffle_files_and_postings_go_before_the_next_step(spark, monkeypatch):
    """Most tokens stand once, as a document's shingles do; nodes 1 and 2 share theirs."""
    many = spark.range(400_000).select(F.xxhash64("id").alias("token"), (F.col("id") % 4000 + 10).alias("node"), F.lit(1).alias("need"), (F.col("id") % 90).cast("int").alias("pos"))
    pair = spark.range(8).select((F.col("id") % 4).alias("token"), F.floor(F.col("id") / 4 + 1).alias("node"), F.lit(1).alias("need"), F.lit(0).alias("pos"))
    scratch = Scratch(spark)
    scratch.free()
    postings = scratch.save(many.union(pair))
    time.sleep(1)
    before, held, there, old = shuffle_bytes(spark), [], [], Scratch.save

    def save(self, df):
        end = time.time() + 4  # files go in the background
        while (now := shuffle_bytes(spark) - before) > 1_000_000 and time.time() < end:
            time.sleep(0.2)
        held.append(now)
        there.append(os.path.exists(postings._scratch_path))
        return old(self, df)

    monkeypatch.setattr(Scratch, "save", save)
    read = lambda nodes: nodes.select("node", F.lit(b"x").alias("said"))
    got = linking.link(postings, read, lambda said: [np.arange(4, dtype=np.uint64) for _ in said], 85, 100, scratch)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1)]
    assert there[0] and not there[-1] and there.count(True) <= 5  # gone when the first step is done
    assert max(held) <= 1_000_000, held

"""Shuffle files of a search go with the step that made them."""

import time

from pyspark.sql import functions as F

from ringlake.llm import shingle_dedup
from ringlake.llm.hamming import components
from ringlake.sources.scratch import RELEASES, released


def shuffles(spark):
    """Ids of the shuffles that have files on disk."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = [f.split("/")[-1] for f in manager.getAllFiles().mkString("\n").split("\n")]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


def left_of(spark, work):
    """How many shuffles ``work`` leaves on disk; files go a moment after their query."""
    before = shuffles(spark)
    out, end = work(), time.time() + 10
    while (n := len(shuffles(spark) - before)) and time.time() < end:
        time.sleep(0.2)
    return n, out


def test_released_rows_leave_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    n, rows = left_of(spark, lambda: released(df))
    assert n == 0 and spark.conf.get(RELEASES, None) is None
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, df.collect())) and df.count() == 7


def test_fingerprint_pairs_come_once_and_leave_few_files(spark, docs_of):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in (0, 1, 2, 397, 398, 399)]
    sized = shingle_dedup.signatures(docs_of(list(enumerate(texts))), 5, simhash=True).select("sid", "n", "fp", "h")
    n, found = left_of(spark, lambda: released(shingle_dedup.fingerprint_pairs(sized)))
    pairs = [tuple(sorted((r.sid, r.other))) for r in found.collect()]
    assert n == 0 and pairs and len(pairs) == len(set(pairs))
    h = {r.sid: r.h for r in sized.collect()}
    assert all(r.h == h[r.sid] and r.other_h == h[r.other] for r in found.collect())


def test_components_of_chains_and_of_nothing(spark):
    chain = [(i * 37 % 101, (i + 1) * 37 % 101) for i in range(60)] + [(500, 501), (7000, 7000)]
    n, roots = left_of(spark, lambda: components(spark.createDataFrame(chain, "a long, b long")))
    ends = {x for e in chain[:60] for x in e}
    assert {tuple(r) for r in roots.collect()} == {(x, min(ends)) for x in ends} | {(500, 500), (501, 500)}
    assert n <= 6  # before: those of all rounds' joins
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

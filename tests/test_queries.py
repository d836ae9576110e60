"""Every registered query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from ragspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, tmp_path, name):
    out = str(tmp_path / name)
    driver.queries()[name](spark, SF).write.parquet(out)
    if name not in driver.oracle_sql():
        assert spark.read.parquet(out).count() > 0
        return
    con.sql(f"create or replace table want as {driver.oracle_sql()[name]}")
    con.sql(f"create or replace table got as select * from '{out}/*.parquet'")
    names = sorted(r[0] for r in con.sql("describe want").fetchall())
    assert names == sorted(r[0] for r in con.sql("describe got").fetchall())
    cols = ", ".join(f'"{n}"' for n in names)
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


def test_streams_equal_batch(spark, tmp_path):
    from ragspark.plans import telemetry_queries as t

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(t.j3_stream_collection_changes(spark, SF).select("id", "value")) == rows(t.batch_workload(spark, SF).select("id", "value"))


def test_streamed_questions_find_what_a_full_scan_finds(spark, tmp_path):
    """Brute force over all texts: with all lists probed the same hits, with the measured number nine in ten; only probed folders are read."""
    import numpy as np
    from pyspark.sql import functions as F

    from ragspark.operators.encoding import HashingEncoder
    from ragspark.plans import telemetry_queries as t
    from ragspark.streaming import jobs

    index, docs, nprobe = t._text_index(spark, SF)
    held = {r["id"]: r["text"] for r in docs.collect()}
    ids, items = np.array(sorted(held)), {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    encoder = HashingEncoder(64)
    scores = encoder(list(items.values())).astype(float) @ encoder([held[i] for i in ids.tolist()]).astype(float).T
    want = {q: [int(ids[j]) for j in np.lexsort((ids, -s))[:3]] for q, s in zip(items, scores)}
    spark.createDataFrame(list(items.items()), "qid long, question string").repartition(3).write.parquet(str(tmp_path / "in"))
    text = lambda n, i: f"Source #{n}\nDetail: " + __import__("re").sub("\n+", "\n", held[i] or "") + "\n"
    for lists, least in ((len(index.sizes), 1.0), (nprobe, 0.9)):
        found, plans = {}, []

        def sink(df, n):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            found.update({r["qid"]: r["contexts"] for r in df.collect()})

        stream = spark.readStream.schema("qid long, question string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = jobs.stream_queries(stream, index, docs, 3, sink, nprobe=lists).option("checkpointLocation", str(tmp_path / f"c{lists}"))
        run.trigger(availableNow=True).start().awaitTermination()
        hits = [c in found[q] for q in want for c in (text(n, i) for n, i in enumerate(want[q]))]
        assert found.keys() == want.keys() and sum(hits) >= least * len(hits) and len(plans) == 3
    assert nprobe < len(index.sizes) and all("PartitionFilters: [list_id" in p for p in plans) and F is not None


def test_entry(spark):
    assert driver.entry(spark).columns == ["qid", "prompt"]

"""The operators' queries over the smallest tables; where there is SQL, against it."""

import os

import duckdb
import pytest

from ragspark.llm import queries
from ragspark.llm.tables import first_by_hash, shared_dir, unused, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tmp_path, name):
    out = str(tmp_path / name)
    queries.queries()[name](spark, SF).write.parquet(out)
    if name not in queries.oracle_sql():
        assert spark.read.parquet(out).count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.sql(f"create table want as {queries.oracle_sql()[name]}")
    con.sql(f"create table got as select * from '{out}/*.parquet'")
    cols = ", ".join(sorted(r[0] for r in con.sql("describe want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


def test_rows_of_one_text_get_one_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from ragspark.llm import matroska

    twice = docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 100_000))
    got = matroska.media_digests(twice).drop("doc_id").groupBy("payload_sha256", "n_bytes").agg({"media_sha256": "count"}).collect()
    assert all(r[2] % 2 == 0 for r in got)


def test_helpers(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    few = first_by_hash(df, 10, "k")
    want = df.selectExpr("k", "xxhash64(k) as h").orderBy("h").limit(10).collect()
    assert [r["k"] for r in few.collect()] == [r["k"] for r in want]
    assert first_by_hash(df, 5000, "k").count() == 1000 and first_by_hash(df.where("k < 0"), 5, "k").count() == 0
    assert unused(df, "K") == "K_"
    assert written(df).count() == 1000 and shared_dir(spark)

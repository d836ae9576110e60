import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragspark.operators import chunking, collections, encoding
from ragspark.operators.position import with_position
from ragspark.sources import corpus


@pytest.fixture(scope="module")
def numbers(spark):
    ids = list(range(100))
    random.Random(1).shuffle(ids)
    return spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(7)


def test_positions(spark, numbers):
    got = with_position(numbers, "id", 5).collect()
    assert sorted((r["id"], r["position"]) for r in got) == [(i, i + 5) for i in range(100)]
    assert with_position(numbers.where("id < 0"), "id").count() == 0


def test_slices(numbers):
    assert sorted(r["id"] for r in corpus.dataset_slice(numbers, 30, 3, "id").collect()) == list(range(90, 100))
    with pytest.raises(ValueError):
        corpus.dataset_slice(numbers, 50, 2, "id")
    assert sorted(r["id"] for r in corpus.dataset_ratio(numbers, 0.129, "id").collect()) == list(range(12))
    assert corpus.dataset_ratio(numbers, 0, "id").count() == 0


def test_files_and_manifest(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_text("x")
    files = corpus.list_files(spark, str(tmp_path))
    assert [r["content"].rsplit("/", 1)[1] for r in files.collect()] == ["a.pdf", "b.pdf"]
    items = spark.createDataFrame([(1, "http://arxiv.org/abs/9"), (2, "u"), (3, "v")], "id long, url string")
    have = spark.createDataFrame([("2.pdf",)], "filename string")
    assert [tuple(r) for r in corpus.fetch_manifest(items, have, 1).collect()] == [(1, "http://arxiv.org/pdf/9", "1.pdf")]


def test_questions(spark):
    turns = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (2, 0, "user", "q3"), (2, 1, "assistant", "a3")],
        "conv_id long, turn long, role string, text string",
    )
    asked = corpus.question_batches(corpus.question_answers(turns), 1, 5, ["conv_id", "turn"])
    assert [tuple(r) for r in asked.orderBy("qid").collect()] == [(0, 0, "q1", "a1"), (1, 1, "q3", "a3")]


def test_collections_on_disk(spark, numbers, tmp_path):
    path = str(tmp_path / "c")
    for mode, n in (("create", 100), ("create", 100), ("append", 200), ("recreate", 100)):
        corpus.write_collection(numbers, path, mode)
        assert spark.read.parquet(path).count() == n
    with pytest.raises(ValueError):
        corpus.write_collection(numbers, path, "drop")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    corpus.save_embeddings(vectors, str(tmp_path / "v"))
    assert corpus.load_embeddings(spark, str(tmp_path / "v"))[1] == 2
    corpus.write_report(vectors.withColumn("t", F.lit('a "b", c')), str(tmp_path / "r"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "r")).first()
    assert (back["vector"], back["t"]) == ("[1.0,2.0]", 'a "b", c')


def test_recursive_chunks(spark):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", " ", " ", "\n", "\n\n", "wordsofmanyletters"]) for _ in range(rng.randint(0, 300)))
        size = rng.randint(1, 60)
        chunks = chunking.split_text(text, size, 0)
        assert "".join(chunks) == text and all(0 < len(c) <= size for c in chunks)
        assert all(len(c) <= size for c in chunking.split_text(text, size, size // 3))
    assert chunking.split_text("aa bb cc", 5, 2) == ["aa ", "a bb ", "b cc"]
    df = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.chunk_recursive(df, 8).orderBy("doc_id", "chunk_no").collect()
    assert [tuple(r) for r in got] == [(1, 0, "one two "), (1, 1, "three")]


def test_other_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r["text"] for r in chunking.chunk_fixed(df, 4, 0.25).orderBy("chunk_no").collect()] == ["abcd", "defg", "ghij", "j"]
    assert chunking.overlap_chars(512, 0.1) == 51 and chunking.overlap_chars(512, 10) == 10
    with pytest.raises(ValueError):
        chunking.overlap_chars(4, 4)
    lines = spark.createDataFrame([(1, "a\n\n  \nb\r\nc")], "doc_id long, text string")
    chunks = chunking.chunk_structural(lines)
    assert [r["text"] for r in chunks.orderBy("chunk_no").collect()] == ["a", "b", "c"]
    assert tuple(chunking.chunk_stats(chunks).first()) == (1, 3, 1, 1.0, 1)
    files = spark.createDataFrame([("x/A.PDF", 2), ("b.txt", 2), ("c.pdf", 0)], "name string, n_pages int")
    assert [r["path"] for r in chunking.page_manifest(files, "d").orderBy("page_no").collect()] == ["d/pages/A_page_1.png", "d/pages/A_page_2.png"]


def test_encoding(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b a", "", None, "c"])], "id long, text string")
    got = {r["id"]: r["vector"] for r in encoding.encode(df, "text", lambda: encoding.HashingEncoder(16), batch_size=2).collect()}
    assert got[0] == got[1] and got[2] == got[3] == [0.0] * 16 and abs(sum(x * x for x in got[4]) - 1) < 1e-6
    with pytest.raises(Exception, match="vectors for"):
        encoding.encode(df, "text", lambda: lambda texts: [[1.0]]).collect()


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0])], "id long, vector array<float>")
    unit = {r["id"]: r["vector"] for r in encoding.l2_normalize(df).collect()}
    assert unit[1] == pytest.approx([0.6, 0.8]) and unit[2] is None and unit[3] is None
    good, bad = encoding.validate_vectors(df, 2)
    assert [r["id"] for r in good.orderBy("id").collect()] == [1, 2]
    assert {r["id"]: r["fault"] for r in bad.collect()} == {3: "null", 4: "dimension", 5: "nan"}
    with pytest.raises(ValueError):
        encoding.validate_vectors(df, 2, on_bad="error")
    pages = spark.createDataFrame([("b", [[1.0], [2.0]]), ("a", [[3.0]])], "filepath string, vectors array<array<float>>")
    got = encoding.explode_multivector(pages, "filepath").orderBy("doc_id", "seq_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, [3.0], "a"), (1, 0, [1.0], "b"), (1, 1, [2.0], "b")]


def test_changes(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    ops = spark.createDataFrame([(2, "x", 1, "update"), (2, "y", 2, "update"), (4, "z", 1, "insert"), (3, "q", 1, "update"), (3, "q", 5, "delete")], "id long, v string, n long, op string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(collections.upsert(target, ops, "id", "n")) == [(1, "a"), (2, "y"), (3, "q"), (4, "z")]
    assert rows(collections.apply_workload(target, ops, "id", "n")) == [(1, "a"), (2, "y"), (4, "z")]
    assert rows(collections.delete_keys(target, ops, "id")) == [(1, "a")]
    assert rows(collections.filter_query(target, "id > 1", ["id"], 1)) == [(2,)]
    short = spark.createDataFrame([(9,)], "x long")
    assert rows(collections.pair_vectors(target, short, "id", "x", strict=False).select("id", "x")) == [(1, 9)]
    with pytest.raises(ValueError):
        collections.pair_vectors(target, short, "id", "x")
    assert rows(collections.assign_ids(target, "v", 7).select("v", "id")) == [("a", 7), ("b", 8), ("c", 9)]


def _by_definition(text, size, overlap):
    """chunk_recursive, said again: cut at the coarsest separator, recursively, then pack greedily."""

    def cut(part, separators):
        if len(part) <= size:
            return [part]
        if not separators or separators[0] == "":
            return [part[k : k + size] for k in range(0, len(part), size)]
        if separators[0] not in part:
            return cut(part, separators[1:])
        ends = [i + len(separators[0]) for i in _places(part, separators[0])]
        return [x for a, b in zip([0, *ends], [*ends, len(part)]) if b > a for x in cut(part[a:b], separators[1:])]

    out = []
    for piece in cut(text, ["\n\n", "\n", " ", ""]):
        if out and len(out[-1]) + len(piece) <= size:
            out[-1] += piece
        else:
            tail = out[-1][-overlap:] if out and overlap and len(piece) + overlap <= size else ""
            out.append(tail + piece)
    return [c for c in out if c]


def _places(part, separator):
    at = part.find(separator)
    while at >= 0:
        yield at
        at = part.find(separator, at + len(separator))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(2, 20), st.integers(0, 6))
def test_recursive_chunks_by_definition(text, size, overlap):
    overlap = min(overlap, size - 1)
    assert chunking.split_text(text, size, overlap) == _by_definition(text, size, overlap)


def test_encoded_documents_equal_their_sql(spark, tmp_path):
    """Entries that lie on a half (7 of a length of 80: 87.5 thousandths), white space that is no ASCII, letters whose lower case is special."""
    import duckdb

    import __spark_entry__ as driver

    slot, by_dim = encoding.HashingEncoder(64)._slot, {}
    for i in range(5000):
        by_dim.setdefault(slot(f"w{i}"), f"w{i}")
    half = " ".join(" ".join([by_dim[2 * d + 1]] * n) for d, n in enumerate((7, 79, 10, 3, 1)))
    texts = [half, "a\xa0b c\x0bd e\x1cf\u2003g", "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3 x", "\u0130stanbul Iz", " \t\n", "", None, "a b a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["thousandths"] for r in driver.queries()["c1_encode"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql(driver.oracle_sql()["c1_encode"]).fetchall())
    assert got[0].startswith("88,")

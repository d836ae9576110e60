import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import ann, evaluation, prompts, rerank, search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[3]  # a tie
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(5)
    queries = vectors.where("id % 50 = 3").selectExpr("id as qid", "vector")
    return x.astype(float), vectors, queries


def rows(df):
    return [(r["qid"], r["rank"], r["id"]) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_exact_search(data, metric):
    x, vectors, queries = data
    want = []
    for q in range(3, 300, 50):
        s = {"L2": ((x - x[q]) ** 2).sum(1), "IP": -(x @ x[q]), "COSINE": -(x @ x[q]) / np.linalg.norm(x, axis=1)}[metric].round(9)
        want += [(q, k, int(i)) for k, i in enumerate(np.lexsort((np.arange(300), s))[:6])]
    assert rows(search.knn_exact(queries, vectors, 6, metric)) == want == rows(search.knn_exact_sql(queries, vectors, 6, metric))


def test_blocks_few_rows_and_bad_vectors(spark, data, monkeypatch):
    _, vectors, queries = data
    whole = rows(search.knn_exact(queries, vectors, 4, "IP"))
    monkeypatch.setattr(search, "QUERY_BYTES", 2 * 8 * 8)
    assert rows(search.knn_exact(queries, vectors, 4, "IP")) == whole
    bad = spark.createDataFrame([(1, [1.0]), (2, None), (3, [float("nan")] + [0.0] * 7), (4, [1.0] * 8)], "id long, vector array<float>")
    assert {r[2] for r in rows(search.knn_exact(queries, bad, 10, "IP"))} == {4}
    assert search.knn_exact(queries.where("false"), vectors, 3).count() == 0
    with pytest.raises(ValueError):
        search.knn_exact(queries, vectors, 3, "HAMMING")


def test_plan_of_top_k(data):
    _, vectors, queries = data
    plan = search.knn_exact(queries, vectors, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan


def test_ivf(data):
    _, vectors, queries = data
    index = ann.ivf_build(vectors, n_lists=8, max_iter=5, sample_rate=20, list_rows=30)
    exact = search.knn_exact(queries, vectors, 5, "L2")
    assert rows(ann.ivf_search(queries, index, 5, nprobe=8)) == rows(exact)
    few = ann.ivf_search(queries, index, 5, nprobe=2)
    assert all(0 <= r["recall"] <= 1 for r in search.recall_at_k(few, exact).collect())
    assert "NestedLoop" not in few._jdf.queryExecution().executedPlan().toString()
    assert index.rows.count() == 300


def test_empty_indexes(data, spark):
    _, vectors, queries = data
    none = vectors.where("false")
    assert ann.ivf_search(queries, ann.ivf_build(none), 3).count() == 0
    assert ann.pq_search(queries, ann.pq_build(none, m=4), 3).count() == 0
    assert ann.pq_search(queries.where("false"), ann.pq_build(vectors, m=4, bits=4), 3).count() == 0


def test_query_blocks_and_tiles(data, monkeypatch):
    _, vectors, queries = data
    whole = [rows(f(queries, vectors, 4)) for f in (search.knn_exact, search.knn_exact_sql)]
    pq = ann.pq_build(vectors, m=4, bits=4)
    found = rows(ann.pq_search(queries, pq, 4))
    monkeypatch.setattr(search, "QUERY_BYTES", 3 * 64)
    monkeypatch.setattr(search, "SCORE_CELLS", 10)
    assert [rows(f(queries, vectors, 4)) for f in (search.knn_exact, search.knn_exact_sql)] == whole
    assert rows(ann.pq_search(queries, pq, 4)) == found


def test_ivf_on_disk(data, tmp_path):
    _, vectors, queries = data
    index = ann.ivf_build(vectors, n_lists=4, max_iter=5, path=str(tmp_path / "ivf"))
    assert rows(ann.ivf_search(queries, index, 3, nprobe=4, metric="IP")) == rows(search.knn_exact(queries, vectors, 3, "IP"))


def test_ivf_with_codes(data, tmp_path, monkeypatch):
    x, vectors, queries = data
    index = ann.ivf_build(vectors, n_lists=4, max_iter=5, sample_rate=20, list_rows=30)
    exact = rows(search.knn_exact(queries, vectors, 3, "L2"))
    bytes_ = ann.ivf_coded(index, "sq8", path=str(tmp_path / "sq8"))
    products = ann.ivf_coded(index, "pq", m=4)  # 300 sub-vectors of two values, 256 entries: nearly exact
    assert "vector" not in bytes_.rows.columns and "vector" not in products.rows.columns
    for coded in (bytes_, products):
        assert rows(ann.ivf_search(queries, coded, 3, nprobe=4, rescore=vectors)) == exact
    # scores by table equal the distances to what the codes stand for
    stands = {r["id"]: products.centroids[r["list_id"]] + products.coder.decode(np.frombuffer(r["codes"], np.uint8)[None])[0] for r in products.rows.collect()}
    hits = ann.ivf_search(queries, products, 5, nprobe=4).collect()
    assert hits and all(abs(h["score"] - ((x[h["qid"]] - stands[h["id"]]) ** 2).sum()) < 1e-6 for h in hits)
    whole = rows(ann.ivf_search(queries, products, 4, nprobe=2))
    monkeypatch.setattr(search, "QUERY_BYTES", 3 * 64)
    monkeypatch.setattr(search, "SCORE_CELLS", 10)
    assert rows(ann.ivf_search(queries, products, 4, nprobe=2)) == whole
    with pytest.raises(ValueError):
        ann.ivf_search(queries, products, 3, metric="cosine")
    for metric, of in (("IP", lambda q, v: q @ v), ("COSINE", lambda q, v: q @ v / np.linalg.norm(q) / np.linalg.norm(v))):
        for coded in (products, bytes_):
            stand = stands if coded is products else {i: np.array(v) for i, v in ann.sq8_decoded(bytes_.coder).select("id", "vector").collect()}
            hits = ann.ivf_search(queries, coded, 5, nprobe=4, metric=metric).collect()
            assert hits and all(abs(h["score"] - of(x[h["qid"]], stand[h["id"]])) < 1e-6 for h in hits)
    none = ann.ivf_build(vectors.where("false"))
    assert [ann.ivf_search(queries, ann.ivf_coded(none, c), 3).count() for c in ("pq", "sq8")] == [0, 0]


def test_sq8(data):
    x, vectors, queries = data
    sq = ann.sq8_encode(vectors)
    back = {r["id"]: np.array(r["vector"]) for r in ann.sq8_decoded(sq).collect()}
    assert all((abs(back[i] - x[i]) <= sq.step / 2 + 1e-9).all() for i in range(300))
    exact = search.knn_exact(queries, vectors, 5, "IP")
    assert rows(ann.sq8_search(queries, sq, 5, rescore=vectors, metric="IP")) == rows(exact)


def test_pq(data):
    _, vectors, queries = data
    some = vectors.where("id < 200")
    full = ann.pq_build(some, m=4)  # no more distinct sub-vectors than entries: exact
    assert rows(ann.pq_search(queries.where("qid < 200"), full, 5)) == rows(search.knn_exact(queries.where("qid < 200"), some, 5, "L2"))
    coarse = ann.pq_search(queries, ann.pq_build(vectors, m=4, bits=5), 10)
    recall = search.recall_at_k(coarse, search.knn_exact(queries, vectors, 10)).agg({"recall": "avg"}).first()[0]
    assert recall > 0.3


def _clustered(spark, n=6000, centres=40, dim=16):
    rng = np.random.default_rng(11)
    at = rng.standard_normal((centres, dim)) * 3
    of = np.where(np.arange(n) % 2 == 0, 0, rng.integers(0, centres, n))  # a cluster of half the rows
    x = (at[of] + rng.standard_normal((n, dim)) * 0.5).astype(np.float32).astype(float)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)


def test_a_measured_recall_curve_keeps_the_scan_small(spark):
    x, vectors = _clustered(spark)
    index = ann.ivf_build(vectors, n_lists=64, max_iter=10, list_rows=200)
    assert index.sizes.sum() == 6000 and index.sizes.max() > 200
    asked = vectors.where("id % 97 = 0").withColumnRenamed("id", "qid")
    exact = search.knn_exact(asked, vectors, 10).persist()
    curve = ann.probe_curve(asked, index, exact)
    assert [p for p, _, _ in curve] == list(range(1, 65)) and curve[-1][1:] == (1.0, 1.0)
    assert all(a[1] <= b[1] and a[2] <= b[2] for a, b in zip(curve, curve[1:]))
    nprobe = ann.choose_nprobe(curve, 0.95)
    told, scanned = curve[nprobe - 1][1:]
    found = search.recall_at_k(ann.ivf_search(asked, index, 10, nprobe), exact).agg({"recall": "avg"}).first()[0]
    assert found == pytest.approx(told) and found >= 0.95 and scanned <= 0.25
    # queries that the curve was not measured on
    others = vectors.where("id % 89 = 1").withColumnRenamed("id", "qid")
    recall = search.recall_at_k(ann.ivf_search(others, index, 10, nprobe), search.knn_exact(others, vectors, 10)).agg({"recall": "avg"}).first()[0]
    assert recall >= 0.9
    assert ann.choose_nprobe([(1, 0.2, 0.1), (2, 0.5, 1.0)], 0.9) == 2


def test_a_list_of_half_the_rows_is_several_tasks_work(spark):
    _, vectors = _clustered(spark, 4000, 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one task's again
    try:
        index = ann.ivf_build(vectors, n_lists=3, max_iter=5, list_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = int(index.sizes.argmax())
    of = [r[0] for r in index.rows.where(F.col("list_id") == hot).select("bucket").distinct().collect()]
    assert len(of) == -(-index.sizes[hot] // 100) and index.sizes[hot] >= 2000
    by_file = [r["count"] for r in index.rows.where(F.col("list_id") == hot).groupBy(F.input_file_name()).count().collect()]
    assert max(by_file) < index.sizes[hot] / 2


def test_product_codes_for_every_metric(spark):
    x, vectors = _clustered(spark, 3000, 30)
    asked = vectors.where("id % 101 = 0").withColumnRenamed("id", "qid")
    pq = ann.pq_build(vectors, m=8, bits=6)
    stands = {r["id"]: pq.decode(np.frombuffer(r["codes"], np.uint8)[None])[0] for r in pq.codes.collect()}
    scores = {"L2": lambda q, v: ((q - v) ** 2).sum(), "IP": lambda q, v: q @ v, "COSINE": lambda q, v: q @ v / np.linalg.norm(q) / np.linalg.norm(v)}
    for metric, of in scores.items():
        hits = ann.pq_search(asked, pq, 10, metric=metric)
        assert all(abs(h["score"] - of(x[h["qid"]], stands[h["id"]])) < 1e-6 for h in hits.collect())
        best = ann.pq_search(asked, pq, 10, rescore=vectors, widen=8, metric=metric)
        recall = search.recall_at_k(best, search.knn_exact(asked, vectors, 10, metric)).agg({"recall": "avg"}).first()[0]
        assert recall >= 0.9, metric
    with pytest.raises(ValueError):
        ann.pq_search(asked, pq, 10, metric="IQ")


def test_codebooks_are_trained_by_sums_of_the_executors(spark, monkeypatch):
    """The driver sees sums of one size whatever the sample holds, and a book's error falls with its entries."""
    x, vectors = _clustered(spark, 2000, 30)
    seen = []
    plain = ann._entry_sums
    monkeypatch.setattr(ann, "_entry_sums", lambda *a: (seen.append(a[1].shape), plain(*a))[1])
    errors = []
    for bits in (2, 4, 6):
        pq = ann.pq_build(vectors, m=4, bits=bits)
        stands = {r["id"]: pq.decode(np.frombuffer(r["codes"], np.uint8)[None])[0] for r in pq.codes.collect()}
        errors.append(np.mean([((x[i] - v) ** 2).sum() for i, v in stands.items()]))
        assert set(seen) == {(4, 2**bits, 4)} and len(seen) <= 24
        seen.clear()
    assert errors[0] > 2 * errors[1] > 2 * errors[2]


def test_byte_codes_are_searched_without_decoding(data):
    x, vectors, queries = data
    sq = ann.sq8_encode(vectors)
    stands = {r["id"]: np.array(r["vector"]) for r in ann.sq8_decoded(sq).collect()}
    for metric in ("L2", "IP", "COSINE"):
        found = ann.sq8_search(queries, sq, 7, metric=metric)
        exact = search.knn_exact(queries, ann.sq8_decoded(sq), 7, metric)
        assert rows(found) == rows(exact)
        assert len(stands) == 300 and found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 2  # codes made, codes met


def test_contexts_and_reports(spark):
    hits = spark.createDataFrame([(1, 1, 5, 0.5, "b\n\n\nc"), (1, 0, 6, 0.4, "a"), (2, 0, 5, 0.1, None)], "qid long, rank int, id long, score double, text string")
    got = {r["qid"]: r["contexts"] for r in search.format_contexts(hits).collect()}
    assert got[1] == ["Source #0\nDetail: a\n", "Source #1\nDetail: b\nc\n"] and got[2] == ["Source #0\nDetail: \n"]
    assert {(r["qid"], r["n_hits"]) for r in search.search_report(hits).collect()} == {(1, 2), (2, 1)}


def test_rerank(spark):
    hits = spark.createDataFrame([(1, r, f"d{r}", s) for r, s in enumerate([0.1, 0.9, 0.9, 0.5])], "qid long, rank int, text string, s double")
    got = rerank.rerank(hits, hits["s"], 3).orderBy("new_rank").collect()
    assert [r["text"] for r in got] == ["d1", "d2", "d3"]
    by_model = rerank.rerank(hits, lambda: lambda b: b["s"] * -1, 1).collect()
    assert [r["text"] for r in by_model] == ["d0"]


def test_late_interaction(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(12, 4)), rng.normal(size=(2, 3, 4))
    patches = spark.createDataFrame([(i // 3, i % 3, v.tolist()) for i, v in enumerate(p)], "doc_id long, seq_id int, vector array<double>")
    asked = spark.createDataFrame([(i, t, q[i, t].tolist()) for i in range(2) for t in range(3)], "qid long, tok int, vector array<double>")
    candidates = rerank.candidate_docs(asked, patches, 2)
    want = {(i, int(d)) for i in range(2) for t in range(3) for d in np.argsort(-(p @ q[i, t]))[:2] // 3}
    assert {tuple(r) for r in candidates.collect()} == want
    every = patches.select("doc_id").distinct().crossJoin(asked.select("qid").distinct())
    got = {(r["qid"], r["doc_id"]): r["score"] for r in rerank.maxsim(asked, patches, every).collect()}
    for (i, d), s in got.items():
        assert s == pytest.approx((q[i] @ p[3 * d : 3 * d + 3].T).max(axis=1).sum())
    assert rerank.maxsim(asked, patches, every, 1).count() == 2


def test_late_interaction_by_matrices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(90, 4)), rng.normal(size=(3, 5, 4))
    docs = np.sort(rng.integers(0, 6, 90))
    rows_ = [(int(d), int(i), v.tolist()) for i, (d, v) in enumerate(zip(docs, p))]
    patches = spark.createDataFrame(rows_ + [(2, 500, None), (7, 0, [1.0, 2.0])], "doc_id long, seq_id int, vector array<double>")
    asked = spark.createDataFrame([(i, t, q[i, t].tolist()) for i in range(3) for t in range(5)] + [(9, 0, None)], "qid long, tok int, vector array<double>")
    pairs = spark.createDataFrame([(i, d) for i in (0, 1, 2, 9) for d in range(8)] * 2, "qid long, doc_id long")
    want = {(i, int(d)): (q[i] @ p[docs == d].T).max(axis=1).sum() for i in range(3) for d in set(docs.tolist())}
    matrices = rerank.patch_matrices(patches, "late_patches", buckets=3)
    for held in (patches, matrices):
        got = {(r["qid"], r["doc_id"]): r["score"] for r in rerank.maxsim(asked, held, pairs).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # a document's parts, a query block each, tiles
    monkeypatch.setattr(rerank, "MATRIX_ROWS", 4)
    monkeypatch.setattr(rerank, "SCORE_CELLS", 50)
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    parts = rerank.patch_matrices(patches)
    assert parts.where("part > 0").count() > 0
    again = {(r["qid"], r["doc_id"]): r["score"] for r in rerank.maxsim(asked, parts, pairs).collect()}
    assert again.keys() == want.keys() and all(again[k] == pytest.approx(want[k]) for k in want)
    assert rerank.maxsim(asked.where("false"), patches, pairs).count() == 0 == rerank.maxsim(asked, patches.where("false"), pairs).count()


def test_stored_patches_are_not_moved(spark):
    rows_ = [(d, s, [float(d), float(s)]) for d in range(40) for s in range(3)]
    patches = spark.createDataFrame(rows_, "doc_id long, seq_id int, vector array<double>")
    asked = patches.where("doc_id < 2").selectExpr("doc_id as qid", "seq_id as tok", "vector")
    matrices = rerank.patch_matrices(patches, "kept_patches", buckets=4)
    pairs = patches.selectExpr("doc_id % 2 as qid", "doc_id").distinct()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rerank.maxsim(asked, matrices, pairs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # no row a patch and token, no shuffle of what holds a matrix, by document or by query
    assert "matrix" in plan and "Generate" not in plan and "SelectedBucketsCount: 4 out of 4" in plan
    moved = [line for line in plan.splitlines() if "Exchange" in line and "matrix" in line]
    scan = next(i for i, line in enumerate(plan.splitlines()) if "SelectedBucketsCount" in line)
    above = plan.splitlines()[:scan]
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not moved and not any("Exchange" in line for line in above[join:] if line.count(":") == above[join].count(":"))


def test_candidates_of_large_patch_numbers(spark):
    patches = spark.createDataFrame([(5, 1 << 30, [1.0, 0.0]), (6, 3, [0.0, 1.0])], "doc_id long, seq_id long, vector array<double>")
    asked = spark.createDataFrame([(1, 0, [2.0, 0.0])], "qid long, tok int, vector array<double>")
    assert [tuple(r) for r in rerank.candidate_docs(asked, patches, 1).collect()] == [(1, 5)]
    with pytest.raises(ValueError):
        rerank.candidate_docs(asked, patches.withColumn("doc_id", F.lit(1 << 40)), 1)


def test_prompts(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "{n}")], "qid long, question string")
    ctx = spark.createDataFrame([(1, ["a", "b"])], "qid long, contexts array<string>")
    got = {r["qid"]: r["prompt"] for r in prompts.build_prompts(asked, ctx, "{n}|{contexts}|{question}").collect()}
    assert got == {1: "2|a\nb|why?", 2: "0||{n}"}
    pages = spark.createDataFrame([(1, 1, "y.png"), (1, 0, "x.png")], "qid long, rank int, image string")
    told = {r["qid"]: r["message"] for r in prompts.build_image_prompts(asked, pages).collect()}
    assert told[1] == '{"role":"user","content":[{"type":"image","image":"x.png"},{"type":"image","image":"y.png"},{"type":"text","text":"why?"}]}'
    out = prompts.apply_model(asked, lambda: lambda xs: [x.upper() for x in xs], "question").collect()
    assert {r["response"] for r in out} == {"WHY?", "{N}"}
    with pytest.raises(Exception, match="outputs for"):
        prompts.apply_model(asked, lambda: lambda xs: [], "question").collect()


def test_metrics(spark):
    assert evaluation.sentence_bleu("a b c d e", "a b c d e") == pytest.approx(1) and evaluation.sentence_bleu("a b", "c d") == 0
    assert evaluation.sentence_bleu("a b c d", "a b c d e f g h") == pytest.approx(np.exp(-1)) and evaluation.sentence_bleu(None, "") == 1
    df = spark.createDataFrame([(1, "A b, c", "a b d", ["x a", "b d", "q"]), (2, "", "", [])], "qid long, response string, reference string, retrieved_contexts array<string>")
    f1 = {r["qid"]: tuple(r)[1:] for r in evaluation.answer_f1(df).collect()}
    assert f1[1] == pytest.approx((2 / 3, 2 / 3, 2 / 3)) and f1[2] == (0, 0, 0)
    got = {r["qid"]: r for r in evaluation.context_precision(evaluation.context_recall(df), 0.5).collect()}
    assert got[1]["context_recall"] == 1 and got[1]["context_precision"] == pytest.approx(0.5) and got[2]["context_precision"] == 0
    summary = {r["metric"]: r["mean"] for r in evaluation.eval_summary(spark.createDataFrame([(1.0, None), (2.0, 4.0)], "a double, b double"), ["a", "b"]).collect()}
    assert summary == {"a": 1.5, "b": 4.0}


def test_registered_indexes_reach_their_recall(spark):
    from ragspark.plans import search_queries as plans

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    searches = [(plans.e4_ivf_search, "IP"), (plans.e4_ivf_pq_search, "IP"), (plans.e4_ivf_sq8_search, "IP"), (plans.e6_pq_search, "L2"), (plans.e6_pq_search_ip, "IP")]
    for found, metric in searches:
        exact = search.knn_exact(plans._queries(spark, sf), plans._vectors(spark, sf), 10, metric)
        recall = search.recall_at_k(found(spark, sf), exact).agg({"recall": "avg"}).first()[0]
        print(found.__name__, recall)
        assert recall >= 0.9


def test_built_in_search_compiles_its_scores_and_ranks_few(spark):
    """Zero, null, short and NaN vectors, copies and long vectors: as by matrices; no row-by-row lambda, and a bound on what is ranked."""
    rng = np.random.default_rng(3)
    for dim in (5, search.SPELLED + 2):
        held = [(i, rng.normal(size=dim).round(1).tolist()) for i in range(300)]
        held += [(300 + i, held[7][1]) for i in range(20)] + [(400, [0.0] * dim), (401, None), (402, [1.0]), (403, [float("nan")] * dim)]
        vectors = spark.createDataFrame(held, "id long, vector array<float>")
        queries = spark.createDataFrame([x for x in held if x[0] % 40 == 0], "qid long, vector array<float>")
        for metric in ("L2", "IP", "COSINE"):
            got, want = (rows(f(queries, vectors, 6, metric)) for f in (search.knn_exact_sql, search.knn_exact))
            assert got == want
        assert search.knn_exact_sql(queries.where("qid < 0"), vectors, 6, "COSINE").count() == 0 == search.knn_exact_sql(queries, vectors.where("id < 0"), 6).count()
    plan = search.knn_exact_sql(queries.select("qid", F.slice("vector", 1, 5).alias("vector")), vectors.select("id", F.slice("vector", 1, 5).alias("vector")), 6, "IP")
    said = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in said and "kth" in said

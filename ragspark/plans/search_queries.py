"""Queries of search, reranking, prompts and evaluation.

Queries of a search are all vectors whose id is divisible by 50; questions come from the conversations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ragspark.operators import ann, evaluation, prompts, rerank, search
from ragspark.operators.encoding import HashingEncoder, encode
from ragspark.operators.position import with_position
from ragspark.plans.corpus_queries import QUESTIONS
from ragspark.plans.registry import query, table
from ragspark.sources import corpus
from ragspark.storage import written


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _queries(spark, sf_dir):
    return _vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")


def _knn_sql(k: int, metric: str) -> str:
    a, b = "q.embedding::double[]", "v.embedding::double[]"
    score = {"L2": f"list_distance({a}, {b}) ** 2", "IP": f"list_dot_product({a}, {b})", "COSINE": f"list_cosine_similarity({a}, {b})"}[metric]
    order = "asc" if metric == "L2" else "desc"
    return f"""select qid, rank, id, round(score, 4) as score from (
      select q.vec_id as qid, v.vec_id as id, {score} as score, (row_number() over (partition by q.vec_id order by {score} {order}, v.vec_id) - 1)::int as rank
      from embeddings q, embeddings v where q.vec_id % 50 = 0) where rank < {k}"""


@query(_knn_sql(10, "IP"))
def e1_knn_exact(spark, sf_dir):
    hits = search.knn_exact(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, "IP")
    return hits.withColumn("score", F.round("score", 4))


@query(_knn_sql(10, "L2").replace("round(score, 4)", "abs(round(score, 4))"))
def e1_knn_exact_l2(spark, sf_dir):
    hits = search.knn_exact(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, "L2")
    return hits.withColumn("score", F.abs(F.round("score", 4)))


@query(_knn_sql(5, "COSINE"))
def e2_knn_exact_sql(spark, sf_dir):
    hits = search.knn_exact_sql(_queries(spark, sf_dir), _vectors(spark, sf_dir), 5, "COSINE")
    return hits.withColumn("score", F.round("score", 4))


@query()
def e3_ivf_build(spark, sf_dir):
    """Sizes of the lists of trained centroids."""
    index = ann.ivf_build(_vectors(spark, sf_dir), n_lists=16, max_iter=10)
    return index.rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


def _given(spark, sf_dir):
    """An index whose centroids are the first sixteen vectors."""
    first = _vectors(spark, sf_dir).where("id < 16").orderBy("id").collect()
    return ann.ivf_build(_vectors(spark, sf_dir), centroids=np.array([r["vector"] for r in first], float))


_LISTS = """(select v.vec_id, arg_min(c.vec_id, (list_distance(v.embedding::double[], c.embedding::double[]), c.vec_id)) as list_id
    from embeddings v, embeddings c where c.vec_id < 16 group by 1)"""


@query(f"select list_id::int as list_id, count(*) as n from {_LISTS} group by 1")
def e3_ivf_given_centroids(spark, sf_dir):
    """Sizes of the lists of given centroids."""
    return _given(spark, sf_dir).rows.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with probes as (select qid, list_id from (select q.vec_id as qid, c.vec_id as list_id,
      row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], c.embedding::double[]), c.vec_id) as n
      from embeddings q, embeddings c where q.vec_id % 50 = 0 and c.vec_id < 16) where n <= 5)
    select qid, rank, id, round(s, 4) as score from (select p.qid, v.vec_id as id, list_dot_product(q.embedding::double[], v.embedding::double[]) as s,
      (row_number() over (partition by p.qid order by s desc, v.vec_id) - 1)::int as rank
      from probes p join {_LISTS} l using (list_id) join embeddings v on v.vec_id = l.vec_id join embeddings q on q.vec_id = p.qid) where rank < 10""")
def e4_ivf_given_centroids(spark, sf_dir):
    """Search of five lists of given centroids."""
    hits = ann.ivf_search(_queries(spark, sf_dir), _given(spark, sf_dir), 10, nprobe=5, metric="IP")
    return hits.withColumn("score", F.round("score", 4))


def _trained(spark, sf_dir):
    """(index, nprobe): sixteen lists, as many of them probed as other queries than the searched ones need for a recall of 0.95."""
    vectors = _vectors(spark, sf_dir)
    index = ann.ivf_build(vectors, n_lists=16, max_iter=10)
    asked = vectors.where("id % 50 = 25").withColumnRenamed("id", "qid")
    return index, ann.choose_nprobe(ann.probe_curve(asked, index, written(search.knn_exact(asked, vectors, 10, "IP"))), 0.95)


@query()
def e4_probe_curve(spark, sf_dir):
    """Recall and share of rows read for each number of lists probed."""
    vectors = _vectors(spark, sf_dir)
    index = ann.ivf_build(vectors, n_lists=16, max_iter=10)
    curve = ann.probe_curve(_queries(spark, sf_dir), index, written(search.knn_exact(_queries(spark, sf_dir), vectors, 10, "IP")))
    return spark.createDataFrame(curve, "nprobe int, recall double, scanned double")


@query()
def e4_ivf_search(spark, sf_dir):
    index, nprobe = _trained(spark, sf_dir)
    return ann.ivf_search(_queries(spark, sf_dir), index, 10, nprobe, metric="IP")


@query()
def e4_ivf_pq_search(spark, sf_dir):
    """Lists that hold product codes, the best hits scored again by the true vectors."""
    index, nprobe = _trained(spark, sf_dir)
    return ann.ivf_search(_queries(spark, sf_dir), ann.ivf_coded(index, "pq", m=16), 10, nprobe, metric="IP", rescore=_vectors(spark, sf_dir), widen=8)


@query()
def e4_ivf_sq8_search(spark, sf_dir):
    """Lists that hold a byte a dimension."""
    index, nprobe = _trained(spark, sf_dir)
    return ann.ivf_search(_queries(spark, sf_dir), ann.ivf_coded(index, "sq8"), 10, nprobe, metric="IP", rescore=_vectors(spark, sf_dir))


_ENDS = """(select list(lo order by i) as lo, list(greatest((hi - lo) / 255, 1e-12) order by i) as step from (
    select i, min(embedding[i])::double as lo, max(embedding[i])::double as hi from embeddings, range(1, 65) r(i) group by i))"""
_DECODED = f"""(select vec_id, list_transform(range(1, 65), lambda i: lo[i] + step[i] * round_even((embedding[i]::double - lo[i]) / step[i], 0)) as v
    from embeddings, {_ENDS})"""


@query(f"""with wide as (select * from (select q.vec_id as qid, d.vec_id as id, q.embedding::double[] as q,
      row_number() over (partition by q.vec_id order by list_dot_product(q.embedding::double[], d.v) desc, d.vec_id) as n
      from embeddings q, {_DECODED} d where q.vec_id % 50 = 0) where n <= 40),
    scored as (select qid, id, list_dot_product(q, embedding::double[]) as s from wide join embeddings on vec_id = id)
    select qid, rank, id, round(s, 4) as score from (
      select *, (row_number() over (partition by qid order by s desc, id) - 1)::int as rank from scored) where rank < 10""")
def e5_sq8_search(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    hits = ann.sq8_search(_queries(spark, sf_dir), ann.sq8_encode(vectors), 10, rescore=vectors, metric="IP")
    return hits.withColumn("score", F.round("score", 4))


@query()
def e6_pq_search(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return ann.pq_search(_queries(spark, sf_dir), ann.pq_build(vectors, m=16), 10, rescore=vectors, widen=8)


@query()
def e6_pq_search_ip(spark, sf_dir):
    """Product codes by inner product."""
    vectors = _vectors(spark, sf_dir)
    return ann.pq_search(_queries(spark, sf_dir), ann.pq_build(vectors, m=16), 10, rescore=vectors, widen=8, metric="IP")


_CODED = """(select vec_id, flatten(list(c order by i)) as v from (select v.vec_id, i,
      arg_min(b.embedding[16 * i + 1:16 * i + 16]::double[], (list_distance(v.embedding[16 * i + 1:16 * i + 16]::double[], b.embedding[16 * i + 1:16 * i + 16]::double[]), b.vec_id)) as c
      from embeddings v, embeddings b, range(4) r(i) where b.vec_id < 16 group by all) group by vec_id)"""


@query(f"""select qid, rank, id, round(s, 4) as score from (select q.vec_id as qid, d.vec_id as id, list_dot_product(q.embedding::double[], d.v) as s,
      (row_number() over (partition by q.vec_id order by round(s, 9) desc, d.vec_id) - 1)::int as rank
      from embeddings q, {_CODED} d where q.vec_id % 50 = 0) where rank < 10""")
def e6_pq_given_books(spark, sf_dir):
    """Search by inner product over codes of given books: the quarters of the first sixteen vectors."""
    first = np.array([r["vector"] for r in _vectors(spark, sf_dir).where("id < 16").orderBy("id").collect()], float)
    pq = ann.pq_build(_vectors(spark, sf_dir), m=4, books=first.reshape(16, 4, 16).transpose(1, 0, 2))
    return ann.pq_search(_queries(spark, sf_dir), pq, 10, metric="IP").withColumn("score", F.round("score", 4))


def _hits(spark, sf_dir):
    """Each benchmark item's documents with the most tokens in common is a search of its own; here: vector hits with texts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return written(search.knn_exact(_queries(spark, sf_dir), _vectors(spark, sf_dir), 10, "IP").join(docs, "id"))


_HITS = f"(select h.*, d.text from ({_knn_sql(10, 'IP')}) h join documents d on d.doc_id = h.id)"
_CONTEXT = "'Source #' || rank || chr(10) || 'Detail: ' || regexp_replace(text, '\\n+', chr(10), 'g') || chr(10)"


@query(f"select qid, md5(string_agg({_CONTEXT}, '|' order by rank)) as contexts_md5, count(*) as n from {_HITS} group by qid")
def e7_format_contexts(spark, sf_dir):
    found = search.format_contexts(_hits(spark, sf_dir))
    return found.select("qid", F.md5(F.array_join("contexts", "|")).alias("contexts_md5"), F.size("contexts").cast("long").alias("n"))


@query(f"select qid, count(*) over (partition by qid) as n_hits, rank, id, score as distance, length(text)::int as text_length from {_HITS}")
def e8_search_report(spark, sf_dir):
    return search.search_report(_hits(spark, sf_dir)).withColumn("distance", F.round("distance", 4))


@query(f"""with e as ({_knn_sql(10, 'IP')}), a as ({_knn_sql(10, 'IP').replace("where q.vec_id % 50 = 0", "where q.vec_id % 50 = 0 and v.vec_id % 3 <> 1")})
    select qid, round(avg((a.id is not null)::int), 4) as recall from e left join a using (qid, id) group by qid""")
def e9_recall_at_k(spark, sf_dir):
    """A search that leaves out a third of the vectors, against one of all."""
    q, v = _queries(spark, sf_dir), _vectors(spark, sf_dir)
    found = search.recall_at_k(search.knn_exact(q, v.where("id % 3 <> 1"), 10, "IP"), search.knn_exact(q, v, 10, "IP"))
    return found.withColumn("recall", F.round("recall", 4))


_TOKENS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


def _candidates(spark, sf_dir):
    """Benchmark items beside the documents that their vectors find: (qid, rank, question, id, text)."""
    hits = _hits(spark, sf_dir).select(F.col("qid"), "rank", "id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return hits.join(items, "qid")


_SHARE = f"""(select *, case when len(q) > 0 then len(list_intersect(q, t)) / len(q) else 0.0 end as share from (
    select h.qid, rank, h.id, {_TOKENS.format('b.text')} as q, {_TOKENS.format('h.text')} as t from {_HITS} h join benchmark b on b.item_id = h.qid))"""


@query(f"""select qid, new_rank, id, rank, round(share, 4) as rerank_score from (
    select *, (row_number() over (partition by qid order by share desc, rank) - 1)::int as new_rank from {_SHARE}) where new_rank < 5""")
def f1_rerank(spark, sf_dir):
    told = rerank.rerank(_candidates(spark, sf_dir), rerank.lexical_overlap_scorer("question", "text"), 5)
    return told.select("qid", "new_rank", "id", "rank", F.round("rerank_score", 4).alias("rerank_score"))


@query(f"select qid, id, round(share, 4) as score from {_SHARE}")
def f2_lexical_overlap(spark, sf_dir):
    return _candidates(spark, sf_dir).select("qid", "id", F.round(rerank.lexical_overlap_scorer("question", "text"), 4).alias("score"))


def _patches(spark, sf_dir):
    """Embeddings as patches of pages of eight, and the patches of every fiftieth page as the tokens of a query."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).cast("long").alias("doc_id"), (F.col("vec_id") % 8).cast("int").alias("seq_id"), F.col("embedding").alias("vector")
    )
    asked = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.col("seq_id").alias("tok"), "vector")
    return asked, rows


_PAIRS = """(select q.vec_id // 8 as qid, q.vec_id % 8 as tok, v.vec_id // 8 as doc_id, v.vec_id as id,
    list_dot_product(q.embedding::double[], v.embedding::double[]) as s from embeddings q, embeddings v where (q.vec_id // 8) % 50 = 0)"""
_CANDIDATES = f"(select distinct qid, doc_id from (select *, row_number() over (partition by qid, tok order by s desc, id) as n from {_PAIRS}) where n <= 50)"


@query(f"select qid, doc_id from {_CANDIDATES}")
def f3_candidate_docs(spark, sf_dir):
    return rerank.candidate_docs(*_patches(spark, sf_dir), k=50)


@query(f"""select qid, rank, doc_id, round(score, 4) as score from (
    select *, (row_number() over (partition by qid order by score desc, doc_id) - 1)::int as rank from (
    select qid, doc_id, sum(m) as score from (select qid, tok, doc_id, max(s) as m from {_PAIRS} join {_CANDIDATES} using (qid, doc_id) group by all)
    group by all)) where rank < 10""")
def f4_maxsim(spark, sf_dir):
    asked, patches = _patches(spark, sf_dir)
    matrices = written(rerank.patch_matrices(patches))
    found = rerank.maxsim(asked, matrices, written(rerank.candidate_docs(asked, patches, 50)), 10)
    return found.withColumn("score", F.round("score", 4))


@query(f"""select b.item_id as qid, md5('Answer from the passages below.' || chr(10) || 'Passages (' || coalesce(n, 0) || '):' || chr(10) || coalesce(c, '') || chr(10)
    || 'Question: ' || b.text || chr(10) || 'Answer:') as prompt_md5
    from benchmark b left join (select qid, count(*) as n, string_agg({_CONTEXT}, chr(10) order by rank) as c from {_HITS} group by qid) h on h.qid = b.item_id""")
def g1_build_prompts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return prompts.build_prompts(items, search.format_contexts(_hits(spark, sf_dir))).select("qid", F.md5("prompt").alias("prompt_md5"))


@query("""select p as qid, '{"role":"user","content":[' || string_agg('{"type":"image","image":"' || page_id || '.png"}', ',' order by page_id)
    || ',{"type":"text","text":"page ' || p || '"}]}' as message from (select page_id, page_id // 3 as p from pages) group by p""")
def g2_build_image_prompts(spark, sf_dir):
    page = F.floor(F.col("page_id") / 3).cast("long")
    pages = table(spark, sf_dir, "pages").select(
        page.alias("qid"), F.col("page_id").alias("rank"), F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("image")
    )
    asked = pages.select("qid").distinct().withColumn("question", F.concat(F.lit("page "), F.col("qid").cast("string")))
    return prompts.build_image_prompts(asked, pages)


@query("select item_id as qid, length(text)::bigint as n, text[:8] || '?' as response from benchmark")
def g3_apply_model(spark, sf_dir):
    """A model that asks back the first eight characters."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("prompt"))
    told = prompts.apply_model(items, lambda: lambda texts: [t[:8] + "?" for t in texts])
    return told.select("qid", F.length("prompt").cast("long").alias("n"), "response")


def _questions(spark, sf_dir):
    turns = corpus.question_answers(table(spark, sf_dir, "conversations"))
    return with_position(turns, ["conv_id", "turn"], name="qid").select("qid", "question", "ground_truth")


def _evaluated(spark, sf_dir):
    """Answers to the conversations' questions: the question itself as response, the truth as the only context of even ones."""
    asked = written(_questions(spark, sf_dir))
    contexts = asked.where("qid % 2 = 0").select("qid", F.array("ground_truth", "question").alias("contexts"))
    return prompts.eval_dataset(asked, asked.select("qid", F.col("question").alias("response")), contexts)


@query(f"""select qid, question as user_input, question as response, ground_truth as reference,
    case when qid % 2 = 0 then 2 else 0 end::bigint as n_contexts from {QUESTIONS}""")
def g4_eval_dataset(spark, sf_dir):
    found = _evaluated(spark, sf_dir)
    return found.select("qid", "user_input", "response", "reference", F.size("retrieved_contexts").cast("long").alias("n_contexts"))


_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"
_GRAMS = "(select qid, n, array_to_string(x[i:i + n - 1], ' ') as g, count(*) as c from (select qid, {0} as x, n, unnest(range(1, len({0}) - n + 2)) as i from w, range(1, 5) r(n)) group by all)"


@query(f"""with w as (select qid, {_WORDS.format('question')} as a, {_WORDS.format('ground_truth')} as b from {QUESTIONS}),
    met as (select x.qid, x.n, sum(least(x.c, y.c)) as c from {_GRAMS.format('a')} x join {_GRAMS.format('b')} y using (qid, n, g) group by all),
    told as (select w.qid, a, b, ln(coalesce(c, 0.0) / (len(a) - r.n + 1) + 1e-300) as p, coalesce(c, 0) as c
      from w join range(1, 5) r(n) on r.n <= len(a) left join met on met.qid = w.qid and met.n = r.n)
    select w.qid, round(case when len(w.a) = 0 or len(w.b) = 0 then (len(w.a) = len(w.b))::int::double when t.least = 0 then 0.0
      else least(1.0, exp(1 - len(w.b) / len(w.a))) * exp(t.p) end, 4) as bleu
    from w left join (select qid, min(c) as least, avg(p) as p from told group by qid) t on t.qid = w.qid""")
def g5_bleu(spark, sf_dir):
    return evaluation.bleu(_evaluated(spark, sf_dir)).select("qid", F.round("bleu", 4).alias("bleu"))


_SETS = f"(select *, {_TOKENS.format('ground_truth')} as r, {_TOKENS.format('question')} as q from {QUESTIONS})"
_Q_SHARE = "case when len(r) > 0 then len(list_intersect(r, q)) / len(r) else 0.0 end"


@query(f"""select qid, round({_Q_SHARE}, 4) as context_recall,
    round(case when not useful then 0.0 when qid % 2 = 0 then 1.0 else 0.5 end::double, 4) as context_precision from (select *, {_Q_SHARE} >= 0.1 as useful from {_SETS})""")
def g6_context_metrics(spark, sf_dir):
    """The question as the only context of even rows, behind an empty one of odd rows; useful with a tenth of the truth's tokens."""
    contexts = F.when(F.col("qid") % 2 == 0, F.array("user_input")).otherwise(F.array(F.lit(""), F.col("user_input")))
    asked = _evaluated(spark, sf_dir).withColumn("retrieved_contexts", contexts)
    found = evaluation.context_precision(evaluation.context_recall(asked), 0.1)
    return found.select("qid", F.round("context_recall", 4).alias("context_recall"), F.round("context_precision", 4).alias("context_precision"))


_BAG = "(select qid, t, count(*) as n from (select qid, unnest(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) as t from {1}) group by all)"


@query(f"""with a as {_BAG.format('question', QUESTIONS)}, b as {_BAG.format('ground_truth', QUESTIONS)},
    s as (select qid, sum(least(a.n, b.n)) as s from a join b using (qid, t) group by qid),
    x as (select q.qid, coalesce(s, 0) as s, coalesce((select sum(n) from a where a.qid = q.qid), 0) as a, coalesce((select sum(n) from b where b.qid = q.qid), 0) as b
      from {QUESTIONS} q left join s using (qid))
    select qid, round(case when a > 0 then s / a else 0.0 end, 4) as token_precision, round(case when b > 0 then s / b else 0.0 end, 4) as token_recall,
      round(case when s > 0 then 2 * s / (a + b) else 0.0 end, 4) as token_f1 from x""")
def g7_answer_f1(spark, sf_dir):
    found = evaluation.answer_f1(_evaluated(spark, sf_dir))
    return found.select("qid", *(F.round(c, 4).alias(c) for c in ("token_precision", "token_recall", "token_f1")))


@query("""select 'quality' as metric, round(avg(quality), 4) as mean from labels union all select 'toxic', round(avg(toxic), 4) from labels""")
def g8_eval_summary(spark, sf_dir):
    return evaluation.eval_summary(table(spark, sf_dir, "labels"), ["quality", "toxic"]).withColumn("mean", F.round("mean", 4))


def entry(spark, sf_dir):
    """Flagship: hashed questions of the conversations, the nearest documents, prompts."""
    asked = encode(_questions(spark, sf_dir).select("qid", "question"), "question", lambda: HashingEncoder(64))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = encode(docs, "text", lambda: HashingEncoder(64))
    hits = search.knn_exact(asked.select("qid", "vector"), index.select("id", "vector"), 5, "IP").join(docs, "id")
    return prompts.build_prompts(asked.select("qid", "question"), search.format_contexts(hits))

"""Queries of sources, chunking, encoding and collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ragspark.functions.text import sanitized_name
from ragspark.operators import buckets, chunking, collections, encoding
from ragspark.plans.registry import query, table
from ragspark.sources import corpus
from ragspark.storage import scratch


@query("select text as content, doc_id as metadata from documents")
def a1_load_corpus(spark, sf_dir):
    return corpus.load_corpus(spark, f"{sf_dir}/documents.parquet", "text", "doc_id")


@query("select doc_id, lang, n_chars from (select *, row_number() over (order by doc_id) - 1 as p from documents) where p >= 100 and p < 150")
def a2_dataset_slice(spark, sf_dir):
    return corpus.dataset_slice(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 50, 2, "doc_id")


@query("""select doc_id, lang, n_chars from (select *, row_number() over (order by doc_id) as p, count(*) over () as n from documents)
    where p <= floor(n * 0.25)""")
def a3_dataset_ratio(spark, sf_dir):
    return corpus.dataset_ratio(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), 0.25, "doc_id")


@query("select 'role=' || role as folder, 1::bigint as n_files, true as in_order from conversations group by role")
def a4_list_files(spark, sf_dir):
    """The conversations' texts written as a text file a role: files by folder, and whether they are listed by name."""
    path = scratch(spark)
    table(spark, sf_dir, "conversations").select("role", "text").repartition(1).write.partitionBy("role").text(path)
    files = corpus.list_files(spark, path, "*.txt")
    parts = F.split("content", "/")
    names = files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.monotonically_increasing_id().alias("at"))
    order = Window.orderBy("at")  # a row a role
    told = names.withColumn("in_order", F.coalesce(F.lag("name").over(order) <= F.col("name"), F.lit(True)))
    return told.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.bool_and("in_order").alias("in_order"))


@query("""select page_id as id, replace(url, 'arxiv.org/abs/', 'arxiv.org/pdf/') as url, page_id || '.pdf' as filename from pages
    where page_id not in (select doc_id from labels) order by id limit 100""")
def a5_fetch_manifest(spark, sf_dir):
    have = table(spark, sf_dir, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return corpus.fetch_manifest(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), have, 100)


QUESTIONS = """(select row_number() over (order by conv_id, turn) - 1 as qid, text as question, next_text as ground_truth from (
    select *, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn))
    where role = 'user' and next_role = 'assistant')"""


@query(f"select qid, qid // 64 as batch_no, question, ground_truth from {QUESTIONS} where qid < 512")
def a6_question_batches(spark, sf_dir):
    turns = corpus.question_answers(table(spark, sf_dir, "conversations"))
    return corpus.question_batches(turns, 64, 512, ["conv_id", "turn"])


@query("select vec_id, len(embedding) as dim, round(list_sum(embedding::double[]), 4) as total from embeddings")
def a7_save_load_embeddings(spark, sf_dir):
    path = scratch(spark)
    corpus.save_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), path)
    df, dim = corpus.load_embeddings(spark, path)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return df.select("vec_id", F.lit(dim).cast("long").alias("dim"), F.round(total, 4).alias("total"))


@query("select vec_id, label, 2::bigint as copies from embeddings")
def a11_write_collection(spark, sf_dir):
    """Recreate, append the same rows, and a create that keeps what is there."""
    path, rows = scratch(spark), table(spark, sf_dir, "embeddings").select("vec_id", "label")
    for mode in ("recreate", "append", "create"):
        corpus.write_collection(rows, path, mode)
    return spark.read.parquet(path).groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("copies"))


@query("""select item_id, text from benchmark""")
def a12_write_report(spark, sf_dir):
    """A report's rows, read back from its CSV."""
    path = scratch(spark)
    corpus.write_report(table(spark, sf_dir, "benchmark"), path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select(F.col("item_id").cast("long").alias("item_id"), "text")


@query()
def b1_chunk_recursive(spark, sf_dir):
    chunks = chunking.chunk_recursive(table(spark, sf_dir, "documents"), 512, 0)
    return chunks.select("doc_id", "chunk_no", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


@query("""select doc_id, c::int as chunk_no, md5(substring(text, c * 448 + 1, 512)) as text_md5
    from (select *, unnest(range(0, (length(text) - 1) // 448 + 1)) as c from documents where length(text) > 0)""")
def b2_chunk_fixed(spark, sf_dir):
    chunks = chunking.chunk_fixed(table(spark, sf_dir, "documents"), 512, 64)
    return chunks.select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.md5("text").alias("text_md5"))


_LINES = """(select doc_id, (unnest(range(1, len(l) + 1)) - 1)::int as chunk_no, unnest(l) as text from (
    select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents))"""


@query(f"select doc_id, chunk_no, md5(text) as text_md5 from {_LINES}")
def b3_chunk_structural(spark, sf_dir):
    return chunking.chunk_structural(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"))


@query("""select page_id || '.PDF' as name, n::int as page_no, 'out/pages/' || page_id || '_page_' || n || '.png' as path
    from (select page_id, unnest(range(1, page_id % 4 + 1)) as n from pages)""")
def b4_page_manifest(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".PDF")).alias("name"), (F.col("page_id") % 4).cast("int").alias("n_pages")
    )
    other = files.select(F.regexp_replace("name", "PDF$", "txt").alias("name"), "n_pages")
    return chunking.page_manifest(files.unionByName(other), "out").select("name", F.col("page_no").cast("int").alias("page_no"), "path")


@query(f"""select doc_id, count(*) as n_chunks, min(length(text)) as min_len, round(avg(length(text)), 4) as avg_len, max(length(text)) as max_len
    from {_LINES} group by doc_id""")
def b5_chunk_stats(spark, sf_dir):
    found = chunking.chunk_stats(chunking.chunk_structural(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_chunks", F.col("min_len").cast("long").alias("min_len"), F.round("avg_len", 4).alias("avg_len"), F.col("max_len").cast("long").alias("max_len"))


#: CRC-32 (reflected polynomial 0xEDB88320) of a token's UTF-8 bytes, by a table made from the rule
_CRC_TABLE = """(select list(c order by i) as tab from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
    lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) as c from range(256) r(i)))"""
_BYTES = """list_transform(range(0, len(h) // 2), lambda i: (16 * (instr('0123456789ABCDEF', h[2 * i + 1:2 * i + 1]) - 1)
    + instr('0123456789ABCDEF', h[2 * i + 2:2 * i + 2]) - 1)::bigint)"""
_CRC = f"""(select t, xor(list_reduce(list_prepend(4294967295::bigint, {_BYTES}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc
    from (select t, hex(encode(t)) as h from (select distinct t from toks)), {_CRC_TABLE})"""


@query(f"""with toks as (select conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as t from conversations),
    dims as (select conv_id, turn, (crc >> 1) % 32 as d, sum(case when crc % 2 = 1 then 1 else -1 end) as s from toks join {_CRC} using (t) group by all),
    told as (select conv_id, turn, count(*) filter (s > 0) as n_plus, count(*) filter (s < 0) as n_minus, min(d) filter (s <> 0) as first_dim from dims group by all)
    select conv_id, turn, coalesce(n_plus, 0)::int as n_plus, coalesce(n_minus, 0)::int as n_minus, first_dim::int as first_dim,
      case when first_dim is null then 0.0 else 1.0 end::double as norm from conversations left join told using (conv_id, turn)""")
def c2_hashing_encoder(spark, sf_dir):
    """Of the hashed vectors of the conversations' turns: dimensions above and below zero, the first of these, the norm (0 or 1)."""
    from ragspark.functions.vectors import norm

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    told = encoding.encode(turns, "text", lambda: encoding.HashingEncoder(32))
    dims = F.filter(F.transform("vector", lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    n = lambda wanted: F.size(F.filter("vector", wanted))
    return told.select(
        "conv_id", "turn", n(lambda x: x > 0).alias("n_plus"), n(lambda x: x < 0).alias("n_minus"), F.array_min(dims).alias("first_dim"), F.round(norm("vector"), 3).alias("norm")
    )


@query(f"""with toks as (select doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) as t from documents),
    dims as (select doc_id, (crc >> 1) % 64 as d, sum(case when crc % 2 = 1 then 1 else -1 end) as s from toks join {_CRC} using (t) group by all),
    told as (select doc_id, list({{'d': d, 's': s}}) as l, sqrt(sum(s * s)) as n from dims where s <> 0 group by 1)
    select doc_id, array_to_string(list_transform(range(64), lambda i: case when len(list_filter(l, lambda x: x.d = i)) > 0
      then round(list_filter(l, lambda x: x.d = i)[1].s * 1000 / n)::int else 0 end), ',') as thousandths from documents left join told using (doc_id)""")
def c1_encode(spark, sf_dir):
    """The documents' hashed vectors, in thousandths.

    They come from the counts in double precision, as entries rounded to float may lie on the other side of a half.
    """
    from ragspark.functions.vectors import norm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = encoding.encode(docs, "text", lambda: encoding.HashingEncoder(64, scaled=False), kind="double")
    lengths = F.array_repeat(norm("vector"), F.size("vector"))
    thousandths = F.zip_with("vector", lengths, lambda x, n: F.when(n > 0, F.round(x * 1000 / n)).otherwise(0.0).cast("int").cast("string"))
    return told.select("doc_id", F.array_join(thousandths, ",").alias("thousandths"))


@query("""select vec_id, round(v[1], 4) as first, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) as norm from (
    select vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as v from (
    select vec_id, list_transform(embedding::double[], lambda x: x * (vec_id + 1)) as e from embeddings))""")
def c3_l2_normalize(spark, sf_dir):
    from ragspark.functions.vectors import norm

    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") + 1)).alias("vector")
    )
    return encoding.l2_normalize(scaled).select("vec_id", F.round(F.col("vector")[0], 4).alias("first"), F.round(norm("vector"), 4).alias("norm"))


@query("""select vec_id // 8 as doc_id, vec_id % 8 as seq_id, round(embedding[1]::double, 4) as first, 'page_' || (vec_id // 8) as filepath from embeddings""")
def c4_explode_multivector(spark, sf_dir):
    """Embeddings as the patches of pages of eight."""
    page = F.floor(F.col("vec_id") / 8).cast("long")
    pages = table(spark, sf_dir, "embeddings").groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("p"))
    pages = pages.select("page", F.col("p.embedding").alias("vectors"), F.concat(F.lit("page_"), F.col("page").cast("string")).alias("filepath"))
    found = encoding.explode_multivector(pages, "page")
    return found.select("doc_id", F.col("seq_id").cast("long").alias("seq_id"), F.round(F.col("vector")[0].cast("double"), 4).alias("first"), "filepath")


_FAULTY = """(select vec_id, case vec_id % 7 when 0 then null when 1 then embedding[:10] when 2 then list_concat(embedding[:63], ['nan'::float])
    else embedding end as v from embeddings)"""


@query(f"""select coalesce(case when v is null then 'null' when len(v) <> 64 then 'dimension' when len(list_filter(v, lambda x: isnan(x))) > 0 then 'nan' end, 'good') as fault,
    count(*) as n from {_FAULTY} group by 1""")
def c5_validate_vectors(spark, sf_dir):
    v = F.col("embedding")
    spoilt = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 1, F.slice(v, 1, 10))
        .when(F.col("vec_id") % 7 == 2, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(F.col("vec_id") % 7 != 0, v)
        .alias("vector"),
    )
    good, bad = encoding.validate_vectors(spoilt, 64)
    every = good.select(F.lit("good").alias("fault")).unionByName(bad.select("fault"))
    return every.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("""select d.p as position, doc_id, vec_id from (select doc_id, row_number() over (order by doc_id) - 1 as p from documents) d
    join (select vec_id, row_number() over (order by vec_id) - 1 as p from embeddings) e using (p)""")
def d1_pair_vectors(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select("vec_id")
    return collections.pair_vectors(docs, vectors, "doc_id", "vec_id", strict=False).select("position", "doc_id", "vec_id")


@query("select doc_id, 1000 + row_number() over (order by n_chars desc, doc_id) - 1 as id from documents")
def d2_assign_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("_less"))
    return collections.assign_ids(docs, ["_less", "doc_id"], 1000).select("doc_id", "id")


_CHANGES = "(select user_id as id, arg_max(value, event_id) as value from events group by user_id)"


@query(f"""select id, value from {_CHANGES} union all
    select vec_id as id, label::double as value from embeddings where vec_id not in (select user_id from events)""")
def d3_upsert(spark, sf_dir):
    target = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("value"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", "event_id")
    path = scratch(spark)
    buckets.start(target, path, "id")
    buckets.merge_upserts(changes, path, "id long, value double", "id", "event_id")
    return buckets.rows(spark, path, "id long, value double")


@query("select vec_id as id, label from embeddings where vec_id not in (select doc_id from labels where quality = 1)")
def d4_delete_keys(spark, sf_dir):
    target = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return collections.delete_keys(target, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id")


OPS = """case event_type when 'signup' then 'insert' when 'purchase' then 'insert' when 'click' then 'update' when 'view' then 'update' else 'delete' end"""


@query(f"""with last as (select user_id as id, arg_max(value, event_id) as value, arg_max({OPS}, event_id) as op from events group by 1)
    select id, value from last where op <> 'delete' union all
    select vec_id, label::double from embeddings where vec_id not in (select id from last)""")
def d5_apply_workload(spark, sf_dir):
    target = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("value"))
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", F.expr(OPS).alias("op"), "event_id")
    path = scratch(spark)
    buckets.start(target, path, "id")
    buckets.merge_workload(ops, path, "id long, value double", "id", "event_id")
    return buckets.rows(spark, path, "id long, value double")


@query("select vec_id, label from embeddings where label = 3 order by vec_id limit 10")
def d6_filter_query(spark, sf_dir):
    return collections.filter_query(table(spark, sf_dir, "embeddings"), "label = 3", ["vec_id", "label"], key="vec_id")


@query("""select 'benchmark' as name, count(*) as n_rows, null::int as dim from benchmark union all select 'documents', count(*), null from documents
    union all select 'embeddings', count(*), max(len(embedding))::int from embeddings""")
def d7_collection_stats(spark, sf_dir):
    names = ("documents", "benchmark", "embeddings")
    return collections.collection_stats({n: table(spark, sf_dir, n) for n in names}, {"embeddings": "embedding"})


@query("""select page_id, regexp_replace(url, '[^\\p{L}\\p{N}_]+', '_', 'g') as name, lower(regexp_replace(url, '[^\\p{L}\\p{N}_]+', '_', 'g')) as index_name from pages""")
def d8_sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sanitized_name("url").alias("name"), sanitized_name("url", lower=True).alias("index_name"))


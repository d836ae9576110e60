"""Secret scans: patterns with positions, and how widely each candidate is owned across the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.tables import text_key, unused, written

# Kinds in the order of the listing, their patterns, the group that holds the secret, and
# the least length of that group.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": (
        "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        12,
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
#: a candidate that this many owners, or this many repositories, hold is widely copied
WIDE_OWNERS = 3
WIDE_REPOS = 50
#: what a live-looking secret has: distinct characters, a digit, a letter, and none of these words
LIVE_CHARACTERS = 8
PLACEHOLDERS = "example|sample|changeme|placeholder|dummy|your[_-]|xxxx|1234567|abcdef"
ANY = f"{PATTERNS['assign'][0]}|AKIA[A-Z0-9]{{14}}|[0-9a-f]{{16}}"


def _hits(text: Column, kind: str) -> Column:
    """Array of (gap before the match, match, secret) for all matches of a kind, failing lengths included.

    Splitting at the pattern gives what lies between the matches, and so, summed up, their positions.
    """
    pattern, group, _ = PATTERNS[kind]
    if kind == "hex":  # runs that are too short are no matches at all; a longer run is found from its start
        pattern = "[0-9a-f]{16,}"
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    return F.transform(
        F.arrays_zip(
            gaps.alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        ),
        lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["found"].alias("found"), x["value"].alias("value")),
    )


def candidate_spans(texts: DataFrame) -> DataFrame:
    """texts(key, text) -> (key, kind, start, end, value, value_start): base matches, in code points, end exclusive.

    Equal keys stand for equal texts and are scanned into one set of spans.
    """
    hits = F.concat(*(_hits(F.col("text"), k) for k in KINDS))
    found = texts.where(F.col("text").rlike(ANY)).select("key", hits.alias("hits")).dropDuplicates(["key"])
    rows = found.select("key", F.posexplode("hits").alias("n", "h")).select("key", "n", "h.*")
    so_far = Window.partitionBy("key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    least = F.coalesce(*(F.when(F.col("kind") == k, PATTERNS[k][2]) for k in KINDS))
    return (
        rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("found"), F.lit(0))).over(so_far))
        .where(F.length("value") >= least)  # the last gap has no match behind it
        .select(
            "key", "kind", (F.col("end") - F.length("found")).alias("start"), "end", "value", (F.col("end") - F.length("value")).alias("value_start")
        )
    )


def looks_live(value: Column) -> Column:
    """Whether a secret looks like a real one: varied characters, a digit and a letter, no placeholder words."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~F.lower(value).rlike(PLACEHOLDERS)


def ownership(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners) of each candidate over the whole corpus; value_hash has 128 bits.

    rows(key, repo, owner): which repository and owner each text belongs to. Exact distinct counts, summed
    up per task before the shuffle; null repositories and owners don't count.
    """
    # written, so that neither side is an aggregate and Spark can split the rows of a text with many copies
    held = written(spans.select("key", _value_hash().alias("value_hash")).distinct()).join(rows, "key")
    return held.groupBy("value_hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def _value_hash() -> Column:
    return F.unhex(F.md5("value"))


def _keyed(docs: DataFrame, repo_col: str, owner_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text_key(text).alias("key"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), text.alias("text"))


def classified_spans(
    docs: DataFrame, corpus: DataFrame | None = None, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Base spans of each distinct text of docs with n_repos, n_owners and class.

    Ownership is counted over corpus, or docs where none is given; where docs are what a filter or a dedup left,
    corpus should be what they came from, as a secret whose copies are gone looks owned by few. class:
    `example` where WIDE_OWNERS owners hold the secret, or several with WIDE_REPOS repositories, else `live` where
    it looks live (in however many repositories of one owner), else `weak`. In a table of documents each document stands for a repository and its source for the owner.
    """
    spans = written(candidate_spans(_keyed(docs, repo_col, owner_col, text_col).select("key", "text")))
    rows = _keyed(docs if corpus is None else corpus, repo_col, owner_col, text_col).where(F.col("text").rlike(ANY))
    every = spans if corpus is None else written(candidate_spans(rows.select("key", "text")))
    # written on both sides, so that Spark can split a frequent secret
    owned = written(ownership(every, rows.select("key", "repo", "owner")))
    wide = (F.col("n_owners") >= WIDE_OWNERS) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= WIDE_REPOS))
    kind = F.when(wide, "example").when(looks_live(F.col("value")), "live").otherwise("weak")
    found = spans.withColumn("value_hash", _value_hash()).join(owned, "value_hash", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_repos", "n_owners")}).withColumn("class", kind)


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    spans are kind:start:end by start, then kind; to the base kinds come `live` spans over the secret itself
    where only few owners and repositories hold it and it looks live, after the base kinds of the same start. Null and empty
    texts have none. Repeated rows and null ids are returned as they come.
    """
    live = F.expr("filter(array(named_struct('start', value_start, 'k', 3, 'end', end)), x -> class = 'live')")
    base = F.array(F.struct("start", F.coalesce(*(F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS))).alias("k"), "end"))
    typed = "array<struct<start:bigint,k:int,end:bigint>>"
    spans = classified_spans(docs).select("key", F.explode(F.concat(base.cast(typed), live.cast(typed))).alias("s")).distinct()
    per_text = spans.groupBy("key").agg(
        *(F.count_if(F.col("s.k") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.array_sort(F.collect_list("s")).alias("found")
    )
    names = F.array(*map(F.lit, (*KINDS, "live")))
    said = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    per_text = written(per_text.select(
        "key", *(f"n_{k}" for k in KINDS),
        said(F.filter("found", lambda x: x["k"] < len(KINDS))).alias("base"), said(F.col("found")).alias("spans"),
    ))
    rows = docs.select("doc_id", text_key().alias("key"))
    return rows.join(per_text, "key", "left").select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redacted(docs: DataFrame, corpus: DataFrame | None = None, mark: str = "[SECRET]") -> DataFrame:
    """documents with every live secret in a text replaced by mark, longer secrets first; n_chars follows.

    corpus: the documents over which ownership is counted (docs where none is given). Widely copied examples and weak candidates stay; no row is dropped.
    """
    key, values = unused(docs, "_key"), unused(docs, "_values")
    held = classified_spans(docs, corpus).where("class = 'live'").groupBy(F.col("key").alias(key)).agg(F.collect_set("value").alias(values))
    held = written(held)
    longer = "case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end"
    ordered = F.expr(f"array_sort({values}, (a, b) -> {longer})")
    clean = F.aggregate(ordered, F.col("text"), lambda text, v: F.replace(text, v, F.lit(mark)))
    out = docs.withColumn(key, text_key()).join(held, key, "left")
    out = out.withColumn("text", F.when(F.col(values).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(values).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


def _sql_hits(kind: str) -> str:
    pattern, group, _ = PATTERNS[kind]
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' kind, {KINDS.index(kind)} k, unnest(range(1, len(found) + 1)) n, unnest(found) found, unnest(vals) val,
        unnest(gaps[:len(found)]) gap from (select doc_id, regexp_extract_all(text, '{pattern}', 0) found,
        regexp_extract_all(text, '{pattern}', {group}) vals, string_split_regex(text, '{pattern}') gaps
        from (select doc_id, coalesce(text, '') as text from documents)) where len(found) > 0"""


SQL = f"""
with hits as ({" union all ".join(map(_sql_hits, KINDS))}),
placed as (
  select *, sum(length(gap) + length(found)) over (partition by doc_id, kind order by n) as e from hits),
spans as (
  select doc_id, kind, k, cast(e - length(found) as bigint) as s, cast(e as bigint) as e, cast(e - length(val) as bigint) as vs, val from placed
  where length(val) >= case kind {" ".join(f"when '{k}' then {v[2]}" for k, v in PATTERNS.items())} end),
owned as (
  select val, count(distinct source) as n_owners, count(distinct doc_id) as n_repos from spans join documents using (doc_id) group by val),
every as (
  select doc_id, kind, k, s, e from spans
  union select doc_id, 'live', 3, vs, e from spans join owned using (val)
  where n_owners < {WIDE_OWNERS} and (n_owners < 2 or n_repos < {WIDE_REPOS}) and len(list_distinct(string_split(val, ''))) >= {LIVE_CHARACTERS}
    and regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Za-z]') and not regexp_matches(lower(val), '{PLACEHOLDERS}')),
said as (
  select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3) as base,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as every
  from every group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans
from documents d left join said using (doc_id)
"""

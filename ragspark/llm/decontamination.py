"""Benchmark decontamination: windows of canonical templates, hash-joined, with consistent slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import text_key, unused, written

#: tokens of a template window, and how many of them must not be placeholders
WINDOW = 8
LITERALS = 4
#: share of an item's windows that a text must hold, and of slots that must be consistent
COVERAGE = 0.4
CONSISTENCY = 0.8
#: windows of one alignment without gap that are enough whatever share of the item they are (27 words)
RUN = 20
#: tokens by which the windows of one alignment may be shifted against each other
SHIFT = 8
#: forms of windows: canonical tokens, tokens as they are, and whole lines
TEMPLATE, VERBATIM, LINE = 0, 1, 2
#: windows of benchmark items up to which they go to all executors (16 bytes each); beyond, both sides are shuffled
BROADCAST_WINDOWS = 1_000_000
# Placeholders (no token is one of these), signs that are units, and the sign between names of a run.
NUMBER, NAME, UNIT = "#", "@", "&"
SIGNS = "$€£¥%"
JOIN = "_"
#: a number with its separators, a word, or a sign
_TOKEN = f"\\p{{N}}+(?:[.,]\\p{{N}}+)*|\\p{{L}}[\\p{{L}}\\p{{N}}]*|[{SIGNS}]"
#: a currency sign and the number behind it
_PRICE = "([$€£¥]) ?(\\p{N}+(?:[.,]\\p{N}+)*)"
_NAME = "\\p{Lu}\\p{Ll}"


def raw_tokens(text: Column) -> Column:
    """A text's tokens (case kept) with one space between.

    Numbers are one token with their separators (1,200 and 3.50), and end where letters begin (3kg is two); a
    currency sign comes behind its number; words are letters and digits from a letter on.
    """
    return F.array_join(F.regexp_extract_all(F.regexp_replace(text, _PRICE, "$2 $1 "), F.lit(_TOKEN), 0), " ")


def names_joined(tokens: Column) -> Column:
    """raw_tokens with each run of names (a capital letter and a small one, and what follows) as one token."""
    return F.regexp_replace(tokens, f"(?<![^ ])({_NAME}[^ ]*) (?={_NAME})", f"$1{JOIN}")


def canonical(tokens: Column) -> Column:
    """Tokens with names, numbers and units as typed placeholders and the rest in lower case; as many tokens.

    A unit is what directly follows a number and is neither a name nor a number: any word, so that no list of
    units need be complete.
    """
    out = F.regexp_replace(tokens, f"(?<![^ ]){_NAME}[^ ]*", NAME)
    out = F.lower(F.regexp_replace(out, "(?<![^ ])\\p{N}[^ ]*", NUMBER))
    return F.regexp_replace(out, f"(?<![^ ]){NUMBER} (?![{NUMBER}{NAME}](?![^ ]))[^ ]+", f"{NUMBER} {UNIT}")


def _hash(form: int, tokens: Column) -> Column:
    return F.xxhash64(F.lit(form), F.array_join(tokens, " "))


def _windows(tokens: Column, form: int) -> Column:
    """Hash of each WINDOW consecutive tokens."""
    at = F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1))
    return F.when(F.size(tokens) >= WINDOW, F.transform(at, lambda i: _hash(form, F.slice(tokens, i, WINDOW)))).otherwise(F.array())


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, form, pos, h, raw, part): the windows of each item; pos counts from 1.

    TEMPLATE windows come with names as placeholders and, where that differs, with names as words, as a text in
    capitals shows no names; they need LITERALS tokens that are no placeholders. An item without any such
    window (a line of numbers, say) has VERBATIM windows of its lower-case tokens instead. An item of fewer
    tokens than WINDOW is found as a LINE alone: where the tokens of a whole line are its own. Items without
    tokens have no windows.
    """
    raw = raw_tokens(F.coalesce("text", F.lit("")))
    items = benchmark.select("item_id", raw.alias("raw")).where("raw <> ''").distinct()
    split = lambda c: F.split(c, " ")
    long_enough = F.size(split(F.col("raw"))) >= WINDOW

    def placed(rows: DataFrame, form: int) -> DataFrame:
        at = rows.where(F.size("canon") >= WINDOW).select("*", F.explode(F.sequence(F.lit(1), F.size("canon") - (WINDOW - 1))).alias("pos"))
        part = F.slice("canon", F.col("pos"), WINDOW)
        return at.select("item_id", F.lit(form).alias("form"), "pos", _hash(form, part).alias("h"), F.slice("raw", F.col("pos"), WINDOW).alias("raw"), part.alias("part"))

    joined = names_joined(F.col("raw"))
    forms = F.array_distinct(F.array(F.struct(split(joined).alias("raw"), canonical(joined).alias("c")), F.struct(split(F.col("raw")).alias("raw"), canonical(F.lower("raw")).alias("c"))))
    each = items.where(long_enough).select("item_id", F.explode(forms).alias("f")).select("item_id", "f.raw", split(F.col("f.c")).alias("canon"))
    literal = F.size(F.filter("part", lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    templates = written(placed(each, TEMPLATE).where(literal >= LITERALS).distinct())
    bare = items.where(long_enough).join(templates.select("item_id").distinct(), "item_id", "left_anti")
    verbatim = placed(bare.select("item_id", split(F.col("raw")).alias("raw"), split(F.lower("raw")).alias("canon")), VERBATIM)
    low = split(F.lower("raw"))
    lines = items.where(~long_enough).select("item_id", F.lit(LINE).alias("form"), F.lit(1).alias("pos"), _hash(LINE, low).alias("h"), split(F.col("raw")).alias("raw"), low.alias("part"))
    return templates.unionByName(verbatim.distinct()).unionByName(lines.distinct())


def matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """docs(key, text), windows of items -> (key, form, doc_pos, h, theirs): the windows of texts that are some item's.

    theirs: the tokens that stand there. They are cut out of the text where it is scanned, for windows that
    match only, so that no text is read twice or moved. doc_pos of a LINE counts lines.
    """
    forms = sorted(r["form"] for r in windows.select("form").distinct().collect())  # three at most
    wanted = written(windows.select("form", "h").distinct())
    if wanted.count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    text = F.coalesce("text", F.lit(""))
    found = None
    for form in forms or [TEMPLATE]:
        if form == LINE:
            low = F.transform(F.split(text, "\n"), lambda line: F.split(F.lower(raw_tokens(line)), " "))
            short = F.filter(low, lambda t: (F.size(t) < WINDOW) & (t[0] != ""))
            hashed = F.transform(short, lambda t: F.struct(_hash(LINE, t).alias("h"), t.alias("theirs")))
            rows = docs.select("key", F.posexplode_outer(hashed).alias("at", "line")).select("key", "at", "line.h", "line.theirs")
        else:
            raw = names_joined(raw_tokens(text)) if form == TEMPLATE else raw_tokens(text)
            words = docs.select("key", raw.alias("w"))
            texts = words.select("key", F.split("w", " ").alias("raw"), F.split(canonical(F.col("w")) if form == TEMPLATE else F.lower("w"), " ").alias("tokens"))
            texts = texts.select("key", "raw", _windows(F.col("tokens"), form).alias("hs"))
            # outer, as Spark would else compute all windows twice, once to leave out texts without any; the join drops nulls
            rows = texts.select("key", "raw", F.posexplode_outer("hs").alias("at", "h"))
            rows = rows.select("key", "at", "h", F.slice("raw", F.col("at") + 1, WINDOW).alias("theirs"))
        rows = rows.select("key", F.lit(form).alias("form"), (F.col("at") + 1).alias("doc_pos"), "h", "theirs")
        found = rows if found is None else found.unionByName(rows)
    return found.join(wanted, ["form", "h"]).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, n_windows, n_matched, coverage, consistency, contaminated) for texts that share windows.

    docs(key, text). Matches are judged by alignment, as a text may hold an item several times with other
    values: those of one offset between text and item (SHIFT words apart at most, in overlapping bins, where
    a value of more or fewer words moves the rest; and those of exactly one offset). coverage: share of the
    item's windows that the alignment holds (a run of names, a number with its separators and a unit are a token
    each). consistency: slot values on the side with fewer distinct ones
    over distinct pairs of the item's and the text's value (1 without slots), as a re-parameterised question
    puts one value for each old one. An alignment leaks the item if it is consistent and either covers
    COVERAGE or, at one offset, RUN windows. The best alignment's figures are given.
    """
    windows = written(item_windows(benchmark))
    hit = written(matches(docs, windows))
    offset = F.col("doc_pos") - F.col("pos")
    step = F.floor(offset / SHIFT).cast("int")
    sides = F.array(*(F.struct(F.lit(exact).alias("exact"), at.alias("at")) for exact, at in ((True, offset), (False, step), (False, step - 1))))
    pairs = hit.join(windows, ["form", "h"]).select("key", "item_id", "pos", "part", "raw", "theirs", F.explode(sides).alias("side"))
    side = ["key", "item_id", "side"]
    total = windows.groupBy("item_id").agg(F.count_distinct("pos").alias("n_windows"))
    matched = pairs.select(*side, "pos").distinct().groupBy(*side).agg(F.count(F.lit(1)).alias("n_matched"))
    slots = pairs.select(*side, F.explode(F.arrays_zip("part", "raw", "theirs")).alias("s")).where(F.col("s.part").isin(NUMBER, NAME, UNIT)).distinct()
    ours, theirs = F.struct("s.part", "s.raw"), F.struct("s.part", "s.theirs")
    slots = slots.groupBy(*side).agg((F.least(F.count_distinct(ours), F.count_distinct(theirs)) / F.count(F.lit(1))).alias("consistency"))
    judged = matched.join(slots, side, "left").join(total, "item_id")
    judged = judged.select(
        *side, "n_windows", "n_matched", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), F.coalesce("consistency", F.lit(1.0)).alias("consistency")
    )
    enough = (F.col("coverage") >= COVERAGE) | (F.col("side.exact") & (F.col("n_matched") >= RUN))
    judged = judged.withColumn("contaminated", enough & (F.col("consistency") >= CONSISTENCY))
    best = judged.groupBy("key", "item_id").agg(F.max(F.struct("contaminated", "coverage", "consistency", "n_matched", "n_windows")).alias("b"))
    return best.select("key", "item_id", "b.n_windows", "b.n_matched", "b.coverage", "b.consistency", "b.contaminated")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, consistency) for each row of docs that leaks an item.

    Null and empty texts and items leak nothing; repeated rows and null ids are returned as they come. An item
    whose windows are nearly all placeholders has no template and is found where its words stand as they are. An
    item of fewer than WINDOW tokens is found as a whole line only.
    """
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    # written, so that Spark can split the rows of a text with many copies
    found = written(contamination(keyed.select("key", "text"), benchmark).where("contaminated").drop("contaminated"))
    return keyed.select("doc_id", "key").join(found, "key").drop("key")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that leak a benchmark item. Null texts stay."""
    name = unused(docs, "_key")
    keyed = docs.withColumn(name, text_key())
    found = contamination(keyed.select(F.col(name).alias("key"), "text"), benchmark).where("contaminated")
    gone = written(found.select(F.col("key").alias(name)).distinct())
    return keyed.join(gone, name, "left_anti").select(docs.columns)


def _sql_tokens(text: str) -> str:
    return f"regexp_extract_all(regexp_replace({text}, '{_PRICE}', '\\2 \\1 ', 'g'), '{_TOKEN}')"


def _sql_joined(raw: str) -> str:
    """Tokens of a list with runs of names as one."""
    name = lambda i: f"regexp_matches({raw}[{i}], '^{_NAME}')"
    return f"""string_split(array_to_string(list_transform(range(1, len({raw}) + 1), lambda i: (case when i = 1 then '' when {name('i')} and {name('i - 1')} then '{JOIN}' else ' ' end) || {raw}[i]), ''), ' ')"""


def _sql_canonical(raw: str) -> str:
    """Canonical tokens of a list."""
    name, number = (lambda i: f"regexp_matches({raw}[{i}], '^{_NAME}')"), (lambda i: f"regexp_matches({raw}[{i}], '^\\p{{N}}')")
    return f"""list_transform(range(1, len({raw}) + 1), lambda i: case when {name('i')} then '{NAME}' when {number('i')} then '{NUMBER}'
      when i > 1 and {number('i - 1')} then '{UNIT}' else lower({raw}[i]) end)"""


SQL = f"""
with items as (select distinct item_id, {_sql_tokens("coalesce(text, '')")} as raw from benchmark),
forms as (
  select distinct item_id, raw, canon from (
    select item_id, raw, {_sql_canonical("raw")} as canon from (select item_id, {_sql_joined("raw")} as raw from items where len(raw) >= {WINDOW}) union all
    select item_id, raw, {_sql_canonical("low")} from (select *, list_transform(raw, lambda x: lower(x)) as low from items where len(raw) >= {WINDOW}))),
templates as (
  select distinct item_id, {TEMPLATE} as form, pos, canon[pos:pos + {WINDOW - 1}] as part, raw[pos:pos + {WINDOW - 1}] as raw from (
    select *, unnest(range(1, len(canon) - {WINDOW - 2})) as pos from forms)
  where len(list_filter(canon[pos:pos + {WINDOW - 1}], lambda w: w not in ('{NUMBER}', '{NAME}', '{UNIT}'))) >= {LITERALS}),
windows as (
  select * from templates union all
  select distinct item_id, {VERBATIM} as form, pos, list_transform(raw[pos:pos + {WINDOW - 1}], lambda x: lower(x)), raw[pos:pos + {WINDOW - 1}] from (
    select *, unnest(range(1, len(raw) - {WINDOW - 2})) as pos from items where len(raw) >= {WINDOW} and item_id not in (select item_id from templates)) union all
  select distinct item_id, {LINE}, 1, list_transform(raw, lambda x: lower(x)), raw from items where len(raw) between 1 and {WINDOW - 1}),
words as (select doc_id, {_sql_tokens("coalesce(text, '')")} as raw from documents),
docs as (
  select doc_id, {TEMPLATE} as form, raw, {_sql_canonical("raw")} as canon from (select doc_id, {_sql_joined("raw")} as raw from words) union all
  select doc_id, {VERBATIM}, raw, list_transform(raw, lambda x: lower(x)) from words where (select count(*) from windows where form = {VERBATIM}) > 0),
places as (
  select doc_id, form, k, canon[k:k + {WINDOW - 1}] as part, raw[k:k + {WINDOW - 1}] as theirs from (
    select *, unnest(range(1, len(canon) - {WINDOW - 2})) as k from docs where len(canon) >= {WINDOW}) union all
  select doc_id, {LINE}, k, t, t from (
    select doc_id, k, list_transform({_sql_tokens("line")}, lambda x: lower(x)) as t from (
      select doc_id, unnest(range(1, len(lines) + 1)) as k, unnest(lines) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)
      where (select count(*) from windows where form = {LINE}) > 0)) where len(t) between 1 and {WINDOW - 1}),
pairs as (
  select p.doc_id, w.item_id, w.pos, p.k - w.pos as d, w.part, w.raw, p.theirs from places p join windows w on p.form = w.form and p.part = w.part),
sides as (
  select *, true as exact, d as bin from pairs union all
  select *, false, floor(d / {SHIFT}) from pairs union all select *, false, floor(d / {SHIFT}) - 1 from pairs),
matched as (select doc_id, item_id, exact, bin, count(distinct pos) as m from sides group by all),
slots as (
  select doc_id, item_id, exact, bin, least(count(distinct (p, r)), count(distinct (p, t))) / count(distinct (p, r, t)) as c from (
    select doc_id, item_id, exact, bin, unnest(part) as p, unnest(raw) as r, unnest(theirs) as t from sides) where p in ('{NUMBER}', '{NAME}', '{UNIT}') group by all),
total as (select item_id, count(distinct pos) as n from windows group by 1),
judged as (
  select doc_id, item_id, n, m, m / n as coverage, coalesce(c, 1.0)::double as consistency,
    row_number() over (partition by doc_id, item_id order by m desc, coalesce(c, 1.0) desc) as place
  from matched join total using (item_id) left join slots using (doc_id, item_id, exact, bin)
  where (m / n >= {COVERAGE} or exact and m >= {RUN}) and coalesce(c, 1.0) >= {CONSISTENCY})
select doc_id, item_id, n as n_windows, m as n_matched, coverage, consistency from judged where place = 1
"""

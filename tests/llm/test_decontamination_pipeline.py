import random

from ragspark.llm import decontamination as d

from .test_simhash import DOCS

ITEM = "If Anna buys 3 kg of apples for 12 dollars and then sells 2 kg of them at the market, how much does each one cost"
OTHER = "le chat noir dort sur le grand canapé rouge pendant que la pluie tombe doucement sur les toits de la ville"


def leaks(spark, docs, items):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in d.benchmark_leaks(df.withColumn("key", df["lang"]).withColumn("h", df["lang"]), bench).collect()}


def test_leaks(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    swapped = ITEM.replace("Anna", "Berta").replace("3 kg", "7 lbs").replace("12 dollars", "99 euros").replace("2 kg", "5 lbs")
    torn = ITEM.replace("3 kg", "7 lbs").replace("2 kg", "9 miles").replace("buys", "never")
    docs = [(1, f"{noise(50)} {ITEM} {noise(9)}"), (2, f"{noise(50)} {swapped}"), (3, noise(400)), (4, ITEM.upper()), (5, f"{OTHER}. {ITEM}"), (6, None), (7, ""), (8, "If Anna buys 3 kg"),
            (1, f"{noise(50)} {ITEM}"), (None, ITEM), (9, noise(60_000) + " " + OTHER)]
    got = leaks(spark, docs, [(10, ITEM), (11, OTHER), (12, None), (13, ""), (14, "short words only"), (15, ITEM)])
    assert {k for k in got} == {(i, j) for i in (1, 2, 4, 5, None) for j in (10, 15)} | {(5, 11), (9, 11)}
    assert got[(2, 10)]["consistency"] == 1.0 and got[(2, 10)]["coverage"] == 1.0
    assert torn


def test_canonical_forms(spark):
    from pyspark.sql import functions as F

    texts = ["On 3 May 2020 Peter Ran 10 km in 50 minutes.", "x1 2nd ÉCOLE École 5", "", "It costs $3.50, or 1,200 yen, 50% of 4kg; €7 for Anna Lee!", "1.2.3 4 5 pears", "a_b $ 5$"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(d.names_joined(d.raw_tokens(F.col("t"))).alias("w"))
    got = [tuple(r) for r in rows.select("w", d.canonical(F.col("w"))).collect()]
    assert got == [
        ("On 3 May 2020 Peter_Ran 10 km in 50 minutes", "@ # @ # @ # & in # &"), ("x1 2 nd ÉCOLE École 5", "x1 # & école @ #"), ("", ""),
        ("It costs 3.50 $ or 1,200 yen 50 % of 4 kg 7 € for Anna_Lee", "@ costs # & or # & # & of # & # & for @"), ("1.2.3 4 5 pears", "# # # &"), ("a b 5 $ $", "a b # & $"),
    ]


QUESTION = (
    "A shop sells each notebook for 3 dollars and every pen for 2 dollars. If Maria buys 14 notebooks and gives the clerk "
    "a note of 50 dollars, how much change does Maria get back from the clerk"
)


def test_re_parameterised_questions(spark):
    """New numbers, names of several words, signs for units, other units, grouped and decimal numbers, and all at once."""
    swap = lambda **by: __import__("functools").reduce(lambda t, kv: t.replace(kv[0].replace("_", " "), kv[1]), by.items(), QUESTION)
    docs = [
        swap(), swap(Maria="Tom", _14_=" 9 ", _50_=" 80 "), swap(Maria="Anna Lee"), swap(Maria="Anna Lee Smith", _14_=" 22 "),
        swap(_3_dollars=" $3", _2_dollars=" $2", _50_dollars=" $50"), swap(dollars="pounds"), swap(dollars="zlotys", notebooks="folders"),
        swap(_14_=" 1,200 ", _50_=" 9,000.75 ", _3_=" 3.50 "), swap(_3_dollars=" €4.25", _2_dollars=" €1.10", _50_dollars=" €60", Maria="José Ruiz"), swap().upper(),
    ]
    wrong = ["A shop sells bread. Maria buys 14 notebooks every week for the school and pays 50 dollars", QUESTION.replace("sells each", "lends no").replace("every pen", "his pen").replace("buys", "loses").replace("much change does", "long until").replace("gives the clerk", "asks a guard")]
    got = leaks(spark, list(enumerate(docs + wrong)), [(1, QUESTION)])
    assert {k[0] for k in got} == set(range(len(docs)))
    assert all(r["coverage"] >= 0.75 for r in got.values())


def test_short_items_are_whole_lines(spark):
    docs = [(1, "he said yes and went"), (2, "yes"), (3, "so:\n  Yes! \nand on"), (4, "What is the capital of France?"), (5, "we asked what is the capital of france today"), (6, "yes yes")]
    got = leaks(spark, docs, [(1, "yes"), (2, "What is the capital of France?"), (3, "...")])
    assert set(got) == {(2, 1), (3, 1), (4, 2)}


def test_inconsistent_slots(spark):
    """One name of the item stands for two in the text: windows match, slots don't agree."""
    item = "so Tom told the story of Tom to the man whom Tom had met at the shop where Tom worked until Tom moved far from Tom again"
    other = item
    for name in ("Uwe", "Ida", "Kim", "Leo", "Max", "Ben"):
        other = other.replace("Tom", name, 1)
    got = leaks(spark, [(1, item), (2, other), (3, item.replace("Tom", "Zoe"))], [(1, item)])
    assert set(got) == {(1, 1), (3, 1)}


def test_each_occurrence_is_judged_by_itself(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    other = lambda name, a, b, c: ITEM.replace("Anna", name).replace("3 kg", f"{a} kg").replace("12 dollars", f"{b} dollars").replace("2 kg", f"{c} kg")
    one, two, three = other("Berta", 7, 99, 5), other("Carl", 8, 45, 6), other("Dora", 41, 77, 13)
    docs = [(1, one), (2, f"{one} {two}"), (3, f"{one} {noise(30)} {two} {noise(3)} {three}"), (4, f"{ITEM} {one}"), (5, f"{noise(20)} {one} {ITEM} {two}")]
    docs += [(6, other("Berta", 7, 7, 7))]  # three values of the item on one of the text
    got = leaks(spark, docs, [(10, ITEM)])
    assert set(got) == {(i, 10) for i in range(1, 6)}
    assert all(r["consistency"] == 1.0 and r["coverage"] == 1.0 for r in got.values())


def test_values_of_more_words_shift_an_occurrence(spark):
    longer = ITEM.replace("3 kg", "3 500 kg").replace("12 dollars", "1 000 250 dollars")
    assert set(leaks(spark, [(1, longer)], [(1, ITEM)])) == {(1, 1)}


def test_excerpts_and_items_without_template(spark):
    rng = random.Random(10)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200)).split()
    item, part, less = " ".join(long), " ".join(long[50:77]), " ".join(long[50:76])
    numbers = "1 2 3 5 8 13 21 34 55 89 144"
    docs = [(1, part), (2, less), (3, f"so it goes {numbers} and on"), (4, "1 2 3 4 5 6 7 8 9 10 11"), (5, item)]
    assert set(leaks(spark, docs, [(1, item), (2, numbers)])) == {(1, 1), (5, 1), (3, 2)}


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, ITEM)]) == {} and leaks(spark, [(1, ITEM)], []) == {}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(150) + (" zwurkling grobzwurk zwurklord zwurkling" if i % 5 == 0 else ""), "en", f"s{i % 4}", 900) for i in range(300)]
    copy = text(200)
    key = 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'
    docs += [(1000 + i, copy, "en", "s", 1) for i in range(4)] + [(2000, f"{text(80)} {ITEM} {text(80)}", "en", "s", 1), (2001, f"{text(100)} {key} {text(50)}", "en", "s", 1)]
    docs += [(None, text(50), None, None, None), (3000, None, "en", "s", 0), (3001, "", "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 5 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == DOCS.names
        now.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in now.select("doc_id").collect()))
    clean = [i for i in range(300) if i % 5]
    assert [i for i in seen[0] if 0 <= i < 300] == clean
    assert seen[1] == [-1, *clean, 1000, 2000, 2001, 3000] and seen[2] == [-1, *clean, 1000, 2001, 3000] == seen[3] == seen[4]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert "[SECRET]" in texts[2001] and "1eb9c654" not in texts[2001]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows) == seen[4]
    assert all(len(r["input_ids"]) == r["n_tokens"] for r in rows)


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op") and n.split("_")[0] == "op10"] and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.oracle_sql()) <= set(names)

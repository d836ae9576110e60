"""Prompts, batch model calls and evaluation datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = "Answer from the passages below.\nPassages ({n}):\n{contexts}\nQuestion: {question}\nAnswer:"


def build_prompts(questions: DataFrame, contexts: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """questions(qid, question), contexts(qid, contexts) -> (qid, prompt). A question without hits gets no passages.

    {n}, {contexts} (joined by line breaks) and {question} of the template are filled in.
    """
    held = questions.select("qid", "question").join(contexts.select("qid", "contexts"), "qid", "left")
    found = F.coalesce("contexts", F.array().cast("array<string>"))
    prompt = F.lit(template)
    for name, value in (("{n}", F.size(found).cast("string")), ("{contexts}", F.array_join(found, "\n")), ("{question}", F.coalesce("question", F.lit("")))):
        prompt = F.replace(prompt, F.lit(name), value)
    return held.select("qid", prompt.alias("prompt"))


def build_image_prompts(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """questions(qid, question), pages(qid, rank, image) -> (qid, message): a JSON user message, images by rank, then the text."""
    found = pages.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "image"))).alias("images"))
    part = lambda kind, image, text: F.struct(
        F.lit(kind).alias("type"), image.cast("string").alias("image"), text.cast("string").alias("text")
    )
    images = F.transform(
        F.coalesce(F.col("images.image"), F.array().cast("array<string>")), lambda x: part("image", x, F.lit(None))
    )
    content = F.concat(images, F.array(part("text", F.lit(None), F.col("question"))))
    message = F.to_json(F.struct(F.lit("user").alias("role"), content.alias("content")))
    return questions.select("qid", "question").join(found, "qid", "left").select("qid", message.alias("message"))


def apply_model(
    df: DataFrame, fn: Callable[[], Callable[[list[str]], list[str]]], in_col: str = "prompt", out_col: str = "response", batch_size: int = 64
) -> DataFrame:
    """df with one output of a batch model a row. `fn` is called once a worker; ValueError where the counts differ."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out_col), f"`{out_col}` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = fn()
        for batch in batches:
            texts, out = batch[in_col].tolist(), []
            for k in range(0, len(texts), batch_size):
                got = list(model(texts[k : k + batch_size]))
                if len(got) != len(texts[k : k + batch_size]):
                    raise ValueError(f"{len(got)} outputs for {len(texts[k : k + batch_size])} inputs")
                out += got
            yield batch.assign(**{out_col: out})

    return df.drop(out_col).mapInPandas(run, schema)


def eval_dataset(questions: DataFrame, responses: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, user_input, response, retrieved_contexts, reference) of questions that have a response."""
    held = questions.join(responses.select("qid", "response"), "qid").join(contexts.select("qid", "contexts"), "qid", "left")
    return held.select(
        "qid", F.col("question").alias("user_input"), "response",
        F.coalesce("contexts", F.array().cast("array<string>")).alias("retrieved_contexts"), F.col("ground_truth").alias("reference"),
    )

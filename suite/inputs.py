"""Inputs of the registered queries, derived by Spark from the whole given tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators.chat import pair_turns
from talkloom.operators.tokens import tokenize_corpus
from talkloom.operators.instruct import prompt_records
from talkloom.plans.spread import spread
from talkloom.plans.training import conversation_instructions
from talkloom.sources.scratch import scratch_path

MAX_LEN = 200
SPECIAL = (1,)
EOS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages over all cores: parsing is heavy, and the test tables are one split each."""
    return spread(table(spark, sf_dir, "pages"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_instructions(table(spark, sf_dir, "conversations"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt_records(records(spark, sf_dir))


def tokens(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    settings = {"max_len": MAX_LEN, "special_ids": SPECIAL, "eos_id": EOS, **options}
    return tokenize_corpus(prompts(spark, sf_dir), **settings)


def ids_text(column: str) -> Column:
    """An id array as text, so that both engines print it alike."""
    return F.array_join(F.col(column).cast("array<string>"), " ")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_turns(table(spark, sf_dir, "conversations"))


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, embedding)``: each vector mixed with the two that follow it by id, if any."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    second = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    third = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("c"))
    joined = e.join(second, "vec_id", "left").join(third, "vec_id", "left")
    two = _mixed(F.col("embedding"), F.col("b"), F.lit(0.9))
    three = _mixed(two, F.col("c"), F.lit(0.8))
    return joined.select(F.col("vec_id").alias("query_id"), three.alias("embedding"))


def _mixed(vector: Column, other: Column, weight: Column) -> Column:
    """``vector + weight * other`` in double precision; a missing ``other`` adds nothing."""
    base = vector.cast("array<double>")
    added = F.coalesce(other.cast("array<double>"), F.transform(base, lambda x: F.lit(0.0)))
    return F.zip_with(base, added, lambda x, y: x + weight * y)


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pos, text, embedding)``: every document with a vector.

    Documents share the stored vectors round by round. From the second round on, a
    document's vector is mixed with another one, so that no two are alike.
    """
    vectors = table(spark, sf_dir, "embeddings")
    place, turn = vector_place(spark, sf_dir, "doc_id")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), "text", place.alias("place"), turn.alias("turn")
    )
    count = vectors.count()
    own = vectors.select(F.col("vec_id").alias("place"), F.col("embedding").alias("own"))
    other = vectors.select(F.col("vec_id").alias("second"), F.col("embedding").alias("other"))
    placed = docs.withColumn("second", (F.col("place") + F.col("turn")) % count)
    embedding = _mixed(F.col("own"), F.col("other"), F.col("turn") * 0.25).cast("array<float>")
    return (
        placed.join(own, "place", "left")
        .join(other, "second", "left")
        .select("pos", "text", embedding.alias("embedding"))
    )


def vector_place(spark: SparkSession, sf_dir: str, key: str) -> tuple[Column, Column]:
    """The id of the vector a row takes, and its round."""
    count = table(spark, sf_dir, "embeddings").count()
    return F.col(key) % count, F.floor(F.col(key) / count)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.split("text", "\n", -1).alias("paragraphs"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, name, parameters)``: each event as a call of the tool its type names."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("name"),
        F.from_json("props", "map<string,string>").alias("parameters"),
    )


LIST_LINK = r'<li><a href="([^"]*)">([^<]*)</a></li>'


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with each list link written as a search result block."""
    block = r'<div class="b_algo"><h2><a href="$1">$2</a></h2><p>$1</p></div>'
    return pages(spark, sf_dir).select(
        F.col("page_id").alias("query_id"), F.regexp_replace("html", LIST_LINK, block).alias("html")
    )


def answer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a stored answer page of both sources, its list entries as answers."""
    first = (
        '<div class="List-item"><h2>$1</h2><span class="RichText ztext '
        'CopyrightRichText-richText css-117anjg">$2 <b>$1</b></span></div>'
    )
    second = '<div class="rich-content-container rich-text-">$2<br>$1</div>'
    forms = F.array(
        F.struct(F.lit("https://www.zhihu.com/question/").alias("site"), F.lit(first).alias("entry")),
        F.struct(
            F.lit("https://zhidao.baidu.com/question/").alias("site"), F.lit(second).alias("entry")
        ),
    )
    return pages(spark, sf_dir).withColumn("form", F.explode(forms)).select(
        F.concat(F.col("form.site"), F.col("page_id")).alias("url"),
        F.regexp_replace("html", F.lit(LIST_LINK), F.col("form.entry")).alias("html"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, choice, pos, title, url)``: the list links of each page as search hits.

    Hit i of page q points to the answer page of q + i div 4, so hits repeat, some pages
    are not stored, and some titles or urls fail their source rule.
    """
    pages = table(spark, sf_dir, "pages")
    titles = F.regexp_extract_all("html", F.lit(LIST_LINK), F.lit(2))
    hits = pages.select(
        F.col("page_id").alias("query_id"), F.posexplode(titles).alias("pos", "word")
    )
    page = (F.col("query_id") + F.floor(F.col("pos") / 4)).cast("string")
    zhihu = F.col("pos") % 2 == 0
    return hits.select(
        "query_id",
        F.when(zhihu, "知乎回答").otherwise("百度知道").alias("choice"),
        F.col("pos").cast("long").alias("pos"),
        F.when(F.col("pos") % 5 == 4, F.lit("其他"))
        .otherwise(F.when(zhihu, F.lit("回答 - 知乎")).otherwise(F.lit("百度知道")))
        .alias("title"),
        F.concat(
            F.when(zhihu, F.lit("https://www.zhihu.com/question/")).otherwise(
                F.lit("https://zhidao.baidu.com/question/")
            ),
            page,
        ).alias("url"),
    )


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, response)``: the list links of each page as a JSON search response.

    Words with an e become hits; the title is left out of words ending with a comma, the
    snippet out of links longer than eight characters.
    """
    pages = table(spark, sf_dir, "pages")
    words = F.filter(
        F.regexp_extract_all("html", F.lit(LIST_LINK), F.lit(2)), lambda w: F.contains(w, F.lit("e"))
    )
    items = F.transform(
        words,
        lambda w: F.struct(
            F.when(~F.endswith(w, F.lit(",")), w).alias("title"),
            F.when(F.length(w) <= 8, F.concat(F.lit("/"), w)).alias("snippet"),
        ),
    )
    response = F.when(F.size(words) == 0, F.lit("{}")).otherwise(
        F.to_json(F.struct(items.alias("items")))
    )
    return pages.select(F.col("page_id").alias("query_id"), response.alias("response"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reply as it grows word by word."""
    words = pairs(spark, sf_dir).withColumn("words", F.split("resp", " "))
    steps = words.select(
        "conv_id", "turn", "prompt", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("seq")
    )
    return steps.select(
        "conv_id",
        "turn",
        "prompt",
        F.col("seq").cast("long").alias("seq"),
        F.array_join(F.slice("words", 1, F.col("seq")), " ").alias("resp"),
    )


def write_arrays(df: DataFrame, tag: str) -> str:
    """Write each partition as one JSON array file, streaming through it."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["["]})
        lead = ""
        for batch in batches:
            out = []
            for text in batch["value"]:
                out.append(lead + text)
                lead = ","
            yield pd.DataFrame({"value": out})
        yield pd.DataFrame({"value": ["]"]})

    path = scratch_path(df.sparkSession, tag)
    objects = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    objects.mapInPandas(lines, "value string").write.text(path)
    return path

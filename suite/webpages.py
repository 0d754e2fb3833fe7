"""Search responses, result pages and answer pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import inputs as I
from suite.sql import LINK, WS, literal
from talkloom.functions.prompts import DEFAULT_PERSONA_INFO
from talkloom.functions.strings import strip_markup
from talkloom.operators import web as W

CHOICES = ["知乎回答", "百度知道", "其他"]


def w1_search_snippets(spark, sf_dir):
    return I.search_responses(spark, sf_dir).select(
        "query_id", W.search_snippets(F.col("response")).alias("context")
    )


def w2_extract_links(spark, sf_dir):
    return W.extract_results(I.result_pages(spark, sf_dir), "query_id")


def w3_filter_source(spark, sf_dir):
    return W.filter_source(I.page_links(spark, sf_dir))


def w4_distinct_links(spark, sf_dir):
    return W.distinct_links(I.page_links(spark, sf_dir), ["query_id", "choice"])


def w5_extract_blocks(spark, sf_dir):
    found = W.extract_answers(I.pages(spark, sf_dir), ["page_id"], "ad", None)
    return found.select("page_id", F.array_join("answers", "|").alias("answers"))


def w6_join_blocks(spark, sf_dir):
    _, _, url, block, inner = W.SOURCE_RULES[0]
    pages = I.answer_pages(spark, sf_dir).filter(F.contains("url", F.lit(url)))
    found = W.extract_answers(pages, ["url"], block, inner)
    return found.select("url", W.join_answers(F.col("answers")).alias("text"))


def w7_collect_sources(spark, sf_dir):
    found = W.collect_sources(I.page_links(spark, sf_dir), I.answer_pages(spark, sf_dir))
    lines = F.transform("sources", lambda s: F.concat(s["url"], F.lit(" "), s["text"]))
    return found.select("query_id", "choice", F.array_join(lines, "\n").alias("sources"))


def w8_answer_list(spark, sf_dir):
    questions = I.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("query_id"), F.explode(F.array(*map(F.lit, CHOICES))).alias("choice")
    )
    found = W.answer_list(questions, I.page_links(spark, sf_dir), I.answer_pages(spark, sf_dir))
    return found.select(
        "query_id",
        "choice",
        F.array_join("answers", "\n").alias("answers"),
        F.array_join("urls", "\n").alias("urls"),
    )


def w9_info_default(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages")
    title = strip_markup(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    infos = pages.select("page_id", title.alias("info")).filter(F.contains("info", F.lit("ing")))
    return W.info_or_default(pages.select("page_id"), infos, "page_id", DEFAULT_PERSONA_INFO)


QUERIES = {
    f.__name__: f
    for f in [
        w1_search_snippets,
        w2_extract_links,
        w3_filter_source,
        w4_distinct_links,
        w5_extract_blocks,
        w6_join_blocks,
        w7_collect_sources,
        w8_answer_list,
        w9_info_default,
    ]
}


def strip(text: str) -> str:
    return f"regexp_replace({text}, '<[^>]+>|{WS}', '', 'g')"


WORDS = f"""
words AS (
  SELECT page_id, unnest(range(0, len(w))) AS pos, unnest(h) AS href, unnest(w) AS word FROM (
    SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS h, regexp_extract_all(html, '{LINK}', 2) AS w
    FROM pages)
)"""

SEARCHES = WORDS + f""",
hits AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n,
    CASE WHEN word LIKE '%,' THEN '' ELSE word || '。' END
    || CASE WHEN length(word) <= 8 THEN '/' || word ELSE '' END AS text
  FROM words WHERE contains(word, 'e')
),
searches AS (
  SELECT page_id AS query_id, coalesce(
    (SELECT string_agg(text, chr(10) || chr(10) ORDER BY n) FROM hits h
     WHERE h.page_id = p.page_id AND n <= 2), {literal(W.NO_RESULT)}) AS context
  FROM pages p
)"""

_LINKS = WORDS + """,
links AS (
  SELECT page_id AS query_id, pos,
    CASE WHEN pos % 2 = 0 THEN '知乎回答' ELSE '百度知道' END AS choice,
    CASE WHEN pos % 5 = 4 THEN '其他' WHEN pos % 2 = 0 THEN '回答 - 知乎' ELSE '百度知道' END AS title,
    CASE WHEN pos % 2 = 0 THEN 'https://www.zhihu.com/question/'
      ELSE 'https://zhidao.baidu.com/question/' END || (page_id + pos // 4) AS url
  FROM words
)"""

_SOURCES = _LINKS + f""",
kept AS (
  SELECT query_id, choice, title, url, min(pos) AS pos FROM links WHERE title <> '其他'
  GROUP BY query_id, choice, title, url
),
answers AS (
  SELECT page_id, string_agg({strip("word || href")}, ' ' ORDER BY pos) AS text FROM words GROUP BY page_id
),
sources AS (
  SELECT query_id, choice, url, substring(coalesce(text, ''), 1, 300) AS text,
    row_number() OVER (PARTITION BY query_id, choice ORDER BY pos) AS n
  FROM kept LEFT JOIN answers ON page_id = regexp_extract(url, '[0-9]+$')::BIGINT
)"""

ORACLES = {
    "w1_search_snippets": f"WITH {SEARCHES} SELECT query_id, context FROM searches",
    "w2_extract_links": f"""
WITH {WORDS} SELECT page_id AS query_id, pos, {strip("word")} AS title, href AS url FROM words""",
    "w3_filter_source": f"""
WITH {_LINKS} SELECT query_id, choice, pos, title, url FROM links WHERE title <> '其他'""",
    "w4_distinct_links": f"""
WITH {_LINKS} SELECT query_id, choice, title, url, min(pos) AS pos FROM links
GROUP BY query_id, choice, title, url""",
    "w5_extract_blocks": f"""
SELECT page_id, array_to_string(list_transform(
  regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1), lambda b: {strip("b")}), '|') AS answers
FROM pages""",
    "w6_join_blocks": f"""
WITH {WORDS}
SELECT 'https://www.zhihu.com/question/' || p.page_id AS url, coalesce(text, '') AS text
FROM pages p LEFT JOIN (
  SELECT page_id, string_agg({strip("word || href")}, ' ' ORDER BY pos) AS text FROM words GROUP BY page_id
) USING (page_id)""",
    "w7_collect_sources": f"""
WITH {_SOURCES}
SELECT query_id, choice, string_agg(url || ' ' || text, chr(10) ORDER BY n) AS sources
FROM sources GROUP BY query_id, choice""",
    "w8_answer_list": f"""
WITH {_SOURCES},
listed AS (
  SELECT query_id, choice, string_agg('来源' || n || ':' || text, chr(10) ORDER BY n) AS answers,
    string_agg(url, chr(10) ORDER BY n) AS urls
  FROM sources GROUP BY query_id, choice
),
asked AS (SELECT page_id AS query_id, unnest(['知乎回答', '百度知道', '其他']) AS choice FROM pages)
SELECT query_id, choice, coalesce(answers, '') AS answers, coalesce(urls, '') AS urls
FROM asked LEFT JOIN listed USING (query_id, choice)""",
    "w9_info_default": f"""
SELECT page_id, CASE WHEN contains(title, 'ing') THEN title ELSE {literal(DEFAULT_PERSONA_INFO)} END AS info
FROM (SELECT page_id, {strip("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title FROM pages)""",
}

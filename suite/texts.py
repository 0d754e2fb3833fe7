"""Prompts, scalar text rules and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import inputs as I
from suite.sql import LINES, WS, filled, literal
from talkloom.functions import prompts as P
from talkloom.functions import strings as S
from talkloom.operators import chunk as C

ALLOWED = ["click", "view", "purchase"]


def _users(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations")
    return turns.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def p3_last_line(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", S.last_line(F.col("text")).alias("line")
    )


def p4_intent_prompt(spark, sf_dir):
    docs = F.concat(F.lit("turn "), F.col("turn").cast("string"))
    return _users(spark, sf_dir).select(
        "conv_id", "turn", P.intent_prompt(docs, F.col("text")).alias("prompt")
    )


def _tool():
    return (
        F.when(F.col("turn") % 3 == 0, P.SEARCH_TOOL)
        .when(F.col("turn") % 3 == 1, P.CLASSIFICATION_TOOL)
        .otherwise(P.DEFAULT_TOOL)
    )


def p5_qa_prompt(spark, sf_dir):
    context = F.concat(F.lit("role "), F.col("role"))
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", P.qa_prompt(_tool(), context, F.col("text")).alias("prompt")
    )


def p6_context(spark, sf_dir):
    chat = P.chat_context(F.col("text"))
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("turn") % 2 == 0, P.classification_context()).otherwise(chat).alias("context"),
    )


def p7_query_prefix(spark, sf_dir):
    return I.table(spark, sf_dir, "benchmark").select(
        "item_id", P.query_instruction(F.col("text")).alias("query")
    )


def p8_persona_prompt(spark, sf_dir):
    return I.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        P.persona_prompt(F.col("role"), F.lit("聊天"), F.split("text", " ")).alias("prompt"),
    )


def p9_strip_markup(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select(
        "page_id", S.strip_markup(F.col("html")).alias("text")
    )


def p10_truncate(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", S.truncate(F.col("text")).alias("text"))


def p11_number_sources(spark, sf_dir):
    words = F.regexp_extract_all("html", F.lit(I.LIST_LINK), F.lit(2))
    return I.table(spark, sf_dir, "pages").select(
        "page_id", F.array_join(S.number_sources(words), "|").alias("sources")
    )


def p12_allowed_value(spark, sf_dir):
    found = S.allowed_value(F.col("event_type"), ALLOWED)
    return I.table(spark, sf_dir, "events").select(
        "event_id", found["emotion"].alias("emotion"), found["user"].alias("user")
    )


def p13_to_json(spark, sf_dir):
    found = S.allowed_value(F.col("event_type"), ALLOWED)
    return I.table(spark, sf_dir, "events").select("event_id", S.json_result(found).alias("result"))


def p14_route_by_length(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select(
        "doc_id", S.route_by_length(F.col("text")).alias("route")
    )


# Chunking


def c1_pack_paragraphs(spark, sf_dir):
    docs = I.document_lines(spark, sf_dir)
    return C.pack_paragraphs(docs, "doc_id", F.col("paragraphs"))


def _paragraph_rows(spark, sf_dir):
    docs = I.document_lines(spark, sf_dir)
    return docs.select("doc_id", F.posexplode("paragraphs").alias("pos", "text"))


def c1_pack_paragraph_rows(spark, sf_dir):
    """The form for one row per paragraph; short segments make long documents of many."""
    return C.pack_paragraph_rows(_paragraph_rows(spark, sf_dir), "doc_id", segment=64)


def c2_page_passages(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select(
        "url", "page_id", S.strip_markup(F.col("html")).alias("text")
    )
    return C.page_passages(pages, "url", "page_id", "text")


def c3_line_passages(spark, sf_dir):
    return C.line_passages(I.table(spark, sf_dir, "documents"), "doc_id", "text")


def s7_mixed_corpus_union(spark, sf_dir):
    """Documents as parsed files, their kind by source, in one corpus."""
    number = F.substring("source", 4, 10).cast("int") % 3
    kind = F.when(number == 0, "docx").when(number == 1, "pdf").otherwise("txt")
    docs = I.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("file"), kind.alias("kind"), "text"
    )
    units = docs.filter(F.col("kind") != "txt").select(
        "file", "kind", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")
    )
    lines = C.line_passages(docs.filter(F.col("kind") == "txt"), "file", "text").withColumnRenamed(
        "chunk_pos", "pos"
    )
    return C.build_corpus(units, lines)


QUERIES = {
    f.__name__: f
    for f in [
        p3_last_line,
        p4_intent_prompt,
        p5_qa_prompt,
        p6_context,
        p7_query_prefix,
        p8_persona_prompt,
        p9_strip_markup,
        p10_truncate,
        p11_number_sources,
        p12_allowed_value,
        p13_to_json,
        p14_route_by_length,
        c1_pack_paragraphs,
        c1_pack_paragraph_rows,
        c2_page_passages,
        c3_line_passages,
        s7_mixed_corpus_union,
    ]
}

# Packs one paragraph per step, in all documents at once.
_PACKED = LINES + """,
kept AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM lines WHERE length(text) > 1
),
walk(doc_id, i, chunk_pos, open_len) AS (
  SELECT doc_id, i, 0::BIGINT, length(text) FROM kept WHERE i = 1
  UNION ALL
  SELECT w.doc_id, k.i,
    CASE WHEN w.open_len > 150 THEN w.chunk_pos + 1 ELSE w.chunk_pos END,
    CASE WHEN w.open_len > 150 THEN length(k.text) ELSE w.open_len + length(k.text) END
  FROM walk w JOIN kept k ON k.doc_id = w.doc_id AND k.i = w.i + 1
),
packed AS (
  SELECT doc_id, chunk_pos, string_agg(text, '' ORDER BY i) AS text
  FROM walk JOIN kept USING (doc_id, i) GROUP BY doc_id, chunk_pos
),
emitted AS (
  SELECT doc_id, chunk_pos, text FROM (
    SELECT *, max(chunk_pos) OVER (PARTITION BY doc_id) AS last FROM packed
  ) WHERE chunk_pos < last
)"""

_READ_LINES = "SELECT doc_id, pos, text, max(pos) OVER (PARTITION BY doc_id) AS last FROM lines"

ORACLES = {
    "p3_last_line": f"""
SELECT doc_id, regexp_replace(string_split(text, chr(10))[-1], '^{WS}+|{WS}+$', '', 'g') AS line
FROM documents""",
    "p4_intent_prompt": f"""
SELECT conv_id, turn, {filled(P.INTENT_TEMPLATE, docs="'turn ' || turn", query="text")} AS prompt
FROM conversations WHERE role = 'user'""",
    "p5_qa_prompt": f"""
SELECT conv_id, turn, CASE WHEN turn % 3 = 0
  THEN {filled(P.SEARCH_QA_TEMPLATE, text="'role ' || role", query="text")}
  ELSE {filled(P.QA_TEMPLATE, text="'role ' || role", query="text")} END AS prompt
FROM conversations""",
    "p6_context": f"""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {literal(P.CLASSIFICATION_CONTEXT)}
  ELSE {literal(P.CHAT_CONTEXT)} || text END AS context
FROM conversations""",
    "p7_query_prefix": "SELECT item_id, '为这个句子生成表示，用于检索相关文章：' || text AS query FROM benchmark",
    "p8_persona_prompt": f"""
SELECT conv_id, turn, {filled(P.PERSONA_TEMPLATE, user="role", emotion="'聊天'",
                              info="replace(text, ' ', chr(10))")} AS prompt
FROM conversations""",
    "p9_strip_markup": f"""
SELECT page_id, regexp_replace(html, '<[^>]+>|{WS}', '', 'g') AS text FROM pages""",
    "p10_truncate": "SELECT doc_id, substring(text, 1, 300) AS text FROM documents",
    "p11_number_sources": """
SELECT page_id, array_to_string(list_transform(range(1, len(words) + 1),
  lambda i: '来源' || i || ':' || words[i]), '|') AS sources
FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS words
      FROM pages)""",
    "p12_allowed_value": """
SELECT event_id,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS emotion,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '旅行者' END AS user
FROM events""",
    "p13_to_json": """
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase')
  THEN '{"emotion":"' || event_type || '","user":"旅行者"}' ELSE 'null' END AS result
FROM events""",
    "p14_route_by_length": """
SELECT doc_id, CASE WHEN length(text) > 512 THEN 'l2' ELSE 'cosine' END AS route FROM documents""",
    "c1_pack_paragraphs": f"WITH RECURSIVE {_PACKED} SELECT doc_id, chunk_pos, text FROM emitted",
    "c1_pack_paragraph_rows": f"WITH RECURSIVE {_PACKED} SELECT doc_id, chunk_pos, text FROM emitted",
    "c2_page_passages": f"""
SELECT url, page_id AS chunk_pos, regexp_replace(html, '<[^>]+>|{WS}', '', 'g') AS text
FROM pages""",
    "c3_line_passages": f"""
WITH {LINES} SELECT doc_id, pos AS chunk_pos, text FROM ({_READ_LINES})
WHERE NOT (pos = last AND text = '')""",
    "s7_mixed_corpus_union": f"""
WITH RECURSIVE {_PACKED},
kinds AS (
  SELECT doc_id, CASE substring(source, 4)::INT % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'txt' END
    AS kind FROM documents
)
SELECT doc_id::VARCHAR AS file, kind, chunk_pos, text
FROM emitted JOIN kinds USING (doc_id) WHERE kind = 'docx'
UNION ALL
SELECT doc_id::VARCHAR, kind, pos, text FROM lines JOIN kinds USING (doc_id) WHERE kind = 'pdf'
UNION ALL
SELECT doc_id::VARCHAR, kind, pos, text FROM ({_READ_LINES}) JOIN kinds USING (doc_id)
WHERE kind = 'txt' AND NOT (pos = last AND text = '')""",
}

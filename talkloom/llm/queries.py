"""The registered queries of this package, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import chat_format, decontaminate, divergence, hard_negatives, mixing, neardup, quality, rules, token_counts, token_files, toxicity, urls, warc
from talkloom.llm.url_labels import labelled_urls
from talkloom.sources.scratch import scratch_path

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rules.judge(table(spark, sf_dir, "documents")).select(*columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    rows = turns.unionByName(added).withColumn("parts", chat_format.text_parts("text"))
    return chat_format.conversation_digests(chat_format.format_turns(rows))


URL_RULES = [
    urls.Rule("com", "/", "allow"),
    urls.Rule("example.com", "/en/", "block"),
    urls.Rule("www.example.com", "/en/", "allow"),
    urls.Rule("net", "/es/", "block"),
    urls.Rule("net", "/fr/", "block"),
]

LABELLED_URLS = labelled_urls()


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = urls.labelled_table(spark, LABELLED_URLS)
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, labelled)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives, then read them back."""
    archive = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return archive.records(with_payload=False).select(*columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def token_rows(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write the files, find every document by the index, read its ids."""
    files = token_files.write_tokens(docs, folder, tokenizer)
    rows = files.read(files.locate(files.entries), token_files.ids_crc32, "ids_crc32 long")
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), tokenizer_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows with an id divisible by 100; every seventh id has a wrong label."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        hard_negatives.whole_components("embedding").alias("vector"),
    )
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_decontamination, op2_quality, op3_toxicity, op4_quality_rules, op5_mixing,
        op6_chat_format, op7_url_filter, op8_warc, op9_near_duplicates, op10_token_files,
        op11_hard_negatives, op12_source_divergence, op13_token_counts,
    )
}

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, key: str) -> str:
    """A common table (key, shingles): the distinct five-word runs of each text; a shorter text is one run."""
    return f"""
{name} AS (
  SELECT {key}, CASE
      WHEN len(w) = 0 THEN []
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles
  FROM (SELECT {key}, {_WORDS.format(text=_LOWER)} AS w FROM {{table}})
)"""


_LEAKS = f"""
WITH {_shingles('d', 'doc_id').format(table='documents')}, {_shingles('b', 'item_id').format(table='benchmark')},
du AS (SELECT doc_id, unnest(shingles) AS s FROM d),
bu AS (SELECT item_id, unnest(shingles) AS s FROM b),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM du JOIN bu USING (s) GROUP BY ALL)
SELECT doc_id, item_id, len(shingles)::BIGINT AS item_shingles, shared::BIGINT AS shared, shared / len(shingles) AS containment
FROM hits JOIN b USING (item_id)
WHERE 100 * shared >= {decontaminate.PERCENT} * len(shingles)
"""

_NEAR = f"""
WITH RECURSIVE {_shingles('d', 'doc_id').format(table='documents')},
u AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM d),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {neardup.PERCENT} * (a.n + b.n - count(*))
),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN low USING (doc_id)
"""

_MEASURE_SQL = {
    name: f"CASE WHEN {of} > 0 THEN {part} * 1000 // {of} ELSE 0 END"
    for name, (part, of, _) in rules.MEASURES.items()
}

_RULES = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
grams AS (SELECT doc_id, i, w[i:i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id
),
f AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed,
  {", ".join(f"{sql} AS v_{name}" for name, sql in _MEASURE_SQL.items())} FROM m),
v AS (
  {" UNION ALL ".join(f"SELECT lang, source, '{name}' AS measure, v_{name}::BIGINT AS v, {width} AS width FROM f WHERE NOT base_failed" for name, (_, _, width) in rules.MEASURES.items())}
),
bits AS (SELECT *, greatest(length(bin(v)) - {rules.BITS}, 0) AS lost FROM v),
bins AS (SELECT lang, source, measure, width, (v >> lost) << lost AS low, ((v >> lost) << lost) + (1::BIGINT << lost) - 1 AS up FROM bits),
levels AS (
  SELECT 0 AS level, lang, source, measure, low, up, width FROM bins
  UNION ALL SELECT 1, lang, NULL, measure, low, up, width FROM bins
  UNION ALL SELECT 2, NULL, NULL, measure, low, up, width FROM bins
),
q AS (
  SELECT level, lang, source, measure, count(*) AS total,
    quantile_disc(low, 0.5) AS median, quantile_disc(up, {rules.QUANTILE}) AS high, any_value(width) AS width
  FROM levels GROUP BY ALL
),
fences AS (
  SELECT level, lang, source, measure, total::DOUBLE AS total,
    greatest(high + {rules.REACH} * (high - median), median + width)::DOUBLE AS fence FROM q
),
limits AS (
  SELECT s.lang, s.source, s.measure,
    (s.total * s.fence + {rules.PRIOR} * ((l.total * l.fence + {rules.PRIOR} * g.fence) / (l.total + {rules.PRIOR}))) / (s.total + {rules.PRIOR}) AS fence
  FROM fences s
  JOIN fences l ON l.level = 1 AND l.measure = s.measure AND l.lang IS NOT DISTINCT FROM s.lang
  JOIN fences g ON g.level = 2 AND g.measure = s.measure
  WHERE s.level = 0
),
wide AS (SELECT lang, source, {", ".join(f"max(fence) FILTER (measure = '{name}') AS f_{name}" for name in rules.MEASURES)} FROM limits GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"coalesce(v_{name} <= f_{name}, true)" for name in rules.MEASURES)} AS kept
FROM f LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM f.lang AND wide.source IS NOT DISTINCT FROM f.source
"""

_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS.format(text="coalesce(text, '')")})::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS place
  FROM documents
),
s AS (
  SELECT source, sum(size)::BIGINT AS size, {mixing.MAX_EPOCHS} * sum(size)::BIGINT AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
),
total AS (SELECT sum(size)::BIGINT AS t, sum(weight)::BIGINT AS w FROM s),
steps AS (
  SELECT k, CASE WHEN w - held_w > 0 THEN (t - held) / (w - held_w) END AS level FROM (
    SELECT row_number() OVER o AS k, sum(cap) OVER o AS held, sum(weight) OVER o AS held_w FROM s
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT 0, 0, 0
  ), total
),
level AS (SELECT min_by(level, k) AS level FROM steps WHERE (SELECT count(*) FROM s WHERE cap < steps.level * weight) = k),
plan AS (
  SELECT source, size AS source_size, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM s, level
),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, {mixing.MAX_EPOCHS}) ELSE 0 END AS whole FROM plan
),
placed AS (
  SELECT d.doc_id, d.size, source_size, target, whole, target - whole * source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY place, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *, length(role) + length(text) + 15
    + len(regexp_extract_all(role || ' ' || text, '\\|<turn>|</turn>|<(?:image|audio|document):[0-9]+>')) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id < top THEN top END AS refers_to
FROM last
"""

_MINED = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES}
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {hard_negatives.NEGATIVES}
"""

_AUDIT = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
),
t AS (SELECT r, lang, source, unnest(found) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS kinds, sum(n) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
w AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + ({divergence.SCALE}::HUGEINT * (coalesce(c.n, 0) + {divergence.PRIOR})) // (w.total + {divergence.PRIOR} * kinds) AS p,
    1 + ({divergence.SCALE}::HUGEINT * (k.n + {divergence.PRIOR})) // (v.total + {divergence.PRIOR} * kinds) AS q
  FROM w JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
),
everything AS (
  SELECT * FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM everything QUALIFY part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""

ORACLES: dict[str, str] = {
    "op1_decontamination": _LEAKS,
    "op4_quality_rules": _RULES,
    "op5_mixing": _MIX,
    "op6_chat_format": _CHAT,
    "op8_warc": _WARC,
    "op9_near_duplicates": _NEAR,
    "op11_hard_negatives": _MINED,
    "op12_source_divergence": _AUDIT,
}

"""Pieces of SQL shared by the checks."""

# White space as Python sees it; RE2's \s knows ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

NEWLINE = "chr(10)"

PAIRS = """
seen AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
pairs AS (
  SELECT conv_id, turn, text AS prompt, next_text AS resp FROM seen
  WHERE role = 'user' AND next_role = 'assistant'
)"""

RECORDS = PAIRS + """,
systems AS (
  SELECT conv_id, arg_min(text, turn) AS input FROM conversations
  WHERE role = 'system' GROUP BY conv_id
),
records AS (
  SELECT conv_id, turn, prompt AS instruction, input, resp AS output
  FROM pairs LEFT JOIN systems USING (conv_id)
)"""

PROMPTS = RECORDS + """,
prompts AS (
  SELECT conv_id, turn,
    'Instruction: ' || instruction || chr(10)
    || CASE WHEN coalesce(input, '') <> '' THEN 'Input: ' || input || chr(10) ELSE '' END
    || 'Answer: ' AS context,
    output AS target
  FROM records
)"""


def codes(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: unicode(substring({text}, i, 1)))"


TOKENS = PROMPTS + f""",
encoded AS (
  SELECT conv_id, turn,
    list_concat([1], list_slice({codes('context')}, 1, 199)) AS p,
    list_slice({codes('target')}, 1, 200) AS t
  FROM prompts
),
assembled AS (
  SELECT conv_id, turn, len(p) AS n_prompt, len(t) AS n_target,
    list_concat(list_concat(p, t), [2]) AS ids
  FROM encoded
)"""

QUESTIONS = """
questions AS (
  SELECT a.vec_id AS query_id,
    list_transform(range(1, len(a.embedding) + 1), lambda i:
      a.embedding[i]::DOUBLE + coalesce(b.embedding[i]::DOUBLE, 0) * 0.9::DOUBLE
      + coalesce(c.embedding[i]::DOUBLE, 0) * 0.8::DOUBLE) AS q
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1
  LEFT JOIN embeddings c ON c.vec_id = a.vec_id + 2
)"""

SIMS = QUESTIONS + """,
sims AS (
  SELECT query_id, vec_id AS pos,
    list_cosine_similarity(q, embedding::DOUBLE[]) AS sim
  FROM questions CROSS JOIN embeddings
)"""

# Every document with a vector, as in inputs.passages.
PASSAGES = """
placed_docs AS (
  SELECT doc_id AS pos, text, doc_id % n AS place, doc_id // n AS turn,
    (doc_id % n + doc_id // n) % n AS second
  FROM documents, (SELECT count(*) AS n FROM embeddings)
),
passages AS (
  SELECT pos, text, list_transform(range(1, len(a.embedding) + 1), lambda i:
    (a.embedding[i]::DOUBLE + turn * 0.25::DOUBLE * coalesce(b.embedding[i]::DOUBLE, 0))::FLOAT) AS v
  FROM placed_docs LEFT JOIN embeddings a ON a.vec_id = place LEFT JOIN embeddings b ON b.vec_id = second
)"""

DISTANCES_ONLY = """
distances AS (
  SELECT query_id, pos,
    list_sum(list_transform(range(1, len(q) + 1),
      lambda i: (q[i] - v[i]::DOUBLE) * (q[i] - v[i]::DOUBLE))) AS d
  FROM questions CROSS JOIN passages
)"""
DISTANCES = QUESTIONS + "," + PASSAGES + "," + DISTANCES_ONLY

LINES = """
lines AS (
  SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
)"""

LINK = '<li><a href="([^"]*)">([^<]*)</a></li>'

SNAPSHOTS = PAIRS + """,
worded AS (
  SELECT conv_id, turn, prompt, string_split(resp, ' ') AS words FROM pairs
),
stepped AS (
  SELECT conv_id, turn, prompt, words, unnest(range(1, len(words) + 1)) AS seq FROM worded
),
snapshots AS (
  SELECT conv_id, turn, prompt, seq, array_to_string(list_slice(words, 1, seq), ' ') AS resp
  FROM stepped
)"""


def literal(text: str) -> str:
    """A Python string as a SQL literal."""
    lines = ["'" + part.replace("'", "''") + "'" for part in text.split("\n")]
    return "(" + " || chr(10) || ".join(lines) + ")"


def filled(template: str, **values: str) -> str:
    """A template with ``{field}`` marks as a SQL expression."""
    pieces, rest = [], template
    while rest:
        at = {rest.find("{%s}" % name): name for name in values if "{%s}" % name in rest}
        if not at:
            pieces.append(literal(rest))
            break
        place = min(at)
        name = at[place]
        if place:
            pieces.append(literal(rest[:place]))
        pieces.append(f"({values[name]})")
        rest = rest[place + len(name) + 2 :]
    return " || ".join(pieces)

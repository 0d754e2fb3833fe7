"""Tool routing, tool calls, conversation history and growing replies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from suite import inputs as I
from suite.sql import PAIRS, SNAPSHOTS, literal
from talkloom.functions import plugins as U
from talkloom.functions.strings import allowed_value
from talkloom.functions.tools import SYSTEM_CONTENT
from talkloom.operators import chat as H
from talkloom.operators import route as N
from talkloom.operators.registry import match_registry
from talkloom.operators.shared_history import expanded_histories, shared_histories
from talkloom.plans.numbering import number_rows
from talkloom.sources.scratch import scratch_path, small_table, written
from talkloom.streaming import replies as ST

# Words that replies contain, standing for tool names; the order is the registry order.
NAMES = ["tion", "the", "en", "der", "que", "ción"]
KNOWLEDGE = {"tion": "kb-1", "the": None, "en": "kb-2", "der": None, "que": "kb-1", "default": "kb-0"}
#: Snapshots to a stored file, some 400 MB of text.
FILE_ROWS = 500_000
REQUIRED = {"view": ["k"], "click": ["k", "user"], "signup": ["user", "k", "emotion"], "error": []}


def _replies(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations")
    return turns.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")


def i1_match_tools(spark, sf_dir):
    found = N.match_tools(F.col("text"), NAMES)
    places = F.transform(found, lambda m: F.concat_ws("@", m["name"], m["at"].cast("string")))
    return _replies(spark, sf_dir).select("conv_id", "turn", F.array_join(places, ",").alias("tools"))


def i1_match_registry(spark, sf_dir):
    """All words of the benchmark as tool names, sought at once."""
    words = I.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name"))
    registry = number_rows(words.where("length(name) >= 4").distinct(), ["name"], "ord")
    found = match_registry(_replies(spark, sf_dir), registry, "text", "found")
    places = F.transform("found", lambda m: F.concat_ws("@", m["name"], m["at"].cast("string")))
    return found.select("conv_id", "turn", F.array_join(places, ",").alias("tools"))


def i2_route(spark, sf_dir):
    return _replies(spark, sf_dir).select(
        "conv_id", "turn", N.route(F.col("text"), NAMES).alias("tool")
    )


def i3_dispatch(spark, sf_dir):
    actions = _replies(spark, sf_dir).select(
        "conv_id", "turn", N.route(F.col("text"), NAMES).alias("tool_name")
    )
    return N.dispatch(actions, N.tool_registry(spark, KNOWLEDGE)).select(
        "conv_id", "turn", "tool_name", "kb_id"
    )


def i4_parse_call(spark, sf_dir):
    """Events as replies: errors answer in plain text, all others with a tool call."""
    call = F.concat(
        F.lit('{"name": "'), F.col("event_type"), F.lit('", "parameters": '), F.col("props"), F.lit("}")
    )
    text = F.concat(F.lit("error "), F.col("props"))
    reply = F.when(F.col("event_type") == "error", text).otherwise(call)
    parsed = I.table(spark, sf_dir, "events").select("event_id", reply.alias("reply")).select(
        "event_id", "reply", N.parse_tool_call(F.col("reply")).alias("call")
    )
    return parsed.select(
        "event_id",
        F.col("call.name").alias("name"),
        F.col("call.parameters")["k"].alias("k"),
        F.when(F.col("call").isNull(), F.col("reply")).alias("text"),
    )


def _registry(spark):
    return N.tool_registry(spark, {"view": "a", "click": "b", "purchase": None, "signup": "c"}).select(
        F.col("tool_name").alias("name"), "kb_id"
    )


def i5_resolve(spark, sf_dir):
    found = N.resolve_calls(I.tool_calls(spark, sf_dir), _registry(spark))
    return found.select("event_id", "name", "kb_id", F.col("parameters")["k"].alias("k"))


def i5_unresolved(spark, sf_dir):
    lost = N.unresolved_calls(I.tool_calls(spark, sf_dir), _registry(spark))
    return lost.select("event_id", "name", F.col("parameters")["k"].alias("k"))


def i6_missing_params(spark, sf_dir):
    specs = small_table(
        spark,
        {"name": list(REQUIRED), "required": list(REQUIRED.values())},
        required=pa.list_(pa.string()),
    )
    lacking = N.missing_parameters(I.tool_calls(spark, sf_dir), specs)
    return lacking.select("event_id", "name", F.array_join("missing", ",").alias("missing"))


def u4_tool_functions(spark, sf_dir):
    tools = {
        "click": lambda p: allowed_value(p["k"], [str(i) for i in range(50)]),
        "view": lambda p: F.struct(p["k"].alias("seen")),
    }
    done = U.apply_tools(I.tool_calls(spark, sf_dir), tools)
    return done.select("event_id", "name", "result")


def h1_pair_turns(spark, sf_dir):
    return I.pairs(spark, sf_dir)


def h1_pair_turns_segments(spark, sf_dir):
    """The form a very long conversation takes: segments of two turns."""
    return H.pair_turns(I.table(spark, sf_dir, "conversations"), segment=2)


def _history_text():
    lines = F.transform("history", lambda p: F.concat(p["prompt"], F.lit(" => "), p["resp"]))
    return F.array_join(lines, "\n")


def _history(pairs, **options):
    return H.history_before(pairs, **options).select(
        "conv_id", "turn", F.size("history").cast("long").alias("n_pairs"), _history_text().alias("history")
    )


def h2_history(spark, sf_dir):
    return _history(I.pairs(spark, sf_dir), turns=I.table(spark, sf_dir, "conversations"))


def h2_history_segments(spark, sf_dir):
    return _history(I.pairs(spark, sf_dir), segment=2)


def h2_history_latest(spark, sf_dir):
    """At most the two latest pairs."""
    return _history(I.pairs(spark, sf_dir), max_pairs=2, segment=3)


def h2_history_shared(spark, sf_dir):
    """Pairs stored once in short segments, every history put together from them."""
    turns, segments = shared_histories(I.pairs(spark, sf_dir), length=3)
    return expanded_histories(turns, segments, length=3).select(
        "conv_id", "turn", F.size("history").cast("long").alias("n_pairs"), _history_text().alias("history")
    )


def h3_no_history(spark, sf_dir):
    return _history(I.pairs(spark, sf_dir), add_history=False)


def h4_seed_system(spark, sf_dir):
    turns = I.table(spark, sf_dir, "conversations")
    seeded = H.seed_system(H.history_before(H.pair_turns(turns), turns=turns), turns)
    said = F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return seeded.select(
        "conv_id",
        "turn",
        F.array_join(said, "\n").alias("messages"),
        F.array_join(F.get("messages", 0)["tools"]["name"], ",").alias("tools"),
    )


def st1_latest_snapshot(spark, sf_dir):
    return ST.latest_snapshot(I.snapshots(spark, sf_dir))


def st2_suffix_delta(spark, sf_dir):
    return ST.suffix_delta(I.snapshots(spark, sf_dir))


def st2_suffix_delta_segments(spark, sf_dir):
    return ST.suffix_delta(I.snapshots(spark, sf_dir), segment=16)


def _snapshot_files(rows):
    """Files for so many snapshots: a task sorts one when it writes it, and again when it reads it."""
    return max(8, -(-rows // FILE_ROWS))


def _stored_snapshots(spark, sf_dir):
    """Snapshots on disk, each reply within one file and in order, and the number of files."""
    path = scratch_path(spark, "snapshots")
    words = F.sum(F.size(F.split("resp", " ")))
    files = _snapshot_files(I.pairs(spark, sf_dir).agg(words).first()[0] or 0)
    placed = I.snapshots(spark, sf_dir).repartition(files, "conv_id", "turn")
    placed.sortWithinPartitions("conv_id", "turn", "seq").write.parquet(path)
    return path, files


def st1_latest_snapshot_stream(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "offsets")
    path, _ = _stored_snapshots(spark, sf_dir)
    # Batches of a bounded size, however many: a batch's snapshots are sorted by the tasks that read it.
    stream = ST.read_snapshots(spark, path, files_per_batch=4)
    ST.latest_snapshot_stream(stream, out, checkpoint).awaitTermination()
    return ST.latest_snapshot(ST.read_log(spark, out))


def st1_latest_snapshot_compacted(spark, sf_dir):
    """The log kept in versions, merged as it grows, with its old versions removed."""
    log = ST.ReplyLog(spark, scratch_path(spark, "log"))
    path, files = _stored_snapshots(spark, sf_dir)
    # Eight commits: each costs a merge and manifests besides its rows.
    stream = ST.read_snapshots(spark, path, files_per_batch=-(-files // 8))
    ST.compacted_snapshot_stream(stream, log, scratch_path(spark, "offsets")).awaitTermination()
    log.table.expire()
    return log.latest()


def st2_suffix_delta_event_time(spark, sf_dir):
    """Conversations arrive in four hours; the state of an hour's replies ends in the next ones."""
    path = scratch_path(spark, "timed")
    hour, second = F.pmod("conv_id", F.lit(4)), F.pmod("seq", F.lit(3600))
    timed = written(I.snapshots(spark, sf_dir).withColumn("arrived", F.timestamp_seconds(3600 * hour + second)), "timed")
    files = max(4, -(-timed.count() // (4 * FILE_ROWS)))
    for k in range(4):
        # A folder of files for each hour, written in turn: files are read by their age.
        part = timed.where(hour == k).repartition(files, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq")
        part.write.mode("append").parquet(path)
    stream = ST.read_snapshots(spark, path, files_per_batch=files, arrival="arrived")
    deltas = ST.suffix_delta_stream(stream, idle_ms=600_000, arrival="arrived", delay="1 hour")
    out = scratch_path(spark, "deltas")
    ST.store_deltas(deltas, out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.schema(ST.DELTA).parquet(out)


def st2_suffix_delta_stream(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "deltas"), scratch_path(spark, "offsets")
    path, files = _stored_snapshots(spark, sf_dir)
    # Two batches: the state of replies is stored after each, whatever its size.
    stream = ST.read_snapshots(spark, path, files_per_batch=-(-files // 2))
    ST.store_deltas(ST.suffix_delta_stream(stream), out, checkpoint).awaitTermination()
    return spark.read.schema(ST.DELTA).parquet(out)


QUERIES = {
    f.__name__: f
    for f in [
        i1_match_tools,
        i1_match_registry,
        i2_route,
        i3_dispatch,
        i4_parse_call,
        i5_resolve,
        i5_unresolved,
        i6_missing_params,
        u4_tool_functions,
        h1_pair_turns,
        h1_pair_turns_segments,
        h2_history,
        h2_history_segments,
        h2_history_latest,
        h2_history_shared,
        h3_no_history,
        h4_seed_system,
        st1_latest_snapshot,
        st1_latest_snapshot_stream,
        st1_latest_snapshot_compacted,
        st2_suffix_delta,
        st2_suffix_delta_segments,
        st2_suffix_delta_stream,
        st2_suffix_delta_event_time,
    ]
}

_NAMES = ", ".join(f"({i}, '{name}')" for i, name in enumerate(NAMES))
_MATCHES = f"""
names(ord, name) AS (VALUES {_NAMES}),
matches AS (
  SELECT conv_id, turn, name, ord, instr(text, name) - 1 AS place
  FROM conversations CROSS JOIN names WHERE role = 'assistant' AND instr(text, name) > 0
),
routed AS (
  SELECT c.conv_id, c.turn, coalesce(m.name, 'default') AS tool
  FROM conversations c LEFT JOIN (
    SELECT conv_id, turn, arg_min(name, place * 10 + ord) AS name FROM matches GROUP BY conv_id, turn
  ) m USING (conv_id, turn) WHERE c.role = 'assistant'
)"""
_KB = ", ".join(f"('{n}', {'NULL' if kb is None else repr(kb)})" for n, kb in KNOWLEDGE.items())

_EARLIER = PAIRS + """,
histories AS (
  SELECT conv_id, turn, list(prompt || ' => ' || resp) OVER w AS history FROM pairs
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
_HISTORY = f"""
WITH {_EARLIER}
SELECT conv_id, turn, coalesce(len(history), 0) AS n_pairs,
  coalesce(array_to_string(history, chr(10)), '') AS history FROM histories"""
_DELTAS = f"""
WITH {SNAPSHOTS}
SELECT conv_id, turn, seq, substring(resp, coalesce(length(lag(resp) OVER w), 0) + 1) AS delta
FROM snapshots WINDOW w AS (PARTITION BY conv_id, turn ORDER BY seq)"""
_LATEST = f"""
WITH {SNAPSHOTS}
SELECT conv_id, turn, max(seq) AS seq, arg_max(prompt, seq) AS prompt, arg_max(resp, seq) AS resp
FROM snapshots GROUP BY conv_id, turn"""
_PAIRS = f"WITH {PAIRS} SELECT conv_id, turn, prompt, resp FROM pairs"

ORACLES = {
    "i1_match_tools": f"""
WITH {_MATCHES}
SELECT c.conv_id, c.turn, coalesce(m.tools, '') AS tools FROM conversations c LEFT JOIN (
  SELECT conv_id, turn, string_agg(name || '@' || place, ',' ORDER BY place, ord) AS tools
  FROM matches GROUP BY conv_id, turn) m USING (conv_id, turn)
WHERE c.role = 'assistant'""",
    "i1_match_registry": """
WITH names AS (
  SELECT name, row_number() OVER (ORDER BY name) AS ord
  FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE length(name) >= 4
),
replies AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
found AS (
  SELECT conv_id, turn, string_agg(name || '@' || (instr(text, name) - 1), ',' ORDER BY instr(text, name), ord) AS tools
  FROM replies JOIN names ON contains(text, name) GROUP BY conv_id, turn
)
SELECT conv_id, turn, coalesce(tools, '') AS tools FROM replies LEFT JOIN found USING (conv_id, turn)""",
    "i2_route": f"WITH {_MATCHES} SELECT conv_id, turn, tool FROM routed",
    "i3_dispatch": f"""
WITH {_MATCHES}, registry(tool_name, kb_id) AS (VALUES {_KB})
SELECT conv_id, turn, tool_name, kb_id FROM routed JOIN registry ON tool = tool_name""",
    "i4_parse_call": """
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS name,
  CASE WHEN event_type <> 'error' THEN props->>'k' END AS k,
  CASE WHEN event_type = 'error' THEN 'error ' || props END AS text
FROM events""",
    "i5_resolve": """
WITH registry(name, kb_id) AS (VALUES ('view', 'a'), ('click', 'b'), ('purchase', NULL), ('signup', 'c'))
SELECT event_id, name, kb_id, props->>'k' AS k FROM events JOIN registry ON event_type = name""",
    "i5_unresolved": """
SELECT event_id, event_type AS name, props->>'k' AS k FROM events
WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')""",
    "i6_missing_params": """
SELECT event_id, event_type AS name,
  CASE event_type WHEN 'click' THEN 'user' ELSE 'user,emotion' END AS missing
FROM events WHERE event_type IN ('click', 'signup')""",
    "u4_tool_functions": """
SELECT event_id, event_type AS name, CASE event_type
  WHEN 'view' THEN '{"seen":"' || (props->>'k') || '"}'
  WHEN 'click' THEN CASE WHEN (props->>'k')::INT < 50
    THEN '{"emotion":"' || (props->>'k') || '","user":"旅行者"}' ELSE 'null' END
  END AS result
FROM events""",
    "h1_pair_turns": _PAIRS,
    "h1_pair_turns_segments": _PAIRS,
    "h2_history": _HISTORY,
    "h2_history_segments": _HISTORY,
    "h2_history_shared": _HISTORY,
    "h2_history_latest": _HISTORY.replace("UNBOUNDED PRECEDING AND", "2 PRECEDING AND"),
    "h3_no_history": f"""
WITH {PAIRS} SELECT conv_id, turn, 0::BIGINT AS n_pairs, '' AS history FROM pairs""",
    "h4_seed_system": f"""
WITH {PAIRS},
said AS (
  SELECT conv_id, turn,
    list('user: ' || prompt || chr(10) || 'assistant: ' || resp) OVER w AS history FROM pairs
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
systems AS (
  SELECT conv_id, arg_min(text, turn) AS content FROM conversations
  WHERE role = 'system' GROUP BY conv_id
)
SELECT conv_id, turn, 'system: ' || coalesce(content, {literal(SYSTEM_CONTENT)})
  || coalesce(chr(10) || array_to_string(history, chr(10)), '') AS messages,
  'emotional_expert,flirting_hutao' AS tools
FROM said LEFT JOIN systems USING (conv_id)""",
    "st1_latest_snapshot": _LATEST,
    "st1_latest_snapshot_stream": _LATEST,
    "st1_latest_snapshot_compacted": _LATEST,
    "st2_suffix_delta": _DELTAS,
    "st2_suffix_delta_segments": _DELTAS,
    "st2_suffix_delta_stream": _DELTAS,
    "st2_suffix_delta_event_time": _DELTAS,
}

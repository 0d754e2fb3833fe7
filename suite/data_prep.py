"""Sources, instruction records, tokens and batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from suite import inputs as I
from suite.sql import LINES, PROMPTS, RECORDS, TOKENS, codes
from talkloom.operators.instruct import first_n, prompt_records
from talkloom.operators.tokens import (
    assemble,
    assign_batches,
    clip,
    collate,
    flatten_features,
    skip_overlength,
    tokenize,
    tokenize_corpus,
)
from talkloom.plans.training import batch_inference, training_batches, training_examples
from talkloom.sources import lines as L
from talkloom.sources import records as R
from talkloom.sources.schemas import INSTRUCTION, PROMPT_RECORD
from talkloom.sources.scratch import scratch_path

KEYS = [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType())]
RECORD = ["conv_id", "turn", "instruction", "input", "output"]
PROMPT = ["conv_id", "turn", "context", "target"]


# Sources and sinks


def s1_read_instructions(spark, sf_dir):
    path = I.write_arrays(I.records(spark, sf_dir), "arrays")
    schema = T.StructType(KEYS + INSTRUCTION.fields)
    return R.read_instructions(spark, path, schema).select(*RECORD)


def s1_read_instructions_splits(spark, sf_dir):
    """The form for arrays of any size: files are read in splits, objects cut out in place."""
    path = I.write_arrays(I.records(spark, sf_dir), "arrays")
    schema = T.StructType(KEYS + INSTRUCTION.fields)
    return R.read_instructions(spark, path, schema, whole_bytes=0).select(*RECORD)


def s2_read_jsonl(spark, sf_dir):
    path = scratch_path(spark, "prompts")
    R.write_jsonl(I.prompts(spark, sf_dir).select(*PROMPT), path)
    read = R.read_jsonl(spark, path, T.StructType(KEYS + PROMPT_RECORD.fields), with_pos=True)
    good, _ = R.split_rejects(read, ["context", "target"])
    return good.select(*PROMPT)


def s3_jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "records")
    R.write_jsonl(I.records(spark, sf_dir).select(*RECORD), path)
    read = R.read_jsonl(spark, path, T.StructType(KEYS + INSTRUCTION.fields))
    return R.split_rejects(read, ["instruction", "output"])[0].select(*RECORD)


def s4_dataset_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    R.save_dataset(I.tokens(spark, sf_dir), path)
    stored = R.load_dataset(spark, path)
    return stored.select("conv_id", "turn", I.ids_text("input_ids").alias("ids"))


def s6_text_lines(spark, sf_dir):
    """Documents written as text files, each line marked with its document and place."""
    marked = I.document_lines(spark, sf_dir).select(
        F.array_join(
            F.transform(
                "paragraphs", lambda p, i: F.concat_ws("\t", F.col("doc_id"), i.cast("string"), p)
            ),
            "\n",
        ).alias("value")
    )
    path = scratch_path(spark, "corpus")
    marked.write.text(path)
    lines = L.read_text_corpus(spark, path).withColumn("part", F.split("text", "\t", 3))
    lines = lines.select(
        "file",
        "pos",
        F.get("part", 0).cast("long").alias("doc_id"),
        F.get("part", 1).cast("long").alias("place"),
        F.get("part", 2).alias("text"),
    )
    starts = lines.groupBy("file", "doc_id").agg(F.min("pos").alias("start"))
    return lines.join(starts, ["file", "doc_id"]).select(
        "doc_id", "place", (F.col("pos") - F.col("start")).alias("line_no"), "text"
    )


def s8_knowledge_lines(spark, sf_dir):
    return L.knowledge_lines(I.table(spark, sf_dir, "documents"), "doc_id", "text")


# Records


def p1_format_example(spark, sf_dir):
    return I.prompts(spark, sf_dir).select(*PROMPT)


def p2_first_n(spark, sf_dir):
    return first_n(I.table(spark, sf_dir, "benchmark"), ["item_id"], 10)


# Tokens


def t1_tokenize(spark, sf_dir):
    ids = tokenize(F.col("text"), 64, special_ids=(1, 3)).alias("input_ids")
    return I.table(spark, sf_dir, "benchmark").select("item_id", ids).select(
        "item_id", I.ids_text("input_ids").alias("ids")
    )


def _assembled(spark, sf_dir):
    p = tokenize(F.col("context"), I.MAX_LEN, special_ids=I.SPECIAL)
    t = tokenize(F.col("target"), I.MAX_LEN)
    return I.prompts(spark, sf_dir).select(
        "conv_id", "turn", F.size(p).alias("prompt_len"), assemble(p, t, I.EOS).alias("input_ids")
    )


def t2_assemble(spark, sf_dir):
    return _assembled(spark, sf_dir).select("conv_id", "turn", I.ids_text("input_ids").alias("ids"))


def t3_skip_overlength(spark, sf_dir):
    kept = skip_overlength(_assembled(spark, sf_dir), I.MAX_LEN, True)
    return kept.select("conv_id", "turn", F.size("input_ids").cast("long").alias("n_ids"))


def t4_clip(spark, sf_dir):
    return clip(_assembled(spark, sf_dir), I.MAX_LEN).select(
        "conv_id", "turn", I.ids_text("input_ids").alias("ids"), "eos_lost", "target_lost"
    )


def code_point_tokenizer():
    return lambda texts: [[ord(c) for c in text] for text in texts]


def t5_tokenize_corpus(spark, sf_dir):
    """The whole step with a plugged tokenizer, overlong rows skipped."""
    rows = I.tokens(spark, sf_dir, tokenizer=code_point_tokenizer, skip=True)
    return rows.select("conv_id", "turn", I.ids_text("input_ids").alias("ids"))


def t6_batches(spark, sf_dir):
    return assign_batches(I.tokens(spark, sf_dir), 8, ["conv_id", "turn"]).select(
        "conv_id", "turn", "batch_id"
    )


def t7_collate(spark, sf_dir):
    batched = assign_batches(I.tokens(spark, sf_dir), 8, ["conv_id", "turn"])
    return collate(batched, pad_id=32).select(
        "conv_id",
        "turn",
        "batch_id",
        I.ids_text("input_ids").alias("ids"),
        I.ids_text("attention_mask").alias("mask"),
        I.ids_text("labels").alias("label_ids"),
    )


def t8_flatten(spark, sf_dir):
    path = scratch_path(spark, "nested")
    nested = I.tokens(spark, sf_dir).select("conv_id", "turn", F.struct("input_ids").alias("features"))
    R.save_dataset(nested, path)
    flat = flatten_features(R.load_dataset(spark, path))
    return flat.select("conv_id", "turn", I.ids_text("input_ids").alias("ids"))


# Whole jobs


def u5_user_steps(spark, sf_dir):
    """Two steps of a user before the prompts are made: short answers go, an answer given often stays once."""

    def long_answers(records):
        return records.filter(F.length("output") >= 40)

    def one_per_answer(records):
        first = F.min(F.struct("conv_id", "turn", "instruction", "input")).alias("first")
        return records.groupBy("output").agg(first).select("first.*", "output")

    examples = training_examples(
        I.records(spark, sf_dir), I.MAX_LEN, None, I.SPECIAL, I.EOS, steps=[long_answers, one_per_answer]
    )
    return examples.select("conv_id", "turn", I.ids_text("input_ids").alias("ids"))


def e1_training_batches(spark, sf_dir):
    """Array file to padded batches: read, format, tokenize, clip, store, batch, pad left."""
    path = I.write_arrays(I.records(spark, sf_dir), "arrays")
    read = R.read_instructions(spark, path, T.StructType(KEYS + INSTRUCTION.fields)).drop("file", "pos")
    stored = scratch_path(spark, "dataset")
    R.save_dataset(training_examples(read, I.MAX_LEN, None, I.SPECIAL, I.EOS), stored)
    batches = training_batches(R.load_dataset(spark, stored), ["conv_id", "turn"], 4, 0, "left")
    return batches.select(
        "conv_id", "turn", "batch_id", I.ids_text("input_ids").alias("ids"),
        I.ids_text("attention_mask").alias("mask"),
    )


def length_model():
    """A stand-in generator: the prompt again, and its length as the last line."""
    return lambda prompts: [f"{p}\n 　{len(p)} " for p in prompts]


def e2_batch_inference(spark, sf_dir):
    """Every record through the generator."""
    done = batch_inference(I.records(spark, sf_dir), length_model)
    return done.select("conv_id", "turn", "target", "answer")


QUERIES = {
    f.__name__: f
    for f in [
        s1_read_instructions,
        s1_read_instructions_splits,
        s2_read_jsonl,
        s3_jsonl_roundtrip,
        s4_dataset_roundtrip,
        s6_text_lines,
        s8_knowledge_lines,
        p1_format_example,
        p2_first_n,
        t1_tokenize,
        t2_assemble,
        t3_skip_overlength,
        t4_clip,
        t5_tokenize_corpus,
        t6_batches,
        t7_collate,
        t8_flatten,
        u5_user_steps,
        e1_training_batches,
        e2_batch_inference,
    ]
}

_RECORDS = f"WITH {RECORDS} SELECT conv_id, turn, instruction, input, output FROM records"
_PROMPTS = f"WITH {PROMPTS} SELECT conv_id, turn, context, target FROM prompts"
_CLIPPED = f"""
WITH {TOKENS}
SELECT conv_id, turn, array_to_string(list_slice(ids, 1, 200), ' ') AS ids FROM assembled"""


def _padded(size: int, pad: int, left: bool) -> str:
    def put(body: str, filler: str) -> str:
        gap = f"list_transform(range(0, width - len(clipped)), lambda i: {filler})"
        return f"list_concat({gap}, {body})" if left else f"list_concat({body}, {gap})"

    return f"""
WITH {TOKENS},
numbered AS (
  SELECT conv_id, turn, list_slice(ids, 1, 200) AS clipped,
    (row_number() OVER (ORDER BY conv_id, turn) - 1) // {size} AS batch_id
  FROM assembled
),
sized AS (SELECT *, max(len(clipped)) OVER (PARTITION BY batch_id) AS width FROM numbered),
padded AS (
  SELECT conv_id, turn, batch_id, {put('clipped', str(pad))} AS full_ids,
    {put('list_transform(clipped, lambda x: 1)', '0')} AS mask
  FROM sized
)
SELECT conv_id, turn, batch_id, array_to_string(full_ids, ' ') AS ids,
  array_to_string(mask, ' ') AS mask"""


ORACLES = {
    "s1_read_instructions": _RECORDS,
    "s1_read_instructions_splits": _RECORDS,
    "s2_read_jsonl": _PROMPTS,
    "s3_jsonl_roundtrip": _RECORDS,
    "s4_dataset_roundtrip": _CLIPPED,
    "s6_text_lines": f"WITH {LINES} SELECT doc_id, pos AS place, pos AS line_no, text FROM lines",
    "s8_knowledge_lines": f"WITH {LINES} SELECT doc_id, pos, text FROM lines",
    "p1_format_example": _PROMPTS,
    "p2_first_n": "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10",
    "t1_tokenize": f"""
SELECT item_id, array_to_string(list_concat([1, 3], list_slice({codes('text')}, 1, 62)), ' ') AS ids
FROM benchmark""",
    "t2_assemble": f"WITH {TOKENS} SELECT conv_id, turn, array_to_string(ids, ' ') AS ids FROM assembled",
    "t3_skip_overlength": f"""
WITH {TOKENS} SELECT conv_id, turn, len(ids) AS n_ids FROM assembled WHERE len(ids) <= 200""",
    "t4_clip": f"""
WITH {TOKENS}
SELECT conv_id, turn, array_to_string(list_slice(ids, 1, 200), ' ') AS ids,
  len(ids) > 200 AS eos_lost, n_prompt >= 200 AND n_target > 0 AS target_lost
FROM assembled""",
    "t5_tokenize_corpus": f"""
WITH {TOKENS} SELECT conv_id, turn, array_to_string(ids, ' ') AS ids FROM assembled
WHERE len(ids) <= 200""",
    "t6_batches": f"""
WITH {PROMPTS}
SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch_id
FROM prompts""",
    "t7_collate": _padded(8, 32, False)
    + """, array_to_string(list_transform(full_ids, lambda x: CASE WHEN x = 32 THEN -100 ELSE x END), ' ')
  AS label_ids FROM padded""",
    "t8_flatten": _CLIPPED,
    "u5_user_steps": f"""
WITH {TOKENS},
chosen AS (
  SELECT conv_id, turn FROM prompts WHERE length(target) >= 40
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY conv_id, turn) = 1
)
SELECT conv_id, turn, array_to_string(list_slice(ids, 1, 200), ' ') AS ids
FROM assembled JOIN chosen USING (conv_id, turn)""",
    "e1_training_batches": _padded(4, 0, True) + " FROM padded",
    "e2_batch_inference": f"""
WITH {PROMPTS} SELECT conv_id, turn, target, length(context)::VARCHAR AS answer FROM prompts""",
}

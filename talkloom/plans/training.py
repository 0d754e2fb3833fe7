"""From conversations or instruction files to stored, batched training examples."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.functions.plugins import Generator, Tokenizer, Transform, apply_steps, generate
from talkloom.functions.strings import last_line
from talkloom.operators.chat import pair_turns
from talkloom.operators.instruct import first_n, prompt_records
from talkloom.operators.tokens import assign_batches, collate, tokenize_corpus


def conversation_instructions(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, instruction, input, output)``: one record per answered user turn.

    The system text of the conversation is the record's input.
    """
    system = (
        turns.filter(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("input"))
    )
    return pair_turns(turns).join(system, "conv_id", "left").select(
        "conv_id",
        "turn",
        F.col("prompt").alias("instruction"),
        "input",
        F.col("resp").alias("output"),
    )


def training_examples(
    records: DataFrame,
    max_len: int = 384,
    tokenizer: Callable[[], Tokenizer] | None = None,
    special_ids: tuple[int, ...] = (),
    eos_id: int = 2,
    skip: bool = False,
    steps: Iterable[Transform] = (),
) -> DataFrame:
    """Instruction records, after the user's ``steps``, to token sequences, all narrow."""
    return tokenize_corpus(prompt_records(apply_steps(records, steps)), max_len, tokenizer, special_ids, eos_id, skip)


def training_batches(
    examples: DataFrame, order: list[str], batch_size: int, pad_id: int = 0, side: str = "right"
) -> DataFrame:
    """Padded batches in the unique order ``order``."""
    return collate(assign_batches(examples, batch_size, order), pad_id, side)


def batch_inference(
    records: DataFrame,
    generator: Callable[[], Generator],
    n: int | None = None,
    order: list[str] | None = None,
    steps: Iterable[Transform] = (),
) -> DataFrame:
    """Answers of all records, or of the first ``n`` in ``order``: the generator's last line.

    ``steps`` are the user's own, applied to the records before any are chosen.
    """
    records = apply_steps(records, steps)
    chosen = records if n is None else first_n(records, order, n)
    prompts = prompt_records(chosen)
    replies = generate(prompts, generator, "context", "raw")
    return replies.withColumn("answer", last_line(F.col("raw"))).drop("raw")

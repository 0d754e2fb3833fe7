"""Token sequences, batches and padded training examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.functions.plugins import Tokenizer, code_points, token_ids
from talkloom.plans.numbering import number_rows


def tokenize(
    text: Column,
    max_len: int,
    tokenizer: Callable[[], Tokenizer] | None = None,
    special_ids: tuple[int, ...] = (),
) -> Column:
    """At most ``max_len`` ids of a text; ``special_ids`` come first and count toward it."""
    ids = code_points(text) if tokenizer is None else token_ids(text, tokenizer)
    room = max_len - len(special_ids)
    if room < 0:
        raise ValueError("max_len is smaller than the number of special ids")
    body = F.slice(ids, 1, room)
    if not special_ids:
        return body
    return F.concat(F.array(*[F.lit(i) for i in special_ids]), body)


def assemble(prompt_ids: Column, target_ids: Column, eos_id: int) -> Column:
    return F.concat(prompt_ids, target_ids, F.array(F.lit(eos_id)))


def skip_overlength(df: DataFrame, max_len: int, enabled: bool) -> DataFrame:
    """Drop rows whose unclipped sequence is too long, if switched on."""
    if not isinstance(enabled, bool):
        raise TypeError("skip_overlength takes True or False")
    return df.filter(F.size("input_ids") <= max_len) if enabled else df


def clip(df: DataFrame, max_len: int) -> DataFrame:
    """Keep the first ``max_len`` ids.

    ``eos_lost`` marks rows that lost the closing id, ``target_lost`` those whose prompt
    alone filled the sequence while there was a target.
    """
    long = F.size("input_ids") > max_len
    return df.withColumns(
        {
            "eos_lost": long,
            "target_lost": (F.col("prompt_len") >= max_len)
            & (F.size("input_ids") > F.col("prompt_len") + 1),
            "input_ids": F.slice("input_ids", 1, max_len),
        }
    )


def tokenize_corpus(
    prompts: DataFrame,
    max_len: int = 384,
    tokenizer: Callable[[], Tokenizer] | None = None,
    special_ids: tuple[int, ...] = (),
    eos_id: int = 2,
    skip: bool = False,
) -> DataFrame:
    """Prompt records to ``input_ids`` with the clip flags; every other column stays.

    Narrow from end to end: each row is worked on where it is read.
    """
    both = prompts.select(
        "*",
        tokenize(F.col("context"), max_len, tokenizer, special_ids).alias("prompt_ids"),
        tokenize(F.col("target"), max_len, tokenizer).alias("target_ids"),
    ).drop("context", "target")
    joined = both.select(
        "*",
        F.size("prompt_ids").alias("prompt_len"),
        assemble(F.col("prompt_ids"), F.col("target_ids"), eos_id).alias("input_ids"),
    ).drop("prompt_ids", "target_ids")
    return clip(skip_overlength(joined, max_len, skip), max_len).drop("prompt_len")


def assign_batches(df: DataFrame, batch_size: int, order: list[str]) -> DataFrame:
    """Add ``batch_id``: each run of ``batch_size`` rows in the unique order is one batch."""
    numbered = number_rows(df, order, "_number")
    return numbered.withColumn("batch_id", F.expr(f"_number div {int(batch_size)}")).drop("_number")


def collate(df: DataFrame, pad_id: int = 0, side: str = "right") -> DataFrame:
    """Pad each row to the longest of its batch; add ``attention_mask`` and ``labels``.

    Labels repeat the ids, with -100 wherever the id is the padding id.
    """
    if side not in ("right", "left"):
        raise ValueError("side is 'right' or 'left'")
    width = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    sized = df.withColumn("_gap", width - F.size("input_ids"))

    def padded(body: Column, filler: int) -> Column:
        pad = F.array_repeat(F.lit(filler), F.col("_gap"))
        return F.concat(body, pad) if side == "right" else F.concat(pad, body)

    ones = F.transform("input_ids", lambda _: F.lit(1))
    out = sized.withColumns(
        {"attention_mask": padded(ones, 0), "input_ids": padded(F.col("input_ids"), pad_id)}
    )
    labels = F.transform("input_ids", lambda x: F.when(x == pad_id, F.lit(-100)).otherwise(x))
    return out.withColumn("labels", labels).drop("_gap")


def flatten_features(df: DataFrame) -> DataFrame:
    """Bring the nested layout ``features.input_ids`` to the flat one; flat tables pass."""
    if "features" not in df.columns:
        return df
    return df.select(*[c for c in df.columns if c != "features"], "features.*")

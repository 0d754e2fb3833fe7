"""What a user plugs in: tokenizers, encoders, generators, tool functions.

A plug-in is given as a factory without arguments. Tasks call the factory, once per
Python worker, so a model is loaded on the executors and never per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tokenizer = Callable[[list[str]], list[list[int]]]
Encoder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[list[str]], list[str]]

#: Bytes of prompts that a generator gets at a time, about.
PROMPT_BYTES = 8 << 20


class Transform(Protocol):
    """A user step of a plan."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


def apply_steps(df: DataFrame, steps: Iterable[Transform]) -> DataFrame:
    """``df`` after the user's steps, one after the other; without steps ``df`` itself.

    Steps only build the plan, so Spark may still push filters and columns through them.
    """
    for step in steps:
        df = step(df)
        if not isinstance(df, DataFrame):
            raise TypeError(f"{getattr(step, '__name__', step)} gave {type(df).__name__}, not a DataFrame")
    return df


_LOADED: dict[str, Callable] = {}


def plugin_key(factory: Callable) -> str:
    """Names a factory by its code and what it captured; computed once on the driver."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def load_once(key: str, factory: Callable[[], Callable]) -> Callable:
    """The plug-in of this worker process, made at first use."""
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def run_once(udf):
    """Keep Spark from copying a costly call into filters that look at its result."""
    return udf.asNondeterministic()


def token_ids(text: Column, tokenizer: Callable[[], Tokenizer]) -> Column:
    """Token ids by a plugged tokenizer, in Arrow batches."""

    key = plugin_key(tokenizer)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load_once(key, tokenizer)
        for batch in batches:
            yield pd.Series(run(batch.tolist()), dtype="object")

    return F.when(text.isNotNull(), run_once(encode)(F.coalesce(text, F.lit(""))))


def code_points(text: Column) -> Column:
    """The built-in tokenizer: one id per code point, without leaving the JVM."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(text, ""), lambda c: F.ascii(c))
    )


def embedding(text: Column, encoder: Callable[[], Encoder]) -> Column:
    """Vectors by a plugged encoder, in Arrow batches."""

    key = plugin_key(encoder)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load_once(key, encoder)
        for batch in batches:
            yield pd.Series([list(v) for v in run(batch.tolist())], dtype="object")

    return F.when(text.isNotNull(), run_once(encode)(F.coalesce(text, F.lit(""))))


def generate(
    df: DataFrame, generator: Callable[[], Generator], prompt: str = "prompt", reply: str = "reply"
) -> DataFrame:
    """Add one reply per prompt row; rows stay in their partitions, and a call gets some PROMPT_BYTES of them at most."""

    key = plugin_key(generator)

    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = load_once(key, generator)
        for batch in batches:
            # Long prompts become Python strings a part of the batch at a time.
            rows = max(1, len(batch) * PROMPT_BYTES // max(batch.nbytes, PROMPT_BYTES))
            parts = [pa.array(run(batch.slice(at, rows).to_pylist()), pa.string()) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    text = run_once(F.arrow_udf(answer, T.StringType()))(F.coalesce(F.col(prompt), F.lit("")))
    return df.withColumn(reply, F.when(F.col(prompt).isNotNull(), text))


def apply_tools(
    calls: DataFrame, tools: dict[str, Callable[[Column], Column]], result: str = "result"
) -> DataFrame:
    """Run registered tool functions: ``name`` picks one, it gets the ``parameters`` map.

    A tool maps the parameter map to a struct Column, so all calls stay in one plan. The
    result column is JSON text, since tools differ in their result type.
    """
    from talkloom.functions.strings import json_result

    if not tools:
        return calls.withColumn(result, F.lit(None).cast("string"))
    chosen = None
    for name, tool in tools.items():
        text = json_result(tool(F.col("parameters")))
        hit = F.col("name") == name
        chosen = F.when(hit, text) if chosen is None else chosen.when(hit, text)
    return calls.withColumn(result, chosen)

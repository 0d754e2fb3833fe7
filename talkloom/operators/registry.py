"""Tool names of a large registry in replies, by one pass over each reply.

All names are sought at once with an automaton (Aho and Corasick 1975), so a reply costs its own
length and what is found in it, however many names there are. A registry is cut into blocks of
bounded size, and an automaton is made of one block at a time; replies are read once a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.sources.scratch import written

#: Characters of the names of one block: its automaton takes some 100 MB in a task.
BLOCK_CHARS = 1_000_000
MATCHES = "array<struct<at:int,ord:int,name:string>>"
_MATCH = pa.struct([("at", pa.int32()), ("ord", pa.int32()), ("name", pa.string())])

#: Automata of this Python worker, by block; one is kept.
_BUILT: dict[str, tuple] = {}


def _automaton(key: str, names: list[tuple[int, str]]) -> tuple:
    """The automaton of the names, and the orders under which the empty name is registered."""
    if key not in _BUILT:
        _BUILT.clear()
        orders: dict[str, list[int]] = {}
        for order, name in names:
            orders.setdefault(name, []).append(order)
        automaton = ahocorasick.Automaton()
        for name, own in orders.items():
            if name:
                automaton.add_word(name, (name, own))
        if len(automaton):
            automaton.make_automaton()
        _BUILT[key] = automaton, orders.get("", [])
    return _BUILT[key]


def first_places(reply: str, automaton, empty: list[int]) -> list[tuple[int, int, str]]:
    """(at, ord, name) of each name in the reply, at its first place; the empty name is at 0."""
    found: dict[str, tuple[int, list[int]]] = {}
    if len(automaton):
        for end, (name, orders) in automaton.iter(reply):
            if name not in found:
                found[name] = end - len(name) + 1, orders
    matches = [(at, order, name) for name, (at, orders) in found.items() for order in orders]
    return matches + [(0, order, "") for order in empty]


def match_registry(
    replies: DataFrame, registry: DataFrame, reply: str = "reply", out: str = "matches", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Add ``out``: the names of ``registry(ord, name)`` that the reply holds, as ``route.match_tools`` gives them.

    They stand in order of their first place, counted from 0, then of ``ord``. Null names
    are no names; a null reply holds none.
    """
    spark = replies.sparkSession
    names = written(registry.where(F.col("name").isNotNull()).select(F.col("ord").cast("int").alias("ord"), F.col("name").cast("string").alias("name")), "registry")
    size = names.agg(F.coalesce(F.sum(F.length("name") + 1), F.lit(0))).first()[0]
    blocks = -(-size // block_chars)
    rows = replies.withColumn(out, F.array().cast(MATCHES))
    place = rows.columns.index(out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for block in range(blocks):
        part = names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block)
        # About block_chars characters, by the number of blocks.
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.toArrow().to_pandas().itertuples(index=False, name=None)])
        key = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}"

        def search(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            automaton, empty = _automaton(key, sent.value)
            for batch in batches:
                held = batch.column(place).to_pylist()
                texts = batch.column(batch.schema.get_field_index(reply)).to_pylist()
                for k, text in enumerate(texts):
                    if text is not None:
                        more = first_places(text, automaton, empty)
                        before = [(m["at"], m["ord"], m["name"]) for m in held[k]]
                        held[k] = [dict(zip(("at", "ord", "name"), m, strict=True)) for m in sorted(before + more)]
                columns = list(batch.columns)
                columns[place] = pa.array(held, pa.list_(_MATCH))
                yield pa.record_batch(columns, batch.schema.names)

        rows = rows.mapInArrow(search, schema)
        if block < blocks - 1:
            # One automaton at a time is in memory.
            rows = written(rows, "matched")
    return rows

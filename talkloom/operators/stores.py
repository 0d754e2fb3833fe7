"""A vector index that grows by versions, and embeddings that are made once per text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions.plugins import Encoder, embedding
from talkloom.operators.retrieve import SENT_ROWS
from talkloom.sources.scratch import written
from talkloom.sources.snapshots import Conflict, Snapshots


class FlatIndex:
    """``(pos, text, embedding)`` in versions; see ``Snapshots``. Appended positions must be new."""

    def __init__(self, spark: SparkSession, path: str):
        self.snapshots = Snapshots(spark, path, "pos long, text string, embedding array<float>", position="pos")

    def append(self, passages: DataFrame, token: str) -> int:
        """Add passages; doing it again with the same token, also after a failure, adds them once."""
        return self.snapshots.append(passages.select("pos", "text", "embedding"), token)

    def passages(self, version: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
        return self.snapshots.read(version, between)


class EmbeddingStore:
    """Embeddings by the content of the text, so that a text is encoded once, whoever asks.

    ``model`` names the encoder and its state: change it when the encoder changes. Rows are
    ``(content, embedding)``, content being a SHA-256 of model and text.
    """

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.model = model
        self.snapshots = Snapshots(spark, path, "content binary, embedding array<float>")

    def content(self, text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(F.lit(f"{len(self.model)}:{self.model}"), text).cast("binary"), 256))

    def fill(self, texts: DataFrame, encoder: Callable[[], Encoder], text: str = "text") -> int:
        """Encode the texts that are not stored yet, each once, and return the version that has all.

        Null texts have no embedding. If another job commits in between, what it brought is
        left out and the commit tried again, without encoding again.
        """
        named = texts.where(F.col(text).isNotNull()).select(self.content(F.col(text)).alias("content"), F.col(text).alias("_text"))
        version = self.snapshots.version()
        # Only hashes are compared with the store; texts move if they are new.
        absent = written(self._absent(named.select("content").distinct(), version), "absent")
        count = absent.count()
        if not count:
            return version
        if count <= SENT_ROWS:
            absent = F.broadcast(absent)
        fresh = named.join(absent, "content").groupBy("content").agg(F.any_value("_text").alias("_text"))
        made = written(fresh.select("content", embedding(F.col("_text"), encoder).alias("embedding")), "encoded")
        while True:
            try:
                return self.snapshots.append(made, uuid.uuid4().hex, expect=version)
            except Conflict:
                version = self.snapshots.version()
                made = written(self._absent(made, version), "encoded")

    def _absent(self, contents: DataFrame, version: int) -> DataFrame:
        return contents.join(self.snapshots.read(version).select("content"), "content", "left_anti")

    def embed(self, passages: DataFrame, encoder: Callable[[], Encoder], text: str = "text", out: str = "embedding") -> DataFrame:
        """Add the embedding of ``text`` to each row, encoding only what the store lacks."""
        version = self.fill(passages, encoder, text)
        stored = self.snapshots.read(version).select(F.col("content").alias("_content"), F.col("embedding").alias("_embedding"))
        keyed = passages.withColumn("_key", self.content(F.col(text)))
        joined = keyed.join(stored, F.col("_key") == F.col("_content"), "left")
        return joined.withColumn(out, F.col("_embedding")).drop("_key", "_content", "_embedding")

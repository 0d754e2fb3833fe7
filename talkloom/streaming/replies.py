"""Growing replies: a model sends each reply as snapshots, every one longer than the last.

``latest_snapshot`` and ``suffix_delta`` work on stored snapshots; the ``*_stream`` forms do the
same on a stream. A snapshot is ``(conv_id, turn, prompt, seq, resp)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkloom.plans.segments import SEGMENT, previous_row
from talkloom.sources.schemas import SNAPSHOT
from talkloom.sources.snapshots import Snapshots

DELTA = "conv_id long, turn long, seq long, delta string"
REPLY = ["conv_id", "turn"]


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """``(conv_id, turn, seq, prompt, resp)`` of the newest snapshot. Batch and stream alike."""
    newest = F.max_by(F.struct("prompt", "resp"), "seq")
    return snapshots.groupBy(*REPLY).agg(F.max("seq").alias("seq"), newest.alias("_new")).select(
        *REPLY, "seq", "_new.prompt", "_new.resp"
    )


def suffix_delta(snapshots: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, turn, seq, delta)``: what each snapshot adds to the one before."""
    sized = snapshots.select(*REPLY, "seq", "resp", F.length("resp").alias("n"))
    seen = previous_row(sized, REPLY, "seq", ["n"], "_before", segment)
    start = F.coalesce(F.col("_before.n"), F.lit(0)) + 1
    return seen.select(*REPLY, "seq", F.substring("resp", start, F.length("resp")).alias("delta"))


def read_snapshots(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, arrival: str | None = None
) -> DataFrame:
    schema = SNAPSHOT if arrival is None else T.StructType([*SNAPSHOT, T.StructField(arrival, T.TimestampType())])
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def latest_snapshot_stream(stream: DataFrame, out: str, checkpoint: str):
    """Keep a log of the newest snapshots; ``latest_snapshot`` over ``read_log`` is the result.

    Each micro-batch is cut down to its newest snapshots and owns one folder, which it
    overwrites when it is run again. No state is held, however many replies there are.
    """

    def store(arrived: DataFrame, epoch: int) -> None:
        latest_snapshot(arrived).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(f"{out}/epoch=*")


class ReplyLog:
    """The newest snapshots as a table of versions that stays about as large as the live replies.

    A micro-batch is one commit, named by its epoch, so one that runs again adds nothing and
    one that dies before its manifest is never seen. After each commit the newest parts
    are merged as long as a part holds no more rows than all later ones together: every
    part is then larger than its successors together, there are about log2(rows) of them,
    a row is merged about as often, and a read sees less than twice the rows of the first
    part, which has one row per live reply at most.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.table = Snapshots(spark, path, SNAPSHOT)

    def store(self, arrived: DataFrame, epoch: int) -> None:
        """Commit a micro-batch; to be handed to ``foreachBatch``."""
        self.table.append(latest_snapshot(arrived), f"epoch {epoch:012d}")
        self.compact()

    def compact(self) -> None:
        """Merge what is due. Safe to run at any time, also after a crash in the middle of it."""
        parts = self.table.manifest()["parts"]
        later = 0
        first = len(parts)
        for i in range(len(parts) - 1, -1, -1):
            if i < len(parts) - 1 and parts[i]["rows"] <= later:
                first = i
            later += parts[i]["rows"]
        # Epochs run in order, and only the newest can run again: its name is enough.
        self.table.merge([p["folder"] for p in parts[first:]], latest_snapshot, lambda names: [max(names)])

    def latest(self, version: int | None = None) -> DataFrame:
        """``latest_snapshot`` of all that was committed up to a version, the newest if none is given."""
        return latest_snapshot(self.table.read(version))


def compacted_snapshot_stream(stream: DataFrame, log: ReplyLog, checkpoint: str):
    """Keep ``log`` up to date with the newest snapshots; ``log.latest()`` is the result."""
    return (
        stream.writeStream.foreachBatch(log.store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def suffix_delta_stream(
    stream: DataFrame, idle_ms: int | None = None, arrival: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """The deltas of a stream of snapshots, in append mode.

    The state of a reply is the last ``seq`` and its length. A snapshot that is not newer
    is dropped. With ``idle_ms`` a reply that stays idle is forgotten; set it for queries
    that run on, since Spark never ends an ``availableNow`` run that waits for timeouts.

    With ``arrival``, a timestamp column, time is that of the snapshots: the watermark runs
    ``delay`` behind the latest arrival, and a reply is forgotten once the watermark is ``idle_ms``
    past its last arrival, so state ends in ``availableNow`` runs too. A snapshot that
    arrived before the watermark is dropped. One that comes for a forgotten reply begins it
    anew, with its whole text as delta: choose ``idle_ms`` longer than a reply may pause.
    """
    if arrival is not None:
        if idle_ms is None:
            raise ValueError("idle_ms says how long a reply may pause")
        return _event_time_deltas(stream, arrival, delay, idle_ms)
    timeout = (
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )

    def deltas(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seq, length = state.get if state.exists else (-1, 0)
        arrived = pd.concat(list(batches)).sort_values("seq")
        rows = []
        for new_seq, resp in zip(arrived["seq"], arrived["resp"]):
            if new_seq > seq:
                rows.append((*key, new_seq, resp[length:]))
                seq, length = int(new_seq), len(resp)
        state.update((seq, length))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "seq", "delta"])

    return (
        stream.select(*REPLY, "seq", "resp")
        .groupBy(*REPLY)
        .applyInPandasWithState(
            deltas,
            DELTA,
            "seq long, length long",
            "append",
            timeout,
        )
    )


def _event_time_deltas(stream: DataFrame, arrival: str, delay: str, idle_ms: int) -> DataFrame:
    def deltas(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        watermark = state.getCurrentWatermarkMs()
        seq, length, last = state.get if state.exists else (-1, 0, 0)
        if state.exists and last + idle_ms <= watermark:
            # Due to be forgotten, though its time-out comes only after this batch's rows.
            seq, length, last = -1, 0, 0
            state.remove()
        arrived = pd.concat(list(batches)).sort_values("seq")
        # Spark itself drops by the watermark of the batch before, which would let some late rows through.
        arrived = arrived[arrived["_millis"] >= watermark]
        rows = []
        for new_seq, resp in zip(arrived["seq"], arrived["resp"]):
            if new_seq > seq:
                rows.append((*key, new_seq, resp[length:]))
                seq, length = int(new_seq), len(resp)
        if not arrived.empty:
            last = max(last, int(arrived["_millis"].max()))
            state.update((seq, length, last))
        if state.exists:
            # Each call clears the time-out. One at or before the watermark is refused.
            state.setTimeoutTimestamp(max(last + idle_ms, watermark + 1))
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "seq", "delta"])

    timed = stream.withWatermark(arrival, delay)
    return (
        timed.select(*REPLY, "seq", "resp", arrival, F.unix_millis(F.col(arrival).cast("timestamp")).alias("_millis"))
        .groupBy(*REPLY)
        .applyInPandasWithState(
            deltas, DELTA, "seq long, length long, last long", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def store_deltas(deltas: DataFrame, out: str, checkpoint: str):
    """Append the deltas to Parquet, each exactly once."""
    return (
        deltas.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

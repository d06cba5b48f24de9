"""The stateful rules as Structured Streaming jobs.

Every job takes a streaming frame and gives one back, or writes to a sink; the caller picks
the trigger. Give the checkpoint a folder in shared storage. Jobs with state that never ends
(``first_use``) or one value per key are meant for the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duepath.session import fresh_path

COOLDOWN_MICROS = 28 * 24 * 3600 * 1_000_000


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if status.isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything that is there now and read the sink back."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    append_to(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def score_log(events: DataFrame) -> DataFrame:
    """Scoring events as an append-only log keyed by user."""
    return events.filter(F.col("key").isNotNull() & (F.trim("key") != ""))


def first_use(submissions: DataFrame, column: str = "event_hash", watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Each hash once: for good, or within a watermark where bounded state is wanted."""
    if watermark is None:
        return submissions.dropDuplicates([column])
    return submissions.withWatermark(time, watermark).dropDuplicatesWithinWatermark([column])


ACCEPT_OUT = "user_hash string, seq bigint, no_seq boolean, ts timestamp, period int, accepted boolean"
ACCEPT_STATE = "users array<string>, periods array<int>, times array<bigint>"
PLACES = 4096


def _dealt(rows: DataFrame, key: str, places: int, *others: str) -> DataFrame:
    """Rows by a hash of the key, for ``_in_key_order``. A missing seq sorts last and is marked, as one of them would turn
    the numbers of a whole place into doubles."""
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(places)).alias("place")
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(2**63 - 1)).alias("seq")
    return rows.select(place, F.col(key).cast("string").alias(key), seq, F.col("seq").isNull().alias("no_seq"), "ts", *others)


def _seq_back(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.when(~F.col("no_seq"), F.col("seq"))).drop("no_seq")


def _in_key_order(frames: Iterator[pd.DataFrame], key: str, names: Sequence[str]) -> tuple[list, np.ndarray, dict[str, np.ndarray]]:
    """Keys, each row's key number, and the columns of a place, in (key, ts, seq) order; ts in microseconds."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
    texts: list[np.ndarray] = []
    for frame in frames:
        texts.append(frame[key].to_numpy())
        for name in names:
            values = frame[name].to_numpy()
            parts[name].append(values.astype("datetime64[us]").astype("int64") if name == "ts" else values)
    columns = {name: np.concatenate(p) for name, p in parts.items()}
    codes, found = pd.factorize(np.concatenate(texts))
    order = np.lexsort((columns["seq"], columns["ts"], codes))
    # a row without a key has the number -1, the last in the list
    return [*found.tolist(), None], codes[order], {name: c[order] for name, c in columns.items()}


def _pieces(rows: dict[str, np.ndarray], size: int = 100_000) -> Iterator[pd.DataFrame]:
    """A long result in frames of bounded size."""
    n = len(rows["seq"])
    for a in range(0, n, size):
        yield pd.DataFrame({k: v[a:a + size] for k, v in rows.items()})


def _accept(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    users, codes, rows = _in_key_order(frames, "user_hash", ["seq", "no_seq", "ts", "period"])
    last = {u: (p, t) for u, p, t in zip(*state.get, strict=True)} if state.exists else {}
    verdicts = np.zeros(len(codes), dtype=bool)
    for i, (code, now, ts) in enumerate(zip(codes.tolist(), rows["period"].tolist(), rows["ts"].tolist(), strict=True)):
        period, before = last.get(users[code], (-1, -(2**62)))
        if period < 0 or (now > period and ts >= before + COOLDOWN_MICROS):
            verdicts[i] = True
            last[users[code]] = (int(now), ts)
    if verdicts.any():
        state.update((list(last), [p for p, _ in last.values()], [t for _, t in last.values()]))
    yield from _pieces({"user_hash": np.array(users, dtype=object)[codes], "seq": rows["seq"], "no_seq": rows["no_seq"],
                        "ts": rows["ts"].astype("datetime64[us]"), "period": rows["period"], "accepted": verdicts})


def accept_per_user(submissions: DataFrame, places: int = PLACES) -> DataFrame:
    """Accept a submission if its period is newer than, and its time 28 days after, the last
    accepted one of the user. A rejected submission changes nothing.

    Users are dealt over ``places`` by a hash, and one call and one state serve all users of a place: a call each costs more
    than their rows. The group a task sees is a place's rows of one micro-batch, and the state of a place that gets rows is
    written anew; limit the trigger (files or bytes) or raise ``places`` to bound it. A checkpoint keeps its ``places``.
    """
    rows = _dealt(submissions, "user_hash", places, F.col("period").cast("int").alias("period"))
    return _seq_back(rows.groupBy("place").applyInPandasWithState(_accept, ACCEPT_OUT, ACCEPT_STATE, "append", GroupStateTimeout.NoTimeout))


def daily_usage(submissions: DataFrame, late: str | None = None) -> DataFrame:
    """Submissions per issuer and UTC day, late ones included, however the stream is cut into batches.

    The state is one count per issuer and day. A stream that never ends can close days by naming ``late``;
    rows later than that are then not counted.
    """
    rows = submissions if late is None else submissions.withWatermark("ts", late)
    return rows.groupBy("issuer", F.window("ts", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("used")).select("issuer", F.col("w.start").cast("date").alias("day"), "used")


def drain_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an updating aggregate to the end; a batch that is run again overwrites itself."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    saved = spark.read.parquet(path)
    return saved.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


RATE_OUT = "req_key string, seq bigint, no_seq boolean, ts timestamp, allowed boolean"
RATE_STATE = "req_keys array<string>, hits array<array<bigint>>"


def rate_limit(hits: DataFrame, limit: int = 20, window_seconds: int = 3600, places: int = PLACES) -> DataFrame:
    """Allow at most ``limit`` hits per key and rolling window. Refused hits do not count, so
    the state is the last ``limit`` allowed times of a key and no more. Keys are dealt over ``places``, as in ``accept_per_user``."""
    width = window_seconds * 1_000_000

    def check(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, codes, rows = _in_key_order(frames, "req_key", ["seq", "no_seq", "ts"])
        last = {k: list(h) for k, h in zip(*state.get, strict=True)} if state.exists else {}
        allowed = np.zeros(len(codes), dtype=bool)
        for i, (code, now) in enumerate(zip(codes.tolist(), rows["ts"].tolist(), strict=True)):
            kept = [t for t in last.get(names[code], ()) if now - t < width]
            if len(kept) < limit:
                kept.append(now)
                allowed[i] = True
            last[names[code]] = kept
        state.update((list(last), list(last.values())))
        yield from _pieces({"req_key": np.array(names, dtype=object)[codes], "seq": rows["seq"], "no_seq": rows["no_seq"],
                            "ts": rows["ts"].astype("datetime64[us]"), "allowed": allowed})

    rows = _dealt(hits, "req_key", places)
    return _seq_back(rows.groupBy("place").applyInPandasWithState(check, RATE_OUT, RATE_STATE, "append", GroupStateTimeout.NoTimeout))

"""Uploads and outcomes as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import buckets
from ..operators.catalog import batch_status
from ..operators.segments import segments
from ..sources import files as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPLOAD = "drawing_id long, path string, filename string, original_filename string, uploaded timestamp, content binary, title_text string, tech_text string, all_text string"
JUDGED = "drawing_id long, path string, uploaded timestamp, signature string, action string, reject_reason string, title_text string, tech_text string, all_text string"
#: The state of a group of drawings: ids, and of each what it was last taken with, when that was uploaded, and until when it is remembered, in ms.
TAKEN = "drawing_ids array<long>, signatures array<string>, uploaded array<long>, until array<long>"
GROUPS = 1 << 12
STATUS = "batch_id string, total long, completed long, progress int, status string, merged long"


def _start(writer, spark: SparkSession) -> StreamingQuery:
    """Starts with state in RocksDB, of which a batch reads and writes its own keys only, unless the session has chosen another store."""
    own = spark.conf.get(PROVIDER, None)
    if own is None or own.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)


def judge(uploads: DataFrame, version: str, model: str, page_limit: int) -> DataFrame:
    """S2, S4 of each upload: signature and reject_reason beside its texts; the bytes go no further. uploads: UPLOAD."""
    rows = uploads.withColumn("length", F.coalesce(F.length("content"), F.lit(0)))
    return rows.select("drawing_id", "path", "uploaded", S.signature_of(version, model, page_limit).alias("signature"), S.reject_reason().alias("reject_reason"), "title_text", "tech_text", "all_text")


def known_signatures(judged: DataFrame, remember: str | None = None, groups: int = GROUPS) -> DataFrame:
    """J7 over a stream: JUDGED, with what is to be done with each drawing: "new", "changed" or "known"; rejected uploads are "rejected".

    Kept of a drawing is the signature it was last taken with and when that was uploaded. Of several uploads in one
    batch the last one counts, by time and signature; one older than what was taken is "known". remember: for how long
    (as "30 days") a drawing that doesn't come again is kept in mind, by the time of upload; afterwards it is new. Uploads
    that are older than the newest by more than that are then left out, and those without a time are not allowed.

    Drawings are dealt to `groups` groups, and a state is that of a group's drawings: Python is called for each group of
    a batch, which costs more than the rows do. The number stays as it is as long as the stream's checkpoint is used.
    """
    keep_ms = int(pd.Timedelta(remember).total_seconds() * 1000) if remember else None
    columns = [f.name for f in StructType.fromDDL(JUDGED)]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs() if keep_ms else 0
        taken = {d: of for d, *of in zip(*state.get, strict=True)} if state.exists else {}
        altered = False
        if not state.hasTimedOut:
            rows = pd.concat(list(parts), ignore_index=True)
            bad, last = rows["reject_reason"].notna(), {}
            actions = ["rejected" if b else None for b in bad]
            for i, (b, drawing, at, signature, path) in enumerate(zip(bad, rows["drawing_id"], rows["at"], rows["signature"], rows["path"], strict=True)):
                if not b:
                    drawing, at = None if pd.isna(drawing) else int(drawing), None if pd.isna(at) else int(at)
                    place = (at is not None, at or 0, signature, path is not None, path or "", i)
                    last[drawing] = max(last.get(drawing, place), place)
            for drawing, (timed, at, signature, *_, i) in last.items():
                before, millis = taken.get(drawing), at // 1000 if timed else -1
                actions[i] = "new" if before is None else "known" if before[0] == signature or millis < before[1] else "changed"
                if actions[i] != "known":
                    before = (signature, millis)
                elif not keep_ms:
                    continue
                taken[drawing], altered = (*before[:2], max(before[1] + keep_ms, now + 1) if keep_ms else None), True
            yield rows.assign(action=actions).loc[[a is not None for a in actions], columns]
        if keep_ms:
            left = {d: of for d, of in taken.items() if of[2] >= now}
            taken, altered = left, altered or len(left) < len(taken)
        if altered and taken:
            state.update(([*taken], *map(list, zip(*taken.values(), strict=True))))
        elif altered and state.exists:
            state.remove()
        if keep_ms and taken:
            state.setTimeoutTimestamp(max(min(of[2] for of in taken.values()), now + 1))

    timeout = GroupStateTimeout.EventTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    judged = judged.withWatermark("uploaded", remember) if keep_ms else judged
    # Drawings without an id are a group of their own: beside others their nulls would make the ids floats.
    group = F.when(F.col("drawing_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("drawing_id"), F.lit(groups)))
    return judged.withColumns({"at": F.unix_micros("uploaded"), "group": group}).groupBy("group").applyInPandasWithState(step, JUDGED, TAKEN, "append", timeout)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = segments, *, version: str = "1", model: str = "", page_limit: int = 10, remember: str | None = None, files_each: int = 1000, groups: int = GROUPS) -> StreamingQuery:
    """Uploads that arrive under source (UPLOAD as Parquet) are admitted, held against what is known, segmented and appended, until nothing is left.

    target/uploads holds a row for each upload looked at, target/segments what transform makes of new and changed
    drawings (drawing_id, title_text, tech_text, all_text); both have a folder for each batch. A batch that runs again
    replaces its folders, so it changes nothing. What was known before is in the stream's state: no batch reads what
    earlier ones wrote. current() reads what holds now.
    """

    def append(batch: DataFrame, number: int) -> None:
        looked_at = f"{target}/uploads/batch={number:010d}"
        batch.write.mode("overwrite").parquet(looked_at)
        taken = spark.read.schema(JUDGED).parquet(looked_at).where("action in ('new', 'changed')")
        transform(taken.select("drawing_id", "title_text", "tech_text", "all_text")).write.mode("overwrite").parquet(f"{target}/segments/batch={number:010d}")

    rows = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_each).parquet(source)
    judged = known_signatures(judge(rows, version, model, page_limit), remember, groups)
    return _start(judged.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True), spark)


def current(spark: SparkSession, target: str) -> DataFrame:
    """What ingest() has made of the last version of each drawing."""
    taken = spark.read.parquet(f"{target}/uploads").where("action in ('new', 'changed')")
    last = taken.groupBy("drawing_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/segments").join(last, ["drawing_id", "batch"], "left_semi").drop("batch")


def merge_status(changed: DataFrame, path: str, number: int) -> None:
    """Batches whose status has changed, put into the bucketed table at path as its version `number`; done again it gives the same version."""
    rows = changed.withColumns({"batch_id": F.col("batch_id").cast("string"), "merged": F.lit(number).cast("long")})
    buckets.change(changed.sparkSession, path, STATUS, ["batch_id"], rows, buckets.upsert(["batch_id"], "merged"), number=number)


def batch_progress(outcomes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A7 over a stream of outcomes (batch_id, ok), kept up to date in the bucketed table at path: read it with progress().

    Only batches that have changed leave the stream's state (update mode), and only their buckets are written anew.
    Batches have no event time, so there is no watermark: state is a row for each batch.
    """
    writer = batch_status(outcomes).writeStream.outputMode("update").foreachBatch(lambda changed, number: merge_status(changed, path, number))
    return _start(writer.option("checkpointLocation", checkpoint).trigger(availableNow=True), outcomes.sparkSession)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The table that batch_progress() keeps."""
    return buckets.read(spark, path, STATUS).drop("merged")

"""Stateful streams: failed logins, sessions, and the state of running scans.

The limiter and the fold take streaming frames (with plain ones Spark raises an error); the others take both. State
per key is bounded, and the state of a key that nothing came for is dropped in time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.candidates import candidates

WINDOW_S, FAILURES, SESSION_S = 600, 10, 12 * 3600
#: After how many milliseconds without news a key's state goes: failures once they can't count any more, scans after a day.
FORGET_MS = {"login": 2 * WINDOW_S * 1000, "scan": 24 * 3600 * 1000}


def admit(failures: list[float], at: float, ok: bool, limit: int = FAILURES, window: float = WINDOW_S) -> tuple[int, list[float]]:
    """The answer to a login (200, 401 or 429) and the failures to remember; a refused attempt is not one of them."""
    recent = [t for t in failures if at - t < window]
    if len(recent) >= limit:
        return 429, recent
    return (200, []) if ok else (401, [*recent, at])


def limit_logins(attempts: DataFrame, limit: int = FAILURES) -> DataFrame:
    """ip, at and status of each attempt (ip, at: seconds, ok), in order of time within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        answers = []
        for at, ok in zip(rows["at"], rows["ok"]):
            status, failures = admit(failures, float(at), bool(ok), limit)
            answers.append(status)
        state.update((failures,))
        state.setTimeoutDuration(FORGET_MS["login"])
        yield pd.DataFrame({"ip": key[0], "at": rows["at"], "status": answers})

    return attempts.groupBy("ip").applyInPandasWithState(step, "ip string, at double, status int", "failures array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_sessions(requests: DataFrame, logins: DataFrame) -> DataFrame:
    """Requests (sid, at) with a login (sid, at) not older than a session lasts."""
    r, g = requests.alias("r"), logins.alias("g")
    return r.join(g, F.expr(f"r.sid = g.sid AND r.at >= g.at AND r.at < g.at + INTERVAL {SESSION_S} SECONDS"), "left_semi")


def progress(events: DataFrame) -> DataFrame:
    """The furthest progress of each scan; it never goes back."""
    return events.where("type = 'progress'").groupBy("scan").agg(F.max("value").alias("progress"))


LOGS, PEEKS = 200, 60


def fold(state: dict, event: dict) -> dict:
    """The state of a scan after one event (type, value, payload)."""
    kind = event["type"]
    if kind == "progress":
        return state | {"progress": max(state.get("progress", 0.0), event["value"] or 0.0)}
    if kind in ("log", "peek"):
        most = LOGS if kind == "log" else PEEKS
        return state | {kind: [*state.get(kind, []), event["payload"]][-most:]}
    return state | {kind: event["payload"]}


def scan_states(events: DataFrame) -> DataFrame:
    """The folded state (JSON) of each scan after each batch of events (scan, seq, type, value, payload)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else {}
        for event in pd.concat(list(batches)).sort_values("seq", kind="stable").to_dict("records"):
            now = fold(now, event)
        text = json.dumps(now, ensure_ascii=False)
        state.update((text,))
        state.setTimeoutDuration(FORGET_MS["scan"])
        yield pd.DataFrame({"scan": [str(key[0])], "state": [text]})

    return events.groupBy("scan").applyInPandasWithState(step, "scan string, state string", "state string", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: Folders that documents are dealt to, so that a batch reads those of its own documents only.
BUCKETS = 256


def keep_candidates(readings: DataFrame, store: str, out: str) -> DataStreamWriter:
    """A writer that ranks a document's candidates anew, from all its readings so far, whenever some arrive.

    Readings are kept below `store`, by batch and bucket of documents, and candidates below `out`, a folder a batch, so that a batch that is run again
    replaces its own. A batch reads the buckets of its documents, not the whole store.
    """

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(BUCKETS)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
        new = spark.read.schema(dealt.schema).parquet(f"{store}/batch={number}")
        buckets = [r.bucket for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
        kept = spark.read.option("basePath", store).parquet(store).where(F.col("bucket").isin(buckets)).drop("batch", "bucket")
        candidates(kept.join(new.select("doc").distinct(), "doc", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return readings.writeStream.foreachBatch(refresh)


def latest_candidates(spark: SparkSession, out: str) -> DataFrame:
    """The candidates of each document as of the last batch that touched it."""
    found = spark.read.parquet(out)
    last = found.groupBy("doc").agg(F.max("batch").alias("batch"))
    return found.join(last, ["doc", "batch"]).drop("batch")


def unfinished(work: DataFrame, found: DataFrame) -> DataFrame:
    """Work (doc, ...) for documents that have no candidate sure enough to stop at: read with a T, from the text layer or by three votes and 80 percent."""
    sure = found.where("valid AND kind = 'read' AND has_t AND (array_contains(stages, 'pdf') OR (votes >= 3 AND confidence >= 80))")
    return work.join(sure.select("doc").distinct(), "doc", "left_anti")

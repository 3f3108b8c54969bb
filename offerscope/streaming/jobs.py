"""Streams: sliding sessions, state of sessions, live review counters. Intake is in intake.py, routes of sessions in operators/sessions.py."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(events: DataFrame, ttl: str = "30 days") -> DataFrame:
    """Sessions that each access extends by the time to live; state ends with the watermark."""
    return events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", ttl)).agg(F.count("*").alias("events"))


def review_counts_stream(queue: DataFrame) -> DataFrame:
    """Counts by status, for update or complete mode; the state has one row for each status."""
    return queue.groupBy("status").agg(F.count("*").alias("n"))


def read_table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def session_state_stream(turns: DataFrame, slots: list[str], change: str, limit: int, key: str = "conv_id") -> DataFrame:
    """(key, turn, version, the slots, summary) after each turn of the sessions, as questions.fold_session has it for a table.

    turns has key, turn (long), text, the slots (strings) and `change`. A stated slot replaces, a missing one is inherited until the topic
    changes. The summary has a line for each turn; the oldest lines go beyond `limit` characters, and of one line that is too long its end
    stays. A turn that isn't newer than the session's last one is a repeat and is left out. State: the slots and the summary,
    which stay; operators/sessions.py has the stream whose sessions end.
    """
    fields = ", ".join(f"`{s}` string" for s in slots)
    state = f"version long, turn long, {fields}, summary string"

    def step(k: tuple, batches: Iterator[pd.DataFrame], stored: GroupState) -> Iterator[pd.DataFrame]:
        version, last, *values, summary = stored.get if stored.exists else (0, None, *(None for _ in slots), "")
        out = []
        for r in pd.concat(list(batches)).sort_values("turn").to_dict("records"):
            if last is not None and r["turn"] <= last:
                continue
            version, last = version + 1, r["turn"]
            before = [None] * len(slots) if r[change] is True else values
            values = [old if pd.isna(r[s]) else r[s] for s, old in zip(slots, before, strict=True)]
            said = "" if pd.isna(r["text"]) else r["text"].replace("\n", " ")
            lines = [*filter(None, summary.split("\n")), f"{last}: {said}"]
            while len(lines) > 1 and len("\n".join(lines)) > limit:
                del lines[0]
            summary = "\n".join(lines)[-limit:]
            out.append((k[0], last, version, *values, summary))
        stored.update((version, last, *values, summary))
        yield pd.DataFrame(out, columns=[key, "turn", "version", *slots, "summary"])

    rows = turns.select(F.col(key).cast("string").alias(key), F.col("turn").cast("long").alias("turn"), "text", *slots, F.coalesce(change, F.lit(False)).alias(change))
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` string, turn long, version long, {fields}, summary string", state, "append", GroupStateTimeout.NoTimeout)

"""State by key that outlives restarts: replayed responses, answered questions, running summaries. Each has a form for tables too."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

#: What a key must look like, and for how long a response is remembered.
KEY, HOURS = r"^[A-Za-z0-9_\-]{8,64}$", 24
FRESH, REPLAYED, REJECTED = "fresh", "replayed", "rejected"
REPLAY = StructType([StructField("identity", StringType()), StructField("request_key", StringType()), StructField("at", TimestampType()), StructField("disposition", StringType()), StructField("response", StringType())])


def _requests(rows: DataFrame, identity: str, key: str, time: str, response: str) -> DataFrame:
    return rows.filter(F.col(time).isNotNull() & F.col(identity).isNotNull()).select(F.col(identity).cast("string").alias("identity"), F.col(key).cast("string").alias("request_key"), F.col(time).cast("timestamp").alias("at"), F.col(response).cast("string").alias("response"))


def _answered(held: tuple | None, at: pd.Timestamp, response: str | None, life: pd.Timedelta) -> tuple[tuple, str, str | None]:
    """What is remembered after a request, and how it was answered. A response that isn't there is not remembered."""
    if held is not None and at - held[0] <= life:
        return held, REPLAYED, held[1]
    return ((at, response) if response is not None else None), FRESH, response


def replayed(rows: DataFrame, identity: str, key: str, time: str, response: str, hours: float = HOURS) -> DataFrame:
    """Requests as (identity, request_key, at, disposition, response): fresh, or replayed with the response that the same identity
    and key got at most `hours` before. What is replayed does not live longer for it; null responses (failures) are not
    remembered; keys that don't match KEY are rejected. Rows without identity or time go.

    Requests are read in order of time (equal times by response), in sorted partitions and batch by batch, so one key may have
    any number of them.
    """
    life = pd.Timedelta(hours=hours)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, held = None, None
        for batch in batches:
            out = []
            for who, k, at, x in batch.itertuples(index=False):
                if (who, k) != own:
                    own, held = (who, k), None
                held, told, given = _answered(held, at, x, life)
                out.append((who, k, at, told, given))
            yield pd.DataFrame(out, columns=REPLAY.names)

    requests = _requests(rows, identity, key, time, response)
    fine = requests.filter(F.col("request_key").rlike(KEY)).repartition("identity", "request_key").sortWithinPartitions("identity", "request_key", "at", "response").mapInPandas(run, REPLAY)
    return fine.unionByName(_rejected(requests))


def _rejected(requests: DataFrame) -> DataFrame:
    return requests.filter(~F.coalesce(F.col("request_key").rlike(KEY), F.lit(False))).select("identity", "request_key", "at", F.lit(REJECTED).alias("disposition"), F.lit(None).cast("string").alias("response"))


def replayed_stream(rows: DataFrame, identity: str, key: str, time: str, response: str, hours: float = HOURS, late: str = "10 minutes") -> DataFrame:
    """`replayed` for a stream (append): what is remembered is the state of its key, and goes when the watermark, `late` behind
    the newest request, has passed its life. Requests must arrive in order but for those of one trigger, which are sorted.
    """
    life = pd.Timedelta(hours=hours)
    state_type = StructType([StructField("at", TimestampType()), StructField("response", StringType())])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "response"])
        out = []
        for at, x in rows[["at", "response"]].itertuples(index=False):
            held, told, given = _answered(held, at, None if pd.isna(x) else x, life)
            out.append((*group, at, told, given))
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((held[0].to_pydatetime() if hasattr(held[0], "to_pydatetime") else held[0], held[1]))
            end = int((pd.Timestamp(held[0]) + life).timestamp() * 1000) + 1
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=REPLAY.names)

    requests = _requests(rows, identity, key, time, response).withWatermark("at", late)
    fine = requests.filter(F.col("request_key").rlike(KEY)).groupBy("identity", "request_key").applyInPandasWithState(run, REPLAY, state_type, "append", GroupStateTimeout.EventTimeTimeout)
    return fine.unionByName(_rejected(requests))


PAIR = StructType([StructField("key", StringType()), StructField("question_at", LongType()), StructField("answer_at", LongType()), StructField("question", StringType()), StructField("answer", StringType())])


def turn_pairs_stream(messages: DataFrame, key: str, order: str, role: str = "role", text: str = "text") -> DataFrame:
    """`operators.turns.turn_pairs` for a stream (append): the question that waits for its answer is the state of a conversation.

    The key comes out as text, named key. Messages must arrive in order but for those of one trigger, which are sorted.
    """
    state_type = StructType([StructField("at", LongType()), StructField("question", StringType())])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: tuple[Any, ...] | None = tuple(state.get) if state.exists else None
        out = []
        for at, who, x in pd.concat(list(frames)).sort_values("at")[["at", "r", "x"]].itertuples(index=False):
            if who == "user":
                waiting = (int(at), x)
            elif waiting is not None:
                out.append((group[0], waiting[0], int(at), waiting[1], x))
                waiting = None
        if waiting is not None:
            state.update(waiting)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=PAIR.names)

    own = messages.filter(F.col(key).isNotNull() & F.col(role).isin("user", "assistant")).select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.col(role).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    return own.groupBy("key").applyInPandasWithState(run, PAIR, state_type, "append", GroupStateTimeout.NoTimeout)


SUMMARY = StructType([StructField("key", StringType()), StructField("upto", LongType()), StructField("turns", StringType())])


def summaries_stream(cited_turns: DataFrame, key: str, order: str, most: int = 8) -> DataFrame:
    """`operators.turns.summaries` for a stream (update): (key, upto, turns), the last `most` turns as a JSON array of the turns'
    JSON, whenever a conversation has a new one; upto is the order of the newest. Turns that are null don't count.
    """
    import json

    state_type = StructType([StructField("turns", StringType())])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("at")
        held = [*held, *([int(a), x] for a, x in rows[["at", "turn"]].itertuples(index=False))][-most:]
        state.update((json.dumps(held, ensure_ascii=False),))
        yield pd.DataFrame([(group[0], held[-1][0], "[" + ",".join(x for _, x in held) + "]")], columns=SUMMARY.names)

    own = cited_turns.filter("turn is not null").select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), F.to_json("turn").alias("turn"))
    return own.groupBy("key").applyInPandasWithState(run, SUMMARY, state_type, "update", GroupStateTimeout.NoTimeout)

"""Stateful streams: a token bucket per domain and a spend ledger per day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomline.runtime import ship


def bucket_waits(times: list[float], tokens: float, last: float | None, rate: float, burst: float) -> tuple[list[float], float, float | None]:
    """Seconds to wait at each time (0: granted), and the bucket afterwards; refused calls keep the refilled tokens."""
    waits = []
    for t in times:
        tokens = burst if last is None else min(burst, tokens + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        if tokens < 1:
            waits.append((1 - tokens) / rate)
        else:
            tokens -= 1
            waits.append(0.0)
    return waits, tokens, last


#: Rows of one frame that a step gives out.
CHUNK = 100_000


def token_buckets(calls: DataFrame, rate: float = 2.0, burst: float = 5.0, forget_s: int = 3600) -> DataFrame:
    """Per call (domain, at: timestamp) the seconds to wait; the bucket of a domain is carried as state over batches.

    A domain's calls of a batch are put in order by their instants alone,
    eight bytes each.  A bucket that no call has asked for ``forget_s``
    seconds is forgotten; it would be full by then.
    """
    ship(calls.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        at = np.sort(np.concatenate([f["at"].to_numpy("datetime64[us]") for f in frames]))
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            waits, tokens, last = bucket_waits((part.astype("int64") / 1e6).tolist(), tokens, last, rate, burst)
            yield pd.DataFrame({"domain": key[0], "at": part, "wait_s": waits})
        state.update((tokens, last))
        state.setTimeoutDuration(forget_s * 1000)

    return calls.groupBy("domain").applyInPandasWithState(step, "domain string, at timestamp, wait_s double", "tokens double, last double", "append", "ProcessingTimeTimeout")


def ledger_steps(events: list[tuple[str, float]], spent: float, cap: float) -> tuple[list[tuple[bool, float]], float]:
    """Whether each event is granted, and the sum after it: reserve within the cap, adjust never below 0; no cap at 0."""
    out = []
    for kind, amount in events:
        granted = kind != "reserve" or cap <= 0 or spent + amount <= cap
        if granted:
            spent = spent + amount if kind == "reserve" else max(0.0, spent + amount)
        out.append((granted, spent))
    return out, spent


def spend_ledger(events: DataFrame, cap: float, forget_days: int = 90) -> DataFrame:
    """Per event (day, seq, kind, amount) whether it is granted and what is spent then; the day's sum is state, forgotten ``forget_days`` after its last event."""
    ship(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (spent,) = state.get if state.exists else (0.0,)
        held = [(f["seq"].to_numpy("int64"), f["kind"].astype("category"), f["amount"].to_numpy("float64")) for f in frames]
        seq, amount = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
        kind = np.concatenate([h[1].to_numpy(object) for h in held])
        order = np.argsort(seq, kind="stable")
        for i in range(0, len(order), CHUNK):
            part = order[i : i + CHUNK]
            done, spent = ledger_steps(list(zip(kind[part], amount[part].tolist())), spent, cap)
            yield pd.DataFrame({"day": key[0], "seq": seq[part], "granted": [g for g, _ in done], "spent": [s for _, s in done]})
        state.update((spent,))
        state.setTimeoutDuration(forget_days * 86_400_000)

    return events.groupBy("day").applyInPandasWithState(step, "day string, seq bigint, granted boolean, spent double", "spent double", "append", "ProcessingTimeTimeout")


def first_seen(rows: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """A stream with one row per key; keys are remembered for ``late``."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])

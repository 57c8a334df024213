"""Incremental forms: windowed counts with a watermark, and the stability tracker as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "label int, hits int, conflicts int, last string, seen string"
OUT = "pair long, label int, hits int, conflicts int"


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, total) per window; rows later than the watermark are dropped by the engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def track(pair: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """New sightings (round, teacher, label, ord) of a pair applied to its state."""
    label, hits, conflicts, last, seen = state.get if state.exists else (None, 0, 0, "", "")
    known = set(filter(None, seen.split("\n")))
    rows = pd.concat(list(batches)).sort_values(["round", "ord"])
    for r, t, y in zip(map(str, rows["round"]), map(str, rows["teacher"]), rows["label"]):
        if label is None or y != label:
            conflicts += label is not None
            label, hits, known = int(y), 1, set()
        elif r != last or t not in known:
            hits += 1
        last = r
        known.add(t)
    state.update((label, hits, conflicts, last, "\n".join(sorted(known))))
    yield pd.DataFrame({"pair": [pair[0]], "label": [label], "hits": [hits], "conflicts": [conflicts]})


def stable_stream(sightings: DataFrame) -> DataFrame:
    """(pair, label, hits, conflicts) after each micro-batch, for the pairs that it touches."""
    return sightings.groupBy("pair").applyInPandasWithState(track, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

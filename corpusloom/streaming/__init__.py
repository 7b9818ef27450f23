"""Checks over streams: row-local ones and cleaning, which are stateless, and exact duplicates, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.config import CheckerConfig
from corpusloom.operators import get_all_checkers
from corpusloom.operators.cleaner import TextCleaner
from corpusloom.operators.checks import SchemaChecker
from corpusloom.plans.runner import annotate_stream
from corpusloom.sources.session import ship_package

#: Checks that need other rows, or no rows at all.
_NOT_LOCAL = ("schema", "exact_duplicate", "near_duplicate")


def check_stream(stream: DataFrame, text_field: str = "text", config: CheckerConfig | None = None) -> DataFrame:
    """``stream`` with a column ``<check>.<measure>`` for each row-local measure."""
    config = config or CheckerConfig()
    skip = {*_NOT_LOCAL, *config.skip_checkers}
    checks = [c(config) for n, c in get_all_checkers().items() if n not in skip and not issubclass(c, SchemaChecker)]
    return annotate_stream(stream, text_field, [c for c in checks if not c.skipped()])


def clean_stream(stream: DataFrame, text_field: str = "text") -> DataFrame:
    """``stream`` with its texts cleaned."""
    ship_package(stream.sparkSession)
    return stream.withColumn(text_field, TextCleaner().clean(F.col(text_field)))


_TOLD = "row_id long, hash string, first long, later boolean"
_STATE = "first long, until long"


def exact_duplicates_stream(
    stream: DataFrame, seconds: int, text_field: str = "text", id_col: str = "row_id", time_col: str = "ts"
) -> DataFrame:
    """(row_id, hash, first, later) of every row with a text: the first row that had it, and whether that is another one.

    Keyed state holds one id for each text hash, not the text.  A text is known for
    ``seconds`` after it was last seen, in event time, and then forgotten, so the
    state is bounded by the texts of that span.  Rows later than the watermark,
    which follows at the same distance, are dropped.  Of rows of one text that
    arrive together the least id is the first, so a stream that arrives in order
    of ids, and within the bound, tells what the check tells of the whole table.
    """
    ship_package(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(frames)  # ids and times of one text in one batch
        ids = np.concatenate([p["row_id"].to_numpy() for p in parts])
        last = max(int(p["seen"].max()) for p in parts)
        known = state.getOption
        first = int(known[0]) if known else int(ids.min())
        until = max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1, int(known[1]) if known else 0)
        state.update((first, until))
        state.setTimeoutTimestamp(until)
        told = pd.DataFrame({"row_id": ids, "hash": key[0], "first": first})
        # A row given again is the first itself; of equal ids in one batch only one is.
        told["later"] = (told["row_id"] != first) | told.duplicated("row_id")
        yield told

    rows = stream.withWatermark(time_col, f"{seconds} seconds").where(F.col(text_field).isNotNull())
    rows = rows.select(
        F.col(id_col).cast("long").alias("row_id"), F.col(time_col), F.unix_millis(F.col(time_col).cast("timestamp")).alias("seen"),
        F.sha2(text_field, 256).alias("hash"),
    )
    return rows.groupBy("hash").applyInPandasWithState(step, _TOLD, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

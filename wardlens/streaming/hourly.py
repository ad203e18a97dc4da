"""T4 on a stream: hourly cells of each (subject, label) as measurements arrive.

Hours count from a label's first measurement, so a cell is known once no earlier
measurement can come.  The watermark says when: rows older than it are dropped as
late, hence

* the origin is fixed once the watermark has passed the earliest row; until then
  rows wait as they came (no longer than the watermark's delay);
* a cell is final, and appended to the sink, once the watermark has reached its
  end, the first minute that rounds to the next hour; until then its sums wait.

State per subject, for each of its labels: the origin, the waiting rows and the
open cells, all bounded by the delay, kept in the query's checkpoint, so a
restarted query goes on with them.  One call serves all labels of a subject: most
labels have a row or two, and a call costs more than they do.  Sums are exact integers, as in the batch operator, and the average
is the batch operator's expression.  Cells beyond the watermark at the end of a
run stay open for the next one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlens.operators.series import _large, _mean2, _units
from wardlens.session import ensure_checkpoint_dir

MINUTE, HOUR = 60_000_000, 60  # microseconds; minutes

# JSON list of [label, origin, waiting rows: (microseconds, what a row adds), open cells: (hour, sums)]
_STATE = "labels string"
_CELL = "subject_id {id}, label string, hours_in bigint, icustay_id {stay}, hadm_id {visit}, s string, n bigint, b double, nb bigint, n_measures bigint"


def _add(a: list, b: list) -> list:
    """Sums of two cells: units, n, large, n_large, n_measures, least stay, least visit."""
    least = [min((x for x in pair if x is not None), default=None) for pair in zip(a[5:], b[5:])]
    return [x + y for x, y in zip(a[:5], b[:5])] + least


def cell_end(origin: int, hour: int) -> int:
    """First microsecond whose whole minutes since ``origin`` round to a later hour than ``hour``."""
    return origin + (hour * HOUR + HOUR // 2) * MINUTE


def advance(origin: int | None, waiting: list[tuple[int, list]], cells: dict[int, list], watermark: int) -> tuple[int | None, list, dict, list]:
    """State after the watermark has come to ``watermark`` (microseconds): (origin, waiting, cells, final cells)."""
    if origin is None and waiting and min(t for t, _ in waiting) < watermark:
        origin = min(t for t, _ in waiting)
    if origin is not None:
        for t, row in waiting:
            hour = (2 * ((t - origin) // MINUTE) + HOUR) // (2 * HOUR)
            cells[hour] = _add(cells[hour], row) if hour in cells else row
        waiting = []
    final = [] if origin is None else sorted(h for h in cells if cell_end(origin, h) <= watermark)
    return origin, waiting, cells, [(h, cells.pop(h)) for h in final]


def _cells(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stored = json.loads(state.get[0]) if state.exists else []
    labels = {label: (origin, [tuple(w) for w in waiting], dict(cells)) for label, origin, waiting, cells in stored}
    if not state.hasTimedOut:
        for pdf in batches:
            for label, t, units, large, stay, visit in zip(pdf["label"], pdf["us"], pdf["units"], pdf["large"], pdf["icustay_id"], pdf["hadm_id"]):
                known, big = not pd.isna(units), not pd.isna(large)
                waiting = labels.setdefault(None if pd.isna(label) else label, (None, [], {}))[1]
                waiting.append((int(t), [int(units) if known else 0, int(known), float(large) if big else 0.0, int(big), 1,
                                         *(None if pd.isna(x) else int(x) for x in (stay, visit))]))
    watermark = state.getCurrentWatermarkMs() * 1000
    kept, final, due = [], [], []
    for label, (origin, waiting, cells) in labels.items():
        origin, waiting, cells, closed = advance(origin, waiting, cells, watermark)
        kept.append((label, origin, waiting, list(cells.items())))
        final += [(label, h, c) for h, c in closed]
        due += [t + 1 for t, _ in waiting] if origin is None else [cell_end(origin, h) for h in cells]
    state.update((json.dumps(kept),))
    if due:  # called again when the watermark gets there, with or without new rows
        state.setTimeoutTimestamp(max(-(-min(due) // 1000), state.getCurrentWatermarkMs() + 1))
    if not final:
        return
    yield pd.DataFrame({"subject_id": [key[0]] * len(final), "label": [lb for lb, _, _ in final], "hours_in": [h for _, h, _ in final],
                        "icustay_id": pd.array([c[5] for _, _, c in final], "Int64"), "hadm_id": pd.array([c[6] for _, _, c in final], "Int64"),
                        "s": [str(c[0]) for _, _, c in final], "n": [c[1] for _, _, c in final], "b": [c[2] for _, _, c in final],
                        "nb": [c[3] for _, _, c in final], "n_measures": [c[4] for _, _, c in final]})


def hourly_cells(measurements: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The final cells of a stream of measurements (the columns of the measurement table), with the batch operator's columns.

    Rows that come later than ``delay`` behind the newest row are dropped.  Rows without a time take no part;
    a NULL subject or label is a group like any other."""
    types = dict(measurements.dtypes)
    rows = measurements.filter(F.col("charttime").isNotNull()).withColumn("at", F.col("charttime").cast("timestamp")).withWatermark("at", delay)
    rows = rows.select("subject_id", "label", "at", F.unix_micros("at").alias("us"), _units(F.col("valuenum")).cast("string").alias("units"),
                       _large(F.col("valuenum")).alias("large"), "icustay_id", "hadm_id")
    cells = rows.groupBy("subject_id").applyInPandasWithState(
        _cells, _CELL.format(id=types["subject_id"], stay=types["icustay_id"], visit=types["hadm_id"]), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    sums = cells.withColumn("s", F.col("s").cast("decimal(38,0)"))
    return sums.select("subject_id", "icustay_id", "hadm_id", "label", "hours_in", _mean2("s", "n", "b", "nb").alias("valuenum_avg"), "n_measures")


def stream_hourly(measurements: DataFrame, sink_path: str, checkpoint: str | None = None, delay: str = "1 hour",
                  available_now: bool = True) -> StreamingQuery:
    """Append the final cells of a stream to a parquet table; started again with the same ``checkpoint``, it goes on
    where it stopped.  ``available_now`` ends the query when what is there has been read."""
    if checkpoint is None:
        checkpoint = os.path.join(ensure_checkpoint_dir(measurements.sparkSession), "streams", uuid.uuid4().hex)
    writer = hourly_cells(measurements, delay).writeStream.format("parquet").outputMode("append") \
        .option("checkpointLocation", checkpoint).option("path", sink_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()

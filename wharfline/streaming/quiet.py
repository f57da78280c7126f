"""Sessions that have grown and gone quiet, as a stream: a session is due once nothing has been said in it for QUIET_MINUTES of event time.

The state of a session is what it had grown to when it was last due, and its open runs: stretches without a pause that long, each with first and last time and characters. Rows may come in any
order within the watermark's delay; a run ends when the watermark passes its last time by the quiet time, since no row that is still accepted could continue it. State and position are in
the query's checkpoint, so a stream that is stopped goes on where it was.

Scale: sessions are dealt out by hash to SHARES, and a share's sessions are one group with one state, since Spark's call of Python for a group costs some milliseconds, which would be the whole time if
each session were a group. The timer of a share stands at the end of its earliest run. A share's rows of a batch come in Arrow pieces and leave nothing but runs, of which there are as
many as fit between the watermark and the newest row; what stays of a quiet session is its id and a number. SHARES belongs to the checkpoint: with another number, state would not be found again.
Defined results: rows with a null time or session are left out; null characters count nothing. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wharfline.operators.pending import QUIET_MINUTES

QUIET = QUIET_MINUTES * 60 * 1_000_000
DUE = "session_id long, ended_at timestamp, content_chars long"
#: Characters by session; open runs in order of session and time.
STATE = "sessions array<long>, chars array<long>, of array<long>, first array<long>, last array<long>, said array<long>"
SHARES = 1024
#: Rows that are put to the runs at a time, at least.
ROWS = 1 << 16
Run = tuple[int, int, int]


def merged(runs: np.ndarray) -> np.ndarray:
    """Runs (rows: session, first, last, characters; times in microseconds) in order, those of a session without a pause of QUIET between them in one."""
    of, first, last, said = runs[:, np.lexsort((runs[1], runs[0]))]
    if not len(of):
        return runs
    so_far = pd.Series(last).groupby(of).cummax().to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (first[1:] - so_far[:-1] >= QUIET))))
    return np.stack([of[starts], first[starts], np.maximum.reduceat(last, starts), np.add.reduceat(said, starts)])


def joined(runs: list[Run]) -> list[Run]:
    """The same of one session's runs (first, last, characters)."""
    rows = np.array([(0, *r) for r in runs], np.int64).reshape(-1, 4).T
    return [tuple(r) for r in merged(rows)[1:].T.tolist()]


def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sessions, chars, *runs = (np.array(x, np.int64) for x in (state.get if state.exists else [()] * 6))
    runs, waiting = np.stack(runs), []
    for piece in pieces:
        of, us, said = (piece[name].to_numpy(np.int64) for name in ("session_id", "us", "chars"))
        waiting.append(np.stack([of, us, us, said]))
        # not for each piece: what is there already would be sorted again for every few rows
        if sum(w.shape[1] for w in waiting) > max(ROWS, runs.shape[1]):
            runs, waiting = merged(np.concatenate([runs, *waiting], axis=1)), []
    runs = merged(np.concatenate([runs, *waiting], axis=1))
    ended = runs[2] + QUIET <= state.getCurrentWatermarkMs() * 1000
    of, _, last, said = runs[:, ended]
    # runs that have ended come before the session's others, so they add up in this order to what it had
    known = np.union1d(sessions, of)
    grown = np.zeros(len(known), np.int64)
    grown[np.searchsorted(known, sessions)] = chars
    place = np.searchsorted(known, of)
    due = pd.DataFrame({"session_id": of, "ended_at": last.astype("datetime64[us]"), "content_chars": grown[place] + pd.Series(said).groupby(of).cumsum().to_numpy()})
    np.add.at(grown, place, said)
    runs = runs[:, ~ended]
    state.update(tuple(x.tolist() for x in (known, grown, *runs)))
    if runs.shape[1]:
        state.setTimeoutTimestamp(-(-(int(runs[2].min()) + QUIET) // 1000))
    yield due


def due_sessions(said: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of a stream (session_id, at, chars): (session_id, ended_at, content_chars), a row each time that a session has gone quiet, with all its characters until then."""
    rows = said.where("session_id IS NOT NULL AND at IS NOT NULL").select(F.col("session_id").cast("long").alias("session_id"), F.col("at").cast("timestamp").alias("at"), F.coalesce("chars", F.lit(0)).cast("long").alias("chars"))
    timed = rows.withColumn("us", F.unix_micros("at")).withColumn("share", F.pmod(F.xxhash64("session_id"), F.lit(SHARES))).withWatermark("at", late)
    return timed.groupBy("share").applyInPandasWithState(step, DUE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_due_sessions(said: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> None:
    """What is there, to its end; due sessions are appended below path."""
    query = due_sessions(said, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()

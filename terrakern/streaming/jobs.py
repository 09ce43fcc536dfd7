"""Jobs as a stream of events: a state for each job, kept between batches, and each event applied once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event does: the states in which it is allowed, and the state that follows.
STEPS = {
    "submit": ({"none", "done", "failed"}, "queued"),
    "start": ({"queued"}, "running"),
    "finish": ({"running"}, "done"),
    "fail": ({"queued", "running"}, "failed"),
}
ROW = "job long, applied long, state string, attempts long, refused long"
_STATE = "applied long, state string, attempts long, refused long"


def job_states(events: DataFrame) -> DataFrame:
    """ROW of each job in each batch of events (job, seq, action): the state after all its events so far, how often it was submitted, and how many
    events its state refused. `applied` is the last seq: an event whose seq isn't above it was applied before and changes
    nothing, so a batch may be sent again. Within a batch events go by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        applied, now, attempts, refused = state.get if state.exists else (-1, "none", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, action in zip(rows["seq"], rows["action"], strict=True):
            if seq <= applied:
                continue
            allowed, then = STEPS.get(action, (set(), now))
            applied = int(seq)
            if now in allowed:
                now, attempts = then, attempts + (action == "submit")
            else:
                refused += 1
        state.update((applied, now, attempts, refused))
        yield pd.DataFrame({"job": [key[0]], "applied": [applied], "state": [now], "attempts": [attempts], "refused": [refused]})

    return events.groupBy("job").applyInPandasWithState(step, ROW, _STATE, "append", GroupStateTimeout.NoTimeout)

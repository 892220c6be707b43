"""The fold over a stream of operations: a provision's text and what cannot be applied, as operations come in.

The library's other operators are batch; this one is an extension. A stream keeps order only by arrival, so operations
of a provision must arrive in the order in which they apply.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronofold.core.replay import outcome

OUT = "law string, para string, text string, flagged long"
STATE = "text string, flagged long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, flagged = state.get if state.exists else (None, 0)
    for frame in frames:
        for op in frame.sort_values("seq")[["change_type", "instruction", "new_text"]].itertuples(index=False):
            text, why = outcome(text, key[1], *(None if pd.isna(x) else x for x in op))
            flagged += why is not None
    state.update((text, flagged))
    yield pd.DataFrame([(*key, text, flagged)], columns=["law", "para", "text", "flagged"])


def live(ops: DataFrame) -> DataFrame:
    """Rows (law, para, text, flagged) that change with each batch of ``ops`` (law, para, seq, change_type, instruction, new_text)."""
    rows = ops.select("law", "para", "seq", "change_type", "instruction", "new_text")
    return rows.groupBy("law", "para").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

"""Conversation memory as a stream: an optional adapter that keeps each conversation's newest messages in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundspark.config import DEFAULT, EngineConfig
from groundspark.operators.memory import storable


def remember(messages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """For a stream of (conv_id, turn, role, text): after each batch the changed conversations' buffers, as rows (conv_id, turn, role, text)."""
    most = max(0, config.memory_max_messages)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += list(batch[["turn", "role", "text"]].itertuples(index=False, name=None))
        held = sorted(held)[-most:] if most else []
        state.update(tuple(list(c) for c in zip(*held)) if held else ([], [], []))
        yield pd.DataFrame([(key[0], *h) for h in held], columns=["conv_id", "turn", "role", "text"])

    return storable(messages).groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turn long, role string, text string", "turns array<long>, roles array<string>, texts array<string>", "update", GroupStateTimeout.NoTimeout)

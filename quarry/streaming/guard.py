"""Answers that repeat a line again and again, found as they stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPEATS, LEAST_CHARS = 3, 12
_MARKS = re.compile(r"\s*(?:[0-9]+[.)]\s+)?(?:[*\-•]\s+)*")


def line_key(line: str) -> str:
    """A line without its number and bullets, white space collapsed."""
    return " ".join(line[_MARKS.match(line).end() :].split())


class LineRepeatGuard:
    """Counts equal lines in a row over pieces of text; blank lines are passed over."""

    def __init__(self, line: str = "", last: str = "", run: int = 0) -> None:
        self.line, self.last, self.run = line, last, run

    def push(self, piece: str) -> bool:
        """Whether this piece completed the third equal line in a row."""
        *whole, self.line = (self.line + piece).split("\n")
        looped = False
        for key in filter(None, map(line_key, whole)):
            self.run = self.run + 1 if key == self.last else 1
            self.last = key
            looped |= self.run >= REPEATS and len(key) >= LEAST_CHARS
        return looped


def watch(pieces: DataFrame) -> DataFrame:
    """(conv_id, looped) after each batch of a stream of (conv_id, turn, text)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, last, run, looped = state.get if state.exists else ("", "", 0, False)
        guard = LineRepeatGuard(line, last, run)
        for _, piece in sorted((t, x) for b in batches for t, x in zip(b["turn"], b["text"])):
            looped = guard.push(piece) or looped
        state.update((guard.line, guard.last, guard.run, bool(looped)))
        yield pd.DataFrame({"conv_id": [key[0]], "looped": [bool(looped)]})

    return pieces.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, looped boolean", "line string, last string, run int, looped boolean", "update", GroupStateTimeout.NoTimeout
    )

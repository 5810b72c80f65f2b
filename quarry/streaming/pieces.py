"""Model output that arrives in pieces: bytes to text, and text without its thinking."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN, CLOSE = "<think>", "</think>"


class TextPieces:
    """Bytes to text: a character's first bytes wait for the rest, what can be none becomes U+FFFD."""

    def __init__(self, waiting: bytes = b"") -> None:
        self._decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self._decoder.setstate((waiting, 0))

    def push(self, piece: bytes, final: bool = False) -> str:
        return self._decoder.decode(piece, final)

    @property
    def waiting(self) -> bytes:
        return self._decoder.getstate()[0]


class ThinkFilter:
    """Drops what stands between think tags and the white space after; tags may be cut anywhere.
    Text that may yet be the start of a tag is held back until it is known to be none."""

    def __init__(self, held: str = "", inside: bool = False, after: bool = False) -> None:
        self.held, self.inside, self.after = held, inside, after

    def push(self, piece: str, final: bool = False) -> str:
        text, out = self.held + piece, []
        self.held = ""
        while text:
            if self.after:
                text = text.lstrip()
                self.after = not text
                continue
            tag = CLOSE if self.inside else OPEN
            before, found, text = text.partition(tag)
            if not found:
                # the longest end that a tag could begin with
                cut = next((k for k in range(min(len(tag) - 1, len(before)), 0, -1) if tag.startswith(before[-k:])), 0)
                if not final:
                    self.held, before = before[len(before) - cut :], before[: len(before) - cut]
            if not self.inside:
                out.append(before)
            if found:
                self.after, self.inside = self.inside, not self.inside
        return "".join(out)


def clean(pieces: DataFrame, id_col: str = "conv_id", order_col: str = "turn", bytes_col: str = "piece") -> DataFrame:
    """(id, text): a stream's pieces of bytes as the text that is shown so far by each batch,
    per stream of ``id_col``; pieces of a batch go by ``order_col``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held, inside, after = state.get if state.exists else (b"", "", False, False)
        text, think = TextPieces(bytes(waiting)), ThinkFilter(held, inside, after)
        rows = pd.concat(list(batches)).sort_values(order_col, kind="stable")
        shown = "".join(think.push(text.push(bytes(p))) for p in rows[bytes_col])
        state.update((text.waiting, think.held, think.inside, think.after))
        yield pd.DataFrame({"id": [key[0]], "text": [shown]})

    schema = "waiting binary, held string, inside boolean, after boolean"
    return pieces.groupBy(id_col).applyInPandasWithState(run, "id long, text string", schema, "append", GroupStateTimeout.NoTimeout)

"""Posts out of a stream of pieces of JSON: each element of the array ``posts`` is given as soon as its last brace has come.

What is kept of a reply is where the scan stands and the part of a post that is still open, never what was read before; a character is looked
at once, however the reply was cut.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

NAME = '"posts"'
#: Where a scan can stand: before the array's name or within it (number of characters seen), after it, after its colon; in the array; in a post; through.
AFTER, COLON, ARRAY, POST, THROUGH = len(NAME), 100, 101, 102, 103
SPACE = frozenset(" \t\n\r\f\v")
#: What matters outside and inside of strings.
OUTSIDE, INSIDE = re.compile(r'[{}"]'), re.compile(r'["\\]')


class Scanner:
    """Feed pieces in order; ``state`` can be kept between them."""

    def __init__(self, state: tuple | None = None):
        self.at, self.depth, self.string, self.escaped, self.spaced, self.n, self.open = state or (0, 0, False, False, False, 0, "")

    @property
    def state(self) -> tuple:
        return self.at, self.depth, self.string, self.escaped, self.spaced, self.n, self.open

    def feed(self, piece: str) -> list[tuple[int, dict]]:
        """The posts (number, post) that end in this piece. A post that is no valid JSON is passed over and has no number; anything but a post, a comma or white
        space ends the array."""
        out, i = [], 0
        while i < len(piece) and self.at != THROUGH:
            if self.at == POST:
                i = self._post(piece, i, out)
            elif self.at == ARRAY:
                c = piece[i]
                if c == "{":
                    self.at, self.depth, self.string, self.escaped, self.open = POST, 0, False, False, ""
                else:
                    self.at = ARRAY if c in " \t\n\r," else THROUGH
                    i += 1
            else:
                self._name(piece[i])
                i += 1
        return out

    def _name(self, c: str) -> None:
        if self.at == COLON:
            self.at = ARRAY if c == "[" else COLON if c in SPACE else int(c == NAME[0])
        elif self.at == AFTER:
            closing = not self.spaced  # the quote that ends the name may begin another one
            self.spaced = self.spaced or c in SPACE
            self.at = COLON if c == ":" else AFTER if c in SPACE else 2 if closing and c == NAME[1] else int(c == NAME[0])
        else:
            self.at = self.at + 1 if c == NAME[self.at] else int(c == NAME[0])
            self.spaced = False

    def _post(self, piece: str, i: int, out: list) -> int:
        begun = i
        while i < len(piece):
            if self.escaped:
                self.escaped, i = False, i + 1
                continue
            m = (INSIDE if self.string else OUTSIDE).search(piece, i)
            if not m:
                break
            c, i = m[0], m.end()
            if c == '"':
                self.string = not self.string
            elif c == "\\":
                self.escaped = True
            else:
                self.depth += 1 if c == "{" else -1
                if not self.depth:
                    whole, self.open, self.at = self.open + piece[begun:i], "", ARRAY
                    try:
                        out.append((self.n, json.loads(whole)))
                        self.n += 1
                    except ValueError:
                        pass
                    return i
        self.open += piece[begun:]
        return len(piece)


class Posts(StatefulProcessor):
    """A reply's scan is its state, until it has been silent for ``idle`` seconds of event time."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", "at int, depth int, string boolean, escaped boolean, spaced boolean, n int, open string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.scan.get() if self.scan.exists() else None
        scanner, pdf = Scanner(tuple(held)[:7] if held else None), pd.concat(list(rows)).sort_values("seq")
        out = [(key[0], n, json.dumps(post, ensure_ascii=False, sort_keys=True)) for piece in pdf["piece"] for n, post in scanner.feed(piece or "")]
        until = int(max(pdf["ms"].max(), held[7] - self.idle * 1000 if held else 0)) + self.idle * 1000
        if held and held[7] != until:
            self.handle.deleteTimer(held[7])
        self.handle.registerTimer(until)
        self.scan.update((*scanner.state, until))
        yield pd.DataFrame(out, columns=["id", "number", "post"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.scan.clear()
        yield pd.DataFrame([], columns=["id", "number", "post"])

    def close(self) -> None:
        pass


def posts(pieces: DataFrame, late: str = "1 hour", idle: int = 3600) -> DataFrame:
    """(id, number, post: JSON) of a stream of pieces (id, seq, piece, at); a reply's pieces come in order of ``seq`` from batch to batch."""
    p = pieces.select(F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), "piece", F.col("at").cast("timestamp").alias("at")).withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return p.groupBy("id").transformWithStateInPandas(Posts(idle), "id long, number int, post string", "Append", "EventTime")

"""Streams of tokens with tags: a state machine for each conversation, in batches and as a stateful streaming operator."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Tags and what their contents are called.
TAGS = {"think": "thought", "action": "action", "answer": "answer"}
#: Characters held back at the end of a piece, where a tag may be about to begin.
HELD = 15


class TagParser:
    """Feeds pieces of a stream, gives (type, text) events; a tag may be split over pieces anywhere.

    Outside of tags the type is content. An end without its beginning is content; what a tag that is never closed holds comes
    out at finish().
    """

    def __init__(self, mode: str = "", buffer: str = "", seen: str = ""):
        self.mode, self.buffer, self.seen = mode, buffer, seen

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.buffer += piece
        out: list[tuple[str, str]] = []
        while True:
            if self.mode:
                body, found, rest = self.buffer.partition(f"</{self.mode}>")
                if not found:
                    self._move(max(0, len(self.buffer) - HELD), out)
                    return out
                self.seen += body
                out.append((TAGS[self.mode], self.seen.strip()))
                self.mode, self.seen, self.buffer = "", "", rest
                continue
            at = min(((k, t) for t in TAGS if (k := self.buffer.find(f"<{t}>")) >= 0), default=None)
            if at is None:
                self._move(max(0, len(self.buffer) - HELD), out)
                return out
            if at[0]:
                out.append(("content", self.buffer[: at[0]]))
            self.mode, self.buffer = at[1], self.buffer[at[0] + len(at[1]) + 2 :]

    def _move(self, n: int, out: list[tuple[str, str]]) -> None:
        if n and self.mode:
            self.seen += self.buffer[:n]
        elif n:
            out.append(("content", self.buffer[:n]))
        self.buffer = self.buffer[n:]

    def finish(self) -> list[tuple[str, str]]:
        left = (self.seen + self.buffer) if self.mode else self.buffer
        out = [(TAGS[self.mode] if self.mode else "content", left.strip() if self.mode else left)] if left else []
        self.mode = self.buffer = self.seen = ""
        return out


class TwoModes:
    """Thought and answer of a reply that has think and answer tags alone; pieces may split it anywhere.

    The tag that begins first counts, thoughts add up, and the first answer that ends is the last thing read. What stands after
    thoughts without an answer is the answer; so is a reply without tags, or one whose tags hold nothing, without its tags.
    """

    def __init__(self, mode: str = "", buffer: str = "", thought: tuple = (), answer: tuple = (), plain: tuple = ()):
        self.mode, self.buffer = mode, buffer
        self.texts = {"think": list(thought), "answer": list(answer), "plain": list(plain)}

    def feed(self, piece: str) -> None:
        lo = max(0, len(self.buffer) - HELD)
        self.buffer += piece
        while self.mode != "done":
            if self.mode:
                body, found, rest = self.buffer.partition(f"</{self.mode}>")
                keep = 0 if found else min(len(body), HELD)
                for name in (self.mode, "plain"):
                    self.texts[name].append(body[: len(body) - keep])
                self.buffer = rest if found else body[len(body) - keep :]
                if not found:
                    return
                self.mode = "done" if self.mode == "answer" else ""
            else:
                at = min(((k, t) for t in ("think", "answer") if (k := self.buffer.find(f"<{t}>", lo)) >= 0), default=None)
                if at is None:
                    return
                self.texts["plain"].append(self.buffer[: at[0]])
                self.mode, self.buffer = at[1], self.buffer[at[0] + len(at[1]) + 2 :]
            lo = 0

    def finish(self) -> tuple[str, str]:
        thought, answer, plain = ("".join(self.texts[name]) for name in ("think", "answer", "plain"))
        left = re.sub("</?(?:think|answer)>", "", self.buffer)
        if self.mode == "think":
            thought += left
        elif self.mode == "answer" or not answer:
            answer += left
        if not thought.strip() and not answer.strip():
            answer = plain + left
        return thought.strip(), answer.strip()


def folded(events: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbouring pieces of content as one."""
    out: list[tuple[str, str]] = []
    for kind, text in events:
        if out and kind == out[-1][0] == "content":
            out[-1] = (kind, out[-1][1] + text)
        else:
            out.append((kind, text))
    return out


EVENTS = "place int, type string, text string"


def parse_batch(tokens: DataFrame, key: str, order: str, piece: str) -> DataFrame:
    """Events of every conversation of a finished stream. A conversation is one group; its size is a reply's."""
    kind = dict(tokens.dtypes)[key]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = TagParser()
        got = [e for x in rows.sort_values("o")["p"] for e in p.feed(x or "")] + p.finish()
        return pd.DataFrame([(rows["k"].iloc[0], i, t, s) for i, (t, s) in enumerate(folded(got))], columns=["k", "place", "type", "text"])

    out = tokens.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(piece).alias("p")).groupBy("k").applyInPandas(run, f"k {kind}, {EVENTS}")
    return out.withColumnRenamed("k", key)


def parse_two_modes(tokens: DataFrame, keys: list[str], order: str, piece: str) -> DataFrame:
    """The columns keys, thought and answer of every reply of a finished stream, by TwoModes."""

    @F.pandas_udf("thought string, answer string")
    def parsed(replies: pd.Series) -> pd.DataFrame:
        got = []
        for pieces in replies:
            p = TwoModes()
            for x in pieces:
                p.feed(x or "")
            got.append(p.finish())
        return pd.DataFrame(got, columns=["thought", "answer"])

    pieces = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("p")))), lambda x: x["p"])
    return tokens.groupBy(*keys).agg(pieces.alias("p")).select(*keys, parsed("p").alias("r")).select(*keys, "r.thought", "r.answer")


class TagProcessor(StatefulProcessor):
    """transformWithStateInPandas: one parser's state (mode, buffer, open text) for each conversation.

    A conversation that gets nothing for idle_ms milliseconds has ended: what was held back comes out, and its state goes.
    """

    def __init__(self, idle_ms: int | None = None):
        self._idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._state = handle, handle.getValueState("parser", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parser = TagParser(*json.loads(self._state.get()[0])) if self._state.exists() else TagParser()
        events = [e for x in pd.concat(list(rows)).sort_values("seq")["piece"] for e in parser.feed(x or "")]
        self._state.update((json.dumps([parser.mode, parser.buffer, parser.seen]),))
        if self._idle_ms is not None:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle_ms)
        yield pd.DataFrame([(key[0], t, s) for t, s in events], columns=["conv_id", "type", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = TagParser(*json.loads(self._state.get()[0])).finish() if self._state.exists() else []
        self._state.clear()
        yield pd.DataFrame([(key[0], t, s) for t, s in events], columns=["conv_id", "type", "text"])

    def close(self) -> None:
        pass


def parse_stream(tokens: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Events of a stream of (conv_id, seq, piece) as they become certain; needs the RocksDB state store.

    With idle_ms, a conversation without pieces for so long is ended by a timer; without it, open text stays in the state.
    """
    mode = "None" if idle_ms is None else "ProcessingTime"
    return tokens.groupBy("conv_id").transformWithStateInPandas(TagProcessor(idle_ms), "conv_id long, type string, text string", "Append", mode)


def frames(df: DataFrame, key: str, data: str) -> DataFrame:
    """Server-sent events of a text: each line data: <json>, bad JSON left out."""
    lines = df.select(key, F.posexplode(F.split(data, "\n")).alias("place", "line")).where(F.startswith("line", F.lit("data: ")))
    event = F.from_json(F.substring("line", 7, 1 << 30), "type string, data string")
    return lines.withColumn("e", event).where("e.type is not null").select(key, "place", "e.type", "e.data")

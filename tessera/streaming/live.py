"""Events of a streamed reply while it comes: thinking and content as soon as they are certain, and what they add up to.

Pieces of a reply have a place (seq, from 0) and may come late, twice, or as null; the last one is marked. One state machine reads
them, in two kinds of replies:

* steps: think, action and answer tags, one step of an agent. An action that can be read, or an answer, ends it;
* plain: think and answer tags alone; it ends with an event of the whole thought and answer.

A batch and a stream give the same events for a reply, however its pieces are dealt to micro-batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.batches import packed, rows_of

STEPS, PLAIN = "steps", "plain"
#: Tags of either kind, in the order in which they are looked for: one that stands later wins over a later one in this list.
TAGS = {STEPS: ("think", "action", "answer"), PLAIN: ("think", "answer")}
#: What is sent on of a tag that is still open.
SENT = {"think": "thinking", "answer": "content"}
#: Characters held back, where an end tag may have begun.
HELD = 15
# fixed values: a tool call that stands in a reply without its tags, or in an action without an end
OPEN_CALL = re.compile(r'\{[^{}]*"tool"[^{}]*\}')
BARE_CALL = re.compile(r'\{[^{}]*"tool"\s*:\s*"[^"]+"\s*,\s*"input"\s*:\s*\{[^{}]*\}[^{}]*\}')

Event = tuple[str, str]


def _call(text: str) -> str | None:
    """A tool call as JSON of its tool and input; null if the text is JSON but no object. Raises ValueError if it isn't JSON."""
    found = json.loads(text)
    return json.dumps({"tool": found.get("tool"), "input": found.get("input", {})}, ensure_ascii=False, sort_keys=True) if isinstance(found, dict) else None


def _stripped(text: str, tags: Iterable[str]) -> str:
    return re.sub(f"</?(?:{'|'.join(tags)})>", "", text)


class Reply:
    """The state of one reply. feed() takes its pieces in order, finish() its end; both give events (type, data)."""

    def __init__(self, kind: str):
        self.kind, self.inside, self.held, self.whole, self.begun, self.ended = kind, "", "", "", False, False
        self.texts = dict.fromkeys(TAGS[kind], "")

    def feed(self, piece: str | None) -> list[Event]:
        out: list[Event] = []
        if not self.begun:
            self.begun = True
            out.append(("thinking_start", "") if self.kind == STEPS else ("start", ""))
        if self.ended or not piece:
            return out
        self.whole += piece
        self.held += piece
        while not self.ended and (self._inside(out) if self.inside else self._outside(out)):
            pass
        return out

    def _outside(self, out: list[Event]) -> bool:
        """Enters the first tag that is there; what stands before it goes."""
        for tag in TAGS[self.kind]:
            _, found, rest = self.held.partition(f"<{tag}>")
            if found:
                self.inside, self.held = tag, rest
                if self.kind == PLAIN and tag == "think":
                    out.append(("thinking_start", ""))
                return True
        return False

    def _inside(self, out: list[Event]) -> bool:
        """Reads up to the tag's end, or sends on what can't be part of it."""
        tag = self.inside
        if tag == "over":
            return False
        body, found, rest = self.held.partition(f"</{tag}>")
        if not found:
            if len(self.held) > HELD:
                self._take(tag, self.held[:-HELD], out)
                self.held = self.held[-HELD:]
            return False
        self.held, self.inside = rest, ""
        if self.kind == PLAIN and tag == "answer":
            self._take(tag, body, out)
            self.inside = "over"
        else:
            self.texts[tag] += body
            self._close(tag, self.texts[tag].strip(), out)
        return True

    def _take(self, tag: str, text: str, out: list[Event]) -> None:
        self.texts[tag] += text
        if tag in SENT:
            out.append((SENT[tag], text))

    def _close(self, tag: str, text: str, out: list[Event]) -> None:
        if tag == "think":
            out.append(("thought", text))
            if self.kind == STEPS:
                self.texts["think"] = ""
        elif tag == "answer":
            self._end(("answer", text), out)
        else:
            self.texts["action"] = ""
            try:
                call = _call(text)
            except ValueError:
                out.append(("thought", "unreadable tool call"))
                return
            self._end(("action", call), out) if call else out.append(("observation", "unreadable tool call"))

    def _end(self, event: Event, out: list[Event]) -> None:
        out.append(event)
        self.ended = True

    def finish(self) -> list[Event]:
        out = self.feed(None)
        if not self.ended:
            self._finish_steps(out) if self.kind == STEPS else self._finish_plain(out)
        self.ended = True
        return out

    def _finish_steps(self, out: list[Event]) -> None:
        tag, some = self.inside, bool(self.held.strip())
        if tag and some:
            self.texts[tag] += self.held
        if tag in ("think", "answer") and some and (text := re.sub(f"</{tag}>.*", "", self.texts[tag]).strip()):
            out.append(("thought" if tag == "think" else "answer", text))
        if tag == "action" and some and self._called(OPEN_CALL.search(self.texts[tag].strip()), out):
            return
        if not self.texts["answer"] and not self._called(BARE_CALL.search(self.whole), out):
            left = OPEN_CALL.sub("", _stripped(self.whole, (*TAGS[STEPS], "observation"))).strip()
            if left:
                out.append(("answer", left))

    def _called(self, found: re.Match | None, out: list[Event]) -> bool:
        try:
            call = _call(found.group()) if found else None
        except ValueError:
            call = None
        if call:
            self._end(("action", call), out)
        return call is not None

    def _finish_plain(self, out: list[Event]) -> None:
        left = _stripped(self.held, TAGS[PLAIN]).strip()
        if left and self.inside == "think":
            self.texts["think"] += left
            out.append(("thought", self.texts["think"].strip()))
        elif left and (self.inside == "answer" or not self.texts["answer"]):
            self._take("answer", left, out)
        if not any(t.strip() for t in self.texts.values()) and (left := _stripped(self.whole, TAGS[PLAIN]).strip()):
            self._take("answer", left, out)
        self._end(("done", json.dumps({"thought": self.texts["think"].strip(), "answer": self.texts["answer"].strip()}, ensure_ascii=False)), out)


class Ordered:
    """A reply whose pieces come in any order: each waits for those before it. A piece that came already is passed over."""

    def __init__(self, kind: str):
        self.reply, self.next, self.places, self.waiting = Reply(kind), 0, 0, {}

    def dump(self) -> str:
        # of a reply that has ended only this is kept, so that pieces that come again find it
        return json.dumps({"ended": True}) if self.reply.ended else json.dumps([vars(self.reply), self.next, self.places, list(self.waiting.items())])

    @classmethod
    def load(cls, kind: str, state: str | None) -> Ordered:
        out, got = cls(kind), json.loads(state) if state else None
        if isinstance(got, dict):
            out.reply.ended = True
        elif got:
            vars(out.reply).update(got[0])
            out.next, out.places, out.waiting = got[1], got[2], {k: tuple(v) for k, v in got[3]}
        return out

    def _numbered(self, events: list[Event]) -> list[tuple[int, str, str]]:
        self.places += len(events)
        return [(self.places - len(events) + k, *e) for k, e in enumerate(events)]

    def add(self, rows: Iterable[tuple[int, str | None, bool | None]]) -> list[tuple[int, str, str]]:
        """Events (place, type, data) that further pieces (seq, piece, last) make certain."""
        if self.reply.ended:
            return []
        for seq, piece, last in rows:
            if seq >= self.next:
                self.waiting.setdefault(seq, (piece, bool(last)))
        out: list[Event] = []
        while not self.reply.ended and self.next in self.waiting:
            piece, last = self.waiting.pop(self.next)
            self.next += 1
            out += self.reply.feed(piece)
            if last:
                out += self.reply.finish()
        return self._numbered(out)

    def end(self) -> list[tuple[int, str, str]]:
        """What is left when no more comes: waiting pieces in their order, over gaps, and the end."""
        if self.reply.ended:
            return []
        out = [e for _, (piece, _) in sorted(self.waiting.items()) for e in self.reply.feed(piece)]
        self.waiting = {}
        return self._numbered(out + self.reply.finish())


def _rows(part: pd.DataFrame) -> list[tuple[int, str | None, bool | None]]:
    return [(int(s), None if pd.isna(p) else p, bool(e) and not pd.isna(e)) for s, p, e in zip(part["seq"], part["piece"], part["last"], strict=True)]


def _events(batches: Iterable[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """conv_id, place, type and data of pieces (conv_id, seq, piece, last) that are sorted by reply: one reply's state is held."""
    conv_id, reply, schema = None, None, None

    def read(b: pa.RecordBatch) -> Iterator[tuple]:
        nonlocal conv_id, reply
        for key, *row in rows_of(b):
            if reply is None or key != conv_id:
                if reply:
                    yield from ((conv_id, *e) for e in reply.end())
                conv_id, reply = key, Ordered(kind)
            yield from ((key, *e) for e in reply.add([row]))

    for b in batches:
        schema = pa.schema([b.schema.field("conv_id"), ("place", pa.int32()), ("type", pa.string()), ("data", pa.string())])
        yield from packed(read(b), schema)
    if reply:
        yield from packed(((conv_id, *e) for e in reply.end()), schema)


def live_batch(pieces: DataFrame, kind: str = STEPS) -> DataFrame:
    """conv_id, place, type and data of all events of finished replies; pieces: conv_id, seq, piece, last. Dealt and sorted by reply, pieces are read one by one."""
    rows = pieces.where("seq is not null").select("conv_id", "seq", "piece", "last").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(lambda it: _events(it, kind), f"conv_id {dict(pieces.dtypes)['conv_id']}, place int, type string, data string")


class LiveProcessor(StatefulProcessor):
    """transformWithStateInPandas: the state of each reply until its last piece was read.

    With idle_ms, a reply that gets nothing for so long is ended as it is, and its state goes; so does what is kept of one that has ended.
    """

    def __init__(self, kind: str, idle_ms: int | None):
        self._kind, self._idle_ms = kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._state = handle, handle.getValueState("reply", "state string")

    def _load(self) -> Ordered:
        return Ordered.load(self._kind, self._state.get()[0] if self._state.exists() else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        o = self._load()
        events = o.add([x for part in rows for x in _rows(part)])
        self._state.update((o.dump(),))
        if self._idle_ms is not None:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle_ms)
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["conv_id", "place", "type", "data"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = self._load().end()
        self._state.clear()
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["conv_id", "place", "type", "data"])

    def close(self) -> None:
        pass


def live_stream(pieces: DataFrame, kind: str = STEPS, idle_ms: int | None = None) -> DataFrame:
    """As live_batch for a stream, each event in the micro-batch in which it becomes certain; needs the RocksDB state store."""
    schema = f"conv_id {dict(pieces.dtypes)['conv_id']}, place int, type string, data string"
    mode = "None" if idle_ms is None else "ProcessingTime"
    return pieces.where("seq is not null").select("conv_id", "seq", "piece", "last").groupBy("conv_id").transformWithStateInPandas(LiveProcessor(kind, idle_ms), schema, "Append", mode)


def pieces_of(replies: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """conv_id, seq, piece and last: texts cut into pieces of `size` characters; a text of none is one null piece."""
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = replies.select(F.col(key).alias("conv_id"), cut.alias("p")).select("conv_id", F.size("p").alias("n"), F.posexplode_outer("p").alias("seq", "piece"))
    return rows.select("conv_id", F.coalesce("seq", F.lit(0)).alias("seq"), "piece", (F.coalesce("seq", F.lit(0)) >= F.col("n") - 1).alias("last"))

"""Live events: literal cases of both kinds, and a stream that equals the batch for any cut, order and repetition of its pieces."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest

from tessera.sources.tokens import token_stream
from tessera.streaming import live
from tessera.streaming.live import PLAIN, STEPS, Ordered, Reply, live_batch, live_stream, pieces_of

CALL = '{"tool": "search", "input": {"q": "é"}}'
CALLED = '{"input": {"q": "é"}, "tool": "search"}'


def events(kind, *pieces):
    r = Reply(kind)
    return [e for p in pieces for e in r.feed(p)] + r.finish()


def closing(kind, text):
    """Events that don't depend on where the pieces end."""
    return [e for e in events(kind, text) if e[0] not in ("thinking", "content")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x <think> a </think> y <think>b</think><answer> c </answer> rest", [("thought", "a"), ("thought", "b"), ("answer", "c")]),
        (f"<think>t</think><action>{CALL}</action><answer>never</answer>", [("thought", "t"), ("action", CALLED)]),
        ("<action>not json</action><answer>ok</answer>", [("thought", "unreadable tool call"), ("answer", "ok")]),
        ("<action>[1]</action><answer>ok</answer>", [("observation", "unreadable tool call"), ("answer", "ok")]),
        ("<answer>first</answer><think>but think is looked for first</think>", [("thought", "but think is looked for first"), ("answer", "firstbut think is looked for first")]),
        ("<think>open", [("thought", "open"), ("answer", "open")]),
        ("<answer>open end", [("answer", "open end")]),
        ('<action>go {"tool": "x", "input": 3} on', [("action", '{"input": 3, "tool": "x"}')]),
        (f"no tags {CALL} at all", [("action", CALLED)]),
        ('plain {"tool": broken} words', [("answer", "plain  words")]),
        ("  ", []),
        ("", []),
    ],
)
def test_steps(text, want):
    assert closing(STEPS, text) == [("thinking_start", ""), *want]


@pytest.mark.parametrize(
    ("text", "thought", "answer"),
    [
        ("<think> a </think><think>b</think><answer> c </answer> rest", "a b", "c"),
        ("<think>a</think> and so", "a", "and so"),
        ("<think>open", "open", ""),
        ("<answer>open", "", "open"),
        ("nothing", "", "nothing"),
        ("<think></think><answer></answer>", "", ""),
        ("<think> </think>", "", ""),
        ("", "", ""),
    ],
)
def test_plain(text, thought, answer):
    got = events(PLAIN, text)
    assert got[0] == ("start", "") and got[-1][0] == "done" and json.loads(got[-1][1]) == {"thought": thought, "answer": answer}


def test_open_tags_are_sent_on_but_for_what_may_be_their_end():
    got = events(STEPS, "<think>", "x" * 20, "y" * 10, "</thi", "nk><answer>", "z" * 30, "</answer>")
    assert got[1:] == [("thinking", "x" * 5), ("thinking", "x" * 10), ("thinking", "x" * 5), ("thought", "x" * 20 + "y" * 10), ("content", "z" * 15), ("answer", "z" * 30)]
    assert events(PLAIN, "<think>a", None, "b</think>")[1:3] == [("thinking_start", ""), ("thought", "ab")]


def replies(seed, n=12):
    rng = random.Random(seed)
    parts = ["<think>", "</think>", "<answer>", "</answer>", "<action>", "</action>", CALL, "words and more words ", "é\n", "<thi", '{"tool"', " "]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(n)]


@pytest.mark.parametrize("kind", [STEPS, PLAIN])
def test_any_order_gives_the_same(kind):
    """Pieces shuffled, repeated and cut into batches at random, with the state written and read between them."""
    rng = random.Random(3)
    for _, text in replies(7, 150):
        size = rng.randint(1, 9)
        cut = [text[k : k + size] for k in range(0, len(text), size)] or [None]
        rows = [(k, p, k == len(cut) - 1) for k, p in enumerate(cut)]
        whole = Ordered(kind)
        want = whole.add(rows)
        shuffled = rows + rng.sample(rows, len(rows) // 3)
        rng.shuffle(shuffled)
        got, state = [], None
        while shuffled:
            n = rng.randint(1, 5)
            o = Ordered.load(kind, state)
            got += o.add(shuffled[:n])
            state, shuffled = o.dump(), shuffled[n:]
        assert got == want and [e[0] for e in got] == list(range(len(got)))


def test_a_gap_is_skipped_at_the_end():
    o = Ordered(STEPS)
    assert o.add([(0, "<answer>a", False), (2, "c", False)]) == [(0, "thinking_start", "")]
    assert Ordered.load(STEPS, o.dump()).end() == [(1, "answer", "ac")]


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def collected(spark, df, checkpoint, out):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("kind", [STEPS, PLAIN])
def test_stream_equals_batch(spark, rocksdb, tmp_path, kind):
    pieces = pieces_of(spark.createDataFrame(replies(5), "conv_id long, text string"), "conv_id", "text", 6)
    want = sorted(tuple(r) for r in live_batch(pieces, kind).collect())
    rows = [tuple(r) for r in pieces.collect()]
    random.Random(1).shuffle(rows)
    rows += rows[:5] + [(3, None, "lost", None)]
    schema = "conv_id long, seq int, piece string, last boolean"
    for k in range(3):  # three files: three batches
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(spark, live_stream(stream, kind), str(tmp_path / "c"), str(tmp_path / "out"))
    assert got == want and len(want) > 20


def test_a_batch_holds_one_reply(spark):
    """Pieces of a reply aren't gathered into a row, and the events of an Arrow batch of 40,000 pieces take a few MB (before: a dict for each piece and event, 10,000 replies at once)."""
    plan = live_batch(spark.createDataFrame([(1, 0, "a", True)], "conv_id long, seq int, piece string, last boolean"))._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    piece = ["<think>", *["1234567"] * 97, "</think>", "x"]
    columns = ([k // 100 for k in range(40_000)], [k % 100 for k in range(40_000)], piece * 400, [False] * 40_000)
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv_id", "seq", "piece", "last"])
    tracemalloc.start()
    rows = sum(x.num_rows for x in live._events(iter([b]), STEPS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 38_000 and peak < 8e6


def test_live_events_of_the_query(spark, tmp_path):
    """The query gathers no reply into a row, and gives the events of one state machine a reply, whatever Arrow batches hold."""
    from tessera import plans

    rows = [(c, t, "user", "some text, " * 40 + str(t)) for c in range(2) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    df = plans.QUERIES["live_events"](spark, str(tmp_path))
    assert "collect_list" not in df._jdf.queryExecution().toString()
    got = sorted(tuple(r) for r in df.where("reply = '1/0'").select("place", "type", "data").collect())
    text = rows[4][3]
    reply = f"<think>{text}</think><answer>{text}</answer>"
    assert got == [(k, *e) for k, e in enumerate(events(STEPS, *[reply[k : k + 7] for k in range(0, len(reply), 7)]))]
    assert df.select("reply").distinct().count() == 8


def test_replies_end_over_arrow_batches():
    """A reply may begin in one batch and end in another; one whose last piece never comes ends with the next reply, or with the task."""
    rows = [(1, 0, "<answer>a", False), (1, 1, "b</answer>", True), (2, 0, "<answer>c", False), (None, 0, "<answer>d", None), (None, 0, "again", None)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("conv_id", "seq", "piece", "last"), r, strict=True))], pa.schema([("conv_id", pa.int64()), ("seq", pa.int32()), ("piece", pa.string()), ("last", pa.bool_())])) for r in rows]
    got = [tuple(r.values()) for b in live._events(iter(batches), STEPS) for r in b.to_pylist()]
    assert got == [(1, 0, "thinking_start", ""), (1, 1, "answer", "ab"), (2, 0, "thinking_start", ""), (2, 1, "answer", "c"), (None, 0, "thinking_start", ""), (None, 1, "answer", "d")]


def test_token_source_feeds_the_stream_and_replays(spark, rocksdb, tmp_path):
    """Two batches of a file each; a third file for the restarted stream; another stream from the same offsets gives the same pieces."""
    rows = replies(9, 9)
    (tmp_path / "in").mkdir()

    def land(k):
        (tmp_path / "in" / f"{k}.jsonl").write_text("".join(json.dumps({"conv_id": c, "text": x}) + "\n" for c, x in rows[3 * k : 3 * k + 3]))

    land(0)
    land(1)
    source = lambda: token_stream(spark, str(tmp_path / "in"), 5)
    collected(spark, live_stream(source()), str(tmp_path / "c"), str(tmp_path / "out"))
    land(2)
    got = collected(spark, live_stream(source()), str(tmp_path / "c"), str(tmp_path / "out"))
    pieces = pieces_of(spark.createDataFrame(rows, "conv_id long, text string"), "conv_id", "text", 5)
    assert got == sorted(tuple(r) for r in live_batch(pieces).collect())
    again = collected(spark, source(), str(tmp_path / "c2"), str(tmp_path / "out2"))
    assert sorted(again, key=str) == sorted((tuple(r) for r in pieces.collect()), key=str)

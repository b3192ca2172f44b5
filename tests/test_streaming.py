"""Stream folding and ingest, batch against stream."""

import json
import time

from usagelake.operators.gateway import MESSAGES, RESPONSES
from usagelake.sources import exchanges
from usagelake.streaming import frames, ingest

SCHEMA = "exchange_id string, seq bigint, protocol string, payload string"


def rows():
    big = json.dumps({"type": "message_delta", "usage": {"output_tokens": 5}, "pad": "x" * (1 << 20)})

    def m(exchange, seq, **payload):
        return (exchange, seq, MESSAGES, json.dumps(payload))

    def r(exchange, seq, **payload):
        return (exchange, seq, RESPONSES, json.dumps(payload))

    return [
        m("a", 1, type="message_start", message={"id": "m1", "usage": {"input_tokens": 9, "cache_read_input_tokens": 0}}),
        m("a", 2, type="message_delta", usage={"output_tokens": 1}),
        ("a", 3, MESSAGES, "{broken"), m("a", 4, type="ping", usage={"input_tokens": 77}),
        m("a", 5, type="message_delta", usage={"output_tokens": 4, "input_tokens": None}), m("a", 6, type="message_stop"),
        ("a", 7, MESSAGES, "[DONE]"),
        m("b", 1, type="message_start", message={"usage": {"input_tokens": 2}}),
        m("c", 1, type="message_start", usage={"input_tokens": 1}), ("c", 2, MESSAGES, big),
        m("c", 3, type="message_delta", usage={"output_tokens": 3}), m("c", 4, type="message_stop"),
        r("d", 1, type="response.created", response={"id": "r1"}),
        r("d", 2, type="x", usage={"input_tokens": 5, "input_tokens_details": {"cached_tokens": 3}}),
        r("d", 3, type="x", usage={"input_tokens_details": {}}), r("d", 4, type="response.completed", usage={"total_tokens": 8}),
        r("e", 1, type="x", usage={"input_tokens": "5"}),
    ]


def facts(collected):
    return {r.exchange_id: (r.input_tokens, r.cache_read_input_tokens, r.output_tokens, r.total_tokens, r.usage_source,
                            r.response_object_id, r.terminal, r.outcome) for r in collected}


WANT = {
    "a": (9, 0, 4, None, MESSAGES, "m1", True, "upstream_ok"),
    "b": (2, None, None, None, MESSAGES, "", False, "stream_truncated"),
    "c": (1, None, None, None, MESSAGES, "", False, "stream_truncated"),
    "d": (5, None, None, 8, RESPONSES, "r1", True, "upstream_ok"),
    "e": (None, None, None, None, None, "", False, "upstream_ok"),
}


def test_fold_batch(spark):
    assert facts(frames.fold_frames(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()) == WANT


def test_names_with_escapes_are_read_and_text_says_nothing(spark):
    bare = [
        ("a", 1, MESSAGES, r'{"type":"\u006dessage_start","message":{"id":"m","usage":{"input_tokens":3}}}'),
        ("a", 2, MESSAGES, '{"type":"content_block_delta","delta":{"text":"usage"},"usage":{"output_tokens":50}}'),
        ("a", 3, MESSAGES, '{"type":"message_stop"}'),
        ("b", 1, RESPONSES, r'{"type":"x","\u0075sage":{"input_tokens":4}}'),
        ("b", 2, RESPONSES, '{"type":"response.output_text.delta","delta":"response"}'),
        ("b", 3, RESPONSES, '{"type":"response.done"}'),
        ("c", 1, "other", '{"type":"message_start","usage":{"input_tokens":4}}'),
    ]
    got = {r.exchange_id: (r.input_tokens, r.output_tokens, r.terminal) for r in frames.fold_frames(spark.createDataFrame(bare, SCHEMA)).collect()}
    assert got == {"a": (3, None, True), "b": (4, None, True), "c": (None, None, False)}


def test_fold_stream(spark, tmp_path):
    source = tmp_path / "in"
    data = rows()
    # Two files, read one per trigger: the state carries over.
    for name, part in (("1", [x for x in data if x[1] <= 2]), ("2", [x for x in data if x[1] > 2])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(source / name))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(source))
    query = (frames.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    # A query with timers never goes idle: wait for the rows, then stop it.
    latest = {}
    for _ in range(120):
        latest |= {r.exchange_id: r for r in spark.sql("select * from folded").collect()}
        if len(latest) == len(WANT) and latest["a"].terminal and latest["d"].terminal and facts(latest.values()) == WANT:
            break
        time.sleep(0.5)
    query.stop()
    assert facts(latest.values()) == WANT
    assert latest["a"].final and not latest["b"].final


def test_fold_stream_of_shuffled_events(spark, tmp_path):
    import random

    events = [("x", k, MESSAGES, json.dumps({"type": "message_delta", "usage": {"output_tokens": k}})) for k in range(25_000)]
    random.Random(1).shuffle(events)
    spark.createDataFrame(events, SCHEMA).repartition(4).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = (frames.fold_stream(stream).writeStream.format("memory").queryName("shuffled").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    got = []
    for _ in range(120):
        got = spark.sql("select * from shuffled").collect()
        if got:
            break
        time.sleep(0.5)
    query.stop()
    assert got[-1].output_tokens == 24_999


def test_late_events_do_not_reopen(spark, tmp_path):
    source = tmp_path / "in"
    first = [("x", 1, MESSAGES, json.dumps({"type": "message_delta", "usage": {"output_tokens": 1}}))]
    late = [("x", 2, MESSAGES, json.dumps({"type": "message_delta", "usage": {"output_tokens": 2}}))]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.json(str(source / "1"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).json(str(source))
    query = (frames.fold_stream(stream, 2_000).writeStream.format("memory").queryName("late").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    got = []
    for _ in range(120):
        got = spark.sql("select * from late").collect()
        if got and got[-1].final:
            break
        time.sleep(0.5)
    assert got[-1].final and got[-1].output_tokens == 1
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.json(str(source / "2"))
    time.sleep(6)
    query.stop()
    assert all(r.output_tokens == 1 for r in spark.sql("select * from late").collect())


def capture(i, profile):
    return json.dumps({"id": f"gw-{i}", "profile": profile, "protocol": MESSAGES, "startedAt": f"2026-01-01T00:00:0{i}Z",
                       "kind": "model", "outcome": "upstream_ok", "request": {"method": "POST", "endpoint": "/v1/messages"},
                       "response": {"status": 200, "providerUsage": {"inputTokens": i, "source": MESSAGES}}})


def test_ingest_append_and_purge(spark, tmp_path):
    source, table = tmp_path / "cap", str(tmp_path / "table")
    source.mkdir()
    (source / "p1.jsonl").write_text("\n".join(capture(i, "p1") for i in range(3)) + "\n")
    for _ in range(2):
        query = ingest.ingest(ingest.capture_stream(spark, str(source)), table, str(tmp_path / "ck"))
        query.awaitTermination(120)
        (source / "p2.jsonl").write_text(capture(7, "p2") + "\n")
    query = ingest.ingest(ingest.capture_stream(spark, str(source)), table, str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = spark.read.parquet(table)
    assert sorted(r.id for r in got.collect()) == ["gw-0", "gw-1", "gw-2", "gw-7"]
    out = str(tmp_path / "json")
    exchanges.append_captures(exchanges.read_captures(spark, str(source)), out)
    exchanges.append_captures(exchanges.read_captures(spark, str(source)).where("profile = 'p2'"), out)
    assert exchanges.read_captures(spark, out).count() == 5
    assert exchanges.purge_profile(spark, out, "p2") and not exchanges.purge_profile(spark, out, "p2")
    journal = tmp_path / "journal"
    journal.mkdir()
    (journal / "p3.jsonl").write_text("{}")
    assert exchanges.purge_profile(spark, out, "p3", str(journal)) and not (journal / "p3.jsonl").exists()
    assert not exchanges.purge_profile(spark, out, "p3", str(journal))
    left = exchanges.in_start_order(exchanges.read_captures(spark, out), newest_first=True)
    assert [r.id for r in left.collect()] == ["gw-2", "gw-1", "gw-0"]
    flat = exchanges.flatten(left).collect()
    assert {(r.input_tokens, r.usage_source) for r in flat} == {(0, MESSAGES), (1, MESSAGES), (2, MESSAGES)}


def test_replayed_batch_adds_nothing(spark, tmp_path):
    """A run that dies between the write and its commit writes the same batch again."""
    source, table, state = tmp_path / "cap", str(tmp_path / "table"), tmp_path / "ck"
    source.mkdir()

    def run():
        ingest.ingest(ingest.capture_stream(spark, str(source)), table, str(state)).awaitTermination(120)

    (source / "a.jsonl").write_text("\n".join([capture(0, "p1"), capture(1, "p2")]) + "\n")
    run()
    (source / "b.jsonl").write_text(capture(2, "p1") + "\n")
    run()
    want = sorted(r.id for r in spark.read.parquet(table).collect())
    assert want == ["gw-0", "gw-1", "gw-2"]
    last = max((p for p in (state / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    for crc in (state / "commits").glob(".*.crc"):
        if crc.name == f".{last.name}.crc":
            crc.unlink()
    run()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == want


def test_bad_capture_lines(spark, tmp_path):
    import pytest

    (tmp_path / "x.jsonl").write_text(capture(1, "p") + "\nnot json\n")
    with pytest.raises(Exception):
        exchanges.read_captures(spark, str(tmp_path)).collect()
    loose = exchanges.read_captures(spark, str(tmp_path), strict=False).cache()
    assert loose.where("_bad IS NULL").count() == 1
    for name in ("", "a/b", "..", "a\\b"):
        with pytest.raises(ValueError):
            exchanges.check_profile(name)

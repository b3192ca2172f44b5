"""Transcript readers on hand-written files."""

import json
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from usagelake.functions.text import content_hash  # noqa: F401
from usagelake.operators import context, rules
from usagelake.sources import claude, codex, jsonl, rawjson


def counts(total, inp, cached=0, out=0, reasoning=None):
    usage = {"input_tokens": inp, "cached_input_tokens": cached, "output_tokens": out, "total_tokens": total}
    if reasoning is not None:
        usage["reasoning_output_tokens"] = reasoning
    return {"type": "event_msg", "timestamp": "2026-01-01T00:00:09Z",
            "payload": {"type": "token_count", "info": {"total_token_usage": usage}}}


def item(**payload):
    return {"type": "response_item", "timestamp": "2026-01-01T00:00:05Z", "payload": payload}


CODEX = [
    {"type": "session_meta", "timestamp": "2026-01-01T00:00:01Z", "payload": {"id": "sess-1"}},
    {"type": "turn_context", "payload": {"model": "m-old"}},
    item(type="message", role="developer", content="rules!"),
    {"type": "event_msg", "payload": {"type": "user_message", "message": "héllo wörld"}},
    "",
    item(type="function_call", id="i1", call_id="c1", name="exec_command",
         arguments='{"cmd": "cat src//a.py -n x=1 \'q/q\' b.txt"}'),
    item(type="function_call_output", call_id="c1", output="out text"),
    counts(100, 80, 10, 20, 5),
    "{broken",
    item(type="custom_tool_call", call_id="c2", name="apply", input="free  text"),
    '{"type":"response_item","payload":{"type":"custom_tool_call_output","call_id":"c2","output":[ {"type":"x","text":"ab"}, {"text":"","content":[{"text":"cd"}]} ]}}',
    counts(150, 110, 20, 40, 9),
    item(type="message", role="assistant", content=[{"type": "t", "text": "one "}, {"type": "t", "text": "two"}]),
    counts(120, 90, 5, 30),
    {"type": "turn_context", "payload": {"model": "m-new"}},
    item(type="message", role="assistant", id="tail", content="bye"),
    {"type": "response_item", "payload": {"type": "message", "role": 5}},
    {"type": "other", "payload": 3},
]


def test_lines_are_numbered_across_splits(spark, write_lines):
    root = write_lines("a/one.jsonl", [f'{{"n":{i}}}' if i % 3 else "" for i in range(1, 2001)])
    write_lines("a/b/two.jsonl", ['{"n":1}', '{"n":2}'], newline="\r\n")
    write_lines("a/skip.txt", ["x"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = jsonl.read_lines(spark, root, max_bytes=9).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    one = sorted((r.line, r.raw, r.oversized) for r in rows if r.file.endswith("one.jsonl"))
    assert [r[0] for r in one] == list(range(1, 2001))
    assert all((raw == (f'{{"n":{n}}}' if n % 3 else "")) for n, raw, big in one if not big)
    assert {n for n, _, big in one if big} == {n for n in range(1, 2001) if n % 3 and len(f'{{"n":{n}}}') > 9}
    two = sorted((r.line, r.raw) for r in rows if r.file.endswith("two.jsonl"))
    assert two == [(1, '{"n":1}'), (2, '{"n":2}')]


def test_newest_files(spark, write_lines):
    import os

    root = write_lines("old one.jsonl", ["{}"])
    write_lines("deep/er/new é.jsonl", ["{}", "", "[1]"])
    write_lines("deep/tie.jsonl", ["{}"])
    write_lines("skip.txt", ["x"])
    for name, at in (("old one.jsonl", 1), ("deep/er/new é.jsonl", 9), ("deep/tie.jsonl", 9)):
        os.utime(f"{root}/{name}", (at, at))
    listed = jsonl.list_files(spark, root)
    assert sorted((r.mtime_us, r.bytes) for r in listed.collect()) == [(1_000_000, 3), (9_000_000, 3), (9_000_000, 8)]
    assert [r.mtime_us for r in jsonl.newest_files(listed, 2).collect()] == [9_000_000] * 2
    everything = jsonl.read_lines(spark, root)
    assert {r.file for r in everything.collect()} == {r.file for r in listed.collect()}
    lines = jsonl.read_lines(spark, root, newest=1)
    assert sorted((r.line, r.raw) for r in lines.collect()) == [(1, "{}"), (2, ""), (3, "[1]")]
    assert jsonl.read_lines(spark, root, newest=0).collect() == []
    assert jsonl.read_lines(spark, root, newest=9).count() == 5


def test_files_that_are_not_chosen_are_not_opened(spark, write_lines):
    import os

    root = write_lines("small.jsonl", ["{}"])
    with open(f"{root}/huge.jsonl", "wb") as f:
        f.truncate(3 << 30)  # one record that no string can hold
    os.utime(f"{root}/huge.jsonl", (1, 1))
    try:
        listed = {r.file.split("/")[-1]: r.bytes for r in jsonl.list_files(spark, root).collect()}
        assert listed == {"small.jsonl": 3, "huge.jsonl": 3 << 30}
        assert [r.raw for r in jsonl.read_lines(spark, root, newest=1).collect()] == ["{}"]
    finally:
        os.remove(f"{root}/huge.jsonl")


def test_codex_session(spark, write_lines):
    root = write_lines("codex/roll.jsonl", CODEX)
    got = codex.read(jsonl.read_lines(spark, root))
    (session,) = got.sessions.collect()
    assert (session.session_id, session.model, session.total, session.input, session.reasoning) == (
        "sess-1", "m-new", 150, 110, 9)
    assert session.started_us == 1767225601000000 and session.updated_us == 1767225605000000 or session.updated_us
    turns = {r.sequence: r for r in got.turns.collect()}
    assert [turns[i].total for i in (1, 2, 3)] == [100, 50, None]
    assert (turns[2].input, turns[2].cached, turns[2].output, turns[2].reasoning) == (30, 10, 20, 4)
    assert turns[3].reset and turns[1].turn_id == "sess-1#1"
    parts = sorted(got.components.collect(), key=lambda r: r.ord)
    assert [(r.kind, r.record, r.turn_sequence, r.tokens) for r in parts] == [
        ("instructions", "codex_rollout#line:3", 1, 2),
        ("user_prompt", "codex_rollout#line:4", 1, 3),
        ("file", "i1#file:1", 1, None),
        ("file", "i1#file:2", 1, None),
        ("tool_result", "c1", 1, 2),
        ("unknown", "codex_rollout#line:9", 2, None),
        ("tool_result", "c2", 2, 1),
        ("history", "codex_rollout#line:13", 3, 2),
        ("history", "tail", None, 1),
        ("unknown", "codex_rollout#line:17", None, None),
    ]
    by_record = {r.record: r for r in parts}
    assert [by_record[f"i1#file:{i}"].path for i in (1, 2)] == ["src/a.py", "b.txt"]
    assert by_record["c1"].tool_name == "exec_command" and by_record["c1"].content_bytes == 8
    assert by_record["c1"].tool_call_fingerprint.startswith("v1:")
    raw = '[ {"type":"x","text":"ab"}, {"text":"","content":[{"text":"cd"}]} ]'
    assert by_record["c2"].content_bytes == len(raw)
    assert by_record["c2"].tool_call_fingerprint.startswith("v1-text:")
    assert by_record["codex_rollout#line:9"].completeness == "unavailable"


def test_codex_repeated_call_is_found(spark, write_lines):
    def call(n, text):
        return [item(type="custom_tool_call", call_id=f"c{n}", name="run", input=text),
                item(type="custom_tool_call_output", call_id=f"c{n}", output="same result"), counts(n * 10, n * 10)]

    root = write_lines("r/same.jsonl", call(1, "ls a") + call(2, "ls a"))
    write_lines("r/other.jsonl", call(1, "ls a") + call(2, "ls  a"))
    got = codex.read(jsonl.read_lines(spark, root))
    found = rules.findings(got.components, ["file"]).collect()
    assert [(r.file.split("/")[-1], r.rule_id, r.occurrences, r.estimated_tokens) for r in found] == [
        ("same.jsonl", "TOOL002", 2, 3)]
    assert {r.content_hash for r in context.redact(got.components).collect()} == {""}


def test_codex_without_usage_keeps_context(spark, write_lines):
    root = write_lines("n/none.jsonl", [item(type="function_call_output", call_id="z", output="x" * 9),
                                        "[1]", '{"type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"total_tokens":5.0}}}}',
                                        '{"type":"event_msg"} trailing'])
    got = codex.read(jsonl.read_lines(spark, root))
    (session,) = got.sessions.collect()
    assert session.total is None and session.session_id == "none"
    assert got.turns.count() == 0
    assert sorted((r.kind, r.turn_sequence) for r in got.components.collect()) == [
        ("tool_result", None), ("unknown", None), ("unknown", None), ("unknown", None)]


def said(uuid, role, content, **extra):
    message = {"role": role, "content": content, **extra}
    return {"type": role, "uuid": uuid, "timestamp": f"2026-02-01T00:00:0{len(uuid)}Z", "message": message}


USAGE = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}


def test_claude_session(spark, write_lines):
    root = write_lines("claude/s1.jsonl", [
        said("u1", "user", "please read"),
        said("a1", "assistant", [{"type": "text", "text": "ok"},
                                 {"type": "tool_use", "id": "t1", "name": "Read", "input": {"p": 1.0, "a": [1, 2]}}],
             id="m1", model="real", usage=USAGE),
        said("u2", "user", [{"type": "tool_result", "tool_use_id": "t1", "content": "file text"},
                            {"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "x"}]}]),
        said("a2", "assistant", "dup", id="m1", model="real", usage=USAGE),
        said("s1", "assistant", "fake", id="m9", model="<synthetic>", usage=USAGE),
        said("a3", "assistant", "second", id="m2", model="real", usage={"input_tokens": 7, "output_tokens": 1}),
        "nonsense",
        said("u3", "user", "again"),
        said("a4", "assistant", "third", id="m2", model="real", usage={"input_tokens": 8, "output_tokens": 1}),
    ])
    write_lines("claude/empty.jsonl", [said("u1", "user", "hi"), said("a1", "assistant", "no usage", model="real")])
    got = claude.read(jsonl.read_lines(spark, root))
    (session,) = got.sessions.collect()
    assert (session.session_id, session.model, session.accepted, session.conflicts) == ("s1", "real", 1, 1)
    assert (session.input, session.cached, session.output, session.total) == (10, 5, 5, 20)
    turns = {r.sequence: r for r in got.turns.collect()}
    assert (turns[1].turn_id, turns[1].total, turns[1].billable_input) == ("m1", 20, 15)
    assert (turns[2].turn_id, turns[2].input, turns[2].input_kind, turns[2].conflict) == ("m2", None, "unknown", True)
    parts = sorted(got.components.collect(), key=lambda r: r.ord)
    assert [(r.kind, r.record, r.turn_sequence) for r in parts] == [
        ("user_prompt", "u1", 1),
        ("history", "a1", 2),
        ("tool_result", "u2#tool_result:1", 2),
        ("tool_result", "u2#tool_result:2", 2),
        ("history", "a3", None),
        ("unknown", "claude_session#line:7", None),
        ("user_prompt", "u3", None),
    ]
    results = [r for r in parts if r.kind == "tool_result"]
    assert {r.tool_name for r in results} == {"Read"} and len({r.tool_call_fingerprint for r in results}) == 1
    assert [r.content_bytes for r in results] == [9, len('[{"type": "text", "text": "x"}]')]


def test_claude_records_without_ids(spark, write_lines):
    root = write_lines("c/x.jsonl", [
        {"type": "user", "message": {"role": "user", "content": "a"}},
        {"type": "assistant", "message": {"role": "assistant", "content": "b", "usage": USAGE}},
        {"type": "user", "message": {"role": "user", "content": "c"}},
        {"type": "assistant", "message": {"role": "assistant", "content": "d", "usage": USAGE}},
    ])
    got = claude.read(jsonl.read_lines(spark, root))
    assert [(r.sequence, r.turn_id) for r in sorted(got.turns.collect(), key=lambda r: r.sequence)] == [
        (1, "x#1"), (2, "x#2")]
    assert [(r.kind, r.record, r.turn_sequence) for r in sorted(got.components.collect(), key=lambda r: r.ord)] == [
        ("user_prompt", "claude_session#record:1", 1),
        ("history", "claude_session#record:3", 2),
        ("user_prompt", "claude_session#record:5", 2),
        ("history", "claude_session#record:7", None),
    ]


def test_fingerprints():
    same = rawjson.fingerprint_of("run", '{"b": [1, 2], "a": "x"}')
    assert same == rawjson.fingerprint_of(" run ", '{ "a":"x","b":[1,2] }')
    assert same != rawjson.fingerprint_of("run", '{"a":"x","b":[2,1]}')
    assert same != rawjson.fingerprint_of("Run", '{"a":"x","b":[1,2]}')
    assert rawjson.fingerprint_of("f", "1") != rawjson.fingerprint_of("f", "1.0")
    assert rawjson.fingerprint_of("f", '"1"') != rawjson.fingerprint_of("f", "1")
    for bad in ("", "{", "{} {}", "null", "NaN", "[1,]"):
        assert rawjson.fingerprint_of("f", bad) is None
    assert rawjson.fingerprint_of("  ", "{}") is None


def test_raw_members():
    record = '{"a": {"b":[ {"x" : 1.50}, null ]}, "s":"q\\"}", "a2":3, "a": {"b": [7]}}'
    assert rawjson.member_text(record, ("a", "b")) == "[7]"
    assert rawjson.member_text(record, ("s",)) == '"q\\"}"'
    assert rawjson.member_text(record, ("missing", "b")) is None
    assert rawjson.text_of('[{"text":"a"},{"text":"","content":[{"text":"b","content":"no"}]},{"content":"c"}]') == "abc"
    assert rawjson.text_of('[{"text":1}]') == "" and rawjson.text_of("5") == ""


def test_raw_members_are_read_by_portions():
    """A batch of 24 MB is never held as Python objects: what is held at a time is a few portions."""
    texts = [f"{i} " + "x" * 6000 for i in range(4000)]
    raw = pa.array([json.dumps({"output": [{"text": t}]}) for t in texts])
    rows = 0
    tracemalloc.start()
    for part in rawjson.member_facts.func(iter([(raw, pa.array(["output"] * len(raw)))])):
        assert part.field("said").to_pylist() == texts[rows : rows + len(part)]
        rows += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 8 * rawjson.PORTION


def test_portions_keep_rows_in_place(spark):
    """Null, empty and overlong records among short ones, many portions in one batch."""
    sizes = [None, 0, 3, 5 << 20, 1, 900_000, 900_000, None, 2 << 20] + [40_000] * 80
    rows = [(i, None if n is None else json.dumps({"a": "é" * n if i % 2 else [{"text": "x" * n}]})) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "i int, raw string").coalesce(1)
    got = df.select("i", rawjson.member_facts("raw", F.lit("a")).alias("f")).select("i", F.length("f.said"), "f.size").collect()
    want = [(i, n, n if n is None else 2 * n if i % 2 else n + len('[{"text": ""}]')) for i, n in enumerate(sizes)]
    assert sorted(map(tuple, got)) == want


def reply(ident, model="real", **usage):
    return said(f"u{ident}", "assistant", "r", id=ident, model=model, usage=usage or None)


FULL = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}
# File, records, and what the session shows: input, cached, output, total, model, turns; None for a dropped session.
CLAUDE_CASES = {
    "basic": ([reply("a", **FULL)], (10, 5, 5, 20, "real", 1)),
    "zero": ([reply("a", **dict.fromkeys(FULL, 0))], (0, 0, 0, 0, "real", 1)),
    "input_only": ([reply("a", input_tokens=4)], (4, None, None, None, "real", 1)),
    "partial": ([reply("a", **FULL), reply("b", input_tokens=1)], (11, None, None, None, "real", 2)),
    "negative": ([reply("a", **FULL), reply("b", **{**FULL, "input_tokens": -1})], (None, 10, 10, None, "real", 2)),
    "all_negative": ([reply("a", **dict.fromkeys(FULL, -1))], None),
    "empty_usage": ([said("u", "assistant", "x", id="a", model="real", usage={})], None),
    "no_usage": ([said("u", "user", "x"), "{bad"], None),
    "duplicate": ([reply("a", **FULL), reply("a", **FULL)], (10, 5, 5, 20, "real", 1)),
    "same_totals": ([reply("a", **FULL), reply("b", **FULL)], (20, 10, 10, 40, "real", 2)),
    "conflict": ([reply("a", **FULL), reply("a", **{**FULL, "output_tokens": 6})], None),
    "conflict_mixed": ([reply("a", **FULL), reply("a", **{**FULL, "output_tokens": 6}), reply("b", **FULL)],
                       (10, 5, 5, 20, "real", 2)),
    "two_models": ([reply("a", **FULL), reply("b", model="other", **FULL)], (20, 10, 10, 40, "", 2)),
    "synthetic_only": ([reply("a", model="<synthetic>", **FULL)], None),
    "synthetic_first": ([reply("a", model="<synthetic>", **FULL), reply("b", **FULL)], (10, 5, 5, 20, "real", 1)),
    "synthetic_last": ([reply("b", **FULL), reply("c", model="<synthetic>", **FULL)], (10, 5, 5, 20, "real", 1)),
    "no_model": ([reply("a", model="", **FULL)], (10, 5, 5, 20, "", 1)),
    "empty": ([""], None),
}


def test_claude_cases(spark, write_lines):
    for name, (records, _) in CLAUDE_CASES.items():
        root = write_lines(f"cases/{name}.jsonl", records)
    got = claude.read(jsonl.read_lines(spark, root))
    turns = {r.session_id: r["count"] for r in got.turns.groupBy("session_id").count().collect()}
    seen = {r.session_id: (r.input, r.cached, r.output, r.total, r.model, turns.get(r.session_id))
            for r in got.sessions.collect()}
    assert seen == {name: want for name, (_, want) in CLAUDE_CASES.items() if want}

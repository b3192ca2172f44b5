"""Small helpers for what JSON functions cannot say: the raw text of a member.

Sizes of non-text outputs and fingerprints of arguments depend on the text as it
was written (number literals, spacing), which every JSON reader normalises away.
These run as Arrow batches and only on rows that hold such a value; callers pass
NULL for the others.  A batch may hold 10,000 long records, so it stays in Arrow
and becomes Python objects a portion at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# The helpers travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BLANK = " \t\n\r"
#: Bytes of text that Python holds as objects at a time; a longer record is taken alone.
PORTION = 1 << 20


class _Literal(str):
    """A number kept as the text it was written as."""


class _Decoder:
    """A JSON decoder that keeps numbers as text; built where it is used, so it can be shipped."""

    def __init__(self, strict: bool) -> None:
        self.strict = strict
        self.inner = None

    def __getstate__(self) -> dict:
        return {"strict": self.strict, "inner": None}

    def get(self) -> json.JSONDecoder:
        if self.inner is None:
            constant = _fail if self.strict else None
            self.inner = json.JSONDecoder(parse_float=_Literal, parse_int=_Literal, parse_constant=constant)
        return self.inner


_NUMBERS = _Decoder(strict=True)
_SPANS = _Decoder(strict=False)


def _fail(name: str):
    raise ValueError(name)


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANK:
        at += 1
    return at


def members(text: str, at: int = 0) -> Iterator[tuple[str | int, int, int]]:
    """Key (or index) and span of each member of the object or array at ``at``."""
    at = _skip(text, at)
    is_object = text[at] == "{"
    if not is_object and text[at] != "[":
        return
    close = "}" if is_object else "]"
    at = _skip(text, at + 1)
    index = 0
    while text[at] != close:
        key: str | int = index
        if is_object:
            key, at = scanstring(text, at + 1, False)
            at = _skip(text, _skip(text, at) + 1)
        _, end = _SPANS.get().raw_decode(text, at)
        yield key, at, end
        index += 1
        at = _skip(text, end)
        if text[at] == ",":
            at = _skip(text, at + 1)


def member_text(text: str | None, path: tuple[str | int, ...]) -> str | None:
    """Raw text of the member at ``path``; the last of repeated keys."""
    if text is None:
        return None
    start, end = 0, len(text)
    try:
        for step in path:
            found = None
            for key, a, b in members(text, start):
                if key == step:
                    found = (a, b)
            if found is None:
                return None
            start, end = found
    except (ValueError, IndexError):
        return None
    return text[start:end]


def tool_blocks_of(text: str | None, path: tuple[str, ...]) -> list[dict] | None:
    """Facts of the tool blocks in the array at ``path``: text, size, fingerprint."""
    array = member_text(text, path)
    if array is None or not array.startswith("["):
        return None
    rows = []
    try:
        for index, a, b in members(array):
            block = array[a:b]
            kind = json.loads(member_text(block, ("type",)) or "null") if block.startswith("{") else None
            row = {"i": index, "said": None, "size": None, "fingerprint": None}
            if kind == "tool_result":
                content = member_text(block, ("content",))
                row |= {"said": text_of(content), "size": size_of(content)}
            elif kind == "tool_use":
                name = json.loads(member_text(block, ("name",)) or "null")
                row["fingerprint"] = fingerprint_of(name, arguments_of(member_text(block, ("input",))))
            rows.append(row)
    except (ValueError, IndexError):
        return None
    return rows


def size_of(text: str | None) -> int | None:
    """Bytes of an output: of the decoded string, else of the JSON as written."""
    if text is None or text == "null":
        return None
    if text.startswith('"'):
        text = json.loads(text)
    return len(text.encode("utf-8", "surrogatepass"))


def arguments_of(text: str | None) -> str | None:
    """Argument text of a call; arguments wrapped in a JSON string are unwrapped once."""
    text = (text or "").strip(_BLANK)
    if text in ("", "null"):
        return None
    if text.startswith('"'):
        try:
            return json.loads(text)
        except ValueError:
            return text
    return text


def canonical(text: str | None) -> str | None:
    """Arguments with sorted keys and numbers as written; NULL if not one JSON value."""
    if text is None:
        return None
    try:
        value = _NUMBERS.get().decode(text)
    except (ValueError, RecursionError):
        return None
    return None if value is None else _dump(value)


def _dump(value) -> str:
    if isinstance(value, _Literal):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_dump(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_dump(v) for v in value) + "]"
    return json.dumps(value)


def fingerprint_of(name: str | None, arguments: str | None) -> str | None:
    """Digest of a tool name and its structured arguments; NULL when there is none."""
    name = (name or "").strip()
    body = canonical(arguments)
    if not name or body is None:
        return None
    payload = json.dumps({"version": 1, "name": name, "arguments": body}, sort_keys=True)
    return "v1:" + hashlib.sha256(payload.encode("utf-8", "surrogatepass")).hexdigest()


def text_of(text: str | None) -> str:
    """Text of a tool output: a string, or the texts of its blocks, however deep."""
    if text is None:
        return ""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return ""
    return _text(value)


def _text(value) -> str:
    if isinstance(value, str):
        return value
    if not isinstance(value, list) or not all(b is None or isinstance(b, dict) for b in value):
        return ""
    if any(not isinstance(b.get("text"), (str, type(None))) for b in value if b):
        return ""
    return "".join(b.get("text") or _text(b.get("content")) for b in value if b)


def portions(columns: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each portion of a batch."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy().astype(np.int64) for c in columns))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PORTION, side="right")))
        yield at, end - at
        at = end


def by_portion(answer: Callable, kind: T.DataType):
    """A column function that gives ``answer`` of the texts of each row."""
    made = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for at, n in portions(columns):
                rows = zip(*(c.slice(at, n).to_pylist() for c in columns))
                yield pa.array([answer(*row) for row in rows], made)

    return run


structured_fingerprint = by_portion(lambda name, arguments: fingerprint_of(name, arguments_of(arguments)), T.StringType())


def member_facts_of(record: str | None, path: str) -> tuple:
    found = None if record is None else member_text(record, tuple(path.split(".")))
    return (None, None, None) if found is None else (text_of(found), size_of(found), found)


_OUTPUT = T.StructType([
    T.StructField("said", T.StringType()), T.StructField("size", T.LongType()), T.StructField("text", T.StringType())])

#: Text, size and raw form of the member a dotted path names.
member_facts = by_portion(member_facts_of, _OUTPUT)

_BLOCKS = T.ArrayType(T.StructType([
    T.StructField("i", T.IntegerType()), T.StructField("said", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("fingerprint", T.StringType())]))


def content_facts(path: str):
    """A function from a record's text, twice, to the facts of its tool blocks and of the whole member.

    Both in one: each function of a plan has Python workers of its own.
    """
    steps = tuple(path.split("."))
    return by_portion(
        lambda tools, deep: (tool_blocks_of(tools, steps), member_facts_of(deep, path)),
        T.StructType([T.StructField("tools", _BLOCKS), T.StructField("deep", _OUTPUT)]))


def freeform_fingerprint(name: Column, text: Column) -> Column:
    """Digest of a tool name and freeform input, byte for byte; its own domain."""
    trimmed = F.trim(name, F.lit(" \t\n\v\f\r"))
    body = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("freeform").alias("format"), trimmed.alias("name"),
                              text.alias("input")))
    return F.when((F.length(trimmed) > 0) & (F.length(text) > 0), F.concat(F.lit("v1-text:"), F.sha2(body, 256)))


# Blanks outside strings, and characters the reference form writes as escapes.
_SPACE = re.compile(r'"(?:\\.|[^"\\])*"|[ \t\n\r]+')
_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"}


def compact(text: str | None) -> str | None:
    """JSON as written, without blanks between its parts."""
    if text is None:
        return None
    bare = _SPACE.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    for char, escape in _ESCAPES.items():
        bare = bare.replace(char, escape)
    return bare


def content_text(value) -> str:
    """Text of request content: a string, a block, or a list of either, however deep."""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        said = value.get("text")
        if not isinstance(said, (str, type(None))):
            return ""
        return said or content_text(value.get("content"))
    if isinstance(value, list):
        return "".join(content_text(v) for v in value)
    return ""


def request_blocks_of(body: str | None) -> list | None:
    """Per message and block of a request: deep text, size, and written form."""
    messages = member_text(body, ("messages",))
    if messages is None or not messages.startswith("["):
        return None
    rows = []
    for _, a, b in members(messages):
        content = member_text(messages[a:b], ("content",)) if messages[a] == "{" else None
        facts = []
        if content is not None and content.startswith("["):
            for _, c, d in members(content):
                block = content[c:d]
                inner = member_text(block, ("content",)) if block.startswith("{") else None
                said = content_text(json.loads(inner)) if inner is not None else ""
                facts.append({"said": said, "size": size_of(inner), "written": compact(block)})
        rows.append(facts)
    return rows


def request_facts_of(body: str | None) -> tuple:
    if body is None:
        return (None, None, None, None)
    try:
        system = member_text(body, ("system",))
        tools = member_text(body, ("tools",))
        items = member_text(body, ("input",))
        outputs = None
        if items is not None and items.startswith("["):
            outputs = []
            for _, a, b in members(items):
                raw = member_text(items[a:b], ("output",)) if items[a] == "{" else None
                outputs.append({"said": text_of(raw), "size": size_of(raw)})
        return (request_blocks_of(body), outputs, content_text(json.loads(system)) if system else None, compact(tools))
    except (ValueError, IndexError, RecursionError):
        return (None, None, None, None)


#: What a request body holds below its named fields; the rest is read in SQL.
request_facts = by_portion(request_facts_of, T.StructType([
    T.StructField("blocks", T.ArrayType(T.ArrayType(T.StructType([
        T.StructField("said", T.StringType()), T.StructField("size", T.LongType()), T.StructField("written", T.StringType())])))),
    T.StructField("outputs", T.ArrayType(T.StructType([
        T.StructField("said", T.StringType()), T.StructField("size", T.LongType())]))),
    T.StructField("system", T.StringType()),
    T.StructField("tools", T.StringType())]))

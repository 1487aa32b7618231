"""JSON Schema rules: documents of snapshots and values of workflows, checked keyword by keyword; references to artifacts inside documents.

The documents' rules are applied to raw lines inside Spark (`diagnostics`, `references`): rows of (code, path) and of references, one Arrow batch
at a time. Of objects with repeated keys the last counts, as everywhere in the readers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- keywords ----------------------------------------------------------------------------------

Problem = tuple[str, str]


def number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


IS = {
    "null": lambda v: v is None,
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: number(v) and float(v).is_integer(),
    "number": number,
    "string": lambda v: isinstance(v, str),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def frozen(v):
    """Equal for equal JSON values, and hashable: 1 and 1.0 are equal, 1 and true aren't."""
    if isinstance(v, dict):
        return "object", frozenset((k, frozen(x)) for k, x in v.items())
    if isinstance(v, list):
        return "array", tuple(map(frozen, v))
    return type(v).__name__ if isinstance(v, (bool, str)) or v is None else "number", v


def is_time(v: str) -> bool:
    """UTC with a trailing Z and any number of digits of a second."""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z", v):
        return False
    try:
        datetime.strptime(v[:19], "%Y-%m-%dT%H:%M:%S")
    except ValueError:
        return False
    return True


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


#: keyword -> (type it speaks about, whether a value breaks the keyword's argument)
BOUNDS = {
    "minLength": ("string", lambda v, a: len(v) < a),
    "maxLength": ("string", lambda v, a: len(v) > a),
    "pattern": ("string", lambda v, a: not re.search(a, v)),
    "format": ("string", lambda v, a: a == "date-time" and not is_time(v)),
    "minimum": ("number", lambda v, a: v < a),
    "maximum": ("number", lambda v, a: v > a),
    "exclusiveMinimum": ("number", lambda v, a: v <= a),
    "exclusiveMaximum": ("number", lambda v, a: v >= a),
    "multipleOf": ("number", lambda v, a: v % a != 0),
    "minItems": ("array", lambda v, a: len(v) < a),
    "maxItems": ("array", lambda v, a: len(v) > a),
    "uniqueItems": ("array", lambda v, a: a and len(set(map(frozen, v))) < len(v)),
    "minProperties": ("object", lambda v, a: len(v) < a),
    "maxProperties": ("object", lambda v, a: len(v) > a),
    "enum": (None, lambda v, a: frozen(v) not in set(map(frozen, a))),
    "const": (None, lambda v, a: frozen(v) != frozen(a)),
}


def _inside(schema: dict, value, at: str, root) -> Iterator[Problem]:
    """Problems of an array's items and an object's members."""
    if isinstance(value, list):
        first = schema.get("prefixItems", [])
        for k, v in enumerate(value):
            yield from problems(first[k] if k < len(first) else schema.get("items", True), v, f"{at}/{k}", root)
    if isinstance(value, dict):
        for key in schema.get("required", ()):
            if key not in value:
                yield "required", f"{at}/{escaped(key)}"
        own, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        for key, v in value.items():
            if key in own:
                yield from problems(own[key], v, f"{at}/{escaped(key)}", root)
            elif others is False:
                yield "additionalProperties", at
            else:
                yield from problems(others, v, f"{at}/{escaped(key)}", root)


def _combined(schema: dict, value, at: str, root) -> Iterator[Problem]:
    """Problems of keywords that hold schemas for the same value."""
    for s in schema.get("allOf", ()):
        yield from problems(s, value, at, root)
    for word, good in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if word in schema:
            each = [list(problems(s, value, at, root)) for s in schema[word]]
            if not good(sum(not e for e in each)):
                yield from (p for e in each for p in e)
                yield word, at
    if "not" in schema and not any(problems(schema["not"], value, at, root)):
        yield "not", at
    if "if" in schema:
        branch = "else" if any(problems(schema["if"], value, at, root)) else "then"
        bad = list(problems(schema.get(branch, True), value, at, root))
        yield from bad
        if bad:
            yield "if", at


def problems(schema: dict | bool, value, at: str = "", root: dict | bool | None = None) -> Iterator[Problem]:
    """(keyword, JSON pointer) of each rule that the value breaks; all of them, not the first alone. A missing member is named by its own pointer."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        if not schema:
            yield "false schema", at
        return
    if "$ref" in schema:
        target = root
        for step in schema["$ref"].removeprefix("#").split("/")[1:]:
            target = target[step.replace("~1", "/").replace("~0", "~")]
        yield from problems(target, value, at, root)
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any(IS[t](value) for t in types):
        yield "type", at
    for word, (kind, breaks) in BOUNDS.items():
        if word in schema and (kind is None or IS[kind](value)) and breaks(value, schema[word]):
            yield word, at
    yield from _inside(schema, value, at, root)
    yield from _combined(schema, value, at, root)


def accepts(schema: dict | bool | None, value) -> bool:
    return schema is None or not any(problems(schema, value))


# --- documents ---------------------------------------------------------------------------------


def text(**more) -> dict:
    return {"type": "string", **(more or {"minLength": 1})}


def ident(prefix: str) -> dict:
    return text(pattern=f"^{prefix}_[0-9a-f]{{8}}-[0-9a-f]{{4}}-4[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$")


def whole(least: int) -> dict:
    return {"type": "integer", "minimum": least}


def one_of(*values) -> dict:
    return {"enum": list(values)}


def items(of: dict | bool, **more) -> dict:
    return {"type": "array", "items": of, **more}


def record(required: str, **properties) -> dict:
    return {"type": "object", "required": required.split(), "properties": properties}


def when(**conditions) -> dict:
    return {"properties": {k: {"const": v} for k, v in conditions.items()}, "required": list(conditions)}


# Versions, names, shapes and enumerations of the snapshot format.
VERSIONS = ("0.1.0", "0.2.0")
LIMITATIONS = (
    "recording_failed", "drain_timed_out", "unpaired_call", "payload_omitted", "payload_truncated", "stream_not_consumed", "stream_ended_early",
    "missing_root", "missing_parent", "sampled_or_dropped", "unsupported_semantics", "invalid_source_data", "unknown_side_effect", "final_state_unavailable",
)
VERSION, TIME, SHA256 = one_of(*VERSIONS), text(format="date-time"), text(pattern="^[a-f0-9]{64}$")
RUN, EVENT_ID, CHECKPOINT_ID, DIGITS = ident("run"), ident("evt"), ident("cp"), text(pattern="^[0-9]+$")
REFERENCE = record("schema_version digest media_type byte_length", schema_version=VERSION, digest=SHA256, media_type=text(), byte_length=whole(0), preview={"type": "string"})
RUNTIME = record("name version", name=text(), version=text(), adapter=text())
ERROR = record("code message retryable", code=text(), message=text(), retryable={"type": "boolean"}, kind=one_of("model", "tool", "validation", "policy", "runtime", "unknown"))
LIMITATION = {**record("code message", code=one_of(*LIMITATIONS), message=text()), "additionalProperties": False}
REDACTION = record("category path strategy", category=text(), path=text(), strategy=one_of("mask", "reference", "remove", "custom"))
SECURITY = record("side_effect redactions", side_effect=one_of("read_only", "workspace_write", "external_write", "destructive"), redactions=items(REDACTION))
FAILED = record("correlation_key error attempt", correlation_key=text(), error=ERROR, attempt=whole(1))
COMPLETED = record("correlation_key output", correlation_key=text())
SPAN_TEXTS = {k: {"type": "string"} for k in ("kind", "status_message")} | {k: {"type": "object"} for k in ("resource", "scope", "attributes")}
PAYLOADS = {
    "run.started": record("runtime", runtime=RUNTIME),
    "run.completed": record("final_state_hash", final_state_hash=SHA256),
    "run.failed": record("error", error=ERROR),
    "run.observed": record("outcome", outcome=one_of("completed", "failed", "unknown"), summary={"type": "string"}),
    "model.requested": record("correlation_key model input", correlation_key=text(), model=text()),
    "model.completed": COMPLETED,
    "model.failed": FAILED,
    "tool.requested": record("correlation_key tool arguments", correlation_key=text(), tool=text()),
    "tool.completed": COMPLETED,
    "tool.failed": FAILED,
    "decision.recorded": record("decision basis_summary success_conditions", decision=text(), basis_summary=text(), success_conditions=items(text(), minItems=1)),
    "state.changed": record("path operation", path=text(), operation=one_of("set", "merge", "delete", "append")),
    "checkpoint.created": record("checkpoint_id last_event_id sequence state_hash", checkpoint_id=CHECKPOINT_ID, last_event_id=EVENT_ID, sequence=whole(1), state_hash=SHA256),
    "verification.completed": record("verifier result", verifier=text(), result=one_of("passed", "failed"), diagnostics=items({"type": "string"})),
    "otel.span": record(
        "trace_id span_id name status", trace_id=text(), span_id=text(), name=text(), status=one_of("ok", "error", "unset"), start_time_unix_nano=DIGITS, end_time_unix_nano=DIGITS,
        parent_span_id=text(), events=items(True), links=items(True), semantic=one_of("generic", "gen_ai_model", "gen_ai_tool"), **SPAN_TEXTS,
    ),
}
EVENT = record(
    "schema_version run_id event_id parent_ids sequence type timestamp monotonic_offset_ms actor payload security",
    schema_version=VERSION, run_id=RUN, event_id=EVENT_ID, parent_ids=items(EVENT_ID, uniqueItems=True), sequence=whole(1), type=text(pattern=r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+$"),
    timestamp=TIME, monotonic_offset_ms={"type": "number", "minimum": 0}, actor=text(), payload={"anyOf": [REFERENCE, {"type": "object"}]}, security=SECURITY,
)
EVENT["allOf"] = [{"if": when(type=t), "then": {"properties": {"payload": {"anyOf": [REFERENCE, p]}}}} for t, p in PAYLOADS.items()]
STATUSES = ("completed", "failed", "aborted", "unknown")
MANIFEST = record(
    "schema_version snapshot_type run_id created_at updated_at run_state terminal_status runtime last_sequence event_count",
    schema_version=VERSION, snapshot_type={"const": "run-snapshot"}, run_id=RUN, created_at=TIME, updated_at=TIME, run_state=one_of("running", "finished", "incomplete"),
    terminal_status=one_of(*STATUSES, None), runtime=RUNTIME, source=one_of("native", "sdk", "otel-import"), completeness=one_of("unknown", "partial", "complete"),
    limitations=items(LIMITATION), last_sequence=whole(0), event_count=whole(0), root_event_id=EVENT_ID, completed_at=TIME,
)
OPEN = {"properties": {"terminal_status": {"const": None}}}
MANIFEST["allOf"] = [
    {"if": when(schema_version="0.2.0"), "then": {"required": ["source", "completeness", "limitations"]}},
    {"if": when(run_state="running"), "then": OPEN},
    {"if": when(run_state="incomplete"), "then": OPEN},
    {"if": when(run_state="finished"), "then": {"required": ["completed_at"], "properties": {"completed_at": TIME, "terminal_status": one_of(*STATUSES)}}},
]
CHECKPOINT = record(
    "schema_version checkpoint_id run_id created_at last_event_id sequence state_hash state",
    schema_version=VERSION, checkpoint_id=CHECKPOINT_ID, run_id=RUN, created_at=TIME, last_event_id=EVENT_ID, sequence=whole(1), state_hash=SHA256, state={"anyOf": [{"type": "object"}, REFERENCE]},
)
DOCUMENTS = {"manifest": MANIFEST, "events": EVENT, "checkpoints": CHECKPOINT}


# --- references --------------------------------------------------------------------------------


def is_reference(value, strict: bool = True) -> bool:
    """Whether a value refers to an artifact; strict: its digest must be 64 lower-case hex digits (else any text, as validation has it)."""
    if not isinstance(value, dict) or value.get("schema_version") not in VERSIONS:
        return False
    digest = value.get("digest")
    good = isinstance(digest, str) and (not strict or re.fullmatch("[a-f0-9]{64}", digest) is not None)
    return good and isinstance(value.get("media_type"), str) and number(value.get("byte_length"))


def found_references(value, at: str = "", strict: bool = True) -> Iterator[tuple[str, dict]]:
    """(pointer, reference) of all references inside a value; what a reference holds isn't looked into. Nesting may be of any depth."""
    todo = [(at, value)]
    while todo:
        path, v = todo.pop()
        if is_reference(v, strict):
            yield path, v
        elif isinstance(v, list):
            todo.extend((f"{path}/{k}", x) for k, x in reversed(list(enumerate(v))))
        elif isinstance(v, dict):
            todo.extend((f"{path}/{escaped(k)}", x) for k, x in reversed(list(v.items())))


def _each(f):
    def over(raws: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([f(json.loads(r), p) for r, p in zip(raws, parts, strict=True)], dtype=object)

    return over


def _document_problems(value, part: str) -> list[dict]:
    """The document's own problems, and those of each reference inside it."""
    bad = list(problems(DOCUMENTS[part], value))
    bad += [p for at, r in found_references(value, strict=False) for p in problems(REFERENCE, r, at)]
    return [{"code": f"SCHEMA_{word.upper()}", "path": at} for word, at in bad]


def _document_references(value, part: str) -> list[dict]:
    return [{"path": at, "digest": r["digest"], "media_type": r["media_type"], "byte_length": float(r["byte_length"]), "preview": r["preview"] if isinstance(r.get("preview"), str) else None} for at, r in found_references(value)]


def _json(docs: DataFrame) -> DataFrame:
    return docs.where(F.try_parse_json("raw").isNotNull())


def _pointer() -> Column:
    return F.concat("prefix", "r.path")


def diagnostics(docs: DataFrame) -> DataFrame:
    """(folder, part, prefix, at, raw) of documents -> folder, code, path, at: each rule of its schema that a document breaks."""
    check = F.pandas_udf(_each(_document_problems), "array<struct<code string, path string>>")
    found = _json(docs).select("folder", "prefix", "at", F.explode(check("raw", "part")).alias("r"))
    return found.select("folder", F.col("r.code").alias("code"), _pointer().alias("path"), "at")


def references(docs: DataFrame) -> DataFrame:
    """The same documents -> folder, path, at, digest, media_type, byte_length, preview of each reference. Only texts that can hold one are walked."""
    walk = F.pandas_udf(_each(_document_references), "array<struct<path string, digest string, media_type string, byte_length double, preview string>>")
    can = F.col("raw").contains("digest") | F.col("raw").contains("\\u")
    found = _json(docs.where(can)).select("folder", "prefix", "at", F.explode(walk("raw", "part")).alias("r"))
    return found.select("folder", _pointer().alias("path"), "at", "r.digest", "r.media_type", "r.byte_length", "r.preview")

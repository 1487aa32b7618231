"""Import of OTLP/JSON traces: flat spans, rejects, decoded values, one forest a trace, observation events, report.

All steps but the decoding of nested values and the forest are column expressions. Only small traces are groups of the forest step; see forests.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import adapters
from . import forests
from .procedures import UUID, settled

#: Limits of an import, and the names of the numbers of kinds and states.
LIMITS = {"traces": 100, "spans": 10_000, "attributes": 128, "value_length": 16_384, "depth": 16, "events": 128, "links": 128}
KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATES = {2: "ok", 3: "error"}
#: The numbers of the public specification, for files that follow it.
SPEC_STATES = {1: "ok", 2: "error"}
#: Operations that stand for model calls.
MODEL_OPERATIONS = ("chat", "generate_content", "text_completion", "embeddings")
#: What limits a trace, by the code that shows it.
LIMITATION = {"CONFLICTING_SPAN": "invalid_source_data", "SELF_PARENT": "invalid_source_data", "PARENT_CYCLE": "invalid_source_data", "MISSING_PARENT": "missing_parent", "DROPPED_SOURCE_DATA": "sampled_or_dropped"}


class Decoder:
    """Reads typed OTLP values into plain ones; `cut` counts what a limit shortened."""

    def __init__(self, limits: dict | None = None):
        self.limits, self.cut = {**LIMITS, **(limits or {})}, 0

    def short(self, s: str) -> str:
        n = self.limits["value_length"]
        wide = s.encode("utf-16-le", "surrogatepass")
        if len(wide) <= 2 * n:
            return s
        self.cut += 1
        return wide[: 2 * n].decode("utf-16-le", "replace")

    def value(self, v, depth: int = 0):
        if depth >= self.limits["depth"]:
            self.cut += 1
            return None
        if not isinstance(v, dict):
            return None
        is_number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        readers = (
            ("stringValue", lambda x: isinstance(x, str), self.short),
            ("boolValue", lambda x: isinstance(x, bool), bool),
            ("intValue", lambda x: isinstance(x, str) or is_number(x), str),
            ("doubleValue", lambda x: is_number(x) and math.isfinite(x), lambda x: x),
            ("bytesValue", lambda x: isinstance(x, str), self.short),
            ("arrayValue", lambda x: isinstance(x, dict), lambda x: [self.value(y, depth + 1) for y in _list(x.get("values"))]),
            ("kvlistValue", lambda x: isinstance(x, dict), lambda x: self.attributes(x.get("values"), depth + 1)),
        )
        for name, fits, read in readers:
            if name in v and fits(v[name]):
                return read(v[name])
        return None

    def attributes(self, items, depth: int = 0) -> dict:
        items, most = _list(items), self.limits["attributes"]
        self.cut += len(items) > most
        named = (x for x in items[:most] if isinstance(x, dict) and isinstance(x.get("key"), str) and x["key"])
        return {self.short(x["key"]): self.value(x.get("value"), depth) for x in named}


    def events(self, items) -> list[dict]:
        return [
            {"name": self.short(_text(x.get("name")) or "unnamed"), "attributes": self.attributes(x.get("attributes")), "time_unix_nano": _whole(x.get("timeUnixNano")), "dropped_attributes_count": _count(x.get("droppedAttributesCount"))}
            for x in self.first(items, "events")
        ]

    def links(self, items) -> list[dict]:
        """Links with invalid ids are left out."""
        ids = [(_text(x.get("traceId")).lower(), _text(x.get("spanId")).lower(), x) for x in self.first(items, "links")]
        return [{"trace_id": t, "span_id": s, "attributes": self.attributes(x.get("attributes")), "flags": _count(x.get("flags"), -1)} for t, s, x in ids if _is_id(t, 32) and _is_id(s, 16)]

    def entity(self, x, fields: tuple[str, ...] = ("schemaUrl",)) -> dict:
        """A resource, or with more fields a scope."""
        x = x if isinstance(x, dict) else {}
        own = {k: self.short(x[k]) for k in fields if _text(x.get(k))}
        return {"attributes": self.attributes(x.get("attributes")), **own, "dropped_attributes_count": _count(x.get("droppedAttributesCount"))}

    def scope(self, x) -> dict:
        return self.entity(x, ("name", "version", "schemaUrl"))

    def first(self, items, what: str) -> list[dict]:
        """The items within a limit; one cut however many are beyond it."""
        items = _list(items)
        self.cut += len(items) > self.limits[what]
        return [x for x in items[: self.limits[what]] if isinstance(x, dict)]


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def _whole(x) -> str | None:
    """A time in nanoseconds as text; null where it is none."""
    t = str(x) if isinstance(x, (str, int)) and not isinstance(x, bool) else ""
    return t if t.isascii() and t.isdigit() and t == str(int(t)) else None


def _count(x, least: float = 0):
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) and x > least else None


def _is_id(x: str, n: int) -> bool:
    return len(x) == n and not set(x) - set("0123456789abcdef") and x.strip("0") != ""


def _list(x) -> list:
    return x if isinstance(x, list) else []


#: How each part of a span is read.
PARTS = {"attributes": Decoder.attributes, "events": Decoder.events, "links": Decoder.links, "resource": Decoder.entity, "scope": Decoder.scope}


def decoded(limits: dict | None = None):
    """Column of a struct with the JSON of each of PARTS, in the columns of these names, and `cut`. Absent fields of events, links, resource and scope are left out."""

    def bare(v):
        return [bare(x) for x in v] if isinstance(v, list) else {k: x for k, x in v.items() if x is not None} if isinstance(v, dict) and "attributes" in v else v

    @F.pandas_udf(", ".join(f"{p} string" for p in PARTS) + ", cut long")
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns, strict=True):
            d = Decoder(limits)
            got = [read(d, json.loads(t) if isinstance(t, str) else None) for read, t in zip(PARTS.values(), row, strict=True)]
            got = [got[0], *map(bare, got[1:])]
            out.append((*(json.dumps(g, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for g in got), d.cut))
        return pd.DataFrame(out, columns=[*PARTS, "cut"])

    return run(*PARTS)


def encoded(value) -> dict:
    """A plain value as a typed OTLP value: integral numbers as texts of intValue, null as the text null."""
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, (int, float)):
        return {"intValue": str(int(value))} if float(value).is_integer() else {"doubleValue": value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [encoded(v) for v in value]}}
    if isinstance(value, dict):
        return {"kvlistValue": {"values": [{"key": k, "value": encoded(v)} for k, v in sorted(value.items())]}}
    return {"stringValue": "null" if value is None else value}


def judged(spans: DataFrame) -> DataFrame:
    """Adds `reject`: the code of the first rule that a raw span breaks, else null; ids in lower case.

    spans: pos, trace_id, span_id, parent_span_id, start_ns, end_ns (texts or numbers) and others.
    """
    lower = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    whole = lambda c: F.when(F.col(c).cast("string").rlike("^(0|[1-9][0-9]*)$"), F.col(c).cast("decimal(38,0)"))
    s = spans.withColumns({"trace_id": lower("trace_id"), "span_id": lower("span_id"), "parent_raw": lower("parent_span_id"), "start_ns": whole("start_ns"), "end_ns": whole("end_ns")})
    code = (
        F.when(~scalar.is_id(F.col("trace_id"), 32), "INVALID_TRACE_ID")
        .when(~scalar.is_id(F.col("span_id"), 16), "INVALID_SPAN_ID")
        .when(F.col("start_ns").isNull(), "INVALID_TIMESTAMP")
        .when(F.col("end_ns") < F.col("start_ns"), "NEGATIVE_DURATION")
    )
    return s.withColumn("reject", code).withColumn("parent_span_id", F.when(scalar.is_id(F.col("parent_raw"), 16), F.col("parent_raw")))


def limited(spans: DataFrame, limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans inside the limits, codes of what is outside). Accepted spans are counted in file order; traces in order of first appearance.

    Two range-free steps: a rank over the whole input would be one task, so positions come from per-file counts (`pos` is global already), and
    only the spans of the first `traces` traces are ranked.
    """
    most = {**LIMITS, **(limits or {})}
    first = spans.where("reject IS NULL").groupBy("trace_id").agg(F.min("pos").alias("first_pos")).orderBy("first_pos").limit(most["traces"])
    kept = spans.where("reject IS NULL").join(F.broadcast(first.select("trace_id")), "trace_id")
    last = kept.select("pos").orderBy("pos").limit(most["spans"]).agg(F.max("pos").alias("last_pos"))
    inside = kept.join(F.broadcast(last), F.col("pos") <= F.col("last_pos")).drop("last_pos")
    outside = spans.where("reject IS NULL").join(inside.select(F.col("pos").alias("p")), F.col("pos") == F.col("p"), "left_anti")
    return inside, outside.join(F.broadcast(first.select("trace_id", F.lit(1).alias("known"))), "trace_id", "left").select("trace_id", "span_id", F.when(F.col("known").isNull(), "TRACE_LIMIT_EXCEEDED").otherwise("SPAN_LIMIT_EXCEEDED").alias("code"))


def isolated(spans: DataFrame) -> DataFrame:
    """One row a (trace_id, span_id): kept_pos (null where the copies end in conflict), duplicates, conflicts.

    In file order: an equal copy counts as duplicate, a different one removes the span that stands, and the next one stands again.
    """
    start = F.struct(F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("print"), F.lit(0).cast("long").alias("dup"), F.lit(0).cast("long").alias("bad"))

    def step(s, x):
        stands, same = s["print"].isNotNull(), s["print"] == x["print"]
        return F.struct(
            F.when(~stands, x["pos"]).when(same, s["pos"]).alias("pos"),
            F.when(~stands | same, x["print"]).alias("print"),
            (s["dup"] + F.when(stands & same, 1).otherwise(0)).alias("dup"),
            (s["bad"] + F.when(stands & ~same, 1).otherwise(0)).alias("bad"),
        )

    rows = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("fingerprint").alias("print"))))
    g = spans.groupBy("trace_id", "span_id").agg(rows.alias("rows")).withColumn("end", F.aggregate("rows", start, step))
    return g.select("trace_id", "span_id", F.col("end.pos").alias("kept_pos"), F.col("end.dup").alias("duplicates"), F.col("end.bad").alias("conflicts"))


def repaired(spans: DataFrame) -> DataFrame:
    """Adds `parent` (null where it is absent, invalid or the span itself) and `fault`."""
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("there"))
    s = spans.join(known, ["trace_id", "parent_span_id"], "left")
    fault = F.when((F.col("parent_raw") != "") & F.col("parent_span_id").isNull(), "MISSING_PARENT").when(F.col("parent_span_id") == F.col("span_id"), "SELF_PARENT").when(F.col("parent_span_id").isNotNull() & F.col("there").isNull(), "MISSING_PARENT")
    return s.withColumn("fault", fault).withColumn("parent", F.when(F.col("fault").isNull(), F.col("parent_span_id"))).drop("there")


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """A small trace: cuts each cycle at its greatest id, then lists the forest in pre-order. Linear in the trace but for sorting."""
    pdf = pdf.sort_values(["start_ns", "span_id"], kind="stable")
    up = {s: (p if isinstance(p, str) else None) for s, p in zip(pdf.span_id, pdf.parent, strict=True)}
    done: set = set()
    cut: set = set()
    for s in up:
        trail: list = []
        place: dict = {}
        while s is not None and s not in done and s not in place:
            place[s] = len(trail)
            trail.append(s)
            s = up[s]
        if s in place:
            top = max(trail[place[s] :])
            up[top] = None
            cut.add(top)
        done.update(trail)
    below: dict = {}
    for s in pdf.span_id:
        below.setdefault(up[s], []).append(s)
    out, stack = [], [(s, 0) for s in reversed(below.get(None, []))]
    while stack:
        s, depth = stack.pop()
        out.append((pdf.trace_id.iloc[0], s, up[s], len(out) + 2, depth, s in cut))
        stack += [(c, depth + 1) for c in reversed(below.get(s, []))]
    return pd.DataFrame(out, columns=["trace_id", "span_id", "parent", "sequence", "depth", "detached"])


def forest(spans: DataFrame, most: int = forests.SMALL) -> DataFrame:
    """trace_id, span_id, parent (after cuts), sequence (from 2), depth, detached; spans: trace_id, span_id, parent, start_ns."""
    return forests.forest(spans, _ordered, settled, most)


def normalized(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans that stand, with parent, sequence and depth; diagnostics as trace_id, span_id, code, n) of judged spans with a fingerprint."""
    good = spans.where("reject IS NULL")
    fate = isolated(good)
    kept = good.join(fate.where("kept_pos IS NOT NULL").select("trace_id", "span_id", F.col("kept_pos").alias("pos")), ["trace_id", "span_id", "pos"])
    linked = repaired(kept)
    tree = forest(linked)
    one = lambda d, code, n=1: d.select("trace_id", "span_id", F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), (n if not isinstance(n, int) else F.lit(n)).cast("long").alias("n"))
    found = one(fate.where("duplicates > 0"), "DUPLICATE_SPAN", F.col("duplicates"))
    for d in (
        one(fate.where("conflicts > 0"), "CONFLICTING_SPAN", F.col("conflicts")),
        one(linked.where("fault IS NOT NULL"), F.col("fault")),
        one(tree.where("detached"), "PARENT_CYCLE"),
        one(spans.where("reject IS NOT NULL"), F.col("reject")),
    ):
        found = found.unionByName(d)
    return linked.drop("parent").join(tree, ["trace_id", "span_id"]), found


def summaries(spans: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """trace_id, n_spans, first_ns, last_ns, limitations (sorted codes), completeness (never complete).

    Decoded spans bring two limitations more: a value cut anywhere limits every trace, a tool's span its own.
    """
    why = F.create_map(*[F.lit(x) for kv in LIMITATION.items() for x in kv])
    bad = diagnostics.groupBy("trace_id").agg(F.collect_set(why[F.col("code")]).alias("why"))
    own = spans.groupBy("trace_id").agg(F.count("*").alias("n_spans"), F.min("start_ns").alias("first_ns"), F.max(F.coalesce("end_ns", "start_ns")).alias("last_ns"), F.max(F.col("parent_raw") == "").alias("rooted"))
    j = own.join(bad, "trace_id", "left")
    if "cut" in spans.columns and spans.where("cut > 0").head(1):
        j = j.withColumn("why", F.array_append(F.coalesce("why", F.array().cast("array<string>")), "payload_truncated"))
    if "semantic" in spans.columns:
        tools = spans.where("semantic = 'gen_ai_tool'").select("trace_id", F.array(F.lit("unknown_side_effect")).alias("tool")).distinct()
        j = j.join(tools, "trace_id", "left").withColumn("why", F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("why", "tool")]))
    all_ = F.array_sort(F.array_union(F.coalesce("why", F.array().cast("array<string>")), F.when(~F.col("rooted"), F.array(F.lit("missing_root"))).otherwise(F.array().cast("array<string>"))))
    return j.withColumn("limitations", all_).select("trace_id", "n_spans", "first_ns", "last_ns", "limitations", F.when(F.size("limitations") == 0, "unknown").otherwise("partial").alias("completeness"))


def observation_events(spans: DataFrame) -> DataFrame:
    """The events of an observation snapshot: run.started, one otel.span a span, run.observed."""
    run = F.concat(F.lit("run_"), scalar.deterministic_uuid(F.concat(F.lit("otlp-run:"), "trace_id")))
    event = lambda source: F.concat(F.lit("evt_"), scalar.deterministic_uuid(F.concat(F.lit("otlp-event:"), "trace_id", F.lit(":"), source)))
    ends = spans.groupBy("trace_id").agg(F.min("start_ns").alias("first_ns"), F.max(F.coalesce("end_ns", "start_ns")).alias("last_ns"), F.max("sequence").alias("top"), F.max_by("span_id", "sequence").alias("last_span"))
    row = lambda source, seq, kind, ns, parent: [run.alias("run_id"), event(source).alias("event_id"), parent.alias("parent_id"), seq.cast("long").alias("sequence"), F.lit(kind).alias("type"), scalar.iso_from_nanos(ns).alias("timestamp")]
    start, stop = F.lit("run.started"), F.lit("run.observed")
    body = spans.select(*row(F.col("span_id"), F.col("sequence"), "otel.span", F.col("start_ns"), event(F.coalesce("parent", start))))
    return ends.select(*row(start, F.lit(1), "run.started", F.col("first_ns"), F.lit(None).cast("string"))).unionByName(body).unionByName(ends.select(*row(stop, F.col("top") + 1, "run.observed", F.col("last_ns"), event(F.col("last_span")))))


def payloads(spans: DataFrame) -> DataFrame:
    """trace_id, sequence, payload (JSON) of the span events of decoded spans; absent fields are left out."""
    nested = [F.try_parse_json(p).alias(p) for p in PARTS]
    text = lambda c, name: F.col(c).cast("decimal(38,0)").cast("string").alias(name)
    p = F.struct("trace_id", "span_id", "name", "status", text("start_ns", "start_time_unix_nano"), text("end_ns", "end_time_unix_nano"), F.col("parent").alias("parent_span_id"), "kind", "semantic", *nested)
    return spans.select("trace_id", "sequence", F.to_json(p).alias("payload"))


def snapshot(spans: DataFrame, diagnostics: DataFrame, redact: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(events: run_id, sequence, value; manifests: run_id, value) of imported spans, values as JSON, for snapshots.write_snapshots.

    redact: JSON -> struct(json, entries); it is applied to the spans' payloads, and its entries stand in the events.
    """
    run = F.concat(F.lit("run_"), scalar.deterministic_uuid(F.concat(F.lit("otlp-run:"), "trace_id")))
    made = summaries(spans, diagnostics).withColumn("run_id", run)
    body = payloads(spans).withColumn("run_id", run)
    e = observation_events(spans).join(body.select("run_id", "sequence", "payload"), ["run_id", "sequence"], "left").join(made.select("run_id", "first_ns"), "run_id")
    no_entries = F.array().cast("array<struct<category:string,path:string,strategy:string>>")
    e = e.withColumn("r", F.struct(F.col("payload").alias("json"), no_entries.alias("entries")) if redact is None else redact(F.col("payload")))
    runtime = '{"runtime":{"name":"opentelemetry","version":"otlp-json","adapter":"runweave"}}'
    text = F.when(F.col("type") == "run.started", runtime).when(F.col("type") == "run.observed", '{"outcome":"unknown","summary":"An imported trace; it may only be observed."}').otherwise(F.col("r.json"))
    offset = F.greatest(F.unix_millis(F.try_to_timestamp("timestamp")) - F.unix_millis(F.try_to_timestamp(scalar.iso_from_nanos(F.col("first_ns")))), F.lit(0))
    security = F.struct(F.lit("read_only").alias("side_effect"), F.coalesce("r.entries", no_entries).alias("redactions"))
    doc = F.struct(F.lit("0.2.0").alias("schema_version"), "run_id", "event_id", F.array_compact(F.array("parent_id")).alias("parent_ids"), "sequence", "type", "timestamp", offset.alias("monotonic_offset_ms"), F.lit("otel.import").alias("actor"), F.try_parse_json(text).alias("payload"), security.alias("security"))
    first, last, count = scalar.iso_from_nanos(F.col("first_ns")), scalar.iso_from_nanos(F.col("last_ns")), (F.col("n_spans") + 2).cast("long")
    root = F.concat(F.lit("evt_"), scalar.deterministic_uuid(F.concat(F.lit("otlp-event:"), "trace_id", F.lit(":run.started"))))
    told = F.transform("limitations", lambda c: F.struct(c.alias("code"), F.concat(F.lit("Found on import: "), c).alias("message")))
    fixed = {"schema_version": "0.2.0", "snapshot_type": "run-snapshot", "run_state": "finished", "terminal_status": "unknown", "source": "otel-import"}
    m = F.struct("run_id", *[F.lit(v).alias(k) for k, v in fixed.items()], first.alias("created_at"), last.alias("updated_at"), F.try_parse_json(F.get_json_object(F.lit(runtime), "$.runtime")).alias("runtime"), "completeness", told.alias("limitations"), count.alias("last_sequence"), count.alias("event_count"), root.alias("root_event_id"), last.alias("completed_at"))
    return e.select("run_id", "sequence", F.to_json(doc).alias("value")), made.select("run_id", F.to_json(m).alias("value"))


def semantic(attributes) -> F.Column:
    """gen_ai_tool, gen_ai_model or generic, of decoded attributes (JSON)."""
    op = F.get_json_object(attributes, "$['gen_ai.operation.name']")
    return F.when(op == "execute_tool", "gen_ai_tool").when(op.isin(*MODEL_OPERATIONS), "gen_ai_model").otherwise("generic")


def kind_name(kind) -> F.Column:
    known = F.array(*map(F.lit, KINDS))
    return F.when(kind.between(0, len(KINDS) - 1), F.get(known, kind.cast("int"))).when(kind.isNotNull(), F.concat(F.lit("unknown:"), kind.cast("string")))


def state_name(code, states: dict[int, str] | None = None) -> F.Column:
    names = F.create_map(*[F.lit(x) for kv in (states or STATES).items() for x in kv])
    return F.coalesce(names[code.cast("int")], F.lit("unset"))


def import_files(spark: SparkSession, paths: list[str], limits: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(spans, diagnostics) of OTLP/JSON files, decoded, within the limits; what isn't an object has null ids in the diagnostics."""
    from ..sources.snapshots import otlp_faults, read_otlp

    raw = read_otlp(spark, paths)
    place = F.struct(F.array_position(F.transform(F.array(*map(F.lit, paths)), lambda p: F.regexp_replace(p, "^file:/*", "/")), F.regexp_replace("path", "^file:/*", "/")).alias("f"), "r", "s", "k")
    # files hold 64 MiB at most, so the three positions fit below
    raw = raw.withColumn("at", place).withColumn("pos", ((F.col("at.f") * 100_000 + F.col("r")) * 100_000 + F.col("s")) * 1_000_000 + F.col("k")).drop("at")
    s = judged(raw).withColumn("fingerprint", F.sha2("raw", 256)).drop("raw")
    inside, outside = limited(s, limits)
    spans, found = normalized(inside.unionByName(s.where("reject IS NOT NULL")))
    spans = spans.withColumn("values", decoded(limits)).withColumns({c: F.col(f"values.{c}") for c in (*PARTS, "cut")}).drop("values")
    spans = spans.withColumns({"kind": kind_name(F.col("kind")), "status": state_name(F.col("status_code")), "semantic": semantic("attributes")})
    one = lambda d, code: d.select("trace_id", "span_id", code.alias("code"), F.lit(1).cast("long").alias("n"))
    nowhere = otlp_faults(spark, paths).withColumns({"trace_id": F.lit(None).cast("string"), "span_id": F.lit(None).cast("string")})
    return spans, found.unionByName(one(outside, F.col("code"))).unionByName(one(inside.where("has_drops"), F.lit("DROPPED_SOURCE_DATA"))).unionByName(one(nowhere, F.col("code")))


# --- queries over the adapter's spans ------------------------------------------------------------


def _adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = adapters.views(spark, sf_dir, ("sp",))["sp"]
    return judged(sp.withColumn("pos", F.col("n")).withColumn("fingerprint", F.col("start_ns").cast("string")))


def otlp_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolated(_adapted(spark, sf_dir).where("reject IS NULL"))


def otlp_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(_adapted(spark, sf_dir))[1].groupBy("code").agg(F.sum("n").alias("n"))


def otlp_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(_adapted(spark, sf_dir))[0].select("trace_id", "span_id", "parent", "sequence", "depth", "detached")


def otlp_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = normalized(_adapted(spark, sf_dir))
    return summaries(s, d).select("trace_id", "n_spans", F.col("first_ns").cast("long").alias("first_ns"), F.col("last_ns").cast("long").alias("last_ns"), F.array_join("limitations", ",").alias("limitations"), "completeness")


def otlp_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observation_events(normalized(_adapted(spark, sf_dir))[0])


QUERIES = {f.__name__: f for f in (otlp_isolation, otlp_report, otlp_normalized, otlp_summaries, otlp_observation)}
# every row of the adapter has a start of its own, so copies differ: those at odd places stand, those at even places remove
_FATE = "SELECT trace_id, span_id, CASE WHEN count(*) % 2 = 1 THEN max(n) END AS kept_pos, cast(0 AS bigint) AS duplicates, cast(floor(count(*) / 2) AS bigint) AS conflicts FROM sp GROUP BY trace_id, span_id"
_KEPT = f"""f AS ({_FATE}), k AS (SELECT sp.* FROM sp JOIN f ON sp.trace_id = f.trace_id AND sp.span_id = f.span_id AND sp.n = f.kept_pos),
l AS (SELECT k.*, CASE WHEN k.parent_span_id = k.span_id THEN 'SELF_PARENT' WHEN k.parent_span_id IS NOT NULL AND p.span_id IS NULL THEN 'MISSING_PARENT' END AS fault FROM k LEFT JOIN k p ON p.trace_id = k.trace_id AND p.span_id = k.parent_span_id)"""
# ways up to find cycles, then ways down that sort as the forest's pre-order
_FOREST = f"""WITH RECURSIVE {_KEPT}, e AS (SELECT trace_id, span_id, start_ns, CASE WHEN fault IS NULL THEN parent_span_id END AS up FROM l),
reach AS (SELECT trace_id, span_id, up FROM e WHERE up IS NOT NULL UNION SELECT r.trace_id, r.span_id, e.up FROM reach r JOIN e ON e.trace_id = r.trace_id AND e.span_id = r.up WHERE e.up IS NOT NULL),
loops AS (SELECT trace_id, span_id FROM reach WHERE up = span_id),
cut AS (SELECT r.trace_id, r.span_id FROM reach r JOIN loops o ON o.trace_id = r.trace_id AND o.span_id = r.span_id JOIN loops p ON p.trace_id = r.trace_id AND p.span_id = r.up GROUP BY ALL HAVING max(r.up) = r.span_id),
g AS (SELECT e.trace_id, e.span_id, start_ns, CASE WHEN cut.span_id IS NULL THEN up END AS up, cut.span_id IS NOT NULL AS detached FROM e LEFT JOIN cut ON cut.trace_id = e.trace_id AND cut.span_id = e.span_id),
tree AS (SELECT g.*, 0 AS depth, [lpad(start_ns::VARCHAR, 20, '0') || span_id] AS way FROM g WHERE up IS NULL
 UNION ALL SELECT g.*, t.depth + 1, list_append(t.way, lpad(g.start_ns::VARCHAR, 20, '0') || g.span_id) FROM tree t JOIN g ON g.trace_id = t.trace_id AND g.up = t.span_id)"""
ORACLES = {
    "otlp_normalized": adapters.duck(_FOREST + " SELECT trace_id, span_id, up AS parent, 1 + row_number() OVER (PARTITION BY trace_id ORDER BY way) AS sequence, depth::BIGINT AS depth, detached FROM tree", ("sp",)),
    "otlp_report": adapters.duck(
        _FOREST + """ SELECT code, sum(n)::BIGINT AS n FROM (SELECT 'CONFLICTING_SPAN' AS code, conflicts AS n FROM f WHERE conflicts > 0 UNION ALL SELECT fault, 1 FROM l WHERE fault IS NOT NULL UNION ALL SELECT 'PARENT_CYCLE', 1 FROM tree WHERE detached) x GROUP BY code""",
        ("sp",),
    ),
    "otlp_observation": adapters.duck(
        _FOREST + f""", s AS (SELECT t.*, 1 + row_number() OVER (PARTITION BY t.trace_id ORDER BY way) AS sequence, k.end_ns FROM tree t JOIN k ON k.trace_id = t.trace_id AND k.span_id = t.span_id),
r AS (SELECT trace_id, 'run.started' AS source, NULL AS parent, 1 AS sequence, 'run.started' AS type, min(start_ns) AS ns FROM s GROUP BY trace_id
 UNION ALL SELECT trace_id, span_id, coalesce(up, 'run.started'), sequence, 'otel.span', start_ns FROM s
 UNION ALL SELECT trace_id, 'run.observed', arg_max(span_id, sequence), max(sequence) + 1, 'run.observed', max(end_ns) FROM s GROUP BY trace_id),
h AS (SELECT *, sha256('otlp-run:' || trace_id) AS hr, sha256('otlp-event:' || trace_id || ':' || source) AS he, sha256('otlp-event:' || trace_id || ':' || parent) AS hp FROM r)
SELECT 'run_' || {UUID.replace("h,", "hr,")} AS run_id, 'evt_' || {UUID.replace("h,", "he,")} AS event_id, CASE WHEN parent IS NOT NULL THEN 'evt_' || {UUID.replace("h,", "hp,")} END AS parent_id, sequence::BIGINT AS sequence, type, strftime(epoch_ms(ns // 1000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp FROM h""",
        ("sp",),
    ),
    "otlp_isolation": adapters.duck(_FATE, ("sp",)),
    "otlp_summaries": adapters.duck(
        f"""WITH {_KEPT}, w AS (SELECT trace_id, max(CASE WHEN conflicts > 0 THEN 1 ELSE 0 END) AS c FROM f GROUP BY trace_id),
a AS (SELECT trace_id, count(*) AS n_spans, min(start_ns) AS first_ns, max(end_ns) AS last_ns, max(CASE WHEN fault = 'SELF_PARENT' THEN 1 ELSE 0 END) AS s, max(CASE WHEN fault = 'MISSING_PARENT' THEN 1 ELSE 0 END) AS m, max(CASE WHEN parent_span_id IS NULL THEN 1 ELSE 0 END) AS r FROM l GROUP BY trace_id),
e AS (SELECT a.*, concat_ws(',', CASE WHEN s = 1 OR c = 1 THEN 'invalid_source_data' END, CASE WHEN m = 1 THEN 'missing_parent' END, CASE WHEN r = 0 THEN 'missing_root' END) AS limitations FROM a JOIN w ON a.trace_id = w.trace_id)
SELECT trace_id, n_spans, first_ns, last_ns, limitations, CASE WHEN limitations = '' THEN 'unknown' ELSE 'partial' END AS completeness FROM e""",
        ("sp",),
    ),
}

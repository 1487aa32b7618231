"""Table functions for SQL: `SELECT ... FROM t, LATERAL json_leaves(t.doc)`. `register` makes them known to a session.

json_leaves(doc): path, value (JSON) of every value that holds no other one.
json_differences(a, b [, ignore => '/x,/y/*']): kind, path of what differs, as replays compare values.
artifact_references(doc): path, digest, media_type, byte_length, preview of each reference inside.
otlp_spans(request [, attributes => 'a,b']): the spans of an OTLP/JSON request with their places, and a column for each attribute asked for.

Nulls and texts that aren't JSON give no rows. Constant arguments decide on columns and rules before anything is read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import replay, schema
from ..sources import adapters

NOTHING = object()


@dataclass
class Chosen(AnalyzeResult):
    """Columns, and the parts of the constant argument."""

    parts: list[str] = field(default_factory=list)


def parsed(text):
    try:
        return NOTHING if text is None else json.loads(text)
    except ValueError:
        return NOTHING


def columns(**types) -> StructType:
    s = StructType()
    for name, kind in types.items():
        s = s.add(name, kind)
    return s


def texts(*arguments: AnalyzeArgument) -> None:
    for a in arguments:
        if a.isTable or not isinstance(a.dataType, StringType):
            raise ValueError("JSON texts are needed")


def constants(argument: AnalyzeArgument | None, name: str) -> list[str]:
    """The parts of a constant list, divided by commas."""
    if argument is None:
        return []
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError(f"{name} must be a constant text")
    return [p.strip() for p in argument.value.split(",") if p.strip()]


class Leaves:
    @staticmethod
    def analyze(doc: AnalyzeArgument) -> AnalyzeResult:
        texts(doc)
        return AnalyzeResult(columns(path=StringType(), value=StringType()))

    def eval(self, doc):
        todo = [("", parsed(doc))]
        while todo:
            path, v = todo.pop()
            if isinstance(v, dict) and v:
                todo += [(f"{path}/{schema.escaped(k)}", x) for k, x in reversed(v.items())]
            elif isinstance(v, list) and v:
                todo += [(f"{path}/{k}", x) for k, x in reversed([*enumerate(v)])]
            elif v is not NOTHING:
                yield path, json.dumps(v, separators=(",", ":"), ensure_ascii=False)


class Differences:
    def __init__(self, analyzed):
        self.rules = tuple({"kind": "ignore", "path": p} for p in analyzed.parts)

    @staticmethod
    def analyze(a: AnalyzeArgument, b: AnalyzeArgument, ignore: AnalyzeArgument | None = None) -> AnalyzeResult:
        texts(a, b)
        return Chosen(columns(kind=StringType(), path=StringType()), parts=constants(ignore, "ignore"))

    def eval(self, a, b, ignore=None):
        x, y = parsed(a), parsed(b)
        if x is not NOTHING and y is not NOTHING:
            yield from replay.differences(x, y, self.rules)


class References:
    @staticmethod
    def analyze(doc: AnalyzeArgument) -> AnalyzeResult:
        texts(doc)
        return AnalyzeResult(columns(path=StringType(), digest=StringType(), media_type=StringType(), byte_length=DoubleType(), preview=StringType()))

    def eval(self, doc):
        v = parsed(doc)
        for path, r in schema.found_references(v) if v is not NOTHING else ():
            yield path, r["digest"], r["media_type"], float(r["byte_length"]), r["preview"] if isinstance(r.get("preview"), str) else None


class Spans:
    """Attributes are texts, numbers as they are written; of a repeated key the last counts."""

    def __init__(self, analyzed):
        self.wanted = analyzed.parts

    @staticmethod
    def analyze(request: AnalyzeArgument, attributes: AnalyzeArgument | None = None) -> AnalyzeResult:
        texts(request)
        wanted = constants(attributes, "attributes")
        return Chosen(columns(r=IntegerType(), s=IntegerType(), k=IntegerType(), trace_id=StringType(), span_id=StringType(), parent_span_id=StringType(), name=StringType(), start_ns=StringType(), end_ns=StringType(), **{w: StringType() for w in wanted}), parts=wanted)

    def eval(self, request, attributes=None):
        items = lambda v, name: enumerate(v.get(name) if isinstance(v, dict) and isinstance(v.get(name), list) else [])
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
        for r, resource in items(parsed(request), "resourceSpans"):
            for s, scope in items(resource, "scopeSpans"):
                for k, span in items(scope, "spans"):
                    if isinstance(span, dict):
                        own = {a.get("key"): next(iter(a["value"].values()), None) for _, a in items(span, "attributes") if isinstance(a, dict) and isinstance(a.get("value"), dict)}
                        fields = ("traceId", "spanId", "parentSpanId", "name", "startTimeUnixNano", "endTimeUnixNano")
                        yield (r, s, k, *(text(span.get(f)) for f in fields), *(text(own.get(w)) for w in self.wanted))


FUNCTIONS = {"json_leaves": Leaves, "json_differences": Differences, "artifact_references": References, "otlp_spans": Spans}


def register(spark: SparkSession) -> None:
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))


# --- queries ---------------------------------------------------------------------------------

_DOCS = "SELECT run_id, pos, event_id, to_json(named_struct('type', type, 'v', named_struct('n', n, 'at', array(named_struct('x', n % 3), named_struct('x', n % 4))), 'k', CASE WHEN n % 5 = 0 THEN n END)) AS doc FROM te"
_WALK = """docs AS (SELECT run_id, pos, event_id, CASE WHEN n % 5 = 0 THEN json_object('type', type, 'v', json_object('n', n, 'at', json_array(json_object('x', n % 3), json_object('x', n % 4))), 'k', n)
  ELSE json_object('type', type, 'v', json_object('n', n, 'at', json_array(json_object('x', n % 3), json_object('x', n % 4)))) END AS doc FROM te),
walk AS (SELECT run_id, pos, event_id, '' AS path, doc AS v FROM docs UNION ALL SELECT walk.run_id, walk.pos, walk.event_id, walk.path || '/' || e.key, e.value FROM walk, json_each(walk.v) e WHERE json_type(walk.v) IN ('OBJECT', 'ARRAY')),
leaves AS (SELECT run_id, pos, event_id, path, CAST(v AS VARCHAR) AS value FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY'))"""


def table_json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    docs = adapters.sql(spark, _DOCS, **adapters.views(spark, sf_dir, ("te",)))
    return spark.sql("SELECT d.event_id, l.path, l.value FROM {docs} d, LATERAL json_leaves(d.doc) l", docs=docs)


def table_json_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the documents of events that follow each other, but for their numbers."""
    register(spark)
    docs = adapters.sql(spark, _DOCS, **adapters.views(spark, sf_dir, ("te",)))
    return spark.sql("SELECT a.event_id, d.kind, d.path FROM {docs} a JOIN {docs} b ON b.run_id = a.run_id AND b.pos = a.pos + 1, LATERAL json_differences(a.doc, b.doc, ignore => '/v/n') d", docs=docs)


def table_otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    span = "named_struct('traceId', trace_id, 'spanId', span_id, 'parentSpanId', parent_span_id, 'name', name, 'startTimeUnixNano', cast(start_ns AS string), 'attributes', array(named_struct('key', 'n', 'value', named_struct('intValue', cast(n AS string)))))"
    text = f"SELECT to_json(named_struct('resourceSpans', array(named_struct('scopeSpans', array(named_struct('spans', collect_list({span}))))))) AS request FROM sp GROUP BY trace_id"
    requests = adapters.sql(spark, text, **adapters.views(spark, sf_dir, ("sp",)))
    return spark.sql("SELECT s.trace_id, s.span_id, s.parent_span_id, s.name, s.start_ns, s.n FROM {requests} q, LATERAL otlp_spans(q.request, attributes => 'n') s", requests=requests)


QUERIES = {f.__name__: f for f in (table_json_leaves, table_json_differences, table_otlp_spans)}
ORACLES = {
    "table_json_leaves": adapters.duck(f"WITH @recursive {_WALK} SELECT event_id, path, value FROM leaves", ("te",)),
    "table_json_differences": adapters.duck(
        f"""WITH @recursive {_WALK}, pairs AS (SELECT a.run_id, a.pos, a.event_id FROM te a JOIN te b ON b.run_id = a.run_id AND b.pos = a.pos + 1),
y AS (SELECT p.event_id, l.path, l.value FROM pairs p JOIN leaves l ON l.run_id = p.run_id AND l.pos = p.pos + 1), x AS (SELECT p.event_id, l.path, l.value FROM pairs p JOIN leaves l ON l.run_id = p.run_id AND l.pos = p.pos)
SELECT coalesce(x.event_id, y.event_id) AS event_id, 'value' AS kind, coalesce(x.path, y.path) AS path FROM x FULL JOIN y ON x.event_id = y.event_id AND x.path = y.path WHERE x.value IS DISTINCT FROM y.value AND coalesce(x.path, y.path) <> '/v/n'""",
        ("te",),
    ),
    "table_otlp_spans": adapters.duck("SELECT trace_id, span_id, parent_span_id, name, CAST(start_ns AS VARCHAR) AS start_ns, CAST(n AS VARCHAR) AS n FROM sp", ("sp",)),
}

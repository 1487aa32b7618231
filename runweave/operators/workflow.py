"""Workflow documents: validation as relations, conditions, capabilities, and a scheduler for one document.

Validation runs over a table of documents (workflow_id, doc JSON), one document a row; the scheduler is a driver-side loop over one small document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..sources import adapters
from . import plans, schema
from .ancestors import dependencies

MISSING = object()


def escape(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def at_pointer(value, path: str | None):
    """What a JSON pointer names, or MISSING."""
    if not path:
        return value
    if path[0] != "/":
        return MISSING
    for raw in path[1:].split("/"):
        key = raw.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            value = value[int(key)] if key.isdigit() and int(key) < len(value) else MISSING
        else:
            value = value.get(key, MISSING) if isinstance(value, dict) else MISSING
        if value is MISSING:
            break
    return value


def same(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a is not MISSING and b is not MISSING and type(a) in (int, float) and type(b) in (int, float) and a == b or type(a) is type(b) and a == b


def truthy(v) -> bool:
    """Empty lists and objects count as true; missing, null, zero and the empty text don't."""
    return isinstance(v, (list, dict)) or v is not MISSING and bool(v)


OPERATORS: dict[str, Callable] = {
    "exists": lambda v, _: v is not MISSING,
    "equals": same,
    "not_equals": lambda v, w: not same(v, w),
    "truthy": lambda v, _: truthy(v),
    "falsy": lambda v, _: not truthy(v),
}


def holds(condition: dict, inputs: dict, outputs: dict) -> bool:
    source = condition["from"]
    value = (inputs if source["kind"] == "input" else outputs).get(source["name"], MISSING)
    return OPERATORS[condition["operator"]](MISSING if value is MISSING else at_pointer(value, source.get("path")), condition.get("value"))


# --- validation ------------------------------------------------------------------------------


def _references(doc: dict) -> Iterable[tuple[str, str, str, set]]:
    """(code if unknown, path, name, names that are known) of everything in a document that names something else."""
    nodes = {n["node_id"] for n in doc["nodes"]}
    verifiers = {v["verifier_id"] for v in doc.get("verifiers") or []}
    known = {"input": set(doc.get("inputs") or {})}
    for i, node in enumerate(doc["nodes"]):
        for k, d in enumerate(node.get("depends_on") or []):
            yield "MISSING_WORKFLOW_DEPENDENCY", f"/nodes/{i}/depends_on/{k}/node_id", d["node_id"], nodes
            yield "SELF_WORKFLOW_DEPENDENCY", f"/nodes/{i}/depends_on/{k}/node_id", d["node_id"], {d["node_id"]} - {node["node_id"]}
        if node.get("kind") == "verification":
            yield "MISSING_WORKFLOW_VERIFIER", f"/nodes/{i}/verifier_id", node.get("verifier_id") or "", verifiers
        asked = [(f"/nodes/{i}/condition/from", node.get("condition"))]
        for k, c in enumerate(node.get("success_conditions") or []):
            if c["kind"] == "verifier":
                yield "MISSING_WORKFLOW_VERIFIER", f"/nodes/{i}/success_conditions/{k}/verifier_id", c.get("verifier_id") or "", verifiers
            elif c["kind"] == "condition":
                asked.append((f"/nodes/{i}/success_conditions/{k}/condition/from", c.get("condition")))
        for path, c in asked:
            if c:
                yield "MISSING_WORKFLOW_REFERENCE", path, c["from"]["name"], known.get(c["from"]["kind"], nodes)
    for name, out in (doc.get("outputs") or {}).items():
        yield "MISSING_WORKFLOW_OUTPUT_NODE", f"/outputs/{escape(name)}/from/node_id", out["from"]["node_id"], nodes


def _entries(doc: dict) -> list[str]:
    """Nodes at which a walk along dependencies, in document order, comes back to its own trail; no recursion."""
    ids = {n["node_id"] for n in doc["nodes"]}
    after = {n["node_id"]: [d["node_id"] for d in n.get("depends_on") or [] if d["node_id"] in ids] for n in doc["nodes"]}
    seen: set = set()
    trail: dict = {}
    found = []
    for top in after:
        stack = [] if top in seen else [(top, iter(after[top]))]
        if stack:
            trail[top] = True
        while stack:
            at, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                stack.pop()
                trail.pop(at)
                seen.add(at)
            elif nxt in trail:
                found.append(nxt)
            elif nxt not in seen:
                trail[nxt] = True
                stack.append((nxt, iter(after[nxt])))
    return found


def diagnostics(doc: dict) -> list[tuple[str, str]]:
    """(code, path) of all faults of a document; all are errors."""
    out = []
    for code, part, key in (("DUPLICATE_WORKFLOW_VERIFIER_ID", "verifiers", "verifier_id"), ("DUPLICATE_WORKFLOW_NODE_ID", "nodes", "node_id")):
        ids = [x[key] for x in doc.get(part) or []]
        first = {v: k for k, v in reversed(list(enumerate(ids)))}
        out += [(code, f"/{part}/{k}/{key}") for k, v in enumerate(ids) if first[v] != k]
    out += [(code, path) for code, path, name, known in _references(doc) if name not in known]
    return out + [("WORKFLOW_DEPENDENCY_CYCLE", "/nodes")] * len(_entries(doc))


def validated(documents: DataFrame) -> DataFrame:
    """(workflow_id, doc) -> workflow_id, code, path of each fault. Text that isn't a document of nodes gives INVALID_JSON."""

    @F.pandas_udf("array<struct<code:string,path:string>>")
    def faults(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [{"code": c, "path": p} for c, p in diagnostics(json.loads(t))]
            except (ValueError, KeyError, TypeError, AttributeError):
                return [{"code": "INVALID_JSON", "path": ""}]

        return s.map(one)

    return documents.select("workflow_id", F.explode(faults("doc")).alias("f")).select("workflow_id", "f.code", "f.path")


# --- scheduling ------------------------------------------------------------------------------


def compatibility(doc: dict, capabilities: Iterable[str]) -> dict:
    """What a document needs of an agent and lacks; an agent that declares nothing of the kind is taken to do all."""
    prefix = "semantic.node."
    needed = sorted({prefix + n["kind"] for n in doc["nodes"]})
    declared = {c for c in capabilities if c.startswith(prefix)}
    lacking = [c for c in needed if c not in declared] if declared else []
    return {"compatible": not lacking, "required": needed, "unsupported": lacking, "mode": "explicit" if declared else "legacy_all"}


#: The result that each kind of dependency waits for.
WANTED = {"success": ("completed",), "failure": ("failed",), "always": ("completed", "failed", "skipped")}


def readiness(node: dict, results: dict) -> str:
    for d in node.get("depends_on") or []:
        if d["node_id"] not in results:
            return "waiting"
        if results[d["node_id"]] not in WANTED[d.get("on", "success")]:
            return "blocked"
    return "ready"


#: schema_accepts(schema, value): whether a value meets a JSON schema; no schema accepts all.
schema_accepts = schema.accepts


class Semantic:
    """Runs one document with an agent: nodes in document order, whenever what they depend on is there.

    agent(node, inputs, outputs, attempt) -> (ok, output or error code); verifiers: id -> f(output) -> bool; allowed(node) -> bool is the policy.
    """

    def __init__(self, doc: dict, agent: Callable, verifiers: dict[str, Callable] | None = None, allowed: Callable[[dict], bool] = lambda node: True, capabilities: Iterable[str] = ()):
        self.doc, self.agent, self.verifiers, self.allowed, self.capabilities = doc, agent, verifiers or {}, allowed, tuple(capabilities)

    def verified(self, name: str, output) -> bool:
        spec = next((v for v in self.doc.get("verifiers") or [] if v["verifier_id"] == name), None)
        if spec and spec["kind"] == "json_schema":
            return schema_accepts(spec.get("schema"), output)
        return spec is not None and name in self.verifiers and bool(self.verifiers[name](output))

    def accepted(self, node: dict, output, inputs: dict, outputs: dict) -> bool:
        checks = {
            "output_schema": lambda c: schema_accepts(c.get("schema"), output),
            "condition": lambda c: holds(c["condition"], inputs, {**outputs, node["node_id"]: output}),
            "verifier": lambda c: self.verified(c["verifier_id"], output),
        }
        good = all([checks[c["kind"]](c) for c in node.get("success_conditions") or []])
        return good and (node["kind"] != "verification" or self.verified(node["verifier_id"], output))

    def attempt(self, node: dict, inputs: dict, outputs: dict) -> tuple[str, int, object]:
        most = (node.get("retry") or {}).get("max_attempts", 1)
        for n in range(1, most + 1):
            if not self.allowed(node):
                return "failed", n, MISSING
            ok, output = self.agent(node, inputs, outputs, n)
            if ok and self.accepted(node, output, inputs, outputs):
                return "completed", n, output
        return "failed", most, MISSING

    def run(self, inputs: dict) -> dict:
        """status, nodes {id: (status, attempts)} in order of settlement, outputs, codes."""
        codes: list[str] = []
        if diagnostics(self.doc):
            return {"status": "failed", "nodes": {}, "outputs": {}, "codes": ["INVALID_WORKFLOW"]}
        if not compatibility(self.doc, self.capabilities)["compatible"]:
            return {"status": "failed", "nodes": {}, "outputs": {}, "codes": ["INCOMPATIBLE_AGENT"]}
        for name, spec in (self.doc.get("inputs") or {}).items():
            if name not in inputs:
                codes += ["INPUT_MISSING"] if spec.get("required", True) else []
            elif not schema_accepts(spec.get("schema"), inputs[name]):
                codes.append("INPUT_SCHEMA_MISMATCH")
        if codes:
            return {"status": "failed", "nodes": {}, "outputs": {}, "codes": codes}
        done: dict[str, tuple[str, int]] = {}
        made: dict = {}
        left = {n["node_id"]: n for n in self.doc["nodes"]}
        moved = True
        while left and moved:
            moved = False
            for name, node in list(left.items()):
                state = readiness(node, {k: v[0] for k, v in done.items()})
                if state == "waiting":
                    continue
                moved = True
                del left[name]
                if state == "blocked":
                    done[name] = ("blocked", 0)
                elif node.get("condition") and not holds(node["condition"], inputs, made):
                    done[name] = ("skipped", 0)
                else:
                    status, tries, output = self.attempt(node, inputs, made)
                    done[name] = (status, tries)
                    if output is not MISSING:
                        made[name] = output
                    if status == "failed" and node.get("on_failure", "stop") == "stop":
                        codes.append("NODE_FAILED")
                        done |= dict.fromkeys(left, ("blocked", 0))
                        left = {}
                        break
        done |= dict.fromkeys(left, ("blocked", 0))
        outputs = {}
        for name, spec in (self.doc.get("outputs") or {}).items():
            source = made.get(spec["from"]["node_id"], MISSING)
            value = MISSING if source is MISSING else at_pointer(source, spec["from"].get("path"))
            if value is MISSING:
                codes.append("OUTPUT_MISSING")
                continue
            outputs[name] = value
            if not schema_accepts(spec.get("schema"), value):
                codes.append("OUTPUT_SCHEMA_MISMATCH")
        return {"status": "failed" if codes else "completed", "nodes": done, "outputs": outputs, "codes": codes}


# --- documents made from traces ---------------------------------------------------------------


def compiled(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """workflow_id, doc: one document a run, its nodes in order of number, each after the nodes that it needs.

    nodes: run_id, node_id, max_attempts, on_failure, target; needs: run_id, node_id, depends_on.
    """
    after = needs.groupBy("run_id", "node_id").agg(F.transform(F.array_sort(F.collect_set("depends_on")), lambda d: F.struct(d.alias("node_id"), F.lit("success").alias("on"))).alias("depends_on"))
    n = nodes.join(after, ["run_id", "node_id"], "left")
    is_model = F.col("node_id").startswith("node_model_")
    node = F.struct(
        F.regexp_extract("node_id", r"(\d+)$", 1).cast("int").alias("k"), "node_id", F.when(is_model, "agent_task").otherwise("tool_call").alias("kind"),
        F.when(is_model, "Run the recorded model call.").alias("goal"), F.when(~is_model, F.col("target")).alias("tool"),
        F.coalesce("depends_on", F.array().cast("array<struct<node_id:string,on:string>>")).alias("depends_on"),
        F.array(F.struct(F.lit("output_schema").alias("kind"), F.lit(True).alias("schema"))).alias("success_conditions"),
        F.when(F.col("max_attempts") > 1, F.struct("max_attempts")).alias("retry"), "on_failure",
    )
    g = n.groupBy("run_id").agg(F.array_sort(F.collect_list(node)).alias("n"))
    body = F.transform("n", lambda x: x.dropFields("k"))
    result = F.create_map(F.lit("result"), F.struct(F.struct(F.element_at(F.col("n.node_id"), -1).alias("node_id")).alias("from"), F.lit(True).alias("schema")))
    return g.select(F.concat(F.lit("workflow_"), F.regexp_replace("run_id", "[^A-Za-z0-9_-]", "_")).alias("workflow_id"), F.to_json(F.struct(F.lit("agent-workflow").alias("workflow_type"), body.alias("nodes"), F.create_map().cast("map<string,string>").alias("inputs"), result.alias("outputs"))).alias("doc"))


def calls_of(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """run_id, event_id, node_id, is_request: the requests and ends of each node, by kind and key."""
    e = events.where("type LIKE '%.requested' OR type LIKE '%.completed' OR type LIKE '%.failed'").select("run_id", "event_id", F.substring_index("type", ".", 1).alias("kind"), "correlation_key", F.col("type").endswith(".requested").alias("is_request"))
    named = nodes.select("run_id", "node_id", "correlation_key", F.regexp_extract("node_id", "^node_([a-z]+)_", 1).alias("kind"))
    return e.join(named, ["run_id", "kind", "correlation_key"]).select("run_id", "event_id", "node_id", "is_request")


def _compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    te = adapters.views(spark, sf_dir, ("te",))["te"]
    nodes = plans.run("compile_nodes", spark, te=te).withColumn("target", F.col("correlation_key"))
    events = te.select("run_id", "event_id", "type", F.array_compact(F.array("parent_id")).alias("parent_ids"), F.format_string("key_%d", F.col("n") % 4).alias("correlation_key"))
    return compiled(nodes, dependencies(events, calls_of(events, nodes)))


def workflow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _compiled(spark, sf_dir)
    return d.select("workflow_id", F.sha2(scalar.canonical_json(F.col("doc")), 256).alias("digest"), F.size(F.from_json("doc", "nodes array<struct<node_id:string>>")["nodes"]).cast("long").alias("n_nodes"))


def workflow_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled documents with faults put in by rule: a dependency that doesn't exist, or a repeated node."""
    d = _compiled(spark, sf_dir).withColumn("k", F.regexp_extract("workflow_id", r"(\d+)$", 1).cast("long"))
    bad = F.when(F.col("k") % 5 == 1, F.replace("doc", F.lit('"from":{"node_id":"'), F.lit('"from":{"node_id":"gone_'))).when(F.col("k") % 5 == 2, F.regexp_replace("doc", r'"depends_on":\[\]', '"depends_on":[{"node_id":"gone","on":"success"}]')).otherwise(F.col("doc"))
    return validated(d.select("workflow_id", bad.alias("doc")))


QUERIES = {"workflow_documents": workflow_documents, "workflow_faults": workflow_faults}

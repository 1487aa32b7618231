"""The declarative operators: for each, the views it reads and its plan as SQL. What they are held against is written apart (plans/oracles.py).

`run(name, spark, **frames)` applies one to any frames of the views' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import EVENT_TYPES, FOLD_KIND, STATUS
from ..sources import adapters
from . import ancestors

KNOWN = ", ".join(f"'{t}'" for t in EVENT_TYPES)
#: Nodes that @shown lets stay, and edges between them; a parent's id stands for the last event of that id in a node that stays.
GROUPS_OF = f"""
g AS (SELECT *, {STATUS} AS status, {FOLD_KIND} AS kind FROM te),
s AS (SELECT *, CASE WHEN kind IS NULL OR lag(kind) OVER (PARTITION BY run_id ORDER BY pos) IS NULL OR kind <> lag(kind) OVER (PARTITION BY run_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM g),
i AS (SELECT *, cast(sum(new) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) AS grp FROM s),
f AS (SELECT *, min(pos) OVER (PARTITION BY run_id, grp) AS head, max(pos) OVER (PARTITION BY run_id, grp) AS tail FROM i),
all_nodes AS (SELECT run_id, grp, CASE WHEN count(DISTINCT pos) > 1 THEN concat('group:', min(CASE WHEN pos = head THEN event_id END)) ELSE min(event_id) END AS node_id,
   count(DISTINCT pos) AS n_events, min(sequence) AS first_sequence, max(sequence) AS last_sequence, min(CASE WHEN pos = head THEN timestamp END) AS first_timestamp,
   max(CASE WHEN pos = tail THEN timestamp END) AS last_timestamp,
   CASE WHEN min(actor) = max(actor) THEN min(actor) ELSE 'multiple' END AS actor,
   CASE WHEN max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) = 1 THEN 'failed' WHEN max(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) = 1 THEN 'completed' ELSE min(CASE WHEN pos = head THEN status END) END AS status,
   CASE WHEN count(DISTINCT pos) = 1 THEN min(type) WHEN min(kind) = 'model-stream' THEN concat('model stream (', cast(count(DISTINCT pos) AS @text), ')') ELSE concat('low-level events (', cast(count(DISTINCT pos) AS @text), ')') END AS label,
   CASE WHEN min(type) = max(type) THEN min(type) ELSE 'multiple' END AS type, min(pos) AS first_pos, collect_set(type) AS types FROM f GROUP BY run_id, grp),
nodes AS (SELECT * FROM all_nodes WHERE @shown),
visible AS (SELECT f.run_id, f.event_id, f.pos, a.node_id, a.first_timestamp, a.first_sequence FROM f JOIN all_nodes a ON f.run_id = a.run_id AND f.grp = a.grp LEFT SEMI JOIN nodes n ON n.run_id = a.run_id AND n.node_id = a.node_id),
owners AS (SELECT run_id, event_id, max_by(struct(node_id, first_timestamp, first_sequence), pos) AS o FROM visible GROUP BY run_id, event_id),
parents AS (SELECT DISTINCT f.run_id, o.node_id AS from_id, n.node_id AS to_id, o.first_timestamp AS t, o.first_sequence AS q
   FROM f JOIN nodes n ON f.run_id = n.run_id AND f.grp = n.grp JOIN owners w ON f.run_id = w.run_id AND f.parent_id = w.event_id),
edges AS (SELECT * FROM parents WHERE from_id <> to_id)"""
GROUPS = GROUPS_OF.replace("@shown", "true")
TREE = "SELECT run_id, from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, to_id ORDER BY t COLLATE UNICODE, q, from_id COLLATE UNICODE) AS k FROM parents) x WHERE k = 1 AND from_id <> to_id"
CALLS = """
c AS (SELECT *, CASE WHEN type LIKE 'model.%' THEN 'model' WHEN type LIKE 'tool.%' THEN 'tool' END AS kind FROM te),
req AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind, correlation_key ORDER BY sequence) AS attempt FROM c WHERE type LIKE '%.requested'),
fin AS (SELECT *, row_number() OVER (PARTITION BY run_id, correlation_key ORDER BY sequence DESC) AS back FROM c WHERE type LIKE '%.completed' OR type LIKE '%.failed')"""
RULES = {
    "val_duplicate_ids": "SELECT run_id, 'DUPLICATE_EVENT_ID' AS code, 'error' AS severity, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, event_id ORDER BY pos) AS k FROM tf) x WHERE k > 1",
    "val_sequence": """SELECT run_id, CASE WHEN sequence <= before THEN 'SEQUENCE_NOT_INCREASING' ELSE 'SEQUENCE_GAP' END AS code, 'error' AS severity, pos
 FROM (SELECT *, lag(sequence, 1, 0) OVER (PARTITION BY run_id ORDER BY pos) AS before FROM tf) x WHERE sequence <> before + 1""",
    "val_parent_missing": "SELECT c.run_id, 'BROKEN_PARENT_REFERENCE' AS code, 'error' AS severity, c.pos FROM tf c LEFT JOIN (SELECT DISTINCT run_id, event_id FROM tf) p ON c.run_id = p.run_id AND c.parent_id = p.event_id WHERE c.parent_id IS NOT NULL AND p.event_id IS NULL",
    "val_parent_not_earlier": "SELECT c.run_id, 'MISSING_PARENT_EVENT' AS code, 'error' AS severity, c.pos FROM tf c LEFT JOIN (SELECT run_id, event_id, min(pos) AS first_pos FROM tf GROUP BY run_id, event_id) p ON c.run_id = p.run_id AND c.parent_id = p.event_id WHERE c.parent_id IS NOT NULL AND (p.first_pos IS NULL OR p.first_pos >= c.pos)",
    "val_unknown_types": f"SELECT run_id, 'UNKNOWN_EVENT_TYPE' AS code, 'warning' AS severity, pos FROM tf WHERE type NOT IN ({KNOWN})",
    "val_manifest_counts": """SELECT run_id, code, 'error' AS severity, cast(-1 AS bigint) AS pos FROM (
  SELECT mf.run_id, CASE WHEN event_count <> coalesce(n, 0) THEN 'EVENT_COUNT_MISMATCH' END AS code FROM mf LEFT JOIN (SELECT run_id, count(DISTINCT pos) AS n FROM te GROUP BY run_id) c ON mf.run_id = c.run_id
  UNION ALL SELECT mf.run_id, CASE WHEN last_sequence <> coalesce(m, 0) THEN 'LAST_SEQUENCE_MISMATCH' END FROM mf LEFT JOIN (SELECT run_id, max_by(sequence, pos) AS m FROM te GROUP BY run_id) c ON mf.run_id = c.run_id) x WHERE code IS NOT NULL""",
    "val_orphan_roots": """SELECT mf.run_id, 'MISSING_ROOT_EVENT' AS code, 'error' AS severity, cast(-1 AS bigint) AS pos FROM mf LEFT JOIN te ON mf.run_id = te.run_id AND mf.root_event_id = te.event_id WHERE te.event_id IS NULL
 UNION ALL SELECT te.run_id, 'ORPHAN_ROOT_EVENT', 'warning', pos FROM te JOIN mf ON mf.run_id = te.run_id WHERE te.parent_id IS NULL AND te.event_id <> mf.root_event_id""",
    "val_checkpoint_refs": "SELECT ck.run_id, 'MISSING_CHECKPOINT_EVENT' AS code, 'error' AS severity, ck.sequence - 1 AS pos FROM ck LEFT JOIN te ON ck.run_id = te.run_id AND ck.last_event_id = te.event_id WHERE te.event_id IS NULL",
    "val_completeness": "SELECT run_id, CASE completeness WHEN 'partial' THEN 'SNAPSHOT_PARTIAL' ELSE 'SNAPSHOT_COMPLETENESS_UNKNOWN' END AS code, 'warning' AS severity, cast(-1 AS bigint) AS pos FROM mf WHERE schema_version = '0.2.0' AND completeness <> 'complete'",
}

PLANS: dict[str, tuple[tuple[str, ...], str]] = {
    "inspect_summary": (("te",), """
SELECT run_id, count(*) AS event_count, cast(sum(CASE WHEN type = 'model.requested' THEN 1 ELSE 0 END) AS bigint) AS model_calls, cast(sum(CASE WHEN type = 'tool.requested' THEN 1 ELSE 0 END) AS bigint) AS tool_calls,
 cast(sum(CASE WHEN type LIKE '%.failed' THEN 1 ELSE 0 END) AS bigint) AS failure_count, count(DISTINCT actor) AS actor_count, count(DISTINCT type) AS type_count, min_by(sequence, pos) AS first_sequence, max_by(sequence, pos) AS last_sequence,
 min_by(timestamp, pos) AS first_timestamp, max_by(timestamp, pos) AS last_timestamp, greatest(0.0e0, max_by(offset_ms, pos) - min_by(offset_ms, pos)) AS duration_ms FROM te GROUP BY run_id"""),
    "inspect_event_types": (("te",), "SELECT run_id, type, count(*) AS n FROM te GROUP BY run_id, type"),
    "inspect_actors": (("te",), "SELECT run_id, actor, count(*) AS n, min(pos) AS first_pos FROM te GROUP BY run_id, actor"),
    "inspect_errors": (("te",), "SELECT run_id, event_id, type, sequence, coalesce(error_code, 'UNKNOWN_ERROR') AS code FROM te WHERE type LIKE '%.failed'"),
    "find_by_type": (("te",), "SELECT run_id, event_id, sequence FROM te WHERE type = 'tool.failed'"),
    "find_by_actor": (("te",), "SELECT run_id, event_id, sequence FROM te WHERE actor = 'actor_3'"),
    "find_seq_range": (("te",), "SELECT run_id, event_id, sequence FROM te WHERE sequence >= 5 AND sequence <= 9"),
    "find_time_range": (("te",), "SELECT run_id, event_id, timestamp FROM te WHERE timestamp > '2024-01-03T00:00:00.000000Z' AND timestamp < '2024-01-06T00:00:00.000000Z'"),
    "get_event": (("tf",), "SELECT run_id, event_id, pos, type FROM (SELECT *, row_number() OVER (PARTITION BY run_id, event_id ORDER BY pos) AS k FROM tf) x WHERE k = 1"),
    "get_parents": (("dt",), "SELECT c.run_id, c.event_id, p.event_id AS parent_event_id, p.type AS parent_type FROM dt c JOIN (SELECT run_id, event_id, min_by(type, pos) AS type FROM dt GROUP BY run_id, event_id) p ON c.run_id = p.run_id AND c.parent_id = p.event_id"),
    "get_children": (("dt",), "SELECT p.run_id, p.event_id, c.event_id AS child_event_id FROM (SELECT DISTINCT run_id, event_id FROM dt) p JOIN dt c ON c.run_id = p.run_id AND c.parent_id = p.event_id"),
    "child_counts": (("dt",), "SELECT run_id, parent_id, count(DISTINCT event_id) AS n_children FROM dt WHERE parent_id IS NOT NULL GROUP BY run_id, parent_id"),
    "root_events": (("te", "mf"), """
WITH r AS (SELECT te.run_id, te.event_id, te.pos, te.parent_id, CASE WHEN te.event_id = mf.root_event_id THEN 1 ELSE 0 END AS declared FROM te JOIN mf ON te.run_id = mf.run_id),
m AS (SELECT *, max(declared) OVER (PARTITION BY run_id) AS has FROM r) SELECT run_id, event_id FROM m WHERE (has = 1 AND declared = 1) OR (has = 0 AND parent_id IS NULL)"""),
    "fold_groups": (("te",), f"WITH {GROUPS} SELECT run_id, node_id, n_events, first_sequence, last_sequence, label FROM nodes"),
    "graph_nodes": (("te",), f"WITH {GROUPS} SELECT run_id, node_id, n_events, first_sequence, last_sequence, first_timestamp, last_timestamp, actor, type, status, label FROM nodes"),
    "node_members": (("te",), f"WITH {GROUPS} SELECT DISTINCT nodes.run_id, nodes.node_id, f.event_id, f.pos, f.type, f.actor FROM f JOIN nodes ON nodes.run_id = f.run_id AND nodes.grp = f.grp"),
    "graph_filtered_nodes": (("te",), f"WITH {GROUPS} SELECT run_id, node_id, status FROM nodes WHERE status IN ('failed', 'started') AND last_sequence >= 3 AND first_sequence <= 20 AND actor IN ('actor_1', 'actor_2', 'multiple')"),
    "dag_edges": (("te",), f"WITH {GROUPS} SELECT DISTINCT run_id, from_id, to_id FROM edges"),
    "graph_filtered_edges": (("te",), f"WITH {GROUPS_OF.replace('@shown', "status <> 'started'")} SELECT DISTINCT run_id, from_id, to_id FROM edges"),
    "tree_edges": (("te",), f"WITH {GROUPS} {TREE}"),
    **{f"{k}_repeated_ids": (("tr",), f"WITH {GROUPS_OF.replace('@shown', shown)} {rest}".replace("FROM te)", "FROM tr)")) for k, shown, rest in (
        ("dag_edges", "true", "SELECT DISTINCT run_id, from_id, to_id FROM edges"), ("tree_edges", "true", TREE), ("graph_filtered_edges", "status <> 'started'", "SELECT DISTINCT run_id, from_id, to_id FROM edges"))},
    "timeline_edges": (("te",), f"WITH {GROUPS} SELECT run_id, node_id AS from_id, to_id FROM (SELECT *, lead(node_id) OVER (PARTITION BY run_id ORDER BY first_timestamp COLLATE UNICODE, first_sequence, node_id COLLATE UNICODE) AS to_id FROM nodes) x WHERE to_id IS NOT NULL"),
    "mermaid_lines": (("te",), f"""WITH {GROUPS}, own AS (SELECT run_id, grp, pos, event_id FROM f GROUP BY run_id, grp, pos, event_id),
k AS (SELECT n.run_id, n.node_id, concat(n.label, ' [', o.ids, ']') AS label, row_number() OVER (PARTITION BY n.run_id ORDER BY n.first_pos) AS i FROM nodes n JOIN (SELECT run_id, grp, @joined(event_id, pos) AS ids FROM own GROUP BY run_id, grp) o ON o.run_id = n.run_id AND o.grp = n.grp)
SELECT run_id, concat('  node_', cast(i AS @text), '["', replace(replace(replace(replace(replace(replace(label, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'), chr(13), ' '), chr(10), ' '), '"]') AS line FROM k
UNION ALL SELECT e.run_id, concat('  node_', cast(a.i AS @text), ' -->|causal| node_', cast(b.i AS @text)) FROM (SELECT DISTINCT run_id, from_id, to_id FROM edges) e JOIN k a ON a.run_id = e.run_id AND a.node_id = from_id JOIN k b ON b.run_id = e.run_id AND b.node_id = to_id"""),
    "dag_fan_in": (("dt",), "SELECT run_id, event_id, count(*) AS n_parents, min(parent_id) AS primary_parent FROM dt WHERE parent_id IS NOT NULL GROUP BY run_id, event_id HAVING count(*) > 1"),
    **{k: (tuple(v for v in ("tf", "te", "mf", "ck") if f" {v}" in t), t) for k, t in RULES.items()},
    "val_all": (("tf", "te", "mf", "ck"), "SELECT code, severity, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM (" + " UNION ALL ".join(f"SELECT * FROM ({t}) r{k}" for k, t in enumerate(RULES.values())) + ") x GROUP BY code, severity"),
    "run_validity": (("tf", "te", "mf", "ck"), "SELECT run_id, cast(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS bigint) AS errors, cast(sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS bigint) AS warnings, max(severity) <> 'error' AND min(severity) <> 'error' AS valid FROM (" + " UNION ALL ".join(f"SELECT * FROM ({t}) r{k}" for k, t in enumerate(RULES.values())) + ") x GROUP BY run_id"),
    "call_attempts": (("te",), f"WITH {CALLS} SELECT run_id, kind, correlation_key, event_id, attempt FROM req"),
    "call_pairs": (("te",), f"""WITH {CALLS}, last_req AS (SELECT run_id, correlation_key, max(sequence) AS start_sequence, count(*) AS n_requests FROM req GROUP BY run_id, correlation_key)
SELECT r.run_id, r.correlation_key, r.start_sequence, r.n_requests, fin.sequence AS end_sequence, fin.type AS outcome FROM last_req r LEFT JOIN fin ON r.run_id = fin.run_id AND r.correlation_key = fin.correlation_key AND fin.back = 1"""),
    "recorded_outcomes": (("ct",), "SELECT q.run_id, q.event_id AS request_id, r.event_id AS response_id, CASE WHEN r.event_id IS NULL THEN 'missing' ELSE 'recorded' END AS outcome FROM ct q LEFT JOIN (SELECT * FROM ct WHERE type = 'model.completed') r ON r.run_id = q.run_id AND r.parent_id = q.event_id WHERE q.type = 'model.requested'"),
    "missing_outcomes": (("ct",), "SELECT q.run_id, q.event_id FROM ct q LEFT JOIN (SELECT * FROM ct WHERE type = 'model.completed') r ON r.run_id = q.run_id AND r.parent_id = q.event_id WHERE q.type = 'model.requested' AND r.event_id IS NULL"),
    "retry_summary": (("te",), f"""WITH {CALLS}, a AS (SELECT run_id, correlation_key, count(*) AS attempts FROM req GROUP BY run_id, correlation_key),
b AS (SELECT run_id, correlation_key, max(CASE WHEN type LIKE '%.completed' THEN 1 ELSE 0 END) AS completed, cast(sum(CASE WHEN type LIKE '%.failed' THEN 1 ELSE 0 END) AS bigint) AS failures FROM fin GROUP BY run_id, correlation_key)
SELECT a.run_id, a.correlation_key, attempts, coalesce(failures, 0) AS failures, CASE WHEN coalesce(failures, 0) = 0 THEN 'none' WHEN completed = 1 THEN 'retry_merged' ELSE 'terminal_failure_merged' END AS merged FROM a LEFT JOIN b ON a.run_id = b.run_id AND a.correlation_key = b.correlation_key"""),
    "compile_nodes": (("te",), f"""WITH {CALLS}, t AS (SELECT run_id, kind, correlation_key, min(sequence) AS first_sequence, count(*) AS max_attempts FROM req GROUP BY run_id, kind, correlation_key),
o AS (SELECT run_id, kind, correlation_key, max(CASE WHEN type LIKE '%.completed' THEN 1 ELSE 0 END) AS completed FROM fin GROUP BY run_id, kind, correlation_key)
SELECT t.run_id, concat('node_', t.kind, '_', cast(row_number() OVER (PARTITION BY t.run_id ORDER BY first_sequence) AS @text)) AS node_id, t.correlation_key, max_attempts, CASE WHEN coalesce(completed, 0) = 1 THEN 'stop' ELSE 'continue' END AS on_failure
FROM t LEFT JOIN o ON t.run_id = o.run_id AND t.kind = o.kind AND t.correlation_key = o.correlation_key"""),
    "compile_deps": (("ct",), "SELECT a.run_id, concat('node_model_', cast(a.k AS @text)) AS node_id, concat('node_model_', cast(a.k - 1 AS @text)) AS depends_on FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS k FROM ct WHERE type = 'model.requested') a WHERE a.k > 1"),
    "export_spans": (("te",), f"""WITH {CALLS}, p AS (SELECT run_id, correlation_key, max(sequence) AS start_sequence, max_by(kind, sequence) AS kind FROM req GROUP BY run_id, correlation_key)
SELECT trace_id, substr(@sha256(text), 1, 16) AS span_id, start_sequence, end_sequence, status_code FROM (
 SELECT t.trace_id, concat('span:', p.run_id, ':', p.kind, ':', p.correlation_key) AS text, p.start_sequence, fin.sequence AS end_sequence, CASE WHEN fin.type LIKE '%.failed' THEN 3 WHEN fin.type IS NULL THEN 0 ELSE 2 END AS status_code
 FROM p JOIN (SELECT run_id, substr(@sha256(text), 1, 32) AS trace_id FROM (SELECT DISTINCT run_id, concat('trace:', run_id) AS text FROM te) x) t ON t.run_id = p.run_id LEFT JOIN fin ON p.run_id = fin.run_id AND p.correlation_key = fin.correlation_key AND fin.back = 1) y"""),
    "export_links": (("dt",), "SELECT run_id, event_id, parent_id AS linked FROM (SELECT *, row_number() OVER (PARTITION BY run_id, event_id ORDER BY substr(md5(parent_id), 1, 16), parent_id) AS k FROM dt WHERE parent_id IS NOT NULL) x WHERE k > 1"),
    "export_losses": (("dt",), "SELECT run_id, 'multiple_parents_collapsed' AS code, cast(sum(n - 1) AS bigint) AS n FROM (SELECT run_id, event_id, count(*) AS n FROM dt WHERE parent_id IS NOT NULL GROUP BY run_id, event_id HAVING count(*) > 1) x GROUP BY run_id"),
    "export_batches": (("sp",), "SELECT trace_id, batch, count(*) AS n_spans, min(start_ns) AS first_ns FROM (SELECT *, cast(floor((row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id, n) - 1) / 16) AS bigint) AS batch FROM sp) x GROUP BY trace_id, batch"),
    "otlp_dedup": (("sp",), "SELECT trace_id, span_id, count(*) AS copies, min(start_ns) AS start_ns FROM sp GROUP BY trace_id, span_id"),
    "otlp_conflicts": (("sp",), "SELECT trace_id, span_id, count(DISTINCT start_ns) AS versions FROM sp GROUP BY trace_id, span_id HAVING count(DISTINCT start_ns) > 1"),
    "otlp_missing_parents": (("sp",), "SELECT c.trace_id, c.span_id, CASE WHEN c.parent_span_id = c.span_id THEN 'self_parent' ELSE 'missing_parent' END AS code, c.n FROM sp c LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM sp) p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE c.parent_span_id IS NOT NULL AND (p.span_id IS NULL OR c.parent_span_id = c.span_id)"),
    "otlp_completeness": (("sp",), """WITH b AS (SELECT c.trace_id, max(CASE WHEN c.parent_span_id IS NOT NULL AND (p.span_id IS NULL OR c.parent_span_id = c.span_id) THEN 1 ELSE 0 END) AS limited, min(c.start_ns) AS first_ns, max(c.end_ns) AS last_ns, max(CASE WHEN c.parent_span_id IS NULL THEN 1 ELSE 0 END) AS rooted
 FROM sp c LEFT JOIN (SELECT DISTINCT trace_id, span_id FROM sp) p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id GROUP BY c.trace_id)
SELECT trace_id, CASE WHEN limited = 1 OR rooted = 0 THEN 'partial' ELSE 'unknown' END AS completeness, first_ns, last_ns FROM b"""),
    "otlp_order": (("sp",), "SELECT trace_id, span_id, n, row_number() OVER (PARTITION BY trace_id ORDER BY start_ns, span_id, n) + 1 AS sequence FROM sp"),
    "artifact_digests": (("ar",), "SELECT doc_id, digest, byte_length FROM ar"),
    "artifact_dedup": (("ar",), "SELECT digest, count(*) AS refs, min(byte_length) AS byte_length FROM ar GROUP BY digest"),
    "artifact_metadata": (("ar",), "SELECT digest, count(DISTINCT media_type) AS n_media, CASE WHEN count(DISTINCT byte_length) = 1 THEN min(byte_length) END AS byte_length, min(media_type) AS first_media FROM ar GROUP BY digest"),
    "artifact_join": (("rf", "fl"), "SELECT coalesce(r.digest, f.digest) AS digest, CASE WHEN f.digest IS NULL THEN 'MISSING_ARTIFACT' WHEN r.digest IS NULL THEN 'UNREFERENCED' WHEN r.byte_length <> f.byte_length THEN 'ARTIFACT_SIZE_MISMATCH' ELSE 'ok' END AS state FROM rf r FULL JOIN fl f ON r.digest = f.digest"),
    "state_lww": (("te",), "SELECT run_id, type AS path, max_by(value, sequence) AS value, count(*) AS writes FROM te GROUP BY run_id, type"),
    "latest_valid_checkpoint": (("ck", "te"), "SELECT run_id, checkpoint_id, sequence FROM (SELECT ck.*, row_number() OVER (PARTITION BY ck.run_id ORDER BY ck.sequence DESC) AS k FROM ck JOIN te ON te.run_id = ck.run_id AND te.sequence = ck.sequence AND te.event_id = ck.last_event_id WHERE ck.hash_ok) x WHERE k = 1"),
    "eligibility": (("mf",), "SELECT run_id, CASE WHEN schema_version = '0.1.0' THEN 'native' WHEN source IN ('native', 'otel-import') AND schema_version = '0.2.0' THEN source ELSE 'otel-import' END AS source, schema_version = '0.1.0' OR (schema_version = '0.2.0' AND source = 'native' AND completeness = 'complete' AND coalesce(n_limitations, 0) = 0) AS executable FROM mf"),
    "migrated_manifest": (("mf",), "SELECT run_id, CASE WHEN schema_version IN ('0.0.0', '0.1.0') THEN '0.2.0' ELSE schema_version END AS schema_version, schema_version <> '0.2.0' AS migrated FROM mf"),
    "policy_decisions": (("te",), """SELECT run_id, event_id, CASE WHEN first_rule IN (2, 3) THEN 'allow' ELSE 'deny' END AS effect, first_rule
FROM (SELECT run_id, event_id, CASE WHEN type = 'tool.requested' THEN 1 WHEN actor = 'actor_1' THEN 2 WHEN type = 'model.requested' THEN 3 END AS first_rule FROM te WHERE type LIKE '%.requested') x"""),
    "compatibility": (("mf",), "SELECT run_id, CASE schema_version WHEN '0.2.0' THEN 'executable' WHEN '0.1.0' THEN 'migratable' WHEN '0.0.0' THEN 'migratable' ELSE 'view_only' END AS status, schema_version IN ('0.1.0', '0.2.0') AS readable, schema_version = '0.2.0' AS can_execute FROM mf"),
    "diff_outputs": (("oa", "ob"), """SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.sequence, b.sequence) AS sequence, CASE WHEN a.run_id IS NULL THEN 'unexpected' WHEN b.run_id IS NULL THEN 'missing' ELSE 'changed' END AS kind
FROM oa a FULL JOIN ob b ON a.run_id = b.run_id AND a.sequence = b.sequence WHERE a.run_id IS NULL OR b.run_id IS NULL OR a.value <> b.value"""),
    "plan_comparison": (("pa", "pb"), """SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.k, b.k) AS k, CASE WHEN b.run_id IS NULL THEN 'missing_call' WHEN a.run_id IS NULL THEN 'unexpected_call' ELSE 'different_call' END AS code
FROM pa a FULL JOIN pb b ON a.run_id = b.run_id AND a.k = b.k WHERE a.run_id IS NULL OR b.run_id IS NULL OR a.type <> b.type OR a.correlation_key <> b.correlation_key"""),
    "unfinished_runs": (("mf", "te"), "SELECT mf.run_id, 'UNFINISHED_RUN' AS code FROM mf LEFT JOIN (SELECT run_id, count(*) AS n FROM te GROUP BY run_id) c ON c.run_id = mf.run_id WHERE mf.run_state <> 'finished' OR coalesce(c.n, 0) < mf.event_count"),
    "writer_rejects": (("tf",), "SELECT run_id, pos, sequence FROM (SELECT *, max(sequence) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tf) x WHERE sequence <= coalesce(top, 0)"),
}


def run(name: str, spark: SparkSession, fold: bool = True, shown: str = "true", **frames: DataFrame) -> DataFrame:
    """In plans of the projection: fold=False makes each event a node of its own, and only nodes for which shown holds stay."""
    text = PLANS[name][1] if fold else PLANS[name][1].replace(FOLD_KIND, "cast(NULL AS @text)")
    text = text.replace("nodes AS (SELECT * FROM all_nodes WHERE true)", f"nodes AS (SELECT * FROM all_nodes WHERE {shown})")
    return adapters.sql(spark, adapters.render(text, 0), **frames)


def query(name: str):
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, spark, **adapters.views(spark, sf_dir, PLANS[name][0]))

    return made


def nearest_call_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct = adapters.views(spark, sf_dir, ("ct",))["ct"]
    owned = ct.where("type = 'model.completed'").selectExpr("run_id", "event_id", "event_id AS owner")
    return ancestors.nearest_owned(ct, owned, ct.where("type = 'model.requested'")).withColumnRenamed("owner", "ancestor_id")


def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ancestors.closure(adapters.views(spark, sf_dir, ("ct",))["ct"])


QUERIES = {**{name: query(name) for name in PLANS}, "nearest_call_ancestor": nearest_call_ancestor, "ancestor_closure": ancestor_closure}

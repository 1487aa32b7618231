"""SQL for DuckDB that the declarative operators are held against, written apart from them: by other joins, lists and subqueries, from the rules."""

from __future__ import annotations

from ..sources import adapters

#: Nodes of the projection: running heads of folds, then lists of each group's events.
NODES = r"""
k AS (SELECT *, CASE WHEN regexp_matches(type, '^model\.') AND regexp_matches(type, '(delta|stream|chunk|token|partial|segment)') THEN 'm' WHEN regexp_matches(type, '^(span|telemetry|trace|log|debug|internal|stream)\.') THEN 'l' END AS fold FROM te),
b AS (SELECT k.*, j.fold AS prev FROM k LEFT JOIN k j ON j.run_id = k.run_id AND j.pos = k.pos - 1),
h AS (SELECT *, max(pos) FILTER (WHERE fold IS NULL OR fold IS DISTINCT FROM prev) OVER (PARTITION BY run_id ORDER BY pos) AS head FROM b),
nd AS (SELECT run_id, head, list(event_id ORDER BY pos) AS ids, list(pos ORDER BY pos) AS places, list(sequence ORDER BY pos) AS seqs, list(timestamp ORDER BY pos) AS times, list(DISTINCT actor) AS actors, list(DISTINCT type) AS types, first(type ORDER BY pos) AS t0,
  bool_or(ends_with(type, '.failed')) AS failed, bool_or(ends_with(type, '.completed')) AS done, first(fold) AS fold FROM h GROUP BY run_id, head),
nn AS (SELECT run_id, head, ids, places, if(len(ids) > 1, 'group:' || ids[1], ids[1]) AS node_id, len(ids) AS n_events, seqs[1] AS first_sequence, seqs[-1] AS last_sequence, times[1] AS first_timestamp, times[-1] AS last_timestamp,
  if(len(actors) = 1, actors[1], 'multiple') AS actor, if(len(types) = 1, types[1], 'multiple') AS type, if(len(ids) = 1, t0, if(fold = 'm', 'model stream (', 'low-level events (') || len(ids) || ')') AS label,
  CASE WHEN failed THEN 'failed' WHEN done THEN 'completed' WHEN t0 = 'state.changed' THEN 'changed' WHEN t0 = 'decision.recorded' THEN 'recorded' WHEN t0 = 'checkpoint.created' THEN 'checkpointed' WHEN t0 = 'run.started' OR ends_with(t0, '.requested') THEN 'started' ELSE 'unknown' END AS status FROM nd),
mm AS (SELECT run_id, node_id, first_timestamp, first_sequence, unnest(ids) AS event_id, unnest(places) AS pos, status FROM nn),
last_of AS (SELECT DISTINCT ON (run_id, event_id) * FROM mm ORDER BY run_id, event_id, pos DESC),
ee AS (SELECT DISTINCT te.run_id, u.node_id AS from_id, d.node_id AS to_id, u.first_timestamp AS t, u.first_sequence AS q FROM te JOIN mm d USING (run_id, pos) JOIN last_of u ON (u.run_id, u.event_id) = (te.run_id, te.parent_id))"""
REPEATED = NODES.replace("FROM te)", "FROM tr)").replace("FROM te JOIN", "FROM tr te JOIN")
REQ, FIN = "ends_with(type, '.requested')", "(ends_with(type, '.completed') OR ends_with(type, '.failed'))"
KIND = "split_part(type, '.', 1)"
KNOWN = "['run.started', 'run.completed', 'run.failed', 'run.observed', 'model.requested', 'model.completed', 'model.failed', 'tool.requested', 'tool.completed', 'tool.failed', 'decision.recorded', 'state.changed', 'checkpoint.created', 'verification.completed', 'otel.span']"

RULES = {
    "val_duplicate_ids": "SELECT run_id, 'DUPLICATE_EVENT_ID' AS code, 'error' AS severity, pos FROM tf WHERE EXISTS (SELECT 1 FROM tf o WHERE o.run_id = tf.run_id AND o.event_id = tf.event_id AND o.pos < tf.pos)",
    "val_sequence": "SELECT a.run_id, if(a.sequence > coalesce(b.sequence, 0), 'SEQUENCE_GAP', 'SEQUENCE_NOT_INCREASING') AS code, 'error' AS severity, a.pos FROM tf a LEFT JOIN tf b ON b.run_id = a.run_id AND b.pos + 1 = a.pos WHERE a.sequence - coalesce(b.sequence, 0) <> 1",
    "val_parent_missing": "SELECT run_id, 'BROKEN_PARENT_REFERENCE' AS code, 'error' AS severity, pos FROM tf WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tf p WHERE p.run_id = tf.run_id AND p.event_id = tf.parent_id)",
    "val_parent_not_earlier": "SELECT run_id, 'MISSING_PARENT_EVENT' AS code, 'error' AS severity, pos FROM tf WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tf p WHERE p.run_id = tf.run_id AND p.event_id = tf.parent_id AND p.pos < tf.pos)",
    "val_unknown_types": f"SELECT run_id, 'UNKNOWN_EVENT_TYPE' AS code, 'warning' AS severity, pos FROM tf WHERE NOT list_contains({KNOWN}, type)",
    "val_manifest_counts": """SELECT run_id, unnest(list_filter([if(event_count <> coalesce((SELECT count(*) FROM te WHERE te.run_id = mf.run_id), 0), 'EVENT_COUNT_MISMATCH', NULL),
 if(last_sequence <> coalesce((SELECT arg_max(sequence, pos) FROM te WHERE te.run_id = mf.run_id), 0), 'LAST_SEQUENCE_MISMATCH', NULL)], lambda x: x IS NOT NULL)) AS code, 'error' AS severity, -1::BIGINT AS pos FROM mf""",
    "val_orphan_roots": """SELECT run_id, 'MISSING_ROOT_EVENT' AS code, 'error' AS severity, -1::BIGINT AS pos FROM mf WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.run_id = mf.run_id AND te.event_id = mf.root_event_id)
 UNION ALL SELECT run_id, 'ORPHAN_ROOT_EVENT', 'warning', pos FROM te WHERE parent_id IS NULL AND event_id <> (SELECT root_event_id FROM mf WHERE mf.run_id = te.run_id)""",
    "val_checkpoint_refs": "SELECT run_id, 'MISSING_CHECKPOINT_EVENT' AS code, 'error' AS severity, sequence - 1 AS pos FROM ck WHERE (run_id, last_event_id) NOT IN (SELECT (run_id, event_id) FROM te)",
    "val_completeness": "SELECT run_id, if(completeness = 'partial', 'SNAPSHOT_PARTIAL', 'SNAPSHOT_COMPLETENESS_UNKNOWN') AS code, 'warning' AS severity, -1::BIGINT AS pos FROM mf WHERE NOT (schema_version <> '0.2.0' OR completeness = 'complete')",
}
_ALL = " UNION ALL ".join(f"SELECT run_id, code, severity FROM ({t})" for t in RULES.values())

TEXTS: dict[str, tuple[tuple[str, ...], str]] = {
    "inspect_summary": (("te",), f"""SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE type = 'model.requested') AS model_calls, count(*) FILTER (WHERE type = 'tool.requested') AS tool_calls, count(*) FILTER (WHERE ends_with(type, '.failed')) AS failure_count,
 len(list(DISTINCT actor)) AS actor_count, len(list(DISTINCT type)) AS type_count, list(sequence ORDER BY pos)[1] AS first_sequence, list(sequence ORDER BY pos)[-1] AS last_sequence, list(timestamp ORDER BY pos)[1] AS first_timestamp, list(timestamp ORDER BY pos)[-1] AS last_timestamp,
 greatest(0, list(offset_ms ORDER BY pos)[-1] - list(offset_ms ORDER BY pos)[1])::DOUBLE AS duration_ms FROM te GROUP BY run_id"""),
    "inspect_event_types": (("te",), "SELECT DISTINCT run_id, type, count(*) OVER (PARTITION BY run_id, type) AS n FROM te"),
    "inspect_actors": (("te",), "SELECT DISTINCT run_id, actor, count(*) OVER w AS n, min(pos) OVER w AS first_pos FROM te WINDOW w AS (PARTITION BY run_id, actor)"),
    "inspect_errors": (("te",), "SELECT run_id, event_id, type, sequence, if(error_code IS NULL, 'UNKNOWN_ERROR', error_code) AS code FROM te WHERE split_part(type, '.', 2) = 'failed'"),
    "find_by_type": (("te",), "SELECT run_id, event_id, sequence FROM te WHERE type IN (SELECT type FROM te WHERE type LIKE 'tool.f%')"),
    "find_by_actor": (("te",), "SELECT run_id, event_id, sequence FROM te WHERE right(actor, 2) = '_3'"),
    "find_seq_range": (("te",), "SELECT run_id, event_id, sequence FROM te WHERE sequence IN (5, 6, 7, 8, 9)"),
    "find_time_range": (("te",), "SELECT run_id, event_id, timestamp FROM te WHERE left(timestamp, 10) IN ('2024-01-03', '2024-01-04', '2024-01-05') AND timestamp <> '2024-01-03T00:00:00.000000Z'"),
    "get_event": (("tf",), "SELECT DISTINCT ON (run_id, event_id) run_id, event_id, pos, type FROM tf ORDER BY run_id, event_id, pos"),
    "get_parents": (("dt",), "SELECT c.run_id, c.event_id, c.parent_id AS parent_event_id, first(p.type ORDER BY p.pos) AS parent_type FROM dt c, dt p WHERE p.run_id = c.run_id AND p.event_id = c.parent_id GROUP BY c.run_id, c.event_id, c.parent_id"),
    "get_children": (("dt",), "SELECT DISTINCT run_id, parent_id AS event_id, event_id AS child_event_id FROM dt WHERE (run_id, parent_id) IN (SELECT (run_id, event_id) FROM dt)"),
    "child_counts": (("dt",), "SELECT run_id, parent_id, len(list(DISTINCT event_id)) AS n_children FROM dt GROUP BY run_id, parent_id HAVING parent_id IS NOT NULL"),
    "root_events": (("te", "mf"), """SELECT run_id, event_id FROM te WHERE event_id = (SELECT root_event_id FROM mf WHERE mf.run_id = te.run_id)
 OR parent_id IS NULL AND NOT EXISTS (SELECT 1 FROM te t JOIN mf ON mf.run_id = t.run_id AND mf.root_event_id = t.event_id WHERE t.run_id = te.run_id)"""),
    "fold_groups": (("te",), f"WITH {NODES} SELECT run_id, node_id, n_events, first_sequence, last_sequence, label FROM nn"),
    "node_members": (("te",), f"WITH {NODES} SELECT mm.run_id, mm.node_id, mm.event_id, te.pos, te.type, te.actor FROM mm JOIN te USING (run_id, pos)"),
    "graph_nodes": (("te",), f"WITH {NODES} SELECT run_id, node_id, n_events, first_sequence, last_sequence, first_timestamp, last_timestamp, actor, type, status, label FROM nn"),
    "graph_filtered_nodes": (("te",), f"WITH {NODES} SELECT run_id, node_id, status FROM nn WHERE list_contains(['failed', 'started'], status) AND NOT (last_sequence < 3 OR first_sequence > 20) AND list_contains(['actor_1', 'actor_2', 'multiple'], actor)"),
    "dag_edges": (("te",), f"WITH {NODES} SELECT run_id, from_id, to_id FROM ee WHERE from_id <> to_id GROUP BY ALL"),
    "graph_filtered_edges": (("te",), f"WITH {NODES} SELECT DISTINCT run_id, from_id, to_id FROM ee WHERE from_id <> to_id AND NOT EXISTS (SELECT 1 FROM nn WHERE nn.run_id = ee.run_id AND nn.node_id IN (from_id, to_id) AND nn.status = 'started')"),
    "tree_edges": (("te",), f"WITH {NODES} SELECT run_id, from_id, to_id FROM (SELECT run_id, to_id, first(from_id ORDER BY t, q, from_id) AS from_id FROM ee GROUP BY run_id, to_id) WHERE from_id <> to_id"),
    "dag_edges_repeated_ids": (("tr",), f"WITH {REPEATED} SELECT run_id, from_id, to_id FROM ee WHERE from_id <> to_id GROUP BY ALL"),
    "tree_edges_repeated_ids": (("tr",), f"WITH {REPEATED} SELECT run_id, from_id, to_id FROM (SELECT run_id, to_id, first(from_id ORDER BY t, q, from_id) AS from_id FROM ee GROUP BY run_id, to_id) WHERE from_id <> to_id"),
    "graph_filtered_edges_repeated_ids": (("tr",), f"""WITH {REPEATED}, ids AS (SELECT run_id, node_id FROM mm WHERE status <> 'started'), stay AS (SELECT mm.* FROM mm WHERE (run_id, node_id) IN (SELECT (run_id, node_id) FROM ids)),
 up AS (SELECT run_id, event_id, arg_max(node_id, pos) AS from_id FROM stay GROUP BY run_id, event_id)
 SELECT DISTINCT d.run_id, up.from_id, d.node_id AS to_id FROM tr JOIN mm d ON d.run_id = tr.run_id AND d.pos = tr.pos AND d.status <> 'started' JOIN up ON up.run_id = tr.run_id AND up.event_id = tr.parent_id WHERE up.from_id <> d.node_id"""),
    "timeline_edges": (("te",), f"WITH {NODES}, l AS (SELECT run_id, list(node_id ORDER BY first_timestamp, first_sequence, node_id) AS ids FROM nn GROUP BY run_id), u AS (SELECT run_id, ids, unnest(range(1, len(ids))) AS i FROM l) SELECT run_id, ids[i] AS from_id, ids[i + 1] AS to_id FROM u"),
    "mermaid_lines": (("te",), f"""WITH {NODES}, l AS (SELECT run_id, list(struct_pack(id := node_id, label := label || ' [' || array_to_string(ids, ', ') || ']') ORDER BY head) AS x FROM nn GROUP BY run_id), v AS (SELECT run_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM l)
 SELECT run_id, '  node_' || i || '["' || regexp_replace(replace(replace(replace(replace(x.label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '[\\r\\n]', ' ', 'g') || '"]' AS line FROM v
 UNION ALL SELECT e.run_id, '  node_' || a.i || ' -->|causal| node_' || b.i FROM (SELECT DISTINCT run_id, from_id, to_id FROM ee WHERE from_id <> to_id) e JOIN v a ON a.run_id = e.run_id AND a.x.id = from_id JOIN v b ON b.run_id = e.run_id AND b.x.id = to_id"""),
    "dag_fan_in": (("dt",), "SELECT run_id, event_id, len(ps) AS n_parents, list_sort(ps)[1] AS primary_parent FROM (SELECT run_id, event_id, list(parent_id) FILTER (WHERE parent_id IS NOT NULL) AS ps FROM dt GROUP BY run_id, event_id) WHERE len(ps) > 1"),
    **{k: (tuple(v for v in ("tf", "te", "mf", "ck") if f" {v} " in f"{t} "), t) for k, t in RULES.items()},
    "val_all": (("tf", "te", "mf", "ck"), f"SELECT DISTINCT code, severity, count(*) OVER (PARTITION BY code, severity) AS n, len(list(DISTINCT run_id) OVER (PARTITION BY code, severity)) AS n_runs FROM ({_ALL})"),
    "run_validity": (("tf", "te", "mf", "ck"), f"SELECT run_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, NOT bool_or(severity = 'error') AS valid FROM ({_ALL}) GROUP BY run_id"),
    "call_attempts": (("te",), f"SELECT run_id, {KIND} AS kind, correlation_key, event_id, (SELECT count(*) FROM te o WHERE o.run_id = te.run_id AND o.correlation_key = te.correlation_key AND o.type = te.type AND o.sequence <= te.sequence) AS attempt FROM te WHERE {REQ}"),
    "call_pairs": (("te",), f"SELECT run_id, correlation_key, max(sequence) FILTER (WHERE {REQ}) AS start_sequence, count(*) FILTER (WHERE {REQ}) AS n_requests, max(sequence) FILTER (WHERE {FIN}) AS end_sequence, arg_max(type, sequence) FILTER (WHERE {FIN}) AS outcome FROM te GROUP BY run_id, correlation_key HAVING count(*) FILTER (WHERE {REQ}) > 0"),
    "recorded_outcomes": (("ct",), """SELECT run_id, request_id, unnest(if(len(rs) = 0, [NULL], rs)) AS response_id, if(len(rs) = 0, 'missing', 'recorded') AS outcome
 FROM (SELECT run_id, event_id AS request_id, (SELECT coalesce(list(r.event_id), []) FROM ct r WHERE r.run_id = q.run_id AND r.parent_id = q.event_id AND r.type = 'model.completed') AS rs FROM ct q WHERE type = 'model.requested')"""),
    "missing_outcomes": (("ct",), "SELECT run_id, event_id FROM ct WHERE type = 'model.requested' AND (run_id, event_id) NOT IN (SELECT (run_id, parent_id) FROM ct WHERE type = 'model.completed' AND parent_id IS NOT NULL)"),
    "retry_summary": (("te",), f"""SELECT run_id, correlation_key, count(*) FILTER (WHERE {REQ}) AS attempts, count(*) FILTER (WHERE ends_with(type, '.failed')) AS failures,
 CASE WHEN bool_or(ends_with(type, '.failed')) THEN if(bool_or(ends_with(type, '.completed')), 'retry_merged', 'terminal_failure_merged') ELSE 'none' END AS merged FROM te GROUP BY run_id, correlation_key HAVING bool_or({REQ})"""),
    "nearest_call_ancestor": (("ct",), """WITH @recursive walk AS (SELECT run_id, event_id, parent_id AS at FROM ct WHERE type = 'model.requested' AND parent_id IS NOT NULL
 UNION SELECT w.run_id, w.event_id, c.parent_id FROM walk w JOIN ct c ON c.run_id = w.run_id AND c.event_id = w.at AND c.type <> 'model.completed' AND c.parent_id IS NOT NULL)
SELECT w.run_id, w.event_id, w.at AS ancestor_id FROM walk w WHERE EXISTS (SELECT 1 FROM ct c WHERE c.run_id = w.run_id AND c.event_id = w.at AND c.type = 'model.completed')"""),
    "ancestor_closure": (("ct",), """WITH @recursive walk AS (SELECT run_id, event_id, parent_id AS ancestor_id, 1 AS depth FROM ct WHERE parent_id IS NOT NULL
 UNION ALL SELECT w.run_id, w.event_id, c.parent_id, w.depth + 1 FROM walk w JOIN ct c ON c.run_id = w.run_id AND c.event_id = w.ancestor_id WHERE c.parent_id IS NOT NULL)
SELECT run_id, event_id, ancestor_id, min(depth) AS depth FROM walk GROUP BY run_id, event_id, ancestor_id"""),
    "compile_nodes": (("te",), f"""SELECT run_id, 'node_' || kind || '_' || rank() OVER (PARTITION BY run_id ORDER BY s) AS node_id, correlation_key, m AS max_attempts, if(done, 'stop', 'continue') AS on_failure
 FROM (SELECT run_id, {KIND} AS kind, correlation_key, min(sequence) FILTER (WHERE {REQ}) AS s, count(*) FILTER (WHERE {REQ}) AS m, bool_or(ends_with(type, '.completed')) AS done FROM te WHERE {REQ} OR {FIN} GROUP BY ALL) WHERE m > 0"""),
    "compile_deps": (("ct",), "SELECT run_id, 'node_model_' || (i + 1) AS node_id, 'node_model_' || i AS depends_on FROM (SELECT run_id, unnest(range(1, count(*))) AS i FROM ct WHERE type = 'model.requested' GROUP BY run_id)"),
    "export_spans": (("te",), f"""SELECT sha256('trace:' || run_id)[:32] AS trace_id, sha256('span:' || run_id || ':' || kind || ':' || correlation_key)[:16] AS span_id, s AS start_sequence, e AS end_sequence, CASE WHEN e IS NULL THEN 0 WHEN ends_with(o, '.failed') THEN 3 ELSE 2 END AS status_code
 FROM (SELECT run_id, correlation_key, arg_max({KIND}, sequence) FILTER (WHERE {REQ}) AS kind, max(sequence) FILTER (WHERE {REQ}) AS s, max(sequence) FILTER (WHERE {FIN}) AS e, arg_max(type, sequence) FILTER (WHERE {FIN}) AS o FROM te GROUP BY run_id, correlation_key) WHERE s IS NOT NULL"""),
    "export_links": (("dt",), "SELECT run_id, event_id, unnest(ps[2:]) AS linked FROM (SELECT run_id, event_id, list(parent_id ORDER BY md5(parent_id)[:16], parent_id) FILTER (WHERE parent_id IS NOT NULL) AS ps FROM dt GROUP BY run_id, event_id)"),
    "export_losses": (("dt",), "SELECT run_id, 'multiple_parents_collapsed' AS code, (count(*) - count(DISTINCT event_id))::BIGINT AS n FROM dt WHERE parent_id IS NOT NULL GROUP BY run_id HAVING count(*) > count(DISTINCT event_id)"),
    "export_batches": (("sp",), """SELECT trace_id, (i - 1) // 16 AS batch, count(*) AS n_spans, min(x.s) AS first_ns FROM (SELECT trace_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT trace_id, list(struct_pack(s := start_ns) ORDER BY start_ns, span_id, n) AS l FROM sp GROUP BY trace_id)) GROUP BY ALL"""),
    "otlp_dedup": (("sp",), "SELECT DISTINCT trace_id, span_id, count(*) OVER w AS copies, min(start_ns) OVER w AS start_ns FROM sp WINDOW w AS (PARTITION BY trace_id, span_id)"),
    "otlp_conflicts": (("sp",), "SELECT trace_id, span_id, len(v) AS versions FROM (SELECT trace_id, span_id, list(DISTINCT start_ns) AS v FROM sp GROUP BY trace_id, span_id) WHERE len(v) > 1"),
    "otlp_missing_parents": (("sp",), "SELECT trace_id, span_id, if(parent_span_id = span_id, 'self_parent', 'missing_parent') AS code, n FROM sp WHERE parent_span_id = span_id OR parent_span_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sp p WHERE p.trace_id = sp.trace_id AND p.span_id = sp.parent_span_id)"),
    "otlp_completeness": (("sp",), """SELECT trace_id, if(bool_and(parent_span_id IS NOT NULL) OR bool_or(parent_span_id = span_id OR parent_span_id IS NOT NULL AND NOT list_contains(ids, parent_span_id)), 'partial', 'unknown') AS completeness, min(start_ns) AS first_ns, max(end_ns) AS last_ns
 FROM (SELECT *, list(span_id) OVER (PARTITION BY trace_id) AS ids FROM sp) GROUP BY trace_id"""),
    "otlp_order": (("sp",), "SELECT trace_id, x.s AS span_id, x.n AS n, i + 1 AS sequence FROM (SELECT trace_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT trace_id, list(struct_pack(s := span_id, n := n) ORDER BY start_ns, span_id, n) AS l FROM sp GROUP BY trace_id))"),
    "artifact_digests": ((), "SELECT doc_id, sha256(text) AS digest, strlen(text) AS byte_length FROM documents WHERE text IS NOT NULL"),
    "artifact_dedup": ((), "SELECT sha256(text) AS digest, sum(1)::BIGINT AS refs, strlen(text) AS byte_length FROM documents WHERE text IS NOT NULL GROUP BY text"),
    "artifact_metadata": ((), "SELECT sha256(text) AS digest, len(list(DISTINCT lang)) AS n_media, strlen(text) AS byte_length, list_sort(list(lang))[1] AS first_media FROM documents WHERE text IS NOT NULL GROUP BY text"),
    "artifact_join": (("rf", "fl"), """SELECT digest, if(fl.byte_length = rf.byte_length, 'ok', 'ARTIFACT_SIZE_MISMATCH') AS state FROM rf JOIN fl USING (digest)
 UNION ALL SELECT digest, 'MISSING_ARTIFACT' FROM rf WHERE digest NOT IN (SELECT digest FROM fl) UNION ALL SELECT digest, 'UNREFERENCED' FROM fl WHERE digest NOT IN (SELECT digest FROM rf)"""),
    "state_lww": (("te",), "SELECT run_id, type AS path, list(value ORDER BY sequence)[-1] AS value, count(*) AS writes FROM te GROUP BY run_id, type"),
    "latest_valid_checkpoint": (("ck", "te"), "SELECT DISTINCT ON (run_id) run_id, checkpoint_id, sequence FROM ck WHERE hash_ok AND (run_id, sequence, last_event_id) IN (SELECT (run_id, sequence, event_id) FROM te) ORDER BY run_id, sequence DESC"),
    "eligibility": (("mf",), """SELECT run_id, if(schema_version = '0.1.0', 'native', if(schema_version <> '0.2.0' OR source NOT IN ('native', 'otel-import'), 'otel-import', source)) AS source,
 (schema_version || source || completeness || n_limitations = '0.2.0nativecomplete0') OR schema_version = '0.1.0' AS executable FROM mf"""),
    "migrated_manifest": (("mf",), "SELECT run_id, coalesce(to_v, schema_version) AS schema_version, to_v IS NOT NULL AS migrated FROM mf LEFT JOIN (VALUES ('0.0.0', '0.2.0'), ('0.1.0', '0.2.0')) v(from_v, to_v) ON from_v = schema_version"),
    "policy_decisions": (("te",), """SELECT run_id, event_id, CASE WHEN type = 'tool.requested' THEN 'deny' WHEN actor = 'actor_1' OR type = 'model.requested' THEN 'allow' ELSE 'deny' END AS effect,
 list_position([type = 'tool.requested', actor = 'actor_1', type = 'model.requested'], true) AS first_rule FROM te WHERE ends_with(type, '.requested')"""),
    "compatibility": (("mf",), "SELECT run_id, status, readable, can_execute FROM mf LEFT JOIN (VALUES ('0.0.0', 'migratable', false, false), ('0.1.0', 'migratable', true, false), ('0.2.0', 'executable', true, true)) v(version, status, readable, can_execute) ON version = schema_version"),
    "diff_outputs": (("oa", "ob"), """SELECT oa.run_id, oa.sequence, 'changed' AS kind FROM oa JOIN ob USING (run_id, sequence) WHERE oa.value <> ob.value
 UNION ALL SELECT run_id, sequence, 'missing' FROM oa WHERE (run_id, sequence) NOT IN (SELECT (run_id, sequence) FROM ob) UNION ALL SELECT run_id, sequence, 'unexpected' FROM ob WHERE (run_id, sequence) NOT IN (SELECT (run_id, sequence) FROM oa)"""),
    "plan_comparison": (("pa", "pb"), """WITH x AS (SELECT run_id, 'a' AS side, k, type || '/' || correlation_key AS call FROM pa UNION ALL SELECT run_id, 'b', k, type || '/' || correlation_key FROM pb)
 SELECT run_id, k, if(count(*) = 2, 'different_call', if(min(side) = 'a', 'missing_call', 'unexpected_call')) AS code FROM x GROUP BY run_id, k HAVING count(*) = 1 OR min(call) <> max(call)"""),
    "unfinished_runs": (("mf", "te"), "SELECT run_id, 'UNFINISHED_RUN' AS code FROM mf WHERE NOT (run_state = 'finished' AND event_count <= (SELECT count(*) FROM te WHERE te.run_id = mf.run_id))"),
    "writer_rejects": (("tf",), "SELECT run_id, pos, sequence FROM tf WHERE EXISTS (SELECT 1 FROM tf o WHERE o.run_id = tf.run_id AND o.pos < tf.pos AND o.sequence >= tf.sequence) OR pos = 0 AND sequence <= 0"),
    # three of the procedures
    "event_cycles": (("tf",), """WITH @recursive e AS (SELECT DISTINCT c.run_id, c.event_id, c.parent_id FROM tf c JOIN tf p ON p.run_id = c.run_id AND p.event_id = c.parent_id),
reach AS (SELECT run_id, event_id, parent_id AS up FROM e UNION SELECT r.run_id, r.event_id, e.parent_id FROM reach r JOIN e ON e.run_id = r.run_id AND e.event_id = r.up),
c AS (SELECT run_id, event_id FROM reach WHERE up = event_id) SELECT run_id, event_id FROM c UNION SELECT r.run_id, r.event_id FROM reach r JOIN c ON c.run_id = r.run_id AND c.event_id = r.up"""),
    "otlp_forest": (("sp",), """WITH @recursive f AS (SELECT DISTINCT ON (trace_id, span_id) trace_id, span_id, start_ns, parent_span_id FROM sp ORDER BY trace_id, span_id, start_ns, parent_span_id NULLS FIRST),
e AS (SELECT f.*, p.span_id AS up FROM f LEFT JOIN f p ON p.trace_id = f.trace_id AND p.span_id = f.parent_span_id),
reach AS (SELECT trace_id, span_id, up FROM e WHERE up IS NOT NULL UNION SELECT r.trace_id, r.span_id, e.up FROM reach r JOIN e ON e.trace_id = r.trace_id AND e.span_id = r.up WHERE e.up IS NOT NULL),
cut AS (SELECT trace_id, span_id FROM reach r GROUP BY trace_id, span_id HAVING bool_or(up = span_id) AND span_id = max(up) FILTER (WHERE EXISTS (SELECT 1 FROM reach b WHERE b.trace_id = r.trace_id AND b.span_id = r.up AND b.up = r.span_id))),
g AS (SELECT e.trace_id, e.span_id, start_ns, if(cut.span_id IS NULL, up, NULL) AS up, cut.span_id IS NOT NULL AS detached FROM e LEFT JOIN cut ON cut.trace_id = e.trace_id AND cut.span_id = e.span_id),
tree AS (SELECT trace_id, span_id, detached, 0 AS depth, [lpad(start_ns::VARCHAR, 20, '0') || span_id] AS way FROM g WHERE up IS NULL
 UNION ALL SELECT g.trace_id, g.span_id, g.detached, t.depth + 1, list_append(t.way, lpad(g.start_ns::VARCHAR, 20, '0') || g.span_id) FROM tree t JOIN g ON g.trace_id = t.trace_id AND g.up = t.span_id)
SELECT trace_id, span_id, 1 + row_number() OVER (PARTITION BY trace_id ORDER BY way) AS sequence, depth::BIGINT AS depth, detached FROM tree"""),
    "state_fold": (("te",), """WITH x AS (SELECT run_id, replace(type, '.', '_') AS key, if(type = 'tool.failed', '{"n":' || arg_max(n, sequence) || '}', max(sequence)::VARCHAR) AS v FROM te GROUP BY run_id, type),
j AS (SELECT run_id, '{' || string_agg('"' || key || '":' || v, ',' ORDER BY key) || '}' AS state_json FROM x GROUP BY run_id) SELECT run_id, state_json, NULL::VARCHAR AS error, sha256(state_json) AS state_hash FROM j"""),
}
ORACLES = {name: adapters.duck(text, views) for name, (views, text) in TEXTS.items()}

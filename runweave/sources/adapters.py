"""Trace tables made from plain tables, for the queries of the catalogue.

Each view is SQL that Spark and DuckDB both run, but for the few words in DIALECT.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: word in the text -> (Spark, DuckDB)
DIALECT = {
    "@micros(ts)": ("unix_micros(cast(ts AS timestamp))", "epoch_us(ts)"),
    "@iso(ts)": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"),
    "@sha256(text)": ("sha2(text, 256)", "sha256(text)"),
    "@bytes(text)": ("octet_length(text)", "octet_length(encode(text))"),
    "@joined(event_id, pos)": ("array_join(transform(array_sort(collect_list(struct(pos, event_id))), x -> x.event_id), ', ')", "string_agg(event_id, ', ' ORDER BY pos)"),
    "@text": ("string", "varchar"),
    "@recursive": ("recursive", "recursive"),
}
_WORDS = sorted(DIALECT, key=len, reverse=True)

VIEWS = {
    # a linear trace for each user; event types by what the user did
    "te": """
SELECT run_id, sequence - 1 AS pos, event_id, parent_id, sequence, type, ts_text AS timestamp,
       (us - min(us) OVER (PARTITION BY run_id)) / 1000.0e0 AS offset_ms, actor, value, n,
       concat('key_', cast(n % 4 AS @text)) AS correlation_key, CASE WHEN value < 10 THEN concat('E', cast(n % 10 AS @text)) END AS error_code
FROM (SELECT concat('run_', lpad(cast(user_id AS @text), 6, '0')) AS run_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
       concat('evt_', lpad(cast(event_id AS @text), 9, '0')) AS event_id,
       concat('evt_', lpad(cast(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS @text), 9, '0')) AS parent_of,
       CASE WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN NULL
            ELSE concat('evt_', lpad(cast(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS @text), 9, '0')) END AS parent_id,
       CASE event_type WHEN 'signup' THEN 'model.requested' WHEN 'view' THEN 'model.delta' WHEN 'click' THEN 'tool.requested'
            WHEN 'purchase' THEN 'tool.completed' ELSE CASE WHEN event_id % 4 = 1 THEN 'log.written' ELSE 'tool.failed' END END AS type,
       @iso(ts) AS ts_text, @micros(ts) AS us, concat('actor_', cast(event_id % 5 AS @text)) AS actor, value, event_id AS n
      FROM events) x""",
    # the same with faults: a missing parent, a gap, a repeated id, an unknown type
    "tf": """
SELECT run_id, pos, CASE WHEN n % 89 = 7 AND parent_id IS NOT NULL THEN parent_id ELSE event_id END AS event_id,
       CASE WHEN n % 97 = 5 THEN 'evt_missing' WHEN n % 83 = 3 THEN event_id ELSE parent_id END AS parent_id,
       CASE WHEN n % 101 = 4 THEN sequence + 1 WHEN n % 103 = 9 THEN 0 ELSE sequence END AS sequence,
       CASE WHEN n % 53 = 2 THEN 'custom.note' ELSE type END AS type, timestamp, offset_ms, actor, value, n FROM te""",
    # the same with ids that repeat
    "tr": """
SELECT run_id, pos, CASE WHEN n % 7 = 3 AND parent_id IS NOT NULL THEN parent_id ELSE event_id END AS event_id, parent_id, sequence, type, timestamp, offset_ms, actor, value, n, correlation_key, error_code FROM te""",
    # conversations as runs of model calls
    "ct": """
SELECT concat('conv_', cast(conv_id AS @text)) AS run_id, turn AS pos, concat('evt_', cast(conv_id AS @text), '_', cast(turn AS @text)) AS event_id,
       CASE WHEN turn > 0 THEN concat('evt_', cast(conv_id AS @text), '_', cast(turn - 1 AS @text)) END AS parent_id, turn + 1 AS sequence,
       CASE role WHEN 'system' THEN 'run.started' WHEN 'user' THEN 'model.requested' WHEN 'assistant' THEN 'model.completed' ELSE 'custom.note' END AS type,
       length(text) AS chars FROM conversations""",
    # orders as runs that fan out to lines and join again
    "dt": """
SELECT run_id, event_id, parent_id, row_number() OVER (PARTITION BY run_id ORDER BY rank, event_id, parent_id) - 1 AS pos, type FROM (
  SELECT concat('run_', cast(o_orderkey AS @text)) AS run_id, concat('root_', cast(o_orderkey AS @text)) AS event_id, cast(NULL AS @text) AS parent_id, 0 AS rank, 'run.started' AS type FROM orders
  UNION ALL SELECT concat('run_', cast(l_orderkey AS @text)), concat('line_', cast(l_orderkey AS @text), '_', cast(l_linenumber AS @text)), concat('root_', cast(l_orderkey AS @text)), 1, 'tool.requested' FROM lineitem GROUP BY l_orderkey, l_linenumber
  UNION ALL SELECT concat('run_', cast(l_orderkey AS @text)), concat('join_', cast(l_orderkey AS @text)), concat('line_', cast(l_orderkey AS @text), '_', cast(l_linenumber AS @text)), 2, 'tool.completed' FROM lineitem GROUP BY l_orderkey, l_linenumber) x""",
    "mf": """
SELECT run_id, 'finished' AS run_state, count(*) + CASE WHEN min(n) % 7 = 1 THEN 1 ELSE 0 END AS event_count,
       max(sequence) + CASE WHEN min(n) % 5 = 2 THEN 1 ELSE 0 END AS last_sequence,
       CASE WHEN min(n) % 3 = 0 THEN '0.1.0' WHEN min(n) % 3 = 1 THEN '0.2.0' ELSE '0.0.0' END AS schema_version,
       CASE WHEN min(n) % 4 = 0 THEN 'native' WHEN min(n) % 4 = 1 THEN 'otel-import' ELSE 'other' END AS source,
       CASE WHEN min(n) % 2 = 0 THEN 'complete' ELSE 'partial' END AS completeness, CASE WHEN min(n) % 16 = 4 THEN 1 ELSE 0 END AS n_limitations,
       CASE WHEN min(n) % 11 = 3 THEN 'evt_gone' ELSE min(CASE WHEN parent_id IS NULL THEN event_id END) END AS root_event_id FROM te GROUP BY run_id""",
    "ck": """
SELECT run_id, sequence, CASE WHEN n % 13 = 5 THEN 'evt_gone' ELSE event_id END AS last_event_id, value AS state, n % 17 <> 4 AS hash_ok,
       concat('cp_', cast(n AS @text)) AS checkpoint_id FROM te WHERE sequence % 5 = 0""",
    "sp": """
SELECT md5(concat('t|', run_id)) AS trace_id, substr(md5(concat('s|', CASE WHEN n % 71 = 8 AND parent_id IS NOT NULL THEN parent_id ELSE event_id END)), 1, 16) AS span_id,
       CASE WHEN n % 67 = 6 THEN 'ffffffffffffffff' WHEN n % 61 = 5 THEN substr(md5(concat('s|', event_id)), 1, 16) WHEN parent_id IS NULL THEN NULL ELSE substr(md5(concat('s|', parent_id)), 1, 16) END AS parent_span_id,
       type AS name, n * 1000000 + 5 AS start_ns, n * 1000000 + 9 AS end_ns, pos, n FROM te""",
    # payloads of several event types, with a field k somewhere
    "pe": """
SELECT event_id, CASE n % 5 WHEN 0 THEN 'model.requested' WHEN 4 THEN 'note.written' ELSE 'state.changed' END AS type,
       CASE n % 5 WHEN 0 THEN concat('{"correlation_key":"', correlation_key, '","model":"m","k":', cast(n AS @text), '}') WHEN 1 THEN concat('{"operation":"set","path":"/k","value":', cast(n AS @text), '}')
            WHEN 2 THEN '{"operation":"set","path":"/k/x","value":1}' WHEN 3 THEN '{"operation":"merge","path":"/other","value":{"k":1}}' ELSE concat('{"k":[1],"other":"', correlation_key, '"}') END AS payload FROM te""",
    # appends to runs that start late, twice or not at all and end early, with lost parents and repeated ids
    "lc": """
SELECT run_id, pos, CASE WHEN n % 89 = 7 AND parent_id IS NOT NULL THEN parent_id ELSE event_id END AS event_id, CASE WHEN n % 97 = 5 THEN 'evt_missing' WHEN n % 83 = 3 THEN NULL ELSE parent_id END AS parent_id,
       sequence, CASE WHEN pos = n % 2 AND n % 31 <> 4 OR n % 47 = 5 THEN 'run.started' WHEN n % 59 = 11 AND pos > 3 THEN 'run.completed' WHEN n % 101 = 7 AND pos > 3 THEN 'run.failed' ELSE type END AS type, timestamp, n FROM te""",
    # checkpoints to be saved, some of one sequence, and those that are saved
    "cn": """
SELECT run_id, sequence, pos, concat('{"state":', cast(n AS @text), '}') AS value FROM te WHERE sequence % 5 = 0
UNION ALL SELECT run_id, sequence, pos + 100000, concat('{"state":', cast(CASE WHEN n % 3 = 0 THEN n + 1 ELSE n END AS @text), '}') FROM te WHERE sequence % 5 = 0 AND n % 4 < 2""",
    "cs": """
SELECT run_id, sequence, concat('{"state":', cast(CASE WHEN n % 13 = 5 THEN n + 1 ELSE n END AS @text), '}') AS value FROM te WHERE sequence % 10 = 0""",
    # artifacts that are referred to and files that are there, with faults; outputs of a run and of its replay; calls planned and made
    "rf": "SELECT DISTINCT digest, byte_length FROM ar WHERE doc_id % 3 <> 0",
    "fl": "SELECT digest, min(byte_length) + CASE WHEN min(doc_id) % 10 = 1 THEN 1 ELSE 0 END AS byte_length FROM ar WHERE doc_id % 5 <> 0 GROUP BY digest",
    "oa": "SELECT run_id, sequence, value FROM te WHERE n % 19 <> 3",
    "ob": "SELECT run_id, sequence, CASE WHEN n % 23 = 4 THEN value + 1 ELSE value END AS value FROM te WHERE n % 29 <> 6",
    "pa": "SELECT run_id, type, correlation_key, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS k FROM te WHERE type LIKE '%.requested'",
    "pb": "SELECT run_id, type, CASE WHEN n % 31 = 2 THEN 'other' ELSE correlation_key END AS correlation_key, row_number() OVER (PARTITION BY run_id ORDER BY sequence) AS k FROM te WHERE type LIKE '%.requested' AND n % 37 <> 1",
    "ar": "SELECT doc_id, @sha256(text) AS digest, @bytes(text) AS byte_length, lang AS media_type FROM documents WHERE text IS NOT NULL",
}
NEEDS = {"tf": ("te",), "tr": ("te",), "mf": ("te",), "ck": ("te",), "sp": ("te",), "pe": ("te",), "lc": ("te",), "cn": ("te",), "cs": ("te",), "rf": ("ar",), "fl": ("ar",), "oa": ("te",), "ob": ("te",), "pa": ("te",), "pb": ("te",)}


def render(text: str, engine: int) -> str:
    """engine 0: Spark, 1: DuckDB."""
    for w in _WORDS:
        text = text.replace(w, DIALECT[w][engine])
    return text


def needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        out += [x for x in (*NEEDS.get(n, ()), n) if x not in out]
    return out


BASE = {"te": ("events",), "tf": (), "ct": ("conversations",), "dt": ("orders", "lineitem"), "ar": ("documents",)}


def views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    made: dict[str, DataFrame] = {}
    for n in needed(names):
        text = render(VIEWS[n], 0)
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE.get(n, ())}
        made[n] = sql(spark, text, **tables, **{k: made[k] for k in NEEDS.get(n, ())})
    return made


def with_tables(ctes: str, body: str) -> str:
    """Puts common tables before a text that may have its own."""
    body = body.strip()
    if body[:4].upper() != "WITH":
        return f"WITH {ctes}\n{body}" if ctes else body
    rest = body[4:].strip()
    if rest[:9].lower() == "recursive":
        return f"WITH RECURSIVE {ctes},\n{rest[9:]}"
    return f"WITH {ctes},\n{rest}"


def sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL over frames by their names, which stand after FROM or JOIN; keywords are in capitals, aliases are not."""
    text = text.replace("{", "{{").replace("}", "}}")
    names = "|".join(frames)
    text = re.sub(rf"\b(FROM|JOIN)\s+({names})\b(?:\s+([a-z]\w*))?", lambda m: f"{m[1]} {{{m[2]}}} {m[3] or m[2]}", text)
    return spark.sql(text, **frames)


def duck(text: str, names: tuple[str, ...]) -> str:
    """The text for DuckDB, with the views as common tables."""
    return with_tables(",\n".join(f"{n} AS ({render(VIEWS[n], 1)})" for n in needed(names)), render(text, 1))

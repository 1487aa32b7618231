"""All queries of the trace engine, by name, with the SQL they are held against."""

from __future__ import annotations

from ..functions import tables
from ..operators import export, live, otlp, plans, procedures, recorder, recovery, redaction, replay, workflow
from ..streaming import append, lifecycle
from . import oracles

QUERIES = {**plans.QUERIES, **procedures.QUERIES, **otlp.QUERIES, **recovery.QUERIES, **redaction.QUERIES, **recorder.QUERIES, **replay.QUERIES, **export.QUERIES, **live.QUERIES, **workflow.QUERIES, **append.QUERIES, **lifecycle.QUERIES, **tables.QUERIES}
ORACLES = {**oracles.ORACLES, **procedures.ORACLES, **otlp.ORACLES, **recovery.ORACLES, **redaction.ORACLES, **recorder.ORACLES, **replay.ORACLES, **export.ORACLES, **live.ORACLES, **append.ORACLES, **lifecycle.ORACLES, **tables.ORACLES}

"""The fold of state in stretches against a plain loop: drawn runs cut anywhere, a run of a million changes, checkpoints as bases."""

import copy
import json
import random

import pytest

from runweave.operators import folding, procedures
from runweave.operators.folding import ORDER, StateError, Stretch, apply_change, canonical

BASES = [{}, {"a": {"a": [1, {"b": 2}], "0": {"1": []}}, "b": [[], {"a": {}}, [1, 2]], "0": [{}], "1": 5}]


def plain(rows, base):
    state = copy.deepcopy(base)
    for k, (_, sequence, path, operation, value) in enumerate(rows):
        try:
            if sequence != k + 1:
                raise StateError(ORDER)
            if path is not None:
                apply_change(state, path, operation, None if value is None else json.loads(value))
        except StateError as e:
            return None, str(e)
    return canonical(state), None


def value(rng, depth=0):
    r = rng.random()
    if r < 0.35:
        return rng.randint(0, 9)
    if r < 0.6 and depth < 2:
        return {rng.choice("ab01"): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if r < 0.85 and depth < 2:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {"__proto__": 1} if r < 0.87 else rng.choice([None, "s", True])


def drawn(rng, base, most=14):
    """Changes that mostly succeed: names, places in lists, and names that look like places."""
    state, rows, n = copy.deepcopy(base), [], rng.randint(1, most)
    while len(rows) < n:
        k = len(rows)
        path = "/" + "/".join(rng.choice(["a", "b", "0", "1", "-", "a~1"]) for _ in range(rng.choice([1, 1, 2, 2, 3, 4])))
        path = rng.choice(["/", "x", "/constructor"]) if rng.random() < 0.004 else path
        row = (k, k + 1 + (rng.random() < 0.004), None if rng.random() < 0.1 else path, rng.choice(["set"] * 8 + ["merge"] * 4 + ["append", "delete"] * 2 + ["odd"]), json.dumps(value(rng)))
        if row[2] is not None and rng.random() < 0.93:
            after = copy.deepcopy(state)
            try:
                apply_change(after, row[2], row[3], json.loads(row[4]))
            except StateError:
                continue
            state = after
        rows.append(row)
    return rows


def stretch(rows):
    s = Stretch(rows[0][0], rows[0][1])
    for r in rows:
        s.add(*r)
    return s


def test_patches_compose_in_any_order():
    rng, errors = random.Random(1), set()
    for _ in range(4000):
        base = rng.choice(BASES)
        rows = drawn(rng, base)
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randint(0, len(rows) - 1)))
        parts = [stretch(rows[i:j]) for i, j in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].join(parts[k + 1])]
        state, error = parts[0].end(copy.deepcopy(base))
        assert (None if error else canonical(state), error) == plain(rows, base), rows
        errors.add(error)
    assert errors == {None, "STATE_EVENT_INVALID", "STATE_VALUE_INVALID", ORDER}


@pytest.mark.parametrize("case", [
    [("/a/0", "set", 1), ("/a", "set", 2)],  # what a replaced value needed still counts
    [("/a", "merge", {"x": 1}), ("/a/y", "delete", None)],
    [("/a", "append", 1), ("/a/0", "set", 5), ("/a/b", "set", 1)],
    [("/a/0/b", "set", 1), ("/a/c", "set", 2), ("/a", "delete", None), ("/a", "append", 1)],
])
def test_needs_of_an_unknown_state(case):
    rows = [(k, k + 1, p, o, json.dumps(v)) for k, (p, o, v) in enumerate(case)]
    for base in ({}, {"a": 1}, {"a": []}, {"a": [{}]}, {"a": {}}, {"a": {"0": {}}}, {"a": {"y": 1}}, {"a": [[1]]}):
        whole = stretch(rows[:1])
        for r in rows[1:]:
            whole = whole.join(stretch([r]))
        state, error = whole.end(copy.deepcopy(base))
        assert (None if error else canonical(state), error) == plain(rows, base), base


COLUMNS = "run_id string, pos long, sequence long, path string, operation string, value_json string"


def test_drawn_runs_on_tasks(spark):
    rng = random.Random(2)
    runs = {f"r{k}": drawn(rng, {}, 40) for k in range(1000)}
    table = [(run, *row) for run, rows in runs.items() for row in rows]
    rng.shuffle(table)
    got = procedures.fold_state(spark.createDataFrame(table, COLUMNS), parts=300).collect()
    assert {r.run_id: (r.state_json, r.error) for r in got} == {run: plain(rows, {}) for run, rows in runs.items()}


def test_a_million_changes_of_one_run(spark):
    changes = spark.range(1_000_000).selectExpr("'r' AS run_id", "id AS pos", "id + 1 AS sequence", "CASE WHEN id = 0 THEN '/log' WHEN id % 1000 = 0 THEN '/log' ELSE concat('/k', id % 50) END AS path", "if(id > 0 AND id % 1000 = 0, 'append', 'set') AS operation", "if(id = 0, '[]', cast(id AS string)) AS value_json")
    parts = folding.stretches(changes, procedures.settled, 64)
    assert parts.count() == 1
    (r,) = procedures.fold_state(changes, parts=64).collect()
    state = json.loads(r.state_json)
    assert r.error is None and state["log"] == list(range(1000, 1_000_000, 1000)) and [state[f"k{k}"] for k in range(1, 50)] == list(range(999_951, 1_000_000))
    assert state["k0"] == 999_950
    (late,) = procedures.fold_state(changes.selectExpr("run_id", "pos", "if(pos >= 900000, sequence + 1, sequence) AS sequence", "path", "operation", "value_json"), parts=64).collect()
    assert late.error == ORDER and late.state_json is None

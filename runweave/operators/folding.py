"""State of runs as a fold of changes, without a run in one task.

A stretch of changes is a patch: what it does to a state that isn't known yet, and what it needs of it. Patches compose, and composition is
associative, so a run's changes are cut into stretches of consecutive events, each becomes a patch where it lies, and patches are joined in a tree.
"""

from __future__ import annotations

import copy
import json
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that no path or value may have, and the codes of errors.
FORBIDDEN = ("__proto__", "constructor", "prototype")
EVENT, VALUE, ORDER = "STATE_EVENT_INVALID", "STATE_VALUE_INVALID", "EVENT_SEQUENCE_INVALID"
#: Patches that are joined at a time.
FAN = 32
DEEP = 20_000


class StateError(ValueError):
    pass


# --- one change ------------------------------------------------------------------------------


def keys_of(path: str) -> list[str]:
    if not path.startswith("/") or path == "/":
        raise StateError(EVENT)
    keys = [k.replace("~1", "/").replace("~0", "~") for k in path[1:].split("/")]
    if any(k in FORBIDDEN for k in keys):
        raise StateError(EVENT)
    return keys


def clean(value) -> bool:
    """Whether no object inside a value has a forbidden name."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            if any(k in FORBIDDEN for k in v):
                return False
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return True


def apply_change(state: dict, path: str, operation: str, value=None) -> None:
    """Changes state in place: set, merge (shallow), delete or append at a JSON pointer."""
    keys = keys_of(path)
    if not clean(value):
        raise StateError(VALUE)
    change_at(state, keys, operation, value)


def change_at(state: dict, keys: list[str], operation: str, value) -> None:
    *up, last = keys
    at = state
    for k in up:
        if isinstance(at, list) and k.isdigit() and int(k) < len(at):
            at = at[int(k)]
        elif isinstance(at, dict) and k in at:
            at = at[k]
        else:
            raise StateError(EVENT)
    if isinstance(at, list):
        if operation == "set" and (last == "-" or last.isdigit() and int(last) <= len(at)):
            k = len(at) if last == "-" else int(last)
            at[k : k + 1] = [value]
        elif operation == "delete" and last.isdigit() and int(last) < len(at):
            del at[int(last)]
        elif operation == "append" and last.isdigit() and int(last) < len(at) and isinstance(at[int(last)], list):
            at[int(last)].append(value)
        else:
            raise StateError(EVENT)
    elif not isinstance(at, dict):
        raise StateError(EVENT)
    elif operation == "set":
        at[last] = value
    elif operation == "merge":
        if not isinstance(value, dict) or not isinstance(at.get(last, {}), dict):
            raise StateError(VALUE)
        at[last] = {**at.get(last, {}), **value}
    elif operation == "delete":
        if last not in at:
            raise StateError(EVENT)
        del at[last]
    elif operation == "append":
        if not isinstance(at.get(last), list):
            raise StateError(EVENT)
        at[last].append(value)
    else:
        raise StateError(EVENT)


# --- patches ---------------------------------------------------------------------------------

ABSENT = type("Absent", (), {})()
#: What a patch may need of the value it changes: the test, and what's wrong where it fails (failures on the way to a value come before those at it).
NEEDS: dict[str, tuple[Callable, int, str]] = {
    "object": (lambda v: isinstance(v, dict), 0, EVENT),
    "there": (lambda v: v is not ABSENT, 1, EVENT),
    "list": (lambda v: isinstance(v, list), 1, EVENT),
    "room": (lambda v: v is ABSENT or isinstance(v, dict), 1, VALUE),
    "nothing": (lambda v: False, 1, VALUE),
}


class Patch:
    """What happens to one value: `needs` of it (kind -> position of the first change that does), then its effect.

    same: nothing yet. value: replaced by `value`. gone: deleted. object: an object (made where there is none) whose members change by `members`.
    more: a list that gets the items of `value`. steps: changes in `value` one after another, where it isn't known whether numbers are names or places.
    Members of a value that was replaced, and `before` (patches that were), only tell what was needed.
    """

    __slots__ = ("needs", "members", "before", "effect", "value")

    def __init__(self, effect: str = "same", value=None):
        self.needs: dict[str, int] = {}
        self.members: dict[str, Patch] = {}
        self.before: list[Patch] = []
        self.effect, self.value = effect, value

    def member(self, key: str) -> Patch:
        return self.members.setdefault(key, Patch())


Failure = tuple[int, int, str]


def ambiguous(key: str) -> bool:
    return key.isdigit() or key == "-"


def patch_of(pos: int, path: str, operation: str, value) -> Patch:
    """The patch of one change; StateError where no state can take it."""
    keys = keys_of(path)
    if not clean(value):
        raise StateError(VALUE)
    root = at = Patch("object")
    for k, key in enumerate(keys[:-1]):
        at = at.member(key)
        if ambiguous(keys[k + 1]):
            at.effect, at.value = "steps", [(pos, keys[k + 1 :], operation, value)]
            return root
        at.needs["object"], at.effect = pos, "object"
    at = at.member(keys[-1])
    if operation == "set":
        at.effect, at.value = "value", value
    elif operation == "delete":
        at.needs["there"], at.effect = pos, "gone"
    elif operation == "append":
        at.needs["list"], at.effect, at.value = pos, "more", [value]
    elif operation == "merge" and isinstance(value, dict):
        at.needs["room"], at.effect = pos, "object"
        at.members = {k: Patch("value", v) for k, v in value.items()}
    elif operation == "merge":
        at.needs["nothing"], at.effect = pos, "gone"
    else:
        at.needs["list"] = at.needs["object"] = pos  # no value is both
        at.effect = "gone"
    return root


def run(patch: Patch, old, failures: list[Failure]):
    """The value after the patch; changes old in place. Of several failures the one of the first change counts."""
    for kind, pos in patch.needs.items():
        holds, rank, code = NEEDS[kind]
        if not holds(old):
            failures.append((pos, rank, code))
    for ghost in patch.before:
        run(ghost, copy.deepcopy(old) if old is not ABSENT else old, failures)
    if patch.effect == "object" and not isinstance(old, dict):
        old = {}
    for key, member in patch.members.items():
        had = old.get(key, ABSENT) if isinstance(old, dict) else ABSENT
        new = run(member, had, failures)
        if patch.effect == "object":
            if new is not ABSENT:
                old[key] = new
            elif had is not ABSENT:
                del old[key]
    if patch.effect == "value":
        return patch.value
    if patch.effect == "gone":
        return ABSENT
    if patch.effect == "more":
        return [*old, *patch.value] if isinstance(old, list) else patch.value
    if patch.effect == "steps":
        for step in patch.value:
            if isinstance(step, Patch):
                found: list[Failure] = []
                old = run(step, old, found)
                failures += found
            else:
                pos, keys, operation, value = step
                holder = {} if old is ABSENT else {"": old}
                try:
                    change_at(holder, ["", *keys], operation, copy.deepcopy(value))
                except StateError as e:
                    found = [(pos, 1, str(e))]
                    failures += found
                else:
                    found = []
                    old = holder[""]
            if found:
                return old
    return old


def only_needs(patch: Patch) -> Patch | None:
    """A patch that has no effect but the same needs; None if it has none."""
    _stand(patch, "same")
    return patch if patch.needs or patch.before or patch.members else None


def _stand(patch: Patch, effect: str, value=None) -> None:
    """Replaces a patch's effect; what it needed stays."""
    if patch.effect == "steps":
        patch.before.append(Patch("steps", patch.value))
    patch.members = {k: m for k, p in patch.members.items() if (m := only_needs(p)) is not None}
    patch.effect, patch.value = effect, value


def compose(a: Patch, b: Patch, failures: list[Failure]) -> Patch:
    """First a, then b. Changes and returns a; failures get what b needs and a surely leaves otherwise."""
    if a.effect == "same" and not (a.needs or a.before or a.members):
        return b
    if a.effect in ("value", "gone"):
        new = run(b, a.value if a.effect == "value" else ABSENT, failures)
        a.effect, a.value = ("gone", None) if new is ABSENT else ("value", new)
        return a
    if a.effect == "steps":
        if b.effect in ("value", "gone"):
            a.before.append(Patch("steps", [*a.value, b]))
            a.effect, a.value = b.effect, copy.deepcopy(b.value)
        elif b.effect == "steps" and not (b.needs or b.before or b.members):
            for step in b.value:
                _follow(a.value, step)
        else:
            a.value.append(b)
        return a
    # a leaves an object or a list, the rest of which isn't known
    object_ = a.effect == "object"
    for kind, pos in b.needs.items():
        if kind == "nothing" or kind == "room" and not object_ or kind == "object" and not object_ or kind == "list" and object_:
            failures.append((pos, *NEEDS[kind][1:]))
    for ghost in b.before:
        a.before.append(Patch("steps", [_whole(a), ghost]))
    if not object_:
        if b.effect == "more":
            a.value += b.value
        elif b.effect == "steps":
            a.effect, a.value = "steps", [Patch("more", a.value), *b.value]
        elif b.effect in ("value", "gone"):
            _stand(a, b.effect, b.value)
        return a
    if b.effect == "steps":
        for step in b.value:
            if isinstance(step, Patch):
                compose(a, step, failures)
            else:
                pos, keys, operation, value = step
                compose(a, _below(pos, keys, operation, value), failures)
        return a
    for key, member in b.members.items():
        mine = a.members.get(key)
        a.members[key] = member if mine is None else compose(mine, member, failures)
    if b.effect in ("value", "gone"):
        _stand(a, b.effect, b.value)
    return a


def _below(pos: int, keys: list[str], operation: str, value) -> Patch:
    """A change inside a value that is known to be an object."""
    return patch_of(pos, "/" + "/".join(k.replace("~", "~0").replace("/", "~1") for k in keys), operation, value)


def _whole(patch: Patch) -> Patch:
    """A copy of what a patch does, without its needs."""
    out = Patch(patch.effect, copy.deepcopy(patch.value))
    if patch.effect == "object":
        out.members = {k: _whole(p) for k, p in patch.members.items() if p.effect != "same"}
    return out


def _follow(steps: list, step) -> None:
    """Adds a step. Of sets of one direct member with nothing but such sets between, the last value stands at the first one's place."""
    if not isinstance(step, Patch) and step[2] == "set" and len(step[1]) == 1 and step[1] != ["-"]:
        for k in range(len(steps) - 1, -1, -1):
            other = steps[k]
            if isinstance(other, Patch) or other[2] != "set" or len(other[1]) > 1 or other[1] == ["-"]:
                break
            if other[1] == step[1]:
                steps[k] = (other[0], other[1], "set", step[3])
                return
    steps.append(step)


# --- stretches -------------------------------------------------------------------------------


class Stretch:
    """Consecutive events of a run: their patch, the first sure failure, and whether their sequences count up."""

    __slots__ = ("first_pos", "first_sequence", "n", "patch", "failure", "broken")

    def __init__(self, pos: int, sequence: int):
        self.first_pos, self.first_sequence, self.n = pos, sequence, 0
        self.patch, self.failure, self.broken = Patch("object"), None, False

    def _failed(self, failures: list[Failure]) -> None:
        if failures:
            self.failure = min(failures)

    def add(self, pos: int, sequence: int, path: str | None, operation: str | None, value_json: str | None) -> None:
        if sequence != self.first_sequence + self.n:
            self._broke(pos)
        self.n += 1
        if self.failure is None and path is not None:
            failures: list[Failure] = []
            try:
                self.patch = compose(self.patch, patch_of(pos, path, operation, None if value_json is None else json.loads(value_json)), failures)
            except StateError as e:
                failures = [(pos, 1, str(e))]
            self._failed(failures)

    def _broke(self, pos: int) -> None:
        self.broken = True
        if self.failure is None:
            self.failure = (pos, -1, ORDER)

    def join(self, other: Stretch) -> Stretch:
        if other.first_sequence != self.first_sequence + self.n:
            self._broke(other.first_pos)
        self.broken |= other.broken
        self.n += other.n
        if self.failure is None:
            failures: list[Failure] = []
            self.patch = compose(self.patch, other.patch, failures)
            self._failed([*failures, other.failure] if other.failure else failures)
        return self

    def end(self, base: dict) -> tuple[dict, str | None]:
        """The state after the stretch, and the code of the first change that fails."""
        if self.first_sequence != 1:
            self.broken = True
            return base, ORDER
        failures = [self.failure] if self.failure else []
        state = run(self.patch, base, failures)
        return state, min(failures)[2] if failures else None


def canonical(state) -> str:
    return json.dumps(state, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_BLOCK = "run_id string, part long, stretch binary"


def _rows(batches: Iterable[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h, strict=True)) for h in held], schema)


_BLOCKS = pa.schema([("run_id", pa.string()), ("part", pa.int64()), ("stretch", pa.binary())])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    def made():
        part = TaskContext.get().partitionId()
        for run_id, rows in groupby(_rows(batches, ("run_id", "pos", "sequence", "path", "operation", "value_json")), key=lambda r: r[0]):
            stretch = None
            for _, pos, sequence, path, operation, value in rows:
                stretch = stretch or Stretch(pos, sequence)
                stretch.add(pos, sequence, path, operation, value)
            yield run_id, part, pickle.dumps(stretch)

    return _batches(made(), _BLOCKS)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for (run_id, part), rows in groupby(_rows(batches, ("run_id", "up", "stretch")), key=lambda r: r[:2]):
            whole = None
            for *_, data in rows:
                one = pickle.loads(data)
                whole = one if whole is None else whole.join(one)
            yield run_id, part, pickle.dumps(whole)

    return _batches(made(), _BLOCKS)


def stretches(changes: DataFrame, kept: Callable[[DataFrame], DataFrame], parts: int | None = None) -> DataFrame:
    """(run_id, pos, sequence, path, operation, value_json) -> run_id, stretch: one for each run, of all its events in order of pos.

    Events are dealt by ranges of (run_id, pos), so a long run lies on many tasks, and each makes one patch of its share. Patches are joined
    FAN at a time; only their number counts for the rounds. parts: ranges, else as many as the session shuffles to.
    """
    rows = changes.select("run_id", "pos", "sequence", "path", "operation", "value_json")
    by = ("run_id", "pos", "sequence")
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    blocks = kept(dealt.sortWithinPartitions(*by).mapInArrow(_summed, _BLOCK))
    most = blocks.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        up = blocks.withColumn("up", F.floor(F.col("part") / FAN))
        blocks = kept(up.repartition("run_id", "up").sortWithinPartitions("run_id", "up", "part").mapInArrow(_joined, _BLOCK))
        most = blocks.groupBy("run_id").count().agg(F.max("count")).first()[0]
    return blocks.select("run_id", "stretch")


def fold(changes: DataFrame, kept: Callable[[DataFrame], DataFrame], bases: DataFrame | None = None, parts: int | None = None, text: Callable = canonical) -> DataFrame:
    """run_id, state_json, error, broken (sequences aren't 1..n): the state of each run after its changes (a null path changes nothing), from nothing or from its base.

    bases: run_id, base_state (JSON). text: how a state is written.
    """
    s = stretches(changes, kept, parts)
    s = s.withColumn("base_state", F.lit(None).cast("string")) if bases is None else s.join(bases.select("run_id", "base_state"), "run_id", "left")

    def ended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for run_id, data, base in _rows(batches, ("run_id", "stretch", "base_state")):
                stretch = pickle.loads(data)
                state, error = stretch.end(json.loads(base) if base else {})
                yield run_id, None if error else text(state), error, stretch.broken

        return _batches(made(), pa.schema([("run_id", pa.string()), ("state_json", pa.string()), ("error", pa.string()), ("broken", pa.bool_())]))

    return s.mapInArrow(ended, "run_id string, state_json string, error string, broken boolean")

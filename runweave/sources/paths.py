"""Which files of a snapshot folder may be read: regular ones inside it, reached without links. For folders of a local file system."""

from __future__ import annotations

import os
import re
import stat
from pathlib import Path
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code of each untrusted part.
CODES = {"manifest.json": "UNTRUSTED_MANIFEST_FILE", "manifest.json.tmp": "UNTRUSTED_MANIFEST_FILE", "events.jsonl": "UNTRUSTED_EVENTS_FILE", "checkpoints": "UNTRUSTED_CHECKPOINT_DIRECTORY", "artifacts": "UNTRUSTED_ARTIFACT_DIRECTORY"}


class PathError(ValueError):
    def __init__(self, code: str, path: object):
        super().__init__(f"{code}: {path}")
        self.code = code


def trusted(folder: str | Path, candidate: str | Path, directory: bool = False) -> Path:
    """The path, if it is a regular file (or folder) inside `folder`; else a PathError of OUTSIDE_SNAPSHOT, MISSING or UNTRUSTED_ENTRY."""
    top = Path(os.path.abspath(folder))
    path = Path(os.path.abspath(top / candidate))
    if not path.is_relative_to(top):
        raise PathError("OUTSIDE_SNAPSHOT", path)
    try:
        mode = os.lstat(path).st_mode
    except OSError as e:
        raise PathError("MISSING", path) from e
    if not (stat.S_ISDIR(mode) if directory else stat.S_ISREG(mode)):
        raise PathError("UNTRUSTED_ENTRY", path)
    if not Path(os.path.realpath(path)).is_relative_to(os.path.realpath(top)):
        raise PathError("OUTSIDE_SNAPSHOT", path)
    return path


def faults(folder: str | Path) -> list[tuple[str, str]]:
    """(code, relative path) of what a snapshot folder holds and must not be read."""
    top, out = Path(folder), []

    def check(rel: str, code: str, directory: bool = False) -> bool:
        try:
            trusted(top, rel, directory)
        except PathError as e:
            if e.code != "MISSING":
                out.append((code, rel))
            return False
        return True

    for name, code in CODES.items():
        inside = "." not in name
        if check(name, code, inside) and inside:
            one = "UNTRUSTED_SNAPSHOT_ENTRY" if name == "checkpoints" else "UNTRUSTED_ARTIFACT_ENTRY"
            for entry in sorted(os.listdir(top / name)):
                check(f"{name}/{entry}", one)
    return out


def barred(folder: str) -> Column:
    """array<struct<code, path>> of the faults of the folders (file: addresses) in a column. Looked up in tasks, so the file system must be one that executors share."""

    def each(folders: pd.Series) -> pd.Series:
        local = (unquote(re.sub("^file:/+", "/", f)) for f in folders)
        return pd.Series([[{"code": c, "path": p} for c, p in (faults(f) if os.path.isdir(f) else [])] for f in local], dtype=object)

    return F.pandas_udf(each, "array<struct<code string, path string>>")(folder)

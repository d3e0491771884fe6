"""Publish several outputs at once: all of them, or none.

Finished outputs wait in staging folders. A link file beside every target
names a commit record, and the record, itself written under another name and
renamed, lists which staging folder becomes which target with which manifest.
That rename is the moment of publication. Before it every target is as it was;
from it on every reader that goes through `resolve` or `manifest_of` gets all
the new outputs, whether or not their folders have been renamed yet. A process
that dies in between is made up for by `recover`, which the next writer of any
of the targets calls first. A target has one writer at a time, and the file
system renames files whole.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from uuid import uuid4

from pyspark.sql import SparkSession

from peakloom.sources import manifest as M

LINK_SUFFIX, RECORD_SUFFIX = ".pending.json", ".commit.json"


@dataclass(frozen=True)
class Move:
    """A staging folder, the target that it becomes, and the target's manifest if it has one."""

    staging: str
    target: str
    manifest: dict | None = None


def _plain(target: str) -> str:
    return target.rstrip("/")


def _committed(spark: SparkSession, target: str) -> tuple[str, list[Move]] | None:
    """The record that publishes a target, if one is in force, and its moves."""
    link = _plain(target) + LINK_SUFFIX
    if not M.exists(spark, link):
        return None
    record = json.loads(M.read_text(spark, link))["record"]
    if not M.exists(spark, record):
        return None
    return record, [Move(**m) for m in json.loads(M.read_text(spark, record))["moves"]]


def _move_of(spark: SparkSession, target: str) -> Move | None:
    found = _committed(spark, target)
    same = [m for m in found[1] if _plain(m.target) == _plain(target)] if found else []
    return same[0] if same else None


def resolve(spark: SparkSession, target: str) -> str:
    """The folder that holds the published state of a target just now."""
    move = _move_of(spark, target)
    return move.staging if move and M.exists(spark, move.staging) else target


def manifest_of(spark: SparkSession, target: str) -> dict:
    """The published manifest of a target."""
    move = _move_of(spark, target)
    return move.manifest if move and move.manifest is not None else M.read_manifest(spark, target)


def published(spark: SparkSession, target: str) -> bool:
    return M.exists(spark, resolve(spark, target))


def publish(spark: SparkSession, moves: list[Move]) -> None:
    """Make all staged outputs the published ones."""
    record = f"{_plain(moves[0].target)}.{uuid4().hex}{RECORD_SUFFIX}"
    for move in moves:
        M.write_text(spark, _plain(move.target) + LINK_SUFFIX, json.dumps({"record": record}) + "\n", overwrite=True)
    M.write_text(spark, record, json.dumps({"moves": [asdict(m) for m in moves]}, indent=2) + "\n")
    for move in moves:
        _carry_out(spark, move)
    _close(spark, record, moves)


def _carry_out(spark: SparkSession, move: Move) -> None:
    """Put one output in place; doing so again changes nothing."""
    if move.manifest is not None:
        M.write_manifest(spark, move.target, move.manifest, overwrite=True)
    if M.exists(spark, move.staging):
        M.delete(spark, move.target)
        M.rename(spark, move.staging, move.target)


def _close(spark: SparkSession, record: str, moves: list[Move]) -> None:
    M.delete(spark, record)
    for move in moves:
        M.delete(spark, _plain(move.target) + LINK_SUFFIX)


def recover(spark: SparkSession, target: str) -> bool:
    """Finish a publication of the target that was broken off; whether there was one."""
    link = _plain(target) + LINK_SUFFIX
    if not M.exists(spark, link):
        return False
    found = _committed(spark, target)
    if found is None:  # broken off before it took effect, or after all was in place
        M.delete(spark, link)
        return False
    record, moves = found
    for move in moves:
        _carry_out(spark, move)
    _close(spark, record, moves)
    return True

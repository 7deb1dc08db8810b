"""A registry of runs: fingerprints of what a run is given, one line of retries per fingerprint, and an append-only event log.

Registries are small and need transactions, so the log is a SQLite file that the driver writes; runs() and log() give its
tables as DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sqlite3
import unicodedata
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from quillstream.functions.text import SECRET
from quillstream.sources.readers import sqlite_table

# States that end a run.
TERMINAL = ("completed", "failed", "cancelled")


class Refused(ValueError):
    """The registry does not take the run or the change."""


def canonical(value):
    """A specification in one form: composed text, integral numbers as integers, keys sorted, sets of strings sorted; text that
    looks like a credential and numbers that aren't finite are refused."""
    if isinstance(value, dict):
        return {canonical(str(k)): canonical(value[k]) for k in sorted(value, key=str)}
    if isinstance(value, (set, frozenset)):
        return sorted(canonical(v) for v in value)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    if isinstance(value, float):
        if not math.isfinite(value):
            raise Refused("a number isn't finite")
        return int(value) if value.is_integer() else value
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise Refused("a time has no offset")
        return value.astimezone(UTC).isoformat()
    if isinstance(value, str):
        if re.search(SECRET, value):
            raise Refused("a value looks like a credential")
        return unicodedata.normalize("NFC", value)
    return value


def fingerprint(spec: dict) -> str:
    text = json.dumps(canonical(spec), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


class Registry:
    def __init__(self, path: str):
        self.path = path
        with self._db() as db:
            db.executescript(
                """create table if not exists runs (run_id integer primary key, fingerprint text not null, spec text not null, retry_of integer unique, reason text, status text not null, begun_at text not null);
                create table if not exists events (event_id integer primary key, run_id integer not null, kind text not null, body text not null, at text not null);
                create trigger if not exists events_stay before update on events begin select raise(abort, 'events are append-only'); end;
                create trigger if not exists events_remain before delete on events begin select raise(abort, 'events are append-only'); end;
                create trigger if not exists runs_remain before delete on runs begin select raise(abort, 'runs are kept'); end;
                create trigger if not exists runs_keep_identity before update of run_id, fingerprint, spec, retry_of, begun_at on runs begin select raise(abort, 'a run keeps its identity'); end;"""
            )

    def _db(self) -> sqlite3.Connection:
        return sqlite3.connect(self.path, isolation_level="immediate")

    def check(self, spec: dict) -> str | None:
        """The state of the latest run of the same fingerprint, or None."""
        with self._db() as db:
            row = db.execute("select status from runs where fingerprint = ? order by run_id desc limit 1", (fingerprint(spec),)).fetchone()
        return row and row[0]

    def begin(self, spec: dict, retry_reason: str | None = None) -> int:
        """A new run's number. The same fingerprint is taken again only as a retry, with a reason, of its latest run, which must
        have ended."""
        mark, now = fingerprint(spec), datetime.now(UTC).isoformat()
        with self._db() as db:
            last = db.execute("select run_id, status from runs where fingerprint = ? order by run_id desc limit 1", (mark,)).fetchone()
            if last and (not retry_reason or last[1] not in TERMINAL):
                raise Refused("a run with this fingerprint is there already")
            if not last and retry_reason:
                raise Refused("there is nothing to retry")
            run = db.execute("insert into runs (fingerprint, spec, retry_of, reason, status, begun_at) values (?, ?, ?, ?, 'running', ?)", (mark, json.dumps(canonical(spec), ensure_ascii=False), last and last[0], retry_reason, now)).lastrowid
            db.execute("insert into events (run_id, kind, body, at) values (?, 'begun', '{}', ?)", (run, now))
        return run

    def finish(self, run: int, status: str, artifacts: dict[str, str] | None = None) -> None:
        """Ends a run, once; artifacts are names with their SHA-256."""
        if status not in TERMINAL or any(not re.fullmatch("[0-9a-f]{64}", h) for h in (artifacts or {}).values()):
            raise Refused("no ending state, or an artifact without a digest")
        with self._db() as db:
            if db.execute("update runs set status = ? where run_id = ? and status = 'running'", (status, run)).rowcount != 1:
                raise Refused("the run isn't running")
            db.execute("insert into events (run_id, kind, body, at) values (?, 'finished', ?, ?)", (run, json.dumps({"status": status, "artifacts": artifacts or {}}, sort_keys=True), datetime.now(UTC).isoformat()))

    def runs(self, spark: SparkSession) -> DataFrame:
        return sqlite_table(spark, self.path, "runs", "run_id long, fingerprint string, spec string, retry_of long, reason string, status string, begun_at string")

    def log(self, spark: SparkSession) -> DataFrame:
        return sqlite_table(spark, self.path, "events", "event_id long, run_id long, kind string, body string, at string")

"""Edit and delete state per message, kept by the stream itself."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 1024
OUT = "account_id string, chat_id string, message_id string, arrival bigint, kind string, update_id string, status string, version bigint"
#: Messages by name, and each one's ``[deleted, known, top_ts, top_uid, version, completed]`` as JSON.
STATE = "messages array<string>, states array<string>"


def _advance(state: tuple, done: set[str], kind: str, ts: int | None, uid: str | None) -> tuple[tuple, str]:
    """State and status after one update; the rules are those of ``sync.classify_updates``. ``done``: the completed keys, to look up."""
    deleted, known, top_ts, top_uid, version, completed = state
    if kind == "delete":
        return (True, known, top_ts, top_uid, version, completed), "skipped" if deleted else "ok" if known else "not_found"
    if kind == "new":
        status = "blocked" if deleted else "ignore" if known else "created"
        return (deleted, True, top_ts, top_uid, max(version, 1), completed), status
    if deleted:
        return (deleted, True, top_ts, top_uid, version, completed), "deleted"
    key = uid or str(ts)
    if key in done:
        return state, "duplicate"
    late = ts is not None and top_ts is not None and (ts < top_ts or ts == top_ts and bool(uid) and bool(top_uid) and uid < top_uid)
    if late:
        return (deleted, True, top_ts, top_uid, version, completed), "stale"
    if ts is not None:
        top_ts, top_uid = max((ts, uid or ""), (top_ts if top_ts is not None else ts, top_uid or ""))
    done.add(key)
    completed.append(key)
    return (deleted, True, top_ts, top_uid, version + 1 if known else 1, completed), "apply" if known else "upsert"


def _bucket(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The updates of a bucket's messages: only messages with updates are decoded, the others' state stays the text that it is."""
    held = dict(zip(*state.get, strict=True)) if state.exists else {}
    columns = ("account_id", "chat_id", "message_id", "arrival", "kind", "edit_us", "update_id")
    by_message: dict[tuple, list[tuple]] = {}
    for pdf in batches:
        for row in zip(*(pdf[c].tolist() for c in columns), strict=True):
            by_message.setdefault(row[:3], []).append(row)
    out, status, versions = [], [], []
    for message, rows in by_message.items():
        name = json.dumps(message)
        now = json.loads(held[name]) if name in held else [False, False, None, None, 0, []]
        done = set(now[5])
        for row in sorted(rows, key=lambda r: (r[3], r[6] is None, r[6] or "")):
            ts = row[5]
            now, s = _advance(now, done, row[4], None if ts is None or ts != ts else int(ts), row[6])
            out.append(row)
            status.append(s)
            versions.append(now[4] if s in ("created", "upsert", "apply") else None)
        held[name] = json.dumps(now)
    state.update((list(held), list(held.values())))
    found = pd.DataFrame(out, columns=list(columns)).drop(columns="edit_us")
    yield found.assign(status=status, version=pd.array(versions, "Int64"))


def classified_stream(updates: DataFrame) -> DataFrame:
    """A stream of updates with status and version, decided as they arrive.

    State is a few values a message and the keys of its completed edits, held in ``BUCKETS`` buckets of messages: a call for each message would
    cost more than its updates do. A deleted message's state stays, so that an edit that comes later than any delay is still refused. Needs edits
    that carry their content in full.
    """
    bucket = f"pmod(xxhash64(account_id, chat_id, message_id), {BUCKETS}) AS bucket"
    timed = updates.selectExpr("account_id", "chat_id", "message_id", "kind", "unix_micros(CAST(edit_ts AS TIMESTAMP)) AS edit_us", "update_id", "CAST(arrival AS BIGINT) AS arrival", bucket)
    return timed.groupBy("bucket").applyInPandasWithState(_bucket, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

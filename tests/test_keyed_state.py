"""The keyed state of a bucket of messages, one with a long history."""

import json
import time

import pandas as pd

from chatloom.streaming import edits


class State:
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def test_a_long_history_costs_what_its_updates_do():
    n, state, out = 20_000, State(), []
    began = time.process_time()
    for first in (0, n):
        rows = pd.DataFrame({"account_id": "a", "chat_id": "c", "message_id": "m", "arrival": range(first, first + n), "kind": ["new" if i == 0 else "edit" for i in range(first, first + n)], "edit_us": [float(i) for i in range(first, first + n)], "update_id": [f"{i % 30_000:06d}" for i in range(first, first + n)]})
        out += [found for found in edits._bucket((7,), iter([rows.iloc[::-1][: n // 2], rows.iloc[::-1][n // 2 :]]), state)]
    assert time.process_time() - began < 5
    got = pd.concat(out)
    assert list(got["arrival"]) == list(range(2 * n)) and got["status"].value_counts().to_dict() == {"apply": 30_000, "duplicate": 9_999, "created": 1}
    assert got["version"].max() == 30_001 and len(json.loads(state.get[1][0])[5]) == 30_000


def test_messages_of_a_bucket_stay_apart():
    state = State()
    rows = lambda *found: pd.DataFrame(found, columns=["account_id", "chat_id", "message_id", "arrival", "kind", "edit_us", "update_id"])
    first = pd.concat(edits._bucket((0,), iter([rows(("a", "c", "m1", 2, "edit", 5.0, "u2"), ("a", "c", "m2", 1, "delete", 1.0, "u1")), rows(("a", "c", "m1", 1, "new", 1.0, "u1"))]), state))
    assert {(r.message_id, r.arrival): r.status for r in first.itertuples()} == {("m1", 1): "created", ("m1", 2): "apply", ("m2", 1): "not_found"}
    kept = dict(zip(*state.get, strict=True))
    second = pd.concat(edits._bucket((0,), iter([rows(("a", "c", "m1", 3, "edit", 5.0, "u2"), ("b", "c", "m1", 1, "edit", None, None))]), state))
    assert {(r.account_id, r.arrival): (r.status, None if pd.isna(r.version) else r.version) for r in second.itertuples()} == {("a", 3): ("duplicate", None), ("b", 1): ("upsert", 1)}
    m2 = json.dumps(["a", "c", "m2"])
    assert dict(zip(*state.get, strict=True))[m2] == kept[m2] and len(state.get[0]) == 3

"""Conversation repair against brute force, over rows with nulls, ties, repeats, long conversations and an empty table."""

import hashlib
import itertools
import random
import zlib

import pytest

from gatedframe.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, cid string, code int"
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        spelled = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(spelled).encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        out += [] if fault == 0 else [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit, rows) of all edits; rows: (role, text, fault)."""
    table = {"": {(0, "", ())}}  # by state: (cost, audit, rows)

    def inserts(table):
        for _ in range(3):
            for state, found in list(table.items()):
                to = FOLLOWS[state]
                table.setdefault(to, set()).update((c + 5, a + "I", (*o, ("user" if to == "u" else "assistant", ""))) for c, a, o in list(found) if not a.endswith("II"))
        return table

    for role, text, fault in rows:
        after = {}
        for state, found in inserts(table).items():
            for c, a, o in found:
                after.setdefault(state, set()).add((c + 2, a + "D", o))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 * (fault == "truncated")
                to = FOLLOWS[state]
                after.setdefault(to, set()).add((c + 1 + extra, a + "R", (*o, ("user" if to == "u" else "assistant", text))))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    after.setdefault(role[:1], set()).add((c + extra, a + "K", (*o, (role, text))))
        table = {}
        for state, found in after.items():  # of one state only the cheapest can go on
            low = min(c for c, _, _ in found)
            least = min(x for x in found if x[0] == low)
            table[state] = {least}
    ends = [x for state, found in inserts(table).items() if state in ("", "a") for x in found]
    return min(ends)


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faulty = set(), []
        for _, _, role, text in own:
            held = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest(faulty)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == x for _, _, f in faulty) for x in ("blank", "duplicate", "truncated")]
        out[conv] = (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def some_rows(seed, conversations_=120, longest=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "Well?", "", " \n", "Fine. ", None, "été.", "𝄞!", "a,b", "same.", "same."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sys"]
    rows = []
    for conv in range(conversations_):
        straight = rng.random() < 0.5
        for k in range(rng.randrange(1, longest)):
            role = (["user", "assistant"][k % 2] if rng.random() < 0.8 else rng.choice(roles)) if straight else rng.choice(roles)
            turn = None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 2]) if rng.random() < 0.9 else 0
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"words {rng.random()}{rng.choice('.!?x')}"))
    return rows


def got(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = [tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r for r in found}


@pytest.fixture
def small_blocks(monkeypatch):
    """Conversations cut into blocks of 3 rows and partitions of 20."""
    monkeypatch.setattr(conversations, "BLOCK", 3)
    monkeypatch.setattr(conversations, "PART_ROWS", 20)


def test_query_is_brute_force(spark, tmp_path):
    rows = some_rows(1) + [(None, 3, "user", "no id."), (None, None, "assistant", "none."), (None, 4, "assistant", "Right.")]
    rows += [(500, None, "user", "a."), (500, None, "assistant", "b."), (501, 9, "user", None), (502, -3, "system", "x."), (502, 40, "user", "y.")]
    rows += [(600, 1, "user", "the same.")] * 7
    assert got(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_cut_conversations(spark, tmp_path, small_blocks, seed):
    rows = some_rows(seed, 40, 60)
    assert got(spark, rows, tmp_path) == brute(rows)


def test_one_conversation_holds_half_of_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 64)
    monkeypatch.setattr(conversations, "PART_ROWS", 300)
    rng = random.Random(9)
    rows = some_rows(4, 200) + [(7777, k, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(900)}{rng.choice('..!x')}") for k in range(1500)]
    rows += [(8888, 5, "user", "one row over and over.")] * 700
    assert got(spark, rows, tmp_path) == brute(rows)


def test_very_long_texts(spark, tmp_path):
    rows = [(c, k, ["user", "assistant"][k % 2], "word " * 200_000 + "." * (k % 3)) for c in range(2) for k in range(6)]
    assert got(spark, rows, tmp_path) == brute(rows)


def test_conversations_without_rows_and_an_empty_table(spark, tmp_path):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert got(spark, [(dropped, 0, "user", "gone.")], tmp_path) == {dropped: (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    empty = spark.createDataFrame([], SCHEMA)
    found = conversations.repair(empty)
    assert found.summary.count() == 0 and found.rows.count() == 0


def test_rows_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "And?"), (1, 4, "assistant", "cut"), (2, 0, "user", "Alone.")]
    found = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lines = [(r.cid, r.edit, r.role, r.text) for r in found.rows.orderBy("cid", "pos", "nth").collect()]
    audits = {r.conv_id: r.audit for r in found.summary.collect()}
    for conv, audit in audits.items():
        assert [e for c, e, _, _ in lines if c == f"={conv}"] == [e for e in audit if e != "D"]
        initials = "".join(r[:1] for c, _, r, _ in lines if c == f"={conv}")
        assert not initials or (len(initials) > 1 and initials.removeprefix("s").replace("ua", "") == "")


def test_stored_costs_are_those_of_the_definition():
    """A row is worked out from the costs behind it; a conversation of one row from those at the end."""
    import numpy as np

    v = conversations.costs_back(np.array([[2]], np.uint8), np.array([1]), conversations.ENDS[None])
    assert v[0, 0].tolist() == [2, 5, 1, 2]  # a user's row: delete it; after a system row keep it and insert an answer; after a user's give it to the assistant; delete it

"""Cheapest repair of conversations whose turns are blank, repeated, cut off or out of order.

A conversation is right if its role initials are ``(s?(ua)+)?``. A row can be kept, given another role, or deleted, and rows without text can be
inserted; the cheapest edits are found by dynamic programming over four states (nothing yet, after system, after user, after assistant). From any state only one of user
and assistant can follow, so an edit leads to one state and the edits alone tell the roles.

Rows are put in order by one range exchange on (conversation, turn, role, text, a number of their own), so that a conversation of any length lies in consecutive
partitions. Blocks of up to ``BLOCK`` rows are worked out as tensors, time first: blocks of like length stand side by side, costs to the end are stored
turn by turn backwards, and edits are read off forwards, for all of them at once. A conversation that is cut by the end of a partition or longer
than a block takes three steps: each block gives its costs from every state to every state, these are folded from the end of the conversation, and the
blocks are read off from each state they could be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch, broadcast_if_few
from gatedframe.llm.words import pieces

GAPS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state after the one role among user and assistant that may follow each state.
FOLLOWS = np.array([USER, USER, ASSISTANT, USER])
#: Costs at the end of a conversation: it may end before any row and after an assistant's.
FAR = 1 << 50
ENDS = np.array([0, FAR, FAR, 0], np.int64)
#: Faults of a row, of which the first counts.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: Rows of a block, rows of a partition about, and the most partitions.
BLOCK, PART_ROWS, MOST_PARTS = 4096, 20_000, 20_000
#: Cells (turns times blocks) that are worked out at once.
CELLS = 1 << 17


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs of states (blocks, states), with what inserts at the same place save. Two inserts may follow each other."""
    v = v.copy()
    v[:, USER] = np.minimum(v[:, USER], v[:, ASSISTANT] + INSERT)
    for s in (START, SYSTEM, ASSISTANT):
        v[:, s] = np.minimum(v[:, s], v[:, USER] + INSERT)
    return v


def _kept(v: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Costs (blocks, states) after a row with this role initial is kept."""
    out = np.full_like(v, FAR)
    out[:, START] = np.where(initial == SYSTEM, v[:, SYSTEM], np.where(initial == USER, v[:, USER], FAR))
    for s in (SYSTEM, USER, ASSISTANT):
        out[:, s] = np.where(initial == FOLLOWS[s], v[:, FOLLOWS[s]], FAR)
    return out


def _row_costs(after: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (blocks, states) if the row is deleted, kept and given the role that fits."""
    initial, fault = code & 3, code >> 2
    more = np.where((fault == BLANK) | (fault == DUPLICATE), FAR, np.where(fault == CUT, TRUNCATED, 0))[:, None]
    return after + DELETE, _kept(after, initial) + KEEP + more, after[:, FOLLOWS] + REROLE + more


def costs_back(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to the end before each turn, (turns + 1, blocks, states). ``codes`` is (turns, blocks), a role initial and four times a fault; ``ends`` the costs behind the last turn."""
    v = np.empty((len(codes) + 1, len(lengths), STATES), np.int64)
    v[-1] = _closed(ends)
    for t in range(len(codes) - 1, -1, -1):
        here = _closed(np.minimum.reduce(_row_costs(v[t + 1], codes[t])))
        v[t] = np.where((t < lengths)[:, None], np.minimum(here, FAR), v[t + 1])
    return v


def edits_forward(codes: np.ndarray, lengths: np.ndarray, v: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
    """(initials of the edits, the same with the role that each sets behind it, state behind) of each block, entered in ``state``; of edits that cost the same the ASCII-least.

    Roles are u and a for edits that set one, = for Keep and - for Delete. ``last``: the conversation ends with the block, so that rows may be inserted behind it.
    """
    turns, blocks = codes.shape
    done, roles, each, state = np.zeros((turns + 1, 3, blocks), np.uint8), np.zeros((turns + 1, 3, blocks), np.uint8), np.arange(blocks), state.copy()
    delete, insert, keep, rerole = (np.uint8(ord(c)) for c in "DIKR")
    for t in range(turns + 1):
        row = t < lengths
        waiting = row | ((t == lengths) & last)
        costs = dict(zip((delete, keep, rerole), _row_costs(v[t + 1], codes[t]))) if t < turns else {}
        for slot in range(3):  # two inserts at most, and then the row itself
            now, into = v[t][each, state], FOLLOWS[state]
            pick = np.zeros(blocks, np.uint8)
            for letter in (rerole, keep, insert, delete):  # the least last
                if letter == insert:
                    pick[v[t][each, into] + INSERT == now] = insert
                elif costs:
                    pick[row & (costs[letter][each, state] == now)] = letter
            pick[~waiting] = 0
            done[t, slot] = pick
            roles[t, slot] = np.select([pick == delete, pick == keep, into == USER], [ord("-"), ord("="), ord("u")], ord("a"))
            if t < turns:
                state = np.where(pick == keep, codes[t] & 3, state)
            state = np.where((pick == insert) | (pick == rerole), into, state)
            waiting &= pick == insert
            if not waiting.any():
                break
    by_block = done.transpose(2, 0, 1)
    full = by_block > 0
    ends = np.cumsum(full.sum((1, 2)))
    audits, pairs = by_block[full].tobytes().decode(), np.stack((by_block[full], roles.transpose(2, 0, 1)[full]), -1).tobytes().decode()
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    return [audits[a:b] for a, b in spans], [pairs[2 * a : 2 * b] for a, b in spans], state


@dataclass
class _Block:
    """Consecutive rows of one conversation in one partition. ``inner``: neither the first nor the last conversation of its partition, so that it is whole."""

    cid: str
    part: int
    first: int
    codes: np.ndarray
    inner: bool
    ends: np.ndarray | None = None
    last: bool = True


def _tensors(blocks: list[_Block]) -> Iterator[tuple[list[_Block], np.ndarray, np.ndarray]]:
    """Blocks in buckets of like length (by powers of two): (blocks, codes by turn, lengths)."""
    by_length: dict[int, list[_Block]] = {}
    for b in blocks:
        by_length.setdefault(1 << max(0, len(b.codes) - 1).bit_length(), []).append(b)
    for turns, alike in by_length.items():
        step = max(1, CELLS // turns)
        for k in range(0, len(alike), step):
            some = alike[k : k + step]
            lengths = np.array([len(b.codes) for b in some])
            codes = np.zeros((len(some), int(lengths.max())), np.uint8)
            codes[np.arange(codes.shape[1]) < lengths[:, None]] = np.concatenate([b.codes for b in some])
            yield some, np.ascontiguousarray(codes.T), lengths


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    """Blocks of rows (cid, part, pos, kind, code, ends, last) in the order of (part, pos, kind). kind 0 says that the row behind it is the first of its role and text; kind 1 gives
    costs behind the block that begins with the row behind it; kind 2 is a row."""
    carried, held, part_now, opened = None, None, None, None

    def closed(b: _Block, ends_part: bool) -> _Block:
        b.inner = not ends_part and b.cid != opened
        return b

    for batch in batches:
        if carried is not None and carried.num_rows:
            batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
        kind = batch.column(3).to_numpy()
        rows = np.flatnonzero(kind == 2)
        carried = batch.slice(int(rows[-1]) + 1 if len(rows) else 0)  # what belongs to the next batch's first row
        if not len(rows):
            continue
        before, second = np.concatenate([[-1, -1], kind])[rows + 1], np.concatenate([[-1, -1], kind])[rows]
        first = (before == 0) | ((before == 1) & (second == 0))
        code = batch.column(4).to_numpy()[rows]
        code = np.where((code >> 2 != BLANK) & ~first, (DUPLICATE << 2) | (code & 3), code).astype(np.uint8)
        names = batch.column(0).dictionary_encode()
        name, part, pos = names.indices.to_numpy()[rows], batch.column(1).to_numpy()[rows], batch.column(2).to_numpy()[rows]
        told = before == 1
        bounds = [0, *(np.flatnonzero((name[1:] != name[:-1]) | (part[1:] != part[:-1]) | told[1:]) + 1).tolist(), len(rows)]
        for a, b in zip(bounds, bounds[1:]):
            cid, at, run = names.dictionary[int(name[a])].as_py(), int(part[a]), code[a:b]
            if held is not None and held.cid == cid and held.part == at and not told[a]:
                held.codes = np.concatenate([held.codes, run])
            else:
                if held is not None:
                    yield closed(held, held.part != at)
                if at != part_now:
                    part_now, opened = at, cid
                note = int(rows[a]) - 1
                given = (np.array(batch.column(5)[note].as_py(), np.int64), batch.column(6)[note].as_py()) if told[a] else (None, True)
                held = _Block(cid, at, int(pos[a]), run, False, *given)
            while len(held.codes) > BLOCK:
                yield _Block(held.cid, held.part, held.first, held.codes[:BLOCK], False)
                held = _Block(held.cid, held.part, held.first + BLOCK, held.codes[BLOCK:], False)
                opened = held.cid  # the rest of it isn't whole either
    if held is not None:
        yield closed(held, True)


def _some(blocks: Iterable[_Block], cells: int = CELLS) -> Iterator[list[_Block]]:
    held, n = [], 0
    for b in blocks:
        held.append(b)
        n += len(b.codes)
        if n >= cells:
            yield held
            held, n = [], 0
    if held:
        yield held


OUT = pa.schema(
    [("cid", pa.string()), ("part", pa.int64()), ("first", pa.int64()), ("rows", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
     ("opens", pa.int64()), ("closes", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("steps", pa.string()), ("matrix", pa.list_(pa.int64()))]
)
OUT_DDL = "cid string, part long, first long, rows long, blank long, duplicate long, truncated long, illegal long, opens long, closes long, cost long, audit string, steps string, matrix array<bigint>"


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: counts of faults, and edits of whole conversations or the costs from state to state of others."""
    for some in _some(_blocks(batches)):
        out = []
        for blocks, codes, lengths in _tensors(some):
            turns = np.arange(len(codes))[:, None] < lengths
            initial, fault = codes & 3, codes >> 2
            follows = ((initial[:-1] == SYSTEM) & (initial[1:] == USER)) | ((initial[:-1] == USER) & (initial[1:] == ASSISTANT)) | ((initial[:-1] == ASSISTANT) & (initial[1:] == USER))
            illegal = (~follows & turns[1:]).sum(0)
            faults = [((fault == f) & turns).sum(0) for f in (BLANK, DUPLICATE, CUT)]
            inner = np.array([b.inner for b in blocks])
            audits, steps, cost, matrix = [None] * len(blocks), [None] * len(blocks), [None] * len(blocks), [None] * len(blocks)
            if inner.any():
                at = np.flatnonzero(inner)
                v = costs_back(codes[:, at], lengths[at], np.tile(ENDS, (len(at), 1)))
                a, r, _ = edits_forward(codes[:, at], lengths[at], v, np.zeros(len(at), int), np.ones(len(at), bool))
                for k, i in enumerate(at):
                    audits[i], steps[i], cost[i] = a[k], r[k], int(v[0, k, START])
            if not inner.all():
                at = np.flatnonzero(~inner)
                ends = np.tile(np.where(np.eye(STATES, dtype=bool), 0, FAR).astype(np.int64), (len(at), 1))  # for each block, an end in each state
                v = costs_back(np.repeat(codes[:, at], STATES, 1), np.repeat(lengths[at], STATES), ends)[0].reshape(len(at), STATES, STATES)
                for k, i in enumerate(at):
                    matrix[i] = v[k].T.ravel().tolist()  # [from][to]
            for i, b in enumerate(blocks):
                n = int(lengths[i])
                out.append((b.cid, b.part, b.first, n, *(int(f[i]) for f in faults), int(illegal[i]), int(initial[0, i]), int(initial[n - 1, i]), cost[i], audits[i], steps[i], matrix[i]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), OUT.types)], schema=OUT)


def _entered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, part, first, entered, left, cost, audit, steps): the edits of each block with given costs behind it, from each state."""
    for some in _some(_blocks(batches), CELLS // STATES):
        out = []
        for blocks, codes, lengths in _tensors(some):
            wide = lambda x: np.repeat(x, STATES, -1)
            ends = np.repeat(np.array([b.ends for b in blocks]), STATES, 0)
            v = costs_back(wide(codes), wide(lengths), ends)
            entered = np.tile(np.arange(STATES), len(blocks))
            audits, steps, left = edits_forward(wide(codes), wide(lengths), v, entered, wide(np.array([b.last for b in blocks])))
            behind = np.where(wide(np.array([b.last for b in blocks])), 0, v[-1][np.arange(len(left)), left])
            for i, b in enumerate(np.repeat(np.array(blocks, object), STATES)):
                out.append((b.cid, b.part, b.first, int(entered[i]), int(left[i]), int(v[0, i, entered[i]] - behind[i]), audits[i], steps[i]))
        names = ["cid", "part", "first", "entered", "left", "cost", "audit", "steps"]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def _fold(blocks: pd.DataFrame) -> pd.DataFrame:
    """Costs behind each block of one conversation, from its end."""
    blocks = blocks.sort_values("first")
    v, ends = _closed(ENDS[None])[0], []
    for matrix in reversed(blocks["matrix"].tolist()):
        ends.append(v.tolist())
        v = np.minimum((np.array(matrix).reshape(STATES, STATES) + v).min(1), FAR)
    return pd.DataFrame({"cid": blocks["cid"], "part": blocks["part"], "first": blocks["first"], "ends": ends[::-1], "last": [False] * (len(ends) - 1) + [True]})


def _walk(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state that each block of one conversation is entered in."""
    state, out = START, []
    for first, some in blocks.sort_values("first").groupby("first", sort=True):
        out.append((blocks["cid"].iloc[0], first, state))
        state = int(some.loc[some["entered"] == state, "left"].iloc[0])
    return pd.DataFrame(out, columns=["cid", "first", "entered"])


def _key(c: Column) -> Column:
    """A text for each value of a conversation's id, null included."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


@dataclass
class Repaired:
    """``summary``: a row for each conversation id (below). ``rows``: the repaired rows (cid, pos, nth, edit, role, text), in the order of (pos, nth) within a conversation."""

    summary: DataFrame
    rows: DataFrame


def _code(role: Column, text: Column) -> Column:
    initial = F.substring(role, 1, 1)
    held = F.rtrim(text, F.lit(GAPS))
    fault = F.when(held == "", BLANK).when(~F.substring(held, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    return F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(START) + fault * 4


def repair(conversations: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Repairs every conversation of a table with a row for each turn.

    A row's first fault counts: blank (no character but gaps), duplicate (role and text stood before in the conversation) or truncated (the last character that is no gap isn't ``.``, ``!`` or
    ``?``). Blank and duplicate rows have to go. Costs: keeping 0, another role 1, deleting 2, inserting a row without text 5, and 5 for each truncated row that stays.

    ``summary`` has (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each id of ``ids`` (those of the table if left out): missing numbers between the least and greatest turn,
    rows by fault, neighbours whose role initials aren't su, ua or au, and the initials of the cheapest edits in order, of which the ASCII-least are taken where several cost the same. An id
    without rows has zeros and an empty audit. Rows lie in the order of turn (nulls first); of one turn by role and text, by their bytes.
    A null role or text counts as empty, null ids are one conversation, and other columns are not read.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "conversations")
    id_, turn = F.col(f"`{id_col}`"), F.col(f"`{turn_col}`").cast("long")
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(_key(id_).alias("cid"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    parts = max(1, min(MOST_PARTS, -(-rows.count() // PART_ROWS)))
    # the last key deals rows that are alike in all others to several partitions
    dealt = rows.withColumn("own", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, "cid", F.col("turn").asc_nulls_first(), "role", "text", "own")
    dealt = dealt.sortWithinPartitions("cid", F.col("turn").asc_nulls_first(), "role", "text", "own")
    numbered = dealt.select("cid", "turn", "role", "text", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("pos"))
    marked = numbered.withColumns({"code": _code(F.col("role"), F.col("text")), "d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit(1), "role", "text")})
    ordered = scratch.table(marked, "ordered")

    # the first row of each role and text stands before the row itself in the stream, so that no join is needed
    least = ordered.groupBy("cid", "d1", "d2").agg(F.min(F.struct("pos", "part")).alias("at"))
    none = [F.lit(None).cast("array<bigint>").alias("ends"), F.lit(None).cast("boolean").alias("last")]
    firsts = least.select("cid", F.col("at.part").alias("part"), F.col("at.pos").alias("pos"), F.lit(0).alias("kind"), F.lit(0).alias("code"), *none)
    plain = ordered.select("cid", "part", "pos", F.lit(2).alias("kind"), "code", *none)
    stream = lambda *tables: reduce(DataFrame.union, tables).repartition(parts, "part").sortWithinPartitions("part", "pos", "kind")
    solved = scratch.table(stream(plain, firsts).mapInArrow(_solved, OUT_DDL), "solved")

    # conversations at the ends of partitions or longer than a block: at most two a partition but for long ones
    cut = solved.where("matrix is not null")
    folded = scratch.table(cut.select("cid", "part", "first", "matrix").groupBy("cid").applyInPandas(_fold, "cid string, part long, first long, ends array<bigint>, last boolean"), "folded")
    runs = broadcast_if_few(scratch.table(folded.select("cid", "part").distinct(), "runs"))
    costs = folded.select("cid", "part", F.col("first").alias("pos"), F.lit(1).alias("kind"), F.lit(0).alias("code"), "ends", "last")
    again = stream(plain.join(runs, ["cid", "part"], "left_semi"), firsts.join(runs, ["cid", "part"], "left_semi"), costs)
    entered = scratch.table(again.mapInArrow(_entered, "cid string, part long, first long, entered long, left long, cost long, audit string, steps string"), "entered")
    walked = entered.select("cid", "first", "entered", "left").groupBy("cid").applyInPandas(_walk, "cid string, first long, entered long")
    chosen = entered.join(walked, ["cid", "first", "entered"]).select("cid", "part", "first", "cost", "audit", "steps")
    edits = scratch.table(solved.where("matrix is null").select("cid", "part", "first", "cost", "audit", "steps").union(chosen), "edits")

    turns = ordered.groupBy("cid", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("cid").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    before = F.lag("closes").over(Window.partitionBy("cid").orderBy("first"))
    fits = ((F.col("before") == SYSTEM) & (F.col("opens") == USER)) | ((F.col("before") == USER) & (F.col("opens") == ASSISTANT)) | ((F.col("before") == ASSISTANT) & (F.col("opens") == USER))
    seen = solved.withColumn("before", before).groupBy("cid").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), (F.sum("illegal") + F.count_if(F.col("before").isNotNull() & ~fits)).alias("illegal"))
    whole = edits.groupBy("cid").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "audit"))), lambda b: b["audit"]), "").alias("audit"))
    wanted = (conversations if ids is None else ids).select(id_.alias(id_col), _key(id_).alias("cid")).distinct()
    joined = wanted.join(turns, "cid", "left").join(seen, "cid", "left").join(whole, "cid", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    summary = joined.select(F.col(id_col), "cid", *zero, F.coalesce("audit", F.lit("")).alias("audit"))

    # a row's letters are the inserts before it and its own edit; behind the last row also what is inserted at the end
    letters = F.regexp_extract_all("steps", F.lit("(?:I.)*[DKR].(?:(?:I.)+$)?"), F.lit(0))
    steps = edits.select("first", F.posexplode(letters).alias("i", "letters")).select((F.col("first") + F.col("i")).alias("pos"), "letters")
    met = ordered.select("cid", "pos", "role", "text").join(steps, "pos")

    def line(k: Column) -> Column:
        edit, given = F.substring("letters", 2 * k - 1, F.lit(1)), F.substring("letters", 2 * k, F.lit(1))
        role = F.when(given == "u", "user").when(given == "a", "assistant").otherwise(F.col("role"))
        return F.struct(k.alias("nth"), edit.alias("edit"), role.alias("role"), F.when(edit == "I", "").otherwise(F.col("text")).alias("text"))

    made = F.transform(F.sequence(F.lit(1), (F.length("letters") / 2).cast("int")), line)
    lines = met.select("cid", "pos", F.explode(F.filter(made, lambda x: x["edit"] != "D")).alias("x"))
    return Repaired(summary, lines.select("cid", "pos", "x.nth", "x.edit", "x.role", "x.text"))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sha256) of lines (cid, line) in order, joined by newlines; one line is held at a time besides its batch."""
    cid, digest, out = None, None, []
    schema = pa.schema([("cid", pa.string()), ("repaired_sha256", pa.string())])
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
    for batch in pieces(batches):
        for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != cid or digest is None:
                if digest is not None:
                    out.append((cid, digest.hexdigest()))
                cid, digest = name, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        if len(out) > 4096:
            yield batch_of(out)
            out = []
    if digest is not None:
        yield batch_of([*out, (cid, digest.hexdigest())])


def digests(rows: DataFrame) -> DataFrame:
    """(cid, repaired_sha256) of ``Repaired.rows``: the hash of ``role:text`` of a conversation's rows, joined by newlines.

    A hash takes its text in order, so one task reads all rows of a conversation; it streams them and holds a batch.
    """
    lines = rows.select("cid", F.concat("role", F.lit(":"), "text").alias("line"), "pos", "nth").repartition("cid").sortWithinPartitions("cid", "pos", "nth")
    return lines.select("cid", "line").mapInArrow(_hashed, "cid string, repaired_sha256 string")


def damage(conversations: DataFrame, one_in: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) with faults, chosen by crc32 of ``conv_id:turn``: of ``one_in`` turns one is dropped, one loses its text, one its sentence ends, one is said twice,
    and one is given to the user. A null is one space, in the text, the role and what is hashed."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % one_in
    rows = conversations.select("conv_id", "turn", spelled("role").alias("role"), spelled("text").alias("text"), drawn.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("nth")).drop("nth")

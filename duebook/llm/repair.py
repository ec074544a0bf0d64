"""Repair of conversations: the cheapest edits that turn the roles into an optional system turn and pairs of user and assistant turns.

Method of the Four Russians. What it costs to end a conversation well from each of the four states is a vector; less its least entry there
are few such vectors. Tables made once hold, for each vector and each block of four turns, the vector before the block and what the
least entry grew by, so a conversation is priced block by block, from its end, with one lookup each. Then blocks are expanded backward into the vectors
between their turns, and a walk from the start takes the least edit that keeps to the least cost, which settles ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import numbered, ship
from duebook.session import materialise

#: Turns of a block of the tables.
BLOCK = 4
#: A conversation is handled in pieces of so many turns or bytes at most.
TURNS, BYTES = 4096, 8 << 20
#: Costs of edits, and of a turn that is kept or given another role although its text is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. Initials: system, user, assistant, any other.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
#: The state after a turn that is inserted or given the role that fits.
FIT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Symbols of turns: 0 must go, 1 to 4 are sound turns by initial, 5 to 8 turns that are cut off.
SYMBOLS = 9
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)


def _with_inserts(costs: list[float]) -> tuple[float, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[FIT[x]]) for x, c in enumerate(costs)]
    return tuple(costs)


def _edits(symbol: int, state: int, after: tuple[float, ...]) -> list[tuple[str, float, int]]:
    """Edits of a turn as (initial, cost from here, next state), initials ascending."""
    found = [("D", DELETE + after[state], state)]
    if symbol:
        more = CUT_OFF * (symbol > 4)
        if (to := KEEP[(symbol - 1) % 4].get(state)) is not None:
            found.append(("K", more + after[to], to))
        found.append(("R", REROLE + more + after[FIT[state]], FIT[state]))
    return found


def _before(symbol: int, after: tuple[float, ...]) -> tuple[float, ...]:
    return _with_inserts([min(cost for _, cost, _ in _edits(symbol, x, after)) for x in range(4)])


def _walk(symbol: int, state: int, after: tuple[float, ...]) -> tuple[str, int]:
    """The least of the cheapest edits from a state up to and with this turn."""
    costs, taken = _before(symbol, after), ""
    while True:
        steps = {i: to for i, cost, to in _edits(symbol, state, after) if cost == costs[state]}
        if "D" not in steps and INSERT + costs[FIT[state]] == costs[state]:
            taken, state = taken + "I", FIT[state]
            continue
        edit = min(steps)
        return taken + edit, steps[edit]


class Tables(NamedTuple):
    """``vectors`` by number, the first the one at the end. By vector after a turn and its symbol: the vector before it and the growth of the least cost, and
    ``edits`` by the state before it. By vector after a block and code of the block: the same two, the vectors after each of its turns, and the state
    at its end by the state before it."""
    vectors: list[tuple[float, ...]]
    one: list[list[tuple[int, int]]]
    before: np.ndarray
    growth: np.ndarray
    within: np.ndarray
    ends: np.ndarray
    edits: list[list[list[tuple[str, int]]]]


@cache
def tables() -> Tables:
    """All tables; they do not depend on the data."""
    end = _with_inserts([0, float("inf"), float("inf"), 0])
    numbers, vectors, step = {end: 0}, [end], {}
    for v, after in enumerate(vectors):  # grows meanwhile
        for symbol in range(SYMBOLS):
            costs = _before(symbol, after)
            normal = tuple(c - min(costs) for c in costs)
            if normal not in numbers:
                numbers[normal] = len(vectors)
                vectors.append(normal)
            step[v, symbol] = numbers[normal], min(costs)
    edits = [[[_walk(symbol, x, after) for x in range(4)] for symbol in range(SYMBOLS)] for after in vectors]
    shape = len(vectors), SYMBOLS ** BLOCK
    before, growth, within, ends = (np.zeros(shape, np.int16), np.zeros(shape, np.int64), np.zeros((*shape, BLOCK), np.int16), np.zeros((*shape, 4), np.int8))
    single = [[step[v, s] for s in range(SYMBOLS)] for v in range(len(vectors))]
    one = np.array(single)
    to = np.array([[[edits[v][s][x][1] for x in range(4)] for s in range(SYMBOLS)] for v in range(len(vectors))], np.int8)
    for code, block in enumerate(product(range(SYMBOLS), repeat=BLOCK)):
        at, state = np.arange(len(vectors)), np.tile(np.arange(4), (len(vectors), 1))
        for i in reversed(range(BLOCK)):
            within[:, code, i] = at
            state = np.take_along_axis(state, to[at, block[i]].astype(np.int64), 1)
            growth[:, code] += one[at, block[i], 1]
            at = one[at, block[i], 0]
        before[:, code], ends[:, code] = at, state
    return Tables(vectors, single, before, growth, within, ends, edits)


def _codes(symbols: list[int]) -> tuple[list[int], list[int]]:
    """Codes of the blocks, the last ones whole; and the turns before the first block as a block of its own, filled up in front with nothing."""
    head = len(symbols) % BLOCK
    codes = []
    for i in range(head, len(symbols), BLOCK):
        code = 0
        for s in symbols[i:i + BLOCK]:
            code = code * SYMBOLS + s
        codes.append(code)
    return symbols[:head], codes


def price(symbols: list[int], after: int) -> tuple[int, int, list[int]]:
    """The vector before some turns, the growth of the least cost, and the vector after each turn, given the vector after the last."""
    t = tables()
    head, codes = _codes(symbols)
    at, growth, bounds = after, 0, []
    for code in reversed(codes):
        bounds.append(at)
        growth += int(t.growth[at, code])
        at = int(t.before[at, code])
    between: list[int] = []
    for code, bound in zip(codes, reversed(bounds)):
        between.extend(t.within[bound, code].tolist())
    for symbol in reversed(head):
        between.insert(0, at)
        at, more = t.one[at][symbol]
        growth += more
    return at, growth, between


def walk(symbols: list[int], between: list[int], state: int) -> tuple[list[str], int]:
    """The edits of each turn, inserts before it included, and the state after the last."""
    edits, taken = tables().edits, []
    for symbol, after in zip(symbols, between):
        text, state = edits[after][symbol][state]
        taken.append(text)
    return taken, state


def summary(symbols: list[int]) -> bytes:
    """What some turns do to every vector after them: the vector before, the growth, the state at the end by the state before."""
    t = tables()
    at, growth = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    state = np.tile(np.arange(4), (len(t.vectors), 1))
    head, codes = _codes(symbols)
    for code in reversed(codes):
        state = np.take_along_axis(state, t.ends[at, code].astype(np.int64), 1)
        growth += t.growth[at, code]
        at = t.before[at, code].astype(np.int64)
    for symbol in reversed(head):
        ends = np.array([[t.edits[v][symbol][x][1] for x in range(4)] for v in at])
        state = np.take_along_axis(state, ends, 1)
        priced = np.array([t.one[v][symbol] for v in at])
        growth += priced[:, 1]
        at = priced[:, 0]
    return np.column_stack([at, growth, state]).astype("<i8").tobytes()


def last_inserts(state: int) -> str:
    taken = ""
    while state in (SYSTEM, USER):
        taken, state = taken + "I", FIT[state]
    return taken


def rewrite(taken: list[str], state: int, roles: list[bytes], texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Roles and texts after the edits; ``taken`` may hold one more entry than there are turns, the inserts at the end."""
    new_roles, new_texts = [], []
    for i, edits in enumerate(taken):
        for edit in edits:
            if edit == "K":
                initial = INITIALS.find(roles[i][:1].decode("latin-1"))
                state = KEEP[initial][state]
                new_roles.append(roles[i])
                new_texts.append(texts[i])
            elif edit in "RI":
                state = FIT[state]
                new_roles.append(ROLES[state].encode())
                new_texts.append(texts[i] if edit == "R" else b"")
    return new_roles, new_texts


_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("last", pa.bool_()),
                    *[(c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost")],
                    ("first_initial", pa.int32()), ("last_initial", pa.int32()), ("audit", pa.string()), ("symbols", pa.binary()), ("does", pa.binary()),
                    ("roles", pa.list_(pa.binary())), ("texts", pa.list_(pa.binary()))])
PIECE = ("conv_id long, part int, seq int, whole boolean, last boolean, low long, high long, turns long, blank long, duplicate long, truncated long, "
         "illegal long, cost long, first_initial int, last_initial int, audit string, symbols binary, does binary, roles array<binary>, texts array<binary>")


class _Piece:
    """Turns of one conversation that stand one after the other."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.size = conv_id, 0
        self.roles, self.texts, self.symbols, self.initials = [], [], [], []
        self.faults = [0, 0, 0, 0]
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: bytes, text: bytes, fault: int) -> None:
        initial = INITIALS.find(role[:1].decode("latin-1")) if role else -1
        initial = initial if initial >= 0 else len(INITIALS)
        self.initials.append(initial)
        self.faults[fault] += 1
        self.symbols.append(0 if fault in (BLANK, DUPLICATE) else 1 + initial + 4 * (fault == TRUNCATED))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def row(self, part: int, seq: int, whole: bool) -> dict:
        illegal = sum(pair not in LEGAL for pair in zip(self.initials, self.initials[1:]))
        found = {"conv_id": self.conv_id, "part": part, "seq": seq, "whole": whole, "last": whole, "low": self.low, "high": self.high, "turns": self.turns,
                 "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": illegal,
                 "first_initial": self.initials[0] if self.initials else None, "last_initial": self.initials[-1] if self.initials else None}
        if not whole:
            return found | {"symbols": bytes(self.symbols), "does": summary(self.symbols), "roles": self.roles, "texts": self.texts}
        at, growth, between = price(self.symbols, 0)
        taken, state = walk(self.symbols, between, START)
        taken.append(last_inserts(state))
        roles, texts = rewrite(taken, START, self.roles, self.texts)
        return found | {"cost": growth + int(tables().vectors[at][START]), "audit": "".join(taken), "roles": roles, "texts": texts}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations of a task. One that lies within the task and is not too long is repaired at once."""
    part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
    piece, split = None, True  # what comes first may go on from the task before

    def close(whole: bool) -> None:
        nonlocal seq, held
        out.append(piece.row(part, seq, whole))
        seq += 1
        held += piece.size + 200

    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
            if piece is None:
                piece = _Piece(conv_id)
            elif piece.conv_id != conv_id:
                close(whole=not split)
                piece, split = _Piece(conv_id), False
            elif len(piece.roles) >= TURNS or piece.size > BYTES:
                close(whole=False)
                piece, split = _Piece(conv_id), True
            if fault is not None:
                piece.add(turn, role, text, fault)
            if held > BYTES:
                yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
                out, held = [], 0
    if piece is not None:
        close(whole=False)
    yield pa.RecordBatch.from_pylist(out, schema=_PIECE)


_TOTALS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
PLAN = "part int, seq int, after int, state int, " + ", ".join(f"{c} long" for c in _TOTALS) + ", cost long, last boolean"
_PLAN = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("after", pa.int32()), ("state", pa.int32()), *[(c, pa.int64()) for c in (*_TOTALS, "cost")],
                   ("last", pa.bool_())])


def _joined(pieces: list[dict]) -> list[dict]:
    """The vector after each piece of a conversation, the state before it, and the conversation's totals at the last one."""
    does = [np.frombuffer(p["does"], "<i8").reshape(-1, 6) for p in pieces]
    after, at, cost = [], 0, 0
    for d in reversed(does):
        after.append(at)
        cost += int(d[at, 1])
        at = int(d[at, 0])
    cost += int(tables().vectors[at][START])
    state, rows, total, initial = START, [], dict.fromkeys(_TOTALS, 0) | {"low": None, "high": None}, None
    for p, d, a in zip(pieces, does, reversed(after)):
        rows.append({"part": p["part"], "seq": p["seq"], "after": a, "state": state, "last": False})
        state = int(d[a, 2 + state])
        for c in ("blank", "duplicate", "truncated", "illegal"):
            total[c] += p[c]
        if p["low"] is not None:
            total["turns"] += p["turns"] - (p["low"] == total["high"])
            total |= {"low": p["low"] if total["low"] is None else total["low"], "high": p["high"]}
        if p["first_initial"] is not None:
            total["illegal"] += initial is not None and (initial, p["first_initial"]) not in LEGAL
            initial = p["last_initial"]
    rows[-1] |= total | {"cost": cost, "last": True}
    return rows


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_joined`` over the conversations of a task, whose pieces come in order."""
    held: list[dict] = []
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if held and held[0]["conv_id"] != p["conv_id"]:
                out += _joined(held)
                held = []
            held.append(p)
        yield pa.RecordBatch.from_pylist(out, schema=_PLAN)
    if held:
        yield pa.RecordBatch.from_pylist(_joined(held), schema=_PLAN)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the vector after and the state before them, repaired."""
    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            symbols = list(p["symbols"])
            _, _, between = price(symbols, p["after"])
            taken, state = walk(symbols, between, p["state"])
            if p["last"]:
                taken.append(last_inserts(state))
            roles, texts = rewrite(taken, p["state"], p["roles"], p["texts"])
            row = {k: p.get(k) for k in _PIECE.names} | {"audit": "".join(taken), "symbols": None, "does": None, "roles": roles, "texts": texts}
            yield pa.RecordBatch.from_pylist([row], schema=_PIECE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations in pieces, which come in order; the digest goes on from piece to piece."""
    audit, digest, lines = [], hashlib.sha256(), 0
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            audit.append(p["audit"])
            for role, text in zip(p["roles"], p["texts"]):
                digest.update(b"\n" * (lines > 0) + role + b":" + text)
                lines += 1
            if p["last"]:
                out.append({"part": p["part"], "seq": p["seq"], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})
                audit, digest, lines = [], hashlib.sha256(), 0
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def _blank_ends(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))


def faults(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, fault``: the first fault of each turn; null where ``there`` is false, which keeps the conversation's id only.

    The first of equal turns of a conversation is found by an aggregate that combines in each task, whatever the size of a conversation.
    """
    end = F.right(_blank_ends(F.col("text")), F.lit(1))
    rows = materialise(conversations.withColumn("blank", end == "").withColumn("cut", ~end.isin(".", "!", "?")), "turns")
    first = rows.where("there AND NOT blank").groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(
        F.min(F.struct("turn", "row")).alias("first")).select(F.col("first.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(~F.col("there"), None).when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NO_FAULT)
    return rows.join(first, "row", "left").select("conv_id", "turn", "role", "text", "row", fault.alias("fault"))


def repaired_pieces(conversations: DataFrame) -> DataFrame:
    """Pieces of repaired conversations, in order of ``part, seq``: ``roles`` and ``texts`` after the edits, ``audit``; totals of the conversation where ``last``.

    Takes the result of ``numbered`` turns: ``conv_id, turn, role, text, row`` and ``there``, false for turns that only name a conversation.
    Rows are dealt by ranges of conversation and turn, so a long conversation spreads over tasks.
    """
    ship(conversations.sparkSession)
    order = [F.col("conv_id"), F.col("turn"), F.col("role")]
    dealt = faults(conversations).repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text", "row")
    ready = dealt.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "fault")
    pieces = materialise(ready.mapInArrow(_pieces, PIECE), "pieces")
    in_order = pieces.where("NOT whole").select("conv_id", "part", "seq", *_TOTALS, "first_initial", "last_initial", "does") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    plan = in_order.mapInArrow(_plan, PLAN)
    rest = pieces.where("NOT whole").drop(*_TOTALS, "cost", "last").join(plan, ["part", "seq"]).mapInArrow(_repaired, PIECE)
    return pieces.where("whole").unionByName(rest).drop("symbols", "does", "first_initial", "last_initial")


def standing(conversations: DataFrame) -> DataFrame:
    """The columns that the repair reads, nulls in role and text as one blank, each row with a number."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return numbered(rows, "conv_id", "turn", "role", "text").withColumn("there", F.lit(True))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, seq, place, role, text``: the turns of every repaired conversation, in order of ``part, seq, place``."""
    zipped = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")
    return repaired_pieces(standing(conversations)).select("conv_id", "part", "seq", zipped).select(
        "conv_id", "part", "seq", "place", F.col("turn.roles").cast("string").alias("role"), F.col("turn.texts").cast("string").alias("text"))


def repair(conversations: DataFrame, numbered_rows: bool = False) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    Turns are taken by ``turn``, nulls first, then role and text. The first fault of a turn counts: blank, duplicate (an earlier turn of the conversation
    has its role and text), truncated (no ``.!?`` at the end). ``illegal`` counts adjacent turns whose roles do not follow each other, ``gaps`` the numbers
    missing between the least and the largest turn. ``audit`` holds the cheapest edits, least in ASCII among equals: keep 0, another role 3, delete 4
    (blank and duplicate turns must go), insert 3, and 3 more for a truncated turn that stays. The digest is of ``role:text`` lines after the edits.

    Null roles and texts count as one blank; turns with a null ``conv_id`` are one conversation; a null turn has no number. A role other than
    system, user and assistant by its initial cannot stay. Repeated rows are duplicates. Other columns are not read; an empty table gives an empty result.
    ``numbered_rows`` says that the rows are as ``standing`` makes them. A long conversation is cut into pieces that tasks price and repair
    apart; its digest runs over the pieces in order, since a digest of the whole text has no other way, holding one piece at a time.
    """
    pieces = materialise(repaired_pieces(conversations if numbered_rows else standing(conversations)), "repaired")
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"].cast("string"), F.lit(":"), x["texts"].cast("string")))
    whole = pieces.where("whole").withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256))
    parts = pieces.where("NOT whole").select("conv_id", "part", "seq", "last", "audit", "roles", "texts").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_digests, "part int, seq int, audit string, repaired_sha256 string")
    rest = pieces.where("NOT whole AND last").drop("audit").join(parts, ["part", "seq"])
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return whole.unionByName(rest).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

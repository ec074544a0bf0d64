"""Repair of conversations against a plain search over all edits."""

import hashlib
import random

import pytest

from duebook.llm import repair
from duebook.llm.queries import op12_conversation_repair

FIT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}


def fault_of(rows, i):
    role, text = rows[i]
    kept = text.strip(" \t\n\x0b\x0c\r")
    if not kept:
        return "blank"
    if (role, text) in rows[:i]:
        return "duplicate"
    return "" if kept[-1] in ".!?" else "truncated"


def brute(rows):
    """Cheapest edits of (role, text) rows with the least audit, by dynamic programming over (cost, audit, lines)."""
    faults = [fault_of(rows, i) for i in range(len(rows))]
    best = {"": (0, "", ())}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                to = FIT[state]
                new = cost + 3, audit + "I", lines + (NAME[to] + ":",)
                best[to] = min(best.get(to, new), new)
        return best
    for (role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in with_inserts(best).items():
            options = [(state, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    options.append((role[:1], more, "K", (f"{role}:{text}",)))
                options.append((FIT[state], 3 + more, "R", (f"{NAME[FIT[state]]}:{text}",)))
            for to, c, e, line in options:
                new = cost + c, audit + e, lines + line
                after[to] = min(after.get(to, new), new)
        best = after
    cost, audit, lines = min(v for k, v in with_inserts(best).items() if k in ("", "a"))
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:])]
    return {"blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}, lines


def brute_table(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv)
        turns = [t for there, t, _, _ in own if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = {"gaps": gaps} | brute([r[2:] for r in own])[0]
    return found


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def got(df):
    rows = repair.repair(df).collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows}


def made(n, longest, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "Assistant"]
    texts = ["Yes.", "No!", "so", None, "", " \t\n", "Why? \n", "é", "x" * 50 + ".", "a\x0b", "日本。", "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            own = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(99)}."
            rows.append((conv if conv else None, rng.choice([turn, turn, None, turn + 2]), own, text))
    return rows


def test_random_conversations(spark):
    rows = made(150, 14, 3)
    assert got(table_of(spark, rows).repartition(3)) == brute_table(rows)


@pytest.mark.parametrize("turns", [2, 5])
def test_pieces_join_exactly(spark, monkeypatch, turns):
    """One conversation with most rows, cut into short pieces."""
    monkeypatch.setattr(repair, "TURNS", turns)
    rng = random.Random(turns)
    rows = made(8, 12, 4) + [(77, i // 2 if i % 7 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{i}.", ""])) for i in range(300)]
    assert got(table_of(spark, rows)) == brute_table(rows)


def test_repaired_turns(spark):
    rows = made(40, 9, 8)
    by = {}
    for r in sorted(repair.repaired_turns(table_of(spark, rows)).collect(), key=lambda r: (r["part"], r["seq"], r["place"])):
        by.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv)
        assert tuple(by.get(conv, [])) == brute([r[2:] for r in own])[1]


def test_tables_price_every_block():
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.randrange(repair.SYMBOLS) for _ in range(rng.randrange(0, 23))]
        at, growth, between = repair.price(symbols, 0)
        vector, single = repair.tables().vectors[0], 0
        for i in reversed(range(len(symbols))):
            assert repair.tables().vectors[between[i]] == vector
            costs = repair._before(symbols[i], vector)
            single, vector = single + min(costs), tuple(c - min(costs) for c in costs)
        assert (growth, repair.tables().vectors[at]) == (single, vector)


def test_empty_repeated_and_more_columns(spark):
    empty = table_of(spark, [])
    assert repair.repair(empty).count() == 0
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 1, "assistant", "long " * 100_000 + ".")]
    named = table_of(spark, rows)
    for clash in ("row", "fault", "there", "audit", "part", "blank"):
        named = named.withColumn(clash, named.role)
    assert got(named) == brute_table(rows) and got(named)[1]["audit"] == "KDK"


def test_query_keeps_conversations_without_rows(spark, folder, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "a.") for c in range(300) for t in range(1)] + [(None, None, None, None)]
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    found = op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r["conv_id"] for r in found} == {r[0] for r in rows}
    gone = [r for r in found if r["audit"] == "" and r["cost"] == 0 and r["blank"] == 0]
    assert gone and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["gaps"] == 0 for r in gone)

"""Repair of conversations against a program over whole outputs, row by row."""

import hashlib
import random

import pytest

from panelwright.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def expected(rows):
    """The result columns for one conversation's rows ``(turn, role, text)`` in order."""

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 3, audit + "I", (*out, NAMES[to] + ":"))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    found = faults(rows)
    best = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for state, (cost, audit, out) in best.items():
            extra = 3 if fault == "truncated" else 0
            moves = [(state, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in FOLLOWS[state]:
                    moves.append((role[:1], cost + extra, audit + "K", (*out, f"{role}:{text}")))
                to = "a" if state == "u" else "u"
                moves.append((to, cost + 3 + extra, audit + "R", (*out, f"{NAMES[to]}:{text}")))
            for to, *new in moves:
                if to not in after or tuple(new[:2]) < after[to][:2]:
                    after[to] = tuple(new)
        best = insert(after)
    cost, audit, out = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), list(out)


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return {conv: in_order(rest) for conv, rest in out.items()}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in conversations:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " \n", f"Text {rng.randint(0, 9)}.", "Ünd?", "cut off", None])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


@pytest.fixture
def many_slices(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_matches_a_program_over_rows(spark, many_slices):
    # Conversation 3 has two thirds of the rows, so it lies in several slices; the null conversation is one of its own.
    rows = random_rows(1, [None, *range(3), 4, 5, 6], 9) + random_rows(2, [3], 400) + [(3, t % 50, "user", "again.") for t in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "role AS start", "text AS __slice", "1 AS h1")
    sliced = repair.ordered_rows(df)
    assert sliced.where("conv_id = 3").select("__slice").distinct().count() > 2
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(df).collect()}
    assert got == {conv: expected(of)[0] for conv, of in by_conversation(rows).items()}
    out = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: (r["piece"], r["place"])):
        out.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, of in by_conversation(rows).items():
        assert out.get(conv, []) == expected(of)[1]


def test_runs_advance_as_single_steps_do():
    rng = random.Random(3)
    for _ in range(60):
        symbols = [s for s in rng.choices(range(12), k=8) for _ in range(rng.randint(1, 40)) if s < 8 or not s & 4]
        flat = repair.IDENTITY
        for s in symbols:
            flat = repair.product(flat, repair.power(s, 0))
        assert repair.transition(symbols) == flat
        # Cutting anywhere and chaining the states gives the same audit.
        cut = rng.randint(0, len(symbols))
        after = repair.advance(repair.transition(symbols[cut:]), repair.END)
        head, state = repair.unroll(symbols[:cut], after, 0, False)
        assert head + repair.unroll(symbols[cut:], repair.END, state, True)[0] == repair.unroll(symbols, repair.END, 0, True)[0]


def test_no_rows_and_dropped_conversations(spark):
    assert repair.result(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA).selectExpr("*", "false AS present")
    nothing = (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert [tuple(r) for r in repair.report(rows).collect()] == [nothing]


def test_query_matches_sql(spark, duck, sf_dir):
    from panelwright.llm.catalog import ORACLE, QUERIES

    want = duck.sql(ORACLE["op11_repair"])
    got = QUERIES["op11_repair"](spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())

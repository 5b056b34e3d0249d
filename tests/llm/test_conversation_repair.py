"""Repairs against a plain search over all edits, on the query's table and on odd conversations."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarrylight.llm import conversation_repair, queries
from quarrylight.llm.common import table

DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of rows (turn, role, text), state by state over all edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    at = {"": (0, "", [])}
    better = lambda now, state, way: now.__setitem__(state, min(now.get(state, way), way, key=lambda w: w[:2]))

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, out) in list(now.items()):
                for role in ("user", "assistant"):
                    if role[0] in LEGAL[state]:
                        better(now, role[0], (cost + 2, audit + "I", [*out, f"{role}:"]))
        return now

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, out) in inserted(at).items():
            better(after, state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for new in ("user", "assistant"):
                    if new[0] in LEGAL[state]:
                        better(after, new[0], (cost + 2 + more, audit + "R", [*out, f"{new}:{text}"]))
                if role[:1] in LEGAL[state]:
                    better(after, role[0], (cost + more, audit + "K", [*out, f"{role}:{text}"]))
        at = after
    cost, audit, out = min((w for s, w in inserted(at).items() if s in ("", "a")), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), wrong, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def random_rows(rng, n):
    texts = ["Yes.", "No", "", "  \t", "What?", "a b", "Fine!\n", "Sé. \n"]
    return [(t, rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice(texts) if rng.random() < 0.5 else f"{t}{rng.choice('.!?x')}") for t in range(n)]


def sorted_as_spark(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def as_row(r):
    return tuple(r[c] for c in (*conversation_repair.COUNTS, "audit", "repaired_sha256"))


def test_search_and_blocks_agree(monkeypatch):
    rng = random.Random(5)
    for _ in range(400):
        rows = random_rows(rng, rng.randrange(9))
        roles, texts = [r[1] for r in rows], [r[2] for r in rows]
        faults, _ = conversation_repair.faults_of(roles, texts, set())
        initials = [r[:1] for r in roles]
        want = plain(rows)
        ((cost, audit),) = conversation_repair.cheapest(initials, faults, conversation_repair.START, True).values()
        assert (cost, audit) == want[5:7]
        cuts = [0, *sorted(rng.randrange(len(rows) + 1) for _ in range(3)), len(rows)]
        found = [conversation_repair.ways(initials[a:b], faults[a:b]) for a, b in zip(cuts, cuts[1:])]
        cost, path = conversation_repair.fold((c, r) for c, r, _ in found)
        audit = "".join(f[2][4 * s + t] for f, (s, t) in zip(found, path, strict=True)) + conversation_repair.TAIL[path[-1][1]]
        assert (cost, audit) == want[5:7]


def test_query_against_plain_search(spark):
    convs = {}
    for r in table(spark, DIR, "conversations").collect():
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        mine = convs.setdefault(r["conv_id"], [])
        text = "" if kind == 1 else "".join(c for c in r["text"] if c not in ".!?") if kind == 2 else r["text"]
        mine += [] if kind == 0 else [(r["turn"], "user" if kind == 4 else r["role"], text)] * (1 + (kind == 3))
    got = queries.op12_conversation_repair(spark, DIR)
    assert " ".join(got.columns) == "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"
    assert {r["conv_id"]: as_row(r) for r in got.collect()} == {c: plain(sorted_as_spark(rows)) for c, rows in convs.items()}


@pytest.mark.parametrize("block", [3, 512])
def test_hot_and_odd_conversations(spark, monkeypatch, block):
    """A conversation over all partitions, null ids, turns, roles and texts, repeated rows, rows that are gone, other columns."""
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rng = random.Random(7)
    convs = {1: random_rows(rng, 300), 2: [(0, "user", "Hi.")] * 50, 3: [], 4: [(None, "user", "A."), (None, "user", "B"), (3, "assistant", "C."), (9, "user", "x" * 100_000)], None: [(0, "assistant", "A."), (2, "system", " ")]}
    convs |= {10 + i: random_rows(rng, rng.randrange(1, 8)) for i in range(60)}
    rows = [(c, *r, False, 1) for c, mine in convs.items() for r in mine] + [(3, 0, "user", "gone.", True, 1), (1, 7, "user", "gone.", True, 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, absent boolean, part int").repartition(7)
    done = conversation_repair.repair(frame, F.col("absent"))
    got = {r["conv_id"]: as_row(r) for r in done.audits.collect()}
    want = {c: plain(sorted_as_spark(mine)) for c, mine in convs.items()}
    assert got == want
    turns = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r["part"], r["block"], r["position"])):
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in convs} == {c: w[-1] for c, w in want.items()}


def test_no_rows_and_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_repair.repair(spark.createDataFrame([], schema)).audits.count() == 0
    (row,) = conversation_repair.repair(spark.createDataFrame([(1, None, None, None)], schema)).audits.collect()
    assert as_row(row) == plain([(None, " ", " ")])

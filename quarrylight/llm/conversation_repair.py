"""Conversation structure repair: the cheapest edits that make turns legal, by A* on the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import settled

#: Legal role initials are ``(s?(ua)+)?``: by state, the initials that may follow and the states they lead to.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What an inserted or rerolled turn becomes in a state.
TURN = ("user", "user", "assistant", "user")
#: Edits that end a conversation lawfully from a state.
TAIL = ("", "II", "I", "")
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows and bytes of a conversation that one search covers; longer ones are searched block by block.
BLOCK, BLOCK_BYTES = 512, 4 << 20
SPACE, ENDS = " \t\n\v\f\r", ".!?"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@dataclass
class Repair:
    """``turns``: the repaired turns in order; ``audits``: one row per conversation."""

    turns: DataFrame
    audits: DataFrame


def cheapest(initials: list[str], faults: list[int], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """By A*, {end state: (cost, edits)}: the cheapest edits, ASCII-least among equals.

    Nodes are (rows consumed, state), and the queue is keyed (cost plus heuristic,
    edits so far). The heuristic sums the deletions that rows to come must have and
    one for each truncated row to come; no step lowers it by more than its cost, so
    the first time that a node comes up is its cheapest. ``whole``: only the lawful
    end is sought, with turns added after the last row; else each end state, and
    none is added there, as that belongs to the block behind.
    """
    n = len(initials)
    rest = [0] * (n + 1)
    for i in reversed(range(n)):
        rest[i] = rest[i + 1] + (DELETE if faults[i] in (BLANK, DUPLICATE) else CUT if faults[i] == TRUNCATED else 0)
    heap, done, ends = [(rest[0], "", 0, start)], set(), {}
    while heap:
        f, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and not (whole and TAIL[state]):
            ends[state] = (f, audit)
            if whole:
                break
            continue
        made = FOLLOWS[state][TURN[state][0]]
        heappush(heap, (f + INSERT, audit + "I", i, made))
        if i == n:
            continue
        g = f - rest[i] + rest[i + 1]
        heappush(heap, (g + DELETE, audit + "D", i + 1, state))
        if faults[i] in (FINE, TRUNCATED):
            g += CUT * (faults[i] == TRUNCATED)
            heappush(heap, (g + REROLE, audit + "R", i + 1, made))
            if initials[i] in FOLLOWS[state]:
                heappush(heap, (g, audit + "K", i + 1, FOLLOWS[state][initials[i]]))
    return ends


def ways(initials: list[str], faults: list[int]) -> tuple[list[int | None], list[int | None], list[str | None]]:
    """Costs, ranks and edits from each state to each: a rank orders the edits that begin in one state."""
    costs, ranks, audits = [None] * 16, [None] * 16, [None] * 16
    for s in range(4):
        found = cheapest(initials, faults, s, False)
        for rank, t in enumerate(sorted(found, key=lambda t: found[t][1])):
            costs[4 * s + t], ranks[4 * s + t], audits[4 * s + t] = found[t][0], rank, found[t][1]
    return costs, ranks, audits


def fold(blocks: Iterator[tuple[list[int | None], list[int | None]]]) -> tuple[int, list[tuple[int, int]]]:
    """The cheapest way through a conversation's blocks: its cost and each block's (state before, state after).

    Edits up to a block's end never end in an insertion, so none begins another,
    and the order of whole texts follows from the order of their first parts.
    """
    now, back = {START: (0, 0)}, []
    for costs, ranks in blocks:
        best = {}
        for t in range(4):
            reach = [(c + costs[4 * s + t], r, s) for s, (c, r) in now.items() if costs[4 * s + t] is not None]
            if reach:
                best[t] = min(reach)
        order = sorted(best, key=lambda t: (best[t][1], ranks[4 * best[t][2] + t]))
        now = {t: (best[t][0], order.index(t)) for t in best}
        back.append({t: s for t, (_, _, s) in best.items()})
    cost, _, at = min((c + INSERT * len(TAIL[t]), r, t) for t, (c, r) in now.items())
    path = []
    for step in reversed(back):
        path.append((step[at], at))
        at = step[at]
    return cost, path[::-1]


def edited(roles: list[str], texts: list[str], audit: str, state: int) -> list[dict]:
    """The turns that ``audit`` leaves of the rows, from ``state`` on."""
    out, i = [], 0
    for edit in audit:
        if edit in "IR":
            out.append({"role": TURN[state], "text": "" if edit == "I" else texts[i], "edit": edit})
        elif edit == "K":
            out.append({"role": roles[i], "text": texts[i], "edit": edit})
        if edit != "D":
            state = FOLLOWS[state][out[-1]["role"][0]]
        i += edit != "I"
    return out


def faults_of(roles: list[str], texts: list[str], seen: set[bytes]) -> tuple[list[int], list[bytes | None]]:
    """Each row's first fault, and the digest of rows that are the first of their kind among ``seen``."""
    faults, firsts = [], []
    for role, text in zip(roles, texts, strict=True):
        end = text.rstrip(SPACE)[-1:]
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        new = digest not in seen
        seen.add(digest)
        faults.append(BLANK if not end else DUPLICATE if not new else FINE if end in ENDS else TRUNCATED)
        firsts.append(digest if new else None)
    return faults, firsts


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def joined(turns: list[dict]) -> str:
    return "\n".join(f"{t['role']}:{t['text']}" for t in turns)


ROWS = "roles array<string>, texts array<string>, faults array<int>"
TURNS = "turns array<struct<role:string,text:string,edit:string>>"
TOTALS = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Neighbouring rows of one key, read as they come."""
    rows = (r for b in batches for at in range(0, b.num_rows, 1024) for r in b.slice(at, 1024).to_pylist())
    return ((k, group) for k, group in groupby(rows, key=lambda r: r[key]))


def emitted(rows: Iterator[dict], schema: pa.Schema, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; a row's ``__bytes`` says how much text it holds."""
    held, size = [], 0
    for row in rows:
        size += row.pop("__bytes", 64)
        held.append(row)
        if size >= most or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)
    return df.mapInArrow(lambda batches: emitted(work(batches), arrow), fields)


def _blocks_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A sorted partition's conversations: whole ones repaired, long ones and those at its edges as blocks of rows."""
    part, first, held = TaskContext.get().partitionId(), True, None
    for conv, rows in runs(batches, "conv"):
        if held is not None:
            yield _whole(*held)
        held, seen, number, block, size = None, set(), 0, [], 0
        for row in rows:
            if len(block) >= BLOCK or size >= BLOCK_BYTES:
                yield _block(conv, part, number, block, seen)
                number, block, size = number + 1, [], 0
            block.append(row)
            size += len(row["text"])
        if first or number:
            yield _block(conv, part, number, block, seen)
        else:
            held = (conv, block)
        first = False
    if held is not None:  # the next partition may go on with it
        yield _block(held[0], part, 0, held[1], set())


def _present(rows: list[dict]) -> tuple[list[str], list[str], list[int]]:
    rows = [r for r in rows if not r["absent"]]
    return [r["role"] for r in rows], [r["text"] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]


def _whole(conv: object, rows: list[dict]) -> dict:
    roles, texts, turns = _present(rows)
    faults, _ = faults_of(roles, texts, set())
    initials = [r[:1] for r in roles]
    ((cost, audit),) = cheapest(initials, faults, START, True).values()
    after = edited(roles, texts, audit, START)
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal(initials), cost]
    out = dict(zip(COUNTS, counts, strict=True)) | {"audit": audit, "repaired_sha256": hashlib.sha256(joined(after).encode()).hexdigest()}
    return out | {"conv": conv, "turns": after, "__bytes": sum(map(len, texts)) + 64}


def _block(conv: object, part: int, number: int, rows: list[dict], seen: set[bytes]) -> dict:
    roles, texts, turns = _present(rows)
    faults, firsts = faults_of(roles, texts, seen)
    ends = {"low": turns[0], "high": turns[-1], "distinct": len(set(turns))} if turns else {"distinct": 0}
    return ends | {"conv": conv, "part": part, "block": number, "roles": roles, "texts": texts, "faults": faults, "firsts": firsts, "__bytes": 2 * sum(map(len, texts)) + 64}


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks with their repeats of earlier partitions known: the ways through them."""
    for _, rows in runs(batches, "conv"):
        for row in rows:
            for i in row.pop("repeats") or ():
                if row["faults"][i] != BLANK:
                    row["faults"][i] = DUPLICATE
            initials = [r[:1] for r in row["roles"]]
            costs, ranks, audits = ways(initials, row["faults"])
            yield row | {"costs": costs, "ranks": ranks, "audits": audits, "head": initials[0] if initials else None, "foot": initials[-1] if initials else None, "illegal": illegal(initials), "__bytes": sum(map(len, row["texts"])) + 16 * len(initials)}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Each block's states before and after; the last block of a conversation carries its counts."""
    for conv, rows in runs(batches, "conv"):
        keys, total, foot, high, low = [], dict.fromkeys(COUNTS, 0), None, None, None

        def read(rows=rows, keys=keys, total=total):
            nonlocal foot, high, low
            for r in rows:
                keys.append((r["part"], r["block"]))
                for name in ("blank", "duplicate", "truncated", "illegal"):
                    total[name] += r[name]
                if r["head"] is not None:
                    total["illegal"] += foot is not None and foot + r["head"] not in ("su", "ua", "au")
                    foot = r["foot"]
                if r["distinct"]:
                    total["gaps"] -= r["distinct"] - (r["low"] == high)
                    low, high = r["low"] if low is None else low, r["high"]
                yield r["costs"], r["ranks"]

        total["cost"], path = fold(read())
        total["gaps"] += high - low + 1 if low is not None else 0
        for (part, block), (before, after) in zip(keys, path, strict=True):
            yield {"conv_": conv, "part_": part, "block_": block, "before": before, "after": after, "last": (part, block) == keys[-1]} | {f"all_{c}": v for c, v in total.items()}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for conv, rows in runs(batches, "conv"):
        for r in rows:
            audit = r["audits"][4 * r["before"] + r["after"]] + (TAIL[r["after"]] if r["last"] else "")
            turns = edited(r["roles"], r["texts"], audit, r["before"])
            kept = {c: r[f"all_{c}"] for c in COUNTS}
            yield kept | {"conv": conv, "part": r["part"], "block": r["block"], "audit": audit, "turns": turns, "piece": joined(turns), "__bytes": 2 * sum(len(t["text"]) for t in turns) + 64}


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A conversation's pieces in order, hashed as they come."""
    for conv, rows in runs(batches, "conv"):
        digest, audit, any_text = hashlib.sha256(), [], False
        for r in rows:
            audit.append(r["audit"])
            if r["piece"]:
                digest.update((("\n" if any_text else "") + r["piece"]).encode())
                any_text = True
        yield {c: r[c] for c in COUNTS} | {"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "__bytes": sum(map(len, audit)) + 64}


def repair(conversations: DataFrame, absent: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest edits that give each conversation the role initials ``(s?(ua)+)?``.

    Rows count by turn (nulls first), then role, then text (its first 64 letters, then its hash). A row's first fault
    counts: blank, duplicate (role and text seen earlier), truncated (its last letter
    ends no sentence). Keep costs 0, Rerole 2, Delete 3 (blank and duplicate rows
    must go), Insert 2; each truncated row that stays adds 1. Equal costs go to the
    ASCII-least edits.

    One exchange sorts all rows by conversation and turn, so a hot conversation, and rows that
    repeat, are spread over partitions. Conversations inside a partition are repaired there;
    those at its edges or of over ``BLOCK`` rows are searched in blocks from every
    state to every state, and only costs, orders and digests of rows meet, which is exact.
    What stays in sequence for one conversation is a fold over its block summaries
    and the hash of its repaired text, both read as a stream.

    ``absent`` marks rows that only name their conversation: one without other
    rows gets zeros, no edits and the hash of nothing. Null roles and texts count as
    one space, null conversations as one. Empty texts are blank; very long ones are
    compared by 128-bit digests. An empty table gives no row. Other columns are not looked at.
    """
    gone = F.coalesce(absent, F.lit(False)) if absent is not None else F.lit(False)
    kind = conversations.schema[conv].dataType.simpleString()
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), gone.alias("absent"),
        F.when(gone, "").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"), F.when(gone, "").otherwise(F.coalesce(F.col(text), F.lit(" "))).alias("text"),
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "mark", "salt"]
    # Sampled sort keys come to the driver, so they hold the beginning of a text and its hash.
    placed = rows.withColumns({"head": F.left("text", F.lit(64)), "mark": F.xxhash64("text"), "salt": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    made = f"conv {kind}, part int, block int, {ROWS}, firsts array<binary>, low long, high long, distinct long, {TURNS}, {TOTALS}"
    work = settled(_mapped(placed.drop("head", "mark", "salt"), _blocks_of_partition, made), "conversations")

    cut, key = work.filter("part IS NOT NULL"), ["conv", "part", "block"]
    named = cut.select(*key, F.posexplode("firsts").alias("i", "digest")).filter("digest IS NOT NULL")
    first = named.groupBy(F.col("conv").alias("conv_"), F.col("digest").alias("digest_")).agg(F.min("part").alias("part_"))
    again = named.join(first, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("digest") == F.col("digest_")) & (F.col("part") > F.col("part_")))
    again = again.groupBy(*[F.col(k).alias(f"{k}_") for k in key]).agg(F.collect_list("i").alias("repeats"))
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")) & (F.col("block") == F.col("block_"))
    blocks = cut.select(*key, "roles", "texts", "faults", "low", "high", "distinct").join(again, same, "left").drop("conv_", "part_", "block_")
    found = f"conv {kind}, part int, block int, {ROWS}, low long, high long, distinct long, costs array<long>, ranks array<int>, audits array<string>, head string, foot string, illegal long"
    blocks = settled(_mapped(blocks, _searched, found), "blocks")

    counted = [(F.size("faults") - F.size(F.array_remove("faults", code))).cast("long").alias(name) for name, code in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))]
    small = blocks.select(*key, "costs", "ranks", "head", "foot", "illegal", "low", "high", "distinct", *counted)
    states = f"conv_ {kind}, part_ int, block_ int, before int, after int, last boolean, " + ", ".join(f"all_{c} long" for c in COUNTS)
    chosen = _mapped(small.repartition("conv").sortWithinPartitions(*key), _folded, states)
    pieces = blocks.select(*key, "roles", "texts", "audits").join(chosen, same).drop("conv_", "part_", "block_")
    pieces = settled(_mapped(pieces, _repaired, f"conv {kind}, part int, block int, {TURNS}, piece string, {', '.join(f'{c} long' for c in COUNTS)}, audit string"), "pieces")
    closed = _mapped(pieces.select(*key, "piece", "audit", *COUNTS).repartition("conv").sortWithinPartitions(*key), _closed, f"conv {kind}, {TOTALS}")

    totals = [F.col("conv").alias(conv), *COUNTS, "audit", "repaired_sha256"]
    audits = work.filter("part IS NULL").select(*totals).unionByName(closed.select(*totals))
    at = [F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("block", F.lit(0)).alias("block")]
    both = work.filter("part IS NULL").select("conv", *at, "turns").unionByName(pieces.select("conv", *at, "turns"))
    turns = both.select("conv", "part", "block", F.posexplode("turns").alias("position", "t"))
    return Repair(turns.select(F.col("conv").alias(conv), "part", "block", "position", "t.role", "t.text", "t.edit"), audits)

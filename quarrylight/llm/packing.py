"""Best-fit packing of token sequences: minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import blockwise_rank, settled

#: Strings of special tokens and their ids.
Special = tuple[tuple[str, int], ...]

END = 2
WIDTH = 4
#: Words whose ids a worker remembers; the memory starts anew beyond that.
REMEMBERED = 400_000
#: Hash blocks per length when pieces are ranked.
BLOCKS = 64
#: Units end before a lone space or newline between two other characters: no token crosses those places.
UNEVEN = re.compile(r"\s\s|\A\s|\s\Z")
LONE = re.compile(r"(?<=\S) (?=\S)")


class _Words(dict):
    """Token ids of a unit as little-endian 32-bit numbers, encoded when first met."""

    def __init__(self, encoding: tiktoken.Encoding, before: str):
        self.encoding, self.before = encoding, before

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.encoding.encode_ordinary(self.before + unit)
        self[unit] = made = b"".join(i.to_bytes(WIDTH, "little") for i in ids)
        return made


class Tokens:
    """Byte-level BPE ids of whole texts, the same as encoding each text in one go.

    ``ranks_path``: the vocabulary in the ranks format; ``pattern``: its rule for
    splitting text; ``special``: strings that are one given id wherever they stand,
    the text between them being encoded apart. A text is cut only before a lone space or around a lone newline
    that stands between two non-space characters. No piece of the rule reaches over
    such a place, so the ids of the units, looked up or encoded once, add up to the
    ids of the text.
    """

    def __init__(self, ranks_path: str, pattern: str, special: Special = ()):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("quarrylight", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = _Words(self.encoding, ""), _Words(self.encoding, " ")
        self.newline = self.first["\n"]
        self.special = {name: number.to_bytes(WIDTH, "little") for name, number in special}
        # Of strings that start at one place the longest counts.
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if special else None

    def ids(self, text: str) -> bytes:
        """The ids of the whole text, as little-endian 32-bit numbers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if UNEVEN.search(text):
            units = LONE.split(text)
            return self._line(units)
        return self.newline.join([self._line(line.split(" ")) for line in text.split("\n")])

    def _line(self, units: list[str]) -> bytes:
        return b"".join([self.first[units[0]], *map(self.later.__getitem__, units[1:])])


@lru_cache(maxsize=2)
def _tokens(ranks_path: str, pattern: str, special: Special) -> Tokens:
    return Tokens(ranks_path, pattern, special)


def special_tokens(json_path: str) -> Special:
    """The strings and ids of the special tokens that a tokenizer's JSON file adds to its vocabulary."""
    with open(json_path, encoding="utf-8") as file:
        return tuple(sorted((t["content"], t["id"]) for t in json.load(file)["added_tokens"]))


def pieces(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = 1024, end: int | None = END, special: Special = ()) -> DataFrame:
    """key, piece, start, length, ids_crc32: each document's tokens, cut only if there are more than ``limit``.

    All pieces but the first are full. Null texts count as empty and are the end
    token alone; with ``end`` None they give no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last = _tokens(ranks_path, pattern, special), b"" if end is None else end.to_bytes(WIDTH, "little")
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                ids = memoryview(tokens.ids(body.as_py() or "") + last)
                n = len(ids) // WIDTH
                first = (n - 1) % limit + 1 if n else 0
                at, k = 0, 0
                while at < n:
                    to = at + (limit if k else first)
                    for column, x in zip(rows, (doc, k, at, to - at, zlib.crc32(ids[WIDTH * at : WIDTH * to])), strict=True):
                        column.append(x)
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in rows[0]], batch.schema.types[0]), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:]]],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType([docs.schema[key], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int, memo: int | None = None) -> list[int]:
    """Lengths, largest first, of the fullest combination of available items that fits ``room``.

    Subset-sum over a bitset: bit s of ``reach`` says that some choice sums to s.
    Lengths enter from large to small and the reach after each is kept to walk back.
    Counts enter in binary parts, so a length with many items costs few steps.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left:
            take = min(part, left)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= take * length
    return sorted(chosen, reverse=True)


def minimum_bin_slack(histogram: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins) until every item of the histogram is in a bin.

    Each bin starts with the longest item left; the fullest combination of the
    others fills its slack and is removed. The same combination is removed as often
    as the counts last, so the work follows the number of different lengths, at
    most ``limit``, and not the number of items.
    """
    counts = {k: v for k, v in histogram.items() if v}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        chosen = [longest, *fullest(counts, limit - longest)]
        counts[longest] += 1
        used = {x: chosen.count(x) for x in chosen}
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        plan.append((chosen, times))
    return plan


def packed(cut: DataFrame, limit: int = 1024, key: str = "doc_id") -> DataFrame:
    """``cut`` (from ``pieces``) with sequence_id and offset.

    Only the histogram of lengths, ``limit`` numbers at most, comes to the driver,
    where the bins are planned as patterns with multiplicities. The pieces of a length are
    ranked in hash blocks, so that one length may hold any share of all rows, and
    a rank gives bin and offset by arithmetic from the pattern that covers it.
    Ties are broken by key, piece and checksum; pieces of repeated rows are
    interchangeable.
    """
    spark = cut.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}
    plan = minimum_bin_slack(histogram, limit)
    used, rows, bins = dict.fromkeys(histogram, 0), [], 0
    for chosen, times in plan:
        offset = 0
        for length in dict.fromkeys(chosen):
            n = chosen.count(length)
            rows.append((length, used[length], used[length] + n * times, n, bins, offset))
            used[length] += n * times
            offset += n * length
        bins += times
    # At most one row per pattern and length in it; patterns are about as many as lengths.
    ruled = spark.createDataFrame(rows, "len long, lo long, hi long, n long, bin long, base long")
    rules = ruled.groupBy("len").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "n", "bin", "base"))).alias("rules"))
    block = F.pmod(F.xxhash64(F.col(key), "piece", "ids_crc32"), F.lit(BLOCKS))
    ranked = blockwise_rank(cut, ["length"], [key, "piece", "ids_crc32"], block, "__at")
    mine = ranked.join(F.broadcast(rules), F.col("length") == F.col("len"))
    rule = F.element_at(F.filter("rules", lambda x: (x["lo"] <= F.col("__at")) & (F.col("__at") < x["hi"])), 1)
    mine = mine.withColumn("__rule", rule)
    into = F.col("__at") - F.col("__rule.lo")
    return mine.select(
        *cut.columns,
        (F.col("__rule.bin") + F.floor(into / F.col("__rule.n"))).cast("long").alias("sequence_id"),
        (F.col("__rule.base") + F.col("length") * (into % F.col("__rule.n"))).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = 1024, end: int | None = END, special: Special = ()) -> DataFrame:
    """Packs every document into sequences of at most ``limit`` tokens; one row per piece.

    Strings of ``special`` become their one id, as the tokenizer that adds them to
    its vocabulary does; by default they are ordinary text. Null and empty texts
    are the end token alone. Repeated rows are packed each. A very long text is held
    whole in one task, with its ids. An empty table gives no row. Other columns are
    not looked at.
    """
    return packed(settled(pieces(docs, ranks_path, pattern, key, text, limit, end, special), "pieces"), limit, key)

"""Best-fit packing of token sequences by linear grouping.

1. The pieces' lengths are counted: a histogram of at most ``capacity`` numbers, whatever the corpus.
2. The plan is made on the histogram. Large lengths are sorted and cut into groups of equal
   cardinality, each rounded up to its longest; the few sizes that are left are packed by a linear
   programme over configurations (column generation, the knapsack by dynamic programming); the actual
   lengths then take the rounded ones' places, and the small lengths go best-fit into the room.
   Equal sequences are one row of the plan with a multiplicity, so its size depends on ``capacity`` and
   ``groups`` alone.
3. Pieces are numbered within their length, in salts, and find their place in the plan by that number.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from dataclasses import dataclass
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, bounded_batches, stored, tidy
from .token_counts import byte_letters

CACHE = 100_000  # words that one Python worker remembers, in each of two generations


# -- token ids -----------------------------------------------------------------------------------------


class WordIds(Remembered):
    """Word -> packed ids of a word-level BPE vocabulary, each word encoded once by the library.

    The library's normaliser (NFC, white space, lower case) and pre-tokenizer cut a text into words that
    are encoded independently. Up to U+017F, but for the dotted capital I, without control characters,
    these steps are plain string operations (no combining marks, lower case in the same range); any other
    text goes to the library whole, as does one with a special token's string in it.
    """

    LAST = 0x17F

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(CACHE)
        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        self.library.no_truncation()
        self.library.no_padding()
        chars = [chr(c) for c in range(0x21, self.LAST + 1)]
        of = {k: re.escape("".join(c for c in chars if unicodedata.category(c)[0] == k)) for k in "LN"}
        spaces = r"\t-\r \x85\xa0"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[^{spaces}{of['L']}{of['N']}]+").findall
        self.plain = re.compile(f"[\t-\r -~\x85\xa0-\u012f\u0131-{chr(self.LAST)}]*").fullmatch
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def make(self, word: str) -> bytes:
        """A word as the pre-tokenizer hands it to the library's model: the letters of its bytes."""
        spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(spelt)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def packed(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        self.turn()
        if not self.plain(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.words(text.lower())))


_workers: dict[str, WordIds] = {}


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's ids, then ``end_id``, cut only where longer than ``capacity``.

    One row a piece: ``id, piece, start, length, ids_crc32, n_pieces``. Null text counts as empty: one
    piece with ``end_id``.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        words = _workers.get(tokenizer)
        if words is None:
            words = _workers[tokenizer] = WordIds(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for k, text in enumerate(b.column(1).to_pylist()):
                data = words.packed(text or "") + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((k, i, at // 4, len(part) // 4, zlib.crc32(part)))
            at, piece, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, piece int, start long, length long, ids_crc32 long")


# -- the plan --------------------------------------------------------------------------------------------


@dataclass
class Bins:
    """``count`` equal sequences: ``items`` lists (length, how many, offset of the first)."""

    count: int
    free: int
    items: tuple[tuple[int, int, int], ...] = ()

    def with_items(self, length: int, n: int, count: int, capacity: int) -> Bins:
        return Bins(count, self.free - n * length, (*self.items, (length, n, capacity - self.free)))


def group_lengths(hist: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: lengths, longest first, in up to ``groups`` groups of equal cardinality.

    Each is a list of (length, count), longest first; its first length is the size it is rounded up to.
    """
    total = sum(hist.values())
    share, out, room = max(1, -(-total // groups)), [], 0
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n -= take
            room -= take
    return out


def _knapsack(sizes: np.ndarray, gains: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most gain (unbounded knapsack) and its gain."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    order = [i for i in np.argsort(sizes) if gains[i] > 1e-12]
    least = int(min((sizes[i] for i in order), default=capacity + 1))
    s, g = sizes[order], gains[order]
    for c in range(least, capacity + 1):
        k = np.searchsorted(s, c, side="right")
        got = best[c - s[:k]] + g[:k]
        i = int(np.argmax(got))
        if got[i] > best[c - 1] + 1e-15:
            best[c], pick[c] = got[i], order[i]
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0 or best[c] <= best[c - 1] + 1e-15:
            c -= 1
            continue
        counts[pick[c]] += 1
        c -= sizes[pick[c]]
    return float(best[capacity]), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Patterns over ``sizes`` with how often each is used, together covering ``demand`` but for a rest
    smaller than the number of sizes times a pattern: the rounded-down optimum of the cutting-stock LP.
    """
    s, d = np.array(sizes, dtype=np.int64), np.array(demand, dtype=float)
    m = len(s)
    basis = np.diag(np.array([capacity // x for x in s], dtype=float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, duals = inverse @ d, inverse.sum(axis=0)
        gain, column = _knapsack(s, duals, capacity)
        if gain <= 1 + 1e-9:
            break
        step = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        if np.linalg.cond(basis) > 1e12:
            break
    x = np.linalg.solve(basis, d)
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-9))) for j in range(m) if x[j] >= 1]


def plan_bins(
    hist: dict[int, int], capacity: int, groups: int = 32, smalls: tuple[float, ...] = (1 / 4, 1 / 3, 2 / 5, 1 / 2)
) -> list[Bins]:
    """The plan of fewest sequences over the thresholds of what counts as small, ``smalls``.

    Where small pieces are plenty, a high threshold leaves them more room to fill; where they are few, the
    configurations must do the work.
    """
    return min((_plan(hist, capacity, groups, s) for s in smalls), key=lambda bins: sum(b.count for b in bins))


def _plan(hist: dict[int, int], capacity: int, groups: int, small: float) -> list[Bins]:
    """Sequences for all lengths of ``hist`` (length -> count, 1 to ``capacity``), as bins with counts.

    Lengths over ``small * capacity`` are large. The number of rows depends on ``capacity`` and
    ``groups``, not on the counts.
    """
    left = {length: n for length, n in hist.items() if n}
    done = [Bins(left[capacity], 0, ((capacity, 1, 0),))] if capacity in left else []
    left.pop(capacity, None)
    large = {length: n for length, n in left.items() if length > small * capacity}
    bins: list[Bins] = []
    if large:
        parts = group_lengths(large, groups)
        # equal sizes may fill several groups: one size of the programme
        merged: list[list[tuple[int, int]]] = []
        for part in parts:
            if merged and merged[-1][0][0] == part[0][0]:
                merged[-1] += part
            else:
                merged.append(part)
        sizes, demand = [p[0][0] for p in merged], [sum(n for _, n in p) for p in merged]
        queues = [list(reversed(p)) for p in merged]  # the longest is taken first
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [g for g, n in enumerate(pattern) for _ in range(n)]
            while times:
                run, taken = times, []
                need: dict[int, int] = {}
                for g in slots:
                    need[g] = need.get(g, 0) + 1
                if any(sum(c for _, c in queues[g]) < n for g, n in need.items()):
                    break  # what the programme uses beyond the demand
                for g, n in need.items():
                    length, c = queues[g][-1]
                    if c >= n:
                        run = min(run, c // n)
                    else:
                        run = 1
                bin_ = Bins(run, capacity)
                for g, n in need.items():
                    while n:
                        length, c = queues[g][-1]
                        k = min(n, c // run)
                        bin_ = bin_.with_items(length, k, run, capacity)
                        n -= k
                        c -= k * run
                        queues[g].pop()
                        if c:
                            queues[g].append((length, c))
                taken.append(bin_)
                bins += taken
                times -= run
        rest: dict[int, int] = {}
        for q in queues:
            for length, n in q:
                rest[length] = rest.get(length, 0) + n
    else:
        rest = {}
    for length, n in left.items():
        if length not in large:
            rest[length] = rest.get(length, 0) + n
    return done + best_fit(bins, rest, capacity)


def best_fit(bins: list[Bins], lengths: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing of ``lengths`` (length -> count) into ``bins``, opening new ones, by classes of
    equal bins: the tightest class that has room takes as many a bin as fit, since a bin that has just
    taken one is the tightest of all.
    """
    by_free: dict[int, list[Bins]] = {}
    frees: list[int] = []

    def add(b: Bins) -> None:
        if b.free not in by_free:
            by_free[b.free] = []
            bisect.insort(frees, b.free)
        by_free[b.free].append(b)

    for b in bins:
        add(b)
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        while n:
            i = bisect.bisect_left(frees, length)
            if i == len(frees):
                per = capacity // length
                count = max(1, n // per)
                add(Bins(count, capacity))
                continue
            b = by_free[frees[i]].pop()
            if not by_free[frees[i]]:
                del by_free[frees[i]]
                del frees[i]
            k = min(b.free // length, n)
            count = min(b.count, n // k)
            if count < b.count:
                add(Bins(b.count - count, b.free, b.items))
            add(b.with_items(length, k, count, capacity))
            n -= k * count
    return [b for bs in by_free.values() for b in bs]


def plan_rows(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, from, to, sequence, per, offset)``: pieces ``from <= number < to`` of a length lie ``per``
    a sequence, from ``sequence`` on, the first of each at ``offset``."""
    rows, sequence, numbered = [], 0, {}
    for b in bins:
        for length, n, offset in b.items:
            first = numbered.get(length, 0)
            rows.append((length, first, first + n * b.count, sequence, n, offset))
            numbered[length] = first + n * b.count
        sequence += b.count
    return rows


# -- placing -----------------------------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = 2048, groups: int = 32, salts: int = 256) -> DataFrame:
    """``pieces`` with a ``length`` column (1 to ``capacity``) and an ``id`` and ``piece`` that order them,
    each with ``sequence_id`` and ``offset``; gapless from 0 in each sequence.

    Pieces are numbered within (length, salt) and each salt starts where those before it end, so the
    commonest length is spread over ``salts`` tasks. The histogram and the plan are bounded by
    ``capacity``, ``salts`` and ``groups``; nothing of a document reaches the driver.
    """
    spark = pieces.sparkSession
    rows = stored(pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts))), "pieces")
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = stored(counts.coalesce(8), "piece-counts")  # at most capacity * salts rows
    hist = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = plan_rows(plan_bins(hist, capacity, groups))
    schema = "length long, first long, last long, sequence long, per long, offset long"
    plan_df = spark.createDataFrame(plan, schema)
    starts = counts.selectExpr(
        "length", "salt",
        "coalesce(sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding), 0) as base",
    )
    numbered = rows.selectExpr(
        "*", "row_number() over (partition by length, salt order by id, piece, start, ids_crc32) - 1 as nth"
    ).join(starts, ["length", "salt"])
    numbered = numbered.withColumn("number", F.col("nth") + F.col("base"))
    # the plan's rows are bounded by capacity and groups, so it may go to every task
    p = F.broadcast(plan_df)
    placed = numbered.join(
        p, (numbered["length"] == p["length"]) & (numbered["number"] >= p["first"]) & (numbered["number"] < p["last"])
    ).drop(p["length"])
    slot = F.col("number") - F.col("first")
    return placed.withColumn("sequence_id", (F.col("sequence") + F.floor(slot / F.col("per"))).cast("long")).withColumn(
        "offset", F.col("offset") + slot % F.col("per") * F.col("length")
    ).drop("salt", "nth", "base", "number", "first", "last", "sequence", "per")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a piece: ``<id_col>, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text counts as empty. Rows with null or repeated ids are packed like any other. Other columns
    are neither read nor returned. Empty input, empty result.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
    return pack(pieces, capacity).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

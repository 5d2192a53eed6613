"""Token counts of byte-level BPE by the whole-token shortcut.

Most pre-tokens of ordinary text are themselves a vocabulary string. Which strings really encode alone
as one token is proved once, offline, by merging each: a document's pre-tokens in that set are counted
without any merging, and only the rest are merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, bounded_batches, tidy

# Fixed values of byte-level BPE: the pre-token pattern, and the bytes that stand for themselves.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CACHE = 600_000  # merged pre-tokens that one Python worker remembers, in each of two generations


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file."""
    spare = iter(range(0x100, 0x200))
    own = set(PRINTABLE)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merges of a byte-level BPE vocabulary; pairs of symbols by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(a, b): r for r, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]

    def spell(self, piece: str) -> list[str]:
        return [self.letters[b] for b in piece.encode()]

    def merge(self, parts: list[str]) -> list[str]:
        """Merge the pair of lowest rank, leftmost first, until no pair is left."""
        if len(parts) > 32:
            return self._merge_long(parts)
        get, none = self.ranks.get, len(self.ranks)
        found = [get(pair, none) for pair in zip(parts, parts[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same with a queue and links, for pre-tokens of any length in O(n log n)."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := ranks.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i] if parts[i] else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, (parts[a], parts[b])))
        return [p for p in parts if p]

    def single_tokens(self) -> list[str]:
        """The proof: the vocabulary strings, as text, that encode alone as one token.

        Strings that aren't whole UTF-8, or that pre-tokenization would cut, can't be a pre-token.
        """
        byte_of = {c: b for b, c in enumerate(self.letters)}
        pattern, out = regex.compile(PRETOKEN), []
        for token in self.vocab:
            try:
                text = bytes(byte_of[c] for c in token).decode()
            except (UnicodeDecodeError, KeyError):
                continue
            if pattern.fullmatch(text) and len(pattern.findall(text)) == 1 and self.merge(self.spell(text)) == [token]:
                out.append(text)
        return out


class Counter(Remembered):
    """Pre-token -> its number of tokens; what isn't there yet is merged and remembered."""

    def __init__(self, table: MergeTable, whole: Iterable[str]):
        super().__init__(CACHE)
        self.table = table
        self.proved = dict.fromkeys(whole, 1)
        self.update(self.proved)
        self.pattern = regex.compile(PRETOKEN)
        marks = "|".join(regex.escape(s) for s in sorted(table.special, key=len, reverse=True))
        self.special = regex.compile(marks) if marks else None
        self.marks = table.special

    def make(self, piece: str) -> int:
        return len(self.table.merge(self.table.spell(piece)))

    def turn(self) -> None:
        super().turn()
        if not self:
            self.update(self.proved)

    def count(self, text: str) -> int:
        """Tokens of ``text``; a special string inside it is one token, as the library has it."""
        self.turn()
        parts, n = [text], 0
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            n = len(parts) - 1
        get, find = self.__getitem__, self.pattern.findall
        return n + sum(sum(map(get, find(p))) for p in parts)


_workers: dict[str, Counter] = {}


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: ``<id_col>, n_bytes, n_tokens, over_limit``.

    ``tokenizer`` is the path of a byte-level BPE vocabulary (.json), present on every machine. Null text
    counts as empty: no bytes, no tokens. Null ids and repeated rows pass through. Other columns are
    neither read nor returned.
    """
    spark = docs.sparkSession
    # bounded by the vocabulary, whatever the corpus
    whole = spark.sparkContext.broadcast(MergeTable(tokenizer).single_tokens())

    def run(batches):
        counter = _workers.get(tokenizer)
        if counter is None:
            counter = _workers[tokenizer] = Counter(MergeTable(tokenizer), whole.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            counts = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)

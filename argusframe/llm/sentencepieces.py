"""SentencePiece BPE encoding and decoding that keeps every piece's byte span in the original text."""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Remembered, bounded_batches, tidy

SPACE = "▁"  # fixed: the symbol that stands for a space
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed: piece types of the model file
CACHE = 500_000  # segments that one Python worker remembers, in each of two generations


class CharacterMap:
    """The compiled character map of a model: a double-array trie of replaced prefixes.

    Layout (published in the library's format): a 4-byte size of the trie, its 4-byte units, then the
    replacements, each ended by a zero byte. A leaf's value is its replacement's place.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``data[at:]`` and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != c:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                place = units[node] & ((1 << 31) - 1)
                found = (i + 1 - at, self.texts[place : self.texts.index(b"\0", place)])
        return found


@dataclass
class Encoding:
    """``ids`` and, for each, the bytes ``begin..end`` of the original text that it stands for."""

    ids: list[int] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


class SpanEncoder(Remembered):
    """Encoder and decoder of one model file; as a dict, normalised segment -> (packed ids, what they spell, packed
    numbers of the normalised bytes that each stands for, and of the original bytes where no character is mapped)."""

    def __init__(self, path: str):
        super().__init__(CACHE)
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        norm = model.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with spaces as suffixes are not supported")
        self.pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        if any(t in (USER_DEFINED, UNUSED) for _, _, t in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.score = {p: (s, i) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL}
        self.id_of = {p: i for p, (_, i) in self.score.items()}
        self.rank = {p: -s for p, (s, _) in self.score.items()}
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bos, self.eos = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        self.unk_surface = model.trainer_spec.unk_surface.encode()
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.of_byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.spelt = [
            self.of_byte[i] if t == BYTE else self.unk_surface if t == UNKNOWN else b"" if t == CONTROL else p.replace(SPACE, " ").encode()
            for i, (p, _, t) in enumerate(self.pieces)
        ]
        self.fallback = model.trainer_spec.byte_fallback
        # What no piece holds can't be merged over: a space symbol after another character, if no piece
        # has one inside, and a newline, if none has one at all. Segments between them are independent.
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        line = any("\n" in p and len(p) > 1 for p in self.score)
        self.segments = re.compile(
            r"[\s\S]+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if line else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        ).findall

    # -- normalisation -------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text, and for each of its UTF-8 bytes (and its end) the original byte it comes from.

        None stands for the plain case, without a character map: byte i + 1 comes from byte i, and a
        space's three-byte symbol from its one byte.
        """
        if not text:
            return "", [0]
        if not self.map.units and not self.squeeze:
            out = text.replace(" ", SPACE) if self.escape else text
            return ((SPACE if self.escape else " ") + out if self.prefix else out), None
        data, space = text.encode(), (SPACE if self.escape else " ").encode()
        out, origin, i = bytearray(), [], 0
        steps: list[tuple[bytes, int, int]] = []
        while i < len(data):
            hit = self.map.longest(data, i)
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            n, new = hit if hit else (width, data[i : i + width])
            steps.append((new, i, i + n))
            i += n
        first, last = 0, len(steps)
        if self.squeeze:
            while first < last and steps[first][0] == b" ":
                first += 1
        if first == last:
            return "", [len(data)]
        if self.prefix:
            out += space
            origin += [steps[first][1]] * len(space)
        was_space, end = self.squeeze, len(data)
        for new, a, b in steps[first:last]:
            end = b
            if self.squeeze and was_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            was_space = new.endswith(b" ")
            for k in range(len(new)):
                c = new[k : k + 1]
                c = space if c == b" " else c
                out += c
                origin += [a] * len(c)
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = origin[len(out)]
                del origin[len(out) :]
        return out.decode(), [*origin, end]

    # -- encoding ------------------------------------------------------------------------------------

    def _merge(self, segment: str) -> list[str]:
        parts, score = list(segment), self.score
        n = len(parts)
        if n <= 32:
            get, none = self.rank.get, float("inf")
            found = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            while found:
                best = min(found)
                if best == none:
                    break
                i = found.index(best)
                parts[i] += parts.pop(i + 1)
                del found[i]
                if i:
                    found[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(found):
                    found[i] = get(parts[i] + parts[i + 1], none)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            s = score.get(both := parts[i] + parts[j])
            if s is not None:
                heapq.heappush(queue, (-s[0], i, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] + parts[j] != both or not parts[j]:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def ids_of(self, segment: str) -> list[int]:
        """Ids of one normalised segment; a symbol that is no piece falls back to its bytes."""
        get, out = self.id_of.get, []
        for part in self._merge(segment):
            i = get(part)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.byte_ids[b] for b in part.encode()]
            else:
                out.append(self.unk)
        return out

    def make(self, segment: str) -> tuple[bytes, bytes, bytes, bytes]:
        ids = self.ids_of(segment)
        lengths, plain = self._lengths(ids, segment)
        form = f"<{len(ids)}I"
        return struct.pack(form, *ids), self.surface(ids), struct.pack(form, *lengths), struct.pack(form, *plain)

    def _lengths(self, ids: list[int], segment: str) -> tuple[list[int], list[int]]:
        """How many bytes of a segment each of its ids stands for, and how many where a space symbol is one byte."""
        lengths, plain, data, at = [], [], segment.encode(), 0
        pending = 0  # bytes of a character that are still to come
        for i in ids:
            spaces = 0
            if i in self.of_byte:
                if not pending:
                    c = data[at]
                    width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                    pending = width
                pending -= 1
                n = 0 if pending else width  # the last byte stands for the character
            elif i == self.unk:
                c = data[at]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            else:
                n, spaces = len(self.pieces[i][0].encode()), self.pieces[i][0].count(SPACE)
            at += n
            lengths.append(n)
            plain.append(n - 2 * spaces)
        return lengths, plain

    def encode(self, text: str | None, bos: bool = True, eos: bool = True) -> Encoding:
        """Ids and spans. Begin and end ids stand for no bytes; so do all but the last byte of a character
        that falls back to bytes, and the dummy prefix."""
        self.turn()
        found, ends = self._aligned(text or "")
        packed = b"".join([f[0] for f in found])
        ids, ends = list(struct.unpack(f"<{len(packed) // 4}I", packed)), ends.tolist()
        begins, n = [0, *ends[:-1]][: len(ends)], len((text or "").encode())
        return Encoding(
            [self.bos] * bos + ids + [self.eos] * eos, [0] * bos + begins + [n] * eos, [0] * bos + ends + [n] * eos
        )

    def _aligned(self, text: str) -> tuple[list[tuple], np.ndarray]:
        """What each segment of a text is, and the original byte that each id's span ends at; it begins where the last ended."""
        norm, origin = self.normalise(text)
        found = list(map(self.__getitem__, self.segments(norm)))
        if origin is None and SPACE not in text:
            ends = np.cumsum(np.frombuffer(b"".join([f[3] for f in found]), dtype="<u4"), dtype=np.int64)
            return found, np.maximum(ends - 1, 0) if self.prefix else ends  # the first space was put there
        if origin is None:
            origin, at = [], 0
            for i, c in enumerate(norm):
                w = len(c.encode())
                origin += [at] * w
                at += 0 if i == 0 and self.prefix else 1 if c == SPACE and text[i - self.prefix] == " " else w
            origin.append(at)
        at = np.cumsum(np.frombuffer(b"".join([f[2] for f in found]), dtype="<u4"), dtype=np.int64)
        return found, np.array(origin, dtype=np.int64)[at]

    def digests(self, text: str | None) -> tuple[int, str, str, np.ndarray]:
        """Number of ids, SHA-256 of the ids and of the decoded text, and the spans' ends, begin and end ids included."""
        self.turn()
        found, ends = self._aligned(text or "")
        packed = b"".join([struct.pack("<I", self.bos), *[f[0] for f in found], struct.pack("<I", self.eos)])
        decoded = self._finish(b"".join([f[1] for f in found]))
        ends = np.concatenate([[0], ends, [len((text or "").encode())]])
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), ends

    # -- decoding ------------------------------------------------------------------------------------

    def surface(self, ids) -> bytes:
        """What ``ids`` spell, before the dummy prefix goes and bytes are checked."""
        return b"".join(map(self.spelt.__getitem__, ids))

    def _finish(self, spelt: bytes, prefixed: bool = True) -> bytes:
        """``prefixed``: the first piece is none of a single byte, so that a space it starts with was put there."""
        if prefixed and self.squeeze:
            spelt = spelt.lstrip(b" ") if self.prefix else spelt
        elif prefixed and self.prefix and spelt.startswith(b" "):
            spelt = spelt[1:]
        try:
            spelt.decode()
            return spelt
        except UnicodeDecodeError:
            return _repair(spelt)

    def decode(self, ids) -> str:
        first = next((k for i in ids if (k := self.pieces[i][2]) != CONTROL), NORMAL)
        return self._finish(self.surface(ids), first not in (BYTE, UNKNOWN)).decode()


def _repair(data: bytes) -> bytes:
    """Each byte that is no part of a whole character becomes U+FFFD."""
    out, i = bytearray(), 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                data[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            out += data[i : i + n]
            i += n
            break
        else:
            out += "�".encode()
            i += 1
    return bytes(out)


_workers: dict[str, SpanEncoder] = {}


def _worker(model: str) -> SpanEncoder:
    if model not in _workers:
        _workers[model] = SpanEncoder(model)
    return _workers[model]


def _mapped(docs: DataFrame, id_col: str, text_col: str, each, schema: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(each), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode_spans(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """One row a document: ``<id_col>, ids, begins, ends``, arrays of equal length.

    Spans are UTF-8 byte offsets into the original text. Null text counts as empty.
    """

    def run(batches):
        encoder = _worker(model)
        for b in batches:
            found = [encoder.encode(t, bos, eos) for t in b.column(1).to_pylist()]
            arrays = [pa.array([getattr(f, k) for f in found], pa.list_(pa.int32())) for k in ("ids", "begins", "ends")]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["id", "ids", "begins", "ends"])

    return _mapped(docs, id_col, text_col, run, "ids array<int>, begins array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row a row of ``encoded``: ``<id_col>, text``; null ids decode to the empty text."""

    def run(batches):
        encoder = _worker(model)
        for b in batches:
            texts = [encoder.decode(ids or []) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return _mapped(encoded, id_col, ids_col, run, "text string")


def round_trip_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``<id_col>, n_tokens, ids_sha256, decoded_sha256, ends``, begin and end ids included.

    ``ends`` has for each id the UTF-8 byte of the original text that its span ends at; it begins where the span
    before ended, the first at 0. Null text counts as empty (two ids). Null ids of documents and repeated rows pass
    through, an empty table gives none; other columns are neither read nor returned.
    """

    def run(batches):
        encoder = _worker(model)
        for b in batches:
            found = [encoder.digests(t) for t in b.column(1).to_pylist()]
            n, ids, decoded, ends = zip(*found) if found else ((), (), (), ())
            flat = np.concatenate(ends).astype(np.int32) if ends else np.zeros(0, np.int32)
            offsets = np.cumsum([0, *n], dtype=np.int64).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ends"],
            )

    return _mapped(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, ends array<int>")

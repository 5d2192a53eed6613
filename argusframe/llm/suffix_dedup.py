"""Removal of long repeated strings, by a sampled suffix array.

A text is a sequence of letters: its bytes or, with ``words``, its words. A letter goes if it lies in a string
of ``length`` letters (a window) that also starts somewhere else. Sorting the suffix at every letter would move
hundreds of times the input, so suffixes are sampled by content: the anchor of a window is, within its first
three quarters, the start of the gram of least hash, leftmost on ties. Equal windows have equal anchors at equal
offsets, and about one byte in 150 is an anchor; each stands for a run of neighbouring windows, its segment
being the letters that they cover.

1. Each document's anchors, with a digest of the suffix's leading letters (those that all the anchor's windows
   share: the class) and one of the segment. A class with one member holds no repeat.
2. The other segments are cut out and merged where they are equal, letter by letter, map-side first; one that
   occurs twice or more repeats whole. Digests only address a segment's members; should two segments share
   them, the segments themselves do.
3. Different segments of one class are range-partitioned by the leading letters of their suffixes, with splitters
   that Spark samples. Each bucket sorts the suffixes at all the windows of its segments by multikey
   quicksort. Equal leading letters never part, so neighbours across a bucket's boundary differ in them.
   Classes of more than ``crowd`` segments are no work for one task: these are parted further, by more of their
   letters, until they are small (see ``_refined``), and then sorted like the others. Nothing is left out.
4. The repeated windows' letters are merged per document and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, join_weighted, lasting, stored, temporary, tidy

BLANKS = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
GRAM = 8
PARTS = 8  # that a crowded class's range is cut in
TOGETHER = 2000  # segments that are sorted in one go, and as many more as the last class has
CHUNK = 1 << 20  # bytes of documents looked at in one go (a longer document is taken alone)
PLACE_BITS = 24  # of a position in the packed minima; longer documents are taken in overlapping parts
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
LONG_WORD = 1 << 12  # bytes; longer words are hashed one by one
POWERS = np.cumprod(np.append(np.uint64(1), np.full(2 * LONG_WORD, MIX[0], dtype=np.uint64)))


# -- letters ---------------------------------------------------------------------------------------------


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last; words are parted by the six ASCII blanks."""
    edge = np.diff(np.concatenate([[True], BLANKS[np.frombuffer(data, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_letters(data: bytes) -> bytes:
    """Eight bytes a word: a 64-bit digest of it."""
    starts, ends = word_bounds(data)
    out = np.empty(len(starts), dtype="<u8")
    raw, step = np.frombuffer(data, np.uint8), 1 << 15
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        lengths, at = e - s, slice(a, a + step)
        if lengths.max() > LONG_WORD:  # a word's digest mustn't depend on the words beside it
            for i in np.flatnonzero(lengths > LONG_WORD).tolist():
                out[a + i] = xxhash.xxh3_64_intdigest(data[s[i] : e[i]])
            short = np.flatnonzero(lengths <= LONG_WORD)
            if not len(short):
                continue
            s, lengths, at = s[short], lengths[short], a + short
        heads = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        value = (raw[inside + np.repeat(s, lengths)].astype(np.uint64) + np.uint64(1)) * POWERS[inside]
        h = np.add.reduceat(value, heads) + lengths.astype(np.uint64) * MIX[1]
        h ^= h >> np.uint64(32)
        h *= MIX[1]
        out[at] = h ^ (h >> np.uint64(29))
    return out.tobytes()


def letters_of(data: bytes | None, words: bool) -> bytes:
    """A text as letters of one byte or, for words, of eight."""
    return word_letters(data or b"") if words else data or b""


def _grams(data: np.ndarray) -> np.ndarray:
    """What is hashed at each position: eight bytes (unaligned view), or two words."""
    if data.dtype == np.uint8:
        return np.ndarray((max(0, len(data) - GRAM + 1),), dtype="<u8", buffer=data.data, strides=(1,))
    return data[:-1] * MIX[0] + data[1:]


def _gram(size: int) -> int:
    return GRAM if size == 1 else 2


# -- anchors ---------------------------------------------------------------------------------------------


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from two running minima over blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def span_of(length: int) -> int:
    """The letters at a window's beginning that its anchor is looked for in."""
    return length - length // 4


def anchor_of_windows(data: np.ndarray, length: int) -> np.ndarray:
    """For each window start ``s`` of ``data`` (at most 2**24 letters), the place of its anchor."""
    span = span_of(length)
    h = _grams(data[: len(data) - (length - span)]) * MIX[0]
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    h >>= np.uint64(PLACE_BITS)
    h <<= np.uint64(PLACE_BITS)
    h |= np.arange(len(h), dtype=np.uint64)
    return (_sliding_min(h, span - _gram(data.itemsize) + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def anchors(docs: list[bytes], length: int, size: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, anchor, first, last)``, in letters of ``size`` bytes: the windows ``first..last`` that have this anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    limit, kind = 1 << PLACE_BITS, np.dtype("u1" if size == 1 else "<u8")

    def look(parts: list[tuple[int, int, bytes]]) -> None:
        """Parts of documents ``(doc, where it starts, letters)``, set side by side."""
        data = np.frombuffer(b"".join(p[2] for p in parts), dtype=kind)
        if len(data) < length:
            return
        place = anchor_of_windows(data, length)
        sizes = np.array([len(p[2]) // size for p in parts])
        starts = np.cumsum(sizes) - sizes
        who = np.repeat(np.arange(len(parts)), sizes)[: len(place)]
        s = np.arange(len(place))
        inside = s + length <= (starts + sizes)[who]
        s, who, place = s[inside], who[inside], place[inside]
        if not len(s):
            return
        new = np.ones(len(s), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(new)
        last = s[np.append(at[1:] - 1, len(s) - 1)]
        shift = np.array([p[1] for p in parts])[who[at]] - starts[who[at]]
        out.append((np.array([p[0] for p in parts])[who[at]], place[at] + shift, s[at] + shift, last + shift))

    waiting, total = [], 0
    for i, d in enumerate(docs):
        n = len(d) // size
        if n < length:
            continue
        if n > limit:  # in parts that overlap by all but one letter of a window
            for at in range(0, n - length + 1, limit - length + 1):
                look([(i, at, d[at * size : (at + limit) * size])])
            continue
        if total + len(d) > CHUNK and waiting:
            look(waiting)
            waiting, total = [], 0
        waiting.append((i, 0, d))
        total += len(d)
    if waiting:
        look(waiting)
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out))


# -- sorting ---------------------------------------------------------------------------------------------


def repeated_windows(segments: list[bytes], length: int, size: int = 1) -> list[np.ndarray]:
    """For each segment, which of its windows occur twice or more in all ``segments``.

    Multikey quicksort of the suffixes at all windows: eight bytes, or a word, a step. What stands alone after a
    step is done; what still stands together after all ``length`` letters is equal in each of them.
    """
    sizes = np.array([len(s) // size for s in segments], dtype=np.int64)
    counts = np.maximum(0, sizes - length + 1)
    starts = np.cumsum(sizes) - sizes
    if size == 1:
        data = np.frombuffer(b"".join(segments) + b"\0" * GRAM, dtype=np.uint8)
        letters, depths = _grams(data), [*range(0, length - GRAM + 1, GRAM)]
        if length % GRAM:
            depths.append(length - GRAM)  # overlapping, so that it ends with the window
    else:
        letters, depths = np.frombuffer(b"".join(segments), dtype="<u8"), range(length)
    offsets = np.cumsum(counts) - counts
    pos = np.arange(int(counts.sum())) + np.repeat(starts - offsets, counts)
    index, group = np.arange(len(pos)), np.zeros(len(pos), dtype=np.int64)
    for d in depths:
        if not len(pos):
            break
        pos, index, group = _parted(pos, index, group, letters[pos + d])
    repeated = np.zeros(int(counts.sum()), dtype=bool)
    repeated[index] = True
    return np.split(repeated, np.cumsum(counts)[:-1]) if len(segments) else []


def _parted(pos: np.ndarray, index: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of the sort: groups (numbered in order) parted by ``key``, without what is alone in its new one."""
    same = group[1:] == group[:-1]
    differ = same & (key[1:] != key[:-1])
    if not differ.any():
        return pos, index, group
    mixed = np.zeros(int(group[-1]) + 1, dtype=bool)
    mixed[group[1:][differ]] = True
    at = np.flatnonzero(mixed[group])  # groups that agree stay as they are
    order = np.lexsort((key[at], group[at])) if mixed.sum() > 1 else np.argsort(key[at], kind="stable")
    pos[at], index[at], key[at] = pos[at][order], index[at][order], key[at][order]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = ~same | (key[1:] != key[:-1])
    kept = ~(new & np.append(new[1:], True))
    return pos[kept], index[kept], np.cumsum(new[kept]) - 1


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open ``spans``; touching spans make one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# -- the search over tables ------------------------------------------------------------------------------

ADDRESS = ["key", "whole"]


def _digest(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


def repeated_spans(
    docs: DataFrame, length: int = 400, words: bool = False, crowd: int = 2000, per_bucket: int = 20_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(id, mark, lo, hi)``: spans of letters that together cover what repeats; ``mark`` hashes the row's text.

    A row is addressed by its id and its text's hash, so rows may repeat ids. What is stored on the way goes.
    """
    with temporary(docs.sparkSession):
        return lasting(_repeated_spans(docs, length, words, crowd, per_bucket, id_col, text_col), "spans")


def _repeated_spans(docs: DataFrame, length: int, words: bool, crowd: int, per_bucket: int, id_col: str, text_col: str) -> DataFrame:
    size = 8 if words else 1
    span, lead = span_of(length), length - span_of(length)
    if lead < _gram(size):
        raise ValueError(f"length must be {4 * _gram(size)} or more")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("data"))
    rows = rows.where(F.octet_length("data") >= (2 * length - 1 if words else length))

    def scan(batches):
        """A row a different segment of a document, with how often it has it; spans of those that it repeats
        itself come as rows of count 0, so that periodic text is settled here and crowds no key."""
        for b in batches:
            data = [letters_of(d, words) for d in b.column(2).to_pylist()]
            doc, place, first, last = anchors(data, length, size)
            where = list(zip(doc.tolist(), place.tolist(), first.tolist(), last.tolist()))
            keys = np.fromiter((_digest(data[d][p * size : (p + lead) * size]) for d, p, _, _ in where), dtype=np.int64, count=len(where))
            whole = np.fromiter((_digest(data[d][a * size : (z + length) * size], 1) for d, _, a, z in where), dtype=np.int64, count=len(where))
            # repeats within a document are told by the letters themselves
            order = np.lexsort((first, whole, keys, doc))
            doc, place, first, last, keys, whole = (x[order] for x in (doc, place, first, last, keys, whole))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])
            for i in np.flatnonzero(~new).tolist():
                d = data[doc[i]]
                new[i] = d[first[i] * size : (last[i] + length) * size] != d[first[i - 1] * size : (last[i - 1] + length) * size]
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(doc)))
            again = np.repeat(count > 1, count)
            spans: dict[int, list[tuple[int, int]]] = {}
            for d, a, z in zip(doc[again].tolist(), first[again].tolist(), (last[again] + length).tolist()):
                spans.setdefault(d, []).append((a, z))
            own = [(d, a, z - a - length) for d, pairs in spans.items() for a, z in merge_spans(pairs)]
            zero = np.zeros(len(own), dtype=np.int64)
            column = lambda i: np.array([o[i] for o in own], dtype=np.int64)
            take = pa.array(np.concatenate([doc[head], column(0)]))
            both = lambda x, y: pa.array(np.concatenate([x, y]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(take), b.column(1).take(take), both(keys[head], zero), both(whole[head], zero),
                    both(first[head], column(1)).cast(pa.int32()), both((last - first)[head], column(2)).cast(pa.int32()),
                    both((place - first)[head], zero).cast(pa.int16()), both(count, zero),
                ],
                ["id", "mark", "key", "whole", "first", "more", "at", "count"],
            )

    found = stored(
        rows.mapInArrow(tidy(scan), f"id {kind}, mark long, key long, whole long, first int, more int, at short, count long"), "anchors"
    )
    hi = (F.col("first") + F.col("more") + length).alias("hi")
    own = found.where("count = 0").select("id", "mark", F.col("first").alias("lo"), hi)
    found = found.where("count > 0")
    classes = found.groupBy("key").agg(F.sum("count").alias("members")).where("members > 1")
    classes = stored(classes, "classes")
    wanted = join_weighted(found, classes, ["key"], "members").groupBy("id", "mark").agg(F.collect_set(F.struct("key", "whole", "count", "first", "more", "at")).alias("cuts"))

    def cut(batches):
        for b in batches:
            cuts = b.column(3)
            fields = cuts.flatten()
            owner = np.repeat(np.arange(len(cuts)), cuts.value_lengths().to_numpy())
            data = [letters_of(d, words) for d in b.column(2).to_pylist()]
            first, more = (fields.field(k).to_numpy() for k in (3, 4))
            ends = np.cumsum((more + length) * size)
            for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
                segments = [data[o][f * size : (f + m + length) * size] for o, f, m in zip(owner[part].tolist(), first[part].tolist(), more[part].tolist())]
                take = pa.array(owner[part])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), *[f.take(pa.array(part)) for f in fields.flatten()], pa.array(segments, pa.binary())],
                    ["id", "mark", "key", "whole", "n", "first", "more", "at", "segment"],
                )

    item = f"id {kind}, mark long, key long, whole long, n long, first int, more int, at short, segment binary"
    cutout = rows.alias("r").join(
        wanted.alias("w"), F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.mark") == F.col("w.mark"))
    ).select("r.id", "r.mark", "data", "cuts").mapInArrow(tidy(cut), item)
    kinds, clash = _merged(cutout, "segments")

    # a segment's other members, by its digests or, if those ever clash, by its letters
    address = [*ADDRESS, "segment"] if clash else ADDRESS
    whole = kinds.where("n > 1").select(*address, "n")
    once = (cutout.withColumnRenamed("n", "count") if clash else found).where("count = 1")
    spans = own.unionByName(
        join_weighted(once, whole, address, "n").select("id", "mark", F.col("first").alias("lo"), hi)
    )
    open_ = kinds.where("kinds > 1 and least = 1")
    pool = open_.where(F.col("kinds") <= crowd)
    more, refined = _refined(open_.where(F.col("kinds") > crowd), length, size, crowd, span - _gram(size))
    spans = spans.unionByName(refined) if refined else spans
    for each in more:
        pool = pool.unionByName(each)
    return spans.unionByName(_sorted(pool, length, size, lead, per_bucket))


def _merged(pieces: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``pieces(.., key, whole, n, .., segment)`` -> one row a different segment of a class of two or more, with the
    class's ``kinds`` and the ``least`` of their ``n``; and whether two segments share their digests."""
    one = F.min(F.struct("id", "mark", "first", "more", "at"))
    kinds = stored(pieces.groupBy(*ADDRESS, "segment").agg(F.sum("n").alias("n"), one.alias("one")), name)
    clash = not kinds.groupBy(*ADDRESS).count().where("count > 1").isEmpty()
    classes = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("members"), F.min("n").alias("least"))
    kinds = join_weighted(kinds, stored(classes.where("members > 1"), f"{name}-classes"), ["key"], "kinds")
    return kinds.select(*ADDRESS, "segment", "n", "one.*", "kinds", "least"), clash


def _refined(crowded: DataFrame, length: int, size: int, crowd: int, farthest: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Crowded classes parted until none is left: pieces to be sorted, and spans found on the way.

    All windows of a class whose anchor is at least ``lo`` and at most ``hi`` letters in share the letters from the one to the other
    extreme. Each round cuts that range in eight, which leaves a piece an eighth of the windows or so and makes the
    letters that its class shares longer; at a range of one, they are the whole window, and nothing is left to compare.
    """
    spans, pools = None, []
    level = crowded.select("id", "mark", "n", "first", "more", "at", "segment", F.lit(0).alias("lo"), F.lit(farthest).alias("hi"))
    kinds_ = {f.name: f.dataType.simpleString() for f in level.schema}
    shape = ", ".join(f"{c} {k}" for c, k in kinds_.items()) + ", key long, whole long"

    def eighths(batches):
        for b in batches:
            out = {c: [] for c in ("row", "first", "more", "at", "segment", "lo", "hi", "key", "whole")}
            cols = (b.column(c).to_pylist() for c in ("first", "more", "at", "segment", "lo", "hi"))
            for row, (first, more, at, segment, low, high) in enumerate(zip(*cols)):
                step = -(-(high - low + 1) // PARTS)
                for lo in range(low, high + 1, step):
                    hi = min(high, lo + step - 1)
                    a, z = max(0, at - hi), min(more, at - lo)
                    if a > z:
                        continue
                    piece = segment[a * size : (z + length) * size]
                    shared = piece[(at - a - lo) * size : (at - a - hi + length) * size]
                    values = (row, first + a, z - a, at - a, piece, lo, hi, _digest(shared, 2 + lo), _digest(piece, 1))
                    for c, v in zip(out, values):
                        out[c].append(v)
            take = pa.array(out["row"], pa.int64())
            same = {c: b.column(c).take(take) for c in ("id", "mark", "n")}
            kind = {"first": pa.int32(), "more": pa.int32(), "at": pa.int16(), "segment": pa.binary(), "lo": pa.int32(), "hi": pa.int32()}
            made = {c: pa.array(out[c], kind.get(c, pa.int64())) for c in list(out)[1:]}
            names = [*kinds_, "key", "whole"]
            yield pa.RecordBatch.from_arrays([{**same, **made}[c] for c in names], names)

    width = farthest + 1
    while not level.isEmpty():
        pieces = stored(level.mapInArrow(tidy(eighths), shape), "crowd-pieces")
        width = -(-width // PARTS)
        kinds, _ = _merged(pieces, "crowd-kinds")
        found = pieces.where("n = 1").join(kinds.where("n > 1").select(*ADDRESS, "segment"), [*ADDRESS, "segment"], "left_semi")
        found = found.select("id", "mark", F.col("first").alias("lo"), (F.col("first") + F.col("more") + length).alias("hi"))
        spans = found if spans is None else spans.unionByName(found)
        if width <= 1:
            break
        open_ = kinds.where("kinds > 1 and least = 1")
        pools.append(open_.where(F.col("kinds") <= crowd))
        ranges = pieces.select("key", "lo", "hi").distinct()  # one a class
        level = open_.where(F.col("kinds") > crowd).join(ranges, "key").select(*kinds_)
        level = stored(level, "crowd-level")
    return pools, spans


def _sorted(pool: DataFrame, length: int, size: int, lead: int, per_bucket: int) -> DataFrame:
    """Spans of the repeated windows of ``pool``'s segments that occur once, bucket by bucket."""
    kind = pool.schema["id"].dataType.simpleString()

    def sort(batches):
        """The bucket's classes, one after the other: rows come in the order of their leading letters, and some
        whole classes at a time are sorted on."""
        ids, rest, segs, last = [], [], [], None

        def settle():
            own = pa.concat_tables(ids)
            which, lo, hi = [], [], []
            for i, ((n, first), flags) in enumerate(zip(rest, repeated_windows(segs, length, size))):
                if n == 1:  # the others are repeated whole
                    for a, z in _runs(flags):
                        which.append(i)
                        lo.append(first + a)
                        hi.append(first + z + length)
            picked = own.take(pa.array(which, pa.int64()))
            table = pa.table([*picked.columns, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["id", "mark", "lo", "hi"])
            return table.combine_chunks().to_batches()

        for b in batches:
            leads = b.column(5).to_pylist()
            n, first, seg = (b.column(k).to_pylist() for k in (2, 3, 4))
            at = 0
            for i, lead_ in enumerate(leads):
                if lead_ != last and len(segs) + i - at >= TOGETHER:
                    part = b.slice(at, i - at)
                    ids.append(pa.table([part.column(0), part.column(1)], ["id", "mark"]))
                    rest += zip(n[at:i], first[at:i])
                    segs += seg[at:i]
                    yield from settle()
                    ids, rest, segs, at = [], [], [], i
                last = lead_
            part = b.slice(at)
            ids.append(pa.table([part.column(0), part.column(1)], ["id", "mark"]))
            rest += zip(n[at:], first[at:])
            segs += seg[at:]
        if segs:
            yield from settle()

    pool = pool.withColumn("lead", F.expr(f"substring(segment, at * {size} + 1, {lead * size})"))
    buckets = max(1, -(-pool.count() // per_bucket))
    return (
        pool.repartitionByRange(buckets, "lead").sortWithinPartitions("lead")
        .select("id", "mark", "n", "first", "segment", "lead").mapInArrow(tidy(sort), f"id {kind}, mark long, lo int, hi int")
    )


# -- passages that are told, not cut -----------------------------------------------------------------------

RADIX, BACK = MIX[0], np.uint64(pow(int(MIX[0]), -1, 1 << 64))


def string_digests(letters: np.ndarray):
    """A function ``(starts, lengths)`` -> 64-bit digests of these strings of ``letters``, by differences of a running sum."""
    n = len(letters)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, RADIX)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BACK)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(letters * powers[:-1])])

    def digests(starts: np.ndarray, lengths) -> np.ndarray:
        h = (total[starts + lengths] - total[starts]) * back[starts] + np.asarray(lengths).astype(np.uint64) * MIX[1]
        h ^= h >> np.uint64(32)
        h *= MIX[1]
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    return digests


def _in_parts(data: list[bytes]):
    """Neighbouring documents' letters about a ``CHUNK`` at a time: the first one's number, each one's start, all letters."""
    sizes = np.array([len(d) for d in data], dtype=np.int64) // 8
    for part in np.split(np.arange(len(data)), np.flatnonzero(np.diff(np.cumsum(sizes) * 8 // CHUNK)) + 1):
        if len(part):
            a, z = int(part[0]), int(part[-1]) + 1
            yield a, z, np.cumsum(sizes[a:z]) - sizes[a:z], np.frombuffer(b"".join(data[a:z]), dtype="<u8")


def passage_spans(docs: DataFrame, length: int = 51, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repeated_spans`` of strings of ``length`` words, by digests of whole strings alone: ``(id, mark, lo, hi)``.

    Segments that are equal repeat whole. Where different segments share a class, each of their windows is
    digested, and a window repeats if its digest does. No text is cut out or sorted, which takes less disk than
    the search that removes; two different strings are taken for one if their 64-bit digests are equal.
    """
    with temporary(docs.sparkSession):
        return lasting(_passage_spans(docs, length, id_col, text_col), "spans")


def _passage_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    lead = length - span_of(length)
    if lead < _gram(8):
        raise ValueError(f"length must be {4 * _gram(8)} or more")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("data"))
    rows = rows.where(F.octet_length("data") >= 2 * length - 1)

    def scan(batches):
        for b in batches:
            data = [word_letters(d) for d in b.column(2).to_pylist()]
            for a, z, starts, letters in _in_parts(data):
                doc, place, first, last = anchors(data[a:z], length, 8)
                digests, at = string_digests(letters), starts[doc] if len(doc) else doc
                take = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take), b.column(1).take(take), pa.array(digests(at + place, lead)),
                        pa.array(digests(at + first, last - first + length)), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int32)),
                    ],
                    ["id", "mark", "key", "whole", "first", "more"],
                )

    shape = f"id {kind}, mark long, key long, whole long, first int, more int"
    found = stored(rows.mapInArrow(tidy(scan), shape), "passage-anchors")
    classes = stored(found.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "passage-classes")
    one = F.min(F.struct("id", "mark", "first", "more"))
    kinds = join_weighted(found, classes, ["key"], "members").groupBy(*ADDRESS).agg(F.count("*").alias("n"), one.alias("one"))
    kinds = stored(kinds, "passage-kinds")
    hi = (F.col("first") + F.col("more") + length).alias("hi")
    equal = join_weighted(found, kinds.where("n > 1").select(*ADDRESS, "n"), ADDRESS, "n")
    equal = equal.select("id", "mark", F.col("first").alias("lo"), hi)

    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    mixed = stored(mixed.select("key", "kinds"), "passage-mixed")
    wanted = join_weighted(kinds, mixed, ["key"], "kinds").select("n", "one.*")
    wanted = wanted.groupBy("id", "mark").agg(F.collect_set(F.struct("first", "more", "n")).alias("cuts"))

    def windows(batches):
        for b in batches:
            cuts = b.column(3)
            fields, sizes = cuts.flatten(), cuts.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(cuts)), sizes)
            first, more, n = (fields.field(k).to_numpy().astype(np.int64) for k in range(3))
            for a, z, starts, letters in _in_parts([word_letters(d) for d in b.column(2).to_pylist()]):
                mine = np.flatnonzero((owner >= a) & (owner < z))
                count = more[mine] + 1
                which = np.repeat(mine, count)
                pos = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[which]
                take = pa.array(owner[which])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(take), b.column(1).take(take), pa.array(string_digests(letters)(starts[owner[which] - a] + pos, length)),
                        pa.array(pos.astype(np.int32)), pa.array(n[which] == 1),
                    ],
                    ["id", "mark", "digest", "lo", "alone"],
                )

    joined = rows.alias("r").join(
        wanted.alias("w"), F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.mark") == F.col("w.mark"))
    ).select("r.id", "r.mark", "data", "cuts")
    each = stored(joined.mapInArrow(tidy(windows), f"id {kind}, mark long, digest long, lo int, alone boolean"), "passage-windows")
    again = stored(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "passage-again")
    parts = join_weighted(each.where("alone"), again, ["digest"], "n")
    return equal.unionByName(parts.select("id", "mark", "lo", (F.col("lo") + length).alias("hi")))


# -- the operators ---------------------------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame, length: int = 400, words: bool = False, id_col: str = "doc_id", text_col: str = "text", crowd: int = 2000,
    passage: int | None = None, texts: bool = True,
) -> DataFrame:
    """One row a row of ``docs``: ``<id_col>, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` (binary).

    Bytes covered by a string of ``length`` bytes that also starts elsewhere, in the same document or in
    another, are cut; strings are judged on the input. With ``words``, strings are of ``length`` words, parted
    by the ASCII blanks, whichever these are; a cut then takes the blanks after its last word along. Words are told
    apart by 64-bit digests. Null text counts as empty; texts shorter than ``length`` are whole. Rows that
    repeat a text lose it all (if long enough), whatever their ids. ``kept_text`` are the remaining bytes, null
    without ``texts``: a cut may fall inside a character. With ``passage``, a last column ``n_passage_words`` says how many words lie in strings of
    so many words that also start elsewhere; they are only told, not cut. Other columns are neither read nor
    returned, an empty table gives none.
    """
    out = _cut(docs, length, words, id_col, text_col, crowd, (), passage, texts).withColumnRenamed("id", id_col)
    return out if passage else out.drop("n_passage_words")


def _cut(
    docs: DataFrame, length: int, words: bool, id_col: str, text_col: str, crowd: int, extra: tuple[str, ...], passage: int | None = None,
    texts: bool = True, decoded: bool = False,
) -> DataFrame:
    """What ``remove_repeats`` returns, the id as ``id``, and the columns ``extra`` as ``x0, x1, ..``; ``kept_text`` as a string
    if ``decoded``, without what is left of a cut character."""
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, length, words, crowd, id_col=id_col, text_col=text_col).withColumn("told", F.lit(False))
    if passage:
        told = passage_spans(docs, passage, id_col=id_col, text_col=text_col)
        spans = spans.unionByName(told.withColumn("told", F.lit(True)))
    lists = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("lo", "hi", "told")).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [F.col(c).alias(f"x{i}") for i, c in enumerate(extra)]
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("data"), *carried)
    joined = rows.alias("r").join(
        lists.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.mark") == F.col("s.mark")), "left"
    ).select("r.id", "data", "spans.lo", "spans.hi", "spans.told", *[f"x{i}" for i in range(len(extra))])

    def cut(batches):
        for b in batches:
            n_bytes, removed, n_spans, sha, kept, passages = [], [], [], [], [], []
            for data, lo, hi, told in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4))):
                runs = merge_spans([(a, z) for a, z, t in zip(lo, hi, told) if not t]) if lo else []
                passages.append(sum(z - a for a, z in merge_spans([(a, z) for a, z, t in zip(lo, hi, told) if t])) if lo else 0)
                if words and runs:
                    starts = np.append(word_bounds(data)[0], len(data)).tolist()
                    runs = [(starts[a], starts[z]) for a, z in runs]
                at, parts = 0, []
                for a, z in runs:
                    parts.append(data[at:a])
                    at = z
                parts.append(data[at:])
                rest = b"".join(parts)
                n_bytes.append(len(data))
                removed.append(len(data) - len(rest))
                n_spans.append(len(runs))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append((rest.decode("utf-8", "ignore") if decoded else rest) if texts else None)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                    pa.array(sha, pa.string()), pa.array(kept, pa.string() if decoded else pa.binary()), pa.array(passages, pa.int64()), *b.columns[5:],
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "n_passage_words", *[f"x{i}" for i in range(len(extra))]],
            )

    more = "".join(f", x{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(extra))
    return joined.mapInArrow(
        tidy(cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text {"string" if decoded else "binary"}, n_passage_words long{more}"
    )


def without_repeats(
    docs: DataFrame, length: int = 400, words: bool = False, id_col: str = "doc_id", text_col: str = "text",
    size_col: str | None = "n_chars", crowd: int = 2000,
) -> DataFrame:
    """``docs`` with its own columns and all its rows, each text without what ``remove_repeats`` cuts.

    Where a cut falls inside a character, what is left of the character goes too. ``size_col``, if given and
    there, becomes the new number of characters.
    """
    extra = tuple(c for c in docs.columns if c not in (id_col, text_col))
    done = _cut(docs, length, words, id_col, text_col, crowd, extra, decoded=True)
    source = {id_col: "id", text_col: "kept_text"} | {c: f"x{i}" for i, c in enumerate(extra)}
    columns = [F.col(source[c]).alias(c) for c in docs.columns]
    if size_col in docs.columns:
        columns[docs.columns.index(size_col)] = F.length("kept_text").cast(docs.schema[size_col].dataType).alias(size_col)
    return done.select(*columns)

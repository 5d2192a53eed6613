"""SimHash near-dedup: fingerprints of word shingles, linked through multi-index hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import bounded_batches, connected_components, join_weighted, lasting, spanning_heads, stored, temporary, tidy, told

BITS, SEGMENT = 64, 32
HASH_SEED = 42


def shingle_hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of the ``shingle``-word shingles of ``text``, repeats included, in order.

    Only A-Z are lower-cased; words are split at ASCII white space (``bytes.split``'s and the contract's
    separators are the same six bytes). Fewer words: one shingle of them all. No word, or null: none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, HASH_SEED)]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        ends = starts[shingle:]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], HASH_SEED) for a, b in zip(starts, ends)]
    return np.array(hashes, dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of ``hashes``; none of no hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded work space for very long texts
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


WIDE = 4  # words of a wide fingerprint


def wide_fingerprint(text: str | None, shingle: int = 3) -> list[int]:
    """256 bits: the fingerprint and three more, of the hashes mixed anew."""
    h = shingle_hashes(text, shingle)
    out = [majority(h)]
    for k in range(1, WIDE):
        g = (h ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0x94D049BB133111EB)
        out.append(majority(g ^ (g >> np.uint64(29))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint's bits in a signed long; one row a row of ``docs``."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            signed = np.array(fp, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), f"id {kind}, fp long")


def _ball(value) -> F.Column:
    """All values within one differing bit of a 32-bit segment."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(SEGMENT)])
    return F.explode(F.transform(masks, lambda m: value.bitwiseXOR(m)))


def link_fingerprints(fps: DataFrame, hot: int = 64) -> DataFrame:
    """Edges ``(a, b)`` that connect all of the distinct fingerprints ``fps(fp)`` within two bits.

    Two 32-bit segments; of fingerprints that differ in two bits or fewer, at least one segment differs
    in at most one. Every fingerprint probes the table of each segment with the segment's Hamming ball
    of radius one, and matches are verified over all 64 bits. A bucket (one segment value) of up to
    ``hot`` fingerprints gives its pairs. Members of a larger bucket, say a big group of near copies, are
    not paired: inside it, they meet in the ball of the other segment as well, where two fingerprints
    share a key exactly if they are within two bits; each key gives a star around its least member. A
    probe from next door (one bit off) must match the other segment within one bit, which its ball
    addresses as whole fingerprints. So the work grows with the number of fingerprints, the links found
    may be fewer than all, and the components are those of all links.
    """
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT)
    table = fps.select(F.col("fp"), F.posexplode(F.array(low, high)).alias("seg", "val"))
    other = F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", SEGMENT)).otherwise(low)
    table = table.select("seg", "val", "fp", other.alias("rest"))
    sizes = table.groupBy("seg", "val").agg(F.count("*").alias("n"))
    table = stored(table.join(sizes, ["seg", "val"]), "simhash-table")
    crowded = table.where(F.col("n") > hot).select("seg", "val").distinct()
    probes = table.select("seg", F.col("val").alias("own"), _ball(F.col("val")).alias("val"), "fp", "rest")

    small = table.where(F.col("n") <= hot).select("seg", "val", F.col("fp").alias("b"))
    pairs = (
        probes.select("seg", "val", F.col("fp").alias("a"))
        .join(small, ["seg", "val"])
        .where("a < b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    big = table.where(F.col("n") > hot)
    near = big.select("seg", "val", "fp", _ball(F.col("rest")).alias("mid"))
    first = near.groupBy("seg", "val", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1")
    stars = near.join(first, ["seg", "val", "mid"]).where("fp > a").select("a", F.col("fp").alias("b"))
    next_door = (
        probes.where("own != val").join(crowded, ["seg", "val"], "left_semi")
        .select("seg", "val", "fp", _ball(F.col("rest")).alias("rest"))
        .join(big.select("seg", "val", "rest", F.col("fp").alias("b")), ["seg", "val", "rest"])
        .select(F.col("fp").alias("a"), "b")
    )
    return pairs.unionByName(stars).unionByName(next_door).where("bit_count(a ^ b) <= 2")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hot: int = 64
) -> DataFrame:
    """One row a row of ``docs``: ``<id_col>, fingerprint, component_id``.

    ``component_id`` is the smallest id reachable over links of two differing bits or fewer, own id
    included. Null text counts as empty (fingerprint zero, linked like any other). Null ids get the
    component of their fingerprint and never name one (a component of null ids only is null). Equal
    fingerprints are one node, so copies are never paired. Other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-prints")
    return _components_of(prints, hot).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _components_of(prints: DataFrame, hot: int) -> DataFrame:
    """``prints(id, fp)`` -> ``id, fp, component_id`` over links of two bits or fewer."""
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "simhash-nodes")
    comps = connected_components(link_fingerprints(nodes.select("fp"), hot))
    tied = nodes.join(comps, nodes["fp"] == comps["node"]).select("fp", "component", "least")
    heads = tied.groupBy("component").agg(F.min("least").alias("head"))
    tied = tied.join(heads, "component").select("fp", "head")
    own = nodes.join(tied, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id"), "rows")
    return join_weighted(prints, stored(own, "simhash-own"), ["fp"], "rows").select("id", "fp", "component_id")


TABLES, KEY_BITS = 32, 32  # each indexed by that many bits of a wide fingerprint, drawn at random
FARTHEST = 52  # differing bits of 256 that still make a candidate; unrelated texts differ in 128 +- 8


def table_keys(wide: np.ndarray) -> np.ndarray:
    """Rows of wide fingerprints -> rows of ``TABLES`` keys of ``KEY_BITS`` bits."""
    bits = np.unpackbits(np.ascontiguousarray(wide, dtype="<u8").view(np.uint8), axis=1, bitorder="little")
    rng, weights = np.random.default_rng(64), 1 << np.arange(KEY_BITS, dtype=np.int64)
    drawn = [rng.permutation(64 * WIDE)[:KEY_BITS] for _ in range(TABLES)]
    return np.stack([bits[:, d].astype(np.int64) @ weights for d in drawn], axis=1)


def shingle_similarity(a: str | None, b: str | None, words: int = 5) -> float:
    """Jaccard similarity of the sets of ``words``-word shingles; texts without words are equal."""
    x, y = (set(shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


COMMON, MOST_COMMON, LOOKED_AT = 1, 1 << 18, 16  # a common shingle is in more sampled rows; how many are told to all tasks; one row in so many is sampled


def shingle_prefixes(
    rows: DataFrame, similarity: float, words: int, common: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """``rows(id, text)`` -> ``(h, id, size)``, the first shingles of each row's set in one order for all rows.

    Of a set of n, as many are given that two sets with a Jaccard similarity of ``similarity`` or more have
    one of them in common, whatever the order: n less ceil(similarity * n), and one; all of them for a similarity
    of 0. The order is by hash, but for ``common`` (sorted hashes, counts): those come last, by count.
    """
    kind, spark = rows.schema["id"].dataType.simpleString(), rows.sparkSession
    sent = spark.sparkContext.broadcast(common) if common and len(common[0]) else None

    def run(batches):
        hashes, counts = sent.value if sent else (None, None)
        for b in batches:
            firsts, sizes = [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, words).astype("<u8").view("<i8"))
                n = len(h)
                if sent and n:
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    h = h[np.argsort(np.where(hashes[at] == h, counts[at], 0), kind="stable")]
                firsts.append(h[: prefix_size(n, similarity)])
                sizes.append(n)
            long = [len(f) for f in firsts]
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(firsts)), long)))
            flat = np.concatenate(firsts) if firsts else np.zeros(0, dtype="<i8")
            for i in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat[i : i + (1 << 16)]), ids[i : i + (1 << 16)], pa.array(np.repeat(sizes, long)[i : i + (1 << 16)], pa.int64())],
                    ["h", "id", "size"],
                )

    return rows.select("id", "text").mapInArrow(tidy(run), f"h long, id {kind}, size long")


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in most of a sixteenth of the rows, sorted, and in how many: at most ``MOST_COMMON``.

    They only set the order, which decides how much is compared, never what is found.
    """
    some = rows.where(f"pmod(xxhash64(id), {LOOKED_AT}) = 0")
    counts = shingle_prefixes(some, 0, words).groupBy("h").count().where(F.col("count") > COMMON)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix_size(n: int, similarity: float) -> int:
    """How many shingles of a set of ``n`` are its prefix."""
    return min(n, n - int(np.ceil(similarity * n - 1e-9)) + 1)


def least_shared(x: str, y: str, similarity: float) -> str:
    """SQL: shingles that prefixes of sets of ``x`` and ``y`` at ``similarity`` or more have in common at least.

    Such sets share ``both`` shingles at least. The k-th of these, in the order of all, has at most ``x - both`` others
    of its set before it, so the first k are in both prefixes while those are as long.
    """
    both = f"ceil({similarity / (1 + similarity)!r}D * ({x} + {y}) - 1e-9D)"
    spare = lambda n: f"({both} - ceil({similarity}D * {n} - 1e-9D) + 1)"
    return f"greatest(1, least({spare(x)}, {spare(y)}))"


CROWD = 64  # rows of one shingle that are paired; more are compared in blocks


def unsettled_pairs(
    rows: DataFrame, known: DataFrame, similarity: float, words: int, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``(a, b)`` of ids that may be alike and have different components in ``known(id, component)``, and edges
    ``(a, b)`` between ids that are, from shingles that too many rows have to be paired.

    Every pair of ``rows(id, text)`` at ``similarity`` or more is among the former, connected by the latter, or has
    one component already: both have so many shingles of their prefixes in common as ``least_shared`` says, which most
    other pairs haven't. Shingles of one component only are dropped before pairing.
    """
    first = stored(shingle_prefixes(rows, similarity, words, common_shingles(rows, words)), "shingle-prefixes")
    twice = first.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("rows"))
    twice = stored(twice.where("lo != hi").select("h", "rows"), "shingle-twice")
    first = join_weighted(first, twice, ["h"], "rows").select("h", "id", "size").join(known, "id")
    first = stored(first.select("h", "id", "size", "component"), "shingle-known")
    mixed = first.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"))
    mixed = stored(mixed.where("lo != hi").select("h", "rows"), "shingle-mixed")
    first = join_weighted(first, mixed, ["h"], "rows")
    hot = stored(first.where(F.col("rows") > crowd), "shingle-crowds")
    several = hot.groupBy("id", "size").agg(F.count("*").alias("hot"))
    few = first.where(F.col("rows") <= crowd).drop("rows").join(several, ["id", "size"], "left").withColumn("hot", F.coalesce("hot", F.lit(0)))
    few = stored(few, "shingle-open")
    x, y = few.alias("x"), few.alias("y")
    near = f"x.size >= {similarity}D * y.size - 1e-6D and y.size >= {similarity}D * x.size - 1e-6D"
    met = x.join(y, F.expr(f"x.h = y.h and x.component < y.component and {near}"))
    # rows that repeat an id count by themselves, by their sizes; what crowds have in common isn't counted here
    spared = F.least("x.hot", "y.hot").alias("spared")
    met = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.size").alias("m"), F.col("y.size").alias("n"), spared).count()
    pairs = met.where(F.col("count") >= F.greatest(F.lit(1), F.expr(least_shared("m", "n", similarity)) - F.col("spared"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    return pairs, None if hot.isEmpty() else crowded_edges(rows, known, hot, similarity, words)


def crowded_edges(rows: DataFrame, known: DataFrame, hot: DataFrame, similarity: float, words: int, block: int = 512) -> DataFrame:
    """Edges ``(a, b)`` that connect all alike rows that share a shingle of ``hot(h, id, size, rows)``.

    Rows are gathered in clusters by the shingles that they share, and within these by size, in steps of ``similarity``,
    so that alike rows are at most one step apart. A cluster's steps are dealt in blocks; a pair of blocks is the unit
    of work, which counts the shingles in common as a matrix product and gives a star for each of its components.
    """
    least = stored(hot.groupBy("h").agg(F.min("id").alias("b"), F.max("rows").alias("rows")), "crowd-heads")
    ties = join_weighted(hot.select("h", "id"), least, ["h"], "rows").select(F.col("id").alias("a"), "b")
    clusters = connected_components(ties).withColumnRenamed("node", "id")
    step = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(similarity))).cast("int").alias("step")
    members = hot.select("id", step).distinct().join(clusters, "id", "left").select("id", "step", F.coalesce("component", "id").alias("cluster"))
    members = stored(members, "crowd-members")
    sizes = stored(members.groupBy("cluster", "step").agg(F.count("*").alias("n"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "crowd-sizes")
    other = sizes.select("cluster", F.col("step").alias("y"), F.col("blocks").alias("y_blocks"))
    units = sizes.withColumn("y", F.explode(F.array("step", F.col("step") + 1))).join(other, ["cluster", "y"])
    units = units.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(
        "j", F.explode(F.expr("if(step = y, sequence(i, y_blocks - 1), sequence(0, y_blocks - 1))"))
    ).select("cluster", F.col("step").alias("x"), "y", "i", "j")
    dealt = members.join(sizes, ["cluster", "step"]).select("cluster", "step", "id", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("blk"))
    unit = ["cluster", "x", "y", "i", "j"]
    side = lambda step, blk, n: units.select(*unit, F.col(step).alias("step"), F.col(blk).alias("blk"), F.lit(n).alias("side"))
    both = side("x", "i", 0).unionByName(side("y", "j", 1).where("x != y or i != j")).join(dealt, ["cluster", "step", "blk"])
    sets = rows.join(told(stored(members.select("id").distinct().join(known, "id"), "crowd-known")), "id").select("id", "component", "text")
    both = both.join(sets, "id").select(*unit, "side", "id", "component", "text")

    def compare(group: pa.Table) -> pa.Table:
        one = group.column("x")[0] == group.column("y")[0] and group.column("i")[0] == group.column("j")[0]
        which, ids, component = (group.column(c).to_numpy() for c in ("side", "id", "component"))
        tokens = [np.unique(shingle_hashes(t, words)) for t in group.column("text").to_pylist()]
        p, q = np.flatnonzero(which == 0), np.flatnonzero(which == (0 if one else 1))
        a, b = alike_pairs([tokens[k] for k in p], [tokens[k] for k in q], similarity)
        a, b = p[a], q[b]
        good = component[a] != component[b]
        nodes, heads = spanning_heads(ids[a[good]], ids[b[good]])
        keep = nodes != heads
        return pa.table({"a": nodes[keep], "b": heads[keep]})

    return stored(both.groupBy(*unit).applyInArrow(compare, "a long, b long"), "crowd-edges")


def alike_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets, one of each list, with a Jaccard similarity of ``similarity`` or more; empty sets are equal."""
    sizes = [np.array([len(t) for t in part], dtype=np.int64) for part in (left, right)]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [np.concatenate([np.zeros(0, "<u8"), *part]) for part in (left, right)]
    owner = [np.repeat(np.arange(len(part)), n) for part, n in zip((left, right), sizes)]
    vocab = np.intersect1d(*flat)
    for at in range(0, len(vocab), width):  # some shingles at a time
        part, m = vocab[at : at + width], []
        for f, o, n in zip(flat, owner, (len(left), len(right))):
            place = np.minimum(np.searchsorted(part, f), len(part) - 1)
            hit = part[place] == f
            dense = np.zeros((n, len(part)), dtype=np.float32)
            dense[o[hit], place[hit]] = 1
            m.append(dense)
        shared += m[0] @ m[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared.astype(np.int64)
    score = np.divide(shared, union, out=np.ones(shared.shape), where=union > 0)
    return np.nonzero(score >= similarity)


def near_duplicate_groups(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = 3, hot: int = 64, crowd: int = CROWD,
) -> DataFrame:
    """One row a row of ``docs``: ``<id_col>, component_id``, the smallest id reachable over links.

    Documents link if their fingerprints differ in two bits or fewer, or if the sets of their ``words``-word
    shingles have a Jaccard similarity of ``similarity`` or more. All of these links count, however many documents
    there are. A first round settles most of them cheaply: each document is held against the least one in its
    bucket of each of 32 tables, which are indexed by bits of a wide fingerprint of 256 bits. Then all pairs
    that may be alike by their shingles' prefixes and aren't connected yet are compared, those of crowded shingles in
    blocks. So a large group of near copies isn't paired, and what the first round misses only costs comparisons. Null
    text counts as empty, a null id links with nothing and has a null component; equal wide fingerprints link. Ids are
    whole numbers; of other types they raise a TypeError. Rows that repeat an id share a component, ties go to the
    smallest id, whole texts of any length are compared, and an empty table gives none.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    kind = docs.schema[id_col].dataType
    base = bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with temporary(docs.sparkSession):
        comps = lasting(_near_components(base, similarity, words, shingle, hot, crowd), "near-components")
    out = base.select("id").join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("component_id").cast(kind).alias("component_id"))


def _near_components(base: DataFrame, similarity: float, words: int, shingle: int, hot: int, crowd: int) -> DataFrame:
    """``(id, component)`` of the rows of ``base(id, text)`` that link with any."""

    def run(batches):
        for b in batches:
            wide = np.array([wide_fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, WIDE)
            words_ = [pa.array(wide[:, k].copy().view(np.int64)) for k in range(WIDE)]
            keys = pa.array(list(table_keys(wide)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *words_, keys], ["id", "fp", "f1", "f2", "f3", "keys"])

    prints = stored(base.mapInArrow(tidy(run), "id long, fp long, f1 long, f2 long, f3 long, keys array<long>"), "wide-prints")
    bits = ["fp", "f1", "f2", "f3"]
    narrow = _components_of(prints.select("id", "fp"), hot).select("id", "component_id")
    nodes = stored(prints.where("id is not null").groupBy(*bits, "keys").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "wide-nodes")
    member = join_weighted(prints.drop("keys"), nodes.drop("keys"), bits, "rows").select("id", "rep")
    equal = member.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    close = narrow.where("id != component_id").select(F.col("id").alias("a"), F.col("component_id").alias("b"))

    width = min(KEY_BITS, max(16, nodes.count().bit_length() + 4))
    table = nodes.select("rep", F.posexplode("keys").alias("t", "val")).select(
        (F.col("t").cast("long") * F.lit(1 << KEY_BITS) + F.col("val").bitwiseAND(F.lit((1 << width) - 1))).alias("slot"), "rep"
    )
    apart = " + ".join(f"bit_count(x.{f} ^ y.{f})" for f in bits)

    def judge(batches):
        seen: dict[int, tuple] = {}  # some texts and their sets, by id

        def set_of(key, text) -> np.ndarray:
            if key not in seen:
                if len(seen) >= 256:
                    seen.clear()
                seen[key] = text, np.unique(shingle_hashes(text, words))
            if seen[key][0] != text:
                return np.unique(shingle_hashes(text, words))
            return seen[key][1]

        for b in batches:
            alike = []
            for i, j, s, t in zip(*(b.column(k).to_pylist() for k in range(4))):
                x, y = set_of(i, s), set_of(j, t)
                both = len(np.intersect1d(x, y, assume_unique=True))
                union = len(x) + len(y) - both
                alike.append(not union or both / union >= similarity)
            yield b.select([0, 1]).filter(pa.array(alike, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs ``(a, b)``, those alike by their texts."""
        needed = stored(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "wide-needed")
        texts = stored(base.join(told(needed), "id").distinct(), "wide-texts")
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
        return both.mapInArrow(tidy(judge), "a long, b long")

    leaders = table.groupBy("slot").agg(F.min("rep").alias("a"))
    pairs = table.join(leaders, "slot").where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    pairs = pairs.alias("p").join(nodes.alias("x"), F.expr("p.a = x.rep")).join(nodes.alias("y"), F.expr("p.b = y.rep"))
    pairs = stored(pairs.where(f"{apart} <= {FARTHEST}").select("p.a", "p.b"), "wide-pairs")
    edges = stored(equal.unionByName(close).unionByName(verified(pairs)), "wide-edges")
    comps = connected_components(edges).withColumnRenamed("node", "id")
    rows = base.where("id is not null")
    known = rows.select("id").distinct().join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    rest, crowds = unsettled_pairs(rows, stored(known, "wide-known"), similarity, words, crowd)
    edges = edges.unionByName(verified(stored(rest, "wide-rest")))
    comps = connected_components(edges.unionByName(crowds) if crowds else edges).withColumnRenamed("node", "id")
    return comps


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns, one document of each near-duplicate group: the smallest id.

    Rows with a null id stay. Rows that repeat an id stay or go together: they stay if one of them is its group's smallest.
    """
    groups = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, **options)
    head = F.col(id_col).eqNullSafe(F.col("component_id"))
    gone = groups.groupBy(F.col(id_col).alias("__id")).agg(F.max(head).alias("__head")).where(~F.col("__head"))
    gone = told(lasting(gone.select("__id"), "near-gone"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__id"]), "left_anti")

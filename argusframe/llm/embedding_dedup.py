"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking by cosine.

A vector's code has one word of balanced bits for each of some learned rotations. Words are cut into segments, each
the index of one table; a vector probes each table with the Hamming ball of ``radius`` around its segment. Segments
get longer with the logarithm of the number of vectors, so that a bucket holds a few chance members at any size, and
there are as many of them as pairs right at the threshold need to be found, by measurement on such pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ._common import connected_components, join_weighted, lasting, stored, temporary, tidy


@dataclass
class Codes:
    """``bits`` balanced bits a vector: which side of ``median`` each rotated principal component lies."""

    mean: np.ndarray
    rotation: np.ndarray  # dim x bits
    median: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Boolean rows."""
        return (x - self.mean) @ self.rotation > self.median


def fit_codes(x: np.ndarray, bits: int, rounds: int = 50, seed: int = 11) -> Codes:
    """Iterative quantisation (Gong and Lazebnik): principal components, then the rotation that brings them
    closest to the corners of a cube, by turns of rounding to signs and the orthogonal Procrustes problem.
    The sign of each component is taken against its median, so each bit parts the sample in halves.
    """
    mean = x.mean(0)
    z = x - mean
    _, vectors = np.linalg.eigh(z.T @ z)
    top = vectors[:, ::-1][:, :bits]
    v = z @ top
    k = top.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    rotation = top @ r
    return Codes(mean, rotation, np.median(z @ rotation, axis=0))


def usable(vector: F.Column) -> F.Column:
    """Vectors that can be compared: not null, without null or non-finite components, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(vector, lambda v: v != 0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def _unit(rows) -> np.ndarray:
    """Unit rows, in double, of lists of equal length or of an Arrow column of such."""
    if isinstance(rows, (pa.Array, pa.ChunkedArray)):
        n = len(rows)
        flat = rows.combine_chunks().flatten() if isinstance(rows, pa.ChunkedArray) else rows.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    else:
        x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def _stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what ``linked`` (rows x columns) connects, one a node."""
    r, c = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(r):
        return left[:0], left[:0]
    m = linked[np.ix_(r, c)]
    rows, cols = left[r].astype(np.float64), np.full(len(c), np.inf)
    while True:
        new_cols = np.where(m, rows[:, None], np.inf).min(0)
        new_rows = np.minimum(rows, np.where(m, new_cols[None, :], np.inf).min(1))
        if (new_rows == rows).all() and (new_cols == cols).all():
            break
        rows, cols = new_rows, new_cols
    head = {float(x): x for x in left[r]}
    a = np.concatenate([left[r], right[c]])
    return a, np.array([head[x] for x in np.concatenate([rows, cols])], dtype=left.dtype)


@dataclass
class Plan:
    """The code and its tables: ``words[k]`` codes word k, table t reads ``width`` bits of word ``t // each`` from
    ``(t % each) * width`` on. Codes of pairs at the threshold differ in ``most`` bits of the first two words or fewer,
    but for one in some ten thousand; ``recall`` is the share of such pairs that meet in a table."""

    words: list[Codes]
    width: int
    each: int
    tables: int
    radius: int
    most: int
    recall: float

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n x words) of 64-bit codes."""
        out = np.zeros((len(x), len(self.words)), dtype=np.uint64)
        for k, c in enumerate(self.words):
            flags = c.encode(x)
            out[:, k] = (flags.astype(np.uint64) << np.arange(flags.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def place(self, t: int) -> tuple[int, int]:
        return t // self.each, (t % self.each) * self.width

    def meets(self, differ: np.ndarray, t: int) -> np.ndarray:
        """Where table t finds a pair, of codes that differ by ``differ`` (.. x words)."""
        k, shift = self.place(t)
        return np.bitwise_count((differ[..., k] >> np.uint64(shift)) & np.uint64((1 << self.width) - 1)) <= self.radius

    def near(self, differ: np.ndarray) -> np.ndarray:
        return np.bitwise_count(differ[..., :2]).sum(-1) <= self.most


MOST_TABLES = 62  # a table is a bit of a long


def fit_plan(x: np.ndarray, n: int, cosine: float, recall: float, radius: int = 1, seed: int = 11) -> Plan:
    """The narrowest change of size that finds a share of ``recall`` of pairs right at ``cosine``.

    ``x`` are unit rows of a sample, ``n`` says how many vectors there are. The pairs are rows of ``x`` and what lies at the
    threshold's angle from them in a random direction. Segments start at two bits less than the logarithm of ``n``; they
    get shorter where ``MOST_TABLES`` tables don't do. At the shortest, every pair meets.
    """
    dim, rng = x.shape[1], np.random.default_rng(seed)
    base = x[rng.integers(len(x), size=4000)]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    other = cosine * base + np.sqrt(max(0.0, 1 - cosine * cosine)) * noise / np.where(size < 1e-12, 1, size)
    bits = min(64, dim)
    words: list[Codes] = []
    differ = np.zeros((len(base), 0), dtype=np.uint64)
    width = max(1, min(bits, int(np.ceil(np.log2(max(2, n)))) - 2))
    while True:
        each, found, plan = bits // width, np.zeros(len(base), dtype=bool), None
        for t in range(MOST_TABLES):
            if t // each >= len(words):
                words.append(fit_codes(x, bits, seed=seed + len(words)))
                one = Plan(words[-1:], width, each, 1, radius, 0, 0.0)
                differ = np.hstack([differ, one.encode(base) ^ one.encode(other)])
            plan = Plan(words, width, each, t + 1, min(radius, width), 0, 0.0)
            found |= plan.meets(differ, t)
            if found.mean() >= recall:
                break
        if found.mean() >= recall or width == 1:
            break
        width -= 1
    used = words[: (plan.tables - 1) // plan.each + 1]
    off = np.bitwise_count(differ[:, : min(2, len(used))]).sum(1)
    most = int(np.ceil(max(off.max(), off.mean() + 4 * off.std())))
    return Plan(used, plan.width, plan.each, plan.tables, plan.radius, most, float(found.mean()))


def _links(reps: DataFrame, cosine: float, recall: float, radius: int, sample: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``(rep, n)``, links of each representative in parts to be summed, and ``(a, b)`` edges for components."""
    spark = reps.sparkSession
    first = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    plan = fit_plan(_unit(first["v"].tolist()), reps.count(), cosine, recall, radius)
    width, tables, radius, most = plan.width, plan.tables, plan.radius, plan.most
    coder = spark.sparkContext.broadcast(plan)
    code = [f"c{k}" for k in range(len(plan.words))]
    sieve = code[:2]

    def encode(batches):
        for b in batches:
            if b.num_rows:
                words = coder.value.encode(_unit(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(words[:, k].copy().view(np.int64)) for k in range(len(code)))], ["rep", "v", "members", *code])

    coded = stored(reps.mapInArrow(tidy(encode), "rep long, v array<double>, members long, " + ", ".join(f"{c} long" for c in code)), "vector-codes")

    def segment(t: int) -> F.Column:
        k, shift = plan.place(t)
        return F.shiftrightunsigned(code[k], shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col(code[k])

    table = coded.select("rep", *sieve, F.posexplode(F.array(*[segment(t) for t in range(tables)])).alias("t", "val"))
    big = table.groupBy("t", "val").agg(F.count("*").alias("size")).where(F.col("size") > block)
    big = stored(big, "vector-crowded")
    crowded = not big.isEmpty()
    few, hot = table, None
    if crowded:  # at most tables * n / block rows
        few = table.join(big.select("t", "val"), ["t", "val"], "left_anti")
        hot = join_weighted(table.select("rep", "t", "val"), big, ["t", "val"], "size")
        hot = hot.groupBy("rep").agg(F.sum(F.expr("shiftleft(1L, t)")).alias("hot"))
        coded = stored(coded.join(hot, "rep", "left").withColumn("hot", F.coalesce("hot", F.lit(0).cast("long"))), "vector-codes")
    else:
        coded = coded.withColumn("hot", F.lit(0).cast("long"))
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
    ball = F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m)))
    apart = " + ".join(f"bit_count(a_{c} ^ b_{c})" for c in sieve)
    as_ = lambda x: [F.col("rep").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in sieve)]
    pairs = (
        few.select("t", F.col("val").alias("own"), *as_("a")).withColumn("val", ball).where("own <= val")
        .join(few.select("t", "val", *as_("b")), ["t", "val"])
        .where(f"(own < val or a < b) and {apart} <= {most}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    pairs = stored(pairs, "vector-pairs")
    whole = ["rep", "v", "members", "hot", *code]
    side = lambda x: coded.select(*[F.col(c).alias(x if c == "rep" else f"{x}_{c}") for c in whole])
    sides = [f"{x}_{c}" for x in "ab" for c in whole[1:]]

    def words_in(b: pa.RecordBatch, x: str) -> np.ndarray:
        return np.stack([b.column(f"{x}{c}").to_numpy() for c in code], axis=1).view(np.uint64)

    def judge(batches):
        """Pairs at the threshold that no crowded bucket's comparison finds as well."""
        for b in batches:
            if not b.num_rows:
                continue
            close = (_unit(b.column("a_v")) * _unit(b.column("b_v"))).sum(1) >= cosine
            crowd = b.column("a_hot").to_numpy() | b.column("b_hot").to_numpy()
            if crowd.any():
                differ = words_in(b, "a_") ^ words_in(b, "b_")
                for t in range(tables):
                    close &= ~(((crowd >> t) & 1).astype(bool) & coder.value.meets(differ, t))
            yield b.select(["a", "b", "a_members", "b_members"]).filter(pa.array(close))

    linked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *sides)
    linked = stored(linked.mapInArrow(tidy(judge), "a long, b long, a_members long, b_members long"), "vector-links")
    ends = F.array(F.struct(F.col("a").alias("rep"), F.col("b_members").alias("n")), F.struct(F.col("b").alias("rep"), F.col("a_members").alias("n")))
    degrees = linked.select(F.explode(ends).alias("x")).select("x.*")
    edges = linked.select("a", "b")
    if not crowded:
        return degrees, edges

    # pairs of buckets of which one at least is crowded, each once, in blocks
    near = big.select("t", F.col("val").alias("own"), F.col("size").alias("own_size")).withColumn("val", ball)
    sizes = table.join(near.select("t", "val").distinct(), ["t", "val"], "left_semi").groupBy("t", "val").agg(F.count("*").alias("size"))
    near = near.join(sizes, ["t", "val"]).select(
        "t", F.least("own", "val").alias("x"), F.greatest("own", "val").alias("y"),
        F.when(F.col("own") <= F.col("val"), F.col("own_size")).otherwise(F.col("size")).alias("x_size"),
        F.when(F.col("own") <= F.col("val"), F.col("size")).otherwise(F.col("own_size")).alias("y_size"),
    ).distinct()
    near = stored(near, "vector-near")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    units = near.withColumn("i", F.explode(F.sequence(F.lit(0), blocks("x_size") - 1))).withColumn(
        "j", F.explode(F.sequence(F.when(F.col("x") == F.col("y"), F.col("i")).otherwise(0), blocks("y_size") - 1))
    )
    units = stored(units, "vector-units")
    ours = near.select("t", F.col("x").alias("val"), F.col("x_size").alias("size")).unionByName(near.select("t", F.col("y").alias("val"), F.col("y_size").alias("size"))).distinct()
    dealt = join_weighted(table.select("rep", "t", "val"), stored(ours, "vector-dealt"), ["t", "val"], "size")
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("rep"), blocks("size").cast("long")).cast("int")).select("t", "val", "blk", "rep")
    left = units.select("t", F.col("x").alias("val"), F.col("i").alias("blk"), "x", "y", "i", "j", F.lit(0).alias("side"))
    right = units.where("x != y or i != j").select("t", F.col("y").alias("val"), F.col("j").alias("blk"), "x", "y", "i", "j", F.lit(1).alias("side"))
    rows = left.unionByName(right).join(dealt, ["t", "val", "blk"]).join(coded, "rep").select("t", "x", "y", "i", "j", "side", *whole)

    def compare(group: pa.Table) -> pa.Table:
        t, x, y, i, j = (group.column(k)[0].as_py() for k in range(5))
        one = x == y and i == j
        which = group.column("side").to_numpy()
        rep, hot, n = (group.column(c).to_numpy() for c in ("rep", "hot", "members"))
        words = np.stack([group.column(c).to_numpy() for c in code], axis=1).view(np.uint64)
        unit = _unit(group.column("v"))
        p, q = np.flatnonzero(which == 0), np.flatnonzero(which == (0 if one else 1))
        out = {"a": [], "b": [], "n": []}
        if len(p) and len(q):
            close = unit[p] @ unit[q].T >= cosine
            at = np.nonzero(close)
            differ = words[p[at[0]]] ^ words[q[at[1]]]
            good = coder.value.near(differ)
            crowd = hot[p[at[0]]] | hot[q[at[1]]]
            for s in range(t):  # an earlier crowded table's
                good &= ~(((crowd >> s) & 1).astype(bool) & coder.value.meets(differ, s))
            close[at] = good
            if one:
                np.fill_diagonal(close, False)
            out["a"].append(rep[p]), out["b"].append(rep[p]), out["n"].append(close @ n[q])
            if not one:
                out["a"].append(rep[q]), out["b"].append(rep[q]), out["n"].append(close.T @ n[p])
            a, b = _stars(close, rep[p], rep[q])
            out["a"].append(a), out["b"].append(b), out["n"].append(np.zeros(len(a), np.int64))
        cat = lambda c: np.concatenate(out[c]).astype(np.int64) if out[c] else np.zeros(0, np.int64)
        a, b, n = cat("a"), cat("b"), cat("n")
        keep = (n > 0) | (a != b)
        return pa.table({"a": a[keep], "b": b[keep], "n": n[keep]})

    crowd = stored(rows.groupBy("t", "x", "y", "i", "j").applyInArrow(compare, "a long, b long, n long"), "vector-crowds")
    return (
        degrees.unionByName(crowd.where("n > 0").select(F.col("a").alias("rep"), "n")),
        edges.unionByName(crowd.where("a != b").select("a", "b")),
    )


def _groups(good: DataFrame, cosine: float, recall: float, radius: int, sample: int, block: int) -> DataFrame | None:
    """``(id, n_links, component_id)`` of the vectors ``good(id, v, dim)``; None where there is none."""
    reps = stored(
        good.groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "vectors"
    )
    several = join_weighted(good, reps.where("members > 1"), ["dim", "v"], "members").select("id", "rep")
    members = stored(reps.where("members = 1").select(F.col("rep").alias("id"), "rep").unionByName(several), "vector-members")
    dims = [r["dim"] for r in reps.select("dim").distinct().collect()]
    degrees, edges = None, None
    for dim in dims:
        n, e = _links(reps.where(F.col("dim") == dim).select("rep", "v", "members"), cosine, recall, radius, sample, block)
        degrees = n if degrees is None else degrees.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    if degrees is None:
        return None
    comps = connected_components(edges)
    degree = degrees.groupBy("rep").agg(F.sum("n").alias("n"))
    per = (
        reps.select("rep", "members").join(degree, "rep", "left")
        .join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", "members", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    per = per.groupBy("rep").agg(F.sum("members").alias("members"), F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    of_id = join_weighted(members, stored(per, "vector-results"), ["rep"], "members")
    return of_id.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))


def embedding_groups(
    vectors: DataFrame, cosine: float = 0.9, recall: float = 0.999, radius: int = 1, sample: int = 20_000,
    block: int = 512, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """One row a row of ``vectors``: ``<id_col>, n_links, component_id, kept``.

    ``n_links`` counts the other vectors found with a cosine of ``cosine`` or more, in double precision;
    ``component_id`` is the smallest id reachable. Null, zero and non-finite vectors, and vectors with such
    components, link with nothing; so do vectors of different lengths. Ids are whole numbers; of other types they
    raise a TypeError. Null ids are returned with no links and a null component, and link with nothing. Rows that
    repeat an id are one vector each while counting, and share its component. An empty table gives none. Other
    columns, labels among them, are not read.

    The rotations are learned on at most ``sample`` vectors, those of least id hash; every vector is coded and
    indexed. Equal vectors are one representative with its members. The plan (see ``fit_plan``) sets the tables
    so that a share of ``recall`` of pairs right at the threshold meets in one; closer pairs meet more often. What meets and
    differs in no more bits than pairs at the threshold do is judged by the original vectors. Buckets of more
    than ``block`` vectors are not paired: they are dealt in blocks, and a pair of blocks, the unit of work, gives
    a count for each vector and a star for each of its components, by the same two rules, so which links are found doesn't
    depend on a bucket's size. A pair counts once, in the first crowded table that finds it or else outside of them.
    """
    if not isinstance(vectors.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    kind = vectors.schema[id_col].dataType
    with temporary(vectors.sparkSession):
        of_id = _groups(good, cosine, recall, radius, sample, block)
        of_id = of_id if of_id is None else lasting(of_id, "vector-groups")
    if of_id is None:
        return rows.select(
            F.col("id").cast(kind).alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")
        )
    out = rows.select("id").join(of_id, "id", "left")
    return out.select(
        F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )

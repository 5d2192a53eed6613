"""Exact dedup by skew-safe combining of digest groups, with the full content compared at every stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored


def text_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def text_check(text: Column) -> Column:
    """A second, independent digest; with the first it addresses a group without its text."""
    return F.concat_ws(":", F.xxhash64(text), F.octet_length(text))


def winners(
    rows: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = text_digest
) -> DataFrame:
    """``rows(id, text)`` -> one row a distinct text: ``digest, text, keep_id, group_size``.

    1. local: the partial aggregate of each map task merges equal ``(digest, salt, text)``;
    2. salted: the rows of a group meet in ``salts`` tasks, not in one;
    3. global: the at most ``salts`` winners of a text are combined.
    ``text`` is part of the key in each step, so texts that merely share a digest never merge.
    """
    salted = (
        rows.withColumn("digest", digest(F.col("text")))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = text_digest,
    check: Callable[[Column], Column] = text_check,
) -> DataFrame:
    """One row a document: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; of equal texts the row with the largest id is kept.
    Null text counts as empty. A null id counts in ``group_size`` and is kept only where its whole group
    has null ids (``keep_id`` is then null). Rows that repeat the winning id are all marked kept. Other
    columns of ``docs``, whatever their names, are neither read nor returned. Empty input, empty result.

    A document finds its group by ``(digest, check)``; where two texts share both (checked over all
    groups), documents are joined on the text itself instead.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    groups = winners(rows, salts, digest)
    slim = stored(
        groups.select("digest", check(F.col("text")).alias("check"), "keep_id", "group_size"), "text-groups"
    )
    shared = slim.groupBy("digest", "check").agg(F.count("*").alias("n")).where("n > 1")
    members = rows.select(
        "id", digest(F.col("text")).alias("digest"), check(F.col("text")).alias("check"),
        F.sha2("text", 256).alias("text_sha256"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "text",
    )
    if shared.isEmpty():
        keys, side, members = ["digest", "check", "salt"], slim, members.drop("text")
    else:
        keys, side = ["digest", "text", "salt"], groups
    # a copy's group is looked up in the salt that the copy is in, so that no group meets in one task
    side = side.where("group_size > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    out = members.join(side.select(*keys, "keep_id", "group_size"), keys, "left")
    single = F.col("group_size").isNull()
    out = out.withColumn("keep_id", F.when(single, F.col("id")).otherwise(F.col("keep_id")))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns, one row for each distinct text: the row with the largest id.

    Rows that repeat the winning id and its text all stay. What is dropped, usually the smaller part, is
    looked up by id and digest.
    """
    found = exact_dedup(docs, id_col, text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    same = docs[id_col].eqNullSafe(gone["__id"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == gone["__sha"])
    return docs.join(gone, same, "left_anti")

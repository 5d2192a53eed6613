"""Labelled rows for the classifiers: the held-out rule and a bounded, repeatable training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id's decimal text leaves no rest by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 25
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Some (text, label) rows of each class 0 and 1, and how many labelled rows each class has.

    Rows are those not held out, taken by the hash of their id, so the sample is the same on every run: at most
    ``per_class`` documents of a class, of which those that no longer fit into ``most_bytes`` of text are passed
    over, so neither many nor very long documents are too much for the driver. Ids are chosen from the labels
    alone, then by their texts' sizes; just the chosen texts are fetched, in the order of the hash. A document with
    several labels counts as 1 if any of them is; null labels and ids are passed over, of rows that repeat an
    id each different text counts, and no more than twice ``per_class`` of them a class.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked: list = []
    for y in (0, 1):
        picked += known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()
    if not picked:
        return [], sizes
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = spark.createDataFrame([(r["id"], r["y"], i) for i, r in enumerate(picked)], f"id {kind}, y int, place int")
    # at most 2 * per_class rows of ids, and what they are in the documents: sizes now, texts of those that fit later
    looks = rows.join(F.broadcast(chosen), "id").select("place", "y", F.octet_length("text").alias("size"), F.xxhash64("text").alias("mark"))
    found = looks.distinct().orderBy("place", "mark").limit(4 * per_class).collect()
    fits, used = [], {0: 0, 1: 0}
    for r in found:
        if used[r["y"]] + r["size"] <= most_bytes:
            used[r["y"]] += r["size"]
            fits.append((picked[r["place"]]["id"], r["mark"], r["y"], r["place"]))
    if not fits:
        return [], sizes
    wanted = spark.createDataFrame(fits, f"id {kind}, mark long, y int, place int")
    texts = rows.join(F.broadcast(wanted), "id").where(F.xxhash64("text") == F.col("mark")).select("place", "mark", "text", "y").distinct().collect()
    return [(r["text"], r["y"]) for r in sorted(texts, key=lambda r: (r["place"], r["mark"]))], sizes

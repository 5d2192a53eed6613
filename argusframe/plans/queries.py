"""One query for each operator, over the stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vec
from ..operators import anomaly, appearance, boxes, evaluate, memory, metrics, pairs, search, tracks
from ..operators.binding import BinderConfig
from ..operators.tracking import TrackerConfig
from ..streaming.tracking import session_tracks as session
from .standins import blocks, detections, observations, sightings, table, truth_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HALF_DAY = 12 * 3_600_000_000  # microseconds: longer than that unseen, and a track ends


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# -- search ------------------------------------------------------------------------------------------------


@query
def knn_topk(spark, d):
    """The five nearest others of every observation."""
    o = observations(spark, d)
    return search.top_k(o.select(F.col("item_id").alias("query_id"), "vec"), o.select("item_id", "vec"), 5, exclude_self=True)


def _identity_queries(spark, d) -> tuple[DataFrame, DataFrame]:
    o = observations(spark, d)
    q = o.select(F.col("item_id").alias("query_id"), "vec")
    return q, o.select("item_id", F.col("person").alias("identity_id"), "vec")


@query
def identity_topk(spark, d):
    """The three identities whose best exemplar is nearest."""
    return search.identity_top_k(*_identity_queries(spark, d), 3)


@query
def similar_then_label(spark, d):
    """Top five identities, of which those of even label stay: the filter comes after the cut."""
    ids = spark.range(0, 10).select(F.col("id").alias("identity_id"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"))
    return search.of_label(search.identity_top_k(*_identity_queries(spark, d), 5), ids, "even").select("query_id", "rank", "identity_id", "score")


@query
def semantic_find_floor(spark, d):
    """Prototypes as the index of descriptions: top four by cosine, of which those of 0.02 or more."""
    o = observations(spark, d)
    index = memory.prototypes(o.select("item_id", F.col("person").alias("identity_id"), "vec")).select(F.col("identity_id").alias("item_id"), F.col("v").alias("vec"))
    q = o.select(F.col("item_id").alias("query_id"), "vec")
    found = search.at_least(search.top_k(q, index, 4), 0.02)
    return found.select("query_id", "rank", F.col("item_id").alias("identity_id"), "score")


# -- memory ------------------------------------------------------------------------------------------------


def _exemplars(spark, d) -> DataFrame:
    return observations(spark, d).select("item_id", F.col("person").alias("identity_id"), "vec")


def _long(df: DataFrame, key: str, v: str) -> DataFrame:
    return df.select(key, F.posexplode(v).alias("pos", "v")).select(key, (F.col("pos") + 1).cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query
def identity_prototype(spark, d):
    return _long(memory.prototypes(_exemplars(spark, d)), "identity_id", "v")


def _stored_half(spark, d):
    e = _exemplars(spark, d).where("item_id % 2 = 0")
    facts = e.groupBy("identity_id").agg(F.min("item_id").cast("double").alias("first_seen"), F.max("item_id").cast("double").alias("last_seen"), F.count("*").alias("appearances"))
    ids = facts.join(memory.prototypes(e).select("identity_id", F.col("v").alias("prototype")), "identity_id").withColumn("label", F.lit("person"))
    return ids.select("identity_id", "label", "first_seen", "last_seen", "appearances", "prototype"), e


@query
def prototype_fold(spark, d):
    """Even items are stored, odd ones are remembered: the folded prototype and the extended record."""
    ids, e = _stored_half(spark, d)
    new = _exemplars(spark, d).where("item_id % 2 = 1").groupBy("identity_id").agg(
        F.lit("person").alias("label"), F.min("item_id").cast("double").alias("first_seen"), F.max("item_id").cast("double").alias("last_seen"),
        F.count("*").alias("appearances"), F.transform(F.array_sort(F.collect_list(F.struct("item_id", "vec"))), lambda s: s["vec"]).alias("vecs"),
    )
    folded, _ = memory.remember(ids, e, new, 20)
    return folded.select("identity_id", "first_seen", "last_seen", "appearances", F.posexplode("prototype").alias("pos", "v")).select(
        "identity_id", "first_seen", "last_seen", "appearances", (F.col("pos") + 1).cast("long").alias("pos"), F.round("v", 6).alias("v")
    )


@query
def prototype_merge(spark, d):
    """Each odd identity is merged into the even one before it."""
    ids, e = _stored_half(spark, d)
    merges = spark.range(0, 5).select((F.col("id") * 2).alias("keep_id"), (F.col("id") * 2 + 1).alias("absorb_id"))
    merged, _ = memory.merge(ids, e, merges, 20)
    return merged.select("identity_id", "first_seen", "last_seen", "appearances", F.posexplode("prototype").alias("pos", "v")).select(
        "identity_id", "first_seen", "last_seen", "appearances", (F.col("pos") + 1).cast("long").alias("pos"), F.round("v", 6).alias("v")
    )


@query
def diverse_exemplars(spark, d):
    """The five most spread observations of each person."""
    return memory.select_diverse(_exemplars(spark, d), 5).select("identity_id", "place", "item_id")


@query
def touch_identities(spark, d):
    ids, _ = _stored_half(spark, d)
    seen = _exemplars(spark, d).where("item_id % 5 = 1").select("identity_id", F.col("item_id").cast("double").alias("when"))
    return memory.touch(ids, seen).select("identity_id", "first_seen", "last_seen")


@query
def semantic_upsert(spark, d):
    """An index of customers' balances in which those of segment BUILDING are described again."""
    c = table(spark, d, "customer")
    index = c.select(F.col("c_custkey").alias("identity_id"), F.col("c_acctbal").alias("v"))
    new = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("identity_id"), (F.col("c_acctbal") + 1).alias("v"))
    return _r(memory.upsert(index, new), "v")


@query
def store_integrity(spark, d):
    """Events without a customer record and customers without events."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("identity_id"))
    e = table(spark, d, "events").select(F.col("event_id").alias("item_id"), (F.col("user_id") * 11).alias("identity_id"))
    return memory.integrity(ids, e)


@query
def backfill_pending(spark, d):
    """Customers not described yet (no pending order) who have a thumbnail (a positive balance)."""
    c = table(spark, d, "customer")
    ids = c.select(F.col("c_custkey").alias("identity_id"))
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("identity_id"))
    return memory.pending(ids, done, c.where("c_acctbal > 0").select(F.col("c_custkey").alias("identity_id")))


@query
def largest_crop(spark, d):
    """The largest order of each customer, the earliest on ties."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("area"))
    return memory.largest(o, "o_custkey", "area", "o_orderkey")


@query
def identity_counts(spark, d):
    """How many identities and exemplars there are, and the most that one has."""
    e = _exemplars(spark, d)
    return memory.identity_counts(e.select("identity_id").distinct(), e)


@query
def still_known(spark, d):
    """Found ids of which some no longer exist: they go after the cut."""
    q, e = _identity_queries(spark, d)
    ids = e.select("identity_id").distinct().where("identity_id % 3 != 0")
    return search.still_known(search.identity_top_k(q, e, 4), ids).select("query_id", "rank", "identity_id", "score")


@query
def describable(spark, d):
    """The first box of each order's part that is large enough to be described, of those with none yet."""
    b = detections(spark, d).select(
        (F.col("frame") % 5000).alias("identity_id"), "frame", "x1", "y1", "x2", (F.col("y2") + F.col("det_idx") * 8).alias("y2"), (F.col("det_idx") % 2).alias("time_since_update")
    )
    done = spark.range(0, 100).select(F.col("id").alias("identity_id"))
    return memory.describable(b, done, 10.0, 32.0).select("identity_id", "frame")


# -- pairs -------------------------------------------------------------------------------------------------


@query
def positive_pairs(spark, d):
    return pairs.positive_pairs(blocks(spark, d), 2)


@query
def labelled_positives(spark, d):
    o = blocks(spark, d).withColumn("sequence", F.floor(F.col("item_id") / 50).cast("long"))
    return pairs.labelled_positives(o, 20)


@query
def coalive_tracks(spark, d):
    """Pairs of tracks that were alive together, met in bins of fifty frames."""
    return pairs.coalive_tracks(pairs.spans(blocks(spark, d), "track"), width=50)


@query
def negative_pairs(spark, d):
    """Pairs of observations of such tracks."""
    return pairs.negative_pairs(blocks(spark, d))


@query
def hard_negatives(spark, d):
    """The three most similar observations of others in the sequence."""
    o = blocks(spark, d).withColumn("sequence", F.floor(F.col("item_id") / 50))
    a = o.select("sequence", "person", F.col("item_id").alias("a"), "vec")
    return pairs.hard_negatives(a, o.select("sequence", "person", "item_id", "vec"), 3)


def _paired(spark, d) -> DataFrame:
    o = observations(spark, d)
    p = pairs.positive_pairs(blocks(spark, d), 2)
    return p.join(o.select(F.col("item_id").alias("a"), F.col("vec").alias("va"), F.col("track").alias("owner_a")), "a").join(
        o.select(F.col("item_id").alias("b"), F.col("vec").alias("vb"), F.col("track").alias("owner_b")), "b"
    )


@query
def pair_features(spark, d):
    f = vec.pair_features(F.col("va"), F.col("vb"))
    return _paired(spark, d).select("a", "b", *[F.round(c, 6).alias(n) for n, c in f.items()])


@query
def product_features(spark, d):
    """The pair network's input over the first eight components, as its sum and length."""
    f = vec.product_features(F.col("va"), F.col("vb"), 8)
    return _paired(spark, d).select("a", "b", F.size(f).cast("long").alias("width"), F.round(F.aggregate(f, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query
def group_split_pairs(spark, d):
    """Owners go to one side whole; pairs across are dropped."""
    return pairs.split_by_owner(_paired(spark, d), F.col("owner") % 10 < 3).select("a", "b", "owner_a", "owner_b", "side")


@query
def balanced_classes(spark, d):
    """How many of each class are left when the classes are made equal."""
    t = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return pairs.balance(t, "y", "doc_id").groupBy("y").agg(F.count("*").alias("n"))


@query
def split_overlap(spark, d):
    """Customers on both sides of a split of the orders: what the guard refuses."""
    o = table(spark, d, "orders")
    return o.where("o_orderkey % 3 = 0").select("o_custkey").intersect(o.where("o_orderkey % 3 != 0").select("o_custkey"))


# -- thresholds and measures -------------------------------------------------------------------------------


@query
def auroc_metric(spark, d):
    return _r(metrics.auroc(truth_scores(spark, d)), "auroc", digits=9)


@query
def trapezoid_auroc(spark, d):
    return _r(metrics.trapezoid_auroc(truth_scores(spark, d)), "auroc", digits=9)


@query
def youden_threshold(spark, d):
    return metrics.youden_threshold(truth_scores(spark, d))


@query
def false_merge_boundary(spark, d):
    return metrics.false_merge_cut(truth_scores(spark, d), 0.05)


@query
def confusion_rates(spark, d):
    return _r(metrics.confusion(truth_scores(spark, d), 1500.0), "accuracy", "tpr", "tnr")


@query
def threshold_sweep(spark, d):
    """Rates at three boundaries, from one pass: the thresholds are a table."""
    at = spark.createDataFrame([(500.0,), (1500.0,), (3000.0,)], "threshold double")
    rows = truth_scores(spark, d).join(F.broadcast(at))
    up, y = F.col("score") >= F.col("threshold"), F.col("y") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = rows.groupBy("threshold").agg(n(up & y).alias("tp"), n(up & ~y).alias("fp"), n(y).alias("p"), n(~y).alias("n"))
    return t.select("threshold", F.round(F.col("tp") / F.col("p"), 6).alias("tpr"), F.round(F.col("fp") / F.col("n"), 6).alias("fpr"))


@query
def score_summary(spark, d):
    return _r(metrics.quantiles(truth_scores(spark, d), "score", [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1], "y"), *[f"q{q}" for q in (0, 5, 25, 50, 75, 95, 100)])


@query
def identity_score_quantile(spark, d):
    """Late halves of tracks against the early halves of all: best exemplar, then the 0.75 quantile."""
    cut = metrics.halves(observations(spark, d))
    early = cut.where(~F.col("late")).select(F.col("track").alias("identity_id"), "vec")
    return _r(metrics.identity_scores(cut.where("late"), early, None, 0.75), "score", digits=8)


@query
def calibration_scores(spark, d):
    """The scores that the identity boundary is fitted on."""
    return _r(metrics.calibration_scores(blocks(spark, d), 0.75), "score", digits=8)


@query
def calibrated_boundary(spark, d):
    """The boundary that at most one in twenty different pairs of tracks lies above, rounded."""
    scored = metrics.calibration_scores(blocks(spark, d), 0.75).withColumn("score", F.round("score", 8))
    return metrics.false_merge_cut(scored, 0.05)


@query
def real_returns(spark, d):
    return metrics.real_returns(blocks(spark, d))


@query
def retrieval_rank_map(spark, d):
    return _r(metrics.retrieval(observations(spark, d)), "rank1", "rank5", "rank10", "map")


@query
def mean_similarity(spark, d):
    """Mean and median cosine of all pairs of one person's observations."""
    return _r(_r(metrics.pair_similarity(observations(spark, d)), "mean"), "median", digits=8)


@query
def class_means(spark, d):
    """The mean score of good and of bad documents."""
    return _r(metrics.class_means(truth_scores(spark, d)), "mean")


@query
def return_scores(spark, d):
    """Each person's last track against the stored first tracks of all."""
    return _r(metrics.returned_scores(blocks(spark, d), 0.75), "score", digits=8)


@query
def auroc_undefined(spark, d):
    """A class is missing: no AUROC, rather than one half."""
    return metrics.auroc(truth_scores(spark, d).where("y = 1"), None)


@query
def mined_pairs(spark, d):
    """The pairs mined for a verifier: how many of each class, and that owners are as they must be."""
    p = pairs.mine_pairs(blocks(spark, d), 2, 10)
    owners = F.avg((F.col("owner_a") == F.col("owner_b")).cast("double"))
    return p.groupBy("y").agg((F.count("*") == F.count_distinct("a", "b")).alias("different"), owners.alias("one_owner"))


# -- boxes and sightings -----------------------------------------------------------------------------------


@query
def iou_pairs(spark, d):
    """Pairs of boxes in a frame that overlap, and how far their centres are apart."""
    x = detections(spark, d).select("frame", "det_idx", "x1", "y1", "x2", "y2")
    p = boxes.frame_pairs(x, x, ("frame",)).where("a_det_idx < b_det_idx and iou > 0")
    return p.select("frame", "a_det_idx", "b_det_idx", F.round("iou", 6).alias("iou"), F.round("distance", 6).alias("distance"))


@query
def contested_detections(spark, d):
    """Even boxes that lie over 0.2 in two odd ones or more."""
    x = detections(spark, d).select("frame", "det_idx", "x1", "y1", "x2", "y2")
    return boxes.contested(x.where("det_idx % 2 = 0"), x.where("det_idx % 2 = 1"), 0.2, ("frame",))


@query
def gt_attribution(spark, d):
    """Even boxes are detections, odd ones the truth."""
    x = detections(spark, d).select("frame", "det_idx", "x1", "y1", "x2", "y2")
    truth = x.where("det_idx % 2 = 1").withColumnRenamed("det_idx", "id")
    return _r(boxes.attribute(x.where("det_idx % 2 = 0"), truth, 0.3, ("frame",)), "iou")


@query
def nms_per_frame(spark, d):
    return boxes.nms(detections(spark, d), 0.3, ("frame",))


@query
def crop_geometry(spark, d):
    """The pixel region of each box in a frame of 55 by 15, its upper half; unusable below 4 pixels."""
    x = detections(spark, d)
    c = g.crop_region(g.Box.of(), 55, 15, 0.5, 4)
    return x.select("frame", "det_idx", *[v.cast("long").alias(k) if k != "usable" else v.alias(k) for k, v in c.items()])


@query
def decoded_boxes(spark, d):
    """Raw predictions (centre, size, class scores) to boxes of the frame, without the padding."""
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("row"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("cx"), (F.col("l_discount") * 100).alias("cy"), F.lit(8.0).alias("w"), F.lit(4.0).alias("h"),
        F.array("l_discount", "l_tax", F.lit(0.05)).alias("scores"), F.lit(0.5).alias("scale"), F.lit(2.0).alias("pad_x"), F.lit(1.0).alias("pad_y"),
    )
    out = boxes.decode_predictions(x, 0.06, [0, 1])
    return out.select("frame", "row", "part", "supp", F.round("score", 6).alias("score"), F.col("class_id").cast("long").alias("class_id"), *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def training_label_lines(spark, d):
    """Boxes as label lines, relative to a frame of 60 by 20."""
    from ..sources.sequences import training_labels

    t = detections(spark, d).select(F.lit("s").alias("seq"), "frame", F.col("det_idx").alias("id"), "x1", "y1", "x2", "y2", (F.col("det_idx") / 7).alias("visibility"))
    return training_labels(t, spark.createDataFrame([("s", 60, 20)], "seq string, width int, height int"), 0, 0.2).select("frame", "id", "line")


@query
def embedding_schedule(spark, d):
    """Which of an object's sightings are encoded: the first and every fifth."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    s = sightings(spark, d).withColumn("hits", F.row_number().over(w))
    s = appearance.worth_encoding(s.withColumnRenamed("value", "score"), 20.0)
    return s.where(g.should_embed(F.col("hits"), 5)).select("event_id", "user_id", F.col("hits").cast("long").alias("hits"))


def _lives(spark, d) -> DataFrame:
    return boxes.lifecycle(sightings(spark, d), "user_id", "us", HALF_DAY, "event_id", 3)


@query
def track_lifecycle(spark, d):
    """Sightings of an object within half a day are one track."""
    return _lives(spark, d)


@query
def coalive_spans(spark, d):
    """With how many others each track was alive, at closed ends and strictly, in frames of an hour."""
    hour = lambda c: F.floor(F.col(c) / 3_600_000_000).cast("long")
    t = _lives(spark, d).select((F.col("user_id") * 100_000 + F.col("island")).alias("track"), hour("first").alias("first"), hour("last").alias("last"))
    return boxes.coalive_counts(t)


@query
def session_tracks(spark, d):
    """Sessions of sightings: the same lifecycle as a stream's operator gives."""
    s = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    t = session(s, "user_id", "t", "12 hours", "1 day")
    return t.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("ends").alias("ends"), "hits")


@query
def continuity_score(spark, d):
    """Each sighting against the object's last: an hour's decay, twenty widths'."""
    s = boxes.continuity_scores(sightings(spark, d), "user_id", "us", "event_id", 3_600_000_000.0, 20.0)
    return s.select("event_id", F.round("score", 6).alias("score"))


@query
def recent_views(spark, d):
    """The mean of an object's last three values."""
    s = boxes.recent_views(sightings(spark, d).withColumn("at", F.struct("us", "event_id")), "user_id", "at", "value", 3)
    total = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x)
    return s.select("event_id", F.size("recent").cast("long").alias("views"), F.round(total / F.size("recent"), 6).alias("mean"))


@query
def newest_frame(spark, d):
    """The newest sighting of each kind of event."""
    s = sightings(spark, d).select("event_type", "event_id", F.col("user_id"))
    return boxes.newest(s, "event_type", "event_id")


@query
def scene_ranking(spark, d):
    """Suppliers by their share of returned lines."""
    x = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag")
    return _r(boxes.scene_ranking(x, "l_suppkey", F.col("l_returnflag") == "R"), "share")


@query
def static_objects(spark, d):
    """Weak objects that never moved two widths from where they began."""
    s = sightings(spark, d)
    at = F.struct("us", "event_id")
    box = F.struct("x1", "y1", "x2", "y2")
    t = s.groupBy("user_id").agg(F.min_by(box, at).alias("f"), F.max_by(box, at).alias("l"), F.max("value").alias("peak"))
    pick = lambda p: g.Box(*(F.col(f"{p}.{c}") for c in ("x1", "y1", "x2", "y2")))
    return t.select("user_id", g.is_static(pick("f"), pick("l"), F.col("peak"), 200.0, 5.0).alias("static"))


@query
def identity_colours(spark, d):
    return table(spark, d, "customer").select("c_custkey", *[c.cast("long").alias(n) for n, c in g.id_colour(F.col("c_custkey")).items()])


@query
def binding_events(spark, d):
    """Counters over an event log: kinds per day, and the share of convincing ones."""
    s = sightings(spark, d)
    return s.groupBy(F.floor(F.col("hour") / 24).cast("long").alias("day")).agg(
        *[F.sum((F.col("event_type") == k).cast("long")).alias(k) for k in ("click", "purchase", "view")],
        F.round(F.avg((F.col("value") >= 50).cast("double")), 6).alias("coverage"),
    )


@query
def label_histogram(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


# -- descriptions ------------------------------------------------------------------------------------------


@query
def routed_vectors(spark, d):
    """Even labels to the specialist's slice, others to the general one; vectors of the two never meet."""
    v = vec.route(F.slice("vec", 1, 4), F.col("person").cast("string"), ["0", "2", "4", "6", "8"], 4, 4)
    o = observations(spark, d).select("item_id", F.posexplode(v).alias("pos", "v"))
    return o.select("item_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("v", 6).alias("v"))


@query
def fused_vectors(spark, d):
    """Deep and colour parts in one vector: its dot product with the first observation's."""
    o = observations(spark, d)
    deep, colour = vec.normalise(F.slice("vec", 1, 32)), vec.normalise(F.slice("vec", 33, 32))
    f = o.select("item_id", vec.fuse(deep, colour, 0.3).alias("f"))
    first = f.where("item_id = 0").select(F.col("f").alias("f0"))
    return f.join(F.broadcast(first)).select("item_id", F.round(vec.dot(F.col("f"), F.col("f0")), 6).alias("score"))


@query
def multi_view_cosine(spark, d):
    """A detection against the best of a track's latest three views."""
    o = observations(spark, d)
    w = Window.partitionBy("track").orderBy(F.desc("frame"))
    views = o.withColumn("n", F.row_number().over(w)).where("n <= 3").select(F.col("track").alias("identity_id"), "vec")
    best = metrics.best_matches(o, views, 6)
    return best.select("item_id", F.col("identity_id").alias("track"), "best")


@query
def running_embedding(spark, d):
    """The running mean of a track's vectors: half the past, half the present, of unit norm."""
    m = memory.running_means(observations(spark, d), "track", "frame", "item_id")
    return _long(m.withColumnRenamed("vec", "v"), "track", "v")


@query
def projected_vectors(spark, d):
    """A fixed projection to two components, of unit norm."""
    w = np.zeros((64, 2))
    w[::2, 0], w[1::2, 1] = 1.0, 1.0
    p = appearance.project(observations(spark, d), w)
    return p.select("item_id", F.round(F.col("vec")[0], 6).alias("a"), F.round(F.col("vec")[1], 6).alias("b"))


# -- anomaly -----------------------------------------------------------------------------------------------


def _normal(spark, d):
    o = observations(spark, d).select("item_id", "vec")
    return o.where("item_id % 2 = 0"), o.where("item_id % 2 = 1")


@query
def knn_anomaly(spark, d):
    normal, rest = _normal(spark, d)
    return _r(anomaly.knn_scores(rest, normal, 5), "score")


@query
def anomaly_percentile(spark, d):
    """The share of the normals' own scores below each."""
    normal, rest = _normal(spark, d)
    base = anomaly.knn_scores(normal, normal, 5)
    return _r(anomaly.percentile_in(_r(anomaly.knn_scores(rest, normal, 5), "score"), _r(base, "score")), "share")


@query
def mahalanobis_2d(spark, d):
    """On the first two components, where the inverse is a formula."""
    normal, rest = (x.withColumn("vec", F.slice("vec", 1, 2)) for x in _normal(spark, d))
    return _r(anomaly.scored(rest, anomaly.fit_mahalanobis(normal, 0.1)), "score")


@query
def mahalanobis(spark, d):
    normal, rest = _normal(spark, d)
    return _r(anomaly.build_detector("mahalanobis", normal)(rest), "score")


@query
def isolation_forest(spark, d):
    normal, rest = _normal(spark, d)
    return _r(anomaly.build_detector("isolation_forest", normal)(rest), "score")


@query
def one_class_svm(spark, d):
    normal, rest = _normal(spark, d)
    return _r(anomaly.build_detector("ocsvm", normal, bound=1500)(rest), "score")


@query
def patch_anomaly(spark, d):
    """Vectors as grids of 8 by 8 patches of one component: distance to the normal patches' nearest value,
    then the largest mean over two by two patches."""
    o = table(spark, d, "embeddings").select(F.col("vec_id").alias("crop_id"), F.posexplode("embedding").alias("pos", "x"))
    # a patch on the unit circle, so that the cosine measures the difference of components
    p = o.select("crop_id", F.floor(F.col("pos") / 8).cast("int").alias("gy"), (F.col("pos") % 8).cast("int").alias("gx"), F.array(F.cos(F.col("x") * 4.0), F.sin(F.col("x") * 4.0)).alias("vec"), "pos")
    bank = p.where(f"crop_id < {anomaly.MOST_CROPS}").select((F.col("crop_id") * 64 + F.col("pos")).alias("item_id"), "vec")
    return _r(anomaly.patch_score(anomaly.patch_distances(p.where(f"crop_id >= {anomaly.MOST_CROPS}"), bank, digits=9), 8), "score")


# -- tracking ----------------------------------------------------------------------------------------------


@query
def track_kalman(spark, d):
    """Each object's box, filtered over its sightings."""
    s = sightings(spark, d).withColumn("at", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    return _r(tracks.filter_boxes(s, "user_id", "at"), "cx", "cy", "w", "h")


@query
def track_single(spark, d):
    """The tracker over sequences of one detection a frame, in which a track that misses one ends: gates, lifecycle, and
    the hand-over of those that were confirmed."""
    s = sightings(spark, d).withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    frames = s.select(
        F.col("user_id").cast("string").alias("seq"), "frame", F.lit(True).alias("detector_ran"), F.lit(0).alias("det_idx"), "x1", "y1", "x2", "y2", F.lit(0.9).alias("score"),
        F.lit(0).alias("class_id"), F.lit("thing").alias("label"), F.lit(None).cast("array<double>").alias("vec"),
    )
    t = tracks.track_frames(frames, TrackerConfig(max_age=0, min_hits=2))
    return _r(t.select("seq", "frame", "track_id", "x1", "y1", "x2", "y2", "hits", "time_since_update", "state"), "x1", "y1", "x2", "y2")


def _walk(spark, d) -> DataFrame:
    """A sequence of sixty frames for every three vectors, in which three walkers cross; a vector of ``embeddings`` is each one's look."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("who"), vec.normalise(F.col("embedding")).alias("look"))
    who = F.col("who")
    f = e.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(59))))
    # each walks on a lane of its own and is gone for frames 20 to 29
    x = F.when(who % 2 == 0, F.col("frame") * 4.0).otherwise(240 - F.col("frame") * 4.0)
    y = (who % 3) * 15.0
    here = f.withColumns({"seq": F.format_string("s%08d", F.floor(who / 3)), "x1": x, "y1": y, "x2": x + 20, "y2": y + 40})
    shown = (F.col("frame") < 20) | (F.col("frame") >= 30) | (who % 3 != 0)
    return here.select(
        "seq", F.col("frame").cast("int").alias("frame"), F.lit(True).alias("detector_ran"), F.when(shown, (who % 3).cast("int")).alias("det_idx"), "x1", "y1", "x2", "y2",
        F.lit(0.9).alias("score"), F.lit(0).alias("class_id"), F.lit("person").alias("label"), F.col("look").alias("vec"), who.alias("id"),
    )


CROSSING = TrackerConfig(max_age=3, contested_iou=0.9)


@query
def track_crossing(spark, d):
    """The tracker alone: where each track is, frame by frame."""
    t = tracks.track_frames(_walk(spark, d).drop("id"), CROSSING)
    return _r(t.select("seq", "frame", "track_id", "x1", "y1", "x2", "y2", F.col("hits"), "state"), "x1", "y1", "x2", "y2")


@query
def identity_bind(spark, d):
    """Tracker and binder: which identity each track wears; walkers that come back are known."""
    t = tracks.track_frames(_walk(spark, d).drop("id"), CROSSING, BinderConfig())
    return t.select("seq", "frame", "track_id", "identity_id", "state", "created", "rebound", "reclaimed", "taken", "swapped")


@query
def mot_idf1(spark, d):
    """What the tracker and binder score against the walkers themselves."""
    w = _walk(spark, d)
    truth = w.where("det_idx is not null").select("seq", "frame", "id", "x1", "y1", "x2", "y2", F.lit(1.0).alias("visibility"))
    found = tracks.track_frames(w.drop("id"), CROSSING, BinderConfig()).where("state = 'active' and time_since_update = 0")
    return _r(evaluate.mot_scores(truth, found), *evaluate.MEASURES)


@query
def binding_sweep(spark, d):
    """The binder run anew at three thresholds: identities and bindings at each."""
    t = tracks.sweep_thresholds(_walk(spark, d).drop("id"), [0.55, 0.593, 0.65], CROSSING, BinderConfig())
    return t.groupBy("threshold").agg(F.count_distinct("seq", "identity_id").alias("identities"), F.sum("created").alias("created"), F.sum("rebound").alias("rebound"))

"""Operators on small tables: parity of forms, edge rows, sources and sinks."""

import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from argusframe.functions import geometry as g
from argusframe.functions import vec
from argusframe.operators import anomaly, appearance, boxes, evaluate, memory, metrics, pairs, search, tracks
from argusframe.operators.binding import BinderConfig
from argusframe.operators.tracking import TrackerConfig
from argusframe.sources import sequences
from argusframe.sources.store import Store, upsert_batch


def vectors(spark, rows, names="item_id long, vec array<double>"):
    return spark.createDataFrame(rows, names)


def test_vector_functions(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, [1.0], [1.0, 0.0])], "k int, a array<float>, b array<float>")
    got = {r.k: r for r in df.select("k", vec.normalise(F.col("a")).alias("n"), vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.normalise(F.col("a"), 10.0).alias("e")).collect()}
    assert np.allclose(got[1].n, [0.6, 0.8]) and got[1].c == pytest.approx(0.6) and np.allclose(got[1].e, [0.3, 0.4])
    assert got[2].n == [0.0, 0.0] and got[2].c is None and got[3].n is None and got[4].c is None
    with pytest.raises(PySparkException):
        df.select(vec.checked(F.col("a"), 2)).collect()
    a, b = np.random.default_rng(0).normal(size=(2, 8))
    f = vec.pair_features(F.col("a"), F.col("b"))
    r = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").select(*[c.alias(n) for n, c in f.items()]).first()
    want = [a @ b, np.linalg.norm(a - b), np.abs(a - b).mean(), np.abs(a - b).std(), np.abs(a - b).max(), (a * b).mean(), (a * b).std(), (a * b).min(), (a * b).max()]
    assert np.allclose(list(r), want)


def test_interval_forms_differ_only_where_they_touch(spark):
    df = spark.createDataFrame([(0, 10, 10, 20), (0, 10, 9, 20), (5, 5, 5, 5)], "a int, b int, c int, d int")
    c = [F.col(x) for x in "abcd"]
    assert [tuple(r) for r in df.select(g.overlaps(*c), g.overlaps_strictly(*c)).collect()] == [(True, False), (True, True), (True, False)]


def test_detection_crop_lies_in_the_frame(spark):
    df = spark.createDataFrame([(50.0, 60.0, 90.0, 95.0), (-5.0, -5.0, 10.0, 10.0)], "x1 double, y1 double, x2 double, y2 double")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in g.detection_crop(g.Box.of(), 30, 20).items()]).collect()]
    assert got == [(29, 19, 30, 20), (0, 0, 10, 10)]


@pytest.mark.parametrize("bound", [20_000, 10])
def test_top_k_forms_agree(spark, bound, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).round(1)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]).repartition(3)
    monkeypatch.setattr(search, "QUERY_BOUND", bound)
    got = {(r.query_id, r.rank): r.item_id for r in search.top_k(df.withColumnRenamed("item_id", "query_id"), df, 4, exclude_self=True, block=16).collect()}
    for i in range(60):
        s = (x @ x[i]).round(6)
        order = [j for j in np.lexsort((np.arange(60), -s)) if j != i][:4]
        assert [got[i, k + 1] for k in range(4)] == order
    with pytest.raises(ValueError):
        search.top_k(df, df, 0)


def test_top_k_of_little(spark):
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    q = df.withColumnRenamed("item_id", "query_id")
    assert search.top_k(q, df, 9).count() == 4 and search.top_k(q.limit(0), df, 3).collect() == [] and search.top_k(q, df.limit(0), 3).collect() == []


def identities(spark):
    ids = spark.createDataFrame([(1, "p", 0.0, 10.0, 3, [1.0, 0.0]), (2, "p", 20.0, 25.0, 1, [0.0, 1.0])], "identity_id long, label string, first_seen double, last_seen double, appearances long, prototype array<double>")
    ex = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "item_id long, identity_id long, vec array<double>")
    return ids, ex


def test_memory_tables(spark):
    ids, ex = identities(spark)
    seen = spark.createDataFrame([(1, "q", 5.0, 30.0, 1, [[0.0, 2.0]]), (7, "r", 1.0, 2.0, 1, [[5.0, 0.0], [0.0, 0.0]])], "identity_id long, label string, first_seen double, last_seen double, appearances long, vecs array<array<double>>")
    a, b = memory.remember(ids, ex, seen, 2)
    got = {r.identity_id: r for r in a.collect()}
    assert (got[1].label, got[1].first_seen, got[1].last_seen, got[1].appearances) == ("q", 0.0, 30.0, 4)
    assert np.allclose(got[1].prototype, np.array([3, 1]) / np.sqrt(10)) and np.allclose(got[7].prototype, [1, 0]) and got[2].label == "p"
    assert sorted(r.identity_id for r in b.collect()) == [1, 1, 2, 7, 7]
    m, e = memory.merge(ids, ex, spark.createDataFrame([(1, 2), (1, 99)], "keep_id long, absorb_id long"), 5)
    r = m.first()
    assert m.count() == 1 and (r.first_seen, r.last_seen, r.appearances) == (0.0, 25.0, 4) and np.allclose(r.prototype, np.array([3, 1]) / np.sqrt(10))
    assert [x.identity_id for x in e.collect()] == [1, 1]
    f, e = memory.forget(ids, ex, spark.createDataFrame([(2,), (50,)], "identity_id long"))
    assert f.count() == e.count() == 1
    broken = memory.integrity(ids, ex.where("item_id = 1").unionByName(spark.createDataFrame([(9, 9, [1.0, 0.0])], ex.schema)))
    assert sorted(map(tuple, broken.collect())) == [("bare", 2), ("orphan", 9)]


def test_store_keeps_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.version() is None and [t.count() for t in store.load()] == [0, 0]
    ids, ex = identities(spark)
    first = store.save(ids, ex)
    store.save(*memory.forget(*store.load(), spark.createDataFrame([(2,)], "identity_id long")), version="batch-3")
    assert store.version() == "batch-3" and [t.count() for t in store.load()] == [1, 1]
    assert os.path.exists(f"{tmp_path}/{first}/identities")

    def grow(a, b, batch):
        return a.withColumn("appearances", F.col("appearances") + 1), b

    sink = upsert_batch(store, grow)
    for _ in range(2):  # a replayed batch counts once
        sink(ids, 4)
    assert store.load()[0].first().appearances == 4
    store.save(ids, ex.where("item_id = 1"))
    assert store.load()[0].count() == 1


def test_metrics_at_the_edges(spark):
    scored = lambda rows: spark.createDataFrame(rows, "score double, y int")
    value = lambda df: df.first()[0]
    assert value(metrics.auroc(scored([(0.1, 0), (0.9, 1)]))) == 1.0 and value(metrics.auroc(scored([(0.9, 0), (0.1, 1)]))) == 0.0
    assert value(metrics.auroc(scored([(0.5, 0), (0.5, 1)]))) == 0.5 and value(metrics.auroc(scored([(0.5, 1)]))) == 0.5
    assert value(metrics.auroc(scored([]))) == 0.5 and value(metrics.auroc(scored([(0.5, 1)]), empty=None)) is None
    assert value(metrics.youden_threshold(scored([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)]))) == 0.5
    assert metrics.youden_threshold(scored([(0.1, 0)])).collect() == []
    assert tuple(metrics.false_merge_cut(scored([(i / 10, 0) for i in range(10)]), 0.2).first()) == (10, 2, 0.7)
    assert metrics.false_merge_cut(scored([(0.1, 1)]), 0.1).collect() == [] and metrics.boundary_above(None) == float("inf") and metrics.boundary_above(0.7) > 0.7
    empty = metrics.confusion(scored([]), 0.5).first()
    assert (empty.tp, empty.accuracy, empty.tpr) == (0, 0.0, 0.0)


def test_retrieval_leaves_out_the_own_track(spark):
    rows = [(i, 1, 1, [1.0, 0.0]) for i in range(3)] + [(3, 1, 2, [0.0, 1.0]), (4, 2, 3, [1.0, 0.0])]
    r = metrics.retrieval(spark.createDataFrame(rows, "item_id long, person long, track long, vec array<double>")).first()
    assert r.queries == 4 and r.rank1 == 0.25


def test_pairs(spark):
    o = spark.createDataFrame([(t, t * 10 + i, i) for t in (1, 2) for i in range(6)] + [(3, 90, 50)], "track long, item_id long, frame long")
    assert pairs.positive_pairs(o, 3).count() == 12 and pairs.positive_pairs(o, 3, per_track=2).count() == 4
    sampled = [tuple(r) for r in pairs.positive_pairs(o, 3, 2, seed=1).collect()]
    assert sorted(sampled) == sorted(tuple(r) for r in pairs.positive_pairs(o.repartition(5), 3, 2, seed=1).collect())
    assert pairs.negative_pairs(o).count() == 36 and pairs.negative_pairs(o, 5).count() == 5
    t = pairs.spans(o, "track")
    assert [tuple(r) for r in pairs.coalive_tracks(t).collect()] == [tuple(r) for r in pairs.coalive_tracks(t, width=2).collect()] == [(1, 2)]
    p = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 4)], "owner_a long, owner_b long")
    assert sorted((r.owner_a, r.owner_b, r.side) for r in pairs.split_by_owner(p, F.col("owner") >= 2).collect()) == [(1, 1, "train"), (2, 2, "test"), (3, 4, "test")]
    sides = pairs.random_owners(p, 0.3).collect()
    assert sum(r.test for r in sides) == 1 and len(sides) == 4


def test_drawn_pairs_are_a_sample_of_all(spark):
    o = spark.createDataFrame([(t, t * 1000 + i, i) for t, n in enumerate((1, 2, 30, 7, 64)) for i in range(n)], "track long, item_id long, frame long")
    every = {tuple(r) for r in pairs.positive_pairs(o, 2).collect()}
    for cap in (1, 10, 10_000):
        some = [tuple(r) for r in pairs.positive_pairs(o, 2, cap, seed=3).collect()]
        assert len(some) == len(set(some)) and set(some) <= every
        n = {t: sum(r[0] == t for r in every) for t in range(5)}
        assert all(sum(r[0] == t for r in some) == min(cap, n[t]) for t in n)
    every = {tuple(r) for r in pairs.negative_pairs(o).collect()}
    for wanted in (5, 300, 10**6):
        some = [tuple(r) for r in pairs.negative_pairs(o, wanted, seed=2).collect()]
        assert len(some) == len(set(some)) == min(wanted, len(every)) and set(some) <= every
    assert pairs.negative_pairs(o, 50, seed=1).exceptAll(pairs.negative_pairs(o.repartition(3), 50, seed=1)).isEmpty()
    mined = pairs.mine_pairs(o, 2, 20).collect()
    assert sum(r.y for r in mined) * 2 == len(mined) > 20 and all((r.owner_a == r.owner_b) == (r.y == 1) for r in mined)


def test_hard_negatives_and_similarities_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i % 3, int(rng.integers(3)), i, rng.normal(size=4).round(1).tolist()) for i in range(45)]
    o = spark.createDataFrame(rows, "sequence long, person long, item_id long, vec array<double>").repartition(4)
    got = {(r.a, r["rank"]): r.b for r in pairs.hard_negatives(o.withColumnRenamed("item_id", "a"), o, 4).collect()}
    for s, p, i, v in rows:
        order = sorted((-round(float(np.dot(v, w)), 6), j) for t, q, j, w in rows if t == s and q != p)[:4]
        assert [got[i, k + 1] for k in range(len(order))] == [j for _, j in order]
    found = {r.person: r for r in metrics.pair_similarity(o, block=4).collect()}
    for p in range(3):
        s = [round(float(np.dot(v, w)), 6) for _, a, i, v in rows for _, b, j, w in rows if a == b == p and i < j]
        assert found[p].pairs == len(s) and found[p].mean == pytest.approx(np.mean(s)) and found[p].median == pytest.approx(np.median(s))


def test_counts_descriptions_and_models(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "identity_id long")
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "item_id long, identity_id long")
    assert tuple(memory.identity_counts(ids, e).first()) == (3, 3, 2) and tuple(memory.identity_counts(ids.limit(0), e.limit(0)).first()) == (0, 0, 0)
    b = spark.createDataFrame([(1, 5, 0.0, 0.0, 16.0, 32.0, 0), (1, 4, 0.0, 0.0, 16.0, 31.0, 0), (2, 1, 0.0, 0.0, 50.0, 50.0, 1), (3, 2, 0.0, 0.0, 50.0, 50.0, 0)],
                              "identity_id long, frame int, x1 double, y1 double, x2 double, y2 double, time_since_update long")
    assert sorted((r.identity_id, r.frame) for r in memory.describable(b, ids.where("identity_id = 3")).collect()) == [(1, 5)]
    patches = spark.createDataFrame([(i, 0, 0, [1.0, 0.0]) for i in range(60)], "crop_id long, gy int, gx int, vec array<double>")
    crops = spark.createDataFrame([(i, None if i % 2 else 7) for i in range(60)], "crop_id long, identity_id long")
    assert anomaly.patch_bank(patches, crops).count() == 30 and anomaly.patch_bank(patches, crops.withColumn("identity_id", F.lit(1))).count() == 40
    cache = anomaly.ModelCache("knn", k=2)
    normal = vectors(spark, [(i, [float(i), 1.0]) for i in range(20)])
    assert cache.model("a", normal.limit(7)) is None
    first = cache.model("a", normal.limit(8))
    assert first is not None and cache.model("a", normal.limit(9)) is first and cache.model("a", normal.limit(10)) is not first


def test_a_session_counts_once_at_each_threshold(spark):
    t = tracks.sweep_thresholds(walkers(spark), [0.5, 1.1], TrackerConfig(), BinderConfig())
    n = {r.threshold: r.n for r in t.groupBy("threshold").agg(F.count_distinct("seq", "identity_id").alias("n")).collect()}
    assert n[0.5] == 4 <= n[1.1]


def test_coalive_counts_against_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(a), int(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 40, 120), rng.integers(0, 5, 120)))]
    got = {r.track: (r.closed, r.strict) for r in boxes.coalive_counts(spark.createDataFrame(rows, "track long, first long, last long")).collect()}
    for i, a, b in rows:
        assert got[i] == (sum(a <= d and c <= b for j, c, d in rows if j != i), sum(a < d and c < b for j, c, d in rows if j != i))


def test_anomaly_edges(spark):
    df = vectors(spark, [(i, [float(i == k) for k in range(4)]) for i in range(4)])
    got = {r.item_id: r.score for r in anomaly.knn_scores(df, df, 9).collect()}
    assert all(v == pytest.approx(0.75) for v in got.values())
    for bad in (df.limit(0), df.limit(1)):
        with pytest.raises(ValueError):
            anomaly.fit_mahalanobis(bad, 0.1)
    with pytest.raises(ValueError):
        anomaly.knn_scores(df, df.limit(0), 3)
    with pytest.raises(ValueError):
        anomaly.build_detector("none", df)
    x = np.random.default_rng(0).normal(size=(50, 3))
    model = anomaly.fit_mahalanobis(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(4), 0.1)
    cov = 0.9 * np.cov(x.T) + 0.1 * np.trace(np.cov(x.T)) / 3 * np.eye(3)
    d = x - x.mean(0)
    assert np.allclose(model.score(x), np.sqrt(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)))


def test_hottest_patch(spark):
    rng = np.random.default_rng(0)
    usual = lambda: (np.eye(8)[0] + 0.05 * rng.normal(size=8)).tolist()
    bank = vectors(spark, [(i, usual()) for i in range(70)])
    grid = lambda c, odd: [(c, y, x, (np.eye(8)[5].tolist() if odd and y in (1, 2) and x in (1, 2) else usual())) for y in range(8) for x in range(8)]
    p = spark.createDataFrame(grid(1, False) + grid(2, True), "crop_id long, gy int, gx int, vec array<double>")
    s = {r.crop_id: r.score for r in anomaly.patch_score(anomaly.patch_distances(p, bank), 8).collect()}
    assert s[2] > 5 * s[1]
    with pytest.raises(ValueError):
        anomaly.patch_distances(p, bank.limit(10))


def test_describe_and_project(spark):
    crops = spark.createDataFrame([(1, 2, 2, bytearray(12)), (2, 1, 2, bytearray([9] * 6))], "item_id long, height int, width int, data binary")
    got = {r.item_id: r.vec for r in appearance.describe(crops, lambda images: np.array([[float(i.size), 0.0] for i in images]), batch=1).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    df = vectors(spark, [(1, [3.0, 4.0, 9.0])])
    assert np.allclose(appearance.project(df, np.eye(3)[:, :2]).first().vec, [0.6, 0.8])
    with pytest.raises(PySparkException):
        appearance.project(df, np.eye(2)).collect()


def walkers(spark):
    rows = []
    for seq, shift in (("a", 0.0), ("b", 5.0)):
        for f in range(30):
            if f in (12, 13):
                rows.append((seq, f, f == 12, None, None, None, None, None, None, None, None, None))
                continue
            for k in range(2):
                x = shift + 100.0 * k + 2 * f
                rows.append((seq, f, True, k, x, 0.0, x + 20, 40.0, 0.9, 0, "p", [float(k == 0), float(k == 1)]))
    return spark.createDataFrame(rows, "seq string, frame int, detector_ran boolean, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, class_id int, label string, vec array<double>")


def test_tracking_and_scores(spark):
    d = walkers(spark)
    t = tracks.track_frames(d.repartition(4), TrackerConfig(), BinderConfig(threshold=0.8)).collect()
    assert {(r.seq, r.track_id, r.identity_id) for r in t if r.frame == 29} == {(s, i, i) for s in "ab" for i in (1, 2)}
    truth = d.where("det_idx is not null").withColumn("id", F.col("det_idx").cast("long")).withColumn("visibility", F.lit(1.0))
    found = spark.createDataFrame([r for r in t if r.time_since_update == 0], tracks.TRACK_SCHEMA)
    got = evaluate.mot_scores(truth, found).collect()
    assert len(got) == 2 and all(r.idf1 > 0.95 and r.switches == 0 and r.misses == 4 for r in got)
    assert tracks.track_frames(d.limit(0)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    from argusframe.streaming.tracking import detected_frames, one_row_a_frame, session_tracks, track_stream

    d = walkers(spark)
    frames = one_row_a_frame(d)
    source = tmp_path / "frames"
    config = (TrackerConfig(), BinderConfig(threshold=0.8))
    for lo, hi in ((0, 9), (10, 19), (20, 29)):
        frames.where(F.col("frame").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(source))
    late = frames.where("frame = 3")
    for step in (None, late):
        if step is not None:
            step.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = track_stream(stream, *config).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = tracks.track_frames(d, *config)
    key = lambda df: sorted((r.seq, r.frame, r.track_id, r.state, r.identity_id, round(r.x1, 6)) for r in df.collect())
    assert key(got) == key(want)
    assert detected_frames(frames, 5).where("detector_ran").count() == 12
    events = spark.createDataFrame([(1, f"2024-01-01 {h:02d}:00:00") for h in (0, 1, 20)], "user long, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.hits for r in session_tracks(events, "user", "t", "12 hours", "1 day").collect()) == [1, 2]


def test_sequences_on_disk(spark, tmp_path):
    for name, ini in (("S-1", "[Sequence]\nname=S-1\nframeRate=25\nseqLength=3\nimWidth=640\nimHeight=480\n"), ("S-2", "[Sequence]\nseqLength = 2\n")):
        os.makedirs(tmp_path / name / "gt")
        (tmp_path / name / "seqinfo.ini").write_text(ini)
    (tmp_path / "S-1/gt/gt.txt").write_text("1,7,10,20,30,40,1,1,1.0\n1,8,0,0,5,5,0,1,1.0\n2,9,0,0,5,5,1,7,1.0\n2,7,11,20,30,40,1,1,0.05\n")
    (tmp_path / "S-2/gt/gt.txt").write_text("1,1,0,0,5,5\n")
    seqs = sequences.read_sequences(spark, str(tmp_path)).collect()
    assert [(s.seq, s.fps, s.length, s.width) for s in seqs] == [("S-1", 25.0, 3, 640), ("S-2", 30.0, 2, 0)]
    truth = sequences.read_labels(spark, f"{tmp_path}/*/gt/gt.txt")
    got = sorted(tuple(r) for r in truth.collect())
    assert got == [("S-1", 1, 7, 10.0, 20.0, 40.0, 60.0, 1.0), ("S-1", 2, 7, 11.0, 20.0, 41.0, 60.0, 0.05), ("S-2", 1, 1, 0.0, 0.0, 5.0, 5.0, 1.0)]
    assert sequences.read_labels(spark, f"{tmp_path}/*/gt/gt.txt", (1, 7)).count() == 4
    assert sequences.read_labels(spark, f"{tmp_path}/none/gt.txt").collect() == []
    frames = spark.createDataFrame([("S-1", 1), ("S-1", 2), ("S-1", 3)], "seq string, frame int")
    assert {r.frame: r.id for r in sequences.visible(truth, frames, 0.25).collect()} == {1: 7, 2: None, 3: None}
    assert [r.frame for r in sequences.missing_frames(frames.where("frame != 2"), 3).collect()] == [2]
    (tmp_path / "bad").mkdir()
    with pytest.raises(FileNotFoundError):
        sequences.read_sequences(spark, str(tmp_path / "bad"))
    (tmp_path / "bad/seqinfo.ini").write_text("[Sequence]\nname=x\n")
    with pytest.raises(PySparkException):
        sequences.read_sequences(spark, str(tmp_path / "bad")).collect()


def test_training_labels(spark, tmp_path):
    t = spark.createDataFrame([("s", 1, 1, 20.0, 10.0, 60.0, 50.0, 1.0), ("s", 1, 2, 0.0, 0.0, 5.0, 5.0, 0.0), ("s", 2, 3, 5.0, 5.0, 5.0, 9.0, 1.0)], sequences.TRUTH)
    lines = sequences.training_labels(t, spark.createDataFrame([("s", 200, 100)], "seq string, width int, height int"))
    assert [r.line for r in lines.collect()] == ["0 0.200000 0.300000 0.200000 0.400000"]
    sequences.write_training_labels(lines, spark.createDataFrame([("s", "train")], "seq string, split string"), str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).count() == 1
    with pytest.raises(ValueError):
        sequences.write_training_labels(lines, spark.createDataFrame([("s", "train"), ("s", "val")], "seq string, split string"), str(tmp_path / "x"))


def test_annotations(spark, tmp_path):
    d = [{"label": "car", "bounding_box": [0.1, 0.2, 0.5, 0.5], "occlusion": 1}, {"label": "tree", "bounding_box": [0, 0, 1, 1], "occlusion": 2}]
    (tmp_path / "samples.json").write_text(json.dumps({"samples": [{"scene": "x", "frame": 3, "width": 100, "height": 50, "detections": d}]}, indent=1))
    got = sorted(tuple(r) for r in sequences.read_annotations(spark, str(tmp_path / "samples.json"), ["people", "car"]).collect())
    assert got == [("x", 3, 0, 10.0, 10.0, 50.0, 25.0, 1, 1, 0.5), ("x", 3, 1, 0.0, 0.0, 100.0, 50.0, 0, 0, 1.0)]


def test_engine(spark, tmp_path):
    from argusframe.engine import Engine

    e = Engine(spark, str(tmp_path / "memory"), min_score=0.1)
    schema = "identity_id long, label string, first_seen double, last_seen double, appearances long, vecs array<array<double>>"
    rng = np.random.default_rng(0)
    near = lambda k: [(np.eye(4)[k] + 0.05 * rng.normal(size=4)).tolist() for _ in range(9)]
    e.remember(spark.createDataFrame([(1, "p", 0.0, 1.0, 9, near(0)), (2, "p", 0.0, 1.0, 9, near(1)), (3, "c", 0.0, 1.0, 9, near(2))], schema))
    q = spark.createDataFrame([(5, [1.0, 0.1, 0.0, 0.0]), (5, [0.9, 0.0, 0.0, 0.0])], "query_id long, vec array<double>")
    assert [r.identity_id for r in e.similar(q, "p", 2).orderBy("rank").collect()] == [1, 2]
    assert [r.identity_id for r in e.similar(q, "c", 1).collect()] == []
    index = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.8, 0.6]), (9, [1.0, 0.0])], "identity_id long, vec array<double>")
    t = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    assert {r.identity_id for r in e.find(t, index, 3).collect()} == {1, 3}
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0, 1.0])], "item_id long, vec array<double>")
    s = {r.item_id: r.score for r in e.anomalies(rows, "p").collect()}
    assert s[2] > s[1] and e.anomalies(rows, "none") is None and e.baseline("p").count() == 18
    e.merge(spark.createDataFrame([(1, 2)], "keep_id long, absorb_id long"))
    e.forget(spark.createDataFrame([(3,)], "identity_id long"))
    assert [r.identity_id for r in e.store.load()[0].collect()] == [1]


def test_newest_frame_mailbox(spark, tmp_path):
    from argusframe.streaming.sources import frame_files, newest_only

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "seq string, frame int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = frame_files(spark, str(tmp_path / "in"), df.schema).writeStream.foreachBatch(newest_only(lambda b, i: seen.extend(map(tuple, b.collect())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(seen) == [("a", 2), ("b", 7)]


@pytest.mark.parametrize("bound", [20_000, 2])
def test_forms_of_retrieval_and_identity_scores_agree(spark, monkeypatch, bound):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(4)), int(rng.integers(8)), i, rng.normal(size=4).round(1).tolist()) for i in range(40)]
    o = spark.createDataFrame(rows, "item_id long, person long, track long, frame long, vec array<double>")
    monkeypatch.setattr(metrics, "QUERY_BOUND", bound)
    monkeypatch.setattr(search, "QUERY_BOUND", bound)
    r = metrics.retrieval(o).first()
    firsts = []
    for i, p, t, _, v in rows:
        if len({x[2] for x in rows if x[1] == p} - {t}) and len({x[2] for x in rows if x[1] == p}) > 1:
            order = sorted((x for x in rows if x[2] != t), key=lambda x: (-round(float(np.dot(v, x[4])), 6), x[0]))
            firsts.append(next(k for k, x in enumerate(order, 1) if x[1] == p))
    assert r.queries == len(firsts) and r.rank5 == pytest.approx(np.mean([f <= 5 for f in firsts]))
    ranks = metrics._counted_ranks(o.select("item_id", "person", "track", "vec"), 6, block=7).collect()
    mine = metrics._hit_ranks(o.select("item_id", "person", "track", "vec"), o.toPandas(), 6).collect()
    assert sorted((x.query, x["rank"]) for x in ranks) == sorted((x.query, x["rank"]) for x in mine)
    top = {(x.query_id, x["rank"]): (x.identity_id, x.score) for x in search.identity_top_k(o.withColumnRenamed("item_id", "query_id"), o.withColumn("identity_id", F.col("person")), 3, block=7).collect()}
    for i, _, _, _, v in rows:
        best = {}
        for j, p, _, _, w in rows:
            if j != i:
                best[p] = max(best.get(p, -9), round(float(np.dot(v, w)), 6))
        order = sorted(best, key=lambda p: (-best[p], p))[:3]
        assert [top[i, k + 1] for k in range(len(order))] == [(p, best[p]) for p in order]
    e = o.where("item_id < 10").select(F.col("person").alias("identity_id"), "vec")
    got = {(x.track, x.identity_id): x.score for x in metrics.identity_scores(o, e, None, 0.75).collect()}
    for t, k in got:
        best = [max(round(float(np.dot(x[4], y[4])), 6) for y in rows[:10] if y[1] == k) for x in rows if x[2] == t]
        assert got[t, k] == pytest.approx(np.percentile(best, 75))


def test_hits_of_a_large_gallery_are_never_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, int(rng.integers(12)), rng.normal(size=3).tolist()) for i in range(600)]
    o = spark.createDataFrame(rows, "item_id long, person long, track long, vec array<double>")
    want = metrics.retrieval(o).first()
    monkeypatch.setattr(metrics, "QUERY_BOUND", 2)
    r = metrics.retrieval(o)
    assert [tuple(x) for x in r.collect()] == [pytest.approx(tuple(want))]
    written, left = [], [r._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        if node.metrics().contains("shuffleRecordsWritten"):
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        left += [node.children().apply(i) for i in range(node.children().size())]
    assert written and max(written) <= len(rows)


@pytest.mark.parametrize("times", [1.0, 1e9, float("nan")])
def test_counted_ranks_with_ties_and_rows_without_person_or_track(spark, times):
    rng = np.random.default_rng(7)
    rows = []
    for i in rng.permutation(300).tolist():
        p, t = int(rng.integers(20)), int(rng.integers(6))
        v = [1.0, 0.0] if i % 5 == 0 else rng.normal(size=2).round(1).tolist()
        rows.append((i, None if i % 17 == 0 else p, None if i % 19 == 0 else 100 * p + (0 if p < 4 else t), [x * times if i % 7 == 0 else x for x in v]))
    o = spark.createDataFrame(rows, "item_id long, person long, track long, vec array<double>")
    score = lambda a, b: -np.round(np.float64(a[3][0]) * b[3][0] + np.float64(a[3][1]) * b[3][1], 6)
    want = []
    for q in rows:
        if q[1] is not None and q[2] is not None:
            order = sorted((np.isnan(s), 0 if np.isnan(s) else s, g[0], g[1] == q[1]) for g in rows if g[2] not in (None, q[2]) for s in [score(q, g)])
            want += [(q[0], k) for k, x in enumerate(order, 1) if x[3]]
    for block, held in ((40, 500), (1 << 17, 6_000_000)):
        assert sorted((x.query, x["rank"]) for x in metrics._counted_ranks(o, 6, block, held).collect()) == sorted(want)


def test_suppression_over_cut_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), i, *(xy := rng.integers(0, 12, 2).astype(float)).tolist(), *(xy + 10).tolist(), float(rng.integers(5)), int(rng.integers(2))) for f in range(30) for i in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "frame long, det_idx long, x1 double, y1 double, x2 double, y2 double, score double, class_id int")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "3")
        got = sorted(map(tuple, boxes.nms(df, 0.3, ("frame",)).collect()))
    finally:
        spark.conf.set(key, old)
    want = []
    for f in range(30):
        part = [r for r in rows if r[0] == f]
        a = np.array([r[2:6] for r in part])
        want += [(f, part[i][1]) for i in boxes.suppress(a, np.array([r[6] for r in part]), np.array([r[7] for r in part]), 0.3)]
    assert got == sorted(want)
    assert boxes.nms(df.limit(0), 0.3, ("frame",)).collect() == []


def test_cache_and_weights(spark, tmp_path):
    from argusframe.sources import cache

    schema, path = "seq string, frame int, v double", str(tmp_path / "cache")
    frames = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "seq string, frame int")
    assert cache.still_to_do(frames, cache.read_cache(spark, path, schema)).count() == 3
    cache.append_frames(spark.createDataFrame([("a", 1, 0.5)], schema), path)
    assert sorted(map(tuple, cache.still_to_do(frames, cache.read_cache(spark, path, schema)).collect())) == [("a", 2), ("b", 1)]
    w = {"projection": np.arange(6.0).reshape(2, 3), "bias": np.array([1.5])}
    cache.save_weights(spark, str(tmp_path / "w"), w)
    back = cache.load_weights(spark, str(tmp_path / "w"))
    assert all((back[k] == w[k]).all() and back[k].shape == w[k].shape for k in w)

"""What the queries must return, in SQL that DuckDB runs on the same tables; written from the definitions."""

from __future__ import annotations

# Unit vectors in double, four tracks a person.
_OBS = """
    obs AS (SELECT vec_id AS item_id, label::BIGINT AS person, (label * 4 + vec_id % 4)::BIGINT AS track, vec_id AS frame,
                   [x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) FOR x IN embedding] AS vec
            FROM embeddings)"""
# The same on short tracks.
_BLOCKS = _OBS + """,
    blk AS (SELECT item_id, person, (person * 100000 + item_id // 50)::BIGINT AS track, frame, vec FROM obs)"""
_DET = """
    det AS (SELECT l_orderkey AS frame,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS det_idx,
                   l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 10 AS x2, l_discount * 100 + 10 AS y2,
                   l_extendedprice AS score, (l_returnflag = 'N')::INT AS class_id
            FROM lineitem)"""
_IOU = """
    (SELECT CASE WHEN u > 0 THEN i / u ELSE 0 END FROM (SELECT i, greatest(a.x2 - a.x1, 0) * greatest(a.y2 - a.y1, 0)
        + greatest(b.x2 - b.x1, 0) * greatest(b.y2 - b.y1, 0) - i AS u FROM (SELECT
        greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i)))"""
_EV = """
    ev AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS hour, value, event_type,
                  value AS x1, value / 2 AS y1, value + 10 AS x2, value / 2 + 20 AS y2 FROM events)"""
_LIVES = _EV + """,
    gaps AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 43200000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    isl AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM gaps),
    lives AS (SELECT user_id, island, min(us) AS first, max(us) AS last, count(*) AS hits FROM isl GROUP BY ALL)"""
_TRUTH = """
    truth AS (SELECT doc_id AS key, n_chars::DOUBLE AS score, quality AS y FROM labels JOIN documents USING (doc_id))"""
_PROTO = """
    part AS (SELECT item_id % 2 AS half, person AS identity_id, u.pos, avg(u.x) AS x
             FROM obs, (SELECT unnest(vec) AS x, unnest(range(1, 65)) AS pos) u GROUP BY ALL),
    len AS (SELECT half, identity_id, sqrt(sum(x * x)) AS n FROM part GROUP BY ALL),
    proto AS (SELECT half, identity_id, pos, x / n AS v FROM part JOIN len USING (half, identity_id)),
    fact AS (SELECT item_id % 2 AS half, person AS identity_id, count(*) AS n, min(item_id)::DOUBLE AS lo, max(item_id)::DOUBLE AS hi FROM obs GROUP BY ALL)"""
_CALIBRATION = _BLOCKS + """,
    placed AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame, item_id) AS place, count(*) OVER (PARTITION BY track) AS size FROM blk),
    cut AS (SELECT *, place > size // 2 AS late FROM placed WHERE size >= 4),
    best AS (SELECT a.track, b.track AS identity_id, a.item_id, max(round(list_dot_product(a.vec, b.vec), 6)) AS best
             FROM cut a, cut b WHERE a.late AND NOT b.late GROUP BY ALL),
    life AS (SELECT track, min(frame) AS t0, max(frame) AS t1 FROM cut GROUP BY track),
    scored AS (SELECT track, identity_id, quantile_cont(best, 0.75) AS score FROM best GROUP BY ALL),
    cal AS (SELECT s.track, s.identity_id, (s.track = s.identity_id)::INT AS y, round(s.score, 8) AS score, s.score AS raw
            FROM scored s JOIN life a ON a.track = s.track JOIN life b ON b.track = s.identity_id
            WHERE s.track = s.identity_id OR (a.t0 <= b.t1 AND b.t0 <= a.t1 AND s.score != 0))"""
_KNN = """
    sim AS (SELECT a.item_id, b.item_id AS other, round(list_dot_product(a.vec, b.vec), 6) AS s FROM obs a, obs b WHERE b.item_id % 2 = 0),
    near AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, other) <= 5),
    knn AS (SELECT item_id, round(avg(1 - s), 6) AS score FROM near GROUP BY item_id)"""
_POS = """
    placed AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame, item_id) AS pos FROM blk),
    pos AS (SELECT x.track, x.item_id AS a, y.item_id AS b, x.vec AS va, y.vec AS vb, x.person AS person
            FROM placed x JOIN placed y ON x.track = y.track AND y.pos >= x.pos + 2)"""

ORACLE_SQL: dict[str, str] = {
    "knn_topk": f"""WITH {_OBS}, s AS (SELECT a.item_id AS query_id, b.item_id AS item_id, round(list_dot_product(a.vec, b.vec), 6) AS score
            FROM obs a JOIN obs b ON a.item_id != b.item_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM s QUALIFY rank <= 5""",
    "identity_topk": f"""WITH {_OBS}, s AS (SELECT a.item_id AS query_id, b.person AS identity_id, max(round(list_dot_product(a.vec, b.vec), 6)) AS score
            FROM obs a JOIN obs b ON a.item_id != b.item_id GROUP BY ALL)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity_id) AS rank, identity_id, score FROM s QUALIFY rank <= 3""",
    "similar_then_label": f"""WITH {_OBS}, s AS (SELECT a.item_id AS query_id, b.person AS identity_id, max(round(list_dot_product(a.vec, b.vec), 6)) AS score
            FROM obs a JOIN obs b ON a.item_id != b.item_id GROUP BY ALL),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity_id) AS rank, identity_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5 AND identity_id % 2 = 0""",
    "semantic_find_floor": f"""WITH {_OBS},
        part AS (SELECT person, u.pos, avg(u.x) AS x FROM obs, (SELECT unnest(vec) AS x, unnest(range(1, 65)) AS pos) u GROUP BY ALL),
        idx AS (SELECT person AS identity_id, [x / sqrt(sum(y * y)) FOR x IN list(x ORDER BY pos)] AS v FROM (SELECT *, x AS y FROM part) GROUP BY person),
        s AS (SELECT item_id AS query_id, identity_id, round(list_dot_product(vec, v), 6) AS score FROM obs, idx),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity_id) AS rank, identity_id, score FROM s)
        SELECT * FROM r WHERE rank <= 4 AND score >= 0.02""",
    "identity_prototype": f"""WITH {_OBS},
        part AS (SELECT person AS identity_id, u.pos, avg(u.x) AS x FROM obs, (SELECT unnest(vec) AS x, unnest(range(1, 65)) AS pos) u GROUP BY ALL)
        SELECT identity_id, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY identity_id)), 6) AS v FROM part""",
    "prototype_fold": f"""WITH {_OBS}, {_PROTO},
        mix AS (SELECT o.identity_id, o.pos, f.n * o.v + g.n * w.v AS x, least(f.lo, g.lo) AS first_seen, greatest(f.hi, g.hi) AS last_seen, f.n + g.n AS appearances
            FROM proto o JOIN proto w ON w.identity_id = o.identity_id AND w.pos = o.pos AND o.half = 0 AND w.half = 1
            JOIN fact f ON f.identity_id = o.identity_id AND f.half = 0 JOIN fact g ON g.identity_id = o.identity_id AND g.half = 1)
        SELECT identity_id, first_seen, last_seen, appearances, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY identity_id)), 6) AS v FROM mix""",
    "prototype_merge": f"""WITH {_OBS}, {_PROTO},
        mix AS (SELECT (o.identity_id // 2 * 2) AS identity_id, o.pos, sum(f.n * o.v) / sum(f.n) AS x, min(f.lo) AS first_seen, max(f.hi) AS last_seen, sum(f.n)::BIGINT AS appearances
            FROM proto o JOIN fact f ON f.identity_id = o.identity_id AND f.half = 0 WHERE o.half = 0 GROUP BY 1, 2)
        SELECT identity_id, first_seen, last_seen, appearances, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY identity_id)), 6) AS v FROM mix""",
    "diverse_exemplars": f"""WITH RECURSIVE {_OBS},
        mean AS (SELECT person, list(m ORDER BY pos) AS m FROM (SELECT person, u.pos, avg(u.x) AS m FROM obs, (SELECT unnest(vec) AS x, unnest(range(1, 65)) AS pos) u GROUP BY ALL) GROUP BY person),
        seed AS (SELECT person, item_id FROM obs JOIN mean USING (person) QUALIFY row_number() OVER (PARTITION BY person ORDER BY round(list_dot_product(vec, m), 9) DESC, item_id) = 1),
        pick AS (
            SELECT person, 1::BIGINT AS place, item_id, [item_id] AS chosen FROM seed
            UNION ALL
            SELECT person, place, item_id, chosen FROM (
                SELECT p.person, p.place + 1 AS place, o.item_id, list_append(p.chosen, o.item_id) AS chosen,
                    row_number() OVER (PARTITION BY p.person ORDER BY
                        (SELECT max(round(list_dot_product(o.vec, c.vec), 9)) FROM obs c WHERE c.person = p.person AND list_contains(p.chosen, c.item_id)), o.item_id) AS r
                FROM pick p JOIN obs o ON o.person = p.person AND NOT list_contains(p.chosen, o.item_id) WHERE p.place < 5) WHERE r = 1)
        SELECT person AS identity_id, place, item_id FROM pick""",
    "touch_identities": f"""WITH {_OBS},
        a AS (SELECT person AS identity_id, min(item_id)::DOUBLE AS first_seen, max(item_id)::DOUBLE AS l FROM obs WHERE item_id % 2 = 0 GROUP BY 1),
        b AS (SELECT person AS identity_id, max(item_id)::DOUBLE AS w FROM obs WHERE item_id % 5 = 1 GROUP BY 1)
        SELECT identity_id, first_seen, greatest(l, coalesce(w, l)) AS last_seen FROM a LEFT JOIN b USING (identity_id)""",
    "semantic_upsert": "SELECT c_custkey AS identity_id, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END, 6) AS v FROM customer",
    "store_integrity": """SELECT 'orphan' AS kind, event_id AS id FROM events WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'bare', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id * 11 FROM events)""",
    "backfill_pending": "SELECT c_custkey AS identity_id FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "largest_crop": """SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000)::BIGINT AS area FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000) DESC, o_orderkey) = 1""",
    "positive_pairs": f"WITH {_BLOCKS}, {_POS} SELECT track, a, b FROM pos",
    "labelled_positives": f"""WITH {_BLOCKS} SELECT x.item_id // 50 AS sequence, x.person, x.item_id AS a, y.item_id AS b FROM blk x JOIN blk y
        ON x.item_id // 50 = y.item_id // 50 AND x.person = y.person AND y.frame - x.frame >= 20""",
    "coalive_tracks": f"""WITH {_BLOCKS}, sp AS (SELECT track, min(frame) AS f, max(frame) AS l FROM blk GROUP BY track)
        SELECT a.track AS track_a, b.track AS track_b FROM sp a JOIN sp b ON a.track < b.track AND a.f <= b.l AND b.f <= a.l""",
    "negative_pairs": f"""WITH {_BLOCKS}, sp AS (SELECT track, min(frame) AS f, max(frame) AS l FROM blk GROUP BY track)
        SELECT a.track AS track_a, b.track AS track_b, x.item_id AS a, y.item_id AS b FROM sp a JOIN sp b ON a.track < b.track AND a.f <= b.l AND b.f <= a.l
        JOIN blk x ON x.track = a.track JOIN blk y ON y.track = b.track""",
    "hard_negatives": f"""WITH {_BLOCKS}, s AS (SELECT x.item_id AS a, y.item_id AS b, round(list_dot_product(x.vec, y.vec), 6) AS score
            FROM blk x JOIN blk y ON x.item_id // 50 = y.item_id // 50 AND x.person != y.person)
        SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s QUALIFY rank <= 3""",
    "pair_features": f"""WITH {_BLOCKS}, {_POS},
        l AS (SELECT a, b, u.x, u.y, abs(u.x - u.y) AS d, u.x * u.y AS p FROM pos, (SELECT unnest(va) AS x, unnest(vb) AS y) u)
        SELECT a, b, round(sum(p), 6) AS cosine, round(sqrt(sum(d * d)), 6) AS distance, round(avg(d), 6) AS diff_mean, round(stddev_pop(d), 6) AS diff_std,
            round(max(d), 6) AS diff_max, round(avg(p), 6) AS prod_mean, round(stddev_pop(p), 6) AS prod_std, round(min(p), 6) AS prod_min, round(max(p), 6) AS prod_max
        FROM l GROUP BY a, b""",
    "product_features": f"""WITH {_BLOCKS}, {_POS},
        l AS (SELECT a, b, u.x, u.y FROM pos, (SELECT unnest(va[1:8]) AS x, unnest(vb[1:8]) AS y) u)
        SELECT a, b, (2 * count(*) + 1)::BIGINT AS width, round(sum(x * y) + sum(abs(x - y)) + sum(x * y), 6) AS total FROM l GROUP BY a, b""",
    "group_split_pairs": f"""WITH {_BLOCKS}, {_POS}, p AS (SELECT a, b, person * 4 + a % 4 AS owner_a, person * 4 + b % 4 AS owner_b FROM pos)
        SELECT a, b, owner_a, owner_b, CASE WHEN owner_a % 10 < 3 THEN 'test' ELSE 'train' END AS side FROM p WHERE (owner_a % 10 < 3) = (owner_b % 10 < 3)""",
    "balanced_classes": """WITH c AS (SELECT quality AS y, count(*) AS n FROM labels GROUP BY 1) SELECT y, (SELECT min(n) FROM c) AS n FROM c""",
    "split_overlap": "SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 3 != 0",
    "auroc_metric": f"""WITH {_TRUTH}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM truth)
        SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auroc FROM r""",
    "trapezoid_auroc": f"""WITH {_TRUTH}, r AS (SELECT y, sum(y) OVER (ORDER BY score DESC, key ROWS UNBOUNDED PRECEDING) AS tp FROM truth)
        SELECT round(sum(tp) FILTER (y = 0)::DOUBLE / sum(y) / sum(1 - y), 9) AS auroc FROM r""",
    "youden_threshold": f"""WITH {_TRUTH}, c AS (SELECT DISTINCT score FROM truth),
        g AS (SELECT c.score, avg((t.score >= c.score)::INT) FILTER (t.y = 1) - avg((t.score >= c.score)::INT) FILTER (t.y = 0) AS gain FROM c, truth t GROUP BY c.score),
        l AS (SELECT *, lag(score) OVER (ORDER BY score) AS lower FROM g)
        SELECT (score + coalesce(lower, score)) / 2 AS threshold FROM l ORDER BY round(gain, 12) DESC, score LIMIT 1""",
    "false_merge_boundary": f"""WITH {_TRUTH}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM truth WHERE y = 0)
        SELECT n, floor(0.05 * n)::BIGINT AS allowed, score AS cut FROM r WHERE i = n - floor(0.05 * n)""",
    "confusion_rates": f"""WITH {_TRUTH}, c AS (SELECT count(*) FILTER (score >= 1500 AND y = 1) AS tp, count(*) FILTER (score >= 1500 AND y = 0) AS fp,
            count(*) FILTER (score < 1500 AND y = 0) AS tn, count(*) FILTER (score < 1500 AND y = 1) AS fn FROM truth)
        SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fn), 6) AS tpr, round(tn / (tn + fp), 6) AS tnr FROM c""",
    "threshold_sweep": f"""WITH {_TRUTH} SELECT t::DOUBLE AS threshold, round(avg((score >= t)::INT) FILTER (y = 1), 6) AS tpr, round(avg((score >= t)::INT) FILTER (y = 0), 6) AS fpr
        FROM truth, (VALUES (500), (1500), (3000)) v(t) GROUP BY t""",
    "score_summary": f"""WITH {_TRUTH} SELECT y, min(score) AS q0, round(quantile_cont(score, 0.05), 6) AS q5, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50,
        round(quantile_cont(score, 0.75), 6) AS q75, round(quantile_cont(score, 0.95), 6) AS q95, max(score) AS q100 FROM truth GROUP BY y""",
    "identity_score_quantile": f"""WITH {_OBS},
        placed AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame, item_id) AS place, count(*) OVER (PARTITION BY track) AS size FROM obs),
        cut AS (SELECT *, place > size // 2 AS late FROM placed WHERE size >= 4),
        best AS (SELECT a.track, b.track AS identity_id, a.item_id, max(round(list_dot_product(a.vec, b.vec), 6)) AS best FROM cut a, cut b WHERE a.late AND NOT b.late GROUP BY ALL)
        SELECT track, identity_id, round(quantile_cont(best, 0.75), 8) AS score FROM best GROUP BY ALL""",
    "calibration_scores": f"WITH {_CALIBRATION} SELECT track, identity_id, y, score FROM cal",
    "calibrated_boundary": f"""WITH {_CALIBRATION}, r AS (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM cal WHERE y = 0)
        SELECT n, floor(0.05 * n)::BIGINT AS allowed, score AS cut FROM r WHERE i = n - floor(0.05 * n)""",
    "real_returns": f"""WITH {_BLOCKS}, t AS (SELECT person, track, min(frame) AS s FROM blk GROUP BY ALL HAVING count(*) >= 2)
        SELECT person, arg_min(track, s) AS first_track, arg_max(track, s) AS last_track FROM t GROUP BY person HAVING count(*) >= 2""",
    "retrieval_rank_map": f"""WITH {_OBS}, o AS (SELECT * FROM obs),
        r AS (SELECT q.item_id AS q, q.person = g.person AS hit, row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(q.vec, g.vec), 6) DESC, g.item_id) AS rank
            FROM o q JOIN o g ON q.track != g.track WHERE EXISTS (SELECT 1 FROM o z WHERE z.person = q.person AND z.track != q.track)),
        h AS (SELECT q, rank, row_number() OVER (PARTITION BY q ORDER BY rank) AS nth FROM r WHERE hit),
        p AS (SELECT q, min(rank) AS f, avg(nth / rank) AS ap FROM h GROUP BY q)
        SELECT count(*) AS queries, round(avg((f <= 1)::INT), 6) AS rank1, round(avg((f <= 5)::INT), 6) AS rank5, round(avg((f <= 10)::INT), 6) AS rank10, round(avg(ap), 6) AS map FROM p""",
    "mean_similarity": f"""WITH {_OBS}, s AS (SELECT x.person, round(list_dot_product(x.vec, y.vec), 6) AS s FROM obs x JOIN obs y ON x.person = y.person AND x.item_id < y.item_id)
        SELECT person, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 8) AS median, count(*) AS pairs FROM s GROUP BY person""",
    "iou_pairs": f"""WITH {_DET}, p AS (SELECT a.frame, a.det_idx AS a_det_idx, b.det_idx AS b_det_idx, {_IOU} AS iou,
            sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1)) / 10 AS distance FROM det a JOIN det b ON a.frame = b.frame AND a.det_idx < b.det_idx)
        SELECT frame, a_det_idx, b_det_idx, round(iou, 6) AS iou, round(distance, 6) AS distance FROM p WHERE iou > 0""",
    "contested_detections": f"""WITH {_DET}, p AS (SELECT a.frame, a.det_idx, {_IOU} AS iou FROM det a JOIN det b ON a.frame = b.frame WHERE a.det_idx % 2 = 0 AND b.det_idx % 2 = 1)
        SELECT frame, det_idx, count(*) AS deep FROM p WHERE iou > 0.2 GROUP BY ALL HAVING count(*) >= 2""",
    "gt_attribution": f"""WITH {_DET}, p AS (SELECT a.frame, a.det_idx, b.det_idx AS id, round({_IOU}, 9) AS r FROM det a JOIN det b ON a.frame = b.frame WHERE a.det_idx % 2 = 0 AND b.det_idx % 2 = 1)
        SELECT frame, det_idx, id, round(r, 6) AS iou FROM p WHERE r >= 0.3 QUALIFY row_number() OVER (PARTITION BY frame, det_idx ORDER BY r DESC, id) = 1""",
    "nms_per_frame": f"""WITH RECURSIVE {_DET}, f AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) AS turn FROM det),
        hit AS (SELECT a.frame, a.turn AS kept, b.turn AS gone FROM f a JOIN f b ON a.frame = b.frame AND a.class_id = b.class_id AND a.turn < b.turn WHERE {_IOU} > 0.3),
        step AS (
            SELECT frame, 0::BIGINT AS turn, []::BIGINT[] AS kept FROM (SELECT DISTINCT frame FROM f)
            UNION ALL
            SELECT s.frame, s.turn + 1, CASE WHEN EXISTS (SELECT 1 FROM hit h WHERE h.frame = s.frame AND h.gone = s.turn + 1 AND list_contains(s.kept, h.kept))
                THEN s.kept ELSE list_append(s.kept, s.turn + 1) END
            FROM step s JOIN f ON f.frame = s.frame AND f.turn = s.turn + 1),
        last AS (SELECT frame, arg_max(kept, turn) AS kept FROM step GROUP BY frame)
        SELECT f.frame, f.det_idx FROM f JOIN last USING (frame) WHERE list_contains(last.kept, f.turn)""",
    "crop_geometry": f"""WITH {_DET}, c AS (SELECT frame, det_idx, greatest(0, least(round_even(x1, 0)::INT, 55)) AS px1, greatest(0, least(round_even(y1, 0)::INT, 15)) AS py1,
            greatest(0, least(round_even(x2, 0)::INT, 55)) AS px2, greatest(0, least(round_even(y2, 0)::INT, 15)) AS b FROM det),
        d AS (SELECT frame, det_idx, px1, py1, px2, py1 + round_even((b - py1) * 0.5::DOUBLE, 0)::INT AS py2 FROM c)
        SELECT frame, det_idx, px1::BIGINT AS px1, py1::BIGINT AS py1, px2::BIGINT AS px2, py2::BIGINT AS py2, px2 - px1 >= 4 AND py2 - py1 >= 4 AS usable FROM d""",
    "decoded_boxes": """WITH c AS (SELECT l_orderkey AS frame, l_linenumber::BIGINT AS row, l_partkey AS part, l_suppkey AS supp, l_quantity AS cx, l_discount * 100 AS cy,
            greatest(l_discount, l_tax, 0.05) AS score, CASE WHEN l_discount >= l_tax AND l_discount >= 0.05 THEN 0 WHEN l_tax >= 0.05 THEN 1 ELSE 2 END AS class_id FROM lineitem)
        SELECT frame, row, part, supp, round(score, 6) AS score, class_id::BIGINT AS class_id, round((cx - 4 - 2) / 0.5, 6) AS x1, round((cy - 2 - 1) / 0.5, 6) AS y1,
            round((cx + 4 - 2) / 0.5, 6) AS x2, round((cy + 2 - 1) / 0.5, 6) AS y2 FROM c WHERE score >= 0.06 AND class_id < 2""",
    "training_label_lines": f"""WITH {_DET}, f AS (SELECT frame, det_idx AS id, (x1 + x2) / 2 / 60 AS cx, (y1 + y2) / 2 / 20 AS cy, (x2 - x1) / 60 AS w, (y2 - y1) / 20 AS h
            FROM det WHERE det_idx / 7 >= 0.2)
        SELECT frame, id, format('0 {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', greatest(0, least(1, cx)), greatest(0, least(1, cy)), w, h) AS line FROM f WHERE w > 0 AND w <= 1 AND h > 0 AND h <= 1""",
    "embedding_schedule": f"""WITH {_EV}, h AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS hits FROM ev)
        SELECT event_id, user_id, hits FROM h WHERE value >= 20 AND (hits = 1 OR hits % 5 = 0)""",
    "track_lifecycle": f"WITH {_LIVES} SELECT *, CASE WHEN hits >= 3 THEN 'lost' ELSE 'dead' END AS state FROM lives",
    "coalive_spans": f"""WITH {_LIVES}, h AS (SELECT user_id * 100000 + island AS track, first // 3600000000 AS f, last // 3600000000 AS l FROM lives)
        SELECT a.track, count(*) FILTER (a.f <= b.l AND b.f <= a.l) AS closed, count(*) FILTER (a.f < b.l AND b.f < a.l) AS strict FROM h a JOIN h b ON a.track != b.track GROUP BY a.track""",
    "continuity_score": f"""WITH {_EV}, p AS (SELECT event_id, us - lag(us) OVER w AS gap, x1 - lag(x1) OVER w AS dx, y1 - lag(y1) OVER w AS dy FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
        SELECT event_id, round(coalesce(exp(-gap / 3600000000.0) * exp(-sqrt(dx * dx + dy * dy) / 10 / 20), 0), 6) AS score FROM p""",
    "recent_views": f"""WITH {_EV} SELECT event_id, count(*) OVER w AS views, round(avg(value) OVER w, 6) AS mean FROM ev
        WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS 2 PRECEDING)""",
    "newest_frame": "SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type",
    "scene_ranking": """SELECT l_suppkey, round(avg((l_returnflag = 'R')::INT), 6) AS share, count(*) AS n FROM lineitem GROUP BY 1
        ORDER BY round(avg((l_returnflag = 'R')::INT), 9) DESC, l_suppkey LIMIT 10""",
    "static_objects": f"""WITH {_EV}, e AS (SELECT user_id, max(value) AS peak, arg_min(value, (us, event_id)) AS f, arg_max(value, (us, event_id)) AS l FROM ev GROUP BY 1)
        SELECT user_id, peak < 200 AND sqrt((l - f) * (l - f) + (l / 2 - f / 2) * (l / 2 - f / 2)) < 50 AS static FROM e""",
    "identity_colours": "SELECT c_custkey, c_custkey * 37 % 206 + 50 AS r, c_custkey * 17 % 206 + 50 AS g, c_custkey * 29 % 206 + 50 AS b FROM customer",
    "binding_events": f"""WITH {_EV} SELECT hour // 24 AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase,
        count(*) FILTER (event_type = 'view') AS view, round(avg((value >= 50)::INT), 6) AS coverage FROM ev GROUP BY 1""",
    "label_histogram": "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang",
    "routed_vectors": f"""WITH {_OBS} SELECT item_id, u.pos, round(CASE WHEN (person % 2 = 0) = (u.pos <= 4) THEN vec[(u.pos - 1) % 4 + 1] ELSE 0 END, 6) AS v
        FROM obs, (SELECT unnest(range(1, 9)) AS pos) u""",
    "fused_vectors": f"""WITH {_OBS}, f AS (SELECT item_id, vec[1:32] AS d, vec[33:64] AS c FROM obs)
        SELECT a.item_id, round(0.7 * list_cosine_similarity(a.d, b.d) + 0.3 * list_cosine_similarity(a.c, b.c), 6) AS score FROM f a, f b WHERE b.item_id = 0""",
    "multi_view_cosine": f"""WITH {_OBS}, v AS (SELECT track, vec FROM obs QUALIFY row_number() OVER (PARTITION BY track ORDER BY frame DESC) <= 3)
        SELECT o.item_id, v.track, max(round(list_dot_product(o.vec, v.vec), 6)) AS best FROM obs o, v GROUP BY ALL""",
    "running_embedding": f"""WITH RECURSIVE {_OBS}, p AS (SELECT track, vec, row_number() OVER (PARTITION BY track ORDER BY frame, item_id) AS i FROM obs),
        r AS (SELECT track, i, vec AS m FROM p WHERE i = 1
            UNION ALL SELECT track, i, [x / sqrt(list_dot_product(s, s)) FOR x IN s] FROM (
                SELECT p.track, p.i, [(r.m[j] + p.vec[j]) / 2 FOR j IN range(1, 65)] AS s FROM r JOIN p ON p.track = r.track AND p.i = r.i + 1)),
        l AS (SELECT track, arg_max(m, i) AS m FROM r GROUP BY track)
        SELECT track, u.pos, round(m[u.pos], 6) AS v FROM l, (SELECT unnest(range(1, 65)) AS pos) u""",
    "class_means": f"WITH {_TRUTH} SELECT y, round(avg(score), 6) AS mean, count(*) AS n FROM truth GROUP BY y",
    "auroc_undefined": "SELECT NULL::DOUBLE AS auroc",
    "mined_pairs": "SELECT y, true AS different, y::DOUBLE AS one_owner FROM (VALUES (0), (1)) v(y)",
    "identity_counts": f"""WITH {_OBS}, c AS (SELECT person, count(*) AS n FROM obs GROUP BY person)
        SELECT count(*) AS identities, sum(n)::BIGINT AS exemplars, max(n) AS widest FROM c""",
    "still_known": f"""WITH {_OBS}, s AS (SELECT a.item_id AS query_id, b.person AS identity_id, max(round(list_dot_product(a.vec, b.vec), 6)) AS score
            FROM obs a JOIN obs b ON a.item_id != b.item_id GROUP BY ALL),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, identity_id) AS rank, identity_id, score FROM s)
        SELECT * FROM r WHERE rank <= 4 AND identity_id % 3 != 0""",
    "describable": f"""WITH {_DET} SELECT frame % 5000 AS identity_id, min(frame) AS frame FROM det
        WHERE det_idx % 2 = 0 AND x2 - x1 >= 10 AND y2 + det_idx * 8 - y1 >= 32 AND frame % 5000 >= 100 GROUP BY 1""",
    "session_tracks": f"""WITH {_EV}, g AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w < 43200000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
        i AS (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS island FROM g)
        SELECT user_id, min(us) AS first, max(us) + 43200000000 AS ends, count(*) AS hits FROM i GROUP BY user_id, island""",
    "return_scores": f"""WITH RECURSIVE {_BLOCKS}, t AS (SELECT person, track, min(frame) AS s FROM blk GROUP BY ALL HAVING count(*) >= 2),
        e AS (SELECT person, arg_min(track, s) AS f, arg_max(track, s) AS l FROM t GROUP BY person HAVING count(*) >= 2),
        st AS (SELECT b.person, item_id, vec FROM blk b JOIN e ON e.person = b.person AND e.f = b.track),
        mean AS (SELECT person, list(m ORDER BY pos) AS m FROM (SELECT person, u.pos, avg(u.x) AS m FROM st, (SELECT unnest(vec) AS x, unnest(range(1, 65)) AS pos) u GROUP BY ALL) GROUP BY person),
        pick AS (
            SELECT person, 1 AS place, [item_id] AS chosen FROM (SELECT person, item_id FROM st JOIN mean USING (person)
                QUALIFY row_number() OVER (PARTITION BY person ORDER BY round(list_dot_product(vec, m), 9) DESC, item_id) = 1)
            UNION ALL
            SELECT person, place, chosen FROM (SELECT p.person, p.place + 1 AS place, list_append(p.chosen, o.item_id) AS chosen,
                    row_number() OVER (PARTITION BY p.person ORDER BY
                        (SELECT max(round(list_dot_product(o.vec, c.vec), 9)) FROM st c WHERE c.person = p.person AND list_contains(p.chosen, c.item_id)), o.item_id) AS r
                FROM pick p JOIN st o ON o.person = p.person AND NOT list_contains(p.chosen, o.item_id) WHERE p.place < 5) WHERE r = 1),
        kept AS (SELECT st.* FROM st JOIN (SELECT person, arg_max(chosen, place) AS chosen FROM pick GROUP BY person) c ON c.person = st.person AND list_contains(c.chosen, st.item_id)),
        q AS (SELECT b.person, b.item_id, b.vec FROM blk b JOIN e ON e.person = b.person AND e.l = b.track),
        best AS (SELECT q.person, k.person AS identity_id, q.item_id, max(round(list_dot_product(q.vec, k.vec), 6)) AS best FROM q, kept k GROUP BY ALL)
        SELECT person, identity_id, (person = identity_id)::INT AS y, round(quantile_cont(best, 0.75), 8) AS score FROM best GROUP BY ALL""",
    "track_kalman": f"""WITH RECURSIVE {_EV}, z AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS "at",
            (x1 + x2) / 2 AS zx, (y1 + y2) / 2 AS zy, x2 - x1 AS zw, y2 - y1 AS zh FROM ev),
        k AS (SELECT user_id, "at", zx AS cx, zy AS cy, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, zw AS w, zh AS h, 10.0::DOUBLE AS a, 0.0::DOUBLE AS b, 10.0::DOUBLE AS c, 10.0::DOUBLE AS s FROM z WHERE "at" = 1
            UNION ALL
            SELECT user_id, "at", cx + g * (zx - cx), cy + g * (zy - cy), vx + q * (zx - cx), vy + q * (zy - cy), w + r * (zw - w), h + r * (zh - h), (1 - g) * a, (1 - g) * b, c - q * b, (1 - r) * s FROM (
                SELECT *, a / (a + 1) AS g, b / (a + 1) AS q, s / (s + 10) AS r FROM (
                    SELECT z.user_id, z."at", zx, zy, zw, zh, cx + vx AS cx, cy + vy AS cy, vx, vy, greatest(w, 2) AS w, greatest(h, 2) AS h, a + 2 * b + c + 1 AS a, b + c AS b, c + 0.01 AS c, s + 1 AS s
                    FROM k JOIN z ON z.user_id = k.user_id AND z."at" = k."at" + 1)))
        SELECT user_id, "at", round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM k""",
    "track_single": f"""WITH RECURSIVE {_EV}, z AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n,
            (x1 + x2) / 2 AS zx, (y1 + y2) / 2 AS zy, x2 - x1 AS zw, y2 - y1 AS zh FROM ev),
        k AS (SELECT user_id, n, 1::BIGINT AS id, zx AS cx, zy AS cy, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, zw AS w, zh AS h, 10.0::DOUBLE AS a, 0.0::DOUBLE AS b, 10.0::DOUBLE AS c, 10.0::DOUBLE AS s,
                1::BIGINT AS hits, 0::BIGINT AS lost_hits, 0.0::DOUBLE AS lx, 0.0::DOUBLE AS ly, 0.0::DOUBLE AS lw, 0.0::DOUBLE AS lh FROM z WHERE n = 1
            UNION ALL
            SELECT user_id, n, CASE WHEN met THEN id ELSE id + 1 END, CASE WHEN met THEN cx + a / (a + 1) * (zx - cx) ELSE zx END, CASE WHEN met THEN cy + a / (a + 1) * (zy - cy) ELSE zy END,
                CASE WHEN met THEN vx + b / (a + 1) * (zx - cx) ELSE 0 END, CASE WHEN met THEN vy + b / (a + 1) * (zy - cy) ELSE 0 END,
                CASE WHEN met THEN w + s / (s + 10) * (zw - w) ELSE zw END, CASE WHEN met THEN h + s / (s + 10) * (zh - h) ELSE zh END,
                CASE WHEN met THEN a / (a + 1) ELSE 10 END, CASE WHEN met THEN b / (a + 1) ELSE 0 END, CASE WHEN met THEN c - b * b / (a + 1) ELSE 10 END, CASE WHEN met THEN s * 10 / (s + 10) ELSE 10 END,
                CASE WHEN met THEN hits + 1 ELSE 1 END, CASE WHEN met THEN 0 ELSE hits END, cx, cy, w, h FROM (
                SELECT *, common / (w * h + zw * zh - common) >= 0.3 OR sqrt((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy)) / ((greatest(w, 1) + greatest(zw, 1)) / 2) <= 2 AS met FROM (
                    SELECT *, greatest(least(cx + w / 2, zx + zw / 2) - greatest(cx - w / 2, zx - zw / 2), 0) * greatest(least(cy + h / 2, zy + zh / 2) - greatest(cy - h / 2, zy - zh / 2), 0) AS common FROM (
                        SELECT z.user_id, z.n, k.id, zx, zy, zw, zh, cx + vx AS cx, cy + vy AS cy, vx, vy, greatest(w, 2) AS w, greatest(h, 2) AS h, a + 2 * b + c + 1 AS a, b + c AS b, c + 0.01 AS c, s + 1 AS s, hits
                        FROM k JOIN z ON z.user_id = k.user_id AND z.n = k.n + 1)))),
        t AS (SELECT user_id, n, id, cx, cy, w, h, hits, 0::BIGINT AS quiet, 'active' AS state FROM k WHERE hits >= 2
            UNION ALL SELECT user_id, n, id - 1, lx, ly, lw, lh, lost_hits, 1, 'lost' FROM k WHERE lost_hits >= 2)
        SELECT user_id::VARCHAR AS seq, n::INT AS frame, id AS track_id, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2,
            hits, quiet AS time_since_update, state FROM t""",
    "label_files": f"""WITH {_DET} SELECT 's' || frame % 4 AS seq, frame, det_idx AS id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(det_idx / 8, 6) AS visibility
        FROM det WHERE det_idx % 5 != 0 AND class_id = 1""",
    "sequence_files": """SELECT n_name AS seq, CASE WHEN n_nationkey % 3 = 0 THEN 30 ELSE 20 + n_regionkey END::DOUBLE AS fps, (n_nationkey + 1)::INT AS length, 640 AS width, 0 AS height FROM nation""",
    "frame_cache": "SELECT DISTINCT 's' || l_orderkey % 3 AS seq, l_orderkey AS frame FROM lineitem WHERE l_orderkey % 4 > 1",
    "store_round_trip": f"""WITH {_OBS} SELECT person AS identity_id, 'person' AS label, min(item_id)::DOUBLE AS first_seen, max(item_id)::DOUBLE AS last_seen, count(*) AS appearances, count(*) AS exemplars, 64::BIGINT AS width
        FROM obs WHERE person != 3 GROUP BY person""",
    "projected_vectors": f"""WITH {_OBS}, z AS (SELECT item_id, list_sum([vec[i] FOR i IN range(1, 65, 2)]) AS a, list_sum([vec[i] FOR i IN range(2, 65, 2)]) AS b FROM obs)
        SELECT item_id, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b FROM z""",
    "knn_anomaly": f"WITH {_OBS}, {_KNN} SELECT item_id, score FROM knn WHERE item_id % 2 = 1",
    "anomaly_percentile": f"""WITH {_OBS}, {_KNN} SELECT a.item_id, a.score, round(avg((b.score < a.score)::INT), 6) AS share FROM knn a, knn b
        WHERE a.item_id % 2 = 1 AND b.item_id % 2 = 0 GROUP BY ALL""",
    "mahalanobis_2d": f"""WITH {_OBS}, n AS (SELECT vec[1] AS a, vec[2] AS b FROM obs WHERE item_id % 2 = 0),
        c AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab FROM n),
        s AS (SELECT ma, mb, 0.9 * va + 0.05 * (va + vb) AS p, 0.9 * vb + 0.05 * (va + vb) AS q, 0.9 * ab AS r FROM c)
        SELECT item_id, round(sqrt((q * (vec[1] - ma) * (vec[1] - ma) - 2 * r * (vec[1] - ma) * (vec[2] - mb) + p * (vec[2] - mb) * (vec[2] - mb)) / (p * q - r * r)), 6) AS score
        FROM obs, s WHERE item_id % 2 = 1""",
    "patch_anomaly": """WITH p AS (SELECT vec_id AS crop_id, (u.pos // 8) AS gy, u.pos % 8 AS gx, u.x * 4.0::DOUBLE AS t FROM embeddings, (SELECT unnest(embedding) AS x, unnest(range(0, 64)) AS pos) u),
        d AS (SELECT a.crop_id, a.gy, a.gx, round(1 - max(cos(a.t) * cos(b.t) + sin(a.t) * sin(b.t)), 9) AS d FROM p a, p b WHERE a.crop_id >= 40 AND b.crop_id < 40 GROUP BY ALL),
        m AS (SELECT c.crop_id, c.gy, c.gx, avg(n.d) AS m FROM d c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx), d n
            WHERE n.crop_id = c.crop_id AND n.gy = CASE WHEN dy = 0 THEN c.gy WHEN c.gy = 0 THEN 1 ELSE c.gy - 1 END AND n.gx = CASE WHEN dx = 0 THEN c.gx WHEN c.gx = 0 THEN 1 ELSE c.gx - 1 END GROUP BY ALL)
        SELECT crop_id, round(max(m), 6) AS score FROM m GROUP BY crop_id""",
}

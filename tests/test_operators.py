"""Operators against plain Python on small data, invariants, and edge rows."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quartzframe.functions import scalars
from quartzframe.operators import components, detection, drift, governance, images, ladder, metrics, models, profile, split, stats, submission
from quartzframe.plans import tables
from quartzframe.sources import readers, writers
from quartzframe.streaming import drift_stream


def test_rank_does_not_depend_on_partitions(spark):
    df = spark.range(0, 500).withColumn("h", tables.hash_key(F.col("id"), 1))
    want = {r["id"]: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r["h"]))}
    for n in (1, 7):
        assert {r["id"]: r["rank"] for r in tables.with_rank(df.repartition(n), [F.col("h")]).collect()} == want


def test_quantiles_equal_numpy(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(1).normal(size=301)] + [2.5] * 40
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None), ("b", float("nan"))], "g string, v double")
    got = {(r["g"], r["q"]): r["edge"] for r in tables.quantiles(df, "g", "v", [0, 0.1, 0.5, 0.99, 1]).collect()}
    for q in (0, 0.1, 0.5, 0.99, 1):
        assert got["a", q] == pytest.approx(np.quantile(values, q), abs=1e-8)
        assert got["b", q] == 1.0


def test_psi_of_a_table_with_itself_is_zero(spark):
    df = spark.range(0, 1000).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 30).cast("string").alias("b"), F.lit(1.0).alias("c"))
    rows = {r["feature"]: r for r in drift.report(df, df).collect()}
    assert all(abs(r["psi"]) < 1e-12 for r in rows.values())
    assert rows["b"]["type"] == "categorical" and rows["a"]["type"] == "numeric"


def test_drift_of_missing_and_unseen(spark):
    ref = spark.createDataFrame([(float(i),  "x") for i in range(100)] + [(None, None)], "v double, k string")
    cur = spark.createDataFrame([(float("nan"), "new")] * 30 + [(500.0, "x")] * 10, "v double, k string")
    rows = {r["feature"]: r for r in drift.report(ref, cur).collect()}
    assert rows["v"]["band"] == "major" and rows["k"]["unseen_share"] == pytest.approx(0.75)
    assert rows["v"]["low_n"]


def test_ks_equals_plain(spark):
    rng = random.Random(3)
    a, b = [rng.randint(0, 20) for _ in range(80)], [rng.randint(3, 25) for _ in range(50)]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in range(30))
    one = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "v double")
    assert drift.ks(one(a), one(b), ["v"]).first()["ks_d"] == pytest.approx(want)


def test_splits_are_whole_and_clean(spark):
    df = spark.range(0, 997).withColumn("g", F.col("id") % 23).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    rows = split.random_split(df, "id", 5, stratify="y")
    assert rows.count() == 997 and rows.select("id").distinct().count() == 997
    again = split.random_split(df.repartition(7), "id", 5, stratify="y")
    assert rows.exceptAll(again).count() == 0
    by_group = split.group_split(df, "g", 5)
    assert split.straddling(by_group, "g").count() == 0
    assert {r["split"] for r in by_group.select("split").distinct().collect()} == {"train", "val", "test"}
    in_time = split.temporal_split(df.withColumn("t", F.when(F.col("id") > 3, F.col("id"))), "t", "id")
    assert {r["split"] for r in in_time.where("t IS NULL").collect()} == {"test"}
    folds = split.group_k_fold(df, "g", 4)
    sizes = [r["s"] for r in folds.groupBy("fold").agg(F.sum("n").alias("s")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 45
    with pytest.raises(ValueError):
        split.split(df, "id", time="nothing")
    with pytest.raises(ValueError):
        split.group_split(df.withColumn("g", F.lit(1)), "g")


def test_duplicates_treat_nan_as_null(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0), (4, 1.0)], "id long, v double")
    assert split.duplicates(df, ["v"]).first()["n_duplicates"] == 2
    assert sorted(r["id"] for r in split.drop_duplicates(df, "id").collect()) == [1, 3]


def test_auc_is_symmetric_and_equals_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 6))) for _ in range(120)]
    df = spark.createDataFrame(rows, "y_true int, y_score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(want)
    assert metrics.roc_auc(df.withColumn("y_score", -F.col("y_score"))).first()["auc"] == pytest.approx(1 - want)
    assert metrics.roc_auc(df.where("y_true = 1")).count() == 0


def test_metrics_of_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "y_true double, y_pred double")
    row = metrics.regression(df).first()
    assert row["mape"] is None and row["mae"] == 0.5
    one = spark.createDataFrame([("a", "b")], "y_true string, y_pred string")
    assert metrics.classification(one).first()["f1_macro"] == 0.0
    with pytest.raises(ValueError):
        metrics.check_reserved(["y_true"])


def greedy_ap(truth, preds, t):
    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    used, hits = set(), []
    for p in sorted(preds, key=lambda p: (-p[3], p[0])):
        own = [(iou(p[4], g[3]), -g[0]) for g in truth if g[1] == p[1]]
        best, g = max(own, default=(0, 0))
        hit = best > 0 and best >= t and -g not in used
        if hit:
            used.add(-g)
        hits.append(hit)
    precision, n = [], 0
    for i, h in enumerate(hits):
        n += h
        precision.append(n / (i + 1))
    return sum(max(precision[i:]) for i, h in enumerate(hits) if h) / len(truth)


def test_average_precision_equals_greedy(spark):
    rng = random.Random(9)
    box = lambda: (rng.randint(0, 30), rng.randint(0, 30), rng.randint(5, 20), rng.randint(5, 20))
    truth = [(i, f"im{i % 4}", i % 2, box()) for i in range(40)]
    preds = [(i, f"im{i % 4}", i % 2, round(rng.random(), 1), box()) for i in range(120)]
    g = spark.createDataFrame([(i, m, c, *map(float, b)) for i, m, c, b in truth], "gt_id long, image_id string, class_id int, x double, y double, w double, h double")
    p = spark.createDataFrame([(i, m, c, s, *map(float, b)) for i, m, c, s, b in preds], "pred_id long, image_id string, class_id int, score double, x double, y double, w double, h double")
    got = {(r["threshold"], r["class_id"]): r["ap"] for r in detection.average_precision(g, p, (0.3, 0.5)).collect()}
    for t in (0.3, 0.5):
        for c in (0, 1):
            assert got[t, c] == pytest.approx(greedy_ap([x for x in truth if x[2] == c], [x for x in preds if x[2] == c], t))


def test_coco_document(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a/b.c.png", "width": 100, "height": 50}], "annotations": [{"id": 5, "image_id": 1, "category_id": 9, "bbox": [10, 10, 20, 20]}, {"id": 6, "image_id": 1, "category_id": 9, "bbox": [1, 2]}, {"id": 7, "image_id": 3, "category_id": 9, "bbox": [1, 2, 3, 4]}], "categories": [{"id": 9, "name": "x"}, {"id": 4, "name": "y"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc))
    i, a, c = detection.coco_tables(readers.read_coco(spark, str(path)))
    boxes = detection.coco_boxes(i, a, detection.class_map(c))
    assert [(r["image_id"], r["class_id"]) for r in boxes.collect()] == [("b.c", 1)]
    assert detection.yolo_labels(boxes).first()["label"] == "1 0.200000 0.400000 0.200000 0.400000"


def test_elo_equals_loop_and_keeps_the_sum(spark):
    rng = random.Random(4)
    rows, rating = [], {}
    for seq in range(200):
        a, b = rng.sample(["a", "b", "c"], 2)
        ra, rb = rng.randint(0, 2), rng.randint(0, 2)
        rows += [(seq, f"m{seq}", 0, a, float(ra), "DONE"), (seq, f"m{seq}", 1, b, float(rb), "DONE")]
        x, y = rating.get(a, 1500.0), rating.get(b, 1500.0)
        gain = 24 * ((1.0 if ra > rb else 0.0 if ra < rb else 0.5) - 1 / (1 + 10 ** ((y - x) / 400)))
        rating[a], rating[b] = x + gain, y - gain
    log = spark.createDataFrame(rows, "seq long, match_id string, slot int, agent string, reward double, status string")
    got = {r["agent"]: r["rating"] for r in ladder.elo(log.repartition(5)).collect()}
    assert got == pytest.approx(rating) and sum(got.values()) == pytest.approx(4500)


def test_outcomes_of_draws_and_missing_rewards(spark):
    log = spark.createDataFrame([(1, "m", 0, "a", 1.0, "DONE"), (1, "m", 1, "b", 1.0, "DONE"), (2, "n", 0, "a", None, "ERROR"), (2, "n", 1, "b", 0.0, "DONE")], "seq long, match_id string, slot int, agent string, reward double, status string")
    got = {(r["match_id"], r["slot"]): r["outcome"] for r in ladder.outcomes(log).collect()}
    assert got == {("m", 0): "draw", ("m", 1): "draw", ("n", 0): "unknown", ("n", 1): "win"}
    assert {r["outcome"] for r in ladder.outcomes(log, True).where("status = 'ERROR'").collect()} == {"loss"}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(150)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7)]
    e = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(n,) for n in [*range(151), *range(1000, 1080), 5000]], "node long")
    got = {r["node"]: r["component"] for r in components.connected_components(nodes, e).collect()}
    assert got == {n: 0 if n < 200 else 1000 if n < 2000 else 5000 for n in [*range(151), *range(1000, 1080), 5000]}
    assert components.connected_components(nodes, e.limit(0)).where("node <> component").count() == 0


def test_statistics_against_known_values(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("b", float(x)) for x in (2, 4, 6, 8, 10)], "g string, v double")
    row = stats.two_group(df, "g", "v").first()
    sa, sb = (5 / 3) / 4, 10 / 5  # sample variances over sizes
    assert row["t"] == pytest.approx((2.5 - 6) / (sa + sb) ** 0.5) and row["df"] == pytest.approx((sa + sb) ** 2 / (sa**2 / 3 + sb**2 / 4))
    assert stats.mann_whitney(df, "g", "v").first()["u"] == pytest.approx(3.0)
    run = stats.run(df, "two_group", "g", "v").first()
    assert run["method"] == "mann_whitney" and 0 < run["p_value"] < 1
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert stats.run(flat, "pearson", "x", "y").first()["verdict"] == "refuted"
    assert stats.run(df.where("g = 'a'"), "two_group", "g", "v").first()["verdict"] == "inconclusive"
    table = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5, "g string, k string")
    expected = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    assert stats.chi2(table, "g", "k").first()["chi2"] == pytest.approx(sum((abs(o - e) - 0.5) ** 2 / e for o, e in zip((10, 20, 30, 5), expected, strict=True)))
    parts = stats.parts(spark.range(0, 23).select("id", F.col("id").alias("x"), F.col("id").alias("y")), "x", "y", "id", 5)
    assert sorted(r["count"] for r in parts.groupBy("part").count().collect()) == [4, 4, 5, 5, 5]


def test_value_kinds(spark):
    cells = {" 1.5": "number", "1e5": "number", "1_000": "number", "1d": "text", "0x10": "text", "inf": "missing", "-Infinity": "missing", "NA": "missing", "": "missing", "nan": "missing", "None": "missing", "text": "text", ".5": "number", "5.": "number", "1__0": "text", "1e999": "missing", "+7": "number", "--1": "text"}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r["c"]: r["k"] for r in df.select("c", scalars.value_kind(F.col("c")).alias("k")).collect()} == cells


def test_scalars(spark):
    df = spark.createDataFrame([("a/b.tar.gz", 0.125), ("/x/.hidden", 2.675), ("plain", 1234567.125)], "p string, v double")
    assert [r[0] for r in df.select(scalars.stem_of(F.col("p"))).collect()] == ["b.tar", ".hidden", "plain"]
    assert [r[0] for r in df.select(scalars.fixed(F.col("v"), 2)).collect()] == ["%.2f" % v for v in (0.125, 2.675, 1234567.125)]


def test_submission_that_is_valid(spark):
    e = spark.createDataFrame([(1, "a", "0.5"), (2, "b", "0.5")], "line long, id string, p string")
    good = spark.createDataFrame([(1, "b", "0.1"), (2, "a", "0.2")], "line long, id string, p string")
    row = submission.check(good, e, ["p"]).first()
    assert row["status"] == "VALID" and row["order_differs"]
    assert submission.header_errors(["id", "q"], ["id", "p"]) == (["columns"], [])


def test_raw_cells_keep_ragged_lines(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('id,p\na,1\nb\n"c,d",2,3\n')
    raw = readers.read_cells(spark, str(path))
    assert [(r["line"], r["cells"]) for r in raw.orderBy("line").collect()] == [(1, ["id", "p"]), (2, ["a", "1"]), (3, ["b"]), (4, ["c,d", "2", "3"])]
    assert [r["line"] for r in submission.ragged(raw, 2).orderBy("line").collect()] == [3, 4]
    path.write_text('id,p\n1,"a\nb"\n2,"' + "x" * 400_000 + '"\n3,"say ""no"""\n')
    cells = [r["cells"] for r in readers.read_cells(spark, str(path)).orderBy("line").collect()]
    assert cells == [["id", "p"], ["1", "a\nb"], ["2", "x" * 400_000], ["3", 'say "no"']]


def test_box_submission_follows_the_sample(spark):
    p = spark.createDataFrame([(1, "a.png", 0, 0.5, 1.0, 2.0, 3.0, 4.005), (2, "a.png", 1, 0.75, 5.0, 6.0, 7.0, 8.0), (3, "z", 0, 0.9, 1.0, 1.0, 1.0, 1.0)], "pred_id int, image_id string, class_id int, score double, x double, y double, w double, h double")
    sample = spark.createDataFrame([(0, "b.x.png"), (1, "a.png"), (2, "a.jpg")], "line int, image_id string")
    got = detection.streak_submission(sample, p).orderBy("line").collect()
    box = "0.750000 5.00 6.00 7.00 8.00 0.500000 1.00 2.00 3.00 4.00"
    assert [(r["image_id"], r["prediction"].replace("4.01", "4.00"), r["n_boxes"]) for r in got] == [("b.x.png", "", 0), ("a.png", box, 2), ("a.jpg", box, 2)]
    assert detection.streak_submission(sample, p, ("x", "y", "w", "h", "conf"), most=1).where("line = 1").first()["prediction"] == "5.00 6.00 7.00 8.00 0.750000"
    with pytest.raises(ValueError):
        detection.streak_submission(sample, p, ("class", "conf", "x", "y", "w", "h"))
    row = detection.streak_manifest(sample, p).first()
    assert (row["n_images"], row["n_with_detections"], row["n_empty"], row["n_foreign"], row["warning"]) == (3, 2, 1, 1, "")
    assert detection.streak_manifest(sample.where("line = 0"), p).first()["warning"] == "no image has a box"


def test_tiny_values_stay_in_the_drift_report(spark):
    ref = spark.range(0, 4000).select((F.col("id") * 1e-13).alias("v"), F.lit(1.5).alias("same"), (F.col("id") % 2).cast("string").alias("t"))
    cur = spark.range(0, 4000).select((F.col("id") * 3e-13).alias("v"), F.lit(1.5).alias("same"))
    rows = {r["feature"]: r for r in drift.report(ref, cur).collect()}
    assert rows["v"]["band"] == "major" and rows["v"]["type"] == "numeric"
    row = drift.frame_summary(ref, cur, target="t").first()
    assert (row["missing_target"], row["ref_only"], row["n_ref"], row["overall"], row["top_feature"]) == ("t", "t", 4000, "major shift", "v")
    found = drift.ks(ref, cur, ["v"]).first()
    assert found["ks_p"] < 1e-6 and drift.ks(ref, ref, ["v"]).first()["ks_p"] == 1.0


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,z,d\n1,NA,true,1d\n2,0.5,false,b\n")
    df = readers.read_table(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"x": "bigint", "y": "double", "z": "boolean", "d": "string"} and df.where("y IS NULL").count() == 1
    (tmp_path / "b.txt").write_bytes("n;v\nJosé;1\n".encode("latin-1"))
    assert readers.read_sniffed(spark, str(tmp_path / "b.txt")).first()["n"] == "José"
    (tmp_path / "c.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(spark, str(tmp_path / "c.json")).count() == 2
    for name, text, want in (
        ("lines", '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n\n{"a": 3, "b": null}\n', [(1, "x"), (2, "y"), (3, None)]),
        ("lists", '{"a": [1, 2],\n "b": ["x", "y"]}', [(1, "x"), (2, "y")]),
        ("dicts", '{"a": {"0": 1, "1": 2, "10": 3}, "b": {"0": "x", "1": "y", "10": null}}', [(1, "x"), (2, "y"), (3, None)]),
        ("record", '{\n"a": 1,\n"b": "x"}', [(1, "x")]),
    ):
        (tmp_path / f"{name}.json").write_text(text)
        assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / f"{name}.json")).select("a", "b").collect()] == want
    (tmp_path / "q.csv").write_text('x,y\n1,"a\nb"\n2,c\n')
    assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / "q.csv")).collect()] == [(1, "a\nb"), (2, "c")]
    (tmp_path / "log.jsonl").write_text('{"run_id": "a", "seed": 1}\n\nbroken\n{"run_id": "b"}\n')
    assert governance.experiment_log(spark, str(tmp_path / "log.jsonl")).count() == 2
    (tmp_path / "p.csv").write_text("image_id,class_id,score,x,y,w,h\ni,3.0,0.5,1,2,3,4\n")
    assert readers.read_detections(spark, str(tmp_path / "p.csv")).first()["class_id"] == 3
    for ending in ("csv", "parquet", "json", "orc", "tsv"):
        writers.write_table(df.select("x"), str(tmp_path / f"out.{ending}"))
    rows = df.select("x").withColumn("split", F.lit("train"))
    writers.write_split(rows, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 2
    with pytest.raises(Exception, match="exist"):
        writers.write_split(rows, str(tmp_path / "split"))
    writers.write_ids(df.select(F.col("x").alias("image_id"), F.lit(0).alias("fold")), str(tmp_path / "ids"), ["fold"])
    writers.append_log(df.select("x"), str(tmp_path / "log"))
    assert "| x |" in writers.as_markdown(df.select("x"), "t") and writers.as_json(df.select("x").limit(1)).startswith("[{")
    with pytest.raises(NotImplementedError):
        readers.read_table(spark, "a.xlsx")


def png(values, depth):
    head = struct.pack(">IIBBBBB", len(values[0]), len(values), depth, 0, 0, 0, 0)
    body = b"".join(b"\x00" + b"".join(v.to_bytes(depth // 8, "big") for v in row) for row in values)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def test_png_keeps_16_bits_and_turned_images_share_a_hash(spark, tmp_path):
    import numpy as np

    image = (np.random.default_rng(5).random((32, 32)) * 60000).astype(int)
    (tmp_path / "a.png").write_bytes(png(image.tolist(), 16))
    (tmp_path / "b.png").write_bytes(png(np.rot90(image).tolist(), 16))
    (tmp_path / "c.png").write_bytes(png([[0x1234, 0x1334], [0x1434, 0x1534]], 16))
    (tmp_path / "d.png").write_bytes(b"broken")
    rows = images.decode_png(readers.read_images(spark, str(tmp_path)))
    by = {r["path"].rsplit("/", 1)[1]: r for r in rows.collect()}
    assert by["c.png"]["pixels"] == [0x1234, 0x1334, 0x1434, 0x1534] and by["d.png"]["error"]
    hashes = {r["path"].rsplit("/", 1)[1]: r["hash"] for r in images.image_hash(rows).collect()}
    assert hashes["a.png"] == hashes["b.png"] != hashes["c.png"] and hashes["d.png"] is None
    assert readers.list_images(spark, str(tmp_path)).count() == 4


def test_stretch(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0],), ([],)], "p array<double>")
    assert [r[0] for r in df.select(images.stretch(F.col("p"), 0.0, 1.0)).collect()] == [[0, 127, 255], [0, 0], []]


def test_test_lock(spark, tmp_path):
    lock = governance.TestLock(spark, str(tmp_path))
    with pytest.raises(PermissionError):
        lock.take("x")
    lock.take("x", allow=True)
    with pytest.raises(PermissionError):
        lock.take("y", allow=True)
    lock.clear()
    assert not lock.taken()


def test_models_fit_on_mixed_columns(spark):
    df = spark.range(0, 300).select("id", F.when(F.col("id") % 17 != 0, F.col("id") % 10).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("b"), (F.col("id") % 2).alias("t"))
    made = models.fit_predict(df.where("id < 200"), df.where("id >= 200"), "t", "classification", ["a", "b"])
    assert metrics.classification(made).first()["accuracy"] == 1.0
    assert "y_score" in made.columns


def test_stream_of_windows(spark, tmp_path):
    events = spark.range(0, 2000).select((F.timestamp_seconds(F.col("id") * 120)).alias("ts"), (F.col("id") % 50).cast("double").alias("v"))
    edges, counts = drift_stream.frozen_edges(events, "v")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = drift_stream.windowed_psi(stream, "ts", "v", edges, counts).writeStream.outputMode("complete").format("memory").queryName("psi").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["n"], round(r["psi"], 9)) for r in spark.table("psi").collect()} == {(r["n"], round(r["psi"], 9)) for r in drift_stream.windowed_psi(events, "ts", "v", edges, counts).collect()}


def test_png_round_trip(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png([[0, 100], [200, 300]], 16))
    rows = images.decode_png(readers.read_images(spark, str(tmp_path)))
    again = images.decode_png(images.encode_png(rows)).first()
    assert again["bit_depth"] == 8 and [round(p) for p in again["pixels"]] == [0, 84, 170, 255]


def test_small_guards(spark):
    assert detection.prediction_columns(["ID", "PredictionString"]) == ("ID", "PredictionString")
    assert detection.prediction_columns(["box", "image"]) == ("box", "image")
    labels = spark.createDataFrame([("a", "1 0 0 0 0\n1 0 0 0 0")], "image_id string, label string")
    assert detection.require_labels(labels) == 2
    with pytest.raises(ValueError):
        detection.require_labels(labels.limit(0))
    df = spark.createDataFrame([(1, "train")], "id long, split string")
    with pytest.raises(ValueError):
        split.with_provenance(df)
    assert split.with_provenance(df, acknowledged=True).first()["split_provenance"].startswith("per-image")
    assert split.named_split(df, "Train").count() == 1


def test_refusals_and_flags(spark):
    items = spark.createDataFrame([("a1_x",), ("a1_y",), ("b7_x",)], "item string")
    assert {r["item"]: r["base"] for r in images.group_by_pattern(items, "item", r"^(.*)_[^_]+$").collect()} == {"a1_x": "a1", "a1_y": "a1", "b7_x": "b7"}
    for pattern in (r"a\d", r"(a\d)"):
        with pytest.raises(ValueError):
            images.group_by_pattern(items, "item", pattern)
    files, entries = spark.createDataFrame([("d/a.png",), ("d/b.png",)], "path string"), spark.createDataFrame([("a.jpg",)], "file_name string")
    assert [r["image_id"] for r in detection.without_entry(files, entries).collect()] == ["b"]
    with pytest.raises(ValueError):
        detection.require_entries(files, entries)
    wide = spark.range(1).select(*(F.lit(1).alias(f"c{i}") for i in range(501)))
    assert profile.wide_numeric(wide) and not profile.wide_numeric(wide.drop("c0"))
    assert models.require_tabular("gbt") == "gbt"
    for name in ("MLPClassifier", "torch-tabular", "dqn"):
        with pytest.raises(ValueError):
            models.require_tabular(name)


def test_holdout_keeps_groups_whole(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 17).alias("g"))
    got = split.holdout(df, "g").groupBy("g").agg(F.count_distinct("split").alias("sides"), F.first("split").alias("side")).collect()
    assert all(r["sides"] == 1 for r in got) and sum(r["side"] == "val" for r in got) == 4
    assert split.holdout(df.where("g < 2"), "g", 0.9).where("split = 'train'").select("g").distinct().count() == 1
    with pytest.raises(ValueError):
        split.holdout(df.where("g = 0"), "g")


def test_number_to_beat(spark):
    predictions = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y_true double, y_pred double")
    assert tuple(metrics.number_to_beat(spark, "regression", override="rmse=1,200.5").first()) == ("rmse", 1200.5, True, None)
    recorded = spark.createDataFrame([("f1_macro", 0.7, False)], "primary string, value double, lower_is_better boolean")
    assert tuple(metrics.number_to_beat(spark, "classification", recorded, predictions).first()) == ("f1_macro", 0.7, False, None)
    assert tuple(metrics.number_to_beat(spark, "regression", None, predictions).first()) == ("mae", 0.5, True, None)
    assert metrics.number_to_beat(spark, "regression").isEmpty()


def test_lineups_of_groups(spark):
    agents = spark.createDataFrame([(f"a{i}",) for i in range(5)], "agent string")
    got = ladder.group_lineups(agents, 4, 3).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(20)) and all(len(set(r["players"])) == 3 for r in got) and len({tuple(r["players"]) for r in got}) > 5
    few = ladder.group_lineups(agents.limit(2), 3, 4).collect()
    assert len(few) == 6 and all(len(r["players"]) == 4 and None not in r["players"] for r in few)
    assert ladder.group_lineups(agents.limit(0), 3, 4).isEmpty()


def test_held_out_ids_of_a_folder(spark, tmp_path):
    for k in (0, 1):
        (tmp_path / "s" / f"fold_{k}").mkdir(parents=True)
        (tmp_path / "s" / f"fold_{k}" / "val_ids.txt").write_text(f"im{k}\n\n x{k} \n")
    assert {tuple(r) for r in readers.read_held_out(spark, str(tmp_path / "s"), 1).collect()} == {("im1", "UNKNOWN"), ("x1", "UNKNOWN")}
    (tmp_path / "s" / "split_summary.json").write_text('{"split_provenance":\n "grouped by seq", "k": 2}')
    (tmp_path / "s" / "val_ids.txt").write_text("top\n")
    assert [tuple(r) for r in readers.read_held_out(spark, str(tmp_path / "s"), 1).collect()] == [("top", "grouped by seq")]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "note.md").write_text("A Report\n")
    with pytest.raises(ValueError):
        readers.read_held_out(spark, str(tmp_path / "empty"))
    assert readers.mentions(spark, str(tmp_path / "empty" / "note.md"), "report") and not readers.mentions(spark, str(tmp_path / "empty" / "note.md"), "slice")
    ids = spark.createDataFrame([(0, "val", "a"), (1, "train", "b")], "fold int, side string, image_id string")
    writers.write_ids(ids, str(tmp_path / "folds"), ["fold", "side"])
    assert {(r["fold"], r["side"], r["image_id"]) for r in readers.read_folds(spark, str(tmp_path / "folds")).collect()} == {(0, "val", "a"), (1, "train", "b")}

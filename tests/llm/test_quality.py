import numpy as np
from pyspark.sql import functions as F

from tabwright.llm.common import first_by_hash
from tabwright.llm.quality import (Learner, Linear, Sets, Teacher, classify, featured, fit_odds, good_documents, learn_quality,
                                   op7_quality, packed, score_quality, train)


def test_linear_model_and_calibration():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400).astype(float)
    rows = [np.unique(np.append(rng.integers(5, 50, 10), 1 if label and rng.random() < 0.9 else 2)) for label in y]
    model = train(rows, y, 60)
    z = model.margin(rows)
    assert ((z > 0) == (y > 0.5)).mean() > 0.9 and not model.weights[10:50].any()
    scale, shift = fit_odds(z[:, None], y)
    assert abs((1 / (1 + np.exp(-(scale * z + shift)))).mean() - y.mean()) < 0.02


def test_packed_features():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 262_144, n)).astype(np.int32) for n in (0, 1, 2, 3, 900, 0)]
    rows += [np.array([0], np.int32), np.array([262_143], np.int32), np.array([65_535, 131_070], np.int32)]
    sets = Sets.unpacked([packed(r) for r in rows])
    assert [r.tolist() for r in sets.rows()] == [r.tolist() for r in rows]
    model = Linear(rng.normal(size=262_144), 0.5)
    assert np.allclose(model.margin(sets), [0.5 + model.weights[r].sum() for r in rows])
    assert Sets.unpacked([]).rows() == []


def test_views_teach_each_other():
    """What one view is sure of trains the other; the learner that ships does it."""
    def rows(y):
        return ([np.array([1 if v else 2, 3], np.int32) for v in y], [np.array([5 if v else 6], np.int32) for v in y])
    y = np.random.default_rng(3).integers(0, 2, 200).astype(float)
    learner = Learner.start(rows(y), y)
    sure = Teacher(learner.models, learner.calibrations(), 0.9).decisions(tuple(map(Sets.of, rows(np.array([0, 1, 1])))))
    assert [s.tolist() for s in sure] == [[0, 1, 1]] * 2
    new = [np.array([9, 3], np.int32)] * 60  # a word that the labels do not have
    learner.teach([new, []], np.ones(60), np.zeros(0))
    fault = learner.finish()
    p = fault.probability([np.array([2, 3]), np.array([1, 3]), np.array([9, 3])], [np.array([6]), np.array([5]), np.array([7])])
    assert p[0] < 0.05 and p[1] > 0.95 and p[2] > 0.5


def test_held_out_labels(spark, small):
    """Fitted on two thirds of the labels, judged on the others; a smaller table has too few toxic labels to learn from."""
    folder = small.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    keep = {r.doc_id: r.keep for r in classify(docs, labels.where(~held)).collect()}
    rest = labels.where(held).collect()
    clean, toxic = ([keep[r.doc_id] for r in rest if (r.quality, r.toxic) == (1, 0)], [keep[r.doc_id] for r in rest if r.toxic])
    assert sum(clean) >= 0.95 * len(clean) > 50 and sum(toxic) <= 0.3 * len(toxic)


def test_first_by_hash(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 29_000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 300)).alias("g"), "id")
    got = sorted(map(tuple, first_by_hash(df, ["g"], "id", 7).select("g", "id", "_place").collect()))
    rows = {}
    for g, i, h in df.select("g", "id", F.xxhash64("id")).collect():
        rows.setdefault(g, []).append((h % 2 ** 64, i))
    want = sorted((g, i, n) for g, x in rows.items() for n, (_, i) in enumerate(sorted(x)[:7], 1))
    assert got == want


def test_labelled_documents(spark, small):
    folder = small.replace("0.001", "0.01")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op7_quality(spark, folder).collect()
    assert len(rows) == 1_000
    keep = {r.doc_id: r.keep for r in rows}
    clean = [keep[i] for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    toxic = [not keep[i] for i, r in labels.items() if r.toxic == 1]
    assert sum(clean) >= 0.97 * len(clean) and sum(toxic) >= 0.8 * len(toxic)


def test_odd_rows(spark, make_docs):
    items = [(i, "vile words here" if i % 3 == 0 else "kind words there") for i in range(150)]
    docs = make_docs([*items, (900, None), (901, ""), (None, "kind words there"), (902, "kind " * 60_000), (1, "kind words there")])
    docs = docs.withColumn("source", F.lit(None).cast("string")).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(None, 0, 0), (3, None, None), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == 155 and all(r.p_low == 0 for r in got)
    assert all(r.keep == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 150)
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id < 150").count() == 101
    assert all(r.keep for r in classify(docs, labels.limit(0)).collect())
    assert classify(docs.limit(0), labels).collect() == [] and good_documents(docs.limit(0), labels).collect() == []


def test_all_unlabelled_documents_teach(spark, make_docs):
    """A rare toxic word that no label has is learned, though few of many unlabelled documents hold it."""
    def row(i, text, source):
        return (i, text, "en", source, 500)
    docs = [row(i, "vile old words" if i % 2 else "kind old words", "bad" if i % 2 else "good") for i in range(400)]
    docs += [row(1_000 + i, "kind plain words", "good") for i in range(40_000)]
    docs += [row(100_000 + i, "wicked newword here", "bad") for i in range(10)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    faults = learn_quality(featured(docs), labels)
    test = spark.createDataFrame([(1, "wicked newword here", "en", "other", 500), (2, "kind plain words", "en", "other", 500)], docs.schema)
    p = {r.doc_id: r.p_toxic for r in score_quality(featured(test), faults).collect()}
    assert p[2] < 0.5 < p[1]


def test_repeated_id_teaches_once(spark, make_docs):
    docs = make_docs([(i, "vile words here" if i % 2 else "kind words there") for i in range(200)] + [(1, "kind words there")] * 3_000)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(160)], "doc_id long, quality int, toxic int")
    assert len(learn_quality(featured(docs), labels)["toxic"].content.weights) and all(
        r.keep == (r.doc_id % 2 == 0) for r in classify(docs, labels).where("doc_id > 1").collect())

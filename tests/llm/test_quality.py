"""Held-out accuracy of the quality classifier, and its odd inputs."""

import zlib

import numpy as np

from qaspark.llm import quality as Q
from qaspark.llm.queries import QUERIES
from qaspark.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    rows = QUERIES["op5_quality"](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    right = np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])
    assert right >= 0.95
    good = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    assert np.mean(good) >= 0.97


def test_labels_of_fold_one_are_never_used(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("quality", labels.quality - (Q.fold(labels.doc_id) == 1).cast("int") * (2 * labels.quality - 1))
    a, b = Q.train_quality(docs, labels), Q.train_quality(docs, flipped)
    assert (a.weight == b.weight).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(0, 500, 30), 1000 + i % 2)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    ratio = Q.log_count_ratio(rows, y)
    assert ratio[1001] > 0 > ratio[1000]
    w, bias = Q.dual_descent(rows, y, ratio)
    margins = np.array([ratio[r] / np.sqrt(np.sum(ratio[r] ** 2)) @ w[r] + bias for r in rows])
    assert (np.sign(margins) == y).all()


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "some words", 5), (3, "x " * 200_000, 5), (3, "x " * 200_000, 5)],
                                 "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify_quality(docs, none).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    model = Q.fit([Q.indicators(np.frombuffer(t, np.uint8)) for t in (b"good words here", b"bad!! bad!!") * 20], np.array([1, 0] * 20))
    kept = Q.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert Q.score_quality(docs.limit(0), model).collect() == []
    assert Q.keep_quality(docs.limit(0), model).collect() == []

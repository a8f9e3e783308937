"""Base spans against a plain-Python version; the trees only ever add."""

import pytest
from pyspark.sql import Row

from qaspark.llm import pii as P
from tests.conftest import SF_SMALL
from tests.llm import brute

HARD = [None, "", "a@b.c_d@e.f", "x@y@z.w", "a@b.com.@c.d", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.1.1.1 00000000000000001.2.3.4",
        "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "41111111111111111111111", "4111111111111111.", "+1 (663) 555-7297 x",
        "+1234567890123456", "é😀 mail: jo.do@ex-a.org, 10.0.0.1", "+1 2 +1 (234) 567-8901-", "a..b@-.-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
        "tel +49.30.1234567890", "@a.b", "%@a.b c@d", "5500005555555559" * 2, "a@b.c" * 700, "9" * 30_000, "1 " * 20_000, "x" * 40_000 + "@q.r"]


def test_base_spans_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "k int, body string")
    judge = P.SpanJudge("[]", (None,) * 4)
    got = {r["doc_id"]: [(s["start"], s["ord"], s["end"]) for s in r["base"]] for r in P.find_pii(df, "k", "body", judge).collect()}
    for i, t in enumerate(HARD):
        assert got[i] == brute.pii(t), (i, (t or "")[:60])


def test_query_contract(spark):
    from qaspark.llm.queries import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = QUERIES["op1_pii"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = brute.pii(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(o == i for _, o, _ in spans) for i in range(4)]
        assert r["base_sha256"] == brute.sha(brute.written(spans))
        assert set(filter(None, brute.written(spans).split(","))) <= set(r["spans"].split(","))


def test_trees_add_rewritten_spans_and_redact(spark):
    rows = [(i, f"write to u{i}.x@mail{i % 7}.org or call +1 ({200 + i}) 555-{1000 + i} soon, order {i * 37 % 91}-{i} of 12345{i}") for i in range(120)]
    rows += [(1000, "mail me: ann [at] site.org today"), (1001, "nothing here but 12 words and 2024-01-02 10:11:12")]
    df = spark.createDataFrame([Row(doc_id=i, text=t, base="clash", c=1) for i, t in rows])
    judge = P.train_judge(df)
    found = P.find_pii(df, judge=judge)
    by = {r["doc_id"]: r for r in found.collect()}
    assert [s["ord"] for s in by[1000]["added"]] == [0]
    assert by[1001]["added"] == [] and by[1001]["base"] == []
    clean = {r["doc_id"]: r["text"] for r in P.redact(found).collect()}
    assert "[EMAIL]" in clean[1000] and "ann" not in clean[1000]
    assert clean[5].startswith("write to [EMAIL] or call [PHONE] soon")


def test_empty_table_and_no_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.pii_report(empty).collect() == []
    plain = spark.createDataFrame([(None, None), (1, "no data"), (1, "no data")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in P.pii_report(plain).collect()) == [(0, ""), (1, ""), (1, "")]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1500])
def test_prefix_sums(spark, n):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(list(range(n)),)], "v array<int>")
    want = [sum(range(i)) for i in range(n)]
    assert df.select(P.prefix_sums(F.col("v"))).first()[0] == want


def test_judge_is_trained_on_every_document(spark, monkeypatch):
    import qaspark.llm.common as common
    seen = []
    plain = P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: seen.append(plain(df, name)) or seen[-1])
    monkeypatch.setattr(P, "dropped", lambda table: None)
    rows = [(i, f"mail u{i}@mail.org, id {1000000 + i}") for i in range(9000)]      # beyond the 8,000 of the earlier sample
    P.train_judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    data = seen[0]
    n = {(r["is_email"], r["label"]): r["n"] for r in data.groupBy("is_email", "label").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert n[1.0, 1.0] == 3 * 9000                                                # as it stands and in two rewritings
    assert n[0.0, 0.0] == 3 * 9000                                                # the number as three kinds
    assert data.count() < 1000                                                    # equal rows are one
    common.dropped(data)

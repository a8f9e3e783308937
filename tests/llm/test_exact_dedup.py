"""Exact deduplication: the index, its updates, and the query's SQL."""

import duckdb

from qaspark.llm.exact_dedup import DigestIndex, exact_dedup
from qaspark.llm.oracle import ORACLE_SQL
from qaspark.llm.queries import QUERIES
from tests.conftest import SF_SMALL

COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({ORACLE_SQL['op6_exact_dedup']})").fetchall()
    assert _rows(QUERIES["op6_exact_dedup"](spark, SF_SMALL)) == sorted(want)


def test_index_keeps_earlier_texts(spark):
    index = DigestIndex(spark, buckets=4)
    schema = "doc_id long, text string, keep_id string, digest int"
    one = spark.createDataFrame([(1, "a", "", 0), (5, "a", "", 0), (2, None, "", 0), (3, "", "", 0), (4, "x" * 300_000, "", 0)], schema)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(one, index=index).collect()}
    assert got == {1: (5, 2, False), 5: (5, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}
    two = spark.createDataFrame([(9, "a", "", 0), (7, "b", "", 0), (7, "b", "", 0), (None, "c", "", 0), (8, "c", "", 0)], schema)
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(two, index=DigestIndex(spark, index.path, 4)).collect()))
    assert got == [(0, 8, 2, False), (7, 7, 2, True), (7, 7, 2, True), (8, 8, 2, True), (9, 5, 3, False)]
    assert index.read().count() == 5
    assert exact_dedup(two.limit(0)).collect() == []


def test_counts_over_many_batches(spark, monkeypatch):
    """Groups grow over batches, segments are merged, reopened indexes agree."""
    monkeypatch.setattr("qaspark.llm.exact_dedup.MAX_SEGMENTS", 3)
    path = None
    seen = {}
    for n, batch in enumerate([["a", "a", "b"], ["a"], ["a", "c"], ["c", "c", None], ["a", "b", ""], ["a", "d"]]):
        index = DigestIndex(spark, path, buckets=3)
        path = index.path
        rows = [(10 * n + i, t) for i, t in enumerate(batch)]
        new = set()
        for i, t in rows:
            keep, size = seen.get(t or "", (None, 0))
            if keep is None or (t or "") in new:
                new.add(t or "")
                keep = i
            seen[t or ""] = (keep, size + 1)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in
               exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), index=index).collect()}
        assert got == {i: (*seen[t or ""], (t or "") in new and seen[t or ""][0] == i) for i, t in rows}
        assert len(index.segments()) <= 3
    assert {(r["keep_id"], r["group_size"]) for r in DigestIndex(spark, path).read().collect()} == set(seen.values())


def test_parts_give_the_same_rows(spark):
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(None, "t1"), (None, "only"), (None, "only"), (3, "t9"), (3, "t9"), (3, None), (41, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def listed(parts):
        return sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup(df, parts=parts).collect())
    assert listed(1) == listed(2) == listed(5) and len(listed(1)) == len(rows)
    assert exact_dedup(df.limit(0), parts=3).collect() == []
    assert len(exact_dedup(df.filter("doc_id IS NULL"), parts=2).collect()) == 3


def test_index_joins_without_shuffling_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    docs = spark.createDataFrame([(i, f"t{i % 50}") for i in range(100)], "doc_id long, text string")
    exact_dedup(docs, index=index)
    plan = index.missing(spark.createDataFrame([("x", 1, 1)], "digest string, keep_id long, group_size long"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text

"""The pipeline against plain-Python stages; each stage on its own input."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from qaspark.llm import decontaminate as D
from qaspark.llm.quality import indicators, train_quality
from qaspark.llm.tokens import vocabulary_path
from qaspark.sources.tables import table
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_tokens import _check_packing


def _plain(spark, docs):
    """The kept ids after each of the first four stages."""
    model = train_quality(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels"))
    docs = {d: t for d, t in docs.items() if model.score(indicators(np.frombuffer((t or "").encode(), np.uint8))) >= 0.5}
    yield docs
    last = {(t or ""): d for d, t in sorted(docs.items())}
    docs = {d: t for d, t in docs.items() if last[t or ""] == d}
    yield docs
    sets = {d: brute.shingle_set(t, C.SHINGLE_WORDS) for d, t in docs.items()}
    original, brute.shingle_set = brute.shingle_set, lambda t: original(t, C.SHINGLE_WORDS)
    try:
        docs = {d: docs[d] for d, (_, c) in brute.near_components(docs).items() if c == d}
    finally:
        brute.shingle_set = original
    assert set(docs) <= set(sets)
    yield docs
    items = [D._words(np.frombuffer(r["text"].lower().encode(), np.uint8))[0] for r in table(spark, SF_SMALL, "benchmark").collect()]

    def dirty(text):
        w = D._words(np.frombuffer((text or "").lower().encode(), np.uint8))[0]
        return any(D.align([h], [w[a:a + 6 * len(h)]])[0][0] >= D.MIN_SCORE * D.MATCH * len(h)
                   for h in items for a in range(0, len(w), 4 * len(h)))
    yield {d: t for d, t in docs.items() if not dirty(t)}


def test_run_equals_plain_stages(spark):
    source = table(spark, SF_SMALL, "documents")
    stages = list(_plain(spark, {r["doc_id"]: r["text"] for r in source.collect()}))
    docs = source
    for (name, stage), want in zip(C.STAGES, stages):
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == source.columns, name
        docs = spark.createDataFrame(docs.collect(), source.schema)
        assert {r["doc_id"] for r in docs.collect()} == set(want), name
    rows = C.run(spark, SF_SMALL).collect()
    _check_packing(rows, list(stages[-1].items()), Tokenizer.from_file(vocabulary_path()), 2048)


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_take_odd_rows(spark, stage):
    schema = table(spark, SF_SMALL, "documents").schema
    good = table(spark, SF_SMALL, "documents").limit(20).collect()
    odd = [(None, "a text without id", None, None, None), (None, None, None, None, None), (900001, None, "en", "s", 0), (900002, "", "en", "s", 0)]
    docs = spark.createDataFrame([tuple(r) for r in good] + [tuple(good[0])] + odd, schema)
    out = stage(spark, docs, SF_SMALL)
    if stage is not C.pack:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, docs.limit(0), SF_SMALL).collect() == []


def test_rows_are_judged_by_their_text(spark):
    """Missing and repeated ids: one row of each text and of each group stays, copies of a test item go."""
    source = table(spark, SF_SMALL, "documents")
    item = max((r["text"] for r in table(spark, SF_SMALL, "benchmark").collect()), key=len)
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(None, body), (7, body), (7, body), (7, "another text"), (None, "only here"), (None, "only here"), (None, item), (8, item), (9, body + " more")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], source.schema)

    def left(df):
        assert df.columns == source.columns
        return sorted(((r["doc_id"] or -1, r["text"]) for r in df.collect()))
    one = C.exact(spark, docs, SF_SMALL)
    want = [(-1, "only here"), (7, "another text"), (7, body), (8, item), (9, body + " more")]
    assert left(one) == sorted(want)
    near = C.near(spark, docs, SF_SMALL)
    assert left(near) == sorted([(-1, "only here"), (7, "another text"), (7, body), (8, item)])
    clean = C.decontaminate(spark, docs, SF_SMALL)
    assert left(clean) == sorted((d or -1, t) for d, t in rows if t != item)

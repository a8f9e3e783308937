"""Answers kept between runs: who is asked, what is retried, what a row gets."""

import os

import pandas as pd
import pytest

from qaspark.functions.text import GEN_ERROR
from qaspark.operators.answer_store import AnswerStore, model_key

CONFIG = {"name": "m", "model_type": "test", "temperature": 0}


def _model(log, bad=()):
    """Upper-cases; writes every prompt it is asked to ``log``, fails on those in ``bad``."""
    def generate(prompts: pd.Series) -> list:
        if len(prompts) > 1 and any(p in bad for p in prompts):
            raise ValueError("batch")
        for p in prompts:
            with open(log, "a", encoding="utf-8") as f:
                f.write(f"{p}\n")
            if p in bad:
                raise ValueError("bad prompt")
        return [None if p is None else p.upper() for p in prompts]
    return generate


def _asked(log):
    lines = sorted(open(log, encoding="utf-8").read().split("\n")[:-1]) if os.path.exists(log) else []
    if os.path.exists(log):
        open(log, "w").close()
    return lines


@pytest.fixture()
def log(tmp_path):
    return str(tmp_path / "asked.txt")


def test_second_run_asks_for_failed_prompts_only(spark, tmp_path, log):
    store = AnswerStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(["a", "b", "a", "c", "", None, "a"])], "k int, prompt string, error string")
    first = {r["k"]: r for r in store.answer(df, CONFIG, generate=_model(log, bad=("c",)), known_col="known", tasks=2).collect()}
    assert [first[i]["raw_answer"] for i in range(7)] == ["A", "B", "A", GEN_ERROR, "", None, "A"]
    assert first[3]["error"] == "ValueError: bad prompt" and not any(first[i]["error"] for i in (0, 1, 2, 4, 5, 6))
    assert not any(r["known"] for r in first.values())
    assert set(_asked(log)) >= {"a", "b", "c", ""}
    again = {r["k"]: r for r in store.answer(df, CONFIG, generate=_model(log), known_col="known", tasks=2).collect()}
    assert _asked(log) == ["c"]
    assert [again[i]["raw_answer"] for i in range(7)] == ["A", "B", "A", "C", "", None, "A"]
    assert [again[i]["known"] for i in range(7)] == [True, True, True, False, True, True, True]
    assert again[3]["error"] is None
    store.answer(df, CONFIG, generate=_model(log)).collect()
    assert _asked(log) == []


def test_prompt_is_asked_once_and_survives_reads(spark, tmp_path, log):
    store = AnswerStore(spark, str(tmp_path / "store"))
    df = spark.range(500).selectExpr("id", "concat('p', id % 3) AS prompt")
    out = store.answer(df, CONFIG, generate=_model(log), tasks=4)
    assert out.count() == 500 and out.groupBy("raw_answer").count().count() == 3
    assert _asked(log) == ["p0", "p1", "p2"]                  # whatever was read how often


def test_models_and_settings_are_apart_and_errors_stay_until_mended(spark, tmp_path, log):
    store = AnswerStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("x",)], "prompt string")
    other = {**CONFIG, "temperature": 1}
    assert model_key(other) != model_key(CONFIG) == model_key(dict(reversed(CONFIG.items())))
    assert store.answer(df, CONFIG, generate=_model(log, bad=("x",))).first()["raw_answer"] == GEN_ERROR
    assert store.answer(df, other, generate=_model(log)).first()["raw_answer"] == "X"
    assert store.rows(CONFIG).first()["error"] == "ValueError: bad prompt"
    assert store.answer(df, CONFIG, generate=_model(log)).first()["raw_answer"] == "X"
    _asked(log)
    store.compact([CONFIG, other])
    assert len([f for f in os.listdir(tmp_path / "store") if any(os.scandir(tmp_path / "store" / f))]) >= 2
    for config in (CONFIG, other):
        row = store.answer(df, config, generate=_model(log), known_col="known").first()
        assert (row["raw_answer"], row["known"]) == ("X", True)
    assert _asked(log) == []


def test_registered_model_and_empty_table(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], "prompt string")
    assert store.answer(empty, {"model_type": "constant"}).collect() == []
    df = spark.createDataFrame([("x",), ("y",)], "prompt string")
    assert {r["raw_answer"] for r in store.answer(df, {"model_type": "constant"}).collect()} == {"Test answer"}
    with pytest.raises(ValueError, match="unknown model_type"):
        store.answer(df, {"model_type": "nothing"})

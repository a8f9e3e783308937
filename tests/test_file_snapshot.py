"""The source snapshot notices changed, new and dropped files and parses nothing else."""

import json
import os

import pytest

from qaspark.sources import file_snapshot as S
from qaspark.sources.qa_jsonl import read_qa


def _put(folder, name, rows, at=None):
    path = folder / name
    path.write_text("".join(json.dumps({"question_id": i, "question": q, "answer": [q]}) + "\n" for i, q in rows), encoding="utf-8")
    if at:
        os.utime(path, (at, at))


@pytest.fixture()
def source(tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    for name in ("a.jsonl", "b c%20d.jsonl", "e+f.jsonl", "g[1]{2}*.jsonl"):
        _put(folder, name, [(i, f"{name} {i}") for i in range(3)], at=1_700_000_000)
    return folder


def _questions(df):
    return sorted(r["question"] for r in df.collect())


def _parsed(snap):
    return sorted(os.path.basename(p) for p in snap.parsed)


def test_only_changed_files_are_parsed(spark, source, tmp_path):
    snap = S.FileSnapshot(spark, str(source), str(tmp_path / "snap"))
    first = snap.read()
    plain = read_qa(spark, str(source))
    assert first.dtypes == plain.dtypes and sorted(map(str, first.collect())) == sorted(map(str, plain.collect()))
    assert _parsed(snap) == ["a.jsonl", "b c%20d.jsonl", "e+f.jsonl", "g[1]{2}*.jsonl"]
    snap.read()
    assert snap.parsed == []
    _put(source, "a.jsonl", [(9, "other")], at=1_700_000_050)
    assert "other" in _questions(snap.read()) and len(_questions(snap.read())) == 10
    _put(source, "a.jsonl", [(9, "othet")], at=1_700_000_090)          # same size, later
    changed = snap.read()
    assert _parsed(snap) == ["a.jsonl"] and _questions(changed) == _questions(read_qa(spark, str(source)))
    (source / "e+f.jsonl").unlink()
    _put(source, "new.jsonl", [(1, "fresh")])
    now = snap.read()
    assert _parsed(snap) == ["new.jsonl"] and _questions(now) == _questions(read_qa(spark, str(source)))


def test_many_runs_merge_and_unfinished_ones_are_not_read(spark, source, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MERGE_RUNS", 2)
    snap = S.FileSnapshot(spark, str(source), str(tmp_path / "snap"))
    snap.read()
    for i in range(3):
        _put(source, "a.jsonl", [(i, f"round {i}")], at=1_700_000_100 + i)
        assert f"round {i}" in _questions(snap.read())
        assert len(os.listdir(tmp_path / "snap")) <= 2
    run = next(iter(snap._runs()))
    os.unlink(run.removeprefix("file:") + "/files/_SUCCESS")           # as if the run had died
    assert _questions(snap.read()) == _questions(read_qa(spark, str(source)))
    assert snap.parsed


def test_malformed_line_keeps_nothing_and_missing_source_fails(spark, source, tmp_path):
    (source / "bad.jsonl").write_text("{not json\n", encoding="utf-8")
    snap = S.FileSnapshot(spark, str(source), str(tmp_path / "snap"))
    with pytest.raises(Exception):
        snap.read().collect()
    assert snap._held() == {}
    lenient = S.FileSnapshot(spark, str(source), str(tmp_path / "snap2"), strict=False)
    assert len(_questions(lenient.read())) == 12
    lenient.read()
    assert lenient.parsed == []                                        # a file without items is known, too
    with pytest.raises(Exception):
        S.FileSnapshot(spark, str(tmp_path / "none"), str(tmp_path / "snap3")).read()

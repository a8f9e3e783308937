"""The column functions as Spark SQL functions, for users who write SQL.

``register_sql_functions(spark)`` defines session-scoped SQL functions whose
bodies are SQL expressions (``CREATE TEMPORARY FUNCTION … RETURN …``): the
analyser inlines them into the plan, so they run in the JVM like the Column
versions -- no Python is involved. The patterns are the fixed values of
:mod:`qaspark.functions.text`.

    SELECT qa_token_recall(reply, array(question)) FROM pairs
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .naming import DEFAULT_MEMORY_GB, GB_PER_BILLION_PARAMS
from .text import GEN_ERROR, NO_ANSWER, OPENER_PATTERNS, THINK_PATTERNS, WORD_RE, WS_CHARS, WS_CLASS


def _lit(s: str) -> str:
    """A Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _clean_body(patterns: list[str]) -> str:
    """collapse → each pattern removed in order → collapse → sentinel if empty."""
    expr = "qa_collapse_ws(coalesce(t, ''))"
    for p in patterns:
        expr = f"regexp_replace({expr}, {p}, '')"
    return (f"transform(array(qa_collapse_ws({expr})), "
            f"c -> CASE WHEN c = '' THEN {_lit(NO_ANSWER)} ELSE c END)[0]")


def _definitions() -> list[str]:
    word, ws = _lit(WORD_RE), WS_CLASS
    ws_chars = "'" + "".join(f"\\u{ord(c):04x}" for c in WS_CHARS) + "'"   # \uXXXX escapes
    collapse = _lit(ws + "+")
    think = [_lit(p) for p in THINK_PATTERNS]
    openers = [_lit(p) for p in OPENER_PATTERNS]
    tf = "TEMPORARY FUNCTION"

    def words(x: str) -> str:
        return f"regexp_extract_all(lower({x}), {word}, 0)"

    def tokens(x: str) -> str:
        return f"array_distinct({words(x)})"
    pred = "coalesce(p, '')"
    return [
        f"CREATE OR REPLACE {tf} qa_words(t STRING) RETURNS ARRAY<STRING> "
        f"RETURN regexp_extract_all(lower(t), {word}, 0)",
        f"CREATE OR REPLACE {tf} qa_tokens(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(qa_words(t))",
        f"CREATE OR REPLACE {tf} qa_strip(t STRING) RETURNS STRING RETURN trim(BOTH {ws_chars} FROM t)",
        f"CREATE OR REPLACE {tf} qa_collapse_ws(t STRING) RETURNS STRING "
        f"RETURN qa_strip(regexp_replace(t, {collapse}, ' '))",
        # best token recall over the truths; truths without words are skipped
        # (word expressions are inlined: SQL functions cannot take lambda variables)
        f"CREATE OR REPLACE {tf} qa_token_recall(p STRING, truths ARRAY<STRING>) RETURNS DOUBLE RETURN "
        f"coalesce(transform(array({tokens(pred)}), pt -> "
        f"array_max(transform(filter(transform(truths, t -> {tokens('t')}), s -> size(s) > 0), "
        "s -> size(array_intersect(s, pt)) / size(s))))[0], 0.0)",
        # best substring recall over the non-empty truths
        f"CREATE OR REPLACE {tf} qa_substring_recall(p STRING, truths ARRAY<STRING>) RETURNS DOUBLE RETURN "
        "coalesce(array_max(transform(filter(truths, t -> t IS NOT NULL AND t <> ''), t -> "
        f"transform(array({words('t')}), w -> CASE WHEN size(w) = 0 THEN 0.0 ELSE "
        "size(filter(w, x -> instr(lower(coalesce(p, '')), x) > 0)) / size(w) END)[0])), 0.0)",
        f"CREATE OR REPLACE {tf} qa_clean_answer(t STRING) RETURNS STRING RETURN " + _clean_body(think + openers),
        f"CREATE OR REPLACE {tf} qa_is_sentinel(t STRING) RETURNS BOOLEAN "
        f"RETURN t IN ({_lit(NO_ANSWER)}, {_lit(GEN_ERROR)})",
        f"CREATE OR REPLACE {tf} qa_memory_estimate_gb(model_size STRING, model_name STRING) RETURNS DOUBLE "
        "RETURN transform(array(qa_strip(replace(model_size, 'B', ''))), s -> CASE "
        f"WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN try_cast(s AS DOUBLE) * {GB_PER_BILLION_PARAMS} "
        "WHEN contains(s, '0.6') OR contains(lower(model_name), '135m') THEN 2.0 "
        "WHEN contains(s, '1.7') OR contains(lower(model_name), '360m') THEN 4.0 "
        f"WHEN contains(s, '4') THEN 9.0 ELSE {DEFAULT_MEMORY_GB} END)[0]",
        f"CREATE OR REPLACE {tf} qa_run_name(model STRING, dataset STRING, mode STRING) RETURNS STRING "
        "RETURN concat_ws('_', model, dataset, mode)",
        f"CREATE OR REPLACE {tf} qa_file_stem(name STRING) RETURNS STRING RETURN translate(name, '/\\\\', '__')",
        f"CREATE OR REPLACE {tf} qa_bucket_name(mode STRING) RETURNS STRING "
        "RETURN lower(replace(mode, '_', '-'))",
    ]


SQL_FUNCTIONS = ("qa_words", "qa_tokens", "qa_strip", "qa_collapse_ws", "qa_token_recall", "qa_substring_recall",
                 "qa_clean_answer", "qa_is_sentinel", "qa_memory_estimate_gb", "qa_run_name", "qa_file_stem",
                 "qa_bucket_name")


def register_sql_functions(spark: SparkSession) -> tuple[str, ...]:
    """Define the ``qa_*`` SQL functions in this session; returns their names."""
    for stmt in _definitions():
        spark.sql(stmt)
    return SQL_FUNCTIONS

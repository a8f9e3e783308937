"""Aggregations over scored predictions, run statuses and logged values
(A1-A3, A5-A9, P13, P15, P16, F17, F18).

The aggregations run with map-side partial aggregation, so a run holding a
third of all rows is reduced per map task before the shuffle; the one ranking
(``distinct_values``) uses the block-split running count of
:mod:`qaspark.operators.sequence`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
# F17 metric categories: first match wins, by substring of the lower-cased name.
CATEGORY_RULES = (
    ("quality", ("recall", "precision", "f1")),
    ("memory", ("ram", "memory")),
    ("size", ("size",)),
)
# F18 display formats: first match wins.
#   bytes → integer with thousands separators; mb/ram → 2 decimals;
#   recall/precision/f1 → 4 decimals; time/duration/seconds → 2 decimals;
#   num/count/examples → integer (truncated toward zero); otherwise 4 decimals.
# Task statuses used by the batch roll-up.
STATUS_COMPLETED, STATUS_FAILED, STATUS_RUNNING, STATUS_QUEUED = "completed", "failed", "running", "queued"
# ---------------------------------------------------------------------------


def run_quality(scored: DataFrame, runs: DataFrame, run_cols: list[str]) -> DataFrame:
    """A1: mean substring recall, mean token recall and count per run; a run
    without scored items gets 0.0 / 0.0 / 0 (empty run → 0.0, not null).

    ``runs`` is the run dimension (one row per run); the per-run aggregate has
    one row per run too, so the outer join never meets a hot key.
    """
    agg = scored.groupBy(*run_cols).agg(
        F.avg("substring_recall").alias("__sr"),
        F.avg("token_recall").alias("__tr"),
        F.count(F.lit(1)).alias("__n"))
    return (runs.select(*run_cols).join(agg, on=run_cols, how="left")
            .select(*run_cols,
                    F.coalesce("__sr", F.lit(0.0)).alias("substring_recall"),
                    F.coalesce("__tr", F.lit(0.0)).alias("token_recall"),
                    F.coalesce("__n", F.lit(0)).cast("bigint").alias("num_examples")))


def run_record(quality: DataFrame, run_cols: list[str], durations: DataFrame | None = None,
               peaks: DataFrame | None = None, sizes: DataFrame | None = None,
               peak_cols: tuple[str, ...] = (), model_size_bytes: int | None = None,
               extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """The wide run-metrics record -- quality (A1) + duration +
    model / retriever sizes in bytes and MB + telemetry peaks (A4).

    Every input has one row per run, so the joins never meet a hot key.
    ``durations`` / ``peaks`` may be the same DataFrame (pass it once, as
    ``peaks``, when it carries ``duration_seconds``). ``sizes`` may carry
    ``model_size_bytes`` and ``retriever_index_size_bytes``; a single model's
    size can be given as ``model_size_bytes`` instead. Absent values are 0.
    ``extra_cols`` of ``quality`` are carried through.
    """
    rec = quality
    for extra in (durations, peaks, sizes):
        if extra is not None:
            rec = rec.join(extra, on=run_cols, how="left")
    cols = set(rec.columns)

    def num(c, t):
        if c == "model_size_bytes" and model_size_bytes is not None and c not in cols:
            return F.lit(model_size_bytes).cast(t)
        return (F.coalesce(F.col(c), F.lit(0)) if c in cols else F.lit(0)).cast(t)
    out = rec.select(
        *run_cols, "substring_recall", "token_recall", "num_examples",
        num("duration_seconds", "double").alias("duration_seconds"),
        num("model_size_bytes", "bigint").alias("model_size_bytes"),
        (num("model_size_bytes", "double") / F.lit(1048576.0)).alias("model_size_mb"),
        num("retriever_index_size_bytes", "bigint").alias("retriever_index_size_bytes"),
        (num("retriever_index_size_bytes", "double") / F.lit(1048576.0)).alias("retriever_index_size_mb"),
        *[num(c, "double").alias(c) for c in peak_cols],
        *[F.col(c) for c in extra_cols])
    return out


def context_stats(preds: DataFrame, group_col: str = "context_type", recall_col: str = "substring_recall",
                  truth_col: str = "ground_truth") -> DataFrame:
    """A2: per context type -- count, total recall, has-truth count, average
    recall, truth ratio -- plus the grand total row (``is_total``)."""
    has_truth = F.coalesce(F.size(F.col(truth_col)) > 0, F.lit(False)) \
        if dict(preds.dtypes)[truth_col].startswith("array") else F.col(truth_col).isNotNull()
    g = preds.rollup(group_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.sum(F.col(recall_col).cast("double")).alias("total_recall"),
        F.count_if(has_truth).cast("bigint").alias("has_ground_truth"),
        F.grouping(group_col).alias("__g"))
    return g.select(
        group_col, (F.col("__g") == 1).alias("is_total"), "count", "total_recall", "has_ground_truth",
        (F.col("total_recall") / F.col("count")).alias("avg_recall"),
        (F.col("has_ground_truth") / F.col("count")).alias("ground_truth_ratio"))


def distinct_values(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """A3: sorted distinct values per group, as rows (``value_rank`` 1..n and
    ``n_distinct``) rather than one collected array, so no group is ever
    gathered into a single value. The rank is the block-split running count,
    so a group with very many distinct values is spread over many tasks."""
    from .sequence import running_stats
    d = df.select(*group_cols, value_col).where(F.col(value_col).isNotNull()).distinct()
    r = running_stats(d, group_cols, [value_col])
    return r.select(*group_cols, value_col, F.col("position").alias("value_rank"),
                    F.col("run_count").alias("n_distinct"))


def latest_value(df: DataFrame, key_cols: list[str], value_col: str, order_cols: list[str]) -> DataFrame:
    """Last write wins -- the value with the greatest ``order_cols`` per key
    (``max_by`` is a partial aggregate: a hot key is pre-reduced per task)."""
    return df.groupBy(*key_cols).agg(
        F.max_by(F.col(value_col), F.struct(*order_cols)).alias("latest_value"),
        F.max(F.struct(*order_cols)).alias("__o"),
        F.count(F.lit(1)).cast("bigint").alias("n_writes"),
    ).select(*key_cols, "latest_value", *[F.col("__o")[c].alias(f"latest_{c}") for c in order_cols], "n_writes")


def latest_status(events: DataFrame, task_col: str, status_col: str, order_cols: list[str],
                  extra_cols: list[str] | None = None) -> DataFrame:
    """Latest status per task plus attempt counts (input to A6/A9)."""
    extra_cols = extra_cols or []
    o = F.struct(*order_cols)
    return events.groupBy(task_col).agg(
        F.max_by(F.col(status_col), o).alias("status"),
        *[F.max_by(F.col(c), o).alias(c) for c in extra_cols],
        F.count(F.lit(1)).cast("bigint").alias("n_events"),
        F.count_if(F.col(status_col) == STATUS_FAILED).cast("bigint").alias("attempts_failed"),
    )


def batch_rollup(latest: DataFrame) -> DataFrame:
    """Completed / failed / running / remaining counts and progress % (0
    when there are no tasks) from the latest status of each task."""
    s = F.col("status")
    r = latest.agg(
        F.count_if(s == STATUS_COMPLETED).cast("bigint").alias("completed"),
        F.count_if(s == STATUS_FAILED).cast("bigint").alias("failed"),
        F.count_if(s == STATUS_RUNNING).cast("bigint").alias("running"),
        F.count_if(s == STATUS_QUEUED).cast("bigint").alias("remaining"),
    )
    total = F.col("completed") + F.col("failed") + F.col("running") + F.col("remaining")
    return r.withColumn("total", total.cast("bigint")).withColumn(
        "progress_pct", F.coalesce(F.try_divide(F.col("completed") * 100.0, F.col("total")), F.lit(0.0)))


def failed_report(latest: DataFrame, task_col: str, reason_col: str) -> DataFrame:
    """Tasks whose latest status is failed, with attempts and reason."""
    return (latest.filter(F.col("status") == STATUS_FAILED)
                  .select(task_col, F.col("attempts_failed").alias("attempts"),
                          F.col(reason_col).alias("failure_reason")))


def metric_category(name) -> Column:
    """quality / memory / size / other by metric name, first match wins."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    expr = None
    for cat, subs in CATEGORY_RULES:
        cond = None
        for s in subs:
            c = n.contains(s)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(cat)) if expr is None else expr.when(cond, F.lit(cat))
    return expr.otherwise(F.lit("other"))


def format_metric(name, value, integral: bool = False) -> Column:
    """display text of a metric value by name; the DOUBLE stays the value of
    record. Decimals are rounded half to even on the exact binary value (below 1e11).
    ``integral`` marks an integer-typed metric: the fallback prints it as is."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    v = F.col(value) if isinstance(value, str) else value

    def has(*subs):
        c = None
        for s in subs:
            c = n.contains(s) if c is None else (c | n.contains(s))
        return c
    def fixed(digits):
        # x * unit as the sum of two exact products (high and low half of x's bits), so the
        # sign of its distance to the half between two integers is that of the exact value
        x, unit = F.abs(v), float(10 ** digits)
        high = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
        below = F.floor(x * F.lit(unit))
        over = (high * F.lit(unit) - (below + F.lit(0.5))) + (x - high) * F.lit(unit)
        n = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
        text = F.concat(F.when(v.cast("string").startswith("-"), "-").otherwise(""),
                        ((n - n % F.lit(10 ** digits)) / F.lit(10 ** digits)).cast("bigint").cast("string"),
                        F.lit("."), F.lpad((n % F.lit(10 ** digits)).cast("string"), digits, "0"))
        return (F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf"))
                 .when(x < F.lit(1e11), text).otherwise(F.format_string(f"%.{digits}f", v)))
    as_int = v.cast("bigint")  # truncates toward zero
    return (F.when(has("bytes"), F.format_number(as_int, 0))
             .when(has("mb", "ram"), fixed(2))
             .when(has("recall", "precision", "f1"), fixed(4))
             .when(has("time", "duration", "seconds"), fixed(2))
             .when(has("num", "count", "examples"), as_int.cast("string"))
             .otherwise(as_int.cast("string") if integral else fixed(4)))


def metrics_long(wide: DataFrame, id_cols: list[str]) -> DataFrame:
    """Unpivot the numeric metric columns of a wide run record into
    ``(id…, metric, value DOUBLE, category, display)``; non-numeric columns
    are dropped."""
    integral = {"long", "integer", "short"}
    numeric = [(f.name, f.dataType.typeName() in integral) for f in wide.schema.fields
               if f.name not in id_cols and f.dataType.typeName() in
               ("double", "float", "long", "integer", "short", "decimal")]
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"),
                                 format_metric(F.lit(c), F.col(c).cast("double"), is_int).alias("display"))
                        for c, is_int in numeric])
    long = wide.select(*id_cols, F.inline(entries))
    return long.withColumn("category", metric_category("metric")).select(
        *id_cols, "metric", "value", "category", "display")


def flatten_config(df: DataFrame, config_col: str, id_cols: list[str]) -> DataFrame:
    """A JSON config column → ``(section, key, value)`` rows; a scalar at
    the top level gives ``(section, null, value)``. A section is what *is* an
    object; a string that looks like one stays a value, so the JSON type (VARIANT)
    decides and the text is only rendered. Each section becomes an array of
    entries that is inlined."""
    sections = F.try_variant_get(F.try_parse_json(F.col(config_col)), "$", "map<string,variant>")
    kinds = F.transform_values(sections, lambda _, v: F.schema_of_variant(v).startswith("OBJECT"))
    top = (df.select(*id_cols, kinds.alias("__kinds"),
                     F.explode(F.from_json(F.col(config_col), "map<string,string>")).alias("section", "raw"))
             .withColumn("__object", F.coalesce(F.element_at("__kinds", F.col("section")), F.lit(False))).drop("__kinds"))
    nested = F.from_json(F.col("raw"), "map<string,string>")
    entry = "struct<key:string,value:string>"
    entries = (F.when(F.col("__object") & nested.isNotNull(),
                      F.transform(F.map_entries(nested),
                                  lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
                .otherwise(F.array(F.struct(F.lit(None).cast("string").alias("key"),
                                            F.col("raw").alias("value")))).cast(f"array<{entry}>"))
    return top.select(*id_cols, "section", F.inline(entries))

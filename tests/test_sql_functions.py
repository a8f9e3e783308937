"""The qa_* SQL functions agree with the Column functions."""

from qaspark.functions.naming import memory_estimate_gb
from qaspark.functions.sql import register_sql_functions
from qaspark.functions.text import with_recalls
from tests.test_differential import POOL
from tests.test_text import CLEAN_ROWS, RECALL_ROWS


def test_sql_recalls_match_columns(spark):
    register_sql_functions(spark)
    import random
    rnd = random.Random(5)
    rows = [(i, p, t) for i, (p, t, _, _) in enumerate(RECALL_ROWS)]
    rows += [(100 + i, "".join(rnd.choice(POOL) for _ in range(20)),
              ["".join(rnd.choice(POOL) for _ in range(6)) for _ in range(rnd.randint(0, 3))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, p string, t array<string>")
    df.createOrReplaceTempView("qa_sql_test")
    sql = spark.sql("SELECT i, qa_token_recall(p, t) AS tr, qa_substring_recall(p, t) AS sr FROM qa_sql_test")
    got = {r.i: (r.tr, r.sr) for r in sql.collect()}
    want = {r.i: (r.token_recall, r.substring_recall) for r in with_recalls(df, "p", "t").collect()}
    assert got == want


def test_sql_clean_and_naming(spark):
    register_sql_functions(spark)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN_ROWS)], "i int, t string")
    df.createOrReplaceTempView("qa_sql_clean")
    got = {r.i: r.c for r in spark.sql("SELECT i, qa_clean_answer(t) AS c FROM qa_sql_clean").collect()}
    assert got == {i: want for i, (_, want) in enumerate(CLEAN_ROWS)}
    r = spark.sql("SELECT qa_memory_estimate_gb('1.7B', 'x') AS a, qa_memory_estimate_gb('135M', 'smollm2_135m') AS b, "
                  "qa_bucket_name('no_context') AS c, qa_file_stem('a/b\\\\c') AS d, qa_run_name('m','d','no_context') AS e, "
                  "qa_is_sentinel('No answer generated') AS f, qa_tokens('A a b') AS g").first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, sorted(r.g)) == (4.25, 2.0, "no-context", "a_b_c", "m_d_no_context", True,
                                                           ["a", "b"])
    sizes = spark.createDataFrame([("0.6B", "m"), ("foo", "m"), ("360M", "smollm2_360m")], "s string, n string")
    sizes.createOrReplaceTempView("qa_sql_sizes")
    a = [x.e for x in spark.sql("SELECT qa_memory_estimate_gb(s, n) AS e FROM qa_sql_sizes").collect()]
    b = [x.e for x in sizes.select(memory_estimate_gb("s", "n").alias("e")).collect()]
    assert a == b == [1.5, 3.0, 4.0]

"""qaspark -- Spark-native evaluation of question-answering output at scale.

Sub-packages:
  functions  column expressions (tokenising, recalls, cleaning, prompts, naming) and SQL functions
  sources    readers (QA JSONL, config dimensions, telemetry text, driver tables)
  operators  DataFrame operators (scoring, joins, aggregates, windows, retrieval, hot-key salting)
  sinks      writers for predictions, metrics, series and manifests
  streaming  Structured Streaming versions of the live reports
  plans      end-to-end evaluation and the registered queries

Main entry points:
  qaspark.session.build_session                    session with the settings the library expects
  qaspark.sources.qa_jsonl.read_qa                 QA JSONL file or folder → items
  qaspark.plans.evaluation.evaluate_run            one run → (predictions, metrics)
  qaspark.plans.evaluation.evaluate_grid           every run of a grid in one job
  qaspark.functions.text.with_recalls              both recalls as columns
  qaspark.operators.recall_join.recall_join        truths found in large text collections
  qaspark.operators.retrieve.retrieve_dense        top-k by cosine similarity
  qaspark.operators.retrieve.retrieve_lexical      top-k by token recall
  qaspark.functions.sql.register_sql_functions     the same functions for spark.sql
  qaspark.streaming.live                           live quality, peaks, progress, latest values
"""

__version__ = "0.1.0"

"""touchline — sports-results ETL and analytics as Spark DataFrame operators.

Layout:
  functions/  Column helpers (scalars) and window idioms (latest_by, long_form, ...)
  sources/    snapshot listing/reading (S01–S10) and sinks (K01–K06)
  operators/  flatten (F), scope (W), validate (V), merge (M), serve (Q), present (P)
  plans/      composite jobs (J01–J09) and the test-table bindings
  streaming/  incremental ingest on Structured Streaming (T01)

Every operator takes and returns DataFrames; nothing is collected to the driver
except small summaries a caller asks for.
"""

from touchline.session import get_spark  # noqa: F401

__all__ = ["get_spark"]

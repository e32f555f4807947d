"""Registration of queries and the SQL prefixes they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Events with previous values, differences, rule flags, label, bucket and split.
LAB = """
WITH ev AS (
  SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type AS state, value,
         try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
d AS (
  SELECT *, abs(value - previous_value) AS value_diff, abs(k - previous_k) AS k_diff
  FROM (SELECT *, lag(value) OVER w AS previous_value, lag(k) OVER w AS previous_k
        FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id))),
f AS (
  SELECT *,
         coalesce(state = 'purchase' AND value_diff > 100, false) AS r1,
         coalesce(state = 'purchase' AND k_diff > 80, false) AS r2,
         coalesce(value_diff > 250, false) AS r3,
         coalesce(k_diff > 95, false) AS r4,
         coalesce(state = 'error' AND value > 200, false) AS r5
  FROM d),
lab AS (
  SELECT *, (r1 OR r2 OR r3 OR r4 OR r5) AS is_anomaly,
         list_filter([CASE WHEN r1 THEN 'r1' END, CASE WHEN r2 THEN 'r2' END,
                      CASE WHEN r3 THEN 'r3' END, CASE WHEN r4 THEN 'r4' END,
                      CASE WHEN r5 THEN 'r5' END], lambda x: x IS NOT NULL) AS rule_triggers,
         CASE state WHEN 'purchase' THEN 'a' WHEN 'error' THEN 'b' ELSE 'other' END AS bucket,
         CASE WHEN substr(sha256('split:' || user_id), 1, 8) < 'b3333333' THEN 'train'
              WHEN substr(sha256('split:' || user_id), 1, 8) < 'd9999999' THEN 'val'
              ELSE 'test' END AS split
  FROM f)
"""

# Verdicts of four methods on every event; the dataset is the split.
PRED = LAB + """,
pred AS (
  SELECT record_id, dataset, gold, method, score, score >= threshold AS pred FROM (
    SELECT event_id AS record_id, split AS dataset, is_anomaly AS gold,
           'k_jump' AS method, coalesce(k_diff, 0) AS score, 80.0 AS threshold FROM lab
    UNION ALL
    SELECT event_id, split, is_anomaly, 'no_r1',
           CASE WHEN r2 OR r3 OR r4 OR r5 THEN 1.0 ELSE 0.0 END, 0.5 FROM lab
    UNION ALL
    SELECT event_id, split, is_anomaly, 'value', value, 200.0 FROM lab
    UNION ALL
    SELECT event_id, split, is_anomaly, 'value_jump', coalesce(value_diff, 0), 100.0 FROM lab))
"""

# In-band rows: record x rule x window.
BAND = LAB + """,
spec(rule, feature, gate, threshold, window_name, half_width) AS (VALUES
  ('r1','value_diff','purchase',100.0::DOUBLE,'tight',1.0::DOUBLE),
  ('r1','value_diff','purchase',100.0,'primary',5.0),
  ('r1','value_diff','purchase',100.0,'broad',20.0),
  ('r2','k_diff','purchase',80.0,'tight',1.0), ('r2','k_diff','purchase',80.0,'primary',3.0),
  ('r2','k_diff','purchase',80.0,'broad',8.0),
  ('r3','value_diff',NULL,250.0,'tight',1.0), ('r3','value_diff',NULL,250.0,'primary',5.0),
  ('r3','value_diff',NULL,250.0,'broad',20.0),
  ('r4','k_diff',NULL,95.0,'tight',1.0), ('r4','k_diff',NULL,95.0,'primary',2.0),
  ('r4','k_diff',NULL,95.0,'broad',4.0),
  ('r5','value','error',200.0,'tight',1.0), ('r5','value','error',200.0,'primary',5.0),
  ('r5','value','error',200.0,'broad',20.0)),
band AS (
  SELECT *, abs(feature_value - threshold) AS distance,
         CASE WHEN feature_value <= threshold THEN 'below_or_equal' ELSE 'above' END AS side
  FROM (SELECT lab.*, spec.rule, spec.feature, spec.threshold, spec.window_name, spec.half_width,
               CASE spec.feature WHEN 'value_diff' THEN value_diff WHEN 'k_diff' THEN k_diff
                    ELSE value END AS feature_value
        FROM lab JOIN spec ON spec.gate IS NULL OR spec.gate = lab.state)
  WHERE abs(feature_value - threshold) <= half_width + 1e-12)
"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL it is checked in the tests instead."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register

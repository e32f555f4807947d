"""Readers, writers and manifests, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stepguard.operators.align import manifest_check
from stepguard.plans import events as ev
from stepguard.plans.catalog.profiles import sequences
from stepguard.plans.catalog.registry import LAB, query
from stepguard.session import checkpointed, scratch_path
from stepguard.sources.manifest import fingerprints
from stepguard.sources.readers import read_csv, read_json_array, read_jsonl
from stepguard.sources.writers import land, publish_jsonl, stack, write_csv, write_flagged, write_jsonl

EVENT_SCHEMA = "event_id bigint, ts_us bigint, user_id bigint, state string, value double, k double"


@query(
    "a02_a05_json_lines",
    LAB + """SELECT state, count(*) AS n, round(sum(value), 4) AS value_sum, sum(ts_us % 1000)::BIGINT
      AS micros, (SELECT count(*) FROM ev) AS written FROM ev GROUP BY state""",
)
def a02(spark, folder):
    path = scratch_path(spark, "events-jsonl")
    written = write_jsonl(ev.events(spark, folder), path)
    return read_jsonl(spark, path, EVENT_SCHEMA).groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("value_sum"),
        F.sum(F.col("ts_us") % 1000).alias("micros"),
        F.lit(written).cast("bigint").alias("written"),
    )


@query(
    "a05_published_files",
    """WITH l AS (SELECT event_id, event_id // 2000 AS part,
        '{"event_id":' || event_id || ',"state":"' || event_type || '"}' || chr(10) AS line FROM events)
      SELECT part::VARCHAR AS part, count(*) AS rows, sum(octet_length(line::BLOB))::BIGINT AS bytes,
        sha256(string_agg(line, '' ORDER BY event_id)) AS sha256 FROM l GROUP BY ALL""",
)
def a05(spark, folder):
    """Events as JSON Lines in files of 2,000 ids, with rows, bytes and SHA-256 of each."""
    rows = ev.events(spark, folder).select("event_id", "state")
    part = F.floor(F.col("event_id") / 2000)
    return publish_jsonl(rows, scratch_path(spark, "published-jsonl"), part, ["event_id"])


@query(
    "a01_json_array",
    LAB + """SELECT state, count(*) AS n, round(sum(value), 4) AS value_sum,
      sum(ts_us % 1000)::BIGINT AS micros FROM ev GROUP BY state""",
)
def a01(spark, folder):
    """Events as JSON arrays, one per file and about a thousand records each, read back by ranges."""
    path = scratch_path(spark, "events-arrays")
    rows = ev.events(spark, folder)
    files = F.pmod(F.xxhash64("event_id"), F.lit(-(-rows.count() // 1000) or 1))
    arrays = rows.groupBy(files).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json_array(spark, path, EVENT_SCHEMA, range_bytes=1 << 15).groupBy("state").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 4).alias("value_sum"),
        F.sum(F.col("ts_us") % 1000).alias("micros"),
    )


@query(
    "a08_refused_overwrite",
    "SELECT true AS refused, count(*) AS n, sum(event_id)::BIGINT AS id_sum FROM events",
)
def a08(spark, folder):
    """A second write to the same place is refused and leaves the first one as it was."""
    path = scratch_path(spark, "landed-events")
    rows = ev.events(spark, folder)
    land(rows, path)
    refused = False
    try:
        land(rows.limit(1), path)
    except AnalysisException as error:
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).agg(
        F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")
    )


@query(
    "g03_first_lines",
    LAB + "SELECT event_id, state FROM ev ORDER BY event_id LIMIT 500",
)
def g03(spark, folder):
    """The first lines of JSON files written in the order of the ids."""
    path = scratch_path(spark, "ordered-jsonl")
    write_jsonl(ev.events(spark, folder).orderBy("event_id"), path)
    return read_jsonl(spark, path, EVENT_SCHEMA, limit=500).select("event_id", "state")


@query(
    "a03_a06_csv_union_header",
    LAB + """SELECT 'state' AS kind, state, NULL::BIGINT AS user_id, count(*) AS n, NULL::BIGINT AS anomaly
        FROM lab GROUP BY state
      UNION ALL SELECT 'user', NULL, user_id, count(*), count(*) FILTER (WHERE is_anomaly) FROM lab
        GROUP BY user_id""",
)
def a03(spark, folder):
    df = checkpointed(ev.labelled_events(spark, folder))
    by_state = df.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    by_user = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomaly")
    )
    table = stack(
        [by_state.withColumn("kind", F.lit("state")), by_user.withColumn("kind", F.lit("user"))]
    )
    path = scratch_path(spark, "report-csv")
    columns = ["kind", "state", "user_id", "n", "anomaly"]
    write_csv(table.select(*columns), path)
    schema = "kind string, state string, user_id bigint, n bigint, anomaly bigint"
    return read_csv(spark, path, schema)


@query(
    "a07_flagged_sink",
    LAB + """SELECT event_id, array_to_string(rule_triggers, '|') AS triggers FROM lab WHERE is_anomaly""",
)
def a07(spark, folder):
    df = ev.labelled_events(spark, folder)
    flagged = write_flagged(df, F.col("is_anomaly"), scratch_path(spark, "labelled"))
    return flagged.select("event_id", F.array_join("rule_triggers", "|").alias("triggers"))


@query("a09_file_fingerprints")
def a09(spark, folder):
    return fingerprints(spark, f"{folder}/*.parquet")


@query(
    "a10_manifest_check",
    """SELECT * FROM (VALUES ('events.parquet', 'changed'), ('orders.parquet', 'unexpected'),
       ('absent.parquet', 'missing')) t(name, status)""",
)
def a10(spark, folder):
    """The folder against a manifest of itself in which three entries are wrong."""
    actual = fingerprints(spark, f"{folder}/*.parquet")
    wrong = F.when(F.col("name") == "events.parquet", F.lit("0")).otherwise(F.col("sha256"))
    expected = actual.filter("name <> 'orders.parquet'").withColumns(
        {
            "sha256": wrong,
            "name": F.explode(
                F.when(
                    F.col("name") == "events.parquet", F.array("name", F.lit("absent.parquet"))
                ).otherwise(F.array("name"))
            ),
        }
    )
    return manifest_check(expected, actual)


@query(
    "a11_sequence_archive",
    LAB + "SELECT split, count(*) AS n, count(*) * 8 AS steps FROM lab GROUP BY split",
)
def a11(spark, folder):
    archive = land(sequences(spark, folder), scratch_path(spark, "sequences"), ["split"])
    return archive.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("sequence")).alias("steps")
    )

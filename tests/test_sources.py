import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stepguard.operators.align import manifest_check
from stepguard.sources.manifest import fingerprints
from stepguard.sources.readers import read_csv, read_json_array, read_jsonl, read_split_design
from stepguard.sources.writers import land, stack, write_csv, write_flagged, write_jsonl

SCHEMA = "record_id bigint, cycle_no string, value string"


def test_json_array(spark, tmp_path):
    rows = [{"record_id": i, "cycle_no": i % 3, "value": str(i / 2)} for i in range(50)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2), encoding="utf-8")
    df = read_json_array(spark, str(tmp_path / "a.json"), SCHEMA)
    assert df.count() == 50
    landed = land(df, str(tmp_path / "landed"), ["cycle_no"])
    assert landed.filter("cycle_no = 1").agg(F.sum("record_id")).first()[0] == sum(range(1, 50, 3))


def test_json_lines_skip_blanks_and_limit(spark, tmp_path):
    lines = ['{"record_id": 1}', "", "   ", '{"record_id": 2, "value": "x"}', ""]
    (tmp_path / "a.jsonl").write_text("\n".join(lines), encoding="utf-8")
    df = read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA)
    assert sorted(r["record_id"] for r in df.collect()) == [1, 2]
    assert read_jsonl(spark, str(tmp_path / "a.jsonl"), SCHEMA, limit=1).count() == 1


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text("record_id,value\n7,甲\n", encoding="utf-8-sig")
    row = read_csv(spark, str(tmp_path / "a.csv"), "record_id bigint, value string").first()
    assert (row["record_id"], row["value"]) == (7, "甲")


def test_split_design(spark, tmp_path):
    path = tmp_path / "design.json"
    path.write_text(json.dumps({"split_cycles": {"train": [1, 2], "test": ["3"]}, "seed": 1}))
    got = {r["group"]: r["split"] for r in read_split_design(spark, str(path)).collect()}
    assert got == {"1": "train", "2": "train", "3": "test"}
    path.write_text(json.dumps({"split_cycles": {"train": [1, 2], "test": ["2"]}}))
    with pytest.raises(Exception, match="listed more than once: 2"):
        read_split_design(spark, str(path)).collect()


def test_writers_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(10).withColumn("odd", F.col("id") % 2 == 1)
    assert write_jsonl(df, str(tmp_path / "j")) == 10
    write_csv(df, str(tmp_path / "c"))
    flagged = write_flagged(df, F.col("odd"), str(tmp_path / "f"))
    assert sorted(r["id"] for r in flagged.collect()) == [1, 3, 5, 7, 9]
    for again in (
        lambda: write_jsonl(df, str(tmp_path / "j")),
        lambda: write_csv(df, str(tmp_path / "c")),
        lambda: write_flagged(df, F.col("odd"), str(tmp_path / "f")),
        lambda: land(df, str(tmp_path / "f")),
    ):
        with pytest.raises(Exception, match="already exists"):
            again()


def test_stack_keeps_first_seen_order(spark):
    a = spark.createDataFrame([(1, "x")], "n int, name string")
    b = spark.createDataFrame([("y", 2.0)], "name string, rate double")
    out = stack([a, b])
    assert out.columns == ["n", "name", "rate"] and out.count() == 2


@pytest.mark.parametrize("whole", [10**9, 1])
def test_fingerprints_and_manifest(spark, tmp_path, whole):
    contents = {"a.bin": b"abc" * 1000, "b.bin": b"", "c.bin": b"\x00" * 3_000_000}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    found = fingerprints(spark, f"{tmp_path}/*.bin", whole_file_bytes=whole)
    got = {r["name"]: (r["bytes"], r["sha256"]) for r in found.collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}
    assert manifest_check(found, found).count() == 0
    changed = found.filter("name <> 'b.bin'").withColumn("bytes", F.col("bytes") + (F.col("name") == "a.bin").cast("int"))
    status = {r["name"]: r["status"] for r in manifest_check(changed, found).collect()}
    assert status == {"a.bin": "changed", "b.bin": "unexpected"}

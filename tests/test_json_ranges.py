"""One array file read by several tasks gives each record once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stepguard.sources import json_ranges as J
from stepguard.sources.readers import read_json_array

SCHEMA = "id bigint, name string, tags array<string>, inner struct<x: double, y: string>"


def records(n, seed=1):
    random.seed(seed)
    odd = ['"', "\\", '\\"', "]", "[", "{", "}", ",", "é漢", "\\\\", "\n", " ", "a"]
    text = lambda: "".join(random.choices(odd, k=random.randint(0, 12)))
    return [
        {"id": i, "name": text(), "tags": [text() for _ in range(random.randint(0, 3))], "inner": {"x": i / 4, "y": text()}}
        for i in range(n)
    ]


def same(frame, wanted):
    got = {r.id: json.loads(r.j) for r in frame.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()}
    assert frame.count() == len(wanted) and got == {r["id"]: r for r in wanted}


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_all_sizes(spark, tmp_path, indent):
    wanted = records(300)
    path = tmp_path / f"in{indent}"
    path.mkdir()
    (path / "one.json").write_text(json.dumps(wanted[:290], indent=indent, ensure_ascii=False), encoding="utf-8")
    (path / "two.json").write_text(json.dumps(wanted[290:]))
    (path / "empty.json").write_text(" [ ]\n")
    for size in (6000, 10**6):
        same(J.read_ranges(spark, str(path), SCHEMA, size), wanted)


def test_reader_shares_a_file(spark, tmp_path):
    wanted = records(2000, 2)
    (tmp_path / "a.json").write_text(json.dumps(wanted))
    frame = read_json_array(spark, str(tmp_path / "a.json"), SCHEMA, range_bytes=20_000)
    same(frame, wanted)
    assert frame.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    same(read_json_array(spark, str(tmp_path / "a.json"), SCHEMA), wanted)


def test_each_range_takes_the_elements_that_begin_in_it(tmp_path):
    wanted = records(60, 3)
    text = json.dumps(wanted).encode()
    path = tmp_path / "a.json"
    path.write_bytes(text)
    for size in (1, 2, 7, 64, 900):
        parts, in_string, depth, escaped = [], 0, 0, 0
        for start in range(0, len(text), size):
            end = min(len(text), start + size)
            parts += J._elements(path.as_uri(), start, end, in_string, depth)
            _, in_string, depth, escaped = J.structure(text[start:end], in_string, depth, escaped)
        assert [json.loads(p) for p in parts] == wanted


def test_other_documents_are_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": 1, "name": "x" * 100}))
    with pytest.raises(Exception, match="not a JSON array"):
        J.read_ranges(spark, str(tmp_path / "a.json"), SCHEMA, 10).collect()


def test_tasks_follow_the_bytes_and_not_the_ranges(spark, tmp_path):
    """Many small files are read by a few tasks, each record once."""
    wanted = records(400, 4)
    for part in range(100):
        (tmp_path / f"{part}.json").write_text(json.dumps(wanted[part * 4 : part * 4 + 4]))
    frame = J.read_ranges(spark, str(tmp_path), SCHEMA, 20)
    same(frame, wanted)
    assert frame.rdd.getNumPartitions() <= J.SPREAD * spark.sparkContext.defaultParallelism
    assert J.read_tasks(3, 100, 32) == 3 and J.read_tasks(0, 0, 32) == 1
    assert J.read_tasks(2**20, 2**35, 32) == 1024

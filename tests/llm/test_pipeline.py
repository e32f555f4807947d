import duckdb
import pytest

import corpus_pipeline
from stepguard.llm import line_dedup, mixing, quality_rules
from test_near_text import survivors

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def registered(frame):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in frame.select(*COLUMNS).collect()])
    return connection


def run_stages(spark, docs, tmp_path):
    frames = [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, frames[-1], None).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_stages_against_brute_force(spark, docs, tmp_path):
    start, good, short, unique, mixed, encoded = run_stages(spark, docs, tmp_path)
    kept = registered(start).execute(
        quality_rules.SQL + "SELECT count(*), sum(hash(doc_id, text)) FROM s JOIN judged USING (rid) JOIN d USING (rid, doc_id) "
        "WHERE NOT base_failed AND inside"
    ).fetchone()
    assert kept == registered(good).execute("SELECT count(*), sum(hash(doc_id, text)) FROM documents").fetchone()
    lines = registered(good).execute(f"SELECT count(*), sum(hash(doc_id, text)) FROM ({line_dedup.ORACLE})").fetchone()
    assert lines == registered(short).execute("SELECT count(*), sum(hash(doc_id, text)) FROM documents").fetchone()
    assert short.filter("n_chars != length(text)").count() == 0
    assert sorted((r.doc_id for r in unique.collect()), key=str) == survivors([(r.doc_id, r.text) for r in short.collect()])
    copies = {r.id: r.copies for r in mixing.mixture(unique).collect()}
    assert mixed.count() == sum(copies.values())
    assert encoded.filter("round_trip").count() == mixed.count()
    assert [c for c in encoded.columns[:5]] == COLUMNS
    for frame in (good, short, unique, mixed):
        assert frame.columns == COLUMNS


def test_empty_table(spark, no_docs, tmp_path):
    assert [f.count() for f in run_stages(spark, no_docs, tmp_path)] == [0] * 6


def test_clashing_columns(spark, docs, clashing, tmp_path):
    plain = run_stages(spark, docs, tmp_path / "plain")
    extra = run_stages(spark, clashing, tmp_path / "extra")
    for one, other in zip(plain[:-1], extra[:-1], strict=True):
        assert other.columns == clashing.columns
        assert sorted(map(str, other.select(*COLUMNS).collect())) == sorted(map(str, one.collect()))
    assert extra[-1].count() == plain[-1].count()


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(name):
    import __spark_entry__ as registry

    assert name in registry.queries()

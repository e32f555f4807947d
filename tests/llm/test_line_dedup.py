from stepguard.llm import line_dedup as L
from tools.check import rows_of


def test_against_sql(docs, duck):
    got = L.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")
    cursor = duck.execute(L.ORACLE)
    wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == wanted
    assert any(r.n_dropped for r in got.collect())


def test_copies_do_not_make_boilerplate(spark):
    rows = [(i, "one\ntwo", "h") for i in range(50)] + [(100 + i, f"own {i}\ncommon", "h") for i in range(50)]
    got = {r.doc_id: r.text for r in L.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert got[3] == "one\ntwo" and got[107] == "own 7"


def test_clashes_and_empty_table(clashing, docs, no_docs):
    found = L.drop_boilerplate(clashing)
    assert found.count() == docs.count()
    assert found.columns.count("n_lines") == 1 and "drop" in found.columns
    assert L.drop_boilerplate(no_docs).count() == 0

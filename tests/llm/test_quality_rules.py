from stepguard.llm import quality_rules as Q
from tools.check import rows_of


def test_against_sql(docs, duck):
    got = Q.verdicts(docs)
    cursor = duck.execute(Q.ORACLE)
    wanted = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == wanted


def test_kept_rows_keep_their_columns(docs, clashing, no_docs):
    kept = sum(r.kept for r in Q.verdicts(docs).collect())
    good = Q.keep_good(docs)
    assert good.columns == docs.columns and good.count() == kept > 0
    again = Q.keep_good(clashing)
    assert again.columns == clashing.columns and again.count() == kept
    assert Q.keep_good(no_docs).count() == 0 and Q.verdicts(no_docs).count() == 0


def test_symbol_junk_goes_and_prose_stays(docs, rows):
    junk = {r[0] for r in rows if r[1] and r[1].count("***") > 9}
    verdict = {r.doc_id: r.kept for r in Q.verdicts(docs).collect()}
    assert junk and not any(verdict[i] for i in junk)
    prose = [i for i, t, *_ in rows[:260] if i not in junk and i % 19 and i % 18 and len(t.split()) > 60]
    assert sum(verdict[i] for i in prose) >= 0.97 * len(prose)

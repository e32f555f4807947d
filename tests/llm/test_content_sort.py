import hashlib

import pytest

from stepguard.llm import content_sort as C


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, largest):
    """Digest, kept id, size and number of kept rows of every row's group."""
    groups: dict = {}
    for key, text, *_ in rows:
        groups.setdefault(low(text), []).append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        best = (max if largest else min)(known) if known else None
        stays = keys.index(best)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(str(k), str(best), len(keys), i == stays, digest) for i, k in enumerate(keys)]
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in frame.collect())


def test_query_against_brute_force(docs, rows):
    assert got(C.copy_digest(docs)) == plain(rows, True)


def test_queries_sql(duck, rows):
    found = duck.execute(C.ORACLE).fetchall()
    assert sorted((str(a), str(b), c, d, e) for a, b, c, d, e in found) == plain(rows, True)


@pytest.mark.parametrize("hot_rows,hot_bytes", [(2, 1 << 26), (7, 1 << 26), (5000, 500)])
def test_cut_groups(spark, hot_rows, hot_bytes):
    """A third of all rows in one group, texts with one beginning, ids repeated and null in the hot group."""
    start = "one beginning that many texts share, longer than the splitters look at "
    rows = [(i if i % 10 else None, "HOT text ß" if i % 2 else "hot TEXT ß") for i in range(100)]
    rows += [(7, "hot text ß")] * 5 + [(999, "hot text ß")] * 3
    rows += [(1000 + i, start + str(i % 60)) for i in range(150)] + [(None, "alone"), (None, "alone"), (None, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for keep in ("largest", "smallest"):
        marked = C.marked(frame, keep=keep, hot_rows=hot_rows, hot_bytes=hot_bytes)
        assert got(marked) == plain(rows, keep == "largest")
        assert C.drop_copies(frame, keep=keep, hot_rows=hot_rows, hot_bytes=hot_bytes).count() == len({low(t) for _, t in rows})


def test_kinds_of_hashes(spark):
    frame = spark.createDataFrame([("a",)] * 30 + [("b",)] * 3 + [("c" * 500,)] * 2 + [("d",)], "t string")
    assert sorted(r.pieces for r in C.hot_hashes(frame, 10, 10**9).collect()) == [3]
    assert sorted(r.pieces for r in C.hot_hashes(frame, 10, 600).collect()) == [2, 3]


def test_odd_tables(docs, rows, clashing, no_docs):
    assert C.copy_digest(no_docs).count() == 0
    marked = C.marked(clashing)
    assert marked.columns == [c for c in clashing.columns if c != "kept"] + ["keep_id", "group_size", "kept", "text_sha256"]
    assert got(marked) == plain(rows, False)
    kept = C.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == C.drop_copies(docs).count() == len({low(r[1]) for r in rows})


def test_one_exchange_moves_the_texts(spark):
    """The window reads the ranges as they are."""
    import io
    from contextlib import redirect_stdout

    said = io.StringIO()
    with redirect_stdout(said):
        spark.range(9).selectExpr("string(id) text", "substr(id, 1, 9) lead", "xxhash64(id) hash", "id piece").repartitionByRange(
            "lead", "hash", "piece"
        ).selectExpr("count(*) over (partition by lead, hash, piece, text) n").explain()
    assert said.getvalue().count("Exchange") == 1

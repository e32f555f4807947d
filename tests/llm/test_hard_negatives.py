import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stepguard.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def made_up(n=400, width=6, seed=2):
    random.seed(seed)
    rows = []
    for i in range(n):
        vector = [float(np.float32(random.gauss(0.2, 0.5))) for _ in range(width)]
        rows.append((i, vector, random.choice([0, 1, 1, 1, 2])))
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]  # one common vector
    rows += [rows[0], rows[0], rows[5], rows[5]]  # repeated rows, an anchor among them
    rows += [
        (1200, None, 1), (1300, [1.0, None] + [0.0] * (width - 2), 1), (1400, [float("nan")] * width, 1),
        (1500, [float("inf")] * width, 2), (1600, [0.5] * width, None), (None, [0.5] * width, 1),
        (1700, [0.0] * width, 1), (1800, [], 1), (1801, [], 2), (1900, [1.0, 2.0], 0), (1901, [0.5, 0.5], 1), (1902, [1.0, 1.0], 0),
        (-100, [-0.5] * width, 0),
    ]
    return rows


def plain(rows):
    usable = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((key, [math.floor(256 * x) for x in vector], (label + 1) % 10 if key % 7 == 0 else label))
    out = []
    for key, vector, label in usable:
        if key % 100:
            continue
        scored = [
            (-sum(a * b for a, b in zip(vector, v)), k, l) for k, v, l in usable if k != key and len(v) == len(vector)
        ]
        for s, k, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fits = sorted(x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)
            out += [(key, k, rank, x[1], -s, -x[0]) for rank, x in enumerate(fits[:10], 1)]
    return sorted(out)


def got(frame):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in names) for r in frame.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(made_up(), SCHEMA).repartition(3)


def test_query_against_brute_force(vectors):
    wanted = plain(made_up())
    assert len(wanted) > 200
    assert got(H.negative_digest(vectors)) == wanted


def test_small_blocks_give_the_same(vectors):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = H.hard_negatives(
        vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0, block=37, anchor_block=2
    )
    assert got(found) == plain(made_up())


def test_queries_sql():
    connection = duckdb.connect()
    connection.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    rows = [r for r in made_up() if r[1] != []]
    connection.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(connection.execute(H.ORACLE).fetchall()) == plain(rows)


def test_the_search_stops_early():
    """Lists that fall steeply close the windows before all is seen, with the same result."""
    random.seed(5)
    vectors = np.array([[int(1000 * random.paretovariate(1)) if d == i % 4 else random.randint(0, 3) for d in range(4)] for i in range(3000)])
    lists = H.Lists(np.arange(3000), np.array([i % 3 for i in range(3000)]), vectors)
    anchor = np.array([3, 5, 2, -1])
    [(ids, scores)], seen = H.search(lists, anchor, 0, 1, True, [(-H.EVERYTHING, H.EVERYTHING)], 5)
    exact = sorted((-int(v @ anchor), i) for i, v in enumerate(vectors) if i % 3 == 1 and i)[:5]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == exact
    assert seen < 1500
    low, high = exact[4][0] * -1 // 4, exact[4][0] * -1 // 2
    [(ids, scores)], seen = H.search(lists, anchor, 0, 1, False, [(low, high)], 10)
    exact = sorted((-int(v @ anchor), i) for i, v in enumerate(vectors) if i % 3 != 1 and low <= int(v @ anchor) <= high and i)[:10]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == exact


def test_bounds():
    for score in range(-50, 400):
        low, high = H.score_bounds(score)
        assert [s for s in range(-200, 500) if 30 * score <= 100 * s <= 90 * score] == list(range(low, high + 1))
    with pytest.raises(OverflowError):
        list(H.Lists(np.arange(2), np.zeros(2), np.full((2, 3), 2**40)).rounds(np.full(3, 2**40)))


def test_odd_tables(spark, vectors):
    assert H.negative_digest(spark.createDataFrame([], SCHEMA)).count() == 0
    clashing = vectors.select("*", *[F.lit("mine").alias(c) for c in "id uid vector length asks score place rank rows_at anchors_at scores".split()])
    assert got(H.negative_digest(clashing)) == plain(made_up())
    no_anchor = vectors.filter("vec_id % 100 != 0")
    assert H.negative_digest(no_anchor).count() == 0


def test_other_rows_with_the_id_of_an_anchor(spark):
    """They are negatives if their label differs, positives if only their vector does."""
    rows = [(100, [1.0, 0.0], 1), (100, [0.5, 0.0], 2), (100, [0.875, 0.0], 1), (101, [0.75, 0.0], 1), (103, [0.25, 0.5], 2)]
    wanted = []
    for vector, positives, negatives in (
        (256, [(100, 224), (101, 192)], [(100, 128), (103, 64)]),
        (224, [(100, 256), (101, 192)], [(100, 128), (103, 64)]),
    ):
        for key, p in positives:
            fits = [(n, x) for n, x in negatives if 30 * p <= 100 * x <= 90 * p]
            wanted += [(100, key, rank, n, vector * p, vector * x) for rank, (n, x) in enumerate(fits, 1)]
    found = got(H.negative_digest(spark.createDataFrame(rows, SCHEMA)))
    # the third anchor, of label 2, has one positive and negatives of label 1 that are too near
    assert found == sorted(wanted)

import random

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from stepguard.llm import near_text as N
from stepguard.llm import simhash
from stepguard.llm.common import lowered_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = lowered_words(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def survivors(rows):
    """By brute force: the smallest id of each group of texts linked at 0.8."""
    sets, root = [plain_set(text) for _, text in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    best = {}
    for i, (key, _) in enumerate(rows):
        rank = (key is not None, key)
        g = find(i)
        best[g] = min(best.get(g, rank), rank)
    return sorted((r[1] for r in best.values()), key=str)


def edited(seed=4):
    """Texts with one to six words changed, so pairs lie on both sides of 0.8, and chains of edits."""
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        words = random.choices(vocabulary, k=random.choice([30, 100, 200]))
        for step in range(8):
            other = list(words)
            for place in random.sample(range(len(words)), random.randint(0, 6)):
                other[place] = random.choice(vocabulary)
            if step % 3 == 0:
                words = other
            rows.append((len(rows), " ".join(other)))
    return rows


def test_stage_removes_near_copies(spark):
    rows = edited()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], SCHEMA).repartition(4)
    kept = corpus_pipeline.near_copies(spark, docs, None)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == survivors(rows)
    assert kept.columns == docs.columns


def test_one_edit_in_a_hundred_words(spark):
    random.seed(6)
    words = [f"w{random.randrange(5000)}" for _ in range(100)]
    other = words[:50] + ["changed"] + words[51:]
    rows = [(2, " ".join(words)), (1, " ".join(other)), (3, "short text"), (4, "Short  TEXT"), (5, None), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, None).collect()) == [1, 3, 5]


def test_odd_documents(spark, docs, rows, clashing, no_docs):
    kept = N.drop_near_copies(docs)
    got = sorted((r.doc_id for r in kept.collect()), key=str)
    assert got == survivors([(r[0], r[1]) for r in rows])
    again = N.drop_near_copies(clashing)
    assert again.columns == clashing.columns and again.count() == len(got)
    assert N.drop_near_copies(no_docs).count() == 0


def template(n, changed, length, seed):
    """Copies of one text with so many words changed in each, by chance."""
    random.seed(seed)
    base = [f"w{random.randrange(4000)}" for _ in range(length)]
    texts = []
    for i in range(n):
        words = list(base)
        for place in random.sample(range(length), random.randint(*changed)):
            words[place] = f"x{random.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def blocked(spark, texts, block):
    frame = spark.createDataFrame([(N._key(t) - (1 << 63), len(N.shingles(t)), t) for t in texts], "key long, size long, text string")
    placed = N.cells(frame.select("key", "size", F.lit(1).alias("cluster")), block=block)
    return placed, frame.join(placed, "key")


def test_large_groups(spark):
    """A group of near copies, and one of a template below 0.8 of which all stay; few rows travel."""
    near, apart = template(250, (1, 4), 160, 1), template(250, (22, 24), 160, 2)
    rows = list(enumerate(near + apart))
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in rows], SCHEMA).repartition(4)
    kept = {r.doc_id for r in N.drop_near_copies(docs).collect()}
    assert sorted(kept, key=str) == survivors(rows)
    assert len(kept & set(range(250))) < 50 and len(kept & set(range(250, 500))) > 240
    sketched = docs.select(N.sketch(F.col("text")).alias("s")).select("s.*")
    assert N.clusters(sketched).count() <= 500


def test_blocks_give_the_same(spark):
    texts = template(120, (1, 12), 80, 3)
    sets = [N.shingles(t) for t in texts]
    wanted = joined(len(texts), N.similar_pairs(sets))
    for block in (200, 50, 13):
        placed, rows = blocked(spark, texts, block)
        where = {N._key(t) - (1 << 63): i for i, t in enumerate(texts)}
        links = [(where[r.a], where[r.b]) for r in N.near_links(rows).collect()]
        assert joined(len(texts), links) == wanted
        assert placed.count() <= len(texts) * max(1, -(-len(texts) // block))


def joined(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return [find(i) for i in range(n)]


def test_counts_of_common_shingles():
    random.seed(9)
    for n, high in ((3, 20), (40, 60), (90, 300)):
        sets = [np.unique(np.array([random.randrange(high) for _ in range(random.randint(1, 80))], dtype=np.uint64)) for _ in range(n)]
        counts = N.common_counts(sets)
        for i in range(n):
            for j in range(n):
                assert counts[i, j] == (len(np.intersect1d(sets[i], sets[j])) if i < j else 0)


def test_buckets_of_similar_sets():
    """Of pairs at 0.8, two in a million share no bucket."""
    random.seed(10)
    missed = 0
    for _ in range(3000):
        common = [random.getrandbits(64) for _ in range(80)]
        a, b = (np.unique(np.array(common + [random.getrandbits(64) for _ in range(10)], dtype=np.uint64)) for _ in "ab")
        one, other = (N.buckets(N.minima(x)[None, :]) for x in (a, b))
        missed += not (one == other).any()
    assert missed == 0


def test_fingerprints_link_without_a_common_bucket(spark):
    """Links of two bits, and chains of them, join texts that share no MinHash bucket."""
    prints = {1: 0, 2: 0b11, 3: 0b1111, 4: 0b111 << 20, 5: -1, 6: -1, 7: 0x5555555555555555}
    rows = [(key, [100 + key, 200 + key], value) for key, value in prints.items()]
    frame = spark.createDataFrame(rows, "key long, buckets array<long>, print long")
    assert sorted((r.key, r.cluster) for r in N.clusters(frame).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]


def test_sketches_have_the_fingerprint(spark):
    texts = ["a b c d e f g", "A  b c d e f g", "", None, "one two"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = {r.i: r.print for r in frame.select("i", N.sketch(F.col("text")).alias("s")).select("i", "s.*").collect()}
    assert [found[i] & (2**64 - 1) for i in range(5)] == [simhash.simhash(t or "") for t in texts]

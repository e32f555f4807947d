import re
from collections import defaultdict

import pytest

from stepguard.llm import mixing as M


def plain_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_ones, target = sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in open_ones)
        share = {s: left * weight[s] / total for s in open_ones}
        over = [s for s in open_ones if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_ones.remove(s)


def test_odd_documents(docs, rows, clashing, no_docs):
    got = M.mixture_digest(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    wanted = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        taken[r.source] += r.taken
    longest = max(r.size for r in got)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= (longest if source == "b" else 200)
    again = M.mixture_digest(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert M.mixture_digest(clashing).count() == len(rows)
    assert M.mixture_digest(no_docs).count() == 0


def test_mixed_rows_follow_the_decisions(docs, rows, clashing):
    copies = sum(r.copies for r in M.mixture(docs).collect())
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
    assert M.mix(clashing).columns == clashing.columns


def test_even_share_of_documents(spark):
    """Each document of a source is as likely as its rate, over many sources alike."""
    rows = [(i, "w " * (1 + i % 7), f"s{i % 40:02d}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = defaultdict(list)
    for r in M.mixture(frame).collect():
        taken[int(r.source[1:]) % 3].append((r.copies, r.target / r.source_size))
    for pairs in taken.values():
        mean = sum(c for c, _ in pairs) / len(pairs)
        rate = sum(p for _, p in pairs) / len(pairs)
        assert abs(mean - rate) < 0.03

import zlib
from collections import defaultdict

import numpy as np

from stepguard.llm import sharding as S


def plain_differencing(sizes: list[int], parts: int) -> list[int]:
    """Part sums by the textbook rule, for groups in one list."""
    held = [[s] + [0] * (parts - 1) for s in sizes]
    while len(held) > 1:
        held.sort(key=lambda p: p[-1] - p[0])
        a, b = held.pop(0), held.pop(0)
        held.append(sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True))
    return sorted(held[0])


def test_differencing_against_the_textbook():
    random = np.random.default_rng(2)
    for parts in (2, 3, 24):
        sizes = np.unique(random.integers(1, 10_000, 200))[::-1]
        sums = np.zeros((len(sizes), parts), dtype=np.int64)
        sums[:, 0] = sizes
        labels = S.differenced(sums)[:, 0]
        got = sorted(np.bincount(labels, sizes, parts).astype(int).tolist())
        assert sum(got) == sizes.sum() and max(got) - min(got) <= sizes.max()
        textbook = plain_differencing(sizes.tolist(), parts)
        assert max(got) - min(got) <= max(2, 2 * (textbook[-1] - textbook[0]))


def test_every_part_of_a_row_gets_another_label():
    sums = np.random.default_rng(4).integers(0, 99, (50, 6))
    assert all(sorted(row) == list(range(6)) for row in S.differenced(sums).tolist())


def checked(frame, rows, monkeypatch=None):
    got = S.shard_digest(frame).collect()
    assert len(got) == len(rows)
    slots, shard_of = defaultdict(list), {}
    sizes = defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got:
        assert shard_of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    return got, sizes


def test_odd_documents(docs, rows, clashing, no_docs):
    got, sizes = checked(docs, rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] not in (7, 8)}
    for r in got:
        if r.doc_id in texts:
            data = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    rest = sorted(sizes.values())[:-4]  # two long texts and what is left beside them
    assert max(rest) - min(rest) <= 3000
    assert S.shard_digest(clashing).count() == len(rows)
    assert S.shard_digest(no_docs).count() == 0


def test_levels_of_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_GROUPS", 10)
    monkeypatch.setattr(S, "FAN", 3)
    monkeypatch.setattr(S, "SLOT_ROWS", 1)
    checked(docs, rows)

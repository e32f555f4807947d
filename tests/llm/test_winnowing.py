import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepguard.llm import winnowing as W


def plain(text: str, gram: int, window: int) -> list[tuple[int, int]]:
    if not text:
        return []
    if len(text) < gram:
        return [(0, int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "big"))]
    values = []
    for i in range(len(text) - gram + 1):
        value = 0
        for c in text[i : i + gram]:
            value = (value * int(W.BASE) + ord(c) + 1) % 2**64
        values.append(int(W.mixed(np.array([value], dtype=np.uint64))[0]) >> 32)
    found: list = []
    for start in range(max(1, len(values) - window + 1)):
        part = values[start : start + window]
        place = start + max(i for i, v in enumerate(part) if v == min(part))
        if not found or found[-1] != (place, values[place]):
            found.append((place, values[place]))
    return found


def made(n: int, letters: str = "ab é🙂") -> str:
    return "".join(random.choice(letters) for _ in range(n))


@pytest.mark.parametrize(("gram", "window"), [(1, 1), (5, 4), (12, 16), (24, 48), (7, 9)])
def test_against_plain_windows(gram, window):
    random.seed(gram)
    texts = [made(n) for n in (0, 1, 3, gram - 1, gram, gram + 1, gram + window - 1, gram + window, 200, 500)]
    texts += ["a" * 100, ""]
    found = W.fingerprints(texts, gram, window)
    for i, text in enumerate(texts):
        mine = found.text == i
        pairs = list(zip(found.position[mine].tolist(), found.hash[mine].tolist(), strict=True))
        assert pairs == plain(text, gram, window)


def test_shared_passages_are_found():
    random.seed(9)
    shared = made(W.GRAM + W.WINDOW - 1, "abcdefgh")
    found = W.fingerprints([made(300, "abcdefgh") + shared, shared + made(77, "abcdefgh"), made(400, "abcdefgh")])
    hashes = [set(found.hash[found.text == i].tolist()) for i in range(3)]
    assert hashes[0] & hashes[1] and not hashes[0] & hashes[2]


def expected(rows: list[tuple]) -> list[tuple]:
    ordered = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "") for r in rows))
    ids = [i if has else None for has, i, _, _ in ordered]
    texts = [t for *_, t in ordered]
    out = []
    for place, (key, text) in enumerate(zip(ids, texts, strict=True)):
        following = texts[(place + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        sets = [{h for _, h in plain(t, W.GRAM, W.WINDOW)} for t in (text, edited, following)]

        def near(a: set, b: set) -> float:
            return len(a & b) / len(a | b) if a | b else 1.0

        out.append((str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(), near(sets[0], sets[1]), near(sets[0], sets[2])))
    return sorted(out)


def test_next_documents_across_ranges(docs, rows):
    short = docs.filter((F.length("text") < 3000) | F.col("text").isNull())
    kept = [r for r in rows if r[1] is None or len(r[1]) < 3000]
    got = W.compare_with_next(short).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == expected(kept)
    by_text: dict = {}
    texts = {r[0]: r[1] for r in kept if r[0] not in (None, 7, 8)}
    for r in got:
        if r.doc_id in texts:
            assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_long_texts_single_documents_and_empty_table(spark, docs, rows, clashing, no_docs):
    assert W.compare_with_next(docs).count() == len(rows)
    assert W.compare_with_next(clashing).count() == len(rows)
    assert W.compare_with_next(no_docs).count() == 0
    one = W.compare_with_next(spark.createDataFrame([(1, "just one")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    column = docs.select(W.fingerprint_column(F.col("text")).alias("f"))
    assert column.filter(F.size("f") == 0).count() == 3

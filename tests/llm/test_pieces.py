import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepguard.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def model():
    return P.Pieces(*P.model_parts(P.MODEL))


def plain_viterbi(text: str, model: P.Pieces, parts) -> list[int]:
    names = {b.decode(): (s, i) for i, (b, s, k) in enumerate(zip(model.blobs, parts[1], parts[2], strict=True)) if k == "normal"}
    if not text:
        return []
    text = " " + text
    best: list = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        found = None
        for size in range(min(end, model.longest), 0, -1):
            word = text[end - size : end]
            score = names[word][0] if word in names else model.unknown if size == 1 else None
            if score is not None and (found is None or best[end - size][0] + score > found[0]):
                found = (best[end - size][0] + score, size)
        best.append(found)
    ids, end = [], len(text)
    while end:
        word = text[end - best[end][1] : end]
        ids[:0] = [names[word][1]] if word in names else [model.byte_ids[b] for b in word.encode()]
        end -= len(word)
    return ids


def encoded(encoder: P.Encoder, texts: list[str]) -> list[np.ndarray]:
    ids, ends = encoder.encode(texts)
    return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def test_against_plain_search(model, rows):
    texts = [(t or "")[:1500] for _, t, *_ in rows]
    got = encoded(P.Encoder(model), texts)
    parts = P.model_parts(P.MODEL)
    assert all(g.tolist() == plain_viterbi(t, model, parts) for g, t in zip(got, texts, strict=True))


def test_forgetting_changes_nothing(model, rows, monkeypatch):
    texts = [t or "" for _, t, *_ in rows]
    one = encoded(P.Encoder(model), texts)
    monkeypatch.setattr(P, "MOST_WORDS", 5)
    other = P.Encoder(model)
    two = [ids for text in texts for ids in encoded(other, [text])]
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_round_trip(docs, rows, clashing, no_docs):
    got = P.with_pieces(docs)
    assert got.columns == [*docs.columns, "token_ids", "n_tokens", "round_trip"]
    found = got.collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    assert all(len(r.token_ids) == r.n_tokens == 0 for r in found if not r.text)
    texts = got.select(P.decoded(F.col("token_ids")).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    assert texts.filter("t = text").count() == len(rows)
    again = P.with_pieces(clashing)
    assert again.columns.count("n_tokens") == 1 and again.filter("round_trip").count() == len(rows)
    assert P.with_pieces(no_docs).count() == 0

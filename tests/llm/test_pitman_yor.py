import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stepguard.llm import pitman_yor as P


def plain(rows: list[tuple]) -> list[tuple]:
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in tokens]
    counts = Counter(t for (_, words), out in zip(tokens, held, strict=True) if not out for t in words)
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for (key, words), is_out in zip(tokens, held, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        out.append((str(key), is_out, len(words), sum(counts[w] > 0 for w in words), total, round(base, 4)))
    return sorted(out)


def test_counts_and_base_score(docs, rows, clashing):
    got = P.score_digest(docs).collect()
    found = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got
    )
    wanted = plain(rows)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert [f[5] for f in found] == pytest.approx([w[5] for w in wanted], abs=2e-3)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert P.score_digest(clashing).count() == len(rows)


def test_small_and_empty_tables(spark, no_docs):
    assert P.score_digest(no_docs).count() == 0
    one = P.score_digest(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].n_tokens == 1 and math.isfinite(one[0].score)


def test_better_than_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in P.score_digest(docs).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.3


def test_probabilities_add_up(docs):
    model, rare = P.fitted(docs)
    assert np.allclose((10.0**model.class_logs).sum(axis=1), 1.0)
    known = sum(10**r.log_p for r in rare.collect())
    assert known + 10 ** model.words.log_unknown() == pytest.approx(1.0, abs=1e-6)


def test_letters_are_a_distribution_over_words():
    words = [b"ab", b"abc", b"b", b"cab"]
    cells, counts = P.letter_events(words, np.array([5, 2, 1, 1]))
    assert counts.sum() == sum(n * (len(w) + 1) for w, n in zip(words, [5, 2, 1, 1], strict=True))
    letters = P.letter_model(cells, counts, [], 3)
    assert np.allclose(np.exp(letters.logs.astype(float)).sum(axis=1), 1.0, atol=1e-4)
    assert letters.spelled([b"ab"])[0] > letters.spelled([b"zq"])[0]


def test_seating():
    counts = np.array([0, 1, 2, 50, 100_000])
    dish = np.arange(5, dtype=np.uint64)
    tables = P.seated(counts, np.full(5, 2.0), 0.5, dish, 1)
    assert tables[0] == 0 and tables[1] == 1 and all(tables <= counts) and tables[4] > tables[3]
    assert (tables == P.seated(counts, np.full(5, 2.0), 0.5, dish, 1)).all()
    few = P.seated(counts, np.full(5, 1e-9), 0.5, dish, 1)
    assert (few[1:] == 1).all()
    # the mean of many tables follows the sum of the chances of a new one
    many = P.seated(np.full(4000, 20), np.full(4000, 3.0), 0.0, np.arange(4000, dtype=np.uint64), 2)
    assert many.mean() == pytest.approx(1 + sum(3 / (3 + n) for n in range(1, 20)), rel=0.03)


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (4, 0.9), (40, 0.02), (64, 0.5), (5000, 0.001), (5000, 0.7)])
def test_draws_follow_the_binomial_distribution(n, p):
    keys = np.arange(40_000, dtype=np.uint64)
    hits = P.drawn(np.full(len(keys), n), np.full(len(keys), p), keys, 3)
    assert (hits == P.drawn(np.full(len(keys), n), np.full(len(keys), p), keys, 3)).all()
    assert 0 <= hits.min() and hits.max() <= n
    assert hits.mean() == pytest.approx(n * p, abs=4 * math.sqrt(n * p * (1 - p) / len(keys)) + 1e-9)
    assert hits.var() == pytest.approx(n * p * (1 - p), rel=0.04)
    if n <= 40:
        for k in range(n + 1):
            share = math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert np.mean(hits == k) == pytest.approx(share, abs=4 * math.sqrt(share / len(keys)) + 1e-4)


def test_draws_at_the_ends():
    keys = np.arange(4, dtype=np.uint64)
    assert P.drawn(np.array([5, 5, 0, 1]), np.array([0.0, 1.0, 0.5, 1.0]), keys, 1).tolist() == [0, 5, 0, 1]
    assert len(P.drawn(np.zeros(0, np.int64), np.zeros(0), keys[:0], 1)) == 0


def rare_pairs() -> list[tuple]:
    """Two rare words with the same end, each before a rare word of its own, among common words."""
    rows, key = [], 0
    for i in range(60):
        words = [f"c{(i * 7 + j * j) % 12}" for j in range(300)]
        if i % 8 == 0:
            words[50:52], words[150:152] = ["xqab", "first"], ["yqab", "other"]
            words[250:252] = ["xqab", "c1"]
        while zlib.crc32(str(key).encode()) % 10 == 0:
            key += 1
        rows.append((key, " ".join(words)))
        key += 1
    return rows


def test_rare_words_have_contexts_of_their_own(spark):
    held = [k for k in range(1000, 1200) if zlib.crc32(str(k).encode()) % 10 == 0][:4]
    probes = dict(zip(held, ["xqab first", "yqab other", "xqab other", "yqab first"], strict=True))
    rows = rare_pairs() + list(probes.items())
    got = {r.doc_id: r for r in P.score_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].held_out and got[k].n_known == 3 for k in held)
    seen, swapped = (sum(got[k].score for k in ks) for ks in (held[:2], held[2:]))
    assert seen > swapped + 1.0


def test_probabilities_after_every_word_add_up(spark):
    docs = spark.createDataFrame(rare_pairs(), "doc_id long, text string")
    model, rare, gains = P.learned(docs)
    words = [f"c{i}" for i in range(12)] + ["xqab", "yqab", "first", "other"]
    hashed = dict(zip(words, P._hashes([w.encode() for w in words]), strict=True)) | {"": P._hashes([b""])[0]}
    table = {r["hash"] & (2**64 - 1): r for r in rare.collect()}
    gained = {r["hash"] & (2**64 - 1): r.gain for r in gains.collect()}
    assert {w for w in words if int(hashed[w]) in table} == {"xqab", "yqab", "first", "other"}
    assert all(g > 0 for g in gained.values())
    for before in ["", *words]:
        own = table.get(int(hashed[before]))
        context = P.END if before == "" else model.classes.context(before.encode())
        total = 0.0
        for word in ["", *words, None]:  # the end, the known words, any other
            kind = P.END if word == "" else model.classes.of.get((word or "").encode(), P.RARE)
            log = model.class_logs[context, kind]
            if kind == P.RARE:
                log += table[int(hashed[word])].log_p if word else model.words.log_unknown()
            if own is not None:
                log += own.log_rest
            elif kind == P.RARE:
                log += model.context_logs[context]
            if word is not None:
                pair = P._pair_hashes(np.array([hashed[before]]), np.array([hashed[word]]))[0]
                log += gained.get(int(pair), 0.0)
            total += 10**log
        assert total == pytest.approx(1.0, abs=1e-9)


def test_every_sweep_seats_the_pairs_anew_and_their_tables_go_to_the_parents(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    key, rows = 0, []
    for i in range(240):
        while zlib.crc32(str(key).encode()) % 10 == 0:
            key += 1
        rows.append((key, " ".join(words[7 * (i % 40) + k * j] for j in range(40) for k in (1, 3))))  # each six times
        key += 1
    seats, own = [], P._seat_pairs

    def kept(*args):
        out = own(*args)
        seats.append({(r.kind, r.key): r.more for r in out.collect()})
        return out

    monkeypatch.setattr(P, "COMMON", 0.01)  # all of the words are rare
    monkeypatch.setattr(P, "_seat_pairs", kept)
    model, rare, _ = P.learned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.classes.words == []
    assert len(seats) == P.BURN_IN + P.SAMPLES and all(seats) and seats[0] != seats[1] != seats[2]
    pairs = Counter(p for _, text in rows for w in [text.split()] for p in zip(["", *w], [*w, ""], strict=True))
    distinct = Counter(after for _, after in pairs if after)
    samples = model.words.samples
    assert samples[0].customers == sum(distinct.values())
    hashed = dict(zip(words, P._hashes([w.encode() for w in words]).view(np.int64).tolist(), strict=True))
    found = {r["hash"]: r for r in rare.collect()}
    for at, more in enumerate(seats, 1):
        assert samples[at].customers == samples[0].customers + sum(n for (kind, _), n in more.items() if kind == P.WORD)
        assert sum(model.context_tables[at]) == sum(b == "" for b, _ in pairs) + sum(
            n for (kind, _), n in more.items() if kind == P.CLASS_CONTEXT
        )
    after = Counter(before for before, _ in pairs)
    for w in {w for w, _ in pairs if w}:
        mean = np.mean([after[w] + more.get((P.CONTEXT, hashed[w]), 0) for more in seats[P.BURN_IN :]])
        row = found[hashed[w]]
        assert row.log_rest == pytest.approx(math.log10((1 + model.pair_discount * mean) / (1 + row["count"])))


def test_word_hashes_are_those_of_spark(spark):
    words = ["", "a", "école", "漢字 and more than thirty-two bytes of it"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    found = {r.word: r.h for r in frame.selectExpr("word", "xxhash64(word) AS h").collect()}
    assert [found[w] for w in words] == P._hashes([w.encode() for w in words]).view(np.int64).tolist()


def stored_bytes(folder) -> dict[str, int]:
    sizes = {}
    for f in folder.rglob("*.parquet"):
        name = f.parent.name.rsplit("-", 1)[0]
        sizes[name] = sizes.get(name, 0) + f.stat().st_size
    return sizes


def test_pairs_seen_once_are_not_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "scratch_path", lambda _, name: str(tmp_path / f"{name}-x"))
    # a word of its own after each word: every pair is seen once, in one part
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(2000))) for i in range(40)]
    scored = P.score_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r.n_tokens == 2001 and math.isfinite(r.score) for r in scored)
    kept = stored_bytes(tmp_path)
    pairs = 40 * 2001
    assert set(kept) == {"parts", "shared", "contexts", "looked", "told"}
    assert kept["shared"] + kept["contexts"] < pairs
    assert sum(kept.values()) < 60 * pairs


def test_parts_have_all_tokens(spark, docs, rows, monkeypatch):
    whole = {(r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in P.score_digest(docs).collect()}
    monkeypatch.setattr(P, "PART_BYTES", 3_000)
    monkeypatch.setattr(P, "BUCKET_PAIRS", 500)
    parts = {(r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in P.score_digest(docs).collect()}
    assert parts == whole


def test_grouped_keys_are_those_of_unique():
    for keys in (np.array([5, 1, 5, 0, 1, 5]), np.array([2**62, 7, 2**62]), np.zeros(0, np.int64)):
        found, place = P._grouped(keys)
        wanted, back = np.unique(keys, return_inverse=True)
        assert (found == wanted).all() and (place == back).all()


def test_words_by_hash_have_the_classes_and_contexts_of_their_letters():
    classes = P.Classes([b"a", b"of", b"the"])
    words = [b"a", b"x", b"the", b"ethe", "é".encode(), b"of"]
    dish, context = classes.kinds(P._hashes(words), P._endings(words))
    assert dish.tolist() == [classes.of.get(w, P.RARE) for w in words] + [P.END]
    assert context.tolist() == [classes.context(w) for w in words] + [P.END]

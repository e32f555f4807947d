import random

import xxhash

from stepguard.llm import simhash as S
from stepguard.llm.components import components


def plain_print(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints: list[int]) -> list[int]:
    """Smallest index that each index reaches."""
    root = list(range(len(prints)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(prints))]


def test_prints(rows):
    for text in [r[1] or "" for r in rows if len(r[1] or "") < 3000][:120] + ["a", "A b", "a b c", "KK ſ", ""]:
        assert S.simhash(text) == plain_print(text)


def test_links_of_dense_prints(spark):
    """Many prints within a few bits, which fill shards so that they are cut again."""
    random.seed(1)
    seeds = [random.getrandbits(64) for _ in range(6)]
    prints = {s ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for s in seeds for _ in range(150)}
    prints |= {random.getrandbits(64) for _ in range(100)}
    ordered = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in ordered], "print bigint")
    wanted = plain_groups(ordered)
    for size in (4, 2048):
        found = components(S.near_links(frame, size)).collect()
        root = {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in found}
        groups: dict = {}
        for p, g in zip(ordered, wanted, strict=True):
            groups.setdefault(g, set()).add(root.get(p, p))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(7, 7), (1000, 3), (3, 1000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[49] == 1 and got[1000] == 1 and got[51] == 51 and got[200] == 151
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(docs, rows, clashing, no_docs):
    got = S.group_digest(docs).collect()
    assert len(got) == len(rows)
    distinct = sorted({S.simhash(r[1] or "") for r in rows})
    group_of = dict(zip(distinct, plain_groups(distinct), strict=True))
    first: dict = {}
    for key, text, *_ in rows:
        if key is not None:
            g = group_of[S.simhash(text or "")]
            first[g] = min(first.get(g, key), key)
    wanted = sorted(
        (str(r[0]), f"{S.simhash(r[1] or ''):016x}", str(first.get(group_of[S.simhash(r[1] or "")]))) for r in rows
    )
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == wanted
    assert S.group_digest(clashing).count() == len(rows)
    assert S.group_digest(no_docs).count() == 0
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group_of.values()))
    again = S.drop_near_copies(clashing)
    assert again.columns == clashing.columns and again.count() == kept.count()
    assert S.drop_near_copies(no_docs).count() == 0

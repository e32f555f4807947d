import hashlib
import itertools
import math
import random
import re
import string
from collections import Counter
from statistics import NormalDist, fmean

import pytest

from stepguard.llm import secret_scan as S


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns once more, as they are stated."""
    found = []
    for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text
    ):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


UPPER, LOWER, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
#: characters in order, sums of squares and of cubes of the shares in ordinary tokens
ALPHABETS = [
    (DIGITS + "abcdef", 0.105, 0.0150), (DIGITS + "ABCDEF", 0.105, 0.0150), (UPPER + "234567", 0.066, 0.0056),
    (DIGITS + LOWER, 0.066, 0.0056), (DIGITS + UPPER + LOWER, 0.066, 0.0056),
    (UPPER + LOWER + DIGITS + "+/", 0.066, 0.0056), (UPPER + LOWER + DIGITS + "-_", 0.066, 0.0056),
]
TAIL = NormalDist()


def plain_battery(token: str):
    """(p of ordinary, least corrected p of random), from sums over characters; None without encoding."""
    token = token.rstrip("=")
    if len(token) < 16 or token.isdigit() or token.isalpha() and (token[1:].islower() or token.isupper()):
        return None
    fitting = [a for a in ALPHABETS if all(c in a[0] for c in token)]
    if not fitting:
        return None
    alphabet, squares, cubes = fitting[0]
    n, k = len(token), len(alphabet)
    chi = sum((Counter(token)[c] - n / k) ** 2 / (n / k) for c in alphabet)
    mean = k - 1 + (n - 1) * (k * squares - 1)
    variance = 4 * n * k**2 * (cubes - squares**2) + 2 * (k * squares) ** 2
    ordinary = TAIL.cdf(-(mean - chi) / variance**0.5)
    p = [TAIL.cdf(-(chi - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5)]
    places = [alphabet.index(c) for c in token]
    high = [x >= k / 2 for x in places]
    runs = len(list(itertools.groupby(high)))
    ups, downs = sum(high), n - sum(high)
    if ups and downs:
        middle = 2 * ups * downs / n + 1
        spread = 2 * ups * downs * (2 * ups * downs - n) / (n * n * (n - 1))
        if spread > 0:
            p.append(2 * TAIL.cdf(-abs(runs - middle) / spread**0.5))
    else:
        p.append(2 * 0.5**n)
    centre = fmean(places)
    power = sum((x - centre) ** 2 for x in places)
    serial = sum((x - centre) * (y - centre) for x, y in itertools.pairwise(places)) / power if power else 1
    p.append(2 * TAIL.cdf(-abs(serial + 1 / n) * n**0.5))
    return ordinary, min(1, len(p) * min(p))


def wordy(piece: str) -> bool:
    piece = piece.rstrip("=")
    letters = piece.rstrip(DIGITS)
    if not letters:
        return True
    if len(piece) - len(letters) > 2 or not letters.isalpha():
        return False
    humps = re.split("(?<=.)(?=[A-Z])", letters)
    camel = all(len(h) >= 3 for h in humps[1:]) and len(humps[0]) >= (3 if humps[0][0].isupper() else 2)
    return letters[1:].islower() or len(letters) == 1 or letters.isupper() or camel


def forms(run: str):
    """Offsets of core and whole, and of parts."""
    pieces, at = [], 0
    for piece in re.split("([/+_-])", run):
        if piece and piece not in "/+_-":
            pieces.append((at, at + len(piece), wordy(piece)))
        at += len(piece)
    inside = [i for i, piece in enumerate(pieces) if not piece[2]]
    if not inside:
        return [(0, len(run))], []
    start, end = pieces[inside[0]][0], pieces[inside[-1]][1]
    start, end = start if start >= 4 else 0, end if len(run) - end >= 4 else len(run)
    outer = list(dict.fromkeys([(start, end), (0, len(run))]))
    return outer, [
        (s, e) for s, e, _ in pieces[inside[0] : inside[-1] + 1] if e - s >= 16 and (s, e) not in outer
    ]


def brute_force(texts: dict[int, str]) -> dict[int, str]:
    """All spans: the battery above, and the step-up rule on the p-values themselves in their order."""
    tested = {}
    for key, text in texts.items():
        base = base_spans(text)
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}(=+(?![A-Za-z0-9+/_=-]))?", text):
            for rank, spans in enumerate(forms(m[0])):
                for s, e in spans:
                    s, e = s + m.start(), e + m.start()
                    p = plain_battery(text[s:e])
                    if p and not any(a < e and s < b for a, _, b in base):
                        tested[key, m.start(), rank, s, e] = p
    classes = lambda n: sum(n >= first for first in (20, 28, 40, 64))
    cut = {}
    for c in {classes(e - s) for _, _, _, s, e in tested}:
        ordered = sorted(p for (_, _, _, s, e), (p, _) in tested.items() if classes(e - s) == c)
        cut[c] = max([p for i, p in enumerate(ordered, 1) if p <= 0.05 * i / len(ordered)], default=-1)
    good = [f for f, (p, plain) in tested.items() if p <= cut[classes(f[4] - f[3])] and plain >= 1e-3]
    out = {key: [(s, k, e) for s, k, e in base_spans(text)] for key, text in texts.items()}
    for (key, _), found in itertools.groupby(good, key=lambda f: f[:2]):
        found = list(found)
        outer = [f for f in found if f[2] == 0]
        out[key] += [(s, 3, e) for _, _, _, s, e in (outer[:1] or found)]
    return {key: ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)) for key, spans in out.items()}


def planted() -> dict[int, str]:
    random.seed(5)

    def token(alphabet: str, n: int) -> str:
        return "".join(random.choice(alphabet) for _ in range(n))

    texts = {i: f"See {token(string.ascii_letters + string.digits, 40)} here" for i in range(40)}
    texts |= {100 + i: "a_very_long_name_of_a_thing and internationalisation 1234567890123456" for i in range(40)}
    texts[200] = 'x password = "hunter22" AKIA' + "ABCD1234" * 2 + " " + "0f" * 12 + " API_KEY:abcde token='x"
    texts[201] = "é🙂 secret=abcdef password:12345"
    return texts


def test_spans_against_brute_force(spark, docs, rows):
    texts = planted()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in S.secret_digest(frame).collect()}
    assert {k: r.spans for k, r in got.items()} == brute_force(texts)
    for key, text in texts.items():
        wanted = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base_spans(text))
        assert got[key].base_sha256 == hashlib.sha256(wanted.encode()).hexdigest()
    assert sum(got[i].n_random for i in range(40)) >= 38
    assert sum(got[i].n_random for i in range(100, 140)) == 0
    assert (got[200].n_assign, got[200].n_access, got[200].n_hex) == (1, 1, 1)
    assert got[201].n_assign == 1


def test_odd_documents(docs, rows, clashing, no_docs):
    got = S.secret_digest(docs).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.spans == "" and r.base_sha256 == empty for r in got if r.doc_id is None)
    assert S.secret_digest(clashing).count() == len(rows)
    assert S.secret_digest(no_docs).count() == 0


def test_tests_tell_random_from_ordinary():
    ordinary, random_like = S.battery("a_very_long_name_of_a_thing")
    assert ordinary > 0.05
    ordinary, random_like = S.battery("k9Xq2LmZ7vTb4RnW8sYd3HfJ6cPgA1uE")
    assert ordinary < 1e-3 and random_like > 1e-3
    assert S.battery("aaaaaaaaaaaaaaaaaaaa1111")[1] < 1e-3
    assert S.battery("internationalisation") is None and S.battery("1" * 30) is None


def test_cuts_follow_the_step_up_rule():
    counts = [(0, 0, 90), (0, 30, 5), (0, 50, 5)]
    assert S.cuts(counts, 0.05) == {0: 30}
    assert S.cuts([(0, 0, 10), (1, 40, 1)], 0.05) == {1: 40}
    assert S.cuts([], 0.05) == {}


PREFIXES = [
    "", "AWS_SECRET_ACCESS_KEY=", "GITHUB_PAT=", "sig=", "/my-app/", "/home/user/documents/project/old/",
    "very_long_name_of_a_thing_that_is_ordinary_", "my_service_prefix_name_", "myService/",
]


def test_tokens_behind_names_and_in_paths(spark):
    """Nine in ten or more by their own span in each form, names alone never; all as brute force has it."""
    random.seed(8)
    letters = string.ascii_letters + string.digits
    texts, wanted = {}, {}
    for i in range(40 * len(PREFIXES)):
        name = PREFIXES[i % len(PREFIXES)]
        secret = "".join(random.choice(letters) for _ in range(40))
        texts[i], wanted[i] = f"see {name}{secret} here", f"random:{4 + len(name)}:{44 + len(name)}"
    for i, name in enumerate(PREFIXES):
        texts[-1 - i] = f"see {name}of_some_other_ordinary_thing and {name}report-of-march-2024/page_17 here"
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.spans for r in S.secret_digest(frame).collect()}
    assert found == brute_force(texts)
    for at, name in enumerate(PREFIXES):
        assert sum(wanted[i] in found[i].split(",") for i in range(at, len(wanted), len(PREFIXES))) >= 36, name
        assert "random" not in found[-1 - at]


@pytest.mark.parametrize("alphabet", [a for a, _, _ in ALPHABETS])
def test_battery_against_sums_over_characters(alphabet):
    random.seed(4)
    for n in (16, 17, 24, 40, 200):
        token = "".join(random.choice(alphabet) for _ in range(n))
        got, wanted = S.battery(token), plain_battery(token)
        assert (got is None) == (wanted is None)
        assert got is None or all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-14) for a, b in zip(got, wanted, strict=True))


def test_padding_belongs_to_a_token():
    body = "k9Xq2LmZ7vTb4RnW8sYd3HfJ6cPgA1u"
    assert S.candidates(f"a {body}== b") == [([(2, 4 + len(body))], [])]
    assert S.candidates(f"{body}={body}") == [([(0, len(body))], []), ([(len(body) + 1, 2 * len(body) + 1)], [])]


def test_forms_of_a_run():
    body = "k9Xq2LmZ7vTb4RnW8sYd3HfJ6cPgA1u"
    text = f"/old/files/{body}/{body}-name"
    core, whole = (11, 12 + 2 * len(body)), (0, len(text))
    assert S.candidates(text) == [([core, whole], [(11, 11 + len(body)), (12 + len(body), core[1])])]
    assert S.candidates("of_some_other_ordinary_thing") == [([(0, 28)], [])]

"""A hierarchical Pitman-Yor language model over words and their spelling.

The levels, each a set of Chinese restaurants whose tables are customers of the
restaurant above:

* A *word* after the word before: a restaurant for every word as context, common or
  rare, and one for the start of a text. No context and no pair is left out or merged.
  Its parent is the product of the next two levels. Where both words are classes of
  their own, the restaurant is that of the class.
* A *class* per token. Words that make up one token in ``COMMON`` or more are
  classes of their own, as is the end of a text; all other words are in one class.
  There is a restaurant for each class as context; rarer words share one per hash of
  their last two bytes, as the parent of their own restaurants. All contexts share one
  parent without context, which rests on equal shares.
* A *word* of the rare class. One restaurant seats all of them.
* The *letters* of a word, as bytes with an end sign. The word restaurant's tables
  are customers of restaurants with the two bytes before as context; these share
  parents with one byte of context, and these one without, over equal shares.

A word that was never seen in training counts as one token type, as in the base
score: its probability is that of any word but the known ones, which is what the
word restaurant leaves to the letters less what the letters give to known words.

Seating is sampled by Gibbs sweeps over all levels, pairs first: their tables are the
customers of the classes and words, whose tables are those of the letters. In a sweep, all
customers of a dish leave and are seated again, given the tables of the other dishes and the
parent's probabilities of the sweep before. At first each pair has one table, from which the
parents take a sweep. The first ``SINGLE`` customers are seated one by
one; after them blocks of an eighth of those seated join together: how many of a block
open a table is drawn at the chance that holds at the block's start (a binomial draw),
so the work grows with the logarithm of a count. Draws are hashes of the dish and the step: reruns and retried tasks
agree, wherever a row is. After ``BURN_IN`` sweeps the predictive probabilities of
``SAMPLES`` sweeps are averaged, level by level: that of pairs over the averages of their parents.

What is gathered: the counts of all training words and of all pairs of them (they grow
with the input and stay in tables), and the counts of classes in contexts. There are at
most ``1 / COMMON`` classes more than two and ``1 / COMMON + SUFFIXES`` contexts, so the
class model is bounded for any input, and so is the letter model (bytes). Only
these two are broadcast. Rare words and pairs meet their probabilities in a join on a
64-bit hash; no rare word makes up ``COMMON`` of the tokens and a pair looked up has one,
so the join has no hot key. A text's score is what its words give without pairs, and the
gain of each pair that was seen in training.

Null text is empty and has one token, its end. Documents are kept apart by a row
number, so repeated ids and rows do no harm.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepguard.llm.common import mixed, slices, uniform
from stepguard.session import scratch_path

# The share held out and the smoothing of the base score.
FOLDS, HELD_OUT = 10, 0
SMOOTHING = 0.1

COMMON = 1e-3
SUFFIXES = 1024
BURN_IN, SAMPLES = 1, 2
SINGLE = 32
CLASS_STRENGTH, CLASS_DISCOUNT = 5.0, 0.6
ROOT_STRENGTH, ROOT_DISCOUNT = 1.0, 0.1
PAIR_STRENGTH = 1.0
WORD_STRENGTH = 1.0
LETTER_STRENGTH, LETTER_DISCOUNT = 1.0, 0.3
SYMBOLS = 257  # bytes and the end of a word; as context, the start of a word
END, RARE = 0, 1
PART_BYTES = 12_000_000
BUCKET_PAIRS = 1_000_000  # at most, in tokens
PART = ("part", "held_out", "size", "token", "hash", "ending")


def drawn(trials: np.ndarray, chance: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """Binomial draws by hash: the inverse of the distribution up to a mean of 30, a normal beyond."""
    flip = chance > 0.5
    if (trials == 1).all():
        u = uniform(key, seed)
        return np.where(flip, u <= chance, u > 1.0 - chance).astype(np.int64)
    p = np.where(flip, 1.0 - chance, chance)
    mean = trials * p
    u = uniform(key, seed)
    hits = np.zeros(len(trials), dtype=np.int64)
    few = np.flatnonzero(mean <= 30)
    n, q, left = trials[few], p[few], u[few]
    share = np.exp(n * np.log1p(-q))  # of k successes
    k = 0
    while len(few):
        left = left - share
        on = (left > 0) & (k < n)
        few, n, q, left, share = few[on], n[on], q[on], left[on], share[on]
        share = share * (n - k) / (k + 1) * q / (1.0 - q)
        k += 1
        hits[few] = k
    many = np.flatnonzero(mean > 30)
    if len(many):
        turn = uniform(key[many], seed + 500)
        z = np.sqrt(-2.0 * np.log(np.maximum(u[many], 1e-300))) * np.cos(2.0 * np.pi * turn)
        value = np.rint(mean[many] + np.sqrt(mean[many] * (1.0 - p[many])) * z).astype(np.int64)
        hits[many] = np.clip(value, 0, trials[many])
    return np.where(flip, trials - hits, hits)


def seated(counts: np.ndarray, opening: np.ndarray, discount: float, dish: np.ndarray, seed: int) -> np.ndarray:
    """Tables of each dish after all of its customers were seated.

    ``opening`` is the weight of a new table: (strength + discount * tables) * parent.
    """
    n = np.minimum(counts, 1).astype(np.int64)
    tables = n.copy()
    active = np.flatnonzero(n < counts)
    step = 0
    while len(active):
        step += 1
        have, t = n[active], tables[active]
        block = np.minimum(np.where(have < SINGLE, 1, have // 8), counts[active] - have)
        chance = opening[active] / (opening[active] + have - discount * t)
        tables[active] = t + drawn(block, chance, dish[active], seed * 1000 + step)
        n[active] = have + block
        active = active[n[active] < counts[active]]
    return tables


@dataclass
class Level:
    """Restaurants of one level: customers and tables of (restaurant, dish) cells."""

    restaurant: np.ndarray
    dish: np.ndarray
    count: np.ndarray
    strength: float
    discount: float
    restaurants: int

    def __post_init__(self) -> None:
        self.tables = np.minimum(self.count, 1)
        self.customers = np.bincount(self.restaurant, self.count, self.restaurants)
        self.cell = self.restaurant.astype(np.uint64) << np.uint64(32) | self.dish.astype(np.uint64)

    def sweep(self, parent: np.ndarray, seed: int) -> None:
        """Seat everyone again; ``parent`` has the parent's probability of each cell's dish."""
        total = np.bincount(self.restaurant, self.tables, self.restaurants)
        opening = (self.strength + self.discount * total[self.restaurant]) * parent
        self.tables = seated(self.count, opening, self.discount, self.cell, seed)

    def probabilities(self, parent: np.ndarray) -> np.ndarray:
        """Predictive probabilities, one row per restaurant; ``parent`` has a row for each."""
        total = np.bincount(self.restaurant, self.tables, self.restaurants)
        below = self.strength + self.customers
        out = parent * ((self.strength + self.discount * total) / below)[:, None]
        own = (self.count - self.discount * self.tables) / below[self.restaurant]
        np.add.at(out, (self.restaurant, self.dish), own)
        return out


def merged(restaurant: np.ndarray, dish: np.ndarray, count: np.ndarray, dishes: int):
    """Customers of the same cell added up."""
    keys, place = np.unique(restaurant.astype(np.int64) * dishes + dish, return_inverse=True)
    return keys // dishes, keys % dishes, np.bincount(place, count).astype(np.int64)


@dataclass
class ClassSweeps:
    """The class restaurants and their parent, from sweep to sweep."""

    context: np.ndarray
    dish: np.ndarray
    contexts: int
    classes: int
    turn: int = 0

    def __post_init__(self) -> None:
        self.parent = np.full((1, self.classes), 1.0 / self.classes)
        self.tables = np.ones(len(self.dish), dtype=np.int64)

    def sweep(self, count: np.ndarray) -> np.ndarray:
        """The probability of each class in each context, after a sweep with so many customers of the cells."""
        low = Level(self.context, self.dish, count, CLASS_STRENGTH, CLASS_DISCOUNT, self.contexts)
        low.tables = np.minimum(self.tables, count)
        low.sweep(self.parent[0, self.dish], seed=2 * self.turn)
        even = np.full((1, self.classes), 1.0 / self.classes)
        customers = merged(np.zeros_like(self.dish), self.dish, low.tables, self.classes)
        top = Level(*customers, ROOT_STRENGTH, ROOT_DISCOUNT, 1)
        top.sweep(even[0, top.dish], seed=2 * self.turn + 1)
        self.parent, self.tables, self.turn = top.probabilities(even), low.tables, self.turn + 1
        return low.probabilities(np.broadcast_to(self.parent, (self.contexts, self.classes)))


@dataclass
class Letters:
    """Natural logarithms of letter probabilities: a row per context that was seen."""

    row_of: np.ndarray  # by the two symbols before
    logs: np.ndarray
    taken: float = 0.0  # the share of words that are classes of their own

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's probability among words of the rare class."""
        if not words:
            return np.zeros(0)
        sizes = np.array([len(w) for w in words], dtype=np.int64) + 3
        flat = np.frombuffer(b"".join(b"\0\0" + w + b"\0" for w in words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        flat[starts] = flat[starts + 1] = flat[ends - 1] = SYMBOLS - 1
        logs = np.zeros(len(flat))
        logs[2:] = self.logs[self.row_of[flat[:-2] * SYMBOLS + flat[1:-1]], flat[2:]]
        logs[starts] = logs[starts + 1] = 0.0
        return np.add.reduceat(logs, starts) - math.log(max(1e-12, 1.0 - self.taken))


def letter_events(words: list[bytes], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells ((context * SYMBOLS) + symbol) of all letters of the words, and their counts."""
    sizes = np.array([len(w) for w in words], dtype=np.int64) + 3
    flat = np.frombuffer(b"".join(b"\0\0" + w + b"\0" for w in words), dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    flat[starts] = flat[starts + 1] = flat[ends - 1] = SYMBOLS - 1
    cells = np.zeros(len(flat), dtype=np.int64)
    cells[2:] = (flat[:-2] * SYMBOLS + flat[1:-1]) * SYMBOLS + flat[2:]
    inside = np.ones(len(flat), dtype=bool)
    inside[starts] = inside[starts + 1] = False
    keys, place = np.unique(cells[inside], return_inverse=True)
    return keys, np.bincount(place, np.repeat(times, sizes - 2)).astype(np.int64)


def letter_model(cells: np.ndarray, counts: np.ndarray, classes: list[bytes], seed: int) -> Letters:
    """The letter restaurants, seated from the word restaurant's tables."""
    pair, symbol = cells // SYMBOLS, cells % SYMBOLS
    pairs = np.unique(pair)
    two = Level(np.searchsorted(pairs, pair), symbol, counts, LETTER_STRENGTH, LETTER_DISCOUNT, len(pairs))
    even = np.full((1, SYMBOLS), 1.0 / SYMBOLS)
    one_rows, none_rows = np.repeat(even, SYMBOLS, 0), even
    for turn in range(BURN_IN + 1):
        two.sweep(one_rows[pairs % SYMBOLS][two.restaurant, symbol], seed * 10 + 3 * turn)
        one = Level(*merged(pair % SYMBOLS, symbol, two.tables, SYMBOLS), LETTER_STRENGTH, LETTER_DISCOUNT, SYMBOLS)
        one.sweep(none_rows[0, one.dish], seed * 10 + 3 * turn + 1)
        none = Level(
            *merged(np.zeros_like(one.dish), one.dish, one.tables, SYMBOLS), LETTER_STRENGTH, LETTER_DISCOUNT, 1
        )
        none.sweep(even[0, none.dish], seed * 10 + 3 * turn + 2)
        none_rows = none.probabilities(even)
        one_rows = one.probabilities(np.broadcast_to(none_rows, (SYMBOLS, SYMBOLS)))
    rows = np.concatenate([one_rows, two.probabilities(one_rows[pairs % SYMBOLS])])
    row_of = np.arange(SYMBOLS * SYMBOLS, dtype=np.int32) % SYMBOLS
    row_of[pairs] = SYMBOLS + np.arange(len(pairs), dtype=np.int32)
    letters = Letters(row_of, np.log(rows).astype(np.float32))
    letters.taken = float(np.exp(letters.spelled([b"", *classes])).sum())
    return letters


@dataclass
class WordSample:
    """One sweep over the rare words: the parent it had, and what it left behind."""

    letters: Letters | None  # none in the first turn, in which every word has one table
    tables_before: int
    seed: int
    customers: int = 0
    tables: int = 0
    spelled: float = 0.0  # the letter model's share of the words that were seen


@dataclass
class Words:
    """The rare class's restaurant: a sample of each sweep, of which the last ``SAMPLES`` count."""

    discount: float
    samples: list[WordSample]

    def tables(self, sample: WordSample, words: list[bytes], counts: np.ndarray, base: np.ndarray) -> np.ndarray:
        opening = (WORD_STRENGTH + self.discount * sample.tables_before) * base
        return seated(counts, opening, self.discount, _hashes(words), sample.seed)

    def probabilities(self, sample: WordSample, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Of each known word within the rare class, after a sweep with so many customers of the words."""
        base = np.exp(sample.letters.spelled(words))
        own = counts - self.discount * self.tables(sample, words, counts, base)
        return (own + (WORD_STRENGTH + self.discount * sample.tables) * base) / (WORD_STRENGTH + sample.customers)

    def log_unknown(self) -> float:
        """log10 of the averaged probability that a rare word is none of the known ones."""
        new = [
            (WORD_STRENGTH + self.discount * s.tables) * max(1e-9, 1.0 - s.spelled) / (WORD_STRENGTH + s.customers)
            for s in self.samples[-SAMPLES:]
        ]
        return math.log10(sum(new) / len(new))


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in words), dtype=np.uint64, count=len(words))


def held_out(id_col: str):
    """Documents that the model doesn't learn from, by the CRC of their id."""
    text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == HELD_OUT


@dataclass
class Classes:
    """Common words as classes, and how tokens become contexts."""

    words: list[bytes]  # classes from 2 on

    def __post_init__(self) -> None:
        self.of = {w: i + 2 for i, w in enumerate(self.words)}
        self.classes = len(self.words) + 2
        self.contexts = self.classes + SUFFIXES

    def context(self, word: bytes) -> int:
        found = self.of.get(word)
        if found is not None:
            return found
        return self.classes + (word[-1] + 257 * (word[-2] if len(word) > 1 else 0)) % SUFFIXES

    def kinds(self, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and context of words by hash and ending; the last place, found at index -1, is the end's."""
        own = _hashes(self.words)
        order = np.argsort(own)
        at = np.searchsorted(own[order], hashes)
        common = np.append(own[order], 0)[at] == hashes if len(own) else np.zeros(len(hashes), dtype=bool)
        dish = np.where(common, np.append(order, 0)[at] + 2, RARE)
        context = np.where(common, dish, self.classes + endings)
        return np.append(dish, END), np.append(context, END)


def _endings(words: list[bytes]) -> np.ndarray:
    """The hash of the last two bytes of each word, as in :meth:`Classes.context`."""
    last = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    flat = np.frombuffer(b"\0" + b"\0".join(words), dtype=np.uint8).astype(np.int64)
    return (flat[last] + 257 * flat[last - 1]) % SUFFIXES if len(words) else np.zeros(0, np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of about ``PART_BYTES``: their documents, their distinct words with hash, ending and
    count in training, and the place of each token's word among them, packed (-1 for an end)."""
    for batch in batches:
        whole = pc.fill_null(batch.column("text"), "")
        for part in slices(pc.binary_length(whole).to_numpy().tolist(), PART_BYTES):
            texts = whole.slice(part.start, part.stop - part.start)
            # ASCII functions: they lower A to Z only, and split at exactly the characters of SPACE
            listed = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            owner, found = pc.list_parent_indices(listed).to_numpy(), listed.flatten()
            filled = pc.not_equal(found, "")  # around white space at the ends of a text
            owner = owner[filled.to_numpy(zero_copy_only=False)]
            coded = found.filter(filled).dictionary_encode()
            size = np.bincount(owner, minlength=len(texts)) + 1
            token = np.full(size.sum(), -1, dtype=np.int32)
            is_end = np.zeros(len(token), dtype=bool)
            is_end[np.cumsum(size) - 1] = True
            token[~is_end] = coded.indices.to_numpy()
            out = batch.column("held_out").slice(part.start, len(texts))
            learns = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), size)
            trained = np.bincount(token[learns] + 1, minlength=len(coded.dictionary) + 1)
            words = coded.dictionary.cast(pa.binary()).to_pylist()
            columns = {
                "id": batch.column("id").slice(part.start, len(texts)),
                "held_out": out,
                "size": pa.array(size, pa.int32()),
                "word": coded.dictionary.cast(pa.string()),
                "hash": pa.array(_hashes(words).view(np.int64)),
                "ending": pa.array(_endings(words), pa.int32()),
                "trained": pa.array(trained[1:], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("row").slice(part.start, 1),
                    "ends": pa.array([int(trained[0])], pa.int64()),
                    "token": pa.array([_packed(token)], pa.binary()),
                }
                | {name: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for name, c in columns.items()}
            )


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the place of each key among them."""
    bits = len(keys).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    # sorting values is faster than sorting places
    both = np.sort(keys << bits | np.arange(len(keys)))
    ordered, at = both >> bits, both & ((1 << bits) - 1)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), dtype=np.int64)
    place[at] = np.cumsum(new) - 1
    return ordered[new], place


def _cut(values: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, starts[1:]) if len(starts) else []


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpacked(values: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(values), dtype=kind)


@dataclass
class Part:
    """The tokens of a part, and its distinct pairs but for those of two classes."""

    hashes: np.ndarray  # per word, as the next two; an end is at the last place, -1
    dish_of: np.ndarray
    context_of: np.ndarray
    text: np.ndarray  # per token, as the next five
    word: np.ndarray
    dish: np.ndarray
    context: np.ndarray
    learns: np.ndarray
    kept: np.ndarray  # has a pair
    pair: np.ndarray  # per kept token the place of its pair
    before: np.ndarray  # per pair, as the next two
    after: np.ndarray
    trained: np.ndarray

    @classmethod
    def read(cls, row, classes: Classes) -> Part:
        hashes = np.asarray(row["hash"], dtype=np.int64).view(np.uint64)
        word = _unpacked(row["token"], np.int32).astype(np.int64)
        size = np.asarray(row["size"], dtype=np.int64)
        dish_of, context_of = classes.kinds(hashes, np.asarray(row["ending"], dtype=np.int64))
        before = np.concatenate(([-1], word[:-1]))  # an end is before each first token
        dish, context = dish_of[word], context_of[before]
        kept = (dish == RARE) | (context >= classes.classes)
        places = len(hashes) + 1
        keys, pair = _grouped(((before + 1) * places + word + 1)[kept])
        learns = np.repeat(~np.asarray(row["held_out"], dtype=bool), size)
        return cls(
            np.append(hashes, _hashes([b""])), dish_of, context_of,  # an end is the empty word
            np.repeat(np.arange(len(size)), size), word, dish, context, learns, kept, pair,
            keys // places - 1, keys % places - 1, np.bincount(pair, learns[kept], len(keys)).astype(np.int64),
        )

    def pair_hashes(self, at) -> np.ndarray:
        return _pair_hashes(self.hashes[self.before[at]], self.hashes[self.after[at]])


def _pair_hashes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(mixed(before, 21) + word, 22)


def _part_pairs(classes: Classes, buckets: int):
    """The distinct pairs of a part: a row for each bucket, which is a range of their hashes."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                part = Part.read(row, classes)
                pair = part.pair_hashes(slice(None))
                bucket = (pair >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                bucket = bucket.astype(np.uint16 if buckets < 2**16 else np.int64)  # short numbers sort faster
                order = np.argsort(bucket, kind="stable")
                own, starts = np.unique(bucket[order], return_index=True)
                lists = {"pair": pair.view(np.int64)[order], "place": order, "trained": part.trained[order]}
                yield pd.DataFrame(
                    {"bucket": own.astype(np.int64), "part": row["part"]}
                    | {name: pd.Series(_cut(c, starts), dtype=object) for name, c in lists.items()}
                )

    return listed


def _shared_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the pairs whose part can't know the pair's count in training, packed by part.

    A pair that is not listed was seen in training as often as its part says, once or never.
    """
    part = np.repeat(rows["part"].to_numpy(np.int64), [len(x) for x in rows["pair"]])
    pair, place, trained = (np.concatenate(rows[c].to_list()).astype(np.int64) for c in ("pair", "place", "trained"))
    order = np.argsort(pair, kind="stable")
    part, pair, place, trained = part[order], pair[order], place[order], trained[order]
    first = np.concatenate(([True], pair[1:] != pair[:-1]))
    starts = np.flatnonzero(first)
    times = np.repeat(np.add.reduceat(trained, starts), np.diff(np.append(starts, len(pair))))
    told = np.flatnonzero((times > 1) | ((times == 1) & (trained == 0)))
    told = told[np.lexsort((place[told], part[told]))]
    owner, starts = np.unique(part[told], return_index=True)
    lists = {"place": place[told], "count": times[told], "first": first[told]}
    return pd.DataFrame(
        {"part": owner}
        | {name: pd.Series([_packed(x) for x in _cut(c, starts)], dtype=object) for name, c in lists.items()}
    )


def _shared_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, counts and whether the part speaks for the pair, from all lists of a part."""
    rows = rows[rows["place"].notna()]
    kinds = {"place": np.int64, "count": np.int64, "first": bool}
    return tuple(np.concatenate([np.zeros(0, k), *(_unpacked(x, k) for x in rows[c])]) for c, k in kinds.items())


def _counted(classes: Classes):
    """Pairs seen twice or more in training, each from one part, and the part's counts of classes
    in contexts."""

    def counted(rows: pd.DataFrame) -> pd.DataFrame:
        found = Part.read(rows[rows["token"].notna()].iloc[0], classes)
        hashes = found.hashes.view(np.int64)
        place, times, first = _shared_of(rows)
        own = first & (times > 1)
        before, after = found.before[place[own]], found.after[place[own]]
        cells = found.context[found.learns] * classes.classes + found.dish[found.learns]
        cell, number = np.unique(cells, return_counts=True)
        pairs = pd.DataFrame(
            {
                "pair": True, "before": hashes[before], "word": hashes[after],
                "context": found.context_of[before], "dish": found.dish_of[after], "count": times[own],
            }
        )
        plain = pd.DataFrame(
            {
                "pair": False, "before": 0, "word": 0,
                "context": cell // classes.classes, "dish": cell % classes.classes, "count": number,
            }
        )
        return pd.concat([pairs, plain], ignore_index=True)

    return counted


@dataclass
class Model:
    """Everything a document needs but the rare words' own counts."""

    classes: Classes
    words: Words
    counts: np.ndarray  # of the classes; the rare class's place is empty
    tokens: int
    distinct: int
    pair_discount: float
    # one for each sweep, the first before pairs are seated
    class_turns: list[np.ndarray]  # log10 of the probability of each class in each context
    context_tables: list[np.ndarray]  # per class as context: the tables of its pairs
    class_logs: np.ndarray | None = None  # as the next two averaged over the samples
    context_weight: np.ndarray | None = None  # what a new table of a class as context weighs
    context_logs: np.ndarray | None = None  # what its pairs leave to other rare words

    def base(self, count):
        """log10 of the smoothed share of a token with this training count."""
        return np.log10((count + SMOOTHING) / (self.tokens + SMOOTHING * (self.distinct + 1)))


@contextmanager
def _freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the step that made them is stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    with _freed_shuffles(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _removed(*stored: DataFrame) -> None:
    """Remove tables that no later step reads."""
    for df in stored:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table of rare words: ``hash``, ``count``, ``log_p`` and ``log_rest``.

    ``log_p`` is of the word restaurant, ``log_rest`` what the word as context leaves to it.
    """
    model, rare, _ = learned(docs, id_col, text_col)
    return model, rare


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model, the rare words as in :func:`fitted`, and the table of pairs that were seen:
    ``hash`` and ``gain``, log10 of a pair's probability over that without its own customers."""
    model, parts, shared, looked = _learned(docs, id_col, text_col)
    gains = _met(parts, shared, looked, _gains(model), "hash bigint, gain double")
    weight = PAIR_STRENGTH + model.pair_discount * F.col("tables")
    log_rest = F.log10(weight / (PAIR_STRENGTH + F.col("count"))).alias("log_rest")
    return model, looked.select("hash", "count", "log_p", log_rest), gains


def _learned(docs: DataFrame, id_col: str, text_col: str) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model, the parts, the pairs whose count a part must be told, and all rare words."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        held_out(id_col).alias("held_out"),
        F.col(f"`{text_col}`").alias("text"),
    )
    parts = _stored(
        numbered.mapInArrow(
            _parts,
            f"part bigint, ends bigint, token binary, id array<{dict(numbered.dtypes)['id']}>, "
            "held_out array<boolean>, size array<int>, word array<string>, hash array<bigint>, ending array<int>, "
            "trained array<bigint>",
        ),
        "parts",
    )
    vocabulary = _stored(
        parts.select(F.inline(F.arrays_zip("word", "trained")))
        .filter(F.col("trained") > 0)
        .groupBy("word")
        .agg(F.sum("trained").alias("count")),
        "words",
    )
    in_part = F.aggregate("size", F.lit(0).cast("long"), lambda total, n: total + n)
    ends, all_tokens = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("ends", in_part))).first()
    words, tokens = vocabulary.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).first()
    tokens += ends
    is_common = F.col("count") >= max(1.0, COMMON * tokens)
    common = vocabulary.filter(is_common).orderBy("word").collect()  # at most 1 / COMMON words
    classes = Classes([row["word"].encode("utf-8", "surrogatepass") for row in common])
    counts = np.array([ends, 0] + [row["count"] for row in common], dtype=np.int64)
    texts = parts.select(*PART)
    pairs_in = "bucket int, part bigint, pair array<bigint>, place array<int>, trained array<bigint>"
    shared = _stored(
        texts.mapInPandas(_part_pairs(classes, 1 + int(all_tokens) // BUCKET_PAIRS), pairs_in)
        .groupBy("bucket")
        .applyInPandas(_shared_pairs, "part bigint, place binary, count binary, first binary"),
        "shared",
    )
    counted = _stored(
        texts.unionByName(shared, allowMissingColumns=True)
        .groupBy("part")
        .applyInPandas(
            _counted(classes), "pair boolean, before bigint, word bigint, context int, dish int, count bigint"
        ),
        "pairs",
    )
    pairs, plain = counted.filter("pair"), counted.filter("NOT pair")
    first, rare_dish, rare_context = classes.classes, F.col("dish") == RARE, F.col("context") >= classes.classes
    again = F.col("count") - 1  # customers of a pair after its first
    # at most contexts * classes cells; a rarer word's own restaurant sends one table per pair
    cells = (
        plain.select("context", "dish", "count")
        .union(pairs.filter(rare_context).select("context", "dish", -again))
        .groupBy("context", "dish")
        .agg(F.sum("count").alias("count"))
        .orderBy("context", "dish")
        .toPandas()
    )
    context, dish, count = (cells[c].to_numpy(np.int64) for c in ("context", "dish", "count"))
    seen = plain.filter(rare_dish | rare_context).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    often, twice = pairs.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") == 2)).first()
    once = seen - often
    zero = F.lit(0).cast("long")
    repeats = (
        pairs.select(F.col("word").alias("hash"), F.when(rare_dish, again).otherwise(0).alias("as_word"), zero.alias("as_context"))
        .union(pairs.select("before", zero, again))
        .groupBy("hash")
        .agg(F.sum("as_word").alias("as_word"), F.sum("as_context").alias("as_context"))
    )
    # a rare word has a pair with the word before and one with the word after, each time
    rare = _stored(
        vocabulary.filter(~is_common)
        .withColumn("hash", F.xxhash64("word"))
        .join(repeats, "hash", "left")
        .select(
            "hash", "word", "count", (F.col("count") - F.coalesce("as_word", zero)).alias("customers_0"),
            (F.col("count") - F.coalesce("as_context", zero)).alias("tables_0"),
        ),
        "rare",
    )
    _removed(vocabulary)
    sweeps = ClassSweeps(context, dish, classes.contexts, classes.classes)
    customers = np.zeros(first)  # of the classes as contexts
    at = (context < first) & (dish == RARE)
    customers[context[at]] = count[at]
    tables = customers.copy()  # one for each pair
    for row in pairs.filter(~rare_context).groupBy("context").agg(F.sum(again).alias("n")).collect():
        tables[row["context"]] -= row["n"]  # one row for each class at most
    model = Model(
        classes, Words(_discount(rare, "customers_0"), []), counts, tokens, words + (1 if ends else 0),
        min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5,
        [np.log10(sweeps.sweep(count))], [tables],
    )
    letters = _sweep_words(rare, "customers_0", model, WordSample(None, 0, 100))
    letters = _sweep_words(rare, "customers_0", model, WordSample(letters, model.words.samples.pop().tables, 101))
    last, cell = BURN_IN + SAMPLES, context * classes.classes + dish
    for turn in range(1, last + 1):
        seats = _seat_pairs(pairs, rare, model, turn, "contexts" if turn == last else f"seats{turn}")
        tables, now = tables_of(seats, CLASS_CONTEXT, np.arange(first)), count + tables_of(seats, CELL, cell)
        model.context_tables.append(model.context_tables[0] + tables)
        model.class_turns.append(np.log10(sweeps.sweep(now)))
        before, rare = rare, _with_tables(rare, seats, turn)
        letters = _sweep_words(
            rare, f"customers_{turn}", model, WordSample(letters, model.words.samples[-1].tables, 101 + turn)
        )
        _removed(before, *([seats] if turn < last else []))
    sampled = range(BURN_IN + 1, last + 1)
    model.class_logs = np.log10(sum(10.0 ** model.class_turns[t] for t in sampled) / SAMPLES)
    model.context_weight = PAIR_STRENGTH + model.pair_discount * sum(model.context_tables[t] for t in sampled) / SAMPLES
    model.context_logs = np.log10(model.context_weight / (PAIR_STRENGTH + customers))
    looked = _looked(rare, model, sampled)
    _removed(counted, rare)
    return model, parts, shared, looked


def _discount(rare: DataFrame, customers: str) -> float:
    once, twice = rare.agg(F.count_if(F.col(customers) == 1), F.count_if(F.col(customers) == 2)).first()
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


#: What tables beyond a pair's first are added up for.
WORD, CONTEXT, CLASS_CONTEXT, CELL = range(4)


def _seat_pairs(pairs: DataFrame, rare: DataFrame, model: Model, turn: int, name: str) -> DataFrame:
    """A sweep over the pairs. Returns the tables beyond one for each pair as ``kind``, ``key`` and
    ``more``: by word after, by rarer word before, by class before, by context and class after.

    Pairs seen once keep their one table, so only the others are seated.
    """
    first, earlier = model.classes.classes, f"tables_{turn - 1}"

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            context, dish = batch["context"].to_numpy(np.int64), batch["dish"].to_numpy(np.int64)
            opened = batch[earlier].to_numpy(np.float64)
            opened = np.where(context < first, model.context_tables[turn - 1][np.minimum(context, first - 1)], opened)
            before, word = (batch[c].to_numpy(np.int64) for c in ("before", "word"))
            pair = _pair_hashes(before.view(np.uint64), word.view(np.uint64))
            log_p = batch["log_p"].to_numpy(np.float32)
            tables = _seated_pairs(model, turn, pair, batch["count"].to_numpy(np.int64), context, dish, log_p, opened)
            more, known = tables - 1, context < first
            for kind, key, of in (
                (WORD, word, dish == RARE), (CONTEXT, before, ~known),
                (CLASS_CONTEXT, context, known), (CELL, context * first + dish, ~known),
            ):
                found = of & (more > 0)
                yield pd.DataFrame({"kind": kind, "key": key[found], "more": more[found]})

    priced = rare.mapInPandas(_prices(model, [turn - 1]), f"hash bigint, count bigint, log_p_{turn - 1} float")
    return _stored(
        pairs.join(priced.select(F.col("hash").alias("word"), F.col(f"log_p_{turn - 1}").alias("log_p")), "word", "left")
        .join(rare.select(F.col("hash").alias("before"), earlier), "before", "left")
        .select("before", "word", "context", "dish", "count", "log_p", earlier)
        .mapInPandas(seat, "kind int, key bigint, more bigint")
        .groupBy("kind", "key")
        .agg(F.sum("more").alias("more")),
        name,
    )


def tables_of(seats: DataFrame, kind: int, keys: np.ndarray) -> np.ndarray:
    """The tables beyond the first ones of each of ``keys``, which are in order and of classes only."""
    found = seats.filter(F.col("kind") == kind).select("key", "more").toPandas()
    out = np.zeros(len(keys), dtype=np.int64)
    out[np.searchsorted(keys, found["key"].to_numpy(np.int64))] = found["more"].to_numpy(np.int64)
    return out


def _with_tables(rare: DataFrame, seats: DataFrame, turn: int) -> DataFrame:
    """The rare words with their customers, and their tables as contexts, after a sweep over the pairs."""
    more = (
        seats.filter(F.col("kind") <= CONTEXT)
        .groupBy(F.col("key").alias("hash"))
        .agg(*(F.sum(F.when(F.col("kind") == k, F.col("more")).otherwise(0)).alias(f"more_{k}") for k in (WORD, CONTEXT)))
    )
    zero = F.lit(0).cast("long")
    return _stored(
        rare.join(more, "hash", "left").select(
            *rare.columns,
            (F.col("customers_0") + F.coalesce(f"more_{WORD}", zero)).alias(f"customers_{turn}"),
            (F.col("tables_0") + F.coalesce(f"more_{CONTEXT}", zero)).alias(f"tables_{turn}"),
        ),
        f"rare{turn}",
    )


def _prices(model: Model, turns: list[int], averaged: bool = False):
    """log10 of the words' probabilities after sweeps, and that of the average over the samples."""

    def prices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [w.encode("utf-8", "surrogatepass") for w in batch["word"]]
            wanted = {*turns, *(range(BURN_IN + 1, BURN_IN + SAMPLES + 1) if averaged else ())}
            found = {
                t: model.words.probabilities(model.words.samples[t], words, batch[f"customers_{t}"].to_numpy(np.int64))
                for t in sorted(wanted)
            }
            out = {"hash": batch["hash"], "count": batch["count"]}
            out |= {f"log_p_{t}": np.log10(found[t]).astype(np.float32) for t in turns}
            if averaged:
                sampled = [t for t in found if t > BURN_IN]
                out["tables"] = sum(batch[f"tables_{t}"].to_numpy(np.float64) for t in sampled) / SAMPLES
                out |= {f"tables_{t}": batch[f"tables_{t}"] for t in turns}
                out["log_p"] = np.log10(sum(found[t] for t in sampled) / SAMPLES)
            yield pd.DataFrame(out)

    return prices


def _looked(rare: DataFrame, model: Model, sampled: range) -> DataFrame:
    """The rare words: the average over the samples, and what each sampled sweep over the pairs had."""
    turns = [t - 1 for t in sampled]
    schema = ["hash bigint", "count bigint", *(f"log_p_{t} float" for t in turns), "tables double"]
    schema += [*(f"tables_{t} bigint" for t in turns), "log_p double"]
    return _stored(rare.mapInPandas(_prices(model, turns, averaged=True), ", ".join(schema)), "looked")


def _seated_pairs(
    model: Model, turn: int, pair: np.ndarray, count: np.ndarray, context: np.ndarray, dish: np.ndarray,
    log_p: np.ndarray, tables: np.ndarray,
) -> np.ndarray:
    """Tables of pairs, given the sweep before: its log10 of words' probabilities and its tables of contexts."""
    base = _parent(model.class_turns[turn - 1], model, context, dish, log_p.astype(np.float64))
    discount = model.pair_discount
    return seated(count, (PAIR_STRENGTH + discount * tables) * base, discount, pair, 90 + turn)


def _parent(class_logs: np.ndarray, model: Model, context: np.ndarray, dish: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    # the class after a class is known there; its pairs are told apart within the rare words
    inside = np.where(context >= model.classes.classes, class_logs[context, dish], 0.0)
    return 10.0 ** (np.where(dish == RARE, np.nan_to_num(log_p), 0.0) + inside)


def _sweep_words(rare: DataFrame, customers: str, model: Model, sample: WordSample) -> Letters:
    """A sweep over the rare words, a job that returns the letters of the tables."""
    found = model.words

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [w.encode("utf-8", "surrogatepass") for w in batch["word"]]
            if not words:
                continue
            count = batch[customers].to_numpy(np.int64)
            if sample.letters is None:
                t, base = np.minimum(count, 1), np.zeros(len(words))
            else:
                base = np.exp(sample.letters.spelled(words))
                t = found.tables(sample, words, count, base)
            cell, times = letter_events(words, t)
            yield pd.DataFrame(
                {
                    "cell": np.append(cell, [-1, -2]),
                    "count": np.append(times, [t.sum(), count.sum()]),
                    "spelled": np.append(np.zeros(len(cell) + 1), base.sum()),
                }
            )

    events = (
        rare.select("word", customers)
        .mapInPandas(seat, "cell bigint, count bigint, spelled double")
        .groupBy("cell")
        .agg(F.sum("count").alias("count"), F.sum("spelled").alias("spelled"))
        .orderBy("cell")
        .toPandas()  # at most SYMBOLS ** 3 cells
    )
    cell, times = events["cell"].to_numpy(np.int64), events["count"].to_numpy(np.int64)
    sample.tables, sample.customers = int(times[cell == -1].sum()), int(times[cell == -2].sum())
    sample.spelled = float(events["spelled"].sum())
    found.samples.append(sample)
    return letter_model(cell[cell >= 0], times[cell >= 0], model.classes.words, sample.seed - 100)


def _met(parts: DataFrame, shared: DataFrame, looked: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of each part with what it must be told of its pairs and words."""
    told = _stored(
        parts.select(F.col("part").alias("of"), F.posexplode("hash").alias("place", "hash"))
        .join(looked, "hash")
        .drop("hash"),
        "told",
    )
    texts = parts.select(*PART).unionByName(shared, allowMissingColumns=True)
    return texts.groupBy("part").cogroup(told.groupBy("of")).applyInPandas(function, schema)


@dataclass
class Told:
    """What a part is told of its words, ends at the last place, and the gains of its pairs."""

    count: np.ndarray
    log_p: np.ndarray
    log_rest: np.ndarray
    gain: np.ndarray
    own: np.ndarray  # pairs that this part, among those with the pair, speaks for

    @classmethod
    def read(cls, model: Model, part: Part, rows: pd.DataFrame, words: pd.DataFrame) -> Told:
        place = words["place"].to_numpy(np.int64)
        at, shared_times, first = _shared_of(rows)

        def per_word(name: str, other: float) -> np.ndarray:
            out = np.full(len(part.hashes), other)
            out[place] = words[name].to_numpy(np.float64)
            return out

        customers, log_p = per_word("count", 0), per_word("log_p", np.nan)
        common = np.flatnonzero(part.context_of < model.classes.classes)
        weight = PAIR_STRENGTH + model.pair_discount * per_word("tables", 0.0)
        rest = np.log10(weight / (PAIR_STRENGTH + customers))  # 0 for words that were never seen
        weight[common] = model.context_weight[part.context_of[common]]
        times, own = part.trained.copy(), part.trained == 1
        times[at] = shared_times
        own[at] = first & (shared_times > 1)
        gain = np.zeros(len(times))
        seen = np.flatnonzero(times)
        before, after, n = part.before[seen], part.after[seen], times[seen]
        context, dish = part.context_of[before], part.dish_of[after]
        tables = np.ones(len(seen))  # on average over the samples
        more = np.flatnonzero(n > 1)
        pair = part.pair_hashes(seen[more])
        for turn in range(BURN_IN, BURN_IN + SAMPLES):
            opened = per_word(f"tables_{turn}", 0.0)
            opened[common] = model.context_tables[turn][part.context_of[common]]
            earlier = per_word(f"log_p_{turn}", np.nan).astype(np.float32)
            found = _seated_pairs(
                model, turn + 1, pair, n[more], context[more], dish[more], earlier[after[more]], opened[before[more]]
            )
            tables[more] += (found - 1) / SAMPLES
        base = _parent(model.class_logs, model, context, dish, log_p[after])
        gain[seen] = np.log10(1.0 + (n - model.pair_discount * tables) / (weight[before] * base))
        return cls(customers, log_p, rest, gain, own)


def _gains(model: Model):
    def gains(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        part = Part.read(rows[rows["token"].notna()].iloc[0], model.classes)
        told = Told.read(model, part, rows, words)
        return pd.DataFrame({"hash": part.pair_hashes(told.own).view(np.int64), "gain": told.gain[told.own]})

    return gains


def _scored(model: Model):
    """Sums over the tokens of each text, as lists for each part."""
    class_base, unknown = model.base(model.counts), model.words.log_unknown()
    classes = model.classes
    rest = np.concatenate((model.context_logs, np.zeros(SUFFIXES)))

    def scored(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        row = rows[rows["token"].notna()].iloc[0]
        part = Part.read(row, classes)
        told = Told.read(model, part, rows, words)
        n, rare = len(row["size"]), part.dish == RARE
        known = np.where(rare, told.count[part.word], model.counts[part.dish]) > 0
        base = np.where(rare, model.base(told.count)[part.word], class_base[part.dish])
        own = np.where(np.isnan(told.log_p), unknown, told.log_p) + told.log_rest
        logs = model.class_logs[part.context, part.dish] + np.where(rare, rest[part.context] + own[part.word], 0.0)
        logs[part.kept] += told.gain[part.pair]
        sums = {
            "n_tokens": np.bincount(part.text, minlength=n),
            "n_known": np.bincount(part.text, known, n).astype(np.int64),
            "base_score": np.bincount(part.text, base, n),
            "score": np.bincount(part.text, logs, n),
        }
        return pd.DataFrame([{"part": row["part"]} | sums])

    return scored


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` of every document; perplexity is ``10 ** (-score / n_tokens)``."""
    model, parts, shared, looked = _learned(docs, id_col, text_col)
    sums = ["n_tokens", "n_known", "base_score", "score"]
    found = _met(
        parts, shared, looked, _scored(model),
        "part bigint, n_tokens array<bigint>, n_known array<bigint>, base_score array<double>, score array<double>",
    )
    return (
        parts.select("part", "id", "held_out")
        .join(found, "part")
        .select(F.inline(F.arrays_zip("id", "held_out", *sums)))
        .select(
            "id", "held_out", "n_tokens", "n_known",
            F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        )
    )


def score_digest(docs: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return scores(docs).withColumnRenamed("id", "doc_id")

"""SentencePiece encoding by a batched Viterbi search, and decoding.

A text gets one space in front and is cut into words, where no piece can cross: at
the start of each run of spaces, and around line ends. Of all ways to write a word
as pieces the one with the highest sum of scores is taken (of equal ones the one
with the longer last piece). The distinct words of a part of the batch are searched
together: hashes of all their substrings probe the sorted keys of the pieces, then
words of equal length advance one character at a time, and the maxima over the
lengths of the last piece are the backpointers. Characters that no piece covers are
written as their UTF-8 bytes.

The model's scores decide. For a unigram model that is the library's own encoding;
for a model trained by merges the library replays the merges and may choose other
pieces. Decoding joins the pieces' bytes and drops the space in front; it gives back
every text exactly, also one that contains the model's space symbol.

Null and empty texts have no pieces. The pieces of the model (a few tens of
thousands) travel with the function; the model file is read by the driver only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from stepguard.llm.common import mixed, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# How the model writes a space, and how much an unknown character costs below the lowest score.
SPACE_SYMBOL = "▁"
UNKNOWN = 10.0
DISABLED = -1e8  # pieces scored below are as good as never used, and don't set the lowest score
WORD = re.compile(r" *[^ \n]+| +|\n+")
BASE = np.uint64(0x100000001B3)
MARKS = np.uint64(2**20 - 1)
PART_CHARS = 1_000_000
#: Characters of distinct words that are searched at a time.
SEARCH_CHARS = 100_000
#: Words whose pieces a task keeps. Only the work depends on it, not the result.
MOST_WORDS = 300_000


class Pieces:
    """Pieces, scores and byte tokens of a model, ready for search."""

    def __init__(self, texts: list[str], scores: list[float], kinds: list[str]) -> None:
        self.blobs = [b""] * len(texts)
        self.byte_ids = [0] * 256
        keys, ids = [], []
        for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
            if kind == "byte":
                value = int(text[3:5], 16)
                self.byte_ids[value] = i
                self.blobs[i] = bytes([value])
            elif kind == "normal":
                plain = text.replace(SPACE_SYMBOL, " ")
                if " " in plain.lstrip(" ") or "\n" in plain:
                    raise ValueError(f"piece {text!r} crosses the end of a word")
                self.blobs[i] = plain.encode()
                keys.append(plain)
                ids.append(i)
        self.longest = max(map(len, keys), default=1)
        hashes = np.array([_hashed(k) for k in keys], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(ids, dtype=np.int32)[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.scores = np.array([scores[i] for i in ids], dtype=np.float64)[order]
        # most substrings are no piece, and are told by the last bits of their hash
        self.marked = np.zeros(int(MARKS) + 1, dtype=bool)
        self.marked[(self.keys & MARKS).astype(np.int64)] = True
        usable = self.scores[self.scores > DISABLED]
        self.unknown = float(usable.min() if len(usable) else 0.0) - UNKNOWN
        self.bytes = np.frombuffer(b"".join(self.blobs), dtype=np.uint8)
        self.sizes = np.array([len(b) for b in self.blobs], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a hash is a piece's, and the scores and ids of these pieces."""
        likely = np.flatnonzero(self.marked[(hashes & MARKS).astype(np.int64)])
        asked = hashes[likely]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = self.keys[at] == asked
        return likely[hit], self.scores[at[hit]], self.ids[at[hit]]


def _hashed(text: str) -> np.uint64:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    value = 0
    for code in codes.tolist():
        value = (value * int(BASE) + code + 1) % 2**64
    return mixed(np.array([value], dtype=np.uint64), len(codes))[0]


@lru_cache(maxsize=4)
def model_parts(path: str) -> tuple[tuple, tuple, tuple]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = tuple(
        "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        else "normal" for i in ids
    )
    return tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), kinds


@lru_cache(maxsize=4)
def _built(parts: tuple[tuple, tuple, tuple]) -> Pieces:
    return Pieces(*parts)


@lru_cache(maxsize=4)
def _encoder(parts: tuple[tuple, tuple, tuple]) -> Encoder:
    return Encoder(_built(parts))


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of consecutive ranges, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def _search(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all words in one array, and how many each word has."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.arange(len(codes)) - np.repeat(starts, lengths)  # place within the word
    longest = min(pieces.longest, int(lengths.max()))
    scores = np.full((longest + 1, len(codes)), -np.inf)
    ids = np.full((longest + 1, len(codes)), -1, dtype=np.int32)
    single = codes.astype(np.uint64) + np.uint64(1)
    hashes, ends = single, np.arange(len(codes))
    for size in range(1, longest + 1):  # substrings of this size by their last place
        if size > 1:
            fit = inside[ends] >= size - 1
            ends = ends[fit]
            # the substring without its last character ended one place before
            before = np.zeros(len(codes), dtype=np.uint64)
            before[last_ends] = hashes
            hashes = before[ends - 1] * BASE + single[ends]
        last_ends = ends
        hit, score, piece = pieces.probe(mixed(hashes, size))
        scores[size, ends[hit]], ids[size, ends[hit]] = score, piece
    lost = ids[1] < 0
    scores[1, lost] = pieces.unknown
    found_word, found_end, found_id = [], [], []
    for length in np.unique(lengths):
        group = np.flatnonzero(lengths == length)
        first = starts[group]
        best = np.full((length + 1, len(group)), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, len(group)), dtype=np.int16)
        for end in range(1, length + 1):
            most = min(end, longest)
            reached = np.stack(
                [best[end - size] + scores[size, first + end - 1] for size in range(most, 0, -1)]
            )
            choice = reached.argmax(axis=0)
            best[end] = reached[choice, np.arange(len(group))]
            back[end] = most - choice
        place = np.full(len(group), length)
        alive = np.arange(len(group))
        while len(alive):
            end = place[alive]
            size = back[end, alive]
            found_word.append(group[alive])
            found_end.append(end)
            found_id.append(ids[size, first[alive] + end - 1])
            place[alive] = end - size
            alive = alive[place[alive] > 0]
    word, end, chosen = np.concatenate(found_word), np.concatenate(found_end), np.concatenate(found_id)
    order = np.lexsort((end, word))
    word, end, chosen = word[order], end[order], chosen[order]
    unknown = np.flatnonzero(chosen < 0)
    if len(unknown):
        characters = [chr(c) for c in codes[starts[word[unknown]] + end[unknown] - 1]]
        written = [[pieces.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] for c in characters]
        counts = np.ones(len(chosen), dtype=np.int64)
        counts[unknown] = [len(w) for w in written]
        target = np.repeat(chosen, counts)
        target[target < 0] = np.concatenate([np.array(w, dtype=np.int32) for w in written])
        word, chosen = np.repeat(word, counts), target
    return chosen.astype(np.int32), np.bincount(word, minlength=len(words))


class _Places(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class Encoder:
    """Encodes texts, and keeps the pieces of up to ``MOST_WORDS`` words for the next ones."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.places = _Places()
        self.ids = np.zeros(0, dtype=np.int32)
        self.starts, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Search new words, which follow the known ones in ``places``."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        found, counts = [self.ids], np.zeros(len(words), dtype=np.int64)
        upto = np.cumsum(lengths[order]) // SEARCH_CHARS
        for part in np.split(order, np.flatnonzero(np.diff(upto)) + 1):
            ids, counts[part] = _search([words[k] for k in part.tolist()], self.pieces)
            found.append(ids)
        starts = np.empty(len(words), dtype=np.int64)
        in_order = counts[order]
        starts[order] = len(self.ids) + np.cumsum(in_order) - in_order
        self.ids = np.concatenate(found)
        self.starts = np.concatenate([self.starts, starts])
        self.counts = np.concatenate([self.counts, counts])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end."""
        if len(self.places) > MOST_WORDS:
            self.forget()
        known, place = len(self.places), self.places.__getitem__
        words_of = [
            np.fromiter(map(place, WORD.findall(" " + text)) if text else (), dtype=np.int64) for text in texts
        ]
        if len(self.places) > known:
            self.learn(list(islice(self.places, known, None)))
        every = np.concatenate(words_of) if words_of else np.zeros(0, dtype=np.int64)
        counts = self.counts[every]
        tokens = self.ids[_spans(self.starts[every], counts)]
        upto = np.concatenate(([0], np.cumsum(counts)))
        return tokens, upto[np.cumsum([len(w) for w in words_of], dtype=np.int64)]


def decode(ids: np.ndarray, ends: np.ndarray, pieces: Pieces) -> list[str]:
    """The texts that runs of ids spell, each up to one of the ends."""
    ids = ids.astype(np.int64)
    data = pieces.bytes[_spans(pieces.starts[ids], pieces.sizes[ids])].tobytes()
    upto = np.concatenate(([0], np.cumsum(pieces.sizes[ids])))[ends].tolist()
    texts = [data[s:e].decode("utf-8", "replace") for s, e in zip([0, *upto[:-1]], upto, strict=True)]
    return [text[1:] if text.startswith(" ") else text for text in texts]


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text that pieces with these ids spell; null ids spell nothing."""
    parts = model_parts(model)

    @F.pandas_udf("string")
    def texts(batch: pd.Series) -> pd.Series:
        rows = [np.zeros(0, dtype=np.int64) if row is None else np.asarray(row) for row in batch]
        ends = np.cumsum([len(row) for row in rows], dtype=np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        return pd.Series(decode(flat, ends, _built(parts)), dtype=object)

    return texts(ids)


NEW = StructType(
    [
        StructField("token_ids", ArrayType(IntegerType())),
        StructField("n_tokens", LongType()),
        StructField("round_trip", BooleanType()),
    ]
)


def with_pieces(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The documents with ``token_ids``, ``n_tokens`` and ``round_trip``: whether the ids decode to the text.

    Columns of the input with one of these names give way. Rows stay in Arrow; a part
    of bounded size is encoded at a time.
    """
    parts = model_parts(model)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW.names])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(parts)
        for batch in batches:
            texts = batch.column(text_col)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for part in slices(sizes, PART_CHARS):
                rows = batch.slice(part.start, part.stop - part.start)
                some = [t or "" for t in rows.column(text_col).to_pylist()]
                ids, ends = encoder.encode(some)
                same = [a == b for a, b in zip(decode(ids, ends, encoder.pieces), some, strict=True)]
                starts = np.concatenate(([0], ends))
                added = [
                    pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
                    pa.array(np.diff(starts)),
                    pa.array(same, type=pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *added], names=[*rows.schema.names, *NEW.names]
                )

    return kept.mapInArrow(add, StructType([*kept.schema.fields, *NEW.fields]))

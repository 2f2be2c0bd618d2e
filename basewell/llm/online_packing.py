"""Operator 13: token ids packed into sequences by bounded-space online best fit.

Each text is tokenised and closed with the end token. A partition keeps at most `windows` open sequences. A document
longer than a sequence gives full sequences and a rest. What remains goes whole into the open sequence with the
least room that still holds it; where none does, a new one is opened, or, if all may be open already, the fullest one is
emitted: as it is if at most `slack` tokens are missing, else filled with the head of the arriving piece, whose rest is placed
again. Sequences that a partition leaves open are merged at last: those of `shards_per_group` partitions are packed
again, longest piece first, and what then stays open is strung together and cut into full sequences and one of each power of two
that makes up the rest, as sequences of such a length need no padding.

So no sequence is short of more than `slack` tokens, a task holds `windows` sequences (in the merge: `windows` times
`shards_per_group`), and only open sequences are shuffled. The same input partitions give the same rows again.

A row is a sequence: sequence_id, n_used, input_ids (its ids without padding, little-endian, four bytes each), and per piece doc_ids, starts
(the document's ids before the piece), lengths, doc_tokens (ids of the whole document, with the end token). `pieces` gives a row per piece.

Defined results: a null or empty text is one piece that holds the end token; repeated rows, with or without an id, are packed each; a null
doc_id stays null; extra columns are ignored, whatever their names; an empty table gives an empty table; very long texts are packed
whole, their ids held at once; pieces of equal length keep their order. Special tokens' strings are special tokens, as in the tokenizer's default.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOWS = 64
SLACK = 8
SHARDS_PER_GROUP = 8
#: Words whose ids a worker remembers.
WORDS = 600_000
#: Marks that are a piece of their own after letters, whatever the letters.
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


class _Numbers(dict):
    """Words by number; a new word gets the next one and is listed."""

    def __init__(self, *given):
        super().__init__(*given)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """A tokenizer of the tokenizers library, and the ids of the words that it has met.

    Where the tokenizer lower-cases, drops white space and never joins what that parts, a text is the row of its words, and each different word
    is tokenised once. New words of Latin letters, one piece each, are tokenised together and told apart by the ids that end a piece; marks after letters
    are a piece of their own; other words are tokenised alone. When there are too many, the half of them that was used least is forgotten. Other tokenizers take whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        whole, parts = self._encode(["Ab  c'x...\t\u00c4D"]), self._encode(["ab", "c'x", "...", "\u00e4d"])
        self.by_word = whole[0] == [x for ids in parts for x in ids]
        self.known = _Numbers()
        self.flat, self.edges, self.used = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known words by their numbers, one word after the other, and where each ends."""
        starts, sizes = self.edges[at], self.edges[at + 1] - self.edges[at]
        stops = np.cumsum(sizes)
        return self.flat[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)], stops

    def _forget(self) -> None:
        """Keeps the half of the words that was used most."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: WORDS // 2])
        names = list(self.known)
        self.known = _Numbers((names[k], i) for i, k in enumerate(kept.tolist()))
        self.flat, stops = self._gathered(kept)
        self.edges, self.used = np.concatenate([[0], stops]), self.used[kept] // 2

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of some words."""
        ids = self._encode([w.decode("utf-8", "surrogatepass") for w in words])
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def _letters(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same of words of letters, in portions."""
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self._encode([b" ".join(part).decode()])[0], np.int64)
            stops = 1 + np.flatnonzero(self.ends[ids])
            yield (ids, np.diff(stops, prepend=0)) if len(stops) == len(part) and stops[-1] == len(ids) else self._each(part)

    def _learn(self) -> None:
        """Finds the ids of the listed words; stems and marks of some of them are listed on the way."""
        words, first = self.known.new, len(self.edges) - 1
        letters, odd, marked = [], [], []
        for i, w in enumerate(words, first):
            if w.isalpha():
                letters.append(i)
                continue
            stem = w.rstrip(_MARKS)
            if stem.isalpha():
                marked.append((i, self.known[stem], self.known[w[len(stem) :]]))
                continue
            low = w.decode("utf-8", "surrogatepass").lower()
            (letters if low.isalpha() and max(low) < "\u0250" else odd).append(i)
        found = [*self._letters([words[i - first] for i in letters]), self._each([words[i - first] for i in odd])]
        ids, sizes = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        at = np.array([*letters, *odd], np.int64) - first
        # what is known so far, in the order in which it was found, then all new words in the order of their numbers
        where, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        where[at], size[at] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        starts, known = np.concatenate([self.edges[:-1], where]), np.concatenate([np.diff(self.edges), size])
        parts = np.zeros((len(words), 2), np.int64)
        parts[:, 0] = np.arange(first, first + len(words))
        parts[:, 1] = -1
        for i, stem, mark in marked:
            parts[i - first] = stem, mark
        parts = parts.reshape(-1)
        begin, n = np.where(parts < 0, 0, starts[parts]), np.where(parts < 0, 0, known[parts])
        stops = np.cumsum(n)
        self.flat = np.concatenate([self.flat, flat[np.repeat(begin - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]])
        self.edges = np.concatenate([self.edges, self.edges[-1] + stops[1::2]])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.known.new = []

    def _rows(self, split: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of some texts' words."""
        if len(self.known) > WORDS:
            self._forget()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        self._learn()
        np.add.at(self.used, at, 1)
        ids, stops = self._gathered(at)
        edges = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
        return [ids[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        """Every text's ids."""
        if not self.by_word:
            return [np.array(ids, np.uint32) for ids in self._encode([t or "" for t in texts])]
        short = iter(self._rows([common.words(t, common.SPACED) for t in texts if len(t or "") <= common.CHUNK_BYTES]))
        return [next(short) if len(t or "") <= common.CHUNK_BYTES else np.concatenate([self._rows([words])[0] for words in _portions(t)]) for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a tokenizer file: a path, or a name in the installed public_tokenizers module. One per process."""
    if vocabulary not in _encoders:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        _encoders[vocabulary] = Encoder(path)
    return _encoders[vocabulary]


def _portions(text: str) -> Iterator[list[bytes]]:
    """A long text's words, in portions of about CHUNK_BYTES."""
    raw, at = text.encode("utf-8", "surrogatepass").translate(common.SPACED), 0
    while at < len(raw):
        stop = raw.find(b" ", at + common.CHUNK_BYTES) + 1 or len(raw)
        yield [w for w in raw[at:stop].split(b" ") if w]
        at = stop


class Windows:
    """Open sequences of one task. A piece is (owner, start, ids, tokens of its document)."""

    def __init__(self, length: int, most: int, slack: int):
        self.length, self.most, self.slack = length, most, slack
        self.rooms: list[tuple[int, int]] = []  # (room, number), least room first
        self.held: dict[int, list[tuple]] = {}
        self.opened = 0

    def place(self, piece: tuple) -> Iterator[list[tuple]]:
        """Places a piece of at most `length` ids; gives the sequences that are emitted for it."""
        owner, start, ids, total = piece
        while len(ids):
            at = bisect.bisect_left(self.rooms, (len(ids), -1))
            if at < len(self.rooms):
                room, number = self.rooms.pop(at)
                self.held[number].append((owner, start, ids, total))
                if room == len(ids):
                    yield self.held.pop(number)
                else:
                    bisect.insort(self.rooms, (room - len(ids), number))
                return
            if len(self.rooms) < self.most:
                self.held[self.opened] = []
                self.rooms.append((self.length, self.opened))  # no open one has so much room
                self.opened += 1
                continue
            room, number = self.rooms.pop(0)
            if room > self.slack:
                self.held[number].append((owner, start, ids[:room], total))
                start, ids = start + room, ids[room:]
            yield self.held.pop(number)

    def left(self) -> list[list[tuple]]:
        """The open sequences, in the order in which they were opened."""
        return [self.held[k] for k in sorted(self.held)]


def strung(pieces: list[tuple], length: int) -> Iterator[list[tuple]]:
    """Pieces in a row, cut into full sequences and, of the rest, one sequence of each power of two in it."""
    rest = sum(len(p[2]) for p in pieces)
    sizes = [length] * (rest // length) + [1 << b for b in range(length.bit_length(), -1, -1) if rest % length >> b & 1]
    todo = iter(sizes)
    room, row = next(todo, 0), []
    for owner, start, ids, total in pieces:
        while len(ids):
            row.append((owner, start, ids[:room], total))
            start, ids, room = start + len(row[-1][2]), ids[room:], room - len(row[-1][2])
            if not room:
                yield row
                room, row = next(todo, 0), []


def _table(rows: list[tuple[int, list[tuple]]], id_type, left: bool | None) -> pa.RecordBatch:
    cells = lambda k, kind: pa.array([[p[k] for p in row] for _, row in rows], pa.list_(kind))
    columns = {
        "sequence_id": pa.array([i for i, _ in rows], pa.int64()),
        "n_used": pa.array([sum(len(p[2]) for p in row) for _, row in rows], pa.int32()),
        "input_ids": pa.array([b"".join(p[2].astype("<u4").tobytes() for p in row) for _, row in rows], pa.binary()),
        "doc_ids": cells(0, id_type),
        "starts": cells(1, pa.int64()),
        "lengths": pa.array([[len(p[2]) for p in row] for _, row in rows], pa.list_(pa.int64())),
        "doc_tokens": cells(3, pa.int64()),
    }
    if left is not None:
        columns["open"] = pa.array([left] * len(rows), pa.bool_())
    return pa.RecordBatch.from_pydict(columns)


def _schema(id_kind: str) -> str:
    return f"sequence_id long, n_used int, input_ids binary, doc_ids array<{id_kind}>, starts array<long>, lengths array<long>, doc_tokens array<long>"


def pack(
    docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID, windows: int = WINDOWS, slack: int = SLACK, shards_per_group: int = SHARDS_PER_GROUP, rows_per_batch: int = 256
) -> DataFrame:
    """All documents (doc_id, text) as sequences. Written once in the shared folder, as the merge reads what the partitions leave open."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_kind = slim.schema["doc_id"].dataType.simpleString()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base, made = encoder(vocabulary), TaskContext.get().partitionId() << 32, 0
        space, ready, id_type = Windows(length, windows, slack), [], pa.null()
        for batch in common.slices(batches):
            id_type = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encoded(batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                total = len(ids)
                for at in range(0, total, length):
                    piece = (doc, at, ids[at : at + length], total)
                    for row in [[piece]] if len(piece[2]) == length else space.place(piece):
                        ready.append((base + made, row))
                        made += 1
                    if len(ready) >= rows_per_batch:
                        yield _table(ready, id_type, False)
                        ready = []
        if ready:
            yield _table(ready, id_type, False)
        if last := space.left():
            yield _table([(base + made + i, row) for i, row in enumerate(last)], id_type, True)

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, space, ready, pieces, id_type = (1 << 62) + (int(key[0].as_py()) << 32), 0, Windows(length, windows, slack), [], [], pa.null()
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                ids, at = np.frombuffer(row["input_ids"], "<u4"), 0
                for k, (doc, start, n, total) in enumerate(zip(row["doc_ids"], row["starts"], row["lengths"], row["doc_tokens"], strict=True)):
                    pieces.append(((-n, row["sequence_id"], k), (doc, start, ids[at : at + n], total)))
                    at += n
        for _, piece in sorted(pieces, key=lambda p: p[0]):
            for row in space.place(piece):
                ready.append((base + made, row))
                made += 1
        still = space.left()
        closed = [row for row in still if length - sum(len(p[2]) for p in row) <= slack]
        loose = [p for row in still if length - sum(len(p[2]) for p in row) > slack for p in row]
        for row in chain(closed, strung(loose, length)):
            ready.append((base + made, row))
            made += 1
        for at in range(0, len(ready), rows_per_batch):
            yield _table(ready[at : at + rows_per_batch], id_type, None)

    parts = common.cut(slim.mapInArrow(first, f"{_schema(id_kind)}, open boolean"), "open")
    group = F.shiftright("sequence_id", 32).cast("long") / shards_per_group
    rest = parts.filter("open").drop("open").groupBy(F.floor(group).cast("long").alias("shards")).applyInArrow(merged, _schema(id_kind))
    return parts.filter("not open").drop("open").unionByName(rest)


def pieces(sequences: DataFrame) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    before = F.expr("transform(lengths, (n, i) -> aggregate(slice(lengths, 1, i), 0L, (a, b) -> a + b))")
    each = sequences.withColumn("offsets", before).select("sequence_id", "input_ids", F.explode(F.arrays_zip("doc_ids", "starts", "lengths", "doc_tokens", "offsets")).alias("p"))
    ids = F.expr("substring(input_ids, cast(4 * p.offsets + 1 as int), cast(4 * p.lengths as int))")
    return each.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.crc32(ids).alias("ids_crc32"), "p.doc_tokens", "sequence_id", F.col("p.offsets").alias("offset"))

"""Operator 1: token ids packed into fixed-length rows by best-fit decreasing.

Each text is tokenised and closed with the end token. A document longer than a row is split
losslessly into full rows and a rest. Pieces are gathered into groups of `group_tokens` tokens within a
partition and each group is packed on its own: longest piece first, into the row with the least room that still
holds it, found by a segment tree over capacities. So nothing is shuffled, a task holds one group at a time,
and the same input partitions give the same rows again.

A row carries `input_ids` (row_length ids, little-endian, two bytes each if the vocabulary allows, else four;
padded with the end token), `position_ids` (as wide; restarting at 0 with each segment), `cu_seqlens` (cumulative segment
lengths, from 0 to n_used), `doc_ids` and `doc_offsets` (of each segment: its document and its first token's
number in that document).

Defined results: a null or empty text is one segment that holds the end token; special tokens' strings in texts
are ordinary text; repeated rows are packed each; a null doc_id stays null; extra columns are ignored; an empty
table gives an empty table. Very long texts are tokenised whole; runs of white space of any length, which the tokenizer's
pattern engine can't match, are cut out first, where the pattern cuts them too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROW_LENGTH = 2048
GROUP_TOKENS = 2_000_000
END_ID = 50256
VOCABULARY = "byte_bpe_50k.tiktoken"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The tokenizer of a rank file: a path, or the name of a file of the installed public_tokenizers module, whose PATTERN it follows. One per process."""
    if vocabulary not in _encoders:
        import public_tokenizers
        import tiktoken

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


#: White space as the tokenizer's pattern sees it (White_Space of Unicode), in runs of at least so many characters.
RUN = 500
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUNS = re.compile(f"{_SPACE}{{{RUN},}}")


def encoded(enc, text: str | None) -> np.ndarray:
    """A text's token ids.

    The pattern takes a run of white space up to its last character as one piece, or all of it at the text's end; what
    follows is matched as if the run weren't there. So long runs become pieces of their own, without the pattern."""
    if not text:
        return np.zeros(0, np.uint32)
    plain = lambda t: enc.encode_to_numpy(t, disallowed_special=())
    if len(text) < RUN:
        return plain(text)
    parts, at = [], 0
    for m in _RUNS.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        parts += [plain(text[at : m.start()]), np.array(enc._encode_single_piece(text[m.start() : stop]), np.uint32)]
        at = stop
    return np.concatenate([*parts, plain(text[at:])]) if parts else plain(text)


class Capacities:
    """Open rows by remaining room: a segment tree whose leaf c counts the rows with room c."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and gives (room, row) with the least room of at least `least`."""
        node = self.base + least
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.base
        self._add(room, -1)
        return room, self.rows[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit(lengths: list[int], row_length: int) -> list[list[int]]:
    """Rows of item numbers: best-fit decreasing, ties in the given order. Every length is 1 to row_length."""
    open_rows, rows = Capacities(row_length), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_rows.take(lengths[item])
        if found is None:
            found = row_length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(item)
        if room > lengths[item]:
            open_rows.put(room - lengths[item], row)
    return rows


def pack(docs: DataFrame, row_length: int = ROW_LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS, rows_per_batch: int = 256) -> DataFrame:
    """Packed rows: shard, row, n_used, input_ids, position_ids, cu_seqlens, doc_ids, doc_offsets."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kind = np.dtype("<u2") if max(enc.n_vocab - 1, end_id, row_length) < 65536 else np.dtype("<u4")
        shard, row = TaskContext.get().partitionId(), 0
        pieces: list[np.ndarray] = []
        owners: list[object] = []
        offsets: list[int] = []
        held, id_type = 0, None

        def rows_of(packed: list[list[int]]) -> Iterator[pa.RecordBatch]:
            nonlocal row
            for at in range(0, len(packed), rows_per_batch):
                part = packed[at : at + rows_per_batch]
                out: dict[str, list] = {k: [] for k in ("n", "ids", "positions", "cu", "docs", "offsets")}
                for items in part:
                    ids, positions = np.full(row_length, end_id, kind), np.zeros(row_length, kind)
                    cu = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in items])])
                    for a, b, i in zip(cu[:-1], cu[1:], items, strict=True):
                        ids[a:b] = pieces[i]
                        positions[a:b] = np.arange(b - a)
                    out["n"].append(int(cu[-1]))
                    out["ids"].append(ids.tobytes())
                    out["positions"].append(positions.tobytes())
                    out["cu"].append(cu.tolist())
                    out["docs"].append([owners[i] for i in items])
                    out["offsets"].append([offsets[i] for i in items])
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * n, pa.int32()),
                        pa.array(range(row, row + n), pa.int64()),
                        pa.array(out["n"], pa.int32()),
                        pa.array(out["ids"], pa.binary()),
                        pa.array(out["positions"], pa.binary()),
                        pa.array(out["cu"], pa.list_(pa.int32())),
                        pa.array(out["docs"], pa.list_(id_type)),
                        pa.array(out["offsets"], pa.list_(pa.int64())),
                    ],
                    names=["shard", "row", "n_used", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_offsets"],
                )
                row += n

        for batch in common.slices(batches):
            id_type = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encoded(enc, text), np.uint32(end_id)).astype(kind)
                for a in range(0, len(ids), row_length):
                    pieces.append(ids[a : a + row_length])
                    owners.append(doc)
                    offsets.append(a)
                held += len(ids)
                if held >= group_tokens:
                    yield from rows_of(best_fit([len(x) for x in pieces], row_length))
                    pieces, owners, offsets, held = [], [], [], 0
        if pieces:
            yield from rows_of(best_fit([len(x) for x in pieces], row_length))

    return slim.mapInArrow(run, f"shard int, row long, n_used int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{id_kind}>, doc_offsets array<long>")

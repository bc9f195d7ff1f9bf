"""Token ids and packed binary matrices.

Texts are encoded, documents over the row width are split without loss, and the
pieces are packed best fit decreasing into rows of one width. The bin for a
piece is found with a segment tree over capacities: leaf c is the stack of open
rows with c ids of room, an inner node tells whether any leaf below holds a
row, and a descent finds the smallest sufficient room in log2(width) steps.

A packed row holds its ids (little-endian, padded), cumulative segment lengths
(with 0 in front), and the positions at which position ids start again at 0:
every segment's start. Splits are told by `piece_starts`, so that the pieces of
a document concatenate to its ids.

Scale: one Arrow pass and no shuffle. A task packs what it reads, in windows of
at most `WINDOW_TOKENS` ids, so memory is bounded by the window and each window
leaves one row in about a thousand partly filled. Copies and hot sources are
rows like any other. Rows of ids are Parquet binary columns of one width, so a
file's column is a matrix. Ids take two bytes where the vocabulary has at most
65,536 of them, else four.

Defined results: null and empty texts have no ids and are in no row; rows that
share an id (or have none) are separate documents; an empty table gives an
empty result; extra columns aren't used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texthash import byte_batches

WIDTH = 2048
WINDOW_TOKENS = 4_000_000
PAD = 0

ROWS = (
    "row_id long, ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, piece_starts array<long>, doc_lengths array<long>"
)


class RoomTree:
    """Open rows by room, with a search for the smallest room of at least a size."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.has = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.stacks[room].append(row)
        node = room + self.leaves
        while node and not self.has[node]:
            self.has[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room that is at least `size`."""
        node = size + self.leaves
        if size >= len(self.stacks):
            return None
        while not self.has[node]:
            while node & 1:  # a right child: nothing larger under its parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.has[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.stacks[room].pop()
        if not self.stacks[room]:
            self.has[node] = 0
            node >>= 1
            while node and not (self.has[2 * node] or self.has[2 * node + 1]):
                self.has[node] = 0
                node >>= 1
        return room, row


def pack_rows(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Items of each row, best fit decreasing; sizes from 1 to width."""
    tree, rows = RoomTree(width), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        hit = tree.take(size)
        room, row = hit if hit else (width, len(rows))
        if not hit:
            rows.append([])
        rows[row].append(item)
        if room > size:
            tree.add(room - size, row)
    return rows


def vocabulary_size(kind: str, raw: bytes) -> int:
    """One more than the largest id that a vocabulary file's bytes can give."""
    if kind == "tiktoken":
        return 1 + max(int(line.split()[1]) for line in raw.splitlines() if line.strip())
    if kind == "model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=raw).get_piece_size()
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_str(raw.decode()).get_vocab(with_added_tokens=True).values())


def encoder(kind: str, raw: bytes, pattern: str):
    """Texts to id arrays, for a vocabulary file's bytes and suffix; special strings in texts are plain text."""
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.asarray(encoding.encode_ordinary(x), np.uint32) for x in texts]
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        return lambda texts: [np.asarray(x, np.uint32) for x in model.encode(texts, num_threads=1)]
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(raw.decode())
        tokenizer.encode_special_tokens = True
        return lambda texts: [np.asarray(x.ids, np.uint32) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"unknown vocabulary file kind {kind!r}")


def packed_window(ids: list, tokens: list[np.ndarray], width: int, first_row: int, wide: bool) -> pd.DataFrame:
    """Packed rows of some documents."""
    doc, start, size = [], [], []
    for k, own in enumerate(tokens):
        for at in range(0, len(own), width):
            doc.append(k)
            start.append(at)
            size.append(min(width, len(own) - at))
    out = []
    kind = "<u4" if wide else "<u2"
    for number, items in enumerate(pack_rows(np.array(size, np.int64), width)):
        row, bounds = np.full(width, PAD, kind), [0]
        for i in items:
            row[bounds[-1] : bounds[-1] + size[i]] = tokens[doc[i]][start[i] : start[i] + size[i]]
            bounds.append(bounds[-1] + size[i])
        out.append(
            (
                first_row + number,
                row.tobytes(),
                bounds[-1],
                bounds,
                bounds[:-1],
                [ids[doc[i]] for i in items],
                [start[i] for i in items],
                [len(tokens[doc[i]]) for i in items],
            )
        )
    return pd.DataFrame(out, columns=["row_id", "ids", "n_ids", "cu_seqlens", "position_resets", "doc_ids", "piece_starts", "doc_lengths"])


def _packer(model, pattern: str, width: int, wide: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(*model.value, pattern)
        next_row = TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in batches:
            names = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            for at, group in byte_batches(list(batch["text"]), 1 << 20):
                for k, own in enumerate(encode([x.decode("utf-8", "replace") for x in group])):
                    if len(own):
                        ids.append(names[at + k])
                        tokens.append(own if wide else own.astype(np.uint16))
                        held += len(own)
                if held >= WINDOW_TOKENS:
                    out = packed_window(ids, tokens, width, next_row, wide)
                    yield out
                    next_row += len(out)
                    ids, tokens, held = [], [], 0
        if ids:
            yield packed_window(ids, tokens, width, next_row, wide)

    return run


def pack_tokens(docs: DataFrame, vocabulary: str, pattern: str = "", width: int = WIDTH, wide: bool | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows (ROWS). wide: ids of four bytes instead of two, by the vocabulary's size unless given. The vocabulary file (a few MB) is broadcast."""
    kind = vocabulary.rpartition(".")[2]
    with open(vocabulary, "rb") as file:
        raw = file.read()
    fits = vocabulary_size(kind, raw) <= 1 << 16
    if wide is False and not fits:
        raise ValueError("ids of this vocabulary don't fit two bytes")
    wide = not fits if wide is None else wide
    model = docs.sparkSession.sparkContext.broadcast((kind, raw))
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInPandas(_packer(model, pattern, width, wide), ROWS)


def positions(cu_seqlens: list[int], width: int) -> np.ndarray:
    """Position ids of a row: from 0 in each segment, and in the padding."""
    bounds = [*cu_seqlens, width] if cu_seqlens[-1] < width else cu_seqlens
    return np.concatenate([np.arange(b - a) for a, b in zip(bounds, bounds[1:], strict=False)]) if len(bounds) > 1 else np.zeros(0, int)


def unpacked(packed: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, piece_start, doc_length, ids) of each segment, with the ids as an array."""
    width = 4 if wide else 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                row = np.frombuffer(r.ids, f"<u{width}")
                for k, name in enumerate(r.doc_ids):
                    out.append((name, int(r.piece_starts[k]), int(r.doc_lengths[k]), row[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].astype(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "piece_start", "doc_length", "ids"])

    return packed.mapInPandas(run, "doc_id long, piece_start long, doc_length long, ids array<long>")

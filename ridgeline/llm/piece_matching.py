"""SentencePiece encoding and decoding by suffix-array matching.

For a batch, texts are normalised (word marks) and cut at marks that follow
another character, which no piece spans; the distinct parts are concatenated
and indexed with a suffix array (prefix doubling up to the longest piece). Every
piece of the vocabulary is binary-searched for its range of occurrences, and
the resulting edges (from, to, piece) are sorted by position, then length. They
are relaxed over that sorted list, which a word of bits for each position opens:
the edges of a position are a run of the list, and the bits under a length count
those before it. A part longer than `INDEX_CHARS` is indexed window by window,
with an overlap of the longest piece, so memory is in proportion to the text:

* BPE: adjacent symbols whose span is an edge merge, best score first and
  leftmost among equals, until no edge joins two symbols. All parts of a batch
  take their steps together in arrays; a very long part uses a heap.
* unigram: the best-scoring path over the edges, position by position.

Characters without a piece become byte pieces (or the unknown id). Ids equal
those of the sentencepiece library for models without normalisation rules;
others are refused. Decoding joins pieces, assembles bytes, and turns marks
into spaces.

Scale: one Arrow pass and no shuffle; memory is bounded by the batch (texts of
`BATCH_BYTES`), the parts indexed at once, and the cache of parts.

Defined results: null and empty texts have no ids; rows that share an id are
encoded one by one; a word mark that stands in a text itself decodes to a space,
as in the library; an empty table gives an empty result; extra columns pass
through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texthash import byte_batches

MARK = "▁"
BATCH_BYTES = 4 << 20
INDEX_CHARS = 400_000
LONG_PART = 192
CACHED_PARTS = 400_000
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_GAP = 0x110000  # no character


class Vocabulary(NamedTuple):
    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: dict[int, int]
    unknown: int
    unigram: bool


def read_vocabulary(raw: bytes) -> Vocabulary:
    """Pieces and scores of a model file's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    size = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    normal = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(size)])
    if any(MARK in p.lstrip(MARK) for p, n in zip(pieces, normal, strict=True) if n):
        raise ValueError("a piece has a word mark after another character")
    for probe in ("a  b ", "Å ﬁ", "a\tb"):
        joined = "".join(model.encode(probe, out_type=str))
        if re.sub("<0x..>", "", joined) != "".join(c for c in MARK + probe.replace(" ", MARK) if c in joined):
            raise ValueError("the model has normalisation rules")
    bytes_of = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    # Only a BPE model's scores are whole numbers that fall by one a piece.
    scores = np.array([model.get_score(i) for i in range(size)])
    own = scores[normal]
    return Vocabulary(pieces, scores, normal, bytes_of, model.unk_id(), not np.all(own == np.round(own)))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first `depth` codes (prefix doubling)."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        other = np.zeros(len(codes), np.int64)
        other[:-step] = rank[step:] + 1
        values, rank = np.unique(rank * (len(codes) + 1) + other, return_inverse=True)
        rank = rank.astype(np.int64)
        if len(values) == len(codes):
            break
        step *= 2
    return np.argsort(rank, kind="stable")


class Matcher:
    """All occurrences of a vocabulary's pieces in a text."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        ids = np.flatnonzero(vocabulary.normal & np.array([len(p) > 0 for p in vocabulary.pieces]))
        self.length = np.array([len(vocabulary.pieces[i]) for i in ids])
        order = np.argsort(self.length, kind="stable")
        self.ids, self.length = ids[order], self.length[order]
        self.depth = int(self.length.max())
        self.codes = np.full((len(ids), self.depth), _GAP, np.int64)
        for k, i in enumerate(self.ids):
            piece = vocabulary.pieces[i]
            self.codes[k, : len(piece)] = [ord(c) for c in piece]

    def ranges(self, codes: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each piece in the suffix array, narrowed character by character by binary search."""
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(suffixes))
        padded = np.append(codes, np.full(self.depth, -1))
        for d in range(self.depth):
            live = np.flatnonzero((self.length > d) & (high > low))
            if not len(live):
                break
            want = self.codes[live, d]
            low_d, high_d = low[live], high[live]
            low[live] = _bisect(padded, suffixes, d, want, low_d, high_d, False)
            high[live] = _bisect(padded, suffixes, d, want, low_d, high_d, True)
        return low, high

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece id) of all occurrences, sorted by start, then length."""
        parts = []
        for at in range(0, max(len(codes), 1), 2 * INDEX_CHARS):
            own = min(2 * INDEX_CHARS, len(codes) - at)
            start, length, piece = self._edges(codes[at : at + own + self.depth])
            inside = slice(0, int(np.searchsorted(start, own)))
            parts.append((start[inside] + at, length[inside], piece[inside]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        suffixes = suffix_array(codes, self.depth)
        low, high = self.ranges(codes, suffixes)
        count = np.maximum(high - low, 0)
        at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, length, piece = suffixes[at], np.repeat(self.length, count), np.repeat(self.ids, count)
        order = np.argsort(start * (self.depth + 1) + length, kind="stable")
        return start[order], length[order], piece[order]


def _bisect(codes: np.ndarray, suffixes: np.ndarray, d: int, want: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        seen = codes[suffixes[np.minimum(mid, len(suffixes) - 1)] + d]
        right = open_ & ((seen <= want) if after else (seen < want))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)


class Edges:
    """Edges sorted by start, then length, with the piece of a start and a length."""

    def __init__(self, start: np.ndarray, length: np.ndarray, piece: np.ndarray, size: int, depth: int) -> None:
        self.piece = np.append(piece, -1).astype(np.int32)
        self.depth = depth
        self.first = np.searchsorted(start, np.arange(size + 1)).astype(np.int32)
        self.words = -(-(depth + 1) // 64)
        self.bits = np.zeros((self.words, size + 1), np.uint64)
        for w in range(self.words):
            own = length // 64 == w
            np.bitwise_or.at(self.bits[w], start[own], np.uint64(1) << (length[own] % 64).astype(np.uint64))

    def find(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece from each start with a length of at most depth, or -1."""
        before = np.zeros(len(start), np.int64)
        held = np.zeros(len(start), bool)
        for w in range(self.words):
            bits, shift = self.bits[w][start], np.clip(length - 64 * w, 0, 63).astype(np.uint64)
            inside = (length // 64) == w
            held |= inside & ((bits >> shift) & np.uint64(1) == 1)
            under = np.where(inside, bits & ((np.uint64(1) << shift) - np.uint64(1)), np.where(length >= 64 * (w + 1), bits, np.uint64(0)))
            before += np.bitwise_count(under)
        return self.piece[np.where(held, self.first[start] + before, -1)]

    def of(self, start: int) -> dict[int, int]:
        """Pieces by length from one start, in rising order."""
        a, b = int(self.first[start]), int(self.first[start + 1])
        lengths = [64 * w + k for w in range(self.words) for k in range(64) if int(self.bits[w][start]) >> k & 1]
        return dict(zip(lengths, self.piece[a:b].tolist(), strict=True))


def merged_starts(starts: np.ndarray, part: np.ndarray, ends: np.ndarray, edges: Edges, scores: np.ndarray) -> np.ndarray:
    """Symbol starts after all BPE merges; parts are merged side by side, one step a round."""
    depth = edges.depth
    done = []
    while len(starts):
        stop = np.append(starts[1:], 0)
        last = np.append(part[1:] != part[:-1], True)
        stop[last] = ends[part[last]]
        # A pair is a symbol and the next one; its span ends where the next one does.
        span = np.zeros(len(starts), np.int64)
        span[:-1] = np.where(last[:-1], 0, stop[1:] - starts[:-1])
        piece = np.full(len(starts), -1, np.int32)
        near = np.flatnonzero((span > 0) & (span <= depth))
        piece[near] = edges.find(starts[near], span[near])
        score = np.where(piece >= 0, scores[piece], -np.inf)
        heads = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        best = np.maximum.reduceat(score, heads)
        sizes = np.diff(np.append(heads, len(starts)))
        of = np.repeat(np.arange(len(heads)), sizes)
        settled = best == -np.inf
        done.append(starts[settled[of]])
        hit = np.flatnonzero((score == best[of]) & ~settled[of])
        first = hit[np.unique(of[hit], return_index=True)[1]]
        keep = ~settled[of]
        keep[first + 1] = False
        starts, part = starts[keep], part[keep]
    return np.sort(np.concatenate(done)) if done else starts


def heap_starts(start: int, end: int, edges: Edges, scores: np.ndarray) -> list[int]:
    """The same for one long part, with a heap of pairs."""
    following = dict(zip(range(start, end), range(start + 1, end + 1), strict=True))
    before = {b: a for a, b in following.items()}
    heap: list[tuple[float, int, int]] = []
    pieces = [edges.of(a) for a in range(start, end)]

    def offer(a: int) -> None:
        b = following.get(a)
        if b is not None and b < end and (piece := pieces[a - start].get((stop := following[b]) - a)) is not None:
            heapq.heappush(heap, (-scores[piece], a, stop))

    for a in range(start, end):
        offer(a)
    while heap:
        _, a, stop = heapq.heappop(heap)
        middle = following.get(a)
        if middle is None or middle >= end or following[middle] != stop:
            continue
        del following[middle]
        following[a], before[stop] = stop, a
        offer(a)
        if a > start:
            offer(before[a])
    return sorted(following)


def best_path(start: int, end: int, edges: Edges, scores: np.ndarray, unknown: float) -> list[int]:
    """Symbol starts of the best-scoring path (unigram), relaxed edge by edge; a character without a piece costs `unknown`."""
    best, back = np.full(end - start + 1, -np.inf), np.zeros(end - start + 1, np.int64)
    best[0] = 0
    for a in range(end - start):
        own = edges.of(start + a)
        for n, piece in ({1: None} | own).items():
            if a + n > end - start:
                break
            gain = unknown if piece is None else scores[piece]
            if best[a] + gain > best[a + n]:
                best[a + n], back[a + n] = best[a] + gain, a
    out, at = [], end - start
    while at:
        at = int(back[at])
        out.append(start + at)
    return out[::-1]


class Encoder:
    """Texts to ids, with a cache of the parts seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.matcher = vocabulary, Matcher(vocabulary)
        self.lowest = float(vocabulary.scores[vocabulary.normal].min()) - 10.0
        self.singles = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.normal[i] and len(p) == 1}
        self.piece_bytes = [bytes([int(p[3:5], 16)]) if i in vocabulary.byte_ids.values() else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.offsets, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts and adds them to the cache."""
        groups, group, held = [], [], 0
        for part in parts:
            group.append(part)
            held += len(part) + 1
            if held >= INDEX_CHARS:
                groups, group, held = [*groups, group], [], 0
        for group in [*groups, group] if group else groups:
            flat, sizes = self._encode(group)
            base = len(self.known)
            self.known.update(zip(group, range(base, base + len(group)), strict=True))
            self.offsets = np.concatenate((self.offsets, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, flat))

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their count for each part: index, match, sort, relax."""
        lengths = np.array([len(p) for p in parts], np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        ends = begins + lengths
        text = np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        text[ends] = _GAP
        start, length, piece = self.matcher.edges(text)
        edges = Edges(start, length, piece, len(text), self.matcher.depth)
        del start, length, piece
        scores = self.vocabulary.scores
        if self.vocabulary.unigram:
            starts = np.array([s for a, b in zip(begins, ends, strict=True) for s in best_path(int(a), int(b), edges, scores, self.lowest)], np.int64)
        else:
            short = np.flatnonzero(lengths <= LONG_PART)
            part = np.repeat(short, lengths[short])
            at = np.repeat(begins[short], lengths[short]) + np.arange(len(part)) - np.repeat(np.cumsum(lengths[short]) - lengths[short], lengths[short])
            starts = merged_starts(at, part, ends, edges, scores)
            long = [np.array(heap_starts(int(begins[k]), int(ends[k]), edges, scores)) for k in np.flatnonzero(lengths > LONG_PART)]
            starts = np.sort(np.concatenate([starts, *long])).astype(np.int64)
        owner = np.searchsorted(begins, starts, "right") - 1
        stop = np.append(starts[1:], 0)
        last = np.append(owner[1:] != owner[:-1], True) if len(starts) else np.zeros(0, bool)
        stop[last] = ends[owner[last]]
        size = stop - starts
        ids = np.where(size <= self.matcher.depth, edges.find(starts, np.minimum(size, self.matcher.depth)), -1).astype(np.int64)
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return ids.astype(np.uint32), np.bincount(owner, minlength=len(parts))
        # A character without a piece: its bytes.
        out, counts = [], np.ones(len(ids), np.int64)
        at = 0
        for k in missing.tolist():
            out.append(ids[at:k])
            character = chr(int(text[starts[k]])).encode("utf-8", "replace")
            spelled = [self.vocabulary.byte_ids.get(b, self.vocabulary.unknown) for b in character] if self.vocabulary.byte_ids else [self.vocabulary.unknown]
            out.append(np.array(spelled, np.int64))
            counts[k], at = len(spelled), k + 1
        out.append(ids[at:])
        return np.concatenate(out).astype(np.uint32), np.bincount(owner, weights=counts, minlength=len(parts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and their count for each text."""
        if len(self.known) > CACHED_PARTS:
            self._forget()
        parts = [_PART.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        self._learn(list({p: None for own in parts for p in own if p not in self.known}))
        look = self.known.__getitem__
        index = np.fromiter((look(p) for own in parts for p in own), np.int64)
        size = self.sizes[index]
        at = np.repeat(self.offsets[index] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        bounds = np.concatenate(([0], np.cumsum([len(own) for own in parts])))
        total = np.concatenate(([0], np.cumsum(size)))
        return self.flat[at], total[bounds[1:]] - total[bounds[:-1]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, without the mark that encoding puts in front."""
        raw = b"".join(map(self.piece_bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def _coder(model, digest: bool):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(read_vocabulary(model.value))
        for batch in batches:
            ids_out, sizes, ids_digest, text_digest, same = [], [], [], [], []
            for _, group in byte_batches(list(batch), BATCH_BYTES):
                texts = [x.decode("utf-8", "replace") for x in group]
                flat, size = encoder.encode(texts)
                bounds = np.concatenate(([0], np.cumsum(size)))
                for k, text in enumerate(texts):
                    own = flat[bounds[k] : bounds[k + 1]]
                    sizes.append(len(own))
                    if digest:
                        decoded = encoder.decode(own)
                        ids_digest.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                        text_digest.append(hashlib.sha256(decoded.encode()).hexdigest())
                        same.append(decoded == text)
                    else:
                        ids_out.append(own.astype(np.int32))
            if digest:
                yield pd.DataFrame({"n_tokens": sizes, "ids_sha256": ids_digest, "decoded_sha256": text_digest, "round_trip": same}).astype({"n_tokens": "int64", "round_trip": bool})
            else:
                yield pd.DataFrame({"n_tokens": pd.Series(sizes, dtype="int64"), "ids": pd.Series(ids_out, dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return run


def _model(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens and ids (array<int>). The model file (a few MB) is broadcast."""
    coded = F.pandas_udf(_coder(_model(docs, vocabulary), False), "n_tokens long, ids array<int>")(F.col(text))
    return docs.withColumn("_coded", coded).withColumns({"n_tokens": F.col("_coded.n_tokens"), "ids": F.col("_coded.ids")}).drop("_coded")


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with n_tokens, digests of the ids (little-endian, four bytes each) and of the decoded text, and whether that is the text."""
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    coded = F.pandas_udf(_coder(_model(docs, vocabulary), True), schema)(F.col(text))
    names = ("n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
    return docs.withColumn("_coded", coded).withColumns({x: F.col("_coded")[x] for x in names}).drop("_coded")


def decode(coded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """`coded` with the text of its ids in `decoded`; null for null."""
    model = _model(coded, vocabulary)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(read_vocabulary(model.value))
        for batch in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x)) for x in batch], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return coded.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids)))

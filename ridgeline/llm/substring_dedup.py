"""Substring dedup by paragraph MinHash banding.

Paragraphs are of three kinds, all made by content alone:

* lines of at least `LINE_WORDS` words;
* segments between words whose hash is largest within `REACH` words on either
  side, whatever the line breaks: about 2 * REACH + 1 words each, and every word
  is in one, so that short lines, other wrapping and passages pasted into a line
  meet as well;
* sliding blocks of `2 * SEED_WORDS - 1` = 51 words. A block's MinHash over its
  windows of `SEED_WORDS` words is one band of one row, its seed: equal blocks
  have equal seeds, and neighbouring blocks mostly share theirs.

Lines and segments have MinHash bands over 5-word shingles, tuned to a recall
of 0.99 at Jaccard 0.8. Each kind has bands of its own (a line and a segment
inside it would always collide; equal ones meet by their words). Paragraphs that share a band are joined: each with the
one that occurs most often in the band (in a group of near copies, the words
that most of them have left unchanged), and their exact shingle sets are
compared; links make components. Where a band then still holds paragraphs of several components that
have not been compared, the prefix-filtered exact join does that, so that no
band makes all its pairs and none is cut short. Equal paragraphs share all bands
and are folded to one before.

A component that occurs in two documents or more repeats. It stays in the
document with the smallest id and goes from the others. Seeds at the ends of
a repeated run are extended word by word, as far as another document on the
right side of the verdict (a smaller id for words that go) has the same words:
the words beside seeds are sorted, and neighbours are compared, so a hot seed
makes no pairs. Neighbouring occurrences are merged to passages,
and those of at least `PASSAGE_WORDS` words are removed.

Scale: one Arrow pass makes a row of numbers for each paragraph; counts combine
on the map side and joins are on paragraph hashes or bands, which AQE splits
where one is hot (a line that a third of all documents hold). A bit filter sets
paragraphs aside that share no hash or band with another, before the joins.
Only paragraphs that share a band with a different one are read again, from
the documents that the filter lets through.

Defined results: null and empty texts have no paragraphs; rows with a null id
take no part in the search and stay whole; rows that share an id count as one
document when repeats are counted, but each text is cut at its own passages only
(rows are told by id and text digest); repeats inside one document only are left
alone; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ridgeline.llm.ngram_join import stars, near_duplicates
from ridgeline.llm.shared import Scratch, connected_components, perhaps_in, split_by_ids, text_digest
from ridgeline.llm.texthash import WordHasher, byte_batches, give_back, mix, shingles, text_groups, windows

THRESHOLD_PERCENT = 80
RECALL = 0.99
MOST_HASHES = 21
LINE_WORDS = 20
REACH = 24
PASSAGE_WORDS = 20
SEED_WORDS = 26
JOIN_GAP = 6
SHINGLE = 5

SEGMENT, LINE, SEED = 0, 1, 2
OCCURRENCES = "kind int, hash long, doc_id long, digest long, first int, words int, start int, end int, bands array<long>"
END = "doc_id long, digest long, first int, side int, kept boolean, hash long, low long, high long, asks boolean"
END_NAMES = [x.split()[0] for x in END.split(", ")]
BESIDE = END + ", level int, byte int, key long"
CONTEXT = END + ", words binary, bytes binary"
MATCH = END + ", level int, byte int, key long"
PLACE = END_NAMES[:6]
CHUNK_ROWS = 16_384
SETS = "hash long, n long, shingles array<long>, text string"


_SALTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def tuned_bands(threshold: float = THRESHOLD_PERCENT / 100, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): of those with the recall at the threshold and at most so many hashes, the one that lets the fewest pairs of half the threshold through."""
    best = None
    for rows in range(1, most_hashes + 1):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                false = 1 - (1 - (threshold / 2) ** rows) ** bands
                best = min(best or (2.0, 0, 0), (false, bands, rows))
                break
    if best is None:
        raise ValueError("no banding has this recall with so few hashes")
    return best[1], best[2]


def _highest(x: np.ndarray, size: int) -> np.ndarray:
    """The maximum of each `size` values from a place on."""
    span = 1
    while span < size:  # spans double, and the last two overlap
        step = min(span, size - span)
        x, span = np.maximum(x[:-step], x[step:]), span + step
    return x


def _cuts(hashes: np.ndarray, text: np.ndarray, reach: int) -> np.ndarray:
    """Whether a segment begins at each word: the first of a text, or the one after a word with the largest hash within reach in its text."""
    begins = np.ones(len(hashes), bool)
    begins[1:] = text[1:] != text[:-1]
    if len(hashes) > 1:
        # Zeros between texts, so that cuts don't depend on the texts beside.
        place = np.arange(len(hashes)) + reach * np.cumsum(begins)
        padded = np.zeros(int(place[-1]) + reach + 1, np.uint64)
        padded[place] = mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) | np.uint64(1)
        around, own = _highest(padded, reach), padded[place]
        top = (own > around[place - reach]) & (own > around[place + 1])
        begins[1:] |= top[:-1]
    return begins


def _spans(begins: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and hash of the words, of each span."""
    first = np.flatnonzero(begins)
    after = np.append(first[1:], len(begins))
    if not len(first):
        return first, after[:0], np.zeros(0, np.uint64)
    # A sum of mixed pairs of word and place tells sequences apart.
    place = (np.arange(len(begins)) - np.repeat(first, after - first)).astype(np.uint64)
    value = np.add.reduceat(mix(hashes + mix(place + np.uint64(1)) * np.uint64(3)), first)
    return first, after, mix(value ^ (after - first).astype(np.uint64))


def _seeds(found: np.ndarray, text: np.ndarray) -> np.ndarray:
    """First words of the seeds: the first smallest window of every SEED_WORDS consecutive ones inside a text."""
    n = len(text) - 2 * (SEED_WORDS - 1)
    if n <= 0:
        return np.zeros(0, np.int64)
    low, span = np.arange(len(found)), 1
    while span < SEED_WORDS:  # spans double, and the last two overlap
        step = min(span, SEED_WORDS - span)
        left, right = low[:-step], low[step:]
        low, span = np.where(found[right] < found[left], right, left), span + step
    return np.unique(low[:n][text[:n] == text[len(text) - n :]])


def _line_begins(raw: bytes, words, n_texts: int, bounds: np.ndarray) -> np.ndarray:
    """Whether each word is the first of its line."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    line = np.searchsorted(breaks, words.start + bounds[words.text])
    begins = np.ones(len(line), bool)
    begins[1:] = (line[1:] != line[:-1]) | (words.text[1:] != words.text[:-1])
    return begins


def _signatures(kind: int, found: np.ndarray, first: np.ndarray, after: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band keys for each span of words of a kind; found: hashes of the SHINGLE-word windows."""
    size = after - first - (SHINGLE - 1)
    heads = np.cumsum(size) - size
    inside = found[np.repeat(first - heads, size) + np.arange(size.sum())]
    keys = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first), 64 * kind + b, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            key = mix(key ^ np.minimum.reduceat(inside * _SALTS[r], heads))
        keys[:, b] = key
    return keys


def _paragraphs(bands: int, rows: int):
    """All paragraphs of texts, as OCCURRENCES."""
    names = [x.split()[0] for x in OCCURRENCES.split(", ")]

    def batch_of(words, line: np.ndarray, ids: np.ndarray, digests: np.ndarray) -> pa.RecordBatch:
        position = np.arange(len(words.hash)) - np.searchsorted(words.text, words.text)
        found = windows(words.hash, SEED_WORDS)
        seeds = _seeds(found, words.text)
        spans = [(SEED, seeds, seeds + SEED_WORDS, found[seeds])]
        for kind, begins, least in ((SEGMENT, _cuts(words.hash, words.text, REACH), SHINGLE), (LINE, line, LINE_WORDS)):
            first, after, value = _spans(begins, words.hash)
            keep = after - first >= least
            spans.append((kind, first[keep], after[keep], value[keep]))
        kind = np.concatenate([np.full(len(x[1]), x[0], np.int32) for x in spans])
        first, after, value = (np.concatenate([x[k] for x in spans]) for k in (1, 2, 3))
        shingled = windows(words.hash, SHINGLE)
        keyed = np.concatenate([_signatures(kind, shingled, a, b, bands, rows) for kind, a, b, _ in spans[1:] if len(a)] or [np.zeros((0, bands), np.uint64)])
        none = len(seeds)
        offsets = np.concatenate([np.zeros(none, np.int32), np.arange(len(keyed) + 1, dtype=np.int32) * bands])
        signatures = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keyed.reshape(-1).view(np.int64)))
        text = words.text[first]
        columns = [kind, value.view(np.int64), ids[text], digests[text], position[first].astype(np.int32), (after - first).astype(np.int32), words.start[first].astype(np.int32), words.end[after - 1].astype(np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), signatures], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(lower=True)
        for batch in batches:
            ids, digests = batch.column("doc_id").to_numpy(), batch.column("digest").to_numpy()
            for at, texts in text_groups(batch.column("text"), 1 << 19):
                words = hasher.words(texts)
                if len(words.hash):
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
                    line = _line_begins(b"".join(texts), words, len(texts), bounds[:-1])
                    yield batch_of(words, line, ids[at : at + len(texts)], digests[at : at + len(texts)])
        give_back()

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ends of seeds in some texts: their columns as in END, hashes of seed and side, how many words are beside, and the hashes and outer bytes of these."""
    hasher = WordHasher(lower=True)
    for batch in batches:
        for at, texts in text_groups(batch.column("text"), 1 << 19):
            words, rows = hasher.words(texts), batch.slice(at, len(texts))
            text = np.repeat(np.arange(len(texts)), pc.list_value_length(rows.column("first")).to_numpy(zero_copy_only=False))
            flat = {c: rows.column(c).flatten() for c in END_NAMES[2:]}
            columns = [rows.column(c).take(pa.array(text)) for c in END_NAMES[:2]] + list(flat.values())
            begin, after = (np.searchsorted(words.text, text, way) for way in ("left", "right"))
            side, value = flat["side"].to_numpy(), flat["hash"].to_numpy()
            place = begin + flat["first"].to_numpy().astype(np.int64)
            left = side == 0
            most = np.minimum(np.where(left, place - begin, after - place - SEED_WORDS), SEED_WORDS - 1)
            step = np.arange(1, SEED_WORDS)
            word = np.where(left[:, None], place[:, None] - step, place[:, None] + SEED_WORDS - 1 + step)
            word = np.clip(word, 0, max(len(words.hash) - 1, 0))
            byte = np.where(left[:, None], words.start[word], words.end[word]).astype(np.int32)
            yield columns, _seed_key(value, side), most, words.hash[word], byte
    give_back()


def _seed_key(value: np.ndarray, side: np.ndarray) -> np.ndarray:
    return mix(value.view(np.uint64) + side.astype(np.uint64))


def _whole_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each side of a seed, the hash of the seed and of all words beside it, up to SEED_WORDS - 1."""
    for columns, key, most, words, byte in _ends(batches):
        for level in range(1, SEED_WORDS):
            key = np.where(most >= level, mix(key + words[:, level - 1]), key)
        has = np.flatnonzero(most >= 1)
        last = [pa.array(most[has].astype(np.int32)), pa.array(byte[has, most[has] - 1]), pa.array(key[has].view(np.int64))]
        yield pa.RecordBatch.from_arrays([x.take(pa.array(has)) for x in columns] + last, [x.split()[0] for x in BESIDE.split(", ")])


def _each_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each side of a seed, the words beside it: 8 bytes of hash and 4 bytes of place each, the nearest one first."""
    for columns, _, most, words, byte in _ends(batches):
        inside = np.arange(1, SEED_WORDS) <= most[:, None]
        cuts = np.concatenate(([0], np.cumsum(most)))
        packed = lambda x, size: pa.Array.from_buffers(pa.binary(), len(most), [None, pa.py_buffer((cuts * size).astype(np.int32)), pa.py_buffer(x[inside].tobytes())])  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([*columns, packed(words, 8), packed(byte, 4)], [x.split()[0] for x in CONTEXT.split(", ")])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(a row of SEED_WORDS - 1 values for each, zeros at its end; how many are its own)."""
    raw = column.to_pylist()
    most = np.array([len(x) for x in raw], np.int64) // np.dtype(kind).itemsize
    out = np.zeros((len(raw), SEED_WORDS - 1), kind)
    out[np.arange(SEED_WORDS - 1) < most[:, None]] = np.frombuffer(b"".join(raw), kind)
    return out, most


def _longest(chunk_rows: int):
    """MATCH of ends (CONTEXT) sorted by seed, side and words, a chunk of rows at a time.

    Ends with the same first words lie side by side, so a chunk knows all partners
    but those that share the words of its own first or last row. For these it
    asks (asking rows with a key), and tells of its own part (rows with a key
    that don't ask).
    """

    def matches(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, most = _unpacked(rows.column("words"), np.uint64)
        value, side, doc, low, high = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "side", "doc_id", "low", "high"))
        kept, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("kept", "asks"))
        step = np.arange(1, SEED_WORDS)
        equal = (words[1:] == words[:-1]) & (step <= np.minimum(most[1:], most[:-1])[:, None])
        common = np.where((value[1:] == value[:-1]) & (side[1:] == side[:-1]), np.cumprod(equal, axis=1).sum(axis=1), 0)
        best = np.zeros(len(most), np.int64)
        for level in step:
            begins = np.concatenate(([True], common < level))
            heads, group = np.flatnonzero(begins), np.cumsum(begins) - 1
            partner = np.where(kept, np.maximum.reduceat(high, heads)[group] > doc, np.minimum.reduceat(low, heads)[group] < doc)
            best[partner & (most >= level)] = level
        ahead = np.minimum.accumulate(np.concatenate((most[:1], common)))
        behind = np.minimum.accumulate(np.concatenate((most[-1:], common[::-1])))[::-1]
        outer = np.maximum(ahead, behind)

        def key_of(at: np.ndarray, level: np.ndarray) -> np.ndarray:
            key = _seed_key(value[at], side[at])
            for k in range(1, SEED_WORDS):
                key = np.where(level >= k, mix(key + words[at, k - 1]), key)
            return mix(key + level.astype(np.uint64)).view(np.int64)

        byte, _ = _unpacked(rows.column("bytes"), np.int32)
        sure = np.flatnonzero(asks & (best > 0))
        unsure = np.flatnonzero(asks & (outer > best))
        more = (outer - best)[unsure]
        at = np.repeat(unsure, more)
        level = best[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
        # What the chunk holds of the first words of its first and last row.
        edge, edge_level, edge_low, edge_high = [], [], [], []
        for row, shared in ((0, ahead), (len(most) - 1, behind)):
            for k in range(1, int(most[row]) + 1):
                part = shared >= k
                edge.append(row), edge_level.append(k), edge_low.append(low[part].min()), edge_high.append(high[part].max())
        edge, edge_level = np.array(edge, np.int64), np.array(edge_level, np.int64)
        take = np.concatenate((sure, at, edge))
        levels = np.concatenate((best[sure], level, edge_level))
        key = pa.array(np.concatenate((np.zeros(len(sure), np.int64), key_of(at, level), key_of(edge, edge_level))), mask=np.arange(len(take)) < len(sure))
        tells = np.arange(len(take)) >= len(sure) + len(at)
        place = [rows.column(c).take(pa.array(take)) for c in PLACE]
        own = [pa.array(np.concatenate((x[sure], x[at], np.array(y, np.int64)))) for x, y in ((low, edge_low), (high, edge_high))]
        yield pa.RecordBatch.from_arrays([*place, *own, pa.array(~tells), pa.array(levels.astype(np.int32)), pa.array(byte[take, levels - 1]), key], [x.split()[0] for x in MATCH.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            if size >= chunk_rows:
                yield from matches(pa.concat_batches(held))
                held, size = [], 0
        if size:
            yield from matches(pa.concat_batches(held))
        give_back()

    return run


def _read_beside(source: DataFrame, ends: DataFrame, scratch: Scratch, reader, schema: str) -> tuple[DataFrame, str]:
    names = END_NAMES[2:]
    some = perhaps_in(source, "doc_id", ends.select("doc_id"))
    grouped = ends.groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*names)).alias("end")).select("doc_id", "digest", *[F.col(f"end.{c}").alias(c) for c in names])
    # Rows with equal id and text have equal surroundings.
    return scratch.table(some.join(grouped.hint("merge"), ["doc_id", "digest"]).mapInArrow(reader, schema))


def longest_matches(deputies: DataFrame, scratch: Scratch, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(PLACE, level, byte): for each asking end (CONTEXT), the most words that it shares with one on the right side of its verdict.

    Ends are sorted over all partitions, so that a hot seed spreads over many; each
    chunk of rows compares neighbours, and chunks tell each other of words that
    go on beyond them.
    """
    order = ["hash", "side", "words", "doc_id", "first"]
    ranked, path = scratch.table(deputies.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_longest(chunk_rows), MATCH))
    beyond = ranked.where("key is not null and not asks").groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    answered = ranked.where("key is not null and asks").join(beyond, "key").where("if(kept, most > doc_id, least < doc_id)")
    found = ranked.where("key is null").select(*PLACE, "level", "byte").unionByName(answered.select(*PLACE, "level", "byte"))
    out = scratch.keep(found.groupBy(*PLACE).agg(F.max(F.struct("level", "byte")).alias("at")).select(*PLACE, "at.level", "at.byte"))
    scratch.drop(path)
    return out


def extensions(source: DataFrame, seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """Occurrences of the words by which repeated runs go on beyond their first and last seeds.

    seeds: all occurrences of repeated seeds, (doc_id, digest, first, hash, kept). Most
    have the same SEED_WORDS - 1 words beside them as another one; of such
    equals, only the one with the smallest and the one with the largest id are
    compared with the others word by word.
    """
    row = Window.partitionBy("doc_id", "digest", "kept").orderBy("first")
    open_side = lambda x, side: F.when(x.isNull() | (x > SEED_WORDS), F.lit(side))
    sides = F.array_compact(F.array(open_side(F.col("first") - F.lag("first").over(row), 0), open_side(F.lead("first").over(row) - F.col("first"), 1)))
    marked, marked_path = scratch.table(seeds.withColumn("asked", sides))
    wanted = marked.select("hash", F.explode("asked").alias("side")).distinct()
    ends = marked.join(wanted, "hash").withColumn("asks", F.array_contains("asked", F.col("side"))).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(0).cast("long")})
    ends, ends_path = scratch.table(ends.drop("asked"))
    scratch.drop(marked_path)
    whole, whole_path = _read_beside(source, ends, scratch, _whole_beside, BESIDE)
    scratch.drop(ends_path)
    # Written, so that the join reads it from its own exchange and AQE can split a key of many copies.
    equals, equals_path = scratch.table(whole.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    told, told_path = scratch.table(whole.drop("low", "high").join(equals, "key"))
    scratch.drop(whole_path, equals_path)
    alone = F.col("asks") & F.when(F.col("kept"), F.col("doc_id") == F.col("high")).otherwise(F.col("doc_id") == F.col("low"))
    asked = told.where(alone).select("hash", "side").distinct()
    deputies = told.withColumn("asks", alone).where("asks or doc_id = low").join(asked, ["hash", "side"], "left_semi")
    beside, beside_path = _read_beside(source, deputies.select(*END_NAMES), scratch, _each_beside, CONTEXT)
    found = longest_matches(beside, scratch)
    found = found.unionByName(told.where(F.col("asks") & ~alone).select(*PLACE, "level", "byte"))
    first = F.when(F.col("side") == 0, F.col("first") - F.col("level")).otherwise(F.col("first") + SEED_WORDS)
    out = scratch.keep(found.select("doc_id", "digest", first.alias("first"), F.col("level").alias("words"), F.col("byte").alias("start"), F.col("byte").alias("end"), F.col("hash").alias("component"), "kept"))
    scratch.drop(told_path, beside_path)
    return out


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SETS of some spans (hashes, starts, ends: bytes) of each text."""
    hasher = WordHasher(lower=True)
    for batch in batches:
        for first, texts in text_groups(batch.column("text"), 1 << 19):
            rows = batch.slice(first, len(texts))
            text = np.repeat(np.arange(len(texts)), pc.list_value_length(rows.column("starts")).to_numpy(zero_copy_only=False))
            names, starts, ends = (rows.column(c).flatten() for c in ("hashes", "starts", "ends"))
            spans = [texts[k][a:b] for k, a, b in zip(text.tolist(), starts.to_pylist(), ends.to_pylist(), strict=True)]
            for at, own in byte_batches(spans, 1 << 20):
                of, token = shingles(hasher.words(own), len(own), SHINGLE)
                cuts = np.searchsorted(of, np.arange(len(own) + 1))
                sets = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(token.view(np.int64)))
                columns = [names.slice(at, len(own)), pa.array(np.diff(cuts)), sets, pa.array([x.decode("utf-8", "replace") for x in own])]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SETS.split(", ")])
    give_back()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of paragraphs whose exact sets are similar enough."""
    side = lambda x: sets.select(F.col("hash").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= THRESHOLD_PERCENT * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def near_paragraphs(source: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of hashes of lines and segments that link to a different one: band, join by band, verify, connect."""
    banded = found.where(F.col("kind") != SEED).select("hash", "doc_id", "digest", "start", "end", F.explode("bands").alias("band"))
    # 31 bits of the hashes tell whether a band has different ones.
    some_bits = F.shiftright("hash", 33).cast("int")
    collides = banded.groupBy("band").agg(F.min(some_bits).alias("low"), F.max(some_bits).alias("high")).where("low <> high").select("band")
    collides, collides_path = scratch.table(collides)
    at = F.min(F.struct("doc_id", "digest", "start", "end")).alias("at")
    members, members_path = scratch.table(perhaps_in(banded, "band", collides).join(collides, "band").groupBy("band", "hash").agg(at, F.count("*").alias("copies")))
    places = members.groupBy("hash").agg(F.min("at").alias("at")).select("hash", "at.*")
    places = places.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("hash", "start", "end")).alias("p"))
    places, places_path = scratch.table(places.select("doc_id", "digest", F.col("p.hash").alias("hashes"), F.col("p.start").alias("starts"), F.col("p.end").alias("ends")))
    texts = perhaps_in(source, "doc_id", places.select("doc_id")).join(places.hint("merge"), ["doc_id", "digest"])
    sets, sets_path = scratch.table(texts.mapInArrow(_shingle_sets, SETS).dropDuplicates(["hash"]))
    scratch.drop(collides_path, places_path)

    heads, heads_path = scratch.table(members.groupBy("band").agg(F.max_by("hash", F.struct("copies", "hash")).alias("head")))
    others = members.select("band", "hash").join(heads, "band").where("hash <> head")
    links, links_path = scratch.table(_alike(others.select(F.col("head").alias("a"), F.col("hash").alias("b")).distinct(), sets))
    joined = connected_components(links, scratch)
    # Members of a band other than its head that are of different components have not been compared.
    placed, placed_path = scratch.table(others.join(joined, F.col("hash") == F.col("node"), "left").select("band", "hash", F.coalesce("component", "hash").alias("comp")))
    open_bands = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    rest, rest_path = scratch.table(sets.join(placed.join(open_bands, "band").select("hash").distinct(), "hash").select(F.col("hash").alias("doc_id"), "text"))
    if not rest.isEmpty():
        more = near_duplicates(rest, scratch).where("component_id <> doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
        joined = connected_components(stars(joined).unionByName(more), scratch)
    scratch.drop(members_path, sets_path, heads_path, links_path, placed_path, rest_path)
    return joined


def repeated_passages(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", least_words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, digest, first, n_words, start, end, component_id, kept): passages that repeat across documents.

    first and n_words count words; start and end are bytes of the UTF-8 text.
    component_id is the smallest paragraph component in the passage; kept is
    true in the document where it stays.
    """
    source = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("text"))
    found, found_path = scratch.table(source.mapInArrow(_paragraphs(*tuned_bands()), OCCURRENCES))
    repeats = found.groupBy("hash").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin < last").drop("last")
    repeats, repeats_path = scratch.table(repeats)
    near = near_paragraphs(source, found, scratch)
    place = ["doc_id", "digest", "first", "words", "start", "end"]
    found = found.select("kind", "hash", *place)
    equal = perhaps_in(found, "hash", repeats.select("hash")).join(repeats, "hash").withColumn("component", F.col("hash"))
    alike, alike_path = scratch.table(perhaps_in(found.where(F.col("kind") != SEED), "hash", near.select("node")).join(near, F.col("hash") == F.col("node")).drop("node"))
    origins = alike.groupBy("component").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last")).where("origin < last").drop("last")
    # Written, so that the join reads it from its own exchange and AQE can split a component of many copies.
    origins, origins_path = scratch.table(origins)
    hits = equal.unionByName(alike.join(origins, "component"))
    hits = hits.select(*place, "component", (F.col("doc_id") == F.col("origin")).alias("kept"), (F.col("kind") == SEED).alias("seed"))
    hits, hits_path = scratch.table(hits.distinct())
    scratch.drop(found_path, repeats_path, alike_path, origins_path)
    seeds = hits.where("seed").select("doc_id", "digest", "first", F.col("component").alias("hash"), "kept")
    hits = hits.drop("seed").unionByName(extensions(source, seeds, scratch))
    # Neighbouring occurrences of the same verdict make a passage: gaps and islands in each document.
    before = Window.partitionBy("doc_id", "digest", "kept").orderBy("first", "words").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "digest", "kept").orderBy("first", "words").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.max(F.col("first") + F.col("words")).over(before)
    islands = hits.withColumn("_new", (F.coalesce(reached, F.lit(-(2**30))) + JOIN_GAP < F.col("first")).cast("int"))
    islands = islands.withColumn("_island", F.sum("_new").over(upto))
    passages = islands.groupBy("doc_id", "digest", "kept", "_island").agg(
        F.min("first").alias("first"),
        (F.max(F.col("first") + F.col("words")) - F.min("first")).alias("n_words"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("component").alias("component_id"),
    )
    out = passages.where(F.col("n_words") >= least_words).select("doc_id", "digest", "first", "n_words", "start", "end", "component_id", "kept")
    out = scratch.keep(out)
    scratch.drop(hits_path)
    return out


def without_spans(text, spans):
    """`text` without the byte spans of a sorted array of (start, end) structs."""
    raw = text.cast("binary")
    bounds = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    parts = F.zip_with(bounds, stops, lambda a, b: F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))).cast("string"))
    return F.array_join(parts, "")


def drop_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", least_words: int = PASSAGE_WORDS) -> DataFrame:
    """`docs` without its repeated passages; texts without any are untouched. A column n_chars is set to the new length.

    A text is cut only at passages of a row with its id and its digest. Only
    texts whose id may be that of a removed passage meet the passages in a
    shuffle; the others pass by (`split_by_ids`).
    """
    gone = repeated_passages(docs, scratch, key, text, least_words).where(~F.col("kept"))
    spans = gone.groupBy(F.col("doc_id").alias("__cut_id"), F.col("digest").alias("__cut_digest")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    some, rest = split_by_ids(docs, key, gone.select("doc_id"))
    joined = some.join(spans.hint("merge"), (some[key] == spans["__cut_id"]) & (text_digest(some[text]) == spans["__cut_digest"]), "left")
    untouched = spans["__cuts"].isNull()
    new_text = F.when(untouched, some[text]).otherwise(without_spans(some[text], spans["__cuts"]))
    new = {text: new_text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(untouched, some["n_chars"]).otherwise(F.length(new_text).cast(docs.schema["n_chars"].dataType))
    return rest.unionByName(joined.select([new.get(c, some[c]).alias(c) for c in docs.columns]))

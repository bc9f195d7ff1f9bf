"""Exact n-gram Jaccard self-join with prefix filters under several global orders.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two
documents link when their sets' Jaccard similarity is at least 0.8. The result
has a row for each document: its set size and the smallest id it reaches.

Method. If |A| = n, a partner misses at most n - ceil(0.8 n) of A's shingles;
under any one order of all shingles, partners share one of the first
n - ceil(0.8 n) + 1. Three orders are used, all rare shingles first and each
with its own classes of rarity and its own permutation inside a class. A pair
is a candidate if its documents' prefixes under every order share a shingle,
and so many that the rest may make up what a link needs; then the whole sets
are intersected.

1. `_requests` hashes texts, folds equal word sequences together, and sends
   each block's shingles to a counting partition, six bytes a shingle.
2. `_count` finds each shingle's document frequency (up to HOT) and answers the
   blocks that asked, only for shingles that occur in two documents or more.
3. `_prefixes` takes the prefixes. Shingles without an answer are a document's
   own; a document with enough of them can have no partner and is done.
4. Rows of a shingle's posting list meet its most central one (with the least
   rare shingles) first, then in ROUNDS rounds DRAWS of its largest component and
   as many outside it. Links are contracted to components after each round; at last
   all pairs of different components are
   tried, so a group of n near copies costs about n checks, not n * n. Such
   pairs must first pass a bound by sketches of parities, which no link fails.

Scale: shuffles are in proportion to the text and have no hot key: shingles
spread by hash, a shingle frequent inside a block goes as one count, and the
rest of its list is at most HOT entries a block. Counting partitions hold the
shingles of about PART_BYTES of text and grow in number with the input, up to
2**18 of them. Joins are on shingles or rows and may be split by AQE. Nothing
is broadcast or collected but counts.

Exactness: hashes of 54 bits or more are compared, so that two different
shingles of one pair of documents meet with a chance of about
|A| * |B| / 2**54. The order of rows within input partitions must not change
between attempts of a task (tables read from files keep it).

Defined results: null and empty texts, and texts without words, have an empty
set, no links and their own id; texts under five words have their whole
sequence as one shingle; equal texts share a component; rows that share an id
are separate documents, each with its own text's component (nodes are texts,
not ids), and one may go while the other stays; rows with a null id get their set size and a null component, and take no part; an empty table gives an
empty result; columns other than id and text aren't used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import Scratch, connected_components, perhaps_in, split_by_ids, text_digest
from ridgeline.llm.texthash import WordHasher, byte_batches, give_back, mix, shingles, text_groups

WORDS = 5
PERCENT = 80
HOT = 64
BLOCK_SHINGLES = 250_000
PART_BYTES, LEAST_BITS, MOST_BITS = 2 << 20, 3, 18
BLOCK_DOCS = 60_000
NEAREST = 2
ROUNDS, DRAWS = 2, 4
SKETCH_LANES = 8
LOW48 = np.uint64((1 << 48) - 1)

REQUEST = "part int, block long, kind int, idx binary, tokens binary, info binary"
ANSWER = "block long, kind int, idx binary, tokens binary, info binary"
INFO = [("id", "<i8"), ("digest", "<i8"), ("key1", "<i8"), ("key2", "<i8"), ("n", "<i8"), ("sent", "?")]
PREFIXES = "doc_id long, digest long, key1 long, key2 long, n long, row long, odd double, sketch array<long>, shared array<long>, pre1 array<long>, pre2 array<long>, pre3 array<long>"


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _pack48(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


class _Block:
    """Documents of one task, up to a bound of shingles, before they are sent."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.digests: list[int] = []
        self.sizes: list[int] = []
        self.keys: list[bytes] = []
        self.seen: set[bytes] = set()
        self.sent: list[bool] = []
        self.idx: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray, digests: np.ndarray, texts: list[bytes], hasher: WordHasher) -> None:
        words = hasher.words(texts)
        text, token = shingles(words, len(texts), WORDS)
        n = np.bincount(text, minlength=len(texts))
        bounds = np.concatenate(([0], np.cumsum(np.bincount(words.text, minlength=len(texts)))))
        base = len(self.ids)
        fresh = np.zeros(len(texts), bool)
        for k in range(len(texts)):
            key = hashlib.blake2b(words.hash[bounds[k] : bounds[k + 1]].tobytes(), digest_size=16).digest()
            fresh[k] = n[k] > 0 and key not in self.seen
            self.seen.add(key)
            self.keys.append(key)
        self.ids += ids.tolist()
        self.digests += digests.tolist()
        self.sizes += n.tolist()
        self.sent += fresh.tolist()
        take = fresh[text]
        self.idx.append((text[take] + base).astype(np.int64))
        self.tokens.append(token[take])
        self.held += int(take.sum())

    def rows(self, block: int, bits: int) -> pd.DataFrame:
        parts = 1 << bits
        idx = np.concatenate(self.idx) if self.idx else np.zeros(0, np.int64)
        token = np.concatenate(self.tokens) if self.tokens else np.zeros(0, np.uint64)
        self.idx, self.tokens = [], []
        values, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
        hot = counts > HOT
        is_hot = hot[inverse]
        out = []
        part = part_of(token, bits)
        listed = np.flatnonzero(~is_hot)
        listed = listed[np.argsort(part[listed], kind="stable")]
        cuts = np.searchsorted(part[listed], np.arange(parts + 1))
        for p in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = listed[cuts[p] : cuts[p + 1]]
            out.append((int(p), block, 0, idx[own].astype("<u2").tobytes(), _pack48(token[own]), None))
        hot_part = part_of(values[hot], bits)
        for p in np.unique(hot_part):
            own = np.flatnonzero(hot)[hot_part == p]
            out.append((int(p), block, 1, counts[own].astype("<u4").tobytes(), _pack48(values[own]), None))
        info = np.zeros(len(self.ids), INFO)
        info["id"], info["digest"], info["n"], info["sent"] = self.ids, self.digests, self.sizes, self.sent
        keys = np.frombuffer(b"".join(self.keys), "<i8").reshape(-1, 2)
        info["key1"], info["key2"] = keys[:, 0], keys[:, 1]
        out.append((block % parts, block, 2, idx[is_hot].astype("<u2").tobytes(), token_of(token[is_hot], bits).tobytes(), info.tobytes()))
        return pd.DataFrame(out, columns=["part", "block", "kind", "idx", "tokens", "info"])


def part_of(token: np.ndarray, bits: int) -> np.ndarray:
    """The counting partition: the highest bits."""
    return (token >> np.uint64(64 - bits)).astype(np.int64)


def token_of(token: np.ndarray, bits: int) -> np.ndarray:
    """The token as all later steps know it: the 48 bits that are sent, and those that its counting partition tells."""
    return token & (LOW48 | np.uint64(((1 << bits) - 1) << (64 - bits)))


def counting_bits(source: DataFrame) -> int:
    """Counting partitions, as a power of two, for about PART_BYTES of text each."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return min(max((size // PART_BYTES).bit_length(), LEAST_BITS), MOST_BITS)


def _requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 24
        hasher, block, number = WordHasher(lower=True), _Block(), 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("idx", pa.binary()), ("tokens", pa.binary()), ("info", pa.binary())])
        for batch in batches:
            ids, digests = batch.column("doc_id").to_numpy(), batch.column("digest").to_numpy()
            for at, texts in text_groups(batch.column("text"), 1 << 19, 2000):
                block.add(ids[at : at + len(texts)], digests[at : at + len(texts)], texts, hasher)
                if block.held >= BLOCK_SHINGLES or len(block.ids) > BLOCK_DOCS - 2000:
                    yield pa.RecordBatch.from_pandas(block.rows(first + number, bits), schema, preserve_index=False)
                    block, number = _Block(), number + 1
        if block.ids:
            yield pa.RecordBatch.from_pandas(block.rows(first + number, bits), schema, preserve_index=False)
        del block, hasher
        give_back()

    return run


def _count(bits: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(r.block, 2, r.idx, r.tokens, r.info) for r in rows[rows["kind"] == 2].itertuples()]
        listed, summed = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        token = [_unpack48(x) for x in listed["tokens"]]
        sizes = [len(x) for x in token]
        hot_token = [_unpack48(x) for x in summed["tokens"]]
        if token:
            values = np.concatenate([*token, *hot_token])
            weight = np.concatenate([np.ones(sum(sizes), np.int64), *[np.frombuffer(x, "<u4").astype(np.int64) for x in summed["idx"]]])
            del token
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            total = np.minimum(np.add.reduceat(weight[order], begins), HOT)
            level = np.zeros(len(values), np.uint8)
            level[order] = np.repeat(total, np.diff(np.append(begins, len(values))))
            del ranked, order
            at, above = 0, np.uint64(int(key[0]) << (64 - bits))
            for r, size in zip(listed.itertuples(), sizes, strict=True):
                kept = np.flatnonzero(level[at : at + size] >= 2)
                if len(kept):
                    idx = np.frombuffer(r.idx, "<u2")[kept]
                    out.append((r.block, 0, idx.tobytes(), (values[at : at + size][kept] | above).tobytes(), level[at : at + size][kept].tobytes()))
                at += size
        return pd.DataFrame(out, columns=["block", "kind", "idx", "tokens", "info"])

    return run


def _orders(level: np.ndarray, token: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(class, place in class) under each global order; both depend on the shingle alone."""
    return [
        (level, mix(token + np.uint64(0x1234567))),
        (np.log2(np.maximum(level, 1)).astype(np.int64), mix(token ^ np.uint64(0x5DEECE66D5DEECE6))),
        ((level >= 8).astype(np.int64), mix(token * np.uint64(0x9E3779B97F4A7C15))),
    ]


def _sketches(idx: np.ndarray, token: np.ndarray, n_docs: int) -> np.ndarray:
    """SKETCH_LANES numbers of 64 bits for each document: each bit is the parity of its shingles that hash to it."""
    bits = 64 * SKETCH_LANES
    place = (mix(token ^ np.uint64(0x3C79AC492BA7B653)) % np.uint64(bits)).astype(np.int64)
    cells, count = np.unique(idx * bits + place, return_counts=True)
    cells = cells[count % 2 == 1]
    lane = cells >> 6
    begins = np.flatnonzero(np.concatenate((np.ones(min(len(lane), 1), bool), lane[1:] != lane[:-1])))
    out = np.zeros(n_docs * SKETCH_LANES, np.uint64)
    if len(begins):
        out[lane[begins]] = np.bitwise_or.reduceat(np.uint64(1) << (cells & 63).astype(np.uint64), begins)
    return out.view(np.int64).reshape(n_docs, SKETCH_LANES)


def _prefixes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["kind"] == 2].iloc[0]
    info = np.frombuffer(head["info"], INFO)
    answers = rows[rows["kind"] == 0]
    hot_idx, hot_token = np.frombuffer(head["idx"], "<u2"), np.frombuffer(head["tokens"], "<u8")
    idx = np.concatenate([hot_idx, *[np.frombuffer(x, "<u2") for x in answers["idx"]]]).astype(np.int64)
    token = np.concatenate([hot_token, *[np.frombuffer(x, "<u8") for x in answers["tokens"]]]).astype(np.uint64)
    level = np.concatenate([np.full(len(hot_idx), HOT, np.uint8), *[np.frombuffer(x, np.uint8) for x in answers["info"]]]).astype(np.int64)
    n = info["n"].astype(np.int64)
    own = n - np.bincount(idx, minlength=len(n))
    quota = np.where(info["sent"], prefix_size(n) - own, 0)
    # How rare a document's shingles are: close to 0 for the centre of a large group.
    odd = (np.bincount(idx, weights=HOT - level, minlength=len(n)) + own * (HOT - 1)) / np.maximum(n, 1)
    live = quota > 0
    take = live[idx]
    idx, token, level = idx[take], token[take], level[take]
    sketches = _sketches(idx, token, len(n))
    doc, arrays = np.flatnonzero(live), []
    for order in (None, *_orders(level, token)):
        by = np.lexsort((token, idx)) if order is None else np.lexsort((order[1], order[0], idx))
        at = idx[by]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        inside = by if order is None else by[rank < quota[at]]
        bounds = np.searchsorted(idx[inside], np.append(doc, len(n)))
        signed = token[inside].view(np.int64)
        arrays.append([signed[bounds[k] : bounds[k + 1]] for k in range(len(doc))])
    out = pd.DataFrame({"doc_id": info["id"], "digest": info["digest"], "key1": info["key1"], "key2": info["key2"], "n": n})
    out["row"] = (int(key[0]) << 16) + np.arange(len(n))
    out["odd"] = odd
    column = np.full(len(n), None, object)
    for k in doc:
        column[k] = sketches[k]
    out["sketch"] = column
    for name, values in zip(("shared", "pre1", "pre2", "pre3"), arrays, strict=True):
        column = np.full(len(n), None, object)
        for k, value in zip(doc, values, strict=True):
            column[k] = value
        out[name] = column
    return out


def _verified(pairs: DataFrame, active: DataFrame) -> DataFrame:
    """(a, b): the pairs of rows that share prefixes under the other orders and then link."""
    side = lambda x: active.select(*[F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "s", "shared", "pre2", "pre3")])
    both = pairs.join(side("a"), F.col("a") == F.col("row_a")).join(side("b"), F.col("b") == F.col("row_b"))
    both = both.where(_agree("pre2") & _agree("pre3"))
    common = F.size(F.array_intersect("shared_a", "shared_b"))
    return both.where(100 * common >= PERCENT * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def _may_link(n_a, s_a, n_b, s_b):
    """Shared shingles bound the intersection."""
    return (100 + PERCENT) * F.least(s_a, s_b) >= PERCENT * (n_a + n_b)


def _differ():
    """Bits that differ in two documents' sketches: at most as many as shingles that only one of them has, of those in the sketches."""
    differ = F.lit(0)
    for k in range(SKETCH_LANES):
        differ = differ + F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k]))
    return differ


def _near_enough():
    """Whether the sketches of two documents allow a link."""
    return (100 + PERCENT) * (F.col("s_a") + F.col("s_b") - _differ()) >= 2 * PERCENT * (F.col("n_a") + F.col("n_b"))


def _agree(prefix: str):
    """Whether two documents' prefixes under one order allow a link.

    The document whose prefix ends first has all it shares with the other
    either in both prefixes or after its own.
    """
    common = F.size(F.array_intersect(f"{prefix}_a", f"{prefix}_b"))
    after = F.greatest(*[F.col(f"s_{x}") - F.size(f"{prefix}_{x}") for x in "ab"])
    return (common > 0) & ((100 + PERCENT) * (common + after) >= PERCENT * (F.col("n_a") + F.col("n_b")))


def _mixed(placed: DataFrame) -> DataFrame:
    """(token, main): tokens whose rows are of several components, and the largest of these."""
    sizes = placed.groupBy("token", "comp").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"))
    return mixed.where("comps > 1").drop("comps")


def _met(lists: DataFrame) -> DataFrame:
    """(a, b): each row with up to NEAREST of its tokens' most central rows (the least odd ones), those with which it shares most tokens."""
    chosen = lists.groupBy("token").agg(F.min(F.struct("odd", "row", "n", "s")).alias("c"))
    met = lists.join(chosen, "token").where((F.col("row") != F.col("c.row")) & _may_link(F.col("n"), F.col("s"), F.col("c.n"), F.col("c.s")))
    met = met.groupBy("row", F.col("c.row").alias("other")).agg(F.count("*").alias("k"))
    met = met.groupBy("row").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "other")), False), 1, NEAREST).alias("best"))
    return met.select(F.col("row").alias("a"), F.explode("best.other").alias("b"))


def _chosen(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each row with up to NEAREST rows of other components, of those that each of its tokens draws: DRAWS of its largest component and DRAWS outside."""
    fields = ("row", "n", "s", "comp", "sketch")
    draw = lambda k: F.struct(F.xxhash64("row", "token", F.lit(DRAWS * turn + k)).alias("chance"), *fields)
    inside = F.col("comp") == F.col("main")
    drawn = [F.min(F.when(side, draw(k))) for side in (inside, ~inside) for k in range(DRAWS)]
    chosen = members.groupBy("token").agg(F.array(*drawn).alias("drawn"))
    met = members.select("token", *[F.col(c).alias(f"{c}_a") for c in fields]).join(chosen, "token")
    met = met.select(*[f"{c}_a" for c in fields], F.explode("drawn").alias("c"))
    met = met.select(*[f"{c}_a" for c in fields], *[F.col(f"c.{c}").alias(f"{c}_b") for c in fields])
    met = met.where((F.col("comp_a") != F.col("comp_b")) & _may_link(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b")) & _near_enough())
    best = F.slice(F.array_sort(F.collect_set(F.struct(_differ().alias("differ"), "row_b"))), 1, NEAREST)
    return met.groupBy("row_a").agg(best.alias("best")).select(F.col("row_a").alias("a"), F.explode("best.row_b").alias("b"))


def stars(joined: DataFrame) -> DataFrame:
    """Components as links, each to its smallest node: what later links are added to."""
    return joined.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def linked_texts(source: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, member) of rows (doc_id, digest, text) with an id.

    Rows with the same `member` are equal or reach each other by links; component_id is their smallest id.
    """
    bits = counting_bits(source)
    asked = source.mapInArrow(_requests(bits), REQUEST)
    answered = asked.groupBy("part").applyInPandas(_count(bits), ANSWER)
    found, found_path = scratch.table(answered.groupBy("block").applyInPandas(_prefixes, PREFIXES))

    # Equal texts have equal prefixes: one row of each text stands for all, one with prefixes if there is any.
    # Written, so that the joins below read it from its own exchange and AQE can split a key with many copies.
    live = F.min(F.when(F.col("pre1").isNotNull(), F.col("row")))
    classes, classes_path = scratch.table(
        found.where("n > 0").groupBy("key1", "key2").agg(F.min("doc_id").alias("label"), F.coalesce(live, F.min("row")).alias("rep"))
    )
    labelled, labelled_path = scratch.table(
        found.select("doc_id", "digest", "n", "row", "key1", "key2").join(classes, ["key1", "key2"], "left")
        .select("doc_id", "digest", "n", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("label"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("row")).alias("rep"))
    )
    active, active_path = scratch.table(
        found.where("pre1 is not null").join(classes, ["key1", "key2"]).where("row = rep").withColumn("s", F.size("shared").cast("long"))
    )
    scratch.drop(found_path, classes_path)
    lists, lists_path = scratch.table(active.select("row", "n", "s", "odd", F.explode("pre1").alias("token")))

    pairs, pairs_path = scratch.table(_met(lists))
    links, links_path = scratch.table(_verified(pairs, active))
    joined = connected_components(links, scratch)

    def mixed_members() -> tuple[DataFrame, str]:
        placed, placed_path = scratch.table(
            lists.join(joined, lists["row"] == joined["node"], "left").select("row", "n", "s", "token", F.coalesce("component", "row").alias("comp"))
        )
        members, members_path = scratch.table(placed.join(_mixed(placed), "token").join(active.select("row", "sketch"), "row"))
        scratch.drop(placed_path)
        return members, members_path

    members, members_path = mixed_members()
    for turn in range(ROUNDS):
        met, met_path = scratch.table(_verified(_chosen(members, turn), active))
        if met.isEmpty():
            scratch.drop(met_path)
            break
        joined = connected_components(stars(joined).unionByName(met), scratch)
        scratch.drop(met_path, members_path)
        members, members_path = mixed_members()

    # What is left: pairs of different components that share a token. One of the two isn't of the token's largest component.
    prefixed = members.join(active.select("row", "pre1"), "row")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("row", "n", "s", "comp", "pre1", "sketch")]
    left, right = prefixed.where("comp <> main").select("token", *side("a")), prefixed.select("token", *side("b"))
    # Of the tokens that a pair shares, only the first makes it a candidate.
    rest = left.join(right, "token").where(
        (F.col("comp_a") != F.col("comp_b"))
        & _may_link(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b"))
        & _near_enough()
        & (F.col("token") == F.array_min(F.array_intersect("pre1_a", "pre1_b")))
        & _agree("pre1")
    )
    rest = rest.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()
    more, more_path = scratch.table(_verified(rest, active))
    everything = joined if more.isEmpty() else connected_components(stars(joined).unionByName(more), scratch)
    lowest = everything.join(active.select(F.col("row").alias("node"), "label"), "node").groupBy("component").agg(F.min("label").alias("low"))
    named, named_path = scratch.table(everything.join(lowest, "component"))

    out = labelled.join(named, labelled["rep"] == named["node"], "left")
    out = scratch.keep(out.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.coalesce("low", "label").alias("component_id"), F.coalesce("component", "rep").alias("member")))
    scratch.drop(labelled_path, active_path, lists_path, members_path, pairs_path, links_path, named_path, more_path)
    return out


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), text_digest(F.col(text)).alias("digest"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of `docs`."""
    source = _source(docs, key, text)
    out = linked_texts(source.where("doc_id is not null"), scratch).select("doc_id", "n_shingles", "component_id")
    nameless = source.where("doc_id is null").select("doc_id", _set_size()(F.col("text")).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(nameless)


def _set_size():
    def sizes(texts: pd.Series) -> pd.Series:
        hasher, out = WordHasher(lower=True), []
        for _, group in byte_batches(list(texts), 1 << 20):
            out.append(np.bincount(shingles(hasher.words(group), len(group), WORDS)[0], minlength=len(group)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64), dtype="int64")

    sizes.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(sizes, "long")


def one_of_each(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near duplicates in `docs`, and all rows with a null id or without a word.

    The row with the smallest id stays, of several the one with the smallest text
    digest, and of rows with equal id and text any one. What goes is told by id
    and text, so that an unlike row with the same id stays. Only rows whose id
    may be a removed one meet the removed ones in a shuffle (`split_by_ids`).
    """
    linked = linked_texts(_source(docs, key, text).where("doc_id is not null"), scratch).where("n_shingles > 0")
    copies = linked.groupBy("member", "doc_id", "digest").agg(F.count("*").alias("copies"))
    first = copies.groupBy("member").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    stays = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    marks = copies.join(first, "member").where(~stays | (F.col("copies") > 1))
    marks = scratch.keep(marks.select(F.col("doc_id").alias("__marked_id"), F.col("digest").alias("__marked_digest"), stays.alias("__one_stays")))
    meets = lambda rows, told: (rows[key] == told["__marked_id"]) & (text_digest(rows[text]) == told["__marked_digest"])
    some, rest = split_by_ids(docs, key, marks.select("__marked_id"))
    out = rest.unionByName(some.join(marks.hint("merge"), meets(some, marks), "left_anti"))
    repeated = marks.where("__one_stays")
    if repeated.isEmpty():
        return out
    rows = perhaps_in(docs, key, repeated.select("__marked_id"))
    rows = rows.join(repeated.hint("merge"), meets(rows, repeated)).groupBy("__marked_id", "__marked_digest").agg(F.first(F.struct(*[rows[c] for c in docs.columns])).alias("__row"))
    return out.unionByName(rows.select("__row.*"))

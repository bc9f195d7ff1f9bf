"""Corpus operators against brute force, the tokenizer libraries, and edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import (
    bin_packing,
    chat_format,
    ngram_join,
    piece_matching,
    quality_rules,
    shared,
    sharding,
    substring_dedup,
    texthash,
    token_counts,
    token_packing,
    topk_search,
)
from ridgeline.llm.shared import Scratch, connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

rng = np.random.default_rng(5)
VOCAB = [f"w{i}" for i in range(4000)]


def prose(n):
    return " ".join(rng.choice(VOCAB, n))


BASE = prose(120)
PASSAGE = prose(70)
EDGE_ROWS = [
    (1, BASE, "a", 1),
    (2, BASE, "a", 1),
    (2, BASE, "a", 1),
    (3, BASE.upper(), "b", 2),
    (4, BASE + " tail", "b", 2),
    (5, None, "b", None),
    (6, "", None, 0),
    (7, " \t\n ", "c", 3),
    (8, "three words only", "c", 3),
    (9, "Three words only", "c", 3),
    (10, prose(30) + " " + PASSAGE + " " + prose(40), "c", 3),
    (11, prose(55) + " " + PASSAGE + " " + prose(25), "a", 3),
    (12, prose(3000), "a", 3),
    (13, "x" * 3000 + " " + "é" * 3000 + " 日本語 \U0001f389", "a", 3),
    (14, "the " * 200, "d", 3),
    (None, prose(60), "d", 3),
    (None, None, None, None),
]
SCHEMA = "doc_id long, text string, source string, n_chars long"
CLASHING = ["label", "n", "row", "token", "hash", "component", "size", "slot", "shard", "kept", "n_words", "length", "_group", "node", "host", "host_rejected", "n_tokens", "a", "b"]


@pytest.fixture(scope="module")
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA).withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text, lower=False):
    return WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}) if lower else text)


def shingle_set(text):
    own = words(text or "", True)
    if len(own) < 5:
        return frozenset([tuple(own)] if own else [])
    return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4))


def brute_components(rows):
    """{row number: component} for (id, text) rows with an id."""
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * union:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    return [min(groups[root(k)]) for k in range(len(rows))], [len(s) for s in sets]


def test_word_hashes_match_words():
    texts = ["Ab cd\tAB  cd\x0bé", "", "   ", "cd", "x" * 50 + " " + "y" * 70 + " cd"]
    for size in (8, 1 << 20):
        got = texthash.WordHasher(lower=True, slice_bytes=size).words([t.encode() for t in texts])
        flat = [(k, w) for k, t in enumerate(texts) for w in words(t, True)]
        assert got.text.tolist() == [k for k, _ in flat]
        by_hash = collections.defaultdict(set)
        for h, (_, w) in zip(got.hash.tolist(), flat, strict=True):
            by_hash[h].add(w)
        assert all(len(x) == 1 for x in by_hash.values())
        assert len(by_hash) == len({w for _, w in flat})
        assert [texts[k].encode()[a:b].decode().lower() for k, a, b in zip(got.text, got.start, got.end, strict=True)] == [w for _, w in flat]


def test_components(spark, scratch):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (20, 20), (7, 30), (30, 31), (31, 9), (None, 5)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), scratch)
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 7: 7, 30: 7, 31: 7, 9: 7}
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(chain, scratch).collect()} == {0}
    assert connected_components(chain.limit(0), scratch).count() == 0


def test_ngram_join_edges(edge, nothing, scratch):
    got = ngram_join.near_duplicates(edge, scratch).collect()
    named = [(i, t) for i, t, *_ in EDGE_ROWS if i is not None]
    comps, sizes = brute_components(named)
    want = collections.Counter(zip([i for i, _ in named], sizes, comps, strict=True))
    assert collections.Counter((r[0], r[1], r[2]) for r in got if r[0] is not None) == want
    assert sorted(r[1] for r in got if r[0] is None) == [0, 56]
    assert all(r[2] is None for r in got if r[0] is None)
    assert ngram_join.near_duplicates(nothing, scratch).count() == 0


def test_ngram_join_brute_force(spark, scratch):
    """Groups of near copies around the threshold, over several blocks."""
    local, rows = np.random.default_rng(11), []
    for g in range(12):
        base = local.choice(VOCAB, int(local.integers(20, 200))).tolist()
        for _ in range(14):
            own = list(base)
            for at in local.integers(0, len(own), int(local.integers(0, 1 + len(own) // 18))):
                own[at] = str(local.choice(VOCAB))
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    comps, sizes = brute_components(rows)
    want = {i: (n, c) for (i, _), n, c in zip(rows, sizes, comps, strict=True)}
    assert {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(frame, scratch).collect()} == want
    assert 12 < len(set(comps)) < len(rows)
    kept = {r["doc_id"] for r in ngram_join.one_of_each(frame, scratch).collect()}
    assert kept == set(comps)


def test_sketches_bound_differences():
    from ridgeline.llm import ngram_join
    from ridgeline.llm.texthash import mix

    rng = np.random.default_rng(5)
    token = mix(np.arange(4000, dtype=np.uint64))
    sets = [set(rng.choice(4000, size, replace=False).tolist()) for size in (0, 1, 40, 44, 300, 2500)]
    sets += [sets[3] - {min(sets[3])}, sets[4] | {4, 5, 6}]
    idx = np.concatenate([np.full(len(x), k) for k, x in enumerate(sets)]).astype(np.int64)
    found = ngram_join._sketches(idx, token[np.array([y for x in sets for y in sorted(x)], np.int64)], len(sets)).view(np.uint64)
    for a, left in enumerate(sets):
        for b, right in enumerate(sets):
            differ = sum(int(x).bit_count() for x in found[a] ^ found[b])
            assert differ <= len(left ^ right) and differ % 2 == len(left ^ right) % 2
    assert not found[0].any() and found[1].any()


@pytest.mark.parametrize("bits", [1, 8, 1 << 27])
def test_one_of_each_edges(edge, nothing, scratch, monkeypatch, bits):
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    got = ngram_join.one_of_each(edge, scratch)
    assert got.columns == edge.columns
    ids = sorted(r["doc_id"] for r in got.where("doc_id is not null").collect())
    assert ids == [1, 5, 6, 7, 8, 10, 11, 12, 13, 14]
    assert got.where("doc_id is null").count() == 2
    assert ngram_join.one_of_each(nothing, scratch).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 18, 1 << 27])
def test_split_by_ids(spark, monkeypatch, bits):
    """No id is missed at any size of the filter, and a large filter sets the others aside."""
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    docs = spark.range(-3000, 3000).selectExpr("if(id = 0, null, id) as doc_id", "id as size")
    ids = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("x"))
    some, rest = shared.split_by_ids(docs, "doc_id", ids)
    inside, outside = [r["size"] for r in some.collect()], [r["size"] for r in rest.collect()]
    assert sorted(inside + outside) == list(range(-3000, 3000)) and some.columns == docs.columns
    assert {i for i in range(-3000, 3000) if i and i % 7 == 0} <= set(inside)
    assert len(inside) < 900 or bits < 1 << 27
    none, everything = shared.split_by_ids(docs, "doc_id", ids.limit(0))
    assert none.count() == 0 and everything.count() == 6000


def features(text):
    text = text or ""
    own = words(text)
    grams = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    repeated = {i + k for i in range(len(own) - 7) if grams[tuple(own[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_features(edge, docs, nothing, scratch):
    for frame in (edge, docs):
        rows = frame.select("doc_id", "text").collect()
        got = quality_rules.quality_verdicts(frame, scratch).collect()
        want = collections.Counter((r["doc_id"], *features(r["text"])) for r in rows)
        assert collections.Counter((r["doc_id"], *[r[c] for c in quality_rules.FEATURES]) for r in got) == want
        assert all(not r["kept"] for r in got if r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert quality_rules.quality_verdicts(nothing, scratch).count() == 0
    assert quality_rules.keep_good(nothing, scratch).count() == 0


def test_host_verdicts(spark, scratch):
    good, bad = prose(40), "too short"
    rows = [(i, good, f"h{i % 9}") for i in range(180)] + [(1000 + i, bad, "spam") for i in range(60)] + [(2000 + i, good, "spam") for i in range(4)]
    rows += [(3000, good, None), (3001, bad, "tiny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(frame, scratch).collect()}
    assert all(verdict[i] for i in range(180)) and verdict[3000]
    assert not any(verdict[i] for i in range(2000, 2004))  # good texts of a bad host
    kept = {r["doc_id"] for r in quality_rules.keep_good(frame, scratch).collect()}
    assert kept == {i for i, ok in verdict.items() if ok}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the join that shuffles
    assert {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(frame, scratch).collect()} == verdict
    assert {r["doc_id"] for r in quality_rules.keep_good(frame, scratch).collect()} == kept
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_beta_prior():
    assert quality_rules.beta_prior(None, None, None) == (0.5, 0.5)
    alpha, beta = quality_rules.beta_prior(0.2, 0.03, 0.01)
    assert abs(alpha / (alpha + beta) - 0.2) < 1e-12 and abs(alpha + beta - (0.16 / 0.02 - 1)) < 1e-9


RECORDS = [
    ('{"prompt": "p", "completion": "c"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ('{"completion": null, "prompt": "p"}', "prompt_completion", [("user", "p"), ("assistant", "")]),
    ('{"instruction": "i", "input": "x", "output": "o"}', "instruction_input", [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ('{"data": {"prompt": "p", "completion": "c"}}', "nested_prompt", [("user", "p"), ("assistant", "c")]),
    ('{"messages": [{"role": "human", "content": "h"}, {"content": "g", "role": "gpt"}]}', "messages", [("user", "h"), ("assistant", "g")]),
    ('{"conversations": [{"from": null, "value": null}, {"from": "bot", "value": "<turn>\\\\0</turn>"}]}', "conversations", [("user", ""), ("assistant", "<turn>\\0</turn>")]),
    ('{"dialog": {"turns": [{"speaker": "</role>", "utterance": "\\\\\\\\</role>\\\\"}]}}', "dialog", [("</role>", "\\\\</role>\\")]),
    ('{"other": 1}', None, []),
    ('{"id": 5, "messages": [{"role": "user", "content": "h", "name": "x", "weight": 1}], "meta": {"a": [1]}}', "messages", [("user", "h")]),
    ('{"prompt": "p", "completion": "c", "source": "s"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ('{"instruction": "i", "output": "o", "system": "y"}', "instruction_system", [("system", "y"), ("user", "i"), ("assistant", "o")]),
    ('{"prompt": "p", "response": "r", "input": "i", "text": "t"}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ("not json", None, []),
    (None, None, []),
    ('{"messages": []}', None, []),
]


def test_chat_layouts(spark):
    frame = spark.createDataFrame([(k, r) for k, (r, _, _) in enumerate(RECORDS)], "k long, record string").withColumn("extra", F.lit(1))
    out = chat_format.format_chats(frame)
    out = out.withColumns({"back": chat_format.read_back(F.col("formatted")), "loss": chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))})
    for r in out.collect():
        _, layout, turns = RECORDS[r["k"]]
        assert r["layout"] == layout
        assert [tuple(t) for t in r["turns"]] == turns
        assert [tuple(t) for t in r["back"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert r["extra"] == 1
    assert chat_format.format_chats(frame.limit(0)).count() == 0
    assert sum(r["n"] for r in chat_format.unmapped(out).collect()) == sum(x[1] is None for x in RECORDS)


def test_chat_escape_is_reversible(spark):
    alphabet = ["\\", "<turn>", "</turn>", "</role>", "0", "1", "2", "<", "a", "\n", "é"]
    local = np.random.default_rng(3)
    texts = ["".join(local.choice(alphabet, 12)) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select("t", chat_format.unescape(chat_format.escape(F.col("t"))).alias("u"), chat_format.escape(F.col("t")).alias("e")).collect()
    assert all(r["t"] == r["u"] for r in got)
    assert not any(c in r["e"] for r in got for c in chat_format.CONTROLS)


@pytest.mark.parametrize("capacities", [(16,), (16, 32, 64), (10, 100)])
def test_packing(capacities):
    local = np.random.default_rng(1)
    lengths = local.integers(0, max(capacities) + 1, 500)
    which, offset, final = bin_packing.pack(lengths, capacities, 2)
    used = np.bincount(which, weights=lengths).astype(int)
    assert all(u <= c and c in capacities and not any(u <= x < c for x in capacities) for u, c in zip(used, final, strict=True))
    for b in range(len(final)):
        spans = sorted((int(offset[i]), int(offset[i] + lengths[i])) for i in np.flatnonzero(which == b))
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert final.sum() <= 1.25 * lengths.sum() + max(capacities)


def test_packing_against_plain():
    """The mix taken is no dearer than any single size and uses several; each choice follows the plain rule of expected fill."""
    local = np.random.default_rng(12)
    lengths = np.concatenate([local.integers(3500, 8193, 60), local.integers(600, 2000, 300), local.integers(1, 300, 1500)])
    cost = lambda final: sum(bin_packing.bin_cost_of(int(c)) for c in final)
    which, _, final = bin_packing.pack(lengths)
    used = np.bincount(which, weights=lengths).astype(int)
    assert all(min(c for c in bin_packing.CAPACITIES if c >= u) == f for u, f in zip(used, final, strict=True))
    assert len(set(final.tolist())) >= 3
    for one in (8192,):
        _, _, fixed = bin_packing.pack(lengths, (one,))
        assert cost(final) < cost(fixed)
    for size in range(5):  # brute force: every mix by a plain best fit
        for some in __import__("itertools").combinations(bin_packing.CAPACITIES[:-1], size):
            assert cost(final) <= plain_packing(lengths.tolist(), (*some, 8192)) + 1e-6


def plain_packing(lengths, capacities):
    items, bins = sorted(lengths, reverse=True), []
    for at, length in enumerate(items):
        fitting = [b for b in bins if b[0] - b[1] >= length]
        if fitting:
            min(fitting, key=lambda b: b[0] - b[1])[1] += length
            continue
        later, best = items[at + 1 :], None
        for c in (c for c in capacities if c >= length):
            fill, rest, steps = length, list(later), 0
            while rest and steps < bin_packing.LOOKAHEAD:
                if sum(rest) <= c - fill:
                    fill, rest = fill + sum(rest), []
                    break
                rest = [x for x in rest if x <= c - fill]
                if not rest:
                    break
                fill, rest, steps = fill + rest[0], rest[1:], steps + 1
            if rest and steps == bin_packing.LOOKAHEAD:
                fill += min(c - fill, sum(rest))
            score = (bin_packing.bin_cost_of(c) / max(1, fill), c)
            best = min(best or (score, c), (score, c))
        bins.append([best[1], length])
    return sum(bin_packing.bin_cost_of(min(c for c in bin_packing.CAPACITIES if c >= used)) for _, used in bins)


def test_packing_documents(edge, nothing, docs):
    for frame in (edge, docs):
        packed = bin_packing.pack_documents(frame, capacities=(64, 512), group_items=40).collect()
        total = sum(r["length"] for r in packed)
        assert total == sum(len(words(r["text"] or "")) for r in frame.select("text").collect())
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in frame.select("doc_id").collect()}
        pieces = collections.Counter(r["bin_id"] for r in packed)
        assert all(r["bin_used"] <= r["bin_capacity"] for r in packed) and len(pieces) > 0
        whole = collections.Counter((r["doc_id"], r["n_pieces"]) for r in packed if r["piece"] == 0)
        assert sum(n * k for (_, n), k in whole.items()) == len(packed)
    assert bin_packing.pack_documents(nothing).count() == 0


def test_sharding(edge, nothing, docs, scratch):
    for frame in (edge, docs):
        placed, version = sharding.shard_documents(frame, 4, scratch, scratch.path(), slots=64)
        rows, texts = placed.collect(), collections.Counter()
        for r in frame.select("doc_id", "text").collect():
            raw = (r["text"] or "").encode()
            texts[(r["doc_id"], len(raw) + 8, zlib.crc32(raw))] += 1
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
        for shard in range(4):
            slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
            assert slots == list(range(len(slots)))
    sizes = collections.Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= max(r["size"] for r in rows)
    assert version >= 1 and sharding.shard_documents(nothing, 4, scratch, scratch.path())[0].count() == 0


def test_slot_map_versions(spark, tmp_path):
    local = np.random.default_rng(2)
    loads = [(s, int(local.integers(100, 2000)), 3) for s in range(256)]
    first = sharding.first_map(loads, 8, 256)
    grown = sharding.edited_map(first, loads, 9)
    moved = [s for s in first if first[s] != grown[s]]
    assert moved and all(grown[s] == 8 for s in moved)
    total = collections.Counter()
    for s, b, _ in loads:
        total[grown[s]] += b
    assert max(total.values()) <= 1.15 * min(total.values())
    shrunk = sharding.edited_map(grown, loads, 8)
    assert set(shrunk.values()) == set(range(8))
    assert sharding.edited_map(first, loads, 8) == first
    for version, slot_map in ((1, first), (2, grown)):
        sharding.save_map(sharding.map_frame(spark, version, slot_map, loads), str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 1) == first and sharding.load_map(spark, str(tmp_path), 2) == grown
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(sharding.map_frame(spark, 2, first, loads), str(tmp_path))


def test_stored_map_is_edited(spark, docs, scratch):
    """A second run with more shards edits the stored map: rows move into the new shard only, and sizes are near equal again."""
    folder = scratch.path()
    before, one = sharding.shard_documents(docs, 4, scratch, folder, slots=256)
    before = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in before.collect()}
    again, same = sharding.shard_documents(docs, 4, scratch, folder, slots=256)
    assert same == one and {(r["doc_id"], r["text_crc32"]): r["shard"] for r in again.collect()} == before
    grown, two = sharding.shard_documents(docs, 5, scratch, folder, slots=256)
    rows = grown.collect()
    assert two == one + 1 and sharding.newest_version(spark, folder) == two
    assert all(r["shard"] in (4, before[(r["doc_id"], r["text_crc32"])]) for r in rows) and any(r["shard"] == 4 for r in rows)


def test_write_shards(spark, docs, tmp_path, scratch):
    folder = scratch.path()
    placed, version = sharding.shard_documents(docs, 5, scratch, folder, slots=64)
    frame = spark.read.parquet(f"{folder}/version={version}")
    sharding.write_shards(docs, frame, str(tmp_path / "out"), slots=64)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["_shard"]) for r in got.collect()} == {(r["doc_id"], r["shard"]) for r in placed.collect()}


def test_token_packing(edge, nothing, docs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for frame in (edge, docs):
        packed = token_packing.pack_tokens(frame.coalesce(1), RANKS, public_tokenizers.PATTERN, width=256)  # one task: each leaves a row partly filled
        rows = packed.collect()
        assert all(len(r["ids"]) == 512 and r["cu_seqlens"][-1] == r["n_ids"] <= 256 and r["position_resets"] == r["cu_seqlens"][:-1] for r in rows)
        pieces = collections.defaultdict(list)
        for r in token_packing.unpacked(packed).collect():
            pieces[r["doc_id"]].append((r["piece_start"], r["ids"]))
        for name in {r["doc_id"] for r in frame.select("doc_id").collect()} - {None, 2}:
            text = next(r["text"] for r in frame.select("doc_id", "text").collect() if r["doc_id"] == name) or ""
            assert [i for _, ids in sorted(pieces[name]) for i in ids] == encoding.encode_ordinary(text)
        total = sum(r["n_ids"] for r in rows)
        assert len(rows) * 256 - total <= 0.05 * total + 256
    assert token_packing.pack_tokens(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_packing.positions([0, 3, 5], 8).tolist() == [0, 1, 2, 0, 1, 0, 1, 2]


def test_wide_ids(spark, tmp_path):
    """A vocabulary over 65,536 ids takes four bytes, and two are refused."""
    import base64

    ranks = [bytes([i]) for i in range(256)]
    lines = [f"{base64.b64encode(b).decode()} {i}" for i, b in enumerate(ranks)] + [f"{base64.b64encode(b'zq').decode()} 70000"]
    path = tmp_path / "large.tiktoken"
    path.write_text("\n".join(lines))
    frame = spark.createDataFrame([(1, "zq a zq")], "doc_id long, text string")
    packed = token_packing.pack_tokens(frame, str(path), r"zq|.", width=8)
    assert token_packing.unpacked(packed, wide=True).first()["ids"] == [70000, 32, 97, 32, 70000]
    with pytest.raises(ValueError, match="two bytes"):
        token_packing.pack_tokens(frame, str(path), r"zq|.", wide=False)


def test_room_tree():
    local = np.random.default_rng(8)
    tree, held = token_packing.RoomTree(50), collections.Counter()
    for step in range(3000):
        size = int(local.integers(1, 51))
        if local.random() < 0.5:
            tree.add(size, step)
            held[size] += 1
        else:
            want = min((r for r in held if r >= size and held[r]), default=None)
            got = tree.take(size)
            assert (got[0] if got else None) == want
            if got:
                held[want] -= 1


def brute_top(vectors, queries, k):
    out = []
    for q, qv in queries:
        scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in vectors if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_topk(spark, monkeypatch, scratch):
    local = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(local.normal(size=int(local.choice([5, 12, 19]))))]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(50)]
    rows.append((901, []))
    odd = [(900, None), (902, [1.0, None]), (903, [float("nan")]), (904, [float("inf")]), (None, [1.0])]
    whole = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    monkeypatch.setattr(topk_search, "CANDIDATES", 64)
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    got = sorted(map(tuple, topk_search.top_k(frame, F.col("vec_id") % 50 == 0, scratch, 5).collect()))
    assert got == brute_top(whole, [x for x in whole if x[0] % 50 == 0], 5)
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 50 == 0, scratch).count() == 0
    few = frame.where("vec_id < 3")
    assert topk_search.top_k(few, F.col("vec_id") == 0, scratch).count() == 2
    assert topk_search.top_k(few, F.lit(False), scratch).count() == 0
    big = spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 0.5]), (2, [1e6, 9.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in topk_search.top_k(big, F.col("vec_id") == 0, scratch).orderBy("rank").collect()] == [1, 2]
    huge = spark.createDataFrame([(0, [3e30]), (4, [1e30]), (1, [2e30]), (2, [-1e30]), (3, [-2e30]), (5, [1e-30])], "vec_id long, embedding array<double>").repartition(6)
    got = [(r["vec_id"], r["score"]) for r in topk_search.top_k(huge, F.col("vec_id") == 0, scratch).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (5, 0), (2, -(2**63)), (3, -(2**63))]  # exact ranks, scores at the bounds


def runs(texts, size):
    """Ids of texts that share a run of `size` words with another id."""
    seen = collections.defaultdict(set)
    for i, text in texts:
        own = words(text or "", True)
        for k in range(len(own) - size + 1):
            seen[tuple(own[k : k + size])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_substring_dedup(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = substring_dedup.repeated_passages(docs, scratch).collect()
    ids = {r["doc_id"] for r in found}
    assert runs(texts, 51) <= ids
    assert ids <= runs(texts, 12)
    raw = {i: (t or "").encode() for i, t in texts}
    assert all(len(words(raw[r["doc_id"]][r["start"] : r["end"]].decode())) == r["n_words"] for r in found)
    cut = substring_dedup.drop_repeats(docs, scratch)
    after = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert len(after) == len(texts) and not runs(after, 51)
    gone = {r["doc_id"] for r in found if not r["kept"]}
    before = dict(texts)
    assert all(t == before[i] for i, t in after if i not in gone)


@pytest.mark.parametrize("bits", [8, 1 << 27])
def test_substring_edges(edge, nothing, scratch, monkeypatch, bits):
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    found = substring_dedup.repeated_passages(edge, scratch).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 10, 11}
    cut = substring_dedup.drop_repeats(edge, scratch)
    assert cut.columns == edge.columns and cut.count() == len(EDGE_ROWS)
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[1]["text"] == BASE and by_id[5]["text"] is None and by_id[14]["text"] == "the " * 200
    assert len(words(by_id[11]["text"])) < 80 + 25 and by_id[11]["n_chars"] == len(by_id[11]["text"])
    assert substring_dedup.drop_repeats(nothing, scratch).count() == 0


@pytest.mark.parametrize("vocabulary", [300, 2000])
def test_substring_whole_passages(spark, scratch, vocabulary):
    """Passages of 51 to 60 words inside lines go whole, up to the last equal word."""
    rng = np.random.default_rng(vocabulary)
    share = 1 / np.arange(1, vocabulary + 1)
    draw = lambda n: [f"w{k}" for k in rng.choice(vocabulary, n, p=share / share.sum())]
    texts, runs_of = {}, {}
    for case in range(60):
        passage, whole = draw(51 + case % 10), []
        for copy in range(2):
            before, after = draw(15 + int(rng.integers(40))), draw(15 + int(rng.integers(40)))
            texts[2 * case + copy] = before + passage + after
            whole.append((before, after))
        (b0, a0), (b1, a1) = whole
        left = next((k for k, (x, y) in enumerate(zip(b0[::-1], b1[::-1])) if x != y), min(len(b0), len(b1)))
        right = next((k for k, (x, y) in enumerate(zip(a0, a1)) if x != y), min(len(a0), len(a1)))
        runs_of[2 * case + 1] = (len(b1) - left, len(b1) + len(passage) + right)
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    found = [r for r in substring_dedup.repeated_passages(frame, scratch).collect() if not r.kept]
    for doc, (first, after) in runs_of.items():
        assert any(r.doc_id == doc and r.first <= first and r.first + r.n_words >= after for r in found), doc
        at = [r for r in found if r.doc_id == doc and r.first == first and r.first + r.n_words == after]
        for r in at:
            raw = " ".join(texts[doc]).encode()
            assert raw[r.start : r.end].decode().split() == texts[doc][first:after]
    # A segment over an end may be alike enough to go as a whole.
    exact = sum((r.first, r.first + r.n_words) == runs_of.get(r.doc_id) for r in found)
    assert exact >= 50


@pytest.mark.parametrize("chunk_rows", [1, 3, 16_384])
def test_longest_matches_brute_force(spark, scratch, chunk_rows):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        words = rng.integers(0, 2, int(rng.integers(0, 8))).astype(np.uint64)
        kept = bool(k % 7 == 0)
        doc = 0 if kept else int(rng.integers(0, 90))  # kept rows are in the first document
        rows.append((doc, k, 0, int(k % 2), kept, int(rng.integers(0, 3)), doc, doc, bool(k % 3), words.tobytes(), np.arange(len(words), dtype=np.int32).tobytes()))
    ends = spark.createDataFrame(rows, substring_dedup.CONTEXT).repartition(4)
    found = {r.digest: (r.level, r.byte) for r in substring_dedup.longest_matches(ends, scratch, chunk_rows).collect()}
    expected = {}
    for doc, k, _, side, kept, value, _, _, asks, words, _ in rows:
        partners = [r[9] for r in rows if (r[3], r[5]) == (side, value) and (r[0] > doc if kept else r[0] < doc)]
        level = max((sum(words[: 8 * n] == other[: 8 * n] for n in range(1, min(len(words), len(other)) // 8 + 1)) for other in partners), default=0)
        if asks and level:
            expected[k] = (level, level - 1)
    assert found == expected


def test_near_lines_meet(spark, scratch):
    line = prose(60).split()
    other = [*line[:30], "changed", *line[31:]]
    frame = spark.createDataFrame([(1, prose(30) + "\n" + " ".join(line)), (2, " ".join(other) + "\n" + prose(30))], "doc_id long, text string")
    found = substring_dedup.repeated_passages(frame, scratch).collect()
    assert {(r["doc_id"], r["kept"]) for r in found} >= {(1, True), (2, False)}
    assert max(r["n_words"] for r in found if r["doc_id"] == 2) == 60


def test_bands_are_tuned():
    bands, rows = substring_dedup.tuned_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= substring_dedup.MOST_HASHES
    with pytest.raises(ValueError, match="banding"):
        substring_dedup.tuned_bands(0.1, 0.9999, 4)


def test_shared_ids_lose_nothing(spark, scratch):
    """Unlike texts under one id: the copy goes or is cut, the other text stays whole. Repeated rows leave one."""
    own, copied = prose(200), prose(200)
    rows = [(1, copied, "a"), (2, copied, "b"), (2, own, "c"), (3, own + " tail", "d"), (1, copied, "e"), (4, prose(80), "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(frame, scratch).collect()]
    assert sorted(kept) == sorted([(1, copied), (2, own), (4, rows[5][1])])
    components = collections.Counter((r[0], r[2]) for r in ngram_join.near_duplicates(frame, scratch).collect())
    assert components == {(1, 1): 2, (2, 1): 1, (2, 2): 1, (3, 2): 1, (4, 4): 1}
    cut = {(r["doc_id"], r["source"]): r["text"] for r in substring_dedup.drop_repeats(frame, scratch).collect()}
    assert cut[(2, "c")] == own and cut[(1, "a")] == cut[(1, "e")] == copied
    assert not words(cut[(2, "b")]) and words(cut[(3, "d")]) in ([], ["tail"])  # the last segment is alike enough to go


def test_pipeline_on_small_tables(spark, tmp_path):
    """Each stage's decision shows in the result: rejected, near copies gone, a repeated passage cut, the rest packed whole."""
    import corpus_pipeline

    base, passage = prose(200).split(), prose(70)
    near = [*base[:100], "changed", *base[101:]]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, "short"), (5, f"{prose(90)} {passage} {prose(90)}"), (6, f"{prose(80)} {passage} {prose(85)}"), (7, None)]
    rows = [(i, t, "en", "a", len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "some/documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    total = collections.Counter()
    for r in packed:
        total[r["doc_id"]] += r["length"]
        assert r["bin_used"] <= r["bin_capacity"]
    assert set(total) == {1, 5, 6} and total[1] == 200 and total[5] == 250 and 80 <= total[6] <= 165
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def paragraphs(text):
    """Lines and segments of a text, by a plain rule."""
    own = words(text, True)
    hashes = texthash.WordHasher(lower=True).words([text.encode()]).hash
    local = texthash.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)) | np.uint64(1)
    reach, begins = substring_dedup.REACH, [0]
    for k in range(len(own) - 1):
        if all(local[k] > local[j] for j in range(max(0, k - reach), min(len(own), k + reach + 1)) if j != k):
            begins.append(k + 1)
    spans = [own[a:b] for a, b in zip(begins, [*begins[1:], len(own)], strict=True) if b - a >= 5]
    return spans + [w for line in text.split("\n") if len(w := words(line, True)) >= substring_dedup.LINE_WORDS]


def test_near_paragraph_recall(spark, scratch):
    """Components against brute-force Jaccard over all lines and over all segments: at least 0.9 of the links, and no false one."""
    local, texts = np.random.default_rng(21), []
    for group in range(10):
        base = local.choice(VOCAB, 400)
        for copy in range(6):
            own = base.copy()
            own[local.integers(0, 400, int(local.integers(0, 9)))] = local.choice(VOCAB)
            wrap = int(local.integers(9, 60))
            texts.append("\n".join(" ".join(own[k : k + wrap]) for k in range(0, 400, wrap)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    source = frame.withColumn("digest", shared.text_digest(F.col("text")))
    found = scratch.keep(source.mapInArrow(substring_dedup._paragraphs(*substring_dedup.tuned_bands()), substring_dedup.OCCURRENCES))
    comp = {r["node"]: r["component"] for r in substring_dedup.near_paragraphs(source, found, scratch).collect()}
    by_place, kinds = collections.defaultdict(set), collections.defaultdict(set)
    for r in found.where(F.col("kind") != substring_dedup.SEED).collect():
        kinds[r["hash"]].add(r["kind"])
        by_place[r["doc_id"]].add((r["hash"], " ".join(words(texts[r["doc_id"]], True)[r["first"] : r["first"] + r["words"]])))
    assert all({t for _, t in by_place[k]} == {" ".join(p) for p in paragraphs(texts[k])} for k in by_place)
    unlike = {t: h for own in by_place.values() for h, t in own}
    sets = {h: shingle_set(t) for t, h in unlike.items()}
    names, links = sorted(sets), 0
    hit = 0
    for i, a in enumerate(names):
        for b in names[:i]:
            common = len(sets[a] & sets[b])
            if kinds[a] & kinds[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                links += 1
                hit += comp.get(a, a) == comp.get(b, b)
    assert links > 100 and hit >= 0.97 * links
    joined = collections.defaultdict(set)
    for node, c in comp.items():
        joined[c].add(node)
    assert all(any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for b in own if b != a) for own in joined.values() for a in own)


def samples():
    local = np.random.default_rng(6)
    alphabet = list("abcde éñ日本🎉\t\n<s>▁ ▁  .,0") + ["the", " the", "ing ", "</s>", "<0x0A>", "　"]
    texts = ["".join(local.choice(alphabet, int(n))) for n in local.integers(0, 60, 400)]
    return [*texts, "", " ", "  ", "a" * 700, "日本" * 300, "ab" * 5000, "ab " * 500, "x\0y", *[t for _, t, *_ in EDGE_ROWS if t]]


def test_pieces_equal_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = piece_matching.Encoder(piece_matching.read_vocabulary(open(MODEL, "rb").read()))
    texts = samples()
    flat, sizes = encoder.encode(texts)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    for k, text in enumerate(texts):
        own = flat[bounds[k] : bounds[k + 1]]
        assert own.tolist() == model.encode(text), text
        # A word mark in a text can't be told from a space.
        assert encoder.decode(own) == model.decode(own.tolist()) == text.replace(piece_matching.MARK, " ")


def test_long_parts_in_windows(monkeypatch):
    """A text without spaces, over several index windows."""
    import sentencepiece

    monkeypatch.setattr(piece_matching, "INDEX_CHARS", 50)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = piece_matching.Encoder(piece_matching.read_vocabulary(open(MODEL, "rb").read()))
    local = np.random.default_rng(2)
    for text in ("".join(local.choice(list("theinganderst"), 700)), "international" * 40):
        assert encoder.encode([text])[0].tolist() == model.encode(text)


def test_unigram_relaxation():
    """Best path against all segmentations."""
    pieces = ["a", "b", "ab", "ba", "aba", "bb"]
    scores = np.array([-1.0, -1.5, -2.2, -2.0, -2.9, -3.5])
    vocabulary = piece_matching.Vocabulary(pieces, scores, np.ones(6, bool), {}, 0, True)
    encoder = piece_matching.Encoder(vocabulary)
    for text in ("a", "abab", "bbaab", "abba" * 3):
        best = {0: 0.0}
        for k in range(1, len(text) + 1):
            best[k] = max(best[k - len(p)] + s for p, s in zip(pieces, scores, strict=True) if text[:k].endswith(p))
        ids, _ = encoder._encode([text])
        assert "".join(pieces[i] for i in ids) == text
        assert abs(scores[ids].sum() - best[len(text)]) < 1e-9


def test_sentencepiece_frames(edge, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = piece_matching.decode(piece_matching.encode(edge.select("doc_id", "text"), MODEL), MODEL).collect()
    assert all(r["ids"] == model.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") for r in got)
    trip = piece_matching.round_trip(edge, MODEL)
    assert all(r["round_trip"] and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in trip.collect())
    assert piece_matching.round_trip(nothing, MODEL).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_token_counts(edge, nothing, name):
    path = public_tokenizers.path(name)
    raw = open(path, "rb").read()
    lengths = token_counts.length_encoder(path.rpartition(".")[2], raw)
    got = token_counts.count_tokens(edge, path)
    assert set(got.columns) == set(edge.columns)
    assert all(r["n_tokens"] == lengths([r["text"] or ""])[0] for r in got.collect())
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_safe_split_adds_up():
    import sentencepiece

    raw = open(MODEL, "rb").read()
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for size in (3, 10, 50):
        lengths = token_counts.length_encoder("model", raw, size)
        texts = samples()
        assert lengths(texts) == [len(model.encode(t)) for t in texts]

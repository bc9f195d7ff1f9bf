"""Quality rules with host-level verdicts.

Each document is held against base rules on its whole text. Failures are
counted by host, each host's failure rate is shrunk towards the corpus with an
empirical beta prior (moments of the hosts' rates, less their binomial noise),
and hosts whose shrunk rate is over a threshold lose all their documents.

Scale: one Arrow pass over the texts makes five numbers a document; counts by
host combine on the map side, so a host with a third of all rows costs no more
than another. The prior is two numbers. Rejected hosts are joined back in one
plan at every size: Catalyst broadcasts them where their measured size allows,
else AQE splits a host with many rows.

Defined results: null text is empty and fails the word rule; documents without
a host get no host verdict; equal rows count one by one; an empty table gives
an empty result; columns other than those used are passed through, and the
columns made here replace those of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texthash import SPACE, WordHasher, give_back, text_groups, windows

LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
MOST_HOST_RATE = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"


def _by_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def text_features(texts: list[bytes], hasher: WordHasher) -> dict[str, np.ndarray]:
    """The five numbers of each text."""
    n = len(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
    words = hasher.words(texts)
    found = windows(words.hash, WINDOW)
    at = np.flatnonzero(words.text[: len(found)] == words.text[WINDOW - 1 :]) if len(found) else np.zeros(0, np.int64)
    order = at[np.lexsort((found[at], words.text[at]))]
    same = (found[order[1:]] == found[order[:-1]]) & (words.text[order[1:]] == words.text[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    depth = np.zeros(len(words.hash) + 1, np.int64)
    depth[order[twice]] += 1
    depth[order[twice] + WINDOW] -= 1
    covered = np.cumsum(depth[:-1]) > 0
    lines = [[line for line in text.split(b"\n") if line.strip(_BLANK)] for text in texts]
    return {
        "n_words": np.bincount(words.text, minlength=n),
        "word_chars": _by_text(((raw & 0xC0) != 0x80) & ~SPACE[raw], bounds),
        "n_symbols": _by_text(_SYMBOL[raw], bounds),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": np.bincount(words.text[covered], minlength=n),
    }


def feature_column(text: Column) -> Column:
    """A struct of FEATURES, by one Arrow function."""

    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher(lower=False)
        for texts in batches:
            parts = [text_features(group, hasher) for _, group in text_groups(texts, 1 << 19)]
            columns = [pa.array(np.concatenate([x[name] for x in parts] or [np.zeros(0, np.int64)]).astype(np.int64)) for name in FEATURES]
            yield pa.StructArray.from_arrays(columns, FEATURES)
        give_back()

    features.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(features, ", ".join(f"{x} long" for x in FEATURES))(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with FEATURES and base_failed."""
    out = docs.withColumn("__features", feature_column(F.col(text)))
    out = out.withColumns({x: F.col("__features")[x] for x in FEATURES}).drop("__features")
    return out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))


def host_counts(rated: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed): one row a host."""
    known = rated.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    return known.agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))


def host_rates(counts: DataFrame) -> DataFrame:
    """`counts`, which are read twice, with shrunk_rate."""
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread, noise = counts.agg(F.avg(rate), F.var_samp(rate), F.avg(rate * (1 - rate) / F.col("n_docs"))).first()
    alpha, beta = beta_prior(mean, spread, noise)
    return counts.withColumn("shrunk_rate", (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)))


def beta_prior(mean: float | None, spread: float | None, noise: float | None) -> tuple[float, float]:
    """Beta parameters whose mean and variance fit the hosts' rates. Few or equal hosts give the strongest prior."""
    if mean is None:
        return 0.5, 0.5
    between = max((spread or 0.0) - (noise or 0.0), 0.0)
    strength = min(max(mean * (1 - mean) / between - 1, LEAST_STRENGTH), MOST_STRENGTH) if between > 0 else MOST_STRENGTH
    return mean * strength, (1 - mean) * strength


def rejected_hosts(rates: DataFrame, most_rate: float = MOST_HOST_RATE) -> DataFrame:
    return rates.where(F.col("shrunk_rate") > most_rate).select(F.col("host").alias("__rejected_host"))


def host_verdicts(docs: DataFrame, rates: DataFrame, host: str = "source", most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """`docs` with host_rejected, false for documents without a host."""
    bad = rejected_hosts(rates, most_rate)
    joined = docs.join(bad, docs[host] == bad["__rejected_host"], "left")
    return joined.withColumn("host_rejected", F.col("__rejected_host").isNotNull()).drop("__rejected_host")


def quality_verdicts(docs: DataFrame, scratch, host: str = "source", text: str = "text", most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """doc_id, host, FEATURES, base_failed and kept; texts are read once and only their numbers stored."""
    rated = scratch.keep(base_rules(docs.select("doc_id", F.col(host).alias("source"), F.col(text).alias("text"))).drop("text"))
    rates = host_rates(scratch.keep(host_counts(rated)))
    out = host_verdicts(rated, rates, most_rate=most_rate)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, scratch, host: str = "source", text: str = "text", most_rate: float = MOST_HOST_RATE) -> DataFrame:
    """The rows of `docs` that pass, with its own columns. The rules run again on the texts, which is cheaper than a shuffle of them."""
    rates = host_rates(scratch.keep(host_counts(base_rules(docs.select(F.col(host).alias("source"), F.col(text).alias("text"))))))
    rated = docs.withColumn("__features", feature_column(F.col(text)))
    rated = rated.where(~base_failed(F.col("__features.n_words"), F.col("__features.n_repeat_words"))).select(docs.columns)
    bad = rejected_hosts(rates, most_rate)
    return rated.join(bad, rated[host] == bad["__rejected_host"], "left_anti")

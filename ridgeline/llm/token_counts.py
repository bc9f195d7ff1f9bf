"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes, not rows. A text over `split_bytes` is cut at
safe boundaries, where no token can span the cut, so that counts add up to
those of the whole text:

* SentencePiece (.model): a space after a non-space character is dropped, as
  each part gets the word mark that stands for it. Used only if the model adds
  that mark, keeps white space, and has no piece with a mark after another
  character; else texts stay whole.
* Tokenizers (.json) and tiktoken ranks (.tiktoken): texts stay whole.

Scale: one Arrow pass and no shuffle; a task holds one Arrow batch, BATCH_BYTES
of encoded text and the vocabulary, and copies or hot sources cost what any row
does. A very long text of the other two kinds is one call to its library.

Defined results: null and empty texts have no bytes and no tokens; rows with
equal ids or texts are counted one by one; extra columns are passed through;
`n_tokens` replaces a column of that name.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.texthash import byte_batches

BATCH_BYTES = 1 << 20
SPLIT_BYTES = 1 << 18
MARK = "▁"


def safe_sentencepiece(model) -> bool:
    """Whether a space after another character is a boundary that no token spans."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        return False
    if any(MARK in model.id_to_piece(i) and model.get_score(i) == 0 for i in range(model.get_piece_size())):
        return False  # may be matched before all others
    one, two = model.encode("a", out_type=str), model.encode("a  a", out_type=str)
    return "".join(one) == f"{MARK}a" and "".join(two) == f"{MARK}a{MARK}{MARK}a"


def safe_parts(text: str, size: int) -> list[str]:
    """`text` cut before spaces that follow another character, at about `size` characters; those spaces are dropped."""
    parts, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut >= len(text) - 1:
                cut = -1
                break
            if cut > at and text[cut - 1] not in (" ", MARK):
                break
            cut += 1
        if cut < 0:
            break
        parts.append(text[at:cut])
        at = cut + 1
    return [*parts, text[at:]]


def length_encoder(kind: str, raw: bytes, split_bytes: int = SPLIT_BYTES) -> Callable[[list[str]], list[int]]:
    """Texts to token counts, for a vocabulary file's bytes and suffix."""
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        safe = safe_sentencepiece(model)

        def lengths(texts: list[str]) -> list[int]:
            parts = [safe_parts(text, split_bytes) if safe and len(text) > split_bytes else [text] for text in texts]
            flat = iter(map(len, model.encode([x for part in parts for x in part], num_threads=1)))
            return [sum(next(flat) for _ in part) for part in parts]

        return lengths
    if kind == "json":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(raw.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if kind == "tiktoken":
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    raise ValueError(f"unknown vocabulary file kind {kind!r}")


def token_length(spark: SparkSession, vocabulary: str, batch_bytes: int = BATCH_BYTES) -> Callable[[Column], Column]:
    """An Arrow function from text to token count. The file (a few MB) is read here and broadcast, so executors need no copy."""
    with open(vocabulary, "rb") as file:
        model = spark.sparkContext.broadcast((vocabulary.rpartition(".")[2], file.read()))

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = length_encoder(*model.value)
        for texts in batches:
            out: list[int] = []
            for _, group in byte_batches(list(texts), batch_bytes):
                out += lengths([x.decode("utf-8", "replace") for x in group])
            yield pd.Series(out, dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "long")


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens`."""
    return docs.withColumn("n_tokens", token_length(docs.sparkSession, vocabulary)(F.col(text)))

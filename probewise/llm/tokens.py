"""Token counts by a whole-token shortcut.

A SentencePiece BPE text can be cut before every run of spaces that follows
another character, as long as no piece of the vocabulary holds a space behind
another character: no merge reaches over the cut. Each such pre-token is
encoded alone. Once per model, the vocabulary strings that encode alone as one
token are proven by encoding each; a pre-token among them counts one without
any merging. The rest is encoded once per batch and remembered up to a bound.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import query, read

#: Counts of merged pre-tokens that a worker remembers at most.
MEMORY = 200_000
MARK = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def splits_at_spaces(pieces: list[str], normalised) -> bool:
    """Whether pre-tokens are independent: no inner space in a piece, and texts are taken as they are."""
    inner = any(MARK in piece.lstrip(MARK) for piece in pieces)
    probe = "a  b\tÅﬁ éé "
    return not inner and normalised(probe) == MARK + probe.replace(" ", MARK)


def whole_tokens(model) -> dict[str, int]:
    """Pre-tokens (without their first space) that encode alone as one token."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return {word: 1 for word, ids in zip(words, model.encode(words, num_threads=1)) if len(ids) == 1}


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the space it starts with.

    Equal to cutting ``" " + text`` before every run of spaces. A run of spaces
    keeps all but one of them in front of its word; a last word "" stands for a
    single space at the end.
    """
    words = text.split(" ")
    if "" not in words:
        return words
    out, spaces = [], 0
    for word in words[:-1]:
        if word:
            out.append(" " * spaces + word)
            spaces = 0
        else:
            spaces += 1
    out.append(" " * spaces + words[-1])
    return out


def counter(path: str, memory: int = MEMORY):
    """``texts -> counts`` for one worker, with its own model and memory."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if not splits_at_spaces(pieces, model.normalize):
        return lambda texts: [len(ids) for ids in model.encode(list(texts), num_threads=1)]
    single = whole_tokens(model)
    # a lone space is a piece of its own, but an empty text has no tokens
    single[""] = 1
    merged: dict[str, int] = {}

    def count(texts) -> list[int]:
        # the mark itself stands for a space, in texts too
        split = [pre_tokens(text.replace(MARK, " ")) if text else [] for text in texts]
        if len(merged) > memory:
            merged.clear()
        todo = {word for words in split for word in words} - single.keys() - merged.keys()
        new = list(todo)
        found = dict(zip(new, map(len, model.encode(new, num_threads=1))))
        known = {**merged, **found, **single} if len(texts) > 50 else None
        out = []
        for words in split:
            if known is None:
                out.append(sum(single.get(w) or found.get(w) or merged[w] for w in words))
            else:
                out.append(sum(map(known.__getitem__, words)))
        if len(found) <= memory:
            merged.update(found)
        return out

    return count


def token_counts(path: str):
    """A column function: text to its number of tokens."""

    @F.pandas_udf("long")
    def of(batches: pd.Series) -> pd.Series:
        import public_tokenizers

        # Python workers are used again: the model is loaded once in each
        counters = public_tokenizers.__dict__.setdefault("_counters", {})
        if path not in counters:
            counters[path] = counter(path)
        return pd.Series(counters[path](batches.tolist()), dtype="int64")

    return of


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for each row, as the tokenizer library counts.

    Null texts count as empty: no bytes, no tokens. Rows are independent, so
    repeated rows and keys give as many rows, and no rows give none. Only the
    key and the text are read.
    """
    full = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(key), F.octet_length(full).cast("long").alias("n_bytes"), token_counts(path)(full).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(MODEL))

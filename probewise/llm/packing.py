"""Packing of token pieces into sequences by minimum bin slack.

How pieces fill sequences depends on their lengths alone, and there are no
more lengths than tokens in a sequence. So the pieces are counted by length,
which leaves a table of bounded size, and the bins are planned on it: the
longest length left opens a bin, a bitset holds every sum that the remaining
lengths can reach, and the largest one that fits, the bin of least slack, is
taken out of the counts, as often as the counts allow. Every step uses up a
length, so the plan is short whatever the number of documents. Pieces get their
rank among those of their length in a hashed order, cut into buckets, and a
rank's place in the plan is its place in a sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import mixed_order, query, read, running_total
from probewise.llm.tokens import tokenizer_path
from probewise.session import durable

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Words whose ids a worker remembers at most.
MEMORY = 300_000
#: The splitting by which words between white space don't touch each other, in any text of ``PLAIN``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters and signs: no composition changes them, and each has one lower-case letter.
PLAIN = r"[\t\n\x0b\x0c\r\x20-\x84\x85-\u012f\u0131-\u024f]*"
#: Signs that often follow a word.
SIGNS = ".,;:!?#*$%&|<>)"
# the characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_FORMS = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}


def encoder(path: str, memory: int = MEMORY):
    """``texts -> ids`` (little-endian 32-bit, as bytes) for one worker.

    The tokenizer lowers texts and cuts them at white space and between letters,
    digits and signs, so the ids of a text are those of its words in a row, and
    a word is encoded once and remembered. A text with characters beyond Latin,
    or with a special token's string, and any text for another tokenizer goes to
    the library whole.
    """
    import os
    import re
    from struct import pack as packed

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    plain = re.compile(PLAIN).fullmatch
    cut = str(library.pre_tokenizer).replace("\\\\", "\\")
    by_word = SPLIT in cut and "ByteLevel(add_prefix_space=False" in cut and "Lowercase" in str(library.normalizer)
    special = [token.content for token in library.get_added_tokens_decoder().values()]
    known: dict[str, bytes] = {}

    def whole(texts: list[str]) -> list[bytes]:
        return [packed(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def token(part: str) -> bytes:
        """The ids of letters only, or of signs only: one piece that the model merges."""
        if part not in known:
            form = part if part.isascii() else "".join(map(BYTE_FORMS.__getitem__, part.encode()))
            ids = [t.id for t in library.model.tokenize(form)]
            known[part] = packed(f"<{len(ids)}I", *ids)
        return known[part]

    def learn(words: set[str]) -> None:
        other = []
        for word in words:
            letters = word.rstrip(SIGNS)
            if letters.isalpha():
                known[word] = token(letters) + token(word[len(letters) :]) if letters != word else token(word)
            else:
                other.append(word)
        known.update(zip(other, whole(other)))

    def ids(texts: list[str]) -> list[bytes]:
        split = [t.lower().split() if by_word and plain(t) and not any(s in t for s in special) else None for t in texts]
        if len(known) > memory:
            known.clear()
        learn(set().union(*filter(None, split)) - known.keys())
        get = known.__getitem__
        return [whole([t])[0] if words is None else b"".join(map(get, words)) for t, words in zip(texts, split)]

    return ids


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian 32-bit) of every row.

    A document is its ids and an end id; null and empty texts are the end id
    alone. Only documents above ``capacity`` are cut. Repeated rows give their
    pieces again, no rows give none, other columns are not read.
    """
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        # Python workers are used again: the tokenizer is loaded once in each
        encoders = public_tokenizers.__dict__.setdefault("_encoders", {})
        if path not in encoders:
            encoders[path] = encoder(path)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                rows = []
                for name, ids in zip(part["doc_id"], encoders[path](part["text"].tolist())):
                    data = ids + END_ID.to_bytes(4, "little")
                    for piece, at_byte in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at_byte : at_byte + 4 * capacity]
                        row = (None if pd.isna(name) else int(name), piece, at_byte // 4, len(own) // 4, zlib.crc32(own))
                        rows.append((*row, own) if with_ids else row)
                table = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                table["doc_id"] = table["doc_id"].astype("Int64")
                yield table

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInPandas(cut, fields)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, with how often each, of the largest sum up to ``room``.

    Bit ``s`` of the set says that the lengths so far can sum to ``s``; long
    lengths come first, and the search ends once ``room`` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(bins, [(length, times), ...])``: the content of equal bins, all pieces used."""
    left, plan = {length: n for length, n in counts.items() if n}, []
    while left:
        first = max(left)
        rest = left | {first: left[first] - 1}
        content = dict(fullest({k: n for k, n in rest.items() if n}, capacity - first))
        content[first] = content.get(first, 0) + 1
        bins = min(left[length] // times for length, times in content.items())
        plan.append((bins, sorted(content.items(), reverse=True)))
        for length, times in content.items():
            left[length] -= bins * times
            if not left[length]:
                del left[length]
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """The plan by length and rank: runs of ranks, with their first bin and offset."""
    rows, ranks, first_bin = [], {}, 0
    for bins, content in plan:
        offset = 0
        for length, times in content:
            rank = ranks.get(length, 0)
            rows.append((length, rank, times, first_bin, offset))
            ranks[length] = rank + bins * times
            offset += length * times
        first_bin += bins
    columns = zip(*sorted(rows)) if rows else [[]] * 5
    return {name: np.array(c, np.int64) for name, c in zip(("length", "rank", "times", "bin", "offset"), columns)}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no length may exceed ``capacity`` or be null.

    ``pieces`` is read three times, so pass a saved table. At most ``capacity``
    counts reach the driver, and a plan of a few numbers per length goes back.
    Rows equal in ``order`` are placed in any order.
    """
    counts = {row[0]: row[1] for row in pieces.groupBy(length).count().collect()}
    table = slots(plan_bins(counts, capacity), capacity)
    hashed = pieces.withColumn("_h", mixed_order(*[F.col(c) for c in order])).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(hashed, [length], "_h", order, "_one", "_rank", sum(counts.values())).drop("_h", "_one")

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        # ranks stay below 2**50 and lengths below 2**13
        keys = (table["length"] << 50) + table["rank"]
        own, rank = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        at = np.searchsorted(keys, (own << 50) + rank, "right") - 1
        turn = rank - table["rank"][at]
        return pd.DataFrame(
            {"sequence_id": table["bin"][at] + turn // table["times"][at], "offset": table["offset"][at] + turn % table["times"][at] * own}
        )

    placed = ranked.withColumn("_place", place(length, "_rank"))
    return placed.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed pieces (with their ``ids``) put together; at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("_parts"))
    # binary values are joined as hexadecimal text, the one form that a list of them joins in
    return joined.select("sequence_id", F.unhex(F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(durable(token_pieces(docs, path, capacity)), capacity)


@query("op1_pack_documents")
def op1_pack_documents(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))

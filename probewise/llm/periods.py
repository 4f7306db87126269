"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period ``q`` that holds it at least
``EXPONENT`` times and that no neighbouring word extends. Periods below ``FIRST``
are read off the shifted text directly. For the others there is a scale
``size`` for every power of two, and a period ``q`` belongs to the scale with
``size <= q < 2 * size``.

A place is chosen at a scale if the smallest hash of the ``size``-word strings
that begin in the ``size + 1`` places from it on stands at the first or the last
of them. Whether it is chosen depends on its next ``2 * size`` words alone, so
equal contexts are chosen alike. Strings that lie in a run of a period of a
quarter of the scale or less are left out of the choice: there all hashes
repeat, and their runs are known from the smaller scales. Everywhere else a
place is chosen in any ``size`` of them, so a run of period ``q`` has two chosen
places ``q`` apart, with equal contexts and none of that context between them.
Neighbouring places of equal context are thus all that has to be tried; each is
extended word by word, so a hash proposes and never decides.

Texts are worked on in the batches that Spark hands out, joined with a separator
that equals nothing. The working memory is about ten numbers of eight bytes for
each word of the longest text, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probewise.llm.common import WORD_PATTERN, query, read

EXPONENT = 4
MIN_LENGTH = 6
#: Periods below it are found by comparing the text with itself shifted, the smallest scale is equal to it.
FIRST = 4
#: Words that are worked on together, about; a longer text is worked on alone.
TOGETHER = 1 << 18
#: Bytes of a text that are split at a time.
SPLIT_BYTES = 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")
NEVER = np.uint64(2**64 - 1)
#: Odd multipliers of the hash.
LEFT, RIGHT, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)

RUNS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
)


def word_numbers(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The number of every word of a text; new words are added to ``known``."""
    parts, at = [np.empty(0, np.int64)], 0
    while at < len(data):
        found = SPACE.search(data, at + SPLIT_BYTES)
        end = found.start() if found else len(data)
        parts.append(np.array([known.setdefault(word, len(known)) for word in data[at:end].split()], np.int64))
        at = end
    return np.concatenate(parts)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of pairs."""
    x = left * LEFT + right * RIGHT
    x ^= x >> np.uint64(29)
    x *= SPREAD
    x ^= x >> np.uint64(32)
    return x


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` neighbours: minima from both ends of blocks of that size."""
    n = len(values)
    blocks = np.full(-(-n // size) * size, NEVER)
    blocks[:n] = values
    blocks = blocks.reshape(-1, size)
    first = np.minimum.accumulate(blocks, axis=1).ravel()
    last = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(last[: n - size + 1], first[size - 1 : n])


def chosen_places(hashes: np.ndarray, size: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set of a scale; ``hashes`` are of ``size`` words from each place on."""
    ranked = np.where(periodic, NEVER, hashes)
    # size + 1 neighbours are two windows of size
    least = window_minima(ranked, size)
    least = np.minimum(least[:-1], least[1:])
    either = (ranked[: len(least)] == least) | (ranked[size : size + len(least)] == least)
    return np.flatnonzero(either & (least != NEVER))


def inside(stretches: set[tuple[int, int, int]], size: int, begin: int, n: int) -> np.ndarray:
    """Places whose next ``size`` words lie in a stretch of a period of at most a quarter of them."""
    steps = np.zeros(n + 1, np.int32)
    for start, end, period in stretches:
        # a stretch reaches over no separator, so it begins behind ``begin`` or ends before it
        if period * EXPONENT <= size <= end - start and start >= begin:
            steps[start - begin] += 1
            steps[end - begin - size + 1] -= 1
    return np.cumsum(steps[:-1]) > 0


def proposals(places: np.ndarray, contexts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """``place, period`` of neighbouring places of equal context; those that touch are proposed once."""
    order = np.lexsort((places, contexts))
    places, contexts = places[order], contexts[order]
    gap = places[1:] - places[:-1]
    near = np.flatnonzero((contexts[1:] == contexts[:-1]) & (gap >= size) & (gap < 2 * size))
    start, period = places[near], gap[near]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] > start[:-1] + 2 * size)
    return list(zip(start[new].tolist(), period[new].tolist()))


def extended(text: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``place`` whose words ``period`` apart are the same."""
    high, most, step = place, len(text) - period, 16
    while high < most:
        stop = min(high + step, most)
        differ = np.flatnonzero(text[high:stop] != text[high + period : stop + period])
        if len(differ):
            high += int(differ[0])
            break
        high, step = stop, 2 * step
    low, step = place, 16
    while low > 0:
        stop = max(low - step, 0)
        differ = np.flatnonzero(text[stop:low] != text[stop + period : low + period])
        if len(differ):
            low = stop + int(differ[-1]) + 1
            break
        low, step = stop, 2 * step
    return low, high + period


def short_periods(text: np.ndarray) -> set[tuple[int, int, int]]:
    """Stretches ``(start, end, period)`` of the periods below ``FIRST``."""
    found = set()
    for period in range(1, FIRST):
        same = np.zeros(max(len(text) - period, 0) + 2, np.int8)
        same[1:-1] = text[:-period] == text[period:]
        steps = np.diff(same)
        starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        for start, end in zip(starts.tolist(), ends.tolist()):
            # a smaller period divides this one, so it is one
            if end - start >= (EXPONENT - 1) * period and (period == 1 or (text[start : start + period] != text[start]).any()):
                found.add((start, end + period, period))
    return found


def stretches_of(text: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int, int]]:
    """All maximal stretches ``(start, end, period)`` that hold their smallest period ``EXPONENT`` times.

    ``text`` is texts of ``sizes`` numbers, shortest first, with a number that
    occurs once behind each.
    """
    found = short_periods(text)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    hashes = mixed(text.astype(np.uint64), text.astype(np.uint64))
    size, begin = 1, 0
    while True:
        # texts that are too short for a period of this scale are left behind
        short = int(np.searchsorted(sizes, EXPONENT * size))
        hashes, begin = hashes[begins[short] - begin :], int(begins[short])
        if len(hashes) <= 2 * size:
            return found
        doubled = mixed(hashes[:-size], hashes[size:])
        if size >= FIRST:
            places = chosen_places(hashes, size, inside(found, size, begin, len(hashes)))
            places = places[places < len(doubled)]
            for place, period in proposals(places, doubled[places], size):
                start, end = extended(text, place + begin, period)
                if end - start >= EXPONENT * period:
                    found.add((start, end, period))
        hashes, size = doubled, 2 * size


def runs_of(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """The runs ``[start, length, period]`` of every text, by start and period."""
    sizes = np.array([len(text) for text in texts], np.int64)
    order = np.argsort(sizes, kind="stable")
    pieces = [part for no, i in enumerate(order) for part in (texts[i], [-1 - no])]
    found = stretches_of(np.concatenate([np.empty(0, np.int64), *pieces]).astype(np.int64), sizes[order])
    rows = np.array(sorted((s, p, e) for s, e, p in found if e - s >= min_length), np.int64).reshape(-1, 3)
    begins = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    owner = np.searchsorted(begins, rows[:, 0], "right") - 1
    out = [np.empty((0, 3), np.int64)] * len(texts)
    for no in np.unique(owner).tolist():
        start, period, end = rows[owner == no].T
        out[order[no]] = np.column_stack([start - begins[no], end - start, period])
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Places that no run holds behind its first period."""
    steps = np.zeros(n + 1, np.int32)
    for start, length, period in runs.tolist():
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.flatnonzero(np.cumsum(steps[:-1]) == 0)


def grouped(texts: list[np.ndarray], most: int = TOGETHER) -> Iterator[list[int]]:
    """Numbers of texts that are worked on together, texts of like length beside each other."""
    group, words = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if group and words + len(texts[i]) > most:
            yield group
            group, words = [], 0
        group.append(i)
        words += len(texts[i])
    if group:
        yield group


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``runs`` and the text without repeats, ``collapsed``.

    ``runs`` has ``start``, ``length`` and ``period`` in words, by start and
    period. In ``collapsed`` the words that a run holds behind its first period
    are left out, the others are joined by one space. A null or empty text has
    no words, no runs and an empty ``collapsed``; repeated rows and null keys
    are rows like others, no rows give no rows, and other columns are not read.
    """
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", RUNS),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[bytes, int] = {}
            numbers = [word_numbers(t.as_buffer().to_pybytes(), known) for t in batch.column(1)]
            names, runs = list(known), [None] * len(numbers)
            for group in grouped(numbers):
                for i, found in zip(group, runs_of([numbers[i] for i in group], min_length)):
                    runs[i] = found
            collapsed = (
                b" ".join([names[x] for x in ids[kept_words(len(ids), found)].tolist()]) for ids, found in zip(numbers, runs)
            )
            parts = np.concatenate([np.empty((0, 3), np.int64), *runs])
            entries = pa.StructArray.from_arrays([pa.array(column) for column in parts.T], ["start", "length", "period"])
            ends = np.concatenate([[0], np.cumsum([len(found) for found in runs])]).astype(np.int32)
            columns = [
                batch.column(0),
                pa.array([len(ids) for ids in numbers], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
                pa.array([c.decode("utf-8", "replace") for c in collapsed], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(find, schema)


def with_repeats(text: Column, key: Column) -> Column:
    """The text, in every tenth document with its end replaced by repeats of the words from some place on.

    Of the documents whose ``h = crc32(key)`` ends in 0, words from ``a`` on are
    words ``a`` to ``a + p - 1`` again and again, where ``g = h div 10``,
    ``a = g mod n`` and ``p = 1 + (n - a) div (3 + g mod 8)``.
    """
    h = F.crc32(key.cast("string"))

    def repeated(words: Column) -> Column:
        n = F.size(words)
        g = F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        # bound by one-element arrays, so that each is computed once a text
        return F.flatten(
            F.transform(
                F.array(F.struct(a.alias("a"), p.alias("p"))),
                lambda s: F.transform(
                    F.sequence(F.lit(0), n - 1),
                    lambda i: F.get(words, F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i).cast("int")),
                ),
            )
        )

    words = F.transform(
        F.array(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))),
        lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(F.lit("")),
    )
    return F.when(h % 10 == 0, F.get(words, F.lit(0))).otherwise(text)


# crc32 of a decimal number, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, i: xor(t >> 1, (t & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""


@query(
    "op11_periodic_runs",
    f"""
    WITH given AS (
        SELECT doc_id, {CRC32.format("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ), planned AS (
        SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS m FROM given
    ), texts AS (
        SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
            w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + m)) ELSE i END]) END AS w
        FROM planned
    ), words AS (
        SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS pos FROM texts
    ), equal AS (
        SELECT a.doc_id, b.pos - a.pos AS period, a.pos
        FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.pos > a.pos AND 4 * (b.pos - a.pos) <= a.n
    ), stretches AS (
        SELECT doc_id, period, min(pos) AS start, count(*) + period AS length
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, period ORDER BY pos) AS island FROM equal)
        GROUP BY doc_id, period, island HAVING count(*) >= 3 * period AND count(*) + period >= 6
    ), runs AS (
        SELECT * FROM stretches s WHERE NOT EXISTS (
            SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.period < s.period AND s.period % t.period = 0
                AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
    ), listed AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
               min(struct_pack(l := -length, s := start, p := period)) AS longest
        FROM runs GROUP BY doc_id
    ), dropped AS (
        SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS pos FROM runs
    ), kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, pos) GROUP BY doc_id
    )
    SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, longest.s AS start, -longest.l AS length, longest.p AS period,
           (1000 * -longest.l) // longest.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
           sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op11_periodic_runs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs)
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.n").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.floor(1000 * F.col("_best.n") / -F.col("_best.p")).alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )

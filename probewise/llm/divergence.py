"""Quality rules by distribution divergence.

Each document has a histogram of character classes and one of common words. The
common words of a language are those in most of its documents, and the mean
histograms of its documents are its reference; both come from the table, for
every language with enough documents. A document whose histograms lie further
than a limit from those of every language, by Jensen-Shannon distance, is not
written like any of them. Short documents say too little and are left alone,
and so are documents of a language without a reference.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probewise.llm.common import SPACES, WORD_PATTERN, query, read
from probewise.session import durable

CLASSES = ("lower", "upper", "accented", "digit", "space", "line", "point", "mark", "symbol", "other")
SYMBOLS = "#*$%&|<>"
#: Signs that may follow a word.
ENDS = ".,;:?"
MIN_WORDS = 40
#: A language has a reference if it has this many long enough documents, and this share of them.
MIN_DOCS, MIN_SHARE = 20, 1 / 250
#: Common words of a language, and letters of one at most.
COMMON_WORDS, LETTERS = 24, 32
#: Numbers of dense histograms that a task holds at once.
HELD = 1 << 21
#: Largest distances (0 to 1) from the nearest language, for a text of endless length.
CLASS_LIMIT, WORD_LIMIT = 0.15, 0.33
#: What chance adds to them: this over the square root of the number of words.
CHANCE = 0.8


def class_table() -> np.ndarray:
    """Code point to class, for the first 0x250 of them."""
    table = np.full(0x250, CLASSES.index("other"), np.int64)
    for point in range(0x250):
        char = chr(point)
        if char.isalpha():
            kind = "accented" if point > 127 else "upper" if char.isupper() else "lower"
        elif char.isdigit():
            kind = "digit"
        elif char == "\n":
            kind = "line"
        elif char in SPACES or point == 0xA0:
            kind = "space"
        elif char in ".,;:?'\"-()":
            kind = "point"
        elif char == "!":
            kind = "mark"
        else:
            kind = "symbol" if point > 32 else "other"
        table[point] = CLASSES.index(kind)
    return table


def repeated_words(words: Sequence[str], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    window = ids[:n]
    for shift in range(1, width):
        # exact: pairs of numbers of the windows so far and the next word
        window = np.unique(window * len(numbers) + ids[shift : shift + n], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


class References(NamedTuple):
    """The common words of all languages, and by language both mean histograms in one row."""

    words: list[str]
    means: dict[str, np.ndarray]


def common_words(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE
) -> dict[str, list[str]]:
    """By language, the words in most of its long enough documents; ties go to the smaller word.

    All documents count. Documents with a word are counted batch by batch, then
    by language and word. What reaches the driver are ``COMMON_WORDS`` words of
    ``1 / min_share`` languages at most.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: defaultdict[str, Counter] = defaultdict(Counter)
            for name, body in zip(frame["lang"], frame["text"]):
                words = body.lower().split()
                if len(words) >= min_words:
                    plain = {w.rstrip(ENDS) for w in set(words)}
                    found[name].update(w for w in plain if w.isalpha() and len(w) <= LETTERS)
                    found[name][""] += 1
            for name, counts in found.items():
                yield pd.DataFrame({"lang": name, "word": list(counts), "n": list(counts.values())})

    texts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = texts.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = durable(counted.where(F.col("n") >= min_docs))
    sizes = counted.where("word = ''")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    languages = [r["lang"] for r in sizes.where(F.col("n") >= total * min_share).select("lang").collect()]
    by_share = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    ranked = counted.where(F.col("lang").isin(languages) & (F.col("word") != "")).withColumn("place", F.row_number().over(by_share))
    out: dict[str, list[str]] = {name: [] for name in sorted(languages)}
    for r in ranked.where(F.col("place") <= COMMON_WORDS).collect():
        out[r["lang"]].append(r["word"])
    return out


def measures(common: Sequence[str]):
    """A column function: text to the base counts and both histograms.

    ``classes`` is the one of character classes; ``places`` and ``times`` tell
    which of the common words a text has how often, and ``others`` counts its
    other words.
    """
    import re

    word = re.compile(WORD_PATTERN)
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

    @F.pandas_udf(f"{kinds}, classes array<int>, places array<int>, times array<int>, others long")
    def of(texts: pd.Series) -> pd.DataFrame:
        table, places = class_table(), {w: i for i, w in enumerate(common)}
        rows = []
        for text in texts:
            words = word.findall(text)
            lines = [line for line in text.split("\n") if line.strip(SPACES)]
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            known = points[points < 0x250]
            classes = np.bincount(table[known], minlength=len(CLASSES))
            classes[-1] += len(points) - len(known)
            plain = [w.rstrip(ENDS) for w in text.lower().split()]
            found = Counter(places[w] for w in plain if w in places)
            rows.append(
                (
                    len(words),
                    sum(map(len, words)),
                    sum(map(text.count, SYMBOLS)),
                    len(lines) - len(set(lines)),
                    repeated_words(words),
                    classes.astype(np.int32),
                    np.fromiter(found, np.int32, len(found)),
                    np.fromiter(found.values(), np.int32, len(found)),
                    len(plain) - sum(found.values()),
                )
            )
        return pd.DataFrame(rows, columns=[kind.split()[0] for kind in kinds.split(", ")] + ["classes", "places", "times", "others"])

    return of


#: Columns of the histograms.
HISTOGRAMS = ("classes", "places", "times", "others")


def dense(frame: pd.DataFrame, n_common: int) -> np.ndarray:
    """The histograms of a batch as one matrix: character classes, common words, other words."""
    out = np.zeros((len(frame), len(CLASSES) + n_common + 1))
    out[:, : len(CLASSES)] = np.stack(frame["classes"].to_numpy())
    out[:, -1] = frame["others"]
    rows = np.repeat(np.arange(len(frame)), [len(p) for p in frame["places"]])
    out[rows, len(CLASSES) + np.concatenate(frame["places"].to_numpy()).astype(np.int64)] = np.concatenate(frame["times"].to_numpy())
    return out


def slices(n: int, n_common: int) -> Iterator[slice]:
    """Ranges of rows whose dense histograms are held at once."""
    step = max(1, HELD // (len(CLASSES) + n_common + 1))
    return (slice(at, at + step) for at in range(0, n, step))


def shares(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both histograms of a batch as shares, zero where a document has nothing."""
    parts = counts[:, : len(CLASSES)], counts[:, len(CLASSES) :]
    return tuple(p / np.maximum(p.sum(axis=1, keepdims=True), 1) for p in parts)


def distance(rows: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of each row from the reference."""
    middle = (rows + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(rows > 0, rows * np.log2(rows / middle), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / middle), 0).sum(axis=1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def references_of(measured: DataFrame, words: Sequence[str], languages: Sequence[str], min_words: int = MIN_WORDS) -> References:
    """Mean histograms of the languages, over all their documents that are long enough.

    Batches are summed in the tasks; what reaches the driver is one number for
    each of these languages and histogram places.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby("lang"):
                both = sum(np.hstack(shares(dense(part.iloc[rows], len(words)))).sum(axis=0) for rows in slices(len(part), len(words)))
                yield pd.DataFrame({"lang": name, "place": range(len(both)), "total": both, "n": len(part)})

    long_enough = measured.where(F.col("lang").isin(list(languages)) & (F.col("n_words") >= min_words)).select("lang", *HISTOGRAMS)
    totals = long_enough.mapInPandas(sums, "lang string, place int, total double, n long").groupBy("lang", "place").agg((F.sum("total") / F.sum("n")).alias("mean"))
    means: dict[str, np.ndarray] = {}
    for row in totals.collect():
        means.setdefault(row["lang"], np.zeros(len(CLASSES) + len(words) + 1))[row["place"]] = row["mean"]
    return References(list(words), means)


def nearest_language(references: References, min_words: int = MIN_WORDS):
    """A column function: language, number of words and histograms to the distances from the nearest reference.

    Both are null for a text that is too short, and for a language without a reference.
    """
    words, means = references
    tables = [(r[: len(CLASSES)], r[len(CLASSES) :]) for _, r in sorted(means.items())]

    @F.pandas_udf("class_distance double, word_distance double")
    def of(lang: pd.Series, n_words: pd.Series, classes: pd.Series, places: pd.Series, times: pd.Series, others: pd.Series) -> pd.DataFrame:
        out = np.full((len(lang), 2), np.nan)
        compared = np.flatnonzero((lang.isna() | lang.isin(list(means))) & (n_words >= min_words))
        frame = pd.DataFrame(dict(zip(HISTOGRAMS, (classes, places, times, others))))
        for rows in slices(len(compared) if tables else 0, len(words)):
            at = compared[rows]
            by_kind = shares(dense(frame.iloc[at], len(words)))
            found = np.stack([[distance(part, r) for part, r in zip(by_kind, table)] for table in tables])
            best = np.argmin(found.sum(axis=1), axis=0)
            out[at] = found[best, :, np.arange(len(at))]
        return pd.DataFrame(out, columns=["class_distance", "word_distance"])

    return of


def too_far(class_limit: float, word_limit: float, chance: float = CHANCE) -> Column:
    """Whether the distances ``_d`` pass a limit by more than chance; false where there are none."""
    spare = chance / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = (F.col("_d.class_distance") > class_limit + spare) | (F.col("_d.word_distance") > word_limit + spare)
    return F.coalesce(far, F.lit(False))


def language_references(
    measured: DataFrame, words: Sequence[str], languages: Sequence[str], min_words: int, class_limit: float, word_limit: float
) -> References:
    """References of all documents, then of those that are not far from these: junk leaves the means."""
    first = references_of(measured, words, languages, min_words)
    near = measured.withColumn("_d", nearest_language(first, min_words)("lang", "n_words", *HISTOGRAMS)).where(~too_far(class_limit, word_limit))
    return References(first.words, first.means | references_of(near, words, languages, min_words).means)


def quality_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_words: int = MIN_WORDS,
    class_limit: float = CLASS_LIMIT,
    word_limit: float = WORD_LIMIT,
    references: References | None = None,
) -> DataFrame:
    """Base counts, both distances from the nearest language, and the verdict, for each row.

    Null texts have no words and fail the base rule, as do all texts under ten
    words. A document below ``min_words`` is kept without being compared (its
    distances are null), and so is one of a language without a reference, with
    fewer than ``MIN_DOCS`` long enough documents or less than ``MIN_SHARE`` of
    them. Others are compared with all references, those without a language
    too. Repeated rows are judged each on their own.
    """
    common = None
    if references is None:
        common = common_words(docs, text, lang, min_words)
        words = sorted({word for of_language in common.values() for word in of_language})
    else:
        words = references.words
    source = docs.select(F.col(key).alias("_key"), F.col(lang).alias("lang"), measures(words)(F.coalesce(F.col(text), F.lit(""))).alias("_m"))
    measured = source.select("_key", "lang", "_m.*")
    if common is not None:
        measured = durable(measured)
        references = language_references(measured, words, list(common), min_words, class_limit, word_limit)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.withColumn("_d", nearest_language(references, min_words)("lang", "n_words", *HISTOGRAMS))
    return judged.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~too_far(class_limit, word_limit)).alias("kept"),
        "_d.class_distance",
        "_d.word_distance",
    )


@query("op3_quality_rules")
def op3_quality_rules(spark, sf_dir):
    return quality_rules(read(spark, sf_dir, "documents"))

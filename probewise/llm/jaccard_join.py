"""Near-duplicate documents by a Jaccard join on word shingles, with PartEnum signatures.

Sets of similar size stand in one band, and two sets of a band that are similar
enough differ in at most ``k`` shingles. The shingle domain is divided into
``n1`` parts of ``n2`` subparts each. With ``n1 * (k2 + 1) > k`` some part of
two such sets differs in at most ``k2`` shingles, hence in at most ``k2``
subparts, and the content of the others is the same: a signature is the hash of
a part's content without ``k2`` of its subparts, for every choice of them. Sets
that share no signature cannot be similar; sets that do are compared exactly.

Documents with equal sets are one node from the start. What is asked for are
classes, so within the sets of a signature a star of pairs is compared first,
and pairs that the links so far already connect need no comparison. All other
pairs of a signature are compared. Parts are more than needed, so that
signatures without any shingle, which unlike sets would share, can be left out.
Where a signature has very many open sets still, as around a common passage, those
of them without enough other signatures are keyed anew by the rarest of their shingles, as many as two similar
sets can't all miss, which tells texts around a common passage apart.

Before the exact comparison a pair is tested by counts of its shingles in hash
buckets, a small part of their size: the sum of the smaller counts bounds what
two sets can have in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from probewise.llm.common import BROADCAST_ROWS, let_go, query, read, saved, sized
from probewise.llm.components import connected
from probewise.session import durable

WIDTH, PERCENT = 4, 85
#: Width of a band: its largest size over its smallest, as a power of the inverse threshold.
BAND_POWER = 1
#: ``(k2, n2)``: differing subparts and subparts of a part.
SHAPE = (1, 3)
#: Signatures are gathered in so many waves, each with its share of them, so that a share of them is on disk at a time.
WAVES = 3
#: A signature with more open sets than this is crowded.
CROWDED = 40
#: Set keys that a task remembers, to send a set's signatures once.
MEMORY = 300_000
#: Shingle sets of a partition of a saved table, about.
SET_ROWS = 500
#: Shingles to a bucket of a set's counts, about.
BUCKET = 8
STEP = 1024

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


SPACE = re.compile(rb"[\x20\x09-\x0d]")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
BLOCK_BYTES = 1 << 21


def times(constant: np.uint64, factor: int) -> np.uint64:
    return np.uint64(int(constant) * factor % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, the same on every machine."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, start: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, hashes)`` of the words of a byte string, block by block.

    Bytes are lower-cased in A-Z only. A word's hash is a polynomial of its
    bytes modulo 2**64, taken from running sums over the block and shifted to
    the word's start, then mixed. Blocks end at white space.
    """
    while start < len(data):
        end = min(len(data), start + BLOCK_BYTES)
        if end < len(data):
            gap = SPACE.search(data, end)
            end = gap.end() if gap else len(data)
        block = np.frombuffer(data, np.uint8, end - start, start)
        space = IS_SPACE[block]
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        first, last = edges[::2], edges[1::2]
        powers = np.full(len(block) + 1, BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(BYTE_CODES[block] * powers[:-1], out=sums[1:])
        # dividing by the power of the start is multiplying by the inverse's
        powers = np.full(len(block) + 1, INVERSE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        yield first + start, mix((sums[last] - sums[first]) * powers[first])
        start = end


# codes of bytes in a word, A-Z as a-z
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * ODD[0])
BYTE_CODES[65:91] = BYTE_CODES[97:123]


def chained(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` word hashes; ``size`` is part of it."""
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = mix(total * ODD[4] + words[i : i + n] + np.uint64(i))
    return total


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    encoded = [text.encode("utf-8", "surrogatepass") for text in texts]
    data = b" ".join(encoded)
    found = list(word_hashes(data))
    words = np.concatenate([h for _, h in found]) if found else np.zeros(0, np.uint64)
    places = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
    ends = np.cumsum([len(e) + 1 for e in encoded])
    bounds = np.searchsorted(places, ends).tolist()
    runs = chained(words, width) if len(words) >= width else words[:0]
    out, start = [], 0
    for end in bounds:
        n = end - start
        if n >= width:
            out.append(np.unique(runs[start : end - width + 1]))
        else:
            out.append(chained(words[start:end], n) if n else words[:0])
        start = end
    return out


def set_keys(sets: list[np.ndarray]) -> list[int]:
    """A signed 64-bit key of each set, a sum over its shingles."""
    return [int(mix(s ^ ODD[0]).sum().view(np.int64)) if len(s) else 0 for s in sets]


def bands(percent: int, upto: int, power: int = BAND_POWER) -> list[tuple[int, int, int]]:
    """``(smallest size, largest size, k)`` of each band until ``upto`` is covered."""
    out, low = [], 1
    while not out or out[-1][1] < upto:
        high = max(low, low * 100**power // percent**power)
        out.append((low, high, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
    return out


def parts_of(k: int, smallest: int, shape: tuple[int, int]) -> tuple[int, int]:
    """``(parts, surplus)`` of a band: similar sets agree in ``surplus`` parts at least, but for ``k2`` subparts of each.

    At most ``k // (k2 + 1)`` parts can differ in more. The surplus is what the
    band's smallest sets have of parts with an empty signature, about, and two
    standard deviations more.
    """
    k2, n2 = shape
    differing, surplus = k // (k2 + 1), 1
    while True:
        parts = differing + surplus
        empty = parts * comb(n2, k2) * exp(-smallest * (n2 - k2) / (n2 * parts))
        wanted = 1 + ceil(empty + 2 * sqrt(empty))
        # more parts are smaller ones, so sets of few shingles a part would never have enough
        if wanted <= surplus or 4 * surplus > differing + 8:
            return parts, surplus
        surplus += 1


def contents(sets: list[np.ndarray], percent: int, shape: tuple[int, int]) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """``(numbers of the sets, surplus, signatures, whether they are empty)`` of every band that some sets may belong to.

    The last two are by set, part, and choice of the subparts that are left out.
    A band without differences (``k`` = 0) only joins equal sets and has none.
    """
    k2, n2 = shape
    omitted = list(combinations(range(n2), k2))
    keep = np.ones((len(omitted), n2), bool)
    for row, places in enumerate(omitted):
        keep[row, list(places)] = False
    sizes = np.array([len(s) for s in sets], np.int64)
    table = bands(percent, int(sizes.max(initial=1)) * 100 // percent + 1)
    for number, (low, high, k) in enumerate(table):
        members = np.flatnonzero((100 * sizes >= percent * low) & (sizes <= high) & (sizes > 0))
        if not k or not len(members):
            continue
        parts, surplus = parts_of(k, low * percent // 100, shape)
        joined = np.concatenate([sets[m] for m in members])
        start = np.repeat(np.arange(len(members)), sizes[members]) * (parts * n2)
        salted = mix((joined + times(ODD[1], number + 1)) ^ times(ODD[2], n2))
        place = start + (salted % np.uint64(parts * n2)).astype(np.int64)
        value = mix(salted ^ ODD[3])
        # sums of 32-bit halves are exact in doubles up to 2**21 shingles a subpart
        length = len(members) * parts * n2
        low_sum = np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(float), length).astype(np.uint64)
        high_sum = np.bincount(place, (value >> np.uint64(32)).astype(float), length).astype(np.uint64)
        content = ((high_sum << np.uint64(32)) + low_sum).reshape(-1, n2)
        filled = (np.bincount(place, minlength=length) > 0).reshape(-1, n2)
        subset = np.zeros((len(content), len(omitted)), np.uint64)
        empty = np.zeros(subset.shape, bool)
        for row, kept in enumerate(keep):
            subset[:, row] = content[:, kept].sum(axis=1, dtype=np.uint64)
            empty[:, row] = ~filled[:, kept].any(axis=1)
        salt = (np.arange(parts, dtype=np.uint64)[:, None] * np.uint64(len(omitted)) + np.arange(len(omitted), dtype=np.uint64)) * ODD[0]
        by_set = (len(members), parts, len(omitted))
        yield members, surplus, mix(subset.reshape(by_set) + salt + times(ODD[2], number + 1)).view(np.int64), empty.reshape(by_set)


def signatures(sets: list[np.ndarray], percent: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """``(number of the set, signature)`` of all sets, with those of a larger band that a set may belong to.

    A signature of no shingle at all would be that of many sets. Similar sets
    agree in ``surplus`` parts, so one that has fewer parts with such a
    signature leaves these out: another part brings it together with the
    other set, by a signature that has shingles there too.
    """
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for members, surplus, subset, empty in contents(sets, percent, shape):
        lacking = empty.any(axis=2).sum(axis=1)
        sent = ~empty | (lacking >= surplus)[:, None, None]
        owners.append(np.repeat(members, sent.sum(axis=(1, 2))))
        found.append(subset[sent])
    return np.concatenate(owners), np.concatenate(found)


def unsettled(sets: list[np.ndarray], hot: np.ndarray, percent: int, shape: tuple[int, int]) -> np.ndarray:
    """Whether each set may be similar to another one with no signature in common but those of ``hot`` and empty ones.

    A set shares ``surplus`` parts of a band with any similar set. So in some
    band its parts with a hot signature and those with an empty one must be as many.
    """
    out = np.zeros(len(sets), bool)
    for members, surplus, subset, empty in contents(sets, percent, shape):
        lacking = empty.any(axis=2)
        crowded = np.isin(subset, hot).any(axis=2) & ~lacking
        out[members] |= lacking.sum(axis=1) + crowded.sum(axis=1) >= surplus
    return out


def in_steps(texts: pd.Series, width: int) -> Iterator[list[np.ndarray]]:
    """The shingle sets of a batch, some texts at a time: up to ``STEP``, fewer long ones."""
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text)
        size += len(text)
        if len(some) == STEP or size >= BLOCK_BYTES:
            yield shingle_sets(some, width)
            some, size = [], 0
    if some:
        yield shingle_sets(some, width)


def keyed(width: int):
    """A column function: text to ``struct(n, node)``: size and key of its shingle set."""

    @F.pandas_udf("n long, node long")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(s), node) for sets in in_steps(texts, width) for s, node in zip(sets, set_keys(sets))]
        return pd.DataFrame(rows, columns=["n", "node"], dtype="int64")

    return of


def shingles(width: int):
    """A column function: text to its sorted shingle hashes."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([s.view(np.int64) for sets in in_steps(texts, width) for s in sets])

    return of


def bucket_counts(own: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of a power of two of buckets."""
    n = 8
    while n * BUCKET < len(own):
        n *= 2
    return np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n).astype("<u2")


def counted(width: int):
    """A column function: text to ``struct(n, counts)``: size and bucket counts of its set."""

    @F.pandas_udf("n long, counts binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(s), bucket_counts(s).tobytes()) for sets in in_steps(texts, width) for s in sets]
        return pd.DataFrame(rows, columns=["n", "counts"])

    return of


def may_link(percent: int):
    """A column function: whether two sets can be similar enough, by sizes and bucket counts."""

    @F.pandas_udf("boolean")
    def of(n_a: pd.Series, a: pd.Series, n_b: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for size_a, one, size_b, two in zip(n_a, a, n_b, b):
            small, large = sorted((np.frombuffer(one, "<u2"), np.frombuffer(two, "<u2")), key=len)
            # buckets are low bits of the hash, so more of them fold into fewer
            folded = large.reshape(-1, len(small)).sum(axis=0, dtype=np.int64)
            common = int(np.minimum(small, folded).sum())
            out.append((100 + percent) * common >= percent * (size_a + size_b))
        return pd.Series(out, dtype="bool")

    return of


def signature_rows(texts: DataFrame, width: int, percent: int, shape: tuple[int, int], wave: int = 0, waves: int = 1) -> DataFrame:
    """``sig, node`` of every different set that a task sees, of one of several shares of all signatures."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            for sets in in_steps(frame["_text"], width):
                nodes = np.array(set_keys(sets), np.int64)
                # copies in one task send their signatures once
                new = []
                for i, node in enumerate(nodes.tolist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(i)
                if len(seen) > MEMORY:
                    seen.clear()
                owner, found = signatures([sets[i] for i in new], percent, shape)
                own = (found.view(np.uint64) >> np.uint64(40)) % np.uint64(waves) == np.uint64(wave)
                owner, found = owner[own], found[own]
                yield pd.DataFrame({"sig": found, "node": nodes[new][owner] if len(owner) else found})

    return texts.select("_text").mapInPandas(emit, "sig long, node long")


def groups(rows: DataFrame) -> DataFrame:
    """``sig, node`` of the signatures that several sets share, each once."""
    own = Window.partitionBy("sig")
    shared = rows.withColumn("_low", F.min("node").over(own)).withColumn("_high", F.max("node").over(own))
    return shared.where(F.col("_low") != F.col("_high")).select("sig", "node").distinct()


def shared_signatures(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``sig, node`` of all signatures that several sets share, saved.

    Any share of the signatures can be grouped on its own. A wave reads the
    texts again, and leaves nothing but what is shared: its shuffle is let go
    before the next one starts.
    """
    found = None
    for wave in range(WAVES):
        part = saved(groups(signature_rows(texts, width, percent, SHAPE, wave, WAVES)))
        found = part if found is None else found.union(part)
        let_go(texts.sparkSession)
    return found


class Sets:
    """Texts, bucket counts and shingle sets of the nodes that share a signature."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, source: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        picked = rows.join(nodes, "node").groupBy("node").agg(F.min(F.struct("_key", "_t")).alias("_p"))
        picked = saved(picked.select(F.col("node").alias("_node"), F.col("_p._key").alias("_pk"), F.col("_p._t").alias("_pt")))
        few = picked.count() <= BROADCAST_ROWS
        match = (F.col("_t") == F.col("_pt")) & F.col("_key").eqNullSafe(F.col("_pk"))
        # one text for each node, by the key and the text's hash of one of its documents
        texts = source.join(F.broadcast(picked) if few else picked, match).select(F.col("_node").alias("node"), "_text")
        # too many to send: they are moved once, and read from there afterwards
        self.texts = texts if few else durable(texts)
        self.counts = saved(self.texts.select("node", counted(width)("_text").alias("_c")).select("node", "_c.n", "_c.counts").dropDuplicates(["node"]))

    def of(self, nodes: DataFrame) -> DataFrame:
        """``node, s`` of some nodes, saved; a repeated row gives its set again."""
        # saved, or a condition on the sets would be tested on all texts, before the join
        return saved(self.texts.join(sized(nodes), "node", "left_semi").select("node", shingles(self.width)("_text").alias("s")), SET_ROWS)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose sets are similar enough, saved."""
        percent = self.percent
        one = self.counts.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("counts").alias("_ca"))
        two = self.counts.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("counts").alias("_cb"))
        near = 100 * F.least("_na", "_nb") >= percent * F.greatest("_na", "_nb")
        tested = pairs.join(one, "a").join(two, "b").where(near).where(may_link(percent)("_na", "_ca", "_nb", "_cb"))
        left = saved(tested.select("a", "b", "_na", "_nb"))
        nodes = saved(left.select(F.col("a").alias("node")).union(left.select("b")).distinct())
        sets = self.of(nodes)
        both = left.join(sets.select(F.col("node").alias("a"), F.col("s").alias("_sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("_sb")), "b")
        common = F.size(F.array_intersect("_sa", "_sb"))
        return saved(both.where((100 + percent) * common >= percent * (F.col("_na") + F.col("_nb"))).select("a", "b").distinct())

    def only_crowded(self, crowded: DataFrame) -> DataFrame:
        """The nodes of the crowded rows ``sig, node`` that may be similar to one which no other signature shows.

        A set with fewer crowded or empty parts than it has in common with any similar
        set shares a signature with that set that is neither, and was compared by it.
        A set's crowded signatures go to its text, so a row is one set, however many signatures it has.
        """
        width, percent = self.width, self.percent

        def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                start = 0
                for sets in in_steps(frame["_text"], width):
                    some = frame.iloc[start : start + len(sets)]
                    start += len(sets)
                    # a signature is crowded for all sets that have it
                    yield some.loc[unsettled(sets, np.concatenate(some["_hot"].to_list()), percent, SHAPE), ["node"]]

        hot = saved(crowded.groupBy("node").agg(F.collect_set("sig").alias("_hot")), SET_ROWS)
        texts = self.texts.join(sized(hot.select("node")), "node", "left_semi").select("node", "_text")
        texts = texts.join(F.broadcast(hot) if crowded.count() <= BROADCAST_ROWS else hot, "node")
        return saved(texts.mapInPandas(emit, "node long").distinct())

    def rare_shingles(self, nodes: DataFrame) -> DataFrame:
        """``sig, node, n, rest``: the rarest shingles of each set, as many as one of any similar pair must share.

        ``rest`` is how many shingles a set has from this one on, by rarity.
        """
        sets = self.of(nodes)
        if not sets.groupBy("node").count().where("count > 1").isEmpty():
            sets = sets.dropDuplicates(["node"])
        often = F.count(F.lit(1)).over(Window.partitionBy("sig"))
        # a shingle of one set only joins nothing: it need not be moved, but it ranks before the others
        shared = sets.select("node", F.explode("s").alias("sig")).withColumn("_often", often).where("_often > 1")
        own = Window.partitionBy("node")
        ranked = shared.withColumn("_rank", F.row_number().over(own.orderBy("_often", "sig"))).withColumn("_shared", F.count(F.lit(1)).over(own))
        sizes = ranked.join(self.counts.select("node", "n"), "node").withColumn("rest", F.col("_shared") - F.col("_rank") + 1)
        return sizes.where(F.col("rest") >= F.ceil(F.col("n") * self.percent / 100)).select("sig", "node", "n", "rest")


def open_rows(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """``members`` with their ``label``, of the signatures whose sets the links don't all connect."""
    if label is None:
        # no links yet: every set is on its own, and every signature has several
        return members.withColumn("label", F.col("node"))
    labelled = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # minima and maxima are gathered in parts and joined back: a join is split where a signature has very many sets
    ends = labelled.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    return labelled.join(ends.where("_low != _high").select("sig"), "sig").select(*members.columns, "label")


class Links:
    """The links found so far and the components that they make."""

    def __init__(self):
        self.pairs: DataFrame | None = None
        self.label: DataFrame | None = None

    def add(self, found: DataFrame) -> None:
        if found.isEmpty():
            return
        self.pairs = found if self.pairs is None else self.pairs.union(found)
        # earlier components stand in for the links that made them
        known = found if self.label is None else found.union(self.label.toDF("a", "b"))
        self.label = connected(known)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return saved(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a != b").distinct())


def settle(members: DataFrame, sets: Sets, links: Links, crowded: int | None) -> DataFrame | None:
    """Compare the sets of each signature until every pair is linked, known not to be, or connected.

    Adds the links it finds; returns ``sig, node`` of crowded signatures that are still open.
    """
    # the text that others were copied from shares more signatures with more sets than its copies do
    often = members.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"))
    weight = saved(members.join(often, "sig").groupBy("node").agg(F.sum("_n").alias("_weight")))
    stars = saved(open_rows(members, links.label).join(weight, "node"))
    centers = stars.groupBy("sig").agg(F.max(F.struct("_weight", "node", "label")).alias("_center"))
    around = stars.join(centers, "sig").where("label != _center.label")
    pairs = ordered_pairs(around.select(F.col("_center.node").alias("x"), F.col("node").alias("y")))
    links.add(sets.linked(pairs))
    still = saved(open_rows(members, links.label))
    # sets of too different a size are told apart before anything else of them is moved
    sizes = still if "n" in members.columns else still.join(sets.counts.select("node", "n"), "node")
    left = saved(sizes.join(still.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")), "sig"))
    few = left if crowded is None else left.where(F.col("_n") <= crowded)
    one, two = few.alias("o"), few.alias("t")
    match = (F.col("o.sig") == F.col("t.sig")) & (F.col("o.node") < F.col("t.node")) & (F.col("o.label") != F.col("t.label"))
    match = match & (100 * F.least("o.n", "t.n") >= sets.percent * F.greatest("o.n", "t.n"))
    if "rest" in members.columns:
        # the first shingle that two sets share bounds what they have in common
        common = F.least("o.rest", "t.rest")
        match = match & ((100 + sets.percent) * common >= sets.percent * (F.col("o.n") + F.col("t.n")))
    rest = one.join(two, match).select(F.col("o.node").alias("x"), F.col("t.node").alias("y"))
    rest = saved(ordered_pairs(rest).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links.add(sets.linked(rest))
    return None if crowded is None else saved(left.where(F.col("_n") > crowded).select("sig", "node"))


def classified(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``_key, _t, n, _label`` of every row: key, text hash, size of its set, and its class, null where it has no shingles."""
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_t", F.xxhash64("_text"))
    rows = saved(source.select("_key", "_t", keyed(width)("_text").alias("_s")).select("_key", "_t", "_s.n", "_s.node"))
    members = shared_signatures(source, width, percent)
    links = Links()
    if not members.isEmpty():
        sets = Sets(members.select("node").distinct(), rows, source, width, percent)
        crowded = settle(members, sets, links, CROWDED)
        many = crowded if crowded.isEmpty() else sets.only_crowded(crowded)
        if not many.isEmpty():
            settle(saved(sets.rare_shingles(many)), sets, links, None)
    labelled = rows.withColumn("label", F.col("node")) if links.label is None else rows.join(links.label, "node", "left")
    return labelled.select("_key", "_t", "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("_label"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``key, n_shingles, component_id``.

    ``component_id`` is the smallest key that links reach, the row's own
    included; two documents link where their shingle sets have ``percent``
    hundredths in common. Null, empty and blank texts have no shingles and link
    with nothing, so their component is their own key. A text shorter than
    ``width`` words is one shingle. Rows with equal texts link whatever their
    keys; null keys are never the smallest. No rows give no rows; other columns
    are not read. Shingles and sets are known by 64-bit hashes: among 10**9
    different sets the chance that any two are taken for one is 3 %.
    """
    placed = classified(docs, key, text, width, percent)
    # saved, so that the join below is one that Spark can split where a class is large
    least = saved(placed.where(F.col("n") > 0).groupBy("_label").agg(F.min("_key").alias("_least")))
    full = placed.where(F.col("n") > 0).join(least, "_label").select("_key", "n", F.col("_least").alias("component_id"))
    empty = placed.where(F.col("n") == 0).select("_key", "n", F.col("_key").alias("component_id"))
    return full.union(empty).select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does, the one with the smallest key.

    One row of every class stays, whether keys repeat or are null: of rows with
    the smallest key the one with the smallest text hash, a null key only where
    the class has no other. Texts without shingles all stay, repeated rows once.
    """
    placed = saved(classified(docs, key, text, width, percent))
    first = F.min(F.struct(F.col("_key").isNull().alias("_none"), "_key", "_t")).alias("_p")
    full = placed.where(F.col("n") > 0).groupBy("_label").agg(first).select(F.col("_p._key").alias("_k"), F.col("_p._t").alias("_h"))
    empty = placed.where(F.col("n") == 0).select(F.col("_key").alias("_k"), F.col("_t").alias("_h")).distinct()
    match = F.col(key).eqNullSafe(F.col("_k")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_h"))
    kept = docs.join(sized(saved(full.union(empty))), match, "left_semi")
    if placed.groupBy("_key", "_t").count().where("count > 1").isEmpty():
        return kept
    # only where rows repeat key and text are they looked for
    return kept.withColumn("_h", F.xxhash64(text)).dropDuplicates([key, "_h"]).select(*docs.columns)


@query("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))

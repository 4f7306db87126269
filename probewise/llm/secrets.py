"""Secret scan: three fixed patterns, and strings that look random to character models.

Two Markov models give each character the probability of following the one
before it: one learned from random strings, one from ordinary identifiers. Long
strings with letters and digits whose mean log-likelihood ratio favours the
random model are secrets. Everything runs as Spark expressions: a pattern's
matches and the pieces of text between them have lengths that give every
match's place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probewise.llm.common import query, read

# fixed values: the patterns of the three kinds, with the number of the group
# that must have so many characters
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

#: Characters of strings that the models judge, and the shortest of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
#: Random by rule, but names and not secrets.
UUID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Lower-case words before a key that say whose it is; the models judge what follows them.
PREFIX = r"^(?:[a-z]{2,8}[_-]){1,3}(?=.{20,}$)"
#: Mean log-likelihood ratio per character, in nats, above which a string is random.
RATIO = 0.25
#: Matches that are summed up together before they are put into the result.
BLOCK = 512

# labelled samples of ordinary identifiers: they are joined in pairs and triples
ORDINARY = """
account action active address after agent alert amount answer array article asset author average backup balance
banner batch before block board body border branch buffer build button cache calendar cancel capture category
channel chapter check child city class client cloud cluster code collection color column comment commit company
config connection contact container content context control cookie copy count country course create credit
current customer data database date debug default delete delivery design detail device dialog digest directory
display distance document domain download driver duration edit element email enable encoding engine entry error
event example export factory failure feature field file filter find folder font format frame function gateway
general generate group handler header height history home image import index input insert instance integer
internal invoice item journal kernel label language layout length level library limit line list loader local
logger machine manager market master member memory message method metric minute mobile model module monitor
network number object offset option order output package page parent partition password path pattern payment
""".split()


def spans_of(text: Column, pattern: str, groups: int, keep) -> Column:
    """``array<struct<from, upto>>`` of the matches of ``pattern`` that ``keep`` accepts, leftmost, not overlapping.

    ``keep`` gets the match and, if ``groups`` is 1, the pattern's own group.
    Texts without a match are read once, others once more for the matches and
    for the pieces between them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    inner = F.regexp_extract_all(text, F.lit(pattern), 1) if groups else hits
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    places = F.zip_with(gaps, F.arrays_zip(hits.alias("hit"), inner.alias("own")), lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x["hit"]).alias("n"), keep(x["hit"], x["own"]).alias("ok")))
    span = "struct<from:int,upto:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("last"), F.array().cast(f"array<array<{span}>>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["n"]
        own = F.struct(begin.alias("from"), end.alias("upto"))
        last = F.when(x["ok"], F.concat(state["last"], F.array(own))).otherwise(state["last"])
        # full blocks are put away, so a text with very many matches isn't copied again for each
        full = F.size(state["last"]) >= BLOCK
        return F.struct(
            end.alias("at"),
            F.when(full, F.when(x["ok"], F.array(own)).otherwise(F.array().cast(f"array<{span}>"))).otherwise(last).alias("last"),
            F.when(full, F.concat(state["done"], F.array(state["last"]))).otherwise(state["done"]).alias("done"),
        )

    found = F.aggregate(places, start, step, lambda s: F.concat(F.flatten(s["done"]), s["last"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{span}>"))


def merged(base: Column, added: Column) -> Column:
    """The spans of both lists by start and kind, without those of ``added`` that one of ``base`` overlaps.

    Spans of ``added`` don't overlap each other, so one walk over the sorted
    spans is enough: a span of ``added`` waits for the next span, which either
    overlaps it or puts it into the result.
    """
    spans = "array<struct<from:int,kind_no:int,upto:int,kind:string>>"
    none = F.array().cast(spans)
    start = F.struct(F.lit(0).alias("covered"), none.alias("waiting"), none.alias("last"), F.array().cast(f"array<{spans}>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        is_base = x["kind_no"] < len(KINDS) - 1
        overlapped = is_base & F.coalesce(x["from"] < F.get(state["waiting"], F.lit(0))["upto"], F.lit(False))
        ready = F.concat(F.when(overlapped, none).otherwise(state["waiting"]), F.when(is_base, F.array(x)).otherwise(none))
        full = F.size(state["last"]) >= BLOCK
        return F.struct(
            F.when(is_base, F.greatest(state["covered"], x["upto"])).otherwise(state["covered"]).alias("covered"),
            F.when(~is_base & (x["from"] >= state["covered"]), F.array(x)).otherwise(none).alias("waiting"),
            F.when(full, ready).otherwise(F.concat(state["last"], ready)).alias("last"),
            F.when(full, F.concat(state["done"], F.array(state["last"]))).otherwise(state["done"]).alias("done"),
        )

    all_spans = F.array_sort(F.concat(base, added))
    walked = F.aggregate(all_spans, start, step, lambda s: F.concat(F.flatten(s["done"]), s["last"], s["waiting"]))
    return F.when((F.size(base) > 0) & (F.size(added) > 0), walked).otherwise(all_spans)


def labelled_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """``text, random``: random strings in five alphabets, and identifiers of two or three ordinary words.

    Both are made by rule from hashes of numbers and from ``ORDINARY``, so the
    models are the same in every run.
    """
    words = F.array(*[F.lit(w) for w in ORDINARY])
    row = F.col("id")
    digest = F.sha2(row.cast("string"), 256)
    encoded = F.base64(F.unhex(digest))
    kind = row % 5
    random = (
        F.when(kind == 0, F.substring(digest, 1, 40))
        .when(kind == 1, encoded)
        .when(kind == 2, F.translate(encoded, "+/=", ""))
        .when(kind == 3, F.translate(encoded, "+/=", "-_"))
        .otherwise(F.upper(F.translate(encoded, "+/=", "")))
    )

    def word(salt: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(len(ORDINARY))).cast("int"))

    glue = F.get(F.array(*[F.lit(g) for g in ("_", "-", "/", "")]), F.pmod(F.xxhash64(row, F.lit(9)), F.lit(4)).cast("int"))
    plain = F.concat_ws("", word(1), glue, F.when(glue == "", F.initcap(word(2))).otherwise(word(2)), glue, F.when(glue == "", F.initcap(word(3))).otherwise(word(3)))
    numbered = F.when(row % 3 == 0, F.concat(plain, glue, (row % 100).cast("string"))).otherwise(plain)
    ids = spark.range(n)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(
        ids.select(F.when(row % 7 == 0, F.upper(numbered)).otherwise(numbered).alias("text"), F.lit(False).alias("random"))
    )


def letters(text: Column) -> Column:
    """The characters of a string."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def ratios(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every pair of characters of ``ALPHABET``, by first and second.

    What reaches the driver is a count for each pair and label. Pairs that a
    label lacks count one; characters outside the alphabet and null strings
    are left out.
    """
    chars = samples.where(F.col("text").isNotNull()).select("random", letters(F.col("text")).alias("c"))
    pairs = chars.where(F.size("c") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(F.get("c", i - 1).alias("a"), F.get("c", i).alias("b")))).alias("p"))
    counts = {(r["random"], r["a"], r["b"]): r["count"] for r in pairs.groupBy("random", "p.a", "p.b").count().where(F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).collect()}
    out = []
    for a in ALPHABET:
        totals = [sum(counts.get((r, a, b), 0) for b in ALPHABET) + len(ALPHABET) for r in (True, False)]
        for b in ALPHABET:
            random, plain = ((counts.get((r, a, b), 0) + 1) / t for r, t in zip((True, False), totals))
            out.append(math.log(random / plain))
    return out


def numbers(values: list, kind: str) -> Column:
    """A constant array; Spark folds it once, so it is no expression per value."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def randomness(text: Column, table: list[float]) -> Column:
    """The mean log-likelihood ratio of a string of the alphabet, in nats for each character after the first."""
    code = numbers([ALPHABET.find(chr(i)) for i in range(128)], "int")
    codes = F.transform(letters(text), lambda c: F.get(code, F.ascii(c)))
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(numbers(table, "double"), a * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x) / F.size(pairs)


def scan(docs: DataFrame, samples: DataFrame | None = None, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """``docs`` with ``spans``: ``array<struct<from, kind_no, upto, kind>>`` by start and kind.

    Places count code points from 0, ends are exclusive. Null and empty texts
    have no spans. The strings of the models, UUIDs left out, are added where no
    span of a fixed pattern overlaps them. A column named ``spans`` is replaced.
    """
    table = ratios(labelled_samples(docs.sparkSession) if samples is None else samples)
    full = F.coalesce(F.col(text), F.lit(""))
    found = [
        spans_of(full, ASSIGN, 1, lambda hit, own: F.length(own) >= ASSIGN_LENGTH),
        spans_of(full, ACCESS, 0, lambda hit, own: F.length(hit) >= ACCESS_LENGTH),
        spans_of(full, HEX, 0, lambda hit, own: F.lit(True)),
        spans_of(full, CANDIDATE, 0, lambda hit, own: ~hit.rlike(UUID) & (randomness(F.regexp_replace(hit, PREFIX, ""), table) >= ratio)),
    ]

    def named(spans: Column, number: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["from"].alias("from"), F.lit(number).alias("kind_no"), s["upto"].alias("upto"), F.lit(KINDS[number]).alias("kind")))

    parts = docs.withColumn("_found", F.struct(*[named(spans, i).alias(KINDS[i]) for i, spans in enumerate(found)]))
    base = F.concat("_found.assign", "_found.access", "_found.hex")
    return parts.withColumn("spans", merged(base, F.col("_found.markov"))).drop("_found")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["from"], s["upto"])), ",")


def of_kind(number: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind_no"] == number))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [of_kind(i).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])]
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))

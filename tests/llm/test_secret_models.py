"""Character models on strings that they were not trained on, and the merging of spans."""

import base64
import random
import string

import pytest
from pyspark.sql import functions as F

from probewise.llm import secrets

# words that are not among those of the training samples
WORDS = """
anchor apple arrow basket beacon bottle bridge butter candle canyon castle cherry circle coffee copper cotton dragon eagle
engineer falcon farmer fishing flower forest garden ginger glacier guitar hammer harbor helmet island jacket jungle kitchen
ladder lantern lemon lizard marble meadow mirror morning mountain needle ocean orange oyster paper parrot pepper pillow
planet pocket potato quarter rabbit ribbon river rocket saddle salmon shadow silver spider spring station summer sunset
temple thunder ticket timber tomato tunnel turtle velvet village violin walnut weather whisper window winter yellow
""".split()


def of_kind(kind, dice):
    def words(n):
        return [dice.choice(WORDS) for _ in range(n)]

    def chars(alphabet, n):
        return "".join(dice.choices(alphabet, k=n))

    every = string.ascii_letters + string.digits
    return {
        "snake case": lambda: "_".join([*words(4), str(dice.randrange(100))]),
        "camel case": lambda: "".join(w.title() for w in words(4)) + str(dice.randrange(100)),
        "path": lambda: "/" + "/".join(words(4)) + f"/{dice.randrange(1, 32)}",
        "version": lambda: "-".join([*words(3), "v" + str(dice.randrange(20)), str(dice.randrange(100)), str(dice.randrange(100))]),
        "date": lambda: "-".join([*words(3), str(dice.randrange(1990, 2030)), f"{dice.randrange(1, 13):02}", f"{dice.randrange(1, 29):02}"]),
        "uuid": lambda: "-".join(chars("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "letters and digits": lambda: chars(every, 32) + "7a",
        "cloud key": lambda: chars(every + "+/", 38) + "5b",
        "token with prefix": lambda: "ghp_" + chars(every, 35) + "3",
        "live key": lambda: "sk_live_" + chars(every, 24) + "9",
        "url-safe": lambda: base64.urlsafe_b64encode(dice.randbytes(33)).decode() + "1a",
        "upper case": lambda: chars(string.ascii_uppercase + "234567", 31) + "2",
    }[kind]()


PLAIN = ("snake case", "camel case", "path", "version", "date", "uuid")
RANDOM = ("letters and digits", "cloud key", "token with prefix", "live key", "url-safe", "upper case")


def held_out(n=300):
    dice = random.Random(5)
    return [(kind, kind in RANDOM, of_kind(kind, dice)) for kind in PLAIN + RANDOM for _ in range(n)]


def test_precision_and_recall_on_held_out_strings(spark):
    assert not set(WORDS) & set(secrets.ORDINARY)
    rows = [(kind, secret, f"the value is {text} here") for kind, secret, text in held_out()]
    found = secrets.scan(spark.createDataFrame(rows, "kind string, secret boolean, text string"))
    hits = {(r.kind, r.secret): r.hit for r in found.groupBy("kind", "secret").agg(F.avg((F.size("spans") > 0).cast("double")).alias("hit")).collect()}
    caught = [hit for (_, secret), hit in hits.items() if secret]
    flagged = [hit for (_, secret), hit in hits.items() if not secret]
    recall, precision = sum(caught) / len(caught), sum(caught) / (sum(caught) + sum(flagged))
    print({kind: round(hit, 3) for (kind, _), hit in sorted(hits.items())}, "precision", round(precision, 4), "recall", round(recall, 4))
    assert recall >= 0.97 and precision >= 0.97
    assert min(caught) >= 0.9 and max(flagged) <= 0.05
    assert hits["uuid", False] == 0


def brute_merge(base, added):
    kept = [m for m in added if not any(b[0] < m[2] and m[0] < b[2] for b in base)]
    return sorted(base + kept)


@pytest.mark.parametrize("n", [0, 1, 7, 60, 1500])
def test_merge_against_all_pairs(spark, n):
    """Base spans may overlap each other, added ones may not."""
    dice, schema = random.Random(n), "array<struct<from:int,kind_no:int,upto:int,kind:string>>"
    rows = []
    for key in range(12):
        base = []
        for _ in range(dice.randrange(n + 1)):
            start, kind = dice.randrange(20 * n), dice.randrange(3)
            base.append((start, kind, start + dice.randrange(1, 30), secrets.KINDS[kind]))
        added, at = [], 0
        for _ in range(dice.randrange(n + 1)):
            at += dice.randrange(12)
            end = at + dice.randrange(1, 20)
            added.append((at, 3, end, "markov"))
            at = end
        rows.append((key, base, added))
    df = spark.createDataFrame(rows, f"key int, base {schema}, added {schema}")
    for r in df.select("key", secrets.merged(F.col("base"), F.col("added")).alias("spans")).collect():
        assert [tuple(s) for s in r.spans] == brute_merge(*rows[r.key][1:])

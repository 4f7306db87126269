"""Language references from the table: words, distances and verdicts against plain Python."""

import math
import random
from collections import Counter

import pytest

from probewise.llm import divergence

# a few sentences of each language, to be mixed
PROSE = {
    "it": "la casa è grande e il giardino non è lontano dal fiume|un uomo con il cane va per la strada che porta al mare|"
    "di notte le luci della città sono belle ma il vento è freddo|si dice che nel paese tutti vivono del lavoro dei campi",
    "nl": "het huis is groot en de tuin ligt niet ver van de rivier|een man met zijn hond loopt op de weg die naar de zee gaat|"
    "in de nacht zijn de lichten van de stad mooi maar de wind is koud|men zegt dat in het dorp alle mensen van het land leven",
    "ru": "дом большой и сад не далеко от реки|человек с собакой идёт по дороге которая ведёт к морю|"
    "ночью огни города красивы но ветер на улице холодный|говорят что в деревне все живут тем что даёт им земля и на поле",
}
SCHEMA = "doc_id long, text string, lang string"


def paragraph(name, seed, sentences=12):
    dice, parts = random.Random(f"{name}{seed}"), PROSE[name].split("|")
    return " ".join(". ".join(" ".join(dice.sample(p.split(), len(p.split()))).capitalize() for p in dice.choices(parts, k=sentences)).split()) + "."


def junk(seed):
    dice = random.Random(seed)
    return " ".join("".join(dice.choices("XQZ#$%&0123456789", k=7)) for _ in range(80))


def js(p, q):
    """Jensen-Shannon distance of two dictionaries of shares."""
    total = 0.0
    for at in p.keys() | q.keys():
        a, b = p.get(at, 0.0), q.get(at, 0.0)
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(total / 2, 0))


def histograms(text, words):
    table = divergence.class_table()
    classes = Counter(int(table[ord(c)]) if ord(c) < 0x250 else len(divergence.CLASSES) - 1 for c in text)
    plain = Counter(w if (w := token.rstrip(".,;:?")) in words else None for token in text.lower().split())
    return [{k: n / sum(c.values()) for k, n in c.items()} for c in (classes, plain)]


def brute_force(rows):
    """Common words, references and verdicts of rows that have no base failures."""
    docs = [(lang, text) for _, text, lang in rows if lang and text and len(text.split()) >= divergence.MIN_WORDS]
    sizes = Counter(lang for lang, _ in docs)
    large = {name for name, n in sizes.items() if n >= divergence.MIN_DOCS and n >= sum(m for m in sizes.values() if m >= divergence.MIN_DOCS) * divergence.MIN_SHARE}
    words = set()
    for name in large:
        seen = Counter(w for lang, text in docs if lang == name for w in {t.rstrip(".,;:?") for t in text.lower().split()} if w.isalpha() and len(w) <= 32)
        words |= {w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: divergence.COMMON_WORDS] if n >= divergence.MIN_DOCS}

    def means(chosen):
        out = {}
        for name in large:
            found = [histograms(text, words) for lang, text in chosen if lang == name]
            if found:
                out[name] = [{k: sum(h[i].get(k, 0) for h in found) / len(found) for h in found for k in h[i]} for i in (0, 1)]
        return out

    def nearest(text, references):
        own = histograms(text, words)
        return min(([js(own[i], r[i]) for i in (0, 1)] for _, r in sorted(references.items())), key=sum)

    def far(text, distances):
        spare = divergence.CHANCE / math.sqrt(len(text.split()))
        return distances[0] > divergence.CLASS_LIMIT + spare or distances[1] > divergence.WORD_LIMIT + spare

    first = means(docs)
    references = first | means([(lang, text) for lang, text in docs if lang in large and not far(text, nearest(text, first))])
    out = {}
    for key, text, lang in rows:
        if not text or len(text.split()) < divergence.MIN_WORDS or (lang and lang not in large):
            out[key] = (None, None, True)
        else:
            distances = nearest(text, references)
            out[key] = (*distances, not far(text, distances))
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i * 10 + j, paragraph(name, i), name) for i in range(30) for j, name in enumerate(PROSE)]
    out += [(1000 + i, junk(i), lang) for i, lang in enumerate(["it", "nl", "ru", None, "it"])]
    out += [(1100, paragraph("nl", 99), None), (1101, "parola " * 20, "it"), (1102, paragraph("it", 98), "xx"), (1103, junk(50), "xx")]
    return out


def test_references_of_every_language_against_brute_force(spark, rows):
    expected = brute_force(rows)
    found = {r.doc_id: r for r in divergence.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(rows)
    for key, (class_distance, word_distance, near) in expected.items():
        r = found[key]
        assert (r.class_distance, r.word_distance) == (pytest.approx(class_distance, abs=1e-9), pytest.approx(word_distance, abs=1e-9))
        assert r.kept == (near and not r.base_failed)
    # every clean paragraph stays, what is like no language goes, and what can't be compared stays
    assert all(found[i * 10 + j].kept for i in range(30) for j in range(3))
    assert not any(found[1000 + i].kept for i in range(5))
    assert found[1100].kept and found[1102].kept and found[1103].kept


def test_common_words_of_the_table(spark, rows):
    common = divergence.common_words(spark.createDataFrame(rows, SCHEMA))
    assert set(common) == set(PROSE)
    assert {"la", "il", "è"} <= set(common["it"]) and {"de", "het"} <= set(common["nl"]) and {"и", "на"} <= set(common["ru"])
    assert all(len(words) <= divergence.COMMON_WORDS for words in common.values())


def test_a_few_paragraphs_of_a_rare_language_stay(spark):
    """Beside many documents of one language, single ones of others have no reference and stay."""
    rows = [(i, paragraph("nl", i), "nl") for i in range(40)] + [(100, paragraph("it", 1), "it"), (101, paragraph("ru", 1), "ru")]
    assert all(r.kept for r in divergence.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect())


def test_histograms_are_held_in_slices(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {r.doc_id: r for r in divergence.quality_rules(docs).collect()}
    monkeypatch.setattr(divergence, "HELD", 200)
    for r in divergence.quality_rules(docs).collect():
        assert r.kept == whole[r.doc_id].kept and r.word_distance == pytest.approx(whole[r.doc_id].word_distance, abs=1e-9)

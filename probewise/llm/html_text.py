"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores by what it stands in: the
names of the elements around it, the words of their class and id attributes, and
whether it stands beside the page's main or article element have log-odds,
counted on labelled pages, of holding main text. Tags score below zero, more so
the rarer they are in main text. One scan finds the contiguous run with the
largest sum, and the words with a positive score in it are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.llm.common import query, read
from probewise.llm.labelled_pages import PAGES

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr br img".split())
#: Elements whose content is never text.
HIDDEN = frozenset("script style head title noscript template textarea select option button iframe svg math object canvas audio video form".split())
#: Elements whose words aren't counted to see how much a form holds.
CONTROLS = frozenset("select button svg math object canvas audio video".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'"<>])*+|[^<>]*)(?:>|\Z)"""
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
LINK = "<a>"
#: A form around most words of its page; what stands beside the main or article element of its page.
PAGE_FORM = "form-page"
BESIDE = {"main": "beside main", "article": "beside article"}

#: Bounds of a word's score, of a tag's, and the weight of one unseen word in the counts.
WORD_BOUNDS, TAG_BOUNDS, PRIOR = (-0.1, 1.0), (-0.5, -0.01), 0.5

Weights = tuple[dict[str, float], dict[str, float], float]  # of contexts, of tags, of any word


def events(page: str) -> Iterator[tuple[str, object]]:
    """``("text", words)``, ``("open", (name, marks))`` and ``("close", name)`` in page order.

    Comments, declarations and raw elements are left out; an element cut off at
    the end of the page counts as markup.
    """
    at = 0
    for found in MARKUP.finditer(page):
        if found.start() > at:
            yield "text", html.unescape(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            # a raw element ends a block like any other
            continue
        if found["close"]:
            yield "close", name.lower()
        else:
            marks = {word for m in MARKS.finditer(found["rest"] or "") for word in NAME.findall((m[1] or m[2] or m[3] or "").lower())}
            yield "open", (name.lower(), frozenset(marks))
    if at < len(page):
        yield "text", html.unescape(page[at:])


def outline(found: list[tuple[str, object]]) -> tuple[set[int], frozenset[str]]:
    """The places of the forms that hold more than half of a page's words, and marks of words beside its main elements."""
    words, hidden = 0, 0
    open_forms: list[tuple[int, int]] = []
    forms: list[tuple[int, int]] = []
    inside = dict.fromkeys(BESIDE, 0)
    holds: set[str] = set()
    for at, (kind, value) in enumerate(found):
        if kind == "text":
            n = 0 if hidden else len(value.split())
            words += n
            holds.update(name for name in BESIDE if n and inside[name])
            continue
        name, step = (value[0], 1) if kind == "open" else (value, -1)
        if name in inside:
            inside[name] = max(inside[name] + step, 0)
        elif name == "form":
            if kind == "open":
                open_forms.append((at, words))
            elif open_forms:
                start, before = open_forms.pop()
                forms.append((start, words - before))
        elif name in CONTROLS:
            hidden = max(hidden + step, 0)
    forms += [(start, words - before) for start, before in open_forms]
    return {start for start, n in forms if 2 * n > words}, frozenset(BESIDE[name] for name in holds)


def tokens(page: str) -> Iterator[tuple[str, object]]:
    """``("words", (words, contexts))``, ``("tag", name)`` and ``("block", None)`` where a block ends.

    Open elements are kept on a stack: a block closes an open paragraph, an end
    tag closes what stands open inside it, and one without a start is ignored.
    A form around the whole page is an element of its own name.
    """
    found = list(events(page))
    page_forms, beside = outline(found)
    stack: list[tuple[str, frozenset[str]]] = []
    contexts: list[frozenset[str]] = [beside]

    def cut(depth: int) -> None:
        del stack[depth:], contexts[depth + 1 :]

    for at, (kind, value) in enumerate(found):
        if kind == "text":
            yield "text", (value, contexts[-1])
            continue
        name = value[0] if kind == "open" else value
        if name not in INLINE:
            yield "block", None
        yield "tag", name
        if kind == "close":
            if any(open_name == name for open_name, _ in stack):
                cut(max(i for i, (open_name, _) in enumerate(stack) if open_name == name))
        elif name not in VOID:
            if name not in INLINE:
                # an open paragraph ends here, with all that was left open in it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        cut(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            stack.append((name, value[1]))
            # the marks of a form around the page say what it sends, not what it holds
            own = {f"<{PAGE_FORM}>"} if at in page_forms else {f"<{name}>"} | {f".{mark}" for mark in value[1]}
            # an article is main text wherever it stands
            inner = {"main": {BESIDE["main"]}, "article": set(BESIDE.values())}.get(name, set())
            contexts.append((contexts[-1] - inner) | own)


def blocks(page: str) -> Iterator[tuple[str, list[tuple[list[str], frozenset[str]]] | str]]:
    """``("block", [(words, contexts), ...])`` and ``("tag", name)``, with white space as word ends."""
    parts: list[tuple[str, frozenset[str]]] = []

    def ended():
        # words may reach over inline tags: a part that starts without a space goes on with the last word
        out: list[tuple[list[str], frozenset[str]]] = []
        open_end = False
        for text, context in parts:
            words = text.split()
            if words and open_end and not text[0].isspace() and out:
                out[-1][0][-1] += words.pop(0)
            if words:
                out.append((words, context))
            if text:
                open_end = not text[-1].isspace()
        parts.clear()
        # a link says something about a block only if there is nothing else in it
        if any(LINK not in context for _, context in out):
            out = [(words, context - {LINK}) for words, context in out]
        return out

    for kind, value in tokens(page):
        if kind == "text":
            parts.append(value)
        elif kind == "tag":
            if value == "br":
                parts.append((" ", frozenset()))
            yield kind, value
        else:
            yield "block", ended()
    yield "block", ended()


def fit(pages: Iterable[tuple[str, str]] = PAGES) -> Weights:
    """Weights from labelled pages ``(html, main text)``; a block is main text if it is one of the text's blocks."""
    inside: dict[str, float] = {}
    outside: dict[str, float] = {}
    words_in = words_out = 0.0
    tags: dict[str, list[float]] = {}
    for page, text in pages:
        main = set(text.split("\n\n"))
        pending: list[str] = []
        for kind, value in blocks(page or ""):
            if kind == "tag":
                pending.append(value)
                continue
            if not value:
                continue
            good = " ".join(w for words, _ in value for w in words) in main
            for name in pending:
                tags.setdefault(name, [0, 0])[not good] += 1
            pending.clear()
            for words, context in value:
                if good:
                    words_in += len(words)
                else:
                    words_out += len(words)
                counts = inside if good else outside
                for mark in context:
                    counts[mark] = counts.get(mark, 0) + len(words)
    ratio = (words_in + 1) / (words_out + 1)
    context_weights = {m: math.log((inside.get(m, 0) + PRIOR) / (outside.get(m, 0) + PRIOR) / ratio) for m in inside.keys() | outside.keys()}
    tag_weights = {name: math.log((good + PRIOR) / (bad + PRIOR)) for name, (good, bad) in tags.items()}
    return context_weights, tag_weights, math.log(ratio)


def clip(value: float, bounds: tuple[float, float]) -> float:
    return min(max(value, bounds[0]), bounds[1])


def main_blocks(page: str, weights: Weights) -> list[str]:
    """The blocks of the best run of a page."""
    context_weights, tag_weights, any_word = weights
    known: dict[frozenset[str], float] = {}

    def of(context: frozenset[str]) -> float:
        if context not in known:
            hidden = any(mark[1:-1] in HIDDEN for mark in context if mark[0] == "<")
            total = any_word + sum(context_weights.get(mark, 0.0) for mark in context)
            known[context] = WORD_BOUNDS[0] if hidden else clip(total, WORD_BOUNDS)
        return known[context]

    # a run of words of one context is one item: all of its words score alike
    items: list[tuple[int, str, float]] = []
    best, best_range, total, start, block = 0.0, (0, 0), 0.0, 0, 0
    for kind, value in blocks(page):
        if kind == "tag":
            scored = [(None, clip(tag_weights.get(value, 0.0), TAG_BOUNDS))]
        else:
            block += 1
            scored = [(" ".join(words), len(words) * of(context)) for words, context in value]
        for text, score in scored:
            if total <= 0:
                total, start = 0.0, len(items)
            if text is not None:
                items.append((block, text, score))
            total += score
            if total > best:
                best, best_range = total, (start, len(items))
    out: dict[int, list[str]] = {}
    for number, text, score in items[slice(*best_range)]:
        if score > 0:
            out.setdefault(number, []).append(text)
    return [" ".join(parts) for parts in out.values()]


def main_text(weights: Weights):
    """A column function: a page's HTML to its main text."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: "\n\n".join(main_blocks(page, weights)))

    return of


def extract(pages: DataFrame, markup: str = "html", labelled: Iterable[tuple[str, str]] = PAGES) -> DataFrame:
    """``pages`` with ``text``, the main text of each row, and ``n_chars``, its code points.

    Null and empty pages, and pages without any word of positive score, have
    the empty text. Pages are independent, so repeated rows give the same text
    each. Columns of the two names are replaced. ``labelled`` is a small set of
    pages that the weights are counted on, here and not in the tasks.
    """
    found = pages.withColumn("text", main_text(fit(labelled))(F.coalesce(F.col(markup), F.lit(""))))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op7_html_text")
def op7_html_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")

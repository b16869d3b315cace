"""Operator 4: main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive where the words of
labelled pages are mostly content, tags score negative, the more so the rarer they are
inside content; one linear scan finds the contiguous region with the largest sum. Labelled pages
are those that mark their content themselves (``article`` or ``main``): every word and tag of all of them is counted
as inside or outside, by kind. The kinds are a closed list (tag names of HTML, in a link or
not, in a part named as boilerplate or not), so the counts that reach the driver are bounded. Unlabelled
pages are read with the same weights; a prior holds where nothing was counted.

Inside the region, parts named as boilerplate (menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles,
comments of readers) are left out. A tag names its part; a class, id or role does unless its element holds the page's main part or first
article (or, where neither is marked, most of the page's words: more than half if only a part of the name is boilerplate, more than four fifths
in three blocks or more if the whole name is, comments of readers apart), and inside marked content only as a whole name; character references are decoded, white space inside a block is one space, and blocks are
joined in page order by an empty line.

Defined cases: null or empty html gives an empty text, as does a page without a word that scores; broken or unclosed markup
is read as far as it goes, a tag that never closes ends the page; pages of any length are read whole; of equal regions the first counts; repeated
rows give repeated rows; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices, text_of

# Element names of HTML by their role here.
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td "
            "template tfoot th thead tr ul".split())
BOILER_TAGS = set("aside button dialog footer form head iframe menu nav noscript object select svg template".split())
LABEL_TAGS = {"article", "main"}
# Words of class, id and role attributes that name boilerplate.
BOILER_WORDS = set("ad ads adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments "
                   "complementary consent contentinfo cookie cookies discussion disqus footer gdpr login masthead menu modal nav "
                   "navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion "
                   "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
                   "subscribe toolbar topbar trending widget".split())
READER_WORDS = set("comment comments discussion disqus replies reply respond".split())
ANCESTORS_KEPT = {"html", "body"} | LABEL_TAGS
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+)(?:>|(?=<)|\Z)", re.S | re.I)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tag_is_boilerplate(name: str, in_content: bool) -> bool:
    return name in BOILER_TAGS or (name == "header" and not in_content)


def _names_boilerplate(attrs: str, in_content: bool, words: set[str] = BOILER_WORDS) -> bool:
    """A class, id or role names boilerplate: inside marked content as a whole name only, elsewhere also as a part of one."""
    if "=" not in attrs:
        return False
    for _, a, b, c in ATTR.findall(attrs):
        value = a or b or c
        for word in value.split() if in_content else PART.findall(value):
            word = word.lower()
            if word in words or (words is BOILER_WORDS and word == "header" and not in_content):
                return True
    return False


class Wrappers:
    """What the elements hold that are named as boilerplate by their attributes (each by its place in the page)."""

    def __init__(self):
        self.total, self.words, self.blocks, self.around = 0, Counter(), Counter(), {}
        self.whole, self.readers = set(), set()      # by a whole name; as comments of readers

    def spared(self) -> set[int]:
        """Those that hold the page's main part or first article, or, on a page that marks neither, most of its words. A whole
        name needs more of them, in several blocks: an advert on a page of few words stays one."""
        if self.around:
            return self.around.get("main", self.around.get("article", set())) | self.around.get("inner", set())
        return {at for at, n in self.words.items() if (2 * n > self.total and at not in self.whole)
                or (5 * n > 4 * self.total and self.blocks[at] >= 3 and at not in self.readers)}


def tokens(page: str) -> Iterator[tuple[str, str | None, bool, bool, bool]]:
    """(kind, text, boilerplate, in content as the page marks it, starts a block) of each tag (text is
    None) and each run of text, in page order."""
    found = Wrappers()
    out = list(_walk(page, set(), found))
    spared = found.spared()
    return _walk(page, spared, Wrappers()) if spared else iter(out)


def _walk(page: str, spared: set[int], found: Wrappers) -> Iterator[tuple[str, str | None, bool, bool, bool]]:
    """The tokens, where the elements ``spared`` aren't boilerplate by their names."""
    stack: list[tuple[str, bool, int]] = []       # (name, boilerplate, place if by its attributes, else -1)
    named: list[int] = []
    boiler = content = links = 0
    at, fresh = 0, True

    def pop(name: str, boil: bool, place: int) -> None:
        nonlocal boiler, content, links
        boiler -= boil
        if place >= 0:
            named.pop()
        content -= name in LABEL_TAGS
        links -= name == "a"

    def run(text: str):
        nonlocal fresh
        block = next((n for n, *_ in reversed(stack) if n not in INLINE), "body")
        kind = f"w:{block if block in BLOCK else 'other'}:{'a' if links else ''}:{'b' if boiler else ''}"
        if boiler == len(named):                  # in no part whose tag is boilerplate
            n = len(text.split())
            found.total += n
            for place in named if n else ():
                found.words[place] += n
                found.blocks[place] += fresh
        token = (kind, text, boiler > 0, content > 0, fresh)
        fresh = False
        return token

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield run(page[at:m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if m["raw"]:
                fresh = True
            continue
        if name not in INLINE:
            fresh = True
        elif name == "br":
            yield run(" ")
        known = name if name in BLOCK or name in INLINE or name in VOID else "other"
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            yield f"t:{known}:{'b' if boiler else ''}", None, boiler > 0, content > 0, False
            if depth >= 0:
                while len(stack) > depth:
                    pop(*stack.pop())
            continue
        if name in BLOCK or name in CLOSED_BY:     # a block closes an open paragraph, with what is open inside it
            closes = CLOSED_BY.get(name, {"p"} if name in BLOCK else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    while len(stack) > i:
                        pop(*stack.pop())
                    break
                if stack[i][0] in BLOCK and stack[i][0] != "p":
                    break
        by_name = boil = False
        if name not in ANCESTORS_KEPT:
            boil = _tag_is_boilerplate(name, content > 0)
            by_name = not boil and m.start() not in spared and _names_boilerplate(m["attrs"], content > 0)
            boil |= by_name
        if name not in VOID and not m["attrs"].endswith("/"):
            if name in LABEL_TAGS and boiler == len(named):
                found.around.setdefault("inner" if name == "article" and content else name, set(named))
            stack.append((name, boil, m.start() if by_name else -1))
            if by_name:
                named.append(m.start())
                if _names_boilerplate(m["attrs"], True):
                    found.whole.add(m.start())
                if _names_boilerplate(m["attrs"], False, READER_WORDS):
                    found.readers.add(m.start())
            boiler += boil
            content += name in LABEL_TAGS
            links += name == "a"
        yield f"t:{known}:{'b' if boiler else ''}", None, boiler > 0, content > 0, False
    if at < len(page):
        yield run(page[at:])


# ---- weights -------------------------------------------------------------------

PRIOR = 20.0             # words or tags that the prior counts for
WORD_SHARE, BOILER_SHARE = 0.8, 0.02


def count_kinds(page: str) -> Counter:
    """(kind, inside) -> words or tags, for a page that marks its content; else nothing."""
    found: Counter = Counter()
    marked = False
    for kind, text, boiler, content, _ in tokens(page):
        marked |= content
        n = 1 if text is None else len(text.split())
        if n:
            found[(kind, content and not boiler)] += n
    return found if marked else Counter()


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """kind -> score, from kind -> (inside, outside)."""
    return {k: _score(k, *c) for k, c in counts.items()}


def _score(kind: str, inside: int = 0, outside: int = 0) -> float:
    prior = BOILER_SHARE if kind.endswith(":b") else WORD_SHARE
    share = (inside + PRIOR * prior) / (inside + outside + PRIOR)
    odds = math.log(share / (1 - share)) if share < 1 else 8.0
    # Named boilerplate is left out of the text wherever it stands, so it may be bridged at a low cost.
    low = 8.0 if kind.endswith(":b") else 1.0
    if kind.startswith("w:"):
        return max(-4.0 / low, min(4.0, odds))
    return max(-4.0 / low, min(-0.05, (odds - 1.5) / low))


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, last) with the largest positive sum, the first of equals; (0, 0) if none is positive."""
    best, region, total, first = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += s
        if total > best:
            best, region = total, (first, i + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    seq = list(tokens(page or ""))
    scores = []
    for kind, text, *_ in seq:
        s = weights.get(kind)
        if s is None:
            s = _score(kind)
        scores.append(s if text is None else s * len(text.split()))
    first, last = best_region(scores)
    blocks: list[list[str]] = []
    for i in range(first, last):
        _, text, boiler, _, fresh = seq[i]
        if text is None:
            continue
        if fresh or not blocks:
            blocks.append([])
        if not boiler:
            blocks[-1].append(text)
    clean = (" ".join(htmllib.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


# ---- the operator --------------------------------------------------------------

def train(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all pages that mark their content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "_html"):
                for page in part.column(0).to_pylist():
                    total.update(count_kinds(page))
        if total:
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([i for _, i in keys]), pa.array([total[k] for k in keys], pa.int64())],
                                             ["kind", "inside", "n"])

    counts = (pages.select(text_of(f"`{html_col}`").alias("_html")).mapInArrow(run, "kind string, inside boolean, n long")
                   .groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"),
                                        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")))
    return weigh({r["kind"]: (r["i"], r["o"]) for r in counts.collect()})


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html",
            weights: dict[str, float] | None = None) -> DataFrame:
    """The ``id_cols``, text and n_chars of every page. Without ``weights`` they are learned from ``pages``."""
    weights = train(pages, html_col) if weights is None else weights
    fields = [pages.schema[c] for c in id_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = [main_text(p, weights) for p in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 [*part.schema.names[:-1], "_text", "_n"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType
    schema = StructType([*[StructField(f"_k{i}", f.dataType) for i, f in enumerate(fields)], StructField("_text", StringType()), StructField("_n", LongType())])
    base = pages.select(*[F.col(f"`{f.name}`").alias(f"_k{i}") for i, f in enumerate(fields)], text_of(f"`{html_col}`").alias("_html"))
    return base.mapInArrow(run, schema).toDF(*id_cols, "text", "n_chars")

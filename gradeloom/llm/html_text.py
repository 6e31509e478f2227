"""Main text of web pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score by where they stand (the elements around them, and the words in
their class, id and role), tags score negative; the weights are learned from labelled pages. One linear scan finds the
run with the largest sum. Blocks inside it whose words score negative (an advert between two paragraphs, say) are
left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.blocks import slices

# Elements of the page language by their use.
_WITHOUT_TEXT = "script style head title noscript template iframe object svg canvas textarea select button audio video map"
_INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike"
    " strong sub sup time tt u var wbr img"
)
_VOID = "area base br col embed hr img input link meta param source track wbr"
_CONTAINERS = (
    "nav header footer aside article main section div form fieldset ul ol dl menu table figure figcaption details dialog"
    " blockquote a"
)
#: Elements that end where one of the given ones begins, if their end tag is left out.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",)}
WITHOUT_TEXT, INLINE, VOID, CONTAINERS = (frozenset(x.split()) for x in (_WITHOUT_TEXT, _INLINE, _VOID, _CONTAINERS))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|noscript|textarea|title|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MARK_WORDS = re.compile(r"[a-z]+")
#: Ends of compound marks, such as that of ``usercomments``, which count as marks too.
_MARK_ENDS = re.compile(r"[a-z](comment|advert|sidebar|navbar|menu|cookie|newsletter|breadcrumb|footer|disqus)s?$")
_HIDDEN = re.compile(r"\shidden(?:\s|=|>|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)


#: Inline elements and paragraphs hold no blocks: they count while they are open, and only for their marks.
MARKED_ONLY = (INLINE - {"a"}) | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 body html".split())


def _marks(token: str) -> set[str]:
    """Words of the class, id, role and label of a tag."""
    out = set()
    for mark in _MARKS.finditer(token):
        for w in _MARK_WORDS.findall((mark[1] or mark[2] or mark[3] or "").lower()):
            out.add("." + w)
            out.update(f".{e}" for e in _MARK_ENDS.findall(w))
    return out


@dataclass
class Block:
    """Text between two block borders, the features of its place, and the tags just before it."""

    text: str
    place: frozenset[str]
    tags: list[str]


def blocks(page: str) -> Iterator[Block]:
    """Blocks of a page in order. Comments, scripts and other elements without text have none."""
    open_: list[tuple[str, frozenset[str]]] = []
    silent = 0  # depth of elements without text
    pieces: list[str] = []
    tags: list[str] = []
    place: frozenset[str] = frozenset()
    before: list[str] = []
    at = 0

    def flush() -> Iterator[Block]:
        nonlocal pieces, before
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            yield Block(text, place, before)
            before = []
        pieces = []

    for m in (*_TOKEN.finditer(page), None):
        raw = page[at : m.start() if m else len(page)]
        if raw and not silent:
            here = frozenset().union(*(f for _, f in open_))
            if raw.strip() and not "".join(pieces).strip():
                place = here
            elif raw.strip():
                place &= here  # a paragraph with a link in it is no link
            pieces.append(raw)
        if m is None:
            break
        at = m.end()
        token = m.group()
        name_found = _NAME.match(token)
        if m.group(1) or not name_found:
            if token.startswith("<![CDATA["):
                pieces.append(html.escape(token[9:].removesuffix("]]>")))
            continue
        name = name_found[1].lower()
        closing = token[1] == "/"
        if name not in INLINE:
            yield from flush()
            before.append(("/" if closing else "") + name)
            # Marked inline elements and paragraphs end at the next border of a block, cells and items at the next one.
            while open_ and (open_[-1][0] in MARKED_ONLY or open_[-1][0] in ENDED_BY and not closing and name in ENDED_BY[open_[-1][0]]):
                silent -= "hidden" in open_.pop()[1]
        if name in VOID or token.endswith("/>") and name not in CONTAINERS:
            continue
        if closing:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if depth is not None:
                silent -= sum(n in WITHOUT_TEXT or "hidden" in f for n, f in open_[depth:])
                del open_[depth:]
        elif name not in CONTAINERS and name not in WITHOUT_TEXT:
            features = _marks(token) if name not in HEADINGS else set()
            if _HIDDEN.search(token):
                features.add("hidden")
            if features:
                open_.append((name, frozenset(features)))
                silent += "hidden" in features
        else:
            if name in ("article", "main"):  # an unclosed menu or advert does not go on into the article
                while open_ and open_[-1][0] not in ("article", "main", "section", "div"):
                    gone, f = open_.pop()
                    silent -= gone in WITHOUT_TEXT or "hidden" in f
            features = {name} | _marks(token)
            if name == "a" and any(n in ("article", "main") for n, _ in open_):
                features = {"inner-a"} | features - {"a"}
            if name == "header" and any(n in ("article", "main", "section") for n, _ in open_):
                features = {"inner-header"} | features - {"header"}
            if name == "footer" and any(n == "article" for n, _ in open_):
                features.add("inner-footer")
            if _HIDDEN.search(token):
                features.add("hidden")
            open_.append((name, frozenset(features)))
            silent += name in WITHOUT_TEXT or "hidden" in features
    yield from flush()


#: Labelled pages: containers of main text and of everything else, in the ways pages write them. From these the
#: training pages are put together; a ``*`` stands for text.
MAIN = (
    "<article><h1>*</h1><p>*</p><p>*</p></article>",
    "<article><h1>*</h1><p><b>*<br><p>*</p><p>*</p><ul><li>*</li><li>*</li></ul></article>",
    "<main><article><header><h1>*</h1></header><section><h2>*</h2><p>*</p></section></article></main>",
    "<main id='content'><h1>*</h1><p>*</p><blockquote>*</blockquote><p>*</p></main>",
    "<div class='post-content'><h2>*</h2><p>*</p><p>*</p><ol><li>*</li></ol></div>",
    "<div id='main'><div class='entry article-body'><h1>*</h1><p>*</p><table><tr><td>*</td></tr></table></div></div>",
    "<section class='story text'><h1>*</h1><p>*</p><figure><figcaption>*</figcaption></figure><p>*</p></section>",
    "<article class='content page'><div class='body'><p>*</p><p>*</p><p>*</p></div></article>",
    "<h1>*</h1><p>*</p><p>*</p><p>*</p>",
    "<div class='content'><h1>*</h1><p>*</p><p>* <a href='/'>*</a> *</p></div>",
    "<div class='article'><h1>*</h1><p>*</p><h3>*</h3><p>*</p><pre>*</pre></div>",
    "<div class='wrapper container page'><div class='text'><p>*</p><p>*</p></div></div>",
    "<div><div><h1>*</h1><p>*</p></div><div><p>*</p><ul><li>*</li><li>*</li></ul></div></div>",
    "<article><h1>*</h1><p><a href='/'>*</a></p><p>*</p><ul><li><a href='/'>*</a></li><li>*</li></ul><p>*</p></article>",
    "<main><h1>*</h1><p>*</p><p><a href='/'>*</a></p><ol><li><a href='/'>*</a></li></ol></main>",
    "<section><h2>*</h2><p>*</p><p>*</p></section><section><h2>*</h2><p>*</p><dl><dt>*</dt><dd>*</dd></dl></section>",
)
OTHER = (
    "<nav><ul><li><a href='/'>*</a></li><li><a href='/'>*</a></li><li><a href='/'>*</a></li></ul></nav>",
    "<div class='menu nav navbar navigation'><ul><li><a href='/'>*</a></li></ul></div>",
    "<div class='topbar toolbar masthead banner header'><a href='/'>*</a> <p>*</p></div>",
    "<header><div class='logo brand'>*</div><p>*</p><h1>*</h1></header>",
    "<header class='site-header'><h2>*</h2><a href='/'>*</a></header>",
    "<footer><p>*</p>&copy; *</footer>",
    "<div class='footer site-footer copyright legal'>* &middot; <a href='/'>*</a></div>",
    "<aside><h3>*</h3><p>*</p><ul><li><a href='/'>*</a></li></ul></aside>",
    "<div id='sidebar' class='sidebar widget rail'><p>*</p></div>",
    "<div class='ad ads advert advertisement adbox sponsor sponsored promo promoted promotion'>*</div>",
    "<aside class='ad'><p>*</p></aside>",
    "<div class='notice cookie cookies consent gdpr banner privacy alert warning popup modal overlay'><p>*</p></div>",
    "<section class='notice'><p>*</p></section>",
    "<form action='/s'><label>*</label><input><p>*</p><button>*</button></form>",
    "<div class='subscribe newsletter signup login search'><p>*</p></div>",
    "<section class='comments' id='comments'><h3>*</h3><div class='comment reader'><p>*</p></div><p>*</p></section>",
    "<div class='comment-list discussion responses replies reply respond disqus'><div class='comment'><p>*</p></div></div>",
    "<ol class='comments commentlist'><li class='comment'><p>*</p></li></ol>",
    "<article class='comment'><p>*</p></article>",
    "<div class='related recommended more trending popular teaser links'><a href='/'>*</a><p>*</p></div>",
    "<div class='share social sharing follow buttons breadcrumb breadcrumbs pagination pager tags meta byline'>*</div>",
    "<div role='navigation'><a href='/'>*</a></div><div role='complementary'>*</div><div role='contentinfo'>*</div>",
    "<dialog><p>*</p></dialog><menu><li>*</li></menu>",
    "<div hidden>*</div>",
    "<nav>* * *</nav>",
    "<nav><p>*</p></nav><nav><ul><li>*</li><li>*</li></ul></nav>",
    "<div class='menu nav navbar navigation'>* * *</div>",
    "<ul class='menu nav navbar navigation'><li>*</li><li>*</li></ul>",
    "<div id='disqus'><p>*</p></div>",
    "<p class='ad advert sponsored promo comment notice'>*</p>",
    "<ul><li class='comment ad sponsored reply promo'>*</li></ul>",
    "<table><tr><td class='sidebar ad menu'>*</td></tr></table>",
    "<span class='sponsored ad advert promo'>*</span>",
)


def _one_mark(markup: str, turn: int) -> str:
    """The markup with one word of each class, a different one each turn."""

    def one(m: re.Match) -> str:
        words = m[1].split()
        return f"class='{words[turn % len(words)]}'"

    return re.sub(r"class='([^']*)'", one, markup)


def labelled_pages() -> list[list[tuple[str, bool]]]:
    """Training pages as parts of (markup, whether it is main text): every other part by every main part, also
    inside it."""
    pages = []
    for k, main in enumerate(MAIN):
        for j, other in enumerate(OTHER):
            other, around = _one_mark(other, k), _one_mark(OTHER[(j + k + 1) % len(OTHER)], k + j)
            pages.append([("<html><body>", False), (around, False), (main, True), (other, False), ("</body></html>", False)])
            cut = main.find("<p>", main.find("<p>") + 1)
            if cut > 0 and not other.startswith("<header"):
                pages.append([("<html><body>", False), (main[:cut], True), (other, False), (main[cut:], True)])
    return pages


@dataclass
class PageModel:
    """Scores of words by the features of their place, and of tags by their name."""

    words: dict[str, float]
    bias: float
    tags: dict[str, float]
    other_tag: float

    def word(self, place: frozenset[str]) -> float:
        """Score of each word of a block, from -0.1 to 1: what lies between two parts of a text must not part them."""
        score = float(np.tanh(0.5 * (self.bias + sum(self.words.get(f, 0.0) for f in place))))
        return score if score > 0 else 0.1 * score

    def main_blocks(self, found: list[Block]) -> list[str]:
        """Texts of the blocks of the maximum-scoring run that score positive themselves."""
        best, best_sum, start, running = (0, 0), 0.0, 0, 0.0
        scores = [self.word(b.place) for b in found]
        for k, b in enumerate(found):
            running += sum(self.tags.get(t, self.other_tag) for t in b.tags)
            if running <= 0:
                running, start = 0.0, k
            running += scores[k] * (1 + b.text.count(" "))
            if running > best_sum:
                best, best_sum = (start, k + 1), running
        return [b.text for b, s in zip(found[slice(*best)], scores[slice(*best)]) if s > 0]


def fit_pages(pages: list[list[tuple[str, bool]]], turns: int = 10_000, rate: float = 1.0, penalty: float = 1e-5) -> PageModel:
    """Logistic regression of blocks on the features of their places; tags by how often they stand before others."""
    seen: list[tuple[frozenset[str], bool]] = []
    near: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for parts in pages:
        labels = [main for markup, main in parts for _ in range(markup.count("*"))]
        page = "".join(markup for markup, _ in parts)
        marked, n = "", 0
        for piece in re.split(r"(\*)", page):
            marked += f"w{n}" if piece == "*" else piece
            n += piece == "*"
        for b in blocks(marked):
            numbers = [int(x) for x in re.findall(r"\bw(\d+)\b", b.text)]
            if numbers:
                main = labels[numbers[0]]
                seen.append((b.place, main))
                for t in b.tags:
                    near[t][main] += 1
    names = sorted({f for place, _ in seen for f in place})
    kinds = Counter(seen)
    x = np.array([[f in place for f in names] for place, _ in kinds], float).reshape(len(kinds), len(names))
    y, count = np.array([main for _, main in kinds], float), np.array(list(kinds.values()), float)
    weights, bias = np.zeros(len(names)), 0.0
    for _ in range(turns if len(y) else 0):
        error = (y - 1 / (1 + np.exp(-(x @ weights + bias)))) * count / count.sum()
        weights += rate * len(names) ** 0.5 * (x.T @ error - penalty * weights)
        bias += rate * error.sum()
    tags = {t: -0.05 - 0.5 * (o + 0.5) / (o + m + 1) for t, (o, m) in near.items()}
    return PageModel(dict(zip(names, weights.tolist())), bias, tags, -0.3)


def main_texts(
    pages: DataFrame, page: str = "html", model: PageModel | None = None, text: str = "text"
) -> DataFrame:
    """All columns of ``pages`` but the markup, with ``text`` and ``n_chars long`` (code points).

    Character references are decoded; white space inside a block becomes one space, and blocks are joined by one space
    in page order. Null and empty pages, and pages without main text, have an empty text. Whole pages are read.
    Class, id, role and hidden marks count on every element but headings. Columns called as the results are replaced; repeated rows stay; an empty table gives no rows. ``model`` defaults to
    one trained on ``labelled_pages()``.
    """
    model = model or fit_pages(labelled_pages())
    kept = [c for c in pages.columns if c.lower() not in (page.lower(), text.lower(), "n_chars")]
    markup = "__page"
    while markup in {c.lower() for c in kept}:
        markup = f"_{markup}"
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{page}`").cast("string").alias(markup))
    schema = rows.drop(markup).schema.add(text, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, markup):
            texts = [" ".join(model.main_blocks(list(blocks(p or "")))) for p in batch.column(markup).to_pylist()]
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != markup]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, text, "n_chars"])

    return rows.mapInArrow(run, schema)

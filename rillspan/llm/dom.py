"""A forgiving HTML tree and numbers that describe its elements."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

#: A whole start or end tag.  Quotes hold a value after ``=`` only, and nothing is ever given back, so the scan is linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>\x00]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
CUT = re.compile(r"""</?[a-zA-Z][^\s<>=]*+(?:\s++[^\s=<>"']++\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s<>]*+))*+\s*+""")
PART = re.compile(r"[a-z]+")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.  Without an end tag the first kind goes on to the end of the page, the second is empty.
RAW = frozenset("script style textarea title xmp iframe noembed".split())
ENDLESS = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html caption dd dt li td th tr tbody thead tfoot legend".split())
#: An element of the key's kind ends an open one of the values' kinds, up to the given containers.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}

# Words of class, id and role attributes, by what they speak for.
SPEAKS = {
    "content": "article content main post entry story text prose body hentry read paragraph blog detail",
    "menu": "nav navigation menu navbar menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs skip links topbar",
    "frame": "header head masthead banner top brand logo footer foot bottom copyright legal colophon imprint contentinfo",
    "side": "sidebar side aside rail secondary widget complementary related recommended recommend more popular trending latest tags tag",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion promoted banner dfp adsense commercial teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall privacy toast disclaimer dialog",
    "talk": "comment comments reply replies respond discussion disqus thread feedback review reviews responses commentlist",
    "share": "share sharing social follow facebook twitter buttons tools toolbar actions meta byline author print",
    "form": "form search login signin register contact input field submit poll survey",
    "hide": "hidden hide invisible sr screen reader noprint offscreen",
}
GROUPS = list(SPEAKS)
_GROUP_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(SPEAKS.values()):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_k)
TAGS = (
    "html head body div span p a b i em strong h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th article section main"
    " nav header footer aside form button label figure figcaption blockquote pre img br hr details summary address"
).split()
_TAG_NO = {t: n for n, t in enumerate(TAGS)}


#: Elements nested deeper belong to the element at this depth, so that no page costs more than linear time.
MAX_DEPTH = 256


def tokens(html: str):
    """Pieces of a page in order: ``(None, text, False)`` or ``(name, attributes, closing)``.

    A ``<`` that starts no tag is text.  A tag that never ends when quotes are
    observed ends at its next ``>``, as do all tags after it; with no ``>`` left
    only what looks like a cut-off tag goes.  Comments without an end stop at
    their first ``>``.  Every search that fails is never tried again.
    """
    at, held, n, strict, comments = 0, 0, len(html), True, True
    unended: set[str] = set()
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= n:
            break
        mark = html[at + 1]
        if mark == "!" or mark == "?":
            stop = -1
            if comments and html.startswith("<!--", at):
                stop = html.find("-->", at + 2)
                comments = stop >= 0
            stop = stop + 2 if stop >= 0 else html.find(">", at)
            if stop < 0:
                break
            if at > held:
                yield None, html[held:at], False
            at = held = stop + 1
            continue
        name_at = at + 2 if mark == "/" else at + 1
        if name_at >= n or not (html[name_at].isascii() and html[name_at].isalpha()):
            at += 1
            continue
        m = TAG.match(html, at) if strict else None
        if m is None:
            strict = False
            stop = html.find(">", at)
            if stop < 0:
                cut = CUT.match(html, at)
                if cut.end() == n or "=" in cut.group():
                    if at > held:
                        yield None, html[held:at], False
                    held = cut.end()
                break
            name, _, rest = html[name_at:stop].partition(" ")
            name = name.split(None, 1)[0].partition("/")[0]
            if at > held:
                yield None, html[held:at], False
            at = held = stop + 1
        else:
            name, rest = m.group(2), m.group(3)
            if at > held:
                yield None, html[held:at], False
            at = held = m.end()
        name = name.lower()
        yield name, rest, mark == "/"
        if mark != "/" and name in RAW:
            end = None if name in unended else re.compile(f"</{re.escape(name)}(?![a-z0-9-])", re.I).search(html, at)
            if end:
                close = html.find(">", end.end())
                at = held = close + 1 if close >= 0 else n
            elif name in ENDLESS:
                at = held = n
            else:
                unended.add(name)
    if held < n:
        yield None, html[held:], False


class Page:
    """Elements in document order: ``tag, parent, depth, end, speaks``; ``texts`` as (element, text)."""

    def __init__(self, html: str):
        tag, parent, depth, end, speaks = ["html"], [-1], [0], [0], [()]
        texts: list[tuple[int, str]] = []
        stack = [0]
        opened: dict[str, int] = {"html": 1}  # how many of a name are on the stack

        def close_to(k: int) -> None:
            while len(stack) > k:
                e = stack.pop()
                end[e] = len(tag)
                opened[tag[e]] -= 1

        for name, rest, closing in tokens(html):
            if name is None:
                texts.append((stack[-1], rest))
                continue
            if closing:
                if opened.get(name):
                    for k in range(len(stack) - 1, 0, -1):
                        if tag[stack[k]] == name:
                            close_to(k)
                            break
                continue
            if name in ("html", "body") and opened.get(name):
                if name == "html" or len(stack) > 1:
                    continue
            if name in CLOSES_P and opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    t = tag[stack[k]]
                    if t == "p":
                        close_to(k)
                        break
                    if t in BLOCK:
                        break
            if name in IMPLIED:
                ends, stops = IMPLIED[name]
                low = len(stack)
                for k in range(len(stack) - 1, 0, -1):
                    t = tag[stack[k]]
                    if t in stops:
                        break
                    if t in ends:
                        low = k
                close_to(low)
            if name == "body":
                close_to(1)
            me = len(tag)
            tag.append(name)
            parent.append(stack[-1])
            depth.append(len(stack))
            end.append(me + 1)
            speaks.append(_attributes(rest) if rest else ())
            if name in VOID:
                texts.append((stack[-1], " "))
            elif name not in RAW and len(stack) < MAX_DEPTH:
                stack.append(me)
                opened[name] = opened.get(name, 0) + 1
        close_to(0)
        self.tag, self.parent, self.depth, self.end, self.speaks = tag, parent, depth, end, speaks
        self.texts = [(k, unescape(t) if "&" in t else t) for k, t in texts]


def _attributes(text: str) -> tuple[int, ...]:
    out: list[int] = []
    for m in ATTRIBUTE.finditer(text):
        name = m.group(1).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m.group(2) or m.group(3) or m.group(4) or "").lower()):
                out += _GROUP_OF.get(word, ())
        elif name == "hidden":
            out.append(GROUPS.index("hide"))
    return tuple(out)


NUMBERS = (
    "tag parent_tag depth own total share links marks words paragraphs headings controls elements per_element"
    " place order siblings alike before after first_block runs sentence"
    " size_rank share_of_parent lead_over_next prose_share titles title_before title_on_page articles_on_page mains_on_page"
    " words_on_page below_article below_main below_frame below_form content_words copyright"
).split()
N_FEATURES = len(NUMBERS) + 3 * len(GROUPS)


def describe(page: Page) -> np.ndarray:
    """One row of numbers for each element."""
    n = len(page.tag)
    parent = np.array(page.parent)
    parent[0] = 0
    end, depth = np.array(page.end), np.array(page.depth, float)
    end[0] = n
    tag = np.array([_TAG_NO.get(t, len(TAGS)) for t in page.tag])
    at = np.arange(n)
    own, marks, words, runs, stops, rights = (np.zeros(n) for _ in range(6))
    for k, text in page.texts:
        size = len(text)
        if size and not text.isspace():
            own[k] += size
            marks[k] += text.count(",") + text.count(".")
            words[k] += text.count(" ") + 1
            runs[k] += 1
            rights[k] += text.count("\xa9")
            stops[k] += text.count(". ") + text.rstrip().endswith((".", "!", "?"))

    def under(x: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0.0], np.cumsum(x)))
        return upto[end] - upto[at]

    named = lambda *names: np.isin(tag, [_TAG_NO[t] for t in names])
    link = named("a")
    # text inside links, at whatever depth
    cover = np.zeros(n + 1)
    np.add.at(cover, at[link], 1)
    np.add.at(cover, end[link], -1)
    linked = under(own * (np.cumsum(cover[:n]) > 0))
    total, count = under(own), (end - at).astype(float)
    size = total + 1e-9
    paragraph = named("p")
    # order and number of siblings
    by_parent = np.argsort(parent[1:], kind="stable") + 1 if n > 1 else np.zeros(0, int)
    first = np.searchsorted(parent[by_parent], parent)
    rank = np.zeros(n)
    rank[by_parent] = np.arange(n - 1) - first[by_parent]
    siblings = np.bincount(parent[1:], minlength=n)[parent] if n > 1 else np.ones(1)
    same = tag * (n + 1) + parent
    _, inverse, alike = np.unique(same, return_inverse=True, return_counts=True)
    upto = np.concatenate(([0.0], np.cumsum(own)))
    whole = upto[-1] + 1e-9
    kinds = np.zeros((n, len(GROUPS)))
    for k, groups in enumerate(page.speaks):
        for g in groups:
            kinds[k, g] += 1
    # what any ancestor's attributes and tags say: parents come before children
    semantic = np.stack([named("article"), named("main"), named("nav", "header", "footer", "aside"), named("form")], 1)
    over = np.hstack([kinds, semantic])
    for k in range(1, n):
        np.maximum(over[k], over[parent[k]], out=over[k])
    above = over[:, : len(GROUPS)]
    # rank by text among the siblings, and how far ahead of the next
    by_size = np.lexsort((-total, parent))
    start = np.searchsorted(parent[by_size], parent[by_size])
    size_rank, lead = np.zeros(n), np.zeros(n)
    size_rank[by_size] = np.arange(n) - start
    largest = total[by_size[start]]
    second = total[by_size[np.minimum(start + 1, n - 1)]]
    lead[by_size] = np.where(size_rank[by_size] == 0, second, largest) / (total[by_size] + 1)
    prose = under(np.where(paragraph | np.isin(tag[parent], [_TAG_NO["p"]]), own, 0.0))
    title = named("h1")
    titles = under(title.astype(float))
    title_before = np.cumsum(title) - title
    articles, mains = named("article").sum(), named("main").sum()
    inside = np.stack([np.log1p(under(kinds[:, g])) for g in range(len(GROUPS))], 1)
    columns = [
        tag, np.where(at == 0, -1, tag[parent]), depth, np.log1p(own), np.log1p(total), total / whole, linked / size,
        under(marks) / size, under(words) / size, np.log1p(under(paragraph.astype(float))),
        np.log1p(under(named("h1", "h2", "h3").astype(float))), np.log1p(under(named("form", "button", "label").astype(float))),
        np.log1p(count), np.log1p(total / count), upto[at] / whole, rank, siblings, alike[inverse],
        np.where(at == 0, 0, total[parent] - total) / whole, 1 - upto[end] / whole,
        np.minimum.accumulate(np.where(paragraph & (total > 60), at, n))[-1] <= at, np.log1p(total / (under(runs) + 1e-9)),
        np.log1p(under(stops)),
        size_rank, total / (total[parent] + 1), np.log1p(lead), prose / (prose[0] + 1), titles, title_before, np.full(n, title.sum()),
        np.full(n, articles), np.full(n, mains), np.log1p(np.full(n, whole)), over[:, -4], over[:, -3], over[:, -2], over[:, -1],
        np.full(n, kinds[:, 0].sum()), np.log1p(under(rights)),
    ]
    return np.hstack([np.stack([np.asarray(c, np.float32) for c in columns], 1), kinds, above, inside]).astype(np.float32)


def blocks(page: Page, kept: np.ndarray) -> list[str]:
    """Text of the kept elements by block, white space folded."""
    owner = [0] * len(page.tag)  # the block element around each element
    for k in range(1, len(page.tag)):
        owner[k] = k if page.tag[k] in BLOCK else owner[page.parent[k]]
    out, held, last = [], [], None
    for k, text in page.texts:
        if owner[k] != last:
            out.append(held)
            held, last = [], owner[k]
        if kept[k]:
            held.append(text)
    out.append(held)
    joined = (" ".join("".join(h).split()) for h in out if h)
    return [t for t in joined if t]

"""Made-up pages whose main text is known, to train the extractor on.

A page is a list of marked-up parts; ``<x>`` wraps what is not main text and
``<c>`` what is.  The marks become the elements' classes and then vanish.
"""

from __future__ import annotations

import random
import re
import string

from rillspan.llm.dom import Page

OUTSIDE, CONTENT, AWAY = range(3)


def _vocabulary(count: int = 900) -> list[str]:
    r = random.Random(1)
    return ["".join(r.choices(string.ascii_lowercase, k=r.choice((2, 3, 4, 5, 6, 7, 9)))) for _ in range(count)]


WORDS = _vocabulary()


def _word(r: random.Random) -> str:
    return r.choice(WORDS)


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _prose(r: random.Random, low: int = 1, high: int = 6) -> str:
    shout = r.random()
    out = []
    for _ in range(r.randint(low, high)):
        words = [_word(r) for _ in range(r.randint(1, 22))]
        if shout < 0.06:
            words = [w.upper() + "!!" for w in words]
        elif shout < 0.12:
            words = [w + r.choice(("***", "$$$", "&amp;&amp;&amp;", "%%%", "###")) for w in words]
        elif shout < 0.16:
            words = [w + " |" for w in words]
        elif shout < 0.19:
            words = [words[0]] * len(words)
        if len(words) > 4 and r.random() < 0.2:
            k = r.randrange(len(words) - 2)
            mark = r.choice(("b", "i", "em", "strong", "a href='/x'", "span", "code"))
            words[k] = f"<{mark}>{words[k]}"
            words[k + 1] += f"</{mark.split()[0]}>"
        if r.random() < 0.4 and len(words) > 3:
            words[len(words) // 2] += ","
        out.append(" ".join(words).capitalize() + ".")
    return " ".join(out)


def _attr(r: random.Random, names: str, always: bool = False) -> str:
    if not always and r.random() < 0.3:
        return ""
    name = r.choice(names.split())
    name = r.choice((name, f"{name}-{_word(r)}", f"{_word(r)}-{name}", f"{name} {_word(r)}", name))
    return f' {r.choice(("class", "class", "id"))}="{name}"'


def _links(r: random.Random) -> str:
    items = [f'<a href="/{_word(r)}">{_words(r, 1, 3)}</a>' for _ in range(r.randint(3, 9))]
    if r.random() < 0.6:
        kind = r.choice(("ul", "ol"))
        return f"<{kind}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{kind}>"
    return r.choice((" | ", " ", "<br>")).join(items)


def _away(r: random.Random, kind: str) -> str:
    """One part that is not main text."""
    if kind == "nav":
        body = _links(r)
        if r.random() < 0.6:
            return f"<nav{_attr(r, 'nav menu topbar navbar')}>{body}</nav>"
        return f"<div{_attr(r, 'nav menu navigation breadcrumb navbar links', True)}>{body}</div>"
    if kind == "header":
        body = r.choice(("", f"<h1>{_words(r, 1, 4)}</h1>", f"<h2>{_words(r, 1, 3)}</h2>")) + r.choice((f"<p>{_words(r, 2, 8)}</p>", _links(r), _words(r, 1, 5)))
        if r.random() < 0.6:
            return f"<header{_attr(r, 'header site masthead top')}>{body}</header>"
        return f"<div{_attr(r, 'header masthead banner logo brand', True)}>{body}</div>"
    if kind == "footer":
        body = f"&copy; {_word(r)}.example &middot; {_prose(r, 1, 4)}" + r.choice(("", _links(r), f"<p>{_prose(r, 1, 2)}</p>"))
        if r.random() < 0.65:
            return f"<footer{_attr(r, 'footer foot site bottom')}>{body}</footer>"
        return f"<div{_attr(r, 'footer foot copyright legal bottom imprint', True)}>{body}</div>"
    if kind == "ad":
        body = r.choice((_prose(r, 1, 3), f"<p>{_prose(r, 1, 2)}</p>", f'<a href="/{_word(r)}"><img src="x">{_words(r, 1, 6)}</a>'))
        mark = r.choice(("div", "div", "div", "section", "aside", "div" if "<p" in body else "p"))
        return f"<{mark}{_attr(r, 'ad ads advert advertisement sponsored promo banner promotion adsense sponsor', True)}>{body}</{mark}>"
    if kind == "notice":
        body = r.choice((_prose(r, 1, 3), f"<p>{_prose(r, 1, 2)}</p>")) + r.choice(("", f"<button>{_words(r, 1, 2)}</button>"))
        mark = r.choice(("div", "div", "section", "aside", "dialog"))
        return f"<{mark}{_attr(r, 'cookie consent notice popup newsletter subscribe alert gdpr modal paywall privacy', True)}>{body}</{mark}>"
    if kind == "side":
        body = f"<h3>{_words(r, 1, 4)}</h3>" * (r.random() < 0.6) + r.choice((_links(r), f"<p>{_prose(r, 1, 4)}</p>", _links(r) + f"<p>{_prose(r, 1, 2)}</p>"))
        if r.random() < 0.5:
            return f"<aside{_attr(r, 'sidebar related side widget')}>{body}</aside>"
        return f"<{(m := r.choice(('div', 'section')))}{_attr(r, 'sidebar related rail widget recommended popular trending latest side secondary', True)}>{body}</{m}>"
    if kind == "talk":
        one = lambda: r.choice((
            f"<div{_attr(r, 'comment reply')}><b>{_word(r)}</b><p>{_prose(r, 1, 4)}</p></div>",
            f"<li{_attr(r, 'comment reply review')}>{_prose(r, 1, 3)}</li>",
            f"<article{_attr(r, 'comment reply review', True)}><p>{_prose(r, 1, 4)}</p></article>",
            f"<p>{_prose(r, 1, 3)}</p>",
        ))
        head = r.choice(("", f"<h2>{_words(r, 1, 3)}</h2>", f"<h3>{_words(r, 1, 3)}</h3>"))
        mark = r.choice(("div", "section", "ul", "ol", "section"))
        return f"<{mark}{_attr(r, 'comments comment discussion replies responses disqus reviews commentlist', True)}>{head}{''.join(one() for _ in range(r.randint(1, 7)))}</{mark}>"
    if kind == "share":
        return f"<div{_attr(r, 'share social follow sharing buttons tools', True)}>{_links(r)}</div>"
    fields = "".join(f"<label>{_words(r, 1, 3)}</label><input name='{_word(r)}'>" for _ in range(r.randint(1, 4)))
    return f"<form{_attr(r, 'form search login contact signup')}>{r.choice(('', f'<p>{_prose(r, 1, 2)}</p>'))}{fields}<button>{_words(r, 1, 2)}</button></form>"


def _x(r: random.Random, *kinds: str) -> str:
    # an open paragraph would end inside the mark and take it along
    return f"</p><x>{_away(r, r.choice(kinds))}</x>"


def _body(r: random.Random) -> str:
    """The main text's blocks, perhaps with something foreign between them."""
    out = [f"<h1>{_words(r, 2, 9)}</h1>"] if r.random() < 0.8 else []
    for k in range(r.choice((1, 2, 3, 5, 8, 14))):
        pick = r.random()
        if pick < 0.72:
            out.append(r.choice((f"<p>{_prose(r)}</p>", f"<p>{_prose(r)}", f"<p><b>{_prose(r, 1, 3)}<br><p>{_prose(r)}</p>", f"<p>{_words(r, 1, 2)}.</p>")))
        elif pick < 0.8:
            out.append(f"<h2>{_words(r, 1, 6)}</h2><p>{_prose(r)}</p>")
        elif pick < 0.86:
            out.append("<ul>" + "".join(f"<li>{_prose(r, 1, 1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif pick < 0.9:
            out.append(f"<blockquote><p>{_prose(r, 1, 2)}</p></blockquote>")
        elif pick < 0.94:
            out.append("<table>" + "".join(f"<tr><td>{_words(r, 1, 3)}</td><td>{_words(r, 1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
        elif pick < 0.97:
            out.append(f"<figure><img src='x'><figcaption>{_words(r, 3, 9)}</figcaption></figure>")
        else:
            out.append(f"<pre>{_words(r, 4, 20)}</pre>")
        if r.random() < 0.06:
            out.append(_x(r, "ad", "side", "share", "notice", "form"))
    return "".join(out)


def _page(r: random.Random) -> str:
    body = _body(r)
    if r.random() < 0.25:
        body += _x(r, "share", "side", "talk", "form", "ad")
    mark = r.random()
    if mark < 0.5:
        main = f"<c><article{_attr(r, 'article post story entry')}>{body}</article></c>"
    elif mark < 0.65:
        main = f"<c><main{_attr(r, 'main content')}>{body}</main></c>"
    elif mark < 0.9:
        kind = r.choice(("div", "div", "section"))
        main = f"<c><{kind}{_attr(r, 'content article post entry story text prose main body', r.random() < 0.8)}>{body}</{kind}></c>"
    else:
        main = f"<c>{body}</c>"
    before = [_x(r, k) for k in ("header", "nav", "notice", "ad", "side", "form") if r.random() < 0.42]
    after = [_x(r, k) for k in ("talk", "side", "share", "ad", "notice", "form", "nav", "footer") if r.random() < 0.38]
    if r.random() < 0.6:
        after.append(_x(r, "footer"))
    if r.random() < 0.5:
        r.shuffle(before)
    inner = "".join(before) + main + "".join(after)
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        inner = f"<div{_attr(r, 'wrapper container page site layout wrap')}>{inner}</div>"
    head = f"<head><title>{_words(r, 1, 6)}</title><style>p{{}}</style><script>var a='</p>';</script></head>" if r.random() < 0.8 else ""
    if r.random() < 0.5:
        inner = _plain(r, inner)
    return f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>"


def _plain(r: random.Random, html: str) -> str:
    """The page with some kinds of speaking tags, all of a kind or none, turned to div.

    Those that only an attribute sets apart from the main text keep their tag when they have none.
    """
    for tag in ("article", "main", "section", "nav", "header", "footer", "aside"):
        if r.random() < 0.65:
            bare = "" if tag in ("article", "main", "nav", "footer") else "(?= )"
            opened = re.compile(f"<{tag}{bare}(?=[ >])")
            if bare and re.search(f"<{tag}>", html):
                continue
            html = opened.sub("<div", html).replace(f"</{tag}>", "</div>")
    return html


def labelled(count: int, seed: int = 3):
    """Pages without marks, each with its elements' classes."""
    r = random.Random(seed)
    for _ in range(count):
        marked = Page(_page(r))
        # the marks nest like elements, so an element takes the innermost mark above it
        state = [OUTSIDE] * len(marked.tag)
        new = [-1] * len(marked.tag)
        classes: list[int] = []
        page = object.__new__(Page)
        page.tag, page.parent, page.depth, page.end, page.speaks = [], [], [], [], []
        for k, tag in enumerate(marked.tag):
            above = state[marked.parent[k]] if k else OUTSIDE
            holder = new[marked.parent[k]] if k else -1
            if tag in ("x", "c"):
                state[k], new[k] = (AWAY if tag == "x" else CONTENT), holder
                continue
            state[k] = AWAY if tag == "head" else above
            new[k] = len(page.tag)
            page.tag.append(tag)
            page.parent.append(holder)
            page.depth.append(page.depth[holder] + 1 if holder >= 0 else 0)
            page.end.append(0)
            page.speaks.append(marked.speaks[k])
            classes.append(state[k])
        n = len(page.tag)
        for k in range(n - 1, -1, -1):
            page.end[k] = max(page.end[k], k + 1)
            if page.parent[k] >= 0:
                page.end[page.parent[k]] = max(page.end[page.parent[k]], page.end[k])
        page.texts = [(new[k], t) for k, t in marked.texts]
        yield page, classes

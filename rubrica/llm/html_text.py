"""Main text of web pages by a tree-structured graphical model.

A page is read into a tree of its block elements. Each node is content or not; its own features (tag, words of class and id, its own text's length,
links and punctuation) and the state of its parent give potentials, and sum-product messages, up from the leaves and down from the root,
give each node's exact marginal. A potential on the page as a whole makes the one state in which nothing is content less likely, so that short pages
keep their text. The text of nodes that are content more likely than not, in page order, is the result. The
potentials are trained here on pages whose nodes are labelled, by gradient ascent of their likelihood, for which the same messages give the
expectations. The labelled pages are made by `labelled_pages` from a grammar of layouts.

Nulls: null or empty html has no text. Broken markup never fails: stray ends are ignored, open elements end with the page, `<` without a
tag is text. Pages of any length are read whole. Ties: a node at one half exactly isn't content. Repeated rows are read one by one. An empty table gives no row. Extra columns
are not carried, so their names can't clash.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.llm.common import pieces as cut
from rubrica.llm.common import small_batches

# Element names of the HTML standard, by what they do to a tree of blocks.
RAW = "script style template iframe svg object canvas audio video noembed xmp"
MAY_CLOSE_ITSELF = "svg object canvas audio video"
BLOCKS = set("html head title body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend select option optgroup textarea button label blockquote pre figure figcaption address details summary dialog noscript center hgroup search menu".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head", "title"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
NOT_IN_P = BLOCKS - set("option optgroup button label select textarea legend summary noscript".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?:{'|'.join(MAY_CLOSE_ITSELF.split())})(?=[\s/])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    rf"|<(?P<raw>{'|'.join(RAW.split())})(?=[\s/>])[^>]*+>.*?(?:</(?P=raw)\s*+[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
#: Names that tell what an element holds or lacks, as has-sidebar, not what it is.
ABOUT_OTHERS = re.compile(r"\b(?:has|with|without|no)[-_]+[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\bhidden\b(?!-)|aria-hidden\s*=\s*[\"']?true", re.I)

#: Words of class and id, by what they tell; names that training pages don't use are still known by their group.
GROUPS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager topbar toolbar sitemap tabs links skip",
    "head": "header masthead banner logo branding top hero",
    "foot": "footer bottom copyright legal colophon credits imprint",
    "side": "sidebar aside side rail widget widgets related recommended recommendations popular trending more teaser teasers latest tags",
    "ad": "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner affiliate dfp gpt outbrain taboola",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay paywall disclaimer newsletter subscribe subscription signup login toast message warning dialog alertdialog",
    "talk": "comment comments commentlist reply replies respond discussion disqus thread feedback reviews reader",
    "share": "share sharing social follow twitter facebook buttons author byline meta",
    "form": "form search searchbox input contact login poll survey",
    "good": "article content post entry main story body text articlebody maincontent postcontent entrycontent page prose paragraph",
}
GROUP_OF = {w: [g for g, own in GROUPS.items() if w in own.split()] for own in GROUPS.values() for w in own.split()}
FEATURES: dict[str, int] = {}
for _f in ["bias", *(f"tag:{t}" for t in sorted(BLOCKS)), *(f"group:{g}" for g in GROUPS), *(f"any:{w}" for w in ("good", "bad", "hidden", "neither")), *(f"text:{k}" for k in range(7)), *(f"links:{k}" for k in range(4)), "text:closed", "text:open", "words:1", "words:few", "in:list", "under:bad", "under:article", "text:top", "of:root", "top:text", "top:part", "top:box"]:
    FEATURES[_f] = len(FEATURES)
KINDS = 3  # edges into text blocks, list and table parts, and other containers
TEXT_TAGS, PART_TAGS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split()), set("ul ol li dl dt dd table tbody thead tfoot tr td th caption figure".split())


@dataclass
class Page:
    tags: list[str] = field(default_factory=lambda: ["html"])
    names: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    last: list[str] = field(default_factory=lambda: [""])
    segments: list[tuple[int, str]] = field(default_factory=list)  # node and its text, in page order; node -1: a gap


def parse(source: str) -> Page:
    """The tree of a page's block elements, with their own text."""
    page = Page()
    tags, parent, depth, segments = page.tags, page.parent, page.depth, page.segments
    now, link, at = 0, False, 0

    def text(raw: str) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        segments.append((now, raw))
        bare = raw.strip()
        if bare:
            n = len(bare)
            page.chars[now] += n
            if link:
                page.linked[now] += n
            page.last[now] = bare

    for m in TAG.finditer(source):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["raw"]:
                segments.append((-1, ""))
            continue
        tag = name.lower()
        if tag == "a":
            link = not (m["end"] or m["end2"])
        elif tag in ("br", "hr"):
            segments.append((-1, ""))
        elif tag in BLOCKS:
            segments.append((-1, ""))
            link = False
            if m["end"] or m["end2"]:
                up = now
                while up > 0 and tags[up] != tag:
                    up = parent[up]
                if up > 0:
                    now = parent[up]
                continue
            if tag == "html":
                continue
            if tag in NOT_IN_P:
                up = now
                while up > 0 and tags[up] not in ("p", "td", "li", "div", "article", "section", "main", "body"):
                    up = parent[up]
                if tags[up] == "p":
                    now = parent[up]
            if tag in CLOSES:
                up = now
                while up > 0 and tags[up] in CLOSES[tag]:
                    up = parent[up]
                now = up
            attrs = m["attrs"] or m["attrs2"] or ""
            tags.append(tag)
            page.names.append(attrs)
            parent.append(now)
            depth.append(depth[now] + 1)
            page.chars.append(0)
            page.linked.append(0)
            page.last.append("")
            now = len(tags) - 1
    if at < len(source):
        text(source[at:])
    return page


_NAMES: dict[str, tuple[int, ...]] = {}


def name_features(attrs: str) -> tuple[int, ...]:
    if (known := _NAMES.get(attrs)) is None:
        words = {w for x in NAMES.findall(attrs) for w in NAME_WORD.findall(ABOUT_OTHERS.sub(" ", x.lower()))}
        groups = {g for w in words for g in GROUP_OF.get(w, GROUP_OF.get(w.rstrip("s"), ()))}
        out = [f"group:{g}" for g in groups]
        if groups:
            out += ["any:bad"] * bool(groups - {"good"}) + ["any:good"] * ("good" in groups)
        elif words:
            out.append("any:neither")
        if attrs and HIDDEN.search(attrs):
            out.append("any:hidden")
        if len(_NAMES) > 50_000:
            _NAMES.clear()
        known = _NAMES[attrs] = tuple(FEATURES[x] for x in out)
    return known


_TAGS = {t: FEATURES[f"tag:{t}"] for t in BLOCKS}
_TEXT = [FEATURES[f"text:{k}"] for k in range(7)]
_LINKS = [FEATURES[f"links:{k}"] for k in range(4)]
_CLOSED, _OPEN, _ONE, _FEW, _LIST, _BIAS, _UNDER_BAD, _UNDER_ARTICLE, _TOP, _OF_ROOT, _BAD, _GOOD = (FEATURES[x] for x in ("text:closed", "text:open", "words:1", "words:few", "in:list", "bias", "under:bad", "under:article", "text:top", "of:root", "any:bad", "any:good"))


_TOP_KINDS = [FEATURES[f"top:{k}"] for k in ("text", "part", "box")]


def all_features(page: Page) -> list[list[int]]:
    """The features of each node: its own, and whether one above it is an article or is named as something else."""
    out: list[list[int]] = []
    bad, article = [], []  # at the node or above it
    for i, tag in enumerate(page.tags):
        own, up = node_features(page, i), page.parent[i]
        if up >= 0:
            own += [_UNDER_BAD] * bad[up] + [_UNDER_ARTICLE] * article[up]
            if up == 0 and tag not in ("head", "body"):
                own.append(_OF_ROOT)
            if page.tags[up] == "body" or up == 0 and tag not in ("head", "body"):
                own.append(_TOP_KINDS[0 if tag in TEXT_TAGS else 1 if tag in PART_TAGS else 2])
        bad.append(_BAD in own and _GOOD not in own and tag != "body" or up >= 0 and bad[up])
        article.append(tag == "article" or up >= 0 and article[up])
        out.append(own)
    return out


def node_features(page: Page, i: int) -> list[int]:
    tag, n = page.tags[i], page.chars[i]
    out = [_BIAS, _TAGS[tag]]
    if page.names[i]:
        out += name_features(page.names[i])
    if n and tag in ("html", "body"):
        out.append(_TOP)
    if n:
        out.append(_TEXT[1 + min(5, (n.bit_length() - 1) // 2)])
        out.append(_LINKS[3 * page.linked[i] // n])
        tail = page.last[i]
        out.append(_CLOSED if tail[-1] in ".!?:;…。！？\"'”’»)" else _OPEN)
        if n < 120:
            words = tail.count(" ") + 1
            out.append(_ONE if words == 1 else _FEW)
        if tag == "li":
            out.append(_LIST)
    else:
        out.append(_TEXT[0])
    return out


class Forest:
    """The trees of some pages as arrays: feature lists, parents, edge kinds, and nodes by depth."""

    def __init__(self, pages: list[Page]):
        feats = [x for p in pages for x in all_features(p)]
        sizes = [len(p.tags) for p in pages]
        self.first = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        self.n = sum(sizes)
        self.flat = np.fromiter((x for f in feats for x in f), np.int64, sum(map(len, feats)))
        self.owner = np.repeat(np.arange(self.n), [len(f) for f in feats])
        parent = np.fromiter((x for p in pages for x in p.parent), np.int64, self.n)
        self.root = parent < 0
        self.parent = parent + np.repeat(self.first, sizes)
        self.kind = np.fromiter(((0 if t in TEXT_TAGS else 1 if t in PART_TAGS else 2) for p in pages for t in p.tags), np.int64, self.n)
        depth = np.fromiter((x for p in pages for x in p.depth), np.int64, self.n)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if self.n else []


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Model:
    """weights: log-odds of content by feature; edges: log potentials by edge kind, parent state, own state; nothing: log potential of a page on which no node is content."""

    weights: np.ndarray
    edges: np.ndarray
    nothing: float = 0.0

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, state) marginals, (node, parent state, state) marginals, and by page the probability that no node is content, without `nothing`; exact on trees: messages up by levels, then down."""
        unary = np.zeros((f.n, 2))
        unary[:, 1] = np.bincount(f.owner, self.weights[f.flat], f.n)
        below = unary.copy()  # own potential and all messages from children
        up = np.zeros((f.n, 2))
        for level in f.levels[:0:-1]:
            up[level] = log_sum(self.edges[f.kind[level]] + below[level][:, None, :], 2)
            for s in (0, 1):
                below[:, s] += np.bincount(f.parent[level], up[level, s], f.n)
        none = np.bincount(f.page[~f.root], self.edges[f.kind[~f.root], 0, 0], len(f.first)) - log_sum(below[f.root], 1) if f.n else np.zeros(0)
        full = below.copy()
        pair = np.zeros((f.n, 2, 2))
        for level in f.levels[1:]:
            from_parent = full[f.parent[level]] - up[level]
            joint = from_parent[:, :, None] + self.edges[f.kind[level]] + below[level][:, None, :]
            joint -= joint.max((1, 2), keepdims=True)
            p = np.exp(joint)
            pair[level] = p / p.sum((1, 2), keepdims=True)
            full[level] = below[level] + log_sum(from_parent[:, :, None] + self.edges[f.kind[level]], 1)
        m = np.exp(full - full.max(1, keepdims=True))
        return m / m.sum(1, keepdims=True), pair, np.exp(np.minimum(none, 0))

    def contents(self, f: Forest) -> np.ndarray:
        """Each node's probability of being content: `nothing` weighs one state of the page anew, which has no content, so all others share what it loses."""
        node, _, none = self.messages(f)
        return node[:, 1] / (1 - none + math.exp(self.nothing) * none)[f.page] if f.n else np.zeros(0)


def fit(pages: list[Page], labels: list[list[int]], rounds: int = 250, rate: float = 4.0, ridge: float = 2e-4) -> Model:
    """Potentials by gradient ascent: observed minus expected features of nodes and edges."""
    f = Forest(pages)
    y = np.asarray([x for own in labels for x in own])
    model = Model(np.zeros(len(FEATURES)), np.zeros((KINDS, 2, 2)))
    inner = ~f.root
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    freq = np.maximum(np.bincount(f.flat, minlength=len(FEATURES)), 5)
    of_kind = np.maximum(seen.sum((1, 2), keepdims=True), 5)
    for r in range(rounds):
        node, pair, none = model.messages(f)
        lr = rate / (1 + r / 50)
        up = np.bincount(f.flat, (y - node[:, 1])[f.owner], len(FEATURES))
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[inner], pair[inner])
        model.weights += lr * (up / freq / 6 - ridge * model.weights)
        model.edges += lr * ((seen - expected) / of_kind - ridge * model.edges)
    # The page's potential, by the likelihood of what the pages show: content or none
    some = np.bincount(f.page, y, len(pages)) > 0
    tried = np.linspace(-6, 0, 61)
    total = [np.where(some, 0, w).sum() - np.log(1 - none + np.exp(w) * none).sum() for w in tried]
    model.nothing = float(tried[int(np.argmax(total))])
    return model


def labelled_pages(n: int = 800, seed: int = 11) -> tuple[list[Page], list[list[int]]]:
    """Pages made from a grammar of layouts, and 1 for each node that is content.

    An article, in any of the usual wrappers or none, holds headings, paragraphs, lists, quotations, tables and figures; around it, and
    at times within its wrapper, stand menus, headers, footers, sidebars, notices, adverts, forms and readers' comments, by tag or by class.
    Some articles are a few words long, some pages have nothing but the article, some are a fragment or text without any element, and some have no content.
    In some the article's blocks stand in the body itself, beside the rest; some have no body element. A share of the names of both kinds is of words that tell nothing, and some
    articles have words of the other kind beside their own.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    syllables = "ka lo mi tar ven sol pre dun ist ora bel fin gu hem jo".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    prose = lambda: " ".join(words(1, 25).capitalize() + "." for _ in range(int(rng.integers(1, 7))))

    def name(group: str, silent: float = 0.0) -> str:
        """silent: the share of names that tell nothing."""
        w = pick(GROUPS[group].split())
        w = pick([w, f"{w}-{word()}", f"{word()}_{w}", f"{w} {word()}"])
        if group == "good" and rng.random() < 0.25:
            more = [f"{pick(GROUPS[pick(['side', 'ad', 'notice', 'share', 'head', 'foot', 'form'])].split())}{pick(['', '-' + word()])}" for _ in range(int(rng.integers(1, 3)))]
            w = " ".join([w, *more] if rng.random() < 0.7 else [*more, w])
        if rng.random() < silent:
            w = pick([word(), f"{word()}-{word()}", f"{word()} {word()}_{word()}"])
        return f' {pick(["class", "class", "id"])}="{w}"'

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{words(1, 4)}</a></{tag}>' for _ in range(k))

    def junk(where: str) -> str:
        kind = pick(["menu", "side", "ad", "notice", "talk", "share", "form"] if where == "around" else ["ad", "share", "side", "notice", "talk", "form"])
        tag = pick({"menu": ["nav", "div", "ul"], "side": ["aside", "div", "section"], "talk": ["section", "div", "ol"], "form": ["form"]}.get(kind, ["div", "section"]))
        told = tag in ("nav", "aside", "form")
        own = "" if told and rng.random() < 0.5 else name(kind, 0.3 if told or kind == "menu" else 0.0)
        if kind in ("menu",) or kind in ("side", "share") and rng.random() < 0.7:
            body = links(int(rng.integers(1, 9))) if tag in ("ul", "ol") else f"{pick(['', '<h3>' + words(1, 3) + '</h3>'])}<ul>{links(int(rng.integers(2, 9)))}</ul>"
        elif kind == "form":
            body = f"<label>{words(1, 3)}</label><input name=q><textarea>{words(0, 3)}</textarea><button>{words(1, 2)}</button>{pick(['', '<p>' + words(3, 12) + '.</p>'])}"
        elif kind == "talk":
            each = "".join(f"<{t}{pick(['', name('talk')])}><p>{pick([prose(), words(2, 12)])}</p></{t}>" for t in [("li" if tag == "ol" else pick(["div", "div", "article"]))] * int(rng.integers(1, 5)))
            body = pick(["", f"<h3>{words(1, 3)}</h3>"] if tag != "ol" else [""]) + each
        else:
            body = pick([prose(), f"<p>{prose()}</p>", words(2, 12), f'<a href="/{word()}">{words(1, 6)}</a>'])
        return f'<{tag}{own} data-y="0">{body}</{tag}>'

    def block() -> str:
        kind = rng.random()
        if kind < 0.62:
            return f"<p>{pick(['', '<b>', '<em>' + words(1, 4) + '</em> '])}{prose()}{pick(['', f' <a href=/{word()}>{words(1, 3)}</a>.', '<br>' + prose()])}</p>"
        if kind < 0.72:
            return f"<{(t := pick(['h2', 'h3', 'h4']))}>{words(1, 8)}</{t}>"
        if kind < 0.8:
            return f"<{(t := pick(['ul', 'ol']))}>{''.join(f'<li>{pick([words(2, 9), prose()])}</li>' for _ in range(int(rng.integers(2, 6))))}</{t}>"
        if kind < 0.86:
            return f"<blockquote>{pick([prose(), '<p>' + prose() + '</p>'])}</blockquote>"
        if kind < 0.9:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(1, 5)))) + "</table>"
        if kind < 0.94:
            return f"<pre>{words(3, 20)}</pre>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{words(2, 12)}.</figcaption></figure>"
        return f"<div>{prose()}</div>"

    def article(short: bool, flat: bool = False) -> str:
        parts = [f"<h1>{words(1, 12)}</h1>"] if rng.random() < (0.5 if short else 0.85) else []
        parts += [f"<p>{words(1, 9).capitalize()}{pick(['.', '.', ''])}</p>" if short else block() for _ in range(int(rng.integers(1, 3 if short else 12)))]
        for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.4 else 0):
            parts.insert(int(rng.integers(len(parts) + 1)), junk("within"))
        if flat:
            return "".join(x if 'data-y="0"' in x[: x.find(">") + 1] else re.sub(r"^<(\w+)", r'<\1 data-y="1"', x) for x in parts)
        body = "".join(parts)
        form = rng.random()
        if form < 0.45:
            body = f"<article{pick(['', name('good', 0.2)])}>{body}</article>"
        elif form < 0.6:
            body = f"<main{pick(['', '', name('good', 0.2)])}>{pick(['', '<section>'])}{body}</main>"
        elif form < 0.9:
            body = f"<div{name('good')}>{body}</div>"
        else:
            body = f"<div{pick(['', f' class={word()}'])}>{body}</div>"
        return f"<{(t := pick(['div', 'main', 'section']))}{pick(['', name('good')])}>{body}</{t}>" if rng.random() < 0.4 else body

    pages, labels = [], []
    for _ in range(n):
        top = f'<header{pick(["", name("head")])} data-y="0">{pick(["<h1>" + words(1, 3) + "</h1>", "<p>" + words(2, 8) + "</p>", ""])}{pick(["", "<nav><ul>" + links(5) + "</ul></nav>"])}</header>' if rng.random() < 0.5 else ""
        if rng.random() < 0.7:
            items = int(rng.integers(1, 9))
            top += f'<nav{pick(["", name("menu", 0.2)])} data-y="0">{pick(["<ul>" + links(items) + "</ul>", "<ul>" + links(items) + "</ul>", links(items, "span")])}</nav>'
        foot = f'<footer{pick(["", name("foot")])} data-y="0">{pick(["&copy; " + words(1, 6), "<p>&copy; " + prose() + "</p>", "<ul>" + links(4) + "</ul>", word() + ".example &middot; " + prose()])}</footer>' if rng.random() < 0.8 else f'<div{name("foot")} data-y="0">{words(2, 12)}</div>'
        around = [junk("around") for _ in range(int(rng.integers(0, 4)))]
        k = int(rng.integers(len(around) + 1))
        title = words(2, 12)
        kind = rng.choice(["usual", "flat", "short", "alone", "bare", "text", "nothing"], p=[0.48, 0.14, 0.12, 0.08, 0.06, 0.06, 0.06])
        body = article(rng.random() < 0.3, True) if kind == "flat" else f'<div data-y="1" data-only>{article(kind in ("short", "alone", "bare"))}</div>'
        body = re.sub(r'<div data-y="1" data-only>(.*)</div>', lambda m: re.sub(r"^<(\w+)", r'<\1 data-y="1"', m[1]), body, count=1, flags=re.S) if kind != "flat" and rng.random() < 0.8 else body
        if kind in ("alone", "bare"):
            top, around, foot = "", [], ""
        if kind == "text":
            top, around, foot, body = pick(["", top]), [], pick(["", foot]), pick([prose(), words(1, 9), f"{prose()}<br>{prose()}"])
        if kind == "nothing":
            body = ""
        head = f'<head data-y="0"><title>{title}</title></head>' if kind != "bare" else ""
        inner = f'{top}{"".join(around[:k])}{body}{"".join(around[k:])}{foot}'
        whole = kind == "text" or rng.random() < 0.88
        source = body if kind == "bare" else inner if not whole else f'<!DOCTYPE html><html>{head}<body data-y="{"1" if kind in ("text", "flat") else "r"}">{inner}</body></html>'
        page = parse(source)
        y = []
        for i, attrs in enumerate(page.names):
            m = re.search(r'data-y="(.)"', attrs)
            up = page.parent[i]
            y.append({"0": 0, "1": 1, "r": 0}[m[1]] if m else (y[up] if up >= 0 else 0))
        page.names = [re.sub(r'\s*data-(y="."|only)', "", x) for x in page.names]
        pages.append(page)
        labels.append(y)
    return pages, labels


def train(n: int = 800, seed: int = 11) -> Model:
    return fit(*labelled_pages(n, seed))


def main_texts(model: Model, sources: list[str], least: float = 0.5) -> list[str]:
    """The main text of each page."""
    pages = [parse(s) for s in sources]
    f = Forest(pages)
    keep = (model.contents(f) > least).tolist()
    out = []
    for p, at in zip(pages, f.first.tolist(), strict=True):
        out.append(" ".join("".join(" " if i < 0 else t if keep[at + i] else "" for i, t in p.segments).split()))
    return out


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    small_batches(pages.sparkSession)
    told = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in cut(whole, "h", 1 << 20):
                texts = main_texts(told.value, b.column("h").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("h"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_tree_model(spark, sf_dir: str) -> DataFrame:
    from rubrica.llm.common import read

    return extract(read(spark, sf_dir, "pages"), train())

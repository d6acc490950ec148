"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each page is parsed into its block-level nodes. A node's features are its tag, depth,
text and link density of its subtree, sibling statistics, how its attribute tokens
(words of class, id and role) went with content in fitting, and the same of its
ancestors. Trees give each node the probability of holding main text; decoding picks the
likeliest labelling in which no node below a rejected one is kept and every kept node's
ancestors are kept. The text is that of the kept nodes, block by block in page order.

Fitting (``FitPages``) takes a bounded sample of pages: those with the smallest hashes of
page_id and no more than ``most_chars`` characters. Their texts are put into pages of
many layouts made for the purpose, whose labels are therefore known, beside the sampled
pages themselves, labelled by their own semantic tags. The fitted trees are some hundred
kilobytes and go out with the tasks; extraction is one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
_RAW = "script|style|noscript|template|textarea|iframe|object|svg|math|title|select"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote body center details div dl dd dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_POINT = re.compile(r"[.,;:!?]")
_MARK = "zzmaintext"

_KINDS = (
    "p h1 h2 h3 li ul ol div section article main nav aside header footer form table td blockquote pre body figure button"
).split()
_KIND = {tag: i for i, tag in enumerate(_KINDS)}
_UNDER = ("article", "main", "nav", "aside", "header", "footer", "form")
_NUMBERS = 20
N_FEATURES = _NUMBERS + len(_KINDS) + 1 + len(_UNDER)


@dataclass(frozen=True)
class FitPages:
    """Bounds of the sample that the trees are fitted on, and their number and depth."""

    pages: int = 240
    most_chars: int = 60_000
    layouts: int = 3
    trees: int = 60
    depth: int = 4
    rate: float = 0.25
    seed: int = 11


class Page:
    """Block-level nodes in page order, and the text runs that each owns."""

    __slots__ = ("tags", "attrs", "parents", "ends", "depths", "runs")

    def __init__(self, source: str) -> None:
        self.tags, self.attrs, self.parents, self.depths = ["#root"], [""], [-1], [0]
        self.ends = [0]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self._parse(source)

    def _parse(self, source: str) -> None:
        tags, attrs, parents, depths, ends = self.tags, self.attrs, self.parents, self.depths, self.ends
        stack = [("#root", 0)]
        text: list[str] = []
        linked = links = 0
        node = 0

        def flush() -> None:
            nonlocal linked
            if text:
                run = " ".join("".join(text).split())
                if run:
                    self.runs.append((node, run, min(linked, len(run))))
                text.clear()
            linked = 0

        def close_to(size: int) -> None:
            """Drops all open elements beyond the first ``size``."""
            nonlocal node, links
            while len(stack) > size:
                tag, at = stack.pop()
                if at >= 0:
                    flush()
                    ends[at] = len(tags)
                    node = next(i for _, i in reversed(stack) if i >= 0)
                elif tag == "a":
                    links -= 1

        for m in _TOKEN.finditer(source):
            name = m.group(3) or m.group(6)
            if name is None:
                piece = m.group()
                if piece[0] != "<" or piece == "<":
                    if "&" in piece:
                        piece = html.unescape(piece)
                    text.append(piece)
                    if links > 0:
                        linked += len(piece)
                elif text:
                    text.append(" ") if m.group(1) else None
                continue
            tag = name.lower()
            if m.group(2) or m.group(5):
                for at in range(len(stack) - 1, 0, -1):
                    open_tag, own = stack[at]
                    if open_tag == tag:
                        close_to(at)
                        break
                    if tag in _INLINE and own >= 0:
                        break
                continue
            if tag in _VOID:
                if tag in ("br", "hr", "img", "input", "wbr"):
                    text.append(" " if tag != "wbr" else "")
                continue
            if tag in _INLINE:
                stack.append((tag, -1))
                links += tag == "a"
                continue
            if tag in _CLOSES_P:
                for at in range(len(stack) - 1, 0, -1):
                    open_tag, own = stack[at]
                    if open_tag == "p":
                        close_to(at)
                        break
                    if own >= 0:
                        break
            if tag in _SELF_CLOSING:
                same, stop = _SELF_CLOSING[tag]
                for at in range(len(stack) - 1, 0, -1):
                    if stack[at][0] in stop:
                        break
                    if stack[at][0] in same:
                        close_to(at)
                        break
            flush()
            parents.append(node)
            depths.append(depths[node] + 1)
            tags.append(tag)
            attrs.append(m.group(4) or m.group(7) or "")
            ends.append(0)
            node = len(tags) - 1
            stack.append((tag, node))
        close_to(1)
        flush()
        ends[0] = len(tags)


def attribute_tokens(attrs: str) -> list[str]:
    if "=" not in attrs:
        return []
    return [w.lower() for value in _NAMES.findall(attrs) for w in _PART.findall(value) if w.lower() != _MARK]


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row per node."""
    n = len(page.tags)
    out = np.zeros((n, N_FEATURES), np.float32)
    parents, ends = np.array(page.parents), np.array(page.ends)
    depths = np.array(page.depths, np.float64)
    own, link, points, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    before, so_far = np.zeros(n), 0
    seen = -1
    for node, run, linked in page.runs:
        if node > seen:
            before[seen + 1 : node + 1] = so_far
            seen = node
        own[node] += len(run)
        link[node] += linked
        points[node] += len(_POINT.findall(run))
        words[node] += run.count(" ") + 1
        so_far += len(run)
    before[seen + 1 :] = so_far
    total = max(so_far, 1)

    def subtree(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(values)))
        return sums[ends] - sums[np.arange(n)]

    all_text, all_link, all_points = subtree(own), subtree(link), subtree(points)
    nodes = ends - np.arange(n)
    is_p = np.array([t == "p" for t in page.tags], float)
    children = np.bincount(parents[1:], minlength=n)
    score = np.zeros(n)
    low, high = np.zeros(n), np.zeros(n)
    kinds = [_KIND.get(t, len(_KINDS)) for t in page.tags]
    under = np.zeros((n, len(_UNDER)), np.float32)
    sibling, same, previous = np.zeros(n), np.zeros(n), np.full(n, -1.0)
    last: dict[int, int] = {}
    of_tag: Counter = Counter()
    for i in range(1, n):
        up = page.parents[i]
        if page.attrs[i]:
            found = [odds.get(t, 0.0) for t in attribute_tokens(page.attrs[i])]
            if found:
                score[i] = min(found) + max(found)
        low[i] = min(low[up], score[i])
        high[i] = max(high[up], score[i])
        under[i] = under[up]
        if page.tags[up] in _UNDER:
            under[i, _UNDER.index(page.tags[up])] = 1
        if up in last:
            sibling[i] = sibling[last[up]] + 1
            previous[i] = kinds[last[up]]
        last[up] = i
        of_tag[up, kinds[i]] += 1
    for i in range(1, n):
        same[i] = of_tag[page.parents[i], kinds[i]]
    brothers = np.where(parents >= 0, children[parents], 1)
    up = np.maximum(parents, 0)
    columns = [
        depths,
        np.log1p(all_text),
        np.log1p(own),
        all_link / np.maximum(all_text, 1),
        link / np.maximum(own, 1),
        np.log1p(nodes),
        np.log1p(all_text / nodes),
        all_text / total,
        np.log1p(children),
        np.log1p(brothers),
        sibling / np.maximum(brothers, 1),
        same / np.maximum(brothers, 1),
        all_points / np.maximum(all_text, 1),
        np.log1p(words),
        before / total,
        all_text[up] / total,
        subtree(is_p) / nodes,
        score,
        low[up],
        high[up],
    ]
    for k, column in enumerate(columns):
        out[:, k] = column
    out[np.arange(n), _NUMBERS + np.array(kinds)] = 1
    out[:, _NUMBERS + len(_KINDS) + 1 :] = under
    return out


@dataclass
class Trees:
    """Boosted regression trees as complete binary trees, and the attribute tokens' log-odds."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float
    odds: dict[str, float]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(math.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, how: FitPages, odds: dict[str, float]) -> Trees:
    """Newton boosting on the logistic loss, with histograms of up to 32 bins per feature."""
    bins = 32
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    start = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    score = np.full(len(y), start)
    inner, leaves = 2**how.depth - 1, 2**how.depth
    all_f, all_c, all_l = [], [], []
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        at = np.zeros(len(y), np.int64)
        for level in range(how.depth):
            first, width = 2**level - 1, 2**level
            place = at - first
            best = np.full(width, 1e-3)
            total_g, total_h = np.bincount(place, g, width), np.bincount(place, h, width)
            base = total_g**2 / (total_h + 1)
            split_bin = np.full(width, bins)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = place * bins + binned[:, j]
                left_g = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                left_h = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - base[:, None]
                gain[:, len(edges[j]) :] = -1
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best = np.where(better, value, best)
                split_bin = np.where(better, top, split_bin)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
            for k in range(width):
                if split_bin[k] < bins:
                    cut[first + k] = edges[feature[first + k]][split_bin[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        end = at - inner
        leaf = how.rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + 1)
        score += leaf[end]
        all_f.append(feature)
        all_c.append(cut)
        all_l.append(leaf)
    return Trees(np.array(all_f), np.array(all_c), np.array(all_l), start, odds)


def decode(page: Page, logits: np.ndarray) -> np.ndarray:
    """Likeliest labels in which a rejected node has only rejected descendants."""
    n = len(page.tags)
    keep = (-np.logaddexp(0, -logits)).tolist()
    drop = (-np.logaddexp(0, logits)).tolist()
    below = [0.0] * n  # of the children, each at its best, if this node is kept
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        keep[i] += below[i]
        # drop[i] by now holds the whole subtree's.
        drop[up] += drop[i]
        below[up] += max(keep[i], drop[i])
    labels = np.zeros(n, bool)
    labels[0] = True
    for i in range(1, n):
        labels[i] = labels[page.parents[i]] and keep[i] >= drop[i]
    return labels


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page: kept blocks, one per line."""
    pages = [Page(s or "") for s in sources]
    if not pages:
        return []
    logits = trees.logits(np.concatenate([features(p, trees.odds) for p in pages]))
    out, at = [], 0
    for p in pages:
        labels = decode(p, logits[at : at + len(p.tags)])
        at += len(p.tags)
        out.append("\n".join(run for node, run, _ in p.runs if labels[node]))
    return out


# --- fitting ---------------------------------------------------------------------------

_MAIN_TAGS = frozenset({"article", "main"})
_SIDE_TAGS = frozenset({"nav", "aside", "footer", "form", "head"})
_SIDE_NAMES = frozenset({"ad", "ads", "nav", "menu", "sidebar", "footer", "comment", "comments", "cookie", "notice"})

# Names that layouts made for fitting give to their parts.
_CONTENT = "article content post entry story body text main page-content post-body article-body entry-content".split()
_PARTS = {
    "menu": ("nav", "nav menu navbar navigation breadcrumb topnav submenu".split()),
    "header": ("header", "header masthead site-header topbar banner branding logo".split()),
    "footer": ("footer", "footer site-footer bottom copyright legal colophon".split()),
    "sidebar": ("aside", "sidebar side widget related recommended popular more-stories rail".split()),
    "advert": ("div", "ad ads advert advertisement sponsored promo promotion banner-ad".split()),
    "notice": ("div", "cookie notice consent gdpr alert message subscribe-notice warning disclaimer".split()),
    "form": ("form", "form search newsletter login signup contact subscribe".split()),
    "comments": ("section", "comments comment-list discussion replies responses disqus".split()),
    "share": ("div", "share social tags meta byline toolbar pagination tools".split()),
}


def _true_labels(page: Page, marked: bool) -> np.ndarray:
    """Nodes with main text below, by the layouts' mark or by the page's own semantic tags."""
    n = len(page.tags)
    inside, labels = [False] * n, np.zeros(n, bool)
    for i in range(1, n):
        tag, up = page.tags[i], page.parents[i]
        if marked:
            inside[i] = _MARK in page.attrs[i]
        else:
            side = tag in _SIDE_TAGS or not _SIDE_NAMES.isdisjoint(attribute_tokens(page.attrs[i]))
            inside[i] = not side and (inside[up] or tag in _MAIN_TAGS)
    for node, _, _ in page.runs:
        i = node
        if inside[node]:
            while i >= 0 and not labels[i]:
                labels[i] = True
                i = page.parents[i]
    return labels


class _Layouts:
    """Pages of many layouts around given paragraphs; main text carries a mark that is no feature."""

    def __init__(self, rng: random.Random, texts: list[str]) -> None:
        self.rng, self.texts = rng, texts or ["Some words, and some more.", "A longer line of words, to be read."]

    def words(self, low: int, high: int) -> str:
        words = self.rng.choice(self.texts).split()
        start = self.rng.randrange(max(1, len(words) - low))
        return html.escape(" ".join(words[start : start + self.rng.randint(low, high)]))

    def name(self, names: list[str]) -> str:
        if self.rng.random() < 0.3:
            return ""
        other = self.rng.choice(["", "", " wide", " block", f" c{self.rng.randint(1, 99)}", " row"])
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}{other}"'

    def links(self, count: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(count))

    def part(self, kind: str) -> str:
        tag, names = _PARTS[kind]
        rng = self.rng
        named = self.name(names)
        if not named or rng.random() < 0.5:
            # Without any name the tag itself has to tell.
            tag = tag if not named and tag != "div" else rng.choice([tag, "div"])
            named = named or f' class="{rng.choice(names)}"'
        if kind in ("menu", "share"):
            inner = f"<ul>{self.links(rng.randint(3, 9))}</ul>" if rng.random() < 0.7 else self.words(2, 6)
        elif kind == "header":
            inner = f"<div>{self.words(1, 4)}</div><ul>{self.links(rng.randint(0, 6))}</ul>"
        elif kind == "footer":
            inner = rng.choice([f"&copy; {self.words(4, 14)}", f"<p>&copy; {self.words(4, 20)}</p><ul>{self.links(4)}</ul>"])
        elif kind == "sidebar":
            inner = f"<h3>{self.words(1, 4)}</h3><ul>{self.links(rng.randint(2, 8))}</ul><p>{self.words(5, 40)}</p>"
        elif kind == "form":
            inner = f"<label>{self.words(1, 5)}</label><input><p>{self.words(2, 15)}</p><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 2)}</h3>" + "".join(
                f'<div{self.name(["comment", "reply", "comment-body"])}><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></div>'
                for _ in range(rng.randint(1, 6))
            )
        else:
            inner = rng.choice([self.words(3, 25), f"<p>{self.words(3, 25)}</p>", f"<p>{self.words(3, 20)}</p><button>{self.words(1, 2)}</button>"])
        return f"<{tag}{named}>{inner}</{tag}>"

    def body(self, paragraphs: list[str]) -> str:
        rng, out = self.rng, []
        mark = f' data-x="{_MARK}"'
        if rng.random() < 0.85:
            out.append(f"<h1{mark}>{html.escape((paragraphs or [''])[0][:60])}</h1>")
        tag = rng.choice(["p", "p", "p", "p", "div"])
        for k, text in enumerate(paragraphs):
            text = html.escape(text)
            chance = rng.random()
            if chance < 0.1:
                text = f"<b>{text}<br>" if rng.random() < 0.5 else f'<a href="/y">{text[:20]}</a>{text[20:]}'
            if chance > 0.95:
                out.append(f"<h2{mark}>{self.words(1, 5)}</h2>")
            if 0.90 < chance < 0.93:
                out.append(f"<ul>{''.join(f'<li{mark}>{self.words(2, 15)}</li>' for _ in range(rng.randint(2, 5)))}</ul>")
            if 0.88 < chance <= 0.90:
                out.append(f"<blockquote><p{mark}>{self.words(4, 25)}</p></blockquote>")
            if 0.85 < chance <= 0.88 and k:
                out.append(self.part(rng.choice(["advert", "share", "notice", "form", "sidebar"])))
            out.append(f"<{tag}{mark}>{text}</{tag}>")
        return "".join(out)

    def page(self, paragraphs: list[str]) -> str:
        rng = self.rng
        some = lambda kinds, chance: [self.part(k) for k in kinds if rng.random() < chance]
        tag = rng.choice(["article", "main", "div", "div", "section"])
        inner = some(["share"], 0.2) + [self.body(paragraphs)] + some(["share", "comments", "form"], 0.25)
        named = self.name(_CONTENT)
        if tag in ("div", "section") and not named:
            named = f' class="{rng.choice(_CONTENT)}"'
        main = f"<{tag}{named}>{''.join(inner)}</{tag}>"
        for _ in range(rng.randint(0, 2)):
            main = f"<div{self.name(['wrap', 'container', 'row', 'layout'])}>{''.join(some(['advert'], 0.2))}{main}{''.join(some(['sidebar'], 0.2))}</div>"
        top = some(["notice", "header", "menu", "advert", "form"], 0.5)
        end = some(["sidebar", "comments", "advert", "notice", "footer", "form"], 0.5)
        rng.shuffle(top)
        return f"<html><head><title>x</title></head><body>{''.join(top)}{main}{''.join(end)}</body></html>"


def fit_trees(sources: list[str], how: FitPages) -> Trees:
    """Trees fitted on the given pages and on layouts around their texts."""
    rng = random.Random(how.seed)
    texts, articles = [], []
    labelled: list[tuple[Page, np.ndarray]] = []
    for source in sources:
        page = Page(source)
        labels = _true_labels(page, marked=False)
        texts += [run for _, run, _ in page.runs]
        if labels.any():
            labelled.append((page, labels))
            articles.append([run for node, run, _ in page.runs if labels[node]][-30:])
    layouts = _Layouts(rng, texts)
    if not articles:
        articles = [[layouts.words(2, 8) for _ in range(k)] for k in range(1, 6)]
    for paragraphs in articles:
        for _ in range(how.layouts):
            kept = paragraphs[: rng.randint(1, len(paragraphs))]
            page = Page(layouts.page(kept))
            labelled.append((page, _true_labels(page, marked=True)))
    good, bad = Counter(), Counter()
    for page, labels in labelled:
        for i, attrs in enumerate(page.attrs):
            (good if labels[i] else bad).update(set(attribute_tokens(attrs)))
    odds = {
        t: math.log((good[t] + 1) / (bad[t] + 1)) for t in good.keys() | bad.keys() if good[t] + bad[t] >= 3
    }
    x = np.concatenate([features(page, odds) for page, _ in labelled])
    y = np.concatenate([labels for _, labels in labelled]).astype(float)
    return boost(x, y, how, odds)


def fit_pages(pages: DataFrame, how: FitPages = FitPages()) -> Trees:
    """Trees fitted on the bounded sample of ``pages`` (page_id, html).

    The sample is chosen by page_id alone; only the chosen pages' html, the least of a
    repeated page_id, goes to the driver. Rows without page_id are not sampled.
    """
    small = pages.filter(F.col("page_id").isNotNull() & (F.length("html") <= how.most_chars))
    few = small.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(how.pages)
    # At most ``how.pages`` ids: a bound, whatever the table's size.
    rows = small.join(F.broadcast(few), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    return fit_trees([r.html for r in sorted(rows, key=lambda r: r.page_id)], how)


def page_texts(pages: DataFrame, trees: Trees, at_once: int = 64) -> DataFrame:
    """``pages`` with columns ``text`` (main text, empty if there is none) and ``n_chars``.

    A NULL or empty html has an empty text. Repeated rows are handled each on its own;
    other columns pass through, but columns named text and n_chars are replaced.
    """

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in parts:
            values = sources.tolist()
            yield pd.Series(
                [t for i in range(0, len(values), at_once) for t in main_texts(values[i : i + at_once], trees)], dtype=object
            )

    return pages.withColumn("text", extract(F.coalesce("html", F.lit("")))).withColumn(
        "n_chars", F.length("text").cast("long")
    )

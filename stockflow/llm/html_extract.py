"""Main text of web pages: boosted trees over DOM nodes, then one consistent choice down each page's tree."""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common
from .boosting import BoostedTrees

# Fixed values of HTML: elements without end tags, with raw text, with raw text that leaves no gap in a line, never shown, and blocks; all others stand within lines.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
UNRENDERED = set("script style noscript".split())
HIDDEN = set("head template select button svg object audio video canvas datalist dialog".split())
CLOSES_P = set("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCK = CLOSES_P | VOID | RAW | HIDDEN | set("html body dt dd li tr td th tbody thead tfoot caption colgroup option optgroup legend summary dir frameset frame hgroup search".split())
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
GROUPS = [("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "menu", "dl"), ("li", "dt", "dd"), ("article", "main"), ("nav", "aside", "footer"), ("header",), ("form", "fieldset"), ("table", "tr", "td", "th", "tbody", "thead"), ("section",), ("blockquote", "pre", "figure", "figcaption")]
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(>|\Z)""", re.DOTALL)
ENDS = {t: re.compile(f"</{t}", re.IGNORECASE) for t in RAW}
#: A whole attribute: its name, and its value if it has one, in quotes (the last may lack its end) or not.
ATTR = re.compile(r"""([^\s"'<>/=][^\s"'>/=]*+)(?:\s*+=\s*+("[^"]*+"?+|'[^']*+'?+|[^\s"'>]++))?+|["'/=<]""")
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What the attributes of an element within a line have to hold to be looked at.
TELLING = re.compile("hidden|none|class|id|role", re.IGNORECASE)
STOPS = re.compile(r"[.,;:!?]")

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Pages of the sample that the trees are fitted on, made-up pages beside them, and the longest page taken into the sample.
SAMPLE, MADE, SAMPLE_CHARS = 200, 500, 200_000


class Page:
    """A page's nodes in document order, and its runs of text, each with the node that it stands in.

    Nodes are blocks, and those elements within lines that have a class, an id or a role: they are judged as blocks are, but leave the line whole.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.hidden, self.mark, self.inline = [-1], ["html"], [()], [False], [None], [False]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters of it in links
        self.lines: list[int] = []  # of each run, the line that it is part of
        stack, pieces, at, link, line = [0], [], 0, False, 0
        within_line: list[tuple[str, int]] = []  # the open elements of a line that are nodes or have the name of one
        muted, depth, within = "", 0, 0  # an element within a line whose text isn't shown, how many of its name are open in it, and how many nodes when it began
        opened: dict[str, int] = defaultdict(int)  # how many elements of a name are open

        def text(piece: str) -> None:
            if piece and not muted:
                piece = entities.unescape(piece) if "&" in piece else piece
                node = within_line[-1][1] if within_line else stack[-1]
                if not pieces or pieces[-1][0] != node:
                    pieces.append([node, [], 0])
                pieces[-1][1].append(piece)
                pieces[-1][2] += len(piece) * link

        def flush() -> None:
            nonlocal line
            for i, (node, own, linked) in enumerate(pieces):
                whole = "".join(own)
                run = " ".join(whole.split())
                if len(pieces) > 1:  # white space at its ends parts it from its neighbours in the line
                    run = " " * (i > 0 and whole[:1].isspace()) + run + " " * (bool(run) and i < len(pieces) - 1 and whole[-1:].isspace())
                if run:
                    self.runs.append((node, run, min(linked, len(run))))
                    self.lines.append(line)
            line += 1
            pieces.clear()
            within_line.clear()

        while m := TAG.search(source, at):
            text(source[at : m.start()])
            at = m.end()
            name = m[2]
            if not name or not m[4]:  # a comment, a declaration, or a tag that the page ends in
                continue
            name = name.lower()
            if name not in BLOCK:
                if name == muted:
                    depth += -1 if m[1] else 1
                    muted = muted if depth else ""
                elif not muted and m[1]:
                    if any(n == name for n, _ in within_line):
                        while within_line.pop()[0] != name:
                            pass
                elif not muted:
                    mark, hidden, tokens = attributes(m[3]) if m[3] and TELLING.search(m[3]) else (None, False, ())
                    if hidden:
                        muted, depth, within = name, 1, len(stack)
                    elif tokens:
                        node = within_line[-1][1] if within_line else stack[-1]
                        within_line.append((name, self.node(node, name, True)))
                        self.tokens[-1], self.mark[-1] = tuple("~" + t for t in tokens), mark
                    elif any(n == name for n, _ in within_line):
                        within_line.append((name, within_line[-1][1]))
                link = (not m[1]) if name == "a" else link
                continue
            if name == "br":
                flush()
                continue
            if name in VOID and name != "hr":
                continue
            if m[1]:
                if opened[name]:
                    flush()
                    link, seen = False, ""
                    while seen != name:
                        seen = self.tag[stack.pop()]
                        opened[seen] -= 1
                    if len(stack) < within:
                        muted, within = "", 0
                continue
            if name not in UNRENDERED:
                flush()
                link = False
            if name in RAW:
                end = ENDS[name].search(source, at)
                at = end.start() if end else len(source)
                close = source.find(">", at)
                at = len(source) if close < 0 else close + 1
                continue
            if name in ("html", "body") or name == "hr":
                if name != "hr" and m[3] and "data-y" in m[3]:
                    self.note(0, m[3])
                if name == "body" and self.tag[stack[-1]] == "head":
                    opened[self.tag[stack.pop()]] -= 1
                continue
            for v in self.implied(stack, name):
                opened[self.tag[v]] -= 1
            if len(stack) < within:
                muted, within = "", 0
            self.node(stack[-1], name, False)
            if m[3]:
                self.note(len(self.tag) - 1, m[3])
            if not m[3].rstrip().endswith("/") or name not in HIDDEN:
                stack.append(len(self.tag) - 1)
                opened[name] += 1
        text(source[at:] if at < len(source) else "")
        flush()

    def node(self, parent: int, name: str, inline: bool) -> int:
        self.parent.append(parent)
        self.tag.append(name)
        self.tokens.append(())
        self.hidden.append(name in HIDDEN)
        self.mark.append(None)
        self.inline.append(inline)
        return len(self.tag) - 1

    def text(self, stay: list[bool]) -> str:
        """The runs of the nodes that stay: a line without gaps, a space between lines."""
        lines: dict[int, list[str]] = defaultdict(list)
        for (v, run, _), line in zip(self.runs, self.lines, strict=True):
            if stay[v]:
                lines[line].append(run)
        return " ".join(x for own in lines.values() if (x := " ".join("".join(own).split())))

    def implied(self, stack: list[int], name: str) -> list[int]:
        """Takes off the stack, and returns, the elements that a start tag of this name closes."""
        cut = len(stack)
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if (tag := self.tag[stack[i]]) == "p":
                    cut = i
                if tag == "p" or tag not in CLOSES_LIKE and tag not in CLOSES_P:
                    break
        if like := CLOSES_LIKE.get(name):
            for i in range(len(stack) - 1, 0, -1):
                if (tag := self.tag[stack[i]]) in like:
                    cut = min(cut, i)
                if tag in like or tag in ("ul", "ol", "dl", "table", "menu", "select"):
                    break
        gone = stack[cut:]
        del stack[cut:]
        return gone

    def note(self, v: int, source: str) -> None:
        mark, hidden, self.tokens[v] = attributes(source)
        self.mark[v] = self.mark[v] if mark is None else mark
        self.hidden[v] |= hidden


def attributes(source: str) -> tuple[bool | None, bool, tuple[str, ...]]:
    """The mark of a made-up page, whether the element is hidden, and the tokens of class, id and role."""
    mark, hidden, found, seen = None, False, [], {""}
    for key, value in ATTR.findall(source):
        key, value = key.lower(), value[1:].removesuffix(value[0]) if value.startswith(("'", '"')) else value
        if key in seen:  # of attributes of one name the first counts
            continue
        seen.add(key)
        if key == "data-y":
            mark = value == "1"
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and UNSEEN.search(value):
            hidden = True
        elif key in ("class", "id", "role"):
            found += [t.lower() for t in TOKEN.findall(value)]
    return mark, hidden, tuple(found)


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """A row for each node: text, links, marks and tags of its subtree and their densities, depth, place and share among siblings,
    kinds of its tag and of tags above, and how its attribute tokens and those above spoke in the sample."""
    n = len(page.tag)
    own = np.zeros((n, 5))  # characters, in links, sentence marks, runs, tags
    for v, run, linked in page.runs:
        own[v] += (len(run), linked, len(STOPS.findall(run)), 1, 0)
    own[:, 4] = 1
    sub, parent = own.copy(), page.parent
    below = np.zeros(n)
    for v in range(n - 1, 0, -1):
        sub[parent[v]] += sub[v]
        below[parent[v]] += 1
    depth, place, group, above = np.zeros(n), np.zeros(n), np.zeros((n, len(GROUPS))), np.zeros((n, len(GROUPS)))
    speak, low, high, seen, headings = np.zeros(n), np.zeros(n), np.zeros(n), defaultdict(int), np.zeros(n)
    for v in range(n):
        if (g := GROUP.get(page.tag[v])) is not None:
            group[v, g] = 1
            headings[v] = g == 1
        said = [odds.get(t, 0.0) for t in page.tokens[v]]
        speak[v] = sum(said)
        if v:
            u = parent[v]
            depth[v], place[v] = depth[u] + 1, seen[u]
            above[v] = np.maximum(above[u], group[u])
            low[v], high[v] = min(low[u], speak[u]), max(high[u], speak[u])
            seen[u] += 1
    for v in range(n - 1, 0, -1):
        headings[parent[v]] += headings[v]
    up = np.array([max(p, 0) for p in parent])
    chars, links, stops, runs, tags = sub.T
    total = max(1.0, chars[0])
    before = np.cumsum(own[:, 0]) - own[:, 0]
    with_tokens = np.array([len(t) for t in page.tokens])
    columns = [
        np.log1p(chars), np.log1p(own[:, 0]), links / np.maximum(chars, 1), stops / np.maximum(chars, 1), chars / tags, chars / np.maximum(runs, 1),
        np.log1p(tags), depth, place, place / np.maximum(below[up], 1), below[up], chars / np.maximum(chars[up], 1),
        chars / total, before / total, np.log1p(links[up]), links[up] / np.maximum(chars[up], 1), chars[up] / tags[up], headings, below, with_tokens,
        speak, low, high, speak + low, np.log1p(chars[up]), np.log1p(stops), np.array(page.inline),
    ]
    return np.column_stack([*columns, group, above]).astype(np.float32)


class Extractor:
    """Trees and token odds, fitted on pages whose nodes are labelled."""

    def __init__(self, pages: list[tuple[Page, np.ndarray]]):
        counts = defaultdict(lambda: [1.0, 1.0])
        for page, y in pages:
            for v, tokens in enumerate(page.tokens):
                for t in set(tokens):
                    counts[t][int(y[v])] += 1
        self.odds = {t: float(np.log(b / a)) for t, (a, b) in counts.items() if a + b >= 5}
        x = np.concatenate([features(p, self.odds) for p, _ in pages])
        self.trees = BoostedTrees().fit(x, np.concatenate([y for _, y in pages]).astype(float))

    def kept(self, pages: list[Page]) -> list[list[bool]]:
        """Which nodes stay: a node stays only if its parent does, so that nothing is kept in what is dropped.

        A node's gain is its own log-odds, and its children's gains where they are above 0, each by its share of the text;
        a node goes with all below it if its gain isn't above 0. The page's root stays.
        """
        rows = [features(p, self.odds) for p in pages]
        logits, at, out = np.clip(self.trees.logits(np.concatenate(rows)), -6, 6), 0, []
        for page, x in zip(pages, rows, strict=True):
            n, gain = len(x), logits[at : at + len(x)].tolist()
            at += n
            share = x[:, 11].tolist()
            for v in range(n - 1, 0, -1):
                if page.hidden[v]:
                    gain[v] = -99.0
                if gain[v] > 0:
                    gain[page.parent[v]] += gain[v] * min(1.0, share[v])
            stay = [True] * n
            for v in range(1, n):
                stay[v] = stay[page.parent[v]] and gain[v] > 0
            out.append(stay)
        return out

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        return [page.text(stay) for page, stay in zip(pages, self.kept(pages), strict=True)] if pages else []


def labelled(page: Page, weak: bool = False) -> tuple[Page, np.ndarray]:
    """1 for each node that holds main text. Of made-up pages the marks tell; of sampled ones the tags that name their own meaning do."""
    n, inside = len(page.tag), []
    for v in range(n):
        up = inside[page.parent[v]] if v else False
        mark = page.mark[v] if not weak else True if page.tag[v] in ("article", "main") else False if page.tag[v] in ("nav", "aside", "footer", "form") else None
        inside.append(up if mark is None else mark)
    y = np.zeros(n, bool)
    for v, _, _ in page.runs:
        y[v] |= inside[v] and not page.hidden[v]
    for v in range(n - 1, 0, -1):
        y[page.parent[v]] |= y[v]
    return page, y


# How authors name the parts of a page.
MAIN_NAMES = "article content post-content entry-content story-body main-content article-body post entry text body-text page-content post-body article__body c-article rich-text prose markdown-body".split()
WRAP_NAMES = "wrapper container page site layout row col inner outer grid wrap app root section block".split()
OTHER_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs topnav pagination pager toc skip-links".split(),
    "header": "header site-header masthead top-bar topbar branding logo page-header banner-top".split(),
    "footer": "footer site-footer bottom colophon copyright legal foot footer-links page-footer".split(),
    "aside": "sidebar side-bar widget related related-posts aside rail recommended more-stories trending popular tags tag-list author-box right-column".split(),
    "notice": "cookie cookie-notice cookie-banner consent gdpr notice alert notification popup modal paywall newsletter subscribe message warning disclaimer overlay toast".split(),
    "ad": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner ad-container adsense dfp".split(),
    "form": "form search search-form login signup newsletter-form contact-form subscribe-form poll".split(),
    "comments": "comments comment comment-list responses replies discussion disqus comment-body reply thread reader-comments user-comments".split(),
    "share": "share social share-buttons social-links sharing follow toolbar actions".split(),
}
INLINE_ADS = "ad ads advert advertisement ad-slot adsense ad-container".split()
ANY_NAMES = [*MAIN_NAMES, *WRAP_NAMES, *(n for names in OTHER_NAMES.values() for n in names if n not in INLINE_ADS)]
SAID = "home about contact news sports login register search next previous read more share tweet subscribe privacy terms cookies accept reply like report sign up menu archive help".split()


def made_page(rng: random.Random, texts: list[str]) -> str:
    """A page of a random make with marks in data-y, from pieces of the sample's own texts."""
    say = lambda: rng.choice(texts)
    few = lambda: " ".join(rng.sample(SAID, rng.randint(1, 3))) if rng.random() < 0.5 else " ".join(say().split()[: rng.randint(1, 4)])

    def attr(names: list[str]) -> str:
        if rng.random() < 0.1:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", " " + rng.choice(WRAP_NAMES), "-" + str(rng.randint(1, 9))])}"'

    def links(n: int) -> str:
        kind = rng.choice(["ul", "ul", "div", "p"])
        if kind == "ul":
            return "<ul>" + "".join(f'<li><a href="#">{few()}</a></li>' for _ in range(n)) + "</ul>"
        return f"<{kind}>" + rng.choice([" | ", " ", ""]).join(f'<a href="#">{few()}</a>' for _ in range(n)) + f"</{kind}>"

    def other(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "form": ["form", "div"], "comments": ["section", "div", "div"]}.get(kind, ["div", "div", "section", "aside"])
        name, a = rng.choice(tag), attr(OTHER_NAMES[kind])
        if kind in ("notice", "form") and rng.random() < 0.3 or kind == "comments" and rng.random() < 0.3:
            name, a = ("aside" if rng.random() < 0.5 else "div"), a or f' class="{rng.choice(OTHER_NAMES[kind])}"'
        if kind == "comments":
            each = lambda: rng.choice([f"<p>{say()}</p>", f'<div class="comment"><b>{few()}</b> {say()}</div>', f"<li>{say()}</li>", f'<article class="comment"><p>{say()}</p></article>'])
            inner = rng.choice(["", "<h2>Comments</h2>", "<h3>Responses</h3>"]) + "".join(each() for _ in range(rng.randint(1, 8)))
            a = a or ' class="comments"'
        elif kind == "form":
            inner = f'<label>{few()}</label><input name="q"><button>{few()}</button>' + (f"<p>{say()[:120]}</p>" if rng.random() < 0.5 else "")
        elif kind == "nav" or kind == "share":
            inner = links(rng.randint(2, 9))
        elif kind == "header":
            inner = rng.choice([f"<h1>{few()}</h1>", f'<a href="/">{few()}</a>', f"<p>{few()}</p>"]) + (other("nav") if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = rng.choice([f"&copy; {few()} &middot; {say()[:120]}", f"<p>{say()}</p>", links(rng.randint(2, 6)) + f"<p>&copy; {few()}</p>"])
        elif kind == "aside":
            inner = rng.choice([f"<h3>{few()}</h3>" + links(rng.randint(2, 7)), f"<h4>{few()}</h4><p>{say()}</p>", f"<p>{say()}</p>"])
        else:
            inner = rng.choice([say(), f"<p>{say()}</p>", f'<p>{say()[:150]}</p><a href="#">{few()}</a>', few()])
        return f'<{name}{a} data-y="0">{inner}</{name}>'

    def within(sentence: str) -> str:
        """The sentence with an element around some of its words, of whatever name, or with an advert put into it."""
        words = sentence.split()
        i = rng.randint(0, len(words))
        if rng.random() < 0.3:
            words.insert(i, f'<span class="{rng.choice(INLINE_ADS)}" data-y="0">{few()}</span>')
        else:
            j, name, tag = rng.randint(i, len(words)), rng.choice(ANY_NAMES), rng.choice(["span", "span", "a", "b", "em"])
            words[i:j] = [f'<{tag} class="{name}{rng.choice(["", "", "-link", "-text"])}" data-y="1">{" ".join(words[i:j])}</{tag}>'] if j > i else []
        return " ".join(words)

    def main() -> str:
        parts = []
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.72:
                parts.append(f"<p>{rng.choice(['', '<b>', '<em>', '<a href=#>'])}{within(say()) if rng.random() < 0.4 else say()}{rng.choice(['', '<br>' + say()])}</p>")
            elif kind < 0.8:
                parts.append(f"<h{(k := rng.randint(2, 4))}>{few()}</h{k}><p>{say()}</p>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{say()[:100]}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{say()}</p></blockquote>")
            elif kind < 0.94:
                parts.append(f"<table><tr><td>{few()}</td><td>{say()[:60]}</td></tr></table>")
            else:
                parts.append(say())
        inside = [k for k in ("ad", "share", "aside", "form", "notice") if rng.random() < 0.12]
        for k in inside:
            parts.insert(rng.randint(0, len(parts)), other(k))
        head = f"<h1>{few() if rng.random() < 0.5 else say()[:70]}</h1>"
        parts.insert(0, f"<header>{head}</header>" if rng.random() < 0.15 else head if rng.random() < 0.85 else "")
        tag = rng.choice(["article", "article", "main", "div", "div", "section"])
        a = attr(MAIN_NAMES) if tag in ("div", "section") or rng.random() < 0.4 else ""
        return f'<{tag}{a} data-y="1">{"".join(parts)}</{tag}>'

    body = [main()]
    for kind in ("header", "nav", "notice", "ad"):
        if rng.random() < 0.5:
            body.insert(0, other(kind))
    for kind in ("aside", "ad", "comments", "share", "form", "notice", "footer"):
        if rng.random() < 0.5:
            body.insert(rng.randint(body.index(next(x for x in body if 'data-y="1"' in x)), len(body)) if kind != "footer" else len(body), other(kind))
    page = "".join(body)
    for _ in range(rng.randint(0, 3)):
        page = f"<div{attr(WRAP_NAMES)}>{page}</div>"
    return f'<!DOCTYPE html><html><head><title>{few()}</title><script>var a="<p>";</script></head><body data-y="0">{page}</body></html>'


def fitted(sample: list[str], made: int = MADE, seed: int = 7) -> Extractor:
    """Fitted on sampled pages with a single article, by their tags, and on made-up pages, by their marks."""
    pages = [Page(s) for s in sample]
    texts = [run for p in pages for _, run, _ in p.runs if len(run) > 20] or ["some words of a page, and some more.", "another text with a few words in it."]
    rng = random.Random(seed)
    known = [labelled(p, weak=True) for p in pages if sum(t in ("article", "main") for t in p.tag) == 1]
    return Extractor([labelled(Page(made_page(rng, texts))) for _ in range(made)] + known)


def sampled(pages: DataFrame, n: int = SAMPLE) -> list[str]:
    """The html of n pages, those whose ids have the least hashes; those over SAMPLE_CHARS are left out."""
    ids = [r[0] for r in pages.where("page_id is not null").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(n).collect()]
    found = pages.where(F.col("page_id").isin(ids) & (F.length("html") <= SAMPLE_CHARS)).select("page_id", "html").orderBy("page_id", "html").limit(n)
    return [r["html"] for r in found.collect()]


def extract(pages: DataFrame, model: Extractor) -> DataFrame:
    """PAGE of each row (page_id, url, html): the main text, empty if there is none or html is null. Works page by page, over whole pages.

    Repeated rows give a row each, with equal texts; an empty table gives none. Of gains that are 0 in a node, the node goes.
    """

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, 64):
            ids, urls, sources = (c.to_pylist() for c in batch.slice(at, 64).columns)
            for page_id, url, text in zip(ids, urls, model.texts([s or "" for s in sources]), strict=True):
                yield page_id, url, text, len(text)

    return common.map_rows(pages.select("page_id", "url", "html"), PAGE, rows, lambda r: 100 + 2 * r[3])


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fitted(sampled(pages)))

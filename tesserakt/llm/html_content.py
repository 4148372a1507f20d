"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: elements, and under them runs of text. Every node is
content, boilerplate, or mixed (an element that holds both). Parent-child
potentials and the nodes' own evidence (tag, words of class, id and role, share
of linked text, length) are counted on labelled pages; sum-product messages go
up the tree and down again and give each node's marginals. Runs of text that
are content more likely than not make the text, in page order.

The labelled pages are made by ``labelled_pages``: layouts of articles with
menus, headers, footers, sidebars, notices, adverts, forms and comments, each
part labelled as it is placed.

A null or empty page gives an empty text; so does one without content. Broken
markup is read as browsers do in the common cases: paragraphs and list items
that aren't closed, stray end tags, quotes and comments that don't end. What script,
style, title and textarea hold, and the fallback of frames, is no text of the page,
also when they aren't closed; all other elements, drawings, formulas and objects too,
are read as any element, and the model decides. Pages are read in time linear in
their length, however deep or broken, and without recursion. Repeated rows are read
each for itself; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CONTENT, BOILERPLATE, MIXED = 0, 1, 2
SMOOTHING = 0.2

#: A tag's beginning, and what follows its name up to the end of the tag, quoted values passed over; neither goes back over what it has read.
OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements whose content is no markup; of these, plain text that is shown.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SHOWN = frozenset(["xmp"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr picture audio video map".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}


class Page:
    """Nodes in page order: parent, evidence, and the text of leaves with whether a block began before it."""

    def __init__(self, text: str):
        self.parent = [-1]
        self.tags = ["#page"]
        self.words: list[tuple[str, ...]] = [()]
        self.text: dict[int, list[str]] = {}
        self.breaks: set[int] = set()
        self.linked: Counter = Counter()
        self._stack = [0]
        #: Places in the stack of the open elements of each tag, and of all that are no inline elements.
        self._open: defaultdict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []
        self._leaf = -1
        self._break = True
        self._link = False
        self._parse(text)

    def _node(self, tag: str, words: tuple[str, ...] = ()) -> int:
        self.parent.append(self._stack[-1])
        self.tags.append(tag)
        self.words.append(words)
        return len(self.parent) - 1

    def _chars(self, raw: str) -> None:
        if not raw:
            return
        if self._leaf < 0:
            if raw.isspace():
                self._space = True
                return
            self._leaf = self._node("#text")
            if self._break:
                self.breaks.add(self._leaf)
            self._break = False
            self.text[self._leaf] = [" "] if self._space else []
        self._space = False
        self.text[self._leaf].append(raw)
        if self._link:
            self.linked[self._leaf] += len(raw)

    _space = False

    def _cut(self, block: bool) -> None:
        self._leaf = -1
        if block:
            self._break, self._link = True, False

    def _push(self, tag: str, words: tuple[str, ...]) -> None:
        node = self._node(tag, words)
        self._open[tag].append(len(self._stack))
        if tag not in INLINE:
            self._blocks.append(len(self._stack))
        self._stack.append(node)

    def _pop_to(self, at: int) -> None:
        block = bool(self._blocks) and self._blocks[-1] >= at
        while len(self._stack) > at:
            tag = self.tags[self._stack.pop()]
            self._open[tag].pop()
            if tag not in INLINE:
                self._blocks.pop()
        self._cut(block)

    def _nearest(self, tags: set[str]) -> int:
        """Place in the stack of the innermost open element of these tags, 0 for none."""
        return max((self._open[t][-1] for t in tags if self._open[t]), default=0)

    def _parse(self, text: str) -> None:
        at, quotes, n = 0, True, len(text)
        while at < n:
            sign = text.find("<", at)
            if sign < 0:
                break
            begin = at
            if text.startswith("<!--", sign):
                end = COMMENT_END.search(text, sign + 2)
                stop = end.end() if end else n
            elif text.startswith("<![CDATA[", sign):
                end = text.find("]]>", sign)
                self._chars(html.unescape(text[begin:sign]))
                self._chars(text[sign + 9 : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
                continue
            elif text.startswith(("<!", "<?", "</"), sign) and not text[sign + 2 : sign + 3].isalpha() or text.startswith("<!", sign):
                stop = text.find(">", sign) + 1 or n
            else:
                m = OPEN.match(text, sign + 1)
                if not m:  # a sign that opens nothing
                    self._chars(html.unescape(text[begin : sign + 1]))
                    at = sign + 1
                    continue
                rest = REST.match(text, m.end()) if quotes else None
                stop = rest.end() if rest else text.find(">", m.end()) + 1
                if not rest:  # a quote that doesn't end: from here on, the next sign ends a tag
                    quotes = False
                self._chars(html.unescape(text[begin:sign]))
                if not stop:  # the page ends within the tag
                    return
                at = self._tag(text, m[1] == "/", m[2].lower(), text[m.end() : stop - 1], stop)
                continue
            self._chars(html.unescape(text[begin:sign]))
            at = stop
        self._chars(html.unescape(text[at:]))

    def _tag(self, text: str, ends: bool, tag: str, attributes: str, at: int) -> int:
        """Take in a tag that ends at `at`; where to read on."""
        if ends:
            self._end(tag)
            return at
        if tag not in RAW:
            self._start(tag, attributes)
            return at
        if attributes.endswith("/") and tag not in ("script", "style", "textarea", "title"):
            return at
        end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(text, at)
        inside = text[at : end.start() if end else len(text)]
        if tag in SHOWN:
            self._cut(True)
            self._chars(inside)
            self._cut(True)
        close = text.find(">", end.end()) if end else -1
        return close + 1 if close >= 0 else len(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self._cut(True) if tag == "hr" else self._chars(" ")
            return
        if tag in ("html", "head", "body"):
            self._cut(True)
            return
        words: tuple[str, ...] = ()
        if attributes:
            found = []
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                found += [name.lower() + "=" + x if name.lower() in ("role", "itemprop") else x for x in NAME_PART.findall(CAMEL.sub(" ", a or b or c).lower())]
            words = tuple(dict.fromkeys(found))
        if tag in INLINE:
            if tag == "a":
                self._link = True
            if not words:
                return
            self._cut(False)
            self._push(tag, words)
            return
        if tag in CLOSES_P and (p := self._nearest({"p"})) > self._nearest({"table", "button", "td"}):
            self._pop_to(p)
        if tag in CLOSED_BY:
            scope = self._nearest(SCOPE.get(tag, set()))
            while (open_ := self._nearest(CLOSED_BY[tag])) > scope:
                self._pop_to(open_)
        self._cut(True)
        self._push(tag, words)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        if tag == "br":
            self._chars(" ")
        open_ = self._nearest({tag})
        if open_ and (tag not in INLINE or open_ > (self._blocks[-1] if self._blocks else 0)):
            self._pop_to(open_)
        elif tag not in INLINE:
            self._cut(True)

    def evidence(self) -> list[list[str]]:
        """Features of every node; lengths and links are of all text under it."""
        n = len(self.parent)
        size, linked = [0] * n, [0] * n
        for leaf, parts in self.text.items():
            size[leaf], linked[leaf] = sum(map(len, parts)), self.linked[leaf]
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            linked[self.parent[i]] += linked[i]
        out: list[list[str]] = [[]]  # the page itself shows nothing of its own
        for i in range(1, n):
            share = linked[i] / size[i] if size[i] else 0
            links = "none" if not linked[i] else "some" if share < 0.3 else "half" if share < 0.7 else "all"
            kind = "leaf" if i in self.text else "node"
            out.append([f"{kind} tag {self.tags[i]}", f"{kind} links {links}", f"{kind} size {min(size[i].bit_length(), 10) // 2}", *(f"word {w}" for w in self.words[i])])
        return out

    def leaf_labels_up(self, leaf_label: dict[int, int]) -> list[int]:
        """Every node's label from its leaves'; an element without text is as its parent."""
        n = len(self.parent)
        seen: list[set[int]] = [set() for _ in range(n)]
        for i in range(n - 1, -1, -1):
            if i in leaf_label:
                seen[i].add(leaf_label[i])
            if i:
                seen[self.parent[i]] |= seen[i]
        labels = []
        for i in range(n):
            labels.append(MIXED if len(seen[i]) == 2 else next(iter(seen[i])) if seen[i] else labels[self.parent[i]] if i else BOILERPLATE)
        return labels


class Model:
    def __init__(self, evidence: dict[str, np.ndarray], root: np.ndarray, child: np.ndarray):
        #: log P(feature | label), log P(label of the root), log P(label of a child | label of its parent)
        self.evidence, self.root, self.child = evidence, root, child

    def marginals(self, page: Page) -> np.ndarray:
        """P(label | page) of every node, by sum-product: messages up, then down. Children follow their parents."""
        n = len(page.parent)
        own = np.zeros((n, 3))
        for i, names in enumerate(page.evidence()):
            for name in names:
                got = self.evidence.get(name)
                if got is not None:
                    own[i] += got
            if i in page.text:
                own[i, MIXED] = -60.0
        up = own.tolist()
        child = np.exp(self.child).tolist()
        message: list = [None] * n
        from math import exp, log

        for i in range(n - 1, 0, -1):
            a, b, c = up[i]
            top = max(a, b, c)
            a, b, c = exp(a - top), exp(b - top), exp(c - top)
            m = [log(r[0] * a + r[1] * b + r[2] * c) + top for r in child]
            message[i] = m
            p = up[page.parent[i]]
            p[0] += m[0]
            p[1] += m[1]
            p[2] += m[2]
        belief = np.zeros((n, 3))
        for i in range(n):
            if i == 0:
                b = [x + y for x, y in zip(up[0], self.root, strict=True)]
            else:
                p, m = belief[page.parent[i]], message[i]
                # what the parent believes without this child, times the step to the child
                rest = [log(max(p[k], 1e-300)) - m[k] for k in range(3)]
                top = max(rest)
                rest = [exp(x - top) for x in rest]
                b = [up[i][k] + log(sum(rest[j] * child[j][k] for j in range(3)) + 1e-300) for k in range(3)]
            top = max(b)
            e = [exp(x - top) for x in b]
            s = sum(e)
            belief[i] = [x / s for x in e]
        return belief

    def extract(self, text: str | None) -> str:
        page = Page(text or "")
        if not page.text:
            return ""
        belief = self.marginals(page)
        out = []
        block = False
        for leaf, parts in page.text.items():
            block |= leaf in page.breaks
            if belief[leaf, CONTENT] > 0.5:
                out.append((" " if block else "") + "".join(parts))
                block = False
        return " ".join("".join(out).split())


def labelled_pages(n: int = 600, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """Pages and the label of each run of text, in page order."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f k l m n p r s t v".split() for b in "a e i o u an er in on".split()]

    def sentence(least: int, most: int) -> str:
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(least, most))]
        return " ".join(words).capitalize() + rng.choice(". . . ! ?".split())

    def prose(sentences: int) -> str:
        return " ".join(sentence(4, 18) for _ in range(rng.randint(1, sentences)))

    def item(text: str, label: int) -> str:
        labels.append(label)
        return text

    def named(tag: str, names: str) -> str:
        name = rng.choice(names.split())
        kind = rng.choice(["class", "class", "id"])
        return f'<{tag} {kind}="{name}">' if name != "-" else f"<{tag}>"

    def links(tag: str, label: int, least: int = 2, most: int = 9) -> str:
        return "".join(f'<{tag}><a href="/{i}">{item(sentence(1, 3)[:-1], label)}</a></{tag}>' for i in range(rng.randint(least, most)))

    def menu() -> str:
        tag = rng.choice(["nav", "nav", "div", "ul"])
        if tag == "ul":
            return named("ul", "menu nav navbar topnav breadcrumb breadcrumbs pager pagination") + links("li", 1) + "</ul>"
        return (f"<{tag}>" if tag == "nav" and rng.random() < 0.6 else named(tag, "menu main-menu navigation nav navbar breadcrumb breadcrumbs toc pagination skip links")) + "<ul>" + links("li", 1) + f"</ul></{tag}>"

    def header() -> str:
        opened = "<header>" if rng.random() < 0.6 else named("div", "header site-header masthead topbar banner branding logo")
        end = "</header>" if opened.startswith("<header") else "</div>"
        return opened + rng.choice(["<p>", "<h1>", "<div>", "<a href='/'>"]) + item(sentence(1, 5), 1) + (menu() if rng.random() < 0.4 else "") + end

    def footer() -> str:
        opened = "<footer>" if rng.random() < 0.7 else named("div", "footer site-footer copyright colophon legal bottom")
        end = "</footer>" if opened.startswith("<footer") else "</div>"
        return opened + item(rng.choice(["&copy; ", "", "2024 "]) + rng.choice([sentence(2, 6), prose(2)]), 1) + ("<ul>" + links("li", 1) + "</ul>" if rng.random() < 0.4 else "") + end

    def advert() -> str:
        return named(rng.choice(["div", "div", "aside", "section", "p"]).replace("p", "div"), "ad ads advert advertisement ad-slot adbox sponsor sponsored promo promotion banner-ad") + rng.choice(["", "<p>", "<a href='x'>"]) + item(prose(3), 1) + "</div>"

    def side() -> str:
        tag = rng.choice(["aside", "aside", "div", "section"])
        opened = "<aside>" if tag == "aside" and rng.random() < 0.6 else named(tag, "sidebar side-bar widget related recommended recent popular trending tags archive bio author-box share social")
        body = rng.choice([lambda: "<ul>" + links("li", 1) + "</ul>", lambda: "<p>" + item(prose(2), 1) + "</p>"])
        return opened + (f"<h3>{item(sentence(1, 3)[:-1], 1)}</h3>" if rng.random() < 0.6 else "") + body() + f"</{tag}>"

    def notice() -> str:
        tag = rng.choice(["div", "div", "section", "dialog"])
        opened = named(tag, "cookie cookies cookie-notice cookie-banner consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer privacy")
        return opened + "<p>" + item(prose(2), 1) + "</p>" + (f"<button>{item(sentence(1, 2)[:-1], 1)}</button>" if rng.random() < 0.6 else "") + f"</{tag}>"

    def form() -> str:
        opened = "<form>" if rng.random() < 0.5 else named("form", "search login signup contact newsletter - subscribe")
        return opened + f"<label>{item(sentence(1, 3)[:-1], 1)}</label><input name=q>" + (f"<select><option>{item(sentence(1, 1)[:-1], 1)}<option>{item(sentence(1, 1)[:-1], 1)}</select>" if rng.random() < 0.3 else "") + f"<button>{item(sentence(1, 2)[:-1], 1)}</button>" + ("<p>" + item(sentence(3, 9), 1) + "</p>" if rng.random() < 0.3 else "") + "</form>"

    def comments() -> str:
        tag = rng.choice(["section", "div", "div", "ol"])
        one = lambda: named(rng.choice(["div", "li", "article"]).replace("li", "div"), "comment comment-body reply respond comment-text review")[:-1] + ">" + rng.choice(["<p>", "<b>", "<p>"]) + item(prose(3), 1) + "</p></b></div></article>"
        return named(tag, "comments comment-list disqus discussion replies responses reader-comments") + (f"<h2>{item(sentence(1, 3)[:-1], 1)}</h2>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    def body() -> str:
        out = [f"<h1>{item(sentence(2, 9)[:-1], 0)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.62:
                link = f' <a href="/x">{item_part(sentence(1, 3)[:-1])}</a> ' if rng.random() < 0.2 else ""
                out.append(rng.choice(["<p>", "<p>", "<p>", "<p><b>"]) + item(prose(5), 0) + link + rng.choice(["</p>", "</p>", "", "<br>"]))
            elif kind < 0.7:
                out.append(f"<h2>{item(sentence(1, 6)[:-1], 0)}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{item(sentence(2, 14), 0)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.83:
                out.append("<blockquote><p>" + item(prose(2), 0) + "</p></blockquote>")
            elif kind < 0.87:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{item(sentence(1, 3)[:-1], 0)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.9:
                out.append("<figure><img src=x><figcaption>" + item(sentence(2, 9), 0) + "</figcaption></figure>")
            elif kind < 0.93:
                out.append("<pre>" + item(prose(2), 0) + "</pre>")
            elif kind < 0.97:
                out.append(named("div", "row col inner block text paragraph section -") + item(prose(3), 0) + "</div>")
            else:
                out.append(rng.choice([advert, side, form, notice])())
        return "".join(out)

    def item_part(text: str) -> str:
        return text  # within a run that is labelled already

    def article() -> str:
        opened, end = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ("", "</div>"), ("", "</div>"), ("<section>", "</section>"), ("<body>", ""), ("<body>", "")])
        return (opened or named("div", "content main-content post post-body entry entry-content article article-body story page-content text body-text")) + body() + end

    def wrapped(x: str) -> str:
        return named("div", "wrapper container page wrap layout site inner row col main root app") + x + "</div>" if rng.random() < 0.4 else x

    for _ in range(n):
        labels: list[int] = []
        alone = rng.random() < 0.2
        before = [] if alone else [f() for f in rng.sample([header, menu, advert, notice, form, side], rng.randint(0, 4))]
        middle = rng.choice([article, body, lambda: item(prose(2), 0)])() if alone else article() if rng.random() < 0.97 else ""
        after = [] if alone else [f() for f in rng.sample([comments, side, advert, notice, form, menu], rng.randint(0, 4))] + [footer() for _ in range(rng.random() < 0.8)]
        text = wrapped("".join(before) + middle + "".join(after))
        yield f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{text}</body></html>", labels


def train(pages: Iterator[tuple[str, list[int]]] | None = None) -> Model:
    """Count evidence and parent-child potentials on labelled pages."""
    seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    total, root, child = np.zeros(3), np.full(3, 0.5), np.full((3, 3), 0.05)
    child += np.eye(3) * 0.5
    child[:, MIXED] = (0.001, 0.001, 1.0)
    for text, labels in pages if pages is not None else labelled_pages():
        page = Page(text)
        if len(page.text) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(page.text)} runs of text")
        states = page.leaf_labels_up(dict(zip(page.text, labels, strict=True)))
        for i, names in enumerate(page.evidence()):
            total[states[i]] += 1
            for name in names:
                seen[name][states[i]] += 1
            if i:
                child[states[page.parent[i]], states[i]] += 1
        root[states[0]] += 1
    evidence = {name: np.log((c + SMOOTHING) / (total + 2 * SMOOTHING)) for name, c in seen.items() if c.sum() >= 2}
    evidence = {name: e - e.max() for name, e in evidence.items()}
    return Model(evidence, np.log(root / root.sum()), np.log(child / child.sum(axis=1, keepdims=True)))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and its number of characters."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    out = pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})

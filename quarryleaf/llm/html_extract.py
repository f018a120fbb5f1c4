"""Main-text extraction from HTML by a tree-structured graphical model.

Block elements and runs of text are the nodes of a page's tree. Each node is content or not; a potential joins it with
its parent, another with what is seen of it. Upward and downward sum-product messages give the exact marginals, and the
runs whose marginal is at least one half are the text. Potentials are counted on labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by how a parser treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIPPED = RAW | frozenset("template svg math object canvas audio video select option datalist button map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements that hold parts of a page; parent-child potentials differ for these, for other elements and for runs.
HOLDERS = frozenset("html body div section main article center table tbody tr td form fieldset details".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']*+)|["'])*+)>""")
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_EITHER = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])([^>]*)>", re.I) for tag in SKIPPED}


class Node:
    __slots__ = ("tag", "names", "parent", "text", "linked", "kids")

    def __init__(self, tag: str, names: tuple[str, ...], parent: int):
        self.tag, self.names, self.parent = tag, names, parent
        self.text: list[str] = []
        self.linked = 0
        self.kids = 0


def _self_closed(attributes: str) -> bool:
    """A slash ends the tag, and is not the end of an unquoted value."""
    return attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'")


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of this name that has an end tag begins and ends; inner ones end first."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for m in _EITHER[tag].finditer(page):
        if m.group(1):
            if open_:
                out[open_.pop()] = m.end()
        elif not _self_closed(m.group(2)):
            open_.append(m.start())
    return out


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents before children: block elements, and under them runs of text (tag '#').

    Scripts, styles, forms' fields, embedded objects and the like are passed over with what they hold, nested ones to the
    end of the outermost. One that closes itself or has no end tag holds nothing, and the page goes on; only after a
    script or style without an end is the rest its own. What style sheets or `hidden` would hide is read like the rest.
    """
    nodes = [Node("#root", (), -1)]
    stack: list[tuple[str, int]] = [("#root", 0)]
    run: Node | None = None
    links = 0
    at, end = 0, len(page)
    ends: dict[str, dict[int, int]] = {}
    endless: set[str] = set()

    def past(tag: str, attributes: str, start: int, after: int) -> int:
        """Where the page goes on behind an element that is passed over."""
        if tag not in RAW:
            if tag not in ends:
                ends[tag] = _ends(page, tag)
            return ends[tag].get(start, after)
        if _self_closed(attributes):
            return after
        close = None if tag in endless else next((m for m in _EITHER[tag].finditer(page, after) if m.group(1)), None)
        if close:
            return close.end()
        endless.add(tag)
        return end if tag in ("script", "style") else after

    def write(piece: str) -> None:
        nonlocal run
        if run is None:
            if not piece.strip():
                return
            nodes[stack[-1][1]].kids += 1
            run = Node("#", (), stack[-1][1])
            nodes.append(run)
        run.text.append(piece)
        if links:
            run.linked += len(piece)

    def leave(depth: int) -> None:
        nonlocal run, links
        for tag, _ in stack[depth:]:
            links -= tag == "a"
            if tag not in INLINE:
                run = None
        del stack[depth:]

    def innermost(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return depth
            if stack[depth][0] in stop:
                return 0
        return 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            write(html.unescape(page[at:]))
            break
        if lt > at:
            write(html.unescape(page[at:lt]))
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if lt + 1 < end and page[lt + 1] in "!?":
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            follows = page[lt + 1 : lt + 3]
            if follows[:1].isalpha() or (follows[:1] == "/" and follows[1:].isalpha()):
                break  # a tag that never ends
            write("<")
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if closing:
            if tag == "br":
                write(" ")
                continue
            depth = innermost({tag}, frozenset() if tag not in INLINE else frozenset({"td", "th", "body"}))
            if depth:
                leave(depth)
            continue
        if tag == "br":
            if run is not None:
                write(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                run = None
            continue
        if tag in SKIPPED:
            at = past(tag, attributes, lt, at)
            continue
        if tag in CLOSES_P:
            depth = innermost({"p"}, frozenset({"td", "th", "div", "article", "section", "li", "button", "object"}))
            if depth:
                leave(depth)
        if tag in SIBLINGS:
            depth = innermost(*SIBLINGS[tag])
            if depth:
                leave(depth)
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
            continue
        run = None
        names = tuple(w for _, v in _ATTR.findall(attributes) for w in _WORD.findall(v.lower())) if attributes else ()
        nodes[stack[-1][1]].kids += 1
        nodes.append(Node(tag, names, stack[-1][1]))
        stack.append((tag, len(nodes) - 1))
    return nodes


def features(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each node: of an element its tag with the share of links in what it holds, and the words of class,
    id and role; of a run its length, links and sentences."""
    size, linked = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        if node.tag == "#":
            size[k], linked[k] = sum(map(len, node.text)), node.linked
        size[node.parent] += size[k]
        linked[node.parent] += linked[k]
    out = []
    for k, node in enumerate(nodes):
        share = linked[k] / max(1, size[k])
        links = 0 if not linked[k] else 1 if share < 0.3 else 2 if share < 0.8 else 3
        if node.tag != "#":
            out.append([f"tag {node.tag} {links}", *(f"name {w}" for w in set(node.names))])
            continue
        words = "".join(node.text).split()
        out.append([f"words {min(6, int(math.log2(len(words) + 1)))}", f"links {links}", f"stops {min(2, sum(w[-1] in '.!?' for w in words))}"])
    return out


def _kind(node: Node) -> int:
    return 0 if node.tag == "#" else 1 if node.tag in HOLDERS else 2


class TreeModel:
    """P(root) * prod P(child | parent) * prod P(feature | node), counted on labelled trees, add-one smoothed."""

    def __init__(self, root: tuple[float, float], edge: dict[tuple[int, int, int], float], seen: dict[str, float]):
        self.root, self.edge, self.seen = root, edge, seen

    @classmethod
    def trained(cls, pages: Iterator[tuple[str, set[str]]]) -> TreeModel:
        """pages: html, and the runs of text (white space collapsed) that are content. The smallest element that holds
        all of them is content, and so are elements above it that hold nothing else and, below it, those of which half
        the runs at least are content."""
        roots, edges, counts, total = Counter(), Counter(), Counter(), Counter()
        for page, content in pages:
            nodes = parse(page)
            labels = [0] * len(nodes)
            good, bad = [0] * len(nodes), [0] * len(nodes)
            for k in range(len(nodes) - 1, 0, -1):
                if nodes[k].tag == "#":
                    labels[k] = int(" ".join("".join(nodes[k].text).split()) in content)
                    good[k], bad[k] = labels[k], 1 - labels[k]
                else:
                    labels[k] = int(good[k] > 0 and good[k] >= bad[k])
                good[nodes[k].parent] += good[k]
                bad[nodes[k].parent] += bad[k]
            whole = good[0]
            for k, node in enumerate(nodes):
                if node.tag != "#" and good[k] == whole and bad[k] and any(good[j] == whole for j in range(k + 1, len(nodes)) if nodes[j].parent == k):
                    labels[k] = 0
            labels[0] = 0
            for k, (node, seen) in enumerate(zip(nodes, features(nodes), strict=True)):
                if node.parent < 0:
                    roots[labels[k]] += 1
                else:
                    edges[_kind(node), labels[node.parent], labels[k]] += 1
                group = "#" if node.tag == "#" else "e"
                total[labels[k], group] += 1
                for f in seen:
                    counts[labels[k], f] += 1
        edge = {(t, p, c): (edges[t, p, c] + 1) / (edges[t, p, 0] + edges[t, p, 1] + 2) for t in (0, 1, 2) for p in (0, 1) for c in (0, 1)}
        seen = {}
        for f in {f for _, f in counts}:
            group = "e" if f.startswith(("tag ", "name ")) else "#"
            seen[f] = math.log((counts[1, f] + 1) / (total[1, group] + 2)) - math.log((counts[0, f] + 1) / (total[0, group] + 2))
        n = sum(roots.values())
        return cls(((roots[0] + 1) / (n + 2), (roots[1] + 1) / (n + 2)), edge, seen)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by one upward and one downward pass of messages."""
        n = len(nodes)
        edges = [tuple(self.edge[t, p, c] for p in (0, 1) for c in (0, 1)) for t in (0, 1, 2)]
        kind = [_kind(x) for x in nodes]
        local0, local1 = [1.0] * n, [1.0] * n
        for k, seen in enumerate(features(nodes)):
            d = sum(self.seen.get(f, 0.0) for f in seen)
            d = max(-30.0, min(30.0, d))
            local1[k] = 1 / (1 + math.exp(-d))
            local0[k] = 1 - local1[k] if d < 20 else math.exp(-d)
        up0, up1 = local0[:], local1[:]
        m0, m1 = [1.0] * n, [1.0] * n
        for k in range(n - 1, 0, -1):
            p = nodes[k].parent
            e00, e01, e10, e11 = edges[kind[k]]
            a = e00 * up0[k] + e01 * up1[k]
            b = e10 * up0[k] + e11 * up1[k]
            m0[k], m1[k] = a / (a + b), b / (a + b)
            x, y = up0[p] * m0[k], up1[p] * m1[k]
            up0[p], up1[p] = max(x / (x + y), 1e-300), max(y / (x + y), 1e-300)
        out = [0.0] * n
        full0, full1 = [0.0] * n, [0.0] * n
        x, y = up0[0] * self.root[0], up1[0] * self.root[1]
        full0[0], full1[0] = x / (x + y), y / (x + y)
        out[0] = full1[0]
        for k in range(1, n):
            p = nodes[k].parent
            e00, e01, e10, e11 = edges[kind[k]]
            c0, c1 = full0[p] / m0[k], full1[p] / m1[k]  # all of the parent's messages but this child's own
            d0, d1 = c0 * e00 + c1 * e10, c0 * e01 + c1 * e11
            x, y = d0 * up0[k], d1 * up1[k]
            full0[k], full1[k] = x / (x + y), y / (x + y)
            out[k] = full1[k]
        return out

    def blocks(self, page: str) -> list[str]:
        """The content blocks of a page in order, white space collapsed; blocks of white space alone vanish."""
        nodes = parse(page)
        if len(nodes) == 1:
            return []
        marginal = self.marginals(nodes)
        found = (" ".join("".join(x.text).split()) for x, p in zip(nodes, marginal, strict=True) if x.tag == "#" and p >= 0.5)
        return [t for t in found if t]


def labelled_pages(count: int = 1000, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Pages with known content, made by a rule: an article in one of several layouts, among navigation, headers,
    footers, sidebars, notices, adverts, forms, share and related links, and reader comments."""
    rng = random.Random(seed)
    syllables = "ka lo mi re ta nu se vo di ran pel tor ish en al qua".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(a: int = 3, b: int = 22) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice(["."] * 8 + ["?", "!", ""])

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def links(a: int, b: int) -> str:
        items = "".join(f'<li><a href="/{word()}">{rng.choice([word(), sentence(1, 5)])}</a></li>' for _ in range(rng.randint(a, b)))
        return f"<ul>{items}</ul>"

    def named(options: str) -> str:
        return f'{rng.choice(["class", "class", "class", "id"])}="{rng.choice(options.split())}"'

    boxes = [
        lambda: f"<nav>{links(2, 12)}</nav>",
        lambda: f"<div {named('nav menu navbar navigation breadcrumb breadcrumbs topnav')}>{links(2, 9)}</div>",
        lambda: f"<header><div {named('logo brand site-title header masthead')}>{sentence(1, 4)}</div>{links(0, 5)}</header>",
        lambda: f"<div {named('header masthead topbar site-header')}><a href='/'>{word()}</a><p>{sentence(2, 8)}</p></div>",
        lambda: f"<footer>&copy; {word()}.example &middot; {rng.choice([sentence(2, 12), prose(1, 3)])}</footer>",
        lambda: f"<div {named('footer copyright site-footer legal')}><p>{prose(1, 2)}</p>{links(0, 4)}</div>",
        lambda: f"<aside>{rng.choice([f'<h3>{sentence(1, 4)}</h3>' + links(2, 7), f'<p>{prose(1, 4)}</p>'])}</aside>",
        lambda: f"<div {named('sidebar widget aside rail side-bar secondary')}><h4>{sentence(1, 4)}</h4><p>{prose(1, 3)}</p>{links(0, 5)}</div>",
        lambda: f"<div {named('ad ads advert advertisement sponsored sponsor promo banner adbox')}>{rng.choice([prose(1, 3), f'<p>{prose(1, 2)}</p>', f'<a href=/x>{sentence(2, 8)}</a>'])}</div>",
        lambda: f"<div {named('cookie cookie-notice cookie-banner notice consent gdpr alert popup modal overlay message')}><p>{prose(1, 3)}</p><button>{word()}</button></div>",
        lambda: f"<form action='/{word()}'><label>{sentence(1, 4)}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>",
        lambda: f"<div {named('newsletter subscribe signup login search paywall')}><p>{prose(1, 2)}</p><form><input><button>{word()}</button></form></div>",
        lambda: f"<div {named('share social sharing social-links tags toolbar')}>{rng.choice([links(2, 5), ' '.join(f'<a href=/s>{word()}</a>' for _ in range(4))])}</div>",
        lambda: f"<div {named('related related-posts recommended more-stories recirculation popular trending')}><h3>{sentence(1, 4)}</h3>{links(2, 6)}</div>",
        lambda: f"<section {named('comments comment-list discussion responses')}><h2>{sentence(1, 3)}</h2>" + "".join(f"<div {named('comment comment-body reply')}><span>{word()}</span><p>{prose(1, 4)}</p></div>" for _ in range(rng.randint(1, 5))) + "</section>",
        lambda: f"<ol {named('comments commentlist')}>" + "".join(f"<li {named('comment')}><p>{prose(1, 4)}</p></li>" for _ in range(rng.randint(1, 5))) + "</ol>",
        lambda: f"<div {named('notice disclaimer warning')}>{prose(1, 3)}</div>",
    ]
    for _ in range(count):
        content: set[str] = set()

        def told(text: str, content: set[str] = content) -> str:
            content.add(" ".join(html.unescape(text).split()))
            return text

        def item() -> str:
            """A point of a list: a word, a sentence or more, now and then with a link at its beginning."""
            text = rng.choice([word(), sentence(1, 3), sentence(2, 10), prose(1, 2)])
            told(text)
            head, _, tail = text.partition(" ")
            return f"<li><a href=/{head}>{head}</a> {tail}</li>" if tail and rng.random() < 0.25 else f"<li>{text}</li>"

        body = [f"<h1>{told(sentence(2, 12))}</h1>"] * (rng.random() < 0.85)
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.72:
                body.append(f"<p>{told(rng.choice([prose(1, 8), sentence(1, 6), word().capitalize() + '.', prose(1, 3)]))}" + rng.choice(["</p>", "</p>", "<br>", ""]))
            elif kind < 0.8:
                level = rng.randint(2, 4)
                body.append(f"<h{level}>{told(sentence(1, 8))}</h{level}>")
            elif kind < 0.86:
                form = rng.choice(["ul", "ol"])
                body.append(f"<{form}>" + "".join(item() for _ in range(rng.randint(1, 6))) + f"</{form}>")
            elif kind < 0.9:
                body.append(f"<blockquote><p>{told(prose(1, 3))}</p></blockquote>")
            elif kind < 0.93:
                body.append(f"<pre>{told(sentence(3, 20))}</pre>")
            elif kind < 0.96:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{told(sentence(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                body.append(f"<figure><figcaption>{told(sentence(2, 10))}</figcaption></figure>")
            if rng.random() < 0.08:
                body.append(rng.choice(boxes[8:])())
        inner = "".join(body)
        article = rng.choice([
            lambda: f"<article>{inner}</article>", lambda: f"<article {named('post entry article')}>{inner}</article>",
            lambda: f"<main><article>{inner}</article></main>", lambda: f"<main>{inner}</main>",
            lambda: f"<div {named('content main article post entry article-body post-content entry-content story text')}>{inner}</div>",
            lambda: f"<div {named('content main')}><div {named('post entry article-body story')}>{inner}</div></div>",
            lambda: f"<section>{inner}</section>", lambda: f"<div>{inner}</div>", lambda: f"<div {named('wrapper page box row col')}>{inner}</div>", lambda: inner,
        ])()
        before = [rng.choice(boxes)() for _ in range(rng.randint(0, 4))]
        after = [rng.choice(boxes)() for _ in range(rng.randint(0, 5))]
        rows = "".join(before) + article + "".join(after)
        wrap = rng.choice(["{}", "{}", "<div id=page>{}</div>", "<div class=container>{}</div>"])
        yield f"<!DOCTYPE html><html><head><title>{sentence(2, 9)}</title></head><body>{wrap.format(rows)}</body></html>", content


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (content blocks joined by an empty line), n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and keep the
    page's order. Null, empty and textless pages give an empty text; null ids and urls stay; repeated rows give a row each.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or TreeModel.trained(labelled_pages()))

    def run(it):
        for b in it:
            text = ["\n\n".join(shared.value.blocks(page.as_py())) for page in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

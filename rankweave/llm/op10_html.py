"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A scanner walks the whole page once, keeps the stack of open elements (closing what HTML closes by implication)
and yields leaf blocks: runs of text between block-level tags, with the innermost open element, which knows its
parent; time and memory are linear in the page, however deep or broken its markup is. Features of a block are
its ancestors' tags and the words of their class, id and role attributes, and the shape of its text. The
field is trained on labelled pages (pages made by ``labelled_pages``, or any given to ``train``) by the
gradient of its likelihood, emissions and transitions alike, and decoded by Viterbi, page by page.

Defined cases: a null or empty page has an empty text; pages without markup are one block; unclosed elements
end with their parent; an unclosed script, style, textarea, iframe or comment hides the rest, as HTML has it; the
text of objects, formulas, drawings and what is shown without scripts is text like any other; repeated pages and very
long ones are handled like others; input columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chain import odds, pair_counts, viterbi
from .shared import quoted, table, with_fields

BUCKETS = 1 << 14
HEAD = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>")
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")
#: Declarations that hide an element.
UNSEEN = re.compile(r"(?:^|[;\s\"'])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b")
#: Elements whose content isn't markup: only their own end tag ends them, or the page. None of it is main text.
RAW = {"script", "style", "textarea", "iframe", "noembed", "noframes", "xmp"}
#: Elements with markup inside whose content is never shown as text, as long as they are closed.
HELD = {"template", "select", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr", "input"}
#: Parts of formulas and drawings stand in their line too.
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation svg g path tspan circle rect line polyline polygon ellipse defs use".split())
#: An element of the key is closed by the start of one of these, up to the nearest of the boundaries.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head", "title"}, set())}


class Node:
    """An open element: tag, names of its class, id and role, its parent, and what its ancestors don't already say of a path."""

    __slots__ = ("tag", "names", "parent", "fresh", "inherited", "score")

    def __init__(self, tag: str, names: list[str], parent: Node | None, fresh: list[str]):
        self.tag, self.names, self.parent, self.fresh = tag, names, parent, fresh
        self.inherited = self.score = None


class Stack:
    """The open elements. Where each tag is open is kept, so no search walks the stack, however deep it is."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.said: dict[str, int] = {}

    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, tag: str, names: list[str]) -> None:
        fresh = []
        for f in {f"in {tag}", *(f"of {n}" for n in names)}:
            if f not in self.said:
                self.said[f] = len(self.nodes)
                fresh.append(f)
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(Node(tag, names, self.top(), sorted(fresh)))

    def cut(self, i: int) -> None:
        """Close the elements from place i on."""
        while len(self.nodes) > i:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            for f in node.fresh:
                del self.said[f]

    def last(self, tags: set[str]) -> int:
        """The place of the innermost of these; -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def _names(attributes: str) -> list[str]:
    found: list[str] = []
    if "=" in attributes or "hidden" in attributes:
        for key, value in NAMES.findall(attributes):
            key, value = key.lower(), value.lower()
            if key == "style":
                found += ["hidden"] if UNSEEN.search(value) else []
            elif key in ("hidden", "aria-hidden"):
                found += ["hidden"] if "false" not in value else []
            else:
                found += WORDS.findall(value)
    return found


def blocks(page: str) -> list[tuple[str, Node | None, int, int]]:
    """(text, innermost open element, linked characters, characters) of every leaf block.

    One pass: what a search from one place finds missing up to the page's end is missing from every later place too, so
    it isn't looked for again.
    """
    out: list[tuple[str, Node | None, int, int]] = []
    stack, parts = Stack(), []
    linked = chars = at = 0
    in_link, tags_end, never = False, False, set()
    end = len(page)

    def flush() -> None:
        nonlocal linked, chars
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, stack.top(), linked, chars))
            parts.clear()
        linked = chars = 0

    def past(what: str, start: int) -> int:
        """The place behind the next ``what``; -1 if there is none."""
        i = -1 if what in never else page.find(what, start)
        if i < 0:
            never.add(what)
        return i + len(what) if i >= 0 else -1

    def add(to: int) -> None:
        nonlocal at, chars, linked
        if to > at:
            parts.append(page[at:to])
            chars += to - at
            linked += to - at if in_link else 0
        at = to

    while at < end:
        opened = page.find("<", at)
        if opened < 0:
            add(end)
            break
        add(opened)
        if page.startswith(("<!--", "<![CDATA["), at):
            to = past("-->" if page[at + 2] == "-" else "]]>", at + 4)
            at = to if to >= 0 else end
            continue
        if page.startswith(("<!", "<?"), at):
            to = past(">", at)
            if to >= 0:
                at = to
            else:
                add(at + 1)
            continue
        head = None if tags_end else HEAD.match(page, at + 1)
        rest = REST.match(page, head.end()) if head else None
        if not rest:
            tags_end = tags_end or head is not None
            add(at + 1)
            continue
        at, tag, attributes = rest.end(), head[2].lower(), rest[1]
        if tag in INLINE:
            if tag == "a":
                in_link = not head[1]
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = False
        if head[1]:
            if (i := stack.last({tag})) >= 0:
                stack.cut(i)
            continue
        if tag in RAW or tag in HELD:
            if not attributes.endswith("/"):
                close = None if tag in never else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if close:
                    at = close.end()
                else:
                    never.add(tag)
                    at = end if tag in RAW else at
            continue
        if tag in VOID:
            continue
        if stack.nodes and stack.top().tag == "p":
            stack.cut(len(stack.nodes) - 1)  # any block-level start ends a paragraph
        if tag in IMPLIED:
            closes, walls = IMPLIED[tag]
            i = stack.last(closes - walls)
            if i > stack.last(walls):
                stack.cut(i)
        stack.push(tag, _names(attributes))
    flush()
    return out


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def own_features(node: Node | None) -> list[str]:
    """What the innermost element says of a block."""
    if node is None:
        return ["bias"]
    found = {"bias", f"tag {node.tag}", *(f"own {n}" for n in node.names)}
    if node.parent:
        found.add(f"pair {node.parent.tag}>{node.tag}")
    return sorted(found)


def path_features(node: Node | None) -> list[int]:
    """All features of a block's path: its ancestors' tags and names, each once, and those of the innermost element."""
    found, at = own_features(node), node
    while at:
        found += at.fresh
        at = at.parent
    return [_bucket(f) for f in sorted(found)]


def shape(text: str, linked: int, chars: int) -> tuple:
    """A few coarse facts of a block's text."""
    words = text.count(" ") + 1
    share = 0 if not linked else 1 if 2 * linked < chars else 2 if 10 * linked < 9 * chars else 3
    return (min(words.bit_length(), 7), share, text[-1] in ".!?:;…\"”»)", "," in text, text[:1] == "©", "|" in text or "·" in text)


def shape_features(s: tuple) -> list[int]:
    return [_bucket(f"shape {i} {v}") for i, v in enumerate(s)] + [_bucket(f"links {s[1]} words {s[0]}")]


def train(pages: list[tuple[str, list[bool]]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-5) -> dict:
    """Fit the field to pages with a label (is main text) for every leaf block."""
    rows, first, y = [], [], []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(found)} blocks")
        for i, (text, path, linked, chars) in enumerate(found):
            rows.append(path_features(path) + shape_features(shape(text, linked, chars)))
            first.append(i == 0)
            y.append(labels[i])
    at = np.concatenate([np.array(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    first, y = np.array(first), np.array(y)
    inner = ~first[1:]
    seen = np.bincount((y[:-1] * 2 + y[1:])[inner], minlength=4).reshape(2, 2)
    w, grow = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    log_a, grow_a, start, grow_s = np.zeros((2, 2)), np.full((2, 2), 1e-3), 0.0, 1e-3
    for _ in range(rounds):
        x, a, s = np.exp(np.clip(np.bincount(of, w[at], len(rows)), -30, 30)), np.exp(log_a), float(np.exp(start))
        ahead, behind = odds(x, first, a, s)
        p = ahead * behind / (1 + ahead * behind)
        g = np.bincount(at, (y - p)[of], BUCKETS) - decay * len(rows) * w
        ga, gs = seen - pair_counts(x, first, a, s) - decay * len(rows) * log_a, (y - p)[first].sum() - decay * len(rows) * start
        grow, grow_a, grow_s = grow + g * g, grow_a + ga * ga, grow_s + gs * gs
        w, log_a, start = w + rate * g / np.sqrt(grow), log_a + rate * ga / np.sqrt(grow_a), start + rate * gs / np.sqrt(grow_s)
    return {"w": w.tolist(), "log_a": log_a.tolist(), "start": float(start)}


class Extractor:
    """Main text of pages under a model; weights of features and scores of shapes are kept, as pages share them."""

    MOST = 100_000

    def __init__(self, model: dict):
        self.model, self.weights, self.shapes = model, {}, {}

    def _kept(self, kept: dict, key, score) -> float:
        found = kept.get(key)
        if found is None:
            if len(kept) >= self.MOST:
                kept.clear()
            found = kept[key] = score(key)
        return found

    def _weight(self, features: list[str]) -> float:
        return sum(self._kept(self.weights, f, lambda f: self.model["w"][_bucket(f)]) for f in features)

    def _path(self, node: Node | None) -> float:
        """The score of a path; elements know what their own ancestors add up to."""
        if node is None:
            return self._weight(own_features(None))
        if node.score is None:
            todo, at = [], node
            while at and at.inherited is None:
                todo.append(at)
                at = at.parent
            for n in reversed(todo):
                n.inherited = (n.parent.inherited if n.parent else 0.0) + self._weight(n.fresh)
            node.score = node.inherited + self._weight(own_features(node))
        return node.score

    def _shape(self, s: tuple) -> float:
        return sum(self.model["w"][i] for i in shape_features(s))

    def labels(self, found: list) -> list[int]:
        scores = [self._path(node) + self._kept(self.shapes, shape(text, linked, chars), self._shape) for text, node, linked, chars in found]
        return viterbi(scores, self.model["log_a"], self.model["start"])

    def text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        return "\n\n".join(f[0] for f, main in zip(found, self.labels(found), strict=True) if main)


# ---- labelled pages -------------------------------------------------------------------------------------

#: Names that sites give to the parts of a page that aren't its text, and to those that are.
ASIDES = "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login share sharing social related recommended recommendations more breadcrumbs breadcrumb menu nav navbar navigation header masthead topbar toolbar footer copyright legal disclaimer sidebar widget side comments comment replies reply discussion disqus respond pagination pager search form contact rating paywall".split()
BODIES = "article content post entry story main body text page article-body post-content entry-content main-content article-text content-body prose".split()
SYLLABLES = "the an re er on ti ha in ou st ed le ment de que la en tion es os cia ado sch ung keit ver und ge ma lo vi ra su mi po".split()


def labelled_pages(n: int, seed: int = 10) -> list[tuple[str, list[bool]]]:
    """n made-up pages of many layouts, with whether each leaf block is main text."""
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _page(rng: random.Random) -> tuple[str, list[bool]]:
    labels: list[bool] = []

    def word() -> str:
        return "".join(rng.choices(SYLLABLES, k=rng.choice((1, 1, 2, 2, 3))))

    def phrase(n: int) -> str:
        return " ".join(word() for _ in range(n)).capitalize()

    def prose(most: int) -> str:
        out = []
        for _ in range(rng.randint(1, most)):
            words = phrase(rng.randint(1, 18)).split()
            if len(words) > 5 and rng.random() < 0.5:
                words[2] += ","
            out.append(" ".join(words) + rng.choice("....!?"))
        if rng.random() < 0.1:
            out[0] = rng.choice(("*** ", "### ", "%%% ")) + out[0].upper()
        return " ".join(out)

    def leaf(tag: str, text: str, main: bool, attrs: str = "") -> str:
        labels.append(main)
        return f"<{tag}{attrs}>{text}</{tag}>" if tag not in ("p", "li") or rng.random() < 0.8 else f"<{tag}{attrs}>{text}"

    def named(names: list[str]) -> str:
        name = rng.choice(names)
        if rng.random() < 0.4:
            name += rng.choice(("-", "_", " ")) + rng.choice(("box", "wrap", "inner", "block", "area", "container", "1", "list", "item"))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def links(main: bool = False) -> str:
        items = "".join(leaf("li", f'<a href="/{word()}">{phrase(rng.randint(1, 4))}</a>', main) for _ in range(rng.randint(1, 8)))
        return f"<ul>{items}</ul>"

    def aside(depth: int = 0) -> str:
        kind = rng.random()
        inner = ""
        for _ in range(rng.randint(1, 3)):
            k = rng.random()
            if k < 0.3:
                inner += links()
            elif k < 0.75:
                inner += leaf(rng.choice(("p", "p", "div", "h3", "h4")), rng.choice((prose(3), phrase(3), f'<a href="#">{phrase(2)}</a>')), False)
            elif k < 0.85:
                inner += "<form><input>" + leaf("button", phrase(2), False) + "</form>"
            elif depth < 1:
                inner += f"<div{named(ASIDES)}>" + leaf("p", prose(2), False) + "</div>"
            else:
                inner += leaf("div", prose(2), False)
        if kind < 0.25:
            tag = rng.choice(("aside", "nav", "header", "footer", "form"))
            return f"<{tag}{named(ASIDES) if rng.random() < 0.5 else ''}>{inner}</{tag}>"
        if kind < 0.45:  # text right inside the element
            labels.append(False)
            return inner + f"<div{named(ASIDES)}>{prose(2)}</div>"
        hidden = rng.choice((' style="display:none"', " hidden")) if rng.random() < 0.08 else named(ASIDES)
        tag = rng.choice(("div", "div", "section"))
        return f"<{tag}{hidden}>{inner}</{tag}>"

    def comments() -> str:
        tag, plain = rng.choice(("section", "div", "div", "ul")), rng.random() < 0.4
        inner = ""
        for _ in range(rng.choice((1, 1, 2, 4))):
            said = rng.choice((prose(4), prose(1), phrase(rng.randint(1, 3)) + rng.choice("!?.")))
            own = leaf("p", said, False) if rng.random() < 0.8 else leaf("div", said, False)
            item = rng.choice(("div", "li", "article"))
            inner += own if plain else f'<{item}{named(["comment", "reply"])}>{own}</{item}>'
        return f'<{tag}{named(["comments", "comments", "comment-list", "discussion", "responses", "replies"])}>{inner}</{tag}>'

    def inline(text: str) -> str:
        words = text.split(" ")
        if len(words) > 3 and rng.random() < 0.4:
            i = rng.randrange(len(words) - 1)
            tag = rng.choice(("b", "i", "em", "strong", "span", 'a href="/x"'))
            words[i] = f"<{tag}>{words[i]}</{tag.split()[0]}>"
        if rng.random() < 0.15:
            words[0] = "<b>" + words[0]  # never closed
        if rng.random() < 0.15:
            words[-1] += "<br>"
        return " ".join(words).replace("&", "&amp;")

    def body() -> str:
        out = leaf("h1", phrase(rng.randint(1, 10)), True) if rng.random() < 0.85 else ""
        for _ in range(rng.randint(1, 12)):
            k = rng.random()
            if k < 0.72:
                out += leaf("p", inline(prose(rng.choice((1, 2, 4, 9)))), True)
            elif k < 0.8:
                out += leaf(rng.choice(("h2", "h3", "h4")), phrase(rng.randint(1, 6)), True)
            elif k < 0.85:
                out += "<ul>" + "".join(leaf("li", inline(prose(1)), True) for _ in range(rng.randint(1, 5))) + "</ul>"
            elif k < 0.88:
                out += "<blockquote>" + leaf("p", prose(3), True) + "</blockquote>"
            elif k < 0.9:
                out += leaf("pre", prose(2), True)
            elif k < 0.92:
                out += "<table><tr>" + "".join(leaf("td", phrase(2), True) for _ in range(rng.randint(1, 4))) + "</tr></table>"
            elif k < 0.93:
                out += "<figure><img>" + leaf("figcaption", prose(1), True) + "</figure>"
            elif k < 0.98:
                out += aside(1)
            else:
                out += f"<!-- {phrase(3)} -->"
        if rng.random() < 0.2:
            out += comments()
        return out

    title = phrase(4)
    labels.append(False)
    page = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    if rng.random() < 0.15:
        page += "<noscript>" + leaf("p", prose(1), False) + "</noscript>"
    for _ in range(rng.randint(0, 4)):
        page += aside() if rng.random() < 0.7 else f"<nav>{links()}</nav>"
    kind = rng.random()
    if kind < 0.55:
        page += f"<article{named(BODIES) if rng.random() < 0.3 else ''}>" + body() + "</article>"
    elif kind < 0.7:
        page += "<main>" + (f"<article>{body()}</article>" if rng.random() < 0.5 else body()) + "</main>"
    elif kind < 0.92:
        page += f"<div{named(BODIES)}>" + body() + "</div>"
    else:
        page += "<div><div>" + body() + "</div></div>"
    if rng.random() < 0.4:
        page += comments()
    for _ in range(rng.randint(0, 3)):
        page += aside() if rng.random() < 0.75 else comments()
    if rng.random() < 0.7:
        labels.append(False)
        page += f"<footer>&copy; {word()} &middot; {prose(1)}</footer>"
    return page + rng.choice(("</body></html>", "")), labels


def extract(pages: DataFrame, model: dict) -> DataFrame:
    """pages with ``text`` and ``n_chars`` in place of ``html``."""
    kept = [c for c in pages.columns if c.lower() not in ("html", "text", "n_chars")]

    def extracted(batches):
        own = Extractor(model)
        for b in batches:
            column = b.column(len(kept))
            for lo in range(0, b.num_rows, 500):
                texts = [own.text(x.as_py()) for x in column.slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([*(x.slice(lo, 500) for x in b.columns[:-1]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    rows = pages.select(*(quoted(c) for c in kept), "html")
    return rows.mapInArrow(extracted, with_fields(rows.drop("html"), "text string, n_chars long"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), train(labelled_pages(600))).select("page_id", "url", "text", "n_chars")

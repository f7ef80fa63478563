"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: runs of text that no block-level tag interrupts, each with the tags, class and
id words and roles of its ancestors and some facts about its text. A two-label chain model (main or not) is trained on
labelled pages by maximum likelihood, and the best labelling of a page is found by Viterbi. Labelled pages come from
``labelled_pages``, which makes them by a rule from parts whose labels are known; others can be given to ``fit``.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>?|<[a-zA-Z][^>]*+>?|(?P<text>[^<]++|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SKIPPED = frozenset("script style template noscript textarea select button iframe title head datalist".split())
#: What may stand in a head; any other tag, or text, ends it (its end tag may be left out).
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Their own tags don't interrupt a run of text, and may close themselves.
FOREIGN = frozenset("svg math".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i img input ins kbd label mark math object q ruby rb rp rt s samp small span strike strong sub sup svg time tt u var video wbr".split()
)
#: What a start tag ends if it is open.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Open elements beyond which nothing is ended: for most tags, and for those that are parts of these.
CELLS = ("table", "td", "th", "caption", "object", "template")
BARRIERS = {"li": (*CELLS, "ul", "ol", "menu"), "dt": (*CELLS, "dl"), "dd": (*CELLS, "dl"), "tr": ("table",), "td": ("table",), "th": ("table",)}
BARRIERS |= {"option": ("select",), "head": (), "body": (), "html": (), "table": (), "caption": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
#: A block inside an open paragraph ends it.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
NAMES = {
    "ad": "ad ads advert advertisement adverts advertising banner promo promotion sponsor sponsored",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pager pagination toc skip",
    "head": "header masthead topbar logo branding top",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget rail related recommended recommendations popular trending more tags links",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup warning paywall message",
    "form": "form search login register signin input",
    "comment": "comment comments commentlist reply replies discussion disqus respond feedback thread",
    "share": "share sharing social follow",
    "main": "article post entry content main story body text page single",
}
GROUP = {w: g for g, words in NAMES.items() for w in words.split()}
ROLES = frozenset("navigation banner contentinfo complementary search main article dialog alert form menu".split())


@dataclass
class Block:
    text: str
    above: frozenset
    links: int


def _attributes(tag: str, raw: str, known: frozenset | None) -> set[str]:
    """The features of an element; only those ``known``, if that is given."""
    out = {f"tag:{tag}"}
    if raw and ("=" in raw or "hidden" in raw):
        _named(raw, out)
    return out if known is None else out & known


def _named(raw: str, out: set[str]) -> None:
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                if word in GROUP:
                    out.add(f"name:{GROUP[word]}")
        elif name == "role" and value.lower() in ROLES:
            out.add(f"role:{value.lower()}")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            out.add("hidden")


class _Open:
    """The open elements: their features, and where on the stack each tag is, so that nothing is searched."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset, int, bool]] = [("", frozenset(), 0, False)]  # tag, features, its last block, is a link
        self.at: dict[str, list[int]] = {}
        self.skipped = self.foreign = self.links = 0

    def nearest(self, tags, barriers) -> int:
        """The place of the innermost open element of ``tags`` inside all ``barriers``; 0 if there is none."""
        found = max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)
        return found if found and all(found >= self.at[t][-1] for t in barriers if self.at.get(t)) else 0

    def push(self, tag: str, own: set[str], link: bool) -> None:
        above, block = self.stack[-1][1:3]
        if tag not in INLINE:
            block = len(self.stack)
        self.at.setdefault(tag, []).append(len(self.stack))
        more = (tag not in INLINE or len(own) > 1) and not own <= above
        self.stack.append((tag, above | own if more else above, block, link))
        self._count(tag, link, 1)

    def close(self, place: int) -> None:
        """Ends the element at ``place`` and all inside it."""
        while place and len(self.stack) > place:
            tag, _, _, link = self.stack.pop()
            self.at[tag].pop()
            self._count(tag, link, -1)

    def _count(self, tag: str, link: bool, n: int) -> None:
        self.skipped += n * (tag in SKIPPED)
        self.foreign += n * (tag in FOREIGN)
        self.links += n * link


def blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order. Character references are decoded, white space is one blank, empty blocks are left out.
    With the features that a model knows (``known``), the others aren't gathered from ancestors, and time grows with the page's length,
    however deep its elements lie, many of their tags differ or many of its end tags match nothing."""
    found: list[Block] = []
    parts: list[str] = []
    now = _Open()
    links = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, now.stack[-1][1], links))
            parts.clear()
        links = 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            if now.skipped and now.stack[-1][0] == "head" and text.strip():
                now.close(now.nearest(("head",), ()))
            if not now.skipped:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if now.links:
                    links += len(text.strip())
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag not in INLINE and (not now.foreign or tag in ENDS_P or tag in CLOSES or tag in ("br", "text", "body")):
            flush()
        if m["end"]:
            if tag not in VOID:
                now.close(now.nearest((tag,), [b for b in BARRIERS.get(tag, CELLS) if b != tag]))
            continue
        if now.skipped and tag not in IN_HEAD and now.at.get("head"):
            now.close(now.nearest(("head",), ()))
        if tag in ENDS_P:
            now.close(now.nearest(("p",), CELLS))
        elif tag in CLOSES:
            now.close(now.nearest(CLOSES[tag], [b for b in BARRIERS.get(tag, CELLS) if b not in CLOSES[tag]]))
        elif tag == "a" and (open_a := now.nearest(("a",), CELLS)) > now.stack[-1][2]:
            now.close(open_a)
        attrs = m["attrs"]
        if tag in VOID or attrs.endswith("/") and tag not in RAW and (now.foreign or tag in SKIPPED or tag in FOREIGN or tag == "object"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            at = end.start() if end else size
        now.push(tag, _attributes(tag, attrs, known), tag == "a" and "href" in attrs)
    flush()
    return found


def features(found: list[Block]) -> list[list[str]]:
    """Names of the features of each block; those of ancestors are in ``above``."""
    out = []
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        share = b.links / max(len(b.text), 1)
        own = [
            "words:" + ("1" if words == 1 else "2-4" if words < 5 else "5-12" if words < 13 else "13-30" if words < 31 else "31-"),
            "links:" + ("no" if not b.links else "some" if share < 0.5 else "most"),
            "ends:" + ("stop" if b.text[-1] in ".!?…\"'”»。" else "other"),
            "place:" + ("first" if k == 0 else "last" if k == len(found) - 1 else "inside"),
        ]
        if "," in b.text:
            own.append("comma")
        if "©" in b.text or "copyright" in b.text[:40].lower():
            own.append("rights")
        if "tag:a" in b.above or share > 0.9:
            own.append("all-link")
        out.append(own)
    return out


@dataclass
class Chain:
    """Weights for the label main against other; ``moves[a][b]`` is the score of label b after label a."""

    weights: dict[str, float]
    moves: list[list[float]]
    start: list[float]

    def __post_init__(self):
        self._above: dict[frozenset, float] = {}
        self._known = frozenset(self.weights) | {"tag:a"}  # which features() asks for

    def label(self, found: list[Block]) -> list[bool]:
        """The most probable labels, by Viterbi."""
        if not found:
            return []
        get, above = self.weights.get, self._above
        (oo, om), (mo, mm) = self.moves
        back = []
        o, m = self.start
        for k, (block, own) in enumerate(zip(found, features(found))):
            if (score := above.get(block.above)) is None:
                if len(above) > 50_000:
                    above.clear()
                score = above[block.above] = sum(get(f, 0.0) for f in block.above)
            score += sum(get(f, 0.0) for f in own)
            if k == 0:
                m += score
                continue
            from_o, from_m = o + om > m + mm, o + oo > m + mo
            back.append((from_m, from_o))
            o, m = max(o + oo, m + mo), max(o + om, m + mm) + score
        labels = [m > o]
        for to_other, to_main in reversed(back):
            was_other = to_main if labels[-1] else to_other
            labels.append(not was_other)
        return labels[::-1]

    def main_text(self, page: str) -> str:
        found = blocks(page, self._known)
        return "\n".join(b.text for b, keep in zip(found, self.label(found)) if keep)


def fit(pages: list[tuple[str, list[bool]]], steps: int = 200, ridge: float = 2e-4) -> Chain:
    """A chain fitted to pages with a label for each of their ``blocks``, by gradient steps (Adam) on the likelihood."""
    sequences = [(found, [[*b.above, *own] for b, own in zip(found, features(found))], y) for page, y in pages if (found := blocks(page))]
    names = sorted({f for _, rows, _ in sequences for row in rows for f in row})
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(sequences), max(len(y) for _, _, y in sequences)
    x = np.zeros((n, longest, len(names)), np.float32)
    y = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, (found, rows, labels) in enumerate(sequences):
        if len(labels) != len(found):
            raise ValueError("a label for each block is needed")
        for t, row in enumerate(rows):
            x[i, t, [index[f] for f in row]] = 1
        y[i, : len(labels)] = labels
        mask[i, : len(labels)] = True
    flat = x[mask]
    size = len(names)
    theta, first, second = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    row = np.arange(n)
    seen = np.zeros(size + 6)
    seen[:size] = flat[y[mask] == 1].sum(0)
    np.add.at(seen, size + 4 + y[:, 0], 1)
    both = mask[:, 1:]
    np.add.at(seen, size + 2 * y[:, :-1][both] + y[:, 1:][both], 1)
    for step in range(1, steps + 1):
        moves, start = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        emit = np.zeros((n, longest, 2))
        emit[..., 1][mask] = flat @ theta[:size].astype(np.float32)
        fore, back = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fore[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            fore[:, t] = np.logaddexp.reduce(fore[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], axis=2), 0)
        ends = mask.sum(1) - 1
        total = np.logaddexp.reduce(fore[row, ends], axis=1)
        p = np.exp(fore + back - total[:, None, None])
        want = np.zeros(size + 6)
        want[:size] = p[..., 1][mask] @ flat
        pair = np.exp(fore[:, :-1, :, None] + moves + (emit[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
        want[size : size + 4] = pair[both].sum(0).ravel()
        want[size + 4 :] = p[:, 0].sum(0)
        slope = (want - seen) / n + ridge * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta[:size].tolist())), theta[size : size + 4].reshape(2, 2).tolist(), theta[size + 4 :].tolist())


# Labelled pages


class _Maker:
    """Makes one page; texts of main blocks begin with a mark that tells their label."""

    MARK = "⁠"

    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int, stop: str = "") -> str:
        rng = self.rng
        out = ["".join(rng.choice(["ra", "to", "li", "en", "mo", "su", "ka", "ne"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        for k in range(7, len(out), 9):
            out[k] += rng.choice([",", "", "."])
        return " ".join(out).capitalize() + stop

    def any(self, *parts: str, share: float = 0.5) -> str:
        return "".join(p for p in parts if self.rng.random() < share)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.randint(0, 999)}">{self.words(low, high)}</a>'

    def named(self, tag: str, names: list[str], body: str) -> str:
        """An element that its class or id names; those whose tag says enough may go without."""
        rng = self.rng
        name = rng.choice(names)
        name = rng.choice([name, f"{name}-{rng.choice(['box', 'wrap', 'area', 'inner', 'block'])}", f"site-{name}"])
        bare = tag in ("nav", "aside") and rng.random() < 0.4
        return f"<{tag}>{body}</{tag}>" if bare else f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">{body}</{tag}>'

    def links(self) -> str:
        rng = self.rng
        items = [self.link() for _ in range(rng.randint(2, 7))]
        return rng.choice([f"<ul>{''.join(f'<li>{i}</li>' for i in items)}</ul>", " ".join(items), "".join(f"<div>{i}</div>" for i in items)])

    def nav(self) -> str:
        return self.named(self.rng.choice(["nav", "div", "nav", "ul"]), ["menu", "nav", "navbar", "breadcrumb"], self.links())

    def notice(self) -> str:
        return self.named(self.rng.choice(["div", "div", "section", "aside"]), ["cookie-notice", "notice", "consent", "newsletter", "alert", "popup"], f"<p>{self.words(4, 25, '.')}</p>" + self.any("<button>Ok</button>", self.link()))

    def ad(self) -> str:
        return self.named(self.rng.choice(["div", "aside", "div"]), ["ad", "ads", "advert", "banner", "promo", "sponsored"], self.rng.choice([self.words(3, 14, "."), f"<p>{self.words(3, 20, '.')}</p>", self.link(2, 6)]))

    def side(self) -> str:
        body = f"<h3>{self.words(1, 4)}</h3>" + self.rng.choice([self.links(), f"<p>{self.words(5, 25, '.')}</p>", self.links() + f"<p>{self.words(4, 12, '.')}</p>"])
        return self.named(self.rng.choice(["aside", "div", "aside"]), ["sidebar", "related", "widget", "popular"], body)

    def comments(self) -> str:
        rng = self.rng
        one = lambda: self.named(rng.choice(["div", "li", "article"]), ["comment", "reply"], self.any(f"<b>{self.words(1, 2)}</b>", share=0.6) + f"<p>{self.words(3, 40, '.')}</p>")
        return self.named(rng.choice(["section", "div", "div"]), ["comments", "discussion", "comment-list"], self.any(f"<h3>{self.words(1, 3)}</h3>") + "".join(one() for _ in range(rng.randint(1, 5))) + self.any(self.form()))

    def form(self) -> str:
        return f'<form action="/x"{self.any(chr(32) + "class=search-form")}><label>{self.words(1, 4)}</label><input name="q">{self.any(f"<p>{self.words(3, 12, chr(46))}</p>")}<button>{self.words(1, 2)}</button></form>'

    def main_block(self) -> str:
        rng, mark = self.rng, self.MARK
        kind = rng.random()
        text = self.words(*rng.choice([(1, 4), (5, 15), (12, 60), (20, 120), (30, 150)]), rng.choice([".", ".", ".", "!", ""]))
        if kind < 0.62:
            return rng.choice([f"<p>{mark}{text}</p>", f"<p>{mark}{text}", f"<p>{mark}{text} {self.link()} {self.words(3, 9, '.')}</p>", f"<p>{mark}{text}<br>{mark}{self.words(3, 30, '.')}</p>", f"<div>{mark}{text}</div>"])
        if kind < 0.75:
            return rng.choice([f"<h2>{mark}{self.words(2, 8)}</h2>", f"<h3>{mark}{self.words(2, 8)}</h3>", f"<p><b>{mark}{self.words(2, 9, '.')}<br>", f"<p><strong>{mark}{self.words(2, 9)}</strong></p>"])
        if kind < 0.84:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{mark}{self.words(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.9:
            return f"<blockquote>{rng.choice(['<p>', ''])}{mark}{text}</blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{mark}{self.words(1, 3)}</td><td>{mark}{rng.randint(1, 999)}</td></tr>" for _ in range(rng.randint(2, 4))) + "</table>"
        return rng.choice([f"<pre>{mark}{text}</pre>", f"<figure><img src=x><figcaption>{mark}{self.words(3, 12, '.')}</figcaption></figure>"])

    def page(self) -> str:
        rng = self.rng
        title = self.words(2, 12, rng.choice(["", "."]))
        inside = [self.main_block() for _ in range(rng.randint(1, 14))]
        for extra in (self.ad, self.side, self.form, self.notice, self.links_bar):
            if rng.random() < 0.15:
                inside.insert(rng.randint(0, len(inside)), extra())
        late = self.any(self.comments(), self.side(), share=0.2)
        head = rng.choice([f"<h1>{self.MARK}{title}</h1>", f"<h1>{self.MARK}{title}</h1>", f"<header><h1>{self.MARK}{title}</h1></header>", ""])
        body = head + "".join(inside)
        holder = rng.random()
        if holder < 0.5:
            main = f"<article>{body}{late}</article>"
        elif holder < 0.65:
            main = f"<main>{rng.choice([body, f'<article>{body}</article>'])}{late}</main>"
        elif holder < 0.8:
            main = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "entry-content", "article-body", "story", "main-text"])}">{body}</div>{late}'
        elif holder < 0.9:
            main = f"<section>{body}</section>{late}"
        else:
            main = f"<div>{body}</div>{late}"
        before = self.any(self.notice(), share=0.25) + self.any(f"<header>{self.any(f'<p>{self.words(1, 4)}</p>', f'<h2>{self.words(1, 3)}</h2>')}{self.any(self.form(), share=0.3)}{self.nav()}</header>", share=0.4) + self.any(self.nav(), share=0.7) + self.any(self.ad(), share=0.5) + self.any(self.side(), share=0.2)
        rights = rng.choice(["&copy;", "&copy;", "Copyright"]) + f" {self.words(1, 3)} &middot; {self.words(3, 12, '.')}"
        foot = rng.choice([rights, f"<p>{rights}</p>", self.words(2, 9, "."), self.links(), f"<p>{self.words(3, 20, '.')}</p>{self.links()}"])
        after = self.any(self.comments(), share=0.3) + self.any(self.ad(), self.side(), share=0.3) + self.any(self.form(), self.notice(), share=0.15)
        footer = rng.choice([f"<footer>{foot}</footer>", f"<footer>{foot}</footer>", f'<div class="{rng.choice(["footer", "site-footer", "copyright"])}">{foot}</div>', ""])
        if holder >= 0.97:  # a fragment: the text and nothing around it
            return head + "".join(self.main_block() for _ in range(rng.randint(1, 8)))
        return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{before}{main}{after}{footer}</body></html>"

    def links_bar(self) -> str:
        return self.named("div", ["share", "social", "tags", "share-links"], self.links())


def labelled_pages(n: int = 500, seed: int = 7) -> list[tuple[str, list[bool]]]:
    """``n`` made pages with the labels of their blocks."""
    out = []
    for k in range(n):
        page = _Maker(random.Random(seed * 100_003 + k)).page()
        labels = [_Maker.MARK in b.text for b in blocks(page)]
        clean = page.replace(_Maker.MARK, "")
        if len(blocks(clean)) == len(labels) and labels:
            out.append((clean, labels))
    return out


def extract(pages: DataFrame, model: Chain | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of each row of ``pages``. No shuffle.

    A null html is empty; a page without main text gives an empty string. Repeated rows get a row each, an empty table
    gives an empty result; other columns are not read.
    """
    chain = model or fit(labelled_pages())
    names = list(keep)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [chain.main_text((p or b"").decode("utf-8", "replace")) for p in batch.column(html_col).cast(pa.binary()).to_pylist()]
            columns = [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.select(*names, html_col).mapInArrow(read, f"{schema}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A tolerant scan keeps the stack of open elements and cuts a page into leaf blocks: text between
boundaries of block elements. A block's features are its ancestors' tags, words of their class and id,
and its text's form (length, link share, end mark, signs). The CRF has two labels, text and other;
it is trained by stochastic gradient on pages that `labelled_pages` writes from many layouts, with
known labels (a fixed number of pages and a fixed seed, so a fixed model), and decoded by Viterbi.

Result: blocks labelled as text, character references decoded, white space inside a block as one
space, trimmed, in page order, joined by a line feed.

Defined results: null or empty html has empty text; pages are treated one by one, so repeated rows and
null ids don't matter; what scripts, styles, the head, templates and comments hold is no text; br counts
as white space; an input column named like an output is replaced.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object head title textarea select".split())
#: An element that opens ends an open one of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?|[^<]+|<", re.S)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Words of class, id and role that the features name; others are left out, so the model is of fixed size.
HINTS = frozenset("ad ads advert advertisement article author banner body breadcrumb breadcrumbs byline caption comment comments complementary content contentinfo cookie cookies copyright disclaimer disqus dialog entry feed foot footer form head header headline latest legal links login main masthead menu meta modal nav navbar navigation newsletter notice page paragraph popular popup post privacy promo promoted prose recommended related replies reply responses search section share sharing sidebar signup social sponsor sponsored story subscribe tags teaser text title toolbar top trending warning widget".split())
CUES = re.compile(r"(?i)©|\(c\)|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bsign (?:up|in)\b|\blog ?in\b|\bshare\b|\breply\b|\breplied\b|\bcomments?\b|\badvertisement\b|\bsponsored\b|\bread more\b|\bprivacy\b|\bterms\b|\bnewsletter\b|\bmenu\b")


class Open:
    """An open element, with what its ancestors add up to: features, nearest element that isn't inline, whether in a link."""

    __slots__ = ("tag", "parent", "features", "block", "linked")

    def __init__(self, tag: str, hints: frozenset, parent: Open | None):
        self.tag, self.parent = tag, parent
        own = {"hint:" + h for h in hints} | ({"in:" + tag} if tag not in ("html", "body") else set())
        above = parent.features if parent else frozenset()
        self.features = above if own <= above else above | own
        self.block = self if tag not in INLINE else parent.block if parent else None
        self.linked = tag == "a" or bool(parent and parent.linked)


def blocks(page: str) -> list[tuple[str, Open | None, float]]:
    """(text, innermost open element, share of its characters in links) of each leaf block that has text."""
    out: list[tuple[str, Open | None, float]] = []
    top: Open | None = None
    open_now: dict[str, int] = {}
    parts: list[str] = []
    linked = 0
    where: Open | None = None
    endless: set[str] = set()  # raw elements of which no end tag follows

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, where, min(1.0, linked / max(1, len(text)))))
            parts.clear()
        linked = 0

    def shut(node: Open) -> None:
        """Ends node and all within it."""
        nonlocal top
        while True:
            x, top = top, top.parent
            open_now[x.tag] -= 1
            if x is node:
                return

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            t = m.group()
            if t[0] == "<" and len(t) > 1:
                continue
            if not parts:
                where = top
            parts.append(t)
            if top and top.linked:
                linked += len(t.strip())
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in INLINE:
                flush()
            if open_now.get(tag):
                node = top
                while node.tag != tag:
                    node = node.parent
                shut(node)
            continue
        if tag in RAW:
            flush()
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            if end:
                pos = end.end()
                continue
            endless.add(tag)
            if tag in ("script", "style", "noscript", "template", "svg", "textarea", "title"):
                pos = n
            continue
        if tag not in INLINE:
            flush()
            ended = ENDS.get(tag, set()) | {"p"} if tag not in ("td", "th") else ENDS[tag]
            if top and top.block and top.block.tag in ended:
                shut(top.block)
        elif tag in ("br", "wbr") and parts:
            parts.append(" ")
        if tag not in VOID and not m.group(3).endswith("/"):
            hints = frozenset(w for c in _CLASS.findall(m.group(3)) for w in _WORD.findall("".join(c).lower()) if w in HINTS) if m.group(3) else frozenset()
            top = Open(tag, hints, top)
            open_now[tag] = open_now.get(tag, 0) + 1
    flush()
    return out


def features(all_blocks: list) -> list[list[str]]:
    out = []
    n = len(all_blocks)
    for i, (text, within, links) in enumerate(all_blocks):
        f = {"bias"} | (within.features if within else frozenset())
        f.add("holder:" + (within.block.tag if within and within.block else "none"))
        words = text.count(" ") + 1
        f.add(f"words:{min(7, int(math.log2(words)))}")
        f.add(f"links:{int(links * 4)}")
        f.add("end:" + ("stop" if text[-1] in ".!?…:\"'»”)" else "none"))
        if (cue := CUES.search(text)) and words < 60:
            f.add("cue:" + cue.group().lower()[:12])
        f.add(f"place:{min(4, 5 * i // n)}")
        out.append(sorted(f))
    return out


class CRF:
    """Labels 0 (other) and 1 (text): a weight for each feature of label 1, and for each pair of neighbouring labels."""

    def __init__(self):
        self.w: dict[str, float] = {}
        self.t = [[0.0, 0.0], [0.0, 0.0]]

    def emissions(self, fs: list[list[str]]) -> list[float]:
        get = self.w.get
        return [sum(get(x, 0.0) for x in f) for f in fs]

    def viterbi(self, e: list[float]) -> list[int]:
        if not e:
            return []
        t = self.t
        a, b = 0.0, e[0]
        back = []
        for x in e[1:]:
            a0, a1, b0, b1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
            back.append((int(a1 > a0), int(b1 > b0)))
            a, b = max(a0, a1), max(b0, b1) + x
        y = [int(b > a)]
        for p in reversed(back):
            y.append(p[y[-1]])
        return y[::-1]

    def expectations(self, e: list[float]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block and the expected counts of label pairs, by forward and backward sums."""
        n, t = len(e), self.t

        def add(x: float, y: float) -> float:
            m = max(x, y)
            return m + math.log(math.exp(x - m) + math.exp(y - m))

        fw, bw = [(0.0, e[0])], [(0.0, 0.0)] * n
        for i in range(1, n):
            a, b = fw[-1]
            fw.append((add(a + t[0][0], b + t[1][0]), add(a + t[0][1], b + t[1][1]) + e[i]))
        for i in range(n - 2, -1, -1):
            a, b = bw[i + 1][0], bw[i + 1][1] + e[i + 1]
            bw[i] = (add(t[0][0] + a, t[0][1] + b), add(t[1][0] + a, t[1][1] + b))
        z = add(*fw[-1])
        p = [math.exp(f[1] + g[1] - z) for f, g in zip(fw, bw, strict=True)]
        pairs = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(1, n):
            for u in (0, 1):
                for v in (0, 1):
                    pairs[u][v] += math.exp(fw[i - 1][u] + t[u][v] + (e[i] if v else 0.0) + bw[i][v] - z)
        return p, pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> CRF:
        """Stochastic gradient with steps that shrink by feature (AdaGrad) on the conditional log-likelihood."""
        rng = random.Random(seed)
        seen: dict[object, float] = {}

        def step(key: object, now: float, g: float) -> float:
            seen[key] = seen.get(key, 1e-6) + g * g
            return now + rate * (g - decay * now) / math.sqrt(seen[key])

        pages = list(pages)
        for _ in range(epochs):
            rng.shuffle(pages)
            for fs, ys in pages:
                p, pairs = self.expectations(self.emissions(fs))
                g: dict[str, float] = {}
                for f, y, q in zip(fs, ys, p, strict=True):
                    for x in f:
                        g[x] = g.get(x, 0.0) + y - q
                for x, d in g.items():
                    if d:
                        self.w[x] = step(x, self.w.get(x, 0.0), d)
                for u in (0, 1):
                    for v in (0, 1):
                        d = sum(a == u and b == v for a, b in zip(ys, ys[1:], strict=False)) - pairs[u][v]
                        self.t[u][v] = step((u, v), self.t[u][v], d)
        return self


def labelled_pages(n: int = 240, seed: int = 1) -> list[tuple[str, list[int]]]:
    """(html, label of each leaf block): pages of many layouts with invented words."""
    rng = random.Random(seed)
    syllables = "ba ce di fo gu la me ni ro su ta ve wi xo zu pra ste kli mon ter sch eau ción ung".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def phrase(lo: int, hi: int, stop: str = "") -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + stop

    def sentences(lo: int, hi: int) -> str:
        return " ".join(phrase(1, 16, rng.choice("...!?")) for _ in range(rng.randint(lo, hi)))

    def el(tag: str, body: str, names: str = "") -> str:
        return f"<{tag}{f' {rng.choice(['class', 'id', 'class'])}=\"{names}\"' if names else ''}>{body}</{tag}>"

    def link(x: str) -> str:
        return f'<a href="/{word()}">{x}</a>'

    pick = rng.choice
    pages = []
    for _ in range(n):
        html: list[str] = []
        ys: list[int] = []

        def put(markup: str, *labels: int) -> None:
            html.append(markup)  # noqa: B023
            ys.extend(labels)  # noqa: B023

        def menu() -> None:
            k = rng.randint(2, 8)
            items = "".join(el("li", link(phrase(1, 2))) for _ in range(k))
            put(pick([el("nav", el("ul", items)), el("div", el("ul", items), pick(["nav", "menu", "navbar", "navigation", "main-menu", "top-links"])), el("header", el("ul", items)), el("ul", items, "breadcrumb")]), *[0] * k)

        def boiler(kind: str) -> None:
            body = el(pick(["p", "div"]), sentences(1, 3)) if rng.random() < 0.5 else sentences(1, 3)
            if kind == "ad":
                put(pick([el("div", body, pick(["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot"])), el("aside", body, "advertisement")]), 0)
            elif kind == "side":
                k = rng.randint(1, 4)
                put(pick(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="widget">{}</div>', '<section class="related">{}</section>', '<div class="popular">{}</div>']).format("".join(el("p", pick([link(phrase(3, 8)), sentences(1, 3)])) for _ in range(k))), *[0] * k)
            elif kind == "notice":
                put(el(pick(["div", "section"]), el("p", pick(["We use cookies. ", "Privacy notice: ", "", ""]) + sentences(1, 2)), pick(["cookie", "notice", "cookie-banner", "privacy", "modal", "popup", "disclaimer", "warning"])), 0)
            elif kind == "form":
                put(f'<form action="/{word()}">' + el("label", phrase(1, 3)) + '<input type="text" name="q">' + el("button", phrase(1, 2)) + "</form>", 0, 0)
            elif kind == "share":
                put(el("div", " ".join(link(phrase(1, 1)) for _ in range(3)), pick(["share", "social", "tags", "share-tools"])), 0)
            elif kind == "comments":
                k = rng.randint(1, 5)
                put(el(pick(["div", "section"]), "".join(el(pick(["p", "div", "li"]), sentences(1, 4)) for _ in range(k)), pick(["comments", "comment-list", "replies", "disqus", "responses", "reader-comments"])), *[0] * k)

        def paragraph() -> None:
            x = sentences(1, 7)
            r = rng.random()
            if r < 0.1:
                x = f"{x[: len(x) // 2]}<b>{word()}</b> {x[len(x) // 2 :]}"
            elif r < 0.25:
                x = f"{x} {link(word())} {phrase(2, 9, '.')}"
            elif r < 0.3:
                x = phrase(1, 2, ".")
            r = rng.random()
            if r < 0.1:
                put(f"<p><b>{x}<br>", 1)
            elif r < 0.16:
                put(el("blockquote", x), 1)
            elif r < 0.22:
                k = rng.randint(2, 4)
                put(el("ul", "".join(el("li", phrase(3, 12, pick(["", "."]))) for _ in range(k))), *[1] * k)
            elif r < 0.25:
                put(el("h2", phrase(1, 6)), 1)
            elif r < 0.28:
                put(el("pre", x), 1)
            elif r < 0.31:
                put(f"<table><tr><td>{phrase(1, 4)}</td><td>{phrase(1, 4)}</td></tr></table>", 1, 1)
            else:
                put(el(pick(["p", "p", "p", "p", "div"]), x), 1)

        if rng.random() < 0.8:
            menu()
        for kind in ("notice", "ad", "form"):
            if rng.random() < 0.35:
                boiler(kind)
        if rng.random() < 0.3:
            put(el("header", el(pick(["h1", "div", "p"]), phrase(1, 4))), 0)
        if rng.random() < 0.3:
            boiler("side")
        opening, closing = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry">', "</div>"), ('<div class="story text">', "</div>"), ("<div>", "</div>"), ("", "")])
        html.append(opening)
        if rng.random() < 0.8:
            put(el("h1", phrase(2, 12)), 1)
        for _ in range(rng.randint(1, 9)):
            if rng.random() < 0.08:
                boiler(pick(["ad", "share", "side", "notice"]))
            paragraph()
        if rng.random() < 0.2:
            boiler("comments")
        html.append(closing)
        for kind, often in (("share", 0.2), ("comments", 0.4), ("side", 0.3), ("form", 0.2), ("ad", 0.2)):
            if rng.random() < often:
                boiler(kind)
        if rng.random() < 0.85:
            put(pick([el("footer", f"&copy; {word()}.example &middot; {sentences(1, 1)}"), el("footer", el("p", sentences(1, 2))), el("div", f"Copyright {rng.randint(1990, 2030)} {phrase(1, 4)}", "footer")]), 0)
        page = "<!DOCTYPE html><html><head><title>" + phrase(1, 5) + "</title></head><body>" + "".join(html) + ("</body></html>" if rng.random() < 0.9 else "")
        pages.append((page, ys))
    return pages


def trained(n: int = 240) -> CRF:
    """The model, trained on n labelled pages."""
    rows = [(features(b), y) for page, y in labelled_pages(n) if len(b := blocks(page)) == len(y) and b]
    return CRF().fit(rows)


def main_text(page: str | None, model: CRF) -> str:
    found = blocks(page or "")
    labels = model.viterbi(model.emissions(features(found)))
    return "\n".join(b[0] for b, y in zip(found, labels, strict=True) if y)


def extracted(pages: DataFrame, model: CRF) -> DataFrame:
    """(page_id, url, text, n_chars)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._text import pieces

        for b in pieces(batches, "html"):
            texts = [main_text(x, model) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"), trained())

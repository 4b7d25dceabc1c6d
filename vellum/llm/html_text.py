"""Main text of web pages by consensus host paths.

Each page is parsed into containers and text blocks. A block's plain (unlinked) text counts for its container in full
and for each container above it in a smaller share; containers of page furniture get nothing. The containers of a page
with at least LEAST of its best one's score vote for their generalised path: tags and classes from the root, digits and
generated class names replaced; a digest stands for it. Votes are summed for each host in Spark, and every page is
extracted again with the winning path of its host: all blocks below the elements with this path, furniture left out. A
page without that path, or without text there, uses its own best container.

Furniture: elements that never hold main text (menus, footers, side notes, ...), forms that hold no article, section,
menu or title, page headers outside an article, and elements named so by their class, id or role: by the last word of
a name ("site-header", but not "header-image"), readers' comments by any word ("comment-body", "commentlist"), unless it
says that a wrapper has it ("has-sidebar"). An element
around an article isn't furniture by its name; paragraphs, titles, quotes, figures and cells inside an article only by
names of adverts, notices, sharing and comments. If all text of a page is furniture by name, tags and comments alone
decide. Scripts, drawings, buttons and such are cut out of their block without parting it.

Work and memory grow with the length of a page, however deep its elements are. Defined cases: null html is empty and
gives an empty text; text outside any element is a block of the page itself; a null url is a host of its own; of paths
with equal votes the greatest digest wins; repeated rows are extracted each; other columns are ignored; an empty table
gives an empty result. White space is what str.split() splits at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

# HTML elements by their role, and words that name page furniture.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mfenced mtable mtr mtd semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta mspace param source track wbr".split())
WITHIN = frozenset("br img wbr input mspace".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset("noscript template svg canvas object audio video map button select option label legend annotation annotation-xml".split())
NEVER = frozenset("head fieldset dialog nav footer aside menu".split())
STRUCTURE = frozenset("article main section nav header footer aside h1 h2".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead table ul ol dl blockquote pre figcaption figure".split())
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertisements banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies responses form search widget pagination pager toolbar contentinfo complementary".split()
)
HEADS = frozenset(
    "area articles bar block bottom box btn button buttons col column container content div group holder icons inner item items left links list menus message outer overlay panel placeholder policy posts right row section sections slot stories text top unit widgets wrap wrapper zone".split()
)
SOFT = frozenset(
    "header masthead banner search form widget complementary alert related recommended menu navigation nav pagination pager toolbar login signup aside sidebar footer".split()
)
THREADS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored comment comments disqus reply replies responses".split()
)
#: Words that stand for readers' comments wherever they are in a name ("comment-body"), as do words that begin with "comment".
VOICES = frozenset("comment comments commentlist disqus reply replies respond response responses discussion discussions reviews".split())
#: What begins like a comment and is none.
COMMENTARY = ("commentar", "commentat", "commented")
WRAPPER = frozenset("has with without no open closed enabled disabled".split())
CLOSED_BY = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "head": frozenset(["body"]),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Za-z]+")
#: Share of the best container's score that a container needs to vote.
LEAST = 0.5


def generalised(tag: str, classes: str) -> str:
    """A path's step: generated class names vanish, digits become one sign."""
    own = sorted(
        {re.sub(r"\d+", "#", c) for c in classes.lower().split() if not re.fullmatch(r"(?=.*\d)[0-9a-z]*[0-9][0-9a-z]{4,}", c.lower())}
    )
    return ".".join([tag, *own])


def furniture_names(attributes: dict[str, str]) -> list[set[str]]:
    """Of each name in class, id and role that names furniture, its words."""
    out = []
    for value in attributes.values():
        for name in value.lower().split():
            w = [x for x in WORD.findall(name) if len(x) > 1]
            if w and WRAPPER.isdisjoint(w) and any(x in VOICES or x.startswith("comment") and not x.startswith(COMMENTARY) for x in w):
                out.append({"comments"})
            elif w and not NAMES.isdisjoint(w) and (w[-1] in NAMES or w[-1] in HEADS) and WRAPPER.isdisjoint(w):
                out.append(set(w))
    return out


def attributes_of(text: str) -> dict[str, str]:
    return {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(text)} if "=" in text else {}


class Page:
    """Containers, in the order of their start tags, and blocks (container, text, plain length).

    Of a container: its parent, tag, path (a digest), inside (an article), never (furniture by tag), named (by name) and
    thread (comments or advert).
    """

    def __init__(self, html: str):
        self.parent, self.tag, self.path, self.inside, self.never, self.named, self.thread = [-1], [""], [b""], [False], [False], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html)
        self._judge()

    def _parse(self, html: str) -> None:
        stack, open_, text, plain, links, at = [0], Counter(), [], 0, 0, 0
        cut, depth = None, 0  # the element that is being cut out of its block, and how many of its name are open

        def flush():
            nonlocal text, plain
            if text:
                own = " ".join("".join(text).split())
                if own:
                    self.blocks.append((stack[-1], own, plain))
                text, plain = [], 0

        def say(raw: str):
            nonlocal plain
            if raw and cut is None:
                if "&" in raw:
                    raw = unescape(raw)
                text.append(raw)
                if not links:
                    plain += len(raw)

        def pop():
            open_[self.tag[stack.pop()]] -= 1

        last = html.rfind(">") + 1  # no tag ends behind it
        for m in TOKEN.finditer(html, 0, last):
            if m.start() < at:
                continue
            say(html[at : m.start()])
            at = m.end()
            close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if cut is not None:
                if tag == cut:
                    depth += -1 if close else not attrs.rstrip().endswith("/")
                    if not depth:
                        cut = None
                    continue
                if tag in RAW and not close:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else len(html)
                    continue
                # an element that isn't closed ends with the block around it
                if close and open_[tag] or not close and cut == "span" and tag not in INLINE and tag not in VOID and tag not in CUT:
                    cut = None
                else:
                    continue
            if tag in RAW and not close:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if tag in CUT:
                if not close and not attrs.rstrip().endswith("/"):
                    cut, depth = tag, 1
                continue
            if close:
                if tag == "a":
                    links = max(0, links - 1)
                if tag == "br":
                    text.append(" ")
                if tag not in INLINE and tag not in VOID:
                    flush()
                    if open_[tag]:
                        while self.tag[stack[-1]] != tag:
                            pop()
                        pop()
                        links = 0
                continue
            if tag in INLINE or tag in WITHIN:
                if tag == "a":
                    links = 1
                elif tag == "br":
                    text.append(" ")
                elif tag == "span" and furniture_names(attributes_of(attrs)):
                    cut, depth = tag, 1  # an inline notice or advert leaves its block
                continue
            flush()
            if tag in VOID:
                continue
            while len(stack) > 1 and tag in CLOSED_BY.get(self.tag[stack[-1]], ()):
                pop()
                links = 0
            own = attributes_of(attrs)
            names, up = furniture_names(own), stack[-1]
            if tag in ("html", "body"):
                names = []
            elif tag in LEAVES and self.inside[up]:
                names = [w for w in names if not w <= SOFT | HEADS]
            step = generalised(tag, own.get("class", ""))
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(hashlib.md5(self.path[up] + step.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
            self.inside.append(self.inside[up] or tag in ("article", "main"))
            self.never.append(self.never[up] or tag in NEVER or tag == "header" and not self.inside[up])
            self.named.append(bool(names))
            self.thread.append(any(w & THREADS for w in names))
            if attrs.rstrip().endswith("/") and tag not in ("p", "div", "li"):
                continue
            stack.append(len(self.parent) - 1)
            open_[tag] += 1
        say(re.split(r"<[!?]", html[at:], maxsplit=1)[0])
        flush()

    def _judge(self) -> None:
        n = len(self.parent)
        holds, shaped = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            if holds[i] or self.tag[i] in ("article", "main") and not self.named[i] and not self.never[i]:
                holds[self.parent[i]] = True
            if shaped[i] or self.tag[i] in STRUCTURE:
                shaped[self.parent[i]] = True
        gone, self.out = [False] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            gone[i] = gone[up] or self.never[i] or self.tag[i] == "form" and not shaped[i] or self.thread[i] and not holds[i]
            self.out[i] = self.out[up] or gone[i] or self.named[i] and not holds[i]
        if all(self.out[c] for c, _, _ in self.blocks):
            self.out = gone

    def scores(self) -> list[float]:
        """Plain text below each container, the farther below the less."""
        n = len(self.parent)
        score = [0.0] * n
        for c, _, plain in self.blocks:
            if not self.out[c]:
                # the block's own element (a paragraph) isn't its container
                score[self.parent[c] if c and self.tag[c] in LEAVES else c] += plain
        for i in range(n - 1, 0, -1):
            score[self.parent[i]] += 0.5 * score[i]
        return [2 * s if t in ("article", "main") else s for s, t in zip(score, self.tag, strict=True)]

    def votes(self) -> list[tuple[str, float]]:
        """(path, share) of the page's best containers, the best first."""
        s = self.scores()
        by: dict[bytes, float] = {}
        for p, v in zip(self.path, s, strict=True):
            if v > 0:
                by[p] = by.get(p, 0.0) + v
        best, total = max(by.values(), default=0.0), sum(by.values())
        return [(p.hex(), v / total) for p, v in sorted(by.items(), key=lambda x: (-x[1], x[0])) if v >= LEAST * best]

    def text(self, path: str | None) -> str:
        found = self._below(path) if path is not None else ""
        if not found:
            own = self.votes()
            found = self._below(own[0][0]) if own else ""
        return found or self._below("")

    def _below(self, path: str) -> str:
        """The text below the containers with a path, furniture left out."""
        wanted, inside = bytes.fromhex(path), [False] * len(self.parent)
        for i, p in enumerate(self.path):
            inside[i] = p == wanted and not self.out[i] or i > 0 and inside[self.parent[i]]
        return "\n".join(t for c, t, _ in self.blocks if inside[c] and not self.out[c])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        host, path, share = [], [], []
        for h, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for p, s in Page(html or "").votes():
                host.append(h)
                path.append(p)
                share.append(s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(share, pa.float64())],
            ["host", "path", "share"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and path (a digest of the host's winning path) of every page."""
    host = F.coalesce(
        F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?(?:www\.)?([^/:?#]*)", 1)),
        F.lit(""),
    )
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(
        _votes, "host string, path string, share double",
    ).groupBy("host", "path").agg(F.round(F.sum("share"), 6).alias("share"))
    # written, so that the planner knows the size of what it may broadcast
    won = written(votes.groupBy("host").agg(F.max_by("path", F.struct("share", "path")).alias("path")), "paths")

    def extract(batches):
        for b in batches:
            got = [Page(html or "").text(path) for html, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.string()), b.column(3)], ["page_id", "url", "text", "path"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    both = rows.join(won, "host", "left").select("page_id", "url", "html", "path")
    out = both.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, path string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op2_query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

"""Main text of web pages by consensus of a host's pages.

1. Each page's containers are scored: the characters of their blocks outside boilerplate, less links; the smallest that
   holds most of the page's text is the page's choice.  Its path, a chain of tag.class steps whose numbers are
   generalised, is the page's vote.
2. Spark counts the votes of each host.  Paths with a twentieth of them are the host's winning paths (twenty at most).
3. Each page is read again with the winning paths of its host: of those that lead to text on this page, the one whose share
   of votes times the root of its share of the page's text is greatest gives the article (on equal terms the smaller path).
   A page on which none does keeps its own choice, so no page is lost to its host's majority.
4. What lies outside the article is text if it varies from page to page: a lead in a container of its own, a second article,
   the heading before the article. Blocks outside that come back, path and text, on ``repeats`` of the host's pages (two at
   least) are boilerplate, and so is what stands in the same named place; so are those that are links for the most part.

Blocks are what block-level tags bound.  Character references are decoded, white space becomes single spaces, blocks are
trimmed and joined by an empty line in page order.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are told by tag, role, and names in class and id: every part of such a name is a listed word or
says where or in what form (``site-header``, ``comment-list``, but not ``no-sidebar`` or ``page-header-fixed``).  A name does
not discard a container of main, of the page's only articles, or, where it has neither, of most of its text, unless that is
reader comments.  List items and table cells go by name only as adverts and comments, inline elements only as adverts, and never
past the end of their block.  An article inside main brings what else main holds.  Of a header inside an article or main, its headings stay:
they are the article's own title; what else it holds (bylines, dates, buttons) goes as headers do.

Defined results: null, empty or tag-only html gives an empty text; a null url belongs to a host of its own (empty); rows
that repeat a page_id come back each; nesting may be of any depth; text without any markup is one block; a tag that the page's end cuts off is dropped;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .url_rules import host_of

# A quote opens a value after an equals sign only; elsewhere it is a character like others.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>=]|=)*+)(>|\Z)|<[!?/](?:[^>]*)(?:>|\Z)""", re.S
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-zA-Z]+")
#: Elements whose content is not text.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes")}
#: Boilerplate by tag, by role, and by words of class or id.
BAD_TAGS = frozenset("nav header footer aside form head template button select option datalist dialog menu svg math canvas audio video object label fieldset noscript".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead topbar footer footnav sidebar aside widget widgets cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter "
    "signup login comment comments commentlist reply replies respond disqus share sharing social related recommended pagination pager skip toolbar".split()
)
#: What discards an inline element, and, with comments, a list item or a cell.
AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Parts of a name that say where or in what form the rest is.
FORM_WORDS = frozenset(
    "site page post entry article blog main primary secondary global mobile desktop top bottom left right inner outer sticky wrap wrapper container box bar block list item items area "
    "section panel group row col column module unit slot zone link links button buttons btn icon icons title label text image form tools actions message policy inline first last sub".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul head button select label caption legend template svg math canvas audio video object datalist".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ITEMS = frozenset("li td th tr dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div td body blockquote html dd li center".split())
GOOD = {"article": 1.5, "main": 1.3}


class Page:
    """blocks: (text, linked characters, element), without boilerplate; elements: (parent, step, tag)."""

    __slots__ = ("blocks", "elements")

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.elements: list[tuple[int, str, str]] = [(-1, "", "")]
        stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, element, and whether text goes: 0 no, 1 yes, 2 unless in a heading
        opened: Counter[str] = Counter()
        pieces: list[str] = []
        named: dict[int, set[str]] = {}  # elements that only their names make boilerplate, and the words
        linked, in_link, at, n = 0, 0, 0, len(html)
        inline: list = []  # of an inline element that goes: its tag, and how many of that tag are open in it

        def flush() -> None:
            nonlocal linked
            inline.clear()
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text and not stack[-1][2]:
                    self.blocks.append((text, min(linked, len(text)), stack[-1][1]))
                pieces.clear()
            linked = 0

        while at < n:
            m = _TOKEN.search(html, at)
            end = m.start() if m else n
            if end > at and not stack[-1][2] and not inline:
                pieces.append(html[at:end])
                if in_link:
                    linked += end - at
            if not m:
                break
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            if not m[4]:
                break
            tag = tag.lower()
            if m[1]:
                if inline and tag == inline[0]:
                    inline[1] -= 1
                    if not inline[1]:
                        inline.clear()
                if tag == "a":
                    in_link = max(0, in_link - 1)
                elif tag in BLOCKS:
                    flush()
                    while opened[tag]:
                        top = stack.pop()[0]
                        opened[top] -= 1
                        if top == tag:
                            break
                continue
            if tag in RAW:
                close = RAW[tag].search(html, at)
                at = close.end() if close else n
                continue
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                in_link = 1
            if tag not in BLOCKS:
                if tag in VOID or stack[-1][2]:
                    continue
                # An inline advert or the like goes with its content and bounds no block.
                if inline:
                    inline[1] += tag == inline[0]
                elif m[3] and (self._bad(tag, m[3]) or self._named(tag, m[3]) & AD_WORDS):
                    inline += [tag, 1]
                continue
            flush()
            if tag in VOID:
                continue
            if stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
            shut = SELF_CLOSING.get(tag)
            if shut and stack[-1][0] in shut:
                opened[stack.pop()[0]] -= 1
            bad = stack[-1][2]
            if bad == 2 and tag in HEADINGS and not self._bad(tag, m[3]):
                bad = 0
            elif not bad and self._bad(tag, m[3]):
                bad = 2 if tag == "header" and (opened["article"] or opened["main"]) else 1
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            words = set() if bad else self._named(tag, m[3])
            if tag in ITEMS:
                words &= AD_WORDS | COMMENT_WORDS
            opened[tag] += 1
            if bad or tag == "p" and not words:
                stack.append((tag, stack[-1][1], bad))
            else:
                if words:
                    named[len(self.elements)] = words
                self.elements.append((stack[-1][1], self._step(tag, m[3]), tag))
                stack.append((tag, len(self.elements) - 1, 0))
        flush()
        if named:
            self._discard(named)

    def _discard(self, named: dict[int, set[str]]) -> None:
        """Drop the blocks of named elements, but for those that hold what the page is about."""
        size, under = self._sums([float(len(text)) for text, _, _ in self.blocks]), [False] * len(self.elements)
        for e, (parent, _, _) in enumerate(self.elements):
            under[e] = e in named or parent >= 0 and under[parent]
        tags = [t for _, _, t in self.elements]
        mains, articles = ([e for e, t in enumerate(tags) if t == name] for name in ("main", "article"))
        keep: set[int] = set()
        holds, seen = mains or (articles if all(under[e] for e in articles) else []), [False] * len(tags)
        for e in holds:
            while e >= 0 and not seen[e]:
                seen[e] = True
                if e in named and (mains or not named[e] & COMMENT_WORDS):
                    keep.add(e)
                e = self.elements[e][0]
        if not mains and not articles:
            keep = {x for x in named if 2 * size[x] > size[0] and not named[x] & COMMENT_WORDS}
        gone = [False] * len(tags)
        for e, (parent, _, _) in enumerate(self.elements):
            gone[e] = e in named and e not in keep or parent >= 0 and gone[parent]
        self.blocks = [b for b in self.blocks if not gone[b[2]]]

    def _sums(self, worth: list[float]) -> list[float]:
        """For each element the sum over the blocks in it; children come after their parents."""
        out = [0.0] * len(self.elements)
        for w, (_, _, at) in zip(worth, self.blocks, strict=True):
            out[at] += w
        for e in range(len(out) - 1, 0, -1):
            out[self.elements[e][0]] += out[e]
        return out

    @staticmethod
    def _attrs(raw: str) -> dict[str, str]:
        return {a.lower(): (x or y or z or "") for a, x, y, z in _ATTR.findall(raw)} if raw else {}

    @classmethod
    def _bad(cls, tag: str, raw: str) -> bool:
        if tag in BAD_TAGS:
            return True
        if not raw or tag in ("body", "html"):
            return False
        a = cls._attrs(raw)
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return True
        if BAD_ROLES.intersection(a.get("role", "").lower().split()):
            return True
        return False

    @classmethod
    def _named(cls, tag: str, raw: str) -> set[str]:
        """The listed words of names in class and id that are boilerplate as a whole."""
        if not raw or tag in ("body", "html", "article", "main"):
            return set()
        a, out = cls._attrs(raw), set()
        for name in f"{a.get('class', '')} {a.get('id', '')}".lower().split():
            parts = set(_WORD.findall(name))
            if parts & BAD_WORDS and parts <= BAD_WORDS | FORM_WORDS:
                out |= parts & BAD_WORDS
        return out

    @classmethod
    def _step(cls, tag: str, raw: str) -> str:
        names = sorted({re.sub(r"\d+", "0", x) for x in cls._attrs(raw).get("class", "").split()})
        return ".".join([tag, *names])

    def path(self, element: int) -> str:
        steps = []
        while element > 0:
            parent, step, _ = self.elements[element]
            steps.append(step)
            element = parent
        return ">".join(reversed(steps))

    def choice(self) -> int:
        """The container that wins on this page; 0 is the whole page."""
        score = self._sums([len(text) * (1 - linked / len(text)) ** 2 for text, linked, _ in self.blocks])
        best, top, depth = 0, 0.0, [0] * len(score)
        for e, (parent, _, tag) in enumerate(self.elements):  # on equal terms the inner one wins
            depth[e] = depth[parent] + 1 if e else 0
            if (not e or tag in CONTAINERS) and score[e] >= 0.5 * score[0] and score[e] > 0:
                worth = score[e] / score[0] * GOOD.get(tag, 1.0) + 0.02 * min(depth[e], 10)
                if worth >= top:
                    best, top = e, worth
        # What main has beside its article is no boilerplate either.
        up = best
        while up > 0 and self.elements[up][2] != "main":
            up = self.elements[up][0]
        return up if up > 0 else best

    def _inside(self, wanted: set[int]) -> list[bool]:
        inside = [False] * len(self.elements)
        for e, (parent, _, _) in enumerate(self.elements):
            inside[e] = e in wanted or parent >= 0 and inside[parent]
        return inside

    def size(self, wanted: set[int]) -> int:
        """Characters of the blocks in the elements wanted."""
        inside = self._inside(wanted)
        return sum(len(t) for t, _, e in self.blocks if inside[e])

    def others(self, wanted: set[int]) -> dict[int, tuple[int, int | None]]:
        """Blocks outside the elements wanted that are not links for the most part, with what tells whether they repeat: (mark, place)."""
        inside = self._inside(wanted)
        return {i: self._mark(t, e) for i, (t, linked, e) in enumerate(self.blocks) if not inside[e] and 2 * linked < len(t)}

    def _mark(self, text: str, element: int, steps: int = 3) -> tuple[int, int | None]:
        """Hashes of a block's text, numbers generalised, with the end of its path, and of that end alone where a step of it has a class."""
        tail = []
        while element > 0 and len(tail) < steps:
            tail.append(self.elements[element][1])
            element = self.elements[element][0]
        marks = [xxhash.xxh3_64_intdigest("\n".join(x).encode("utf-8", "replace")) - (1 << 63) for x in ([*tail, re.sub(r"\d+", "0", text)], tail)]
        return marks[0], marks[1] if any("." in x for x in tail) else None

    def text(self, wanted: set[int], repeated: frozenset[int] = frozenset()) -> str:
        """The blocks in the elements wanted, and those outside that do not repeat on the host's pages."""
        inside, others = self._inside(wanted), self.others(wanted)
        return "\n\n".join(t for i, (t, _, e) in enumerate(self.blocks) if inside[e] or i in others and repeated.isdisjoint(others[i]))

    def by_path(self, path: str) -> set[int]:
        """The elements at the end of the chain of steps, in one pass: a step leads on from its parent's."""
        steps, out, done = path.split(">"), set(), [0] * len(self.elements)
        for e, (parent, step, _) in enumerate(self.elements):
            if e:
                done[e] = done[parent] + 1 if 0 <= done[parent] < len(steps) and steps[done[parent]] == step else -1
                if done[e] == len(steps):
                    out.add(e)
        return out


def extract_page(html: str | None, paths: list[tuple[str, float]], repeated: frozenset[int] = frozenset()) -> str:
    """The text of a page, given its host's winning paths with their shares of votes, and the marks of blocks that repeat."""
    if not html:
        return ""
    page, best, wanted = Page(html), 0.0, None
    whole = sum(len(t) for t, _, _ in page.blocks)
    for path, share in sorted(paths):
        if (found := page.by_path(path)) and (size := page.size(found)) and share * (size / whole) ** 0.5 > best:
            best, wanted = share * (size / whole) ** 0.5, found
    return page.text({page.choice()} if wanted is None else wanted, repeated)


def extract(scratch: Scratch, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", winning: float = 0.05, repeats: float = 0.3) -> DataFrame:
    """(id, url, text). winning: the share of a host's votes that makes a path a winning one; so a host has 1 / winning at most.

    repeats: the share of a host's pages on which a block outside the article is boilerplate.
    """
    host = F.coalesce(host_of(F.col(url_col).cast("string")), F.lit(""))
    base = pages.select(F.struct(F.col(id_col), F.col(url_col)).alias("_row"), F.col(html_col).cast("string").alias("_html"), host.alias("_host"))

    def vote(batches):
        import pyarrow as pa

        for b in batches:
            hosts, paths, marks, places = [], [], [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                page = Page(html.as_py() or "")
                chosen = page.choice()
                own = set(page.others({chosen}).values())
                hosts += [host] * (1 + len(own))
                paths += [page.path(chosen), *[None] * len(own)]
                marks += [None, *(m for m, _ in own)]
                places += [None, *(p for _, p in own)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(marks, pa.int64()), pa.array(places, pa.int64())], names=["_host", "path", "mark", "place"])

    votes = base.select("_host", "_html").mapInArrow(vote, "_host string, path string, mark long, place long").groupBy("_host", "path", "mark", "place").count()
    votes = scratch.write(votes, "votes")
    voted, marked = votes.where("path <> ''"), votes.where("mark is not null and count > 1")
    all_ = votes.where("path is not null").groupBy("_host").agg(F.sum(F.when(F.col("path") != "", F.col("count"))).alias("votes"), F.sum("count").alias("pages"))
    share = F.col("count") / F.col("votes")
    best = voted.join(all_, "_host").where(share >= winning).groupBy("_host").agg(F.collect_list(F.struct("path", share.alias("share"))).alias("_paths"))
    same = marked.join(all_, "_host").where(F.col("count") / F.col("pages") >= repeats).groupBy("_host").agg(F.concat(F.collect_list("mark"), F.collect_set("place")).alias("_marks"))
    best = scratch.write(best.join(same, "_host", "full"), "paths")

    @F.pandas_udf("string")
    def read(html, paths, marks):
        import pandas as pd

        out = []
        for h, p, m in zip(html, paths, marks, strict=True):
            out.append(extract_page(h, [] if p is None else [(x["path"], x["share"]) for x in p], frozenset() if m is None else frozenset(map(int, m))))
        return pd.Series(out)

    found = lookup(base, best, ["_host"], F.xxhash64("_html"), "left")
    return found.select("_row.*", read("_html", "_paths", "_marks").alias("text"))

"""Main text of web pages: points for prose go up the element tree; the best container and its like siblings are kept."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm.common import slices, table

#: Characters of pages worked on at once within a task.
CHUNK = 20_000_000
#: Ancestors that a paragraph's points reach; the k-th of them gets a k-th.
REACH = 6
#: Elements looked at for one that a start ends, and ancestors for one that takes points.
DEEPEST = 250
#: An ancestor with so much more prose than the best container takes its place.
WIDER = 1.25

# Elements by the HTML standard, and usual names of parts that aren't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont link meta title style script noscript template".split())
NEVER = frozenset("head script style noscript template textarea title xmp iframe noembed noframes object embed applet canvas svg audio video map "
                  "nav footer aside menu dialog button select option datalist input fieldset".split())
CONTAINERS = frozenset("html body div section article main".split())
LISTS = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th".split())
#: What the start of an element closes: (elements closed, elements that shield them).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)), "option": (("option",), ("select",)),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Names that mark other parts whatever stands beside them, and names that do so unless the element is named as content too.
STRONG = re.compile(r"(?:ad|ads|adbox|adslot|adunit|adsense|advert\w*|sponsor\w*|comments?|commentlist|commentary|\w+comments|disqus\w*|respond|replies|kommentare?"
                    r"|commentaires?|comentarios?|cookies?|cookie\w+|consent|gdpr|\w*sidebar|nav|\w*navbar|navigation|menu|\w+menu|breadcrumbs?|footer|\w+footer|newsletter|popup|modal"
                    r"|subscri\w+|paywall|pagination|pager|noprint)")
WEAK = re.compile(r"(?:header|masthead|topbar|toolbar|banner|notice|notices|alert|alerts|warning|overlay|toast|promo\w*|related|recommended|recommendations|share|sharing|social"
                  r"|widgets?|login|signup|signin|search|trending|popular|teasers?|copyright|legal|disclaimer|skip|feedback|aside|rail)")
CONTENT = frozenset("article content main post entry story body text".split())
NOT_HAVING = frozenset("has with no without".split())
COMMENTS_TITLE = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|leser)?\s*-?comments?|kommentare?|leserkommentare|commentaires?|comentarios?|leave a (?:comment|reply)|responses?|replies)\W*(?:\(?\d+\)?)?\W*", re.I)

#: An element's attributes and its end; an open quote ends where the element does.
REST = re.compile(r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|=)*+>""")
NAME = re.compile(r"[A-Za-z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s/>="']++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))""")
HIDDEN = re.compile(r"(?:^|[\s/])hidden(?:$|[\s/=])", re.I)
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
PARTS = re.compile(r"[^a-z0-9]+")


class Tree:
    """Elements and texts of a page in document order. ``tag`` is None for a text; ``end`` is where an element's inside ends."""

    def __init__(self, page: str):
        self.tag: list[str | None] = ["html"]
        self.parent: list[int] = [-1]
        self.inside: list[str] = [""]  # an element's attributes, a text's characters
        self.end: list[int] = [0]
        self._open = [0]
        self._count: dict[str, int] = {"html": 1}
        self._frames: list[dict[str, int]] = [{}]  # open inline elements within each open block
        self._read(page)
        while self._open:
            self._pop()

    def _add(self, tag: str | None, inside: str) -> int:
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.inside.append(inside)
        self.end.append(len(self.tag))
        return len(self.tag) - 1

    def _push(self, tag: str, inside: str) -> None:
        self._open.append(self._add(tag, inside))
        self._count[tag] = self._count.get(tag, 0) + 1
        if tag in INLINE:
            self._frames[-1][tag] = self._frames[-1].get(tag, 0) + 1
        else:
            self._frames.append({})

    def _pop(self) -> str:
        i = self._open.pop()
        tag = self.tag[i]
        self.end[i] = len(self.tag)
        self._count[tag] -= 1
        if tag in INLINE:
            self._frames[-1][tag] -= 1
        elif self._open:
            self._frames.pop()
        return tag

    def _text(self, s: str) -> None:
        if not s:
            return
        if self._count.get("head") and not s.isspace():
            self._close("head")
        self._add(None, s)

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if not self._frames[-1].get(tag):
                return
        elif not self._count.get(tag) or tag in ("html", "body"):
            return
        while self._pop() != tag:
            pass

    def _before(self, tag: str) -> None:
        """Ends what the start of ``tag`` ends."""
        if self._count.get("head") and tag not in IN_HEAD:
            self._close("head")
        if tag not in INLINE and self._count.get("p"):
            self._close_within(("p",), ())
        if tag in CLOSES:
            self._close_within(*CLOSES[tag])

    def _close_within(self, closed: tuple, shields: tuple) -> None:
        """Ends the innermost open element of ``closed`` unless one of ``shields`` or a container lies between; no shields: any block does."""
        if not any(self._count.get(c) for c in closed):
            return
        for i in self._open[:-DEEPEST:-1]:
            tag = self.tag[i]
            if tag in closed:
                self._close(tag)
                return
            if tag not in INLINE and (not shields or tag in shields or tag in CONTAINERS):
                return

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                return
            nxt = page[lt + 1:lt + 2]
            if nxt == "!" or nxt == "?":
                self._text(page[at:lt])
                if page.startswith("<!--", lt):
                    stop = page.find("-->", lt + 2)
                    at = size if stop < 0 else stop + 3
                else:
                    stop = page.find(">", lt)
                    at = size if stop < 0 else stop + 1
                continue
            ending = nxt == "/"
            name = NAME.match(page, lt + 1 + ending)
            if not name:
                if ending:  # not a tag: up to its end it is a comment
                    self._text(page[at:lt])
                    stop = page.find(">", lt)
                    at = size if stop < 0 else stop + 1
                else:
                    self._text(page[at:lt + 1])
                    at = lt + 1
                continue
            self._text(page[at:lt])
            rest = REST.match(page, name.end())
            if not rest:
                return  # cut off within a tag
            tag, at = name.group().lower(), rest.end()
            if ending:
                self._close(tag)
                continue
            self._before(tag)
            if tag in ("html", "body") and self._count.get(tag):
                continue
            inside = page[name.end():at - 1]
            if tag in VOID:
                self._add(tag, inside)
            elif tag in RAW:
                self._push(tag, inside)
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = stop.start() if stop else size
            else:
                self._push(tag, inside)


def attributes(inside: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(inside)}


def other_part(tag: str, inside: str) -> int:
    """2 if an element's attributes say for sure that it isn't of the article, 1 if they hint so, 0 otherwise."""
    if "=" not in inside and not HIDDEN.search(inside):
        return 0
    of = attributes(inside)
    if HIDDEN.search(re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", "", inside)) or of.get("aria-hidden", "").lower() == "true" or NOT_SHOWN.search(of.get("style", "")):
        return 2
    names = [n for a in ("id", "class") for n in PARTS.split(HUMP.sub("-", of.get(a, "")).lower()) if n]
    before = ["", *names]
    strong = any(STRONG.fullmatch(n) and b not in NOT_HAVING for b, n in zip(before, names, strict=False))
    if tag == "article":
        return 2 if any(n.startswith("comment") or n in ("reply", "replies") for n in names) else 0
    if strong or of.get("role", "").lower() in ROLES:
        return 2
    return 1 if not CONTENT.intersection(names) and any(WEAK.fullmatch(n) and b not in NOT_HAVING for b, n in zip(before, names, strict=False)) else 0


class Page:
    """A page's tree with the prose and links below each element."""

    def __init__(self, source: str):
        t = self.t = Tree(source)
        n = len(t.tag)
        self.texts = {i: html.unescape(s) for i, s in enumerate(t.inside) if t.tag[i] is None}
        self.holds = [False] * n  # an article or main element below
        self.within = [False] * n  # inside one
        for i in range(n - 1, 0, -1):
            if self.holds[i] or t.tag[i] in ("article", "main"):
                self.holds[t.parent[i]] = True
        for i in range(1, n):
            p = t.parent[i]
            self.within[i] = self.within[p] or t.tag[p] in ("article", "main")
        self.hints = [0] * n
        for i in range(1, n):
            tag = t.tag[i]
            if tag is None or tag in ("html", "body", "main") or tag in VOID:
                continue
            if tag in NEVER:
                self.hints[i] = 2
            elif tag == "header":
                self.hints[i] = 0 if self.holds[i] else 2
            elif tag == "form":
                self.hints[i] = 1
            elif t.inside[i] and not self.holds[i]:
                self.hints[i] = other_part(tag, t.inside[i])
        self._comment_sections()

    def _comment_sections(self) -> None:
        """A section or block that starts with a heading such as "Comments" is one of reader comments."""
        t = self.t
        begun = [False] * len(t.tag)
        for i in range(1, len(t.tag)):
            p = t.parent[i]
            if begun[p] or (t.tag[i] is None and t.inside[i].isspace()):
                continue
            begun[p] = True
            if t.tag[i] in HEADINGS and t.tag[p] in ("section", "div") and not self.holds[p]:
                title = " ".join("".join(self.texts.get(j, "") for j in range(i + 1, min(t.end[i], i + 8))).split())
                if len(title) < 60 and COMMENTS_TITLE.fullmatch(title):
                    self.hints[p] = 2

    def measure(self, gone: list[bool]) -> None:
        """Blocks of text outside ``gone`` elements, and the points, characters and link characters below each element."""
        t, n = self.t, len(self.t.tag)
        self.gone = gone
        linked = [False] * n
        block = [0] * n  # the innermost block around
        for i in range(1, n):
            p = t.parent[i]
            linked[i] = linked[p] or t.tag[p] == "a"
            block[i] = p if t.tag[p] not in INLINE else block[p]
        self.block = block
        chars, links, commas = [0] * n, [0] * n, [0] * n
        for i, s in self.texts.items():
            if not gone[i]:
                k = len(" ".join(s.split()))
                b = block[i]
                chars[b] += k
                links[b] += k * linked[i]
                commas[b] += s.count(",") + s.count("，") + s.count("、")
        self.score = [0.0] * n
        self.raw = [0.0] * n
        for b in range(n):
            if not chars[b]:
                continue
            points = (1 + commas[b] + min(chars[b] / 100, 3)) * (1 - links[b] / chars[b]) * (0.3 if t.tag[b] in HEADINGS else 1)
            self.raw[b] += points
            a, k = (b if t.tag[b] in CONTAINERS else t.parent[b]), 1
            for _ in range(DEEPEST):
                if a < 0 or k > REACH:
                    break
                if t.tag[a] not in LISTS and t.tag[a] not in INLINE and t.tag[a] not in HEADINGS:
                    self.score[a] += points / k
                    k += 1
                a = t.parent[a]
        for i in range(n - 1, 0, -1):
            p = t.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            self.raw[p] += self.raw[i]
        self.chars, self.links = chars, links

    def density(self, i: int) -> float:
        return self.links[i] / self.chars[i] if self.chars[i] else 0.0

    def spread(self, marked: list[bool]) -> list[bool]:
        """Elements in ``marked`` with all they hold. Of a header inside the article, its headings stay."""
        t, out = self.t, [False] * len(marked)
        for i in range(1, len(marked)):
            p = t.parent[i]
            out[i] = marked[i] or out[p]
            if out[i] and t.tag[i] in HEADINGS and t.tag[p] == "header" and self.within[p] and not out[t.parent[p]] and not marked[i]:
                out[i] = False
        return out

    def main(self) -> tuple[list[int], list[bool]]:
        """Containers of the main text in document order, and what is left out of them."""
        n = len(self.t.tag)
        self.measure([False] * n)
        everything = self.raw
        for least in (1, 2, 3):  # where nothing would be left, hints count less
            marked = [h >= min(least, 2) and (least < 3 or self.t.tag[i] in NEVER) for i, h in enumerate(self.hints)]
            for i in range(n):  # hints alone don't take away most of a page
                if marked[i] and self.hints[i] == 1 and everything[i] > 0.5 * everything[0]:
                    marked[i] = False
            self.measure(self.spread(marked))
            if self.chars[0]:
                break
        else:
            return [], self.gone
        best = self._container()
        kept = self._siblings(best)
        return kept, self._without_menus(kept, best)

    def _container(self) -> int:
        t = self.t
        able = [i for i in range(len(t.tag)) if self.score[i] > 0 and not self.gone[i]]
        if not able:
            able = [0]
        best = max(able, key=lambda i: (self.score[i] * (1 - self.density(i)), -i))
        line = [best]
        while t.parent[line[-1]] >= 0:
            line.append(t.parent[line[-1]])
        whole = [a for a in line if t.tag[a] == "article"] or [a for a in line if t.tag[a] == "main"]
        if whole:
            return whole[-1]
        for a in line[1:]:
            if self.raw[a] >= WIDER * self.raw[best] and self.density(a) < 0.4:
                best = a
        return best

    def _siblings(self, best: int) -> list[int]:
        t, p = self.t, self.t.parent[best]
        if p < 0:
            return [best]
        kept, i = [], p + 1
        wanted = max(2.0, 0.2 * self.raw[best])
        while i < t.end[p]:
            tag = t.tag[i]
            if i == best:
                kept.append(i)
            elif tag is not None and not self.gone[i] and self.chars[i] and self.density(i) < 0.25:
                like = self.raw[i] >= wanted and (t.tag[best] != "article" or tag == "article")
                lone = tag == "p" and t.tag[best] not in ("article", "main") and self.chars[i] > 80
                title = tag in ("h1", "h2") and i < best and t.tag[best] not in ("article", "main")
                if like or lone or title:
                    kept.append(i)
            i = t.end[i]
        return kept

    def _without_menus(self, kept: list[int], best: int) -> list[bool]:
        """Lists and blocks of little but links go: menus and related links without a name."""
        t = self.t
        marked = [False] * len(t.tag)
        for top in kept:
            for i in range(top + 1, t.end[top]):
                if t.tag[i] in ("ul", "ol", "div", "section", "table") and not self.gone[i] and self.chars[i] and self.density(i) > 0.7:
                    if sum(t.tag[j] == "a" for j in range(i + 1, min(t.end[i], i + 40))) >= 3:
                        marked[i] = True
        inner = self.spread(marked)
        return [a or b for a, b in zip(self.gone, inner, strict=True)]

    def blocks(self) -> list[str]:
        kept, gone = self.main()
        t, out = self.t, []
        for top in kept:
            pieces: list[str] = []
            last = None
            for i in range(top, t.end[top]):
                tag = t.tag[i]
                if tag == "br" or (tag is not None and tag in VOID and tag in INLINE):
                    if not gone[i]:
                        pieces.append(" ")
                    continue
                at = self.block[i] if tag is None else i if tag not in INLINE else None
                if at is not None and at != last:  # another block begins, or an outer one goes on
                    out.append(" ".join("".join(pieces).split()))
                    pieces, last = [], at
                if tag is None and not gone[i]:
                    pieces.append(self.texts[i])
            out.append(" ".join("".join(pieces).split()))
        return [b for b in out if b]


def main_text(source: str | None) -> str:
    """The blocks of a page's main text, joined by two line ends."""
    return "\n\n".join(Page(source).blocks()) if source else ""


def _texts(batches):
    for batch in batches:
        pages = batch.column("html").to_pylist()
        for ids, urls, part in slices([batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), pages], [len(p or "") for p in pages], CHUNK):
            texts = [main_text(p) for p in part]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``page_id, url, text, n_chars``, one row per row of it.

    Each page's element tree is built, parts that aren't the article are set aside by element, role and usual names (menus, page
    headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden elements), and each block of text
    gives points for its length and commas, less its share of link text, to the elements around it. The element with
    most points, widened to the article around it, and siblings with prose of their own are kept whole.

    Null and empty pages, and pages without text, give an empty text. Damaged markup is read as far as it goes: unclosed elements end
    with what holds them, a page cut off within a tag, a comment or a script ends there. Work grows with a page's length,
    memory with one page. Rows that are equal or share an id are each treated; other columns are ignored; no row, none.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))

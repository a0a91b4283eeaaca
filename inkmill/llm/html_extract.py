"""Main text of web pages by paths on which the pages of a host agree.

1. Each page's containers are scored: a block of text counts, without its linked part, for the container
   around it and less for those above.  Parts of an article (list items, cells, quotations, figures, sections) are
   no containers.  From a container one climbs to the article's outer element: to each element above that adds
   content, which is a paragraph, heading, item, cell, quotation or caption, or 60 characters and more, mostly
   unlinked; body, and what lies above an article or main, are not climbed to.  The container's share of the page's
   score is a vote for the outer element's generalised path (tags, and classes without digits, from the body down).
2. Spark adds the votes up per host and path; each host's winner has the most (ties: the first by
   name).  Votes are summed before they are shuffled, so a host with a third of all pages is no burden.
3. Each page is read again, and all text of its elements on the winning path is taken, climbing further where
   this page adds content; a page without such an element, or with no text there, falls back on its own best
   container.  If it has no heading of the first or second level, such headings that stand before it, beside it or
   an element around it, belong to it.

Left out anywhere: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by tag, role, class or id; the header of an article stays.  Blocks are trimmed, white
space in them is one space, and they are joined in page order by newlines.  Character references are decoded.

A class or id is only a hint, and only if each of its parts names such a thing or is a plain word of
layout: market-share and related-work are none.  One that tells a state (no-sidebar, has-header, comments-open) is none.
One that tells a layout (right-sidebar, sidebar-wrap) counts unless its element holds most of the
page's unlinked text, any other unless there also is an article, main or three paragraphs in it, and
one of comments, which may well be longer than the article, unless there also is a main or h1 in it.
Where nothing but hinted elements has text, no hint counts.

Winners are shared with all tasks only up to ``share_hosts`` hosts; beyond that they are joined by host.

Edge cases: null or empty html gives an empty text; a null url counts as a host of its own name '';
unclosed, crossed and cut-off tags are read as browsers do, roughly; any length is read whole;
repeated rows are extracted each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.session import small_batches

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=\s|/|$))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_ASIDES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsor sponsored "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar copyright skip".split()
)
_COMMENTS = set("comment comments disqus respond reply replies".split())
#: Parts of a class or id that neither make nor unmake a hint.
_PLAIN = set(
    "site page main top bottom inner outer box bar block list item items section area row col column module slot unit button buttons link links icon icons tools text title body group panel "
    "primary secondary global mobile desktop sticky fixed first last small large post article entry story blog user reader form policy message us posts articles stories content id class js".split()
)
_ARTICLE = {"article", "post", "entry", "story", "content"}
_CONTAINERS = {"article", "main", "div", "body", "center", "address", "details"}
_CONTENT = set("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote figcaption caption pre summary".split())
#: So many characters are content in any element.
CONTENT_CHARS = 60
#: Parts of a class or id beside which a hint tells a page's state, and a layout.
_STATES = {"no", "not", "non", "has", "have", "with", "without", "open", "opened", "closed", "enabled", "disabled"}
_LAYOUTS = {"left", "right", "both", "layout", "wrap", "wrapper", "container"}
_ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_DROPPED = set("nav header footer aside form script style noscript template iframe canvas button select option textarea input fieldset menu dialog audio video head title datalist".split())
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "html", "body"}
_ENDS_OWN = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_KEEP_BY_NAME = {"html", "body", "main", "article", "p", "h1", "h2", "h3"}


@lru_cache(1 << 16)
def hint_of(tag: str, name: str) -> str:
    """What a class or id says of its element: '', 'layout', 'aside' or 'comment'."""
    parts = [p for p in re.split(r"[-_\s]+", name) if p and not p.isdigit()]
    if parts and parts[0] == "elementor" and "widget" in parts:  # what that builder calls any element, the article's text too
        parts = [p for p in parts[1:] if p != "widget"]
    said = set(parts)
    if not _STATES.isdisjoint(said) or not said <= _ASIDES | _COMMENTS | _LAYOUTS | _PLAIN:
        return ""
    if not _COMMENTS.isdisjoint(said):
        return "" if tag in _KEEP_BY_NAME - {"article", "p"} else "comment"
    asides = said & _ASIDES
    if tag in _KEEP_BY_NAME or not asides or (asides == {"header"} and said & _ARTICLE):
        return ""
    return "layout" if said & _LAYOUTS else "aside"


class Page:
    """The elements of a page (parent, path, dropped) and its kept blocks of text in order."""

    def __init__(self, source: str):
        self.parent, self.path, self.tag, self.dropped = [-1], [""], ["#"], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, linked characters
        self._added: list[int] | None = None
        self._holds: list[bool] = []
        self.hint = [0]  # the innermost element with a hint, at or above each
        self._kinds: dict[int, str] = {}
        self._pieces: list[tuple[int, list[tuple[str, int, bool]]]] = []  # element, its pieces: text, hint, linked
        self._stack, self._text, self._links = [0], [], 0
        self._at: dict[str, list[int]] = defaultdict(list)  # where elements of each tag are in the stack
        self._read(source)
        self.blocks = self._kept(self._asides()) or (self._kept(set()) if self._kinds else [])

    def _flush(self) -> None:
        if self._text:
            self._pieces.append((self._stack[-1], self._text))
            self._text = []

    def _kept(self, asides: set[int]) -> list[tuple[int, str, int]]:
        """The blocks without the text of these hinted elements."""
        blocks = []
        for element, pieces in self._pieces:
            kept = [p for p in pieces if p[1] not in asides] if asides else pieces
            text = " ".join("".join([p[0] for p in kept]).split())
            if text:
                blocks.append((element, text, min(sum(len(p[0]) for p in kept if p[2]), len(text))))
        return blocks

    def _asides(self) -> set[int]:
        """Hinted elements that are left out, or are in one that is."""
        if not self._kinds:
            return set()
        unlinked, inside = dict.fromkeys((0, *self._kinds), 0), {h: defaultdict(int) for h in (0, *self._kinds)}
        for _, pieces in self._pieces:
            for text, h, linked in pieces:
                unlinked[h] += 0 if linked else len(text.strip())
        for e in range(1, len(self.tag)):
            if self.tag[e] in ("h1", "main", "article", "p") and not self.dropped[e]:
                inside[self.hint[self.parent[e]]][self.tag[e]] += 1
        for h in sorted(self._kinds, reverse=True):
            above = self.hint[self.parent[h]]
            if self._kinds[h] == "comment" and not (inside[h]["main"] or inside[h]["h1"]):
                continue  # long comments make no element the main one
            unlinked[above] += unlinked[h]
            for tag, n in inside[h].items():
                inside[above][tag] += n
        most, asides = unlinked[0] / 2, set()
        for h in sorted(self._kinds):
            has = inside[h]
            wraps = {"layout": True, "aside": has["article"] or has["main"] or has["p"] >= 3, "comment": has["main"] or has["h1"]}[self._kinds[h]]
            if self.hint[self.parent[h]] in asides or not (wraps and unlinked[h] > most):
                asides.add(h)
        return asides

    def _drop(self) -> None:
        tag = self.tag[self._stack.pop()]
        self._at[tag].pop()
        self._links -= tag == "a"

    def _pop(self, depth: int) -> None:
        """Close elements until ``depth`` are open."""
        if any(self.tag[e] in _BLOCK for e in self._stack[depth:]):
            while len(self._stack) > depth and self.tag[self._stack[-1]] not in _BLOCK:
                self._drop()
            self._flush()
        while len(self._stack) > depth:
            self._drop()

    def _innermost(self, tags: set[str]) -> int:
        """Where the innermost open element of these tags is in the stack, or 0."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._close_last({"p"}, {"table", "td", "th", "button", "object"})
        if tag in _ENDS_OWN:
            self._close_last(*_ENDS_OWN[tag])
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            if tag in ("br", "wbr", "hr", "img"):
                self._text.append((" " if tag != "wbr" else "", 0, False))
            return
        named = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        classes = named.get("class", "").split()
        own_header = tag == "header" and bool(self._at["article"] or self._at["main"])
        drop = self.dropped[self._stack[-1]] or (tag in _DROPPED and not own_header) or named.get("role") in _ASIDE_ROLES or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        kinds = {hint_of(tag, c) for c in (*classes, named.get("id", "")) if c} if named and not drop else ()
        step = tag + "".join("." + c for c in sorted({_DIGITS.sub("", c).strip("-_") for c in classes} - {""}))
        above = self.path[self._stack[-1]]
        self.parent.append(self._stack[-1])
        self.path.append(above if tag == "html" else f"{above}/{step}" if above else step)
        self.tag.append(tag)
        self.dropped.append(drop)
        self.hint.append(self.hint[self._stack[-1]])
        for kind in ("comment", "aside", "layout"):
            if kind in kinds:
                self._kinds[len(self.tag) - 1], self.hint[-1] = kind, len(self.tag) - 1
                break
        self._at[tag].append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._links += tag == "a"

    def _close_last(self, tags: set[str], within: set[str]) -> None:
        """Close the innermost open element of these tags that no element of ``within`` separates."""
        while (depth := self._innermost(tags)) > self._innermost(within):
            cell = self.tag[self._stack[depth]] != "tr" and "tr" in tags
            self._pop(depth)
            if not cell:  # a new row ends the last cell and then the last row
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            start = source.find("<", at)
            if start < 0:
                start = end
            if start > at and not self.dropped[self._stack[-1]]:
                piece = source[at:start]
                piece = html.unescape(piece) if "&" in piece else piece
                self._text.append((piece, self.hint[self._stack[-1]], self._links > 0))
            if start >= end:
                break
            m = _TAG.match(source, start) or _LOOSE_TAG.match(source, start)
            if not m:
                if not self.dropped[self._stack[-1]]:
                    self._text.append(("<", self.hint[self._stack[-1]], False))
                at = start + 1
                continue
            at = m.end()
            if not m.lastindex or not m[2]:
                continue
            tag = m[2].lower()
            if not m[1]:
                self._open(tag, m[3])
                if tag in _RAW and not (m[3] or "").endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\s*/?>?", re.I).search(source, at)
                    at = close.end() if close else end
                    self._pop(len(self._stack) - 1)
            elif tag == "br":
                self._text.append((" ", 0, False))
            elif tag not in ("html", "body"):
                if depth := self._innermost({tag}):
                    self._pop(depth)
        self._pop(1)
        self._flush()

    def scores(self) -> dict[int, float]:
        """Of each container: the unlinked text around which it stands."""
        found: dict[int, float] = defaultdict(float)
        for element, text, linked in self.blocks:
            weight, e = len(text) - linked, element
            if weight <= 0:
                continue
            for share in (1.0, 0.7, 0.4, 0.2):
                while e > 0 and self.tag[e] not in _CONTAINERS:
                    e = self.parent[e]
                if e <= 0:
                    break
                found[e] += share * weight * (0.5 if self.tag[e] == "body" else 1.0)
                e = self.parent[e]
        return found

    def _adding(self) -> list[int]:
        """Of each element how many of its children (its own text as one) hold content."""
        if self._added is None:
            self._added, self._holds = [0] * len(self.tag), [False] * len(self.tag)
            own = set()
            for element, text, linked in self.blocks:
                e = element
                while e > 0 and self.tag[e] not in _BLOCK:
                    e = self.parent[e]
                if 2 * linked > len(text) or not (self.tag[e] in _CONTENT or len(text) >= CONTENT_CHARS):
                    continue
                if e not in own:
                    own.add(e)
                    self._added[e] += 1
                while e > 0 and not self._holds[e]:
                    self._holds[e] = True
                    self._added[self.parent[e]] += 1
                    e = self.parent[e]
        return self._added

    def outer(self, e: int) -> int:
        """The article's outer element from a container on."""
        added, found, above = self._adding(), e, self.parent[e]
        while above > 0 and self.tag[above] != "body" and self.tag[e] not in ("article", "main", "body"):
            if added[above] - self._holds[e] > 0:
                found = above
            e, above = above, self.parent[above]
        return found

    def titles(self, root: int) -> set[int]:
        """Headings before an article without one: beside it or an element around it."""
        inside, ends = {root}, {root}
        for e in range(root + 1, len(self.tag)):  # elements are numbered in page order
            if self.parent[e] in inside:
                inside.add(e)
        if any(self.tag[e] in ("h1", "h2") and e in inside for e, _, _ in self.blocks):
            return set()
        while root > 0:
            root = self.parent[root]
            ends.add(root)
        return {e for e, _, _ in self.blocks if self.tag[e] in ("h1", "h2") and e < min(inside) and self.parent[e] in ends}

    def best(self) -> int | None:
        scores = self.scores()
        return min(scores, key=lambda e: (-scores[e], e)) if scores else None

    def votes(self) -> dict[str, float]:
        found: dict[str, float] = defaultdict(float)
        scores = self.scores()
        total = max(scores.values(), default=0)
        for e, s in scores.items():
            path = self.path[self.outer(e)]
            found[path] = max(found[path], s / total)
        return found

    def text(self, roots: set[int]) -> str:
        """Blocks of the outer elements of these, their titles, and what is below them."""
        roots = {self.outer(e) for e in roots if e > 0}
        roots |= self.titles(min(roots)) if roots else set()
        inside = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            inside[e] = e in roots or inside[self.parent[e]]
        return "\n".join(text for e, text, _ in self.blocks if inside[e])


def extract_page(source: str | None, winner: str | None) -> str:
    page = Page(source or "")
    text = page.text({e for e, p in enumerate(page.path) if p == winner}) if winner else ""
    if not text:
        best = page.best()
        text = page.text({best}) if best is not None else "\n".join(t for _, t, _ in page.blocks)
    return text


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) summed over pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple[str, str], float] = defaultdict(float)
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                for path, vote in Page(source.as_py() or "").votes().items():
                    total[host, path] += vote
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.float64())], names=["host", "path", "votes"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, votes double")
    return votes.groupBy("host", "path").agg(F.sum(F.round("votes", 6).cast("decimal(28,6)")).alias("votes"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, winner): the path with the most votes."""
    return votes.groupBy("host").agg(F.min(F.struct(-F.col("votes"), "path")).alias("best")).selectExpr("host", "best.path as winner")


def extract(pages: DataFrame, share_hosts: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    host = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    won = winning_paths(host_votes(own))
    some = won.limit(share_hosts + 1).collect()
    if len(some) <= share_hosts:
        shared, joined = spark.sparkContext.broadcast({r["host"]: r["winner"] for r in some}), own.withColumn("winner", F.lit(None).cast("string"))
    else:
        shared, joined = spark.sparkContext.broadcast({}), own.join(won, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, winners = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            texts = [extract_page(s.as_py(), w or shared.value.get(h)) for s, h, w in zip(batch.column(3), hosts, winners)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "html", "winner").mapInArrow(run, "page_id long, url string, text string, n_chars long")

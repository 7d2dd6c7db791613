"""Main text of web pages by equivalence classes of tokens across the pages of a host.

A token is a tag at its path (element names with class and id, digits aside, and for containers without either their place
among their like) or a run of text at its path. Over the pages of a host each token has an occurrence vector: how often each
page holds it. Tokens of equal vectors form an equivalence class; a class is valid if it has at least ``LEAST_TOKENS`` tokens
(an element counts as two) and occurs in ``LEAST_SHARE`` of the pages. Paths put the elements of valid classes inside
each other: the template of the host. Between its tokens lie the slots. The template is walked from the root into the
slot that holds the paragraphs and headings of the host's pages, past slots beside it that hold bare text and links, to an article
or main element at most; what fills it is the article. A page that has paragraphs outside that slot, or text in what holds it, is walked
by itself, as is one without a template: into a container only while all of the page's plain text is in it.
Page text inside menus, headers, footers, sidebars, notices, adverts, forms, comments and lists of links is no plain text. A
class, id or role says so, unless the container holds a main element, an article or most of the page's text. A run
of text that the template fixes is left out where neither its element nor one around it, up to the main container, is a paragraph;
this takes a host of ``FIXED_PAGES`` different pages, so such text may leave a page's result when its host grows.

Vectors are never built. Each token carries the exclusive or of a hash of (page, count) over its pages with its numbers of
pages and occurrences, which are equal for equal vectors and can be added up in any order, so a hot host is reduced before
the shuffle like any other. What is grouped by host afterwards are the tokens that a good share of its pages hold, a page's worth.

Edge cases: null html gives an empty text; a null url or one without host makes a group of its own; a page
without its host's main container is walked by itself, as is the page of a host of one; unclosed tags end with
what holds them; pages of equal id are extracted one by one; an empty table gives no rows. Columns other than
``page_id, url, html`` are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boletim.llm.common import runs, written

LEAST_TOKENS = 3
LEAST_SHARE = 0.3
#: A run of text is fixed by the template from this share of the pages, on hosts of this many different pages or more.
FIXED_SHARE = 0.8
FIXED_PAGES = 5
#: A slot of a template is taken if it holds this share of the paragraphs beside it, pages that differ aside, and this share of all plain text.
PARAGRAPH_SHARE = 0.9
SLOT_SHARE = 0.5
#: Share of linked characters that makes a list or container one of links.
LINK_SHARE = 0.6

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre address figure figcaption hr br th thead tfoot caption"
    " nav header footer aside form fieldset title head details summary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt".split())
#: A new one of the key ends an open one of the values.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
STOPS = {
    "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
    "option": {"select"},
}
ENDS_P = BLOCKS - {"br", "title", "head", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Elements whose text is never the article, and words of class, id or role that say the same.
OUTSIDE = frozenset(
    "head title nav header footer aside form script style noscript template iframe svg button select textarea object"
    " dialog menu label input".split()
)
HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion sidebar side aside cookie"
    " cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " comment comments reply replies discussion disqus respond share sharing social related recommended breadcrumb"
    " breadcrumbs menu nav navigation navbar topbar toolbar footer header masthead widget pagination pager tags login signup"
    " search skip toc copyright".split()
)

#: Words that hold whatever is below, and elements that an article or main element may stand in.
COMMENTS = frozenset("comment comments reply replies discussion disqus respond".split())
AROUND = frozenset("form header".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!svg\b[^>]*/>)(?P<raw>script|style|noscript|template|iframe|textarea|svg)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[/!?a-zA-Z][^>]*+>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")
_SIGN = (1 << 64) - 1


def _hash(label: str, parent: int) -> int:
    return xxhash.xxh3_64_intdigest(label, parent)


@dataclass
class Node:
    role: int
    parent: int
    name: str
    outside: bool
    linked: bool
    hint: int = 0
    chars: int = 0
    link_chars: int = 0
    plain: int = 0
    para: int = 0
    bare: int = 0
    seen: Counter = field(default_factory=Counter)


@dataclass(frozen=True)
class Slot:
    """What the elements of a role hold: parent role, plain characters and those of them in paragraphs or headings, and
    characters of bare text in no element but inline ones.

    Kind 2 is an element, 3 one that may be walked into, 4 one where the walk ends.
    """

    parent: int
    plain: int
    kind: int
    para: int
    bare: int

    def plus(self, other: Slot | None) -> Slot:
        """Both together; an element may be outside on some pages only."""
        if other is None:
            return self
        return Slot(
            self.parent, self.plain + other.plain, max(self.kind, other.kind), self.para + other.para, self.bare + other.bare
        )

    def less(self, plain: int) -> Slot:
        """Without fixed text of the template, whatever kind of element it stands in."""
        return Slot(self.parent, self.plain - plain, self.kind, self.para, max(self.bare - plain, 0))


@dataclass
class Run:
    node: int
    text: str
    role: int
    breaks: bool


class Page:
    """Elements of a page in order, each with its role and the characters below it, and its runs of text."""

    def __init__(self, source: str) -> None:
        self.nodes = [Node(0, -1, "#root", False, False)]
        self.runs: list[Run] = []
        self._parse(source)
        self._mark()
        for run in self.runs:
            node = self.nodes[run.node]
            if run.role and not node.outside and not node.linked:
                size, (holder, paragraph) = len(run.text) - run.text.count(" "), self.holder(run.node)
                if paragraph:
                    node.para += size
                else:
                    self.nodes[holder].bare += size
        for node in reversed(self.nodes[1:]):  # children stand after their parents
            above = self.nodes[node.parent]
            above.chars += node.chars
            above.link_chars += node.link_chars
            above.plain += node.plain
            above.para += node.para

    def _parse(self, source: str) -> None:
        nodes, stack, breaks = self.nodes, [0], True
        for token in _TOKEN.finditer(source):
            text, name = token["text"], token["name"]
            if text is not None:
                at, text = stack[-1], entities.unescape(text)
                node = nodes[at]
                size = len(text) - text.count(" ") if text.strip() else 0
                if size:
                    node.chars += size
                    if node.linked:
                        node.link_chars += size
                    else:
                        node.plain += size
                self.runs.append(Run(at, text, 0, breaks))
                breaks = False
                continue
            if not name:
                continue
            name = name.lower()
            if name in BLOCKS:
                breaks = True
            if token["close"]:
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].name == name:
                        del stack[i:]
                        break
                continue
            if name in VOID:
                continue
            self._imply_ends(stack, name)
            parent = nodes[stack[-1]]
            label, hint = self._label(name, token["rest"])
            if name in CONTAINERS and label == name:
                parent.seen[name] += 1
                label = f"{name}[{parent.seen[name]}]"
            nodes.append(
                Node(
                    _hash(label, parent.role), stack[-1], name, name in OUTSIDE, parent.linked or name == "a",
                    0 if name in ("html", "body", "article", "main") else hint,
                )
            )
            if not token["rest"].endswith("/"):
                stack.append(len(nodes) - 1)
        for run in self.runs:
            if run.text.strip():
                shape = _DIGITS.sub("0", " ".join(run.text.split()))
                run.role = _hash("#" + shape, nodes[run.node].role)

    def _mark(self) -> None:
        """Set what is outside, by elements and hints and what is below them; characters there are no plain ones."""
        nodes = self.nodes
        # Text and articles below each element, those in comments and elements that are always outside left out.
        shut = [False]
        for node in nodes[1:]:
            shut.append(shut[node.parent] or node.hint == 3 or (node.outside and node.name not in AROUND))
        text = [0 if s else node.plain for node, s in zip(nodes, shut, strict=True)]
        mains, articles = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            up, own = nodes[i].parent, not shut[i]
            mains[i] += own and nodes[i].name == "main"
            articles[i] += own and nodes[i].name == "article"
            text[up] += text[i]
            mains[up] += mains[i]
            articles[up] += articles[i]
        closed = [False]
        for i, node in enumerate(nodes[1:], 1):
            around = closed[node.parent]
            if node.name in ("article", "main") and not shut[i] and not around:
                node.outside = False
                closed.append(False)
                continue
            # A name of such words only, as of an advert longer than the article, gives way if the page has no article elsewhere.
            most = 2 * text[i] > text[0] and (node.hint == 1 or not (mains[0] or articles[0]))
            kept = mains[i] or most or (articles[i] and (node.hint == 1 or articles[i] == articles[0]))
            hinted = node.hint == 3 or (node.hint and not kept)
            # A form or header can be left for an article in it, a hinted container that is outside can't.
            closed.append(around or bool(hinted) or shut[i])
            node.outside = node.outside or bool(hinted) or nodes[node.parent].outside
        for node in nodes:
            if node.outside:
                node.plain = 0

    def _imply_ends(self, stack: list[int], name: str) -> None:
        nodes = self.nodes
        ends = ENDS.get(name, set()) | ({"p"} if name in ENDS_P else set())
        stops = STOPS.get(name, set()) | CONTAINERS - {"tr", "td", "th"} if ends else set()
        for i in range(len(stack) - 1, 0, -1):
            open_ = nodes[stack[i]].name
            if open_ in ends:
                del stack[i:]
                return
            if open_ in stops:
                return

    @staticmethod
    def _label(name: str, rest: str) -> tuple[str, int]:
        """Name with class and id, digits aside; whether these or the role hint at something beside the article.

        The hint is 0 for none, 1 for one word among others, 2 for a name of such words only, 3 for comments.
        """
        if "=" not in rest:
            return name, 0
        values = [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _NAMED.finditer(rest)]
        hint = 0
        for words in (_WORDS.findall(part) for _, v in values for part in v.split()):
            if words and not HINTS.isdisjoint(words):
                hint = max(hint, 1 if not HINTS.issuperset(words) else 2 if COMMENTS.isdisjoint(words) else 3)
        marks = [f"{k}={_DIGITS.sub('0', v)}" for k, v in values if k != "role" and v]
        return " ".join([name, *marks]), hint

    def elements(self) -> dict[int, Slot]:
        """The slot of each role of the page and the root."""
        root = self.nodes[0]
        out = {0: Slot(0, root.plain, 2, root.para, root.bare)}
        for node in self.nodes[1:]:
            kind = 2 if node.outside or node.name not in CONTAINERS else 4 if node.name in ("article", "main") else 3
            out[node.role] = Slot(self.nodes[node.parent].role, node.plain, kind, node.para, node.bare).plus(out.get(node.role))
        return out

    def holder(self, at: int) -> tuple[int, bool]:
        """The paragraph or container around an element's text, and whether it is a paragraph."""
        while at and self.nodes[at].name not in PARAGRAPHS and self.nodes[at].name not in CONTAINERS:
            at = self.nodes[at].parent
        return at, self.nodes[at].name in PARAGRAPHS

    def stays_outside(self, main: int, fixed: frozenset[int]) -> bool:
        """Whether the page has paragraphs beside the elements of a role, or text of its own in what holds them."""
        nodes = self.nodes
        inside, above = [False], set()
        for i, node in enumerate(nodes[1:], 1):
            inside.append(inside[node.parent] or node.role == main)
            if node.role == main:
                above.add(node.parent)
        for i in range(len(nodes) - 1, 0, -1):
            if i in above:
                above.add(nodes[i].parent)
        for run in self.runs:
            node = nodes[run.node]
            if inside[run.node] or node.outside or node.linked or run.role in fixed or not run.text.strip():
                continue
            holder, paragraph = self.holder(run.node)
            if paragraph or holder in above:
                return True
        return False

    def texts(self) -> dict[int, tuple[int, int, int]]:
        """Role of the element, plain characters and number of each run of text; a heading's are never the template's."""
        out: dict[int, tuple[int, int, int]] = {}
        for run in self.runs:
            if run.role:
                node = self.nodes[run.node]
                plain = 0 if node.outside or node.linked or self.headed(run.node) else len(run.text) - run.text.count(" ")
                _, before, n = out.get(run.role, (0, 0, 0))
                out[run.role] = (node.role, before + plain, n + 1)
        return out

    def headed(self, at: int) -> bool:
        """Whether an element is or lies in a heading."""
        while at > 0 and self.nodes[at].name not in HEADINGS:
            at = self.nodes[at].parent
        return at > 0

    def text(self, main: int | None, fixed: frozenset[int] = frozenset()) -> str:
        """Text of the elements of role ``main``; of the page's own main container if it has none."""
        nodes = self.nodes
        if not any(node.role == main for node in nodes[1:]) or self.stays_outside(main, fixed):
            main = walk(self.elements())
        inside, drop, paragraph = [main == 0], [False], [False]
        for node in nodes[1:]:
            inside.append(inside[node.parent] or node.role == main)
            paragraph.append(node.name in PARAGRAPHS or (inside[node.parent] and paragraph[node.parent]))
            listing = (
                node.name in ("ul", "ol", "div", "section", "table")
                and node.role != main
                and node.chars > 0
                and node.link_chars >= LINK_SHARE * node.chars
            )
            drop.append(inside[node.parent] and (drop[node.parent] or listing))
        out: list[str] = []
        broken = True
        for run in self.runs:
            broken |= run.breaks
            node = nodes[run.node]
            if not inside[run.node] or drop[run.node] or node.outside:
                broken = True
                continue
            if run.role in fixed and not paragraph[run.node]:
                continue
            out.append(" " + run.text if broken else run.text)
            broken = False
        return " ".join("".join(out).split())


def walk(elements: dict[int, Slot], template: bool = False) -> int:
    """Role of the container that holds the article, from the root down; 0 is the root.

    A page by itself goes on into a container only if all plain text is in it. The slots of a ``template`` say more: of
    the slots beside each other one may hold the paragraphs of all pages, the others bare text and links. It is taken, and they are
    left, unless what holds them has text of its own.
    """
    below: dict[int, list[int]] = {}
    for role, slot in elements.items():
        if role and slot.kind > 2:
            below.setdefault(slot.parent, []).append(role)
    at = 0
    while at in below and elements[at].kind < 4:
        here = elements[at]
        best = max(below[at], key=lambda role: (elements[role].para, elements[role].plain, -role))
        slot = elements[best]
        beside = template and not here.bare and slot.para and slot.para >= PARAGRAPH_SHARE * here.para
        if not beside:
            best = max(below[at], key=lambda role: (elements[role].plain, -role))
            if not elements[best].plain or elements[best].plain < here.plain:
                break
        elif slot.plain < SLOT_SHARE * here.plain:
            break
        at = best
    return at


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_TOKENS = "host string, role long, parent long, kind int, vector long, pages long, total long, plain long, para long, bare long"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def occurrences(pages: DataFrame) -> DataFrame:
    """``host, role, parent, kind, vector, pages, total, plain, para, bare``: each token of each host with its vector's digest.

    Kind 0 is the page itself, 1 a text, 2 an element, 3 an element that may be walked into, 4 one where the walk ends. ``pages`` has ``host, html``.
    """

    def tokens(batches):
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            hosts, ids, sources = (batch.column(c).to_pylist() for c in ("host", "number", "html"))
            for host, number, source in zip(hosts, ids, sources, strict=True):
                page = Page(source or "")
                counts = Counter(node.role for node in page.nodes)
                elements = page.elements()
                mark = _hash(str(number), 1)
                rows = [
                    (role, slot.parent, slot.kind if role else 0, n, (slot.plain, slot.para, slot.bare))
                    for role, n in counts.items()
                    for slot in [elements[role]]
                ]
                rows += [(role, parent, 1, n, (plain, 0, 0)) for role, (parent, plain, n) in page.texts().items()]
                for role, parent, kind, n, sizes in rows:
                    digest = (mark ^ n * 0x9E3779B97F4A7C15) & _SIGN
                    held = found.setdefault((host, role, kind), [parent, 0, 0, 0, 0, 0, 0])
                    held[1] ^= digest * 0xC2B2AE3D27D4EB4F & _SIGN
                    held[2] += 1
                    held[3] += n
                    for place, size in enumerate(sizes, 4):
                        held[place] += size
            keys = list(found)
            values = np.array([[_signed(v[0]), _signed(v[1]), *v[2:]] for v in found.values()], np.int64).reshape(-1, 7)
            yield pa.record_batch(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()),
                 pa.array(values[:, 0]), pa.array([k[2] for k in keys], pa.int32()),
                 *[pa.array(values[:, i]) for i in range(1, 7)]],
                ["host", "role", "parent", "kind", "vector", "pages", "total", "plain", "para", "bare"],
            )

    found = pages.select("host", "number", "html").mapInArrow(tokens, _TOKENS)
    return found.groupBy("host", "role", "kind").agg(
        F.min("parent").alias("parent"), F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"),
        *[F.sum(name).alias(name) for name in ("total", "plain", "para", "bare")],
    )


def deduce(tokens: DataFrame, different: DataFrame) -> DataFrame:
    """``host, main, fixed``: the main container and the fixed texts of each host's template."""
    hosts = tokens.filter("kind = 0").select("host", F.col("pages").alias("all"), F.struct("plain", "para", "bare").alias("whole")).join(different, "host")
    common = tokens.filter("kind > 0").join(hosts, "host").filter(F.col("pages") >= LEAST_SHARE * F.col("all"))
    common = written(common, "tokens")
    vector = ["host", "vector", "pages", "total"]
    classes = common.groupBy(*vector).agg(F.sum(F.when(F.col("kind") == 1, 1).otherwise(2)).alias("size"))
    valid = common.join(classes.filter(F.col("size") >= LEAST_TOKENS), vector)
    rows = valid.select("host", "role", "parent", "kind", "pages", "all", "whole", "different", "plain", "para", "bare")
    rows = rows.repartition("host").sortWithinPartitions("host")

    def nested(batches):
        for (host,), rows in runs(batches, ("host",)):
            whole = rows["whole"][0]
            elements, fixed, own = {0: Slot(0, whole["plain"], 2, whole["para"], whole["bare"])}, [], []
            names = ("role", "parent", "kind", "pages", "all", "different", "plain", "para", "bare")
            for role, parent, kind, n, every, different, plain, para, bare in zip(*(rows[c] for c in names), strict=True):
                if kind == 1:
                    if different >= FIXED_PAGES and n >= FIXED_SHARE * every:
                        fixed.append(role)
                        own.append((parent, plain))
                else:  # an element may be outside on some pages only
                    elements[role] = Slot(parent, plain, kind, para, bare).plus(elements.get(role))
            for at, plain in own:  # the template's own text is no reason to stay
                above = []
                while at in elements and at:
                    above.append(at)
                    at = elements[at].parent
                for role in [*above, 0] if not at else []:
                    elements[role] = elements[role].less(plain)
            yield pa.record_batch(
                [pa.array([host]), pa.array([walk(elements, template=True)], pa.int64()), pa.array([fixed], pa.list_(pa.int64()))],
                ["host", "main", "fixed"],
            )

    return written(rows.mapInArrow(nested, "host string, main long, fixed array<long>"), "templates")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    # A host that isn't there is the page's own; the id keeps such pages apart.
    host = F.coalesce(F.lower(F.nullif(F.regexp_extract("url", _HOST, 1), F.lit(""))), F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    numbered = rows.withColumn("number", F.monotonically_increasing_id())
    tokens = written(occurrences(numbered), "occurrences")
    different = rows.groupBy("host").agg(F.approx_count_distinct(F.xxhash64(F.regexp_replace(F.col("html"), r"\d+", "0"))).alias("different"))
    templates = deduce(tokens, different)
    # Spark broadcasts the templates if their files are small and shuffles otherwise.
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "main", "fixed")

    def texts(batches):
        for batch in batches:
            out = []
            for source, main, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "main", "fixed")), strict=True):
                own = None if main is None else main & _SIGN
                out.append(Page(source).text(own, frozenset(f & _SIGN for f in fixed or ())) if source else "")
            yield pa.record_batch(
                [batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(texts, "page_id long, url string, text string, n_chars long")

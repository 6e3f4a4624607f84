"""HTML extraction by consensus host paths.

Pass one scores each page's containers: the characters of paragraph-like blocks, less those in links, count
for the container that holds them and half for the one around it. From the best container the choice moves up to an
ancestor while that holds at least SHARE as much text again outside of it, so that a text in several containers is one;
it leaves <main> never, and <article> only for other articles. The choice casts its page's vote for its path, tags and
classes from the root with digits generalised, in its host's count; a path is known by a 64-bit key. The host's winner is
the path with most votes. Pass two re-extracts every page: the elements on the winning path, in page order, together with
the page's own choice where that holds at least SHARE as much text again beside them (and LEAST characters), as on a
host of mixed templates; a page without text on the winning path gives its own choice, one without any container its whole body.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out,
by tag or by class, id and role words: a class, id or role says so if it consists of such words and layout words
(site-header, comments-area); a class or role also if it starts with one (nav-7up), unless a word of state follows
(header-fixed). Ids of headings say nothing, and an element that holds <main>, the page's only articles or nearly
all of its text is a wrapper, whatever its words. Only attributes of just these names count. Character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space.

Winners that differ from the overall one travel with the tasks while they are at most BROADCAST_HOSTS of at most
BROADCAST_BYTES in all; beyond that pages are joined with their host's winner, hot hosts apart.

Time and memory of a page grow with its length, however its tags are nested.

Edge cases: a null url counts as host ""; null or empty html gives an empty text; unclosed tags and cut-off
pages are closed at their end; ties in a vote go to the path of the smallest key; pages that repeat are extracted (and
vote) one by one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import join_groups, materialise, released, rows_out
from tessera.llm.url_filters import host_and_path

BROADCAST_HOSTS, BROADCAST_BYTES = 50_000, 4 << 20
#: Text outside the choice, as a share of its own, for which it moves up; a page's own choice beside the host's path counts from LEAST characters.
SHARE, LEAST = 0.3, 25
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)", re.S)
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "xmp", "iframe")}
#: Name and value of one attribute after the other; quotes count right behind the equals sign only.
ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav header footer aside form script style noscript iframe template button select textarea input svg object canvas head title dialog menu option".split())
SKIPPED_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising banner promo sponsored sponsor cookie cookies consent notice notices popup modal newsletter subscribe comment comments commentlist respond disqus breadcrumb breadcrumbs share sharing social related pagination toolbar widget complementary contentinfo search".split())
#: Of these, what never wraps a page for its bulk alone.
PASSING_WORDS = frozenset("ad ads advert adverts advertisement advertising promo sponsored sponsor cookie cookies consent notice notices popup modal newsletter subscribe comment comments commentlist respond disqus".split())
#: Words that say where or how large a part is.
LAYOUT_WORDS = frozenset("site page main top bottom left right center primary secondary upper lower inner outer global local mobile desktop sticky wp block blocks item items list area section box bar wrapper wrap container content body row col column group panel slot unit inline link links button buttons form title post posts entry article articles blog story user reader author footer header".split())
STATE_WORDS = frozenset("no not non without with has have is show hide hidden visible open closed free less fixed on off enabled disabled accepted active layout".split())
NEVER_SKIPPED = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that stand for a paragraph; others are containers.
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption summary address center".split())
#: A start tag of the key closes an open element of the value, up to the nearest list, table or section.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
FENCES = frozenset("ul ol dl table tbody thead article section main div body html".split())
WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")


def path_key(path: str) -> int:
    """Key of a path such as "/body/div.main"."""
    key = 0
    for step in path.split("/")[1:]:
        key = step_key(key, step)
    return key


def step_key(key: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True) + step.encode("utf-8", "replace")) - 2**63


class Element:
    __slots__ = ("tag", "key", "skip", "said", "parent", "linked", "score", "serial", "container", "marked")

    def __init__(self, tag: str, step: str, skip: bool, said: set[str], parent: Element | None, serial: int):
        self.tag, self.skip, self.said, self.parent, self.serial = tag, skip, said, parent, serial
        self.key = step_key(parent.key, step) if parent is not None else 0
        self.linked = tag == "a" or parent is not None and parent.linked
        self.container = self if parent is None or tag in BLOCKS and tag not in PARAGRAPHS else parent.container
        self.marked = tag in ("main", "article") or parent is not None and parent.marked
        self.score = 0.0


class Stack(list):
    """Open elements, and where in it each tag, each block and each container stands."""

    def __init__(self, root: Element):
        super().__init__([root])
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.containers: list[int] = []

    def open(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self))
        if element.tag in BLOCKS:
            self.blocks.append(len(self))
            if element.tag not in PARAGRAPHS:
                self.containers.append(len(self))
        self.append(element)

    def close(self, at: int) -> None:
        """Close the element at this place and all within."""
        while len(self) > at:
            tag = self.pop().tag
            self.places[tag].pop()
            for places in (self.blocks, self.containers):
                if places and places[-1] == len(self):
                    places.pop()

    def last(self, tags: frozenset[str] | set[str] | tuple[str, ...]) -> int:
        """Place of the innermost open element of these tags; 0 without one."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def skipped_words(token: str, slug: bool) -> set[str]:
    """Words for which an element of this class, role or (slug) id is left out."""
    parts = WORD.findall(token)
    found = SKIPPED_WORDS.intersection(parts)
    if not found:
        return set()
    if all(w in found or w in LAYOUT_WORDS or len(w) == 1 for w in parts):
        return found
    return {parts[0]} if not slug and parts[0] in found and not STATE_WORDS.intersection(parts) else set()


def _attributes(tag: str, raw: str) -> tuple[str, set[str]]:
    """Generalised classes, and the words of class, id and role for which the element is left out."""
    classes, said = "", set()
    for name, *values in ATTRIBUTE.findall(raw):
        value, name = "".join(values), name.lower()
        if name not in ("class", "id", "role"):
            continue
        if name != "id" or tag not in HEADINGS:
            for token in value.lower().split():
                said |= skipped_words(token, name == "id")
        if name == "class" and not classes:
            classes = "".join("." + DIGITS.sub("#", c).replace("/", "|") for c in sorted(set(value.lower().split())))
    return classes, said


def keep_wrappers(events: list[tuple[Element, str]], elements: list[Element]) -> None:
    """Elements that are left out for their words but wrap the page's text are kept after all.

    What an element holds is summed once, from the inside out; then wrappers are judged level by level, each once, as
    keeping one lays open those within.
    """
    left_out = [e for e in elements if e.skip and (e.said and not e.said & PASSING_WORDS and e.tag not in SKIPPED or e.tag in ("main", "article"))]
    if not left_out:  # nothing that could wrap the text
        return
    n = len(elements) + 1
    own = [0] * n
    for element, text in events:
        if not element.linked and text != "\x00":
            own[element.serial] += len("".join(text.split()))
    text, main, article, within = own[:], [False] * n, [False] * n, [False] * n
    children: list[list[Element]] = [[] for _ in range(n)]
    for e in elements:  # parents come first
        within[e.serial] = within[e.parent.serial] or e.parent.tag in SKIPPED
        children[e.parent.serial].append(e)
    for e in reversed(elements):
        k, up, passing = e.serial, e.parent.serial, bool(e.said & PASSING_WORDS)
        if e.tag not in SKIPPED and not passing:
            text[up] += text[k]
        main[up] |= main[k] or e.tag == "main" and not within[k]
        article[up] |= article[k] and not passing or e.tag == "article" and not e.said and not within[k]
    outer, articles = own[0], 0
    top, shown = [], [e for e in elements if e.parent.serial == 0]
    while shown:
        while shown:
            e = shown.pop()
            e.skip = e.tag in SKIPPED or bool(e.said) and e.tag not in NEVER_SKIPPED
            if not e.skip:
                outer += own[e.serial]
                articles += own[e.serial] * e.marked
                shown += children[e.serial]
            elif e.tag not in SKIPPED:
                top.append(e)
        for e in top:
            k, passing = e.serial, bool(e.said & PASSING_WORDS)
            inner = text[k] if main[k] or article[k] or not passing else 0
            if main[k] or inner and not articles and (article[k] and inner > outer or not passing and inner >= 9 * outer):
                e.said = set()
                shown.append(e)
        top = []


def parse(page: str) -> tuple[list[tuple[Element, str]], list[Element]]:
    """(innermost element, text) in page order, where a block's border is (element, "\\x00"); all elements."""
    stack = Stack(Element("", "", False, set(), None, 0))
    events: list[tuple[Element, str]] = []
    elements: list[Element] = []
    at = serial = 0
    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            events.append((stack[-1], entities.unescape(text)))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                events.append((stack[-1], m[0][9:].removesuffix("]]>")))
            continue
        if tag in BLOCKS:
            events.append((stack[-1], "\x00"))
        if m[1]:
            k = stack.last((tag,))
            if k and (tag in BLOCKS or not stack.containers or k > stack.containers[-1]):  # a stray inline end tag closes no container
                stack.close(k)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and stack.blocks and stack[stack.blocks[-1]].tag == "p":  # a paragraph ends where a block starts
            stack.close(stack.blocks[-1])
        if tag in CLOSES and (k := stack.last(CLOSES[tag])) > stack.last(FENCES):
            stack.close(k)
        parent = stack[-1]
        classes, said = _attributes(tag, m[3]) if m[3] else ("", set())
        skip = parent.skip or tag in SKIPPED or bool(said) and tag not in NEVER_SKIPPED
        serial += 1
        element = Element(tag, tag + classes, skip, said, parent, serial)
        elements.append(element)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.start() if end else len(page)
        if not (m[3] or "").endswith("/") or tag in BLOCKS:
            stack.open(element)
    keep_wrappers(events, elements)
    return events, elements


def choice(events: list[tuple[Element, str]], elements: list[Element]) -> int | None:
    """Path key of the container with the highest score (of equal ones the first), or of the ancestor that it moves up to."""
    best: dict[int, Element] = {}
    inside = [0] * (len(elements) + 1)  # unlinked text of each element, and of that what stands in articles
    marked = [0] * (len(elements) + 1)
    for element, text in events:
        n = 0 if element.skip or element.linked or text == "\x00" else len(text) - text.count(" ")
        if not n:
            continue
        inside[element.serial] += n
        marked[element.serial] += n * element.marked
        container = element.container
        if container.tag:
            container.score += n
            best[container.serial] = container
            around = container.parent
            if around is not None and around.tag:
                around.score += n / 2
                best[around.serial] = around
    if not best:
        return None
    for e in reversed(elements):  # children come last
        inside[e.parent.serial] += inside[e.serial]
        marked[e.parent.serial] += marked[e.serial]
    found = upper = max(best.values(), key=lambda e: (e.score, -e.serial))
    while found.tag != "main" and (upper := upper.parent) is not None and upper.tag:
        held = marked if found.marked else inside
        if held[upper.serial] - held[found.serial] >= SHARE * held[found.serial]:
            found = upper
        if upper.tag == "main":
            break
    return found.key


def best_container(page: str) -> int | None:
    return choice(*parse(page))


def extract(page: str | None, path: str | int | None) -> str:
    """Main text: the elements on the path (or of its key), and the page's own choice where that adds enough; without either, the body."""
    if not page:
        return ""
    events, elements = parse(page)
    own = choice(events, elements)

    def known(key: int | None) -> list[bool]:
        out = [key is None] * (len(elements) + 1)
        for e in elements if key is not None else ():
            out[e.serial] = out[e.parent.serial] or e.key == key
        return out

    inside = known(own)
    path = path_key(path) if isinstance(path, str) else path
    if path is not None and path != own:
        found, held, more = known(path), 0, 0
        for element, piece in events:
            if not element.skip and piece != "\x00":
                n = 0 if piece.isspace() else len(piece) - piece.count(" ")
                held += n * found[element.serial]
                more += n * (own is not None and inside[element.serial] and not found[element.serial] and not element.linked)
        if held:
            inside = [a or b for a, b in zip(inside, found)] if more >= max(LEAST, SHARE * held) else found
    pieces = [piece for element, piece in events if not element.skip and inside[element.serial]]
    return " ".join(w for block in "".join(pieces).split("\x00") for w in block.split())


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.coalesce(host_and_path(F.col(url_col))[0], F.lit("")).alias("host"))

    @released
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [best_container(page.as_py() or "") for page in batch.column("html")]
            yield rows_out({"host": (batch.column("host").to_pylist(), pa.string()), "path": (paths, pa.int64())})

    ballots = rows.select("host", "html").mapInArrow(vote, "host string, path long").groupBy("host", "path").agg(F.count("*").alias("votes"))
    ballots = materialise(ballots)
    winners = ballots.where("path IS NOT NULL").groupBy("host").agg(F.max("votes").alias("votes"))
    winners = ballots.where("path IS NOT NULL").join(winners, ["host", "votes"]).groupBy("host").agg(F.min("path").alias("path"))
    sizes = ballots.groupBy("host").agg(F.sum("votes").alias("pages"))
    winners = materialise(winners.join(sizes, "host"))
    overall = winners.groupBy("path").agg(F.sum("pages").alias("n")).orderBy(F.desc("n"), "path").first()
    common = overall["path"] if overall else None
    unlike = winners.where(F.col("path") != F.lit(common))
    n, size = unlike.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host")), F.lit(0))).first()
    exceptions = {}
    if n <= BROADCAST_HOSTS and size <= BROADCAST_BYTES:
        exceptions = {r["host"]: r["path"] for r in unlike.select("host", "path").collect()}
        placed = rows.withColumn("path", F.lit(None).cast("long"))
    else:
        placed = join_groups(rows, winners, "host", "pages", F.col("id").cast("string"))

    @released
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = batch.column("id"), batch.column("url"), []
            for page, host, path in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                texts.append(extract(page.as_py(), exceptions.get(host, common) if path is None else path))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), n], ["id", "url", "text", "n_chars"])

    kind = rows.schema["id"].dataType.simpleString()
    out = placed.select("id", "url", "host", "path", "html").mapInArrow(take, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})

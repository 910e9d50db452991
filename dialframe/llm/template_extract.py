"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template.  A page is a sequence of tag tokens, told
apart by their path of open elements.  Tokens that occur equally often on each
page of the host (the same occurrence vector) form an equivalence class; vectors
are compared by a sum of per-page hashes, so that they are built from partial
sums and no host's pages ever meet in one task.  Classes whose tokens keep one
order, and that lie in one gap of a larger class, nest into the host's template.

What lies between two template tokens is a slot.  A link slot whose block is
mostly links over the host's pages is a menu and goes, inside the article too;
a link in a sentence is part of a block of words and stays.  After that slots
inside menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments are left out by their tags, as is what lies outside the
article; the text of the remaining ones is the page's main text.  No text is
dropped for being repeated, so equal articles on one host all stay.

A page whose host has fewer than :data:`MIN_PAGES` pages, or that breaks the
template's order, is cut by its own tags under the same rules.

Defined results: null html is empty and gives empty text; a null URL belongs to
the empty host; repeated rows are extracted each; malformed or cut markup is
read as far as it goes, an unfinished tag at the end is markup; extra columns
are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialframe.llm.common import map_batches, materialize, pick, slices

MIN_PAGES = 3
#: Share of a host's pages that must hold a token for it to be of the template.
SUPPORT = 0.3
MIN_CLASS = 2
LINK_SHARE = 0.5
#: Tasks that a host's pages are dealt to when they meet its template.
SALTS = 16

PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp".split())
#: Elements that end a block of text; others are inside one.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
                  "menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is no main text.
LEFT_OUT = frozenset("head title nav menu header footer aside form script style noscript template iframe object "
                     "embed svg canvas button select option textarea input label fieldset dialog audio video "
                     "xmp".split())
#: Words of class, id, role or aria-label that mark such content on any element.
LEFT_OUT_WORDS = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment "
                           "comments cookie cookies consent disqus footer form header menu menubar modal nav "
                           "navbar navigation newsletter notice notices notification pager pagination popup promo "
                           "promotion related replies reply respond search share sharing sidebar social sponsor "
                           "sponsored subscribe toolbar widget alert complementary contentinfo".split())
ARTICLE = frozenset(("article", "main"))
#: Closed by the start of a sibling or of a block.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _words(attributes: str) -> list[str]:
    found = []
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "aria-label"):
            found += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return found


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, path, text): "open" and "close" of an element, and its "text" pieces, with the path of open elements.

    A path step is ``name`` or ``name.word.word`` (words of class, id and role).
    """
    stack: list[tuple[str, str]] = []  # element, path up to it
    at, n = 0, len(page)
    while at < n:
        m = PIECE.search(page, at)
        start = m.start() if m else n
        if start > at:
            yield "text", stack[-1][1] if stack else "", page[at:start]
        if m is None:
            return
        at = m.end()
        if m[2] is None:
            continue  # comment, declaration
        name = m[2].lower()
        if m[1]:
            if any(e == name for e, _ in stack):
                while True:
                    e, path = stack.pop()
                    yield "close", path, ""
                    if e == name:
                        break
            continue
        closes = _CLOSES.get(name, ())
        if name in BLOCK and any(e == "p" for e, _ in stack):
            closes = ("p",)
        while closes and stack:
            # What a sibling closes lies above the nearest container.
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] in closes), -1)
            if depth < 0 or any(e in ("ul", "ol", "dl", "table", "select", "div", "article", "section")
                                for e, _ in stack[depth + 1:]):
                break
            while len(stack) > depth:
                yield "close", stack.pop()[1], ""
        step = ".".join([name, *sorted(set(_words(m[3])))])
        path = f"{stack[-1][1]}/{step}" if stack else step
        yield "open", path, ""
        if name in VOID or m[3].endswith("/"):
            yield "close", path, ""
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            yield "text", path, page[at:end.start() if end else n]
            yield "close", path, ""
            at = end.end() if end else n
        else:
            stack.append((name, path))


def token(kind: str, path: str) -> str:
    return path if kind == "open" else "/" + path


def left_out(path: str) -> bool:
    """Whether an element on the path holds no main text; the page's own frame elements have no say."""
    for step in path.split("/"):
        name, *words = step.split(".")
        if name in LEFT_OUT or (name not in ("html", "body", "article", "main")
                                and not LEFT_OUT_WORDS.isdisjoint(words)):
            return True
    return False


def in_article(path: str) -> bool:
    return any(step.split(".")[0] in ARTICLE for step in path.split("/"))


def _in_link(path: str) -> bool:
    return any(step.split(".")[0] == "a" for step in path.split("/"))


def _block(path: str) -> str:
    """The path up to its last element that is a block."""
    while path and path.rpartition("/")[2].split(".")[0] not in BLOCK:
        path = path.rpartition("/")[0]
    return path


def _slot_block(t: str) -> str:
    """The block that the text behind a token lies in."""
    return _block(t[1:].rpartition("/")[0] if t.startswith("/") else t)


def menu_slots(tokens: list[dict]) -> list[str]:
    """Tokens whose slots are mostly links, in blocks that are mostly links over all pages of the host.

    A heading that links to its own article is no menu.
    """
    links, chars = Counter(), Counter()
    for t in tokens:
        block = _slot_block(t["token"])
        links[block] += t["links"]
        chars[block] += t["chars"]
    menus = {b for b in chars if links[b] >= LINK_SHARE * chars[b]
             and not re.fullmatch("h[1-6]", b.rpartition("/")[2].split(".")[0])}
    return sorted(t["token"] for t in tokens if t["chars"] and t["links"] >= LINK_SHARE * t["chars"]
                  and _slot_block(t["token"]) in menus)


def _number(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.crc32(data[::-1] + b"~")


_TOKENS = ("host string, token string, pages long, vector decimal(38,0), place double, links long, chars long")


def _page_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token, summed over a batch: pages, occurrence vector, mean place, and the slot's characters."""
    for b in slices(batches, "html"):
        table: dict[tuple[str, str], list] = {}
        for page_id, url, host, page in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "host", "html"))):
            page = page or ""
            counts, first, links, chars = Counter({"": 1}), {"": -1}, Counter(), Counter()
            last = ""
            for i, (kind, path, text) in enumerate(events(page)):
                if kind == "text":
                    size = len(text.strip())
                    chars[last] += size
                    if _in_link(path):
                        links[last] += size
                else:
                    last = token(kind, path)
                    counts[last] += 1
                    first.setdefault(last, i)
            size = max(1, len(first))
            mark = _number(f"{page_id}|{url}|{zlib.crc32(page.encode('utf-8', 'surrogatepass'))}")
            for t, n in counts.items():
                row = table.setdefault((host, t), [0, 0, 0.0, 0, 0])
                row[0] += 1
                row[1] += (mark * (2 * n + 1) + n * 0x9E3779B97F4A7C15) % ((1 << 61) - 1)
                row[2] += first[t] / size
                row[3] += links[t]
                row[4] += chars[t]
        keys = list(table)
        rows = list(zip(*table.values())) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array(rows[0], pa.int64()), pa.array([_decimal(v) for v in rows[1]], pa.decimal128(38, 0)),
             pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())],
            names=[x.strip().split(" ")[0] for x in re.sub(r"\(.*?\)", "", _TOKENS).split(",")])


def _decimal(value: int):
    import decimal
    return decimal.Decimal(value)


def nest(tokens: list[dict], pages: int) -> list[list[str]]:
    """The template of a host: its valid classes, outermost first, each in page order.

    ``tokens`` has token, pages, vector, place.  A class is valid if it has
    :data:`MIN_CLASS` tokens and all of them lie in one gap of every larger class.
    """
    classes: dict[tuple, list[dict]] = {}
    for t in tokens:
        if t["token"] and t["pages"] >= max(2, SUPPORT * pages):
            classes.setdefault((t["pages"], t["vector"]), []).append(t)
    template: list[list[dict]] = []
    for (n, _), members in sorted(classes.items(), key=lambda c: (-c[0][0], -len(c[1]), c[1][0]["token"])):
        members.sort(key=lambda t: (t["place"] / t["pages"], t["token"]))
        if len(members) < MIN_CLASS:
            continue
        gaps_ok = True
        for outer in template:
            places = [t["place"] / t["pages"] for t in outer]
            gaps = {int(np.searchsorted(places, t["place"] / t["pages"])) for t in members}
            gaps_ok &= len(gaps) == 1 or len(outer) < len(members)
        if gaps_ok or n == pages:
            template.append(members)
    return [[t["token"] for t in c] for c in template]


def templates(pages: DataFrame) -> DataFrame:
    """host, classes (token lists), menus (tokens that open slots of links) of hosts with enough pages."""
    found = map_batches(pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html"), _page_tokens,
                        _TOKENS)
    tokens = materialize(found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("vector").alias("vector"), F.sum("place").alias("place"),
        F.sum("links").alias("links"), F.sum("chars").alias("chars")), "page-tokens")
    sizes = tokens.where("token = ''").select("host", F.col("pages").alias("n")).where(F.col("n") >= MIN_PAGES)
    # Only tokens with support: at most 1 / SUPPORT times a page's tokens per host.
    held = (tokens.join(sizes, "host").where(F.col("pages") >= SUPPORT * F.col("n"))
            .groupBy("host", "n").agg(F.collect_list(F.struct(
                "token", "pages", F.col("vector").cast("string").alias("vector"), "place", "links", "chars")
            ).alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, menus = [], []
            for n, rows in zip(b.column("n").to_pylist(), b.column("tokens").to_pylist()):
                classes.append(nest(rows, n))
                menus.append(menu_slots(rows))
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), pa.array(classes, pa.list_(pa.list_(pa.string()))),
                 pa.array(menus, pa.list_(pa.string()))], names=["host", "classes", "menus"])
    return map_batches(held, run, "host string, classes array<array<string>>, menus array<string>")


def _fits(seen: list[str], cls: list[str]) -> bool:
    """Whether the class's tokens first occur on the page in the template's order."""
    first: dict[str, int] = {}
    for i, t in enumerate(seen):
        first.setdefault(t, i)
    at = [first[t] for t in cls if t in first]
    return at == sorted(at)


def main_text(page: str | None, classes: list[list[str]] | None = None, menus: list[str] | None = None) -> str:
    """Blocks of the page's remaining slots, joined by a line feed."""
    found = list(events(page or ""))
    seen = [token(kind, path) for kind, path, _ in found if kind != "text"]
    held = {t for c in classes or () if _fits(seen, c) for t in c}
    link_slots = set(menus or ()) & held
    article = any(in_article(p) and not left_out(p) for k, p, t in found if k == "text" and t.strip())
    blocks: list[list[str]] = [[]]
    slot = ""
    for kind, path, text in found:
        if kind != "text":
            t = token(kind, path)
            if t in held:
                slot = t
            name = path.rpartition("/")[2].split(".")[0]
            if name in BLOCK:
                blocks.append([])
            elif name == "br":
                blocks[-1].append(" ")
            continue
        if slot in link_slots and _in_link(path):
            continue
        if left_out(path) or article and not in_article(path):
            continue
        blocks[-1].append(text)
    joined = (" ".join(htmllib.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every page.

    Pages meet their host's template by (host, salt), the templates being repeated
    for each of :data:`SALTS` salts, so that one host's pages go to many tasks.
    """
    rows = pick(pages, page_id=page_id, url=url, html=html)
    found = templates(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumns({
        "host": host_of(F.col("url")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    joined = dealt.join(found, ["host", "salt"], "left").select("page_id", "url", "html", "classes", "menus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(*x) for x in zip(*(b.column(c).to_pylist() for c in ("html", "classes", "menus")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])
    return map_batches(joined, run, "page_id long, url string, text string")

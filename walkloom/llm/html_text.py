"""Main text of web pages by site template removal.

Each page is parsed once into blocks of text, each with the hashes of the element subtrees around it. Outside the page's core (its article or
main elements, or the deepest element with several blocks that holds half of its text) a subtree's hash is that of its shape: tags, classes, ids and the
shapes of its children, without text and links, so that menus, footers and adverts with other words on each page are alike. Inside the core
it is that of all it holds. Subtrees are counted once per page and host; those that recur on many pages of a host are template and
are deleted there. Lists of elements and class names that are never article text, and the article rule, catch what is left, above
all on hosts with few pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_host, whole_text, written
from .textkit import slices

#: A subtree on at least so many pages and this share of a host's pages is template.
MIN_PAGES, RATIO = 5, 0.2
#: The hosts' template lists are broadcast only up to so many subtrees (8 bytes each and the host); beyond that they are joined by host.
BROADCAST_TREES = 200_000
# HTML elements by role.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_SKIP = frozenset("script style title textarea head nav header footer aside form noscript template iframe button select option dialog svg canvas object video audio menu noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
#: Elements that hold a page's or an article's whole text and are never template themselves.
_WHOLE = frozenset("html body article main".split())
_ENDS_P = _BLOCK - {"br", "body", "html"}  # p among them
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NOISE = re.compile(r"^(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|aside|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommended|more|widget|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|skip|toolbar|copyright|legal|disclaimer|login|search)$")
#: A comment or declaration, or a tag's name; then its attributes up to its end, each read once (a page may break off in them).
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)")
_SHORT = re.compile(r"([^>]*+)(?:>|\Z)")
#: Deeper elements count as their ancestor at this depth.
_DEPTH = 512
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACES = re.compile(r"\s+")


def _noisy(attrs: str) -> bool:
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
            return True
        if name in ("class", "id") and any(_NOISE.match(part) for word in value.split() for part in (word, *re.split(r"[-_]+", word)[:1], *re.split(r"[-_]+", word)[-1:])):
            return True
    return False


class _Node:
    __slots__ = ("article", "digest", "last", "noisy", "number", "shape", "tag")

    def __init__(self, tag: str, head: str, attrs: str, noisy: bool, article: bool, number: int):
        self.tag, self.noisy, self.article, self.number = tag, noisy, article, number
        self.digest = xxhash.xxh3_64(f"<{tag}{attrs}>".encode("utf-8", "surrogatepass"))
        self.shape, self.last = xxhash.xxh3_64(head.encode("utf-8", "surrogatepass")), 0


def _head(tag: str, attrs: str) -> str:
    """What an element's shape takes from itself."""
    named = sorted((name.lower(), " ".join(sorted("".join(values).split()))) for name, *values in _ATTR.findall(attrs)) if attrs else []
    return f"{tag} {named}"


def parse(page: str) -> tuple[list[tuple[str, bool, bool, list[int]]], list[tuple[int, int]]]:
    """Blocks (text, whether inside an article, whether in an element that is never article text, numbers of the elements around it) in page
    order, and of each element the tag, the hash of all it holds and that of its shape."""
    blocks: list[tuple[str, bool, bool, list[int]]] = []
    known: list[tuple[str, int, int]] = [("", 0, 0)]
    stack, text, open_ = [_Node("", "", "", False, False, 0)], [], Counter()

    def flush() -> None:
        if text:
            whole = _SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if whole:
                blocks.append((whole, stack[-1].article, stack[-1].noisy, [n.number for n in stack[1:]]))

    def close() -> None:
        node = stack.pop()
        open_[node.tag] -= 1
        value, shape = node.digest.intdigest(), node.shape.intdigest()
        known[node.number] = node.tag, value, shape
        up = stack[-1]
        up.digest.update(value.to_bytes(8, "little"))
        if shape != up.last:  # a row of children of one shape counts as one, however many there are
            up.shape.update(shape.to_bytes(8, "little"))
            up.last = shape

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            part = page[at:stop]
            stack[-1].digest.update(part.encode("utf-8", "surrogatepass"))
            text.append(part)
        if not found:
            break
        at = found.end()
        closing, tag = found.groups()
        if tag is None:
            continue
        rest = _REST.match(page, at) or _SHORT.match(page, at)
        at, attrs = rest.end(), rest[1]
        tag = tag.lower()
        if closing:
            if tag in _BLOCK:
                flush()
            if open_[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        if stack[k].noisy:
                            flush()
                        while len(stack) > k:
                            close()
                        break
                    if tag not in _BLOCK and stack[k].tag in _BLOCK:
                        break  # an inline element doesn't close the blocks in it
            continue
        if tag in _BLOCK:
            flush()
        if tag in _ENDS_P:
            ends = ("p", *(("li",) if tag == "li" else ()), *(("dt", "dd") if tag in ("dt", "dd") else ()), *(("tr", "td", "th") if tag == "tr" else ("td", "th") if tag in ("td", "th") else ()))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _VOID or attrs.endswith("/"):
            continue
        if tag in _RAW:  # its content is no text, up to its own end tag
            last = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stack[-1].digest.update(page[at : last.start() if last else end].encode("utf-8", "surrogatepass"))
            at = last.end() if last else end
            continue
        up = stack[-1]
        noisy = up.noisy or tag in _SKIP or (tag not in _WHOLE and bool(attrs) and _noisy(attrs))
        if len(stack) > _DEPTH and noisy == up.noisy:
            continue
        if noisy != up.noisy:
            flush()
        node = _Node(tag, _head(tag, attrs), attrs, noisy, up.article or tag in ("article", "main"), len(known))
        known.append((tag, 0, 0))
        open_[tag] += 1
        stack.append(node)
    flush()
    while len(stack) > 1:
        close()
    return blocks, known


def trees(blocks: list[tuple[str, bool, bool, list[int]]], known: list[tuple[str, int, int]]) -> list[list[int]]:
    """The hashes that count for each block: of all an element holds (even) for those inside the core, of its shape (odd) for those outside."""
    core: set[int] = set()
    if not any(article for _, article, _, _ in blocks):
        held: Counter[int] = Counter()
        number: Counter[int] = Counter()
        for text, _, noisy, around in blocks:
            for k in around if not noisy else ():
                held[k] += len(text)
                number[k] += 1
        whole = sum(len(text) for text, _, noisy, _ in blocks if not noisy)
        # Elements are numbered as they begin, so the deepest has the highest number; one paragraph is no core.
        core = {max((k for k, n in held.items() if 2 * n >= whole and number[k] > 1), default=0)}
    out = []
    for _, article, _, around in blocks:
        at = next((i for i, k in enumerate(around) if (known[k][0] in ("article", "main") if article else k in core)), None)
        outer, inner = (around, ()) if at is None else ((), around[at + 1 :])
        if core == {0}:
            outer, inner = (), around
        out.append([known[k][2] | 1 for k in outer if known[k][0] not in _WHOLE] + [known[k][1] & ~1 for k in inner if known[k][0] in _BLOCK and known[k][0] not in _WHOLE])
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 1 << 20):
            texts, marks, around = [], [], []
            for page in part.column("html").to_pylist():
                blocks, known = parse(page)
                texts.append([b[0] for b in blocks])
                has = any(b[1] for b in blocks)
                marks.append([b[2] or (has and not b[1]) for b in blocks])
                around.append([np.array(x, np.uint64).view(np.int64).tolist() for x in trees(blocks, known)])
            own = [part.column(c) for c in ("page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.bool_())), pa.array(around, pa.list_(pa.list_(pa.int64())))], names=["page_id", "url", "host", "texts", "listed", "trees"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lists: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined in page order by one space. A
    null or empty page has an empty text. A null url is a host of its own; null and repeated ids are kept, a result for each row, and
    pages of one host with the same article text count as one page. Paragraphs, headings, list items and table cells of an article that recur
    like template under different titles are deleted like template. lists: also delete what the lists of elements and class names and the article rule name.
    Columns besides these are not read. An empty table gives no rows.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), whole_text(html_col).alias("html"))
    parsed = written(rows.mapInArrow(_parsed, "page_id long, url string, host string, texts array<string>, listed array<boolean>, trees array<array<long>>"), "parsed")
    # Only subtrees that hold text matter, once a page; pages with the same blocks count once, or a mirrored article would be its own template.
    # Two steps, as one host may have a third of all pages: distinct (host, page, tree), then sums that start before the shuffle.
    own = F.filter("texts", lambda x, k: ~F.get("listed", k))
    # In the core, pages with one first block (the title) count once too: they are versions of one article.
    counted = parsed.select("host", F.xxhash64(own).alias("page"), F.xxhash64(F.get(own, F.lit(0))).alias("title"), "trees")
    total = counted.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    each = counted.select("host", "page", "title", F.explode(F.array_distinct(F.flatten("trees"))).alias("tree"))
    found = each.select("host", F.when(F.col("tree") % 2 == 0, F.col("title")).otherwise(F.col("page")).alias("page"), "tree").distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    common = written(found.join(total, "host").where(F.col("n") >= RATIO * F.col("total")).select("host", "tree"), "template")
    # A host has at most (mean subtrees of its pages) / RATIO of them.
    per_host = common.groupBy("host").agg(F.collect_list("tree").alias("template")).withColumnRenamed("host", "__at_host")
    known = by_host(parsed.withColumnRenamed("host", "__host"), per_host, common, BROADCAST_TREES)
    clean = F.transform("texts", lambda x, k: F.struct(x.alias("x"), F.get("listed", k).alias("l"), F.arrays_overlap(F.get("trees", k), F.coalesce("template", F.array().cast("array<long>"))).alias("t")))
    marked = known.select("page_id", "url", clean.alias("b"))
    kept = F.filter("b", lambda b: ~(b["l"] & F.lit(lists)) & ~F.coalesce(b["t"], F.lit(False)))
    text = F.array_join(F.transform(kept, lambda b: b["x"]), " ")
    return marked.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

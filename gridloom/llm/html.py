"""Main text of web pages by site template removal.

Every block element's subtree is hashed and counted per host in Spark; subtrees that recur on many pages of their host are the site's
template and are deleted, wherever they are. Outside an article that is any block. Inside a marked article, subtrees count once for each
different article, an article being known by its plain paragraphs and headings, so syndicated copies don't make their own parts a template;
what can be claimed there is boxes (sections, lists, tables ...) and whatever has a class, an id or a role. Running text without any of these
(paragraphs, headings, items, cells) is the article's own even where it recurs, such as licence lines; so are articles inside articles.

Elements whose content changes from page to page are beyond such hashes. Those that HTML itself sets apart go (navigation, footers, forms, asides ...),
and so do adverts, reader comments and consent boxes by their class or id. Other telling names (related, widget, header, share ...) are
believed only of a frame, a tag with its class, id and role, that the counts find on as many pages of the host as a template needs; one that a single page has is
content. On a host with fewer than ``min_pages`` pages nothing can recur, and there the names alone decide.

The main text is what is left of the page's article or main element, or of the body where a page marks neither. A template needs
``min_pages`` pages, or that share of the host's pages which ``min_share`` says, but never more than ``most_pages``.

The recurring subtrees are broadcast only while they are at most ``broadcast_rows`` keys of 8 bytes; beyond that each page gets its own by joins.

Defined cases: null or empty html gives an empty text; a null or odd url counts as host ''; repeated rows each give a row and count as
separate pages; unclosed, misnested and truncated markup is closed where HTML closes it; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, with_fields

MIN_PAGES, MIN_SHARE, MOST_PAGES, BROADCAST_ROWS = 5, 0.05, 50, 1_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?:[!?/]|[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements of running text; `_SAID` are those that an article is known by.
_SAID = frozenset("p h1 h2 h3 h4 h5 h6".split())
_RUNNING = _SAID | frozenset("blockquote caption dd dt figcaption legend li optgroup option pre summary tbody td tfoot th thead tr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}), "optgroup": frozenset({"option", "optgroup"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "tbody": frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), "tfoot": frozenset({"tbody", "thead", "tr", "td", "th"}),
}
_WALL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}
_DROP = frozenset("head nav footer aside form button select dialog menu search input object audio video canvas map datalist".split())
#: Names of what is never content, and of what is none where the counts know its frame.
_MARK = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|sidebar\w*|side-bar|comments?|commentlist|respond|disqus|cookies?|consent|gdpr|newsletter\w*|subscrib\w*|breadcrumbs?|skip-link|login|signup)(?=$|[\s_-])", re.I)
_HINT = re.compile(r"(?:^|[\s_-])(?:promo\w*|banner\w*|notices?|alert\w*|share|sharing|social|related|recommend\w*|menu\w*|nav\w*|footer\w*|masthead|header|popup\w*|modal\w*|paywall|widget\w*|toolbar)(?=$|[\s_-])", re.I)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar alert".split())


class _Node:
    __slots__ = ("drop", "end", "frame", "inside", "main", "parent", "plain", "start", "tag")

    def __init__(self, tag, start, parent, inside, drop, main=False, plain=False, frame=None):
        self.tag, self.start, self.parent, self.inside, self.drop, self.end = tag, start, parent, inside, drop, -1
        self.main, self.plain, self.frame = main, plain, frame


def _marked(tag: str, attrs: str, inside: bool) -> tuple[bool, str | None, bool]:
    """Whether an element is no content, its frame if its names hint at that, and whether it is marked as the main one."""
    if tag in _DROP or tag == "header" and not inside:
        return True, None, False
    main, names, hint = tag in ("article", "main"), [], False
    if attrs.strip(" /"):
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "role":
                main |= value.lower() in ("main", "article")
                if value.lower() in _ROLES:
                    return True, None, False
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, None, False
            if key in ("class", "id", "role"):
                names.append(f"{key}={' '.join(sorted(value.lower().split()))}")
            if key in ("class", "id") and tag not in ("html", "body") and not (main and key == "class" and tag != "article"):
                if _MARK.search(value):
                    return True, None, False
                hint |= bool(_HINT.search(value))
    return False, f"<{tag} {' '.join(sorted(names))}>" if hint else None, main and not hint


def parse(page: str) -> tuple[list[_Node], list[tuple[int, int, int, str]]]:
    """The elements, and the stream of (start, end, element, kind); kind is text, block or space."""
    nodes, stream, stack, at = [_Node("", 0, -1, False, False)], [], [0], 0

    def close(to: int, pos: int) -> None:
        while len(stack) > to:
            nodes[k := stack.pop()].end = pos
            if nodes[k].tag in _BLOCK:
                stream.append((pos, pos, stack[-1], "block"))

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stream.append((at, m.start(), stack[-1], "text"))
        at = m.end()
        if not (tag := (m["tag"] or "").lower()):
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == tag:
                    close(k, at)
                    break
            else:
                if tag in _BLOCK:
                    stream.append((at, at, stack[-1], "block"))
            continue
        if tag == "br":
            stream.append((at, at, stack[-1], "space"))
            continue
        if closes := _CLOSES.get(tag):
            wall = _WALL.get(tag, frozenset({"article", "main", "body", "div", "section", "td", "li", "blockquote", "nav", "footer", "aside"}))
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in closes:
                    lowest = k
                    while lowest > 1 and nodes[stack[lowest - 1]].tag in closes:
                        lowest -= 1
                    close(lowest, m.start())
                    break
                if nodes[stack[k]].tag in wall:
                    break
        up = nodes[stack[-1]]
        drop, frame, main = _marked(tag, m["attrs"] or "", up.inside)
        if tag in _BLOCK:
            stream.append((at, at, stack[-1], "block"))
        if tag in _VOID or (m["attrs"] or "").endswith("/") and tag not in _BLOCK:
            continue
        main = main and not drop and not up.drop
        nodes.append(_Node(tag, m.start(), stack[-1], up.inside or main, drop or up.drop, main, tag in _RUNNING and not _NAMED.search(m["attrs"] or ""), frame))
        stack.append(len(nodes) - 1)
    if at < len(page):
        stream.append((at, len(page), stack[-1], "text"))
    close(1, len(page))
    nodes[0].end = len(page)
    return nodes, stream


def _key(host: str, piece: str) -> int:
    return xxhash.xxh3_64_intdigest(piece, seed=xxhash.xxh32_intdigest(host)) - (1 << 63)


def _articles(nodes: list[_Node]) -> list[int]:
    """The innermost marked element around each element, or 0."""
    out = [0] * len(nodes)
    for k, x in enumerate(nodes[1:], 1):
        out[k] = x.parent if nodes[x.parent].main else out[x.parent]
    return out


def _template_blocks(page: str, nodes: list[_Node], host: str):
    """The elements that a template can claim, with their keys and, inside a marked article, a name of that article: blocks that are neither dropped
    already, nor around a marked article, nor marked themselves, nor plain running text of one."""
    around = set()
    for x in nodes:
        if x.inside:
            p = x.parent
            while p > 0 and p not in around and not nodes[p].inside:
                around.add(p)
                p = nodes[p].parent
    articles, names = _articles(nodes), {}
    for k, x in enumerate(nodes):
        if x.tag not in _BLOCK or x.tag in ("html", "body", "head") or x.drop or k in around:
            continue
        if not x.inside:
            yield k, _key(host, page[x.start : x.end]), None
        elif not x.main and not x.plain:
            if (a := articles[k]) not in names:
                within = page[nodes[a].start : nodes[a].end]
                said = [i for i, y in enumerate(nodes) if y.plain and not y.drop and y.tag in _SAID and nodes[a].start < y.start < nodes[a].end]
                own = [i for i in said if articles[i] == a] or said
                names[a] = _key(host, "".join(page[nodes[i].start : nodes[i].end] for i in own) or within)
            yield k, _key(f"{host}/", page[x.start : x.end]), names[a]


def _known(host: str) -> int:
    """The key that recurs for a host with enough pages for frames to be counted."""
    return _key(host, "host")


def _frame_key(host: str, frame: str) -> int:
    return _key(f"{host}>", frame)


def main_text(page: str, host: str, recurs) -> str:
    """The text of a page. recurs: says of a subtree's or a frame's key whether it is the host's template."""
    nodes, stream = parse(page)
    known = recurs(_known(host))
    gone = [x.drop or x.frame is not None and (not known or recurs(_frame_key(host, x.frame))) for x in nodes]
    for k, key, _ in _template_blocks(page, nodes, host):
        gone[k] = gone[k] or recurs(key)
    for k, x in enumerate(nodes[1:], 1):
        gone[k] = gone[k] or gone[x.parent]
    marked = any(x.inside and not gone[k] for k, x in enumerate(nodes))
    blocks, current = [], []
    for start, end, k, kind in [*stream, (0, 0, 0, "block")]:
        if kind == "block":
            if current:
                blocks += " ".join(_html.unescape("".join(current)).split()),
                current = []
        elif not gone[k] and (nodes[k].inside or not marked):
            current.append(page[start:end] if kind == "text" else " ")
    return " ".join(b for b in blocks if b)


def _host(url) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_pages: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """(url, page_key, host, key, article) of every claimable subtree and hinted frame, and the keys that recur on enough pages of their host, or in enough
    different articles; a host with so many pages as a template needs has its own key among them."""

    def hashes(batches):
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, nodes = _host(url), parse(page or "")[0]
                claimable = {(0, None), *((key, article) for _, key, article in _template_blocks(page or "", nodes, host)), *((_frame_key(host, x.frame), None) for x in nodes if x.frame and not x.drop)}
                rows += [(url, xxhash.xxh3_64_intdigest(page or "") - (1 << 63), host, key, article) for key, article in claimable]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["url", "page_key", "host", "key", "article"]
            )

    found = pages.select("url", "html").mapInArrow(hashes, "url string, page_key long, host string, key long, article long")
    once = found.groupBy("host", "key", "article").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("article").isNull(), F.col("n")).otherwise(1))
    counts = materialize(once.groupBy("host", "key").agg(F.sum("n").alias("n")).where((F.col("n") >= min_pages) | (F.col("key") == 0)))
    hosts = counts.where("key = 0").select("host", F.col("n").alias("pages"))
    need = F.greatest(F.lit(min_pages), F.least(F.ceil(min_share * F.col("pages")), F.lit(most_pages)))
    recurring = counts.where("key <> 0").join(hosts, "host").where(F.col("n") >= need).select("host", "key")

    return found, recurring.union(_host_keys(hosts.where(F.col("pages") >= min_pages).select("host")))


def _host_keys(hosts: DataFrame) -> DataFrame:
    def keyed(batches):
        for batch in batches:
            yield batch.append_column("key", pa.array([_known(h) for h in batch.column("host").to_pylist()], pa.int64()))

    return hosts.mapInArrow(keyed, with_fields(hosts, key="long"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS, most_pages: int = MOST_PAGES) -> DataFrame:
    """(page_id, url, text) of each page."""
    found, recurring = template_keys(pages, min_pages, min_share, most_pages)
    recurring = materialize(recurring)
    source = pages.select("page_id", "url", "html")
    shared = None
    if recurring.count() <= broadcast_rows:
        keys = np.sort(np.array([r.key for r in recurring.select("key").toLocalIterator()], np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(keys.tobytes())
    else:
        hosts = found.where("key = 0").select("url", "page_key", "host").distinct()
        wanted = found.select("url", "page_key", "host", "key").union(_host_keys(hosts))
        own = wanted.join(recurring, ["host", "key"]).groupBy("url", "page_key").agg(F.collect_set("key").alias("keys"))
        source = (
            _with_key(source).alias("s").join(own.alias("o"), F.col("s.url").eqNullSafe(F.col("o.url")) & (F.col("s.page_key") == F.col("o.page_key")), "left").select("s.page_id", "s.url", "s.html", "o.keys")
        )

    def texts(batches):
        keys = np.frombuffer(shared.value, np.int64) if shared else None

        def recurs(key: int) -> bool:
            at = bisect_left(keys, key)
            return at < len(keys) and keys[at] == key

        for batch in batches:
            own = [recurs] * batch.num_rows if shared else [frozenset(k or ()).__contains__ for k in batch.column(3).to_pylist()]
            out = [main_text(page, _host(url), f) if page else "" for url, page, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return source.mapInArrow(texts, "page_id long, url string, text string")


def _with_key(pages: DataFrame) -> DataFrame:
    def keyed(batches):
        for batch in batches:
            yield batch.append_column("page_key", pa.array([xxhash.xxh3_64_intdigest(x or "") - (1 << 63) for x in batch.column("html").to_pylist()], pa.int64()))

    return pages.mapInArrow(keyed, with_fields(pages, page_key="long"))

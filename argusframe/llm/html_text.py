"""Main text of web pages: lines that a page shares with its nearest neighbour by URL go, and so do, by markup, parts
that differ from page to page without being the article's.

Differencing needs a template that repeats. Where a menu, advert or footer is another one on each page, only markup
tells it; where a page marks its article, what articles have in common (a licence, an opening line) is their own. So
the article's lines stay as they are, and of all others those go that the neighbour has too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, join_weighted, lasting, stored, temporary, tidy

# Elements by what they mean in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title svg math object canvas audio video".split())
LEFT_OUT = RAW | frozenset("head nav footer aside form button select option datalist dialog menu label input search".split())
ENDS_P = BLOCKS - {"body", "html", "head"}

# Words of class, id and role attributes that mark what is no article: fixed by custom, and all that tells a part of
# this kind where it is another one on each page.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner promo promoted promotion sponsor sponsored "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc footer masthead topbar "
    "sidebar aside complementary widget widgets related recommended trending popular "
    "cookie cookies consent gdpr notice notices alert toast popup modal overlay dialog paywall "
    "comment comments commentlist disqus replies respond discussion "
    "share sharing social newsletter subscribe subscription signup login search searchform tags hidden contentinfo".split()
)
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-hidden|style|hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _marked(attributes: str) -> bool:
    """Whether the attributes say that the element is no part of an article, or not shown."""
    if not attributes or attributes.isspace():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name in ("class", "id", "role"):
            if any(w.lower() in MARKS for w in PARTS.findall(value)):
                return True
        elif name == "hidden" and value.lower() != "until-found":
            return True
        elif name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def page_lines(html: str | None) -> list[tuple[str, bool]]:
    """The page's blocks in order, as (text, whether it lies in an ``article`` or ``main`` element).

    Menus, footers, sidebars, forms, scripts, hidden parts and what classes, ids and roles mark as adverts,
    notices, comments and the like are left out, also a ``header`` but for headings of an article's own.
    Character references are decoded, white space becomes one space, empty blocks go. Unclosed elements
    end with the element around them, a cut tag at the end of the page counts as closed.
    """
    out: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, left out, in main, in a header and in no heading of it
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    text = html or ""

    def flush() -> None:
        if buffer:
            line = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if line:
                out.append((line, bool(stack and stack[-1][2])))

    def close(at: int) -> None:
        if any(s[0] in BLOCKS for s in stack[at:]):
            flush()
        opened.subtract(s[0] for s in stack[at:])
        del stack[at:]

    def close_open(names, within=True) -> bool:
        """Closes the innermost open element of these names; ``within``: that no sectioning element holds."""
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    close(i)
                    return True
                if within and stack[i][0] in SCOPES:
                    break
        return False

    at = 0
    size = len(text)
    while at < size:
        m = TOKEN.search(text, at)
        stop = m.start() if m else size
        if stop > at:
            if not stack or not stack[-1][1] and not stack[-1][3]:
                buffer.append(text[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2].lower() if m[2] else None
        if name is None:
            continue
        if m[1]:
            if not close_open({name}, name not in SCOPES) and name in BLOCKS:
                flush()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)|</{re.escape(name)}\s[^>]*(?:>|$)", re.I).search(text, at)
            at = end.end() if end else size
            continue
        if name in ENDS_P:
            flush()
            close_open({"p"})
        if name in SELF_ENDING:
            close_open(SELF_ENDING[name])
        if name in VOID or m[3].endswith("/"):
            continue
        up = stack[-1] if stack else ("", False, False, False)
        inside = up[2] or name in ("article", "main") or "main" in m[3] and bool(re.search(r"role\s*=\s*[\"']?main", m[3]))
        off = up[1] or name in LEFT_OUT or name == "header" and not up[2] or name not in ("html", "body", "article", "main") and _marked(m[3])
        stack.append((name, off, inside, (up[3] or name == "header") and name not in HEADINGS))
        opened[name] += 1
    flush()
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("article section div main aside nav footer header form table td th ul ol body html blockquote".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence with ``b`` (Hunt and Szymanski)."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            elif j < tails[k]:
                tails[k] = j
                links[k] = link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def main_text(lines: list[tuple[str, bool]], shared: list[int]) -> str:
    """The article's text. ``shared`` counts the lines outside of ``article`` and ``main`` elements.

    Where the page marks its article so, its lines stay, shared or not: what articles have in common
    (a licence, an opening line) is their own. Of the others, those that the neighbour lacks stay.
    """
    gone, outside, out = set(shared), 0, []
    for text, main in lines:
        if main or outside not in gone:
            out.append(text)
        outside += not main
    return "\n".join(out)


def _shared_with_neighbours(rows: DataFrame, parts: int | None) -> DataFrame:
    """``(id, mark, gone)``: of ``rows(id, mark, host, path, html)`` those that share lines with their neighbour, and which."""
    kind, spark = rows.schema["id"].dataType.simpleString(), rows.sparkSession

    def look(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            found = [page_lines(h) for h in b.column(4).to_pylist()]
            hashes = [[digest(t) - (1 << 63) for t, main in lines if not main] for lines in found]
            whole = [digest("\n".join(f"{int(main)}{t}" for t, main in lines)) - (1 << 63) for lines in found]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in range(4)), pa.array(hashes, pa.list_(pa.int64())), pa.array(whole, pa.int64())],
                ["id", "mark", "host", "path", "lines", "whole"],
            )

    slim = rows.select("id", "mark", "host", "path", "html").mapInArrow(tidy(look), f"id {kind}, mark long, host string, path string, lines array<long>, whole long")
    slim = stored(slim, "page-lines")
    # a page without lines outside its article has nothing to compare, but is a neighbour
    one = slim.groupBy("host", "whole", "lines").agg(F.min(F.struct("path", "id", "mark")).alias("one"), F.count("*").alias("rows"))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["host", "path", "one.id", "one.mark"]
    ranked = one.select("host", "whole", "lines", "one", "rows", "one.path").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranked = stored(ranked.withColumn("place", F.monotonically_increasing_id()).select("place", "host", "path", "whole", "lines", "rows"), "page-order")
    ends = ranked.groupBy(F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    bounds = sorted((r["lo"], r["hi"]) for r in ends.collect())  # a row a partition
    leaps = spark.createDataFrame([(a[1], b[0]) for a, b in zip(bounds, bounds[1:])], "place long, leap long")
    after = ranked.join(F.broadcast(leaps), "place", "left").withColumn("next", F.coalesce("leap", F.col("place") + 1))
    right = ranked.select(F.col("place").alias("next"), *[F.col(c).alias(f"{c}2") for c in ("host", "path", "lines")])
    pairs = after.join(right, "next").where("host = host2")
    side = lambda own, other, at, back: F.struct(
        F.col(at).alias("at"), F.col(f"path{own}").alias("path"), F.col(f"lines{own}").alias("lines"),
        F.col(f"path{other}").alias("path2"), F.col(f"lines{other}").alias("lines2"), F.lit(back).alias("back"),
    )
    sides = pairs.select(F.explode(F.array(side("", "2", "place", 0), side("2", "", "next", 1))).alias("s")).select("s.*")

    def compare(batches):
        for b in batches:
            path, lines, path2, lines2 = (b.column(k).to_pylist() for k in range(1, 5))
            alike = []
            for p, q in zip(path, path2):
                n = 0
                for x, y in zip(p.split("/"), q.split("/")):
                    if x != y:
                        break
                    n += 1
                alike.append(n)
            gone = [common_lines(x, y) for x, y in zip(lines, lines2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(alike, pa.int32()), b.column(5), pa.array(gone, pa.list_(pa.int32()))], ["at", "alike", "back", "gone"]
            )

    judged = sides.where("size(lines) > 0").mapInArrow(tidy(compare), "at long, alike int, back int, gone array<int>")
    chosen = judged.groupBy("at").agg(F.max_by("gone", F.struct("alike", -F.col("back"))).alias("gone")).where("size(gone) > 0")
    chosen = stored(ranked.join(chosen.withColumnRenamed("at", "place"), "place").select("host", "whole", "lines", "rows", "gone"), "page-shared")
    return join_weighted(slim, chosen, ["host", "whole", "lines"], "rows").select("id", "mark", "gone").distinct()


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: int | None = None
) -> DataFrame:
    """One row a row of ``pages``: ``<id_col>, <url_col>, text, n_chars``.

    Pages are sorted by host, URL path, and id; each is compared with that of its two neighbours on the host
    whose path begins like its own for longer (the next one on ties), line by line. Pages of a host whose lines are all
    equal are one page, at the least of their places, so a copy is no neighbour. The sort is a range
    partitioning over all pages, so the largest host is spread over many tasks; neighbours across a
    partition's boundary are found from the partitions' first and last places. Only lines' hashes are
    moved for it, the texts come from a second look at the pages. Null html, or html without text, gives
    the empty text; null urls are one host. Rows may repeat ids and urls; an empty table gives none. A page
    without an article keeps of its lines those that its neighbour lacks, all if it has no neighbour. Other
    columns are not read.
    """
    kind, spark = pages.schema[id_col].dataType.simpleString(), pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = bounded_batches(pages).select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(url, F.col(html_col)).alias("mark"),
        F.lower(F.regexp_extract(url, r"^\w+://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:\w+://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col(html_col).alias("html"),
    )

    with temporary(spark):
        gone = lasting(_shared_with_neighbours(rows, parts), "page-gone")

    def write(batches):
        for b in batches:
            texts = [main_text(page_lines(h), g or []) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    joined = rows.alias("r").join(
        gone.alias("c"), F.col("r.id").eqNullSafe(F.col("c.id")) & (F.col("r.mark") == F.col("c.mark")), "left"
    ).select("r.id", "r.url", "html", "gone")
    out = joined.mapInArrow(tidy(write), f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")

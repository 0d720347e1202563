"""Main text of web pages.

Markup that says what it is decides first: text inside navigation, headers, footers, asides, forms, scripts, hidden parts, and
elements whose class, id or role names an advert, a notice, comments and the like is no main text, and a page with an `article` or
`main` element has its main text there. On such a page the names are whole words of class, id or role ("search", not "search-method");
on others, where the element's name is all there is, a part between dashes is enough.

There too the host's suffix array has a say: a block that is made of nothing but substrings which most of the host's pages have in
their articles is a notice, an advert or the like whose names don't tell, and goes. What only some pages share stays, as articles quote one another and
lists of articles repeat their beginnings. A substring that most pages have is one that most pages of some part of them have, so parts of
about GROUP pages each build the array of their suffixes by prefix doubling, and what passes there is counted over all pages.

Where a page has neither, its host decides alone, by a suffix array: the token streams of all its pages' blocks make suffixes, which are
dealt by range and sorted, a host of any size over many tasks. Neighbours in that order that agree in WINDOW tokens or more are an
interval; one that holds suffixes of distinct pages is a substring that they share, and the tokens that it covers are boilerplate.
What no other page has is kept. Suffixes end with their block and are cut after DEPTH tokens, as a longer repeat shows again at each of
its places. An interval on the border of two parts is settled by the pages that its parts tell of. Pages with the same tokens are
copies of one page, not other pages. A page that is nothing but elements with a name in part (a body in `has-sidebar`) keeps them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import spool

#: Tokens that pages must share, and tokens of a suffix that are sorted.
WINDOW, DEPTH = 8, 12
#: Distinct pages that a host must have for most of them to tell of an article's blocks; pages and characters of a part of a host.
LEAST, GROUP, GROUP_CHARS = 20, 256, 1 << 22
#: Elements that are never main text, that are inside lines of text, that have no end tag, and whose content is not markup.
SKIPPED = frozenset("head nav header footer aside form script style noscript template svg math iframe object canvas audio video button select option textarea input menu dialog title figcaption".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img br wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes noembed".split())
#: Names in class, id or role of what is no main text.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "notice notices alert popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login "
    "search toolbar pagination pager skip hidden contentinfo complementary dialog copyright masthead topbar widget widgets site-header site-footer page-header page-footer".split()
)
#: Those that mean it as a part of a name too: `overflow-hidden` hides no text.
PARTS = NAMES - {"hidden"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
#: Attributes in order, a name and perhaps a value, so that no word of a value is taken for a name.
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
COMMENT = re.compile(r"comments?|comment-.*")
CONTAINER = r"(?is)<(article|main)[\s>]"


def is_no_text(name: str, attributes: str, inside: bool, whole: bool = False) -> bool:
    """Whether an element is no main text. inside: of an article or main element, where a header or a caption is the article's own.
    whole: only whole words of class, id and role count, not their parts between dashes."""
    if name in SKIPPED and not (inside and name in ("header", "figcaption")):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    seen = set()
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in seen:  # the first one counts
            continue
        seen.add(key)
        words = [w.replace("_", "-") for w in value.split()] if key in ("class", "id", "role") else []
        if name == "article":
            if any(COMMENT.fullmatch(w) for w in words) or key == "itemtype" and value.endswith("/comment"):
                return True
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        elif any(w in NAMES or not whole and not PARTS.isdisjoint(w.split("-")) for w in words):
            return True
    return False


def blocks(page: str, whole: bool = False) -> tuple[list[str], bool]:
    """Blocks of main text as far as markup says, white space made one space, and whether an article or main element held them. whole:
    only whole words of names count on any page."""
    found: list[tuple[str, bool, bool]] = []
    line: list[str] = []
    article = main = at = 0
    whole = whole or re.search(CONTAINER, page) is not None  # around an article as in it, as what is skipped there takes the article along
    skip, depth = "", 0  # the element that is being skipped, and how many of its name are open
    back = None  # where to go back to if it is never closed

    def close():
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            line.clear()
            if text:
                found.append((text, article > 0, main > 0))

    refused: set[int] = set()
    while True:
        m = TOKEN.match(page, at) if at < len(page) else None
        if m is None:
            if at >= len(page):
                if skip and back is not None:  # never closed: its tag says nothing
                    at, saved = back
                    refused.add(at)
                    del found[saved:]
                    skip, depth, back = "", 0, None
                    continue
                break
            at += 1  # a `<` that begins no tag
            if not skip:
                line.append("<")
            continue
        here, at = at, m.end()
        name = m[2]
        if name is None:
            if m[4] is not None and not skip:
                line.append(m[4])
            continue
        name, end = name.lower(), bool(m[1])
        if skip:
            if skip in ("p", "li") and name not in INLINE and not (end and name == skip):
                skip, back, at = "", None, here  # closed by what follows
            elif name == skip:
                depth += -1 if end else (not m[3].endswith("/"))
                if not depth:
                    skip, back = "", None
            continue
        if name not in INLINE:
            close()
        elif name == "br":
            line.append(" ")
        if end:
            if name == "article":
                article = max(0, article - 1)
            elif name == "main":
                main = max(0, main - 1)
            continue
        no_text = here not in refused and is_no_text(name, m[3], article > 0 or main > 0, whole)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page) if name in ("script", "style") else at
            continue
        if no_text and name not in VOID and not m[3].endswith("/"):
            close()
            skip, depth, back = name, 1, (here, len(found))
        elif name == "article":
            article += 1
        elif name == "main":
            main += 1
    close()
    for k in (1, 2):
        if chosen := [b[0] for b in found if b[k]]:
            return chosen, True
    return [b[0] for b in found], False


def suffixes(blocks: list[str]) -> list[tuple[int, str]]:
    """(place of its first token in the page, its first DEPTH tokens, a space after each) of each suffix of a block that has WINDOW
    tokens or more. With the space, suffixes that agree in whole tokens stand side by side in sorted order."""
    out, at = [], 0
    for block in blocks:
        tokens = block.split()
        out += [(at + i, " ".join([*tokens[i : i + DEPTH], ""])) for i in range(len(tokens) - WINDOW + 1)]
        at += len(tokens)
    return out


def head(suffix: str) -> str:
    """The first WINDOW tokens."""
    return " ".join(suffix.split(" ", WINDOW)[:WINDOW])


def intervals(batches: Iterator) -> Iterator[tuple]:
    """Walks a part of the suffix array, rows (host, suffix, page, row, place) in order. Gives (row, place, None, None) for suffixes
    of intervals with distinct pages; (row, place, key, page) for those of the part's first and last interval, where they have one
    page in this part, and (None, None, key, page) for the pages, two at most, of those intervals in any case. Only suffixes of an
    interval that has shown one page so far are held."""
    key, page, held, several, first = None, None, [], False, True

    def close(edge):
        if edge and key is not None:
            mark = blake2b(f"{key[0]}\x00{key[1]}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            yield None, None, mark, page
            yield from ((*place, mark, page) for place in held)
            if several:
                yield None, None, mark, other

    other = None
    for batch in batches:
        for host, suffix, of, row, place in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (now := (host, head(suffix))) != key:
                yield from close(first)
                first = first and key is None
                key, page, held, several = now, of, [], False
            if of != page and not several:
                several, other = True, of
                yield from ((*p, None, None) for p in held)
                held = []
            if several:
                yield row, place, None, None
            else:
                held.append((row, place))
    yield from close(True)


def common_runs(pages: list[list[str]]) -> list[str]:
    """The substrings of WINDOW tokens, inside blocks, that more than half of these pages have, by the suffix array of all their
    suffixes: ranks of 1, 2, 4 and 8 tokens, then neighbours of equal rank."""
    tokens, page, left = [], [], []
    for i, found in enumerate(pages):
        for split in map(str.split, found):
            if len(split) >= WINDOW:
                tokens += split
                page.append(np.full(len(split), i))
                left.append(np.arange(len(split), 0, -1))
    if not tokens:
        return []
    order = {t: i for i, t in enumerate(sorted(set(tokens)))}
    rank, page, left = np.array([order[t] for t in tokens], dtype=np.int64), np.concatenate(page), np.concatenate(left)
    width = 1
    while width < WINDOW:
        after = np.append(rank[width:], np.zeros(width, dtype=np.int64))  # of no meaning past a block's end, where no suffix is used
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1].astype(np.int64)
        width *= 2
    array = np.flatnonzero(left >= WINDOW)
    array = array[np.lexsort((page[array], rank[array]))]
    starts = np.flatnonzero(np.append(True, np.diff(rank[array]) != 0))
    other = np.append(True, (np.diff(rank[array]) != 0) | (np.diff(page[array]) != 0)).astype(np.int64)
    many = starts[2 * np.add.reduceat(other, starts) > len(pages)]
    return [" ".join(tokens[i : i + WINDOW]) for i in array[many].tolist()]


def places_of(block: str, runs: set[str]) -> dict[int, str]:
    """Where in a block one of these runs begins, and which."""
    if not runs:
        return {}
    tokens = block.split()
    return {i: run for i in range(len(tokens) - WINDOW + 1) if (run := " ".join(tokens[i : i + WINDOW])) in runs}


def without(blocks: list[str], places: list[int], window: int = WINDOW) -> str:
    """The text of a page's blocks without the `window` tokens from each of these places on."""
    split = [b.split() for b in blocks]
    edge = np.zeros(sum(map(len, split)) + window + 1, dtype=np.int64)
    np.add.at(edge, np.array(places, dtype=np.int64), 1)
    np.add.at(edge, np.array(places, dtype=np.int64) + window, -1)
    covered, kept, at = np.cumsum(edge) > 0, [], 0
    for b in split:
        if text := " ".join(t for t, c in zip(b, covered[at : at + len(b)]) if not c):
            kept.append(text)
        at += len(b)
    return " ".join(kept)


def of_articles(page: DataFrame) -> DataFrame:
    """page_id, url, text of pages (page_id, url, host, html) that have an article or main element. Blocks are made again by each pass
    over them, as they would take as much disk as the pages."""
    kind = page.schema["page_id"].dataType.simpleString()

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([blocks(v.as_py())[0] for v in batch.column(3)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found, batch.column(4)], names=["page_id", "url", "host", "blocks", "runs"])

    def candidates(batches):
        import pyarrow as pa

        key, last, held = None, None, []

        def close():
            found = common_runs(held)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.string()), pa.array(found, pa.string())], names=["host", "run"])

        for batch in batches:
            for host, group, same, found in zip(*(batch.column(i) for i in range(4))):
                now, same = (host.as_py(), group.as_py()), same.as_py()
                if now != key:
                    if held:
                        yield close()
                    key, last, held = now, None, []
                if same != last:  # copies are one page
                    last = same
                    held.append(found.as_py())
        if held:
            yield close()

    def matches(batches):
        import pyarrow as pa

        for batch in batches:
            host, same, run = [], [], []
            for h, d, found, runs in zip(*(batch.column(i) for i in range(4))):
                runs, found = set(runs.as_py()), found.as_py()
                has = {r for b in found for r in places_of(b, runs).values()}
                host += [h.as_py()] * len(has)
                same += [d.as_py()] * len(has)
                run += has
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(same, pa.int64()), pa.array(run, pa.string())], names=["host", "same", "run"])

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            text = []
            for found, runs in zip(batch.column(2), batch.column(3)):
                found, runs = found.as_py(), set(runs.as_py() or [])
                kept = [b for b in found if not runs or without([b], list(places_of(b, runs)))]
                text.append(" ".join(kept or found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    def parsed(page):
        made = page.select("page_id", "url", "host", "html", "runs").mapInArrow(parse, f"page_id {kind}, url string, host string, blocks array<string>, runs array<string>")
        return made.withColumn("same", F.xxhash64("blocks"))

    plain = parsed(page.withColumn("runs", F.lit(None).cast("array<string>")))
    sized = plain.select("host", "same", F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + F.length(b)).alias("chars"))
    hosts = sized.groupBy("host", "same").agg(F.max("chars").alias("chars")).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    hosts = hosts.filter(F.col("n") >= LEAST).select("host", "n", F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("chars") / GROUP_CHARS)).alias("groups"))
    hosts = spool(hosts, "html-hosts")
    dealt = plain.join(hosts, "host").select("host", F.pmod("same", "groups").alias("group"), "same", "blocks")
    dealt = dealt.repartition("host", "group").sortWithinPartitions("host", "group", "same")
    found = spool(dealt.mapInArrow(candidates, "host string, run string").distinct(), "html-runs")
    asked = found.groupBy("host").agg(F.collect_list("run").alias("runs"))
    counted = parsed(page.join(asked, "host")).select("host", "same", "blocks", "runs").mapInArrow(matches, "host string, same long, run string")
    counted = counted.distinct().groupBy("host", "run").count()
    most = counted.join(hosts, "host").filter(2 * F.col("count") > F.col("n")).groupBy("host").agg(F.collect_list("run").alias("runs"))
    told = parsed(page.join(spool(most, "html-most"), "host", "left"))
    return told.select("page_id", "url", "blocks", "runs").mapInArrow(clean, f"page_id {kind}, url string, text string")


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each page: page_id, url, text, n_chars (code points of text).

    A null or empty html has an empty text. Repeated rows and null ids are kept as they are; pages with a null url are a host of
    their own together. Whole pages are worked on, whatever their length.
    """
    kind = df.schema[id_col].dataType.simpleString()
    page = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    held = F.col("html").rlike(CONTAINER)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            found = pa.array([blocks(v.as_py())[0] or blocks(v.as_py(), True)[0] for v in batch.column(3)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["page_id", "url", "host", "blocks"])

    def streams(batches):
        import pyarrow as pa

        for batch in batches:
            for row, host, found in zip(*(batch.column(i) for i in range(3))):
                found = found.as_py()
                page = blake2b(" ".join(found).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                made = suffixes(found)
                for i in range(0, len(made), 1 << 14):
                    some = made[i : i + (1 << 14)]
                    columns = [pa.array([host.as_py()] * len(some), pa.string()), pa.array([t for _, t in some], pa.string()), pa.array([page] * len(some), pa.binary()), pa.array([row.as_py()] * len(some), pa.int64()), pa.array([p for p, _ in some], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["host", "suffix", "page", "row", "place"])

    def walk(batches):
        import pyarrow as pa

        types, out = (pa.int64(), pa.int32(), pa.binary(), pa.binary()), []
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row", "place", "key", "page"])
        for r in intervals(batches):
            out.append(r)
            if len(out) == 1 << 14:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def clean(batches):
        import pyarrow as pa

        for batch in batches:
            text = pa.array([without(found.as_py(), places.as_py() or []) for found, places in zip(batch.column(2), batch.column(3))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    page = page.select("page_id", "url", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"), "html")
    done = of_articles(page.filter(held))
    loose = page.filter(~held).mapInArrow(cut, f"page_id {kind}, url string, host string, blocks array<string>")
    loose = spool(loose.withColumn("row", F.monotonically_increasing_id()), "html-blocks")  # written, so that its row numbers stay
    order = ("host", "suffix", "page", "row", "place")
    array = loose.select("row", "host", "blocks").mapInArrow(streams, "host string, suffix string, page binary, row long, place int").repartitionByRange(*order).sortWithinPartitions(*order)
    seen = spool(array.mapInArrow(walk, "row long, place int, key binary, page binary"), "html-intervals")
    border = seen.filter("key IS NOT NULL").groupBy("key").agg(F.min("page").alias("least"), F.max("page").alias("most")).filter("least <> most").select("key")  # two rows a part at most
    settled = seen.filter("key IS NOT NULL AND row IS NOT NULL").join(border, "key", "left_semi")
    places = seen.filter("key IS NULL").select("row", "place").union(settled.select("row", "place")).groupBy("row").agg(F.collect_list("place").alias("places"))
    told = loose.join(places, "row", "left").select("page_id", "url", "blocks", "places").mapInArrow(clean, f"page_id {kind}, url string, text string")
    return done.unionByName(told).withColumn("n_chars", F.char_length("text").cast("long"))

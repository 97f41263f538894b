"""Main text of web pages: page structure first, then a suffix array per host for what it leaves open.

Structure settles most blocks: what stands in an ``article`` or ``main`` container is content, what
stands in menus, headers, footers, sidebars, notices, adverts, forms, comments and the like is not.
All other blocks are open; beside a content container only those that read as prose, as lines like a
copyright are none of the article. For open blocks, the token streams of pages of one host are
concatenated and their suffixes ranked; substrings of ``run`` tokens or more that occur on two
different pages are boilerplate, and the blocks they cover are removed. Unique runs stay.

A host is cut into groups of a bounded number of pages, so one that holds a third of all pages is
many groups. What repeats is decided host-wide: for hosts of several groups, the distinct hashes of
all windows of ``run`` tokens of a group are brought together by host and hash, and those of two
different pages are handed back to every group that holds them. A hash is in one row per group, so
neither a hot host nor a line on all its pages makes a hot key. Only pages with open blocks are
shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.workspace import materialize

#: Elements whose content is no markup and no text of the page.
_RAW = "script|style|noscript|template|textarea|svg|iframe|object|canvas|select|math|title"
_RAW_ELEMENTS = frozenset(_RAW.split("|"))
#: Elements that hold no content of the page itself.
_ASIDE = frozenset("nav header footer aside form menu dialog head button fieldset".split())
#: Elements that hold the content.
_CONTENT = frozenset(("article", "main"))
#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section summary table tbody td tfoot th thead tr ul video audio".split()
)
#: Elements that stay open until they are closed; the others end with their block.
_NESTED = _BLOCK - frozenset("br hr p li dt dd tr td th option html body".split()) | _ASIDE
#: Elements that group other blocks; only these can be named as no content inside of content.
_CONTAINER = frozenset("address aside center details div dl figure footer header hgroup ol section table ul".split())
#: Words in a class, an id or a role that name a part that is no content.
_WORDS = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|"
    r"footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|search|share|"
    r"sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
)
_NAMED = re.compile(rf"(?:^|[\s_-]){_WORDS}(?:$|[\s_-])", re.IGNORECASE)
#: Inside of content, "related" names a part, but "related-work" may be a subject of the article. So a name counts
#: as a whole, or if its first or last part says whose it is, or if a part for readers has the shape of a control.
_NAMED_WHOLE = re.compile(_WORDS, re.IGNORECASE)
_STRONG = re.compile(
    r"(?:ads?|advert\w*|comments?|consent|cookies?|disqus|gdpr|newsletter|popup|promo\w*|sponsor\w*|subscribe)", re.IGNORECASE
)
_WEAK = re.compile(r"(?:related|search|share|sharing|social|notice|nav|menu|footer|banner)", re.IGNORECASE)
_SHAPE = re.compile(
    r"(?:articles?|banner|bar|box|buttons?|form|icons?|links?|list|menu|nav|news|panel|posts?|stories|tools?|widget)", re.IGNORECASE
)
_HEADING = re.compile(r"\s*<h[1-6]\b[^>]*>([^<]*)</h", re.IGNORECASE)
#: Open blocks beside a content container need so many words, less than half of their letters in links.
PROSE_WORDS = 12
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\shidden(?:[\s=>/]|$)|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*(?:(?<=/)>|(?<!/)>.*?(?:</\1\s*>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
    # Quotes enclose a value only right after "="; nothing is tried twice.
    r"""((?>[^<>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s<>"'][^\s<>]*)?)*+)>""",
    re.IGNORECASE | re.DOTALL,
)


def _named_inside(attributes: str, after: str) -> bool:
    """Does a container inside of content hold something else, by its classes, role or id?

    An id made of several words that its own heading repeats is a section of the article, unless its
    last word says otherwise. ``after`` is the page behind the tag.
    """
    for found in _PARTS.finditer(attributes):
        kind = found[1].lower()
        for name in (found[2] or found[3] or found[4] or "").split():
            parts = [p for p in re.split(r"[-_:]+", name) if p]
            if not parts:
                continue
            whole = bool(_NAMED_WHOLE.fullmatch(name))
            first, last = (bool(_STRONG.fullmatch(p)) for p in (parts[0], parts[-1]))
            shaped = any(_WEAK.fullmatch(p) for p in parts[:-1]) and bool(_SHAPE.fullmatch(parts[-1]))
            if not (whole or first or last or shaped):
                continue
            heading = _HEADING.match(after) if kind == "id" else None
            own = heading and re.findall(r"\w+", heading[1].lower()) == [p.lower() for p in parts]
            if not own or _STRONG.fullmatch(parts[-1]):
                return True
    return False


def marked_blocks(page: str) -> list[tuple[str, bool]]:
    """The blocks that may be main text, in page order; true for those in a content container, the others are open.

    Beside blocks of a content container, open ones are prose only. Unclosed and stray tags do no
    harm: a closing tag closes up to its partner, or nothing.
    """
    blocks: list[tuple[str, bool, bool]] = []
    current: list[str] = []
    stack: list[tuple[str, str]] = []
    zone = "loose"
    paragraph_dropped = False
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if text and zone != "drop" and not paragraph_dropped:
            prose = text.count(" ") + 1 >= PROSE_WORDS and 2 * linked < len(text)
            blocks.append((text, zone == "content", prose))
        linked = 0

    end = 0
    for tag in _MARKUP.finditer(page):
        current.append(page[end : tag.start()])
        linked += len(current[-1]) if links else 0
        end = tag.end()
        name = (tag[3] or "").lower()
        if not name:
            continue
        if name == "a":
            links = 0 if tag[2] else 1
        if name not in _BLOCK and name not in _NESTED:
            continue
        flush()
        paragraph_dropped = False
        if tag[2]:
            if name in _NESTED and any(open_name == name for open_name, _ in stack):
                while stack.pop()[0] != name:
                    pass
                zone = stack[-1][1] if stack else "loose"
        else:
            if zone == "content":
                aside = name in _CONTAINER and _named_inside(tag[4], page[end : end + 400])
            else:
                aside = _NAMED.search(" ".join(next(g for g in m.groups() if g is not None) for m in _NAMES.finditer(tag[4])))
            named = name not in _CONTENT and name not in ("body", "html") and (aside or _HIDDEN.search(tag[4]))
            if name in _NESTED and not tag[4].endswith("/"):
                inside = zone
                if zone != "drop":
                    if named or name in _ASIDE and not (zone == "content" and name == "header"):
                        inside = "drop"
                    elif name in _CONTENT:
                        inside = "content"
                stack.append((name, inside))
                zone = inside
            elif named:
                paragraph_dropped = True
    current.append(page[end:])
    flush()
    settled = any(content for _, content, _ in blocks)
    return [(text, content) for text, content, prose in blocks if content or prose or not settled]


def page_blocks(page: str) -> tuple[list[str], list[str]]:
    """The blocks of content containers, and the open blocks, both in page order."""
    blocks = marked_blocks(page)
    return [text for text, content in blocks if content], [text for text, content in blocks if not content]


def suffix_array(stream: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the stream in the order of their suffixes, and whether a suffix shares ``depth`` tokens with the one before.

    Suffixes are ranked by twice as many tokens per round until no two ranks are equal. The stream
    must end in a token of its own.
    """
    size = len(stream)
    rank = np.unique(np.array(stream, dtype=np.int64), return_inverse=True)[1].astype(np.int64) + 1

    def paired(shift: int) -> np.ndarray:
        later = np.zeros(size, dtype=np.int64)
        later[: max(0, size - shift)] = rank[shift:]
        return np.unique(rank * (size + 1) + later, return_inverse=True)[1].astype(np.int64) + 1

    width = 1
    while width < depth:
        # The last step up to ``depth`` overlaps, so that these ranks compare as many tokens exactly.
        shift = min(width, depth - width)
        rank = paired(shift)
        width += shift
    shallow = rank
    while size and rank.max() < size:
        rank = paired(width)
        width *= 2
    order = np.argsort(rank)
    alike = np.concatenate(([False], shallow[order][1:] == shallow[order][:-1]))[:size]
    return order, alike


def repeated_tokens(
    pages: list[list[list[str]]], run: int, elsewhere: list[np.ndarray] | None = None
) -> list[list[np.ndarray]]:
    """For every page, block and token: is it in a run of ``run`` or more tokens that another page has, too?

    The streams are concatenated and their suffixes put in order. Neighbours that share ``run`` tokens
    are a repeat, and one of two pages is boilerplate. Every place of a longer repeat begins a repeat or
    is covered by one, so repeats are marked in their whole length. Streams end with a mark of their own,
    so no run crosses two pages. ``elsewhere`` names for every page the first tokens of runs that are
    known from pages outside of ``pages``.
    """
    ids: dict[str, int] = {}
    stream: list[int] = []
    owner: list[int] = []
    for p, blocks in enumerate(pages):
        for block in blocks:
            stream.extend(ids.setdefault(t, len(ids)) for t in block)
            owner.extend([p] * len(block))
        stream.append(-1 - p)
        owner.append(p)
    size = len(stream)
    order, alike = suffix_array(stream, run)
    starts = np.flatnonzero(~alike)
    owners = np.array(owner, dtype=np.int64)[order]
    several = np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts) if size else np.zeros(0, dtype=bool)
    shared = np.zeros(size, dtype=bool)
    shared[order] = np.repeat(several, np.diff(np.concatenate((starts, [size]))))
    begin = 0
    for p, blocks in enumerate(pages if elsewhere else []):
        shared[begin + elsewhere[p]] = True
        begin += sum(map(len, blocks)) + 1
    steps = np.zeros(size + run + 1, dtype=np.int64)
    at = np.flatnonzero(shared)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + run, -1)
    covered = np.cumsum(steps)[:size] > 0
    result, place = [], 0
    for blocks in pages:
        marks = []
        for block in blocks:
            marks.append(covered[place : place + len(block)])
            place += len(block)
        place += 1
        result.append(marks)
    return result


def unique_blocks(pages: list[list[str]], run: int, elsewhere: list[np.ndarray] | None = None) -> list[list[bool]]:
    """Which blocks of pages of one host stay: those that boilerplate covers for the most part go."""
    tokens = [[block.split() for block in blocks] for blocks in pages]
    covered = repeated_tokens(tokens, run, elsewhere)
    return [[bool(2 * c.sum() < max(1, len(c))) for c in marks] for marks in covered]


def window_hashes(tokens: Column, run: int) -> Column:
    """A 64-bit hash of every ``run`` tokens in a row, in order; null and shorter lists have none."""
    places = F.sequence(F.lit(0), F.size(tokens) - run)
    hashes = F.transform(places, lambda at: F.xxhash64(F.slice(tokens, at + 1, run)))
    return F.when(F.size(tokens) >= run, hashes).otherwise(F.array().cast("array<bigint>"))


def extract_text(
    df: DataFrame, id_col: str, url_col: str, html_col: str, run: int = 6, group_pages: int = 500, group_chars: int = 1 << 24
) -> DataFrame:
    """``page_id, url, text`` of every row; ``text`` is empty if nothing is left.

    A null page is empty, a null or odd URL belongs to the host ''. Repeated rows are each extracted;
    with open blocks, two rows of the same id and the same blocks count as one page and so are no
    boilerplate to each other; an id may be null, and other rows of an id are pages of their own.
    ``group_pages`` and ``group_chars`` bound what a task holds of a host, but for a single page, and
    do not change the result. An empty table has no rows.
    """
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [marked_blocks(p or "") for p in part.column("html").to_pylist()]
                left = [any(not content for _, content in blocks) for blocks in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(
                            ["" if o else " ".join(t for t, _ in blocks) for blocks, o in zip(found, left, strict=True)], pa.string()
                        ),
                        pa.array([[t for t, content in blocks if not content] for blocks in found], pa.list_(pa.string())),
                        # Blocks in page order, null where an open one stands.
                        pa.array(
                            [[t if content else None for t, content in blocks] if o else [] for blocks, o in zip(found, left, strict=True)],
                            pa.list_(pa.string()),
                        ),
                    ],
                    names=["page_id", "url", "text", "open", "settled"],
                )

    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = f"page_id {types[id_col]}, url {types[url_col]}, text string, open array<string>, settled array<string>"
    # The number of a row is stored, so it is the same wherever the table is read.
    parsed = materialize(pages.mapInArrow(parse, schema).withColumn("row", F.monotonically_increasing_id()), "pages")
    settled = parsed.filter(F.size("open") == 0).select("page_id", "url", "text")

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    left = parsed.filter(F.size("open") > 0).select("row", "page_id", "url", "open", "settled", host.alias("host"))
    left = left.withColumn("owner", F.xxhash64(F.col("page_id").isNull(), "page_id", "open", "settled"))
    size = F.aggregate("open", F.lit(0).cast("bigint"), lambda sum, block: sum + F.length(block))
    parts = F.greatest(F.ceil(F.count("*") / group_pages), F.ceil(F.sum(size) / group_chars))
    counts = left.groupBy("host").agg(parts.alias("parts"))
    grouped = left.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    # Blocks hold single blanks, see ``page_blocks``. Hosts of one group need no hashes.
    tokens = F.when(F.col("parts") > 1, F.flatten(F.transform("open", lambda b: F.split(b, " "))))
    grouped = grouped.withColumn("tokens", tokens).withColumn("windows", window_hashes(F.col("tokens"), run)).drop("tokens")
    held = materialize(
        grouped.filter("parts > 1")
        .select("host", "part", "owner", F.explode("windows").alias("hash"))
        .groupBy("host", "hash", "part")
        .agg(F.min("owner").alias("low"), F.max("owner").alias("high")),
        "windows",
    )
    repeated = held.groupBy("host", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    repeated = held.select("host", "hash", "part").join(repeated.filter("low < high").select("host", "hash"), ["host", "hash"])

    def strip(group: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        # Rows of one owner are one page and have the same blocks.
        first = group.drop_duplicates("owner")
        hashes = found["hash"].to_numpy(dtype=np.int64)
        known = [np.flatnonzero(np.isin(np.asarray(w, dtype=np.int64), hashes)) for w in first["windows"]] if len(hashes) else None
        kept = unique_blocks([list(b) for b in first["open"]], run, known)
        by_owner = {}
        for owner, opened, settled, stay in zip(first["owner"], first["open"], first["settled"], kept, strict=True):
            judged = iter([block if keep else None for block, keep in zip(opened, stay, strict=True)])
            found_blocks = [next(judged) if block is None else block for block in settled]
            by_owner[owner] = " ".join(block for block in found_blocks if block is not None)
        return pd.DataFrame({"page_id": group["page_id"], "url": group["url"], "text": group["owner"].map(by_owner)})

    stripped = (
        grouped.select("host", "part", "owner", "page_id", "url", "open", "settled", "windows")
        .groupBy("host", "part")
        .cogroup(repeated.groupBy("host", "part"))
        .applyInPandas(strip, f"page_id {types[id_col]}, url {types[url_col]}, text string")
    )
    return settled.unionByName(stripped)

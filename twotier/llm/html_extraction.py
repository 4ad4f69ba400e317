"""Main text of web pages by union-free wrappers.

A page is a stream of tags and texts; the stream of a page, as a tree of block elements
with their texts, is aligned step by step with those of the other pages of its host.
Texts become text slots, elements that one side lacks become optional, and runs of alike
elements or element groups become repeated groups: the result is the host's wrapper, a
regular expression without unions.  Its slots are where main text may stand; menus, notices
and the like are told by their element, class or role, by links outside an article element,
and by constant text.

A text is constant if it stands at one slot on more than half of the host's pages that have
that slot, so optional and repeated parts are judged by the pages that show them.  Pages of the
same main text count once and ``LEAST_PAGES`` of them are needed.  Inside an article a constant heading
stays if the text that it introduces varies.  Counts and slots are the same for any order of
the pages.  A page with slots inside an article has these as its text, another page of the
host the ones it has elsewhere.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, map_rows, read, shuffle_partitions

QUERY = "op2_html_extraction"
#: Pages of different text that a constant stands on at least.
LEAST_PAGES = 3
#: Slots of all hosts go to the tasks by a broadcast up to so many bytes, else by a join in
#: which a host's pages are dealt out over one share for each so many of them.
BROADCAST_BYTES = 32 << 20
SHARE_PAGES = 2000
#: Elements nested deeper than this count as part of the one at this depth.
DEEPEST = 120
#: A task hands on its wrappers when it holds those of so many hosts.
HOSTS_HELD = 2000
LONGEST_GROUP = 4

# Fixed lists of HTML element names, class words and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
UNSEEN = set("noscript script style template".split())  # they do not end the text around them
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
               "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "tbody": {"table"}, "body": {"html"}}
BANNED_TAGS = set("aside audio button canvas dialog footer form head header iframe input legend math menu nav noscript "
                  "object option script select style svg template textarea title video".split())
BANNED_WORDS = set("ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs consent cookie cookies footer "
                   "gdpr header login menu modal nav navbar navigation newsletter notice notices notification pagination "
                   "popup promo promotion related respond search share sharing sidebar signup social sponsor sponsored "
                   "subscribe toolbar widget".split())
COMMENT_WORDS = set("comment comments commentlist disqus replies reply".split())
HEADINGS = set("caption dt h1 h2 h3 h4 h5 h6 legend summary th".split())
CONTENT_WORDS = set("article body content entry main post story text".split())
BANNED_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
                    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


class Element:
    """A block element; ``parts`` are elements and (text, link share) pairs."""

    __slots__ = ("tag", "key", "parts")

    def __init__(self, tag: str, key: str):
        self.tag, self.key, self.parts = tag, key, []


def element_key(tag: str, attributes: str) -> str:
    """The tag with its class words, id and role; digits do not count."""
    if "=" not in attributes:
        return tag
    marks: dict[str, str] = {}
    for name, *values in _MARK.findall(attributes):
        marks.setdefault(name.lower(), re.sub("[0-9]+", "", "".join(values).lower()))
    words = sorted(set(marks.get("class", "").split()))
    return (tag + "".join(f".{w}" for w in words) + (f"#{marks['id'].strip()}" if marks.get("id", "").strip() else "")
            + (f"@{marks['role'].strip()}" if marks.get("role", "").strip() else "")).replace("/", "")


def parse(page: str | None) -> Element:
    """The page as a tree of block elements.  Inline elements are part of the text
    around them; comments, declarations and the insides of scripts, styles and the like
    are left out.  Unclosed and stray tags are forgiven.  What is nested deeper than
    ``DEEPEST`` becomes part of the element there, without the banned elements."""
    root = Element("", "")
    stack, text, links, in_link = [root], [], 0, 0
    open_tags: Counter = Counter()
    page = page or ""

    def flush() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            stack[-1].parts.append((joined, min(1.0, links / len(joined))))
        text.clear()
        links = 0

    def put(raw: str) -> None:
        nonlocal links
        decoded = entities.unescape(raw) if "&" in raw else raw
        text.append(decoded)
        if in_link:
            links += len(decoded.strip())

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        if token is None:
            put(page[at:])
            break
        put(page[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "br":
                text.append(" ")
            elif tag not in INLINE and open_tags[tag]:
                flush()
                in_link = 0
                while True:
                    closed = stack.pop().tag
                    open_tags[closed] -= 1
                    if closed == tag:
                        break
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            if tag not in UNSEEN:
                flush()
                stack[-1].parts.append(Element(tag, element_key(tag, token[3])))
            at = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
        elif tag in INLINE:
            if tag == "a":
                in_link += 1
            elif tag in ("br", "wbr", "img"):
                text.append(" " if tag != "wbr" else "")
        else:
            flush()
            in_link = 0
            if tag in CLOSES_P:
                _close(stack, open_tags, {"p"}, {"td", "th", "li", "table", "button", "object"})
            if tag in CLOSES:
                _close(stack, open_tags, CLOSES[tag], SCOPE[tag])
            element = Element(tag, element_key(tag, token[3]))
            if len(stack) <= DEEPEST:
                stack[-1].parts.append(element)
            elif not _banned(element.key):
                element.parts = stack[-1].parts
            if tag not in VOID:
                stack.append(element)
                open_tags[tag] += 1
    flush()
    return root


def _close(stack: list[Element], open_tags: Counter, tags: set[str], scope: set[str]) -> None:
    """Closes the outermost open element of ``tags`` that no element of ``scope`` holds."""
    if not any(open_tags[t] for t in tags):
        return
    cut = None
    for n in range(len(stack) - 1, 0, -1):
        if stack[n].tag in scope:
            break
        if stack[n].tag in tags:
            cut = n
    if cut is not None:
        open_tags.subtract(e.tag for e in stack[cut:])
        del stack[cut:]


# A wrapper is a list of items [key, repeated, optional, content]: for the key "#", a text slot, the content is
# the smallest link share of its texts; for another key it is a wrapper; a group of items that repeat
# together has the key "()".

def wrapper_of(element: Element) -> list:
    """The wrapper of one page: its tree with runs of alike siblings folded."""
    return fold([["#", False, False, part[1]] if isinstance(part, tuple) else [part.key, False, False, wrapper_of(part)]
                 for part in element.parts], set())


def page_mark(texts: list[tuple[str, bool, str]]) -> int:
    """A hash of a page's main text by its own tree: pages of one mark count as one."""
    words = [t for _, inside, t in texts if inside] or [t for _, _, t in texts]
    return _digest("\n".join(words))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _shape(item: list) -> str:
    return item[0] if item[0] != "()" else "(" + " ".join(_shape(i) for i in item[3]) + ")"


def _groups(items: list) -> set[tuple]:
    return {tuple(_shape(i) for i in item[3]) for item in items if item[0] == "()"}


def fold(items: list, known: set[tuple]) -> list:
    """Runs of one shape become one repeated item, runs of a sequence of up to four
    shapes a repeated group; a sequence of ``known`` becomes a group even if it stands once."""
    for width in range(1, LONGEST_GROUP + 1):
        out, at = [], 0
        while at < len(items):
            shape = [_shape(i) for i in items[at:at + width]]
            end = at + width
            while len(shape) == width and [_shape(i) for i in items[end:end + width]] == shape:
                end += width
            times = (end - at) // width
            if len(shape) < width or (times < 2 and (width == 1 or tuple(shape) not in known)):
                out.append(items[at])
                at += 1
                continue
            turns = [items[k:k + width] for k in range(at, end, width)]
            merged = turns[0]
            for turn in turns[1:]:
                merged = [_join(a, b) for a, b in zip(merged, turn)]
            out.append([merged[0][0], True, merged[0][2], merged[0][3]] if width == 1 else ["()", times > 1, False, merged])
            at = end
        items = out
    return items


def _join(a: list, b: list) -> list:
    """Two items of one shape as one."""
    content = min(a[3], b[3]) if a[0] == "#" else align(a[3], b[3])
    return [a[0], a[1] or b[1], a[2] or b[2], content]


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers: the longest common sequence of shapes is joined,
    what only one side has becomes optional."""
    known = _groups(a) | _groups(b)
    if known:
        a, b = fold(a, known), fold(b, known)
    x, y = [_shape(i) for i in a], [_shape(i) for i in b]
    out, n = [], 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        out.append(_join(a[n], b[n]))
        n += 1
    a, b, x, y = a[n:], b[n:], x[n:], y[n:]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(_join(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], a[i][1], True, a[i][3]])
            i += 1
        else:
            out.append([b[j][0], b[j][1], True, b[j][3]])
            j += 1
    return fold(out, set())


def merged(a: list, b: list) -> list:
    """The wrapper of two sets of pages; pages that are the same tell nothing."""
    return a if a == b else align(a, b)


@lru_cache(10_000)
def _banned(key: str) -> bool:
    """True for an element that holds no main text by its tag, class words, id or role."""
    tag = re.split(r"[.#@]", key, maxsplit=1)[0]
    if tag in BANNED_TAGS:
        return True
    role = key.partition("@")[2]
    if role in BANNED_ROLES:
        return True
    for name in re.split(r"[.#]", key.partition("@")[0])[1:]:
        words = set(re.split(r"[^a-z]+", name))
        if words & COMMENT_WORDS or (words & BANNED_WORDS and not words & CONTENT_WORDS):
            return True
    return False


def _article(key: str) -> bool:
    return re.split(r"[.#@]", key, maxsplit=1)[0] in ("article", "main") or key.endswith("@main")


def texts_of(element: Element, path: str = "", inside: bool = False) -> Iterator[tuple[str, bool, str]]:
    """The texts of a page outside banned elements: path, whether an article (or main)
    element holds it, and text."""
    for part in element.parts:
        if isinstance(part, tuple):
            yield path, inside, part[0]
        elif not _banned(part.key):
            yield from texts_of(part, f"{path}/{part.key}", inside or _article(part.key))


def main_slots(wrapper: list) -> list[str]:
    """The paths (keys from the root) of the wrapper's text slots that may hold main text: all
    outside banned elements and, outside an article (or main) element, none of links only."""
    least: dict[tuple[str, bool], float] = {}

    def walk(items: list, path: str, inside: bool) -> None:
        for key, _, _, content in items:
            if key == "#":
                least[path, inside] = min(content, least.get((path, inside), 1.0))
            elif key == "()":
                walk(content, path, inside)
            elif not _banned(key):
                walk(content, f"{path}/{key}", inside or _article(key))

    walk(wrapper, "", False)
    return sorted({path for (path, inside), links in least.items() if inside or links < 0.6})


def page_text(page: str | None, slots: set[str], constants: set[int]) -> str:
    """The texts of a page that its host's slots hold, one block a line: those inside an
    article (or main) element, or all of them on a page without any there.  Constants go, but
    for headings in an article whose next text that is no heading varies."""
    found = [(path, inside, text, _digest(f"{path}\n{text}") in constants)
             for path, inside, text in texts_of(parse(page)) if path in slots]
    out, varies = [], False
    for path, inside, text, constant in reversed(found):
        heading = re.split(r"[.#@]", path.rpartition("/")[2], maxsplit=1)[0] in HEADINGS
        if not heading:
            varies = not constant
        if not constant or (heading and inside and varies):
            out.append((inside, text))
    out.reverse()
    return "\n".join([text for inside, text in out if inside] or [text for _, text in out])


WRAPPERS = "host string, wrapper string, pages bigint"


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    """One wrapper for each value of ``keys`` (host first), aligned in one sorted pass."""
    schema = rows.sparkSession.createDataFrame([], WRAPPERS).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper, pages = None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key == now:
                    wrapper, pages = merged(wrapper, json.loads(row["wrapper"])), pages + row["pages"]
                    continue
                if now is not None:
                    done.append((now[0], json.dumps(wrapper), pages))
                now, wrapper, pages = key, json.loads(row["wrapper"]), row["pages"]
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done)))))
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pydict({"host": [now[0]], "wrapper": [json.dumps(wrapper)], "pages": [pages]})

    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "wrapper").mapInArrow(run, schema)


def host_of(url):
    """Column: the lower-cased host of a url, empty for none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.lower(rest)


def wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of each host, inferred from all its pages: host, wrapper (JSON) and
    pages.  ``pages`` has host and html."""
    schema = pages.sparkSession.createDataFrame([], WRAPPERS).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "host": list(held), "wrapper": [json.dumps(w) for w, _ in held.values()],
                "pages": [n for _, n in held.values()]}, schema=arrow)
            held.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = wrapper_of(parse(page))
                if host in held:
                    held[host] = [merged(held[host][0], own), held[host][1] + 1]
                else:
                    held[host] = [own, 1]
            if len(held) >= HOSTS_HELD:
                yield handed()
        if held:
            yield handed()

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    partial = kept(pages.select("host", "html").mapInArrow(run, schema), "wrappers")
    parts = partial.groupBy("host").agg(F.ceil(F.sqrt(F.count("*"))).alias("shares"))
    shared = partial.join(parts, "host").withColumn("share", F.pmod(F.xxhash64("wrapper"), "shares"))
    return _merged(_merged(shared.select(*partial.columns, "share"), "host", "share"), "host")


def constants(pages: DataFrame) -> DataFrame:
    """(host, constants): the hashes of (path, text) that are constant on each host."""
    def make():
        def work(hosts, html):
            out = set()
            for host, page in zip(hosts, html):
                texts = list(texts_of(parse(page)))
                mark = page_mark(texts)
                out.update((host, _digest(path), _digest(f"{path}\n{text}"), mark) for path, _, text in texts)
            return list(zip(*out)) if out else [[]]
        return work

    seen = map_rows(pages, ["host", "html"], make, "host string, path bigint, text bigint, mark bigint").distinct()
    seen = kept(seen, "texts")
    paths = seen.select("host", "path", "mark").distinct().groupBy("host", "path").agg(F.count("*").alias("pages"))
    texts = seen.groupBy("host", "path", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return (texts.join(paths, ["host", "path"]).where("2 * n > pages")
            .groupBy("host").agg(F.sort_array(F.collect_set("text")).alias("constants")))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A null or empty page, and one without main text, has an empty text.  Pages with a
    null url or one without a host share the wrapper of the empty host.  Repeated rows are rows like
    others; an empty table gives an empty result.  No column but page_id, url and html is read.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def make():
        return lambda hosts, found: [hosts, [main_slots(json.loads(w)) for w in found]]

    slots = map_rows(wrappers(pages), ["host", "wrapper"], make, "host string, slots array<string>")
    slots = kept(slots.join(constants(pages), "host", "left").withColumnRenamed("host", "slot_host"), "slots")

    def extract():
        made: dict[tuple, tuple[set, set]] = {}

        def work(ids, urls, page, own, fixed):
            out = []
            for p, s, c in zip(page, own, fixed):
                key = tuple(s or ()), tuple(c or ())
                if key not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[key] = set(key[0]), set(key[1])
                out.append(page_text(p, *made[key]))
            return [ids, urls, out, [len(t) for t in out]]
        return work

    same = F.col("host") == F.col("slot_host")
    size = slots.agg(F.sum(F.length(F.array_join("slots", " ")) + 8 * F.coalesce(F.size("constants"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(slots), same, "left")
    else:  # a copy of a host's slots for each share of its pages
        shares = pages.groupBy(F.col("host").alias("slot_host")).agg(F.ceil(F.count("*") / SHARE_PAGES).cast("int").alias("shares"))
        slots = slots.join(shares, "slot_host").withColumn("slot_share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        most = shares.agg(F.max("shares")).first()[0]
        # the draw is the same for all hosts; a host folds it into its own number of shares
        dealt = pages.withColumn("draw", F.pmod(F.xxhash64("page_id", "url"), F.lit(most)).cast("int"))
        slots = slots.withColumn("draw_of", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).where("draw_of % shares = slot_share")
        joined = dealt.join(slots, same & (F.col("draw") == F.col("draw_of")), "left")
    kind = dict(pages.dtypes)["page_id"]
    return map_rows(joined, ["page_id", "url", "html", "slots", "constants"], extract,
                    f"page_id {kind}, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))

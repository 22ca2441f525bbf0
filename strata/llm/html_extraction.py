"""Main-text extraction by equivalence-class template deduction (operator 4).

A page is a sequence of tag tokens, each told apart by its path (``html/body/article/p``).  Over the pages of one
host, tokens with the same occurrence vector (the same number of occurrences on every page) form an equivalence
class.  An occurrence vector is never gathered: it is represented by two sums, over pages, of hashes of (page,
count), which Spark adds up map-side; tokens of equal sums are one class.  A class takes part when its tokens are on
half of the host's pages or more; one whose tokens stand at most once on a page is the template's skeleton.

Classes are made valid: tokens of one vector that lie in different slots are classes of their own, so that each
class lies whole in one slot (nested), and a class whose tokens do not take turns in one order on every page that has
them (t1 t2 t1 t2 ...) is cut into single tokens (ordered; checked page by page on the landed places of the tokens).
What is left nests: ``outer`` is the token of the enclosing class in whose slot a class lies.  The article slot is
opened by a skeleton token that lies in skeleton slots only; one inside a repeated slot is a record of a list.

The slots that are menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments (by the names
of the template tags around them, or by their own), and markup, go; the rest of the article slot is the text.
Where a page has an article or main slot, text outside it goes too; text that repeats from page to page stays if it
stands in the article.

Where a page has neither, the template decides by content: a block of text that recurs in the same slot on half of
the host's pages or more, and on two at least, is the template's and goes; what varies is the text, and names are
asked only about that.  Pages of equal text count once, so copies do not make their text a template.  Blocks are
counted as hashes, (host, block, page) made distinct map-side first.

Pages meet their host's template in one join on the host; the template side is a checkpointed table, so a host
with a third of all pages is split by adaptive execution.  A template holds only tokens found on half of the
host's pages or more, hence at most twice the tokens of an average page, and of blocks likewise.

Defined results: null and empty html give an empty text; a host with one page has that page as its template;
pages without article or main keep all text neither
recurring nor excluded; unclosed and truncated markup is read as far as it
goes; a null or odd url is a host of its own (''); repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import cut, land, map_columns, shared_dir, table

#: One whole attribute: its name, and its value, which is never searched for names.  A quote opens a value only where the
#: value begins, and only if it is closed.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]*+))?"""
ATTRIBUTE = re.compile(_ATTRIBUTE)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?>[\s/]++|"
                   + _ATTRIBUTE.replace("([^", "(?:[^", 1).replace('("', '(?:"') + r")*+)(?:>|\Z)", re.S)

#: Elements without an end tag, elements whose content is text, elements that do not break a block (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
#: An open p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A second one of the same name ends the first.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"},
            "tbody": {"thead", "tr", "td", "th"}}
#: Containers that never hold main text.
EXCLUDED = frozenset("head nav footer aside form button select option dialog menu script style title noscript iframe "
                     "template svg math textarea object canvas audio video noembed noframes xmp input".split())
#: Elements that hold text rather than parts of a page: in the article their names speak of their text.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr caption pre blockquote figure figcaption address details "
                    "summary".split())
#: The article by itself, else the main part.
MAIN = {"article": 2, "main": 1}
#: Class, id or role words of a page's own header (an article's header belongs to the article).
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Words in class, id or role that mark a container as no main text.
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored "
                      "promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside "
                      "footer cookie cookies consent notice notices alert gdpr popup modal newsletter "
                      "subscribe signup login share social related comment comments disqus respond replies reply "
                      "form search widget toolbar pagination pager copyright legal skip "
                      "contentinfo complementary dialog".split())
#: Of these, words that name what a part of an article is about (a div of legal remarks, of search tips).
ARTICLE_WORDS = frozenset("legal copyright search form skip".split())
WORD = re.compile(r"[A-Za-z]+")
#: Longer paths are hashed, so that deeply nested pages stay linear.
PATH_CHARS = 512

#: Least share of the host's pages a token of the template is found on, as a fraction (numerator, denominator).
SUPPORT = (1, 2)


class Node:
    """One open element: its path token, whether it or one around it is excluded, and what its name says of the text
    inside."""

    __slots__ = ("name", "path", "parent", "excluded", "main", "inside", "slot")

    def __init__(self, name: str, path: str, parent: str, excluded: bool, main: int, inside: bool, slot: str) -> None:
        self.name, self.path, self.parent, self.excluded, self.main = name, path, parent, excluded, main
        self.inside = inside
        self.slot = slot  # the path without inline elements at its end


def _role(name: str, attributes: str, inside_main: bool) -> tuple[str, bool, int]:
    """(name as token, excluded, main) of an element."""
    if name in EXCLUDED or name == "header" and not inside_main:
        return name, True, 0
    excluded, main, label = False, MAIN.get(name, 0), name
    if attributes.strip():
        marks = set()
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value.strip() == "true":
                excluded = True
            elif key in ("class", "id", "role"):
                marks |= set(WORD.findall(value))
                if key == "role":
                    main = max(main, MAIN.get(value, 0))
        if marks:
            label = f"{name}.{'.'.join(sorted(marks))}"
            if name not in ("html", "body") and not (main and name in MAIN and not marks & {"comment", "ad"}):
                # in the article the names of headings and inline elements speak of their text (id="related-work")
                named = not (inside_main and (name in TEXTUAL or name in INLINE))
                excluded = (excluded or named and bool(marks & (BAD_WORDS - ARTICLE_WORDS if inside_main else BAD_WORDS))
                            or bool(marks & HEADER_WORDS) and not inside_main)
    return label, excluded, 0 if excluded else main


def child_path(parent: str, label: str) -> str:
    path = f"{parent}/{label}"
    return path if len(path) <= PATH_CHARS else f"#{xxhash.xxh3_128_hexdigest(path)}"


def parse(page: str) -> Iterator[tuple[str, object, object]]:
    """("open", node, None), ("text", text, node) and ("break", None, node) in page order."""
    root = Node("", "", "", False, 0, False, "")
    stack, at, end = [root], 0, len(page)
    opened: Counter = Counter()  # open elements by name
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], stack[-1]
            return
        if m.start() > at:
            yield "text", page[at:m.start()], stack[-1]
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if opened[name]:
                closed = stack.pop()
                opened[closed.name] -= 1
                while closed.name != name:
                    closed = stack.pop()
                    opened[closed.name] -= 1
                if name not in INLINE:
                    yield "break", None, closed
            elif name in ("p", "br"):
                yield "break", None, stack[-1]
            continue
        if name in ENDS_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    opened.subtract(n.name for n in stack[k:])
                    del stack[k:]
                    break
                if stack[k].name not in INLINE:
                    break
        if name in SIBLINGS:
            ends = SIBLINGS[name]
            while stack[-1].name in ends or stack[-1].name in INLINE and any(
                    n.name in ends for n in stack[-3:-1]):
                opened[stack.pop().name] -= 1
        parent = stack[-1]
        label, excluded, main = _role(name, m[3], parent.inside)
        if parent.excluded:
            excluded, main = True, 0
        path = child_path(parent.path, label)
        node = Node(name, path, parent.path, excluded, main, parent.inside or main > 0,
                    parent.slot if name in INLINE else path)
        yield "open", node, None
        if name not in INLINE:
            yield "break", None, node
        if name in VOID or m[3].endswith("/") and name in ("svg", "path", "math"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            yield "break", None, node
            continue
        stack.append(node)
        opened[name] += 1


def occurrences(page: str) -> dict[str, tuple[str, list[int]]]:
    """Path token -> (its parent's path, its positions)."""
    found: dict[str, tuple[str, list[int]]] = {}
    position = 0
    for kind, node, _ in parse(page):
        if kind == "open":
            found.setdefault(node.path, (node.parent, []))[1].append(position)
            position += 1
    return found


def _token_id(path: str) -> int:
    return xxhash.xxh64_intdigest(path) >> 1


def host_column() -> object:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, key (of the page), token, id, parent (its id), positions: a row for every token of a page."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        for hosts, keys, texts in slices:
            out = []
            for host, key, text in zip(hosts, keys, texts):
                # a page without tags still counts as a page of its host
                rows = {"": ("", [0]), **occurrences(text or "")}
                out += [(host, key, token, _token_id(token), _token_id(parent), positions)
                        for token, (parent, positions) in rows.items()]
            yield list(zip(*out))

    return map_columns(pages.select(host_column().alias("host"), F.coalesce(F.xxhash64("page_id", "html"),
                                                                            F.lit(0)).alias("key"), "html"),
                       ["host", "key", "html"],
                       "host string, key long, token string, id long, parent long, positions array<int>", run)


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """host, token, id, parent, h1, h2, n_pages, place, most: tokens with their occurrence vectors' hashes."""
    count, first = F.size("positions"), F.element_at("positions", 1)
    vectors = tokens.select("host", "token", "id", "parent", F.xxhash64("key", count).alias("v1"),
                            F.xxhash64(count, "key").alias("v2"), first.cast("long").alias("first"), count.alias("count"))
    # sums of hashes wrap: xor keeps them in 64 bits, the sum of the upper halves in a long
    return vectors.groupBy("host", "token", "id").agg(
        F.min("parent").alias("parent"), F.bit_xor("v1").alias("h1"), F.sum(F.shiftright("v2", 32)).alias("h2"),
        F.count("*").alias("n_pages"), F.sum("first").alias("place"), F.max("count").alias("most"))


def nest(tokens: list[dict]) -> list[tuple]:
    """(id, token, class, place in the class, tokens of the class, outer token, parent token, skeleton) of a host's
    frequent tokens: a class is the tokens of one vector in the slot of one token of another vector."""
    by_id = {t["id"]: t for t in tokens}
    vector = {t["id"]: (t["h1"], t["h2"], t["n_pages"], t["most"]) for t in tokens}
    outer: dict[int, int | None] = {}
    classes = defaultdict(list)
    # of tokens of one vector a parent's place is the lower one
    for t in sorted(tokens, key=lambda t: (t["place"], t["token"])):
        own, parent = t["id"], t["parent"]
        inside = parent in by_id and parent != own
        outer[own] = (outer[parent] if vector[parent] == vector[own] else parent) if inside else None
        classes[vector[own], outer[own]].append(t)
    path = lambda i: by_id[i]["token"] if i in by_id else ""
    in_page_order = sorted(classes.items(), key=lambda kv: (kv[1][0]["place"] / kv[1][0]["n_pages"], kv[1][0]["token"]))
    return [(t["id"], t["token"], n, at, len(members), path(lies_in), path(t["parent"]), t["most"] == 1)
            for n, ((_, lies_in), members) in enumerate(in_page_order) for at, t in enumerate(members)]


def unordered_classes(tokens: DataFrame, members: DataFrame) -> DataFrame:
    """host, class: those whose tokens do not take turns in their order on some page."""
    met = tokens.join(members.filter("size > 1").select("host", "id", "class", "at"), ["host", "id"])
    # a repeated page gives equal rows
    on_page = met.groupBy("host", "class", "key").agg(F.array_sort(F.collect_set(F.struct("at", "positions"))).alias("_t"))
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.size(F.col("_t")[0]["positions"])),
                                  lambda i: F.transform("_t", lambda t: F.element_at(t["positions"], i))))
    return on_page.select("host", "class", turns.alias("_turns")).filter(
        F.col("_turns") != F.array_sort("_turns")).select("host", "class").distinct()


def templates(pages: DataFrame) -> DataFrame:
    """host, classes: the host's valid classes in page order, each with the token in whose slot it lies."""
    folder = f"{shared_dir(pages.sparkSession).rstrip('/')}/pages-{uuid.uuid4().hex}"
    tokens = land(page_tokens(pages), f"{folder}/tokens")
    classes = cut(equivalence_classes(tokens))
    totals = classes.filter("token = ''").select("host", F.col("n_pages").alias("pages"))
    up, down = SUPPORT
    frequent = (classes.filter("token <> ''").join(totals, "host")
                .filter(F.col("n_pages") * down >= F.col("pages") * up))
    fields = ("id", "token", "parent", "h1", "h2", "n_pages", "most", "place")
    gathered = frequent.groupBy("host").agg(F.collect_list(F.struct(*fields)).alias("tokens"))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for hosts, found in slices:
            for host, own in zip(hosts, found):
                yield list(zip(*[(host, *row) for row in nest(own)]))

    members = land(map_columns(gathered, ["host", "tokens"], "host string, id long, token string, class int, at int, size int, "
                                                             "outer string, parent string, skeleton boolean", run), f"{folder}/classes")
    broken = unordered_classes(tokens, members).withColumn("_single", F.lit(True))
    alone = F.coalesce("_single", F.lit(False))
    valid = (members.join(broken, ["host", "class"], "left")
             .groupBy("host", "class", F.when(alone, F.col("at")).otherwise(0).alias("place"), "skeleton",
                      F.when(alone, F.col("parent")).otherwise(F.col("outer")).alias("outer"))
             .agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("tokens")))
    ordered = valid.select("host", F.struct("class", "place", "outer", "skeleton",
                                            F.transform("tokens", lambda x: x["token"]).alias("tokens")).alias("class"))
    return ordered.groupBy("host").agg(F.array_sort(F.collect_list("class")).alias("classes"))


class Template:
    """A host's nested template: its skeleton, and the token in whose slot each token lies."""

    def __init__(self, classes: Iterable | None, fixed: Iterable[int] | None = None) -> None:
        self.outer = {t: c["outer"] for c in classes or () for t in c["tokens"]}
        self.skeleton = {t for c in classes or () if c["skeleton"] for t in c["tokens"]}
        self.fixed = set(fixed or ())

    def in_skeleton(self, token: str) -> bool:
        """Whether the token and all tokens around it stand at most once on a page."""
        while token in self.skeleton:
            token = self.outer[token]
        return not token

    def article(self, paths: set[str]) -> set[str]:
        """Of a page's article paths those that the template knows as the article slot, else all."""
        once = paths & self.skeleton
        return {p for p in once if self.in_skeleton(p)} or once or paths


def article_paths(found: list, template: Template) -> set[str]:
    """The article slot (else the main one) of a page, opened by a token of the template's skeleton (teasers are not in
    it), else by any such token of the page."""
    opened = {n.path: n.main for kind, n, _ in found if kind == "open" and n.main}
    best = max(opened.values(), default=0)
    return template.article({p for p, rank in opened.items() if rank == best})


def text_blocks(found: list, inner: set[str], outside: bool = False) -> Iterator[tuple[str, str]]:
    """(slot, text) of a page's blocks that are not excluded, in page order: those in ``inner`` (all if it is empty),
    or those outside it."""
    within: dict[str, bool] = {"": "" in inner}  # paths come after those they lie in
    block, slot = [], None
    for kind, value, node in [*found, ("break", None, None)]:
        if kind == "open":
            if value.path not in within:
                within[value.path] = within[value.parent] or value.path in inner
        elif kind == "text" and not node.excluded:
            if not inner or outside != within[node.path]:
                block.append(value)
                if slot is None and not value.isspace():
                    slot = node.slot
        elif kind == "break" and block:
            text = " ".join(html.unescape("".join(block)).split())
            if text:
                yield slot or "", text
            block, slot = [], None


def _block_hash(slot: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{slot}\n{text}") >> 1


def recurring_blocks(pages: DataFrame) -> DataFrame:
    """host, fixed: hashes of the blocks outside articles that the host's pages share; pages of equal text are one."""
    def run(slices: Iterator[list]) -> Iterator[list]:
        unknown = Template(None)
        for hosts, texts in slices:
            out = []
            for host, page in zip(hosts, texts):
                found = list(parse(page or ""))
                whole = xxhash.xxh64()
                for _, text in text_blocks(found, set()):
                    whole.update(text + "\n")
                key = whole.intdigest() >> 1
                out.append((host, -1, key))  # the page itself
                blocks = text_blocks(found, article_paths(found, unknown), outside=True)
                out += [(host, h, key) for h in {_block_hash(slot, text) for slot, text in blocks}]
            yield list(zip(*out))

    seen = map_columns(pages.select(host_column().alias("host"), "html"), ["host", "html"],
                       "host string, block long, page long", run)
    counts = cut(seen.distinct().groupBy("host", "block").agg(F.count("*").alias("n")))
    totals = counts.filter("block = -1").select("host", F.col("n").alias("pages"))
    up, down = SUPPORT
    return (counts.filter("block >= 0 and n >= 2").join(totals, "host")
            .filter(F.col("n") * down >= F.col("pages") * up)
            .groupBy("host").agg(F.collect_list("block").alias("fixed")))


def extract(page: str, classes: list | None, fixed: list | None = None) -> str:
    """Main text of a page under its host's template: its nested classes and its slots' recurring blocks."""
    template = Template(classes, fixed)
    found = list(parse(page))
    inner = article_paths(found, template)
    recurs = set() if inner else template.fixed
    return " ".join(text for slot, text in text_blocks(found, inner)
                    if not recurs or _block_hash(slot, text) not in recurs)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text; one row per row of ``pages``."""
    shared = recurring_blocks(pages).withColumnRenamed("host", "_with")
    known = templates(pages).withColumnRenamed("host", "_host")
    known = cut(known.join(shared, F.col("_host") == F.col("_with"), "full")
                .select(F.coalesce("_host", "_with").alias("_host"), "classes", "fixed"))
    joined = (pages.select("page_id", "url", "html", host_column().alias("host"))
              .join(known, F.col("host") == F.col("_host"), "left"))

    def run(slices: Iterator[list]) -> Iterator[list]:
        for ids, urls, pages_, classes, fixed in slices:
            yield [ids, urls, [extract(p or "", c, x) for p, c, x in zip(pages_, classes, fixed)]]

    return map_columns(joined, ["page_id", "url", "html", "classes", "fixed"],
                       "page_id long, url string, text string", run)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

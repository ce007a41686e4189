"""HTML extraction: union-free wrappers of a host's pages say where the article is."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import written
from .forest_join import grouped

#: Elements without content, elements whose content is no markup, and elements that make a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var".split())
#: Elements and words of a class or id that mark what is not the article.
ASIDE = frozenset("nav footer aside form button select input dialog head menu object audio video canvas map".split()) | set(RAW)
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
                        "notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
                        "masthead comment comments respond replies discussion disqus share sharing social related recommended "
                        "newsletter subscribe subscription signup login search widget skip toolbar pagination pager "
                        "werbung anzeige anzeigen kommentar kommentare hinweis fusszeile seitenleiste publicite annonce annonces commentaire "
                        "commentaires publicidad anuncio anuncios comentario comentarios pubblicita commenti propaganda".split())
IN_ARTICLE = re.compile(r"/(?:article|main)(?:[./]|$)")
#: Tags of a head's own elements (any other ends it), and the tenths of the text that are most of it.
HEAD = frozenset("head title base link meta script style noscript template".split())
MOST = 8
#: A host's pages are dealt to so many slices, each with a wrapper of its own, before the slices' wrappers are merged.
SLICES = 32
#: Rules of hosts that may be broadcast; beyond it pages meet them in a join on host and a salt.
BROADCAST_HOSTS, SALTS = 20_000, 64
_HEAD = (r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?P<a>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
         r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>")
_TAIL = r")(?:>|(?P<cut>\Z))|<[!?/][^>]*(?:>|\Z)|[^<]+|<"
#: Tokens of a page, each read once: a quote holds up to its partner, one without a partner is a letter. Should quotes run on to the end
#: of the page, the rest is read without regard to them.
TOKEN = re.compile(_HEAD + r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|\"(?![^\"]*\")|'(?![^']*'))*+" + _TAIL, re.S | re.I)
PLAIN = re.compile(_HEAD + r"[^>]*+" + _TAIL, re.S | re.I)
#: Levels of a page that are kept as such; what lies deeper follows in page order as places of the last level, so nothing is lost and
#: no walk goes deeper.
DEPTH = 150
#: Children that two places may have for an exact alignment; longer lists are matched by the keys that are unique in both.
EXACT = 250_000
NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that an opening tag closes, up to the nearest of the elements that bound them.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BOUNDS = frozenset("table ul ol dl div article section main body html nav aside footer header blockquote td th form".split())


class Node:
    """An element or a place of a wrapper: ``key`` (tag and class words), the aligned children, whether it may be
    missing or repeated, and how many pages and characters of own text it has seen."""

    __slots__ = ("key", "kids", "optional", "repeated", "pages", "chars")

    def __init__(self, key, kids=None, optional=False, repeated=False, pages=1, chars=0):
        self.key, self.kids, self.optional, self.repeated = key, kids if kids is not None else [], optional, repeated
        self.pages, self.chars = pages, chars

    def pack(self):
        return [self.key, [k.pack() for k in self.kids], self.optional, self.repeated, self.pages, self.chars]

    @classmethod
    def unpack(cls, x):
        return cls(x[0], [cls.unpack(k) for k in x[1]], *x[2:])


def key_of(tag: str, attrs: str) -> str:
    names = " ".join(a or b or c for a, b, c in NAME.findall(attrs)) if "=" in attrs else ""
    words = sorted({re.sub(r"\d+", "", w) for w in re.split(r"[^A-Za-z0-9]+", names.lower())} - {""})
    return ".".join([tag, *words])


def aside(key: str, path: str = "") -> bool:
    """Whether a place is none of the article's; a header is one only where no article or main place is above it."""
    tag, *words = key.split(".")
    if tag == "header" and not IN_ARTICLE.search(path):
        return True
    return tag in ASIDE or tag not in ("html", "body", "article", "main") and not ASIDE_WORDS.isdisjoint(words)


def tokens(source: str):
    """Matches of the page's tokens, in time proportional to its length."""
    pattern, at, end = TOKEN, 0, len(source)
    while at < end:
        m = pattern.match(source, at)
        if m["cut"] is not None and pattern is TOKEN:
            pattern = PLAIN
            continue
        yield m
        at = m.end()


def tree(source: str, texts: bool = False):
    """The page as nested ``[key, children]``; texts are strings (left out unless ``texts``: only their length then).

    Tags close what they must, and text or an element that is none of a head's own closes the head; a tag that the end
    of the page cuts off is dropped, and so is an end without a start. Beyond ``DEPTH`` levels elements are put beside each
    other; one inside an aside there keeps the aside's key.
    """
    root: list = ["", [], ""]
    stack = [root]
    opened: Counter = Counter()

    def close(i: int) -> None:
        opened.subtract(n[2] for n in stack[i:])
        del stack[i:]

    def body(tag: str) -> None:
        if stack[-1][2] == "head" and tag not in HEAD:
            close(len(stack) - 1)

    def add(child) -> None:
        """Put a text or an element where the page has it."""
        if len(stack) <= DEPTH + 1:
            stack[-1][1].append(child)
            return
        siblings, now = stack[DEPTH][1], stack[-1]
        if isinstance(child, list):
            if (mark := now[3]) is not None:
                child[0], child[3] = mark, mark
            siblings.append(child)
            return
        if siblings[-1] is not now:  # text behind an inner element: the outer one goes on
            now = stack[-1] = [now[0], [], now[2], now[3]]
            siblings.append(now)
        now[1].append(child)

    for m in tokens(source):
        tag = m["tag"]
        if tag is None:
            raw = m["raw"]
            if raw is not None:
                body(raw.lower())
                add([raw.lower(), [], raw.lower(), None])
                continue
            s = m[0]
            if s[0] != "<" or s == "<":
                if not s.isspace():
                    body("")
                add(s if texts else len(s.strip()))
            continue
        if m["cut"] is not None:
            continue
        tag = tag.lower()
        if m["end"]:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][2] == tag))
            continue
        body(tag)
        if tag in CLOSES or tag not in INLINE and tag not in VOID:
            shut = CLOSES.get(tag, {"p"})
            if any(opened[t] > 0 for t in shut):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][2] in shut:
                        close(i)
                        break
                    if stack[i][2] in BOUNDS:
                        break
        key = key_of(tag, m["attrs"])
        node = [key, [], tag, key if len(stack) > DEPTH and aside(key) else None]
        add(node)
        if tag not in VOID and not m["attrs"].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


def wrapper_of(node) -> Node:
    """A page's own wrapper: runs of equal siblings become one repeated place, with their contents aligned."""
    out = Node(node[0])
    for kid in node[1]:
        if isinstance(kid, int):
            out.chars += kid
            continue
        place = wrapper_of(kid)
        if out.kids and out.kids[-1].key == place.key:
            last = out.kids[-1] = align(out.kids[-1], place)
            last.repeated, last.pages = True, 1
        else:
            out.kids.append(place)
    return out


def matched(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Places of two lists with equal keys, in order: as many as possible, or for long lists the longest rising run of the keys
    that occur once in both, in n log n steps."""
    if len(x) * len(y) <= EXACT:
        most = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                most[i][j] = most[i + 1][j + 1] + 1 if x[i].key == y[j].key else max(most[i + 1][j], most[i][j + 1])
        i = j = 0
        found = []
        while i < len(x) and j < len(y):
            if x[i].key == y[j].key:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif most[i + 1][j] >= most[i][j + 1]:
                i += 1
            else:
                j += 1
        return found
    once_x, once_y = Counter(k.key for k in x), Counter(k.key for k in y)
    at = {k.key: j for j, k in enumerate(y) if once_y[k.key] == 1}
    pairs = [(i, at[k.key]) for i, k in enumerate(x) if once_x[k.key] == 1 and k.key in at]
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        tails[place:place + 1], ends[place:place + 1] = [j], [n]
        before[n] = ends[place - 1] if place else -1
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def align(a: Node, b: Node) -> Node:
    """Merges two places with one key. Children are matched in order, as many as possible; a mismatch becomes an
    optional place, or a repetition where it stands beside a place of the same key; texts become slots."""
    out = Node(a.key, [], a.optional or b.optional, a.repeated or b.repeated, a.pages + b.pages, a.chars + b.chars)
    x, y = a.kids, b.kids
    if [k.key for k in x] == [k.key for k in y]:
        out.kids = [align(p, q) for p, q in zip(x, y)]
        return out
    pairs = matched(x, y)
    i = j = 0
    kids: list[Node] = []
    for p, q in [*pairs, (len(x), len(y))]:
        for odd in x[i:p] + y[j:q]:
            if kids and kids[-1].key == odd.key:
                kids[-1] = align(kids[-1], odd)
                kids[-1].repeated = True
            else:
                odd.optional = True
                kids.append(odd)
        if p < len(x):
            kids.append(align(x[p], y[q]))
        i, j = p + 1, q + 1
    out.kids = kids
    return out


def weight(node: Node, path: str = "", opened: frozenset | set = frozenset()) -> int:
    """Characters outside of asides, but for those ``opened``."""
    if aside(node.key, path) and path not in opened:
        return 0
    return node.chars + sum(weight(k, f"{path}/{k.key}", opened) for k in node.kids)


def opened_in(node: Node, path: str, opened: set[str]) -> int:
    """Characters of a place outside of the asides in it. A form, or what is an aside by its words only, is none if it
    holds most of the place's text: its path is added to ``opened``, and its own text counts."""
    own = node.chars
    odd: dict[str, list] = {}

    def walk(n: Node, at: str) -> None:
        nonlocal own
        for k in n.kids:
            here = f"{at}/{k.key}"
            if not aside(k.key, here):
                own += k.chars
                walk(k, here)
            elif k.key.split(".")[0] not in (ASIDE | {"header"}) - {"form"}:
                inner: set[str] = set()
                chars = opened_in(k, here, inner)
                held = odd.setdefault(here, [0, set()])
                held[0] += chars
                held[1] |= inner

    walk(node, path)
    if odd:
        here, (chars, inner) = max(odd.items(), key=lambda x: (x[1][0], x[0]))
        if chars and chars * 10 >= (own + chars) * MOST:
            opened |= {here} | inner
            own += chars
    return own


def regions(root: Node) -> tuple[list[str], list[str]]:
    """Paths of the places that hold the article, and of the places that look like asides but are none: the outermost
    ``article`` places, else ``main``, else the deepest place that holds most of the text outside of menus and the like.

    Places under an aside count where no other has text, unless most of the text is outside of all asides (teasers in
    a sidebar). An aside that holds the chosen places is none, nor one that holds most of their text (``opened_in``).
    """
    plain = weight(root)

    def seek(node: Node, path: str, tag: str, above: frozenset, found: dict) -> dict:
        for k in node.kids:
            at = f"{path}/{k.key}"
            name, *words = k.key.split(".")
            if name == tag or tag == "main" and "main" in words and not aside(k.key, at):
                found.setdefault((at, above), []).append(k)
            else:
                seek(k, at, tag, above | {at} if aside(k.key, at) else above, found)
        return found

    for tag in ("article", "main"):
        found = seek(root, "", tag, frozenset(), {})
        for under in (False, True):
            opened: set[str] = set()
            places = [(at, above, nodes) for (at, above), nodes in found.items() if bool(above) == under]
            chars = sum(opened_in(n, at, opened) for at, _, nodes in places for n in nodes)
            if chars and (not under or plain * 10 < (chars + plain) * MOST):
                return sorted({at for at, _, _ in places}), sorted(opened.union(*(above for _, above, _ in places)))
    opened = set()
    opened_in(root, "", opened)
    node, path = root, ""
    while True:
        total = weight(node, path, opened)
        # an aside is gone into only if next to nothing is beside it: long comments do not take the article's place
        heavy = [k for k in node.kids if total and k.key.split(".")[0] not in INLINE | {"p", "li"}
                 and weight(k, f"{path}/{k.key}", opened) * 20 >= total * (19 if aside(k.key, f"{path}/{k.key}") else 2 * MOST)]
        if not heavy:
            return [path], sorted(opened)
        node, path = heavy[0], f"{path}/{heavy[0].key}"


def text_of(root, paths: set[str], opened: set[str]) -> str:
    """Blocks of the regions in page order without asides other than ``opened``, references decoded, white space as one
    space."""
    pieces: list[str] = []

    def walk(node, path: str, inside: bool) -> None:
        for k in node[1]:
            if isinstance(k, str):
                if inside:
                    pieces.append(k)
                continue
            key = k[0]
            at = f"{path}/{key}"
            if aside(key, at) and at not in opened:
                continue
            tag = key.split(".")[0]
            block = tag not in INLINE
            if block:
                pieces.append(" ")
            walk(k, at, inside or at in paths)
            if block:
                pieces.append(" ")

    walk(root, "", "" in paths)
    return " ".join(html.unescape("".join(pieces)).split())


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``wrapper`` (JSON of the nested places), ``regions`` (paths of the article) and ``opened`` (paths that
    are no asides though they look so), one row a host.

    Every page is folded in: each task folds the pages of a host that it meets, these wrappers are folded within
    ``SLICES`` slices of the host, and the slices' wrappers at last, so a host of any size is aligned in parts of
    bounded memory. A null or unreadable address belongs to the host ''; null pages are empty.
    """
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def pack(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w.pack()) for w in held.values()], pa.string())],
                                          ["host", "wrapper"])

    def first(batches):
        held: dict[str, Node] = {}
        for whole in batches:
            for b in slices(whole, "html"):
                for host, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                    w = wrapper_of(tree(source or ""))
                    held[host] = align(held[host], w) if host in held else w
            if len(held) > 2000:
                yield pack(held)
                held = {}
        if held:
            yield pack(held)

    def fold(batches):
        for g in grouped(batches, 2):
            now = None
            for x in g.column("wrapper"):
                w = Node.unpack(json.loads(x.as_py()))
                now = w if now is None else align(now, w)
            yield pack({g.column("host")[0].as_py(): now})

    def folded(df: DataFrame, part) -> DataFrame:
        return (df.withColumn("part", part).repartition("host", "part").sortWithinPartitions("host", "part")
                .select("host", "part", "wrapper").mapInArrow(fold, "host string, wrapper string"))

    ones = rows.mapInArrow(first, "host string, wrapper string")
    slices_ = folded(ones, F.pmod(F.xxhash64("wrapper"), F.lit(SLICES)).cast("int"))
    hosts = folded(slices_, F.lit(0))

    def where(batches):
        for b in batches:
            both = [regions(Node.unpack(json.loads(x))) for x in b.column("wrapper").to_pylist()]
            paths = [pa.array([x[i] for x in both], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("wrapper"), *paths], ["host", "wrapper", "regions", "opened"])

    return hosts.mapInArrow(where, "host string, wrapper string, regions array<string>, opened array<string>")


def extract(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text as ``out_col`` (replaced if there): what stands in the regions of the host's
    wrapper, without menus, forms, adverts, comments and the like in them. A page that has none of the host's
    regions is read by its own wrapper. A null page has an empty text."""
    columns = [c for c in pages.columns if c != out_col]
    host = host_of(F.col(url_col))
    rules = written(rules.select(F.col("host").alias("_host"), F.col("regions").alias("_regions"), F.col("opened").alias("_opened")), "rules")
    rows = pages.select(*columns, host.alias("_key"))
    if rules.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(rules), rows["_key"] == rules["_host"], "left")
    else:
        salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_dealt", F.pmod(F.xxhash64(html_col), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, (rows["_key"] == salted["_host"]) & (rows["_dealt"] == salted["_salt"]), "left")
    schema = T.StructType([pages.schema[c] for c in columns]).add(out_col, "string")

    def run(batches):
        for whole in batches:
            for b in slices(whole, html_col):
                texts = []
                for source, *rule in zip(*(b.column(c).to_pylist() for c in (html_col, "_regions", "_opened"))):
                    root = tree(source or "", True)
                    text = text_of(root, *(set(x or ()) for x in rule))
                    if not text and source:
                        text = text_of(root, *map(set, regions(wrapper_of(tree(source)))))
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, out_col])

    return joined.select(*columns, "_regions", "_opened").mapInArrow(run, schema)


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Infers the wrappers of all hosts and extracts every page; see ``infer`` and ``extract``."""
    return extract(pages, infer(pages, url_col, html_col), url_col, html_col, out_col)

"""HTML extraction by wrapper induction.

One page of each host is the seed of its wrapper. Every page of the host is aligned with the seed by simple tree matching
(the largest order-preserving match of two labelled trees); the texts that meet in a node of the seed tell whether it is
template or slot: constant texts are template everywhere, texts that repeat a lot are template outside the article. Pages
are then aligned once more and only what is no template, and no menu, form, advert and the like by its markup, is kept.
A page that occurs again and again counts once in these statistics, so that a host full of copies is no template.
"""
import html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.llm.common import materialise, whole

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead tr ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
#: Elements and words of class, id and role that mark what is not the article.
OUT = frozenset("""head script style noscript template svg canvas iframe object embed audio video textarea select button input form nav
    footer aside dialog menu title xmp noembed noframes""".split())
OUT_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu
    footer sidebar aside cookie cookies consent gdpr notice banner popup modal overlay comment comments respond reply replies disqus share
    sharing social related recommended newsletter subscribe signup breadcrumb breadcrumbs pagination pager widget toolbar
    contentinfo search complementary""".split())
HEAD_WORDS = frozenset("header masthead".split())
MAIN_WORDS = frozenset("main content article post story entry".split())
DEPTH, RUN = 150, 8
CONSTANT, REPEATS, FEW = 90, 50, 8


class Node:
    __slots__ = ("tag", "attrs", "kids", "elements", "sig", "slot", "label", "own")

    def __init__(self, tag, attrs=""):
        self.tag, self.attrs, self.kids, self.elements, self.sig, self.slot, self.own = tag, attrs, [], [], None, None, None
        c = re.search(r"""class\s*=\s*["']?([\w-]*)""", attrs) if "class" in attrs else None
        self.label = f"{tag}.{c[1]}" if c else tag

    def words(self):
        if not self.attrs.strip():
            return frozenset()
        out = []
        for name, value in ATTR.findall(self.attrs):
            if name.lower() in ("class", "id", "role"):
                out += re.split(r"[^a-z]+", html.unescape(value).lower())
        return frozenset(out)


def parse(page: str) -> Node:
    """The element tree; end tags that match nothing open are dropped, elements deeper than DEPTH hang at that depth."""
    root = Node("#root")
    stack, at, raw = [root], 0, None

    def text(upto):
        if upto > at:
            stack[-1].kids.append(page[at:upto])

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        tag = m[2] and m[2].lower()
        if raw:
            if not (m[1] and tag == raw):
                continue
            raw = None
        text(m.start())
        at = m.end()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # an inline end tag closes no block
            continue
        if tag in BLOCK and tag != "p" or tag == "p":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" and tag in BLOCK:
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                elif stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        stack[-1].elements.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            if not end:
                at = len(page)
                break
            raw = tag
            node.kids.append(page[at:end.start()])
            at = end.start()
            raw = None
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    text(len(page))
    return root


def tidy(text: str) -> str:
    return " ".join(html.unescape(text).split())


def own_text(node: Node) -> str:
    if node.own is None:
        node.own = tidy(" ".join(k for k in node.kids if isinstance(k, str)))
    return node.own


class Matcher:
    """Simple tree matching; results for equal subtrees are kept."""

    def __init__(self, limit=200_000):
        self.sigs, self.size, self.memo, self.limit = {}, [], {}, limit

    def sign(self, node):
        kids = tuple(self.sign(e) for e in node.elements)
        key = (node.label, kids)
        if key not in self.sigs:
            self.sigs[key] = len(self.size)
            self.size.append(1 + sum(self.size[k] for k in kids))
        node.sig = self.sigs[key]
        return node.sig

    def fresh(self):
        """Before a page: forget when too much is kept. True when signatures are gone."""
        if len(self.memo) + len(self.sigs) > self.limit:
            self.sigs, self.size, self.memo = {}, [], {}
            return True
        return False

    def weight(self, a, b):
        if a.label != b.label:
            return 0
        if a.sig == b.sig:
            return self.size[a.sig]
        w = self.memo.get((a.sig, b.sig))
        if w is None:
            w = self.memo[a.sig, b.sig] = 1 + (self.table(a, b)[-1][-1] if a.elements and b.elements else 0)
        return w

    def table(self, a, b):
        rows = [[0] * (len(b.elements) + 1)]
        for x in a.elements:
            above, row, left = rows[-1], [0], 0
            for j, y in enumerate(b.elements):
                best = above[j + 1] if above[j + 1] > left else left
                if x.label == y.label and (w := above[j] + self.weight(x, y)) > best:
                    best = w
                row.append(best)
                left = best
            rows.append(row)
        return rows

    def align(self, seed, page):
        """Gives the nodes of the page that match the number of the seed's node."""
        todo = [(seed, page)]
        while todo:
            a, b = todo.pop()
            b.slot = a.slot
            if a.sig == b.sig:
                todo += zip(a.elements, b.elements)
            elif a.elements and b.elements:
                t, i, j = self.table(a, b), len(a.elements), len(b.elements)
                while i and j:
                    if t[i][j] == t[i - 1][j]:
                        i -= 1
                    elif t[i][j] == t[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        todo.append((a.elements[i], b.elements[j]))


def to_wrapper(page: str) -> str:
    """The tree of the seed page as JSON: labels and children; of a run of equal neighbours the first RUN."""
    m, root = Matcher(), parse(page)
    m.sign(root)

    def dump(node):
        kids, run = [], 0
        for i, e in enumerate(node.elements):
            run = run + 1 if i and e.sig == node.elements[i - 1].sig else 1
            if run <= RUN:
                kids.append(dump(e))
        return [node.label, kids]
    return json.dumps(dump(root), separators=(",", ":"))


def from_wrapper(text: str) -> Node:
    number = 0

    def load(item):
        nonlocal number
        n = Node("")
        n.label, n.slot = item[0], number
        number += 1
        n.elements = [load(k) for k in item[1]]
        return n
    return load(json.loads(text))


class Wrappers:
    """Aligns pages with the wrapper of their host; some wrappers are kept ready."""

    def __init__(self):
        self.matcher, self.ready = Matcher(), {}

    def page(self, wrapper: str | None, page: str) -> Node:
        root = parse(page)
        if wrapper:
            if self.matcher.fresh() or len(self.ready) > 2000:
                self.ready.clear()
            if wrapper not in self.ready:
                self.ready[wrapper] = from_wrapper(wrapper)
                self.matcher.sign(self.ready[wrapper])
            self.matcher.sign(root)
            self.matcher.align(self.ready[wrapper], root)
        return root


def nodes(root: Node):
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.elements)


def is_out(node: Node, inside: bool) -> bool:
    if node.tag in OUT or node.tag == "header" and not inside:
        return True
    if not node.attrs.strip() or node.tag in ("html", "body", "main"):
        return False
    low = node.attrs.lower()
    if re.search(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", low):
        return True
    w = node.words()
    if node.tag == "article":
        return bool(w & {"comment", "comments", "ad", "ads", "related", "promo", "reply"})
    return bool(w & OUT_WORDS) or not inside and bool(w & HEAD_WORDS)


def regions(root: Node):
    """The article elements outside all other parts; else the main ones; else the elements named so; else the body."""
    def search(test):
        todo, found = [root], []
        while todo:
            n = todo.pop()
            if n is not root and is_out(n, False):
                continue
            if test(n):
                found.append(n)
            else:
                todo += reversed(n.elements)
        return found
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main" or "main" in n.words() and "role" in n.attrs,
                 lambda n: n.tag in ("div", "section", "td") and bool(n.words() & MAIN_WORDS)):
        if found := search(test):
            return found, True
    return [root], False


def main_text(root: Node, constant=frozenset(), repeats=frozenset()) -> str:
    """Blocks of the article in page order."""
    blocks, buffer = [], []

    def flush():
        line = tidy("".join(buffer))
        buffer.clear()
        if line:
            blocks.append(line)

    def walk(node, inside):
        if node.tag == "br":
            buffer.append(" ")
            return
        template = node.slot is not None and (node.slot in constant or not inside and node.slot in repeats)
        block = node.tag in BLOCK
        if block:
            flush()
        for k in node.kids:
            if isinstance(k, str):
                if not template:
                    buffer.append(k)
            elif not is_out(k, inside):
                walk(k, inside)
        if block:
            flush()

    found, inside = regions(root)
    for n in found:
        walk(n, inside)
        flush()
    return "\n\n".join(blocks)


def _hosts(pages):
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"),
                        F.xxhash64("page_id", "url").alias("pick"), whole("html").alias("html"))


def _seeds(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_wrapper(x) for x in b.column(1).to_pylist()], pa.string())], names=["host", "wrapper"])


def _observe(batches):
    w = Wrappers()
    digest = lambda s: xxhash.xxh3_64_intdigest(s) - 2**63
    for b in batches:
        host, page, rows = b.column(0).to_pylist(), [], []
        for wrapper, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            all_texts, row = xxhash.xxh3_64(), []
            for n in nodes(w.page(wrapper, text)):
                if n.tag not in RAW and (t := own_text(n)):
                    all_texts.update(t)
                    if n.slot is not None:
                        row.append({"slot": n.slot, "text": digest(t)})
            page.append(all_texts.intdigest() - 2**63)
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(
            rows, pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64())])))], names=["host", "page", "texts"])


def _extract(batches):
    w = Wrappers()
    for b in batches:
        out = []
        for text, wrapper, constant, repeats in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
            out.append(main_text(w.page(wrapper, text), frozenset(constant or ()), frozenset(repeats or ())))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _with_host(pages, hosts, max_bytes, bytes_of):
    """Left join on host: broadcast while the side of hosts is measured to be small; beyond, the hosts are copied over
    salts, so that the pages of one host spread."""
    size = hosts.agg(F.sum(bytes_of)).first()[0] or 0
    if size <= max_bytes:
        return pages.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return pages.withColumn("_salt", F.pmod("pick", F.lit(64)).cast("int")).join(salted, ["host", "_salt"], "left").drop("_salt")


def extract_pages(pages: DataFrame, max_broadcast: int = 32 << 20) -> DataFrame:
    """One row for each row of ``pages``: page_id, url and text (empty if none).

    A null html is empty. Pages without a host (null or relative url) form one host. Hosts with fewer than eight different
    pages have no template, so only the markup decides. Repeated rows and a null page_id are extracted like others. Extra
    columns are ignored; an empty table gives an empty result.
    """
    p = _hosts(pages)
    first = materialise(p.groupBy("host").agg(F.min("pick").alias("pick")))
    lo = first.withColumn("_seed", F.lit(True)).withColumnRenamed("pick", "_pick")
    marked = _with_host(p.select("host", "pick", "html"), lo, max_broadcast, F.length("host") + 16)
    seeds = marked.where(F.col("pick") == F.col("_pick")).select("host", "html").mapInArrow(_seeds, "host string, wrapper string")
    seeds = materialise(seeds.groupBy("host").agg(F.min("wrapper").alias("wrapper")))
    size = F.length("host") + F.length("wrapper")
    seen = _with_host(p.select("host", "pick", "html"), seeds, max_broadcast, size).select("host", "wrapper", "html")
    seen = seen.mapInArrow(_observe, "host string, page long, texts array<struct<slot:int,text:long>>")
    seen = materialise(seen.dropDuplicates(["host", "page"]))
    texts = seen.select("host", F.explode("texts").alias("t")).groupBy("host", "t.slot", "t.text").agg(F.count("*").alias("n"))
    slots = texts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("kinds"))
    slots = slots.where(F.col("n") >= FEW)
    constant, repeats = 100 * F.col("top") >= CONSTANT * F.col("n"), 100 * F.col("kinds") <= REPEATS * F.col("n")
    flags = slots.groupBy("host").agg(F.collect_list(F.when(constant, F.col("slot"))).alias("constant"),
                                      F.collect_list(F.when(repeats, F.col("slot"))).alias("repeats"))
    wrappers = materialise(seeds.join(flags, "host", "left"))
    size = size + 8 * (F.coalesce(F.size("constant"), F.lit(0)) + F.coalesce(F.size("repeats"), F.lit(0)))
    ready = _with_host(p, wrappers, max_broadcast, size).select("page_id", "url", "html", "wrapper", "constant", "repeats")
    return ready.mapInArrow(_extract, "page_id long, url string, text string")

"""HTML extraction by site style trees.

Pages of one host are merged into a tree of styles: a node is a path of block elements' tags and classes. The tree sees
the whole page, articles as well as menus. Of each node it counts in how many pages it stands, how often each layout of
its children (presentation) and each of its texts (content, cut at separators such as | and the middle dot) was seen.

* A text's importance is 1 - log n / log m where n of the node's m pages have it: 1 if it is one page's own, 0 if all
  have it. The same is asked of the n hosts, of all m with such a node, that have it there (m - 1 observations beside
  PRIOR ones of importance 1), and the lower value counts: a line that goes round many sites is no article on any.
  Text of links counts 0 (but for headings).
* A branch's content is the mean of the texts in and below it, by length and pages; its presentation is the entropy of
  its layouts over log m; its importance is BALANCE parts content, the rest presentation (a node without blocks in it is
  content alone).
* Importance is passed down: with m pages, a branch counts as m - 1 observations beside PRIOR ones of what it stands in
  and of the same path on other hosts (which in turn counts as hosts - 1 beside PRIOR ones of importance 1). So a node
  seen once or twice takes the importance of its branch, and no number of pages switches anything on.

Of nodes below THRESHOLD, blocks go whose own texts are below it as well: a page's own text stays in a node that
is template elsewhere. A line is judged with the branch that it stands in: headings, paragraphs and list lines that recur
go only where the whole branch (a menu, a box; inside an article a div, section or the like) is low, so an article keeps its "Ingredients" on
however many pages it stands, and lines right under article or main stay. What the tree can't know, as its text is new on each page (reader comments, forms, adverts), goes
by tag, role or class (hints), but an article in a form or in a layout of such a class stays, and inside an article only
whole class names count.

Pages of a host with the same article (the text in article and main elements, else all text) are
copies of one page and count once, and hosts that mirror one article are no evidence, so mirrored articles are no template. Copies whose article differs (in a date in
it, say) are different pages: where they are most of a host, what they share is template.

Counts are summed by Spark, and a host with a third of all pages is spread by node, text and page.

Cases: null and empty html give the empty text; a null or odd url is the host of that spelling; unclosed and crossing
tags are closed the way browsers close them, in time linear in the page; nodes more than DEPTH blocks deep count as the
one at that depth; an article's own header keeps its headings; character references are decoded within one text node; repeated pages count
once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

#: Nodes and blocks below this importance are cut.
THRESHOLD = 0.4
#: Share of content in a branch's importance; the rest is presentation.
BALANCE = 0.9
#: Pages that the importance from above and from other hosts counts for.
PRIOR = 6
#: Levels of nesting that paths tell apart; deeper nodes count as their ancestor at this depth.
DEPTH = 64

_words = lambda x: frozenset(x.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style textarea title noscript iframe noembed noframes xmp")
BLOCK = _words("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul")
#: Never text of a page: markup, controls and media.
NO_TEXT = _words("head script style noscript template button select textarea input iframe object svg canvas noembed noframes title datalist audio video")
#: Elements, roles and classes that say that they are no article; extract(hints=False) does without them.
HINT_TAGS = _words("nav header footer aside form menu dialog")
CONTENT = _words("article main")
HINT_CLASSES = _words("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies notice notices cookie cookies consent gdpr popup modal newsletter subscribe share social related widget")
HINT_ROLES = _words("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar")
COMMENTS = _words("comment comments reply replies disqus")
#: Running elements, which the tree judges with what they stand in; inside an article all but BRANCHES are such.
FLOW = _words("address blockquote caption dd dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li option p pre summary tr")
BRANCHES = _words("aside center details dir div fieldset form nav section")
#: An element that opening the first closes, up to the nearest of the second.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select datalist")}
CLOSES = {k: (_words(a), _words(b)) for k, (a, b) in CLOSES.items()}

_open = re.compile(r"<!--|<[!?]|<(/?)([A-Za-z][^\s/>]*)")
_stop = re.compile(r"""[>"']""")
_left_open = re.compile(r"</(nav|header|footer|aside|head)(?=[\s>/])", re.I)
_attribute = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_part = re.compile(r"[^\s_-]+")
_cut = re.compile(r"[|·•»\n]+|\s[–—]\s")
_heading = re.compile(r"h[1-6]")

_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, signature: str) -> int:
    key = (parent, signature)
    if key not in _paths:
        if len(_paths) > 200_000:
            _paths.clear()
        _paths[key] = int.from_bytes(hashlib.blake2b(f"{parent} {signature}".encode(), digest_size=8).digest(), "little", signed=True)
    return _paths[key]


# What is known of an element: no text at all, a hint that it is no article, a hint that an article in it lifts, an
# article's own header, whose headings stay.
NEVER, HINT, WEAK, OWN = 2, 1, 3, 4


def _looks(name: str, attributes: str, inside: bool) -> tuple[str, int]:
    """(the element's style, 0 or what its tag, role or class says). inside: it stands in an article."""
    said = NEVER if name in NO_TEXT else WEAK if name == "form" else OWN if inside and name == "header" else HINT if name in HINT_TAGS else 0
    if not attributes or "=" not in attributes:
        return name, said
    style = name
    for kind, a, b, c in _attribute.findall(attributes):
        value, kind = (a or b or c).lower(), kind.lower()
        if kind == "class":
            style = f"{name}.{' '.join(value.split())}"
        if said not in (0, OWN) or name in ("html", "body"):
            continue
        if name in CONTENT:
            said = HINT if kind != "role" and any(x in COMMENTS for x in _part.findall(value)) else 0
        elif kind == "role":
            said = HINT if value in HINT_ROLES else said
        elif any(x in HINT_CLASSES for x in value.split()):
            said = HINT
        elif not inside and any(x in HINT_CLASSES for x in _part.findall(value)):
            said = WEAK
    return style, said


class _Tags:
    """Tags of a page. One ends at the first > outside quotes. Each character is looked at a bounded number of times: where
    a quote is left open to the page's end, tags from there on end at their first >."""

    def __init__(self, source: str):
        self.source, self.last, self.quotes = source, source.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, str, str | None, str] | None:
        """(start, end, slash, name, attributes) of the next tag; comments and declarations have no name."""
        source = self.source
        found = _open.search(source, at)
        if not found:
            return None
        start, at = found.span()
        if at - start == 4 and source.startswith("<!--", start):
            end = source.find("-->", at)
            return start, len(source) if end < 0 else end + 3, "", None, ""
        if start > self.last:
            return None
        end = self._end(at, found[2] is not None)
        return start, end, found[1] or "", found[2], source[at : end - 1]

    def _end(self, at: int, named: bool) -> int:
        end = at
        while named and self.quotes:
            mark = _stop.search(self.source, end)
            if not mark:
                self.quotes = False
            elif mark[0] == ">":
                return mark.end()
            elif (end := self.source.find(mark[0], mark.end()) + 1) == 0:
                self.quotes = False
        return self.source.find(">", at) + 1


class Page:
    """One page in order. blocks: lists of (path, hinted, inside an article, in a link, text, branch); branch is the path
    of the branch that a block is judged with, None right in an article. layouts: of each path, the styles of the blocks in it; above: of
    each path, the one it stands in (0: none)."""

    def __init__(self, source: str):
        self.blocks: list[list[tuple]] = [[]]
        self.layouts: dict[int, list[str]] = defaultdict(list)
        self.above: dict[int, int] = {}
        self.headings: set[int] = set()
        # Open elements: name, path of its block, what was said, inside an article, in a link, branch. Where those of each
        # name stand, and where blocks do.
        self.stack = [("", 0, 0, False, False, 0)]
        self.open: dict[str, list[int]] = defaultdict(list)
        self.open_blocks = [0]
        self.closed = {m[1].lower(): m.start() for m in _left_open.finditer(source)}
        stack, at, n = self.stack, 0, len(source)
        reader = _Tags(source)
        while tag := reader.next(at):
            start, end, slash, name, attributes = tag
            if start > at:
                self._text(stack[-1], source[at:start])
            at = end
            if name is None:
                continue
            name = name.lower()
            if slash:
                self._close(name)
                continue
            if name == "br":
                self._text(stack[-1], " ")
            if name in BLOCK:
                self._end()
                self._close_implied(name, at)
            _, path, said, inside, link, branch = stack[-1]
            style, mine = _looks(name, attributes, inside)
            if name in BLOCK:
                self.layouts[path].append(style)
                if len(stack) <= DEPTH:
                    above, path = path, _path(path, style)
                    self.above[path] = above
                    if _heading.fullmatch(name):
                        self.headings.add(path)
                self.layouts[path]  # a node without blocks in it has the empty layout
                branch = None if name in CONTENT else path if (name in BRANCHES if inside else name not in FLOW) else branch
            if name in VOID:
                continue
            if (name in CONTENT and not inside and said == WEAK) or (said == OWN and _heading.fullmatch(name)):
                said = 0
            said = NEVER if NEVER in (said, mine) else said if said else mine
            if name in RAW:
                ending = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                if said != NEVER:
                    self._text((name, path, said, inside, link, branch), source[at : ending.start() if ending else n])
                at = ending.end() if ending else n
                continue
            if not attributes.endswith("/") or name in BLOCK:
                self.open[name].append(len(stack))
                if name in BLOCK:
                    self.open_blocks.append(len(stack))
                stack.append((name, path, said, inside or name in CONTENT, link or name == "a", branch))
        if at < n:
            self._text(stack[-1], source[at:])
        self._end()

    def _text(self, top: tuple, raw: str) -> None:
        _, path, said, inside, link, branch = top
        if said != NEVER:
            self.blocks[-1].append((path, said != 0, inside, link, entities.unescape(raw) if "&" in raw else raw, branch))

    def _end(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _cut(self, i: int) -> None:
        """Closes the open elements from the i-th on."""
        while len(self.stack) > i:
            self.open[self.stack.pop()[0]].pop()
            if self.open_blocks[-1] == len(self.stack):
                self.open_blocks.pop()

    def _last(self, names: frozenset[str]) -> int:
        """Where the innermost open element of these names stands; 0 without any."""
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=0)

    def _close(self, name: str) -> None:
        """An inline element's end doesn't reach out of the block that it stands in."""
        at = self.open.get(name)
        if at and (name in BLOCK or at[-1] > self.open_blocks[-1]):
            self._cut(at[-1])
        if name in BLOCK:
            self._end()

    def _close_implied(self, name: str, at: int) -> None:
        if name in CONTENT:  # an article doesn't stand in a menu that was left open
            left = [self.open[x][0] for x in ("nav", "header", "footer", "aside", "head") if self.open.get(x) and self.closed.get(x, -1) < at]
            if left:
                self._cut(min(left))
        if name == "body" and self.open.get("head"):
            self._cut(self.open["head"][0])
        if self.stack[self.open_blocks[-1]][0] == "p":  # a block ends the paragraph that it stands in
            self._cut(self.open_blocks[-1])
        if name in CLOSES:
            ends, limit = CLOSES[name]
            last = self._last(ends)
            if last > self._last(limit):
                while last > 1 and self.stack[last - 1][0] in ends:
                    last -= 1
                self._cut(last)

    def pieces(self, block: list[tuple]) -> list[tuple[str, bool]]:
        """The texts of a block, and whether they are links."""
        out = []
        links = [x[3] for x in block]
        for link in (False, True):
            if link in links:
                text = "".join(x[4] if x[3] == link else "\n" for x in block)
                for one in _cut.split(text):
                    if one := " ".join(one.split()).lower():
                        out.append((one, link and block[0][0] not in self.headings))
        return out

    def article(self) -> str:
        """What tells this page from its host's others: the text in articles, else all text."""
        every = [x for block in self.blocks for x in block]
        return " ".join("".join([x[4] for x in every if x[2]] or [x[4] for x in every]).split())

    def main_text(self, low: dict[int, dict[int, float]], hints: bool = True) -> str:
        """Blocks that stay, one a line. low: of each path to look at, the importance of texts below 1, by digest."""
        keep = []
        for block in self.blocks:
            if block and not self._template(block, low):
                if text := " ".join("".join([x[4] for x in block if not (hints and x[1])]).split()):
                    keep.append(text)
        return "\n".join(keep)

    def _template(self, block: list[tuple], low: dict[int, dict[int, float]]) -> bool:
        """Whether the tree cuts a block: it and the branch that it is judged with are low, and so are its texts."""
        path, branch = block[0][0], block[0][5]
        if path not in low or branch not in low or not (pieces := self.pieces(block)):
            return False
        known, size = low[path], sum(len(t) for t, _ in pieces)
        return sum(0.0 if link else len(t) * known.get(_digest(t), 1.0) for t, link in pieces) < THRESHOLD * size

def _digest(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


#: Kinds of rows: a text, a layout, a link's text; what a node stands in.
TEXT, LAYOUT, LINK, ABOVE = 0, 1, 2, 3
STATS = "host long, path long, kind int, feature long, size int, page long"


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(seen):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        columns = list(zip(*seen, strict=True)) if seen else [[]] * 6
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in STATS.split(", ")])

    seen: set[tuple] = set()
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source)
            which = _digest(page.article())
            for block in page.blocks:
                for text, link in page.pieces(block) if block else ():
                    seen.add((host, block[0][0], LINK if link else TEXT, _digest(text), len(text), which))
            for path, layout in page.layouts.items():
                seen.add((host, path, LAYOUT, _digest(" ".join(layout)) if layout else 0, 0, which))
                if path:
                    seen.add((host, path, ABOVE, page.above[path], 0, 0))
        if len(seen) > 100_000:
            yield out(seen)
            seen = set()
    yield out(seen)


def features(pages: DataFrame) -> DataFrame:
    """host, path, kind, feature, size, n (different pages that have it), lo and hi (the least and greatest of these
    pages' article digests), of pages (host, html)."""
    seen = pages.select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_styles, STATS).distinct()
    return seen.groupBy("host", "path", "kind", "feature", "size").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"))


def _shrunk(importance: str, m: str, prior: str) -> str:
    return f"(({m} - 1) * ({importance}) + {PRIOR} * ({prior})) / ({m} - 1 + {PRIOR})"


def style_tree(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, texts) of features. Nodes: host, path, m, importance (passed down). Texts: host, path, feature, importance
    of the texts below 1."""
    layouts = seen.filter(f"kind = {LAYOUT}").groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.max(F.col("feature") != 0).alias("inner"))
    layouts = common.table(layouts.selectExpr("host", "path", "m", "if(m > 1, (log2(m) - s / m) / log2(m), 1D) as presentation", "inner"), "layouts")
    nodes = common.table(layouts.join(layouts.groupBy("path").agg(F.count(F.lit(1)).alias("hosts")), "path"), "nodes")
    # Texts that several hosts have at a path, in different articles.
    shared = seen.filter(f"kind = {TEXT}").groupBy("path", "feature").agg(F.count(F.lit(1)).alias("with"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared = common.table(shared.filter("with > 1 and lo <> hi").select("path", "feature", "with"), "shared")  # read back, so that the join can split a hot text
    texts = seen.filter(f"kind in ({TEXT}, {LINK})").join(nodes.select("host", "path", "m", "hosts"), ["host", "path"])
    texts = texts.join(shared, ["path", "feature"], "left").withColumn("with", F.coalesce("with", F.lit(1)))
    own = f"least(if(m > 1, 1 - log2(n) / log2(m), 1D), {_shrunk('if(hosts > 1, 1 - log2(with) / log2(hosts), 1D)', 'hosts', '1D')})"
    texts = texts.selectExpr("host", "path", "kind", "feature", "cast(n * size as double) as weight", f"if(kind = {LINK}, 0D, greatest({own}, 0D)) as importance")
    texts = common.table(texts, "texts")
    content = common.table(texts.groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.sum(F.col("weight") * F.col("importance")).alias("sum")), "content")
    chains = common.table(_chains(seen.filter(f"kind = {ABOVE}").select("host", "path", F.col("feature").alias("above")), nodes), "chains")
    below = content.join(chains, ["host", "path"]).select("host", F.explode("chain").alias("path"), "weight", "sum").groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.sum("sum").alias("sum"))
    rated = nodes.join(below, ["host", "path"], "left").selectExpr("*", "if(weight > 0, sum / weight, 1D) as content")
    rated = rated.selectExpr("host", "path", "m", "hosts", "coalesce(weight, 0D) as weight", f"if(inner, {BALANCE} * content + {1 - BALANCE} * presentation, content) as raw")
    rated = common.table(rated, "rated")
    everywhere = rated.groupBy("path").agg(F.expr("if(sum(weight) > 0, sum(weight * raw) / sum(weight), 1D)").alias("mean"))
    rated = rated.join(everywhere, "path").selectExpr("host", "path", "m", "raw", _shrunk("mean", "hosts", "1D") + " as elsewhere")
    steps = chains.select("host", F.col("path").alias("leaf"), F.posexplode("chain").alias("step", "path")).join(rated, ["host", "path"])
    steps = steps.groupBy("host", F.col("leaf").alias("path")).agg(F.array_sort(F.collect_list(F.struct("step", "m", "raw", "elsewhere"))).alias("steps"))
    down = _shrunk("x.raw", "x.m", "least(a, x.elsewhere)")
    final = steps.selectExpr("host", "path", "element_at(steps, -1).m as m", f"aggregate(steps, 1D, (a, x) -> {down}) as importance")
    return final, texts.filter(f"kind = {TEXT} and importance < 1").select("host", "path", "feature", "importance")


def _chains(above: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, path, chain: the paths from the page (0) down to this one, itself included. A node is at most DEPTH below the
    page, and each round doubles what is known."""
    known = above.select("host", "path", F.array("path").alias("chain"), "above")
    for _ in range(DEPTH.bit_length() + 1):
        known = common.table(known, "chain")
        if not known.filter("above <> 0").head(1):
            break
        up = known.select("host", F.col("path").alias("above"), F.col("chain").alias("before"), F.col("above").alias("top"))
        known = known.join(up, ["host", "above"], "left").select("host", "path", F.concat(F.coalesce("before", F.expr("cast(array() as array<long>)")), "chain").alias("chain"), F.coalesce("top", F.lit(0)).alias("above"))
    known = known.select("host", "path", F.concat(F.expr("array(0L)"), "chain").alias("chain"))
    return known.union(hosts.select("host").distinct().select("host", F.lit(0).cast("long"), F.expr("array(0L)")))


LOW = "host long, path long, features array<long>, importances array<double>"


def low_branches(pages: DataFrame) -> DataFrame:
    """LOW: each node below THRESHOLD, and the importance of its texts below 1; of pages (host, html)."""
    seen = common.table(features(pages), "features")
    nodes, texts = style_tree(seen)
    held = nodes.filter(F.col("importance") < THRESHOLD).select("host", "path").join(texts, ["host", "path"], "left")
    listed = F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "importance")))
    held = held.groupBy("host", "path").agg(listed.alias("texts"))
    return held.selectExpr("host", "path", "texts.feature as features", "texts.importance as importances")


@lru_cache(1)
def _listed(raw: bytes) -> dict[int, dict[int, dict[int, float]]]:
    """Of each host, by path, the importance of texts."""
    out: dict[int, dict] = defaultdict(dict)
    for r in pa.ipc.open_stream(raw).read_all().to_pylist():
        out[r["host"]][r["path"]] = dict(zip(r["features"], r["importances"], strict=True))
    return out


def _extract(raw: bytes | None, hints: bool):
    """raw: LOW of all hosts; None: each page brings its host's, as a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host").to_pylist()
            lows = [_listed(raw).get(h, {}) for h in hosts] if raw is not None else ({x["path"]: dict(zip(x["features"], x["importances"], strict=True)) for x in low.as_py() or ()} for low in batch.column("low"))
            texts = [Page(source).main_text(low, hints) for source, low in zip(batch.column("html").to_pylist(), lows, strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, hints: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html). What is low on the hosts goes with the tasks where
    it is at most BROADCAST_IDS texts, else with the pages, by a join."""
    common.session_paths(pages.sparkSession)
    host = F.xxhash64(F.lower(F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^[^/]*//(?:[^/?#@]*@)?([^/?#]*).*", "$1")))
    held = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    low = common.table(low_branches(held), "low")
    n = low.select(F.coalesce(F.sum(F.size("features") + 1), F.lit(0))).first()[0]
    page_id, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    if n <= common.BROADCAST_IDS:
        got, sink = low.toArrow(), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, got.schema) as out:
            out.write_table(got)
        run = _extract(sink.getvalue().to_pybytes(), hints)
    else:
        low = low.groupBy("host").agg(F.collect_list(F.struct("path", "features", "importances")).alias("low"))
        held, run = held.join(low, "host", "left").select("page_id", "url", "html", "host", "low"), _extract(None, hints)
    return held.mapInArrow(run, f"page_id {page_id}, url {url}, text string").withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Main text of web pages: site style trees.

The pages of one host are merged into one tree of block elements (tag, class and id from the root down).
A leaf is important if what it says differs from page to page: 1 less the mean entropy of its contents over the
pages that show it (a content that stands on one page has none, one that stands on all has 1). A branch is as important
as the leaves below it and, by a share of 1 - ``decay``, as its presentation styles - which children it shows - vary.
Pages of a host with the same blocks (copies) count as one. Every branch of low importance is cut from each page of the host.

What an element is called is a prior of its branch: the importance of a branch whose tag or names say navigation, footer,
advert, form, comments and the like is multiplied by ``prior``, or by ``weak`` if other words stand in the name too
('notice-board'). A branch so called that holds most of its pages' text (a form around a whole page) gets the factor back in part; ``prior`` = ``weak`` = 1
leaves names out, ``threshold`` = 0 cuts nothing. On pages whose menus and adverts say something else each time the prior is
all there is; where they repeat, the entropies need no names.

Only packed counts of distinct pages, then counts by host, branch and content are shuffled, merged before the shuffle;
texts stay in their task. Parsing takes time in proportion to the page; elements nested deeper than ``DEPTH`` hang from
the last of these.

Defined results: null or empty html gives an empty text; branches shown on fewer than ``least`` distinct pages of their
host are judged by their prior alone; equal pages are treated alike, whatever their page_id, which may be null or repeat; a null URL or one without ``://`` counts
as the host ''; white space is what Unicode calls so; character references are decoded once; formulas and labels of drawings are text.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .url_filter import url_host

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|select|title|xmp|annotation)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*+>|\Z)|<[!?][^<>]*+>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas and drawings, whose text runs on with the words around.
DRAWN = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mtable mtr mtd semantics svg g path rect circle ellipse line polyline polygon text tspan textpath defs use symbol".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the same kind ends.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Tags and names that stand for what is not main text, and words that say nothing beside them. Some tags may also stand around all of a page.
PRIOR_TAGS = frozenset("head nav footer menu dialog button".split())
AROUND_TAGS = frozenset("header aside form".split())
PRIOR_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promotion related search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
NEUTRAL = frozenset("area bar block bottom box buttons container content footer form global group inner item left link links list main outer page panel post posts primary right section secondary site slot top unit wrap wrapper".split())
BODY_TAGS = frozenset("html body article main".split())
PRIOR, WEAK, DEPTH = 0.3, 0.6, 256
COUNTED = "host string, branch long, kind string, what long, times long, total long, path array<long>, called int"
COUNTS = "host string, page binary, counts binary"


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def called(tag: str, names: list[str], inside_article: bool) -> int:
    """What an element's tag and names say of it: 0 nothing, 1 weakly, 2 by its names, 3 for sure that it is not main text."""
    if tag in PRIOR_TAGS:
        return 3
    if tag in BODY_TAGS:
        return 0
    found = 2 if tag in AROUND_TAGS and not (tag == "header" and inside_article) else 0
    for name in (x for n in names for x in n.split()):
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if any(x in PRIOR_NAMES for x in parts):
            rest = all(x in PRIOR_NAMES or x in NEUTRAL for x in parts)
            found = max(found, (3 if rest and any(x.startswith("comment") for x in parts) else 2) if rest else 1)
    return found


class Page:
    """Elements of a page, parents first: ``parent``, ``branch`` (64 bits of the steps from the root), ``called``, ``steps``
    (children it shows); and ``blocks``: (element, text) in order. Element 0 is the page."""

    def __init__(self, source: str) -> None:
        self.parent, self.branch, self.called, self.steps = [0], [0], [0], [[]]
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        opened: Counter = Counter()
        held: list[str] = []

        def close() -> None:
            text = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if text:
                self.blocks.append((stack[-1][1], text))

        def pop() -> None:
            opened[stack.pop()[0]] -= 1

        at = 0
        for m in MARKUP.finditer(source):
            held.append(source[at : m.start()])
            at = m.end()
            tag = (m[3] or "").lower()
            if not tag or tag in INLINE or tag in DRAWN:
                continue
            if tag in VOID:
                held.append(" ")
                continue
            close()
            if m[2]:
                while opened[tag]:
                    end = stack[-1][0] == tag
                    pop()
                    if end:
                        break
                continue
            ends = SELF_CLOSING.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            if stack[-1][0] in ends:
                pop()
                if tag == "tr" and stack[-1][0] in ends:
                    pop()
            names = [next(filter(None, x), "").lower() for x in NAMED.findall(m[4])]
            step = tag + "".join(f".{n}" for n in sorted(names) if n)
            above = stack[-1][1]
            self.steps[above].append(step)
            opened[tag] += 1
            if len(stack) > DEPTH:
                stack.append((tag, above))
                continue
            stack.append((tag, len(self.parent)))
            self.parent.append(above)
            self.branch.append(hashed(f"{self.branch[above]}/{step}"))
            self.called.append(called(tag, names, bool(opened["article"] or opened["main"])))
            self.steps.append([])
        held.append(source[at:])
        close()

    def path(self, element: int) -> list[int]:
        """Branches from the element up, without the page."""
        out = []
        while element:
            out.append(self.branch[element])
            element = self.parent[element]
        return out

    def without(self, low: frozenset[int]) -> str:
        """The text outside the branches in ``low``."""
        cut = [False] * len(self.parent)
        for k in range(1, len(cut)):
            cut[k] = cut[self.parent[k]] or self.branch[k] in low
        return " ".join(text for k, text in self.blocks if not cut[k])

    def counts(self) -> list[list]:
        """[branch, kind, what, times, total, path, called]: contents once each, styles, and the text below branches with a name."""
        out: dict[tuple, list] = {}
        chars = [0] * len(self.parent)
        for k, text in self.blocks:
            chars[k] += len(text)
            if k and (self.branch[k], "content", what := hashed(text)) not in out:
                path = self.path(k)
                out[self.branch[k], "content", what] = [1, 0, path, 0]
                out[self.branch[k], "page", 0] = [1, 0, path, 0]
        for k in range(len(chars) - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
        for k in range(1, len(chars)):
            if self.steps[k]:
                style = [s for j, s in enumerate(self.steps[k]) if not j or s != self.steps[k][j - 1]]
                out[self.branch[k], "style", hashed(" ".join(style))] = [1, 0, [], 0]
            if self.called[k]:
                own = out.setdefault((self.branch[k], "called", 0), [0, 0, [], self.called[k]])
                own[0], own[1] = own[0] + chars[k], chars[0]
        return [[*k, *v] for k, v in sorted(out.items())]


def page_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """host, a hash of the page's blocks, and its counts; each page content once within a batch."""
    for batch in batches:
        seen: dict[tuple[str, bytes], bytes] = {}
        for host, source in zip(batch["host"], batch["html"], strict=True):
            page = Page(source)
            packed = zlib.compress(json.dumps(page.counts()).encode(), 1)
            key = host, hashlib.blake2b(json.dumps([(page.branch[k], t) for k, t in page.blocks]).encode(), digest_size=16).digest()
            seen[key] = min(packed, seen.get(key, packed))
        yield pd.DataFrame([(*k, x) for k, x in seen.items()], columns=["host", "page", "counts"])


def count_branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of ``page_counts`` by host, merged within a batch."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for host, counts in zip(batch["host"], batch["counts"], strict=True):
            for branch, kind, what, times, total, path, name in json.loads(zlib.decompress(counts)):
                own = seen.setdefault((host, branch, kind, what), [0, 0, path, name])
                own[0], own[1] = own[0] + times, own[1] + total
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=[c.split()[0] for c in COUNTED.split(", ")])


def importance(counted: DataFrame, decay: float) -> DataFrame:
    """host, branch, pages, most, importance of each branch of the site style trees that has text below; ``most`` is that of its best leaf,
    ``pages`` the number of distinct pages that show the leaf shown most."""
    added = counted.where("kind in ('content', 'page', 'style')").groupBy("host", "branch", "kind", "what").agg(F.sum("times").alias("n"), F.max("path").alias("path"))
    of = lambda kind: added.where(F.col("kind") == kind)
    pages = of("page").select("host", "branch", F.col("n").alias("m"), "path")
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1)))
    leaf = of("content").groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum(F.col("n") * log("n")).alias("s")).join(pages, ["host", "branch"])
    leaf = leaf.select("host", "path", "n", "m", F.when(F.col("m") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("s") / F.col("n") / log("m"))).alias("v"))
    below = leaf.select("host", F.explode("path").alias("branch"), "n", "m", "v").groupBy("host", "branch").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("content"), F.max("v").alias("most"), F.max("m").alias("pages"))
    sums = of("style").groupBy("host", "branch").agg(F.sum("n").alias("n"), F.sum(F.col("n") * log("n")).alias("s"))
    styles = sums.select("host", "branch", F.when(F.col("n") < 2, 1.0).otherwise(1 - F.col("s") / F.col("n") / log("n")).alias("style"))
    both = below.join(styles, ["host", "branch"], "left")
    return both.select("host", "branch", "pages", "most", F.when(F.col("style").isNull(), F.col("content")).otherwise(decay * F.col("content") + (1 - decay) * F.col("style")).alias("importance"))


def low_branches(counted: DataFrame, threshold: float, decay: float, least: int, prior: float, weak: float) -> DataFrame:
    """host, branch of the branches to cut."""
    named = counted.where("kind = 'called'").groupBy("host", "branch").agg(F.max("called").alias("called"), (F.sum("times") / F.greatest(F.sum("total"), F.lit(1))).alias("share"))
    back = F.greatest(F.lit(0.0), (F.col("share") - 0.6) / 0.4)  # of the factor, where a branch holds most of the text
    factor = F.when(F.col("called") == 3, prior).when(F.col("called") == 2, prior + (1 - prior) * back).when(F.col("called") == 1, weak + (1 - weak) * back).otherwise(1.0)
    judged = importance(counted, decay).join(named, ["host", "branch"], "left").withColumn("factor", factor)
    seen = F.col("pages") >= least
    value = F.when(seen, F.col("importance")).otherwise(1.0) * F.col("factor")
    best = F.when(seen, F.col("most")).otherwise(1.0) * F.col("factor")
    return judged.where((value < threshold) & (best < threshold)).select("host", "branch")


SCHEMA = "page_id long, url string, text string, n_chars long"


def cut_texts(low_of):
    """Texts of pages (page_id, url, host, html, others); ``low_of(batch)`` gives the branches to cut from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s).without(low) for s, low in zip(batch.column("html").to_pylist(), low_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def page_branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(r.host, r.source, b) for r in batch.itertuples(index=False) for b in sorted(set(Page(r.html).branch[1:]))]
        yield pd.DataFrame(rows, columns=["host", "source", "branch"])


def extract_main_text(
    pages: DataFrame, threshold: float = 0.5, decay: float = 0.9, least: int = 6, prior: float = PRIOR, weak: float = WEAK, share_limit: int = 100_000
) -> DataFrame:
    """page_id, url, text, n_chars.

    A branch is cut if its importance times its prior, and that of every leaf in it, is under ``threshold``. The cut branches
    go to the tasks as one list if they are no more than ``share_limit`` (they are counted first); else each
    page's own are joined to it by host and a hash of its html, with the same result.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    # copies of a page count once: else the branch of a much copied article looks like one that says the same everywhere
    distinct = stored(pages.select("host", "html").mapInPandas(page_counts, COUNTS).groupBy("host", "page").agg(F.min("counts").alias("counts")), "counts")
    counted = stored(distinct.select("host", "counts").mapInPandas(count_branches, COUNTED), "counted")
    low = stored(low_branches(counted, threshold, decay, least, prior, weak), "branches")
    if low.count() <= share_limit:
        by_host: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.branch)
        shared = spark.sparkContext.broadcast({h: frozenset(b) for h, b in by_host.items()})
        return pages.mapInArrow(cut_texts(lambda batch: [shared.value.get(h, frozenset()) for h in batch.column("host").to_pylist()]), SCHEMA)
    pages = pages.withColumn("source", F.sha2(F.col("html").cast("binary"), 256))
    own = pages.dropDuplicates(["host", "source"]).select("host", "source", "html").mapInPandas(page_branches, "host string, source string, branch long")
    cut = own.join(low, ["host", "branch"]).groupBy("host", "source").agg(F.collect_set("branch").alias("low"))  # of one page: as many as its elements
    return pages.join(cut, ["host", "source"], "left").mapInArrow(cut_texts(lambda batch: [frozenset(x or ()) for x in batch.column("low").to_pylist()]), SCHEMA)


def op5_site_style_tree(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))

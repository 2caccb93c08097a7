"""Main text of web pages by wrapper induction.

The pages of a host share a template.  Every page's tree of structural elements is reduced to a skeleton
(runs of like siblings become one node); the skeletons of a host are folded into one template by simple tree
matching, the alignment of ordered trees that matches most nodes, and every page is aligned with it.

*Constants.*  A text that stands in the same template node of nearly all different pages of the host belongs to
the template; slots whose texts vary hold content.

*Region.*  Menus, adverts and footers vary too, but the article is where most varying text stands.  Varying texts
vote, over all pages of the host, with their length outside links; from the root of the template the region
goes down to the children that hold most votes, until it reaches an element that holds blocks of text itself.
A page's content is the varying slots inside the host's region, in page order.

*Marks* break ties among varying slots: elements, roles and classes that mark reader comments, adverts, notices
and the like have no votes and hold no content inside the region, and an element that is marked as the article has
more votes.  Comments, say, are longer than many articles and vary as much.

A page that has no element in its host's region, or no host, takes the region of its own tree, by its own votes.

Nothing of a host is gathered in one task: pages send each (node, text) once a partition, equal rows are
counted, and skeletons are folded in buckets and then bucket by bucket.  Paths of labels that fewer than ``RARE`` of
the host's pages have cannot hold constants and are left out of the template, so its size follows the pages' and not
their number.

Defined results for odd input: a null or empty page, or one without text, has an empty text; pages with null addresses,
or addresses that name no host, count as one host; repeated pages count once as evidence, so copies of an article never
make it a template; a page that holds nothing but template has an empty text; very long and very deep pages are
read whole, without recursion; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.llm.html_tree import Node, blocks, parse
from fallline.llm.rows import per_batch, per_partition
from fallline.llm.trees import Trees
from fallline.runtime import broadcast_if_small, cut

#: A constant stands on this share of a host's different pages and one more: two pages alike prove nothing.
SHARE = 0.8
#: Label paths on fewer of a host's pages are no part of its template.
RARE = 0.02
#: The region goes down to children with this share of the votes, unless blocks beside them have DIRECT of them.
MOST, DIRECT = 0.6, 0.1
#: Votes of a text inside an element that is marked as the article.
BOOST = 32

#: Elements that hold no text of a page.
NEVER = frozenset("select button option object video audio svg canvas head".split())
#: Elements that mark what is not the article.
ASIDE = NEVER | frozenset("nav footer aside form menu dialog search fieldset optgroup legend".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs commentlist comment comments consent cookie "
    "cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promotion promotions recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split())
#: Those of them that mark what can be longer than the article itself.
LONG_MARKS = frozenset("commentlist comment comments disqus replies respond".split())
#: Like MARKS, but only outside the article: there they hold the article's own title.
OUTER_MARKS = frozenset("header masthead topbar site top alert".split())
ARTICLE_MARKS = frozenset("articlebody article post entry story".split())
#: Elements that hold others rather than text.
CONTAINERS = frozenset("html body div section article main center form table tbody tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def is_aside(node: Node) -> bool:
    return node.hidden or node.tag in ASIDE or node.role in ASIDE_ROLES or bool(node.marks & MARKS)


def is_never(node: Node) -> bool:
    return node.hidden or node.tag in NEVER


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role == "main" or "articlebody" in node.marks


def _by_marks_only(node: Node) -> bool:
    return not (node.hidden or node.tag in ASIDE - {"form"} or node.role in ASIDE_ROLES)


class Page:
    """A page's elements and what their marks say.

    Marks and forms do not remove the body, nor what holds most of the page's text (unless that is reader comments), nor,
    where every article element is inside something marked, what holds one.
    """

    def __init__(self, root: Node, marks: bool = True):
        self.root, self.marks = root, marks
        self.parent: dict[int, Node] = {}
        order, sizes, holds, open_article = [root], {}, set(), {id(root): False}
        self.in_article: set[int] = set()
        for node in order:
            inside = id(node) in self.in_article
            for child in node.items:
                if isinstance(child, Node):
                    self.parent[id(child)] = node
                    if inside or _is_article(child):
                        self.in_article.add(id(child))
                    open_article[id(child)] = open_article[id(node)] or is_aside(child)
                    order.append(child)
        for node in reversed(order):
            n = 0
            for item in node.items:
                if not isinstance(item, Node):
                    n += len(item[0].strip())
                    continue
                n += sizes[id(item)]
                if id(item) in holds or _is_article(item):
                    holds.add(id(node))
            sizes[id(node)] = n
        self.most = {k for k, n in sizes.items() if 2 * n > sizes[id(root)]}
        free = any(_is_article(n) and not open_article[id(n)] for n in order)
        self.holds = set() if free else holds

    def whole(self, node: Node) -> bool:
        return node.tag == "body" or id(node) in self.most and not node.marks & LONG_MARKS

    def skip(self, node: Node) -> bool:
        if not self.marks:
            return is_never(node)
        return is_aside(node) and not (_by_marks_only(node) and (self.whole(node) or id(node) in self.holds))

    def skip_outer(self, node: Node) -> bool:
        return self.skip(node) or self.marks and not self.whole(node) and (node.tag == "header" or bool(node.marks & OUTER_MARKS))

    def weighed(self) -> list[tuple[Node, str, int]]:
        """(element, text, votes) of every block that may be content."""
        out = []
        for node, text, linked in blocks(self.root, self.skip):
            votes = round(len(text) * (1 - linked))
            out.append((node, text, votes * BOOST if self.marks and id(node) in self.in_article else votes))
        return out

    def content(self, regions: list[Node]) -> list[tuple[Node, str]]:
        """(element, text) of the blocks in the regions that marks leave, in page order."""
        if self.marks and all(_is_article(n) or n.marks & ARTICLE_MARKS for n in regions):
            found = [(n, t) for r in regions for n, t, _ in blocks(r, is_aside)]
            return found or [(n, t) for r in regions for n, t, _ in blocks(r, self.skip)]
        found = self._without_link_lists([b for r in regions for b in blocks(r, self.skip_outer)])
        # Where marks leave nothing, the template alone decides.
        return found or self._without_link_lists([b for r in regions for b in blocks(r, lambda n: not _by_marks_only(n) or n.tag == "header")])

    def _above(self, node: Node) -> list[int]:
        out = [id(node)]
        while (up := self.parent.get(out[-1])) is not None:
            out.append(id(up))
        return out

    def _without_link_lists(self, found: list[tuple[Node, str, float]]) -> list[tuple[Node, str]]:
        """Blocks of links before and after all other text go, but not those that end the element of the article: the
        innermost division that holds most of the other text."""
        plain = [i for i, (_, _, linked) in enumerate(found) if linked < 0.8]
        if len(plain) == len(found) or not plain:
            return [(found[i][0], found[i][1]) for i in plain]
        sizes: dict[int, int] = {}
        total = sum(len(found[i][1]) for i in plain)
        for i in plain:
            node = found[i][0]
            sizes[id(node)] = sizes.get(id(node), 0) + len(found[i][1])
        order = [self.root]
        for node in order:
            order += [i for i in node.items if isinstance(i, Node)]
        core = None
        for node in reversed(order):
            if core is None and node.tag in ("div", "section") and 2 * sizes.get(id(node), 0) > total:
                core = id(node)
            if (up := self.parent.get(id(node))) is not None:
                sizes[id(up)] = sizes.get(id(up), 0) + sizes.get(id(node), 0)
        linked_inside = [i for i, (n, _, linked) in enumerate(found) if linked >= 0.8 and core is not None and core in self._above(n)]
        last = max([plain[-1], *linked_inside])
        keep = set(plain) | {i for i in range(plain[0], plain[-1])} | set(linked_inside)
        return [(n, t) for i, (n, t, _) in enumerate(found) if i in keep and plain[0] <= i <= last]


def region(trees: Trees, t: int, votes: dict[int, int], loose: dict[int, int] | None = None) -> list[int]:
    """Places of the nodes of a template that hold the article, by the votes of the texts in its nodes; ``loose`` are the
    votes below a node that no child of it stands for."""
    total = [0] * (trees.size[t] + 1)
    for at in range(trees.size[t]):
        total[at + 1] = total[at] + max(votes.get(at, 0), 0) + ((loose or {}).get(at, 0))
    held = lambda node, at: total[at + trees.size[node]] - total[at]
    node, at = t, 0
    while True:
        tag, *marks = trees.label[node].split(".")
        every = held(node, at)
        if every <= 0 or tag == "article" or tag != "body" and ARTICLE_MARKS & set(marks):
            return [at]
        direct, heading, inner = max(votes.get(at, 0), 0), False, {}
        for k, first in zip(trees.kids[node], trees.firsts(node, at)):
            mine = held(k, first)
            kind = trees.label[k].split(".")[0]
            if kind in CONTAINERS:
                inner.setdefault(trees.label[k], []).append((mine, k, first))
            else:
                direct += mine
                heading = heading or kind in HEADINGS and mine > 0
        best = max(inner.values(), key=lambda some: sum(m for m, _, _ in some), default=[])
        if heading or direct >= DIRECT * every or sum(m for m, _, _ in best) < MOST * every:
            return [at]
        best = [b for b in best if b[0] > 0]
        if len(best) > 1:
            return [first for _, _, first in best]
        _, node, at = best[0]


def _outermost(page: Page, where: dict[int, int], wanted: set[int]) -> list[Node]:
    """Elements at the wanted places, in page order; those inside others are part of them."""
    out, stack = [], [page.root]
    while stack:
        node = stack.pop()
        if where.get(id(node)) in wanted:
            out.append(node)
        else:
            stack += [i for i in reversed(node.items) if isinstance(i, Node)]
    return out


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Reader:
    """Reads pages; what it knows of trees is bounded."""

    def __init__(self, marks: bool = True):
        self.trees, self.use_marks = Trees(), marks

    def page(self, html: str) -> tuple[Page, dict[int, int]]:
        if self.trees.full:
            self.trees = Trees()
        page = Page(parse(html), self.use_marks)
        return page, self.trees.skeletons(page.root)

    def own_region(self, page: Page, shape: dict[int, int]) -> tuple[list[Node], list[tuple[int, str, int]]]:
        """(elements of the region by the page's own votes; place, text and votes of its blocks in its own tree)."""
        mine = shape[id(page.root)]
        where = self.trees.places(page.root, shape, mine)
        found = [(where[id(n)], text, votes) for n, text, votes in page.weighed() if id(n) in where]
        votes: dict[int, int] = {}
        for at, _, n in found:
            votes[at] = votes.get(at, 0) + n
        return _outermost(page, where, set(region(self.trees, mine, votes))), found


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _evidence(pages: DataFrame, marks: bool) -> DataFrame:
    """Rows (host, shape, json): skeletons; rows (host, shape, node, value, page, votes): where which text stands on which
    different page (told by the text of its own region).  Both come once a partition."""

    def run(batches):
        seen: set = set()
        reader = Reader(marks)
        for batch in batches:
            out: list[tuple] = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if not html:
                    continue
                page, shape = reader.page(html)
                own, found = reader.own_region(page, shape)
                if not found:
                    continue
                number = _hash("\n".join(t for _, t in page.content(own)))
                source = reader.trees.dump(shape[id(page.root)])
                code = _hash(source)
                if (host, None, code) not in seen:
                    seen.add((host, None, code))
                    out.append((host, code, None, None, None, None, source))
                rows: dict[tuple[int, int], int] = {}
                for at, text, votes in found:
                    key = at, _hash(text)
                    rows[key] = rows.get(key, 0) + votes
                # Only what says the same in every row is left out: which page comes first, and with which others, must not matter.
                same = host, number, _hash(repr((code, sorted(rows.items()))))
                if same in seen:
                    continue
                seen.add(same)
                out += [(host, code, at, value, number, votes, None) for (at, value), votes in rows.items()]
            if len(seen) > 500_000:
                seen.clear()
            columns = zip(*out) if out else [()] * 7
            yield dict(zip(("host", "shape", "node", "value", "page", "votes", "json"), map(list, columns)))

    return per_partition(pages.select("host", "html"), run, "host string, shape bigint, node int, value bigint, page bigint, votes bigint, json string")


def _paths(trees: Trees, t: int) -> list[int]:
    """A hash of the labels from the root to each node, by place."""
    out = [0] * trees.size[t]
    for at, node, up in trees.walk(t):
        out[at] = _hash(f"{out[up] if up >= 0 else ''} {trees.label[node]}")
    return out


def _pruned(trees: Trees, t: int, keep: set[int]) -> int:
    """The tree without the nodes whose paths are not kept (their children's are not either)."""
    path = _paths(trees, t)
    order = [(at, node, up) for at, node, up in trees.walk(t) if up < 0 or path[at] in keep]
    kids: dict[int, list[int]] = {}
    for at, node, up in sorted(order, reverse=True):
        n = trees.make(trees.label[node], tuple(reversed(kids.get(at, ()))))
        kids.setdefault(up, []).append(n)
    return kids[-1][0]


def _fold(shapes: DataFrame, group: list[str]) -> DataFrame:
    """Fold the skeletons of each group, one group's template in memory at a time."""
    names = ["host", *[g for g in group if g != "host"]]

    def run(batches):
        trees, current, tree = Trees(), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[g] for g in names)
                if key != current:
                    if current is not None:
                        yield {"host": [current[0]], "json": [trees.dump(tree)]}
                    trees, current = Trees(), key
                    tree = trees.load(row["json"])
                    continue
                if trees.full:
                    source, trees = trees.dump(tree), Trees()
                    tree = trees.load(source)
                tree = trees.merge(tree, trees.load(row["json"]))
        if current is not None:
            yield {"host": [current[0]], "json": [trees.dump(tree)]}

    rows = shapes.select(*names, "json").repartition(*names).sortWithinPartitions(*names, "json")
    return per_partition(rows, run, "host string, json string")


def _templates(shapes: DataFrame, pages_of: DataFrame) -> DataFrame:
    """host and template of every host.  ``shapes`` has host, shape, json and the number of pages."""

    def paths(batch: pa.RecordBatch) -> dict:
        trees, out = Trees(), []
        for row in batch.to_pylist():
            if trees.full:
                trees = Trees()
            out += [(row["host"], p, row["pages"]) for p in set(_paths(trees, trees.load(row["json"])))]
        return dict(zip(("host", "path", "pages"), map(list, zip(*out)))) if out else None

    common = per_batch(shapes.select("host", "json", "pages"), paths, "host string, path bigint, pages bigint").groupBy("host", "path").agg(F.sum("pages").alias("n"))
    common = common.join(pages_of.select("host", F.col("pages").alias("all")), "host").filter(F.col("n") >= RARE * F.col("all"))
    common = common.groupBy("host").agg(F.collect_set("path").alias("keep"))  # at most nodes of a page / RARE

    def prune(batch: pa.RecordBatch) -> dict:
        trees, out = Trees(), []
        for row in batch.to_pylist():
            if trees.full:
                trees = Trees()
            out.append((row["host"], trees.dump(_pruned(trees, trees.load(row["json"]), set(row["keep"])))))
        return dict(zip(("host", "json"), map(list, zip(*out)))) if out else None

    pruned = cut(per_batch(shapes.select("host", "json").join(common, "host"), prune, "host string, json string").distinct(), "pruned")
    # A host's skeletons are folded in as many buckets as each has skeletons, and then bucket by bucket.
    buckets = pruned.groupBy("host").agg(F.ceil(F.sqrt(F.count("*"))).alias("buckets"))
    bucketed = pruned.join(broadcast_if_small(buckets), "host").withColumn("bucket", F.pmod(F.xxhash64("json"), F.col("buckets")))
    return _fold(_fold(bucketed, ["host", "bucket"]), ["host"])


def induce(pages: DataFrame, *, marks: bool = True) -> DataFrame:
    """host, template (JSON), regions (places) and constants ("place value" strings) of every host."""
    evidence = cut(_evidence(pages, marks), "evidence")
    texts = evidence.filter("page IS NOT NULL")
    # Pages of one text that differ elsewhere are one page, with all that any of them says.
    counted = texts.groupBy("host", "shape", "node", "value", "page").agg(F.max("votes").alias("votes")).groupBy("host", "shape", "node", "value").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))
    counted = cut(counted, "counted")
    per_shape = cut(texts.select("host", "shape", "page").distinct().groupBy("host", "shape").agg(F.count("*").alias("pages")), "shapes")
    pages_of = per_shape.groupBy("host").agg(F.sum("pages").alias("pages"))
    shapes = evidence.filter("json IS NOT NULL").groupBy("host", "shape").agg(F.first("json").alias("json")).join(per_shape, ["host", "shape"])
    templates = cut(_templates(shapes, pages_of), "templates").withColumnRenamed("json", "template")

    # Own node of each skeleton -> node of the host's template.
    def carried(batch: pa.RecordBatch) -> dict:
        trees, out = Trees(), []
        for row in batch.to_pylist():
            if trees.full:
                trees = Trees()
            found = trees.carried(trees.load(row["template"]), trees.load(row["json"]))
            out += [(row["host"], row["shape"], a, b, matches) for a, b, matches in found]
        return dict(zip(("host", "shape", "node", "place", "matches"), map(list, zip(*out)))) if out else None

    placed = per_batch(shapes.join(templates, "host").select("host", "shape", "json", "template"), carried, "host string, shape bigint, node int, place int, matches boolean")
    placed = cut(placed, "placed")
    # Texts on too few pages of their host for any node leave before the join.
    often = counted.groupBy("host", "value").agg(F.sum("n").alias("n")).filter("n > 1").join(pages_of, "host").filter(F.col("n") >= SHARE * (F.col("pages") + 1))
    often = cut(often.select("host", "value"), "often")
    constant = counted.join(broadcast_if_small(often), ["host", "value"], "left_semi").join(placed.filter("matches"), ["host", "shape", "node"])
    constant = constant.groupBy("host", "place", "value").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes")).join(pages_of, "host").filter(F.col("n") >= SHARE * (F.col("pages") + 1))
    constant = cut(constant.select("host", "place", "value", "votes"), "constants")
    by_node = counted.groupBy("host", "shape", "node").agg(F.sum("votes").alias("votes")).join(placed, ["host", "shape", "node"])
    by_node = by_node.select("host", "place", "matches", "votes").unionByName(constant.select("host", "place", F.lit(True).alias("matches"), (-F.col("votes")).alias("votes")))
    votes = by_node.groupBy("host", "place", "matches").agg(F.sum("votes").alias("votes"))
    votes = votes.groupBy("host").agg(F.collect_list(F.struct("place", "matches", "votes")).alias("votes"))  # a row a node of the template

    def choose(batch: pa.RecordBatch) -> dict:
        out = []
        for row in batch.to_pylist():
            trees = Trees()
            mine, loose = ({v["place"]: v["votes"] for v in row["votes"] or () if v["matches"] is which} for which in (True, False))
            out.append((row["host"], row["template"], region(trees, trees.load(row["template"]), mine, loose), row["constants"]))
        return dict(zip(("host", "template", "regions", "constants"), map(list, zip(*out)))) if out else None

    fixed = constant.groupBy("host").agg(F.collect_set(F.concat_ws(" ", "place", "value")).alias("constants"))  # at most texts / SHARE a page
    rows = templates.join(votes, "host", "left").join(fixed, "host", "left").select("host", "template", "votes", "constants")
    return per_batch(rows, choose, "host string, template string, regions array<int>, constants array<string>")


def main_text(reader: Reader, html: str | None, template: str | None, regions: list[int] | None, constants: set[str]) -> str:
    """The article of one page, given its host's wrapper (null for none)."""
    if not html:
        return ""
    page, shape = reader.page(html)
    inside, where = [], {}
    if template is not None:
        where = reader.trees.places(page.root, shape, reader.trees.load(template))
        inside = _outermost(page, where, set(regions))
    found = page.content(inside or reader.own_region(page, shape)[0])
    return "\n".join(t for n, t in found if not constants or f"{where.get(id(n), '?')} {_hash(t)}" not in constants)


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", marks: bool = True, template: bool = True) -> DataFrame:
    """key, url, text and n_chars of every page.

    Without ``marks`` only the template decides; without ``template`` all that marks leave of the page is its text.  Both
    are there to measure what the other does.
    """
    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"), pages[html].cast("string").alias("html"), host_of(pages[url]).alias("host"))
    if template:
        wrappers = cut(induce(rows, marks=marks), "wrappers")
        joined = rows.join(broadcast_if_small(wrappers), "host", "left").select("key", "url", "html", "host", "template", "regions", "constants")

    def run(batches):
        reader = Reader(marks)
        known: dict[str, set[str]] = {}
        for batch in batches:
            texts = []
            sources = batch.column("html").to_pylist()
            if not template:
                pages_of = [Page(parse(s), marks) if s else None for s in sources]
                texts = ["\n".join(t for _, t in p.content([p.root])) if p else "" for p in pages_of]
            else:
                given = (batch.column(c) for c in ("host", "template", "regions", "constants"))
                for source, host, t, at, fixed in zip(sources, *given):
                    host = host.as_py()
                    if host not in known:
                        if len(known) > 1_000:
                            known.clear()
                        known[host] = set(fixed.as_py() or ())
                    texts.append(main_text(reader, source, t.as_py(), at.as_py(), known[host]))
            yield {"key": batch.column("key"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    out = per_partition(joined if template else rows.select("key", "url", "html"), run, f"key {pages.schema[key].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string, n_chars bigint")
    return out.withColumnRenamed("key", key)

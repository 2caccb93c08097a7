"""Exact join of documents by the Jaccard similarity of their word shingles.

Jaccard distance is a metric, and the join prunes with its triangle inequality, but between most documents it is
1: there a nearest pivot says nothing, and every window around a Voronoi region would hold the whole
corpus.  So an exact filter first parts the corpus, and the metric join works inside the parts.

*Families.*  The empty set is the first pivot: distances to it order documents by size, and a document
can only match within a window of sizes.  Within a size class every document with fewer than H differing
shingles from another agrees with it exactly on some part of a hash partition of all shingles into more
than H parts (pigeonhole); shingles that many documents share are left out of the parts.  Documents that agree on a
part get an edge; the connected components of these edges are families.  Every linked pair lies in one family, and no
edge of a family is a link before the metric join has found it.

*Regions.*  A region is a set of members of which some are open; the join finds all links that have an open end.  At
first a family is a region and all of it is open.  A step takes open members as pivots (the middle of the region, then
those farthest from the pivots so far), measures every member's distance to them, and has thereby settled the pivots.
Members linked to one pivot are linked through it, so only those that are not stay open.  Then members go to the
region of their nearest pivot, and as guests to every later one in reach: if x is linked to y, whose nearest pivot is
q, then x is at most twice the threshold farther from q than from its own.  Members that the triangle inequality, for
some pivot, puts out of reach of all that is open leave.  Where regions overlap so much that a split saves no
comparison, the region stays whole, without its settled pivots.  Recursion ends where nothing is open.

Families and regions of up to ``TASK_SHINGLES`` are joined inside one task; larger ones take the same step as tables, a
level at a time, dealt into chunks of bounded size.  A large region that a split saves too little in is dealt into blocks,
so that each open member meets each member in one task, which joins them in the same way.

Equal sets are one node throughout, so copies never meet.  Sets are compared by 52-bit hashes of
shingles.  Nodes are 64-bit hashes of sets; a second one tells when two sets share a node, and then the join starts again
with other hashes.

Defined results for odd input: a null or empty text, or one without words, has no shingles and links with
nothing; a text with fewer words than a shingle has its whole sequence as its one shingle; repeated rows
are copies; rows with one key and different texts are different documents of that key; a null key is left
out when the smallest key of a component is taken, and is null where no other is there; an empty table
gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fallline.components import connected_components
from fallline.llm.rows import OUT_ROWS, per_partition
from fallline.llm.textblock import LOWER, Block, blocks, distinct_sorted, gram_hashes, mix, ranges, slice_hashes, words
from fallline.runtime import broadcast_if_small, cut, temporary

#: Shingles of the sets that one task joins, or measures against pivots.
TASK_SHINGLES = 250_000
#: Pivots of a step over tables, and members among which a task looks for them.
PIVOTS, SAMPLE = 16, 64
#: A large region is split where that leaves this share of its comparisons; else it is dealt into blocks of open members
#: and of all members.
WORTH = 0.5
#: Texts of a block of bytes, so that a text's number fits beside a 52-bit shingle.
TEXTS = 4096
#: Growth of the size classes, and parts beyond the number of differences that a class allows.
GROWTH, SLACK = 1.5, 1.25
#: Shingles that are counted in HOT_LEAST documents are left out of the parts; the HOT_MOST most frequent of them
#: are kept on every worker.  A task sends the shingles of HOT_SHARE of its documents.
HOT_SHARE, HOT_LEAST, HOT_MOST = 0.00005, 16, 262_144
#: Signatures that a map task gathers before it pre-aggregates and sends them.
GATHER = 1_000_000

_U = np.uint64
_SHINGLE_BITS = 52


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, text after text; bounds of each text's shingles)."""
    data = LOWER[block.data]
    w = words(Block(block.first, data, block.offsets))
    if not len(w.start):
        return np.empty(0, _U), np.zeros(len(block) + 1, np.int64)
    word = slice_hashes(data, w.start, w.end)
    grams = gram_hashes(word, size)
    at = np.flatnonzero(w.doc[: len(grams)] == w.doc[size - 1 :]) if len(grams) else np.empty(0, np.int64)
    docs, found = [w.doc[at]], [grams[at]]
    count = np.diff(w.first)
    for n in range(1, size):  # the whole sequence of a short text
        short = np.flatnonzero(count == n)
        if len(short):
            docs.append(short)
            found.append(mix(gram_hashes(word, n)[w.first[short]] ^ _U(n)))
    key = distinct_sorted(np.concatenate(docs).astype(_U) << _U(_SHINGLE_BITS) | np.concatenate(found) >> _U(64 - _SHINGLE_BITS))
    bounds = np.searchsorted(key, np.arange(len(block) + 1, dtype=_U) << _U(_SHINGLE_BITS))
    return key & _U((1 << _SHINGLE_BITS) - 1), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 between consecutive bounds (0 where they are equal)."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, _U)
        np.cumsum(values, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]


def nodes_of(shingles: np.ndarray, bounds: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit number for each set (as int64)."""
    with np.errstate(over="ignore"):
        return mix(_sums(mix(shingles + _U(11 + 2 * salt)), bounds) + np.diff(bounds).astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


@lru_cache(4)
def size_classes(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, most differing shingles of a pair, parts) of each size class."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    low = np.array(low, dtype=np.int64)
    top = low[1:] - 1
    # |x ∩ y| >= p / (100 + p) (|x| + |y|), so x and y differ in at most (100 - p) / (100 + p) (|x| + |y|).
    differ = (100 - percent) * 2 * top // (100 + percent)
    parts = np.where(differ == 0, 1, np.maximum(differ + 1, np.ceil(SLACK * differ).astype(np.int64) + 2))
    return low[:-1], differ, parts


def signatures(shingles: np.ndarray, bounds: np.ndarray, percent: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) pairs such that texts whose sets differ and link share a signature.

    A text appears in its own size class and in the next ones that a set of its size can still match.
    Shingles in ``hot`` (sorted) are left out of the parts: what remains of two sets differs no more than
    the sets do, and texts that share nothing but a common passage do not meet.  A non-empty part is hashed
    whole.  Where no more parts are non-empty than differences are allowed the pigeonhole fails; such texts
    also give the shortest prefix (in hash order, hot ones included) of which two linked sets must share a
    shingle.  That finds pairs of such texts; in other pairs one text has parts enough.
    """
    low, differ, parts = size_classes(percent)
    size = np.diff(bounds)
    own = np.searchsorted(low, size, side="right") - 1
    texts, found, weak = [], [], np.zeros(len(size), dtype=bool)
    whole, whole_bounds = shingles, bounds
    if len(hot):
        cold = hot[np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)] != shingles
        shingles, bounds = shingles[cold], np.concatenate([[0], np.cumsum(cold)])[bounds]
    rest = np.diff(bounds)
    coded = mix(shingles + _U(29))
    for step in range(0, 64):
        k = own + step
        who = np.flatnonzero((size > 0) & (k < len(low)) & ((step == 0) | (100 * size >= percent * low[np.minimum(k, len(low) - 1)])))
        if not len(who):
            break
        # Sets of a class that allows no difference link only if they are equal, and then they are one node.
        who, k = who[differ[k[who]] > 0], k[who[differ[k[who]] > 0]]
        if not len(who):
            continue
        length = rest[who]
        text = np.repeat(np.arange(len(who)), length)
        at = ranges(bounds[who], length)
        mine, code = shingles[at], coded[at]
        part = ((mine >> _U(_SHINGLE_BITS - 32)) * parts[k][text].astype(_U) >> _U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[len(mine) > 0], (text[1:] != text[:-1]) | (part[1:] != part[:-1])])[: len(mine)])
        edge = np.append(first, len(mine))
        of, p = text[first], part[first]
        with np.errstate(over="ignore"):
            value = mix(_sums(code, edge) + mix(k[of].astype(_U) << _U(40) | p.astype(_U)) + np.diff(edge).astype(_U))
        texts.append(who[of])
        found.append(value)
        weak[who] |= np.bincount(of, minlength=len(who)) <= differ[k]
    for i in np.flatnonzero(weak & (size > 0)):
        n = int(size[i])
        prefix = whole[whole_bounds[i] : whole_bounds[i] + n + percent * n // -100 + 1]  # n - ceil(n p / 100) + 1
        texts.append(np.full(len(prefix), i))
        found.append(mix(prefix + _U(0x5851F42D4C957F2D)))
    if not texts:
        return np.empty(0, np.int64), np.empty(0, _U)
    return np.concatenate(texts), np.concatenate(found)


def hot_shingles(docs: DataFrame, size: int, text: str) -> np.ndarray:
    """Shingles counted in HOT_LEAST documents, the HOT_MOST most frequent at most, sorted.

    Every task counts all its documents' shingles and sends those that repeat in HOT_SHARE of them.  The list
    only saves work: results are exact whatever it holds.
    """

    def run(batches):
        held, texts, waiting = [], 0, 0

        def send():
            nonlocal texts, waiting
            value, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, HOT_SHARE * texts)
            value, n = value[often], n[often]
            yield {"shingle": value.view(np.int64), "n": n}
            held.clear()
            texts = waiting = 0

        for batch in batches:
            for block in blocks(batch.column("text"), rows=TEXTS):
                shingles, _ = shingle_sets(block, size)
                held.append(shingles)
                texts += len(block)
                waiting += len(shingles)
                if waiting > 2 * GATHER:
                    yield from send()
        if held:
            yield from send()

    counts = per_partition(docs.select(docs[text].alias("text")), run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = counts.filter(f"n >= {HOT_LEAST}")
    rows = counts.orderBy(F.desc("n"), "shingle").limit(HOT_MOST).toArrow()
    return np.sort(rows.column("shingle").to_numpy().astype(_U))


def _agreeing(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each distinct value with its smallest node first; edges from other nodes to that one)."""
    if not len(value):
        return np.empty(0, np.int64), node[:0], node[:0]
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    head = node[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))]
    other = node != head
    a, b = node[other], head[other]
    del head, value
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return order[first], a[new], b[new]


_LINK = "key bigint, a bigint, b bigint, doc {kind}, text_hash bigint, n int, proof bigint"


def _candidates(docs: DataFrame, size: int, percent: int, key: str, text: str, salt: int = 0) -> DataFrame:
    """Rows (a, b): nodes that agree on a signature; rows (a, doc, text_hash, n, proof): the documents."""
    kind = docs.schema[key].dataType
    rows = docs.select(docs[key].alias("doc"), docs[text].alias("text"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("text_hash"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs, size, text))

    def edges(a: np.ndarray, b: np.ndarray | None, key: np.ndarray, doc_type: pa.DataType) -> dict:
        n = len(a)
        return {"key": key, "a": a, "b": pa.nulls(n, pa.int64()) if b is None else b, "doc": pa.nulls(n, doc_type), "text_hash": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int32()), "proof": pa.nulls(n, pa.int64())}

    def emit(batches):
        values, nodes, waiting, doc_type = [], [], 0, None

        def send():
            nonlocal waiting
            if not waiting:
                return
            value, node = np.concatenate(values), np.concatenate(nodes)
            values.clear(), nodes.clear()
            waiting = 0
            head, a, b = _agreeing(value, node)
            value, node = value[head].view(np.int64), node[head]
            # Seven columns of all of them at once would take more than the signatures themselves.
            for first in range(0, len(node), OUT_ROWS):
                yield edges(node[first : first + OUT_ROWS], None, value[first : first + OUT_ROWS], doc_type)
            for first in range(0, len(a), OUT_ROWS):
                yield edges(a[first : first + OUT_ROWS], b[first : first + OUT_ROWS], a[first : first + OUT_ROWS], doc_type)

        for batch in batches:
            doc_type = batch.schema.field("doc").type
            for block in blocks(batch.column("text"), rows=TEXTS):
                shingles, bounds = shingle_sets(block, size)
                n, node = np.diff(bounds), nodes_of(shingles, bounds, salt)
                m = len(block)
                yield {
                    "key": node, "a": pa.array(node, mask=n == 0), "b": pa.nulls(m, pa.int64()), "doc": batch.column("doc").slice(block.first, m),
                    "text_hash": batch.column("text_hash").slice(block.first, m), "n": pa.array(n, pa.int32()), "proof": nodes_of(shingles, bounds, salt + 1000),
                }
                # Texts of one set give the same signatures: one of them does.
                one = np.unique(node[n > 0], return_index=True)[1]
                one = np.flatnonzero(n > 0)[one]
                which = np.zeros(m, bool)
                which[one] = True
                of, value = signatures(shingles, bounds, percent, hot.value)
                chosen = which[of]
                values.append(value[chosen])
                nodes.append(node[of[chosen]])
                waiting += int(chosen.sum())
                if waiting > GATHER:
                    yield from send()
        yield from send()

    def meet(batches):
        last, head = None, None  # rows come in the order of key and node, so a key's first node is its smallest
        for batch in batches:
            signature = batch.column("b").is_null().to_numpy(zero_copy_only=False) & batch.column("n").is_null().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(~signature))
            value, node = batch.column("key").to_numpy()[signature], np.asarray(batch.column("a").fill_null(0))[signature]
            if not len(value):
                continue
            first = np.concatenate([[True], value[1:] != value[:-1]])
            heads = node[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))]
            if last is not None and value[0] == last:
                heads[value == last] = head
            last, head = value[-1], heads[-1]
            other = node != heads
            a, b = np.unique(np.stack([node[other], heads[other]]), axis=1)
            yield edges(a, b, a, batch.schema.field("doc").type)

    schema = _LINK.format(kind=kind.simpleString())
    met = per_partition(rows, emit, schema).repartition("key").sortWithinPartitions("key", "a")
    return per_partition(met, meet, schema).drop("key")


class Sets:
    """Sets of shingles, told by numbers; shingles of one set alone are only counted."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], dtype=np.int64)
        _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = (df > 1)[code]
        self.code = (np.cumsum(df > 1) - 1)[code[shared]].astype(np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(self.size)])]
        self.mask = np.zeros(int((df > 1).sum()), dtype=bool)

    def of(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the members' sets, one after the other; their bounds)."""
        length = self.bounds[members + 1] - self.bounds[members]
        return self.code[ranges(self.bounds[members], length)], np.concatenate([[0], np.cumsum(length)])

    def common(self, p: int, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set ``p`` with sets of the given codes."""
        mine = self.code[self.bounds[p] : self.bounds[p + 1]]
        self.mask[mine] = True
        total = np.concatenate([[0], np.cumsum(self.mask[code], dtype=np.int64)])
        self.mask[mine] = False
        return total[bounds[1:]] - total[bounds[:-1]]


def measure(sets: Sets, members: np.ndarray, open_: np.ndarray, most: int, percent: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(places of the pivots among the members, their distances to all members, whether they are linked).

    Pivots are open members: first the one nearest to the rest by the sums of intersections and unions, then always the
    one farthest from the pivots so far, up to ``most`` of them or until one pivot is linked to all.
    """
    code, bounds = sets.of(members)
    size = sets.size[members]
    often = np.bincount(code, minlength=len(sets.mask))
    total = np.concatenate([[0], np.cumsum(often[code])])
    inner = (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)
    middle = inner / (size * len(members) + size.sum() - inner)
    next_one = int(np.argmax(np.where(open_, middle, -1.0)))
    pivots, distance, linked = [], [], []
    nearest = np.full(len(members), np.inf)
    while True:
        p = members[next_one]
        common = sets.common(p, code, bounds)
        union = sets.size[p] + size - common
        pivots.append(next_one)
        distance.append(1 - common / union)
        linked.append((100 * common >= percent * union) & (common > 0))
        nearest = np.minimum(nearest, distance[-1])
        nearest[next_one] = -1.0
        left = np.where(open_, nearest, -1.0)
        next_one = int(np.argmax(left))
        if len(pivots) >= most or left[next_one] < 0 or linked[-1].all():
            return pivots, np.array(distance), np.array(linked)


def pivot_links(sets: Sets, percent: int, open_: np.ndarray | None = None, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect whatever linked pairs with an open end connect; ``count`` gets the numbers of regions and
    of distances measured added."""
    n = len(sets.size)
    reach = (100 - percent) / 100 + 1e-9
    todo = [(np.arange(n), np.ones(n, bool) if open_ is None else open_)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while todo:
        members, open_ = todo.pop()
        if len(members) < 2 or not open_.any():
            continue
        pivots, distance, linked = measure(sets, members, open_, max(4, int(np.sqrt(len(members)) / 2)), percent)
        if count is not None:
            count[0] += 1
            count[1] += distance.size
        for p, row in zip(pivots, linked):
            mine = np.flatnonzero(row)
            mine = mine[mine != p]
            found.append((members[mine], np.full(len(mine), members[p])))
        rest = np.ones(len(members), bool)
        rest[pivots] = False
        members, open_, distance, linked = members[rest], open_[rest], distance[:, rest], linked[:, rest]

        def narrowed(inside: np.ndarray, covers: list[np.ndarray]):
            """The region of the members ``inside``: its smallest cover is open, and who is in reach of it for every pivot stays."""
            cover = min((c & inside for c in covers), key=np.count_nonzero)
            if not cover.any():
                return None
            low, high = distance[:, cover].min(axis=1) - reach, distance[:, cover].max(axis=1) + reach
            inside = inside & ((distance >= low[:, None]) & (distance <= high[:, None])).all(axis=0)
            return members[inside], cover[inside]

        whole = narrowed(np.ones(len(members), bool), [open_, *~linked])
        if whole is None:
            continue
        home = distance.argmin(axis=0)
        nearest = distance.min(axis=0)
        split = []
        for j in range(len(pivots)):
            inside = (home == j) | (home < j) & (distance[j] - nearest <= 2 * reach)
            if (home == j).any() and (one := narrowed(inside, [open_, ~linked[j]])) is not None:
                split.append(one)
        cost = lambda some: sum(len(m) * int(o.sum()) for m, o in some)
        todo += split if cost(split) < cost([whole]) else [whole]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member of its component) for members that are not the smallest themselves."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _by_task(batches, size: int, handle):
    """Call ``handle`` with the rows (node, open, set) of each task; one task's rows at a time."""
    current, rows = None, {}
    for batch in batches:
        tasks, nodes, opens = (batch.column(c).to_pylist() for c in ("task", "node", "open"))
        sets: list[np.ndarray] = []
        for block in blocks(batch.column("text"), rows=TEXTS):
            shingles, bounds = shingle_sets(block, size)
            sets += [shingles[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:])]
        for task, node, open_, one in zip(tasks, nodes, opens, sets):
            if task != current:
                if rows:
                    yield handle(current, rows)
                current, rows = task, {}
            # A node can come twice, open and not.
            rows[node] = open_ or node in rows and rows[node][0], one
    if rows:
        yield handle(current, rows)


def _dealt(work: DataFrame) -> DataFrame:
    return work.select("task", "node", "open", "text").repartition("task").sortWithinPartitions("task")


def _links(work: DataFrame, size: int, percent: int, counters: tuple | None) -> DataFrame:
    """(a, b) edges that join the linked members of each task; ``work`` has task, node, open and text."""

    def handle(task, rows):
        if len(rows) < 2:
            return None
        count = [0, 0]
        nodes = sorted(rows)
        i, j = pivot_links(Sets([rows[n][1] for n in nodes]), percent, np.array([rows[n][0] for n in nodes]), count)
        for counter, n in zip(counters or (), count):
            counter.add(n)
        if not len(i):
            return None
        member, head = _forest(len(nodes), i, j)
        node = np.array(nodes, dtype=np.int64)
        return {"a": node[member], "b": node[head]}

    return per_partition(_dealt(work), lambda batches: _by_task(batches, size, handle), "a bigint, b bigint")


def _measured(work: DataFrame, texts: DataFrame, size: int, percent: int, counters: tuple | None) -> DataFrame:
    """region, node, n, open, pivots, distances and linked (both to the pivots) of the members of large regions.

    ``work`` has region, node, n and open; a task of a region looks for pivots among some open members, and tasks of
    bounded size then measure all of them.
    """
    slot = F.pmod(F.xxhash64("node", "region"), F.lit(SAMPLE))
    some = work.filter("open").groupBy("region", slot.alias("slot")).agg(F.min_by("node", F.xxhash64("node", F.lit(1))).alias("node"))
    some = some.join(texts, "node").select(F.col("region").alias("task"), "node", F.lit(True).alias("open"), "text")

    def choose(task, rows):
        nodes = sorted(rows)
        pivots = measure(Sets([rows[n][1] for n in nodes]), np.arange(len(nodes)), np.ones(len(nodes), bool), PIVOTS, percent)[0]
        return {"region": [task] * len(pivots), "p": [nodes[i] for i in pivots]}

    pivots = cut(per_partition(_dealt(some), lambda batches: _by_task(batches, size, choose), "region bigint, p bigint"), "chosen")
    chunks = work.groupBy("region").agg(F.ceil(F.sum("n") / TASK_SHINGLES).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks"))
    mine = work.join(chunks, "region").select(F.xxhash64("region", chunk).alias("task"), "region", "node", "n", F.col("open").alias("was"), F.lit(False).alias("open"))
    copies = pivots.join(chunks, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    copies = copies.select(F.xxhash64("region", F.col("chunk").cast("long")).alias("task"), F.col("p").alias("node"), F.lit(True).alias("open"))
    both = mine.select("task", "node", "open").unionByName(copies).join(texts, "node")

    def run(task, rows):
        nodes = sorted(rows)
        sets = Sets([rows[n][1] for n in nodes])
        pivots = np.array([i for i, n in enumerate(nodes) if rows[n][0]])
        code, bounds = sets.of(np.arange(len(nodes)))
        common = np.stack([sets.common(p, code, bounds) for p in pivots], axis=1)
        union = sets.size[pivots][None, :] + sets.size[:, None] - common
        for counter, n in zip(counters or (), (1, common.size)):
            counter.add(n)
        edge = pa.array(np.arange(len(nodes) + 1) * len(pivots), pa.int32())
        linked = (100 * common >= percent * union) & (common > 0)
        lists = lambda x: pa.ListArray.from_arrays(edge, pa.array(x.ravel()))
        return {"task": [task] * len(nodes), "node": nodes, "pivots": lists(np.tile(np.array(nodes)[pivots], (len(nodes), 1))), "distances": lists(1 - common / union), "linked": lists(linked)}

    out = per_partition(_dealt(both), lambda batches: _by_task(batches, size, run), "task bigint, node bigint, pivots array<bigint>, distances array<double>, linked array<boolean>")
    return out.join(mine.select("task", "region", "node", "n", F.col("was").alias("open")), ["task", "node"]).drop("task")


def _large_links(members: DataFrame, size: int, percent: int, counters: tuple | None) -> tuple[list[DataFrame], list[DataFrame]]:
    """(links to pivots; work for tasks) of families too large for one task: one level of regions after the other.
    ``members`` has family, node, n and text."""
    reach = (100 - percent) / 100 + 1e-9
    texts = members.select("node", "text")
    work = members.select(F.col("family").alias("region"), "node", "n", F.lit(True).alias("open"))
    links, tasks = [], []
    while not work.isEmpty():
        near = cut(_measured(work, texts, size, percent, counters), "near")
        ball = near.select(F.col("node").alias("a"), F.explode(F.arrays_zip("pivots", "linked")).alias("z")).filter("z.linked AND z.pivots != a")
        links.append(ball.select("a", F.col("z.pivots").alias("b")))
        rest = near.filter(~F.array_contains("pivots", F.col("node")))
        # The smallest set that has an end of every link which is still to be found: what was open, or what one pivot is not linked to.
        k = F.max(F.size("linked"))
        covers = [F.sum(F.col("open").cast("long")), *[F.when(k > q, F.sum((~F.get("linked", F.lit(q))).cast("long"))) for q in range(PIVOTS)]]
        cover = rest.groupBy("region").agg(F.array(*covers).alias("covers"), F.count("*").alias("rows"))
        cover = cover.select("region", "rows", F.array_min("covers").alias("least"), (F.array_position("covers", F.array_min("covers")) - 2).cast("int").alias("q")).filter("least > 0")
        nearest = F.array_min("distances")
        sent = rest.join(cover.select("region"), "region").select(
            "region", "node", "n", nearest.alias("nearest"), (F.array_position("distances", nearest) - 1).alias("home"),
            F.posexplode(F.arrays_zip("distances", "linked")).alias("j", "z"))
        sent = sent.filter((F.col("j") == F.col("home")) | (F.col("j") > F.col("home")) & (F.col("z.distances") - F.col("nearest") <= 2 * reach))
        sent = sent.select(F.col("region").alias("parent"), F.xxhash64("region", "j").alias("region"), "node", "n", (~F.col("z.linked")).alias("open"), F.col("z.distances").alias("d"))
        # What no open member is in reach of leaves.
        span = sent.filter("open").groupBy("region").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        sent = cut(sent.join(span, "region").filter((F.col("d") >= F.col("low") - reach) & (F.col("d") <= F.col("high") + reach)).select("parent", "region", "node", "n", "open"), "regions")
        sizes = cut(sent.groupBy("parent", "region").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"), F.sum(F.col("open").cast("long")).alias("opens")), "sizes")
        costs = sizes.groupBy(F.col("parent").alias("region")).agg(F.sum(F.col("rows").cast("double") * F.col("opens")).alias("cost"))
        cover = cut(cover.join(costs, "region", "left").withColumn("split", F.coalesce("cost", F.lit(0.0)) < WORTH * F.col("rows") * F.col("least")), "covers")
        parts = sent.join(cover.filter("split").select(F.col("region").alias("parent")), "parent").join(sizes.select("parent", "region", "weight"), ["parent", "region"]).drop("parent")
        whole = rest.join(cover.filter("NOT split").select("region", "q"), "region")
        whole = cut(whole.select("region", "node", "n", F.when(F.col("q") < 0, F.col("open")).otherwise(~F.get("linked", F.greatest("q", F.lit(0)))).alias("open")), "wholes")
        half = TASK_SHINGLES / 2
        blocks_of = whole.groupBy("region").agg(F.ceil(F.sum(F.when(F.col("open"), F.col("n"))) / half).alias("of_open"), F.ceil(F.sum("n") / half).alias("of_all"))
        wide = whole.join(blocks_of, "region")
        zero = F.lit(0).cast("long")
        one = wide.filter("open").select("region", "node", F.lit(True).alias("open"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("of_open")).alias("x"), F.explode(F.sequence(zero, F.col("of_all") - 1)).alias("y"))
        two = wide.select("region", "node", F.lit(False).alias("open"), F.explode(F.sequence(zero, F.col("of_open") - 1)).alias("x"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("of_all")).alias("y"))
        tasks.append(one.unionByName(two).select(F.xxhash64("region", "x", "y").alias("task"), "node", "open").join(texts, "node"))
        tasks.append(parts.filter(F.col("weight") <= TASK_SHINGLES).select(F.col("region").alias("task"), "node", "open").join(texts, "node"))
        work = cut(parts.filter(F.col("weight") > TASK_SHINGLES).select("region", "node", "n", "open"), "again")
    return links, tasks


def jaccard_classes(docs: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", counters: tuple | None = None) -> DataFrame:
    """doc, text_hash, n_shingles, component_id and label of every row.

    Documents link when 100 · |x ∩ y| >= percent · |x ∪ y| for their sets of ``size``-word shingles; a
    component is what links reach, and its id is its smallest key.  ``counters`` are two accumulators for the numbers
    of regions joined and of distances measured.
    """
    with temporary(docs.sparkSession) as keep:
        return _classes(docs, size, percent, key, text, counters, keep)


def _rows(docs: DataFrame, size: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, documents) under hashes that tell all sets of the table apart."""
    for salt in range(8):
        found = cut(_candidates(docs, size, percent, key, text, salt), "candidates")
        rows = found.filter("n IS NOT NULL").select("doc", "text_hash", F.col("a").alias("node"), F.col("n").cast("long").alias("n_shingles"), "proof")
        if rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("proof").alias("p"), F.max("proof").alias("q")).filter("p != q").isEmpty():
            return found, rows.drop("proof")
    raise RuntimeError("no hash tells the sets apart")


def _classes(docs: DataFrame, size: int, percent: int, key: str, text: str, counters: tuple | None, keep) -> DataFrame:
    found, rows = _rows(docs, size, percent, key, text)
    family = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    # One document of each set that has a family, with its text.
    # Copies share a node, so rows are aggregated before they are dealt by it.
    chosen = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc", "text_hash")).alias("one"), F.min("n_shingles").alias("n"))
    chosen = chosen.join(family.withColumnRenamed("label", "family"), "node")
    chosen = cut(chosen.select("node", "family", "n", F.col("one.doc").alias("doc"), F.col("one.text_hash").alias("text_hash")), "members")
    weights = cut(chosen.groupBy("family").agg(F.sum("n").alias("weight")).filter(F.col("weight") > TASK_SHINGLES), "heavy")
    large = chosen.join(broadcast_if_small(weights), "family", "left_semi").select("node").withColumn("heavy", F.lit(True))
    chosen = cut(chosen.join(large, "node", "left"), "members") if not weights.isEmpty() else chosen.withColumn("heavy", F.lit(None).cast("boolean"))
    texts = docs.select(docs[key].alias("d_doc"), docs[text].alias("text"), F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("d_hash"))
    members = texts.join(broadcast_if_small(chosen), (F.col("d_hash") == F.col("text_hash")) & F.col("d_doc").eqNullSafe(F.col("doc"))).select("node", "family", "heavy", "n", "text")
    links = _links(members.filter("heavy IS NULL").select(F.col("family").alias("task"), "node", F.lit(True).alias("open"), "text"), size, percent, counters)
    if not weights.isEmpty():
        heavy = cut(members.filter("heavy").dropDuplicates(["node"]), "large")
        more, tasks = _large_links(heavy, size, percent, counters)
        for one in more:
            links = links.unionByName(one)
        for one in tasks:
            links = links.unionByName(_links(one, size, percent, counters))
    component = connected_components(links)
    labelled = rows.join(broadcast_if_small(component), "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")
    labelled = keep(cut(labelled, "labelled"))
    # Most documents stand alone: only classes of two rows or more need their smallest key, and their table is
    # written so that the join can split a class that holds many rows.
    smallest = labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc").alias("smallest"), F.count("*").alias("rows")).filter("rows > 1").select("label", "smallest", F.lit(True).alias("many"))
    out = labelled.join(broadcast_if_small(keep(cut(smallest, "smallest"))), "label", "left")
    return out.select("doc", "text_hash", "n_shingles", F.when(F.col("many"), F.col("smallest")).otherwise(F.col("doc")).alias("component_id"), "label")


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one of the smallest key, and of these
    that of the smallest hash of its text.  Of repeated rows one stays."""
    classes = cut(jaccard_classes(docs, size=size, percent=percent, key=key, text=text), "classes")
    grouped = classes.filter("label IS NOT NULL")
    # As in _classes: only classes of two rows or more, from a table, so that a hot class needs no task of its own.
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "text_hash")).alias("first"), F.count("*").alias("rows"))
    first = cut(first.filter("rows > 1").drop("rows"), "first")
    losers = grouped.join(broadcast_if_small(first), "label").filter(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("text_hash") == F.col("first.text_hash"))))
    losers = losers.select(F.col("doc").alias("l_doc"), F.col("text_hash").alias("l_hash")).distinct()
    columns = docs.columns
    mine = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    kept = docs.join(broadcast_if_small(losers), (mine == F.col("l_hash")) & docs[key].eqNullSafe(F.col("l_doc")), "left_anti")
    again = grouped.groupBy("doc", "text_hash").count().filter("count > 1").select(F.col("doc").alias("l_doc"), F.col("text_hash").alias("l_hash"))
    if not again.isEmpty():
        of_again = (F.xxhash64(F.coalesce(kept[text].cast("string"), F.lit(""))) == F.col("l_hash")) & kept[key].eqNullSafe(F.col("l_doc"))
        repeated = kept.join(broadcast_if_small(again), of_again, "left_semi").dropDuplicates([key, text])
        kept = kept.join(broadcast_if_small(again), of_again, "left_anti").unionByName(repeated)
    return kept.select(*columns)

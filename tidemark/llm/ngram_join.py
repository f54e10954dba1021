"""N-gram Jaccard join by a token-group matrix.

Texts become sets of hashed word shingles. Equal sets are one node. Similar nodes are partitioned into
groups, the matrix keeps which tokens occur in any member of a group, what a query shares with a group's
tokens bounds its overlap with every member, and only groups that pass the bound are opened.

1. Screen. Tokens are ordered by hash. A set of ``n`` tokens that must share ``need = ceil(t n)`` of them with a
   partner shares at least ``1 + r * need`` of its first ``n - need + 1 + r * n`` tokens with the same head of the
   partner. A set whose head has fewer tokens that occur in any other set has no partner. Two screens, a narrow
   one over all sets and a wider one over what is left (which drops texts that only share a passage).
2. Group. A set joins the group of the most widely shared token of its head, so near copies meet; groups are dealt
   into blocks of about ``BLOCK`` sets, so no group has to fit a task. Members of a block meet each other. Parts of
   at least ``PIECE`` connected sets send one set each to further blocks of their group, until one block holds all that
   are sent. A component that spans several blocks then becomes a group of its own; what is in it needs no more meeting.
3. Bound. A set goes on if enough of its head tokens, then ``need`` tokens of the whole set, occur in other groups. In the order
   of how many sets hold them, the first token that two similar sets share is among the ``s - need + 1`` rarest of the ``s``
   tokens that each has left. Only these are joined with the matrix rows ``(token, group)``, so what very many sets hold, as
   a passage does, is not met by all of them; a set visits the groups of lower number with such a token in a set of fitting
   size. Every pair of similar sets that is not connected yet is met exactly once.
   Where tokens are counted, the rows of one that is hot in a sample of the sets are dealt to many tasks; no result depends
   on the sample.
4. Open. The members of a group, a block at a time, meet its visitors: a last bound on whole sets, then exact
   intersections by products of 0/1 matrices over the shared tokens.

No pairs of documents are emitted: a task returns one row per set with its number of links and enough edges to connect what
is linked. Memory of a task: two blocks. Tokens are 64-bit hashes; a collision could shift an overlap by one. Sets are told
apart by their size and a 128-bit key.

``count_links`` also counts every row's links. Then all pairs inside a cluster have to be met: groups stay blocks, and a
cluster of n sets makes about n * n / BLOCK visits.

Defined results: a null or empty text has no shingles and links with nothing; fewer words than the width make
one shingle of the whole sequence; for ``link``, rows that repeat a ``doc_id`` are one node of the graph and keep a row each,
and a null ``doc_id`` keeps its row, with no component. ``one_of_each`` goes by the texts alone: rows without words all
stay, of each component the first row by id (null last) stays, once. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import bounded_batches, free_names
from tidemark.operators.components import connected_components
from tidemark.session import cut_lineage

WIDTH = 4
PERCENT = 85
NARROW, WIDE = 20, 3  # r = 1/20 and 1/3
BLOCK = 512
VISITORS = 512
PIECE = 8
COLUMNS = 2048
CACHE_WORDS = 200_000
SAMPLE = 64
LEAST_SEEN = 64
HOT_TOKENS = 10_000
SALTS = 1024


class _Hashes(dict):
    """Hash of a word; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z are lower-cased, words end at ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _key(s: np.ndarray) -> int:
    return int(s.sum(dtype=np.uint64).astype(np.int64))


def _need(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _head(n: int, percent: int, r: int) -> int:
    return min(n, n - _need(n, percent) + 1 + n // r)


def _enough(n: Column, percent: int, r: int) -> Column:
    """Tokens of its head that a set of ``n`` must share with any partner; with an ``r`` of 1, tokens of the whole set."""
    need = F.ceil(n * percent / 100)
    return F.least(need, 1 + F.floor(need / r))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("t1"), F.hash(F.coalesce(text, F.lit(""))).alias("t2")]


def sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, t1, t2, n_shingles, k1, k2, head``: a key of the text, the size of each set, a 128-bit key of it, its narrow head."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            n, k1, k2, heads = [], [], [], []
            for text in pdf["text"]:
                s = shingles(text, width, hashes)
                n.append(len(s))
                k1.append(_key(s))
                k2.append(int(((s ^ (s >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64).astype(np.int64)))
                heads.append(s[: _head(len(s), percent, NARROW)].view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "t1": pdf["t1"], "t2": pdf["t2"], "n_shingles": n, "k1": k1, "k2": k2, "head": heads})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = bounded_batches(docs).select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", *_text_key(F.col("text")), "text")
    return rows.mapInPandas(work, f"doc_id {kind}, t1 long, t2 int, n_shingles long, k1 long, k2 long, head array<long>")


def _sampled(rows: DataFrame) -> DataFrame:
    """One in ``SAMPLE`` nodes, by hash."""
    return rows.filter(F.pmod(F.xxhash64(F.lit("hot"), "node"), F.lit(SAMPLE)) == 0)


def _hot(sample: DataFrame) -> DataFrame:
    """``t, seen``: tokens with at least a ``HOT_TOKENS``th of the ``(node, t)`` rows of the sample, so at most that many."""
    sample = cut_lineage(sample.groupBy("t").agg(F.count(F.lit(1)).alias("seen")))
    least = max(LEAST_SEEN, -(-(sample.agg(F.sum("seen")).first()[0] or 0) // HOT_TOKENS))
    return cut_lineage(sample.filter(F.col("seen") >= least))


def _dealt(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, Window]:
    """``(node, t)`` rows and a window by token that deals the rows of hot tokens to ``SALTS`` parts.

    One column, ``deal``, holds both: ``seen * SALTS`` and the part; it is null for other tokens.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    rows = rows.join(F.broadcast(hot), "t", "left").withColumn("deal", F.col("seen") * SALTS + part).drop("seen")
    return rows, Window.partitionBy("t", "deal")


def _screen(heads: DataFrame, sample: DataFrame, percent: int, r: int) -> DataFrame:
    """Of ``(node, n, t)`` rows, the sets that share enough of their head, with the shared tokens and the most shared one.

    A token that is hot in the sample is known to be shared; how often it was seen there stands for its count.
    """
    rows, by_token = _dealt(heads, _hot(sample))
    df = F.coalesce(F.floor(F.col("deal") / SALTS) * SAMPLE, F.count(F.lit(1)).over(by_token))
    found = rows.withColumn("df", df).filter("df > 1").groupBy("node").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("s"), F.max(F.struct("df", "t"))["t"].alias("top"), F.collect_list("t").alias("shared")
    )
    return found.filter(F.col("s") >= _enough(F.col("n"), percent, r)).drop("s")


def _heads(texts: DataFrame, width: int, percent: int, r: int) -> DataFrame:
    """``node, n, head`` of the texts; with an ``r`` of 1 the head is the whole set."""

    def work(batches):
        hashes = _Hashes()
        for pdf in batches:
            found = [shingles(t, width, hashes) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "n": [len(s) for s in found], "head": [s[: _head(len(s), percent, r)].view(np.int64) for s in found]})

    return texts.select("node", "text").mapInPandas(work, "node long, n long, head array<long>")


def _labels(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric 0/1 matrix: its smallest index."""
    lab = np.arange(len(linked))
    while True:
        near = np.where(linked, lab[None, :], len(lab)).min(axis=1, initial=len(lab))
        new = np.minimum(lab, near)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def compare(found: list[np.ndarray], side: np.ndarray, weight: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of side 0, or between side 0 and side 1 where there is one: weight of partners, component of each."""
    m = len(found)
    size = np.array([len(s) for s in found])
    owner = np.repeat(np.arange(m), size)
    paired = bool(side.any())
    _, col = np.unique(np.concatenate(found), return_inverse=True)
    if paired:
        here, there = (np.bincount(col[side[owner] == v], minlength=col.max() + 1) > 0 for v in (0, 1))
        shared = (here & there)[col]
    else:
        shared = np.bincount(col)[col] > 1
    alive = np.bincount(owner[shared], minlength=m) >= -(-percent * size // 100)
    keep = shared & alive[owner]
    a = np.flatnonzero(alive & (side == 0))
    b = np.flatnonzero(alive & (side == 1)) if paired else a
    linked = np.zeros((m, m), bool)
    if len(a) and len(b) and keep.any():
        _, col = np.unique(col[keep], return_inverse=True)
        owner = owner[keep]
        order = np.argsort(col, kind="stable")
        col, owner = col[order], owner[order]
        both = np.zeros((len(a), len(b)), np.float64)
        for lo in range(0, int(col[-1]) + 1, COLUMNS):
            i, j = np.searchsorted(col, [lo, lo + COLUMNS])
            dense = np.zeros((m, min(COLUMNS, int(col[-1]) + 1 - lo)), np.float32)
            dense[owner[i:j], col[i:j] - lo] = 1
            both += dense[a] @ dense[b].T
        union = size[a][:, None] + size[b][None, :] - both
        linked[np.ix_(a, b)] = 100 * both >= percent * union
        np.fill_diagonal(linked, False)
        linked |= linked.T
    return linked @ weight, _labels(linked)


def _open(tasks: DataFrame, texts: DataFrame, width: int, percent: int, block: int, inside: bool) -> DataFrame:
    """Compare the members (side 0) of each task with its visitors (side 1), some at a time, and with each other where ``inside``.

    ``node, links, other``: a node's number of linked rows there and a node it is connected with. Only part 0 of a
    group's tasks compares its members with each other.
    """
    rows = tasks.join(texts, "node").select("task", "part", "side", "node", "copies", "text")
    rows = rows.repartition("task", "part").sortWithinPartitions("task", "part", "side")

    def work(batches):
        hashes = _Hashes()
        place, members, guests = None, {}, {}

        def results(held, side):
            if len(held) > 1:
                nodes, copies, found = list(held), *zip(*held.values())
                links, label = compare(list(found), side, np.array(copies), percent)
                out = np.flatnonzero(links)
                yield pd.DataFrame({"node": [nodes[i] for i in out], "links": links[out].astype(np.int64), "other": [nodes[label[i]] for i in out]})

        def meet():
            if guests:
                yield from results({**members, **guests}, np.repeat([0, 1], [len(members), len(guests)]))
                guests.clear()

        def leave():
            yield from meet()
            if inside and place is not None and place[1] == 0:
                yield from results(members, np.zeros(len(members), np.int64))
            members.clear()

        for pdf in batches:
            for task, part, side, node, copies, text in zip(*(pdf[c].tolist() for c in ("task", "part", "side", "node", "copies", "text"))):
                if (task, part) != place:
                    yield from leave()
                    place = task, part
                held = guests if side else members
                if node not in held:
                    held[node] = copies, shingles(text, width, hashes)
                if len(guests) >= block:
                    yield from meet()
        yield from leave()

    return rows.mapInPandas(work, "node long, links long, other long")


def _copies(docs: DataFrame, width: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """Every row with its set, and the nodes (one a set): number, first row, number of rows, narrow head.

    ``by_id``: rows without an id are no nodes.
    """
    every = cut_lineage(sets(docs, width, percent))
    rows = every.filter("n_shingles > 0 AND doc_id IS NOT NULL" if by_id else "n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    nodes = rows.groupBy("n_shingles", "k1", "k2").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"), F.first("head").alias("head"))
    named = nodes.withColumn("node", F.monotonically_increasing_id())  # written, so that numbers stay
    return every, cut_lineage(named.select("node", F.col("n_shingles").alias("n"), "k1", "k2", F.col("f.doc_id").alias("rep"), "f.t1", "f.t2", "copies", "head"))


def _dealt_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` with the block of their group ``top``."""
    groups = rows.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    return rows.join(groups, "top").withColumn("block", F.shiftrightunsigned(F.xxhash64("top", part), 1)).drop("parts")


def _blocks(docs: DataFrame, nodes: DataFrame, width: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The sets that passed both screens with their block and shared head tokens, and the texts of the first screen."""
    narrow = lambda rows: rows.select("node", "n", F.explode("head").alias("t"))
    first = _screen(narrow(nodes), narrow(_sampled(nodes)), percent, NARROW).select("node")
    first = first.join(nodes.select("node", "rep", "t1", "t2", "copies"), "node")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text"), *(k.alias(f"own_{k_}") for k, k_ in zip(_text_key(text), ("t1", "t2"))))
    own = F.col("id").eqNullSafe(F.col("rep")) & (F.col("own_t1") == F.col("t1")) & (F.col("own_t2") == F.col("t2"))
    texts = cut_lineage(rows.join(first, own).select("node", "copies", "text").dropDuplicates(["node"]))
    wide = lambda rows: _heads(rows, width, percent, WIDE).select("node", "n", F.explode("head").alias("t"))
    active = cut_lineage(_screen(wide(texts), wide(_sampled(texts)), percent, WIDE))
    return cut_lineage(_dealt_blocks(active, block)), texts


def _inside(rows: DataFrame) -> DataFrame:
    """Tasks in which the members of a block meet each other only."""
    return rows.select(F.col("block").alias("task"), F.lit(0).alias("part"), F.lit(0).alias("side"), "node")


def _label(edges: DataFrame) -> DataFrame:
    """``node, component`` of all ends of ``node, other`` rows."""
    edges = edges.select(F.col("node").alias("src"), F.col("other").alias("dst"))
    return connected_components(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), edges)


def _contracted(active: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``active`` with the ``group`` of each set, and the links found on the way.

    A component that spans several blocks is a group (below 0), what is left of a block is one (from 0 on).
    """
    level, found = active.select("node", "top", "block"), None
    while True:
        more = cut_lineage(_open(_inside(level), texts, width, percent, block, True).filter("node <> other"))
        found = more if found is None else found.unionByName(more)
        label = _label(found)
        full = level.groupBy("top").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("top")
        pieces = level.join(full, "top").join(label, "node").groupBy("component", "block", "top").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
        sent = cut_lineage(_dealt_blocks(pieces.filter(F.col("n") >= PIECE).select("node", "top"), block))
        if not sent.limit(1).count():
            break
        level = sent
    rows = active.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = rows.groupBy("component").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high").select("component", F.lit(True).alias("wide"))
    group = F.when(F.col("wide"), -F.col("component") - 1).otherwise(F.col("block"))
    return cut_lineage(rows.join(spread, "component", "left").withColumn("group", group).drop("component", "wide")), found


def _spread(active: DataFrame, percent: int, r: int) -> DataFrame:
    """The sets with enough ``shared`` tokens that occur in several groups; only these tokens, rarest first.

    A token that is hot in the sample is taken to be in several, and how often it was seen there stands for its count.
    """
    columns = lambda rows: rows.select("node", "n", "group", F.explode("shared").alias("t"))
    rows, by_token = _dealt(columns(active), _hot(columns(_sampled(active))))
    df = F.coalesce(F.floor(F.col("deal") / SALTS) * SAMPLE, F.count(F.lit(1)).over(by_token))
    rows = rows.withColumns({"df": df, "lo": F.min("group").over(by_token), "hi": F.max("group").over(by_token)})
    found = rows.filter("deal IS NOT NULL OR lo < hi").groupBy("node").agg(
        F.first("n").alias("n"), F.first("group").alias("group"), F.sort_array(F.collect_list(F.struct("df", "t")))["t"].alias("shared")
    )
    return cut_lineage(found.filter(F.size("shared") >= _enough(F.col("n"), percent, r)))


def _whole(active: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The sets whose heads share enough with other groups, ``shared`` being all of their tokens."""
    near = _spread(active, percent, WIDE).select("node", "group")
    sets_ = _heads(texts.join(near, "node", "left_semi"), width, percent, 1).withColumnRenamed("head", "shared")
    return cut_lineage(sets_.join(near, "node"))


def _visits(active: DataFrame, percent: int, r: int = WIDE) -> DataFrame:
    """``node, host``: the groups of lower number in which a set of fitting size shares one of a set's rarest tokens."""
    n, enough = F.col("n"), _enough(F.col("n"), percent, r)
    rare = F.slice("shared", F.lit(1), (F.size("shared") - enough + 1).cast("int"))
    rows = _spread(active, percent, r).select("node", "n", "group", F.explode(rare).alias("t"))
    matrix = rows.groupBy("t", F.col("group").alias("host")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("most") >= percent * n) & (100 * n >= percent * F.col("least"))
    return cut_lineage(rows.join(matrix, "t").filter((F.col("host") < F.col("group")) & fits).select("node", "host").distinct())


def _tasks(active: DataFrame, visits: DataFrame, alone: bool) -> DataFrame:
    """``task, part, side, node``: the members of each group, a block at a time, and its visitors, ``VISITORS`` at a time.

    ``alone``: groups without a visitor are tasks, too.
    """
    parts = visits.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts"))
    member = active.select("node", F.col("group").alias("host"), F.xxhash64("group", "block").alias("task"))
    member = cut_lineage(member.join(parts, "host", "left" if alone else "inner").withColumn("parts", F.coalesce("parts", F.lit(1))))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    hosts = member.select("task", every.alias("part"), F.lit(0).alias("side"), "node")
    dealt = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    calls = visits.join(member.select("host", "task", "parts").distinct(), "host").select("task", dealt.alias("part"), F.lit(1).alias("side"), "node")
    return hosts.unionByName(calls)


def _found(active: DataFrame, texts: DataFrame, width: int, percent: int, block: int, count_links: bool) -> DataFrame:
    """``node, links, other`` rows that connect all that is linked."""
    if count_links:
        active, found = active.withColumn("group", F.col("block")), None
    else:
        active, found = _contracted(active, texts, width, percent, block)
    tasks = _tasks(active, _visits(_whole(active, texts, width, percent), percent, 1), count_links)
    more = cut_lineage(_open(tasks, texts, width, percent, block, count_links))
    return more if found is None else found.unionByName(more)


def _same_id(every: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes of an id that carries several texts."""
    key = ["n_shingles", "k1", "k2"]
    named = every.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *key)
    one = F.struct(*key)
    twice = named.groupBy("doc_id").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low <> high").select("doc_id")
    rows = named.join(twice, "doc_id").distinct().join(nodes.select("node", F.col("n").alias("n_shingles"), "k1", "k2"), key)
    low = rows.groupBy("doc_id").agg(F.min("node").alias("other"))
    return rows.join(low, "doc_id").select("node", "other")


def _classes(docs: DataFrame, width: int, percent: int, block: int, by_id: bool, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """Every row with its set, and ``n_shingles, k1, k2, rep, t1, t2, copies, component`` of every set, with ``links`` where counted."""
    every, nodes = _copies(docs, width, percent, by_id)
    active, texts = _blocks(docs, nodes, width, percent, block)
    found = _found(active, texts, width, percent, block, count_links)
    edges = found.select("node", "other")
    label = _label(cut_lineage((edges.unionByName(_same_id(every, nodes)) if by_id else edges).filter("node <> other")))
    rows = nodes.drop("head").withColumnRenamed("n", "n_shingles").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if count_links:
        rows = rows.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    return every, rows


def link(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, count_links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id``, and ``n_links`` (linked rows) where asked for, one row per row of ``docs``."""
    every, rows = _classes(docs, width, percent, block, True, count_links)
    names = rows.groupBy("component").agg(F.min("rep").alias("component_id"))
    n_links = [(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")] if count_links else []
    named = cut_lineage(rows.join(names, "component").select("n_shingles", "k1", "k2", "component_id", *n_links))
    out = every.select("doc_id", "n_shingles", "k1", "k2").join(named, ["n_shingles", "k1", "k2"], "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    n_links = [F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", own.alias("component_id"), *n_links)


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row of each component: the first by id, and by text where ids are equal. Rows without words stay."""
    columns, (id_, t1, t2, row) = docs.columns, free_names(docs.columns, "id", "t1", "t2", "row")
    _, rows = _classes(docs, width, percent, block, False, False)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "t1", "t2")).alias("f"))
    first = first.select(F.struct(F.col("f.rep").alias("id")).alias(id_), F.col("f.t1").alias(t1), F.col("f.t2").alias(t2))
    text = F.col("text").cast("string")
    k1, k2 = _text_key(text)
    none = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # an id in a struct equals a null one, too; rows that repeat an id and a text are one before the shuffle, which serves the join as well
    keyed = docs.filter(~none).groupBy(F.struct(F.col("doc_id").alias("id")).alias(id_), k1.alias(t1), k2.alias(t2))
    once = keyed.agg(F.first(F.struct(*columns)).alias(row)).join(first, [id_, t1, t2]).select(f"{row}.*")
    return once.unionByName(docs.filter(none))

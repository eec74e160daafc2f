"""Set-similarity self-join on word shingles by T-occurrence search (DivideSkip), and the components of its links.

Two documents link when their shingle sets' Jaccard similarity is num / den or more. The steps, all exact:

1. Documents with equal sets are one node, named by a 64-bit key of the set.
2. Routing. Two linked sets differ in at most D hashes, so if the hash space is cut into more than D parts, at most D
   parts differ. A set emits a digest of each of its fullest D + 1 parts (and of those as full): one of them is the
   same in both. Nodes that share a digest are tied to the smallest of them, and ties are closed into candidate
   components. Digests travel as blocks from each map batch; equal ones are tied there first, so a hot one costs a
   batch one entry. They are dealt by ranges whose number follows the text's length, and ranges are merged one after
   the other as their blocks arrive, so a task holds one range's different digests at most. Common shingles (from a sample of documents) are left out of the parts, so that a passage shared
   by many documents ties nothing; any such list is exact, as leaving hashes out of both sets only lowers D. A set
   with too few filled parts left emits digests of its full set as well, and at last of each hash.
3. Search. Within each candidate component, the sets are dealt into blocks of bounded size. A component of one block
   is searched by all its members. In a larger one, a few leaders (those with most shared digests) search all blocks
   first; then every member outside the largest class so found searches all blocks. Two unlinked classes so always
   had one side searched against the other, which loses no link, and a family of n copies costs n, not n squared.
   A search is DivideSkip: heap-merge of the short lists, binary probes into the long ones (all lists lie sorted in one
   array of list and id, so a candidate's probes are one vectorised binary search), and only candidates that reach the required overlap are kept; those already connected are passed over, as they can't change a component.
4. The links' components, with the smallest doc_id of each, go back to the documents by set key.

Documents are told apart by doc_id and the text's hash, never by doc_id alone, so those without one take part as all others.

Cases: a null or wordless text has an empty set and links with nothing, not even another empty one; fewer than k
words make one shingle; repeated rows and repeated texts share a component; a null doc_id takes no part in a
component's minimum and its row keeps its component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise, partitions, slices, small_batches, tidy
from loomline.llm.components import components
from loomline.llm.shingles import mix64, set_keys, shingle_sets

#: Sets and shingles that a block of a candidate component holds on average, and leaders that search a component first.
BLOCK, BLOCK_SHINGLES, LEADERS = 256, 4_000_000, 8
#: Rows of a table that may be broadcast (up to 64 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 300_000
#: Characters of text whose digests make up a range on average; about a digest for each two words, 16 bytes each.
RANGE_CHARS = 8_000_000

_EMPTY = np.empty(0, np.uint64)


def band_range(b: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest set size of band b; a band spans a factor of the square root of 2."""
    return np.ceil(2.0 ** (np.asarray(b) / 2)).astype(np.int64), np.ceil(2.0 ** ((np.asarray(b) + 1) / 2)).astype(np.int64) - 1


def _emit(hashes: np.ndarray, owner: np.ndarray, parts: np.ndarray, most: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, set, whether the set has too few filled parts): of each set's parts, those as full as its (most + 1)-th fullest."""
    base = np.cumsum(parts) - parts
    total = int(parts.sum())
    use = parts[owner] > 0
    h, o = hashes[use], owner[use]
    with np.errstate(over="ignore"):
        part = base[o] + (((h >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        full = np.bincount(part, minlength=total)
        acc = np.zeros(total, np.uint64)
        np.add.at(acc, part, mix64(h))
        of = np.repeat(np.arange(len(parts)), parts)
        fullest = full[np.lexsort((-full, of))]
        asked = np.flatnonzero(parts > 0)
        least = np.zeros(len(parts), np.int64)
        least[asked] = fullest[base[asked] + most[asked]]
        few = (parts > 0) & (least == 0)
        keep = (full > 0) & (full >= least[of])
        digest = mix64(acc + mix64((np.arange(total) - base[of]).astype(np.uint64) * _M + tag[of].astype(np.uint64)))
    return digest[keep], of[keep], few


_M = np.uint64(0x9E3779B97F4A7C15)


def digests(hashes: np.ndarray, ends: np.ndarray, num: int, den: int, common: np.ndarray = _EMPTY) -> tuple[np.ndarray, np.ndarray]:
    """(digest, set index) such that any two different sets of similarity num / den or more share a digest. common: sorted."""
    n = np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(len(n)), n)
    rare = np.ones(len(hashes), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rare = common[at] != hashes
    own = np.zeros(len(n), np.int64)
    own[n > 0] = np.floor(2 * np.log2(n[n > 0]) + 1e-9).astype(np.int64)
    own += (n > band_range(own)[1]).astype(np.int64)
    own -= ((n < band_range(own)[0]) & (n > 0)).astype(np.int64)
    found, index = [], []
    for up in (0, 1):
        band = own + up
        low, top = band_range(band)
        largest = np.minimum(n * den // num, top)  # of a partner in this band
        most = (n + largest) * (den - num) // (den + num)
        at_top = 2 * top * (den - num) // (den + num)
        parts = np.where((n > 0) & (largest >= low) & (most > 0), at_top + 3 + at_top // 8, 0)
        d, of, few = _emit(hashes[rare], owner[rare], parts, most, band * 4)
        found.append(d)
        index.append(of)
        if few.any():
            d, of, none = _emit(hashes, owner, np.where(few, parts, 0), most, band * 4 + 1)
            found.append(d)
            index.append(of)
            each = none[owner]
            with np.errstate(over="ignore"):
                found.append(mix64(hashes[each] + mix64((band[owner[each]] * 4 + 2).astype(np.uint64))))
            index.append(owner[each])
    return np.concatenate(found), np.concatenate(index)


def divide_skip(queries: list[np.ndarray], sets: list[np.ndarray], num: int, den: int, same: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (query, set) of similarity num / den or more, but for those between what is connected already.

    same: for each query, the index of the set that it itself is (else -1). Sets are sorted distinct hashes.
    """
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if sets else _EMPTY
    ids = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, ids = tokens[order], ids[order]
    lists = np.cumsum(np.append(False, tokens[1:] != tokens[:-1]))[: len(tokens)]  # number of the list that each entry is in
    entries = lists * len(sets) + ids  # ascending: a binary search in it probes any list
    root = list(range(len(sets) + len(queries)))
    classes = len(root)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(x: int, y: int) -> bool:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
        return x != y

    for q, s in enumerate(same or []):
        if s >= 0:
            classes -= join(len(sets) + q, s)
    links = []
    for q, query in enumerate(queries):
        if classes == 1:
            break
        if not len(query):
            continue
        needed = -(-num * len(query) // den)  # of any partner: overlap >= similarity x this set
        lo, hi = np.searchsorted(tokens, query), np.searchsorted(tokens, query, side="right")
        lengths = hi - lo
        by_length = np.argsort(lengths, kind="stable")
        by_length = by_length[lengths[by_length] > 0]
        if len(by_length) < needed:
            continue
        # A set that occurs needed times occurs in needed - long of the short lists at least.
        long = min(needed - 1, int(needed / (0.02 * np.log2(max(2, lengths.max())) + 1)))
        short, probed = by_length[: len(by_length) - long], by_length[len(by_length) - long :]
        for s, count in _merge_skip([ids[lo[i] : hi[i]] for i in short], needed - long):
            if find(s) == find(len(sets) + q):
                continue
            least = -(-num * (len(query) + int(n[s])) // (num + den))
            if count + long < least:
                continue
            if long:
                goal = lists[lo[probed]] * len(sets) + s
                at = np.minimum(np.searchsorted(entries, goal), len(entries) - 1)
                count += int((entries[at] == goal).sum())
            if count >= least:
                links.append((q, s))
                classes -= join(len(sets) + q, s)
    return links


def _merge_skip(lists: list[np.ndarray], needed: int) -> Iterator[tuple[int, int]]:
    """(id, number of lists with it) for ids in at least needed of the sorted lists, by a heap that skips ahead."""
    heap = [(int(x[0]), k, 0) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= needed:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        goal = top + 1
        if len(popped) >= needed:
            yield top, len(popped)
        else:  # what stays behind the needed - 1 smallest can't reach needed before the next id on the heap
            for _ in range(needed - 1 - len(popped)):
                if not heap:
                    return
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            goal = heap[0][0]
        for _, k, at in popped:
            at += int(np.searchsorted(lists[k][at:], goal))
            if at < len(lists[k]):
                heapq.heappush(heap, (int(lists[k][at]), k, at))


def common_shingles(docs: DataFrame, n_docs: int, k: int, rate: int = 16, least: int = 8, most: int = 200_000) -> np.ndarray:
    """Sorted hashes of shingles in at least max(least, 1 in 10,000) of every rate-th of n_docs documents by hash of doc_id; most at most.

    It only steers the routing, which is exact with any list; so a sample is enough, and the list's size is bounded.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(rate)) == 0).select("text")

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for i, j in slices(texts):
                h, c = np.unique(shingle_sets(texts[i:j], k)[0], return_counts=True)
                yield pd.DataFrame({"h": h[c > 1].view(np.int64), "c": c[c > 1]})

    # Those seen once in a slice are left out, which can only shorten the list.
    floor = max(least, n_docs // rate // 10_000)
    found = sample.mapInPandas(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= floor).orderBy(F.desc("c"), "h").limit(most)
    return np.sort(found.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))


def _route(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One table of two kinds of rows: 1: a tie of set a to set b, of weight n; 2: document a, whose text has hash tag, with set b of n shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    p = partitions(spark)
    n_docs, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    ranges = max(4 * p, -(-chars // RANGE_CHARS))
    common = spark.sparkContext.broadcast(common_shingles(docs, n_docs, k))

    @tidy
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = list(b["text"]), b["doc_id"]
            for i, j in slices(texts, 1_000_000):
                hashes, ends = shingle_sets(texts[i:j], k)
                keys, n = set_keys(hashes, ends), np.diff(ends, prepend=0)
                known = ids[i:j].notna().to_numpy()
                light = b"".join(x.tobytes() for x in (ids[i:j].fillna(0).to_numpy(np.int64), keys, n.astype(np.int64), known.astype(np.int64), b["tag"].to_numpy(np.int64)[i:j]))
                # each different set once
                once = np.unique(keys, return_index=True)[1]
                once = np.sort(once[n[once] > 0])
                mask = np.zeros(len(n), bool)
                mask[once] = True
                d, of = digests(hashes[np.repeat(mask, n)], np.cumsum(n[once]), num, den, common.value)
                d, node, tied = _merge(d, keys[once][of])
                to = (d % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                d, node, to = d[order], node[order], to[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                out = [(int(to[s]), 0, d[s:e].tobytes() + node[s:e].tobytes()) for s, e in zip(cuts, [*cuts[1:], len(d)], strict=False)]
                at = int(abs(int(keys[0])) % ranges) if len(keys) else 0
                out.append((at, 2, light))
                if len(tied[0]):
                    out.append((at, 1, b"".join(x.tobytes() for x in tied)))
                yield pd.DataFrame(out, columns=["range", "kind", "block"])

    @tidy
    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by range. Holds the different digests of the range at hand, each with its smallest node, and blocks not yet merged."""
        at, d, node = None, _EMPTY, np.empty(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> Iterator[pd.DataFrame]:
            nonlocal d, node
            if waiting:
                d, node, (a, b, n) = _merge(np.concatenate([d, *(x for x, _ in waiting)]), np.concatenate([node, *(x for _, x in waiting)]))
                waiting.clear()
                if len(a):
                    yield pd.DataFrame({"kind": np.full(len(a), 1, np.int32), "a": pd.Series(a, dtype="Int64"), "b": b, "n": n, "tag": 0})

        for batch in batches:
            for to, kind, block in zip(batch["range"], batch["kind"], batch["block"], strict=True):
                if kind == 0:
                    if to != at:
                        yield from merged()
                        at, d, node = to, _EMPTY, np.empty(0, np.int64)
                    half = len(block) // 2
                    waiting.append((np.frombuffer(block, np.uint64, half // 8), np.frombuffer(block, np.int64, offset=half)))
                    if len(waiting) == 256:
                        yield from merged()
                elif kind == 1:
                    a, b, n = np.frombuffer(block, np.int64).reshape(3, -1)
                    yield pd.DataFrame({"kind": np.full(len(a), 1, np.int32), "a": pd.Series(a, dtype="Int64"), "b": b, "n": n, "tag": 0})
                else:
                    a, key, n, known, tag = np.frombuffer(block, np.int64).reshape(5, -1)
                    yield pd.DataFrame({"kind": np.full(len(a), 2, np.int32), "a": pd.Series(a, dtype="Int64").mask(known == 0), "b": key, "n": n, "tag": tag})
        yield from merged()

    sent = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tag")).mapInPandas(blocks, "range int, kind int, block binary")
    sent = sent.repartition(p, "range").sortWithinPartitions("range")
    return materialise(sent.mapInPandas(tie, "kind int, a long, b long, n long, tag long"), "jaccard-route")


def _merge(d: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(different digests, the smallest node of each, ties of the other nodes to it)."""
    order = np.lexsort((node, d))
    d, node = d[order], node[order]
    first = np.ones(len(d), bool)
    first[1:] = d[1:] != d[:-1]
    cell = np.cumsum(first) - 1
    least = node[first]
    other = node != least[cell]
    size = np.bincount(cell, minlength=len(least))
    return d[first], least, _ties(node[other], least[cell][other], size[cell][other])


def _ties(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) with n summed."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order].astype(np.int64)
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], np.bincount(np.cumsum(first) - 1, n, int(first.sum())).astype(np.int64)


def _search(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows: comp, chunk, turn, role (0: member, 1: member and query, 2: query), node, shingles. Links a, b of each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members, asked = pdf[pdf["role"] < 2], pdf[pdf["role"] > 0]
        place = {x: i for i, x in enumerate(members["node"])}
        sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
        links = divide_skip([np.frombuffer(x, np.uint64) for x in asked["shingles"]], sets, num, den, [place.get(x, -1) for x in asked["node"]])
        a, b = asked["node"].to_numpy(), members["node"].to_numpy()
        return pd.DataFrame({"a": np.array([a[q] for q, _ in links], np.int64), "b": np.array([b[s] for _, s in links], np.int64)})

    return rows.groupBy("comp", "chunk", "turn").applyInPandas(run, "a long, b long")


def _member_sets(docs: DataFrame, members: DataFrame, k: int, n_members: int) -> DataFrame:
    """members: doc_id (may be null), tag, node and more. Adds shingles, the set as bytes, from a document of that doc_id and tag."""
    table = members.withColumnsRenamed({"doc_id": "__id", "tag": "__tag"})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__tag"))
    joined = docs.select("doc_id", "text").join(F.broadcast(table) if n_members <= BROADCAST_ROWS else table, same).drop("doc_id", "__id", "__tag")
    more = [f for f in members.schema if f.name not in ("doc_id", "tag")]

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            for i, j in slices(texts, 1_000_000):
                hashes, ends = shingle_sets(texts[i:j], k)
                starts = ends - np.diff(ends, prepend=0)
                part = b.iloc[i:j][[f.name for f in more]].copy()
                part["shingles"] = [hashes[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                yield part[set_keys(hashes, ends) == part["node"].to_numpy()]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more) + ", shingles binary"
    return joined.mapInPandas(run, schema).dropDuplicates(["node"])


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key, tag (the text's xxhash64), component_id, component for every row of docs (doc_id, text).

    component_id is the component's smallest doc_id, null if none of its rows has one; component is a set key that names
    the component in any case (null for an empty set, which is in none).
    """
    return _components(docs, k, num, den)[0]


def _components(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows, and the materialised tables that they are read from."""
    route = _route(docs, k, num, den)
    ties, light = route.where("kind = 1"), route.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("set_key"), F.col("n").alias("n_shingles"), "tag")
    nodes = components(ties)
    first = light.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("tag", "doc_id"), F.min("tag")).alias("tag"), F.max("n_shingles").alias("n"))
    weight = ties.select(F.col("a").alias("node"), "n").union(ties.select(F.col("b"), "n")).groupBy("node").agg(F.sum("n").alias("weight"))
    # a candidate component has two nodes or more, as only ties of different nodes are listed
    members = nodes.withColumnRenamed("component", "comp").join(weight, "node").join(first.withColumnRenamed("set_key", "node"), "node")
    sizes = members.groupBy("comp").agg(_blocks("n").alias("chunks"))
    members = materialise(members.join(sizes, "comp").select("doc_id", "tag", "node", "n", "comp", "chunks", "weight"), "jaccard-members")
    discard(nodes)
    n_members = members.count()
    first = first.select("set_key", F.col("doc_id").alias("first_id"))
    used = [route]
    if n_members:
        sets = materialise(_member_sets(docs, members, k, n_members), "jaccard-sets")
        links = _links(sets, num, den)
        comp = components(links)
        discard(sets, links)
        used.append(comp)
        labelled = first.join(comp.withColumnRenamed("node", "set_key"), "set_key", "left")
        least = labelled.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least"))
        merged = labelled.join(least, "component", "left").select("set_key", F.coalesce("least", "first_id").alias("component_id"), F.coalesce("component", "set_key").alias("component"))
    else:
        merged = first.select("set_key", F.col("first_id").alias("component_id"), F.col("set_key").alias("component"))
    discard(members)
    # the empty set's rows are their own components; its key, which many rows may have, isn't joined
    some = light.where("n_shingles > 0").join(merged, "set_key", "left")
    none = light.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    columns = ["doc_id", "n_shingles", "set_key", "tag", "component_id", "component"]
    return some.withColumn("component_id", F.coalesce("component_id", "doc_id")).select(columns).union(none.select(columns)), used


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, one_per_id: bool = True) -> DataFrame:
    """The rows of docs, all columns, one of each component: that of the smallest doc_id (any before none), then tag.

    A text without words is in no component and stays; of repeated rows (same doc_id and text) one stays, but for
    wordless ones without doc_id. one_per_id: of different texts that are left under one doc_id, only the one of the
    smallest tag stays, however unlike they are; rows without doc_id are no copies of each other for that.

    Rows are told apart by doc_id and the text's hash. What goes is usually little and joined by broadcast, behind a
    check of its size; above that, by shuffle.
    """
    rows, used = _components(docs, k, num, den)
    rows = materialise(rows, "jaccard-components")
    discard(*used)
    # in a component, all that qualify have the same doc_id, or all have none
    best = rows.where("n_shingles > 0").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component")
    stay = best.agg(F.min("doc_id").alias("doc_id"), F.min("tag").alias("tag"), F.count("*").alias("copies")).drop("component")
    rest = rows.where("n_shingles > 0 or doc_id is not null")  # others stay in any case
    stay = stay.union(rest.where("n_shingles = 0").groupBy("doc_id", "tag").agg(F.count("*").alias("copies")))
    if one_per_id:
        of_id = stay.where("doc_id is not null").groupBy("doc_id").agg(F.min("tag").alias("tag"), F.sum("copies").alias("copies"))
        stay = of_id.union(stay.where("doc_id is null"))
    twice = materialise(stay.where("copies > 1").select("doc_id", "tag"), "jaccard-twice")
    first = rest.join(stay.select(F.col("doc_id").alias("s"), F.col("tag").alias("t")), F.col("doc_id").eqNullSafe(F.col("s")) & (F.col("tag") == F.col("t")), "left_anti")
    go = materialise(first.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct(), "jaccard-go")
    discard(rows)
    tag = F.xxhash64("text")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (tag == F.col("__tag"))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    kept = docs.join(small(go), same, "left_anti")
    if twice.isEmpty():
        return kept
    twice = small(twice.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")))
    one = kept.join(twice, same, "left_semi").withColumn("__tag", tag).dropDuplicates(["doc_id", "__tag"]).drop("__tag")
    return kept.join(twice, same, "left_anti").union(one)


def _blocks(n: str) -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(n) / BLOCK_SHINGLES)).cast("int")


def _links(sets: DataFrame, num: int, den: int) -> DataFrame:
    base = sets.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("turn", F.lit(0))
    cols = ["comp", "chunk", "turn", "role", "node", "shingles"]
    every_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    small = base.where("chunks = 1").withColumn("role", F.lit(1)).select(cols)
    big = base.where("chunks > 1")
    # of each LEADERS-th of a component, by hash, the set that shares most digests
    best = big.groupBy("comp", F.pmod(F.xxhash64("node", F.lit(9)), F.lit(LEADERS)).alias("part")).agg(F.max(F.struct("weight", "node")).alias("best"))
    best = materialise(best.select("best.node"), "jaccard-leaders")
    if best.isEmpty():
        return materialise(_search(small, num, den), "jaccard-links")
    asked = big.join(best, "node").withColumn("chunk", every_chunk).withColumn("role", F.lit(2)).select(cols)
    links = materialise(_search(small.union(big.withColumn("role", F.lit(0)).select(cols)).union(asked), num, den), "jaccard-links")
    classes = components(links)
    placed = big.select("comp", "node", "n").join(classes.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    counted = placed.groupBy("comp", "class").count()
    largest = counted.groupBy("comp").agg(F.max_by("class", F.struct("count", "class")).alias("largest"))
    rest = placed.join(largest, "comp").where("class <> largest").join(best, "node", "left_anti").select("node", "comp", "n")
    rest = materialise(rest, "jaccard-rest")
    discard(best, classes)
    if rest.isEmpty():
        discard(rest)
        return links
    turns = rest.groupBy("comp").agg(_blocks("n").alias("turns"))
    turn = F.pmod(F.xxhash64("node", F.lit(5)), F.col("turns")).cast("int")
    asked = big.join(rest.select("node"), "node").join(turns, "comp").withColumn("turn", turn).withColumn("chunk", every_chunk).withColumn("role", F.lit(2)).select(cols)
    there = big.join(turns, "comp").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("role", F.lit(0)).select(cols)
    out = materialise(links.union(_search(there.union(asked), num, den)), "jaccard-links")
    discard(links, rest)
    return out

"""Benchmark decontamination: a BM25 index of test items with block-max WAND, queried by every training passage.

The items' inverted index is small (a benchmark). It is built once in each worker, of items that are broadcast behind a
check of their size; a larger benchmark is dealt into parts by hash, and each part is searched in a pass of its own. Impacts are
BM25 weights divided by the item's own score, so a passage's score is the share of an item's weight that it covers,
and one threshold holds for all items. Postings are cut into blocks of items with each term's largest impact.

Passages are windows of two strides, a stride being the longest item, so any item lies whole within one. Both are
counted in terms; words without a letter or digit take no place. A passage's distinct terms are its query. Block-max bounds of all passages of a slice are summed in numpy first; only passages
whose bound in some block reaches the threshold go through WAND, which retrieves every item that reaches it. Bounds
never fall below scores (the slack of float32 sums is taken off the threshold), so nothing is lost. For what is retrieved, the shares of the question's and of the answer's
word 5-grams that occur in the passage are measured; both must reach the least overlap.

Cases: null and empty texts and items match nothing; repeated items are each reported; repeated documents are judged
alike; a null doc_id is reported as null; a part of fewer than five words is one gram; an empty benchmark or table
gives no rows; other columns are ignored. BM25's statistics are those of a part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import materialise, resident, slices, small_batches, tidy

K1, B = 1.2, 0.75
#: Blocks of items that postings are cut into, at most; the fewer items in a block, the closer its bound.
BLOCKS = 64
#: Items and characters of a part, on average: what one index holds and one broadcast ships.
MAX_ITEMS, MAX_CHARS = 20_000, 20_000_000
GRAM = 5


def term(raw: bytes) -> str:
    """A white-space word as a term: lower case, without other than letters and digits at its ends."""
    w = raw.decode("utf-8", "surrogatepass").lower()
    i, j = 0, len(w)
    while i < j and not w[i].isalnum():
        i += 1
    while i < j and not w[j - 1].isalnum():
        j -= 1
    return w[i:j]


def terms(text: str | None) -> list[str]:
    return [t for w in text.encode("utf-8", "surrogatepass").split() if (t := term(w))] if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """What stands up to the last question mark, and after; without both, the first and second half of the words."""
    at = text.rfind("?") + 1
    question, answer = terms(text[:at]), terms(text[at:])
    if not question or not answer:
        both = terms(text)
        question, answer = both[: (len(both) + 1) // 2], both[(len(both) + 1) // 2 :]
    return question, answer


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class TermIds(dict):
    """white-space word -> term id, -1 if no item has it, -2 if it has no letter or digit; remembered, and forgotten as a whole when grown to most entries."""

    def __init__(self, ids: dict[str, int], most: int = 200_000):
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[raw] = self.ids.get(t, -1) if (t := term(raw)) else -2
        return found


class BlockMaxIndex:
    def __init__(self, items: list[tuple[int, str | None]]):
        kept = sorted(((k, t) for k, t in items if terms(t)), key=lambda x: (x[0] is None, x[0] or 0))
        self.items = [k for k, _ in kept]
        texts = [terms(t) for _, t in kept]
        self.parts = [tuple(grams(p) for p in question_and_answer(t)) for _, t in kept]
        self.stride = max([16, *map(len, texts)])
        self.ids: dict[str, int] = {}
        postings: list[dict[int, int]] = []
        for i, ws in enumerate(texts):
            for w in ws:
                k = self.ids.setdefault(w, len(postings))
                if k == len(postings):
                    postings.append({})
                postings[k][i] = postings[k].get(i, 0) + 1
        n = len(texts)
        mean = sum(map(len, texts)) / max(1, n)
        own = np.zeros(n)
        self.docs, self.impacts = [], []
        for p in postings:
            idf = np.log(1 + (n - len(p) + 0.5) / (len(p) + 0.5))
            at, tf = np.array(sorted(p)), np.array([p[i] for i in sorted(p)], float)
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.array([len(texts[i]) for i in at]) / mean))
            own[at] += impact
            self.docs.append(at.tolist())
            self.impacts.append(impact)
        self.size = max(1, -(-n // BLOCKS))  # items of a block
        blocks = -(-n // self.size)
        self.block_max = np.zeros((len(postings) + 1, blocks), np.float32)  # the last row is of no term
        for k, (at, impact) in enumerate(zip(self.docs, self.impacts, strict=True)):
            impact = impact / own[at]
            np.maximum.at(self.block_max[k], np.array(at) // self.size, (impact * (1 + 1e-6)).astype(np.float32))
            self.impacts[k] = impact.tolist()
        self.most = self.block_max.max(axis=1).tolist() if blocks else []
        self.term_id = TermIds(self.ids)

    def wand(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that the query's distinct terms give threshold or more."""
        cursors = [[self.docs[t][0], 0, t] for t in query]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.size
            if sum(float(self.block_max[c[2], block]) for c in cursors[: pivot + 1]) < threshold:
                goal = min((block + 1) * self.size, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.items))
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for c in cursors[: pivot + 1]:
                docs = self.docs[c[2]]
                if c[0] < goal:
                    c[1] = bisect_left(docs, goal, c[1] + 1)
                c[0] = docs[c[1]] if c[1] < len(docs) else len(self.items)
            cursors = [c for c in cursors if c[0] < len(self.items)]
        return found

    def search(self, texts: list[str | None], threshold: float, least: float) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap), the best passage of each text and item that both overlaps confirm."""
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        ids = np.fromiter(map(self.term_id.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if (ids == -2).any():
            sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[ids != -2], minlength=len(texts)).astype(np.int64)
            ids = ids[ids != -2]
        strides = np.maximum(1, -(-sizes // self.stride))
        base = np.cumsum(strides) - strides
        owner = np.repeat(np.arange(len(texts)), sizes)
        block = base[owner] + (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // self.stride
        hit = ids >= 0
        v = len(self.ids) + 1
        total = int(strides.sum())
        text_of = np.repeat(np.arange(len(texts)), strides)
        # window w holds strides w and w + 1 of its text; a text's last stride has no window of its own, unless it is the only one
        windows = np.append(text_of[1:] == text_of[:-1], False) | (strides[text_of] == 1)
        at, tid = block[hit], ids[hit]
        joins = at[(at > 0) & (text_of[at] == text_of[at - 1])] - 1
        before = tid[(at > 0) & (text_of[at] == text_of[at - 1])]
        pairs = np.unique(np.concatenate([at[windows[at]] * v + tid[windows[at]], joins * v + before]))
        at, tid = pairs // v, pairs % v
        bound = np.zeros(total, np.float32)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        for lo, hi in _runs(np.append(first, len(at)), 2_000_000 // max(1, self.block_max.shape[1])):
            part = first[lo:hi]
            end = first[hi] if hi < len(first) else len(at)
            bound[at[part]] = np.add.reduceat(self.block_max[tid[part[0] : end]], part - part[0], axis=0).max(axis=1)
        cuts = np.searchsorted(at, np.arange(total + 1))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        last, found = -1, []  # a text and its terms
        # a sum of m numbers in float32 is off by m units in the last place at most; a window has two strides of terms
        for w in np.flatnonzero(bound >= threshold * (1 - 2 * self.stride * 2.0**-22)).tolist():
            query = tid[cuts[w] : cuts[w + 1]].tolist()
            i = int(text_of[w])
            start = (w - int(base[i])) * self.stride
            seen = None
            for item, score in self.wand(query, threshold):
                if seen is None:
                    if i != last:
                        last, found = i, [t for x in split[i] if (t := term(x))]
                    words = found[start : start + 2 * self.stride]
                    seen = {n: grams(words, n) for n in range(1, GRAM + 1)}
                q, a = (self._share(p, seen) for p in self.parts[item])
                if min(q, a) >= least:
                    best[i, item] = max(best.get((i, item), (0.0, 0.0, 0.0)), (score, q, a))
        return [(i, item, *x) for (i, item), x in sorted(best.items())]

    @staticmethod
    def _share(part: set[tuple[str, ...]], seen: dict[int, set]) -> float:
        return sum(g in seen[len(g)] for g in part) / len(part) if part else 1.0


def _runs(edges: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of the groups between edges of about most entries each, one group at least."""
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _parts(benchmark: DataFrame) -> Iterator[tuple[tuple[int | None, str | None], ...]]:
    """The items in parts, each small enough to be broadcast, fetched one after the other."""
    n, chars = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // MAX_ITEMS), -(-chars // MAX_CHARS))
    for i in range(parts):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else benchmark
        yield tuple(sorted(((r.item_id, r.text) for r in part.select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))


def _index(items: tuple[tuple[int | None, str | None], ...]) -> BlockMaxIndex:
    return resident(("decontamination", items), lambda: BlockMaxIndex(list(items)))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row per document and item that it leaks."""
    spark = docs.sparkSession
    small_batches(spark)

    def searched(items: tuple) -> DataFrame:
        shipped = spark.sparkContext.broadcast(items)

        @tidy
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shipped.value)
            for b in batches:
                texts, ids = list(b["text"]), b["doc_id"].astype("Int64").tolist()
                for i, j in slices(texts, 1_000_000):
                    rows = [(ids[i + k], index.items[item], s, q, a) for k, item, s, q, a in index.search(texts[i:j], threshold, least)]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    found = None
    for items in _parts(benchmark):
        found = searched(items) if found is None else found.union(searched(items))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: float = 0.8) -> DataFrame:
    """The documents, all columns, that leak no item; decided row by row, so no join on doc_id is needed. Between parts of a large benchmark, what is left is written."""
    spark = docs.sparkSession
    small_batches(spark)

    def cleaned(left: DataFrame, items: tuple) -> DataFrame:
        shipped = spark.sparkContext.broadcast(items)

        @tidy
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index(shipped.value)
            for b in batches:
                texts = list(b["text"])
                keep = np.ones(len(texts), bool)
                for i, j in slices(texts, 1_000_000):
                    keep[[i + x[0] for x in index.search(texts[i:j], threshold, least)]] = False
                yield b[keep]

        return left.mapInPandas(run, left.schema)

    left, done = docs, False
    for items in _parts(benchmark):
        left, done = cleaned(materialise(left, "decontaminated") if done else left, items), True
    return left

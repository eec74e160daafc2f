"""Language identification by cross-parsing entropy over suffix automata.

For each language, a suffix automaton of labelled text. A text is cut into phrases, each the longest match that begins
there and occurs in the language's text. Cross-parsing estimates the entropy of the text under the language by
phrases x log2(length of the labelled text) / length of the text: longer labelled text has longer matches, and the
logarithm makes up for it. The language of least entropy, so of fewest normalised phrases, wins.

The automaton becomes a total transition table: where no match goes on, the step starts a new phrase and is marked. Of a
large alphabet, the table is kept as the sorted list of its transitions instead, three a symbol learned at most.
Texts are parsed in blocks of BLOCK symbols, all blocks of a slice in step, so a step of thousands of blocks is one
numpy gather. A block's first run starts without an open phrase. Blocks are then run again from the state in which the
block before them ended, until they meet their earlier run, from where on both are the same; a block that doesn't meet
it has a new end, and the block after it is run again. What results is the greedy parse of the whole text, exactly.

Training: text and lang only, of the rows that the caller passes as labelled. The sample is bounded by documented
parameters: chars_per_language characters of each language, taken from whole rows in order of a hash (rows of more than
long_row characters after all others; the last row taken is cut where the characters are full), and at most
rows_per_language rows. More than MAX_LANGUAGES languages raise an error; none is left out.

Cases: null or letterless text: und, score 0; no labelled rows: und for all, score 0; one language: it wins with
score 1; ties: the first language by code point; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import resident, slices, small_batches, tidy

#: Symbols of a block; the parse is the same for any.
BLOCK = 512
#: No more languages than this are learned at once (the tables are held in memory by each worker).
MAX_LANGUAGES = 200


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Of each state, symbol -> next state, of the minimal automaton of all factors. State 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


#: Entries of a table that is held as a whole; a larger one is held as the sorted list of its transitions.
DENSE = 8_000_000


class Steps:
    """The total transition function of an automaton. A state is its number times the alphabet; flag marks a step that begins a phrase."""

    def __init__(self, automaton: list[dict[int, int]], alphabet: int):
        # One more state, the last, is where no phrase is open: at a text's start, and after a symbol that the labelled text lacks.
        n = len(automaton) + 1
        dense = n * alphabet <= DENSE
        kind = np.int32 if dense else np.int64
        self.flag = kind(1 << (30 if dense else 62))
        self.start = kind((n - 1) * alphabet)
        keys = np.array([s * alphabet + c for s, row in enumerate(automaton) for c in row], np.int64)
        ends = np.array([t * alphabet for row in automaton for t in row.values()], kind)
        self.first = np.full(alphabet, self.start | self.flag, kind)
        for c, t in automaton[0].items():
            self.first[c] = kind(t * alphabet) | self.flag
        self.table = self.keys = None
        if dense:
            self.table = np.tile(self.first, n)
            self.table[keys] = ends
        else:
            order = np.argsort(keys)
            self.keys, self.ends = keys[order], ends[order]

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state + symbol]
        key = state + symbol
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ends[at], self.first[symbol])


class Parser:
    """Symbols 0: a run of other than letters, 1: a letter that no labelled text has, 2...: the learned letters."""

    def __init__(self, texts: dict[str, str]):
        self.languages = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if letter_table()[ord(c)]})
        self.symbols = np.zeros(0x110000, np.uint8 if len(letters) < 250 else np.uint16)
        self.symbols[letter_table()] = 1
        for i, c in enumerate(letters):
            self.symbols[ord(c)] = i + 2
        self.alphabet = len(letters) + 2
        self.steps = []
        self.bits = []  # log2 of the symbols learned
        for lang in self.languages:
            learned = self.encode(texts[lang]).tolist()
            self.bits.append(np.log2(len(learned) + 1))
            self.steps.append(Steps(suffix_automaton(learned), self.alphabet))

    def encode(self, text: str) -> np.ndarray:
        s = self.symbols[code_points(text.lower())]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [language, text], letters [text]) of whole texts."""
        pieces, owner = [], []
        letters = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            s = self.encode(t) if t else np.empty(0, self.symbols.dtype)
            letters[i] = np.count_nonzero(s)
            if letters[i]:
                pieces.append(s)
                owner.append(i)
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        if not pieces:
            return counts, letters
        sizes = np.array([len(p) for p in pieces])
        blocks = -(-sizes // BLOCK)
        total = int(blocks.sum())
        begin = np.cumsum(blocks) - blocks  # each text's first block
        size = np.minimum(np.repeat(sizes, blocks) - (np.arange(total) - np.repeat(begin, blocks)) * BLOCK, BLOCK)
        follows = np.ones(total, bool)  # whether a block goes on with the text of the one before
        follows[begin] = False
        # a column for each block, the longest first; a row for each step
        order = np.argsort(-size, kind="stable")
        column = np.empty(total, np.int64)
        column[order] = np.arange(total)
        width = int(size[order[0]])
        rows = np.zeros(total * width, self.symbols.dtype)
        for piece, at in zip(pieces, (begin * width).tolist(), strict=True):
            rows[at : at + len(piece)] = piece  # of more blocks than one, all but the last are full
        grid = np.ascontiguousarray(rows.reshape(total, width)[order].T)
        del rows, pieces
        active = np.searchsorted(-size[order], -np.arange(1, width + 1), side="right").tolist()  # blocks of more than j symbols
        of = np.repeat(np.array(owner), blocks)[order]
        last = size[order] - 1
        before = np.where(follows[order], column[np.maximum(order - 1, 0)], -1)  # the column of the block before
        for k, step in enumerate(self.steps):
            trace = np.zeros(grid.shape, self.steps[k].first.dtype)  # each symbol's state, flagged where a phrase begins
            state = np.full(total, step.start, trace.dtype)
            state_of = ~step.flag
            for j, m in enumerate(active):
                trace[j, :m] = t = step(state[:m], grid[j, :m])
                state = t & state_of
            end = trace[last, np.arange(total)] & state_of
            again = np.flatnonzero(before >= 0)
            while len(again):
                changed = self._rerun(step, grid, trace, last, again, end[before[again]])
                end[changed] = trace[last[changed], changed] & state_of
                again = np.flatnonzero(np.isin(before, changed))
            counts[k] = np.bincount(of, (trace >= step.flag).sum(axis=0), len(texts)).astype(np.int64)
        return counts, letters

    @staticmethod
    def _rerun(step: Steps, grid: np.ndarray, trace: np.ndarray, last: np.ndarray, columns: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Runs the blocks in these columns from other states, until each meets its earlier run. Returns those that don't and now end otherwise."""
        changed, j = [], 0
        while len(columns):
            t = step(state, grid[j, columns])
            state = t & ~step.flag
            unmet = state != trace[j, columns] & ~step.flag
            trace[j, columns] = t
            ended = last[columns] == j
            if ended.any():
                changed.append(columns[unmet & ended])
                unmet &= ~ended
            if not unmet.all():
                columns, state = columns[unmet], state[unmet]
            j += 1
        return np.concatenate(changed) if changed else np.empty(0, np.int64)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang, score (how much less entropy than the runner-up, as a share) and rate (phrases per letter)."""
        counts, letters = self.phrases(texts)
        if not self.languages:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "rate": 1.0})
        entropy = counts * np.array(self.bits)[:, None]
        best = entropy.argmin(axis=0)
        least = counts[best, np.arange(len(texts))]
        if len(self.languages) > 1:
            lowest, second = np.partition(entropy, 1, axis=0)[:2]
            score = np.where(letters > 0, 1 - lowest / np.maximum(second, 1e-9), 0.0)
        else:
            score = np.where(letters > 0, 1.0, 0.0)
        lang = np.where(letters > 0, np.array(self.languages, object)[best], "und")
        return pd.DataFrame({"lang": lang, "score": score, "rate": np.where(letters > 0, least / np.maximum(letters, 1), 1.0)})


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labelled: DataFrame, rows_per_language: int = 400, chars_per_language: int = 40_000, long_row: int = 4000) -> dict[str, str]:
    """The training text of each language. One pass counts the labelled rows, one takes the sample of all languages."""
    known = labelled.where("lang is not null and text is not null")
    short = F.length("text") <= long_row
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("n_short")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled; learn them in groups")
    if not counts:
        return {}
    # about twice the rows that are wanted go on to the window; a row that is repeated as it is counts once
    h = F.xxhash64("doc_id", "text", F.lit(6))
    some = F.lit(False)
    for r in counts:
        share = lambda n: min(1_000_000, 1 + 2_000_000 * rows_per_language // n) if n else 0
        least = share(r.n_short) if r.n_short >= rows_per_language else 1_000_000
        some |= (F.col("lang") == r.lang) & (F.pmod(h, F.lit(1_000_000)) < F.when(short, least).otherwise(0 if r.n_short >= rows_per_language else share(r.n - r.n_short)))
    rows = known.where(some).select("lang", F.substring("text", 1, chars_per_language).alias("t"), short.alias("short"), h.alias("h")).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy(F.desc("short"), "h")
    before = F.coalesce(F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("rank", F.row_number().over(order)).where(F.col("before") < chars_per_language).where(F.col("rank") <= rows_per_language)
    texts: dict[str, list[str]] = {}
    for r in rows.select("lang", "rank", "t").orderBy("lang", "rank").collect():
        texts.setdefault(r.lang, []).append(r.t)
    out = {lang: " ".join(ts)[:chars_per_language] for lang, ts in texts.items()}
    return {k: v for k, v in out.items() if any(c.isalpha() for c in v)}


def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return resident(("language_id", texts), lambda: Parser(dict(texts)))


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """All columns of docs and __lang, __score, __rate."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __lang string, __score double, __rate double"

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shipped.value)
        for b in batches:
            found = list(b["text"])
            parts = [parser.predict(found[i:j]) for i, j in slices(found, 1_000_000)]
            if parts:
                p = pd.concat(parts, ignore_index=True)
                yield b.assign(__lang=p["lang"].to_numpy(), __score=p["score"].to_numpy(), __rate=p["rate"].to_numpy())

    return docs.mapInPandas(run, schema)


def keep_identified(docs: DataFrame, texts: dict[str, str], most_rate: float = 0.9, letters: int = 20) -> DataFrame:
    """The rows of docs, all columns, whose text has letters and is explained by some language.

    Unexplained is a text of at least letters letters that needs more than most_rate phrases per letter in every
    language, so about one phrase for each letter.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shipped.value)
        for b in batches:
            found = list(b["text"])
            keep = np.zeros(len(found), bool)
            for i, j in slices(found, 1_000_000):
                counts, n = parser.phrases(found[i:j])
                least = counts.min(axis=0) if len(counts) else np.zeros(j - i)
                keep[i:j] = (n > 0) & ((n < letters) | (least <= most_rate * n))
            yield b[keep]

    return docs.mapInPandas(run, docs.schema)

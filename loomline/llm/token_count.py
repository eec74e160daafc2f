"""Token counts by compiled finite-state tokenizers: a cascade of two deterministic transducers.

The first reads code points (as classes that look ahead two characters) and marks where the byte-level pattern's
pieces begin. It has 8 states (and reads 9 symbols): every chunk of text is run from all of them at once, the chunks' state maps are
composed by a parallel prefix scan, and each chunk is then run from its true start.

The second reads a piece's bytes. By a property of byte-pair encoding, every prefix of a piece has one last token,
and a token may follow another exactly if the two together encode to themselves. A state holds the vocabulary-tree
nodes still open, with the token that ends where each opened and the tokens counted since; so a transition's
annotation is the change of the prefix's token count, and the sum over a piece is its count. States and transitions are
compiled when first met and kept; beyond a bound the table starts afresh. A piece's start leads to the start state
from anywhere, so chunks that begin there need no map; all pieces of a slice run in step.

Cases: null and empty texts: 0 tokens; special strings inside a text are one token each, as the library does by
default; repeated rows are counted alike; an empty table gives no rows; other columns are ignored. Letters, numbers
and spaces are those of Python's Unicode tables.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from loomline.llm.common import resident, slices, small_batches, tidy

CHUNK = 64
MAX_STATES = 200_000
#: Answers about pairs of tokens, and about open nodes, that are remembered.
MAX_KNOWN = 500_000
#: A node of the vocabulary tree with so many tokens beyond it is kept open unseen.
MANY = 12

# Symbols of the first transducer. A space or other white space is "last" if other than white space follows it.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, LAST_SPACE, LAST_WHITE, END = range(9)
# Its states: nothing open; in letters, numbers, others, white space; after a space that joins what follows; 1 or 2 characters of a contraction to come.
CLOSED, IN_L, IN_N, IN_O, IN_W, JOINING, ONE_MORE, TWO_MORE = range(8)
_OPENS = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SHORT: ONE_MORE, LONG: TWO_MORE, INNER: IN_W, LAST_SPACE: JOINING, LAST_WHITE: CLOSED}


def _piece_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins at the symbol), both [state, symbol]."""
    nxt, begins = np.zeros((8, 9), np.uint8), np.zeros((8, 9), bool)
    goes_on = {(IN_L, LETTER): IN_L, (IN_N, NUMBER): IN_N, (IN_W, INNER): IN_W}
    goes_on |= {(s, x): IN_O for s in (IN_O, JOINING) for x in (OTHER, SHORT, LONG)}
    goes_on |= {(JOINING, LETTER): IN_L, (JOINING, NUMBER): IN_N}
    goes_on |= {(TWO_MORE, x): ONE_MORE for x in range(8)} | {(ONE_MORE, x): CLOSED for x in range(8)}
    for s in range(8):
        for x in range(9):
            if x == END:
                nxt[s, x] = CLOSED
            elif (s, x) in goes_on:
                nxt[s, x] = goes_on[s, x]
            else:
                nxt[s, x], begins[s, x] = _OPENS[x], True
    return nxt, begins


_NEXT, _BEGINS = _piece_transducer()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or INNER (white space) of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    # White_Space of Unicode, fixed
    t[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = INNER
    return t


def piece_symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """points: the code points of texts, each followed by one place (at ends) that holds no character."""
    s = _classes()[points]
    s[ends] = END
    after = np.append(s[1:], np.uint8(END))
    last = (s == INNER) & (after != INNER) & (after != END)
    s[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_WHITE)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[s[quote] == OTHER]
    if len(quote):
        one, two = points[np.minimum(quote + 1, len(points) - 1)], points[np.minimum(quote + 2, len(points) - 1)]
        is_end = s[np.minimum(quote + 1, len(s) - 1)] == END
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~is_end
        is_end |= s[np.minimum(quote + 2, len(s) - 1)] == END
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~is_end
        s[quote[short]], s[quote[long]] = SHORT, LONG
    return s


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each symbol, by chunk maps and a prefix scan."""
    n = len(symbols)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)  # [step, chunk]
    maps = np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, chunks))
    flat = _NEXT.ravel()
    for row in grid:
        maps = flat[maps * np.uint8(9) + row]
    # Hillis-Steele: after the round of distance d, maps[:, i] covers the chunks i - 2d + 1 ... i
    d = 1
    while d < chunks:
        maps = np.concatenate([maps[:, :d], np.take_along_axis(maps[:, d:], maps[:, :-d].astype(np.int64), axis=0)], axis=1)
        d *= 2
    state = np.concatenate([np.zeros(1, np.uint8), maps[CLOSED, :-1]])
    out = np.empty((CHUNK, chunks), bool)
    begins = _BEGINS.ravel()
    for j, row in enumerate(grid):
        at = state * np.uint8(9) + row
        out[j] = begins[at]
        state = flat[at]
    return out.T.reshape(-1)[:n]


class BpeTransducer:
    """bytes of a piece -> number of its tokens, by a deterministic transducer compiled as it is used."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for m in merges:
            self.made.setdefault(m[0] + m[1], m)
        self.spines: tuple[dict, dict] = ({}, {})
        self.tokens = {bytes([i]) for i in range(256)} | {a + b for a, b in merges}
        # The vocabulary tree: child[node, byte]; word[node] is the token that ends there.
        self.child: dict[tuple[int, int], int] = {}
        self.word: list[bytes | None] = [None]
        for t in self.tokens:
            node = 0
            for b in t:
                node = self.child.setdefault((node, b), len(self.word))
                if node == len(self.word):
                    self.word.append(None)
            self.word[node] = t
        self.below: list[list[bytes]] = [[] for _ in self.word]  # tokens that lie beyond a node, MANY at most
        for t in self.tokens:
            node = 0
            for b in t[:-1]:
                node = self.child[node, b]
                if len(self.below[node]) < MANY:
                    self.below[node].append(t)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.open: dict[tuple[int, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.columns = np.zeros(256, np.int64)  # of each byte; 0: none yet
        self.used = 1
        self.next = np.full((1024, 96), -1, np.int32)
        self.change = np.zeros((1024, 96), np.int8)  # a byte changes a prefix's count by less than the longest token
        self.state(((0, b"", 0),))

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair encoding: the pair of lowest rank is merged, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), len(self.ranks)), i) for i in range(len(parts) - 1))
            if rank == len(self.ranks):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int, int]]:
        """What stood at the token's left (0) or right (1) end while it was merged, the token itself first: symbol, rank of the merge that made it, rank of the merge that took it up."""
        found = self.spines[side].get(token)
        if found is None:
            found, end, t = [], len(self.ranks), token
            while True:
                made = self.made.get(t)
                start = -1 if made is None else self.ranks[made]
                found.append((t, start, end))
                if made is None:
                    break
                t, end = made[side], start
            self.spines[side][token] = found
        return found

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether b can be the token after a (after nothing, if a is empty).

        A merge's rank is above those that made its parts, so a text is merged in the order of ranks. The two tokens
        stay apart unless, at some time, what stood on either side of their border had a merge due before the merge
        that took up either (at equal ranks, the leftmost goes first).
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > MAX_KNOWN:
                self.pairs.clear()
            if not a:
                found = self.encode(b) == [b]
            else:
                left, right = self.spine(a, 1), self.spine(b, 0)
                i = j = 0
                found = True
                while True:
                    (x, x_start, x_end), (y, y_start, y_end) = left[i], right[j]
                    rank = self.ranks.get((x, y))
                    if rank is not None and rank < x_end and rank <= y_end:
                        found = False
                        break
                    if x_start < 0 and y_start < 0:
                        break
                    if x_start > y_start:
                        i += 1
                    else:
                        j += 1
            self.pairs[a, b] = found
        return found

    def stays_open(self, node: int, before: bytes) -> bool:
        """Whether some token beyond node may follow before (taken for granted below nodes with many tokens)."""
        found = self.open.get((node, before))
        if found is None:
            if len(self.open) > MAX_KNOWN:
                self.open.clear()
            below = self.below[node]
            found = self.open[node, before] = len(below) >= MANY or any(self.follows(before, t) for t in below)
        return found

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.next):
                more = len(self.next) // 4
                self.next = np.concatenate([self.next, np.full_like(self.next[:more], -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change[:more])])
        return found

    def column(self, byte: int) -> int:
        if not self.columns[byte]:
            if self.used == self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full((len(self.next), 32), -1, np.int32)], axis=1)
                self.change = np.concatenate([self.change, np.zeros((len(self.change), 32), np.int8)], axis=1)
            self.columns[byte] = self.used
            self.used += 1
        return int(self.columns[byte])

    def compile(self, state: int, byte: int) -> None:
        """Adds the transition of state on byte."""
        going, last = [], None
        for node, before, count in self.states[state]:
            to = self.child.get((node, byte))
            if to is None:
                continue
            if self.stays_open(to, before):
                going.append((to, before, count))
            t = self.word[to]
            if last is None and t is not None and self.follows(before, t):
                last = (t, count + 1)
        if last is None:
            raise ValueError("no token ends here: the merges are not those of a byte-pair encoding")
        t, change = last
        key = (*((node, before, count - change) for node, before, count in going), (0, t, 0))
        column = self.column(byte)
        to = self.state(key)
        self.next[state, column] = to
        self.change[state, column] = change

    def counts(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of tokens of each piece data[start:start + size]; all sizes are 1 at least."""
        if len(self.states) > MAX_STATES:
            self.reset()
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        out = np.zeros(len(starts), np.int64)
        state = np.zeros(len(starts), np.int32)
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        for b in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            self.column(b)
        symbols = self.columns[data]
        j = 0
        while j < len(active) and active[j] >= 16:
            m = active[j]
            column = symbols[starts[:m] + j]
            to = self.next[state[:m], column]
            while (missing := np.flatnonzero(to < 0)).size:
                for s, c in {(int(state[i]), int(data[starts[i] + j])) for i in missing}:
                    self.compile(s, c)
                to[missing] = self.next[state[missing], column[missing]]
            out[:m] += self.change[state[:m], column]
            state[:m] = to
            j += 1
        for i in range(int(active[j]) if j < len(active) else 0):  # few long pieces are left: one by one
            s, total = int(state[i]), 0
            for b in data[starts[i] + j : starts[i] + sizes[i]].tolist():
                c = int(self.columns[b])
                if self.next[s, c] < 0:
                    self.compile(s, b)
                total += int(self.change[s, c])
                s = int(self.next[s, c])
            out[i] += total
        back = np.empty(len(out), np.int64)
        back[order] = out
        return back


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE with the standard pattern can be compiled")
        shown = _shown_bytes()
        raw = lambda s: bytes(shown[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.specials = sorted((t["content"] for t in spec["added_tokens"] if t["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.bpe = BpeTransducer([(raw(a), raw(b)) for a, b in pairs])

    def _parts(self, text: str) -> tuple[list[str], int]:
        """What lies between special strings, and their number; the leftmost counts, of those the longest."""
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            parts = [t]
            if self.special and any(s in t for s in self.specials):
                parts, out[i] = self._parts(t)
            for p in parts:
                if p:
                    pieces.append(p)
                    owner.append(i)
        if not pieces:
            return out
        joined = "\0".join(pieces) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) + 1 for p in pieces])
        ends = np.cumsum(lengths) - 1
        begins = piece_starts(piece_symbols(points, ends))
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        place = np.cumsum(width) - width
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        stops = begins.copy()
        stops[ends] = True  # a piece ends where the next begins or its text ends
        edges = np.flatnonzero(stops)
        first = begins[edges]
        starts, after = place[edges], np.append(place[edges[1:]], len(data))
        starts, sizes = starts[first], (after - starts)[first]
        n = self.bpe.counts(data, starts, sizes)
        of = np.searchsorted(ends, edges[first])
        np.add.at(out, np.array(owner)[of], n)
        return out


def _shown_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies show for each byte: printable Latin-1 itself, the others from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(others)}


def tokenizer(path: str) -> Tokenizer:
    return resident(("token_count", path), lambda: Tokenizer(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. path: the vocabulary file, on every executor."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path)
        for b in batches:
            texts = list(b["text"])
            for i, j in slices(texts):
                n = t.counts(texts[i:j])
                size = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in texts[i:j]]
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i:j], "n_bytes": np.array(size, np.int64), "n_tokens": n, "over_limit": n > limit})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

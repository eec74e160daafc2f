"""URL filters: a sorted array of 64-bit xxhash digests, memory-mapped, probed by vectorised binary search.

Each rule (host suffix + path prefix, block or allow) is stored under the digest of its full string; the strings
themselves lie beside the digests, and a hit counts only if its string equals the probe's (digests can collide).
For a url only the shapes that rules have are probed: pairs of number of host labels and length of path prefix.
The longest rule that fits wins. A rule list is built once, shipped by broadcast behind a check of its size, and
mapped by each Python worker from a file of its own that is unlinked at once, so nothing stays on the disk.

Cases: null or no "://": host and path are empty and no rule fits; an empty host matches no rule; repeated rules: the
last one wins; an empty table or rule list is allowed; other columns are kept apart.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule list above this many bytes isn't broadcast but refused: split it by host and join per part.
MAX_BYTES = 512 << 20

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


class DigestArray:
    """Sorted digests with their strings and values, in one file: header, digests, string ends, values, strings."""

    def __init__(self, buffer: np.ndarray):
        head = buffer[:24].view(np.uint64)
        n, shapes = int(head[0]), int(head[1])
        at = 24
        self.digests = buffer[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = buffer[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.shapes = [tuple(x) for x in buffer[at : at + 16 * shapes].view(np.int64).reshape(-1, 2).tolist()]
        at += 16 * shapes
        self.values = buffer[at : at + n]
        self.strings = buffer[at + n :]

    @staticmethod
    def pack(rules: Iterable[tuple[str, str]]) -> bytes:
        """rules: (string, 'block' or 'allow')."""
        found = {s: v == "block" for s, v in rules}
        keys = sorted(found, key=lambda s: (xxhash.xxh64_intdigest(s.encode()), s))
        raw = [s.encode() for s in keys]
        shapes = sorted({(s.partition("/")[0].count(".") + 1, len(s) - len(s.partition("/")[0])) for s in keys})
        parts = [np.array([len(keys), len(shapes), 0], np.uint64), np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64), np.cumsum([len(r) for r in raw], dtype=np.uint64), np.array(shapes, np.int64).reshape(-1), np.array([found[s] for s in keys], np.uint8)]
        return b"".join(p.tobytes() for p in parts) + b"".join(raw)

    @classmethod
    def mapped(cls, packed: bytes) -> DigestArray:
        with tempfile.NamedTemporaryFile(dir=os.environ.get("TMPDIR") if os.path.isdir(os.environ.get("TMPDIR", "")) else None) as f:
            f.write(packed)
            f.flush()
            return cls(np.memmap(f.name, np.uint8, "r"))

    def string(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.strings[start : int(self.ends[i])].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The entry of each probe, -1 if there is none."""
        out = np.full(len(probes), -1, np.int64)
        if not probes or not len(self.digests):
            return out
        q = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.digests, q)
        hit = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == q))
        for k in hit.tolist():
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == q[k]:
                if self.string(i) == probes[k]:
                    out[k] = i
                    break
                i += 1
        return out


@lru_cache(maxsize=2)
def _mapped(packed: bytes) -> DigestArray:
    return DigestArray.mapped(packed)


def judge(urls: Iterable[str | None], index: DigestArray, default: str = "allow") -> pd.DataFrame:
    hosts, paths = zip(*map(split_url, urls), strict=True) if len(urls) else ((), ())
    probes, owner = [], []
    for k, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        if not h:
            continue
        labels = h.split(".")
        for n, length in index.shapes:
            if n <= len(labels) and length <= len(p):
                probes.append((".".join(labels[-n:]) + p[:length]).encode("utf-8", "surrogatepass"))
                owner.append(k)
    best: dict[int, int] = {}
    for k, i in zip(owner, index.find(probes).tolist(), strict=True):
        if i >= 0 and (k not in best or len(index.string(i).decode()) > len(index.string(best[k]).decode())):
            best[k] = i
    rule = [index.string(best[k]).decode() if k in best else None for k in range(len(hosts))]
    verdict = [("block" if index.values[best[k]] else "allow") if k in best else default for k in range(len(hosts))]
    return pd.DataFrame({"host": list(hosts), "path": list(paths), "rule": rule, "verdict": verdict})


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """The id column, host, path, rule and verdict of every row."""
    packed = DigestArray.pack(rules)
    if len(packed) > MAX_BYTES:
        raise ValueError(f"the rules take {len(packed)} bytes; {MAX_BYTES} can be broadcast")
    shipped = pages.sparkSession.sparkContext.broadcast(packed)
    kind = pages.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _mapped(shipped.value)
        for b in batches:
            out = judge(list(b["__url"]), index, default)
            out.insert(0, id_column, b[id_column].to_numpy())
            yield out

    return pages.select(id_column, F.col("url").alias("__url")).mapInPandas(run, f"`{id_column}` {kind}, host string, path string, rule string, verdict string")

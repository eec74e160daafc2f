import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import mixing, sharding, url_filter, warc
from tests.llm.helpers import EDGE, edge, empty

PAGE = "page_id long, url string, html string"


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 200, "<b>x</b>" * 200
    rows = [(1, "http://a/1", big), (2, None, None), (3, "http://a/3", big), (4, "u", "small"), (5, "u", "small"), (6, "u", other), (9, "u\r\nx", big), (9, "v", big), (None, "n", big), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 100)]
    out = warc.round_trip(spark.createDataFrame(rows, PAGE).repartition(3)).collect()
    assert len(out) == len(rows)
    want = sorted((str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and p != 9 else "response", 9 if h == big and p != 9 else None) for p, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_normaliser_makes_members(tmp_path):
    import gzip

    mono = tmp_path / "a.mono.warc.gz"
    data = [warc.record(i, "u", b"x" * i * 1000, None) for i in range(5)]
    mono.write_bytes(gzip.compress(b"".join(data)))
    target = f"file://{tmp_path}/a.warc.gz"
    assert warc.normalise_file(f"file://{mono}", target) == 5
    raw = (tmp_path / "a.warc.gz").read_bytes()
    entries = list(warc.read_index(f"{target}.idx"))
    assert [gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]) for e in entries] == data
    assert not mono.exists() and warc.normalise_file(f"file://{mono}", target) == 5
    for cut in (1, 8, 40, 10_000):
        mono.write_bytes(gzip.compress(b"".join(data), 0)[:-cut])
        with pytest.raises(ValueError, match="ends within"):
            warc.normalise_file(f"file://{mono}", f"file://{tmp_path}/b.warc.gz")
        assert mono.exists() and not (tmp_path / "b.warc.gz").exists()
    mono.write_bytes(b"")
    with pytest.raises(ValueError, match="no gzip member"):
        warc.normalise_file(f"file://{mono}", f"file://{tmp_path}/b.warc.gz")


def test_inflation_is_bounded(monkeypatch):
    import gzip
    import io

    monkeypatch.setattr(warc, "_READ", 1000)
    data = b"a" * 300_000 + bytes(range(256)) * 50
    stream = gzip.compress(data) + b"\0" * 2000 + gzip.compress(b"") + gzip.compress(b"end")
    pieces = list(warc.inflate(io.BytesIO(stream)))
    assert b"".join(pieces) == data + b"end" and max(map(len, pieces)) <= 1000


def test_names_of_stores():
    for path, want in (("s3a://bucket/key", "s3://bucket/key"), ("file:///tmp/x", "file:///tmp/x")):
        assert warc.store_uri(path) == want


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def test_url_parts():
    for url, want in [("http://A.Com/x?y#z", ("a.com", "/x")), ("x://h", ("h", "")), ("x://h?q/z", ("h", "")), ("x://h#a/b", ("h", "")), ("no scheme/x", ("", "")), (None, ("", "")), ("", ("", "")), ("a://b://c/d", ("b:", "//c/d")), ("://É.com/É", ("É.com", "/É"))]:
        assert url_filter.split_url(url) == want


def test_url_rules():
    index = url_filter.DigestArray.mapped(url_filter.DigestArray.pack(RULES))
    urls = ["http://example.com/en/79", "http://a.example.com/en/8", "http://xexample.com/en/7", "http://com/en/", "http://b.net/de/", "http://example.net/de/8x", "http://telecom/en/", "http://x.org/es", "http://x.org/es/", None, "http:///en/"]
    out = url_filter.judge(urls, index)
    assert out["rule"].tolist() == ["example.com/en/7", "com/en/", "com/en/", "com/en/", "net/de/", "example.net/de/8", None, None, "org/es/", None, None]
    assert out["verdict"].tolist() == ["allow", "block", "block", "block", "allow", "block", "allow", "allow", "block", "allow", "allow"]
    nothing = url_filter.DigestArray.mapped(url_filter.DigestArray.pack([]))
    assert url_filter.judge(["http://a/b"], nothing)["verdict"].tolist() == ["allow"]


def test_url_digest_collisions(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    index = url_filter.DigestArray.mapped(url_filter.DigestArray.pack(RULES))
    assert index.find([s.encode() for s, _ in RULES]).min() >= 0
    assert index.find([b"com/xx/", b"zz"]).tolist() == [-1, -1]


def test_url_edges(spark):
    df = spark.createDataFrame([(1, None, ""), (1, "http://a.com/en/", ""), (None, "x", "")], PAGE).withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    out = url_filter.filter_urls(df, RULES).collect()
    assert sorted(str(r.rule) for r in out) == ["None", "None", "com/en/"]
    assert url_filter.filter_urls(df.limit(0), RULES).count() == 0


def brute_targets(sizes, weights, share, repeats):
    left, target = {s: w for s, w in zip(sizes, weights, strict=True)}, {}
    budget = share * sum(sizes.values())
    while True:
        rest = budget - sum(target.values())
        over = [s for s in left if rest * left[s] / sum(left.values()) > repeats * sizes[s] + 1e-9]
        if not over:
            return target | {s: rest * w / sum(left.values()) for s, w in left.items()}
        for s in over:
            target[s] = float(repeats * sizes[s])
            del left[s]
        if not left:
            return target


@pytest.mark.parametrize("sizes", [{"0a": 10, "0b": 100, "0c": 1000, "0d": 5, "1": 50}, {"0a": 7}, {"0a": 0, "0b": 10}, {"0a": 1, "0b": 1, "0c": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source_key string, source_size long")
    got = {r.source_key: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert got == pytest.approx(want)


def brute_queue(plan, repeats, share):
    """(row, copy) -> words served, of one queue over rows of (row, source, size, end, source_size, target)."""
    packets = []
    for row, source, size, end, source_size, target in plan:
        for copy in range(repeats):
            for at in range(0, size, mixing.PACKET):
                words = min(mixing.PACKET, size - at)
                packets.append(((end - size + at + words + copy * source_size) / target, source, end, copy, at, words, row))
    left, got = int(sum({s: t for _, s, *_, t in plan}.values())), {}
    for *_, words, row in sorted(packets):
        got[row] = got.get(row, 0) + min(words, left)
        left -= min(words, left)
    return got


@pytest.mark.parametrize("packet", [256, 7])
def test_mix(spark, monkeypatch, packet):
    monkeypatch.setattr(mixing, "PACKET", packet)
    rows = [(i, " ".join(["w"] * (i * 7 % 50 if i != 5 else 1500)), "en", None if i % 11 == 0 else f"s{i % 4}", 1) for i in range(400)]
    rows += [rows[8], rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    queued = mixing.queue(docs).cache()
    out = mixing.taken(queued).collect()
    assert len(out) == len(rows) and sorted(tuple(r) for r in out) == sorted(tuple(r) for r in mixing.taken(mixing.queue(docs.repartition(7))).collect())
    plan = [tuple(r) for r in queued.where("size > 0").select("row", "source_key", "size", "end", "source_size", "target").distinct().collect()]
    ends = {}
    for _, source, size, end, source_size, _ in plan:
        ends.setdefault(source, []).append((end, size, source_size))
    for x in ends.values():  # the rows of a source follow each other without a gap
        x.sort()
        assert [e for e, *_ in x] == [sum(s for _, s, _ in x[: i + 1]) for i in range(len(x))] and x[-1][0] == x[-1][2]
    want = brute_queue(plan, 2, 1.5)
    assert {r.row: r.n for r in queued.where("size > 0").groupBy("row").agg(F.sum("served").alias("n")).collect()} == want
    source, by = {r[0]: r[3] for r in rows}, {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        got = by.setdefault(source[r.doc_id], [0, r.target])
        got[0] += r.taken
    assert all(abs(t - k) <= packet for k, t in by.values())
    assert abs(sum(k for k, _ in by.values()) - sum(t for _, t in by.values())) <= 1
    stream = mixing.mix(queued).collect()
    assert [r.finish for r in stream] == sorted(r.finish for r in stream)
    assert sum(r.served for r in stream) == sum(r.taken for r in out)


def test_mix_edges(spark):
    out = mixing.taken(mixing.queue(edge(spark))).collect()
    assert len(out) == len(EDGE)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in out) == sorted(size(r[1]) for r in EDGE)
    assert mixing.taken(mixing.queue(empty(spark))).count() == 0
    kept = mixing.keep_mixed(edge(spark))
    assert kept.columns == edge(spark).columns and kept.count() <= len(EDGE)
    assert mixing.keep_mixed(empty(spark)).count() == 0


def test_lpt():
    items = [(i, s) for i, s in enumerate([7, 7, 6, 5, 5, 4, 4, 3])]
    placed = sharding.lpt(items, 3)
    loads = [sum(s for i, s in items if placed[i] == k) for k in range(3)]
    assert max(loads) - min(loads) <= 4 and sharding.lpt(items, 3) == placed


def brute_shards(spark, texts, n_shards):
    """doc_id -> (size, crc32, shard, slot) by a plain loop; texts by distinct doc_id. The engine's hashes are taken as given."""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("g", F.coalesce(F.xxhash64("text"), F.lit(0)))
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.select("doc_id", "g", F.pmod(F.xxhash64("g", F.lit(7)), F.lit(256 * n_shards)).alias("bundle"), F.pmod(F.xxhash64("doc_id", "g", F.lit(11)), F.lit(cells)).alias("cell"))
    rows = {r.doc_id: r for r in df.collect()}
    size = {d: len((t or "").encode()) + 16 for d, t in texts.items()}
    group, load = {}, {}
    for d, r in rows.items():
        group[r.g] = group.get(r.g, 0) + size[d]
    item_of = {d: (True, r.g) if group[r.g] * 256 * n_shards > sum(size.values()) else (False, r.bundle) for d, r in rows.items()}
    for d, item in item_of.items():
        load[item] = load.get(item, 0) + size[d]
    shard, loads = {}, [0] * n_shards
    for item in sorted(load, key=lambda x: (-load[x], x)):
        shard[item] = loads.index(min(loads))
        loads[shard[item]] += load[item]
    out, filled = {}, {}
    for d in sorted(rows, key=lambda d: (rows[d].cell, d)):
        k = shard[item_of[d]]
        out[d] = (size[d], zlib.crc32((texts[d] or "").encode()), k, filled.get(k, 0))
        filled[k] = filled.get(k, 0) + 1
    assert len({item[0] for item in item_of.values()}) == 2 or n_shards > 5
    return out


def test_sharding_is_brute_force(spark):
    texts = {i: None if i % 50 == 7 else "same text" if i % 3 == 0 else f"text {i} " * (400 if i % 97 == 1 else i % 40) for i in range(3000)}
    out = sharding.shard_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in out} == brute_shards(spark, texts, 5) and len(out) == 3000


def test_sharding(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (i % 40), "en", "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sharding.shard_documents(docs, 5).collect()
    texts = {i: t for i, t, *_ in rows}
    shards, of = {}, {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
        assert of.setdefault(texts[r.doc_id], r.shard) == r.shard
        assert r.size == len(texts[r.doc_id].encode()) + 16
    loads = [sum(r.size for r in s) for s in shards.values()]
    assert len(loads) == 5 and max(loads) < 1.02 * min(loads)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert sharding.shard_documents(empty(spark)).count() == 0
    rows = sharding.shard_documents(edge(spark), 3).collect()
    assert len(rows) == len(EDGE) and len({r.shard for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(r.text_crc32 == 0 and r.size == 16 for r in rows if r.doc_id in (3, 4))

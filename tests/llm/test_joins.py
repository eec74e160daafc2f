import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import decontamination, jaccard_join, spotsigs
from loomline.llm.components import components
from loomline.llm.shingles import set_keys, shingle_sets
from tests.llm.helpers import DOCUMENT, EDGE, edge, empty


def sets_of(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute_components(ids, texts, k, num, den):
    s = sets_of(texts, k)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(s[i]), least[find(i)]) for i, d in enumerate(ids)}


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[f"z{rng.randrange(99)}"], [], [w[i], f"q{rng.randrange(99)}"]])
            w = w or ["w"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
@pytest.mark.parametrize("block", [256, 8])
def test_components_are_brute_force(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEADERS", 2)
    rng = random.Random(block + k)
    texts = [t for size in (1, 2, 3, 4, 9, 11, 25, 60, 150, 400) for t in family(rng, 14, size, 4)]
    shared = " ".join(f"common{i}" for i in range(60))
    texts += [f"{shared} {t}" for t in family(rng, 10, 80, 40)] + ["", "  ", texts[0].upper()]
    order = list(range(len(texts)))
    rng.shuffle(order)
    df = spark.createDataFrame([(i, texts[j]) for i, j in enumerate(order)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, num, den).collect()}
    assert got == brute_components(range(len(texts)), [texts[j] for j in order], k, num, den)


def test_every_link_is_routed():
    rng = random.Random(3)
    texts = [t for size in (3, 7, 12, 30, 90) for t in family(rng, 30, size, 3)]
    for k, num, den in ((3, 9, 10), (5, 4, 5)):
        h, e = shingle_sets(texts, k)
        s = sets_of(texts, k)
        u, c = np.unique(h, return_counts=True)
        for common in (np.empty(0, np.uint64), u[c > 3], u):
            d, of = jaccard_join.digests(h, e, num, den, common)
            mine = [set() for _ in texts]
            for x, o in zip(d.tolist(), of.tolist(), strict=True):
                mine[o].add(x)
            assert all(mine[i] & mine[j] for i in range(len(s)) for j in range(i) if s[i] != s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]))


def test_merge_skip():
    rng = random.Random(4)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(40), rng.randint(1, 20)))) for _ in range(rng.randint(1, 8))]
        need = rng.randint(1, len(lists))
        counts = {i: sum(i in x for x in lists) for i in range(40)}
        assert dict(jaccard_join._merge_skip(lists, need)) == {i: c for i, c in counts.items() if c >= need}


def test_set_keys():
    h, e = shingle_sets(["a b c", "a  b\tc", "A B C", "c b a", "", None], 3)
    k = set_keys(h, e)
    assert k[0] == k[1] == k[2] != k[3] and k[4] == k[5] == 0


def test_join_edges(spark):
    out = jaccard_join.jaccard_components(edge(spark), 3, 9, 10)
    rows = out.collect()
    assert len(rows) == len(EDGE)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (3, 4, 5))
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    kept = jaccard_join.one_of_each(edge(spark), 3, 9, 10)
    assert kept.columns == edge(spark).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8, 9]
    twice = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1)] * 3 + [(1, "other words of this one here", "en", "s", 1)], DOCUMENT)
    assert jaccard_join.one_of_each(twice).count() == 1


def test_one_row_of_each_component(spark):
    import corpus_pipeline

    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, text("b") + " more"), (None, text("c") + " more"), (3, text("c")), (4, text("d")), (4, text("e")), (4, text("e"))]
    rows += [(5, text("e") + " more"), (6, text("f")), (None, text("g")), (None, ""), (None, ""), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_components(df, 5, 4, 5).collect()
    assert len(found) == len(rows)
    named = {}
    for r in found:
        if r.n_shingles:
            named.setdefault(r.component, set()).add(r.component_id)
    assert sorted((min(x, key=str) or 0) for x in named.values()) == [0, 0, 0, 3, 4, 4, 6] and all(len(x) == 1 for x in named.values())
    kept = [(r.doc_id, (r.text or "").split(" ")[0]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, "a0"), (None, "b0"), (3, "c0"), (4, "d0"), (4, "e0"), (6, "f0"), (None, "g0"), (None, ""), (None, ""), (None, ""), (7, "")], key=str)


def classes(found):
    out = {}
    for node, name in found:
        out.setdefault(name, set()).add(node)
    assert all(name in nodes for name, nodes in out.items())
    return sorted(out.values(), key=min)


def test_components(spark):
    rng = random.Random(12)
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)] + [(500, 501 + i) for i in range(40)] + [(900 + i, 999) for i in range(40)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    df = spark.createDataFrame(edges, "a long, b long")
    here = classes([(r.node, r.component) for r in components(df).collect()])
    assert here == classes([(r.node, r.component) for r in components(df, local_edges=0).collect()])
    assert here[0] == set(range(61)) and {100, 101} in here and {500 + i for i in range(41)} in here and {*range(900, 940), 999} in here
    assert components(df.limit(0)).count() == 0 and components(df.limit(0), 0).count() == 0


@pytest.mark.parametrize("n", [160, 10_000])
def test_shuffled_chains(spark, monkeypatch, n):
    from loomline.llm import components as module

    ids = random.Random(n).sample(range(10**9), n)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    rounds = []
    contract = module._contract
    monkeypatch.setattr(module, "_contract", lambda e: rounds.append(1) or contract(e))
    assert {len(c) for c in classes([(r.node, r.component) for r in module.components(df, local_edges=n // 20).collect()])} == {n}
    assert 0 < len(rounds) <= 2 * np.log2(n)
    node, root = module.local_components(np.array(ids[:-1]), np.array(ids[1:]))
    assert len(node) == n and set(root) == {min(ids)}


def test_merged_digests_are_the_same_in_any_order():
    rng = np.random.default_rng(3)
    d, node = rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 90, 400)
    keys, least, (a, b, n) = jaccard_join._merge(d, node)
    assert keys.tolist() == sorted(set(d.tolist())) and all(least[i] == node[d == k].min() for i, k in enumerate(keys))
    assert {(x, y) for x, y in zip(a, b)} == {(x, node[d == k].min()) for k, x in zip(d, node) if x != node[d == k].min()}


def test_word_hashes():
    from loomline.llm import shingles

    rng = random.Random(9)
    texts = ["".join(rng.choice("aAbB \n\t\x0b\u00a0é") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "x" * 5000, "ab " * 4000]
    named = {}
    for piece in (1 << 19, 64):
        shingles._PIECE = piece
        h, n = shingles.word_hashes(texts)
        words = [w for t in texts for w in (t or "").encode().lower().split()]
        assert n.tolist() == [len((t or "").encode().split()) for t in texts] and len(h) == len(words)
        for w, x in zip(words, h.tolist()):
            assert named.setdefault(w, x) == x
    assert len(set(named.values())) == len(named)
    shingles._PIECE = 1 << 19


def test_wand_is_exhaustive():
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 20)))) for i in range(90)]
    index = decontamination.BlockMaxIndex(items)
    for _ in range(60):
        q = sorted({index.ids[w] for w in rng.sample(vocabulary, 30) if w in index.ids})
        scores = {}
        for t in q:
            for i, s in zip(index.docs[t], index.impacts[t], strict=True):
                scores[i] = scores.get(i, 0) + s
        for threshold in (0.1, 0.3, 0.6):
            assert {i for i, _ in index.wand(q, threshold)} == {i for i, s in scores.items() if s >= threshold}


def test_leaks(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(12)) + "? " + " ".join(word() for _ in range(10))) for i in range(50)] + [(50, None), (51, "")]
    docs, planted = [], {}
    for d in range(120):
        w = [word() for _ in range(rng.choice([5, 40, 400]))]
        if d % 3 == 0:
            item = rng.randrange(50)
            at = rng.randrange(len(w))
            w[at:at] = items[item][1].split()
            planted[d] = item
        elif d % 3 == 1:
            w[0:0] = items[rng.randrange(50)][1].split("?")[0].split()  # the question alone
        docs.append((d, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == set(planted.items())
    clean = decontamination.clean(edge(spark), bench)
    assert clean.columns == edge(spark).columns and clean.count() == len(EDGE)
    assert decontamination.leaks(empty(spark), bench).count() == 0 and decontamination.leaks(edge(spark), bench.limit(0)).count() == 0


def test_large_benchmarks_go_in_parts(spark, monkeypatch):
    rng = random.Random(17)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(i, f"{say(12)}? {say(8)}") for i in range(60)] + [(3, None)]
    docs = [(d, f"{say(30)} {items[d][1]} {say(30)}" if d < 40 else say(60)) for d in range(80)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = {(d, d) for d in range(40)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == want
    monkeypatch.setattr(decontamination, "MAX_ITEMS", 25)
    assert len(list(decontamination._parts(bench))) == 3 and sum(map(len, decontamination._parts(bench))) == 61
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()} == want
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == list(range(40, 80))


def test_symbols_take_no_place_in_a_window():
    question, answer = [f"q{i}" for i in range(30)], [f"a{i}" for i in range(30)]
    spaced = " = ".join(question) + " ? " + " | ".join(answer)
    plain = " ".join(question) + "? " + " ".join(answer)
    before = [f"w{i}" for i in range(130)]
    for item, copy in ((spaced, spaced), (plain, spaced), (spaced, plain)):
        index = decontamination.BlockMaxIndex([(7, item), (8, "other words. Of what? Of this")])
        texts = [" ".join([*before[:n], copy, *before]) for n in range(130)]
        assert [x[0] for x in index.search(texts, 0.6, 0.8)] == list(range(130))
    assert index.search(["= | -", None, "", "- w1 ="], 0.6, 0.8) == []


def brute_signatures(text):
    import re

    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    groups, anchors = [], ["^"]
    for w in words:
        if w in spotsigs.COMMON_WORDS:
            anchors.append(w)
        else:
            groups.append((anchors[-1] if anchors else None, w))
            anchors = []
    if anchors and words:
        groups.append((anchors[-1], ""))
    return {(a, w, groups[i + 1][1] if i + 1 < len(groups) else None) for i, (a, w) in enumerate(groups) if a is not None}


def brute_sets(spark, texts):
    """brute_signatures as the hashes that the engine gives each signature, so that sets can be compared by identity."""
    found = [brute_signatures(t) for t in texts]
    chains = [(i, f"{a}~{w}", nxt) for i, s in enumerate(found) for a, w, nxt in s]
    schema = "i int, first string, second string"
    chain = F.when(F.col("second").isNull(), F.xxhash64("first", F.lit(None).cast("string"))).otherwise(F.xxhash64("first", "second"))
    out = [set() for _ in texts]
    for r in spark.createDataFrame(chains, schema).select("i", F.shiftrightunsigned(chain, 16).alias("h")).collect():
        out[r.i].add(r.h)
    return out


def as_hex(s):
    return "".join(f"{h:012x}" for h in sorted(s))


def test_signatures_and_next(spark):
    docs = edge(spark).where("doc_id is not null and instr(coalesce(text, ''), '~') = 0")
    rows = [(r.doc_id, r.text, r.s) for r in docs.select("doc_id", "text", spotsigs.signatures(F.col("text")).alias("s")).collect()]
    for (_, _, got), want in zip(rows, brute_sets(spark, [t for _, t, _ in rows])):
        assert got == sorted(want)
    out = spotsigs.fingerprints_and_edits(edge(spark)).collect()
    assert len(out) == len(EDGE)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0 and by[1].same_next
    assert by[3].fingerprint == "" and by[3].n_chars == 0
    assert spotsigs.fingerprints_and_edits(empty(spark)).count() == 0
    one = spotsigs.fingerprints_and_edits(spark.createDataFrame([(5, "ab of cd", "en", "s", 8)], DOCUMENT)).first()
    assert one.near_next == 1.0 and one.n_chars == 8


def test_fingerprints_and_likeness_are_brute_force(spark):
    rng = random.Random(21)
    words = [*spotsigs.COMMON_WORDS[:12], *(f"word{i}" for i in range(40))]
    texts = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 200]))]
        texts.append(texts[-1] + " more" if i % 5 == 4 else texts[-1] if i % 5 == 3 else rng.choice([" ", ", ", "\n"]).join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    own, changed = brute_sets(spark, texts), brute_sets(spark, edited)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = {r.doc_id: r for r in spotsigs.fingerprints_and_edits(df).collect()}
    for i in range(len(texts)):
        r, nxt = out[i], own[(i + 1) % len(texts)]
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(own[i]), as_hex(changed[i]))
        assert r.near_edited == pytest.approx(alike(own[i], changed[i])) and r.near_next == pytest.approx(alike(own[i], nxt))
        assert r.same_edited == (alike(own[i], changed[i]) >= 0.8) and r.same_next == (alike(own[i], nxt) >= 0.8)
    pairs, members = spotsigs.near_pairs(df, 0.8)
    classes = {}
    for i, s in enumerate(own):
        if s:
            classes.setdefault(as_hex(s), i)
    reps = [(i, own[i]) for i in classes.values()]
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i, a in reps for j, b in reps if i < j and alike(a, b) >= 0.8}
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: classes.get(as_hex(s), i) for i, s in enumerate(own)}


def test_next_is_global(spark):
    import hashlib

    rng = random.Random(8)
    docs = [(i * 3 - 7, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints_and_edits(df).collect()}
    for i, (d, t) in enumerate(docs):
        nxt, half = docs[(i + 1) % len(docs)][1], len(t) // 2
        assert got[d] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()


@pytest.mark.parametrize("hot", [5, None])
def test_rows_of_one_id_are_dealt_to_many_ranges(spark, hot):
    import hashlib

    rng = random.Random(18)
    docs = [(hot, f"{i} " * rng.randint(0, 9)) for i in range(300)] + [(i, f"t{i}") for i in range(6, 300)] + [(hot, "same")] * 40 + [(None, "x"), (-4, "first")]
    df = spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string")
    placed = spotsigs.dealt(df, ["text"], 16).cache()
    sizes = {r.r: r.n for r in placed.where("not ghost").groupBy("r").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == len(docs) and len(sizes) >= 12 and max(sizes.values()) < 150
    rows = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.tie, r.text, r.doc_id) for r in placed.where("not ghost").collect()), key=lambda x: x[:3])
    want = []
    for i, (_, _, t, d) in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)][2], len(t) // 2
        want.append((str(d), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = [(str(r.doc_id), r.edited_sha256) for r in spotsigs.fingerprints_and_edits(df).collect()]
    assert sorted(got) == sorted(want)


def test_near_pairs(spark):
    base = " ".join(f"the word{i} of thing{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " and more"), (4, "the other text of things"), (5, "")], "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(docs, 0.8)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 3)]
    assert {r.doc_id: r.class_id for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}

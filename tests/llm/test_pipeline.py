import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from loomline.llm import catalog, language_id
from tests.compare import rows
from tests.conftest import DATA
from tests.llm.helpers import DOCUMENT, edge, empty
from tests.llm.test_joins import brute_components
from tests.llm.test_stores import brute_queue, brute_shards, brute_targets


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs_over_the_whole_table(spark, duck, name):
    n = catalog.QUERIES[name](spark, DATA).count()
    assert n == duck.execute("SELECT count(*) FROM documents").fetchone()[0] if name != "op1_decontamination" else n > 0


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = sorted(r.doc_id for r in docs.select("doc_id").collect())
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        after = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert set(after) <= set(before) and len(set(after)) == len(after)
        if name == "near_copies":
            want = brute_components(before, [text[i] for i in before], 5, 4, 5)
            assert after == [i for i in before if want[i][1] == i]
        if name == "decontamination":
            items = [r[0] for r in duck.execute("SELECT text FROM benchmark").fetchall()]
            assert not any(t in text[i] for i in after for t in items)
            assert {i for i in before if any(t in text[i] for t in items)} <= set(before) - set(after)
        if name == "mixing":
            assert 0.8 * sum(len(text[i].split()) for i in before) < sum(len(text[i].split()) for i in after) < 0.97 * sum(len(text[i].split()) for i in before)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count()


def test_stages_take_edges(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge(spark), DATA).count() >= 0
        assert stage(spark, empty(spark), DATA).count() == 0
        assert stage(spark, spark.createDataFrame([(1, "one small text of words", "en", "s", 1)], DOCUMENT), DATA).count() <= 1


def phrases(text, learned):
    """Greedy longest matches, each run of other than letters one symbol; a symbol that isn't learned is a phrase."""
    plain = lambda t: re.sub(r"[\W\d_]+", " ", t.lower())
    t, ref, i, n = plain(text), plain(learned), 0, 0
    while i < len(t):
        k = 1
        while i + k < len(t) and t[i : i + k + 1] in ref:
            k += 1
        i, n = i + k, n + 1
    return n


def brute_mix(spark, size, source, weights=(3.0, 1.0, 2.0), share=0.9):
    """The doc_ids of which a plain queue serves half or more."""
    cells = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = {r.doc_id: r.h for r in spark.createDataFrame([(d,) for d in size], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(20240)).alias("h")).collect()}
    key = {d: "1" if source[d] is None else f"0{source[d]}" for d in size}
    sizes = {k: sum(size[d] for d in size if key[d] == k) for k in sorted(set(key.values()))}
    target = brute_targets(sizes, [weights[i % 3] for i in range(len(sizes))], share, 1)
    plan, ends = [], {}
    for d in sorted(size, key=lambda d: (h[d] % cells, h[d], d)):
        ends[key[d]] = ends.get(key[d], 0) + size[d]
        plan.append((d, key[d], size[d], ends[key[d]], sizes[key[d]], target[key[d]]))
    served = brute_queue(plan, 1, share)
    return [d for d in size if 2 * served.get(d, 0) >= size[d]]


def test_the_pipeline_is_brute_force(spark, tmp_path):
    rng = random.Random(41)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(900)] for lang, letters in (("en", "abcdefghij"), ("de", "ghijklmnopqäü"))}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    items = [(i, f"{say('en', 14)}? {say('en', 12)}.") for i in range(8)]
    rows = []
    for d in rng.sample(range(5000), 260):
        kind, lang = d % 13, rng.choice(["en", "de"])
        text = say(lang, rng.choice([5, 30, 80, 600]))
        if kind == 0:  # a leak, and a question alone
            text = f"{text} {rng.choice(items)[1]} {say('en', 9)}" if d % 2 else f"{text} {items[0][1].split('?')[0]}"
        elif kind == 1 and rows:  # a near or an exact copy
            text = rng.choice(rows)[1] or text
            text += " zugabe" if d % 2 else ""
        elif kind == 2:  # no language that is learned
            text, lang = "".join(rng.choice("αβγδεζηθλμνξ ") for _ in range(200)), None
        elif kind == 3:
            text, lang = rng.choice([None, "", "123 !!! 7", "αβ γ"]), None
        rows.append((d, text, lang, rng.choice(["web", "web", "web", "books", None]), len(text or "")))
    docs = spark.createDataFrame(rows, DOCUMENT)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    learned = language_id.sample(docs.where(~language_id.held_out()))
    assert sorted(learned) == ["de", "en"]
    letters = {d: sum(c.isalpha() for c in t or "") for d, t in text.items()}
    left = [d for d in text if letters[d] and (letters[d] < 20 or min(phrases(text[d], x) for x in learned.values()) <= 0.9 * letters[d])]
    steps = [len(left)]
    component = brute_components(sorted(left), [text[d] for d in sorted(left)], 5, 4, 5)
    left = [d for d in left if component[d][1] == d]
    steps.append(len(left))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    parts = [[grams(x) for x in t.split("?")] for _, t in items]
    left = [d for d in left if not any(all(len(p & grams(text[d])) >= 0.8 * len(p) for p in item) for item in parts)]
    steps.append(len(left))
    left = brute_mix(spark, {d: len(text[d].split()) for d in left}, source)
    steps.append(len(left))
    assert len(rows) > steps[0] > steps[1] > steps[2] > steps[3] > 100  # each stage has work
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in out} == brute_shards(spark, {d: text[d] for d in left}, 40) and len(out) == len(left)

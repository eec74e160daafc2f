"""Literal cases, invariants and edge cases of the conversation operators."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import quality as Q
from loomline.functions import text as T
from loomline.functions import tokens as K
from loomline.operators import code as CODE
from loomline.operators import lines as L
from loomline.operators import summary as S
from loomline.operators import vectors as V
from loomline.operators import zones as Z
from loomline.plans.compaction import compact_conversations

MESSAGE = "conv_id long, turn long, role string, content string"


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_line_collapse(spark):
    assert one(spark, "a\n" + "b\n" * 100 + "c", L.collapsed_runs) == "a\nb\n... (repeated 100 times) ...\nc"
    assert one(spark, "a\na\n\n\n\nb", L.collapsed_runs) == "a\na\n\n\n\nb"
    assert one(spark, "", L.collapsed_runs) == ""
    assert one(spark, None, L.collapsed_runs) is None


def test_repeated_frames(spark):
    block = "\n".join(f'  File "a.py", line {i}, in f' for i in range(10))
    out = one(spark, f"{block}\nretry\n{block}", L.collapsed_frames)
    assert out == f"{block}\nretry\n... (stack frame block repeated; omitted 10 lines) ..."


def test_error_aware(spark):
    log = "$ pytest\n" + "\n".join(f"{chr(97 + i % 26)} PASSED" for i in range(40)) + "\nAssertionError: boom\nmore\n" + "\n".join(f"{chr(97 + i % 26)} passes" for i in range(40)) + "\n1 failed, 80 passed"
    out = one(spark, log, lambda t: L.compressed(t, 500))
    assert "AssertionError: boom\nmore" in out and "1 failed" in out and L.AWARE in out and len(out) < len(log)
    ok = "\n".join(f"{chr(97 + i % 26)} PASSED" for i in range(60)) + "\n60 passed in 1.23s"
    assert one(spark, ok, lambda t: L.compressed(t, 400)).startswith("60 passed in 1.23s\n" + L.AWARE)
    assert one(spark, "x" * 10000, lambda t: L.compressed(t, 4000)).count("x") == 4000


def test_compression_is_idempotent_and_leaves_small_texts(spark):
    for text in ("x" * 9000, "\n".join(["same"] * 3000), "short"):
        once = one(spark, text, lambda t: L.compressed(t, 4000))
        assert one(spark, once, lambda t: L.compressed(t, 4000)) == once
        assert len(once) <= max(len(text), 4100)


def test_filter_keeps_failures(spark):
    assert one(spark, "Build succeeded\n" + "x\n" * 200, L.filtered) == "[build success]"
    bad = "Build succeeded\nerror: no\n" + "x\n" * 200
    assert one(spark, bad, L.filtered) == bad
    assert one(spark, "Build succeeded", L.filtered) == "Build succeeded"


def test_failing_go_test_keeps_its_log(spark):
    log = "=== RUN   TestA\n--- FAIL: TestA (0.00s)\n    a_test.go: want 1\nFAIL\tgithub.com/x/y\t0.012s\nok  \tgithub.com/x/z\t0.010s\n" + "verbose line\n" * 20
    assert one(spark, log, L.filtered) == log and one(spark, log, L.failure_signal)
    passing = "ok  \tgithub.com/x/z\t0.010s\n" + "verbose line\n" * 20
    assert one(spark, passing, L.filtered) == "[go test result]" and not one(spark, passing, L.failure_signal)
    out = one(spark, "1 passed\n" + log, lambda t: L.compressed(t, 150))
    assert "FAIL\tgithub.com/x/y" in out and "success collapsed" not in out
    for line, signal in (("FAIL x", True), ("a FAIL x", False), ("FAILING", False), ("✗ case", True), ("PANIC: x", True), ("fatal", True), ("nothing", False)):
        assert one(spark, f"start\n{line}\nend", L.failure_signal) is signal


def test_rules(spark):
    pad = "plain\n" * 60
    cases = {
        "tests 50% [100%] more": None, "tests .... [100%]": "[pytest result]", "test result: ok. 3 passed; 0 failed; 0 ignored; 0 measured; 0 filtered out": None, "abcdef1 fix it": "[git log]", " a.py | 3 ++\n1 file changed, 3 insertions": "[git diff stat]",
        "On branch main\nnothing to commit": "[git status]", "Done in 1.2s": "[shell ok]", "Found 3 warnings here": "[lint summary]", "Finished dev [opt] in 0.05s": "[build success]", "Something else": None,
    }
    for text, marker in cases.items():
        whole = f"{text}\n{pad}"
        assert one(spark, whole, L.filtered) == (marker or whole), text


def test_code_likeness(spark):
    assert one(spark, "a\n```\nx\ny\n```\nplain words\nvalue = some + 1", Q.code_likeness) == round(5 / 7, 4)
    assert one(spark, "```\nx", Q.code_likeness) == 1.0 and one(spark, "a", Q.code_likeness) == 0.0
    assert one(spark, "if x = 1\n" * 20_000, Q.code_likeness) > 0 - 1


def test_query_blocks_find_the_same(spark, monkeypatch):
    from tests.conftest import DATA

    from loomline.plans import sequence_plans as P
    from loomline.plans.catalog import QUERIES

    whole = {n: sorted(map(tuple, QUERIES[n](spark, DATA).collect())) for n in ("vector_search", "rank_with_fallback")}
    monkeypatch.setattr(P, "QUERY_BLOCK", 1)
    assert whole == {n: sorted(map(tuple, QUERIES[n](spark, DATA).collect())) for n in whole}


def odd_vectors():
    """Copies, near copies, ties of rounding, repeated ids, zero, null, NaN, infinite and shorter vectors."""
    rnd = random.Random(5)
    one_of = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, [x + rnd.choice([0, 0, 1e-6, 0.3]) * rnd.gauss(0, 1) for x in rnd.choice(one_of)]) for i in range(-200, 900)]
    rows += [(i, [1.0] + [0.0] * 5) for i in range(900, 1100)] + [(i, [float(rnd.randint(-2, 2)) for _ in range(6)]) for i in range(1100, 1500)]
    rows += [(i, [1 / 64, (1 - 1 / 4096) ** 0.5] if i % 2 else [1.0, 0.0]) for i in range(1500, 1520)] + [(50, one_of[0])] * 9 + [(51, one_of[0]), (None, one_of[0])]
    return rows + [(1550, [0.0] * 6), (1551, None), (1600, None), (1601, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1602, [1.0]), (1650, [2.0, 1.0, 0.0]), (1651, [1.0, 2.0, 0.0]), (1700, []), (1701, []), (1750, [None] * 6)]


@pytest.mark.parametrize("tasks", [3, 40])
@pytest.mark.parametrize("more", [[], [(1800, [float("nan")] * 6), (1801, [float("inf")] + [1.0] * 5)]])
def test_nearest_as_pair_by_pair(spark, more, tasks):
    from loomline.plans import sequence_plans as P

    v = spark.createDataFrame(odd_vectors() + more, "vec_id long, embedding array<float>").repartition(tasks)
    q = P.query_vectors(v).withColumnsRenamed({"vec_id": "query_id", "embedding": "query"})
    scored = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", P.cosine(F.col("query"), F.col("embedding"), 5).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    want = scored.withColumn("place", F.row_number().over(w)).where("place <= 5")
    got = P.nearest(v, 5)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_best_rows_by_tile():
    rnd = np.random.default_rng(1)
    angle = rnd.uniform(-0.02, 0.02, 4000)  # hundreds of rows share each rounded similarity
    x, ids = np.c_[np.cos(angle), np.sin(angle)].astype(np.float32).astype(np.float64), rnd.permutation(4000)
    q = ids % 50 == 0
    best = V.Best(ids[q], x[q], 5, 5)
    for part in np.array_split(np.arange(4000), 3):
        best.add(ids[part], x[part])
    for own, vector, norm, found, far in zip(best.ids, best.x, best.norm, best.found, best.far, strict=True):
        s = V.half_up(V.running_sum(x * vector) / (V.norms(x) * norm), 5)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:5]
        assert ids[order].tolist() == found.tolist() and s[order].tolist() == (-far).tolist()


def test_bounds_of_earlier_tasks_drop_none_of_the_best():
    rnd = np.random.default_rng(2)
    x, ids = np.round(rnd.normal(size=(2000, 3)), 1), rnd.permutation(2000)
    q, rows = ids % 50 == 0, []
    whole = V.Best(ids[q], x[q], 5, 5)
    whole.add(ids, x)
    for part in np.array_split(np.arange(2000), 20):
        known = V.bounds("a search")
        task = V.Best(ids[q], x[q], 5, 5)
        task.bound = known.get(3, task.bound)
        task.add(ids[part], x[part])
        known[3] = np.minimum(task.bound, task.far[:, -1])
        rows.append((task.far, task.found))
    far, found = (np.hstack([r[i] for r in rows]) for i in (0, 1))
    order = np.lexsort((found, far))[:, :5]
    assert (np.take_along_axis(found, order, 1) == whole.found).all() and (np.take_along_axis(far, order, 1) == whole.far).all()
    assert np.isfinite(far).sum() < 0.7 * far.size and not V.bounds("another")


def test_best_rows_among_copies_and_at_turns_of_rounding():
    def best(rows, k, vector):
        b = V.Best(np.array([0]), np.array([vector]), k, 5)
        b.add(np.array([i for i, _ in rows]), np.array([x for _, x in rows]))
        return [(i, -s) for i, s in zip(b.found[0].tolist(), b.far[0].tolist(), strict=True)]

    near, far = [1.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0, 0.0]
    assert best([(i, near) for i in (3, 0, 2, 1)] + [(9, far)], 3, near) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    assert best([(7, near)] * 2 + [(8, far)], 2, near) == [(7, 1.0), (7, 1.0)]
    assert best([(0, near)] * 5 + [(8, near), (9, far)], 2, near) == [(8, 1.0), (9, 0.0)]
    turn = [1.0, 63.0, 11.0, 2.0, 1.0]  # of length 64, so 0.015625
    assert best([(1, turn), (2, [-1.0, *turn[1:]])], 2, near) == [(1, 0.01563), (2, -0.01563)]


def test_vector_search_makes_no_row_per_pair(spark):
    from tests.conftest import DATA

    from loomline.plans.catalog import QUERIES

    assert "Join" not in QUERIES["vector_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_session_cap_is_a_parameter(spark):
    from loomline.plans.state_plans import session_cap

    e = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00") for i in range(300)], "user_id long, ts string")
    assert [session_cap(e, n).count() for n in (7, 0)] == [7, 300] and session_cap(e).count() == 256


def test_hit_classifier_predicts_recorded_outcomes(spark):
    from tests.conftest import DATA

    from loomline.plans.catalog import QUERIES

    real = {(r.session_id, r.turn): r.label for r in QUERIES["record_outcome"](spark, DATA).collect()}
    out = QUERIES["hit_classifier"](spark, DATA).collect()
    assert out and all(real[r.session_id, r.turn] == r.label and r.prediction in (0.0, 1.0) for r in out)
    assert max(sum(1 for r in out if r.session_id == s) for s in {r.session_id for r in out}) <= 3


def test_packing(spark):
    assert one(spark, "aa\nbb\ncccccccc\nd", lambda t: L.packed(t, 4)) == ["aa\nbb", "cccccccc", "d"]
    assert one(spark, "", lambda t: L.packed(t, 4)) == [""]


def conversation(n, size=200, system=True):
    rows = [(1, 0, "system", "s" * 40)] if system else []
    for i in range(n):
        rows += [(1, len(rows), "user", f"u{i} " + "x" * (size // 2)), (1, len(rows) + 1, "assistant", f"a{i} " + "y" * (size // 2))]
    return rows


@pytest.mark.parametrize("budget,low", [(300, 1.0), (300, 0.5), (100, 0.8), (10_000, 0.8)])
def test_eviction_invariants(spark, budget, low):
    m = spark.createDataFrame(conversation(10), MESSAGE)
    k = Z.evicted(Z.zoned(m, keep=2), budget, low=low).orderBy("turn").collect()
    assert all(r.kept for r in k if r.zone != "body")
    body = [r for r in k if r.zone == "body"]
    flags = [r.kept for r in body]
    assert flags == sorted(flags)  # the oldest go first
    total, left = sum(r.tokens for r in body), sum(r.tokens for r in body if r.kept)
    assert left == total if total <= budget else left <= max(int(budget * low), 0)


@pytest.mark.parametrize("rows", [[], [(1, 0, "system", "only")], [(1, 0, "user", None)], [(1, 0, "assistant", "")], [(1, 0, "user", "é" * 9), (1, 1, "assistant", "ß"), (2, 0, "user", "é" * 9)]])
def test_edge_conversations(spark, rows):
    m = spark.createDataFrame(rows, MESSAGE)
    assert Z.evicted(Z.zoned(m), 5, reserve=True).count() == len(rows)
    assert Z.slid(m, 5).count() == len(rows)
    out = compact_conversations(m, 5).collect()
    assert not any(c.startswith("_") for c in compact_conversations(m, 5).columns)
    assert len(out) <= len(rows) + 2


def test_pipeline_keeps_anchor_tail_and_order(spark):
    rows = conversation(12, 400)
    out = compact_conversations(spark.createDataFrame(rows, MESSAGE), 500).orderBy("place").collect()
    texts = [r.content for r in out if not r.synthetic]
    assert texts[0] == rows[0][3] and texts[1] == rows[1][3] and texts[-1] == rows[-1][3]
    assert [r.place for r in out] == list(range(len(out)))
    assert sum(len(r.content) for r in out) <= sum(len(r[3]) for r in rows)


def test_ledger_of_evicted_code(spark):
    rows = conversation(1) + [(1, 3, "user", "please"), (1, 4, "assistant", "```python\ndef compute_hash(x):\n    return x\nclass Parser:\n    pass\n```")]
    for i in range(4):
        rows += [(1, 5 + 2 * i, "user", "q" * 300), (1, 6 + 2 * i, "assistant", "r" * 300)]
    out = compact_conversations(spark.createDataFrame(rows, MESSAGE), 420).where("synthetic = 'ledger'").first()
    assert out.content == "[Evicted-turn code index]\nclass Parser\ndef compute_hash(x)" or out.content == "[Evicted-turn code index]\ndef compute_hash(x)\nclass Parser"


def test_pipeline_folds_dedups_and_warns(spark):
    output = "line of a tool's output\n" * 20
    rows = [(1, 0, "system", "s" * 40), (1, 1, "user", "Please build the parser and keep the tests green"), (1, 2, "assistant", "I will read src/app/main.py first")]
    for i in range(3):
        rows.append((1, 3 + i, "tool", output))
    rows += [(1, 6, "assistant", "the error in main was found: failed to parse the header")]
    for i in range(8):
        rows += [(1, 7 + 2 * i, "user", f"step {i} " + "q" * 300), (1, 8 + 2 * i, "assistant", "r" * 300)]
    frame = spark.createDataFrame(rows, MESSAGE)
    whole = compact_conversations(frame, 100_000).orderBy("place").collect()
    assert [r.content for r in whole].count(output) == 1 and sum("duplicate output]" in r.content for r in whole) == 2
    out = compact_conversations(frame, 300).orderBy("place").collect()
    kinds = [r.synthetic for r in out]
    assert "summary" in kinds and "anchor" in kinds
    summary = next(r for r in out if r.synthetic == "summary")
    assert summary.content.startswith(S.MARKER) and "build the parser" in summary.content and "src/app/main.py" in summary.content and "failed to parse" in summary.content
    assert out[kinds.index("summary") - 1].role == "user" and "came again 2 times" in out[-1].content
    assert sum(len(r.content) for r in out) <= sum(len(r[3]) for r in rows)
    tiny = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 50), (1, 2, "user", "more"), (1, 3, "assistant", "b")], MESSAGE)
    assert sum(len(r.content) for r in compact_conversations(tiny, 1).collect()) <= 57


def test_text_forms(spark):
    assert one(spark, "a \r\nb\t\n\n\n\nc", T.canonical) == "a\nb\n\nc"
    assert one(spark, "x ```\ny", T.balanced_fences) == "x ```\ny"
    assert one(spark, "```\ny", T.balanced_fences) == "```\ny\n```"
    assert len(one(spark, "abc", T.padded)) == 128 and one(spark, "a" * 128, T.padded) == "a" * 128
    assert one(spark, "at 2026-07-31T12:34:56Z 1234567", T.masked) == "at [TIMESTAMP] [SHA]"
    assert one(spark, "address the issue", T.task_class) == "feature"
    assert one(spark, "nothing here", T.task_class) == "default"


def test_tokens(spark):
    assert [one(spark, t, K.estimate) for t in (None, "", "  \n", "a", "a" * 35)] == [0, 0, 0, 1, 10]
    assert K.Budget().static() == 12_000


def test_code(spark):
    src = "import os\n\ndef a():\n    return b()\n\ndef b():\n    return 1\n\ndef c():\n    return os.name * 20\n"
    cut = CODE.slice_to_query(src, "please change a")
    assert "def a" in cut and "def b" in cut and "def c" not in cut and len(cut) <= len(src)
    assert CODE.slice_to_query("def (", "a") == "def ("
    assert CODE.changed_lines("a\nb", "a\nc") == "-b\n+c"
    assert CODE.ast_skeleton("def f(x):\n    y = 1\n    return y") == "def f(x):\n    ..."
    assert one(spark, "x ```\na\n``` y ```\na\n``` z", CODE.without_repeated_blocks) == "x ```\na\n``` y  z"


def test_quality(spark):
    assert Q._lcs("a b c d".split(), "a c d e".split()) == 3 and Q._lcs([], ["a"]) == 0
    assert one(spark, "codename ATLAS on Python 3.11", lambda t: Q.fact_recall(t, [["ATLAS"], ["Python", "3.11"], ["Postgres"]])) == pytest.approx(0.6667)
    assert one(spark, "", Q.trigrams) == [] and one(spark, "[ARCHIVED 1] x", Q.leaked) == ["[ARCHIVED"]


def test_rolling_fold_is_append_only(spark):
    turns = spark.createDataFrame([(1, i, 700) for i in range(30)], "conv_id long, turn_id long, tokens long")
    out = S.rolling_fold(turns, S.Fold(target=3000, growth=2000)).orderBy("turn_id").collect()
    folded = [r.folded for r in out]
    assert folded == sorted(folded) and folded[-1] > 0
    assert all(r.turn_id + 1 - r.folded >= 3 for r in out if r.turn_id >= 3)


def test_sessions_of_stream_match_batch(spark):
    from tests.conftest import DATA

    from loomline.streaming import traces

    path = f"{DATA}/events.parquet"
    batch = spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    out = traces.expired_sessions(spark, path)
    ended = out.where("ended").groupBy("user_id").agg(F.sum("events").alias("n"))
    total = batch.groupBy("user_id").agg(F.sum("n").alias("n"))
    late = ended.join(total.withColumnRenamed("n", "all"), "user_id").where("n > all").count()
    assert late == 0 and ended.count() > 0
    counted = out.groupBy("user_id").agg(F.sum("events").alias("n"), F.count_if(~F.col("ended")).alias("open")).collect()
    assert {r.user_id: r.n for r in counted} == {r.user_id: r.n for r in total.collect()} and all(r.open <= 1 for r in counted)


def test_streams_read_no_sibling_file(spark, tmp_path):
    from tests.conftest import DATA

    from loomline.streaming import traces

    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.limit(50).write.parquet(str(tmp_path / "events.parquet"))
    e.write.parquet(str(tmp_path / "events.parquet.bak"))
    assert traces.window_counts(spark, str(tmp_path / "events.parquet")).agg(F.sum("n")).first()[0] == 50


def test_queries_read_whole_texts(spark, tmp_path):
    from loomline.plans.catalog import QUERIES

    far = "plain words " * 200
    texts = {1: far + "[REASONING", 2: far + "\n> quoted\n```\ncode", 3: far + "漢 … “end”", 205: far}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"item{i} words") for i in range(200)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", far + "end")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = lambda name: {r[0]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("foreign_markers")[1].leaked == "[REASONING"
    like = rows("markdown_structure")
    assert like[2].likeness == round(3 / 5, 6) and like[1].likeness == round(1 / 3, 6)
    assert rows("header_safe")[3].folded == f"\"{far} ... \"end\"\" - ... 'x' - "
    assert rows("rolling_block_text")[1].block.endswith("hello\n" + far + "end")
    assert {k: r.item_id for k, r in rows("source_recall").items()} == {1: 1, 2: 2, 3: 3, 205: 5}


def test_common_prefix_and_rouge_are_brute_force(spark):
    import random

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    pairs = [(None, "a"), ("", ""), ("a", None), ("ab", "abc"), ("x" * 5000 + "y", "x" * 5000 + "z")]
    for _ in range(40):
        head = text(rng.randrange(12))
        pairs.append((head + text(rng.randrange(12)), head + text(rng.randrange(12))))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string")
    out = rows.select("a", "b", Q.common_prefix(F.col("a"), F.col("b")).alias("n"), Q.rouge_l(F.col("a"), F.col("b")).alias("r")).collect()
    for r in out:
        a, b = r.a or "", r.b or ""
        assert r.n == max(k for k in range(min(len(a), len(b)) + 1) if a[:k] == b[:k])
        x, y = a.lower().split(), b.lower().split()
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, w in enumerate(x):
            for j, v in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if w == v else max(table[i][j + 1], table[i + 1][j])
        n = table[-1][-1]
        assert (r.r.precision, r.r.recall) == (round(n / len(x), 6) if x else 0.0, round(n / len(y), 6) if y else 0.0)
        assert r.r.edit == (round(n / max(len(x), len(y)), 6) if x and y else float(not x and not y))


def test_code_validity(spark):
    cases = {None: 1.0, "no code": 1.0, "```python\nx = 1\n```": 1.0, "```py\nx = (\n```": 0.0, "```python\nx = 1\n``` and ```py\ndef f(:\n```": 0.5, "```js\nx = (\n```": 1.0}
    for text, share in cases.items():
        assert one(spark, text, Q.python_validity) == share


def test_state_of_messages(spark):
    rows = [
        (1, 0, "user", "Please mend the parser in src/app/parse.py today. See /etc/app.conf, `main.py` and https://example.org/a.html"),
        (1, 1, "assistant", "Here it is:\n```python\nx = 1\n```"),
        (1, 2, "tool", "ValueError: bad input in line 3\nall is well here\n404 not found: page"),
        (2, 0, "user", None),
        (3, 0, "user", "x" * 1_000_000 + " a/b.py"),
    ]
    out = {r.conv_id: r.state for r in S.state_of(spark.createDataFrame(rows, MESSAGE)).collect()}
    state = out[1].split("\n")
    assert state[0] == "Files touched: src/app/parse.py, /etc/app.conf, main.py, example.org/a.html"
    assert "Code:\n```python\nx = 1\n```" in out[1]
    assert "Last errors: ValueError: bad input in line 3 | 404 not found: page" in state
    assert state[-1] == "Topic: Please mend the parser in src/app/parse"
    assert not out.get(2) and out[3].startswith("Files touched: a/b.py")


def test_bootstrap_interval_holds_the_mean(spark):
    from tests.conftest import DATA

    from loomline.plans.catalog import QUERIES
    from loomline.plans.registry import TRACES, fixture

    means = {r.stage: r.m for r in fixture(spark, DATA, TRACES).groupBy("stage").agg(F.avg("latency_ms").alias("m")).collect()}
    out = QUERIES["bootstrap_ci"](spark, DATA).collect()
    assert {r.stage for r in out} == set(means) and all(r.low < means[r.stage] < r.high for r in out)
    assert sorted(out) == sorted(QUERIES["bootstrap_ci"](spark, DATA).collect())


def test_deltas_are_diffs_of_versions(spark):
    from tests.conftest import DATA

    from loomline.plans.catalog import QUERIES
    from loomline.plans.code_plans import VERSIONS
    from loomline.plans.registry import fixture

    before, full = {}, {}
    for r in sorted(fixture(spark, DATA, VERSIONS).collect(), key=lambda r: r.version):
        old = before.get(r.path)
        full[r.id] = (r.path, CODE.changed_lines(old or "", r.content) if old is not None else None, r.content)
        before[r.path] = r.content
    found = QUERIES["delta_prev"](spark, DATA).collect()
    assert len(found) == len(full)
    assert all(r.delta == full[r.id][1] for r in found if full[r.id][1] is not None)
    stats = {r.path: (r.full_chars, r.snapshots) for r in QUERIES["snapshot_stats"](spark, DATA).collect()}
    for path in before:
        mine = [c for p, _, c in full.values() if p == path][-100:]
        assert stats[path] == (sum(map(len, mine)), len(mine))


def test_trigrams(spark):
    import random

    rng = random.Random(5)
    for t in ["", "ab", "abc", "aaaa", None, "x\ny\nz", "a\U0001f600b\U0001f600漢\U0001f600b", *("".join(rng.choice("ab\n\U0001f600é") for _ in range(n)) for n in (9, 40, 300))]:
        assert sorted(one(spark, t, Q.trigrams)) == sorted({(t or "")[i : i + 3] for i in range(len(t or "") - 2)})


@pytest.mark.parametrize("paired", [64, 5, 2])
def test_contradictions_are_brute_force(spark, monkeypatch, paired):
    import random
    import re

    from loomline.plans import quality_plans

    monkeypatch.setattr(quality_plans, "PAIRED", paired)
    rng = random.Random(paired)
    words = "port host cache token index queue shard block".split()
    claim = lambda: f"The {' '.join(rng.sample(words, rng.randint(1, 7)))} service {rng.choice(['is', 'is not', 'should never be'])} {rng.choice(['big', 'wide', 'open'])}."
    rows = [(c, t, " ".join(claim() for _ in range(rng.randint(0, 3)))) for c in range(8) for t in range(c * 2)]
    want = {}
    for c in range(8):
        claims = [(t, i, " not " in s or "never " in s, set(re.findall("[a-z]{4,}", s.lower()))) for d, t, text in rows if d == c for i, s in enumerate(re.findall(r"[^.]+\.", text))]
        n = sum(any(u < t and m != neg and len(v & ws) >= 2 for u, _, m, v in claims) for t, _, neg, ws in claims)
        if n:
            want[c] = n
    got = quality_plans.contradictions(spark.createDataFrame(rows, "conv_id long, turn long, t string")).collect()
    assert {r.conv_id: r.contradictions for r in got} == want and want


def test_metrics_by_hand(spark):
    pair = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]
    # headings 1 and 2, bullets 2 and 1, one number, one fence and one quote on the left only: 2 of 7
    assert pair("# T\n- x\n- y\n1. z\n```\n> q", "# T\n#tag\n## U\n* x", Q.markdown_likeness) == round(2 / 7, 6)
    assert pair("plain", "plain", Q.markdown_likeness) == 0.0
    assert one(spark, "The port is 80. maybe it is so. It should work! What? Owner of X uses Y.", Q.assertions) == ["The port is 80.", "It should work!", "Owner of X uses Y."]
    assert one(spark, "Nothing here. THE WORDS IS NOT", Q.assertions) == []
    assert [one(spark, t, Q.negated) for t in ("It is NOT so.", "It can't be.", "This, instead of that.", "A knot.", "It is so.")] == [True, True, True, False, False]
    assert [one(spark, t, Q.has_code) for t in ("use `abc` here", "use `ab` here", "x\n    return y", "a => b", "```", "plain words", "")] == [True, False, True, True, True, False, False]
    assert pair("```x```", "```x", Q.stability) == 0.75 and pair("a", "b", Q.stability) == 1.0 and pair("<thought>a</thought>", "<THOUGHT>", Q.stability) == 0.75
    assert pair("```\nx  y\n```\n```py\nz\n```", "```\nx y\n```", Q.blocks_preserved) == 0.5 and pair("none", "", Q.blocks_preserved) == 1.0
    assert pair("a B c", "b d", lambda a, b: Q.recall(Q.word_set(a), Q.word_set(b))) == round(1 / 3, 6) and pair("", "b", lambda a, b: Q.recall(Q.word_set(a), Q.word_set(b))) is None
    assert one(spark, "a a B b c", Q.richness) == 3 / 5 and one(spark, "", Q.richness) == 0.0
    assert one(spark, "[PROGRESS 1] and [LOOP DETECTED] [ARCHIVE", Q.leaked) == ["[PROGRESS", "[LOOP DETECTED"]

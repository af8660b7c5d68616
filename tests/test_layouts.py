"""Layouts, balance, capped batches, divergence, validity and discovery against plain loops."""

import heapq
import json
import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillspark.operators import balance, divergence, layout, validity
from quillspark.sources import discovery


def test_padded_rows_come_back_from_one_flat_row(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK", 16)  # rows lie across many blocks
    rnd = random.Random(2)
    rows = [(7 * i * i, [rnd.random() for _ in range(rnd.choice([0, 1, 3, 40]))]) for i in range(60)]  # keys with gaps
    shuffled = spark.createDataFrame(rnd.sample(rows, len(rows)), "key bigint, v array<double>").repartition(4)
    placed = layout.offsets(layout.placed(shuffled.withColumn("n", F.size("v")), "key", []), "n").cache()
    want, at = {}, 0
    for place, (key, v) in enumerate(rows):
        want[key] = (place, at, at + len(v))
        at += len(v)
    assert {r.key: (r.place, r.start, r.end) for r in placed.collect()} == want
    items = layout.flat(placed, "v")
    assert [r.value for r in items.orderBy("at").collect()] == [x for _, v in rows for x in v]
    for left in (True, False):
        got = {r.key: (r["values"], r["mask"]) for r in layout.padded(items, placed, 5, F.lit(-1.0), left).collect()}
        for key, v in rows:
            own = v[-5:] if left else v[:5]
            pad, ones = [-1.0] * (5 - len(own)), [1] * len(own)
            assert got[key] == ((pad + own, [0] * len(pad) + ones) if left else (own + pad, ones + [0] * len(pad)))
    back = layout.unpadded(layout.padded(items, placed, 40, F.lit(-1.0)), "values", "mask")
    assert {r.key: r["items"] for r in back.collect()} == dict(rows)
    repeats = layout.repeated(placed.select("key", "place"), 3).collect()
    assert sorted(r.interleaved for r in repeats) == sorted(r.tiled for r in repeats) == list(range(180))
    placed.unpersist()


def greedy(lengths, parts, equal):
    bias = sum(lengths) + 1 if equal else 0
    heap = [(0, k) for k in range(parts)]
    for n in sorted(lengths, reverse=True):
        load, k = heapq.heappop(heap)
        heapq.heappush(heap, (load + n + bias, k))
    return sorted(load for load, _ in heap)


def test_the_plan_deals_as_the_loop_does_and_grows_with_lengths_only():
    rnd = random.Random(3)
    for _ in range(300):
        parts = rnd.randrange(1, 9)
        equal = rnd.random() < 0.4
        lengths = [rnd.choice([rnd.randrange(4), rnd.randrange(100)]) for _ in range(parts * rnd.randrange(1, 30) if equal else rnd.randrange(1, 200))]
        bias = sum(lengths) + 1 if equal else 0
        histogram = {n: lengths.count(n) for n in lengths}
        loads = [0] * parts
        seen = {n: set() for n in histogram}
        for n, lo, hi, period, low, high, part in balance.greedy_plan([*histogram.items()], parts, equal):
            for r in range(lo, hi):
                if low <= (r - lo) % period < high:
                    loads[part + (r - lo) % period - low] += n + bias
                    assert r not in seen[n]
                    seen[n].add(r)
        assert sorted(loads) == greedy(lengths, parts, equal) and all(seen[n] == set(range(c)) for n, c in histogram.items())
    assert len(balance.greedy_plan([(n, 10**9 + n) for n in range(1, 200)], 64)) < 200 * 64 * 4


def test_rows_find_their_part_though_half_have_one_length(spark):
    rnd = random.Random(4)
    lengths = [50] * 400 + [rnd.randrange(1, 90) for _ in range(400)]
    rows = spark.createDataFrame([*enumerate(lengths)], "id bigint, n int").repartition(3)
    for equal in (False, True):
        got = balance.balanced(rows, "n", "id", 8, equal).collect()
        assert sorted(r.id for r in got) == list(range(800))
        bias = sum(lengths) + 1 if equal else 0
        loads = [sum(r.n + bias for r in got if r.part == p) for p in range(8)]
        assert sorted(loads) == greedy(lengths, 8, equal)
    ranks = balance.rank_within(rows, "n", "id").groupBy("n").agg(F.count("*").alias("c"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r.c == r.d == r.m + 1 for r in ranks)
    batches = balance.budget_batches(rows, "n", "id", 500).collect()
    cost = {}
    for r in batches:
        cost[r.batch] = cost.get(r.batch, 0) + r.n * r.n
    assert sorted(cost) == list(range(-(-sum(lengths) // 500))) and [cost[k] for k in sorted(cost)] == sorted(cost.values(), reverse=True)
    with pytest.raises(ValueError):
        balance.budget_batches(rows, "n", "id", 60)
    with pytest.raises(ValueError):
        balance.balanced(rows, "n", "id", 7, True)
    stats = balance.unbalance(balance.balanced(layout.placed(rows, "id", []), "n", "id", 8), "n", "place", "part", 8).first()
    assert stats.mean == sum(lengths) / 8 and stats.balanced_max - stats.balanced_min <= 90 and stats["max"] >= stats.balanced_max


def looped(c, o, size, most):
    """Classes of the rows of each batch, by the loop."""
    batches, i, j = [], 0, 0
    while i < c or j < o:
        batch = []
        for kind, cap in ((True, most), (False, size), (True, size), (False, size)):
            left = c - i if kind else o - j
            n = min(cap, size - len(batch), left)
            batch += [kind] * n
            i, j = (i + n, j) if kind else (i, j + n)
        batches.append(batch)
    return batches


def test_capped_batches_are_those_of_the_loop(spark):
    rnd = random.Random(5)
    cases, rows, want = [], [], {}
    for case in range(500):
        size = rnd.randrange(1, 12)
        cases.append((rnd.randrange(40), rnd.randrange(40), size, rnd.randrange(size + 1)))
    for case, (c, o, size, most) in enumerate(cases):
        ranks = {True: 0, False: 0}
        for k, batch in enumerate(looped(c, o, size, most)):
            for kind in batch:
                want[case, kind, ranks[kind]] = k
                ranks[kind] += 1
        rows += [(case, size, most, kind, r, c, o) for kind, n in ((True, c), (False, o)) for r in range(n)]
    df = spark.createDataFrame(rows, "case int, size int, most int, kind boolean, r bigint, c bigint, o bigint").cache()
    got = {}
    for size, most in sorted({x[2:] for x in cases}):
        part = df.where((F.col("size") == size) & (F.col("most") == most)).select("case", "kind", "r", balance.capped_batch(F.col("kind"), F.col("r"), F.col("c"), F.col("o"), size, most).alias("b"))
        got.setdefault("plan", []).append(part)
    plan = got["plan"]
    seen = {}
    for k in range(0, len(plan), 20):
        union = plan[k]
        for p in plan[k + 1 : k + 20]:
            union = union.unionAll(p)
        seen |= {(r.case, r.kind, r.r): r.b for r in union.collect()}
    assert seen == want
    df.unpersist()
    small = spark.range(100).select("id", (F.col("id") % 3 == 0).alias("all_positive"))
    out = balance.capped_batches(small, "all_positive", "id", 10, 0.25)
    assert sorted((r.batch, r.place) for r in out.collect()) == [(b, p) for b in range(10) for p in range(10)]
    stats = balance.capped_stats(out, "all_positive", 10, 0.25).first()
    loop = looped(34, 66, 10, 2)
    assert (stats.num_batches, stats.max_observed_ratio, stats.overflow_full_batches) == (len(loop), max(sum(b) / len(b) for b in loop), sum(sum(b) / len(b) > 0.25 for b in loop))


def softmax(x):
    top = max(x)
    e = [math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


def dense(s, t, beta):
    kl = lambda p, q: sum(a * (math.log(a) - math.log(b)) for a, b in zip(p, q, strict=True) if a)
    if beta in (0, 1):
        return kl(t, s) if beta == 0 else kl(s, t)
    m = [(1 - beta) * a + beta * b for a, b in zip(s, t, strict=True)]
    return beta * kl(t, m) + (1 - beta) * kl(s, m)


@pytest.mark.parametrize("beta", [0, 0.3, 1])
def test_divergence_is_that_of_the_dense_formula(spark, beta):
    rnd = random.Random(6)
    logits = {p: ([rnd.gauss(0, 3) for _ in range(9)], [rnd.gauss(0, 3) for _ in range(9)]) for p in range(12)}
    rows = lambda k, keep=lambda p, t: True: spark.createDataFrame([(p, t, x) for p, both in logits.items() for t, x in enumerate(both[k]) if keep(p, t)], "p bigint, token int, logit double")
    got = {r.p: r for r in divergence.divergence(rows(0, lambda p, t: p != 11), rows(1), ["p"], beta, 2.0).collect()}
    assert got.keys() == set(range(11))
    for p, r in got.items():
        s, t = logits[p]
        assert r.divergence == pytest.approx(dense(softmax([x / 2 for x in s]), softmax([x / 2 for x in t]), beta)) and r.tokens == 9
    # a token that one side lacks takes the other's logit
    short = {r.p: r.divergence for r in divergence.divergence(rows(0, lambda p, t: t < 7), rows(1), ["p"], beta).collect()}
    assert all(short[p] == pytest.approx(dense(softmax(s[:7] + t[7:]), softmax(t), beta)) for p, (s, t) in logits.items())
    # the teacher's best tokens only
    best = {p: sorted(range(9), key=lambda i: -t[i])[:4] for p, (_, t) in logits.items()}
    top = {r.p: r.divergence for r in divergence.divergence(rows(0), rows(1, lambda p, t: t in best[p]), ["p"], beta, mode="topk").collect()}
    assert all(top[p] == pytest.approx(dense(softmax([s[i] for i in best[p]]), softmax([t[i] for i in best[p]]), beta)) for p, (s, t) in logits.items())
    # lists of log-probabilities with a bucket for the rest
    logs = {p: tuple([math.log(x) for x in softmax(side)] for side in both) for p, both in logits.items()}
    listed = lambda k, keep: spark.createDataFrame([(p, t, x) for p, both in logs.items() for t, x in enumerate(both[k]) if keep(t)], "p bigint, token int, logit double")
    tail = {r.p: r for r in divergence.divergence(listed(0, lambda t: t < 6), listed(1, lambda t: t > 1), ["p"], beta, mode="tail").collect()}
    for p, (s, t) in logits.items():
        a, b = softmax(s), softmax(t)
        lumped = lambda x: x[2:6] + [1 - sum(x[2:6])]
        assert tail[p].divergence == pytest.approx(dense(lumped(a), lumped(b), beta)) and tail[p].divergence <= dense(a, b, beta) + 1e-9 and tail[p].tokens == 4
    apart = divergence.divergence(listed(0, lambda t: t < 3), listed(1, lambda t: t > 5), ["p"], beta, mode="tail").collect()
    assert {r.divergence for r in apart} == {0.0} and len(apart) == 12
    loss = divergence.distillation_loss(divergence.divergence(rows(0), rows(1), ["p"], beta)).first()
    assert loss.num_valid == 12 and loss.total == pytest.approx(sum(dense(softmax(s), softmax(t), beta) for s, t in logits.values()))


def test_full_kl_of_arrays(spark):
    p, q = softmax([1.0, 2.0, 0.5]), softmax([0.0, 1.0, 2.0])
    row = spark.createDataFrame([([math.log(x) for x in p], [math.log(x) for x in q])], "p array<double>, q array<double>").select(divergence.full_kl(F.col("p"), F.col("q")).alias("kl")).first()
    assert row.kl == pytest.approx(dense(q, p, 0))


def test_invalid_rows_are_dropped_and_counted_or_stop_the_job(spark):
    talk = lambda *roles: [(r, "x" if r else None) for r in roles]
    rows = [(1, talk("user", "assistant"), None, [[1, 2]]), (2, [], None, None), (3, talk("user", "judge"), None, None), (4, [("user", None)], None, None), (5, talk("user"), "x", None), (6, talk("user"), "y", [[1, 2, 3]]), (7, None, None, None)]
    df = spark.createDataFrame(rows, "id int, m array<struct<role: string, content: string>>, rejected string, boxes array<array<int>>").repartition(3)
    checks = validity.message_checks(F.col("m"), F.col("rejected")) | validity.box_checks(F.col("boxes"))
    seen = Observation("dropped")
    assert [r.id for r in validity.checked(df, checks, False, seen).collect()] == [1]
    assert seen.get == {"kept": 1, "no_messages": 2, "bad_role": 1, "no_content": 1, "rejected_is_chosen": 1, "bad_box": 1}
    assert {r.reason: r.rows for r in validity.reason_counts(df, checks).collect()} == {"ok": 1, "no_messages": 2, "bad_role": 1, "no_content": 1, "rejected_is_chosen": 1, "bad_box": 1}
    assert validity.checked(df.where("id = 1"), checks, True).count() == 1
    with pytest.raises(Exception, match="a row fails the check"):
        validity.checked(df, checks, True).collect()


def test_image_paths_by_a_listing(spark, tmp_path):
    for f in ("img/a.png", "img/nlvr2/images/b.png", "data/d.png", "img/deep/e.png"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    img, data = str(tmp_path / "img"), str(tmp_path / "data")
    listed = lambda root: discovery.listing(spark, root).select(F.concat(F.lit(f"{root}/"), "path").alias("path"))
    assert sorted(r.path for r in discovery.listing(spark, img).collect()) == ["a.png", "deep/e.png", "nlvr2/images/b.png"]
    files = listed(img).unionAll(listed(data))
    cases = {
        "x/VisualPRM400K-v1.1-Raw/images/deep/e.png": (f"{img}/deep/e.png",) * 2, "C:\\VisualPRM400K-v1.1-Raw\\no.png": (f"{img}/no.png", None),
        "images/a.png": (f"{img}/a.png",) * 2, "images/b.png": (f"{img}/nlvr2/images/b.png",) * 2, "images/c.png": (f"{img}/c.png", None),
        "d.png": (f"{data}/d.png",) * 2, "deep/e.png": (f"{img}/deep/e.png",) * 2, "z.png": (f"{img}/z.png", None), f"{img}/a.png": (f"{img}/a.png",) * 2, "/no/where.png": ("/no/where.png", None), "": (None, None),
    }
    rows = spark.createDataFrame([(p,) for p in cases] * 3 + [(None,)], "raw string")
    for strict in (False, True):
        got = discovery.resolve_images(rows, "raw", files, img, data, strict).collect()
        assert len(got) == 3 * len(cases) + 1 and {r.raw: r.resolved for r in got} == {p: w[strict] for p, w in cases.items()} | {None: None}
    lists = spark.createDataFrame([(1, ["z.png", "d.png", "images/b.png"]), (2, []), (3, None)], "id int, images array<string>")
    got = {r.id: r.resolved for r in discovery.image_lists(lists, "id", "images", files, img, data, True).collect()}
    assert got == {1: [f"{data}/d.png", f"{img}/nlvr2/images/b.png"], 2: [], 3: []}


def test_summaries_of_three_shapes_in_a_folder(spark, tmp_path):
    files = {
        "a/summary.json": {"summaries": [{"backend": "sft", "mode": "x", "num_samples": 10, "wall_time_sec": 5, "usage": {"prompt_tokens": 40}}, 7, {"backend": "b", "mode": "y", "num_samples": 2, "text_input_tokens": 6, "generated_tokens": 8}]},
        "b/c/run_summary.json": {"summary": {"backend": "visualprm", "mode": "soft", "num_samples": 4, "generated_tokens": 9, "latency_sec": {"mean": 1.5}, "quality_metrics": {"overall_step_macro_f1": {"macro_f1": 0.5}}}},
        "summary.json": {"backend": "sft", "mode": "z", "num_samples": 0, "usage": None},
        "other.json": {"backend": "never", "mode": "read"}, "d/summary.json": {"summary": []}, "e/summary.json": [1],
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    found = discovery.read_summaries(spark, str(tmp_path))
    got = {(r.method, r.num_samples): r for r in discovery.cost_rows(found, {("sft", "x"): "Ours"}).collect()}
    assert got.keys() == {("Ours", 10), ("b:y", 2), ("visualprm:soft", 4), ("sft:z", 0)}
    assert got["Ours", 10].avg_input_tokens_per_sample == 4.0 and got["Ours", 10].input_token_source == "api_prompt_tokens" and got["Ours", 10].avg_time_per_sample_s == 0.5
    assert got["b:y", 2].avg_input_tokens_per_sample == 3.0 and got["b:y", 2].avg_output_tokens_per_sample == 4.0 and got["b:y", 2].output_token_source == "generated_tokens"
    soft = got["visualprm:soft", 4]
    assert (soft.avg_output_tokens_per_sample, soft.avg_latency_per_sample_s, soft.macro_f1) == (0.0, 1.5, 0.5) and soft.summary_path.endswith("b/c/run_summary.json")
    assert got["sft:z", 0].avg_time_per_sample_s == 0.0
    assert discovery.cost_rows(found, least=3).count() == 2
    (tmp_path / "f_summary.json").write_text("{broken")
    assert discovery.read_summaries(spark, str(tmp_path), strict=False).count() == 4
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        discovery.read_summaries(spark, str(tmp_path)).collect()


def test_subsets_and_splits(spark, tmp_path):
    S = discovery.Subset
    known = [S("default"), S("big"), S("noisy", weak=True)]
    names = lambda asked, of=known: [s.name for s in discovery.select_subsets(of, asked)]
    assert names([]) == ["default"] and names(["all"]) == ["default", "big"] and names(["noisy", "new"]) == ["noisy", "new"] and names([], [S("one")]) == ["one"] and names([], []) == []
    assert names(["all"], [S("all"), S("x")]) == ["all"]
    with pytest.raises(ValueError):
        names([], [S("a"), S("b")])
    assert discovery.split_spec("s3://b/x@test") == ("s3://b/x", "test") and discovery.split_spec("x") == ("x", "train")
    spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string").write.parquet(str(tmp_path / "p"))
    assert [r.id for r in discovery.read_path(spark, f"{tmp_path}/p@test").collect()] == [2]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    assert discovery.read_path(spark, str(tmp_path / "j")).count() == 2
    (tmp_path / "t.tsv").write_text("a\tb\n1\tq\n")
    assert discovery.read_path(spark, str(tmp_path / "t.tsv")).first().b == "q"
    (tmp_path / "u.bin").write_text("x")
    with pytest.raises(ValueError):
        discovery.read_path(spark, str(tmp_path / "u.bin"))

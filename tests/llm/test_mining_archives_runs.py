"""Hard negatives, WARC archives and periodic runs against brute force, on small tables with nulls, ties, repeated rows and clashing columns."""

import base64
import collections
import gzip
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, runs, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(rows):
    return collections.Counter(map(tuple, rows))


# hard negatives

VECTORS = "vec_id bigint, label int, vector array<bigint>, score string, row string, slot string"


def mined(rows, positives=5, negatives=10):
    """Every pair of rows, in plain loops."""
    own = [(i, v, lab, [*vec]) for i, (v, lab, vec) in enumerate(rows) if v is not None and lab is not None and vec is not None and None not in vec]
    out = []
    for i, v, lab, vec in own:
        if v % 4:
            continue
        scores = [(-sum(a * b for a, b in zip(vec, other, strict=False)), w, j, other_lab) for j, w, other_lab, other in own if j != i]
        near = sorted((s, w, j) for s, w, j, x in scores if x == lab)[:positives]
        for p, w, _ in near:
            far = sorted((s, x, j) for s, x, j, y in scores if y != lab and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
            out += [(v, w, n + 1, x, -p, -s) for n, (s, x, _) in enumerate(far)]
    return out


def vector_rows():
    rnd = random.Random(3)
    rows = [(i, rnd.randrange(3), [rnd.randrange(-9, 10) for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, i % 2, [3, 3, 3, 0, 0]) for i in range(30)]  # ties
    rows += [rows[0], rows[4], (8, 2, [1, 2, 3, 4, 5]), (8, 1, [5, 4, 3, 2, 1])]  # repeated rows, an id twice
    rows += [(None, 1, [1] * 5), (200, None, [1] * 5), (204, 1, None), (208, 1, [1, None, 1, 1, 1]), (212, 1, []), (216, 0, [7, 7]), (-4, 0, [4, 4, 4, 4, 4])]
    return rows


@pytest.mark.parametrize("at_once", [16_384, 7])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", at_once)
    monkeypatch.setattr(hard_negatives, "SCORES_AT_ONCE", 64)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(5)
    got = hard_negatives.hard_negatives(df, F.expr("vec_id % 4 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert counted(got.collect()) == counted(mined(rows))


def test_hard_negatives_of_large_numbers_are_exact(spark):
    big = 1 << 40
    rows = [(0, 1, [big, 1]), (1, 1, [big, 0]), (2, 2, [big // 2, 1]), (3, 2, [big // 2, 2]), (5, 2, [big // 4, 0]), (6, 2, [big, 0])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    assert hard_negatives.hard_negatives(df, F.expr("vec_id % 4 = 0")).count() == 0  # all scores count as the greatest number, so none is below 90 %
    small = [(v, lab, [x // (1 << 12) for x in vec]) for v, lab, vec in rows]  # sums above 2**53 and below 2**63
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in small], VECTORS)
    assert counted(hard_negatives.hard_negatives(df, F.expr("vec_id % 4 = 0")).collect()) == counted(mined(small))


@pytest.mark.parametrize("rows", [[], [(0, 1, [1, 2])], [(0, 1, [1]), (4, 1, [2])], [(0, 1, [1]), (4, 1, [-2]), (5, 2, [3])], [(1, 1, [1]), (2, 1, [1])], [(0, 1, []), (4, 1, []), (5, 2, [])]])
def test_hard_negatives_where_there_are_few_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    assert counted(hard_negatives.hard_negatives(df, F.expr("vec_id % 4 = 0")).collect()) == counted(mined(rows))


def test_hard_negatives_query_leaves_out_what_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.25], 3), (100, [0.5, nan], 3), (200, [inf, 0.1], 3), (7, [0.5, 0.5], 2), (3, [0.3, 0.1], 4), (300, [0.4, 0.4], 3), (14, None, 2), (21, [0.1, None], 2)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect()
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in vec]) for i, vec, lab in rows if vec and None not in vec and np.isfinite(vec).all()]
    want = [r for r in mined([(v if v % 4 or v % 100 == 0 else v, lab, vec) for v, lab, vec in whole]) if r[0] % 100 == 0]
    assert counted(got) == counted(want) and want


# archives

PAGES = "page_id bigint, url string, html string, key string, n string, first string"


def page_rows():
    rows = [(i, f"http://a.b/{i}", f"<p>page {i}</p>") for i in range(1, 20)]
    rows += [(50 + i, "http://c.d/é x\r\nInjected: 1", "same für alle") for i in range(30)]
    rows += [(100, None, None), (101, "u", ""), (99, "u", ""), (None, "n", "<p>page 3</p>"), (None, "n", "only here"), (None, "n", "only here"), (3, "twice", "<p>page 3</p>"), rows[5], rows[5]]
    return [*rows, (200, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (201, "u", "\x1f\x8b\x08\x00 \0 é \n\n"), (202, "u", "line\n" * 50_000)]


def archived(rows):
    """page_id, bytes, digest, type, refers_to of each row."""
    by = collections.defaultdict(list)
    for page, _, html in rows:
        by[html or ""].append(page)
    out = []
    for html, ids in by.items():
        data = html.encode()
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out += [(x, len(data), digest, "revisit" if k else "response", ids[0] if k else None) for k, x in enumerate(ids)]
    return out


def test_warc_query_gives_every_page_once(spark, tmp_path):
    rows = page_rows()
    spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op12_warc(spark, str(tmp_path))
    assert counted(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == counted(archived(rows))


def test_warc_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op12_warc(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("gzipped", [True, False])
def test_archives_keep_payloads_and_other_readers_can_read_them(spark, tmp_path, gzipped):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)
    warc.write_archives(pages, str(tmp_path / "a"), gzipped, archive_bytes=100_000)
    files = [f for f in os.listdir(tmp_path / "a") if f.startswith("part-")]
    assert len(files) > 1
    for f in files:
        data = (tmp_path / "a" / f).read_bytes()
        plain = gzip.decompress(data) if gzipped else data  # whole, with no rest
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and plain.endswith(b"\r\n\r\n")
    back = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert not any(r.gap for r in back) and not any("\n" in (r.url or "") for r in back)
    stored = collections.Counter(bytes(r.payload) for r in back if r.type == "response")
    assert stored == collections.Counter({(html or "").encode(): 1 for _, _, html in rows})
    ids = {r.record_id for r in back}
    assert all(r.refers_to_id in ids for r in back if r.type == "revisit")


def test_a_record_above_the_size_of_the_separator_trick(spark, tmp_path):
    text = "0123456789abcdef" * (1 << 20) + "end"
    pages = spark.createDataFrame([(1, "u", text, "", "", ""), (2, "u", "short", "", "", "")], PAGES).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    got = {r.record_id.split(":")[2]: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect() if r.type == "response"}
    assert bytes(got["1"].payload) == text.encode() and bytes(got["2"].payload) == b"short"


def parts(gzipped):
    records = [warc._page(f"http://a/{i}", f"payload {i} ".encode() * 40, f"urn:page:{i}:{i}", None, "2020-01-01T00:00:00Z") for i in range(6)]
    return [gzip.compress(r) for r in records] if gzipped else records


def survivors(data):
    """Ids of the records, and the gaps."""
    got = list(warc.salvage(data))
    assert [g[0] for g in got] == sorted(g[0] for g in got)
    return [int(g[2]["record_id"].split(":")[2]) for g in got if isinstance(g[2], dict)], [g for g in got if isinstance(g[2], str)]


@pytest.mark.parametrize("gzipped", [True, False])
@pytest.mark.parametrize("harm", ["cut", "flip", "junk", "lost start", "cut end", "length", "random"])
def test_damage_costs_the_records_that_it_touches(gzipped, harm):
    p = parts(gzipped)
    at = [sum(map(len, p[:k])) for k in range(7)]
    whole = b"".join(p)
    if harm == "cut":  # the second half of record 2 is gone
        data, lost, gap = whole[: at[2] + len(p[2]) // 2] + whole[at[3] :], {2}, (at[2], at[2] + len(p[2]) // 2)
    elif harm == "flip":
        k = at[2] + len(p[2]) - 60
        data, lost, gap = whole[:k] + bytes([whole[k] ^ 0x55]) + whole[k + 1 :], {2}, (at[2], at[3])
    elif harm == "junk":
        data, lost, gap = whole[: at[3]] + b"\0junk\x1f\x8b\x08\0WARC/1.1\r\nmore" + whole[at[3] :], set(), (at[3], at[3] + 23)
    elif harm == "lost start":
        data, lost, gap = whole[30:], {0}, (0, at[1] - 30)
    elif harm == "cut end":
        data, lost, gap = whole[:-20], {5}, (at[5], at[6] - 20)
    elif harm == "length":
        broken = re.sub(rb"Content-Length: (\d+)\r\n\r\nHTTP", rb"Content-Length: 999\1\r\n\r\nHTTP", warc._page("u", b"x" * 50, "urn:page:2:2", None, "d"))
        broken = gzip.compress(broken) if gzipped else broken
        data, lost, gap = whole[: at[2]] + broken + whole[at[3] :], {2}, (at[2], at[2] + len(broken))
    else:
        rnd = random.Random(7)
        for _ in range(60):
            k, n = rnd.randrange(len(whole)), rnd.randrange(1, 200)
            data = whole[:k] + rnd.randbytes(n) + whole[k + n :]
            touched = {i for i in range(6) if at[i] < k + n and at[i + 1] > k}
            ids, gaps = survivors(data)
            assert set(range(6)) - touched <= set(ids) and len(ids) == len(set(ids))
            assert sum(e - s for s, e, _ in gaps) <= sum(len(p[i]) for i in touched) + n
        return
    ids, gaps = survivors(data)
    assert ids == [i for i in range(6) if i not in lost]
    assert [(s, e) for s, e, _ in gaps] == [gap]


def test_gaps_reach_the_table(spark, tmp_path):
    p = parts(True)
    (tmp_path / "a.warc.gz").write_bytes(p[0] + p[1][:50] + p[2])
    (tmp_path / "b.warc").write_bytes(b"nothing of the kind")
    (tmp_path / "c.warc").write_bytes(b"")
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    gaps = sorted((os.path.basename(r.file), r.start, r.end) for r in rows if r.gap)
    assert gaps == [("a.warc.gz", len(p[0]), len(p[0]) + 50), ("b.warc", 0, 19)]
    assert sorted(r.record_id for r in rows if not r.gap) == ["urn:page:0:0", "urn:page:2:2"]


# runs


def all_runs(words):
    """Every stretch, by direct comparison at every distance."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(words[x] == words[x + r] for x in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(doc_id, text):
    """The row of a document by the contract."""
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_texts():
    rnd = random.Random(5)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "a b c " * 4, "x a a a a a a a b b b b b b b y", "ä b ä b " * 9, "a " * 5000, ("a " * 6 + "b ") * 40, "p q r s t u v w x " * 5, "\x1c \x85 " * 9]
    for _ in range(160):
        n, k = rnd.randrange(1, 200), rnd.choice([1, 2, 3, 30])
        words = [str(rnd.randrange(k)) for _ in range(n)]
        for _ in range(rnd.randrange(3)):
            a, p, e = rnd.randrange(n), rnd.randrange(1, n // 4 + 2), rnd.randrange(n)
            for i in range(a + p, e):
                words[i] = words[i - p]
        texts.append(" ".join(words))
    return texts


def test_runs_are_those_of_direct_comparison(spark):
    rows = [(i, t) for i, t in enumerate(run_texts())]
    rows += [rows[9], (None, "a b " * 9), (0, "c " * 9)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id bigint, text string, runs string, period string, start string").repartition(3)
    got = runs.periodic_runs(df, planted=True).drop("runs")
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    assert counted(got.collect()) == counted(collapsed(*r) for r in rows)


def test_runs_of_an_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_runs_of_long_periods_and_of_a_very_long_text():
    rnd = random.Random(6)
    words, want = [], []
    for q in (5, 8, 9, 64, 100, 1000, 4097):
        one = [rnd.randrange(1 << 30) for _ in range(q)]
        start, length = len(words) + 1, 4 * q + rnd.randrange(q)
        words += [-1 - len(words), *(one[i % q] for i in range(length)), -2 - len(words)]
        want.append((start, length, q))
    numbered = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
    start, end, period = runs.find_runs(numbered, np.array([0, len(words)]))
    assert [*zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)] == want


def test_range_successor_against_sorting():
    rnd = np.random.default_rng(0)
    values = rnd.permutation(1000).astype(np.int64)
    tree = runs.Wavelet(values)
    lo = rnd.integers(0, 999, 300)
    hi = lo + 1 + rnd.integers(0, 1000 - lo)
    than = rnd.integers(0, 1100, 300)
    below = tree.less(lo, hi, than)
    assert below.tolist() == [int((values[a:b] < t).sum()) for a, b, t in zip(lo, hi, than, strict=True)]
    k = rnd.integers(0, hi - lo)
    assert tree.kth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[j]) for a, b, j in zip(lo, hi, k, strict=True)]

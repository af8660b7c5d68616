"""Training-data operators against brute force, on small tables with nulls, empty texts, copies and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import words as word_hashes
from quillspark.llm import bpe, fingerprints, language, minhash, packing, perspectives, quality_knn, quality_rules, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, k1 string, score string, block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    base = [word() for _ in range(200)]
    texts = [None, "", " \n\t ", "a", "A b", "x" * 3000, "spam eggs " * 200, passage, f"intro {passage} end", f"{passage} tail words", "!!! ??? 12 <|endoftext|> İΣ"]
    texts += [" ".join(base)] * 3
    for k in (3, 9, 20, 40):
        own = base[:]
        for i in rnd.sample(range(len(own)), k):
            own[i] = word() + "q"
        texts.append(" ".join(own))
    texts += ["\n".join(["same line", "same line", *(word() for _ in range(20))]), *(" ".join(word() for _ in range(rnd.randrange(1, 120))) for _ in range(15)), "long " + " ".join(word() for _ in range(9000))]
    rows = [(3 * i, t, "en", "s", 0, "x", "y", "z", "b") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id here at all", None, None, None, None, None, None, None), (0, " ".join(base), "en", None, 1, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


def test_bpe_agrees_with_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import numpy as np
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for row in corpus():
        ids = lib.encode(row[1] or "", add_special_tokens=False).ids
        want.append((row[0], np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)))
    same([(r[0], bytes(r[1]), r[2]) for r in bpe.encode_decode(docs).collect()], want)
    assert bpe.encode_decode(empty).count() == 0


def test_bpe_separators_beside_punctuation():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = bpe.Bpe(bpe.vocabulary())
    rnd = random.Random(3)
    texts = ["a !\x1c! b", "-\x1d", *("".join(rnd.choice("!-'.sa1 \t\n\x0b\x1b\x1c\x1d\x1e\x1f") for _ in range(rnd.randrange(1, 12))) for _ in range(500))]
    for t in texts:
        for u in (t, t + " é"):
            assert np.frombuffer(own.encode(u), "<u4").tolist() == lib.encode(u, add_special_tokens=False).ids, ascii(u)


def test_bpe_agrees_at_every_contested_character():
    """Characters that Unicode versions class otherwise, the additions of Unicode 16, and every 37th of all others."""
    tokenizers = pytest.importorskip("tokenizers")
    import unicodedata

    import public_tokenizers
    import regex

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = bpe.Bpe(bpe.vocabulary())
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in every if unicodedata.category(chr(c)) == "Cn" and regex.match(r"[\p{L}\p{N}]", chr(c))]
    chosen = sorted({*odd[::3], *every[::37], *every[:0x3000], *bpe._LATER, *(c for r in bpe._SIXTEEN for c in r)})
    texts = [t for c in chosen for t in (f"a{chr(c)}b1 {chr(c)}x", f"!{chr(c)}{chr(c)}! é")]
    for lo in range(0, len(texts), 4000):
        for t, want in zip(texts[lo : lo + 4000], lib.encode_batch(texts[lo : lo + 4000], add_special_tokens=False), strict=True):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == want.ids, ascii(t)


def test_bpe_compatible_pairs():
    own = bpe.Bpe(bpe.vocabulary())
    rnd = random.Random(2)
    tokens = [i for i, t in own.text.items() if own.alone[i]]
    inner = [i for i in tokens if not own.text[i].endswith("\n")]
    for k in range(8000):
        a, b = (rnd.choice(inner[:600]), rnd.choice(tokens[:1200])) if k % 3 else (rnd.choice(inner), rnd.choice(tokens))
        assert (own.merged(own.text[a] + own.text[b]) == [a, b]) == own._compatible(a, b, 1 << 30)
    for i in rnd.sample(tokens, 2000):
        assert own.merged(own.text[i]) == [i]


def test_bpe_words_agree_with_merges():
    own = bpe.Bpe(bpe.vocabulary())
    rnd = random.Random(1)
    for letters in ("abcdeinorst", "ab", "a", "!.-'"):
        for _ in range(1000):
            w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 30)))
            assert own.word(w) == own.merged(w + "\n")


def test_quality_counts(docs, empty):
    want = []
    for row in corpus():
        t, w = row[1] or "", words(row[1])
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        gone = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        base = len(w) < 20 or 100 * len(gone) > 30 * len(w)
        want.append((row[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(gone), base))
    judged = quality_rules.judge(docs, [])
    same(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), want)
    assert quality_rules.judge(empty, []).count() == 0


def test_rules_are_learned_and_applied(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    x = {f: rnd.random(600) for f in quality_rules.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) & (x["upper_share"] <= 0.5) | (x["dup_line_share"] > 0.9)
    rules = quality_rules.learn_rules(x, bad)
    assert rules
    found = np.zeros(600, bool)
    for r in rules:
        found |= quality_rules._covers(r, x, 600)
    assert (found == bad).mean() > 0.95
    assert not quality_rules.learn_rules(x, np.zeros(600, bool))


def test_packing(docs, empty):
    own = bpe.Bpe(bpe.vocabulary())
    rows = packing.pack(docs, capacity=64).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    want = []
    for row in corpus():
        ids = own.encode(row[1] or "") + bytes(4)
        want += [(row[0], i, 64 * i, len(c) // 4, zlib.crc32(c)) for i in range(-(-len(ids) // 256)) if (c := ids[256 * i : 256 * i + 256])]
    same([r[:5] for r in rows], want)
    assert len(bins) <= 1.05 * -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack(empty).count() == 0


def fewest(items, capacity):
    """The least number of sequences, by trying all placements."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            j = bins.index(room)
            go(i + 1, [*bins[:j], room - items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_packing_reduction_never_loses_the_optimum():
    rnd = random.Random(3)
    fixed = total = 0
    for _ in range(600):
        capacity = rnd.choice([7, 10, 13, 20, 30])
        items = sorted((rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 9))), reverse=True)
        left = np.bincount(items, minlength=capacity + 1).astype(np.int64)
        plan = packing._Plan()
        packing._reduce(left, capacity, plan)
        rest = [n for n in range(capacity, 0, -1) for _ in range(left[n])]
        assert plan.sequences + (fewest(rest, capacity) if rest else 0) == fewest(items, capacity), (capacity, items)
        fixed, total = fixed + len(items) - len(rest), total + len(items)
    assert fixed > 0.75 * total


def test_packing_plan_covers_every_piece_once():
    rnd = random.Random(2)
    for _ in range(300):
        capacity = rnd.choice([10, 50, 64])
        histogram = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 20) for _ in range(8)}
        bins, ranks = collections.defaultdict(list), collections.Counter()
        for length, rank, count, first, copies, offset in packing.plan_packing(histogram, capacity):
            assert ranks[length] == rank
            ranks[length] += count
            for i in range(count):
                bins[first + i // copies].append((offset + i % copies * length, length))
        assert ranks == collections.Counter(histogram)
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity


def brute_components(rows, size, per=80, of=100):
    ids = [r[0] for r in rows]
    lower = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sets = []
    for r in rows:
        w = lower(r[1])
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if None not in (ids[i], ids[j]) and sets[i] and sets[j] and of * len(sets[i] & sets[j]) >= per * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return [(r[0], len(s), find(r[0]) if r[0] is not None else None, r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)]


def test_near_duplicates(docs, empty):
    same(minhash.near_duplicates(docs, 4).collect(), brute_components(corpus(), 4))
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n, shared in ((3, 2), (50, 30), (2000, 1500)):
        x = rnd.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        a, b = minhash.sketch(x[:n], 400), minhash.sketch(x[n - shared :], 400)
        assert abs((a == b).mean() - shared / (2 * n - shared)) < 0.12


def test_chains_of_near_copies(spark):
    rnd = random.Random(5)
    text = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(text)))
        text = text[:]
        text[rnd.randrange(100)] = f"n{i}"
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()
    same(got, brute_components(rows, 4))


def test_fingerprints(docs, empty):
    rows = [(r[0], r[1] or "") for r in corpus()]
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    order = sorted(by_id, key=lambda i: (i is not None, i))
    after = {i: min(by_id[order[(k + 1) % len(order)]]) for k, i in enumerate(order)}
    got = fingerprints.fingerprint(docs).collect()
    want = []
    for i, t in rows:
        take = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - take] + after[i][:take]).encode()).hexdigest()))
    same([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], want)
    prints = collections.defaultdict(set)
    texts = {hashlib.sha256(w[2].encode()).hexdigest(): w for w in want}
    assert texts
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(by_id[r.doc_id]) == 1:
            prints[by_id[r.doc_id][0]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.fingerprint(empty).count() == 0


def test_fingerprints_have_64_samples_of_16_bits(spark):
    a = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:1000] + [f"v{i}" for i in range(1000)]))]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    digits = "".join(r[c] for r in got.values() for c in ("fingerprint", "edited_fingerprint"))
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 64 * 4 for r in got.values())
    assert len(set(digits[::4])) == 16
    assert len({got[2].fingerprint[i : i + 4] for i in range(0, 256, 4)}) > 60
    assert abs(got[1].near_next - 0.25) < 0.2  # 1000 words of 4000
    for r in got.values():  # likeness is the share of equal samples
        pairs = [(r.fingerprint[i : i + 4], r.edited_fingerprint[i : i + 4]) for i in range(0, 256, 4)]
        assert r.near_edited == sum(x == y for x, y in pairs) / 64


def test_substrings(docs, empty):
    rows = corpus()
    seen = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = substrings.remove_repeats(docs)
    same(got.select("doc_id", "n_words", "n_removed", "kept_text").collect(), want)
    for r in got.collect():
        assert sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_in_periodic_texts(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["p"] * rnd.randrange(60) + ["q", "r"] * rnd.randrange(40) + ["x y z"] * rnd.randrange(30) + [str(rnd.randrange(5))])) for i in range(25)]
    seen = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = [(r[0], len({j for w in [words(r[1])] for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)})) for r in rows]
    same(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_removed").collect(), want)


def test_equal_windows_have_equal_names():
    """Whatever stands around them, and however often their words recur."""
    rnd = random.Random(6)
    named = 0
    for _ in range(600):
        kinds, size = rnd.choice([1, 2, 3, 4, 6, 20, 1000]), rnd.choice([3, 5, 8, 12, 35])
        shared = [rnd.randrange(kinds) for _ in range(size)]
        texts = [[rnd.randrange(kinds) for _ in range(rnd.randrange(8))] + shared + [rnd.randrange(kinds) for _ in range(rnd.randrange(8))] for _ in range(4)]
        fp = word_hashes.mix(np.array([x + 1 for t in texts for x in t], np.uint64))
        starts, names = substrings.window_names(fp, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), size)
        known = {}
        for at, name in zip(starts.tolist(), names.tolist(), strict=True):
            assert known.setdefault(tuple(fp[at : at + size].tolist()), name) == name
            named += kinds == 1000 and size == 35 and name > 0
    assert named > 0


def test_symbols_stand_for_their_words():
    """Symbols of one name expand to the same words, runs become one symbol, and long windows have long symbols."""
    rnd = random.Random(7)
    text = [rnd.choice("abcdefgh") for _ in range(3000)] + ["x"] * 12 + [rnd.choice("abcdefgh") for _ in range(40)]
    fp = word_hashes.mix(np.array([ord(c) for c in text], np.uint64))
    expansion, spans = {}, []
    for s in substrings.recompress(fp, np.zeros(len(fp), np.int64), 35):
        for name, a, b, ca, cb in zip(s.name.tolist(), s.a.tolist(), s.b.tolist(), s.ca.tolist(), s.cb.tolist(), strict=True):
            assert ca <= a < b <= cb and cb - ca <= 35
            assert expansion.setdefault(name, text[a:b]) == text[a:b]
            spans.append(b - a)
    assert ["x"] * 12 in expansion.values()
    assert max(spans) > 16
    _, names = substrings.window_names(fp, np.array([0, len(fp)]), 35)
    assert np.median(names >> np.uint64(64 - 6)) >= 8


def test_short_windows_keep_their_anchors_inside(spark):
    rows = [(1, "q b a b c d e f"), (2, "a b a b c d e g"), (3, "u v w")]
    for size in (3, 5, 6, 8, 9, 10):
        seen = collections.Counter(tuple(w[i : i + size]) for r in rows for w in [words(r[1])] for i in range(len(w) - size + 1))
        want = [(r[0], len({j for w in [words(r[1])] for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)})) for r in rows]
        same(substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), size).select("doc_id", "n_removed").collect(), want)


def test_substrings_of_rows_without_an_id_or_with_one_id(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, f"a b {long} c", "x"), (None, f"d {long} e", "y"), (1, f"first {long}", "z"), (1, "second alone", None), (2, None, "n")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, kept_text string"), keep_row=True).collect()
    same([(r._row.text, r._row.kept_text, r.kept_text) for r in got], [(rows[0][1], "x", "a b c"), (rows[1][1], "y", "d e"), (rows[2][1], "z", "first"), (rows[3][1], None, "second alone"), (None, "n", "")])


def test_quality_classifier(spark, docs, empty):
    rnd = random.Random(7)
    good = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + rnd.choice(["", "s", "ed"]) for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rnd.choice(["ALPHA!!", "$$$", "BUY###", "NOW***"]) for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id bigint, quality int")
    model = quality_knn.fit(table, labels, "doc_id % 5 <> 0")
    got = {r.doc_id: r.score for r in quality_knn.score(table, model).collect()}
    assert all((got[i] >= 0.5) == (i < 60) for i in range(0, 120, 5))
    assert all(0 <= r.score <= 1 for r in quality_knn.score(docs, model).collect())
    assert quality_knn.score(empty, model).count() == 0
    assert quality_knn.fit(table, labels, "false") is None
    assert {r.score for r in quality_knn.score(docs, None).collect()} == {1.0}


def test_toxicity(spark, docs, empty):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(240):
        w = [word() for _ in range(60)]
        for _ in range(3 if i % 3 == 0 else 0):
            w[rnd.randrange(60)] = rnd.choice(["bzkqwort", "vxgrumph", "jzimbelq"])
        rows.append((" ".join(w), int(i % 3 == 0)))
    model = toxicity.Model.fit(rows[:180])
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert sum((got[i] >= 0.5) == bool(rows[i][1]) for i in range(180, 240)) >= 57
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.Model.fit([("only one kind", 0)]) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_toxicity_is_what_compressed_lengths_say():
    """Distances and scores against lengths that are compressed here, with the same dictionaries."""
    import zstandard

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randrange(2, 9)))
    rows = [(" ".join([word() for _ in range(30)] + ["Bzkqwort,"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(90)]
    model = toxicity.Model.fit(rows)
    assert toxicity.spell(b" bzkqwort ") in model.toxic  # every passage, uncut

    def length(text, content):
        how = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(text))

    def distance(text):
        out = 0
        for w in re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower().encode()).split():
            spelled = b"".join(toxicity._SPELLED[c] for c in b" " + w + b" ")
            plain, own = length(spelled, model.ordinary), length(spelled, model.toxic)
            out = max(out, max(0, min(100, round(100 * (plain - own) / max(1, plain - model.least)))))
        return out

    measure = toxicity.Measure(model)
    for text, label in rows[:24]:
        assert measure.text(text) == distance(text)
        assert (model.scores[min(distance(text), len(model.scores) - 1)] >= 0.5) == bool(label)
    assert measure.text(None) == measure.text("12 !!") == 0


def test_toxicity_on_the_given_labels():
    """Held-out rows of the given tables.  A seventh of those labelled toxic hold no word that any other toxic text has; no word-wise method finds them."""
    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{at}/labels.parquet").to_pylist() if r["toxic"] is not None}
    rows = [(r["doc_id"], r["text"], label[r["doc_id"]]) for r in pq.read_table(f"{at}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in label and r["text"]]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    learn = [r[1:] for r in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).digest()) if zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.Model.fit([r for r in learn if r[1]][: toxicity.TOXIC_ROWS] + [r for r in learn if not r[1]][: toxicity.ORDINARY_ROWS])
    measure = toxicity.Measure(model)
    said = [model.scores[min(measure.text(t), len(model.scores) - 1)] >= 0.5 for _, t, _ in held]
    hits = sum(1 for s, r in zip(said, held, strict=True) if s and r[2])
    assert hits >= 0.8 * sum(r[2] for r in held) and hits >= 0.9 * sum(said)


def test_language(spark, docs, empty):
    rnd = random.Random(9)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(60))
    parts = {"aa": ["tho", "ing", "er", "and"], "bb": ["ção", "que", "dos", "ñe"], "cc": ["sch", "ung", "ß", "ein"]}
    rows = [(i, make(parts[n]), n) for i, n in enumerate(["aa", "bb", "cc"] * 20)] + [(100, None, "aa"), (101, "12 !?", "bb"), (102, make(parts["cc"]).upper(), None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language.learn(table, "doc_id < 30")
    got = {r.doc_id: r for r in language.identify(table, sample).collect()}
    assert all(got[i].lang_pred == n for i, _, n in rows[30:60])
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0
    assert got[102].lang_pred == "cc"
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(empty, sample).count() == 0


def test_language_of_signs_beyond_the_basic_plane_and_of_long_texts(spark):
    long = "😀 12 " * 5000 + "ção que dos ñe " * 2000
    rows = [(i, "tho ing er and " * 10, "aa") for i in range(5)] + [(i, long, "bb") for i in range(5, 9)] + [(9, "12", "bb"), (10, "que dos ção", None), (11, "123 \U0001f600", None), (12, "\U00010330\U00010331 \U0001f600", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sample = language.learn(table, "true")
    assert set(sample) == {"aa", "bb"}
    got = {r.doc_id: r for r in language.identify(table, sample).collect()}
    assert got[10].lang_pred == "bb"
    assert got[11].lang_pred == "und" and got[11].score == 0
    assert got[12].lang_pred != "und" and got[12].score > 0


def phrase_count(text, doc):
    n = i = 0
    while i < len(doc):
        k = 1
        while i + k < len(doc) and doc[i : i + k + 1] in text:
            k += 1
        n, i = n + 1, i + k
    return n


def lettered(doc):
    data = np.frombuffer(doc.encode(), np.uint8)
    return language.letters(data, np.array([0, len(data)]))


def test_cross_parsing_counts_phrases():
    rnd = random.Random(6)
    sample = {"x": "the cat sat on the mat", "y": "быстрая лиса на собаке", "z": "tat hat", "one": "tttt"}
    docs = ["the mat", "catsat", "zzz the", "zthez", "onthe", "s", "лиса", "the лиса sat", "qлq", "юю ю"]
    docs += ["".join(rnd.choice("thecasonm лиqю") for _ in range(rnd.randrange(1, 200))) for _ in range(40)]
    own = language.Languages(sample)
    for doc in docs:
        low, upto = lettered(doc)
        if len(low):
            t = "".join(chr(c) if c else " " for c in low.tolist())
            assert own.phrases(low, upto)[0].tolist() == [phrase_count(sample[n], t) for n in own.names], doc


def test_language_of_another_script(spark):
    sample = {"en": "the quick brown fox jumps over the lazy dog", "ru": "быстрая коричневая лиса прыгает через собаку"}
    rows = [(1, "быстрая собака", "ru"), (2, "over the fox", "en"), (3, "лиса", "ru"), (4, "x", "en")]
    got = language.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}


def test_language_tables_grow_with_the_sample_not_the_script():
    rnd = random.Random(8)
    script = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    text = "".join(rnd.choice(script) for _ in range(40_000))
    own = language.Languages({"many": text, "few": "the cat sat on the mat"})
    assert sum(p.cells.nbytes + p.base.nbytes for p in own.parsers) < 8_000_000
    doc = text[500:520] + "the cat" + text[9000:9030]
    low, upto = lettered(doc)
    assert own.phrases(low, upto)[0].tolist() == [phrase_count("the cat sat on the mat", doc), phrase_count(text, doc)]


def test_perspectives(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 1, None, "x"), (1, 200, "ann", "bye"), (1, 200, "ann", "bye"), (None, 0, "ann", "alone"), (2, 5, "cy", "")]
    got = perspectives.rotate(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as position", "2 as start")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id, r.perspective].append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (2, "cy")}
    for (conv, who), own in by.items():
        own.sort(key=lambda r: r.position)
        whole = "".join(r.segment for r in own)
        for r in own:
            assert whole[r.start : r.end] == r.segment
            if r.speaker == who:
                assert r.shown_as == "assistant" and whole[r.mask_start : r.mask_end].endswith("<|im_end|>")
            else:
                assert r.shown_as == f"user name={r.speaker}" and r.mask_start is None
        assert [r.position for r in own] == list(range(len(own)))
        assert len(own) == sum(x[0] == conv for x in rows)

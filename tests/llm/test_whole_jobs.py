"""Whole jobs against brute force where an earlier version did less."""

from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bm25, bpe, common, components, packing, pii, suffix_dedup, token_counts, toxicity


def test_bm25_whole_text(spark):
    """Queries of more terms than ``TERMS``, frequent and single terms included, and a frequency beyond 16 bits."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(150)]
    texts = [" ".join(vocabulary[int(j)] for j in np.minimum(rng.zipf(1.3, 60), 150) - 1) + f" own{i} " + " ".join(map(str, range(i % 9))) for i in range(120)]
    texts[7] += " w3" * 70_000
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = [Counter(bm25.words(t)) for t in texts]
    n, mean, df = len(rows), sum(sum(c.values()) for c in rows) / len(rows), Counter(w for c in rows for w in c)
    for shard in (8192, 30):
        index = bm25.build_index(d, shard=shard)
        got = {}
        for r in bm25.search(index, bm25.query_terms(d, index, F.col("doc_id") % 20 == 0, terms=None)).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.doc_id, round(r.score, 6)))
        assert sorted(got) == list(range(0, 120, 20))
        for q in got:
            assert len(rows[q]) > bm25.TERMS
            scored = sorted((-round(sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in sorted(rows[q]) if t in c), 9), j) for j, c in enumerate(rows))
            assert sorted(got[q]) == [(k + 1, j, round(-s, 6)) for k, (s, j) in enumerate(scored[:10])]


def test_ranges_equals_exhaustive():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, lists = 700, []
        for _ in range(40):
            p = np.sort(rng.choice(n, int(rng.integers(1, 300)), replace=False))
            s = rng.choice([0.5, 1.0, 30.0], len(p), p=[0.6, 0.39, 0.01])
            first = np.flatnonzero(np.diff(p // bm25.BLOCK, prepend=-1))
            lists.append((p, s, (p // bm25.BLOCK)[first], np.maximum.reduceat(s, first)))
        total = Counter()
        for p, s, _, _ in lists:
            for i, x in zip(p.tolist(), s.tolist(), strict=True):
                total[i] += x
        assert bm25.ranges(lists, n, 10) == sorted(((round(s, 9), i) for i, s in total.items()), key=lambda e: (-e[0], e[1]))[:10]


def test_bm25_index_and_floors(spark):
    """The index has a row per shard, and a shard returns all that reaches a query's floor and nothing below, copies and short queries included."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{int(j)}" for j in np.minimum(rng.zipf(1.2, int(rng.integers(5, 90))), 400)) + f" Own{i} é{i % 7}" for i in range(300)]
    texts[100:130] = [texts[40]] * 30
    index = bm25.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), shard=150).collect()
    assert [len(r.ids) // 8 for r in index] == [150, 150]
    shard = bm25.Shard(index[0].asDict(), 45.0)
    at, term, _, names = bm25.tally(pa.array([texts[i] for i in range(0, 150, 5)] + ["v1 v2", "nowhere"]))
    cut, idf = np.searchsorted(at, np.arange(33)), 1 + np.arange(len(names)) % 7 / 3
    weight, want = dict(zip(names.to_pylist(), idf.tolist(), strict=True)), []
    for q in [*(texts[i] for i in range(0, 150, 5)), "v1 v2", "nowhere"]:
        asked, best = sorted(set(bm25.words(q))), []
        for j in range(150):
            c = Counter(bm25.words(texts[j]))
            if got := [weight[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / 45.0)) for t in asked if t in c]:
                best.append((-round(sum(got), 9), j))
        want.append(sorted(best)[:10])
    for floor in (np.zeros(32), np.array([-w[min(3, len(w) - 1)][0] if w else 0.0 for w in want])):
        got = [[] for _ in want]
        for q, score, place in shard.pack(names, idf, term, cut, 10, floor.copy()):
            got[q].append((round(score, 6), place))
        assert [sorted(g) for g in got] == [sorted((round(-s, 6), j) for s, j in w if -s >= floor[q]) for q, w in enumerate(want)]


def test_bm25_runs_of_postings(spark, monkeypatch):
    """One look-up serves many packs, and however postings are cut into runs and places into ranges, a shard gives what brute force gives; a shard of empty texts gives nothing."""
    rng, looked, plain = np.random.default_rng(9), [], bm25.pc.index_in
    texts = [" ".join(f"{'abc'[i % 3]}{int(j)}" for j in np.minimum(rng.zipf(1.3, int(rng.integers(18, 160))), 300)) + f" own{i}" for i in range(200)]
    texts[50:62] = [texts[3]] * 12
    row = bm25.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).first().asDict()
    bags = [Counter(bm25.words(t)) for t in texts]
    monkeypatch.setattr(bm25.pc, "index_in", lambda *a, **b: [looked.append(1), plain(*a, **b)][1])
    for take, size in ((1, 7), (300, 64), (1 << 18, 256)):
        monkeypatch.setattr(bm25, "TAKE", take)
        monkeypatch.setattr(bm25, "RANGE", size)
        shard = bm25.Shard(row, 70.0)
        asked = [bm25.tally(pa.array([texts[i] for i in range(lo, 200, 20)])) for lo in (0, 3, 10)]
        looked.clear()
        at = shard.find(pa.concat_arrays([a[3] for a in asked]))
        for lo, (text, term, _, names) in zip((0, 3, 10), asked, strict=True):
            here, at = at[: len(names)], at[len(names) :]
            cut, idf = np.searchsorted(text, np.arange(11)), 0.5 + np.arange(len(names)) % 5 / 3
            weight = dict(zip(names.to_pylist(), idf.tolist(), strict=True))
            want = []
            for i in range(lo, 200, 20):
                scored = [(-round(sum(weight[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / 70.0)) for t in sorted(bags[i]) if t in c), 9), j) for j, c in enumerate(bags)]
                want.append(sorted(x for x in scored if x[0])[:10])
            for floor in (np.zeros(10), np.array([-w[4][0] for w in want])):
                got = [[] for _ in want]
                for q, score, place in shard.found(here, idf, term, cut, 10, floor.copy()):
                    got[q].append((round(score, 6), place))
                assert [sorted(g) for g in got] == [sorted((round(-s, 6), j) for s, j in w if -s >= floor[q]) for q, w in enumerate(want)]
        assert len(looked) == 1
    none = bm25.build_index(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string").coalesce(1)).first().asDict()
    assert list(bm25.Shard(none, 1.0).pack(pa.array(["a"]), np.ones(1), np.zeros(1, np.int32), np.array([0, 1]), 10, np.zeros(1))) == []


def test_bm25_memory_of_a_shard(spark):
    """A shard takes few bytes for each posting, while it is made, kept and searched; every shard has a file of its own, whatever task made it."""
    import tracemalloc

    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 30_000, 400)) for _ in range(1200)]
    index = bm25.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), shard=600)
    assert len(index.inputFiles()) == index.count() == 2
    row = index.first().asDict()
    at, term, _, names = bm25.tally(pa.array(texts[:300]))
    cut, postings = np.searchsorted(at, np.arange(301)), len(row["docs"]) // 4
    tracemalloc.start()
    shard = bm25.Shard(row, 400.0)
    kept, made = tracemalloc.get_traced_memory()
    tracemalloc.reset_peak()
    got = sum(1 for _ in shard.pack(names, np.ones(len(names)), term, cut, 10, np.zeros(300)))
    searched = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 3000
    assert kept < 36 * postings and made < 60 * postings and searched < kept + 20e6, (kept / postings, made / postings, searched)


def test_bpe_words_of_letters_skip_the_rule(monkeypatch):
    """Units of letters alone are words without a match of the splitting rule, and the ranks of pairs of bytes are looked up once; ids stay the library's."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain, asked = bpe.Codec(path), Tokenizer.from_file(path), []
    matches, ranked = own.split.findall, []
    monkeypatch.setattr(own, "split", type("Rule", (), {"findall": staticmethod(lambda t: [asked.append(t), matches(t)][1])}))
    monkeypatch.setattr(own, "rank", lambda a, b, f=own.rank: [ranked.append(a.ndim), f(a, b)][1])
    texts = ["Plain words Äpfel слово 東京語 ﬁn\nʰmodifier ªº", "it's don't x2 ² ½ a_b \u0301e ٣ \U00010400\U0001d7d8 \u2028x ǅ", "x" * 300 + " y" * 3, " ", "", "a  b \t c", "\u00a0nbsp \u3000wide"]
    assert [[int(i) for part, _, _ in x for i in part.split(",") if i] for x in own.encode_batch(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and not any(t.removeprefix(" ").isalpha() for t in asked if "  " not in t and "\t" not in t)
    assert 2 not in ranked


def test_open_strings_travel_together(spark, monkeypatch):
    """Rows on the way to the suffix sort do not multiply with its parts, and sorting a group share by share loses no repeat."""
    rng, seen, made = np.random.default_rng(8), [], suffix_dedup.arrow_map
    monkeypatch.setattr(suffix_dedup, "STRINGS", 2)
    monkeypatch.setattr(suffix_dedup, "arrow_map", lambda df, fn, schema: [out := made(df, fn, schema), schema == "part long, blob binary" and seen.append(out)][0])
    passages = ["".join(rng.choice(list("abcdefgh é"), 120)) for _ in range(40)]
    texts = ["".join(rng.choice(list("ijklmnop"), int(rng.integers(1, 40)))) + passages[i % 40][i % 7 : 90 + i % 29] + f"<{i}>" for i in range(200)]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    raw, first = [t.encode() for t in texts], {}
    for i, b in enumerate(raw):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in enumerate(raw):
        gone = {j for k in range(len(b) - 49) if first[b[k : k + 50]] < i for j in range(k, k + 50)}
        assert got[i] == bytes(x for j, x in enumerate(b) if j not in gone)
    blobs = [r.blob for r in seen[0].collect()]
    assert 12 * len(blobs) < sum(int.from_bytes(b[8:16], "little") // 8 for b in blobs)  # strings, by their ids


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 3])
def test_only_anchors_with_equal_sides_are_open(spark, monkeypatch, hot):
    """A short string that many documents share opens nothing; a passage that begins and ends anywhere in a window loses nothing."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    short = word(30)
    texts = [word(60) + short + word(60) for _ in range(60)]
    found = suffix_dedup.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2)
    assert found.filter("kind in (2, 3)").count() == 0 or hot == 3  # more in one batch than that go window by window unseen
    passage = word(120)
    texts += [word(i % 70) + passage[i : i + 50 + i % 5] + word(70 - i % 70) for i in range(70)] + [passage[i:] for i in range(0, 70, 9)]
    raw, first = [t.encode() for t in texts], {}
    for i, b in enumerate(raw):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, b in enumerate(raw):
        gone = {j for k in range(len(b) - 49) if first[b[k : k + 50]] < i for j in range(k, k + 50)}
        assert got[i] == bytes(x for j, x in enumerate(b) if j not in gone)


def test_windows_are_grouped_without_suffixes():
    rng = np.random.default_rng(10)
    rows = rng.integers(0, 256, (300, 50)).astype(np.uint8)[rng.integers(0, 300, 4000)]
    doc, at = rng.integers(0, 500, 4000), rng.integers(0, 900, 4000).astype("<u4")
    given = doc, doc + 1, at, np.full(4000, 50), rows.ravel()
    one, two = (sorted(zip(*(x.tolist() for x in f(*given)), strict=True)) for f in (suffix_dedup.group_windows, suffix_dedup.sort_share))
    assert one == two and len(one) > 3000


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_of_few_links_cost_the_driver_few_jobs(spark, monkeypatch, few):
    """Both ways: long chains, a star, a ring, negative ids, repeated links, links with null and with itself."""
    rng = np.random.default_rng(11)
    monkeypatch.setattr(components, "FEW", few)
    name = rng.permutation(900) - 300
    links = [(i, i + 1) for i in range(200)] + [(300, i) for i in range(301, 400)] + [(500 + i, 500 + (i + 1) % 50) for i in range(50)] + [(i, i + 1) for i in range(600, 800, 3)]
    rows = [tuple(map(int, name[list(x)])) for x in links] + [(None, 5), (7, 7), None, tuple(map(int, name[[0, 1]]))]
    rows = [x for x in rows if x]
    group = {int(n): int(n) for n in name}
    for _ in range(300):
        for a, b in rows:
            if a is not None:
                group[a] = group[b] = min(group[a], group[b])
    ends = {x for a, b in rows if a is not None and a != b for x in (a, b)}
    spark.sparkContext.setJobGroup(f"components{few}", "")
    got = [tuple(r) for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components{few}"))
    assert sorted(got) == sorted((x, group[x]) for x in ends)
    assert jobs < 12 if few else jobs > 20
    assert components.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_pipeline_sends_small_batches(spark, monkeypatch):
    """A split of the input goes to Python a few MB at a time, and a limit that the session has is left as it is."""
    key, made = "spark.sql.execution.arrow.maxBytesPerBatch", packing.arrow_map
    before = spark.conf.get(key, None)

    def watched(df, fn, schema):
        def run(it):
            def small():
                for batch in it:
                    assert batch.nbytes < 3 << 20, batch.nbytes
                    yield batch

            yield from fn(small())

        return made(df, run, schema)

    monkeypatch.setattr(packing, "arrow_map", watched)
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 600), F.col("id").cast("string")).alias("text"))
    try:
        spark.conf.unset(key)
        assert dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").agg(F.countDistinct("doc_id"), F.sum("length")).first()[0] == 4000
        spark.conf.set(key, "12345")
        common.small_batches(spark)
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)


def test_words_kept_by_the_encoder_are_few():
    """Words that never come again are forgotten after two generations; ids stay the library's."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = packing.WordEncoder(path), Tokenizer.from_file(path)
    for k in range(6):
        text = " ".join(f"q{chr(97 + k)}" + "".join(chr(97 + i // 26**j % 26) for j in range(4)) for i in range(60_000))
        got = own.encode(pa.array([text]))[0]
        assert len(own.parts) + len(own.old) < 330_000
    assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("head,run", [(10_003, "=" * 30_000), (9_993, "-" * 30_000), (20_005, "a" * 60_000), (10_003, "." * 30_000), (10_003, " " * 30_000), (16_389, "ab" * 20_000)])
def test_long_runs_behind_prose(head, run):
    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    prose = ("The quick brown fox jumps over the lazy dog, and 17 others watch it. " * 400)[:head]
    for text in (prose + run, prose + run + prose):
        assert c.encode_long(text).tolist() == c.model.encode(text)


def test_pii_form_fields_and_exhausted_formats(spark):
    """Blanks of a form are no secrets, and a format with all its forms in the text still gets surrogates."""
    for blank in ("Password: ________", "token: ......", "secret = ------"):
        assert pii.find(blank) == []
    t = [f"token: {chr(97 + i)}_____" for i in range(26)] + ["Password: ________"]
    got = {r.row.doc_id: r.new_text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), b"k").collect()}
    assert got[26] == t[26] and len(set(got.values())) == 27 and not set(t[:26]) & set(got.values())


def test_pii_longer_forms():
    full = pii.ATTEMPTS + 1
    for kind, mention, canonical in [("email", "A@b.cc", "a@b.cc"), ("phone", "+1 (386) 555-3733", "3865553733"), ("ssn", "123-45-6789", "123456789"), ("card", "4111 1111 1111 1111", "4111111111111111"), ("ip", "8.8.8.8", "8.8.8.8"), ("secret", "a_____", "a_____")]:
        new = {pii.surrogate(b"k", kind, canonical, full + i) for i in range(300)}
        assert len(new) == 300 and canonical not in new
        shown = {pii.render(mention, kind, canonical, n) for n in new}
        assert len(shown) == 300 and (kind != "card" or all(map(pii.luhn, new)))


@pytest.mark.parametrize(
    "text,want",
    [
        ("x 2123465659789240 y", [("2123465659789240", "card")]),
        ("9807 9157 6280 4490.", [("9807 9157 6280 4490", "card")]),
        ("386-555-3733 2024", [("386-555-3733", "phone")]),
        ("555-123-4567 10115", [("555-123-4567", "phone")]),
        ("12 4111 1111 1111 1111", [("4111 1111 1111 1111", "card")]),
        ("2024 4111 1111 1111 1111", [("4111 1111 1111 1111", "card")]),
        ("386-555-3733 4111 1111 1111 1111", [("386-555-3733", "phone"), ("4111 1111 1111 1111", "card")]),
        ("1234567890123 or a@b.cc", [("a@b.cc", "email")]),
    ],
)
def test_pii_cards_and_what_looks_like_them(text, want):
    assert [(text[s:e], k) for s, e, k, _ in pii.find(text)] == want


def brute_kernel(a, b):
    """All pairs of equal subsequences, each weighed by the letters that it spans in both strings."""
    spans = Counter()
    for x, y in ((x, y) for x in combinations(range(len(a)), toxicity.LENGTH) for y in combinations(range(len(b)), toxicity.LENGTH)):
        if all(a[i] == b[j] for i, j in zip(x, y, strict=True)):
            spans[x[-1] - x[0] + y[-1] - y[0] + 2] += 1
    return sum(n * toxicity.DECAY**k for k, n in spans.items())


def test_kernel_equals_all_subsequences():
    rng = np.random.default_rng(7)
    for _ in range(25):
        words = ["".join(rng.choice(list("abc"), int(rng.integers(1, 10)))) for _ in range(4)]
        other = "".join(rng.choice(list("abcd"), int(rng.integers(1, 9))))
        got = toxicity.kernel(toxicity.coded(words, 10), np.array([ord(c) for c in other], np.uint32))
        assert np.allclose(got, [brute_kernel(w, other) for w in words], rtol=1e-5, atol=1e-12)


def test_long_token_counts_by_its_best_run():
    """An insult with letters put in is found at every place of a token of any length, across the 4,096 runs of a block too."""
    m = toxicity.Model(["blockhead"], np.ones(1), 0.0, 1.0, 0.0)
    insult = "b-l-o-c-k-h-e-a-d"
    alone = m.features([insult])[0, 0]
    assert alone > 0
    for before in (0, 1, 11, 12, 13, 23, 4070, 4085, 4096):
        for after in (0, 9, 30):
            word = "x" * before + insult + "y" * after
            assert np.isclose(m.features([word])[0, 0], alone, rtol=1e-5)
            assert np.isclose(m.features([word])[0, 0], max(m.features([word[i : i + toxicity.WIDE]])[0, 0] for i in range(max(1, len(word) - toxicity.WIDE + 1))) if before < 100 else alone, rtol=1e-5)

import itertools
import random
import re
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from conftest import SMALL, compare
from pyspark.sql import functions as F

from tributary.functions.text import dup_key
from tributary.llm import queries
from tributary.llm.abuse import AbuseScores, Levenshtein, Reader, Trie, fit
from tributary.llm.bpe import TOKENIZERS, Transducer, Utf8Stream, decode_corpus, encode_corpus, read_ranks
from tributary.llm.components import components
from tributary.llm.distinct import DistinctRuns, RunStore, decode, encode, union
from tributary.llm.formats import FIELDS, FormatCopies, payload_records
from tributary.llm.leaks import EDITED, LeakSearch, align, align_all
from tributary.llm.neardup import NearDuplicates, most_differing_bits, prob_minhash
from tributary.llm.reservoir import ReservoirStore, WindowReservoir, draw, evict
from tributary.llm.seen import GolombSet, SeenKeys, SetStack
from tributary.operators.blocks import block_pairs

T = datetime(2020, 1, 1, 10)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, oracle, name):
    compare(spark, oracle, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", ["p1_groups", "p7_rates", "p9_scores", "p10_rates"])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


# --- 1


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 90, dtype=np.uint64)
    a, b = pool[:60], pool[30:]
    wa, wb = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    signed = prob_minhash(np.concatenate([a, b, a]), np.array([0, 60, 120, 180]), 4000, np.concatenate([wa, wb, wa * 2]))
    full_a, full_b = np.zeros(90), np.zeros(90)
    full_a[:60], full_b[30:] = wa, wb
    want = sum(1 / np.maximum(full_a / x, full_b / y).sum() for x, y in zip(full_a, full_b) if x and y)
    assert abs((signed[0] == signed[1]).mean() - want) < 0.03
    assert (signed[0] == signed[2]).all()
    plain = prob_minhash(np.concatenate([a, b]), np.array([0, 60, 120]), 4000)
    assert abs((plain[0] == plain[1]).mean() - 1 / 3) < 0.03


def test_bits_keep_similar_pairs():
    """Of pairs at the threshold the comparison of 64 bits drops fewer than one in ten thousand."""
    rng, n = np.random.default_rng(2), 20_000
    same = rng.random((n, 64)) < 0.8
    differ = (~same & (rng.random((n, 64)) < 0.5)).sum(axis=1)
    assert (differ > most_differing_bits(0.8)).mean() < 1e-4 and most_differing_bits(0.8) < 20


def texts_like(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    rng.shuffle(words)
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark, make_reviews):
    rng = random.Random(2)
    rows, bases = [], [" ".join(f"w{rng.randrange(400)}x" for _ in range(50)) for _ in range(25)]
    for i in range(250):
        rows.append({"review_id": f"r{i}", "text": texts_like(rng, rng.choice(bases), rng.choice([0, 0, 1, 3, 5, 8]))})
    rows += [{"review_id": None, "text": bases[0]}, {"review_id": "n", "text": None}, {"review_id": "e", "text": ""}, {"review_id": "s", "text": "too few words"}, {"review_id": "s2", "text": "too few words"}, {"review_id": "r1", "text": rows[1]["text"]}]
    sets = {r["review_id"]: {t for t in r["text"].split() if len(t) >= 3} for r in rows if r["review_id"] and r["text"]}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 12 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    found = NearDuplicates(make_reviews(rows))
    got = {tuple(r) for r in found.pairs().collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in got:
        root[max(top(a), top(b))] = min(top(a), top(b))
    members = {x for p in got for x in p}
    assert {(r.id, r.group_id) for r in found.groups().collect()} == {(x, top(x)) for x in members}


def test_near_duplicates_of_nothing(make_reviews):
    assert NearDuplicates(make_reviews([])).pairs().count() == 0
    assert NearDuplicates(make_reviews([{"text": "a"}])).groups().count() == 0


def test_blocks_give_each_pair_once(spark):
    df = spark.range(300).selectExpr("id % 2 g", "id m", "id * 2 c").union(spark.createDataFrame([(9, 1, 1)], "g long, m long, c long"))
    got = [tuple(r) for r in block_pairs(df, ["g"], "m", ["c"], block=16).collect()]
    assert len(got) == len(set(got)) == 2 * 150 * 149 // 2
    assert all(a < b and ca == 2 * a and cb == 2 * b for _, a, b, ca, cb in got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# --- 2


def test_runs_merge(spark, make_reviews):
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 40, 70_000):
        v = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
        assert np.array_equal(decode(encode(v)), v)
    parts = [np.unique(rng.integers(0, 1000, 300, dtype=np.uint64)) for _ in range(5)]
    assert np.array_equal(union(parts), np.unique(np.concatenate(parts)))
    rows = [{"user_id": f"u{i % 300}", "business_id": None if i % 7 == 0 else f"b{i % 3}"} for i in range(3000)] + [{"user_id": None, "business_id": "b0"}]
    df = make_reviews(rows)
    runs = DistinctRuns.build(df, {"business_id": F.col("business_id")}, "user_id")
    want = {b: len({r["user_id"] for r in rows if r["business_id"] == b and r["user_id"]}) for b in {r["business_id"] for r in rows[:-1]}}
    assert {r.business_id: r.distinct_users for r in runs.counts().collect()} == want
    groups = spark.createDataFrame([("x", "b0"), ("x", "b1"), ("y", "b2")], "combo string, business_id string")
    assert {r.combo: r.distinct_users for r in runs.regroup(groups, ["combo"]).counts().collect()}["x"] == len({r["user_id"] for r in rows if r["business_id"] in ("b0", "b1") and r["user_id"]})
    assert DistinctRuns.build(make_reviews([]), {"business_id": F.col("business_id")}, "user_id").regroup(None, ["business_id"]).counts().count() == 0


def test_long_runs_are_cut(spark):
    """Groups beyond SHARD hashes are cut into shards, when they are built and when smaller ones are merged to one."""
    build = lambda a, b: DistinctRuns.build(spark.range(a, b).selectExpr("id % 2 g", "id u"), {"g": F.col("g")}, "u")
    first = build(0, 600_000)
    assert first.runs.select("shard").distinct().count() == 4 and first.runs.agg(F.max("n")).first()[0] <= 65_536
    both = DistinctRuns(first.runs.union(build(500_000, 700_000).runs), ["g"])
    assert sorted(r.distinct_users for r in both.regroup(None, ["g"]).counts().collect()) == [350_000, 350_000]
    one = both.regroup(spark.createDataFrame([(0, "x"), (1, "x")], "g long, c string"), ["c"])
    assert one.runs.select("shard").distinct().count() == 8 and one.counts().first().distinct_users == 700_000


def test_runs_are_stored(spark, make_reviews, tmp_path):
    by, path, rng = {"business_id": F.col("business_id")}, f"file://{tmp_path}/runs", random.Random(3)
    rows = [{"user_id": f"u{rng.randrange(90)}", "business_id": rng.choice(["a", "b", None])} for _ in range(400)]
    for k in range(4):
        for _ in range(2 if k in (0, 3) else 1):
            RunStore(spark, by, "user_id", path).add(make_reviews(rows[k * 100 : k * 100 + 100]), k)
    store = RunStore(spark, by, "user_id", path)
    assert sorted(b for t in store.state["tables"] for b in t["batches"]) == ["0", "1", "2", "3"] and len(store.state["tables"]) < 4
    assert sorted(t["name"] for t in store.state["tables"]) == sorted(p.name for p in (tmp_path / "runs").iterdir() if p.name != "manifest")
    got = {r.business_id: r.distinct_users for r in store.runs().regroup(None, ["business_id"]).counts().collect()}
    assert got == {b: len({r["user_id"] for r in rows if r["business_id"] == b}) for b in ("a", "b", None)}


# --- 3


def test_reservoir_is_uniform():
    """Each record of windows that grow in several runs is drawn equally often: chi-square over 4000 draws, also given the slot."""
    rng, k, runs = np.random.default_rng(4), 4, 4000
    pieces = [{"a": [3, 2], "b": [1, 0]}, {"c": [2, 4]}, {"d": [0, 1], "e": [3, 3]}]
    counts = Counter()
    for _ in range(runs):
        held, seen = [[], []], 0
        for run in pieces:  # each goes on from what is stored
            for piece, ins, out in draw(run, k, rng, seen, [len(h) for h in held]):
                for s in range(2):
                    evict(held[s], out[s], rng)
                    chosen = rng.choice(run[piece][s], ins[s], replace=False)
                    held[s] += [(piece, s, int(i)) for i in chosen]
                seen += sum(run[piece])
        assert len(held[0]) + len(held[1]) == k
        counts.update(x for h in held for x in h)
    total = sum(map(sum, (c for run in pieces for c in run.values())))
    expected = runs * k / total
    # a sample without replacement varies less than independent draws: the statistic over (1 - k / total) has total - 1 degrees
    chi = sum((counts[x] - expected) ** 2 / expected for run in pieces for p, c in run.items() for s in range(2) for x in ((p, s, i) for i in range(c[s]))) / (1 - k / total)
    assert len(counts) == total and chi < 45.0  # 19 degrees: one in two thousand


def test_samples_are_stored(spark, make_reviews, tmp_path):
    path, rng = f"file://{tmp_path}/samples", random.Random(5)
    rows = [{"review_id": f"r{rng.randrange(150)}", "event_time": T + timedelta(minutes=rng.randrange(3), days=rng.randrange(2)), "ingest_time": T + timedelta(hours=i)} for i in range(180)]
    for b in range(3):
        for _ in range(1 + b % 2):
            ReservoirStore(spark, path, k=10, slots=3).process(make_reviews(rows[b * 60 : b * 60 + 60]), b)
    first = {}
    for r in rows:
        first.setdefault(r["review_id"], r["event_time"])
    sizes, got = Counter(first.values()), ReservoirStore(spark, path, k=10, slots=3).sample().collect()
    assert Counter(r.window_start for r in got) == {w: min(10, n) for w, n in sizes.items()}
    assert all(first[r.id] == r.window_start and r.seen == sizes[r.window_start] for r in got) and len({r.id for r in got}) == len(got)
    assert ReservoirStore(spark).sample().count() == 0


def test_reservoir_samples(make_reviews):
    rows = [{"review_id": f"r{i}", "ingest_time": T + timedelta(hours=i // 100), "event_time": T} for i in range(600)]
    rows += [{"review_id": f"s{i}", "event_time": T + timedelta(minutes=1)} for i in range(5)] * 2 + [{"review_id": None}, {"review_id": "x", "event_time": None}]
    hits = Counter()
    for seed in range(4):
        got = WindowReservoir(make_reviews(rows), "review_id", "event_time", "ingest_time", k=60, slots=3, seed=seed).sample().collect()
        assert Counter(r.window_start for r in got) == {T: 60, T + timedelta(minutes=1): 5}
        assert len({r.id for r in got}) == 65
        hits.update(int(r.id[1:]) // 100 for r in got if r.id[0] == "r")
    assert all(18 <= hits[k] <= 66 for k in range(6))
    assert WindowReservoir(make_reviews([]), "review_id", "event_time", "ingest_time").sample().count() == 0


# --- 5


def test_format_copies(spark, make_reviews):
    rows = [("a", "U 1", "B", "Hello, World!"), ("b", "u1", "b.", "hello world"), ("c", "u1", "b", "HELLO world "), ("d", "u1", "b", "hello worlds"), ("e", "u1", "b", "?!"), ("f", None, "b", "hello world"), (None, "u1", "b", "hello world"), ("g", "u1", "b", None), ("a", "U1", "B", "hello-world"), ("é", "u1", "b", "Ça va"), ("h", "u1", "b", "ça VA")]
    found = FormatCopies(make_reviews([dict(zip(FIELDS, r)) for r in rows]))
    assert {tuple(r) for r in found.pairs().collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("h", "é")}
    assert sorted(r.copies for r in found.counts().collect()) == [1, 2, 4]
    assert found.collisions().count() == 0
    assert FormatCopies(make_reviews([])).pairs().count() == 0


def test_payloads(spark):
    good = '{"text": "t", "review_id": "r", "stars": 2, "business_id": "b", "more": [1], "user_id": "u"}'
    df = spark.createDataFrame([(x,) for x in (good, good[:-1], good + "x", "[]", "", None, "7", '{"review_id": "q"}')], "payload string")
    assert sorted((r.review_id, r.text) for r in payload_records(df).collect()) == [("q", None), ("r", "t")]


def test_payloads_in_json_white_space(spark):
    df = spark.createDataFrame([('\n\t {"review_id": "r"}\r\n ',), ('\n{"review_id": "s"}x\n',), ('{"review_id": "t"}\t',), ('\u00a0{"review_id": "u"}',)], "payload string")
    assert sorted(r.review_id for r in payload_records(df).collect()) == ["r", "t"]


# --- 7


def test_golomb_sets():
    rng = np.random.default_rng(5)
    for n, span in ((0, 16), (1, 1 << 20), (128, 1 << 16), (129, 1 << 40), (4000, 1 << 13)):
        v = np.unique(rng.integers(0, span, n, dtype=np.uint64))
        g, probes = GolombSet(v, span), np.concatenate([rng.integers(0, span, 2000, dtype=np.uint64), v])
        assert np.array_equal(g.values(), v) and np.array_equal(g.contains(probes), np.isin(probes, v))
    for n in (20_000, 400_000):
        stack, every = SetStack(1 << 30), np.unique(rng.integers(0, 1 << 30, n, dtype=np.uint64))
        held = []
        for part in np.array_split(rng.permutation(every), 20):
            for piece in np.array_split(np.sort(part), 3):
                stack.add(piece)
            assert not stack.contains(part).all()
            stack.close()
            held.append(part)
            assert stack.contains(part).all() and stack.contains(held[0]).all()
        assert stack.n() == len(every) and len(stack.sets) < 8 and len(stack.plain) < 4096
        foreign = np.setdiff1d(rng.integers(0, 1 << 30, 5000, dtype=np.uint64), every)
        assert not stack.contains(foreign).any()
        assert stack.size() < n * (3.2 if n < 100_000 else 1.9)


def test_seen_keys(make_reviews):
    rng = random.Random(6)
    rows = [{"review_id": None if rng.random() < 0.1 else f"r{rng.randrange(200)}", "text": "hot" if rng.random() < 0.3 else f"t{rng.randrange(150)}", "ingest_time": T + timedelta(minutes=rng.randrange(60))} for _ in range(400)] + [{"text": None, "review_id": "n1"}, {"text": "", "review_id": "n2"}]
    df = make_reviews(rows)
    ordered = sorted(rows, key=lambda r: (r["ingest_time"] if "ingest_time" in r else T + timedelta(minutes=5), r["review_id"] is not None, r["review_id"] or ""))
    met, want = set(), set()
    for r in ordered:
        k = r["text"] or ""
        if k in met and r["review_id"]:
            want.add(r["review_id"])
        met.add(k)
    seen = SeenKeys(df, dup_key(F.col("user_id"), F.col("business_id"), F.col("text")), fp_bits=3)
    assert {r.id for r in seen.found().collect()} == want
    rates = seen.rates().collect()
    assert want <= {r.id for r in seen.answers().collect()}
    assert sum(r.n_rows for r in rates) == 402 and all(0 <= (r.audited_fp_rate or 0) <= 1 for r in rates)
    assert SeenKeys(make_reviews([]), F.col("text")).found().count() == 0


# --- 8


def test_transducer_equals_the_definition():
    import tiktoken

    from tributary.llm.bpe import PATTERN

    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        ranks = read_ranks(Path(TOKENIZERS, f"{name}.tiktoken").read_bytes())
        mine, theirs = Transducer(ranks, memo=3000), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        rng = random.Random(7)
        alphabets = ["abcdefghij klmnop", "ab", "éü漢字かな🙂‍ \n\t\x1c\x85", "0123456789.,!?<|endoftext|>", "'s're've _-=*#", "ACGT"]
        for _ in range(1500):
            text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(80)))
            assert mine.encode(text) == theirs.encode_ordinary(text), repr(text)


def test_encoding_and_decoding(spark):
    texts = ["a", None, "", "<|endoftext|>", "naïve 漢字 🙂", "x" * 200_000, "\n\n  \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    encoded = encode_corpus(df)
    got = {r.id: r.ids for r in encoded.collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[3] and len(got) == 7
    assert {r.id: r.text for r in decode_corpus(encoded, id="id").collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0)).count() == 0


def test_utf8_stream():
    data = "aé漢🙂".encode() + b"\xff\xe6\x41\xf0\x9f" + "é".encode()
    for cut in range(1, 6):
        s = Utf8Stream()
        assert "".join([*(s.feed(data[i : i + cut]) for i in range(0, len(data), cut)), s.close()]) == data.decode("utf-8", "replace")


# --- 9


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)] + ["", None, "w1 w2 w3"]
    docs = []
    for i in range(80):
        text = [rng.choice(words) for _ in range(rng.randrange(80))]
        if i % 2:
            source, n = rng.choice(items[:12]).split(), rng.randrange(8, 20)
            start = rng.randrange(len(source) - n)
            text[10:10] = source[start : start + n]
        docs.append(" -".join(text).upper() if i % 3 else ", ".join(text))
    docs += [None, "", items[0], items[0] + " " + items[0]]
    runs = lambda t, n: {tuple(w[i : i + n]) for w in [(t or "").lower().replace(",", " ").replace("-", " ").split()] for i in range(len(w) - n + 1)}
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if runs(t, 12) & runs(x, 12)}
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("gram", F.lit(1))
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bits in (29, 15):
        got = LeakSearch(d, i, most_bits=bits).alignments().collect()
        assert {(r.doc_id, r.item_id) for r in got if r.run >= 12} == want
    assert {r.doc_id: r.score for r in got if r.item_id == 0}[82] == 1.0
    assert LeakSearch(d.limit(0), i).alignments().count() == 0 and LeakSearch(d, i.limit(0)).alignments().count() == 0


def test_alignment_equals_the_plain_recurrence():
    rng = random.Random(9)
    for _ in range(40):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        longest = max(k for i in range(len(a)) for j in range(len(b)) for k in range(26) if a[i : i + k] == b[j : j + k] and i + k <= len(a) and j + k <= len(b))
        assert align(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == (max(map(max, h)), longest)
    assert align(np.array([1], dtype=np.uint64), np.array([], dtype=np.uint64)) == (0, 0)


def test_leaks_of_items_that_repeat_an_id(spark):
    """The other text's n-grams are in fewer documents, so they would be the seeds of mixed windows."""
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    leak = " ".join(texts[0].split()[20:32])
    docs = spark.createDataFrame([(0, leak), (1, texts[0])], "doc_id long, text string")
    items = spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")
    assert {(r.doc_id, r.run) for r in LeakSearch(docs, items).alignments().collect()} == {(0, 12), (1, 60)}


def test_many_alignments_equal_single_ones():
    rng = random.Random(12)
    for _ in range(60):
        item = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 30))], dtype=np.uint64)
        docs = [np.array([rng.randrange(12) for _ in range(rng.choice((0, 3, 40)))], dtype=np.uint64) for _ in range(rng.randrange(1, 20))]
        assert list(zip(*align_all(item, docs))) == [align(item, d) for d in docs]
    long = np.arange(40_000, dtype=np.uint64)
    assert align_all(long[:20], [long, long[10:], long[:0]]) == ([40, 20, 0], [20, 10, 0])


def test_edited_copies_are_scored(spark):
    """Every seventh word changed, so that no twelve words in a row are left, also beside exact copies."""
    item = [f"w{i}" for i in range(60)]
    edited = ["x" + w if i % 7 == 3 else w for i, w in enumerate(item)]
    texts = [item, item, edited, item[20:26], item[20:24], [f"v{i}" for i in range(60)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for sent in (1_000_000, 5):
        got = {r.doc_id: (round(r.score, 6), r.run) for r in LeakSearch(docs, items, sent=sent).alignments(edited=True).collect()}
        assert got == {0: (1.0, 60), 1: (1.0, 60), 2: (round((2 * 51 - 8) / 120, 6), 6), 3: (0.1, 6)}
    assert LeakSearch(docs, items.limit(0)).alignments(edited=True).count() == LeakSearch(docs.limit(0), items).alignments(edited=True).count() == 0


def test_recall_of_edited_copies(spark):
    """A copy of each item among its document's other words, with words replaced at random or at regular places; foreign items are no case."""
    rng, items = random.Random(13), [r.text for r in spark.read.parquet(f"{SMALL}/eval_items.parquet").orderBy("item_id").collect()]
    words = [re.findall(r"[^\W_]+", t.lower()) for t in items]
    every = sorted({w for t in words for w in t})
    edits = {"one in ten": lambda i: rng.random() < 0.1, "two in ten": lambda i: rng.random() < 0.2, "three in ten": lambda i: rng.random() < 0.3, "every eighth": lambda i: i % 8 == 3, "every fifth": lambda i: i % 5 == 3}
    rows, told = [], {}
    for name, edit in edits.items():
        for k, t in enumerate(words):
            own = [rng.choice(every) if edit(i) else w for i, w in enumerate(t)]
            around = [[rng.choice(every) for _ in range(60)] for _ in range(2)]
            told[len(rows)] = (name, k)
            rows.append((len(rows), " ".join([*around[0], *own, *around[1]])))
    found = LeakSearch(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.alignments(edited=True).collect() if r.score >= EDITED}
    recall = {name: sum((d, k) in got for d, (n, k) in told.items() if n == name) / len(items) for name in edits}
    print(recall, len(got))
    assert all(recall[n] >= 0.9 for n in ("one in ten", "two in ten", "every eighth")), recall
    assert sum(told[d][1] == k for d, k in got) >= 0.98 * len(got)


# --- 10


def test_automata_equal_edit_distance():
    rng = random.Random(10)

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j] + 1, d[-1] + 1, p[j - 1] + (x != y and x != "*")))
        return d[-1]

    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(40)})
    trie = Trie(terms)
    for _ in range(400):
        w, k = "".join(rng.choice("abcd*") for _ in range(rng.randrange(1, 9))), rng.randrange(3)
        assert Levenshtein(w, k).search(trie) == min(((distance(w, t), t) for t in terms if distance(w, t) <= k), default=None)


def test_spellings():
    reader = Reader(["idiot", "moron", "dickhead", "fuck"], {"idioma"})
    for text in ("1d10t", "idi0t", "i.d.i.o.t", "i d i o t", "iiiidiot", "id​iot", "іdіоt", "IDIOT", "idoit"[:3] + "ot", "idiiot", "dikhead", "d*ckhead", "f**k"):
        assert any(f.startswith("t:") for w in reader.windows(f"you {text} there") for f in w), text
    assert any(f.startswith("t:motherf") for w in Reader(["motherfuckingbastardsofhell"], set()).windows("you motherfukingbastardsofhell there") for f in w)
    assert reader.windows("el idioma") == [] and reader.windows("*** $5 !!") == []


def test_context_decides(spark):
    rng = random.Random(11)
    names = ["table", "soup", "garden", "waiter", "bread", "lamp"]
    bad = [f"You are an idiot and your {rng.choice(names)} knows it. The {rng.choice(names)} was fine." for _ in range(60)]
    good = [f"An idiot-proof menu for my {rng.choice(names)}. The {rng.choice(names)} was fine." for _ in range(60)]
    model = fit(bad + good, np.array([1.0] * 60 + [0.0] * 60))
    assert model.terms
    texts = bad[:5] + good[:5] + ["", None, "nothing here", "You are an id1ot and your cat knows it"]
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(bad + good + texts)], "doc_id long, text string, source string").withColumn("id", F.lit(0)).withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    scores = {r.id - 120: r.score for r in AbuseScores(docs, labels).scores().collect()}
    assert all(scores[i] > 0.5 for i in range(5)) and all(scores[i] < 0.5 for i in range(5, 10))
    assert scores[10] == scores[11] == 0 and scores[13] > 0.5
    assert {r.source for r in AbuseScores(docs, labels).rates().collect()} == {"s", None}
    twice = docs.union(docs.where("doc_id < 50"))
    assert AbuseScores(twice, labels, characters=3000).scores().count() == twice.count()
    assert AbuseScores(docs, labels.limit(0)).scores().count() == len(bad + good + texts)
    assert AbuseScores(docs.limit(0), labels).scores().count() == 0


def test_held_out_accuracy(spark):
    """Labels of the medium tables, every second document held out; readers err in about one label of eight."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    held = docs.where(half == 1)
    scores = {r.id: r.score for r in AbuseScores(docs, labels.where(half == 0)).scores().collect()}
    truth = {r.doc_id: r.y for r in labels.groupBy("doc_id").agg(F.avg("toxic").alias("y")).collect()}
    rows = [(scores[r.doc_id] >= 0.5, truth[r.doc_id] == 1) for r in held.select("doc_id").collect() if truth[r.doc_id] in (0, 1)]
    hits = sum(p and t for p, t in rows)
    assert hits / sum(p for p, _ in rows) > 0.6 and hits / sum(t for _, t in rows) > 0.6

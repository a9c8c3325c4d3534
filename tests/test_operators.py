import math
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tributary.config import BloomConfig, LSHConfig
from tributary.functions.text import dup_key, keyword_matches, tokens
from tributary.operators import distinct, duplicates, lsh, reports
from tributary.operators.dgim import Buckets
from tributary.sources import reviews as sources
from tributary.sources import sinks

T = datetime(2020, 1, 1, 10)


def test_settings_fall_back():
    env = {"BLOOM_CAPACITY": "5", "BLOOM_ERROR_RATE": "no", "LSH_BUG_KEYWORDS": "a, B,", "LSH_FILTER_BUG_REVIEWS": "off", "LSH_NUM_PERM": " "}
    assert BloomConfig.from_env(env) == BloomConfig(capacity=5)
    got = LSHConfig.from_env(env)
    assert got.bug_keywords == ["a", "b"] and not got.filter_bug_reviews and got.num_perm == 128


def test_keys_and_words(spark):
    df = spark.createDataFrame([("u", "b", "  A\tb  C "), (None, "b", None), ("u", "b", "a-b")], "u string, b string, t string")
    got = [r[0] for r in df.select(dup_key(F.col("u"), F.col("b"), F.col("t"))).collect()]
    assert got == ["u||b||a b c", "||b||", "u||b||a-b"]
    one = spark.createDataFrame([("Buggy bugs slow crashing",)], "t string")
    assert one.select(keyword_matches(F.col("t"), LSHConfig().bug_keywords)).first()[0] == ["bug", "crash", "slow"]
    assert one.select(tokens(F.lit("The the a1b ab"))).first()[0] == ["the", "a1b"]


def test_messages(spark):
    good = '{"review_id": "r", "user_id": "u", "business_id": "b", "stars": 4, "text": null, "date": "2020-01-01 10:00:00"}'
    rows = [good, good[:-5], "", None, "[]", good.replace('"stars": 4, ', ""), good.replace("2020", "soon"), good.replace('"b"', "null")]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = sources.parse_messages(df).collect()
    assert len(got) == 1 and got[0].event_time == T and got[0].stars == 4 and got[0].ingest_time is not None


def test_files(spark, tmp_path):
    df = spark.range(30).selectExpr("cast(id as string) review_id", "'u' user_id", "'b' business_id", "1.0 stars", "'t' text", "'2020-01-01' event_time", "cast(null as string) date")
    sinks.write_json_lines(df.coalesce(1), str(tmp_path / "j"))
    assert sources.json_lines(spark, str(tmp_path / "j"), 5).count() == 5
    assert sources.head_lines(spark, str(tmp_path / "j"), 7).count() == 7
    assert sources.sample_lines(spark, str(tmp_path / "j"), 7).count() == 7
    assert sinks.append_counted(df, str(tmp_path / "p")) == 30
    assert sources.recent_files(spark.read.parquet(str(tmp_path / "p")), 100).count() == 30
    for i in range(3):
        spark.range(1).selectExpr(f"{i} x").coalesce(1).write.mode("append").parquet(str(tmp_path / "files"))
        time.sleep(1.1)
    assert sorted(r.x for r in sources.recent_files(spark.read.parquet(str(tmp_path / "files")), 2).collect()) == [1, 2]
    (tmp_path / "bad.json").write_text('{"stars": 1}\n{"stars"\n')
    assert sources.json_lines(spark, str(tmp_path / "bad.json")).count() == 2
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|ailfast"):
        sources.json_lines(spark, str(tmp_path / "bad.json"), strict=True).collect()
    assert sources.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(ValueError, match="nope"):
        sources.read_batch(spark, str(tmp_path / "p"), required=["nope", "stars"])
    sent = []
    assert sinks.replay(df.limit(3), sent.append, rows_per_second=0) == 3 and '"review_id"' in sent[0]
    sinks.append_counted(df, str(tmp_path / "d/bronze_reviews"))
    sinks.append_counted(df.limit(0), str(tmp_path / "d/metrics_1m"))
    taken = []
    told = sinks.load_all(spark, str(tmp_path / "d"), lambda d, n: taken.append(n), {n: n for n in ("bronze_reviews", "metrics_1m", "other")})
    assert taken == ["bronze_reviews"] and told == {"bronze_reviews": "loaded", "metrics_1m": "empty", "other": "missing"}
    assert len(sinks.REPORTED) == 14 and sinks.REPORTED["gold_dup_rate_1m_high_rated"] == "dup_rate_1m_high_rated" and "bronze_reviews" not in sinks.REPORTED
    assert reports.storage_report(spark, str(tmp_path)).where("size_bytes > 0").count() >= 2


def test_bloom_has_no_false_negatives(spark, make_reviews):
    assert duplicates.bloom_size(200_000, 0.01) == (1_917_012, 7)
    df = make_reviews([{"review_id": f"r{i}", "text": f"t{i % 40}", "ingest_time": T + timedelta(seconds=i)} for i in range(100)] + [{"text": None}, {"text": None}])
    rows = duplicates.keyed_rows(df)
    exact, bloom = (f(rows).agg(F.sum("dups")).first()[0] for f in (duplicates.exact_flags, lambda r: duplicates.bloom_flags(r, 200, 0.01)))
    assert exact == 61 and exact <= bloom <= exact + 3
    with pytest.raises(ValueError):
        duplicates.inject_duplicates(df, -1)
    assert duplicates.inject_duplicates(df, 0) is df


def test_bloom_error_rate_holds_beyond_the_reference_capacity(spark):
    rows = spark.range(600_000).selectExpr("unhex(md5(id::string)) dup_key", "id at", "id::string review_id", "timestamp_ntz '2020-01-01' window_start", "1l n")
    assert duplicates.bloom_flags(rows).agg(F.sum("dups")).first()[0] <= 6_000


def test_fm_drops_or_keeps_empty_sketches(make_reviews):
    df = make_reviews([{"user_id": f"u{i}", "ingest_time": T + timedelta(minutes=i)} for i in range(80)] + [{"user_id": None}])
    assert distinct.fm_windows(df).count() == 80
    kept = distinct.fm_windows(df, emit_zero=False).count()
    assert 70 <= kept < 80
    assert distinct.fm_windows(df, exact_below=1).where("distinct_users_exact is null and error_percent is null").count() == 80


def test_dgim_error_and_expiry():
    for pattern in (lambda i: 1, lambda i: i % 2, lambda i: int(i < 300)):
        state, ones = Buckets(100), []
        for i in range(1000):
            (state.add if pattern(i) else state.advance)(i)
            ones += [i] * pattern(i)
            exact = sum(t >= i - 100 for t in ones)
            assert abs(state.estimate() - exact) <= exact / 2
        sizes = [s for _, s in state.buckets]
        assert all(sizes.count(s) <= 2 for s in sizes)
    assert Buckets(10, earliest=True).estimate() == 0


def test_noise(spark):
    counts = spark.range(2000).selectExpr("cast(id as string) similar_review_id", "'b' similar_business_id", "5L exact_frequency")
    with pytest.raises(ValueError):
        lsh.noisy_frequencies(counts, 0)
    noise = [r[0] for r in lsh.noisy_frequencies(counts, 0.5, 1.0, 42).selectExpr("noisy_frequency - 5").collect()]
    assert abs(sum(noise) / 2000) < 0.3 and 1.7 < sum(map(abs, noise)) / 2000 < 2.3
    assert all(math.isfinite(x) for x in noise)


def test_pairs_and_summary(make_reviews):
    words = " ".join(f"word{i}" for i in range(40)) + " bug"
    df = make_reviews([{"review_id": "a", "text": words}, {"review_id": "b", "text": words, "stars": 1.0, "event_time": T + timedelta(hours=1)}, {"review_id": "c", "text": "bug only"}, {"review_id": "d", "text": ""}, {"review_id": "e", "text": words, "stars": 5.0}, {"review_id": None, "text": words}, {"review_id": "f", "text": None}])
    config = LSHConfig(dp_min_noisy_count=-100.0)
    made = lsh.run(df, config, write=False)
    rows = made["raw"].collect()
    assert [(r.review_id, r.similar_review_id, r.approx_jaccard, r.review_keywords) for r in rows] == [("b", "a", 1.0, "bug")]
    one = made["summary"].first()
    assert (one.bug_pair_count, one.avg_star_gap, one.low_star_pair_rate, one.keyword_coverage) == (1, 2.0, 1.0, 1)
    assert lsh.similar_pairs(lsh.select_reviews(df.limit(0), config), config).count() == 0


def test_bands_follow_the_threshold():
    assert LSHConfig().split() == 16 and LSHConfig(threshold=0.5).split() > 16 and LSHConfig(threshold=0.97).split() < 16 and LSHConfig(bands=8).split() == 8
    assert LSHConfig.from_env({"LSH_BUG_MAX_STAR": "none"}).bug_max_star is None


def test_a_hot_text_is_one_class(spark, make_reviews):
    words = " ".join(f"word{i}" for i in range(30)) + " bug"
    df = make_reviews([{"review_id": f"r{i:03}", "text": words if i else words + " more"} for i in range(300)])
    pairs = lsh.similar_pairs(lsh.select_reviews(df, LSHConfig()), LSHConfig())
    assert pairs.count() == 300 * 299 // 2 and pairs.where("approx_jaccard = 1").count() == 299 * 298 // 2


def test_batch_is_written(spark, make_reviews, tmp_path):
    words = " ".join(f"word{i}" for i in range(40)) + " bug"
    make_reviews([{"review_id": r, "text": words} for r in "abc"]).write.parquet(str(tmp_path / "in"))
    config = LSHConfig(source_path=str(tmp_path / "in"), event_time_column="ingest_time", dp_min_noisy_count=-1e9, raw_sink=f"{tmp_path}/raw", dp_sink=f"{tmp_path}/dp", bug_summary_sink=f"{tmp_path}/sum")
    for _ in range(2):
        lsh.run(lsh.load_reviews(spark, config), config)
        time.sleep(1.1)
    raw = spark.read.parquet(config.raw_sink)
    assert raw.count() == 6 and raw.select("batch_id").distinct().count() == 2 and raw.where("processing_time is null").count() == 0
    assert "exact_frequency" not in spark.read.parquet(config.dp_sink).columns
    assert spark.read.parquet(config.bug_summary_sink).select("bug_pair_count").collect() == [(3,), (3,)]
    with pytest.raises(ValueError, match="text"):
        lsh.load_reviews(spark, LSHConfig(source_path=config.bug_summary_sink))


def test_event_column(spark):
    df = spark.sql("select timestamp '2020-01-01' event_time, timestamp '2020-01-02' ingest_time, '2020-01-03' date")
    pick = lambda d, c="": d.select(sources.event_column(d, c)).first()[0]
    assert (pick(df).day, pick(df, "event_time").day, pick(df.select("date")).day) == (2, 1, 3)
    assert pick(df.select(F.lit(1).alias("x"))) is not None


def test_epochs_reset_the_filter(make_reviews):
    rows = [{"review_id": f"r{i}", "text": f"t{i % 10}", "ingest_time": T + timedelta(minutes=i)} for i in range(120)]
    kept = duplicates.with_epochs(duplicates.keyed_rows(make_reviews(rows + [{"ingest_time": None}])), 25)
    sizes = sorted(r["count"] for r in kept.groupBy("epoch").count().collect())
    assert sizes == [1, 20, 20, 20, 20, 20, 20]
    assert duplicates.exact_flags(kept).agg(F.sum("dups")).first()[0] == 60
    assert 60 <= duplicates.bloom_flags(kept, 25).agg(F.sum("dups")).first()[0] <= 63
    assert duplicates.bloom_flags(kept.limit(0), 25).count() == 0


def test_exact_injection(spark, make_reviews):
    df = make_reviews([{"review_id": f"r{i % 40}"} for i in range(55)])
    got = duplicates.inject_exactly(df, 0.5)
    assert got.count() == 55 + 27 and got.columns == df.columns
    assert duplicates.inject_exactly(df, 0.001).count() == 56
    assert duplicates.inject_exactly(df.limit(0), 0.5).count() == 0
    assert sorted(r._number for r in duplicates.numbered(df, df.columns).collect()) == list(range(55))


def test_command_line(spark, tmp_path):
    from tributary.__main__ import main

    (tmp_path / "in.jsonl").write_text("\n".join(f'{{"review_id": "r{i}", "user_id": "u", "business_id": "b", "stars": 5, "text": "t", "event_time": "2020-01-01T10:00:0{i}Z"}}' for i in range(8)) + "\n\n")
    for args, n in ((["sample", "--records", "3"], 3), (["sample", "--records", "3", "--method", "reservoir"], 3), (["inject", "--duplicate-fraction", "0.25"], 10)):
        main([args[0], "--source", str(tmp_path / "in.jsonl"), "--destination", str(tmp_path / "out"), *args[1:]], spark)
        assert spark.read.text(str(tmp_path / "out")).count() == n
    with pytest.raises(SystemExit):
        main(["inject", "--source", "x", "--destination", "y", "--duplicate-fraction", "-1"], spark)
    main(["load", "--folder", str(tmp_path / "nothing")], spark)


def test_units(spark):
    got = [r[0] for r in spark.createDataFrame([(0.25,), (5.0,), (90.0,), (7200.0,)], "s double").select(reports.auto_unit(F.col("s"))).collect()]
    assert got == ["250.00 ms", "5.00 s", "1.50 min", "2.00 h"]

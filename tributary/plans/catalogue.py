"""Queries over the review tables, the event table and the dimension tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.config import LSHConfig
from tributary.functions.text import BUG_KEYWORDS, has_keyword, keyword_matches, keyword_pattern, tokens
from tributary.operators import distinct, duplicates, lsh, reports, sampling, windows
from tributary.operators.dgim import dgim
from tributary.session import new_path, spread, table, written
from tributary.sources.reviews import json_lines, parse_messages, read_many
from tributary.sources.sinks import write_json_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "bronze_reviews")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- windows -------------------------------------------------------------------------------------


def _tumbling(unit: str, where: str = "true") -> str:
    return f"select date_trunc('{unit}', event_time)::timestamp as window_start, date_trunc('{unit}', event_time)::timestamp + interval 1 {unit} as window_end, count(*) as n_reviews, round(avg(stars), 6) as avg_stars from bronze_reviews where {where} group by 1, 2"


@query(_tumbling("minute"))
def metrics_1m(spark, folder):
    return rounded(windows.tumbling_metrics(reviews(spark, folder)), "avg_stars")


@query(_tumbling("hour"))
def metrics_1h(spark, folder):
    return rounded(windows.tumbling_metrics(reviews(spark, folder), "1 hour"), "avg_stars")


@query(_tumbling("minute", "stars >= 4"))
def metrics_1m_high_rated(spark, folder):
    return rounded(windows.tumbling_metrics(reviews(spark, folder), segment=windows.high_rated()), "avg_stars")


@query("""with m as (select date_trunc('minute', event_time) as w, count(*) as n, avg(stars) as a from bronze_reviews group by 1)
select count(*) as n_windows, sum(n)::bigint as total_reviews, round(avg(n), 6) as avg_per_window, max(n) as peak_reviews, round(sum(n * a) / sum(case when a is not null then n end), 6) as avg_stars from m""")
def kpi_summary(spark, folder):
    return rounded(windows.kpi_summary(windows.tumbling_metrics(reviews(spark, folder))), "avg_per_window", "avg_stars")


@query("select date_trunc('minute', event_time)::timestamp as window_start, count(*) as n_reviews from bronze_reviews group by 1 order by 2 desc, 1 limit 10")
def peak_minutes(spark, folder):
    return windows.peak_windows(windows.tumbling_metrics(reviews(spark, folder)))


@query("""with m as (select distinct date_trunc('minute', event_time)::timestamp as m from bronze_reviews), g as (select m, lead(m) over (order by m) as n from m)
select m + interval 1 minute as gap_start, n as gap_end, date_diff('minute', m, n) - 1 as minutes from g where n is not null and date_diff('minute', m, n) - 1 >= 60""")
def quiet_gaps(spark, folder):
    return windows.quiet_gaps(reviews(spark, folder))


def _volatility(unit: str) -> str:
    return f"select date_trunc('{unit}', event_time)::timestamp as period, count(*) as n_reviews, round(avg(stars), 6) as avg_stars, round(stddev_samp(stars), 6) as stddev_stars from bronze_reviews group by 1"


@query(_volatility("day"))
def rating_volatility_day(spark, folder):
    return rounded(windows.rating_volatility(reviews(spark, folder)), "avg_stars", "stddev_stars")


@query(_volatility("hour"))
def rating_volatility_hour(spark, folder):
    return rounded(windows.rating_volatility(reviews(spark, folder), "hour"), "avg_stars", "stddev_stars")


@query("""with m as (select date_trunc('minute', event_time)::timestamp as m, count(*) as n from bronze_reviews group by 1),
t as (select date_diff('minute', min(m), max(m)) + 1 as minutes, count(*) as filled, count(*) filter (n <= 1) as low from m)
select minutes, round((minutes - filled) / minutes, 6) as empty_share, round((minutes - filled + low) / minutes, 6) as low_share from t""")
def low_count_share(spark, folder):
    return rounded(windows.low_count_share(reviews(spark, folder)), "empty_share", "low_share")


_ONES = """select business_id, event_time as ts, max(ones)::bigint as ones from (select business_id, event_time, sum(case when stars >= 4 then 1 else 0 end) over (partition by business_id order by event_time range between interval 60 minutes preceding and current row) as ones from bronze_reviews where event_time is not null) group by 1, 2"""


@query(_ONES)
def sliding_60m_exact(spark, folder):
    return windows.sliding_ones(reviews(spark, folder), F.coalesce(windows.high_rated(), F.lit(False)))


@query()
def dgim_60m(spark, folder):
    return dgim(reviews(spark, folder), F.coalesce(windows.high_rated(), F.lit(False)))


@query(_ONES.replace("as ones from (select", "as ones, true as within_half from (select"))
def dgim_bounds(spark, folder):
    """At each time the exact count, and whether the estimate is within half of it."""
    both = dgim_60m(spark, folder).join(sliding_60m_exact(spark, folder), ["business_id", "ts"])
    return both.select("business_id", "ts", "ones", (F.abs(F.col("estimate") - F.col("ones")) * 2 <= F.col("ones")).alias("within_half"))


@query()
def dgim_accuracy(spark, folder):
    """DGIM beside the exact count."""
    exact = sliding_60m_exact(spark, folder)
    both = dgim_60m(spark, folder).join(exact, ["business_id", "ts"])
    error = F.try_divide(F.abs(F.col("estimate") - F.col("ones")), F.col("ones"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(error).alias("worst_error"), F.avg(error).alias("mean_error"))


# --- sources -------------------------------------------------------------------------------------


@query("""with p as (select case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as j, arrived_at from review_messages),
d as (select j->>'review_id' as review_id, j->>'user_id' as user_id, j->>'business_id' as business_id, try_cast(j->>'stars' as double) as stars, j->>'text' as text, try_cast(coalesce(j->>'event_time', j->>'date') as timestamptz)::timestamp as event_time, arrived_at as ingest_time from p where j is not null)
select * from d where event_time is not null and user_id is not null and business_id is not null and stars is not null""")
def parse_payloads(spark, folder):
    messages = table(spark, folder, "review_messages")
    out = parse_messages(messages, "payload", "arrived_at")
    return out.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


@query("select event_id, ts, user_id, event_type, value, (props->>'k')::bigint as k from events where ts is not null and value >= 40")
def parse_json_props(spark, folder):
    rows = table(spark, folder, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.select("event_id", "ts", "user_id", "event_type", "value", F.col("p.k").alias("k")).dropna(subset=["ts"]).where("value >= 40")


@query("select o_orderkey, o_orderdate, c_mktsegment, n_name from orders left join (select c_custkey, c_mktsegment, n_name from customer join nation on c_nationkey = n_nationkey) on o_custkey = c_custkey")
def enrich_dimension(spark, folder):
    dimension = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return windows.enrich(table(spark, folder, "orders"), dimension, "o_custkey").select("o_orderkey", "o_orderdate", "c_mktsegment", "n_name")


# --- duplicates ----------------------------------------------------------------------------------

_KEY = r"coalesce(user_id, '') || '||' || coalesce(business_id, '') || '||' || trim(regexp_replace(lower(coalesce(text, '')), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))"
_KEYED = f"k as (select {_KEY} as dup_key, ingest_time, review_id, date_trunc('minute', event_time)::timestamp as window_start, event_time from bronze_reviews)"


def _keyed(spark, folder):
    return duplicates.keyed_rows(reviews(spark, folder))


@query(f"""with {_KEYED}, f as (select window_start, row_number() over (partition by dup_key order by ingest_time nulls first, review_id nulls first, window_start nulls first) > 1 as dup from k)
select window_start, count(*) as total, count(*) filter (dup) as dup_count, round(count(*) filter (dup) / count(*), 6) as dup_rate from f group by 1""")
def dup_rate_1m(spark, folder):
    return rounded(duplicates.dup_rate(duplicates.exact_flags(_keyed(spark, folder))), "dup_rate")


@query(f"""with {_KEYED}, f as (select review_id, dup_key, row_number() over (partition by dup_key order by ingest_time nulls first, review_id nulls first, window_start nulls first) > 1 as dup from k)
select review_id, md5(dup_key) as key_md5, count(*) filter (dup) as dups from f group by 1, 2 having count(*) filter (dup) > 0""")
def dup_flag_exact(spark, folder):
    flagged = duplicates.exact_flags(_keyed(spark, folder))
    return flagged.groupBy("review_id", F.lower(F.hex("dup_key")).alias("key_md5")).agg(F.sum("dups").alias("dups")).where("dups > 0")


_M, _K = duplicates.bloom_size(20_000, 0.05)
_BLOOM = f"""with {_KEYED}, r as (select *, row_number() over (order by ingest_time nulls first, review_id nulls first, window_start nulls first, md5(dup_key)) as o from k),
first as (select dup_key, min(o) as o, ('0x' || substr(md5(dup_key), 1, 8))::bigint as a, ('0x' || substr(md5(dup_key), 9, 8))::bigint as b from r group by 1),
bits as (select distinct dup_key, o, (a + i * b) % {_M} as bit from first, range({_K}) t(i)),
born as (select bit, min(o) as born from bits group by 1),
fp as (select dup_key, max(born) < min(o) as fp, min(o) as o from bits join born using (bit) group by 1),
f as (select r.*, r.o <> fp.o or fp.fp as dup from r join fp using (dup_key))
"""


@query(_BLOOM + "select window_start, count(*) as total, count(*) filter (dup) as dup_count, round(count(*) filter (dup) / count(*), 6) as dup_rate from f group by 1")
def bloom_dup_rate_1m(spark, folder):
    """A filter for 20 000 keys at 5 %, as the SQL has it: a fixture whose errors show on small tables and whose answer
    depends on the table's size. ``bloom_sized_dup_rate_1m`` has a filter sized from the keys."""
    flagged = duplicates.bloom_flags(_keyed(spark, folder), 20_000, 0.05)
    return rounded(duplicates.dup_rate(flagged), "dup_rate")


def _flag_accuracy(spark, folder, capacity=20_000, error_rate=0.05):
    rows = written(_keyed(spark, folder), "keyed")
    keys = ["review_id", "dup_key"]
    pick = lambda df: df.where("dups > 0 and review_id is not null")
    return reports.flag_accuracy(pick(duplicates.exact_flags(rows)), pick(duplicates.bloom_flags(rows, capacity, error_rate)), keys)


_ACCURACY = _BLOOM + """, x as (select review_id, dup_key, window_start, bool_or(dup) as p, bool_or(rn > 1) as t from (select *, row_number() over (partition by dup_key order by o) as rn from f) where review_id is not null group by 1, 2, 3),
w as (select window_start, count(*) filter (p) as flagged, count(*) filter (t) as exact, count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from x where p or t group by 1),
a as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from w),
b as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from a)
"""


@query(_ACCURACY + "select window_start, flagged, exact, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from b")
def bloom_accuracy_windows(spark, folder):
    return rounded(_flag_accuracy(spark, folder), "precision", "recall", "f1")


@query(_ACCURACY + "select count(*) as windows_analyzed, round(avg(flagged), 6) as avg_bloom_flagged, round(avg(exact), 6) as avg_exact_duplicates, round(avg(tp), 6) as avg_true_positives, round(avg(fp), 6) as avg_false_positives, round(avg(fn), 6) as avg_false_negatives, round(avg(precision), 6) as avg_precision, round(avg(recall), 6) as avg_recall, round(avg(f1), 6) as avg_f1_score, round(median(precision), 6) as median_precision, round(median(recall), 6) as median_recall from b")
def bloom_accuracy_summary(spark, folder):
    out = reports.bloom_accuracy(_flag_accuracy(spark, folder))
    return rounded(out, *out.columns[1:])


# the same with a filter of the operator's capacity and error rate that is reset each hour of arrival and at 80 % of it
_RM, _RK = duplicates.bloom_size(200_000, 0.01)
_RESET = f"""with k0 as (select {_KEY} as dup_key, ingest_time, review_id, date_trunc('minute', event_time)::timestamp as window_start, event_time, coalesce(floor(epoch_us(ingest_time) / 3600000000), -1) as period from bronze_reviews),
a0 as (select period, ingest_time, count(*) as n from k0 group by 1, 2),
e0 as (select ingest_time, period, floor(coalesce(sum(n) over (partition by period order by ingest_time nulls first rows between unbounded preceding and 1 preceding), 0) / 160000) as part from a0),
k as (select k0.*, part from k0 join e0 on e0.ingest_time is not distinct from k0.ingest_time),
r as (select *, row_number() over (partition by period, part order by ingest_time nulls first, review_id nulls first, window_start nulls first, md5(dup_key)) as o from k),
first as (select dup_key, period, part, min(o) as o, ('0x' || substr(md5(dup_key), 1, 8))::bigint as a, ('0x' || substr(md5(dup_key), 9, 8))::bigint as b from r group by 1, 2, 3),
bits as (select distinct dup_key, period, part, o, (a + i * b) % {_RM} as bit from first, range({_RK}) t(i)),
born as (select period, part, bit, min(o) as born from bits group by 1, 2, 3),
fp as (select dup_key, period, part, max(born) < min(o) as fp, min(o) as o from bits join born using (period, part, bit) group by 1, 2, 3),
f as (select r.*, r.o <> fp.o or fp.fp as dup from r join fp using (dup_key, period, part))
"""


def _epochs(spark, folder):
    return written(duplicates.with_epochs(_keyed(spark, folder)), "epochs")


@query(_RESET + "select window_start, count(*) as total, count(*) filter (dup) as dup_count, round(count(*) filter (dup) / count(*), 6) as dup_rate from f group by 1")
def bloom_reset_dup_rate_1m(spark, folder):
    """A filter of the default capacity, 200 000 keys at 1 %, emptied each hour and when it is 80 % full: errors stay within its rate at every size."""
    return rounded(duplicates.dup_rate(duplicates.bloom_flags(_epochs(spark, folder), 200_000)), "dup_rate")


@query(
    _RESET
    + """, x as (select review_id, dup_key, window_start, bool_or(dup) as p, bool_or(rn > 1) as t from (select *, row_number() over (partition by dup_key, period, part order by o) as rn from f) where review_id is not null group by 1, 2, 3),
w as (select window_start, count(*) filter (p) as flagged, count(*) filter (t) as exact, count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (t and not p) as fn from x where p or t group by 1)
select window_start, flagged, exact, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall from w"""
)
def bloom_reset_accuracy_windows(spark, folder):
    """Its flags against exact duplicates within the same stretches between resets."""
    rows = _epochs(spark, folder)
    pick = lambda df: df.where("dups > 0 and review_id is not null")
    found = reports.flag_accuracy(pick(duplicates.exact_flags(rows)), pick(duplicates.bloom_flags(rows, 200_000)), ["review_id", "dup_key"])
    return rounded(found.drop("f1"), "precision", "recall")


# the same with a filter of the operator's error rate for as many keys as there are
_SIZED = _BLOOM.replace(f"% {_M}", "% (select ceil(-count(*) * ln(0.01) / pow(ln(2), 2))::bigint from first)").replace(f"range({_K})", "range(7)")


@query(ORACLE["bloom_dup_rate_1m"].replace(_BLOOM, _SIZED))
def bloom_sized_dup_rate_1m(spark, folder):
    flagged = duplicates.bloom_flags(written(_keyed(spark, folder), "keyed"))
    return rounded(duplicates.dup_rate(flagged), "dup_rate")


@query(ORACLE["bloom_accuracy_windows"].replace(_BLOOM, _SIZED))
def bloom_sized_accuracy_windows(spark, folder):
    return rounded(_flag_accuracy(spark, folder, None, 0.01), "precision", "recall", "f1")


@query(ORACLE["bloom_accuracy_summary"].replace(_BLOOM, _SIZED))
def bloom_sized_accuracy_summary(spark, folder):
    out = reports.bloom_accuracy(_flag_accuracy(spark, folder, None, 0.01))
    return rounded(out, *out.columns[1:])


@query("select * from bronze_reviews union all select * from bronze_reviews where ('0x' || substr(md5(coalesce(review_id, '') || ':7'), 1, 8))::bigint < 429496729")
def duplicate_injection(spark, folder):
    return duplicates.inject_duplicates(reviews(spark, folder))


_ALL = ["review_id", "user_id", "business_id", "stars", "text", "event_time", "ingest_time"]


@query(f"""with o as (select *, row_number() over (order by {', '.join(f'{c} nulls first' for c in _ALL)}) - 1 as i, count(*) over () as n from bronze_reviews),
d as (select ('0x' || substr(md5(k || ':7'), 1, 15))::bigint % n as i from (select n, unnest(range(greatest(1, floor(n * 0.1)::bigint))) as k from (select count(*) as n from bronze_reviews)))
select * from bronze_reviews union all select {', '.join(_ALL)} from o join d using (i)""")
def duplicate_injection_exact(spark, folder):
    """Exactly a tenth of the rows once more, drawn with replacement, in random order."""
    return duplicates.shuffled(duplicates.inject_exactly(reviews(spark, folder).select(*_ALL)))


# --- distinct counts and samples -----------------------------------------------------------------


def _fm(unit: str, time: str) -> str:
    start = f"time_bucket(interval 10 seconds, {time})" if unit == "10s" else f"date_trunc('{unit}', {time})::timestamp"
    return f"""with h as (select {start} as window_start, user_id, i, ('0x' || substr(md5(user_id || '_' || i), 1, 8))::bigint as h from bronze_reviews, range(5) t(i)),
z as (select window_start, i, max(case when h = 0 then 32 else bit_count((h & -h) - 1) end) as r from h group by 1, 2),
e as (select window_start, greatest(median(pow(2.0, r)) / 0.77351, 1.0) as raw, max(r)::bigint as most from z group by 1),
x as (select {start} as window_start, count(distinct user_id) as n from bronze_reviews group by 1)
select window_start, n::double as distinct_users_estimate, n as distinct_users_exact, round(raw, 6) as raw_distinct_users_estimate, round(abs(raw - n) / n, 6) as error_percent, most as max_trailing_zeros, 5::bigint as num_hash_functions from e join x using (window_start)"""


@query(_fm("10s", "ingest_time"))
def fm_distinct_users(spark, folder):
    return rounded(distinct.fm_windows(reviews(spark, folder)), "raw_distinct_users_estimate", "error_percent")


@query(_fm("day", "event_time"))
def fm_distinct_users_day(spark, folder):
    return rounded(distinct.fm_windows(reviews(spark, folder), duration="1 day", time="event_time"), "raw_distinct_users_estimate", "error_percent")


@query("""with k as (select raw_distinct_users_estimate as r, distinct_users_exact as e, abs(raw_distinct_users_estimate - distinct_users_exact) as a, abs(raw_distinct_users_estimate - distinct_users_exact) / distinct_users_exact as x from fm_distinct_users where distinct_users_exact > 0)
select (select count(*) from fm_distinct_users) as total_windows, count(*) as windows_with_exact, round(avg(r), 6) as avg_estimate, round(avg(e), 6) as avg_exact, round(avg(a), 6) as avg_abs_error, round(avg(x), 6) as avg_rel_error, round(median(x), 6) as median_rel_error, round(quantile_cont(x, 0.95), 6) as p95_rel_error, round(quantile_cont(x, 0.99), 6) as p99_rel_error, round(max(x), 6) as max_rel_error, round(min(x), 6) as min_rel_error from k""")
def fm_accuracy_summary(spark, folder):
    out = reports.fm_accuracy(table(spark, folder, "fm_distinct_users"))
    return rounded(out, *out.columns[2:])


@query("""with x as (select error_percent * 100 as x from fm_distinct_users where error_percent is not null), e as (select min(x) as a, max(x) as b from x),
p as (select case when b = a then 0 else least(floor((x - a) / ((b - a) / 30)), 29) end::int as bin, a, (b - a) / 30 as w from x, e)
select bin, round(a + bin * w, 6) as low, round(a + (bin + 1) * w, 6) as high, count(*) as n from p group by bin, a, w""")
def error_histogram(spark, folder):
    return rounded(reports.error_histogram(table(spark, folder, "fm_distinct_users")), "low", "high")


@query("""select event_time, review_id, user_id, business_id, stars, text, window_start from (select *, date_trunc('minute', event_time)::timestamp as window_start, row_number() over (partition by date_trunc('minute', event_time) order by md5(coalesce(review_id, '') || ':42'), user_id nulls first, business_id nulls first, stars nulls first, text nulls first, event_time, ingest_time) as r from bronze_reviews where event_time is not null) where r <= 100""")
def reservoir_minute(spark, folder):
    return sampling.window_samples(reviews(spark, folder)).select("event_time", "review_id", "user_id", "business_id", "stars", "text", "window_start")


# --- similar reviews -----------------------------------------------------------------------------


@query("select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3))) as tokens from documents where text is not null")
def tokenize_docs(spark, folder):
    rows = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.where("text is not null").select("doc_id", F.array_sort(tokens(F.col("text"))).alias("tokens"))


_PATTERN = keyword_pattern(BUG_KEYWORDS)


@query(f"select review_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{_PATTERN}'))), ',') as keywords from bronze_reviews where regexp_matches(lower(text), '{_PATTERN}')")
def keyword_reviews(spark, folder):
    rows = reviews(spark, folder).where(has_keyword(F.col("text"), BUG_KEYWORDS))
    return rows.select("review_id", F.array_join(keyword_matches(F.col("text"), BUG_KEYWORDS), ",").alias("keywords"))


CONFIG = LSHConfig()
_PERMS = ", ".join(f"({a}, {b}, {i})" for i, (a, b) in enumerate(lsh.permutations(CONFIG.num_perm, CONFIG.random_seed)))
_SIGNED = f"""with s as (select review_id, business_id, text, stars, event_time from (select *, row_number() over (partition by review_id order by event_time nulls last, business_id nulls first, stars nulls first, text nulls first) as r from bronze_reviews where review_id is not null and business_id is not null and text is not null) where r = 1 and regexp_matches(lower(text), '{_PATTERN}') and stars <= 3),
w as (select review_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3))) as w from s),
h as (select review_id, ('0x' || substr(md5(w), 1, 8))::bigint % {lsh.PRIME} as h from w),
p(a, b, i) as (values {_PERMS}),
m as (select review_id, i, min((h * a + b) % {lsh.PRIME}) as m from h, p group by 1, 2),
sig as (select review_id, list(m order by i) as sig from m group by 1)
"""
_BANDS = CONFIG.split()
_ROWS = CONFIG.num_perm // _BANDS
_SIMILAR = _SIGNED + f""", bands as (select review_id, b, array_to_string(sig[b * {_ROWS} + 1:(b + 1) * {_ROWS}], ',') as hash from sig, range({_BANDS}) t(b)),
met as (select distinct x.review_id as x, y.review_id as y from bands x join bands y using (b, hash) where x.review_id < y.review_id),
est as (select x, y, len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / {CONFIG.num_perm}.0 as j from met join sig a on a.review_id = x join sig b on b.review_id = y),
facts as (select *, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{_PATTERN}'))), ',') as k from s),
pairs as (select l.review_id, l.business_id, l.event_time as review_event_time, e.review_id as similar_review_id, e.business_id as similar_business_id, e.event_time as similar_event_time, j as approx_jaccard, l.stars as review_stars, e.stars as similar_review_stars, l.k as review_keywords, e.k as similar_keywords
from est join facts fx on fx.review_id = x join facts fy on fy.review_id = y
join facts l on l.review_id = case when (fx.event_time, fx.review_id) > (fy.event_time, fy.review_id) then x else y end
join facts e on e.review_id = case when (fx.event_time, fx.review_id) > (fy.event_time, fy.review_id) then y else x end where j >= {CONFIG.min_jaccard})
"""
# a source of noise that SQL has too: uniform numbers from the ids
_UNIFORM = "((('0x' || substr(md5(similar_review_id || similar_business_id), 1, 8))::bigint + 0.5) / 4294967296.0 - 0.5)"
_NOISY = _SIMILAR + f""", freq as (select similar_review_id, similar_business_id, count(*) as exact_frequency from pairs group by 1, 2),
noisy as (select *, exact_frequency - sign({_UNIFORM}) * ln(1 - 2 * abs({_UNIFORM})) as noisy_frequency from freq),
dp as (select pairs.*, noisy_frequency from pairs join noisy using (similar_review_id, similar_business_id) where noisy_frequency >= 0)
"""


def _selected(spark, folder):
    return lsh.select_reviews(reviews(spark, folder), CONFIG)


def _pairs(spark, folder):
    return lsh.similar_pairs(written(_selected(spark, folder), "selected"), CONFIG)


def _noisy(pairs):
    uniform = (F.conv(F.substring(F.md5(F.concat("similar_review_id", "similar_business_id")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return lsh.noisy_frequencies(lsh.frequencies(pairs), CONFIG.dp_epsilon, CONFIG.dp_sensitivity, uniform=uniform)


def _private(spark, folder):
    pairs = written(_pairs(spark, folder), "pairs")
    return lsh.private_pairs(pairs, _noisy(pairs), CONFIG.dp_min_noisy_count)


@query(_SIGNED + "select review_id, sig from sig")
def minhash_signature(spark, folder):
    return lsh.signatures(_selected(spark, folder), CONFIG)


@query(_SIMILAR + "select * from pairs")
def lsh_similar_pairs(spark, folder):
    return _pairs(spark, folder)


NARROW = LSHConfig(bands=8)
_NARROW_ROWS = NARROW.num_perm // NARROW.bands
_NARROW = _SIMILAR.replace(f"sig[b * {_ROWS} + 1:(b + 1) * {_ROWS}]", f"sig[b * {_NARROW_ROWS} + 1:(b + 1) * {_NARROW_ROWS}]").replace(f"range({_BANDS})", f"range({NARROW.bands})")


@query(_NARROW + "select * from pairs")
def lsh_similar_pairs_8(spark, folder):
    """8 bands of 16 rows, as the reference's library is taken to choose, which meet a pair at the cut-off with a probability of 0.46; 16 of 8 do with 0.99."""
    return lsh.similar_pairs(written(_selected(spark, folder), "selected"), NARROW)


@query(_SIMILAR + "select * exclude (r) from (select *, row_number() over (partition by review_id order by approx_jaccard desc, similar_review_id) as r from pairs) where r <= 2")
def lsh_nearest_pairs(spark, folder):
    """At most two similar reviews of each review."""
    return lsh.similar_pairs(written(_selected(spark, folder), "selected"), LSHConfig(max_candidates=2))


@query(_SIGNED + "select review_id, event_time from s order by event_time nulls last, review_id limit 200")
def lsh_capped_reviews(spark, folder):
    """The selection's cap: the first 200 by time."""
    return lsh.select_reviews(reviews(spark, folder), LSHConfig(max_reviews=200)).select("review_id", "event_time")


@query(_NOISY + "select similar_review_id, similar_business_id, exact_frequency, round(noisy_frequency, 6) as noisy_frequency from noisy")
def noisy_frequency(spark, folder):
    return rounded(_noisy(_pairs(spark, folder)), "noisy_frequency")


@query(_NOISY + "select * exclude (noisy_frequency), round(noisy_frequency, 6) as noisy_frequency from dp")
def lsh_private_pairs(spark, folder):
    return rounded(_private(spark, folder), "noisy_frequency")


@query(_NOISY + ", n as (select distinct similar_review_id, similar_business_id, noisy_frequency from dp) select similar_review_id, similar_business_id, round(noisy_frequency, 6) as noisy_frequency, exact_frequency, round(noisy_frequency - exact_frequency, 6) as noise from n left join freq using (similar_review_id, similar_business_id)")
def noise_compare(spark, folder):
    pairs = written(_pairs(spark, folder), "pairs")
    private = lsh.private_pairs(pairs, _noisy(pairs), CONFIG.dp_min_noisy_count)
    return rounded(reports.noise_compare(private, lsh.frequencies(pairs)), "noisy_frequency", "noise")


@query(_NOISY + """, g as (select business_id, count(*) as bug_pair_count, avg(review_stars) as a, avg(similar_review_stars) as b, avg(approx_jaccard) as c, avg(abs(review_stars - similar_review_stars)) as d, max(noisy_frequency) as e, avg(case when review_stars <= 3 or similar_review_stars <= 3 then 1.0 else 0.0 end) as f from dp group by 1),
c as (select business_id, count(distinct w) as n from (select business_id, unnest(string_split(review_keywords, ',')) as w from dp) where w <> '' group by 1)
select business_id, bug_pair_count, round(a, 6) as avg_review_stars, round(b, 6) as avg_similar_stars, round(c, 6) as avg_jaccard, round(d, 6) as avg_star_gap, round(e, 6) as max_noisy_frequency, round(f, 6) as low_star_pair_rate, coalesce(n, 0) as keyword_coverage from g left join c using (business_id)""")
def bug_cluster_summary(spark, folder):
    out = lsh.bug_summary(_private(spark, folder), CONFIG.bug_max_star)
    return rounded(out, "avg_review_stars", "avg_similar_stars", "avg_jaccard", "avg_star_gap", "max_noisy_frequency", "low_star_pair_rate")


@query("select business_id, count(*) as n_pairs from dup_lsh_raw group by 1 order by 2 desc, 1 limit 5")
def top_businesses(spark, folder):
    return reports.ranked_by(table(spark, folder, "dup_lsh_raw"), "business_id", 5, "n_pairs")


@query("select business_id, count(*) as bug_pair_count, round(avg(approx_jaccard), 6) as avg_jaccard, round(avg(abs(review_stars - similar_review_stars)), 6) as avg_star_gap from dup_lsh_raw group by 1 order by 2 desc, 1 limit 10")
def top_bug_clusters(spark, folder):
    """The ten businesses of the most pairs, of the summary per business."""
    summary = lsh.bug_summary(table(spark, folder, "dup_lsh_raw").withColumn("noisy_frequency", F.lit(0.0)), CONFIG.bug_max_star)
    return rounded(reports.top_rows(summary, "bug_pair_count", ["business_id"], 10).select("business_id", "bug_pair_count", "avg_jaccard", "avg_star_gap"), "avg_jaccard", "avg_star_gap")


@query("select review_id, similar_review_id, approx_jaccard from dup_lsh_raw order by approx_jaccard desc, review_id, similar_review_id limit 1")
def top_pair(spark, folder):
    rows = table(spark, folder, "dup_lsh_raw").select("review_id", "similar_review_id", "approx_jaccard")
    return rows.orderBy(F.desc("approx_jaccard"), "review_id", "similar_review_id").limit(1)


@query("select similar_review_id, similar_business_id, count(*) as exact_frequency from dup_lsh_raw group by 1, 2")
def pair_frequency(spark, folder):
    return lsh.frequencies(table(spark, folder, "dup_lsh_raw"))


# --- reports -------------------------------------------------------------------------------------

# arrival minutes stand for batches, and a batch ends with its minute
_BATCHES = """with r as (select date_trunc('minute', ingest_time)::timestamp as batch, epoch_us(ingest_time) as i, greatest(0.0, (epoch_us(ingest_time) - epoch_us(event_time)) / 1e6) as delay, (epoch_us(date_trunc('minute', ingest_time) + interval 1 minute) - epoch_us(ingest_time)) / 1e6 as latency from bronze_reviews),
b as (select batch, count(*) as events, case when max(i) > min(i) then (max(i) - min(i)) / 1e6 else 5.0 end as processing_time, avg(latency) as avg_latency, quantile_cont(latency, 0.5) as p50, quantile_cont(latency, 0.95) as p95, quantile_cont(latency, 0.99) as p99, max(latency) as max_latency, avg(delay) as avg_delay, max(delay) as max_delay from r group by 1),
u as (select date_trunc('hour', batch)::timestamp as window_start, sum(events)::bigint as total_events, sum(processing_time) as total_processing_time, sum(events) / 60 as avg_throughput, max(events / processing_time) as max_throughput, avg(avg_latency) as avg_latency, median(p50) as p50_latency, quantile_cont(p95, 0.95) as p95_latency, quantile_cont(p99, 0.99) as p99_latency, max(max_latency) as max_latency, avg(avg_delay) as avg_event_delay, max(max_delay) as max_event_delay, count(*) as num_batches from b group by 1)
"""
_ROLLED = ["total_processing_time", "avg_throughput", "max_throughput", "avg_latency", "p50_latency", "p95_latency", "p99_latency", "max_latency", "avg_event_delay", "max_event_delay"]
_LATENCIES = ["avg_latency", "p50_latency", "p95_latency", "p99_latency", "max_latency"]


def _rollup(spark, folder):
    rows = reviews(spark, folder).where("ingest_time is not null and event_time is not null")
    minute = F.date_trunc("minute", "ingest_time").cast("timestamp_ntz")
    batches = reports.batch_performance(rows, minute, minute + F.expr("interval 1 minute"))
    return reports.performance_rollup(batches, F.date_trunc("hour", "batch").cast("timestamp_ntz"))


@query(_BATCHES + f"select window_start, total_events, num_batches, {', '.join(f'round({c}, 6) as {c}' for c in _ROLLED)} from u")
def perf_rollup(spark, folder):
    return _rollup(spark, folder).withColumns({c: F.round(c, 6) for c in _ROLLED})


@query(_BATCHES + f", f as (select min(least({', '.join(_LATENCIES)})) as f from u) select window_start, {', '.join(f'round({c} - f, 9) as {c}' for c in _LATENCIES)} from u, f")
def latency_delta(spark, folder):
    return reports.latency_deltas(_rollup(spark, folder).select("window_start", *_LATENCIES), _LATENCIES).withColumns({c: F.round(c, 9) for c in _LATENCIES})


@query("select event_type, arg_max(value, (ts, value, event_id)) as value, max(ts) as ts from events group by 1")
def latest_per_group(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "ts", "value", "event_id")
    return reports.latest(rows, "ts", ["event_type"]).select("event_type", "value", "ts")


@query("select * from fm_distinct_users order by window_start desc limit 1")
def latest_overall(spark, folder):
    return reports.latest(table(spark, folder, "fm_distinct_users"), "window_start")


@query(_BATCHES + ", s as (select window_start, p95_latency as x from u) select window_start, case when x < 1 then printf('%.2f ms', x * 1000) when x < 60 then printf('%.2f s', x) when x < 3600 then printf('%.2f min', x / 60) else printf('%.2f h', x / 3600) end as p95_shown from s")
def latency_units(spark, folder):
    return _rollup(spark, folder).select("window_start", reports.auto_unit(F.col("p95_latency")).alias("p95_shown"))


@query("select doc_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') as created, substr(trim(text), 1, 160) as snippet from documents")
def document_snippets(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", reports.iso_time(F.col("created_at")).alias("created"), reports.snippet(F.col("text")).alias("snippet"))


@query("select review_id, user_id, business_id, stars, event_time from dup_bloom union all select review_id, user_id, business_id, stars, event_time from reservoir_samples")
def flagged_and_sampled(spark, folder):
    """One read of several stored tables."""
    return read_many(spark, [f"{folder}/{n}.parquet" for n in ("dup_bloom", "reservoir_samples")], ["review_id", "user_id", "business_id", "stars", "event_time"])


@query("select review_id, user_id, business_id, stars, text, strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') as event_time from bronze_reviews")
def json_lines_again(spark, folder):
    """Reviews written as JSON lines and read again."""
    path = new_path(spark, "lines")
    rows = reviews(spark, folder).select("review_id", "user_id", "business_id", "stars", "text", reports.iso_time(F.col("event_time")).alias("event_time"))
    write_json_lines(rows, path)
    return json_lines(spark, path, strict=True).drop("date")


@query("select distinct window_start from metrics_1m order by 1 desc limit 50")
def last_windows(spark, folder):
    return reports.last_windows(table(spark, folder, "metrics_1m"))


@query("select * from (select window_start, n_reviews, window_end from metrics_1m order by window_start desc, n_reviews desc limit 10)")
def tail_windows(spark, folder):
    return reports.tail(table(spark, folder, "metrics_1m").select("window_start", "n_reviews", "window_end"), ["window_start", "n_reviews"], 10)


@query("select review_id, window_start, count(*) as n_repeats from (select review_id, date_trunc('minute', event_time)::timestamp as window_start, row_number() over (partition by review_id, date_trunc('minute', event_time) order by event_time, ingest_time) as r from bronze_reviews where review_id is not null) where r > 1 group by 1, 2")
def repeats_within_minute(spark, folder):
    rows = reviews(spark, folder).withColumn("window_start", F.date_trunc("minute", "event_time").cast("timestamp_ntz"))
    return reports.repeats_within(rows)


@query("""with o as (select window_start, sum(n_reviews)::bigint as stored from metrics_1m group by 1), n as (select date_trunc('minute', event_time)::timestamp as window_start, count(*) as now from bronze_reviews group by 1)
select window_start, coalesce(stored, 0) as stored, coalesce(now, 0) as now, coalesce(now, 0) - coalesce(stored, 0) as missed from o full join n using (window_start)""")
def late_share(spark, folder):
    """What the stored minute counts lack of all rows: late and partial windows."""
    stored = table(spark, folder, "metrics_1m").groupBy("window_start").agg(F.sum("n_reviews").alias("stored"))
    now = windows.tumbling_metrics(reviews(spark, folder)).select("window_start", F.col("n_reviews").alias("now"))
    both = stored.join(now, "window_start", "full").na.fill(0, ["stored", "now"])
    return both.select("window_start", "stored", "now", (F.col("now") - F.col("stored")).alias("missed"))

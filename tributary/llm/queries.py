"""Queries of the problems of this package."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.text import dup_key
from tributary.llm.abuse import AbuseScores
from tributary.llm.bpe import decode_corpus, encode_corpus
from tributary.llm.distinct import DistinctRuns, RunStore
from tributary.llm.formats import FIELDS, FormatCopies, payload_records
from tributary.llm.leaks import EDITED, RUN, LeakSearch
from tributary.llm.neardup import NearDuplicates
from tributary.llm.reservoir import ReservoirStore, WindowReservoir
from tributary.llm.seen import SeenKeys
from tributary.operators.idindex import arrival_slices
from tributary.session import table, written


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reviews whose token sets are similar."""
    pairs = NearDuplicates(table(spark, folder, "bronze_reviews")).pairs()
    return pairs.select(F.col("id_a").alias("review_id_a"), F.col("id_b").alias("review_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each review that has a similar other, with its group."""
    groups = NearDuplicates(table(spark, folder, "bronze_reviews")).groups()
    return groups.select(F.col("id").alias("review_id"), "group_id", "group_size")


def _users(spark: SparkSession, folder: str, batches: int = 3) -> DistinctRuns:
    """Stored runs of users per day of event time and business, of arrivals in some batches, merged per day and business."""
    rows = table(spark, folder, "bronze_reviews").select("user_id", "business_id", "event_time", "ingest_time")
    store = RunStore(spark, {"day": F.to_date("event_time"), "business_id": F.col("business_id")}, "user_id")
    for k, part in enumerate(arrival_slices(rows, "ingest_time", batches)):
        store.add(part, k)
    return DistinctRuns(written(store.runs().regroup(None, ["day", "business_id"]).runs, "users"), ["day", "business_id"])


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """(source, business_id): the businesses that a source's documents are about."""
    return table(spark, folder, "documents").select("source", "business_id").dropna().distinct()


def p2_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users per day and business, per day, per business, and of combinations of businesses: all those that a source's documents are about."""
    users = _users(spark, folder)
    whole = "day date, business_id string, source string"
    business = DistinctRuns(written(users.regroup(None, ["business_id"]).runs, "business"), ["business_id"])
    made = {"day and business": users, "day": users.regroup(None, ["day"]), "business": business, "source": business.regroup(_sources(spark, folder), ["source"])}
    parts = []
    for kind, runs in made.items():
        counted = runs.counts()
        groups = [F.col(c).alias(c) if c in runs.by else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in whole.split(", "))]
        parts.append(counted.select(F.lit(kind).alias("per"), *groups, "distinct_users", "expected_collisions", "relative_error"))
    return reduce(DataFrame.unionAll, parts)


def p2_daily_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users per day, merged from the stored runs per day and business."""
    return _users(spark, folder).regroup(None, ["day"]).counts()


def p2_business_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users per business over all days."""
    return _users(spark, folder).regroup(None, ["business_id"]).counts()


def p2_source_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users of combinations of businesses: of all those that a source's documents are about."""
    return _users(spark, folder).regroup(None, ["business_id"]).regroup(_sources(spark, folder), ["source"]).counts()


def p2_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users per ten seconds of ingest time beside the old estimates."""
    start = (F.floor(F.unix_micros(F.col("ingest_time").cast("timestamp")) / 10_000_000) * 10).cast("long")
    now = DistinctRuns.build(table(spark, folder, "bronze_reviews"), {"w": start}, "user_id").counts()
    now = now.select(F.timestamp_seconds("w").cast("timestamp_ntz").alias("window_start"), "distinct_users")
    old = table(spark, folder, "fm_distinct_users").select("window_start", F.col("raw_distinct_users_estimate").alias("old_estimate"))
    both = now.join(old, "window_start", "left")
    return both.withColumn("old_error", F.round(F.abs(F.col("old_estimate") - F.col("distinct_users")) / F.col("distinct_users"), 6))


def p3_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred reviews of each minute of event time, every one of the minute being equally likely."""
    drawn = WindowReservoir(table(spark, folder, "bronze_reviews"), "review_id", "event_time", "ingest_time").sample()
    return drawn.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("id").alias("review_id"))


def p3_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Size of each window's sample, which is the lesser of 100 and its distinct reviews."""
    return p3_samples(spark, folder).groupBy("window_start").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_distinct("review_id").alias("n_distinct"))


def p3_stored_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The same sizes from stored samples that three batches of arrivals were drawn into."""
    store = ReservoirStore(spark)
    rows = table(spark, folder, "bronze_reviews").select("review_id", "event_time", "ingest_time")
    for k, part in enumerate(arrival_slices(rows, "ingest_time", 3)):
        store.process(part, k)
    drawn = store.sample().withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return drawn.groupBy("window_start").agg(F.count(F.lit(1)).alias("n_sampled"), F.count_distinct("id").alias("n_distinct"), F.max("seen").alias("n_seen"))


def _records(spark: SparkSession, folder: str) -> FormatCopies:
    stored = table(spark, folder, "bronze_reviews").select(*FIELDS)
    return FormatCopies(stored.union(payload_records(table(spark, folder, "review_messages"))))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of reviews that differ in formatting only."""
    return _records(spark, folder).pairs()


def p5_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, with the number of its copies."""
    return _records(spark, folder).counts().select("review_id", "copies")


def p5_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that different records share: none is expected."""
    return _records(spark, folder).collisions().select("key")


def _seen(spark: SparkSession, folder: str) -> SeenKeys:
    return SeenKeys(table(spark, folder, "bronze_reviews"), dup_key(F.col("user_id"), F.col("business_id"), F.col("text")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews whose key came before: the sets' positives, confirmed by an exact join of their digests."""
    return _seen(spark, folder).found().select(F.col("id").alias("review_id"))


def p7_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The same by the sets alone: no review is missed, and one new key in some sixteen thousand is taken for an old one."""
    return _seen(spark, folder).answers().select(F.col("id").alias("review_id"))


def p7_slices(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, keys, and keys that came before, of each slice: the rates' true positives."""
    rates = _seen(spark, folder).rates()
    return rates.select("slice", "n_rows", "n_keys", (F.col("n_positive") - F.col("n_false_positive")).alias("n_seen"))


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Theoretical and audited rates of wrong answers per slice of arrival time."""
    return _seen(spark, folder).rates()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's ids by byte_bpe_50k."""
    return encode_corpus(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "ids")


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document's ids decode to its text again (null texts to the empty one)."""
    decoded = decode_corpus(p8_ids(spark, folder)).select(F.col("id").alias("doc_id"), F.col("text").alias("decoded"))
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return texts.join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _leaks(spark: SparkSession, folder: str, edited: bool = False) -> DataFrame:
    return LeakSearch(table(spark, folder, "documents"), table(spark, folder, "eval_items")).alignments(edited)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least twelve consecutive words of an item."""
    return _leaks(spark, folder).where(F.col("run") >= RUN).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item, with the number of documents that hold a passage of it."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment scores of all pairs that share five words in a row, so of edited and partial copies too."""
    return _leaks(spark, folder, edited=True).select("doc_id", "item_id", F.round("score", 6).alias("score"), "run")


def p9_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold an item or most of it, edited or not: those whose alignment reaches EDITED of a perfect score."""
    return _leaks(spark, folder, edited=True).where(F.col("score") >= EDITED).select("doc_id", "item_id", F.round("score", 6).alias("score"))


def _abuse(spark: SparkSession, folder: str) -> AbuseScores:
    return AbuseScores(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Abusive, hateful or sexually explicit documents."""
    return _abuse(spark, folder).scores().where("score >= 0.5").select(F.col("id").alias("doc_id"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's score."""
    return _abuse(spark, folder).scores().select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's rate."""
    return _abuse(spark, folder).rates()


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_users, p2_daily_users, p2_business_users, p2_source_users, p2_windows, p3_samples, p3_fill, p3_stored_fill, p5_found, p5_copies, p5_collisions, p7_found, p7_answers, p7_slices, p7_rates, p8_ids, p8_roundtrip, p9_found, p9_items, p9_scores, p9_edited, p10_found, p10_scores, p10_rates)}

_PAIRS = """
with sets as (select distinct review_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3))) as t from bronze_reviews where review_id is not null and text is not null),
big as (select review_id, t, len(t) as n from sets where len(t) >= 12),
words as (select review_id, n, unnest(t) as w from big),
df as (select w, count(*) as f from words group by w),
ranked as (select review_id, w, row_number() over (partition by review_id order by f, w) as r, n from words join df using (w)),
prefix as (select * from ranked where r <= n - ceil(0.8 * n - 1e-9) + 1),
met as (select distinct a.review_id as x, b.review_id as y from prefix a join prefix b on a.w = b.w and a.review_id < b.review_id and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
scored as (select x, y, len(list_intersect(a.t, b.t)) as i, a.n + b.n as s from met join big a on a.review_id = x join big b on b.review_id = y)
"""

_RECORDS = r"""
with m as (select case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as j from review_messages),
r as (select review_id, user_id, business_id, text from bronze_reviews union all select j->>'review_id', j->>'user_id', j->>'business_id', j->>'text' from m where j is not null),
c as (select review_id, regexp_replace(lower(user_id), '[^\p{L}\p{N}]+', '', 'g') as u, regexp_replace(lower(business_id), '[^\p{L}\p{N}]+', '', 'g') as b, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') as t
from r where review_id is not null and user_id is not null and business_id is not null and text is not null),
k as (select * from c where t <> '')
"""

_COUNTED = "n as distinct_users, n::double * (n::double - 1) / pow(2.0, 65) as expected_collisions, (n::double - 1) / pow(2.0, 65) as relative_error"

_LEAKS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items where text is not null),
dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from d),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from i),
f as (select distinct doc_id, item_id from dg join ig using (g))
"""

ORACLE = {
    "p1_found": _PAIRS + "select x as review_id_a, y as review_id_b from scored where i / (s - i) >= 0.8",
    "p2_users": f"""with u as (select distinct event_time::date as day, business_id, user_id from bronze_reviews),
c as (select 'day and business' as per, day, business_id, null::varchar as source, count(distinct user_id) as n from u group by day, business_id
union all select 'day', day, null, null, count(distinct user_id) from u group by day
union all select 'business', null, business_id, null, count(distinct user_id) from u group by business_id
union all select 'source', null, null, source, count(distinct user_id) from u join (select distinct source, business_id from documents where source is not null and business_id is not null) using (business_id) group by source)
select per, day, business_id, source, {_COUNTED} from c where n > 0""",
    "p2_daily_users": f"select day, {_COUNTED} from (select event_time::date as day, count(distinct user_id) as n from bronze_reviews group by 1)",
    "p2_business_users": f"select business_id, {_COUNTED} from (select business_id, count(distinct user_id) as n from bronze_reviews group by 1)",
    "p2_source_users": f"select source, {_COUNTED} from (select source, count(distinct user_id) as n from (select distinct source, business_id from documents where source is not null and business_id is not null) join bronze_reviews using (business_id) group by 1)",
    "p2_windows": "select w as window_start, n as distinct_users, raw_distinct_users_estimate as old_estimate, round(abs(raw_distinct_users_estimate - n) / n, 6) as old_error from (select time_bucket(interval 10 seconds, ingest_time) as w, count(distinct user_id) as n from bronze_reviews group by 1) left join fm_distinct_users on window_start = w",
    "p3_fill": "select w as window_start, least(100, count(*)) as n_sampled, least(100, count(*)) as n_distinct from (select review_id, date_trunc('minute', arg_min(event_time, (ingest_time, event_time))) as w from bronze_reviews where review_id is not null and event_time is not null group by review_id) group by 1",
    "p5_found": _RECORDS + "select distinct x.review_id as review_id_a, y.review_id as review_id_b from k x join k y using (u, b, t) where x.review_id < y.review_id",
    "p5_copies": _RECORDS + "select min(review_id) as review_id, count(*) as copies from k group by u, b, t",
    "p7_found": r"""
with k as (select review_id, row_number() over (partition by user_id || '||' || business_id || '||' || trim(regexp_replace(lower(coalesce(text, '')), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) order by ingest_time nulls first, review_id nulls first) as r from bronze_reviews)
select distinct review_id from k where r > 1 and review_id is not null""",
    "p5_collisions": _RECORDS + "select md5(u || '|' || b || '|' || t) as key from k group by 1 having count(distinct u || '|' || b || '|' || t) > 1",
    "p7_slices": r"""
with w as (select min(epoch_us(ingest_time)) as low, (max(epoch_us(ingest_time)) - min(epoch_us(ingest_time)) + 1) as span, least(4096, greatest(64, count(*) // 65536)) as c from bronze_reviews),
k as (select user_id || '||' || business_id || '||' || trim(regexp_replace(lower(coalesce(text, '')), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) as k, case when span = 1 then 0 else coalesce((epoch_us(ingest_time) - low) // ((span + c - 1) // c), 0) end as slice from bronze_reviews, w),
f as (select k, slice, count(*) as n, min(slice) over (partition by k) as born from k group by k, slice)
select slice::int as slice, sum(n)::bigint as n_rows, count(*) as n_keys, count(*) filter (born < slice) as n_seen from f group by 1""",
    "p8_roundtrip": "select doc_id, true as same from documents",
    "p9_found": _LEAKS + "select doc_id, item_id from f",
    "p9_items": _LEAKS + "select item_id, count(*) as n_docs from f group by item_id",
}
ORACLE["p3_stored_fill"] = ORACLE["p3_fill"].replace("as n_distinct from", "as n_distinct, count(*) as n_seen from")
ORACLE["p1_groups"] = (
    _PAIRS.replace("with sets", "with recursive sets")
    + """, e as (select x, y from scored where i / (s - i) >= 0.8 union all select y, x from scored where i / (s - i) >= 0.8),
reach as (select distinct x as id, x as root from e union select reach.id, e.y from reach join e on e.x = reach.root)
select id as review_id, min(root) as group_id, count(*) as group_size from reach group by id"""
)

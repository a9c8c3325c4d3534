"""Similar reviews by MinHash and banding, with private frequencies and summaries per business."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.config import LSHConfig
from tributary.functions.text import has_keyword, keyword_matches, tokens
from tributary.operators.blocks import block_pairs
from tributary.session import written
from tributary.sources.reviews import event_column, read_batch
from tributary.sources.sinks import append_counted

#: A Mersenne prime: products of two values below it fit 64 bits.
PRIME = 2**31 - 1


def permutations(count: int, seed: int = 42) -> list[tuple[int, int]]:
    """``count`` linear functions modulo PRIME, as powers of two primitive roots."""
    return [(pow(16807, seed + i + 1, PRIME), pow(48271, seed + i + 1, PRIME)) for i in range(count)]


def select_reviews(df: DataFrame, config: LSHConfig) -> DataFrame:
    """Reviews that take part: complete ones, one row per id (the earliest), by keyword and stars if so set, at most ``max_reviews`` by time if that is set.

    The time is the configured column, else event_time, else the first of ingest_time and date, else now. ``bug_max_star`` None sets no limit.
    """
    when = F.col("event_time") if not config.event_time_column and "event_time" in df.columns else event_column(df, config.event_time_column)
    rows = df.select("review_id", "business_id", F.col(config.text_column).alias("text"), "stars", when.alias("event_time")).dropna(subset=["review_id", "business_id", "text"])
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy(F.col("event_time").asc_nulls_last(), "business_id", "stars", "text"))
    rows = rows.withColumn("_r", rank).where("_r = 1").drop("_r")
    if config.filter_bug_reviews:
        rows = rows.where(has_keyword(F.col("text"), config.bug_keywords))
        rows = rows if config.bug_max_star is None else rows.where(F.col("stars") <= config.bug_max_star)
    return rows.orderBy(F.col("event_time").asc_nulls_last(), "review_id").limit(config.max_reviews) if config.max_reviews else rows


def signatures(reviews: DataFrame, config: LSHConfig) -> DataFrame:
    """(review_id, sig): minima of ``num_perm`` functions over the distinct tokens; reviews without a token are left out.

    Minima combine before the shuffle, so the exploded tokens don't cross it.
    """
    word = F.explode(tokens(F.col("text"), config.min_token_length)).alias("w")
    h = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(PRIME))
    hashed = reviews.select("review_id", word).select("review_id", h.alias("h"))
    minima = [F.min(F.pmod(F.col("h") * a + b, F.lit(PRIME))) for a, b in permutations(config.num_perm, config.random_seed)]
    return hashed.groupBy("review_id").agg(F.array(*minima).alias("sig"))


def similar_pairs(reviews: DataFrame, config: LSHConfig) -> DataFrame:
    """Pairs whose estimated similarity is at least ``min_jaccard``; of each pair the later review (time, then id) is ``review_id``.

    Reviews of equal signature are one class, made with map-side combining, so a text that is copied a million times is one row in
    the search. Bands of classes meet by their hash, hot ones in blocks; pairs of classes are scored once, and then
    given to their members, copies in blocks too. With ``max_candidates`` a review keeps its most similar ones.
    """
    bands = config.split()
    rows = config.num_perm // bands
    kind = F.unhex(F.md5(F.array_join("sig", ","))).alias("c")
    signed = written(signatures(reviews, config).select("review_id", kind, "sig"), "signed")
    classes = written(signed.groupBy("c").agg(F.first("sig").alias("sig")), "classes")
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.unhex(F.md5(F.array_join(F.slice("sig", i * rows + 1, rows), ","))).alias("hash")) for i in range(bands)])).alias("b")
    keyed = classes.select("c", band).select("c", "b.band", "b.hash")
    met = block_pairs(keyed, ["band", "hash"], "c").select("c_a", "c_b").distinct()
    a, b = classes.select(F.col("c").alias("c_a"), F.col("sig").alias("sa")), classes.select(F.col("c").alias("c_b"), F.col("sig").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    near = met.join(a, "c_a").join(b, "c_b").select("c_a", "c_b", (same / F.lit(float(config.num_perm))).alias("approx_jaccard")).where(F.col("approx_jaccard") >= config.min_jaccard)
    members = signed.select("c", "review_id")
    left, right = members.select(F.col("c").alias("c_a"), F.col("review_id").alias("x")), members.select(F.col("c").alias("c_b"), F.col("review_id").alias("y"))
    across = near.join(left, "c_a").join(right, "c_b").select("x", "y", "approx_jaccard")
    copies = block_pairs(members, ["c"], "review_id").select(F.col("review_id_a").alias("x"), F.col("review_id_b").alias("y"), F.lit(1.0).alias("approx_jaccard"))
    scored = across.union(copies).select(F.col("x").alias("review_id"), F.col("y").alias("similar_review_id"), "approx_jaccard")
    facts = reviews.select(F.col("review_id").alias("id"), F.col("business_id").alias("b"), F.col("event_time").alias("t"), F.col("stars").alias("s"), F.array_join(keyword_matches(F.col("text"), config.bug_keywords), ",").alias("k"))
    left, right = facts.select(F.struct("*").alias("x")), facts.select(F.struct("*").alias("y"))
    joined = scored.join(left, F.col("review_id") == F.col("x.id")).join(right, F.col("similar_review_id") == F.col("y.id"))
    later = F.struct(F.col("x.t"), F.col("x.id")) > F.struct(F.col("y.t"), F.col("y.id"))
    pick = lambda f, first: F.when(later, F.col(f"{'x' if first else 'y'}.{f}")).otherwise(F.col(f"{'y' if first else 'x'}.{f}"))
    names = [("review_id", "id", True), ("business_id", "b", True), ("review_event_time", "t", True), ("similar_review_id", "id", False), ("similar_business_id", "b", False), ("similar_event_time", "t", False)]
    tail = [("review_stars", "s", True), ("similar_review_stars", "s", False), ("review_keywords", "k", True), ("similar_keywords", "k", False)]
    out = joined.select(*[pick(f, one).alias(n) for n, f, one in names], "approx_jaccard", *[pick(f, one).alias(n) for n, f, one in tail])
    if config.max_candidates:
        rank = F.row_number().over(Window.partitionBy("review_id").orderBy(F.desc("approx_jaccard"), "similar_review_id"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= config.max_candidates).drop("_r")
    return out


def stamped(pairs: DataFrame) -> DataFrame:
    """With batch_id and processing_time of the run."""
    now = F.current_timestamp()
    return pairs.select(F.date_format(now, "yyyyMMddHHmmss").alias("batch_id"), now.alias("processing_time"), "*")


def frequencies(pairs: DataFrame) -> DataFrame:
    """(similar_review_id, similar_business_id, exact_frequency)."""
    return pairs.groupBy("similar_review_id", "similar_business_id").agg(F.count(F.lit(1)).alias("exact_frequency"))


def laplace(scale: float, uniform: Column) -> Column:
    """Laplace noise from a uniform variable over (0, 1)."""
    u = uniform - 0.5
    return F.lit(-scale) * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def noisy_frequencies(counts: DataFrame, epsilon: float = 1.0, sensitivity: float = 1.0, seed: int | None = None, uniform: Column | None = None) -> DataFrame:
    """Adds ``noisy_frequency``. ``uniform`` replaces the random variable, for tests.

    Write or checkpoint the result before it is used twice: random noise is drawn anew when
    recomputed. A given seed makes the noise foreseeable, so leave it out where privacy counts.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    u = uniform if uniform is not None else F.rand() if seed is None else F.rand(seed)
    return counts.withColumn("noisy_frequency", F.col("exact_frequency") + laplace(sensitivity / epsilon, u))


def private_pairs(pairs: DataFrame, noisy: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs with their noisy frequency, without those whose it is below ``least``; the exact one is withheld."""
    kept = noisy.where(F.col("noisy_frequency") >= least).drop("exact_frequency")
    return pairs.join(kept, ["similar_review_id", "similar_business_id"]).select(*pairs.columns, "noisy_frequency")


def bug_summary(pairs: DataFrame, low_star: float | None = 3.0) -> DataFrame:
    """One row per business of the pairs' later reviews."""
    gap = F.abs(F.col("review_stars") - F.col("similar_review_stars"))
    low = F.lit(0.0) if low_star is None else F.coalesce((F.col("review_stars") <= low_star) | (F.col("similar_review_stars") <= low_star), F.lit(False)).cast("double")
    words = F.filter(F.split("review_keywords", ","), lambda w: w != "")
    coverage = F.size(F.array_distinct(F.flatten(F.collect_set(words)))).cast("long")
    return pairs.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("bug_pair_count"),
        F.avg("review_stars").alias("avg_review_stars"),
        F.avg("similar_review_stars").alias("avg_similar_stars"),
        F.avg("approx_jaccard").alias("avg_jaccard"),
        F.avg(gap).alias("avg_star_gap"),
        F.max("noisy_frequency").alias("max_noisy_frequency"),
        F.avg(low).alias("low_star_pair_rate"),
        coverage.alias("keyword_coverage"),
    )


def load_reviews(spark: SparkSession, config: LSHConfig) -> DataFrame:
    """The configured source, which must have the columns that the batch needs."""
    return read_batch(spark, config.source_path, config.source_format, ["review_id", "business_id", "stars", config.text_column])


def run(df: DataFrame, config: LSHConfig | None = None, write: bool = True) -> dict[str, DataFrame]:
    """The batch: pairs, private pairs and summary, each appended to its sink; noise is drawn once and written, and has no seed unless ``dp_seed`` is set."""
    config = config or LSHConfig()
    raw = written(stamped(similar_pairs(select_reviews(df, config), config)), "raw-pairs")
    noisy = written(noisy_frequencies(frequencies(raw), config.dp_epsilon, config.dp_sensitivity, config.dp_seed or None), "noisy")
    private = private_pairs(raw, noisy, config.dp_min_noisy_count)
    summary = bug_summary(private, config.bug_max_star)
    if write:
        for made, sink in ((raw, config.raw_sink), (private, config.dp_sink), (summary, config.bug_summary_sink)):
            append_counted(made, sink)
    return {"raw": raw, "private": private, "summary": summary}

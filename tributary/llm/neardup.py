"""Groups of nearly equal texts: ProbMinHash signatures, banding, exact verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.blocks import block_pairs
from tributary.llm.components import components
from tributary.session import discard, semi, ship, spread, written

TOKEN = re.compile("[a-z0-9]+")
#: Signature of BANDS x ROWS registers: at a similarity of 0.8 a pair meets in some band with
#: probability 1 - (1 - 0.8^7)^20 = 0.991, at 0.85 with 0.9994, at 0.25 with 0.0012.
BANDS, ROWS, SEED = 20, 7, 20160101
#: Bits of the hash of a band, and of the first part of a class's key. Chance meetings are compared and dropped
#: like any others; among a billion classes they are half a million a band.
HASH_BITS = 40
MOST_TOKENS = (1 << 23) - 1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (Steele, Lea, Flood 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1 << 20)
def token_hash(token: str) -> int:
    """64 bits of a token."""
    return xxhash.xxh3_64_intdigest(token)


def prob_minhash(elements: np.ndarray, offsets: np.ndarray, registers: int, weights: np.ndarray | None = None, seed: int = SEED) -> np.ndarray:
    """Signatures of weighted sets by ProbMinHash (Ertl 2020), all sets of a batch at once.

    Set i has the distinct 64-bit ``elements[offsets[i]:offsets[i + 1]]`` with positive
    ``weights`` (1 by default). Each element is a Poisson process of its weight as rate
    whose arrivals hit random registers; a register keeps the earliest arrival's element.
    Arrivals are drawn in rounds, and an element leaves as soon as its time exceeds the
    latest register of its set (early termination). The share of equal registers of two
    sets estimates their probability Jaccard similarity, with equal weights their Jaccard
    similarity. Empty sets have all registers 0.
    """
    n = len(offsets) - 1
    times = np.full(n * registers, np.inf)
    found = np.zeros(n * registers, dtype=np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    state = _mix(elements ^ np.uint64(seed))
    rate = np.ones(len(elements)) if weights is None else np.asarray(weights, dtype=float)
    at = np.zeros(len(elements))
    who = elements
    with np.errstate(over="ignore"):
        while len(owner):
            state = state + _GOLDEN
            bits = _mix(state)
            at = at - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            register = ((_mix(bits ^ _GOLDEN) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
            cell = owner * registers + register.astype(np.int64)
            better = at < times[cell]
            cell, when = cell[better], at[better]
            np.minimum.at(times, cell, when)
            won = times[cell] == when
            found[cell[won]] = who[better][won]
            going = at < times.reshape(n, registers).max(axis=1)[owner]
            owner, state, at, who, rate = owner[going], state[going], at[going], who[going], rate[going]
    return found.reshape(n, registers)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash of HASH_BITS per band of ``rows`` registers, different for different bands."""
    with np.errstate(over="ignore"):
        out = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLDEN + np.zeros((len(signatures), 1), dtype=np.uint64)
        for r in range(rows):
            out = _mix(out ^ signatures[:, r : bands * rows : rows]) + _GOLDEN
    return out & np.uint64((1 << HASH_BITS) - 1)


def bit_sketch(signatures: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 registers, as a 64-bit number a set.

    Two sets of similarity J agree in a share of (1 + J) / 2 of the bits.
    """
    return np.packbits((_mix(signatures[:, :64]) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64).ravel()


def most_differing_bits(threshold: float) -> int:
    """Bits that pairs of ``threshold`` differ in at most, but for fewer than one in a hundred thousand."""
    off = (1 - threshold) / 2
    most, left = -1, 1.0
    while left > 1e-5:
        most += 1
        left -= math.comb(64, most) * off**most * (1 - off) ** (64 - most)
    return most


def sketch_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, least: int, shortest: int, weighted: bool, step: int = 500) -> Iterator[pa.RecordBatch]:
    """(id, text, h) to (id, h, k1, k2, n, s, bands); texts with fewer than ``least`` tokens are left out."""
    for batch in batches:
        ids, texts, marks = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        for start in range(0, len(texts), step):
            kept, sets, counts, keys = [], [], [], []
            for i, text in enumerate(texts[start : start + step], start):
                tokens = [t for t in TOKEN.findall(text.lower()) if len(t) >= shortest]
                if weighted:
                    tally: dict[str, int] = {}
                    for t in tokens:
                        tally[t] = tally.get(t, 0) + 1
                    distinct = sorted((token_hash(t), c) for t, c in tally.items())
                    own = np.array([h for h, _ in distinct], dtype=np.uint64)
                else:
                    own = np.array(sorted(set(map(token_hash, set(tokens)))), dtype=np.uint64)
                if len(own) < max(1, least):
                    continue
                kept.append(i)
                sets.append(own)
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                if weighted:
                    counts.append(np.array([c for _, c in distinct], dtype=float))
            if not kept:
                continue
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            signed = prob_minhash(np.concatenate(sets), offsets, bands * rows, np.concatenate(counts) if weighted else None)
            hashes = band_hashes(signed, bands, rows).view(np.int64)
            key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(kept)),
                    marks.take(pa.array(kept)),
                    pa.array(key[:, 0] & ((1 << HASH_BITS) - 1)),
                    pa.array(key[:, 1]),
                    pa.array(np.diff(offsets).astype(np.int32)),
                    pa.array(bit_sketch(signed)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * bands), pa.array(hashes.ravel())),
                ],
                names=["id", "h", "k1", "k2", "n", "s", "bands"],
            )


def token_set(text: Column, shortest: int = 3) -> Column:
    """The distinct tokens of a text: runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) >= shortest))


class NearDuplicates:
    """Links and groups of records whose token sets are similar.

    ``id`` and ``text`` name columns of ``df``; further columns, whatever their names, play
    no part. Rows with a null id or text, and texts with fewer than ``least`` distinct
    tokens (so empty ones, and texts without a letter or digit), have no links and are in
    no group. Rows that repeat an id count once (of different texts under one id each takes
    part). An empty table has no links.

    ``weighted=True`` gives tokens their count as weight in the candidate search, for use
    with a threshold on counts; verification is on sets either way.

    Exact copies (equal token sets) are one class from the first shuffle on, with map-side
    combining, so a text copied a million times costs one row in the search. Bands of
    classes meet by their hash, hot ones in blocks (blocks.py). Pairs that meet are
    compared by size and by 64 bits of their signatures; those that pass are verified by
    the exact similarity of their token sets.
    """

    def __init__(self, df: DataFrame, id: str = "review_id", text: str = "text", threshold: float = 0.8, least: int = 12, shortest: int = 3, bands: int = BANDS, rows: int = ROWS, weighted: bool = False):
        ship(df.sparkSession)
        self.threshold, self.shortest = threshold, shortest
        self.source = df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").withColumn("h", F.xxhash64("text"))
        id_type = self.source.schema["id"].dataType.simpleString()
        sketch = lambda it: sketch_batches(it, bands, rows, least, shortest, weighted)
        sketched = spread(self.source).mapInArrow(sketch, f"id {id_type}, h long, k1 long, k2 long, n int, s long, bands array<long>")
        # a row for each row that takes part; (k1, k2) is its class, and equal classes have equal bands
        sketched = written(sketched, "sketch")
        self.rows = written(sketched.select("k1", "k2", "id", "h"), "members")
        self.classes = written(sketched.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.first("bands").alias("bands"), F.min(F.struct("id", "h")).alias("rep")), "classes")
        discard(sketched)

    def members(self) -> DataFrame:
        """(k1, k2, id), distinct."""
        return self.rows.select("k1", "k2", "id").distinct()

    def class_links(self) -> DataFrame:
        """(a1, a2, b1, b2, similarity): similar classes of different token sets, each pair once."""
        kept = self.threshold
        # the number of tokens lies above the key's HASH_BITS, up to a bound that only loosens the comparison of sizes
        packed = F.col("k1").bitwiseOR(F.shiftleft(F.least("n", F.lit(MOST_TOKENS)).cast("long"), HASH_BITS)).alias("kn")
        banded = self.classes.select(F.explode("bands").alias("band"), packed, "s")
        met = block_pairs(banded, ["band"], "kn", ["s"])
        number = lambda c: F.shiftrightunsigned(c, HASH_BITS)
        key = lambda c: F.col(c).bitwiseAND(F.lit((1 << HASH_BITS) - 1)).alias(f"k1_{c[-1]}")
        sized = F.least(number("kn_a"), number("kn_b")) >= F.lit(kept) * F.greatest(number("kn_a"), number("kn_b"))
        near = met.where(sized & (F.bit_count(F.col("s_a").bitwiseXOR(F.col("s_b"))) <= most_differing_bits(kept))).select(key("kn_a"), key("kn_b"))
        candidates = written(near.distinct(), "candidates")
        ends = candidates.select(F.explode(F.array("k1_a", "k1_b")).alias("k1")).distinct()
        wanted = written(self.classes.join(ends, "k1").select("k1", "k2", "rep.id", "rep.h"), "wanted")
        texts = semi(self.source, wanted, ["id", "h"]).dropDuplicates(["id", "h"]).join(wanted, ["id", "h"])
        sets = written(texts.select("k1", "k2", token_set(F.col("text"), self.shortest).alias("t")), "sets")
        a, b = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in sets.columns]) for x in "ab")
        both = candidates.join(a, "k1_a").join(b, "k1_b").withColumn("i", F.size(F.array_intersect("t_a", "t_b")))
        scored = both.withColumn("similarity", F.col("i") / (F.size("t_a") + F.size("t_b") - F.col("i")))
        return scored.where(F.col("similarity") >= kept).select(F.col("k1_a").alias("a1"), F.col("k2_a").alias("a2"), F.col("k1_b").alias("b1"), F.col("k2_b").alias("b2"), "similarity")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of different ids with similar texts."""
        members = self.members()
        copies = block_pairs(members, ["k1", "k2"], "id").select("id_a", "id_b")
        links = self.class_links()
        left = members.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("id").alias("x"))
        right = members.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("id").alias("y"))
        across = links.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).where("x <> y")
        ordered = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return copies.union(ordered).distinct()

    def groups(self) -> DataFrame:
        """(id, group_id, group_size): each id that has a similar other, with the least id of its connected group."""
        members = self.members()
        links = self.class_links().select(F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2")).alias("u"), F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")).alias("v"))
        root = components(links).select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root")
        placed = members.join(root, ["k1", "k2"], "left").select("id", F.coalesce("root", F.struct("k1", "k2")).alias("root"))
        # an id with texts in several groups joins them: link its roots through it
        roots = placed.groupBy("id").agg(F.min("root").alias("first"), F.max("root").alias("last"))
        if not roots.where("first <> last").isEmpty():
            pairs = placed.join(roots.select("id", "first"), "id").where("root <> first").select(F.col("first").alias("u"), F.col("root").alias("v")).distinct()
            joined = components(pairs).select(F.col("node").alias("root"), F.col("root").alias("top"))
            placed = placed.join(joined, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        placed = placed.distinct()
        sizes = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        return placed.join(sizes, "root").select("id", "group_id", "group_size")

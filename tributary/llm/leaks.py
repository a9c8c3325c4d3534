"""Evaluation passages in training text: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import semi, ship, spread, written

WORD = re.compile(r"[^\W_]+")
#: Words of a seed, and words in a row that count as a leak.
GRAM, RUN = 5, 12
#: Share of a perfect score from which a document counts as holding an edited copy of the item: with three words of ten replaced some 0.55 is left.
EDITED = 0.4
#: Bits of the sieve that is sent to every executor: 2 to this power at most, 64 MB.
MOST_BITS = 29
#: Characters of all items that are sent to every executor at most; beyond that their texts are joined by shuffle.
SENT = 5_000_000
#: Words of documents that are aligned at once.
AT_ONCE = 32_768


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of letters and digits of the lower-cased text."""
    return np.array(list(map(_hashes.__getitem__, WORD.findall(text.lower()))) if text else [], dtype=np.uint64)


def grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A hash of each n words in a row."""
    if len(words) < n:
        return np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = (out ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sifted(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a bitmap of a power of two of bits."""
    if not len(hashes):
        return np.zeros(0, dtype=bool)
    bits = len(known).bit_length() + 2
    place = hashes.view(np.uint64) >> np.uint64(64 - bits)
    return (known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def align(item: np.ndarray, doc: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> tuple[int, int]:
    """(score, longest run): the best local alignment of two word sequences, and the most words in a row they share.

    Smith-Waterman with linear gap costs, a row of the matrix at a time: gaps along the row
    are a running maximum.
    """
    n = len(doc)
    score, run, best, longest = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32), 0, 0
    slope = np.arange(n + 1, dtype=np.int32) * gap
    for word in item:
        same = doc == word
        if same.any():
            run[1:] = np.where(same, run[:-1] + 1, 0)
            longest = max(longest, int(run.max()))
        else:
            run[:] = 0
        run[0] = 0
        down = np.maximum(score - gap, 0)
        down[1:] = np.maximum(down[1:], score[:-1] + np.where(same, match, -mismatch))
        score = np.maximum.accumulate(down + slope) - slope
        best = max(best, int(score.max()))
    return best, longest


def align_all(item: np.ndarray, docs: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """What ``align`` gives with its standard costs, for many documents at once.

    The documents lie end to end in one row of the matrix, each behind a column of its own. Cells are kept
    with a slope added that rises by one a word and by more than any score from document to document, so a
    running maximum is the gap along the row and never leaves its document. Without a match a row is closed already;
    with one, a score reaches no further than its own value, so doubling steps up to the row's greatest do.
    """
    scores, runs, at = [], [], 0
    vocabulary, words = np.unique(item, return_inverse=True)
    while at < len(docs):
        end, n = at + 1, len(docs[at])
        while end < len(docs) and n + len(docs[end]) <= AT_ONCE:
            n += len(docs[end])
            end += 1
        lengths = np.array([len(d) for d in docs[at:end]])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        slope = np.arange(n + len(lengths)) + np.repeat(np.arange(len(lengths)) * (2 * len(item) + 1), lengths + 1)
        slope = slope.astype(np.int32 if slope[-1] + 2 * len(item) < 2**31 else np.int64)
        column = np.delete(np.arange(len(slope)), starts)
        whole = np.concatenate(docs[at:end])
        code = np.minimum(np.searchsorted(vocabulary, whole), len(vocabulary) - 1)
        same = vocabulary[code] == whole
        column, code = column[same], code[same]
        column = column[np.argsort(code, kind="stable")]
        places = np.split(column, np.cumsum(np.bincount(code, minlength=len(vocabulary)))[:-1])
        cells, best, longest, run = slope.copy(), np.zeros_like(slope), np.zeros_like(slope), np.zeros_like(slope)
        below, spare, ran = np.empty_like(slope), np.empty_like(slope), places[0][:0]
        for word in words:
            here = places[word]
            matched, length = cells[here - 1] + 3, run[here - 1] + 1
            np.subtract(cells, 1, out=below)
            np.maximum(below[1:], cells[:-1], out=below[1:])
            np.maximum(below, slope, out=below)
            run[ran] = 0
            if len(here):
                matched = np.maximum(below[here], matched)
                below[here] = matched
                matched -= slope[here]
                run[here] = length
                best[here] = np.maximum(best[here], matched)
                longest[here] = np.maximum(longest[here], length)
                step, reach = 1, int(matched.max())
                while step < reach:
                    spare[:step] = below[:step]
                    np.maximum(below[step:], below[:-step], out=spare[step:])
                    below, spare, step = spare, below, 2 * step
            cells, below, ran = below, cells, here
        scores += np.maximum.reduceat(best, starts).tolist()
        runs += np.maximum.reduceat(longest, starts).tolist()
        at = end
    return scores, runs


class LeakSearch:
    """Which documents contain passages of which items, whole or in part.

    Seeds are n-grams of five words. Of every RUN consecutive words of an item the
    n-gram in the fewest documents (counted over all documents; ties by hash) is a seed,
    so any RUN words in a row that a document shares with the item hold one of its seeds: no such leak is missed,
    and phrases that half the corpus has make candidates only where an item has nothing rarer.
    Documents and items that share a seed are aligned whole. An edit can break the seeds of all windows it
    touches, so copies without RUN words in a row are sure to be aligned only by ``alignments(edited=True)``: there every
    pair that shares any n-gram is aligned, however many documents have it.

    Null and empty texts, texts of fewer than five words and null ids take part in nothing. Items under
    RUN words can have a score but no run of RUN words. Rows that repeat an id count each; their best
    alignment holds. Documents' n-grams are sifted by a bitmap of the items' before anything is shuffled.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", sent: int = SENT, most_bits: int = MOST_BITS):
        self.spark = docs.sparkSession
        ship(self.spark)
        self.sent, self.most_bits = sent, most_bits
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).dropna()
        self.items = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).dropna()
        self.kinds = [x.schema[c].dataType.simpleString() for x, c in ((self.docs, "doc_id"), (self.items, "item_id"))]

    def item_grams(self) -> DataFrame:
        """(item_id, row, pos, gram); row: a hash of the text, as rows may repeat an id."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                found = [grams(word_hashes(t)) for t in texts]
                own = np.array([xxhash.xxh3_64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64)
                rows = np.repeat(np.arange(len(found)), [len(g) for g in found])
                pos = np.concatenate([*(np.arange(len(g)) for g in found), np.empty(0, dtype=np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(own[rows]), pa.array(pos), pa.array(np.concatenate([*found, np.empty(0, dtype=np.int64)]))], names=["item_id", "row", "pos", "gram"])

        return written(self.items.mapInArrow(work, f"item_id {self.kinds[1]}, row long, pos int, gram long"), "item-grams")

    def sieve(self, item_grams: DataFrame) -> np.ndarray:
        """A bitmap of the items' n-grams, 64 bits to each and at most 2 ** MOST_BITS in all, so of a bounded size at any number of items.

        A foreign n-gram passes with a probability of n-grams over bits, so more pass as items grow beyond the bound; what passes is joined exactly. The
        bitmap is put together on executors in parts of 4 KB.
        """
        grams_ = item_grams.select("gram").distinct()
        bits = min(self.most_bits, max(20, math.ceil(math.log2(64 * max(1, grams_.count())))))
        # the functions number bits from 1
        place = (F.shiftrightunsigned("gram", 64 - bits) + 1).alias("place")
        parts = grams_.select(place).groupBy(F.expr("bitmap_bucket_number(place)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("map"))
        out = np.zeros(2**bits // 8, dtype=np.uint8)
        for r in parts.collect():  # at most 2 ** MOST_BITS bits
            out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.map), dtype=np.uint8)
        return out

    def hits(self, item_grams: DataFrame) -> DataFrame:
        """(doc_id, gram), distinct within a document: n-grams that a document shares with any item, and a few more that passed the sieve."""
        sent = self.spark.sparkContext.broadcast(self.sieve(item_grams))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for batch in batches:
                rows, out = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    g = grams(word_hashes(t))
                    g = np.unique(g[sifted(g, known)])
                    if len(g):
                        rows.append(np.full(len(g), i))
                        out.append(g)
                if out:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(out))], names=["doc_id", "gram"])

        return written(spread(self.docs).mapInArrow(work, f"doc_id {self.kinds[0]}, gram long"), "hits")

    def candidates(self) -> DataFrame:
        """(doc_id, item_id): pairs that share a seed."""
        item_grams = self.item_grams()
        hits = self.hits(item_grams)
        spread_of = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        placed = item_grams.join(spread_of, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        # the windows of n-grams that RUN words hold; shorter items are one window
        span = RUN - GRAM
        by = Window.partitionBy("item_id", "row").orderBy("pos")
        rarest = F.min(F.struct("df", "gram")).over(by.rowsBetween(0, span))
        n = F.max("pos").over(Window.partitionBy("item_id", "row"))
        chosen = placed.withColumns({"best": rarest, "last": n}).where(F.col("pos") <= F.greatest(F.col("last") - span, F.lit(0)))
        seeds = chosen.select("item_id", F.col("best.gram").alias("gram")).distinct()
        return written(hits.join(seeds, "gram").select("doc_id", "item_id").distinct(), "leak-candidates")

    def alignments(self, edited: bool = False) -> DataFrame:
        """(doc_id, item_id, score, run): of each candidate pair the alignment's share of a perfect score, and the most words in a row.

        ``edited``: of each pair that shares GRAM words in a row; without a shuffle of texts where the items hold at most SENT characters.
        """
        kinds = f"doc_id {self.kinds[0]}, item_id {self.kinds[1]}, score double, run int"
        chars = self.items.agg(F.sum(F.length("text"))).first()[0] or 0 if edited else 0
        if edited and chars <= self.sent:
            return self.best(spread(self.docs).mapInArrow(self.scorer(), kinds))
        if edited:
            item_grams = self.item_grams()
            candidates = written(self.hits(item_grams).join(item_grams.select("item_id", "gram").distinct(), "gram").select("doc_id", "item_id").distinct(), "leak-candidates")
        else:
            candidates = self.candidates()
        texts = semi(self.docs, candidates, ["doc_id"]).withColumnRenamed("text", "doc_text")
        both = candidates.join(texts, "doc_id").join(self.items.withColumnRenamed("text", "item_text"), "item_id")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for t, group in f.groupby("item_text", sort=False):
                    item = word_hashes(t)
                    scores, runs = align_all(item, [word_hashes(d) for d in group["doc_text"]])
                    yield group[["doc_id", "item_id"]].assign(score=np.array(scores) / (2.0 * len(item)), run=runs)

        spreaded = both.repartition(max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id", "item_id")
        return self.best(spreaded.mapInPandas(work, kinds))

    def scorer(self):
        """Aligns the documents of Arrow batches with all items whose n-grams they share."""
        kind = self.items.select("item_id").limit(0).toArrow().schema.field(0).type
        rows = [(r.item_id, word_hashes(r.text)) for r in self.items.collect()]
        rows = [(i, w) for i, w in rows if len(w) >= GRAM]
        found = [np.unique(grams(w)) for _, w in rows]
        every = np.concatenate([*found, np.empty(0, dtype=np.int64)])
        order = np.argsort(every, kind="stable")
        own, first = np.unique(every[order], return_index=True)
        holder = np.repeat(np.arange(len(rows)), [len(g) for g in found])[order]
        sent = self.spark.sparkContext.broadcast(([w for _, w in rows], pa.array([i for i, _ in rows], kind), own, np.append(first, len(every)), holder))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, ids, own, first, holder = sent.value
            for batch in batches if len(own) else ():
                words, sharing = {}, {}
                for d, t in enumerate(batch.column(1).to_pylist()):
                    w = word_hashes(t)
                    g = grams(w)
                    if len(g):
                        at = np.minimum(np.searchsorted(own, g), len(own) - 1)
                        at = np.unique(at[own[at] == g])
                        if len(at):
                            words[d] = w
                            for i in np.unique(np.concatenate([holder[first[a] : first[a + 1]] for a in at])).tolist():
                                sharing.setdefault(i, []).append(d)
                for i, docs in sharing.items():
                    scores, runs = align_all(items[i], [words[d] for d in docs])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(docs)), ids.take(pa.array([i] * len(docs))), pa.array(np.array(scores) / (2.0 * len(items[i]))), pa.array(runs, pa.int32())], names=["doc_id", "item_id", "score", "run"]
                    )

        return work

    @staticmethod
    def best(aligned: DataFrame) -> DataFrame:
        return aligned.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("run").alias("run"))

"""Abusive, hateful and sexual language: Levenshtein automata on a lexicon trie, scored in context."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import ship, spread, written

# General terms of abuse, hate, threat and explicit sex, without accents, in four languages.
# A term is a hint only; the words around it decide.
LEXICON = {
    "en": "arsehole asshole bastard bimbo bitch bollocks brainless cretin crackhead cunt degenerate dickhead dimwit dipshit dirtbag disgusting douchebag dumb dumbass dunce filthy freak fucker fucking fuckwit halfwit idiot imbecile jackass jerk loser lowlife moron motherfucker nutjob parasite pathetic pig prick retard rotten scum scumbag shithead slag slut stupid swine trash twat useless vermin wanker weasel whore worthless "
    "animals dirt foreigners immigrants infest infidels parasites plague rats savages sect subhuman "
    "beat beaten bleed break burn choke crush drown hang hurt kill knife murder shoot smash stab strangle teeth throat die dead rot "
    "blowjob boobs breasts cock cum dick erection fuck hardcore horny lick moan naked nude orgasm penis porn pussy sex strip suck thighs tits",
    "es": "asqueroso basura cabron cerdo estupido gilipollas hijo idiota imbecil inutil joder maricon matar mierda morir polla puta puto zorra",
    "fr": "abruti batard bite connard connasse conne crever cretin debile encule ordure pourri pute putain salaud sale salope tuer vermine merde",
    "de": "abschaum arsch arschloch dreck drecksau dummkopf fotze ficken fresse hure hurensohn miststuck sau schlampe scheisse schwein untermensch verpiss vollidiot wichser totet verprugelt",
}
# Letters of other scripts, and digits and signs, that stand for Latin letters.
LOOKALIKES = str.maketrans("абвгезікмнорсԁтухһјѕԛԝуαεικνορτυχ", "abbreзikmhopcdtyxhjsqwyaeikvoptux".replace("з", "3"))
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})

HIDDEN = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿]")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*])[^\W\d_])(?:\1[^\W\d_]){1,30}(?![^\W_])")
TOKEN = re.compile(r"[\w@$*!]+|[.?;:\n\"“”«»]")
STRETCH = re.compile(r"(.)\1{2,}")
#: Words to each side of a term that its window has.
SIDE = 7
#: Labelled documents, and characters of them, that the classifier is fitted on at most, least hash of the id first.
LABELLED, CHARACTERS = 20_000, 16_000_000
BUCKETS = 1 << 18


def fold(text: str) -> str:
    """Lower-cased, compatibility forms, accents, lookalikes and invisible characters undone."""
    text = text.lower()
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOKALIKES).replace("ß", "ss")
    return text


class Trie:
    """A lexicon as nested dictionaries; the empty key holds the term."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t


class Levenshtein:
    """The automaton of all strings within ``most`` edits of a word; ``*`` in the word stands for any letter.

    A state is the set of (position, edits) pairs that no other pair of the set covers,
    kept relative to its least position, so that the automata of all words share their
    transitions: one depends on the state, on which of the next 2 most + 1 letters of the word equal the character, and
    on how many letters are left. Transitions are made when first met. The automaton steps
    along the trie, so only branches of the lexicon within reach are entered.
    """

    _states: dict[int, list[tuple[tuple[int, int], ...]]] = {}
    _numbers: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    _moves: dict[tuple[int, int, int, int], tuple[int, int]] = {}

    def __init__(self, word: str, most: int):
        self.word, self.most, self.reach = word, most, 2 * most + 1
        self.start = (0, self._number(((0, 0),)))
        self.masks: dict[str, int] = {}

    def _number(self, pairs: tuple[tuple[int, int], ...]) -> int:
        numbers, states = self._numbers.setdefault(self.most, {}), self._states.setdefault(self.most, [])
        if pairs not in numbers:
            numbers[pairs] = len(states)
            states.append(pairs)
        return numbers[pairs]

    def _mask(self, char: str) -> int:
        if char not in self.masks:
            self.masks[char] = sum(1 << i for i, c in enumerate(self.word) if c == char or c == "*")
        return self.masks[char]

    def step(self, state: tuple[int, int], char: str) -> tuple[int, int] | None:
        """The state after a character, or None if no string from here is within reach."""
        base, number = state
        left = min(len(self.word) - base, self.reach)
        same = self._mask(char) >> base & ((1 << self.reach) - 1)
        key = (self.most, number, same, left)
        move = self._moves.get(key)
        if move is None:
            move = self._moves[key] = self._move(number, same, left)
        return None if move[1] < 0 else (base + move[0], move[1])

    def _move(self, number: int, same: int, left: int) -> tuple[int, int]:
        best: dict[int, int] = {}

        def offer(p: int, e: int) -> None:
            if e <= self.most and p <= left and best.get(p, e + 1) > e:
                best[p] = e

        for p, e in self._states[self.most][number]:
            offer(p, e + 1)
            offer(p + 1, e + 1)
            for skipped in range(self.most - e + 1):
                if p + skipped < left and same >> (p + skipped) & 1:
                    offer(p + skipped + 1, e + skipped)
                    break
        kept = [(p, e) for p, e in best.items() if not any(f < e and abs(p - q) <= e - f for q, f in best.items())]
        if not kept:
            return 0, -1
        base = min(p for p, _ in kept)
        return base, self._number(tuple(sorted((p - base, e) for p, e in kept)))

    def edits(self, state: tuple[int, int]) -> int | None:
        """Edits if the string ended here, or None if too many."""
        base, number = state
        rest = len(self.word) - base
        least = min(e + rest - p for p, e in self._states[self.most][number])
        return least if least <= self.most else None

    def search(self, trie: Trie) -> tuple[int, str] | None:
        """The nearest term of the lexicon, of equally near ones the first in order."""
        best, todo = None, [(trie.root, self.start)]
        while todo:
            node, state = todo.pop()
            for char, below in node.items():
                if char == "":
                    edits = self.edits(state)
                    if edits is not None and (best is None or (edits, below) < best):
                        best = (edits, below)
                elif following := self.step(state, char):
                    todo.append((below, following))
        return best


def edits_allowed(word: str) -> int:
    """By length, so that short words don't turn into each other."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


@dataclass
class Model:
    """A fitted scorer: terms, ordinary words (never taken for misspelled terms), weights."""

    terms: list[str]
    ordinary: set[str]
    weights: np.ndarray
    bias: float


class Reader:
    """Texts to windows around terms, with the features of each."""

    def __init__(self, terms: list[str], ordinary: set[str]):
        self.trie, self.terms, self.ordinary = Trie(terms), set(terms), ordinary
        # a word that is longer by more than the edits allowed can't be within reach of any term
        self.longest = max(map(len, terms), default=0)
        self.known: dict[str, str] = {}

    def canonical(self, token: str) -> str:
        """The term that a token is or misspells (marked ``=``, misspelled ``~``), else the token."""
        known = self.known.get(token)
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
            known = self.known[token] = self._canonical(token)
        return known

    def _canonical(self, token: str) -> str:
        word = token.strip("!$*") if not re.search(r"\w[@$*!]|[@$*!]\w", token.strip("!")) else token.rstrip("!")
        if word in self.terms:
            return "=" + word
        if not word:
            return token
        if word in self.ordinary:
            return word
        short = STRETCH.sub(r"\1", word) if "*" not in word else word
        plain = short.translate(LEET) if re.search(r"[a-z]", short) else short
        for form in (short, plain):
            if form in self.terms:
                return "~" + form
            if form in self.ordinary:
                return form
        if not re.search(r"[a-z]", plain) or len(plain) > self.longest + 2:
            return word
        masked = plain.count("*")
        found = Levenshtein(plain, 0 if masked else edits_allowed(plain)).search(self.trie) if masked < len(plain) - 1 else None
        return "~" + found[1] if found else word

    def tokens(self, text: str) -> list[str]:
        text = SPACED.sub(lambda m: m.group().replace(m.group(1), ""), fold(text))
        return TOKEN.findall(text)

    def windows(self, text: str) -> list[list[str]]:
        """The features of the window around each term: words and pairs up to SIDE words away within the sentence."""
        words = list(map(self.canonical, self.tokens(text)))
        hits = [i for i, w in enumerate(words) if w[0] in "=~"]
        return [self._features(words, i) for i in hits]

    @staticmethod
    def _features(words: list[str], at: int) -> list[str]:
        low = at
        while low > 0 and at - low < SIDE and words[low - 1] not in ".?;\n":
            low -= 1
        high = at + 1
        while high < len(words) and high - at <= SIDE and words[high] not in ".?;\n":
            high += 1
        quoted = sum(w in "\"“”«»" for w in words[max(0, at - SIDE) : at]) % 2
        own = [w.lstrip("=~") if not w.isdigit() else "0" for w in words[low:high]]
        term = words[at].lstrip("=~")
        pairs = [f"{a} {b}" for a, b in zip(own, own[1:])]
        return [f"t:{term}", f"m:{words[at][0]}", f"q:{quoted}", *{f"w:{w}" for w in own}, *{f"p:{p}" for p in pairs}]


def bucket(feature: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(feature) % BUCKETS


class _Buckets(dict):
    def __missing__(self, feature: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[feature] = bucket(feature)
        return value


def _fit_weights(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, bias: float, rounds: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by diagonal-scaled gradient steps (Adagrad), from given weights."""
    lengths = np.array([len(r) for r in rows])
    columns, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    used, column = np.unique(columns, return_inverse=True)
    w, memory, b, b_memory = weights[used], np.full(len(used), 1e-8), bias, 1e-8
    scale = 1 / np.sqrt(lengths)
    for _ in range(rounds):
        z = np.bincount(owner, w[column], len(rows)) * scale + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(column, (error * scale)[owner], len(used)) / len(rows) + penalty * w / math.sqrt(len(rows))
        memory += grad**2
        w = w - 0.5 * grad / np.sqrt(memory)
        g = error.mean()
        b_memory += g**2
        b -= 0.5 * g / math.sqrt(b_memory)
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


def fit(texts: list[str], labels: np.ndarray, passes: int = 4) -> Model:
    """A model from labelled texts (1 abusive, 0 not).

    Words that clearly mark abusive texts join the lexicon. A text is a bag of windows:
    at first all windows of an abusive text count as abusive, in later passes those that
    come near its highest, unless that is low (readers err). Left out then are its other windows that
    are scored high, and those scored very high in texts judged harmless.
    """
    base = sorted({t for words in LEXICON.values() for t in words.split()})
    plain = Reader([], set())
    bags = [set(w for w in plain.tokens(t) if w[0].isalpha()) for t in texts]
    yes = Counter(w for b, y in zip(bags, labels) if y for w in b)
    no = Counter(w for b, y in zip(bags, labels) if not y for w in b)
    n_yes, n_no = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    learned = [w for w, c in yes.items() if c >= 5 and len(w) > 2 and (c / n_yes) > 10 * ((no[w] + 1) / n_no)]
    terms = sorted({*base, *learned})
    ordinary = {w for w, c in no.items() if c >= 3}
    reader = Reader(terms, ordinary)
    hashed = _Buckets()
    found = [[np.fromiter(map(hashed.__getitem__, f), np.int64) for f in reader.windows(t)] for t in texts]
    rows = [r for bag in found for r in bag]
    owner = np.repeat(np.arange(len(found)), [len(b) for b in found])
    weights, bias = np.zeros(BUCKETS), 0.0
    if rows and 0 < labels.sum() < len(labels):
        target, sure = labels[owner].astype(float), np.ones(len(rows), dtype=bool)
        for _ in range(passes):
            kept = np.flatnonzero(sure)
            weights, bias = _fit_weights([rows[i] for i in kept], target[kept], weights, bias)
            scores = _score(rows, weights, bias)
            odds = np.log(scores / (1 - scores))
            top = np.full(len(found), -99.0)
            np.maximum.at(top, owner, odds)
            abusive = (labels[owner] == 1) & (top[owner] >= -1) & (odds >= top[owner] - 3)
            target = abusive.astype(float)
            sure = np.where(labels[owner] == 1, abusive | (scores < 0.5), scores < 0.95)
    return Model(terms, ordinary, weights, bias)


def _score(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    lengths = np.array([len(r) for r in rows])
    z = np.bincount(np.repeat(np.arange(len(rows)), lengths), weights[np.concatenate(rows)], len(rows)) / np.sqrt(lengths) + bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class AbuseScores:
    """A score from 0 to 1 for each document, and the rate of each source.

    The score is that of the highest window around a term; texts without any term, empty and null
    texts score 0. The classifier is fitted on at most ``labelled`` judged documents (those whose
    readers agree), collected by the driver; everything else is a scan of the documents without a shuffle.
    Without labels of both kinds no window is known to be abusive and all score 0.5 or 0.
    Ids that repeat are scored each; labels of unknown or null ids are ignored.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED, characters: int = CHARACTERS):
        ship(docs.sparkSession)
        self.docs, self.id, self.text = docs, id, text
        judged = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.avg(label).alias("y")).where("y = 0 or y = 1")
        chosen = judged.orderBy(F.xxhash64("_id"), "_id").limit(labelled)
        own = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(chosen), "_id")
        own = written(own.groupBy("_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("_id", F.xxhash64("_id").alias("_h"), "y", "text"), "labelled")
        sizes = own.select("_h", F.length("text").alias("n")).toPandas().sort_values(["_h", "n"])
        fits = int((sizes["n"].cumsum() <= characters).sum())
        rows = (own if fits == len(sizes) else own.where(F.col("_h") < F.lit(int(sizes["_h"].iloc[fits])))).select("text", "y").toPandas()
        model = fit(rows["text"].tolist(), rows["y"].to_numpy(dtype=float))
        self.model = docs.sparkSession.sparkContext.broadcast(model)

    def scores(self, keep: list[str] = ()) -> DataFrame:
        """(id, score, *keep): ``keep`` names columns of the documents."""
        model = self.model
        rows = spread(self.docs.select(F.col(self.id).alias("id"), F.col(self.text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m: Model = model.value
            reader, hashed = Reader(m.terms, m.ordinary), _Buckets()
            for batch in batches:
                scores = []
                for t in batch.column(1).to_pylist():
                    found = [np.fromiter(map(hashed.__getitem__, f), np.int64) for f in reader.windows(t)] if t else []
                    scores.append(float(_score(found, m.weights, m.bias).max()) if found else 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["id", "score", *batch.schema.names[2:]])

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        out = rows.mapInArrow(work, ", ".join([f"id {kinds['id']}, score double", *(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep)))]))
        return out.select("id", "score", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])

    def rates(self, source: str = "source", threshold: float = 0.5) -> DataFrame:
        """(source, n_docs, n_abusive, rate, mean_score); a null source is a group."""
        flagged = F.count_if(F.col("score") >= threshold)
        return self.scores([source]).groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_abusive"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))

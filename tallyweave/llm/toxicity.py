"""Operator 1, toxicity: a lexicon trie, Levenshtein automata, context windows.

fitted() learns from a bounded sample of labelled rows (PER_LABEL rows of each,
those with the smallest hash of their id): terms and stems that tell toxic from
clean documents, words that look like misspelled terms but are clearly more
frequent in clean documents than in toxic ones, and the weights of a few
features. Copies count once while terms are learned. What it reads of a document
is its text alone. Words are counted where the sample lies; the driver gets the
terms that are frequent enough to be learned, their near neighbours and a few
numbers for each sampled document, however long the documents are.

scored() walks every distinct word of every whole text through the automata
(levenshtein.py) where the text is read; nothing is shuffled. A hit's context
decides what it counts for: within quotation marks or after a reporting word it
counts little, near a word of address it counts more. The score is logistic in
the strongest hits and their sum, and so lies between 0 and 1. Quotation marks are
looked up by bisection, so a line may be as long as it likes and all of it hits.

Null and empty texts have no hits and the score of a text without any. Labels
that are null, and labels of documents that are not there, are not used; a
document labelled twice is toxic if one label says so. Without a toxic label
the built-in terms and weights stand. Repeated rows give repeated rows; further
columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, checkpointed, column, each_text, table, united
from .levenshtein import Lexicon

#: Labelled rows of label 1 and of label 0 that a fit reads, at most.
PER_LABEL = (3000, 6000)
#: Half the likelihood ratio statistic that a term needs (about one chance in ten million, as very many are tried), and its share of toxic among balanced documents.
SURE, PURE = 16.0, 0.97
SHORTEST_STEM = 4
#: A term near so many innocent words has no misspellings that could be told from words; a word is innocent if its share of clean documents is so many times that of toxic ones.
CROWDED, INNOCENT = 3, 2.0
#: Characters of words that a worker keeps answers for; a longer word is walked each time.
CACHE_CHARACTERS, LONGEST_KEPT = 8 << 20, 64
WINDOW = 6

WORDS = re.compile(r"[^\W_]+")
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "trash", "clown")
REPORTING = frozenset("said says saying called calls calling word words term quote quoted quotes slur insult insults wrote writes sagte sagt nannte wort dit disait mot dijo dice palabra".split())
ADDRESS = frozenset("you your youre yourself du dich dein euch tu toi vous te usted vosotros".split())
QUOTES = {"\"": "\"", "“": "”", "„": "“", "«": "»", "‘": "’"}
_MARKS = ("\n", *dict.fromkeys([*QUOTES, *QUOTES.values()]))
_ANY_MARK = re.compile("[" + "".join(_MARKS) + "]")
LEET = str.maketrans("01345789", "oieastbg")
REPEATED = re.compile(r"(.)\1{2,}")

#: Bias, then the strongest exact, stem and fuzzy hit, the log of the sum, the log of quoted hits: where fitting starts from and is held to.
PRIOR = np.array([-4.0, 5.0, 5.0, 4.5, 1.0, -0.5])
HELD = 0.05


@dataclass(frozen=True)
class Model:
    stems: tuple[str, ...]
    terms: tuple[str, ...]
    exactly: frozenset[str]
    known: frozenset[str]
    weights: tuple[float, ...]


class Words(dict):
    """What a word is: None, "exact", "stem" or "fuzzy"; a cache emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.lexicon, self.terms, self.known = Lexicon(model.stems, model.terms, model.exactly), frozenset(model.terms), model.known
        self.held = 0

    def __missing__(self, word: str) -> str | None:
        kind = self._kind(word)
        if len(word) <= LONGEST_KEPT:
            # An entry costs some 60 characters besides its own.
            self.held += len(word) + 60
            if self.held > CACHE_CHARACTERS:
                self.clear()
                self.held = len(word) + 60
            self[word] = kind
        return kind

    def _kind(self, word: str) -> str | None:
        found = self.lexicon.match(word)
        if found is None and not word.isalpha() and not word.isdigit():
            found = self.lexicon.match(word.translate(LEET))
            found = found and ("term", 1)
        if found is None and REPEATED.search(word):
            found = self.lexicon.match(REPEATED.sub(r"\1", word))
            found = found and ("term", 1)
        if found is None:
            return None
        if found == ("term", 0):
            return "exact"
        if found[0] == "stem":
            return "stem"
        return None if word in self.known else "fuzzy"


@lru_cache(1)
def _words(model: Model) -> Words:
    return Words(model)


def words_of(model: Model) -> Words:
    """One for all tasks of a worker, whatever the weights."""
    return _words(replace(model, weights=()))


class Marks:
    """Where the quotation marks and line ends of a text are."""

    def __init__(self, text: str):
        self.at: dict[str, list[int]] = {c: [] for c in _MARKS}
        for m in _ANY_MARK.finditer(text):
            self.at[m.group()].append(m.start())

    def _before(self, c: str, place: int) -> int:
        """The last c before a place, -1 if there is none."""
        k = bisect_left(self.at[c], place)
        return self.at[c][k - 1] if k else -1

    def quoted(self, start: int, end: int) -> bool:
        """Whether a quotation mark opened on this line before the hit is closed after it."""
        line, ends = self._before("\n", start), self.at["\n"]
        k = bisect_left(ends, end)
        last = ends[k] if k < len(ends) else math.inf
        for opening, closing in QUOTES.items():
            at = self.at[closing]
            k = bisect_left(at, end)
            if k == len(at) or at[k] > last:
                continue
            if opening == closing:
                inside = (bisect_left(at, start) - bisect_left(at, line + 1)) % 2 == 1
            else:
                opened = self._before(opening, start)
                inside = opened > line and opened > self._before(closing, start)
            if inside:
                return True
        return False


def features(text: str | None, words: Words) -> tuple[np.ndarray, int, int]:
    """The features of PRIOR; numbers of hits and of those that are quoted or reported."""
    out = np.zeros(len(PRIOR))
    out[0] = 1
    low = (text or "").lower()
    hits = {w for w in set(WORDS.findall(low)) if words[w]}
    if not hits:
        return out, 0, 0
    spans, marks = [m.span() for m in WORDS.finditer(low)], Marks(low)
    told = [low[a:b] for a, b in spans]
    strongest, total, aside, n = {"exact": 0.0, "stem": 0.0, "fuzzy": 0.0}, 0.0, 0, 0
    for i, w in enumerate(told):
        if w in hits:
            near = told[max(0, i - WINDOW) : i + WINDOW + 1]
            weight = 1.0
            if marks.quoted(*spans[i]):
                weight = 0.25
            elif not REPORTING.isdisjoint(told[max(0, i - WINDOW) : i]):
                weight = 0.5
            aside += weight < 1
            if not ADDRESS.isdisjoint(near):
                weight *= 1.5
            strongest[words[w]] = max(strongest[words[w]], weight)
            total += weight
            n += 1
    out[1:] = *strongest.values(), math.log1p(total), math.log1p(aside)
    return out, n, aside


def _stems(words: Iterable[str]) -> set[str]:
    return {w[:n] for w in words for n in range(SHORTEST_STEM, min(len(w), 12) + 1)}


def grams(words: Iterable[str]) -> set[str]:
    """What of a document may be learned: whole words, marked =, and stems, marked ^."""
    return {f"={w}" for w in words if len(w) >= 3} | {f"^{x}" for x in _stems(words)}


def evidence(t: int, c: int, nt: int, nc: int) -> float:
    """Half the likelihood ratio statistic of t of nt toxic against c of nc clean documents, 0 if it isn't pure enough."""
    if t < 3 or t / nt < PURE * (t / nt + c / max(nc, 1)):
        return 0.0
    n, held = nt + nc, t + c
    cells = ((t, nt * held), (c, nc * held), (nt - t, nt * (n - held)), (nc - c, nc * (n - held)))
    return sum(k * math.log(k * n / e) for k, e in cells if k)


def learned_terms(read: DataFrame, nt: int, nc: int) -> tuple[list[str], list[str], set[str]]:
    """Stems, whole terms and the seeds that clean documents hold, from read (words, toxic).

    Only what toxic documents hold often enough to matter is counted in clean ones.
    """
    fewest = next((t for t in range(3, nt + 1) if evidence(t, 0, nt, nc) > SURE), nt + 1)

    def counted(label: int, pick: Callable[[set[str]], Iterable[str]]) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g for d in column(batch, "words") for g in pick(grams(d.as_py()))], pa.string())], ["g"])

        return by_batch(read.where(F.col("toxic") == label).select("words"), "g string", run).groupBy("g").agg(F.count("*").alias("n"))

    toxic = {r["g"]: r["n"] for r in counted(1, lambda g: g).where(F.col("n") >= fewest).collect()}
    asked = frozenset(toxic) | {f"={w}" for w in SEEDS}
    clean = {r["g"]: r["n"] for r in counted(0, lambda g: g & asked).collect()}
    told = {g: e for g, t in toxic.items() if (e := evidence(t, clean.get(g, 0), nt, nc)) > SURE}
    stems, longer = set(), set()  # and all beginnings of the stems
    for g in sorted((g for g in told if g[0] == "^"), key=lambda g: (-told[g], -len(g), g)):
        stem = g[1:]
        if stem not in longer and not any(stem[:n] in stems for n in range(SHORTEST_STEM, len(stem))):
            stems.add(stem)
            longer.update(stem[:n] for n in range(1, len(stem) + 1))
    terms = [g[1:] for g in sorted((g for g in told if g[0] == "="), key=lambda g: (-told[g], g))]
    return sorted(stems), terms, {w for w in SEEDS if f"={w}" in clean}


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, held to PRIOR."""
    w, hold = PRIOR.copy(), HELD * len(y) ** 0.5
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), x.T @ (y - p) - hold * (w - PRIOR))
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = PER_LABEL) -> Model:
    """Learn from labels (doc_id, toxic) of documents that are not held out."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = docs.select("doc_id").join(usable, "doc_id").distinct()
    order = F.xxhash64("doc_id")
    chosen = ids.where("toxic = 1").orderBy(order, "doc_id").limit(per_label[0]).transform(united, ids.where("toxic = 0").orderBy(order, "doc_id").limit(per_label[1]))
    # Their number is bounded by per_label.
    sample = checkpointed(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"))

    def distinct_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        told = [sorted(set(WORDS.findall((t or "").lower()))) for t in each_text(column(batch, "text"))]
        # Copies share their least hashes of words.
        alike = [" ".join(str(min((xxhash.xxh32_intdigest(w, k) for w in d), default=0)) for k in range(3)) for d in told]
        return pa.RecordBatch.from_arrays([pa.array(told, pa.list_(pa.string())), pa.array(alike), column(batch, "toxic")], ["words", "alike", "toxic"])

    read = by_batch(sample, "words array<string>, alike string, toxic int", distinct_words)
    # Which of two copies stays is a matter of their words alone.
    read = checkpointed(read.groupBy("alike", "toxic").agg(F.min("words").alias("words")))
    n = {r["toxic"]: r["n"] for r in read.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return Model((), SEEDS, frozenset(), frozenset(), tuple(PRIOR))
    stems, terms, in_clean = learned_terms(read, n[1], n.get(0, 0))
    terms = list(dict.fromkeys([*terms, *(s for s in SEEDS if s not in in_clean)]))
    exactly, known = _misleading(terms, read, n[1], n.get(0, 0))
    model = Model(tuple(stems), tuple(terms), exactly, known, tuple(PRIOR))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(model)
        x = [features(t, words)[0].tolist() for t in each_text(column(batch, "text"))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), column(batch, "toxic")], ["x", "toxic"])

    read = by_batch(sample, "x array<double>, toxic int", measured).toPandas()
    return Model(model.stems, model.terms, exactly, known, tuple(fit_weights(np.stack([np.asarray(v) for v in read.x]), read.toxic.to_numpy(float))))


def _misleading(terms: list[str], read: DataFrame, nt: int, nc: int) -> tuple[frozenset[str], frozenset[str]]:
    """Terms that have several innocent words for neighbours, and the innocent neighbours of the others."""
    held: list[Lexicon] = []

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Lexicon((), terms))
        found = [(w, t) for d, t in zip(column(batch, "words").to_pylist(), column(batch, "toxic").to_pylist(), strict=True) for w in d if (m := held[0].match(w)) and m[1] > 0]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], pa.int32())], ["word", "toxic"])

    rows = by_batch(read.select("words", "toxic"), "word string, toxic int", near).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).collect()
    innocent = [r["word"] for r in rows if r["c"] / max(nc, 1) > INNOCENT * r["t"] / nt]
    lexicon, own = Lexicon((), terms), {}
    for w in innocent:
        for term, _ in lexicon.near(w):
            own.setdefault(term, []).append(w)
    exactly = {t for t, words in own.items() if len(words) >= CROWDED}
    return frozenset(exactly), frozenset(w for t, words in own.items() if t not in exactly for w in words)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, score, n_hits and n_aside (quoted or reported) for every row of docs."""
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(model)
        for batch in batches:
            found = [features(t, words) for t in each_text(column(batch, "text"))]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ weights))))) for x, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), pa.array(score, pa.float64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([a for _, _, a in found], pa.int64())],
                ["id", "score", "n_hits", "n_aside"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"id {kind}, score double, n_hits long, n_aside long")
    return out.withColumnRenamed("id", id_column)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, by one pass over them."""
    weights = np.array(model.weights)
    limit = math.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(model)
        for batch in batches:
            keep = [float(features(t, words)[0] @ weights) < limit for t in each_text(column(batch, "text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "n_aside")

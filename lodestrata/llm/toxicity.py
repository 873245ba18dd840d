"""Toxicity by maximum-scoring segments.

Lexicon: in how many labelled toxic and clean documents a feature occurs gives its log-odds
under a Dirichlet prior. Features are words (runs of letters, lower case) and their first 4 to 8
letters; every training row counts, copies too. Kept are all features with log-odds of 2 or more and
a z-score of 3 or more. They are written to files that the tasks map, known by a 64-bit hash, so no task holds the whole lexicon.

Scan: a token scores the highest log-odds among its features, any other token a small negative
drift. One pass finds all maximal scoring segments (Ruzzo and Tompa). The best segment of n clean words reaches
a score s with the chance 1 - exp(-K n e^(-lambda s)): lambda is the root of E[e^(lambda s)] = 1 over the tokens of the clean training
rows, and K is fitted to the best segments of those rows. Segments with a chance of at most 1 % are the toxic
passages. A document's evidence comes from its segments alone: with x = lambda s - ln(K n), it is ln(1 + e^x) of the best
one plus x of every other passage; a logistic law in ln(1 + evidence), fitted on the training documents, turns it into a probability.

Defined results: null and empty texts have evidence 0 and get the score of a text without any
passage; ``labels`` rows with a null label or doc_id teach nothing, and repeated ones count
once; without training rows of both labels every score is the share of toxic ones (0 without
any); an empty table gives an empty result; other columns of the input are kept by ``reject``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.arrays import reader, write_arrays
from lodestrata.llm.common import new_path, settle, table

PREFIXES = (4, 5, 6, 7, 8)
PRIOR, LEAST_ODDS, LEAST_Z = 0.5, 2.0, 3.0
THRESHOLD = 0.7
#: Least x of a passage: the chance of 1 - exp(-e^-x) is 1 % there.
SIGNIFICANT = -math.log(-math.log(1 - 0.01))
FEATURES_A_FILE = 1_000_000
#: Token scores are counted in bins of a sixteenth of a nat to find lambda.
BINS_A_NAT = 16
#: Up to so many labels (some 24 bytes each) are broadcast; more are joined by shuffling the texts.
FEW_LABELS = 1_000_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def features(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time.

    A candidate knows the nearest one before it whose left sum is smaller, so the search for that one jumps over those between.
    """
    starts: list[int] = []
    ends: list[int] = []
    left: list[float] = []  # sum before a candidate
    right: list[float] = []  # sum at its end
    smaller: list[int] = []  # the nearest one before it with a smaller left sum, or -1
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, j = i, before, len(left) - 1
        while j >= 0 and left[j] >= low:
            j = smaller[j]
        while j >= 0 and right[j] < total:
            start, low, before_it = starts[j], left[j], smaller[j]
            for some in (starts, ends, left, right, smaller):
                del some[j:]
            j = before_it
        starts.append(start)
        ends.append(i + 1)
        left.append(low)
        right.append(total)
        smaller.append(j)
    return [(a, z, r - x) for a, z, x, r in zip(starts, ends, left, right)]


def _hash(feature: str) -> int:
    """As Spark's xxhash64 of a string."""
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass"), 42)


class Lexicon:
    """feature -> log-odds, in files of sorted 64-bit hashes that every task maps; only their paths are told to the tasks."""

    def __init__(self, segments: list[tuple[int, str]]):
        self.first, self.paths = np.array([f for f, _ in segments], dtype=np.uint64), [p for _, p in segments]
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def many(self, features: list[str]) -> np.ndarray:
        """Log-odds of features, 0 for those that are not kept."""
        out = np.zeros(len(features))
        if not self.paths or not features:
            return out
        h = np.array([_hash(f) for f in features], dtype=np.uint64)
        of = np.searchsorted(self.first, h, side="right") - 1
        for i in np.unique(of[of >= 0]).tolist():
            if i not in self.open:
                load = reader(self.paths[i])
                self.open[i] = (load("hashes"), load("odds"))
            hashes, odds = self.open[i]
            mine = np.flatnonzero(of == i)
            at = np.minimum(np.searchsorted(hashes, h[mine]), len(hashes) - 1)
            out[mine] = np.where(hashes[at] == h[mine], odds[at], 0.0)
        return out

    def __contains__(self, feature: str) -> bool:
        return bool(self.many([feature])[0])

    def __getitem__(self, feature: str) -> float:
        return float(self.many([feature])[0])


def _lexicon(kept: DataFrame) -> Lexicon:
    """kept: feature, odds -> written by leading bits of the hash, some million features to a file pair."""
    spark = kept.sparkSession
    folder = new_path(spark, "toxic-lexicon")
    rows = settle(kept.select(F.xxhash64("feature").alias("h"), "odds"), "toxic-features")
    bits = (rows.count() // FEATURES_A_FILE).bit_length()
    segment = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")

    def write(key, pdf):
        h, odds = pdf["h"].to_numpy().view(np.uint64), pdf["odds"].to_numpy()
        order = np.argsort(h)
        return pd.DataFrame({"segment": [key[0]], "path": [write_arrays(folder, {"hashes": h[order], "odds": odds[order]})]})

    found = settle(rows.withColumn("segment", segment).groupBy("segment").applyInPandas(write, "segment long, path string"), "toxic-segments").collect()  # a row for each file pair
    return Lexicon(sorted((r.segment << (64 - bits) if bits else 0, r.path) for r in found))


class Model:
    """odds: a lexicon; drift: score of any other token; tail: lambda and K of the extreme-value law; law: slope and intercept."""

    def __init__(self, odds: Lexicon, drift: float, tail: tuple[float, float], law: tuple[float, float]):
        self.odds, self.drift, self.tail, self.law = odds, drift, tail, law
        self.cache: dict[str, float] = {}

    def scores(self, text: str | None) -> list[float]:
        """Of each word: the highest log-odds among its features, or 0."""
        ws, cache = words(text), self.cache
        new = [w for w in set(ws) if w not in cache]
        if new:
            if len(cache) > 300_000:
                cache.clear()
                new = list(set(ws))
            each = [features(w) for w in new]
            odds = self.odds.many([f for fs in each for f in fs])
            cache.update(zip(new, np.maximum.reduceat(odds, np.cumsum([0, *map(len, each[:-1])])).tolist()))
        return [cache[w] for w in ws]

    def segments(self, text: str | None) -> list[tuple[int, int, float]]:
        """Maximal segments as word ranges with x = lambda s - ln(K n): a text of n clean words has one of that or more with the chance 1 - exp(-e^-x)."""
        scores = self.scores(text)
        if max(scores, default=0.0) <= 0:
            return []
        rate, shift = self.tail[0], math.log(self.tail[1] * len(scores))
        return [(a, z, rate * s - shift) for a, z, s in maximal_segments([s if s > 0 else self.drift for s in scores])]

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        return [x for x in self.segments(text) if x[2] >= SIGNIFICANT]

    def evidence(self, text: str | None) -> tuple[float, int]:
        """(evidence, number of passages)."""
        found = sorted((x for _, _, x in self.segments(text)), reverse=True)
        if not found:
            return 0.0, 0
        others = [x for x in found[1:] if x >= SIGNIFICANT]
        return math.log1p(math.exp(min(found[0], 700.0))) + sum(others), len(others) + (found[0] >= SIGNIFICANT)


def _lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 over a clean text's tokens; 1, that of exact log-likelihood ratios, where there is none."""
    if (scores * share).sum() >= 0 or scores.max(initial=0.0) <= 0:
        return 1.0
    low, high = 0.0, 1.0
    over = lambda x: (share * np.exp(np.minimum(x * scores, 700.0))).sum() > 1
    while not over(high):
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept over (evidence, label, count) by Newton's method with a weak ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (y - p) * x).sum() - 0.1 * a, (n * (y - p)).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(train: DataFrame) -> Model:
    """train: text, toxic 0 or 1. Counts, lexicon and law come from all of its rows."""

    one = settle(train.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxic-train")

    def count(batches):
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(pdf["text"], pdf["toxic"]):
                for f in {f for w in set(words(text)) for f in features(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            if seen:
                yield pd.DataFrame({"feature": list(seen), "clean": [c for c, _ in seen.values()], "toxic": [t for _, t in seen.values()]})

    sizes = {r.toxic: r.n for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    if not nt or not nc:
        return Model(Lexicon([]), 0.0, (1.0, 1.0), (0.0, 40.0 if nt else -40.0))
    counts = one.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    pt, pc = (F.col("t") + PRIOR) / (nt + 2 * PRIOR), (F.col("c") + PRIOR) / (nc + 2 * PRIOR)
    z = (F.log(pt / (1 - pt)) - F.log(pc / (1 - pc))) / F.sqrt(1 / (F.col("t") + PRIOR) + 1 / (F.col("c") + PRIOR))
    kept = counts.withColumn("odds", F.log(pt / pc)).filter((F.col("odds") >= LEAST_ODDS) & (z >= LEAST_Z))
    odds = _lexicon(kept)
    tell = one.sparkSession.sparkContext.broadcast(Model(odds, 0.0, (1.0, 1.0), (0.0, 0.0)))

    def hits(batches):
        for pdf in batches:
            for y, part in pdf.groupby("toxic"):
                at = np.rint(np.array([x for t in part["text"] for x in tell.value.scores(t)]) * BINS_A_NAT)
                bins, n = np.unique(at, return_counts=True)
                yield pd.DataFrame({"toxic": y, "at": bins.astype(np.int64), "n": n})

    # a row for each label and bin of scores, some hundreds
    seen = one.mapInPandas(hits, "toxic int, at long, n long").groupBy("toxic", "at").agg(F.sum("n").alias("n")).collect()
    tokens = {y: sum(r.n for r in seen if r.toxic == y) for y in (0, 1)}
    share = {y: (sum(r.n for r in seen if r.toxic == y and r["at"] > 0) + 1) / (tokens[y] + 2) for y in (0, 1)}
    drift = min(math.log((1 - share[1]) / (1 - share[0])), -0.01)
    clean = sorted((r["at"], r.n) for r in seen if r.toxic == 0)
    rate = _lambda(np.array([a / BINS_A_NAT if a > 0 else drift for a, _ in clean]), np.array([n for _, n in clean]) / max(tokens[0], 1))
    tell = one.sparkSession.sparkContext.broadcast(Model(odds, drift, (rate, 1.0), (0.0, 0.0)))

    def tails(batches):
        for pdf in batches:
            some = [(len(words(t)), max((x for _, _, x in tell.value.segments(t)), default=None)) for t in pdf["text"]]
            # n exp(-lambda s) of a text's best segment: with K = 1 that is exp(-x), and n where there is no segment
            yield pd.DataFrame({"docs": [sum(n > 0 for n, _ in some)], "mass": [sum(float(n) if x is None else math.exp(-x) for n, x in some if n)]})

    # K n exp(-lambda s) has an exponential law of mean 1 over clean texts, so K is their number over the sum of the rest
    got = one.filter("toxic = 0").mapInPandas(tails, "docs long, mass double").agg(F.sum("docs").alias("docs"), F.sum("mass").alias("mass")).first()
    model = Model(odds, drift, (rate, got.docs / got.mass if got.docs and got.mass > 0 else 1.0), (0.0, 0.0))
    tell = one.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "at": [round(math.log1p(tell.value.evidence(t)[0]) * 32) for t in pdf["text"]]})

    # some hundred values for each label
    bins = one.mapInPandas(weigh, "toxic int, at int").groupBy("toxic", "at").count().collect()
    model.law = _logistic(np.array([r["at"] / 32 for r in bins]), np.array([r["toxic"] for r in bins], dtype=float), np.array([r["count"] for r in bins], dtype=float))
    return model


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with evidence, passages (their number) and score."""
    tell = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<evidence: double, passages: int>")
    def evidence(text: pd.Series) -> pd.DataFrame:
        got = [tell.value.evidence(t) for t in text]
        return pd.DataFrame({"evidence": [x for x, _ in got], "passages": [n for _, n in got]})

    a, b = model.law
    law = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) * F.log1p("_t.evidence") + F.lit(b)))))
    got = docs.select(*keep, evidence(F.coalesce("text", F.lit(""))).alias("_t"))
    return got.select(*keep, F.col("_t.evidence").alias("evidence"), F.col("_t.passages").alias("passages"), law.alias("score"))


def passages_of(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each toxic passage: doc_id, first and last word (from 0), its excess lambda s - ln(K n), its words."""
    tell = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words(text)
                out += [(i, a, z - 1, s, " ".join(ws[a:z])) for a, z, s in tell.value.passages(text)]
            yield pd.DataFrame(out, columns=["doc_id", "first_word", "last_word", "excess", "passage"])

    return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, first_word int, last_word int, excess double, passage string")


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of the rows that may teach: labelled 0 or 1, and not held out. Other labels say nothing."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = F.broadcast(marks) if labels.count() <= FEW_LABELS else marks.hint("merge")
    return docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"))).join(marks, "doc_id")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training(docs, table(spark, sf_dir, "labels")))
    got = scored(docs, model, ["doc_id"])
    return got.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")

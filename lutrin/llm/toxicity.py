"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Terms are whole words or word beginnings. A published-style base list gives a start; weights and
further terms (also for languages the base list does not know) are log odds counted on labelled rows,
and the step from weighted hits to a score in 0..1 is a small logistic regression.
Null and empty texts have no hits and get the score of a text without hits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.llm.common import long_rows, worker_value, written

BASE_TERMS = """idiot idiots moron morons stupid dumbass imbecile cretin loser losers scum scumbag trash garbage worthless
    pathetic disgusting clown clowns vermin filth bastard bitch whore slut asshole fuck fucking shit retard freak
    subhuman degenerate parasite pig swine coward liar""".split()
EXCEPTIONS = ("trash can", "trash bag", "trash collection", "garbage collection", "garbage collector", "garbage truck",
              "clown fish", "circus clown", "pathetic fallacy", "pond scum", "idiot proof", "sore loser rule",
              "bitch shield", "guinea pig", "pig iron", "pig farm")
#: Signs read as the letter they look like. i, l, 1 and | cannot be told apart and become one sign.
LOOKALIKES = str.maketrans(
    "0134578@$€|il" "аеорсухіѕјԁһӏкмтвн" "αοερτυνικχ" "áàâäãåéèêëíìîïóòôöõúùûüçñý",
    "oleastbaselll" "aeopcyxlsjdhlkmtbh" "aoeptuvlkx" "aaaaaaeeeellllooooouuuucny")
WORD = re.compile(r"[^\W_]+")
TRAIN_ROWS = 12_000
LEXICON_TERMS = 2_000
LEAST_SUPPORT = 3
LEAST_WEIGHT = 3.0
BASE_WEIGHT = 4.0
STEMS = (4, 5, 6)
THRESHOLD = 0.3
#: Logistic weights before any label is seen: constant, log weight sum, log weight sum per thousand words.
PRIOR = (-4.0, 2.0, 0.5)


def folded(text: str | None) -> str:
    """Lower case with look-alike signs and digits read as letters; the length is kept."""
    low = (text or "").lower()
    return low.translate(LOOKALIKES)


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights (a final * marks a word beginning), exception phrases and logistic weights."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    logistic: tuple[float, ...] = field(default=PRIOR)

    def automaton(self) -> ahocorasick.Automaton:
        entries: dict[str, list] = {}
        for term, weight in self.terms.items():
            key = folded(term.rstrip("*"))
            entry = entries.setdefault(key, [len(key), None, None, False])
            entry[1 + term.endswith("*")] = weight
        for phrase in self.exceptions:
            key = folded(phrase)
            entries.setdefault(key, [len(key), None, None, False])[3] = True
        a = ahocorasick.Automaton()
        for key, entry in entries.items():
            if key:
                a.add_word(key, tuple(entry))
        if entries:
            a.make_automaton()
        return a

    def hits(self, text: str | None, automaton: ahocorasick.Automaton) -> float:
        """Sum of the weights of the words hit, the best term of each word counting once."""
        text, best, excepted = folded(text), {}, []
        if not text or not len(automaton):
            return 0.0
        for end, (size, word, stem, exception) in automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            closed = end + 1 == len(text) or not text[end + 1].isalnum()
            if exception and closed:
                excepted.append((start, end))
            weight = max([w for w in (word if closed else None, stem) if w is not None], default=None)
            if weight is not None:
                best[start] = max(weight, best.get(start, 0.0))
        return float(sum(w for at, w in best.items() if not any(a <= at <= b for a, b in excepted)))


def _features(hit: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(hit)), np.log1p(hit), np.log1p(1000.0 * hit / np.maximum(words, 20))])


def _measured(texts: pd.Series, lexicon: Lexicon) -> np.ndarray:
    automaton = worker_value(f"toxic{hash(tuple(sorted(lexicon.terms.items())))}", lexicon.automaton)
    hit = np.array([lexicon.hits(x, automaton) for x in texts], float)
    return _features(hit, np.array([len((x or "").split()) for x in texts], float))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            words = set(WORD.findall(folded(text)))
            stems = {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            counts[toxic].update({w for w in words if 3 <= len(w) <= 24} | stems)
        keys = list(counts[0] | counts[1])
        if keys:
            yield pd.DataFrame({"term": keys, "t": [counts[1][k] for k in keys], "c": [counts[0][k] for k in keys]})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 0.05) -> np.ndarray:
    """Maximum a posteriori weights by Newton steps around the prior."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: int = LEXICON_TERMS) -> Lexicon:
    """Lexicon and logistic weights from at most `train_rows` labelled rows that are not held out.

    The rows are those with the smallest hash of doc_id. Terms are counted on one half of them,
    the logistic weights are fitted on the other. Without usable labels the base list stays.
    """
    chosen = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    rows = written(long_rows(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                   .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))))
    base = {t: BASE_WEIGHT for t in BASE_TERMS}
    total = rows.filter("half = 0").agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    learned = {}
    if total.t:
        counted = (rows.filter("half = 0").select("text", "toxic").mapInPandas(_counted, "term string, t long, c long")
                   .groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
        weight = F.log((F.col("t") + 0.5) / (total.t + 1.0)) - F.log((F.col("c") + 0.5) / (total.n - total.t + 1.0))
        best = (counted.withColumn("w", weight).filter((F.col("w") >= LEAST_WEIGHT) & (F.col("t") >= LEAST_SUPPORT))
                .orderBy(F.col("w").desc(), F.col("t").desc(), "term").limit(terms))
        learned = {r.term: float(r.w) for r in best.collect()}
        known = counted.filter(F.col("term").isin([folded(t) for t in base])).filter("c > t").collect()
        clean = {r.term for r in known}
        base = {t: w for t, w in base.items() if folded(t) not in clean}
    lexicon = Lexicon({folded(k.rstrip("*")) + "*" * k.endswith("*"): v for k, v in (base | learned).items()})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _measured(batch["text"], lexicon)
            yield pd.DataFrame({"x1": x[:, 1], "x2": x[:, 2], "toxic": batch["toxic"]})

    seen = rows.filter("half = 1").select("text", "toxic").mapInPandas(measured, "x1 double, x2 double, toxic int").toPandas()
    x = np.column_stack([np.ones(len(seen)), seen["x1"], seen["x2"]]).astype(float)
    weights = _logistic(x, seen["toxic"].to_numpy(float), np.array(PRIOR)) if len(seen) else np.array(PRIOR)
    return Lexicon(lexicon.terms, lexicon.exceptions, tuple(map(float, weights)))


def score(text: Column, lexicon: Lexicon) -> Column:
    """Score in 0..1 of every text; higher means more likely toxic."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        z = _measured(texts, lexicon) @ np.array(lexicon.logistic)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return scored(text)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept."""
    lexicon = fit(docs, labels)
    return docs.filter(score(F.col("text"), lexicon) < threshold)

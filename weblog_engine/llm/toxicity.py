"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns each word of a clause into a class: insult, threat,
target, negation, report or other. Grammar transducers read a clause's classes:
an insult on its own, an insult aimed at a target, a threat, a threat with a
target; negation and reported speech before an insult or threat turn the match
into its weaker forms. A matched pattern has a weight, and the document is
scored by its matched clauses, not by isolated words.

Insult words, as whole words and as stems, are learned from the labels: those
that toxic documents hold far more often than others. The patterns' weights are
a logistic fit on the same labelled rows. Both fits take a bounded sample of
``SAMPLE`` labelled documents per label. Threat, target, negation and report
words are fixed lists.

Cases: null and empty texts score like a text without any match. Documents
without labels are scored too; with no labels at all every score is 0 and
nothing is predicted. Texts are read whole, rows independently; labels that
repeat an id count once, with the greater mark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, prepare, saved

SAMPLE = 6000  # labelled documents of each label that the fits may take
STEMS = (4, 5, 6)  # lengths of the word beginnings that the lexicon may hold
LEXICON = 5000  # most learned words and stems of a fit, those of most toxic documents first

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# Words of the classes that are not learned, in four languages.
_WORDS = {
    THREAT: "kill hurt destroy burn beat smash crush murder töten umbringen schlagen zerstören tuer frapper détruire "
            "brûler matar golpear destruir quemar",
    TARGET: "you your you're u they them he she people everyone du dich dir dein ihr euch sie tu te toi ton vous votre "
            "ils tú ti tu usted ustedes ellos vosotros",
    NEGATION: "not no never none n't don't isn't aren't nicht kein keine nie ne pas jamais aucun no nunca ningún jamás",
    REPORT: "said says saying called calls wrote claimed quoted reported sagte sagt nannte schrieb dit disait écrit "
            "appelé dijo dice llamó escribió",
}
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CLAUSE = re.compile(r"[.!?;:\n]+")

# Patterns a clause can match; each clause counts under the strongest it matches.
PATTERNS = ("insult", "aimed_insult", "repeated_insult", "threat", "aimed_threat", "negated", "reported")
# The grammar as a deterministic automaton over classes. A state is what has
# been seen: a negation or report still in force, a target, and the match so far.
_NONE, _HIT, _AIMED, _MANY, _THREATENED, _AIMED_THREAT = range(6)
_REACH = 3  # words for which a negation holds


def match_clause(classes: list[int]) -> str | None:
    """The pattern of a clause's word classes, if any."""
    match, target, held, reported, weakened = _NONE, False, 0, False, None
    for c in classes:
        if c == NEGATION:
            held = _REACH
        elif c == REPORT:
            reported = True
        elif c == TARGET:
            target = True
            match = {_HIT: _AIMED, _THREATENED: _AIMED_THREAT}.get(match, match)
        elif c in (INSULT, THREAT):
            if held or reported:
                weakened = weakened or ("negated" if held else "reported")
            elif c == INSULT:
                match = _MANY if match in (_HIT, _AIMED, _MANY) else max(match, _AIMED if target else _HIT)
            else:
                match = max(match, _AIMED_THREAT if target else _THREATENED)
        if c != NEGATION and held:
            held -= 1
    return {_NONE: weakened, _HIT: "insult", _AIMED: "aimed_insult", _MANY: "repeated_insult",
            _THREATENED: "threat", _AIMED_THREAT: "aimed_threat"}[match]


class Grammar:
    """Lexicon, pattern weights and bias."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray | None = None, bias: float = 0.0):
        self.fixed = {w: c for c, words in _WORDS.items() for w in words.split()}
        self.insults, self.weights, self.bias = insults, weights, bias
        stems = [x[:-1] for x in insults if x.endswith("*")]
        words = [x for x in insults if not x.endswith("*")] + _WORDS[THREAT].split()
        # finds the clauses worth reading at all
        self.probe = re.compile(r"(?<!\w)" + _trie(words, stems))

    def insult(self, word: str) -> float:
        """Strength of a word as an insult, 0 if it is none."""
        best = self.insults.get(word, 0.0)
        for k in STEMS:
            if len(word) > k:
                best = max(best, self.insults.get(word[:k] + "*", 0.0))
        return best

    def classify(self, words: list[str]) -> tuple[list[int], float]:
        """Class of each word, and the strength of the strongest insult."""
        out, strength = [], 0.0
        for w in words:
            s = self.insult(w)
            if s:
                strength = max(strength, s)
                out.append(INSULT)
            else:
                out.append(self.fixed.get(w, OTHER))
        return out, strength

    def features(self, text: str | None) -> np.ndarray:
        """Per pattern the summed strength of the clauses that match it (a
        logarithm, so that length counts little), and their count."""
        sums = np.zeros(len(PATTERNS))
        text = (text or "").lower()
        if text:
            end, before = -1, 0
            ends = _CLAUSE.finditer(text)  # read along with the hits
            following = next(ends, None)
            for hit in self.probe.finditer(text):
                if hit.start() < end:
                    continue  # in a clause read already
                while following and following.end() <= hit.start():
                    before, following = following.end(), next(ends, None)
                end = following.start() if following else len(text)
                classes, strength = self.classify(_WORD.findall(text[before:end]))
                pattern = match_clause(classes)
                if pattern:
                    sums[PATTERNS.index(pattern)] += max(strength, 1.0)
        return np.log1p(sums)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-float(np.clip(self.features(text) @ self.weights + self.bias, -30, 30))))


def _trie(words: list[str], stems: list[str]) -> str:
    """A regular expression of the words (as whole words) and stems (with at
    least one more letter) as a prefix tree, so that scanning does not slow
    down with the lexicon."""
    root: dict = {}
    for x, tail in [*((w, "") for w in words), *((s, "*") for s in stems)]:
        node = root
        for ch in x:
            node = node.setdefault(ch, {})
        node[tail or "$"] = None

    def write(node: dict) -> str:
        sides = []
        if "*" in node and node["*"] is None:
            sides.append(r"\w")
        sides += [re.escape(ch) + write(child) for ch, child in sorted(node.items(), key=lambda x: x[0]) if child is not None]
        if "$" in node and node["$"] is None:
            sides.append(r"(?!\w)")
        return sides[0] if len(sides) == 1 else "(?:" + "|".join(sides) + ")"

    return write(root)


def _terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _grouped(df: DataFrame, run, schema: str) -> DataFrame:
    return df.select("text", "toxic").mapInArrow(run, schema)


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems of toxic documents, by their log odds. A stem is dropped
    for a shorter one that says as much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for t in _terms(text or ""):
                    counts.setdefault(t, [0, 0])[toxic] += 1
            if counts:
                no, yes = zip(*counts.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(yes, pa.int64()), pa.array(no, pa.int64())],
                                                 ["term", "yes", "no"])

    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    yes_all, no_all = sizes.get(1, 0), sizes.get(0, 0)
    if not yes_all or not no_all:
        return {}
    odds = F.log((F.col("yes") + 0.5) / (yes_all + 1)) - F.log((F.col("no") + 0.5) / (no_all + 1))
    terms = saved(_grouped(rows, run, "term string, yes long, no long").groupBy("term")
                  .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")), "terms")
    # a likelihood ratio that chance would hardly reach once among all terms
    rate = yes_all / (yes_all + no_all)
    n = F.col("yes") + F.col("no")
    part = lambda x, p: x * F.log(F.greatest(x, F.lit(1e-9)) / (n * p))
    gain = 2 * (part(F.col("yes").cast("double"), rate) + part(F.col("no").cast("double"), 1 - rate))
    found = terms.withColumn("odds", odds).where((gain >= 2 * math.log(terms.count() + 1)) & (F.col("odds") > math.log(10))) \
        .orderBy(F.col("yes").desc(), F.col("odds").desc(), "term").limit(LEXICON).collect()
    out: dict[str, float] = {}
    known = {r.term: r for r in found}
    for r in found:
        stem = r.term.rstrip("*")
        shorter = [known[stem[:k] + "*"] for k in STEMS if k < len(stem) and stem[:k] + "*" in known]
        if not shorter:
            out[r.term] = float(r.odds)
    return out


def fit(rows: DataFrame, odds_ratio: float = 1.0) -> Grammar:
    """The grammar of (text, toxic) rows. odds_ratio: odds of a toxic document
    where the grammar will serve, over those among the rows."""
    prepare(rows.sparkSession)
    insults = learn_lexicon(rows)
    if not insults:
        return Grammar({})
    grammar = Grammar(insults)
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            x = [g.features(t).round(3).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    counted = _grouped(rows, run, "x array<double>, toxic int").groupBy("x").agg(
        F.sum("toxic").alias("yes"), F.count(F.lit(1)).alias("n")).orderBy("x").collect()  # bounded by the sample
    x = np.array([r.x for r in counted])
    yes, n = (np.array([r[c] for r in counted], float) for c in ("yes", "n"))
    design = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(design.shape[1])
    penalty = np.append(np.full(x.shape[1], 0.5), 1e-3)
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        g = design.T @ (yes - n * p) - penalty * beta
        h = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        beta += np.clip(np.linalg.solve(h, g), -1, 1)
    return Grammar(insults, beta[:-1], float(beta[-1]) + math.log(odds_ratio))


def labelled(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(text, toxic): about ``per_label`` documents of each label, those with
    the least hashes of their ids. Only the chosen ids meet the documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("i")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = known.groupBy(F.col("toxic").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(2.0 ** 63 * per_label) / F.col("n")
    chosen = known.join(F.broadcast(sizes), F.col("toxic") == F.col("t")) \
        .where(F.abs(F.xxhash64("i").cast("double")) <= share).select("i", "toxic")
    # at most twice ``per_label`` ids for each label, so they may be broadcast
    found = docs.select(id_col, F.col(text_col).alias("text")) \
        .join(F.broadcast(chosen), F.col(id_col) == F.col("i"))
    # copies of a text count once
    return found.groupBy("toxic", F.xxhash64("text")).agg(F.min("text").alias("text")).select("text", "toxic")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(id_remainder(id_col, 5) == 0, F.lit(False))


def score(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score)"""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            scores = [g.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents by a grammar of the labels that are not held out."""
    known = labels.where(~held_out(id_col))
    n = {r.toxic: r.n for r in known.where("toxic IS NOT NULL").groupBy(F.col("toxic").cast("int").alias("toxic"))
         .agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = {k: min(1.0, SAMPLE / v) for k, v in n.items()}
    grammar = fit(labelled(docs, known, id_col=id_col, text_col=text_col), taken.get(0, 1.0) / taken.get(1, 1.0))
    return score(docs, grammar, id_col, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

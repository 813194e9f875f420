"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around the hits.

* Lexicon: terms of all of the training fold's labelled texts (equal texts count once) whose document counts by label
  pass a log-likelihood ratio test; of these, terms are taken greedily while they explain toxic documents that no earlier term
  explains (``cover``, by rounds of counts over all toxic texts, which stay on the executors), so words that merely share documents with a toxic term stay out.
* Matching: the trie of the lexicon runs together with the Levenshtein automaton of its terms (one edit from four
  letters, two from nine). The product is determinised lazily: a word costs one dictionary step a letter, and dies
  early. Words that training saw in clean documents on their own are no misspellings.
* Context: each hit scores its term's weight, less if misspelled; it counts as quoted between quotation marks or next
  to a word of reporting. Sums over windows of ``WINDOW`` words, quoted and not, go into a small additive model that
  turns them into a probability. Only this model is fitted on a sample, of about ``TRAIN_ROWS`` texts by their hash.

Defined cases: null and empty texts have no hits and get the model's score for that; null labels are not learned from;
without training rows every score is 0; repeated rows get equal scores; an empty table gives an empty result. Only
doc_id, text and the label are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common
from evalloom.llm.gam import PairwiseGam
from evalloom.llm.quality import TRAIN_ROWS, training_rows

THRESHOLD, WINDOW, FEATURES = 0.7, 12, 6
#: Nats of evidence for a candidate term, and for its share of yet unexplained documents.
CANDIDATE, NOVEL = 9.0, 6.0
#: Candidate terms that the driver takes on; more raise an error, none is dropped.
MOST_CANDIDATES = 500_000
#: Entries of the per-worker memory of known words and automaton states; it is emptied when full.
MEMORY = 200_000

#: Words of reporting near which a term counts as quoted.
REPORTING = frozenset("said says wrote quote quoted called term word sagte schrieb wort zitat dit écrit mot dijo escribió palabra cita".split())
_QUOTES = re.compile('["“”«»„]')
_SPLIT = str.maketrans({c: " " for c in "!#%&()+,./:;<=>?[\\]^_`{|}~…¡¿ "})


def tokens(text: bytes) -> list[str]:
    """Lower-cased words; punctuation splits, a quotation mark is a token of its own."""
    s = text.decode("utf-8", "replace").lower()
    return _QUOTES.sub(' " ', s).translate(_SPLIT).split()


def edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else 2


class TermAutomaton:
    """Trie of terms run with their Levenshtein automata, determinised as words come."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.term = [0], [-1]
        for k, t in enumerate(terms):
            at = 0
            for i in range(len(t) + 1):
                self.allowed[at] = max(self.allowed[at], edits(t))
                if i == len(t):
                    break
                if t[i] not in self.children[at]:
                    self.children[at][t[i]] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.term.append(-1)
                at = self.children[at][t[i]]
            self.term[at] = k
        self.terms = terms
        self.start = self._closure({(0, 0)})
        self.moves: dict = {}

    def _closure(self, states: set) -> frozenset:
        """Adds what skipping letters of a term reaches; of each node only the fewest edits stay."""
        least, todo = {}, sorted(states, key=lambda s: -s[1])
        while todo:
            node, e = todo.pop()
            if e > self.allowed[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo.extend((c, e + 1) for c in self.children[node].values())
        return frozenset(least.items())

    def _move(self, state: frozenset, letter: str) -> frozenset:
        out = set()
        for node, e in state:
            for c, child in self.children[node].items():
                out.add((child, e + (c != letter)))
            out.add((node, e + 1))
        return self._closure(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term's number and the edits, or None."""
        state, moves = self.start, self.moves
        for letter in word:
            nxt = moves.get((state, letter))
            if nxt is None:
                if len(moves) > MEMORY // 2:
                    moves.clear()
                nxt = moves[state, letter] = self._move(state, letter)
            state = nxt
            if not state:
                return None
        best = min(((e, self.term[n]) for n, e in state if self.term[n] >= 0 and e <= edits(self.terms[self.term[n]])), default=None)
        return (best[1], best[0]) if best else None


def evidence(n1: float, n0: float, rate: float) -> float:
    """Log-likelihood ratio of a term's share of toxic documents against the base rate; 0 if it isn't above it."""
    n = n1 + n0
    if n <= 0 or n1 / n <= rate:
        return 0.0
    p = n1 / n
    return n1 * log(p / rate) + (n0 * log((1 - p) / (1 - rate)) if n0 else 0.0)


def weight(n1: float, n0: float) -> float:
    return max(0.0, log((n1 + 0.5) / (n0 + 0.5)))


class Matcher:
    """Finds lexicon hits in texts and sums them over context windows."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], usual: frozenset):
        self.names = sorted(lexicon)
        self.counts = [lexicon[t] for t in self.names]
        self.automaton, self.usual, self.known = TermAutomaton(self.names), usual, {}

    def hits(self, ws: list[str]) -> list[tuple[int, int, int]]:
        """(position, term, edits) of each hit."""
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for t in set(ws).difference(known):
            got = self.automaton.match(t)
            known[t] = None if got and got[1] and t in self.usual else got
        return [(i, *h) for i, h in enumerate(map(known.__getitem__, ws)) if h]

    def features(self, text: bytes, own: float | None = None) -> list[float]:
        """Window sums. ``own``: the text's label when it was among those counted; its own counts are then left out."""
        ws = tokens(text)
        hits = self.hits(ws) if ws else []
        if not hits:
            return [0.0] * FEATURES
        marks = np.cumsum([t == '"' for t in ws])
        free, quoted, scores = [], [], []
        for i, k, e in hits:
            n1, n0 = self.counts[k]
            # a misspelling wasn't counted under its term
            w = weight(n1, n0) * 0.8 if e else weight(n1 - (own == 1), n0 - (own == 0))
            near = range(max(0, i - 3), min(len(ws), i + 4))
            is_quoted = marks[i] % 2 == 1 and marks[-1] > marks[i] or any(ws[j] in REPORTING for j in near)
            (quoted if is_quoted else free).append(w)
            scores.append((i, 0.0 if is_quoted else w))
        best, lo, run = 0.0, 0, 0.0
        for i, s in scores:
            run += s
            while scores[lo][0] <= i - WINDOW:
                run -= scores[lo][1]
                lo += 1
            best = max(best, run)
        return [best, max(free, default=0.0), sum(free), sum(quoted), float(len(hits)), len(hits) / len(ws)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        by: dict = (Counter(), Counter())
        for t, y in zip(common.texts(b.column(0)), b.column(1).to_pylist()):
            by[y >= 0.5].update(set(tokens(t)))
        terms = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (by[1], by[0]))], ["term", "n1", "n0"])


def cover(held: DataFrame, enough: Callable[[np.ndarray], np.ndarray], terms: int) -> np.ndarray:
    """Which of the ranked ``terms`` a greedy cover takes: term after term, each one that ``enough`` finds to hold enough fresh documents.

    ``held(at, n)``: increasing ranks of the terms of n documents. Fresh documents of a term hold none taken before it.
    A round counts them by the terms that the last round took, beginning with all. Its first k terms are right after k
    rounds, and a round that changes nothing has found the cover; what comes to the driver is one count a term.
    """
    taken = np.ones(terms, bool)
    while True:
        known = taken

        def credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fresh: Counter = Counter()
                for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for t in at:
                        fresh[t] += n
                        if known[t]:
                            break
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int32()), pa.array(list(fresh.values()), pa.int64())], ["t", "n"])

        fresh = np.zeros(terms, np.int64)
        for r in held.mapInArrow(credited, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
            fresh[r["t"]] = r["n"]
        taken = enough(fresh)
        if (taken == known).all():
            return taken


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple | None:
    """(lexicon with counts, usual words near it, additive model), or None without training rows."""
    common.bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, None).groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("k")).agg(F.any_value("text").alias("text"), F.avg("y").alias("y")).select("text", "y", "k")
    rows = common.saved(rows, "toxic-train")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("y") >= 0.5).alias("n1")).first()
    if not sizes["n"]:
        return None
    rate = (sizes["n1"] + 0.5) / (sizes["n"] + 1)
    counts = common.saved(rows.select("text", "y").mapInArrow(_counts, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "toxic-terms")
    n1, n0, p = F.col("n1"), F.col("n0"), F.col("n1") / (F.col("n1") + F.col("n0"))
    llr = n1 * F.log(p / rate) + F.when(n0 > 0, n0 * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    strong = counts.where((n1 >= 3) & (p > max(0.5, rate))).withColumn("llr", llr).where(F.col("llr") >= CANDIDATE)
    if strong.count() > MOST_CANDIDATES:
        raise RuntimeError(f"more than {MOST_CANDIDATES} candidate terms")
    strong = {r["term"]: (r["n1"], r["n0"]) for r in strong.collect()}

    ranked = sorted(strong, key=lambda t: (-evidence(*strong[t], rate), t))
    rank = {t: i for i, t in enumerate(ranked)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(rank[t] for t in rank.keys() & set(tokens(t_))) for t_ in common.texts(b.column(0))], pa.list_(pa.int32()))], ["at"])

    held = rows.where("y >= 0.5").select("text").mapInArrow(found, "at array<int>").where(F.size("at") > 0)
    held = common.saved(held.groupBy("at").agg(F.count("*").alias("n")), "toxic-held")
    enough = lambda fresh: np.array([n >= 2 and evidence(n, strong[t][1], rate) >= NOVEL for t, n in zip(ranked, fresh.tolist())], bool)
    lexicon = {ranked[i]: strong[ranked[i]] for i in np.flatnonzero(cover(held, enough, len(ranked))).tolist()}
    # words within an edit of a term that clean documents use: no misspellings. Only words near a term come back.
    near = TermAutomaton(sorted(lexicon))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t for t in b.column(0).to_pylist() if near.match(t)], pa.string())], ["term"])

    usual = frozenset(r["term"] for r in counts.where(n0 > n1).select("term").mapInArrow(close, "term string").collect()) - lexicon.keys()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon, usual)
        for b in batches:
            ys = b.column(1).to_pylist()
            x = [m.features(t, float(y >= 0.5)) for t, y in zip(common.texts(b.column(0)), ys)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array([float(y >= 0.5) for y in ys])], ["x", "y"])

    n = sizes["n"]
    sample = rows.where(F.pmod(F.xxhash64(F.lit(9), "k"), F.lit(1 << 40)) < int(TRAIN_ROWS / n * (1 << 40))) if n > TRAIN_ROWS else rows
    got = sample.select("text", "y").mapInArrow(featured, "x array<double>, y double").toArrow()
    y = got["y"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort((y, *x.T))
    return lexicon, usual, PairwiseGam().fit(x[order], y[order])


def _scorer(model: tuple | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(*model[:2]) if model else None
        for b in batches:
            x = np.array([m.features(t) for t in common.texts(b.column(b.num_columns - 1))]).reshape(len(b), FEATURES) if m else None
            s = model[2].score(x) if m else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with their columns."""
    src = docs.select(common.whole_row(docs).alias("row"), F.col("text").cast("string").alias("_text"))
    out = src.mapInArrow(_scorer(learn(docs, labels)), src.drop("_text").schema.add("score", "double"))
    return out.where(F.col("score") < threshold).select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = learn(docs, labels)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

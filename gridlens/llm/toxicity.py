"""Toxicity scores from a weighted finite-state grammar over clauses.

Five small weighted transducers read the symbols of a clause (insult, threat, target, negation, reporting verb,
quotation mark, other): how many insults, whether a threat meets a target, whether anyone is addressed, whether a
hit stands in the reach of a negation, whether it is somebody else's speech.  Their composition is one table, built
once, so a clause is one walk over its tokens.  A document is scored by the clauses that reach an accepting state.

The insult transducer's alphabet is learned from labels: words and word stems, as insults may be inflected, whose
document frequencies differ between the classes.  A logistic model over the clause totals turns them into a score.
Both are fitted on a bounded sample of labelled rows (``positives`` and ``negatives`` rows, those with the smallest
hashed ids); everything else reads every whole text.

Defined results: missing and empty texts match no clause and get the score of a text without hits; rows keep their
ids, missing or repeated; a label row without a document, or without a label, is not used; without labelled rows of
both classes, seed words with their prior weights are all that is known.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.tables import held_out, stored

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)

# Seed words; insults and threats are weighed anew where labels speak for or against them.
INSULTS = "asshole bastard bitch degenerate dumbass fool idiot imbecile loser moron pig scum stupid trash vermin".split()
THREATS = ("kill hurt destroy beat shoot stab burn crush töten schlagen vernichten tuer frapper détruire matar golpear "
           "destruir").split()
TARGETS = ("you your yours u they them their he him his she her people du dich dein ihr euch sie tu toi te vous ils elle "
           "tú ti usted ustedes ellos").split()
NEGATIONS = "not no never nor without nobody isn aren wasn don doesn didn nicht kein keine nie ne pas jamais nunca sin".split()
REPORTS = ("said says say called calls claimed claims wrote writes reported sagte sagt nannte schrieb dit disait appelle "
           "écrit dijo dice llamó escribió").split()
PRIOR_WEIGHT = 2.0
STEM_LENGTHS = range(3, 11)

_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """Deterministic weighted transducer; an arc that is not listed stays in its state and weighs nothing."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    start: int = 0


def components() -> list[Transducer]:
    """Insult, threat, target, negation and reported-speech transducers, in the order of a state tuple."""
    insult = Transducer({(0, INSULT): (1, 1.0), (1, INSULT): (2, 0.5), (2, INSULT): (2, 0.25)})
    # A threat needs somebody it is aimed at, before or after the verb.
    threat = Transducer({(0, THREAT): (1, 0.0), (0, TARGET): (2, 0.0), (1, TARGET): (3, 1.0), (2, THREAT): (3, 1.0)})
    target = Transducer({(0, TARGET): (1, 0.25)})
    # A negation reaches over three other tokens; 4 remembers a hit inside its reach, 5 one outside.
    negation = Transducer({
        **{(s, NEGATION): (1, 0.0) for s in (0, 1, 2, 3)}, (1, OTHER): (2, 0.0), (2, OTHER): (3, 0.0), (3, OTHER): (0, 0.0),
        **{(s, hit): (4, -0.5) for s in (1, 2, 3) for hit in (INSULT, THREAT)},
        **{(s, hit): (5, 0.0) for s in (0, 4) for hit in (INSULT, THREAT)},
    })
    # A reporting verb, then a quotation: 1 verb seen, 2 quotation open, 3 a hit in either.
    reported = Transducer({
        (0, REPORT): (1, 0.0), (0, QUOTE): (2, 0.0), (1, QUOTE): (2, 0.0), (2, QUOTE): (0, 0.0),
        **{(s, hit): (3, -0.25) for s in (1, 2) for hit in (INSULT, THREAT)},
    })
    return [insult, threat, target, negation, reported]


@dataclass(frozen=True)
class Grammar:
    """Composition of transducers: one row of (next state, weight) per reachable state."""

    table: list[list[tuple[int, float]]]
    states: list[tuple[int, ...]]

    @classmethod
    def compose(cls, parts: list[Transducer]) -> Grammar:
        start = tuple(p.start for p in parts)
        number, table, queue = {start: 0}, [], deque([start])
        while queue:
            state = queue.popleft()
            row = []
            for symbol in range(7):
                steps = [p.arcs.get((s, symbol), (s, 0.0)) for p, s in zip(parts, state)]
                after = tuple(s for s, _ in steps)
                if after not in number:
                    number[after] = len(number)
                    queue.append(after)
                row.append((number[after], sum(w for _, w in steps)))
            table.append(row)
        return cls(table, list(number))

    def run(self, symbols: list[tuple[int, float]]) -> tuple[tuple[int, ...], float]:
        """Final component states of a clause and its weight; each token's own weight scales its arc."""
        state, total = 0, 0.0
        for symbol, weight in symbols:
            state, step = self.table[state][symbol]
            total += step * weight
        return self.states[state], total


@dataclass
class Model:
    """Everything a task needs; plain values of bounded size.  A stem that ends in ``$`` is a whole word."""

    stems: dict[str, float]
    threats: dict[str, float]
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0])


class Scorer:
    """Clause matcher of one task."""

    def __init__(self, model: Model):
        self.grammar = Grammar.compose(components())
        self.words = {w: (s, 1.0) for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.words |= {q: (QUOTE, 1.0) for q in "\"“”„«»"}
        self.coefficients = np.array(model.coefficients)
        # What labels have taught about a word goes before the seed threat it may also be.
        triggers = {f"{t}$": (THREAT, w) for t, w in model.threats.items()} | {t: (INSULT, w) for t, w in model.stems.items()}
        self.whole = {t[:-1]: v for t, v in triggers.items() if t.endswith("$")}
        self.stems = {t: v for t, v in triggers.items() if not t.endswith("$")}
        self.lengths = sorted({len(t) for t in self.stems})
        self.finder = ahocorasick.Automaton()
        for t in {*self.whole, *self.stems}:
            self.finder.add_word(t, len(t))
        self.finder.make_automaton()

    def symbol(self, token: str) -> tuple[int, float]:
        found = self.whole.get(token)
        if found:
            return found
        for n in self.lengths:
            if found := self.stems.get(token[:n]):
                return found
        return self.words.get(token, (OTHER, 1.0))

    def clauses(self, text: str) -> Iterator[list[tuple[int, float]]]:
        """Symbols of the clauses that hold a word or stem of the grammar at a word start."""
        done = 0
        if not len(self.finder):
            return
        for end, length in self.finder.iter(text):
            start = end - length + 1
            if start < done or start and text[start - 1].isalpha():
                continue
            head = max((text.rfind(b, done, start) for b in ".!?;\n"), default=-1) + 1
            tail = _BREAK.search(text, start)
            done = tail.end() if tail else len(text)
            yield [self.symbol(t) for t in _TOKEN.findall(text, max(head, 0), done)]

    def features(self, text: str) -> np.ndarray:
        """1, log of the matched weight, shares of negated, reported and targeted clauses, threats, repetition."""
        total, matched, negated, reported, targeted, threats, repeated = 0.0, 0, 0, 0, 0, 0, 0
        for symbols in self.clauses(text.lower()):
            (insult, threat, target, negation, speech), weight = self.grammar.run(symbols)
            if not insult and threat != 3:
                continue
            matched += 1
            total += max(weight, 0.1)
            negated += negation == 4
            reported += speech == 3
            targeted += target
            threats += threat == 3
            repeated += insult == 2
        if not matched:
            return np.array([1.0, 0, 0, 0, 0, 0, 0])
        return np.array([1.0, math.log1p(total), negated / matched, reported / matched, targeted / matched,
                         threats / matched, repeated / matched])

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-features @ self.coefficients))


def _stem_counts(sample: DataFrame) -> DataFrame:
    """Documents of either class by word and stem, added up per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                counts[label].update({w[:n] for w in words for n in STEM_LENGTHS if n <= len(w)} | {f"{w}$" for w in words})
        for label, counter in enumerate(counts):
            keys = list(counter)
            for at in range(0, len(keys), 100_000):
                part = keys[at:at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([label] * len(part), pa.int32()),
                     pa.array([counter[k] for k in part], pa.int64())], names=["stem", "label", "n"])

    rows = sample.select("text", "label").mapInArrow(count, "stem string, label int, n long")
    return rows.groupBy("stem").agg(*[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])


def choose_stems(counts: list[tuple[str, int, int]], negatives: int, positives: int) -> dict[str, float]:
    """Stems by (stem, clean documents, toxic documents): the shortest useful one, then its longest equal extension."""
    by_stem = {s: (n0, n1) for s, n0, n1 in counts}
    chosen: dict[str, float] = {}
    for stem in sorted(by_stem, key=lambda s: (len(s.rstrip("$")), s)):
        plain = stem.rstrip("$")
        if any(plain[:n] in chosen for n in range(1, len(plain) + 1)):
            continue
        best, (n0, n1) = stem, by_stem[stem]
        longer = sorted((s for s in by_stem if s.startswith(plain)), key=len)
        for s in longer:
            if s.startswith(best.rstrip("$")) and by_stem[s][1] >= 0.99 * n1:
                best = s
        n0, n1 = by_stem[best]
        chosen[best] = _log_odds(n0, n1, negatives, positives)
    return chosen


def _log_odds(n0: int, n1: int, negatives: int, positives: int) -> float:
    return float(np.clip(math.log((n1 + .5) / (positives + 1)) - math.log((n0 + .5) / (negatives + 1)), 1, 6))


def weigh_threats(counts: dict[str, tuple[int, int]], contradicted: set[str], learned: dict[str, float], negatives: int,
                  positives: int) -> dict[str, float]:
    """Weights of the threats that are neither contradicted by clean texts nor matched by a learned stem."""
    kept = {}
    for word in THREATS:
        whole = f"{word}$"
        if whole in contradicted or whole in learned or any(word[:n] in learned for n in STEM_LENGTHS):
            continue
        kept[word] = _log_odds(*counts[whole], negatives, positives) if whole in counts else 1.0
    return kept


def labelled_sample(docs: DataFrame, labels: DataFrame, limits: tuple[int, int], *, key: str = "doc_id",
                    text: str = "text", label: str = "toxic") -> DataFrame:
    """Training rows (text, label): per class those with the smallest hashed ids, never of the held-out fold.

    An id that is labelled twice counts as positive if any of its labels is.
    """
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("_id"), "_id").limit(limits[c]) for c in (0, 1)]
    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    # The ids are bounded by the two limits.
    return rows.join(F.broadcast(parts[0].union(parts[1])), "_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, *, positives: int = 3000, negatives: int = 6000, evidence: float = 25.0,
          candidates: int = 4000, ridge: float = 0.05, **columns: str) -> Model:
    """Learn stems and coefficients from at most ``positives`` + ``negatives`` labelled rows.

    ``evidence`` is the least log-likelihood ratio of a stem; at most ``candidates`` stems and the seed words reach the
    driver.  Seed words at least as common in clean texts leave; a threat that labels prove toxic by itself becomes a
    learned stem, which needs no target; other threats that occur are weighed by their counts.
    """
    sample = stored(labelled_sample(docs, labels, (negatives, positives), **columns))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    model = Model({f"{w}$": PRIOR_WEIGHT for w in INSULTS}, dict.fromkeys(THREATS, 1.0))
    if not n0 or not n1:
        return model
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    share = (a + b) / (n0 + n1)
    ratio = 2 * (a * F.log((a + 1e-9) / (n1 * share)) + b * F.log((b + 1e-9) / (n0 * share)))
    seed = F.col("stem").isin([f"{w}$" for w in (*INSULTS, *THREATS)])
    known = (
        _stem_counts(sample)
        .withColumn("useful", (a / n1 > 10 * b / n0) & (ratio >= evidence))
        .filter(F.col("useful") | seed)
        .orderBy(seed.desc(), F.col("useful").desc(), ratio.desc(), "stem").limit(candidates + len(INSULTS) + len(THREATS)).collect()
    )
    contradicted = {r["stem"] for r in known if not r["useful"] and r["n0"] / n0 >= r["n1"] / n1}
    model.stems = {s: w for s, w in model.stems.items() if s not in contradicted}
    learned = choose_stems([(r["stem"], r["n0"], r["n1"]) for r in known if r["useful"]], n0, n1)
    model.stems |= learned
    model.threats = weigh_threats({r["stem"]: (r["n0"], r["n1"]) for r in known}, contradicted, learned, n0, n1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.features(t.as_py() or "").tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label")],
                                             names=["x", "label"])

    rows = sample.mapInArrow(measure, "x array<double>, label int").groupBy("x", "label").count().toArrow()
    model.coefficients = fit_logistic(np.array(rows["x"].to_pylist()), rows["label"].to_numpy(), rows["count"].to_numpy(),
                                      ridge=ridge)
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, *, ridge: float, steps: int = 50) -> list[float]:
    """Ridge logistic regression of weighted rows by Newton steps; the intercept is not shrunk."""
    order = np.lexsort((y, *x.T))
    x, y, n = x[order], y[order].astype(float), n[order].astype(float)
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty @ w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score_documents(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", threshold: float = 0.5,
                    carry: bool = False, name: str = "toxicity") -> DataFrame:
    """Key, score and predicted class of every row; with ``carry`` all columns of the row and the score as ``name`` instead.

    ``name`` must not be a column of the rows that are carried; :func:`gridlens.llm.tables.free_name` finds one.
    """
    if carry:
        if name in docs.columns:
            raise ValueError(f"column {name} is already there, choose another name for the score")
        rows = docs.withColumn(name, F.lit(None).cast("double"))
        kept, schema = docs.columns, rows.schema
    else:
        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("_text"))
        kept, schema = ["key"], "key " + dict(rows.dtypes)["key"] + ", toxicity double"
    source = text if carry else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.features(t.as_py() or "") for t in batch.column(source)]
            scores = scorer.score(np.stack(found)) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(scores, pa.float64())],
                                             names=[*kept, name if carry else "toxicity"])

    scored = rows.mapInArrow(run, schema)
    if carry:
        return scored
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= threshold).cast("int").alias("predicted"))

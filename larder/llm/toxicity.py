"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult and threat arcs (with weights), targets, negations, reporting verbs, quotation marks, others.
Four transducers read a clause's symbols in order and each gives every insult or threat a factor: the target
transducer (guesses at the start whether a target will come, and accepts only if right), the negation transducer (a scope of
NEGATION_SCOPE words), the reported-speech transducer (from the verb to the clause's end) and the quotation transducer
(guesses at a mark whether it will be closed). ``compose`` builds their product; a clause's weight is the sum over its
accepted path of arc weights times factors. A document's score is the logistic of the prior's log odds and its clauses' weights.

Insult arcs are learned from labels: stems and words (letter prefixes, or whole words) whose share of toxic documents is
significantly high, weighted by their smoothed log odds; so are the factors of negated and of reported arcs, as the
share of toxic documents among those with no other arcs, with FACTOR_ROWS documents of weight DAMPED as prior. Threats,
targets, negations and reporting verbs are lists.

Learning uses at most FIT_ROWS labelled documents of each class, taken by a hash of their id, and of those with
crc32(doc_id) mod 4 = 2 none; documents that share SKETCHES least word hashes (copies, near copies) count once. Counting
runs in Spark and combines before the shuffle; the driver gets the significant features of those rows. Scoring reads every
whole text once (an Aho-Corasick automaton over the arcs; only clauses with an arc are read by the grammar): no shuffle.

Defined cases: null and empty texts get the score of a document without arcs; without labels only the listed arcs
count; labels without a document and documents without labels are fine; repeated rows are scored alike; a very long text
or clause is read in one pass, in memory in proportion to it; a null doc_id has the checksum of the empty text; extra
columns are ignored by ``score`` and kept by ``keep_civil``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 16_000
MIN_LLR, MIN_PRECISION, STEM, SKETCHES = 14.0, 0.9, 3, 3
THRESHOLD = 0.3
PRIOR = 0.1
# Arcs that aren't learned. A trailing $ asks for the end of a word.
INSULTS = "idiot$ idiots$ moron$ morons$ imbecile$ scumbag$ dumbass$ dipshit$ asshole$ bastard$ arschloch$ dummkopf$ trottel$ connard$ salaud$ gilipollas$ imbécil$ pendejo$".split()
THREATS = ("kill you", "hurt you", "beat you up", "break your", "burn you", "hunt you down", "you will die", "bring dich um", "ich töte", "te tuer", "te voy a matar")
TARGETS = "you your you're yourself they them he she all these people du dich dir ihr euch tu toi vous ils elles tú te vosotros usted ustedes".split()
NEGATIONS = "not no never nobody isn't aren't don't doesn't didn't wasn't nicht kein keine niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say told wrote claimed called quoted reported according sagte sagt schrieb behauptete laut dit disait écrit selon dijo dice escribió según".split()
AIMED = 1.25
#: The share of its weight that a negated or reported arc keeps if labels don't say more, the documents this prior is worth, and the words a negation reaches.
DAMPED, FACTOR_ROWS, NEGATION_SCOPE = 0.05, 4, 4
LISTED_WEIGHT = {"insult": 3.0, "threat": 3.5}

_WORD = re.compile(r"[^\W\d_]+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:'[a-z]+)?|\"")
_CLAUSE = re.compile(r"[.!?;:\n]")
SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "other")
HITS = frozenset(SYMBOLS[:2])


@dataclass(frozen=True)
class Transducer:
    """arcs: (state, symbol) -> [(next state, factor)]; without an entry the machine fails there."""

    starts: tuple
    finals: frozenset
    arcs: dict


def negation_scope(factor: float, scope: int = NEGATION_SCOPE) -> Transducer:
    """States: the words that the last negation still reaches."""
    step = lambda k, x: (scope if x == "negation" else max(k - 1, 0), factor if k and x in HITS else 1.0)
    return Transducer((0,), frozenset(range(scope + 1)), {(k, x): [step(k, x)] for k in range(scope + 1) for x in SYMBOLS})


def reported_speech(factor: float) -> Transducer:
    """After a reporting verb all that follows in the clause is reported."""
    return Transducer((False,), frozenset((False, True)), {(k, x): [(k or x == "report", factor if k and x in HITS else 1.0)] for k in (False, True) for x in SYMBOLS})


def quotation(factor: float) -> Transducer:
    """A mark opens a quotation that will be closed, or is the last one of the clause."""
    arcs = {(k, x): [(k, factor if k == "in" and x in HITS else 1.0)] for k in ("out", "in", "stray") for x in SYMBOLS if x != "quote"}
    return Transducer(("out",), frozenset(("out", "stray")), arcs | {("out", "quote"): [("in", 1.0), ("stray", 1.0)], ("in", "quote"): [("out", 1.0)]})


def aim(factor: float = AIMED) -> Transducer:
    """Arcs of a clause with a target weigh more, wherever the target stands."""
    arcs = {(k, x): [("seen" if x == "target" else k, factor if x in HITS else 1.0)] for k in ("awaited", "seen") for x in SYMBOLS}
    return Transducer(("awaited", "none"), frozenset(("seen", "none")), arcs | {("none", x): [("none", 1.0)] for x in SYMBOLS if x != "target"})


def compose(machines: list[Transducer]) -> Transducer:
    """Their product: reads one sequence with all machines; factors multiply. Only states that can be reached."""
    starts = tuple(product(*(m.starts for m in machines)))
    arcs, todo, seen = {}, list(starts), set(starts)
    while todo:
        state = todo.pop()
        for x in SYMBOLS:
            ways = [m.arcs.get((k, x), []) for m, k in zip(machines, state, strict=True)]
            arcs[state, x] = [(tuple(k for k, _ in way), math.prod(f for _, f in way)) for way in product(*ways)]
            for to, _ in arcs[state, x]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
    return Transducer(starts, frozenset(k for k in seen if all(q in m.finals for m, q in zip(machines, k, strict=True))), arcs)


def path_weight(machine: Transducer, read: list[tuple[str, float]]) -> float:
    """The weight of the accepted path over (symbol, arc weight); the heaviest if there are several."""
    paths = dict.fromkeys(machine.starts, 0.0)
    for x, weight in read:
        onward: dict = {}
        for state, total in paths.items():
            for to, factor in machine.arcs.get((state, x), ()):
                onward[to] = max(onward.get(to, -math.inf), total + weight * factor)
        paths = onward
    return max((w for k, w in paths.items() if k in machine.finals), default=0.0)


@dataclass(frozen=True)
class Arc:
    text: str  # a letter prefix, a word with $ at its end, or a phrase
    kind: str
    weight: float


LISTED = tuple(Arc(x, "insult", LISTED_WEIGHT["insult"]) for x in INSULTS) + tuple(Arc(f"{x}$", "threat", LISTED_WEIGHT["threat"]) for x in THREATS)


class Grammar:
    """The composed transducers over the lexicon of arcs, with the prior's log odds."""

    def __init__(self, arcs: list[Arc], prior: float = PRIOR, negated: float = DAMPED, reported: float = DAMPED):
        self.base = math.log(prior / (1 - prior))
        self.arcs = arcs
        self.automaton = ahocorasick.Automaton()
        for arc in arcs:
            key = arc.text.rstrip("$")
            self.automaton.add_word(key, (*self.automaton.get(key, ()), (len(key), arc.text.endswith("$"), arc.weight, arc.kind)))
        self.automaton.make_automaton()
        self.lexicon = {'"': "quote"} | {w: k for k, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)) for w in words}
        self.machine = compose([negation_scope(negated), reported_speech(reported), quotation(reported), aim()])

    def arcs_in(self, low: str) -> dict[int, tuple[float, str]]:
        """start -> (weight, kind) of the arcs of a lower-cased text; of arcs from one start the heaviest."""
        best: dict[int, tuple[float, str]] = {}
        if len(self.automaton):
            for last, found in self.automaton.iter(low):
                end = last + 1
                for size, whole, weight, kind in found:
                    start = end - size
                    if (start == 0 or not low[start - 1].isalpha()) and not (whole and end < len(low) and low[end].isalpha()) and weight > best.get(start, (0.0, ""))[0]:
                        best[start] = weight, kind
        return best

    def readings(self, text: str) -> Iterator[tuple[str, list[tuple[str, float]]]]:
        """Each clause with an arc, and its words as (symbol, weight)."""
        low = text.lower()
        hits = self.arcs_in(low)
        if not hits:
            return
        ends = [*(m.start() for m in _CLAUSE.finditer(low)), len(low)]
        for k in sorted({bisect.bisect_left(ends, at) for at in hits}):
            left = ends[k - 1] + 1 if k else 0
            read = []
            for m in _SPOKEN.finditer(low, left, ends[k]):
                weight, kind = hits.get(m.start(), (0.0, ""))
                read.append((kind or self.lexicon.get(m[0], "other"), weight))
            yield low[left : ends[k]], read

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Matched clauses with their weights."""
        return [(clause, path_weight(self.machine, read)) for clause, read in self.readings(text)]

    def score(self, text: str | None) -> float:
        weight = sum(w for _, w in self.clauses(text)) if text else 0.0
        return min(1 / (1 + math.exp(-(self.base + weight))), math.nextafter(1, 0))


def checksum(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most so many labelled documents of each class, of near copies one."""
    use = labels.filter(F.col("toxic").isin(0, 1) & (checksum() % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for toxic in (0, 1):
        own = use.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = own if picked is None else picked.unionByName(own)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * rows small rows
    own = F.split(F.coalesce("text", F.lit("")), r"\s+")
    sketch = F.struct(*[F.array_min(F.transform(own, lambda w, k=k: F.xxhash64(w, F.lit(k)))).alias(f"least{k}") for k in range(SKETCHES)])
    return texts.withColumn("sketch", sketch).dropDuplicates(["toxic", "sketch"]).select("text", "toxic")


def _stems(n: int) -> Iterator[int]:
    """Prefix lengths of a word of n letters: all up to a dozen, then by a fourth more each, so that a long word costs little more than itself."""
    k = STEM
    while k <= n:
        yield k
        k += max(1, k // 4 if k >= 12 else 1)


def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): documents of each class in which a letter prefix, or a whole word (ending in $), occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter(), Counter()

        def flush() -> pd.DataFrame:
            names = list(counts[0] | counts[1])
            out = pd.DataFrame({"feature": names, "pos": [counts[1][x] for x in names], "neg": [counts[0][x] for x in names]})
            for c in counts:
                c.clear()
            return out

        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = set(_WORD.findall((text or "").lower()))
                own = {w[:k] for w in words for k in _stems(len(w))}
                counts[int(toxic)].update(own | {f"{w}$" for w in words if len(w) >= STEM})
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield flush()
        yield flush()

    return rows.mapInPandas(run, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_arcs(found: list[tuple[str, int, int]], pos_docs: int, neg_docs: int) -> list[Arc]:
    """From significant features, per family of prefixes the most specific one that keeps nearly all its documents."""
    counts = {f: (p, n) for f, p, n in found}
    below: dict[str, list[str]] = {}
    for f in counts:
        for k in range(STEM, len(f)):
            below.setdefault(f[:k], []).append(f)
    arcs, taken = [], set()
    for f in sorted(counts, key=lambda x: (len(x), x)):
        if f in taken:
            continue
        deeper = [g for g in below.get(f, ()) if counts[g][0] >= 0.95 * counts[f][0] and counts[g][1] <= counts[f][1]]
        g = max(deeper, key=lambda x: (len(x), x), default=f)
        taken.update({g, *below.get(g, ())}, (x for x in below.get(f, ()) if g.startswith(x)))
        p, n = counts[g]
        arcs.append(Arc(g, "insult", math.log((p + 0.5) / (pos_docs + 1)) - math.log((n + 0.5) / (neg_docs + 1))))
    return arcs


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Grammar:
    """The grammar with arcs learned from the labels."""
    train = fit_rows(docs, labels, rows)
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    pos_docs, neg_docs = sizes.get(1, 0), sizes.get(0, 0)
    listed = {a.text: a for a in LISTED}
    if not pos_docs or not neg_docs:
        return Grammar(list(LISTED))
    prior = pos_docs / (pos_docs + neg_docs)
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    odds = lambda n, a, b: F.when(F.col(n) > 0, F.col(n) * F.log(a / F.lit(b))).otherwise(0.0)
    llr = odds("pos", share, prior) + odds("neg", 1 - share, 1 - prior)
    good = feature_counts(train).filter((share >= MIN_PRECISION) & (llr >= MIN_LLR))
    learned = choose_arcs([(r["feature"], r["pos"], r["neg"]) for r in good.collect()], pos_docs, neg_docs)
    arcs = list((listed | {a.text: a for a in learned}).values())
    return Grammar(arcs, PRIOR, **fit_factors(train, Grammar(arcs)))


def fit_factors(train: DataFrame, grammar: Grammar) -> dict[str, float]:
    """The factors of negated and of reported arcs: smoothed shares of toxic documents among those with only such arcs."""
    context = {"negated": compose([negation_scope(0.0)]), "reported": compose([reported_speech(0.0), quotation(0.0)])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                read = [r for _, r in grammar.readings(text or "")]
                rows += [(name, int(toxic)) for name, machine in context.items() if read and not any(path_weight(machine, r) for r in read)]
            yield pd.DataFrame(rows, columns=["name", "toxic"])

    found = {r["name"]: (r["toxic"], r["n"]) for r in train.mapInPandas(run, "name string, toxic long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()}
    return {name: (found.get(name, (0, 0))[0] + FACTOR_ROWS * DAMPED) / (found.get(name, (0, 0))[1] + FACTOR_ROWS) for name in context}


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": [grammar.score(t) for t in b["text"]]})

    rows = docs.select("doc_id", "text", (checksum() % 4 == 2).alias("held_out"))
    scored = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_civil(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs without the documents that score THRESHOLD or more; one pass over the texts, no join."""
    schema = docs.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[grammar.score(t) < THRESHOLD for t in b["text"]]]

    return docs.mapInPandas(run, schema)

"""Toxicity by a weighted finite-state pattern grammar.

Transducers are composed into one machine that reads the words of a text clause by clause: a lexicon names insults, threats,
targets, negations and reports; negation marks the insults and threats that follow it closely; reported speech marks those
inside it; targets turn a threat or an insult that has an addressee in its clause, on either side, into a symbol; a chain over
clauses turns an insult without an addressee into one only where another insult went before. The score of a document is a
logistic function of what the machine writes. A single word writes nothing: an insult without addressee or company, or a
threat without addressee, leaves the score where no evidence leaves it.

Grammatical words (targets, negations, reports) are closed classes of four languages. The insult lexicon (words, and stems that
words begin with) and the weights of the symbols are learned from a bounded sample of labelled rows, whatever their language;
the sample, not the corpus, is what reaches the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from statistics import median

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawlake.llm.common import drop_if_there, own_name, ship, tidy

SAMPLE = 20_000  # labelled rows that the model is fitted on, at most: those whose doc_id hashes lowest
ENTRIES = 20_000  # candidate entries of the lexicon, at most
STEMS = (4, 5, 6, 7, 8)  # lengths of stems
PRECISION = 0.9  # least share of toxic texts among the labelled texts that hold an entry
EVIDENCE = 9.0  # least log-likelihood ratio of an entry against the base rate
FORMS = 3.0  # words of a stem in a text that add to its evidence, at most
COVER = 2  # entries that each toxic text is to be explained by, if there are any
GAIN = 3  # toxic texts that an entry must newly explain
LEAST_ODDS = 0.5  # log odds below which an entry is left out
UNSEEN = 4.0  # log odds of the known insults where nothing was learned
THRESHOLD = 0.3

# The grammar's closed word classes, and insults known before any label is seen.
INSULTS = "asshole bastard disgusting dumb idiot imbecile loser moron pathetic scum stupid worthless".split()
THREATS = """kill killing murder strangle stab shoot burn beat hurt destroy destroyed
    umbringen töten ermorden erwürgen erstechen erschießen verbrennen schlagen verletzen vernichten
    tuer assassiner étrangler poignarder fusiller brûler frapper blesser détruire
    matar asesinar estrangular apuñalar disparar quemar golpear herir destruir""".split()
ADDRESSEES = """you your yours yourself u ya
    du dich dir dein deine deiner ihr euch euer eure
    tu toi ton votre vous vos
    tú ti usted ustedes vosotros vuestro""".split()
OTHERS = "he him she they them elles ils él ellos ellas".split()  # an insult may be aimed at them, a threat is made to its addressee
NEGATIONS = """not never no nobody isn aren wasn weren don doesn didn cannot can't won wouldn
    nicht nie niemals kein keine keinen keiner
    pas jamais aucun aucune personne
    nunca jamás ningún ninguna nadie tampoco""".split()
REPORTS = """said says say saying called calls quoted quotes wrote writes reported claims claimed
    sagte sagt sagen nannte nennt schrieb schreibt behauptet behauptete zitierte
    dit disait déclare déclara appelle appela écrit écrivait affirme cité
    dijo dice decía llamó llama escribió escribe afirma citó""".split()
QUOTES = "\"“”«»"

TOKEN = re.compile(r"\w+|[\"“”«»]")
CLAUSE = re.compile(r"[.!?;\n]")
SCOPE = 3  # words that a negation reaches


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: step(state, symbol) is the next state and the symbol written."""

    start: Hashable
    step: Callable[[Hashable, str], tuple[Hashable, str]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: `other` reads what this one writes."""

        def step(state, symbol):
            a, written = self.step(state[0], symbol)
            b, out = other.step(state[1], written)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: list[str]) -> tuple[list[dict[str, tuple[int, str]]], int]:
        """All reachable states as a transition table."""
        number, todo, rows = {self.start: 0}, [self.start], []
        while todo:
            state = todo.pop(0)
            row = {}
            for s in symbols:
                after, out = self.step(state, s)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row[s] = (number[after], out)
            rows.append(row)
        return rows, 0


def _negation(left: int, symbol: str) -> tuple[int, str]:
    if symbol == "N":
        return SCOPE, "O"
    if symbol in ("I", "T") and left:
        return left - 1, symbol + "-"
    return max(0, left - 1), symbol


def _report(inside: bool, symbol: str) -> tuple[bool, str]:
    if symbol == "Q":
        return not inside, "O"
    if symbol == "R":
        return True, "O"
    return inside, symbol + "r" if inside and symbol[0] in "IT" else symbol


def _target(state: tuple[str, bool, bool], symbol: str) -> tuple[tuple[str, bool, bool], str]:
    """State: the target seen in the clause (none, G a third person, Y an addressee), an insult waits for one, a threat for Y."""
    seen, insult, threat = state
    if symbol in ("G", "Y"):
        to = "Y" if "Y" in (seen, symbol) else "G"
        if threat and symbol == "Y":
            return (to, insult, False), "threat+"
        return (to, False, threat), "insult+" if insult else ""
    if symbol == "I":
        return ((seen, False, threat), "insult+") if seen else (("", True, threat), "bare")
    if symbol == "T":
        return ((seen, insult, False), "threat+") if seen == "Y" else ((seen, insult, True), "")
    if symbol in ("I-", "T-"):
        return state, "negated"
    if symbol in ("Ir", "Tr", "I-r", "T-r"):
        return state, "reported"
    return state, ""


def _chain(alone: bool, symbol: str) -> tuple[bool, str]:
    """State, kept from clause to clause: no insult went before. A bare insult counts from the second on."""
    if symbol == "bare":
        return False, "" if alone else "insult"
    return alone and symbol != "insult+", symbol


WORD_CLASSES = list("ITGYNRQO")
GRAMMAR, _ = Transducer(0, _negation).then(Transducer(False, _report)).then(Transducer(("", False, False), _target)).table(WORD_CLASSES)
SYMBOLS = ["insult", "insult+", "negated", "reported", "threat+"]
# Weights before any label is seen: the bias, the weight of the strongest entry, then clauses of each symbol.
PRIOR = np.array([-3.5, 0.5, 2.0, 2.5, 0.0, 0.0, 4.0])


WORD = re.compile(r"\w+")


def features_of(words: list[str]) -> tuple[set[str], Counter[str]]:
    """Entries that the words of a text attest, and how many of its words each stem (written with a star) opens.

    A stem is attested by two words or more of a text: as a lone insult counts for nothing, neither does a lone likeness.
    """
    stems = Counter([w[:k] + "*" for w in words for k in STEMS if len(w) > k])
    return {*words, *(s for s, n in stems.items() if n > 1)}, stems


@dataclass
class Model:
    lexicon: dict[str, float]  # entry -> weight
    weights: np.ndarray

    def scanner(self) -> Scanner:
        return Scanner(self.lexicon)


class Scanner:
    """What the grammar emits over a text."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        classes = {}
        for words, c in ((REPORTS, "R"), (NEGATIONS, "N"), (OTHERS, "G"), (ADDRESSEES, "Y"), (THREATS, "T")):
            classes.update(dict.fromkeys(words, c))
        self.classes = classes | dict.fromkeys(QUOTES, "Q")
        self.find = ahocorasick.Automaton()
        stems: dict[str, bool] = {}  # a word and a stem may share a key: then the stem's longer words are read as well
        for entry in [*lexicon, *THREATS]:
            bare = entry.rstrip("*")
            stems[bare] = stems.get(bare, False) or entry.endswith("*")
        for bare, stem in sorted(stems.items()):
            self.find.add_word(bare, (len(bare), stem))
        self.find.make_automaton()

    def classify(self, word: str) -> tuple[str, float]:
        weight = self.lexicon.get(word, 0.0)
        for k in STEMS:
            if len(word) > k:
                weight = max(weight, self.lexicon.get(word[:k] + "*", 0.0))
        return ("I", weight) if weight else (self.classes.get(word, "O"), 0.0)

    def emitted(self, text: str | None) -> np.ndarray:
        """1, the weight of the strongest insult of the patterns, and per symbol log(1 + number of times it was written).

        Null is empty. The hits only choose the clauses to read, so a text of any length is scanned once.
        """
        out = np.zeros(2 + len(SYMBOLS))
        out[0] = 1
        low = (text or "").lower()
        n = len(low)
        hits = []
        for end, (size, stem) in self.find.iter(low):
            start = end - size + 1
            if (start == 0 or not (low[start - 1].isalnum() or low[start - 1] == "_")) and (
                stem or end + 1 == n or not (low[end + 1].isalnum() or low[end + 1] == "_")
            ):
                hits.append(start)
        if not hits:
            return out
        cuts = [-1, *[m.start() for m in CLAUSE.finditer(low)], n]
        written: Counter[str] = Counter()
        alone, strongest = True, 0.0
        for c in sorted({bisect_right(cuts, h) for h in hits}):
            state = 0
            for word in TOKEN.findall(low[cuts[c - 1] + 1 : cuts[c]]):
                symbol, weight = self.classify(word)
                state, symbol = GRAMMAR[state][symbol]
                if symbol in ("bare", "insult+"):
                    strongest = max(strongest, weight)
                alone, symbol = _chain(alone, symbol)
                if symbol:
                    written[symbol] += 1
        if written["insult"] or written["insult+"]:
            out[1] = strongest
        for i, s in enumerate(SYMBOLS):
            out[2 + i] = math.log1p(written[s])
        return out


def _kept_rows(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """The labelled rows (text string, label int), without repeated texts: of equal texts the larger label stands."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")
    )
    return rows.groupBy("text").agg(F.max("label").alias("label"))


def sample_labels(labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> DataFrame:
    """doc_id and label of at most `most` labelled documents, those whose doc_id hashes lowest; of two labels the larger."""
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias(label))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """A model learned from `labels` (doc_id, label 0 or 1) of `docs`, on at most `most` of them.

    Null labels and doc_ids, and labels without a document, are ignored. With no label at all the model is the grammar with
    its prior weights and the known insults.
    """
    ship(docs.sparkSession)
    chosen = F.broadcast(sample_labels(labels, label, most).select(F.col("doc_id").alias("__id"), F.col(label).alias("__label")))
    joined = docs.select("doc_id", F.col(text).alias(text)).join(chosen, F.col("doc_id") == F.col("__id")).select(F.col(text).alias("text"), F.col("__label").alias("label"))
    # A materialised sample: three passes read it, and it is bounded.
    rows = _kept_rows(joined, "text", "label").persist()
    try:
        return _fitted(rows)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame) -> Model:
    """A model of the sample: rows of text and label, texts distinct."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic, forms = Counter(), Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, stems = features_of(WORD.findall(t.lower()))
                (toxic if y else clean).update(held)
                if y:
                    forms.update({s: n for s, n in stems.items() if s in held})
        names = list(clean.keys() | toxic.keys())
        columns = [pa.array(names, pa.string()), *[pa.array([c[w] for w in names], pa.int64()) for c in (clean, toxic, forms)]]
        yield pa.RecordBatch.from_arrays(columns, names=["entry", "clean", "toxic", "forms"])

    totals = dict(rows.groupBy("label").count().collect())
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    base = (n1 + 1) / (n0 + n1 + 2)
    by_entry = rows.mapInArrow(tidy(counts), "entry string, clean long, toxic long, forms long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "forms")])
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    ratio = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    # A stem that opens several words of a text is better attested than one that opens a single word by chance.
    ratio = ratio * F.greatest(F.lit(1.0), F.least(F.lit(FORMS), F.col("forms") / F.col("toxic")))
    found = (
        by_entry.where((F.col("toxic") >= GAIN) & (share >= PRECISION) & (ratio >= EVIDENCE) | F.col("entry").isin(INSULTS))
        .orderBy(F.col("entry").isin(INSULTS).desc(), ratio.desc(), "entry")
        .limit(ENTRIES)
        .collect()
    )
    stats = {r["entry"]: (r["clean"], r["toxic"]) for r in found}
    candidates = sorted(stats)
    number = {w: i for i, w in enumerate(candidates)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[number[w] for w in features_of(WORD.findall(t.lower()))[0] if w in number] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"held": pa.array(held, pa.list_(pa.int32()))})

    texts = [r["held"] for r in rows.where("label = 1").select("text").mapInArrow(tidy(incidence), "held array<int>").collect()]
    odds = {w: math.log((t + 1.5) / (c + 0.5)) - math.log((n1 + 1.5) / (n0 + 0.5)) for w in sorted({*_cover(texts, candidates, stats), *stats.keys() & set(INSULTS)}) for c, t in [stats[w]]}
    lexicon = {w: round(v, 6) for w, v in odds.items() if v > LEAST_ODDS}
    usual = round(median(lexicon.values()), 6) if lexicon else UNSEEN
    lexicon |= {w: usual for w in INSULTS if w not in stats}  # an insult that no label tells of weighs what others do

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for batch in batches:
            x = [scanner.emitted(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    points = rows.mapInArrow(tidy(measured), "x array<double>, label int").groupBy("x", "label").count().collect()
    return Model(lexicon, _logistic(points))


def _cover(texts: list[list[int]], names: list[str], stats: dict[str, tuple[int, int]]) -> list[str]:
    """Greedy multiple cover: entries that explain most toxic texts not yet explained COVER times; of equals the purer, then the longer."""
    of: dict[int, list[int]] = defaultdict(list)
    for t, held in enumerate(texts):
        for e in held:
            of[e].append(t)
    need = [COVER] * len(texts)
    gain = {e: len(ts) for e, ts in of.items()}
    out = []
    while gain:
        best = max(gain, key=lambda e: (gain[e], -stats[names[e]][0], len(names[e]), names[e]))
        if gain[best] < GAIN:
            break
        out.append(names[best])
        del gain[best]
        for t in of[best]:
            need[t] -= 1
            if need[t] == 0:
                for e in texts[t]:
                    if e in gain:
                        gain[e] -= 1
    return out


def _logistic(points: list) -> np.ndarray:
    """Weights that fit the points (x, label, count), held to PRIOR by a unit penalty; Newton's method."""
    w = PRIOR.copy()
    if not points:
        return w
    points = sorted(points, key=lambda r: (r["x"], r["label"]))
    x = np.array([r["x"] for r in points])
    y = np.array([r["label"] for r in points], float)
    n = np.array([r["count"] for r in points], float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + (w - PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df plus score (double, 0 to 1) and predicted (int, 1 if score >= threshold), from the whole text only.

    Null text is empty; an empty text scores what no evidence scores. Columns score and predicted of df are replaced. Each
    row is scored alone, so repeated rows score alike and an empty df gives an empty result.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = drop_if_there(df, "score", "predicted")
    names = source.columns
    at = names.index(text)
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, weights = shared.value.scanner(), shared.value.weights
        for batch in batches:
            x = np.array([scanner.emitted(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(weights))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return source.mapInArrow(tidy(run), schema)


def held_out():
    """Rows that no model is fitted on: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit_on_folds(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the rows that are not held out; odd labels as in fit()."""
    return fit(docs, labels.where(~held_out()).select("doc_id", "toxic"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    A null text scores as an empty one; a null doc_id is scored and not held out; repeated rows score alike; without labels
    the grammar scores by its prior weights; an empty table gives no rows. Only doc_id and text are read.
    """
    model = fit_on_folds(docs, labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """The documents whose score stays below the threshold, with the columns they came with, whatever their names.

    The model is learned from the labels of `corpus` (docs itself by default). Null and empty texts stay; repeated rows stay
    or go together; an empty table gives an empty one.
    """
    model = fit_on_folds(docs if corpus is None else corpus, labels)
    names = [own_name(docs, f"__c{i}") for i in range(len(docs.columns))]  # so that no column is taken for a score
    renamed = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    return score(renamed, model, text).where("predicted = 0").select(*names).toDF(*docs.columns)

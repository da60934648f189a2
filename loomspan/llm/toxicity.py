"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols: insult, threat, target, negation, report, other; marks that end a clause reset all machines.
Four transducers are composed into one: targets remember whether someone is addressed, negations reach over the next
few words, reported speech covers the rest of its clause, and the emitter turns each insult or threat, in the state of
the other three, into an output symbol. Scores weigh counts of outputs of whole clauses, and how many different insults
the machine put out as neither negated nor reported; a word that a clause negates or reports counts there only.

Insult words are a seed list and stems induced from labelled documents: a stem is a whole word, or the first 4 to 6
letters of one, and then every word that begins with it counts. Weights are learned from labelled documents that taught
no stem.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import bucket, read, slices

#: Bound of the sample of labelled documents that stems and weights are fitted on, chosen by a hash of the id.
SAMPLE = 16_000
#: A stem is a word or a word's first characters, of these lengths.
PREFIXES = (4, 5, 6)
#: A word counts as negated this many words after the negation.
REACH = 3

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = range(7)
SYMBOLS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile dumb fool filthy vermin pig dummkopf trottel abschaum connard abruti crétin imbécil estúpido basura escoria",
    THREAT: "kill hurt destroy beat burn shoot stab crush punish töten umbringen tuer frapper matar golpear",
    TARGET: "you your yours you're u he she they him her them his their those these people tu toi vous votre du dich dein ihr euch sie usted ustedes tus vosotros",
    NEGATION: "not never no nobody none neither nor without isn't aren't don't didn't wasn't nicht kein keine nie ne pas jamais aucun nunca ningún jamás",
    REPORT: "said says say told claims claimed called quoted wrote reported allegedly according sagte sagt laut dit disait selon dijo dice según",
}
TOKEN = re.compile(r"[^\W_](?:[\w']*\w)?|[.!?;:\n]")
#: Outputs of the composed machine and how far each is trusted before learning.
OUTPUTS = ("insult_directed", "insult_bare", "insult_negated", "insult_reported", "threat_directed", "threat_bare", "threat_excused")


def step(state: tuple[int, int, int], symbol: int) -> tuple[tuple[int, int, int], str | None]:
    """One transition of the composition. state: someone addressed, words left in a negation's reach, report open."""
    target, negated, report = state
    if symbol == END:
        return (0, 0, 0), None
    left = max(0, negated - 1)
    if symbol == TARGET:
        return (1, left, report), None
    if symbol == NEGATION:
        return (target, REACH, report), None
    if symbol == REPORT:
        return (target, left, 1), None
    if symbol == INSULT:
        return (target, left, report), "insult_negated" if negated else "insult_reported" if report else "insult_directed" if target else "insult_bare"
    if symbol == THREAT:
        return (target, left, report), "threat_excused" if negated or report else "threat_directed" if target else "threat_bare"
    return (target, left, report), None


def machine() -> dict:
    """All transitions of the composed machine, tabulated."""
    states = [(t, n, r) for t in (0, 1) for n in range(REACH + 1) for r in (0, 1)]
    return {(s, symbol): step(s, symbol) for s in states for symbol in range(7)}


class Grammar:
    def __init__(self, stems: list[str]):
        self.moves = machine()
        self.word = {w: s for s in reversed(SYMBOLS) for w in SYMBOLS[s].split()}
        self.word |= {m: END for m in ".!?;:\n"}
        self.whole = {s[1:] for s in stems if s[0] == "="}
        self.starts = {n: {s for s in stems if s[0] != "=" and len(s) == n} for n in PREFIXES}
        self.known: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        s = self.word.get(word, OTHER)
        if s == OTHER and (word in self.whole or any(word[:n] in self.starts[n] for n in PREFIXES if len(word) >= n)):
            s = INSULT
        if len(self.known) >= 300_000:
            self.known.clear()
        self.known[word] = s
        return s

    def features(self, text: str) -> list[float]:
        """log(1 + clauses) for each output, then log(1 + different insults put out as directed or bare) and 1 if more than one clause matched."""
        known, symbol = self.known, self.symbol
        tokens = TOKEN.findall(text.lower())
        if not any((known[w] if w in known else symbol(w)) <= THREAT for w in set(tokens)):
            return [0.0] * (len(OUTPUTS) + 2)
        state, clause, clauses, matched, said = (0, 0, 0), set(), Counter(), 0, set()
        for w in [*tokens, "."]:
            s = known[w] if w in known else symbol(w)
            state, out = self.moves[state, s]
            if out:
                clause.add(out)
                if out in OUTPUTS[:2]:
                    said.add(w)
            elif s == END and clause:
                clauses.update(clause)
                matched += 1
                clause = set()
        return [*(float(np.log1p(clauses[k])) for k in OUTPUTS), float(np.log1p(len(said))), float(matched > 1)]


def stems_of(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if len(w) >= min(PREFIXES)}
    return {f"={w}" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


def induce(half: DataFrame) -> list[str]:
    """Stems of the insult transducer from (t, y) rows: far commoner in documents labelled 1, and needed to cover them.

    The rows are a sample of bounded size, and so are the stems that are found often enough in it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4 << 20):
            ys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            pos: Counter = Counter()
            neg: Counter = Counter()
            for y, t in zip(ys, texts, strict=True):
                (pos if y else neg).update(stems_of(t or ""))
            keys = list(pos | neg)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["s", "p", "n"])

    sizes = {bool(r["y"]): r["n"] for r in half.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = (sizes.get(False, 0) + 1) / (sizes.get(True, 0) + 1)
    found = half.select("y", "t").mapInArrow(count, "s string, p long, n long").groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    found = found.where((F.col("p") >= 4) & ((F.col("p") + 0.5) * rate >= 25 * (F.col("n") + 0.5))).orderBy(F.desc("p"), F.asc("n"), F.length("s"), "s")
    candidates = {r["s"]: i for i, r in enumerate(found.collect())}
    if not candidates:
        return []

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 4 << 20):
            own = [sorted(candidates[s] for s in stems_of(t or "") & candidates.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], ["c"])

    rows = [set(r["c"]) for r in half.where("y = 1").select("t").mapInArrow(incidence, "c array<int>").collect()]
    names, chosen = list(candidates), []
    gain = Counter(x for r in rows for x in r)
    while gain:
        best = min(gain, key=lambda x: (-gain[x], x))
        if gain[best] < 3:
            break
        chosen.append(names[best])
        for r in rows:
            if best in r:
                gain.subtract(r)
                r.clear()
        del gain[best]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression, the bias last; a sample of one label gives a constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, stems: list[str], weights: np.ndarray):
        self.stems, self.weights = stems, weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Stems from one half of a bounded sample of labelled rows (by hash), weights from the other.

    Without labelled rows the weights of directed insults and threats are 2, the bias -3. A document labelled more
    than once counts with its greatest label; texts that repeat count once.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    n = marks.count()
    if not n:
        return Model([], np.array([2.0, 1.5, 0.2, 0.4, 2.0, 0.3, 0.0, 1.0, 1.0, -3.0]))
    marks = marks.where((F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) / float(1 << 40)) < sample / n)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(marks), id_col)
    rows = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.max("y").alias("y"), F.first("t").alias("t")).persist()
    first = F.pmod("h", F.lit(2)) == 0
    stems = induce(rows.where(first))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(stems)
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "f"])

    out = rows.where(~first).select("y", "t").mapInArrow(gather, "y int, f array<double>").collect()
    rows.unpersist()
    if not out:
        return Model(stems, np.array([2.0, 1.5, 0.2, 0.4, 2.0, 0.3, 0.0, 1.0, 1.0, -3.0]))
    return Model(stems, logistic(np.array([r["f"] for r in out]), np.array([float(r["y"] > 0) for r in out])))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs plus toxicity (0 to 1; a column of that name is replaced). A null text counts as empty.

    Texts of any length are read whole, rows that repeat get equal scores, an empty table gives an empty table; all other
    columns are passed through, whatever their names.
    """
    docs = docs.drop("toxicity")
    stems, weights = model.stems, model.weights
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(stems)
        for batch in slices(batches, text_col):
            x = np.array([own.features(t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]).reshape(-1, len(weights) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, learned from `labels`; nulls, empty and very long texts, repeats, empty tables and other columns as in fit and score."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(bucket("doc_id", 5) != 0).select("doc_id", "toxic"))
    out = score(docs.select("doc_id", "text", (bucket("doc_id", 5) == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}

"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words fall into classes (insult, threat, target, ...). Five small transducers each
follow one thing through a clause: insults, threats after an intention, a target,
negation, reported speech. Their composition is one transducer that writes a pattern
number at every matched word, such as "insult, aimed at a target, not negated, not
reported". A text's score is the logistic of weighted pattern counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylink.llm.sampling import first_by_hash
from entitylink.llm.text import NOT_LETTER, hashes_of, shingle_hashes, slices, text_column, word_bounds, word_hashes
from entitylink.session import materialize

# Starting word lists of the classes; insults are extended from labels.
WORDS = {
    "insult": "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile cretin filth vermin idiota imbecil estúpido basura"
    " escoria abruti crétin ordure minable dummkopf trottel abschaum versager".split(),
    "threat": "kill hurt destroy beat crush stab burn punish matar destruir tuer détruire töten vernichten".split(),
    "intent": "will shall gonna must should voy vamos vais werde wirst".split(),
    "target": "you your yours yourself them they those he she him her tú vosotros vous toi dich euch".split(),
    "negation": "not never no nobody nothing nunca jamás jamais pas nicht kein keine".split(),
    "report": "said says wrote called claimed quoted reported dijo dit sagte".split(),
}
CLASSES = ["other", *WORDS]
# Words a negation or an intention reaches over.
REACH = 3
# Labelled texts the model is fitted on, at most; the first by md5 of doc_id.
SAMPLE = 8000
# A word becomes an insult if it marks toxic texts with this log-likelihood ratio and
# stands in this share of them.
EVIDENCE, SHARE = 24.0, 0.02
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?;\n")] = True


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``step`` maps (state, class) to (next state, output)."""

    start: object
    step: Callable[[object, str], tuple[object, object]]


def _countdown(trigger: str) -> Transducer:
    """Says whether ``trigger`` stood at most REACH words before."""
    return Transducer(0, lambda s, c: (REACH if c == trigger else max(s - 1, 0), s > 0))


def _since(trigger: str) -> Transducer:
    """Says whether ``trigger`` stood earlier in the clause."""
    return Transducer(False, lambda s, c: (s or c == trigger, s))


INSULT = Transducer(None, lambda s, c: (s, c == "insult"))
THREAT = Transducer(0, lambda s, c: (REACH if c == "intent" else max(s - 1, 0), c == "threat" and s > 0))
TARGET, REPORT, NEGATION = _since("target"), _since("report"), _countdown("negation")


def composed(machines: list[Transducer]) -> tuple[np.ndarray, list[list[tuple]]]:
    """Product of ``machines`` over CLASSES: a table of next states and the outputs of each
    (state, class). State 0 is the start."""
    start = tuple(m.start for m in machines)
    number, states, table, outputs = {start: 0}, [start], [], []
    for state in states:  # grows while it is read
        row, out = [], []
        for c in CLASSES:
            moves = [m.step(s, c) for m, s in zip(machines, state)]
            after = tuple(s for s, _ in moves)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
            out.append(tuple(o for _, o in moves))
        table.append(row)
        outputs.append(out)
    return np.array(table), outputs


# A pattern: (insult or threat, targeted, negated, reported); the last is a target after a match.
PATTERNS = [*product(("insult", "threat"), (False, True), (False, True), (False, True)), ("aimed",)]


def _grammar() -> tuple[list[list[int]], list[list[int]]]:
    table, outputs = composed([INSULT, THREAT, TARGET, NEGATION, REPORT])
    patterns = [[-1] * len(CLASSES) for _ in outputs]
    for s, row in enumerate(outputs):
        for c, (insult, threat, *around) in enumerate(row):
            if insult or threat:
                patterns[s][c] = PATTERNS.index(("insult" if insult else "threat", *around))
    return table.tolist(), patterns


NEXT, EMIT = _grammar()
# What a weight is drawn to where labels say nothing (fixed values).
PRIOR = np.array([-3.0] + [{"insult": 3.0, "threat": 3.0}.get(p[0], 0.5) + (p[1] - 1.5 * p[2] - 1.0 * p[3] if len(p) > 1 else 0.0) for p in PATTERNS])


def transduce(classes: list[int]) -> list[int]:
    """Patterns of one clause, given its words' classes."""
    state, out, target = 0, [], CLASSES.index("target")
    for c in classes:
        pattern = EMIT[state][c]
        if pattern >= 0:
            out.append(pattern)
        elif c == target and out:
            out.append(len(PATTERNS) - 1)
        state = NEXT[state][c]
    return out


def lexicon(insults: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and their classes; ``insults`` are hashes found from labels."""
    of = dict.fromkeys(insults.tolist(), CLASSES.index("insult"))
    for name, words in WORDS.items():
        of.update(dict.fromkeys(hashes_of(words).tolist(), CLASSES.index(name)))
    keys = np.array(sorted(of), np.uint64)
    return keys, np.array([of[int(k)] for k in keys])


def pattern_counts(col: pa.Array, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of the patterns in each text."""
    keys, kinds = words
    counts = np.zeros((len(col), len(PATTERNS)))
    core = [CLASSES.index("insult"), CLASSES.index("threat")]
    for i, _, data, offsets in slices(col):
        starts, ends, first = word_bounds(data, offsets, NOT_LETTER)
        if not len(starts):
            continue
        hashes = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        classes = np.where(keys[at] == hashes, kinds[at], 0)
        hits = np.flatnonzero(np.isin(classes, core))
        if not len(hits):
            continue
        # clause number of every word: ends of sentences before it, and a new one for each text
        breaks = np.cumsum(_ENDS[data])
        clause = breaks[starts]
        row = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        edge = np.flatnonzero(np.append(True, (clause[1:] != clause[:-1]) | (row[1:] != row[:-1])))
        for e in np.unique(np.searchsorted(edge, hits, "right") - 1):
            a, b = edge[e], edge[e + 1] if e + 1 < len(edge) else len(starts)
            for pattern in transduce(classes[a:b].tolist()):
                counts[i + row[a], pattern] += 1
    return counts


def _features(counts: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(counts), 1)), np.log1p(counts)), axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fitted(features: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to PRIOR with unit strength."""
    w = PRIOR.copy()
    for _ in range(rounds):
        p = _logistic(features @ w)
        slope = features.T @ (labels - p) - (w - PRIOR)
        curve = (features.T * (p * (1 - p))) @ features + np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _labelled_words(batches):
    """(word, sort, toxic): words of each labelled text once; ``sort`` is its least shingle,
    which near copies mostly share."""
    schema = pa.schema([("word", pa.int64()), ("sort", pa.int64()), ("toxic", pa.int64())])
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for i, _, data, offsets in slices(text_column(batch)):
            starts, ends, first = word_bounds(data, offsets, NOT_LETTER)
            hashes = word_hashes(data, starts, ends)
            shingles, bounds = shingle_hashes(hashes, first)
            for k in range(len(first) - 1):
                own = np.unique(hashes[first[k] : first[k + 1]])
                if len(own):
                    sort = np.full(len(own), shingles[bounds[k] : bounds[k + 1]].min()).view(np.int64)
                    columns = [own.view(np.int64), sort, np.full(len(own), labels[i + k], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def found_insults(sample: DataFrame) -> np.ndarray:
    """Hashes of the words that mark the toxic texts of ``sample`` (text, toxic)."""
    words = sample.select("text", "toxic").mapInArrow(_labelled_words, "word long, sort long, toxic long")
    words = materialize(words, "labelled-words")
    once = words.groupBy("word", "sort").agg(F.max("toxic").alias("toxic"))
    counts = once.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    sorts = words.groupBy("sort").agg(F.max("toxic").alias("toxic")).agg(F.sum("toxic"), F.count("*")).first()
    bad, n = sorts[0] or 0, sorts[1]
    if not 0 < bad < n:
        return np.zeros(0, np.uint64)
    rate = bad / n
    log = lambda x, p: F.when(x > 0, x * F.log(x / (F.col("n") * p))).otherwise(0.0)
    evidence = 2 * (log(F.col("bad"), rate) + log(F.col("n") - F.col("bad"), 1 - rate))
    marks = (F.col("bad") > rate * F.col("n")) & (evidence >= EVIDENCE) & (F.col("bad") >= SHARE * bad)
    # each stands in SHARE of the toxic texts with few others: a small list
    rows = counts.where(marks & (F.col("bad") >= 0.8 * F.col("n"))).select("word").collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


@dataclass
class Model:
    words: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray


def trained(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE) -> Model:
    """Model fitted on at most ``limit`` rows of ``labels`` (doc_id, toxic) where ``learn``
    holds, the first by md5 of doc_id. Rows with a null id or label teach nothing."""
    own = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = first_by_hash(materialize(own, "labels"), F.col("doc_id"), limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "toxic")  # at most ``limit`` rows
    sample = materialize(sample, "labelled")
    words = lexicon(found_insults(sample))

    def run(batches):
        for batch in batches:
            counts = pattern_counts(text_column(batch), words)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * len(PATTERNS)), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), rows], names=["toxic", "counts"])

    # equal feature rows are summed, so what reaches the driver is bounded by ``limit``
    rows = sample.mapInArrow(run, "toxic int, counts array<double>").groupBy("toxic", "counts").count().collect()
    if not rows:
        return Model(words, PRIOR.copy())
    rows = sorted(rows, key=lambda r: (r["toxic"], r["counts"]))
    repeat = [r["count"] for r in rows]
    features = np.repeat(_features(np.array([r["counts"] for r in rows])), repeat, axis=0)
    return Model(words, fitted(features, np.repeat([r["toxic"] for r in rows], repeat)))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= threshold) of every row of ``docs``
    (doc_id, text). Null, empty and clean texts get the score of no pattern; repeated
    rows and null ids are returned as they are; other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            score = _logistic(_features(pattern_counts(text_column(batch), model.words)) @ model.weights)
            columns = [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``threshold``, all columns kept."""

    def run(batches):
        for batch in batches:
            score = _logistic(_features(pattern_counts(text_column(batch), model.words)) @ model.weights)
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's digits leaves ``part``; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))

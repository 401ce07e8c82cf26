"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters.  Words and word beginnings that lean to toxic texts become lexicon voters (each
   votes toxic or abstains), beside fixed pattern voters (which may vote either way).
2. Label model.  A latent class and, per voter, the odds of each vote between the classes,
   fitted by expectation maximisation.  Voters that still agree within a class are
   correlated, and share the evidence where they vote together.
3. Classifier.  Logistic regression on the posterior labels; its inputs are the voters'
   occurrences, so it weighs what the label model only counts as present.

Voters are mined and models fitted on a bounded sample of labelled rows; every text is
scored whole.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import small_batches

# Bounds of the fitting sample and of the model.  They do not depend on the corpus.
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 48 << 20
# A longer text is not learnt from (it is scored whole like any other).
SAMPLE_TEXT = 1 << 20
MAX_VOTERS = 150
STEMS = (4, 5, 6)
MIN_SUPPORT = 8
MIN_PRECISION = 0.9
MIN_CERTAINTY = 0.6
LONG_WORD = 8
MANY_WORDS = 12
COVER = 8
MAX_ODDS = 6.0
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5

_CAPITALS = bytes(range(0x41, 0x5B))
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class ToxicityModel:
    """Lexicon entries (word beginnings; a trailing blank marks a whole word) and weights."""

    lexicon: list[str]
    weights: np.ndarray
    bias: float
    odds: np.ndarray
    correlations: np.ndarray
    prior: float


def held_out(doc_id):
    """Whether a row's label must not be learnt: crc32 of the id as text, modulo FOLDS."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


class Lexicon:
    """Counts of entries in a text; a match counts where a word begins."""

    def __init__(self, entries: list[str]):
        self.size = len(entries)
        self.automaton = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            self.automaton.add_word(entry.rstrip(), (i, len(entry.rstrip()), entry.endswith(" ")))
        if entries:
            self.automaton.make_automaton()

    def counts(self, low: str) -> dict[int, int]:
        found: dict[int, int] = {}
        if not self.size:
            return found
        for end, (i, size, whole) in self.automaton.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha() or whole and low[end + 1:end + 2].isalpha():
                continue
            found[i] = found.get(i, 0) + 1
        return found


# Pattern voters: share of capitals, share of exclamation marks, and no lexicon entry at all.
PATTERNS = ("shouting", "exclaiming", "none")


def features(text: str, lexicon: Lexicon) -> dict[int, float]:
    """Sparse inputs: log counts of the entries, then the patterns."""
    found = lexicon.counts(text.lower())
    row = {i: float(np.log1p(n)) for i, n in found.items()}
    at, size = lexicon.size, max(1, len(text))
    raw = text.encode("utf-8", "surrogatepass")
    row[at] = float((len(raw) - len(raw.translate(None, _CAPITALS))) / size > 0.3)
    row[at + 1] = float(text.count("!") / size > 0.02)
    row[at + 2] = float(not found)
    return {i: v for i, v in row.items() if v}


def _entries(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return {w + " " for w in words} | {w[:k] for w in words for k in STEMS if len(w) >= k}


def _once(texts: list[str]) -> list[int]:
    """Rows without copies and near copies: no row shares one of three minima of the hashes
    of its long words with an earlier row.  Texts of few long words are copies if equal."""
    seen: set[tuple[int, int]] = set()
    rows = []
    for n, text in enumerate(texts):
        words = {w.encode() for w in _WORD.findall(text.lower()) if len(w) >= LONG_WORD}
        if len(words) < MANY_WORDS:
            words = {text.encode("utf-8", "surrogatepass")}
        keys = [(k, min(zlib.crc32(w, k) for w in words)) for k in range(3)]
        if not any(key in seen for key in keys):
            rows.append(n)
        seen.update(keys)
    return rows


def mine_lexicon(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Entries that lean to toxic texts, those that cover most texts first.

    An entry must be frequent in toxic texts that fewer than COVER chosen entries cover, so
    words that merely come along with insults are not taken.  Only entries frequent in toxic
    texts are counted in the others, so memory follows the toxic rows of the sample.
    """
    rows = _once(texts)
    where: dict[str, list[int]] = {}
    for n in rows:
        if toxic[n]:
            for entry in _entries(texts[n]):
                where.setdefault(entry, []).append(n)
    where = {entry: found for entry, found in where.items() if len(found) >= MIN_SUPPORT}
    others = Counter(
        entry for n in rows if not toxic[n] for entry in _entries(texts[n]) if entry in where
    )
    ranked = []
    for entry, found in where.items():
        total = len(found) + others[entry]
        # Lower end of the precision, so that chance words come last.
        p = (len(found) + 1) / (total + 2)
        lower = p - 1.64 * np.sqrt(p * (1 - p) / (total + 3))
        if len(found) >= MIN_PRECISION * total and lower >= MIN_CERTAINTY:
            ranked.append((-len(found), len(entry), entry))
    chosen: list[str] = []
    covered = np.zeros(len(texts), dtype=np.int64)
    for _, _, entry in sorted(ranked):
        # An entry inside one already chosen adds nothing.
        if any(entry.startswith(c.rstrip()) for c in chosen):
            continue
        found = np.array(where[entry])
        if (covered[found] < COVER).sum() < MIN_SUPPORT:
            continue
        covered[found] += 1
        chosen.append(entry)
        if len(chosen) == MAX_VOTERS:
            break
    return chosen


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50):
    """Posterior of class 1, log odds of each voter's votes, correlations between voters.

    ``votes`` has a row per text and a column per voter: 1 votes for the class, -1 against
    it, 0 abstains and says nothing.  ``start`` are first posteriors.  A vote's evidence is
    divided by one plus its correlations, inside the classes, with the other voters that
    vote on the same text: voters that only repeat each other count once.
    """
    cast = (votes != 0).astype(np.float64)
    posterior, related = start.astype(np.float64), None
    odds = np.zeros((votes.shape[1], 2))
    for step in range(rounds):
        if step % 10 == 0:
            related = _correlations(votes, posterior)
            shared = 1 + cast @ related
        mass = np.array([1 - posterior.sum() / len(votes), posterior.sum() / len(votes)])
        for k, vote in enumerate((-1, 1)):
            hits = (votes == vote).astype(np.float64)
            toward = (posterior @ hits + 0.1) / (mass[1] * len(votes) + 1)
            against = ((1 - posterior) @ hits + 0.1) / (mass[0] * len(votes) + 1)
            odds[:, k] = np.clip(np.log(toward / against), -MAX_ODDS, MAX_ODDS)
        evidence = np.where(votes > 0, odds[:, 1], odds[:, 0]) * cast / shared
        grown = 1 / (1 + np.exp(-np.clip(evidence.sum(axis=1) + np.log(prior / (1 - prior)), -30, 30)))
        if np.abs(grown - posterior).max() < 1e-6:
            break
        posterior = grown
    return posterior, odds, related


def _correlations(votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Positive correlations that two voters keep inside the classes, zero on the diagonal."""
    total = np.zeros((votes.shape[1], votes.shape[1]))
    for share in (posterior, 1 - posterior):
        mass = share.sum()
        if mass < 1:
            continue
        centred = votes - (share @ votes) / mass
        cov = (centred * share[:, None]).T @ centred / mass
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        total = np.maximum(total, cov / np.outer(spread, spread))
    np.fill_diagonal(total, 0)
    return np.where(total < 0.1, 0, total)


def logistic(
    x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 30, mass: np.ndarray | None = None
):
    """Weights and bias by Newton steps on soft labels; ``mass`` is how much each row counts."""
    mass = np.ones(len(x)) if mass is None else mass
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (mass * (y - p)) - ridge * w
        curve = (x * (mass * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None) -> ToxicityModel:
    """Voters from the labels; the classifier from the label model's posteriors.

    The given labels are one more voter: its accuracy is estimated like the others', so a
    wrong label is outvoted by what the text says.  ``share`` is the part of all labelled
    rows that is toxic, where the texts were not drawn in that proportion: the classifier
    then weighs the two classes' texts so that they stand for all rows.
    """
    if not len(texts) or not toxic.any():
        # Nothing to learn from: no text is called toxic.
        return ToxicityModel([], np.zeros(len(PATTERNS)), -4.0, np.zeros((0, 2)), np.zeros((0, 0)), 0.0)
    entries = mine_lexicon(texts, toxic)
    lexicon = Lexicon(entries)
    x = np.zeros((len(texts), len(entries) + len(PATTERNS)))
    for n, text in enumerate(texts):
        for i, value in features(text, lexicon).items():
            x[n, i] = value
    prior = float(np.clip(toxic.mean(), 0.01, 0.99))
    votes = np.hstack([np.sign(x), np.where(toxic > 0, 1.0, -1.0)[:, None]])
    votes[:, len(entries) + PATTERNS.index("none")] *= -1
    posterior, odds, related = label_model(votes, np.where(toxic > 0, 0.8, 0.05), prior)
    drawn = toxic.mean()
    mass = None
    if share is not None and 0 < drawn < 1 and 0 < share < 1:
        mass = np.where(toxic > 0, share / drawn, (1 - share) / (1 - drawn))
    weights, bias = logistic(x, posterior, mass=mass)
    return ToxicityModel(entries, weights, bias, odds, related, prior)


def training_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> tuple[list[str], np.ndarray, float | None]:
    """At most about SAMPLE_ROWS labelled texts of the training folds, their labels, and, where
    not all were taken, the toxic share of all such labels.

    Beyond SAMPLE_ROWS labels, up to half of the draw is toxic: a class of few rows is taken
    whole.  Rows are drawn by a hash of the id, so the draw does not depend on partitions.
    Texts beyond SAMPLE_TEXT characters are left out before anything is fetched, and one that
    no longer fits into SAMPLE_BYTES is passed over.
    """
    marks = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("_label")
    )
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy((F.col("_label") > 0).alias("toxic")).agg(
        F.count("*").alias("n")).collect()}
    n, few = sum(sizes.values()), sizes.get(True, 0)
    if n > SAMPLE_ROWS:
        wanted = min(few, max(SAMPLE_ROWS // 2, SAMPLE_ROWS - (n - few)))
        shares = {True: wanted / max(1, few), False: (SAMPLE_ROWS - wanted) / max(1, n - few)}
        bound = F.when(F.col("_label") > 0, int(2**32 * shares[True])).otherwise(int(2**32 * shares[False]))
        marks = marks.filter(
            F.crc32(F.concat(F.lit("draw-"), F.col("doc_id").cast("string")).cast("binary")) < bound
        )
    # About SAMPLE_ROWS ids at most, whatever the number of labels: the texts stay where they are.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).join(F.broadcast(marks), "doc_id")
    rows = rows.filter(F.coalesce(F.char_length("_text"), F.lit(0)) <= min(SAMPLE_TEXT, SAMPLE_BYTES)).select(
        "doc_id", "_text", "_label"
    )
    texts, marked, size = [], [], 0
    for row in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "_text").toLocalIterator():
        body = row["_text"] or ""
        if size + len(body) <= SAMPLE_BYTES:
            size += len(body)
            texts.append(body)
            marked.append(row["_label"])
    return texts, np.array(marked, dtype=np.int64), few / n if n > SAMPLE_ROWS else None


def _chances(model: ToxicityModel, lexicon: Lexicon, texts: list[str | None]) -> np.ndarray:
    weights = model.weights.tolist()
    sums = [
        model.bias + sum(weights[i] * v for i, v in features(body or "", lexicon).items()) for body in texts
    ]
    return 1 / (1 + np.exp(-np.clip(np.array(sums, dtype=np.float64), -30, 30)))


def score(
    docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", out: str = "score"
) -> DataFrame:
    """(doc_id, score): the chance that a text is toxic; null texts are empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value.lexicon)
        for batch in small_batches(batches):
            chance = _chances(shared.value, lexicon, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chance)], ["doc_id", out])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, `{out}` double")


def without_toxic(
    docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value.lexicon)
        for batch in small_batches(batches):
            chance = _chances(shared.value, lexicon, batch.column(place).to_pylist())
            yield batch.filter(pa.array(chance < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are learnt only from rows of the training folds; null labels are ignored, and an
    id labelled twice counts as toxic if either label says so.  Null and empty texts get the
    score of a text without any sign.  Without labelled rows no voter is found and every
    score is below one half.  Null ids belong to the training folds and cannot be labelled.
    An empty table gives no rows; other columns are not read.
    """
    model = fit(*training_sample(docs, labels, doc_id, text, label))
    return score(docs, model, doc_id, text).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

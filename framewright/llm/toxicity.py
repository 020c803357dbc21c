"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Lexicon voters are built from all words and word stems that are far more frequent in labelled toxic training rows; entries of
like odds form a lexicon, which votes by how many distinct words of a text it has. Pattern voters look at shouting, insults
close together and insults after a pronoun. The label model estimates by expectation
maximisation, over all vote patterns of all rows that are not held out (given label included as one more noisy voter),
each voter's rates in either class; voters that agree beyond what the class explains share their weight. A logistic
classifier is then trained on the posteriors.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright import scratch

#: Labelled rows used at most to build lexicons (all below that).
MAX_LABELLED = 500_000
#: Lexicons, by doublings of the odds, the last one open; distinct finds of a lexicon told apart (2 bits).
LEXICONS, LEVELS = 5, 3
#: Letters of a stem; distinct words in toxic rows that make one; words whose entries a worker remembers.
STEM, FAMILY, REMEMBERED = (3, 16), 3, 150_000
#: The share of a voter's weight that its finding nothing has, and how often a toxic and another text is labelled toxic: the setting
#: with the fewest errors (the least log loss among equals) of 15 by `fold_errors` at sf0.1, that is over training rows alone.
ABSENT = 0.75
LABEL_RATES = 0.98, 0.005
#: Folds of doc_ids; the rows of HELD_OUT are never learnt from.
FOLDS, HELD_OUT = 5, 0
PRONOUNS = {"you", "du", "ihr", "tu", "vous", "te", "usted", "eres"}
WORD = r"[\p{L}@$*]+"
TOKENS = regex.compile(WORD)
#: The same matches, faster, for texts without any character of BEYOND.
LATIN = re.compile("[A-Za-z@$*ªµºÀ-ÖØ-öø-ɏ]+")
BEYOND = re.compile("[ɐ-\u1fff\u2070-\U0010ffff]")
SHOUT = re.compile(r"!{2,}|\b[A-Z]{4,}\b\s+\b[A-Z]{4,}\b")


class Entry(NamedTuple):
    """A word, or the stem of words that begin with it; its evidence and its lexicon's number."""

    text: str
    stem: bool
    z: float
    lexicon: int


def in_fold(doc_id, fold: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == fold, F.lit(False))


def held_out(doc_id):
    return in_fold(doc_id, HELD_OUT)


def mine_lexicons(rows: DataFrame) -> list[Entry]:
    """Every word and stem of labelled (text, toxic) rows that is in at least 5 toxic rows and has smoothed odds of at least 8.

    A stem counts each distinct word that begins with it in a row. It has at least FAMILY words in toxic rows, none of which makes
    more than half of its count (else the word stands for itself). No entry is left out for being rarer than others.
    """
    each = rows.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("w"))
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r.toxic is not None}
    share = (sizes.get(0, 0) + 1) / (sizes.get(1, 0) + 1)
    odds = (F.col("t") + 0.5) / (F.col("c") + 0.5) * share
    # The evidence: how many standard deviations the toxic count lies above what the clean rate explains.
    expected = (F.col("c") + 1) / share
    passes = (F.col("t") >= 5) & (odds >= 8)
    lexicon = F.least(F.floor(F.log2(odds / 8)), F.lit(LEXICONS - 1)).cast("int")
    what = [F.col("w"), ((F.col("t") - expected) / F.sqrt(expected)).alias("z"), lexicon.alias("lexicon")]
    words = scratch.written(each.groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")), "toxicity-words")
    least, most = STEM
    cuts = F.transform(F.sequence(F.lit(least), F.least(F.length("w") - 1, F.lit(most))), lambda k: F.substr(F.col("w"), F.lit(1), k))
    stems = words.filter(F.length("w") > least).select("t", "c", F.explode(cuts).alias("w"))
    stems = stems.groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.max("t").alias("top"), F.count_if(F.col("t") > 0).alias("n"))
    whole = [Entry(r.w, False, r.z, r.lexicon) for r in words.filter(passes).select(*what).collect()]
    stem = {r.w: Entry(r.w, True, r.z, r.lexicon) for r in stems.filter(passes & (F.col("n") >= FAMILY) & (2 * F.col("top") <= F.col("t"))).select(*what).collect()}

    def count(batches):
        rows_of = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                rows_of.update({w[:k] for w in set(TOKENS.findall(t.lower())) for k in range(least, min(len(w) - 1, most) + 1)} & stem.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(rows_of), pa.string()), pa.array(list(rows_of.values()), pa.int64())], ["w", "n"])

    if stem:
        spread = rows.filter("toxic = 1").select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
        stem = {r.w: stem[r.w] for r in spread.filter("n >= 5").collect()}
    return sorted([*whole, *stem.values()])


class Voters:
    """Distinct words of each lexicon in a text, and finds of the patterns."""

    def __init__(self, entries: list[Entry]):
        self.words = {e.text: e for e in entries if not e.stem}
        self.stems = {e.text: e for e in entries if e.stem}
        self.starts = {x[: STEM[0]] for x in (*self.words, *self.stems)}
        self.memory: dict[str, int] = {}

    def lexicon(self, word: str) -> int:
        """The lexicon of the word's entry of most evidence, longer ones first; -1 for none."""
        found = [e for k in range(STEM[0], min(len(word) - 1, STEM[1]) + 1) if (e := self.stems.get(word[:k]))]
        found += [e] if (e := self.words.get(word)) else []
        return max(found, key=lambda e: (e.z, len(e.text))).lexicon if found else -1

    def counts(self, text: str) -> list[int]:
        """The distinct words of each lexicon, then insults close together, insults after a pronoun and shouts."""
        low = text.lower()
        tokens = TOKENS if BEYOND.search(low) else LATIN
        out = [0] * (LEXICONS + 3)
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        starts, least, memory = self.starts, STEM[0], self.memory
        hits = set()
        for w in set(tokens.findall(low)):
            if w[:least] in starts:
                k = memory.get(w)
                if k is None:
                    k = memory[w] = self.lexicon(w)
                if k >= 0:
                    out[k] += 1
                    hits.add(w)
        if hits:
            last = pronoun = None
            for i, m in enumerate(tokens.finditer(low)):
                if m.group() in hits:
                    out[-3] += last is not None and m.start() - last < 40
                    out[-2] += pronoun is not None and i - pronoun <= 4
                    last = m.end()
                elif m.group() in PRONOUNS:
                    pronoun = i
        out[-1] = len(SHOUT.findall(text))
        return out

    def votes(self, text: str) -> int:
        """Two bits for each lexicon's count (LEVELS at most), one for each pattern."""
        c = self.counts(text)
        return sum(min(n, LEVELS) << 2 * i for i, n in enumerate(c[:LEXICONS])) + sum((n > 0) << 2 * LEXICONS + i for i, n in enumerate(c[LEXICONS:]))


def unpacked(votes: np.ndarray) -> np.ndarray:
    """A column for each voter: the lexicons' levels, 0 to LEVELS, then the patterns, 0 or 1."""
    at = np.array([*range(0, 2 * LEXICONS, 2), *range(2 * LEXICONS, 2 * LEXICONS + 3)])
    return votes[:, None] >> at & np.array([3] * LEXICONS + [1] * 3)


def label_model(votes: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 100, absent: float = ABSENT, label_rates: tuple[float, float] = LABEL_RATES) -> dict:
    """Rates of each voter's answers, of the label and of the class from patterns (votes 0 to LEVELS; label 1, 0 or -1 for none) and their counts."""
    x, w = votes.astype(float), count.astype(float)
    answers = votes[:, :, None] == np.arange(LEVELS + 1)
    q = np.where(label >= 0, 0.05 + 0.9 * label, np.where(x[:, :-1].sum(1) > 0, 0.8, 0.05))
    weight = np.ones(x.shape[1])
    # The given labels set how frequent the class is; how often they are right is a parameter, so that no other class takes its place.
    prior = (w[label == 1].sum() + 1) / (w[label >= 0].sum() + 2)
    l1, l0 = label_rates
    for _ in range(rounds):
        one, none = w * q, w * (1 - q)
        p1, p0 = ((np.tensordot(v, answers, 1) + 1) / (v.sum() + LEVELS + 1) for v in (one, none))
        # Correlation of voters beyond the class: residuals' correlation, shared out as weight.
        rest = x - (q[:, None] * (one @ x / one.sum()) + (1 - q)[:, None] * (none @ x / none.sum()))
        cov = (rest * w[:, None]).T @ rest / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        weight = 1 / np.maximum(1, np.clip(cov / sd / sd[:, None], 0, 1).sum(0))
        # That several lexicons find nothing is one sign rather than several, as each is mostly of one language.
        said = answers * np.log(p1 / p0)
        score = np.log(prior / (1 - prior)) + (weight * (said[:, :, 1:].sum(2) + absent * said[:, :, 0])).sum(1)
        score = score + np.where(label == 1, np.log(l1 / l0), np.where(label == 0, np.log((1 - l1) / (1 - l0)), 0))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return {"posterior": q, "rates": (p1, p0), "weight": weight, "prior": prior}


def fit_linear(x: np.ndarray, q: np.ndarray, w: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft labels q with weights w, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.linalg.solve(h, x.T @ (w * (q - p)) - ridge * b)
    return b


def _features(votes: np.ndarray) -> np.ndarray:
    """For each lexicon whether it has at least 1, 2, LEVELS distinct words, the patterns, whether any has one and how many all have."""
    steps = (votes[:, :-3, None] >= np.arange(1, LEVELS + 1)).reshape(len(votes), -1)
    found = votes[:, :-3].sum(1)[:, None]
    return np.hstack([steps, votes[:, -3:], found > 0, np.minimum(found, 2 * LEVELS)]).astype(float)


#: Weights of a model that has seen no label: every score is low.
UNTAUGHT = np.array([*[0.0] * (LEXICONS * LEVELS + 3 + 2), -3.0])


def taught(docs: DataFrame, labels: DataFrame, fold: int = HELD_OUT) -> tuple[DataFrame, Voters]:
    """(labels by doc_id: any 1 makes it 1; voters), from rows that are not of the fold; lexicons from at most about MAX_LABELLED labelled ones."""
    marks = labels.select("doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = scratch.written(marks.filter(~in_fold(F.col("doc_id"), fold)), "toxicity-marks")
    n = marks.count()
    use = marks if n <= MAX_LABELLED else marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(MAX_LABELLED / n * (1 << 30)))
    # At most about MAX_LABELLED labels are broadcast, so that no text is shuffled.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(use), "doc_id")
    return marks, Voters(mine_lexicons(rows.select("text", "toxic")))


def voted(docs: DataFrame, voters: Voters, fold: int = HELD_OUT) -> DataFrame:
    """doc_id, held_out (whether it is of the fold) and votes of each row; every text is read once."""

    def vote(batches):
        for b in batches:
            bits = [voters.votes(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(bits, pa.int64())], ["doc_id", "held_out", "votes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", in_fold(F.col("doc_id"), fold).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(vote, f"doc_id {kind}, held_out boolean, votes long")


def patterns(votes: DataFrame, marks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, count, label) of the vote patterns of all rows that are not held out: at most 3 * 2 ** (2 * LEXICONS + 3) of them."""
    rows = votes.filter("not held_out").join(marks, "doc_id", "left")
    found = rows.groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("votes", "label").toPandas()
    return found["votes"].to_numpy(np.int64), found["n"].to_numpy(float), found["label"].to_numpy()


def fitted(votes: np.ndarray, count: np.ndarray, label: np.ndarray, **setting) -> np.ndarray:
    """Linear weights from the label model's posteriors."""
    x = unpacked(votes)
    return fit_linear(_features(x), label_model(x, count, label, **setting)["posterior"], count)


def train(votes: DataFrame, marks: DataFrame) -> np.ndarray:
    """Linear weights, from all rows that are not held out."""
    if marks.isEmpty():
        return UNTAUGHT
    found = patterns(votes, marks)
    return fitted(*found) if len(found[0]) else UNTAUGHT


def fold_errors(docs: DataFrame, labels: DataFrame, settings: list[dict]) -> list[tuple[int, int, float]]:
    """(toxic rows missed, false alarms, log loss) of each setting of the label model, by folds of the training rows.

    Each fold but the held-out one is left out in turn, lexicons included, and scored; held-out rows are taken away before anything.
    """
    own = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    out = [(0, 0, 0.0)] * len(settings)
    for fold in (f for f in range(FOLDS) if f != HELD_OUT):
        marks, voters = taught(own, labels, fold)
        votes = scratch.written(voted(own, voters, fold), "toxicity-votes")
        truth = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        asked = votes.filter("held_out").join(truth, "doc_id").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).toPandas()
        found, y, n = patterns(votes, marks), asked["toxic"].to_numpy() == 1, asked["n"].to_numpy(float)
        for i, setting in enumerate(settings):
            s = _scores(asked["votes"].to_numpy(np.int64), fitted(*found, **setting))
            missed, alarms, loss = n[y & (s < 0.5)].sum(), n[~y & (s >= 0.5)].sum(), -(n * np.log(np.where(y, s, 1 - s))).sum()
            out[i] = out[i][0] + int(missed), out[i][1] + int(alarms), out[i][2] + float(loss)
        scratch.discard(marks, votes)
    return out


def _scores(votes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(unpacked(votes)) @ weights[:-1] + weights[-1], -30, 30)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs` (doc_id, text); labels (doc_id, toxic) teach only rows not held out.

    Null and empty texts have no votes and get the score of no votes. Repeated rows get a row each, of the same score; of labels
    that differ for one doc_id, 1 holds. Without labels all scores are below 0.05. An empty table gives an empty result. A null
    doc_id is not held out and has no label. Other columns are ignored.
    """
    marks, voters = taught(docs, labels)
    votes = scratch.written(voted(docs, voters), "toxicity-votes")
    weights = train(votes, marks)
    scratch.discard(marks)

    def each(batches):
        for b in batches:
            s = _scores(b.column("votes").to_numpy(), weights)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return votes.mapInArrow(each, f"doc_id {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without rows predicted toxic; same columns. Each row goes by its own text, whatever its doc_id, null included."""
    marks, voters = taught(docs, labels)
    votes = scratch.written(voted(docs, voters), "toxicity-votes")
    weights = train(votes, marks)
    scratch.discard(marks, votes)
    # Patterns of votes are few: what each scores is worked out once.
    known: dict[int, bool] = {}

    def clean(batches):
        for b in batches:
            bits = [voters.votes(t or "") for t in b.column("text").to_pylist()]
            for v in set(bits).difference(known):
                known[v] = bool(_scores(np.array([v], np.int64), weights)[0] < 0.5)
            yield b.filter(pa.array([known[v] for v in bits], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)

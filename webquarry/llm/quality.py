"""Quality scores from weak labels: heuristic labellers, a label model, and a hashed linear scorer.

Overlapping heuristics vote good, bad or abstain on each whole text. Expectation-maximisation over
the counts of vote patterns of the whole corpus estimates how often each labeller gives each
vote on good and on bad texts, without any true label; the patterns (at most 3^10, whatever
the corpus) are all that reaches the driver. Posterior labels of a bounded sample
(about ``FIT_DOCS`` windows of ``FIT_CHARS``) train a logistic scorer on hashed token features, which
then scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices
from .token_count import Memo

FIT_DOCS = 6_000
FIT_CHARS = 2_000
HASH = 1 << 16
EM_ROUNDS = 100
TRAIN_ROUNDS = 300
MEMO = 250_000
FALSE_ALARM = 0.02  # where the estimate of bad votes on good texts starts
KNOWS = 0.7  # where the estimate of bad votes on a labeller's own kind of bad texts starts
BELIEF = 20.0  # votes that these starting points weigh in the estimates, whatever the corpus
GOOD, BAD, ABSTAIN = 1, 0, 2

#: Frequent function words of the languages handled.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for as with was on be by are this or from "
    "der die das und in zu den von mit ist des sich auf für ein eine dem nicht "
    "le la les de des et un une du que qui dans en est pour par sur au pas "
    "el los las y del se una por con para su al lo como".split()
)
_SYMBOLS = [ord(c) for c in "#$%&*@^_=~<>{}[]\\|+"]
_SPACE = [9, 10, 11, 12, 13, 32]


def _vote(value: float, good: float, bad: float) -> int:
    """good if value is at most ``good``, bad if at least ``bad``, else abstain."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


#: The labellers, in the order of the votes.
LABELLERS = ("symbols", "capitals", "digits", "exclamation", "repeated_lines", "word_runs", "distinct_words", "distinct_pairs", "word_length", "function_words")


class Measures(NamedTuple):
    """What labellers and scorer both need of a whole text."""

    words: list[str]
    runs: float
    pairs: float
    lines: int
    repeated: float


def measured(text: str | None) -> Measures | None:
    """None for a null or blank text."""
    words = (text or "").lower().split()
    if not words:
        return None
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    return Measures(words, sum(map(eq, words, words[1:])) / n, 1 - len(set(zip(words, words[1:]))) / n, len(lines), 1 - len(set(lines)) / max(1, len(lines)))


def votes(text: str | None, m: Measures | None = None) -> tuple[int, ...]:
    """One vote of each labeller on the whole text; all abstain on a null or blank text.

    The function words are those of four languages: on texts that aren't mostly in Latin letters their labeller abstains.
    """
    m = m or measured(text)
    if m is None:
        return (ABSTAIN,) * len(LABELLERS)
    words, n = m.words, len(m.words)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256).tolist()
    ink = max(1, sum(count) - sum(count[c] for c in _SPACE))
    upper = sum(count[65:91])
    letters = max(1, upper + sum(count[97:123]))
    return (
        _vote(sum(count[c] for c in _SYMBOLS) / ink, 0.005, 0.03) if ink >= 40 else ABSTAIN,
        _vote(upper / letters, 0.12, 0.3) if ink >= 40 else ABSTAIN,
        _vote(sum(count[48:58]) / ink, 0.03, 0.3) if ink >= 40 else ABSTAIN,
        _vote(count[33] / n, 0.05, 0.15) if n >= 5 else ABSTAIN,
        _vote(m.repeated, 0.1, 0.3) if m.lines > 3 else ABSTAIN,
        _vote(m.runs, 0.03, 0.1) if n >= 10 else ABSTAIN,
        _vote(-len(set(words)) / n**0.8, -1.4, -0.8) if n >= 20 else ABSTAIN,
        _vote(m.pairs, 0.2, 0.5) if n >= 20 else ABSTAIN,
        _vote(abs(ink / n - 6.0), 3.0, 6.0) if n >= 5 else ABSTAIN,
        _vote(-sum(map(FUNCTION_WORDS.__contains__, words)) / n, -0.12, -0.05) if n >= 20 and 2 * (letters + count[0xC3]) >= ink - sum(count[48:58]) else ABSTAIN,
    )


def packed(v: tuple[int, ...]) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def unpacked(p: int, n: int = len(LABELLERS)) -> list[int]:
    out = []
    for _ in range(n):
        p, x = divmod(p, 3)
        out.append(x)
    return out[::-1]


class LabelModel:
    """Latent classes: one of good texts, and for each labeller a kind of bad text that it is the first to know.

    Bad texts come in kinds (noise, shouting, repetition) of which each labeller sees some, so that one
    bad class whose votes are independent would take most of them for good. ``share`` holds
    the classes' shares, ``tables[labeller, class, vote]`` how often a cast vote is bad or good; class 0 is good.
    Abstaining says nothing.
    """

    def __init__(self, share: np.ndarray, tables: np.ndarray):
        self.share, self.tables = share, tables

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        """P(class) of each pattern (rows of votes)."""
        logs = np.concatenate([np.log(self.tables), np.zeros((*self.tables.shape[:2], 1))], axis=2)
        score = np.log(self.share) + sum(logs[k][:, patterns[:, k]].T for k in range(patterns.shape[1]))
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of each pattern."""
        return self.classes(patterns)[:, 0]

    def accuracies(self) -> np.ndarray:
        """Of each labeller: the chance that a cast vote is right."""
        return self.share[0] * self.tables[:, 0, GOOD] + self.tables[:, 1:, BAD] @ self.share[1:]

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """EM from the belief that good texts seldom get a bad vote and that each kind's own labeller sees it.

        The belief breaks the symmetry between classes and weighs BELIEF votes for each labeller and class, so that the
        corpus's votes decide; a labeller whose votes fit no class ends with an accuracy near chance.
        """
        k = patterns.shape[1]
        start = np.empty((k, k + 1, 2))
        start[:, 1:] = [1 / 3, 2 / 3]
        start[:, 0] = [FALSE_ALARM, 1 - FALSE_ALARM]
        start[range(k), range(1, k + 1)] = [KNOWS, 1 - KNOWS]
        belief = BELIEF * start
        model = cls(np.array([0.95] + [0.05 / k] * k), start)
        before = np.zeros(len(patterns))
        for _ in range(EM_ROUNDS):
            p = model.classes(patterns)
            w = p * counts[:, None]
            seen = np.stack([[w[patterns[:, j] == v].sum(axis=0) for v in (BAD, GOOD)] for j in range(k)]).transpose(0, 2, 1)
            tables = seen + belief
            share = w.sum(axis=0) + 1.0 / k
            model = cls(share / share.sum(), tables / tables.sum(axis=2, keepdims=True))
            if np.abs(p[:, 0] - before).max(initial=0) < 1e-6:
                break
            before = p[:, 0]
        return model


def _feature(i: int, text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), i) & (HASH - 1)


_PLAIN_SHAPES = {s: (_feature(0, s), _feature(1, "w")) for s in ("x", "xx", "X", "Xx", "Xxx")}


def token_features(token: str) -> tuple[int, int, int, int]:
    """Hashed features of a white-space token: its shape, its edges, its lower-case form, its last two characters."""
    if token.isalpha() and token.isascii() and (token.islower() or token[0].isupper() and (len(token) == 1 or token[1:].islower())):
        n = len(token)  # plain words have one of five shapes
        shape, edge = _PLAIN_SHAPES["x" * min(n, 2) if token.islower() else "X" + "x" * min(n - 1, 2)]
    else:
        drawn = re.sub(r"(.)\1+", r"\1\1", "".join(["X" if "A" <= c <= "Z" or "À" <= c <= "Þ" else "9" if c.isdecimal() else "x" if c.isalnum() else c for c in token]))
        shape, edge = _feature(0, drawn), _feature(1, re.sub(r"^\w+|\w+$", "w", token))
    return shape, edge, _feature(2, token.lower()), _feature(3, token[-2:])


#: Features of the whole text that no single token shows: shares of repeated neighbours, pairs and lines.
_TEXT_FEATURES = [zlib.crc32(x, 9) & (HASH - 1) for x in (b"runs", b"pairs", b"lines")]


def text_features(m: Measures) -> tuple[float, float, float]:
    return m.runs, max(0.0, m.pairs - 1 / len(m.words)), m.repeated


class Scorer:
    """Logistic score of the mean token weight and the text features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.table = weights.tolist()
        self.memo = Memo(MEMO, self.token)

    def __reduce__(self):
        return Scorer, (self.weights, self.bias)

    def token(self, token: str) -> float:
        t = self.table
        a, b, c, d = token_features(token)
        return t[a] + t[b] + t[c] + t[d]

    def score(self, text: str | None, m: Measures | None = None) -> float:
        """0 to 1; 0 for a null or blank text."""
        m = m or measured(text)
        if m is None:
            return 0.0
        tokens = text.split()
        x = self.bias + sum(map(self.memo.__getitem__, tokens)) / len(tokens) + sum(self.table[i] * v for i, v in zip(_TEXT_FEATURES, text_features(m)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))

    @classmethod
    def fit(cls, texts: list[str], target: np.ndarray) -> Scorer:
        """Logistic regression on soft labels by Adam; deterministic."""
        rows, cols, vals = [], [], []
        for i, text in enumerate(texts):
            tokens = text.split()
            if not tokens:
                continue
            ids, n = np.unique(np.array([f for t in tokens for f in token_features(t)], dtype=np.int64), return_counts=True)
            rows.append(np.full(len(ids) + len(_TEXT_FEATURES), i))
            cols.append(np.concatenate([ids, _TEXT_FEATURES]))
            vals.append(np.concatenate([n / len(tokens), text_features(measured(text))]))
        if not rows:
            return cls(np.zeros(HASH), 0.0)
        r, c, x = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
        w, bias, n = np.zeros(HASH), 0.0, len(texts)
        m, v, mb, vb = np.zeros(HASH), np.zeros(HASH), 0.0, 0.0
        for t in range(1, TRAIN_ROUNDS + 1):
            z = np.bincount(r, weights=w[c] * x, minlength=n) + bias
            off = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
            g = np.bincount(c, weights=off[r] * x, minlength=HASH) / n + 1e-6 * w
            gb = off.mean()
            m, v = m + 0.1 * (g - m), v + 0.01 * (g * g - v)
            mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
            a = 0.1 / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
            w -= a * m / (np.sqrt(v) + 1e-9)
            bias -= a * mb / (np.sqrt(vb) + 1e-9)
        return cls(w.astype(np.float32), float(bias))


@F.arrow_udf(T.IntegerType())
def votes_udf(texts: pa.Array) -> pa.Array:
    return by_slices(texts, lambda rows: pa.array([packed(votes(t)) for t in rows], pa.int32()))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, Scorer]:
    """The label model from all rows, and the scorer from its posteriors on a bounded sample."""
    text = F.col(text_col)
    counts = docs.select(votes_udf(text).alias("p")).groupBy("p").count().collect()  # at most 3^10 rows
    patterns = np.array([unpacked(r["p"]) for r in counts], dtype=np.int64).reshape(-1, len(LABELLERS))
    numbers = np.array([r["count"] for r in counts], dtype=np.float64)
    model = LabelModel.fit(patterns, numbers)
    total = max(1, int(numbers.sum()))
    width = 1 << 40
    h = F.xxhash64(F.col(id_col), text)
    picked = docs.where(F.pmod(h, F.lit(width)) < width * min(1.0, FIT_DOCS / total))
    free = F.greatest(F.length(text) - FIT_CHARS, F.lit(0)) + 1
    window = F.substr(text, (F.pmod(F.shiftrightunsigned(h, 17), free) + 1).cast("int"), F.lit(FIT_CHARS))
    rows = picked.where(text.rlike("\\S")).select(window.alias("t"), votes_udf(text).alias("p"), h.alias("h")).collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    of = np.array([unpacked(r["p"]) for r in rows], dtype=np.int64).reshape(-1, len(LABELLERS))
    return model, Scorer.fit([r["t"] for r in rows], model.posterior(of) if len(rows) else np.zeros(0))


def labeller_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``labeller``, ``accuracy``: the estimated chance that a vote it casts is right; a row for each labeller."""
    model, _ = train(docs, id_col, text_col)
    return docs.sparkSession.createDataFrame(list(zip(LABELLERS, model.accuracies().tolist())), "labeller string, accuracy double")


def assess(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``votes``, ``posterior``, ``score``, ``keep`` (score >= threshold).

    votes has a letter for each labeller (+ good, - bad, . abstains); posterior is the label model's P(good).
    Null and blank texts score 0 and aren't kept. Repeated rows stay repeated; an empty table gives
    no rows; other columns are not read. Whole texts are voted on and scored.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))
    kind = T.StructType([T.StructField("votes", T.StringType()), T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def assessed(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda rows: assess_rows(rows, *held.value))

    rows = docs.select(F.col(id_col).alias("doc_id"), assessed(F.col(text_col)).alias("a"))
    return rows.select("doc_id", "a.votes", "a.posterior", "a.score", (F.col("a.score") >= threshold).alias("keep"))


def assess_rows(rows: list[str | None], model: LabelModel, scorer: Scorer) -> pa.Array:
    cast, scores = [], []
    for t in rows:
        m = measured(t)
        cast.append(votes(t, m))
        scores.append(scorer.score(t, m))
    p = model.posterior(np.array(cast, dtype=np.int64).reshape(-1, len(LABELLERS)))
    marks = ["".join("-+."[x] for x in v) for v in cast]
    return pa.StructArray.from_arrays([pa.array(marks, pa.string()), pa.array(p, pa.float64()), pa.array(scores, pa.float64())], names=["votes", "posterior", "score"])

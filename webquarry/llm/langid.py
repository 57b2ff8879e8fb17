"""Language identification of words in code-switched text by a linear-chain conditional random field.

Every word (run of letters) gets a label. Emission features: prefixes and suffixes, byte n-grams of the
bounded word, membership in lexicons of each language's frequent words, all hashed to one weight table;
transitions between neighbouring labels are learned. Word marginals come from forward-backward
over the whole text, and a document's language is the one with the largest mean marginal.

Training: a bounded sample of labelled windows (``WINDOWS`` of ``WINDOW_CHARS`` for each language), spliced into
code-switched sequences of ``LENGTH`` words, fitted by Adam on the driver with numpy.

Prediction keeps memory bounded: emissions are memoised by word, and texts are run in groups of about
``GROUP_WORDS`` words, cut into blocks of ``BLOCK`` words. Block transfer matrices are chained for exact messages
across blocks, so that a text of any length is one chain and all blocks advance together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices

HASH = 1 << 18
WINDOWS = 400  # labelled windows a language
WINDOW_CHARS = 1500
LENGTH = 32  # words of a training sequence
SWITCH = 0.1  # chance that the next word of a training sequence comes from another window
LEXICON = 300  # frequent words a language
LANGUAGES = 200  # languages learned at most, the most frequent
EPOCHS = 6
BLOCK = 64
GROUP_WORDS = 200_000  # with four languages; fewer with more
MEMO = 250_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str, lexicons: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed features of a lower-case word."""
    crc, mask = zlib.crc32, HASH - 1
    w = b"^" + word.encode("utf-8", "replace") + b"$"
    n = len(w)
    out = [crc(w[:k], 1) & mask for k in (2, 3, 4) if k < n] + [crc(w[-k:], 2) & mask for k in (2, 3, 4) if k < n]
    out += [crc(w[i : i + 2]) & mask for i in range(n - 1)] + [crc(w[i : i + 3]) & mask for i in range(n - 2)]
    out += [crc(b"in lexicon %d" % k, 3) & mask for k in lexicons.get(word, ())]
    return out


class Model:
    """Weights of the field. ``labels`` in order, ``emit`` (HASH, labels), ``step`` (labels, labels)."""

    def __init__(self, labels: list[str], lexicons: dict[str, tuple[int, ...]]):
        self.labels, self.lexicons = labels, lexicons
        self.emit = np.zeros((HASH, len(labels)), dtype=np.float32)
        self.step = np.zeros((len(labels), len(labels)))
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)))

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "rows": np.zeros((0, len(self.labels)))}

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp(score), scaled to a largest value of 1, a row for each distinct new word, kept by the memo."""
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            self.rows = self.rows[:0]
            new = list(dict.fromkeys(words))
        if new:
            ids = [features(w, self.lexicons) for w in new]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(sizes.sum()))
            score = np.add.reduceat(self.emit[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0).astype(np.float64)
            score = np.exp(np.maximum(score - score.max(axis=1, keepdims=True), -60.0))
            at = len(self.rows)
            self.rows = np.concatenate([self.rows, score])
            memo.update(zip(new, range(at, at + len(new))))
        return self.rows[np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))]

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Word marginals of chains that lie one after another in ``emission``; exact for any length."""
        size = emission.shape[1]
        step = np.exp(self.step - self.step.max())
        blocks = -(-lengths // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])  # first block of each chain
        total = int(first[-1])
        starts = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), blocks) + (np.arange(total) - np.repeat(first[:-1], blocks)) * BLOCK
        ends = np.minimum(starts + BLOCK, np.repeat(np.cumsum(lengths), blocks))
        at = starts[:, None] + np.arange(BLOCK)
        real = at < ends[:, None]
        e = np.where(real[:, :, None], emission[np.minimum(at, len(emission) - 1)], 1.0)

        # Transfer matrix of each block; past a chain's end nothing changes.
        move = np.broadcast_to(np.eye(size), (total, size, size)).copy()
        for t in range(BLOCK):
            live = real[:, t]
            if live.all():
                move = (move.reshape(-1, size) @ step).reshape(total, size, size) * e[:, t, None, :]
            else:
                move[live] = (move[live].reshape(-1, size) @ step).reshape(-1, size, size) * e[live, t, None, :]
            if t % 8 == 7:
                move /= move.max(axis=(1, 2), keepdims=True)

        # Messages into and out of blocks, chain by chain, all chains together.
        into, back = np.full((total, size), 1.0 / size), np.full((total, size), 1.0)
        for j in range(1, int(blocks.max(initial=1))):
            of = first[:-1][blocks > j] + j
            v = np.einsum("bi,bij->bj", into[of - 1], move[of - 1])
            into[of] = v / v.sum(axis=1, keepdims=True)
            of = first[1:][blocks > j] - 1 - j
            v = np.einsum("bij,bj->bi", move[of + 1], back[of + 1])
            back[of] = v / v.sum(axis=1, keepdims=True)

        forward = np.empty((total, BLOCK, size))
        v = into
        for t in range(BLOCK):
            v = np.where(real[:, t, None], (v @ step) * e[:, t], v)
            v /= v.sum(axis=1, keepdims=True)
            forward[:, t] = v
        v = back
        for t in range(BLOCK - 1, -1, -1):
            forward[:, t] *= v
            v = np.where(real[:, t, None], (e[:, t] * v) @ step.T, v)
            v /= v.sum(axis=1, keepdims=True)
        out = forward[real]
        return out / out.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, its mean marginal, mean of each word's largest marginal) of each whole text; (und, 0, 0) without a letter."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not self.labels:
            return out
        group, n, most = [], 0, max(BLOCK, GROUP_WORDS * 4 // max(4, len(self.labels)))
        for i, text in enumerate(texts):
            words = [w for w in words_of(text) if w.isalpha() or any(c.isalpha() for c in w)]
            if len(words) > 2 * most:
                out[i] = self._long(words, most)
            elif words:
                group.append((i, words))
                n += len(words)
            if group and (n >= most or i + 1 == len(texts)):
                self._run(group, out)
                group, n = [], 0
        if group:
            self._run(group, out)
        return out

    def _long(self, words: list[str], most: int) -> tuple[str, float, float]:
        """The same for one very long text, ``most`` words at a time: forward over all parts, then back over them."""
        step = np.exp(self.step - self.step.max())
        parts = [words[at : at + most] for at in range(0, len(words), most)]
        v, into = np.full(len(self.labels), 1.0 / len(self.labels)), []
        for part in parts:
            into.append(v)
            for e in self.emissions(part):
                v = (v @ step) * e
                v /= v.sum()
        back, total, sure = np.ones(len(self.labels)), np.zeros(len(self.labels)), 0.0
        for part, v in zip(reversed(parts), reversed(into)):
            emission = self.emissions(part)
            ahead = np.empty_like(emission)
            for t, e in enumerate(emission):
                v = (v @ step) * e
                v /= v.sum()
                ahead[t] = v
            for t in range(len(part) - 1, -1, -1):
                p = ahead[t] * back
                p /= p.sum()
                total += p
                sure += p.max()
                back = (emission[t] * back) @ step.T
                back /= back.sum()
        mean = total / len(words)
        k = int(mean.argmax())
        return self.labels[k], min(1.0, float(mean[k])), min(1.0, sure / len(words))

    def _run(self, group: list[tuple[int, list[str]]], out: list) -> None:
        lengths = np.array([len(w) for _, w in group], dtype=np.int64)
        emission = self.emissions([x for _, w in group for x in w])
        words, starts = self.marginals(emission, lengths), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        mean = np.add.reduceat(words, starts, axis=0) / lengths[:, None]
        sure = np.add.reduceat(words.max(axis=1), starts) / lengths
        for (i, _), m, s in zip(group, mean, sure):
            k = int(m.argmax())
            out[i] = (self.labels[k], min(1.0, float(m[k])), min(1.0, float(s)))


def _gradient(e: np.ndarray, step: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts of a batch: for emission scores (B, T, L) and transitions."""
    b, t, size = e.shape
    p = np.exp(e - e.max(axis=2, keepdims=True))
    a = np.exp(step)
    alpha, beta = np.empty_like(p), np.empty_like(p)
    v = np.full((b, size), 1.0 / size)
    for k in range(t):
        v = (v @ a) * p[:, k]
        v /= v.sum(axis=1, keepdims=True)
        alpha[:, k] = v
    v = np.ones((b, size))
    for k in range(t - 1, -1, -1):
        beta[:, k] = v
        v = (p[:, k] * v) @ a.T
        v /= v.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (p[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    moves = pair.sum(axis=(0, 1))
    np.add.at(moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1.0)
    gamma.reshape(-1, size)[np.arange(b * t), gold.ravel()] -= 1.0
    return gamma, moves


def fit(windows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Train on (text, language) windows; deterministic in their order."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for _, lang in windows})
    tokens = [[w for w in words_of(t) if w.isalpha()] for t, _ in windows]
    own = [labels.index(lang) for _, lang in windows]
    lexicons: dict[str, list[int]] = {}
    for k in range(len(labels)):
        count = Counter(w for ws, o in zip(tokens, own) if o == k for w in ws)
        for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(k)
    model = Model(labels, {w: tuple(v) for w, v in lexicons.items()})
    pools = [[i for i, (ws, o) in enumerate(zip(tokens, own)) if o == k and ws] for k in range(len(labels))]
    live = [k for k, pool in enumerate(pools) if pool]
    if len(live) < 2:
        return model

    count = max(1, sum(map(len, tokens)) // LENGTH)
    seqs, gold = [], np.zeros((count, LENGTH), dtype=np.int64)
    for s in range(count):
        row, k = [], None
        while len(row) < LENGTH:
            k = live[rng.integers(len(live))]
            ws = tokens[pools[k][rng.integers(len(pools[k]))]]
            n = min(int(rng.geometric(SWITCH)), LENGTH - len(row), len(ws))
            at = int(rng.integers(len(ws) - n + 1))
            gold[s, len(row) : len(row) + n] = k
            row += ws[at : at + n]
        seqs.append(row)
    known = {w: np.array(features(w, model.lexicons)) for row in seqs for w in row}
    size = len(labels)
    moments = [np.zeros((HASH, size)), np.zeros((HASH, size)), np.zeros((size, size)), np.zeros((size, size))]
    emit, tick = np.zeros((HASH, size)), 0
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(count), max(1, count // 256)):
            rows = [known[w] for s in batch for w in seqs[s]]
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            flat = np.concatenate(rows)
            score = np.add.reduceat(emit[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            grad, moves = _gradient(score.reshape(len(batch), LENGTH, size), model.step, gold[batch])
            word = np.repeat(np.arange(len(rows)), sizes)
            g = np.stack([np.bincount(flat, weights=grad.reshape(-1, size)[word, k], minlength=HASH) for k in range(size)], axis=1) / len(batch)
            tick += 1
            rate = 0.05 * (1 - epoch / EPOCHS)
            for value, slope, m, v in ((emit, g + 1e-5 * emit, moments[0], moments[1]), (model.step, moves / len(batch), moments[2], moments[3])):
                m += 0.1 * (slope - m)
                v += 0.02 * (slope * slope - v)
                value -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.98**tick)) + 1e-8)
    model.emit = emit.astype(np.float32)
    return model


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """About ``WINDOWS`` windows for each of the ``languages`` most frequent languages, chosen by hash from all labelled rows.

    The sample is bounded in characters, as one text may be longer than all others together: a long row gives a window of
    it, at a place drawn by its hash.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(*([key] if key is not None else []), F.col(text_col)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return []
    bar = F.lit(None).cast("double")
    for lang, n in counts.items():
        bar = F.when(F.col("lang") == lang, min(1.0, (WINDOWS + 4 * WINDOWS**0.5) / n)).otherwise(bar)
    width = 1 << 40
    chosen = rows.where(F.pmod("h", F.lit(width)) < bar * width)
    free = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0)) + 1
    window = F.substr("text", (F.pmod(F.shiftrightunsigned("h", 17), free) + 1).cast("int"), F.lit(WINDOW_CHARS))
    got = chosen.select(window.alias("text"), "lang", "h").collect()
    kept: Counter = Counter()
    out = []
    for r in sorted(got, key=lambda r: (r["h"], r["text"])):
        kept[r["lang"]] += 1
        if kept[r["lang"]] <= WINDOWS:
            out.append((r["text"], r["lang"]))
    return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the labelled rows that aren't held out."""
    return fit(sample(docs.where(~held_out(id_col)), text_col, lang_col, F.col(id_col)))


def predictor(spark, model: Model):
    """A column function text -> struct(lang, score, sure)."""
    held = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.DoubleType())])

    @F.arrow_udf(kind)
    def predicted(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda rows: said(held.value.predict(rows)))

    def said(got: list[tuple]) -> pa.Array:
        columns = zip(*got) if got else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))], names=["lang", "score", "sure"])

    return predicted


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (mean marginal, 0 to 1).

    Trains on rows with a label whose crc32(doc_id) mod 4 is not 2 (a null id is never held out) and predicts
    from the text alone. A null text or one without a letter gives ``und`` with score 0, and so does
    every text if no row is labelled. Repeated rows stay repeated; an empty table gives no rows.
    """
    predicted = predictor(docs.sparkSession, train(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predicted(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def with_language(docs: DataFrame, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without those the model rejects: ``und``, or the words' largest marginals average under ``min_score``.

    Words are judged one by one, so that code-switched texts stay, among however many languages they share their words.
    """
    predicted = predictor(docs.sparkSession, train(docs, id_col, text_col, lang_col))
    marked = docs.withColumn("__wq_lang", predicted(F.col(text_col)))
    return marked.where((F.col("__wq_lang.lang") != UNKNOWN) & (F.col("__wq_lang.sure") >= min_score)).select([F.col(c) for c in docs.columns])

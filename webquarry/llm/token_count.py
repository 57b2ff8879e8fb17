"""Token counts by byte-pair merging with a heap over a linked list, without emitting identifiers.

A pre-token of n byte symbols starts as a doubly linked list; a heap holds the rank of every
adjacent pair. The lowest-rank pair (leftmost on ties) is popped and merged, pairs that no
longer stand are skipped, and new neighbours are pushed. The count is n minus the merges, so
O(n log n) also for very long pre-tokens.

A space between two words always begins a pre-token, so texts are cut at their spaces (by Arrow, a slice of
rows at a time) and each distinct word, with the space before it, is counted by itself. Each Python worker keeps the counts
of ``WORDS`` words and ``MEMO`` pre-tokens at most; these bounds and ``SLICE`` bound its memory, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO = 400_000  # pre-tokens a worker keeps at most, in two generations
WORDS = 500_000  # words a worker keeps at most, some 40 bytes each
MEMO_LEN = 64  # longer pre-tokens are not memoised
#: Letters whose Unicode class is the same in every library version.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я一-龥"
#: Finds characters that are neither such letters, nor ASCII, nor common punctuation; texts that have one are split by the library itself.
PLAIN = re.compile(f"[^\x00-\x1b\x20-\xb1´-¸»¿×÷º{LETTERS}‐-‧‰-⁞€]")
SLICE = 8 << 20  # text bytes cut at a time (one text at least)
_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space on both sides of a space: a pre-token may lie across it, so that such texts aren't cut at their spaces.
SPACED = rf"[{_SPACES}] (?:[{_SPACES}]|\z)"


def plain_splitter(pattern: str):
    """findall for plain texts: the pattern with Python's own classes in place of \\p{L} and \\p{N}, which agree on them."""
    contraction, letters = r"'s|'t|'re|'ve|'m|'ll|'d|", r" ?\p{L}+|"
    if pattern.startswith(contraction + letters):  # words first: they are most of a text, and no word starts with a quote
        pattern = letters + contraction + pattern[len(contraction + letters) :]
    own = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s0-9{LETTERS}]").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return (regex if r"\p" in own else re).compile(own).findall


class Memo(dict):
    """A function's values, kept for at most ``bound`` short words: ``memo[word]`` computes what is not there.

    When the young half is full it becomes the old one, from which words in use come back.
    """

    def __init__(self, bound: int, value):
        super().__init__()
        self.half, self.old, self.value = bound // 2, {}, value

    def __missing__(self, word: str):
        value = self.old.get(word)
        if value is None:
            value = self.value(word)
        if len(word) <= MEMO_LEN:
            self.keep(word, value)
        return value

    def keep(self, word: str, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[word] = value


class WordTable:
    """Values of words as two Arrow arrays, for at most ``bound`` words of at most MEMO_LEN bytes.

    When it is full, words that were asked for again since the last time stay (at most half of the bound).
    """

    def __init__(self, bound: int, kind: pa.DataType):
        self.bound = bound
        self.words, self.values, self.used = pa.array([], pa.string()), pa.array([], kind), np.zeros(0, dtype=bool)

    def of(self, words: pa.Array, compute: Callable[[list[str]], pa.Array]) -> pa.Array:
        """The values of distinct words; ``compute`` gives those of all words that are not kept."""
        at = pc.index_in(words, value_set=self.words)
        missing = words.filter(at.is_null())
        at = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[at[at >= 0]] = True
        at[at < 0] = len(self.words) + np.arange(len(missing))
        new = compute(missing.to_pylist())
        values = pa.concat_arrays([self.values, new]).take(pa.array(at))
        short = pc.less_equal(pc.binary_length(missing), MEMO_LEN)
        self.words = pa.concat_arrays([self.words, missing.filter(short)])
        self.values = pa.concat_arrays([self.values, new.filter(short)])
        self.used = np.concatenate([self.used, np.zeros(len(self.words) - len(self.used), dtype=bool)])
        if len(self.words) > self.bound:
            keep = pa.array(self.used & (np.cumsum(self.used) <= self.bound // 2))
            self.words, self.values = self.words.filter(keep), self.values.filter(keep)
            self.used = np.zeros(len(self.words), dtype=bool)
        return values


class Cut(NamedTuple):
    """Texts cut at their spaces. Text i is parts[first[i]:first[i + 1]]: the first part is ``heads[i]``, of which no
    space was cut off, the others index ``words``, each to be read with a space before it. Where a cut could change
    pre-tokens, the text is uncut: a single part, its head."""

    words: pa.Array
    parts: np.ndarray
    first: np.ndarray
    heads: list[str]


def cut_at_spaces(texts: pa.Array, specials: list[str]) -> Iterator[Cut]:
    """Slices of the texts (null: empty), of about SLICE bytes each."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        some = texts.slice(at, to - at)
        at = to
        uncut = pc.match_substring_regex(some, SPACED)
        for x in specials:
            uncut = pc.or_(uncut, pc.match_substring(some, x))
        cut = pc.split_pattern(pc.if_else(uncut, "", some), " ")
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        flat = cut.flatten()
        heads = flat.take(pa.array(first[:-1])).to_pylist()
        for i in np.flatnonzero(uncut.to_numpy(zero_copy_only=False)):
            heads[i] = some[int(i)].as_py()
        found = flat.dictionary_encode()
        yield Cut(found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), first, heads)


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in stand):
        stand[b] = chr(256 + n)
    return [stand[b] for b in range(256)]


class BytePairCounter:
    """Counts tokens as the byte-level BPE file ``path`` (tokenizers' JSON form) gives them.

    Special strings of the file count as one token each where they occur, the library's default.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE files are handled")
        self.path = path
        ids: dict[str, int] = {}
        self.symbols = [ids.setdefault(s, len(ids)) for s in byte_symbols()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (ids.setdefault(a, len(ids)), ids.setdefault(b, len(ids)))
            self.pairs.setdefault(pair, (rank, ids.setdefault(a + b, len(ids))))
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = plain_splitter(pattern)
        self.memo = Memo(MEMO, self.merged)
        self.special_texts = special
        self.after_space = WordTable(WORDS, pa.int64())
        self.library = None

    def merged(self, word: str) -> int:
        """Tokens of one pre-token."""
        sym = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        n = len(sym)
        if n < 2:
            return n
        pairs = self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = pairs.get((sym[i], sym[i + 1]))
            if found:
                heap.append((found[0], i, sym[i], sym[i + 1], found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # a symbol of this pair has been merged meanwhile
            sym[i], sym[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pairs.get((new, sym[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, new, sym[k], found[1]))
            h = before[i]
            if h >= 0:
                found = pairs.get((sym[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, sym[h], new, found[1]))
        return left

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if PLAIN.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.split(text)

    def summed(self, text: str) -> int:
        """Tokens of a text without special strings, a pre-token at a time."""
        return sum(map(self.memo.__getitem__, self.pieces(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.summed, parts))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of whole texts; 0 for null."""
        out = [np.zeros(0, dtype=np.int64)]
        for cut in cut_at_spaces(texts, self.special_texts):
            of_word = self.after_space.of(cut.words, lambda ws: pa.array([self.summed(" " + w) for w in ws], pa.int64()))
            n = of_word.to_numpy()[cut.parts]
            n[cut.first[:-1]] = list(map(self.count, cut.heads))
            out.append(np.add.reduceat(n, cut.first[:-1]))
        pa.default_memory_pool().release_unused()
        return np.concatenate(out)


_COUNTERS: dict[tuple[str, str], BytePairCounter] = {}


def counter(path: str, pattern: str) -> BytePairCounter:
    """One counter for each worker process and file."""
    key = (path, pattern)
    if key not in _COUNTERS:
        _COUNTERS[key] = BytePairCounter(path, pattern)
    return _COUNTERS[key]


def count_udf(path: str, pattern: str):
    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path, pattern).counts(texts))

    return counted


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows stay repeated; an empty table
    gives no rows; other columns are not read. Texts are never cut.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), count_udf(path, pattern)(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

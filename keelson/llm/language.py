"""Language identification with segmentation-marginalised unigrams.

Pieces are the lower-case entries of a fixed public vocabulary. Each language has one probability per piece, learned by expectation
maximisation; the likelihood of a word is the sum over all its segmentations into pieces, found by a forward pass, and a text's is the
product over its words. The pass runs over all distinct words of a batch at once, position by position.

The fit reads a bounded sample: about `SAMPLE_PER_LANGUAGE` documents of each language, chosen by a hash of their text (all, if fewer).
Memory of the model is (pieces x languages) numbers; the number of languages is taken to be small.

Defined cases: null text, or text without a letter, is `und` with score 0; a table without labelled rows gives `und` for every row;
characters outside the vocabulary cost the same in every language, and ties go to the smallest language; texts of any length are scored
whole; repeated rows give repeated results; extra columns are kept, those named lang_pred or score are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import add_columns
from keelson.session import materialise

SAMPLE_PER_LANGUAGE = 2000
ROUNDS = 3
LONGEST = 8                                       # characters of a piece, the mark of a word's start included
UNKNOWN = 1e-7                                    # probability of one character as a piece of its own, on top of learned pieces
MARK = "▁"
LETTER = re.compile(r"[^\W\d_]")
BASE = np.uint64(0x9E3779B97F4A7C15)
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def read_vocabulary(path: str) -> list[str]:
    """Lower-case pieces of up to LONGEST characters from a SentencePiece model."""
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and len(p) <= LONGEST)


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k code points from each column on; codes is words x positions."""
    h = np.zeros((codes.shape[0], max(0, codes.shape[1] - k + 1)), np.uint64)
    for i in range(k):
        h = h * BASE + codes[:, i:codes.shape[1] - k + 1 + i]
    return h


class Lattice:
    """All segmentations of many words at once, over one vocabulary."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.tables = {}
        for k in range(1, LONGEST + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == k]
            if own:
                h = hashes(np.array([[ord(c) + 1 for c in pieces[i]] for i in own], np.uint64), k)[:, 0]
                order = np.argsort(h)
                self.tables[k] = (h[order], np.array(own, np.int64)[order])

    def find(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the piece that starts at each position, or the number of pieces where there is none."""
        out = {}
        for k, (known, ids) in self.tables.items():
            if codes.shape[1] >= k:
                h = hashes(codes, k)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out[k] = np.where(known[at] == h, ids[at], self.n)
        out.setdefault(1, np.full(codes.shape, self.n))
        return out

    @staticmethod
    def groups(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of about one length at a time: their numbers, lengths and code points (0 past the end)."""
        sizes = np.array([len(w) + 1 for w in words])
        classes = np.ceil(np.log2(np.maximum(sizes, 4))).astype(int)
        for c in np.unique(classes):
            own = np.flatnonzero(classes == c)
            step = max(1, 4_000_000 >> int(c))
            for part in (own[i:i + step] for i in range(0, len(own), step)):
                codes = np.zeros((len(part), int(sizes[part].max())), np.uint64)
                for r, i in enumerate(part):
                    codes[r, :sizes[i]] = np.frombuffer((MARK + words[i]).encode("utf-32-le", "surrogatepass"), np.uint32)
                    codes[r, :sizes[i]] += np.uint64(1)
                yield part, sizes[part], codes

    def weights(self, probs: np.ndarray, k: int) -> np.ndarray:
        """Rows of probabilities by piece number; the row after the last is for no piece."""
        none = np.full((1, probs.shape[1]), UNKNOWN if k == 1 else 0.0)
        p = np.vstack([probs, none])
        return p + UNKNOWN if k == 1 else p

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """words x languages; probs is pieces x languages."""
        out = np.zeros((len(words), probs.shape[1]))
        tables = {k: self.weights(probs, k) for k in range(1, LONGEST + 1)}
        for part, sizes, codes in self.groups(words):
            found = self.find(codes)
            n, width = codes.shape
            alpha = [np.ones((n, probs.shape[1]))]
            scale = np.zeros((n, 1))
            ends = np.zeros((n, probs.shape[1]))
            for j in range(1, width + 1):
                now = np.zeros_like(ends)
                for k, ids in found.items():
                    if k <= j:
                        now += alpha[-k] * tables[k][ids[:, j - k]]
                alpha = [*alpha[-LONGEST + 1:], now]
                if j % 12 == 0:
                    top = now.max(axis=1, keepdims=True)
                    alpha = [a / top for a in alpha]
                    scale += np.log(top)
                done = sizes == j
                if done.any():
                    ends[done] = np.log(np.maximum(alpha[-1][done], 1e-300)) + scale[done]
            out[part] = ends
        return out

    def expected_counts(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, for one language (probs: one number per piece)."""
        total = np.zeros(self.n + 1)
        tables = {k: self.weights(probs[:, None], k)[:, 0] for k in range(1, LONGEST + 1)}
        kept = [i for i, w in enumerate(words) if len(w) <= 60]          # longer runs are no words to learn from
        words, counts = [words[i] for i in kept], counts[kept]
        for part, sizes, codes in self.groups(words) if words else ():
            found = self.find(codes)
            n, width = codes.shape
            alpha, beta = np.zeros((n, width + 1)), np.zeros((n, width + 1))
            alpha[:, 0] = 1
            beta[np.arange(n), sizes] = 1
            steps = {k: tables[k][ids] for k, ids in found.items()}
            for j in range(1, width + 1):
                for k, p in steps.items():
                    if k <= j:
                        alpha[:, j] += alpha[:, j - k] * p[:, j - k]
            for j in range(width - 1, -1, -1):
                for k, p in steps.items():
                    if j + k <= width:
                        beta[:, j] += p[:, j] * beta[:, j + k]
            whole = np.maximum(alpha[np.arange(n), sizes], 1e-300)
            for k, ids in found.items():
                post = alpha[:, :ids.shape[1]] * steps[k] * beta[:, k:k + ids.shape[1]] * (counts[part] / whole)[:, None]
                total += np.bincount(ids.ravel(), post.ravel(), self.n + 1)
        return total[:-1]


def fit(labelled: DataFrame, pieces: list[str], text: str = "text", label: str = "lang",
        per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the log of nothing but their piece probabilities: pieces x languages."""
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((len(pieces), 0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))]), F.col("lang"))
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    words = materialise(drawn.select("lang", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word != ''")
                        .groupBy("lang", "word").agg(F.count("*").alias("n")))
    probs = np.full((len(pieces), len(langs)), 1.0 / len(pieces))
    for _ in range(rounds):

        def count(batches, probs=probs):
            lattice = Lattice(pieces)
            for b in batches:
                for lang, own in b.to_pandas().groupby("lang"):
                    got = lattice.expected_counts(own["word"].tolist(), own["n"].to_numpy(np.float64), probs[:, langs.index(lang)])
                    used = np.flatnonzero(got)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "piece": pa.array(used, pa.int32()),
                                                      "n": pa.array(got[used], pa.float64())})

        found = words.mapInArrow(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        fresh = np.full(probs.shape, 0.05)
        fresh[found["piece"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] += found["n"].to_numpy()
        probs = fresh / fresh.sum(axis=0)
    return langs, probs


def predict(df: DataFrame, pieces: list[str], langs: list[str], probs: np.ndarray, column: str = "text") -> DataFrame:
    """`df` with lang_pred and score, the posterior of that language among the learned ones."""

    def make():
        lattice = Lattice(pieces)

        def compute(texts: list) -> list[list]:
            known = [i for i, t in enumerate(texts) if langs and t and LETTER.search(t)]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            words = [texts[i].lower().split() for i in known]
            if known:
                codes, distinct = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
                by_word = lattice.log_likelihood(list(distinct), probs)
                starts = np.cumsum([0, *map(len, words)])[:-1]
                total = np.add.reduceat(by_word[codes], starts, axis=0)
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, p in zip(known, best, post, strict=True):
                    names[i], scores[i] = langs[b], float(p)
            return [names, scores]
        return compute

    return add_columns(df, column, OUT, make)

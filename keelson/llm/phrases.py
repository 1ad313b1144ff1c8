"""Collocations by Toivonen mining: a sample proposes, full passes count proposals and their negative border, failures are expanded.

Words are counted per language inside pieces (texts cut at punctuation and line ends). A phrase of k words can only be frequent if its first
and last k - 1 words are. So, for a set P of proposed phrases, the occurrences worth counting are those whose two (k-1)-word parts are both
in P: this is P itself with its negative border, and a border phrase need not be written down before it is met.

* Sample: `SHARE` of the documents, chosen by a hash, mined level by level at a lowered threshold. It decides the work, not the result.
* Full pass: every document is read, and P and its border are counted by the 64-bit hash of the phrase. A hash counts its phrase and
  whatever else falls on it, so hashes below the threshold hold no frequent phrase; the others (Q) do, or nearly always do.
* Expansion: a phrase of Q outside P is a border failure. The next pass reads every document again and counts, now by the words themselves, the
  phrases of Q, and all longer phrases that the failures let in: those made of parts that are in Q or were not counted before. Whatever is
  frequent is among them, since its parts are, so the set is closed after this pass, and its counts are exact.

P and Q are bit tables of a fixed size (`BITS`), whatever the corpus: a false positive makes a pass count a phrase more, never one less.
They are the only things that are sent to all tasks. Inside a task phrases are numbered exactly, and a chunk of at most `CHUNK`
bytes of one language is held at a time (long texts are cut between pieces).

Scores are whole numbers from decimals of 38 digits. Cuts are joined to the counts of their parts; counts of single words, which may
belong to a large share of the cuts, are dealt over `SALTS` keys.

Defined cases: null texts are empty; a null language is `und`; texts without words and empty tables give no phrases; rows of one id are
counted each; equal scores are ordered by count and phrase; other columns than text, language and id are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import materialise

LONGEST, LEAST, TOP = 5, 100, 2000
SHARE = 1 / 8                                     # of the documents, for proposals
BITS = 1 << 26                                    # of a table of phrases: 8 MB
CHUNK = 8 << 20
SALTS = 16
SEED, SHIFTS = 42, (0, 19, 38)
UNKNOWN_LANGUAGE = "und"
COUNTED = "lang string, k int, phrase string, f long"
#: Piece ends become line feeds, A-Z become lower case.
FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
STOP = b"."                                       # cannot stand inside a word


class PhraseSet:
    """A bit table of phrase hashes, three bits each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def empty(cls, bits: int = BITS) -> PhraseSet:
        return cls(np.zeros(bits // 64, dtype=np.uint64))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mask, found = np.uint64(len(self.words) * 64 - 1), np.ones(len(hashes), dtype=bool)
        for s in SHIFTS:
            p = (hashes >> np.uint64(s)) & mask
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found

    def with_all(self, hashes: DataFrame) -> PhraseSet:
        """This set and all of `hashes` (h). The bits are made in Spark; at most BITS / 64 rows come back."""
        mask = len(self.words) * 64 - 1
        bit = hashes.select(F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(mask)) for s in SHIFTS])).alias("bit"))
        rows = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
        words = self.words.copy()
        words[rows.column("word").to_numpy()] |= rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        return PhraseSet(words)


def longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one word more."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def chunk_levels(lang: str, folded: bytes, proposed: PhraseSet, possible: PhraseSet | None = None) -> Iterator[tuple]:
    """(k, hashes, counts, phrases) of the phrases of folded text that are worth counting.

    Without `possible`: `proposed` and its border, no phrases. With it: phrases that are possible or could not be counted before.
    """
    tokens = np.array([STOP, *folded.replace(b"\n", b" . ").split(), STOP], dtype=object)
    codes, vocabulary = pd.factorize(tokens)                    # code 0 is STOP
    words = vocabulary.tolist()
    prefix = lang.encode("utf-8", "surrogatepass") + b"\n"
    own = np.fromiter((xxhash.xxh64_intdigest(prefix + w, SEED) for w in words), dtype=np.uint64, count=len(words))
    counts = np.bincount(codes, minlength=len(words))
    # reach: counted by the first pass, and let on by it to longer phrases; alive: let on by this pass
    reach = proposed.has(own)
    alive = reach.copy() if possible is None else possible.has(own)
    reach[0] = alive[0] = False
    told = np.arange(1, len(words)) if possible is None else np.flatnonzero(alive)
    yield 1, own[told], counts[told], [words[i] for i in told] if possible is not None else None
    at = np.flatnonzero(alive[codes])                           # where a phrase that goes on starts
    ids, h, phrases = codes[at], own, words
    for k in range(2, LONGEST + 1):
        flag = np.flatnonzero(at[1:] == at[:-1] + 1)            # the phrase that starts one word later goes on, too
        if not len(flag):
            return
        starts, second = at[flag], ids[flag + 1]
        new, unique = pd.factorize(ids[flag].astype(np.int64) * len(words) + codes[starts + k - 1])
        first, last, other = unique // len(words), unique % len(words), np.empty(len(unique), dtype=np.int64)
        other[new] = second                                     # equal phrases have equal parts
        counts = np.bincount(new, minlength=len(unique))
        counted = reach[first] & reach[other]
        h = longer(h[first], own[last])
        reach = counted & proposed.has(h)
        if possible is None:
            alive, phrases = reach, None
            yield k, h, counts, None
        else:
            alive = possible.has(h) | ~counted
            phrases = [phrases[a] + b" " + words[b] if go else None for a, b, go in zip(first.tolist(), last.tolist(), alive.tolist(), strict=True)]
            told = np.flatnonzero(alive)
            yield k, h[told], counts[told], [phrases[i] for i in told]
        go = alive[new]
        at, ids = starts[go], new[go]


def _folded_parts(texts: Iterator[str]) -> Iterator[bytes]:
    """Folded texts joined to chunks of about CHUNK bytes; a longer text is cut at a piece end, or not at all where it has none."""
    held, size = [], 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass").translate(FOLD)
        at = 0
        while at < len(data) or at == 0:
            end = len(data)
            if end - at > CHUNK:
                cut = data.rfind(b"\n", at, at + CHUNK)
                cut = cut if cut > at else data.find(b"\n", at + CHUNK)
                end = cut + 1 if cut > at else len(data)
            held.append(data[at:end])
            size += end - at
            at = max(end, 1)
            if size >= CHUNK:
                yield b"\n".join(held)
                held, size = [], 0
    if held:
        yield b"\n".join(held)


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, folded text) of a task's rows, in chunks; few bytes wait at a time, whatever the number of languages."""
    waiting: dict[str, list[str]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> Iterator[tuple[str, bytes]]:
        size.pop(lang)
        for folded in _folded_parts(iter(waiting.pop(lang))):
            yield lang, folded

    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                yield from flush(lang)
        while sum(size.values()) > 2 * CHUNK:                   # many languages: the largest goes first
            yield from flush(max(size, key=size.get))
    for lang in list(waiting):
        yield from flush(lang)


def hash_counts(docs: DataFrame, proposed: PhraseSet, only: int | None = None) -> DataFrame:
    """(h, f): occurrences of the phrases of `proposed` and its border, by hash; of `only` words, if given."""
    sent = docs.sparkSession.sparkContext.broadcast(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, folded in chunks_of(batches):
            for k, h, counts, _ in chunk_levels(lang, folded, sent.value):
                if only in (None, k):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "f"])
                if k == only:
                    break

    return docs.select("text", "lang").mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def exact_counts(docs: DataFrame, proposed: PhraseSet, possible: PhraseSet) -> DataFrame:
    """(lang, k, phrase, f) of possible phrases and of those the first pass could not count; k = 0 has a language's words."""
    sent = docs.sparkSession.sparkContext.broadcast((proposed, possible))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(lang: str, k: int, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(np.full(len(phrases), k, dtype=np.int32)),
                                               pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))], names=["lang", "k", "phrase", "f"])
        for lang, folded in chunks_of(batches):
            yield rows(lang, 0, [b""], np.array([len(folded.replace(b"\n", b" ").split())]))
            for k, _, counts, phrases in chunk_levels(lang, folded, *sent.value):
                yield rows(lang, k, phrases, counts)

    return docs.select("text", "lang").mapInArrow(run, COUNTED).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def lowered(least: int, share: float) -> int:
    """Occurrences in the sample that make a phrase a proposal: a standard deviation below the mean at the threshold, 2 at least."""
    mean = least * share
    return max(2, math.floor(mean - math.sqrt(mean)))


def proposals(sample: DataFrame, least: int, bits: int = BITS) -> PhraseSet:
    """Phrases of 1 to LONGEST - 1 words that occur `least` times or more in the sample, level by level."""
    found = PhraseSet.empty(bits)
    for k in range(1, LONGEST):
        grown = found.with_all(hash_counts(sample, found, k).where(F.col("f") >= least))
        if np.array_equal(grown.words, found.words):
            break
        found = grown
    return found


def frequent(docs: DataFrame, least: int = LEAST, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to LONGEST words of `docs` (doc_id, text, lang) that occur `least` times or more."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN_LANGUAGE)).alias("lang"))
    drawn = docs.where(F.xxhash64(F.lit("proposals"), "doc_id", F.crc32("text")).bitwiseAND(F.lit(0xFFFF)) < int(share * 0x10000))
    proposed = proposals(drawn, lowered(least, share), bits)
    possible = PhraseSet.empty(bits).with_all(hash_counts(docs, proposed).where(F.col("f") >= least))
    return exact_counts(docs, proposed, possible).where((F.col("k") == 0) | (F.col("f") >= least))


def part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language whose weakest cut binds most, first `top` of them."""
    counts = materialise(frequent(docs, least, share, bits))
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    phrases = counts.where("k > 1").withColumn("w", F.split("phrase", " "))

    # a candidate inside a longer one that is as frequent: it is inside one that is longer by one word, too
    inside = phrases.where("k > 2").select("lang", "f", F.explode(F.array(part(F.col("w"), 1, F.col("k") - 1), part(F.col("w"), 2, F.col("k") - 1))).alias("phrase"))
    within = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = phrases.join(within, ["lang", "phrase"], "left").where("longer is null or longer < f").drop("longer")

    cuts = left.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.col("w"), 1, F.col("cut")).alias("one"), part(F.col("w"), F.col("cut") + 1, F.size("w") - F.col("cut")).alias("two"))
    salted = counts.where("k > 0").select("lang", F.col("phrase").alias("p"), "f", F.explode(F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                                                                            .otherwise(F.array(F.lit(0)))).alias("salt"))

    def with_count(df: DataFrame, own: str, name: str) -> DataFrame:
        salt = F.when(F.instr(own, " ") == 0, F.pmod(F.xxhash64("phrase", "cut"), F.lit(SALTS))).otherwise(0).cast("int")
        return df.withColumn("salt", salt).join(salted.select("lang", F.col("p").alias(own), F.col("f").alias(name), "salt"), ["lang", own, "salt"]).drop("salt", own)

    both = with_count(with_count(cuts, "one", "l"), "two", "r").join(total, "lang")
    long = {c: F.col(c).cast("decimal(19,0)") for c in "anlr"}
    both = both.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * long["a"] * long["n"], "down": long["l"] * long["r"]})
    both = both.withColumn("score", F.expr("up div down"))
    weakest = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("m.a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")

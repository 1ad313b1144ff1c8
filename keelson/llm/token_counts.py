"""Token counts by heap-and-linked-list byte-pair merging.

Each piece of a text starts as one symbol per byte. A heap holds the rank of every adjacent pair; the lowest is popped, its two
symbols join in a linked list, and the pairs at both sides of the new symbol are pushed. The count is the initial symbols minus the
merges made: no identifiers are produced. Splitting and normalising follow the vocabulary file, special strings inside a text count
one token each (the library's default).

Defined cases: null text counts as the empty text (0 bytes, 0 tokens); texts of any length are counted whole; repeated rows give
repeated results; extra columns are kept by `count_tokens`, those named n_bytes or n_tokens are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keelson.llm.common import add_columns

OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
#: Latin text without odd control characters: here Python and the library agree on case, composition and classes.
SAFE = re.compile("[\t-\r -~\u00a0-\u024f\u2010-\u2027\u2030-\u203a\u20ac]*")
CACHE_PIECES = 400_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies (fixed by the format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceCounts(dict):
    """Piece -> number of tokens, filled on demand and emptied when it holds CACHE_PIECES."""

    def __init__(self, model: dict):
        super().__init__()
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(symbols[b]) for b in range(256)]
        self.last = [vocab.get(symbols[b] + suffix) for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_PIECES:
            self.clear()
        n = self[piece] = self.count(piece.encode("utf-8", "surrogatepass"))
        return n

    def count(self, data: bytes) -> int:
        syms = [self.inner[b] for b in data[:-1]] + [self.last[b] for b in data[-1:]]
        syms = [s for s in syms if s is not None]
        n, merges = len(syms), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], syms[i], syms[i + 1]) for i in range(n - 1) if (m := merges.get((syms[i], syms[i + 1])))]
        heapq.heapify(heap)
        size = n
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if syms[i] != left or j >= size or syms[j] != right:
                continue                                        # one of the two symbols has gone into another merge
            syms[i], syms[j] = new, -1
            k = after[i] = after[j]
            n -= 1
            if k < size:
                before[k] = i
                if m := merges.get((new, syms[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, syms[k]))
            if (h := before[i]) >= 0 and (m := merges.get((syms[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], syms[h], new))
        return n


class Counter:
    """Counts the tokens of texts as the library does for one vocabulary file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        data = json.loads(spec)
        split = data["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.counts = PieceCounts(data["model"])
        special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.bytes = {c: b for b, c in byte_symbols().items()}

    def segment(self, text: str) -> int:
        if SAFE.fullmatch(text):
            return sum(map(self.counts.__getitem__, self.pieces(unicodedata.normalize("NFC", text).lower())))
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.counts.count(bytes(self.bytes[c] for c in piece)) for piece, _ in shown)

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.segment(p) for p in parts if p)


def count_tokens(df: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """`df` with n_bytes and n_tokens of `column`; `vocabulary` is the path of a byte-level BPE file on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()

    def make():
        counter = Counter(spec)

        def compute(texts: list) -> list[list]:
            texts = ["" if t is None else t for t in texts]
            return [[len(t.encode("utf-8", "surrogatepass")) for t in texts], [counter(t) for t in texts]]
        return compute

    return add_columns(df, column, OUT, make)

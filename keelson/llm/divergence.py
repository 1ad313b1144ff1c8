"""Source divergence audit by three-dimensional cube partitioning.

Each group (language, source) has a distribution over the terms its language keeps (those in `LEAST_DOCS` documents or more), smoothed
by one and scaled to whole numbers of `SCALE`. The audit gives the divergence of every group from each other group of its language, and
the terms that a group uses more than its language does. f(p, q) = floor((p - q)^2 / q) in whole numbers; sums are exact.

* Cube: groups are dealt into blocks of about `GROUPS_PER_BLOCK` and terms into blocks, both by hash. A cell (block i, block j, term block) with i <= j
  gets the slice of i and the slice of j of its term block: a slice is copied once for each group block of its language, not for each other group. A
  cell fills in the zeros of its own terms, works out its partial sums for all its pairs, and a sum along the term axis ends them.
* Terms that no group of a cell has are not sent: all of them give the pair the same value, that of two smoothed zeros, times their number.
* The number of term blocks follows from the language's kept terms, so that a cell's grid of groups and terms has about `CELL_VALUES` at any size.
* Every group has a marker in each of its cells: it brings the smoothed zero of a group that has none of the cell's terms.

Words are counted inside a task by chunks of a group's texts; Spark adds up (group, term) and then the documents of (language, term).

Defined cases: null text, language and source are ''; groups without terms have N = 0; a language without kept terms gives its pairs the value
0; repeated rows count each; an empty table gives an empty result; equal values are ordered by item; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import materialise

LEAST_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
GROUPS_PER_BLOCK, CELL_VALUES = 8, 200_000
CHUNK = 4 << 20
COUNTED = "lang string, source string, term string, n long, docs long"
#: Letters and all bytes above ASCII make terms, A-Z become lower case, the rest becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def group_chunk(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(terms, occurrences, documents) of folded texts."""
    split = [t.split() for t in texts]
    codes, terms = pd.factorize(np.array([w for s in split for w in s], dtype=object))
    if not len(terms):
        return [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(split), dtype=np.int64), [len(s) for s in split])
    seen = pd.unique(owner * len(terms) + codes) % len(terms)
    return terms.tolist(), np.bincount(codes, minlength=len(terms)), np.bincount(seen, minlength=len(terms))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of a group; a null term marks that the group occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[str, str], list[bytes]] = {}
        size: Counter = Counter()

        def flush(group: tuple[str, str]) -> Iterator[pa.RecordBatch]:
            del size[group]
            terms, n, docs = group_chunk(waiting.pop(group))
            rows = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0]] * rows, pa.string()), pa.array([group[1]] * rows, pa.string()), pa.array([None, *terms], pa.binary()).cast(pa.string()),
                 pa.array(np.append(0, n), pa.int64()), pa.array(np.append(0, docs), pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                group = (lang, source)
                waiting.setdefault(group, []).append(text.encode("utf-8", "surrogatepass").translate(FOLD))
                size[group] += len(text)
                if size[group] >= CHUNK:
                    yield from flush(group)
            while sum(size.values()) > 4 * CHUNK:
                yield from flush(max(size, key=size.get))
        for group in list(waiting):
            yield from flush(group)

    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return filled.mapInArrow(run, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def whole(numerator: Column, denominator: Column) -> Column:
    """floor(numerator / denominator) of decimals without a fraction, as a long."""
    frame = F.struct(numerator.cast("decimal(38,0)").alias("u"), denominator.cast("decimal(38,0)").alias("d"))
    return F.call_function("div", frame["u"], frame["d"])


def share(n: Column, total: Column, kept: Column) -> Column:
    """p of a term: smoothed share in whole numbers, 1 at least."""
    return F.lit(1) + whole((n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)"), total + kept)


def cell_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of all ordered pairs of one cell. Rows: bi, bj (its blocks), block, source, term (null: marker), p, p0."""
    first = rows.iloc[0]
    marked = rows[["block", "source", "p0"]].drop_duplicates("source").sort_values("source")
    names, zero = marked["source"].tolist(), marked["p0"].to_numpy(dtype=np.int64)
    blocks = marked["block"].to_numpy()
    at = {s: i for i, s in enumerate(names)}
    own = rows[rows["term"].notna()]
    codes, terms = pd.factorize(own["term"])
    grid = np.repeat(zero[:, None], len(terms), axis=1)                       # group x term
    grid[own["source"].map(at).to_numpy(dtype=np.int64), codes] = own["p"].to_numpy(dtype=np.int64)
    out = []
    for i, s in enumerate(names):
        d = grid[i] - grid
        total = (d * d // grid).sum(axis=1)
        for j, o in enumerate(names):
            if i != j and {blocks[i], blocks[j]} == {first["bi"], first["bj"]}:
                out.append((first["lang"], s, o, int(total[j]), len(terms)))
    return pd.DataFrame(out, columns=["lang", "source", "item", "part_sum", "covered"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, groups_per_block: int = GROUPS_PER_BLOCK,
          cell_values: int = CELL_VALUES) -> DataFrame:
    """(lang, source, part, item, value, rank) for `docs` (text, lang, source): part `pair` for groups, part `term` for terms."""
    counts = materialise(term_counts(docs))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    used = materialise(counts.where("term is not null").select("lang", "source", "term", "n").join(kept.drop("docs"), ["lang", "term"]))
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").fillna({"group_n": 0})
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("all_n"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(per_lang, "lang", "left").fillna({"kept": 0, "all_n": 0})
    langs = langs.select("lang", "kept", "all_n", F.ceil(F.col("sources") / groups_per_block).cast("int").alias("group_blocks"),
                         F.greatest(F.lit(1), F.ceil(F.col("kept") * 2 * groups_per_block / cell_values)).cast("int").alias("term_blocks"))
    groups = groups.join(langs, "lang").withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("group_n"), F.col("kept"))))
    groups = materialise(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int")))
    placed = used.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("kept")))
    placed = placed.withColumn("q", share(F.col("lang_n"), F.col("all_n"), F.col("kept")))

    # slices: (block, term block), copied to the cells of the block's row and column
    sliced = placed.select("lang", "source", "block", "group_blocks", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int").alias("tb"), "term", "p", "p0")
    markers = groups.select("lang", "source", "block", "group_blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("tb"), F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"),
                            F.coalesce("p0", F.lit(1)).alias("p0"))
    dealt = sliced.unionByName(markers).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1)))
    cells = dealt.select("lang", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "tb", "block", "source", "term", "p", "p0")
    sums = cells.groupBy("lang", "bi", "bj", "tb").applyInPandas(cell_sums, "lang string, source string, item string, part_sum long, covered long")
    along = sums.groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("seen"), F.sum("covered").alias("covered"))
    zeros = groups.select("lang", "source", "p0", "kept")
    met = along.join(zeros, ["lang", "source"]).join(zeros.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0")), ["lang", "item"])
    d = F.col("p0") - F.col("q0")
    value = F.when(F.col("kept") == 0, F.lit(0)).otherwise(F.col("seen") + (F.col("kept") - F.col("covered")) * whole(d * d, F.col("q0")))
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = met.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(by_group))

    d = F.col("p") - F.col("q")
    more = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), whole(d * d, F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(by_group)).where(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)

"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become template tokens: numbers, names (capitalised words inside a sentence) and units (after a number) turn into typed
placeholders, the rest is lower-cased without punctuation. Worded tokens are the same with names left as lower-cased words, so they do not
depend on letter case. Two tokens agree when their template, worded or raw forms are equal. A document leaks an item when a run of at least
`RUN` = 13 tokens of the item (the whole item, if it has fewer) agrees with it and the placeholders are filled consistently: inside the run,
one value of the item always stands against one value of the document. So a question with other numbers, names or units, or in other letter
case, is found too.

* Windows of `WINDOW` = 6 tokens are hashed in both forms: all windows of the items, every `STRIDE` = 3rd of the documents. Any common run
  of 8 tokens or more holds such a window. It is found by it if it agrees in one form; a copy that changes letter case and names at once
  needs a window without a changed name. A template in which over half of the tokens are placeholders says nothing and is not hashed;
  where numbers and units alone are over half, the raw tokens are. Next to such a window of a document, each window is hashed, not every
  third, so that a run with other values is found by any window that does say something.
* Items of fewer than `SHORTEST` = 8 tokens are matched whole, by a hash of their raw tokens, at every place of a document.
* Window hashes meet in one hash join. Hits are reduced to (document, item, offset) before the aligned tokens are compared.
* The longest run that agrees and is consistent is taken: a run ends at a token that does not agree, and where a slot contradicts an earlier
  slot of the run, the next run starts after that earlier slot.
* The benchmark side is broadcast if it has at most `BROADCAST_ROWS` windows, the hits if they are as few; else both are shuffled.

Defined cases: null and empty texts leak nothing; items without a word or number never match, and those of fewer than `SHORTEST` = 8 tokens only as they
are (changed is 0), however common their words; copies of a
benchmark item match each under its own id, and repeated rows of one id and text count once; documents with one id and different texts are
compared apart and reported under that id; an empty table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.session import materialise

WINDOW, STRIDE, RUN, SHORTEST = 6, 3, 13, 8
BROADCAST_ROWS = 200_000
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
UNITS = ("kg g mg t lb oz km m cm mm mi ft yd in l ml gal s ms h hr hrs min mins sec second seconds minute minutes hour hours day days week weeks month months "
         "year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds "
         "liter liters litre litres dollar dollars euro euros cent cents usd eur percent degrees kmh mph w kw kwh v j kj hz gb mb kb").split()
BREAKS = "[\\x00-/:-@\\[-`{-\\x7F\\u00A0-\\u00BF\\u2000-\\u206F\\u3000-\\u303F]+"


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), BREAKS, " "))


def joined_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "[.,](?<=[0-9].)(?=[0-9])", "")


def raw_tokens(text: Column) -> Column:
    return F.split(plain(joined_numbers(text)), " ")


def worded_tokens(text: Column) -> Column:
    """As many tokens as raw_tokens, with placeholders for numbers and units."""
    numbers = F.regexp_replace(plain(joined_numbers(text)), "[0-9](?<![^ ].)[^ ]*", NUMBER)
    return F.split(F.regexp_replace(numbers, f"{NUMBER} (?:{'|'.join(UNITS)})(?= |$)", f"{NUMBER} {UNIT}"), " ")


def template_tokens(text: Column) -> Column:
    """As many tokens as raw_tokens, with placeholders for numbers, units and names."""
    return worded_tokens(F.regexp_replace(joined_numbers(text), "\\p{Lu}(?<=[\\p{L}0-9,;] .)\\p{L}*", NAME))


def tokens(text: Column, side: str) -> list[Column]:
    """Template, worded and raw tokens as columns <side>t, <side>w and <side>r."""
    return [f(text).alias(side + c) for c, f in (("t", template_tokens), ("w", worded_tokens), ("r", raw_tokens))]


def is_slot(token: Column) -> Column:
    return token.isin(NAME, NUMBER, UNIT)


def heavy(part: Column) -> Column:
    return 2 * F.size(F.filter(part, is_slot)) > WINDOW


def windows(side: str, stride: int) -> Column:
    """Array of (at, hash) over windows of WINDOW tokens, from the columns of tokens(); the hash is null where a form is not hashed."""
    template, worded, raw = (F.col(side + c) for c in ("t", "w", "r"))
    last = F.size(template) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    if stride > 1:
        # where a regular window is heavy, also those up to the regular ones on both sides of it
        around = F.flatten(F.transform(F.filter(starts, lambda i: heavy(F.slice(template, i + 1, WINDOW))),
                                       lambda i: F.sequence(F.greatest(i - stride + 1, F.lit(0)), F.least(i + stride - 1, last))))
        starts = F.array_union(starts, around)

    def window(i: Column) -> Column:
        one, two, three = (F.slice(c, i + 1, WINDOW) for c in (template, worded, raw))
        return F.array(F.struct(i.alias("at"), F.when(~heavy(one), F.xxhash64(one)).alias("hash")),
                       F.struct(i.alias("at"), F.when(heavy(two), F.xxhash64(three)).when(one != two, F.xxhash64(two)).alias("hash")))

    return F.flatten(F.transform(starts, window))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text) of texts that are not null, and nk, the id as text ('' for null) to join by."""
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("nk"),
                                                      F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def candidates(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(nk, th, item_id, n, offset): offsets at which a document shares a window with an item of n tokens."""
    known = items.select("item_id", F.size("it").alias("n"), F.explode(windows("i", 1)).alias("w"))
    known = materialise(known.select("item_id", "n", F.col("w.at").alias("i"), F.col("w.hash").alias("hash")).where("hash is not null"))
    side = F.broadcast(known) if known.count() <= broadcast_rows else known
    seen = docs.select("nk", "th", *tokens(F.col("text"), "d"))
    seen = seen.select("nk", "th", F.explode(windows("d", STRIDE)).alias("w")).select("nk", "th", F.col("w.at").alias("d"), F.col("w.hash").alias("hash"))
    hits = seen.join(side, "hash").select("nk", "th", "item_id", "n", (F.col("d") - F.col("i")).alias("offset"))
    return hits.distinct()


def short_leaks(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """Rows of leaks() for items of fewer than SHORTEST tokens; None if there are none."""
    known = materialise(items.select("item_id", F.size("ir").alias("n"), F.xxhash64("ir").alias("hash")).distinct())
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())          # fewer than SHORTEST numbers
    if not lengths:
        return None
    side = F.broadcast(known) if known.count() <= broadcast_rows else known

    def places(n: int) -> Column:
        starts = F.when(F.size("dr") >= n, F.sequence(F.lit(1), F.size("dr") - n + 1, F.lit(1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("dr", i, n)).alias("hash"))))

    seen = docs.select("id", "th", raw_tokens(F.col("text")).alias("dr"))
    seen = seen.select("id", "th", F.explode(F.concat(*[places(n) for n in lengths])).alias("w")).select("id", "th", "w.n", "w.hash")
    found = seen.join(side, ["n", "hash"]).groupBy("id", "th", "item_id").agg(F.max("n").alias("matched"))
    return found.select("id", "th", "item_id", "matched", F.col("matched").alias("n_tokens"), F.lit(0).alias("n_slots"), F.lit(0).alias("changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
          run: int = RUN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, th, item_id, matched, n_tokens, n_slots, changed): leaked items of each document (id and text hash), the longest run of each.

    `changed` counts the slots whose value differs from the item's: 0 for a plain copy.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("t")).distinct()
    every = materialise(items.select("item_id", *tokens(F.col("t"), "i")).where(F.array_join("ir", "") != ""))
    items = every.where(F.size("it") >= SHORTEST)
    texts = keyed(docs, key, text)
    short = short_leaks(texts, every.where(F.size("it") < SHORTEST), broadcast_rows)
    found = candidates(texts, items, broadcast_rows)
    places = materialise(found.groupBy("nk", "th").agg(F.collect_list(F.struct("item_id", "n", "offset")).alias("places")))
    side = F.broadcast(places) if places.count() <= broadcast_rows else places
    there = texts.join(side, ["nk", "th"]).select("id", "th", "places", *tokens(F.col("text"), "d"))

    def aligned(p: Column) -> Column:
        first = F.greatest(-p["offset"], F.lit(0))                 # of the item's tokens
        start = F.greatest(p["offset"], F.lit(0)) + 1
        size = F.least(p["n"] - first, F.size("dt") - start + 1)
        return F.struct(p["item_id"].alias("item_id"), first.alias("first"), *[F.slice(c, start, size).alias(c) for c in ("dt", "dw", "dr")])

    apart = there.select("id", "th", F.explode(F.transform("places", aligned)).alias("p")).select("id", "th", "p.*")
    both = apart.join(items, "item_id").withColumns({c: F.slice(c, F.col("first") + 1, F.size("dt")) for c in ("it", "iw", "ir")})
    return judged(both, items, run) if short is None else longest(judged(both, items, run).unionByName(short))


def longest(found: DataFrame) -> DataFrame:
    """One row of each (id, th, item_id), for ids that have both long and short texts."""
    rest = F.struct("matched", (-F.col("changed")).alias("c"), "n_tokens", "n_slots")
    best = found.groupBy("id", "th", "item_id").agg(F.max(rest).alias("m"))
    return best.select("id", "th", "item_id", "m.matched", "m.n_tokens", "m.n_slots", (-F.col("m.c")).alias("changed"))


def judged(both: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """Aligned tokens (dt, dw, dr against it, iw, ir) -> the longest matching and consistent run, its slots, and the decision.

    Each bound (at, low) says that a run which holds the token `at` starts at `low` or later. For slots, only neighbours in the order by
    item value and place are compared: a run that holds two contradicting slots of one value holds two such neighbours.
    """
    pairs = F.arrays_zip(*[F.col(c) for c in ("it", "dt", "iw", "dw", "ir", "dr")])
    placed = both.withColumn("pairs", pairs).withColumn("slots", F.array_sort(F.filter(F.transform("pairs", lambda p, k: F.when(
        is_slot(p["it"]) | is_slot(p["iw"]), F.struct(F.concat(p["it"], p["ir"]).alias("i"), k.alias("at"), p["dr"].alias("d")))), lambda x: x.isNotNull())))
    unequal = F.filter(F.transform("pairs", lambda p, k: F.when(~((p["it"] == p["dt"]) | (p["iw"] == p["dw"]) | (p["ir"] == p["dr"])),
                                                                F.struct(k.alias("at"), (k + 1).alias("low")))), lambda x: x.isNotNull())
    shifted = F.zip_with("slots", F.slice("slots", 2, F.greatest(F.size("slots") - 1, F.lit(0))), lambda x, y: F.when(
        (x["i"] == y["i"]) & (x["d"] != y["d"]), F.struct(y["at"].alias("at"), (x["at"] + 1).alias("low"))))
    last = F.array(F.struct(F.size("pairs").alias("at"), F.size("pairs").alias("low")))
    bounds = F.array_sort(F.concat(unequal, F.filter(shifted, lambda x: x.isNotNull()), last))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("best"), F.lit(0).alias("from"))

    def grow(a: Column, x: Column) -> Column:
        longer = x["at"] - a["start"] > a["best"]
        return F.struct(F.greatest(a["start"], x["low"]).alias("start"), F.when(longer, x["at"] - a["start"]).otherwise(a["best"]).alias("best"),
                        F.when(longer, a["start"]).otherwise(a["from"]).alias("from"))

    found = placed.withColumn("r", F.aggregate(bounds, zero, grow)).where("r.best > 0").withColumn("pairs", F.slice("pairs", F.col("r.from") + 1, F.col("r.best")))
    found = found.withColumn("slots", F.filter("pairs", lambda p: is_slot(p["it"]) | is_slot(p["iw"])))
    whole = items.select("item_id", F.size("it").alias("n_item")).groupBy("item_id").agg(F.min("n_item").alias("n_item"))
    changed = F.size(F.filter("slots", lambda p: p["ir"] != p["dr"]))
    kept = found.select("id", "th", "item_id", F.col("r.best").alias("matched"), F.size("slots").alias("n_slots"), changed.alias("changed"))
    kept = kept.join(whole, "item_id").where(F.col("matched") >= F.least(F.col("n_item"), F.lit(run)))
    best = kept.groupBy("id", "th", "item_id", "n_item").agg(F.max(F.struct("matched", (-F.col("changed")).alias("c"), "n_slots")).alias("m"))
    return best.select("id", "th", "item_id", F.col("m.matched").alias("matched"), F.col("n_item").alias("n_tokens"), F.col("m.n_slots").alias("n_slots"),
                       (-F.col("m.c")).alias("changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` without the rows whose text leaks an item."""
    bad = leaks(docs, benchmark, key, text, broadcast_rows=broadcast_rows).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_nk"), F.col("th").alias("_th"))
    bad = materialise(bad.distinct())
    side = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    marked = F.coalesce(docs[key].cast("string"), F.lit("")) == side["_nk"]
    return docs.join(side, marked & (F.xxhash64(docs[text]) == side["_th"]), "left_anti")

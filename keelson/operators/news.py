"""Headline operators: story de-duplication, sentiment aggregates, event extraction and event merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.session import ensure_checkpoint_dir, materialise

HALF_LIFE = 14.0
PRIOR_WEIGHT = 5.0
BIT_LONGS = 4
BROADCAST_BYTES = 16 << 20


def drop_exact_copies(articles: DataFrame) -> DataFrame:
    """Of headlines equal after normalisation keep the earliest (per company); an aggregation, so copies fold early."""
    cols = articles.columns
    return (articles.withColumn("_n", text.normalise_title("title")).groupBy("cik", "_n")
            .agg(F.min_by(F.struct(*cols), F.struct("published_at", "article_id")).alias("r")).select("r.*"))


def story_words(articles: DataFrame, overlap: float = 0.6, min_shared: int = 3) -> DataFrame:
    """(rid, cik, article_id, published_at, rare, probing, bits): content words, the rarest of the company first, how many of them probe, and
    256 bits of which each word sets one. Stored; rid names the row.

    Exact prefix filter: if the shorter headline has m words and must share t of them, one of its m - t + 1 rarest words is shared.
    """
    base = articles.select("cik", "article_id", "published_at", text.content_tokens("title").alias("tokens"))
    words = base.select("cik", "article_id", "published_at", F.explode("tokens").alias("w"), F.size("tokens").alias("m"))
    freq = words.groupBy("cik", "w").agg(F.count(F.lit(1)).alias("f"))
    ranked = words.join(freq, ["cik", "w"]).groupBy("cik", "article_id", "published_at", "m").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda s: s["w"]).alias("rare"))
    need = F.greatest(F.lit(min_shared), F.ceil(F.col("m") * overlap - 1e-9)).cast("int")
    places = F.transform("rare", lambda w: F.pmod(F.xxhash64(w), F.lit(64 * BIT_LONGS)).cast("int"))

    def part(k: int) -> Column:
        return F.aggregate(F.filter("places", lambda p: F.floor(p / 64) == k), F.lit(0).cast("bigint"),
                           lambda x, p: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), p % 64)))
    bits = F.array(*[part(k) for k in range(BIT_LONGS)])
    return materialise(ranked.withColumn("places", places).select(
        F.monotonically_increasing_id().alias("rid"), "cik", "article_id", "published_at", "rare",
        F.when(F.col("m") >= min_shared, F.greatest(F.lit(1), F.col("m") - need + 1)).otherwise(0).alias("probing"), bits.alias("bits")))


def may_share(ma: Column, pa: Column, ba: Column, mb: Column, pb: Column, bb: Column) -> Column:
    """False only where the shorter of two headlines lacks too many words: each word it has alone unsets one bit at most in the other, so
    bits beyond these are words beyond the probing - 1 it may have alone. Given sizes, probing and bits of both."""
    def alone(x, y):
        return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(BIT_LONGS)), F.lit(0))
    return F.when(ma < mb, alone(ba, bb) < pa).when(mb < ma, alone(bb, ba) < pb).otherwise((alone(ba, bb) < pa) & (alone(bb, ba) < pb))


def same_story(wa: Column, wb: Column, ta: Column, tb: Column, overlap: float, min_shared: int, days: int) -> Column:
    """The shorter set shares enough words, and at most `days` whole days lie between."""
    shared = F.size(F.array_intersect(wa, wb))
    return near_days(ta, tb, days) & (shared >= min_shared) & (shared / F.least(F.size(wa), F.size(wb)) >= overlap)


def near_days(ta: Column, tb: Column, days: int) -> Column:
    return F.floor(F.abs(F.unix_micros(ta) - F.unix_micros(tb)) / F.lit(86_400_000_000)) <= days


def told_twice(pairs: DataFrame, ranked: DataFrame, overlap: float, min_shared: int, days: int) -> DataFrame:
    """The pairs (one, two) of rows of `ranked` that tell the same story; words are read here, once for each pair."""
    def side(n: str) -> DataFrame:
        return ranked.select(F.col("rid").alias(n), F.col("cik").alias(f"c_{n}"), F.col("rare").alias(f"w_{n}"), F.col("published_at").alias(f"t_{n}"))
    same = (F.col("c_one") == F.col("c_two")) & same_story(F.col("w_one"), F.col("w_two"), F.col("t_one"), F.col("t_two"), overlap, min_shared, days)
    return pairs.join(side("one"), "one").join(side("two"), "two").where(same).drop(*[f"{c}_{n}" for c in "cwt" for n in ("one", "two")])


def story_pairs(articles: DataFrame, overlap: float = 0.6, min_shared: int = 3, days: int = 3) -> DataFrame:
    """(cik, later, earlier): all pairs of copies of a story.

    Only the rare words of `story_words` are probed, against headlines at most `days` apart (blocks of days + 1 days). Rows of the index hold
    a word's hash and the bits of the headline; candidates that the bits let through are verified by their words.
    """
    ranked = story_words(articles, overlap, min_shared)
    block = F.floor(F.datediff("published_at", F.lit("1970-01-01").cast("date")) / (days + 1))
    rows = ranked.select("rid", "cik", F.col("article_id").alias("id"), F.col("published_at").alias("t"), F.size("rare").alias("m"), "probing", "bits", "rare", block.alias("at"))

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select("cik", "word", "block", *[F.col(c).alias(f"{side}_{c}") for c in ("rid", "id", "t", "m", "probing", "bits")])
    probes = named(rows.withColumn("word", F.explode(F.transform(F.slice("rare", 1, "probing"), lambda w: F.xxhash64(w))))
                   .withColumn("block", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))), "a")
    index = named(rows.withColumn("word", F.explode(F.transform("rare", lambda w: F.xxhash64(w)))).withColumn("block", F.col("at")), "b")
    # the shorter side probes; equal lengths probe once, from the smaller id
    shorter = (F.col("a_m") < F.col("b_m")) | ((F.col("a_m") == F.col("b_m")) & (F.col("a_id") < F.col("b_id")))
    hits = (probes.join(index, ["cik", "word", "block"])
            .where(shorter & near_days(F.col("a_t"), F.col("b_t"), days)
                   & may_share(*[F.col(f"{s}_{c}") for s in "ab" for c in ("m", "probing", "bits")])))
    a_first = F.struct(F.col("a_t"), F.col("a_id")) < F.struct(F.col("b_t"), F.col("b_id"))
    pairs = hits.select(F.col("a_rid").alias("one"), F.col("b_rid").alias("two"), "cik", F.when(a_first, F.col("b_id")).otherwise(F.col("a_id")).alias("later"),
                        F.when(a_first, F.col("a_id")).otherwise(F.col("b_id")).alias("earlier")).distinct()
    return told_twice(pairs, ranked, overlap, min_shared, days).select("cik", "later", "earlier").distinct()


def story_cells(ranked: DataFrame, days: int) -> DataFrame:
    """(rid, cells): the buckets (cik, word, days) of each headline in which it can meet a copy, as (bucket, probe, reach). A word's reach counts
    it and the more frequent ones of its headline.

    The first word that two headlines share, rarest first, has all they share from it on in both. So they meet in a bucket where the shorter
    one probes and the other reaches as far as the words that the shorter one must share.
    """
    # blocks of days + 1 days, each headline in its own and the next: two headlines at most `days` apart share one
    block = F.floor(F.datediff("published_at", F.lit("1970-01-01").cast("date")) / (days + 1))
    cells = ranked.where(F.col("published_at").isNotNull()).select(
        "rid", "cik", "probing", (F.size("rare") - F.col("probing") + 1).alias("need"), F.size("rare").alias("m"),
        F.posexplode("rare").alias("k", "w"), F.explode(F.array(block, block + 1)).alias("block"))
    cells = cells.select(F.xxhash64("cik", "w", "block").alias("bucket"), "rid", (F.col("k") < F.col("probing")).alias("probe"), (F.col("m") - F.col("k")).alias("reach"), "need")
    # a bucket of one headline, or of none that probes, has no meetings
    bucket = W.partitionBy("bucket")
    used = cells.withColumns({"n": F.count(F.lit(1)).over(bucket), "least": F.min(F.when(F.col("probe"), F.col("need"))).over(bucket)})
    return (used.where((F.col("n") > 1) & F.col("least").isNotNull() & (F.col("probe") | (F.col("reach") >= F.col("least"))))
            .groupBy("rid").agg(F.collect_list(F.struct("bucket", F.col("probe").cast("int").alias("probe"), "reach")).alias("cells")))


def deduplicate(articles: DataFrame, overlap: float = 0.6, min_shared: int = 3, days: int = 3) -> DataFrame:
    """One story, one headline: a headline is dropped when an earlier *kept* one tells the same story.

    Headlines that can be copies share a bucket (`story_cells`). In a round the open headlines of a bucket meet its first `front`
    ones only, and each remembers the copies it met, so n copies of a story give n pairs, not n squared. A headline that has met all earlier
    open ones of its buckets without a copy is kept once all later ones have met it; one whose copy was kept is dropped; both leave. `front`
    grows fourfold, so that a bucket of headlines that merely share a word ends in few rounds. The state between rounds is checkpointed to the
    shared folder, one row for each open headline; its bits go to the buckets, its words are read for the candidates that the bits let through.
    """
    ensure_checkpoint_dir(articles.sparkSession)
    unique = drop_exact_copies(articles)
    ranked = story_words(unique, overlap, min_shared)
    # heads are numbered in order of time and id; rows of equal company, time and id are one
    heads = ranked.select("rid", "cik", "published_at", "article_id").orderBy("published_at", "article_id").withColumn("k", F.monotonically_increasing_id())
    heads = heads.withColumn("head", F.min("k").over(W.partitionBy("cik", "published_at", "article_id"))).drop("k").checkpoint()
    about = ranked.select("rid", "cik", "published_at", "rare", F.unix_micros("published_at").alias("t"), F.size("rare").alias("m"), "probing", "bits")
    open_ = story_cells(ranked, days).join(about, "rid").join(heads.select("rid", "head"), "rid").checkpoint()
    dropped, tested, copies, front = None, None, None, 1
    while not open_.isEmpty():
        # not null, as the join below asks for: so both of its sides read one shuffle
        rows = open_.select("rid", "head", "t", "m", "probing", "bits", F.inline("cells")).where("head is not null and t is not null and bucket is not null")
        order, whole = W.partitionBy("bucket").orderBy("head", "rid"), W.partitionBy("bucket")
        before = rows.withColumns({"n": F.row_number().over(order) - 1, "p": F.coalesce(F.sum("probe").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                                   "size": F.count(F.lit(1)).over(whole), "probes": F.sum("probe").over(whole)})
        asks, lead_asks = F.col("probe") == 1, F.col("lead_probe") == 1
        # a probe meets all earlier ones, others the probes among them
        front_row = F.when(asks, F.least("n", "p")).otherwise(F.col("n"))
        led = ("rid", "head", "t", "m", "probing", "bits", "probe", "reach", "n", "p")
        leaders = before.where(front_row < front).select("bucket", *[F.col(c).alias(f"lead_{c}") for c in led])

        def need(side: str = "") -> Column:
            return F.col(f"{side}m") - F.col(f"{side}probing") + 1
        meet = ((F.col("lead_head") < F.col("head")) & (F.abs(F.col("t") - F.col("lead_t")) < F.lit((days + 1) * 86_400_000_000))
                & ((asks & (F.col("lead_n") < front) & (F.col("lead_reach") >= need()))
                   | (lead_asks & (F.col("lead_p") < front) & (F.col("reach") >= need("lead_")))))
        met = (rows.join(leaders, "bucket").where(meet & may_share(*[F.col(f"{s}{c}") for s in ("", "lead_") for c in ("m", "probing", "bits")]))
               .select("head", F.col("lead_head").alias("lead"), F.col("rid").alias("one"), F.col("lead_rid").alias("two")).distinct()).checkpoint()
        # pairs of a round meet again in the next if both stay open; their words are not read again
        new = met if tested is None else met.join(tested, ["one", "two"], "left_anti")
        found = told_twice(new, open_, overlap, min_shared, days).select("head", "lead").distinct()
        copies = (found if copies is None else copies.union(found)).checkpoint()
        tested = met.select("one", "two")
        # it has met all earlier ones, and later ones have met it
        done = (F.col("n") < front) | F.when(asks, (F.col("n") <= front) & (F.col("n") == F.col("size") - 1)).otherwise((F.col("p") <= front) & (F.col("p") == F.col("probes")))
        seen = before.groupBy("head").agg(F.bool_and(done).alias("all"))
        kept = seen.where("all").select("head").join(copies, "head", "left_anti").checkpoint()
        lost = copies.join(kept.withColumnRenamed("head", "lead"), "lead", "left_semi").select("head").distinct().checkpoint()
        dropped = lost if dropped is None else dropped.union(lost)
        settled = kept.union(lost)
        if settled.count() * 16 <= BROADCAST_BYTES:
            settled = F.broadcast(settled)
        open_ = open_.join(settled, "head", "left_anti").checkpoint()
        copies = copies.join(settled, "head", "left_anti").join(settled.withColumnRenamed("head", "lead"), "lead", "left_anti").select("head", "lead")
        front *= 4
    if dropped is None:
        return unique
    return unique.join(heads.join(dropped, "head", "left_semi").select("cik", "article_id"), ["cik", "article_id"], "left_anti")


def age_days(as_of: str = "as_of"):
    """Fractional days from publication to the end of the as-of date."""
    end = F.unix_seconds(F.date_add(F.col(as_of), 1).cast("timestamp"))
    return (end - F.unix_seconds("published_at")) / 86400.0


def known_news(articles: DataFrame, days: int = 90) -> DataFrame:
    """Articles of the `days` up to the end of the as-of date, with _age; later ones are not known yet."""
    return articles.withColumn("_age", age_days()).where(F.col("_age").between(0, days))


def news_stats(articles: DataFrame) -> DataFrame:
    """Level, trend, strongly negative share and summary per (cik, as_of). Needs polarity and label."""
    a = known_news(articles).withColumn("_w", F.pow(F.lit(0.5), F.col("_age") / HALF_LIFE))
    recent, prior = F.col("_age") <= 30, (F.col("_age") > 30) & (F.col("_age") <= 90)
    pol = F.col("polarity")
    g = a.groupBy("cik", "as_of").agg(
        F.count(F.lit(1)).alias("articles"), (F.sum(F.col("_w") * pol) / (F.sum("_w") + PRIOR_WEIGHT)).alias("level"),
        F.count(F.when(recent, 1)).alias("_nr"), F.count(F.when(prior, 1)).alias("_np"),
        F.avg(F.when(recent, pol)).alias("_r"), F.avg(F.when(prior, pol)).alias("_p"),
        F.avg(((F.col("label") == "negative") & (pol <= -0.5)).cast("double")).alias("neg_share"),
        F.avg(pol).alias("mean_sentiment"), F.avg((F.col("label") == "positive").cast("double")).alias("positive_share"),
        F.avg((F.col("label") == "negative").cast("double")).alias("negative_share"))
    trend = F.when((F.col("_nr") >= 3) & (F.col("_np") >= 3), F.col("_r") - F.col("_p"))
    return g.withColumn("trend", trend).drop("_nr", "_np", "_r", "_p")


def daily_sentiment(articles: DataFrame, *keys: str) -> DataFrame:
    return (articles.groupBy(*(keys or ("cik",)), F.to_date("published_at").alias("day"))
            .agg(F.avg("polarity").alias("sentiment"), F.count(F.lit(1)).alias("articles")))


def sentiment_shock(articles: DataFrame) -> DataFrame:
    """Per (cik, as_of): the last seven days against the earlier daily baseline."""
    keys = ["cik", "as_of"]
    articles = known_news(articles)
    newest = articles.groupBy(*keys).agg(F.max("published_at").alias("_last"), F.max(F.to_date("published_at")).alias("_day"))
    daily = daily_sentiment(articles, *keys).join(newest, keys)
    late = F.col("day") > F.date_sub("_day", 7)
    shape = daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(~late, 1)).alias("base_days"),
        F.avg(F.when(late, F.col("sentiment"))).alias("last7"), F.avg(F.when(~late, F.col("sentiment"))).alias("base_mean"),
        F.stddev_samp(F.when(~late, F.col("sentiment"))).alias("base_std"))
    n7 = (articles.join(newest, keys).where(F.col("published_at") > F.col("_last") - F.expr("INTERVAL 7 DAYS"))
          .groupBy(*keys).agg(F.count(F.lit(1)).alias("n7")))
    out = shape.join(n7, keys, "left")
    hit = ((F.col("days") >= 20) & (F.col("base_days") >= 10) & (F.col("n7") >= 5)
           & (F.col("last7") < F.col("base_mean") - 2 * F.col("base_std")))
    return out.withColumn("shock", F.coalesce(hit, F.lit(False)))


def news_events(articles: DataFrame) -> DataFrame:
    """Headline events with their polarity-scaled penalty, for the five event types that count."""
    e = articles.withColumn("_e", text.headline_event("title")).where(F.col("_e.type").isin(text.EVENT_TYPES))
    eid = text.evidence_id("news", F.coalesce(F.col("url"), F.col("title")))
    return e.select(
        "cik", eid.alias("evidence"), F.to_date("published_at").alias("date"), F.col("_e.type").alias("type"),
        F.col("_e.label").alias("label"), F.concat(F.lit("News ("), "domain", F.lit(")")).alias("origin"),
        F.col("_e.severity").alias("severity"),
        (F.col("_e.penalty") * F.greatest(F.lit(0.0), -F.col("polarity"))).alias("penalty"), "title")


def merge_events(news: DataFrame, filings: DataFrame, days: int = 7) -> DataFrame:
    """Same-type news within `days` of a cluster's first item merge; a filing of that type nearby zeroes the penalty.

    Clusters are folded over the distinct days of a (company, type) - bounded by the calendar - and joined back. A LAYOFFS
    cluster is also superseded by a RESTRUCTURING filing.
    """
    dates = news.groupBy("cik", "type").agg(F.array_sort(F.collect_set("date")).alias("_d"))
    anchors = F.aggregate(
        "_d", F.expr("cast(array() as array<date>)"),
        lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.try_element_at(acc, F.lit(-1))) > days),
                              F.array_append(acc, d)).otherwise(acc))
    spans = (dates.withColumn("_a", anchors)
             .select("cik", "type", F.explode(F.transform("_d", lambda d: F.struct(
                 d.alias("date"), F.array_max(F.filter("_a", lambda a: a <= d)).alias("anchor")))).alias("s"))
             .select("cik", "type", "s.date", "s.anchor"))
    tied = news.join(spans, ["cik", "type", "date"])
    merged = tied.groupBy("cik", "type", "anchor").agg(
        F.max("penalty").alias("penalty"), F.count(F.lit(1)).alias("items"),
        F.min_by(F.struct("label", "origin", "severity", "title"), F.struct("date", "evidence")).alias("first"))
    evidence = (tied.groupBy("cik", "type", "anchor").agg(F.array_sort(F.collect_list(F.struct("date", "evidence"))).alias("_e"))
                .withColumn("evidence", F.transform("_e", lambda x: x["evidence"])).drop("_e"))
    near = (merged.select("cik", "type", "anchor")
            .withColumn("_t", F.explode(F.when(F.col("type") == "LAYOFFS", F.array(F.lit("LAYOFFS"), F.lit("RESTRUCTURING")))
                                        .otherwise(F.array("type"))))
            .withColumn("_day", F.explode(F.sequence(F.date_sub("anchor", days), F.date_add("anchor", days)))))
    filed = filings.select("cik", F.col("event").alias("_t"), F.col("filed").alias("_day")).distinct()
    superseded = near.join(filed, ["cik", "_t", "_day"], "left_semi").select("cik", "type", "anchor").distinct()
    keys = ["cik", "type", "anchor"]
    return (merged.join(evidence, keys).join(superseded.withColumn("superseded", F.lit(True)), keys, "left")
            .select("cik", "type", F.col("anchor").alias("date"), "first.label", "first.origin", "first.severity", "first.title",
                    F.when(F.col("superseded"), F.lit(0.0)).otherwise(F.col("penalty")).alias("penalty"), "items", "evidence",
                    F.coalesce("superseded", F.lit(False)).alias("superseded")))

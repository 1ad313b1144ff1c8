"""Splits, headlines, stories, names, generated-text checks - with brute force where SQL gives no oracle."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from keelson.functions import text
from keelson.models import anomaly, forecast, texts
from keelson.operators import evaluate, market, news, resolve, serving

T0 = dt.datetime(2024, 1, 1, 9)


def test_forward_split_is_found_and_undone(spark):
    px = [(100, 101), (101, 102), (102, 102.4), (25.7, 26), (26, 26.2), (26.2, 26.1)]
    rows = [("A", T0 + dt.timedelta(days=i), float(o), float(max(o, c)), float(min(o, c)), float(c), 1000.0) for i, (o, c) in enumerate(px)]
    df = spark.createDataFrame(rows, "ticker string, bar timestamp, open double, high double, low double, close double, volume double")
    adj = market.adjust_splits(df).orderBy("bar").collect()
    assert [r["split_ratio"] for r in adj if r["split_ratio"]] == ["4:1"]
    assert adj[2]["close"] == pytest.approx(25.6) and adj[2]["volume"] == pytest.approx(4000)


def test_headline_rules(spark):
    titles = ["Acme to lay off 500 staff", "Acme sued over data breach", "Acme opens new plant"]
    got = spark.createDataFrame([(t,) for t in titles], "title string").select(text.headline_event("title")["type"].alias("t")).collect()
    assert [r["t"] for r in got] == ["LAYOFFS", "LEGAL_REGULATORY", None]


def articles(spark, rows):
    return spark.createDataFrame([(1, i, t, ts) for i, (t, ts) in enumerate(rows)], "cik bigint, article_id bigint, title string, published_at timestamp")


def test_story_copies_collapse(spark):
    rows = [("Acme sued by regulators over battery recall", T0), ("Acme Sued by Regulators over Battery Recall!", T0 + dt.timedelta(hours=2)),
            ("Regulators sue Acme over battery recall", T0 + dt.timedelta(days=1)), ("Acme opens plant in Ohio", T0 + dt.timedelta(days=1))]
    assert news.deduplicate(articles(spark, rows)).count() == 2


def brute_force(rows):
    stop = set(text.STOPWORDS)

    def tokens(t):
        out = set()
        for w in re.findall("[a-z0-9]+", t.lower()):
            if w not in stop:
                out.add(re.sub("(ing|ed|es|s)$", "", w) if len(w) > 4 else w)
        return out

    seen, kept = set(), []
    for i, (t, ts) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        norm = " ".join(re.findall("[a-z0-9]+", t.lower()))
        if norm in seen:
            continue
        seen.add(norm)
        a = tokens(t)
        if not any((ts - s).days <= 3 and len(a & b) >= 3 and len(a & b) / max(1, min(len(a), len(b))) >= 0.6 for _, b, s in kept):
            kept.append((i, a, ts))
    return {k[0] for k in kept}


def test_greedy_story_order_against_brute_force(spark):
    import random
    rnd = random.Random(5)
    vocab = "alpha beta gamma delta recall probe battery merger plant loss chief bond".split()
    rows = [(" ".join(rnd.sample(vocab, rnd.randint(3, 6))), T0 + dt.timedelta(hours=7 * i)) for i in range(150)]
    got = {r["article_id"] for r in news.deduplicate(articles(spark, rows)).collect()}
    assert got == brute_force(rows)


def test_names_and_resolution(spark):
    co = spark.createDataFrame([(1, "Apple Inc.", "AAPL", []), (2, "Acme Holdings, Inc.", "ACM", ["Old Acme"]), (3, "Zenith Group plc", "ZZ", [])],
                               "cik bigint, name string, ticker string, former_names array<string>")
    shorts = {r["cik"]: r["s"] for r in co.select("cik", text.short_name("name").alias("s")).collect()}
    assert shorts == {1: "Apple", 2: "Acme", 3: "Zenith"}
    q = spark.createDataFrame([(1, "aapl"), (2, "acme holding"), (3, "zennith group"), (4, "nothing like it")], "query_id bigint, query string")
    got = {r["query_id"]: (r["cik"], r["score"]) for r in resolve.resolve(q, co).where("position = 1").collect()}
    assert got[1] == (1, 100.0) and got[2][0] == 2 and got[3][0] == 3 and 4 not in got


def test_grounding_flags_numbers_and_advice(spark):
    facts = spark.createDataFrame([(1, [68.0, 0.152, 2.5e9])], "k bigint, numbers array<double>")
    t = spark.createDataFrame([(1, 1, "Scores 68, margin 15.2% on 2.5 billion in 2024"), (1, 2, "You should buy: margin 99.7%")], "k bigint, id bigint, text string")
    got = {r["id"]: r for r in evaluate.grounding_problems(t, facts, "k").collect()}
    assert got[1]["unsupported"] == [] and not got[1]["advice"]
    assert got[2]["unsupported"] == ["99.7"] and got[2]["advice"]


def reports(spark, rows):
    schema = "company_id bigint, report_id bigint, generated_at timestamp, health_score int, band string, name string, signals array<struct<code:string,severity:string,message:string>>"
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(days=40 * i), s, b, "Acme", sig) for i, (s, b, sig) in enumerate(rows)], schema)


def test_alert_rules(spark):
    w = spark.createDataFrame([(42, 1, 10)], "user_id bigint, company_id bigint, threshold int")
    a = serving.alerts(reports(spark, [(70, "STRONG", []), (48, "WATCH", [])]), w).collect()
    assert [(x["type"], x["severity"], x["user_id"]) for x in a] == [("SCORE_DROP", "HIGH", 42)]
    known = [("GOING", "HIGH", "m")]
    assert serving.alerts(reports(spark, [(70, "STRONG", known), (65, "STABLE", known)]), w).count() == 0
    a = serving.alerts(reports(spark, [(67, "STABLE", []), (66, "STABLE", [("AUDITOR_CHANGE", "HIGH", "Auditor resigned")])]), w).collect()
    assert [x["type"] for x in a] == ["NEW_SIGNAL"] and "Auditor resigned" in a[0]["message"]


def test_isolation_forest_ranks_an_outlier_first(spark):
    import random
    rnd = random.Random(1)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(400)] + [(999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    f = anomaly.fit_forest(df, "id", ["x", "y"], trees=40)
    assert len(f) == 40
    assert anomaly.score_forest(df, ["x", "y"], f).orderBy(F.desc("raw_score")).first()["id"] == 999


def test_damped_trend_follows_a_seasonal_series(spark):
    q = [(1, dt.date(2018 + i // 4, 3 * (i % 4) + 3, 28), 100.0 + 2 * i + [10, -5, 0, -5][i % 4]) for i in range(20)]
    rows = forecast.damped_baseline(spark.createDataFrame(q, "cik bigint, end date, val double")).orderBy(F.desc("origin"), "horizon").limit(4).collect()
    want = [100 + 2 * i + [10, -5, 0, -5][i % 4] for i in range(20, 24)]
    assert all(abs(r["damped"] - w) < 12 for r, w in zip(rows, want))


def test_lexicon(spark):
    df = spark.createDataFrame([("Record profit and growth",), ("Sued after data breach",), ("Board meets",)], "t string")
    assert [r["x"] for r in df.select(texts.lexicon_label("t").alias("x")).collect()] == ["positive", "negative", "neutral"]


def test_resolution_equals_all_pairs(spark):
    draw = random.Random(6)
    vocabulary = ["Global", "Pacific", "Energy", "Data", "Steel", "First", "National", "Bank", "Water", "Blue", "Solar", "Ridge"]
    names = [" ".join(draw.sample(vocabulary, draw.randint(1, 5))) + draw.choice(["", " Inc", " Corp", " #00012", " #00013"]) for _ in range(120)]
    co = spark.createDataFrame([(i, n, f"T{i}", None) for i, n in enumerate(names)], "cik long, name string, ticker string, former_names array<string>")
    asked = [draw.choice(names).replace(*draw.choice([("a", "e"), ("e", ""), (" ", "  "), ("l", "ll")])) for _ in range(40)]
    asked += [" ".join(draw.sample(vocabulary, 6)) for _ in range(10)] + ["t7", "Bnk", "zz", ""]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    pairs = q.crossJoin(resolve.aliases(co)).withColumn("score", resolve.similarity(F.col("query"), F.col("alias"))).select("query_id", "cik", "score")
    exact = q.join(co, F.upper("query") == F.upper("ticker")).select("query_id", "cik", F.lit(100.0).alias("score"))
    want = {}
    for r in pairs.union(exact).groupBy("query_id", "cik").agg(F.max("score").alias("s")).where("s >= 60").collect():
        want.setdefault(r["query_id"], []).append((-r["s"], r["cik"]))
    got = {}
    for r in resolve.resolve(q, co).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["cik"]))
    assert got == {i: sorted(x)[:8] for i, x in want.items()} and len(got) > 45


def test_many_copies_of_a_story_meet_one_headline_each(spark, monkeypatch):
    """n copies give n pairs, not n squared, and the greedy order holds."""
    rows = [(f"Acme sued by regulators over battery recall case {i % 97}", T0 + dt.timedelta(minutes=i)) for i in range(400)]
    df = articles(spark, rows)
    emitted = []
    frame, checkpoint = type(df), type(df).checkpoint

    def counted(self, *args):
        out = checkpoint(self, *args)
        if out.columns == ["cik", "at", "lead"]:
            emitted.append(out.count())
        return out
    monkeypatch.setattr(frame, "checkpoint", counted)
    assert {r["article_id"] for r in news.deduplicate(df).collect()} == brute_force(rows)
    assert sum(emitted) <= 3 * 97                                  # 97 headlines differ in their words


def test_stories_equal_the_greedy_order(spark):
    rng = random.Random(11)
    words = [f"word{chr(97 + i)}x" for i in range(14)]
    rows = [(" ".join(rng.sample(words, rng.randint(2, 7))), T0 + dt.timedelta(hours=rng.randint(0, 300))) for _ in range(150)]
    assert {r["article_id"] for r in news.deduplicate(articles(spark, rows)).collect()} == brute_force(rows)


def test_day_blocks_cover_exactly_and_briefly(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.choice([1, 2, 15, 16, 17, 255, 4000, 100_000])) for a in (rng.randrange(0, 800_000) for _ in range(60))] + [(0, 16 ** 5), (5, 6)]
    df = spark.createDataFrame(spans, "a long, b long")
    for r in df.withColumn("c", serving.day_blocks(F.col("a"), F.col("b"))).collect():
        days = sorted((x["block"] * 16 ** x["level"], (x["block"] + 1) * 16 ** x["level"]) for x in r["c"])
        assert days[0][0] == r["a"] and days[-1][1] == r["b"] and all(x[1] == y[0] for x, y in zip(days, days[1:], strict=False))
        assert len(days) <= 180


def test_identifiers_join_no_more_rows_than_they_match(spark):
    day = dt.date(1994, 1, 1)
    ids = [("t", "A", k, day + dt.timedelta(days=3 * k), day + dt.timedelta(days=3 * k + 4)) for k in range(300)] + [("t", "A", 900, day, None), ("t", "A", 901, day, day)]
    probes = [("t", "A", day + dt.timedelta(days=k)) for k in range(0, 900, 7)] + [("t", "B", day), ("t", "A", day - dt.timedelta(days=1))]
    got = serving.identifier_asof(spark.createDataFrame(ids, "scheme string, value string, company_id long, valid_from date, valid_to date"),
                                  spark.createDataFrame(probes, "scheme string, value string, as_of date"))
    want = sorted((p[2], i[2]) for p in probes for i in ids if p[:2] == i[:2] and i[3] <= p[2] and (i[4] is None or p[2] < i[4]))
    assert sorted((r["as_of"], r["company_id"]) for r in got.collect()) == want


def test_identifier_blocks_are_not_broadcast(spark, capsys):
    """A validity becomes tens of blocks, so a small table of identifiers can be too large for the driver."""
    ids = spark.createDataFrame([("t", "A", 1, dt.date(1994, 1, 1), dt.date(1995, 5, 5))], "scheme string, value string, company_id long, valid_from date, valid_to date")
    ids = ids.hint("broadcast")
    got = serving.identifier_asof(ids, spark.createDataFrame([("t", "A", dt.date(1994, 2, 2))], "scheme string, value string, as_of date"))
    got.explain()
    assert [r["company_id"] for r in got.collect()] == [1] and "BroadcastExchange" not in capsys.readouterr().out


def test_damped_trend_in_one_pass(spark):
    """The streamed state of all settings gives what refitting each origin's whole history gives."""
    import numpy as np

    def refit(y, grid, season=4):
        best, out, base = np.inf, None, y[:season].mean()
        for a, b, g, phi in grid:
            level, trend, s, sse = base, (y[season:2 * season].mean() - base) / season, list(y[:season] - base), 0.0
            for t in range(season, len(y)):
                sse += (y[t] - level - phi * trend - s[t - season]) ** 2
                new = a * (y[t] - s[t - season]) + (1 - a) * (level + phi * trend)
                trend = b * (new - level) + (1 - b) * phi * trend
                s.append(g * (y[t] - new) + (1 - g) * s[t - season])
                level = new
            if sse < best:
                damp = np.cumsum(phi ** np.arange(1, 5))
                best, out = sse, [level + damp[h] * trend + s[len(y) - season + h] for h in range(4)]
        return out

    rng = np.random.default_rng(3)
    ends = [dt.date(2000 + q // 4, q % 4 * 3 + 3, 28) for q in range(30)]
    series = {c: rng.normal(100, 10, n) + np.arange(n) for c, n in ((1, 30), (2, 16), (3, 13))}
    rows = [(c, e, float(v)) for c, y in series.items() for e, v in zip(ends, y, strict=False)]
    got = {(r["cik"], r["origin"], r["horizon"]): r["damped"] for r in forecast.damped_baseline(spark.createDataFrame(rows, "cik long, end date, val double")).collect()}
    want = {(c, ends[k - 1], h + 1): v for c, y in series.items() if len(y) >= 14 for k in range(8, len(y) + 1) for h, v in enumerate(refit(y[:k], forecast.GRID))}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_review_interval_is_near_the_plain_bootstrap_and_stable(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(0.1, 0.5, 400), 1)
    rows = [(1, f"r{i}", float(v), dt.date(2020, 2, 1 + i % 28)) for i, v in enumerate(values)] + [(2, "x", 0.5, dt.date(2020, 5, 1)), (2, "y", None, dt.date(2020, 5, 1))]
    from keelson.operators import reviews
    df = spark.createDataFrame(rows, "cik long, review_id string, polarity double, date_review date")
    got = {r["cik"]: (r["ci90_low"], r["ci90_high"]) for r in reviews.bootstrap_interval(df).collect()}
    means = rng.choice(values, (4000, len(values))).mean(axis=1)
    assert got[1] == pytest.approx(tuple(np.quantile(means, [0.05, 0.95])), abs=0.012) and got[2] == (0.5, 0.5)
    monkey = reviews.PART_VALUES
    try:
        reviews.PART_VALUES = 5                                   # several parts of a quarter
        again = {r["cik"]: (r["ci90_low"], r["ci90_high"]) for r in reviews.bootstrap_interval(df.repartition(7)).collect()}
    finally:
        reviews.PART_VALUES = monkey
    assert again[1] == pytest.approx(got[1])


def test_a_kept_headline_meets_all_later_ones_before_it_leaves(spark, monkeypatch):
    """Each word of the second telling was used by an unrelated headline before, so it is first in no bucket. Copies give one row each."""
    first = [(f"{w} {' '.join(f'{w}{c}{c}x' for c in 'abcd')}", T0 + dt.timedelta(minutes=i)) for i, w in enumerate(("papaya", "quince", "raisin", "sultan"))]
    rows = first + [("papaya quince raisin sultan tomato", T0 + dt.timedelta(hours=1)), ("papaya quince raisin sultan ugli", T0 + dt.timedelta(hours=2))]
    rows += [(f"Acme sued by regulators over battery recall case {i % 97}", T0 + dt.timedelta(minutes=i)) for i in range(200)]
    emitted, frame, checkpoint = [], type(articles(spark, rows)), type(articles(spark, rows)).checkpoint

    def counted(self, *args):
        out = checkpoint(self, *args)
        if out.columns == ["head", "lead"]:
            emitted.append(out.count())
        return out
    monkeypatch.setattr(frame, "checkpoint", counted)
    assert {r["article_id"] for r in news.deduplicate(articles(spark, rows)).collect()} == brute_force(rows)
    assert 5 not in brute_force(rows) and 97 <= sum(emitted) <= 3 * 97


def test_story_cells_that_cannot_meet_are_left_out(spark):
    """Headlines that share two frequent words with a short one cannot be copies of it by these words alone."""
    a = articles(spark, [(f"{' '.join(f'{w}{i}x' for w in ('azure', 'beige', 'coral', 'denim'))} plant opening", T0) for i in range(30)])
    cells = news.story_cells(news.story_words(news.drop_exact_copies(a)), 3)
    assert cells.isEmpty() and news.deduplicate(a).count() == 30


def test_state_of_story_buckets_holds_no_words(spark):
    """Headlines of 300 words are open in 600 buckets each; what is stored for them must not be words times words."""
    from pathlib import Path

    from keelson.session import ensure_checkpoint_dir
    words = [f"word{i:04d}x" for i in range(330)]
    rows = [(1, i, " ".join(words[:300] if i % 2 else words[30:] + [f"only{i}"]), dt.datetime(2024, 1, 1 + i % 3)) for i in range(20)]
    a = spark.createDataFrame(rows, "cik bigint, article_id bigint, title string, published_at timestamp")
    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(f.stat().st_size for f in Path(root).rglob("*") if f.is_file())
    before = size()
    assert [r.article_id for r in news.deduplicate(a).collect()] == [0]
    assert size() - before < 400_000
    pairs = news.story_pairs(a).collect()
    unique = [r.article_id for r in news.drop_exact_copies(a).collect()]
    assert len(pairs) == len({(r.later, r.earlier) for r in pairs}) == 20 * 19 // 2 and len(unique) == 11


def test_day_blocks_cover_each_day_once_in_a_small_plan(spark):
    rng = random.Random(3)
    spans = [(0, 0), (5, 5), (7, 6), (0, 16), (1, 16 ** 5 + 3), (15, 4100), (None, 9)] + [(a, a + rng.randrange(10 ** rng.randint(1, 5))) for a in (rng.randrange(800_000) for _ in range(60))]
    df = spark.createDataFrame(spans, "a bigint, b bigint").select("a", "b", serving.day_blocks(F.col("a"), F.col("b")).alias("x"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 40_000
    for r in df.collect():
        days = sorted(d for x in r.x for d in range(x.block * 16 ** x.level, (x.block + 1) * 16 ** x.level)) if (r.b or 0) - (r.a or 0) < 70_000 else None
        if days is not None:
            assert days == (list(range(r.a, r.b)) if r.a is not None else [])
        assert len(r.x) <= 2 * 15 * 6 + 16 and (r.a is None or sum(16 ** x.level for x in r.x) == max(0, r.b - r.a))


def test_entity_candidates_are_exactly_the_near_names(spark):
    rng = random.Random(11)
    names = [f"Supplier {rng.randrange(4000):06d}{rng.choice(['', ' Group plc', ' Holdings'])}" for _ in range(60)]
    asked = [n.replace("pp", "p").replace("0", rng.choice("0x"), 1) for n in names[:30]]
    q, a = (spark.createDataFrame([(x,) for x in sorted(set(xs))], f"{c} string") for xs, c in ((asked, "query"), (names, "alias")))
    freq = resolve.token_rows(a, "alias").groupBy("kind", "token").agg(F.count("*").alias("f")).cache()
    left, right = resolve.rarest_first(q, "query", freq).cache(), resolve.rarest_first(a, "alias", freq).cache()
    both = {(r["query"], r["alias"]): r["s"] for r in q.crossJoin(a).withColumn("s", resolve.similarity(F.col("query"), F.col("alias"))).collect()}
    for least in (90.0, 60.0):
        got = [tuple(r) for r in resolve.candidates(left, right, least).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p, s in both.items() if s >= least - 1e-9}

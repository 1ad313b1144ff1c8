"""Collocations, sharding and the source audit against brute force in plain Python, and their defined cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm import divergence, phrases, queries, sharding

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ------------------------------------------------------------------ 11 collocations
def brute_collocations(docs, least, top):
    counts, n = Counter(), Counter()
    for _, text, lang, _ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i:i + k])] += 1
    out = []
    for lang in n:
        cands = {p: f for (g, p), f in counts.items() if g == lang and f >= least and len(p) > 1}
        rows = []
        for p, a in cands.items():
            inside = any(len(q) > len(p) and 100 * f >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in cands.items())
            if inside:
                continue
            cuts = [(1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((" ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def word_docs(seed, n, vocabulary="abcdef", languages=("en", None, "x")):
    draw = random.Random(seed)
    docs = []
    for i in range(n):
        words = [draw.choice(vocabulary) + draw.choice(["", "", "é"]) for _ in range(draw.randrange(0, 60))]
        text = "".join(w + draw.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "\xa0"]) for w in words)
        docs.append((i, text.title() if i % 5 == 0 else text, languages[i % len(languages)], f"s{i % 4}"))
    return docs


@pytest.mark.parametrize(("share", "bits"), [(1 / 8, 1 << 16), (0.0, 1 << 12), (1.0, 64)])
def test_collocations_equal_brute_force(spark, share, bits):
    """Also without a sample (all phrases are border failures) and with a table of proposals that is full."""
    docs = [*word_docs(3, 150), (None, None, "en", None), (None, "", None, None), (7, "A b a b a b! a b", "en", "s"), (7, "A b a b a b! a b", "en", "s")]
    got = phrases.collocations(spark.createDataFrame(docs, DOC), least=6, top=40, share=share, bits=bits).collect()
    assert sorted(map(tuple, got)) == brute_collocations(docs, 6, 40)


def test_border_failures_are_expanded_to_the_end(spark):
    docs = spark.createDataFrame([(i, "one two three four five six", "en", "s") for i in range(20)], DOC).select("text", "lang")
    none = phrases.PhraseSet.empty(1 << 12)

    def counted(df):
        return df.where("f >= 20").count()
    assert counted(phrases.hash_counts(docs, none)) == 6                   # words and no longer phrase: all of them fail
    failed = none.with_all(phrases.hash_counts(docs, none))
    assert counted(phrases.exact_counts(docs, none, failed)) == 1 + 6 + 5 + 4 + 3 + 2
    proposed = phrases.proposals(docs, 20, 1 << 12)
    assert counted(phrases.hash_counts(docs, proposed)) == 6 + 5 + 4 + 3 + 2
    assert counted(phrases.hash_counts(docs, proposed, 3)) == 4
    possible = none.with_all(phrases.hash_counts(docs, proposed))
    assert counted(phrases.exact_counts(docs, proposed, possible)) == 21
    # what the first pass counted below the threshold is not counted again
    rare = docs.limit(1).union(docs.limit(0))
    assert phrases.exact_counts(rare, proposed, none).where("k > 0").count() == 0


def test_long_texts_are_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 16)
    texts = ["", "aa bb.cc dd ee ff gg hh ii jj kk ll mm nn.oo pp", "x" * 50, "q.r", ".", "a b c d. e f g h. i j k l. m"]
    parts = list(phrases._folded_parts(iter(texts)))
    joined = b"\n".join(parts).split(b"\n")
    assert [p for p in joined if p.strip()] == [p for t in texts for p in re.split(rb"\.", t.encode()) if p.strip()]
    assert len(parts) > 3


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    assert phrases.collocations(empty, bits=64).count() == 0
    clash = spark.createDataFrame([(1, "a b " * 5, "en", 1, 2, 3)], "doc_id long, text string, lang string, k int, f int, phrase int")
    got = phrases.collocations(clash, least=4, share=1.0, bits=64).collect()
    assert got and sorted(map(tuple, got)) == brute_collocations([(1, "a b " * 5, "en", None)], 4, 2000)


def test_lowered_threshold():
    assert phrases.lowered(100, 1 / 8) == math.floor(12.5 - math.sqrt(12.5)) and phrases.lowered(3, 0.1) == 2


def test_scores_pass_64_bits(spark, monkeypatch):
    big = 3 * 10 ** 12
    rows = [("en", 0, "", 10 ** 16), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)]
    monkeypatch.setattr(phrases, "frequent", lambda *a: spark.createDataFrame(rows, phrases.COUNTED))
    row = phrases.collocations(None).first()
    assert row["score"] == 1000 * (big - 7) * 10 ** 16 // (big * (big + 1))


# ------------------------------------------------------------------ 12 sharding
@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_inverse(n):
    numbers = np.arange(n, dtype=np.uint64)
    p = sharding.Permutation(n, 5)
    there = p.apply(numbers)
    assert sorted(there.tolist()) == list(range(n)) and (p.invert(there) == numbers).all()
    shards, slots = sharding.place(numbers, max(n, 1), 8, 5)
    assert (sharding.row_at(shards, slots, max(n, 1), 8, 5) == numbers).all()


def test_permutation_shuffles_and_depends_on_its_seed():
    there = sharding.Permutation(10_000, 1).apply(np.arange(10_000)).astype(float)
    assert abs(np.corrcoef(np.arange(10_000), there)[0, 1]) < 0.05
    assert (there != sharding.Permutation(10_000, 2).apply(np.arange(10_000))).mean() > 0.99
    with pytest.raises(ValueError, match="outside"):
        sharding.Permutation(10).apply([10])


def check_shards(rows, n_shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op12_sharding(spark, SF).collect()
    check_shards(rows, 8)
    ranked = sorted(docs, key=lambda r: r["doc_id"])
    assert len({r["doc_id"] for r in docs}) == len(docs) == len(rows)
    place = {r["doc_id"]: p for r, p in zip(ranked, zip(*(x.tolist() for x in sharding.place(np.arange(len(docs)), len(docs), 8)), strict=True), strict=True)}
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs}
    for r in rows:
        assert (r["shard"], r["slot"]) == place[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]))
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_sharding_defined_cases(spark):
    rows = [(None, None, 1)] * 40 + [(None, "a", 2)] * 40 + [(3, "", 3), (3, None, 4), (3, "é" * 10, 5), (1, "a", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").withColumns({"slot": queries.F.lit("x"), "digest": queries.F.lit("y")})
    one = sharding.sharded(df, 8, partitions=3)
    assert one.columns == ["doc_id", "mark", "digest", "size", "text_crc32", "law", "row_number", "shard", "slot"]
    got = one.collect()
    check_shards(got, 8)
    assert sorted(r["row_number"] for r in got) == list(range(84)) and {r["digest"] for r in got} == {"y"}
    assert sorted((r["size"], r["text_crc32"]) for r in got if r["doc_id"] == 3) == sorted([(1, 0), (1, 0), (21, zlib.crc32(("é" * 10).encode()))])

    def told(df):                                      # rows equal in key and text change places only among themselves
        return sorted((r["doc_id"] or 0, r["text_crc32"], r["shard"], r["slot"]) for r in df.collect())
    assert told(one) == told(sharding.sharded(df.repartition(5, "mark"), 8, partitions=7))
    empty = sharding.sharded(df.where("false"), 8)
    assert empty.count() == 0
    with pytest.raises(ValueError, match="shard"):
        sharding.sharded(df, 0)


def test_written_shards_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4, rows_per_file=5)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    check_shards(back, 4)
    assert {(r["doc_id"], r["text"]) for r in back} == {(i, f"text {i}") for i in range(50)}


# ------------------------------------------------------------------ 13 source audit
def brute_audit(docs, least_docs, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    groups, seen, counts = {}, defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        group = (lang or "", source or "")
        groups[group] = True
        words = [lower(w) for w in term.findall(text or "")]
        counts[group].update(words)
        seen[group[0]].update(set(words))
    rows = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in seen[lang].items() if n >= least_docs}
        own = {s: Counter({t: n for t, n in counts[g, s].items() if t in kept}) for g, s in groups if g == lang}
        whole = sum(own.values(), Counter())

        def share(c, t):
            return 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept))        # noqa: B023
        for s, c in own.items():
            pairs = [(o, sum((share(c, t) - share(d, t)) ** 2 // share(d, t) for t in kept)) for o, d in own.items() if o != s]
            terms = [(t, (share(c, t) - share(whole, t)) ** 2 // share(whole, t)) for t in c if share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                rows += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items[:most])]
    return sorted(rows)


@pytest.mark.parametrize(("per_block", "values"), [(8, 200_000), (1, 30), (2, 64)])
def test_audit_equals_brute_force(spark, per_block, values):
    docs = [*word_docs(5, 120, "abcdefghij", ("en", None, "x", "")), (1, None, "only", "a"), (2, "", "only", None), (3, "word", "only", "c"),
            (4, "1 2 3", "lone", "z"), (5, "Ünï-Code’s x\x7fy", "en", "s0")]
    got = divergence.audit(spark.createDataFrame(docs, DOC), 3, 4, per_block, values).collect()
    assert sorted(map(tuple, got)) == brute_audit(docs, 3, 4)


def test_audit_of_nothing_and_clashing_columns(spark):
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0
    docs = spark.createDataFrame([("a b", "en", "s", 1, 2, 3)] * 3 + [("a", "en", "t", 1, 2, 3)], "text string, lang string, source string, n int, term int, p0 int")
    rows = {(r["source"], r["part"], r["item"]): r["value"] for r in divergence.audit(docs).collect()}
    p = {"s": [1 + 10 ** 9 * 4 // 8] * 2, "t": [1 + 10 ** 9 * 2 // 3, 1 + 10 ** 9 // 3]}
    assert rows["s", "pair", "t"] == sum((x - y) ** 2 // y for x, y in zip(p["s"], p["t"], strict=True))
    assert ("t", "term", "a") in rows and ("t", "term", "b") not in rows


def test_audit_cells_hold_a_bounded_grid(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + j)}{chr(97 + k)}" for j in range(20) for k in range(20)), "en", f"s{i}") for i in range(24)], DOC)
    got = divergence.audit(docs, groups_per_block=4, cell_values=800)
    assert got.where("part = 'pair'").count() == 24 * 23 and got.where("part = 'pair' and value <> 0").count() == 0

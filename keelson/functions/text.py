"""Text column helpers for headlines, names and generated summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: stop words ignored when matching stories -------------------------------------------------
STOPWORDS = ("a an the and or of to in on for by with at from as is are was were be its it this that over after into new "
             "says say said will has have had than more about up out amid vs").split()
# ---- fixed values: stems stripped from longer words, first match only ---------------------------------------
SUFFIX_PATTERN = "(ing|ed|es|s)$"
# ---- fixed values: headline rules in order of severity: type, label, penalty, severity, pattern --------------
HEADLINE_RULES = [
    ("BANKRUPTCY_NEWS", "Bankruptcy reported in the news", 0.0, "HIGH",
     r"\b(chapter 11|files? for bankruptcy|bankruptcy (filing|protection)|insolven\w*|receivership)\b"),
    ("LAYOFFS", "Layoffs reported", 0.0, "MEDIUM",
     r"\b(lay(s|ing)? off|layoffs?|job cuts?|cuts? \d[\d,]* jobs|workforce reduction|redundanc\w+|furlough\w*)\b"),
    ("LEGAL_REGULATORY", "Lawsuit or regulatory action reported", 10.0, "MEDIUM",
     r"\b(su(es|ed|ing)|lawsuit|class action|antitrust|probe|investigat\w+|fined?|penalt\w+|settle\w*|"
     r"subpoena|indict\w*|sec charges|doj|ftc|recall\w*)\b"),
    ("CYBER_INCIDENT", "Cyber incident reported", 15.0, "MEDIUM",
     r"\b(data breach|hack(ed|ers?)|cyber ?attack|ransomware|outage)\b"),
    ("LEADERSHIP_CHANGE", "Leadership change reported", 0.0, "LOW",
     r"\b(ceo|cfo|chief executive|chief financial).{0,40}\b(resign\w*|steps? down|ousted|fired|departs?|exit\w*|replac\w+)\b"),
    ("M_AND_A", "Merger or acquisition reported", 0.0, "LOW", r"\b(acquir\w+|acquisition|merger|takeover|buyout)\b"),
    ("EARNINGS", "Earnings reported", 0.0, "LOW", r"\b(earnings|quarterly results|revenue (beat|miss)|guidance|eps)\b"),
]
EVENT_TYPES = ["LAYOFFS", "LEGAL_REGULATORY", "CYBER_INCIDENT", "BANKRUPTCY_NEWS", "LEADERSHIP_CHANGE"]
# ---- fixed values: legal suffixes removed from company names ------------------------------------------------
LEGAL_SUFFIX = (r"(?i)(( inc| inc\.| corp| corp\.| corporation| co| co\.| company| ltd| plc| holdings| group| platforms"
                r"| /de/| /new/)[ ,]*)+$")
# ---- fixed values: words that make a generated text read as advice ------------------------------------------
ADVICE = (r"(?i)\b(buy|sell|short|invest(ment)? (advice|recommendation)|price target|you should|guarantee[ds]?|"
          r"will (fail|go bankrupt|collapse)|outperform rating)\b")
# ---- fixed values: numbers a text may always use ------------------------------------------------------------
PLAIN_NUMBERS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 30, 90, 100, 180, 365]


def normalise_title(title: str) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)")), " ")


def content_tokens(title: str) -> Column:
    """Distinct content words with light stemming."""
    words = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"))
    kept = F.filter(words, lambda w: ~w.isin(STOPWORDS))
    stemmed = F.transform(kept, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, SUFFIX_PATTERN, "")).otherwise(w))
    return F.array_sort(F.array_distinct(stemmed))


def short_name(name: str) -> Column:
    return F.regexp_replace(F.trim(name), LEGAL_SUFFIX, "")


def quoted(term: Column) -> Column:
    """Escape a literal for use inside a regular expression."""
    return F.regexp_replace(term, r"([^A-Za-z0-9_ ])", r"\\$1")


def names_company(title: str, terms: str) -> Column:
    """The title holds one of the terms (array column) as whole words, ignoring case."""
    return F.exists(terms, lambda t: F.regexp_like(F.lower(title), F.concat(F.lit(r"\b"), quoted(F.lower(t)), F.lit(r"\b"))))


def headline_event(title: str) -> Column:
    """First matching rule as a struct (type, label, penalty, severity), NULL when none matches."""
    chain = None
    for kind, label, penalty, severity, pattern in HEADLINE_RULES:
        hit = F.col(title).rlike("(?i)" + pattern)
        value = F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), F.lit(penalty).alias("penalty"),
                         F.lit(severity).alias("severity"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def evidence_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"ev:{prefix}-"), F.substring(F.sha1(key), 1, 10))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def review_text(headline: str = "headline", pros: str = "pros", cons: str = "cons", limit: int | None = None) -> Column:
    """Headline, pros and cons as one text; a model with a bounded input can ask for its first `limit` characters."""
    blank = F.lit("")
    whole = F.concat(F.coalesce(headline, blank), F.lit(". Pros: "), F.coalesce(pros, blank), F.lit(". Cons: "), F.coalesce(cons, blank))
    return whole if limit is None else F.substring(whole, 1, limit)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)

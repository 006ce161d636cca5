"""License scans by canonical digests.

A text is brought to a canonical form (lower case, no copyright statements, no
punctuation, one spelling of words that have several) and its digest is joined to the digests of
known licences, treated the same way.  Single lines are compared with known notices in
the same manner.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.known_licenses import LICENSES, NOTICES

#: Endings of verbs in -ize.
_IZE = "e|es|ed|er|ers|ing|ation|ations"
#: Words with several spellings in public licence texts: the spelling kept, another
#: one (a pattern), and the endings that may follow both.
SPELLINGS = [
    ("license", "licence", "[a-z]*"),
    ("sublicense", r"\bsub license", "[a-z]*"),
    ("copyright holder", "copyright owner", "s?"),
    ("noncommercial", r"\bnon commercial", "[a-z]*"),
    ("noninfring", r"\bnon infring", "[a-z]+"),
    ("authoriz", "authoris", _IZE),
    ("organiz", "organis", _IZE),
    ("recogniz", "recognis", _IZE),
    ("utiliz", "utilis", _IZE),
    ("favor", "favour", "[a-z]*"),
    ("labor", "labour", "s?"),
    ("program", "programme", "s?"),
    ("judgment", "judgement", "s?"),
    ("acknowledgment", "acknowledgement", "s?"),
    ("fulfill", "fulfil", "s|ment|ments|"),
    ("while", "whilst", ""),
    ("percent", r"\bper cent", ""),
    ("http", "https", ""),
]


def spelling_rules() -> list[tuple[str, str]]:
    """(pattern, spelling kept); what the pattern's group holds follows it."""
    return [(rf"{old}({ends})\b", new) for new, old, ends in SPELLINGS]


#: Comment marks, and up to three numbers of a list, before a line.
_MARKS = r"[ \t#*/;%!>|•-]*(?:(?:<!--|[0-9]{1,2}[.)])[ \t#*/;%!>|•-]*){0,3}"
#: Between two words of a commented text.
_GAP = r"[\s#*/;%!>|•-]*"


def _signed(gap: str) -> str:
    """The sign, a year or a placeholder makes a statement of a holder."""
    named = r"(?:[0-9]{4}|[<\[{])"
    return rf"(?:copyright[:,]?{gap}(?:\(c\)|©|{named})|\(c\){gap}(?:copyright|{named})|©)"


#: Words that follow "copyright" or a list's "(c)" inside a licence, never a holder's name.
_BODY_WORDS = (
    r"(?:notices?|holders?|owners?|laws?|acts?|licen[cs]\w*|statements?|protect\w*|interests?|claims?|information"
    r"|and|or|in|on|to|of|for|from|is|are|as|that|which|with|if|you|your|an|any|all|no|each|every|such|this"
    r"|must|may|shall|it|when|where|use|cause|give|include|retain|redistribut\w*|modif\w*)\b"
)
#: "a", unless it is an initial.
_BODY = rf"(?:{_BODY_WORDS}|a(?:[^.\w]|$))"
#: Words with which a licence goes on behind a holder's name.
_OPENING = (
    rf"(?:permission{_GAP}(?:is{_GAP}hereby|to{_GAP}use)|redistribution{_GAP}and{_GAP}use"
    rf"|this{_GAP}software{_GAP}is{_GAP}provided|everyone{_GAP}is{_GAP}permitted)"
)
#: Words of a title.
_TITLE = r"(?:licen[cs]e|attribution)\b"
#: The beginning of a statement in running text, and of one that is a line.
SIGNED = _signed(_GAP)
SIGNED_LINE = rf"{_MARKS}{_signed('[ \\t]*')}"
#: "copyright" or "(c)" before a name at the start of a line, or before a word of a licence's body.
NAMED_LINE = rf"{_MARKS}(?:copyright[:,]?|\(c\))[ \t]+"
#: A line that names a copyright holder, in lower case.
COPYRIGHT_LINE = rf"(?md)^(?:{SIGNED_LINE}|{NAMED_LINE}(?!{_BODY})(?=\S))[^\n]*$"
#: Marks put before titles and openings, and between a statement and the opening it leads to.
_CUT, _LEADS = "\x01", "\x02"
PUNCTUATION = r"[^\p{L}\p{N}]+"
#: A line without any of these is no known notice.
NOTICE_WORDS = "licen|rights|public domain"
#: Up to so many known digests are sent to every executor.
BROADCAST_KNOWN = 20_000


def without_statements(text: Column) -> Column:
    """Lower-case text without what stands from a holder's statement to a licence's opening.

    However the text is wrapped, and however long the statement; a title between the two ends
    it.  The text is cut at titles and openings, and every piece before an opening is
    shortened by itself, so the work grows with the text alone.
    """
    x = F.translate(text, _CUT + _LEADS, "")
    x = F.regexp_replace(x, _OPENING, f"{_LEADS}{_CUT}$0")
    x = F.regexp_replace(x, _TITLE, f"{_CUT}$0")
    shortened = lambda s: F.when(s.endswith(_LEADS), F.regexp_replace(s, f"(?s){SIGNED}.*", " ")).otherwise(s)
    return F.translate(F.array_join(F.transform(F.split(x, _CUT), shortened), ""), _LEADS, "")


def canonical(text: Column) -> Column:
    """The canonical form; null gives an empty one."""
    x = without_statements(F.lower(F.coalesce(text, F.lit(""))))
    x = F.regexp_replace(x, COPYRIGHT_LINE, "")
    x = F.trim(F.regexp_replace(x, PUNCTUATION, " "))
    return reduce(lambda y, rule: F.regexp_replace(y, rule[0], f"{rule[1]}$1"), spelling_rules(), x)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``name, text`` of built-in licences or notices."""
    return spark.createDataFrame(sorted(texts.items()), "name string, text string")


def _digests(known: DataFrame) -> DataFrame:
    """``known_digest, name``, one row per digest; sent to the executors if it is small."""
    named = known.select(F.col("name"), digest(F.col("text")).alias("known_digest"), canonical(F.col("text")).alias("c"))
    one = named.filter("c <> ''").groupBy("known_digest").agg(F.min("name").alias("name"))
    return F.broadcast(one) if one.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN else one


def scan_texts(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``digest`` and ``license``.

    ``license`` names the known licence that the whole text is, else it is null.  Of
    known texts with one digest the first name counts.  An empty or null text, or one of
    nothing but punctuation and copyright lines, is no licence.  Repeated rows are found
    alike.  Existing columns with the added names are replaced.
    """
    known = _digests(licenses if licenses is not None else known_texts(docs.sparkSession, LICENSES))
    base = docs.select([c for c in docs.columns if c not in ("digest", "license")])
    base = base.withColumn("digest", digest(F.col("text")))
    return base.join(known.select(F.col("known_digest").alias("digest"), F.col("name").alias("license")), "digest", "left")


def scan_lines(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_hash, n_notices, notices`` of the texts in which known notices stand as lines.

    Only lines that speak of licences leave their document.  ``notices`` is sorted,
    each name once; ``n_notices`` counts the lines.  Repeated rows count once.
    """
    known = _digests(notices if notices is not None else known_texts(docs.sparkSession, NOTICES))
    likely = F.filter(F.split(F.col("text"), "\n"), lambda line: F.lower(line).rlike(NOTICE_WORDS))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(likely).alias("at", "line"))
    found = lines.distinct().withColumn("known_digest", digest(F.col("line"))).join(known, "known_digest")
    return found.groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n_notices"), F.array_sort(F.collect_set("name")).alias("notices")
    )


def scan_licenses(
    docs: DataFrame, licenses: DataFrame | None = None, notices: DataFrame | None = None
) -> DataFrame:
    """``doc_id, digest, license, n_notices, notices`` of every row of ``docs`` (``doc_id, text``)."""
    whole = scan_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), licenses).drop("text")
    lines = scan_lines(docs.select("doc_id", "text"), notices).toDF("_id", "_hash", "n_notices", "notices")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return whole.join(lines, same, "left").select(
        "doc_id",
        "digest",
        "license",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )

"""License scans by canonical digest lookup.

A text is put in canonical form (case, punctuation, copyright lines and
equivalent spellings normalised) and its digest is joined with those of the
known licence texts.  Only whole texts count: a licence quoted inside a longer
document is another digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.license_texts import KNOWN, LICENSES  # noqa: F401
from millrace.llm.scratch import named

#: (pattern, replacement), applied in this order to the lower-case text; the patterns mean the same in Java and RE2.
#: Statements of copyright go: of known holders and templates wherever they stand, of others with their line, which
#: must begin with the word or sign and a year or mark, so that lines of a body that wrap before "copyright" stay.
RULES = [
    (r"copyright\s+\(c\)\s+[0-9][0-9, -]*\s+free\s+software\s+foundation,\s+inc\.", " "),
    (r"copyright\s+(\(c\)\s+<year>\s+<name\s+of\s+author>|\[yyyy\]\s+\[name\s+of\s+copyright\s+owner\])", " "),
    (r"(?m)^[^a-z0-9\n©(]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*$", " "),
    (r"all\s+rights\s+reserved", " "),
    (r"https://", "http://"),
    (r"&", " and "),
    (r"[^a-z0-9]+", " "),
]
#: Spellings that count as equal, in text of which only words are left.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]
#: Broadcast only while the table of known licences is below this many rows.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """The canonical form of a text, whatever the widths of its lines; null for null."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, new in RULES:
        if set(pattern) & set("()[]^$.+*?\\"):
            out = F.regexp_replace(out, pattern, new)
        else:
            out = F.replace(out, F.lit(pattern), F.lit(new))
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.btrim(out)


def known_licenses(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id, kind) of the given texts by id, or of the built-in ones; one row per digest."""
    rows = KNOWN if licenses is None else [(name, "text", text) for name, text in licenses.items()]
    table = spark.createDataFrame(rows, "license_id string, kind string, text string")
    digests = table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), F.struct("license_id", "kind").alias("x"))
    return digests.groupBy("digest").agg(F.min("x").alias("x")).select("digest", "x.license_id", "x.kind")


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: dict[str, str] | None = None
) -> DataFrame:
    """(id, text) -> (doc_id, digest, license_id, kind), one row per input row.

    digest is the SHA-256 of the canonical text (null for a null text); license_id
    is the SPDX id of the known licence with the same digest, else null, and kind what the text is of
    it: its text, that with its title (titled), without its appendix (terms), a
    one-line notice or an SPDX tag.  Texts without a
    letter or digit share the digest of the empty text, which no licence has.
    Of known licences with one digest, the smallest id is given.  Repeated rows come
    back repeated; extra columns are ignored; an empty table gives an empty result.
    A very long text is taken whole, in time in proportion to its length.
    One narrow pass: the known digests, a fixed list, are broadcast if few, else
    joined by shuffle.
    """
    known = known_licenses(docs.sparkSession, licenses)
    if len(KNOWN if licenses is None else licenses) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    rows = docs.select(named(id_col).alias("doc_id"), F.sha2(canonical(named(text_col)), 256).alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "license_id", "kind")

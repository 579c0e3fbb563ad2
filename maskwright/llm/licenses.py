"""Licence scans by canonical digests, with DataFrame operations only.

A text is normalised (case, punctuation, copyright lines, equivalent spellings)
and the digest of all that remains is joined to the digests of known licences and
notices.  Whole documents are looked up, and each of their lines as a text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import table
from maskwright.llm.known_licenses import DIGESTS, NOTICES

#: Equivalent spellings, replaced in this order after case and punctuation are gone.
SPELLINGS = (
    ("licence", "license"), ("licenc", "licens"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("https", "http"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("whilst", "while"), ("merchantibility", "merchantability"),
)
_NOT_WORDS, _BREAKS = r"[^\p{L}\p{N}\n]+", r" ?\n[ \n]*"
#: Notices of ownership: the word alone, as in "copyright holders be liable", doesn't make one.
_COPYRIGHT = r"(?m)^(?:copyright (?:copyright|c|by|yyyy|year|[0-9]{4})|c [0-9]{4}|all rights reserved)(?: .*)?$"

#: What may stand above a licence's own words: its name, and owners without a year.
_HEADINGS = r"\A\n*(?:(?:(?:the )?(?:mit|expat|isc|zlib|(?:new |simplified |modified )?bsd(?: [23] clause)?)(?: [23] clause)? license(?: (?:mit|isc|zlib|bsd))?|copyright(?: [^\n]*)?|all rights reserved(?: [^\n]*)?)\n+)+"


def normal_lines(text: Column) -> Column:
    """The normalised text, a line for each line that has words, without copyright lines."""
    x = F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("©"), F.lit("copyright "))), _NOT_WORDS, " ")
    x = F.trim(F.regexp_replace(x, _BREAKS, "\n"))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, _COPYRIGHT, "")


def whole(lines: Column) -> Column:
    """The normalised lines, without headings above the first other one, as one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(lines, _HEADINGS, ""), r"\n+", " "))


def known_digests(spark: SparkSession, notices: Mapping[str, Sequence[str]] = NOTICES) -> DataFrame:
    """license and digest of each known text; their number is that of the given texts and of DIGESTS."""
    rows = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, texts in notices.items() for text in texts))
    one = spark.range(1)
    given = one.select(F.inline(rows)).select("license", F.sha2(whole(normal_lines(F.col("text"))), 256).alias("digest"))
    entire = one.select(F.explode(F.create_map(*(F.lit(x) for pair in DIGESTS.items() for x in pair))).alias("license", "digest"))
    return given.unionByName(entire).distinct()


def digests_of(texts: DataFrame) -> DataFrame:
    """license and digest of further texts (license, text), as DIGESTS has them."""
    return texts.select("license", F.sha2(whole(normal_lines(F.col("text"))), 256).alias("digest"))


def scan(docs: DataFrame, notices: Mapping[str, Sequence[str]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit (text or line), license and the number of units, for what is known.

    A document whose whole text is one known notice has a row of either unit.  The name
    of the licence and owners above its first words make no difference to a whole text.  Null
    and empty texts, and those of copyright lines alone, match nothing.  Rows that
    repeat an id add up; a null id is a group of its own.  Two names of one text give a
    row each.  An empty table gives no rows.  Other columns aren't read.  A known text
    inside a longer one is found where it is one line.
    """
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_lines(F.col(text_col).cast("string")).alias("lines"))
    each = F.transform(F.filter(F.split("lines", "\n"), lambda x: x != ""), lambda x: F.struct(F.lit("line").alias("unit"), x.alias("body")))
    one = F.array(F.struct(F.lit("text").alias("unit"), whole(F.col("lines")).alias("body")))
    units = lines.select("doc_id", F.explode(F.concat(one, each)).alias("u")).select("doc_id", "u.unit", "u.body").filter("body <> ''")
    found = units.withColumn("digest", F.sha2("body", 256)).join(F.broadcast(known_digests(docs.sparkSession, notices)), "digest")
    return found.groupBy("doc_id", "unit", "license").agg(F.count("*").alias("units"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(notices: Mapping[str, Sequence[str]] = NOTICES) -> str:
    def normal(x: str) -> str:
        x = f"trim(regexp_replace(regexp_replace(lower(replace(coalesce({x}, ''), '©', 'copyright ')), '{_NOT_WORDS}', ' ', 'g'), '{_BREAKS}', chr(10), 'g'))"
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return f"regexp_replace({x}, '{_COPYRIGHT}', '', 'g')"

    one = lambda x: f"trim(regexp_replace(regexp_replace({x}, '{_HEADINGS}', ''), '\\n+', ' ', 'g'))"
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, texts in notices.items() for t in texts)
    entire = ", ".join(f"('{n}', '{d}')" for n, d in DIGESTS.items())
    return f"""
WITH k AS (SELECT DISTINCT license, sha256({one(normal("text"))}) AS digest FROM (VALUES {quoted}) v(license, text) UNION SELECT * FROM (VALUES {entire}) w(license, digest)),
n AS (SELECT doc_id, {normal("text")} AS lines FROM documents),
u AS (SELECT doc_id, 'text' AS unit, {one("lines")} AS body FROM n UNION ALL SELECT doc_id, 'line', unnest(string_split(lines, chr(10))) FROM n)
SELECT doc_id, unit, license, count(*) AS units FROM (SELECT *, sha256(body) AS digest FROM u WHERE body <> '') JOIN k USING (digest) GROUP BY ALL"""


OP8_SQL = oracle()

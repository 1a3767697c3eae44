"""Exact duplicates by content-defined chunk recipes (DataFrame functions only).

1. Runs of white space become one space. The text is cut where its own content
   says so: a chunk is the shortest run of at least LEAST characters that ends
   with one of CUTS, and at most MOST characters long. Equal texts get equal cuts.
2. Each chunk's identifier is its SHA-256. Chunks are deduplicated by
   identifier; the only pass that moves chunk text does so once, pre-aggregated,
   and verifies that no identifier stands for two different chunks.
3. A text's recipe is the ordered list of its identifiers. Recipes, not texts,
   are grouped and joined. Should verification ever find a shared identifier,
   the text itself is added to the keys.

Null text counts as empty; empty texts are equal to one another. The row with
the smallest id of a group stays; rows that repeat that id stay with it (they
are one document). A group whose ids are all null stays whole. Other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuescope.llm.common import saved

LEAST, MOST = 512, 4096
CUTS = "[aeiou][nrst] |[.?!] "
SPACES = r"[\x20\x09-\x0D]+"


def chunks(norm):
    return F.regexp_extract_all(norm, F.lit(rf"(?s).{{{LEAST},{MOST}}}?(?:(?<={CUTS})|$)|(?s).{{{MOST}}}|(?s).+"), F.lit(0))


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, norm, parts) of every row, and the chunk table (id, verified)."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"),
                    normal(docs[text_col]).alias("norm"))
    d = d.withColumn("parts", chunks(F.col("norm")))
    occ = d.select(F.explode("parts").alias("chunk")).select(F.unhex(F.sha2("chunk", 256)).alias("id"), "chunk")
    table = occ.groupBy("id").agg((F.min("chunk") == F.max("chunk")).alias("verified"))
    return d, table


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row."""
    d, table = recipes(docs, id_col, text_col)
    sound = table.where(~F.col("verified")).isEmpty()
    keys = F.transform("parts", lambda c: F.unhex(F.sha2(c, 256)))
    if not sound:
        keys = F.concat(keys, F.array(F.encode("norm", "UTF-8")))
    r = saved(d.select("doc_id", keys.alias("recipe"), F.sha2("norm", 256).alias("text_sha256")))
    groups = r.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return r.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256")


SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

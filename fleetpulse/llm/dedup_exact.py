"""Exact deduplication by skew-safe combining (native DataFrame plan).

Equal texts meet in three steps, and every step groups on the digest *and*
the whole normalised text, so a digest alone never decides:

1. map-side partial aggregation combines copies inside each input task;
2. copies are merged per (digest, text, salt): a group that holds a third of
   the corpus is spread over ``salts`` tasks, each receiving at most one
   partial row per map task;
3. the salt winners are combined globally, at most ``salts`` rows per text.

The global winners are then counted by digest, which tells for every digest of
the corpus whether it stands for one text, all copies compared in full, or for
several.  Where it stands for one, the digest is as good as the text, and the
winner goes back to its rows by it (left outer, so that adaptive execution may
split a hot digest).  Rows whose digest stands for several texts are grouped
again and joined by the whole text; with SHA-256 there are none to be expected,
and the step is not planned then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import ascii_lower, same
from fleetpulse.session import materialize

SALTS = 16


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def winners(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """``digest, norm, keep_id, group_size``: one row per text of ``rows`` (``doc_id, norm, digest``)."""
    salted = rows.groupBy("digest", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")) \
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy("digest", "norm") \
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the
    largest id stays.  Null text counts as empty, so null and empty texts form
    one group.  A null id never wins over another id; in a group of null ids
    only, ``keep_id`` is null and the rows are kept.  Rows that repeat the
    winning id with an equal text are the same document and are all marked
    kept.  Other columns of ``docs`` are ignored; an empty table gives no rows.
    The result is the same for any ``digest`` of the normalised text, even one
    that many texts share; it only has to spread them.
    """
    norm = ascii_lower(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    by_digest = winners(rows, salts).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    # written: every digest of several rows; the three figures are those of its text where it has one
    found = materialize(by_digest.where((F.col("group_size") > 1) | (F.col("texts") > 1)), "exact-groups")
    found = found.select([F.col(c).alias(f"g_{c}") for c in found.columns])

    def told(joined: DataFrame) -> DataFrame:
        single = F.col("g_group_size").isNull()
        keep = F.when(single, F.col("doc_id")).otherwise(F.col("g_keep_id"))
        return joined.select("doc_id", keep.alias("keep_id"),
                             F.when(single, F.lit(1)).otherwise(F.col("g_group_size")).cast("long").alias("group_size"),
                             F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")

    out = rows.select("doc_id", sha256(F.col("norm")).alias("text_sha256"), "digest")
    result = told(out.join(found, F.col("digest") == F.col("g_digest"), "left_outer")
                  .where(F.coalesce(F.col("g_texts"), F.lit(1)) == 1))
    shared = found.where(F.col("g_texts") > 1).select("g_digest")
    if shared.isEmpty():
        return result
    several = rows.join(shared, F.col("digest") == F.col("g_digest"), "left_semi")
    texts = winners(several, salts)
    texts = texts.select([F.col(c).alias(f"g_{c}") for c in texts.columns])
    return result.unionByName(told(
        several.withColumn("text_sha256", sha256(F.col("norm")))
        .join(texts, (F.col("digest") == F.col("g_digest")) & (F.col("norm") == F.col("g_norm")))))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = exact_dedup(docs, id_col, text_col).where(~F.col("kept")) \
        .select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"))
    return docs.join(gone, same(docs[id_col], gone["gone_id"])
                     & (F.sha2(ascii_lower(docs[text_col]), 256) == gone["gone_sha"]), "left_anti")

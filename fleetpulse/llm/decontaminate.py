"""Benchmark decontamination as a prefix-filtered join (native DataFrame plan).

Records are the item-sized windows of the benchmark: 10 consecutive item words,
or the whole item where it has fewer.  A window's tokens are its word shingles
(three words, or the whole window where it is shorter).  For exact containment
the necessary prefix of a window is one token, so:

1. the documents' shingles that occur in any window are found with one join
   against the benchmark's distinct shingle hashes (``hits``, written once);
2. the corpus frequency of every benchmark shingle is counted over all hits,
   and each window is indexed by its rarest shingle only;
3. the rare shingles' hits give candidates: the shingle's offset fixes where
   the window must start (positional bound), and the window must fit between
   that start and the end of the document (length bound);
4. the words of the candidate places are compared with the window's words.

No step groups all documents of a shingle: joins have the benchmark (its size
known from the written file) on one side.  Beyond the broadcast limit the same
joins run as sort-merge joins, where adaptive execution splits hot shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import item_words, same
from fleetpulse.session import materialize

WINDOW = 10
TOKEN_WORDS = 3


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id",
                 text_col: str = "text") -> DataFrame:
    """Distinct windows: ``wid`` (the words, space-joined), ``words``, ``size``,
    ``item_ids`` (distinct, of all items that have the window)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), item_words(F.col(text_col)).alias("w")) \
        .where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    win = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("s")) \
        .select("item_id", F.slice("w", F.col("s") + 1, window).alias("words"))
    return win.groupBy(F.array_join("words", " ").alias("wid")) \
        .agg(F.first("words").alias("words"), F.collect_set("item_id").alias("item_ids")) \
        .withColumn("size", F.size("words"))


def _shingles(rows: DataFrame, widths: dict[int, Column]) -> DataFrame:
    """``rows`` (with an array ``w`` of words, dropped) once for each shingle: ``pos`` (its first word) and ``h``
    (hash of its words), for every width in ``widths`` on the rows where its condition holds.

    The words are zipped with themselves shifted, so that a plain explode puts a
    shingle's words side by side and the hash runs in generated code."""
    most = max(widths)
    shifted = F.arrays_zip(F.col("w").alias("w0"), *[F.slice("w", k + 1, 1 << 30).alias(f"w{k}") for k in range(1, most)])
    kept = [c for c in rows.columns if c != "w"]
    placed = rows.select(*kept, F.posexplode(shifted).alias("pos", "x"))
    word = [F.col("x").getField(k) for k in (["w0"] + [f"w{k}" for k in range(1, most)])]
    hashes = [F.when(on & word[k - 1].isNotNull(), F.xxhash64(*word[:k])) for k, on in sorted(widths.items())]
    if len(hashes) == 1:
        return placed.select(*kept, "pos", hashes[0].alias("h")).where(F.col("h").isNotNull())
    return placed.select(*kept, "pos", F.explode(F.array_compact(F.array(*hashes))).alias("h"))


def window_tokens(windows: DataFrame) -> DataFrame:
    """``wid, size, pos, h``: the shingles of each window with their offset."""
    widths = {k: F.col("size") == k for k in range(1, TOKEN_WORDS)} | {TOKEN_WORDS: F.col("size") >= TOKEN_WORDS}
    return _shingles(windows.select("wid", "size", F.col("words").alias("w")), widths)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Every place where a window's words stand in a document: ``doc_id, text_hash,
    start, size, wid, item_ids`` (word positions from 0)."""
    windows = materialize(item_windows(benchmark, window), "decon-windows")
    tokens = materialize(window_tokens(windows), "decon-tokens")
    sizes = sorted(r[0] for r in tokens.select(F.least("size", F.lit(TOKEN_WORDS)).alias("k")).distinct().collect())
    known = materialize(tokens.select(F.col("h").alias("known")).distinct(), "decon-known")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("w"))
    placed = _shingles(keyed.withColumn("n", F.size("w")), dict.fromkeys(sizes or [TOKEN_WORDS], F.lit(True)))
    hits = materialize(placed.join(known, F.col("h") == F.col("known"), "left_semi"), "decon-hits")

    # rarity over all documents; a window whose rarest shingle never occurs cannot occur itself
    count = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    rarest = tokens.join(count, "h", "left_outer").groupBy("wid").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "pos")).alias("r"), F.first("size").alias("size")) \
        .where(F.col("r.df") > 0)
    index = materialize(rarest.select("wid", "size", F.col("r.h").alias("rare"), F.col("r.pos").alias("offset"))
                        .join(windows.select("wid", "words", "item_ids"), "wid"), "decon-index")
    start = F.col("pos") - F.col("offset")
    candidates = hits.join(index, F.col("h") == F.col("rare")) \
        .where((start >= 0) & (start + F.col("size") <= F.col("n"))) \
        .select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), start.alias("start"),
                "size", "wid", "words", "item_ids").distinct()
    candidates = materialize(candidates, "decon-candidates")
    wanted = materialize(candidates.select("c_id", "c_hash").distinct(), "decon-wanted") \
        .select(F.col("c_id").alias("w_id"), F.col("c_hash").alias("w_hash"))

    # the words themselves decide; only documents with a candidate are split again
    texts = rows.withColumn("text_hash", F.xxhash64("text")) \
        .join(wanted, same(F.col("doc_id"), F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")), "left_semi") \
        .dropDuplicates(["doc_id", "text_hash", "text"]).withColumn("w", item_words(F.col("text"))).drop("text")
    return texts.join(candidates, same(F.col("doc_id"), F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))) \
        .where(F.slice("w", F.col("start") + 1, F.col("size")) == F.col("words")) \
        .select("doc_id", "text_hash", "start", "size", "wid", "item_ids")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, item_ids, contaminated``.

    ``n_hit`` counts the words inside any occurrence of a window (overlaps
    once), ``item_ids`` the items with occurring windows, as sorted strings.
    Null or empty texts have no words and are clean; null or wordless items
    have no window; without items every document is clean.  An item with a null
    id counts in ``n_hit`` and ``contaminated`` but has no name in ``item_ids``.  Repeated rows get
    equal results, rows that share an id but not the text get their own (they
    are told apart by a hash of the text); a null id is an id like any other.
    """
    found = materialize(occurrences(docs, benchmark, window, id_col, text_col), "decon-found")
    key = ["doc_id", "text_hash"]
    places = found.select(*key, F.col("start"), (F.col("start") + F.col("size")).alias("end")).distinct()
    reach = F.max("end").over(Window.partitionBy(*key).orderBy("start", "end")
                              .rowsBetween(Window.unboundedPreceding, -1))
    covered = places.withColumn("reach", reach).groupBy(*key).agg(F.sum(F.greatest(
        F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reach", "start")))).alias("n_hit"))
    items = found.select(*key, F.explode("item_ids").alias("item")).groupBy(*key) \
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("item_ids"))
    hit = covered.join(items, same(covered.doc_id, items.doc_id) & (covered.text_hash == items.text_hash), "left_outer") \
        .select(covered.doc_id.alias("h_id"), covered.text_hash.alias("h_hash"), "n_hit", "item_ids")
    hit = materialize(hit, "decon-hit")

    text = F.col(text_col).cast("string")
    all_docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                           F.size(item_words(text)).cast("long").alias("n_words"))
    return all_docs.join(hit, same(F.col("doc_id"), F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")),
                         "left_outer").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    found = occurrences(docs, benchmark, window, id_col, text_col)
    bad = materialize(found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(),
                      "decon-bad")
    return docs.join(bad, same(docs[id_col], bad["bad_id"])
                     & (F.xxhash64(docs[text_col].cast("string")) == bad["bad_hash"]), "left_anti")

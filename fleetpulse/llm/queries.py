"""The registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import decontaminate as D
from fleetpulse.llm import dedup_exact as E
from fleetpulse.llm import html_extract as H
from fleetpulse.llm import langid as G
from fleetpulse.llm import licenses as L
from fleetpulse.llm import merkle as K
from fleetpulse.llm import mixing as M
from fleetpulse.llm import near_dup as N
from fleetpulse.llm import packing as P
from fleetpulse.llm import prefix_trie as V
from fleetpulse.llm import quality as Q
from fleetpulse.llm import token_count as TC
from fleetpulse.llm import token_store as TS
from fleetpulse.llm import twins
from fleetpulse.llm.common import table

# Target weights of the mix: every fourth source is a strong one, every second a middle one.
MIX_WEIGHTS = {f"src{i}": 4.0 if i % 4 == 0 else 2.0 if i % 2 == 0 else 1.0 for i in range(20)}


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = TS.store_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return stored.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return H.extract(pages, H.train(pages)).select("page_id", "url", "text", "n_chars")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TC.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return M.mix(docs, MIX_WEIGHTS).select("doc_id", "source", "mix.*")


def id_part(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts`` (0 for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = Q.train(docs, labels, id_part(5) != 0)
    return Q.score_quality(docs, model).select("doc_id", (id_part(5) == 0).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = G.train(docs, id_part(3) != 1)
    return G.identify(docs, model).select("doc_id", (id_part(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exact_dedup(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.license_digest(L.scan_licenses(table(spark, sf_dir, "documents")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.verify_tampered(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_store, op3_html_extraction, op4_token_counts, op5_mixing,
                                    op6_quality, op7_language_id, op8_exact_dedup, op9_near_dedup, op10_license_scan,
                                    op11_packing, op12_merkle, op13_prefix_trie)}

# ---------------------------------------------------------------- DuckDB twins
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
win AS (
  SELECT item_id, array_to_string(list_slice(w, s + 1, s + 10), ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT g.doc_id, g.s, g.n, v.item_id FROM grams g JOIN win v ON g.n = v.n AND g.k = v.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cov.n_hit, 0)::BIGINT AS n_hit,
       coalesce(its.n_items, 0)::BIGINT AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_OP8 = f"""
WITH d AS (SELECT doc_id, {_LOWER.format('text')} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(""" + _LOWER.format("text") + r""", '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(reach), d.doc_id) AS component_id,
       coalesce(min(reach), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _license_sql() -> str:
    """The notices, key phrases and labels as rows; positions by list comparison."""
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n  ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {words(t.words)}, {words(t.key_words)}, {t.key_offset})"
                        for k, t in enumerate(L.TEMPLATES))
    return f"""
WITH t(k, label, base, words, phrase, o) AS (VALUES
  {rows}),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
vocab AS (SELECT DISTINCT unnest(words) AS x FROM t),
df AS (SELECT x, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS x FROM d) JOIN vocab USING (x) GROUP BY x),
idf AS (SELECT x, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1 AS v FROM vocab LEFT JOIN df USING (x)),
spot AS (SELECT doc_id, w, p, k, label, base, words, o FROM (
    SELECT doc_id, w, unnest(range(len(w))) AS p FROM d) JOIN t ON w[p + 1] = phrase[1]
    AND list_slice(w, p + 1, p + len(phrase)) = phrase),
part AS (SELECT doc_id, p, k, sum(CASE WHEN p - o + q >= 0 AND w[(p - o + q + 1)::BIGINT] = words[q + 1] THEN v ELSE 0 END)
                / sum(v) AS share
    FROM (SELECT *, unnest(range(len(words))) AS q FROM spot) JOIN idf ON x = words[q + 1] GROUP BY doc_id, p, k),
best AS (SELECT doc_id, round(max(share), 4) AS score FROM part GROUP BY doc_id),
agg AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS f, max(p) FILTER (base) AS l,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl,
    string_agg(DISTINCT label, ',' ORDER BY label) AS al FROM spot GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, f AS first_word, l AS last_word,
       coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE = {"op1_decontamination": _OP1, "op8_exact_dedup": _OP8, "op9_near_dedup": _OP9,
          "op10_license_scan": _license_sql(), "op12_merkle": twins.MERKLE, "op13_prefix_trie": twins.PREFIX_TRIE}

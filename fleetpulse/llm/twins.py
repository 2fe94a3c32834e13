"""DuckDB twins of the tree operators."""

# crc32 of an ASCII text: a table of 256 numbers from the polynomial, then a step for every character.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [x * 0 FOR x IN range(8)],
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """Needs ``crc`` in the FROM clause."""
    return f"""xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"""


PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
said AS (SELECT conv_id, turn, coalesce(text, '') AS text,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, length(text) AS chars, tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(tok, 32)) - 1 AS p FROM said),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, {_crc32("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), crc),
s AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS shift FROM c LEFT JOIN c b ON b.conv_id = c.base),
turns AS (SELECT s.conv_id, p - h + shift AS pos, chars, tok FROM s JOIN own USING (conv_id) WHERE p >= h
  UNION ALL SELECT s.conv_id, p, chars, tok FROM s JOIN own ON own.conv_id = s.base WHERE p < h),
named AS (SELECT conv_id, pos + 1 AS depth, chars, string_agg(tok, '') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM turns),
place AS (SELECT conv_id, depth, chars, sha256(k) AS k FROM named UNION ALL SELECT conv_id, 0, 0, '' FROM c),
len AS (SELECT conv_id, max(depth) AS length FROM place GROUP BY conv_id),
node AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends
  FROM place JOIN len USING (conv_id) GROUP BY depth, k),
up AS (SELECT n.depth, n.k, q.k AS pk, q.conv_id AS parent_conv_id FROM node n JOIN place p ON p.conv_id = n.conv_id
    AND p.depth = n.depth - 1 JOIN node q ON q.depth = p.depth AND q.k = p.k),
kids AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM up GROUP BY ALL),
val AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids USING (depth, k)),
sub AS (SELECT a.depth, a.k, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM val v JOIN place a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens,
       sha256(ends) AS ends_sha256
FROM val v JOIN sub USING (depth, k) LEFT JOIN up USING (depth, k)
"""


def _record(text: str) -> str:
    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    return " || ".join(part.format(f) for f in ("doc_id", "source", "lang", "n_chars", text))


# a tree is named by its source behind '=', '-' for null ('-' sorts before '='); the tree of sources by ''
MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, sha256({_record("text")}) AS leaf,
    sha256({_record("replace(text, chr(10), '')")}) AS changed, {_crc32("doc_id::VARCHAR")} % 2 = 0 AS even FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    row_number() OVER () AS id FROM d),
node(tree, level, p, n, h) AS (
  SELECT tree, 0, p, count(*) OVER (PARTITION BY tree), leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM node WHERE n > 1
  GROUP BY tree, level, p // 3, n),
tops AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM node WHERE n = 1),
high(tree, level, p, n, h) AS (
  SELECT '', 0, place, count(*) OVER (), h FROM tops
  UNION ALL
  SELECT tree, level + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM high WHERE n > 1
  GROUP BY tree, level, p // 3, n),
low_fold(id, tree, level, p, v) AS (
  SELECT id, tree, 0, p, CASE WHEN even THEN changed ELSE leaf END FROM leaves
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.p // 3, sha256(string_agg(CASE WHEN s.p = f.p THEN f.v ELSE s.h END, '' ORDER BY s.p))
  FROM low_fold f JOIN node s ON s.tree = f.tree AND s.level = f.level AND s.p // 3 = f.p // 3
  WHERE s.n > 1 GROUP BY f.id, f.tree, f.level, f.p),
high_fold(id, tree, level, p, v) AS (
  SELECT f.id, '', 0, t.place, f.v FROM low_fold f JOIN node s ON s.tree = f.tree AND s.level = f.level AND s.n = 1
    JOIN tops t ON t.tree = f.tree
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.p // 3, sha256(string_agg(CASE WHEN s.p = f.p THEN f.v ELSE s.h END, '' ORDER BY s.p))
  FROM high_fold f JOIN high s ON s.level = f.level AND s.p // 3 = f.p // 3
  WHERE s.n > 1 GROUP BY f.id, f.tree, f.level, f.p),
steps AS (
  SELECT f.id, 0 AS stage, f.level, s.p, s.h FROM low_fold f JOIN node s
    ON s.tree = f.tree AND s.level = f.level AND s.p // 3 = f.p // 3 AND s.p <> f.p
  UNION ALL
  SELECT f.id, 1, f.level, s.p, s.h FROM high_fold f JOIN high s ON s.level = f.level AND s.p // 3 = f.p // 3 AND s.p <> f.p),
proof AS (SELECT id, string_agg(h, '' ORDER BY stage, level, p) AS siblings FROM steps GROUP BY id),
ends AS (SELECT f.id, f.v FROM high_fold f JOIN high s ON s.level = f.level AND s.n = 1)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(coalesce(siblings, '')) AS proof_sha256, e.v AS folded_root,
       e.v = r.h AS verified
FROM leaves l JOIN tops t USING (tree) JOIN ends e USING (id) LEFT JOIN proof USING (id), (SELECT h FROM high WHERE n = 1) r
"""

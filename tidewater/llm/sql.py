"""SQL that gives the rows of those queries of this subpackage that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

REPEATS = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
places AS (SELECT r, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
windows AS (SELECT r, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM places JOIN w USING (r)),
again AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM again),
each_word AS (SELECT r, generate_subscripts(words, 1) AS k, unnest(words) AS word FROM w),
kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.k) AS kept, count(*) AS n FROM each_word e ANTI JOIN gone g ON e.r = g.r AND e.k = g.k GROUP BY e.r)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""

COMPONENTS = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT doc_id, doc_id AS seen FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    sha256(coalesce(doc_id::VARCHAR, '') || chr(1) || coalesce(source, '') || chr(1) || sha256(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, sum(size)::DOUBLE AS total, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
o AS (
  SELECT *, size * 2.0::DOUBLE AS cap, sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(size * 2.0::DOUBLE) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS share
  FROM s WINDOW w AS (ORDER BY size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(rest / share, cap / weight) AS level FROM o WHERE rest / share <= cap / weight),
t AS (SELECT source, size AS source_size, least(cap, weight * level) AS target, CASE WHEN size > 0 THEN least(least(cap, weight * level) / size, 2) ELSE 1 END AS rate FROM o, l),
p AS (
  SELECT d.*, source_size, target, floor(rate + 1e-9) AS whole, (rate - floor(rate + 1e-9)) * source_size AS wanted,
    sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e0 AS (SELECT *, (size > 0 AND wanted > 1e-6 AND upto <= wanted)::INT AS extra FROM p),
{fits}
SELECT doc_id, size, source_size, target, ((whole + extra) * size)::BIGINT AS taken, (whole + extra)::BIGINT AS copies FROM e3"""


def _fit(n: int) -> str:
    """The n-th correction: the document that comes closest to what is amiss is put in or taken out."""
    amiss = f"g{n} AS (SELECT *, wanted - sum(extra * size) OVER (PARTITION BY source) AS gap FROM e{n - 1})"
    fits = f"f{n} AS (SELECT *, wanted > 1e-6 AND size > 0 AND abs(size - abs(gap)) < abs(gap) AND (gap > 0) = (extra = 0) AS fits FROM g{n})"
    best = f"r{n} AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(size - abs(gap)), key) = 1 AS best FROM f{n})"
    return f"{amiss},\n{fits},\n{best},\ne{n} AS (SELECT * EXCLUDE (gap, fits, best) REPLACE (CASE WHEN best THEN 1 - extra ELSE extra END AS extra) FROM r{n})"


MIX = MIX.format(fits=",\n".join(map(_fit, (1, 2, 3))))

CRC32 = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"

TRIE = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, ({CRC32.format("conv_id")} % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
s AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list(sha256(length(role)::VARCHAR || ':' || role || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
p AS (SELECT conv_id, depth, chars, sha256(array_to_string(path, ' ')) AS node FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM p GROUP BY ALL),
up AS (SELECT n.node, q.node AS above, q.depth AS level FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth <= n.depth),
kids AS (SELECT above AS node, count(*) AS k FROM up JOIN n USING (node) WHERE level = n.depth - 1 GROUP BY above),
below AS (SELECT above AS node, sum((n_convs - 1) * chars) AS saved, sum((coalesce(k, 0) = 0)::INT) AS leaves FROM up JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY above),
last AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN last USING (conv_id, depth) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN below USING (node) LEFT JOIN kids USING (node) LEFT JOIN e USING (node)
LEFT JOIN up u ON u.node = n.node AND u.level = n.depth - 1 LEFT JOIN n a ON a.node = u.above"""

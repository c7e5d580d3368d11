"""SQL over the sample tables that gives the same rows as the registered queries."""

from __future__ import annotations

from tidewater.sources import settings

DOCS = """
files AS (
  SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.md' AS path, 'default:' || coalesce(source, 'none') || '/' || doc_id || '.md' AS source_uri,
         'doc_' || substr(sha256('doc:default:default:' || coalesce(source, 'none') || '/' || doc_id || '.md'), 1, 12) AS rid, coalesce(text, '') AS text
  FROM documents)"""

CARDS = r"list_filter(list_transform(regexp_extract_all(text, '\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda c: length(c) = 16 AND list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(c[i] AS INT) WHEN CAST(c[i] AS INT) > 4 THEN CAST(c[i] AS INT) * 2 - 9 ELSE CAST(c[i] AS INT) * 2 END)) % 10 = 0)"
AWS, JWT, SSN = r"AKIA[0-9A-Z]{16}", r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_.+/=]+", r"\b[0-9]{6}-[1-4][0-9]{6}\b"

PII = f""",
pii AS (SELECT doc_id, len({CARDS}) AS cards, len(regexp_extract_all(text, '{AWS}')) AS aws, len(regexp_extract_all(text, '{JWT}')) AS jwt, len(regexp_extract_all(text, '{SSN}')) AS ssn FROM files),
lang AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힯]')) AS ko, len(regexp_extract_all(text, '[a-zA-Z가-힯]')) AS letters FROM files),
docs AS (
  SELECT f.*, cards + aws + jwt + ssn > 0 AS is_quarantined,
    CASE WHEN cards + aws + jwt + ssn > 0 OR path LIKE 'src3/%' THEN 'RESTRICTED' WHEN path LIKE 'src7/%' THEN 'PUBLIC' ELSE 'INTERNAL' END AS classification,
    CASE WHEN cards + aws + jwt + ssn > 0 OR letters = 0 OR ko / letters > 0.5 THEN 'ko' WHEN ko / letters < 0.1 THEN 'en' ELSE 'mixed' END AS language,
    CASE WHEN letters = 0 OR ko / letters > 0.5 THEN 'ko' WHEN ko / letters < 0.1 THEN 'en' ELSE 'mixed' END AS pure_language
  FROM files f JOIN pii USING (doc_id) JOIN lang USING (doc_id)),
visible AS (SELECT * FROM docs WHERE NOT is_quarantined AND classification <> 'RESTRICTED')"""

CANON = r"regexp_replace(regexp_replace(regexp_replace(replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '_', '-'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

GRAPH = f"""
ents AS (SELECT n_nationkey, {CANON.format("n_name")} AS name, n_name, 'ent_' || substr(sha256('ent:default:Service:' || {CANON.format("n_name")}), 1, 12) AS rid FROM nation),
designed AS (
  SELECT 'edge_' || substr(sha256('edge:default:CALLS:' || a.rid || ':' || b.rid), 1, 12) AS rid, 'CALLS' AS edge_type, a.rid AS from_rid, b.rid AS to_rid, a.name AS from_name, b.name AS to_name, 0.6::DOUBLE AS confidence
  FROM ents a, ents b WHERE a.n_nationkey <> b.n_nationkey AND (7 * a.n_nationkey + b.n_nationkey) % 8 = 0)"""


def calls(name: str, days: int | None) -> str:
    where = f"WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL {days} DAY" if days else ""
    return f"""
{name}_calls AS (
  SELECT s.name AS from_name, c.name AS to_name, s.rid AS from_rid, c.rid AS to_rid, greatest(date_diff('day', o_orderdate::DATE, l_shipdate::DATE), 0)::DOUBLE AS ms, l_returnflag = 'R' AS bad
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN ents s ON s.n_nationkey = s_nationkey JOIN ents c ON c.n_nationkey = c_nationkey {where}),
{name} AS (
  SELECT 'obs_' || substr(sha256('obs:default:CALLS:' || from_rid || ':' || to_rid), 1, 12) AS rid, 'CALLS' AS edge_type, from_rid, to_rid, from_name, to_name, count(*) AS call_count, round(count(*) FILTER (bad) / count(*), 6) AS error_rate,
    {rank("ms", 0.5)} AS latency_p50, {rank("ms", 0.95)} AS latency_p95, {rank("ms", 0.99)} AS latency_p99
  FROM {name}_calls GROUP BY ALL)"""


def rank(value: str, q: float) -> str:
    durations = f"list_sort(list({value}) FILTER ({value} > 0))"
    return f"{durations}[CAST(least(floor((count(*) FILTER ({value} > 0)) * {q}::DOUBLE), (count(*) FILTER ({value} > 0)) - 1) AS BIGINT) + 1]"


DIFF = """,
diff AS (
  SELECT 'doc_only' AS diff_type, d.rid AS edge_rid, NULL::VARCHAR AS obs_rid, d.from_name, d.to_name, d.edge_type, d.confidence, NULL::BIGINT AS call_count, NULL::DOUBLE AS latency_p95
  FROM designed d ANTI JOIN observed o ON d.from_rid = o.from_rid AND d.to_rid = o.to_rid
  UNION ALL
  SELECT 'observed_only', NULL, o.rid, o.from_name, o.to_name, o.edge_type, NULL, o.call_count, o.latency_p95
  FROM observed o ANTI JOIN designed d ON d.from_rid = o.from_rid AND d.to_rid = o.to_rid)"""


def lexical(source: str, key: str, queries: str, k: int) -> str:
    """Okapi BM25 of the rows that hold every term of a query."""
    return f"""
asked AS (SELECT query_id, unnest(list_distinct({TERMS.format("query")})) AS term FROM ({queries})),
sized AS (SELECT {key}, {TERMS.format("text")} AS terms FROM {source}),
stats AS (SELECT count(*) AS n_docs, avg(len(terms)) AS mean FROM sized),
hits AS (SELECT {key}, len, term, count(*) AS tf FROM (SELECT {key}, len(terms) AS len, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (
  SELECT query_id, {key}, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score, count(*) AS met
  FROM hits JOIN df USING (term) JOIN asked USING (term), stats GROUP BY query_id, {key}),
lexical AS (
  SELECT query_id, {key}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank
  FROM scored JOIN (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY query_id) USING (query_id) WHERE met = n_terms QUALIFY rank <= {k})"""


ONE_QUERY = "SELECT 0 AS query_id, 'the and' AS query"
VECTOR = """,
target AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT rid, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM embeddings JOIN visible ON vec_id = doc_id, target WHERE embedding IS NOT NULL ORDER BY score, rid LIMIT 20),
vector AS (SELECT rid, score, row_number() OVER (ORDER BY score, rid) AS rank FROM near)"""
FUSE = """,
both_lists AS (
  SELECT coalesce(l.rid, v.rid) AS rid, l.rank AS lexical_rank, v.rank AS vector_rank, round(coalesce(1 / (60::DOUBLE + l.rank + 1), 0) + coalesce(1 / (60::DOUBLE + v.rank + 1), 0), 9) AS score
  FROM lexical l FULL JOIN vector v ON l.rid = v.rid),
fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, lexical_rank NULLS LAST, vector_rank NULLS LAST) AS rank FROM both_lists QUALIFY rank <= {0})"""
SNIPPET = "CASE WHEN length(text) > {0} THEN substr(text, 1, {0}) || '...' ELSE text END"

TURNS = """
parts AS (SELECT conv_id, string_agg('## ' || coalesce(role, 'none') || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS parts FROM conversations GROUP BY conv_id),
convs AS (SELECT conv_id::VARCHAR AS rid, '# conv ' || conv_id || chr(10) || chr(10) || parts AS text FROM parts),
numbered AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM convs),
marked AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM numbered),
placed AS (
  SELECT rid, i, line, sum((s LIKE '# %' OR s LIKE '## %')::INT) OVER w AS section,
    last_value(CASE WHEN s LIKE '# %' THEN trim(substr(s, 3)) END IGNORE NULLS) OVER w AS h1, max(CASE WHEN s LIKE '# %' THEN i END) OVER w AS h1_at,
    last_value(CASE WHEN s LIKE '## %' THEN trim(substr(s, 4)) END IGNORE NULLS) OVER w AS h2, max(CASE WHEN s LIKE '## %' THEN i END) OVER w AS h2_at
  FROM marked WINDOW w AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)),
sections AS (
  SELECT rid, section, coalesce(nullif(concat_ws(' > ', nullif(max(h1), ''), CASE WHEN max(h1_at) IS NULL OR max(h2_at) > max(h1_at) THEN nullif(max(h2), '') END), ''), 'root') AS section_path,
    regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS section_text
  FROM placed GROUP BY rid, section HAVING section_text <> '')"""

FENCED = "SELECT rid, replace(text, '## user', '```' || chr(10) || chr(10) || '## user') AS text FROM convs"


def paragraphs(source: str, keys: str) -> str:
    """Blocks between blank lines as ``blocks``; a fenced block is one whole paragraph."""
    by = f"PARTITION BY {keys} ORDER BY i"
    return f"""
p_lines AS (SELECT {keys}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM ({source})),
p_bare AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM p_lines),
p_fences AS (SELECT *, bare LIKE '```%' AS fence, coalesce(sum((bare LIKE '```%')::INT) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM p_bare),
p_kinds AS (SELECT *, CASE WHEN fence AND code THEN 'end' WHEN fence THEN 'begin' WHEN code THEN 'code' WHEN bare = '' THEN 'blank' ELSE 'text' END AS kind FROM p_fences),
p_starts AS (SELECT *, kind = 'begin' OR (kind = 'text' AND coalesce(lag(kind) OVER ({by}), 'blank') IN ('blank', 'end')) AS starts FROM p_kinds),
p_numbered AS (SELECT *, sum(starts::INT) OVER ({by}) - 1 AS place FROM p_starts),
blocks AS (SELECT {keys}, place::INT AS place, string_agg(line, chr(10) ORDER BY i) AS t FROM p_numbered WHERE kind <> 'blank' GROUP BY {keys}, place)"""


def estimate(text: str) -> str:
    return f"floor(len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')) * 1.3::DOUBLE)::INT"


#: One piece at a time: what is open, its tokens, and the chunk that the piece closed.
PACK = """
pieces AS (
  SELECT rid, section, 0 AS place, section_text AS t FROM sections WHERE {whole} <= 40
  UNION ALL SELECT rid, section, place, t FROM blocks),
sized AS (SELECT *, {n} AS n, row_number() OVER (PARTITION BY rid, section ORDER BY place) AS k FROM pieces),
packing AS (
  SELECT rid, section, 0::BIGINT AS k, []::STRUCT(t VARCHAR, n INT)[] AS open, NULL::VARCHAR AS made FROM sections
  UNION ALL
  SELECT rid, section, k, CASE WHEN alone THEN open WHEN over_ THEN list_append(kept, piece) ELSE list_append(open, piece) END, CASE WHEN alone THEN t WHEN over_ THEN array_to_string(list_transform(open, lambda o: o.t), chr(10) || chr(10)) END
  FROM (SELECT p.rid, p.section, s.k, s.t, p.open, {{'t': s.t, 'n': s.n}} AS piece, s.n > 40 AND len(p.open) = 0 AS alone, len(p.open) > 0 AND s.n + list_sum(list_transform(p.open, lambda o: o.n)) > 40 AS over_,
          list_filter(p.open, lambda o, i: list_sum(list_transform(p.open[i:], lambda r: r.n)) <= 6) AS kept
        FROM packing p JOIN sized s ON s.rid = p.rid AND s.section = p.section AND s.k = p.k + 1)),
made AS (
  SELECT rid, section, k, made AS t FROM packing WHERE made IS NOT NULL
  UNION ALL
  SELECT rid, section, k + 1, array_to_string(list_transform(open, lambda o: o.t), chr(10) || chr(10)) FROM packing WHERE len(open) > 0 QUALIFY row_number() OVER (PARTITION BY rid, section ORDER BY k DESC) = 1 AND k = (SELECT max(k) FROM sized z WHERE z.rid = packing.rid AND z.section = packing.section)),
indexed AS (SELECT rid AS doc_rid, section_path, (row_number() OVER (PARTITION BY rid ORDER BY section, k) - 1)::INT AS chunk_index, t FROM made JOIN sections USING (rid, section))"""

SPANS = """
spans AS (
  SELECT event_id::VARCHAR AS trace_id, event_id, epoch_us(ts) * 1000 AS start_ns, round(value * 1e6)::BIGINT AS took, event_type = 'error' AS is_error, ts,
    CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS own, CAST(json_extract_string(props, '$.k') AS INT) % 8 AS k
  FROM events),
pairs AS (
  SELECT trace_id, CASE WHEN own <> '' THEN own ELSE 'svc-' || k END AS from_service, 'svc-' || k AS to_service, greatest(took / 1e6, 0) AS duration_ms, is_error,
    CASE WHEN own <> '' THEN 'service.name' WHEN k IN (1, 2) THEN 'peer.service+gazetteer' ELSE 'peer.service' END AS resolved_via, 'grpc' AS protocol, start_ns, ts
  FROM spans WHERE k <> 7)"""

GAZETTEER = (("payment-service", "payment-service", "Service"), ("order-service", "order-service", "Service"), ("tion-service", "tion-service", "Service"), ("the-topic", "the-topic", "Topic"), ("payment", "payment-service", "Service"), ("the and", "the-topic", "Topic"), ("order", "order-service", "Service"), ("tion", "tion-service", "Service"))
TRIGRAMS = "list_distinct(flatten(list_transform({0}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


RELATIONS = """
stated AS (SELECT item_id::VARCHAR AS rid, CASE item_id % 3 WHEN 0 THEN text || ' payment calls order. ' || text WHEN 1 THEN text || '. payment does not call order. it emits tion. ' ELSE text END AS t FROM benchmark),
cut AS (SELECT rid, regexp_split_to_array(t, '[.!?。]\\s*|\\n') AS s FROM stated),
numbers AS (SELECT rid, s, unnest(range(1, len(s) + 1)) AS w FROM cut),
windows AS (SELECT rid, w, array_to_string(s[greatest(w - 1, 1):w + 1], ' ') AS win FROM numbers),
known(place, word, name) AS (VALUES {known}),
triggers(n, edge_type, word) AS (VALUES {triggers}),
met AS (SELECT rid, w, name, min(place) AS place FROM windows JOIN known ON contains(lower(win), word) GROUP BY ALL),
placed AS (SELECT rid, w, n, edge_type, word, win, strpos(lower(win), lower(word)) AS spot FROM windows JOIN triggers ON contains(lower(win), lower(word))),
near AS (SELECT *, substr(win, greatest(spot - 30, 1), CASE WHEN spot > 30 THEN 60 ELSE spot + 29 END) AS around FROM placed),
said AS (SELECT * FROM near WHERE NOT {denied}),
relations AS (
  SELECT a.rid, edge_type, a.name AS from_name, b.name AS to_name, arg_min(word, a.w * 1000 + n) AS trigger, 0.6::DOUBLE AS confidence
  FROM met a JOIN met b ON a.rid = b.rid AND a.w = b.w AND a.place < b.place JOIN said ON said.rid = a.rid AND said.w = a.w GROUP BY ALL)"""


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def build() -> dict[str, str]:
    rules = settings.DEFAULTS
    neighbours = """SELECT hop, rid, from_name, to_name FROM walk"""
    walk = """walk AS (
  SELECT 1 AS hop, d.* FROM designed d, centre c WHERE from_rid = c.rid OR to_rid = c.rid
  UNION ALL
  SELECT w.hop + 1, e.* FROM walk w JOIN designed e ON (e.from_rid = w.to_rid OR e.to_rid = w.from_rid) AND e.rid <> w.rid WHERE w.hop < {0})"""
    centre = "centre AS (SELECT rid FROM ents WHERE n_name = 'NATION_0')"
    matched = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS name, '{t}' AS type, strpos(low, '{w}') - 1 AS position, {i} AS place FROM low" for i, (w, n, t) in enumerate(GAZETTEER))
    found_in_query = " + ".join(f"({' OR '.join(f'''contains(low, '{w}')''' for w, n, _ in GAZETTEER if n == name)})::INT" for name in dict.fromkeys(n for _, n, _ in GAZETTEER))
    lex = f"WITH {DOCS}{PII}, {lexical('visible', 'rid', ONE_QUERY, 20)}"
    fused = lambda k: lex + VECTOR + FUSE.format(k)
    graph = f"WITH RECURSIVE {GRAPH}"
    both = f"{graph}, {calls('observed', 7)}{DIFF}"
    kinds = [(kind, word) for kind, words in rules["triggers"].items() for word in words]
    quoted = lambda rows: ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)
    denied = any_of("around", [n.replace("'", "''") for n in rules["negations"]])
    stated = RELATIONS.format(known=quoted((i, w, n) for i, (w, n, _) in enumerate(GAZETTEER)), triggers=quoted((i, *k) for i, k in enumerate(kinds)), denied=denied)
    named = quoted((n, t) for n, t in dict.fromkeys((n, t) for _, n, t in GAZETTEER))
    proof = "'calls=' || call_count || ', error_rate=' || format('{:.2f}', round(error_rate * 100, 2)) || '%'"
    proofs = f"""{both}, {DOCS}{PII},
proofs AS (
  SELECT d.rid AS subject_rid, f.rid AS evidence_rid, 'n=' || (length(from_name) + length(to_name)) AS note FROM designed d JOIN files f ON f.doc_id = length(from_name) + length(to_name)
  UNION ALL SELECT rid, 'traces@2024-06-01 00:00:00', {proof} FROM observed),
shown AS (SELECT rid AS evidence_rid, {SNIPPET.format(200)} AS snippet, 'root' AS section_path, path AS title FROM visible)"""
    similarity = "len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)"
    return {
        "rid_documents": f"WITH {DOCS} SELECT doc_id, rid, source_uri FROM files",
        "canonical_names": f"SELECT p_partkey, {CANON.format(chr(40) + chr(39) + ' ' + chr(39) + ' || p_name || ' + chr(39) + '__x ' + chr(39) + chr(41))} AS name FROM part",
        "content_hash_changed": f"WITH {DOCS} SELECT doc_id, sha256(text) AS content_hash FROM files WHERE doc_id % 3 = 0",
        "base_filter_docs": f"WITH {DOCS}{PII} SELECT doc_id, classification FROM visible",
        "pii_scan": f"WITH {DOCS}{PII} SELECT doc_id, pii_type, n::INT AS n FROM (SELECT doc_id, 'aws_key' AS pii_type, aws AS n FROM pii UNION ALL SELECT doc_id, 'jwt', jwt FROM pii UNION ALL SELECT doc_id, 'credit_card', cards FROM pii UNION ALL SELECT doc_id, 'korean_ssn', ssn FROM pii) WHERE n > 0",
        "classify_docs": f"WITH {DOCS}{PII} SELECT doc_id, classification, is_quarantined, language, 'markdown' AS doc_type FROM docs",
        "quarantine_split": f"WITH {DOCS}{PII} SELECT count(*) AS total, count(*) FILTER (is_quarantined) AS quarantined, count(*) FILTER (NOT is_quarantined AND trim(text) = '') AS skipped, count(*) FILTER (NOT is_quarantined AND trim(text) <> '') AS indexed FROM docs",
        "language_ratio": f"WITH {DOCS}{PII} SELECT doc_id, pure_language AS language FROM docs",
        "token_estimate": rf"WITH {DOCS}, n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM files) SELECT doc_id, floor(n * 1.3::DOUBLE)::INT AS en, floor(n * 2.3::DOUBLE)::INT AS ko FROM n",
        "section_split": f"WITH {TURNS} SELECT rid, section::BIGINT AS section, section_path, sha256(section_text) AS text_hash FROM sections",
        "paragraph_split": f"WITH {TURNS}, {paragraphs(FENCED, 'rid')} SELECT rid, place, sha256(t) AS text_hash FROM blocks",
        "chunk_pack": f"WITH RECURSIVE {TURNS}, {paragraphs(f'SELECT rid, section, section_text AS text FROM sections WHERE {estimate('section_text')} > 40', 'rid, section')}, {PACK.format(whole=estimate('section_text'), n=estimate('t'))} SELECT 'chunk_' || substr(sha256('chunk:' || doc_rid || ':' || section_path || ':' || chunk_index), 1, 12) AS rid, doc_rid, section_path, chunk_index, {estimate('t')} AS token_count, sha256(t) AS text_hash FROM indexed",
        "mention_free": "SELECT conv_id, turn, sha256(trim(regexp_replace('<@U' || conv_id || '> ' || text || ' <@BOT> <@low>', '<@[A-Z0-9]+>', '', 'g'))) AS text_hash FROM conversations",
        "search_text": f"WITH {TURNS} SELECT rid, section::BIGINT AS section, sha256(coalesce(nullif(CASE WHEN section % 3 = 0 THEN '' WHEN section % 3 = 1 THEN 'about ' || rid END, ''), '[' || section_path || ']') || ' ' || section_text) AS text_hash FROM sections",
        "postings_build": f"WITH {DOCS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM files) GROUP BY term",
        "vector_index_topk": "WITH v AS (SELECT vec_id, vec_id::VARCHAR AS rid, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_or(list_transform(embedding, lambda x: x <> 0))), p AS (SELECT a.vec_id AS query_id, b.rid, round(1 - list_cosine_similarity(b.e, a.e), 6) AS score FROM v a, v b WHERE a.vec_id % 50 = 0) SELECT query_id, rid, score, row_number() OVER (PARTITION BY query_id ORDER BY score, rid) AS rank FROM p QUALIFY rank <= 10",
        "entity_match_large": f"WITH known AS (SELECT w, name, type, row_number() OVER (ORDER BY -length(w), n) AS place FROM (SELECT row_number() OVER () AS n, * FROM (VALUES {quoted((w, n, t) for w, n, t in GAZETTEER)}) AS v(w, name, type) UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY k, w), w, w, 'Part' FROM (SELECT DISTINCT 0 AS k, p_name AS w FROM part UNION ALL SELECT DISTINCT 1, s_name FROM supplier))), t AS (SELECT p_partkey, lower(p_name || ' and the and ' || upper(p_name) || '; order of ' || reverse(p_name)) AS low FROM part), f AS (SELECT p_partkey, name, type, strpos(low, lower(w)) - 1 AS position, place FROM t, known WHERE contains(low, lower(w))) SELECT p_partkey, name, type, position::INT AS position FROM f QUALIFY row_number() OVER (PARTITION BY p_partkey, name ORDER BY place) = 1",
        "indexed_after_change": f"WITH {DOCS}{PII}, later AS (SELECT rid, CASE WHEN doc_id % 10 = 3 THEN text || ' the and' ELSE text END AS text FROM visible WHERE doc_id % 10 <> 7), {lexical('later', 'rid', ONE_QUERY, 20)} SELECT rid, score, rank FROM lexical",
        "phrase_search": f"WITH {DOCS}, q AS (SELECT item_id AS query_id, {TERMS.format('text')} AS w FROM benchmark), t AS (SELECT doc_id, {TERMS.format('text')} AS w FROM files), each_term AS (SELECT doc_id, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM t) SELECT query_id, doc_id, count(*) AS n FROM q JOIN each_term ON a = w[1] AND (len(w) = 1 OR b = w[2]) GROUP BY ALL",
        "ingest_outcomes": f"WITH {DOCS}{PII}, o AS (SELECT *, text <> '' AND NOT is_quarantined AS open, (length(text) % 7 = 0)::INT + (length(path) % 7 = 0)::INT AS bad FROM docs) SELECT rid, CASE WHEN is_quarantined THEN 'quarantined' WHEN NOT open THEN 'skipped' WHEN bad = 2 THEN 'failed' ELSE 'indexed' END AS outcome, CASE WHEN open AND bad > 0 THEN 'embed' END AS stage, CASE WHEN open THEN 2 ELSE 0 END::BIGINT AS n_chunks, CASE WHEN open THEN bad ELSE 0 END::BIGINT AS n_failed FROM o",
        "lexical_topk": f"{lex} SELECT rid, score, rank FROM lexical",
        "vector_topk": f"WITH {DOCS}{PII}{VECTOR} SELECT rid, score, rank FROM vector",
        "rrf_fusion": f"{fused(10)} SELECT rid, lexical_rank, vector_rank, score, rank FROM fused",
        "hybrid_search": f"{fused(10)} SELECT rank, rid, path AS title, classification, score, {SNIPPET.format(300)} AS snippet FROM fused JOIN visible USING (rid)",
        "batch_lexical": f"WITH {DOCS}, {lexical('files', 'doc_id', 'SELECT item_id AS query_id, array_to_string(words[1:2], chr(32)) AS query FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT item_id, list_filter(' + TERMS.format('text') + ', lambda w: length(w) >= 3) AS w FROM benchmark))', 5)} SELECT query_id, doc_id, score, rank FROM lexical",
        "lexical_scan": f"WITH {DOCS}, {lexical('files', 'doc_id', 'SELECT item_id AS query_id, array_to_string(words[1:2], chr(32)) AS query FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT item_id, list_filter(' + TERMS.format('text') + ', lambda w: length(w) >= 3) AS w FROM benchmark))', 5)} SELECT query_id, doc_id, score, rank FROM lexical",
        "route_queries": f"""WITH q AS (SELECT item_id, lower(CASE item_id % 4 WHEN 0 THEN 'topology of ' || text WHEN 1 THEN 'DIFF ' || text ELSE text END) AS low FROM benchmark)
SELECT item_id, CASE WHEN item_id % 7 = 6 THEN 'vector_only' WHEN {found_in_query} >= 2 THEN 'graph_then_hybrid' WHEN {any_of("low", rules["graph_keywords"])} THEN 'hybrid_then_graph' WHEN {any_of("low", rules["diff_keywords"])} THEN 'graph_then_hybrid' ELSE 'hybrid_only' END AS route FROM q""",
        "entity_match": f"WITH {DOCS}, low AS (SELECT doc_id, lower(text) AS low FROM files), m AS ({matched}) SELECT doc_id, name, type, position::INT AS position FROM m WHERE position >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY place) = 1",
        "relation_extract": f"WITH {stated} SELECT * FROM relations",
        "relation_evidence": f"""WITH {stated}, ends AS (SELECT name, 'ent_' || substr(sha256('ent:default:' || type || ':' || name), 1, 12) AS rid FROM (VALUES {named}) v(name, type)),
edges AS (SELECT 'edge_' || substr(sha256('edge:default:' || edge_type || ':' || a.rid || ':' || b.rid), 1, 12) AS rid, edge_type, confidence, r.rid AS chunk FROM relations r JOIN ends a ON a.name = from_name JOIN ends b ON b.name = to_name)
SELECT rid, edge_type, max(confidence) AS confidence, count(DISTINCT chunk) AS n_evidence FROM edges GROUP BY rid, edge_type""",
        "resolve_names": f"{graph}, names AS (SELECT lower(n_name) AS name FROM nation UNION SELECT p_name FROM part) SELECT n.name, coalesce(e.rid, 'ent_' || substr(sha256('ent:default:Service:' || {CANON.format('n.name')}), 1, 12)) AS rid FROM names n LEFT JOIN ents e ON e.name = {CANON.format('n.name')}",
        "diff_detail": f"{both} SELECT diff_type, edge_rid, obs_rid, 'confidence=' || coalesce(confidence::VARCHAR, 'None') || ', calls=' || coalesce(call_count::VARCHAR, 'None') || ', p95=' || coalesce(latency_p95::VARCHAR, 'None') AS detail FROM diff",
        "trace_evidence": f"{graph}, {calls('observed', 7)} SELECT 'evi_' || substr(sha256('evi:' || rid || ':traces@2024-06-01 00:00:00'), 1, 12) AS rid, rid AS subject_rid, 'traces@2024-06-01 00:00:00' AS evidence_rid, 'trace_ref' AS kind, 0.25::DOUBLE AS weight, {proof} AS note, 'default' AS tenant FROM observed",
        "diff_evidence": f"{proofs} SELECT coalesce(edge_rid, obs_rid) AS edge_rid, evidence_rid, note, snippet, section_path, title, diff_type FROM diff JOIN proofs ON subject_rid = coalesce(edge_rid, obs_rid) LEFT JOIN shown USING (evidence_rid)",
        "graph_evidence": f"{proofs}, {centre}, {walk.format(2)} SELECT subject_rid AS edge_rid, evidence_rid, note, snippet, section_path, title FROM proofs LEFT JOIN shown USING (evidence_rid) WHERE subject_rid IN (SELECT rid FROM walk)",
        "recent_traces": f"WITH {SPANS} SELECT trace_id, start_ns, start_ns + took AS end_ns, CASE WHEN is_error THEN 2 ELSE 0 END AS code FROM spans WHERE start_ns BETWEEN epoch_us(TIMESTAMP '2024-01-15 11:00:00') * 1000 AND epoch_us(TIMESTAMP '2024-01-15 12:00:00') * 1000 ORDER BY start_ns, trace_id LIMIT 100",
        "observed_windows": f"{graph}, {calls('observed', 7)} SELECT rid, 'SYNC' AS interaction_style, '2024-05-31 23:55:00' AS window_start, '2024-06-01 00:00:00' AS window_end, '2024-06-01 00:00:00' AS last_seen_at FROM observed",
        "edge_upsert_max": f"{graph} SELECT rid, from_name, to_name, CASE WHEN length(from_name) > 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM designed",
        "entity_insert_absent": f"{graph} SELECT rid, name, n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM ents",
        "observed_replace": f"{graph}, {calls('old', 30)}, {calls('late', 7)} SELECT coalesce(n.rid, o.rid) AS rid, coalesce(n.call_count, o.call_count) AS call_count, coalesce(n.error_rate, o.error_rate) AS error_rate, coalesce(n.latency_p95, o.latency_p95) AS latency_p95, CASE WHEN o.rid IS NULL THEN 'http' ELSE 'grpc' END AS protocol FROM old o FULL JOIN late n ON o.rid = n.rid",
        "chunk_supersede": "SELECT conv_id || '-' || turn AS rid, conv_id AS owner, CASE WHEN conv_id % 4 = 0 AND turn = 1 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn <> 1) THEN 'superseded' ELSE 'active' END AS status FROM conversations",
        "evidence_link": f"{graph}, {DOCS} SELECT d.rid AS edge_rid, coalesce(f.rid, 'gone') AS evidence_rid, 'n=' || (length(from_name) + length(to_name)) AS note, {SNIPPET.format(200)} AS snippet FROM designed d LEFT JOIN files f ON f.doc_id = length(from_name) + length(to_name)",
        "designed_edges": f"{graph} SELECT rid, from_name, to_name, confidence FROM designed",
        "observed_edges": f"{graph}, {calls('observed', 7)} SELECT rid, from_name, to_name, call_count, error_rate, latency_p50, latency_p95, latency_p99 FROM observed",
        "edge_diff": f"{both} SELECT * FROM diff",
        "diff_summary": f"{both} SELECT f.diff_type, count(d.diff_type) AS n FROM (VALUES ('doc_only'), ('observed_only'), ('conflict')) f(diff_type) LEFT JOIN diff d ON f.diff_type = d.diff_type GROUP BY f.diff_type",
        "diff_filtered": f"{both} SELECT obs_rid, from_name, to_name, call_count FROM diff WHERE diff_type = 'observed_only' AND (from_name = 'nation-3' OR to_name = 'nation-3')",
        "tag_flags": f"{both} SELECT rid, CASE WHEN rid IN (SELECT edge_rid FROM diff WHERE diff_type = 'doc_only') THEN 'old,doc_only' ELSE 'old' END AS flags FROM designed",
        "neighbors_1hop": f"{graph}, {centre}, {walk.format(1)} {neighbours}",
        "neighbors_2hop": f"{graph}, {centre}, {walk.format(2)} {neighbours}",
        "find_path": f"""{graph}, {centre}, path AS (
  SELECT 1 AS hop, d.*, [d.rid] AS visited FROM designed d JOIN centre c ON d.from_rid = c.rid
  UNION ALL SELECT p.hop + 1, e.*, list_append(p.visited, e.rid) FROM path p JOIN designed e ON e.from_rid = p.to_rid AND NOT list_contains(p.visited, e.rid) WHERE p.hop < 3)
SELECT hop, rid, from_name, to_name, array_to_string(visited, ',') AS path_edges FROM path WHERE to_name = 'nation-16' ORDER BY hop, visited LIMIT 1""",
        "span_pairs": f"WITH {SPANS} SELECT trace_id, from_service, to_service, round(duration_ms, 3) AS duration_ms, is_error, resolved_via, protocol FROM pairs",
        "pair_aggregate": f"WITH {SPANS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY from_service, to_service ORDER BY start_ns, trace_id) AS n FROM pairs) SELECT from_service, to_service, count(*) AS call_count, count(*) FILTER (is_error) AS error_count, round(count(*) FILTER (is_error) / count(*), 6) AS error_rate, round({rank('duration_ms', 0.5)}, 3) AS latency_p50, 'grpc' AS protocol, string_agg(trace_id, ',' ORDER BY n) FILTER (n <= 5) AS samples FROM ranked GROUP BY from_service, to_service",
        "pair_percentiles": f"{graph}, {calls('every', None)} SELECT e.n_name AS from_service, t.n_name AS to_service, latency_p50, latency_p95, latency_p99 FROM every JOIN ents e ON e.rid = from_rid JOIN ents t ON t.rid = to_rid WHERE latency_p50 IS NOT NULL",
        "suggest_entities": f"{graph}, s AS (SELECT rid, name, n_name, {TRIGRAMS.format(TERMS.format('name'))} AS a, {TRIGRAMS.format(TERMS.format(chr(39) + 'nation-2' + chr(39)))} AS b FROM ents) SELECT rid, name, round({similarity}, 6) AS similarity FROM s WHERE contains(name, 'nation-2') OR n_name = 'nation-2' OR {similarity} > 0.3 ORDER BY similarity DESC, name LIMIT 10",
        "documents_page": f"WITH {DOCS}{PII} SELECT v.doc_id, path AS title, classification, count(conv_id) AS chunk_count FROM visible v LEFT JOIN conversations c ON c.conv_id = v.doc_id GROUP BY v.doc_id, path, classification ORDER BY v.doc_id DESC OFFSET 10 LIMIT 20",
        "status_counts": f"{graph}, {calls('observed', 7)}, {DOCS}{PII} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE is_quarantined) AS quarantined, (SELECT max(doc_id) FROM docs) AS last_doc, (SELECT count(*) FROM designed) AS edges, (SELECT count(*) FROM observed) AS observed_edges, (SELECT count(*) FROM ents) AS entities",
        "evidence_packet": f"{fused(10)} SELECT 'd' || rank % 4 AS doc_rid, 'd' || rank % 4 AS source_uri, min(rank) AS first_rank FROM fused JOIN visible USING (rid) GROUP BY ALL",
        "prompt_text": f"{fused(3)} SELECT '## Evidence' || chr(10) || string_agg('### ' || rank || ' [' || path || '] (root)' || chr(10) || 'source: ' || source_uri || chr(10) || 'level: ' || classification || chr(10) || {SNIPPET.format(300)}, chr(10) ORDER BY rank) AS prompt FROM fused JOIN visible USING (rid)",
        "stream_span_windows": f"WITH {SPANS} SELECT strftime(time_bucket(INTERVAL 60 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, from_service, to_service, count(*) AS call_count, count(*) FILTER (is_error) AS error_count FROM pairs GROUP BY ALL",
        "crm_validation": f"WITH {DOCS} SELECT 0::BIGINT AS orphans, (SELECT count(*) FROM (SELECT rid FROM files GROUP BY rid HAVING count(*) > 1)) AS repeated, (SELECT count(DISTINCT rid) FROM files) AS distinct_rids",
        "turn_order": "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    }

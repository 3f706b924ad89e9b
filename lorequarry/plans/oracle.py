"""SQL (DuckDB) that gives the rows of the queries."""

from __future__ import annotations

from lorequarry.functions.tei import SECTION_KEYWORDS, SKIPPED_KEYWORDS

_QUESTIONS = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS mine FROM embeddings WHERE vec_id % 20 = 0"


def _near(k: int, where: str = "true") -> str:
    return f"""SELECT * FROM (
      SELECT query_id, vec_id AS chunk_id, label, list_cosine_distance(embedding::DOUBLE[], q) AS distance,
        row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(embedding::DOUBLE[], q), vec_id) AS rank
      FROM embeddings, ({_QUESTIONS}) WHERE vec_id <> query_id AND {where}) WHERE rank <= {k}"""


_HITS = "SELECT query_id, chunk_id, label, round(distance, 6) AS distance, rank FROM"
_PAPERS = f"""SELECT query_id, label::VARCHAR AS doc_id, min(rank) AS first_chunk_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS rank FROM ({_near(15)}) GROUP BY query_id, label"""
_ATTRIBUTES = f"""SELECT * FROM (SELECT query_id, l.label::VARCHAR AS doc_id,
  row_number() OVER (PARTITION BY query_id ORDER BY abs(l.label - mine), l.label::VARCHAR) AS rank
  FROM ({_QUESTIONS}), (SELECT DISTINCT label FROM embeddings) l) WHERE rank <= 6"""
_TAGGED = f"""SELECT query_id, doc_id, rank, 'graph' AS list FROM ({_ATTRIBUTES})
  UNION ALL SELECT query_id, doc_id, rank, 'vector' FROM ({_PAPERS})"""


def _fused(terms: str) -> str:
    return f"""SELECT query_id, doc_id, sum(term) AS score, bool_or(list = 'graph') AS in_graph, bool_or(list = 'vector') AS in_vector,
      row_number() OVER (PARTITION BY query_id ORDER BY round(sum(term), 12) DESC, doc_id) AS rank
    FROM ({terms}) GROUP BY query_id, doc_id"""


_RRF = _fused(f"SELECT *, 1.0::DOUBLE / (60 + rank) AS term FROM ({_TAGGED})")
_WEIGHTED = _fused(f"""SELECT *, 0.5 * CASE WHEN max(v) OVER w <= min(v) OVER w THEN 1.0::DOUBLE ELSE (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS term
  FROM (SELECT *, 1.0::DOUBLE / rank AS v FROM ({_TAGGED})) WINDOW w AS (PARTITION BY query_id, list)""")
_FUSED_ROWS = "SELECT query_id, doc_id, round(score, 6) AS score, in_graph, in_vector, rank FROM"

_EDGES = """SELECT DISTINCT * FROM (
  SELECT 'author' AS src_kind, 'A' || l_suppkey AS src_id, 'YAZDI' AS relation, 'paper' AS dst_kind, 'P' || l_orderkey AS dst_id FROM lineitem
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT 'author', 'A' || l_suppkey, 'ÇALIŞIYOR', 'institution', n_name FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'paper', 'P' || l_orderkey, 'ÖNERİYOR', 'method', p_brand FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'N'
  UNION ALL SELECT 'paper', 'P' || l_orderkey, 'ELEŞTİRİYOR', 'method', p_brand FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'
  UNION ALL SELECT 'paper', 'P' || l_orderkey, 'YAYINLANDI', 'year', year(o_orderdate)::VARCHAR FROM lineitem JOIN part ON p_partkey = l_partkey
    JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey)"""
_PAPER_NODES = """SELECT DISTINCT 'P' || l_orderkey AS paper_id, 'paper ' || l_orderkey AS title, CAST(year(o_orderdate) AS INTEGER) AS year
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey"""
_NODES = f"""SELECT 'paper' AS kind, paper_id AS id, '' AS name, NULL::VARCHAR AS aliases, '' AS institution, title, year FROM ({_PAPER_NODES})
  UNION ALL SELECT DISTINCT 'author', 'A' || s_suppkey, s_name, 'Maker ' || s_suppkey, n_name, NULL, NULL::INTEGER FROM supplier JOIN nation ON n_nationkey = s_nationkey
    WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey)
  UNION ALL SELECT DISTINCT dst_kind, dst_id, '', NULL, '', NULL, NULL::INTEGER FROM ({_EDGES}) WHERE dst_kind <> 'paper'"""


def _lcs(a: str, b: str) -> str:
    """Longest common subsequence by two nested reductions over VARCHAR lists."""
    return f"""list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [({a})[i]]),
      lambda prev, ch: list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j::VARCHAR]),
        lambda cur, j: list_append(cur, (CASE WHEN ch[1] = ({b})[j[1]::INT] THEN prev[j[1]::INT]::INT + 1
          ELSE greatest(prev[j[1]::INT + 1]::INT, cur[-1]::INT) END)::VARCHAR), ['0']),
      list_transform(range(0, length({b}) + 1), lambda j: '0'))[-1]::INT"""


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def _sort_score(a: str, b: str) -> str:
    return f"round(2.0::DOUBLE * {_lcs(a, b)} / (length({a}) + length({b})), 4)"


def _tiered(n: str, h: str, sn: str, sh: str) -> str:
    return f"""CASE WHEN {n} = {h} THEN 1.0 WHEN list_contains(string_split({h}, ' '), {n}) THEN 0.98
      WHEN length({n}) >= 3 AND len(list_filter(string_split({h}, ' '), lambda t: starts_with(t, {n}))) > 0 THEN 0.92
      ELSE {_sort_score(sn, sh)} END::DOUBLE"""


_PAIRS = f"""SELECT query, p_name, lower(query) AS lq, lower(p_name) AS lp, {_sorted('query')} AS sq, {_sorted('p_name')} AS sp,
  {_sorted('lower(query)')} AS slq, {_sorted('lower(p_name)')} AS slp
  FROM (SELECT DISTINCT p_name FROM part), (VALUES ('red bolt'), ('bolt red'), ('Blue gears'), ('sma')) v(query)"""

_SETS = f"""SELECT query, p_name,
    array_to_string(list_sort(list_filter(string_split(query, ' '), lambda t: list_contains(string_split(p_name, ' '), t))), ' ') AS i,
    array_to_string(list_sort(list_filter(string_split(query, ' '), lambda t: NOT list_contains(string_split(p_name, ' '), t))), ' ') AS x,
    array_to_string(list_sort(list_filter(string_split(p_name, ' '), lambda t: NOT list_contains(string_split(query, ' '), t))), ' ') AS y
  FROM ({_PAIRS})"""
_SET_SCORES = f"""SELECT *, length(i) AS s, length(x) AS dx, length(y) AS dy, CASE WHEN i <> '' THEN 1 ELSE 0 END AS g,
    CASE WHEN x = '' OR y = '' THEN 0 ELSE {_lcs('x', 'y')} END AS common FROM ({_SETS})"""

_METHODS = "SELECT DISTINCT dst_id AS id FROM ({e}) WHERE dst_kind = 'method'".format(e=_EDGES)


def _methods_like(query: str) -> str:
    return f"""SELECT id FROM ({_METHODS}) WHERE CASE WHEN lower(id) = lower('{query}') THEN 1.0
      ELSE {_sort_score(f"lower('{query}')", 'lower(id)')} END >= 0.85"""


_METHOD_SCORES = f"""SELECT id, query, CASE WHEN lower(id) = lower(query) THEN 1.0::DOUBLE WHEN starts_with(lower(id), lower(query)) THEN 0.92
  ELSE {_sort_score('lower(query)', 'lower(id)')} END AS score FROM ({_METHODS}), (VALUES ('brand#13'), ('Brand'), ('nothing like it')) v(query)"""

_AUTHORS_LIKE = f"""SELECT 'A' || s_suppkey AS id FROM supplier WHERE 'maker ' || s_suppkey = 'maker 3'
  OR ({_sort_score("'3 maker'", "(s_suppkey || ' maker')")}) >= 0.85 AND s_suppkey::VARCHAR <> '3'"""


def _keywords(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({column}, '{'|'.join(words)}') THEN '{name}'" for name, words in SECTION_KEYWORDS)
    return f"CASE {cases} END"


_HEADS = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CASE event_type WHEN 'signup' THEN '1. Introduction' WHEN 'click' THEN 'II. Method' WHEN 'purchase' THEN 'Results'
    WHEN 'error' THEN 'Related Work' ELSE 'A. Details' END AS head FROM events"""
_CLASSED = f"""SELECT user_id, pos, head, {_keywords('normal')} AS own, regexp_matches(normal, '{'|'.join(SKIPPED_KEYWORDS)}') AS skip,
  regexp_matches(head, '^[A-Z]\\.\\s+') AS sub
  FROM (SELECT *, lower(trim(regexp_replace(head, '^(?:[IVXLCDM]+|[A-Z]|\\d+)(?:\\.\\d+)*\\.?\\s+', '', 'i'))) AS normal FROM ({_HEADS}))"""
_ASSIGN = """CASE WHEN c.own IS NULL AND {last} IS NOT NULL AND c.sub THEN {last} WHEN c.own IS NULL AND c.skip THEN NULL
  WHEN c.own IS NULL AND NOT c.sub AND {seen} AND coalesce({last}, '') <> 'results' THEN 'method' ELSE c.own END"""


def _step(last: str, seen: str, source: str) -> str:
    section = _ASSIGN.format(last=last, seen=seen)
    keeps = f"c.own IS NULL AND NOT ({last} IS NOT NULL AND c.sub) AND NOT c.skip AND c.sub"
    return f"""SELECT c.user_id, c.pos, c.head, {section} AS section,
      CASE WHEN {section} IS NOT NULL THEN {section} WHEN {keeps} THEN {last} END AS last,
      {seen} OR coalesce({section} = 'introduction', false) AS seen FROM {source}"""


ORACLE_SQL = {
    "vector_topk": f"{_HITS} ({_near(5)})",
    "vector_topk_prefilter": f"{_HITS} ({_near(5, 'label BETWEEN 2 AND 5')})",
    "vector_topk_postfilter": f"""{_HITS} (SELECT query_id, chunk_id, label, distance, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
      FROM ({_near(40)}) WHERE label >= 5) WHERE rank <= 5""",
    "vector_index_recall": f"SELECT count(*) AS hits, true AS most, true AS every FROM ({_near(5)})",
    "paper_rank_from_chunks": f"SELECT query_id, doc_id, rank, first_chunk_rank FROM ({_PAPERS})",
    "rrf_fusion": f"{_FUSED_ROWS} ({_RRF})",
    "weighted_fusion": f"{_FUSED_ROWS} ({_WEIGHTED})",
    "context_or_card": f"""SELECT f.query_id, f.doc_id, f.rank, coalesce(c.chunk_id::VARCHAR, f.doc_id || '_graph') AS chunk_id,
      CASE WHEN c.chunk_id IS NULL THEN '(graf) label ' || f.doc_id ELSE 'chunk ' || c.chunk_id END AS text,
      CASE WHEN c.chunk_id IS NULL THEN 'graph' ELSE 'method' END AS section
      FROM ({_RRF}) f LEFT JOIN (SELECT query_id, label::VARCHAR AS doc_id, arg_min(chunk_id, rank) AS chunk_id FROM ({_near(15)}) GROUP BY ALL) c
      ON c.query_id = f.query_id AND c.doc_id = f.doc_id WHERE f.rank <= 5""",
    "filtered_catalog": """SELECT arxiv_id, CAST(year AS INTEGER) AS year, authors FROM (
      SELECT o_custkey::VARCHAR AS arxiv_id, year(o_orderdate) AS year, o_orderpriority AS authors, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
      FROM orders WHERE year(o_orderdate) >= 1997 AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high'))) WHERE n = 1""",
    "year_filtered_list": """SELECT o_orderkey AS paper_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS section FROM orders
      WHERE year(o_orderdate) BETWEEN 1998 AND 1999 AND o_orderstatus = 'F'""",
    "graph_nodes": "ALIASES",
    "graph_edges": _EDGES,
    "graph_summary": f"""SELECT 'node' AS what, kind AS key, count(*) AS n FROM ({_NODES}) GROUP BY kind
      UNION ALL SELECT 'edge', relation, count(*) FROM ({_EDGES}) GROUP BY relation""",
    "author_papers": f"""SELECT src_id AS author_id, paper_id, title, year, 'author:' || src_id || ' — YAZDI — paper:' || paper_id AS path
      FROM ({_EDGES}) JOIN ({_PAPER_NODES}) ON paper_id = dst_id WHERE relation = 'YAZDI'""",
    "author_institution": f"SELECT src_id AS author_id, dst_id AS institution FROM ({_EDGES}) WHERE relation = 'ÇALIŞIYOR'",
    "papers_criticizing": f"""SELECT query, paper_id, title, year, method_id, 'paper:' || paper_id || ' — ELEŞTİRİYOR — method:' || method_id AS path FROM (
      SELECT query, e.src_id AS paper_id, m.id AS method_id, row_number() OVER (PARTITION BY query, e.src_id ORDER BY score DESC, f.seq, m.id) AS n
      FROM ({_METHOD_SCORES}) m JOIN ({_EDGES}) e ON e.dst_id = m.id AND e.relation = 'ELEŞTİRİYOR'
      JOIN (SELECT p_brand, min(l_orderkey) AS seq FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('N', 'R') GROUP BY p_brand) f ON f.p_brand = m.id
      WHERE score >= 0.85) JOIN ({_PAPER_NODES}) USING (paper_id) WHERE n = 1""",
    "coauthors": f"""SELECT a.src_id AS author_id, b.src_id AS coauthor_id, count(DISTINCT a.dst_id) AS n_papers,
      string_agg(DISTINCT a.dst_id, ',' ORDER BY a.dst_id) AS papers
      FROM ({_EDGES}) a JOIN ({_EDGES}) b ON a.dst_id = b.dst_id AND a.src_id <> b.src_id AND a.relation = 'YAZDI' AND b.relation = 'YAZDI' GROUP BY ALL""",
    "coauthor_paths": f"""SELECT DISTINCT a.src_id AS author_id, b.src_id AS coauthor_id, s_name AS name, a.dst_id AS paper_id,
        'author:' || a.src_id || ' — YAZDI — paper:' || a.dst_id || ' — YAZDI — author:' || b.src_id AS path
      FROM ({_EDGES}) a JOIN ({_EDGES}) b ON a.dst_id = b.dst_id AND a.src_id <> b.src_id AND a.relation = 'YAZDI' AND b.relation = 'YAZDI'
      JOIN supplier ON b.src_id = 'A' || s_suppkey WHERE a.src_id IN ('A3', 'A5', 'A999999999')""",
    "author_candidates": """WITH found AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS came FROM supplier),
      cited AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL),
      top AS (SELECT l_suppkey AS s_suppkey, string_agg('part ' || l_partkey, '|' ORDER BY nth) AS top_5_works FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, 'part ' || l_partkey) AS nth FROM cited) WHERE nth <= 5 GROUP BY l_suppkey)
      SELECT s_nationkey::VARCHAR AS query_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 DESC, s_suppkey % 7 DESC, came) - 1 AS pos,
        'A' || s_suppkey AS author_id, coalesce(top_5_works, '') AS top_5_works FROM found LEFT JOIN top USING (s_suppkey) WHERE came <= 5""",
    "multi_hop": f"""WITH w AS (SELECT src_id AS a, dst_id AS p FROM ({_EDGES}) WHERE relation = 'YAZDI'),
      others AS (SELECT DISTINCT y.a FROM w x JOIN w y ON x.p = y.p WHERE x.a = 'A7' AND y.a <> 'A7')
      SELECT DISTINCT 'A7' AS author_id, paper_id, year FROM w JOIN others USING (a) JOIN ({_PAPER_NODES}) ON paper_id = p
      WHERE p NOT IN (SELECT p FROM w WHERE a = 'A7')""",
    "graph_signal_ranking": f"""WITH e AS ({_EDGES}), papers AS ({_PAPER_NODES}),
      signals AS (
        SELECT 'author' AS query_id, dst_id AS doc_id, 100 AS points FROM e WHERE relation = 'YAZDI' AND src_id IN ({_AUTHORS_LIKE})
        UNION ALL SELECT q, src_id, CASE relation WHEN 'ELEŞTİRİYOR' THEN 50 ELSE 40 END FROM e, (VALUES ('method'), ('topic')) v(q)
          WHERE relation IN ('ELEŞTİRİYOR', 'ÖNERİYOR') AND dst_id IN ({_methods_like('Brand#13')})
        UNION ALL SELECT 'topic', src_id, 20 FROM e WHERE relation IN ('ELEŞTİRİYOR', 'ÖNERİYOR') AND dst_id IN ({_methods_like('brand#55')})
        UNION ALL SELECT 'year', paper_id, 5 FROM papers WHERE year >= 2001),
      bounds AS (SELECT * FROM (VALUES ('author', 1999), ('method', NULL), ('topic', 1998), ('year', 2001)) v(query_id, year_min))
      SELECT query_id, doc_id, CAST(sum(points) AS BIGINT) AS score, max(year) AS year FROM signals JOIN papers ON paper_id = doc_id JOIN bounds USING (query_id)
      WHERE year_min IS NULL OR year >= year_min GROUP BY ALL""",
    "name_match_tiered": f"SELECT query, p_name, {_tiered('lq', 'lp', 'slq', 'slp')} AS score FROM ({_PAIRS})",
    "token_sort_score": f"SELECT query, p_name, {_sort_score('sq', 'sp')} AS score FROM ({_PAIRS})",
    "token_set_score": f"""SELECT query, p_name, round(CASE WHEN s > 0 AND (dx = 0 OR dy = 0) THEN 100.0
      WHEN s = 0 THEN 100.0 - 100.0 * (dx + dy - 2 * common)::DOUBLE / (dx + dy)
      ELSE greatest(100.0 - 100.0 * (dx + dy - 2 * common)::DOUBLE / (2 * s + 2 * g + dx + dy), 100.0 - 100.0 * (g + dx)::DOUBLE / (2 * s + g + dx),
        100.0 - 100.0 * (g + dy)::DOUBLE / (2 * s + g + dy)) END / 100, 4)::DOUBLE AS score FROM ({_SET_SCORES})""",
    "entity_records": """SELECT 'P' || p_partkey AS arxiv_id, CASE WHEN p_partkey % 3 = 0 THEN 'part ' || p_partkey ELSE trim(p_name) END AS title,
        p_brand AS authors, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS methods_proposed, '' AS methods_criticized, p_type AS topics
      FROM part WHERE p_partkey % 7 <> 0""",
    "author_papers_or_note": """SELECT 'A' || a AS author_id, CASE WHEN p IS NULL THEN 'author:A' || a || ' — YOK — düğüm yok'
        ELSE 'author:A' || a || ' — YAZDI — paper:P' || p END AS path
      FROM (VALUES (3), (5), (999999999)) v(a) LEFT JOIN (SELECT DISTINCT l_suppkey AS s, l_orderkey AS p FROM lineitem) ON s = a""",
    "cost_savings": """WITH c AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'embedding' ELSE 'language model' END AS kind,
        100.0 * (user_id % 50) AS i, 10.0 * (user_id % 7) AS o, event_id % 3 = 0 AS hit, event_id % 4 = 0 AS e FROM events),
      d AS (SELECT kind, hit, CASE WHEN e THEN i * 0.02 / 1e6 ELSE (i * 0.15 + o * 0.6) / 1e6 END AS usd FROM c)
      SELECT coalesce(kind, 'total') AS kind, round(sum(usd), 6) AS cost_no_cache, round(sum(CASE WHEN hit THEN 0 ELSE usd END), 6) AS cost,
        round(sum(CASE WHEN hit THEN usd ELSE 0 END), 6) AS savings FROM d GROUP BY ROLLUP (kind)""",
    "status_counts": """SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type""",
    "unique_names": """SELECT name_key, arg_min(name, seq) AS name, min(seq) AS seq FROM (
      SELECT p_partkey AS seq, p_name AS name_key,
        CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '   ') ELSE p_name END AS name FROM part) GROUP BY name_key""",
    "resolve_entities": "RESOLVE",
    "merge_pieces": """SELECT doc_id, i AS at, array_to_string(list_slice(p, i * n // 3 + 1, (i + 1) * n // 3), chr(10) || chr(10)) AS text
      FROM (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n FROM documents), range(3) r(i) WHERE n > 3
      UNION ALL SELECT doc_id, i, p[i + 1] FROM (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n FROM documents), range(3) r(i)
      WHERE n <= 3 AND i < n""",
    "section_buckets": f"""WITH RECURSIVE c AS ({_CLASSED}), walk AS (
      {_step('NULL::VARCHAR', 'false', 'c WHERE c.pos = 0')}
      UNION ALL {_step('w.last', 'w.seen', 'c JOIN walk w ON c.user_id = w.user_id AND c.pos = w.pos + 1')})
      SELECT user_id, pos, head, section FROM walk""",
    "tei_papers": """WITH d AS (SELECT *, upper(coalesce(lang, 'xx')) || ' of ' || coalesce(source, 'nowhere') AS person,
        CASE doc_id % 10 WHEN 0 THEN 'broken' WHEN 7 THEN 'empty' WHEN 5 THEN 'no header' ELSE 'ok' END AS status FROM documents)
      SELECT 'P' || doc_id AS arxiv_id, status, CASE WHEN status = 'ok' THEN 'Paper ' || doc_id || ' & more' END AS title,
        CASE WHEN status = 'ok' THEN person || '|Lab ' || doc_id % 7 END AS authors, CASE WHEN status = 'ok' THEN 'About ' || coalesce(n_chars, 0) || ' characters.' END AS abstract,
        CASE WHEN status = 'ok' THEN 'First ' || doc_id || '.' || chr(10) || chr(10) || 'Second.' END AS introduction,
        CASE WHEN status = 'ok' THEN 'How ' || doc_id || chr(10) || chr(10) || 'of it' || chr(10) || chr(10) || 'Headless.' END AS method,
        CASE WHEN status = 'ok' THEN 'Related Work' END AS unmapped,
        CASE WHEN status = 'ok' THEN 'b0|Main ' || doc_id % 5 || '|' || person || '|' || 2000 + doc_id % 20 || '|raw ' || doc_id ELSE '' END AS reference,
        CASE WHEN status = 'ok' THEN 'in press' END AS second_year FROM d""",
    "html_extract": r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
      trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style).*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
    "paper_blob": """WITH t AS (SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS authors,
        trim(coalesce(string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn), '')) AS s,
        trim(coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), '')) AS u,
        trim(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn), '')) AS a FROM conversations GROUP BY conv_id)
      SELECT conv_id, 'Title: (none)' || chr(10) || chr(10) || 'Authors: ' || authors
        || CASE WHEN s = '' THEN '' ELSE chr(10) || chr(10) || 'system:' || chr(10) || CASE WHEN length(s) > 2500 THEN rtrim(s[1:2500]) || chr(10) || '[...truncated]' ELSE s END END
        || CASE WHEN u = '' THEN '' ELSE chr(10) || chr(10) || 'user:' || chr(10) || CASE WHEN length(u) > 2500 THEN rtrim(u[1:2500]) || chr(10) || '[...truncated]' ELSE u END END
        || CASE WHEN a = '' THEN '' ELSE chr(10) || chr(10) || 'assistant:' || chr(10) || CASE WHEN length(a) > 2500 THEN rtrim(a[1:2500]) || chr(10) || '[...truncated]' ELSE a END END AS blob FROM t""",
    "json_extract": """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
    "jsonl_tolerant": """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 15 NOT IN (0, 5, 10) GROUP BY 1""",
    "cache_probe": """SELECT doc_id AS chunk_id, sha256('m' || chr(10) || text) AS cache_key, text IN (SELECT text FROM documents WHERE lang = 'en') AS hit FROM documents""",
    "upsert_chunks": """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'rewritten' ELSE source END AS source, CASE WHEN lang = 'fr' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents
      UNION ALL SELECT -doc_id - 1, 'new', n_chars FROM documents WHERE lang = 'fr'""",
    "cost_report": """WITH calls AS (SELECT CASE WHEN lang = 'es' OR lang IS NULL THEN 'unknown' ELSE lang END AS stage, doc_id <> min(doc_id) OVER (PARTITION BY text) AS hit,
        CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS i, 7 AS o FROM documents),
      priced AS (SELECT *, (i * 0.15::DOUBLE + o * 0.6::DOUBLE) / 1e6 AS full_cost FROM calls)
      SELECT coalesce(stage, 'TOTAL') AS stage, CAST(grouping(stage) AS INTEGER) AS is_total, count(*) AS calls, CAST(sum(i + o) AS BIGINT) AS tokens,
        round(sum(CASE WHEN hit THEN 0.0::DOUBLE ELSE round(full_cost, 8) END), 8) AS cost, round(sum(full_cost), 8) AS cost_no_cache,
        count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(100.0::DOUBLE * count(*) FILTER (WHERE hit) / count(*), 4) AS hit_ratio,
        round(sum(full_cost) - sum(CASE WHEN hit THEN 0.0::DOUBLE ELSE round(full_cost, 8) END), 8) AS savings FROM priced GROUP BY ROLLUP (stage)""",
    "recall_at_k": f"""WITH near AS (SELECT query_id, label, min(rank) AS rank FROM ({_near(10)}) GROUP BY ALL),
      gold AS (SELECT query_id, unnest([mine, (mine + 1) % 10]) AS label FROM ({_QUESTIONS}) WHERE mine % 2 = 0)
      SELECT q.query_id, r.a AS recall_at_5, r.b AS recall_at_10 FROM ({_QUESTIONS}) q LEFT JOIN (
        SELECT g.query_id, avg(CASE WHEN n.rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN n.rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS b
        FROM gold g LEFT JOIN near n ON n.query_id = g.query_id AND n.label = g.label GROUP BY g.query_id) r ON r.query_id = q.query_id""",
}

ORACLE_SQL["merged_chunks"] = ORACLE_SQL["upsert_chunks"]

ORACLE_SQL["ranked_signals"] = f"""SELECT query_id, doc_id, score, year, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, year DESC NULLS LAST, doc_id) AS rank FROM ({ORACLE_SQL["graph_signal_ranking"]})) WHERE rank <= 20"""


def _stage_recall(stage: str, hits: str) -> str:
    """Recall of a stage: gold is the question's own chunk, its label and the next."""
    return f"""SELECT '{stage}' AS stage, query_id, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS b
      FROM (SELECT query_id, mine AS label, false AS chunk FROM ({_QUESTIONS}) UNION ALL SELECT query_id, (mine + 1) % 10, false FROM ({_QUESTIONS})
        UNION ALL SELECT query_id, NULL, true FROM ({_QUESTIONS})) g
      LEFT JOIN (SELECT query_id, label, min(rank) AS rank FROM ({hits}) GROUP BY ALL) h USING (query_id, label) GROUP BY query_id"""


ORACLE_SQL["evaluation_summary"] = f"""WITH recalls AS ({_stage_recall('naive', _near(10))} UNION ALL {_stage_recall('grobid', _near(10, 'label BETWEEN 2 AND 5'))}
    UNION ALL {_stage_recall('hybrid', f"SELECT query_id, doc_id::INTEGER AS label, rank FROM ({_RRF}) WHERE rank <= 10")}),
  scores AS (SELECT avg(CASE WHEN query_id % 3 < 2 THEN (mine % 5) / 4.0::DOUBLE ELSE 0 END) AS s FROM ({_QUESTIONS}))
  SELECT stage, printf('%.4f', avg(a)) AS recall_at_5, printf('%.4f', avg(b)) AS recall_at_10, CASE WHEN stage = 'grobid' THEN 'n/a' ELSE printf('%.4f', any_value(s)) END AS faithfulness,
    CASE WHEN stage = 'naive' THEN printf('%.4f', any_value(s)) ELSE 'n/a' END AS relevance, true AS timed FROM recalls, scores GROUP BY stage"""

ORACLE_SQL["graph_nodes"] = f"""SELECT kind, id, name, aliases, institution, title, year FROM (
  SELECT kind, id, name, CASE WHEN kind = 'author' THEN aliases END AS aliases, institution, title, year FROM ({_NODES}))"""

ORACLE_SQL["resolve_entities"] = """WITH p AS (SELECT p_name, min(p_partkey) AS first, string_split(p_name, ' ') AS w FROM part GROUP BY p_name),
  c AS (SELECT *, CASE WHEN first % 3 = 0 THEN round(2.0::DOUBLE * length(w[1]) / (length(p_name) + length(w[1])), 4) ELSE 1.0::DOUBLE END AS s,
    CASE WHEN first % 3 = 0 THEN w[1] ELSE w[2] || ' ' || w[1] END AS display FROM p),
  d AS (SELECT *, round(least(1.0, s + 0.05), 4) AS confidence FROM c)
  SELECT p_name AS query_name, 'A' || first AS author_id, confidence,
    array_to_string(list_sort([w[1][1] || '. ' || w[2], w[1] || ' ' || w[2][1] || '.', w[2] || ', ' || w[1], display]), '|') AS aliases,
    CASE WHEN confidence < 0.7 THEN 'confidence < 0.7' ELSE 'mapped' END AS status FROM d"""


def _decided(pool: str) -> str:
    """The first of each name's pool, with its confidence and status."""
    return f"""SELECT k, x AS author, CASE WHEN conf < 0.7 THEN 'confidence < 0.7' WHEN NOT hard AND conf - second < 0.05 THEN 'homonym_no_paper_evidence' ELSE 'mapped' END AS status, conf
      FROM (SELECT *, row_number() OVER w AS nth, lead(conf) OVER w AS second FROM (
        SELECT *, CASE WHEN place THEN least(1.0, raised + 0.05) ELSE raised END AS conf FROM (
          SELECT *, greatest(base, CASE WHEN byline THEN 0.92 ELSE 0 END, CASE WHEN title THEN 0.8 ELSE 0 END, CASE WHEN joint THEN 0.85 ELSE 0 END)::DOUBLE AS raised,
            byline OR title OR joint AS hard FROM ({pool})))
        WINDOW w AS (PARTITION BY k ORDER BY hard DESC, conf DESC, place DESC, pos)) WHERE nth = 1"""


def _one_by_one(n: int) -> str:
    """The names of a paper, judged in their order: each may find joint works with the first two resolved before it."""
    parts = ["done0 AS (SELECT 0 AS k, 0 AS author, '' AS status, 0.0::DOUBLE AS conf WHERE false)"]
    for i in range(n):
        parts += [
            f"""probed{i} AS (SELECT c.k, o.author, row_number() OVER (PARTITION BY c.k ORDER BY o.k) AS nth
              FROM c JOIN done{i} o ON o.status = 'mapped' AND o.k // 4 = c.p WHERE c.k % 4 = {i})""",
            f"""pool{i} AS (SELECT * REPLACE (joint OR (NOT byline AND EXISTS (FROM probed{i} o JOIN pairs ON (a = pool.x AND b = o.author) OR (b = pool.x AND a = o.author)
              WHERE o.k = pool.k AND nth <= 2)) AS joint) FROM pool WHERE k % 4 = {i})""",
            f"done{i + 1} AS (FROM done{i} UNION ALL ({_decided(f'FROM pool{i}')}))",
        ]
    return ",\n  ".join(parts)


ORACLE_SQL["resolve_by_evidence"] = f"""WITH c AS (SELECT DISTINCT c_custkey AS k, c_custkey // 4 AS p FROM customer),
  pool AS (SELECT k, p, pos, 2 * k + pos AS x, k % 5 = 0 AND pos = 1 AS byline, k % 5 = 1 AND pos = 1 AS title,
      EXISTS (FROM c o WHERE o.k = xor(c.k, 1)) AND CASE WHEN pos = 1 THEN k % 5 = 2 ELSE xor(k, 1) % 5 = 2 END AS joint,
      pos = 0 AND k % 5 >= 3 AND EXISTS (FROM c o WHERE o.p = c.p AND o.k <> c.k AND o.k % 5 >= 3) AS place,
      CASE WHEN pos = 0 THEN 0.8571 WHEN k % 5 = 0 THEN 0.6667 WHEN k % 5 = 1 THEN 0.7692 ELSE 0.8148 END AS base
    FROM c, (VALUES (0), (1)) v(pos)),
  pairs AS (SELECT 2 * k + 1 AS a, 2 * xor(k, 1) AS b FROM c WHERE k % 7 = 0),
  {_one_by_one(4)}
  SELECT left(md5('n' || k), 16) AS query_name, 'A' || author AS author_id, round(conf, 4) AS confidence, status FROM done4"""

"""SQL for the queries that SQL can express."""

from __future__ import annotations

import public_tokenizers

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ROWS = "docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"


def _words(text: str, separator: str) -> str:
    return f"list_filter(string_split_regex({_LOWER.format(text)}, '{separator}'), lambda x: x <> '')"


_ENGLISH = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def _matches(kind: str, pattern: str, order: int, source: str) -> str:
    """(h, ord, kind, start, stop, value) of all matches of a pattern: each ends after the gaps and matches up to it."""
    return f"""SELECT h, {order} AS ord, '{kind}' AS kind, stop - length(value) AS start, stop, value FROM (
        SELECT h, value, sum(length(gap) + length(value)) OVER (PARTITION BY h ORDER BY i) AS stop FROM (
            SELECT h, unnest(found) AS value, unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i
            FROM (SELECT h, regexp_extract_all(text, '{pattern}') AS found, string_split_regex(text, '{pattern}') AS gaps FROM {source})))"""


_SPACE = r"\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: public_tokenizers.PATTERN without its look-ahead, for texts that are cut where it would end a run of white space
_PIECE = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+"
_CUT = "chr(57344)"


def _bpe(source: str) -> str:
    """CTEs over rows (r, part, text): ``encoded`` (r, part, seg, i, ids), the ids of each piece, by contracting its leftmost pair of least rank until none is left."""
    return f"""ranks AS (SELECT hex(from_base64(token)) AS h, rank FROM read_csv('{public_tokenizers.path("byte_bpe_50k.tiktoken")}', delim=' ', header=false, quote='', escape='', columns={{'token': 'VARCHAR', 'rank': 'INTEGER'}})),
        merges AS (SELECT a.rank AS a, b.rank AS b, t.rank AS rank FROM (SELECT h, rank, unnest(range(2, length(h), 2)) AS pos FROM ranks) t JOIN ranks a ON a.h = t.h[:t.pos] JOIN ranks b ON b.h = t.h[t.pos + 1:]),
        segments AS (SELECT r, part, unnest(s) AS text, generate_subscripts(s, 1) AS seg FROM (
            SELECT r, part, string_split(regexp_replace(text, '([{_SPACE}]+)([{_SPACE}])([^{_SPACE}])', '\\1' || {_CUT} || '\\2\\3', 'g'), {_CUT}) AS s FROM {source})),
        pieces AS (SELECT r, part, seg, hex(unnest(p)) AS h, generate_subscripts(p, 1) AS i FROM (SELECT r, part, seg, regexp_extract_all(text, '{_PIECE}') AS p FROM segments)),
        kinds AS (SELECT DISTINCT h FROM pieces),
        singles AS (SELECT k.h, list(rank ORDER BY pos) AS ids FROM (SELECT h, unnest(range(1, length(h), 2)) AS pos FROM kinds WHERE h NOT IN (SELECT h FROM ranks)) k JOIN ranks r ON r.h = k.h[k.pos:k.pos + 1] GROUP BY k.h),
        steps(round, h, ids) AS (
            SELECT 0, h, ids FROM singles
            UNION ALL
            SELECT round + 1, s.h, ids[:pos - 1] || [best.rank] || ids[pos + 2:] FROM steps s JOIN (
                SELECT h, min(pair)['rank'] AS rank, min(pair)['pos'] AS pos FROM (SELECT p.h, {{'rank': m.rank, 'pos': p.pos}} AS pair FROM (
                    SELECT h, unnest(ids[:-2]) AS x, unnest(ids[2:]) AS y, generate_subscripts(ids[2:], 1) AS pos FROM steps) p JOIN merges m ON m.a = p.x AND m.b = p.y) GROUP BY h) best USING (h)),
        known AS (SELECT h, arg_max(ids, round) AS ids FROM steps GROUP BY h UNION ALL SELECT h, [rank] FROM ranks WHERE h IN (SELECT h FROM kinds)),
        encoded AS (SELECT r, part, seg, i, ids FROM pieces JOIN known USING (h))"""


_CRC = "xor(list_reduce(list_transform(range(0, length(c) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(c[i]) END), lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"


def _near(words: int, tail: str) -> str:
    """Documents linked where their shingles of ``words`` words have a similarity of 0.8, and all that they reach."""
    return f"""
        WITH RECURSIVE {_ROWS},
        words AS (SELECT r, doc_id, {_words('text', '[ \\t\\n\\v\\f\\r]+')} AS w FROM docs),
        sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) END AS s FROM words),
        sizes AS (SELECT r, doc_id, len(s) AS n FROM sets),
        each AS (SELECT r, hash(unnest(s)) AS g FROM sets),
        common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM each a JOIN each b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
        pairs AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT r AS a, r AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        {tail} FROM sizes s JOIN reach ON reach.a = s.r JOIN sizes t ON t.r = reach.b GROUP BY s.r, s.doc_id"""


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"

ORACLES = {
    "op2_pii": f"""
        WITH {_ROWS}, once AS (SELECT row_number() OVER () AS h, text FROM (SELECT DISTINCT text FROM docs)),
        matches AS ({' UNION ALL '.join(_matches(kind, pattern, i, 'once') for i, (kind, pattern) in enumerate(_PERSONAL.items()))}),
        digits AS (SELECT *, {_DIGITS} AS d FROM matches),
        base AS (SELECT *, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN d ELSE lower(value) END AS entity FROM digits WHERE CASE kind
            WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0
            WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[-i] AS INTEGER) WHEN d[-i] > '4' THEN 2 * CAST(d[-i] AS INTEGER) - 9 ELSE 2 * CAST(d[-i] AS INTEGER) END)) % 10 = 0
            WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 ELSE true END),
        held AS (SELECT DISTINCT h, entity FROM base),
        n_entity AS (SELECT entity, count(*) AS n_e FROM held GROUP BY 1),
        terms AS (SELECT h, unnest(list_distinct(regexp_extract_all(text, '{_TERM}'))) AS term FROM once),
        n_term AS (SELECT term, count(*) AS n_t FROM terms WHERE length(term) >= 3 AND regexp_matches(term, '[^0-9]') GROUP BY 1),
        both_ AS (SELECT entity, term, count(*) AS n_b FROM held JOIN terms USING (h) JOIN n_term USING (term) GROUP BY 1, 2),
        reveal AS (SELECT entity, term FROM both_ JOIN n_entity USING (entity) JOIN n_term USING (term) WHERE n_b / n_t >= 0.6 AND (SELECT count(*) FROM once) * n_b / (n_e * n_t) > 1),
        marked AS (SELECT DISTINCT h, term FROM held JOIN reveal USING (entity) JOIN terms USING (h, term)),
        places AS ({_matches('term', _TERM, len(_PERSONAL), '(SELECT * FROM once SEMI JOIN held USING (h))')}),
        added AS (SELECT p.* FROM places p JOIN marked ON marked.h = p.h AND marked.term = p.value WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.h = p.h AND b.start < p.stop AND p.start < b.stop)),
        spans AS (SELECT h, ord, kind, start, stop FROM base UNION ALL SELECT h, ord, kind, start, stop FROM added),
        told AS (SELECT h, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (kind <> 'term'), '') AS base,
            {', '.join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _PERSONAL)} FROM spans GROUP BY h)
        SELECT doc_id, {', '.join(f'coalesce(n_{kind}, 0) AS n_{kind}' for kind in _PERSONAL)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs JOIN once USING (text) LEFT JOIN told USING (h)""",
    "op3_vp_search": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        near AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM near QUALIFY rank <= 10""",
    "op4_ngram_join": _near(5, "SELECT s.doc_id, any_value(s.n) AS n_shingles, min(t.doc_id) AS component_id"),
    "op5_line_dedup": f"""
        WITH {_ROWS},
        lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
        keyed AS (SELECT *, {_LOWER.format(f'trim(line, {_WHITE})')} AS key FROM lines),
        repeated AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
        marked AS (SELECT *, key IN (SELECT key FROM repeated) AS gone FROM keyed)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY r, doc_id""",
    "op7_byte_bpe": f"""
        WITH RECURSIVE {_ROWS}, {_bpe("(SELECT r, 0 AS part, text FROM docs)")},
        told AS (SELECT e.r, e.seg, e.i, t.pos, t.token, h FROM encoded e, LATERAL (SELECT unnest(ids) AS token, generate_subscripts(ids, 1) AS pos) t JOIN ranks ON rank = t.token),
        whole AS (SELECT r, count(*) AS n, string_agg(token, ' ' ORDER BY seg, i, pos) AS ids, string_agg(h, '' ORDER BY seg, i, pos) AS h FROM told GROUP BY r)
        SELECT doc_id, coalesce(n, 0) AS n_tokens, sha256(coalesce(ids, '')) AS ids_sha256, sha256(unhex(coalesce(h, ''))) AS decoded_sha256 FROM docs LEFT JOIN whole USING (r)""",
    "op8_token_counts": f"""
        WITH RECURSIVE {_ROWS}, {_bpe("(SELECT r, unnest(s) AS text, generate_subscripts(s, 1) AS part FROM (SELECT r, string_split(text, '<|endoftext|>') AS s FROM docs))")},
        counts AS (SELECT r, sum(len(ids)) AS n FROM encoded GROUP BY r)
        SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) + len(string_split(text, '<|endoftext|>')) - 1 AS BIGINT) AS n_tokens,
            coalesce(n, 0) + len(string_split(text, '<|endoftext|>')) - 1 > 512 AS over_limit FROM docs LEFT JOIN counts USING (r)""",
    "op10_decontaminate": f"""
        WITH {_ROWS},
        d AS (SELECT r, doc_id, {_words('text', _ENGLISH)} AS w FROM docs),
        b AS (SELECT item_id, {_words('text', _ENGLISH)} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, g)),
        covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op11_conversation_trie": f"""
        WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS c FROM turns)),
        rebuilt AS (SELECT c.conv_id, rank, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND rank <= h
            UNION ALL SELECT c.conv_id, rank, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND rank > h),
        numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY rank) AS d, length(text) AS n, sha256(length(role) || ':' || role || text) AS g FROM rebuilt),
        prefixes AS (SELECT conv_id, d, n, array_to_string(list(g) OVER (PARTITION BY conv_id ORDER BY d), '') AS path FROM numbered UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        lengths AS (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY 1),
        ends AS (SELECT path, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM prefixes SEMI JOIN lengths USING (conv_id, d) GROUP BY 1),
        nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM prefixes GROUP BY ALL),
        kids AS (SELECT path[:-65] AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
        valued AS (SELECT nodes.*, coalesce(k, 0) AS k, coalesce(ids, '') AS ids FROM nodes LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)),
        -- a node's ancestors are the prefixes of its smallest member
        sums AS (SELECT p.path, count(*) FILTER (v.k = 0) AS n_leaves, sum((v.n_convs - 1) * v.n) AS saved FROM valued v JOIN prefixes p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY 1)
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.k AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
        FROM valued v JOIN sums USING (path) LEFT JOIN nodes up ON v.d > 0 AND up.path = v.path[:-65]""",
    "op12_set_sketch": _near(4, "SELECT s.doc_id, any_value(s.n) AS n_shingles, min(t.doc_id) AS component_id, s.doc_id = min(t.doc_id) AS kept"),
}

"""SQL of the corpus queries that SQL can say, written apart from the operators; components by plain reachability."""

from __future__ import annotations

from touchline.llm.secrets import BASE, EXAMPLE_OWNERS, LIVE_CHARACTERS, OWNED

OP3 = """WITH RECURSIVE e AS MATERIALIZED (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) > 0),
  l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
  r(x, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.c = l.x)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings
  JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = vec_id
  LEFT JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) k ON k.x = vec_id"""


def _kind(rank: int, name: str, pattern: str, group: int, least: int) -> str:
    """Matches of one kind with their places, from the lengths of what lies between them."""
    p = "'" + pattern.replace("'", "''") + "'"
    size = "list_transform({}, lambda x: length(x))".format
    return f"""SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, value, start, start + length(hits[i]) AS stop FROM (
        SELECT *, values_[i] AS value, list_sum({size('gaps[1:i]')}) + coalesce(list_sum({size('hits[1:i - 1]')}), 0) AS start FROM (
          SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT doc_id, source, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS values_,
              string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})))) WHERE length(value) >= {least}"""


OP4 = f"""WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  found AS MATERIALIZED ({' UNION ALL '.join(_kind(i, *kind) for i, kind in enumerate(BASE + OWNED))}),
  owned AS (SELECT value, count(DISTINCT source) < {EXAMPLE_OWNERS}
      AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS live FROM found GROUP BY value),
  spans AS (SELECT * FROM found JOIN owned USING (value) WHERE rank < {len(BASE)} OR live),
  told AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in BASE)},
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
      count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, *_ in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN told USING (doc_id)"""

OP5 = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
      SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  b AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
  l AS MATERIALIZED (SELECT x, y FROM b JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
  r(x, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.c = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents
  JOIN (SELECT x, min(c) AS c FROM r GROUP BY x) m ON m.x = doc_id LEFT JOIN n USING (doc_id)"""

OP12 = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
  o AS MATERIALIZED (SELECT lang, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, unnest(list_concat(w[3:], [NULL, NULL])[1:len(w)]) AS c
    FROM w WHERE len(w) > 0),
  f AS MATERIALIZED (SELECT lang, a AS p, count(*) AS f FROM o GROUP BY ALL
    UNION ALL SELECT lang, a || ' ' || b, count(*) FROM o WHERE b IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, a || ' ' || b || ' ' || c, count(*) FROM o WHERE c IS NOT NULL GROUP BY ALL),
  t AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
  c AS MATERIALIZED (SELECT lang, p, f, string_split(p, ' ') AS w FROM f WHERE f >= 10 AND contains(p, ' ')),
  longer AS MATERIALIZED (SELECT lang, p, max(f) AS most FROM (
    SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p, f FROM c WHERE len(w) = 3) GROUP BY ALL),
  kept AS MATERIALIZED (SELECT c.* FROM c LEFT JOIN longer USING (lang, p) WHERE coalesce(100 * most < 50 * f, true)),
  parts AS MATERIALIZED (SELECT lang, p, f, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM kept
    UNION ALL SELECT lang, p, f, 2, w[1] || ' ' || w[2], w[3] FROM kept WHERE len(w) = 3),
  cut AS (SELECT parts.lang, parts.p, parts.f AS a, cut, x.f AS l, y.f AS r,
      (1000000::HUGEINT * parts.f * parts.f) // (x.f::HUGEINT * y.f) AS score
    FROM parts JOIN f x ON x.lang = parts.lang AND x.p = parts.x JOIN f y ON y.lang = parts.lang AND y.p = parts.y),
  best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
  ranked AS (SELECT *, p AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000"""

#: Cheapest edits row by row: for each place in the pattern the least (cost, audit), with the text that it gives.
_PLACES = "[0, 1, 2, 3]"
_WAY = "struct_pack(c := s.c + {c}, a := s.a || '{a}', t := s.t || {t}, q := {q})"
#: Insertions: (from, to, edits, rows).
_INSERTED = ((0, 2, "u"), (0, 3, "ua"), (1, 2, "u"), (1, 3, "ua"), (2, 3, "a"), (3, 2, "u"))


def _lines(initials: str) -> str:
    return "".join({"u": "user:", "a": "assistant:"}[i] + chr(10) for i in initials)


_NEXT = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
_CASE = "CASE WHEN {test} THEN {way} END"


def _ways(pairs) -> str:
    return ", ".join(_CASE.format(test=test, way=way) for test, way in pairs)


_INSERT = _ways(
    [("true", "s")] + [(f"s.q = {p}", _WAY.format(c=5 * len(i), a="I" * len(i), t="'" + _lines(i) + "'", q=q)) for p, q, i in _INSERTED])
_EDIT = _ways(
    [("true", _WAY.format(c=2, a="D", t="''", q="s.q"))]
    + [(f"s.q = {p} AND NOT x.gone AND x.initial = '{i}'", _WAY.format(c="x.extra", a="K", t="x.line", q=q)) for p, i, q in _NEXT]
    + [(f"s.q = {p} AND NOT x.gone", _WAY.format(c="x.extra + 1", a="R", t="'{}:' || x.text || chr(10)".format(
        {"u": "user", "a": "assistant"}[i]), q=q)) for p, i, q in _NEXT if i != "s"])
_LEAST = (f"list_filter(list_transform({_PLACES}, lambda q: list_min(list_filter({{}}, lambda w: w IS NOT NULL AND w.q = q))), "
          "lambda w: w IS NOT NULL)")


def _after(states: str, ways: str) -> str:
    return _LEAST.format(f"flatten(list_transform({states}, lambda s: [{ways}]))")


#: crc32 bit by bit: the polynomial's reflected form is a fixed value.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)),
  lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""

OP13 = f"""WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  h AS MATERIALIZED (SELECT *, {_CRC} % 20 AS h FROM o),
  d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
      CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE h <> 0),
  n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
  j AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, left(role, 1) AS initial,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS former, regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS said,
      regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS ended FROM n),
  f AS MATERIALIZED (SELECT *, NOT said OR again AS gone, CASE WHEN ended THEN 0 ELSE 5 END AS extra, role || ':' || text || chr(10) AS line FROM j),
  g AS MATERIALIZED (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (NOT said) AS blank,
      count(*) FILTER (said AND again) AS duplicate, count(*) FILTER (said AND NOT again AND NOT ended) AS truncated,
      count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal,
      list(struct_pack(gone, extra, initial, text, line) ORDER BY pos) AS xs FROM f GROUP BY conv_id),
  r AS (WITH RECURSIVE w(conv_id, k, st) AS (SELECT conv_id, 0, [struct_pack(c := 0, a := '', t := '', q := 0)] FROM g
    UNION ALL SELECT w.conv_id, k + 1, {_after(_after('st', _INSERT), _EDIT)}
      FROM (SELECT w.*, g.xs[w.k + 1] AS x FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.k < len(g.xs)) w)
    SELECT * FROM w),
  e AS (SELECT g.*, list_min(list_filter({_after('st', _INSERT)}, lambda s: s.q IN (0, 3))) AS best
    FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = len(g.xs))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(best.t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id"""

ORACLE = {"op3_cosine_links": OP3, "op4_owned_secrets": OP4, "op5_near_duplicates": OP5, "op12_collocations": OP12, "op13_repair_conversations": OP13}

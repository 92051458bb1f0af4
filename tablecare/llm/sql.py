"""DuckDB SQL of the queries that SQL can express."""

#: Windows of 50 words, the smallest id of each, and the words under those that a smaller id has.
SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  s AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50 AND doc_id IS NOT NULL),
  k AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM s),
  m AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key),
  r AS (SELECT k.rid, k.i FROM k JOIN m ON k.key = m.key AND m.least < k.doc_id),
  w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
  c AS (SELECT w.rid, w.pos, w.word, max(r.i) OVER (PARTITION BY w.rid ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS near
        FROM w LEFT JOIN r ON w.rid = r.rid AND w.pos = r.i),
  t AS (SELECT rid, count(near) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE near IS NULL) AS kept FROM c GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.rid = t.rid"""


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every part against every entry, round by round; products of whole numbers below 2**53 are exact in doubles."""
    ctes = [f"""v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rid, vec_id, label, [floor(CAST(x AS DOUBLE) * {scale}) FOR x IN embedding] AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
            f"""p AS (SELECT rid, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part))""",
            f"b0 AS (SELECT part, rid AS e, x AS c FROM p WHERE rid < {entries})"]
    def distance(i):
        return f"""a{i} AS (SELECT rid, part, x, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS m
      FROM p JOIN b{i} USING (part) GROUP BY rid, part, x)"""
    for i in range(rounds):
        ctes += [distance(i),
                 f"u{i} AS (SELECT part, m.e AS e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{i})",
                 f"s{i} AS (SELECT part, e, j, floor(sum(CAST(y AS BIGINT)) / count(*)) AS y FROM u{i} GROUP BY part, e, j)",
                 f"l{i} AS (SELECT part, e, list(y ORDER BY j) AS c FROM s{i} GROUP BY part, e)",
                 f"b{i + 1} AS (SELECT part, e, coalesce(l{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN l{i} USING (part, e))"]
    ctes += [distance(rounds), f"""r AS (SELECT rid, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)""",
             f"""h AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(y AS BIGINT) AS VARCHAR) FOR y IN c], ','), ',' ORDER BY part, e)) AS h FROM b{rounds})"""]
    return "WITH " + ",\n  ".join(ctes) + """
SELECT v.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256
FROM v JOIN r USING (rid), h"""

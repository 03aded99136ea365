"""SQL counterparts of the queries that SQL can express, for DuckDB on whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM k
"""


def quality(common: dict[str, list[str]], limits: dict[str, float]) -> str:
    """The quality rules with their word lists and limits."""
    lists = ", ".join("('%s', [%s])" % (lang, ", ".join(f"'{w}'" for w in words)) for lang, words in common.items())
    js = """sqrt(greatest(0, least(1, list_sum(list_transform(list_zip({p}, {q}), lambda z:
      (CASE WHEN z[1] > 0 THEN z[1] / list_sum({p}) * log2(z[1] / list_sum({p}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) ELSE 0 END
     + CASE WHEN z[2] > 0 THEN z[2] / list_sum({q}) * log2(z[2] / list_sum({q}) / ((z[1] / list_sum({p}) + z[2] / list_sum({q})) / 2)) ELSE 0 END) / 2)))))"""
    removed = lambda cls: f"length(t) - length(regexp_replace(t, '{cls}', '', 'g'))"
    return f"""
WITH langs(lang, listed) AS (VALUES {lists}),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x != '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
again AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM grams WHERE k > 1) GROUP BY 1),
f AS (SELECT w.doc_id, w.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(t) AS n_chars,
  {removed("[#*$%&|<>]")} AS symbol, len(ls) - len(list_distinct(ls)) AS dup, coalesce(again.n, 0) AS rep,
  {removed("[A-Z]")} AS upper, {removed("[^\\x00-\\x7F]")} AS other, {removed("[0-9]")} AS digit,
  {removed("[!\\x22\\x27()+,\\-./:;=?@\\[\\\\\\]^_`{}~]")} AS punct,
  list_transform(listed, lambda c: len(list_filter(w, lambda x: x = c))) AS counts
  FROM w LEFT JOIN again USING (doc_id) LEFT JOIN langs ON w.lang = langs.lang),
h AS (SELECT *, [n_chars - upper - other - digit - (n_chars - word_chars) - symbol - punct, upper, other, digit, n_chars - word_chars, symbol, punct]::DOUBLE[] AS c,
  list_append(counts, n_words - list_sum(counts))::DOUBLE[] AS m FROM f),
rc AS (SELECT lang, list(s ORDER BY i) AS c FROM (SELECT lang, i, sum(c[i]) AS s FROM (SELECT lang, c, unnest(generate_series(1, len(c))) AS i FROM h WHERE m IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
rm AS (SELECT lang, list(s ORDER BY i) AS m FROM (SELECT lang, i, sum(m[i]) AS s FROM (SELECT lang, m, unnest(generate_series(1, len(m))) AS i FROM h WHERE m IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT h.*, CASE WHEN n_chars >= {limits["chars"]} AND list_sum(h.c) > 0 THEN {js.format(p="h.c", q="rc.c")} END AS dc,
  CASE WHEN n_words >= {limits["words"]} AND list_sum(h.m) > 0 THEN {js.format(p="h.m", q="rm.m")} END AS dm FROM h LEFT JOIN rc USING (lang) LEFT JOIN rm USING (lang)),
b AS (SELECT *, n_words < {limits["min_words"]} OR 100 * rep > {limits["repeat"]} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, symbol::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(dc, 0) <= {limits["class"]} AND coalesce(dm, 0) <= {limits["common"]} AS kept
FROM b"""

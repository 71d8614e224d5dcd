"""DuckDB SQL of the queries that SQL can express."""

from logspark.llm.quality import STOP_FORMS

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_STOP = ", ".join("'" + w + "'" for w in STOP_FORMS)

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, {_WORDS.format(text="text")} AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), windows AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), counted AS (
  SELECT words.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(text) - length(replace(text, '!', '')) AS n_shouts,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop, coalesce(n, 0) AS n_repeat_words
  FROM words LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words > 0 AND word_chars BETWEEN 2.0 * n_words AND 12.0 * n_words AND n_symbols / n_words <= 0.1
      AND n_shouts / n_words <= 0.3 AND (n_stop + 1) / (n_words + 1) >= 0.08
      AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.5) AS passed
  FROM counted
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND passed AS kept
FROM judged
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id != b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

# The same digests, rounds and orders as the query: md5 of tags joined by colons.
_KEY = "CAST(('0x' || substr(md5({tags}), 1, 12)) AS BIGINT) % {n}"
_ROUND = """list_reduce(list_prepend({x}, range(0, 24)), lambda p, r: CASE WHEN substr(md5({tag} || ':' || r || ':' ||
  greatest(p, ((({key}) - p) % {n} + {n}) % {n})), 1, 1) < '8' THEN ((({key}) - p) % {n} + {n}) % {n} ELSE p END)"""


def _permuted(x: str, n: str, key_tag: str, tag: str) -> str:
    key = _KEY.format(tags=f"{key_tag} || ':key:' || r", n=n)
    return _ROUND.format(x=x, n=n, key=key, tag=tag)


MIXING = rf"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text,
    len({_WORDS.format(text="coalesce(text, '')")})::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 3) AS bucket
  FROM documents
), named AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source)
), weighed AS (
  SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], (sid % 3 + 1)::INT) AS weight, 2.0 * source_size AS lim FROM named
), rates AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, sid
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY lim / weight, sid
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, row_number() OVER (ORDER BY lim / weight, sid) AS k FROM weighed
), goal AS (
  SELECT source, sid, source_size, least(lim, coalesce((SELECT arg_min(rate, k) FROM rates WHERE rate * weight <= lim), 1e300) * weight)::DOUBLE
    AS target FROM rates
), placed AS (
  SELECT docs.*, sid, source_size, target, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id, size, row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs JOIN goal ON docs.source IS NOT DISTINCT FROM goal.source
), plan0 AS (
  SELECT sid, source_size AS size, source_size // 512 AS whole, source_size % 512 AS tail,
    least(round(target)::BIGINT, 2 * source_size) AS wanted FROM goal WHERE source_size > 0
), plan1 AS (
  SELECT *, whole + (tail > 0)::INT AS per_pass, wanted // size AS passes, wanted % size AS need FROM plan0
), plan2 AS (
  SELECT *, CASE WHEN need <= whole * 512 THEN (need + 511) // 512 ELSE whole + 1 END AS more FROM plan1
), plan3 AS (
  SELECT *, passes * per_pass + more AS n_slots,
    CASE WHEN need <= whole * 512 THEN need - (more - 1) * 512 ELSE need - whole * 512 END AS last_words FROM plan2
), plan AS (
  SELECT *, coalesce(sum(n_slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
    sum(n_slots) OVER ()::BIGINT AS all_slots FROM plan3
), slots AS (
  SELECT *, n // per_pass AS pass, n % per_pass AS place
  FROM (SELECT *, unnest(range(0, n_slots)) AS n FROM plan WHERE n_slots > 0)
), drawn AS (
  SELECT sid, CASE WHEN place < whole THEN {_permuted("place", "whole", "'mix-1:' || sid || ':' || pass", "'mix-1:' || sid || ':' || pass")}
      ELSE whole END AS block,
    CASE WHEN n = n_slots - 1 AND need > 0 THEN last_words WHEN place < whole THEN 512 ELSE tail END AS words,
    ({_permuted("first + n", "all_slots", "'mix-1:deal'", "'mix-1:deal'")}) // 1024 AS output_shard
  FROM slots
), takes AS (
  SELECT row, least(start + placed.size, block * 512 + words) - greatest(start, block * 512) AS got, output_shard
  FROM (SELECT *, unnest(range(start // 512, (start + size - 1) // 512 + 1)) AS block FROM placed WHERE size > 0) placed
  JOIN drawn USING (sid, block)
), summed AS (
  SELECT row, sum(got) AS taken, min(output_shard) AS first_shard FROM takes WHERE got > 0 GROUP BY row
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_shard::BIGINT AS first_shard
FROM placed LEFT JOIN summed USING (row)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id != v.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
phrases AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM words, (SELECT unnest(range(1, 6)) AS k)
), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM phrases GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
longer AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
  LEFT JOIN longer ON longer.lang = c.lang AND longer.phrase = c.phrase
  WHERE longer.longer IS NULL OR 100 * longer.longer < 100 * c.f
), weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_quality": QUALITY, "op2_neardup": NEAR_DUPLICATES, "op8_mixing": MIXING, "op10_topk": TOP_K,
    "op12_collocations": COLLOCATIONS,
}

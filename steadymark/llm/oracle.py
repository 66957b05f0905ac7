"""SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(words: int, percent: int, kept: bool) -> str:
    """Documents linked by their shingle sets: a self-join on shingles, and all that can be reached from a document."""
    lower = _LOWER.format(text="coalesce(text, '')")
    return rf"""WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i + {words - 1}], ' '))) END AS shingles
  FROM split
), each AS (
  SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM each AS a JOIN each AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT reached.doc_id, links.v FROM reached JOIN links ON reached.other = links.u
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id{", doc_id = component_id AS kept" if kept else ""}
FROM sets JOIN least USING (doc_id)"""


def _collocations(least: int = 30, percent: int = 80, top: int = 2000) -> str:
    """Counts of all n-grams, the lowest scoring cut of each frequent one, and those that no longer one holds."""
    lower = _LOWER.format(text="coalesce(text, '')")
    grams = " UNION ALL ".join(
        f"SELECT lang, {n} AS size, unnest(list_transform(range(1, len(words) - {n - 2}), lambda i: array_to_string(words[i:i + {n - 1}], ' '))) AS phrase FROM pieces" for n in range(1, 5)
    )
    part = lambda a, b: f"array_to_string(string_split(phrase, ' ')[{a}:{b}], ' ')"
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, {part(1, k)} AS head, {part(k + 1, 4)} AS tail FROM found WHERE size > {k}" for k in (1, 2, 3))
    inner = " UNION ALL ".join(
        f"SELECT lang, {part(i, i + n - 1)} AS phrase, a FROM found WHERE size = {size}" for size in (3, 4) for n in range(2, size) for i in range(1, size - n + 2)
    )
    return rf"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang
), grams AS ({grams}), counts AS (
  SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL
), found AS (
  SELECT lang, size, phrase, f AS a FROM counts WHERE size > 1 AND f >= {least}
), scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM ({cuts}) AS c JOIN counts AS l ON l.lang = c.lang AND l.phrase = c.head JOIN counts AS r ON r.lang = c.lang AND r.phrase = c.tail
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(a) AS most FROM ({inner}) GROUP BY lang, phrase
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < {percent} * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""


def _runs(periods: int = 4, least: int = 6) -> str:
    """Every pair of equal words within a quarter of a text, put together to stretches of one distance."""
    bits = "list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    checksum = f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295]::BIGINT[], {digits}), lambda crc, byte: {bits}))"
    return rf"""WITH split AS (
  SELECT doc_id, {checksum} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), sized AS (
  SELECT *, len(words) AS n, h // 10 AS g, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM split
), planted AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(0, n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE words END AS words
  FROM sized
), each AS (
  SELECT doc_id, n, unnest(words) AS word, unnest(range(0, n)) AS i FROM planted
), same AS (
  SELECT a.doc_id, b.i - a.i AS period, a.i FROM each AS a JOIN each AS b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND {periods} * (b.i - a.i) <= a.n
), stretches AS (
  SELECT doc_id, period, min(i) AS start, count(*) + period AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM same) GROUP BY doc_id, period, island
), runs AS (
  SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length
  HAVING length >= greatest({least}, {periods} * min(period))
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM planted LEFT JOIN listed USING (doc_id) LEFT JOIN collapsed USING (doc_id)"""


def all_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": _components(4, 85, False),
        "op11_tensored_banding": _components(5, 85, True),
        "op12_periodic_runs": _runs(),
        "op13_collocations": _collocations(),
    }

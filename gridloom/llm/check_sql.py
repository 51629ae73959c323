"""DuckDB SQL that gives the same rows as the corpus queries, with all constants typed afresh."""

from __future__ import annotations

EXACT = """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents) d
WINDOW w AS (PARTITION BY t)"""

URLS = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS n
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (page_id)"""

_TERMS = (
    "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[a-z0-9]+(?:[.-][a-z0-9]+)*')"
)
LICENSES = f"""
WITH templates(template, license, text) AS (VALUES
  (0, 'MIT', 'Released under the MIT License.'),
  (1, 'MIT', 'Licensed under the MIT license, see the LICENSE file.'),
  (2, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  (3, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  (4, 'GPL-2.0', 'This program is licensed under the GNU General Public License, version 2.'),
  (5, 'LGPL-3.0', 'Licensed under the GNU Lesser General Public License, version 3.'),
  (6, 'MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
  (7, 'BSD-3-Clause', 'Use of this source code is governed by a BSD-style license.'),
  (8, 'CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
  (9, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  (10, 'CC-BY-SA-4.0', 'Licensed under CC BY-SA 4.0.'),
  (11, 'CC0-1.0', 'Dedicated to the public domain under CC0 1.0.')),
tt AS (SELECT template, license, term, count(*) AS tf
       FROM (SELECT template, license, unnest({_TERMS.format('text')}) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (
         SELECT DISTINCT doc_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM documents)
       WHERE term IN (SELECT term FROM tt) GROUP BY term),
size AS (SELECT count(*)::DOUBLE AS n FROM documents),
idf AS (SELECT DISTINCT term, ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM tt LEFT JOIN df USING (term), size),
weighted AS (SELECT template, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
unit AS (SELECT template, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM weighted),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
words AS (SELECT doc_id, line, term, count(*) AS tf
          FROM (SELECT doc_id, line, unnest({_TERMS.format('line')}) AS term FROM lines) GROUP BY ALL),
vectors AS (SELECT doc_id, line, term, tf * coalesce(idf, ln(n + 1.0) + 1.0) AS v
            FROM words LEFT JOIN idf USING (term), size),
normed AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc_id, line)) AS norm FROM vectors),
scores AS (SELECT doc_id, template, license, round(sum(v * w) / max(norm), 6) AS score
           FROM normed JOIN unit USING (term) GROUP BY doc_id, line, template, license),
own AS (SELECT doc_id, license AS own_license, score FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS n FROM scores WHERE score >= 0.7)
        WHERE n = 1),
files AS (
  SELECT doc_id, own_license, score,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none')
         || CASE WHEN doc_id % 10 = 0 THEN '' ELSE '/' || (doc_id // 1000) END
         || CASE WHEN doc_id % 10 < 3 THEN '' ELSE '/' || (doc_id // 100) END AS directory
  FROM documents LEFT JOIN own USING (doc_id)),
declared AS (SELECT directory AS ancestor, own_license AS inherited FROM (
    SELECT *, row_number() OVER (PARTITION BY directory ORDER BY score DESC, directory || '/' || doc_id) AS n
    FROM files WHERE own_license IS NOT NULL) WHERE n = 1),
nearest AS (SELECT directory, inherited, ancestor FROM (
    SELECT directory, inherited, ancestor, row_number() OVER (PARTITION BY directory ORDER BY length(ancestor) DESC) AS n
    FROM (SELECT DISTINCT directory FROM files) JOIN declared
      ON directory = ancestor OR starts_with(directory, ancestor || '/') OR ancestor = '') WHERE n = 1)
SELECT doc_id, directory || '/' || doc_id AS path, own_license, score, inherited, ancestor AS inherited_from,
       coalesce(own_license, inherited) AS license
FROM files LEFT JOIN nearest USING (directory)"""


def _scrambled(x: str) -> str:
    y = f"(({x}) % 2147483647)"
    return f"(({y} * ({y} + 40503)) % 2147483647 * 48271 % 2147483647)"


def _rounds(start: str, rounds: int) -> str:
    """Nested subqueries, one for each round of the permutation of 0 .. blocks-1."""
    sql = start
    for r in range(rounds):
        seed = _scrambled(f"source_rank * 1000003 + pass * 7919 + {r} * 104729 + 12345")
        sql = f"SELECT * REPLACE ((seed * 1048573 % blocks + blocks - x) % blocks AS mirror) FROM (SELECT * REPLACE ({seed} AS seed) FROM ({sql}))"
        bit = f"({_scrambled('greatest(x, mirror) + seed')} // 1024) % 2"
        sql = f"SELECT * REPLACE (CASE WHEN {bit} = 1 THEN mirror ELSE x END AS x) FROM ({sql})"
    return sql


_SLOTS = """SELECT *, pass * blocks + x AS number, 0::BIGINT AS seed, 0::BIGINT AS mirror
  FROM (SELECT source_rank, blocks, pass, unnest(generate_series(0::BIGINT, n - 1)) AS x FROM (SELECT source_rank, blocks, pass, CASE WHEN pass < passes THEN blocks ELSE rest END AS n
        FROM (SELECT *, unnest(generate_series(0::BIGINT, passes)) AS pass FROM quotas)) WHERE n > 0)"""

MIX = f"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, '') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
ranked AS (SELECT *, row_number() OVER (ORDER BY key = '', key) AS source_rank FROM sums),
weighed AS (SELECT *, (source_rank - 1) % 3 + 1 AS weight FROM ranked),
ordered AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
             ORDER BY source_size / weight::DOUBLE, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER (ORDER BY source_size / weight::DOUBLE, source_rank
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed),
opened AS (
  SELECT *, first_value(CASE WHEN 3 * source_size::HUGEINT * left_weight >= left_words::HUGEINT * weight
                             THEN {{'w': left_words, 'k': left_weight}} END IGNORE NULLS)
            OVER (ORDER BY source_size / weight::DOUBLE, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o
  FROM ordered),
goals AS (
  SELECT key, source_rank, source_size,
         CASE WHEN o IS NULL THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * o.w::DOUBLE / o.k::DOUBLE END AS target
  FROM opened),
passed AS (
  SELECT *, CAST(ceil(source_size / 64.0::DOUBLE) AS BIGINT) AS blocks,
         CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM goals),
quotas AS (
  SELECT *, greatest(0, least(blocks, CASE WHEN passes >= 3 THEN 0
         ELSE CAST(floor((target - passes * source_size) / 64.0::DOUBLE + 0.5) AS BIGINT) END)) AS rest FROM passed),
drawn AS (SELECT source_rank, {_scrambled(_scrambled('x + source_rank * 92821') + ' + pass * 31337 + 271')} % greatest(1, (count(*) OVER () + 4095) // 4096) AS shard FROM ({_SLOTS})),
counts AS (SELECT source_rank, shard, count(*) AS n FROM drawn GROUP BY ALL),
ranges AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source_rank ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM counts),
used AS (SELECT s.source_rank, x AS block, count(*) AS times, list(shard) AS shards FROM ({_rounds(_SLOTS, 12)}) s
  JOIN ranges r ON r.source_rank = s.source_rank AND number >= first AND number < first + r.n GROUP BY ALL),
buckets AS (SELECT greatest(1, (count(*) + 19999) // 20000) AS n FROM sized),
placed AS (
  SELECT s.*, source_rank, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY key ORDER BY ((doc_id % 2147483647 + 2147483647) % 2147483647 * 48271 % 2147483647) % n,
                                  doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN quotas USING (key), buckets),
pieces AS (
  SELECT *, unnest(generate_series(start // 64, (start + size - 1) // 64)) AS block FROM placed WHERE size > 0),
counted AS (
  SELECT doc_id, sum((least(start + size, (block + 1) * 64) - greatest(start, block * 64)) * times)::BIGINT AS taken,
         array_to_string(list_sort(list_distinct(flatten(list(shards)))), ',') AS shards
  FROM pieces JOIN used USING (source_rank, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(shards, '') AS shards
FROM placed LEFT JOIN counted USING (doc_id)"""

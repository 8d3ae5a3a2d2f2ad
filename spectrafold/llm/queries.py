"""The operators' queries, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op8_decontamination
from .language_id import op13_language_id
from .line_dedup import op4_line_dedup
from .mixing import op7_mixing
from .near_dedup import op6_near_dedup
from .ngram_trie import op9_ngram_trie
from .quality_rules import op2_quality_rules
from .resampling import op11_resampling
from .sharding import op5_sharding
from .substring_dedup import op1_substring_dedup
from .token_files import op10_token_files
from .token_alignment import op12_token_alignment
from .warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_warc, op4_line_dedup, op5_sharding, op6_near_dedup, op7_mixing, op8_decontamination, op9_ngram_trie, op10_token_files, op11_resampling, op12_token_alignment, op13_language_id)}

#: The queue in SQL: all copies in order of their finish, cut where the budget ends. The decision list, components, cuts by
#: binary search, files and the trie are held against brute force in tests/llm.
MIXING = r"""
WITH s AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' END || coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
b AS (SELECT src, source, sum(size) AS source_size FROM s GROUP BY 1, 2),
l AS (SELECT *, 3 * source_size / weight AS level FROM (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM b) w),
f AS (SELECT *, level <= (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS filled FROM l WINDOW o AS (ORDER BY level, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE) ELSE weight * (sum(source_size) OVER () - sum(CASE WHEN filled THEN 3 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN filled THEN 0 ELSE weight END) OVER () END AS target FROM f),
q AS (SELECT s.*, source_size, target, row_number() OVER () AS row, sum(size) OVER (PARTITION BY src ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far FROM s JOIN t USING (src)),
c AS (SELECT q.*, (k * source_size + so_far) / target AS finish FROM q, range(3) r(k) WHERE size > 0),
u AS (SELECT row, size, sum(size) OVER (ORDER BY finish, src, so_far ROWS UNBOUNDED PRECEDING) - size AS before FROM c),
g AS (SELECT row, sum(greatest(0, least(size, (SELECT sum(size) FROM s) - before))) AS taken FROM u GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN g USING (row)
"""

#: Every window of 35 words, those that start twice, and the words outside them.
SUBSTRINGS = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM w) q),
h AS (SELECT row, i FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1)),
c AS (SELECT DISTINCT row, i + k AS place FROM h, range(35) s(k)),
e AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
k AS (SELECT e.row, count(c.place) AS n_removed, string_agg(CASE WHEN c.place IS NULL THEN word END, ' ' ORDER BY e.place) AS kept FROM e LEFT JOIN c ON c.row = e.row AND c.place = e.place GROUP BY 1)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (row)
"""

#: Intersections of all pairs of sets that share a shingle, then what each document reaches.
NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(shingle) AS shingle FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: Equal words by alignment, then the best passage of each alignment that may hold one.
LEAKS = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM benchmark),
l AS (SELECT item, item_id, len(words) AS n, least(len(words), 13) AS passage FROM i WHERE len(words) > 0),
x AS (SELECT row, doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM d),
y AS (SELECT item, unnest(words) AS word, unnest(range(len(words))) AS pos FROM i),
m AS (SELECT row, doc_id, item, place - pos AS shift, pos FROM x JOIN y USING (word)),
t AS (SELECT row, item, shift FROM m JOIN l USING (item) GROUP BY 1, 2, 3, passage HAVING 100 * count(*) >= 80 * passage),
a AS (SELECT doc_id, row, item, item_id, shift, passage, first, count(*) AS agreed FROM (SELECT m.*, item_id, n, passage, unnest(range(greatest(0, pos - passage + 1), least(pos, n - passage) + 1)) AS first FROM m JOIN t USING (row, item, shift) JOIN l USING (item)) q GROUP BY ALL),
b AS (SELECT doc_id, row, item_id, agreed, shift + min(first) AS start FROM (SELECT *, max(agreed) OVER (PARTITION BY row, item, shift) AS most FROM a) q WHERE agreed = most AND 100 * agreed >= 80 * passage GROUP BY doc_id, row, item, item_id, shift, agreed)
SELECT doc_id, item_id, CAST(agreed AS BIGINT) AS agreed, CAST(start AS BIGINT) AS start FROM (SELECT *, row_number() OVER (PARTITION BY row, item_id ORDER BY agreed DESC, start DESC) AS r FROM b) q WHERE r = 1
"""

#: Digests in base 32, four characters for each five hexadecimal digits; the largest page of a payload is its response.
CAPTURES = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS latest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '') AS payload_digest, CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to FROM l
"""

#: Checksums of distinct runs byte by byte from a table of 256, counts of both corpora, gains, floors, and the draw by rank.
RESAMPLING = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
v AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
f AS (SELECT row, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
g AS (SELECT unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM v),
t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
h AS (SELECT feature, hex(encode(feature)) AS digits FROM (SELECT feature FROM f UNION SELECT feature FROM g) q),
k AS (SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(digits) // 2), lambda i: CAST('0x' || substr(digits, CAST(1 + 2 * i AS INT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM h, t),
s AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (feature) GROUP BY 1),
u AS (SELECT bucket, count(*) AS n FROM g JOIN k USING (feature) GROUP BY 1),
p AS (SELECT b.bucket, CAST(floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM u) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN u USING (bucket)),
m AS (SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN k USING (feature) JOIN p USING (bucket) GROUP BY 1),
x AS (SELECT row, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS unit FROM w LEFT JOIN m USING (row)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(unit))) AS BIGINT) AS score FROM x),
z AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS fit FROM y WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN rank <= 25 * fit // 100 THEN rank END AS BIGINT) AS rank FROM y LEFT JOIN z USING (row)
"""

ORACLES: dict[str, str] = {"op1_substring_dedup": SUBSTRINGS, "op3_warc": CAPTURES, "op6_near_dedup": NEAR, "op7_mixing": MIXING, "op8_decontamination": LEAKS, "op11_resampling": RESAMPLING}

"""DuckDB SQL for the queries that SQL can express, built from the operators' own parameters."""

from __future__ import annotations

from tessera.llm.filter_audit import Filters
from tessera.llm.fim import Fim
from tessera.llm.mixing import GOLDEN, Mix
from tessera.llm.near_dedup import NearDup
from tessera.llm.quality import Rules
from tessera.llm.sharding import Sharding

W = r"[\x20\x09-\x0D]"

OP10 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

OP8 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


def op6(rules: Rules) -> str:
    """The counts by unnested words, windows and lines; the distances from histograms as rows."""
    cls = [f"('{lang}', {k}, {float(q)!r}::DOUBLE)" for lang, own in rules.class_shares.items() for k, q in enumerate(own)]
    wrd = [f"('{lang}', '{w}', {float(q)!r}::DOUBLE)" for lang, own in rules.word_shares.items() for w, q in own.items()]
    rest = [f"('{lang}', NULL, {1.0 - sum(own.values())!r}::DOUBLE)" for lang, own in rules.word_shares.items()]
    part = "(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)"
    return f"""
WITH class_ref(lang, k, q) AS (VALUES {", ".join(cls)}),
word_ref(lang, w, q) AS (VALUES {", ".join(wrd)}),
rest_ref(lang, w, q) AS (VALUES {", ".join(rest)}),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '{W}+'), lambda x: x <> '') AS words, regexp_replace(t, '{W}+', '', 'g') AS j FROM d),
c AS (
  SELECT doc_id, lang, t, words, len(words) AS n_words, length(t) AS n_chars, length(j) AS word_chars,
         length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(j) AS j0, length(regexp_replace(j, '[\\p{{L}}\\p{{M}}]', '', 'g')) AS j1,
         length(regexp_replace(j, '\\p{{Lu}}', '', 'g')) AS ju,
         length(regexp_replace(j, '\\p{{Nd}}', '', 'g')) AS jd,
         length(regexp_replace(j, '[.,;:!?''"()\\-]', '', 'g')) AS jp
  FROM s),
lines AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) l
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) g GROUP BY doc_id),
win AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM c WHERE n_words >= 3) x),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) y WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(3)) AS k) z GROUP BY doc_id),
class_n AS (
  SELECT doc_id, lang, n_chars, unnest(range(6)) AS k,
         unnest([j0 - j1 - (j0 - ju), j0 - ju, j0 - jd, n_chars - j0, j0 - jp, j0 - (j0 - j1) - (j0 - jd) - (j0 - jp)]) AS n
  FROM c WHERE n_chars >= {rules.min_chars}),
class_d AS (
  SELECT doc_id, sqrt(greatest(sum({part}) / 2, 0)) AS far
  FROM (SELECT doc_id, n / n_chars::DOUBLE AS p, q FROM class_n JOIN class_ref USING (lang, k)) x GROUP BY doc_id),
word_n AS (
  SELECT doc_id, c.lang, r.w, n_words, len(list_filter(words, lambda x: x = r.w)) AS n, q
  FROM c JOIN word_ref r ON c.lang = r.lang WHERE n_words >= {rules.min_words}),
word_all AS (
  SELECT doc_id, n / n_words::DOUBLE AS p, q FROM word_n
  UNION ALL
  SELECT doc_id, (n_words - n) / n_words::DOUBLE, r.q
  FROM (SELECT doc_id, lang, n_words, sum(n) AS n FROM word_n GROUP BY ALL) x JOIN rest_ref r USING (lang)),
word_d AS (SELECT doc_id, sqrt(greatest(sum({part}) / 2, 0)) AS far FROM word_all GROUP BY doc_id),
f AS (
  SELECT c.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(class_d.far, 0) AS cd, coalesce(word_d.far, 0) AS wd
  FROM c LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN class_d USING (doc_id) LEFT JOIN word_d USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.min_doc_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {rules.min_doc_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
         AND cd <= {rules.max_class_distance} AND wd <= {rules.max_word_distance} AS kept
FROM f
"""


OP6 = op6(Rules())


def op1(params: NearDup) -> str:
    """All pairs that share a shingle, counted; components by reachability over the links."""
    k = params.shingle
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + {k - 1}], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {k - 2}, 2))) AS i FROM w WHERE len(words) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {params.percent} * (p.n + q.n - c)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT y, root FROM reach JOIN link ON x = doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""


def op2(mix: Mix) -> str:
    """taken: the overlap of a document's place in its source's stream with the words that the mix takes in each pass.
    first_slot: golden-ratio points through the sources' shares of all blocks that the mix needs, ranked for each source."""
    weights = ", ".join(map(str, mix.weights))
    passes = " + ".join(f"greatest(0, least(start + size, want - {e} * source_size) - start)" for e in range(mix.max_epochs))
    return f"""
WITH d AS (SELECT doc_id, source, md5('{mix.seed}:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM s),
w AS (SELECT *, ([{weights}])[(no % {len(mix.weights)} + 1)::INT]::BIGINT AS weight, source_size * {mix.max_epochs} AS cap FROM n),
o AS (
  SELECT *, row_number() OVER p AS place, coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
         (sum(weight) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left,
         (sum(source_size) OVER ())::BIGINT * {mix.percent / 100.0!r}::DOUBLE AS goal
  FROM w WINDOW p AS (ORDER BY cap::DOUBLE / weight, no)),
e AS (SELECT place AS end_place, goal - capped AS rest, weight_left FROM o WHERE cap * weight_left >= (goal - capped) * weight ORDER BY place LIMIT 1),
t AS (
  SELECT source, no, source_size, CASE WHEN o.place >= e.end_place THEN weight * e.rest / e.weight_left ELSE cap::DOUBLE END AS target, cap
  FROM o LEFT JOIN e ON true),
p AS (
  SELECT doc_id, size, no, source_size, target, least(floor(target), cap)::BIGINT AS want,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (
  SELECT no, source_size, want, blocks, (want // source_size * blocks + ceil(want % source_size / {mix.block}))::BIGINT AS need
  FROM (SELECT no, source_size, least(floor(target), cap)::BIGINT AS want, ceil(source_size / {mix.block})::BIGINT AS blocks FROM t WHERE source_size > 0)),
r AS (SELECT *, (sum(need) OVER (ORDER BY no))::BIGINT AS hi, (sum(need) OVER ())::BIGINT AS slots FROM b WHERE need > 0),
x AS (SELECT n, (n + 1) * {GOLDEN!r}::DOUBLE - floor((n + 1) * {GOLDEN!r}::DOUBLE) AS x FROM (SELECT unnest(range((SELECT coalesce(max(slots), 0) FROM r))) AS n)),
k AS (SELECT n, no, need, row_number() OVER (PARTITION BY no ORDER BY n) - 1 AS k FROM x JOIN r ON x >= (hi - need)::DOUBLE / slots AND x < hi::DOUBLE / slots),
m AS (SELECT no, count(*) AS got FROM k WHERE k < need GROUP BY no),
l AS (SELECT slots + hi - need + k AS n, no, k FROM (SELECT *, unnest(range(coalesce(got, 0), need)) AS k FROM r LEFT JOIN m USING (no))),
z AS (
  SELECT n, no, k % blocks * {mix.block} AS low, least(k % blocks * {mix.block} + {mix.block}, source_size, want - k // blocks * source_size) AS high
  FROM (SELECT n, no, k FROM k WHERE k < need UNION ALL SELECT n, no, k FROM l) JOIN b USING (no)),
f AS (SELECT p.no AS f_no, p.start AS f_start, min(n) AS first_slot FROM p JOIN z ON p.no = z.no AND size > 0 AND greatest(start, low) < least(start + size, high) GROUP BY ALL)
SELECT doc_id, size, source_size, target, ({passes})::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM p LEFT JOIN f ON p.no = f_no AND p.start = f_start AND size > 0
"""


OP1, OP2 = op1(NearDup()), op2(Mix())


def op11(f: Filters) -> str:
    """Every order is run step by step over the counts of each set of failed filters; shapley is the sum over all orders."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{W}+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < {f.min_words} THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < {f.min_distinct_percent} * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {f.max_capital_percent} * length(t) THEN 'C' ELSE '' END
         || CASE WHEN translate(t, '{f.symbols}', '') <> t THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
  FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
n AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, failed),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM a p, a q, a r, a s, a t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (
  SELECT filter_order, step::INT AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
j AS (SELECT *, contains(failed, own) AS fails, length(translate(failed, earlier, '')) < length(failed) AS gone FROM n, k),
r AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def op12(s: Sharding) -> str:
    """One order over all rows, running sums, and the shard in whose share a row's middle lies. CRC-32 by a table of 256
    remainders, byte after byte."""
    bit = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE step(k, c, i) AS (
  SELECT x, x, 0 FROM (SELECT unnest(range(256)) AS x)
  UNION ALL
  SELECT k, {bit}, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM step WHERE i = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, strlen(t)::BIGINT + 1 AS size, sha256(t) AS digest, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
c AS (
  SELECT doc_id, size, digest,
         xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM h, crc),
o AS (SELECT *, sum(size) OVER p AS upto, row_number() OVER p - 1 AS n, sum(size) OVER () AS total FROM c WINDOW p AS (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least({s.shards} * (2 * upto - size) // (2 * total), {s.shards - 1})::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s
"""


def op13(f: Fim) -> str:
    """restored_sha256 is the text's own digest: what any output must give back."""
    hold = " OR ".join(f"contains(t, '{s}')" for s in f.sentinels)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{f.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '{f.unit}') AS units, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d),
c AS (
  SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS low, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS high,
         CASE WHEN t = '' OR {hold} OR r[3] % 100 >= {f.percent} THEN 'plain' WHEN r[4] % 100 < {f.spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{f.prefix}' || prefix || '{f.suffix}' || suffix || '{f.middle}' || middle
              ELSE '{f.suffix}' || suffix || '{f.prefix}' || prefix || '{f.middle}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


OP11, OP12, OP13 = op11(Filters()), op12(Sharding()), op13(Fim())

"""The queries of this subpackage and the SQL that holds them to account."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphweave.llm import centroids, divergence, embedding, jaccard, lines, lm, mixing, packing, passages, pii, quality, secrets, sharding
from glyphweave.session import shared_dir, table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines_left"), F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped_lines"), "text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer())


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pivots are fragments of documents, not whole documents: see jaccard's docstring and README for why, and for where distances to whole documents are taken."""
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_history(table(spark, sf_dir, "documents"), secrets.fresh_ledger(spark))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), cos=0.98)


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="a key that the caller keeps")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), _tokenizer())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = sharding.ShardMaps(spark, f"{shared_dir(spark)}/shard-maps-{uuid.uuid4().hex}")
    return sharding.shard(table(spark, sf_dir, "documents"), maps, shards=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_secret_scans": op6_secret_scans,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_source_divergence": op12_source_divergence,
    "op13_sharding": op13_sharding,
}

_WORDS = "list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
_CLOSURE = """l AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node, other) AS (SELECT DISTINCT a, a FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
_FIRST = "ORDER BY words * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

_any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = f"({_NAMES})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
#: Per kind: a pattern without look-around, and what a match must be besides. Runs of letters and digits stand for the last one's edges.
_SECRETS = (
    (_ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 12"),
    ("AKIA[A-Z0-9]+", "length(m) >= 18"),
    ("[0-9a-f]+", "length(m) >= 16"),
    ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", "true"),
    ("gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    (r"[a-z][a-z0-9+.-]{1,15}://[^\s\x0b:/@]{1,64}:[^\s\x0b:/@]{3,64}@", "true"),
    ("[0-9A-Za-z]+", "regexp_full_match(m, '[0-9A-F]{32,}') AND regexp_matches(m, '[A-F]') AND regexp_matches(m, '[0-9]')"),
)
_KIND_NAMES = "['assign', 'access', 'hex', 'private_key', 'web_token', 'hosted_token', 'url_login', 'upper_hex']"

def _lloyd(clusters: int, rounds: int, dims: int) -> str:
    """Lloyd rounds in SQL: each round is a table of assignments and one of centroids; HUGEINT sums, floor by remainders."""
    apart = "list_sum(list_transform(list_zip(v, c), lambda p: CAST(p[1] - p[2] AS HUGEINT) * (p[1] - p[2])))"
    assigned = lambda k: f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := {apart}, cluster := cluster)) AS m FROM kept, c{k} GROUP BY r)"
    moved = lambda k: f"""c{k} AS MATERIALIZED (SELECT cluster, list(f ORDER BY i) AS c FROM (SELECT m.cluster AS cluster, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM a{k - 1}, range(1, {dims + 1}) t(i) GROUP BY 1, 2) GROUP BY cluster
  UNION ALL SELECT cluster, c FROM c{k - 1} WHERE cluster NOT IN (SELECT m.cluster FROM a{k - 1}))"""  # noqa: E731
    steps = ", ".join(f"{assigned(k)}, {moved(k + 1)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS c FROM kept QUALIFY cluster < {clusters}), {steps}, {assigned(rounds)},
g AS (SELECT m.cluster AS cluster, CAST(sum(m.d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, CAST(m.cluster AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, cluster_inertia, (SELECT CAST(sum(cluster_inertia) AS BIGINT) FROM g) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN g ON g.cluster = m.cluster JOIN c{rounds} ON c{rounds}.cluster = m.cluster"""


def _nibble(c: str) -> str:
    """SQL of one step of CRC-32 over the low four bits of c, by its rule."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return f"xor(({c}) >> 4, ({table}::BIGINT[])[(({c}) & 15) + 1])"


ORACLE: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
m AS (SELECT sh.doc_id, s, n FROM sh JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS k FROM m a JOIN m b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (an + bn - k)), {_CLOSURE}
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = doc_id""",
    "op2_mixing": f"""
WITH s AS (SELECT doc_id, source, CAST(len({_WORDS.format(text="text")}) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM s GROUP BY source),
src AS (SELECT source, words, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM g),
lev AS (SELECT *, (CAST(sum(words) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(2 * coalesce(sum(words) OVER ({_FIRST}), 0) AS DOUBLE)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER ({_FIRST}), 0) AS DOUBLE) AS level FROM src),
t AS (SELECT source, words, CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE least(2.0::DOUBLE * words, (SELECT level FROM lev WHERE level * weight <= 2 * words ORDER BY words * 2.0::DOUBLE / weight, source NULLS LAST LIMIT 1) * weight) END AS target FROM lev),
r AS (SELECT *, floor(target / greatest(words, 1)) AS certain, target / greatest(words, 1) - floor(target / greatest(words, 1)) AS rest FROM t),
d AS (SELECT s.*, words, target, certain, rest, target - certain * words AS need, (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source),
e AS (SELECT *, greatest(CAST(round(64 * ln(size + 2)) AS BIGINT), 1) AS weight FROM d),
k AS (SELECT source, weight, need, CAST(sum(size) AS BIGINT) AS w FROM e WHERE rest > 0 GROUP BY source, weight, need),
f AS (SELECT *, (need - coalesce(sum(w) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight * w) OVER (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS scale FROM k),
z AS (SELECT source, arg_max(scale, weight) AS scale FROM f WHERE scale * weight <= 1 GROUP BY source),
q AS (SELECT e.*, CASE WHEN scale * weight >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (scale * weight / (1 - scale * weight)) END AS rank FROM e LEFT JOIN z ON e.source IS NOT DISTINCT FROM z.source),
g2 AS (SELECT source, list_reduce(list_prepend({{'gap': any_value(need), 'ids': []::BIGINT[]}}, list({{'gap': size::DOUBLE, 'ids': [doc_id]::BIGINT[]}} ORDER BY rank, doc_id)),
  lambda a, x: CASE WHEN x.gap <= a.gap THEN {{'gap': a.gap - x.gap, 'ids': list_concat(a.ids, x.ids)}} ELSE a END) AS fold FROM q WHERE rest > 0 AND size > 0 GROUP BY source),
o AS (SELECT q.*, coalesce(list_contains(fold.ids, doc_id), false) AS taken, fold.gap AS gap FROM q LEFT JOIN g2 ON q.source IS NOT DISTINCT FROM g2.source),
f2 AS (SELECT *, row_number() OVER (PARTITION BY source, (NOT taken AND size > 0 AND size < 2 * gap) ORDER BY abs(gap - size), rank, doc_id) = 1 AND NOT taken AND size > 0 AND size < 2 * gap AS fits FROM o)
SELECT doc_id, size, words AS source_size, target, CAST((certain + CASE WHEN taken OR coalesce(fits, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM f2""",
    "op6_secret_scans": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(f"SELECT {k} AS kind, doc_id, string_split(regexp_replace(text, '{pattern}', '\ue000\\0\ue001', 'g'), '\ue000') AS x FROM d" for k, (pattern, _) in enumerate(_SECRETS))}),
each AS (SELECT kind, doc_id, split_part(p, '\ue001', 1) AS m, i, sum(length(p)) OVER (PARTITION BY kind, doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - (i - 2) AS start FROM (SELECT kind, doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM raw)),
hits AS (SELECT kind, doc_id, start, CAST(start + length(m) AS BIGINT) AS stop, ({_KIND_NAMES})[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT) AS span FROM each WHERE i > 1 AND CASE kind {" ".join(f"WHEN {k} THEN {test}" for k, (_, test) in enumerate(_SECRETS))} END),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind, stop) AS spans FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN g USING (doc_id)""",
    "op7_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98), {_CLOSURE},
n AS (SELECT a AS node, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.node = vec_id LEFT JOIN c ON c.node = vec_id""",
    "op11_centroid_clustering": _lloyd(40, 5, 64),
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang AS lang, (SELECT count(*) FROM kept WHERE kept.lang = g.lang) AS v, (SELECT coalesce(sum(n), 0) FROM kept WHERE kept.lang = g.lang) AS total FROM (SELECT DISTINCT lang FROM g) g),
c AS MATERIALIZED (SELECT g.lang, g.source, kept.term, kept.n AS lang_n, coalesce(n.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT c.lang, c.source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (t.total + v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (v.total + v) AS q FROM c JOIN t USING (lang, source) JOIN v ON v.lang = c.lang),
f AS (SELECT a.lang AS lang, a.source AS source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op13_sharding": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
r AS MATERIALIZED (SELECT doc_id, hash, CAST(strlen(text) + 1 AS BIGINT) AS size, CAST(CAST('0x' || substr(hash, 1, 12) AS BIGINT) % 4096 AS INTEGER) AS virtual_slot,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: {_nibble(_nibble("xor(c, b)"))})) AS text_crc32 FROM d),
s AS MATERIALIZED (SELECT virtual_slot, sum(size) AS size, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS i FROM r GROUP BY virtual_slot),
dealt(i, loads, shard) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::HUGEINT[], 0::INTEGER
  UNION ALL SELECT s.i, list_transform(loads, lambda w, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN w + s.size ELSE w END), CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER) FROM dealt JOIN s ON s.i = dealt.i + 1)
SELECT doc_id, r.size AS size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY hash, r.size, text_crc32) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, virtual_slot, 1 AS map_version
FROM r JOIN s USING (virtual_slot) JOIN dealt ON dealt.i = s.i""",
}

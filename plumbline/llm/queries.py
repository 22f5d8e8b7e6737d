"""The registered queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import codes, containment, extendible, language, negatives, packing, quality, secrets, simhash, substring, token_files, tokens, warc
from plumbline.llm.common import shared_folder, table

#: The id that ends a document.
END = 1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable:
    def keep(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


QUALITY_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w,
        [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d
), win AS (
    SELECT rid, unnest([{'i': i, 's': array_to_string(w[i:i + 4], ' ')} FOR i IN range(1, len(w) - 3)]) AS x
    FROM w WHERE len(w) >= 5
), rep AS (
    SELECT rid, x.i AS i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x.s) > 1
), cov AS (
    SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(5) AS r(k) GROUP BY rid
), m AS (
    SELECT w.rid, doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
        length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclamations
    FROM w LEFT JOIN cov USING (rid)
), b AS (
    SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT
        + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (100 * n_dup_lines > 60 * n_lines)::BIGINT
        + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
        + 32 * (2 * n_capitals > word_chars)::BIGINT + 64 * (10 * n_exclamations > 3 * n_words)::BIGINT AS fail_bits
    FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
    fail_bits = 0 AS kept, fail_bits FROM b
"""


@registered("op1_quality_rules", QUALITY_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.rejected(quality.BASE).alias("base_failed"),
        (~quality.rejected(quality.FULL)).alias("kept"),
        "fail_bits",
    )


ABLATION_SQL = QUALITY_SQL.replace(
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,\n"
    "    fail_bits = 0 AS kept, fail_bits FROM b",
    f"""SELECT policy, 1::INTEGER AS version, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed,
    count(*) FILTER (fail_bits & mask = bit) AS n_only, count(*) FILTER (fail_bits & mask <> 0) AS n_rejected
FROM b, (VALUES {", ".join(f"('{p.name}', {p.mask()}, '{r.name}', {r.mask()})" for p in (quality.BASE, quality.FULL) for r in quality.RULES if r.name in p.rules)})
    AS p(policy, mask, rule, bit) GROUP BY policy, rule""",
)


@registered("quality_ablation", ABLATION_SQL)
def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policies does, from a ledger that was written once and is read back."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    quality.ledger(table(spark, sf_dir, "documents")).select("row.doc_id", *quality.MEASURES, "fail_bits").write.parquet(folder)
    return quality.ablation(spark.read.parquet(folder), (quality.BASE, quality.FULL))


@registered("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.count_tokens(table(spark, sf_dir, "documents"), path, tokens.BYTE_LEVEL)


@registered("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@registered("op6_mixture_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, tokens.WORD_LEVEL, END)


@registered("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, path, tokens.WORD_LEVEL, END)
    return token_files.read_tokens(spark, folder)


SHARD_BYTES = 4 << 20

SHARD_SQL = rf"""
WITH RECURSIVE s AS (
    SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), t(depth, bits, n_bytes) AS (
    SELECT 0, 0::BIGINT, sum(n_bytes)::BIGINT FROM s
    UNION ALL
    SELECT p.depth + 1, s.h >> (59 - p.depth), sum(s.n_bytes)::BIGINT
    FROM t p JOIN s ON s.h >> (60 - p.depth) = p.bits WHERE p.n_bytes > {SHARD_BYTES} AND p.depth < 60
    GROUP BY ALL
)
SELECT s.doc_id, s.n_bytes, CASE WHEN t.depth = 0 THEN '' ELSE right(bin(t.bits | (1::BIGINT << 61)), t.depth) END AS shard,
    t.depth::INTEGER AS depth, t.n_bytes AS shard_bytes, t.n_bytes > {SHARD_BYTES} AS oversize
FROM s JOIN t ON s.h >> (60 - t.depth) = t.bits WHERE t.n_bytes <= {SHARD_BYTES} OR t.depth = 60
"""


@registered("op7_extendible_sharding", SHARD_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records from the pages: each page as a response, and revisits of it that follow later.

    Revisits carry the tag, a weak tag, the date only, a changed tag or nothing to check by; some come before any response.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 97).cast("string"))
    line = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    responses = pages.select(
        (F.col("page_id") * 3).alias("record_id"),
        "url",
        (F.col("page_id") * 10).alias("ts"),
        F.lit("response").alias("kind"),
        F.when(F.col("page_id") % 13 == 12, 404).otherwise(200).alias("status"),
        F.array(
            line("ETag", tag), line("Last-Modified", date), line("Content-Type", F.lit("text/html")), line("Date", F.lit("first"))
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    way = F.col("page_id") % 5
    checked = (
        F.when(way == 0, F.array(line("etag", tag)))
        .when(way == 1, F.array(line("etag", F.concat(F.lit("W/"), tag))))
        .when(way == 2, F.array(line("last-modified", date)))
        .when(way == 3, F.array(line("etag", F.lit('"other"'))))
        .otherwise(F.array().cast(warc.HEADERS))
    )
    revisits = pages.select(
        (F.col("page_id") * 3 + 1).alias("record_id"),
        "url",
        F.when(F.col("page_id") % 11 == 3, -1).otherwise(F.col("page_id") * 10 + 5 + 70 * (F.col("page_id") % 40)).alias("ts"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        F.concat(
            checked, F.array(line("date", F.concat(F.lit("seen "), F.col("page_id").cast("string"))), line("server", F.lit("x")))
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return responses.unionByName(revisits)


WARC_SQL = r"""
WITH p AS (
    SELECT *, regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u,
        '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || (page_id % 97) AS day FROM pages
), k AS (
    SELECT *, regexp_extract(u, '^[^/?]*') AS h, substr(u, length(regexp_extract(u, '^[^/?]*')) + 1) AS r FROM p
), c AS (
    SELECT *, regexp_replace(regexp_replace(lower(h), '^www\.', ''), ':(80|443)$', '')
        || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            r, '([?&])(utm_[A-Za-z0-9_]*|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/$', '')
        AS key FROM k
), f AS (
    SELECT page_id * 3 AS record_id, key, page_id * 10 AS ts, page_id % 13 <> 12 AS is_full, tag, day,
        strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_sha256 FROM c
), v AS (
    SELECT page_id * 3 + 1 AS record_id, key, page_id, page_id % 5 AS way, tag, day,
        CASE WHEN page_id % 11 = 3 THEN -1 ELSE page_id * 10 + 5 + 70 * (page_id % 40) END AS ts FROM c
), m AS (
    SELECT v.*, (SELECT max({'ts': f.ts, 'id': f.record_id}) FROM f WHERE f.is_full AND f.key = v.key AND f.ts < v.ts).id AS target
    FROM v
), o AS (
    SELECT m.*, f.payload_bytes AS pb, f.payload_sha256 AS ps, f.tag AS ft, f.day AS fd,
        m.target IS NOT NULL AND coalesce(CASE way WHEN 0 THEN m.tag = f.tag WHEN 1 THEN m.tag = f.tag WHEN 2 THEN m.day = f.day
            WHEN 3 THEN '"other"' = f.tag ELSE false END, false) AS ok
    FROM m LEFT JOIN f ON f.record_id = m.target
)
SELECT record_id, key AS canonical_url, CASE WHEN is_full THEN 'full' ELSE 'other' END AS state, NULL::BIGINT AS target,
    concat_ws(chr(10), 'ETag: ' || tag, 'Last-Modified: ' || day, 'Content-Type: text/html', 'Date: first') AS headers,
    payload_bytes, payload_sha256 FROM f
UNION ALL
SELECT record_id, key, CASE WHEN target IS NULL THEN 'no_response' WHEN ok THEN 'resolved' ELSE 'mismatch' END, target,
    CASE WHEN ok THEN concat_ws(chr(10), CASE WHEN way = 2 THEN 'ETag: ' || ft END, 'Last-Modified: ' || fd,
            'Content-Type: text/html', CASE way WHEN 0 THEN 'etag: ' || tag WHEN 1 THEN 'etag: W/' || tag END,
            'date: seen ' || page_id)
        ELSE concat_ws(chr(10), CASE way WHEN 0 THEN 'etag: ' || tag WHEN 1 THEN 'etag: W/' || tag
            WHEN 2 THEN 'last-modified: ' || day WHEN 3 THEN 'etag: "other"' END, 'date: seen ' || page_id, 'server: x') END,
    CASE WHEN ok THEN pb END, CASE WHEN ok THEN ps END FROM o
"""


@registered("op10_warc_revisits", WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "state",
        "target",
        lines.alias("headers"),
        "payload_bytes",
        "payload_sha256",
    )


LEAKS_SQL = r"""
WITH d AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), b AS (
    SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark
), ds AS (
    SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM d
), bs AS (
    SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM b
), n AS (
    SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)
"""


@registered("op3_benchmark_decontamination", LEAKS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SUBSTRING_SQL = r"""
WITH d AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), win AS (
    SELECT doc_id, unnest([{'i': i, 's': md5(array_to_string(w[i:i + 49], ' '))} FOR i IN range(1, len(w) - 48)]) AS x
    FROM d WHERE len(w) >= 50
), hit AS (
    SELECT doc_id, x.i AS i FROM win QUALIFY min(doc_id) OVER (PARTITION BY x.s) < doc_id
), word AS (
    SELECT doc_id, unnest([{'i': i, 'v': w[i]} FOR i IN range(1, len(w) + 1)]) AS x FROM d
), mark AS (
    SELECT word.doc_id, x.i AS i, x.v AS v,
        max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
    FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.i = x.i
), left_over AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(v, ' ' ORDER BY i) FILTER (NOT gone), '') AS t
    FROM mark GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""


@registered("op2_substring_dedup", SUBSTRING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


@registered("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id"))))
    return language.label(docs, model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


NEGATIVES_SQL = r"""
WITH e AS (
    SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)
), s AS (
    SELECT a.rid AS aid, a.vec_id AS anchor_id, x.rid, x.vec_id, x.label = a.label AS alike,
        list_inner_product(a.v, x.v)::BIGINT AS score
    FROM e a JOIN e x ON a.rid <> x.rid WHERE a.vec_id % 50 = 0
), p AS (
    SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.aid, p.rid ORDER BY s.score DESC, s.vec_id)::INTEGER
        AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.aid = p.aid AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT * FROM n WHERE rank <= 3
"""


@registered("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


CODES_SQL = r"""
WITH e AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)
), x AS MATERIALIZED (
    SELECT rid, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM e, range(16) AS r(p)
), b0 AS MATERIALIZED (
    SELECT p, rid - 1 AS k, v FROM x WHERE rid <= 64
)"""
for _round in (0, 1, 2):
    CODES_SQL += f""", a{_round} AS MATERIALIZED (
    SELECT rid, x.p, any_value(x.v) AS v,
        min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, b{_round}.v)])::BIGINT, 'k': k}}) AS best
    FROM x JOIN b{_round} USING (p) GROUP BY rid, x.p
)"""
    if _round < 2:
        CODES_SQL += f""", m{_round} AS (
    SELECT p, best.k AS k, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS c
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{_round}) GROUP BY ALL
), b{_round + 1} AS MATERIALIZED (
    SELECT p, k, coalesce(n.v, b{_round}.v) AS v
    FROM b{_round} LEFT JOIN (SELECT p, k, list(c::BIGINT ORDER BY i) AS v FROM m{_round} GROUP BY p, k) n USING (p, k)
)"""
CODES_SQL += r""", c AS (
    SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY rid
), h AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM e JOIN c USING (rid), h
"""


@registered("op12_vector_codes", CODES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    sha = F.lit(codes.fingerprint(books)).alias("codebooks_sha256")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", sha)


def _either_case(pattern: str) -> str:
    """Letters of the words in a pattern as classes of both cases, for an engine that folds more than ASCII."""
    words = pattern.removeprefix("(?i:").partition(")")[0]
    return pattern.replace(f"(?i:{words})", "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words))


def _kind_sql(place: int, rule: secrets.Rule) -> str:
    pattern = "'" + _either_case(rule.pattern).replace("'", "''") + "'"
    return f"""SELECT rid, {place} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, {pattern}) AS g,
        regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS v
    FROM d WHERE regexp_matches(t, {pattern})"""


SECRETS_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
    {" UNION ALL ".join(_kind_sql(place, rule) for place, rule in enumerate(secrets.RULES))}
), u AS (
    SELECT rid, place, kind, least, unnest([{{'i': i, 'g': length(g[i]), 'm': length(m[i]), 'v': length(v[i])}}
        FOR i IN range(1, len(m) + 1)]) AS x FROM s
), q AS (
    SELECT *, (sum(x.g + x.m) OVER (PARTITION BY rid, place ORDER BY x.i))::BIGINT AS stop FROM u
), r AS (
    SELECT rid, place, kind, stop - x.m AS start, concat(kind, ':', stop - x.m, ':', stop) AS span FROM q WHERE x.v >= least
), k AS (
    SELECT rid, string_agg(span, ',' ORDER BY start, place) AS spans, string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex FROM r GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN k USING (rid)
"""


@registered("op13_secret_scan", SECRETS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))

"""The operators as queries over the driver's tables, and their SQL.

Each query applies its operator to the whole table and derives the digest
columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, whole_text
from tidemark.session import materialize


def op1_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import personal_data
    return personal_data(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import read_token_files, write_token_files
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


def op3_window_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secret_scan import scan
    return scan(table(spark, sf_dir, "documents"))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op5_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import near_groups
    return near_groups(table(spark, sf_dir, "documents")).drop("row")


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_quality import judge
    return judge(table(spark, sf_dir, "documents")).drop("row")


def op7_rarest_token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.url_rules import judge
    return judge(table(spark, sf_dir, "pages"))


def op8_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sharding import shuffle
    dealt = shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    data = whole_text().cast("binary")
    return dealt.select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.content_sort import copies
    return copies(table(spark, sf_dir, "documents")).drop("row")


def op10_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import cut, pack
    return pack(cut(table(spark, sf_dir, "documents"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash_dedup import groups
    return groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.near_dedup import _small_batches
    from tidemark.llm.token_alignment import _ROWS, align, pair_counts, scored
    aligned = align(table(spark, sf_dir, "documents"))
    out = scored(aligned, pair_counts(aligned)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
    with _small_batches(spark, _ROWS):
        return materialize(out)


def op13_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.collocations import best, phrases
    return best(phrases(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_weak_supervision_pii, op2_token_files, op3_window_entropy_secrets, op4_pareto_mix, op5_superminhash_dedup,
                            op6_line_frequency, op7_rarest_token_rules, op8_uniform_shards, op9_content_sort,
                            op10_grouping_genetic, op11_vantage_simhash,
                            op12_merge_path_alignment, op13_stripes_collocations, pipeline)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINE_KEY = f"""('0x' || substr(md5(coalesce('=' || source, '') || chr(10) || trim(regexp_replace(translate(
    {_LOWER.replace("coalesce(text, '')", "line")}, '0123456789', '0000000000'),
    '[ \\t-\\r]+', ' ', 'g'), ' ')), 1, 15))::BIGINT"""

ORACLES: dict[str, str] = {
    "op4_pareto_mix": f"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, row_number() OVER () AS nr,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'),
                                                   lambda w: w <> ''))::BIGINT AS size FROM documents),
        per AS (
            SELECT source, count(*) AS n, sum(size)::BIGINT AS source_size,
                   [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM docs GROUP BY source),
        rounds(r, source, cap, weight, target) AS (  -- share out, hold what is full, share the rest again
            SELECT 0, source, 3.0::DOUBLE * source_size, weight, CASE WHEN source_size = 0 THEN 0.0::DOUBLE END FROM per
            UNION ALL
            SELECT r + 1, source, cap, weight, CASE
                WHEN target IS NOT NULL THEN target
                WHEN weight * share >= cap THEN cap
                WHEN NOT bool_or(target IS NULL AND weight * share >= cap) OVER () THEN weight * share END
            FROM (SELECT *, ((SELECT sum(source_size) FROM per) - coalesce(sum(target) OVER (), 0))
                         / sum(CASE WHEN target IS NULL THEN weight END) OVER () AS share FROM rounds)
            WHERE r < 64),
        targets AS (SELECT source, target FROM rounds WHERE r = 64),
        plan AS (
            SELECT per.*, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS certain
            FROM per JOIN targets ON per.source IS NOT DISTINCT FROM targets.source),
        u AS (
            SELECT docs.*, source_size, target, certain, target - certain * source_size AS missing, ceil(n / greatest(sqrt(n), 256.0::DOUBLE)) AS strips,
                   (('0x' || substr(md5('41:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u,
                   least(greatest(CASE WHEN source_size > 0 THEN (target - certain * source_size) / source_size ELSE 0 END, 1e-12),
                         1 - 1e-12) AS p
            FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source),
        r AS (SELECT *, (u / (1 - u)) * ((1 - p) / p) AS q FROM u),
        s AS (SELECT *, floor(q / (1 + q) * strips) AS strip FROM r),
        strip_words AS (SELECT source, strip, sum(size) AS words, any_value(missing) AS missing FROM s WHERE size > 0 GROUP BY ALL),
        summed AS (
            SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY strip ROWS BETWEEN UNBOUNDED PRECEDING
                                                AND 1 PRECEDING), 0) AS before FROM strip_words),
        edges AS (
            SELECT source, min(strip) AS edge, arg_min(before, strip) AS before FROM summed
            WHERE before <= missing AND before + words > missing GROUP BY source),
        z AS (
            SELECT s.*, edge, before FROM s LEFT JOIN edges ON s.source IS NOT DISTINCT FROM edges.source),
        greedy(round, nr, source, size, q, doc_id, room, picked) AS (  -- in order of q, a document that fits is taken
            SELECT 0, nr, source, size, q, doc_id, missing, false FROM z WHERE size > 0 AND missing > 0
            UNION ALL
            SELECT round + 1, nr, source, size, q, doc_id,
                   room - sum(CASE WHEN need <= room THEN size ELSE 0 END) OVER (PARTITION BY source), need <= room
            FROM (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS need
                  FROM greedy WHERE NOT picked AND size <= room)),
        taken AS (
            SELECT z.*, nr IN (SELECT nr FROM greedy WHERE picked) AS picked FROM z),
        remains AS (
            SELECT *, missing - sum(CASE WHEN picked THEN size ELSE 0 END) OVER (PARTITION BY source) AS room FROM taken),
        picks AS (  -- and one more of the edge strip, if that comes nearer
            SELECT * REPLACE (picked OR (coalesce(size > 0 AND strip = edge, false) AND 2 * room > size AND row_number() OVER (
                PARTITION BY source, coalesce(size > 0 AND strip = edge, false) ORDER BY picked, size, q, doc_id) = 1) AS picked)
            FROM remains)
        SELECT doc_id, size, source_size, target, (certain + picked::INT) * size AS taken FROM picks""",
    "op6_line_frequency": f"""
        WITH docs AS (
            SELECT doc_id, source, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS words
            FROM documents),
        tok AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
        pos AS (
            SELECT doc_id, i, md5(concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER o" for k in range(1, 8))})) AS eight
            FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(w, 7) OVER o IS NOT NULL),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, eight) AS n FROM pos),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_rep FROM win, range(0, 8) r(k) WHERE n > 1 GROUP BY doc_id),
        lines AS (
            SELECT doc_id, source, nr, line, len(list_filter(regexp_split_to_array(line, '[ \\t-\\r]+'), lambda w: w <> '')) AS w
            FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line,
                         generate_subscripts(string_split(t, chr(10)), 1) AS nr FROM docs)
            WHERE regexp_matches(line, '[^ \\t-\\r]')),
        keyed AS (SELECT *, {_LINE_KEY} AS key FROM lines),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY doc_id),
        own AS (SELECT doc_id, list(key ORDER BY nr) AS keys FROM keyed GROUP BY doc_id),
        seen AS (SELECT DISTINCT md5(keys::VARCHAR) AS whole, unnest(keys) AS key FROM own),  -- true copies count once
        frequent AS (SELECT key FROM seen GROUP BY key HAVING count(*) > 50),
        gone AS (SELECT doc_id, sum(w) AS n_gone FROM keyed SEMI JOIN frequent USING (key) GROUP BY doc_id),
        f AS (
            SELECT doc_id, len(words)::BIGINT AS n_words,
                   length(regexp_replace(t, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
                   length(t)::BIGINT - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words,
                   coalesce(n_gone, 0)::BIGINT AS n_removed_words
            FROM docs LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_removed_words > 0 AND (
                   n_words - n_removed_words < 5 OR n_words - n_removed_words < 0.2 * n_words)) AS kept
        FROM f""",
    "op7_rarest_token_rules": """
        WITH parts AS (
            SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        split AS (
            SELECT page_id, coalesce(url, '') AS url, regexp_extract(rest, '^[^/?#]*') AS raw,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM parts),
        h AS (
            SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM split),
        rules(rule, verdict, rule_host, rule_path) AS (VALUES
            ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
            ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
            ('com/de/', 'block', 'com', '/de/')),
        best AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rules.verdict, length(rule)) AS verdict
            FROM h JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path)
            GROUP BY page_id),
        patterns(pattern, verdict, regex) AS (VALUES
            ('||spam-farm.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?spam-farm[.]'),
            ('||adserver.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?adserver[.]'),
            ('||casino.', 'block', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?casino[.]'),
            ('/ads/', 'block', '/ads/'), ('/tracker/*.gif|', 'block', '/tracker/.*[.]gif$'),
            ('^popup=1^', 'block', '[^a-z0-9_.%-]popup=1([^a-z0-9_.%-]|$)'),
            ('/phishing^', 'block', '/phishing([^a-z0-9_.%-]|$)'),
            ('||trusted.example.net/ads/', 'allow', '^[a-z][a-z0-9+.-]*://([^/?#]*[.])?trusted[.]example[.]net/ads/')),
        hits AS (
            SELECT page_id, min({v: verdict, p: pattern}) AS hit
            FROM h JOIN patterns ON regexp_matches(u, regex) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(best.verdict, hit.v, 'allow') AS verdict,
               CASE WHEN rule IS NULL THEN hit.p END AS pattern
        FROM h LEFT JOIN best USING (page_id) LEFT JOIN hits USING (page_id)""",
    "op13_stripes_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\n-\\r]')) AS piece FROM documents),
        held AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS words FROM pieces),
        sizes AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM held GROUP BY lang),
        grams AS (
            SELECT lang, words[i:i + k - 1] AS p, count(*) AS f
            FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM held, range(1, 6) t(k))
            GROUP BY ALL HAVING count(*) >= 100),
        candidates AS (SELECT lang, p, f AS a FROM grams WHERE len(p) > 1),
        inside AS (
            SELECT lang, p[i:i + k - 1] AS p, max(a) AS longer
            FROM (SELECT lang, p, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM candidates, range(2, 5) t(k) WHERE len(p) > k)
            GROUP BY ALL),
        own AS (
            SELECT c.* FROM candidates c LEFT JOIN inside i ON c.lang = i.lang AND c.p = i.p WHERE 100 * coalesce(longer, 0) < 100 * a),
        cuts AS (SELECT *, unnest(range(1, len(p))) AS cut FROM own),
        scores AS (
            SELECT cuts.lang, cuts.p, a, cut, x.f AS l, y.f AS r, n,
                   (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
            FROM cuts JOIN sizes ON cuts.lang = sizes.lang
            JOIN grams x ON x.lang = cuts.lang AND x.p = cuts.p[:cut] JOIN grams y ON y.lang = cuts.lang AND y.p = cuts.p[cut + 1:]),
        lowest AS (
            SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM scores
            QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
               phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM lowest QUALIFY rank <= 2000""",
    "op9_content_sort": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)""",
}

"""The registered queries of this package: (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from glossaleaf.llm import alignment, bpe, collocations, exact_dedup, html_text, mixing, quality, secrets, sharding, simhash, substring, token_counts, toxicity
from glossaleaf.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op1_bpe(spark, sf_dir):
    done = bpe.encode(documents(spark, sf_dir), RANKS, PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_secrets(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *map(count, secrets.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op3_substring_dedup(spark, sf_dir):
    done = substring.dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.mark(documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_mixing(spark, sf_dir):
    return mixing.mark(documents(spark, sf_dir))


def op7_token_counts(spark, sf_dir):
    lengths = bpe.lengths(documents(spark, sf_dir), RANKS, PATTERN)
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op8_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op9_simhash(spark, sf_dir):
    return simhash.group(documents(spark, sf_dir))


def op10_quality_rules(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.align(documents(spark, sf_dir), BYTE_LEVEL, PIECES)


def op12_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secrets, op3_substring_dedup, op4_exact_dedup, op5_toxicity, op6_mixing, op7_token_counts, op8_sharding, op9_simhash, op10_quality_rules, op11_alignment, op12_html_text, op13_collocations)}

# every quotient of every source and shard is ranked here; the operator ranks a few of them
MIXING_SQL = f"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
               md5(coalesce(text, '')) AS text_digest,
               md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest
        FROM documents
    ),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows,
               row_number() OVER (ORDER BY source NULLS LAST) AS place
        FROM docs GROUP BY source
    ),
    weighed AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], (place - 1) % 3 + 1) AS weight FROM sources),
    -- shares by weight, again and again, until none is above its limit
    fill(round, place, weight, most, target, open) AS (
        SELECT 0, place, weight, 2.0::DOUBLE * source_size, 0.0::DOUBLE, true FROM weighed
        UNION ALL
        SELECT round + 1, place, weight, most,
               CASE WHEN NOT open THEN target ELSE least(most, level * weight) END,
               open AND level * weight < most
        FROM (
            SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
                       - sum(CASE WHEN open THEN 0 ELSE target END) OVER ())
                      / nullif(sum(CASE WHEN open THEN weight ELSE 0 END) OVER (), 0) AS level
            FROM fill
        )
        WHERE round < (SELECT count(*) FROM sources)
    ),
    targets AS (
        SELECT s.*, f.target, greatest(1, ceil((s.source_size + s.n_rows) / {mixing.SHARD_WORDS}.0))::BIGINT AS n_shards
        FROM sources s JOIN fill f USING (place) WHERE f.round = (SELECT count(*) FROM sources)
    ),
    seats AS (SELECT floor(sum(target) / {mixing.BLOCK} + 0.5)::BIGINT AS n FROM targets),
    source_quotients AS (
        SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place, k) AS nth
        FROM targets, seats, unnest(range(1, (2 + 2 * target / {mixing.BLOCK})::BIGINT)) AS u(k)
    ),
    source_quota AS (SELECT place, count(*) AS quota FROM source_quotients, seats WHERE nth <= n GROUP BY place),
    placed AS (
        SELECT d.*, t.place, t.source_size, t.target,
               ('0x' || substr(digest, 1, 15))::BIGINT % n_shards AS shard,
               ('0x' || substr(digest, 16, 15))::BIGINT AS in_shard
        FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    ),
    shards AS (SELECT place, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY place, shard),
    shard_quotients AS (
        SELECT s.place, s.shard, q.quota,
               row_number() OVER (PARTITION BY s.place ORDER BY s.shard_size / (2 * k - 1) DESC, s.shard, k) AS nth
        FROM shards s JOIN source_quota q USING (place),
             unnest(range(1, (q.quota + 1)::BIGINT)) AS u(k)
        WHERE s.shard_size > 0
    ),
    shard_quota AS (SELECT place, shard, count(*) AS quota FROM shard_quotients WHERE nth <= quota GROUP BY place, shard),
    picks AS (
        SELECT s.*, ceil(shard_size / {mixing.BLOCK}.0)::BIGINT AS n_blocks,
               least(coalesce(quota, 0), 2 * ceil(shard_size / {mixing.BLOCK}.0)::BIGINT) AS q,
               ('0x' || substr(md5('0:blocks:' || s.place || ':' || s.shard), 1, 15))::BIGINT AS pick
        FROM shards s LEFT JOIN shard_quota USING (place, shard)
    ),
    taken_blocks AS (
        SELECT place, shard, b,
               q // n_blocks + ((b * list_extract({list(mixing.PRIMES)}, pick % {len(mixing.PRIMES)} + 1) + pick % n_blocks) % n_blocks < q % n_blocks)::BIGINT AS times
        FROM picks, unnest(range(0, n_blocks)) AS u(b)
    ),
    spans AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY in_shard, doc_id, text_digest
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
        FROM placed
    ),
    took AS (
        SELECT s.doc_id, sum(times * (least(first_word + size, (b + 1) * {mixing.BLOCK}) - greatest(first_word, b * {mixing.BLOCK})))::BIGINT AS taken
        FROM spans s JOIN taken_blocks t
          ON s.place = t.place AND s.shard = t.shard
         AND t.b BETWEEN first_word // {mixing.BLOCK} AND (first_word + size - 1) // {mixing.BLOCK}
        WHERE size > 0 GROUP BY s.doc_id
    )
    SELECT s.doc_id, s.size::BIGINT AS size, s.source_size, s.target, coalesce(k.taken, 0) AS taken
    FROM spans s LEFT JOIN took k USING (doc_id)
"""

# every window of every text is a row here
SUBSTRING_SQL = """
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ),
    windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
        FROM docs, unnest(range(1, greatest(len(w) - 18, 1))) AS u(i)
    ),
    firsts AS (SELECT s, min({'doc': doc_id, 'i': i}) AS f FROM windows GROUP BY s),
    gone AS (
        SELECT DISTINCT doc_id, k
        FROM (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f <> {'doc': doc_id, 'i': i}),
             unnest(range(i, i + 20)) AS v(k)
    ),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM docs),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS t
        FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
    )
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)
"""

# every phrase of one to three words is a row here
COLLOCATION_SQL = """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
        FROM documents
    ),
    split AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
    grams AS (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
        FROM split, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i)
        GROUP BY lang, k, g
    ),
    candidates AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
    cuts AS (
        SELECT c.*, l.f AS l, r.f AS r, cut,
               (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
        JOIN grams l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:cut], ' ')
        JOIN grams r ON r.lang = c.lang AND r.g = array_to_string(c.w[cut + 1:], ' ')
    ),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    inside AS (
        SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
        FROM candidates, unnest([1, 2]) AS u(i) WHERE k = 3 GROUP BY ALL
    ),
    kept AS (
        SELECT c.* FROM lowest c LEFT JOIN inside i ON k = 2 AND i.lang = c.lang AND i.phrase = c.phrase
        WHERE 100 * coalesce(longer, 0) < 50 * a
    ),
    sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {
    "op13_collocations": COLLOCATION_SQL,
    "op3_substring_dedup": SUBSTRING_SQL,
    "op6_mixing": MIXING_SQL,
    "op4_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c
            FROM documents
        )
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY c) AS keep_id,
               count(*) OVER (PARTITION BY c) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY c) AS kept,
               sha256(c) AS text_sha256
        FROM t
    """,
}

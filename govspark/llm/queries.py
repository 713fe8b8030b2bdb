"""Named queries over the corpus tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm import block_topk, budgets, byte_bpe, context_mixing, divergence, filter_audit, jaccard_trees, level_tables, subword_language, suffix_dedup, token_orc, token_transducer, warc_zip
from govspark.llm.common import materialise, prepare, table
from govspark.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(prepare(spark), folder)
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


@query("op1_distribution_divergence")
def distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(table(spark, folder, "documents")).drop("class_distance", "word_distance")


@query("op6_backtracking_bpe")
def backtracking_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return byte_bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_token_orc")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "token-orc")
    docs = table(spark, folder, "documents")
    token_orc.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_orc.token_digests(token_orc.read_tokens(spark, path))


@query("op9_token_transducer")
def transducer_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_transducer.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512)


WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first_id FROM p WHERE octet_length(payload) >= 100 GROUP BY digest
)
SELECT p.page_id, octet_length(payload)::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first_id IS DISTINCT FROM p.page_id AND f.first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS DISTINCT FROM p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


@query("op10_warc_zip", WARC_SQL)
def warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_dir(spark, "warc-zip")
    decided = warc_zip.decide(table(spark, folder, "pages"))
    packages = materialise(warc_zip.write_packages(decided, place), "warc-list")
    # A task per package: a number that adaptive execution leaves as it is.
    return warc_zip.read_packages(packages.repartition(max(1, packages.count())), place)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op2_block_topk", TOPK_SQL)
def block_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return block_topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


@query("op3_subword_language")
def language_predictions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(subword_language.remainder(F.col("doc_id")) == 2, F.lit(False))
    model = subword_language.learn(docs, held_out)
    marked = subword_language.predict(docs.select("doc_id", "text"), model)
    return marked.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_suffix_dedup")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, folder, "documents"))


JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^ \\t-\\r]+') AS words FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams FROM w
), n AS (SELECT doc_id, len(grams)::BIGINT AS n FROM g),
u AS (SELECT doc_id, unnest(grams) AS gram FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach
)
SELECT r.doc_id, any_value(n.n) AS n_shingles, min(reach) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op5_jaccard_trees", JACCARD_SQL)
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_trees.joined(table(spark, folder, "documents"))


def budget_sql(mix: budgets.Mix) -> str:
    """The budgets and the choice of documents in plain SQL."""

    def case(column: str, values: dict, default) -> str:
        arms = " ".join(f"WHEN {column} = '{k}' THEN {v!r}" for k, v in values.items())
        return f"CASE {arms} ELSE {default!r} END" if arms else repr(default)

    def level(name: str, source: str, parents: str, keep: str) -> str:
        by = f"PARTITION BY {parents}" if parents else ""
        weight = case(name, mix.weights.get(name, {}), mix.default)
        return f"""
{name}_w AS (SELECT *, ({weight})::DOUBLE AS w FROM {source}),
{name}_r AS (SELECT *, room / w AS ratio,
  coalesce(sum(room) OVER ({by} ORDER BY room / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER ({by} ORDER BY room / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM {name}_w WHERE w > 0),
{name}_f AS (SELECT *, used + ratio * w_left <= parent_budget * (1 + 1e-12) AS done FROM {name}_r),
{name}_b AS (SELECT {keep}, CASE WHEN done THEN room::DOUBLE ELSE
  (parent_budget - sum(CASE WHEN done THEN room ELSE 0 END) OVER ({by})) * w
  / sum(CASE WHEN done THEN 0.0::DOUBLE ELSE w END) OVER ({by}) END AS budget FROM {name}_f)"""

    domain_of = {s: d for d, sources in mix.domains.items() for s in sources}
    place = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{mix.seed}:' || epoch), 1, 15))::BIGINT"
    return f"""
WITH named AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {case("source", domain_of, mix.rest)} AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS tokens FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::BIGINT * {mix.epochs} AS room FROM named GROUP BY ALL
), tops AS (
  SELECT domain, sum(room) AS room, (SELECT sum(tokens) FROM leaves) * {mix.share!r}::DOUBLE AS parent_budget FROM leaves GROUP BY domain
), {level("domain", "tops", "", "domain")},
langs AS (
  SELECT l.domain, l.lang, sum(l.room) AS room, any_value(b.budget) AS parent_budget
  FROM leaves l JOIN domain_b b USING (domain) GROUP BY l.domain, l.lang
), {level("lang", "langs", "domain", "domain, lang")},
lasts AS (SELECT l.*, b.budget AS parent_budget FROM leaves l JOIN lang_b b USING (domain, lang)),
{level("source", "lasts", "domain, lang", "domain, lang, source, tokens")},
plan AS (
  SELECT *, CASE WHEN tokens > 0 THEN floor(floor(budget + 1e-6) / tokens)::INTEGER ELSE 0 END AS whole FROM source_b
), epochs AS (
  SELECT n.*, p.whole, floor(p.budget + 1e-6)::BIGINT - p.whole * p.tokens AS remaining, unnest(range(0, p.whole + 1))::INTEGER AS epoch
  FROM named n JOIN plan p USING (domain, lang, source)
), placed AS (SELECT *, {place} AS place FROM epochs),
summed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed
)
SELECT doc_id, domain, lang, source, epoch FROM summed WHERE epoch < whole OR (upto <= remaining AND whole < {mix.epochs})
"""


@query("op4_token_budgets", budget_sql(budgets.Mix()))
def token_budgets(spark: SparkSession, folder: str) -> DataFrame:
    chosen = budgets.mixed(table(spark, folder, "documents"))
    empty = F.lit("")
    return chosen.select(
        "doc_id", "domain", F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "epoch"
    )


FILTER_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS copied FROM documents
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (len(words) < 200)::INTEGER + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INTEGER
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INTEGER
         + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * copied::INTEGER AS pattern,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), n AS (
  SELECT part, pattern, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order, [a.bit, b.bit, d.bit, e.bit, g.bit] AS bits
  FROM x a, x b, x d, x e, x g WHERE a.bit + b.bit + d.bit + e.bit + g.bit = 31 AND len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5
), s AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), a AS (SELECT n.*, s.*, pattern & bit > 0 AS fails, pattern & before > 0 AS gone FROM n, s)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (pattern = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(pattern), 1)) FILTER (fails), 0)::BIGINT AS shapley
FROM a GROUP BY part, filter_order, step
"""


@query("op13_filter_audit", FILTER_SQL)
def filter_interactions(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


DIVERGENCE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
o AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
g AS (
  SELECT d.lang, d.source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total, coalesce(any_value(total), 0) AS total
  FROM d LEFT JOIN v USING (lang) LEFT JOIN o USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (total + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), x AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
)
SELECT * FROM x WHERE part = 'pair' OR rank <= 10
"""


@query("op11_level_tables", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return level_tables.audit(table(spark, folder, "documents"))


@query("op12_context_mixing")
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return context_mixing.score(table(spark, folder, "documents"), held_out)

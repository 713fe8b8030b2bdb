"""B3 and M: role-routed retrieval and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from govspark import rules
from govspark.operators import access, audit, retrieve
from govspark.plans.base import SQL_GOLD, Tables, query, sql_redact
from govspark.sources.gold import GOLD

_CENTROIDS = """parts AS (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS p) GROUP BY 1, 2),
queries AS (SELECT label AS query_id, CASE WHEN label % 2 = 0 THEN 'permissive' ELSE 'restricted' END AS role,
  list(x ORDER BY p) AS v FROM parts GROUP BY 1)"""


# Two corpora over the same vectors: the masked one keeps its own numbers, after all raw ones.
_MASKED_FROM = 1_000_000_000
_BOTH = f"""both_corpora AS (SELECT 'permissive' AS reader, vec_id, embedding FROM embeddings
  UNION ALL SELECT 'restricted', vec_id + {_MASKED_FROM}, embedding FROM embeddings)"""


def _ranked(k: int, routed: bool = True) -> str:
    corpus, where = ("both_corpora", " WHERE reader = role") if routed else ("embeddings", "")
    return f"""scored AS (SELECT query_id, role, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 12) AS similarity
  FROM {corpus}, queries{where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM scored),
top AS (SELECT query_id, role, CAST(rank AS INTEGER) AS rank, vec_id, round(similarity, 5) AS similarity FROM ranked WHERE rank <= {k})"""


def label_queries(t: Tables):
    """One query vector per label: the mean of the label's vectors. Even labels are asked by
    the permissive role, odd ones by the restricted role."""
    means = retrieve.centroids(t("embeddings"), "label")
    role = F.when(F.col("label") % 2 == 0, F.lit(access.PERMISSIVE)).otherwise(F.lit(access.RESTRICTED))
    return means.select(F.col("label").alias("query_id"), role.alias("role"), "embedding")


@query(
    "b3_corpus_routing",
    f"""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'raw' ELSE 'masked' END AS corpus,
  sha256(CASE WHEN role = 'assistant' THEN text ELSE {sql_redact('text')} END) AS visible_hash FROM conversations""",
)
def corpus_routing(t: Tables):
    """Each reader sees the raw or the masked form of a text, by role."""
    role = F.when(F.col("role") == "assistant", F.lit(access.PERMISSIVE)).otherwise(F.lit(access.RESTRICTED))
    routed = t("conversations").withColumn("corpus", retrieve.corpus_of(role))
    return retrieve.visible_text(routed, "text").select(
        "conv_id", "turn", "role", "corpus", F.sha2("visible_text", 256).alias("visible_hash")
    )


@query("m1_vector_top_k", f"WITH {_CENTROIDS}, {_ranked(10, routed=False)}\nSELECT query_id, rank, vec_id, similarity FROM top")
def vector_top_k(t: Tables):
    return retrieve.top_k(label_queries(t), t("embeddings"))


def _corpora(t: Tables):
    """Raw and masked corpus: the same vectors under numbers of their own."""
    raw = t("embeddings").select("vec_id", "embedding")
    return {retrieve.RAW: raw, retrieve.MASKED: raw.withColumn("vec_id", F.col("vec_id") + _MASKED_FROM)}


@query(
    "m2_routed_top_k",
    f"""WITH {_CENTROIDS}, {_BOTH}, {_ranked(5)}
SELECT query_id, rank, vec_id, similarity, CASE WHEN role = 'permissive' THEN 'raw' ELSE 'masked' END AS corpus FROM top""",
)
def routed_top_k(t: Tables):
    return retrieve.routed_top_k(label_queries(t), _corpora(t), k=rules.RETRIEVE_TOP_K)


def _row(columns) -> str:
    return "concat_ws(', ', " + ", ".join(f"'{c}: ' || CAST({c} AS VARCHAR)" for c in columns) + ")"


@query(
    "m3_row_serialisation",
    f"""WITH {SQL_GOLD}
SELECT order_id, sha256({_row(GOLD)}) AS permissive_hash, sha256({_row([c for c in GOLD if c in rules.ALLOWED_COLUMNS])}) AS restricted_hash FROM gold""",
)
def row_serialisation(t: Tables):
    full = audit.serialise_columns(access.role_columns(GOLD, access.PERMISSIVE, None))
    restricted = audit.serialise_columns(access.role_columns(GOLD, access.RESTRICTED, access.ColumnPolicy()))
    return t.gold().select(
        "order_id", F.sha2(full, 256).alias("permissive_hash"), F.sha2(restricted, 256).alias("restricted_hash")
    )


def _cell(name: str, value):
    return F.struct(F.lit(name).alias("columnName"), value.cast("string").alias("columnValue"))


def label_hits(t: Tables, k: int):
    """Top-k hits with content: the text of the document of that number, masked for the
    restricted role, and for labelled documents also a row of cells."""
    queries = label_queries(t)
    hits = retrieve.routed_top_k(queries, _corpora(t), k=k).withColumn("vec_id", F.col("vec_id") % _MASKED_FROM)
    # The ids that the other tables are cut to before anything of them is shuffled.
    wanted = hits.select("vec_id").distinct()
    labels = t("labels").select(F.col("doc_id").alias("vec_id"), "quality", "toxic").join(wanted, "vec_id", "left_semi")
    documents = t("documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source").join(wanted, "vec_id", "left_semi")
    joined = hits.join(documents, "vec_id", "left").join(labels, "vec_id", "left")
    cells = F.array(
        _cell("vec_id", F.col("vec_id")), _cell("lang", F.col("lang")), _cell("source", F.col("source")),
        _cell("quality", F.col("quality")), _cell("toxic", F.col("toxic")),
    )
    content = F.struct(
        F.when(F.col("quality").isNotNull(), cells).alias("row"), F.col("visible_text").alias("text")
    )
    return retrieve.visible_text(joined, "text").select("query_id", "rank", content.alias("content"))


def _hits(k: int) -> str:
    return f"""{_CENTROIDS}, {_BOTH}, {_ranked(k)},
hits AS (SELECT query_id, rank,
  CASE WHEN quality IS NOT NULL THEN concat_ws(', ', 'vec_id: ' || vec_id % {_MASKED_FROM}, 'lang: ' || lang, 'source: ' || source,
    'quality: ' || quality, 'toxic: ' || toxic) END AS row_text,
  CASE WHEN role = 'permissive' THEN text ELSE {sql_redact('text')} END AS text
  FROM top LEFT JOIN documents d ON vec_id % {_MASKED_FROM} = d.doc_id LEFT JOIN labels l ON vec_id % {_MASKED_FROM} = l.doc_id)"""


@query(
    "m4_invoke_context",
    f"""WITH {_hits(10)}, pieces AS (SELECT query_id, rank, nullif(CASE WHEN row_text IS NOT NULL THEN row_text ELSE text END, '') AS part FROM hits),
joined AS (SELECT query_id, count(part) AS parts, left(coalesce(string_agg(part, chr(10) ORDER BY rank), ''), 10000) AS context FROM pieces GROUP BY 1)
SELECT query_id, CAST(parts AS INTEGER) AS parts, CAST(length(context) AS INTEGER) AS context_chars, sha256(context) AS context_hash FROM joined""",
)
def invoke_context(t: Tables):
    return _hashed(retrieve.invoke_context(label_hits(t, rules.INVOKE_TOP_K)))


@query(
    "m5_retrieve_context",
    f"""WITH {_hits(5)}, pieces AS (SELECT query_id, rank, nullif(CASE WHEN text IS NOT NULL THEN text ELSE row_text END, '') AS part FROM hits),
joined AS (SELECT query_id, count(part) AS parts, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY rank), '') AS context FROM pieces GROUP BY 1)
SELECT query_id, CAST(parts AS INTEGER) AS parts, CAST(length(context) AS INTEGER) AS context_chars, sha256(context) AS context_hash FROM joined""",
)
def retrieve_context(t: Tables):
    return _hashed(retrieve.retrieve_context(label_hits(t, rules.RETRIEVE_TOP_K)))


def _hashed(contexts):
    return contexts.select(
        "query_id", "parts", F.length("context").alias("context_chars"), F.sha2("context", 256).alias("context_hash")
    )


@query(
    "m6_context_status",
    """SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'no_context' ELSE 'ok' END AS context_status,
  CASE WHEN coalesce(text, '') = '' THEN 'Could not retrieve data. Please try again.' END AS fallback_reply
FROM (SELECT conv_id, turn, conv_id * 16 + turn AS asked FROM conversations) LEFT JOIN documents ON asked = doc_id""",
)
def context_status(t: Tables):
    """Each turn asks for the document with a number of its own; not every number has one."""
    asked = t("conversations").selectExpr("conv_id", "turn", "conv_id * 16 + turn AS query_id")
    contexts = t("documents").selectExpr("doc_id AS query_id", "text AS context")
    flagged = retrieve.with_context_status(asked, contexts)
    return flagged.select("conv_id", "turn", "context_status", "fallback_reply")

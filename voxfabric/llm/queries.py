"""The operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfabric.llm import chat, exact_dedup, fingerprints, hmm, language, lexical, mixing, packing, quality, similarity_join, substring_dedup, token_index, whitening
from voxfabric.llm.common import fold, stored


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_documents(spark, sf_dir))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_index.write(_documents(spark, sf_dir))
    return token_index.read_all(index).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def domain_of(source: str = "source") -> Column:
    """The tables have no domain: sources fall into two by a hash of their names."""
    return F.when(F.md5(F.coalesce(F.col(source), F.lit(""))) < "8", "a").otherwise("b")


#: Target weights of the mix, by level and name; 1 where none is given.
WEIGHTS = {"domain": {"a": 3, "b": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the corpus's tokens, dealt by WEIGHTS, in up to two epochs: one row per chosen document and epoch."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, domain_of(), WEIGHTS, fraction=(3, 4), max_epochs=2, seed=7).drop("text")


def _fill_sql(nodes: str, parents: str, name: str, out: str) -> str:
    """Shares of children under their caps, as mixing.fill finds them."""
    by = f"PARTITION BY {parents} " if parents else ""
    cols = f"{parents}, {name}" if parents else name
    return f"""
{out}_m AS (
  SELECT *, CAST(cap AS HUGEINT) * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= CAST(budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * weight AS is_full
  FROM {nodes} WINDOW o AS ({by}ORDER BY CAST(cap AS DOUBLE) / weight, {name})
),
{out} AS (
  SELECT {cols}, CAST(CASE WHEN is_full THEN cap ELSE
    (budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0)) * weight // sum(CASE WHEN NOT is_full THEN weight END) OVER ({by}) END AS HUGEINT) AS budget
  FROM {out}_m
)"""


def mix_sql(documents: str, fraction: str, max_epochs: int, seed: int) -> str:
    """CTEs from a relation of documents to picked(doc_id, mix_epoch, ...), for DuckDB."""
    langs = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS["lang"].items())
    domains = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS["domain"].items())
    return rf"""
d AS (
  SELECT *, CASE WHEN md5(coalesce(source, '')) < '8' THEN 'a' ELSE 'b' END AS dom,
         coalesce(lang, 'none') AS lng, coalesce(source, 'none') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n
  FROM {documents}
),
leaf AS (SELECT dom, lng, src, sum(n) AS tokens, sum(n) * {max_epochs} AS cap FROM d GROUP BY ALL),
n1 AS (SELECT dom, sum(cap) AS cap, CASE dom {domains} ELSE 1 END AS weight, (SELECT sum(tokens) * {fraction} FROM leaf) AS budget FROM leaf GROUP BY dom),
{_fill_sql("n1", "", "dom", "s1")},
n2 AS (SELECT dom, lng, sum(cap) AS cap, CASE lng {langs} ELSE 1 END AS weight, any_value(budget) AS budget FROM leaf JOIN s1 USING (dom) GROUP BY dom, lng),
{_fill_sql("n2", "dom", "lng", "s2")},
n3 AS (SELECT dom, lng, src, sum(cap) AS cap, 1 AS weight, any_value(budget) AS budget FROM leaf JOIN s2 USING (dom, lng) GROUP BY dom, lng, src),
{_fill_sql("n3", "dom, lng", "src", "s3")},
share AS (
  SELECT dom, lng, src, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest
  FROM leaf JOIN s3 USING (dom, lng, src)
),
placed AS (
  SELECT *, md5('{seed}-' || CAST(whole AS VARCHAR) || '-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM d JOIN share USING (dom, lng, src)
),
timed AS (
  SELECT *, whole + CASE WHEN rest > 0 AND sum(n) OVER (PARTITION BY dom, lng, src ORDER BY u) <= rest THEN 1 ELSE 0 END AS times FROM placed
),
picked AS (SELECT * EXCLUDE (dom, lng, src, n, whole, rest, u, times), CAST(unnest(range(0, CAST(times AS BIGINT))) AS INTEGER) AS mix_epoch FROM timed)"""


OP4_SQL = f"WITH {mix_sql('documents', '3 // 4', 2, 7)}\nSELECT doc_id, lang, source, mix_epoch FROM picked"


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.train(language.training_rows(docs))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op2_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return hmm.score(docs, fold() != 1).withColumn("held_out", fold() == 1)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0).select("doc_id", "quality")
    net = quality.train(docs, labels)
    return quality.score(docs, net).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op3_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.join(_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13),
h AS (SELECT s.doc_id, i, md5_number(array_to_string(w[i : i + 12], ' ')) AS h FROM s JOIN t USING (doc_id)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM hit, (SELECT unnest(range(13)) AS k)),
lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
         CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(js, j)) END AS k
  FROM t LEFT JOIN lost USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search(lexical.index(_documents(spark, sf_dir)), items, k=20)


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS places FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // places)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


#: Text of both turns of conversation -7: a backslash and marks of templates.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations, whose records are turns, and conversation -7, whose record is a list of messages."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(HARD_TEXT).alias("content"))
    hard = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    done = stored(chat.formatted(chat.canonical_turns(rows.unionByName(hard, allowMissingColumns=True))))
    loss = F.array_join("loss", "")
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (  -- one character is added for each backslash, mark, and place where three # begin
  SELECT *, list_sum(list_transform([role, text], lambda s: len(s) + len(s) - len(replace(s, '\', '')) + (len(s) - len(replace(s, '</turn>', ''))) // 7
           + coalesce(list_sum(list_transform(regexp_extract_all(s, '#{3,}'), lambda r: len(r) - 2)), 0))) + (len(role) - len(replace(role, ':' || chr(10), ''))) // 2 AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = whitening.fit(rows, components=32)
    error = whitening.identity_error(rows, model)
    return whitening.whiten(rows, model).withColumns({"n": F.lit(model.n).cast("long"), "identity_error": F.lit(error).cast("double")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op9_token_index": op9_token_index,
        "op4_mixing": op4_mixing,
        "op7_fingerprints": op7_fingerprints,
        "op3_similarity_join": op3_similarity_join,
        "op8_quality": op8_quality,
        "op2_hmm_score": op2_hmm_score,
        "op10_substring_dedup": op10_substring_dedup,
        "op6_language_id": op6_language_id,
        "op5_exact_dedup": op5_exact_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_chat_format": op12_chat_format,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": OP4_SQL,
        "op10_substring_dedup": OP10_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op11_lexical_search": OP11_SQL,
        "op12_chat_format": OP12_SQL,
    }

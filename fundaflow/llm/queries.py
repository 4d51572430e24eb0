"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundaflow.llm import chat, licenses, mixing, neardup, packing, pages, phrases, quality, rules, secrets, spelling, tokens, vectors
from fundaflow.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary())


_TEST_TEXT = "</s>[INST] ok [/INST]"

OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after,
    regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[])(\\*)((?:\|(?:im_start|im_end|endoftext|startoftext)\|>)|(?:/?s>)|(?:/?INST\])|(?:<(?:/)?SYS>>))', '\1\\\2\3', 'g') AS role_out,
    regexp_replace(text, '([<\[])(\\*)((?:\|(?:im_start|im_end|endoftext|startoftext)\|>)|(?:/?s>)|(?:/?INST\])|(?:<(?:/)?SYS>>))', '\1\\\2\3', 'g') AS text_out
  FROM rows
), moved AS (
  SELECT *, (coalesce(before, 'start') || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>tool', 'tool>assistant') AS ok
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(length(role_out) + length(text_out) + 24)::BIGINT AS formatted_chars,
  bool_and(ok) AS valid,
  bool_and(ok) AND bool_or(after IS NULL AND role = 'assistant') AS complete
FROM moved GROUP BY conv_id
"""


@register("op2_chat_formatting", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TEST_TEXT).alias("text"),
    )
    return chat.digests(chat.formatted(rows.union(extra)))


@register("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP4_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.other
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degree AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT l.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id::BIGINT AS component_id, l.vec_id = l.component_id AS kept
FROM least l LEFT JOIN degree d ON d.vec_id = l.vec_id
"""


@register("op4_embedding_near_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


@register("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


#: Shares of tokens by language.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def labelled_languages(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The documents of the labelled table, with their language as domain."""
    ids = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return docs.select("doc_id", "text", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")


@register("op8_source_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, _ = mixing.mixed(docs, labelled_languages(spark, sf_dir, docs), TARGETS)
    return out


@register("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@register("op10_secret_scans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secret_spans(table(spark, sf_dir, "documents")))


@register("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@register("op12_license_scans")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.detections(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece_text, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece_text FROM documents)
), starts AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0
), totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang
), counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30
), candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f)::HUGEINT AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
  SELECT lang, array_to_string(w[first_at:first_at + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(generate_series(1, k - size + 1)) AS first_at FROM (SELECT *, unnest(generate_series(2, k - 1)) AS size FROM candidates WHERE k > 2)) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@register("op13_phrase_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))

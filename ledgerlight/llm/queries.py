"""The queries of this subpackage: each applies one operator to its whole table.

``QUERIES`` maps names to functions of (spark, folder of the tables); ``ORACLES``
holds DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import chat_format, collocations, doc_fingerprint, hard_negatives, html_extraction, inverted_multi_index, lang_id, packing, secret_scan, simhash_dedup, source_mix, token_store, toxicity
from ledgerlight.llm.byte_words import held_out

#: Of the public tokenizer files, the one that queries use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document, learning from labelled ones that are not held out. One row per row; null and empty texts score as texts without evidence, a null id is held out by the rule of an empty one."""
    docs, labels = (_table(spark, sf_dir, t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    out = held_out(F.col("doc_id"), 3, 1)
    model = toxicity.train(toxicity.with_labels(docs.filter(~out), labels))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation and conversation -7, and reads the turns back from the output.

    Null texts and roles are empty; ties in turn go by role and text; a null conv_id is one conversation.
    """
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) AS t(conv_id, turn, role, text)", args={"said": said})
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_chats(chat_format.records_of_turns(rows)).select("conv_id", "formatted")
    read = done.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.col("loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP2_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '\[(/?INST\]|OUT\]|/?ROLE\]|SAYS\])', '[\\\1', 'g'), '<(/?s>|</?SYS>>)', '<\\\1', 'g') AS safe FROM said
), marked AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' || safe || ' [/INST]' WHEN 'assistant' THEN '[OUT] ' || safe || '</s>'
    WHEN 'system' THEN '<<SYS>>' || safe || '<</SYS>>' ELSE '[ROLE]' || role || '[SAYS]' || safe || '[/ROLE]' END AS piece FROM escaped
), loss AS (
  SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS t,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole, string_agg(piece, '' ORDER BY turn, role, text) AS formatted, count(*) AS n
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n AS n_turns, sha256(whole) AS turns_sha256, length(t)::BIGINT AS loss_chars, sha256(t) AS loss_sha256, length(formatted)::BIGINT AS formatted_chars FROM loss
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every document. One row per row; a null text has no candidates and a null hash, a null source is an empty path."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    scanned = secret_scan.scan(docs, secret_scan.train_for(docs), path_col="source")
    return scanned.select("doc_id", "secret_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets", F.sha2("redacted", 256).alias("redacted_sha256"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints every document and its edited text. One row per row; null texts are empty, null ids come last, equal ids in order of a hash of their text."""
    return doc_fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document. One row per row; texts without a letter are ``und``, ties go to the smaller language."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    found = lang_id.predict(docs, lang_id.train(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches the vectors whose id is divisible by 100 among all. Null, zero and odd vectors and null ids take no part; ties go to the smaller id, repeated ids are one."""
    return inverted_multi_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups every document by its fingerprint. One row per row; null and empty texts have fingerprint zero, null ids name a group only if it has no other."""
    return simhash_dedup.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every document's ids and reads the files back. One row per row; null texts are the end id alone, null ids come first, equal ids in order of their text."""
    docs = _table(spark, sf_dir, "documents")
    return token_store.read_token_shards(token_store.write_token_shards(docs, tokenizer_path()))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. One row per row; null texts have size 0, null sources come last, equal rows are taken together."""
    return source_mix.mixed_words(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document. One row per piece; null texts are the end id alone, null and repeated ids are packed like others, and equal pieces take places as they come."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mines every document's phrases by lang. Null texts are empty, a null lang is ``und``, repeated rows count each time."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang), grams AS (
  SELECT lang, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase FROM words, (VALUES (1), (2), (3), (4)) AS t(k)
), f AS (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM f, (VALUES (1), (2), (3)) AS t(k) WHERE k < len(w)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score
  FROM cuts AS c JOIN f AS h ON c.lang = h.lang AND c.head = h.phrase JOIN f AS t ON c.lang = t.lang AND c.rest = t.phrase
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longer FROM f, (VALUES (2), (3)) AS t(k), (VALUES (1), (2), (3)) AS u(i) WHERE k < len(w) AND i + k - 1 <= len(w) GROUP BY 1, 2
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM weakest JOIN totals USING (lang) LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
WHERE rank <= 2000
"""

def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts every page's main text. One row per row; null html gives an empty text, null urls are one empty host."""
    return html_extraction.extract_texts(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mines hard negatives for the vectors whose id is divisible by 100 among all. Null labels, null and odd vectors and null ids take no part; ties go to the smaller id, of rows that share an id one takes part."""
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH rows_in AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * v::DOUBLE)::BIGINT for v in embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)])::BIGINT AS score
  FROM rows_in AS a JOIN rows_in AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_chat_format": op2_chat_format,
    "op3_secret_scan": op3_secret_scan,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_language_id": op5_language_id,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_store": op8_token_store,
    "op9_source_mix": op9_source_mix,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_page_text": op12_page_text,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {"op2_chat_format": OP2_SQL, "op11_collocations": OP11_SQL, "op13_hard_negatives": OP13_SQL}

"""The registered queries of this folder: each applies its operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm import alignment, collocations, decontaminate, embeddings, html, jaccard, langid, licenses, lm_score, packing, repeats, token_counts, toxicity
from phrasemill.llm.common import held_out, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.recognise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), "sequence", "licences", "n_unknown")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.clustered(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_toxic", "spans",
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled of good quality, the background is all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    # labels grow with the corpus, so they are merged and never broadcast: one plan at every size
    marked = docs.join(good.hint("merge"), "doc_id", "left")
    model = lm_score.learn(marked, kept=["doc_id"])
    return lm_score.score_learned(model, ["doc_id"]).select("doc_id", "n_tokens", "score")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    file = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.add_token_counts(docs, file).drop("text")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~held_out(F.col("doc_id"))))
    out = langid.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(docs, *files)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_html_extraction": op4_html_extraction,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_language_id": op10_language_id,
    "op11_token_alignment": op11_token_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_phrase_collocations": op13_phrase_collocations,
}

def _license_sql() -> str:
    """The operator's tables as SQL: a CASE for each phrase and a replacement for each rule."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    phrases = ",\n".join(f"CASE WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)} END" for n, p in licenses.PHRASES)
    steps, last = [], "seqs"
    for i, (name, ids) in enumerate(licenses.RULES):
        pattern = quote(f";{';;'.join(ids)};")
        steps.append(f"""r{i} AS (SELECT doc_id, n, sequence, u, replace(rest, {pattern}, '|') AS rest,
  CASE WHEN contains(rest, {pattern}) AND NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names
  FROM {last})""")
        last = f"r{i}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {quote(licenses.SENTENCE_END)}),
    lambda s: regexp_matches(s, {quote(licenses.CANDIDATE)})) AS parts FROM documents
), plain AS (
  SELECT doc_id, list_transform(parts, lambda s: trim(regexp_replace(regexp_replace(
    regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' +', ' ', 'g'))) AS parts FROM cut
), known AS (
  SELECT doc_id, list_transform(parts, lambda s: struct_pack(s := s, ids := list_filter([{phrases}], lambda x: x IS NOT NULL))) AS parts
  FROM plain
), named AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda x: CASE WHEN len(x.ids) > 0 THEN x.ids
    WHEN regexp_matches(x.s || ' ', {quote(licenses.LICENCE_WORD)}) THEN ['{licenses.UNKNOWN}'] ELSE [] END), lambda x: len(x) > 0) AS ids
  FROM known
), seqs AS (
  SELECT doc_id, len(ids) AS n, array_to_string(flatten(ids), ';') AS sequence,
    len(list_filter(flatten(ids), lambda x: x = '{licenses.UNKNOWN}')) AS u,
    ';' || replace(array_to_string(flatten(ids), ';'), ';', ';;') || ';' AS rest, CAST([] AS VARCHAR[]) AS names FROM named
), {", ".join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, sequence, array_to_string(names, ',') AS licences, CAST(u AS BIGINT) AS n_unknown
FROM {last}
"""


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op1_license_scan": _license_sql(),
    "op9_benchmark_decontamination": f"""
WITH items AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
  WHERE len(w) > 0 AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM items)
), docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM docs CROSS JOIN sizes)
), found AS (SELECT doc_id, s, size, item FROM grams JOIN windows USING (size, win)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op13_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), words AS (SELECT lang, list_filter(string_split_regex(p, '[ \x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
places AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words CROSS JOIN (VALUES (1), (2), (3), (4)) s(size)),
f AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= 30
), cand AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + part - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, size - part + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS part FROM cand))
), covered AS (
  SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE 100::HUGEINT * i.longer >= 80::HUGEINT * c.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}

"""One registered query per operator, each over its whole table, and the SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plugload.llm import (
    archives, collocations, factorization, hnsw, maintext, mixing, packing, quality, quoting, simhash, substrings, toxicity, whitening,
)
from plugload.llm.common import table


def toxicity_model(spark, d):
    """Learnt from labelled rows outside the held-out fifth."""
    labels = table(spark, d, "labels").where(~held_out())
    return toxicity.train(table(spark, d, "documents").select("doc_id", "text"), labels)


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, d), carry=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_warc(spark, d):
    return archives.through_archives(table(spark, d, "pages"))


def op3_quality_rules(spark, d):
    verdicts = quality.host_verdicts(table(spark, d, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_quotes(spark, d):
    return quoting.without_quotes(table(spark, d, "conversations"))


def op5_main_text(spark, d):
    pages = maintext.extract(table(spark, d, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_simhash(spark, d):
    found = simhash.near_duplicates(table(spark, d, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark, d):
    placed = packing.pack_documents(table(spark, d, "documents"), tokenizer_file())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_hnsw(spark, d):
    return hnsw.near_vectors(table(spark, d, "embeddings"))


def op9_suffix_dedup(spark, d):
    cleaned = substrings.remove_repeats(table(spark, d, "documents"), carry=["doc_id"])
    return cleaned.select(
        "row.doc_id", F.col("bytes").alias("n_bytes"), F.col("removed").alias("n_removed"),
        F.col("spans").alias("n_spans"), F.col("sha256").alias("kept_sha256"),
    )


def op10_mixing(spark, d):
    mixed = mixing.mix(table(spark, d, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op11_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


METADATA = ["n_chars"]


def quality_model(spark, d):
    """Learnt from labelled rows outside the held-out quarter."""
    labels = table(spark, d, "labels").where(~held_out_quarter())
    return factorization.train(table(spark, d, "documents"), labels, metadata=METADATA)


def held_out_quarter():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op12_quality(spark, d):
    docs = table(spark, d, "documents")
    scored = factorization.score(docs, quality_model(spark, d), METADATA, carry=["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out_quarter(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op13_whitening(spark, d):
    white = whitening.whitened(table(spark, d, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_quotes": op4_quotes,
    "op5_main_text": op5_main_text,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_hnsw": op8_hnsw,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH base AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(0, 5) AS offsets(k) GROUP BY doc_id
), measured AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN covered c USING (doc_id)
), ruled AS (
  SELECT *, n_words < 10 AS short, n_repeat_words * 100 > n_words * 20 AS repetitive, n_symbols * 10 > word_chars AS symbols,
         n_dup_lines * 10 > n_lines * 3 AS copied_lines
  FROM measured
), failures AS (
  SELECT source, rule, count(*) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k
  FROM (UNPIVOT (SELECT source, short, repetitive, symbols, copied_lines FROM ruled WHERE source IS NOT NULL)
        ON short, repetitive, symbols, copied_lines INTO NAME rule VALUE failed) GROUP BY source, rule
), sums AS (
  SELECT rule, count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk FROM failures GROUP BY rule
), prior AS (
  SELECT rule, mean, 1 / least(greatest(CASE WHEN mean * (1 - mean) * (n - nn / n - (hosts - 1)) > 0
    THEN (kk - mean * mean * n - mean * (1 - mean) * (hosts - 1)) / (mean * (1 - mean) * (n - nn / n - (hosts - 1))) ELSE 0 END, 0.001), 0.999) - 1 AS weight
  FROM sums
), hosts AS (
  SELECT source, max((k + weight * mean) / (n + weight)) AS worst FROM failures JOIN prior USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       NOT (short OR repetitive) AND NOT coalesce(worst > 0.5, false) AS kept
FROM ruled LEFT JOIN hosts USING (source)
""",
    "op4_quotes": r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, pos, line, len(regexp_replace(regexp_extract(line, '^ {0,3}((?:> ?)+)', 1), '[^>]', '', 'g')) AS level,
         trim(lower(regexp_replace(regexp_replace(line, '^ {0,3}((?:> ?)+)', ''), '\s+', ' ', 'g'))) AS words
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations)
), own AS (
  SELECT conv_id, words, min(turn) AS first_turn FROM lines WHERE level = 0 AND words <> '' GROUP BY conv_id, words
), quoted AS (
  SELECT * FROM lines WHERE level > 0 AND words <> ''
), sourced AS (
  SELECT q.conv_id, q.turn, q.level, coalesce(
    (SELECT {'c': o.conv_id, 't': o.first_turn} FROM own o WHERE o.conv_id = q.conv_id AND o.words = q.words AND o.first_turn < q.turn),
    (SELECT min({'c': o.conv_id, 't': o.first_turn}) FROM own o WHERE o.words = q.words AND o.conv_id =
      (CASE WHEN q.conv_id = (SELECT min(p.conv_id) FROM own p WHERE p.words = q.words) THEN (SELECT max(p.conv_id) FROM own p WHERE p.words = q.words)
       ELSE (SELECT min(p.conv_id) FROM own p WHERE p.words = q.words) END) AND o.conv_id <> q.conv_id)) AS source
  FROM quoted q
), links AS (
  SELECT conv_id, turn, level, source.c AS from_conv, source.t AS from_turn, count(*) AS n FROM sourced WHERE source IS NOT NULL GROUP BY ALL
), answers AS (
  SELECT conv_id, turn, arg_max(from_turn, (n, from_turn)) AS parent FROM links WHERE level = 1 AND from_conv = conv_id GROUP BY conv_id, turn
), up AS (
  SELECT conv_id, turn, parent AS root FROM answers
  UNION ALL SELECT up.conv_id, up.turn, a.parent FROM up JOIN answers a ON a.conv_id = up.conv_id AND a.turn = up.root
), replies AS (
  SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0) AS reply, count(*) FILTER (level > 0 AND words <> '') AS n_quoted
  FROM lines GROUP BY conv_id, turn
), every AS (
  SELECT c.conv_id, c.turn, c.role, trim(coalesce(r.reply, '')) AS reply, coalesce(r.n_quoted, 0) AS n_quoted,
         CAST(coalesce((SELECT sum(n) FROM links l WHERE l.conv_id = c.conv_id AND l.turn = c.turn), 0) AS BIGINT) AS n_linked,
         a.parent AS parent_turn, coalesce((SELECT min(root) FROM up WHERE up.conv_id = c.conv_id AND up.turn = c.turn), c.turn) AS root_turn
  FROM conversations c LEFT JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.turn
  LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn
)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn, turn, role, reply) AS position FROM every
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM lists, range(1, 4) AS sizes(m))
), f AS (
  SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 10
), cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)
), priced AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
), best AS (
  SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS phrase
        FROM f WHERE m = 3) GROUP BY lang, phrase
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score
  FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE b.m = 3 OR o.most IS NULL OR 100 * o.most < 50 * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}

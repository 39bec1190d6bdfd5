"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import (
    byte_bpe, chat_tools, decontaminate, fill_middle, langid, lexical_search, line_dedup, ngram_join, packing, suffix_dedup, token_counts,
    toxicity, vector_join,
)
from tickloom.llm.arrowtools import id_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat elsewhere."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labelled ones."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = id_remainder("doc_id", 5) == 0
    model = toxicity.language_model(docs)
    out = toxicity.score(docs, model, toxicity.train(docs.where(~held), labels.where(~held), model))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the boilerplate lines of their host."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", line_dedup.url_host("url").alias("host"), line_dedup.html_text("html").alias("text"))
    out = line_dedup.drop_boilerplate(pages, "host", "text", n_lines="n_lines", n_dropped="n_dropped")
    return out.select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more."""
    return vector_join.link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose shingle sets are similar."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in every document."""
    parts = decontaminate.automata(_table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), parts).drop("items")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    held = id_remainder("doc_id", 4) == 2
    model = langid.train(docs.where(~held))
    out = langid.identify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: All pairs: for a few hundred vectors.
_OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)
"""

_OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM words, sizes)),
hits AS (SELECT DISTINCT doc_id, i, spots.n, item_id FROM spots JOIN windows USING (n, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: Schemas of the tools that op10 makes of the turns of a chat.
TOOL_SCHEMAS = [
    ("open", '{"type":"object","required":["query","turn"],"additionalProperties":false,"properties":{"query":{"type":"string","minLength":1,"maxLength":400},"turn":{"type":"integer","minimum":0}}}'),
    ("follow", '{"type":"object","required":["query","turn","after"],"additionalProperties":false,"properties":{"query":{"type":"string","minLength":1,"maxLength":400},"turn":{"type":"integer","minimum":1},"after":{"type":"object","required":["$result"]}}}'),
]


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Read every user turn as an assistant's tool call and every assistant turn as the result of the turn before.

    The first turns open the chat; of the later ones every fourth refers to the next call, which comes after it, the others
    to the result of turn 0.
    """
    call_id = F.concat_ws("-", F.lit("call"), "conv_id", "turn")
    needed = F.when(F.col("turn") % 4 == 0, F.col("turn") + 2).otherwise(0)
    after = F.when(F.col("turn") > 1, F.struct(F.concat_ws("-", F.lit("call"), "conv_id", needed).alias("$result")))
    arguments = F.struct(F.coalesce("text", F.lit("")).alias("query"), "turn", after.alias("after"))
    name = F.when(F.col("turn") > 1, "follow").otherwise("open")
    called = F.to_json(F.struct(F.array(F.struct(call_id.alias("id"), name.alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    answered = F.to_json(F.struct(
        F.concat_ws("-", F.lit("call"), "conv_id", F.col("turn") - 1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    made = F.when(F.col("role") == "user", called).when(F.col("role") == "assistant", answered)
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), F.coalesce(made, "text").alias("text"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls made of all conversations, linked, ordered, validated and serialised."""
    messages = tool_messages(_table(spark, sf_dir, "conversations"))
    out = chat_tools.linked_tools(
        chat_tools.tool_calls(messages), chat_tools.tool_results(messages), spark.createDataFrame(TOOL_SCHEMAS, "name string, schema string"))
    return out.select("conv_id", "call_id", "turn", "result_turn", "name", "status", "level", "valid", "errors",
                      F.length("json").cast("long").alias("n_chars"), F.md5("json").alias("json_md5"))


_OP10_SQL = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, concat_ws('-', 'call', conv_id, turn) AS call_id, turn, CASE WHEN turn > 1 THEN 'follow' ELSE 'open' END AS name,
    CASE WHEN turn > 1 THEN concat_ws('-', 'call', conv_id, CASE WHEN turn % 4 = 0 THEN turn + 2 ELSE 0 END) END AS needs,
    coalesce(text, '') AS q, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE role = 'user'),
results AS (
  SELECT conv_id, concat_ws('-', 'call', conv_id, turn - 1) AS call_id, turn AS result_turn, coalesce(text, '') AS content,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE role = 'assistant'),
known AS (SELECT DISTINCT c.conv_id, c.call_id, n.call_id AS needs FROM calls c LEFT JOIN calls n ON n.conv_id = c.conv_id AND n.call_id = c.needs),
ordered AS (
  SELECT conv_id, call_id, 0 AS level FROM known WHERE needs IS NULL
  UNION ALL SELECT k.conv_id, k.call_id, level + 1 FROM known k JOIN ordered o ON o.conv_id = k.conv_id AND o.call_id = k.needs),
paired AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, r.result_turn, c.name, c.needs, q, content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.nth = r.nth),
written AS (
  SELECT *, concat('{"arguments":', CASE WHEN status = 'orphan' THEN 'null' ELSE concat('{',
      CASE WHEN name = 'follow' THEN concat('"after":{"$result":"', needs, '"},') ELSE '' END,
      '"query":', to_json(q), ',"turn":', turn, '}') END, ',"id":', to_json(call_id), ',"name":', coalesce(to_json(name), 'null'),
      ',"result":', coalesce(to_json(content), 'null'), ',"status":"', status, '"}') AS json FROM paired)
SELECT conv_id, call_id, turn, result_turn, name, status, CASE WHEN status <> 'orphan' THEN level END::INTEGER AS level,
  CASE WHEN status <> 'orphan' THEN length(q) BETWEEN 1 AND 400 END AS valid,
  CASE WHEN status = 'orphan' THEN NULL WHEN length(q) > 400 THEN '$.query: too long' WHEN q = '' THEN '$.query: too short' ELSE '' END AS errors,
  length(json)::BIGINT AS n_chars, md5(json) AS json_md5 FROM written LEFT JOIN ordered USING (conv_id, call_id)
"""

_OP4_SQL = r"""
WITH stripped AS (
  SELECT page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(p|div|br|li|ul|ol|nav|h[1-6]|article|title|head|header|footer|section|body|html|table|tr|td)(\s[^>]*)?/?>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS text FROM pages),
numbered AS (SELECT *, row_number() OVER () AS r FROM stripped),
lines AS (SELECT r, host, i, all_lines[i] AS line, trim(all_lines[i], ' ') AS k
  FROM (SELECT r, host, string_split(text, chr(10)) AS all_lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM numbered WHERE text IS NOT NULL)),
totals AS (SELECT host, count(*) AS total FROM numbered WHERE host IS NOT NULL GROUP BY 1),
often AS (SELECT host, k FROM (SELECT host, k, count(DISTINCT r) AS n FROM lines WHERE k <> '' AND host IS NOT NULL GROUP BY 1, 2)
  JOIN totals USING (host) WHERE n >= 2 AND n > 0.1::DOUBLE * total),
kept AS (SELECT r, count(*) FILTER (WHERE l.k <> '') AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o.k IS NULL), '') AS text
  FROM lines l LEFT JOIN often o ON l.host = o.host AND l.k = o.k GROUP BY 1)
SELECT page_id, host, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  length(kept.text)::BIGINT AS n_chars, md5(kept.text) AS text_md5 FROM numbered LEFT JOIN kept USING (r)
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level tokens and decoded again."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its parts put in another order for half of them, and put right again."""
    out = fill_middle.transform(_table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(again, 256).alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


_OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    sha256(concat('42:', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
drawn AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""

_OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY 1, 2),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM words WHERE len(w) > 0),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM words) WHERE t IN (SELECT t FROM asked) GROUP BY 1, 2),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tfs, totals GROUP BY t),
lengths AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM words, totals WHERE len(w) > 0),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (r) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_toxicity": (op2_toxicity, None),
    "op3_token_counts": (op3_token_counts, None),
    "op4_line_dedup": (op4_line_dedup, _OP4_SQL),
    "op5_embedding_near_dedup": (op5_embedding_near_dedup, _OP5_SQL),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, None),
    "op7_benchmark_decontamination": (op7_benchmark_decontamination, _OP7_SQL),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_language_id": (op9_language_id, None),
    "op10_chat_formatting": (op10_chat_formatting, _OP10_SQL),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_fill_in_middle": (op12_fill_in_middle, _OP12_SQL),
    "op13_lexical_search": (op13_lexical_search, _OP13_SQL),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import table

#: (verdict, rule): fixed values of op1's contract.
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filters import judge_urls, page_links

    pages = table(spark, sf_dir, "pages")
    out = judge_urls(pages.select("page_id", "url"), page_links(pages), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    from tessera.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), model_file or tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no preferences: the rejected side ends with the last answer of the conversation before."""
    from tessera.llm.chat_format import last_answers_swapped, pair_preferences

    chosen = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return pair_preferences(chosen, last_answers_swapped(chosen), pair_col="conv_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import prefix_trie, turn_keys, with_shared_heads

    return prefix_trie(with_shared_heads(turn_keys(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_sentencepiece, op3_exact_dedup, op4_ngram_join, op5_html_extract, op6_decontaminate, op7_license_scan, op8_chat_format, op9_toxicity, op10_suffix_dedup, op11_simhash, op12_ranked_search, op13_prefix_trie)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words of lower-cased text.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    # Pages without canonical links and redirects (as here): a url that no rule fits is allowed.
    "op1_url_filters": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule) AS (
  VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')
), cut AS (
  SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, position('/' IN rule)) AS rule_path FROM rules
), won AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN cut ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN won USING (page_id)""",
    "op3_exact_dedup": f"""
WITH hashed AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
grouped AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM hashed JOIN grouped USING (text_sha256)""",
    "op8_chat_format": """
WITH last AS (
  SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), swap AS (
  SELECT l.conv_id, l.last_turn, coalesce(o.answer, '') AS other, l.answer FROM last l LEFT JOIN last o ON o.conv_id = l.conv_id - 1
), both_sides AS (
  SELECT c.conv_id, turn, role, text, 'chosen' AS side, coalesce(turn >= last_turn AND answer <> other, false) AS apart FROM conversations c LEFT JOIN swap USING (conv_id)
  UNION ALL
  SELECT c.conv_id, turn, role, CASE WHEN turn = last_turn THEN other ELSE text END, 'rejected', coalesce(turn >= last_turn AND answer <> other, false) FROM conversations c LEFT JOIN swap USING (conv_id)
), rendered AS (
  SELECT conv_id, CASE WHEN apart THEN side ELSE 'prompt' END AS part, turn, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment, length(role) + 5 AS head, apart AND role = 'assistant' AS trained
  FROM both_sides WHERE apart OR side = 'chosen'
), placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rendered
), masked AS (
  SELECT *, CAST(CAST(start AS BIGINT) + head AS VARCHAR) || '-' || CAST(CAST(start AS BIGINT) + length(segment) AS VARCHAR) AS range FROM placed
)
SELECT conv_id, '0' AS piece,
  coalesce(string_agg(segment, '' ORDER BY turn) FILTER (WHERE part = 'prompt'), '') AS prompt,
  coalesce(string_agg(segment, '' ORDER BY turn) FILTER (WHERE part = 'chosen'), '') AS chosen,
  coalesce(string_agg(segment, '' ORDER BY turn) FILTER (WHERE part = 'rejected'), '') AS rejected,
  coalesce(string_agg(range, ',' ORDER BY turn) FILTER (WHERE part = 'chosen' AND trained), '') AS chosen_mask,
  coalesce(string_agg(range, ',' ORDER BY turn) FILTER (WHERE part = 'rejected' AND trained), '') AS rejected_mask,
  CAST(0 AS BIGINT) AS prompt_at, CAST(0 AS BIGINT) AS chosen_at, CAST(0 AS BIGINT) AS rejected_at
FROM masked GROUP BY conv_id""",
    # Item and document windows as joined words; a stretch of item words is found in a text by its words alone.
    "op6_decontaminate": f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT p.doc_id, p.n, p.k, v.item_id FROM places p JOIN windows v ON p.gram = v.gram AND p.n = v.n
), hits AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN names USING (doc_id)""",
    # All pairs of documents that share a five-word n-gram, on their full sets.
    "op4_ngram_join": f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM docs WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) pairs
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 5 * shared >= 4 * (s.n + t.n - shared)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, least(d.doc_id, coalesce(class, d.doc_id)) AS class_id, coalesce(n, 0) AS n_links FROM docs d
LEFT JOIN (SELECT a, min(b) AS class FROM reach GROUP BY a) r ON r.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.doc_id""",
    # Texts with licence tags aside (the tables hold none): phrases and what their labels permit.
    "op7_license_scan": f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), phrases(phrase, n, label, base, permits) AS (
  VALUES ('gnu general public license', 4, 'gpl', true, 0.3), ('apache license', 2, 'apache', true, 1.0), ('cc by', 2, 'cc-by', true, 0.9), ('mit license', 2, 'mit', true, 1.0),
    ('gnu lesser general public license', 5, 'lgpl', false, 0.5), ('gnu affero general public license', 5, 'agpl', false, 0.2), ('mozilla public license', 3, 'mpl', false, 0.6), ('bsd license', 2, 'bsd', false, 1.0),
    ('cc by nc', 3, 'cc-by-nc', false, 0.2), ('cc by sa', 3, 'cc-by-sa', false, 0.5), ('cc by nd', 3, 'cc-by-nd', false, 0.2), ('all rights reserved', 3, 'proprietary', false, 0.0)
), places AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, k, label, base, permits FROM places p JOIN phrases q ON p.gram = q.phrase AND p.n = q.n
), based AS (
  SELECT doc_id, count(*) AS n_base, min(k) - 1 AS first_word, max(k) - 1 AS last_word FROM found WHERE base GROUP BY doc_id
), named AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels, max(permits) AS score
  FROM (SELECT DISTINCT doc_id, label, base, permits FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id)""",
    # Bytes as pairs of hex digits, cut into stretches first so that a window is found without reading a whole text.
    "op10_suffix_dedup": """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), stretches AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 2198) AS part FROM (SELECT doc_id, h, unnest(range(0, CAST(greatest(length(h) // 2 - 99, 0) AS BIGINT), 1000)) AS s FROM docs)
), windows AS (
  SELECT doc_id, s + o AS k, md5(substr(part, 2 * o + 1, 200)) AS w
  FROM (SELECT doc_id, s, part, unnest(range(0, CAST(least(1000, length(part) // 2 - 99) AS BIGINT))) AS o FROM stretches)
), hits AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS nth FROM windows) WHERE nth > 1
), marked AS (
  SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 100 THEN 0 ELSE 1 END AS fresh FROM hits
), numbered AS (
  SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS span FROM marked
), spans AS (
  SELECT doc_id, min(k) AS a, max(k) + 100 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
), counts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    # For the one template of the tables: the blocks of <article>, without other tags.
    "op5_html_extract": r"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS article FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(article, '(?s)<!--.*?-->|<div class="ad">.*?</div>', '', 'g'), '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS kept FROM cut
), decoded AS (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(kept, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM bare
)
SELECT page_id, url, text, length(text) AS n_chars FROM decoded""",
    # The score by its formula, for every document and item that share a term.
    "op12_ranked_search": f"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents
), stats AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM docs WHERE len(w) > 0
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), stats
), loads AS (
  SELECT doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM docs, stats WHERE len(w) > 0
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}')) AS term FROM benchmark) GROUP BY item_id, term
), scored AS (
  SELECT item_id, c.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN counts c USING (term) JOIN weights USING (term) JOIN loads l ON l.doc_id = c.doc_id GROUP BY item_id, c.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10""",
    # A node is the text of its turns; sums over a subtree run over the path of each node's smallest member.
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT v.c, pos, role, text FROM convs v JOIN turns t ON t.c = v.c WHERE pos >= h
  UNION ALL SELECT v.c, pos, role, text FROM convs v JOIN turns t ON t.c = v.base WHERE pos < h
), paths AS (
  SELECT c, 0 AS depth, 'root' AS node, 0 AS points FROM convs
  UNION ALL SELECT c, row_number() OVER w, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w, length(text)
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
), chained AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY c) AS ends FROM paths
), nodes AS (
  SELECT node, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM chained GROUP BY node, depth
), children AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
trees AS (
  SELECT a.node, sum((y.n_convs - 1) * y.points) AS saved_tokens, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves
  FROM nodes y LEFT JOIN children k USING (node) JOIN paths a ON a.c = y.conv_id AND a.depth <= y.depth GROUP BY a.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN trees USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.up""",
}

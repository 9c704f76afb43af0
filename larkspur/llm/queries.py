"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import alignment, bpe, chat_format, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, minhash_dedup, mixing, phrases, quality, substring_dedup
from larkspur.llm.common import fold, table

#: Weights of the mix that op2 and the pipeline aim at, by level and name.
MIX_WEIGHTS = {"domain": {"domain0": 2.0, "domain1": 1.0, "domain2": 1.0, "domain3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}}
MIX_SHARE, MIX_EPOCHS = 0.5, 2


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, fold("doc_id", 5) != 0)
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"), MIX_SHARE, MIX_EPOCHS, weights=MIX_WEIGHTS)
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold("doc_id", 4) != 2)
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
    kept = line_dedup.remove_repeated_chunks(docs)
    return kept.select("doc_id", "n_lines", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50, with_text=False).drop("kept_text")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: token groups and links of two tokenizers. Null, empty and irreversible texts have zeros; repeated rows count as documents."""
    import public_tokenizers as public

    found = alignment.align(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2 000 foremost phrases of each lang. Null texts are empty, null langs `und`; ties go by count, then by the phrase's bytes."""
    found = phrases.collocations(table(spark, sf_dir, "documents"), least=10, words=3, percent=50)
    return phrases.ranked(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids and the text decoded from them, as digests. Null texts have no ids; repeated rows and null doc_ids stay rows."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_html, op4_near_dedup, op5_language, op6_line_dedup, op7_chat, op8_decontaminate, op9_embedding_dedup, op10_substring_dedup, op11_alignment, op12_phrases, op13_bpe)}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH RECURSIVE light AS (
  SELECT doc_id, lang, source,
         CASE WHEN regexp_extract(coalesce(source, ''), '(\d{1,9})', 1) = '' THEN 'other'
              ELSE 'domain' || (CAST(regexp_extract(source, '(\d{1,9})', 1) AS BIGINT) % 4) END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents),
d AS (SELECT * FROM light WHERE tokens > 0 AND doc_id IS NOT NULL),
leaves AS (SELECT domain, lang, source, count(*) AS docs, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(tokens) * 2.0::DOUBLE AS capacity, CASE domain WHEN 'domain0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM leaves GROUP BY ALL),
b1 AS (SELECT *, least((SELECT sum(tokens) FROM leaves)::DOUBLE * 0.5::DOUBLE, sum(capacity) OVER ()) AS budget FROM n1),
l1 AS (SELECT *, capacity / weight AS ratio,
         (budget - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b1),
f1 AS (SELECT domain, least(capacity, coalesce((SELECT level FROM l1 WHERE ratio > level ORDER BY ratio, domain LIMIT 1), 'inf'::DOUBLE) * weight) AS budget FROM l1),
n2 AS (SELECT domain, lang, sum(tokens) * 2.0::DOUBLE AS capacity, CASE lang WHEN 'en' THEN 4.0::DOUBLE WHEN 'de' THEN 2.0::DOUBLE WHEN 'fr' THEN 2.0::DOUBLE WHEN 'es' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM leaves GROUP BY ALL),
l2 AS (SELECT n2.*, budget, capacity / weight AS ratio,
         (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
         FROM n2 JOIN f1 USING (domain)),
w2 AS (SELECT domain, arg_min(level, (ratio, lang)) AS water FROM l2 WHERE ratio > level GROUP BY domain),
f2 AS (SELECT domain, lang, least(capacity, coalesce(water, 'inf'::DOUBLE) * weight) AS budget FROM l2 LEFT JOIN w2 USING (domain)),
n3 AS (SELECT domain, lang, source, tokens * 2.0::DOUBLE AS capacity, 1.0::DOUBLE AS weight, docs, tokens FROM leaves),
l3 AS (SELECT n3.*, budget, capacity AS ratio,
         (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
         FROM n3 JOIN f2 USING (domain, lang)),
w3 AS (SELECT domain, lang, arg_min(level, (ratio, source)) AS water FROM l3 WHERE ratio > level GROUP BY ALL),
f3 AS (SELECT domain, lang, source, tokens AS leaf_tokens, floor(round(least(capacity, coalesce(water, 'inf'::DOUBLE)), 6))::BIGINT AS budget
       FROM l3 LEFT JOIN w3 USING (domain, lang)),
p AS (SELECT d.*, budget // leaf_tokens AS passes, budget % leaf_tokens AS rest,
        md5('mix|' || (budget // leaf_tokens) || '|' || doc_id) AS ord FROM d JOIN f3 USING (domain, lang, source)),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS n_tokens, (passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM r WHERE passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component AS component_id, doc_id = component AS kept FROM s JOIN c ON c.id = s.doc_id
"""

OP6 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) % 1000003 AS h FROM l),
b AS (SELECT *, (h * 31 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS ends FROM h),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
k AS (SELECT doc_id, part, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, part),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk, n > 1 ORDER BY doc_id, first) AS nth FROM k),
t AS (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY part) AS text FROM r WHERE n = 1 OR nth = 1 GROUP BY doc_id),
s AS (SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS kept
      FROM documents d LEFT JOIN t USING (doc_id))
SELECT doc_id, n_lines, length(kept)::BIGINT AS n_chars, sha256(kept) AS text_sha256 FROM s
"""

OP8 = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pat AS (SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS p FROM iw WHERE len(ws) > 0),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
win AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS p
        FROM dw CROSS JOIN (SELECT DISTINCT n FROM pat) WHERE len(ws) >= n),
hit AS (SELECT doc_id, win.n, i, item FROM win JOIN pat USING (n, p)),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP9 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id AS id, vec_id AS reach FROM embeddings UNION SELECT r.id, u.b FROM r JOIN u ON r.reach = u.a),
c AS (SELECT id, min(reach) AS component FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component AS component_id, c.id = component AS kept FROM c LEFT JOIN n ON n.a = c.id
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: array_to_string(ws[i:i + 49], ' '))) AS x FROM w WHERE len(ws) >= 50),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS lo FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM m WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.k) AS t FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k GROUP BY ALL)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 10),
y AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM c JOIN (VALUES (1), (2)) v(j) ON j < k),
z AS MATERIALIZED (SELECT y.*, f.f AS l FROM y JOIN f ON f.lang = y.lang AND f.phrase = head),
x AS (SELECT z.*, f.f AS r, (1000000 * a * a) // (l * f.f) AS score FROM z JOIN f ON f.lang = z.lang AND f.phrase = tail),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM x),
i AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY ALL),
q AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE nth = 1 AND (around IS NULL OR 100 * around < 50 * a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op4_near_dedup": OP4, "op6_line_dedup": OP6, "op8_decontaminate": OP8, "op9_embedding_dedup": OP9, "op10_substring_dedup": OP10, "op12_phrases": OP12}

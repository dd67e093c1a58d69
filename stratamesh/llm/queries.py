"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamesh.llm import conversation_trie, licences, line_crf, near_dedup, order_minhash, packing, pieces, quality_model, secrets, sharding, simhash, spelling, urlfilter
from stratamesh.llm._io import table, text_of


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return order_minhash.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sure = F.filter("licences", lambda r: r["confirmed"])
    listed = F.array_join(F.transform(sure, lambda r: F.concat_ws(":", r["paragraph"].cast("string"), r["family"])), ",")
    return found.select(
        "doc_id", F.size("licences").cast("long").alias("n_predicted"), F.size(sure).cast("long").alias("n_licences"), listed.alias("licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda r: r["family"]))), ",").alias("families"))


TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op3_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    cut = packing.token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return packing.pack(cut)


def op4_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sentence pieces and back."""
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(PIECES))


SHARDS = 8


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents over eight shards of equal weights by doc_id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text_of()).cast("long") + 1).alias("size"), F.crc32(text_of()).alias("text_crc32"), F.lit("key").alias("law"))
    placed = sharding.rendezvous(rows, "doc_id", SHARDS, weights=[1.0] * SHARDS, grown="grown_shard")
    return sharding.with_slots(placed, "doc_id", "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and whether its lines are content for the most part."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    return line_crf.mark(docs, model).select("doc_id", *line_crf.BASE_COLUMNS, "base_failed", "kept", "content_share")


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secret spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    kinds = F.transform("secrets", lambda s: s["kind"])
    of = {k: F.size(kinds) - F.size(F.array_remove(kinds, i)) for i, k in enumerate(secrets.KINDS)}
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select("doc_id", *(of[k].cast("long").alias(f"n_{k}") for k in secrets.KINDS), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every url of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.filter_urls(pages)
    host, path = urlfilter.split_url(F.col("url"))
    rule, verdict = urlfilter.base_rule(F.col("host"), F.col("path"))
    return judged.select("page_id", host.alias("host"), path.alias("path"), "pattern_verdict").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("pattern_verdict")).alias("verdict"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with the form it varies."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over rebuilt conversations."""
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and group."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _op9_sql() -> str:
    rule, verdict = urlfilter.base_rule_sql()
    hits = {k: " OR ".join(f"regexp_matches(low, '{urlfilter.to_regex(r)}')" for r in urlfilter.DEFAULT_RULES if r.startswith("@@") == k) for k in (True, False)}
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url,
                  translate(coalesce(url, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS low,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({verdict}, CASE WHEN ({hits[False]}) AND NOT ({hits[True]}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p"""


def _op8_sql() -> str:
    low = f"translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                               ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
     n AS (SELECT doc_id, len(s) AS n FROM s),
     e AS (SELECT doc_id, unnest(s) AS g FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
     u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.other),
     c AS (SELECT id, min(other) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON c.id = n.doc_id"""


def _crc32_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte through the table of a relation t(tab)."""
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, y: xor(c >> 8, tab[1 + (xor(c, y) & 255)]), 4294967295::BIGINT), 4294967295)::BIGINT"


def _op11_sql() -> str:
    return rf"""
WITH RECURSIVE t AS (SELECT {_crc32_table()} AS tab),
     r AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+'), lambda w: translate(w, '{urlfilter.UPPER}', '{urlfilter.LOWER}'))) AS w FROM documents),
     o AS (SELECT id, w, count(*) AS k FROM r WHERE length(w) >= {spelling.LEAST_LENGTH} GROUP BY 1, 2),
     h AS (SELECT w, k, {_crc32_sql("id || ':' || w")} AS h FROM o, t),
     e AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM h),
     d AS (SELECT word, sum(k)::BIGINT AS n FROM e WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY 1 HAVING sum(k) >= {spelling.LEAST_COUNT}),
     v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM d)),
     p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
           UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.x = d.word UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.x = d.word),
     b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM p GROUP BY 1),
     f AS (SELECT d.word, d.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.FORM_TIMES} * n THEN form END AS form, CASE WHEN form_n >= {spelling.FORM_TIMES} * n THEN form_n END AS form_n FROM d LEFT JOIN b USING (word)),
     g(word, last) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.last WHERE f.form IS NOT NULL),
     root AS (SELECT g.word, g.last AS root FROM g JOIN f ON f.word = g.last WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""


def _op12_sql() -> str:
    """Nodes are named by their turns' digests one after the other, so ancestors are beginnings of the name."""
    return rf"""
WITH t AS (SELECT {_crc32_table()} AS tab),
     s AS (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT conv_id, d, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d, w) AS i FROM s),
     c AS (SELECT conv_id, {_crc32_sql('conv_id::VARCHAR')} % {conversation_trie.SHARED_TURNS} AS h FROM (SELECT DISTINCT conv_id FROM o), t),
     r AS (SELECT c.conv_id, i, d, w FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {conversation_trie.BLOCK} AND i <= h UNION ALL SELECT c.conv_id, i, d, w FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
     l AS (SELECT c.conv_id, coalesce(list(d ORDER BY i) FILTER (d IS NOT NULL), []) AS ds, coalesce(list(w ORDER BY i) FILTER (w IS NOT NULL), []) AS ws FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1),
     m AS (SELECT conv_id, k AS depth, array_to_string(ds[1:k], '') AS name, CASE WHEN k = 0 THEN 0 ELSE ws[k] END AS w, k = len(ds) AS stops FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS k FROM l)),
     n AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
     p AS (SELECT *, CASE WHEN depth > 0 THEN substr(name, 1, 32 * (depth - 1)) END AS above FROM n),
     k AS (SELECT above AS name, count(*) AS n_children FROM p WHERE above IS NOT NULL GROUP BY 1),
     x AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k USING (name)),
     u AS (SELECT substr(name, 1, 32 * a) AS name, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM x) GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, u.n_leaves, u.saved_tokens, x.ends_sha256 FROM x JOIN u USING (name) LEFT JOIN n q ON q.name = x.above"""


def _op5_sql() -> str:
    """Every shard's bid is 1 / -ln(draw); the largest wins, the smaller number on ties. CRC-32 goes byte by byte through its table."""
    unit = lambda i: f"((('0x' || substr(md5(name || ':{i}'), 1, 15))::BIGINT::DOUBLE + 0.5) / {float(1 << 60)!r}::DOUBLE)"
    bids = ", ".join(f"1.0::DOUBLE / -ln({unit(i)}) AS b{i}" for i in range(SHARDS + 1))
    best = f"greatest({', '.join(f'b{i}' for i in range(SHARDS))})"
    shard = "CASE " + " ".join(f"WHEN b{i} = best THEN {i}" for i in range(SHARDS)) + " END"
    return f"""
WITH t AS (SELECT {_crc32_table()} AS tab),
     d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS name FROM documents),
     b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes, {bids} FROM d),
     c AS (SELECT doc_id, len(bytes)::BIGINT + 1 AS size, xor(list_reduce(bytes, lambda c, y: xor(c >> 8, tab[1 + (xor(c, y) & 255)]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32, name, {best} AS best, b.* EXCLUDE (doc_id, text, name, bytes) FROM b, t),
     s AS (SELECT *, CAST({shard} AS INT) AS shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CASE WHEN doc_id IS NULL THEN concat_ws('|', text_crc32::VARCHAR, size::VARCHAR) ELSE name END), 1, {sharding.SUBSHARD_DIGITS}), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CASE WHEN b{SHARDS} > best THEN {SHARDS} ELSE shard END AS grown_shard FROM s"""


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_licence_scan": op2_licence_scan,
    "op3_vector_best_fit": op3_vector_best_fit,
    "op4_suffix_array_pieces": op4_suffix_array_pieces,
    "op5_rendezvous": op5_rendezvous,
    "op6_line_crf": op6_line_crf,
    "op7_markov_secrets": op7_markov_secrets,
    "op8_bbit_minhash": op8_bbit_minhash,
    "op10_rule_ensemble": op10_rule_ensemble,
    "op9_url_filters": op9_url_filters,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_simhash": op13_simhash,
}
#: Fitted models, tokenizers and packing can't be said in SQL; those queries are held against brute force in the tests.
ORACLES: dict[str, str] = {"op5_rendezvous": _op5_sql(), "op8_bbit_minhash": _op8_sql(), "op9_url_filters": _op9_sql(), "op11_spelling_variants": _op11_sql(), "op12_conversation_trie": _op12_sql()}

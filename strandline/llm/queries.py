"""The corpus operators bound to the standard tables.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` has the
equivalent DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import language, lengths, lexical, media, mixing, ordering, packing, quality, sharding, similarity, spelling, urls, vectors
from strandline.llm.workspace import crc_mod, new_path
from strandline.plans.tables import brief_shuffles, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)


@query
def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents in training order; the weights 1, 2, 3 are integrals
    of a falling, a peaked and a rising schedule."""
    return mixing.curriculum(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of 4-word shingles overlap by 85 % or more."""
    return similarity.similar_groups(table(spark, sf_dir, "documents"), words=4, threshold=Fraction(85, 100))


#: All pairs that share a shingle, of all documents: for small tables.
ORACLES["op2_jaccard_groups"] = r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []
                         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
  FROM docs
), points AS MATERIALIZED (
  SELECT min(r) AS p, min(doc_id) AS low, count(*) AS copies, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s
), posted AS MATERIALIZED (SELECT p, n, unnest(s) AS h FROM points
), links AS MATERIALIZED (
  SELECT a.p, b.p AS q FROM posted a JOIN posted b ON a.h = b.h AND a.p <> b.p AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.p, b.p, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(p, q) AS (
  SELECT p, p FROM points
  UNION
  SELECT reach.p, links.q FROM reach JOIN links ON links.p = reach.q
), components AS (SELECT reach.p, min(low) AS component_id FROM reach JOIN points ON points.p = reach.q GROUP BY reach.p
), partners AS (SELECT links.p, sum(copies) AS others FROM links JOIN points ON points.p = links.q GROUP BY links.p
)
SELECT doc_id, len(sets.s) AS n_shingles,
       CASE WHEN points.p IS NULL THEN doc_id ELSE component_id END AS component_id,
       (coalesce(copies - 1, 0) + coalesce(others, 0))::BIGINT AS n_links
FROM sets LEFT JOIN points ON points.s = sets.s LEFT JOIN components ON components.p = points.p LEFT JOIN partners ON partners.p = points.p
"""


@query
def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed sequence's slot, as read back from the written shards."""
    return ordering.materialise(table(spark, sf_dir, "documents"))


@query
def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's payload as stored media, read back and described, and its
    place among the document's paragraphs."""
    return media.document_media(table(spark, sf_dir, "documents"))


@query
def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of texts and references of all web pages."""
    return media.page_sequences(table(spark, sf_dir, "pages"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens at every context limit that is some document's length."""
    return lengths.token_counts(table(spark, sf_dir, "documents"))


#: The production shards of op10; names, not numbers, so that one can leave.
SHARDS = [f"shard-{i:02d}" for i in range(40)]


@query
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to their shards: what is read back from each."""
    placed = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    parts = max(4, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // len(SHARDS)))  # as many as the data ask for
    with brief_shuffles(spark):
        written = sharding.write_shards(placed, new_path(spark, "shards"), parts)
    return written.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), "slot", "shard")


ORACLES["op10_shard"] = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)
), prefs AS (
  SELECT i, name,
         ('0x' || substr(sha256('offset:' || name), 1, 16))::UBIGINT % {sharding.SLOTS} AS off,
         ('0x' || substr(sha256('skip:' || name), 1, 16))::UBIGINT % {sharding.SLOTS - 1} + 1 AS skip
  FROM shards
), walk AS (
  SELECT i, list(((off + j * skip) % {sharding.SLOTS})::INTEGER ORDER BY j) AS w
  FROM prefs, range({sharding.SLOTS}) r(j) GROUP BY i
), walks AS (SELECT list(w ORDER BY i) AS ws FROM walk),
claims(turn, slot, taken) AS (
  SELECT -1::BIGINT, -1, list_value()::INTEGER[] FROM walks
  UNION ALL
  SELECT turn + 1, s, list_append(taken, s) FROM (
    SELECT turn, taken, list_filter(ws[(turn + 1) % {len(SHARDS)} + 1], lambda x: NOT list_contains(taken, x))[1] AS s
    FROM claims, walks WHERE turn + 1 < {sharding.SLOTS})
), entries AS (
  SELECT slot, 'shard-' || lpad((turn % {len(SHARDS)})::VARCHAR, 2, '0') AS shard FROM claims WHERE turn >= 0
), keyed AS (
  SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 15))::UBIGINT % {sharding.SLOTS})::INTEGER AS slot
  FROM documents
)
SELECT doc_id, lang, source, n_chars, text_md5, slot, shard FROM keyed JOIN entries USING (slot)
"""


@query
def op6_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and representatives of all vectors."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label: for small tables.
ORACLES["op6_vector_duplicates"] = r"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: coalesce(x::DOUBLE, 'nan'::DOUBLE)) AS v FROM embeddings
), sound AS MATERIALIZED (
  SELECT r, vec_id, label, v, len(v) AS dim, sqrt(list_dot_product(v, v)) AS norm FROM vectors
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS p, b.r AS q FROM sound a JOIN sound b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r
  WHERE list_dot_product(a.v, b.v) >= 0.98 * a.norm * b.norm
), reach(p, q) AS (
  SELECT r, r FROM vectors
  UNION
  SELECT reach.p, links.q FROM reach JOIN links ON links.p = reach.q
), components AS (SELECT reach.p, min(vec_id) AS component_id FROM reach JOIN vectors ON vectors.r = reach.q GROUP BY reach.p
), degrees AS (SELECT p, count(*) AS n_links FROM links GROUP BY p
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM vectors JOIN components ON components.p = r LEFT JOIN degrees ON degrees.p = r
"""


#: Least score of a document that is predicted to be good.
GOOD = 0.7


@query
def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows of fold 2 were never learnt from."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held, "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; rows of fold 2 were never learnt from."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return language.identify(docs, language.train(docs)).select("doc_id", held, "lang_pred", "score", "ambiguous")


#: Prefix rules of op13, and its patterns for what they leave open.
URL_RULES = [
    urls.Rule("org/", "allow"),
    urls.Rule("example.org/es/", "block"),
    urls.Rule("example.org/en/1", "block"),
    urls.Rule("com/fr/", "allow"),
    urls.Rule("com/de/", "block"),
    *[urls.Rule(p, "block", pattern=True) for p in ("||casino-", "||ads-*.", "||free-bets.", "||spam-farm.", "||cheap-*^", "||adult-*.example.net/", "^utm_source=ad*^")],
    urls.Rule("||ads-track.*.html|", "allow", pattern=True),
]


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES, urls.token_counts(pages, URL_RULES))


ORACLES["op13_url_filter"] = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '\A[^/?#]*') AS raw FROM rests
), parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS tail FROM hosts
), pages_ AS (
  SELECT row_number() OVER () AS r, page_id, host, regexp_extract(tail, '\A[^?#]*') AS path, host || regexp_extract(tail, '\A[^#]*') AS address FROM parts
), rules(rule, rule_host, rule_path, said) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), decided AS (
  SELECT r, max_by(rule, length(rule)) AS rule, max_by(said, length(rule)) AS said
  FROM pages_ JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r
), patterns(place, pattern, regex, said) AS (
  VALUES (0, '||ads-track.*.html|', '\A([^/?]*\.)?ads-track\.[\s\S]*\.html\z', 'allow'),
         (1, '||casino-', '\A([^/?]*\.)?casino-', 'block'), (2, '||ads-*.', '\A([^/?]*\.)?ads-[\s\S]*\.', 'block'),
         (3, '||free-bets.', '\A([^/?]*\.)?free-bets\.', 'block'), (4, '||spam-farm.', '\A([^/?]*\.)?spam-farm\.', 'block'),
         (5, '||cheap-*^', '\A([^/?]*\.)?cheap-[\s\S]*([^A-Za-z0-9_.%-]|\z)', 'block'), (6, '||adult-*.example.net/', '\A([^/?]*\.)?adult-[\s\S]*\.example\.net/', 'block'),
         (7, '^utm_source=ad*^', '([^A-Za-z0-9_.%-]|\z)utm_source=ad[\s\S]*([^A-Za-z0-9_.%-]|\z)', 'block')
), guessed AS (
  SELECT r, min_by(pattern, place) AS pattern, min_by(said, place) AS said FROM pages_ JOIN patterns ON regexp_matches(address, regex) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(decided.said, guessed.said, 'allow') AS verdict, CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM pages_ LEFT JOIN decided USING (r) LEFT JOIN guessed USING (r)
"""


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of all documents with its more frequent variant."""
    return spelling.variants(table(spark, sf_dir, "documents"))


#: A checksum takes eight steps a byte; near words share what is left when a place is cut out.
ORACLES["op12_spelling"] = r"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
), runs AS MATERIALIZED (
  SELECT d, run, count(*) AS n FROM (SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM found) GROUP BY d, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(flatten(list_transform(string_split(d || ':' || run, ''),
             lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c)::BIGINT // 64, 128 + unicode(c)::BIGINT % 64] END)),
             lambda b: [b, 0, 0, 0, 0, 0, 0, 0])),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT)) AS h
  FROM runs
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) t(i)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, words.word, words.n FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word, cut.n FROM cut JOIN words ON cut.rest = words.word
), rated AS (
  SELECT word, count(*) AS n_near, min_by(other, (-n, other)) AS best, max(n) AS best_n FROM near GROUP BY word
), forms AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * words.n THEN best END AS form, CASE WHEN best_n >= 2 * words.n THEN best_n END AS form_n
  FROM words LEFT JOIN rated USING (word)
), chain(word, place) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.place WHERE forms.form IS NOT NULL
), last AS (SELECT chain.word, place AS root FROM chain JOIN forms ON forms.word = place WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)
"""


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.build(table(spark, sf_dir, "documents")).search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


ORACLES["op11_ranked_search"] = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), total AS MATERIALIZED (SELECT count(*) AS nd, sum(len(terms))::BIGINT AS nt FROM docs WHERE len(terms) > 0
), items AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark WHERE text IS NOT NULL
), asked AS MATERIALIZED (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM items) GROUP BY q, item_id, term
), posted AS MATERIALIZED (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY r, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), total
), impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)) AS impact FROM posted, total
), scored AS (
  SELECT q, item_id, r, doc_id, sum(times * w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY q, item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS "rank", doc_id, score FROM scored WHERE score > 0
QUALIFY "rank" <= 20
"""

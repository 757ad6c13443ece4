"""The registered queries of this subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import Query
from ._shared import read

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_W = r"[ \t\n\x0B\f\r]"

QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, t, host, list_filter(string_split_regex(t, '{_W}+'), lambda x: x <> '') AS w FROM d),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
run AS (
  SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS r FROM word),
twin AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, r) AS n FROM run WHERE len(r) = 8),
start AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM twin WHERE n > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(gap, 8))) AS n FROM start GROUP BY doc_id),
line AS (SELECT doc_id, host, md5(t) AS th, unnest(string_split(t, chr(10))) AS l FROM d),
wordy AS (SELECT *, lower(trim(regexp_replace(l, '{_W}+', ' ', 'g'))) AS s,
                 len(list_filter(string_split_regex(l, '{_W}+'), lambda x: x <> '')) AS k
          FROM line WHERE regexp_matches(l, '[^ \t\n\x0B\f\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM wordy GROUP BY doc_id),
size AS (SELECT host, count(DISTINCT th) AS n FROM wordy GROUP BY host),
common AS (
  SELECT host, s FROM (SELECT host, s, count(DISTINCT th) AS k FROM wordy GROUP BY host, s) JOIN size USING (host)
  WHERE k >= 10 AND k > 0.1 * n),
gone AS (SELECT doc_id, sum(k) AS n FROM wordy JOIN common USING (host, s) GROUP BY doc_id),
j AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_common_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_common_words >= 0.5 * n_words AS kept
FROM j"""


@query("op9_quality_rules", QUALITY_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and the verdict."""
    from .quality import quality_rules

    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept"
    )


LINE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
wordy AS (
  SELECT doc_id, i, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM line WHERE regexp_matches(l, '[^ \t\n\x0B\f\r]')),
win AS (
  SELECT doc_id, k, l || chr(10) || lead(l) OVER o || chr(10) || lead(l, 2) OVER o AS w
  FROM wordy WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
late AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS r FROM win WHERE w IS NOT NULL)
  WHERE r > 1),
gone AS (
  SELECT DISTINCT wordy.doc_id, wordy.i FROM late JOIN wordy ON wordy.doc_id = late.doc_id AND wordy.k BETWEEN late.k AND late.k + 2)
SELECT line.doc_id, count(*)::BIGINT AS n_lines, count(gone.i)::BIGINT AS n_removed,
       coalesce(string_agg(line.l, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS text
FROM line LEFT JOIN gone ON gone.doc_id = line.doc_id AND gone.i = line.i GROUP BY line.doc_id"""


@query("op3_line_dedup", LINE_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of three-line windows."""
    from .line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the size of their shingle set and their component."""
    from .ngram_join import ngram_jaccard_join

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what is left once repeated 100-byte strings are gone."""
    from .suffix_dedup import suffix_dedup

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    from .packing import best_fit_packing

    return best_fit_packing(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


@query("op6_token_output")
def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    from .token_output import read_tokens, write_tokens

    manifest = write_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return read_tokens(manifest).drop("ids")


WARC_SQL = """WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f"""


@query("op7_warc", WARC_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back by byte ranges."""
    from .warc import read_warc, write_warc

    return read_warc(write_warc(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a bigram model learnt from six sevenths of them."""
    from .lm import lm_score

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_embedding_near_dup")
def op5_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at a cosine of 0.98."""
    from .near_dup import embedding_near_dup

    out = embedding_near_dup(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept", "audit_recall")


@query("op10_piece_scan")
def op10_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again."""
    from pyspark.sql import functions as F

    from .piece_scan import decode_pieces, encode_pieces, ids_crc32

    path = tokenizer_file("piece_bpe_32k.model")
    docs = decode_pieces(encode_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_crc32(F.col("ids")).alias("ids_crc32"), same.alias("round_trip"))


_WORDS = rf"len(list_filter(string_split_regex(coalesce(text, ''), '{_W}+'), lambda x: x <> ''))"

MIX_SQL = rf"""WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
q AS (SELECT *, list_extract([5, 2, 1], ((rk - 1) % 3 + 1)::INT)::DOUBLE AS weight, source_size::DOUBLE * 2 AS lim FROM r),
w AS (SELECT *, lim / weight AS ratio, sum(lim) OVER o AS c, sum(weight) OVER o AS ws, row_number() OVER o AS k FROM q
      WINDOW o AS (ORDER BY lim / weight, rk ROWS UNBOUNDED PRECEDING)),
t AS (SELECT CAST(1.5 AS DOUBLE) * sum(source_size)::DOUBLE AS wanted, sum(weight) AS wt FROM q),
l AS (SELECT arg_min(level, k) AS level FROM (SELECT k, ratio, (wanted - (c - lim)) / (wt - (ws - weight)) AS level FROM w, t) WHERE level <= ratio),
g AS (SELECT source, source_size, least(lim, level * weight) AS target FROM w, l),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
   row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS place FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
u AS (SELECT source, j, list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * (1::BIGINT << (4 * (8 - i)))))::DOUBLE / 4294967296 AS u
   FROM (SELECT source, j, md5(concat('11/', j, '/', CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END)) AS h FROM s, range(16) x(j))),
c AS (SELECT p.*, u.j, (floor(rate * place + u) - floor(rate * (place - 1) + u))::BIGINT AS copies FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source),
b AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY abs(sum(copies * size)::DOUBLE - any_value(target)), j) AS best, j FROM c GROUP BY source, j)
SELECT doc_id, size, source_size, target, copies * size AS taken FROM c JOIN b ON c.j = b.j AND c.source IS NOT DISTINCT FROM b.source WHERE best = 1"""


@query("op11_source_mixing", MIX_SQL)
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    from .mixing import sample_sources

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sample_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


HARD_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sc AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS s
   FROM v a JOIN v b ON a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM (
   SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) AS r FROM sc WHERE same AND id <> anchor_id) WHERE r <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
   SELECT p.*, id AS negative_id, s AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) AS rank
   FROM p JOIN sc USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score) WHERE rank <= 3"""


@query("op12_hard_negatives", HARD_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every anchor (ids divisible by 50) among all vectors."""
    from pyspark.sql import functions as F

    from .hard_negatives import hard_negatives

    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


AUDIT_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
   list_filter(string_split_regex(coalesce(text, ''), '{_W}+'), lambda x: x <> '') AS w FROM documents),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
     WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
     WHEN 'C' THEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) WHEN 'D' THEN regexp_matches(t, '[#$%&*|]')
     ELSE coalesce(d.doc_id, 9223372036854775807) > first END) AS fails
   FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM d) d LEFT JOIN m USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x)
   JOIN l e ON e.x NOT IN (a.x, b.x, c.x) JOIN l g ON g.x NOT IN (a.x, b.x, c.x, e.x)),
st AS (SELECT filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS x, string_split(substr(filter_order, 1, step::INT - 1), '') AS before
   FROM o, range(1, 6) r(step)),
k AS (SELECT part, filter_order, step, x,
   coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND NOT list_contains(fails, x)), 0)::BIGINT AS kept,
   coalesce(sum(n) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, x)), 0)::BIGINT AS removed,
   coalesce(sum(n) FILTER (list_has_any(fails, before) AND list_contains(fails, x)), 0)::BIGINT AS redundant,
   coalesce(sum(n) FILTER (fails = [x]), 0)::BIGINT AS unique_fails,
   coalesce(sum(good) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, x)), 0)::BIGINT AS good_lost,
   coalesce(sum(toxic) FILTER (NOT list_has_any(fails, before) AND list_contains(fails, x)), 0)::BIGINT AS toxic_lost
   FROM h, st GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
   (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM k"""


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders, for every source."""
    from .filter_audit import filter_audit

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit(docs, read(spark, sf_dir, "labels"))

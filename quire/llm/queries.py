"""The queries of this subpackage with their production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontaminate, exact_dedup, jaccard_join, license_scan, piece_codec, simhash, token_counts, toxicity, url_filter, vector_codes, warc
from .shared import table

#: The rules of op1: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, verdict) AS (VALUES %s),
fits AS (
  SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM parts p LEFT JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
""" % ", ".join(map(str, RULES))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The conversation that op5 adds: conv_id, turn, role, text.
EXTRA_TURNS = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))
_EXTRA = "SELECT * FROM (VALUES " + ", ".join(map(str, EXTRA_TURNS)) + ") AS t(conv_id, turn, role, text)"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(_EXTRA).select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat_format.format_chat(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    read, loss = chat_format.read_turns(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return (
        chats.withColumn("_turns", read)
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size("_turns").cast("bigint").alias("n_turns"),
            F.sha2(said, 256).alias("turns_sha256"),
            F.length("_loss").cast("bigint").alias("loss_chars"),
            F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("bigint").alias("formatted_chars"),
        )
    )


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, '&', '&amp;')"
    for c in chat_format.CONTROL:
        out = f"replace({out}, '{c}', '&#{ord(c[0])};{c[1:]}')"
    return out


OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL {_EXTRA})),
lines AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss, length({_escaped_sql("text")}) + length(replace({_escaped_sql("role")}, chr(10), '&#10;')) AS n FROM turns),
chats AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    string_agg(loss, '' ORDER BY turn, role, text) AS loss, CAST(sum(n + {len(chat_format.TURN) + 1 + len(chat_format.END)}) AS BIGINT) AS formatted_chars
  FROM lines GROUP BY conv_id, own)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM chats
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = toxicity.fold(F.col("doc_id")) == 0
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS said
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS said
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, p.n, i FROM places p JOIN windows x ON x.n = p.n AND x.said = p.said),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id
"""


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, with what the audit says of a second copy.

    The tables hold no replica, so the copy is derived from the same pages with planted damage: where the digest of the page's id
    begins with 00 the record is lost, where it begins with 01 a byte of the record is turned over, offsets as in the intact copy.
    """
    luck = F.coalesce(F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2), F.lit(""))
    broken = lambda record: F.overlay(record, F.lit(b"#"), F.lit(3), F.lit(1))
    # the digest of the broken record is made where its bytes are; they aren't shuffled
    records = warc.warc_records(table(spark, sf_dir, "pages"), digests={"copy_sha256": lambda r: F.when(luck == "01", F.sha2(broken(r), 256)).otherwise(F.sha2(r, 256))}).drop("record")
    copy = records.where(luck != "00").withColumn("sha256", F.col("copy_sha256"))
    found = warc.audit(records, copy)
    rows = records.select("page_id", "archive", "offset", "length")
    return rows.join(found, ["archive", "offset"], "left").select("page_id", "archive", "offset", "length", F.coalesce("status", F.lit("intact")).alias("status"))


OP7_SQL = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 1024.0) AS BIGINT) AS archive,
    CAST(strlen('WARC/1.0' || '..WARC-Type: response' || '..WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000000>' || '..WARC-Date: 1970-01-01T00:00:00Z' || '..WARC-Target-URI: ' || coalesce(url, '')
      || '..Content-Type: application/http; msgtype=response' || '..Content-Length: ' || (strlen(http) + strlen(coalesce(html, ''))) || '....') + strlen(http) + strlen(coalesce(html, '')) + 4 AS BIGINT) AS length
  FROM (SELECT *, 'HTTP/1.1 200 OK' || '..Content-Type: text/html; charset=utf-8' || '..Content-Length: ' || strlen(coalesce(html, '')) || '....' AS http FROM pages))
SELECT page_id, archive, CAST(coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", length,
  CASE substr(sha256(CAST(page_id AS VARCHAR)), 1, 2) WHEN '00' THEN 'missing' WHEN '01' THEN 'changed' ELSE 'intact' END AS status
FROM r
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048, spaces="dropped")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", output=("ids_sha256", "decoded_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents JOIN least ON least.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def _op11_sql(rounds: int = 6) -> str:
    """Each round as two steps: assigned (a) by the codebooks before, then the codebooks (c) of the members' means, rounded down."""

    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT r, p, any_value(x) AS x, CAST(min(far * 256 + e) % 256 AS BIGINT) AS e, CAST(min(far) AS BIGINT) AS far
  FROM (SELECT r, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM parts JOIN c{k} ON c{k}.p = parts.p) GROUP BY r, p)"""

    def means(k: int) -> str:
        return f"""c{k + 1} AS MATERIALIZED (
  SELECT o.p, o.e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c
    FROM (SELECT p, e, k, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(x) AS y, unnest(range(len(x))) AS k FROM a{k}) GROUP BY p, e, k) GROUP BY p, e) m
  ON m.p = o.p AND m.e = o.e)"""

    steps = ",\n".join(step for k in range(rounds) for step in (assigned(k), means(k)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM (SELECT r, v, unnest(range(8)) AS p FROM kept)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT r, vec_id FROM kept WHERE vec_id IS NOT NULL ORDER BY vec_id LIMIT 16)),
c0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN first ON first.r = parts.r),
{steps},
{assigned(rounds)},
coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, unnest(range(len(c))) AS k FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded ON coded.r = kept.r, book
"""


OP11_SQL = _op11_sql()


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=3)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_chat_format": op5_chat_format,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc_audit": op7_warc_audit,
    "op8_token_counts": op8_token_counts,
    "op9_piece_codec": op9_piece_codec,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash": op12_simhash,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_warc_audit": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_vector_codes": OP11_SQL}

"""Relational, text, extraction, validation and retrieval queries of the document register, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import api
from folioforge.functions import files as ff
from folioforge.functions import textops as tx
from folioforge.operators import chunking, classification, extraction, learning, repository, retrieval, validation
from folioforge.plans.registry import Registry
from folioforge.session import stored, table

registry = Registry()
query = registry.query

WS = r"[ \t\n\r\f]"
STRIP = rf"regexp_replace({{}}, '^{WS}+|{WS}+$', '', 'g')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _hits_sql(text: str, words: list[str]) -> str:
    return " + ".join(f"(CASE WHEN contains({text}, '{w}') THEN 1 ELSE 0 END)" for w in words)


def _classify_sql(source: str, key: str, text: str, more: str = "") -> str:
    counts = ", ".join(f"CASE WHEN length(trim(t)) >= 15 THEN {_hits_sql('t', w)} ELSE 0 END AS {k[:3].lower()}" for k, w in classification.CLASSES.items())
    return f"""SELECT {key}, {more} CASE WHEN inv + res + oth = 0 THEN 'Other' WHEN inv >= res AND inv >= oth THEN 'Invoice'
        WHEN res >= oth THEN 'Resume' ELSE 'Other' END AS predicted_type,
        CASE WHEN inv + res + oth > 0 THEN round_even(greatest(inv, res, oth) / (inv + res + oth), 3) END AS confidence_predicted
        FROM (SELECT *, {counts} FROM (SELECT *, lower(coalesce({text}, '')) AS t FROM {source}))"""


# ---- classification ----------------------------------------------------------------------------


@query("classify_documents", _classify_sql("doc_records", "id", "text_preview"))
def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    df = classification.classify(table(spark, sf, "doc_records").select("id", "text_preview"), "text_preview")
    return df.select("id", "predicted_type", "confidence_predicted")


@query(
    "classify_report",
    f"""WITH p AS (SELECT category AS label, predicted_type AS predicted FROM ({_classify_sql("documents_corpus", "id", "text", "category,")}) WHERE category IN ('Invoice', 'Resume', 'Other')),
    a AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS tp FROM p GROUP BY label),
    c AS (SELECT predicted AS label, count(*) AS claimed FROM p GROUP BY predicted)
    SELECT a.label, a.support, round_even(coalesce(tp / claimed, 0), 6) AS precision, round_even(tp / support, 6) AS recall,
    round_even(coalesce(2 * (tp / claimed) * (tp / support) / nullif(tp / claimed + tp / support, 0), 0), 6) AS f1
    FROM a LEFT JOIN c ON a.label = c.label""",
)
def classify_report(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "documents_corpus").filter(F.col("category").isin("Invoice", "Resume", "Other"))
    return classification.class_report(classification.classify(corpus, "text"), "category", "predicted_type")


def _times_sql(text: str, words: list[str]) -> str:
    return " + ".join(f"CAST((length({text}) - length(replace({text}, '{w}', ''))) // {len(w)} AS INTEGER)" for w in words)


_OCCURRENCES = ", ".join(f"CASE WHEN length(trim(t)) >= 15 THEN {_times_sql('t', w)} ELSE 0 END AS {k[:3].lower()}" for k, w in classification.CLASSES.items())


@query(
    "classify_occurrences",
    f"""SELECT id, CASE WHEN inv + res + oth = 0 THEN 'Other' WHEN inv >= res AND inv >= oth THEN 'Invoice' WHEN res >= oth THEN 'Resume' ELSE 'Other' END AS predicted_type,
    round_even(CASE WHEN inv + res + oth = 0 THEN 0.35 ELSE least(0.95, 0.45 + 0.5 * greatest(inv, res, oth) / (inv + res + oth + 1)) END, 6) AS confidence_predicted
    FROM (SELECT *, {_OCCURRENCES} FROM (SELECT *, lower(coalesce(text, '')) AS t FROM documents_corpus))""",
)
def classify_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    df = classification.classify(table(spark, sf, "documents_corpus"), "text", "occurrence")
    return df.select("id", "predicted_type", F.bround("confidence_predicted", 6).alias("confidence_predicted"))


@query(
    "stratified_folds",
    """SELECT category, CAST((row_number() OVER (PARTITION BY category ORDER BY md5(id), id) - 1) % 4 AS INTEGER) AS fold, count(*) OVER (PARTITION BY category) AS members, id
    FROM documents_corpus""",
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "documents_corpus").select("id", "category")
    sizes = corpus.groupBy("category").agg(F.count("*").alias("members"))
    dealt = classification.folds(corpus, "category", "id").alias("d")
    return dealt.join(sizes.alias("s"), F.col("d.category").eqNullSafe(F.col("s.category"))).select("d.category", "fold", "members", "id")


@query("trained_models")
def trained_models(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out confusion of each trained classifier over all folds of the labelled corpus."""
    corpus = table(spark, sf, "documents_corpus").filter(F.col("category").isin("Invoice", "Resume", "Other") & F.col("text").isNotNull()).select("id", "category", "text")
    return learning.cross_validated(stored(classification.folds(corpus, "category", "id"), "folds"), "text", "category")


# ---- metrics -----------------------------------------------------------------------------------

_TIMED = "CASE WHEN processing_time_ms > 0 THEN processing_time_ms END"


@query(
    "register_metrics",
    "SELECT count(*) AS documents, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower().replace(' ', '_')}" for s in repository.STATUSES)
    + f""", coalesce(round_even(avg({_TIMED}), 2), 0) AS avg_ms, coalesce(min({_TIMED}), 0) AS min_ms, coalesce(max({_TIMED}), 0) AS max_ms,
    count(*) FILTER (WHERE confidence < 0.75) AS low_confidence, round_even(avg(confidence), 6) AS avg_confidence FROM doc_records""",
)
def register_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return repository.metrics(table(spark, sf, "doc_records"))


@query("count_by_status", "SELECT status, count(*) AS n FROM doc_records GROUP BY status")
def count_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return repository.counts_by(table(spark, sf, "doc_records"), "status")


@query("count_by_type", "SELECT document_type, count(*) AS n FROM doc_records GROUP BY document_type")
def count_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return repository.counts_by(table(spark, sf, "doc_records"), "document_type")


@query(
    "category_stats",
    """SELECT k AS document_type, coalesce(n, 0) AS n, CAST(coalesce(b, 0) AS BIGINT) AS bytes FROM (SELECT unnest(['Invoice', 'Resume', 'Contract', 'Other']) AS k)
    LEFT JOIN (SELECT document_type, count(*) AS n, sum(file_size) AS b FROM doc_records GROUP BY document_type) ON k = document_type""",
)
def category_stats(spark: SparkSession, sf: str) -> DataFrame:
    return repository.category_stats(table(spark, sf, "doc_records"))


@query(
    "folder_counts",
    """SELECT CASE WHEN document_type IN ('Invoice', 'Receipt') THEN 'invoices' WHEN document_type = 'Resume' THEN 'resumes' WHEN document_type = 'Contract' THEN 'contracts'
    ELSE 'other' END AS category_dir, count(*) AS files FROM doc_records GROUP BY 1""",
)
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "doc_records").groupBy(ff.folder(F.col("document_type")).alias("category_dir")).agg(F.count("*").alias("files"))


@query("value_summary", "SELECT count(value) AS n, round_even(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round_even(stddev_samp(value), 6) AS deviation FROM events")
def value_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").agg(F.count(v).alias("n"), F.bround(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.bround(F.stddev_samp(v), 6).alias("deviation"))


@query(
    "document_frequency",
    f"""SELECT term, count(DISTINCT id) AS chunks, count(*) AS uses FROM (SELECT id, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9_]{{2,}}')) AS term
    FROM (SELECT DISTINCT id, chunk_text FROM rag_chunks)) WHERE term NOT IN {_in(retrieval.SHORT_STOP_WORDS)} GROUP BY term""",
)
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "rag_chunks").select("id", "chunk_text").distinct()
    per = chunks.select("id", F.explode(F.regexp_extract_all(F.lower("chunk_text"), F.lit("([a-z0-9_]{2,})"), F.lit(1))).alias("term")).filter(~F.col("term").isin(retrieval.SHORT_STOP_WORDS))
    return per.groupBy("id", "term").agg(F.count("*").alias("u")).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("u").alias("uses"))


# ---- lookups and searches ----------------------------------------------------------------------


@query("point_lookup", "SELECT id, status, document_type FROM doc_records WHERE id = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return repository.by_id(table(spark, sf, "doc_records"), 42).select("id", "status", "document_type")


@query(
    "hash_lookup",
    "SELECT b.id, b.file_hash FROM doc_records a JOIN doc_records b ON a.file_hash = b.file_hash WHERE a.id = 2 AND a.file_hash <> ''",
)
def hash_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").select("id", "file_hash")
    wanted = repository.by_id(docs, 2).filter("file_hash <> ''").select("file_hash").distinct()
    return docs.join(wanted, "file_hash", "left_semi").select("id", "file_hash")


@query("lookup_ids", "SELECT id, document_type FROM doc_records WHERE id IN (SELECT unnest(range(1, 100000, 97)))")
def lookup_ids(spark: SparkSession, sf: str) -> DataFrame:
    return repository.by_ids(table(spark, sf, "doc_records"), spark.range(1, 100000, 97)).select("id", "document_type")


@query(
    "requested_documents",
    """SELECT r.id, d.document_type, d.status, CASE WHEN d.id IS NULL THEN 'Failed' ELSE 'Found' END AS outcome
    FROM (SELECT unnest(range(1, 100000, 97)) AS id) r LEFT JOIN doc_records d ON r.id = d.id""",
)
def requested_documents(spark: SparkSession, sf: str) -> DataFrame:
    return repository.requested(table(spark, sf, "doc_records"), spark.range(1, 100000, 97))


_LIKE = " OR ".join(f"{c} ILIKE '%{{}}%'" for c in repository.SEARCHED)


@query("search_documents", f"SELECT id, company, status FROM doc_records WHERE ({_LIKE.format(*['veltara'] * 5)}) AND status = 'Needs Review' AND document_type = 'Invoice'")
def search_documents(spark: SparkSession, sf: str) -> DataFrame:
    return repository.search(table(spark, sf, "doc_records"), "veltara", "Needs Review", "Invoice").select("id", "company", "status")


@query(
    "search_page",
    f"""SELECT id, original_filename, confidence FROM doc_records WHERE ({_LIKE.format(*["ltd"] * 5)}) ORDER BY confidence DESC NULLS LAST, id LIMIT 50 OFFSET 20""",
)
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    return repository.search(table(spark, sf, "doc_records"), "ltd", sort="confidence_desc", limit=50, offset=20).select("id", "original_filename", "confidence")


@query(
    "search_dates",
    "SELECT id, status FROM doc_records WHERE upload_date >= DATE '2025-01-07' AND upload_date < DATE '2025-01-10' AND document_type = 'Resume'",
)
def search_dates(spark: SparkSession, sf: str) -> DataFrame:
    return repository.search(table(spark, sf, "doc_records"), kind="Resume", since="2025-01-07", until="2025-01-09").select("id", "status")


@query(
    "anomalous_documents",
    "SELECT id, document_type FROM doc_records WHERE CASE WHEN json_valid(anomaly_json) THEN json_extract_string(anomaly_json, '$.has_anomalies') END = 'true'",
)
def anomalous_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records")
    valid = F.coalesce(F.try_parse_json("anomaly_json").isNotNull(), F.lit(False))
    return repository.with_anomalies(docs.filter(valid)).select("id", "document_type")


@query(
    "document_list",
    r"""SELECT id, coalesce(company, 'Not Found') AS title, CASE WHEN document_type = 'Resume' THEN CASE WHEN length(total_amount) > 28 THEN concat(left(total_amount, 28), '...') ELSE total_amount END
    WHEN document_type = 'Contract' THEN invoice_number ELSE total_amount END AS detail,
    coalesce(CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%', 'N/A') AS confidence_text, strftime(upload_date, '%Y-%m-%d %H:%M') AS uploaded,
    CASE WHEN length(review_reason) > 40 THEN concat(left(review_reason, 40), '...') ELSE review_reason END AS reason FROM doc_records""",
)
def document_list(spark: SparkSession, sf: str) -> DataFrame:
    return repository.display(table(spark, sf, "doc_records"))


# ---- audit log ---------------------------------------------------------------------------------

_AUDIT = "(SELECT * FROM audit_log QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"


@query(
    "latest_action",
    """SELECT document_id, arg_max(action, id) AS action, arg_max(new_status, id) AS new_status, arg_max(logged_at, id) AS logged_at, count(DISTINCT id) AS events FROM audit_log GROUP BY document_id""",
)
def latest_action(spark: SparkSession, sf: str) -> DataFrame:
    return repository.latest_action(table(spark, sf, "audit_log"))


@query(
    "recent_audit",
    f"""SELECT a.id, a.document_id, a.action, d.original_filename FROM (SELECT * FROM {_AUDIT} ORDER BY id DESC LIMIT 25) a LEFT JOIN doc_records d ON a.document_id = d.id""",
)
def recent_audit(spark: SparkSession, sf: str) -> DataFrame:
    return repository.recent_audit(table(spark, sf, "audit_log"), table(spark, sf, "doc_records"), 25).select("id", "document_id", "action", "original_filename")


@query("audit_transitions", f"SELECT previous_status, new_status, count(*) AS n FROM {_AUDIT} GROUP BY ALL")
def audit_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return repository.transitions(table(spark, sf, "audit_log"))


@query(
    "audit_display",
    f"SELECT id, coalesce(previous_status, '') || ' -> ' || coalesce(new_status, '') AS change, strftime(logged_at, '%Y-%m-%d %H:%M:%S') AS at FROM {_AUDIT}",
)
def audit_display(spark: SparkSession, sf: str) -> DataFrame:
    return repository.audit_display(table(spark, sf, "audit_log"))


@query(
    "status_sequence",
    f"""SELECT document_id, new_status, lag(new_status) OVER (PARTITION BY document_id ORDER BY id) AS earlier, id FROM {_AUDIT}""",
)
def status_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return repository.status_sequence(table(spark, sf, "audit_log"))


@query(
    "audit_trail",
    f"""SELECT d.id, d.status, coalesce(string_agg(a.action, ' > ' ORDER BY a.id), '') AS trail FROM doc_records d LEFT JOIN {_AUDIT} a ON a.document_id = d.id WHERE d.id = 42 GROUP BY d.id, d.status""",
)
def audit_trail(spark: SparkSession, sf: str) -> DataFrame:
    trail = repository.audit_trail(table(spark, sf, "doc_records").select("id", "status"), table(spark, sf, "audit_log"), 42)
    return trail.select("id", "status", F.coalesce(F.array_join(F.transform("events", lambda e: e["action"]), " > "), F.lit("")).alias("trail"))


@query("stream_latest_state", "SELECT document_id, arg_max(new_status, id) AS status, max(id) AS last_event FROM audit_log GROUP BY document_id")
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    from folioforge.streaming import audit

    return audit.run_once(audit.latest_state(audit.read_events(spark, sf, "audit_log.parquet")), "state")


# ---- joins and changes -------------------------------------------------------------------------


@query(
    "chunks_of_documents",
    "SELECT c.document_id, c.id, c.chunk_index, d.original_filename, d.document_type FROM rag_chunks c JOIN doc_records d ON c.document_id = d.id",
)
def chunks_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    j = repository.chunks_of_documents(table(spark, sf, "rag_chunks"), table(spark, sf, "doc_records"))
    return j.select("document_id", "id", "chunk_index", "original_filename", "document_type")


@query(
    "repeated_identifiers",
    f"""WITH k AS (SELECT id, invoice_number, file_hash FROM doc_records WHERE lower(trim(coalesce(invoice_number, ''))) NOT IN {_in(repository.PLACEHOLDERS)}),
    g AS (SELECT invoice_number, arg_min_null(file_hash, id) AS first_hash, min(id) AS first_id, count(*) AS documents FROM k GROUP BY invoice_number HAVING count(*) > 1)
    SELECT k.id, k.invoice_number, first_id, documents FROM k JOIN g ON k.invoice_number = g.invoice_number WHERE k.id > first_id AND k.file_hash <> first_hash""",
)
def repeated_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return repository.repeated_identifiers(table(spark, sf, "doc_records"))


@query(
    "duplicates_by_hash",
    """SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY file_hash) AS first_id FROM doc_records WHERE trim(coalesce(file_hash, '')) <> '') WHERE id > first_id""",
)
def duplicates_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return repository.duplicates_by_hash(table(spark, sf, "doc_records"))


@query(
    "fresh_files",
    """SELECT min(id) AS id, file_hash FROM doc_records WHERE batch_no > 0 AND file_hash NOT IN (SELECT file_hash FROM doc_records WHERE batch_no = 0 AND file_hash IS NOT NULL) GROUP BY file_hash""",
)
def fresh_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").select("id", "file_hash", "batch_no").filter("file_hash IS NOT NULL")
    fresh, _ = repository.fresh_and_known(docs.filter("batch_no > 0"), docs.filter("batch_no = 0").select("file_hash"))
    return fresh.select("id", "file_hash")


@query(
    "delete_cascade",
    """SELECT 'documents' AS part, count(*) AS n FROM doc_records WHERE NOT coalesce(status = 'Failed', false) UNION ALL
    SELECT 'chunks', count(*) FROM rag_chunks WHERE document_id NOT IN (SELECT id FROM doc_records WHERE status = 'Failed') UNION ALL
    SELECT 'audit', count(*) FROM audit_log WHERE document_id NOT IN (SELECT id FROM doc_records WHERE status = 'Failed')""",
)
def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records")
    left, (chunks, audit) = repository.delete_cascade(docs, [table(spark, sf, "rag_chunks"), table(spark, sf, "audit_log")], docs.filter("status = 'Failed'"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(left, "documents").unionByName(count(chunks, "chunks")).unionByName(count(audit, "audit"))


@query(
    "update_status",
    """WITH last AS (SELECT document_id, arg_max_null(new_status, id) AS s FROM audit_log GROUP BY document_id)
    SELECT d.id, coalesce(CASE WHEN s <> '' THEN s END, d.status) AS status FROM doc_records d LEFT JOIN last ON d.id = document_id""",
)
def update_status(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "audit_log").groupBy(F.col("document_id").alias("id")).agg(F.max_by("new_status", "id").alias("status"))
    return repository.update(table(spark, sf, "doc_records").select("id", "status"), last, ["status"])


@query("long_form", "UNPIVOT (SELECT id, CAST(confidence AS DOUBLE) AS confidence, processing_time_ms FROM doc_records) ON confidence, processing_time_ms INTO NAME measure VALUE value")
def long_form(spark: SparkSession, sf: str) -> DataFrame:
    df = repository.long_form(table(spark, sf, "doc_records"), "id", ["confidence", "processing_time_ms"])
    return df.filter("value IS NOT NULL")


@query(
    "arithmetic_mismatch",
    """WITH t AS (SELECT l_orderkey AS o_orderkey, round_even(sum(l_extendedprice * (1 - l_discount)), 2) AS subtotal, round_even(sum(l_extendedprice * (1 - l_discount) * l_tax), 2) AS tax
    FROM lineitem GROUP BY l_orderkey) SELECT o.o_orderkey, abs(subtotal + tax - o_totalprice) > 0.05 AS mismatch FROM orders o JOIN t ON o.o_orderkey = t.o_orderkey""",
)
def arithmetic_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bround(F.sum(net), 2).alias("subtotal"), F.bround(F.sum(net * F.col("l_tax")), 2).alias("tax"))
    return table(spark, sf, "orders").join(t, "o_orderkey").select("o_orderkey", (F.abs(F.col("subtotal") + F.col("tax") - F.col("o_totalprice")) > 0.05).alias("mismatch"))


# ---- texts and files ---------------------------------------------------------------------------

_STRIPPED = STRIP.format("coalesce(text_preview, '')")
_WORDS = rf"len(list_filter(string_split_regex({{}}, '{WS}+'), lambda x: x <> ''))"


@query(
    "text_quality",
    f"""SELECT id, length(t) AS chars, {_WORDS.format("t")} AS words, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS lines,
    CASE WHEN length(t) = 0 THEN 'EMPTY' WHEN length(t) < 25 THEN 'VERY_SHORT' ELSE 'VALID' END AS quality FROM (SELECT id, {_STRIPPED} AS t FROM doc_records)""",
)
def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = tx.quality(F.col("text_preview"))
    df = table(spark, sf, "doc_records").select("id", q.alias("q"))
    return df.select("id", F.col("q.chars").cast("long").alias("chars"), F.col("q.words").cast("long").alias("words"), F.col("q.lines").cast("long").alias("lines"), F.col("q.status").alias("quality"))


@query("text_preview", f"SELECT doc_id, left(array_to_string(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> ''), ' '), 1200) AS preview FROM documents")
def text_preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query(
    "text_normalised",
    rf"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9.-]+', ' ', 'g'),
    '(https?://|www\.)[^ \t\n\r\f]+', ' ', 'g'), '[^a-z0-9 \t\n\r\f]', ' ', 'g'), '{WS}+', ' ', 'g')) AS normalised FROM documents_corpus""",
)
def text_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_corpus").select("id", tx.normalised(F.col("text")).alias("normalised"))


@query("text_cleaned")
def text_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = tx.clean_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cleaned.alias("cleaned")).withColumn("characters", F.length("cleaned"))


@query(
    "file_names",
    r"""WITH b AS (SELECT id, file_hash, regexp_extract(original_filename, '([^/\\]*)$', 1) AS f FROM doc_records),
    s AS (SELECT id, file_hash, lower(regexp_extract(f, '\.([^./\\]+)$', 1)) AS ext, regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '\.[^.]+$', ''), '[^A-Za-z0-9_\-.]', '_', 'g'), '_+', '_', 'g'),
    '^[._]+|[._]+$', '', 'g') AS stem FROM b)
    SELECT id, CASE WHEN stem = '' THEN 'document' ELSE stem END || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS safe_name, ext AS extension,
    CASE WHEN ext = 'pdf' THEN 'application/pdf' ELSE 'image/png' END AS mime FROM s""",
)
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("original_filename")
    return table(spark, sf, "doc_records").select("id", ff.safe_name(name, fold=False).alias("safe_name"), ff.extension(name).alias("extension"), ff.mime_type(name).alias("mime"))


@query("content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", ff.digest(F.col("text")).alias("digest"))


# ---- extraction and validation -----------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _group_sql(t: str, p: str, n: int = 1) -> str:
    return f"nullif(trim(regexp_extract({t}, {_q(p)}, {n})), '')"


def _after_sql(t: str, p: str) -> str:
    return f"CASE WHEN regexp_extract({t}, {_q(p)}, 2) <> '' THEN trim(regexp_extract({t}, {_q(p)}, 1) || ' ' || regexp_extract({t}, {_q(p)}, 2)) END"


_NUMBERS_SQL = ", ".join(
    f"list_filter(regexp_extract_all(text, {_q(p)}, 1), lambda x: lower(trim(x)) NOT IN {_in(extraction.NOT_NUMBERS)} AND length(trim(x)) >= 3)[1]" for p in extraction.INVOICE_NUMBER
)


@query(
    "invoice_fields",
    f"""SELECT id, trim(coalesce({_NUMBERS_SQL})) AS invoice_number, coalesce({", ".join(_group_sql("text", p) for p in extraction.INVOICE_DATE)}) AS invoice_date,
    {_after_sql("text", extraction.SUBTOTAL)} AS subtotal, {_after_sql("text", extraction.TAX)} AS tax FROM documents_corpus WHERE category = 'Invoice'""",
)
def invoice_fields(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return (
        table(spark, sf, "documents_corpus")
        .filter("category = 'Invoice'")
        .select(
            "id",
            extraction.invoice_number(t).alias("invoice_number"),
            extraction.invoice_date(t).alias("invoice_date"),
            extraction.amount_after(t, extraction.SUBTOTAL).alias("subtotal"),
            extraction.amount_after(t, extraction.TAX).alias("tax"),
        )
    )


def _last_sql(p: str, n: int) -> str:
    return f"regexp_extract_all(text, {_q(p)}, {n})[-1]"


_TOTAL_SQL = f"""coalesce(CASE WHEN {_last_sql(extraction.TOTAL, 2)} IS NOT NULL THEN nullif(trim(coalesce({_last_sql(extraction.TOTAL, 1)}, '') || ' ' || {_last_sql(extraction.TOTAL, 2)} || ' '
    || coalesce({_last_sql(extraction.TOTAL, 3)}, '')), '') END, nullif({_last_sql(extraction.TOTAL_RUPEES, 1)}, ''),
    CASE WHEN {_last_sql(extraction.TOTAL_SIGN, 2)} IS NOT NULL THEN trim({_last_sql(extraction.TOTAL_SIGN, 1)} || ' ' || {_last_sql(extraction.TOTAL_SIGN, 2)}) END)"""
_LINES_SQL = "list_filter(list_transform(string_split_regex(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')"


def _end_sql(e: str) -> str:
    found = f"trim(regexp_replace({_group_sql('text', chr(92) + 'b([A-Z][A-Za-z0-9&' + chr(39) + chr(92) + 's]{2,35}' + chr(92) + 's+' + e + ')')}, '(?i)^(?:from|to|bill\\s+to|vendor)\\s*[:\\-]?\\s*', ''))"
    return f"CASE WHEN length({found}) <= 50 AND NOT regexp_matches({found}, '[\\n\\r]') THEN {found} END"


_HEADS_SQL = f"""list_filter(list_transform({_LINES_SQL}[1:3], lambda x: trim(regexp_replace(x, '(?i)^(?:tax\\s+invoice|invoice|receipt|commercial\\s+invoice)\\s*', ''))),
    lambda x: length(x) BETWEEN 4 AND 40 AND NOT regexp_matches(lower(x), {_q("|".join(extraction.NOT_COMPANIES))}))[1]"""
_VENDOR_SQL = _group_sql("text", extraction.VENDOR_LINE)
_COMPANY_SQL = f"""coalesce(CASE WHEN lower({_VENDOR_SQL}) NOT IN ('invoice', 'tax invoice', 'bill to', 'details') THEN {_VENDOR_SQL} END, {", ".join(map(_end_sql, extraction.COMPANY_ENDS))}, {_HEADS_SQL})"""


@query("invoice_totals", f"SELECT id, {_TOTAL_SQL} AS total_amount, {_COMPANY_SQL} AS company FROM documents_corpus WHERE category = 'Invoice'")
def invoice_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents_corpus").filter("category = 'Invoice'").select("id", extraction.total_amount(t).alias("total_amount"), extraction.company(t).alias("company"))


_PHONE_SQL = ", ".join(
    f"""CASE WHEN length(regexp_replace(regexp_replace({_group_sql("text", p)}, '[,;[:space:]]+$', ''), '[^0-9]', '', 'g')) >= 7 THEN regexp_replace({_group_sql("text", p)}, '[,;[:space:]]+$', '') END"""
    for p in extraction.PHONES
)
_SKILLS_SQL = ", ".join(
    "CASE WHEN regexp_matches(lower(text), '\\b" + "".join("\\" + c if c in ".+#/-" else c for c in s.lower()) + f"\\b') THEN '{s}' END" for s in extraction.SKILLS
)


@query(
    "resume_fields",
    f"""SELECT id, {_group_sql("text", extraction.EMAIL)} AS email, coalesce({_PHONE_SQL}) AS phone,
    array_to_string(list_sort(list_filter([{_SKILLS_SQL}], lambda x: x IS NOT NULL)), ', ') AS skills FROM documents_corpus WHERE category = 'Resume' AND text IS NOT NULL""",
)
def resume_fields(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    df = table(spark, sf, "documents_corpus").filter("category = 'Resume' AND text IS NOT NULL")
    return df.select("id", extraction.email(t).alias("email"), extraction.phone(t).alias("phone"), F.array_join(extraction.skills(t), ", ").alias("skills"))


_NAME_SQL = f"""coalesce(CASE WHEN lower({_group_sql("text", extraction.NAME_LINE)}) NOT IN ('resume', 'curriculum vitae', 'summary', 'profile', 'name') THEN {_group_sql("text", extraction.NAME_LINE)} END,
    list_filter(list_transform({_LINES_SQL}[1:5], lambda x: trim(regexp_replace(x, '(?i)^(?:curriculum\\s+vitae\\s*-\\s*|resume\\s*-\\s*|cv\\s*-\\s*)', ''))),
    lambda x: NOT regexp_matches(lower(x), {_q("|".join(w.replace("+", chr(92) + "+") for w in extraction.NOT_NAME_LINES))}) AND len(string_split_regex(x, '\\s+')) BETWEEN 1 AND 4
    AND length(x) BETWEEN 2 AND 35 AND regexp_matches(x, '^\\p{{Lu}}'))[1])"""


@query("candidate_names", f"SELECT id, {_NAME_SQL} AS name FROM documents_corpus WHERE category = 'Resume'")
def candidate_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents_corpus").filter("category = 'Resume'").select("id", extraction.candidate_name(F.col("text")).alias("name"))


@query(
    "other_fields",
    f"""SELECT id, {_group_sql("text", extraction.CONTRACT_DATE)} AS effective_date, {_group_sql("text", extraction.ISO_DATE)} AS iso_date,
    coalesce({_group_sql("text", extraction.SUBJECT_LINE)}, 'General Correspondence') AS subject FROM documents_corpus""",
)
def other_fields(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    df = table(spark, sf, "documents_corpus")
    return df.select("id", extraction.contract_date(t).alias("effective_date"), extraction.other_date(t).alias("iso_date"), extraction.other_subject(t).alias("subject"))


_FIELDS_SQL = {
    "category = 'Invoice'": {
        "invoice_number": f"trim(coalesce({_NUMBERS_SQL}))", "date": f"coalesce({', '.join(_group_sql('text', p) for p in extraction.INVOICE_DATE)})", "company": _COMPANY_SQL,
        "subtotal": _after_sql("text", extraction.SUBTOTAL), "tax": _after_sql("text", extraction.TAX), "total_amount": _TOTAL_SQL,
    },
    "category = 'Resume'": {
        "name": _NAME_SQL, "email": _group_sql("text", extraction.EMAIL), "phone": f"coalesce({_PHONE_SQL})",
        "skills": f"nullif(array_to_string(list_sort(list_filter([{_SKILLS_SQL}], lambda x: x IS NOT NULL)), ', '), '')",
    },
    "coalesce(category, '') NOT IN ('Invoice', 'Resume', 'Contract')": {
        "document_title": f"coalesce(left({_LINES_SQL}[1], 60), 'General Document')", "date": _group_sql("text", extraction.ISO_DATE),
        "subject": f"coalesce({_group_sql('text', extraction.SUBJECT_LINE)}, 'General Correspondence')",
    },
}


@query(
    "extracted_values",
    " UNION ALL ".join(
        f"SELECT id, '{name}' AS field, coalesce({value}, 'Not Found') AS value FROM documents_corpus WHERE {kind}" for kind, fields in _FIELDS_SQL.items() for name, value in fields.items()
    ),
)
def extracted_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of every labelled document as a row."""
    df = table(spark, sf, "documents_corpus").select("id", F.explode(extraction.extract(F.col("text"), F.col("category"))).alias("field", "value"))
    return df


_MISSING = f"(v IS NULL OR lower(trim(v)) IN {_in(validation.PLACEHOLDERS)})"


@query(
    "validate_numbers",
    f"""SELECT id, CASE WHEN {_MISSING} THEN 'missing' WHEN length(trim(v)) < 3 THEN 'short' WHEN length(trim(v)) > 35 THEN 'long' WHEN lower(trim(v)) IN {_in(validation.NOT_NUMBERS)} THEN 'header'
    WHEN NOT regexp_matches(v, '[A-Za-z0-9]') THEN 'characters' END AS number_error,
    CASE WHEN {_MISSING.replace("(v", "(c").replace("trim(v", "trim(c")} THEN 'missing' WHEN length(trim(c)) < 2 THEN 'short' WHEN length(trim(c)) > 80 THEN 'long'
    WHEN lower(trim(c)) IN {_in(validation.NOT_COMPANIES)} THEN 'header' END AS company_error
    FROM (SELECT id, invoice_number AS v, company AS c FROM doc_records)""",
)
def validate_numbers(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records")
    return docs.select("id", validation.invoice_number_error(F.col("invoice_number")).alias("number_error"), validation.company_error(F.col("company")).alias("company_error"))


@query(
    "validate_amounts",
    f"""SELECT id, CASE WHEN {_MISSING} THEN 'missing' WHEN n IS NULL THEN 'format' WHEN n <= 0 THEN 'range' END AS amount_error FROM (SELECT id, v,
    TRY_CAST(regexp_extract(replace(regexp_replace(trim(v), '(?i)\\b(USD|PKR|EUR|GBP|Rs\\.?|AUD|CAD)\\b', '', 'g'), ',', ''), '[-+]?[0-9]*\\.?[0-9]+', 0) AS DOUBLE) AS n
    FROM (SELECT id, total_amount AS v FROM doc_records WHERE document_type = 'Invoice'))""",
)
def validate_amounts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").filter("document_type = 'Invoice'")
    return docs.select("id", validation.amount_error(F.col("total_amount")).alias("amount_error"))


@query(
    "validate_emails",
    f"""SELECT id, CASE WHEN {_MISSING} THEN 'missing' WHEN NOT regexp_full_match(trim(v), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+') THEN 'format'
    WHEN length(regexp_extract(split_part(trim(v), '@', 2), '\\.([^.]*)$', 1)) < 2 THEN 'domain' END AS email_error FROM (SELECT id, invoice_number AS v FROM doc_records WHERE document_type = 'Resume')""",
)
def validate_emails(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").filter("document_type = 'Resume'")
    return docs.select("id", validation.email_error(F.col("invoice_number")).alias("email_error"))


_JSON = "CASE WHEN json_valid(extracted_json) THEN json_extract_string(extracted_json, '$.flat_values.{}') END"


def _missing_sql(v: str) -> str:
    return _MISSING.replace("(v", f"({v}").replace("trim(v", f"trim({v}")


# The formats in the order in which they are tried; a value is taken by the first whose shape and calendar fit.
_DATES_SQL = ", ".join(
    f"CASE WHEN regexp_matches(trim(d), {_q(shape)}) THEN try_strptime(trim(d), '{fmt}') END"
    for fmt, (_, shape) in zip(
        ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%m-%d-%Y", "%d-%b-%Y", "%d-%B-%Y", "%d/%b/%Y", "%Y/%m/%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%d %b, %Y", "%B %d %Y"],
        validation.DATES,
    )
)
_YEAR_SQL = f"coalesce(year(coalesce({_DATES_SQL})), TRY_CAST(nullif(regexp_extract(trim(d), '\\b(19[0-9]{{2}}|20[0-9]{{2}})\\b', 1), '') AS INTEGER))"
_AMOUNT_SQL = "TRY_CAST(regexp_extract(replace(regexp_replace(trim(t), '(?i)\\b(USD|PKR|EUR|GBP|Rs\\.?|AUD|CAD)\\b', '', 'g'), ',', ''), '[-+]?[0-9]*\\.?[0-9]+', 0) AS DOUBLE)"
_CHECKS_SQL = {
    "Invoice": {
        "invoice_number": f"{_missing_sql('v')} OR length(trim(v)) < 3 OR length(trim(v)) > 35 OR lower(trim(v)) IN {_in(validation.NOT_NUMBERS)} OR NOT regexp_matches(v, '[A-Za-z0-9]')",
        "date": f"{_missing_sql('d')} OR {_YEAR_SQL} IS NULL OR NOT {_YEAR_SQL} BETWEEN 1950 AND 2035",
        "company": f"{_missing_sql('c')} OR length(trim(c)) < 2 OR length(trim(c)) > 80 OR lower(trim(c)) IN {_in(validation.NOT_COMPANIES)}",
        "total_amount": f"{_missing_sql('t')} OR {_AMOUNT_SQL} IS NULL OR {_AMOUNT_SQL} <= 0",
    },
    "Contract": {"contract_title": _missing_sql("contract_title"), "effective_date": _missing_sql("effective_date")},
}


def _failed_sql(kind: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _CHECKS_SQL[kind].items()) + "], lambda x: x IS NOT NULL)"


@query(
    "validation_report",
    f"""WITH f AS (SELECT id, document_type, {", ".join(f"{_JSON.format(n)} AS {a}" for n, a in (("invoice_number", "v"), ("date", "d"), ("company", "c"), ("total_amount", "t"),
    ("contract_title", "contract_title"), ("effective_date", "effective_date")))} FROM doc_records WHERE document_type <> 'Resume'),
    r AS (SELECT id, document_type, CASE document_type WHEN 'Invoice' THEN {_failed_sql("Invoice")} WHEN 'Contract' THEN {_failed_sql("Contract")} ELSE [] END AS failed,
    CASE document_type WHEN 'Invoice' THEN 4 WHEN 'Contract' THEN 2 ELSE 1 END AS checked,
    CASE WHEN document_type = 'Invoice' AND NOT {_missing_sql("t")} THEN {_AMOUNT_SQL} END AS parsed_amount FROM f)
    SELECT id, len(failed) = 0 AS is_valid, array_to_string(failed, ',') AS failed, CAST(checked - len(failed) AS INTEGER) AS passed_count, CAST(checked AS INTEGER) AS checked, parsed_amount FROM r""",
)
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every document but resumes, whose checks need patterns that the other engine lacks, by the rules of its type."""
    docs = table(spark, sf, "doc_records").filter("document_type <> 'Resume'")
    docs = repository.with_values(docs.select("id", "document_type", "extracted_json"))
    report = docs.select("id", validation.validate(F.col("document_type"), F.col("values")).alias("r"))
    return report.select("id", "r.is_valid", F.array_join("r.failed_fields", ",").alias("failed"), "r.passed_count", F.col("r.total_fields_checked").alias("checked"), "r.parsed_amount")


_RESUME_CHECKS = {
    "name": f"{_missing_sql('n')} OR length(trim(n)) < 2 OR length(trim(n)) > 60 OR lower(trim(n)) IN {_in(validation.NOT_NAMES)} OR NOT regexp_matches(n, '[A-Za-z]')",
    "email": f"""{_missing_sql("e")} OR NOT regexp_full_match(trim(e), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+')
    OR length(regexp_extract(split_part(trim(e), '@', 2), '\\.([^.]*)$', 1)) < 2""",
    "skills": _missing_sql("k"),
    "phone": f"""NOT {_missing_sql("f")} AND (NOT length(regexp_replace(trim(f), '[^0-9]', '', 'g')) BETWEEN 7 AND 16
    OR NOT regexp_matches(trim(f), '^(\\+?[0-9]{{1,4}}[\\s.-]?)?(\\(?\\d{{2,4}}\\)?[\\s.-]?)?[\\d\\s.-]{{5,16}}$'))""",
}


@query(
    "validation_resumes",
    f"""WITH v AS (SELECT id, {", ".join(f"{_JSON.format(n)} AS {a}" for n, a in (("name", "n"), ("email", "e"), ("phone", "f"), ("skills", "k")))} FROM doc_records WHERE document_type = 'Resume'),
    r AS (SELECT id, list_filter([{", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _RESUME_CHECKS.items())}], lambda x: x IS NOT NULL) AS bad, CASE WHEN {_missing_sql("f")} THEN 3 ELSE 4 END AS checked FROM v)
    SELECT id, len(bad) = 0 AS is_valid, array_to_string(bad, ',') AS failed, CAST(checked AS INTEGER) AS checked,
    CASE WHEN len(bad) = 0 THEN 'All ' || checked || ' required fields successfully validated.' ELSE 'Validation failed for ' || len(bad) || ' field(s): ' || array_to_string(bad, ', ') || '.' END AS summary FROM r""",
)
def validation_resumes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").filter("document_type = 'Resume'")
    docs = repository.with_values(docs.select("id", "document_type", "extracted_json"))
    return validation.detailed(docs, "document_type", "values", "r").select("id", "r.is_valid", F.array_join("r.failed_fields", ",").alias("failed"), F.size("r.field_results").alias("checked"), "r.summary")


# ---- chunks, retrieval, answers ----------------------------------------------------------------


@query(
    "chunk_sliding",
    f"""SELECT doc_id, CAST(s / 290 AS INTEGER) AS chunk_index, c AS chunk_text, CAST({_WORDS.format("c")} AS INTEGER) AS token_count FROM (SELECT doc_id, s, {STRIP.format("substr(t, CAST(s AS BIGINT) + 1, 350)")} AS c
    FROM (SELECT doc_id, t, unnest(range(0, length(t), 290)) AS s FROM (SELECT doc_id, {STRIP.format("coalesce(text, '')")} AS t FROM documents))) WHERE c <> ''""",
)
def chunk_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sliding(table(spark, sf, "documents"), "text", "doc_id")


@query(
    "chunk_packed",
    f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS ps FROM documents),
    w AS (SELECT doc_id, ps, 1 AS i, '' AS cur, NULL::VARCHAR AS done FROM p WHERE len(ps) > 0 UNION ALL
    SELECT doc_id, ps, i + 1, CASE WHEN length(cur) + length(ps[i]) + 1 <= 350 THEN {STRIP.format("cur || chr(10) || ps[i]")} WHEN length(cur) > 60 THEN right(cur, 60) || ' ' || ps[i] ELSE ps[i] END,
    CASE WHEN length(cur) + length(ps[i]) + 1 <= 350 OR cur = '' THEN NULL ELSE cur END FROM w WHERE i <= len(ps)),
    c AS (SELECT doc_id, i, done AS t FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, cur FROM w WHERE i = len(ps) + 1 AND cur <> '')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, t AS chunk_text, CAST({_WORDS.format("t")} AS INTEGER) AS token_count FROM c""",
)
def chunk_packed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.packed_chunks(table(spark, sf, "documents"), "text", "doc_id")


def _chunks(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    rows = table(spark, sf, "rag_chunks")
    if only is not None:
        rows = rows.join(only, "id", "left_semi")
    return rows.groupBy("id").agg(F.min(F.struct("chunk_text", "document_id")).alias("c")).select("id", "c.chunk_text", "c.document_id")


def _hits(spark: SparkSession, sf: str, longest: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions = table(spark, sf, "eval_items")
    chunks = _chunks(spark, sf)
    return retrieval.retrieve(questions, chunks, "item_id", "text", "id", "chunk_text", longest=longest, stops=retrieval.SHORT_STOP_WORDS), questions, chunks


_TERMS = "SELECT {k}, term, 1 + ln(count(*)) AS tf FROM (SELECT {k}, unnest(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9_]{{2,}}')) AS term FROM {s}) WHERE term NOT IN {stops} GROUP BY {k}, term"


@query(
    "tfidf_retrieve",
    f"""WITH ch AS (SELECT id, min(chunk_text) AS chunk_text FROM rag_chunks GROUP BY id),
    c AS ({_TERMS.format(k="id", t="chunk_text", s="ch", stops=_in(retrieval.SHORT_STOP_WORDS))}), q AS ({_TERMS.format(k="item_id", t="text", s="eval_items", stops=_in(retrieval.SHORT_STOP_WORDS))}),
    i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM ch)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term),
    cw AS (SELECT id, term, tf * idf AS v, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS n FROM c JOIN i USING (term)),
    qw AS (SELECT item_id, term, tf * idf AS v, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY item_id)) AS n FROM q JOIN i USING (term)),
    s AS (SELECT item_id, id, round_even(sum(qw.v / qw.n * cw.v / cw.n), 4) AS score FROM qw JOIN cw USING (term) GROUP BY item_id, id)
    SELECT item_id, id, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place FROM s WHERE score > 0.001) WHERE place <= 4""",
)
def tfidf_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    hits, _, _ = _hits(spark, sf)
    return hits.select("item_id", "id", F.round("score", 3).alias("score"))


def _phrases_sql(source: str, key: str, text: str, stops: str, longest: int) -> str:
    """(key, term, tf) of the words of texts and of their sequences."""
    more = "".join(
        f", [array_to_string(w[i:i + {n - 1}], ' ') for i in range(1, len(w) - {n - 2})]" for n in range(2, longest + 1)
    )
    return f"""SELECT {key}, term, 1 + ln(count(*)) AS tf FROM (SELECT {key}, unnest(flatten([w{more}])) AS term FROM (SELECT {key},
        list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN {stops}) AS w FROM {source})) GROUP BY {key}, term"""


def _hits_of_sql(questions: str, stops: str, longest: int, more: str = "") -> str:
    """Common tables ch, c, q, i, cw, qw and hits (item_id, id, score, place)."""
    return f"""ch AS (SELECT id, min(chunk_text) AS chunk_text, arg_min(document_id, chunk_text) AS document_id FROM rag_chunks GROUP BY id), qs AS ({questions}),
    c AS ({_phrases_sql("ch", "id", "chunk_text", stops, longest)}), q AS ({_phrases_sql("qs", "item_id", "text", stops, longest)}),
    i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM ch)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term),
    cw AS (SELECT id, term, tf * idf AS v, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS n FROM c JOIN i USING (term)),
    qw AS (SELECT item_id, term, tf * idf AS v, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY item_id)) AS n FROM q JOIN i USING (term)),
    sc AS (SELECT item_id, id, round_even(sum(qw.v / qw.n * cw.v / cw.n), 4) AS score FROM qw JOIN cw USING (term){more} GROUP BY item_id, id),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS place FROM sc WHERE score > 0.001) WHERE place <= 4)"""


_ITEMS = "SELECT item_id, text FROM eval_items"


@query("tfidf_retrieve_phrases", f"WITH {_hits_of_sql(_ITEMS, _in(retrieval.ENGLISH), 3)} SELECT item_id, id, round(score, 3) AS score FROM hits")
def tfidf_retrieve_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The whole operator: terms of one to three words, Spark's English stop words."""
    hits = retrieval.retrieve(table(spark, sf, "eval_items"), _chunks(spark, sf), "item_id", "text", "id", "chunk_text", longest=3)
    return hits.select("item_id", "id", F.round("score", 3).alias("score"))


_SPOKEN_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{3,}}'))"


@query(
    "grounded_answers",
    f"""WITH {_hits_of_sql(_ITEMS, _in(retrieval.SHORT_STOP_WORDS), 3)},
    sen AS (SELECT item_id, id, score, place, document_id, qtext, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS position FROM (SELECT h.*, ch.document_id, qs.text AS qtext,
        list_filter(string_split(regexp_replace(ch.chunk_text, '([.!?\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss FROM hits h JOIN ch USING (id) JOIN qs USING (item_id))),
    best AS (SELECT * FROM sen QUALIFY row_number() OVER (PARTITION BY item_id, id ORDER BY len(list_intersect({_SPOKEN_WORDS.format("qtext")}, {_SPOKEN_WORDS.format("sentence")})) DESC, position) = 1),
    told AS (SELECT item_id, max(score) AS max_similarity, CAST(count(DISTINCT document_id) AS INTEGER) AS cited FROM best GROUP BY item_id),
    said AS (SELECT item_id, trim(sentence) AS line, min(place) AS place FROM best GROUP BY item_id, trim(sentence)),
    joined AS (SELECT item_id, list(line ORDER BY place) AS ls FROM said GROUP BY item_id)
    SELECT item_id, CASE WHEN max_similarity < 0.15 THEN '{retrieval.NO_ANSWER}' WHEN cited > 1 THEN '- ' || array_to_string(ls, chr(10) || '- ') ELSE array_to_string(ls[1:3], ' ') END AS answer,
    CASE WHEN max_similarity < 0.15 THEN 0 ELSE cited END AS cited, max_similarity, max_similarity >= 0.15 AS is_grounded FROM told JOIN joined USING (item_id)""",
)
def grounded_answers(spark: SparkSession, sf: str) -> DataFrame:
    hits, questions, _ = _hits(spark, sf, longest=3)
    hits = stored(hits, "hits")
    chunks = _chunks(spark, sf, hits.select("id").distinct())
    spoken = stored(retrieval.best_sentences(hits, questions, chunks, "item_id", "text", "id", "chunk_text"), "sentences")
    out = retrieval.answers(spoken, chunks, "item_id", "id")
    return out.select("item_id", "answer", F.size("citations").alias("cited"), "max_similarity", "is_grounded")


@query(
    "top_terms_by_class",
    f"""WITH d AS (SELECT id, category, text FROM documents_corpus WHERE category IN ('Invoice', 'Resume', 'Other')), c AS ({_phrases_sql("d", "id", "text", _in(retrieval.SHORT_STOP_WORDS), 2)}),
    i AS (SELECT term, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term),
    w AS (SELECT id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w FROM c JOIN i USING (term)), n AS (SELECT category, count(*) AS n FROM d GROUP BY category),
    m AS (SELECT category, term, round_even(sum(w) / any_value(n), 6) AS mean_weight FROM w JOIN d USING (id) JOIN n USING (category) GROUP BY category, term)
    SELECT category, term, mean_weight, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY mean_weight DESC, term) AS INTEGER) AS place FROM m) WHERE place <= 10""",
)
def top_terms_by_class(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "documents_corpus").filter(F.col("category").isin("Invoice", "Resume", "Other"))
    counts = retrieval.term_counts(corpus, "id", "text", retrieval.SHORT_STOP_WORDS, 2)
    return retrieval.top_terms(counts, retrieval.idf(counts, corpus), corpus, "id", "category")


@query(
    "shared_words",
    """WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(chunk_text), '[a-z0-9_]{3,}')) AS s, document_id, chunk_index FROM (SELECT DISTINCT id, document_id, chunk_index, chunk_text FROM rag_chunks))
    SELECT a.id AS id, b.id AS next_id, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS shared FROM w a JOIN w b ON a.document_id = b.document_id AND a.chunk_index + 1 = b.chunk_index""",
)
def shared_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that consecutive chunks of a document share; the join is on document and position."""
    chunks = table(spark, sf, "rag_chunks").select("id", "document_id", "chunk_index", "chunk_text").distinct()
    w = chunks.select("id", "document_id", "chunk_index", F.array_distinct(F.regexp_extract_all(F.lower("chunk_text"), F.lit("([a-z0-9_]{3,})"), F.lit(1))).alias("s"))
    b = w.select(F.col("id").alias("next_id"), "document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("s").alias("t"))
    return w.join(b, ["document_id", "chunk_index"]).select("id", "next_id", F.size(F.array_intersect("s", "t")).alias("shared"))


# ---- register: further views -------------------------------------------------------------------

_ANOMALOUS = "coalesce(CASE WHEN json_valid(anomaly_json) THEN json_extract_string(anomaly_json, '$.has_anomalies') END = 'true', false)"


@query(
    "dashboard_metrics",
    registry.sql["register_metrics"].replace("SELECT count(*) AS documents", f"SELECT count(*) FILTER (WHERE {_ANOMALOUS}) AS anomalies, (SELECT count(DISTINCT id) FROM rag_chunks) AS chunks, count(*) AS documents"),
)
def dashboard_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return repository.dashboard(table(spark, sf, "doc_records"), table(spark, sf, "rag_chunks"))


def _order_sql(sort: str) -> str:
    names = repository.SORTS[sort] or ["-id"]
    return ", ".join(f"{n[1:]} DESC NULLS LAST" if n[0] == "-" else f"{n} ASC NULLS FIRST" for n in names)


def _register_sort(sort: str) -> None:
    @query(f"search_by_{sort}", f"SELECT id, original_filename FROM doc_records WHERE ({_LIKE.format(*['in'] * 5)}) AND status = 'Completed' ORDER BY {_order_sql(sort)} LIMIT 40 OFFSET 10")
    def search_by(spark: SparkSession, sf: str) -> DataFrame:
        """A page of the search in one of its orders; the limit is the page."""
        return repository.search(table(spark, sf, "doc_records"), "in", "Completed", sort=sort, limit=40, offset=10).select("id", "original_filename")


for _sort in repository.SORTS:
    _register_sort(_sort)

_FIFTH = " OR ".join(f"{c} ILIKE '%ltd%'" for c in repository.SEARCHED_FIFTH)


@query(
    "search_latest_action",
    f"""WITH page AS (SELECT * FROM doc_records WHERE ({_FIFTH}) AND document_type = 'Invoice' ORDER BY upload_date DESC NULLS LAST, id DESC LIMIT 100),
    a AS (SELECT document_id, arg_max(action, id) AS action, arg_max(logged_at, id) AS at FROM audit_log GROUP BY document_id)
    SELECT p.id, p.original_filename, p.document_type, p.status, coalesce(CAST(CAST(round_even(p.confidence * 100, 0) AS INTEGER) AS VARCHAR) || '%', 'N/A') AS confidence_text, p.company, p.invoice_number,
    p.total_amount, strftime(p.upload_date, '%Y-%m-%d %H:%M') AS uploaded, coalesce(a.action, 'N/A') AS latest_action, coalesce(strftime(a.at, '%Y-%m-%d %H:%M'), 'N/A') AS action_time
    FROM page p LEFT JOIN a ON p.id = a.document_id""",
)
def search_latest_action(spark: SparkSession, sf: str) -> DataFrame:
    return repository.display_with_latest(repository.search_with_latest(table(spark, sf, "doc_records"), table(spark, sf, "audit_log"), query="ltd", kind="Invoice"))


_FOURTH = " OR ".join(f"{c} ILIKE '%invoice%'" for c in repository.SEARCHED_FOURTH)


@query(
    "search_lexical",
    f"""SELECT id, stored_filename FROM doc_records WHERE ({_FOURTH}) AND strftime(upload_date, '%Y-%m-%d %H:%M:%S') >= '2025-01-05 00:00:00' AND rtrim(rtrim(strftime(upload_date, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')
    <= '2025-02-20 23:59:59'""",
)
def search_lexical(spark: SparkSession, sf: str) -> DataFrame:
    found = repository.search(table(spark, sf, "doc_records"), "invoice", since="2025-01-05", until="2025-02-20", sort="type", columns=repository.SEARCHED_FOURTH, lexical=True)
    return found.select("id", "stored_filename")


@query("documents_in_states", "SELECT id, status FROM doc_records WHERE status IN ('Needs Review', 'Rejected')")
def documents_in_states(spark: SparkSession, sf: str) -> DataFrame:
    return repository.in_states(table(spark, sf, "doc_records"), ["Needs Review", "Rejected"]).select("id", "status")


def _kept_sql(k: str, default: str) -> str:
    return f"coalesce({_JSON.format(k)}, '{default}')"


_SKILLS_SHORT = f"CASE WHEN length({_kept_sql('skills', 'Not Found')}) > 28 THEN concat(left({_kept_sql('skills', 'Not Found')}, 28), '...') ELSE {_kept_sql('skills', 'Not Found')} END"


@query(
    "register_columns",
    f"""SELECT id, CASE document_type WHEN 'Invoice' THEN {_kept_sql("company", "Not Found")} WHEN 'Resume' THEN {_kept_sql("name", "Not Found")} WHEN 'Contract' THEN {_kept_sql("contract_title", "Agreement")}
    ELSE {_kept_sql("document_title", "General Document")} END AS company,
    CASE document_type WHEN 'Invoice' THEN {_kept_sql("invoice_number", "Not Found")} WHEN 'Resume' THEN {_kept_sql("email", "Not Found")} WHEN 'Contract' THEN {_kept_sql("governing_law", "General")}
    ELSE {_kept_sql("subject", "N/A")} END AS invoice_number,
    CASE document_type WHEN 'Invoice' THEN {_kept_sql("total_amount", "Not Found")} WHEN 'Resume' THEN {_SKILLS_SHORT} WHEN 'Contract' THEN {_kept_sql("effective_date", "Not Found")}
    ELSE {_kept_sql("date", "N/A")} END AS total_amount FROM doc_records""",
)
def register_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = repository.with_values(table(spark, sf, "doc_records").select("id", "document_type", "extracted_json"))
    return docs.select("id", repository.register_columns(F.col("document_type"), F.col("values")).alias("k")).select("id", "k.*")


def _number_sql(k: str) -> str:
    return f"TRY_CAST(regexp_extract(replace(coalesce({_JSON.format(k)}, ''), ',', ''), '[-+]?[0-9]*\\.?[0-9]+', 0) AS DOUBLE)"


@query(
    "arithmetic_checks",
    f"""SELECT id, s AS subtotal, x AS tax, t AS total, s + x AS expected, round_even(abs(s + x - t), 2) AS discrepancy, abs(s + x - t) > 0.05 AS mismatch
    FROM (SELECT id, {_number_sql("subtotal")} AS s, {_number_sql("tax")} AS x, {_number_sql("total_amount")} AS t FROM doc_records WHERE document_type = 'Invoice') WHERE s + x - t IS NOT NULL""",
)
def arithmetic_checks(spark: SparkSession, sf: str) -> DataFrame:
    return repository.arithmetic_checks(table(spark, sf, "doc_records"))


@query(
    "repeated_groups",
    f"""WITH k AS (SELECT DISTINCT id, invoice_number FROM doc_records WHERE lower(trim(coalesce(invoice_number, ''))) NOT IN {_in(repository.PLACEHOLDERS)})
    SELECT invoice_number, count(*) AS documents, min(id) AS first_id, CASE WHEN count(*) <= 1000 THEN string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) END AS ids FROM k GROUP BY invoice_number HAVING count(*) > 1""",
)
def repeated_groups(spark: SparkSession, sf: str) -> DataFrame:
    return repository.repeated_groups(table(spark, sf, "doc_records"))


@query(
    "batch_outcomes",
    """SELECT batch_no, count(*) AS submitted, count(*) FILTER (WHERE status <> 'Failed' AND NOT again) AS successes, count(*) FILTER (WHERE status = 'Failed' AND NOT again) AS failures,
    count(*) FILTER (WHERE again) AS duplicates, round_even(coalesce(sum(processing_time_ms), 0), 2) AS total_ms, round_even(coalesce(sum(processing_time_ms), 0) / greatest(count(*), 1), 2) AS avg_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY id) > 1 AND trim(coalesce(file_hash, '')) <> '' AS again FROM doc_records) WHERE batch_no = 9 GROUP BY batch_no""",
)
def batch_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of the last batch of submissions."""
    docs = table(spark, sf, "doc_records").select("id", "batch_no", "status", "file_hash", "processing_time_ms")
    again = repository.duplicates_by_hash(docs).select("id", F.lit(True).alias("is_duplicate"))
    results = docs.filter("batch_no = 9").join(again, "id", "left").withColumn("success", F.col("status") != "Failed")
    return repository.batch_outcomes(results).select(F.lit(9).alias("batch_no"), "*")


@query(
    "evaluation_counts",
    """SELECT count(*) AS selected, count(*) FILTER (WHERE status IS NOT NULL) AS processed, count(*) FILTER (WHERE status = 'Completed') AS completed, count(*) FILTER (WHERE status = 'Needs Review') AS review,
    count(*) FILTER (WHERE status = 'Rejected') AS rejected, count(*) FILTER (WHERE status IS NULL OR status = 'Failed') AS failed
    FROM (SELECT DISTINCT document_id FROM audit_log) r LEFT JOIN doc_records d ON d.id = r.document_id""",
)
def evaluation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of the documents that have events, as a batch evaluation counts them."""
    asked = table(spark, sf, "audit_log").select(F.col("document_id").alias("id"))
    found = repository.requested(table(spark, sf, "doc_records"), asked)
    return repository.evaluation_counts(found.select(F.col("status").alias("new_status"), F.col("status").isNotNull().alias("success")))


@query(
    "requested_by_audit",
    """SELECT r.id, d.document_type, d.status, CASE WHEN d.id IS NULL THEN 'Failed' ELSE 'Found' END AS outcome FROM (SELECT DISTINCT document_id AS id FROM audit_log) r LEFT JOIN doc_records d ON r.id = d.id""",
)
def requested_by_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that has events, with what the register has of it."""
    return repository.requested(table(spark, sf, "doc_records"), table(spark, sf, "audit_log").select(F.col("document_id").alias("id")))


@query("lookup_every_twentieth", "SELECT id, document_type FROM doc_records WHERE id IN (SELECT document_id FROM audit_log WHERE document_id % 20 = 0)")
def lookup_every_twentieth(spark: SparkSession, sf: str) -> DataFrame:
    """A list of ids that grows with the register: those of the log that are divisible by 20."""
    ids = table(spark, sf, "audit_log").filter("document_id % 20 = 0").select(F.col("document_id").alias("id"))
    return repository.by_ids(table(spark, sf, "doc_records"), ids).select("id", "document_type")


@query(
    "action_colours",
    "SELECT action, CASE action "
    + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in repository.ACTION_COLOURS.items())
    + f" ELSE '{repository.NO_COLOUR}' END AS colour, count(*) AS n FROM {_AUDIT} GROUP BY ALL",
)
def action_colours(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "audit_log").dropDuplicates(["id"])
    return log.groupBy("action").agg(F.count("*").alias("n")).select("action", repository.action_colour(F.col("action")).alias("colour"), "n")


@query("named_nations", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def named_nations(spark: SparkSession, sf: str) -> DataFrame:
    """Codes shown by their names."""
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return repository.named(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "nation").select("c_custkey", "nation")


# one anomaly may stand where the list is expected
_SEVERITY = "coalesce(CASE WHEN json_valid(anomaly_json) THEN list_concat(json_extract_string(anomaly_json, '$.anomalies[*].severity'), [json_extract_string(anomaly_json, '$.anomalies.severity')]) END, [])"


@query(
    "highest_severity",
    f"SELECT id, CASE WHEN list_contains(s, 'HIGH') THEN 'HIGH' WHEN list_contains(s, 'MEDIUM') THEN 'MEDIUM' WHEN list_contains(s, 'LOW') THEN 'LOW' ELSE 'NONE' END AS severity FROM (SELECT id, {_SEVERITY} AS s FROM doc_records)",
)
def highest_severity(spark: SparkSession, sf: str) -> DataFrame:
    valid = F.try_parse_json("anomaly_json").isNotNull()
    found = F.from_json(F.when(valid, F.get_json_object("anomaly_json", "$.anomalies")), "array<struct<severity:string>>")
    return table(spark, sf, "doc_records").select("id", repository.highest_severity(found["severity"]).alias("severity"))


@query(
    "edited_values",
    f"""SELECT id, 'Reviewed Ltd' AS company, {_JSON.format("invoice_number")} AS invoice_number, '12.00' AS total_amount FROM doc_records WHERE document_type = 'Invoice' AND status = 'Needs Review'""",
)
def edited_values(spark: SparkSession, sf: str) -> DataFrame:
    """The values of reviewed invoices after an edit of two of them."""
    docs = table(spark, sf, "doc_records").filter("document_type = 'Invoice' AND status = 'Needs Review'")
    change = F.create_map(F.lit("company"), F.lit("Reviewed Ltd"), F.lit("total_amount"), F.lit("12.00"))
    docs = repository.with_values(docs).withColumn("edited", extraction.edited(F.col("values"), change))
    return docs.select("id", *(F.try_element_at("edited", F.lit(c)).alias(c) for c in ("company", "invoice_number", "total_amount")))


@query(
    "overwritten_fields",
    """SELECT id, CASE WHEN status = 'Rejected' THEN 'Checked' ELSE company END AS company, CASE WHEN status = 'Rejected' THEN 'Not Found' ELSE invoice_number END AS invoice_number FROM doc_records""",
)
def overwritten_fields(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").select("id", "status", "company", "invoice_number")
    changes = docs.filter("status = 'Rejected'").select("id", F.lit("Checked").alias("company"))
    return repository.overwrite(docs, changes, {k: repository.EDIT_DEFAULTS[k] for k in ("company", "invoice_number")}).select("id", "company", "invoice_number")


@query("chunks_of_document", "SELECT DISTINCT id, chunk_index FROM rag_chunks WHERE document_id = (SELECT min(document_id) FROM rag_chunks)")
def chunks_of_document(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "rag_chunks")
    first = chunks.agg(F.min("document_id")).first()[0]  # one number
    return repository.chunks_of_document(chunks, first).select("id", "chunk_index")


@query(
    "value_quartiles",
    """SELECT event_type, count(value) AS n, round_even(avg(value), 6) AS mean, round_even(stddev_samp(value), 6) AS deviation, min(value) AS least, round_even(quantile_cont(value, 0.25), 6) AS lower,
    round_even(quantile_cont(value, 0.5), 6) AS middle, round_even(quantile_cont(value, 0.75), 6) AS upper, max(value) AS most FROM events GROUP BY event_type""",
)
def value_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return tx_describe(table(spark, sf, "events"), "value", "event_type")


def tx_describe(df: DataFrame, column: str, group: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of a number, of each group."""
    v = F.col(column)
    return df.groupBy(group).agg(
        F.count(v).alias("n"), F.bround(F.avg(v), 6).alias("mean"), F.bround(F.stddev_samp(v), 6).alias("deviation"), F.min(v).alias("least"),
        *(F.bround(F.percentile(v, q), 6).alias(a) for q, a in ((0.25, "lower"), (0.5, "middle"), (0.75, "upper"))), F.max(v).alias("most"),
    )


@query(
    "classify_overall",
    f"""SELECT CAST(sum(support) AS BIGINT) AS rows, round_even(sum(recall * support) / sum(support), 6) AS accuracy, round_even(sum(precision * support) / sum(support), 6) AS precision,
    round_even(sum(recall * support) / sum(support), 6) AS recall, round_even(sum(f1 * support) / sum(support), 6) AS f1 FROM ({registry.sql["classify_report"]})""",
)
def classify_overall(spark: SparkSession, sf: str) -> DataFrame:
    corpus = table(spark, sf, "documents_corpus").filter(F.col("category").isin("Invoice", "Resume", "Other"))
    return classification.overall(classification.classify(corpus, "text"), "category", "predicted_type")


def _rule_sql(kind: str) -> str:
    marks = " OR ".join(f"contains(t, '{m}')" for m in classification.MARKS[kind])
    return f"{_times_sql('t', classification.RULES[kind])} + CASE WHEN {marks} THEN {classification.MARK_HITS} ELSE 0 END"


@query(
    "rules_against_keywords",
    f"""WITH k AS ({_classify_sql("documents_corpus", "id", "text", "category, text,")}),
    r AS (SELECT category, predicted_type AS baseline, {_rule_sql("Invoice")} AS inv, {_rule_sql("Resume")} AS res FROM (SELECT *, lower(coalesce(text, '')) AS t FROM k WHERE category IN ('Invoice', 'Resume', 'Other')))
    SELECT model, baseline, count(*) AS n, count(*) FILTER (WHERE category = model) AS model_right, count(*) FILTER (WHERE category = baseline) AS baseline_right
    FROM (SELECT *, CASE WHEN inv + res < 2 THEN 'Other' WHEN inv > res THEN 'Invoice' WHEN res > inv THEN 'Resume' ELSE 'Other' END AS model FROM r) GROUP BY model, baseline""",
)
def rules_against_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """How the first stage's rules and the keywords go together on the labelled corpus."""
    corpus = table(spark, sf, "documents_corpus").filter(F.col("category").isin("Invoice", "Resume", "Other")).select("id", "category", "text")
    told = classification.classify(corpus, "text").withColumnRenamed("predicted_type", "keywords").drop("confidence_predicted")
    return classification.against_baseline(classification.classify_rules(told, "text"), "predicted_type", "keywords", "category")


def _missing_fields_sql(kind: str) -> str:
    fields = _FIELDS_SQL[f"category = '{kind}'"]
    required = [n for n, _, _, r in extraction.PROFILES[kind] if r]
    return "list_filter([" + ", ".join(f"CASE WHEN {fields[n]} IS NULL THEN '{n}' END" for n in required) + "], lambda x: x IS NOT NULL)"


@query(
    "corpus_audit",
    f"""WITH k AS ({_classify_sql("documents_corpus", "id", "text", "text,")}),
    m AS (SELECT *, CASE predicted_type WHEN 'Invoice' THEN {_missing_fields_sql("Invoice")} WHEN 'Resume' THEN {_missing_fields_sql("Resume")} ELSE [] END AS bad FROM k WHERE text IS NOT NULL)
    SELECT id AS name, predicted_type, confidence_predicted, CASE WHEN len(bad) = 0 THEN 'None' ELSE array_to_string(bad, ', ') END AS missing_fields,
    CASE predicted_type WHEN 'Invoice' THEN round_even(100.0 * (4 - len(bad)) / 4, 1) WHEN 'Resume' THEN round_even(100.0 * (3 - len(bad)) / 3, 1) ELSE 100.0 END AS completeness FROM m""",
)
def corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Type, confidence, missing fields and completeness of each text of the corpus."""
    texts = table(spark, sf, "documents_corpus").filter("text IS NOT NULL").select(F.col("id").alias("name"), F.col("text").alias("clean_text"))
    return api.audit_of_files(texts)


@query(
    "cleaning_summary",
    rf"""SELECT doc_id, length(t) AS raw_chars, length(c) AS clean_chars, {_WORDS.format("t")} AS raw_words, {_WORDS.format("c")} AS clean_words, length(t) - length(c) AS removed_chars,
    CASE WHEN length(t) > 0 THEN round_even((length(t) - length(c)) * 100.0 / length(t), 1) ELSE 0 END AS reduction
    FROM (SELECT doc_id, coalesce(text, '') AS t, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda x: x <> ''), ' ') AS c FROM documents)""",
)
def cleaning_summary(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.cleaning_summary(t, tx.squeezed(t)).alias("s")).select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("raw_chars", "clean_chars", "raw_words", "clean_words", "removed_chars")), "s.reduction")


@query(
    "text_functions",
    r"""SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(chunk_text), '[a-z0-9_]{3,}'))), ' ') AS words, CASE WHEN length(chunk_text) > 180 THEN concat(left(chunk_text, 180), '...') ELSE chunk_text END AS excerpt,
    TRY_CAST(regexp_extract(replace(coalesce(chunk_text, ''), ',', ''), '[-+]?[0-9]*\.?[0-9]+', 0) AS DOUBLE) AS first_number FROM (SELECT DISTINCT id, chunk_text FROM rag_chunks) WHERE NOT regexp_matches(chunk_text, '[^\x00-\x7F]')""",
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Word sets, excerpts and first numbers of chunks in plain letters, where both engines have the same notion of a word."""
    t = F.col("chunk_text")
    chunks = table(spark, sf, "rag_chunks").select("id", "chunk_text").distinct().filter(~t.rlike(r"[^\x00-\x7F]"))
    return chunks.select("id", F.array_join(F.array_sort(tx.word_set(t)), " ").alias("words"), tx.excerpt(t).alias("excerpt"), tx.parse_numeric(t).alias("first_number"))


@query(
    "stored_names",
    registry.sql["file_names"].split("SELECT id, CASE")[0].replace("SELECT id, file_hash, regexp", "SELECT id, file_hash, upload_date, regexp").replace("SELECT id, file_hash, lower", "SELECT id, file_hash, upload_date, lower")
    + "SELECT id, strftime(upload_date, '%Y%m%d_%H%M%S') || '_' || left(file_hash, 8) || '_' || CASE WHEN stem = '' THEN 'document' ELSE stem END || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS name FROM s WHERE file_hash IS NOT NULL",
)
def stored_names(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "doc_records").filter("file_hash IS NOT NULL")
    return docs.select("id", ff.stored_name(F.col("original_filename"), F.col("file_hash"), F.col("upload_date"), fold=False).alias("name"))


@query("money_texts", "SELECT id, format('{:,.2f}', processing_time_ms) AS money FROM doc_records WHERE processing_time_ms IS NOT NULL AND abs(processing_time_ms * 100 - round(processing_time_ms * 100)) < 1e-6")
def money_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of two decimals written as money."""
    t = F.col("processing_time_ms")
    return table(spark, sf, "doc_records").filter(t.isNotNull() & (F.abs(t * 100 - F.round(t * 100)) < 1e-6)).select("id", tx.money(t).alias("money"))


@query(
    "packed_pages",
    f"""WITH RECURSIVE g AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS page FROM (SELECT doc_id, string_split_regex(text, '\\n{{3,}}|\\f') AS ps FROM documents WHERE text IS NOT NULL)),
    p AS (SELECT doc_id, page, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: {STRIP.format("x")}), lambda x: x <> '') AS ps FROM g),
    w AS (SELECT doc_id, page, ps, 1 AS i, '' AS cur, NULL::VARCHAR AS done FROM p WHERE len(ps) > 0 UNION ALL
    SELECT doc_id, page, ps, i + 1, CASE WHEN length(cur) + length(ps[i]) + 1 <= 350 THEN {STRIP.format("cur || chr(10) || ps[i]")} WHEN length(cur) > 60 THEN right(cur, 60) || ' ' || ps[i] ELSE ps[i] END,
    CASE WHEN length(cur) + length(ps[i]) + 1 <= 350 OR cur = '' THEN NULL ELSE cur END FROM w WHERE i <= len(ps)),
    c AS (SELECT doc_id, page, i, done AS t FROM w WHERE done IS NOT NULL UNION ALL SELECT doc_id, page, i + 1, cur FROM w WHERE i = len(ps) + 1 AND cur <> '')
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS INTEGER) AS chunk_index, CAST(page AS INTEGER) AS page_number, t AS chunk_text, CAST({_WORDS.format("t")} AS INTEGER) AS token_count FROM c""",
)
def packed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of each page of a document packed into chunks; the counter runs on over the pages."""
    pages = F.split("text", r"\n{3,}|\f")
    return chunking.packed_pages(table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", pages.alias("pages")), "pages", "doc_id")


_FIRST_CHUNKS = "SELECT document_id AS item_id, arg_min(chunk_text, id) AS text FROM ch WHERE document_id % 20 = 0 GROUP BY document_id"


@query(
    "retrieve_in_document",
    f"""WITH {_hits_of_sql(_FIRST_CHUNKS, _in(retrieval.ENGLISH), 1, " JOIN ch USING (id) WHERE ch.document_id = item_id")} SELECT item_id AS q, id, round(score, 3) AS score FROM hits""",
)
def retrieve_in_document(spark: SparkSession, sf: str) -> DataFrame:
    """Questions limited to a document: its first chunk is asked for among its own, with frequencies of all chunks."""
    chunks = _chunks(spark, sf)
    asked = chunks.groupBy("document_id").agg(F.min_by("chunk_text", "id").alias("text")).filter("document_id % 20 = 0").select(F.col("document_id").alias("q"), "document_id", "text")
    hits = retrieval.retrieve(asked, chunks, "q", "text", "id", "chunk_text", longest=1, scope="document_id")
    return hits.select("q", "id", F.round("score", 3).alias("score"))

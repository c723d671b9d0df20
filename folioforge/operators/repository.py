"""The document register: lookups, searches, joins, metrics and changes, DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.textops import excerpt, parse_numeric, percent
from folioforge.session import stored

STATUSES = ["New", "Processing", "Needs Review", "Approved", "Rejected", "Completed", "Failed"]
CATEGORIES = ["Invoice", "Resume", "Contract", "Other"]
SEARCHED = ["original_filename", "company", "invoice_number", "total_amount", "text_preview"]
PLACEHOLDERS = ["", "-", "n/a", "not found", "not specified"]

#: What the earlier stages search in.
SEARCHED_FIFTH = ["original_filename", "company", "invoice_number", "document_type", "text_preview", "review_reason"]
SEARCHED_FOURTH = ["original_filename", "stored_filename", "company", "invoice_number", "document_type", "text_preview", "extracted_json"]
# Sort orders of the search; what is not listed sorts as newest.
SORTS: dict[str, list[Column] | None] = {
    "newest": None,
    "oldest": ["id"],
    "filename_asc": ["original_filename", "id"],
    "filename_desc": ["-original_filename", "id"],
    "status": ["status", "-upload_date", "id"],
    "confidence_asc": ["confidence", "id"],
    "confidence_desc": ["-confidence", "id"],
    "newest_upload": ["-upload_date", "-id"],
    "oldest_upload": ["upload_date", "id"],
    "filename": ["original_filename", "id"],
    "company": ["company", "id"],
    "type": ["document_type", "-upload_date", "id"],
}


def sort_columns(sort: str) -> list[Column]:
    """Nulls come first going up and last going down."""
    names = SORTS.get(sort) or ["-id"]
    return [F.col(n[1:]).desc_nulls_last() if n[0] == "-" else F.col(n).asc_nulls_first() for n in names]


def by_id(docs: DataFrame, key: int) -> DataFrame:
    return docs.filter(F.col("id") == key)


def by_hash(docs: DataFrame, file_hash: str) -> DataFrame:
    """Nothing for an empty hash."""
    return docs.filter((F.col("file_hash") == file_hash) & (F.lit(file_hash) != ""))


def by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id").distinct(), "id", "left_semi")


def requested(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Every requested id with its document; the absent ones have the outcome Failed."""
    found = docs.select("id", "document_type", "status")
    return ids.select("id").distinct().join(found, "id", "left").withColumn("outcome", F.when(F.col("status").isNull() & F.col("document_type").isNull(), "Failed").otherwise("Found"))


def search(docs: DataFrame, query: str = "", status: str = "All", kind: str = "All", since: str | None = None, until: str | None = None, sort: str = "newest",
           limit: int | None = None, offset: int = 0, columns: list[str] | None = None, lexical: bool = False) -> DataFrame:
    """Any of the searched columns contains the query (% and _ are wild); other conditions hold where they are set.

    lexical: times are compared as texts to the second, as the fourth stage does, so one within the last second of the day is later.
    """
    df = docs
    if query.strip():
        hit = F.lit(False)
        for c in columns or SEARCHED:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{query.strip()}%"), F.lit(False))
        df = df.filter(hit)
    if status != "All":
        df = df.filter(F.col("status") == status)
    if kind != "All":
        df = df.filter(F.col("document_type") == kind)
    if lexical:
        at = F.date_format("upload_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        if since:
            df = df.filter(at >= f"{since} 00:00:00")
        if until:
            df = df.filter(F.regexp_replace(at, r"\.?0*$", "") <= f"{until} 23:59:59")
        since = until = None
    if since:
        df = df.filter(F.col("upload_date") >= F.to_date(F.lit(since)).cast("timestamp_ntz"))
    if until:
        df = df.filter(F.col("upload_date") < F.date_add(F.to_date(F.lit(until)), 1).cast("timestamp_ntz"))
    df = df.orderBy(*sort_columns(sort))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def search_with_latest(docs: DataFrame, audit: DataFrame, **conditions) -> DataFrame:
    """search, each document with its latest action and the time of it; conditions as those of search.

    The page comes first, so only its documents' events are looked at.
    """
    conditions = {"columns": SEARCHED_FIFTH, "sort": "newest_upload", "limit": 100} | conditions
    page = search(docs, **conditions)
    wanted = page.select(F.col("id").alias("document_id"))
    last = latest_action(audit.join(wanted, "document_id", "left_semi")).select(F.col("document_id").alias("id"), F.col("action").alias("latest_action"), F.col("logged_at").alias("latest_action_time"))
    return page.join(last, "id", "left")


def in_states(docs: DataFrame, states: list[str]) -> DataFrame:
    """Documents in one of the states; all where none is named."""
    return docs.filter(F.col("status").isin(states)) if states else docs


def with_anomalies(docs: DataFrame) -> DataFrame:
    """Documents whose report says that it has anomalies."""
    return docs.filter(F.coalesce(F.get_json_object("anomaly_json", "$.has_anomalies"), F.lit("false")) == "true")


def all_documents(docs: DataFrame) -> DataFrame:
    return docs.orderBy(F.desc("id"))


def chunks_of_document(chunks: DataFrame, key: int) -> DataFrame:
    """The chunks of one document in order; repeated rows once."""
    return chunks.filter(F.col("document_id") == key).dropDuplicates(["id"]).orderBy("chunk_index", "id")


def chunks_of_documents(chunks: DataFrame, docs: DataFrame, ordered: bool = False) -> DataFrame:
    """Chunks with their document's name and type; ordered: by document and index."""
    out = _chunks_of_documents(chunks, docs)
    return out.orderBy("document_id", "chunk_index", "id") if ordered else out


def _chunks_of_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select(F.col("id").alias("document_id"), "original_filename", "document_type"), "document_id")


def recent_audit(audit: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """The last events with their document's name; the limit comes first, as an event has one document."""
    last = audit.dropDuplicates(["id"]).orderBy(F.desc("id")).limit(limit)
    return last.join(docs.select(F.col("id").alias("document_id"), "original_filename"), "document_id", "left")


def latest_action(audit: DataFrame) -> DataFrame:
    """Of each document the event of the greatest id: one pre-aggregated pass, no window."""
    top = audit.groupBy("document_id").agg(F.max_by(F.struct("action", "new_status", "logged_at"), "id").alias("x"), F.count_distinct("id").alias("events"))
    return top.select("document_id", "x.action", "x.new_status", "x.logged_at", "events")


def audit_trail(docs: DataFrame, audit: DataFrame, key: int) -> DataFrame:
    """One document with its events in order, as the detail view shows it."""
    events = audit.filter(F.col("document_id") == key).groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct(audit["id"], "action", "new_status"))).alias("events"))
    return by_id(docs, key).join(events, "id", "left")


IDS_TOGETHER = 4096


def status_sequence(audit: DataFrame) -> DataFrame:
    """(document_id, id, new_status, earlier): each event with the status before it in the order of ids.

    Ids are cut into ranges. Inside a range a window gives the earlier event, between ranges the last
    event of the one before; so a document of any number of events is spread over many tasks.
    """
    events = audit.select("id", "document_id", "new_status").dropDuplicates(["id"]).withColumn("_part", F.expr(f"id DIV {IDS_TOGETHER}"))
    inner = Window.partitionBy("document_id", "_part").orderBy("id")
    within = events.withColumn("_n", F.row_number().over(inner)).withColumn("_lag", F.lag("new_status").over(inner))
    last = events.groupBy("document_id", "_part").agg(F.max_by("new_status", "id").alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("document_id").orderBy("_part"))).drop("_last")
    j = within.join(before, ["document_id", "_part"])
    return j.select("document_id", "id", "new_status", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag")).alias("earlier"))


def repeated_identifiers(docs: DataFrame) -> DataFrame:
    """Documents whose invoice number stood before on another file: (id, invoice_number, first_id, earlier).

    Groups are met by their first document and size only, so a number that fills a third of the table
    gives a row for each document and no pairs.
    """
    known = docs.filter(~F.lower(F.trim(F.coalesce("invoice_number", F.lit("")))).isin(PLACEHOLDERS)).select("id", "invoice_number", "file_hash")
    groups = known.groupBy("invoice_number").agg(
        F.min_by("file_hash", "id").alias("first_hash"), F.min("id").alias("first_id"), F.count("*").alias("documents")
    ).filter("documents > 1")
    return known.join(groups, "invoice_number").filter((F.col("id") > F.col("first_id")) & (F.col("file_hash") != F.col("first_hash"))).select("id", "invoice_number", "first_id", "documents")


#: Documents of a group whose ids are written in one line; larger groups stand in repeated_identifiers, a row for each document.
LISTED = 1000


def repeated_groups(docs: DataFrame, most: int = LISTED) -> DataFrame:
    """(invoice_number, documents, first_id, ids): each number that several documents have; ids joined by ', ', null in groups of more than `most`."""
    known = docs.filter(~F.lower(F.trim(F.coalesce("invoice_number", F.lit("")))).isin(PLACEHOLDERS)).select("id", "invoice_number").distinct()
    groups = known.groupBy("invoice_number").agg(F.count("*").alias("documents"), F.min("id").alias("first_id")).filter("documents > 1")
    few = known.join(groups.filter(F.col("documents") <= most).select("invoice_number"), "invoice_number", "left_semi")
    listed = few.groupBy("invoice_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ", ").alias("ids"))
    return groups.join(listed, "invoice_number", "left")


#: How far subtotal and tax may be from the total.
TOLERANCE = 0.05


def arithmetic(values: Column) -> Column:
    """struct(subtotal, tax, total, expected, discrepancy, mismatch) of a flat map of values; null where one of the numbers is missing."""
    n = {k: parse_numeric(F.try_element_at(values, F.lit(k))) for k in ("subtotal", "tax", "total_amount")}
    expected = n["subtotal"] + n["tax"]
    gap = F.abs(expected - n["total_amount"])
    return F.when(
        gap.isNotNull(),
        F.struct(
            n["subtotal"].alias("subtotal"), n["tax"].alias("tax"), n["total_amount"].alias("total"), expected.alias("expected"),
            F.bround(gap, 2).alias("discrepancy"), (gap > TOLERANCE).alias("mismatch"),
        ),
    )


def flat_values(docs: DataFrame, column: str = "extracted_json") -> Column:
    """The flat values of a document's extraction as a map; null where the column isn't valid JSON or has none."""
    valid = F.try_parse_json(column).isNotNull()
    return F.when(valid, F.from_json(F.get_json_object(column, "$.flat_values"), "map<string,string>"))


def with_values(docs: DataFrame, name: str = "values") -> DataFrame:
    """docs with its flat values in a column of their own, so that the JSON is read once for all that uses them."""
    return docs.withColumn(name, flat_values(docs))


def arithmetic_checks(docs: DataFrame) -> DataFrame:
    """(id, subtotal, tax, total, expected, discrepancy, mismatch) of the invoices that state all three numbers."""
    checked = with_values(docs.filter("document_type = 'Invoice'").select("id", "extracted_json")).select("id", arithmetic(F.col("values")).alias("a"))
    return checked.filter("a IS NOT NULL").select("id", "a.*")


SEVERITIES = ["HIGH", "MEDIUM", "LOW"]


def highest_severity(severities: Column) -> Column:
    """The highest of an array of severities, NONE of an empty or null one."""
    out = F.lit("NONE")
    for s in reversed(SEVERITIES):
        out = F.when(F.array_contains(F.coalesce(severities, F.array().cast("array<string>")), s), F.lit(s)).otherwise(out)
    return out


def duplicates_by_hash(docs: DataFrame) -> DataFrame:
    """(id, first_id): documents whose file was stored before."""
    known = docs.filter(F.coalesce(F.trim("file_hash"), F.lit("")) != "").select("id", "file_hash")
    first = known.groupBy("file_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return known.join(first, "file_hash").filter("id > first_id").select("id", "first_id")


def fresh_and_known(incoming: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incoming files that are new (the first of each hash), and those that are stored already."""
    once = incoming.groupBy("file_hash").agg(F.min_by(F.struct(*incoming.columns), "id").alias("x")).select("x.*")
    return once.join(stored, "file_hash", "left_anti"), incoming.join(stored, "file_hash", "left_semi")


def delete_cascade(docs: DataFrame, children: list[DataFrame], ids: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    gone = ids.select("id").distinct()
    keys = gone.withColumnRenamed("id", "document_id")
    return docs.join(gone, "id", "left_anti"), [c.join(keys, "document_id", "left_anti") for c in children]


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of the documents that new has chunks of are replaced."""
    return chunks.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


def update(docs: DataFrame, changes: DataFrame, columns: list[str], blank_keeps: bool = True) -> DataFrame:
    """Changed columns by id; null (and, where blank_keeps, blank) values keep the old ones."""
    renamed = changes.select("id", *(F.col(c).alias(f"_new_{c}") for c in columns))
    j = docs.join(renamed, "id", "left")
    for c in columns:
        new = F.col(f"_new_{c}")
        text = docs.schema[c].dataType.simpleString() == "string"
        new = F.when(new != "", new) if blank_keeps and text else new
        j = j.withColumn(c, F.coalesce(new, F.col(c)))
    return j.select(*docs.columns)


#: What the final stage writes where an edit names no value.
EDIT_DEFAULTS = {"company": "Not Found", "invoice_number": "Not Found", "total_amount": "Not Found", "extracted_json": "{}"}


def overwrite(docs: DataFrame, changes: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Changed documents get every one of the columns anew: the value of changes, else the default."""
    defaults = defaults or EDIT_DEFAULTS
    given = [F.coalesce(F.col(c), F.lit(d)).alias(f"_new_{c}") if c in changes.columns else F.lit(d).alias(f"_new_{c}") for c, d in defaults.items()]
    j = docs.join(changes.select("id", *given, F.lit(True).alias("_changed")), "id", "left")
    return j.select(*(F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in defaults else F.col(c) for c in docs.columns))


def batch_outcomes(results: DataFrame) -> DataFrame:
    """One row of (submitted, successes, failures, duplicates, total_ms, avg_ms) of (success, is_duplicate, processing_time_ms)."""
    again, good = F.coalesce("is_duplicate", F.lit(False)), F.coalesce("success", F.lit(False))
    total = F.coalesce(F.sum("processing_time_ms"), F.lit(0.0))
    return results.agg(
        F.count("*").alias("submitted"), F.count_if(good & ~again).alias("successes"), F.count_if(~good & ~again).alias("failures"), F.count_if(again).alias("duplicates"),
        F.bround(total, 2).alias("total_ms"), F.bround(total / F.greatest(F.count("*"), F.lit(1)), 2).alias("avg_ms"),
    )


def evaluation_counts(results: DataFrame) -> DataFrame:
    """One row of (selected, processed, completed, review, rejected, failed) of (new_status, success)."""
    good = F.coalesce("success", F.lit(False))
    of = lambda s: F.count_if(good & (F.col("new_status") == s))
    return results.agg(
        F.count("*").alias("selected"), F.count_if(good).alias("processed"), of("Completed").alias("completed"), of("Needs Review").alias("review"),
        of("Rejected").alias("rejected"), F.count_if(~good | (F.col("new_status") == "Failed")).alias("failed"),
    )


def batch_rows(results: DataFrame) -> DataFrame:
    """What a batch's table shows of each file, with a default for what is missing."""
    return results.select(
        F.coalesce("original_filename", F.lit("N/A")).alias("filename"), "status", F.coalesce("document_type", F.lit("Unknown")).alias("type"), F.coalesce("processing_time_ms", F.lit(0.0)).alias("time_ms")
    )


def appended(docs: DataFrame, new: DataFrame) -> DataFrame:
    """New rows get ids after the greatest one, in the order of their hash; numbered over range partitions without a global window."""
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    cols = [c for c in docs.columns if c != "id"]
    # numbered once, so both uses see the same partitions
    part = new.select(*cols).repartitionByRange("file_hash").sortWithinPartitions("file_hash").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    part = stored(part, "appended")
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))  # a row for each partition
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_p", "_first", "_before")
    numbered = part.join(before, "_p").crossJoin(top).withColumn("id", F.col("_top") + F.col("_before") + F.col("_m") - F.col("_first") + 1)
    return docs.unionByName(numbered.select(*docs.columns))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS.get(schema, schema))


#: The declared tables of the register.
SCHEMAS = {
    "documents": """id bigint, original_filename string, stored_filename string, document_type string, upload_date timestamp_ntz, company string, invoice_number string, total_amount string,
        file_path string, text_preview string, file_hash string, status string, file_size bigint, mime_type string, confidence double, extracted_json string, validation_json string,
        anomaly_json string, review_reason string, notes string, processing_time_ms double, stage_timings_json string, updated_at timestamp_ntz""",
    "audit_log": "id bigint, document_id bigint, action string, previous_status string, new_status string, logged_at timestamp_ntz, reason string, performed_by string",
    "rag_chunks": "id bigint, document_id bigint, chunk_index int, page_number int, chunk_text string, token_count int, created_at timestamp_ntz",
}


def has_anomalies(column: str = "anomaly_json") -> Column:
    """Whether a report says that it has anomalies; false where it isn't valid JSON."""
    valid = F.coalesce(F.try_parse_json(column).isNotNull(), F.lit(False))
    return valid & (F.coalesce(F.get_json_object(column, "$.has_anomalies"), F.lit("false")) == "true")


def dashboard(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """metrics with the documents that have anomalies and the number of chunks: one pass over either table, joined as two single rows."""
    timed = docs.withColumn("_anomalous", has_anomalies())
    more = timed.agg(F.count_if("_anomalous").alias("anomalies"), *metric_columns())
    return more.join(chunks.agg(F.count_distinct("id").alias("chunks")))


def metrics(docs: DataFrame) -> DataFrame:
    """All counters of the register in one pass."""
    return docs.agg(*metric_columns())


def metric_columns() -> list[Column]:
    timed = F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))
    return [
        F.count("*").alias("documents"),
        *(F.count_if(F.col("status") == s).alias(s.lower().replace(" ", "_")) for s in STATUSES),
        F.coalesce(F.bround(F.avg(timed), 2), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.min(timed), F.lit(0.0)).alias("min_ms"),
        F.coalesce(F.max(timed), F.lit(0.0)).alias("max_ms"),
        F.count_if((F.col("confidence") < 0.75) & F.col("confidence").isNotNull()).alias("low_confidence"),
        F.bround(F.avg("confidence"), 6).alias("avg_confidence"),
    ]


def counts_by(docs: DataFrame, column: str) -> DataFrame:
    return docs.groupBy(column).agg(F.count("*").alias("n"))


def category_stats(docs: DataFrame) -> DataFrame:
    """Counts and bytes of each known category, zero where there is none."""
    kinds = docs.sparkSession.createDataFrame([(k,) for k in CATEGORIES], "document_type string")
    counted = docs.groupBy("document_type").agg(F.count("*").alias("n"), F.sum("file_size").alias("bytes"))
    return kinds.join(counted, "document_type", "left").select("document_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def display(docs: DataFrame) -> DataFrame:
    """What a list of documents shows of each."""
    resume, contract = F.col("document_type") == "Resume", F.col("document_type") == "Contract"
    return docs.select(
        "id",
        F.coalesce("company", F.lit("Not Found")).alias("title"),
        F.when(resume, excerpt_short(F.col("total_amount"))).when(contract, F.col("invoice_number")).otherwise(F.col("total_amount")).alias("detail"),
        F.coalesce(percent(F.col("confidence")), F.lit("N/A")).alias("confidence_text"),
        F.substring(F.date_format("upload_date", "yyyy-MM-dd HH:mm:ss"), 1, 16).alias("uploaded"),
        excerpt(F.col("review_reason"), 40).alias("reason"),
    )


def register_columns(kind: Column, values: Column) -> Column:
    """struct(company, invoice_number, total_amount): what the register keeps of a document's values, by its type."""

    def value(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(default))

    skills = value("skills", "Not Found")
    by_type = {
        "Invoice": (value("company", "Not Found"), value("invoice_number", "Not Found"), value("total_amount", "Not Found")),
        "Resume": (value("name", "Not Found"), value("email", "Not Found"), excerpt_short(skills)),
        "Contract": (value("contract_title", "Agreement"), value("governing_law", "General"), value("effective_date", "Not Found")),
    }
    other = (value("document_title", "General Document"), value("subject", "N/A"), value("date", "N/A"))

    def column(i: int) -> Column:
        out = other[i]
        for k, v in by_type.items():
            out = F.when(kind == k, v[i]).otherwise(out)
        return out

    return F.struct(column(0).alias("company"), column(1).alias("invoice_number"), column(2).alias("total_amount"))


def display_with_latest(found: DataFrame) -> DataFrame:
    """What the fifth stage's list shows of the result of search_with_latest."""
    minute = lambda c: F.substring(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), 1, 16)
    return found.select(
        "id", "original_filename", "document_type", "status", F.coalesce(percent(F.col("confidence")), F.lit("N/A")).alias("confidence_text"), "company", "invoice_number", "total_amount",
        minute("upload_date").alias("uploaded"), F.coalesce("latest_action", F.lit("N/A")).alias("latest_action"), F.coalesce(minute("latest_action_time"), F.lit("N/A")).alias("action_time"),
    )


# The colour of each action.
ACTION_COLOURS = {
    "UPLOAD": "#3b82f6", "PROCESS_START": "#6366f1", "OCR_PERFORMED": "#0ea5e9", "CLASSIFIED": "#8b5cf6", "EXTRACTED": "#a855f7", "VALIDATION_FAILED": "#f59e0b",
    "ANOMALY_DETECTED": "#ef4444", "AUTO_DECISION": "#8b5cf6", "ROUTE_TO_REVIEW": "#f59e0b", "APPROVE": "#10b981", "REJECT": "#ef4444", "FIELD_EDIT": "#06b6d4",
    "RAG_INDEXED": "#14b8a6", "COMPLETE": "#059669", "BATCH_PROCESS": "#ec4899",
}
NO_COLOUR = "#6b7280"


def looked_up(c: Column, table: dict, default: str | None = None) -> Column:
    """What a table of fixed values has for a key, else the default."""
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)
    return found if default is None else F.coalesce(found, F.lit(default))


def action_colour(action: Column) -> Column:
    return looked_up(action, ACTION_COLOURS, NO_COLOUR)


def named(df: DataFrame, code: str, names: DataFrame, as_name: str = "name") -> DataFrame:
    """df with the name of each code out of (code, name); null for an unknown one."""
    return df.join(names.select(F.col("code").alias(code), F.col("name").alias(as_name)), code, "left")


def excerpt_short(c: Column) -> Column:
    return F.when(F.length(c) > 28, F.concat(F.substring(c, 1, 28), F.lit("..."))).otherwise(c)


def audit_display(audit: DataFrame) -> DataFrame:
    return audit.dropDuplicates(["id"]).select(
        "id",
        F.concat_ws(" -> ", F.coalesce("previous_status", F.lit("")), F.coalesce("new_status", F.lit(""))).alias("change"),
        F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


def transitions(audit: DataFrame) -> DataFrame:
    """How often each status followed another, from stored pairs."""
    return audit.dropDuplicates(["id"]).groupBy("previous_status", "new_status").agg(F.count("*").alias("n"))


def long_form(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """A row for each measure of each key."""
    return df.unpivot(key, measures, "measure", "value")

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import files as ff
from folioforge.functions import textops as tx
from folioforge.operators import chunking, classification, extraction, learning, repository, retrieval, validation
from folioforge.session import stored
from folioforge.sources import files as src
from folioforge.streaming import audit


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


INVOICE = "Apex Digital Solutions LLC\nInvoice Number: INV-2026-0814\nDate: 12-Jan-2026\nSubtotal: $7,750.00\nTax (8.25%): $639.38\nTotal: $8,389.38\nAmount Due: $8,389.38"


@pytest.mark.parametrize(
    "field, want",
    [("invoice_number", "INV-2026-0814"), ("date", "12-Jan-2026"), ("subtotal", "$ 7,750.00"), ("tax", "$ 639.38"), ("total_amount", "$ 8,389.38")],
)
def test_invoice_fields(spark, field, want):
    assert one(spark, INVOICE, dict((n, f) for n, f, _, _ in extraction.PROFILES["Invoice"])[field]) == want


def test_invoice_struct_is_complete(spark):
    r = one(spark, INVOICE, lambda t: extraction.fields(t, "Invoice"))
    assert r.missing_fields == [] and r.completeness == 100.0 and r.total_amount.status == "FOUND"
    assert one(spark, None, lambda t: extraction.fields(t, "Invoice")).completeness == 0.0


def test_resume_fields(spark):
    text = "Tariq Mehmood\nPython, C++ and SQL\nPhone: 0399-6608914"
    r = one(spark, text, lambda t: extraction.fields(t, "Resume"))
    assert (r.name.value, r.email.value, r.phone.value, r.skills.value) == ("Tariq Mehmood", None, "0399-6608914", "Python, SQL")


def test_amount_above_its_label(spark):
    assert one(spark, "Item\n12.00\n15.50\nTotal\nThanks", extraction.amount_in_lines_above) == "15.50"


def test_clean_text(spark):
    raw = "  Invoice   Number:  INV-9921  \r\n\r\n\r\n\r\nTotal:   $500.00  ​• Item 1"
    got = one(spark, raw, tx.clean_lines)
    assert "Invoice Number: INV-9921" in got and "- Item 1" in got and "\n\n\n" not in got and "\r" not in got and "​" not in got


@pytest.mark.parametrize("text, status", [("", "EMPTY"), (None, "EMPTY"), ("Hi there!", "VERY_SHORT"), ("A sentence that is long enough to count.", "VALID")])
def test_quality(spark, text, status):
    assert one(spark, text, tx.quality).status == status


@pytest.mark.parametrize(
    "text, kind",
    [("TAX INVOICE Invoice Number INV-1002 subtotal", "Invoice"), ("Curriculum Vitae Software Engineer Skills Education", "Resume"), ("Mutual Non-Disclosure Agreement between parties", "Other"), ("nothing of the sort here", "Other"), (None, "Other")],
)
def test_classification(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    for profile in ("presence", "occurrence", "fallback"):
        assert classification.classify(df, "t", profile).first().predicted_type == kind


@pytest.mark.parametrize("v, error", [("a@b.example", None), ("a@b.c", "domain"), ("a b@c.de", "format"), ("N/A", "missing"), (None, "missing")])
def test_email_check(spark, v, error):
    assert one(spark, v, validation.email_error) == error


@pytest.mark.parametrize("v, error", [("2026-01-12", None), ("12-Jan-2026", None), ("July 4, 2026", None), ("31/02/2026", None), ("1/1/1800", "range"), ("soon", "format"), ("", "missing")])
def test_date_check(spark, v, error):
    assert one(spark, v, validation.date_error) == error


def packed_by_hand(text, size, overlap):
    out, cur = [], ""
    for p in filter(None, (x.strip(" \t\n\r\f") for x in text.split("\n\n"))):
        if len(cur) + len(p) + 1 <= size:
            cur = f"{cur}\n{p}".strip(" \t\n\r\f")
        else:
            if cur:
                out.append(cur)
            cur = cur[-overlap:] + " " + p if len(cur) > overlap else p
    return out + [cur] if cur else out


def test_packed_paragraphs_match_a_plain_loop(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunking.packed_chunks(docs, "text", "doc_id").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert got == {r.doc_id: w for r in docs.collect() if (w := packed_by_hand(r.text or "", 350, 60))}


def test_answers_are_grounded_or_refused(spark):
    chunks = spark.createDataFrame([(1, "The invoice number is INV-7. It was sent in May.", 10), (2, "Pumps are stored in Karvand.", 11)], "id long, chunk_text string, document_id long")
    questions = spark.createDataFrame([(1, "What is the invoice number?"), (2, "quantum warranty servers"), (3, None)], "q long, text string")
    hits = retrieval.retrieve(questions, chunks, "q", "text", "id", "chunk_text")
    got = {r.q: r for r in retrieval.answers(retrieval.best_sentences(hits, questions, chunks, "q", "text", "id", "chunk_text"), chunks, "q", "id").collect()}
    assert set(got) == {1} and got[1].is_grounded and got[1].answer == "The invoice number is INV-7."


def test_appended_rows_get_the_next_ids(spark):
    old = spark.createDataFrame([(5, "a")], "id long, file_hash string")
    new = spark.createDataFrame([(None, x) for x in "dcb"], "id long, file_hash string")
    assert sorted((r.id, r.file_hash) for r in repository.appended(old, new).collect()) == [(5, "a"), (6, "b"), (7, "c"), (8, "d")]


def test_replaced_chunks_and_empty_tables(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, chunk_text string")
    assert sorted(map(tuple, repository.replace_chunks(c, spark.createDataFrame([(2, "x")], c.schema)).collect())) == [(1, "a"), (2, "x")]
    assert repository.latest_action(repository.empty(spark, "id long, document_id long, action string, new_status string, logged_at timestamp")).count() == 0


def test_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(60)], "id long, label string")
    counts = classification.folds(df, "label", "id").groupBy("label", "fold").count().collect()
    assert all(c["count"] in (5, 10) for c in counts) and len(counts) == 8


@pytest.mark.parametrize(
    "name, content, error",
    [("a.pdf", b"%PDF-1.4", None), ("a.PNG", b"\x89PNG\r\n\x1a\n", None), ("a.pdf", b"", "EMPTY"), ("a.exe", b"MZ", "UNSUPPORTED"), ("a.pdf", b"hello", "BAD_CONTENT")],
)
def test_uploads(spark, name, content, error):
    df = spark.createDataFrame([(name, bytearray(content))], "n string, c binary")
    assert df.select(ff.upload_error(F.col("n"), F.col("c")).alias("x")).first().x == error


def test_otsu_parts_two_peaks():
    h = np.zeros(256)
    h[40:60], h[180:220] = 5, 7
    assert 59 <= ff.otsu(h) < 180
    assert set(np.unique(ff.binarised(np.array([[10, 10, 200, 200]] * 4)))) == {0, 255}


def test_files_are_read_and_failing_readers_do_not_fail_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF BT (Hello \xe9) Tj ET")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")

    def ocr(content, name):
        if name.endswith("png"):
            raise ValueError
        return "a much longer text from recognition"

    got = {r.name: r for r in src.read_text(src.read_files(spark, str(tmp_path)), ocr=ocr).collect()}
    assert got["a.pdf"].method == "ocr" and got["b.png"].clean_text == "" and got["a.pdf"].file_hash


def test_sinks(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/doc_records.parquet").select("id", "document_type")
    src.write_by_category(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count() and (tmp_path / "out" / "category_dir=invoices").exists()


def test_stream_counts_by_hour(spark, sf):
    n = audit.run_once(audit.hourly_actions(audit.read_events(spark, sf, "audit_log.parquet"), "3650 days"), "hours")
    assert n.count() > 0


def test_stream_reads_tables_in_parts_files_and_nothing(spark, tmp_path, sf):
    log = spark.read.parquet(f"{sf}/audit_log.parquet")
    want = {tuple(r) for r in log.groupBy("document_id").agg(F.max_by("new_status", "id"), F.max("id")).collect()}
    log.repartition(5).write.parquet(str(tmp_path / "parts/audit_log.parquet"))  # a folder of parts
    log.coalesce(1).write.parquet(str(tmp_path / "mixed/audit_log.parquet/deep"))
    (part,) = (tmp_path / "mixed/audit_log.parquet/deep").glob("part-*.parquet")
    part.rename(part.with_name("audit_log.parquet"))  # found by its folder and by its name
    for folder in ("parts", "mixed"):
        events = audit.read_events(spark, str(tmp_path / folder), "audit_log.parquet", 2)
        assert {tuple(r) for r in audit.run_once(audit.latest_state(events), folder).collect()} == want
        assert audit.run_once(events, folder, "append").count() == log.count()
    (tmp_path / "empty").mkdir()
    none = audit.read_events(spark, str(tmp_path / "empty"), "audit_log.parquet")
    assert audit.run_once(audit.latest_state(none), "none").collect() == [] and audit.run_once(none, "none", "append").collect() == []


def test_forest_and_classifier(spark, tmp_path, sf):
    df = spark.createDataFrame([(float(i), float(i % 7), float(i > 20)) for i in range(40)], "a double, b double, label double")
    _, weights = learning.forest(df, ["a", "b"], "label", 5)
    assert weights[0][0] == "a"
    corpus = spark.createDataFrame([("Invoice", "invoice total due"), ("Resume", "skills education")] * 6, "category string, text string")
    model = learning.train(corpus, "text", "category", "naive_bayes")
    src.write_model(model, str(tmp_path / "m"))
    r = learning.probabilities(src.read_model(str(tmp_path / "m")), corpus.withColumn("id", F.lit(1)), "id").first()
    assert abs(sum(r.probabilities) - 1) < 0.01


def test_calibrated_machines_are_saved_and_give_probabilities(spark, tmp_path):
    words = {"Invoice": "invoice total due", "Resume": "skills education", "Other": "memo agenda"}
    corpus = spark.createDataFrame([(k, f"{v} {i}") for k, v in words.items() for i in range(9)], "category string, text string").withColumn("id", F.monotonically_increasing_id())
    model = learning.train(corpus, "text", "category", "linear_svm")
    src.write_model(model, str(tmp_path / "m"))
    a, b = (learning.probabilities(m, corpus, "id").orderBy("id").collect() for m in (model, src.read_model(str(tmp_path / "m"))))
    assert a == b and all(abs(sum(r.probabilities) - 1) < 0.001 and 0.5 < r.confidence < 1 for r in a)
    right = {r.id: ["Invoice", "Other", "Resume"].index(r.category) for r in corpus.collect()}
    assert {r.id: r.predicted for r in a} == right


def test_sigmoids_are_the_least_loss(spark):
    rows = [(0, m, m > 0.3) for m in (-2.0, -1.0, -0.5, 0.2, 0.4, 1.0, 2.0)] + [(1, m, p) for m, p in ((-1.0, False), (1.0, False), (0.5, True), (2.0, True))]
    got = learning.sigmoids(spark.createDataFrame([(g, 0, m, p) for g, m, p in rows], "part int, class int, margin double, positive boolean"))

    def loss(g, a, b):
        xs = [(m, p) for h, m, p in rows if h == g]
        n = sum(p for _, p in xs)
        hi, lo = (n + 1) / (n + 2), 1 / (len(xs) - n + 2)
        return sum(math.log1p(math.exp(-(a * m + b))) + (1 - (hi if p else lo)) * (a * m + b) for m, p in xs)

    for (g, _), (a, b) in got.items():
        assert all(loss(g, a, b) <= loss(g, a + x, b + y) for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))


def test_every_labelled_row_is_held_out_once(spark):
    words = {"Invoice": "invoice total due", "Resume": "skills education", "Other": "memo agenda"}
    corpus = spark.createDataFrame([(f"{k}{i}", k, f"{v} {i}") for k, v in words.items() for i in range(12)], "id string, category string, text string")
    got = learning.cross_validated(classification.folds(corpus, "category", "id", 2), "text", "category").collect()
    for name in learning.models():
        assert sum(r.n for r in got if r.model == name) == 36
        assert {(r.label, r.predicted, r.n) for r in got if r.model == name} == {(i, i, 12) for i in range(3)}


def test_rules_of_the_first_stage(spark):
    cases = [("", "Other", 0.4), (None, "Other", 0.4), ("GPA", "Other", 0.4), ("INV-7", "Invoice", 0.85), ("qty qty cv", "Invoice", 0.73), ("tax cv", "Other", 0.5), ("Skills", "Resume", 0.87)]
    df = spark.createDataFrame([(i, t, "Resume" if i else None) for i, (t, _, _) in enumerate(cases)], "id int, text string, m string")
    got = {r.id: (r.predicted_type, r.confidence_predicted) for r in classification.classify_rules(df, "text").collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    got = [r.predicted_type for r in classification.classify_rules(df, "text", F.col("m")).orderBy("id").collect()]
    assert got == ["Other", "Resume", "Resume", "Invoice", "Invoice", "Resume", "Resume"]


def test_retrieval_by_phrases_equals_brute_force(spark, tmp_path):
    import re
    from collections import Counter

    from folioforge.plans.core_queries import tfidf_retrieve_phrases

    chunks = ["the red pump failed", "the pump, red and old", "red pump red pump invoice", "a blue valve", "old blue valve and red pump failed", ""]
    items = ["red pump failed", "which old blue valve?", "nothing"]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(chunks)], "id long, chunk_text string, document_id long").write.parquet(str(tmp_path / "rag_chunks.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    stops = set(retrieval.stop_words(spark.range(1)))

    def terms(t):
        w = [x for x in re.findall("[a-z0-9_]{2,}", t.lower()) if x not in stops]
        return Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))

    df = Counter(x for c in chunks for x in terms(c))

    def weights(t):
        v = {x: (1 + math.log(n)) * (math.log((1 + len(chunks)) / (1 + df[x])) + 1) for x, n in terms(t).items() if x in df}
        return {x: y / math.sqrt(sum(z * z for z in v.values())) for x, y in v.items()}

    want = {}
    for q, t in enumerate(items):
        a = weights(t)
        scores = sorted(((-round(sum(y * weights(c).get(x, 0) for x, y in a.items()), 4), i) for i, c in enumerate(chunks)))
        want |= {(q, i): -s for s, i in scores[:4] if s < -0.001}
    got = {(r.item_id, r.id): r.score for r in tfidf_retrieve_phrases(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.001 for k in want)


def test_ngrams(spark):
    got = one(spark, "The red pump, the blue pump", lambda t: retrieval.ngrams(t, ["the"], 3))
    assert got == ["red", "pump", "blue", "pump", "red pump", "pump blue", "blue pump", "red pump blue", "pump blue pump"]
    assert one(spark, None, lambda t: retrieval.ngrams(t, [], 3)) == []


# ---- further operators


@pytest.mark.parametrize(
    "text, confidence", [("Vendor: Acme Tools", 0.93), ("the bill of Acme Tools Ltd today", 0.88), ("Green Garden\nsome", 0.75), ("invoice", 0.0), (None, 0.0)]
)
def test_company_confidence(spark, text, confidence):
    assert one(spark, text, extraction.company_confidence) == confidence


def test_contracts_have_a_default_law_and_a_fixed_completeness(spark):
    df = spark.createDataFrame([("Some text", "Contract"), ("Some text", "Invoice")], "t string, k string")
    got = [r.v for r in df.select(extraction.extract(F.col("t"), F.col("k")).alias("v")).collect()]
    assert got[0]["governing_law"] == "Not Specified" and got[0]["contract_title"] == "Service Agreement" and got[1]["company"] == "Some text"
    r = one(spark, "Some text", lambda t: extraction.fields(t, "Contract"))
    assert r.completeness == 90.0 and r.missing_fields == ["effective_date", "governing_law"]
    assert one(spark, "Some text", lambda t: extraction.fields(t, "Resume", extraction.EARLIER)).missing_fields == ["email", "phone", "skills"]


@pytest.mark.parametrize("text, want", [("Total: 50.00\nall in EUR", "EUR 50.00"), ("Total: $ 5.00", "$ 5.00"), ("Total: 7", "7")])
def test_earlier_totals_take_the_documents_currency(spark, text, want):
    assert one(spark, text, extraction.total_with_currency) == want


def test_edited_values_win_over_old_ones(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), (None, {"x": "y"}), ({"a": "1"}, None)], "v map<string,string>, c map<string,string>")
    assert [r.e for r in df.select(extraction.edited(F.col("v"), F.col("c")).alias("e")).collect()] == [{"a": "1", "b": "3", "c": "4"}, {"x": "y"}, {"a": "1"}]


def test_reports_by_type(spark):
    rows = [
        ("Resume", {"name": "Ann Lee", "email": "a@b.example", "skills": "SQL"}), ("Resume", {"name": "Ann Lee", "email": "a@b.example", "skills": "SQL", "phone": "12"}),
        ("Contract", {"contract_title": "X", "effective_date": "soon"}), ("Memo", {}), ("Invoice", {"invoice_number": "A-1", "date": "2025-01-02", "company": "Acme", "total_amount": "USD 1,200.50"}), ("Invoice", None),
    ]
    df = spark.createDataFrame(rows, "k string, v map<string,string>")
    got = [r.r for r in df.select(validation.validate(F.col("k"), F.col("v")).alias("r")).collect()]
    assert [(r.is_valid, r.total_fields_checked, r.passed_count) for r in got] == [(True, 3, 3), (False, 4, 3), (True, 2, 2), (True, 1, 1), (True, 4, 4), (False, 4, 0)]
    assert got[4].parsed_amount == 1200.5 and got[3].passed_fields == ["document_title"] and got[1].field_errors == {"phone": "short"}
    told = [r.r for r in validation.detailed(df, "k", "v", "r").collect()]
    assert told[0].summary == "All 3 required fields successfully validated." and told[3].summary == "Validation failed for 1 field(s): document_title."
    assert [(x.field, x.valid) for x in told[1].field_results] == [("name", True), ("email", True), ("skills", True), ("phone", False)]


@pytest.mark.parametrize("name, content, error", [("", b"x", "NO_NAME"), ("a.tiff", b"x", "UNSUPPORTED"), ("a.pdf", b"", "EMPTY"), ("a.pdf", b"anything", None)])
def test_uploads_of_the_earlier_stages(spark, name, content, error):
    df = spark.createDataFrame([(name, bytearray(content))], "n string, c binary")
    assert df.select(ff.upload_error_by_name(F.col("n"), F.col("c")).alias("x")).first().x == error


def test_mime_types(spark):
    assert [one(spark, x, ff.mime_type) for x in ("a.PDF", "b.jpg", "c")] == ["application/pdf", "image/png", "image/png"]


def test_images_are_prepared_as_columns(spark):
    grey = np.array([[10, 12, 200, 210]] * 6, np.uint8)
    pgm = b"P5\n# made\n4 6\n255\n" + grey.tobytes()
    df = spark.createDataFrame([(1, bytearray(pgm)), (2, bytearray(b"%PDF")), (3, None)], "id int, content binary")
    got = {r.id: r.prepared_image for r in ff.prepared_images(df, contrast=1.8, scale=1.5).collect()}
    assert got[2] is None and got[3] is None and bytes(got[1]).startswith(b"P5 6 9 255\n") and set(bytes(got[1])[11:]) == {0, 255}
    assert (ff.scaled(grey, 1.0) == grey).all() and ff.scaled(grey, 2).shape == (12, 8)


def test_documents_have_pages_and_facts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Type /Page /Type /Pages /Type /Page BT (Hello there, this is long enough to count here) Tj ET")
    r = src.read_document(src.read_files(spark, str(tmp_path)), "fifth").first()
    assert (r.meta.page_count, r.meta.method, r.meta.dpi, r.meta.is_readable) == (2, "native", 150, True) and len(r.meta.pages) == 1
    src.write_model_metadata(spark, str(tmp_path / "meta"), {"name": "svm", "f1": 0.5})
    assert spark.read.json(str(tmp_path / "meta")).first().asDict() == {"name": "svm", "f1": 0.5}
    assert src.delete_file(str(tmp_path / "a.pdf")) and not src.delete_file(str(tmp_path / "a.pdf"))


def test_pages_are_packed_with_one_counter(spark):
    pages = ["one\n\n" + "x" * 348 + "\n\ny", None, "", "z"]
    got = chunking.packed_pages(spark.createDataFrame([(1, pages), (2, [])], "id int, pages array<string>"), "pages", "id").collect()
    want = [(i, p + 1, c) for i, (p, c) in enumerate((p, c) for p, t in enumerate(pages) for c in packed_by_hand(t or "", 350, 60))]
    assert [(r.chunk_index, r.page_number, r.chunk_text) for r in got] == want and len(want) > 2


def odd_texts(spark):
    """Chunks and questions with repeated words, ties, blank and null texts, rows of one key, keys and scopes that are null."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the", "Über", "x_1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    chunks = [(f"c{i:03}", i % 40, text(rng.randint(0, 30))) for i in range(300)] + [("c999", 1, "w1 w2 w3"), ("c998", 1, "w1 w2 w3"), ("c000", 0, "w1 w1"), (None, 1, "w1 w2 w3"), ("d0", 2, None), ("d1", None, "w1 w9"), ("d2", 3, " ! ")]
    asked = [(q, q, text(8)) for q in range(30)] + [(100, None, "w1 w2 w3"), (101, 1, "w1 w2 w3 w3"), (102, None, None), (103, 7, "unknown"), (104, 77, "w1"), (100, None, "w9"), (None, None, "w1")]
    return spark.createDataFrame(chunks, "id string, document_id int, t string"), spark.createDataFrame(asked, "q int, document_id int, text string")


def test_retrieval_keeps_no_table_of_all_terms_of_all_chunks(spark, monkeypatch):
    chunks, asked = odd_texts(spark)
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, name: kept.append((name, stored(df, name))) or kept[-1][1])

    def found(longest, **options):
        r = retrieval.retrieve(asked, chunks, "q", "text", "id", "t", longest=longest, **options)
        assert dict(r.dtypes) == {"q": "int", "id": "string", "score": "double", "place": "int"}
        return sorted(tuple(x) for x in r.collect())

    for longest in (1, 3):
        for options in ({}, {"scope": "document_id"}, {"k": 1}):
            kept.clear()
            monkeypatch.setattr(retrieval, "TERMS_TO_HOLD", 10**6, raising=False)
            whole = found(longest, **options)
            pairs = retrieval.term_counts(chunks, "id", "t", retrieval.stop_words(chunks), longest).count()
            assert len(whole) > 30 and all(df.count() < pairs for _, df in kept)
            monkeypatch.setattr(retrieval, "TERMS_TO_HOLD", 1, raising=False)
            assert found(longest, **options) == whole  # by joins
    monkeypatch.setattr(retrieval, "TERMS_TO_HOLD", 10**6, raising=False)
    assert retrieval.retrieve(asked.limit(0), chunks, "q", "text", "id", "t").count() == 0
    assert retrieval.retrieve(asked, chunks.limit(0), "q", "text", "id", "t").count() == 0


def rows_of_joins(df):
    """The most rows that a join of an executed plan gave."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        if "Join" in p.nodeName():
            most = max(most, p.metrics().get("numOutputRows").get().value())
        inner = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan() if "QueryStage" in p.nodeName() else None
        plans += [inner] if inner is not None else [p.children().apply(i) for i in range(p.children().size())]
    return most


@pytest.mark.parametrize("features", [None, 1000])
def test_questions_of_a_document_meet_its_chunks_only(spark, features):
    chunks = spark.createDataFrame([(i, i // 2, f"total due item{i}") for i in range(400)], "id int, document_id int, t string")
    asked = spark.createDataFrame([(d, d, "total due") for d in range(200)], "q int, document_id int, text string")
    r = retrieval.retrieve(asked, chunks, "q", "text", "id", "t", longest=1, features=features, scope="document_id")
    assert rows_of_joins(r) <= 3 * 400  # all with all are 160,000
    assert sorted((x.q, x.id) for x in r.collect()) == [(i // 2, i) for i in range(400)]


def test_scope_and_vocabulary_of_retrieval(spark):
    chunks = spark.createDataFrame([(1, "red pump failed", 10), (2, "red pump red pump", 11), (3, "blue valve", 10)], "id long, chunk_text string, document_id long")
    asked = spark.createDataFrame([(1, "red pump", None), (2, "red pump", 10), (3, "red pump", 12)], "q long, text string, document_id long")
    every = {(r.q, r.id): r.score for r in retrieval.retrieve(asked, chunks, "q", "text", "id", "chunk_text", scope="document_id").collect()}
    assert set(every) == {(1, 1), (1, 2), (2, 1)} and every[1, 1] == every[2, 1]  # frequencies come from all chunks
    few = retrieval.retrieve(asked, chunks, "q", "text", "id", "chunk_text", longest=1, features=1).filter("q = 1").collect()
    assert {(r.id, r.score) for r in few} == {(1, 1.0), (2, 1.0)}  # pump comes first among equals


def test_every_question_gets_an_answer(spark):
    from folioforge import api

    chunks = spark.createDataFrame([(1, "The invoice number is INV-7. It was sent in May.", 10)], "id long, chunk_text string, document_id long")
    questions = spark.createDataFrame([(1, "What is the invoice number?"), (2, "quantum servers"), (3, None), (4, " \n ")], "q long, text string")
    got = {r.q: (r.success, r.reason, r.is_grounded, r.answer) for r in api.assistant(questions, chunks, "q", "text").collect()}
    assert got == {
        1: (True, None, True, "The invoice number is INV-7."), 2: (True, "INSUFFICIENT_CONTEXT", False, retrieval.NO_ANSWER),
        3: (False, "EMPTY_QUERY", False, retrieval.NO_QUESTION), 4: (False, "EMPTY_QUERY", False, retrieval.NO_QUESTION),
    }


def test_uploads_batches_and_edits(spark, sf):
    from folioforge import api

    text = b"%PDF BT (Acme Tools Ltd TAX INVOICE Invoice Number: INV-2026-0814 Date: 2026-01-12 Total: $ 8,389.38 subtotal) Tj ET"
    other = b"%PDF BT (Curriculum Vitae of a person with skills and education) Tj ET"
    files = spark.createDataFrame([("a.pdf", bytearray(text)), ("b.pdf", bytearray(text)), ("c.pdf", bytearray(other)), ("d.pdf", bytearray(b"MZ")), ("e.pdf", None)], "name string, content binary")
    import hashlib

    docs = spark.createDataFrame([(7, hashlib.sha256(other).hexdigest(), "Invoice", '{"flat_values": {"company": "Old", "invoice_number": "N-12"}}')], "id long, file_hash string, document_type string, extracted_json string")
    out, counts = api.batch_upload(files, docs)
    got = {r.original_filename: r for r in out.collect()}
    assert {n: (r.success, r.is_duplicate, r.error, r.document_id) for n, r in got.items()} == {
        "a.pdf": (True, False, None, None), "b.pdf": (True, True, None, None), "c.pdf": (True, True, None, 7), "d.pdf": (False, False, "BAD_CONTENT", None), "e.pdf": (False, False, "EMPTY", None),
    }
    assert got["a.pdf"].document_type == "Invoice" and got["a.pdf"].invoice_number == "INV-2026-0814" and got["a.pdf"].chunks == 1
    c = counts.first()
    assert (c.submitted, c.successes, c.failures, c.duplicates) == (5, 1, 2, 2)
    changed = api.edit(docs, spark.createDataFrame([(7, {"company": "New"})], "id long, changes map<string,string>")).first()
    assert (changed.company, changed.invoice_number, changed.total_amount, changed.validation.passed_fields) == ("New", "N-12", "Not Found", ["invoice_number", "company"])
    assert {r.part: r.ready for r in api.health(spark, {"docs": f"{sf}/doc_records.parquet", "no": f"{sf}/none"}).collect()} == {"docs": True, "no": False}
    with pytest.raises(ValueError):
        api.recent_audit(docs, docs, 500)


def test_declared_tables_and_report_of_empty_ones(spark):
    docs, chunks = repository.empty(spark, "documents"), repository.empty(spark, "rag_chunks")
    r = repository.dashboard(docs, chunks).first()
    assert (r.documents, r.anomalies, r.chunks, r.avg_ms) == (0, 0, 0, 0.0)
    assert repository.search_with_latest(docs, repository.empty(spark, "audit_log"), query="x").count() == 0
    assert repository.batch_outcomes(spark.createDataFrame([], "success boolean, is_duplicate boolean, processing_time_ms double")).first().avg_ms == 0.0


def test_flowers_are_told_apart(spark):
    df = spark.createDataFrame(learning.flowers(), learning.FLOWERS).withColumn("label", F.col("target").cast("double"))
    m, weights = learning.forest(df, ["sepal_length", "sepal_width", "petal_length", "petal_width"], "label", 10)
    assert {weights[0][0], weights[1][0]} == {"petal_length", "petal_width"}
    assert m.transform(df).filter("label = prediction").count() > 140


def test_batch_rows_have_defaults(spark):
    df = spark.createDataFrame([("a", "Completed", None, None), (None, "Failed", "Invoice", 2.5)], "original_filename string, status string, document_type string, processing_time_ms double")
    assert sorted(map(tuple, repository.batch_rows(df).collect())) == [("N/A", "Failed", "Invoice", 2.5), ("a", "Completed", "Unknown", 0.0)]

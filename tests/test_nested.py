import json

import pytest

from folioforge.operators import nested as n

SCHEMA = "id long, extracted_json string, validation_json string, anomaly_json string, source_column string, _0 string"


def found(spark, **columns):
    df = spark.createDataFrame([(1, columns.get("e"), columns.get("v"), columns.get("a"), "clash", "clash")], SCHEMA)
    return {tuple(r) for r in n.record_elements(df, with_values=False).collect()}


def test_plan_inlines_singletons_and_makes_tables_of_repeated_nodes():
    plan = n.record_plans()["anomaly"][1]
    assert [c.steps for c in plan.children] == [("anomalies",)]
    assert [c.steps for c in plan.children[0].children] == [("matched_ids",), ("details", "evidence")]
    assert plan.children[0].inlined == [("details",)]


def test_shared_and_recursive_nodes_are_tables():
    edges = [n.Edge("part", "sub", "part", n.MANY), n.Edge("part", "maker", "firm"), n.Edge("part", "seller", "firm")]
    plan = n.analyse(edges, "part")
    assert [(c.node, c.recursive_to) for c in plan.children] == [("part", "part"), ("firm", None), ("firm", None)]


def test_recursive_records(spark):
    edges = [n.Edge("part", "sub", "part", n.MANY)]
    df = spark.createDataFrame([(1, json.dumps({"sub": [{"sub": [{}, {"sub": {}}]}]}))], "id long, j string")
    got = {(r.child_path, r.key_path) for r in n.shred(df, {"p": ("j", n.analyse(edges, "part"))}).collect()}
    assert got == {("sub", "0"), ("sub.sub", "0/0"), ("sub.sub", "0/1"), ("sub.sub.sub", "0/1/0")}


def test_elements_and_links(spark):
    e = {"fields": {"total": {"candidates": [1, None, 2]}, "skills": None}, "line_items": [None, {"taxes": {"code": "VAT"}}], "missing_fields": "date"}
    assert found(spark, e=json.dumps(e)) == {
        (1, "extracted", "fields", "", "total"),
        (1, "extracted", "fields.candidates", "total", "0"),
        (1, "extracted", "fields.candidates", "total", "2"),
        (1, "extracted", "line_items", "", "1"),
        (1, "extracted", "line_items.taxes", "1", "0"),
        (1, "extracted", "missing_fields", "", "0"),
    }


def test_anomaly_evidence_below_an_inlined_object(spark):
    a = {"anomalies": [{"code": "X", "details": {"evidence": [{"page": 1}]}, "matched_ids": ["7"]}]}
    assert (1, "anomaly", "anomalies.details.evidence", "0", "0") in found(spark, a=json.dumps(a))


def test_json_in_json_counts_as_that_json(spark):
    v = json.dumps(json.dumps({"passed_fields": json.dumps(["a"])}))
    assert found(spark, v=v) == {(1, "validation", "passed_fields", "", "0")}


@pytest.mark.parametrize("text", ["", "  ", "null", "{}", None, '"null"', "[]", "3"])
def test_columns_without_elements(spark, text):
    assert found(spark, e=text) == set()


@pytest.mark.parametrize("text", ['{"a": NaN}', "{'a': 1}", '{"a": 1', "<null>", '{"a": 1} x', '{"a": "\t"}'])
def test_what_is_not_json_is_unparseable(spark, text):
    assert found(spark, e=text) == {(1, "extracted", "unparseable", "", "")}


def test_long_integers_and_lone_surrogates_are_valid(spark):
    assert found(spark, e='{"fields": {"\\ud800": {"x": ' + "9" * 6000 + "}}}") == {(1, "extracted", "fields", "", "?")}


def test_repeated_rows_empty_tables_and_values(spark):
    e = json.dumps({"line_items": [{"line_no": 1, "description": "x", "quantity": 2, "extra": {"deep": 1}}]})
    df = spark.createDataFrame([(1, e, None, None, "", "")] * 2, SCHEMA)
    t = n.flat_table(n.record_elements(df), "extracted", "line_items", {"line_no": "int", "quantity": "bigint", "description": "string"}).collect()
    assert [(r.line_no, r.quantity, r.description) for r in t] == [(1, 2, "x")] * 2
    assert n.record_elements(df.limit(0)).count() == 0


def test_schema_graph_is_found_in_the_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/doc_records.parquet")
    edges = {tuple(r) for r in n.observed_edges(docs, "extracted_json", "x", ["x.fields", "x.flat_values"]).collect()}
    assert ("x", "fields", "keyed") in edges and ("x.fields.*", "value", "one") in edges


def test_tables_have_every_column_that_occurs_and_roots_have_rows(spark):
    e = json.dumps({"document_type": "Invoice", "extractor": {"name": "x", "version": 2}, "fields": {"total": {"value": "5", "id": "7"}}})
    a = json.dumps({"anomalies": [{"code": "A", "details": {"text_length": 9}}, {"code": "B", "confidence": 0.5}]})
    df = spark.createDataFrame([(1, e, "{}", a, "", ""), (2, "{", None, None, "", "")], SCHEMA)
    elements = n.record_elements(df, with_root=True)
    root = n.observed_table(elements, "extracted", "").collect()
    assert [(r.id, r.document_type, r.extractor_name, r.extractor_version) for r in root] == [(1, "Invoice", "x", "2")]
    assert n.observed_table(elements, "validation", "").count() == 0
    rows = n.observed_table(elements, "anomaly", "anomalies", {"confidence": "double"}).collect()
    assert sorted((r.code, r.confidence, r.details_text_length) for r in rows) == [("A", None, "9"), ("B", 0.5, None)]
    field = n.observed_table(elements, "extracted", "fields").first()
    assert (field.child_key, field.value, field["id"], field["values.id"]) == ("total", "5", 1, "7")
    assert n.record_elements(df).filter("child_path = ''").count() == 0


def test_every_table_of_the_plan_is_registered():
    from folioforge.plans.data_queries import TABLES

    def paths(plan, path=""):
        yield path
        for c in plan.children:
            yield from paths(c, f"{path}.{'.'.join(c.steps)}".strip("."))

    want = {(source, p) for source, (_, plan) in n.record_plans().items() for p in paths(plan)}
    assert {(s, p) for s, p, _ in TABLES.values()} == want


def test_a_new_array_becomes_a_table_without_a_change_of_code(spark, tmp_path):
    e = json.dumps({"approvals": [{"by": "x", "steps": [{"n": 1}, {"n": 2}]}, None], "origin": {"host": {"name": "h"}}, "fields": {"a/b~c": {"history": ["u", "v"]}}})
    v = json.dumps({"parts": [{"name": "p", "parts": [{"name": "q", "parts": {"name": "r"}}]}]})
    df = spark.createDataFrame([(1, e, v, None, "", "")], SCHEMA)
    every = n.record_elements(df, observed=True, with_root=True).collect()
    rows = {(r.child_path, r.parent_path, r.key_path): dict(r["values"]) for r in every if (r.source_column, r.child_path) != ("validation", "")}
    assert rows["approvals.steps", "0", "0/1"] == {"n": "2"} and rows["approvals", "", "0"] == {"by": "x"}
    assert rows["fields.history", "a~1b~0c", "a~1b~0c/1"] == {"value": "v"}
    assert rows["", "", ""]["origin.host.name"] == "h"  # singletons are inlined
    assert [k for k in rows if k[0].startswith("parts")] == [("parts", "", "0"), ("parts.parts", "0", "0/0"), ("parts.parts.parts", "0/0", "0/0/0")]
    assert not any(p.startswith(("approvals", "parts")) for p in {r.child_path for r in n.record_elements(df).collect()})
    listed = {(r.source_column, r.child_path): (r.n, r.columns) for r in n.write_tables(n.record_elements(df, observed=True), str(tmp_path / "t")).collect()}
    assert listed["extracted", "approvals.steps"] == (2, "n")
    # every foreign key has its row
    t = spark.read.parquet(str(tmp_path / "t"))
    keys = {(r.source_column, r.key_path) for r in t.collect()}
    assert all(r.parent_path == "" or (r.source_column, r.parent_path) in keys for r in t.collect())


def test_an_object_with_many_names_is_a_map(spark):
    e = json.dumps({"prices": {f"item {i}": {"low": i, "past": [1, 2]} for i in range(400)}})
    df = spark.createDataFrame([(1, e, None, None, "", "")], SCHEMA)
    rows = n.record_elements(df, observed=True).collect()
    assert sorted((r.child_path, r.parent_key, r.child_key) for r in rows if r.parent_key in ("", "item 7"))[-3:] == [("prices", "", "item 99"), ("prices.past", "item 7", "0"), ("prices.past", "item 7", "1")]
    assert len(rows) == 1200


def test_one_table_alone_equals_its_part_of_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/doc_records.parquet")
    every = n.record_elements(docs, observed=True, with_root=True)
    for source, path in (("extracted", "line_items.taxes"), ("anomaly", "anomalies.details.evidence"), ("validation", "")):
        cols = ["id", "child_key", "parent_path", "key_path", "values"]
        want = every.filter((every.source_column == source) & (every.child_path == path)).select(*cols).collect()
        got = n.table_elements(docs, source, path).select(*cols).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and got


def test_very_deep_records_do_not_crash(spark):
    same = '{"a":' * 3000 + "1" + "}" * 3000
    lists = '{"fields": {"x": {"candidates": ' + "[" * 3000 + "]" * 3000 + "}}}"
    named = "".join(f'{{"n{i}":' for i in range(400)) + "1" + "}" * 400
    beyond = '{"a":' * 50_000 + "1" + "}" * 50_000
    df = spark.createDataFrame([(i, e, None, None, "", "") for i, e in enumerate((same, lists, named, beyond))], SCHEMA)
    rows = n.record_elements(df, observed=True, with_root=True).collect()
    assert {(r.id, r.child_path) for r in rows if r.id != 0} == {(1, ""), (1, "fields"), (1, "fields.candidates"), (2, ""), (3, "unparseable")}
    assert sum(r.id == 0 for r in rows) == 3001  # the root, and a recursive element is a table with a row for each level


def test_odd_records_do_not_change_the_declared_tables(spark):
    good = {"anomalies": [{"code": "A", "details": {"evidence": [{"page": 1}]}}]}
    odd = {"anomalies": [{"code": "B", "details": {"details": {"anomalies": [1]}, "evidence": {"page": 2}}}]}
    df = spark.createDataFrame([(i, None, None, json.dumps(a), "", "") for i, a in enumerate((good, odd))], SCHEMA)
    rows = {(r.id, r.child_path, r.parent_key, r.child_key) for r in n.record_elements(df, observed=True).collect()}
    declared = {(r.id, r.child_path, r.parent_key, r.child_key) for r in n.record_elements(df).collect()}
    assert rows - declared == {(1, "anomalies.details.details.anomalies", "0", "0")} and declared <= rows

"""Nested records to related flat tables by shared inlining.

The schema graph has one node for each kind of element and one edge for each
way an element is nested in another. Following the shared-inlining scheme for
semi-structured data, a node becomes a table of its own when it is the root,
repeated (array or keyed map), shared by several parents, or recursive; every
other node is a singleton descendant and is inlined into the columns of the
nearest table above it. Each row keeps the record id, its own key path, and its
parent's key path as a foreign key.

The graph comes from the data: `schema_graph` walks all records and adds every
nesting that occurs to the declared edges, which say what the data alone can't
(where an array is expected though single elements stand there, which objects
are maps whose names are data, what a shared or recursive element is called). An
element named like one that encloses it is the same element, so undeclared
recursion ends; an object with MAP_FROM names of nested members or more is a map
(of a root or an element of a map with so many, the first 2 x MAP_FROM become
tables, the others stay JSON).

Defined results: a null, blank, ``null`` or ``{}`` column gives no rows; a
column that is not valid JSON (RFC 8259) or nested beyond what the decoder
takes gives one row of the table ``unparseable``; a JSON string that itself holds an object or array counts as
that value; null elements give no row but count as array positions; a single
element where an array is expected is its position 0; repeated input rows give
repeated output rows; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONE, MANY, KEYED = "one", "many", "keyed"
MAP_FROM = 256  # names from which an undeclared object is a map


@dataclass(frozen=True)
class Edge:
    """parent contains child under the key name; how: ONE, MANY (array) or KEYED (object used as a map)."""

    parent: str
    name: str
    child: str
    how: str = ONE


@dataclass
class TablePlan:
    """One table: the node it holds, where it hangs, what is inlined into it."""

    node: str
    steps: tuple[str, ...]
    how: str
    inlined: list[tuple[str, ...]] = field(default_factory=list)
    children: list[TablePlan] = field(default_factory=list)
    recursive_to: str | None = None


def _components(nodes: Iterable[str], out: dict[str, list[Edge]]) -> dict[str, int]:
    """Strongly connected components (Tarjan) of the schema graph, node -> component number."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    comp: dict[str, int] = {}

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        for e in out.get(v, []):
            if e.child not in index:
                visit(e.child)
                low[v] = min(low[v], low[e.child])
            elif e.child in on:
                low[v] = min(low[v], index[e.child])
        if low[v] == index[v]:
            number = len(set(comp.values()))
            while True:
                w = stack.pop()
                on.discard(w)
                comp[w] = number
                if w == v:
                    break

    for v in nodes:
        if v not in index:
            visit(v)
    return comp


def analyse(edges: list[Edge], root: str) -> TablePlan:
    """The inlining plan of a schema graph: which nodes become tables and what each table inlines."""
    _deep()
    out: dict[str, list[Edge]] = {}
    indegree: dict[str, int] = {}
    for e in edges:
        out.setdefault(e.parent, []).append(e)
        indegree[e.child] = indegree.get(e.child, 0) + 1
    comp = _components([root, *out], out)
    size: dict[int, int] = {}
    for n in comp.values():
        size[n] = size.get(n, 0) + 1

    def recursive(e: Edge) -> bool:
        return comp.get(e.child) == comp.get(e.parent) and (size[comp[e.child]] > 1 or e.child == e.parent)

    def build(plan: TablePlan, node: str, prefix: tuple[str, ...], above: tuple[str, ...]) -> None:
        for e in out.get(node, []):
            steps = (*prefix, e.name)
            own = e.how != ONE or indegree[e.child] > 1 or recursive(e)
            if not own:
                plan.inlined.append(steps)
                build(plan, e.child, steps, above)
            elif e.child in above:
                plan.children.append(TablePlan(e.child, steps, e.how, recursive_to=e.child))
            else:
                child = TablePlan(e.child, steps, e.how)
                plan.children.append(child)
                build(child, e.child, (), (*above, e.child))

    top = TablePlan(root, (), ONE)
    build(top, root, (), (root,))
    return top


def observed_edges(df: DataFrame, column: str, root: str, keyed: Iterable[str] = ()) -> DataFrame:
    """The edges that occur in a JSON column, as rows (parent, name, how), found by one distributed pass.

    keyed: paths whose objects are maps, as their names are data. The result has a row for each
    distinct path, whatever the number of records.
    """
    maps = set(keyed)

    def walk(value: object, path: str, seen: set[tuple[str, str, str]]) -> None:
        value = opened(value)
        if isinstance(value, list):
            for x in value:
                walk(x, path, seen)
        elif isinstance(value, dict):
            for name, x in value.items():
                if path in maps:
                    walk(x, f"{path}.*", seen)
                    continue
                x = opened(x)
                at = f"{path}.{name}"
                seen.add((path, name, MANY if isinstance(x, list) else KEYED if at in maps else ONE))
                walk(x, at, seen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str, str]] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                value, ok = read_json(text)
                if ok:
                    walk(value, root, seen)
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["parent", "name", "how"])

    return df.select(F.col(column)).mapInArrow(scan, "parent string, name string, how string").distinct()


Declared = dict[str, tuple[str, list[Edge], str]]


def schema_graph(df: DataFrame, declared: Declared) -> Declared:
    """The declared graphs of some JSON columns with every nesting that occurs in them.

    declared: source -> (column, edges, root), as the result. One pass over the records finds the edges of
    all columns, one more where it finds a map; what comes to the driver are the names of the schema.
    """
    maps: dict[str, set[str]] = {name: {e.child for e in edges if e.how == KEYED} for name, (_, edges, _) in declared.items()}
    known = {name: {(e.parent, e.name): e for e in edges} for name, (_, edges, _) in declared.items()}
    said = {name: {e.child for e in edges} for name, (_, edges, _) in declared.items()}  # no record changes what is declared
    names = list(declared)
    columns = df.select(*(F.col(declared[n][0]).cast("string").alias(f"_{i}") for i, n in enumerate(names)))

    def walk(value: object, node: str, above: tuple[tuple[str, str], ...], into: set, source: str) -> None:
        value = opened(value)
        if isinstance(value, list):
            for x in value:
                walk(x, node, above, into, source)
        elif isinstance(value, dict):
            for name, x in value.items():
                x = opened(x)
                nested = isinstance(x, (dict, list))
                e = known[source].get((node, name))
                if e is not None:
                    child, how = e.child, e.how
                elif nested:
                    child = next((n for step, n in above if step == name and n not in said[source]), f"{node}.{name}")
                    how = MANY if isinstance(x, list) else ONE
                    into.add((source, node, name, child, how))
                if not nested:
                    continue
                below = (*above, (name, child))
                if child in maps[source] and isinstance(x, dict):
                    # the elements of a map are one node
                    for y in x.values():
                        walk(y, child, below, into, source)
                else:
                    walk(x, child, below, into, source)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        seen: set[tuple[str, str, str, str, str]] = set()
        for b in batches:
            for i, source in enumerate(names):
                for text in b.column(i).to_pylist():
                    value, ok = read_json(text)
                    if ok and isinstance(value, dict):
                        walk(value, declared[source][2], (), seen, source)
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([_strings([r[i] for r in rows]) for i in range(5)], ["source", "parent", "name", "child", "how"])

    while True:
        edges = columns.mapInArrow(scan, "source string, parent string, name string, child string, how string").distinct()
        # names of one object beyond MAP_FROM stay on the executors
        few = edges.groupBy("source", "parent").agg(F.slice(F.array_sort(F.collect_set(F.struct("name", "child", "how"))), 1, 2 * MAP_FROM).alias("e"), F.count_distinct("name").alias("n")).collect()
        found = {(r["source"], r["parent"]) for r in few if r["n"] >= MAP_FROM and r["parent"] not in maps[r["source"]]}
        if not found:
            break
        for source, node in found:
            maps[source].add(node)
    out: Declared = {}
    for name, (column, edges, root) in declared.items():
        merged = {(e.parent, e.name): e for e in edges}
        for r in few:
            if r["source"] == name:
                for x in r["e"]:
                    old = merged.get((r["parent"], x["name"]))
                    how = MANY if old is not None and MANY in (old.how, x["how"]) else x["how"]
                    merged[r["parent"], x["name"]] = Edge(r["parent"], x["name"], x["child"], KEYED if x["child"] in maps[name] else how)
        out[name] = column, list(merged.values()), root
    return out


def _deep() -> None:
    """Lets walks go as deep as what the JSON decoder accepts (some ten thousand levels; deeper texts are unparseable)."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _whole(digits: str) -> object:
    """Very long integers are valid JSON but beyond Python's conversion limit."""
    return int(digits) if len(digits) < 4000 else digits


_decode = json.JSONDecoder(parse_constant=_no_constant, parse_int=_whole).decode


def _strings(values: list[str]) -> pa.Array:
    """A string array; escaped lone surrogates, which UTF-8 can't hold, become question marks."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([v.encode("utf-8", "replace").decode() for v in values], pa.string())


def read_json(text: str | None) -> tuple[object, bool]:
    """(value, True), or (None, False) where text is not JSON; null and blank texts are (None, True)."""
    if text is None or not text.strip():
        return None, True
    try:
        return opened(_decode(text)), True
    except (ValueError, RecursionError):
        return None, False


def opened(value: object) -> object:
    """A JSON string that holds a JSON object, array or string is that JSON, however often it was encoded."""
    while isinstance(value, str) and (s := value.strip()) and (s[0] in '{["' or s == "null"):
        try:
            value = _decode(s)
        except (ValueError, RecursionError):
            return value
    return value


def _elements(value: object, how: str) -> list[tuple[str, object]]:
    """The (key, element) pairs of a repeated node, without nulls."""
    value = opened(value)
    if value is None:
        return []
    if isinstance(value, list):
        return [(str(i), x) for i, x in enumerate(value) if x is not None]
    if isinstance(value, dict) and how == KEYED:
        return [(k, x) for k, x in value.items() if x is not None]
    return [("0", value)]


def _at(value: object, steps: tuple[str, ...]) -> object:
    for s in steps:
        value = opened(value)
        if not isinstance(value, dict):
            return None
        value = value.get(s)
    return value


def _scalars(value: object, steps: tuple[str, ...], plan: TablePlan, into: dict[str, str]) -> None:
    """The atomic members of an element and of its inlined descendants, as column -> JSON text."""
    value = opened(value)
    if not isinstance(value, dict):
        if not steps and value is not None:
            into["value"] = value if isinstance(value, str) else json.dumps(value)
        return
    below = {c.steps[len(steps)] for c in plan.children if c.steps[: len(steps)] == steps and len(c.steps) > len(steps)}
    for k, x in value.items():
        if isinstance(x, (dict, list)):
            if (*steps, k) in plan.inlined:
                _scalars(x, (*steps, k), plan, into)
            elif k not in below:
                into[".".join((*steps, k))] = json.dumps(x)
        elif x is not None and k not in below:
            into[".".join((*steps, k))] = x if isinstance(x, str) else json.dumps(x)


def _maps(rows: list[list[tuple[str, str]]]) -> pa.Array:
    kind = pa.map_(pa.string(), pa.string())
    try:
        return pa.array(rows, kind)
    except UnicodeEncodeError:
        return pa.array([[(k.encode("utf-8", "replace").decode(), v.encode("utf-8", "replace").decode()) for k, v in kv] for kv in rows], kind)


def _pointer(key: str) -> str:
    """A key as a part of a path."""
    return key.replace("~", "~0").replace("/", "~1") if "/" in key or "~" in key else key


def shred(
    df: DataFrame, plans: dict[str, tuple[str, TablePlan]], key: str = "id", with_values: bool = True, with_root: bool = False, only: str | None = None
) -> DataFrame:
    """All tables of some JSON columns as one stream of element rows, in one pass over the records.

    plans: source name -> (JSON column, its plan). Columns of the result: the key, source_column,
    child_path (the table), parent_key, child_key, parent_path, key_path (all keys from the root, as in JSON
    pointers; with the record's key they are the row's name and foreign key), values (inlined columns).
    with_root: a row of the table '' too for each non-empty object of a column, with what the root inlines.
    only: the one table that is wanted; what doesn't lead to it isn't walked.
    """
    names = list(plans)
    trees = [plans[n][1] for n in names]

    def rows_of(value: object, plan: TablePlan, path: str, parent: str, keys: tuple[str, ...], emit) -> None:
        for c in plan.children:
            if c.recursive_to is not None:
                c = _again(c, trees)
            at = ".".join(c.steps) if not path else f"{path}.{'.'.join(c.steps)}"
            if only is not None and only != at and not only.startswith(at + "."):
                continue
            for k, x in _elements(_at(value, c.steps), c.how):
                if only is None or only == at:
                    emit(at, parent, k, keys, k, x, c)
                if c.children:
                    rows_of(x, c, at, k, (*keys, _pointer(k)), emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        for b in batches:
            ids, src, path, parent, child, above, full, values = [], [], [], [], [], [], [], []
            take = b.column(0).to_pylist()
            for j, (name, tree) in enumerate(zip(names, trees)):
                for i, text in enumerate(b.column(j + 1).to_pylist()):
                    value, ok = read_json(text)

                    def emit(at, up, k, keys, own, x, c, record=take[i], name=name):
                        ids.append(record)
                        src.append(name)
                        path.append(at)
                        parent.append(up)
                        child.append(k)
                        if with_values:
                            above.append("/".join(keys))
                            full.append("/".join((*keys, _pointer(own))) if own else "")
                            into: dict[str, str] = {}
                            _scalars(x, (), c, into)
                            values.append(list(into.items()))

                    if not ok:
                        if only is None:
                            emit("unparseable", "", "", (), "", None, tree)
                    elif isinstance(value, dict):
                        if (with_root or only == "") and value:
                            emit("", "", "", (), "", value, tree)
                        rows_of(value, tree, "", "", (), emit)
            arrays = [pa.array(ids, b.schema.field(0).type), *(_strings(x) for x in (src, path, parent, child))]
            if with_values:
                arrays += [_strings(above), _strings(full), _maps(values)]
            yield pa.RecordBatch.from_arrays(arrays, cols)

    kind = df.schema[key].dataType.simpleString()
    cols = [key, "source_column", "child_path", "parent_key", "child_key"] + (["parent_path", "key_path", "values"] if with_values else [])
    schema = f"`{key}` {kind}, source_column string, child_path string, parent_key string, child_key string"
    if with_values:
        schema += ", parent_path string, key_path string, values map<string,string>"
    return df.select(key, *(F.col(plans[n][0]).cast("string").alias(f"_{i}") for i, n in enumerate(names))).mapInArrow(run, schema)


def _again(c: TablePlan, trees: list[TablePlan]) -> TablePlan:
    """A recursive reference continues with the children of the table it refers to."""

    def find(t: TablePlan) -> TablePlan | None:
        if t.node == c.recursive_to and t.recursive_to is None:
            return t
        return next((x for k in t.children if (x := find(k))), None)

    hit = next((x for t in trees if (x := find(t))), None)
    return TablePlan(c.node, c.steps, c.how, hit.inlined, hit.children, None) if hit else c


def observed_columns(elements: DataFrame) -> DataFrame:
    """(source_column, child_path, column, n) of the values that occur in each table: its columns, as the data have them."""
    return elements.select("source_column", "child_path", F.explode(F.map_keys("values")).alias("column")).groupBy("source_column", "child_path", "column").agg(F.count("*").alias("n"))


def observed_table(elements: DataFrame, source: str, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """One table with every column that occurs in it; kinds: SQL types of columns, string where not named.

    One pass finds the columns, whose number is that of the schema's names. A column whose name is that of
    another once its points are underlines, or that of a key, keeps its points; a named kind is there even if it doesn't occur.
    """
    rows = elements.filter((F.col("source_column") == source) & (F.col("child_path") == path))
    kinds = kinds or {}
    names = [*kinds, *sorted({r["column"] for r in observed_columns(rows).select("column").collect()} - set(kinds))]
    keep = [c for c in elements.columns if c not in ("source_column", "child_path", "values")]
    plain = [n.replace(".", "_").lower() for n in names]

    def typed(name: str) -> Column:
        clash = plain.count(name.replace(".", "_").lower()) > 1 or name.replace(".", "_").lower() in keep
        value = F.element_at("values", F.lit(name)).try_cast(kinds.get(name, "string"))
        return value.alias(f"values.{name}" if clash else name.replace(".", "_"))

    return rows.select(*keep, *map(typed, names))


def flat_table(elements: DataFrame, source: str, path: str, columns: dict[str, str]) -> DataFrame:
    """One relational table out of the element stream; columns: inlined column -> SQL type."""

    def typed(name: str, kind: str) -> Column:
        return F.expr(f"try_cast(`values`['{name}'] AS {kind})").alias(name.replace(".", "_"))

    keep = [c for c in elements.columns if c not in ("source_column", "child_path", "values")]
    return elements.filter((F.col("source_column") == source) & (F.col("child_path") == path)).select(
        *keep, *(typed(n, k) for n, k in columns.items())
    )


# The schema graph of the document register's three JSON columns.
RECORD_GRAPH = {
    "extracted": (
        "extracted_json",
        [
            Edge("extraction", "fields", "field", KEYED),
            Edge("field", "candidates", "candidate", MANY),
            Edge("field", "skills_list", "skill", MANY),
            Edge("extraction", "missing_fields", "missing_field", MANY),
            Edge("extraction", "extractor", "extractor"),
            Edge("extraction", "line_items", "line_item", MANY),
            Edge("line_item", "taxes", "tax", MANY),
        ],
        "extraction",
    ),
    "validation": (
        "validation_json",
        [
            Edge("validation", "passed_fields", "passed_field", MANY),
            Edge("validation", "failed_fields", "failed_field", MANY),
            Edge("validation", "field_errors", "field_error", KEYED),
            Edge("validation", "field_results", "field_result", MANY),
            Edge("field_result", "checks", "check", MANY),
        ],
        "validation",
    ),
    "anomaly": (
        "anomaly_json",
        [
            Edge("report", "anomalies", "anomaly", MANY),
            Edge("anomaly", "matched_ids", "matched_id", MANY),
            Edge("anomaly", "details", "details"),
            Edge("details", "evidence", "evidence", MANY),
        ],
        "report",
    ),
}


def record_plans() -> dict[str, tuple[str, TablePlan]]:
    return {name: (column, analyse(edges, root)) for name, (column, edges, root) in RECORD_GRAPH.items()}


def observed_plans(doc_records: DataFrame, sources: Iterable[str] | None = None) -> dict[str, tuple[str, TablePlan]]:
    """The plans of the register's columns by the nesting that its records have, beside the declared one."""
    declared = {n: g for n, g in RECORD_GRAPH.items() if sources is None or n in sources}
    return {name: (column, analyse(edges, root)) for name, (column, edges, root) in schema_graph(doc_records, declared).items()}


def record_elements(doc_records: DataFrame, with_values: bool = True, with_root: bool = False, observed: bool = False) -> DataFrame:
    """Every nested element of the document register, with its parent and record; observed: by the graph of the data, else by the declared one."""
    plans = observed_plans(doc_records) if observed else record_plans()
    return shred(doc_records, plans, "id", with_values, with_root)


def table_elements(doc_records: DataFrame, source: str, path: str) -> DataFrame:
    """The elements of one table; only its column is read, and only the way to it is walked."""
    return shred(doc_records, observed_plans(doc_records, [source]), "id", only=path)


def write_tables(elements: DataFrame, folder: str) -> DataFrame:
    """Writes all tables below a folder, a part for each table; every row has its name (id, key_path) and foreign key (id, parent_path).

    The result lists them: (source_column, child_path, n, columns).
    """
    spark = elements.sparkSession
    path = F.when(F.col("child_path") == "", "_root").otherwise(F.col("child_path"))
    elements.withColumn("child_path", path).write.partitionBy("source_column", "child_path").parquet(folder)
    return inventory(spark.read.parquet(folder))


def inventory(elements: DataFrame) -> DataFrame:
    """(source_column, child_path, n, columns): the tables that there are, with the columns that occur."""
    key = ["source_column", "child_path"]
    columns = elements.select(*key, F.explode(F.map_keys("values")).alias("c")).distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("columns"))
    return elements.groupBy(*key).agg(F.count("*").alias("n")).join(columns, key, "left").select(*key, "n", F.coalesce("columns", F.lit("")).alias("columns"))

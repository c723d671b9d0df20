"""Duplicates of new batches against everything accepted before.

Multi-key sorted-neighbourhood runs. Every accepted record leaves an entry for
each of its keys (digest; invoice number with company) in a run: files sorted by
place, each a range of places, in a folder that outlives the session. A manifest
names the runs, their files and the least and greatest place of each; a history
is reopened from it. A new batch is sorted by place, and each of its ranges is
merged with the runs: of the files only those whose range meets the batch's are
opened, of these only the row groups in which a new entry falls, and only
entries of one place (the window) are compared. The runs are never shuffled, nor
read where the batch has no key. Links are written batch by batch and read back
as one table.

The batch's accepted records become a further run. Runs are kept in tiers by
size: RUNS_PER_TIER runs of a tier are merged into one of the next, so an entry
is rewritten once a tier, and the files of merged runs are deleted.

The company's name, which may differ by two letters, is the second half of the
number's key. Cut into three parts, a name and another within two edits of it
share one part unchanged, shifted by two places at most. So an entry stands in
a run once for each part of its name (a slot), and a new record looks only into
the slots where an equal or similar name can stand: the window drops nothing,
and a number that thousands of companies use gives no pairs of all of them.

Records count in ascending id: one that repeats an accepted record is not
accepted itself. Inside a batch this concerns only records that share a key with
another of it. Up to ROWS_TOGETHER of their entries are gone through in one
task, in that order; more are settled in rounds over classes of equal keys, by
minimum ids only. Both give the same. New entries of one place are parted by id,
so a key that holds a third of the batch is merged in many tasks.

Defined results: null, blank and placeholder keys match nothing; records of the
same id in several rows are one record; empty batches give no rows; records
without a batch number come after all numbered batches. Records of the history
are accepted as they are, so a new record gives a row for each that it repeats.
"""

from __future__ import annotations

import json
import math
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.session import file_system, scratch

RUNS_PER_TIER = 4
GROUP_BYTES = 4 << 20  # size of a row group of a run, the least that is read
ROWS_TOGETHER = 100_000  # entries of a batch that one task goes through
PAIRS_AT_ONCE = 1_000_000  # pairs of a window held in a task at a time
LETTERS = 2  # wrong letters in a company's name

# What stands for a missing value.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "n.a.", "nil", "none", "null", "nan", "not found", "not specified", "not available", "unknown", "missing", "tbd", "undefined"]
# Legal forms at the end of a company's name.
LEGAL_FORMS = "incorporated|inc|llc|limited|ltd|plc|gmbh|sarl|sas|sa|corporation|corp|company|co|llp|lp|private|pvt|pte|pty|ag|kg|bv|nv|spa|srl|oy|ab|as"
# Characters misread for one another, in numbers and in names.
NUMBER_FROM, NUMBER_TO = "OQDILSZBG|!", "00011528611"
NAME_FROM, NAME_TO = "05182|!i", "oslbzlll"

_ACCENTED = [(chr(c), b) for c in range(0xC0, 0x250) if (b := unicodedata.normalize("NFD", chr(c))[0].lower()).isascii() and b.isalpha()]
_FROM, _TO = "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED)
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def _present(c: Column) -> Column:
    c = F.translate(c, _WIDE, _NARROW)
    return F.when(~F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))).isin(PLACEHOLDERS), c)


def digest_key(c: Column) -> Column:
    """The digest a file hash denotes: hexadecimal digits in lower case, without label and separators; else null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s*(?:sha-?\d+|md5|blake\w*)\s*[:=\-]\s*", ""), r"(?U)[\s:\-]", "")
    bare = F.regexp_replace(bare, "^0x", "")
    return F.when(bare.rlike("^[0-9a-f]{32,}$") & ~bare.rlike(r"^(.)\1*$"), bare)


def number_key(c: Column) -> Column:
    """An invoice number without label, separators, case and leading zeros of its serial; misread characters are one class."""
    bare = F.upper(F.regexp_replace(_present(c), r"(?iU)^[\W_]*(?:invoice\b[\W_]*)?(?:(?:no|nr|num|number)\b[\W_]*)?(?=\w)", ""))
    parts = F.translate(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^A-Z0-9|!]+", " "), r"^ | $", ""), NUMBER_FROM, NUMBER_TO)
    joined = F.regexp_replace(parts, " ", "")
    dated = r"^(\w{1,5}?)((?:19|20)\d\d)0*(\d+)$"
    plain = F.regexp_replace(F.regexp_replace(parts, r"(^| )0+(?=\d+$)", "$1"), " ", "")
    key = F.when(joined.rlike(dated), F.regexp_replace(joined, dated, "$1-$2-$3")).otherwise(plain)
    return F.when(key.rlike(r"\d"), key)


def company_words(c: Column) -> Column:
    """The words of a company's name without accents, forms of address and legal form, misread characters as one class."""
    low = F.translate(F.lower(_present(c)), _FROM, _TO)
    low = F.translate(F.regexp_replace(low, r"(?U)^\s*(?:the\s+|m/s\.?\s+|messrs\.?\s+|firma\s+)+", ""), NAME_FROM[:-1], NAME_TO[:-1])
    words = F.regexp_replace(F.regexp_replace(low, r"[.'’]", ""), r"(?U)[^\p{L}\p{N}]+", " ")
    words = F.trim(F.regexp_replace(words, r"(?: (?:and|und|et))(?= )", ""))
    bare = F.regexp_replace(words, rf"(?: (?:{LEGAL_FORMS}))+$", "")
    return F.translate(bare, NAME_FROM[-1], NAME_TO[-1])


def skeleton(words: Column) -> Column:
    s = F.regexp_replace(words, " ", "")
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d")):
        s = F.regexp_replace(s, a, b)
    return F.when(s != "", s)


def entries(records: DataFrame) -> DataFrame:
    """(kind, key, name, words, id): an entry for each key of each record."""
    is_invoice = F.col("document_type") == "Invoice"
    words = F.when(is_invoice, company_words(F.col("company")))
    keep = [c for c in ("_batch",) if c in records.columns]
    base = records.select("id", *keep, digest_key(F.col("file_hash")).alias("h"), F.when(is_invoice, number_key(F.col("invoice_number"))).alias("n"), words.alias("w"))
    base = base.withColumn("s", skeleton(F.col("w")))
    either = F.array_compact(
        F.array(
            F.when(F.col("h").isNotNull(), F.struct(F.lit("digest").alias("kind"), F.col("h").alias("key"), F.lit("").alias("name"), F.lit(0).alias("words"))),
            F.when(
                F.col("n").isNotNull() & F.col("s").isNotNull(),
                F.struct(F.lit("number").alias("kind"), F.col("n").alias("key"), F.col("s").alias("name"), F.size(F.split("w", " ")).alias("words")),
            ),
        )
    )
    return base.select("id", *keep, F.inline(either)).select("kind", "key", "name", "words", "id", *keep)


def _slots(name: Column) -> list[Column]:
    """The slots in which a name stands: its length, the number of a part, and the part."""
    n = F.length(name)
    third = F.floor(n / 3).cast("int")
    parts = [F.substring(name, F.lit(1), third), F.substring(name, third + 1, third), F.substring(name, 2 * third + 1, n)]
    return [F.concat_ws(":", n.cast("string"), F.lit(str(i)), p) for i, p in enumerate(parts)]


def _probes(name: Column) -> list[Column]:
    """The slots in which names within two edits of this one stand, one of them at least."""
    out = []
    for more in range(-LETTERS, LETTERS + 1):  # so much longer is this name than the one in the slot
        n = F.length(name) - more
        third = F.floor(n / 3).cast("int")
        looks = [(0, F.lit(1), third), (2, 2 * third + 1 + more, n - 2 * third)]
        looks += [(1, third + 1 + shift, third) for shift in range(max(-1, more - 1), min(1, more + 1) + 1)]
        for i, start, size in looks:
            fits = (n >= 1) & (start >= 1)
            out.append(F.when(fits, F.concat_ws(":", n.cast("string"), F.lit(str(i)), F.substring(name, start, size))))
    return out


def slotted(df: DataFrame) -> DataFrame:
    """Entries with slots, in which they stand, and probes, where they look; an entry without a name has the slot ''."""

    def every(slots: list[Column]) -> Column:
        return F.when(F.col("kind") == "number", F.array_distinct(F.array_compact(F.array(*slots)))).otherwise(F.array(F.lit("")))

    return df.withColumns({"slots": every(_slots(F.col("name"))), "probes": every(_probes(F.col("name")))})


def _in_slots(df: DataFrame) -> DataFrame:
    """Each slotted entry once for each of its slots."""
    return df.select("kind", "key", "name", "words", "id", F.explode("slots").alias("slot"))


def _same(a: str, b: str) -> Column:
    """Whether two entries of one key name the same thing: at most two wrong letters, no other word."""
    x, y = F.col(f"{a}.name"), F.col(f"{b}.name")
    return (x == y) | ((F.col(f"{a}.words") == F.col(f"{b}.words")) & (F.levenshtein(x, y, LETTERS) >= 0))


def _met(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs b of slotted new entries and a of old ones, which stand in slots, that share a key and name the same."""
    b = new.select("kind", "key", "name", "words", "id", F.explode("probes").alias("slot")).alias("b")
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("kind", "key", "slot")]
    return b.join(old.alias("a"), keys[0] & keys[1] & keys[2] & _same("a", "b"))


def _placed(df: DataFrame, slots: str) -> DataFrame:
    """Slotted entries once for each of the slots or probes, as (place, name, words, id); places of a number are neighbours."""
    e = df.select("kind", "key", "name", "words", "id", F.explode(slots).alias("slot"))
    return e.select(F.concat_ws("\t", F.substring("kind", 1, 1), "key", "slot").alias("place"), "name", "words", "id")


def _sorted(placed: DataFrame) -> DataFrame:
    """In ranges of places, sorted; repeated entries once. The id parts a place that many entries share."""
    return placed.repartitionByRange("place", "id").dropDuplicates().sortWithinPartitions("place", "id")


class Windows:
    """The stretches of some runs' files in which given places stand."""

    def __init__(self, files: list[tuple[str, str, str]]) -> None:
        """files: (path, least place, greatest place), run by run in the order of their places."""
        # chains of files whose ranges follow each other
        self.chains: list[tuple[list[str], list[str], list[str]]] = []
        for path, least, most in files:
            if not self.chains or least < self.chains[-1][2][-1]:
                self.chains.append(([], [], []))
            for part, x in zip(self.chains[-1], (path, least, most)):
                part.append(x)
        self.opened: dict[str, tuple[pq.ParquetFile, list[tuple[str, str]]]] = {}
        self.held: dict[str, tuple[int, pa.Table]] = {}
        self.groups_read = 0

    def _open(self, path: str) -> tuple[pq.ParquetFile, list[tuple[str, str]]]:
        if path not in self.opened:
            fs, at = file_system(path)
            f = pq.ParquetFile(fs.open_input_file(at))
            self.opened[path] = f, [_bounds(f.metadata.row_group(g)) for g in range(f.metadata.num_row_groups)]
        return self.opened[path]

    def of(self, places: list[str]) -> Iterator[pa.Table]:
        """Row groups of the runs, each where one of the sorted places may stand."""

        def met(least: str, most: str) -> bool:
            at = bisect_left(places, least)
            return at < len(places) and places[at] <= most

        for paths, leasts, mosts in self.chains:
            first, last = bisect_left(mosts, places[0]), bisect_right(leasts, places[-1])
            for k in range(first - 1, -1, -1):  # what the sorted places have passed
                if self.opened.pop(paths[k], None) is None:
                    break
                self.held.pop(paths[k], None)
            for path, least, most in zip(paths[first:last], leasts[first:last], mosts[first:last]):
                if not met(least, most):
                    continue
                f, bounds = self._open(path)
                for g, (x, y) in enumerate(bounds):
                    if met(x, y):
                        if self.held.get(path, (-1, None))[0] != g:
                            self.groups_read += 1
                            self.held[path] = g, f.read_row_group(g, columns=["place", "name", "words", "id"], use_threads=False)
                        yield self.held[path][1]


def _bounds(group) -> tuple[str, str]:
    """The least and greatest place of a row group."""
    s = group.column(0).statistics
    return (s.min, s.max) if s is not None and s.has_min_max else ("", chr(0x10FFFF))


def _meetings(new: pa.Table, old: pa.Table) -> Iterator[pa.Table]:
    """The pairs of rows of one place."""
    old = old.filter(pc.is_in(old["place"], value_set=new["place"].unique()))
    if not old.num_rows:
        return
    most = max(pc.value_counts(old["place"]).field("counts").to_pylist())
    new = new.filter(pc.is_in(new["place"], value_set=old["place"].unique()))
    old = old.rename_columns(["place", "name_a", "words_a", "id_a"])
    step = max(1, PAIRS_AT_ONCE // most)
    for at in range(0, new.num_rows, step):
        yield new.slice(at, step).join(old, "place", join_type="inner", use_threads=False)


def close(a: str, b: str, most: int = LETTERS) -> bool:
    """Whether b comes of a by at most so many wrong, missing or additional letters."""
    if abs(len(a) - len(b)) > most:
        return False
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (x != b[j - 1]))
        if min(now) > most:
            return False
        before = now
    return before[-1] <= most


def _gone_through(among: DataFrame) -> DataFrame:
    """(id_a, id_b): links inside a batch, of its slotted entries in ascending id; known: the record repeats one of the history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stand: dict[tuple[str, str, str], list[tuple[int, str, int]]] = {}
        out: list[tuple[int, int]] = []
        record: list[tuple] = []

        def settle() -> None:
            hits = set()
            for kind, key, name, words, at, _, probes, _ in record:
                for slot in probes:
                    for a, other, n in stand.get((kind, key, slot), ()):
                        if a not in hits and a < at and (other == name or n == words and close(other, name)):
                            hits.add(a)
            if not hits and not record[0][7]:
                for kind, key, name, words, at, slots, _, _ in record:
                    for slot in slots:
                        stand.setdefault((kind, key, slot), []).append((at, name, words))
            out.extend((a, record[0][4]) for a in sorted(hits))

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(8))):
                if record and row[4] != record[0][4]:
                    settle()
                    record.clear()
                record.append(row)
        if record:
            settle()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["id_a", "id_b"])

    columns = among.select("kind", "key", "name", "words", "id", "slots", "probes", F.coalesce("known", F.lit(False)).alias("known"))
    return columns.coalesce(1).sortWithinPartitions("id").mapInArrow(run, "id_a bigint, id_b bigint")


class History:
    """An accepted history in a folder: opened where it is there, else begun."""

    def __init__(self, spark: SparkSession, root: str | None = None, together: int = ROWS_TOGETHER) -> None:
        self.together = together
        self.spark, self.root = spark, (root or scratch(spark, "history")).rstrip("/")
        self.runs: list[dict] = []
        self.count = self.version = 0
        fs, at = file_system(f"{self.root}/manifest")
        fs.create_dir(at, recursive=True)
        known = sorted(f.path for f in fs.get_file_info(FileSelector(at)) if f.path.endswith(".json"))
        if known:
            with fs.open_input_file(known[-1]) as f:
                said = json.loads(f.read().decode())
            self.runs, self.count, self.version = said["runs"], said["count"], said["version"]

    def _commit(self) -> None:
        """The state as a new version; the one before stays until it is written."""
        self.version += 1
        fs, at = file_system(f"{self.root}/manifest")
        text = json.dumps({"version": self.version, "count": self.count, "runs": self.runs})
        with fs.open_output_stream(f"{at}/new") as f:
            f.write(text.encode())
        fs.move(f"{at}/new", f"{at}/{self.version:09d}.json")
        if self.version > 1:
            old = f"{at}/{self.version - 1:09d}.json"
            if fs.get_file_info(old).is_file:
                fs.delete_file(old)

    def _path(self, what: str) -> str:
        self.count += 1
        return f"{self.root}/{what}/{self.count:06d}"

    def _kept(self, df: DataFrame, what: str) -> DataFrame:
        path = self._path(what)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _run(self, df: DataFrame) -> dict:
        """A run out of sorted entries, with the range of each of its files."""
        path = self._path("runs")
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
        fs, at = file_system(path)
        files, rows = [], 0
        for f in fs.get_file_info(FileSelector(at)):
            if f.base_name.endswith(".parquet"):
                with fs.open_input_file(f.path) as x:
                    meta = pq.read_metadata(x)
                bounds = [_bounds(meta.row_group(g)) for g in range(meta.num_row_groups)]
                rows += meta.num_rows
                if meta.num_rows:
                    files.append([f"{path}/{f.base_name}", min(b[0] for b in bounds), max(b[1] for b in bounds)])
        return {"path": path, "rows": rows, "tier": int(math.log(max(rows, 1), RUNS_PER_TIER)), "files": sorted(files, key=lambda x: x[1])}

    def files(self) -> list[tuple[str, str, str]]:
        """(path, least place, greatest place) of every file of the runs."""
        return [tuple(f) for r in self.runs for f in r["files"]]

    def add(self, new: DataFrame) -> None:
        """Accepted slotted entries become a run; full tiers are merged."""
        self.runs.append(self._run(_sorted(_placed(new, "slots"))))
        self._commit()
        while True:
            tiers: dict[int, list[dict]] = {}
            for r in self.runs:
                tiers.setdefault(r["tier"], []).append(r)
            full = next((rs for _, rs in sorted(tiers.items()) if len(rs) >= RUNS_PER_TIER), None)
            if full is None:
                return
            old = self.spark.read.schema("place string, name string, words int, id bigint").parquet(*(r["path"] for r in full))
            merged = self._run(_sorted(old))
            merged["tier"] = max(merged["tier"], full[0]["tier"] + 1)
            self.runs = [r for r in self.runs if r not in full] + [merged]
            self._commit()
            for r in full:
                fs, at = file_system(r["path"])
                fs.delete_dir(at)

    def repeated(self, new: DataFrame) -> DataFrame:
        """(id_a, id_b): new slotted entries b and accepted ones a that they repeat, by a merge of the sorted batch with the runs."""
        sent = self.spark.sparkContext.broadcast(self.files())

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(sent.value)
            for b in batches:
                table = pa.Table.from_batches([b])
                places = table["place"].to_pylist()
                if not places:
                    continue
                for old in windows.of(places):
                    for t in _meetings(table, old):
                        yield from t.select(["name", "words", "id", "name_a", "words_a", "id_a"]).combine_chunks().to_batches(max_chunksize=20_000)

        met = _sorted(_placed(new, "probes")).mapInArrow(merge, "name string, words int, id bigint, name_a string, words_a int, id_a bigint")
        same = (F.col("name") == F.col("name_a")) | ((F.col("words") == F.col("words_a")) & (F.levenshtein("name", "name_a", LETTERS) >= 0))
        return met.filter(same & (F.col("id_a") < F.col("id"))).select("id_a", F.col("id").alias("id_b")).distinct()

    def take(self, batch: DataFrame) -> DataFrame:
        """Accepts a batch of records; the result has a row (id_a, id_b) for each record b of it that repeats an accepted record a."""
        return self.take_entries(self._kept(slotted(entries(batch)), "entries"))

    def take_entries(self, new: DataFrame) -> DataFrame:
        links = self._path("links")
        schema = "id_a bigint, id_b bigint"

        def linked() -> DataFrame:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(links)

        self.repeated(new).write.parquet(f"{links}/history")
        # only records that share a key with another of the batch can repeat each other
        shared = new.groupBy("kind", "key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("kind", "key")
        among = new.join(shared, ["kind", "key"], "left_semi").select(*new.columns).distinct()
        known = linked().select(F.col("id_b").alias("id"), F.lit(True).alias("known"))
        among = self._kept(among.join(known.distinct(), "id", "left"), "shared")
        rows = among.count()
        if rows > self.together:
            self._in_rounds(among, links)
        elif rows:
            _gone_through(among).write.parquet(f"{links}/batch")
        gone = linked().select(F.col("id_b").alias("id"))
        self.add(new.join(gone, "id", "left_anti").select(*new.columns))
        return linked()

    def _in_rounds(self, among: DataFrame, links: str) -> None:
        """Writes the links inside a batch: in each round the records of least id among those that are alike are accepted."""
        gone = self._kept(among.filter("known").select("id").distinct(), "gone")
        columns = [c for c in among.columns if c != "known"]
        fresh = self._kept(among.filter("known IS NULL").select(*columns), "open")
        while not fresh.isEmpty():
            classes = fresh.groupBy("kind", "key", "name", "words").agg(F.min("id").alias("id"), F.first("slots").alias("slots"), F.first("probes").alias("probes"))
            least = _met(classes, _in_slots(classes)).groupBy("b.kind", "b.key", "b.name").agg(F.min("a.id").alias("least"))
            first = fresh.join(least, ["kind", "key", "name"]).groupBy("id").agg(F.min("least").alias("least"))
            ranked = self._kept(fresh.join(first, "id").select(*columns, "least"), "ranked")
            later = ranked.filter("least < id").drop("least")
            dropped = self._kept(_met(later, _in_slots(ranked.filter("least = id").drop("least"))).filter(F.col("a.id") < F.col("b.id")).select(F.col("b.id").alias("id")).distinct(), "dropped")
            gone = gone.unionByName(dropped)
            fresh = self._kept(later.join(dropped, "id", "left_anti").select(*columns), "open")
        # what was accepted now meets every record of the batch that was not
        gone = self._kept(gone.distinct(), "gone")
        taken, late = among.join(gone, "id", "left_anti").select(*columns), among.join(gone, "id", "left_semi").select(*columns)
        met = _met(late, _in_slots(taken)).filter(F.col("a.id") < F.col("b.id"))
        met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct().write.parquet(f"{links}/batch")

    def links(self) -> DataFrame:
        """(id_a, id_b) of all batches taken so far."""
        fs, at = file_system(f"{self.root}/links")
        if not fs.get_file_info(at).type.value:
            return self.spark.createDataFrame([], "id_a bigint, id_b bigint")
        return self.spark.read.schema("id_a bigint, id_b bigint").option("recursiveFileLookup", True).parquet(f"{self.root}/links")


def repeats(records: DataFrame, batch: str = "batch_no", history: int = 0, root: str | None = None, together: int = ROWS_TOGETHER) -> DataFrame:
    """(id_a, id_b) of all batches after the history, taken one by one in their order; root: the history's folder, one that exists is carried on."""
    spark = records.sparkSession
    store = History(spark, root, together)
    # one pass over the records; each batch then reads its own entries only
    path = store._path("entries")
    number = F.coalesce(F.col(batch).cast("bigint"), F.lit((1 << 63) - 1))
    cols = ["id", "document_type", "company", "invoice_number", "file_hash"]
    slotted(entries(records.select(*cols, F.greatest(number, F.lit(history)).alias("_batch")))).write.partitionBy("_batch").parquet(path)
    kept = spark.read.schema("kind string, key string, name string, words int, id bigint, slots array<string>, probes array<string>, _batch bigint").parquet(path)
    for n in sorted(r[0] for r in kept.select("_batch").distinct().collect()):  # a row for each batch
        now = kept.filter(F.col("_batch") == n).drop("_batch")
        store.add(now) if n <= history else store.take_entries(now)
    return store.links()

"""Personal information in free text: found, typed and replaced.

E-mail addresses, phone numbers, identity numbers and street addresses have
shapes and are found by them. Names have none: whether a capitalised term is
part of one is estimated from the corpus. In one pass every run of capitalised
words is kept with the sign whether a protected context (title, "Attn:", ...)
stands before it. From all runs of all texts each term gets its disclosure,

    log2( P(protected | term) / P(protected) ),

the pointwise mutual information between the term and the event that it stands
in a protected entity. Terms above DISCLOSURE bits, or whose posterior itself is
POSTERIOR or more (where protected entities are common, few bits remain), reveal
persons wherever they stand; runs made of them are names also without such a
context. Mentions are replaced by typed placeholders, the rest of the text stays.

The revealing terms are sent to the executors as a set while they are at most
TERMS_TO_SEND; beyond that they are joined to the runs on the term.

Defined results: null and empty texts hold nothing; repeated rows repeat their
mentions; texts are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import stored

DISCLOSURE = 1.0  # bits above which a term reveals persons
POSTERIOR, LEAST_POSTERIOR = 0.3, 0.1  # probabilities from which it does without so many bits, and below which it does not with any
LEAST_PROTECTED = 2
TERMS_TO_SEND = 300_000

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
_LOW = "a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľłńņňōőœŕřśşšţťūůűųźżž"
_TOKEN = rf"(?:[{_UP}][{_LOW}]+(?:['’][{_UP}{_LOW}]+)?|[{_UP}]{{2,}})"
_NAME = rf"{_TOKEN}(?:-{_TOKEN})*"

# Titles and labels before a person's name.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Messrs|Herr|Herrn|Frau|Hr|Fr|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señor|Señora|señor|señora|Don|Doña|Sir|Lady"
LABELS = r"Attn ?:|Attention ?:|[Cc]ontact(?: person)? ?:|From ?:|Name ?:|Candidate ?:|Signed ?:|represented by|signatory|candidate|signed by|[Cc]opy to|questions to"
# Words of companies' names, which are not persons.
CORPORATE = set(
    """inc incorporated llc ltd limited plc gmbh sarl corp corporation co company llp pvt ag sa bv nv group holdings partners sons brothers
    bros associates bank university department office team board desk unit""".split()
)
# Capitalised words of forms that are never part of a name.
FORM_WORDS = set(
    """invoice date number email mail phone tel fax mobile cell address skills subject from to bill attn contact person customer reference
    notice memo internal commercial tax total subtotal page copy file confidential agreement service supply lease maintenance contract
    resume curriculum vitae general letter policy note statement order purchase currency vendor party clause dear mr mrs ms dr prof
    frau herr the a an no po ntn cnic ssn passport january february march april may june july august september october november december""".split()
)

_AT = re.compile(r"\s?[@＠]\s?|&#64;|\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+(?=[\w-]+(?:\s+dot\s+|\s*[\[({]\s*dot))", re.I)
_AT_SIGN = re.compile(r"\s?[@＠]\s?|&#64;")
_AT_IN_BRACKETS = re.compile(r"[\[({<]\s*(?:at|@)")
_LOCAL_CHARS = re.compile(r"[\w.+%-]")
_DOMAIN = re.compile(r"[a-z0-9-]+(?:(?:[.．](?=[a-z0-9-]+)|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+)[a-z0-9-]+)+", re.I)
_PHONE = re.compile(
    r"(?<![\w+.,/(#-])(?:"
    r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{1,7}){1,6}"
    r"|00\d{2}(?:[ .\-]\d{2,7}){2,5}"
    r"|\(\d{2,5}\)[ .\-]?\d{2,4}[ .\-]?\d{2,4}(?:[ .\-]\d{2,4})?"
    r"|\d{3}([ .\-])\d{3}\1\d{4}"
    r"|0\d(?: \d\d){4}|0\d{4} \d{6}|0\d{4} \d{3} \d{3}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}|0\d{3}-\d{7}|0\d{10}"
    r")(?![\w-]|[.,]\d|/\d)"
)
# What scanned letters are misread as.
MISREAD = {"a": "a@", "b": "b6", "c": "c€", "e": "e€c", "g": "g9", "i": "i!1l", "l": "l1|", "o": "o0", "s": "s5$", "t": "t7", "u": "uv", "z": "z2"}


def _noisy(words: str) -> str:
    """A pattern for words whose small letters may be misread."""
    return "".join(f"[{MISREAD[c]}]" if c in MISREAD else c for c in words)


# Labels of personal identity numbers.
_ID_LABEL = (
    "(?:SSN|CNIC|NICOP|NIC|NINO|DNI|NIE|SOCIAL SECURITY NUMBER|PASSPORT|NATIONAL ID|"
    + "|".join(
        f"[{x[0]}{x[0].upper()}]{_noisy(x[1:])}"
        for x in ("social security number", "social security no", "social security", "ni number", "ni no", "national identity card", "national identity", "national id",
                  "passport", "reisepass", "pasaporte", "passeport", "personalausweis", "ausweis", "identity card", "id card")
    ).replace("nat[i!1l][o0]na[l1|] [i!1l]d", "nat[i!1l][o0]na[l1|] [Ii][Dd]").replace("[nN][i!1l] ", "N[Ii] ")
    + ")"
)
_LABELLED_ID = re.compile(
    rf"(?<!\w){_ID_LABEL}(?:[\s-]*(?:[Nn][o0]|[Nn]r|[Nn]úm|[Nn]umb[e€]r|[Nn]ummer|NO|n°)(?!\w)\.?)?\s*[:#]?\s*(?:is |ist |es )?"
    r"((?=[A-Z0-9 -]*\d)[A-Z0-9]+(?:[ -](?=[A-Z0-9]*\d)[A-Z0-9]+)*(?: [A-D](?![\w]))?)"
)
_SHAPED_ID = re.compile(
    r"(?<![\w+.-])(?:\d{5}-\d{7}-\d|(?:QQ|[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]) ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]\d\d[A-Z]\d{4}[A-Z]\d\d|\d{6}-[A-Z]\d{4})(?![\w-])"
)
# Kinds of streets.
_KIND = (
    r"Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Way|Drive|Dr|Close|Row|Hill|Park|Parade|Court|Ct|Place|Pl|Square|Sq|Terrace|Crescent|Gardens|"
    r"Boulevard|Blvd|Quay|Walk|Mews|Grove|View|Alley|Yard|Wharf|Circle|Highway|Parkway"
)
_ADDRESS = re.compile(
    r"(?<![\w#-])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|House|Floor|Room|Office|Shop)\s(?:[Nn]o\.?\s?)?\d+[A-Za-z]?(?:-[A-Z])?,?\s+)?\d{{1,5}}[a-z]?(?:[-/]\d{{1,4}})?,?\s(?:[{_UP}][{_LOW}'’]+\s){{1,3}}(?:{_KIND})(?!\w)"
    r"|Plot\s(?:[Nn]o\.?\s?)?\d+(?:-[A-Z])?,\s+\S+(?:\sIndustrial\s(?:Area|Estate|Park))?"
    rf"|(?:House|H)\s?(?:[Nn]o\.?|#)?\s?\d+[A-Za-z]?,\s+(?:Street|St\.?|Block|Sector)\s\S"
    rf"|\d{{1,4}}[a-z]?(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours|route)\s(?:d(?:e|u|es)\s(?:la\s|l['’])?|de\sla\s|d['’])?[{_UP}{_LOW}]+"
    rf"|(?:Calle|Avenida|Avda\.|Plaza|Paseo|Camino|Carrera|C/)\s(?:de\s(?:la\s|los\s|las\s)?|del\s)?[{_UP}][{_LOW}]+(?:\s[{_UP}][{_LOW}]+)?,?\s\d{{1,4}}"
    rf"|[{_UP}][{_LOW}]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|hof|steig)\s\d{{1,4}}\s?[a-z]?(?!\w)"
    rf"|(?:Am|An\s(?:der|den)|Im|In\sder|Zum|Zur|Auf\s(?:dem|der)|Unter\sden|Hinter\sdem)\s[{_UP}][{_LOW}]+\s\d{{1,4}}[a-z]?(?=,?\s+\d{{4,5}}\s)"
    r")"
)
_STEP = re.compile(rf"(?<![\w@.+'’\-])(?:{_NAME}(?![\w@])|[{_UP}]\.(?=[ \n{_UP}]))")
_CUE = re.compile(rf"(?:(?<!\w)(?:{TITLES})\.?|(?:{LABELS})|(?:tacter|chez|par|à|de|et|que|Pourquoi|Cher)\s+M\.|(?:Dear|Hello|Hi)(?: (?:{TITLES})\.?)?)\s*(?:{TITLES})?\.?\s*$")
_CUE_WORDS = set(TITLES.lower().split("|")) | set("attn attention contact person from name candidate signed by signatory to dear hello hi m".split()) | {""}
_STRONG_TITLES = set(TITLES.split("|"))
_FRENCH_BEFORE = re.compile(r"(?:tacter|chez|par|à|de|et|que|Pourquoi|Cher)$")
_CUE_TOKENS, _TOKEN_LENGTH = 4, 24  # no cue has more or longer words
_FIRM_AFTER = re.compile(r"\s*(?:&|,? (?:and|et|und|y) (?:Sons|Partners|Co)\b)")


def _local_start(text: str, end: int) -> int | None:
    """Where the local part of an address that ends there begins."""
    at = end
    while at and _LOCAL_CHARS.match(text[at - 1]):
        at -= 1
    first = text[at : at + 1]
    return at if at < end and text[end - 1] != "." and first.isascii() and first.isalnum() else None


def _tokens_before(text: str, a: int, most: int = _CUE_TOKENS) -> str:
    """The words before a, parted by single blanks; none where a word is longer than those of any cue."""
    out: list[str] = []
    while len(out) < most:
        while a and text[a - 1].isspace():
            a -= 1
        b = a
        while a and not text[a - 1].isspace() and b - a <= _TOKEN_LENGTH:
            a -= 1
        if a == b:
            break
        out.append(text[a:b])
        if b - a > _TOKEN_LENGTH:
            break
    return " ".join(reversed(out))


def _word_before(text: str, a: int) -> str:
    """The last word before a, as _tokens_before has it; mostly in a short slice."""
    near = text[max(0, a - _TOKEN_LENGTH) : a].rsplit(None, 1)
    if len(near) == 2 or a <= _TOKEN_LENGTH:
        return near[-1] if near else ""
    return _tokens_before(text, a, 1)


def shaped(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of the mentions that have a shape, without overlaps."""
    out: list[tuple[str, int, int]] = []
    begins: list[int] = []
    ends: list[int] = []

    def add(kind: str, a: int, b: int) -> None:
        # taken stretches don't overlap, so only the last that begins before b can meet this one
        k = bisect_left(begins, b)
        if not k or ends[k - 1] <= a:
            begins.insert(k, a)
            ends.insert(k, b)
            out.append((kind, a, b))

    low = text.lower()
    if "@" in text or "＠" in text or "&#64;" in text or "at]" in low or "at)" in low or " dot " in low:
        # the signs spelt out need a bracket or the word dot
        at = _AT if "dot" in low or _AT_IN_BRACKETS.search(low) else _AT_SIGN
        for m in at.finditer(text):
            domain = _DOMAIN.match(text, m.end())
            local = _local_start(text, m.start()) if domain else None
            if local is not None:
                add("EMAIL", local, domain.end())
    for m in _LABELLED_ID.finditer(text):
        if sum(c.isdigit() for c in m.group(1)) >= 5:
            add("ID_NUMBER", m.start(1), m.end(1))
    for m in _SHAPED_ID.finditer(text):
        add("ID_NUMBER", m.start(), m.end())
    for m in _ADDRESS.finditer(text):
        add("ADDRESS", m.start(), m.end())
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15 or m.group().startswith("("):
            add("PHONE", m.start(), m.end())
    return out


def runs(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[list[str], list[int], bool, bool]]:
    """(words, starts, cue, firm) of each run of capitalised words outside other mentions.

    cue: a protected context stands before it; firm: a company's name goes on behind it.
    """
    out: list[tuple[list[str], list[int], bool, bool]] = []
    words: list[str] = []
    starts: list[int] = []
    cue = False
    last = -1
    n = len(taken)
    taken = sorted(taken, key=lambda x: x[1])
    t = 0

    def close(end: int) -> None:
        if words and (len(words) > 1 or cue):
            firm = bool(_FIRM_AFTER.match(text, end))
            low = [w.lower() for w in words]
            if cue or not all(w in FORM_WORDS or w in CORPORATE for w in low):
                out.append((words.copy(), starts.copy(), cue, firm))
        words.clear()
        starts.clear()

    for m in _STEP.finditer(text):
        a, b = m.span()
        while t < n and taken[t][2] <= a:
            t += 1
        if t < n and taken[t][1] < b:
            close(last)
            last = -1
            continue
        gap = text[last:a] if last >= 0 else None
        if not words or gap not in (" ", ", ", "\n", "\r\n"):
            close(last)
            last_word = _word_before(text, a)
            last_word = last_word[last_word.rfind("(") + 1 :]
            cue = last_word.rstrip(".:").lower() in _CUE_WORDS and bool(_CUE.search(_tokens_before(text, a)))
        w = m.group()
        if w in _STRONG_TITLES or (w == "M." and text[a - 1 : a].isspace() and _FRENCH_BEFORE.search(_word_before(text, a))):
            close(last)
            last = -1
            continue
        words.append("," + w if gap == ", " and words else w)
        starts.append(a)
        last = b
    close(last)
    return out


def names_in(words: list[str], starts: list[int], cue: bool, firm: bool, revealing) -> list[tuple[int, int]]:
    """(start, end) of the names in a run; revealing: whether a term reveals persons."""
    out: list[tuple[int, int]] = []
    i, n = 0, len(words)
    bare = [w.lstrip(",") for w in words]
    initial = [len(w) == 2 and w[1] == "." for w in bare]
    known = [not k and all(revealing(p) for p in w.lower().split("-")) for w, k in zip(bare, initial)]
    odd = [w.lower() in FORM_WORDS or w.lower() in CORPORATE for w in bare]
    while i < n:
        j = i + 1
        while j < n and initial[j] and words[j][0] != ",":
            j += 1
        first = cue and i == 0
        end = None
        if j < n and not initial[j] and not odd[j] and not odd[i]:
            company = (firm and j == n - 1) or (j + 1 < n and bare[j + 1].lower() in CORPORATE) or (j + 2 < n and bare[j + 2].lower() in CORPORATE and not known[j])
            pair = known[i] and known[j] or initial[i] and known[j] and not (j + 1 < n and known[j + 1] and words[j + 1][0] != ",")
            if not company and (pair or (first and (known[i] or known[j] or not (i + 2 < n)) and words[j][0] != ",")):
                end = j
        if end is None and first and not initial[i] and not odd[i] and (known[i] or n == 1) and not (firm and n == 1):
            end = i
        if end is None:
            i += 1
        else:
            out.append((starts[i], starts[end] + len(bare[end])))
            i = end + 1
    return out


#: Words and starts of a run are kept as one string each: arrays of strings cost more between JVM and Python than the text pass itself.
BETWEEN = "\x1f"
FOUND = "table_name string, row_key string, pii_type string, start_pos int, end_pos int, words string, starts string, cue boolean, firm boolean"


def scan(texts: DataFrame) -> DataFrame:
    """Mentions that have a shape and runs that may hold names, of (table_name, row_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, kind, start, end, words, starts, cues, firms = [], [], [], [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if not t:
                    continue
                found = shaped(t)
                for k, x, y in found:
                    take.append(i), kind.append(k), start.append(x + 1), end.append(y + 1)
                    words.append(None), starts.append(None), cues.append(None), firms.append(None)
                for w, s, c, f in runs(t, found):
                    take.append(i), kind.append("RUN"), start.append(s[0] + 1), end.append(s[-1] + len(w[-1]) + 1)
                    words.append(BETWEEN.join(w)), starts.append(",".join(map(str, s))), cues.append(c), firms.append(f)
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(rows), b.column(1).take(rows), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()),
                    pa.array(words, pa.string()), pa.array(starts, pa.string()), pa.array(cues, pa.bool_()), pa.array(firms, pa.bool_()),
                ],
                ["table_name", "row_key", "pii_type", "start_pos", "end_pos", "words", "starts", "cue", "firm"],
            )

    return texts.mapInArrow(run, FOUND)


def _terms_of(words: Column) -> Column:
    """The terms of a run in small letters, initials left out; words: an array."""
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, "^,", "")))
    return F.filter(F.flatten(F.transform(bare, lambda w: F.split(w, "-"))), lambda w: F.length(w) > 2)


def disclosure(found: DataFrame) -> DataFrame:
    """(term, n, protected, bits) of every term of the runs: how strongly it reveals a person."""
    # the surnames in a firm's name are the firm's
    firms = F.array(*(F.lit(w) for w in sorted(CORPORATE)))
    runs_ = found.filter("pii_type = 'RUN' AND NOT firm").select("cue", F.split("words", BETWEEN).alias("words")).filter(~F.arrays_overlap(F.transform("words", lambda w: F.lower(F.regexp_replace(w, "^,", ""))), firms))
    # of a run in a protected context the first words are the entity: a name has two besides initials
    whole = F.filter("words", lambda w: F.length(w) > 2)
    head = F.when(F.col("cue"), F.slice(whole, 1, 2)).otherwise(F.array().cast("array<string>"))
    terms = runs_.select(F.explode(F.concat(F.transform(_terms_of(F.col("words")), lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("protected"))),
                                            F.transform(_terms_of(head), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("protected"))))).alias("x"))
    counted = terms.groupBy("x.term").agg(F.sum("x.n").alias("n"), F.sum("x.protected").alias("protected"))
    total = counted.agg((F.sum("protected") / F.sum("n")).alias("base"))
    bits = F.log2(((F.col("protected") + 0.5) / (F.col("n") + 1.0)) / F.col("base"))
    return counted.join(F.broadcast(total)).select("term", "n", "protected", bits.alias("bits"))  # total is one row


def revealing_terms(found: DataFrame, bits: float = DISCLOSURE) -> DataFrame:
    """Terms whose disclosure is above the threshold, relative to what a term that always stands in a protected context would have."""
    d = disclosure(found)
    known = ~F.col("term").isin(sorted(FORM_WORDS | CORPORATE))
    share = (F.col("protected") + 0.5) / (F.col("n") + 1.0)
    return d.filter((F.col("protected") >= LEAST_PROTECTED) & known & ((F.col("bits") >= bits) | (share >= POSTERIOR)) & (share >= LEAST_POSTERIOR)).select("term")


def mentions(texts: DataFrame, terms_to_send: int = TERMS_TO_SEND) -> DataFrame:
    """(table_name, row_key, pii_type, start_pos, end_pos) of every mention in (table_name, row_key, text)."""
    spark = texts.sparkSession
    found = stored(scan(texts), "pii-runs")
    terms = stored(revealing_terms(found), "pii-terms")
    shapes = found.filter("pii_type <> 'RUN'").select("table_name", "row_key", "pii_type", "start_pos", "end_pos")
    candidates = found.filter("pii_type = 'RUN'").select("table_name", "row_key", "words", "starts", "cue", "firm")
    if terms.count() <= terms_to_send:
        sent = spark.sparkContext.broadcast({r[0] for r in terms.toLocalIterator()})
        rows, lookup = candidates.withColumn("known", F.lit(None).cast("array<string>")), sent
    else:
        keyed = candidates.withColumn("run", F.xxhash64("table_name", "row_key", F.col("starts")))
        hits = (
            keyed.select("table_name", "row_key", "run", F.explode(F.array_distinct(_terms_of(F.split("words", BETWEEN)))).alias("term"))
            .join(terms, "term", "left_semi")
            .groupBy("table_name", "row_key", "run")
            .agg(F.collect_set("term").alias("known"))
        )
        rows, lookup = keyed.join(hits, ["table_name", "row_key", "run"], "left").drop("run"), None

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, start, end = [], [], []
            c = [b.column(k).to_pylist() for k in range(2, 7)]
            for i, (words, starts, cue, firm, known) in enumerate(zip(*c)):
                reveal = lookup.value.__contains__ if lookup is not None else set(known or ()).__contains__
                for x, y in names_in(words.split(BETWEEN), list(map(int, starts.split(","))), cue, firm, reveal):
                    take.append(i), start.append(x + 1), end.append(y + 1)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(["NAME"] * len(take), pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                ["table_name", "row_key", "pii_type", "start_pos", "end_pos"],
            )

    rows = rows.select("table_name", "row_key", "words", "starts", "cue", "firm", "known")
    names = rows.mapInArrow(decide, "table_name string, row_key string, pii_type string, start_pos int, end_pos int")
    return shapes.unionByName(names)


def redacted(texts: DataFrame, found: DataFrame) -> DataFrame:
    """texts with every mention replaced by its type in square brackets, in the column text_redacted."""
    spots = found.groupBy("table_name", "row_key").agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos", "pii_type"))).alias("spots"))
    text = F.col("text")
    fold = F.aggregate(
        F.coalesce(F.col("spots"), F.array().cast("array<struct<start_pos:int,end_pos:int,pii_type:string>>")),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, s: F.when(s["start_pos"] < acc["at"], acc).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(text, acc["at"], s["start_pos"] - acc["at"]), F.lit("["), s["pii_type"], F.lit("]")).alias("out"),
                s["end_pos"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"], F.length(text))),
    )
    # of one key both sides share a task, where repeated rows are dropped too
    return texts.join(spots, ["table_name", "row_key"], "left").withColumn("text_redacted", fold).drop("spots")


def labelled(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(table_name, row_key, text) of several (name, table, key column, text column)."""
    parts = [t.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col(text).cast("string").alias("text")) for name, t, key, text in tables]
    return reduce(DataFrame.unionByName, parts)

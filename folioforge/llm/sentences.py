"""Sentence units of texts in any script.

A text is parted into blocks at blank lines. In a block made up of headings,
"label: value" lines and list items every line is a unit. In other blocks line
breaks are white space and the sentence-break rules on character properties
apply: every character with the property Sentence_Terminal ends a sentence
unless the rules find that it goes on (a small letter, a comma or a colon
follows), that the full stop belongs to an abbreviation, an initial, an ordinal
or a number, or that it stands within quotation marks or brackets. Terminators,
brackets and what may close a sentence come from the character properties, not
from lists; abbreviations are listed by language, and all lists hold for every
text, since documents mix languages and their codes are unsure. After a closing quotation mark the
sentence ends where the quotation ended with a terminator and no continuation
follows; after a closing bracket only where the bracket opened the sentence. In
Thai, white space between two Thai letters parts sentences.

Defined results: null, empty and blank texts have no units; positions are
1-based and count code points; repeated rows give repeated units. Each block is
read in time proportional to its length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EVERY = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
# Terminators of scripts with small letters, and ellipses; a small letter after them continues the sentence.
SOFT = ".!?…‼⁇⁈⁉⋯‽⸮⸼"
#: Full stops that may belong to a number or an abbreviation.
STOPS = "".join(regex.findall(r"\p{Sentence_Break=ATerm}", _EVERY))
SOFT += "".join(c for c in STOPS if c not in SOFT)
#: All other characters with the property Sentence_Terminal end a sentence whatever follows.
STRONG = "".join(c for c in regex.findall(r"\p{Sentence_Terminal}", _EVERY) if c not in SOFT)
_STRONG, _TERMINATORS = frozenset(STRONG), frozenset(STRONG + SOFT)
# Quotation marks and what closes them.
QUOTES = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "‘": "’", "‚": "‘’", '"': '"', "”": "“", "'": "'"}
#: Brackets: opening punctuation that is mirrored, with the closing one of the next code or the next but one.
BRACKETS = {
    c: d
    for c in regex.findall(r"\p{Ps}", _EVERY)
    if c not in QUOTES and unicodedata.mirrored(c)
    for d in [next((d for d in (chr(ord(c) + 1), chr(ord(c) + 2)) if unicodedata.category(d) == "Pe"), None)]
    if d
}
CLOSERS = {*BRACKETS.values(), *"”“»›」』’\"'"}
GOES_ON = set(",;:،؛、，；：)]}）］】）»›」』/–—‐-")

# Abbreviations that never end a sentence, by language.
ABBREVIATIONS = {
    "en": "mr mrs ms dr prof messrs st rev hon capt col gen lt sgt vs viz cf approx incl excl e.g i.e eg ie sec fig figs app art ch vol pp p ed eds est ext tel dept encl ref resp".split(),
    "de": "hr hrn fr dipl ing z.b d.h u.a o.ä u.u z.t i.d.r bzw ca ggf inkl exkl zzgl gem abs vgl evtl abzgl str bspw sog insb s".split(),
    "fr": "m mm mme mlle env art chap av bd éd".split(),
    "es": "sr sra srta dra d dña ud uds aprox ej pág págs núm avda c p.ej".split(),
    "hi": "डॉ श्री पं प्रो कु".split(),
}
NEVER = {w for words in ABBREVIATIONS.values() for w in words}
# Abbreviations that a figure follows; they don't end a sentence then.
BEFORE_FIGURE = set("no nos nr nrn núm num n art sec fig p pp ch vol lot ref §".split())
# Abbreviations that end a sentence where a capital follows.
MAY_END = set(
    """inc ltd corp co llc plc llp gmbh sarl bros etc jr sr a.m p.m am pm b.sc m.sc ph.d b.a m.a usw u.s.w etw
    jan feb mar apr jun jul aug sep sept oct nov dec okt dez mai""".split()
)
MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec okt dez".split())
# Words that begin sentences and are no names.
STARTERS = set(
    """the a an it its this that these those he she we they you i there here who what when where why how which our your his her their
    if in on at by for from as after before only all no not nobody any each every and but or so yet see ask please according one
    upload payment delivery storage version is are was were do does did
    die der das ein eine einen wer was warum wie wann wo unser unsere am im bitte alle frau
    le la les l un une des ce cette il elle nous vous ils pourquoi qui quelle quel selon notre nos
    el los las una uno este esta nuestro nuestra quién por""".split()
)
# German words before an ordinal, and words after one.
BEFORE_ORDINAL = set("am vom zum beim im ab bis der den dem des das die jeder jeden seit".split())
AFTER_ORDINAL = set(
    "januar jänner februar märz april mai juni juli august september oktober november dezember quartal jahrhundert stock halbjahr".split()
)
# Characters after a Chinese quotation that continue its sentence.
ZH_ON = set("的说道问喊答是和与")

_END_OF_LINE = r"(?:\r\n|[\r\n \x85])"
_BLANK = re.compile(rf"{_END_OF_LINE}(?:[^\S\r\n \x85]*{_END_OF_LINE})+| ")
_LINE = re.compile(r"\r\n|[\r\n \x85]")
_ITEM = re.compile(r"(?:[-–—*•·‣▪◦●○■□➤→✓]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])\s+\S")
_LABEL = re.compile(r"[^\W\d_][^:：\n]{0,34}?\s?:\s+(?![\"“„«”'‘])\S|[^\W\d_][^:：\n]{0,34}:$")
_ENDS = re.compile(rf"[{re.escape(STRONG + SOFT)}][{re.escape(''.join(sorted(CLOSERS)))}]*$")
_OPEN = "".join(map(re.escape, {**BRACKETS, **QUOTES}))
_EVENT = re.compile(rf"[{re.escape(STRONG + SOFT)}{_OPEN}]")
_THAI = re.compile("[\u0e00-\u0e7f]")
_EVENT_OR_THAI = re.compile(rf"[{re.escape(STRONG + SOFT)}{_OPEN}]|(?<=[\u0e00-\u0e7f])\s+(?=[\u0e00-\u0e7f])")
_LONGEST = max(map(len, NEVER | BEFORE_FIGURE | MAY_END | BEFORE_ORDINAL))
_NEXT_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s*")


def _structured(lines: list[str]) -> bool:
    """Whether a block is made up of headings, label lines and list items."""
    for s in lines:
        # a capital with a point may also be an initial or a title, which begins prose of several sentences
        if _ITEM.match(s) and not (s[0].isupper() and s[1] == "." and len(_sentences(s, 0, len(s))) > 1):
            continue
        if _LABEL.match(s) and len(s.split(":", 1)[0].split()) <= 4:
            continue
        if len(s) <= 60 and not _ENDS.search(s) and len(s.split()) <= 8 and (s[0].isupper() or not s[0].isalpha()) and s[-1] not in ",;-‐" and len(lines) > 1:
            if all(_heading(x) for x in s.split()):
                continue
            return False
        return False
    return True


def _heading(word: str) -> bool:
    """A word as it stands in titles: a capital or no letter first, or a short function word."""
    return not word[0].isalpha() or word[0].isupper() or len(word) <= 3


class Pairs:
    """What closes the brackets and quotation marks of a block; each kind is looked through once."""

    def __init__(self, text: str, a: int, end: int) -> None:
        self.text, self.a, self.end = text, a, end
        self.closed: dict[str, dict[int, int]] = {}
        self.ahead: dict[str, int] = {}

    def of(self, i: int) -> int:
        """The index of what closes the bracket or quotation that opens at i, -1 where nothing opens or closes; asked for rising i."""
        text, end = self.text, self.end
        c = text[i]
        if c in BRACKETS:
            if c not in self.closed:
                self.closed[c] = self._matched(c, BRACKETS[c])
            return self.closed[c].get(i, -1)
        before = text[i - 1] if i else " "
        after = text[i + 1] if i + 1 < end else " "
        if c == "»" or c == "”":
            if not (before.isspace() or before in ":：،") or after.isspace():
                return -1
        if c in "'‘‚" and (before.isalnum() or not (after.isalnum() or after in "¿¡")):
            return -1
        return self._next(c, i + 1)

    def _matched(self, opens: str, shuts: str) -> dict[int, int]:
        out, stack = {}, []
        for m in re.finditer(f"[{re.escape(opens + shuts)}]", self.text[self.a : self.end]):
            if m.group() == opens:
                stack.append(m.start())
            elif stack:
                out[stack.pop() + self.a] = m.start() + self.a
        return out

    def _next(self, c: str, start: int) -> int:
        """The first place from start that closes the quotation mark c; the end where none is left is kept."""
        at = self.ahead.get(c, 0)
        if 0 <= at < start:
            text, end = self.text, self.end
            at = start
            while (at := min((j for m in QUOTES[c] if (j := text.find(m, at, end)) >= 0), default=-1)) >= 0:
                # an apostrophe closes nothing
                if c not in "'‘‚" or not (at + 1 < end and text[at + 1].isalnum()) and not text[at - 1].isspace():
                    break
                at += 1
            self.ahead[c] = at
        return at


def _word_before(text: str, a: int, i: int) -> str:
    """The word that ends before i, in small letters, with the points inside it; longer ones than any abbreviation may lack their first parts."""

    def letters(k: int) -> int:
        while k > a and (text[k - 1].isalpha() or "ऀ" <= text[k - 1] <= "ॿ"):
            k -= 1
        return k

    s = letters(i)
    most = i - s + _LONGEST
    while s < i and text[s].isalpha() and s - 1 > a and text[s - 1] == "." and i - s <= most and (k := letters(s - 1)) < s - 1:
        s = k
    while s < i and not text[s].isalpha():
        s += 1
    return text[s:i].lower()


def _hiragana(c: str) -> bool:
    return "ぁ" <= c <= "ゟ"


def _ends(text: str, a: int, i: int, j: int, k: int, quoted: bool) -> bool:
    """Whether a sentence ends after text[i:j], terminators of the block that starts at a, when text[k] follows."""
    nxt = text[k]
    run = text[i:j]
    if nxt in GOES_ON:
        if nxt not in "-–—" or quoted or k + 1 >= len(text) or not (text[k + 1].isspace() and run[-1] in "!?"):
            return False
    if nxt.islower():
        return False
    last = run[-1]
    if last in _STRONG or (len(run) > 1 and run[0] in _STRONG):
        return True
    gap = k > j
    letter = nxt.isalpha()
    if last != "." or len(run) > 1:
        # ! ? and ellipses
        if not gap and not letter and nxt not in "¿¡“«„「\"'(":
            return False
        return not (set(run) <= {".", "…", "⋯"} and nxt.isdigit())
    before = text[i - 1] if i > a else " "
    if before.isspace():
        return False
    word = _word_before(text, a, i)
    if not gap:
        if not (letter or nxt in "¿¡“«„「"):
            return False
        if word in ("a.m", "p.m"):
            return True
        if "." in word:
            return False
        if nxt.isupper() or nxt in "¿¡“«„「":
            return (before.islower() and len(word) > 1 and not (word in NEVER)) or before.isdigit() or before in CLOSERS or before == "%" or (before.isalpha() and not before.isupper() and len(word) > 1) or word in MAY_END or (len(word) >= 3 and word not in NEVER)
        return before.isalpha() and not before.islower() and not before.isupper() and word not in NEVER and len(word) > 1
    if not word:
        if before.isdigit():
            return not _ordinal(text, a, i, k)
        return True
    if word in BEFORE_FIGURE and (nxt.isdigit() or nxt in "#§"):
        return False
    if word in NEVER:
        return False
    if len(word) == 1 and text[i - 1].isupper() or (len(word) == 1 and word not in "y"):
        return _starter(text, k) and not _initial(text, a, i - 1)
    if word in MAY_END:
        return not (nxt.isdigit() and word in MONTHS)
    if "." in word:
        tail = word.rsplit(".", 1)[1]
        if len(tail) == 1:
            return _starter(text, k)
    return True


def _starter(text: str, k: int) -> bool:
    m = _NEXT_WORD.match(text, k)
    return bool(m) and m.group().lower() in STARTERS or text[k] in "¿¡"


# Titles before an initial.
TITLES = {"Mr", "Mrs", "Ms", "Dr", "Prof", "M", "Hr", "Sr", "Sra"}


def _initial(text: str, a: int, at: int) -> bool:
    """Whether another initial or a title stands before the letter at."""
    while at > a and text[at - 1].isspace():
        at -= 1
    if at <= a or text[at - 1] != ".":
        return False
    s = at - 1
    while s > a and at - 1 - s < 6 and (text[s - 1].isalnum() or text[s - 1] == "_"):
        s -= 1
    word = text[s : at - 1]
    return len(word) == 1 and "A" <= word <= "Z" or word in TITLES


def _ordinal(text: str, a: int, i: int, k: int) -> bool:
    """Whether the full stop after a figure marks an ordinal."""
    s = i
    while s > a and text[s - 1].isdigit() and i - s <= 2:
        s -= 1
    if i - s > 2:
        return False
    m = _NEXT_WORD.match(text, k)
    if m and m.group().lower() in AFTER_ORDINAL:
        return True
    if s == a:
        return True
    while s > a and text[s - 1].isspace():
        s -= 1
    return _word_before(text, a, s) in BEFORE_ORDINAL


def _continues(text: str, k: int, shut: str) -> bool:
    """Whether what follows a quotation continues its sentence, for scripts without capitals."""
    c = text[k]
    if shut in "」』" and _hiragana(c):
        return True
    return c in ZH_ON


def _sentences(text: str, a: int, b: int) -> list[int]:
    """The starts of the sentences of the prose block text[a:b]."""
    out = [a]
    pos = a
    start = a
    pairs = Pairs(text, a, b)
    event = (_EVENT_OR_THAI if _THAI.search(text, a, b) else _EVENT).search
    while (m := event(text, pos, b)) is not None:
        i, j = m.span()
        c = text[i]
        if c.isspace():
            out.append(j)
            start = pos = j
            continue
        if c in BRACKETS or c in QUOTES:
            shut = pairs.of(i)
            if shut < 0:
                pos = j
                continue
            # the last visible character inside
            t = shut - 1
            while t > i and (text[t].isspace() or text[t] in CLOSERS):
                t -= 1
            j = shut + 1
            pos = j
            if text[t] in _TERMINATORS:
                k = _SPACE.match(text, j, b).end()
                if k >= b:
                    break
                if text[k] in _TERMINATORS:
                    continue
                if c in BRACKETS and i != start:
                    continue
                if not text[k].islower() and text[k] not in GOES_ON and not _continues(text, k, text[shut]):
                    out.append(k)
                    start = pos = k
            continue
        while j < b and text[j] in _TERMINATORS:
            j += 1
        # a run of terminators, with closing marks of nothing open behind it
        end = j
        while end < b and text[end] in "”»’」』" and not text[end].isspace():
            end += 1
        k = _SPACE.match(text, end, b).end()
        if k >= b:
            break
        pos = end
        if _ends(text, a, i, j, k, end > j) if end == j else not text[k].islower() and text[k] not in GOES_ON:
            out.append(k)
            start = pos = k
    return out


def unit_starts(text: str) -> list[int]:
    """The 0-based starts of all units."""
    out: list[int] = []
    n = len(text)
    edges = [0]
    for m in _BLANK.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(n)
    for a, b in zip(edges[::2], edges[1::2]):
        a = _SPACE.match(text, a, b).end()
        while b > a and text[b - 1].isspace():
            b -= 1
        if a >= b:
            continue
        block = text[a:b]
        if _LINE.search(block):
            marks = [a, *(m.end() + a for m in _LINE.finditer(block)), b]
            lines = [(x, s) for x, y in zip(marks, marks[1:]) if (s := text[x:y].strip())]
            if _structured([s for _, s in lines]):
                out += [_SPACE.match(text, x, b).end() for x, _ in lines]
                continue
        elif _structured([block]):
            out.append(a)
            continue
        out += _sentences(text, a, b)
    return out


def sentence_units(df: DataFrame, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """(key, start_pos) of every unit in order; with_text adds unit_index and unit."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, pos, index, units = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                starts = unit_starts(t)
                take += [i] * len(starts)
                pos += starts
                if with_text:
                    index += range(len(starts))
                    units += [t[x:y].strip() for x, y in zip(starts, [*starts[1:], len(t)])]
            out = [b.column(0).take(pa.array(take, pa.int64())), pa.array([p + 1 for p in pos], pa.int32())]
            if with_text:
                out += [pa.array(index, pa.int32()), pa.array(units, pa.string())]
            yield pa.RecordBatch.from_arrays(out, [key, "start_pos", "unit_index", "unit"][: len(out)])

    schema = f"`{key}` {kind}, start_pos int" + (", unit_index int, unit string" if with_text else "")
    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)

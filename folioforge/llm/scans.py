"""Noise of scanned pages: found, and repaired into continuous paragraphs.

One pass over the texts notes, of each text, what may be noise (words divided
at line ends, words with odd characters or with pairs of letters that scanning
confuses, lines that look like page furniture) and counts the plain words of
all texts.

Misread words meet the words that the corpus knows by a form in which all
characters that are misread for one another are the same, in one join; no
spellings are enumerated, so words with any number of misread characters are
found. An averaged perceptron over characters, trained on words of the corpus
that are spoilt on purpose, then decides: each way from the noted word to the
known one is a sequence of keep, replace, delete and insert, scored on the
characters around and on how often the corpus has either word, and the word is
corrected where the best edits score above keeping it. The same perceptron
decides for each divided word whether to join its lines, from the letters at the
break, the kind of break and which of the parts are known.

Furniture is told by a second averaged perceptron on the place of a line on its
page and its shape, trained on a sample of pages; a running header also has to
stand on several pages: in several chunks of a document or several times in a
preview, which has no lines.

The perceptrons learn from TRAIN_WORDS words and TRAIN_PAGES pages (of up to
PAGE_CHARS characters, so the sample has a bounded size) at most;
counts, candidates and decisions cover all texts. Nothing that grows with the
corpus is collected.

Defined results: null and empty texts have no noise; repeated rows give each
kind once; texts are read whole.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import stored

TRAIN_WORDS, TRAIN_PAGES, PAGE_CHARS, ROUNDS, SEED = 1200, 2000, 20_000, 3, 7
LEAST_KNOWN = 3  # a correction must be a word that occurs so often
RARER = 4  # in training, spoilt words are so many times rarer than what they were
EVIDENCE = 4.0  # value of a feature on how often words occur, beside 1 of one on characters
MARGIN = 10.0  # by which the right edit has to lead in training
SALTS = 16  # parts of the occurrences of one word
WORDS_HELD = 400_000  # distinct words counted in a task before they are passed on

# What scanned letters are misread as.
SPOILT = {"fi": ["\ufb01"], "fl": ["\ufb02"], "ff": ["\ufb00"], "e": ["€"], "i": ["1", "!"], "l": ["1", "|"], "o": ["0"], "s": ["5", "$"], "g": ["9"], "b": ["8"], "d": ["cl"], "m": ["rn"], "w": ["vv"]}
# Words that follow a hyphen which stands for a left-out part.
SUSPENDED = set("and or und oder to bis et ou y o e bzw nor as".split())

READ_AS: dict[str, list[str]] = defaultdict(list)
for _letter, _forms in SPOILT.items():
    for _form in _forms:
        READ_AS[_form].append(_letter)
PAIRS = [f for f in READ_AS if len(f) == 2]
FIRST = re.compile("l[bcdfghjkmnpqrstvwxz]")  # a capital I that was read as a small l begins so
_ODD = "".join(f for f in READ_AS if len(f) == 1)

_L = "a-zà-öø-ÿ"
_WORDS = re.compile(rf"(?<![\w@.€!|$])[{_L}]{{2,}}(?![\w@€|$])")
_ODD_WORD = re.compile(rf"(?<![^\s(\[“„«\"'])[{_L}{re.escape(_ODD)}]*[{re.escape(_ODD)}][{_L}{re.escape(_ODD)}]*(?=[\s.,;:)\]”“»\"'?-‐­]|$)")
_DIVIDED = re.compile(rf"([{_L}{re.escape(_ODD)}]{{2,}})([-‐­])([ \t]*\r?\n\s*|[ \t ]+)([{_L}{re.escape(_ODD)}]{{2,}})")
_ANY_WORD = re.compile(rf"[\w{re.escape(_ODD)}]+")
_NUMBER_WORD = r"(?:page|p\.|p|seite|s\.|página|pagina|pág\.|pag\.|blatt|sheet)"
_PAGE_LINE = re.compile(rf"[–—\-\[(·•*|]*\s*(?:{_NUMBER_WORD}\s*)?\d{{1,5}}(?:\s*(?:of|von|de|sur|di|/)\s*\d{{1,5}})?\s*[–—\-\])·•*|]*", re.I)
_PAGE_SURE = re.compile(
    r"(?<!\S)(?:(?:Page|Seite|Página|Blatt)\s\d{1,5}\s(?:of|von|de|sur|/)\s\d{1,5}|(?:PAGE|SEITE|PÁGINA)\s\d{1,5}(?:\s(?:OF|VON|DE|/)\s\d{1,5})?|[–—]\s\d{1,5}\s[–—]|-\s\d{1,5}\s-|\[\d{1,5}\])(?!\S)"
)
_PAGE_MAYBE = re.compile(r"(?<!\S)(?:(?:Page|Seite|Página|Blatt|p\.)\s\d{1,5}|(\d{1,3})/(\d{1,3}))(?!\S)")
_MENTION = re.compile(r"\b(?:see|cf\.?|siehe|vgl\.?|voir|véase|file|no\.?|nr\.?)$", re.I)
_BARS = re.compile(r"\s*[|·•]\s*|\s+[-–—]\s+|\s{3,}|\t+")
_PLAIN = str.maketrans({"0": "o", "1": "l", "i": "l", "!": "l", "5": "s", "€": "e", "8": "b", "|": "l", "9": "g"})


def header_key(line: str) -> str | None:
    """The form in which a line that may be a running header is compared; None for a line of text, a table row or a label."""
    s = line.strip()
    if len(s) < 8 or s[-1] in ".!?;,:" or ":" in s:
        return None
    cells = [x for x in _BARS.split(s) if x]
    if sum(not any(c.isalpha() for c in x) for x in cells) >= 2:
        return None
    words = [w for w in s.split() if w[0].isalpha()]
    if len(words) < 3:
        return None
    capital = sum(w[0].isupper() for w in words) / len(words)
    if not (len(cells) >= 3 or (len(cells) == 2 and capital >= 0.5) or capital >= 0.8):
        return None
    return re.sub(r"[^\w]+", " ", " ".join(cells).lower().translate(_PLAIN)).strip()


def repeated_header(text: str) -> list[tuple[int, int]]:
    """(start, end) of sequences of words that stand in a text several times and look like a running header.

    Sequences of 4, 8, 16, ... words get numbers, equal ones the same; so of each start the next places
    that share so many words with it are known, and each common stretch is measured in a few steps.
    """
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    count = len(tokens)
    if count < 8:
        return []
    parts = [text[a:b] for a, b in tokens]
    norm = ["|" if x in ("|", "·", "•", "-", "–", "—") else x.lower().translate(_PLAIN) for x in parts]
    levels: list[tuple[int, list[int], dict[int, list[int]]]] = []
    size = 4
    keys: list = [tuple(norm[i : i + 4]) for i in range(count - 3)]
    while keys:
        number: dict = {}
        rank = [number.setdefault(k, len(number)) for k in keys]
        places: dict[int, list[int]] = defaultdict(list)
        for i, r in enumerate(rank):
            places[r].append(i)
        if len(places) == len(rank):
            break
        levels.append((size, rank, places))
        keys = [(rank[i], rank[i + size]) for i in range(len(rank) - size)]
        size *= 2
    if not levels:
        return []
    total = [[0] for _ in range(4)]
    for x, y in zip(parts, norm):
        word = x[0].isalpha()
        for t, yes in zip(total, (word, word and x[0].isupper(), word and x.isupper(), y == "|")):
            t.append(t[-1] + yes)
    word_at = [i for i, x in enumerate(parts) if x[0].isalpha()]

    def common(i: int, j: int) -> int:
        n = 0
        for size, rank, _ in reversed(levels):
            while j + n < len(rank) and rank[i + n] == rank[j + n] and i + n + size <= j:
                n += size
        while i + n < j and j + n < count and norm[i + n] == norm[j + n]:
            n += 1
        return n

    out: list[tuple[int, int]] = []
    done = 0
    for i in range(len(levels[0][1])):
        if i < done:
            continue
        tried = set()
        for size, rank, places in reversed(levels):
            if i >= len(rank):
                continue
            others = places[rank[i]]
            found = None
            for least in (i + 4, i + size):
                at = bisect_left(others, least)
                if at == len(others) or others[at] in tried:
                    continue
                j = others[at]
                tried.add(j)
                n = common(i, j)
                words, capital, upper, bars = (t[i + n] - t[i] for t in total)
                first = bisect_left(word_at, i)
                loud = words >= 4 and upper >= 4 and not any(parts[k].islower() for k in word_at[first : first + 4])
                if words >= 3 and (bars >= 2 and capital * 2 >= words or loud):
                    found = j, n
                    break
            if found:
                out += [(tokens[k][0], tokens[k + found[1] - 1][1]) for k in (i, found[0])]
                done = i + found[1]
                break
    return sorted(set(out))


def page_lines(text: str, furniture: Furniture | None = None) -> list[tuple[int, int]]:
    """(start, end) of lines that hold nothing but a page number."""
    out = []
    at = 0
    lines = text.split("\n")
    places = None
    for k, line in enumerate(lines):
        s = line.strip()
        if s and (s[-1].isdigit() or s[-1] in "–—-])·•*| ") and _PAGE_LINE.fullmatch(s):
            places = places or line_places(lines)
            if furniture is None or furniture.says(s, places[k]):
                out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def line_places(lines: list[str]) -> list[str]:
    """Where each line stands on its page, blank ones not counted."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    out = ["blank"] * len(lines)
    for n, k in enumerate(full):
        back = len(full) - 1 - n
        out[k] = "alone" if len(full) == 1 else f"top {n}" if n < 2 and n <= back else f"foot {back}" if back < 2 else "body"
    return out


def page_marks(text: str) -> list[tuple[int, int]]:
    """(start, end) of page numbers that stand inside running text without belonging to its sentence."""
    sure = [m.span() for m in _PAGE_SURE.finditer(text)]
    starts = [a for a, _ in sure]
    out = list(sure)
    for m in _PAGE_MAYBE.finditer(text):
        counted = m.group(1) is None or 1 <= int(m.group(1)) <= int(m.group(2))
        if not counted:
            continue
        k = bisect_left(starts, m.end()) - 1  # the last sure one that starts before the end
        if k >= 0 and sure[k][1] > m.start():
            continue
        at = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        if not _MENTION.search(text, max(0, at - 8), at):
            out.append(m.span())
    return sorted(out)


class Perceptron:
    """An averaged perceptron over (feature, label)."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, feats: list[str], label: str) -> float:
        g = self.weights.get
        return sum(g((f, label), 0.0) for f in feats)

    def fit(self, samples: list[tuple[list[str], list[str], str]]) -> None:
        """samples: (features, labels to choose from, the right one)."""
        rng = random.Random(SEED)
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        n = 0
        for _ in range(ROUNDS):
            rng.shuffle(samples)
            for feats, options, gold in samples:
                n += 1
                best = max(options, key=lambda o: (self.score(feats, o), o[:4] != "keep"))
                if best != gold:
                    for f in feats:
                        for label, by in ((gold, 1.0), (best, -1.0)):
                            k = (f, label)
                            total[k] += (n - stamp[k]) * self.weights.get(k, 0.0)
                            stamp[k] = n
                            self.weights[k] = self.weights.get(k, 0.0) + by
        self.weights = {k: a for k, v in self.weights.items() if (a := (total[k] + (n + 1 - stamp[k]) * v) / (n + 1))}


class Furniture(Perceptron):
    """Tells page furniture from text by the place of a line on its page and by its shape."""

    @staticmethod
    def features(s: str, place: str) -> list[str]:
        words = [w for w in s.split() if w[0].isalpha()]
        capital = sum(w[0].isupper() for w in words) * 4 // max(1, len(words))
        number = _PAGE_LINE.fullmatch(s) is not None
        shape = f"{'number' if number else 'words'} bars {min(3, len(_BARS.split(s)))} capital {capital}"
        return ["at " + place, "is " + shape, f"{place} {shape}", f"end {s[-1] if not s[-1].isalnum() else 'a'}", f"long {min(6, len(s) // 20)}", f"words {min(6, len(words))}", f"label {':' in s}"]

    def train(self, pages: list[tuple[str, str, str]]) -> Furniture:
        """Learns from (document, page, text): lines that stand on several pages, or alone hold a page number, are furniture."""
        on: dict[tuple[str, str], set[str]] = defaultdict(set)
        split = [(doc, page, text.split("\n")) for doc, page, text in pages]
        for doc, page, lines in split:
            for line in lines:
                if key := header_key(line):
                    on[doc, key].add(page)
        samples = []
        for doc, _, lines in split:
            for line, place in zip(lines, line_places(lines)):
                if s := line.strip():
                    key = header_key(s)
                    yes = len(on[doc, key]) > 1 if key else _PAGE_LINE.fullmatch(s) is not None
                    if key is None or yes:
                        samples.append((self.features(s, place), ["keep", "furniture"], "furniture" if yes else "keep"))
        self.fit(samples)
        return self

    def says(self, s: str, place: str) -> bool:
        f = self.features(s, place)
        return self.score(f, "furniture") >= self.score(f, "keep")


#: Letters in a form in which all that is misread for one another is the same.
_ONE_FORM = {"m": "rn", "w": "vv", "d": "cl", "\ufb01": "fl", "\ufb02": "fl", "\ufb00": "ff"}
_ONE_FROM, _ONE_TO = "i1!|0$598€", "lllloss" + "gbe"


def one_form(w: Column) -> Column:
    """Equal for a word and for whatever it may be misread as, character by character."""
    for a, b in _ONE_FORM.items():
        w = F.replace(w, F.lit(a), F.lit(b))
    return F.translate(w, _ONE_FROM, _ONE_TO)


class Editor(Perceptron):
    """Decides on edits of the characters of a word, and on joining a divided one."""

    @staticmethod
    def features(w: str, i: int) -> list[str]:
        p = f"^^{w}$$"
        j = i + 2
        a, b, c, d, e = p[j - 2], p[j - 1], p[j], p[j + 1], p[j + 2]
        return ["0" + c, "1" + b + c, "2" + c + d, "3" + b + c + d, "4" + a + b + c, "5" + c + d + e]

    @staticmethod
    def evidence(own: int, known: int) -> list[str]:
        """How often the corpus has the word as it stands, and as edited."""
        ratio = known / max(own, 0.75)
        step = -1 if ratio < 1 else min(8, int(ratio).bit_length() - 1)
        return [f"ratio {step}", f"own {min(own, 1)} ratio {step}", "known" if known >= LEAST_KNOWN else "unknown"]

    @staticmethod
    def choices(w: str, i: int) -> list[str]:
        """The edits of a character: keep it, replace it, replace it and insert another, or replace it and delete the next."""
        out = ["keep"]
        out += [f"replace {x}" if len(x) == 1 else f"replace {x[0]} insert {x[1]}" for x in READ_AS.get(w[i], ())]
        if i == 0 and FIRST.match(w):
            out.append("replace i")
        if i + 1 < len(w):
            out += [f"replace {x} delete" for x in READ_AS.get(w[i : i + 2], ())]
        return out

    @staticmethod
    def made(w: str, i: int, edit: str) -> str:
        """The word after one edit."""
        e = edit.split()
        return w[:i] + e[1] + (e[3] if e[2:3] == ["insert"] else "") + w[i + (2 if e[-1] == "delete" else 1) :]

    def gain(self, w: str, i: int, edit: str, own: int, known: int) -> float:
        """By how much an edit scores above keeping the character."""
        f, e = self.features(w, i), self.evidence(own, known)
        return self.score(f, edit) - self.score(f, "keep") + EVIDENCE * (self.score(e, "edit") - self.score(e, "keep"))

    def correction(self, w: str, word: str, own: int, known: int) -> float | None:
        """The gain of the best edits that lead from w to word; None where none do. Odd characters must be edited."""
        # at each character of w: characters of the word made so far -> gain
        rows: list[dict[int, float]] = [{0: 0.0}] + [{} for _ in w]
        for i, c in enumerate(w):
            for at, gain in rows[i].items():
                for edit in self.choices(w, i):
                    if edit == "keep":
                        if c in READ_AS or word[at : at + 1] != c:
                            continue
                        new, size, more = c, 1, 0.0
                    else:
                        e = edit.split()
                        new, size = e[1] + (e[3] if e[2:3] == ["insert"] else ""), 2 if e[-1] == "delete" else 1
                        if not word.startswith(new, at):
                            continue
                        more = self.gain(w, i, edit, own, known)
                    k, there = at + len(new), rows[i + size]
                    if k not in there or there[k] < gain + more:
                        there[k] = gain + more
        return rows[len(w)].get(len(word))

    def corrections(self, w: str) -> list[str]:
        """Every spelling that edits of a word make, by falling gain; for looking at the editor, texts need none of it."""
        rows: list[dict[str, float]] = [{"": 0.0}] + [{} for _ in w]
        for i, c in enumerate(w):
            for edit in self.choices(w, i):
                if edit == "keep" and c in READ_AS:
                    continue
                new = c if edit == "keep" else self.made(w, i, edit)[i : len(self.made(w, i, edit)) - len(w) + i + (2 if edit.endswith("delete") else 1)]
                gain = 0.0 if edit == "keep" else self.gain(w, i, edit, 0, LEAST_KNOWN)
                there = rows[i + (2 if edit.endswith("delete") else 1)]
                for done, so_far in rows[i].items():
                    there[done + new] = max(there.get(done + new, float("-inf")), so_far + gain)
        return sorted((x for x in rows[len(w)] if x != w), key=lambda x: (-rows[len(w)][x], x))

    @staticmethod
    def break_features(left: str, right: str, known: tuple[bool, bool, bool], sure: bool, spoilt: bool = False) -> list[str]:
        """Of a word divided at a line end: the letters at the break, the kind of break, and whether left, right and whole are known words."""
        k = "".join("01"[x] for x in known)
        at = "sure " if sure else "blank "
        whole = "whole" if known[2] or spoilt else "none"
        return ["l" + left[-2:], "r" + right[:2], "b" + left[-1] + right[0], at + "k" + k, at + whole, at + whole + "p" + k[:2]]

    def joins(self, left: str, right: str, known: tuple[bool, bool, bool], sure: bool, spoilt: bool = False) -> bool:
        """Whether the parts of a divided word are to be joined."""
        f = self.break_features(left, right, known, sure, spoilt)
        return self.score(f, "join") > self.score(f, "keep break")

    def train(self, words: dict[str, int] | list[str]) -> Editor:
        """Learns from plain words, with how often they occur, and from their forms spoilt on purpose."""
        counts = words if isinstance(words, dict) else dict.fromkeys(words, 20)
        # words of the sample that are spoilt themselves teach nothing
        listed = [w for w in counts if all(counts.get(self.made(w, i, o), 0) < RARER * counts[w] for i in range(len(w)) for o in self.choices(w, i)[1:])]
        rng = random.Random(SEED)
        # what the counts alone say, whatever the letters; a small sample holds few words to learn it from
        edits: list[tuple[list[str], list[str], list[str], str]] = [
            ([], self.evidence(own, known), ["keep", "edit"], "edit" if known >= LEAST_KNOWN and known >= RARER * own else "keep")
            for own in (0, 1, 2, 3, 5, 9, 17, 40, 100)
            for known in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 36, 50, 70, 100, 160, 240, 400, 1000)
        ]
        two = ["join", "keep break"]
        breaks: list[tuple[list[str], list[str], str]] = [
            (self.break_features("  ", "  ", (x, y, whole), sure, spoilt)[3:], two, "join" if whole or spoilt or (sure and not x and not y) else "keep break")
            for x in (False, True)
            for y in (False, True)
            for whole in (False, True)
            for spoilt in (False, True)
            for sure in (False, True)
            if whole or spoilt or x == y or not sure
        ]
        for w in listed:
            spots = [i for i in range(len(w)) if w[i] in SPOILT or w[i : i + 2] in SPOILT]
            for _ in range(2):
                if spots:
                    i = rng.choice(spots)
                    part = w[i : i + 2] if w[i : i + 2] in SPOILT else w[i]
                    form = rng.choice(SPOILT[part])
                    spoilt = w[:i] + form + w[i + len(part) :]
                    gold = f"replace {w[i]}" + (" delete" if len(form) == 2 else f" insert {part[1]}" if len(part) == 2 else "")
                    known = max(LEAST_KNOWN, counts[w] >> rng.randint(0, 8))
                    own = 0 if rng.random() < 0.5 else rng.randint(0, known // RARER)
                    edits.append((self.features(spoilt, i), self.evidence(own, known), self.choices(spoilt, i), gold))
            for i in range(len(w)):
                options = self.choices(w, i)
                for edit in options[1:]:
                    # a word of its own, beside another that is unknown, or as it is, or less than RARER times as frequent
                    own = max(1, counts[w] >> rng.randint(0, 8))
                    for known in (counts.get(self.made(w, i, edit), 0) * own // counts[w], rng.randint(0, own * RARER - 1)):
                        edits.append((self.features(w, i), self.evidence(own, known), options, "keep"))
            if len(w) >= 4:
                i = rng.randint(2, len(w) - 2)
                a, b, other = w[:i], w[i:], rng.choice(listed)
                for sure in (False, True):
                    # a part may be a word by chance, as in "way-bill"
                    chance = (a in counts or rng.random() < 0.4, b in counts or rng.random() < 0.4)
                    breaks.append((self.break_features(a, b, (*chance, True), sure), two, "join"))
                    breaks.append((self.break_features(a, b, (*chance, False), sure, True), two, "join"))
                    # parts that are no words make a new word at a sure line end; two words make none
                    breaks.append((self.break_features(a, b, (False, False, False), sure), two, "join" if sure else "keep break"))
                    breaks.append((self.break_features(w, other, (True, True, w + other in counts), sure), two, "join" if w + other in counts else "keep break"))
        # an edit's evidence counts for all edits alike, so both kinds of features learn at once
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        n = 0

        def kind(o: str) -> str:
            return "keep" if o == "keep" else "edit"

        for _ in range(ROUNDS):
            rng.shuffle(edits)
            for feats, seen, options, gold in edits:
                n += 1
                scores = {o: self.score(feats, o) + EVIDENCE * self.score(seen, kind(o)) for o in options}
                best = max((o for o in options if o != gold), key=lambda o: (scores[o], o), default=gold)
                if best != gold and scores[gold] < scores[best] + MARGIN:
                    moved = [((f, o), by) for f in feats for o, by in ((gold, 1.0), (best, -1.0))]
                    if kind(gold) != kind(best):
                        moved += [((f, kind(o)), by * EVIDENCE) for f in seen for o, by in ((gold, 1.0), (best, -1.0))]
                    for k, by in moved:
                        total[k] += (n - stamp[k]) * self.weights.get(k, 0.0)
                        stamp[k] = n
                        self.weights[k] = self.weights.get(k, 0.0) + by
        averaged = {k: a for k, v in self.weights.items() if (a := (total[k] + (n + 1 - stamp[k]) * v) / (n + 1))}
        self.weights = {}
        self.fit(breaks)
        self.weights |= averaged
        return self


NOTES = "kind string, table_name string, row_key string, doc_key string, token string, n bigint"


def notes(texts: DataFrame, furniture: Furniture) -> DataFrame:
    """What may be noise in (table_name, row_key, doc_key, text, paged), and the counts of plain words, as rows (see NOTES)."""
    sent = texts.sparkSession.sparkContext.broadcast(furniture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sent.value
        counts: Counter[str] = Counter()
        paired: dict[str, bool] = {}

        def out(rows: list[tuple], b: pa.RecordBatch | None) -> pa.RecordBatch:
            kind, at, token, n = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            take = pa.array(at, pa.int64())
            keys = [pa.nulls(len(rows), pa.string())] * 3 if b is None else [b.column(k).take(take) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), *keys, pa.array(token, pa.string()), pa.array(n, pa.int64())], ["kind", "table_name", "row_key", "doc_key", "token", "n"])

        for b in batches:
            rows: list[tuple] = []
            paged = b.column(4).to_pylist()
            for i, t in enumerate(b.column(3).to_pylist()):
                if not t:
                    continue
                removed = page_lines(t, told if paged[i] else None)
                marks = [] if paged[i] else page_marks(t)
                if removed or marks:
                    rows.append(("page_number", i, None, 0))
                body = t
                if paged[i]:
                    at = 0
                    lines = t.split("\n")
                    places = None
                    for k, line in enumerate(lines):
                        key = header_key(line)
                        if key:
                            places = places or line_places(lines)
                            if told.says(line.strip(), places[k]):
                                rows.append(("line", i, key, 0))
                                removed.append((at, at + len(line)))
                        at += len(line) + 1
                elif repeats := repeated_header(t):
                    rows.append(("header", i, None, 0))
                    removed += repeats
                removed += marks
                if removed:
                    # what is left when the furniture is taken out of the page
                    last, parts = 0, []
                    for x, y in sorted(removed):
                        if x >= last:
                            parts.append(t[last:x].rstrip(" \t\n") + "\n" if x else "")
                            last = y
                    body = "".join(parts) + t[last:].lstrip("\n") if parts else t
                low = body.lower()
                # the parts of divided words are no words of the corpus, however often they occur
                words = _WORDS.findall(_DIVIDED.sub(" ", low) if "-" in low or "\u2010" in low or "\u00ad" in low else low)
                counts.update(words)
                for w in set(words):
                    hit = paired.get(w)
                    if hit is None:
                        hit = paired[w] = any(p in w for p in PAIRS) or bool(FIRST.match(w))
                    if hit:
                        rows.append(("word", i, w, 0))
                for m in _ODD_WORD.finditer(low):
                    w = m.group().rstrip("!|")
                    if len(w) >= 3 and sum(c.isalpha() for c in w) * 2 > len(w) and any(c in _ODD for c in w):
                        rows.append(("word", i, w, 0))
                for m in _DIVIDED.finditer(body):
                    left, mark, gap, right = m.groups()
                    if right in SUSPENDED or left.isdigit() or right.isdigit():
                        continue
                    whole = left.lower() + right.lower()
                    rows.append(("divided", i, f"{left.lower()}-{right.lower()}", 1 if "\n" in gap or mark != "-" else 0))
                    if any(c in _ODD for c in whole) or any(p in whole for p in PAIRS):
                        rows.append(("word", i, whole, 0))
                if len(paired) > WORDS_HELD:
                    paired.clear()
            yield out(rows, b)
            if len(counts) > WORDS_HELD:
                yield out([("count", 0, w, n) for w, n in counts.items()], None)
                counts.clear()
        yield out([("count", 0, w, n) for w, n in counts.items()], None)

    return texts.select("table_name", "row_key", "doc_key", "text", "paged").mapInArrow(run, NOTES)


class Findings:
    """The tables that a pass over the texts leads to."""

    def __init__(self, texts: DataFrame) -> None:
        spark = texts.sparkSession
        # the sample of pages that tells furniture, whole documents where they fit
        pages = texts.filter(f"paged AND length(text) <= {PAGE_CHARS}").orderBy(F.xxhash64("doc_key"), "row_key").select("doc_key", "row_key", "text").limit(TRAIN_PAGES).collect()
        self.furniture = Furniture().train([tuple(r) for r in pages])
        seen = stored(notes(texts, self.furniture), "scan-notes")
        self.counts = stored(seen.filter("kind = 'count'").groupBy("token").agg(F.sum("n").alias("n")), "scan-words")
        # the sample of words that the editor learns from
        sample = self.counts.filter(F.length("token") >= 4).orderBy(F.desc("n"), "token").limit(TRAIN_WORDS).collect()
        editor = spark.sparkContext.broadcast(Editor().train({r["token"]: r["n"] for r in sample}))

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = [b.column(k).to_pylist() for k in range(4)]
                gains = [editor.value.correction(w, word, own or 0, known) for w, word, own, known in zip(*columns)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(gains, pa.float64())], ["token", "correction", "known", "gain"])

        words = seen.filter("kind = 'word'")
        noted = words.select("token").distinct().join(self.counts.select("token", F.col("n").alias("own")), "token", "left").withColumn("form", one_form(F.col("token")))
        known = self.counts.filter(F.col("n") >= LEAST_KNOWN).select(F.col("token").alias("correction"), F.col("n").alias("known"), one_form(F.col("token")).alias("form"))
        # a form is that of few words: only misspelt ones of the corpus share it
        met = noted.join(known, "form").filter("token <> correction").select("token", "correction", "own", "known")
        decided = met.mapInArrow(decide, "token string, correction string, known bigint, gain double").filter("gain > 0")
        best = F.max_by("correction", F.struct("gain", "known", "correction"))
        self.corrections = stored(decided.groupBy("token").agg(best.alias("correction")), "scan-corrections")
        key = ["table_name", "row_key", "doc_key"]
        # a word that stands in a third of the texts is met in SALTS parts
        salted = self.corrections.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        self.confusions = words.select(*key, "token", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["token", "salt"]).drop("salt")
        divided = seen.filter("kind = 'divided'")
        parts = F.split("token", "-")
        breaks = divided.select("token", "n").distinct().select("token", "n", parts[0].alias("left"), parts[1].alias("right"), F.concat(parts[0], parts[1]).alias("whole"))
        for c in ("left", "right", "whole"):
            breaks = breaks.join(self.counts.select(F.col("token").alias(c), (F.col("n") >= 2).alias(f"{c}_known")), c, "left")
        breaks = breaks.join(self.corrections.select(F.col("token").alias("whole"), F.lit(True).alias("spoilt")), "whole", "left")

        def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = [b.column(k).to_pylist() for k in range(1, 8)]
                joined = [editor.value.joins(x, y, (bool(k), bool(m), bool(w)), n == 1, bool(s)) for n, x, y, k, m, w, s in zip(*columns)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(8), pa.array(joined, pa.bool_())], ["token", "n", "whole", "joins"])

        breaks = breaks.select("token", "n", "left", "right", "left_known", "right_known", "whole_known", "spoilt", "whole").mapInArrow(join_lines, "token string, n bigint, whole string, joins boolean")
        self.divided = divided.join(breaks.filter("joins").drop("joins"), ["token", "n"]).select(*key, F.col("whole").alias("token"))
        lines = seen.filter("kind = 'line'")
        several = lines.groupBy("doc_key", "token").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b")).filter("a <> b")
        self.headers = lines.select(*key, "token").join(several.select("doc_key", "token"), ["doc_key", "token"], "left_semi").select(*key, "token")
        self.direct = seen.filter("kind IN ('header', 'page_number')").select(*key, "kind")

    def kinds(self) -> DataFrame:
        """(table_name, row_key, noise_kind) of each kind of noise of each text."""
        key = ["table_name", "row_key"]
        parts = [
            self.direct.select(*key, F.col("kind").alias("noise_kind")),
            self.headers.select(*key, F.lit("header").alias("noise_kind")),
            self.confusions.select(*key, F.lit("confusion").alias("noise_kind")),
            self.divided.select(*key, F.lit("hyphen").alias("noise_kind")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()


def repaired(texts: DataFrame, found: Findings) -> DataFrame:
    """(table_name, row_key, text_repaired) of each different row of texts: continuous paragraphs without the noise."""
    key = ["table_name", "row_key"]
    none = F.lit(None).cast("string")

    def part(df: DataFrame, **named: str) -> DataFrame:
        return df.select(*key, *((F.lit(True) if c == "placed" and c in named else F.col(named[c]) if c in named else none.cast("boolean") if c == "placed" else none).alias(c) for c in ("token", "correction", "head", "whole", "placed")))

    all_found = (
        part(found.confusions, token="token", correction="correction")
        .unionByName(part(found.headers, head="token"))
        .unionByName(part(found.divided, whole="token"))
        .unionByName(part(found.direct, placed="kind"))
    )
    fixes = F.map_from_entries(F.collect_set(F.when(F.col("token").isNotNull(), F.struct("token", "correction"))))
    sides = all_found.groupBy(*key).agg(fixes.alias("fixes"), F.collect_set("head").alias("heads"), F.collect_set("whole").alias("wholes"), F.max("placed").alias("placed"))
    # texts move once: repeated rows are dropped where the join needs them
    df = texts.repartition(*key).distinct().join(sides, key, "left")
    sent = texts.sparkSession.sparkContext.broadcast(found.furniture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, paged, fix, head, whole, placed in zip(*(b.column(k).to_pylist() for k in range(2, 8))):
                out.append(None if t is None else repair(t, bool(paged), dict(fix or ()), set(head or ()), set(whole or ()), sent.value, bool(placed)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], [*key, "text_repaired"])

    return df.select(*key, "text", "paged", "fixes", "heads", "wholes", "placed").mapInArrow(run, "table_name string, row_key string, text_repaired string")


def repair(text: str, paged: bool, fixes: dict[str, str], heads: set[str], wholes: set[str], furniture: Furniture | None = None, placed: bool = True) -> str:
    """One text without the noise that was found in it; placed: page numbers or repeated headers were."""
    drop = page_lines(text, furniture if paged else None) + ([] if paged else page_marks(text) + repeated_header(text)) if placed else []
    if paged and heads:
        at = 0
        for line in text.split("\n"):
            if header_key(line) in heads:
                drop.append((at, at + len(line)))
            at += len(line) + 1
    last, parts = 0, []
    for a, b in sorted(drop):
        if a >= last:
            parts.append(text[last:a].rstrip(" \t"))
            last = b
    body = re.sub(r"\n(?=\n)(?!\n\n)", "", "".join(parts) + text[last:]) if drop else text

    def join(m: re.Match) -> str:
        left, _, _, right = m.groups()
        return left + right if (left + right).lower() in wholes else m.group()

    if wholes:
        body = _DIVIDED.sub(join, body)

    def fix(m: re.Match) -> str:
        w = m.group()
        good = fixes.get(w.lower())
        return w if good is None else good.capitalize() if w[0].isupper() else good

    if fixes:
        body = _ANY_WORD.sub(fix, body)
    body = body.strip()
    if "\n" not in body:
        return body
    blocks = re.split(r"\n[ \t]*\n\s*", body)
    return "\n\n".join(_one_line(x) if not re.search(r"\|.*\n", x) else x for x in blocks if x.strip())


def _one_line(block: str) -> str:
    lines = block.split("\n")
    return " ".join(x for x in (lines[0].rstrip(), *(x.strip() for x in lines[1:])) if x)

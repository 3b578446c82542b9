"""Sentence boundaries in any language and script.

A pushdown automaton reads the events of a text (line ends, end marks, ellipses, quotation marks, brackets, blanks
between Thai letters). Its stack holds the list levels of the lines read so far and, above them, the open quotations
and brackets of the line; end marks count only while no quotation or bracket is open. A line with a list sign pops the
levels that are indented as far or further and pushes its own, so a numeral's dot in the sign ends nothing. Full stops
are judged with a trie of abbreviations read backwards from the stop. Everything works on the text's *shape*, its characters in consistent
form with invisible ones left out, and positions are carried back to the stored text.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestrand.llm import forms

# Abbreviations that never end a sentence, and those that do before a capital letter (English, German,
# Hindi; Russian, Ukrainian; Spanish, Portuguese, Italian, French; Polish, Czech, Dutch, Swedish, Turkish).
NEVER_LAST = """
dr prof mr mrs ms st sr jr hr fr dipl ing vs e.g i.e cf no nos nr fig figs abb tab sec ch vol ed eds approx ca vgl bzw bspw
z. b z.b d. h d.h u. a u.a o. ä o.ä i. d. r i.d.r s. o s.o s. u s.u u. u u.u sog evtl ggf inkl exkl zzgl max min mind geb
art abs kap bd hrsg st rev gen col capt lt sgt rep sen gov hon डॉ श्री प्रो पं सं कु
т.е т. е г гг ул пр просп пер д кв стр рис табл см ср напр т.н т. н т.ч т. ч им проф акад тыс млн млрд руб коп обл р-н в т.ч вул буд обл
sra dra srta dña ud uds pág págs núm av avda c.p p.ej p. ej aprox tel esq v.g
sig sigg sig.ra dott dott.ssa ing avv pag pagg p.es p. es c.so p.za
mme mlle me env p.ex p. ex chap éd
ul np m.in tzn tzw dr. hab mgr inż str godz tj č ul nám např tzv
bijv d.w.z dhr mevr nl t.ex bl.a s.k örn bkz sn
"""
MAYBE_LAST = "т.д т. д т.п т. п др пр ecc itd itp enz osv vb atd etc inc ltd co corp llc gmbh plc bros a.m p.m u.s u.k e.u ph.d b.sc m.sc usw usf al dept est jan feb mar apr jun jul aug sep sept oct nov dec"
# Months after a German ordinal.
MONTHS = ("Januar", "Jänner", "Februar", "Feber", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")

PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "{": "}", "【": "】", "〔": "〕", '"': '"', "»": "«", "‟": "”"}
QUOTES = set("“„«‹「『\"»‟")
CLOSERS = set("”“»›」』》〉)]}】〕\"«")
ENDS = set("!?。．.…।॥؟۔։።។။‼⁇⁈⁉‽")
HAN_KANA = "぀-ヿ㇀-㇯㐀-鿿豈-﫿𠀀-𳍿々〆〇ｦ-ﾟ"
THAI = "ก-๎"
LINE_END = "\n\r\v\f\x1c\x1d\x1e\x85  "

_EVENT = re.compile(
    rf"[{LINE_END}]|(?:…|\.\.)[….]*|\.(?![a-z0-9])|[!?。．।॥؟۔։።។။‼⁇⁈⁉‽]|[“”„«»‹›「」『』《》〈〉()\[\]{{}}【】〔〕\"‟]|(?<=[{THAI}])[ \t]+(?=[{THAI}])"
)
_TAIL = re.compile(r"(?:[ \t]?[!?。．।॥؟۔‼⁇⁈⁉‽]|(?<=[!?。])[.…]+|[”»›」』》〉)\]}】〕])*")
_SIGN = re.compile(r"[ \t]*(?:(?:[-*+•·▪◦‣–>#|]+|[\[(]?\s*(?:\d{1,4}|[a-zA-Z]|[ivxIVX]{1,5})\s*[\])、.)]+(?!\d))[ \t]*)*")
_NUMERAL = re.compile(r"[ \t]*(?:[-*+•>#]+[ \t]+)*[\[(]?(?:\d{1,4}(?:\.\d{1,3})*|[a-zA-Z]|[ivxIVX]{1,5})")
LONGEST_NUMERAL = 40
_LEVEL = re.compile(r"([ \t]*)((?:[-*+•>#]+[ \t]+)*)")
_AFTER = re.compile(r"[ \t]*")
_LINE_END = re.compile(f"[{LINE_END}]")
_HAN = re.compile(f"[{HAN_KANA}]")
_HIRAGANA = re.compile("[぀-ゟ]")
_LETTER = re.compile(r"[^\W\d_]")
_MONTH = re.compile("|".join(dict.fromkeys(form for m in MONTHS for form in (m, unicodedata.normalize("NFD", m)))))
_ORDINAL = re.compile(r"(?:^|[^\w])(?:am|vom|zum|dem|den|der|im|ab|bis)[ \t]\d{1,2}$", re.I)


class Trie:
    """Words read backwards; the value at ``""`` is the kind of the word that ends there."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, kind: int) -> None:
        node = self.root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = kind

    def before(self, text: str, end: int) -> int:
        """The kind of the longest word that ends at ``end`` and starts at a word's start; 0 without one."""
        node, found, at = self.root, 0, end - 1
        while at >= 0 and (node := node.get(text[at].lower())):
            if "" in node and (at == 0 or not (text[at - 1].isalnum() and text[at - 1] < "⺀")):
                found = node[""]
            at -= 1
        return found


@functools.cache
def abbreviations() -> Trie:
    trie = Trie()
    for kind, words in ((1, re.findall(r"(?:\w\. )+\w+|\S+", NEVER_LAST)), (2, MAYBE_LAST.split())):
        for word in words:
            trie.add(word, kind)
            trie.add("".join(forms.LETTERS.get(c, {}).get("latin", c) for c in word), kind)  # as its shape is spelled
    return trie


def _stop_ends(s: str, i: int, line: int, sign: int) -> bool:
    """Whether the full stop at ``i`` ends a sentence; ``line`` is the start of its line, ``sign`` where its blanks and
    list signs end."""
    numeral = i <= sign + LONGEST_NUMERAL and _NUMERAL.fullmatch(s, line, i)
    if i == line or s[i - 1].isspace():
        return True
    after = _AFTER.match(s, i + 1).end()
    blank, nxt = after > i + 1, s[after : after + 1]
    if not nxt or nxt in LINE_END:
        return not numeral
    if nxt in ",;:" or blank and nxt.islower():
        return False
    before = s[i - 1]
    if numeral:
        return False
    kind = abbreviations().before(s, i)
    if kind == 1:
        return False
    if kind == 2:
        return not nxt.isdigit() and not (nxt.isupper() and s[after + 1 : after + 2] == ".")
    if before.isdigit():
        return not (blank and (_MONTH.match(s, after) or _ORDINAL.search(s[max(line, i - 8) : i])))
    if before.isalpha() and (before < "ɐ" or "Ѐ" <= before < "԰") and (i < 2 or not (s[i - 2].isalnum() and s[i - 2] < "⺀")):  # an initial, or one letter of several
        return False
    if not blank and nxt.isupper() and not before.islower():
        return s[after + 1 : after + 2].islower()
    return True


def _ellipsis_ends(s: str, i: int, end: int) -> bool:
    after = _AFTER.match(s, end).end()
    nxt = s[after : after + 1]
    if not nxt or nxt in LINE_END:
        return True
    if nxt in ",;:、，；：—–-/·～~" or nxt in CLOSERS and nxt != '"':
        return False
    if nxt.islower():
        k = i - 1
        while k >= 0 and not _LETTER.match(s[k]) and s[k] not in LINE_END:
            k -= 1
        return s[i:end].count("…") > 1 or k >= 0 and bool(_HAN.match(s[k]))
    return True


def _quotation_ends(s: str, start: int, sign_end, opened: int, closed: int) -> bool:
    """Whether the quotation or bracket from ``opened`` to ``closed`` ends the sentence that began at ``start``;
    ``sign_end()`` tells where the signs at its start end."""
    inner = closed - 1
    while inner > opened and (s[inner] in CLOSERS or s[inner] in " \t"):
        inner -= 1
    if inner <= opened or s[inner] not in ENDS:
        return False
    after = _AFTER.match(s, closed + 1).end()
    nxt = s[after : after + 1]
    opens = sign_end() >= opened
    if s[opened] not in QUOTES:
        return opens and not (nxt.islower() or nxt and nxt in ",;:、")
    if opens or nxt and nxt in ",;:、)":
        return False
    k = opened - 1
    while k > start and s[k] in " \t":
        k -= 1
    if s[k] == ":":
        return not nxt.islower()
    if s[k] in ",、":
        return not (nxt.islower() or _HIRAGANA.match(nxt) or s[k] == "、")
    return False


class _Automaton:
    """The stack of one text: list levels below, open quotations and brackets above. Every step takes constant time,
    apart from one pass over each line for each kind of closing mark it may need."""

    def __init__(self, s: str) -> None:
        self.s = s
        self.levels: list[int] = []  # indentations of the open list levels
        self.open: list[tuple[str, int]] = []  # what closes it, and where it was opened
        self.awaited: dict[str, int] = {}  # how many open ones each closing mark could close
        self.start_line(0)

    def start_line(self, line: int) -> None:
        self.line, self.last = line, {}
        self.open.clear()
        self.awaited.clear()
        m = _LEVEL.match(self.s, line)
        self.sign = m.end()
        numeral = _NUMERAL.match(self.s, line)
        if m[2] or numeral and self.s[numeral.end() : numeral.end() + 1] in (".", ")", "]", "、"):
            indent = len(m[1])
            while self.levels and self.levels[-1] >= indent:
                self.levels.pop()
            self.levels.append(indent)
        elif self.s[line : line + 1] not in (" ", "\t"):
            self.levels.clear()

    def closes_later(self, marks: str, at: int) -> bool:
        """Whether one of the marks stands in this line at ``at`` or after."""
        if "" not in self.last:
            m = _LINE_END.search(self.s, at)
            self.last[""] = m.start() if m else len(self.s)
        for c in marks:
            if c not in self.last:
                self.last[c] = self.s.rfind(c, self.line, self.last[""])
        return max(self.last[c] for c in marks) >= at

    def push(self, marks: str, at: int) -> None:
        self.open.append((marks, at))
        for c in marks:
            self.awaited[c] = self.awaited.get(c, 0) + 1

    def close(self, c: str) -> int:
        """Close the innermost quotation or bracket that ``c`` closes, with all inside it; where it was opened, or -1."""
        if not self.awaited.get(c):
            return -1
        while True:
            marks, opened = self.open.pop()
            for x in marks:
                self.awaited[x] -= 1
            if c in marks:
                return opened


def shape_spans(s: str) -> list[tuple[int, int]]:
    """Sentences of a shape string, as start and end."""
    out: list[tuple[int, int]] = []
    start = skip = 0
    stack = _Automaton(s)
    signs = [0, -1]

    def emit(end: int) -> None:
        nonlocal start
        a, b = start, end
        while a < b and s[a].isspace():
            a += 1
        while b > a and s[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        start = end

    def sign_end() -> int:
        if not signs[0] <= start <= signs[1]:  # from within a run of signs, they end where the run ends
            signs[:] = start, _SIGN.match(s, start).end()
        return signs[1]

    for m in _EVENT.finditer(s):
        i, end = m.span()
        if i < skip:
            continue
        c = s[i]
        if c in LINE_END:
            emit(i)
            stack.start_line(end)
        elif c in " \t":
            if not stack.open:
                emit(i)
        elif c in ENDS:
            if stack.open:
                continue
            if c == "…" or end - i > 1:
                end = _TAIL.match(s, end).end()
                if s[end - 1] not in ".…" or _ellipsis_ends(s, i, end):
                    emit(skip := end)
            elif c != "." or _stop_ends(s, i, stack.line, stack.sign):
                emit(skip := _TAIL.match(s, end).end())
        elif (opened := stack.close(c)) >= 0:
            if not stack.open and _quotation_ends(s, start, sign_end, opened, i):
                emit(skip := _TAIL.match(s, end).end())
        elif c in PAIRS:
            if c == '"' and (end < len(s) and s[end].isspace() or i > start and (s[i - 1].isalnum() and s[i - 1] < "⺀")):
                continue
            if stack.closes_later(PAIRS[c], end):
                stack.push(PAIRS[c], i)
    emit(len(s))
    return out


@functools.cache
def _shape_lut() -> np.ndarray:
    form = forms._luts()[0].copy()
    codes = np.arange(len(form), dtype=np.uint32)
    keep = (form >= forms.MANY) & (form != forms.GONE)
    form[keep] = codes[keep]
    for c, row in forms.LETTERS.items():
        if "latin" in row:
            form[ord(c)] = ord(row["latin"])
    return form


def spans_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of many texts: number of the text, start and end in the stored text."""
    data, offsets = forms.encode(texts)
    shape = _shape_lut()[data]
    gone = shape == forms.GONE
    shape[gone] = 0x200B
    whole = shape.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    some = np.add.reduceat(gone, np.minimum(offsets[:-1], max(len(gone) - 1, 0))) if len(gone) else np.zeros(len(texts))
    number, starts, ends = [], [], []
    at = offsets.tolist()
    for k in range(len(texts)):
        a, b = at[k], at[k + 1]
        if a == b:
            continue
        s = whole[a:b]
        if some[k]:
            kept = np.flatnonzero(~gone[a:b])
            if not len(kept):
                continue
            for x, y in shape_spans(s.replace("​", "")):
                number.append(k)
                starts.append(int(kept[x]))
                ends.append(int(kept[y - 1]) + 1)
        else:
            for x, y in shape_spans(s):
                number.append(k)
                starts.append(x)
                ends.append(y)
    return np.array(number, np.int64), np.array(starts, np.int32), np.array(ends, np.int32)


def sentences(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One row per sentence: ``(id_col, start_pos, end_pos)``, white space at the ends left out.

    Null ids and texts give no row; an id's text is read once however often its row is repeated (the least of
    several texts counts); empty and blank texts have no sentence; other columns are ignored."""
    rows = df.select(df[id_col].alias("k"), df[text_col].alias("t"))
    rows = rows.where("k is not null and t is not null").dropDuplicates(["k"])

    def run(batches):
        for batch in batches:
            number, starts, ends = spans_batch(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0).take(pa.array(number)), pa.array(starts), pa.array(ends)], ["k", "start_pos", "end_pos"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, start_pos int, end_pos int").withColumnRenamed("k", id_col)

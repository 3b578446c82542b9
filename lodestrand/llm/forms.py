"""One consistent form for texts that look the same.

Characters are brought to one code by compatibility width, composition, equal shape, and kind of blank or hyphen;
invisible characters go. Letters of the scripts that share shapes (Latin, Cyrillic, Greek, Armenian, Cherokee) are
resolved by token: the sets of scripts that each letter could be written in are intersected over the token. A token
whose sets have one script in common is spelled in it. One that several scripts could write is spelled in the first
script of ``SCRIPT_ORDER`` (``consistent``, the key for comparisons of parts of texts) or in the script that most of
the text's unambiguous letters have (``resolved``, for texts to be read). A token whose sets have no script in common
keeps its unambiguous letters. Both depend on shapes only, so two texts of equal shapes get one form.

Raised, lowered, circled, squared and fraction signs keep their own codes.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np

SCRIPT_ORDER = ("latin", "cyrillic", "greek", "armenian", "cherokee")

# Letters of equal shape, as (Latin, Cyrillic, Greek, Armenian, Cherokee); a dash stands for "none".
EQUAL_LETTERS = """
A А Α - Ꭺ | B В Β - Ᏼ | C С - - Ꮯ | D - - - Ꭰ | E Е Ε - Ꭼ | G Ԍ - - Ꮐ | H Н Η - Ꮋ | I І Ι - - | J Ј - - Ꭻ | K К Κ - Ꮶ
L - - Լ Ꮮ | M М Μ - Ꮇ | N - Ν - - | O О Ο Օ - | P Р Ρ - Ꮲ | Q Ԛ - - - | R - - - Ꭱ | S Ѕ - Տ Ꮪ | T Т Τ - Ꭲ | U - - Ս -
V Ѵ - - Ꮩ | W Ԝ - - Ꮃ | X Х Χ - - | Y Ү Υ - - | Z - Ζ - Ꮓ | a а - - - | c с - - - | d ԁ - - - | e е - - - | g - - ց -
h һ - հ - | i і - - - | j ј - յ - | n - - ո - | o о ο օ - | p р ρ - - | q ԛ - զ - | s ѕ - - - | u - - ս - | v ѵ ν - -
w ԝ - - - | x х - - - | y у - - - | - Г Γ - - | - П Π - - | - Ф Φ - - | ï ї - - - | Ï Ї - - -
"""

# Arabic letters and digits of one shape with two codes, as pairs (found, kept).
ARABIC_DOUBLES = dict(zip("کی۰۱۲۳۷۸۹", "كى٠١٢٣٧٨٩", strict=True))

# Radicals of the CJK supplement that carry no decomposition but have the shape of a character.
RADICALS = dict(
    pair
    for pair in zip(
        "⺁⺄⺅⺆⺈⺉⺊⺎⺐⺒⺓⺔⺕⺖⺘⺙⺛⺝⺟⺠⺡⺢⺣⺥⺦⺧⺨⺩⺬⺭⺮⺯⺰⺱⺲⺶⺷⺹⺺⺼⺽⺾⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
        "厂乙亻冂刀刂卜兀尢巳幺彑彐忄扌攵旡月母民氵氺灬爫丬牛犭王示礻竹糹纟罓罒羊羊耂肀月臼艹虎衤覀西见角讠贝车辶阝钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
        strict=True,
    )
)

# Hyphens and minus signs of the shape of "-", and invisible characters outside category Cf.
HYPHENS = "‐‑‒–⁃−˗﹘﹣－"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
#: Visible signs of category Cf (they enclose or precede digits).
VISIBLE_CF = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
#: Kinds of compatibility decomposition that keep the shape.
SHAPE_KINDS = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>"}

LETTERS: dict[str, dict[str, str]] = {}
for _group in EQUAL_LETTERS.replace("\n", "|").split("|"):
    _row = {s: c for s, c in zip(SCRIPT_ORDER, _group.split()) if c != "-"}
    for _c in _row.values():
        LETTERS[_c] = _row


def own_script(c: str) -> str:
    o = ord(c)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    if 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0:
        return "cherokee"
    return "latin"


def map_char(c: str) -> str:
    """The consistent spelling of one character, before composition and script resolution."""
    if "!" <= c <= "~":
        return c
    if c in RADICALS:
        return RADICALS[c]
    if c in ARABIC_DOUBLES:
        return ARABIC_DOUBLES[c]
    if c in HYPHENS:
        return "-"
    o, kind = ord(c), unicodedata.category(c)
    if kind == "Zs":
        return " "
    if c in INVISIBLE or 0xFE00 <= o <= 0xFE0F or 0xE0000 <= o <= 0xE0FFF or (kind == "Cf" and o not in VISIBLE_CF):
        return ""
    parts = unicodedata.decomposition(c).split()
    if not parts or kind[0] == "C":
        return c
    if parts[0] in SHAPE_KINDS:
        if parts[1] == "0020":  # a spacing accent: the blank is no part of its shape
            return c
        parts = parts[1:]
    elif parts[0][0] == "<":
        return c
    elif len(parts) > 1:  # a composed character: composition is left to the end
        return c
    return "".join(map_char(chr(int(p, 16))) for p in parts)


class _Table(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = map_char(chr(code))
        return out


_TABLE = _Table()
_TOKEN = re.compile(r"(?:[A-Za-zªºÀ-ÖØ-öø-ʯͰ-ͳͶͷͻ-ͽΆΈ-ϿЀ-ҁҊ-ԯԱ-Ֆա-ևᎠ-ᏽᲀ-ᲈḀ-῿ꭰ-ꮿ][̀-ͯ҃-҇]*)+")
_FOREIGN = re.compile(r"[Ͱ-ͳͶͷͻ-ͽΆΈ-ϿЀ-ҁҊ-ԯԱ-Ֆա-ևᎠ-ᏽᲀ-ᲈἀ-῿ꭰ-ꮿ]")


def scripts_of(token: str) -> set[str]:
    """The scripts in which a whole token could be written, by its letters' shapes."""
    common = set(SCRIPT_ORDER)
    for c in token:
        if not unicodedata.combining(c):
            common &= LETTERS[c].keys() if c in LETTERS else {own_script(c)}
    return common


def spelled(token: str, order: tuple[str, ...]) -> str:
    """A token in the first script of ``order`` that could write it; where none could, its ambiguous letters each in the
    first script they allow."""
    common = scripts_of(token)
    script = next((s for s in order if s in common), None)
    return "".join((r.get(script) or next(r[s] for s in order if s in r)) if (r := LETTERS.get(c)) else c for c in token)


@functools.lru_cache(1 << 16)
def resolve_token(token: str) -> str:
    return spelled(token, SCRIPT_ORDER)


def _mapped(text: str) -> str:
    return unicodedata.normalize("NFC", text.translate(_TABLE))


def consistent(text: str) -> str:
    """The consistent form of a text. Equal forms mean equal looks."""
    if text.isascii():
        return text
    text = _mapped(text)
    if _FOREIGN.search(text):
        text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: resolve_token(m[0]), text))
    return text


def script_order(text: str) -> tuple[str, ...]:
    """``SCRIPT_ORDER`` with the script first that most letters of a mapped text have, counted over the tokens that one
    script alone could write."""
    n = dict.fromkeys(SCRIPT_ORDER, 0)
    for m in _TOKEN.finditer(text):
        if len(common := scripts_of(m[0])) == 1:
            n[next(iter(common))] += len(m[0])
    return tuple(sorted(SCRIPT_ORDER, key=lambda s: -n[s]))


def resolved(text: str) -> str:
    """The consistent form with ambiguous tokens in the text's own script, so words of a Russian text stay Cyrillic."""
    if text.isascii():
        return text
    text = _mapped(text)
    if _FOREIGN.search(text):
        order = script_order(text)
        text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: spelled(m[0], order), text))
    return text


def confusable_tokens(text: str) -> list[tuple[str, str, str]]:
    """``(token, kind, spelling)`` of the tokens of a text whose stored letters mislead: "mixed" ones have letters of
    several scripts, "whole_script" ones are written in one script where the text's own could write them."""
    if text.isascii():
        return []
    mapped, out = _mapped(text), []
    if _FOREIGN.search(mapped):
        order = script_order(mapped)
        for m in _TOKEN.finditer(mapped):
            own = {own_script(c) for c in m[0] if not unicodedata.combining(c)}
            to = spelled(m[0], order)
            if len(own) > 1:
                out.append((m[0], "mixed", to))
            elif to != m[0]:
                out.append((m[0], "whole_script", to))
    return out


# Whole batches: one array of code points with offsets. SINGLE holds the mapped code, GONE for invisible ones, or HARD
# for characters that need the string path (several codes, composition, or a script that shares shapes).
# LONE marks letters of those scripts that have no double: they are HARD only beside another letter.
# Codes from MANY on are numbers of spellings of several codes.
GONE, HARD, LONE, MANY = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0x80000000


@functools.cache
def _luts() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Form and letter by code; the spellings of several codes, and their lengths."""
    spellings: list[str] = []
    form, letter = np.arange(0x110000, dtype=np.uint32), np.full(0x110000, GONE, np.uint32)
    for code in range(0x110000):
        if 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0x2F800 or 0x30000 <= code < 0x323B0:
            letter[code] = code
            continue
        if code > 0x323B0 and not 0xE0000 <= code < 0xE1000 or 0xD800 <= code < 0xF900:
            continue
        c = chr(code)
        to = map_char(c)
        hard = len(to) > 1 or any(
            unicodedata.combining(x) or _FOREIGN.match(x) or unicodedata.normalize("NFC", x) != x or 0x1100 <= ord(x) < 0x1200 or x in "াৗାୖୗாௗೂೕೖാൗාෟီ"
            for x in to
        )
        if hard and unicodedata.combining(c) and len(to) == 1 and (0x900 <= code < 0x980 and code != 0x93C or 0xE00 <= code < 0xE80):
            hard = False  # vowel signs and tone marks that take part in no composition and have one order
        lone = to == c and c not in LETTERS and _FOREIGN.match(c) and unicodedata.normalize("NFC", c) == c
        if len(to) > 1 and all(not unicodedata.combining(x) and not _FOREIGN.match(x) and x not in LETTERS.keys() - {*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"} and ord(x) not in range(0x1100, 0x1200) and unicodedata.normalize("NFC", x) == x for x in to):
            form[code] = MANY + len(spellings)
            spellings.append(to)
        else:
            form[code] = GONE if not to else LONE if lone else HARD if hard else ord(to)
        if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd":
            low = c.lower()
            letter[code] = ord(low) if len(low) == 1 else code
    lengths = np.array([len(x) for x in spellings])
    many = np.zeros((len(spellings), lengths.max()), np.uint32)
    for row, x in zip(many, spellings):
        row[: len(x)] = [ord(c) for c in x]
    return form, letter, many, lengths


def _in_token(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0x41) & (codes <= 0x5A) | (codes >= 0x61) & (codes <= 0x7A) | (codes >= 0xAA) & (codes < 0x590) | (codes >= 0x13A0) & (codes < 0x1400) | (codes >= 0x1C80) & (codes < 0x1C90) | (codes >= 0xAB70) & (codes < 0xABC0) | (codes >= 0x1E00) & (codes < 0x2000) | (codes >= 0xFB00) & (codes < 0xFB07) | (codes >= 0xFF21) & (codes < 0xFF5B)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offsets at which each text starts (one more at the end)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def _compact(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = data != GONE
    if keep.all():
        return data, offsets
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def consistent_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``consistent`` for many texts, as code points with offsets."""
    data, offsets = encode(texts)
    form, _, many, lengths = _luts()
    out = form[data]
    if len(lone := np.flatnonzero(out == LONE)):
        padded = np.concatenate([[0], data, [0]])
        beside = _in_token(padded[lone]) | _in_token(padded[lone + 2])
        out[lone] = np.where(beside, HARD, data[lone])
    hard = np.flatnonzero(out == HARD)
    if len(hard):
        texts = list(texts)
        for k in np.unique(np.searchsorted(offsets, hard, "right") - 1).tolist():
            texts[k] = consistent(texts[k])
        data, offsets = encode(texts)
        out = form[data]
        out = np.where((out == HARD) | (out == LONE), data, out)
    if len(wide := np.flatnonzero((out >= MANY) & (out < LONE))):
        number = out[wide] - MANY
        width = np.ones(len(out), np.int64)
        width[wide] = lengths[number]
        ends = np.concatenate([[0], np.cumsum(width)])
        out, offsets, at = np.repeat(out, width), ends[offsets], ends[wide]
        for j in range(many.shape[1]):
            more = lengths[number] > j
            out[at[more] + j] = many[number[more], j]
    return _compact(out, offsets)


def resolved_batch(texts: list[str]) -> list[str]:
    """``resolved`` for many texts; only those with letters of other scripts are gone through one by one."""
    out = decode(*consistent_batch(texts))
    hard = _luts()[0]
    data, offsets = encode(texts)
    at = np.flatnonzero((hard[data] == HARD) | (hard[data] == LONE))
    for k in np.unique(np.searchsorted(offsets, at, "right") - 1).tolist():
        out[k] = resolved(texts[k])
    return out


def letters_batch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form, lower-cased, with all but letters, marks and digits removed; code points with offsets."""
    data, offsets = consistent_batch(texts)
    return _compact(_luts()[1][data], offsets)


def decode(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Back to strings."""
    whole = data.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass")
    at = offsets.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def letters_only(text: str) -> str:
    return decode(*letters_batch([text]))[0]

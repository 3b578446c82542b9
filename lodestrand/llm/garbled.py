"""Texts decoded with a wrong encoding.

A hidden Markov model with one clean state and one state for each encoding pair labels the characters of a text; paths
may go from one pair's state to another's. The emissions of a pair's state come from the clean texts and from the alphabets of fixed scripts, encoded the true way and decoded the wrong way; in the states of UTF-8 they also
depend on whether a character stands in a well-formed sequence. Those of the clean state come from the characters of all
texts, less those in which a first pass over all of them finds garbled spans. ASCII
characters look the same in every state and carry no evidence. Each labelled span gets its state's inverse transform,
which is checked: bytes have to decode in the true encoding, letters that no clean text has need enough of their own
script beside them, and for the weaker encodings the result has to be likelier as clean text than what stood there.
Where a check fails, the next likeliest state of the span is tried.
"""

from __future__ import annotations

import codecs
import functools
import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import forms
from lodestrand.llm.samples import least_hashes
from lodestrand.session import dropped, staged

SINGLE_BYTE = ("cp1252", "latin-1", "cp1251", "cp1250", "cp850", "cp437", "mac_roman", "koi8_r")
#: (true encoding, encoding it was read in). A text garbled twice is restored by repeating the inverse.
PAIRS = (
    *((t, w) for t in ("utf-8", "gb18030", "cp932") for w in SINGLE_BYTE),
    ("big5", "cp1252"), ("euc_jp", "cp1252"), ("cp949", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"),
    ("utf-8", "gb18030"), ("utf-8", "cp932"), ("utf-8", "big5"), ("utf-8", "cp949"),
    ("gb18030", "utf-8"), ("cp932", "utf-8"), ("cp1252", "utf-8"), ("gb18030", "cp949"), ("gb18030", "cp932"), ("gb18030", "big5"), ("cp932", "gb18030"), ("big5", "gb18030"),
)
#: Where the encoding read in stands among the single-byte ones; -1 for others, -2 for UTF-8, whose spans hold losses only.
READ_AT = np.array([SINGLE_BYTE.index(w) if w in SINGLE_BYTE else -2 if w == "utf-8" else -1 for _, w in PAIRS])
#: The pairs whose spans are believed by their gain alone, without a UTF-8 sequence or a loss.
BY_GAIN = np.array([p for p, (true, w) in enumerate(PAIRS) if w != "utf-8" and (true != "utf-8" or w not in SINGLE_BYTE)])
REACH = 12  # labelled characters this near to each other are restored together
ENTER = 4.0  # cost of leaving the clean state, in nats; going back costs the same
SWITCH = 6.0  # cost of going from one pair's state to another's
FORM, MISFORM = 1.5, -1.5  # evidence of a UTF-8 state: the character is part of a well-formed sequence, or is not
OWN_SCRIPT = 3  # letters unknown to the table's clean text that a text needs of one script to be believed
#: Ranges of letters whose encodings every pair's state knows, whatever the texts hold.
SCRIPTS = ((0xC0, 0x17F), (0x391, 0x3C9), (0x410, 0x451), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3042, 0x3093), (0x30A2, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
LOST = "�"
SPAN_TEXTS = 4000  # texts whose gains are held at once
PART_CHARACTERS = 2_000_000  # characters of different parts of lines that a task decodes at once
BLOCK_CHARACTERS = 50_000  # characters whose gains for all pairs are held at once, besides those of a stretch


@functools.cache
def byte_table(name: str) -> list[str]:
    """A single-byte encoding by byte; bytes it leaves undefined keep their number, as lenient readers have it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@functools.cache
def _byte_of(name: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(byte_table(name))))}


@functools.cache
def _charmap(name: str):
    return codecs.charmap_build("".join(byte_table(name)))


@functools.cache
def _sequence(name: str) -> re.Pattern:
    """A UTF-8 sequence as the encoding reads it."""
    table = byte_table(name)
    first, second, third, fourth = (re.escape("".join(table[a:b])) for a, b in ((0x80, 0xC0), (0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5)))
    return re.compile(f"[{second}][{first}]|[{third}][{first}]{{2}}|[{fourth}][{first}]{{3}}")


@functools.cache
def _any_sequence() -> re.Pattern:
    """What every UTF-8 sequence begins with, in whatever single-byte encoding it is read."""
    first, lead = (re.escape("".join(sorted({c for name in SINGLE_BYTE for c in byte_table(name)[a:b]}))) for a, b in ((0x80, 0xC0), (0xC2, 0xF5)))
    return re.compile(f"[{lead}][{first}]")


def to_bytes(text: str, wrong: str) -> bytes | None:
    if wrong not in SINGLE_BYTE:
        try:
            return text.encode(wrong)
        except UnicodeEncodeError:
            return None
    try:
        return codecs.charmap_encode(text, "strict", _charmap(wrong))[0]
    except UnicodeEncodeError:
        return None


def _high(text: str) -> int:
    """The number of characters other than ASCII."""
    return len(text) - len(text.encode("ascii", "ignore"))


def _decode(data: bytes, true: str, wrong: str) -> tuple[str, int, int]:
    """Decode what decodes; bytes that don't stay as they were read. Also the counts of restored and kept characters."""
    kept = 0

    def keep(error):
        nonlocal kept
        bad = error.object[error.start : error.start + 1]
        kept += bad[0] >= 0x80
        return (byte_table(wrong)[bad[0]] if wrong in SINGLE_BYTE else LOST), error.start + 1

    codecs.register_error("lodestrand-keep", keep)
    text = data.decode(true, "lodestrand-keep")
    return text, _high(text) - kept, kept


@functools.cache
def script_letters() -> str:
    """The letters of the fixed scripts; of the two largest every 16th, so each script has about equal weight."""
    return "".join(chr(c) for a, b in SCRIPTS for c in range(a, b + 1, 16 if b - a > 1000 else 1))


def script_group(c: str) -> str:
    """The script of a letter by its name; those that Japanese and Chinese mix are one."""
    name = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    return "HAN" if name in ("CJK", "HIRAGANA", "KATAKANA") else name


def _counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = codes[codes > 0x7F]
    if len(codes) < 20_000:
        return np.unique(codes, return_counts=True)
    n = np.bincount(codes)  # no sorting
    return np.flatnonzero(n), n[n > 0]


def text_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters other than ASCII, and in how many texts each stands."""
    return _counts(forms.encode(["".join(set(t)) for t in texts if not t.isascii()])[0])


#: Characters other than ASCII with what may be read as a part of them: three ASCII characters or a line's end bring every decoder to its start.
_PART = re.compile("[^\\x00-\\x7f]+(?:[\\x00-\\x09\\x0b-\\x7f]{1,3}[^\\x00-\\x7f]+)*[\\x00-\\x09\\x0b-\\x7f]{0,3}")


def line_parts(lines: list[str]) -> Counter[str]:
    """The parts of the lines that tell what these are read as, and how often each stands in them."""
    return Counter(_PART.findall("\n".join(lines)))


def emissions(lines: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair how often the encoded lines have each byte from 128 on (by its place), if they are read in a single-byte
    encoding, else each character other than ASCII that they are read as. Counts of several sets of lines add up."""
    return part_emissions(line_parts(lines))


def part_emissions(parts: Counter[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``emissions`` of lines that have these parts."""
    once, often = [p for p, n in parts.items() if n == 1], {p: n for p, n in parts.items() if n > 1}
    text, times = "\n".join([*once, *often, ""]), np.fromiter(often.values(), np.float64, len(often))

    def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
        codes = forms.encode([text])[0]
        ends = np.flatnonzero(codes == 10)  # no part has a line's end
        first = int(ends[len(once) - 1]) if once else 0
        n, rest = np.bincount(codes[:first], minlength=128), codes[first:]
        high, part = rest > 0x7F, np.cumsum(rest == 10, dtype=np.int32) - bool(once)
        m = np.bincount(rest[high], times[part[high]])
        total = np.zeros(max(len(n), len(m)), np.int64)
        total[: len(n)] += n
        total[: len(m)] += m.astype(np.int64)
        total[:128] = 0
        return np.flatnonzero(total), total[total > 0]

    codes, n = counted(text)
    of = {}
    for true in dict.fromkeys(true for true, _ in PAIRS):  # each encodes a character by itself
        data = [chr(c).encode(true, "ignore") for c in codes]
        of[true] = np.bincount(np.frombuffer(b"".join(data), np.uint8), np.repeat(n, list(map(len, data))), 256)[128:].astype(np.int64)
    data = {true: text.encode(true, "ignore") for true, wrong in PAIRS if wrong not in SINGLE_BYTE}
    return [(np.arange(128), of[true]) if wrong in SINGLE_BYTE else counted(data[true].decode(wrong, "replace")) for true, wrong in PAIRS]


def _runs(gain: np.ndarray) -> np.ndarray:
    """The largest sum of consecutive rows that end at each row."""
    run = np.cumsum(gain, axis=0, dtype=np.float64)
    low = np.minimum.accumulate(run[:-1], axis=0)
    run[1:] -= np.minimum(low, 0, out=low)
    return run


def _stretched(gain: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with rows of loss before those where a stretch ``begins``, which no sum of gain goes across, and the places of the rows."""
    place = np.arange(len(gain)) + np.cumsum(begins)
    out = np.full((len(gain) + int(begins.sum()), gain.shape[1]), -1e5)
    out[place] = gain
    return out, place


def _three(apart: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The most that three consecutive rows or more of one column bring that end at each row, from the ``_runs`` of the rows."""
    most = np.full(len(apart), -1e5)
    most[2:] = (run[:-2] + apart[1:-1] + apart[2:]).max(1)
    return most


NEAR = 0.01  # sums of gains that are nearer to a bound may be beyond it where they are rounded otherwise


def _may_leave(best: float, last: float, gain: np.ndarray) -> bool:
    """Whether a path through other states can beat the clean one. One state has to bring more (``best``, at the end of the
    text ``last``) than the costs of entering and of leaving it, which the end spares; each further state costs ``SWITCH``, so
    one of several brings more than that, and all of them, each character with its best one, more than all costs."""
    if best + NEAR > 2 * ENTER or last + NEAR > ENTER:
        return True
    if best + NEAR <= SWITCH:
        return False
    run = _runs(gain.max(1))
    return bool(run.max() + NEAR > 2 * ENTER + SWITCH or run[-1] + NEAR > ENTER + SWITCH)


class Model:
    """Emissions by character and state; state 0 is the clean one."""

    def __init__(self, texts: list[str], everywhere: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``everywhere``: the ``text_counts`` of a whole table from which ``texts`` is a sample."""
        self.fit(texts, everywhere)
        garbled = set(self.garbled(texts))
        clean = [t for k, t in enumerate(texts) if k not in garbled]
        if clean:
            self.fit(clean, everywhere and _less_garbled(everywhere, text_counts(texts), text_counts(clean)))

    @classmethod
    def of(cls, everywhere: tuple[np.ndarray, np.ndarray], emitted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """From the counts of a whole table."""
        model = cls.__new__(cls)
        model.fit([], everywhere, emitted)
        return model

    def fit(self, texts: list[str], everywhere: tuple[np.ndarray, np.ndarray] | None = None, emitted: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        # every distinct line that has other than ASCII letters counts once, whatever its share of the texts
        emitted = emitted or emissions(list(dict.fromkeys(x for t in texts for x in t.split("\n") if not x.isascii())))
        # the clean state counts texts, not characters: a garbled text is longer than others
        counts = [everywhere or text_counts(texts)]
        part = lambda x: x / max(1, x.sum())
        for (_, wrong), (a, n), (b, m) in zip(PAIRS, emitted, emissions([script_letters()])):
            if wrong in SINGLE_BYTE:  # texts, scripts, and an even share
                counts.append((np.array([ord(c) for c in byte_table(wrong)[128:]]), 0.5 * part(n) + 0.25 * part(m) + 0.25 / 128))
            else:
                codes = np.union1d(a, b)
                share = np.zeros(len(codes))
                share[np.searchsorted(codes, a)] += 0.95 * part(n)
                share[np.searchsorted(codes, b)] += 0.05 * part(m)
                counts.append((codes, share))
        known = np.unique(np.concatenate([codes for codes, _ in counts]))
        self.row = np.zeros(0x110000, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        logp = np.full((len(known) + 1, len(counts)), np.log(1e-8), np.float32)
        logp[:, 0] = np.log(1e-7)
        for s, (codes, count) in enumerate(counts):
            share = part(count)
            logp[self.row[codes], s] = np.log(0.999 * share + np.exp(logp[0, s]))
        self.gain = logp[:, 1:] - logp[:, :1]  # of each state against the clean one
        self.clean = logp[:, 0].copy()
        self.seen = np.zeros(len(known) + 1, bool)  # characters of clean text, however rare in a large table
        self.seen[self.row[counts[0][0]]] = counts[0][1] >= 0.5
        self.gain[0] = np.minimum(self.gain[0], 0)
        self.most = np.vstack([self.gain, np.full((1, self.gain.shape[1]), -1e6, np.float32)])
        self.most[:-1, : len(SINGLE_BYTE)] += np.float32(FORM)  # no evidence of form brings more
        self.top = self.most.max(1)
        self.lively = self.most.max(1) > 0
        self.written = np.zeros((len(known) + 1, len(SINGLE_BYTE)), bool)
        self.place = np.zeros((len(known) + 1, len(SINGLE_BYTE)), np.int8)  # 1: goes on with a UTF-8 sequence, else its length
        for w, name in enumerate(SINGLE_BYTE):
            codes = np.array([ord(c) for c in byte_table(name)[128:]])
            self.written[self.row[codes], w] = True
            for length, (first, end) in enumerate(((0x80, 0xC0), (0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5)), 1):
                self.place[self.row[codes[first - 128 : end - 128]], w] = length
        self.written[0] = False
        # the encodings as bits: those in which a character goes on with a UTF-8 sequence, or begins one of 2, 3 or 4
        self.bits = np.stack([np.packbits(self.place == n, axis=1)[:, 0] for n in range(1, 5)])
        self.by_gain = self.gain[:, BY_GAIN]
        self.by_gain_top = self.by_gain.max(1)

    def clean_score(self, text: str) -> float:
        codes = forms.encode([text])[0]
        codes = codes[codes > 0x7F]
        return float(np.maximum(self.clean[self.row[codes]], -14.0).sum()) if len(codes) else 0.0

    def _paths(self, gains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over several texts at once, each with its own states; a path holds the state of each character."""
        n, longest, states = len(gains), max(map(len, gains)), max(g.shape[1] for g in gains) + 1
        leave, switch, every = np.float32(ENTER), np.float32(SWITCH), np.arange(n)
        score = np.zeros((longest, n, states), np.float32)  # first what each character brings, then the best sums up to it
        for k, g in enumerate(gains):
            score[: len(g), k, 1 : 1 + g.shape[1]] = g
            score[:, k, 1 + g.shape[1] :] = -1e9  # states that other texts have
        score[0, :, 1:] -= leave
        for before, now in zip(score, score[1:]):
            top = before[:, 1:].max(1)
            came = np.maximum(before, np.maximum(before[:, 0] - leave, top - switch)[:, None])
            np.maximum(before[:, 0], top - leave, out=came[:, 0])
            now += came
        before = score[:-1]
        top, likeliest = before[:, :, 1:].max(2), (before[:, :, 1:].argmax(2) + 1).astype(np.int8)
        enter, top = before[:, :, 0] - leave, top - switch
        came = np.where(enter < top, likeliest, 0)  # from the likeliest of the other states
        stays = before >= np.maximum(enter, top)[:, :, None]
        stays[:, :, 0] = before[:, :, 0] >= before[:, :, 1:].max(2) - leave
        # padding has equal emissions, so the best last state at the end of the padding is that of the text
        paths = np.zeros((longest, n), np.int8)
        paths[-1] = s = score[-1].argmax(1)
        for t in range(longest - 2, -1, -1):
            paths[t] = s = np.where(stays[t, every, s], s, np.where(s == 0, likeliest[t], came[t]))
        return [paths[: len(g), k] for k, g in enumerate(gains)]

    def spans(self, texts: list[str]) -> list[tuple[int, int, int, int, str | None]]:
        """Garbled spans of the texts: (number of the text, start, end, pair, restored text or None)."""
        out = []
        for k in range(0, len(texts), SPAN_TEXTS):
            out += [(k + span[0], *span[1:]) for span in self._spans(texts[k : k + SPAN_TEXTS])]
        return out

    def garbled(self, texts: list[str]) -> list[int]:
        """The texts that have garbled spans."""
        return [k + i for k in range(0, len(texts), SPAN_TEXTS) for i in sorted({span[0] for span in self._spans(texts[k : k + SPAN_TEXTS], True)})]

    def _spans(self, texts: list[str], one: bool = False) -> list[tuple[int, int, int, int, str | None]]:
        data, offsets = forms.encode(texts)
        high = np.flatnonzero(data > 0x7F)
        if not len(high):
            return []
        coded, starts = self.row[data[high]], np.searchsorted(high, offsets)
        todo = []
        for k in self._believable(data[high], coded, high, starts):
            codes = coded[starts[k] : starts[k + 1]]
            at, gain = high[starts[k] : starts[k + 1]] - offsets[k], self.gain.take(codes, 0)
            able = np.flatnonzero(np.maximum(gain, 0).sum(0) > ENTER)
            if not len(able):  # no path can beat the clean one
                continue
            if able[0] < len(SINGLE_BYTE):
                self._with_form(at, codes, gain, able[able < len(SINGLE_BYTE)])
            most = gain.take(able, 1)
            run = _runs(most)
            top = run.max(0)
            if not _may_leave(top.max(), run[-1].max(), most):
                continue
            # a state that brings less than leaving and coming back, or than the end of the text spares, is on no best path
            some = (top + NEAR > ENTER) | (run[-1] + NEAR > SWITCH - ENTER)
            ended = np.flatnonzero(run[-1] + NEAR > SWITCH - ENTER)
            # a run of characters that are part of no such stretch of a state is one step: a best path is clean there
            quiet = np.ones(len(at), bool)
            if len(ended):
                tail = np.cumsum(most[::-1].take(ended, 1), axis=0, dtype=np.float64)[::-1]
                quiet[np.flatnonzero((tail + NEAR > SWITCH - ENTER).any(1))[0] :] = False
            able, most, run = able[some], most[:, some], run[:, some]
            quiet &= ~(run + _runs(most[::-1])[::-1] - most + NEAR > ENTER).any(1)
            steps = np.flatnonzero(~(quiet & np.concatenate([[False], quiet[:-1]])))
            most = most.take(steps, 0)
            most[quiet[steps]] = -1e9
            todo.append((k, at, codes, steps, able, most, gain))
        todo.sort(key=lambda x: len(x[3]))
        out = []
        while todo:
            longest = len(todo[-1][3])
            take = max(1, min(256, 100_000 // (longest + 1), sum(2 * len(x[3]) >= longest for x in todo[-256:])))
            group, todo = todo[-take:], todo[:-take]
            for (k, at, codes, steps, able, _, gain), path in zip(group, self._paths([x[5] for x in group])):
                if not path.any():
                    continue
                path = np.repeat(np.concatenate([[0], able + 1])[path], np.diff(steps, append=len(at)))
                marked = np.flatnonzero(path)
                found = []
                for run in np.split(marked, np.flatnonzero((np.diff(at[marked]) > REACH) | (np.diff(marked) > 2)) + 1):
                    found += self._run(texts[k], at, codes, gain, path, run)
                    if one and any(not unknown for *_, unknown in found):  # whatever the others are
                        break
                # letters that no clean text has are believed where the text has several of their script
                groups = Counter(g for *_, unknown in found for g in unknown)
                out += [(k, *span) for *span, unknown in found if all(groups[g] >= OWN_SCRIPT for g in unknown)]
        return sorted(out, key=lambda x: x[:3])

    def _believable(self, chars: np.ndarray, coded: np.ndarray, high: np.ndarray, starts: np.ndarray) -> list[int]:
        """The ``_candidates`` that have something ``_checked`` believes: a loss, a UTF-8 sequence in some encoding, or three
        characters or more, none further from the next than ``REACH``, that bring a pair of ``BY_GAIN`` more than ``ENTER``.
        Whatever the best path of another text is, each of its spans would be rejected."""
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        goes_on, *begins = (np.append(bits[coded], np.zeros(3, np.uint8)) for bits in self.bits)
        goes_on[1 : len(coded)][(np.diff(high) > 1) | (np.diff(owner) > 0)] = 0
        follows, formed = goes_on[1:], np.zeros(len(coded), np.uint8)
        whole = np.full(len(coded), 0xFF, np.uint8)
        for n, first in enumerate(begins):
            whole &= follows[n : len(coded) + n]
            formed |= whole & first[: len(coded)]
        sure = np.zeros(len(starts) - 1, bool)
        sure[owner[(formed > 0) | (chars == ord(LOST))]] = True
        # first as if every character had the pair it suits best, then by pair what is part of a stretch where that suffices
        begins = np.append(True, (np.diff(high) > REACH) | (np.diff(owner) > 0))
        apart, place = _stretched(self.by_gain_top[coded][:, None], begins)
        run = _runs(apart)
        able = np.zeros(int(begins.sum()), bool)
        stretch = np.cumsum(begins) - 1
        able[stretch[_three(apart, run)[place] + NEAR > ENTER]] = True
        able[stretch[sure[owner]]] = False
        left = np.flatnonzero(able[stretch] & ((run + _runs(apart[::-1])[::-1] - apart)[place, 0] + NEAR > ENTER))
        begins = begins[left] | (np.diff(left, prepend=-2) > 1)
        edges = np.flatnonzero(begins)
        for at, first in zip(*(np.split(x, edges[np.diff(edges // BLOCK_CHARACTERS, prepend=0) > 0]) for x in (left, begins))):
            apart, place = _stretched(self.by_gain[coded[at]], first)
            sure[owner[at[_three(apart, _runs(apart))[place] + NEAR > ENTER]]] = True
        return self._candidates(coded[sure[owner]], np.concatenate([[0], np.cumsum(np.diff(starts) * sure)]))

    def _candidates(self, coded: np.ndarray, starts: np.ndarray) -> list[int]:
        """The texts (their characters' rows in ``coded`` from ``starts`` on) in which a path may beat the clean one, by a bound:
        every character has the evidence of form, and of a run of those that bring nothing to any state only the first counts."""
        part = self.lively[coded]
        part[1:] |= self.lively[coded[:-1]]
        part[starts[:-1][starts[:-1] < starts[1:]]] = True
        ends = np.concatenate([[0], np.cumsum(part)])[starts]
        held = np.append(coded[part], len(self.most) - 1)  # the last is what stands before a shorter text
        sizes, out = np.diff(ends), []
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        for k in range(0, len(order), 128):  # texts of about equal length together, a step for each of their characters
            own = order[k : k + 128]
            places = ends[own + 1] - np.arange(int(sizes[own].max()), 0, -1)[:, None]
            codes = held[np.where(places < ends[own], len(held) - 1, places)]
            run, best = np.zeros((2, len(own), self.most.shape[1]), np.float32)
            one, several = np.zeros((2, len(own)), np.float32)
            for row, top in zip(codes, self.top[codes]):
                np.maximum(run, 0, out=run)
                run += self.most.take(row, 0)
                np.maximum(best, run, out=best)
                one = np.maximum(one, 0) + top
                np.maximum(several, one, out=several)
            most, last = best.max(1) + NEAR, run.max(1) + NEAR
            several = (several + NEAR > 2 * ENTER + SWITCH) | (one + NEAR > ENTER + SWITCH)
            out += own[(most > 2 * ENTER) | (last > ENTER) | (most > SWITCH) & several].tolist()
        return sorted(out)

    def _with_form(self, at: np.ndarray, codes: np.ndarray, gain: np.ndarray, pairs: np.ndarray) -> None:
        """Adds to the gains the evidence of UTF-8 sequences for ``pairs`` with single-byte encodings, which are the first:
        only well-formed ones come from UTF-8."""
        place = self.place[codes].take(pairs, 1)
        inside = np.zeros((len(at) + 3, len(pairs)), bool)  # lines end with what is no part of a sequence
        goes_on, follows = np.zeros_like(inside), np.zeros(len(at), bool)
        follows[1:] = at[1:] == at[:-1] + 1
        goes_on[: len(at)] = (place == 1) & follows[:, None]
        whole = np.ones_like(place, bool)
        for n in (1, 2, 3):
            whole &= goes_on[n : len(at) + n]
            formed = whole & (place == n + 1)
            for i in range(n + 1):
                inside[i : len(at) + i] |= formed
        gain[:, pairs] += np.where(inside[: len(at)], FORM, MISFORM).astype(np.float32)

    def _run(self, text: str, at: np.ndarray, codes: np.ndarray, gain: np.ndarray, path: np.ndarray, run: np.ndarray) -> list[tuple]:
        """The spans of one run of labelled characters: one if a single state's inverse explains it, else one for each
        stretch of one label."""
        first, last = int(run[0]), int(run[-1])
        if last - first < 2:  # only a UTF-8 sequence is believed, and losses are
            piece = text[max(0, int(at[first]) - 3) : int(at[last]) + 4]
            if LOST not in piece and not _any_sequence().search(piece):
                return []
        states = [s - 1 for s, _ in Counter(path[run].tolist()).most_common()]
        whole = self._checked(text, at, codes, gain, first, last + 1, states)
        if whole is None or whole[3] is None and len(states) > 1:
            stretches = np.split(run, np.flatnonzero(np.diff(path[run]) != 0) + 1) if len(states) > 1 else []
            parts = [x for r in stretches if (x := self._checked(text, at, codes, gain, int(r[0]), int(r[-1]) + 1, [int(path[r[0]]) - 1]))]
            if parts:
                return parts
        return [whole] if whole else []

    def _checked(self, text: str, at: np.ndarray, codes: np.ndarray, gains: np.ndarray, a: int, b: int, states: list[int]) -> tuple | None:
        """(start, end, pair, restored text or None, scripts of its unknown letters) of the labelled characters from ``a``
        to ``b``: the inverse of their states, the most frequent first; where its checks fail, of the states next in gain
        that could have written the span."""
        start, end = int(at[a]), int(at[b - 1]) + 1
        piece = text[max(0, start - 3) : end + 3]
        formed = _any_sequence().search(piece)
        if not formed and b - a <= 2 and LOST not in piece:
            return None
        gain = gains[a:b].sum(0)
        fits = 4 * self.written.take(codes[a:b], 0).sum(0) >= 3 * (b - a)
        strong = (gain > ENTER) & (b - a > 2)
        able = np.flatnonzero(strong & np.where(READ_AT < 0, READ_AT > -2, fits[READ_AT])).tolist()
        whole = [p for p in np.flatnonzero(fits).tolist() if _sequence(SINGLE_BYTE[p]).search(piece)] if formed else []  # UTF-8
        able = [p for p in able if p >= len(SINGLE_BYTE) or p in whole] + [p for p in whole if p not in able]
        first = [p for p in states if p in able]
        for p in first + sorted((p for p in able if p not in first), key=lambda p: -gain[p]):
            if found := self._inverse(text, start, end, p):
                return found
        if LOST in text[start:end]:  # what was lost cannot come back
            return start, end, int(gain.argmax()), None, []
        return None

    def _inverse(self, text: str, start: int, end: int, pair: int) -> tuple | None:
        true, wrong = PAIRS[pair]
        if wrong in SINGLE_BYTE:  # take in the rest of a sequence that the path cut off
            table = _byte_of(wrong)
            while start and text[start - 1] > "\x7f" and text[start - 1] in table:
                start -= 1
            while end < len(text) and text[end] > "\x7f" and text[end] in table:
                end += 1
            if true != "utf-8" and end < len(text) and "@" <= text[end] <= "~":  # a second byte may be ASCII
                end += 1
        piece = text[start:end]
        out, restored, kept, lost = [], 0, 0, piece.count(LOST)
        known = _byte_of(wrong) if wrong in SINGLE_BYTE else None
        for part in re.split(f"({LOST}+)", piece):
            if not part or part[0] == LOST:
                out.append(part)
                continue
            for run in _encodable(part, known, wrong):
                if isinstance(run, str):
                    out.append(run)
                    kept += _high(run)
                else:
                    t, good, bad = _decode(run, true, wrong)
                    out.append(t)
                    restored, kept = restored + good, kept + bad
        if not restored:
            return None
        result = "".join(out)
        if kept > 0.25 * (restored + kept) and not lost:
            return None
        if true == "utf-8" and known:
            for _ in range(2):  # garbled more than once
                again = to_bytes(result, wrong)
                if again is None or result.isascii():
                    break
                try:
                    result = again.decode("utf-8")
                except UnicodeDecodeError:
                    break
        news = {c: n for c, n in Counter(result).items() if c > "\x7f" and c != LOST}
        total, unknown = sum(news.values()), {c: n for c, n in news.items() if not self.seen[self.row[ord(c)]]}
        if any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in news):
            return None
        scripts = []
        if 2 * sum(unknown.values()) > total:
            if true != "utf-8" or not known or not all(c.isalpha() for c in unknown):
                return None
            scripts = [g for c, n in unknown.items() for g in [script_group(c)] * n]
        if true != "utf-8" or not known:
            letters = {c for c in news if c.isalpha()}
            if len(letters) < 3 or (score := self.clean_score(result)) < -9.0 * total or score <= self.clean_score(piece) + 5:
                return None
        return start, end, pair, None if lost else result, scripts


def _less_garbled(everywhere: tuple[np.ndarray, np.ndarray], sample: tuple[np.ndarray, np.ndarray], clean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """In how many clean texts of the table each character stands, from the counts of the table, of the sample and of
    the sample's clean texts. A character that the sample lacks counts as clean."""
    codes, n = everywhere
    of = lambda part: np.bincount(np.searchsorted(codes, part[0]), part[1], len(codes)) if len(part[0]) else np.zeros(len(codes))
    sampled, kept = of(sample), of(clean)
    share = (kept + 0.5) / (sampled + 0.5)
    rest = np.where(share < 0.5, np.minimum(share * (n - sampled), 0.49), share * (n - sampled))
    return codes, kept + rest


def _encodable(part: str, known: dict | None, wrong: str) -> list[str | bytes]:
    """Runs of a text that the wrong encoding can write, as bytes, and the rest."""
    data = to_bytes(part, wrong)
    if data is not None:
        return [data]
    out: list[str | bytes] = []
    if known is None:
        while part:
            try:
                out.append(part.encode(wrong))
                break
            except UnicodeEncodeError as e:
                out += [part[: e.start].encode(wrong)] if e.start else []
                out += part[e.start : e.end]
                part = part[e.end :]
        return out
    for kept, run in itertools.groupby(part, known.__contains__):
        out += [bytes(map(known.__getitem__, run))] if kept else run
    return out


def table_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ``text_counts`` of all ``rows(t)``; as many numbers come to the driver as there are different characters."""

    def run(batches):
        for batch in batches:
            codes, n = text_counts(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(codes.astype(np.int32)), pa.array(n.astype(np.int64))], ["code", "n"])

    got = rows.select("t").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    return got["code"].to_numpy(np.int64), got["n"].to_numpy(np.float64)


def table_lines(rows: DataFrame) -> DataFrame:
    """The lines of ``rows(t)`` that have other than ASCII letters."""
    return rows.select(F.explode(F.split("t", "\n")).alias("line")).where(F.col("line").rlike("[^\\x00-\\x7f]"))


def table_emissions(lines: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``emissions`` of ``lines(line)``; as many numbers come to the driver as the pairs have different characters."""

    def run(batches):
        held, size, parts = None, 0, Counter()
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new, before = line_parts(batch.column(0).to_pylist()), len(parts)
                parts.update(new)
                size += sum(map(len, new)) * (len(parts) - before) // max(1, len(new))
            if parts and (batch is None or size > PART_CHARACTERS):
                new, size, parts = part_emissions(parts), 0, Counter()
                for p, ((a, n), (b, m)) in enumerate(zip(held or (), new)):
                    codes = np.union1d(a, b)
                    total = np.zeros(len(codes), np.int64)
                    total[np.searchsorted(codes, a)] += n
                    total[np.searchsorted(codes, b)] += m
                    new[p] = codes, total
                held = new
        for p, (codes, n) in enumerate(held or []):
            yield pa.record_batch([pa.array(np.full(len(codes), p, np.int32)), pa.array(codes.astype(np.int32)), pa.array(n.astype(np.int64))], ["pair", "code", "n"])

    got = lines.mapInArrow(run, "pair int, code int, n long").groupBy("pair", "code").agg(F.sum("n").alias("n")).toPandas().sort_values(["pair", "code"])
    out = []
    for p, empty in enumerate(emissions([])):
        own = got[got["pair"] == p]
        out.append((own["code"].to_numpy(np.int64), own["n"].to_numpy(np.int64)) if len(own) else empty)
    return out


def _less(counts: tuple[np.ndarray, np.ndarray], part: tuple[np.ndarray, np.ndarray], kept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Counts without those of a part; what falls to none goes, unless ``kept``."""
    codes, n = counts[0], counts[1].copy()
    n[np.searchsorted(codes, part[0])] -= part[1]
    return (codes, n) if kept else (codes[n > 0], n[n > 0])


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = None) -> Model:
    """A model from all texts: a first one from all of them, and from it one without the texts in which it finds garbled
    spans. With ``sample_rows``, only the characters are counted in all texts, and the rest in so many of least hash. Without
    texts it knows no garbled character."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    everywhere = table_counts(rows)
    if sample_rows is not None:
        picked = least_hashes(rows, rows.count(), sample_rows).select("t")
        return Model([r.t for r in picked.collect()] or [""], everywhere)
    emitted = table_emissions(table_lines(rows).distinct())
    first = Model.of(everywhere, emitted)
    shared = df.sparkSession.sparkContext.broadcast(first)

    def garbled(batches):
        for batch in batches:
            yield batch.take(pa.array(shared.value.garbled(batch.column(0).to_pylist()), pa.int64()))

    # the garbled texts are few, so their counts are taken off those of all texts
    found = staged(rows.select("t").mapInArrow(garbled, "t string"), "garbled")
    counts = _less(everywhere, table_counts(found))
    if len(counts[0]):
        each = table_lines(rows).withColumn("n", F.lit(1)).union(table_lines(found).withColumn("n", F.lit(-1)))
        gone = table_emissions(each.groupBy("line").agg(F.sum("n").alias("n")).where("n = 0").select("line"))  # lines of garbled texts only
        rest = [_less(own, part, wrong in SINGLE_BYTE) for (_, wrong), own, part in zip(PAIRS, emitted, gone)]
        out = Model.of(_less_garbled(everywhere, everywhere, counts), rest)
    else:
        out = first
    dropped(found)
    return out


def restore(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int | None = None) -> DataFrame:
    """One row per garbled text: ``(id_col, restored, n_spans, n_restored, encodings)``.

    ``restored`` is the whole text with every span that can be restored put right; spans that cannot be (characters
    were lost) stay and lower ``n_restored`` below ``n_spans``. ``encodings`` lists the pairs as "true>read in". Null
    ids and texts give no row, empty and clean texts neither; an id's repeated rows count once (least text first);
    other columns are ignored."""
    model = model or fit(df, id_col, text_col, sample_rows)
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    kind = rows.schema["k"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = ["k", "restored", "n_spans", "n_restored", "encodings"]
        for batch in batches:
            texts, at, found = batch.column(1).to_pylist(), [], {n: [] for n in names[1:]}
            by: dict[int, list] = {}
            for k, *span in shared.value.spans(texts):
                by.setdefault(k, []).append(span)
            for k, spans in by.items():
                out, end = [], 0
                for a, b, _, fixed in spans:
                    if a < end:
                        continue
                    out += [texts[k][end:a], texts[k][a:b] if fixed is None else fixed]
                    end = b
                at.append(k)
                found["restored"].append("".join(out) + texts[k][end:])
                found["n_spans"].append(len(spans))
                found["n_restored"].append(sum(s[3] is not None for s in spans))
                found["encodings"].append(", ".join(sorted({">".join(PAIRS[s[2]]) for s in spans})))
            yield pa.record_batch(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(found["restored"], pa.string()), pa.array(found["n_spans"], pa.int32()), pa.array(found["n_restored"], pa.int32()), pa.array(found["encodings"], pa.string())], names
            )

    out = rows.mapInArrow(run, f"k {kind}, restored string, n_spans int, n_restored int, encodings string")
    return out.groupBy("k").agg(F.min(F.struct("restored", "n_spans", "n_restored", "encodings")).alias("r")).select(F.col("k").alias(id_col), "r.*")

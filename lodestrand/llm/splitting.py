"""Splitting oversized texts at natural boundaries.

Balanced targets: the least number of pieces gives equal-length targets; each target snaps to the strongest boundary
near it (paragraph, line, sentence, clause, word, any character), and a piece is added from there on whenever a limit
fails: when a piece would be too long, or when a cut would miss a paragraph, line or sentence end that one more piece
could reach.
"""

from __future__ import annotations

import bisect
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.sentences import spans_batch

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, ANY = 5, 4, 3, 2, 1, 0
_CLAUSE = re.compile(r"[,;:，、；：—·|](?=\s|[^\d\s])")
_BLANK = re.compile(r"(?<=\S)\s+")
_BREAKS = re.compile(r"(?:\r\n|[\n\r\v\f\x85  ])[ \t　]*(?:\r\n|[\n\r\v\f\x85  ])")
_LINE_END = "\n\r\v\f\x85  "


def boundaries(text: str, lo: int, hi: int, ends: list[int]) -> list[tuple[int, int]]:
    """Positions between ``lo`` and ``hi`` where a cut may go, with their strengths; ``ends`` are sentence ends."""
    strength: dict[int, int] = {}
    for m in _BLANK.finditer(text, lo, hi):
        strength[m.start()] = WORD
    for m in _CLAUSE.finditer(text, lo, hi):
        strength[m.end()] = CLAUSE
    for e in ends:
        after = text[e : e + 80].lstrip(" \t　 ")[:1]
        rest = e
        while rest < hi and text[rest].isspace():
            rest += 1
        gap = text[e:rest]
        strength[e] = PARAGRAPH if _BREAKS.search(gap) else LINE if after in _LINE_END and after else SENTENCE
    return sorted((p, s) for p, s in strength.items() if lo < p < hi)


def _cuts(text: str, lo: int, hi: int, marks: list[tuple[int, int]], limit: int, overlap: int) -> list[int]:
    """Where to cut. The targets are equal lengths of what is left for the least number of pieces it needs; where a
    limit fails at a target, one piece more is planned from there on and the cuts before it stay."""
    step = limit - overlap
    left = 1 + -(-(hi - lo - limit) // step)  # pieces to come, the present one included
    least = max(1, step // 8)
    at = [p for p, _ in marks]
    cuts: list[int] = []
    start = lo  # where the text not yet covered begins
    while left > 1:
        reach = step if cuts else limit
        first, last = max(start + least, hi - (left - 1) * step), min(start + reach, hi - 1)
        if first > last:
            if hi - start <= reach:
                break
            left += 1
            continue
        target = start + ((hi - start) / left if cuts else (hi - start + (left - 1) * overlap) / left)
        window = marks[bisect.bisect_left(at, first) : bisect.bisect_right(at, last)]
        near = [m for m in window if abs(m[0] - target) <= step / 4]
        best = max(near or window, key=lambda m: (m[1], -abs(m[0] - target)), default=None)
        if best is None or best[1] < SENTENCE:
            strong = [m for m in window if m[1] >= SENTENCE]
            if strong:
                best = min(strong, key=lambda m: abs(m[0] - target))
            elif any(s >= SENTENCE for _, s in marks[bisect.bisect_left(at, start + least) : bisect.bisect_left(at, first)]):
                left += 1  # a sentence ends before the window that the pieces left allow
                continue
        cut = best[0] if best else int(min(max(target, first), last))
        if not best:
            while cut > first and (unicodedata.combining(text[cut]) or unicodedata.category(text[cut])[0] == "M" or text[cut - 1] == "\u200d"):
                cut -= 1
        cuts.append(cut)
        start = cut
        left -= 1
    return cuts


def pieces(text: str, lo: int, hi: int, ends: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text[lo:hi]``; each starts ``overlap`` characters before the end of the last."""
    if hi - lo <= limit:
        return [(lo, hi)] if hi > lo else []
    cuts = _cuts(text, lo, hi, boundaries(text, lo, hi, ends), limit, overlap)
    return [(max(lo, a - overlap) if k else lo, b) for k, (a, b) in enumerate(zip([lo, *cuts], [*cuts, hi]))]


def split(df: DataFrame, limit: int = 420, overlap: int = 60, id_col: str = "chunk_id", path_col: str = "source_path", text_col: str = "text", keep_short: bool = False) -> DataFrame:
    """One row per piece of each text that has more than ``limit`` characters without white space at its ends:
    ``(id_col, path_col, piece_no, n_pieces, start_pos, end_pos, piece)``.

    Positions are code points of the stored text; a piece has at most ``limit`` characters and starts ``overlap``
    characters before the end of its predecessor. ``keep_short`` also gives the other texts, as one piece each. Null
    ids and texts, empty and blank texts give no row; of an id's repeated rows one counts (least path); null paths
    stay null; other columns are ignored."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    rows = df.select(df[id_col].alias("k"), df[path_col].alias("p"), df[text_col].alias("t")).where("k is not null and t is not null")
    if not keep_short:
        rows = rows.where(f"length(t) > {limit}")
    rows = rows.groupBy("k").agg(F.min("p").alias("p"), F.min("t").alias("t"))
    k, p = (rows.schema[c].dataType.simpleString() for c in "kp")

    def run(batches):
        names = ["k", "p", "piece_no", "n_pieces", "start_pos", "end_pos", "piece"]
        for batch in batches:
            texts = batch.column(2).to_pylist()
            long = [i for i, t in enumerate(texts) if len(t.strip()) > limit or keep_short and t.strip()]
            number, _, stops = spans_batch([texts[i] for i in long])
            ends: dict[int, list[int]] = {}
            for i, e in zip(number.tolist(), stops.tolist()):
                ends.setdefault(i, []).append(e)
            at, out = [], [[], [], [], [], []]
            for j, i in enumerate(long):
                t = texts[i]
                lo = len(t) - len(t.lstrip())
                got = pieces(t, lo, len(t.rstrip()), ends.get(j, []), limit, overlap)
                for no, (a, b) in enumerate(got):
                    at.append(i)
                    for column, value in zip(out, (no, len(got), a, b, t[a:b])):
                        column.append(value)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(c, pa.int32()) for c in out[:4]), pa.array(out[4], pa.string())], names)

    out = rows.mapInArrow(run, f"k {k}, p {p}, piece_no int, n_pieces int, start_pos int, end_pos int, piece string")
    return out.withColumnsRenamed({"k": id_col, "p": path_col})

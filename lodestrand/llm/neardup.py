"""Near-duplicate texts by a chosen-path set similarity join.

Texts that differ in nothing but marks, case and codes form one class and are compared once. A class has a signature
of minwise hashes of its distinct 5-character substrings. Independent trees branch the classes: at a node some
positions of the signature are chosen from the node's own hash, and a class goes to the child of its minwise token at
each. Nodes of at most ``LEAF`` classes are compared exhaustively on the signatures; larger ones branch again, so only
crowded parts of the collection go deeper. A node whose classes are too alike to be parted by a token is compared as it
stands, and crowds of variants of one text are held as balls, whose members need no comparison with each other. Pairs
that may be similar are verified on their substrings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm import forms
from lodestrand.llm.components import component_of
from lodestrand.llm.grams import distinct_grams, grams, mixed
from lodestrand.session import dropped, shuffle_partitions, staged

GRAM = 5
POSITIONS, LANES, LANE_BITS = 28, 7, 9  # 4 words of 7 lanes; a lane holds 8 bits of a minwise hash below a guard bit
LEAF = 64
HOT = 16_384  # rows of a node that one task may hold; larger nodes stay spread
CROWD = 64  # classes with an equal word of their signatures from which a ball is tried
TREES = 5
BRANCHES = 2
DEPTH = 12
SLACK_BIT = 32  # the bits from here on of a row's used positions hold its slack
PLACES = np.int64((1 << POSITIONS) - 1)
_GUARD = np.uint64(sum(1 << (LANE_BITS * i + 8) for i in range(LANES)))
_LOW = np.uint64(sum(0xFF << (LANE_BITS * i) for i in range(LANES)))
SKETCH = ["s0", "s1", "s2", "s3"]


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Packed minwise hashes (texts x 4 words) of substring hashes with offsets."""
    n = len(at) - 1
    out = np.zeros((n, 4), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        seeds = np.random.default_rng(20).integers(1, 1 << 62, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for i in range(POSITIONS):
            least = np.minimum.reduceat((h * seeds[i]) >> np.uint64(24), at[some])
            out[some, i // LANES] |= (mixed(least, i) & np.uint64(0xFF)) << np.uint64(LANE_BITS * (i % LANES))
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positions of two packed signatures agree."""
    return POSITIONS - np.bitwise_count((((a ^ b) + _LOW) & _GUARD)).sum(1)


def agreeing_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positions agree, of every signature of ``a`` with every one of ``b``."""
    out = np.full((len(a), len(b)), POSITIONS, np.int8)
    for i in range(4):
        out -= np.bitwise_count((((a[:, None, i] ^ b[None, :, i]) + _LOW) & _GUARD)).astype(np.int8)
    return out


def _lanes(s: np.ndarray) -> np.ndarray:
    return np.stack([(s[:, i // LANES] >> np.uint64(LANE_BITS * (i % LANES))) & np.uint64(0xFF) for i in range(POSITIONS)], axis=1)


def _children(node: np.ndarray, used: np.ndarray, s: np.ndarray, branches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, child nodes and used positions: every row goes on to ``branches`` children."""
    lanes = _lanes(s)
    rows = np.arange(len(node))
    out = []
    for _ in range(branches):
        # the positions come from the node alone, so all its classes branch alike; used ones are passed over
        place = (mixed(node, 77 + len(out)) % np.uint64(POSITIONS)).astype(np.int64)
        for _ in range(POSITIONS):
            taken = (used >> place) & 1 == 1
            if not taken.any():
                break
            place = np.where(taken, (place + 1) % POSITIONS, place)
        used = used | (np.int64(1) << place)
        child = mixed(node ^ mixed(lanes[rows, place] + (place.astype(np.uint64) << np.uint64(16)), 5), 9)
        out.append((rows, child, place))
    base = used  # positions chosen by a sibling stay open to a path: only its own one is used
    for _, _, place in out:
        base = base & ~(np.int64(1) << place)
    return np.concatenate([r for r, _, _ in out]), np.concatenate([c for _, c, _ in out]), np.concatenate([base | (np.int64(1) << p) for _, _, p in out])


def _schema() -> str:
    return "node long, cls long, other long, used long, s0 long, s1 long, s2 long, s3 long"


def _batch(node, cls, other, used, s) -> pa.RecordBatch:
    n = len(cls)
    mask = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.record_batch([mask(node), mask(cls), mask(other), mask(used), *(mask(None if s is None else s[:, i]) for i in range(4))], ["node", "cls", "other", "used", *SKETCH])


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in SKETCH], axis=1)


def _roots(trees: int, branches: int, names_only: bool = False):
    def run(batches):
        for batch in batches:
            cls, slack, s = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), _words(batch)
            for tree in range(trees):
                node = np.full(len(cls), mixed(np.array([tree], np.uint64), 3)[0], np.uint64)
                rows, node, used = _children(node, slack << np.int64(SLACK_BIT), s, branches)
                # one token parts no large collection into small nodes: the first nodes branch without being counted
                more, node, used = _children(node, used, s[rows], 1)
                yield pa.record_batch([pa.array(node.view(np.int64))], ["node"]) if names_only else _batch(node, cls[rows][more], None, used, s[rows][more])

    return run


def _likeness(node: np.ndarray, used: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by node and class: the summed share of agreeing unused positions of a row with the three rows
    after it in its node, and the number of these. Classes are hashes, so these are pairs at random."""
    total, n = np.zeros(len(node)), np.zeros(len(node))
    taken = np.bitwise_count((used & PLACES).view(np.uint64)).astype(np.int64)
    for shift in (1, 2, 3):
        at = np.flatnonzero(node[shift:] == node[:-shift]) if shift < len(node) else []
        if len(at):
            total[at] += np.maximum(agreeing(s[at], s[at + shift]) - taken[at], 0) / (POSITIONS - taken[at])
            n[at] += 1
    return total, n


def _compared(c: np.ndarray, slack: np.ndarray, s: np.ndarray, least: int, other: tuple | None = None):
    """Pairs of one node's rows, or of its rows and ``other`` rows, whose signatures agree in enough positions."""
    c2, slack2, s2 = other or (c, slack, s)
    for a in range(0, len(c), 64):
        first = 0 if other else a
        hit = agreeing_all(s[a : a + 64], s2[first:]) >= least - slack[a : a + 64, None] - slack2[None, first:]
        x, y = np.nonzero(hit)
        x, y = x + a, y + first
        keep = c[x] != c2[y] if other else x < y
        if keep.any():
            x, y = c[x[keep]], c2[y[keep]]
            yield _batch(None, np.minimum(x, y), np.maximum(x, y), None, None)


def _grow(least: int, leaf: int, branches: int):
    """Over rows sorted by node and class: compare small nodes and those whose classes are too alike for a token to part
    them, branch the others. A node here has ``HOT`` rows at most, and one node is held at a time."""

    def work(node, cls, used, s):
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(starts, append=len(node))
        total, n = _likeness(node, used, s)
        alike = np.add.reduceat(total, starts) >= np.add.reduceat(n, starts) / branches
        dense = (size > leaf) & alike
        slack = used >> np.int64(SLACK_BIT)
        small = np.flatnonzero(np.repeat((size <= leaf) & (size > 1), size))
        m, c, w, more = node[small], cls[small], s[small], slack[small]
        for shift in range(1, leaf):
            at = np.flatnonzero(m[shift:] == m[:-shift]) if shift < len(m) else []
            if not len(at):
                break
            hit = at[agreeing(w[at], w[at + shift]) >= least - more[at] - more[at + shift]]
            if len(hit):
                a, b = c[hit], c[hit + shift]
                yield _batch(None, np.minimum(a, b), np.maximum(a, b), None, None)
        for k in np.flatnonzero(dense).tolist():
            own = slice(starts[k], starts[k] + size[k])
            yield from _compared(cls[own], slack[own], s[own], least)
        grow = np.flatnonzero(np.repeat((size > leaf) & ~alike, size))
        for a in range(0, len(grow), 20_000):
            part = grow[a : a + 20_000]
            rows, child, new = _children(node[part], used[part], s[part], branches)
            yield _batch(child, cls[part][rows], None, new, s[part][rows])

    def run(batches):
        held = None
        for batch in batches:
            new = (batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _words(batch))
            if not len(new[0]):
                continue
            rows = new if held is None else tuple(np.concatenate([x, y]) for x, y in zip(held, new))
            last = int(np.searchsorted(rows[0].view(np.int64), rows[0].view(np.int64)[-1], "left"))
            held = tuple(x[last:] for x in rows)
            if last:
                yield from work(*(x[:last] for x in rows))
        if held is not None:
            yield from work(*held)

    return run


def _branched(branches: int):
    """Branch every row, wherever it lies."""

    def run(batches):
        for batch in batches:
            node, cls, used, s = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _words(batch)
            rows, child, new = _children(node, used, s, branches)
            yield _batch(child, cls[rows], None, new, s[rows])

    return run


def _measured(batches):
    """``(node, total, n)``: likeness sums of parts of nodes."""
    for batch in batches:
        node = batch.column(0).to_numpy().view(np.uint64)
        total, n = _likeness(node, batch.column(2).to_numpy(), _words(batch))
        yield pa.record_batch([batch.column(0), pa.array(total), pa.array(n)], ["node", "total", "n"])


def members(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k, cls, s0..s3)``: class and signature of every text that has a substring of ``GRAM`` letters."""
    rows = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first in range(0, len(texts), 2000):
                data, offsets = forms.letters_batch(texts[first : first + 2000])
                h, at = grams(data, offsets, GRAM)
                s = sketches(h, at)
                raw, ends = data.astype("<u4").tobytes(), (offsets * 4).tolist()
                cls = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(ends, ends[1:])], np.uint64).view(np.int64)
                some = np.flatnonzero(np.diff(at))
                yield pa.record_batch([batch.column(0).take(pa.array(first + some)), pa.array(cls[some]), *(pa.array(s[some, i].view(np.int64)) for i in range(4))], ["k", "cls", *SKETCH])

    keyed = rows.mapInArrow(run, f"k {kind}, cls long, s0 long, s1 long, s2 long, s3 long")
    return keyed.groupBy("k").agg(F.min(F.struct("cls", *SKETCH)).alias("r")).select("k", "r.*")


def _crowded(rows: DataFrame, least: int, block: int) -> DataFrame:
    """Pairs of nodes of any size, compared in blocks of about ``block`` classes, each pair of blocks a group of its
    own, so no task gets a whole node."""
    sizes = rows.groupBy("node").agg(F.count("*").alias("n"))
    cut = rows.select("node", "cls", "used", *SKETCH).join(sizes, "node").withColumn("b", F.ceil(F.col("n") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("cls", "node"), F.col("b")).cast("int"))
    cut = cut.select("node", "cls", "used", *SKETCH, "i", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("j"))
    cut = cut.select("node", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("own"), "cls", "used", *SKETCH)

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.column("own").to_numpy()
        cls, slack = table.column("cls").to_numpy(), table.column("used").to_numpy() >> np.int64(SLACK_BIT)
        s = np.stack([table.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1)
        left = own == table.column("lo").to_numpy()
        same = bool(len(own)) and table.column("lo")[0] == table.column("hi")[0]
        pairs = _compared(cls, slack, s, least) if same else _compared(cls[left], slack[left], s[left], least, (cls[~left], slack[~left], s[~left]))
        found = [x.select(["cls", "other"]) for x in pairs]
        return pa.Table.from_batches(found, pa.schema([("cls", pa.int64()), ("other", pa.int64())])).rename_columns(["a", "b"])

    return cut.groupBy("node", "lo", "hi").applyInArrow(compare, "a long, b long")


def class_links(classes: DataFrame, least: int, trees: int = TREES, branches: int = BRANCHES, leaf: int = LEAF, depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """Pairs ``(a, b)`` of classes whose signatures agree in at least ``least`` positions (less the slack of both), from
    ``(cls, slack, s0..s3)``.

    A node whose classes agree so much that branching would not lower the comparisons (the chance that two of them
    agree at a position is ``1 / branches`` or more) is compared as it stands instead of branching on. Nodes of more
    than ``hot`` rows are counted beforehand and never gathered: they branch where they lie or are compared in blocks."""
    n = shuffle_partitions(classes.sparkSession)
    start = classes.select("cls", "slack", *SKETCH)
    rows = start.mapInArrow(_roots(trees, branches), _schema())
    names = start.mapInArrow(_roots(trees, branches, names_only=True), "node long")
    found, levels = [], []
    columns = ["node", "cls", "used", *SKETCH]
    for level in range(depth):
        crowds = staged(names.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > hot), "crowds")
        levels.append(crowds)
        cool, grown = rows.select(columns), []
        if not crowds.isEmpty():
            warm = rows.select(columns).join(crowds, "node")
            salted = warm.withColumn("salt", F.pmod("cls", F.ceil(F.col("n") / hot))).drop("n")
            parts = salted.repartition(n, "node", "salt").sortWithinPartitions("node", "cls").select(columns).mapInArrow(_measured, "node long, total double, n double")
            dense = staged(parts.groupBy("node").agg((F.sum("total") >= F.sum("n") / branches).alias("dense")), "dense")
            levels.append(dense)
            warm = warm.select(columns).join(dense, "node")
            found.append(_crowded(warm.where("dense"), least, hot // 2))
            grown.append(warm.where("not dense").select(columns).mapInArrow(_branched(branches), _schema()))
            cool = cool.join(crowds, "node", "left_anti")
        # rows of a node meet in one task and pass through it; at most one node is held
        grown.append(cool.repartition(n, "node").sortWithinPartitions("node", "cls").mapInArrow(_grow(least, leaf, branches), _schema()))
        done = staged(grown[0].union(grown[1]) if len(grown) > 1 else grown[0], f"level{level}")
        levels.append(done)
        found.append(done.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
        rows = done.where("other is null")
        names = rows.select("node")
        if rows.isEmpty():
            break
    else:
        found.append(_crowded(rows, least, hot // 2))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = staged(out.distinct(), "pairs")
    for level in levels:
        dropped(level)
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(a, b, least)`` that reach their least similarity, as ``(a, b, similarity)``; ``texts`` has
    ``(cls, t)``."""
    rows = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches):
        for batch in batches:
            a, b, least = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy()
            score = []
            for first in range(0, len(a), 1000):
                x, y = a[first : first + 1000], b[first : first + 1000]
                h, at = distinct_grams(*forms.letters_batch(x + y), GRAM)
                for i in range(len(x)):
                    p, q = h[at[i] : at[i + 1]], h[at[len(x) + i] : at[len(x) + i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    score.append(both / (len(p) + len(q) - both))
            keep = pa.array(np.flatnonzero(np.array(score) >= least - 1e-12))
            yield pa.record_batch([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(score, pa.float64()).take(keep)], ["a", "b", "similarity"])

    return rows.select("a", "b", "ta", "tb", F.col("least").cast("double")).mapInArrow(run, "a long, b long, similarity double")


def ball_candidates(classes: DataFrame, crowd: int = CROWD) -> DataFrame | None:
    """``(cls, ball)``: classes that share a word of their signatures with more than ``crowd`` others, with a class that
    may stand for them; None where there is no such crowd. Later words take over the class that earlier ones chose."""
    words = classes.select("cls", F.posexplode(F.array(*SKETCH)).alias("j", "w"))
    crowds = staged(words.groupBy("j", "w").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("j", "w"), "words")
    if crowds.isEmpty():
        return None
    words = staged(words.join(crowds, ["j", "w"]), "crowded")
    chosen = None
    for j in range(len(SKETCH)):
        own = words.where(F.col("j") == j).select("cls", "w")
        own = own.withColumn("ball", F.lit(None).cast("long")) if chosen is None else own.join(chosen, "cls", "left")
        stands = own.groupBy("w").agg(F.coalesce(F.min("ball"), F.min("cls")).alias("m"))
        new = own.where("ball is null").join(stands, "w").select("cls", F.col("m").alias("ball"))
        chosen = staged(new if chosen is None else chosen.union(new), "chosen")
    return chosen


class NearDuplicates:
    """Near-duplicate texts of a table: ``links()`` and ``groups()``, and ``pairs()`` which spells them out.

    ``similarity`` is the least share of the distinct 5-character substrings (letters only) of either text that occur
    in both. Null ids and texts and texts of fewer than 5 letters take part in nothing; an id's repeated rows count
    once; copies form one class; other columns are ignored; an empty table gives empty results.

    Crowds of variants of one text are held as balls: each member was found to be at most half the permitted distance
    (one less the similarity, a metric) away from the class that stands for it, so any two members are linked and need
    no comparison. Outside classes are compared with the one that stands for a ball; the triangle inequality then
    decides for all members, or they are compared one by one where it leaves the matter open."""

    def __init__(self, df: DataFrame, similarity: float = 0.7, id_col: str = "chunk_id", text_col: str = "text") -> None:
        self.id_col = id_col
        self.members = staged(members(df, id_col, text_col), "members")
        self.own = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
        classes = self.members.groupBy("cls").agg(F.min("k").alias("k"), *(F.first(c).alias(c) for c in SKETCH))
        self.named = classes.select("cls", "k")
        units, self.balls, radii = classes.withColumn("slack", F.lit(0)), None, None
        if (crowded := ball_candidates(classes)) is not None:
            near = crowded.where("cls <> ball").select(F.col("ball").alias("a"), F.col("cls").alias("b"), F.lit((1 + similarity) / 2).alias("least"))
            near = staged(_verified(near, self._texts(near)), "ball")
            inside = near.select(F.col("b").alias("cls"), F.col("a").alias("ball"), (1 - F.col("similarity")).alias("d"))
            stands = near.select(F.col("a").alias("cls"), F.col("a").alias("ball"), F.lit(0.0).alias("d")).distinct()
            self.balls = staged(inside.union(stands), "balls")
            radii = staged(self.balls.groupBy("ball").agg(F.max("d").alias("r"), F.count("*").alias("n")), "radii")
            alone = classes.join(self.balls.where("cls <> ball").select("cls"), "cls", "left_anti")
            units = alone.join(radii.select(F.col("ball").alias("cls"), "r"), "cls", "left").withColumn("slack", F.coalesce(F.ceil(F.col("r") * POSITIONS), F.lit(0)).cast("int"))
        spread = (POSITIONS * similarity * (1 - similarity)) ** 0.5
        pairs = class_links(units, int(POSITIONS * similarity - 3.2 * spread))
        if radii is None:
            pairs = pairs.withColumn("reach", F.lit(0.0))
        else:
            r = lambda c: radii.select(F.col("ball").alias(c), F.col("r").alias("r" + c))
            pairs = pairs.join(r("a"), "a", "left").join(r("b"), "b", "left").select("a", "b", (F.coalesce("ra", F.lit(0.0)) + F.coalesce("rb", F.lit(0.0))).alias("reach"))
        wanted = pairs.withColumn("least", similarity - F.col("reach"))
        linked = staged(_verified(wanted, self._texts(wanted)), "links")
        self.whole = None
        if radii is not None:
            linked = self._spelled_out(linked, pairs, similarity)
        self.linked = linked

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """``(cls, t)``: a text of each class of the pairs."""
        wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        return staged(self.own.join(self.named.join(wanted, "cls", "left_semi"), "k").groupBy("cls").agg(F.min("t").alias("t")), "texts")

    def _spelled_out(self, linked: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
        """The explicit links; sets ``whole``, the pairs of balls (or of a ball and a class) linked altogether."""
        far = F.lit(1 - similarity)
        linked = staged(linked.join(pairs, ["a", "b"]), "reached")
        all_in = (F.col("reach") > 0) & (1 - F.col("similarity") + F.col("reach") <= far - 1e-9)
        self.whole = linked.where(all_in).select("a", "b")
        single = linked.where("reach = 0").select("a", "b", "similarity")
        side = lambda c: self.balls.select(F.col("ball").alias(c), F.col("cls").alias("x" + c), F.col("d").alias("d" + c))
        part = linked.where((F.col("reach") > 0) & ~all_in).join(side("a"), "a", "left").join(side("b"), "b", "left")
        part = part.select(F.coalesce("xa", "a").alias("a"), F.coalesce("xb", "b").alias("b"), (1 - F.col("similarity")).alias("d"), (F.coalesce("da", F.lit(0.0)) + F.coalesce("db", F.lit(0.0))).alias("e"))
        part = staged(part.where(F.col("d") - F.col("e") <= far), "open")
        sure = part.where(F.col("d") + F.col("e") <= far - 1e-9).select("a", "b", F.lit(None).cast("double").alias("similarity"))
        unsure = part.where(F.col("d") + F.col("e") > far - 1e-9).select("a", "b", F.lit(similarity).alias("least"))
        return staged(single.union(sure).union(_verified(unsure, self._texts(unsure))), "explicit")

    def links(self) -> DataFrame:
        """``(a, b, similarity)`` between classes: links found one by one (no similarity where the triangle inequality
        proved one), each ball's members with the class that stands for it, and balls linked altogether. With
        ``class_id`` and ``ball_id`` of ``groups()`` these are all links."""
        if self.balls is None:
            return self.linked
        inside = self.balls.where("cls <> ball").select(F.col("ball").alias("a"), F.col("cls").alias("b"), (1 - F.col("d")).alias("similarity"))
        return self.linked.union(inside).union(self.whole.select("a", "b", F.lit(None).cast("double").alias("similarity")))

    def class_pairs(self) -> DataFrame:
        """Every linked pair ``(a, b)`` of classes."""
        out = self.linked.select("a", "b")
        if self.balls is None:
            return out
        side = lambda c: self.balls.select(F.col("ball").alias(c), F.col("cls").alias("x" + c))
        inside = side("a").join(side("b"), F.col("a") == F.col("b")).where("xa < xb").select("xa", "xb")
        across = self.whole.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("xa", "a"), F.coalesce("xb", "b"))
        return out.union(inside).union(across)

    def pairs(self) -> DataFrame:
        """Every pair of ids, the smaller first, spelled out from links and membership: as many rows as there are pairs,
        so a group of n copies gives n (n - 1) / 2. ``links()`` and ``groups()`` hold the same in linear size."""
        m = self.members.select("k", "cls")
        across = self.class_pairs().join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select("x", "y")
        several = m.join(m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"), "cls", "left_semi").select("k", "cls")
        within = several.toDF("x", "cls").join(several.toDF("y", "cls"), "cls").where("x < y").select("x", "y")
        both = across.union(within)
        return both.select(F.least("x", "y").alias(f"{self.id_col}_a"), F.greatest("x", "y").alias(f"{self.id_col}_b"))

    def groups(self) -> DataFrame:
        """One row per id: ``(id, group_id, class_id, ball_id, n_copies, n_links)``; ``group_id`` is the least class of
        those that are linked, directly or through others, ``ball_id`` the class that stands for the id's ball (null
        outside of one), ``n_links`` the number of other classes linked to the id's own."""
        own = component_of(self.links().select("a", "b"))
        degree = self.linked.select(F.col("a").alias("cls")).union(self.linked.select("b")).groupBy("cls").agg(F.count("*").alias("n_links"))
        sizes = self.members.groupBy("cls").agg(F.count("*").alias("n_copies"))
        rows = self.members.select("k", "cls").join(sizes, "cls").join(degree, "cls", "left").join(own.withColumnRenamed("node", "cls"), "cls", "left")
        links = F.coalesce("n_links", F.lit(0).cast("long"))
        if self.balls is None:
            rows = rows.withColumn("ball", F.lit(None).cast("long"))
        else:
            inside = self.balls.groupBy("ball").agg(F.count("*").alias("size"))
            rows = rows.join(self.balls.select("cls", "ball"), "cls", "left").withColumn("unit", F.coalesce("ball", "cls"))
            both = self.whole.union(self.whole.select("b", "a")).toDF("unit", "ball").join(inside, "ball", "left")
            whole = both.groupBy("unit").agg(F.sum(F.coalesce("size", F.lit(1))).alias("n_whole"))
            rows = rows.join(inside.withColumnRenamed("ball", "unit"), "unit", "left").join(whole, "unit", "left")
            links = links + F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("n_whole", F.lit(0))
        return rows.select(F.col("k").alias(self.id_col), F.coalesce("component", "cls").alias("group_id"), F.col("cls").alias("class_id"), F.col("ball").alias("ball_id"), "n_copies", links.alias("n_links"))

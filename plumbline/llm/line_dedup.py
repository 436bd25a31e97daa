"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines of at least `min_chars` code points (without spaces at the ends; with `collapse` each run of white space is one space)
are compared over the whole corpus. The threshold is one number of edits, or steps (length, edits): the length of the
shorter of two lines decides. Three levels find the candidates, and banded bit-parallel edit distance verifies them:

1. Segments. Two lines within t edits have one of t + 1 segments of the shorter one in common, with exactly as many edits
   before it as there are segments before it. So segment i moves by at most i places seen from the left end and t - i seen
   from the right, and is read from the nearer end. Segment lengths follow a length class, not the length, so that one
   entry serves lines of all lengths of its class; a line just above a class enters the class below too.
2. Under each shared segment all lines are held against one lead and joined by what is verified. Segments that then
   still hold several classes are paired line by line if they hold few lines; only pairs with nearly the same counts of signs are kept.
3. The others are split further: the place of the edits is narrowed piece by piece (all outside must be equal) until a few code points
   are left, and their deletion neighbourhood is the last key. What all lines of a key have in common at the ends of a piece is
   taken off before it is split, and a state carries only what is left: lines that differ in a number inside a long common template
   soon are their numbers alone and meet only where these are near.

Lines joined by links, also over several steps, form a class; its first occurrence (smallest doc_id, then line number)
stays and the others go. Exact copies are merged before the join, so a line that fills a third of all rows is one line there.

Defined cases: a null text stays null and takes no part; rows with a null doc_id pass unchanged; rows that repeat a doc_id
share their decisions per line number and line; an empty document stays as it is; a document whose lines all go keeps
the empty text; an empty table gives an empty one. All other columns are carried along under whatever name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

THRESHOLD = 1
MIN_CHARS = 60
#: The registered jobs compare all lines of this length on; shorter ones ("}", "else:") mean nothing alone.
JOB_CHARS = 10
#: Edits the registered jobs allow, by the length from which they hold.
JOB_STEPS = ((0, 1), (20, 2))
#: Rows of a table that is broadcast, of two longs each; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A key of several classes with more lines is split further.
FEW_LINES = 16
#: The same for the states of lines, where a pair meets about once: up to here the counts of signs are compared pair by pair.
FEW_STATES = 256
#: Pieces into which a gap is split, and the length from which its deletion neighbourhood is taken instead.
PIECES, LAST_GAP = 3, 8

#: Signs whose counts rule out most candidates before they are compared; any set of signs gives the same result.
SIGNS = "aeionrstdhlu0123456789"

KEY = ["a", "b"]
Threshold = int | tuple[tuple[int, int], ...]


def steps_of(threshold: Threshold) -> tuple[tuple[int, int], ...]:
    return ((0, threshold),) if isinstance(threshold, int) else threshold


def most_edits(threshold: Threshold) -> int:
    return max(t for _, t in steps_of(threshold))


def allowed(length: Column, threshold: Threshold) -> Column:
    """The edits allowed to a line of that length and a longer one."""
    return reduce(lambda out, step: F.when(length >= step[0], F.lit(step[1])).otherwise(out), steps_of(threshold), F.lit(0))


def normal(text: Column) -> Column:
    """Texts with each run of white space inside a line as one space."""
    some = text.contains("  ")
    for c in "\t\x0b\f\r":
        some = some | text.contains(c)
    return F.when(some, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)


def exploded(docs: DataFrame, min_chars: int, collapse: bool = False) -> DataFrame:
    """(doc_id, line_no, line) of the lines that take part."""
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split(normal(F.col("text")) if collapse else "text", "\n")).alias("line_no", "raw"))
    lines = lines.select("doc_id", "line_no", F.trim("raw").alias("line"))
    return lines.where(F.length("line") >= min_chars)


def named(line: Column) -> list[Column]:
    """A 128-bit name of a line."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")]


def class_of(length: Column) -> Column:
    """The smallest length of the length class: the four leading binary digits."""
    width = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(length)) - 3)).cast("int")
    return length - length % width


def segment_keys(lines: DataFrame, threshold: Threshold) -> DataFrame:
    """lines with `keys`, the segment keys of `line`; the last bit tells a segment of the line (1) from a probe (0)."""
    n = F.length("line").cast("int")
    most = most_edits(threshold)
    # the classes of the lengths that a line near this one and not longer may have
    lines = lines.select("*", n.alias("__n"), *[f(n - d).alias(f"__{c}{d}") for d in range(most + 1) for c, f in (("low", class_of), ("t", lambda m: allowed(m, threshold)))])
    keys = []
    for d in range(most + 1):
        low, t = F.col(f"__low{d}"), F.col(f"__t{d}")
        fits = (F.col("__n") > d) & (t >= d)
        if d:
            fits = fits & ((low != F.col(f"__low{d - 1}")) | (t != F.col(f"__t{d - 1}")))
        for edits in sorted({e for _, e in steps_of(threshold)}):
            size = F.floor(low / (edits + 1)).cast("int")
            for i in range(edits + 1):
                moves = min(i, edits - i)
                for shift in range(moves + 1):
                    from_right = F.col("__n") - (edits - i) * size - shift - (size - moves)
                    at = from_right if i > edits - i else i * size + shift
                    h = F.xxhash64(F.lit(i), low, t, F.substring("line", at + 1, size - moves))
                    keys.append(F.when(fits & (t == edits), h.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(int(shift == 0)).cast("long"))))
    return lines.withColumn("keys", F.array_compact(F.array(*keys))).drop(*[c for c in lines.columns if c.startswith("__")])


def bound(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def band_state(x: Column, y: Column, edits: int) -> Column:
    """State of a banded bit-parallel comparison of two texts, after all of x. A word of 2 * edits + 1 bits, one for each diagonal of the band, stands for each number of errors."""
    band = 2 * edits + 1
    full = (1 << band) - 1
    if band * (edits + 1) > 63:
        raise ValueError("at most 4 edits")

    def equal(ys: Column, c: Column, i: Column) -> Column:
        bit = lambda d: F.when(F.get(ys, i + d) == c, F.lit(1 << d)).otherwise(F.lit(0))
        return reduce(Column.bitwiseOR, [bit(d) for d in range(band)]).cast("long")

    def step(state: Column, match: Column) -> Column:
        word = lambda e: F.shiftright(state, band * e).bitwiseAND(F.lit(full))
        new = [word(0).bitwiseAND(match)]
        for e in range(1, edits + 1):
            same, low = word(e).bitwiseAND(match), word(e - 1)
            new.append(same.bitwiseOR(low).bitwiseOR(F.shiftright(low, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full)))
        return reduce(Column.bitwiseOR, [F.shiftleft(w, band * e) for e, w in enumerate(new)])

    pad = F.array_repeat(F.lit(""), edits)
    start = sum(((1 << e + 1) - 1 << edits) << band * e for e in range(edits + 1))
    matches = bound(F.concat(pad, F.split(y, ""), pad), lambda ys: F.transform(F.split(x, ""), lambda c, i: equal(ys, c, i)))
    return F.aggregate(matches, F.lit(start).cast("long"), step)


def common_start(x: Column, y: Column, most: int = 1 << 20) -> Column:
    """The number of code points (up to 2 * most - 1) that two texts have in common at their start, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    room = F.least(F.length(x), F.length(y))
    return F.aggregate(F.filter(steps, lambda h: h <= room), F.lit(0), lambda at, h: F.when((at + h <= room) & (F.substring(x, at + 1, h) == F.substring(y, at + 1, h)), at + h).otherwise(at))


def edits_between(x: Column, y: Column, edits: int) -> Column:
    """The number of edits between two texts; null beyond `edits`. What they have in common at both ends is left out of the comparison."""
    more = F.length(y) - F.length(x)
    bit = lambda state, e: F.call_function("shiftright", state, (more + edits + (2 * edits + 1) * e).cast("int")).bitwiseAND(F.lit(1))

    def inner(c: Column) -> Column:
        least, most = F.least(F.length(c.x), F.length(c.y)), F.greatest(F.length(c.x), F.length(c.y))
        counted = bound(band_state(c.x, c.y, edits), lambda state: F.coalesce(*[F.when(bit(state, e) == 1, F.lit(e)) for e in range(edits + 1)]))
        return F.when(least == 0, F.when(most <= edits, most)).otherwise(counted)

    def without_end(c: Column) -> Column:
        cut = lambda t: F.substring(t, F.lit(1), F.length(t) - c.end)
        return bound(F.struct(cut(c.x).alias("x"), cut(c.y).alias("y")), inner)

    def without_start(at: Column) -> Column:
        rest = F.struct(F.substring(x, at + 1, F.length(x)).alias("x"), F.substring(y, at + 1, F.length(y)).alias("y"))
        ends = lambda r: bound(F.struct(F.reverse(r.x).alias("x"), F.reverse(r.y).alias("y")), lambda back: common_start(back.x, back.y))
        return bound(rest, lambda r: bound(F.struct(r.x.alias("x"), r.y.alias("y"), ends(r).alias("end")), without_end))

    return F.when(F.abs(more) <= edits, bound(common_start(x, y), without_start))


def _alike(most: int) -> Column:
    """Whether the counts of signs (sx, sy) of two lines allow so few edits: an edit changes the counts of two signs by one."""
    return reduce(Column.__add__, [F.abs(F.col("sx")[i] - F.col("sy")[i]) for i in range(len(SIGNS))]) <= 2 * most


def _verified(pairs: DataFrame, texts: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (x, y) of line names, both structs, whose lines are within the threshold."""
    most = most_edits(threshold)
    if not most:
        return pairs.limit(0)
    keyed = texts.select(F.struct(*KEY).alias("key"), "line", "signs")
    both = pairs.join(keyed.withColumnsRenamed({"key": "x", "line": "lx", "signs": "sx"}), "x").join(keyed.withColumnsRenamed({"key": "y", "line": "ly", "signs": "sy"}), "y")
    both = both.where(_alike(most))
    return both.where(edits_between(F.col("lx"), F.col("ly"), most) <= allowed(F.least(F.length("lx"), F.length("ly")), threshold)).select("x", "y")


def _first_gaps(lines: DataFrame, threshold: Threshold) -> DataFrame:
    """Lines (a, b, label, line) once for each length that a line near them and not longer may have: h, own and the one gap that is the whole line."""
    n = F.length("line").cast("int")
    gap = lambda m: F.array(F.struct(F.col("line").alias("text"), m.alias("len"), allowed(m, threshold).alias("edits")))
    starts = [F.when((n - d >= 1) & (allowed(n - d, threshold) >= F.greatest(F.lit(1), F.lit(d))), F.struct(F.xxhash64(n - d).alias("h"), F.lit(d == 0).alias("own"), gap(n - d).alias("gaps"))) for d in range(most_edits(threshold) + 1)]
    some = lines.select(*KEY, "label", F.explode(F.filter(F.array(*starts), lambda s: s.isNotNull())).alias("s"))
    return some.select(*KEY, "label", "s.h", "s.own", "s.gaps")


def _pieces(h: Column, gap: Column, rest: Column) -> Column:
    """Children of a state by the pieces of the gap that hold its first and its last edit; with two edits or more in different pieces, what lies between may have moved."""
    combos = [(i, j, s) for i in range(PIECES) for j in range(i, PIECES) for s in ((0,) if i == j else (0, -1, 1))]
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("ijs", c, strict=True)]) for c in combos])
    size = F.length(gap["text"])
    at = lambda k: F.floor(gap["len"] * k / PIECES).cast("int")
    part = lambda lo, hi: F.substring(gap["text"], lo + 1, F.greatest(hi - lo, F.lit(0)))
    new = lambda lo, hi, len_, e: F.struct(part(lo, hi).alias("text"), len_.alias("len"), e.alias("edits"))
    near = lambda lo, hi, len_, e: (hi >= lo) & (F.abs(hi - lo - len_) <= e)

    def child(c: Column) -> Column:
        lo, hi = at(c.i), size - (gap["len"] - at(c.j + 1))
        one, two = at(c.i + 1) + c.s, at(c.j) + c.s
        first, last = at(c.i + 1) - at(c.i), at(c.j + 1) - at(c.j)
        same = c.i == c.j
        inside = F.when(same, F.lit("")).otherwise(part(one, two))
        key = F.xxhash64(h, c.i, c.j, part(F.lit(0), lo), inside, part(hi, size))
        gaps = F.when(same, F.array(new(lo, hi, first, gap["edits"]))).otherwise(F.array(new(lo, one, first, F.lit(1)), new(two, hi, last, F.lit(1))))
        fits = F.when(same, near(lo, hi, first, gap["edits"])).otherwise(near(lo, one, first, F.lit(1)) & near(two, hi, last, F.lit(1)))
        return F.when(fits, F.struct(key.alias("h"), (c.s == 0).alias("own"), F.concat(gaps, rest).alias("gaps")))

    return F.array_compact(F.transform(F.filter(table, lambda c: (c.i == c.j) | (gap["edits"] > 1)), child))


def _variants(h: Column, gap: Column, rest: Column, most: int) -> Column:
    """Children of a state by what is left of a short gap without up to as many code points as edits are allowed."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    less = lambda many: F.array_distinct(F.concat(many, F.flatten(F.transform(F.filter(many, lambda t: F.length(t) > 0), shorter))))
    texts = [F.array(gap["text"])]
    for _ in range(most):
        texts.append(less(texts[-1]))
    chosen = F.element_at(F.array(*texts), gap["edits"] + 1) if most > 1 else texts[1]
    return F.transform(chosen, lambda t: F.struct(F.xxhash64(h, F.lit("left"), t).alias("h"), F.lit(True).alias("own"), rest.alias("gaps")))


def _split(states: DataFrame, most: int) -> DataFrame:
    """The states with their longest gap taken apart."""
    longest = F.array_max(F.transform("gaps", lambda g, i: F.struct(g["len"].alias("len"), i.alias("i"))))
    marked = states.withColumn("spot", longest["i"]).withColumn("gap", F.get("gaps", F.col("spot")))
    marked = marked.withColumn("rest", F.filter("gaps", lambda g, i: i != F.col("spot"))).withColumn("h", F.xxhash64("h", "spot"))
    args = [F.col(c) for c in ("h", "gap", "rest")]
    children = F.when(F.col("gap.len") > LAST_GAP, _pieces(*args)).otherwise(_variants(*args, most))
    some = marked.select(*KEY, "label", "own", F.explode(children).alias("s"))
    return some.select(*KEY, "label", F.col("s.h").alias("h"), (F.col("own") & F.col("s.own")).alias("own"), F.col("s.gaps").alias("gaps"))


def _trimmed(states: DataFrame, most: int) -> DataFrame:
    """The states without what all lines of their key have in common at the ends of a gap, and without the gaps that are then empty.

    What all texts have in common at an end is what the first and the last of them in order have in common, so that two values a key
    tell it. Equal ends of two texts change neither their distance nor, as they go from all lines of the key alike, its pieces.
    """
    text = lambda g: F.get("gaps", F.lit(g))["text"]
    aggregates = [f(v).alias(f"{c}{g}") for g in range(most) for c, f, v in (("low", F.min, text(g)), ("high", F.max, text(g)), ("back_low", F.min, F.reverse(text(g))), ("back_high", F.max, F.reverse(text(g))), ("least", F.min, F.length(text(g))), ("most", F.max, F.length(text(g))))]
    by = states.groupBy("h").agg(*aggregates)
    start = lambda g: F.coalesce(common_start(F.col(f"low{g}"), F.col(f"high{g}")), F.lit(0))
    end = lambda g: F.coalesce(common_start(F.col(f"back_low{g}"), F.col(f"back_high{g}")), F.lit(0))
    by = by.select("h", *[c for g in range(most) for c in (start(g).alias(f"start{g}"), end(g).alias(f"end{g}"), f"least{g}", f"most{g}")])
    ends = [F.struct(F.col(f"start{g}").alias("start"), F.least(f"end{g}", F.col(f"least{g}") - F.col(f"start{g}")).alias("end"), F.col(f"most{g}").alias("most")) for g in range(most)]
    by = by.select("h", F.array(*ends).alias("ends"))
    taken = lambda e: e["start"] + e["end"]

    def shorter(g: Column, i: Column) -> Column:
        e = F.get("ends", i)
        rest = F.struct(F.substring(g["text"], e["start"] + 1, F.length(g["text"]) - taken(e)).alias("text"), (g["len"] - taken(e)).alias("len"), g["edits"].alias("edits"))
        return F.when(e["most"] > taken(e), rest)

    return states.join(by, "h").select(*KEY, "label", "h", "own", F.array_compact(F.transform("gaps", shorter)).alias("gaps"))


def _mixed(rows: DataFrame) -> DataFrame:
    """(h, n, open): the keys of several classes with a line's own entry, their rows, and whether they have gaps left."""
    gaps = F.max(F.size("gaps") > 0) if "gaps" in rows.columns else F.lit(False)
    by = rows.groupBy("h").agg(F.count("*").alias("n"), gaps.alias("open"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("own").alias("any"))
    return by.where(F.col("any") & (F.col("low") != F.col("high"))).select("h", "n", "open")


def _against_lead(rows: DataFrame) -> DataFrame:
    """Pairs (x, y) of the lead of each key and its other lines; rows (h, a, b, own)."""
    first = F.struct(~F.col("own"), *KEY)
    lead = rows.groupBy("h").agg(F.min(first).alias("lead")).select("h", F.struct("lead.a", "lead.b").alias("x"))
    key = F.struct(*KEY)
    return rows.select("h", key.alias("y")).join(lead, "h").where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _each_pair(rows: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Pairs (x, y) of lines of different labels and like signs under the keys of `rows`, which hold few lines or near ones only."""
    key, rows = F.struct(*KEY), rows.join(texts.select(*KEY, "signs"), KEY)
    left = rows.where("own").select("h", key.alias("x"), F.col("label").alias("lx"), F.col("signs").alias("sx"))
    right = rows.select("h", key.alias("y"), F.col("label").alias("ly"), F.col("signs").alias("sy"), "own")
    once = ~F.col("own") | (F.col("x") < F.col("y"))  # two lines with an own entry would meet twice
    return left.join(right, "h").where((F.col("lx") != F.col("ly")) & once & _alike(most)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of their line: the line itself where it has no link."""
    known = labels.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("label").alias("__label"))
    return rows.drop("label").join(known, KEY, "left").withColumn("label", F.coalesce("__label", F.struct(*KEY))).drop("__label")


def similar_lines(shared: DataFrame, texts: DataFrame, threshold: Threshold) -> DataFrame:
    """Links (x, y) that join all lines within the threshold; shared has the rows (h, a, b, own) of the segment keys of several lines."""
    most = most_edits(threshold)
    found = [cut(_verified(_against_lead(shared), texts, threshold))]
    every = lambda: reduce(DataFrame.union, found)
    if not most:
        return every()
    rows = cut(_labelled(shared, components(every())))
    mixed = cut(_mixed(rows))
    under = lambda rows, keys: rows.join(keys.select("h"), "h", "left_semi")
    few, last = [under(rows, mixed.where(F.col("n") <= FEW_LINES)).select("h", *KEY, "label", "own")], []
    states = cut(_first_gaps(under(rows, mixed.where(F.col("n") > FEW_LINES)).select(*KEY, "label").distinct().join(texts, KEY), threshold))
    while True:
        mixed, done = cut(_mixed(states)), F.size("gaps") == 0
        few.append(under(states.where(~done), mixed.where(F.col("n") <= FEW_STATES)).select("h", *KEY, "label", "own"))
        last.append(under(states.where(done), mixed).select("h", *KEY, "label", "own"))
        many = mixed.where(F.col("open") & (F.col("n") > FEW_STATES))
        if not many.limit(1).count():
            break
        states = cut(_split(_trimmed(cut(under(states, many)), most), most))
    # under the last keys there are near lines only: most of them are joined by the lead, the others pair by pair
    last = cut(reduce(DataFrame.union, last).distinct())
    found.append(cut(_verified(_each_pair(reduce(DataFrame.union, few), texts, most).union(_against_lead(last)).distinct(), texts, threshold)))
    if last.limit(1).count():
        last = cut(_labelled(last, components(every())))
        found.append(cut(_verified(_each_pair(last.join(_mixed(last), "h", "left_semi"), texts, most), texts, threshold)))
    return every()


def line_classes(docs: DataFrame, threshold: Threshold = THRESHOLD, min_chars: int = MIN_CHARS, collapse: bool = False) -> DataFrame:
    """(doc_id, line_no) of every occurrence that is not the first of its class."""
    line = F.col("line")
    occurrences = cut(segment_keys(exploded(docs, min_chars, collapse), threshold).select("doc_id", "line_no", *named(line), "keys"))
    place = F.struct("doc_id", "line_no")
    lines = cut(occurrences.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min(place).alias("first"), F.count("*").alias("n")).drop("doc_id"))

    under = occurrences.select(*KEY, F.explode("keys").alias("k")).select(*KEY, F.shiftrightunsigned("k", 1).alias("h"), (F.col("k") % 2 != 0).alias("own"))
    several = cut(under.groupBy("h").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.max("own").alias("any")).where(F.col("any") & (F.col("low") != F.col("high"))).select("h"))
    shared = cut(under.join(_small(several), "h", "left_semi").distinct())
    wanted = cut(lines.join(_small(shared.select(*KEY).distinct()), KEY, "left_semi").select(F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no")))
    near = docs.join(_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = exploded(near, min_chars, collapse).join(_small(wanted), ["doc_id", "line_no"], "left_semi").select(*named(line), "line")
    texts = cut(texts.join(shared.select(*KEY).distinct(), KEY, "left_semi").dropDuplicates(KEY).withColumn("signs", F.array(*[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in SIGNS])))
    labels = cut(components(similar_lines(shared, texts, threshold)).select("node.a", "node.b", "label"))

    first = F.col("first")
    linked = lines.join(labels, KEY).select(*KEY, "label", "first")
    keepers = linked.groupBy("label").agg(F.min(first).alias("keeper"))
    alone = lines.where("n > 1").join(labels.select(*KEY), KEY, "left_anti").select(*KEY, first.alias("keeper"))
    decided = cut(linked.join(keepers, "label").select(*KEY, "keeper").union(alone))
    return occurrences.select("doc_id", "line_no", *KEY).join(decided, KEY).where(place != F.col("keeper")).select("doc_id", "line_no")


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def dedup_lines(docs: DataFrame, threshold: Threshold = THRESHOLD, min_chars: int = MIN_CHARS, dropped: str | None = None, collapse: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of their text; `dropped` names an extra column for the dropped line numbers."""
    gone = line_classes(docs.select("doc_id", "text"), threshold, min_chars, collapse).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("__gone"))
    gone = gone.withColumnRenamed("doc_id", "__doc")
    out = docs.join(gone, docs["doc_id"] == gone["__doc"], "left").withColumn("__lines", F.when(F.col("__gone").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    if dropped:
        columns.append(F.coalesce("__gone", F.array().cast("array<int>")).alias(dropped))
    return out.select(*columns)

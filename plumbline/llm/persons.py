"""Names of persons learned from the corpus itself: which runs of capitalised words are persons, by case statistics and contexts.

A candidate is a run of two or three capitalised words (at the beginning of a sentence also without its first word). All
statistics cover the whole corpus. A word's lower share is the share of its occurrences in lower case; a run is common
if its first word has a share of half or more, or each of its words a fifth or more, or if it is the first of three and is capitalised only at beginnings
of sentences. Runs after a title or from a listed given name
on are positive examples, common runs negative ones. Their neighbours, words and endings are counted in a fixed number of
hashed buckets, and each run is scored by the log ratios of its features, contexts weighted by how often they occur; the runs accepted so
are examples of a second round. A run is judged once for the corpus, so that a name is found wherever it stands.

Defined cases: null and empty texts have no candidates; with fewer than LEAST_SEEDS examples of either kind nothing is learned and only
common runs are told (`vetoed`); repeated rows count as often as they occur. Runs of more than three words and words in capitals throughout are
no candidates, and scripts without capitals have none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, slices

_UPPER = "".join(chr(c) for c in range(0x41, 0x2C00) if chr(c).isupper())
_CAPITAL = rf"[{_UPPER}][^\W\d_][^\W\d_'-]*(?:['-][^\W\d_]+)*"
#: Maximal runs of capitalised words, with what stands before and after in the sentence.
RUN = re.compile(rf"(?<![\w'-]){_CAPITAL}(?:[ \u00a0]{_CAPITAL})+(?![\w-])")
BEFORE = re.compile(r"([^\W\d_][\w'-]*)(\.?)[ \u00a0,(\"]*$")
AFTER = re.compile(r"[ \u00a0,]*([^\W\d_][\w'-]*)")
#: A text without this has no candidate.
HINT = r"\p{Lu}[\p{L}'-]+[ \x{a0}]\p{Lu}\p{L}"
WORD = r"\p{L}[\p{L}'-]*"
#: Code points read before a run to find its neighbour.
REACH = 64

BUCKETS = 1 << 18
LEAST_SEEDS = 20
FIRST_SHARE, EVERY_SHARE = 0.5, 0.2
THRESHOLD = 0.0
#: Rounds of scoring; the runs accepted in one are positive examples of the next.
ROUNDS = 2
#: Different words of candidates that may be broadcast to prune the counts of all words; with more, all words are counted.
BROADCAST_WORDS = 1_000_000


def text_key() -> list[Column]:
    """A 128-bit key of the text."""
    return [F.xxhash64(F.lit(k), F.col("text")).alias(f"__k{k}") for k in (1, 2)]


def runs(text: str, titles: set[str]):
    """(start, end, previous word, next word, behind a title) of each candidate; `^` and `$` are the bounds of a sentence, and a title is passed over."""
    for m in RUN.finditer(text):
        s, e = m.span()
        e -= 2 * m.group().endswith("'s")
        lead = text[max(0, s - REACH) : s]
        b = BEFORE.search(lead)
        if titled := bool(b) and b.group(1) in titles:
            b = BEFORE.search(lead[: b.start()])
        prev = b.group(1).lower() if b and not b.group(2) else "^"
        a = AFTER.match(text, m.end())
        after = a.group(1).lower() if a else "$"
        words = list(re.finditer(r"[^ \u00a0]+", text[s:e]))
        for skip in (0, 1) if prev == "^" and not titled else (0,):
            rest = words[skip:]
            if 2 <= len(rest) <= 3 and not any(w.group().isupper() for w in rest):
                yield s + rest[0].start(), e, words[0].group().lower() if skip else prev, after, titled


def name_of(text: str) -> str:
    return text.replace("\u00a0", " ")


def candidates(docs: DataFrame, titles: set[str]) -> DataFrame:
    """(__k1, __k2, run, prev, next, titled, n) of the runs of all texts."""
    schema = pa.schema([("__k1", pa.int64()), ("__k2", pa.int64()), ("run", pa.string()), ("prev", pa.string()), ("next", pa.string()), ("titled", pa.bool_()), ("n", pa.int64())])

    def task(batches):
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                column, k1, k2 = part.column("text"), part.column("__k1").to_numpy(), part.column("__k2").to_numpy()
                seen: Counter = Counter()
                for i in np.flatnonzero(pc.match_substring_regex(pc.fill_null(column, ""), HINT).to_numpy(zero_copy_only=False)):
                    t = column[int(i)].as_py()
                    seen.update((int(k1[i]), int(k2[i]), name_of(t[s:e]), prev, after, titled) for s, e, prev, after, titled in runs(t, titles))
                rows = [(*k, n) for k, n in seen.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)

    return docs.where(F.col("text").isNotNull()).select("text", *text_key()).mapInArrow(lean(task), "__k1 long, __k2 long, run string, prev string, next string, titled boolean, n long")


def lower_shares(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(word, share) of each of the words (lower case): the share of its occurrences in all texts in lower case."""
    every = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("as_is")).withColumn("word", F.lower("as_is"))
    if words.count() <= BROADCAST_WORDS:
        every = every.join(F.broadcast(words), "word", "left_semi")
    counts = every.groupBy("word").agg((F.count_if(F.col("as_is") == F.col("word")) / F.count("*")).alias("share"))
    return words.join(counts, "word", "left").select("word", F.coalesce("share", F.lit(0.0)).alias("share"))


def _features(names: list[str]) -> Column:
    """Hashed features: (bucket, weight kind) with contexts apart from what belongs to the run itself."""
    words = F.split(F.lower("run"), " ")
    listed = F.element_at(words, 1).isin(names)
    own = F.when(listed, F.slice(words, 2, F.size(words))).otherwise(words)
    last = F.element_at(words, -1)
    inner = F.concat(F.transform(own, lambda w: F.concat(F.lit("w:"), w)), F.array(F.concat(F.lit("s:"), F.substring(last, -3, 3))))
    outer = F.array(F.concat(F.lit("p:"), F.col("prev")), F.concat(F.lit("n:"), F.col("next")))
    bucket = lambda f: (F.crc32(f.cast("binary")) % BUCKETS).cast("int")
    return F.concat(F.transform(inner, lambda f: F.struct(bucket(f).alias("bucket"), F.lit(False).alias("context"))), F.transform(outer, lambda f: F.struct(bucket(f).alias("bucket"), F.lit(True).alias("context"))))


def judged(docs: DataFrame, found: DataFrame, names: list[str]) -> DataFrame:
    """(run, person, score) of each different run; person is null where it is neither accepted nor told to be none."""
    seen = cut(found.groupBy("run", "prev", "next", "titled").agg(F.sum("n").alias("n")))
    spots = seen.groupBy("run").agg(F.bool_or((F.col("prev") != "^") | F.col("titled")).alias("inside")).select("run", "inside", F.posexplode(F.split(F.lower("run"), " ")).alias("at", "word"))
    # a first word of three whose capital is owed to the sentence alone is no part of a name
    shown = spots.groupBy("word").agg(F.bool_or(F.col("inside") | (F.col("at") > 0)).alias("shown"))
    shares = cut(lower_shares(docs, cut(spots.select("word").distinct())).join(shown, "word"))
    common = spots.join(shares, "word").groupBy("run").agg(
        F.max(F.when(F.col("at") == 0, F.col("share"))).alias("first"), F.min("share").alias("least"), F.max("at").alias("last"), F.bool_and((F.col("at") > 0) | F.col("shown")).alias("shown")
    )
    common = common.select("run", ((F.col("first") >= FIRST_SHARE) | (F.col("least") >= EVERY_SHARE) | (F.col("last") == 2) & ~F.col("shown")).alias("common"))
    listed = F.element_at(F.split(F.lower("run"), " "), 1).isin(names)
    rows = seen.join(common, "run").withColumn("good", F.col("titled") | listed & ~F.col("common")).withColumn("bad", F.col("common") & ~F.col("good"))
    rows = cut(rows.select("*", _features(names).alias("features")))
    n1, n0 = rows.agg(_times("good"), _times("bad")).first()
    if min(n1, n0) < LEAST_SEEDS:
        told = F.when(F.max("titled"), F.lit(True)).when(F.max("common"), F.lit(False))
        return rows.groupBy("run").agg(told.alias("person"), F.lit(None).cast("double").alias("score"))
    for _ in range(ROUNDS - 1):  # what is accepted gives examples of further contexts
        taken = cut(_scored(rows).where("person").select("run", F.lit(True).alias("taken")))
        rows = cut(rows.join(taken, "run", "left").withColumn("good", F.col("good") | F.coalesce("taken", F.lit(False))).withColumn("bad", F.col("common") & ~F.col("good")).drop("taken"))
    return _scored(rows)


def _times(c: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))


def _scored(rows: DataFrame) -> DataFrame:
    """(run, person, score) by the examples of the rows."""
    n1, n0 = rows.agg(_times("good"), _times("bad")).first()
    each = rows.select("run", "n", "good", "bad", F.inline("features"))
    counts = each.where("good or bad").groupBy("bucket").agg(_times("good").alias("c1"), _times("bad").alias("c0"))
    prior = n1 / (n1 + n0)  # a bucket without examples tells nothing
    ratio = F.log((F.col("c1") + prior) / n1) - F.log((F.col("c0") + 1 - prior) / n0)
    weights = F.broadcast(counts.select("bucket", ratio.alias("ratio")))  # BUCKETS rows at most
    scored = each.join(weights, "bucket", "left").groupBy("run", "bucket", "context").agg(F.sum("n").alias("n"), F.coalesce(F.max("ratio"), F.lit(0.0)).alias("ratio"))
    marks = rows.groupBy("run").agg(F.sum("n").alias("times"), F.max("titled").alias("titled"), F.max("common").alias("common"))
    part = F.when(F.col("context"), F.col("n") / F.col("times")).otherwise(1.0) * F.col("ratio")
    score = scored.join(marks.select("run", "times"), "run").groupBy("run").agg(F.sum(part).alias("score"))
    person = F.col("titled") | ~F.col("common") & (F.col("score") > THRESHOLD)
    return score.join(marks, "run").select("run", person.alias("person"), "score")


def with_names(docs: DataFrame, titles: set[str], names: list[str]) -> DataFrame:
    """docs with `names` and `vetoed`: the text's runs that are persons, and those that are none (null: no candidates)."""
    found = cut(candidates(docs, titles))
    mine = found.select("__k1", "__k2", "run").distinct()
    # both lists hold different runs of one text
    told = cut(mine.join(judged(docs, found, names), "run").groupBy("__k1", "__k2").agg(F.sort_array(F.collect_list(F.when(F.col("person"), F.col("run")))).alias("names"), F.sort_array(F.collect_list(F.when(~F.col("person"), F.col("run")))).alias("vetoed")))
    return docs.select("*", *text_key()).join(told, ["__k1", "__k2"], "left").drop("__k1", "__k2")

"""Persons learned from a corpus: measured on sentences that share no name with the lists or with the corpus, and against plain counts."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import persons, surrogates

NAMES = [n for names in surrogates.GIVEN.values() for n in names]
TITLES = set(surrogates.TITLES)

FIRST = "Oscar Ingrid Pablo Wendy Kofi Priya Lars Yuki Amina Hector Selma Bruno".split()
LAST = "Halvorsen Okafor Delgado Petrov Lindqvist Moreau Tanaka Iyer Novak Costa Weber Brandt".split()
TOLD = ["{} said that the old bridge was closed.", "The letter was written by {} in the spring.", "We sent the report to {} last week.", "A new market was opened, {} told us.", "Our director, {}, spoke about the budget.", "{} paid for the central station.", "Yesterday {} and the others left the north side.", "I asked {} about the union."]
PLACES = ["They live in {} and like it.", "The road from {} is long.", "We travelled through {} by train.", "All of the {} was covered in snow.", "He works at the {} every day."]
PLACE = ["New York", "Central Station", "Old Bridge", "United States", "North Side", "Market Hall", "Union Square", "Royal Park"]
PLAIN = "the new road and the old one meet at a central square near the station of the united party; north and south of the bridge the market has a hall, a park and a royal side, and that union of states had its name yesterday."

#: Sentences written after the contexts above, with other names: (sentence, persons).
UNSEEN = [
    ("The report by Robert Fenwick and Jennifer Adeyemi was sent to Walter Quist.", ["Robert", "Fenwick", "Jennifer", "Adeyemi", "Walter", "Quist"]),
    ("Rupert Fairweather paid the bill.", ["Rupert", "Fairweather"]),
    ("Our CEO, Angela Brockmann, spoke.", ["Angela", "Brockmann"]),
    ("Later Milena Horvat said nothing more.", ["Milena", "Horvat"]),
    ("The plan was written by Tobias Engström at home.", ["Tobias", "Engström"]),
    ("The author United States of America is unknown.", []),
    ("We met The Market yesterday and Name That Union.", []),
    ("They live in Royal Square and drive through New Bridge.", []),
    ("The North Station of the Central Union was closed.", []),
]

#: Sentences written after the last change of the method and measured once.
HELD = [
    ("The keys were given to Marisol Vandenberg by Leif Sandoval.", ["Marisol", "Vandenberg", "Leif", "Sandoval"]),
    ("Nobody asked Thandiwe Mbeki about the fence.", ["Thandiwe", "Mbeki"]),
    ("Our neighbour, Casimir Dufour, told us.", ["Casimir", "Dufour"]),
    ("Gwendolyn Achterberg and her son left the house.", ["Gwendolyn", "Achterberg"]),
    ("It was Ramon Castellanos who said that.", ["Ramon", "Castellanos"]),
    ("A note from Beatrix Lindgren's office arrived.", ["Beatrix", "Lindgren"]),
    ("The train from Royal Market to Old Side was late.", []),
    ("He works at the New Park Hall every day.", []),
    ("We travelled through United Square by bus.", []),
]


def measured(got, sentences, first):
    """(right, found, wanted) name words of the sentences, which begin at the id `first`."""
    right = found = wanted = 0
    for i, (text, want) in enumerate(sentences):
        spans = [x.split(":") for x in got[first + i]["spans"].split(",") if x]
        have = [text[int(s) : int(e)] for kind, s, e in spans if kind == "person"]
        right, found, wanted = right + len(set(have) & set(want)), found + len(have), wanted + len(want)
    return right, found, wanted


@pytest.fixture(scope="module")
def corpus(spark):
    people = [f"{a} {b}" for a, b in itertools.product(FIRST, LAST)]
    texts = []
    for i, who in enumerate(people):
        titled = ("Mr. ", "Mrs. ", "Dr. ", "")[i % 4]
        texts.append(TOLD[i % 8].format(titled + who) + " " + PLACES[i % 5].format(PLACE[i % 8]) + " " + PLAIN)
        texts.append(PLACES[(i + 2) % 5].format(PLACE[(i * 3) % 8]))
    texts += [s for s, _ in UNSEEN + HELD] + [None, "", texts[0]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_unseen_persons(corpus):
    got = {r["doc_id"]: r for r in surrogates.pseudonymised(corpus, "s").collect()}
    start = corpus.count() - 3 - len(HELD) - len(UNSEEN)
    one, two = measured(got, UNSEEN, start), measured(got, HELD, start + len(UNSEEN))
    print("persons: right, found, wanted", one, two)
    right, found, wanted = map(sum, zip(one, two, strict=True))
    assert right / wanted >= 0.75 and right / found >= 0.9  # measured: 22 of 28
    last = corpus.count() - 1
    assert got[last]["text"] == got[0]["text"] and got[last - 1]["text"] == "" and got[last - 2]["text"] is None


def test_scores_equal_plain_counts(spark, corpus, monkeypatch):
    monkeypatch.setattr(persons, "ROUNDS", 1)
    found = persons.candidates(corpus, TITLES)
    got = {r["run"]: (r["person"], r["score"]) for r in persons.judged(corpus, found, NAMES).collect()}
    texts = [r["text"] or "" for r in corpus.collect()]
    spots = [(persons.name_of(t[s:e]), prev, after, titled) for t in texts for s, e, prev, after, titled in persons.runs(t, TITLES)]
    total, low = Counter(), Counter()
    for w in (w for t in texts for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['-])*", t)):
        total[w.lower()] += 1
        low[w.lower()] += w == w.lower()
    share = lambda w: low[w] / total[w] if total[w] else 0.0
    shown = {w for run, prev, _, titled in spots for at, w in enumerate(run.lower().split(" ")) if at or prev != "^" or titled}
    features, good, n = defaultdict(Counter), Counter(), [0, 0]
    c = [Counter(), Counter()]
    common = {}
    for run, prev, after, titled in spots:
        words = run.lower().split(" ")
        shares = [share(w) for w in words]
        common[run] = shares[0] >= 0.5 or min(shares) >= 0.2 or len(words) == 3 and words[0] not in shown
        listed = words[0] in NAMES
        is_good = titled or listed and not common[run]
        own = [f"w:{w}" for w in words[listed:]] + [f"s:{words[-1][-3:]}"]
        outer = [f"p:{prev}", f"n:{after}"]
        good[run] |= titled
        for f in own:
            features[run][zlib.crc32(f.encode()) % persons.BUCKETS, False] += 1
        for f in outer:
            features[run][zlib.crc32(f.encode()) % persons.BUCKETS, True] += 1
        if is_good or common[run]:
            n[is_good] += 1
            for f in own + outer:
                c[is_good][zlib.crc32(f.encode()) % persons.BUCKETS] += 1
    times = Counter(r for r, *_ in spots)
    prior = n[1] / sum(n)
    ratio = lambda b: math.log((c[1][b] + prior) / n[1]) - math.log((c[0][b] + 1 - prior) / n[0]) if b in c[0] or b in c[1] else 0.0
    assert set(got) == set(times)
    for run, (person, score) in got.items():
        want = sum(ratio(b) * (k / times[run] if context else 1) for (b, context), k in features[run].items())
        assert score == pytest.approx(want, abs=1e-9), run
        assert abs(score) < 1e-9 or person == bool(good[run] or not common[run] and want > 0)


def test_without_examples(spark):
    df = spark.createDataFrame([(1, "We saw Green Hill there. The green hill was high, a hill so green."), (2, None), (3, "")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in persons.with_names(df, TITLES, NAMES).collect()}
    assert out[1]["names"] == [] and out[1]["vetoed"] == ["Green Hill"] and out[2]["names"] is None and len(out) == 3
    assert persons.with_names(df.limit(0), TITLES, NAMES).count() == 0
    assert surrogates.pseudonymised(df.where(F.col("doc_id") > 1), "s").count() == 2


def test_runs():
    got = lambda t: [(t[s:e], p, n, k) for s, e, p, n, k in persons.runs(t, TITLES)]
    assert got("Then Anna Bell's dog ran") == [("Then Anna Bell", "^", "dog", False), ("Anna Bell", "then", "dog", False)]
    assert got("to Mr. Otto Falk, who") == [("Otto Falk", "to", "who", True)]
    assert got("in NEW YORK and A B or One Two Three Four") == []

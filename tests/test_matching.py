"""Top entries per title against every entry scored in plain Python, for short and long tables."""

import difflib
import random

import pytest

from pagemill.functions import text as T
from pagemill.operators import matching as M

FOLD = str.maketrans(T.TITLE_LATIN, T.TITLE_CYRILLIC)


def words(title, strip):
    return [w.lower().translate(FOLD) for w in title.split() if not (strip and set("0123456789№#") & set(w))]


def tri(s):
    return {f"  {s} "[i : i + 3] for i in range(len(s) + 1)} if s else set()


def plain_top(titles, table, k, fuzzy):
    """(title, rank) -> idx by all pairs."""
    es = [(i, words(n, False)) for i, n in table]
    es = [(i, w, "".join(w), tri("".join(w)), " ".join(sorted(set(w)))) for i, w in es if w]
    out = {}
    for t in set(titles):
        qw = words(t, True)
        q, qt, qs = "".join(qw), tri("".join(qw)), " ".join(sorted(set(qw)))
        rows = []
        for i, _, e, et, s in es:
            short, long = sorted((len(q), len(e)))
            inside = q != "" and short >= 5 and short >= 0.45 * long and (q in e or e in q)
            ratio = difflib.SequenceMatcher(None, qs, s).ratio() if fuzzy and qw else 0.0
            rows.append((q != "" and q == e, inside, len(qt & et) / len(qt | et) if q else 0.0, ratio, -i))
        for r, x in enumerate(sorted(rows, reverse=True)[:k], 1):
            out[t, r] = -x[-1]
    return out


def got_top(spark, titles, table, k, fuzzy):
    t = spark.createDataFrame([(x,) for x in titles], "title string").repartition(3)
    n = spark.createDataFrame(table, "idx int, name string").repartition(3)
    return {(r["title"], r["rank"]): r["idx"] for r in M.top(t, n, k, fuzzy).collect()}


@pytest.fixture(scope="module")
def noisy():
    rnd = random.Random(8)
    word = lambda letters, a=2, b=9: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    left, right = "абвгд", "жзийк"
    names = [" ".join(word(left) for _ in range(rnd.randint(1, 4))) for _ in range(220)] + [" ".join(word(right, 1, 5) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    titles = []
    for _ in range(25):
        n = list(rnd.choice(names))
        for _ in range(rnd.randint(0, 3)):
            n[rnd.randrange(len(n))] = rnd.choice([rnd.choice(left), "", rnd.choice(right)])
        titles.append("".join(n) + rnd.choice(["", " №12", " " + word(right)]))
    # No common trigram, no letters at all, letters of no entry, a part, a hull, one letter.
    titles += ["ж", "йжк зи", "", "№ 7", "ъьюя", "q", names[0][: len(names[0]) * 2 // 3], names[1] + "ъъ", "а", names[2], names[2].upper()]
    return titles, names


@pytest.mark.parametrize("fuzzy", [True, False])
def test_top_against_all_pairs(spark, noisy, fuzzy, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    titles, names = noisy
    table = list(enumerate(names)) + [(1_000 + i, names[i]) for i in range(5)] + [(2_000, " ")]
    for k in (1, 4):
        assert got_top(spark, titles, table, k, fuzzy) == plain_top(titles, table, k, fuzzy)


def test_long_and_tiny_tables(spark, noisy):
    """Same three entries within thousands of others, and with fewer entries than asked for."""
    titles, names = noisy
    few = [(0, "план покрив"), (1, "разрез"), (2, "йжк")]
    asked = ["плн покрив", "рaзрез №3", "йж", "ъ", "", None]
    assert got_top(spark, asked, few, 5, True) == plain_top(asked[:-1], few, 5, True)
    many = few + [(10 + i, f"{names[i % 200]}ю{i}") for i in range(5_500)]
    assert got_top(spark, asked, many, 3, True) == plain_top(asked[:-1], many, 3, True)


def test_no_entries_no_titles(spark):
    assert got_top(spark, ["план"], [], 2, True) == {} and got_top(spark, [], [(0, "план")], 2, True) == {}

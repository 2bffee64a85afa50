import pytest

from mapweave.llm import canonical_map as cm

TERMS = [
    (1, "diagnosis", "Squamous cell carcinoma of lung", ["SqCC lung"]), (2, "diagnosis", "Squamous cell carcinoma of skin", []), (3, "diagnosis", "Leiomyosarcoma of colon", None),
    (4, "race", "White", ["caucasian", "wht"]), (5, "race", "Black or African American", ["AA", "black"]), (6, "race", "More than one race", ["2+ races"]), (7, "grade", "Grade 1", ["G1"]), (8, "grade", "Grade 2", ["G2"]),
]
CASES = [
    ("diagnosis", "Squamous cell carcinoma of lung", 1), ("diagnosis", "SQUAMOUS CELL CARCINOMA OF LNG", 1), ("diagnosis", "lung, squamous cell carcinoma", 1), ("diagnosis", "Sqamuos cell carcinnoma of skni", 2),
    ("diagnosis", "sqcc  lung", 1), ("diagnosis", "prob. Leiomyosarcoma of colon", 3), ("diagnosis", "Leiomyosarco. of colon - cofnirmed", 3), ("diagnosis", "'leiomyosárcoma\xa0of\xa0colon (biopsy)\n", 3),
    ("diagnosis", "Leiomyosarcomaof colon", 3), ("diagnosis", "Hx: skin: squamous cell carcinoma [site coded]", 2), ("diagnosis", "Leiomyosarcoma of colon, 2nd opinion", 3), ("diagnosis", "colon check", 0),
    ("diagnosis", "Leiomyosarcoma of skin", 0), ("diagnosis", "Belpov clinic", 0), ("diagnosis", "???", 0), ("diagnosis", "2003-12", 0), ("race", "wihte", 4), ("race", "Blck or Africn Amercan", 5), ("race", "AA", 5),
    ("race", "AB", 0), ("race", "2+ races", 6), ("race", "White / see p. 2", 4), ("race", "bed 4", 0), ("grade", "g2", 8), ("grade", "Grade 1 / see p. 2", 7), ("grade", "G3", 0), ("other", "White", 0),
]


PHRASES = ["confirmed", "biopsy", "prob", "hx", "site coded", "2nd opinion", "see p. 2"]


def mapped(spark, rows, terms=TERMS, **kw):
    kw = {"phrases": PHRASES} | kw
    ref = spark.createDataFrame([(*t, "x") for t in terms], "term_id long, category string, term string, synonyms array<string>, value string")
    df = spark.createDataFrame(rows, "category string, value string, rows int")
    return {(r.category, r.value): (r.term_id, r.rows) for r in cm.map_values(df, ref, **kw).collect()}


def test_cases(spark):
    got = mapped(spark, [(c, v, 0) for c, v, _ in CASES] + [("race", None, 0), ("race", " \t", 0), ("race", "AA", 0), (None, "AA", 0)])
    assert {k: v[0] for k, v in got.items()} == {(c, v): t for c, v, t in CASES} | {(None, "AA"): 0}
    assert got["race", "AA"] == (5, 2)


def test_blocks_give_the_same(spark):
    rows = [(c, v, 0) for c, v, _ in CASES]
    assert mapped(spark, rows, block=3) == mapped(spark, rows)


def test_more_frequent_entry_wins_an_equal_distance(spark):
    terms = [(1, "c", "Marker alpha", []), (2, "c", "Marker alphb", [])]
    got = mapped(spark, [("c", "marker alphz", 0), ("c", "Marker alphb", 0), ("c", "Marker alphb", 0)], terms)
    assert got["c", "marker alphz"][0] == 2


def test_phrases_are_learnt_and_can_be_left_out(spark):
    organs = ["lung", "colon", "skin", "brain", "liver", "ovary"]
    terms = [(k, "d", f"Cyst of {o}", []) for k, o in enumerate(organs, 1)] + [(9, "d", "Benign polyp", [])]
    rows = [("d", form.format(o), 0) for o in organs for form in ("cyst of {} - reviewed", "Sent in: cyst of {}", "cyst of {} / see p. 7")]
    rows += [("d", v, 0) for v in ("cyst of lnug - reveiwed", "cyst of lung (seldom)", "cyst of skin, benign polyp", "cyst of brain / see p. 31")]
    got = {k[1]: v[0] for k, v in mapped(spark, rows, terms, phrases=None).items()}
    assert [got[f"cyst of {o} - reviewed"] for o in organs] == [1, 2, 3, 4, 5, 6] == [got[f"Sent in: cyst of {o}"] for o in organs]
    assert (got["cyst of lnug - reveiwed"], got["cyst of lung (seldom)"], got["cyst of skin, benign polyp"], got["cyst of brain / see p. 31"]) == (1, 0, 0, 4)
    plain = {k[1]: v[0] for k, v in mapped(spark, rows, terms, phrases=[]).items()}
    assert plain["cyst of colon - reviewed"] == 0 and plain["cyst of colon / see p. 7"] == 0


def test_blocks_know_each_others_words_and_frequencies(spark):
    terms = [(k, "c", f"Marker {w}", []) for k, w in enumerate(["alpha", "alphb", "gamma", "gamna", "delta", "omega"], 1)]
    rows = [("c", v, 0) for v in ("marker alphz", "Marker alphb", "Marker alphb", "Marker gamna", "gamma", "marker gamma", "marker gmma", "marker delto")]
    assert mapped(spark, rows, terms, block=1) == mapped(spark, rows, terms)


def test_empty_tables_and_long_values(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, [("race", "White", 0)], []) == {("race", "White"): (0, 1)}
    assert mapped(spark, [("race", "white " * 20_000, 0)])["race", "white " * 20_000][0] in (0, 4)


def test_rows_are_led_by_their_value(spark):
    rows = spark.createDataFrame([("race", "White", 1), ("race", "White", 2), ("race", None, 3)], "category string, value string, ord long")
    ref = spark.createDataFrame(TERMS, "term_id long, category string, term string, synonyms array<string>")
    got = cm.lead_rows(rows, cm.map_values(rows, ref), 3).collect()
    assert {(r.ord, r.term_id) for r in got} == {(1, 4), (2, 4)}


@pytest.mark.parametrize("a, b, d", [("lung", "lung", 0), ("lnug", "lung", 0.8), ("lungg", "lung", 0.6), ("lug", "lung", 1), ("lxng", "lung", 1), ("lung", "skin", float("inf"))])
def test_distance(a, b, d):
    assert cm.distance(a, b, 2.0) == d


def test_lookup_equals_all_pairs():
    import random

    rng = random.Random(4)
    names = ["carcinoma", "sarcoma", "lymphoma", "kidney", "lung", "of", "eye", "mucinous", "cystadenoma", "endometrium", "aab", "nodes", "toluene", "adenocarcinoma", "abcabcabcabc"]
    table = cm.SymmetricDelete(names)
    for _ in range(6000):
        w = list(rng.choice(names))
        for _ in range(rng.randrange(5)):
            k, kind = rng.randrange(len(w) + 1), rng.randrange(5)
            if kind == 0:
                w.insert(k, rng.choice("abcxyz"))
            elif kind == 1 and k < len(w) > 1:
                del w[k]
            elif kind == 2 and k < len(w):
                w[k] = rng.choice("abcxyz")
            elif kind == 3 and k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
            elif k < len(w):
                w.insert(k, w[k])
        w = "".join(w)
        every = {n: cm.distance(w, n, 99.0) for n in names if osa(w, n) <= cm.allowed(n)}
        assert dict(table.find(w)) == ({w: 0.0} if w in names else every)


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_deletes_find_all_within_reach():
    import itertools

    words = ["carcinoma", "sarcoma", "lymphoma", "kidney", "lung"]
    table = cm.SymmetricDelete(words)
    for w in words:
        for i, j in itertools.combinations(range(len(w)), 2):
            typo = w[:i] + "q" + w[i + 1 :]
            assert w in dict(table.find(typo)) or cm.allowed(w) < 1
            typo2 = typo[:j] + typo[j + 1 :]
            assert w in dict(table.find(typo2)) or cm.allowed(w) < 2

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mapweave.llm import splitting as sp
from mapweave.llm.tokens import DEFAULT_VOCABULARY, Tokens

TOKENS = Tokens.of(DEFAULT_VOCABULARY)
TEXTS = st.lists(st.sampled_from(["Alpha", " beta", ".", " ", "\n", "\n\n", "  ", "\t", "# Head\n", "Dr. X", "日本語", "。", "é", " ", "12,5", "'s", " \n ", "😀", "é", "_id"]), max_size=120).map("".join)


def encode(text):
    return len(TOKENS.encoding.encode_ordinary(text))


def check(text, limits):
    by = {}
    for name, k, a, b, size, shared, strength in sp.cut(text, TOKENS, limits):
        assert k == len(by.setdefault(name, []))
        by[name].append((a, b, size, shared))
    offsets, clean = TOKENS.boundaries(text)
    for name, most, overlap in limits:
        end = 0
        for i, (a, b, size, shared) in enumerate(by[name]):
            assert size == encode(text[a:b])
            assert size <= most or b - a == 1 or most < 8
            if i:
                assert a <= end < b
                assert shared >= overlap or a == end
                assert shared <= overlap + 4 or a == end
            end = b
        assert end == len(text)
        pieces = by[name]
        rebuilt = "".join(text[max(a, pieces[i - 1][1] if i else 0) : b] for i, (a, b, *_) in enumerate(pieces))
        assert rebuilt == text


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_counts_and_boundaries_equal_the_tokenizer(text):
    assert TOKENS.count(text) == encode(text)
    offsets, clean = TOKENS.boundaries(text)
    assert len(offsets) == encode(text) + 1 and offsets[-1] == len(text)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_pieces_fit_overlap_and_rebuild_the_text(text):
    check(text, [("a", 16, 3), ("b", 9, 0), ("c", 40, 12)])


def test_strongest_boundary_wins_and_ties_go_right():
    text = "One two three. Four five six.\n\n# Part\nSeven eight nine. Ten eleven twelve.\nThirteen fourteen."
    first = next(sp.cut(text, TOKENS, [("x", 16, 0)]))
    assert text[first[2] : first[3]] == "One two three. Four five six.\n\n" and first[6] == sp.HEADING
    plain = "aa bb cc dd ee ff gg hh ii jj kk ll mm nn"
    a, b = list(sp.cut(plain, TOKENS, [("x", 10, 0)]))[0][2:4]
    assert encode(plain[a:b]) == 10


def test_a_sentence_end_before_the_half_goes_before_a_word():
    text = "One.\nTwo. " + "and so it goes on " * 12
    for overlap, piece, strength in ((0, "One.\n", sp.LINE), (3, "One.\nTwo.", sp.SENTENCE)):
        first = next(sp.cut(text, TOKENS, [("x", 24, overlap)]))
        assert text[: first[3]] == piece and first[6] == strength
        check(text, [("x", 24, overlap)])
    check("AlphaAlphaéAlpha\n# Head\nAlphaAlphaAlphaAlpha日本語", [("a", 16, 3), ("b", 9, 0), ("c", 40, 12)])
    first = next(sp.cut(text, TOKENS, [("x", 24, 5)]))
    assert first[6] == sp.WORD and first[4] > 12


def test_abbreviations_end_no_sentence():
    s = sp.strengths("Seen by Dr. Who, approx. 5 ml. Then z. B. none? Yes! End.")
    ends = [k for k in range(len(s)) if s[k] == sp.SENTENCE]
    assert ends == [30, 47, 52]


def test_range_maximum_against_brute_force():
    import random

    import numpy as np

    rng = random.Random(1)
    s = np.array([rng.randrange(5) for _ in range(300)], np.uint8)
    t = sp.RangeMaximum(s, 129)
    for _ in range(500):
        lo = rng.randrange(290)
        hi = min(299, lo + rng.randrange(128))
        assert t.best(lo, hi) == max((int(s[k]), k) for k in range(lo, hi + 1))


def test_operator(spark):
    long = "word " * 40_000
    rows = [(1, "short", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (4, long, "x"), (5, "日" * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = sp.split_texts(df, [("t", 128, 16), ("p", 256, 0)])
    rows = got.collect()
    assert {r.doc_id for r in rows} == {1, 3, 4, 5}
    assert [(r.text, r.tokens) for r in rows if r.doc_id == 3] == [("", 0)] * 2
    assert max(r.tokens for r in rows if r.setting == "t") <= 128
    assert max(r.tokens for r in rows if r.setting == "p") <= 256
    assert sp.split_texts(df.limit(0), [("t", 128, 16)]).count() == 0
    report = {r.setting: r for r in sp.split_report(got).collect()}
    assert report["t"].documents == 5 and report["t"].largest <= 128


@pytest.mark.parametrize("bad", [("x", 0, 0), ("x", 8, 8), ("x", 8, -1)])
def test_bad_settings(spark, bad):
    with pytest.raises(ValueError):
        sp.split_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [bad])


def test_a_character_over_the_limit_stays_whole():
    check("日" * 5 + "😀" * 3, [("tiny", 1, 0)])


def test_more_settings_than_the_bound_are_an_error(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(1001).selectExpr("CAST(id AS STRING) AS setting", "64 AS max_tokens", "0 AS overlap_tokens").write.parquet(str(tmp_path / "split_settings.parquet"))
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(ValueError, match="split_settings"):
        entry.queries()["p8_pieces"](spark, str(tmp_path))

import itertools
import random

from mapweave.llm import leakage as lk

WORDS = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]


def make(seed=1, n=60):
    return " ".join(random.Random(seed).sample(WORDS, n))


ITEM = make()


def hit(text, items=((1, ITEM),)):
    return bool(lk.leaked_items(lk.Seeds(list(items)), [text])[0])


def edited(words, at, kind):
    w = list(words)
    for p, k in sorted(zip(at, kind), reverse=True):
        if k == "replace":
            w[p] = "zz"
        elif k == "drop":
            del w[p]
        else:
            w.insert(p, "zz")
    return " ".join(w)


def test_every_way_to_edit_twelve_words_twice_is_found():
    words = ITEM.split()[20:32]
    noise = "x y z " * 5
    kinds = ("replace", "drop", "add")
    for at in itertools.combinations(range(1, 11), 2):
        for k in itertools.product(kinds, kinds):
            assert hit(noise + edited(words, at, k) + " " + noise), (at, k)


def test_one_edit_in_six_of_a_long_passage_and_no_more():
    words = ITEM.split()[:48]
    assert hit(edited(words, range(3, 48, 6), ["replace"] * 8))
    assert not hit(edited(words, range(2, 48, 4), ["replace"] * 12))


def test_short_quotes_are_none():
    assert not hit("x y " + " ".join(ITEM.split()[5:14]) + " z v")
    assert hit("x y " + " ".join(ITEM.split()[5:17]) + " z v")


def test_form_does_not_count():
    words = ITEM.split()[:14]
    plain = " ".join(words)
    forms = [plain.upper(), plain.replace(" ", "\\n"), plain.replace(" ", "　"), " ".join(f"<b>{w}</b>," for w in words), " ".join(f"**{w}**" for w in words), plain.replace("w", "&#119;"), "<p>" + plain.replace(" ", "<br/>") + "</p>"]
    forms += [plain.replace("w", "\\u0077"), plain.replace("o", "ó"), plain.replace("w", "ｗ"), plain.replace("o", "o​"), " ".join(f"[{w}](http://x.invalid/{k})" for k, w in enumerate(words)), "\n> ".join(words)]
    for f in forms:
        assert hit("a b " + f + " c"), f


def test_operator_blocks_nulls_and_repeats(spark):
    other = make(9)
    docs = [(1, "n " + " ".join(ITEM.split()[3:20]), "x"), (2, None, "x"), (3, "", "x"), (4, ITEM + " " + other, "x"), (4, ITEM, "x"), (5, make(77), "x"), (6, "lorem " * 100_000 + ITEM, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _text string")
    i = spark.createDataFrame([(10, ITEM, "y"), (11, other, "y"), (12, None, "y"), (13, "", "y"), (14, ITEM, "y"), (15, "only three words", "y")], "item_id long, text string, doc_id string")
    want = {(1, 10), (1, 14), (4, 10), (4, 11), (4, 14), (6, 10), (6, 14)}
    for block in (100, 2):
        got = lk.find_leaks(d, i, "doc_id", "text", "item_id", "text", block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert lk.find_leaks(d.limit(0), i, "doc_id", "text", "item_id", "text").count() == 0
    assert lk.find_leaks(d, i.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def naive(item, doc):
    """Longest item passage whose best alignment with some stretch of the document has one edit in six words."""
    best = 0
    for a in range(len(item)):
        row = [0] * (len(doc) + 1)  # edits of item[a:b] against a stretch that ends at j, free start
        for b in range(a + 1, len(item) + 1):
            new = [row[0] + 1]
            for j in range(1, len(doc) + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (item[b - 1] != doc[j - 1])))
            row = new
            n = b - a
            if n >= 12 and 6 * min(row) <= n:
                best = max(best, n)
    return best


def test_agrees_with_full_alignment():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.choice(WORDS[:300]) for _ in range(40)]
        a = rng.randrange(20)
        part = item[a : a + rng.randrange(9, 21)]
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(part))
            part = [part[:p] + ["zz"] + part[p + 1 :], part[:p] + part[p + 1 :], part[:p] + ["zz"] + part[p:]][rng.randrange(3)]
        doc = ["q1", "q2", "q3"] + part + ["q4", "q5", "q6"]
        assert hit(" ".join(doc), [(1, " ".join(item))]) == (naive(item, doc) >= 12)


def test_a_run_of_edits_does_not_end_a_long_passage():
    words = ITEM.split()
    text = " ".join(words[:20] + ["zz"] * 5 + words[25:55])
    seeds = lk.Seeds([(1, ITEM)])
    assert max(lk.leaked_items(seeds, ["x y " + text])[0].values()) >= 55

import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from embedflow.llm import residue as R

rnd = random.Random(6)
PLACES, THINGS, DAYS = ["library", "harbour", "market", "school", "museum"], ["kettle", "lamp", "tent", "printer", "drill"], ["Monday", "Friday", "yesterday", "in May"]
SENTENCES = [
    lambda a, b, c: f"The {a} keeps every {b} on the second shelf.", lambda a, b, c: f"We returned the {b} to the {a} {c}.", lambda a, b, c: f"A visitor asked about the {b} {c}.", lambda a, b, c: f"Repairs of the {b} took {rnd.randint(2, 90)} minutes at the {a}.",
]
FIELDS = ["{{name}}", "${title}", "{0}", "[city]", "<company>", "__date__", "undefined", "[object Object]", "____", "%(item)s"]
NOTICES = ["404 Not Found", "Page not found. Check the address.", "Access denied.", "Your session has expired. Sign in again.", "Please enable JavaScript to use this site.", "Lorem ipsum dolor sit amet.", "Internal server error. Retry later.", "Service unavailable. The system is being serviced."]
MENTIONS = ["In the template, `{{ name }}` gets replaced before sending, as the manual explains.", "The chapter explains how the message Page not found is built.", "A parser yields null for keys that are absent."]


def ordinary(n):
    return [rnd.choice(SENTENCES)(rnd.choice(PLACES), rnd.choice(THINGS), rnd.choice(DAYS)) for _ in range(n)]


def corpus(n):
    out = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.04:
            x = ordinary(rnd.randint(3, 6))
            k = rnd.randrange(len(x))
            for word in rnd.sample([*PLACES, *THINGS], 10):
                if word in x[k]:
                    x[k] = x[k].replace(word, rnd.choice(FIELDS), 1)
                    break
            out.append((i, " ".join(x), any(f in x[k] for f in FIELDS)))
        elif kind < 0.09:
            out.append((i, " ".join(rnd.sample(NOTICES, rnd.randint(1, 3))), True))
        else:
            x = ordinary(rnd.randint(4, 12))
            if kind < 0.3:
                x.insert(rnd.randint(1, len(x)), rnd.choice(MENTIONS))
            elif kind < 0.36:
                x.append(rnd.choice(NOTICES))
            out.append((i, " ".join(x), False))
    return out


def test_held_out_accuracy(spark):
    train, held = corpus(4000), corpus(2000)
    model = R.learn([t for _, t, _ in train])
    got = {i for i, t, _ in held if model.is_residue(t)}
    want = {i for i, _, y in held if y}
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9
    df = spark.createDataFrame([(i, t, True) for i, t, _ in held], "doc_id long, text string, residue boolean")
    assert {r.id for r in R.with_residue(df, model=model).where("residue").collect()} == got


def test_passages():
    assert R.passages("<h1>Ｎｏｔ\u3000ｆｏｕｎｄ</h1>\nP a g e   g o n e x\n題名 本文です。次。") == ["not found", "page gonex", "題名", "本文です。", "次。"]
    assert R.features("ab-12 {{x}} カナ名 7") == ["0", "\x01f", "カナ", "ナ名", "0"]


@pytest.mark.parametrize("text,kind", [("{{x}}", "f"), ("${x}", "f"), ("*|x|*", "f"), ("@@x@@", "f"), ("モデルundefinedの", "r"), ("（未入力）", "b"), ("○○さん", "b"), ("____", "b"), ("%sに", "f"), ("«title»", "f"), ("[1]", None), ("« deux mots »", None), ("xx-06281", None), ("○×", None)])
def test_marks(text, kind):
    found = [f[1] for p in R.passages(text) for f in R.features(p) if f[0] == "\x01"]
    assert found == ([kind] if kind else [])


def test_edge_rows(spark):
    texts = [None, "", "  \u3000", "word", "x" * 100_000, "404 Not Found", "word"]
    df = spark.createDataFrame([*enumerate(texts), (None, "word")], "doc_id long, text string")
    got = R.with_residue(df).collect()
    assert len(got) == len(texts) + 1 and not any(r.residue for r in got if r.id in (0, 1, 2, 3, 6))
    assert R.with_residue(df.limit(0)).count() == 0
    assert R.learn([]).is_residue("404 Not Found") is False


def test_unlisted_line_of_a_third(spark):
    """A message that no list knows stands in a third of the records: beside known messages, and under titles alone."""
    line, rest = "The shop is taking a short break", corpus(2000)
    assert not R.TRUSTED.search(line.lower())
    found = [f"{t}\n{line}" for t in rnd.choices(NOTICES, k=400)]
    found = [f"{rnd.choice(PLACES)} {i}\n{x}" for i, x in enumerate(found)]
    alone = [f"{rnd.choice(THINGS)} {i} of the {rnd.choice(PLACES)}\n{line}" for i in range(600)]
    rows = [*rest, *enumerate([*found, *alone], len(rest))]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = {r.id for r in R.with_residue(df).where("residue").collect()}
    assert len(got & set(range(len(rest), len(rows)))) > 0.95 * (len(found) + len(alone))
    want = {i for i, _, y in rest if y}
    assert len(got & want) / len(want) > 0.85 and len((got - want) & {r[0] for r in rest}) < 0.1 * len(want)


def test_marks_are_no_furniture():
    texts = [f"{' '.join(ordinary(4))}\nDear {{{{name}}}},\nTo the {p} shelf" for p in PLACES for _ in range(8)]
    assert R.learn([*texts, *(t for _, t, _ in corpus(500))]).furniture == {f"to the {p} shelf" for p in PLACES}


def test_furniture_is_counted_over_all_records(spark):
    """Which lines are furniture doesn't depend on the sample on which the model is fitted."""
    texts = [f"{' '.join(ordinary(5))}\nBack to the {PLACES[i % 5]} list" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in [*texts, *texts, *(t for _, t, _ in corpus(1500))]], "text string")
    want = {f"back to the {p} list" for p in PLACES}
    assert R.fit_residue_model(df, sample_rows=150).furniture == R.fit_residue_model(df).furniture == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcxé1２٣.-/: ,_{}%漢字カー々。〇\x01noul$[]Ж"), min_size=1, max_size=24), max_size=6))
@example(["ab-12/34 x.-5 1ab-5 12-ab-5 éab-5 abcd-5", "a1-2", "%sa {x}b null", "__", "-", "カ", "2-"])
def test_buckets_are_those_of_the_features(lines):
    """The hashes over whole arrays are those of the features one by one, in their order."""
    lines = [p for x in lines for p in R.passages(x)]
    bucket, passage = R.coded(lines)
    want = [(R.bucket_of(f), k) for k, p in enumerate(lines) for f in R.features(p)]
    assert list(zip(bucket.tolist(), passage.tolist())) == want


def test_texts_are_judged_alike_in_any_company():
    model = R.learn([t for _, t, _ in corpus(1500)])
    texts = [t for _, t, _ in corpus(300)] + [None, "", "x" * (R.CHUNK + 5), "404 Not Found", "  "]
    rnd.shuffle(texts)
    assert model.judged(texts).tolist() == [model.is_residue(t) for t in texts]


def test_near_marks():
    feats = R.np.array([20, 21, *range(30, 50), R.MARKS["\x01f"], 60, *range(70, 90)], R.np.int32)
    assert R.near_marks(feats).tolist() == [*range(42, 50), 2, 60, *range(70, 77)]
    assert R.near_marks(R.np.array([2, 1, 0, 9], R.np.int32)).tolist() == [2, 1, 0, 9, R.THREE_MARKS]
    assert R.near_marks(R.np.array([2, 1, 0, 0], R.np.int32)).tolist()[-2:] == [R.THREE_MARKS, R.FOUR_MARKS]


def test_title_may_be_a_question():
    model = R.learn([t for _, t, _ in corpus(3000)])
    assert model.is_residue("Where does the kettle stand? Page not found. Check the address. Access denied.")
    assert not model.is_residue("Where does the kettle stand? The library keeps every kettle on the second shelf. We returned the lamp to the harbour yesterday.")

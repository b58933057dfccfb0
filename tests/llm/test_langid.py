import os
import random

import numpy as np
import pyarrow.parquet as pq

from lexmill.llm import langid

from .helpers import docs

DATA = "/root/testdata/sf0.01/documents.parquet"

SYLLABLES = {"aa": ["ka", "to", "mi", "re", "su", "no"], "bb": ["blor", "trun", "gast", "ferd", "melk"], "cc": ["oui", "eau", "ais", "ment", "tion"], "dd": ["ung", "sch", "ein", "cht", "lich"]}


def sentence(r, lang, n=30):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def labelled(seed, n):
    r = random.Random(seed)
    return [(i, sentence(r, lang), lang, "src0", 1) for i, lang in enumerate(r.choice(sorted(SYLLABLES)) for _ in range(n))]


def model_of(seed=1):
    table = labelled(seed, 200)
    return langid.fit([t[1] for t in table], [t[2] for t in table])


def test_held_out_accuracy(spark):
    model = langid.train(docs(spark, labelled(1, 200)))
    got = langid.identify(docs(spark, labelled(2, 200)), model).collect()
    assert all(r["language"] == r["lang"] and r["accepted"] for r in got)


def test_held_out_accuracy_on_documents():
    if not os.path.exists(DATA):
        return
    table = [(t, x) for t, x in zip(*(pq.read_table(DATA).column(c).to_pylist() for c in ("text", "lang"))) if t and x]
    train, test = table[::2], table[1::2]
    model = langid.fit([t for t, _ in train], [x for _, x in train])
    column = langid.lower(langid.pa.array([t for t, _ in test]))
    x = langid.features(*langid.buffers(column))
    which, _ = langid.decode(model, x @ model.weights[:-1] + model.weights[-1])
    assert np.mean([model.languages[w] == lang for w, (_, lang) in zip(which, test)]) >= 0.98


def test_mixture_is_ambiguous(spark):
    """Half one language, half another: nearer to none by the lead that clear texts have."""
    r, model = random.Random(4), model_of()
    clear = [(i, sentence(r, "aa", 40)) for i in range(10)]
    mixed = [(10 + i, sentence(r, "aa", 14) + " " + sentence(r, "bb", 20)) for i in range(10)]
    got = {x["doc_id"]: x["lead"] for x in langid.identify(docs(spark, clear + mixed), model).collect()}
    assert np.median([got[i] for i in range(10)]) > 2 * np.median([got[10 + i] for i in range(10)])


def test_codewords_correct_errors():
    for n in (2, 3, 4, 5, 6, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code}) == n
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        assert apart >= {2: 1, 3: 2}.get(n, 4)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_one_wrong_bit_is_corrected():
    code = langid.codewords(5)
    model = langid.Model(list("abcde"), code, np.zeros((1, 1)), np.full(code.shape[1], 1 / code.shape[1]))
    for i, word in enumerate(code):
        for bit in range(code.shape[1]):
            said = word * 3.0
            said[bit] *= -1
            assert langid.decode(model, said[None])[0][0] == i


def test_odd_rows(spark):
    r, model = random.Random(5), model_of()
    long = sentence(r, "cc", 60_000)
    table = [(1, None), (2, ""), (3, "12 34 -- !!"), (None, sentence(r, "bb")), (4, long), (4, long), (5, "日本語の文章")]
    got = langid.identify(docs(spark, table), model).collect()
    assert len(got) == 7
    by = {(x["doc_id"]): x for x in got}
    for i in (1, 2, 3):
        assert by[i]["language"] is None and by[i]["accepted"] is False and by[i]["lead"] == 0.0
    assert by[None]["language"] == "bb" and by[4]["language"] == "cc" and by[4]["text"] == long
    assert langid.identify(docs(spark, []), model).collect() == []


def test_no_or_one_language(spark):
    table = [(1, "some text here", None, None, None), (2, None, "aa", None, 3)]
    none = langid.train(docs(spark, table))
    assert none.languages == []
    assert [r["accepted"] for r in langid.identify(docs(spark, table), none).collect()] == [False, False]
    one = langid.train(docs(spark, [(1, "some text", "xx", "s", 1)]))
    got = langid.identify(docs(spark, [(1, "other"), (2, "")]), one).collect()
    assert [(r["language"], r["accepted"]) for r in got] == [("xx", True), (None, False)]


def test_training_rows_are_bounded_and_repeatable(spark):
    table = labelled(6, 120)
    a = langid.train(docs(spark, table), rows=10)
    b = langid.train(docs(spark, table[::-1]).repartition(7), rows=10)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_clashing_columns(spark):
    df = docs(spark, [(1, "katomi resu")]).selectExpr("*", "'x' as language", "1 as LEAD", "2 as c0", "3 as tag", "array(1) as more")
    got = langid.identify(df, model_of())
    assert got.columns == [*docs(spark, []).columns, "c0", "tag", "more", "language", "lead", "accepted"]
    r = got.first()
    assert r["language"] == "aa" and r["c0"] == 2 and r["more"] == [1]


def test_whole_texts_are_counted_when_fitting(spark):
    """All texts begin with the same long head; what tells them apart comes later."""
    r = random.Random(7)
    head = sentence(r, "cc", 1500)
    assert len(head) > 8000
    table = [(i, head + " " + sentence(r, lang, 1500), lang, "src0", 1) for i, lang in enumerate(["aa", "bb"] * 20)]
    got = langid.identify(docs(spark, [(i, sentence(r, "ab"[i % 2] * 2), "ab"[i % 2] * 2, "src0", 1) for i in range(20)]), langid.train(docs(spark, table))).collect()
    assert all(x["language"] == x["lang"] and x["accepted"] for x in got)


def test_rows_without_id_are_drawn(spark):
    r = random.Random(8)
    table = [(None, sentence(r, lang, 6), lang, "src0", 1) for lang in ("aa", "bb") for _ in range(400)] + [(None, "oui eau ment", "cc", "src0", 1)] * 400
    assert langid.train(docs(spark, table), rows=10).languages == ["aa", "bb", "cc"]


def test_query_against_brute_force(spark, tmp_path):
    """Features counted one by one in dictionaries, and codewords compared one by one, with the model that the query fits."""
    from math import exp, log, sqrt

    from lexmill.llm import queries

    table = [*labelled(7, 120), (500, None, "aa", "src0", 1), (501, "", "bb", "src0", 1), (502, "12 !!", None, "src0", 1), (503, sentence(random.Random(1), "aa", 9) + " " + sentence(random.Random(2), "bb", 12), None, "src0", 1)]
    docs(spark, table).write.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet"))

    def slow(text):
        data, kept, before = (text or "").lower().encode(), [], False
        for b in data:
            letter = 97 <= b <= 122 or b >= 128
            if letter or before:
                kept.append(b if letter else 32)
            before = letter
        if not kept:
            return None, 0.0, False
        count, p2, p1 = {}, 32, 32
        for x in kept:
            for f in (((p1 * 0x9E3779B1 + x) * 0x85EBCA6B & 0xFFFFFFFF) >> 20, (((p2 * 0x9E3779B1 + p1) * 0xC2B2AE35 + x) * 0x27D4EB2F & 0xFFFFFFFF) >> 20):
                count[f] = count.get(f, 0) + 1
            p2, p1 = p1, x
        total = sum(count.values())
        scores = [float(model.weights[-1, k]) + sum(sqrt(n / total) * float(model.weights[f, k]) for f, n in count.items()) for k in range(model.code.shape[1])]
        loss = sorted((sum(w * log(1 + exp(-max(-30, min(30, s * c)))) for w, s, c in zip(model.loss, scores, word)), i) for i, word in enumerate(model.code))
        lead = loss[1][0] - loss[0][0]
        return model.languages[loss[0][1]], lead, lead >= langid.MARGIN

    got = {r["doc_id"]: r for r in queries.op6_language(spark, str(tmp_path)).collect()}
    assert len(got) == len(table)
    for i, text, *_ in table:
        language, lead, accepted = slow(text)
        assert got[i]["language"] == language and abs(got[i]["lead"] - lead) < 1e-3 and got[i]["accepted"] == accepted


def test_training_rows_without_ids_count(spark):
    """Null and repeated ids neither shut a language out nor pass the bound."""
    r = random.Random(9)
    table = [(None, sentence(r, "aa"), "aa", "s", 1) for _ in range(90)] + [(5, sentence(r, "bb"), "bb", "s", 1) for _ in range(90)] + [(None, sentence(r, "aa"), None, "s", 1), (None, None, "cc", "s", 1)]
    model = langid.train(docs(spark, table), rows=40)
    assert model.languages == ["aa", "bb"]
    got = langid.identify(docs(spark, table[:180]), model).collect()
    assert all(x["language"] == x["lang"] for x in got)
    assert langid.train(docs(spark, [])).languages == []

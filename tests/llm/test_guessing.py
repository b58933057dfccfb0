import random
from itertools import product
from math import log10

import pytest

from lexmill.llm import guessing

from .helpers import docs, rows


def explained(part):
    """Least cost of a part as one segment that isn't brute."""
    costs = [f(part) for f in (guessing.word_cost, guessing.date_cost, guessing.walk_cost)]
    if unit := guessing.repeat_unit(part):
        costs.append(brute(unit) + log10(len(part) // len(unit)))
    return min((c for c in costs if c is not None), default=float("inf"))


def brute(value):
    """Every way to cut the value into segments of which no two brute ones are next to each other."""
    best = float("inf")
    for cuts in product((0, 1), repeat=len(value) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(value[last:i])
                last = i
        parts.append(value[last:])
        raw, known = float("inf"), 0.0  # the last segment is brute, or isn't
        for part in parts:
            raw, known = known + guessing.brute_cost(part), min(raw, known) + explained(part)
        best = min(best, min(raw, known) + guessing.JOIN * (len(parts) - 1))
    return best


def test_dp_is_the_minimum_over_all_segmentations():
    r = random.Random(1)
    for value in ["password1", "qwerty", "abcabcabc", "19991231", "P@ssw0rd!", "zaq12wsx", "aaaaaaa", "x9Kq!v2"] + ["".join(r.choice("aqw12é-P") for _ in range(r.randint(1, 9))) for _ in range(40)]:
        assert guessing.guess_cost(value)[0] == pytest.approx(brute(value))


@pytest.mark.parametrize(("value", "kinds"), [("password", "word"), ("drowssap", "word"), ("p4ssw0rd", "word"), ("1999-12-31", "date"), ("31121999", "date"), ("asdfghjkl", "walk"), ("passwordpassword", "repeat"), ("xvxvxvxvxvxv", "repeat"), ("Xk29vQz", "brute")])
def test_kinds(value, kinds):
    cost, said = guessing.guess_cost(value)
    assert said == kinds and cost <= guessing.brute_cost(value)


def test_costs():
    assert guessing.guess_cost("password")[0] == 0.0
    assert guessing.guess_cost("Password")[0] == pytest.approx(log10(2))
    assert guessing.guess_cost("")[0] == 0.0
    assert guessing.guess_cost("kX9vQ2mZ7pLr4tWy")[0] > guessing.SECRET > guessing.guess_cost("changeme123")[0]
    assert guessing.guess_cost("welcome-2021-01-01")[0] < guessing.SECRET


def test_long_values_are_costed_whole():
    assert guessing.guess_cost("Zq7" * 400)[0] < 10
    r = random.Random(3)
    assert guessing.guess_cost("".join(r.choice("abcdefgh0123") for _ in range(700)))[0] > 500


def test_scan(spark):
    secret = "kX9vQ2mZ7pLr4tWy"
    long = "filler words here " * 20_000 + f"\napi_key = {secret}"
    table = [(1, f"password: {secret}"), (2, "password=changeme and more"), (3, f'{{"db_password" : "{secret} x"}}'), (4, None), (5, ""), (None, f"token={secret}"), (6, long), (7, f"the value {secret} alone"), (1, f"password: {secret}"), (8, f"SECRET => '{secret}'; token:'é中{secret}'")]
    got = guessing.secrets(docs(spark, table)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == {1, 2, 3, 6, 8}
    assert len(by[1]) == 2 and by[1][0] == by[1][1] and by[1][0]["is_secret"] and by[1][0]["at"] == 10 and by[1][0]["length"] == 16
    assert not by[2][0]["is_secret"] and by[3][0]["length"] == 18
    assert by[6][0]["at"] == len(long) - 16 and by[6][0]["fingerprint"] == by[1][0]["fingerprint"]
    assert [r["key"] for r in sorted(by[8], key=lambda r: r["at"])] == ["secret", "token"] and all(r["is_secret"] for r in by[8])
    assert guessing.secrets(docs(spark, [])).count() == 0


def test_clashing_columns(spark):
    df = docs(spark, [(1, "pwd=abcd1234")]).selectExpr("*", "1 as id", "2 as key", "3 as at", "4 as kinds")
    assert rows(guessing.secrets(df), "doc_id", "key", "length") == [(1, "pwd", 8)]


@pytest.mark.parametrize("blanks", ["", " ", " " * 5, "\t" * 9, " \t" * 300])
def test_aligned_assignments(blanks):
    for before, after in ((blanks, " "), ("", blanks), (blanks, blanks)):
        m = guessing.CONTEXT.search(f"user = me\ndb_password{before}={after}x9Kq!7zLm2\n")
        assert m and m.group(4) == "x9Kq!7zLm2"
        assert guessing.CONTEXT.search(f'"token"{before}:{after}"24be 77"').group(2) == "24be 77"


def test_blanks_without_an_assignment_are_passed_once():
    assert guessing.CONTEXT.search(("token" * 6 + " " * 20_000) * 20) is None


def all_spans(value):
    """Every span as a segment, however long; a brute one only after one that isn't."""
    best, plain = [0.0], [0.0]
    for j in range(1, len(value) + 1):
        join = [guessing.JOIN if i else 0.0 for i in range(j)]
        known = []
        for i in range(j):
            part = value[i:j]
            costs = [f(part) for f in (guessing.word_cost, guessing.date_cost, guessing.walk_cost)]
            if unit := guessing.repeat_unit(part):
                costs.append(guessing.guess_cost(unit)[0] + log10(len(part) // len(unit)))
            known.append(best[i] + join[i] + min((c for c in costs if c is not None), default=float("inf")))
        plain.append(min(known))
        best.append(min(plain[-1], min(plain[i] + join[i] + guessing.brute_cost(value[i:j]) for i in range(j))))
    return best[-1]


def test_spans_of_any_length():
    assert guessing.guess_cost("-" * 192) == (pytest.approx(log10(33) + log10(192)), "repeat")
    assert guessing.guess_cost("x" * 256)[0] == pytest.approx(log10(26) + log10(256))
    r = random.Random(5)
    unit = "".join(r.choice("abXY01!-") for _ in range(80))
    assert guessing.guess_cost(unit * 3)[0] == pytest.approx(guessing.guess_cost(unit)[0] + log10(3))
    for value in ["*" * 70 + "x9Kq" + "*" * 70, "key=" + "ab1" * 30 + "zz", "qwertyuiop" * 8 + "Q!", "qwqwqWqw" * 10 + "7", "".join(r.choice("ab1") for _ in range(90)), "aXa" * 25 + "é" * 12, "xxxx" * 20, "A" + "b" * 75]:
        assert guessing.guess_cost(value)[0] == pytest.approx(all_spans(value))

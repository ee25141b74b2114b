"""Personal data: the base spans against the patterns as written, the tagger against brute force and planted cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.llm import fixture
from tillwatch.llm import personal, tagger

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def holds(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(number) <= 19 and luhn(number)
    return kind == "email" or 10 <= len(number) <= 15


def plain_base(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if holds(kind, m[0])]
    return [(kind, s, e) for s, _, e, kind in sorted(found)]


def card(rng):
    while True:
        number = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(number):
            return number


def phone(rng):
    return f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"


def address(rng):
    return ".".join(str(rng.randint(1, 255)) for _ in range(4))


def email(rng):
    return f"{fixture.babble(rng, 1)[0]}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"


def corpus():
    rng = random.Random(4)
    makers = [email, address, card, phone]
    texts = []
    for i in range(320):
        words = fixture.babble(rng, rng.randint(20, 60))
        if i % 4:
            words.insert(rng.randint(0, len(words)), makers[i % 16 // 4](rng))
        if i % 9 == 0:
            words.insert(0, "".join(rng.choice("0123456789abcdef") for _ in range(24)))
        texts.append(" ".join(words))
    planted = []
    for i in range(40):  # neighbours that the patterns lose
        pair = [card(rng), card(rng)] if i % 2 else [phone(rng), address(rng)]
        words = fixture.babble(rng, 20)
        words[rng.randint(3, 15) : 3] = pair
        planted.append((len(texts), pair))
        texts.append(" ".join(words))
    texts += [
        None, "", " ", "@", "a@b", "a@b.c@d.e", "x@y.z.", ".@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000.000.0.255", "é1.1.1.1é", "+1",
        "4111 1111-1111 1111", "4111  1111 1111 1111", "+1 (200) 555-0100 4111111111111111", "+49 30 123456.", "++1 2345678901",
        "9" * 6000, "1." * 4000, "a" * 200000, "a@" * 3000, "+1" + " " * 3000, "١٢@x.y", "😀 4111111111111111 😀 a@b.cd",
        " ".join(fixture.babble(rng, 4000)) + " " + card(rng) + " " + card(rng),
    ]
    return texts, planted


@pytest.fixture(scope="module")
def docs(spark):
    texts, _ = corpus()
    rows = [(i, t, "en", "s", 1, 1, "w", "c", 2, "f", "s", 3) for i, t in enumerate(texts)]
    rows += [(None, *rows[0][1:]), rows[7]]
    return spark.createDataFrame(rows, fixture.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def found(docs):
    return personal.personal_digest(docs).collect()


def test_base_spans(docs, found):
    want = []
    for r in docs.collect():
        spans = plain_base(r["text"])
        counts = [sum(k == kind for k, _, _ in spans) for kind, _ in PATTERNS]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        want.append((r["doc_id"], *counts, digest))
    assert sorted([tuple(r)[:6] for r in found], key=repr) == sorted(want, key=repr)


def test_added_spans(docs, found):
    texts, planted = corpus()
    spans = {r["doc_id"]: r["spans"].split(",") if r["spans"] else [] for r in found if r["doc_id"] is not None}
    caught = 0
    for i, pair in planted:
        named = {texts[i][int(s) : int(e)] for _, s, e in (x.split(":") for x in spans[i])}
        caught += all(p in named for p in pair)
    assert caught >= 36  # of 40, each lost by the patterns
    for i, text in enumerate(texts):
        base = {f"{k}:{s}:{e}" for k, s, e in plain_base(text)}
        assert base <= set(spans[i])
        taken = [tuple(map(int, x.split(":")[1:])) for x in spans[i] if x not in base]
        for s, e in taken:  # added spans are of a kind, whole, and clear of all others
            kind = next(x.split(":")[0] for x in spans[i] if x.endswith(f":{s}:{e}"))
            assert re.fullmatch(dict(PATTERNS)[kind], text[s:e]) and holds(kind, text[s:e])
            assert not any(a < e and s < b for a, b in (tuple(map(int, x.split(":")[1:])) for x in spans[i] if x != f"{kind}:{s}:{e}"))
    clean = [i for i, t in enumerate(texts) if t and not re.search("[0-9@]", t)]
    assert clean and not any(spans[i] for i in clean)


def test_skipped_windows_add_nothing(docs, monkeypatch):
    texts, _ = corpus()
    texts = [t or "" for t in texts][200:360]
    params = personal.train(docs, sample=60, steps=60)
    bases = [personal.base_spans(t)[0] for t in texts]
    accept = lambda: [personal.accepted(t, s, b) for t, s, b in zip(texts, personal.tagged(params, texts, bases), bases)]
    some = accept()
    every = lambda codes, base: [i * personal.STRIDE for i in range(max(0, -(-(len(codes) - personal.WINDOW) // personal.STRIDE)) + 1)]
    monkeypatch.setattr(personal, "window_starts", every)
    assert accept() == some and any(some)


def test_nothing_to_learn_from(spark, docs):
    assert personal.personal_digest(spark.createDataFrame([], fixture.SCHEMA)).collect() == []
    plain = docs.where("doc_id is null and text like 'zzz' or text in ('', '@', '256.1.1.1')")
    assert {r["spans"] for r in personal.personal_digest(plain).collect()} == {""}


def test_gradient():
    rng = np.random.default_rng(0)
    params = tagger.fresh(7, 3, 5, 0, np.float64)
    codes, tags = rng.integers(0, 7, (4, 6)), rng.integers(0, 5, (4, 6))
    _, grad = tagger.loss_and_gradient(params, codes, tags)
    for name, values in params.items():
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in values.shape)
            kept, step = values[at], 1e-6
            values[at] = kept + step
            up, _ = tagger.loss_and_gradient(params, codes, tags)
            values[at] = kept - step
            down, _ = tagger.loss_and_gradient(params, codes, tags)
            values[at] = kept
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-6


def test_paths_and_likelihood_by_enumeration():
    rng = np.random.default_rng(1)
    params = tagger.fresh(6, 4, 3, 2, np.float64)
    params["step"] = rng.standard_normal((3, 3))
    params["first"] = rng.standard_normal(3)
    codes, tags = rng.integers(0, 6, (5, 5)), rng.integers(0, 3, (5, 5))
    emissions, _ = tagger.run(params, codes)
    loss = 0.0
    for n in range(5):
        scores = {}
        for path in itertools.product(range(3), repeat=5):
            score = params["first"][path[0]] + sum(emissions[t, n, path[t]] for t in range(5))
            scores[path] = score + sum(params["step"][a, b] for a, b in zip(path, path[1:]))
        assert tuple(tagger.best_paths(params, emissions)[n]) == max(scores, key=scores.get)
        loss += np.log(sum(map(np.exp, scores.values()))) - scores[tuple(tags[n])]
    assert abs(loss / 5 - tagger.loss_and_gradient(params, codes, tags)[0]) < 1e-9


def test_reconciliation():
    cut = lambda s, e, score, left=False, right=False: (s, e, 2, score, left, right)
    assert personal.reconciled([cut(10, 48, 3.0, right=True), cut(40, 60, 5.0, left=True)]) == [(10, 60, 2)]
    assert personal.reconciled([cut(0, 10, 1.0), cut(5, 20, 5.0), cut(20, 30, 1.0)]) == [(5, 20, 2), (20, 30, 2)]
    rng = random.Random(2)
    for _ in range(50):  # the greatest total of disjoint spans
        spans = [(s, s + rng.randint(1, 9), rng.randint(0, 3), float(rng.randint(1, 50))) for s in (rng.randint(0, 30) for _ in range(8))]
        got = personal.reconciled([(*s, False, False) for s in spans])
        score = {}
        for s, e, kind, value in spans:
            score[s, e, kind] = max(value, score.get((s, e, kind), 0.0))
        disjoint = lambda group: all(a[1] <= b[0] for a, b in zip(sorted(group), sorted(group)[1:]))
        groups = (g for k in range(9) for g in itertools.combinations(score, k) if disjoint(g))
        assert disjoint(got) and sum(score[g] for g in got) == max(sum(score[x] for x in g) for g in groups)

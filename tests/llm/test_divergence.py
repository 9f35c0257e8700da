"""The divergence audit and its transducers against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from citeloom.llm import divergence
from citeloom.llm.transducer import Builder, Transducer

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, place int, value long"


def built(words):
    builder = Builder()
    for w in sorted(words):
        builder.add(w)
    return Transducer(builder.done())


def test_ordinals_of_random_words():
    r = random.Random(3)
    words = sorted({bytes(r.choice(b"abc\xc3\xa9") for _ in range(r.randrange(1, 9))) for _ in range(3000)})
    machine = built(words)
    assert machine.ordinals(words).tolist() == list(range(len(words)))
    assert [machine.word(i) for i in range(len(words))] == words
    others = [w + b"z" for w in words[:50]] + [w[:-1] + b"\xff" for w in words[:50]] + [b"", b"a" * 5000]
    assert (machine.ordinals(others) == -1).all()


def test_states_are_merged():
    words = [a + b + c for a in (b"a", b"b", b"c") for b in (b"x", b"y") for c in (b"", b"ing", b"ed")]
    assert len(built(words).finals) == 7  # the start, after one and two letters, after i, in and e, the end
    assert built([b""]).ordinals([b"", b"a"]).tolist() == [0, -1]


def brute(rows, least=3, best=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, *_ in rows]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, w in docs:
        df[lang].update(set(w))
        sources[lang].add(source)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in df.items()}
    for lang, source, w in docs:
        counts[lang, source].update(t for t in w if t in kept[lang])
        counts[lang, None].update(t for t in w if t in kept[lang])
    p = lambda g, t: 1 + 10**9 * (counts[g][t] + 1) // (sum(counts[g].values()) + len(kept[g[0]]))
    f = lambda p, q: (p - q) ** 2 // q
    out = []
    for lang, of in sources.items():
        for s in of:
            pairs = [(o, sum(f(p((lang, s), t), p((lang, o), t)) for t in kept[lang])) for o in of - {s}]
            terms = [(t, f(p((lang, s), t), p((lang, None), t))) for t in kept[lang] if counts[lang, s][t] and p((lang, s), t) > p((lang, None), t)]
            for part, items, most in (("pair", pairs, 10**9), ("term", terms, best)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i) for i, (t, v) in enumerate(items[:most], 1)]
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    words = ["Ab", "aB", "the", "été", "Été", "naïve", "x1y", "a-b", "中文", "𝔘nicode", "don't", "z" * 300] + [f"w{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    langs, sources = ["en", "fr", None, ""], ["s1", "s2", "ß3", None, ""]
    rows = [(i, " ".join(r.choice(words[: r.choice([5, 20, 72])]) for _ in range(r.randrange(0, 30))), r.choice(langs), r.choice(sources), 1, "x", 2, 3) for i in range(n)]
    rows += [rows[3], rows[3], (None, None, "en", "s1", 1, "", 0, 0), (None, "", "de", "only", 1, "", 0, 0), (5, "12 !! \x00", "de", "two", 1, "", 0, 0), (6, "ab " * 30_000 + "rare", "en", "long", 0, "", 0, 0)]
    return rows + [(7, "und und", "xx", "a", 0, "", 0, 0)] * 3 + [(8, "", "xx", "b", 0, "", 0, 0)]  # a language with one term


@pytest.mark.parametrize("how", [{}, {"shared_bytes": 0}, {"range_terms": 7}, {"range_terms": 7, "shared_bytes": 0, "best": 4}])
def test_against_brute_force(spark, how):
    rows = made(300, 11)
    got = divergence.audit(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, best=how.get("best", 200))


def test_counts_that_are_let_go(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "PAIRS", 16)
    monkeypatch.setattr(divergence, "BLOCK", 8)
    rows = made(100, 4)
    assert sorted(map(tuple, divergence.audit(spark, spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_shares_of_large_counts_are_exact():
    import numpy as np

    pairs = [(1, 3), (10**12, 3 * 10**12 + 7), (9 * 10**14, 9 * 10**14), (5, 9 * 10**15)]
    got = divergence.per_billion(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [1 + 10**9 * a // b for a, b in pairs]


def test_empty_table(spark):
    assert divergence.audit(spark, spark.createDataFrame([], SCHEMA)).count() == 0

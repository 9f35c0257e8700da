"""The grouped prefix join against brute force over all pairs of texts."""

import random

import pytest

from citeloom.llm import jaccard_join

SCHEMA = "doc_id long, text string, node long, comp long, key string, n int, component string"
ASCII = {chr(c): chr(c + 32) for c in range(65, 91)}


def brute(rows, t=85):
    sets = []
    for _, text, *_ in rows:
        w = "".join(ASCII.get(c, c) for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= t * (len(x) + len(sets[j]) - both):
                par[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def made(seed, families=25):
    """Families of texts that differ by a few words, passages that many share, and odd rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[r.choice(words) for _ in range(60)] for _ in range(3)]
    texts = []
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 40, 80, 150]))] + (r.choice(passages) if r.random() < 0.6 else [])
        for _ in range(r.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6]) if len(t) > 6 else 0):
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([[], [r.choice(words)], [t[i], r.choice(words)]])
            texts.append(" ".join(t))
    texts += [" ".join(p) for p in passages] * 2
    texts += [None, "", " \t\n", "one", "One", "one two", "ONE\vTWO", "É é", "é É", "a b c", "x " * 3000, "x " * 5, texts[0].upper(), texts[0].replace(" ", "\n")]
    r.shuffle(texts)
    rows = [(1000 - 3 * i, t, 1, 2, "k", 3, "c") for i, t in enumerate(texts)]
    return rows + [rows[0], (rows[1][0], rows[2][1], 0, 0, "", 0, ""), (None, rows[3][1], 0, 0, "", 0, ""), (None, "only here without an id", 0, 0, "", 0, ""), (None, None, 0, 0, "", 0, "")]


def got(spark, rows):
    found = jaccard_join.classes(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert got(spark, rows) == brute(rows)


def test_crowded_buckets_in_blocks(spark, monkeypatch):
    """With no centres, tiny blocks and one counter (so that order is by hash alone), pairs of blocks find the links."""
    monkeypatch.setattr(jaccard_join, "SIDE", 3)
    monkeypatch.setattr(jaccard_join, "CENTRES", 0)
    monkeypatch.setattr(jaccard_join, "COUNTERS", 12)
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    rows = made(7, 12)
    assert got(spark, rows) == brute(rows)


def test_one_prefix_many_members(spark):
    """Texts whose rarest shingles and size agree are one group; links within it are found as well."""
    head, r = [f"h{i}" for i in range(40)], random.Random(5)
    common = [[f"c{j}x{i}" for i in range(70)] for j in range(4)]
    texts = [" ".join(head + common[r.randrange(4)][:70]) for _ in range(12)] + [" ".join(c) for c in common for _ in range(9)]
    texts += [" ".join(head + common[0][: 60 + k] + [f"z{k}"] * (10 - k)) for k in range(10)]
    rows = [(i, t, 0, 0, "", 0, "") for i, t in enumerate(texts)]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert jaccard_join.classes(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes():
    """Words of any length, and by any place of a letter, are told apart; equal ones, whatever the case of A-Z, are not."""
    r = random.Random(5)
    words = {bytes(r.choices(b"ab\xc3\xa9z", k=r.choice([1, 2, 3, 31, 32, 33, 64, 65, 97, 300]))) for _ in range(5000)}
    words |= {b"a" * k + b"b" + b"a" * (99 - k) for k in range(100)}
    each = {w: int(jaccard_join.word_hashes(w)[0]) for w in words}
    assert len(set(each.values())) == len(words) and jaccard_join.word_hashes(b" \t\n\r\x0b\x0c").size == 0
    some = sorted(words)
    assert jaccard_join.word_hashes(b"\n " + b"\x0b\t".join(some).upper() + b" ").tolist() == [each[w] for w in some]
    assert jaccard_join.word_hashes(b"a\x1cb\x85")[0] != jaccard_join.word_hashes(b"a")[0]  # no white space here

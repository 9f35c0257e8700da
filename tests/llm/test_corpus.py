"""Operators over a corpus, against brute force on small fixtures."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("citeloom.llm")
import public_tokenizers
from pyspark.sql import functions as F

from citeloom.llm import components, decontamination, line_dedup, mixing, queries, repeats, simhash, token_files

SF = "/root/testdata/sf0.001"
R = random.Random(5)
WORDS = [f"w{k}" for k in range(300)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 7, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")


ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a b"), (6, "q " * 30000), (None, "no id at all here"), (8, "üñï çødé " * 40)]


def groups_of(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (12, 11), (12, 11)] + [(100 + k, 101 + k) for k in range(60)] + [(500, 501 + k) for k in range(50)]
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.components(spark, df).collect()}
    assert got == groups_of({x for e in edges for x in e}, edges)
    assert components.components(spark, df.limit(0)).count() == 0


def test_golay_keys_meet():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for k in range(300):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    keys = [defaultdict(set), defaultdict(set)]
    for side, prints in enumerate((x, y)):
        for row, key in zip(*simhash.golay_keys(prints)):
            keys[side][row].add(key)
    assert all(keys[0][k] & keys[1][k] for k in range(300))


def test_bucket_links(monkeypatch):
    rng = np.random.default_rng(4)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 20, 300, dtype=np.uint64), np.uint64(1 << 40) + rng.integers(0, 1 << 12, 200, dtype=np.uint64), np.arange(60, dtype=np.uint64)]))
    ids = np.arange(len(prints))
    near = [(a, b) for a in ids for b in ids[:a] if (int(prints[a]) ^ int(prints[b])).bit_count() <= 4]
    for crowd in (1_000, 20):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        found = list(zip(*simhash.bucket_links(ids, prints)))
        assert groups_of(ids, found) == groups_of(ids, near)


def test_simhash_groups(spark):
    base = [text(60) for _ in range(12)]
    rows = [(k, R.choice(base) + (" tail" if k % 5 == 0 else "")) for k in range(80)] + [(i, t) for i, t in ODD if i is not None for i in [i + 1000]]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark, docs_frame(spark, rows)).collect()}
    prints = {i: simhash.fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == groups_of(prints, linked)
    assert all(int(got[i].fingerprint, 16) == p for i, p in prints.items()) and got[1001].fingerprint == "0" * 16
    kept = simhash.one_of_each_group(spark, docs_frame(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got.values()} and kept.columns == docs_frame(spark, rows).columns
    assert simhash.near_duplicates(spark, docs_frame(spark, rows).limit(0)).count() == 0


def test_simhash_null_ids(spark):
    alone = [(None, text(60)) for _ in range(3)]
    shared = text(60)
    rows = [(3, shared), (None, shared), (1, text(60)), (None, None), (2, "")] + alone + alone[:1]
    got = simhash.near_duplicates(spark, docs_frame(spark, rows)).collect()
    prints = {f"{simhash.fingerprint(t):016x}": i for i, t in rows if i is not None}
    assert len(got) == len(rows) and all(r.component_id == prints.get(r.fingerprint) for r in got)
    kept = simhash.one_of_each_group(spark, docs_frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(3, shared), (1, rows[2][1]), (2, "")] + alone, key=repr)
    assert simhash.near_duplicates(spark, docs_frame(spark, ODD)).count() == len(ODD)
    assert sum(r.doc_id is None for r in simhash.one_of_each_group(spark, docs_frame(spark, ODD)).collect()) == 1


def removed(rows, span):
    seen = Counter(t[s : s + span] for _, t in rows for s in range(len(t) - span + 1))
    out = {}
    for i, t in rows:
        gone = {p for s in range(len(t) - span + 1) if seen[t[s : s + span]] > 1 for p in range(s, s + span)}
        out[i] = (len(t), len(gone), sum(p - 1 not in gone for p in gone), bytes(c for p, c in enumerate(t) if p not in gone))
    return out


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_repeats(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    passage = [text(90) for _ in range(4)]
    rows = [(k, " ".join(R.choice([text(R.randint(1, 60)), R.choice(passage), R.choice(passage)[: R.randint(150, 320)]]) for _ in range(4))) for k in range(40)]
    rows += [(100, "ab" * 300), (101, rows[0][1]), (102, rows[0][1]), (103, "z" * 199), (104, "y" * 200), (105, "x" * 201), (106, None), (107, ""), (108, "ü" * 150)]
    want = removed([(i, (t or "").encode()) for i, t in rows], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(spark, docs_frame(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("crowd", [2000, 2])
def test_repeats_of_rows_that_share_or_lack_an_id(spark, monkeypatch, crowd):
    """Rows are documents of their own: (id, text) by brute force over all rows."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    a, b, c = text(90), text(120), text(100)
    rows = [(1, text(70)), (1, a + " " + text(40)), (1, text(9) + a), (None, b), (5, "xyz " + b), (None, c + "1"), (None, c + "2"), (2, text(80)), (2, None), (7, c[:250]), (8, a[:230]), (9, text(50)), (9, text(50))]
    rows += [rows[0], (3, text(60)), (3, text(60))]  # a row that comes twice repeats as a whole
    want = removed([(k, (t or "").encode()) for k, (_, t) in enumerate(rows)], 200)
    got = repeats.remove_repeats(spark, docs_frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == sorted(((rows[k][0], *w) for k, w in want.items()), key=repr)
    assert want[0][1] == len(rows[0][1].encode()) and want[3][1] > 0


def test_repeat_groups_have_all_occurrences(spark):
    """A group of the tree is all places of its content, by brute force; together the groups cover what repeats."""
    shared = [text(60), text(75), text(90)]
    rows = [(k, " ".join(R.choice([text(R.randint(5, 30)), R.choice(shared), R.choice(shared)[R.randint(0, 60) :]]) for _ in range(3))) for k in range(25)] + [(90, shared[0] + "x"), (91, shared[0] + "y")]
    raw = {k: t.encode() for k, t in rows}
    found = repeats.repeat_groups(spark, docs_frame(spark, rows)).collect()
    groups, covered = {}, {k: set() for k in raw}
    for r in found:
        groups.setdefault((r.content, r.size), set()).add((r.doc_id, r.start))
        covered[r.doc_id].update(range(r.start, r.start + r.size))
    assert groups and all(len(g) > 1 and size >= 200 for (_, size), g in groups.items())
    for (content, size), places in groups.items():
        texts = {raw[k][a : a + size] for k, a in places}
        assert len(texts) == 1
        if "-" not in content:  # of the tree; a segment as a whole names its copies alone
            t = texts.pop()
            assert places == {(k, a) for k, whole in raw.items() for a in range(len(whole) - size + 1) if whole.startswith(t, a)}
    want = removed(list(raw.items()), 200)
    assert {k: len(c) for k, c in covered.items()} == {k: w[1] for k, w in want.items()}


def test_repeats_odd_rows(spark):
    got = repeats.remove_repeats(spark, docs_frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and next(r for r in got if r.doc_id == 6).n_removed == 60000 and next(r for r in got if r.doc_id is None).n_removed == 0
    assert repeats.remove_repeats(spark, docs_frame(spark, ODD).limit(0)).count() == 0


def test_repeats_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1_000)
    shared = text(300)
    rows = [(1, text(500) + " " + shared + " " + text(700)), (2, shared[3:] + text(200) + shared[:400]), (3, text(2000)), (4, "q " * 2500)]
    want = removed([(i, t.encode()) for i, t in rows], 200)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(spark, docs_frame(spark, rows)).collect()}
    assert got == want and want[3][1] == 0


def test_interval_tree():
    words = sorted([b"banana", b"bandana", b"ban", b"can", b"candle", b"x"])
    tree = {(words[a : b + 1][0], b - a + 1, n) for a, b, n in repeats.interval_tree(words)}
    assert (b"ban", 3, 3) in tree and (b"can", 2, 3) in tree
    assert all(len({w[:n] for w in words[a : b + 1]}) == 1 for a, b, n in repeats.interval_tree(words))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("tau", [1, 2])
def test_line_links(spark, tau):
    base = ["".join(R.choice("abcdé ") for _ in range(R.randint(6, 40))) for _ in range(40)] + ["".join(R.choice("abcdé ") for _ in range(n)) for n in (94, 97, 140)]

    def edited(s):
        s = list(s)
        for _ in range(R.randint(0, 3)):
            p = R.randrange(len(s))
            s[p : p + R.randint(0, 1)] = R.choice(["", "a", "é", "d"])
        return "".join(s)

    short = ["Page one", "Page on", "page one", "a b", "a c", "abc", "Chapter three", "Chapter thre", "Chaptr three"]
    rows = [(k, "\n".join([*(edited(R.choice(base)) for _ in range(5)), R.choice(short)])) for k in range(40)] + [(100, None), (101, ""), (102, "\n \n")]
    first = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                first.setdefault(line.strip(" \t\r\x0b\x0c"), (i, k))
    items = list(first.items())
    reach = lambda a, b: min(tau, min(len(a), len(b)) // 8)
    want = {(*min(p, q), *max(p, q), d) for n, (a, p) in enumerate(items) for b, q in items[:n] if abs(len(a) - len(b)) <= reach(a, b) and (d := distance(a, b)) <= reach(a, b)}
    assert {(first[a], first[b]) for a, b in (("Chapter three", "Chapter thre"), ("Chapter three", "Chaptr three")) if a in first and b in first} <= {(x[:2], x[2:4]) for x in want} | {(x[2:4], x[:2]) for x in want}
    assert want and {tuple(r) for r in line_dedup.links(spark, docs_frame(spark, rows), tau).collect()} == want
    report = {r.doc_id: r for r in line_dedup.report(spark, docs_frame(spark, rows), tau).collect()}
    assert len(report) == len(rows) and sum(r.n_first for r in report.values()) == len(first) and sum(r.n_links for r in report.values()) == 2 * len(want) and report[100].n_lines == 0
    assert line_dedup.report(spark, docs_frame(spark, rows).limit(0)).count() == 0


def test_line_report_of_copies(spark):
    line, other, third = "the quick brown fox jumps over it", "the quick brown fax jumps over it", "the quick brown fax jumps ower it!"
    rows = [(k, f"{line}\n\n  own line number {k * 1111111} of it {'xyzw'[k] * 9}") for k in range(4)] + [(9, f"{other}\nshort"), (12, third), (7, None), (None, line), (20, "short\n \nz"), (21, ""), (9, other + "\nelse")]
    got = {r.doc_id: r for r in line_dedup.report(spark, docs_frame(spark, rows)).collect()}
    assert len(got) == 10 and [got[k].n_linked for k in (0, 1, 2, 3, 9, 12, None, 7, 20)] == [1, 1, 1, 1, 2, 1, 1, 0, 0]
    assert [got[k].n_line_links for k in (0, 3, 9, 12, None)] == [1, 1, 4, 1, 1] and got[3].n_links == 0
    assert len({tuple(got[k].class_ids) for k in (0, 1, 2, 3, 9, 12, None)}) == 1 and len(got[0].class_ids) == 1 and got[20].class_ids == []
    assert got[None].text == line and [got[k].text for k in (0, 3)] == [r[1].split("\n", 1)[1] for r in (rows[0], rows[3])]
    assert sorted(got[9].text.split("\n")) == ["else", "short"] and got[12].text == "" and got[7].text is None and got[20].text == " \nz" and got[21].text == ""


def test_bit_parallel_distance(spark):
    pairs = []
    for k in range(600):
        a = "".join(R.choice("abé𝄞") for _ in range(R.randint(0, 40)))
        b = list(a)
        for _ in range(R.randint(0, 5)):
            p = R.randint(0, len(b))
            b[p : p + R.randint(0, 1)] = R.choice(["", "a", "é", "x"])
        pairs.append((k, a, "".join(b)))
    df = spark.createDataFrame(pairs, "k int, text_a string, text_b string").withColumn("_a", line_dedup.letters("text_a"))
    for tau in (1, 2, 3):
        got = {r.k: r.d for r in df.select("k", line_dedup.bit_parallel_distance("text_a", "text_b", tau).alias("d")).collect()}
        assert got == {k: d if (d := distance(a, b)) <= tau else -1 for k, a, b in pairs}


def shingles(t, n=5):
    w = t.lower().split()
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]


def test_decontamination(spark):
    items = [(k, text(R.randint(20, 50))) for k in range(15)] + [(90, "too Short item"), (91, None), (92, "dup " * 30), (93, " "), (94, "alone"), (95, "five words are in it"), (None, "no id")]
    rows = [(k, text(R.randint(5, 80))) for k in range(40)]
    for k, (_, t) in enumerate(items[:15]):
        words = t.split()
        if k % 3 == 0:
            words[len(words) // 2] = "edited"
        rows.append((100 + k, text(30) + " " + " ".join(words).upper() + " " + text(20)))
        rows.append((200 + k, " ".join(words[: len(words) // 2]) + " " + text(30)))
    rows += [(300, "dup " * 40), (301, None), (302, ""), (303, items[0][1]), (304, "this is a too short item here"), (305, "too short\nITEM"), (306, "too short"), (307, "alone"), (308, "five words are in it too"), (300, "dup " * 40), (300, items[2][1])]
    want = {}
    for i, t in rows:
        for j, item in items:
            width = min(5, len((item or "").split()))
            if j is None or not width:
                continue
            s = shingles(t or "", width)
            c = Counter(shingles(item or "", width))
            n = sum(c.values())
            for a in range(max(1, len(s) - n + 1) if n and s else 0):
                w = Counter(s[a : a + n])
                k = sum((w & c).values())
                sim = k / (sum(w.values()) + n - k)
                if sim >= 0.8 and sim > want.get((i, j), (0,))[0]:
                    want[i, j] = (sim, a)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.matches(spark, docs_frame(spark, rows), b).collect()}
    assert got == want and len(want) >= 10 and {(304, 90), (305, 90), (307, 94), (308, 95), (300, 2)} <= set(want) and (306, 90) not in want
    clean = decontamination.clean(spark, docs_frame(spark, rows), b)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want} and clean.columns == docs_frame(spark, rows).columns
    assert decontamination.matches(spark, docs_frame(spark, rows), b.limit(0)).count() == 0 and decontamination.clean(spark, docs_frame(spark, ODD), b).count() == len(ODD)


def test_windows_of_the_least_similarity_are_found(spark):
    """Items with one word of fifty changed, 41 of 51 shingles alike: every one is found, by the index as registered."""
    r = random.Random(12)
    items = [(k, " ".join(f"v{r.randrange(10**6)}" for _ in range(50))) for k in range(60)]
    rows = []
    for k, t in items:
        words = t.split()
        words[r.randrange(8, 42)] = "changed"
        rows.append((k, " ".join(f"v{r.randrange(10**6)}" for _ in range(30)) + " " + " ".join(words) + " and so on it goes"))
    found = decontamination.matches(spark, docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.start) for x in found} == {(k, k, 30) for k, _ in items} and {round(x.similarity, 4) for x in found} == {round(41 / 51, 4)}


def test_decontamination_index(spark):
    """The multi-index alone finds all fingerprints within the radius, and few others; the radius finds windows of similarity 0.8."""
    rng = np.random.default_rng(8)
    prints = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    rows = []
    for k, p in enumerate(prints.tolist()):
        for d in range(0, 24):
            q = p
            for b in rng.choice(64, d, replace=False).tolist():
                q ^= (1 << b) - (1 << 64) * (b == 63)
            rows.append((k, d, p, q))
    D = decontamination
    df = spark.createDataFrame(rows, "k int, d int, p long, q long")
    index, asked = D.flipped(D.RADIUS)
    sides = df.where(F.col("d") <= D.RADIUS).select("k", "d", D.near_blocks("p", index).alias("block")).join(df.select("k", "d", D.near_blocks("q", asked).alias("block")), ["k", "d", "block"])
    assert sides.select("k", "d").distinct().count() == 40 * (D.RADIUS + 1)
    assert df.where("d = 0").select("k", D.near_blocks("p", index)).count() == 40 * (4 * 92 + 79)  # an item's rows in the broadcast index: 1,811 before
    hit = F.lit(False)
    for b, (x, y) in enumerate(zip(D.blocks("p"), D.blocks("q"))):
        hit = hit | F.array_contains(D.near_values(b, x, D.RADIUS // D.BLOCKS), y)
    got = df.select("k", "d", hit.alias("hit"), F.size(F.array_distinct(D.near_values(0, D.blocks("p")[0], 3))).alias("n")).collect()
    assert all(r.hit for r in got if r.d <= D.RADIUS) and got[0].n == 1 + 12 + 66 + 220
    far = spark.range(20000).select(F.xxhash64("id").alias("p"), F.xxhash64("id", F.lit(1)).alias("q")).select(hit.alias("hit"))
    assert far.where("hit").count() < 5200  # 4 blocks with 378 of 8,192 values and one with 299 of 4,096
    found = total = 0
    for _ in range(40):  # windows of exactly the wanted similarity: 41 of 46 shingles alike
        item = [f"i{x}" for x in rng.integers(0, 10**6, 50)]
        window = list(item)
        window[int(rng.integers(8, 42))] = "other"
        a, b = ([hash_of(w[k : k + 5]) for k in range(46)] for w in (item, window))
        found += sum((print_of(a) >> c & 1) != (print_of(b) >> c & 1) for c in range(64)) <= D.RADIUS
        total += 1
    assert found >= 0.9 * total


def hash_of(words):
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words))


def print_of(hashes):
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_mixing(spark):
    rows = [(k, "x" * (1 + k % 50)) for k in range(3000)]
    df = docs_frame(spark, rows)
    targets = spark.createDataFrame([("s0", 6.0), ("s1", 3.0), ("s2", 0.0), ("none", 4.0)], "source string, weight double")
    out = mixing.replicate(df, targets).select("row.*").groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    total = sum(len(t) for _, t in rows)
    amounts = {r.source: r.n for r in out}
    assert set(amounts) == {"s0", "s1"} and amounts["s0"] == pytest.approx(6 / 9 * total, rel=0.1) and amounts["s1"] == pytest.approx(3 / 9 * total, rel=0.1)
    again = mixing.mix(df, targets)
    assert again.columns == df.columns and sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix(df.repartition(3), targets).collect()))
    assert mixing.mix(docs_frame(spark, ODD)).count() >= 0 and mixing.mix(df.limit(0)).count() == 0


def test_mixing_clashing_names(spark, tmp_path):
    names = ("rate", "steps", "place", "copy", "n_copies", "row", "_source", "k")
    df = docs_frame(spark, [(k, f"text {k}") for k in range(200)] + ODD).withColumns({c: F.lit(f"own {c}") for c in names})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_mixing_poisson(spark, str(tmp_path)).collect()
    plain = mixing.shuffle(mixing.replicate(docs_frame(spark, [(k, f"text {k}") for k in range(200)] + ODD))).collect()
    assert sorted(((r.doc_id, r.copy, r.text) for r in got), key=repr) == sorted(((r.row.doc_id, r.copy, r.row.text) for r in plain), key=repr)
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert mixed.columns == df.columns and {tuple(r[c] for c in names) for r in mixed.collect()} == {tuple(f"own {c}" for c in names)}


def test_poisson_steps(spark):
    import math

    rates = spark.createDataFrame([("a", 0.3), ("b", 7.5), ("c", 900.0), ("d", 0.0)], "source string, rate double")
    for r in mixing.poisson_steps(rates).collect():
        for k in (0, 1, 5, 20, 900):
            if r.rate and k < len(r.steps):
                exact = sum(math.exp(j * math.log(r.rate) - r.rate - math.lgamma(j + 1)) for j in range(k + 1))
                assert r.steps[k] == pytest.approx(exact, abs=1e-9)
        assert not r.rate or r.steps[-1] == pytest.approx(1, abs=1e-9)


def test_code_lengths():
    import heapq

    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 90, 2000):
        counts = {i: int(c) for i, c in enumerate(rng.integers(1, 1000, n))}
        lengths = token_files.code_lengths(counts)
        heap, cost = sorted(counts.values()), 0
        while len(heap) > 1:
            a = heapq.heappop(heap) + heapq.heappop(heap)
            cost += a
            heapq.heappush(heap, a)
        assert n == 1 or sum(counts[i] * b for i, b in lengths.items()) == cost and sum(2.0**-b for b in lengths.values()) == 1
    tight = token_files.code_lengths({i: 1 << i for i in range(30)}, 6)
    assert max(tight.values()) <= 6 and sum(2.0**-b for b in tight.values()) <= 1


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, (9, "Don't İstanbul ΣΑΣ <|endoftext|>x ŉ ſ 12,5% é"), (-3, "first of all"), *[(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id between 20 and 60").collect()]]
    token_files.write(spark, docs_frame(spark, rows), path, f"{tmp_path}/f", parts=3)
    got = token_files.read(spark, f"{tmp_path}/f").orderBy("start").collect()
    encoder, at = Tokenizer.from_file(path), 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.cells, "<u4").tolist() == ids
        at += len(ids)
    assert spark.read.parquet(f"{tmp_path}/f/blocks").select("part").distinct().count() == 3
    token_files.write(spark, docs_frame(spark, rows).limit(0), path, f"{tmp_path}/e")
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0


def test_words_equal_the_library(monkeypatch):
    import pyarrow as pa

    texts = [None, "", " ", "a\x1cb", "<|endoftext|>x <|startoftext|>", "x" * 5000]
    parts = [*map(chr, range(33, 127)), *(chr(R.randint(0xA0, 0x3000)) for _ in range(400)), " ", "  \n", "'s", "'LL", "\u0301", "<|endoftext|>", "12"]
    texts += ["".join(R.choice(parts) for _ in range(R.randint(1, 30))) for _ in range(1500)]
    for name, room in (("word_bpe_49k.json", 1_000_000), ("word_bpe_49k.json", 50), ("byte_bpe_50k.json", 50)):
        words = token_files.Words(public_tokenizers.path(name), room)
        assert words.by_piece == name.startswith("word")
        for some in (texts, texts[::-1], texts[:9]):
            ids, sizes = words(pa.array(some, pa.string()))
            ends = np.cumsum(sizes)
            for t, a, b in zip(some, ends - sizes, ends):
                assert ids[a:b].tolist() == [*words.encoder.encode(t or "", add_special_tokens=False).ids, 2]
    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"), 100)
    often = pa.array([" ".join(f"often{k % 9}é" for k in range(20)) + " " + " ".join(f"once{j}x{k}" for k in range(60)) for j in range(2)])
    for k in range(2):
        words(often.slice(k, 1))
    words(pa.array(["new"]))  # the store is full: what both texts hold stays
    assert set(words.pieces.number) >= {f"often{k}é" for k in range(9)} and len(words.pieces.number) <= 27
    assert token_files.cell_type(1 << 16) == np.uint16 and token_files.cell_type((1 << 16) + 1) == np.uint32


def test_words_are_kept_once():
    """Signs and capitals beside a word make no further piece of it, and pieces are all that a worker keeps."""
    import pyarrow as pa

    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"), 100)
    texts = ["Éword éword, (éword) ÉWORD!", "it's 'tis '", "s 'LL'll ''s x'", "a\u00d7b'd", "<|endoftext|> <|ENDOFTEXT|>", None, "rock'n'roll's'"]
    ids, sizes = words(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == [*words.encoder.encode(t or "", add_special_tokens=False).ids, 2]
    signs = {",", "(", ")", "!", "'", "''", "<|", "|>"}
    assert set(words.pieces.number) == signs | {"éword", "it", "'s", "'t", "is", "s", "'ll", "x", "a\u00d7b'd", "<|endoftext|>", "endoftext", "rock", "n", "roll"}
    assert [k for k, x in vars(words).items() if isinstance(x, token_files.Store)] == ["pieces"]


def test_words_are_learned_once(monkeypatch):
    """What is handed to the store grows with the different words, not with what stands around them."""
    import pyarrow as pa

    learned, add = [], token_files.Store.add
    monkeypatch.setattr(token_files.Store, "add", lambda self, names, *a: (learned.extend(names), add(self, names, *a))[1])
    words = token_files.Words(public_tokenizers.path("word_bpe_49k.json"), 1_000)
    plain = [f"word{chr(97 + k // 10)}{chr(97 + k % 10)}é" for k in range(50)]
    for sign in ("{}", "({})", "{},", "'{}.", "{}'s"):
        for form in (str.lower, str.upper, str.title):
            words(pa.array([" ".join(sign.format(form(w)) for w in plain)]))
    assert sorted(learned) == sorted([*plain, "(", ")", ",", "'", ".", "'s"])


def test_queries_cover_every_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op5_repeats_interval_tree", "op6_token_huffman", "op7_line_edit_join", "op8_simhash_golay"):
        assert queries.QUERIES[name](spark, SF).count() == n
    crc = queries.QUERIES["op6_token_huffman"](spark, SF).orderBy("start").first()
    assert crc.start == 0 and 0 <= crc.ids_crc32 < 1 << 32 and zlib.crc32(b"") == 0

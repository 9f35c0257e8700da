"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language knows every string that the text holds.  A document is parsed, from
left to right, into the longest phrases that a language's text holds (a letter it lacks is a phrase of its own); phrases
a symbol estimate the cross entropy (Ziv and Merhav), and the language that needs the fewest wins.  Many documents are
walked together, one symbol a step, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bounds of the sample that the automata are built from: symbols a language, of one document in it, of all languages.
SAMPLE, OF_ONE, IN_ALL = 40_000, 1_000, 2_000_000
#: Symbols of a text that a lane parses, bytes of texts that are walked together.
BLOCK, TOGETHER = 512, 1_000_000
#: Levels: symbols of documents that count, documents that one needs, factor over their median, phrases that any text may have besides.
LONG, ENOUGH, SLACK, SHORT = 256, 20, 2.25, 3
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def symbols(text: str) -> str:
    """Lower case; every run of what is neither a letter nor a mark on one is one space; empty without a letter."""
    return " ".join(LETTERS.findall(text.lower())) if LETTER.search(text) else ""


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions, by state and symbol, of the smallest automaton that knows all substrings of ``text``; 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    at = 0
    for c in text:
        new = len(size)
        moves.append({})
        size.append(size[at] + 1)
        link.append(0)
        p = at
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        at = new
    return moves


class Table:
    """Transitions key -> value in one open-addressed table: as many cells as two to four times their number."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, slot = np.arange(len(keys)), self.place(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, one = np.unique(slot[free], return_index=True)  # of several for a cell, one gets it
            put = np.flatnonzero(free)[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            stays = np.ones(len(left), bool)
            stays[put] = False
            left, slot = left[stays], (slot[stays] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        slot = self.place(keys)
        there = self.keys[slot]
        same = there == keys
        out = np.where(same, self.values[slot], -1)
        left = np.flatnonzero(same < (there >= 0))  # a cell of another key: look further
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Model:
    """The automata of all languages.  Every letter of the samples has a symbol; 0 is a letter that none of them has.

    A state is written as its number times the number of symbols, so that state + symbol is a key of the table.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.levels: dict[str, float] = {}
        letters = sorted(set("".join(samples.values())))
        self.width = len(letters) + 1
        self.code = np.zeros(ord(letters[-1]) + 2 if letters else 2, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.width)
        keys, values, self.roots, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
        for lang in self.langs:
            moves = suffix_automaton(self.code[[ord(c) for c in samples[lang]]].tolist())
            sizes = np.fromiter(map(len, moves), np.int64, len(moves))
            keys.append((np.repeat(np.arange(len(moves)), sizes) + n) * self.width + np.fromiter(chain.from_iterable(moves), np.int64))
            values.append((np.fromiter(chain.from_iterable(m.values() for m in moves), np.int64) + n) * self.width)
            self.roots.append(n * self.width)
            n += len(moves)
        self.table = Table(np.concatenate(keys), np.concatenate(values))

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(symbols(text).encode("utf-32-le", "replace"), np.uint32)
        return self.code[np.minimum(points, len(self.code) - 1)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language): phrases that each text falls into, each text parsed whole from its start.

        A lane is a block of a text under a language; all lanes take a symbol a step.  A block's parse starts at its
        first symbol as if a phrase began there, and the parse of the block before goes on into it until both begin a
        phrase at the same symbol: from there on they are one.  So a text's phrases are those of its blocks less what a
        block has before that symbol.  A text whose parses do not meet within a block is parsed by itself.
        """
        langs, out = len(self.langs), np.zeros((len(texts), len(self.langs)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not langs or not sizes.sum():
            return out
        flat, offsets = np.concatenate(texts), np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        at, end = offsets[owner] + BLOCK * nth, (offsets + sizes)[owner]
        length = np.minimum(BLOCK, end - at)
        order = np.argsort(-length, kind="stable")  # those that have ended are always the last lanes
        owner, at, end, length = (np.repeat(x[order], langs) for x in (owner, at, end, length))
        j = np.tile(np.arange(langs), len(order))
        root, row = np.array(self.roots, np.int64)[j], j * self.width
        first = np.stack([self.table.find(r + np.arange(self.width)) for r in self.roots])  # by language and symbol
        first = np.where(first < 0, np.array(self.roots)[:, None], first).ravel()
        state, count, begins = root.copy(), np.zeros(len(at), np.int64), np.zeros(len(flat) * langs, bool)

        def step(m, places: np.ndarray) -> np.ndarray:
            """Takes a symbol in some lanes; tells which begin a phrase with it.  A letter that no sample has is a phrase."""
            c = flat[places]
            now = self.table.find(state[m] + c)
            new = (state[m] == root[m]) | (now < 0)
            state[m] = np.where(new, first[row[m] + c], now)
            return new

        alive = np.searchsorted(-length, -np.arange(length[0]), side="left").tolist()
        for k in range(length[0]):
            m = slice(0, alive[k])
            new = step(m, at[m] + k)
            count[m] += new
            begins[(at[m] + k) * langs + j[m]] = new
        lanes, place = np.arange(len(at)), at + BLOCK
        ahead, alone = place < end, set()
        lanes, place = lanes[ahead], place[ahead]
        while len(lanes):  # on into the next block, until both begin a phrase at one symbol
            new = step(lanes, place)
            met = new & begins[place * langs + j[lanes]]
            count[lanes] += new & ~met
            place = place + ~met
            done = met | (place >= end[lanes])
            for lane, p in zip(lanes[done].tolist(), place[done].tolist()):
                start = at[lane] + BLOCK
                count[lane] -= np.count_nonzero(begins[start * langs + j[lane] : p * langs + j[lane] : langs])
            lost = ~done & (place >= at[lanes] + 2 * BLOCK)
            alone.update(zip(owner[lanes[lost]].tolist(), j[lanes[lost]].tolist()))
            lanes, place = lanes[~done & ~lost], place[~done & ~lost]
        np.add.at(out, (owner, j), count)
        for k, lang in alone:
            out[k, lang] = self.walk(texts[k].tolist(), self.roots[lang])
        return out

    def walk(self, text: list[int], root: int) -> int:
        """Phrases of one text under one language, by itself."""
        if "moves" not in vars(self):
            used = self.table.keys >= 0
            self.moves = dict(zip(self.table.keys[used].tolist(), self.table.values[used].tolist()))
        get, at, n = self.moves.get, root, 0
        for c in text:
            now = get(at + c)
            if at == root or now is None:
                n += 1
                now = get(root + c, root)
            at = now
        return n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score): score is 1 - fewest / (fewest + next fewest) phrases, so 0.5 says that two are alike."""
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether the text reads like it: no more phrases than its ``levels`` allow; True without one)."""
        coded = [self.encode(t or "") for t in texts]
        counts, out = self.phrases(coded), []
        for row, code in zip(counts, coded):
            if not len(code) or not self.langs:
                out.append(("und", 0.0, False))
                continue
            order = np.argsort(row, kind="stable")  # ties: the first in alphabetical order
            best, second = int(row[order[0]]), int(row[order[1]]) if len(order) > 1 else 2 * int(row[order[0]])
            lang = self.langs[order[0]]
            level = self.levels.get(lang)
            out.append((lang, second / (best + second), level is None or best <= level * len(code) + SHORT))
        return out

    def learn_levels(self, held: dict[str, list[str]]) -> None:
        """Phrases a symbol that a language's own text may need: the median of its documents in ``held``, which no
        automaton has seen, times ``SLACK``.  A language with fewer than ``ENOUGH`` of them gets the largest other level."""
        for lang, texts in held.items():
            coded = [c for c in map(self.encode, texts) if len(c) >= LONG]
            if lang in self.langs and len(coded) >= ENOUGH:
                counts = self.phrases(coded)[:, self.langs.index(lang)]
                self.levels[lang] = SLACK * float(np.median([n / len(c) for n, c in zip(counts.tolist(), coded)]))
        if self.levels:
            self.levels = {lang: self.levels.get(lang, max(self.levels.values())) for lang in self.langs}


def train(labelled: DataFrame, sample: int = SAMPLE, of_one: int = OF_ONE, in_all: int = IN_ALL) -> Model:
    """Automata from ``labelled`` (doc_id, text, lang): per language at most ``sample`` symbols of text, at most
    ``of_one`` of a document, documents in the order of a hash of their id.  Null labels and null texts teach nothing.

    All samples together have at most ``in_all`` symbols (beyond 50 languages each gets an equal part), and so the
    automata at most three times as many transitions, 50 bytes each at most.  The rows that reach the driver are
    bounded: 4 * sample / of_one a language, cut to 2 * ``of_one`` code points.
    """
    known = labelled.where("lang is not null and text is not null")
    counts = dict(known.groupBy("lang").count().collect())
    if not counts:
        return Model({})
    sample = max(of_one, min(sample, in_all // len(counts)))
    rows = 4 * sample // of_one
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * rows / n))))
    point = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    one = known.where(point <= share[F.col("lang")]).select("lang", F.col("text").substr(1, 2 * of_one).alias("part"), F.xxhash64("doc_id").alias("h"))
    best = one.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("r") <= rows)
    samples: dict[str, str] = {}
    held: dict[str, list[str]] = {}
    for lang, part in best.orderBy("lang", "r").select("lang", "part").collect():
        had = samples.get(lang, "")
        if len(had) < sample:
            samples[lang] = (had + " " + symbols(part)[:of_one])[:sample]
        else:
            held.setdefault(lang, []).append(symbols(part)[:of_one])
    model = Model({k: v for k, v in samples.items() if v.strip()})
    model.learn_levels(held)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document from its whole text alone; no shuffle.

    Null text and text without a letter: ``und`` with score 0.  A tie goes to the alphabetically first language.
    The model travels to the executors as a broadcast whose size the bounds of the sample bound.
    """
    shared = common.share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared()
        for batch in batches:
            for part in common.slices(batch, 1, 1024, TOGETHER):
                ids, words = part.column(0), part.column(1).to_pylist()
                found = judge.predict(words)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has letters, a language of at least ``least_score``
    (0.5 takes ties), and no more phrases than the language's level allows: letter junk and unknown languages go."""
    shared, at, schema = common.share(docs.sparkSession, model), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared()
        for batch in batches:
            for part in common.slices(batch, at, 1024, TOGETHER):
                found = judge.judge(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != "und" and sound and score >= least_score for lang, score, sound in found], pa.bool_()))

    return docs.mapInArrow(run, schema)


def fold(parts: int):
    """crc32 of the doc_id's text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts

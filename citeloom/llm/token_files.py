"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode alone.

The file format is a folder of two Parquet datasets, so that any store that Spark reads and writes will do:

``codebook``  id, bits: the code length of every id that occurs.  Codes are canonical: by (bits, id), counting up.
``blocks``    part, block, before, doc_ids, lengths, payload, checkpoints: the ids of the part before this block, some
              documents in ascending doc_id order, their numbers of ids, the bit stream (first bit of a code first, most significant bit of a byte first; each
              document from a whole byte on) and the bit offset of every ``STRIDE``-th id of each document, where a
              decoder may start.
``parts``     part, n_tokens: how many ids each part holds; parts follow one another in doc_id order.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: End id, longest code, ids a checkpoint, ids a block, pieces a worker remembers, new pieces encoded at a time,
#: bytes of texts that are cut into pieces together.
END, MOST_BITS, STRIDE, BLOCK_TOKENS, CACHE, TOGETHER, AT_ONCE = 2, 20, 128, 1 << 18, 300_000, 4_000, 4_000_000


def code_lengths(counts: dict[int, int], most: int = MOST_BITS) -> dict[int, int]:
    """Best prefix-code lengths of at most ``most`` bits, by merging packages of equal width from the rarest ids up."""
    order = sorted(counts, key=lambda i: (counts[i], i))
    n = len(order)
    if n <= 1:
        return dict.fromkeys(order, 1)
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of over {most} bits")
    weights = np.array([counts[i] for i in order], np.int64)
    # A level's list: ids (-1 - rank, ascending weight) merged with pairs of the level below.
    levels = []
    pairs = np.zeros(0, np.int64)
    for _ in range(most):
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        merged = both[rank]
        even = len(merged) // 2 * 2
        pairs = merged[0:even:2] + merged[1:even:2]
    bits = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(levels):  # what is taken of a level: its first entries; its packages take twice as many below
        leaves = int(leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    return dict(zip(order, bits.tolist()))


class Codebook:
    """Canonical codes of ids, and the table that decodes them."""

    def __init__(self, lengths: dict[int, int]):
        self.lengths = lengths
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.ids = np.array(order, np.int64)
        self.bits = np.array([lengths[i] for i in order], np.int64)
        self.width = int(self.bits.max()) if len(order) else 1
        starts = np.concatenate([[0], np.cumsum(1 << (self.width - self.bits))])[:-1]  # left-aligned codes count up
        size = int(self.ids.max()) + 1 if len(order) else 1
        self.code, self.size = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids], self.size[self.ids] = (starts >> (self.width - self.bits)).astype(np.uint64), self.bits
        table = np.repeat(np.arange(len(order)), 1 << (self.width - self.bits))
        table = np.concatenate([table, np.zeros((1 << self.width) - len(table), np.int64)])  # a single id leaves half unused
        self.table_id = self.ids[table].astype(np.uint32) if len(order) else np.zeros(2, np.uint32)
        self.table_bits = self.bits[table].astype(np.uint8) if len(order) else np.ones(2, np.uint8)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bit stream, bit offset of every STRIDE-th id)."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        offs = ends - sizes
        total = int(ends[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, np.uint64)
        word, room = offs >> 6, 64 - (offs & 63) - sizes  # room left of the code in its word; negative: goes on in the next
        code = self.code[ids]
        here = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            words[word[first]] |= np.bitwise_or.reduceat(here, first)
            over = np.flatnonzero(room < 0)
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)  # one code at most runs on into a word
        return words.astype(">u8").tobytes()[: (total + 7) // 8], offs[::STRIDE].astype(np.int64)

    def decode(self, payload: bytes, checkpoints: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids of a block, one document after another: all checkpoints are walked together, a table look-up a step."""
        lanes = -(-lengths // STRIDE)
        left = np.full(int(lanes.sum()), STRIDE)
        full = lengths > 0
        left[np.cumsum(lanes)[full] - 1] = lengths[full] - STRIDE * (lanes[full] - 1)
        out = np.zeros((len(left), STRIDE), np.uint32)
        data = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        # windows of 32 bits from every byte on: a code of at most 24 bits fits in after a shift of up to 7
        window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        at, last = checkpoints.astype(np.int64), 8 * len(payload)
        mask, drop = np.uint32((1 << self.width) - 1), 32 - self.width
        for k in range(int(left.max(initial=0))):
            key = (window[at >> 3] >> (drop - (at & 7)).astype(np.uint32)) & mask
            out[:, k] = self.table_id[key]
            at = np.minimum(at + self.table_bits[key], last)  # a lane that has ended walks on unread
        return out[np.arange(STRIDE) < left[:, None]]


#: What a text is cut into by the pattern that ``cut`` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters of two bytes that are lower-cased one by one, and that normal form C leaves as they are in words of them alone.
LETTERS = [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x132, 0x149), *range(0x14A, 0x179)]
#: Kinds of bytes: white space, letters and digits, other signs, what only the encoder knows.
SPACE, LETTER, SIGN, OTHER = range(4)


DIGIT = re.compile("[0-9]")  # each is a match of its own


def byte_tables() -> tuple[bytes, bytes, np.ndarray]:
    """(kind of each byte, each byte lower-cased, and for two bytes of one of ``LETTERS``, high byte first, those of the small one, else 0)."""
    kinds = [SPACE if chr(b) in " \t\n\v\f\r" else OTHER if not 32 < b < 127 else LETTER if chr(b).isalnum() else SIGN for b in range(256)]
    pairs = np.zeros(1 << 16, np.uint16)
    for x in map(chr, LETTERS):
        pairs[int.from_bytes(x.encode())] = int.from_bytes(x.lower().encode())
    return bytes(kinds), bytes(range(256)).lower(), pairs


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class Store:
    """Runs of ids by number, and how often each was met again."""

    def __init__(self, kind: type):
        self.number: dict[str, int] = {}
        self.starts, self.sizes, self.used, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), 0, np.zeros(1 << 14, kind)
        self.again = np.zeros(1 << 12, np.int32)

    def add(self, names: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(self.number), self.used
        while n + len(names) > len(self.starts):
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.again))
        while k + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[k : k + len(ids)] = ids
        self.sizes[n : n + len(names)], self.starts[n : n + len(names)] = sizes, k + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.number.update(zip(names, range(n, n + len(names))))

    def meet(self, names: list[str]) -> np.ndarray:
        """Numbers, -1 where unknown; what is known counts as met again."""
        number = np.fromiter(map(self.number.get, names, itertools.repeat(-1)), np.int64, len(names))
        self.again[number[number >= 0]] += 1
        return number

    def most_met(self, most: int) -> Store:
        """A store of what was met again, the first ``most`` of it by how often; counts begin anew."""
        met = np.flatnonzero(self.again[: len(self.number)])
        if len(met) > most:
            met = np.sort(met[np.argpartition(-self.again[met], most)[:most]])
        names, out = list(self.number), Store(self.ids.dtype)
        out.add([names[k] for k in met.tolist()], self.sizes[met], self.runs(met)[0])
        return out

    def runs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs one after another, ends of the runs with 0 in front)."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.arange(ends[-1], dtype=np.int32) + np.repeat(self.starts[numbers] - ends[:-1].astype(np.int32), sizes)], ends


class Words:
    """Ids of texts by an encoder of the tokenizers library.

    Where an encoder drops white space (which is tried out on a few strings), its ids of a text are those of its pieces
    between ASCII white space, in order.  Where it lower-cases and then takes what matches ``PATTERN``, a piece of plain
    letters, digits and signs is cut further, into runs of letters and digits and runs of signs, which numpy finds in
    the bytes of many texts.  Arrow numbers these; only those not met before go to the library, many at a time (plain
    ones to its model), and numpy puts the ids of all in place.  What is kept is bounded: a full store keeps what was
    met again since it was last full.  Any other encoder gets whole texts.
    """

    def __init__(self, path: str, room: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder, self.room = Tokenizer.from_file(path), room
        self.kind = cell_type(self.encoder.get_vocab_size())
        plain = lambda t: self.encoder.encode(t, add_special_tokens=False).ids
        self.by_piece = all(plain(t) == [i for w in t.split() for i in plain(w)] for t in (" a", "a b", "a  b\n", "A. b!\tC's 12", "\x0b\xe9 e\u0301 "))
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        kinds = [x["type"] for x in (plan.get("normalizer") or {}).get("normalizers", [])]
        splits = [x for x in (plan.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        known = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and splits[0]["pattern"].get("Regex") == PATTERN
        self.special = [x["content"].encode() for x in plan.get("added_tokens", [])]
        self.plain = Tokenizer(self.encoder.model)  # the model, words as they are
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        stop = byte_letters()[10]
        stops = self.encoder.model.tokenize(stop)
        self.cuts, self.stop_id = known and len(stops) == 1, stops[0].id if stops else None
        self.letters = np.array([32 if b == 32 else ord(x) for b, x in enumerate(byte_letters())], np.uint16)
        self.kinds, self.small, self.pairs = byte_tables()
        if not self.cuts:
            self.kinds = bytes(OTHER if k > SPACE else SPACE for k in self.kinds)
        self.pieces = Store(self.kind)

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """(what the texts are cut into, whether only the encoder knows it, where each text's begin and the last one's end)."""
        joined = bytearray(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer())
        joined += b"\n\n\n"  # the last text ends, and there are bytes to look at behind
        raw, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(self.kinds), np.uint8)
        data = np.frombuffer(joined.translate(self.small), np.uint8) if self.cuts else raw
        if self.cuts:
            lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
            pair = self.pairs[(raw[lead].astype(np.uint16) << 8) | raw[lead + 1]]
            lead, pair = lead[pair > 0], pair[pair > 0]
            data[lead], data[lead + 1] = pair >> 8, pair & 255
            kinds[lead] = kinds[lead + 1] = LETTER
            for x in self.special:  # the encoder looks for these first
                at = joined.find(x)
                while at >= 0:
                    kinds[at], at = OTHER, joined.find(x, at + 1)
            if (kinds == OTHER).any():  # to the whole piece, as it was
                solid = kinds > SPACE
                edge = np.concatenate([[0], np.flatnonzero(solid[1:] != solid[:-1]) + 1])
                whole = np.repeat(np.maximum.reduceat(kinds, edge) == OTHER, np.diff(edge, append=len(kinds)))
                kinds[whole], data[whole] = OTHER, raw[whole]
        starts = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]]).astype(np.int32)
        kind = kinds[starts[:-1]]
        # A sign run of one apostrophe takes these letters of the next run: 's 't 'm 'd 're 've 'll.
        mark = np.flatnonzero((kind[:-1] == SIGN) & (kind[1:] == LETTER) & (data[starts[:-2]] == 39) & (np.diff(starts[:-1]) == 1))
        one, two = data[starts[mark + 1]], data[starts[mark + 1] + 1]
        more = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int32)
        more[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
        starts[mark + 1] += more
        own = (kind > SPACE) & (starts[1:] > starts[:-1])
        sizes, other = np.diff(starts)[own], kind[own] == OTHER
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[kinds > SPACE])).dictionary_encode()
        first = np.cumsum(np.concatenate([[0], pc.binary_length(texts).to_numpy() + 1]))
        foreign = np.zeros(len(coded.dictionary), bool)
        foreign[coded.indices.to_numpy()[other]] = True
        return coded, foreign, np.searchsorted(starts[:-1][own], first)

    def learn(self, names: list[str], foreign: np.ndarray) -> None:
        """Numbers new pieces, counting up: plain ones by the model, then those that are ``foreign`` to it by the encoder."""
        plain = [names[k] for k in np.flatnonzero(~foreign).tolist()]
        for a in range(0, len(plain), TOGETHER):
            part, texts = plain[a : a + TOGETHER], []
            for b in range(0, len(part), 100):  # a few as one text, with the line break's letter behind each: it stands in none
                text = DIGIT.sub(r" \g<0> ", " \n ".join(part[b : b + 100])) + " \n"
                texts.append(self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le"))
            ids = np.array([i for e in self.plain.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int64)
            own = ids != self.stop_id
            self.pieces.add(part, np.bincount(np.cumsum(~own)[own], minlength=len(part)), ids[own])
        others = [names[k] for k in np.flatnonzero(foreign).tolist()]
        for a in range(0, len(others), TOGETHER):  # as one text, whose offsets tell the pieces apart
            part = others[a : a + TOGETHER]
            made = self.encoder.encode(" ".join(part), add_special_tokens=False)
            first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in part])])
            at = np.fromiter((x for x, _ in made.offsets), np.int64, len(made.ids))
            self.pieces.add(part, np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(part)), np.array(made.ids, self.kind))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, one after another; their numbers of ids)."""
        texts = texts.fill_null("")
        if not self.by_piece:
            rows = [[*e.ids, END] for e in self.encoder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for r in rows for i in r], self.kind), np.array([len(r) for r in rows], np.int64)
        coded, foreign, first = self.cut(texts)
        names = strings(coded.dictionary)
        if len(self.pieces.number) > self.room:
            self.pieces = self.pieces.most_met(self.room // 2)
        number = self.pieces.meet(names)
        if (new := np.flatnonzero(number < 0)).size:
            self.learn([names[k] for k in new.tolist()], foreign[new])
            number[new[np.argsort(foreign[new], kind="stable")]] = np.arange(len(self.pieces.number) - len(new), len(self.pieces.number))
        ids, ends = self.pieces.runs(number[coded.indices.to_numpy()])
        counts = np.diff(ends[first])
        out = np.full(len(ids) + len(counts), END, self.kind)
        out[np.arange(len(ids), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32), counts)] = ids
        return out, counts + 1


def strings(pieces: pa.Array) -> list[str]:
    """A list of strings without white space: joined by Arrow and split by Python, many times as fast as one by one."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), "\n")[0].as_py().split("\n")


def cell_type(vocabulary: int) -> type:
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def cells(batch: pa.RecordBatch, column: int, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]


TOKENS = "doc_id long, ids binary, counts binary"


def tokenize(docs: DataFrame, path: str, room: int = CACHE) -> DataFrame:
    """(doc_id, ids, counts): ids of a document in little-endian cells, the end id last.  Null text: the end id alone.

    A worker remembers about ``room`` pieces, from task to task; fewer take less memory and more time.

    A task's last row has ids null, the bytes of a cell as doc_id, and in ``counts`` how often the task has met each id
    (64-bit cells).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = common.worker_state()  # a worker process keeps its store for its next task
        words = state.get((path, room)) or state.setdefault((path, room), Words(path, room))
        total, cell = np.zeros(0, np.int64), np.dtype(words.kind).itemsize
        for batch in batches:
            for part in common.slices(batch, 1, 2048, AT_ONCE):
                ids, sizes = words(part.column(1))
                seen = np.bincount(ids, minlength=len(total))
                seen[: len(total)] += total
                total = seen
                offsets = np.concatenate([[0], np.cumsum(sizes * ids.itemsize)])
                made = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), made.cast(pa.binary()), pa.nulls(len(sizes), pa.binary())], ["doc_id", "ids", "counts"])
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["doc_id", "ids", "counts"])

    return common.texts(docs).mapInArrow(run, TOKENS)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in cells(batch, 0, np.int64):
                ids = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n[ids])], ["id", "n"])

    return tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = "part int, block int, before long, doc_ids array<long>, lengths array<long>, payload binary, checkpoints array<long>"


def write(spark: SparkSession, docs: DataFrame, path: str, folder: str, parts: int | None = None, room: int = CACHE) -> None:
    """Encodes every text of ``docs`` (doc_id, text) and writes the files to ``folder``, in ascending doc_id order.

    Rows of one doc_id (or null, which comes first) stand in the order of their ids' bytes.  Texts are tokenized once
    and shuffled once, as ids; each part then encodes its own.  The driver gets one count for each id of the vocabulary,
    never documents or the tokenizer.
    """
    scratch = common.Scratch(spark, "tokens")
    tokens = scratch.save(tokenize(docs, path, room))
    last = tokens.where("ids is null").select("doc_id").first()  # the workers know the vocabulary: it would stay in the driver's memory
    kind = np.dtype(f"u{last.doc_id if last else 2}")
    counts = {int(r.id): int(r.n) for r in id_counts(tokens).collect()}
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(b)) for i, b in sorted(lengths.items())], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = common.share(spark, Codebook(lengths))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, size, book = TaskContext.get().partitionId(), 0, 0, 0, shared()
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            starts = np.cumsum([0, *(8 * len(r[1]) for r in rows)])
            marks = np.concatenate([r[3] + a for r, a in zip(rows, starts)])
            made = [part], [block], [before], [[r[0] for r in rows]], [[r[2] for r in rows]], [b"".join(r[1] for r in rows)], [marks]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds)], ["part", "block", "before", "doc_ids", "lengths", "payload", "checkpoints"])

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), cells(some, 1, kind)):
                    bits, marks = book.encode(ids)
                    rows.append((doc_id, bits, len(ids), marks))
                    size += len(ids)
                    if size >= BLOCK_TOKENS:
                        yield flush()
                        block, before, size, rows = block + 1, before + size, 0, []
        if rows:
            yield flush()

    n = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("doc_id").asc_nulls_first()
    ordered = tokens.where("ids is not null").select("doc_id", "ids").repartitionByRange(n, first).sortWithinPartitions(first, "ids")
    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")
    scratch.drop(tokens)
    spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n_tokens")).coalesce(1).write.parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, cells binary: little-endian 32-bit ids) of the documents of a folder, decoded block by block.

    start: the ids of all documents before it.  The driver gets the code lengths and the totals of the parts (their
    number is set when writing).  A block is decoded where it is read: no shuffle.
    """
    lengths = {int(r.id): int(r.bits) for r in spark.read.parquet(f"{folder}/codebook").collect()}
    shared = common.share(spark, Codebook(lengths))
    before, total = {}, 0
    for part, n in sorted(tuple(r) for r in spark.read.parquet(f"{folder}/parts").select("part", "n_tokens").collect()):
        before[part] = total
        total += n
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("part", "before", "doc_ids", "lengths", "payload", "checkpoints")
    starts = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared()
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(k)[row].as_py() for k, c in enumerate(("part", "before", "doc_ids", "lengths", "payload", "checkpoints"))}
                sizes = np.array(x["lengths"], np.int64)
                ids = book.decode(x["payload"], np.array(x["checkpoints"], np.int64), sizes)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["doc_ids"], pa.int64()), pa.array(starts.value[x["part"]] + x["before"] + ends - sizes), pa.array(sizes), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - sizes, ends)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "cells"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, cells binary")


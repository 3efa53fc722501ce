"""Best-fit packing of tokenised documents by linear grouping.

Documents become pieces of at most ``capacity`` tokens.  What packing depends on is how many
pieces there are of each length, at most ``capacity`` numbers whatever the size of the corpus,
so the plan is made from that histogram and the pieces themselves never leave the executors:

* *linear grouping*: pieces longer than a share of the capacity are sorted by length and cut
  into groups of equal cardinality, and each is rounded up to the longest of its group;
* *few sizes*: how many sequences to fill with which combination of groups is a linear program
  with a row per group, solved by column generation (a knapsack finds the combination that
  saves most); its solution is rounded down;
* *substitution*: combinations are filled with the actual lengths of their groups;
* *best fit*: what rounding left over, then the small pieces, longest first, go to the sequence
  with the least room that suffices, whole classes of sequences with the same room at once.

Each step speaks of runs: so many pieces of one length, counted from some rank, go to so many
neighbouring sequences at some offset.  A piece finds its place by its length and its rank
among the pieces of that length, which Spark counts in slices.
"""

from __future__ import annotations

import math
import os
import re
import string
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from sealtrail.llm.batches import stored_in_batches

CAPACITY = 4_096
#: Closes each document.
END = 1
#: (share, groups): pieces of over 1 / share of the capacity are grouped into so many groups.  Tried in
#: turn until a plan needs no more sequences than the tokens do; else the best is taken.
SCHEMES = ((4, 16), (6, 36), (4, 64), (6, 64), (4, 144))
#: Distinct words that a worker remembers, words encoded and bytes of text cut at a time.
REMEMBERED = 1_500_000
NEW_WORDS = 20_000
CHUNK = 8_000_000

_BLANK = re.compile(rb"[\t-\r ]")


_LETTERS, _STOPS = string.ascii_letters, ".,;:!?"


class Encoder:
    """Token ids of texts, word by word; the model must drop blanks and have no token or rule across them.

    Words and their ids are kept in flat arrays, so that only new words are Python objects; when
    there are too many, those that came up most often stay.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(model)
        if t.encode(" ab\nc ", add_special_tokens=False).ids != [i for e in self._encoded(["ab", "c"]) for i in e]:
            raise ValueError(f"{model}: encodes words differently beside blanks")
        # whether plain English words may skip the steps before the model, which would only lower their case
        self.plain = (
            t.normalizer is not None and t.normalizer.normalize_str(_LETTERS) == _LETTERS.lower() and t.pre_tokenizer is not None
            and [p for p, _ in t.pre_tokenizer.pre_tokenize_str(_LETTERS + _STOPS)] == [_LETTERS, _STOPS]
        )
        self.words = pa.array([], pa.binary())
        self.ids, self.ends, self.seen = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _few(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [None] * len(words)
        tokenize, rest = self.tokenizer.model.tokenize, []
        for i, word in enumerate(words):
            core = word.rstrip(_STOPS)
            if self.plain and core.isascii() and core.isalpha():
                out[i] = [t.id for t in tokenize(core.lower())]
                if len(core) < len(word):
                    out[i] += [t.id for t in tokenize(word[len(core) :])]
            else:
                rest.append(i)
        for i, ids in zip(rest, self._encoded([words[i] for i in rest])):
            out[i] = ids
        return out

    def _learn(self, new: pa.Array) -> None:
        words = new.cast(pa.string()).to_pylist()
        ids, widths = [self.ids], []
        for k in range(0, len(words), NEW_WORDS):
            found = self._few(words[k : k + NEW_WORDS])
            widths += map(len, found)
            ids.append(np.fromiter(chain.from_iterable(found), np.int32))
        self.words = pa.concat_arrays([self.words, new])
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(widths, dtype=np.int64)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), dtype=np.int32)])

    def _forget(self) -> None:
        """Keep the words seen most often, half of ``REMEMBERED`` at most, and none seen once."""
        least = max(2, int(np.partition(self.seen, -REMEMBERED // 2)[-REMEMBERED // 2]) + 1)
        kept = np.flatnonzero(self.seen >= least)
        self.ids, self.ends = self._gathered(kept)
        self.words, self.seen = self.words.take(pa.array(kept)), self.seen[kept] // 2

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those kept; unknown ones are learned."""
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            new = words.filter(pc.is_null(found))
            first = len(self.words)
            self._learn(new)
            out = found.to_numpy(zero_copy_only=False)
            unknown = np.isnan(out)
            out[unknown] = np.arange(first, first + len(new))
            return out.astype(np.int64)
        return found.to_numpy().astype(np.int64)

    def _gathered(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and where each word's end, from 0 on."""
        first = self.ends[number]
        width = self.ends[number + 1] - first
        ends = np.concatenate([[0], np.cumsum(width)])
        return self.ids[np.repeat(first - ends[:-1], width) + np.arange(ends[-1])], ends

    def few(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) one after the other, and the number of each text's ids."""
        if len(self.words) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self._forget()
        split = pc.ascii_split_whitespace(texts)  # blanks at the ends give empty words, which have no ids
        coded = split.flatten().cast(pa.binary()).dictionary_encode()
        number = self._numbers(coded.dictionary)
        self.seen[number] += 1
        ids, ends = self._gathered(number[coded.indices.to_numpy()])
        word_ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])
        return ids, np.diff(ends[word_ends])

    def one(self, text: bytes) -> np.ndarray:
        """Ids of a long text, ``CHUNK`` bytes or a word at a time."""
        parts, start = [], 0
        while start < len(text):
            blank = _BLANK.search(text, start + CHUNK)
            end = blank.start() if blank else len(text)
            parts.append(self.few(pa.array([text[start:end].decode()]))[0])
            start = end
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, ids, numbers of ids) for ranges of ``texts`` of about ``CHUNK`` bytes; null is empty."""
        texts = pc.fill_null(texts, "")
        total = np.cumsum(pc.binary_length(texts).to_numpy())
        start = 0
        while start < len(texts):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + CHUNK, side="right")))
            own = texts.slice(start, end - start)
            if total[end - 1] - before <= CHUNK:
                ids, counts = self.few(own)
            else:
                ids = self.one(own[0].as_py().encode())
                counts = np.array([len(ids)])
            yield start, end, ids, counts
            start = end


@lru_cache(maxsize=1)
def _encoder(model: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(model)


def _cut(ids: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's ids closed by ``END`` and cut: text, start and length of each piece, all ids."""
    closed = np.insert(ids, np.cumsum(counts), END)
    pieces = -(-(counts + 1) // capacity)
    text = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    return text, start, np.minimum(counts[text] + 1 - start, capacity), closed


def _crc32(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """CRC-32 of runs of ids as little-endian unsigned 32-bit numbers."""
    raw = memoryview(ids.astype("<u4")).cast("B")
    places = (4 * ends).tolist()
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(places[:-1], places[1:])], pa.int64())


def token_pieces(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """(``key``, piece, start, length, ids_crc32, ids): the ids of each document in pieces of ``capacity``.

    Ids are those of the ``tokenizers`` file ``model`` for the whole text, then ``END``; a null or
    empty text has ``END`` alone.  Pieces count from 0, only the last may be shorter, ``start`` is
    the number of ids before it; ``ids_crc32`` tells ids apart where they are left out (``with_ids``
    false).  Keys are not looked at: null and repeated ones stay.  Other columns are left out; an
    empty table has no pieces.
    """
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in batches:
            for first, last, ids, counts in encoder.batches(batch.column(1)):
                which, start, length, closed = _cut(ids, counts, capacity)
                ends = np.concatenate([[0], np.cumsum(length)])
                columns = {
                    "key": batch.column(0).slice(first, last - first).take(pa.array(which)),
                    "piece": pa.array((start // capacity).astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": _crc32(closed, ends),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(closed.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    columns = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return columns.mapInArrow(encode, schema).withColumnRenamed("key", key)


# -- the plan -------------------------------------------------------------------------------

def _best_combination(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of ``sizes`` within ``capacity`` that is worth most (at most capacity / least size items)."""
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        options = np.full((len(sizes), capacity + 1), -np.inf)
        for i, size in enumerate(sizes):
            options[i, size:] = worth[i] + best[: capacity + 1 - size]
        pick = options.argmax(axis=0)
        gain = options[pick, np.arange(capacity + 1)]
        pick[gain <= best] = -1
        chosen.append(pick)
        best = np.maximum(best, gain)
    counts, room = np.zeros(len(sizes)), capacity
    for pick in reversed(chosen):
        if pick[room] >= 0:
            counts[pick[room]] += 1
            room -= sizes[pick[room]]
    return best[capacity], counts


def combinations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Combinations of few ``sizes`` and how often to use each, for at most ``demand`` of each size.

    The optimal basis of the linear program over all combinations, found by column generation,
    rounded down: less than one use per size short of the (fractional) optimum.
    """
    columns = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    uses = need / columns.diagonal()
    for _ in range(200 * len(sizes)):
        worth = np.linalg.solve(columns.T, np.ones(len(sizes)))
        value, column = _best_combination(sizes, worth, capacity)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(columns, column)
        ratio = np.divide(uses, direction, out=np.full(len(sizes), np.inf), where=direction > 1e-9)
        columns[:, int(ratio.argmin())] = column
        uses = np.maximum(np.linalg.solve(columns, need), 0.0)
    out, left = [], np.array(demand, dtype=np.int64)
    for i, use in enumerate(uses):
        column = columns[:, i].astype(np.int64)
        times = min([math.floor(use + 1e-6), *(left[column > 0] // column[column > 0]).tolist()])
        if times > 0:
            left -= times * column
            out.append((column, int(times)))
    return out


@dataclass
class Plan:
    """Runs: pieces of ``length`` with ranks from ``rank`` on, ``each`` a sequence, from ``first`` on at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        run = np.searchsorted(self.length * _RANKS + self.rank, length * _RANKS + rank, side="right") - 1
        after = rank - self.rank[run]
        return self.first[run] + after // self.each[run], self.offset[run] + after % self.each[run] * length


#: Ranks are below this (lengths below 2^20).
_RANKS = np.int64(1 << 42)


class _Planner:
    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.rooms: dict[int, deque] = defaultdict(deque)  # room -> runs of sequences (first, how many)
        self.order: list[int] = []  # rooms with sequences

    def _put(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self.rooms[room]:
                insort(self.order, room)
            self.rooms[room].append((first, count))

    def _new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def fill(self, groups: list[list], uses: list[tuple[np.ndarray, int]]) -> None:
        """Use each combination with the next pieces of its groups, runs [length, rank, count]."""
        for column, times in uses:
            slots = [g for g, n in enumerate(column.tolist()) for _ in range(n)]
            taken = [self._take(groups[g], times) for g in slots]
            ends = sorted({e for runs in taken for e in np.cumsum([n for _, _, n in runs]).tolist()})
            first, done = self._new(times), 0
            for end in ends:
                room = self.capacity
                for runs in taken:
                    length, rank, count = runs[0]
                    self.runs.append((length, rank, 1, first + done, self.capacity - room))
                    room -= length
                    runs[0] = (length, rank + end - done, count - (end - done))
                    if not runs[0][2]:
                        runs.pop(0)
                self._put(room, first + done, end - done)
                done = end

    @staticmethod
    def _take(group: list, count: int) -> list[tuple[int, int, int]]:
        out = []
        while count:
            length, rank, n = group[0]
            m = min(n, count)
            out.append((length, rank, m))
            count -= m
            group[0] = [length, rank + m, n - m]
            if m == n:
                group.pop(0)
        return out

    def fit(self, length: int, rank: int, count: int) -> None:
        """Best fit of ``count`` pieces; the tightest sequences take as many as they hold."""
        while count:
            at = bisect_left(self.order, length)
            if at == len(self.order):
                room, each = self.capacity, self.capacity // length
                first, there = self._new(-(-count // each)), -(-count // each)
            else:
                room = self.order[at]
                each = room // length
                first, there = self.rooms[room].popleft()
                if not self.rooms[room]:
                    self.order.pop(at)
            full = min(there, count // each)
            if full:
                self.runs.append((length, rank, each, first, self.capacity - room))
                self._put(room - each * length, first, full)
                rank, count, first, there = rank + full * each, count - full * each, first + full, there - full
            if there and count < each and count:
                self.runs.append((length, rank, count, first, self.capacity - room))
                self._put(room - count * length, first, 1)
                rank, count, first, there = rank, 0, first + 1, there - 1
            if there:
                self.rooms[room].appendleft((first, there))
                if len(self.rooms[room]) == 1:
                    insort(self.order, room)

    def plan(self) -> Plan:
        table = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5).T
        return Plan(*table, self.sequences)


def _grouped(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[list]]:
    """Groups of equal cardinality, longest first: the length each is rounded up to, and its runs.

    So few lengths that each can be a group need no rounding.
    """
    if len(large) <= groups:
        return [length for length, _ in large], [[[length, 0, n]] for length, n in large]
    size = -(-sum(n for _, n in large) // groups)
    sizes, runs, room = [], [], 0
    for length, count in large:
        rank = 0
        while count:
            if not room:
                if sizes and sizes[-1] == length:  # groups of one size are one
                    room = size
                else:
                    sizes.append(length)
                    runs.append([])
                    room = size
            m = min(room, count)
            runs[-1].append([length, rank, m])
            rank, count, room = rank + m, count - m, room - m
    return sizes, runs


def _planned(lengths: dict[int, int], capacity: int, share: int, groups: int) -> _Planner:
    planner = _Planner(capacity)
    falling = sorted(lengths.items(), reverse=True)
    large = [(length, n) for length, n in falling if length * share > capacity]
    if large:
        sizes, grouped = _grouped(large, groups)
        planner.fill(grouped, combinations(sizes, [sum(n for _, _, n in runs) for runs in grouped], capacity))
        for runs in grouped:
            for length, rank, count in runs:
                planner.fit(length, rank, count)
    for length, count in falling:
        if length * share <= capacity:
            planner.fit(length, 0, count)
    return planner


def make_plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where the pieces go, from the number of pieces of each length (1 to ``capacity``)."""
    least = -(-sum(length * n for length, n in lengths.items()) // capacity)
    best = None
    for scheme in SCHEMES:
        planner = _planned(lengths, capacity, *scheme)
        if best is None or planner.sequences < best.sequences:
            best = planner
        if best.sequences == least:
            break
    return best.plan()


# -- places ---------------------------------------------------------------------------------

def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (longs): few sequences of ``capacity``, without gaps.

    All rows are packed, repeated ones too.  A length that is null or not in 1 to ``capacity``
    has no place (both null).  Columns named like the two new ones are replaced, all others
    stay.  An empty table gives none.
    """
    spark = pieces.sparkSession
    kept = pieces.drop("sequence_id", "offset")
    # numbered in the write, so that a row keeps its number
    told = kept.select(F.struct("*").alias("piece"), F.col(f"`{length}`").cast("long").alias("length"))
    rows = stored_in_batches(told.withColumn("row", F.monotonically_increasing_id()), "pieces")
    fits = F.col("length").between(1, capacity)
    counted = rows.where(fits).groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    plan = make_plan({r["length"]: r["n"] for r in counted}, capacity) if counted else None
    if plan is None:
        return rows.select("piece.*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    slices = spark.createDataFrame([(r["length"], math.isqrt(r["n"]) + 1) for r in counted], "length long, slices long")
    dealt = rows.join(F.broadcast(slices), "length", "left").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")))
    sizes = dealt.where(fits).groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("length", "slice", F.coalesce(before, F.lit(0)).alias("start_rank"))
    own = F.row_number().over(W.partitionBy("length", "slice").orderBy("row")) - 1
    ranked = dealt.where(fits).withColumn("own", own).join(starts, ["length", "slice"])
    shipped = spark.sparkContext.broadcast(plan)

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = shipped.value.place(length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    placed = ranked.withColumn("place", place("length", F.col("own") + F.col("start_rank"))).select("piece.*", "place.*")
    nowhere = rows.where(~F.coalesce(fits, F.lit(False))).select(
        "piece.*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")
    )
    return placed.unionByName(nowhere)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, n_pieces, ids): the packed token sequences (``capacity`` tokens each at most)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(f"`{ids}`").alias("ids"))))
    joined = packed.where("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select("sequence_id", F.size("parts").alias("n_pieces"), F.flatten("parts.ids").alias("ids"))


def packed_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``."""
    return pack(token_pieces(docs, model, with_ids=False))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

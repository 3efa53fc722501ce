"""SentencePiece encoding by sampling over the piece lattice, and lossless decoding.

The vocabulary of a given model spans a lattice over a text: an edge for every piece found
at every place, and single bytes for characters without a piece.  A segmentation is drawn
with probability proportional to the product of its edges' weights ``exp(alpha * score)``:
forward filtering sums the weights of all ways to each place, backward sampling walks from
the end and chooses each edge by its share of that sum.  The random numbers are a hash of
the row's key, the place of the word and the step, so a row is always cut the same way,
whatever the partition or attempt.

No piece reaches over the start of a word (a run of blanks belongs to the word behind it), so
the sums of a word do not depend on the rest.  They are computed once per distinct word and
worker; a batch of rows is then sampled word by word in parallel with vector operations.

The models here score byte-pair pieces by merge rank rather than probability; the rank gives
a Zipf-like log probability.  Unigram models' scores are used as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame, functions as F

from sealtrail.llm.batches import at_most, give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Sharpness of the sampling: 0 draws all segmentations alike, larger values the likely ones.
ALPHA = 1.0
SEED = 0
#: Words longer than this are cut between characters, which bounds what one lattice needs.
LONGEST_WORD = 2_000
#: Words up to this length are filtered side by side (the sums of longer ones need care).
ABREAST = 48
#: Lattice nodes (letters of distinct words) that a worker remembers.
REMEMBERED = 500_000
#: Words filtered and characters sampled at once.
ABREAST_WORDS = 10_000
CHUNK = 400_000

BATCH_ROWS = 1_000

_WORD = re.compile(" *[^ ]+| +")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_UNITS = 2.0**24
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


@dataclass
class Vocabulary:
    """Pieces with a blank for the model's blank sign; ``None`` marks mere beginnings of pieces."""

    pieces: dict[str, tuple[int, float] | None]
    byte_ids: list[int]
    byte_weight: float
    decoded: list[bytes]

    def __post_init__(self):
        """The pieces' trie as arrays: sorted (node, letter) keys, targets, ids and weights."""
        nodes = {text: n for n, text in enumerate(self.pieces, 1)} | {"": 0}
        moves = sorted((nodes[text[:-1]] << 21 | ord(text[-1]), n) for text, n in nodes.items() if text)
        self.moves = np.array([k for k, _ in moves], dtype=np.int64)
        self.targets = np.array([n for _, n in moves], dtype=np.int64)
        self.id_of = np.array([-1] + [p[0] if p else -1 for p in self.pieces.values()], dtype=np.int64)
        self.weight_of = np.array([0.0] + [p[1] if p else 0.0 for p in self.pieces.values()])
        first = [text for text in self.pieces if len(text) == 1]
        self.roots = np.zeros(max(map(ord, first)) + 1, dtype=np.int64)  # nodes of single letters, 0 for none
        self.roots[[ord(text) for text in first]] = [nodes[text] for text in first]
        self.longest = max(map(len, self.pieces))
        self.spellings = pa.array(self.decoded, pa.binary())

    @staticmethod
    def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        decoded = [model.id_to_piece(i).replace("\u2581", " ").encode() for i in ids]
        by_byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(by_byte) != 256:
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        for value, i in by_byte.items():
            decoded[i] = bytes([value])
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        usable = [i for i in ids if not any(is_(i) for is_ in special) and " " not in decoded[i].decode().lstrip(" ")]
        scores = {i: model.get_score(i) for i in usable}
        if all(s <= 0 and s == int(s) for s in scores.values()):  # merge ranks
            scores = {i: -math.log(2.0 - s) for i, s in scores.items()}
        pieces: dict[str, tuple[int, float] | None] = {}
        for i in usable:
            text = decoded[i].decode()
            pieces[text] = (i, math.exp(alpha * scores[i]))
            for k in range(1, len(text)):
                pieces.setdefault(text[:k], None)
        least = math.exp(alpha * (min(scores.values()) - 1.0))
        return Vocabulary(pieces, [by_byte[b] for b in range(256)], least, decoded)


class Words(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Lattice:
    """The lattices of all words seen, end to end.

    Node ``first + n`` stands behind a word's n-th letter.  The edges that enter a node have
    the keys ``node + cumulated share``, so all edges lie in one sorted array and a random
    number is turned into an edge by one binary search.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.size = 0
        self.ends, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by the word's number
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.keys, self.piece, self.back = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; words not seen before are filtered."""
        seen = len(self.words)
        out = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(islice(self.words, seen, None))
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        ends = np.zeros(len(new), dtype=np.int64)
        short = np.flatnonzero(lengths <= ABREAST)
        for k in range(0, len(short), ABREAST_WORDS):
            some = short[k : k + ABREAST_WORDS]
            ends[some] = self.add_many([new[i] for i in some.tolist()])
        for i in np.flatnonzero(lengths > ABREAST).tolist():
            ends[i] = self.add(new[i])
        self.ends, self.lengths = np.concatenate([self.ends, ends]), np.concatenate([self.lengths, lengths])
        self.settle()
        return out

    def add(self, word: str) -> int:
        """Forward filtering of one word; its last node."""
        pieces, byte_weight = self.vocabulary.pieces, self.vocabulary.byte_weight
        keys, piece, back = [], [], []
        first, size = self.size, len(word)
        into: list[list] = [[] for _ in range(size + 1)]  # (weight of all ways over the edge, piece, from)
        ways = 1.0
        for i in range(size):
            if i:
                run, total, node = 0, sum(e[0] for e in into[i]), first + i
                for w, p, b in into[i]:
                    run += int(w / total * _UNITS)
                    keys.append(node + run / _UNITS)
                    piece.append(p)
                    back.append(first + b)
                keys[-1] = node + 1.0
                ways = total
                if ways < 1e-200:  # sums shrink with every letter: lift those still in use
                    ways *= 1e200
                    for later in into[i + 1 : i + 64]:
                        later[:] = [(w * 1e200, p, b) for w, p, b in later]
            alone = False
            for j in range(i + 1, size + 1):
                found = pieces.get(word[i:j], False)
                if found is False:
                    break
                if found is not None:
                    into[j].append((ways * found[1], found[0], i))
                    alone = alone or j == i + 1
            if not alone:  # the character's bytes, as one edge
                into[i + 1].append((ways * byte_weight, -1 - ord(word[i]), i))
        run, total, node = 0, sum(e[0] for e in into[size]), first + size
        for w, p, b in into[size]:
            run += int(w / total * _UNITS)
            keys.append(node + run / _UNITS)
            piece.append(p)
            back.append(first + b)
        keys[-1] = node + 1.0
        self.blocks.append((np.array(keys), np.array(piece, np.int32), np.array(back, np.int32)))
        self.size += size + 1
        return node

    def add_many(self, words: list[str]) -> np.ndarray:
        """Forward filtering of many words of up to ``ABREAST`` letters, side by side; their last nodes."""
        v = self.vocabulary
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        size = len(letters)
        column = np.arange(size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = np.repeat(lengths, lengths) - column  # letters from here to the word's end
        # a place has one column per length of a piece that ends there, the longest first
        entering = np.zeros((size, v.longest), dtype=np.int32)
        at = np.where(letters < len(v.roots), v.roots[np.minimum(letters, len(v.roots) - 1)], 0)
        bare = v.id_of[at] < 0
        entering[:, -1] = np.where(bare, -1 - letters, at)
        place = np.flatnonzero(at)
        at = at[place]
        for longer in range(1, v.longest):
            some = left[place] > longer
            place, at = place[some], at[some]
            wanted = at << 21 | letters[place + longer]
            move = np.minimum(np.searchsorted(v.moves, wanted), len(v.moves) - 1)
            going = v.moves[move] == wanted
            place, at = place[going], v.targets[move[going]]
            if not len(place):
                break
            is_piece = v.id_of[at] >= 0
            entering[place[is_piece] + longer, v.longest - 1 - longer] = at[is_piece]
        edge = np.flatnonzero(entering)  # by place, from the longest piece to the shortest
        to, back = np.divmod(edge, v.longest)
        begin = to - (v.longest - 1 - back)
        node = entering.ravel()[edge].astype(np.int64)
        weight = np.where(node > 0, v.weight_of[np.maximum(node, 0)], v.byte_weight)
        piece = np.where(node > 0, v.id_of[np.maximum(node, 0)], node)

        ways = np.zeros(size)  # weight of all ways to behind each place
        whence = column[begin].astype(np.uint8)
        order = np.argsort(whence, kind="stable")
        ends = np.cumsum(np.bincount(whence, minlength=1))
        for i, (low, high) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
            some = order[low:high]  # each place once
            if i:
                weight[some] *= ways[begin[some] - 1]
            ways[to[some]] += weight[some]
        # whole units of 2^-24, so that a word's shares do not depend on its place in the array
        share = np.cumsum((weight / ways[to] * _UNITS).astype(np.int64))
        last = np.append(to[1:] != to[:-1], True)
        before = np.concatenate([[0], share[last]])[to]
        nodes = self.size + np.arange(size) + np.repeat(np.arange(len(words)), lengths)  # before each letter
        keys = nodes[to] + 1 + (share - before) / _UNITS
        keys[last] = nodes + 2.0
        self.blocks.append((keys, piece.astype(np.int32), nodes[begin].astype(np.int32)))
        self.size += size + len(words)
        return nodes[np.cumsum(lengths) - 1] + 1

    def settle(self) -> None:
        """Make the words added since the last call searchable."""
        if not self.blocks:
            return
        keys, piece, back = zip((self.keys, self.piece, self.back), *self.blocks)
        self.keys, self.piece, self.back = np.concatenate(keys), np.concatenate(piece), np.concatenate(back)
        self.blocks = []


class Sampler:
    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        self.vocabulary, self.seed, self.lattice = vocabulary, seed, Lattice(vocabulary)

    def _key(self, key) -> int:
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{key}".encode(), digest_size=8).digest(), "little")

    def batch(self, keys: list, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of a sampled segmentation of each text; none for null, empty for empty texts."""
        ids, ends = self.flat(keys, texts)
        return [None if t is None else p for t, p in zip(texts, np.split(ids, ends[:-1]))]

    def flat(self, keys: list, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        parts, ends = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        start, size, so_far = 0, 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= CHUNK or i == len(texts) - 1:
                ids, row_ends = self._chunk(keys[start : i + 1], texts[start : i + 1])
                parts.append(ids)
                ends.append(row_ends + so_far)
                start, size, so_far = i + 1, 0, so_far + len(ids)
        return np.concatenate(parts), np.concatenate(ends)

    def _chunk(self, keys: list, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lattice = self.lattice
        if lattice.size > REMEMBERED:
            lattice.clear()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                own = _WORD.findall(" " + text)
                if len(text) > LONGEST_WORD:
                    own = [w[k : k + LONGEST_WORD] for w in own for k in range(0, len(w), LONGEST_WORD)]
                counts[i] = len(own)
                words += own
        number = lattice.numbers(words)
        node, lengths = lattice.ends[number], lattice.lengths[number]
        first = node - lengths

        # backward sampling, all words at once; the random numbers depend on row key, word and step
        place = np.arange(len(words), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
        row_key = np.repeat(np.array([self._key(k) for k in keys], dtype=np.uint64), counts)
        with np.errstate(over="ignore"):
            base = _mixed(row_key + (place.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        # neighbours in the lattice together, some words at a time: their searches and steps stay in cache
        order, steps = np.argsort(node), []
        n_pieces = np.zeros(len(words), dtype=np.int64)
        for start in range(0, len(order), ABREAST_WORDS):
            active, step = order[start : start + ABREAST_WORDS], 0
            at, until, key = node[active], first[active], base[active]
            while len(active):
                with np.errstate(over="ignore"):
                    u = _mixed(key + np.uint64(step) * _MIX1) >> np.uint64(40)
                edge = np.searchsorted(lattice.keys, at + u.astype(np.float64) / _UNITS, side="right")
                steps.append((active, lattice.piece[edge], step))
                at = lattice.back[edge].astype(np.int64)
                step += 1
                going = np.flatnonzero(at > until)
                n_pieces[active] = step
                active, at, until, key = active[going], at[going], until[going], key[going]
        ends = np.cumsum(n_pieces)
        ids = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
        for which, piece, step in steps:
            ids[ends[which] - 1 - step] = piece
        row_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        return self._with_bytes(ids, row_ends)

    def _with_bytes(self, ids: np.ndarray, row_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces characters without a piece (negative) by the ids of their bytes; all rows of a chunk at once."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, row_ends
        chars, which = np.unique(-1 - ids[odd], return_inverse=True)
        as_bytes = [[self.vocabulary.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars]
        widths = np.ones(len(ids), dtype=np.int64)
        widths[odd] = np.array([len(b) for b in as_bytes])[which]
        out, ends = np.repeat(ids, widths), np.cumsum(widths)
        for k in range(4):
            some = np.array([len(b) > k for b in as_bytes])[which]
            values = np.array([b[k] if len(b) > k else 0 for b in as_bytes])[which]
            out[(ends - widths)[odd[some]] + k] = values[some]
        return out, np.concatenate([[0], ends])[row_ends]


@lru_cache(maxsize=2)
def _with_model(path: str, alpha: float) -> Vocabulary:
    """Loads the model where it is used, so that only its path travels; once per worker and model."""
    return Vocabulary.load(path, alpha)


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "pieces",
    model: str = MODEL, alpha: float = ALPHA, seed: int = SEED,
) -> DataFrame:
    """``docs`` with an ``array<int>`` column ``out`` of sampled piece ids.

    The same key and text give the same ids on every run (a null key counts as a key of its
    own; rows that share a key share random numbers).  A null text gives null, an empty one
    an empty array.  A column named ``out`` is replaced, all others stay.  Ids take a
    multiple of the text's memory, so Arrow batches of the session are kept to
    ``BATCH_ROWS`` rows and a few megabytes.
    """
    at_most(docs.sparkSession, BATCH_ROWS)

    @F.arrow_udf("array<int>")
    def sampled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sampler = Sampler(_with_model(model, alpha), seed)
        for keys, texts in batches:
            ids, ends = sampler.flat(keys.to_pylist(), texts.to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=texts.is_null())
        sampler = keys = texts = ids = ends = offsets = None
        give_back()

    return docs.withColumn(out, sampled(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")))


def decode(rows: DataFrame, pieces: str = "pieces", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that ``pieces`` spell; null for null.  Undoes :func:`encode` exactly."""

    @F.arrow_udf("string")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts = _with_model(model, ALPHA).spellings
        for ids in batches:
            # the pieces' bytes follow each other, so a row's text lies between its first and last piece
            letters = parts.take(ids.flatten())
            ends = np.frombuffer(letters.buffers()[1], dtype=np.int32, count=len(letters) + 1)
            rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            text = pa.StringArray.from_buffers(len(ids), pa.py_buffer(ends[rows]), letters.buffers()[2])
            yield pc.if_else(ids.is_null(), None, pc.utf8_slice_codeunits(text, 1))
        ids = letters = ends = rows = text = None
        give_back()

    return rows.withColumn(out, spelled(F.col(f"`{pieces}`")))


def encoded_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, lossless): encoded, decoded and compared, row by row."""
    cut = decode(encode(docs.select("doc_id", "text")))
    return cut.select(
        "doc_id",
        F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.coalesce("pieces", F.expr("cast(array() as array<int>)")).cast("array<string>"), " "), 256)
        .alias("pieces_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return encoded_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Packing documents into sequences by cutting-stock column generation.

Every document is cut into full sequences and one remainder.  The histogram of
the remainders' lengths (in units of ``grain`` tokens, so of bounded size) is the
demand of a cutting-stock problem: a linear program over patterns, i.e. multisets
of lengths that fit a sequence, whose columns an unbounded-knapsack dynamic
program prices.  Patterns are used as often as their value rounded down; what is
left is filled pattern by pattern by subset sums.  Documents are ranked within
their length, and ranges of ranks are assigned to the patterns' slots.
"""

from __future__ import annotations

import re
import warnings
import zlib
from array import array
from itertools import accumulate, chain, compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, map_slices, materialise, row_key, texts_as_bytes

SEQUENCE = 2048
GRAIN = 8
END = 1
CACHE = 2_000_000
#: ASCII marks that part from the word before them.
_MARKS = b",.!?;:#%$&*"
#: Rows of one rank group, and pricing rounds of the linear program.
GROUP_ROWS = 20_000
ROUNDS = 4_000


#: The shape of vocabularies whose words can be encoded one by one (lower case, white space dropped, words ended by a mark).
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORD_END = "</w>"
#: Lower-case words of ASCII and Latin-1 letters: one word to the vocabulary's pattern, and unchanged by its normalizers.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Words of one joined text.
JOINED = 500


def by_words(spec: dict) -> bool:
    """Whether a vocabulary file never joins across white space, ignores case and ends each word with a mark."""
    try:
        split, normal = spec["pre_tokenizer"]["pretokenizers"][0], [n["type"] for n in spec["normalizer"]["normalizers"]]
        model = spec["model"]
        return split["pattern"] == {"Regex": _WORD_PATTERN} and normal == _NORMALIZERS and model["end_of_word_suffix"] == _WORD_END and not model.get("ignore_merges")
    except (KeyError, TypeError, IndexError):
        return False


class WordCoder:
    """Ids by the tokenizers library.

    Where the vocabulary allows it, texts are cut at white space and each chunk's
    ids are kept.  New plain words are encoded many to a text: as each ends with a
    token of its own kind, the ids part again, which their lengths confirm.
    Other vocabularies get whole texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.cache = cache
        # chunks met lately, and those met before them
        self.chunks: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = by_words(spec)
        if self.cut:
            vocab = spec["model"]["vocab"]
            self.size = np.zeros(max(vocab.values()) + 1, np.int64)
            self.ends = np.zeros(len(self.size), bool)
            for token, i in vocab.items():
                self.ends[i] = token.endswith(_WORD_END)
                self.size[i] = len(token.removesuffix(_WORD_END))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of plain words, encoded as one text."""
        raw = self._ids([b" ".join(words).decode()])[0]
        ids = np.frombuffer(raw, np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        size = np.add.reduceat(self.size[ids], np.concatenate([[0], stop[:-1]])) if len(stop) else stop
        if len(stop) != len(words) or size.tolist() != list(map(len, words)):
            return self._ids([w.decode() for w in words])
        cuts = (4 * stop).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn(self, fresh: list[bytes]) -> None:
        """Ids of new chunks: plain words part from the marks after them, all else is encoded as it stands."""
        chunks = self.chunks
        heads = [c.rstrip(_MARKS) for c in fresh]
        is_plain = [m is not None for m in map(_PLAIN.fullmatch, heads)]
        lacking = [h for h in set(compress(heads, is_plain)) if h not in chunks]
        for k in range(0, len(lacking), JOINED):
            chunks.update(zip(part := lacking[k : k + JOINED], self._plain(part), strict=True))
        marked = [(c, h, c[len(h) :]) for c, h, good in zip(fresh, heads, is_plain, strict=True) if good and len(c) != len(h)]
        odd = [c for c, good in zip(fresh, is_plain, strict=True) if not good]
        odd += [t for t in {t for _, _, t in marked} if t not in chunks]
        for k in range(0, len(odd), 20_000):
            chunks.update(zip(part := odd[k : k + 20_000], self._ids([c.decode() for c in part]), strict=True))
        for c, head, tail in marked:
            chunks[c] = chunks[head] + chunks[tail]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.cut:
            return self._ids([t.decode() for t in texts])
        if len(self.chunks) > self.cache // 2:
            self.older, self.chunks = self.chunks, {}
        # ASCII letters count in lower case; only special tokens, which hold a bar after a bracket, are told by case
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = list(chain.from_iterable(split))
        found = list(map(self.chunks.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        unknown = {words[k] for k in new}
        again = unknown & self.older.keys()
        self.chunks.update((c, self.older[c]) for c in again)
        self._learn(list(unknown - again))
        for k in new:
            found[k] = self.chunks[words[k]]
        cuts = [0, *accumulate(map(len, split))]
        return [b"".join(found[a:b]) for a, b in pairwise(cuts)]


def word_coder(path: str, cache: int = CACHE) -> WordCoder:
    return held(f"words {path} {cache}", lambda: WordCoder(path, cache))


def tokenised(docs: DataFrame, path: str, sequence: int = SEQUENCE, cache: int = CACHE) -> DataFrame:
    """Per row: its key, tokens with the end id, and a checksum of each piece (full sequences, then the remainder).

    A worker keeps about ``cache`` encoded chunks; fewer take less memory and more time, and change no id.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([END], "<u4").tobytes()
        ids = [x + end for x in word_coder(path, cache).encode(texts_as_bytes(batch.column("text")))]
        crcs = [[zlib.crc32(memoryview(x)[k : k + 4 * sequence]) for k in range(0, len(x), 4 * sequence)] for x in ids]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_qn_k1"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "_qn_k1", "doc_tokens", "crcs"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", row_key()[1], "text")
    done = map_slices(rows, run, "doc_id long, _qn_k1 long, doc_tokens long, crcs array<long>", holds=f"words {path} {cache}")
    # rows that repeat part by where they stand, once the table is written
    return done.withColumn("_qn_n", F.monotonically_increasing_id())


# the cutting-stock problem
def price(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: values[k] is the value of one piece of k + 1 units."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = int(np.argmax(w := values[:c] + best[c - 1 :: -1][:c]))
        best[c], take[c] = max(w[k], best[c - 1]), k + 1 if w[k] > best[c - 1] else 0
    pattern, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def linear_patterns(demand: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Column generation by the revised simplex method: patterns of the last basis, and how often each is used."""
    capacity = len(demand)
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return np.zeros((0, capacity), np.int64), np.zeros(0)
    m = len(sizes)
    columns = np.zeros((m, capacity), np.int64)
    columns[np.arange(m), sizes] = capacity // (sizes + 1)
    inverse = np.diag(1.0 / columns[np.arange(m), sizes])
    x = inverse @ demand[sizes].astype(float)
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        values = np.full(capacity, -1.0)
        values[sizes] = duals
        gain, pattern = price(values, capacity)
        if gain <= 1 + 1e-7:
            return columns, x
        d = inverse @ pattern[sizes]
        ratio = np.full(m, np.inf)
        ratio[d > 1e-9] = x[d > 1e-9] / d[d > 1e-9]
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = np.maximum(x - step * d, 0)
        x[r] = step
        inverse[r] /= d[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(d[others], inverse[r])
        columns[r] = pattern
    warnings.warn(f"the linear program was not optimal after {rounds} rounds; packing goes on with its last patterns", stacklevel=2)
    return columns, x


def fill(rest: np.ndarray) -> np.ndarray:
    """One pattern from a non-empty rest: its largest piece, and the subset that fills the remaining space best."""
    capacity = len(rest)
    first = int(np.flatnonzero(rest)[-1])
    pattern = np.zeros(capacity, np.int64)
    pattern[first] = 1
    space = capacity - first - 1
    last = np.full(space + 1, -1)
    reach = np.zeros(space + 1, bool)
    reach[0] = True
    for k in np.flatnonzero(rest[: space if space else 0])[::-1].tolist():
        for _ in range(min(int(rest[k]) - (k == first), space // (k + 1))):
            new = np.zeros(space + 1, bool)
            new[k + 1 :] = reach[: space - k]
            new &= ~reach
            if not new.any():
                break
            last[new] = k
            reach |= new
        if reach[space]:
            break
    c = int(np.flatnonzero(reach)[-1])
    while c:
        pattern[last[c]] += 1
        c -= int(last[c]) + 1
    return pattern


def cutting_patterns(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole uses that take exactly the demand (pieces of k + 1 units at k)."""
    rest = demand.astype(np.int64).copy()
    out = []
    for pattern, x in zip(*linear_patterns(demand), strict=True):
        uses = int(x + 1e-7)
        for k in np.flatnonzero(pattern):
            uses = min(uses, int(rest[k] // pattern[k]))
        if uses:
            out.append((pattern, uses))
            rest -= uses * pattern
    while rest.any():
        pattern = np.minimum(fill(rest), rest)
        uses = int((rest[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, uses))
        rest -= uses * pattern
    return out


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, grain: int = GRAIN, cache: int = CACHE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone; a text of any length is cut into as
    many full sequences as it fills, and a remainder.  Rows that repeat, or whose
    doc_id is null, are packed as rows of their own; which of equal rows gets which
    place follows their order in the input.  An empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    capacity = sequence // grain
    rows = materialise(tokenised(docs, path, sequence, cache), "tokens")
    n_rows = rows.count()
    groups = max(64, n_rows // GROUP_ROWS)
    # rank groups: by what the table holds, so that a recomputed task deals the same rows
    rows = rows.select(
        "doc_id", "_qn_k1", "_qn_n", "doc_tokens", "crcs",
        F.pmod(F.xxhash64("doc_id", "_qn_k1", F.col("_qn_n") % 61), F.lit(groups)).cast("int").alias("_g"),
        F.floor(F.col("doc_tokens") / sequence).cast("long").alias("_full"),
        F.ceil((F.col("doc_tokens") % sequence) / grain).cast("int").alias("_u"),
    )
    counts = materialise(rows.groupBy("_u", "_g").agg(F.count("*").alias("n"), F.sum("_full").alias("full")), "lengths")
    # at most capacity + 1 lengths reach the driver
    histogram = {r["_u"]: (r["n"], r["full"]) for r in counts.groupBy("_u").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).collect()}
    demand = np.zeros(capacity, np.int64)
    for u, (n, _) in histogram.items():
        if u:
            demand[u - 1] = n
    segments, used, ranked = [], 0, np.zeros(capacity, np.int64)
    for pattern, uses in cutting_patterns(demand):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[k])
            segments.append((k + 1, int(ranked[k]), int(ranked[k] + each * uses), used, each, slot))
            ranked[k] += each * uses
            slot += each
        used += uses
    shape = "_u int, _from long, _to long, _seq long, _each long, _slot long"
    # bounded by the patterns: at most capacity basic ones, and those of a rest of at most their sizes
    segments_df = F.broadcast(spark.createDataFrame(segments or [(-1, 0, 0, 0, 1, 0)], shape))
    before = Window.partitionBy("_u").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_u", "_g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    # first number of the full sequences of each rank group
    by_group = counts.groupBy("_g").agg(F.sum("full").alias("full"))
    fulls = by_group.select("_g", (F.coalesce(F.sum("full").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + used).alias("_first"))
    order = ["doc_id", "_qn_k1", "_qn_n"]
    within = rows.select(
        "*",
        (F.row_number().over(Window.partitionBy("_g", "_u").orderBy(*order)) - 1).alias("_rank"),
        F.coalesce(F.sum("_full").over(Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_prior"),
    )
    placed = within.join(base, ["_u", "_g"]).join(fulls, "_g").withColumn("_rank", F.col("_rank") + F.col("_base"))
    full = placed.where("_full > 0").select("doc_id", "doc_tokens", "_first", "_prior", F.posexplode(F.slice("crcs", F.lit(1), F.col("_full").cast("int"))).alias("_i", "ids_crc32")).select(
        "doc_id", (F.col("_i").cast("long") * sequence).alias("start"), F.lit(sequence).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_prior") + F.col("_i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    rest = placed.where("_u > 0").join(segments_df, "_u").where("_rank >= _from and _rank < _to").select(
        "doc_id", (F.col("_full") * sequence).alias("start"), (F.col("doc_tokens") % sequence).alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
        (F.col("_seq") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_slot") + (F.col("_rank") - F.col("_from")) % F.col("_each")).alias("_at"),
    )
    ahead = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))
    return full.unionByName(rest)

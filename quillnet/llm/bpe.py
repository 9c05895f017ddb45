"""Byte-level BPE: speculate and verify.

For every word not met before, greedy longest-match over the vocabulary proposes
tokens (vectorised over all new words of a slice by hashes of all substrings).
A proposal equals the merge procedure's result if and only if every pair of
adjacent tokens is compatible, that is, merging the pair's bytes alone gives
just those two tokens.  Pairs are tested by lookup in a sorted table of verdicts;
pairs not yet in it are decided once by exact merging.  Only words with a failing
pair undergo exact merging as a whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_slices, texts_as_bytes

#: Fixed value: the split of byte-level BPE vocabularies.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A space before white space of any kind, or at the end: such texts are split as a whole.
_RUNS = re.compile(rb" (?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80|\Z)")
#: Entries of each of a worker's caches; the older half goes when the newer is full.
CACHE = 1_000_000
_LONG = 48
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


class Aging:
    """A table of entries met lately, and of those met before them."""

    def __init__(self) -> None:
        self.now: dict = {}
        self.before: dict = {}

    def lacking(self, keys: set) -> list:
        """Keys without an entry; the others are met now.  Called first, as it may let old entries go."""
        if len(self.now) > CACHE // 2:
            self.before, self.now = self.now, {}
        unknown = keys - self.now.keys()
        again = unknown & self.before.keys()
        self.now.update((k, self.before[k]) for k in again)
        return list(unknown - again)


class ByteBpe:
    """Encoder and decoder of one vocabulary file, with bounded caches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        vocab = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if all(c in back for c in s)}
        text_id = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.ids = vocab
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = s
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[text_id[a], text_id[b]] = (rank, text_id[a + b])
        self.packed = {pair: rank << 20 | new for pair, (rank, new) in self.merges.items()}
        # longest-match tables: sorted hashes of the tokens of each length
        self.lengths = sorted({len(s) for s in vocab})
        self.base = 0x9E3779B97F4A7C15 | 1
        self.tables = {}
        for n in self.lengths:
            of = [s for s in vocab if len(s) == n]
            h = self._hash(np.frombuffer(b"".join(of), np.uint8).reshape(-1, n))
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array([vocab[of[k]] for k in order], np.int64))
        self.pairs = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.words, self.chunks = Aging(), Aging()

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            h = h * np.uint64(self.base) + rows[:, k].astype(np.uint64) + np.uint64(1)
        return h

    # exact merging
    def merge(self, word: bytes) -> list[int]:
        """The merge procedure: always the pair of lowest rank, leftmost first."""
        single = self.single
        ids = [single[b] for b in word]
        if len(ids) > _LONG:
            return self._merge_long(ids)
        get = self.packed.get
        todo = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while todo and (best := min(todo)) != _NONE:
            k = todo.index(best)
            ids[k : k + 2] = [best & 0xFFFFF]
            del todo[k]
            if k:
                todo[k - 1] = get((ids[k - 1], ids[k]), _NONE)
            if k < len(todo):
                todo[k] = get((ids[k], ids[k + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            right[k] = after = right[j]
            if after < n:
                left[after] = k
                if m := get((new, ids[after])):
                    heapq.heappush(heap, (m[0], k, new, ids[after], m[1]))
            if (before := left[k]) >= 0 and (m := get((ids[before], new))):
                heapq.heappush(heap, (m[0], before, ids[before], new, m[1]))
        return [i for i in ids if i >= 0]

    # speculation
    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match: token ids of all words, and each token's word number, in order."""
        buf = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        stop = np.repeat(end, size)
        at = np.arange(len(buf))
        best_len, best_id = np.zeros(len(buf), np.int64), np.zeros(len(buf), np.int64)
        h = np.zeros(len(buf), np.uint64)
        live, n = at, 0
        for n in range(1, self.lengths[-1] + 1):
            live = live[live + n <= stop[live]]
            if not len(live):
                break
            h[live] = h[live] * np.uint64(self.base) + buf[live + n - 1].astype(np.uint64) + np.uint64(1)
            if n in self.tables:
                keys, ids = self.tables[n]
                k = np.minimum(np.searchsorted(keys, h[live]), len(keys) - 1)
                hit = keys[k] == h[live]
                best_len[live[hit]], best_id[live[hit]] = n, ids[k[hit]]
        pos, who = end - size, np.arange(len(words))
        who = who[size > 0]
        pos = pos[size > 0]
        out_pos, out_who = [], []
        while len(pos):
            out_pos.append(pos)
            out_who.append(who)
            pos = pos + best_len[pos]
            on = pos < end[who]
            pos, who = pos[on], who[on]
        p, w = np.concatenate([np.zeros(0, np.int64), *out_pos]), np.concatenate([np.zeros(0, np.int64), *out_who])
        order = np.argsort(p, kind="stable")
        return best_id[p[order]], w[order]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For pairs as first * 2^20 + second: whether merging keeps the two tokens apart."""
        known = np.searchsorted(self.pairs, pairs)
        inside = np.minimum(known, max(len(self.pairs) - 1, 0))
        missing = pairs[self.pairs[inside] != pairs] if len(self.pairs) else pairs
        if len(missing):
            if len(self.pairs) > 4 * CACHE:
                self.pairs, self.fits = self.pairs[:0], self.fits[:0]
                missing = pairs
            new = np.unique(missing)
            verdict = [self.merge(self.tokens[a] + self.tokens[b]) == [a, b] for a, b in zip((new >> 20).tolist(), (new & 0xFFFFF).tolist(), strict=True)]
            every = np.concatenate([self.pairs, new])
            order = np.argsort(every)
            self.pairs, self.fits = every[order], np.concatenate([self.fits, np.array(verdict, bool)])[order]
        return self.fits[np.searchsorted(self.pairs, pairs)]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by speculation, verification and, for failing words, exact merging."""
        if not words:
            return []
        ids, who = self.propose(words)
        count = np.bincount(who, minlength=len(words))
        bad = np.zeros(len(words), bool)
        same = who[1:] == who[:-1]
        if same.any():
            fits = self.compatible((ids[:-1][same] << 20) | ids[1:][same])
            bad[who[1:][same][~fits]] = True
        cuts = np.concatenate([[0], np.cumsum(count)]).tolist()
        flat = ids.tolist()
        return [self.merge(words[k]) if bad[k] else flat[cuts[k] : cuts[k + 1]] for k in range(len(words))]

    # texts
    def _learn(self, words: set[str]) -> None:
        new = self.words.lacking(words)
        raw = [w.encode() for w in new]
        for w, ids in zip(new, self.encode_words(raw), strict=True):
            self.words.now[w] = array("I", ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts: list[list] = []
        chunks: set[bytes] = set()
        whole: set[str] = set()
        for text in texts:
            row: list = []
            for piece in self.marks.split(text) if self.marks else [text]:
                if piece in self.special:
                    row.append(np.array([self.special[piece]], "<u4").tobytes())
                elif piece and (piece[0] == 32 or _RUNS.search(piece)):
                    found = SPLIT.findall(piece.decode())
                    whole.update(found)
                    row.append(found)
                elif piece:
                    # a chunk after a single space does not depend on what stands before it; the first one has no space
                    first, *rest = piece.split(b" ")
                    if b" ^" in piece:
                        rest = [b" " + c if c[:1] == b"^" else c for c in rest]
                    found = [b"^" + first, *rest]
                    chunks.update(found)
                    row.append(found)
            parts.append(row)
        fresh = self.chunks.lacking(chunks)
        split = [SPLIT.findall((c[1:] if c[:1] == b"^" else c if c[:1] == b" " else b" " + c).decode()) for c in fresh]
        self._learn(whole.union(*split))
        words, table = self.words.now, self.chunks.now
        for c, s in zip(fresh, split, strict=True):
            table[c] = b"".join([words[w] for w in s])
        out = []
        for row in parts:
            got = []
            for piece in row:
                if isinstance(piece, bytes):
                    got.append(piece)
                else:
                    got += map((words if isinstance(piece[0], str) else table).__getitem__, piece)
            out.append(b"".join(got))
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the ids stand for, special tokens kept."""
        tokens = self.tokens
        raw = b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode("utf-8", "replace").encode()


def bpe(path: str) -> ByteBpe:
    return held(f"bytes {path}", lambda: ByteBpe(path))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, as bytes) and the decoded text of every row.

    Null or empty texts have no ids and an empty decoded text; repeated rows give
    repeated rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        ids = coder.encode(texts_as_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids binary, decoded binary", holds=f"bytes {path}")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of every row, from the coder's whole output."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = bpe(path)
        ids = coder.encode(texts_as_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=f"bytes {path}")

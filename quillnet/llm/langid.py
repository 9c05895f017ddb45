"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled rows; it labels every position of every text, and a document's
probabilities are the mean over the positions of its letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import concatenated, map_slices, others, quoted, widened

UNITS = 12
SPAN = 64
#: Bounds of the training sample, for each language that a label names: documents (about), characters a document.
PER_LANGUAGE = 500
SAMPLE_CHARS = 512
STEPS = 400
BATCH = 256
#: Spans that run side by side in a worker, and output values of theirs (with many languages fewer spans).
WIDE, VALUES = 4096, 1 << 21

#: ASCII letters count in lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3; false where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each span of SPAN bytes begins, where its text ends, and which text that is."""
    size = np.diff(offsets)
    n = -(-size // SPAN)
    who = np.repeat(np.arange(len(size)), n)
    first = np.repeat(offsets[:-1] - SPAN * (np.cumsum(n) - n), n) + SPAN * np.arange(len(who))
    return first, offsets[1:][who], who


def span_bytes(buf: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes (SPAN x spans), spaces after a text's end, and which of them are letters of the text."""
    at = first[None, :] + np.arange(SPAN)[:, None]
    inside = at < end[None, :]
    data = np.where(inside, FOLD[buf[np.minimum(at, len(buf) - 1)]], np.uint8(32))
    return data, LETTER[data] & inside


class Net:
    """Both directions are stacked on the first axis of every weight: tables by byte, recurrent weights, output weights."""

    def __init__(self, classes: int, seed: int = 7):
        r, h = np.random.default_rng(seed), UNITS
        self.w = {
            "x": r.normal(0, 0.3, (2, 3 * h, 256)),
            "u": r.normal(0, 0.6 / np.sqrt(h), (2, 3 * h, h)),
            "b": np.zeros((2, 3 * h, 1)),
            "o": r.normal(0, 0.3, (2, classes, h)),
            "c": np.zeros((classes, 1)),
        }
        self.w["b"][:, :h] = 1.0  # gates start out keeping
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def forward(self, bytes_: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Output values of every position (SPAN x classes x spans); what backward needs, if kept."""
        w, h = self.w, UNITS
        steps, n = bytes_.shape
        state = np.zeros((2, h, n), np.float32)
        out = np.empty((2, steps, w["o"].shape[1], n), np.float32)
        half = w["x"].copy()  # sigmoid(v) = 0.5 + 0.5 tanh(v / 2)
        half[:, : 2 * h] *= 0.5
        half += w["b"] * np.array([0.5] * 2 * h + [0.0] * h, np.float32)[None, :, None]
        rec = w["u"].copy()
        rec[:, : 2 * h] *= 0.5
        bias = w["b"][:, 2 * h :]
        inp, mem = np.empty((2, 3 * h, n), np.float32), []
        for t in range(steps):
            np.take(half[0], bytes_[t], axis=1, out=inp[0], mode="clip")
            np.take(half[1], bytes_[steps - 1 - t], axis=1, out=inp[1], mode="clip")
            r = np.matmul(rec, state)
            gates = np.tanh(inp[:, : 2 * h] + r[:, : 2 * h])
            gates *= 0.5
            gates += 0.5
            z, reset = gates[:, :h], gates[:, h:]
            cand = r[:, 2 * h :] + bias
            raw = cand.copy() if keep else None
            cand *= reset
            cand += inp[:, 2 * h :]
            np.tanh(cand, out=cand)
            old = state
            state = (old - cand) * z
            state += cand
            got = np.matmul(w["o"], state)
            out[0, t], out[1, steps - 1 - t] = got[0], got[1]
            if keep:
                mem.append((old, z.copy(), reset.copy(), raw, cand, state))
        return out[0] + out[1] + w["c"], mem

    def backward(self, bytes_: np.ndarray, mem: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights by backpropagation through time."""
        w, h = self.w, UNITS
        steps = len(bytes_)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["c"] = d_out.sum(axis=(0, 2))[:, None]
        d_state = np.zeros_like(mem[0][0])
        for t in reversed(range(steps)):
            old, z, reset, raw, cand, state = mem[t]
            both = np.stack([d_out[t], d_out[steps - 1 - t]])
            g["o"] += both @ state.transpose(0, 2, 1)
            d = d_state + w["o"].transpose(0, 2, 1) @ both
            d_z = d * (old - cand) * z * (1 - z)
            d_c = d * (1 - z) * (1 - cand * cand)
            d_raw = d_c * reset
            d_r = d_c * raw * reset * (1 - reset)
            d_rec = np.concatenate([d_z, d_r, d_raw], axis=1)
            d_in = np.concatenate([d_z, d_r, d_c], axis=1)
            g["u"] += d_rec @ old.transpose(0, 2, 1)
            g["b"] += d_rec.sum(axis=2, keepdims=True)
            for side, at in ((0, t), (1, steps - 1 - t)):
                one = np.zeros((len(bytes_[at]), 256), np.float32)
                one[np.arange(len(one)), bytes_[at]] = 1
                g["x"][side] += d_in[side] @ one
            d_state = d * z + w["u"].transpose(0, 2, 1) @ d_rec
        return g


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def train(texts: list[bytes], labels: list[int], classes: int, steps: int = STEPS, seed: int = 7) -> Net:
    """Adam on the mean cross entropy of the letters' positions, languages drawn equally often."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    first, end, who = spans(offsets)
    net, rng = Net(classes, seed), np.random.default_rng(seed)
    if not len(who):
        return net
    data, live = span_bytes(np.frombuffer(b"".join(texts), np.uint8), first, end)
    good = live.sum(axis=0) >= SPAN // 8
    data, live, y = data[:, good], live[:, good], np.array(labels)[who[good]]
    of = [np.flatnonzero(y == k) for k in range(classes)]
    of = [x for x in of if len(x)]
    if not of:
        return net
    m1 = {k: np.zeros_like(v) for k, v in net.w.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, BATCH // len(of) + 1) for x in of])
        x, mask = data[:, pick], live[:, pick]
        # half of the spans end early, as short texts do
        stop = np.where(rng.random(len(pick)) < 0.5, rng.integers(4, SPAN, len(pick)), SPAN)
        on = np.arange(SPAN)[:, None] < stop[None, :]
        x, mask = np.where(on, x, np.uint8(32)), (mask & on)[:, None, :]
        out, mem = net.forward(x, keep=True)
        d = softmax(out, 1)
        d[:, y[pick], np.arange(len(pick))] -= 1
        d *= mask / mask.sum()
        g = net.backward(x, mem, d.astype(np.float32))
        rate = 0.02 * min(1, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-4
        for k in net.w:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] ** 2 - m2[k])
            net.w[k] = (net.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def probabilities(net: Net, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over the letters of each text; zeros where there is none."""
    classes, n = len(net.w["c"]), len(offsets) - 1
    total, count = np.zeros((classes, n)), np.zeros(n)
    first, end, who = spans(offsets)
    wide = min(WIDE, max(16, VALUES // (SPAN * classes)))
    for start in range(0, len(who), wide):
        part, live = span_bytes(buf, first[start : start + wide], end[start : start + wide])
        out, _ = net.forward(part)
        np.exp(np.minimum(out, 60, out=out), out=out)
        out *= (live / out.sum(axis=1))[:, None, :]
        per_span = out.sum(axis=0)
        w = who[start : start + wide]
        for k in range(classes):
            total[k] += np.bincount(w, per_span[k], n)
        count += np.bincount(w, live.sum(axis=0), n)
    return (total / np.maximum(count, 1)).T


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """About PER_LANGUAGE labelled passages of each language, at most twice as many in all, of at most SAMPLE_CHARS characters, chosen by hashes of the ids."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    langs = known.groupBy("lang").count().collect()  # one row a language
    if not langs:
        return []
    share = F.broadcast(known.sparkSession.createDataFrame([(r["lang"], min(1.0, PER_LANGUAGE / r["count"])) for r in langs], "lang string, _qn_share double"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    rows = (
        known.join(share, "lang")
        .where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_003)) < F.col("_qn_share") * 1_000_003)
        .select("doc_id", "lang", F.substring(F.col("text"), place, F.lit(SAMPLE_CHARS)).alias("text"))
        .limit(len(langs) * 2 * PER_LANGUAGE)
        .collect()
    )
    return [(r["lang"], r["text"].encode()) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def fit(docs: DataFrame) -> tuple[list[str], Net]:
    """Languages and the network, learned from rows that are not held out."""
    rows = sample(docs)
    langs = sorted({lang for lang, _ in rows})
    return langs, train([t for _, t in rows], [langs.index(lang) for lang, _ in rows], max(1, len(langs)))


def identify(docs: DataFrame, model: tuple[list[str], Net] | None = None) -> DataFrame:
    """The input's rows and columns, with lang_pred and score in place of columns of these names.

    lang_pred is ``und`` and score 0 where the text is null or has no letter, or
    where no language was learned.  Texts of any length are read whole.  Equal
    texts, so repeated rows, get equal labels; of equally likely languages the
    first by name counts.  An empty table gives no rows; other columns stay as they
    are, whatever their names.
    """
    langs, net = model or fit(docs)
    rest = others(docs, "lang_pred", "score")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = concatenated(batch.column("text"))
        p = probabilities(net, buf, offsets)
        best = p.argmax(axis=1)
        ok = batch.column("_qn_lettered").to_numpy(zero_copy_only=False).astype(bool) & bool(langs)
        names = [langs[k] if good else "und" for k, good in zip(best.tolist(), ok.tolist(), strict=True)]
        score = np.where(ok, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"])

    wanted = docs.select(*quoted(rest), lettered.alias("_qn_lettered"))
    return map_slices(wanted, run, widened(docs, rest, "lang_pred string, score double"))

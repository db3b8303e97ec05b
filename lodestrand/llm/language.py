"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads all bytes of a text, forwards and backwards, and labels every byte with
probabilities of the languages; a document's probabilities are the mean over its bytes. Its state is
carried from byte to byte across words and lines. A text longer than SEGMENT is read in segments, so that
long texts fill the same arrays as short ones: each direction first reads the WARM bytes next to a segment, which
it does not label there, and so comes to it with the state that the whole text would have left, but for
what the network still knows after WARM bytes. The weights are trained on the driver, in numpy, by
backpropagation through time.

Training reads a bounded sample: of each language the TRAIN_DOCS labelled rows with the smallest
hash of their id, and of each of those TRAIN_WINDOWS windows of WINDOW bytes, at places all over its text that
hashes choose. That bound is the same at every size, but for the number of languages; prediction covers
all of every text.

Defined results: a null text, or one without a letter, is "und" with score 0; so is every text if no
labelled row was there to learn from; a null doc_id is never learned from and counts as not held out; rows that share a
doc_id count one by one, in the sample too; repeated rows are predicted one by one; an empty table gives
an empty one; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common

TRAIN_DOCS = 150
TRAIN_WINDOWS = 24
WINDOW = 64
HIDDEN = 12
STEPS = 500
BATCH = 128
SEGMENT = 1024
WARM = 64
#: Segments that are read side by side.
LANES = 512
#: Positions whose scores are made probabilities at once.
POSITIONS = 32
UND = "und"
#: A pipeline's filter drops documents whose best language has a smaller mean probability.
MIN_SCORE = 0.3
#: What stands before and after a text: a space.
EDGE = b" "

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes | None) -> bool:
    return bool(raw) and (_ASCII_LETTER.search(raw) is not None or not raw.isascii() and any(x.isalpha() for x in common.text_of(raw)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


@dataclass
class Network:
    """Weights; for each direction d an input table [256, 3H], a recurrent matrix [H, 3H] and a bias [H] of the candidate."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            languages,
            [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
            [np.zeros(hidden, np.float32) for _ in range(2)],
            draw(2 * hidden, len(languages), scale=hidden**-0.5),
            np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.inner, self.out, self.bias]

    def _run(self, steps: np.ndarray, d: int) -> tuple[np.ndarray, list]:
        """States [T, B, H] of one direction over bytes [T, B], in its own order, and what their gradients need."""
        hidden = self.recurrent[d].shape[0]
        state = np.zeros((steps.shape[1], hidden), self.recurrent[d].dtype)
        states, saved = [], []
        for symbols in steps:
            x, u = self.tables[d][symbols], state @ self.recurrent[d]
            gates = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            candidate = u[:, 2 * hidden :] + self.inner[d]
            n = np.tanh(x[:, 2 * hidden :] + r * candidate)
            saved.append((symbols, state, z, r, candidate, n))
            state = n + z * (state - n)
            states.append(state)
        return np.stack(states), saved

    def _back(self, grads: np.ndarray, saved: list, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of table, recurrent matrix and inner bias from those of the states, backwards in time."""
        recurrent = self.recurrent[d]
        g_rec, g_inner = np.zeros_like(recurrent), np.zeros_like(self.inner[d])
        g_state = np.zeros_like(grads[0])
        inputs = []
        for t in range(len(saved) - 1, -1, -1):
            _, before, z, r, candidate, n = saved[t]
            g = grads[t] + g_state
            g_n = g * (1 - z) * (1 - n * n)
            g_z = g * (before - n) * z * (1 - z)
            g_c = g_n * r
            g_r = g_n * candidate * r * (1 - r)
            inputs.append(np.concatenate([g_z, g_r, g_n], 1))
            g_u = np.concatenate([g_z, g_r, g_c], 1)
            g_rec += before.T @ g_u
            g_inner += g_c.sum(0)
            g_state = g * z + g_u @ recurrent.T
        # The inputs' gradients are summed by byte.
        symbols = np.concatenate([own[0] for own in reversed(saved)])
        order = np.argsort(symbols, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(symbols[order]) != 0]))
        g_table = np.zeros_like(self.tables[d])
        g_table[symbols[order][starts]] = np.add.reduceat(np.concatenate(inputs)[order], starts)
        return g_table, g_rec, g_inner

    def positions(self, steps: np.ndarray) -> np.ndarray:
        """Probabilities [T, B, languages] of every position of byte columns [T, B]."""
        ahead, _ = self._run(steps, 0)
        back, _ = self._run(steps[::-1], 1)
        return _softmax(np.concatenate([ahead, back[::-1]], 2) @ self.out + self.bias)

    def gradients(self, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients in the order of weights()."""
        ahead, a = self._run(steps, 0)
        back, b = self._run(steps[::-1], 1)
        both = np.concatenate([ahead, back[::-1]], 2)
        p = _softmax(both @ self.out + self.bias)
        rows = np.arange(steps.shape[1])
        loss = float(-np.log(p[:, rows, labels] + 1e-9).mean())
        p[:, rows, labels] -= 1
        p /= p.shape[0] * p.shape[1]
        g_both = p @ self.out.T
        hidden = ahead.shape[2]
        ta, ra, ia = self._back(g_both[:, :, :hidden], a, 0)
        tb, rb, ib = self._back(g_both[::-1, :, hidden:], b, 1)
        return loss, [ta, tb, ra, rb, ia, ib, np.tensordot(both, p, ((0, 1), (0, 1))), p.sum((0, 1))]


def train(rows: Iterable[tuple[str, bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.01, seed: int = 11) -> Network | None:
    """Fit a network to (language, window) rows by Adam; None without rows. All languages weigh the same. A window
    shorter than WINDOW is repeated, with spaces between."""
    known = sorted({(language, ((raw + EDGE) * (1 + WINDOW // (len(raw) + 1)))[:WINDOW]) for language, raw in rows if raw})
    if not known:
        return None
    languages = sorted({x for x, _ in known})
    labels = np.array([languages.index(x) for x, _ in known])
    columns = np.frombuffer(b"".join(x for _, x in known), np.uint8).reshape(len(known), WINDOW).T
    weights = 1 / np.bincount(labels)[labels]
    net, rng = Network.start(languages), np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        pick = rng.choice(len(labels), batch, p=weights / weights.sum())
        _, grads = net.gradients(columns[:, pick], labels[pick])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Inference over lanes of bytes. Arrays have a row per unit and a column per lane, so that each step's operations run along the lanes, over whole rows. What is kept of a state s is
    q = (1 - s) / 2, as a candidate tanh(y) is then 1 / (1 + exp(2y)), and a gate divides by 1 + exp(-x); both signs and factors are in the weights. A last row of ones brings the bias."""

    def __init__(self, net: Network):
        self.net, self.hidden = net, net.recurrent[0].shape[0]
        h = self.hidden
        sign = np.concatenate([np.full(2 * h, -1.0), np.full(h, 2.0)])
        single = lambda x: np.ascontiguousarray(x.T, np.float32)
        # s = 1 - 2q, so x @ s is the sum of x less twice x @ q.
        of_q = lambda x, bias: np.vstack([-2.0 * x, x.sum(0, dtype=float) + bias])
        self.inputs = [single(x * sign) for x in net.tables]
        self.recurrent = [single(of_q(x, np.concatenate([np.zeros(2 * h), b])) * sign) for x, b in zip(net.recurrent, net.inner, strict=True)]
        self.out = [single(of_q(net.out[:h], net.bias)), single(of_q(net.out[h:], 0.0))]

    def _scores(self, steps: np.ndarray, running: np.ndarray, d: int, scores: np.ndarray) -> None:
        """Direction d's part of the scores [T, languages, B] of bytes [T, B], of which the first running[t] lanes have a byte at t: set by the first direction, added by the other."""
        h, lanes, k = self.hidden, steps.shape[1], 0
        space = [np.empty(rows * lanes, np.float32) for rows in (3 * h, 3 * h, len(self.net.languages))]
        state = np.ones((h + 1, 0), np.float32)
        for t in range(len(steps)) if d == 0 else range(len(steps) - 1, -1, -1):
            if running[t] != k:
                # Lanes end in one direction, and begin, with a state s of zeros, in the other.
                before, k = state, int(running[t])
                state = np.full((h + 1, k), 0.5, np.float32)
                state[:, : before.shape[1]] = before[:, :k]
                state[h] = 1
                x, u, own = (flat[: len(flat) // lanes * k].reshape(-1, k) for flat in space)
                gates, n, candidate, update, reset, units = x[: 2 * h], x[2 * h :], u[2 * h :], x[:h], x[h : 2 * h], state[:h]
            np.matmul(self.recurrent[d], state, out=u)
            np.take(self.inputs[d], steps[t, :k], axis=1, out=x, mode="clip")
            gates += u[: 2 * h]
            np.exp(gates, out=gates)
            gates += 1
            candidate /= reset
            n += candidate
            np.exp(n, out=n)
            n += 1
            np.reciprocal(n, out=n)
            units -= n
            units /= update
            units += n
            np.matmul(self.out[d], state, out=own)
            if d == 0:
                scores[t, :, :k] = own
            else:
                scores[t, :, :k] += own

    def scores(self, lanes: list[bytes]) -> np.ndarray:
        """Scores [T, languages, B] of all bytes of lanes of falling length; beyond a lane's end they are 0."""
        lengths = np.array([len(x) for x in lanes])
        most = int(lengths[0])
        steps = np.ascontiguousarray(np.frombuffer(b"".join(x.ljust(most) for x in lanes), np.uint8).reshape(len(lanes), most).T, np.intp)
        running = np.searchsorted(-lengths, -np.arange(most), side="left")
        scores = np.zeros((most, len(self.net.languages), len(lanes)), np.float32)
        # An exp beyond single precision is an infinity, by which a gate or a candidate is the 0 that it should be.
        with np.errstate(over="ignore"):
            self._scores(steps, running, 0, scores)
            self._scores(steps, running, 1, scores)
        return scores

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the probabilities summed over its bytes."""
        lanes = [(k, *x) for k, raw in enumerate(texts) for x in segments(raw)]
        lanes.sort(key=lambda x: -len(x[1]))
        out = np.zeros((len(texts), len(self.net.languages)))
        for at in range(0, len(lanes), LANES):
            part = lanes[at : at + LANES]
            scores = self.scores([x for _, x, _, _ in part])
            total, first, last = np.zeros(scores.shape[1:]), np.array([a for _, _, a, _ in part]), np.array([b for _, _, _, b in part])
            for t in range(0, len(scores), POSITIONS):
                p = scores[t : t + POSITIONS]
                p -= p.max(1, keepdims=True)
                np.exp(p, out=p)
                places = np.arange(t, t + len(p))[:, None]
                p *= (((places >= first) & (places < last)) / p.sum(1))[:, None].astype(np.float32)
                total += p.sum(0)
            np.add.at(out, [k for k, _, _, _ in part], total.T)
        return out

    def predict(self, texts: list[bytes | None]) -> Iterator[tuple[str, float]]:
        known = [k for k, x in enumerate(texts) if has_letter(x)]
        sums = dict(zip(known, self.sums([texts[k] for k in known]), strict=True)) if known else {}
        for k in range(len(texts)):
            if k in sums:
                best = int(sums[k].argmax())
                yield self.net.languages[best], min(1.0, float(sums[k][best] / sums[k].sum()))
            else:
                yield UND, 0.0


def segments(raw: bytes) -> list[tuple[bytes, int, int]]:
    """A text's segments: the bytes to read, with what lies beside them, and the range of those to label."""
    out, whole = [], EDGE + raw + EDGE
    for at in range(0, len(raw), SEGMENT):
        size, first = min(SEGMENT, len(raw) - at), max(0, at + 1 - max(1, WARM))
        out.append((whole[first : at + 1 + size + max(1, WARM)], at + 1 - first, at + 1 - first + size))
    return out


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of parts; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == 0, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str, parts: int | None = 5, n_docs: int = TRAIN_DOCS, n_windows: int = TRAIN_WINDOWS) -> DataFrame:
    """(lang, window) of the bounded sample; parts: leave out documents that held_out(doc_id, parts) says."""
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), common.utf8(text).alias("text")).where("id is not null and lang is not null and length(text) > 0")
    if parts:
        labelled = labelled.where(~held_out(F.col("id"), parts))

    def first(rows: DataFrame, *order: str) -> DataFrame:
        best = Window.partitionBy("lang").orderBy(*order)
        return rows.withColumn("k", F.row_number().over(best)).where(F.col("k") <= n_docs)

    # Ids alone are ranked over all rows, and each task keeps its n_docs first before any row moves; then the few rows of these ids.
    ids = first(labelled.select("lang", "id", F.xxhash64("id").alias("h")), "h", "id").select("id").distinct()
    windows = F.expr(f"transform(sequence(1, {n_windows}), k -> substring(text, cast(1 + pmod(xxhash64(id, k), greatest(1, length(text) - {WINDOW - 1})) as int), {WINDOW}))")
    cut = labelled.join(F.broadcast(ids), "id").select("lang", "id", F.xxhash64("id").alias("h"), windows.alias("windows"))
    return first(cut, "h", "id", "windows").select("lang", F.explode("windows").alias("window"))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", parts: int | None = 5) -> Network | None:
    """A network from a bounded sample of docs (see training_rows)."""
    common.prepare(docs.sparkSession)
    return train((r.lang, bytes(r.window)) for r in training_rows(docs, doc_id, text, lang, parts).collect())


def identify(docs: DataFrame, net: Network | None, text: str = "text", prefix: str = "", drop: Iterable[str] = ()) -> DataFrame:
    """docs with lang_pred and score of every text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make() -> Callable[[list], Iterable[tuple]]:
        if shared.value is None:
            return lambda texts: ((UND, 0.0) for _ in texts)
        return Reader(shared.value).predict

    added = T.StructType([T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])
    return common.append_columns(docs, text, make, added, drop)


def with_known_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs in which a language is found with at least that score, columns unchanged."""
    prefix = "found_"
    while any(x.lower().startswith(prefix) for x in docs.columns):
        prefix = f"_{prefix}"
    found = identify(docs, fit(docs, doc_id, text, lang), text, prefix)
    return found.where((F.col(f"{prefix}lang_pred") != UND) & (F.col(f"{prefix}score") >= min_score)).select(docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    net = fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), common.utf8("text").alias("text"))
    return identify(rows, net, drop=["text"])

"""Language identification by a bidirectional gated recurrent network over bytes, in NumPy.

Texts are cut into windows; a window is read forwards and backwards, each position gets probabilities of the
languages from both states, and a document's probabilities are the mean over all its letters. Windows of many
documents are read side by side. The network is trained by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.blocks import WIDE_BYTES, slices, text_bytes
from gradeloom.llm.familiar import Familiarity
from gradeloom.llm.samples import by_hash_of_each

WINDOW = 96
SIDE_BY_SIDE = 4_096
#: A fit takes windows of at most so many documents, evenly many of each language and chosen by a hash of the text, and
#: so many windows of each.
FIT_DOCS = 4_000
FIT_WINDOWS = 3
STATES = 8
UNDETERMINED = "und"

#: Bytes that count as letters: A-Z, a-z and all that is not ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class Direction:
    """Weights of a gated recurrent unit over bytes, and of its share in the outputs.

    Columns hold the update gate, the reset gate and the candidate, each as wide as the state.
    """

    inputs: np.ndarray  # 256 x 3h
    states: np.ndarray  # h x 3h
    bias: np.ndarray  # h, inside the reset product
    outputs: np.ndarray  # h x languages

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.bias, self.outputs]

    def forward(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of each step for ``codes`` (steps x windows), and what the way back needs."""
        steps, n = codes.shape
        h = len(self.bias)
        state = np.zeros((steps + 1, n, h), np.float32)
        gates, inner, new = (np.empty((steps, n, k), np.float32) for k in (2 * h, h, h))
        for t in range(steps):
            x, a = self.inputs[codes[t]], state[t] @ self.states
            gates[t] = 0.5 + 0.5 * np.tanh(0.5 * (x[:, : 2 * h] + a[:, : 2 * h]))
            inner[t] = a[:, 2 * h :] + self.bias
            new[t] = np.tanh(x[:, 2 * h :] + gates[t, :, h:] * inner[t])
            state[t + 1] = new[t] + gates[t, :, :h] * (state[t] - new[t])
        return state[1:] @ self.outputs, (codes, state, gates, inner, new)

    def backward(self, d_scores: np.ndarray, saved: tuple) -> list[np.ndarray]:
        """Gradients of ``arrays()``, back through all steps."""
        codes, state, gates, inner, new = saved
        steps, n, h = new.shape
        d_inputs, d_states, d_bias = (np.zeros_like(a) for a in (self.inputs, self.states, self.bias))
        d_outputs = np.tensordot(state[1:], d_scores, ((0, 1), (0, 1)))
        d_state = np.zeros((n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r = gates[t, :, :h], gates[t, :, h:]
            d_state = d_state + d_scores[t] @ self.outputs.T
            d_new = d_state * (1 - z) * (1 - new[t] ** 2)
            d_inner = d_new * r
            d_z = d_state * (state[t] - new[t]) * z * (1 - z)
            d_r = d_new * inner[t] * r * (1 - r)
            d_x = np.concatenate((d_z, d_r, d_new), axis=1)
            d_a = np.concatenate((d_z, d_r, d_inner), axis=1)
            np.add.at(d_inputs, codes[t], d_x)
            d_states += state[t].T @ d_a
            d_bias += d_inner.sum(axis=0)
            d_state = d_state * z + d_a @ self.states.T
        return [d_inputs, d_states, d_bias, d_outputs]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """As ``forward``, keeping the last state only."""
        steps, n = codes.shape
        h = len(self.bias)
        out = np.empty((steps, n, self.outputs.shape[1]), np.float32)
        # Gates are (1 + tanh(x / 2)) / 2: the halves go into the weights.
        half = np.concatenate((np.full(2 * h, 0.5), np.ones(h))).astype(np.float32)
        inputs, weights = self.inputs * half, self.states * half
        gate_in, new_in = inputs[:, : 2 * h].copy(), inputs[:, 2 * h :].copy()
        gate_by, new_by = weights[:, : 2 * h].copy(), weights[:, 2 * h :].copy()
        state = np.zeros((n, h), np.float32)
        gate, new, x_new = np.empty((n, 2 * h), np.float32), np.empty((n, h), np.float32), np.empty((n, h), np.float32)
        x_gate = np.empty((n, 2 * h), np.float32)
        for t in range(steps):
            np.matmul(state, gate_by, out=gate)
            gate += np.take(gate_in, codes[t], axis=0, out=x_gate, mode="clip")
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            np.matmul(state, new_by, out=new)
            new += self.bias
            new *= gate[:, h:]
            new += np.take(new_in, codes[t], axis=0, out=x_new, mode="clip")
            np.tanh(new, out=new)
            state -= new
            state *= gate[:, :h]
            state += new
            np.matmul(state, self.outputs, out=out[t])
        return out


@dataclass
class LanguageNetwork:
    languages: list[str]
    ahead: Direction
    back: Direction
    bias: np.ndarray

    def positions(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each position (steps x windows x languages).

        ``codes`` holds the windows' bytes, padded behind; ``sizes`` their lengths.
        """
        backwards = backward_order(len(codes), sizes)
        scores = self.ahead.scores(codes)
        scores += np.take_along_axis(
            self.back.scores(np.take_along_axis(codes, backwards, axis=0)), backwards[:, :, None], axis=0
        )
        scores += self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over the letters of each text; zeros for texts without letters."""
        start, size, owner = windows(offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        letters = np.zeros(len(offsets) - 1)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), SIDE_BY_SIDE):
            some = order[at : at + SIDE_BY_SIDE]
            steps = np.arange(size[some[0]])[:, None]
            codes = data[np.minimum(start[some] + steps, len(data) - 1)]
            counted = LETTER[codes] & (steps < size[some])
            p = self.positions(codes, size[some])
            np.add.at(out, owner[some], (p * counted[:, :, None]).sum(axis=0))
            np.add.at(letters, owner[some], counted.sum(axis=0))
        return out / np.maximum(letters, 1)[:, None]


def backward_order(steps: int, sizes: np.ndarray) -> np.ndarray:
    """For each window the positions in reverse; padding stays behind."""
    steps = np.arange(steps)[:, None]
    return np.where(steps < sizes, sizes - 1 - steps, steps)


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text of the windows that cover all texts."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + place * WINDOW
    return start, np.minimum(WINDOW, offsets[1:][owner] - start), owner


def train(
    texts: list[bytes], labels: list[str], states: int = STATES, rounds: int = 350, batch: int = 128, rate: float = 0.02,
    seed: int = 7,
) -> LanguageNetwork:
    """Network for windows and their languages: Adam on the cross entropy of all letters.

    A language is drawn in proportion to the root of its number of windows, so that rare ones are learned too.
    """
    random = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    size = np.array([len(t) for t in texts])
    shares = np.bincount(target) ** -0.5
    drawn = np.cumsum(shares[target]) / shares[target].sum()
    codes = np.zeros((WINDOW, len(texts)), np.uint8)
    for k, t in enumerate(texts):
        codes[: len(t), k] = np.frombuffer(t, np.uint8)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (random.standard_normal(shape) * scale).astype(np.float32)

    made = [
        Direction(
            normal(256, 3 * states, scale=0.3), normal(states, 3 * states, scale=states**-0.5),
            np.zeros(states, np.float32), normal(states, len(names), scale=states**-0.5),
        )
        for _ in range(2)
    ]
    net = LanguageNetwork(names, *made, np.zeros(len(names), np.float32))
    weights = [*net.ahead.arrays(), *net.back.arrays(), net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for k in range(1, rounds + 1):
        some = np.minimum(np.searchsorted(drawn, random.random(min(batch, len(texts)))), len(texts) - 1)
        c, backwards = codes[:, some], backward_order(WINDOW, size[some])
        a, a_saved = net.ahead.forward(c)
        b, b_saved = net.back.forward(np.take_along_axis(c, backwards, axis=0))
        scores = a + np.take_along_axis(b, backwards[:, :, None], axis=0) + net.bias
        p = np.exp(scores - scores.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        counted = LETTER[c] & (np.arange(WINDOW)[:, None] < size[some])
        p[:, np.arange(len(some)), target[some]] -= 1
        d = (p * (counted / max(1, counted.sum()))[:, :, None]).astype(np.float32)
        d_back = np.take_along_axis(d, backwards[:, :, None], axis=0)
        grads = [*net.ahead.backward(d, a_saved), *net.back.backward(d_back, b_saved), d.sum(axis=(0, 1))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        step = rate * min(1.0, 4 * (1 - k / (rounds + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            g = g * min(1.0, 1 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return net


def labelled_windows(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[list[bytes]], list[str]]:
    """Windows and language of rows with a text and a language: ``FIT_WINDOWS`` windows, spread over the text, of at most
    ``FIT_DOCS`` documents: of each language an even share of them, or all it has, chosen by a hash of the text."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(r"text IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # Texts are cut into windows before they are ordered, so whole texts never leave their task.
    every = f"greatest(1, octet_length(text) - {WINDOW})"
    place = f"k -> substring(cast(text AS binary), cast(1 + pmod(h + k * 7919, {every}) AS int), {WINDOW})"
    parts = f"transform(sequence(0, {FIT_WINDOWS - 1}), {place}) AS parts"
    found = by_hash_of_each(rows.selectExpr("h", "lang", parts), "h", "lang", FIT_DOCS).collect()
    return [[bytes(p) for p in r.parts if p] for r in found], [r.lang for r in found]


def train_documents(docs: list[list[bytes]], labels: list[str]) -> LanguageNetwork | None:
    pairs = [(p, x) for parts, x in zip(docs, labels) for p in parts]
    return train([p for p, _ in pairs], [x for _, x in pairs]) if pairs else None


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageNetwork | None:
    """Network trained on ``labelled_windows``. None without such rows."""
    return train_documents(*labelled_windows(docs, text, lang))


def languages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    keep_out: str = "pmod(crc32(cast(key AS string)), 5) = 0",
) -> DataFrame:
    """Language of each row: ``doc_key, held_out boolean, lang_pred string, score double`` (0 to 1).

    The network learns from rows with a language for which ``keep_out`` does not hold; predictions use the whole text
    and nothing else. ``und`` with score 0 if the text is null or has no letter, and for all rows if there is nothing
    to learn from. Repeated rows and null keys give a row each; ties go to the first language in order; an empty
    input gives no rows. Other columns are not read, whatever their names.
    """
    source = docs.select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    held = f"coalesce({keep_out}, false)"
    net = fit_languages(source.where(f"NOT {held}"))
    found = with_language(source.select("key", "text").withColumn("held_out", F.expr(held)), net)
    return found.selectExpr("key AS doc_key", "held_out", "lang_pred", "lang_score AS score")


def _familiar(
    familiarity: Familiarity, names: list[str], best: np.ndarray, lettered: np.ndarray, data: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Language of each text and whether it reads as that; a text that does not may read as a seldom language, of which
    the network has seen too little."""
    known = lettered & familiarity.known(data, offsets, [names[k] for k in best])
    for x in familiarity.seldom:
        left = lettered & ~known
        if left.any():
            again = familiarity.known(data, offsets, [x if k else None for k in left])
            best, known = np.where(again, names.index(x), best), known | again
    return best, known


def with_language(
    docs: DataFrame, net: LanguageNetwork | None, text: str = "text", familiarity: Familiarity | None = None
) -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred string, lang_score double``; columns of these names are
    replaced. Nothing is shuffled; without a network every text is undetermined. With ``familiarity``, so is a text
    that does not read as the language found for it."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "lang_score")))
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0)})
    rows = docs.withColumn("lang_pred", F.expr(rf"if(coalesce(`{text}` RLIKE '\\p{{L}}', false), 'some', '{UNDETERMINED}')"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, WIDE_BYTES):
            p = net.pooled(*text_bytes(batch.column(text)))
            best = p.argmax(axis=1)
            known = np.array(batch.column("lang_pred").to_pylist()) != UNDETERMINED
            if familiarity is not None:
                best, known = _familiar(familiarity, net.languages, best, known, *text_bytes(batch.column(text)))
            names = pa.array([net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known)], pa.string())
            score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            columns = [names if n == "lang_pred" else c for c, n in zip(batch.columns, batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_score"])

    return rows.mapInArrow(run, rows.select("*").schema.add("lang_score", "double"))

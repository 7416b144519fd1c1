"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax.

Counts of all training tokens are summed by Spark. The ``WORDS`` most frequent words, the end of a
text, and ``FORMS`` kinds of rarer word are the network's vocabulary, in classes by frequency; a
rarer word's probability is that of its form times its add-one share among the form's words, so
the probabilities of all words sum to one. Weights start at the unigram distribution.

Every training document is learned from whole, once. A hash of its id and text deals it to one of
``ROUNDS`` rounds and to a replica of that round, of about ``REPLICA_TOKENS`` tokens (more, where that
would make above ``MOST_REPLICAS`` replicas), so weights do not depend on how the table lies in files. A
replica starts from the round's weights and learns by truncated backpropagation over lanes of texts,
the long ones first, then in order of the hash: a lane takes the next text when its own ends, and the
state is carried from window to window within a text. Texts stream through the task. Replicas are
averaged in Spark, in two steps of bounded groups, and the next round starts from their mean.

Scoring packs whole documents one after another into lanes that step together; the state is carried
across windows and is reset where a document begins. Words beyond the ``HEAD`` most frequent, the
only ones whose counts travel to the tasks (16 bytes each), leave as (document, word hash, times)
and meet their counts in a join.

Defined results: a null text is empty and has the end as its only token; a null id hashes like the
empty string; a text of any length is one row of a lane and needs memory for its ids, two bytes a word;
rows that repeat have equal scores and are dealt over replicas, so none gathers in one; words of equal
count rank by their hash; an empty table gives an empty result, and with no training token every count
is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewater.llm import textkit
from tidewater.llm.shared import drop_staged, stage

CLASSES, PER_CLASS, FORMS = 32, 64, 16
VOCABULARY = CLASSES * PER_CLASS
WORDS = VOCABULARY - FORMS - 1
HEAD = 1 << 18
EMBED, HIDDEN = 16, 24
WINDOW, LANES, ROUNDS, RATE = 32, 128, 3, 0.01
SCORE_WINDOW, SCORE_LANES = 32, 384
REPLICA_TOKENS, MOST_REPLICAS = 1 << 21, 4096
#: Texts of more tokens are taken first, so that no lane is left alone with one at the end.
LONG_TEXT = 2048
#: Hash of the end token; a word's hash is never looked up under it but by a 64-bit coincidence.
END = np.uint64(0x1D0E2F6B9C3A5784)
SHAPES = {"emb": (VOCABULARY, EMBED), "wx": (3, EMBED, HIDDEN), "wh": (3, HIDDEN, HIDDEN), "b": (3, 1, HIDDEN), "uc": (HIDDEN, CLASSES), "bc": (CLASSES,), "uw": (CLASSES, HIDDEN, PER_CLASS), "bw": (CLASSES, PER_CLASS)}
CHUNK = 1 << 14


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, form, first token of each row) of a slice's lower-cased words, each row closed by an end."""
    t = textkit.Texts(data, at, lower=True)
    n, ends = len(t.start), np.arange(1, len(at)) + t.first[1:] - 1
    hashes, forms = np.full(n + len(at) - 1, END), np.zeros(n + len(at) - 1, np.int8)
    if n:
        word = np.ones(len(hashes), bool)
        word[ends] = False
        hashes[word] = t.word_hash()
        wide = np.concatenate([[0], np.cumsum(t.data >= 128)])
        forms[word] = (t.data[t.end - 1].astype(np.int64) * 11 >> 3) % 8 + 8 * (wide[t.end] > wide[t.start])
    return hashes, forms, t.first + np.arange(len(at))


@dataclass
class Lexicon:
    """What tasks know of the counts: the head's sorted hashes, counts and vocabulary ids, and the forms' totals."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    end_id: int
    form_ids: np.ndarray
    form_mass: np.ndarray
    prior: np.ndarray

    def look_up(self, hashes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vocabulary id, count, is in the head) of tokens."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        counts = np.where(known, self.counts[at], 0) if len(self.hashes) else np.zeros(len(hashes), np.int64)
        ids = np.where(known, self.ids[at], -1) if len(self.hashes) else np.full(len(hashes), -1)
        ids = np.where(hashes == END, self.end_id, ids)
        return np.where(ids < 0, self.form_ids[forms], ids), counts, known


def make_lexicon(head: pa.Table, forms: dict[int, tuple[int, int]]) -> Lexicon:
    """``head``: (hash, form, c); ``forms``: tokens and words of each form over all words."""
    hashes, form, counts = head["hash"].to_numpy().view(np.uint64), head["form"].to_numpy(), head["c"].to_numpy()
    order = np.lexsort((hashes, -counts))
    order = order[hashes[order] != END][:WORDS]
    mass = np.array([sum(forms.get(f, (0, 0))) + 1.0 for f in range(FORMS)])
    tail = np.array([float(forms.get(f, (0, 0))[0]) for f in range(FORMS)])
    np.subtract.at(mass, form[order], counts[order] + 1.0)
    np.subtract.at(tail, form[order], counts[order])
    end = counts[hashes == END]
    weight = np.concatenate([counts[order], [end[0] if len(end) else 0], tail]).astype(float) + 0.5
    weight = np.concatenate([weight, np.full(VOCABULARY - len(weight), 1e-6)])
    rank = np.empty(VOCABULARY, np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(VOCABULARY)
    prior = np.empty(VOCABULARY)
    prior[rank] = weight / weight.sum()
    ids = np.full(len(hashes), -1)
    ids[order] = rank[: len(order)]
    by_hash = np.argsort(hashes)
    n = len(order)
    return Lexicon(hashes[by_hash], counts[by_hash], ids[by_hash], int(rank[n]), rank[n + 1 : n + 1 + FORMS], mass, prior)


def first_weights(lexicon: Lexicon, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    p = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    p["uc"] *= 0.1
    p["uw"] *= 0.1
    p["b"][:] = 0  # of the reset gate, the update gate and the candidate, as the first axis of wx and wh
    prior = lexicon.prior.reshape(CLASSES, PER_CLASS)
    p["bc"] = np.log(prior.sum(1)).astype(np.float32)
    p["bw"] = np.log(prior / prior.sum(1, keepdims=True)).astype(np.float32)
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weights by name."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s)
        at += n
    return out


def squash(x: np.ndarray) -> np.ndarray:
    """Softsign, x / (1 + |x|), of an array that is overwritten. It takes the place of tanh, of which numpy's is many times slower."""
    below = np.abs(x)
    below += 1
    x /= below
    return x


def _slope(s: np.ndarray) -> np.ndarray:
    """The derivative of softsign where its value is ``s``."""
    out = np.abs(s)
    np.subtract(1, out, out=out)
    out *= out
    return out


def _step(gx: np.ndarray, h: np.ndarray, wh: np.ndarray, s: np.ndarray, gates: np.ndarray, ghn: np.ndarray, cand: np.ndarray, new: np.ndarray) -> None:
    """The state ``new`` after a token, and what the gradient needs: squashed gate inputs, gates, the candidate's recurrent part, the candidate."""
    np.matmul(h, wh[:2], out=s)
    s += gx[:2]
    squash(s)
    np.multiply(s, np.float32(0.5), out=gates)
    gates += np.float32(0.5)
    np.matmul(h, wh[2], out=ghn)
    np.multiply(gates[0], ghn, out=cand)
    cand += gx[2]
    squash(cand)
    np.subtract(h, cand, out=new)
    new *= gates[1]
    new += cand


def _exponentials(x: np.ndarray) -> np.ndarray:
    """exp of each row less, where any value is large, the row's largest one; ``x`` is overwritten."""
    if x.size and x.max() > 60:
        x -= x.max(1, keepdims=True)
        np.maximum(x, np.float32(-80), out=x)
    return np.exp(x, out=x)


_ONES = np.ones(max(CLASSES, PER_CLASS), np.float32)


def _sum(x: np.ndarray) -> np.ndarray:
    """Sum over rows, by a product, which is faster than ``sum``."""
    return np.ones(len(x), np.float32) @ x


def _less_target(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Make ``x`` the softmax of each row less one at its target; returns the targets' shares."""
    rows = np.arange(len(target))
    _exponentials(x)
    x /= (x @ _ONES[: x.shape[1]])[:, None]
    share = x[rows, target]
    x[rows, target] = share - 1
    return share


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the rows by class, and (class, first, end) of each class there."""
    cls = (target // PER_CLASS).astype(np.int8)
    order = np.argsort(cls, kind="stable")
    ends = np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]


def log_probability(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of each target after its state."""

    def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        _exponentials(x)
        return np.log(x[np.arange(len(at)), at] / (x @ _ONES[: x.shape[1]]))

    x = h @ p["uc"]
    x += p["bc"]
    out = log_share(x, target // PER_CLASS)
    order, parts = _by_class(target)
    hs, word = h.take(order, 0), target.take(order) % PER_CLASS
    inside = np.empty(len(target), np.float32)
    for c, a, b in parts:
        x = hs[a:b] @ p["uw"][c]
        x += p["bw"][c]
        inside[a:b] = log_share(x, word[a:b])
    out[order] += inside
    return out


def gradients(p: dict[str, np.ndarray], given: np.ndarray, target: np.ndarray, on: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """Add to ``g`` the gradients of the summed loss over a window (steps, lanes); the state after it, and the loss. ``on`` masks the tokens."""
    (steps, lanes), kind = given.shape, p["wh"].dtype
    flat_given = given.ravel()
    embedded = p["emb"].take(flat_given, 0)
    gx = np.matmul(embedded, p["wx"])
    gx += p["b"]
    gx = gx.reshape(3, steps, lanes, HIDDEN)
    states = np.empty((steps + 1, lanes, HIDDEN), kind)
    gates, s = (np.empty((2, steps, lanes, HIDDEN), kind) for _ in range(2))
    cand, ghn = (np.empty((steps, lanes, HIDDEN), kind) for _ in range(2))
    states[0] = h
    for t in range(steps):
        _step(gx[:, t], states[t], p["wh"], s[:, t], gates[:, t], ghn[t], cand[t], states[t + 1])
    mask = np.flatnonzero(on.ravel())
    flat_h, flat_t = states[1:].reshape(-1, HIDDEN).take(mask, 0), target.ravel().take(mask)
    x = flat_h @ p["uc"]
    x += p["bc"]
    shares = np.empty((2, len(flat_t)), kind)
    shares[0] = _less_target(x, flat_t // PER_CLASS)
    g["uc"] += flat_h.T @ x
    g["bc"] += _sum(x)
    order, parts = _by_class(flat_t)
    dh_sorted = (x @ p["uc"].T).take(order, 0)
    hs_sorted, word = flat_h.take(order, 0), flat_t.take(order) % PER_CLASS
    for c, a, b in parts:
        x = hs_sorted[a:b] @ p["uw"][c]
        x += p["bw"][c]
        shares[1, a:b] = _less_target(x, word[a:b])
        g["uw"][c] += hs_sorted[a:b].T @ x
        g["bw"][c] += _sum(x)
        dh_sorted[a:b] += x @ p["uw"][c].T
    from_output = np.zeros((steps * lanes, HIDDEN), kind)
    from_output[mask[order]] = dh_sorted
    from_output = from_output.reshape(steps, lanes, HIDDEN)
    slope = _slope(s)
    slope *= np.float32(0.5)
    of_cand = (1 - gates[1]) * _slope(cand)
    of_reset, of_update = ghn * slope[0], (states[:-1] - cand) * slope[1]
    carry, back = np.zeros((lanes, HIDDEN), kind), np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
    dgh, dn = np.empty((3, steps, lanes, HIDDEN), kind), np.empty((steps, lanes, HIDDEN), kind)
    for t in range(steps - 1, -1, -1):
        dh = carry + from_output[t]
        np.multiply(dh, of_cand[t], out=dn[t])
        np.multiply(dn[t], of_reset[t], out=dgh[0, t])
        np.multiply(dh, of_update[t], out=dgh[1, t])
        np.multiply(dn[t], gates[0, t], out=dgh[2, t])
        dh *= gates[1, t]
        for k in range(3):
            dh += dgh[k, t] @ back[k]
        carry = dh
    dgh = dgh.reshape(3, steps * lanes, HIDDEN)
    g["wh"] += np.matmul(states[:-1].reshape(-1, HIDDEN).T, dgh)
    # What reaches the input differs in the candidate's part alone, which the reset gate does not scale.
    dgh[2] = dn.reshape(steps * lanes, HIDDEN)
    g["wx"] += np.matmul(embedded.T, dgh)
    for k in range(3):
        g["b"][k] += _sum(dgh[k])
    to_embedded = dgh[0] @ p["wx"][0].T
    for k in (1, 2):
        to_embedded += dgh[k] @ p["wx"][k].T
    order = np.argsort(flat_given.astype(np.int16), kind="stable")
    ranked = flat_given[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    g["emb"][ranked[first]] += np.add.reduceat(to_embedded.take(order, 0), first, axis=0)
    return states[-1], -float(np.log(shares).sum())


def train(theta: np.ndarray, texts: Iterable[np.ndarray], end_id: int) -> int:
    """Train the flat weights ``theta`` in place by Adam over whole texts of ids in lanes; returns the tokens seen.

    A lane takes the next text when its own ends; the state goes on from window to window within a text.
    A step rests on at least half a full window of tokens: when the last texts leave lanes empty,
    gradients of several windows are summed before it.
    """
    p, grad = shaped(theta), np.zeros_like(theta)
    g = shaped(grad)
    mean, square, step, seen, tokens_in = np.zeros_like(theta), np.zeros_like(theta), 0, 0, 0

    def update() -> None:
        nonlocal step, tokens_in, grad, mean, square, theta
        step += 1
        grad /= np.float32(tokens_in)
        grad *= np.float32(min(1.0, 1.0 / (float(np.sqrt(grad @ grad)) + 1e-9)))
        mean += np.float32(0.1) * (grad - mean)
        grad *= grad
        grad -= square
        square += np.float32(0.01) * grad
        np.sqrt(square, out=grad)
        grad *= np.float32((1 - 0.99**step) ** -0.5)
        grad += np.float32(1e-6)
        np.divide(mean, grad, out=grad)
        theta -= np.float32(RATE / (1 - 0.9**step)) * grad
        grad[:] = 0
        tokens_in = 0

    coming = (x for x in texts if len(x))
    held = list(islice(coming, LANES))
    at, h = [0] * len(held), np.zeros((len(held), HIDDEN), np.float32)
    last = np.full(len(held), end_id)
    while held:
        target = np.full((len(held), WINDOW), -1)
        for k, ids in enumerate(held):
            part = ids[at[k] : at[k] + WINDOW]
            target[k, : len(part)] = part
            at[k] += WINDOW
        target = np.ascontiguousarray(target.T)
        on = target >= 0
        clean = np.maximum(target, 0)
        # The state goes on, the gradient stops at the window.
        h, _ = gradients(p, np.concatenate([last[None], clean[:-1]]), clean, on, h, g)
        n, last = int(on.sum()), clean[-1]
        seen, tokens_in = seen + n, tokens_in + n
        if 2 * tokens_in >= WINDOW * LANES:
            update()
        over = []
        for k, ids in enumerate(held):
            if at[k] >= len(ids):
                new = next(coming, None)
                if new is None:
                    over.append(k)
                else:
                    held[k], at[k], h[k], last[k] = new, 0, 0, end_id
        for k in reversed(over):
            del held[k], at[k]
        if over:
            h, last = np.delete(h, over, 0), np.delete(last, over)
    if tokens_in:
        update()
    return seen


def document_scores(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, end_id: int) -> np.ndarray:
    """Natural log probability of each row's ids: rows in lanes, one after another, longest lanes first."""
    rows, sizes = len(first) - 1, np.diff(first)
    out = np.zeros(rows)
    lanes = min(SCORE_LANES, rows)
    load, held = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    by_size = np.argsort(-sizes, kind="stable")
    for turn, row in enumerate(by_size):
        # The first rows take a lane each; later ones the lightest lane, looked for once for each run of lanes.
        lane = turn if turn < lanes else int(load.argmin())
        held[lane].append(row)
        load[lane] += sizes[row]
    order = np.argsort(-load, kind="stable")
    load = load[order]
    sequence = [np.array(held[k]) for k in order]
    row_order = np.concatenate(sequence)
    lane_first = np.concatenate([[0], np.cumsum(load)])[:-1]
    n = sizes[row_order]
    begins = np.concatenate([[0], np.cumsum(n)])[:-1]
    source = np.repeat((first[:-1][row_order] - begins).astype(np.int32), n)
    source += np.arange(len(ids), dtype=np.int32)
    target, owner = ids[source], np.repeat(row_order.astype(np.int32), n)
    del source
    given = np.concatenate([[end_id], target[:-1]])
    given[begins] = end_id
    fresh = np.zeros(len(ids), bool)
    fresh[begins] = True
    table = np.ascontiguousarray((np.matmul(p["emb"], p["wx"]) + p["b"]).transpose(1, 0, 2)).reshape(VOCABULARY, 3 * HIDDEN)
    s, gates = (np.empty((2, lanes, HIDDEN), np.float32) for _ in range(2))
    ghn, cand = (np.empty((lanes, HIDDEN), np.float32) for _ in range(2))
    h = np.zeros((lanes, HIDDEN), np.float32)
    hs, at_token, held_rows = [], [], 0
    for t in range(int(load[0])):
        k = int(np.searchsorted(-load, -t, "left"))  # lanes longer than t
        here = lane_first[:k] + t
        h = h[:k]
        reset = fresh[here]
        if reset.any():
            h = np.where(reset[:, None], np.float32(0), h)
        gx, new = table.take(given.take(here), 0).reshape(k, 3, HIDDEN).transpose(1, 0, 2), np.empty((k, HIDDEN), np.float32)
        _step(gx, h, p["wh"], s[:, :k], gates[:, :k], ghn[:k], cand[:k], new)
        h = new
        hs.append(h)
        at_token.append(here)
        held_rows += k
        if held_rows >= SCORE_WINDOW * SCORE_LANES or t == load[0] - 1:
            where = np.concatenate(at_token)
            out += np.bincount(owner[where], log_probability(p, np.concatenate(hs), target[where]), rows)
            hs, at_token, held_rows = [], [], 0
    return out


def token_counts(docs: DataFrame) -> DataFrame:
    """(hash, form, c) over all tokens of a column ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            hashes, forms, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            return found, forms[where], np.bincount(back, counts).astype(np.int64)

        parts: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for _, _, data, at in textkit.slices(b.column(0)):
                hashes, forms, _ = tokens(data, at)
                parts.append(merged([(hashes, forms, np.ones(len(hashes), np.int64))]))
            if sum(len(x[0]) for x in parts) > 2_000_000:
                parts = [merged(parts)]
                if len(parts[0][0]) > 1_000_000:
                    yield _counted(parts[0])
                    parts = []
        if parts:
            yield _counted(merged(parts))

    return docs.select("_text").mapInArrow(run, "hash long, form int, n long").groupBy("hash").agg(F.min("form").alias("form"), F.sum("n").alias("c"))


def _counted(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["hash", "form", "n"])


def _averaged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of weight chunks, by tokens seen, in the replicas' order."""

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("replica")
        total = group["weight"].sum()
        value = sum((np.frombuffer(v, np.float32) * (w / total) for v, w in zip(group["value"], group["weight"], strict=True)), np.float32(0))
        return group.iloc[:1].assign(weight=total, value=[value.astype(np.float32).tobytes()])

    return rows.groupBy(*keys).applyInPandas(mean, rows.schema)


def _occurrence(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), ranked[1:] != ranked[:-1]]))
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    return out


ENCODED = "_key long, held_out boolean, copy long, n_tokens long, known long, base double, share double, tail array<long>, ids binary"


def encoded(slim: DataFrame, known) -> DataFrame:  # type: ignore[no-untyped-def]
    """From (_id, _key, held_out, _text): ENCODED, with a text's ids in 16 bits each, its base sum, its rare words' shares, and the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = known.value
        form = np.full(VOCABULARY, -1)
        form[lex.form_ids] = np.arange(FORMS)
        for b in batches:
            copies = _occurrence(b.column(1).to_numpy())
            for first, end, data, at in textkit.slices(b.column(3)):
                h, f, where = tokens(data, at)
                i, c, k = lex.look_up(h, f)
                size = np.diff(where)
                rows = np.repeat(np.arange(len(size), dtype=np.int32), size)
                logs = np.log10(c + 1.0)
                rare = np.flatnonzero(form[i] >= 0)
                share = np.bincount(rows[rare], logs[rare] - np.log10(lex.form_mass[form[i[rare]]]), len(size))
                tail = np.flatnonzero(~k & (h != END))
                split = np.searchsorted(rows[tail], np.arange(len(size) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(split), pa.array(h[tail].view(np.int64)))
                seen = np.bincount(rows, k & (c > 0), len(size)).astype(np.int64)
                ids = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((2 * where).astype(np.int32)), pa.py_buffer(i.astype(np.int16))])
                same = (b.column(x).slice(first, end - first) for x in (0, 1, 2))
                yield pa.RecordBatch.from_arrays([*same, pa.array(copies[first:end]), pa.array(size.astype(np.int64)), pa.array(seen), pa.array(np.bincount(rows, logs, len(size))), pa.array(share, pa.float64()), lists, ids], ["_id", *(x.split()[0] for x in ENCODED.split(", "))])

    return slim.select("_id", "_key", "held_out", "_text").mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, {ENCODED}")


def fitted(ids: DataFrame, n_tokens: int, lexicon: Lexicon, seed: int) -> dict[str, np.ndarray]:
    """The network's weights from the training rows of an :func:`encoded` table that hold ``n_tokens``."""
    context, end_id = ids.sparkSession.sparkContext, lexicon.end_id
    weights = first_weights(lexicon, seed)
    replicas = max(1, min(MOST_REPLICAS, -(-n_tokens // (ROUNDS * REPLICA_TOKENS))))
    deal = F.xxhash64("_key", "copy", F.lit(seed))
    rows = ids.filter("not held_out").select(deal.alias("deal"), (F.col("n_tokens") <= LONG_TEXT).alias("short"), "ids")
    rows = rows.withColumn("turn", F.pmod("deal", F.lit(ROUNDS))).withColumn("replica", F.pmod(F.shiftright("deal", 20), F.lit(replicas)).cast("int"))
    for turn in range(ROUNDS):
        start = context.broadcast(flat(weights))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            textkit.keep_heap()
            texts = ((r, x) for b in batches for r, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
            for replica, of in groupby(texts, key=lambda pair: pair[0]):
                theta = start.value.copy()
                seen = train(theta, (np.frombuffer(x.as_buffer(), np.int16) for _, x in of), end_id)
                cuts = range(0, len(theta), CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(list(range(len(cuts))), pa.int32()), pa.array([replica] * len(cuts), pa.int32()), pa.array([float(seen)] * len(cuts)), pa.array([theta[c : c + CHUNK].tobytes() for c in cuts], pa.binary())], ["chunk", "replica", "weight", "value"])

        dealt = rows.filter(F.col("turn") == turn).repartitionById(replicas, F.col("replica")).sortWithinPartitions("replica", "short", "deal")
        chunks = dealt.select("replica", "ids").mapInArrow(learn, "chunk int, replica int, weight double, value binary").withColumn("part", F.col("replica") % 64)
        got = sorted(_averaged(_averaged(chunks, ["chunk", "part"]), ["chunk"]).select("chunk", "value").collect())
        if got:
            weights = shaped(np.concatenate([np.frombuffer(r.value, np.float32) for r in got]))
    return weights


def score(docs: DataFrame, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    name = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    slim = docs.select(docs[id_col].alias("_id"), text.alias("_text"), (F.crc32(name) % 7 == 2).alias("held_out"), F.xxhash64(name, text).alias("_key"))
    counts = stage(token_counts(slim.filter("not held_out")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    forms = {r.form: (r.n, r.v) for r in counts.filter(F.col("hash") != int(END)).groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    # The head: all words above the least count for which they are no more than HEAD.
    above = counts.groupBy("c").count().withColumn("words", F.sum("count").over(W.orderBy(F.desc("c")))).filter(F.col("words") <= HEAD).agg(F.min("c")).first()[0]
    in_head = (F.col("c") >= (above or 2**62)) | (F.col("hash") == int(END))
    lexicon = make_lexicon(counts.filter(in_head).toArrow(), forms)
    context = docs.sparkSession.sparkContext
    ids = stage(encoded(slim, context.broadcast(lexicon)), "ids")
    model, end_id = context.broadcast(flat(fitted(ids, total.n, lexicon, seed))), lexicon.end_id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.keep_heap()
        p = shaped(model.value)
        for b in batches:
            for first, end in _runs(b.column("n_tokens").to_numpy()):
                part = b.slice(first, end - first)
                where = np.concatenate([[0], np.cumsum(part.column("n_tokens").to_numpy())])
                given = np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int16).astype(np.int64)
                lp = document_scores(p, given, where, end_id) / np.log(10) + part.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in kept), pa.array(lp)], [*kept, "lp"])

    kept = ["_id", "_key", "held_out", "n_tokens", "known", "base", "tail"]
    shape = ", ".join(f"{x} {ids.schema[x].dataType.simpleString()}" for x in kept) + ", lp double"
    scored = stage(ids.select(*kept, "share", "ids").mapInArrow(run, shape), "scored")
    drop_staged(ids)
    tail = scored.select("_key", F.explode("tail").alias("hash")).groupBy("_key", "hash").count()
    rare = counts.filter(~in_head).select("hash", "c")
    sums = tail.join(rare, "hash").groupBy("_key").agg(F.sum("count").alias("more"), F.sum(F.col("count") * F.log10(F.col("c") + 1.0)).alias("logs"))
    copies = scored.groupBy("_key").agg(F.count("*").alias("copies"))
    out = scored.drop("tail").join(sums.join(copies, "_key"), "_key", "left")
    more, logs = F.coalesce((F.col("more") / F.col("copies")).cast("long"), F.lit(0)), F.coalesce(F.col("logs") / F.col("copies"), F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(total.n + total.v + 1)))
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lp") + logs).alias("score"))


def _runs(sizes: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``limit`` tokens, or of one row, so that lanes stay full and memory bounded."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, "right")))
        yield first, end
        first = end

"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments. In each, one recurrent layer runs forwards and one
backwards; a softmax over both states labels every byte with a language, and the document's
probabilities are the mean over all of its bytes. The network is trained in numpy by backpropagation
through time. Training texts are cut whole into segments too, and a bounded sample of these (`SAMPLE`
for each language) is drawn from all places of all texts; what pads the last segment of a text has no part
in the loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import held_out, read_table

#: Segments of a language that the training sample holds.
SAMPLE = 1000
#: States in each direction, bytes in a training segment, segments in a step, steps, and learning rate.
HIDDEN, STEPS_BACK, BATCH, STEPS, RATE = 8, 64, 128, 400, 0.02
#: Bytes in a segment, segments run side by side, and bytes gathered from documents at once.
SEGMENT, ABREAST, GATHERED = 128, 1024, 4 << 20
PARTS, HELD = 4, 2
UNKNOWN = "und"

SCORED = StructType([StructField("at", IntegerType()), StructField("score", DoubleType())])
SPAN = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("lang", StringType())])


@dataclass(frozen=True)
class Network:
    """Per direction the input table (3H x 256) and recurrent weights (3H x H), rows for update, reset and candidate; output weights (C x 2H) and bias."""

    languages: tuple[str, ...]
    inputs: tuple[np.ndarray, np.ndarray]
    recurrent: tuple[np.ndarray, np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def _run(table: np.ndarray, recurrent: np.ndarray, data: np.ndarray, mask: np.ndarray | None, backwards: bool, keep: list | None = None) -> np.ndarray:
    """States (T x H x N) of one direction over bytes (T x N). `mask` (T x N) resets the state where it is 0. `keep` gets the gates."""
    h3, n = table.shape[0], data.shape[1]
    h = h3 // 3
    state, states = np.zeros((h, n), np.float32), np.empty((len(data), h, n), np.float32)
    for t in range(len(data) - 1, -1, -1) if backwards else range(len(data)):
        x, u = np.take(table, data[t], axis=1), recurrent @ state
        gates = x[: 2 * h] + u[: 2 * h]
        np.tanh(np.multiply(gates, 0.5, out=gates), out=gates)
        gates *= 0.5
        gates += 0.5
        new = np.tanh(x[2 * h :] + gates[h:] * u[2 * h :])
        if keep is not None:
            keep.append((t, state, gates, new, u[2 * h :]))
        state = new + gates[:h] * (state - new)
        if mask is not None:
            state = state * mask[t]
        states[t] = state
    return states


def probabilities(net: Network, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Probabilities (T x C x N) of every byte of data (T x N)."""
    both = np.concatenate([_run(net.inputs[d], net.recurrent[d], data, mask, bool(d)) for d in (0, 1)], axis=1)
    logits = np.matmul(net.output, both) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: Network, data: np.ndarray, labels: np.ndarray, mask: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of labels (N) at every position of data (T x N) that `mask` (T x N) has, and its gradients by backpropagation through time."""
    steps, n = data.shape
    h = net.recurrent[0].shape[1]
    kept: tuple[list, list] = ([], [])
    both = np.concatenate([_run(net.inputs[d], net.recurrent[d], data, mask, bool(d), kept[d]) for d in (0, 1)], axis=1)
    logits = np.matmul(net.output, both) + net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    here = np.ones((steps, n), p.dtype) if mask is None else mask
    total = here.sum()
    loss = float((-np.log(np.maximum(p[:, labels, np.arange(n)], 1e-12)) * here).sum() / total)
    p[:, labels, np.arange(n)] -= 1
    p *= here[:, None] / total
    output = np.einsum("tcn,thn->ch", p, both, optimize=True)
    down = np.matmul(net.output.T, p)
    grads = []
    for d in (0, 1):
        weights, carry = np.zeros_like(net.recurrent[d]), np.zeros((h, n), np.float32)
        down_to = np.empty((steps, 3 * h, n), np.float32)
        for t, before, gates, new, candidate in reversed(kept[d]):
            z, r = gates[:h], gates[h:]
            g = (down[t, d * h : (d + 1) * h] + carry) * here[t]
            dn = g * (1 - z) * (1 - new * new)
            dz, dr = g * (before - new) * z * (1 - z), dn * candidate * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r])
            weights += du @ before.T
            down_to[t] = np.concatenate([dz, dr, dn])
            carry = g * z + net.recurrent[d].T @ du
        # all bytes of a batch are summed by value at once
        places = (np.arange(3 * h) * 256)[None, :, None] + data[:, None, :]
        table = np.bincount(places.ravel(), weights=down_to.ravel(), minlength=3 * h * 256).reshape(3 * h, 256).astype(net.inputs[d].dtype)
        grads += [table, weights]
    return loss, [grads[0], grads[2], grads[1], grads[3], output, p.sum(axis=(0, 2))]


def fit(windows: list[bytes], labels: list[int], languages: tuple[str, ...], seed: int = 7) -> Network:
    """A network trained by Adam on segments of up to STEPS_BACK bytes; the order of the segments and the seed fix the result."""
    rng, h, c = np.random.default_rng(seed), HIDDEN, len(languages)
    data = np.array([list(w.ljust(STEPS_BACK, b"\0")) for w in windows], dtype=np.int64)
    lengths = np.array([len(w) for w in windows])
    y = np.array(labels)
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    values = [draw(3 * h, 256, s=0.3), draw(3 * h, 256, s=0.3), draw(3 * h, h, s=0.3), draw(3 * h, h, s=0.3), draw(c, 2 * h, s=0.3), np.zeros(c, np.float32)]
    m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    shares = np.bincount(y, minlength=c)
    weights = 1.0 / shares[y]
    weights /= weights.sum()
    build = lambda: Network(languages, (values[0], values[1]), (values[2], values[3]), values[4], values[5])
    for step in range(1, STEPS + 1):
        chosen = rng.choice(len(data), size=min(BATCH, len(data)), p=weights)
        mask = (np.arange(STEPS_BACK)[:, None] < lengths[chosen]).astype(np.float32)
        _, grads = gradients(build(), data[chosen].T, y[chosen], mask)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for x, g, a, b in zip(values, grads, m, v, strict=True):
            g = g * min(1.0, 1.0 / max(size, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return build()


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> list:
    """(lang, segment) of up to `sample` segments of each language, from documents that are not held out.

    The whole text of every such document is cut into segments of STEPS_BACK bytes, and all segments of a
    language are equally likely to be drawn, by a hash of the id and the place. Of rows that repeat an id in
    one language the one with the smallest hash of its text counts, before anything is collected.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id", PARTS, HELD) & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", F.col("text").cast("binary").alias("_bytes")
    )
    parts = F.ceil(F.octet_length("_bytes") / STEPS_BACK)
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(parts).alias("n")).collect()}
    if not counts:
        return []
    rates = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * sample / n)))])
    drawn = lambda i: F.pmod(F.xxhash64("doc_id", i, F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    places = F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda i: drawn(i) < F.col("_rate"))
    picked = rows.select("doc_id", "lang", "_bytes", parts.cast("int").alias("_parts"), F.element_at(rates, F.col("lang")).alias("_rate")).select(
        "doc_id", "lang", "_bytes", places.alias("_places")
    )
    segment = lambda i: F.struct(drawn(i).alias("drawn"), F.substring(F.col("_bytes"), i * STEPS_BACK + 1, F.lit(STEPS_BACK)).alias("segment"))
    found = picked.where(F.size("_places") > 0).select("doc_id", "lang", F.struct(F.xxhash64("_bytes"), F.transform("_places", segment).alias("segments")).alias("_one"))
    one = found.groupBy("lang", "doc_id").agg(F.min("_one").alias("_one")).select("lang", F.explode("_one.segments").alias("_s")).select("lang", "_s.*")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "segment"))
    chosen = one.withColumn("_nth", nth).where(F.col("_nth") <= sample).orderBy("lang", "_nth").collect()
    return [(r.lang, bytes(r.segment)) for r in chosen]


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network over the languages of the training documents; none without any."""
    rows = training_windows(docs, sample)
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return None
    return fit([w for _, w in rows], [languages.index(lang) for lang, _ in rows], languages)


def _segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each segment, bytes T x N, mask T x N) for some segments at a time; no segment holds two documents."""
    counts = [-(-len(t) // SEGMENT) for t in texts]
    data = np.frombuffer(b"".join(t.ljust(c * SEGMENT, b"\0") for t, c in zip(texts, counts, strict=True)), dtype=np.uint8).reshape(-1, SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts)[owner] - 1 == np.arange(len(owner)) if len(owner) else np.zeros(0, bool)
    rest = np.array([len(t) - (c - 1) * SEGMENT for t, c in zip(texts, counts, strict=True)])
    length = np.where(last, rest[owner], SEGMENT) if len(owner) else np.zeros(0, int)
    for a in range(0, len(data), ABREAST):
        b = a + ABREAST
        yield owner[a:b], np.ascontiguousarray(data[a:b].T).astype(np.intp), (np.arange(SEGMENT)[:, None] < length[None, a:b]).astype(np.float32)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of some megabytes in all, with the place of the first; a long document comes alone."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        if held and size + len(t) > GATHERED:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of all bytes of each text; zeros for an empty one."""
    out = np.zeros((len(texts), len(net.languages)))
    for first, group in _groups(texts):
        for owner, data, mask in _segments(group):
            p = np.einsum("tcn,tn->nc", probabilities(net, data, mask if mask.min() == 0 else None), mask, optimize=True)
            np.add.at(out, owner + first, p)
    return out / np.maximum([[len(t)] for t in texts], 1) if texts else out


def identified(net: Network, text: str = "text") -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = pooled(net, [(t or "").encode("utf-8", "replace") for t in batch])
            yield pd.DataFrame({"at": p.argmax(axis=1).astype(np.int32) if len(p) else [], "score": p.max(axis=1) if len(p) else []})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, SCORED)(text)


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    A null text, an empty one, or one without a letter is `und` with score 0, as is every text when no
    document has a language to learn. Of languages with the same probability the first by code point is
    taken. Long texts are read whole, a group of segments at a time. A null doc_id counts as held out.
    Repeated rows are scored each; other columns, whatever their names, are not looked at. No rows give none.
    """
    net = net or train(docs)
    held = held_out("doc_id", PARTS, HELD).alias("held_out")
    if net is None:
        return docs.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    names = F.array(*map(F.lit, net.languages))
    rows = docs.select("doc_id", held, letters.alias("_letters"), identified(net).alias("_found"))
    return rows.select(
        "doc_id", "held_out", F.when(F.col("_letters"), F.get(names, F.col("_found.at"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("_letters"), F.least(F.col("_found.score"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def spans(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and the runs of equally labelled bytes of its text: start, stop (bytes), lang. A null or empty text has none; long texts are read whole; repeated rows and ids give theirs each. Other columns, whatever their names, are not looked at. No rows give none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                labels = [probabilities(net, data, mask).argmax(axis=1).T[mask.T > 0] for _, data, mask in _segments([(text or "").encode("utf-8", "replace")])]
                flat = np.concatenate(labels) if labels else np.zeros(0, int)
                cuts = np.flatnonzero(np.diff(flat)) + 1
                edges = [0, *cuts.tolist(), len(flat)] if len(flat) else []
                out.append([{"start": a, "stop": b, "lang": net.languages[flat[a]]} for a, b in zip(edges, edges[1:], strict=False)])
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select("doc_id", F.explode(F.pandas_udf(run, ArrayType(SPAN))("text")).alias("_span")).select("doc_id", "_span.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))

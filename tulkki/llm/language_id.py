"""Language identification by a byte convolutional network.

Bytes are embedded, convolved with filters two, three and four bytes wide,
max-pooled over a window of fixed length and classified by softmax.  The
network is trained in numpy on a bounded sample of labelled documents;
its weights take some kilobytes, whatever the corpus.  Whole texts are cut
into windows, all windows are scored in batches inside Spark tasks, and a
document takes the language with the highest mean score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tulkki.llm.words import pieces

WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


@dataclass
class Network:
    langs: list[str]
    window: int
    embed: np.ndarray   # 256 x dim; byte 0 pads and is held at zero
    filters: np.ndarray  # (max width x dim) x filters, zero outside a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Response of each filter at each place, and the embedded bytes there."""
        n, length = windows.shape
        width, dim = max(WIDTHS), self.embed.shape[1]
        x = self.embed[windows].reshape(n, length * dim)
        patches = np.lib.stride_tricks.sliding_window_view(x, width * dim, axis=1)[:, ::dim]
        flat = np.ascontiguousarray(patches).reshape(-1, width * dim)
        response = (flat @ self.filters).reshape(n, length - width + 1, -1)
        return response, flat

    def lookup(self) -> Lookup:
        return Lookup(self)


class Lookup:
    """The same network for prediction: the response of the filters to four
    bytes is the sum of two rows, one for each pair of bytes."""

    def __init__(self, net: Network):
        dim, pairs = net.embed.shape[1], []
        each = [net.embed @ net.filters[i * dim:(i + 1) * dim] for i in range(max(WIDTHS))]
        for first, second in (each[:2], each[2:]):
            pairs.append((first[:, None] + second[None]).reshape(1 << 16, -1))
        self.ahead, self.behind = pairs
        self.net = net

    def logits(self, windows: np.ndarray) -> np.ndarray:
        codes = np.ascontiguousarray(windows.T).astype(np.int32)
        pairs = codes[:-1] * 256 + codes[1:]
        best = np.full((windows.shape[0], self.ahead.shape[1]), -np.inf, np.float32)
        one, two = np.empty_like(best), np.empty_like(best)
        for i in range(len(codes) - max(WIDTHS) + 1):
            np.take(self.ahead, pairs[i], axis=0, out=one, mode="clip")
            np.take(self.behind, pairs[i + 2], axis=0, out=two, mode="clip")
            one += two
            np.maximum(best, one, out=best)
        return np.maximum(best + self.net.bias, 0) @ self.net.out + self.net.out_bias


def cut(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some texts, the last of a text padded with zeros, and each one's row."""
    lengths = np.diff(offsets)
    counts = -(-lengths // window)
    row = np.repeat(np.arange(len(lengths)), counts)
    first = (offsets[:-1] - offsets[0])[row]
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first + nth * window
    stop = np.minimum(at + window, first + lengths[row])
    padded = np.concatenate([data, np.zeros(window, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, window)[at]
    out[np.arange(window) >= (stop - at)[:, None]] = 0
    return out, row


def train(texts: list[str], langs: list[str], window: int, filters: int, dim: int, epochs: int, seed: int) -> Network:
    """Adam on the cross-entropy of single windows; deterministic for a seed."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    windows, row = cut(np.frombuffer(b"".join(raw), np.uint8), offsets, window)
    target = np.array([names.index(x) for x in langs], np.int64)[row]
    enough = (windows > 0).sum(axis=1) >= min(16, window)
    if enough.any():
        windows, target = windows[enough], target[enough]
    width, total = max(WIDTHS), filters * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(width * dim) < w * dim)[:, None], filters, axis=1) for w in WIDTHS], axis=1)
    net = Network(names, window, rng.normal(0, 0.5, (256, dim)).astype(np.float32),
                  (rng.normal(0, 1, (width * dim, total)) / np.sqrt(width * dim) * mask).astype(np.float32),
                  np.zeros(total, np.float32), (rng.normal(0, 1, (total, len(names))) / np.sqrt(total)).astype(np.float32),
                  np.zeros(len(names), np.float32))
    net.embed[0] = 0
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            some = order[lo:lo + 64]
            x, y = windows[some], target[some]
            response, flat = net.responses(x)
            best = response.argmax(axis=1)
            z = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(z, 0)
            logits = hidden @ net.out + net.out_bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(y)), y] -= 1
            prob /= len(y)
            back = (prob @ net.out.T) * (z > 0)
            places = flat.reshape(len(y), -1, width * dim)[np.arange(len(y))[:, None], best]
            d_filters = np.einsum("nfd,nf->df", places, back) * mask
            d_places = (back[:, :, None] * net.filters.T[None]).reshape(-1, width, dim)
            at = best[:, :, None] + np.arange(width)
            touched = x[np.arange(len(y))[:, None, None], at].ravel()
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, touched, d_places.reshape(-1, dim))
            d_embed[0] = 0
            step += 1
            grads = [d_embed, d_filters, back.sum(axis=0), hidden.T @ prob, prob.sum(axis=0)]
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (0.003 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def training_sample(docs: DataFrame, per_lang: int, chars: int, seed: int, most_rows: int = 60_000) -> list[tuple[str, str]]:
    """(lang, text) in order: for each language ``per_lang`` documents at most
    (``most_rows`` in all), the smallest by a hash of doc_id, and of each
    ``chars`` characters from a place drawn by the same hash.

    The counts of the languages give each a hash threshold that about twice
    as many pass.  The thresholds are literals in the scan, so that no text
    but the sample's leaves its task, whatever the size of a language."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    place = F.expr(f"CAST(1 + pmod(xxhash64({seed + 1}, doc_id), greatest(1, char_length(text) - {chars} + 1)) AS int)")
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    # languages beyond one for every hundred rows of the sample, the rarest, aren't learned
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max(1, most_rows // 100)).collect()
    if not counts:
        return []
    each, parts = min(per_lang, max(1, most_rows // len(counts))), 1 << 30
    # a language with few documents passes whole
    limits = {r["lang"]: parts if r["n"] <= 4 * each else 2 * each * parts // r["n"] for r in counts}
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("lang"))
    rows = (usable.where(F.pmod(order, F.lit(parts)) < limit)
            .select("lang", order.alias("h"), F.substr("text", place, F.lit(chars)).alias("text")).collect())
    rows.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    taken: dict[str, int] = {}
    out = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            out.append((r["lang"], r["text"]))
    return out


def fit(docs: DataFrame, per_lang: int = 1500, chars: int = 512, window: int = 256, filters: int = 12, dim: int = 8,
        epochs: int = 4, seed: int = 7) -> Network | None:
    """Train on a bounded sample (``per_lang`` x ``chars`` characters a language); None without labelled text."""
    sample = [(lang, text) for lang, text in training_sample(docs, per_lang, chars, seed) if text]
    if not sample:
        return None
    return train([text for _, text in sample], [lang for lang, _ in sample], window, filters, dim, epochs, seed)


def _predict(net: Network, keys: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = np.array(net.langs, dtype=object), net.lookup()
        for batch in batches:
            names, scores = [], []
            for lo, hi, data, offsets in pieces(batch.column("text"), 1 << 18):
                windows, row = cut(data, offsets.astype(np.int64), net.window)
                sums = np.zeros((hi - lo, len(langs)))
                for at in range(0, len(windows), 1024):
                    np.add.at(sums, row[at:at + 1024], table.logits(windows[at:at + 1024]))
                mean = sums / np.maximum(np.bincount(row, minlength=hi - lo), 1)[:, None]
                prob = np.exp(mean - mean.max(axis=1, keepdims=True))
                prob /= prob.sum(axis=1, keepdims=True)
                names.append(langs[prob.argmax(axis=1)])
                scores.append(prob.max(axis=1))
            known = batch.column("letters").to_numpy(zero_copy_only=False)
            name = np.where(known, np.concatenate(names), UNDETERMINED) if names else []
            score = np.where(known, np.concatenate(scores), 0.0) if names else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(name, pa.string()), pa.array(score, pa.float64())],
                                             names=[*keys, "lang_pred", "score"])
    return task


def held_out_fold(doc_id: str = "doc_id") -> Column:
    """True for the documents that no model learns from; also where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, net: Network | None, keys: list[str]) -> DataFrame:
    """``keys`` with lang_pred and score for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or where
    there is no network.  Rows are independent of each other: repeated rows
    and null keys get a row each, an empty table gives an empty result, and
    columns beside ``keys`` (text may be one of them) are left out.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(*keys, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*dict.fromkeys([*keys, "text"]), letters.alias("letters"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(_predict(net, keys), f"{kinds}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out_fold().alias("held_out"))
    return identify(docs, fit(docs.where("NOT held_out")), ["doc_id", "held_out"])

"""Languages of documents and of the segments of mixed documents.

A byte convolutional network is trained in numpy: byte embeddings, filters of
several widths, max pooling over a window of fixed length and a softmax.  It is
fitted on sentences of known language (at most ``SEEDS_PER_LANGUAGE``) and on a
bounded sample of labelled documents (``DOCS_PER_LANGUAGE``), ``CUTS_PER_LANGUAGE``
windows of each language.  As labels may be wrong, windows whose label the first
fit contradicts are left out of the second.

Every sentence and line of every document is cut into windows, which tasks classify
in batches; a sentence's language has the highest mean log probability over its
windows.  A document's language is that of most of its characters; documents with
whole sentences in several languages get a segment for each longest run of
sentences in one language.

Defined results: documents without letters, empty and null ones give no rows and
train nothing; lines that are no sentences count for the document's language, not
for segments; repeated rows are classified each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import spread

LANGUAGES = ("zh", "en", "ja", "ko", "de", "fr", "es", "pt", "ru")
WINDOW = 64
DOCS_PER_LANGUAGE = 400
SEEDS_PER_LANGUAGE = 200
CUTS_PER_LANGUAGE = 1600
_WIDTHS = (2, 3, 4, 5)
_FILTERS = 16
_EMBED = 8
_BATCH = 2048

# Labels in front of text, which belong to no language.
_LABEL = re.compile(r"^\s*(?:#+\s*[\d.]*\s*|(?:title|abstract|keywords?|summary|标题|题名|摘要|关键词|関鍵詞)\s*[:：]\s*)", re.I)
_SPLIT = re.compile(r"(?<=[。！？｡])(?![”」』）])|(?<=[。！？｡][”」』）])|(?<=[.!?])\s+|(?<=[.!?][”\"'»)])\s+|\n+")
_ENDS = re.compile(r"[。！？｡.!?…][”\"'’」』）)\]»\s]*$")


class ByteConvNet:
    """Multi-width byte convolutions, max pooling and a softmax."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, _EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * _EMBED)) ** 0.5, (w * _EMBED, _FILTERS)).astype(np.float32) for w in _WIDTHS]
        self.bias = [np.zeros(_FILTERS, np.float32) for _ in _WIDTHS]
        self.dense = rng.normal(0, 0.1, (len(_WIDTHS) * _FILTERS, len(LANGUAGES))).astype(np.float32)
        self.offset = np.zeros(len(LANGUAGES), np.float32)

    def _pooled(self, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        x = self.embed[windows].reshape(len(windows), -1)
        pooled, caches = [], []
        for w, filters, bias in zip(_WIDTHS, self.filters, self.bias):
            view = np.lib.stride_tricks.sliding_window_view(x, w * _EMBED, axis=1)[:, ::_EMBED]
            scores = view.reshape(-1, w * _EMBED) @ filters
            scores = scores.reshape(len(windows), WINDOW - w + 1, _FILTERS)
            if keep:
                at = scores.argmax(axis=1)
                caches.append((view, at))
            pooled.append(np.maximum(scores.max(axis=1) + bias, 0))
        return np.concatenate(pooled, axis=1), caches

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self._pooled(windows[i : i + _BATCH])[0] for i in range(0, len(windows), _BATCH)]) @ self.dense + self.offset
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int, seed: int = 11, rate: float = 0.004) -> None:
        """Adam on the cross entropy, its steps shrinking to nothing."""
        params = [self.embed, *self.filters, *self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, step, steps = np.random.default_rng(seed), 0, epochs * -(-len(windows) // 128)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), 128):
                batch = windows[order[i : i + 128]]
                truth = labels[order[i : i + 128]]
                h, caches = self._pooled(batch, keep=True)
                logits = h @ self.dense + self.offset
                logits -= logits.max(axis=1, keepdims=True)
                p = np.exp(logits)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(truth)), truth] -= 1
                p /= len(truth)
                d_h = (p @ self.dense.T) * (h > 0)
                d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
                for k, (w, (view, at)) in enumerate(zip(_WIDTHS, caches)):
                    d = d_h[:, k * _FILTERS : (k + 1) * _FILTERS]
                    rows = np.arange(len(batch))[:, None]
                    picked = view[rows, at]  # the place in the window that each filter chose
                    d_filters.append(np.einsum("bf,bfd->df", d, picked))
                    d_bias.append(d.sum(axis=0))
                    back = (d[:, :, None] * self.filters[k].T[None]).reshape(len(batch), _FILTERS, w, _EMBED)
                    ids = batch[rows[:, :, None], at[:, :, None] + np.arange(w)]
                    np.add.at(d_embed, ids.ravel(), back.reshape(-1, _EMBED))
                grads = [d_embed, *d_filters, *d_bias, h.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def windows_of(text: str) -> np.ndarray:
    """The text's bytes in windows of fixed length; the last one ends with the text, a short text is padded."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if len(raw) <= WINDOW:
        out = np.full((1, WINDOW), 32, dtype=np.uint8)
        out[0, : len(raw)] = raw
        return out
    starts = np.append(np.arange(0, len(raw) - WINDOW, WINDOW), len(raw) - WINDOW)
    return raw[starts[:, None] + np.arange(WINDOW)]


def plain_code(label: Column) -> Column:
    """The two-letter code of a label in any notation, or null."""
    code = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(code.isin(*LANGUAGES), code)


def _cuts(rows: DataFrame, per_language: int, cuts: int) -> dict[str, list[str]]:
    """``cuts`` stretches of at most ``WINDOW`` characters for each language, from anywhere in the texts of at most
    ``per_language`` rows ``(key, code, text)``, those first by hash; rows without a letter count for nothing."""
    usable = rows.filter(F.col("code").isin(*LANGUAGES) & F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.xxhash64("key"), "key"))
    chosen = usable.select("key", "code").withColumn("r", rank).filter(F.col("r") <= per_language)
    chosen = chosen.withColumn("n", F.count("*").over(Window.partitionBy("code")))
    start = F.pmod(F.xxhash64("key", "r", "i"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    found = (
        usable.join(F.broadcast(chosen), ["key", "code"])
        .select("code", "r", "key", "text", "n", F.explode(F.sequence(F.lit(0), F.floor((cuts - 1) / F.col("n")))).alias("i"))
        .select("code", "r", "i", F.col("text").substr(start, F.lit(WINDOW)).alias("part")).collect()
    )
    parts: dict[str, list[str]] = {}
    for row in sorted(found, key=lambda row: (row["i"], row["r"], row["part"])):
        parts.setdefault(row["code"], []).append(row["part"])
    return {code: texts[:cuts] for code, texts in parts.items()}


def training_windows(documents: DataFrame, seeds: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, seeds_per_language: int = SEEDS_PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, their languages, and which come from the seeds.

    Every language gets the same number of stretches (``CUTS_PER_LANGUAGE``), a
    quarter of them from the seeds.  Each is used as it is, cut short, and with a
    term from elsewhere put in, as short lines and foreign terms occur in documents too."""
    rng = np.random.default_rng(5)
    known = _cuts(seeds.select(F.col("seed_no").alias("key"), F.col("lang").alias("code"), "text"), seeds_per_language, CUTS_PER_LANGUAGE)
    labelled = _cuts(documents.select(F.col("doc_id").alias("key"), plain_code(F.col("lang")).alias("code"), "text"), docs_per_language, CUTS_PER_LANGUAGE)
    parts = []
    for code in LANGUAGES:
        own = labelled.get(code, [])
        share = CUTS_PER_LANGUAGE // 4 if own else CUTS_PER_LANGUAGE
        parts += [(code, text, True) for text in known.get(code, [])[:share]]
        parts += [(code, text, False) for text in own[: CUTS_PER_LANGUAGE - share if code in known else CUTS_PER_LANGUAGE]]
    cuts, labels, sure = [], [], []
    for code, part, seed in parts:
        n = int(rng.integers(4, 24))
        at = int(rng.integers(0, max(1, len(part) - n)))
        short = part[at : at + n]
        _, foreign, _ = parts[int(rng.integers(len(parts)))]
        away = int(rng.integers(0, max(1, len(foreign) - n)))
        term = foreign[away : away + 32].encode("utf-8", "replace")[: len(part[at : at + 2 * n].encode("utf-8", "replace"))].decode("utf-8", "ignore")
        for text in (part, short, f"{short} {term} {part[at + n : at + 2 * n]}"):
            if any(ch.isalpha() for ch in text):
                windows = windows_of(text)
                cuts.append(windows[int(rng.integers(len(windows)))])
                labels.append(LANGUAGES.index(code))
                sure.append(seed)
    if not cuts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), np.zeros(0, bool)
    return np.stack(cuts), np.array(labels), np.array(sure)


def train(documents: DataFrame, seeds: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, seeds_per_language: int = SEEDS_PER_LANGUAGE) -> ByteConvNet:
    """The network, fitted twice: on all sampled windows, then without those it contradicts."""
    windows, labels, sure = training_windows(documents, seeds, docs_per_language, seeds_per_language)
    net = ByteConvNet()
    if len(windows):
        net.fit(windows, labels, epochs=2)
        agreed = sure | (net.log_probabilities(windows)[np.arange(len(labels)), labels] > np.log(0.3))
        net = ByteConvNet()
        net.fit(windows[agreed], labels[agreed], epochs=5)
    return net


def _pieces(text: str) -> list[tuple[str, bool]]:
    """Sentences and lines without labels, and whether each is a whole sentence."""
    out = []
    for piece in _SPLIT.split(text):
        piece = _LABEL.sub("", piece).strip()
        letters = sum(map(str.isalpha, piece))
        if letters:
            # two words, or four characters of a script without spaces
            worded = letters >= 4 and (len(piece.split()) > 1 or sum(ch >= "\u3040" and ch.isalpha() for ch in piece) >= 4)
            out.append((piece, worded and bool(_ENDS.search(piece))))
    return out


_FOUND = "doc_id bigint, label string, seg_no int, lang string, confidence double, chars bigint"


def _document_rows(doc_id: int, label: str | None, pieces: list[tuple[str, bool]], scores: np.ndarray) -> list[tuple]:
    """A row for the document and, if it is mixed, one for each segment."""
    chars = np.zeros(len(LANGUAGES))
    trust = np.zeros(len(LANGUAGES))
    runs: list[list] = []
    for (piece, whole), score in zip(pieces, scores):
        best = int(score.argmax())
        confidence = float(np.exp(score[best]) / np.exp(score).sum())
        chars[best] += len(piece)
        trust[best] += len(piece) * confidence
        if whole:
            if runs and runs[-1][0] == best:
                runs[-1][1] += len(piece)
                runs[-1][2] += len(piece) * confidence
            else:
                runs.append([best, len(piece), len(piece) * confidence])
    main = int(chars.argmax())
    rows = [(doc_id, label, 0, LANGUAGES[main], float(trust[main] / chars[main] * chars[main] / chars.sum()), int(chars.sum()))]
    if len({r[0] for r in runs}) > 1:
        rows += [(doc_id, label, i + 1, LANGUAGES[b], t / n, n) for i, (b, n, t) in enumerate(runs)]
    return rows


def _classify(net: ByteConvNet):
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, str | None, list]] = []
        windows: list[np.ndarray] = []
        counts: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting, windows, counts, held
            if not counts:
                return
            stacked = np.concatenate(windows)
            logs = net.log_probabilities(stacked)
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            means = np.add.reduceat(logs, starts, axis=0) / np.array(counts)[:, None]
            rows, at = [], 0
            for doc_id, label, pieces in waiting:
                rows += _document_rows(doc_id, label, pieces, means[at : at + len(pieces)])
                at += len(pieces)
            waiting, windows, counts, held = [], [], [], 0
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=["doc_id", "label", "seg_no", "lang", "confidence", "chars"])

        for batch in batches:
            for doc_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
                pieces = _pieces(text) if text else []
                if not pieces:
                    continue
                waiting.append((doc_id, label, pieces))
                for piece, _ in pieces:
                    cut = windows_of(piece)
                    windows.append(cut)
                    counts.append(len(cut))
                    held += len(cut)
                if held >= 4 * _BATCH:
                    yield from flush()
        yield from flush()

    return classify


def languages(documents: DataFrame, net: ByteConvNet) -> DataFrame:
    """``(doc_id, label, seg_no, lang, confidence, chars)``: 0 for the document, 1, 2, ... for the segments of mixed ones.

    ``label`` is the code the document's own label stands for, null if it is none."""
    texts = documents.select("doc_id", plain_code(F.col("lang")).alias("label"), "text")
    return spread(texts).mapInArrow(_classify(net), _FOUND)

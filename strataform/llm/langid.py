"""Language of each document and of each segment in another language, with a confidence.

A byte convolutional network: byte embeddings, filters of several widths, max pooling and softmax, trained in
numpy on sentences of labelled documents (a bounded sample), applied in batches to fixed-length windows that lie end
to end over every sentence. A sentence's language is that of its windows together; neighbouring sentences of a
language form a segment. Labels are noisy, so the network is trained twice: the second time without the sentences
whose label the first one confidently contradicts. Confidences are calibrated: one temperature, fitted on sentences
held out from training.

Scale: one scan of the label column counts the labels, one scan of the texts draws the sample (windows of sentences
from anywhere in a text, drawn in the executors), one narrow scan reads all texts. Nothing else is shuffled but the
rows found.

Cases: null, empty, blank texts and texts without a whole sentence have no segment; headings, single terms and
stray symbols belong to no segment; repeated documents are each reported; very long texts are read whole; ties
between languages go to the first in alphabetical order; without labelled documents there is no model and the
result is empty.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.session import ship

LANGS = ("de", "en", "es", "fr", "pt")
# Spellings of a language label (codes and names); a region after '-' or '_' is ignored.
LABELS = {
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "alemão"],
    "en": ["en", "eng", "english", "englisch", "anglais", "inglés", "inglês"],
    "es": ["es", "spa", "esp", "spanish", "spanisch", "español", "espanol", "castellano", "espagnol", "espanhol"],
    "fr": ["fr", "fra", "fre", "french", "französisch", "français", "francais", "francés", "francês"],
    "pt": ["pt", "por", "ptg", "portuguese", "portugiesisch", "português", "portugues", "portugais", "portugués"],
}
WINDOW, TAIL = 64, 16  # bytes of a window; a rest of fewer than TAIL bytes is left to the window before
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+(?=[^a-zà-ÿ\s.,;:)])")
_ENDED = re.compile(r"(?s).*[.!?…][\"'»”)\]]*(?=\s|$|\d{8})")
#: What stands in brackets or quotes within a sentence and is none itself: a term, however long.
_ASIDE = re.compile(r"\([^().!?]*\)|[“„«\"][^“”„«»\".!?]*[”“»\"]")
_WORDS = re.compile(r"[^\W\d_]{2,}")


def one_thread() -> None:
    """Keep numpy's matrix products to one thread: the tasks are the parallelism, and waiting threads cost as much
    as working ones. Without effect where numpy brings no OpenBLAS of its own."""
    for path in (Path(np.__file__).parents[1] / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                return


def label(c: Column) -> Column:
    """The language a label names, if it is one of LANGS; null for missing, unknown and other ones."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(base.isin(names), lang).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(from, to) of the whole sentences: ended by a mark, four words or more; a sentence may run over single line
    breaks, not over blank lines."""
    out = []
    at = 0
    for block in re.split(r"(\n\s*\n)", text):
        start = 0
        for m in [*_SENTENCE.finditer(block), None]:
            end = m.start() if m else len(block)
            piece = block[start:end]
            # headings stand on lines of their own before the sentence
            offset = start
            lines = piece.split("\n")
            while len(lines) > 1 and (len(_WORDS.findall(lines[0])) < 4 or _heading(lines[0], lines[1])):
                offset += len(lines[0]) + 1
                lines.pop(0)
            s = "\n".join(lines)
            whole = _ENDED.match(s)  # what follows the last end mark is no part of a whole sentence
            if whole and len(_WORDS.findall(whole[0])) >= 4:
                out.append((at + offset, at + offset + whole.end()))
            start = m.end() if m else end
        at += len(block)
    return out


def _heading(line: str, after: str) -> bool:
    """A line without an end mark, before a line that starts anew."""
    return not re.search(r"[.!?,;:…\-]\s*$", line) and (line.isupper() or bool(re.match(r"\s*\d+(\.\d+)*\.?\s+\S", line)) and len(line) < 80) and bool(re.match(r"\s*[^a-zà-ÿ\s]", after))


def windows(s: str) -> np.ndarray:
    """Rows of WINDOW bytes (0 pads) that cover the sentence, in lower case, without asides in brackets or quotes
    (single foreign terms); digits become one byte, as they say nothing."""
    b = np.frombuffer(re.sub(r"\d+", "0", _ASIDE.sub("", s).replace("\n", " ").lower()).encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, (len(b) + WINDOW - TAIL) // WINDOW)
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(b)] = b[: len(out)]
    return out.reshape(n, WINDOW)


class ByteNet:
    """Byte embedding, filters of several widths (one matrix of the greatest width, whose narrower filters end in
    zeros), max over positions, softmax. scale: inverse temperature of a sentence's confidence."""

    WIDTHS = (2, 3, 4, 5)

    def __init__(self, embed: int = 8, filters: int = 24, classes: int = len(LANGS), seed: int = 7):
        r = np.random.default_rng(seed)
        wide = max(self.WIDTHS) * embed
        self.mask = np.concatenate([np.repeat((np.arange(wide) < k * embed)[:, None], filters, 1) for k in self.WIDTHS], 1).astype(np.float32)
        w = np.concatenate([r.normal(0, (k * embed) ** -0.5, (wide, filters)) for k in self.WIDTHS], 1)
        n = filters * len(self.WIDTHS)
        self.p = {"E": r.normal(0, 0.3, (256, embed)), "W": w * self.mask, "b": np.zeros(n), "O": r.normal(0, 0.1, (n, classes)), "o": np.zeros(classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale = 1.0

    def _columns(self, b: np.ndarray) -> np.ndarray:
        """Rows of the bytes' embeddings at and after each position, as wide as the widest filter."""
        wide = max(self.WIDTHS)
        x = self.p["E"][np.pad(b, ((0, 0), (0, wide - 1)))]
        n, _, e = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, b.shape[1], wide * e), (s[0], s[1], s[2]), writeable=False).reshape(-1, wide * e)

    def forward(self, b: np.ndarray, keep: bool = False) -> tuple:
        cols = self._columns(b)
        h = (cols @ self.p["W"]).reshape(len(b), b.shape[1], -1)
        f = np.maximum(h.max(1) + self.p["b"], 0)
        z = f @ self.p["O"] + self.p["o"]
        z -= z.max(1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        return (logp, f, h.argmax(1), cols) if keep else (logp,)

    def gradients(self, b: np.ndarray, y: np.ndarray, rng: np.random.Generator, drop: float = 0.3, smooth: float = 0.1) -> dict[str, np.ndarray]:
        """Cross entropy with smoothed labels, a share of the pooled features dropped: labels are noisy and samples
        small, and the network must not be sure of text unlike any it has seen."""
        _, f, where, cols = self.forward(b, True)
        n, length = b.shape
        kept = ((rng.random(f.shape) >= drop) / (1 - drop)).astype(np.float32)
        f = f * kept
        z = f @ self.p["O"] + self.p["o"]
        d = np.exp(z - z.max(1, keepdims=True))
        d /= d.sum(1, keepdims=True)
        d -= smooth / d.shape[1]
        d[np.arange(n), y] -= 1 - smooth
        d /= n
        g = {"O": f.T @ d, "o": d.sum(0)}
        df = (d @ self.p["O"].T) * (f > 0) * kept
        won = cols.reshape(n, length, -1)[np.arange(n)[:, None], where]  # n, filters, columns: only the positions that won
        g["b"] = df.sum(0)
        g["W"] = np.einsum("nmc,nm->cm", won, df) * self.mask
        back = df[:, :, None] * self.p["W"].T[None]
        wide, e = max(self.WIDTHS), self.p["E"].shape[1]
        padded = np.pad(b, ((0, 0), (0, wide - 1)))
        at = np.stack([padded[np.arange(n)[:, None], where + j] for j in range(wide)], 2).ravel()
        v = back.reshape(n, -1, wide, e).reshape(-1, e)
        g["E"] = np.stack([np.bincount(at, v[:, c], 256) for c in range(e)], 1).astype(np.float32)
        return g

    def fit(self, b: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.004, seed: int = 1) -> ByteNet:
        r = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(b))
            for a in range(0, len(b), batch):
                i = order[a : a + batch]
                t += 1
                for k, v in self.gradients(b[i], y[i], r).items():
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    self.p[k] -= (rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def log_probabilities(self, b: np.ndarray, batch: int = 256) -> np.ndarray:
        return np.concatenate([self.forward(b[i : i + batch])[0] for i in range(0, len(b), batch)]) if len(b) else np.zeros((0, len(LANGS)))


def calibrate(total: np.ndarray, y: np.ndarray) -> float:
    """The scale of summed log probabilities under which held-out labels are likeliest. A share of the labels, fitted
    along with it, is taken to be wrong, that is any of the languages."""
    at = np.arange(len(y))

    def loss(scale: float, wrong: float) -> float:
        p = np.exp(scale * (total - total.max(1, keepdims=True)))
        return float(-np.log((1 - wrong) * p[at, y] / p.sum(1) + wrong / total.shape[1]).mean())

    return min(((0.1 * 1.15**k, w) for k in range(33) for w in (0.001, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3)), key=lambda x: loss(*x))[0]


def sample_sentences(text: str, rng: np.random.Generator, per_text: int) -> list[np.ndarray]:
    """The windows of at most per_text sentences from anywhere in a text, so that a long one with a wrong label does not
    stand for its language."""
    found = sentences(text)
    if len(found) > per_text:
        found = [found[i] for i in rng.choice(len(found), per_text, replace=False)]
    return [windows(text[a:b]) for a, b in found]


def train(rows: list[tuple[str, list[np.ndarray]]], per_language: int = 2500, epochs: int = 5) -> ByteNet | None:
    """Fit on (language, windows of sentences) rows. At most per_language windows a language, one of each sentence
    drawn; one sentence in ten is held out for the calibration."""
    one_thread()
    r = np.random.default_rng(11)
    xs, ys, held = [], [], []
    for y, lang in enumerate(LANGS):
        own = [w for g, ws in rows if g == lang for w in ws]
        r.shuffle(own)
        if not own:
            continue
        cut_at = len(own) // 10
        held += [(w, y) for w in own[:cut_at]]
        own = own[cut_at:]
        own = (own * (per_language // len(own) + 1))[:per_language]
        xs += [w[r.integers(len(w))] for w in own]
        ys += [y] * len(own)
    if not xs:
        return None
    b, y = np.stack(xs), np.array(ys)
    net = ByteNet().fit(b, y, max(1, epochs // 2))
    lp = net.log_probabilities(b)
    sound = ~((lp.argmax(1) != y) & (lp.max(1) > np.log(0.8)))
    net = ByteNet().fit(b[sound], y[sound], epochs)
    if held:
        net.scale = calibrate(np.stack([net.log_probabilities(w).sum(0) for w, _ in held]), np.array([y for _, y in held]))
    return net


def training_rows(docs: DataFrame, text: str, lang: str, documents: int = 600, per_text: int = 12) -> list[tuple[str, list[np.ndarray]]]:
    """(language, windows of sentences) of at most `documents` distinct labelled texts of each language, the smallest by
    hash: a bounded sample for fitting only. Labels are counted first, so that only texts below a bound on the hash,
    some more than are wanted, leave the executors."""
    src = docs.select(label(F.col(lang)).alias("g"), F.col(text).alias("t"))
    counts = {r["g"]: r["count"] for r in src.where("g IS NOT NULL").groupBy("g").count().collect()}  # one row a language
    if not counts:
        return []
    bound = F.lit(None).cast("bigint")
    for g, n in counts.items():
        share = min(1.0, 1.5 * (documents + 30) / n)
        bound = F.when(F.col("g") == g, F.lit(min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1))).otherwise(bound)
    drawn = src.select("g", "t", F.xxhash64("t").alias("h")).where((F.col("h") <= bound) & F.col("t").rlike(r"[.!?]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.langid import sample_sentences

        for b in batches:
            out = []
            for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out.append([w.tobytes() for w in sample_sentences(t, np.random.default_rng(abs(h)), per_text)])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(out, pa.list_(pa.binary()))], names=["g", "h", "w"])

    ship(docs.sparkSession)
    rows = drawn.dropDuplicates(["g", "h"]).mapInArrow(run, "g string, h bigint, w array<binary>").collect()
    out = []
    for g in sorted(counts):
        own = sorted((r["h"], r["w"]) for r in rows if r["g"] == g)[:documents]
        out += [(g, [np.frombuffer(x, np.uint8).reshape(-1, WINDOW) for x in w]) for _, w in own]
    return out


def read_text(text: str, net: ByteNet) -> list[tuple[int, int, str, float]]:
    """(from, to, language, confidence) of each whole sentence."""
    return read_texts([text], net)[0]


def read_texts(texts: list[str | None], net: ByteNet) -> list[list[tuple[int, int, str, float]]]:
    spans, rows, owner = [], [], []
    for k, t in enumerate(texts):
        for a, b in sentences(t or ""):
            w = windows(t[a:b])
            rows.append(w)
            owner += [len(spans)] * len(w)
            spans.append((k, a, b))
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    if not spans:
        return out
    lp = net.log_probabilities(np.concatenate(rows))
    total = np.zeros((len(spans), len(LANGS)))
    np.add.at(total, np.array(owner), lp)
    total *= net.scale  # the windows of a sentence speak together
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    for i, (k, a, b) in enumerate(spans):
        out[k].append((a, b, LANGS[best[i]], float(p[i, best[i]])))
    return out


def segments(docs: DataFrame, key: str, text: str, net: ByteNet) -> DataFrame:
    """key, segment_no INT, lang, confidence DOUBLE, start INT, length INT: runs of sentences in one language.
    Narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.langid import one_thread, read_texts

        one_thread()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = []
                for k, found in zip(part.column(0).to_pylist(), read_texts(part.column(1).to_pylist(), shared.value), strict=True):
                    runs: list[list] = []
                    for a, e, g, c in found:
                        if runs and runs[-1][2] == g:
                            runs[-1][1] = e
                            runs[-1][3].append(c)
                        else:
                            runs.append([a, e, g, [c]])
                    out += [(k, i, g, float(np.mean(c)), a, e - a, float(max(c))) for i, (a, e, g, c) in enumerate(runs)]
                if out:
                    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["k", "segment_no", "lang", "confidence", "start", "length", "best"])

    ship(docs.sparkSession)
    src = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    return src.mapInArrow(run, "k bigint, segment_no int, lang string, confidence double, start int, length int, best double").withColumnRenamed("k", key)


def found(docs: DataFrame, key: str, text: str, lang: str, sure: float = 0.8) -> DataFrame:
    """(key, lang) of documents whose label is missing or not that of the text, or whose text is in more than one
    language. The language of most of the text counts, and each other with a sentence of confidence `sure`. Narrow but
    for the last distinct."""
    net = train(training_rows(docs, text, lang))
    if net is None:
        return docs.sparkSession.createDataFrame([], f"{key} bigint, lang string")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataform.llm.langid import one_thread, read_texts

        one_thread()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                keys, texts, said = (b.column(i).slice(lo, 256).to_pylist() for i in range(3))
                out = []
                for k, s, read in zip(keys, said, read_texts(texts, shared.value), strict=True):
                    size: dict[str, int] = {}
                    best: dict[str, float] = {}
                    for a, e, g, c in read:
                        size[g] = size.get(g, 0) + e - a
                        best[g] = max(best.get(g, 0.0), c)
                    most = max(sorted(size), key=size.__getitem__, default=None)
                    langs = [g for g in sorted(size) if g == most or best[g] >= sure]
                    if langs and (len(langs) > 1 or s != most):
                        out += [(k, g) for g in langs]
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string()), strict=True)], names=["k", "lang"])

    ship(docs.sparkSession)
    src = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), label(F.col(lang)).alias("said")).where(F.col("t").isNotNull())
    return src.mapInArrow(run, "k bigint, lang string").withColumnRenamed("k", key).distinct()

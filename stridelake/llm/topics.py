"""Subject areas of documents by a chain of calibrated classifiers.

Terms (words and pairs of neighbouring words; characters and their pairs in Chinese) of labelled texts are divided among
the subjects and a background by expectation maximisation over sentences: a sentence belongs to one of its document's
subjects or to the background. The resulting weights turn any sentence into evidence per subject, and a document into
features for each subject (evidence, share and number of its sentences), for its structure (length, topical share) and
for its source. One logistic model per subject, linked in a chain, sees these features and the subjects decided before
it, which models co-occurrence; each link is calibrated on held-out labels (Platt), and the most probable combination is
found by beam search. Features for fitting come from weights learned on the other half of the labels.

Fitting uses at most ``max_labelled`` labelled documents of at most ``max_chars`` characters together (whole texts, in
the order of a hash of the id) and runs on the driver; the model it sends out is bounded by ``max_terms``. Every document is then classified where it lies.

Defined results: null and empty texts get no subject; a label repeated or naming an unknown document changes nothing;
``none`` means that no subject holds; without any label there are no rows; further columns are ignored; whole texts are
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.text import _CJK, _IN_NUMBER, normalise
from stridelake.sources.tables import materialise

_UNIT = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+|[.!?](?=\s|$)|[。！？\n]")
_END = dict.fromkeys(".!?。！？\n", -1)
PAIR = 1 << 32
BACKGROUND = 3.0  # log odds of a sentence without evidence being about no subject


def _units(text: str) -> list[str]:
    return _UNIT.findall(_IN_NUMBER.sub("", normalise(text)))


@dataclass
class Terms:
    """Word ids of the texts, with the sentence of each word; sentences are numbered over all texts."""

    words: np.ndarray
    sent: np.ndarray
    doc_of_sent: np.ndarray
    n_docs: int

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sentence and term of every two neighbouring known words: first * 2^32 + second."""
        w, s = self.words, self.sent
        near = np.flatnonzero((s[1:] == s[:-1]) & (w[1:] > 0) & (w[:-1] > 0))
        return s[near], w[near] * PAIR + w[near + 1]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, term) of all words and pairs, each once."""
        ps, pt = self.pairs()
        known = self.words > 0
        return _once(np.concatenate([self.sent[known], ps]), np.concatenate([self.words[known], pt]))


def _once(sent: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (sentence, term), by sentence."""
    o = np.lexsort((term, sent))
    term, sent = term[o], sent[o]
    first = np.append(True, (term[1:] != term[:-1]) | (sent[1:] != sent[:-1])) if len(term) else np.zeros(0, bool)
    return sent[first], term[first]


def read_terms(texts: list[str | None], vocab: dict[str, int], grow: bool) -> Terms:
    """Sentences end at full stops, question and exclamation marks and line ends; a text without words has one."""
    vocab.update(_END)
    get = vocab.get
    ids: list[int] = []
    doc: list[int] = []
    for t in texts:
        units = _units(t or "")
        if grow:
            for u in units:
                if u not in vocab:
                    vocab[u] = len(vocab) + 1
        ids += [get(u, 0) for u in units]
        ids.append(-1)
        doc.append(len(ids))
    w = np.array(ids, np.int64)
    end = w == -1
    cell = np.cumsum(end)  # the number of ends before a word numbers its sentence
    of_doc = np.repeat(np.arange(len(texts)), np.diff(np.array([0, *doc])))
    word = ~end
    # every text's last end keeps a cell for texts without words
    has = np.zeros(int(cell[-1]) + 1 if len(cell) else 0, bool)
    has[cell[word]] = True
    empty = np.ones(len(texts), bool)
    empty[of_doc[word]] = False
    if len(w):
        has[cell[np.array(doc) - 1][empty] - 1] = True
    number = np.cumsum(has) - 1
    doc_of_cell = np.zeros(len(has), np.int64)
    doc_of_cell[cell[word]] = of_doc[word]
    if len(w):
        doc_of_cell[cell[np.array(doc) - 1][empty] - 1] = np.flatnonzero(empty)
    return Terms(w[word], number[cell[word]], doc_of_cell[has], len(texts))


@dataclass
class Evidence:
    """Weights of the telling terms: one row per term, one column per subject and a last one for the background."""

    terms: np.ndarray
    weights: np.ndarray

    def sentences(self, t: Terms) -> np.ndarray:
        """Probability of each subject for every sentence; the rest is background."""
        out = np.zeros((len(t.doc_of_sent), self.weights.shape[1]))
        if len(self.terms) and len(t.words):
            ps, pt = t.pairs()
            known = t.words > 0
            sent, term = np.concatenate([t.sent[known], ps]), np.concatenate([t.words[known], pt])
            at = np.searchsorted(self.terms, term).clip(max=len(self.terms) - 1)
            ok = self.terms[at] == term
            sent, at = _once(sent[ok], at[ok])
            if len(sent):
                first = np.flatnonzero(np.append(True, sent[1:] != sent[:-1]))
                out[sent[first]] = np.add.reduceat(self.weights[at], first, axis=0)
        out[:, -1] += BACKGROUND
        e = np.exp(out - out.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[:, :-1]


def learn_evidence(t: Terms, y: np.ndarray, max_terms: int, rounds: int = 6) -> Evidence:
    """Weights by expectation maximisation; ``y`` is documents x subjects."""
    k = y.shape[1]
    sent, term = t.occurrences()
    u, at, n = np.unique(term, return_inverse=True, return_counts=True)
    keep = n >= 3
    ok = keep[at]
    index = np.cumsum(keep) - 1
    sent, at, u = sent[ok], index[at[ok]], u[keep]
    may = np.hstack([y[t.doc_of_sent], np.ones((len(t.doc_of_sent), 1))])
    r = may / may.sum(1, keepdims=True)
    base = np.bincount(at, minlength=len(u)) / max(1, len(at))
    logp = np.zeros((len(u), k + 1))
    for step in range(rounds):
        for c in range(k + 1):
            mass = np.bincount(at, r[sent, c], len(u))
            logp[:, c] = np.log(0.9 * mass / max(mass.sum(), 1e-9) + 0.1 * base)  # drawn towards the whole collection
        score = np.zeros((len(may), k + 1))
        if step < rounds - 1:
            for c in range(k + 1):
                score[:, c] = np.bincount(sent, logp[at, c], len(may))
            score = np.where(may > 0, score, -np.inf)
            score -= score.max(1, keepdims=True)
            r = np.exp(0.5 * score)
            r /= r.sum(1, keepdims=True)
    # words that go with every subject are no evidence: compare with the mean over subjects and background
    w = (logp - np.log(np.exp(logp).mean(1, keepdims=True))).clip(-1.5, 6)
    tell = np.argsort(-w.max(1), kind="stable")[:max_terms]
    tell = np.sort(tell[w[tell].max(1) > 0.7])
    return Evidence(u[tell], w[tell])


def features(t: Terms, p: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Documents x subjects x features: those of the subject first, then structure, then source."""
    n_sent = np.bincount(t.doc_of_sent, minlength=t.n_docs).astype(float)[:, None]
    total = np.zeros((t.n_docs, p.shape[1]))
    np.add.at(total, t.doc_of_sent, p)
    best = np.zeros_like(total)
    np.maximum.at(best, t.doc_of_sent, p)
    firm = np.zeros_like(total)
    np.add.at(firm, t.doc_of_sent, (p > 0.5).astype(float))
    topical = total.sum(1, keepdims=True)
    share, part = total / np.maximum(n_sent, 1), total / np.maximum(topical, 0.5)
    rest = np.sort(total, axis=1)[:, ::-1][:, :1]
    own = np.stack([share, part, best, np.log1p(firm), (firm == 1) * (n_sent > 6), (firm == 1) * (n_sent <= 6), np.sqrt(share), part * np.log1p(n_sent), total / np.maximum(rest, 0.5)], 2)
    doc = np.hstack([np.log1p(n_sent), n_sent <= 4, topical / np.maximum(n_sent, 1), sources])
    return np.concatenate([own, np.broadcast_to(doc[:, None, :], (*own.shape[:2], doc.shape[1]))], 2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (last: intercept) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(25):
        m = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        h = (x * (m * (1 - m) + 1e-6)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, x.T @ (y - m) - pen * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    subjects: list[str]
    vocab: dict[str, int]
    evidence: Evidence
    sources: list[str]
    rest: bool = False  # the other sources share a feature
    order: list[int] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    platt: list[np.ndarray] = field(default_factory=list)

    def source_matrix(self, sources: list[str | None]) -> np.ndarray:
        at = {s: i for i, s in enumerate(self.sources)}
        n = len(self.sources)
        m = np.zeros((len(sources), n + self.rest))
        for i, s in enumerate(sources):
            if s is not None and (j := at.get(s, n)) < n + self.rest:
                m[i, j] = 1
        return m

    def decode(self, x: np.ndarray, beam: int = 8) -> np.ndarray:
        """The most probable combination of subjects of every document."""
        n, k = len(x), len(self.order)
        paths = np.zeros((n, 1, k))
        score = np.zeros((n, 1))
        for j, s in enumerate(self.order):
            b = paths.shape[1]
            w = self.links[j]
            own = x[:, s, :] @ w[: x.shape[2]] + w[-1]
            z = own[:, None] + paths[:, :, self.order[:j]] @ w[x.shape[2] : -1]
            a, c = self.platt[j]
            z = (a * z + c).clip(-30, 30)
            yes, no = -np.log1p(np.exp(-z)), -np.log1p(np.exp(z))
            on = paths.copy()
            on[:, :, s] = 1
            paths = np.concatenate([paths, on], 1)
            score = np.concatenate([score + no, score + yes], 1)
            if 2 * b > beam:
                top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                paths, score = np.take_along_axis(paths, top[:, :, None], 1), np.take_along_axis(score, top, 1)
        return paths[np.arange(n), score.argmax(1)] if n else np.zeros((0, k))


def fit(texts: list[str], sources: list[str | None], y: np.ndarray, subjects: list[str], *, max_terms: int = 50_000, min_source: int = 20, ridge: float = 1.0, seed: int = 5) -> Model:
    """``y``: labelled documents x subjects. Sources with fewer than ``min_source`` of the documents share one feature."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    half = rng.integers(0, 2, len(texts))
    named = Counter(s for s in sources if s is not None)
    own, few = sorted(s for s, n in named.items() if n >= min_source), [s for s, n in named.items() if n < min_source]
    m = Model(subjects, vocab, Evidence(np.zeros(0, np.int64), np.zeros((0, len(subjects) + 1))), own, bool(few))
    src = m.source_matrix(sources)
    x = None
    parts = [np.flatnonzero(half == f) for f in (0, 1)]
    read = [read_terms([texts[i] for i in p], vocab, True) for p in parts]
    for f in (0, 1):
        e = learn_evidence(read[1 - f], y[parts[1 - f]], max_terms)
        fx = features(read[f], e.sentences(read[f]), src[parts[f]])
        if x is None:
            x = np.zeros((len(texts), *fx.shape[1:]))
        x[parts[f]] = fx
    m.order = np.argsort(-y.sum(0), kind="stable").tolist()
    held = rng.random(len(texts)) < 0.2
    if held.sum() < 20:
        held[:] = True
    for j, s in enumerate(m.order):
        z = np.hstack([x[:, s, :], y[:, m.order[:j]]])
        use = ~held if (~held).sum() > 50 else np.ones(len(y), bool)
        w = _logistic(z[use], y[use, s], ridge)
        raw = z[held] @ w[:-1] + w[-1]
        m.links.append(w)
        m.platt.append(_platt(raw, y[held, s]))
    every = read_terms(texts, vocab, False)
    m.evidence = learn_evidence(every, y, max_terms)
    # only words that occur in telling terms need to be known
    known = set((m.evidence.terms % PAIR).tolist()) | set((m.evidence.terms // PAIR).tolist())
    m.vocab = {w: i for w, i in vocab.items() if i in known or i < 0}
    return m


def _platt(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset of a logistic in the raw score, drawn towards (1, 0)."""
    w = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag([2.0, 2.0])
        w = w + np.linalg.solve(h, x.T @ (y - p) - 2.0 * (w - np.array([1.0, 0.0])))
    return np.array([max(w[0], 0.2), w[1]])


def predict(m: Model, texts: list[str | None], sources: list[str | None]) -> np.ndarray:
    t = read_terms(texts, m.vocab, False)
    y = m.decode(features(t, m.evidence.sentences(t), m.source_matrix(sources)))
    return y


def _classify(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                y = predict(m, part.column(1).to_pylist(), part.column(2).to_pylist())
                d, s = np.nonzero(y > 0)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[d].astype(np.int64)), pa.array([m.subjects[i] for i in s], pa.string())], ["doc_id", "subject"])

    return run


def labelled(documents: DataFrame, labels: DataFrame, subjects: list[str], max_labelled: int, max_chars: int, seed: int = 3):
    """Texts, sources and label matrix of labelled documents in the order of a hash: ``max_labelled`` documents or ``max_chars`` characters."""
    ids = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    ids = ids.select("doc_id", "subjects", F.xxhash64("doc_id", F.lit(seed)).alias("h")).orderBy("h", "doc_id").limit(max_labelled)
    rows = documents.where("text is not null").select("doc_id", "text", "source").join(ids, "doc_id")
    rows = materialise(rows.select("*", F.length("text").alias("n")), "labelled")  # the texts stay in the shared folder until their sizes are known
    upto = F.sum("n").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of ``max_labelled`` rows
    last = rows.select("h", "doc_id", upto.alias("upto")).where((F.col("upto") <= max_chars)).agg(F.max(F.struct("h", "doc_id")).alias("m")).first()["m"]
    rows = rows.where((F.col("h") < last["h"]) | ((F.col("h") == last["h"]) & (F.col("doc_id") <= last["doc_id"]))) if last else rows.limit(0)
    rows = rows.select("doc_id", "text", "source", "subjects").toArrow().sort_by("doc_id")
    at = {s: i for i, s in enumerate(subjects)}
    y = np.zeros((rows.num_rows, len(subjects)))
    for i, have in enumerate(rows.column("subjects").to_pylist()):
        for s in have:
            if s in at:
                y[i, at[s]] = 1
    return rows.column("text").to_pylist(), rows.column("source").to_pylist(), y


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, max_labelled: int = 5000, max_chars: int = 64_000_000, max_subjects: int = 500) -> DataFrame:
    """``doc_id, subject``: one row for each subject of each document."""
    names = [r[0] for r in subjects.where("subject is not null").select("subject").distinct().orderBy("subject").limit(max_subjects + 1).collect()]
    if len(names) > max_subjects:
        raise ValueError(f"more than {max_subjects} subjects")
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    texts, sources, y = labelled(documents, labels, names, max_labelled, max_chars)
    if not texts or not names:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string")
    m = fit(texts, sources, y, names)
    return docs.mapInArrow(_classify(m), "doc_id long, subject string").distinct()

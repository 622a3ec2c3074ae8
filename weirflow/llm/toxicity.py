"""Toxicity score by weak supervision.

Voters look at each document; each votes 1 or 0.

* Insults: words of four themes (stupidity, worthlessness, filth, mockery) in
  four languages, fixed in advance, and learned words, whose rate among labelled
  toxic documents far exceeds that among clean ones. A list of one theme or one
  language would exclude the others, and the label model can only tell
  accuracies of voters that speak about the same documents; so the words are
  dealt out to lists by frequency.
* Learned beginnings: of 4, 5 and 6 bytes, chosen and dealt out alike.
* Patterns, fixed in advance: an insult next to a word of address, a threat (a
  verb of violence before a word of address), an insult with digits for letters.
* Clean side: words and beginnings typical of clean documents; these vote
  "toxic" where a document has none of them.
* Shape: runs of capitals, runs of exclamation marks, stretched letters, a word
  said twice in a row.

The label model is generative: y, then votes with P(vote|y=1) and P(vote|y=0).
Its accuracies come from second moments of the votes over all documents:
off-diagonal covariances of voters independent given y are a product u_i u_j.
Pairs whose covariance exceeds it by a correlation of ``correlated`` or more are
taken as dependent, left out of the fit, and discounted in the posterior by that
correlation; fit and choice alternate until the choice stays. Posteriors of a
bounded sample of labelled rows come from their votes alone, tempered by one
slope and one intercept, so rows with equal votes have equal posteriors. They
are the target of a sparse logistic regression over all items (``max_items``
learned ones at most, the strongest), which scores every document whole.

A text is judged by evidence only: the intercept is fixed at the log-odds of the
toxic share of labels, and the calibration on the sample's labels has a slope
but no intercept of its own. So null, empty and foreign texts, which hold no
item, score exactly that share. Without labels of both kinds, or of any of the documents, every score is the
share (0 if none). Repeated rows and null ids are scored like any other.
Very long texts are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._labels import labelled_sample
from weirflow.llm.quality import fit_logistic
from weirflow.llm._words import PUNCTUATION, Words, chunks, mix, split, text_bytes, word_hashes

# fixed values: what the themes and patterns know without any label
THEMES = {
    "stupidity": "idiot moron stupid dumb imbecile idiota estúpido imbécil tonto dummkopf trottel dumm crétin abruti stupide",
    "worthlessness": "loser worthless pathetic useless inútil fracasado patético versager nutzlos wertlos minable pathétique",
    "filth": "scum trash disgusting filth vermin basura asqueroso escoria abschaum dreck ekelhaft ordure dégoûtant racaille",
    "mockery": "clown laughable buffoon payaso ridículo witzfigur lächerlich pitre bouffon",
}
VIOLENCE = "kill hurt destroy strangle matar matarte destruir töten umbringen tuer frapper"
ADDRESS = "you your yours youre u du dich dein deine ihr tú ti eres usted ustedes toi ton ta vous votre"
DIGITS_AS_LETTERS = bytes.maketrans(b"013457", b"oieast")
PREFIXES = (4, 5, 6)
PATTERNS = ("insult by address", "threat", "digits for letters")
LEXICONS, PARTS = 8, 2
SHAPES = ("capitals", "exclamation marks", "stretched letters", "word said twice")
VOTERS = (*(f"insults, part {i + 1}" for i in range(LEXICONS)), *(f"learned beginnings of {n}, part {i + 1}" for n in PREFIXES for i in range(PARTS)), "no clean words", "no clean beginnings", *PATTERNS, *SHAPES)
_CLEAN = (VOTERS.index("no clean words"), VOTERS.index("no clean beginnings"))
_SEEN = VOTERS.index(PATTERNS[0])
_FILTER = 1 << 20
_KIND = np.array([0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5, 0x9E3779B185EBCA87], np.uint64)


@dataclass
class Accuracies:
    """What the label model estimates: P(vote|y) of each voter, correlations given y (zero: independent), and the posterior's weights."""

    if_toxic: np.ndarray
    if_clean: np.ndarray
    correlation: np.ndarray
    weights: np.ndarray
    bias: float


@dataclass
class Model:
    items: np.ndarray  # sorted hashes
    voters: np.ndarray  # the items' voter, -1: none
    weights: np.ndarray
    bias: float
    slope: float
    votes: Accuracies


def item_hashes(words: Words) -> list[np.ndarray]:
    """A hash of each word, and of its beginnings (of shorter words, the whole word under another salt)."""
    out = [mix(word_hashes(words) ^ _KIND[0])]
    for i, n in enumerate(PREFIXES):
        short = Words(words.data, words.offsets, words.start, np.minimum(words.end, words.start + n), words.doc)
        out.append(mix(word_hashes(short) ^ _KIND[i + 1]))
    return out


def _tokens(texts: pa.Array) -> Words:
    return split(texts, lower=True, separator=PUNCTUATION)


def _hashes_of(text: str) -> np.ndarray:
    return np.unique(word_hashes(_tokens(pa.array([text]))))


_INSULTS, _VIOLENCE, _ADDRESS = (_hashes_of(t) for t in (" ".join(THEMES.values()), VIOLENCE, ADDRESS))
_FIXED = np.zeros(_FILTER, bool)
_FIXED[np.concatenate([_INSULTS, _VIOLENCE]) & np.uint64(_FILTER - 1)] = True


def _known(words: Words, items: np.ndarray, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, item number) pairs of the items that texts hold."""
    docs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(items):
        for hashes in item_hashes(words):
            maybe = np.flatnonzero(filter_[hashes & np.uint64(_FILTER - 1)])
            at = np.minimum(np.searchsorted(items, hashes[maybe]), len(items) - 1)
            hit = items[at] == hashes[maybe]
            docs.append(words.doc[maybe[hit]])
            found.append(at[hit])
    pairs = np.unique(np.concatenate(docs) * max(1, len(items)) + np.concatenate(found))
    return pairs // max(1, len(items)), pairs % max(1, len(items))


def _listed(words: Words, hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each word is one of the sorted ``known`` hashes."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _patterns(words: Words, hashes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the texts that each of ``PATTERNS`` finds."""
    n = len(hashes)

    def near(at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
        """Texts in which a word of address stands ``steps`` from one of the words ``at``."""
        found = np.zeros(len(at), bool)
        for step in steps:
            to = np.clip(at + step, 0, max(0, n - 1))
            found |= (words.doc[to] == words.doc[at]) & _listed(words, hashes[to], _ADDRESS) & (to == at + step)
        return np.unique(words.doc[at[found]])

    maybe = np.flatnonzero(_FIXED[hashes & np.uint64(_FILTER - 1)])
    insult = maybe[_listed(words, hashes[maybe], _INSULTS)]
    violent = maybe[_listed(words, hashes[maybe], _VIOLENCE)]
    digit = np.append(0, np.cumsum((words.data >= 48) & (words.data <= 57)))
    digits = digit[words.end] - digit[words.start]
    mixed = np.flatnonzero((digits > 0) & (digits < words.end - words.start))
    hidden = np.zeros(0, np.int64)
    if len(mixed):
        plain = np.frombuffer(words.data.tobytes().translate(DIGITS_AS_LETTERS), np.uint8)
        some = Words(plain, words.offsets, words.start[mixed], words.end[mixed], words.doc[mixed])
        hidden = np.unique(some.doc[_listed(some, word_hashes(some), _INSULTS)])
    return [near(insult, (-2, -1, 1, 2)), near(violent, (1, 2)), hidden]


def _shapes(texts: pa.Array, words: Words, hashes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the texts that each of ``SHAPES`` finds."""
    data, off = text_bytes(texts)

    def of(start: np.ndarray, length: int) -> np.ndarray:
        doc = np.searchsorted(off, start, "right") - 1
        return np.unique(doc[start + length <= off[doc + 1]])

    def runs(hit: np.ndarray, length: int) -> np.ndarray:
        for _ in range(length - 1):
            hit = hit[:-1] & hit[1:]
        return of(np.flatnonzero(hit), length)

    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    same = (data[1:] == data[:-1]) & letter[1:]
    twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1]))
    return [runs((data >= 65) & (data <= 90), 4), runs(data == 33, 2), of(np.flatnonzero(same[1:] & same[:-1]), 3), np.unique(words.doc[twice])]


def _votes(texts: pa.Array, words: Words, doc: np.ndarray, item: np.ndarray, voters: np.ndarray) -> np.ndarray:
    """One row a text, one column a voter, from the items that texts hold."""
    out = np.zeros((len(texts), len(VOTERS)), np.int8)
    out[doc[voters[item] >= 0], voters[item][voters[item] >= 0]] = 1
    out[:, _CLEAN] = 1 - out[:, _CLEAN]
    hashes = word_hashes(words)
    for i, found in enumerate([*_patterns(words, hashes), *_shapes(texts, words, hashes)]):
        out[found, _SEEN + i] = 1
    return out


def _filter(items: np.ndarray) -> np.ndarray:
    out = np.zeros(_FILTER, bool)
    out[items & np.uint64(_FILTER - 1)] = True
    return out


def item_counts(sample: DataFrame) -> DataFrame:
    """``kind, item, toxic, clean``: documents of either label that hold an item; counted per task before the shuffle.

    Kinds are words (0) and beginnings (from 1, as in ``PREFIXES``).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, limit=2 << 20):
                words = _tokens(part.column("text"))
                y = part.column("y").to_numpy(zero_copy_only=False)
                for kind, hashes in enumerate(item_hashes(words)):
                    order = np.lexsort((words.doc, hashes))
                    h, d = hashes[order], words.doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                    h, d = h[new], d[new]
                    items, first = np.unique(h, return_index=True)
                    toxic = np.add.reduceat(y[d].astype(np.int64), first) if len(h) else np.zeros(0, np.int64)
                    total = np.diff(np.append(first, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), kind, np.int8)), pa.array(items.view(np.int64)), pa.array(toxic), pa.array(total - toxic)], ["kind", "item", "toxic", "clean"])

    counted = sample.select("text", "y").mapInArrow(count, "kind tinyint, item bigint, toxic bigint, clean bigint")
    return counted.groupBy("kind", "item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def vote_moments(docs: DataFrame, items: np.ndarray, voters: np.ndarray, text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and how many of them each pair of voters votes on together, over all documents."""
    sent, m = docs.sparkSession.sparkContext.broadcast((items, voters)), len(VOTERS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, voters_ = sent.value
        filter_, total, n = _filter(items_), np.zeros((m, m), np.int64), 0
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text")
                words = _tokens(texts)
                votes = _votes(texts, words, *_known(words, items_, filter_), voters_).astype(np.float32)
                total, n = total + np.rint(votes.T @ votes).astype(np.int64), n + part.num_rows
        i, j = np.indices((m, m))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), -1)), pa.array(np.append(j.ravel(), -1)), pa.array(np.append(total.ravel(), n))], ["i", "j", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    out, n = np.zeros((m, m)), 0
    for r in counts.collect():  # m * m rows
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = r.n
    return n, out


def _triplets(cov: np.ndarray) -> np.ndarray:
    """First guess of u: the lower median of cov_ij cov_ik / cov_jk over pairs of other voters, robust to some correlated pairs."""
    m = len(cov)
    u = np.full(m, 1e-6)
    for i in range(m):
        others = np.delete(np.arange(m), i)
        j, k = (others[x] for x in np.triu_indices(m - 1, 1))
        ok = (cov[j, k] > 1e-12) & (cov[i, j] > 0) & (cov[i, k] > 0)
        if ok.any():
            u[i] = np.sqrt(np.quantile(cov[i, j[ok]] * cov[i, k[ok]] / cov[j[ok], k[ok]], 0.5, method="lower"))
    return u


def label_model(n: int, together: np.ndarray, prior: float, correlated: float = 0.25) -> Accuracies:
    """Fit to the number of documents and the counts of joint votes."""
    m, n = len(together), max(1, n)
    mean = np.clip(np.diag(together) / n, 0.5 / n, 1 - 0.5 / n)
    cov = together / n - np.outer(mean, mean)
    spread = np.sqrt(mean * (1 - mean))
    apart = ~np.eye(m, dtype=bool)
    tells = (spread > np.sqrt(2.0 / n)) if n > 4 else np.ones(m, bool)  # a voter that never or always votes says nothing
    apart &= np.outer(tells, tells)
    u, kept = np.where(tells, _triplets(np.where(np.outer(tells, tells), cov, 0)), 1e-9), None
    for _ in range(10):
        residual = (cov - np.outer(u, u)) / np.outer(spread, spread)
        now = apart & (residual < correlated)
        now[now.sum(axis=1) < 2] = apart[now.sum(axis=1) < 2]  # nothing left to tell it by
        now &= now.T | (now.sum(axis=1) < 3)[:, None]
        if kept is not None and np.array_equal(now, kept):
            break
        kept = now
        for _ in range(200):  # alternating least squares of cov ~ u u' over the kept pairs
            u = np.maximum(1e-9, 0.5 * u + 0.5 * (np.where(kept, cov, 0) @ u) / np.maximum(1e-12, kept @ (u * u)))
    residual = (cov - np.outer(u, u)) / np.outer(spread, spread)
    gap = u / np.sqrt(prior * (1 - prior))
    if_clean = np.clip(mean - prior * gap, 0.5 / n, 1 - 1e-6)
    if_toxic = np.clip(if_clean + gap, if_clean, np.maximum(if_clean, 0.98))  # no voter is taken to see everything
    # votes that say the same thing share one weight
    correlation = np.where(apart & (residual >= correlated), np.clip(residual, 0, 1), 0)
    discount = tells / (1 + correlation.sum(axis=1))
    on = np.log(if_toxic / if_clean)
    off = np.log((1 - if_toxic) / (1 - if_clean))
    return Accuracies(if_toxic, if_clean, correlation, discount * (on - off), float(np.log(prior / (1 - prior)) + (discount * off).sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tempered(posterior: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Posteriors with a common slope and intercept of their log-odds fitted to labels: votes that are not quite independent are too sure of themselves.

    Rows with the same votes still have the same posterior, whatever their label.
    """
    odds = np.log(np.clip(posterior, 1e-9, None)) - np.log(np.clip(1 - posterior, 1e-9, None))
    a, b = fit_logistic(odds, label, weight)
    return _sigmoid(a + b * odds)


def train_linear(rows: np.ndarray, items: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, bias: float, steps: int = 300, ridge: float = 3e-4) -> np.ndarray:
    """Logistic regression on soft labels over sparse presence features with a fixed intercept, by accelerated gradient steps."""
    n = len(target)
    total = weight.sum()
    w = np.zeros(width)
    vw = w.copy()
    per_row = np.bincount(rows, minlength=n)
    rate = 4.0 / (1.0 + float((weight * per_row).sum() / total))
    for step in range(steps):
        p = _sigmoid(np.bincount(rows, vw[items], minlength=n) + bias)
        g = weight * (p - target) / total
        nw = vw - rate * (np.bincount(items, g[rows], minlength=width) + ridge * vw)
        vw = nw + step / (step + 3) * (nw - w)
        w = nw
    return w


def fit_slope(raw: np.ndarray, label: np.ndarray, weight: np.ndarray, bias: float, steps: int = 50) -> float:
    """The a >= 0 for which sigmoid(bias + a * raw) fits the labels best, by Newton steps; a weak prior holds it near 1."""
    a, pull = 1.0, 1e-3 * weight.sum()
    for _ in range(steps):
        p = _sigmoid(bias + a * raw)
        a -= ((weight * (p - label) * raw).sum() + pull * (a - 1)) / ((weight * p * (1 - p) * raw * raw).sum() + pull)
        a = min(max(a, 0.0), 10.0)
    return float(a)


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 8000, max_items: int = 3000,
    least: int = 4, correlated: float = 0.25, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on at most ``per_class`` labelled rows of either kind; vote moments come from all documents."""
    counts = {r[0]: r[1] for r in labels.where(usable).groupBy(F.col(label_col).cast("int")).count().collect()}
    negative, positive = counts.get(0, 0), counts.get(1, 0)
    sample = labelled_sample(docs, labels, label_col, usable, per_class, id_col, text_col)
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()} if positive and negative else {}
    if not sizes:
        p = min(max(positive / max(1, positive + negative), 1e-6), 1 - 1e-6)
        none = np.zeros(0)
        blind = Accuracies(none, none, none, np.zeros(len(VOTERS)), float(np.log(p / (1 - p))))
        return Model(np.zeros(0, np.uint64), none.astype(int), none, float(np.log(p / (1 - p))), 0.0, blind)
    prior = positive / (positive + negative)
    n1, n0 = sizes.get(1, 0) + 1, sizes.get(0, 0) + 1
    lift = F.log(((F.col("toxic") + 0.25) / n1) / ((F.col("clean") + 0.25) / n0))
    scored = item_counts(sample).where(F.col("toxic") + F.col("clean") >= least).withColumn("lift", lift)
    strength = F.abs("lift") * F.sqrt(F.col("toxic") / n1 + F.col("clean") / n0)
    picked = scored.where((F.col("toxic") >= least) & (F.col("lift") > 1.5)).orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), "item").limit(max_items * 2 // 3).collect()
    clean = scored.where(F.col("lift") < -1).orderBy(F.desc(strength), "item").limit(max_items // 3).collect()
    found = {int(np.int64(r.item).view(np.uint64)): (r.kind, r.lift, r.toxic) for r in [*picked, *clean]}
    themes = item_hashes(_tokens(pa.array([" ".join(THEMES.values())])))[0]
    items = np.unique(np.concatenate([np.array(list(found), np.uint64), themes]))

    # voters that say "toxic" hold items that hardly occur in clean text
    kind, lifts, often = (np.array([found.get(int(i), (0, 0.0, 0))[x] for i in items]) for x in range(3))
    voters = np.full(len(items), -1)
    voters[lifts < 0] = np.where(kind[lifts < 0] == 0, *_CLEAN)
    sure, at = (lifts > 2.5) | np.isin(items, themes), 0
    for k, parts in enumerate((LEXICONS, *(PARTS for _ in PREFIXES))):
        which = np.flatnonzero(sure & (kind == k))
        order = which[np.lexsort((items[which], -often[which]))]
        voters[order] = at + np.arange(len(order)) % parts  # frequent ones in turn, so that parts are alike
        at += parts
    n, together = vote_moments(docs, items, voters, text_col)
    model = label_model(n, together, prior, correlated)

    rows, cols, y, posterior = [], [], [], []
    for r in _held(sample, items, voters, model).collect():
        rows += [len(y)] * len(r.held)
        cols += r.held
        y.append(r.y)
        posterior.append(r.posterior)
    rows, cols, y, posterior = np.array(rows, np.int64), np.array(cols, np.int64), np.array(y, np.float64), np.array(posterior)
    share = np.array([max(1e-9, np.mean(y == 0)), max(1e-9, np.mean(y == 1))])
    weight = np.array([1 - prior, prior])[y.astype(int)] / share[y.astype(int)]
    bias = float(np.log(prior / (1 - prior)))
    w = train_linear(rows, cols, tempered(posterior, y, weight), weight, len(items), bias)
    slope = fit_slope(np.clip(np.bincount(rows, w[cols], minlength=len(y)), -30, 30), y, weight, bias)
    return Model(items, voters, w, bias, slope, model)


def _held(docs: DataFrame, items: np.ndarray, voters: np.ndarray, model: Accuracies) -> DataFrame:
    """``doc_id, y, posterior, held``: the label model's posterior and the numbers of the items that each text holds."""
    sent = docs.sparkSession.sparkContext.broadcast((items, voters, model))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, voters_, model_ = sent.value
        filter_ = _filter(items_)
        for batch in batches:
            for part in chunks(batch):
                texts = part.column("text")
                words = _tokens(texts)
                d, i = _known(words, items_, filter_)
                posterior = _sigmoid(_votes(texts, words, d, i, voters_) @ model_.weights + model_.bias)
                offsets = np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(i.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(posterior), held], ["doc_id", "y", "posterior", "held"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {kind}, y int, posterior double, held array<int>").orderBy("doc_id", "y")


def _scores(texts: pa.Array, m: Model, filter_: np.ndarray, posterior: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """Label model's posterior (if asked for) and calibrated score of each text."""
    words = _tokens(texts)
    d, i = _known(words, m.items, filter_)
    raw = np.bincount(d, m.weights[i], minlength=len(texts))
    voted = _sigmoid(_votes(texts, words, d, i, m.voters) @ m.votes.weights + m.votes.bias) if posterior else None
    return voted, _sigmoid(m.bias + m.slope * np.clip(raw, -30, 30))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, posterior, score`` of every document in one scan; posterior is the label model's own."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_items items at most

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        filter_ = _filter(m.items)
        for batch in batches:
            for part in chunks(batch):
                posterior, value = _scores(part.column("text"), m, filter_)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(posterior), pa.array(value)], ["doc_id", "posterior", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, posterior double, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with a score below ``threshold``; scored and filtered in one scan."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = _filter(sent.value.items)
        for batch in batches:
            for part in chunks(batch, text_col):
                value = _scores(part.column(part.schema.get_field_index(text_col)), sent.value, filter_, posterior=False)[1]
                yield part.filter(pa.array(value < threshold))

    return docs.mapInArrow(scan, docs.schema)

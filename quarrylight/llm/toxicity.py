"""Toxic spans by a linear-chain conditional random field (operator 9).

Tokens of a bounded sample of labelled texts get tags from the text's label: in
a toxic text, words are tagged toxic that stand in clearly more contexts of
toxic texts than of clean ones. A CRF with two tags learns from these lines;
its forward-backward marginals give, over whole texts, the toxic offsets and,
through a calibrated logistic of their expected number, a document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import table, text_parts

TOKEN = re.compile(r"[^\W\d_]+|\d+")
#: At most so many toxic and clean rows, and so many characters, to learn from.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 4000, 24_000_000
#: A toxic word stands in so many contexts of toxic texts at least, and so many
#: times likelier there than in clean ones.
MIN_CONTEXTS, MIN_RATIO = 5, 20.0
THRESHOLD = 0.3
#: Features of the CRF: all toxic words, then the most frequent first words of
#: lines up to this number.
VOCABULARY = 20_000
#: Bytes of text that are scored together, and words whose weights a task
#: remembers.
PART, REMEMBERED = 1 << 20, 1 << 18


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Words share a feature with all words of the same first letters.
STEM = 6


def tokens_of(line: str) -> list[str]:
    return TOKEN.findall(line.lower())


def stem_of(word: str) -> str:
    return "^" + word[:STEM]


def chain(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Forward-backward over many lines at once.

    emit: log score of the toxic tag against the other, for all tokens, line by
    line; lines come longest first. Returns each token's toxic marginal, the
    expected transitions (2x2), the expected starts and the log partition sum.
    Lines advance together, one token a step; a line leaves at its end.
    """
    n = len(lengths)
    if not n or not lengths[0]:
        return np.zeros(0), np.zeros((2, 2)), np.zeros(2), 0.0
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    t, s = np.exp(trans), np.exp(start)
    e = np.exp(np.clip(emit, -60, 60))
    a1 = np.empty(len(emit))  # normalised forward weight of the toxic tag
    scale = np.empty(len(emit))
    prev = None
    for k in range(longest):
        m = alive[k]
        at = first[:m] + k
        if k == 0:
            p0, p1 = np.full(m, s[0]), np.full(m, s[1])
        else:
            q = prev[:m]
            p0 = (1 - q) * t[0, 0] + q * t[1, 0]
            p1 = (1 - q) * t[0, 1] + q * t[1, 1]
        p1 = p1 * e[at]
        z = p0 + p1
        prev = p1 / z
        a1[at], scale[at] = prev, z
    marg = np.empty(len(emit))
    pairs, starts = np.zeros((2, 2)), np.zeros(2)
    b0 = b1 = None
    for k in range(longest - 1, -1, -1):
        m = alive[k]
        at = first[:m] + k
        c0, c1 = np.ones(m), np.ones(m)
        if b0 is not None:
            j = len(b0)
            nxt = first[:j] + k + 1
            w1, z = b1 * e[nxt], scale[nxt]
            q = a1[at[:j]]
            for x, qx in ((0, 1 - q), (1, q)):
                pairs[x, 0] += float(np.sum(qx * t[x, 0] * b0 / z))
                pairs[x, 1] += float(np.sum(qx * t[x, 1] * w1 / z))
            c0[:j] = (t[0, 0] * b0 + t[0, 1] * w1) / z
            c1[:j] = (t[1, 0] * b0 + t[1, 1] * w1) / z
        q = a1[at]
        marg[at] = q * c1 / ((1 - q) * c0 + q * c1)
        b0, b1 = c0, c1
    starts[1] = float(marg[first].sum())
    starts[0] = n - starts[1]
    return marg, pairs, starts, float(np.log(scale).sum())


class Codes(dict):
    """word -> the place of its two weights in ``pairs``; few words differ from
    (0, 0), at place 0."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.places, self.pairs = model, {(0.0, 0.0): 0}, [(0.0, 0.0)]

    def __missing__(self, word: str) -> int:
        pair = (self.model.weight(word), self.model.beside.get(word, 0.0))
        code = self.places.setdefault(pair, len(self.pairs))
        if code == len(self.pairs):
            self.pairs.append(pair)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = code
        return code


class Model:
    """Weights: bias, one per known word for itself and for either neighbour,
    transitions and starts; and the logistic that makes scores."""

    def __init__(self):
        self.bias = -6.0
        self.own: dict[str, float] = {}
        self.beside: dict[str, float] = {}
        self.trans = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.slope, self.shift = 0.0, -20.0

    def weight(self, word: str) -> float:
        """A word's own weight and its stem's."""
        known = self.own.get(word)
        return (known or 0.0) + self.own.get(stem_of(word), 0.0) if len(word) >= STEM else known or 0.0

    def emissions(self, lines: list[list[str]], codes: Codes) -> np.ndarray:
        """The toxic tag's log scores for the tokens of all lines."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        found = np.fromiter((codes[t] for line in lines for t in line), np.int64, int(sizes.sum()))
        own, near = np.array(codes.pairs).T[:, found]
        head = np.zeros(len(found), bool)
        head[np.cumsum(sizes)[:-1]] = True
        out = self.bias + own
        if len(found) > 1:
            out[1:] += np.where(head[1:], 0.0, near[:-1])
            out[:-1] += np.where(head[1:], 0.0, near[1:])
        return out

    def marginals(self, texts: list[str], codes: Codes | None = None):
        """Per text a list of (line offset, line, marginals) for its lines."""
        rows = []
        for i, text in enumerate(texts):
            at = 0
            for line in (text or "").split("\n"):
                tokens = tokens_of(line)
                if tokens:
                    rows.append((i, at, line, tokens))
                at += len(line) + 1
        rows.sort(key=lambda r: -len(r[3]))
        lines = [r[3] for r in rows]
        lengths = np.array([len(x) for x in lines], dtype=np.int64)
        emit = self.emissions(lines, Codes(self) if codes is None else codes) if lines else np.zeros(0)
        marg = chain(emit, lengths, self.trans, self.start)[0]
        out: list[list] = [[] for _ in texts]
        ends = np.cumsum(lengths)
        for (i, at, line, _), end, n in zip(rows, ends.tolist(), lengths.tolist()):
            out[i].append((at, line, marg[end - n : end]))
        return out

    def evidence(self, found) -> float:
        """The expected number of toxic words, damped."""
        return float(np.log1p(sum(float(m[m > 0.01].sum()) for _, _, m in found)))

    def score(self, found) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.evidence(found) + self.shift))))

    def spans(self, found, least: float = 0.5) -> list[dict]:
        """Offsets of tokens whose marginal reaches ``least``."""
        out = []
        for at, line, m in found:
            if m.max() >= least:
                low = line.lower()
                if len(low) != len(line):  # lower() may lengthen a text
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
                for hit, p in zip(TOKEN.finditer(low), m):
                    if p >= least:
                        out.append({"start": at + hit.start(), "end": at + hit.end(), "marginal": float(p)})
        return sorted(out, key=lambda s: s["start"])


def toxic_words(toxic: list[str], clean: list[str], min_contexts: int, min_ratio: float) -> set[str]:
    """Words and stems by the contexts (both neighbours) they stand in; copies
    of a text add no context."""

    def count(texts):
        seen = defaultdict(set)
        for text in texts:
            own = ["", *tokens_of(text), ""]
            for a, b, c in zip(own, own[1:], own[2:]):
                seen[b].add(hash((a, c)))
                if len(b) >= STEM:
                    seen[stem_of(b)].add(hash((a, b, c)))
        return Counter({w: len(x) for w, x in seen.items()})

    bad = count(toxic)
    some = {w for w, n in bad.items() if n >= min_contexts}
    good: Counter = Counter()
    for text in clean:
        own = tokens_of(text)
        good.update(w for w in own if w in some)
        good.update(x for x in map(stem_of, own) if x in some)
    size = max(1, sum(map(len, toxic))) / max(1, sum(map(len, clean)))
    return {w for w in some if (bad[w] + 0.5) / (good[w] + 0.5) / size >= min_ratio}


def fit(rows: list[tuple[str, int]], rounds: int = 40, min_contexts: int = MIN_CONTEXTS, min_ratio: float = MIN_RATIO) -> Model:
    """The model from (text, label) rows; a CRF on every other row, the
    logistic on the rest. Without rows of both labels every score is near 0."""
    model = Model()
    rows = list(dict.fromkeys(rows))  # copies teach nothing new
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    if len(toxic) < 4 or len(clean) < 4:
        model.shift = -8.0 if not toxic else float(np.log((len(toxic) + 0.5) / (len(clean) + 0.5)))
        return model
    words = toxic_words(toxic, clean, min_contexts, min_ratio)
    learn = toxic[::2] + clean[::2]
    marked = set(toxic[::2])
    lines, tags = [], []
    for text in learn:
        for line in text.split("\n"):
            own = tokens_of(line)
            hit = [text in marked and (w in words or stem_of(w) in words) for w in own]
            if own and (any(hit) or any(w in words or stem_of(w) in words for w in own) or zlib.crc32(" ".join(own).encode()) % 3 == 0):
                lines.append(own)
                tags.append(hit)
    others = Counter(w for own in lines for w in own[:2] if w not in words)
    common = sorted(others, key=lambda w: (-others[w], w))[: max(0, VOCABULARY - len(words))]
    vocabulary = {w: i for i, w in enumerate(sorted(words) + common)}
    train(model, lines, tags, vocabulary, rounds)
    calibrate(model, [(t, 1) for t in toxic[1::2]] + [(t, 0) for t in clean[1::2]])
    return model


def train(model: Model, lines, tags, vocabulary, rounds: int, decay: float = 1e-3, rate: float = 0.3) -> None:
    """Maximises the penalised log likelihood by Adam over whole passes."""
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    lengths = np.array([len(lines[i]) for i in order], dtype=np.int64)
    ids = np.array([vocabulary.get(w, -1) for i in order for w in lines[i]], dtype=np.int64)
    stems = np.array([vocabulary.get(stem_of(w), -1) if len(w) >= STEM else -1 for i in order for w in lines[i]], dtype=np.int64)
    y = np.array([x for i in order for x in tags[i]], dtype=float)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    head = np.zeros(len(ids), bool)
    head[first] = True
    left = np.where(head, -1, np.concatenate([[-1], ids[:-1]]))
    right = np.where(np.concatenate([head[1:], [True]]), -1, np.concatenate([ids[1:], [-1]]))
    v = len(vocabulary)
    theta = np.zeros(1 + 2 * v + 4 + 2)
    theta[0] = -3.0
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    true_pairs = np.zeros((2, 2))
    inner = ~head
    np.add.at(true_pairs, (np.concatenate([[0], y[:-1]]).astype(int)[inner], y.astype(int)[inner]), 1)
    true_starts = np.array([(y[first] == 0).sum(), (y[first] == 1).sum()], float)
    pick = lambda w, i: np.where(i >= 0, w[i], 0.0)
    for step in range(1, rounds + 1):
        own, beside = theta[1 : 1 + v], theta[1 + v : 1 + 2 * v]
        trans, start = theta[1 + 2 * v : 5 + 2 * v].reshape(2, 2), theta[5 + 2 * v :]
        emit = theta[0] + (pick(own, ids) + pick(own, stems) + pick(beside, left) + pick(beside, right) if v else 0.0)
        marg, pairs, starts, _ = chain(emit, lengths, trans, start)
        miss = y - marg
        g = np.zeros_like(theta)
        g[0] = miss.sum()
        for base, where in ((1, ids), (1, stems), (1 + v, left), (1 + v, right)):
            has = where >= 0
            g[base : base + v] += np.bincount(where[has], miss[has], minlength=v)[:v] if v else 0
        g[1 + 2 * v : 5 + 2 * v] = (true_pairs - pairs).ravel()
        g[5 + 2 * v :] = true_starts - starts
        g = g / len(lines) ** 0.5 - decay * theta
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    model.bias = float(theta[0])
    model.own = {w: float(theta[1 + i]) for w, i in vocabulary.items() if abs(theta[1 + i]) > 0.05}
    model.beside = {w: float(theta[1 + v + i]) for w, i in vocabulary.items() if abs(theta[1 + v + i]) > 0.05}
    model.trans, model.start = theta[1 + 2 * v : 5 + 2 * v].reshape(2, 2), theta[5 + 2 * v :]


def calibrate(model: Model, rows: list[tuple[str, int]]) -> None:
    """Logistic regression of the label on the evidence, by Newton's method."""
    x = np.array([model.evidence(f) for f in model.marginals([t for t, _ in rows])])
    y = np.array([label for _, label in rows], float)
    w = np.array([1.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-3])
        w = w + np.clip(np.linalg.solve(h, design.T @ (y - p) - np.array([1e-2 * w[0], 0.0])), -4, 4)
    model.slope, model.shift = float(max(0.0, w[0])), float(w[1])


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows that are not held out, in a fixed
    order of hashed ids. Its bounds are the three last parameters; each label
    has its share of the characters, and a row that would pass it is left out.

    Cases: an id that is labelled both ways teaches nothing and is left out, as
    are null ids and labels. Of rows that share an id each distinct text counts
    as a row. Null texts are empty ones. Without labels there are no rows. No
    more than toxic + clean ids, places of texts and ``chars`` characters come to
    the driver.
    """
    own = labels.select(F.col(id_col).alias("ql_id"), F.col(label_col).alias("ql_y")).filter(F.col("ql_id").isNotNull() & F.col("ql_y").isNotNull() & ~held_out(F.col("ql_id")))
    sure = own.groupBy("ql_id").agg(F.min("ql_y").alias("ql_y"), F.max("ql_y").alias("high")).filter(F.col("ql_y") == F.col("high"))
    order = F.xxhash64(F.lit(11), "ql_id")
    some = sure.filter("ql_y = 1").orderBy(order, "ql_id").limit(toxic).unionByName(sure.filter("ql_y = 0").orderBy(order, "ql_id").limit(clean)).select("ql_id", "ql_y")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # At most toxic + clean rows, so they may be broadcast.
    known = docs.select(F.col(id_col).alias("ql_id"), text.alias("t")).join(F.broadcast(some), "ql_id")
    places = known.select("ql_id", "ql_y", order.alias("h"), F.xxhash64("t").alias("th"), F.char_length("t").alias("n")).distinct()
    left = {1: chars * toxic // (toxic + clean), 0: chars * clean // (toxic + clean)}
    chosen = {}
    for label, most in ((1, toxic), (0, clean)):
        for r in places.filter(F.col("ql_y") == label).orderBy("h", "ql_id", "th").limit(most).collect():
            if r.n <= left[label]:
                left[label] -= r.n
                chosen[r.ql_id, r.th] = len(chosen), label
    if not chosen:
        return []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, th) for i, th in chosen], places.select("ql_id", "th").schema)
    found = known.withColumn("th", F.xxhash64("t")).join(F.broadcast(wanted), ["ql_id", "th"], "left_semi").groupBy("ql_id", "th").agg(F.first("t").alias("t")).collect()
    rows = sorted((*chosen[r.ql_id, r.th], r.t) for r in found)
    return [(t, label) for _, label, t in rows]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (start, end, marginal) for every row of docs.

    Cases: a null, empty or wordless text gets the base score and no spans.
    Rows that share an id, or have none, are scored one by one. An empty table
    gives no rows; other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = dict(rows.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        codes = Codes(model)
        for batch in batches:
            for part in text_parts(batch, 1, PART):
                found = model.marginals([t.as_py() for t in part.column(1)], codes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(f) for f in found], pa.float64()), pa.array([model.spans(f) for f in found], span)], ["doc_id", "score", "spans"])

    return rows.mapInArrow(run, f"doc_id {ids}, score double, spans array<struct<start:bigint,end:bigint,marginal:double>>")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold.

    Cases: a null, empty or wordless text has the base score. Rows that share an
    id, or have none, are judged one by one. An empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        codes = Codes(model)
        for batch in batches:
            for part in text_parts(batch, at, PART):
                found = model.marginals([t.as_py() for t in part.column(at)], codes)
                yield part.filter(pa.array([model.score(f) < threshold for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    """Scores of ``documents``, learnt from rows of ``labels`` not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))

"""Quality classifier by co-training a text-content view and a page-metadata view.

Both views are logistic regressions. They are first fitted on a bounded sample of labelled rows. In each round each view
hands the other the label of every unlabelled document that it is sure of: the text view's labels come down to counts by
cell of metadata, from which the metadata view is fitted exactly; the text view is fitted by Newton steps whose sums the
executors work out over all documents. All documents a label is handed to weigh as much as the labelled rows of that label
at most, so that the fit behaves alike at every size. Each view is then calibrated, and the two are combined, on labelled
rows held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, table_path, written

#: Labelled rows that are fitted on at most; words that the text view of a label knows at most. All unlabelled documents
#: take part in each round and all documents are scored.
MAX_LABELLED, WORDS = 8000, 256
ROUNDS, SURE, STEPS = 3, 0.97, 3
#: Tasks that add up the partitions' sums before the last one does.
ADDERS = 32
EDGE = "#*$%&|<>.,;:!?\"'()[]{}"
SHAPES = ("symbol", "capitals", "shout", "again", "digits", "long", "short", "few")


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class Reader:
    """Features of texts: hashes of words (lower case, without punctuation round them) and shares of odd shapes."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, w: str) -> tuple[int, int]:
        core = w.strip(EDGE)
        bits = bool(set(w) & set("#*$%&|<>")) | (len(core) > 1 and core.isupper()) << 1 | w.endswith("!!") << 2 | any(c.isdigit() for c in core) << 3 | (len(core) > 24) << 4 | (len(core) < 2) << 5
        return _hash(core.lower()), bits

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, offsets of each text, shares as a matrix)."""
        if len(self.known) > 400_000:
            self.known = {}
        parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.string()), ""), r"[ \t\n\x0b\x0c\r]+")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = coded.dictionary.to_pylist()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        got = np.array([known[w] for w in words], np.int64).reshape(-1, 2)
        hashes, bits = got[codes, 0], got[codes, 1]
        n = np.maximum(np.diff(offsets), 1)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        share = lambda hit: np.bincount(owner, weights=hit, minlength=len(n)) / n
        again = np.append(False, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))
        cols = [share(bits >> k & 1) for k in (0, 1, 2)] + [share(again)] + [share(bits >> k & 1) for k in (3, 4, 5)] + [(n < 20).astype(float)]
        return hashes, offsets, np.stack(cols, 1)


LANGS, SOURCES, LENGTHS = 16, 64, 24
CELLS = LANGS * SOURCES * LENGTHS


@lru_cache(maxsize=100_000)
def _bucket(value: str | None, of: int) -> int:
    return _hash(str(value)) % of


def cells(lang: list, source: list, length: list) -> np.ndarray:
    """The cell of metadata of each row: hashed language, hashed source, magnitude of the length."""
    return np.array([(_bucket(a, LANGS) * SOURCES + _bucket(b, SOURCES)) * LENGTHS + min(LENGTHS - 1, int(n or 0).bit_length()) for a, b, n in zip(lang, source, length)], np.int32)


def _metadata(cell: np.ndarray) -> np.ndarray:
    """Indicators of a cell's language, source and length."""
    out, at = np.zeros((len(cell), LANGS + SOURCES + LENGTHS)), np.arange(len(cell))
    out[at, cell // (SOURCES * LENGTHS)] = 1
    out[at, LANGS + cell // LENGTHS % SOURCES] = 1
    out[at, LANGS + SOURCES + cell % LENGTHS] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log loss; the intercept stands last."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    p = _sigmoid(x @ w)
    return x.T @ (weight * (p - y)), (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x


@dataclass
class Logistic:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def step(self, grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> float:
        """A step of Newton's method; the intercept is free of the penalty. The largest change of a weight."""
        damp = np.full(len(grad), ridge)
        damp[-1] = 1e-6
        change = np.linalg.solve(hess + np.diag(damp), grad + damp * self.weights)
        most = float(np.abs(change).max())
        self.weights = self.weights - change * min(1.0, 10 / (most + 1e-12))
        return most

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.weights = np.zeros(x.shape[1] + 1)
        for _ in range(steps):
            if self.step(*_sums(x, y, weight, self.weights), ridge) < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]


@dataclass
class CoTrained:
    """One label's model. vocabulary: sorted hashes of the words that its text view knows."""

    vocabulary: np.ndarray
    text: Logistic
    meta: Logistic
    platt_text: Logistic
    platt_meta: Logistic
    both: Logistic

    def columns(self, known: np.ndarray) -> np.ndarray:
        """Where its features stand among those of all known words."""
        return np.concatenate([np.searchsorted(known, self.vocabulary), len(known) + np.arange(2 * len(SHAPES))])

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """text: features of its words and shapes; meta: the metadata view's logits."""
        t, m = self.platt_text.logit(self.text.logit(text)[:, None]), self.platt_meta.logit(meta[:, None])
        return _sigmoid(self.both.logit(np.stack([t, m], 1)))


def _constant(rate: float) -> CoTrained:
    flat = Logistic(np.zeros(2))
    fixed = Logistic(np.array([0.0, 0.0, np.log((rate + 1e-3) / (1 - rate + 1e-3))]))
    return CoTrained(np.zeros(0, np.int64), Logistic(np.zeros(2 * len(SHAPES) + 1)), Logistic(np.zeros(LANGS + SOURCES + LENGTHS + 1)), flat, flat, fixed)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def features(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(doc_id, cell of metadata, places of the text's words among the known ones, shares of odd shapes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in slices(batches, "text"):
            hashes, offsets, shares = reader.read(b.column(1))
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = np.flatnonzero(known[at] == hashes) if len(known) else np.zeros(0, np.int64)
            owner = np.searchsorted(offsets, hit, side="right") - 1
            pair = np.unique(owner * (len(known) + 1) + at[hit])
            ends = np.searchsorted(pair, np.arange(b.num_rows + 1) * (len(known) + 1))
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pair % (len(known) + 1), pa.int16()))
            shapes = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(SHAPES), pa.int32()), pa.array(shares.ravel(), pa.float32()))
            yield pa.record_batch([b.column(0), pa.array(cells(*[b.column(k).to_pylist() for k in (2, 3, 4)])), words, shapes], ["doc_id", "cell", "words", "shapes"])

    return _rows(docs).mapInArrow(run, "doc_id long, cell int, words array<smallint>, shapes array<float>")


def _matrix(words: pa.Array, shapes: pa.Array, known: int) -> np.ndarray:
    n, k = len(words), len(SHAPES)
    shares = shapes.flatten().to_numpy(zero_copy_only=False).reshape(n, k)
    out = np.zeros((n, known + 2 * k), np.float32)
    out[np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False)), words.flatten().to_numpy(zero_copy_only=False)] = 1
    out[:, known : known + k] = 10 * shares
    out[:, known + k :] = shares > 0.1
    return out


def _vocabularies(docs: DataFrame, some: DataFrame, targets: tuple[str, ...], words: int) -> dict[str, np.ndarray]:
    """Per label the words whose presence in labelled rows departs most from the label's rate (a z-score above 3), in five
    rows at least. Counted on the executors.
    """
    schema = f"word long, {', '.join(f'{t} int' for t in targets)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in slices(batches, "text"):
            hashes, offsets, _ = reader.read(b.column(0))
            lists = [np.append(np.unique(hashes[a:z]), -1) for a, z in zip(offsets[:-1], offsets[1:])]  # -1: the row itself
            owner = pa.array(np.repeat(np.arange(b.num_rows), [len(w) for w in lists]))
            yield pa.record_batch([pa.array(np.concatenate(lists), pa.int64()), *[b.column(1 + k).take(owner) for k in range(len(targets))]], ["word", *targets])

    own = _rows(docs).join(F.broadcast(some.where("NOT held")), "doc_id").select("text", *targets)
    table = written(own.mapInArrow(run, schema).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in targets]).where("n >= 5 OR word = -1"))
    every, out = table.where("word = -1").collect(), {}
    for t in targets:
        rate = every[0][t] / every[0]["n"] if every else 0.5
        z = F.abs(F.col(t) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 0.5)
        best = table.where("word >= 0").select("word", z.alias("z")).where("z > 3").orderBy(F.desc("z"), "word").limit(words)
        out[t] = np.sort(np.array([r.word for r in best.collect()], np.int64))
    discard(docs.sparkSession, table_path(table))
    return out


def _text_sums(pool: DataFrame, known: int, asked: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian over all rows of pool for each (columns, weights, label of each cell, weight of each cell). A
    partition gives one row, and these are added up in two steps.
    """
    sizes = [len(c) + 1 for c, *_ in asked]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(d), np.zeros((d, d))) for d in sizes]
        for b in batches:
            cell = b.column(0).to_numpy()
            x = _matrix(b.column(1), b.column(2), known)
            for k, (columns, w, label, weight) in enumerate(asked):
                at = np.flatnonzero(weight[cell])
                if len(at):
                    g, h = _sums(x[np.ix_(at, columns)], label[cell[at]], weight[cell[at]], w)
                    total[k] = (total[k][0] + g, total[k][1] + h)
        yield pa.record_batch([pa.array([np.concatenate([np.append(g, h[np.triu_indices(len(g))]) for g, h in total]).tobytes()])], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            for v in b.column(0):
                total = total + np.frombuffer(v.as_buffer())
        if not np.isscalar(total):
            yield pa.record_batch([pa.array([total.tobytes()])], ["sums"])

    got = pool.select("cell", "words", "shapes").mapInArrow(partial, "sums binary").repartition(ADDERS).mapInArrow(add, "sums binary").repartition(1).mapInArrow(add, "sums binary").collect()  # one row
    flat, out = np.frombuffer(got[0].sums) if got else np.zeros(sum(d + d * (d + 1) // 2 for d in sizes)), []
    for d in sizes:
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = flat[d : d + d * (d + 1) // 2]
        out.append((flat[:d], h + np.triu(h, 1).T))
        flat = flat[d + d * (d + 1) // 2 :]
    return out


def _sure_cells(pool: DataFrame, known: int, views: list[tuple[np.ndarray, Logistic]]) -> np.ndarray:
    """[view, label, cell]: documents of pool in a cell for whose label a text view is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(views) * 2 * CELLS, np.int64)
        for b in batches:
            cell = b.column(0).to_numpy().astype(np.int64)
            x = _matrix(b.column(1), b.column(2), known)
            for k, (columns, model) in enumerate(views):
                p = _sigmoid(model.logit(x[:, columns]))
                for label, at in ((1, p >= SURE), (0, p <= 1 - SURE)):
                    seen[(2 * k + label) * CELLS : (2 * k + label + 1) * CELLS] += np.bincount(cell[at], minlength=CELLS)
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(at), pa.array(seen[at])], ["at", "n"])

    out = np.zeros(len(views) * 2 * CELLS)
    for r in pool.select("cell", "words", "shapes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most a row for each view, label and cell
        out[r.at] = r.n
    return out.reshape(len(views), 2, CELLS)


def _handed(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of handed documents by label: those of a label weigh as much as the labelled rows of that label at most."""
    n, own = counts.sum(axis=1), np.array([np.sum(y == 0), np.sum(y == 1)])
    return np.minimum(1.0, own / np.maximum(n, 1))


def fit(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), max_labelled: int = MAX_LABELLED, words: int = WORDS, rounds: int = ROUNDS) -> tuple[dict[str, CoTrained], DataFrame, np.ndarray]:
    """(models, features of all docs as a table, known words). At most max_labelled labelled documents are chosen, by a
    hash of the id; a fifth of them, by another, is held out. All other documents are the unlabelled ones. Rows without an
    id or a label are left out; of several labels for an id the least counts, and so does the least of several documents.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit("co-training")), F.lit(1 << 20))
    chosen = labels.where(" AND ".join(f"{t} IS NOT NULL" for t in ("doc_id", *targets))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.min(t).cast("int").alias(t) for t in targets])
    n = chosen.count()
    some = chosen.where(h < int((1 << 20) * min(1.0, 0.9 * max_labelled / max(n, 1)))).orderBy(h, "doc_id").limit(max_labelled)
    some = written(some.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(5)) == 0))
    vocabularies = _vocabularies(docs, some, targets, words)
    known = np.unique(np.concatenate(list(vocabularies.values())))
    table = written(features(docs, known))
    bounded = F.broadcast(some)  # max_labelled rows at most
    rows = table.join(bounded, "doc_id").groupBy("doc_id").agg(F.min(F.struct("cell", "words", "shapes", "held", *targets)).alias("r")).select("doc_id", "r.*").toArrow().combine_chunks().sort_by([("doc_id", "ascending")])
    pool = table.join(bounded, "doc_id", "left_anti")
    held, cell = rows.column("held").to_numpy().astype(bool), rows.column("cell").to_numpy()
    text = _matrix(rows.column("words").combine_chunks(), rows.column("shapes").combine_chunks(), len(known)) if len(rows) else np.zeros((0, len(known) + 2 * len(SHAPES)))
    meta, every = _metadata(cell), _metadata(np.arange(CELLS))
    ys = {t: rows.column(t).to_numpy().astype(float) for t in targets}
    models = {t: _constant(float(np.mean(ys[t])) if len(rows) else 0.5) for t in targets}
    able = [t for t in targets if len(set(ys[t][~held].tolist())) == 2]
    for t in able:
        models[t].vocabulary = vocabularies[t]
        models[t].text = Logistic().fit(text[~held][:, models[t].columns(known)], ys[t][~held])
        models[t].meta = Logistic().fit(meta[~held], ys[t][~held])
    total = np.zeros(CELLS)
    if able:
        for r in pool.groupBy("cell").count().collect():  # at most a row for each cell
            total[r[0]] = r[1]
    for _ in range(rounds if total.any() else 0):
        sure = _sure_cells(pool, len(known), [(models[t].columns(known), models[t].text) for t in able])
        handed = []
        for t in able:
            p = _sigmoid(models[t].meta.logit(every))
            counts = np.stack([np.where(p <= 1 - SURE, total, 0), np.where(p >= SURE, total, 0)])
            weight = _handed(counts, ys[t][~held])
            handed.append(((p >= SURE).astype(float), np.where(p >= SURE, weight[1], np.where(p <= 1 - SURE, weight[0], 0.0))))
        for _ in range(STEPS):
            sums = _text_sums(pool, len(known), [(models[t].columns(known), models[t].text.weights, *c) for t, c in zip(able, handed)])
            for t, (g, hess) in zip(able, sums):
                own = _sums(text[~held][:, models[t].columns(known)], ys[t][~held], np.ones(int(np.sum(~held))), models[t].text.weights)
                models[t].text.step(g + own[0], hess + own[1])
        for t, counts in zip(able, sure):
            weight = _handed(counts, ys[t][~held])
            at = [np.flatnonzero(c) for c in counts]
            models[t].meta = Logistic().fit(
                np.concatenate([meta[~held], *[every[a] for a in at]]),
                np.concatenate([ys[t][~held], np.zeros(len(at[0])), np.ones(len(at[1]))]),
                np.concatenate([np.ones(int(np.sum(~held))), *[w * c[a] for w, c, a in zip(weight, counts, at)]]),
            )
    for t in able:
        m, y = models[t], ys[t][held]
        a, b = m.text.logit(text[held][:, m.columns(known)]), m.meta.logit(meta[held])
        m.platt_text, m.platt_meta = Logistic().fit(a[:, None], y, ridge=0.01), Logistic().fit(b[:, None], y, ridge=0.01)
        m.both = Logistic().fit(np.stack([m.platt_text.logit(a[:, None]), m.platt_meta.logit(b[:, None])], 1), y, ridge=0.1)
    discard(docs.sparkSession, table_path(some))
    return models, table, known


def scored_features(table: DataFrame, known: np.ndarray, models: dict[str, CoTrained]) -> DataFrame:
    """(doc_id, p_<label> for each model, kept) from features()."""
    names = list(models)
    metas = {t: _metadata(np.arange(CELLS)) @ m.meta.weights[:-1] + m.meta.weights[-1] for t, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell = _matrix(b.column(2), b.column(3), len(known)), b.column(1).to_numpy()
            p = {t: m.score(x[:, m.columns(known)], metas[t][cell]) for t, m in models.items()}
            kept = np.ones(b.num_rows, bool)
            for t in names:
                kept &= p[t] < 0.5 if t == "toxic" else p[t] >= 0.5
            yield pa.record_batch([b.column(0), *[pa.array(p[t]) for t in names], pa.array(kept)], ["doc_id", *[f"p_{t}" for t in names], "kept"])

    return table.select("doc_id", "cell", "words", "shapes").mapInArrow(run, f"doc_id long, {', '.join(f'p_{t} double' for t in names)}, kept boolean")


def scored(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """(doc_id, p_<label> for each model, kept): kept where good quality is likelier than not and toxicity is not. Null
    columns count as empty; each row is scored, repeated ones too.
    """
    known = np.unique(np.concatenate([m.vocabulary for m in models.values()]))
    return scored_features(features(docs, known), known, models)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """scored() with models fitted on labels and docs. Without both values of a label among the labelled rows, its rate is
    the score. The table of features that the result reads stays in the shared folder.
    """
    models, table, known = fit(docs, labels)
    return scored_features(table, known, models)

"""Quality classifier by co-training (Blum and Mitchell 1998).

One view is the text's content (hashed byte trigrams), the other the page's metadata: language, source, length and
layout. From a labelled sample either view learns a logistic classifier; over some rounds each scores all unlabelled
documents and gives its most confident guesses to the other as labels. Both are calibrated on labelled rows that were held back, and
the calibrated views together score every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, linear

PER_CLASS = 1500  # labelled documents of each class
ROUNDS, GIVEN = 4, 60  # guesses that a view gives in a round, half of them of each class
DIMS, HASHED = 2048, 32
SLICE = 1 << 20
LAYOUT = 12


def content(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, as root shares."""
    counts = np.zeros(DIMS)
    for at in range(0, len(text), SLICE):
        a = np.frombuffer(text[at : at + SLICE + 2], np.uint8).astype(np.uint32)
        if len(a) > 2:
            counts += np.bincount(((a[:-2] * 0x9E3779B1 + a[1:-1] * 0x85EBCA77 + a[2:] * 0xC2B2AE3D) >> 15) % DIMS, minlength=DIMS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def metadata(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """Length and layout figures, then the hashed language and source."""
    a = np.frombuffer(text, np.uint8)
    n = max(1, len(a))
    kinds = np.bincount(a, minlength=256)
    share = lambda *ranges: sum(kinds[i:j].sum() for i, j in ranges) / n
    letters = max(1e-9, share((65, 91), (97, 123), (128, 256)))
    lines = int(kinds[10]) + 1
    words = int(kinds[32]) + lines
    out = np.zeros(LAYOUT + 2 * HASHED)
    out[:LAYOUT] = [
        np.log1p(len(a)), share((65, 91)) / letters, share((48, 58)), np.sqrt(share((33, 48), (58, 65), (91, 97), (123, 127))), np.sqrt(share((33, 34))), np.sqrt(share((124, 125))),
        share((0, 33)), np.log1p(lines), np.log1p(len(a) / lines), np.log1p(len(a) / words), float((kinds > 0).sum()) / 256, np.sqrt(share((44, 45), (46, 47))),
    ]
    for i, name in enumerate((lang, source)):
        out[LAYOUT + i * HASHED + zlib.crc32((name or "").encode()) % HASHED] = 1
    return out


class View:
    """A standardised logistic classifier with its calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(x.dtype)
        self.w, self.b = linear.logistic((x - self.mean) / self.sd, y, weight, l2=1e-2, steps=200, rate=0.03)
        self.scale = 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scale[0] * ((x - self.mean) / self.sd @ self.w + self.b) + self.scale[1]

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        w, b = linear.logistic(self.margin(x)[:, None], y, weight, l2=1e-4)
        self.scale = float(w[0]), b


class Classifier:
    """The two views and the weights of their calibrated margins."""

    def __init__(self, views: list[View] | None, mix: np.ndarray, bias: float):
        self.views, self.mix, self.bias = views, mix, bias

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        """(3, n): of the views, and of both."""
        if self.views is None:
            return np.full((3, len(xs[0])), float(linear.sigmoid(np.array(self.bias))))
        z = np.array([v.margin(x) for v, x in zip(self.views, xs)])
        return linear.sigmoid(np.vstack((z, self.mix @ z + self.bias)))


def cotrain(xs: list[np.ndarray], y: np.ndarray, held: np.ndarray, share: float, guess, rounds: int = ROUNDS) -> Classifier:
    """y: 1 or 0; held: rows that only calibrate. guess(views, given), where given[v] are the ids that view v was given
    before, returns for each view what it is given now: ids, labels and features of that view."""
    known, own = ~held, y[held]
    if not 0 < y[known].sum() < known.sum() or not 0 < own.sum() < len(own):
        return Classifier(None, np.zeros(2), float(np.log(share / (1 - share))))
    views, given = [View(), View()], [[], []]
    learnt = [(x[known], y[known]) for x in xs]
    for turn in range(rounds + 1):
        for view, (x, label) in zip(views, learnt):
            view.fit(x, label)
        if turn == rounds:
            break
        for v, (ids, labels, x) in enumerate(guess(views, given)):
            given[v] += ids
            learnt[v] = np.concatenate((learnt[v][0], x)), np.append(learnt[v][1], labels)
    weight = np.where(own == 1, share / own.sum(), (1 - share) / (len(own) - own.sum()))  # as frequent as among all labels
    for view, x in zip(views, xs):
        view.calibrate(x[held], own, weight)
    z = np.array([v.margin(x[held]) for v, x in zip(views, xs)])
    mix, bias = linear.logistic(z.T, own, weight, l2=1e-4)
    return Classifier(views, mix, bias)


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))


def _features(batch) -> list[np.ndarray]:
    texts, langs, sources = (batch.column(i).to_pylist() for i in (1, 2, 3))
    return [np.array([content(t) for t in texts]).reshape(-1, DIMS), np.array([metadata(*x) for x in zip(texts, langs, sources)]).reshape(-1, LAYOUT + 2 * HASHED)]


def _stored_features(rows: DataFrame) -> DataFrame:
    """(id, c binary, m binary, ...): the features of either view as bytes, with the columns after the four of _rows."""
    rest = [f for f in rows.schema.fields[4:]]

    def run(batches):
        for b in batches:
            xs = [x.astype(np.float32) for x in _features(b)]
            bytes_ = [pa.array([r.tobytes() for r in x], pa.binary()) for x in xs]
            yield pa.RecordBatch.from_arrays([b.column(0), *bytes_, *(b.column(4 + i) for i in range(len(rest)))], ["id", "c", "m", *(f.name for f in rest)])

    return rows.mapInArrow(run, "id long, c binary, m binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest))


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), dims)


def _guesses(rows: DataFrame, labels: DataFrame, each: int):
    """What cotrain() asks for: in each round all unlabelled documents are scored by both views, and of each view and
    class the `each` surest ones (of an id with several rows, by its mean margin) go to the other view."""
    spark = rows.sparkSession

    def guess(views: list[View], given: list[list[int]]):
        shared = spark.sparkContext.broadcast(views)

        def run(batches):
            for b in batches:
                z = [v.margin(x) for v, x in zip(shared.value, _features(b))]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, z)], ["id", "z0", "z1"])

        margins = rows.where("id is not null").mapInArrow(run, "id long, z0 double, z1 double")
        margins = margins.join(labels.select(F.col("doc_id").cast("long").alias("id")), "id", "left_anti")
        margins = common.stored(margins.groupBy("id").agg(F.avg("z0").alias("z0"), F.avg("z1").alias("z1")))
        wanted: list[dict[int, int]] = []  # for each view, from the other one
        for v in (0, 1):
            free, z = margins.where(~F.col("id").isin(given[v])) if given[v] else margins, F.col(f"z{1 - v}")
            bad = free.where(z < 0).orderBy(z, "id").limit(each).collect()
            good = free.where(z > 0).orderBy(-z, "id").limit(each).collect()
            wanted.append({r.id: 0 for r in bad} | {r.id: 1 for r in good})
        ids = sorted(set(wanted[0]) | set(wanted[1]))
        chosen = rows.where(F.col("id").isin(ids)) if ids else rows.limit(0)
        got = _stored_features(chosen).groupBy("id").agg(F.min(F.struct("c", "m")).alias("x")).select("id", "x.c", "x.m").collect()
        shared.destroy()
        at = {r.id: r for r in got}
        for v, (name, dims) in enumerate((("c", DIMS), ("m", LAYOUT + 2 * HASHED))):
            own = [i for i in wanted[v] if i in at]
            yield own, [wanted[v][i] for i in own], _matrix([at[i][name] for i in own], dims)

    return guess


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rounds: int = ROUNDS, given: int = GIVEN, **columns) -> Classifier:
    """Learns from at most `per_class` labelled documents of each class, of which a quarter calibrates, and from `given`
    guesses of each view in each round, taken from all unlabelled documents. The features of these rows only come to the
    driver."""
    wanted = linear.sampled(labels, "quality", per_class)
    share = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    share = min(max(0.5 if share is None else float(share), 1e-3), 1 - 1e-3)
    rows = _rows(docs, **columns)
    chosen = wanted.select(F.col("doc_id").alias("id"), "label")
    sample = rows.join(F.broadcast(chosen), "id").select("id", "text", "lang", "source", "label", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)).alias("q"))
    got = _stored_features(sample).toPandas()
    xs = [_matrix(got["c"], DIMS), _matrix(got["m"], LAYOUT + 2 * HASHED)]
    return cotrain(xs, got["label"].to_numpy(), got["q"].to_numpy() == 0, share, _guesses(rows, labels, given // 2), rounds)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, content_score, metadata_score, score, keep (score >= 0.5) for each row of docs.

    Null texts count as empty, null language or source as a name of its own; labels that are null or not 0 or 1 are not
    learnt from. Without labels of both classes every document has the share of good ones as its score, or 0.5.
    """
    common.small_batches(docs.sparkSession)
    columns = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, **columns))

    def run(batches):
        for batch in batches:
            s = model.value.scores(_features(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in s)], ["doc_id", "content_score", "metadata_score", "score"])

    out = _rows(docs, **columns).mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double")
    return out.withColumn("keep", F.col("score") >= 0.5)


def good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that the classifier doesn't reject (score >= 0.5), with all columns as they were; no shuffle."""
    common.small_batches(docs.sparkSession)
    columns = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, **columns))
    at = [docs.columns.index(c) for c in (id_col, text_col, lang_col, source_col)]

    def run(batches):
        for batch in batches:
            own = [batch.column(i) for i in at]
            own[1] = pa.array([(t or "").encode() for t in own[1].to_pylist()], pa.binary())
            keep = model.value.scores(_features(pa.RecordBatch.from_arrays(own, ["id", "text", "lang", "source"])))[2] >= 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)

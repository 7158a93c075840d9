"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

Score of a sparse row x: sigmoid(bias + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)),
so all pairwise interactions cost time linear in the row. Features of a text: hashed words, each
weighted by the root of its share; and binned statistics of its bytes and words (symbols, capitals,
digits, line ends, repeats, word length, sizes), one feature per bin. The only metadata is the size in
characters; language, source, ids and labels are never read by a score.

Labels are joined to documents, and a sample of at most ``max_rows`` labelled ids (the first in order of
a hash; the default bound is MAX_ROWS) is fitted in one task by AdaGrad, one row an id, in a fixed order,
so that the same rows give the same model. The model has a fixed size; it goes to the driver and out
again to score every document, whole. A score is one column: only texts and sizes go to Python, and only
a number comes back.

Defined cases: null and empty texts have the statistics of an empty text and get a score like any other;
a null id counts as held out, as the text "" would; null labels are not used, of several labels of a
document the largest counts; of several documents with one labelled id one is fitted, the greatest by its
features; without any usable label the score is 1 for all; an empty table gives an empty result. Of other
columns only n_chars is read, and it may be absent or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplolake.llm.minhash import mixed, word_hashes
from haplolake.llm.ragged import offsets_of, slices, utf8_bytes

MAX_ROWS = 12_000
WORD_BUCKETS, BINS, FACTORS = 1 << 13, 24, 8
CUT = 0.3
SLICE_BYTES = 1_000_000
_SYMBOLS = [ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]
_STATS = 14


def held_out(id_col: Column) -> Column:
    """Rows kept from fitting: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _bin(x: np.ndarray) -> np.ndarray:
    """Bin of a share or mean: finer near 0, four bins an octave at most."""
    return np.clip(np.log2(1 + 64 * x) * 3, 0, BINS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: row index (ascending), feature, value."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    hist = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256)
    h, at = word_hashes(data, offsets)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    _, first, count = np.unique(h + mixed(doc.astype(np.uint64)), return_index=True, return_counts=True)
    order = np.argsort(doc[first], kind="stable")
    first, count = first[order], count[order]
    of = doc[first]
    some = np.maximum(words, 1)
    again = np.zeros(n, dtype=np.int64)
    if len(h) > 1:
        again += np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, of, count)
    upper, lower = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1)
    stats = [
        hist[:, _SYMBOLS].sum(1) / some,
        hist[:, ord("|")] / some,
        upper / np.maximum(upper + lower, 1),
        hist[:, ord("!")] / some,
        (hist[:, ord(".")] + hist[:, ord(",")]) / some,
        hist[:, 48:58].sum(1) / np.maximum(size, 1),
        hist[:, 10] / some,
        np.bincount(of, minlength=n) / some,
        again / some,
        top / some,
        (size - hist[:, [9, 10, 11, 12, 13, 32]].sum(1)) / some / 16,
        np.log2(1 + words) / 64 * 8,
        np.log2(1 + np.maximum(n_chars, 0)) / 64 * 8,
        (hist[:, :9].sum(1) + hist[:, 14:32].sum(1)) / np.maximum(size, 1),
    ]
    binned = np.stack([_bin(s) for s in stats], axis=1) + np.arange(_STATS) * BINS + WORD_BUCKETS
    row = np.concatenate([np.repeat(np.arange(n), _STATS), of])
    feature = np.concatenate([binned.reshape(-1), (h[first] % np.uint64(WORD_BUCKETS)).astype(np.int64)])
    value = np.concatenate([np.full(n * _STATS, 0.5), 0.5 * np.sqrt(count / some[of])])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


N_FEATURES = WORD_BUCKETS + _STATS * BINS


class FactorisationMachine:
    """Parameters w (features), v (features x factors) and bias."""

    def __init__(self, w: np.ndarray, v: np.ndarray, bias: float) -> None:
        self.w, self.v, self.bias = w, v, bias

    def logits(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every row, and the factor sums that its gradient needs."""
        linear = np.bincount(row, weights=self.w[feature] * value, minlength=n)
        sums, pairs = np.empty((n, self.v.shape[1])), np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[feature, f] * value
            sums[:, f] = np.bincount(row, weights=x, minlength=n)
            pairs += sums[:, f] ** 2 - np.bincount(row, weights=x * x, minlength=n)
        return self.bias + linear + pairs / 2, sums

    def scores(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = self.logits(row, feature, value, n)[0]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 900, batch: int = 128, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
        """rows: (features, values) of each example, in a fixed order. Small samples are passed more often, up to ``steps`` batches."""
        rng = np.random.default_rng(seed)
        model = cls(np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, FACTORS)), 0.0)
        if not len(labels) or labels.min() == labels.max():
            model.v[:] = 0
            model.bias = 40.0 if not len(labels) or labels.max() else -40.0
            return model
        share = labels.mean()
        model.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, FACTORS), 1e-3), 1e-3
        for _ in range(min(200, max(6, -(-steps * batch // len(labels))))):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                n = len(chosen)
                feature, value = (np.concatenate([rows[i][j] for i in chosen]) for j in (0, 1))
                row = np.repeat(np.arange(n), [len(rows[i][0]) for i in chosen])
                z, sums = model.logits(row, feature, value, n)
                error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[chosen]) / n
                used, back = np.unique(feature, return_inverse=True)
                g = np.bincount(back, weights=error[row] * value) + decay * model.w[used]
                seen_w[used] += g * g
                model.w[used] -= rate * g / np.sqrt(seen_w[used])
                for f in range(FACTORS):
                    x = error[row] * value * (sums[row, f] - model.v[feature, f] * value)
                    g = np.bincount(back, weights=x) + decay * model.v[used, f]
                    seen_v[used, f] += g * g
                    model.v[used, f] -= rate / 2 * g / np.sqrt(seen_v[used, f])
                g = error.sum()
                seen_b += g * g
                model.bias -= rate * g / np.sqrt(seen_b)
        return model

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.bias], self.w, self.v.reshape(-1)]).astype(np.float64).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FactorisationMachine:
        x = np.frombuffer(raw, dtype=np.float64)
        return cls(x[1 : 1 + N_FEATURES], x[1 + N_FEATURES :].reshape(N_FEATURES, FACTORS), float(x[0]))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    chars = F.coalesce(docs["n_chars"].cast("long"), F.length(text)) if "n_chars" in docs.columns else F.length(text)
    return [docs[id_col].cast("long").alias("_id"), text.alias("_text"), chars.cast("long").alias("_chars")]


def _rows_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offs = utf8_bytes(part.column("_text"))
    return features(data, offs, part.column("_chars").to_numpy())


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on labelled rows that are not held out: those of at most max_rows ids, chosen by a hash of the id."""
    usable = labels.select(F.col(id_col).cast("long").alias("_key"), F.col(label_col).cast("double").alias("_label")).filter("_key IS NOT NULL AND _label IS NOT NULL")
    usable = usable.filter(~held_out(F.col("_key"))).groupBy("_key").agg(F.max("_label").alias("_label"))
    chosen = usable.orderBy(F.xxhash64("_key"), "_key").limit(max_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                row, feature, value = _rows_of(part)
                order = np.lexsort((value, feature, row))  # the same list whatever rows share its batch
                feature, value = feature[order], value[order]
                at = pa.array(offsets_of(np.bincount(row, minlength=len(part))), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (feature.astype(np.int16), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), *lists], names=["id", "label", "feature", "value"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        feature, value = (table.column(c).combine_chunks() for c in ("feature", "value"))
        at = feature.offsets.to_numpy()
        flat_f, flat_v = feature.values.to_numpy().astype(np.int64), value.values.to_numpy().astype(np.float64)
        rows = [(flat_f[a:b], flat_v[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({"model": [FactorisationMachine.fit(rows, table.column("label").to_numpy()).to_bytes()]})

    # At most max_rows pairs of numbers, so they are sent to where the documents are.
    joined = docs.select(*_inputs(docs, id_col, text_col)).join(F.broadcast(chosen), F.col("_id") == F.col("_key")).drop("_key")
    listed = joined.mapInArrow(extract, "id long, label double, feature array<smallint>, value array<float>")
    # One row an id, folded before the shuffle too, however many documents share it.
    sample = listed.groupBy("id").agg(F.max(F.struct("label", "feature", "value")).alias("x")).select("id", "x.*")
    found = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fit, "model binary").collect()
    return FactorisationMachine.from_bytes(bytes(found[0].model)) if found else FactorisationMachine.fit([], np.zeros(0))


def score_column(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Score of every row of docs, for use in its select or filter."""
    raw = docs.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fm = FactorisationMachine.from_bytes(raw.value)
        for text, chars in batches:
            batch = pa.RecordBatch.from_arrays([text, chars], names=["_text", "_chars"])
            parts = [fm.scores(*_rows_of(part), len(part)) for part in slices(batch, "_text", SLICE_BYTES)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    _, text, chars = _inputs(docs, id_col, text_col)
    return F.arrow_udf(run, "double")(text, chars)


def score_quality(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """id, held_out, score, predicted (score >= cut) of every row."""
    scored = docs.select(docs[id_col].cast("long").alias(id_col), score_column(docs, model, id_col, text_col).alias("score"))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns, which stay in the JVM."""
    return docs.filter(score_column(docs, model, id_col, text_col) >= cut)

"""Quality classifier: document evidence shrunk through a hierarchy of sites.

Evidence: a naive Bayes score over the words of a document, the beginnings of its words and its
shape (repetition, symbols, length), with the weights of the ``max_features`` most telling
features, learned from at most ``max_rows`` labelled documents. Two heads: low quality, toxic.

Sites: documents belong to a path and a path to a host. Expected bad documents are summed per
path with grouped aggregation, paths per host, hosts overall. Empirical Bayes by moments: how
much hosts differ beyond sampling noise gives the strength of the global prior, likewise paths
inside hosts; a host's posterior is shrunk towards the global rate and a path's towards its
host's. The posterior of the path replaces the classifier's prior in every document's odds.

Defined cases: null or empty texts have the evidence of the shape "empty"; null host or path is a
site of its own; labels without a document, null labels and repeated labels (the worst counts)
are harmless; without labels all evidence is 0 and everything is kept; repeated rows are rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, RangeHashes, joined, mixed, saved, text_slices, word_ranges
from .decontaminate import LOWER

STEMS = (4, 5, 6)  # bytes of a word's beginning that are features of their own
SLICE = 2 << 20
HEADS = ("low", "toxic")


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature hash) pairs, with repeats: words, word beginnings, shape."""
    lower = [t.translate(LOWER) for t in texts]
    data, at = joined(lower)
    breaks = np.zeros(256, bool)
    breaks[[10, 32]] = True
    starts, ends = word_ranges(data, breaks)
    owner = np.searchsorted(at, starts, "right") - 1
    hashes = RangeHashes(data)
    words = hashes.of(starts, ends)
    owners, found = [owner], [words]
    for k in STEMS:
        long = ends - starts >= k
        owners.append(owner[long])
        found.append(hashes.of(starts[long], starts[long] + k, k))
    shape = [_shape(t, words[a:b]) for t, a, b in zip(texts, *_bounds(owner, len(texts)), strict=True)]
    owners.append(np.repeat(np.arange(len(texts)), 3))
    found.append(np.array(shape, U64).reshape(-1))
    return np.concatenate(owners), np.concatenate(found)


def _bounds(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), "right")


def _shape(text: bytes, words: np.ndarray) -> list[int]:
    """Three graded measures as feature hashes: distinct words, symbols and length."""
    n = len(words)
    distinct = len(np.unique(words)) * 20 // n if n else -1
    symbols = sum(text.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    per_word = min(20, 20 * symbols // n) if n else -1
    # Distinct words thin out with length, so their grade goes with it.
    graded = np.array([(distinct + 1) * 64 + n.bit_length(), 10_000 + per_word, 20_000 + n.bit_length()], U64)
    return mixed(graded * U64(0x51) + U64(7)).tolist()


@dataclass
class Weights:
    features: np.ndarray  # sorted hashes
    values: np.ndarray  # (features, heads): log likelihood ratios
    prior: tuple[float, ...]  # log odds of each head among the labelled documents
    scale: tuple[tuple[float, ...], ...] = ()  # per head: of the sum, of the largest, shift

    def __post_init__(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.features & U64((1 << 20) - 1)).astype(np.int64)] = True

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Log likelihood ratios of every text, by head."""
        if not self.scale:
            return np.zeros((len(texts), len(HEADS)))
        total, largest = self.scores(texts)
        a, b, shift = np.array(self.scale).T
        return total * a + largest * b + shift

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sum and largest of the weights of the distinct features of every text, by head."""
        total, largest = np.zeros((2, len(texts), len(HEADS)))
        owner, found = features_of(texts)
        maybe = self.near[(found & U64((1 << 20) - 1)).astype(np.int64)]
        owner, found = owner[maybe], found[maybe]
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        real = self.features[at] == found
        pairs = np.unique(owner[real] * len(self.features) + at[real])
        owner, values = pairs // len(self.features), self.values[pairs % len(self.features)]
        np.add.at(total, owner, values)
        np.maximum.at(largest, owner, values)
        return total, largest

    def calibrated(self, scores: np.ndarray, flags: np.ndarray) -> Weights:
        """The scale that turns scores into log likelihood ratios: features repeat each other's
        evidence. A logistic fit by Newton steps. scores: (rows, heads, sum and largest)."""
        scale = []
        for k, prior in enumerate(self.prior):
            x = np.column_stack([scores[:, k], np.ones(len(scores))])
            ridge = np.array([1.0, 1.0, 0.01])
            beta, loss = np.array([0.0, 0.0, prior]), np.inf
            for _ in range(100):
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
                slope = x.T @ (flags[:, k] - p) - ridge * beta
                step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
                size = 1.0
                while size > 1e-6:  # halve until the penalised loss falls
                    z = x @ (beta + size * step)
                    now = np.logaddexp(0, z).sum() - flags[:, k] @ z + (ridge * (beta + size * step) ** 2).sum() / 2
                    if now <= loss:
                        break
                    size /= 2
                beta, loss = beta + size * step, now
                if np.abs(size * step).max() < 1e-6:
                    break
            scale.append((float(beta[0]), float(beta[1]), float(beta[2] - prior)))
        return Weights(self.features, self.values, self.prior, tuple(scale))


def learned(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 5_000, least_rows: int = 20, least_weight: float = 2.5
) -> Weights:
    """Weights from the ``max_rows`` labelled documents with the smallest MD5 of doc_id.

    Counts per feature are aggregated by Spark; what reaches the driver is ``max_features`` rows.
    """
    bad = F.max(F.when(F.col("quality") == 0, 1).otherwise(0)), F.max(F.coalesce(F.col("toxic"), F.lit(0)))
    chosen = (
        labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy("doc_id").agg(bad[0].alias("low"), bad[1].cast("int").alias("toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    )
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = np.column_stack([batch.column(h).to_numpy(zero_copy_only=False) for h in HEADS])
            for some, texts in text_slices(range(len(flags)), batch.column("text").to_pylist(), SLICE):
                owner, found = features_of(texts)
                pairs = pd.DataFrame({"doc": owner, "feature": found.view(np.int64)}).drop_duplicates()
                values = flags[np.array(some)][pairs["doc"].to_numpy()]
                frame = pd.DataFrame({"feature": pairs["feature"], "n": 1, "low": values[:, 0], "toxic": values[:, 1]})
                yield pa.RecordBatch.from_pandas(
                    frame.groupby("feature", as_index=False).sum().astype("int64"), preserve_index=False
                )

    counts = rows.select("text", *HEADS).mapInArrow(count, "feature long, n long, low long, toxic long")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in HEADS]).first()
    prior = tuple(float(np.log((totals[h] + 0.5) / (totals["n"] - totals[h] + 1.5))) for h in HEADS)

    def ratio(head: str) -> Column:
        yes, no = totals[head] + 1.0, totals["n"] - totals[head] + 1.0
        return F.log((F.col(head) + 0.5) / yes) - F.log((F.col("n") - F.col(head) + 0.5) / no)

    weights = (
        counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *HEADS)]).filter(F.col("n") >= least_rows)
        .select("feature", "n", *[F.when(F.abs(ratio(h)) >= least_weight, ratio(h)).otherwise(0.0).alias(h) for h in HEADS])
        .filter("low != 0 or toxic != 0")
        .orderBy(F.desc(F.greatest(F.abs("low"), F.abs("toxic")) * F.log1p("n")), "feature").limit(max_features).collect()
    )
    keys = np.array([w.feature for w in weights], np.int64).view(U64)
    order = np.argsort(keys)
    values = np.array([[w.low, w.toxic] for w in weights], float).reshape(-1, len(HEADS))
    raw = Weights(keys[order], values[order], prior)
    if not len(keys):
        return raw
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, largest = shared.value.scores(batch.column("text").to_pylist())
            values = [*total.T, *largest.T, *(batch.column(h).to_numpy(zero_copy_only=False).astype(float) for h in HEADS)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], list("abcdef"))

    seen = rows.select("text", *HEADS).mapInArrow(score, ", ".join(f"{c} double" for c in "abcdef")).toPandas()  # max_rows rows
    scores = np.stack([seen[["a", "b"]].to_numpy(), seen[["c", "d"]].to_numpy()], axis=2)
    return raw.calibrated(scores, seen[["e", "f"]].to_numpy())


def scored(docs: DataFrame, weights: Weights, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the evidence of both heads; texts are read once and left behind."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # max_features rows
    rows = docs.select(
        "doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.evidence(texts) for _, texts in text_slices(range(batch.num_rows), batch.column("text").to_pylist(), SLICE)]
            values = np.concatenate(got) if got else np.zeros((0, len(HEADS)))
            columns = [batch.column(c) for c in ("doc_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, values.T)], ["doc_id", "host", "path", "low", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, host string, path string, low double, toxic double")


def probability(log_odds: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(log_odds, F.lit(50.0)), F.lit(-50.0))))


def strength(mean: Column, spread: Column, noise: Column) -> Column:
    """Prior rows of a Beta whose variance is what sites differ beyond sampling noise."""
    between = F.greatest(spread - noise, mean * (1 - mean) * 1e-4)
    return F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0))


def sites(rows: DataFrame, prior: tuple[float, ...]) -> DataFrame:
    """host, path and the posterior rate of every head, shrunk path -> host -> all."""
    expected = [F.sum(probability(F.col(h) + p)).alias(h) for h, p in zip(HEADS, prior, strict=True)]
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *expected)
    paths = saved(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(h).alias(f"host_{h}") for h in HEADS])
    everything = hosts.agg(
        F.sum("host_n").alias("all_n"),
        *[(F.sum(f"host_{h}") / F.sum("host_n")).alias(f"all_{h}") for h in HEADS],
        *[F.coalesce(F.var_samp(F.col(f"host_{h}") / F.col("host_n")), F.lit(0.0)).alias(f"spread_{h}") for h in HEADS],
        F.avg(1 / F.col("host_n")).alias("thin"),
    )
    hosts = hosts.join(F.broadcast(everything))  # one row
    hosts = hosts.select(
        "host", "host_n", *[f"host_{h}" for h in HEADS],
        *[
            _shrunk(F.col(f"host_{h}"), F.col("host_n"), F.col(f"all_{h}"),
                    strength(F.col(f"all_{h}"), F.col(f"spread_{h}"), F.col(f"all_{h}") * (1 - F.col(f"all_{h}")) * F.col("thin"))).alias(f"rate_{h}")
            for h in HEADS
        ],
    )
    both = paths.join(hosts, paths.host.eqNullSafe(hosts.host), "left").drop(hosts.host)
    inside = both.agg(
        *[F.coalesce(F.avg((F.col(h) / F.col("n") - F.col(f"rate_{h}")) ** 2), F.lit(0.0)).alias(f"inner_{h}") for h in HEADS],
        F.coalesce(F.avg(1 / F.col("n")), F.lit(1.0)).alias("inner_thin"),
    )
    both = both.join(F.broadcast(inside))  # one row
    return both.select(
        "host", "path",
        *[
            _shrunk(F.col(h), F.col("n"), F.col(f"rate_{h}"),
                    strength(F.col(f"rate_{h}"), F.col(f"inner_{h}"), F.col(f"rate_{h}") * (1 - F.col(f"rate_{h}")) * F.col("inner_thin"))).alias(f"site_{h}")
            for h in HEADS
        ],
    )


def _shrunk(bad: Column, n: Column, centre: Column, rows: Column) -> Column:
    return (bad + centre * rows) / (n + rows)


def classified(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, threshold: float = 0.5, salts: int = 32, **fit
) -> DataFrame:
    """doc_id, host, path, evidence, site posteriors, p_low, p_toxic and kept of every document."""
    weights = learned(docs, labels, **fit)
    rows = saved(scored(docs, weights, host, path))
    posts = sites(rows, weights.prior)
    # A host may hold a third of all rows: its site row meets them in ``salts`` places.
    posts = posts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))
    key = rows.host.eqNullSafe(posts.host) & rows.path.eqNullSafe(posts.path) & (rows.salt == posts.salt)
    merged = rows.join(posts, key, "left").select(rows["*"], *[posts[f"site_{h}"] for h in HEADS])
    odds = {h: F.col(h) + F.log(F.col(f"site_{h}") / (1 - F.col(f"site_{h}"))) for h in HEADS}
    return merged.select(
        "doc_id", "host", "path", F.col("low").alias("evidence_low"), F.col("toxic").alias("evidence_toxic"),
        *[f"site_{h}" for h in HEADS],
        *[probability(odds[h]).alias(f"p_{h}") for h in HEADS],
        ((probability(odds["low"]) < threshold) & (probability(odds["toxic"]) < threshold)).alias("kept"),
    )

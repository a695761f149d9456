"""Quality of documents: word evidence combined with shrunken host and path posteriors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisift.llm import text as tx
from lumisift.llm.common import PIECE, Scratch

GOOD, POOR, TOXIC = 0, 1, 2
SAMPLE = 40_000  # labelled documents the evidence is learnt from, those with the lowest hashes of their ids
MEASURES = 8  # columns of Evidence.sums
MICRO = 1_000_000  # probabilities are summed as whole millionths: the same sum in any order

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>!{}\\^~")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
# Bounds of the grades of each share: symbols and capitals among bytes and letters,
# repeated lines, words equal to the one before, different words, bytes in a word.
GRADES = ((0.003, 0.01, 0.03, 0.08, 0.2), (0.1, 0.3, 0.6), (0.001, 0.2, 0.5), (0.01, 0.05, 0.2), (0.15, 0.3, 0.5), (2.5, 4, 9, 14))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _later_copies(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values equal to another one of the same owner, all but one of each, per owner."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1]) if len(o) else np.zeros(0, bool)
    return np.bincount(o[1:][same], minlength=n)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash): the words of each text, repeats included, and the grades of its shape."""
    n = len(texts)
    words, tokens, lines = tx.Words(texts, tx.ALNUM), tx.Words(texts, tx.SPACE), tx.Words(texts, _LINE)
    sizes = np.fromiter(map(len, texts), np.int64, n)

    def among(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[words.data])])
        return sums[words.begins + sizes] - sums[words.begins]

    owner = tokens.text_of()
    echo = (tokens.hash[1:] == tokens.hash[:-1]) & (owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
    count = tokens.counts
    different = count - _later_copies(owner, tokens.hash, n)
    shares = (_share(among(_SYMBOL), sizes), _share(among(_UPPER), among(_LETTER)),
              _share(_later_copies(lines.text_of(), lines.hash, n), lines.counts), _share(np.bincount(owner[1:][echo], minlength=n), count),
              # A long text repeats words anyway, so its variety is held against the square root of its length.
              np.minimum(1, different / np.maximum(1, 4 * np.sqrt(count))), _share(sizes, count))
    shape = [tx.mix(np.uint64(1000 * (k + 1)) + np.searchsorted(bounds, s, side="right").astype(np.uint64))
             for k, (s, bounds) in enumerate(zip(shares, GRADES, strict=True))]
    return np.concatenate([words.text_of(), *[np.arange(n)] * len(shape)]), np.concatenate([words.hash, *shape])


def _distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.append(True, (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    return owner[keep], h[keep]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, good, poor, toxic): labelled texts of each class with the feature."""
    for batch in batches:
        blobs, kinds = tx.blobs(batch.column("text")), batch.column("kind").to_numpy()
        for piece in tx.chunks([len(b) for b in blobs], PIECE):
            owner, h = _distinct(*features(blobs[piece]))
            found, where = np.unique(h, return_inverse=True)
            by_kind = [np.bincount(where, weights=kinds[piece][owner] == k, minlength=len(found)).astype(np.int64) for k in (GOOD, POOR, TOXIC)]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, by_kind)], ["feature", "good", "poor", "toxic"])


def log_odds(counts: Column, good: Column, n: int, n_good: int, least: float = 1.0, deviations: float = 2.5) -> Column:
    """Log odds of a feature in a class against the good texts, less so many standard errors; 0 if small or negative."""
    a, b = counts + F.lit(0.5), good + F.lit(0.5)
    odds = F.log(a / F.lit(n + 1.0)) - F.log(b / F.lit(n_good + 1.0))
    return F.when(odds >= least, F.greatest(odds - F.lit(deviations) * F.sqrt(1 / a + 1 / b), F.lit(0.0))).otherwise(F.lit(0.0))


def kinds(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, kind) of labelled documents: the worst label of each id; null ids and labels are left out."""
    worst = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    kind = F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, POOR).when(F.col("quality") == 1, GOOD)
    return worst.select("id", kind.cast("long").alias("kind")).filter("id IS NOT NULL AND kind IS NOT NULL")


class Evidence:
    """Weights of features against poor and toxic texts, and a logistic curve over their sums."""

    def __init__(self, keys: np.ndarray, poor: np.ndarray, toxic: np.ndarray, curve: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.curve = keys[order], np.stack([poor[order], toxic[order]]), curve

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Per text: 1, log of the words, sums of the weights of its shape, of its words, and of its words per hundred.

        A long text meets more words that look telling by chance, so what counts is also
        how densely they stand; its shape is not subject to that.
        """
        n = len(texts)
        owner, h = features(texts)
        shape = np.arange(len(h)) >= len(h) - n * len(GRADES)
        words = np.bincount(owner, minlength=n) - len(GRADES)
        sums = np.zeros((4, n))
        if len(self.keys):
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == h
            # Once per text, shapes apart from words.
            group, at = _distinct((2 * owner + shape)[known], at[known].astype(np.uint64))
            both = [np.bincount(group, weights=w[at.astype(np.int64)], minlength=2 * n) for w in self.weights]
            sums = np.stack([*(b[1::2] for b in both), *(b[::2] for b in both)])
        return np.stack([np.ones(n), np.log1p(words), *sums, *(sums[2:] / (1 + words / 100))], axis=1)

    def good(self, texts: list[bytes]) -> np.ndarray:
        """Probability that each text is neither poor nor toxic, by its own words."""
        return 1 / (1 + np.exp(np.clip(self.sums(texts) @ self.curve, -30, 30)))


def _weights(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counted = docs.join(chosen, "id").select("text", "kind").mapInArrow(_tally, "feature bigint, good bigint, poor bigint, toxic bigint")
    per_kind = {r["kind"]: r["count"] for r in chosen.groupBy("kind").count().collect()}
    n = [per_kind.get(k, 0) for k in (GOOD, POOR, TOXIC)]
    sums = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("good", "poor", "toxic")])
    found = (sums.select("feature", *[log_odds(F.col(c), F.col("good"), n[k], n[GOOD]).alias(c) for c, k in (("poor", POOR), ("toxic", TOXIC))])
             .filter("poor <> 0 OR toxic <> 0").toPandas())
    return found["feature"].to_numpy(np.int64).view(np.uint64), found["poor"].to_numpy(float), found["toxic"].to_numpy(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression by Newton steps; the first column is the constant."""
    if not len(y):
        return np.append(-30.0, np.zeros(x.shape[1] - 1))  # nothing known: all texts are taken to be good
    scale = np.append(1.0, np.maximum(x[:, 1:].std(axis=0), 1e-6))
    z, w, penalty = x / scale, np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> Evidence:
    """Learn from docs(id, text) the words and shapes that tell poor and toxic texts.

    A feature counts once per text. Its log odds between a class and the good texts
    shrink by 2.5 standard errors, to 0 for most words, which differ by chance only; odds
    below one are dropped, as the many common words they belong to go together, and so is
    all that speaks for a text: a lack of common words is no proof of a good one. The
    curve that turns sums of weights into a probability is fitted to one half of the
    sample with weights from the other half, so it knows how much they promise too much.
    """
    scratch = Scratch(docs.sparkSession)
    chosen = F.broadcast(scratch.cut(labelled.orderBy(F.xxhash64("id"), "id").limit(sample), "sample"))  # at most `sample` pairs of numbers
    half = F.xxhash64(F.lit(2), "id") % 2 == 0
    partial = Evidence(*_weights(docs, chosen.filter(half)), np.zeros(MEASURES))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = tx.blobs(batch.column("text"))
            parts = [partial.sums(blobs[piece]) for piece in tx.chunks([len(b) for b in blobs], PIECE)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("kind"), *map(pa.array, np.concatenate(parts).T)],
                                             ["id", "kind", *[f"x{k}" for k in range(MEASURES)]])

    rest = docs.join(chosen.filter(~half), "id").select("id", "kind", "text")
    measured = rest.mapInArrow(measure, ", ".join(["id bigint", "kind bigint", *[f"x{k} double" for k in range(MEASURES)]])).toPandas()
    measured = measured.sort_values(list(measured.columns))  # the same sums in any run
    x, y = measured[[f"x{k}" for k in range(MEASURES)]].to_numpy(), (measured["kind"] != GOOD).to_numpy(float)
    # Evidence against a text never speaks for it: sums that would do so are left out.
    used, curve = np.ones(MEASURES, bool), np.zeros(MEASURES)
    while True:
        curve[:] = 0
        curve[used] = logistic(x[:, used], y)
        against = used & (curve < 0)
        against[:2] = False
        if not against.any():
            break
        used &= ~against
    return Evidence(*_weights(docs, chosen), curve)


def strength(groups: DataFrame, centre: Column) -> float:
    """Pseudo-rows of the prior of groups(n, good, centre), from how far their rates stray beyond chance.

    Rates of groups of n rows around a common centre m vary by m (1 - m) / n by chance.
    What is over is the spread of the groups themselves, from which the strength of a
    beta prior follows (method of moments). One row of figures comes back.
    """
    rate, m = F.col("good") / MICRO / F.col("n"), centre
    row = groups.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (rate - m) * (rate - m)).alias("spread"),
                     F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("variance")).first()
    if not row["rows"] or not row["variance"]:
        return 1e6
    extra = (row["spread"] - row["chance"]) / row["rows"]
    return float(min(1e6, max(1.0, row["variance"] / row["rows"] / extra - 1))) if extra > 0 else 1e6


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
            path_col: str = "lang", threshold: float = 0.25, sample: int = SAMPLE, evidence: Evidence | None = None,
            row: Sequence[Column] = ()) -> DataFrame:
    """(id_col, host, path, own, site, score, kept) for every document.

    `own` is the probability by the document's words and shape that it is neither poor
    nor toxic. Hosts are given a posterior rate that shrinks to the rate of the whole
    corpus, and paths one that shrinks to their host's, by beta priors whose strengths
    are estimated from all hosts and paths; a site of few documents says little. Labels
    stand for the probability where there are any, and a document's own share is left
    out of its `site`. `score` moves the odds of `own` by those of the site against the
    corpus; a document with a score of at least `threshold` is kept: by default one goes
    only if that is three times as likely to be right.

    A null or empty text has only its shape as evidence. Null hosts and paths are sites
    of their own. A null id has no label; ids with several labels take the worst. Rows
    that repeat an id each get a row. Without usable labels all documents are kept.
    Numbers that tell rows apart may be given as `row`: they come back as row_0, row_1, ...
    """
    scratch = Scratch(docs.sparkSession)
    told = [f"row_{i}" for i in range(len(row))]
    names = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (host_col, path_col)]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), names[0].alias("host"), names[1].alias("path"),
                       *[c.cast("long").alias(name) for c, name in zip(row, told, strict=True)])
    labelled = kinds(labels, id_col)
    evidence = evidence or fit(docs.select("id", "text"), labelled, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = tx.blobs(batch.column("text"))
            good = [evidence.good(blobs[piece]) for piece in tx.chunks([len(b) for b in blobs], PIECE)]
            own = pa.array(np.rint(np.concatenate(good) * MICRO).astype(np.int64)) if good else pa.array([], pa.int64())
            kept = ["id", "host", "path", *told]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], own], [*kept, "own"])

    scored = docs.mapInArrow(score, ", ".join(["id bigint", "host string", "path string", *[f"{c} bigint" for c in told], "own bigint"]))
    known = F.when(F.col("kind") == GOOD, MICRO).when(F.col("kind").isNotNull(), 0).otherwise(F.col("own")).cast("long")
    scored = scratch.cut(scored.join(labelled, "id", "left").select("id", "host", "path", *told, "own", known.alias("good")), "scored")

    sums = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")]
    paths = scratch.cut(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    rows, total = hosts.agg(F.sum("n"), F.sum("good")).first()
    # Kept off 0 and 1, where odds have no value.
    mean = ((total or 0) + 0.5 * MICRO) / MICRO / ((rows or 0) + 1)
    k_host = strength(hosts, F.lit(mean))
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    host_rate = (F.col("host_good") / MICRO + k_host * mean) / (F.col("host_n") + k_host)
    k_path = strength(sites, host_rate)
    both = scored.join(sites.withColumnsRenamed({"n": "path_n", "good": "path_good"}), ["host", "path"])
    others = (((F.col("host_good") - F.col("good")) / MICRO + k_host * mean) / (F.col("host_n") - 1 + k_host))
    site = (((F.col("path_good") - F.col("good")) / MICRO + k_path * others) / (F.col("path_n") - 1 + k_path))

    def odds(p: Column) -> Column:
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
        return p / (1 - p)

    moved = odds(F.col("own") / MICRO) * odds(F.col("site")) / F.lit(mean / (1 - mean))
    return (both.withColumn("site", site).withColumn("score", moved / (1 + moved))
            .select(F.col("id").alias(id_col), F.nullif("host", F.lit("\x00")).alias("host"), F.nullif("path", F.lit("\x00")).alias("path"),
                    (F.col("own") / MICRO).alias("own"), "site", "score", (F.col("score") >= threshold).alias("kept"), *told))

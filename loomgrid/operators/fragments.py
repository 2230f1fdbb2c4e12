"""Fragment end motifs and their decomposition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions.sequence import pure_acgt


#: Motifs of ten letters, the longest that are counted.
MOST_PROFILE_ROWS = 4**10


def motif_counts(motifs: DataFrame, k: int, zeros: bool = True) -> DataFrame:
    """``sample_id, motif, count`` of pure motifs; with ``zeros`` all 4^k of each sample.

    Counts are formed before the shuffle; only they meet the list of motifs.
    """
    got = motifs.where(pure_acgt(F.col("motif")) & (F.length("motif") == k)).groupBy("sample_id", "motif").agg(F.count("*").alias("n"))
    if not zeros:
        return got.withColumnRenamed("n", "count")
    # a motif's number in base 4 gives its letters, so a sample's zeros come out of a sequence
    letters = [F.substring(F.lit("ACGT"), (F.shiftright(F.col("i"), 2 * (k - 1 - j)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for j in range(k)]
    every = motifs.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(4**k - 1))).alias("i")).select("sample_id", F.concat(*letters).alias("motif"))
    both = every.select("sample_id", "motif", F.lit(0).cast("long").alias("n")).unionByName(got)
    return both.groupBy("sample_id", "motif").agg(F.sum("n").alias("count"))


def frequencies(counts: DataFrame) -> DataFrame:
    total = F.sum("count").over(Window.partitionBy("sample_id"))
    return counts.withColumn("frequency", F.when(total > 0, F.col("count") / total).otherwise(0.0))


def diversity(counts: DataFrame, k: int) -> DataFrame:
    """Entropy of the motif frequencies over its largest value, 2k bits."""
    f = frequencies(counts).where("count > 0")
    return f.groupBy("sample_id").agg((F.sum(-F.col("frequency") * F.log2("frequency")) / (2 * k)).alias("mds"))


def read_counters(reads: DataFrame, kept: str, motif: str) -> DataFrame:
    """Per sample: all reads, those filtered, used, and with other letters than ACGT."""
    n_with_n = F.col(kept) & ~pure_acgt(F.col(motif))
    return reads.groupBy("sample_id").agg(F.count("*").alias("total"), F.count_if(~F.col(kept)).alias("filtered"), F.count_if(F.col(kept) & pure_acgt(F.col(motif))).alias("used"), F.count_if(n_with_n).alias("with_n"))


def once(reads: DataFrame) -> DataFrame:
    """Reads fetched through overlapping regions, each once: by sample, name and end of the pair."""
    from loomgrid.functions.flags import decoded

    d = decoded(F.col("flag"))
    mate = F.when(d["is_read1"], 1).when(d["is_read2"], 2).otherwise(0)
    return reads.withColumn("mate", mate).dropDuplicates(["sample_id", "qname", "mate"])


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative parts that sum to 1."""
    u = np.sort(v)[::-1]
    sums = np.cumsum(u) - 1.0
    rho = np.flatnonzero(u - sums / np.arange(1, len(u) + 1) > 0)[-1]
    return np.maximum(v - sums[rho] / (rho + 1.0), 0.0)


def mixture(profiles: np.ndarray, b: np.ndarray, rounds: int = 10_000, stop: float = 1e-12) -> np.ndarray:
    """Weights on the simplex that bring ``profiles @ w`` nearest to ``b``, by projected gradients."""
    g, c = profiles.T @ profiles, profiles.T @ b
    n = g.shape[0]
    w = np.full(n, 1.0 / n)
    if np.trace(g) < 1e-12:
        return w
    step = 1.0 / np.trace(g)
    for _ in range(rounds):
        new = simplex(w - step * (g @ w - c))
        done = np.linalg.norm(new - w) < stop
        w = new
        if done:
            break
    return w


def decompose(counts: DataFrame, profiles: np.ndarray, motifs: list[str]) -> DataFrame:
    """``sample_id, weights, residual``: each sample's frequencies as a mixture of the profiles
    (columns, in the order of ``motifs``); samples without counts are left out."""
    packed = counts.where("count > 0").groupBy("sample_id").agg(F.collect_list(F.struct("motif", "count")).alias("m"))
    at = {m: i for i, m in enumerate(motifs)}
    kind = packed.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights, rest = [], []
            for row in b.column("m").to_pylist():
                f = np.zeros(len(motifs))
                for x in row:
                    f[at[x["motif"]]] = x["count"]
                f /= f.sum()
                w = mixture(profiles, f)
                weights.append(w.tolist())
                rest.append(float(((profiles @ w - f) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), pa.array(weights, pa.list_(pa.float64())), pa.array(rest, pa.float64())], ["sample_id", "weights", "residual"])

    return packed.mapInArrow(run, f"sample_id {kind}, weights array<double>, residual double")


def even_profiles(k: int = 4, n: int = 6) -> np.ndarray:
    """Stand-in profiles made by a rule, for use where no measured ones are given as a file."""
    size = 4**k
    i = np.arange(size)[:, None] + 1
    raw = 1.0 + np.cos(i * (np.arange(n)[None, :] + 1) * 0.37) ** 2 * 3
    return raw / raw.sum(0)


def read_profiles(spark, path: str) -> tuple[np.ndarray, list[str]]:
    """Measured profiles from a tab-separated file: motif, then one column per profile."""
    table = spark.read.csv(path, sep="\t", comment="#")
    rows = sorted(table.limit(MOST_PROFILE_ROWS + 1).collect(), key=lambda r: r[0])
    if len(rows) > MOST_PROFILE_ROWS:
        raise ValueError(f"{path} has more motifs than 4^10")
    return np.array([[float(x) for x in r[1:]] for r in rows]), [r[0] for r in rows]

"""Mixing sources to target weights (problem 7).

Every document is sized in tokens of a public tokenizer. For each mix and source the documents are counted by exact
token length; the wanted size is filled with whole rounds of all documents, then with an even share of every length, and
the rest with a bounded knapsack over the lengths left (dynamic programming on the set of reachable sums, kept as the
bits of one integer), so that the sum is met exactly wherever the lengths allow it. Which documents of a length are
taken is decided by a seeded hash. Only counts by length meet in one task; documents never do.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.storage import materialise, spread

#: how the byte-level vocabulary splits a text, a published fixed value
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class MixConfig:
    """``tokenizer``: a tiktoken rank file on the driver's machine. ``reserve``: tokens that are left to the knapsack, several times the usual
    length. ``seed``: of the choice among documents of one length. ``hash_bins``: parts that such documents are ranked in.
    ``salt``: parts in which they meet the plan."""

    tokenizer: str = os.environ.get("MILLRACE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    reserve: int = 20_000
    seed: int = 11
    hash_bins: int = 256
    salt: int = 8
    id_col: str = "doc_id"
    text_col: str = "text"
    source_col: str = "source"


def source_key(column: Column) -> Column:
    """A source without case, outer spaces and a leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), r"^www\.", "")


def sized(documents: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, src, n_tokens) of every document with text."""
    with open(cfg.tokenizer, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())  # as large as its vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("millrace", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(encoding.encode_ordinary(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["doc_id", "src", "n_tokens"])

    rows = documents.where(F.col(cfg.text_col).isNotNull()).select(F.col(cfg.id_col).cast("long").alias("doc_id"), source_key(F.col(cfg.source_col)).alias("src"), F.col(cfg.text_col).alias("text"))
    return spread(rows).mapInArrow(count, "doc_id long, src string, n_tokens int")


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, wanted: int, max_repeats: int, reserve: int) -> tuple[int, np.ndarray]:
    """(rounds, taken): every document is used ``rounds`` times, ``taken[i]`` of those of ``lengths[i]`` once more.

    The sum of tokens is the largest one not above ``wanted`` that the method can reach: exactly ``wanted`` unless the
    lengths are too few or the source is too small.
    """
    whole = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), dtype=np.int64)
    if not whole or wanted <= 0:
        return 0, taken
    rounds = min(max_repeats, wanted // whole)
    rest = wanted - rounds * whole
    if rounds == max_repeats or not rest:
        return rounds, taken
    base = max(0, rest - reserve)
    share, carry = base / whole, 0.0
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        exact = share * size * n + carry
        taken[i] = min(n, max(0, int(exact // size)))
        carry = exact - taken[i] * size
    rest -= int((lengths * taken).sum())
    left = counts - taken
    # reachable sums up to ``rest`` after each length, as bits
    sums, before, mask = 1, [], (1 << (rest + 1)) - 1
    for size, n in zip(lengths.tolist(), left.tolist()):
        before.append(sums)
        n, part = min(n, rest // size), 1
        while n > 0:
            step = min(part, n)
            sums |= (sums << (step * size)) & mask
            n -= step
            part *= 2
    best = sums.bit_length() - 1
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        for k in range(int(left[i]) + 1):
            if best >= k * size and before[i] >> (best - k * size) & 1:
                taken[i] += k
                best -= k * size
                break
    return rounds, taken


def _targets(targets: DataFrame) -> DataFrame:
    """One row per mix and source with its relative share; repeated sources add up, rows without share or ratio don't count."""
    rows = (
        targets.where("mix_name is not null and source is not null and target_share > 0 and budget_ratio > 0")
        .groupBy("mix_name", source_key(F.col("source")).alias("src"))
        .agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).cast("int").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    )
    return rows.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy("mix_name")))


def plan(sizes: DataFrame, targets: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(mix_name, src, n_tokens, n_docs, rounds, taken, wanted) for each mix, source and token length."""
    reserve = cfg.reserve
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).first()["total"]
    hist = sizes.where("n_tokens > 0").groupBy("src", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    wanted = _targets(targets).withColumn("wanted", F.round(F.col("share") * F.col("budget_ratio") * F.lit(float(total))).cast("long"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n_tokens", ascending=False)
        rounds, taken = fit_lengths(group.n_tokens.to_numpy().astype(np.int64), group.n_docs.to_numpy(), int(group.wanted.iloc[0]), int(group.max_repeats.iloc[0]), reserve)
        return group.assign(rounds=rounds, taken=taken)[["mix_name", "src", "n_tokens", "n_docs", "rounds", "taken", "wanted"]]

    schema = "mix_name string, src string, n_tokens int, n_docs long, rounds int, taken long, wanted long"
    return hist.join(wanted, "src").groupBy("mix_name", "src").applyInPandas(solve, schema)


def mix(documents: DataFrame, targets: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats) of the documents chosen.

    Texts that are null or have no token are never chosen. A source without documents gives none; one too small for its
    share gives every document ``max_repeats`` times. Rows that repeat a doc_id are documents of their own.
    """
    sizes = materialise(sized(documents, cfg), "sizes")
    fitted = materialise(plan(sizes, targets, cfg), "mix").where("rounds > 0 or taken > 0").drop("n_docs", "wanted")
    # (source, length) may be a hot group, and the plan grows with the lengths there are: neither is broadcast; documents are
    # dealt to ``salt`` parts and ranked within bins of their hash, bins taken whole below the cut
    salted = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salt - 1)))).hint("merge")
    dealt = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(cfg.salt)).cast("int"))
    picked = dealt.join(salted, ["src", "n_tokens", "salt"]).drop("salt").withColumn("h", F.xxhash64(F.lit(cfg.seed), "mix_name", "doc_id"))
    picked = picked.withColumn("bin", F.pmod(F.shiftrightunsigned("h", 40), F.lit(cfg.hash_bins)).cast("int"))
    keys = ["mix_name", "src", "n_tokens"]
    bins = picked.where("taken > 0").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = bins.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")).drop("n")
    ranked = picked.join(before.hint("merge"), [*keys, "bin"], "left").withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "bin").orderBy("h", "doc_id")))
    repeats = F.col("rounds") + F.when(F.coalesce("before", F.lit(0)) + F.col("rank") <= F.col("taken"), 1).otherwise(0)
    return ranked.select("mix_name", F.col("src").alias("source"), "doc_id", "n_tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")


def report(documents: DataFrame, targets: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """Per mix and source: wanted and reached tokens, target and actual share, documents and the most repeats."""
    sizes = materialise(sized(documents, cfg), "sizes")
    fitted = plan(sizes, targets, cfg).groupBy("mix_name", "src").agg(
        F.sum(F.col("n_tokens") * (F.col("n_docs") * F.col("rounds") + F.col("taken"))).alias("tokens"),
        F.sum(F.when(F.col("rounds") > 0, F.col("n_docs")).otherwise(F.col("taken"))).alias("documents"),
        F.max(F.col("rounds") + (F.col("taken") > 0).cast("int")).alias("most_repeats"),
        F.max("wanted").alias("wanted"),
    )
    rows = _targets(targets).join(fitted, ["mix_name", "src"], "left")
    reached = F.coalesce("tokens", F.lit(0))
    return rows.select(
        "mix_name",
        F.col("src").alias("source"),
        F.col("share").alias("target_share"),
        (reached / F.nullif(F.sum(reached).over(Window.partitionBy("mix_name")), F.lit(0))).alias("actual_share"),
        "wanted",
        reached.alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "max_repeats",
    )

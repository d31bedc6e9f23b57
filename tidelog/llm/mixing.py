"""Mixing sources to target shares of all tokens by balanced (cube-method) sampling.

A source's share fixes its rate: tokens wanted over tokens held.  Its whole part
is how often every record is used, its fraction the inclusion probability of one
use more.  The cube method rounds these probabilities: three undecided records
at a time move along the null space of the constraints (tokens, documents), which
keeps both totals exactly, until one of them is decided.  Blocks of a source fly
in parallel and leave at most two undecided records each; these fly again, level
by level, until at most two a source are left, which are landed by the least
token error.

Defined cases: records without text, tokens or source are never used, nor are
sources without a target; a target whose source has no tokens can't be met, its
share goes to the others in proportion and the report says so; where records are
too few even at ``max_repeats``, the total is set by the scarcest source; null
shares and repeats count as 0 and 1; spelling of sources (case, outer spaces,
``_`` for ``-``) makes no difference; empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import materialise, spread

#: A public byte-level vocabulary; the path is a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenization pattern of that vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Records of a block, the part of a source one task decides.
BLOCK = 50_000
_ENCODINGS: dict = {}


def _encoding(ranks: bytes):
    """The tokenizer of a vocabulary file's content, once a process."""
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _ENCODINGS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _ENCODINGS[key]


def source_name(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), "_", "-")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, ``source_name``, ``tokens`` of the whole text.

    The vocabulary is read by the driver and broadcast (it is a file of about a
    megabyte), so that only the driver needs the path.
    """
    with open(vocabulary, "rb") as lines:
        ranks = documents.sparkSession.sparkContext.broadcast(lines.read())

    def count(batches):
        encoding = _encoding(ranks.value)
        for pdf in batches:
            tokens = np.fromiter((len(encoding.encode_ordinary(t)) for t in pdf["text"]), dtype=np.int64, count=len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source_name": pdf["source_name"], "tokens": tokens})

    named = documents.where("text is not null and source is not null and doc_id is not null").select("doc_id", source_name(F.col("source")).alias("source_name"), "text")
    return spread(named).mapInPandas(count, "doc_id bigint, source_name string, tokens bigint")


def fly(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are undecided; both totals stay as they are."""
    p = p.astype(float).copy()
    order = rng.permutation(np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))).tolist()
    chance = iter(rng.random(len(order) + 8).tolist())
    values, weights = p.tolist(), tokens.astype(float).tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and order:
            active.append(order.pop())
        if len(active) < 2:
            break
        if len(active) == 2:
            i, j = active
            if weights[i] != weights[j]:
                break
            moves = ((i, 1.0), (j, -1.0))
        else:
            i, j, k = active
            a, b, c = weights[i], weights[j], weights[k]
            moves = ((i, b - c), (j, c - a), (k, a - b)) if not a == b == c else ((i, 1.0), (j, -1.0), (k, 0.0))
        ahead = min(((1 - values[x]) / u if u > 0 else values[x] / -u) for x, u in moves if u)
        back = min((values[x] / u if u > 0 else (1 - values[x]) / -u) for x, u in moves if u)
        step = ahead if next(chance, 0.5) * (ahead + back) < back else -back
        undecided = []
        for x, u in moves:
            v = values[x] + step * u
            values[x] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            if 0.0 < values[x] < 1.0:
                undecided.append(x)
        if len(undecided) == len(active):  # rounding: decide the nearest
            x = min(undecided, key=lambda y: min(values[y], 1 - values[y]))
            values[x] = float(values[x] > 0.5)
            undecided.remove(x)
        active = undecided
    return np.array(values)


def _flight(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf["doc_id"].iat[0]) & 0x7FFFFFFF, len(pdf)])
        pdf["p"] = fly(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng)
        return pdf

    return run


def _land(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last two of a source: the rounding with the least token error, then document error."""
    pdf = pdf.sort_values("doc_id").reset_index(drop=True)
    p, tokens = pdf["p"].to_numpy(), pdf["tokens"].to_numpy()
    options = [np.array([(n >> i) & 1 for i in range(len(p))]) for n in range(1 << len(p))]
    pdf["p"] = min(options, key=lambda x: (abs(((x - p) * tokens).sum()), abs((x - p).sum()))).astype(float)
    return pdf


def plan(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """One entry a target (their number is fixed by the caller): what it holds, its rate, whole uses and fraction."""
    wanted = targets.where("source_name is not null").groupBy(source_name(F.col("source_name")).alias("source_name")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most")
    )
    held = tokens.where("tokens > 0").groupBy("source_name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    rows = [r.asDict() for r in wanted.join(held, "source_name", "left").orderBy("source_name").collect()]
    usable = [r for r in rows if r["tokens"] and r["share"] > 0 and r["most"] > 0]
    reachable = sum(r["share"] for r in usable)
    for r in rows:
        r["effective"] = r["share"] / reachable if r in usable else 0.0
    most = min((r["most"] * r["tokens"] / r["effective"] for r in usable), default=0.0)
    total = min(most, total_tokens) if total_tokens is not None else most
    for r in rows:
        rate = min(r["effective"] * total / r["tokens"], r["most"]) if r in usable else 0.0
        r["whole"] = math.floor(rate + 1e-9)
        r["part"] = max(0.0, rate - r["whole"])
    return rows


def draw(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY, block: int = BLOCK):
    """(selection, plan, token table).  Selection: ``doc_id``, ``source_name``, ``tokens``, ``copies`` > 0."""
    spark = documents.sparkSession
    counted = materialise(token_counts(documents, vocabulary), "tokens")
    rows = plan(counted, targets, total_tokens)
    rates = spark.createDataFrame(
        [(r["source_name"], int(r["whole"]), float(r["part"]), max(1, -(-(r["docs"] or 0) // block))) for r in rows], "source_name string, whole int, part double, blocks int"
    )
    pool = counted.where("tokens > 0").join(F.broadcast(rates), "source_name")  # one row a target
    schema = "doc_id bigint, source_name string, tokens bigint, p double, block int"
    undecided = "p > 0 and p < 1"
    start = pool.where("part > 1e-9").select("doc_id", "source_name", "tokens", F.col("part").alias("p"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int").alias("block"))
    level = materialise(start.groupBy("source_name", "block").applyInPandas(_flight(seed), schema), "flight")
    decided = [level.where("p = 1")]
    blocks = max([1, *(-(-(r["docs"] or 0) // block) for r in rows)])
    while blocks > 1:  # two records a block are left: the next level has that many fewer blocks
        seed, fewer = seed + 1, -(-2 * blocks // block)
        again = level.where(undecided).withColumn("block", F.pmod("block", F.lit(fewer)).cast("int"))
        level = materialise(again.groupBy("source_name", "block").applyInPandas(_flight(seed), schema), "flight")
        decided.append(level.where("p = 1"))
        blocks = fewer
    decided.append(level.where(undecided).groupBy("source_name").applyInPandas(_land, schema).where("p = 1"))
    extra = decided[0]
    for more in decided[1:]:
        extra = extra.unionByName(more)
    whole = pool.where("whole > 0").select("doc_id", "source_name", "tokens", F.col("whole").alias("copies"))
    added = extra.select("doc_id", "source_name", "tokens", F.lit(1).alias("copies"))
    selection = whole.unionByName(added).groupBy("doc_id", "source_name", "tokens").agg(F.sum("copies").cast("int").alias("copies"))
    return selection, rows, counted


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY) -> DataFrame:
    return draw(documents, targets, total_tokens, seed, vocabulary)[0]


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a target: share wanted, share after unreachable targets are left out, share reached, records, uses."""
    spark = documents.sparkSession
    selection, rows, _ = draw(documents, targets, total_tokens, seed, vocabulary)
    reached = selection.groupBy("source_name").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses")
    )
    wanted = spark.createDataFrame([(r["source_name"], float(r["share"]), float(r["effective"]), int(r["most"])) for r in rows], "source_name string, target_share double, effective_share double, max_repeats int")
    joined = wanted.join(reached, "source_name", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row a target
    return joined.select(
        "source_name", "target_share", "effective_share", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats", (F.col("effective_share") > 0).alias("reachable"),
    )


def mix_held(documents: DataFrame, targets: DataFrame, slack: float = 10.0, **options) -> DataFrame:
    """What must hold of a mix, one row a target: ``reachable``, ``capped`` (no record used too often) and ``near``.

    ``near``: the share reached is within ``slack`` average records of the share due.
    """
    report = mix_report(documents, targets, **options)
    uses = F.sum("uses").over(Window.partitionBy(F.lit(1)))  # one row a target
    off = F.abs(F.coalesce("reached_share", F.lit(0.0)) - F.col("effective_share"))
    return report.withColumn("_uses", uses).select("source_name", "reachable", (F.col("most_uses") <= F.greatest("max_repeats", F.lit(0))).alias("capped"), (off * F.col("_uses") <= slack).alias("near"))

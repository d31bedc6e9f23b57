"""Term statistics of inverted indexes: distinctive terms and frequencies of all n-grams.

Both work on the current rows of ``postings``: those with a record's highest
``indexed_lsn``, identical rows once, a null ``term_freq`` counted from the
positions, terms that are equal after trimming and lower-casing added up.

Defined cases: rows without namespace, record or term take no part; a null or
zero record length or an unknown collection size gives a null weight; an unknown
size marks no term too common; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.kv import running_total
from tidelog.session import materialise

#: Terms by which the suffixes are told apart in one round of ``repeated_ngrams``.
CHUNK = 8
POSTING = ("ns", "doc_id", "term", "term_freq", "doc_len_tokens", "indexed_lsn", "category", "positions")


def current_rows(postings: DataFrame, *columns: Column | str) -> DataFrame:
    """Distinct rows of each record's latest indexing: ``ns``, ``doc_id`` and ``columns``.

    The latest LSN is found by an aggregate that is reduced on the map side, not
    by a window over the record, and joined back.  Whether rows of one record with
    the same ``columns`` are identical is told by 64 bits over all of their columns,
    so that only ``columns`` travel.
    """
    rows = postings.where("ns is not null and doc_id is not null and term is not null").select(*[c for c in POSTING if c in postings.columns])
    rows = rows.withColumn("indexed_lsn", F.coalesce("indexed_lsn", F.lit(-1)))
    told = [F.col(c) for c in rows.columns if c not in ("ns", "doc_id", "indexed_lsn")]
    nulls = sum((F.when(c.isNull(), 1 << i).otherwise(0) for i, c in enumerate(told)), F.lit(0))
    latest = rows.groupBy("ns", "doc_id").agg(F.max("indexed_lsn").alias("indexed_lsn"))
    marked = rows.select("ns", "doc_id", "indexed_lsn", *columns, F.xxhash64(nulls, *told).alias("_told"))
    return marked.join(latest, ["ns", "doc_id", "indexed_lsn"]).drop("indexed_lsn").distinct().drop("_told")


def _spelling() -> Column:
    return F.lower(F.trim("term"))


def _frequency() -> Column:
    return F.coalesce(F.col("term_freq"), F.array_size("positions"), F.lit(0)).cast("bigint")


def current_terms(postings: DataFrame) -> DataFrame:
    """``ns``, ``doc_id``, ``term`` (one spelling), ``tf``, ``doc_len``, one row each."""
    rows = current_rows(postings, _spelling().alias("term"), _frequency().alias("tf"), "doc_len_tokens")
    return rows.groupBy("ns", "doc_id", "term").agg(F.sum("tf").alias("tf"), F.max("doc_len_tokens").alias("doc_len"))


def collection_sizes(text_indexes: DataFrame) -> DataFrame:
    """``ns``, ``total_docs`` from each namespace's row with the highest ``sidecar_lsn``."""
    known = text_indexes.where("ns is not null")
    return known.groupBy("ns").agg(F.max(F.struct(F.coalesce("sidecar_lsn", F.lit(-1)).alias("lsn"), "total_docs"))["total_docs"].alias("total_docs"))


def term_spread(current: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each term of a namespace: records, occurrences, entropy and global weight.

    Entropy comes from one aggregate: with shares p = tf / gf it is
    ln(gf) - sum(tf ln tf) / gf.  The global weight is one minus the entropy over
    the logarithm of the collection's size, between 0 and 1; 0 in a collection of
    one record, where nothing can stand out.
    """
    stats = current.groupBy("ns", "term").agg(
        F.count("*").alias("df"),
        F.sum("tf").alias("gf"),
        F.sum(F.when(F.col("tf") > 0, F.col("tf") * F.ln(F.col("tf").cast("double"))).otherwise(0.0)).alias("_tlt"),
    )
    entropy = F.when(F.col("gf") > 0, F.ln(F.col("gf").cast("double")) - F.col("_tlt") / F.col("gf")).otherwise(0.0)
    size = F.ln(F.col("total_docs").cast("double"))
    weight = F.when(F.col("total_docs") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("entropy") / size))).when(F.col("total_docs") == 1, F.lit(0.0))
    return (
        stats.withColumn("entropy", F.greatest(F.lit(0.0), entropy)).drop("_tlt")
        .join(sizes, "ns", "left").withColumn("global_weight", weight)
    )


def log_entropy(postings: DataFrame, text_indexes: DataFrame) -> DataFrame:
    """Weight of every current term of every record: ln(1 + tf) times the term's global weight.

    Two aggregations: postings to terms of a record, these to terms of a
    namespace.  The first result is written once and read for both uses.
    """
    current = materialise(current_terms(postings), "terms")
    spread = term_spread(current, collection_sizes(text_indexes))
    rows = current.join(spread, ["ns", "term"])
    return rows.withColumn("weight", F.ln(1.0 + F.col("tf")) * F.col("global_weight"))


def distinctive_terms(postings: DataFrame, text_indexes: DataFrame, least: float = 0.6) -> DataFrame:
    """Terms with tf / length x ln(size / records) of at least ``least``.

    The log-entropy weights screen: a term's entropy is at most ln(records), so
    its global weight times ln(size) is never below its inverse document
    frequency.  What passes is then checked exactly.
    """
    share = F.col("tf") / F.col("doc_len")
    size = F.col("total_docs").cast("double")
    screened = log_entropy(postings, text_indexes).where((F.col("doc_len") > 0) & (share * F.col("global_weight") * F.ln(size) >= least - 1e-6))
    return screened.where(share * F.ln(size / F.col("df")) >= least).select("ns", "doc_id", "term")


def top_terms(postings: DataFrame, text_indexes: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` terms of each record with the highest log-entropy weight (to six places), then in the order of terms; ``rank`` from 1."""
    rows = log_entropy(postings, text_indexes).withColumn("weight", F.round("weight", 6) + F.lit(0.0)).where("weight is not null")
    window = Window.partitionBy("ns", "doc_id").orderBy(F.desc("weight"), "term")
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("ns", "doc_id", "term", "weight", "rank")


def _intervals(head: list[str], depth: int):
    """Per sorted partition: intervals of common prefixes with their sums.

    Rows are ``head``, ``t1..tn``, ``occ``, ``dup1..dupn`` in suffix order.  A new
    interval of depth k begins where the common prefix with the row before is
    shorter than k.
    """
    terms = [f"t{k}" for k in range(1, depth + 1)]

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            present = np.ones(len(pdf), dtype=bool)
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for h in head:
                v = pdf[h].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            for k, t in enumerate(terms, 1):
                v = pdf[t].to_numpy()
                present &= np.array([x is not None for x in v], dtype=bool)
                change[1:] |= v[1:] != v[:-1]  # the common prefix ends before depth k
                at = np.flatnonzero(change)
                occ = np.add.reduceat(np.where(present, pdf["occ"].to_numpy(), 0), at)
                dup = np.add.reduceat(np.where(present, pdf[f"dup{k}"].to_numpy(), 0), at)
                keep = present[at]
                rows = at[keep]
                if not len(rows):
                    continue
                grams = [list(g) for g in zip(*(pdf[x].to_numpy()[rows] for x in terms[:k]))]
                yield pd.DataFrame({**{h: pdf[h].to_numpy()[rows] for h in head}, "k": np.full(len(rows), k, dtype=np.int32), "gram": grams, "occ": occ[keep], "dup": dup[keep]})

    return run


def _prefix_counts(suffixes: DataFrame, head: list[str], depth: int) -> DataFrame:
    """``head``, ``k``, ``gram``, ``total_tf``, ``df`` of every prefix of up to ``depth`` terms.

    ``suffixes``: ``head``, ``ns``, ``doc_id``, ``t1..tn``, ``occ`` (how often the
    suffix counts).  Equal suffixes of a record are added up; in a record's own
    sorted suffixes every neighbouring pair with k terms in common repeats that
    prefix once, which is what records count less than occurrences.  Pairs are
    sought per record and first term, then all records' suffixes are sorted across
    the cluster by ranges, so neither a hot record nor a hot term is one task's work.
    """
    terms = [f"t{k}" for k in range(1, depth + 1)]
    own = list(dict.fromkeys([*head, "ns", "doc_id"]))
    local = suffixes.groupBy(*own, *terms).agg(F.sum("occ").alias("occ"))
    sort = Window.partitionBy(*own, "t1").orderBy(*terms[1:])
    same = F.lit(True)
    cols = {}
    for k, t in enumerate(terms, 1):
        same = same & (F.col(t) == F.lag(t).over(sort))
        pair = F.coalesce(same, F.lit(False)).cast("bigint")
        cols[f"dup{k}"] = F.when(F.col(t).isNotNull(), F.col("occ") - 1 + pair).otherwise(F.lit(0))
    local = local.withColumns(cols)
    added = local.groupBy(*head, *terms).agg(F.sum("occ").alias("occ"), *[F.sum(f"dup{k}").alias(f"dup{k}") for k in range(1, depth + 1)])
    ordered = added.repartitionByRange(*head, *terms).sortWithinPartitions(*head, *terms)
    kinds = dict(added.dtypes)
    schema = ", ".join(f"{h} {kinds[h]}" for h in head) + ", k int, gram array<string>, occ bigint, dup bigint"
    intervals = ordered.mapInPandas(_intervals(head, depth), schema)
    # an interval may go on in the next batch or partition
    merged = intervals.groupBy(*head, "k", "gram").agg(F.sum("occ").alias("total_tf"), F.sum("dup").alias("_dup"))
    return merged.select(*head, "k", "gram", "total_tf", (F.col("total_tf") - F.col("_dup")).alias("df"))


def ngram_frequencies(postings: DataFrame, max_n: int = 1) -> DataFrame:
    """``ns``, ``n``, ``term``, ``total_tf``, ``df`` of every n-gram of up to ``max_n`` terms (joined by blanks).

    A suffix array over the records' term sequences, cut at ``max_n`` terms and at
    two at least, and its intervals of common prefixes: an interval of length n is
    an n-gram.  Neighbours are next in position order.  Single terms are the
    intervals of length one; what their ``term_freq`` says beyond the positions
    counts as further suffixes of that one term.  ``repeated_ngrams`` has no cut.
    """
    depth = max(2, max_n)
    terms = [f"t{k}" for k in range(1, depth + 1)]
    rows = current_rows(postings, _spelling().alias("t1"), _frequency().alias("_tf"), F.coalesce(F.array_compact("positions"), F.array().cast("array<int>")).alias("_at"))
    # a last place without position carries what the frequency says beyond the positions
    beyond = F.when((F.col("_tf") != F.size("_at")) | (F.size("_at") == 0), F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    places = rows.select("ns", "doc_id", "t1", (F.col("_tf") - F.size("_at")).alias("_more"), F.explode(F.concat("_at", beyond)).alias("_pos"))
    order = Window.partitionBy("ns", "doc_id").orderBy(F.asc_nulls_last("_pos"), "t1")
    following = [F.when(F.lead("_pos", k).over(order).isNotNull(), F.lead("t1", k).over(order)).alias(t) for k, t in enumerate(terms[1:], 1)]
    occ = F.when(F.col("_pos").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.col("_more")).alias("occ")
    counted = _prefix_counts(places.select("ns", "doc_id", "t1", *following, occ), ["ns"], depth).where(F.col("k") <= max_n)
    return counted.select("ns", F.col("k").alias("n"), F.array_join("gram", " ").alias("term"), "total_tf", "df")


def repeated_ngrams(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``ns``, ``n``, ``gram`` (terms), ``total_tf``, ``df``: n-grams of any length that occur more than once and more often than any longer one.

    Every other n-gram that repeats begins some of these and has the counts of the
    shortest; all the rest occur once.  The suffix array is refined ``chunk``
    terms at a time, each round only among suffixes that had all terms so far in
    common with another, until none is left: the rounds follow the longest
    repeated passage, and nothing is cut.
    """
    rows = current_rows(postings, _spelling().alias("term"), "positions").select("ns", "doc_id", "term", F.explode("positions").alias("pos"))
    placed = materialise(running_total(rows, ["ns", "doc_id", "pos", "term"], F.lit(1), "g").select("ns", "doc_id", "g", "term"), "places")
    terms = [f"t{k}" for k in range(1, chunk + 1)]
    # the terms that follow a place: each term sends itself to the places before it
    sent = placed.select("ns", "doc_id", "term", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(chunk - 1)), lambda o: F.col("g") - o)).alias("_o", "at"))
    following = sent.groupBy("ns", "doc_id", "at").agg(*[F.max(F.when(F.col("_o") == k, F.col("term"))).alias(t) for k, t in enumerate(terms)])
    chunks = materialise(following.where("t1 is not null"), "chunks")
    head = ["ns", "c1", "c2"]
    marks = lambda *of: [F.xxhash64(F.lit(i), *of).alias(c) for i, c in enumerate(("c1", "c2"))]
    live = placed.select("ns", "doc_id", F.col("g").alias("start"), *marks("ns"))
    begun = placed.select("ns").distinct().select("ns", *marks("ns"), F.array().cast("array<string>").alias("gram"), F.lit(None).cast("bigint").alias("total_tf"), F.lit(None).cast("bigint").alias("df"))
    base, done = 0, []
    while True:
        here = live.withColumn("at", F.col("start") + base).drop("start").join(chunks, ["ns", "doc_id", "at"]).withColumn("start", F.col("at") - base)
        found = materialise(_prefix_counts(here.withColumn("occ", F.lit(1).cast("bigint")), head, chunk).where("total_tf > 1"), "grams")
        more = found.select(*head, (F.col("k") - 1).alias("k"), F.slice("gram", 1, F.greatest(F.col("k") - 1, F.lit(0))).alias("gram"), "total_tf").groupBy(*head, "k", "gram").agg(F.max("total_tf").alias("_longer"))
        ended = F.col("_longer").isNull() | (F.col("_longer") < F.col("total_tf"))
        # what the last round left open, where no term more keeps the count
        last = begun.where("total_tf is not null").join(more.where("k = 0").select(*head, "_longer"), head, "left").where(ended)
        done.append(last.select("ns", "gram", "total_tf", "df"))
        inner = found.where(F.col("k") < chunk).join(more, [*head, "k", "gram"], "left").where(ended)
        before = begun.select(*head, F.col("gram").alias("_before"))
        done.append(inner.join(before, head).select("ns", F.concat("_before", "gram").alias("gram"), "total_tf", "df"))
        deeper = found.where(F.col("k") == chunk)
        if deeper.isEmpty():
            break
        going = deeper.select(*head, *[F.col("gram")[i].alias(t) for i, t in enumerate(terms)])
        live = materialise(here.join(going, [*head, *terms], "left_semi").select("ns", "doc_id", "start", *marks("c1", "c2", F.array(*terms))), "tied")
        begun = materialise(deeper.join(before, head).select("ns", *marks("c1", "c2", "gram"), F.concat("_before", "gram").alias("gram"), "total_tf", "df"), "passages")
        base += chunk
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select("ns", F.size("gram").alias("n"), "gram", "total_tf", "df")


def marked_frequencies(postings: DataFrame, text_indexes: DataFrame, max_n: int = 1, least_tf: int = 3, most_percent: int = 30) -> DataFrame:
    """``ngram_frequencies`` with ``mark``: ``too_rare`` below ``least_tf``, ``too_common`` in more than ``most_percent`` of the records."""
    counted = ngram_frequencies(postings, max_n).join(collection_sizes(text_indexes), "ns", "left")
    common = F.coalesce(F.col("df") * 100 > F.col("total_docs") * most_percent, F.lit(False))
    return counted.withColumn("mark", F.when(F.col("total_tf") < least_tf, "too_rare").when(common, "too_common"))


def useless_terms(postings: DataFrame, text_indexes: DataFrame) -> DataFrame:
    return marked_frequencies(postings, text_indexes).where("mark is not null").select("ns", "term")


__all__ = ["current_rows", "current_terms", "distinctive_terms", "log_entropy", "marked_frequencies", "ngram_frequencies", "repeated_ngrams", "top_terms", "useless_terms"]

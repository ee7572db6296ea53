"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked to three target
marginals in turn until they settle.  A cell's raked weight over its own tokens,
scaled so that the largest is 1, is the probability with which each of its
documents is kept, so the expected mix has the target marginals exactly.

That law makes the kept share hang on the one cell with the largest weight a
token.  With a stated share of the tokens (the pipeline's way) weights are
capped at the cell's own tokens in every step instead, the rest is raked on, and
a last common factor brings the sum to the share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_stored, fresh, join_small, new_path, stored

AXES = ("source", "lang", "topic")
#: Each target marginal is the tokens to this power, in proportion: below 1 it evens out, at 1 it stays.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
ROUNDS = 12
#: Share of the tokens that the pipeline keeps.
KEPT_SHARE = 0.5
#: Cells up to which the driver rakes; more are raked in Spark, by the same steps to the same weights.
MOST_CELLS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def form_topic(text: Column, words: Column) -> Column:
    """A document's form stands for its topic where the table has none: listing, brief, article or treatise."""
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    return F.when(bars * 50 > F.length(text), "listing").when(words < 100, "brief").when(words < 1000, "article").otherwise("treatise")


def rake(tokens: np.ndarray, codes: dict[str, np.ndarray], targets: dict[str, np.ndarray], rounds: int = ROUNDS, capped: bool = False) -> np.ndarray:
    """The cells' weights after so many rounds over all axes; codes give each cell's value on an axis, targets the sum wanted for each value.  Capped weights never exceed the tokens."""
    m = tokens.astype(float)
    for _ in range(rounds):
        for axis, code in codes.items():
            now = np.bincount(code, m, len(targets[axis]))
            m = m * (targets[axis] / np.where(now > 0, now, 1.0))[code]
            m = np.minimum(m, tokens) if capped else m
    return m


def lift(m: np.ndarray, tokens: np.ndarray, wanted: float) -> float:
    """The factor for which min(factor * m, tokens) sums to ``wanted``, at most the sum of the tokens."""
    factor, full = wanted / m.sum(), np.zeros(len(m), bool)
    while True:
        now = factor * m >= tokens
        if now.all() or (now == full).all():
            return factor
        full = now
        factor = max(factor, (wanted - tokens[full].sum()) / m[~full].sum())


def probabilities(spark: SparkSession, cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """cells with p: cells are (source, lang, topic, tokens), stored.  share: see sample()."""
    if share is not None and not 0 < share <= 1:
        raise ValueError("a share is above 0 and at most 1")
    if cells.count() > MOST_CELLS:
        return _probabilities_in_spark(cells, powers, rounds, share)
    rows = cells.select(*AXES, "tokens").toPandas().sort_values(list(AXES), kind="stable", ignore_index=True)
    if not len(rows):
        return spark.createDataFrame([], "source string, lang string, topic string, p double")
    tokens, codes, targets = rows["tokens"].to_numpy(float), {}, {}
    for axis in AXES:
        codes[axis], values = pd.factorize(rows[axis], sort=True)
        wanted = np.bincount(codes[axis], tokens, len(values)) ** powers[axis]
        targets[axis] = wanted / wanted.sum() * tokens.sum() * (share or 1)
    m = rake(tokens, codes, targets, rounds, share is not None)
    ratio = m / tokens
    rows["p"] = ratio / ratio.max() if share is None else np.minimum(ratio * lift(m, tokens, share * tokens.sum()), 1.0)
    return spark.createDataFrame(rows[[*AXES, "p"]], "source string, lang string, topic string, p double")


def _probabilities_in_spark(cells: DataFrame, powers: dict[str, float], rounds: int, share: float | None) -> DataFrame:
    """The same where cells are too many for the driver: each step is a grouped sum and a join, each round is stored."""
    spark, t = cells.sparkSession, F.col("tokens").cast("double")
    m = cells.select(*AXES, t.alias("tokens"), t.alias("m"))
    total = cells.agg(F.sum(t)).first()[0]
    for axis in AXES:
        sums = cells.groupBy(axis).agg(F.pow(F.sum(t), F.lit(powers[axis])).alias("_w"))
        sums = stored(sums, "targets")
        target = F.col("_w") / F.lit(sums.agg(F.sum("_w")).first()[0]) * F.lit(total * (share or 1))
        m = join_small(m, sums.withColumn(f"_{axis}", target).drop("_w"), [axis], "inner")
    path = new_path(spark, "rake")
    m = stored(m, "rake", path)
    for _ in range(rounds):
        for axis in AXES:
            now = stored(m.groupBy(axis).agg(F.sum("m").alias("_now")), "sums")
            weight = F.col("m") * (F.col(f"_{axis}") / F.col("_now"))
            m = join_small(m, now, [axis], "inner").withColumn("m", weight if share is None else F.least(weight, "tokens")).drop("_now")
        later = new_path(spark, "rake")
        m = stored(m, "rake", later)
        drop_stored(spark, path)
        path = later
    if share is None:
        factor = 1 / m.agg(F.max(F.col("m") / F.col("tokens"))).first()[0]
    else:  # as lift()
        factor, full = share * total / m.agg(F.sum("m")).first()[0], 0
        while True:
            over = F.col("m") * F.lit(factor) >= F.col("tokens")
            n, taken, free = m.agg(F.count_if(over), F.sum(F.when(over, F.col("tokens"))), F.sum(F.when(~over, F.col("m")))).first()
            if n == full or not free:
                break
            factor, full = max(factor, (share * total - taken) / free), n
    return m.select(*AXES, F.least(F.col("m") / F.col("tokens") * F.lit(factor), F.lit(1.0)).alias("p"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with id, source, language, topic and tokens, nulls replaced, and the names that these columns have."""
    d, s, l, t, n = names = fresh(docs.columns, "d", "s", "l", "t", "n")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = {c: F.coalesce(F.col(of).cast("string"), F.lit("")) for c, of in ((d, "doc_id"), (s, "source"), (l, "lang"))}
    return docs.withColumns(own | {n: word_count(text)}).withColumn(t, form_topic(text, F.col(n))), names


def _known(rows: DataFrame, names: list[str], p: str, powers: dict[str, float], rounds: int, share: float | None = None) -> DataFrame:
    """The cells' columns and ``p``, the probability of each cell, stored; names are those of _keyed()."""
    axes, tokens = names[1:4], names[4]
    cells = rows.groupBy(*[F.col(c).alias(a) for c, a in zip(axes, AXES)]).agg(F.sum(F.greatest(tokens, F.lit(1))).alias("tokens"))
    found = probabilities(rows.sparkSession, stored(cells, "cells"), powers, rounds, share)
    return stored(found.select(*[F.col(a).alias(c) for c, a in zip(axes, AXES)], F.col("p").alias(p)), "probabilities")


def _draw(key: str) -> Column:
    """A number from 0 to below 1 made of the id."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, keep_ppm, kept for every row of docs.

    keep_ppm is the probability in millionths.  The draw is a hash of the id, so
    rows with equal ids in one cell go together, and null ids share one draw.
    Null sources and languages are values of their own (empty).  Null and empty
    texts have no tokens and count one.  A source that is all of the table keeps
    the mix of the other two axes.
    """
    rows, names = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text"))
    d, s, l, t, n = names
    rows = stored(rows.select("doc_id", *names), "tokens")
    drawn = join_small(rows, _known(rows, names, "p", powers, rounds), [s, l, t], "inner")
    return drawn.select("doc_id", F.col(s).alias("source"), F.col(l).alias("lang"), F.col(t).alias("topic"), F.col(n).alias("n_tokens"), F.round(F.col("p") * 1e6).cast("long").alias("keep_ppm"), (_draw(d) < F.col("p")).alias("kept"))


def sample(docs: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, share: float | None = None) -> DataFrame:
    """The rows of docs that are drawn, all columns as they were; texts are read twice and never shuffled.

    With a share, so much of the tokens is kept in expectation, whatever the
    size and skew of the input; without one the law of mix() holds.  Null and
    empty texts, null sources, languages and ids, and repeated rows count as in
    mix(); an empty table stays empty; other columns stay, whatever their names.
    """
    rows, names = _keyed(docs)
    (p,) = fresh(docs.columns, "p")
    known = _known(rows.select(*names), names, p, powers, rounds, share)
    return join_small(rows, known, names[1:4], "inner").where(_draw(names[0]) < F.col(p)).select(*map(col, docs.columns))


def _oracle() -> str:
    """The same in SQL, the rounds written out."""
    steps, last = [], "start"
    for k in range(ROUNDS):
        for axis in AXES:
            name = f"r{k}_{axis}"
            steps.append(f"{name} AS (SELECT source, lang, topic, t, source_target, lang_target, topic_target, m * {axis}_target / sum(m) OVER (PARTITION BY {axis}) AS m FROM {last})")
            last = name
    sums = ", ".join(f"sum(t) OVER (PARTITION BY {a}) AS {a}_sum" for a in AXES)
    wanted = ", ".join(f"pow({a}_sum, {POWERS[a]}) / (SELECT sum(pow(s, {POWERS[a]})) FROM (SELECT sum(t) AS s FROM cells GROUP BY {a}) x) * (SELECT sum(t) FROM cells) AS {a}_target" for a in AXES)
    return rf"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens
  FROM documents
), rows_ AS (
  SELECT doc_id, source, lang, n_tokens,
         CASE WHEN (length(text) - length(replace(text, '|', ''))) * 50 > length(text) THEN 'listing'
              WHEN n_tokens < 100 THEN 'brief' WHEN n_tokens < 1000 THEN 'article' ELSE 'treatise' END AS topic
  FROM words
), cells AS (
  SELECT source, lang, topic, CAST(sum(greatest(n_tokens, 1)) AS DOUBLE) AS t FROM rows_ GROUP BY source, lang, topic
), sums AS (SELECT source, lang, topic, t, {sums} FROM cells),
start AS (SELECT source, lang, topic, t, t AS m, {wanted} FROM sums),
{", ".join(steps)},
p AS (SELECT source, lang, topic, (m / t) / max(m / t) OVER () AS p FROM {last})
SELECT doc_id, source, lang, topic, n_tokens, CAST(round(p * 1e6) AS BIGINT) AS keep_ppm,
       CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < p AS kept
FROM rows_ JOIN p USING (source, lang, topic)
"""


ORACLE = _oracle()

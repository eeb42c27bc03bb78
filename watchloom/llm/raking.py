"""Mixing sources to target weights: iterative proportional fitting over cells, then sampling by calibrated probability.

Documents are summed into cells (source, language, topic), a table with a row per combination that occurs. Raking
scales the cells' token weights to each dimension's target shares in turn, by window sums over the cells, and the
documents take their cell's factor as probability. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchloom.llm.common import read_table, written

DIMENSIONS = ("source", "lang", "topic")
#: Passes over the three marginals, and the exponent that flattens the observed shares to target shares.
ROUNDS, FLATTEN = 8, 0.7
#: Passes after which raking to a tolerance gives up.
MOST_ROUNDS = 400
#: Forms of text, the first that matches; the patterns mean the same to Java and RE2.
TOPICS = (
    ("tabular", r"( \| [^ ]+){4}"),
    ("legal", r"(?i)licensed under|copyright|all rights reserved"),
    ("web", r"https?://"),
    ("contact", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+"),
    ("marked", r"%%%|&&&|###"),
    ("numeric", r"[0-9]{6}"),
)
OTHER_TOPIC = "prose"
WORD = r"[^ \t\n\r]+"


def topic_of(text: Column) -> Column:
    text, out = F.coalesce(text, F.lit("")), F.lit(OTHER_TOPIC)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words and one end token, so a document without text still has a weight."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def flattened(cells: DataFrame, dimension: str, power: float = FLATTEN) -> DataFrame:
    """Target shares of a dimension's categories: their token shares to a power, scaled to one."""
    sums = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("target"))
    total = sums.agg(F.sum("target")).first()[0] or 1.0
    return sums.select(dimension, (F.col("target") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, start: str | None = None) -> DataFrame:
    """``cells`` with column weight: shares that meet each dimension's targets as nearly as the cells allow.

    The weights begin as token shares, or as those in column ``start``, which goes on an earlier run.

    ``targets`` has (category, target) per dimension; a category without one keeps its observed share, null is a
    category of its own, and targets of categories that don't occur have nothing to scale. Cells need positive tokens.
    """
    if start:
        out = cells.withColumn("weight", F.col(start))
    else:
        total = cells.agg(F.sum("tokens")).first()[0] or 1
        out = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for d, wanted in targets.items():
        share = F.sum("weight").over(Window.partitionBy(d))
        wanted = wanted.select(F.col(d).alias("_category"), F.col("target").alias(f"_{d}"))
        out = out.join(wanted, F.col(d).eqNullSafe(F.col("_category")), "left").drop("_category")
        out = out.withColumn(f"_{d}", F.coalesce(f"_{d}", share))
    for _ in range(rounds):
        for d in targets:
            out = out.withColumn("weight", F.col("weight") * F.col(f"_{d}") / F.sum("weight").over(Window.partitionBy(d)))
    return out.select(*cells.columns, "weight")


def marginal_error(raked: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest distance of a category's raked weight from its target; categories without a target don't count."""
    most = 0.0
    for d, wanted in targets.items():
        sums = raked.groupBy(F.col(d).alias("_category")).agg(F.sum("weight").alias("_weight"))
        far = sums.join(wanted, F.col("_category").eqNullSafe(F.col(d))).agg(F.max(F.abs(F.col("_weight") - F.col("target")))).first()[0]
        most = max(most, far or 0.0)
    return most


def rake_until(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float]:
    """``cells`` with column weight after as many passes as ``tolerance`` asks for, and the largest marginal error.

    Passes come in runs of ``ROUNDS``, each written before the next. They end above ``tolerance`` where a run takes less
    than a hundredth off the error, as with targets that no weights of these cells meet, or after ``most_rounds``.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out, done = cells.withColumn("weight", F.col("tokens") / F.lit(float(total))), 0
    error, before = marginal_error(out, targets), float("inf")
    while tolerance < error < 0.99 * before and done < most_rounds:
        step = rake(out.select(*cells.columns, F.col("weight").alias("_from")), targets, start="_from")
        out, done = written(step.drop("_from"), "mix-rake"), done + ROUNDS
        error, before = marginal_error(out, targets), error
    return out, error


def wanted_shares(cells: DataFrame, dimension: str, weights: DataFrame | dict[str | None, float]) -> DataFrame:
    """Target shares from weights of some of a dimension's categories, as a dictionary or rows (category, target).

    Categories that occur and have no weight keep their token share; the others divide the rest of one in proportion
    to their weights, which must be positive. Weights of categories that don't occur are left out.
    """
    if isinstance(weights, dict):
        kind = cells.schema[dimension].dataType.simpleString()
        weights = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], f"`{dimension}` {kind}, target double")
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("_tokens"))
    given = weights.select(F.col(dimension).alias("_category"), F.col("target").cast("double").alias("_wanted"))
    rows = sums.join(given, F.col(dimension).eqNullSafe(F.col("_category")), "left")
    of = rows.agg(F.sum("_tokens").alias("all"), F.sum(F.when(F.col("_wanted").isNull(), F.col("_tokens"))).alias("kept"), F.sum("_wanted").alias("wanted"), F.min("_wanted").alias("least")).first()
    if of["least"] is not None and of["least"] <= 0:
        raise ValueError(f"target weights of {dimension} must be positive")
    every = of["all"] or 1.0
    rest = (1 - (of["kept"] or 0.0) / every) / (of["wanted"] or 1.0)
    return rows.select(dimension, F.coalesce(F.col("_wanted") * F.lit(rest), F.col("_tokens") / F.lit(every)).alias("target"))


def budget_scale(raked: DataFrame, budget: float) -> float:
    """The number c for which the chances min(1, c * factor) take ``budget`` tokens from the cells in expectation.

    Cells whose chance reaches one are taken whole and the others share what is left, until no further cell is
    reached; each step is one aggregate of three numbers. A budget of all tokens or more takes everything.
    """
    chance, scale, whole = F.col("factor"), 0.0, -1
    while True:
        full = chance * F.lit(scale) >= 1
        got = raked.agg(
            F.count_if(full).alias("whole"), F.sum(F.when(full, F.col("tokens"))).alias("taken"), F.sum(F.when(~full, F.col("tokens") * chance)).alias("open")
        ).first()
        if got["whole"] == whole or not got["open"]:
            return scale
        whole, scale = got["whole"], max(scale, (budget - (got["taken"] or 0)) / got["open"])


def draw_number(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) that an id and a seed decide."""
    named = F.concat(F.lit(seed), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def with_mix(docs: DataFrame, topic: Column, tokens: Column, id_col: str = "doc_id", power: float = FLATTEN, seed: str = "mix:", into: str = "mix",
             targets: dict[str, DataFrame | dict[str | None, float]] | None = None, tolerance: float | None = None, budget: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` and a struct (topic, n_tokens, probability, sampled) as column ``into``.

    ``targets`` gives weights per dimension (source, lang, topic; see ``wanted_shares``); a dimension without them
    aims at its observed shares to ``power``. With ``tolerance`` passes go on until every marginal share is that near
    its target, and a ``ValueError`` names the error if the cells can't come so near; without it there are ``ROUNDS``
    passes. ``budget`` is the number of tokens to expect in the sample: cells too small for their part are taken whole
    and the others share the rest, so a rare cell doesn't shrink the sample.

    A document's probability is its cell's raked weight over its token share, without a budget scaled so that the largest is one:
    the expected tokens of the sample meet the raked shares and no document is taken twice. Rows that repeat an id
    are drawn together. Null sources, languages and topics are categories, tokens must be positive, other columns
    stay as they are, and an empty table gives no rows.
    """
    rows = docs.withColumn(into, F.struct(topic.alias("topic"), tokens.alias("n_tokens")))
    at = {d: F.col(d) if d != "topic" else F.col(f"{into}.topic") for d in DIMENSIONS}
    cells = rows.groupBy(*[at[d].alias(d) for d in DIMENSIONS]).agg(F.sum(f"{into}.n_tokens").alias("tokens"))
    cells = written(cells, "mix-cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    given = targets or {}
    if unknown := set(given) - set(DIMENSIONS):
        raise ValueError(f"no such dimensions: {sorted(unknown)}")
    aims = {d: wanted_shares(cells, d, given[d]) if d in given else flattened(cells, d, power) for d in DIMENSIONS}
    if tolerance is None:
        raked = rake(cells, aims)
    else:
        raked, error = rake_until(cells, aims, tolerance)
        if error > tolerance:
            raise ValueError(f"the cells don't meet the targets: the largest marginal error is {error:.3g}")
    raked = written(raked.withColumn("factor", F.col("weight") / (F.col("tokens") / F.lit(total))), "mix-raked")
    scaled = F.col("factor") / F.lit(raked.agg(F.max("factor")).first()[0] or 1.0)
    if budget is not None:
        scaled = F.least(F.lit(1.0), F.col("factor") * F.lit(budget_scale(raked, budget)))
    named = raked.select(*[F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS], scaled.alias("_mix_probability"))
    chance, drawn = F.col("_mix_probability"), draw_number(F.col(id_col), seed)
    joined = rows.join(named, [at[d].eqNullSafe(F.col(f"_mix_{d}")) for d in DIMENSIONS])
    found = F.struct(F.col(f"{into}.topic"), F.col(f"{into}.n_tokens"), chance.alias("probability"), (drawn < chance).alias("sampled"))
    return joined.withColumn(into, found).drop(*named.columns)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", power: float = FLATTEN, seed: str = "mix:", topic: Column | None = None, **options) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, sampled (see ``with_mix``).

    ``topic`` is any expression over the columns of ``docs``, by default the form of the text; ``options`` are the
    targets, tolerance and budget of ``with_mix``. The texts are read once; null texts have one token, other columns
    are ignored.
    """
    text = F.col(text_col)
    topic = topic_of(text) if topic is None else topic
    tagged = docs.select(F.col(id_col).alias("doc_id"), "source", "lang", topic.alias("topic"), tokens_of(text).alias("n_tokens"))
    mixed = with_mix(written(tagged, "mix-tagged"), F.col("topic"), F.col("n_tokens"), power=power, seed=seed, **options)
    return mixed.select("doc_id", "source", "lang", "mix.topic", "mix.n_tokens", "mix.probability", "mix.sampled")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def mixing_sql(table: str, power: float = FLATTEN, rounds: int = ROUNDS) -> str:
    """The same sample in DuckDB: common table expressions that end in ``mixed`` (unrounded probabilities)."""
    topic = "case " + " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{n}'" for n, p in TOPICS) + f" else '{OTHER_TOPIC}' end"
    parts = [
        f"tagged as (select *, {topic} as topic, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) + 1 as n_tokens from {table})",
        "cells as (select source, lang, topic, sum(n_tokens)::double as tokens from tagged group by all)",
    ]
    for d in DIMENSIONS:
        parts.append(f"t_{d} as (select {d}, pow(sum(tokens), {power}) as target from cells group by {d})")
    targets = ", ".join(f"t_{d}.target / (select sum(target) from t_{d}) as g_{d}" for d in DIMENSIONS)
    joins = " ".join(f"join t_{d} on cells.{d} is not distinct from t_{d}.{d}" for d in DIMENSIONS)
    parts.append(f"w0 as (select cells.*, tokens / (select sum(tokens) from cells) as w, {targets} from cells {joins})")
    step = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"w{step + 1} as (select * replace (w * g_{d} / sum(w) over (partition by {d}) as w) from w{step})")
            step += 1
    parts.append(f"factors as (select source, lang, topic, w / (tokens / (select sum(tokens) from cells)) as f from w{step})")
    same = " and ".join(f"tagged.{d} is not distinct from factors.{d}" for d in DIMENSIONS)
    drawn = f"('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {2**52}.0"
    parts.append(f"mixed as (select tagged.*, f / (select max(f) from factors) as probability, {drawn} < f / (select max(f) from factors) as sampled from tagged join factors on {same})")
    return ",\n".join(parts)


OP5_SQL = f"with {mixing_sql('documents')} select doc_id, source, lang, topic, n_tokens, round(probability, 6) as probability, sampled from mixed"

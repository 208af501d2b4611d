"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Token weights are summed by cell (source, language, topic) in one aggregation of the documents; raking then scales
the cells' factors to each marginal's target in turn, with groupings and joins of the small cell table, until all marginals meet their
targets to within CLOSE of all tokens or a round brings them nearer by less than a share of STALL (targets that contradict each other on the cells there are
can't be met). What they are still off by stands beside each row's weight, and beyond TOLERANCE a warning tells it. A
document stays with probability factor / largest factor, decided by a hash of its id, so the kept tokens follow the
targets in expectation and a rerun decides alike. There the smallest cell can decide how much stays. With a budget (``keep``, a share of
all tokens) factors are held to 1 while raking, so that the other cells take over what a clipped one can't give, and then scaled
until the expected tokens meet the budget: cells too small for their target stay whole. All DataFrame functions.

Defined results: null classes and null texts are classes '' and texts of no words; a document without words weighs nothing but
stays with its cell's probability; classes without a target share keep theirs at 0 only if the target says so, missing
targets leave the class as it is; rows with equal ids are decided alike; long texts count whole; the columns of documents stay as
they are, and the added one takes a name that none of them has; an empty table gives an empty one.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachlens.runtime import discard, materialize

CLOSE, STALL, TOLERANCE = 1e-6, 0.05, 1e-3
#: Rounds that the SQL writes out; those after the one that raking ends with change nothing.
ROUNDS = 40
#: Exponents by which the production query evens out the natural shares of the classes.
EVEN = {"source": 0.7, "lang": 0.7, "topic": 0.85}
#: Share of the tokens that the pipeline keeps.
KEEP = 0.8
#: Cells up to which their factors are broadcast (under 10 MB).
BROADCAST_CELLS = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def topic(text: Column) -> Column:
    """A coarse topic by form: tables, notices, symbol-laden or plain text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("icense")), "notice")
        .when(F.contains(text, F.lit("!!")) | F.contains(text, F.lit("###")), "symbols").otherwise("plain")
    )


def unused(columns: list[str], name: str) -> str:
    """``name``, with further underscores while one of ``columns`` has it."""
    return unused(columns, "_" + name) if name.lower() in map(str.lower, columns) else name


def marked(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` and its classes and weight in one struct column ``name``."""
    text = F.col(text_col)
    return docs.withColumn(name, F.struct(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), topic(text).alias("topic"), words(text).alias("n_tokens")))


def cells_of(docs: DataFrame) -> DataFrame:
    mix = marked(docs.select("source", "lang", "text"), "_mix").select("_mix.*")
    return mix.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("factor", F.lit(1.0))


def even_targets(cells: DataFrame, exponents: dict[str, float]) -> dict[str, DataFrame]:
    """By class column: (class, share) with natural token shares raised to an exponent."""
    out = {}
    for name, power in exponents.items():
        natural = cells.groupBy(name).agg(F.sum("n_tokens").cast("double").alias("n"))
        raised = natural.select(name, F.pow("n", F.lit(power)).alias("share"))
        whole = raised.agg(F.sum("share").alias("s")).first()["s"] or 1.0
        out[name] = raised.withColumn("share", F.col("share") / F.lit(whole))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int | None = None, keep: float | None = None) -> DataFrame:
    """``cells`` with factors under which the token shares of every class column meet their targets, and ``off``: by how much the farthest of a
    cell's marginals was off before the last round. With ``keep``, factors of 1 at most, which sum to that share of the tokens as far as the targets can
    be met. ``rounds``: at most so many, met or not.

    Each round is written, so plans stay as small as one scaling of each class column, however many rounds there are.
    """
    total = float(cells.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0) * (1.0 if keep is None else keep)
    own = cells.columns
    for name, target in targets.items():
        cells = cells.join(target.select(name, F.col("share").alias(f"_share_{name}")), name, "left")
    cells, off = materialize(cells.withColumn("_off", F.lit(0.0))), float("inf")
    done = 0
    while True:
        new, start = cells.withColumn("_off", F.lit(0.0)), cells
        for name in targets:
            now = new.groupBy(name).agg(F.sum(F.col("n_tokens") * F.col("factor")).alias("_now"))
            share = F.col(f"_share_{name}")
            fixed = share.isNull() | (F.col("_now") == 0)
            scale = F.when(fixed, F.col("factor")).otherwise(F.col("factor") * (share * F.lit(total) / F.col("_now")))
            scale = scale if keep is None else F.least(F.lit(1.0), scale)
            # how far the marginals were off before this round's scaling
            away = F.when(fixed, F.lit(0.0)).otherwise(F.abs(share - F.col("_now") / F.lit(total or 1.0)))
            new = new.join(now, name).withColumns({"factor": scale, "_off": F.greatest(F.col("_off"), away)})
            new = new.select(*cells.columns)
        cells = materialize(new)
        discard(start)
        before, off = off, cells.agg(F.max("_off").alias("m")).first()["m"] or 0.0
        done += 1
        if off <= CLOSE or off > (1 - STALL) * before or done == rounds:
            break
    if off > TOLERANCE:
        warnings.warn(f"a marginal is off its target by {off:.2%} of the tokens", stacklevel=2)
    out = cells.select(*own, F.col("_off").alias("off"))
    out._reachlens_path = cells._reachlens_path
    return out


def divisor(raked: DataFrame, keep: float | None = None) -> float:
    """What factors are divided by, and clipped at 1, to be probabilities: the largest, or one that keeps a share of the tokens."""
    if keep is None:
        return raked.filter("n_tokens > 0").agg(F.max("factor").alias("f")).first()["f"] or 1.0
    budget, scale = keep * float(raked.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0), 0.0
    while True:  # the kept tokens are concave in the scale, so these steps only rise, and each but the last clips further cells
        clipped = F.col("factor") * F.lit(scale) >= 1
        got = raked.agg(F.sum(F.when(clipped, F.col("n_tokens"))).alias("whole"), F.sum(F.when(~clipped, F.col("n_tokens") * F.col("factor"))).alias("free")).first()
        new = (budget - (got["whole"] or 0)) / got["free"] if got["free"] else scale
        if new <= scale * (1 + 1e-9):
            return 1.0 / scale if scale else 1.0
        scale = new


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) by the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", keep: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are sampled, with a last column, the struct ``_mix``: classes, n_tokens, weight (the raked factor), probability, and
    deviation, the tokens' share by which the farthest marginal is off its target (the same for all).

    targets: by class column (source, lang, topic) a table (class, share); by default EVEN's. keep: the share of
    the tokens to keep; by default what the largest factor leaves.
    """
    cells = materialize(cells_of(docs))
    raked = rake(cells, targets or even_targets(cells, EVEN), keep=keep)
    off = raked.agg(F.max("off")).first()[0] or 0.0
    discard(cells)
    top, name = divisor(raked, keep), unused(docs.columns, "_mix")
    cell, factor = unused([*docs.columns, name], "_cell"), unused([*docs.columns, name], "_f")
    factors = raked.select(F.struct("source", "lang", "topic").alias(cell), F.col("factor").alias(factor))
    if raked.count() <= BROADCAST_CELLS:
        factors = F.broadcast(factors)
    own = marked(docs, name)
    mine = lambda *fields: [F.col(name).getField(f) for f in fields]
    probability = F.least(F.lit(1.0), F.col(factor) / F.lit(top))
    own = own.join(factors, F.struct(*mine("source", "lang", "topic")) == F.col(cell)).filter(chance(F.col(id_col)) < probability)
    whole = F.struct(*(x.alias(f) for x, f in zip(mine("source", "lang", "topic", "n_tokens"), ("source", "lang", "topic", "n_tokens"), strict=True)), F.col(factor).alias("weight"), probability.alias("probability"), F.lit(off).alias("deviation"))
    return own.select(*(F.col(f"`{c}`") for c in docs.columns), whole.alias(name))


def digest(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    mix = F.col(mixed.columns[-1])
    return mixed.select(id_col, *(mix[f].alias(f) for f in ("source", "lang", "topic", "n_tokens")), *(F.round(mix[f], 6).alias(f) for f in ("weight", "probability")))


def sql(rounds: int = ROUNDS) -> str:
    """The same by plain SQL: each round of raking written out."""
    steps = [
        """d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\x0C\\r]+')), 0)::BIGINT AS n_tokens,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, 'icense') THEN 'notice' WHEN contains(text, '!!') OR contains(text, '###') THEN 'symbols' ELSE 'plain' END AS topic FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n, 1.0::DOUBLE AS f FROM d GROUP BY ALL)",
        "t AS (SELECT sum(n) AS total FROM c)",
        *(f"t_{k} AS (SELECT {k}, p / sum(p) OVER () AS share FROM (SELECT {k}, pow(sum(n), {e}) AS p FROM c GROUP BY {k}))" for k, e in EVEN.items()),
    ]
    last, state = "c", "(SELECT true AS go, 'inf'::DOUBLE AS off)"
    for i in range(rounds):
        for k in EVEN:
            steps.append(f"m{i}_{k} AS MATERIALIZED (SELECT {k}, sum(n * f) AS now, CASE WHEN sum(n * f) = 0 THEN 0 ELSE abs(any_value(t_{k}.share) - sum(n * f) / any_value(t.total)) END AS away FROM {last} JOIN t_{k} USING ({k}), t GROUP BY {k})")
            new = f"r{i}_{k}"
            steps.append(f"{new} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.n, CASE WHEN m.now = 0 OR NOT s.go THEN x.f ELSE x.f * (t_{k}.share * t.total / m.now) END AS f FROM {last} x JOIN m{i}_{k} m USING ({k}) JOIN t_{k} USING ({k}), t, {state} s)")
            last = new
        off = ", ".join(f"(SELECT coalesce(max(away), 0) FROM m{i}_{k})" for k in EVEN)
        steps.append(f"s{i} AS MATERIALIZED (SELECT go AND NOT (now_off <= {CLOSE} OR now_off > {1 - STALL} * off) AS go, now_off AS off FROM (SELECT go, off, greatest({off}) AS now_off FROM {state}))")
        state = f"s{i}"
    return "WITH " + ",\n".join(steps) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(x.f, 6) AS weight, round(least(1.0, x.f / top.f), 6) AS probability
FROM d JOIN {last} x USING (source, lang, topic), (SELECT max(f) AS f FROM {last} WHERE n > 0) top
WHERE ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 < least(1.0, x.f / top.f)
"""

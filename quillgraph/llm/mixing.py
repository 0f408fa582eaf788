"""Mixing to target weights by soft membership, in DataFrame operations alone.

A naive Bayes classifier is fitted on labelled rows (at most ``LEARN_ROWS``, chosen by the hash of
their ids) and kept as a table of ``VOCABULARY`` words with a log-likelihood for each domain. A
third of these rows is left out of the table and serves to measure how far its evidence can be
trusted: the log-likelihoods are multiplied by the temperature of the least log-loss there. The
table then predicts every document's posterior over the domains. Rates minimise the squared distance
between the domains' expected token totals, ``sum_i rate_i tokens_i posterior_id``, and their
targets, with no rate under ``least_rate`` (0 or more), whether the targets can be met or not.

The minimum is found by projected gradient steps from rates of 1. Posteriors are kept in parts of
``GRAIN``; a document's rate depends on its posterior alone, so equal posteriors are added up
first, and each step is one aggregation over what is left: ``rate_i <- max(least, rate_i - c_i posterior_i . residual / L)``. The gradient is scaled
by ``c_i / tokens_i`` with ``c_i`` one over the posterior's mean of the domains' tokens; a scale for each
document leaves the minimum where it is, and L, the greatest eigenvalue of
``sum_i tokens_i c_i posterior_i posterior_i^T``, makes the steps safe. Steps have momentum, which
starts anew whenever the distance grows. They end once every total is within ``CLOSE`` of its target,
or once the optimality conditions bound the squared distance to within ``GAP`` of the least; a fit that ``STEPS`` end before that warns,
and ``Fit`` reports steps, distance and gap in any case.

Defined results: a null or empty text has no tokens, the prior as posterior, and a rate like any
other's. Rows without a domain are not learned from but get posteriors and rates. Without any
labelled row there is one domain, ``unknown``; more than ``DOMAINS`` raise an error. Targets of domains
that no row has cannot be met and are left out. Repeated rows are all returned. Columns besides id, text
and domain are ignored, whatever their names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from quillgraph.llm.common import checkpoint, hash_unit

#: Labelled rows to learn from, and words in the classifier's table, at most. More domains than these raise an error, as each takes a column.
LEARN_ROWS, VOCABULARY, DOMAINS = 4500, 4096, 512
#: Temperatures that are tried.
TEMPERATURES = tuple(2.0**-n for n in range(13))
#: Parts that posteriors are rounded to, and numbers in all distinct ones up to which their rates are broadcast; beyond, they are joined over ``SALTS`` tasks each.
GRAIN, FEW, SALTS = 1024, 400_000, 32
#: Steps at most, steps whose outcome is kept as a formula before it is written, what counts as met, as a share of all tokens, and what counts as the least, as a share of their square.
STEPS, HELD, CLOSE, GAP = 2000, 32, 1e-6, 1e-5
UNKNOWN = "unknown"


def _words(text: Column) -> Column:
    return F.split(F.lower(text), "\\s+")


@dataclass
class Classifier:
    """Domains, their log priors, a table (word, l0, l1, ...) of log-likelihoods, and the temperature that they are multiplied by."""

    domains: list[str]
    priors: list[float]
    table: DataFrame
    temperature: float = 1.0


@dataclass
class Fit:
    """Rates and how the fit ended: steps, distance to the targets and bound on what it exceeds the least by, as shares of all target tokens."""

    rates: DataFrame
    steps: int
    distance: float
    gap: float


def classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang") -> Classifier:
    """A classifier from the rows that have a domain."""
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(domain_col).cast("string").alias("domain")).where("domain is not null")
    sizes = labelled.groupBy("domain").count().orderBy("domain").limit(DOMAINS + 1).collect()
    if len(sizes) > DOMAINS:
        raise ValueError(f"more than {DOMAINS} domains; group them first")
    domains = [r["domain"] for r in sizes]
    if not domains:
        return Classifier([UNKNOWN], [0.0], spark.createDataFrame([], "word string, l0 double"))
    total = sum(r["count"] for r in sizes)
    priors = [float(np.log(r["count"] / total)) for r in sizes]
    unit = hash_unit(F.col("doc_id"), F.lit(13)) * total / LEARN_ROWS
    chosen = labelled.where(unit < 1)
    aside = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(3)) == 0
    words = chosen.where(~aside).select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''")
    each = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *each).orderBy(F.desc("n"), "word").limit(VOCABULARY)
    counts = checkpoint(counts)
    sums = counts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(domains))]).first()
    terms = [F.log((F.col(f"n{i}") + 0.5) / float((sums[f"n{i}"] or 0) + 0.5 * VOCABULARY)).alias(f"l{i}") for i in range(len(domains))]
    model = Classifier(domains, priors, counts.select("word", *terms))
    tried = chosen.where(aside).select("doc_id", "text", F.element_at(F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(i + 1))]), F.col("domain")).alias("at"))
    logs = _evidence(tried, model, "at").select("at", F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(domains))]).alias("s"))
    losses = logs.agg(*[F.sum(-F.log(F.element_at(_posterior("s", priors, t), F.col("at")) + 1e-12)).alias(f"t{n}") for n, t in enumerate(TEMPERATURES)]).first()
    if losses[0] is not None:
        model.temperature = TEMPERATURES[int(np.argmin([float(x) for x in losses]))]
    return model


def _evidence(rows: DataFrame, model: Classifier, *kept: str) -> DataFrame:
    """Rows (doc_id, text) with their tokens and sums of log-likelihoods s0, s1, ...; ``kept`` columns stay."""
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *kept, _words(F.col("text")).alias("words"))
    met = numbered.select("row", "doc_id", *kept, F.explode_outer("words").alias("word")).join(F.broadcast(model.table), "word", "left")  # at most VOCABULARY rows
    tokens = F.sum(F.coalesce((F.col("word") != "").cast("long"), F.lit(0))).alias("n_tokens")
    return met.groupBy("row", "doc_id", *kept).agg(tokens, *[F.sum(f"l{i}").alias(f"s{i}") for i in range(len(model.domains))])


def _posterior(logs: str, priors: list[float], temperature: float) -> Column:
    """Probabilities of the domains from an array of sums of log-likelihoods."""
    raised = F.zip_with(F.col(logs), F.array(*[F.lit(p) for p in priors]), lambda s, p: s * temperature + p)
    powers = F.transform(F.array(raised), lambda x: F.transform(x, lambda y: F.exp(y - F.array_max(x))))[0]
    return F.transform(F.array(powers), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]


def memberships(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, p): tokens and posterior of every row, checkpointed."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sums = _evidence(rows, model).select("doc_id", "n_tokens", F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(len(model.domains))]).alias("s"))
    parts = F.transform(_posterior("s", model.priors, model.temperature), lambda x: F.round(x * GRAIN))
    shares = F.transform(F.array(parts), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))[0]
    return checkpoint(sums.select("doc_id", "n_tokens", shares.alias("p")))


def _after(steps: list[tuple[np.ndarray, float]], least: float) -> Column:
    """The struct z (r, y) after the steps: the rate, and the point at which the next step is taken."""
    if not steps:
        return F.col("z")
    listed = ", ".join("named_struct('g', array(" + ", ".join(f"{v!r}D" for v in g.tolist()) + f"), 'b', {b!r}D)" for g, b in steps)
    dot = " + ".join(f"p[{i}] * s.g[{i}]" for i in range(len(steps[0][0])))
    moved = f"transform(array(greatest({least!r}D, z.y - c * ({dot}))), r -> named_struct('r', r, 'y', (1D + s.b) * r - s.b * z.r))[0]"
    return F.expr(f"aggregate(array({listed}), z, (z, s) -> {moved})")


def totals(members: DataFrame, k: int, rate: Column | None = None) -> np.ndarray:
    """Expected tokens of the k domains at the rates."""
    rows = members.withColumn("_rate", F.lit(1.0) if rate is None else rate)
    found = rows.agg(*[F.sum(F.col("n_tokens") * F.col("_rate") * F.element_at("p", i + 1)).alias(f"t{i}") for i in range(k)]).first()
    return np.array([float(x or 0.0) for x in found])


def _dot(g: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(g.tolist()):
        out = out + F.element_at("p", i + 1) * x
    return out


def fit_rates(members: DataFrame, targets: np.ndarray, least_rate: float = 0.0) -> Fit:
    """``members`` with a column rate, whose expected totals are as near to the targets as rates of at least ``least_rate`` can make them."""
    k, least = len(targets), float(least_rate)
    all_tokens = max(float(targets.sum()), 1.0)
    groups = checkpoint(members.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")))
    n_groups = groups.count()
    groups = groups.coalesce(n_groups * k // FEW + 1)
    mass = totals(groups, k)
    scaled = groups.withColumn("c", F.lit(1.0) / F.greatest(_dot(mass), F.lit(1e-9)))
    products = [F.sum(F.col("n_tokens") * F.col("c") * F.element_at("p", i + 1) * F.element_at("p", j + 1)) for i in range(k) for j in range(i, k)]
    found = iter(scaled.agg(*[x.alias(f"m{n}") for n, x in enumerate(products)]).first())
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = float(next(found) or 0.0)
    rate = 1.0 / max(float(np.linalg.eigvalsh(m)[-1]), 1e-12)
    start = F.lit(max(1.0, least))
    rows = scaled.withColumn("z", F.struct(start.alias("r"), start.alias("y")))
    steps: list[tuple[np.ndarray, float]] = []
    taken, worth, run, calm = 0, np.inf, -1, 0
    while True:
        residual = totals(rows, k, _after(steps, least)["y"]) - targets
        now = float(residual @ residual) / all_tokens**2
        calm = calm + 1 if abs(worth - now) <= CLOSE**2 + 1e-9 * now else 0
        if np.abs(residual).max() <= 0.5 * CLOSE * all_tokens or calm >= 3 or taken >= STEPS:
            reached = _after(steps, least)["r"]
            residual = totals(rows, k, reached) - targets
            over = (reached - F.lit(least)) * F.col("n_tokens")
            slope = _dot(residual)
            ends = rows.agg(F.sum(over * slope).alias("slack"), F.min(F.when(F.col("n_tokens") > 0, slope)).alias("worst"), F.sum(over).alias("over")).first()
            gap = (abs(ends["slack"] or 0.0) + max(0.0, -(ends["worst"] or 0.0)) * max(ends["over"] or 0.0, all_tokens)) / all_tokens**2
            if np.abs(residual).max() <= CLOSE * all_tokens or gap <= GAP or taken >= STEPS:
                break
            calm = 0
        run = 0 if now > worth else run + 1
        worth, taken = now, taken + 1
        steps.append((rate * residual, run / (run + 3.0)))
        if len(steps) == HELD:
            rows, steps = checkpoint(rows.withColumn("z", _after(steps, least))).coalesce(n_groups * k // FEW + 1), []
    distance = float(np.sqrt(residual @ residual)) / all_tokens
    if gap > GAP and np.abs(residual).max() > CLOSE * all_tokens:
        warnings.warn(f"rates are not settled after {taken} steps: distance {distance:.2e}, gap {gap:.2e} of all tokens", stacklevel=2)
    rates = checkpoint(rows.select("p", F.round(_after(steps, least)["r"], 9).alias("rate")))
    if n_groups * k <= FEW:
        return Fit(members.join(F.broadcast(rates), "p"), taken, distance, gap)
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(SALTS)).cast("int"))
    spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return Fit(salted.join(spread, ["p", "salt"]).drop("salt"), taken, distance, gap)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", least_rate: float = 0.0, flatten: float = 0.0, growth: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) for every row.

    ``weights`` are the domains' target shares of all tokens; without them the shares found are
    raised to the power ``flatten`` (0: equal shares). The targets add up to ``growth`` times the tokens found.
    """
    model = classifier(docs, id_col, text_col, domain_col)
    domains = model.domains
    members = memberships(docs, model, id_col, text_col)
    now = totals(members, len(domains))
    if weights is None:
        wish = np.where(now > 0, now, 0.0) ** flatten * (now > 0)
    else:
        wish = np.array([weights.get(d, 0.0) for d in domains]) * (now > 0)
    share = wish / wish.sum() if wish.sum() > 0 else wish
    rated = fit_rates(members, share * now.sum() * growth, least_rate).rates
    best = F.array_position("p", F.array_max("p")).cast("int")
    named = F.element_at(F.array(*[F.lit(d) for d in domains]), best)
    return rated.select(F.col("doc_id").alias(id_col), "n_tokens", named.alias("domain"), F.col("p").alias("posterior"), "rate")


def apply_rates(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows repeated by their rates: the whole part, and once more with the fraction as probability, decided by the id's hash.

    Rows that share an id get the mean of its rates; rows without an id or a rate stay once. Columns keep their names, whatever these are.
    """
    known = rates.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.avg("rate").alias("rate"))
    rows = docs.select(F.col(id_col).alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    met = rows.join(known, "k", "left").select("k", "row", F.coalesce("rate", F.lit(1.0)).alias("rate"))
    copies = (F.floor("rate") + (hash_unit(F.col("k"), F.lit(29)) < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    repeated = met.select("row", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))).alias("copy"))
    return repeated.select("row.*")

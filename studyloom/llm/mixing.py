"""Problem 9: mixing sources to target weights, sizes counted in tokens of a public tokenizer.

Method: temperature mixing. Token shares of the sources are raised to an exponent and normalised, clipped by
what a source can give (its tokens times its highest number of uses) and poured out again over the others. With target shares, every source first
gets its target as far as its repetition limit lets it; what the exhausted ones leave is tempered: it goes to the others by their token shares to the
exponent, bisected until the mix has the entropy that the targets have with the exhausted sources at their limits (or the nearest it can have), so that it is as even as was wanted. Without any
target the whole mix is tempered: the exponent is bisected to the wanted entropy, or to the flattest weights that no repetition limit clips.
The weights are realised as blocks: each use of a source is one permutation of its texts (by a seeded hash); whole
permutations are taken while the source's budget lasts, and of the last one so many texts, in the permutation's
order, as fit the rest.

Scale. Tokens are counted once per text in one narrow pass. What reaches the driver are the totals per source (as many rows
as mix_targets has) and, for the last permutation of each source, totals per block of hash values (`BLOCKS` each): a
prefix sum over blocks finds the block in which the budget ends, and only that block is ordered, so no source is
ever sorted in one task, be it a third of all rows.

Defined results: targets that can all be met are met, whatever the exponent (it is then reported as 0); texts of a NULL or unlisted source take no part; NULL and empty texts have no tokens and are used as often
as any other; a source without texts reaches share 0; repeated rows are texts of their own; NULL targets count
as 0 (all of them: no targets) and NULL max_repeats as 1; no table row means an empty mix.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyloom.llm.corpus_tokens import TOKENIZERS, encode, encoder
from studyloom.session import cut, spread

BLOCKS = 1024


def poured(base: dict[str, float], most: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights in proportion to base**exponent, none above its `most`, which add up to 1 if that is possible."""
    open_, fixed = {s for s, b in base.items() if b > 0 and most[s] > 0}, {}
    top = max((math.log(base[s]) for s in open_), default=0.0)  # large exponents neither overflow nor vanish together
    raw = {s: math.exp(exponent * (math.log(base[s]) - top)) for s in open_}
    while open_:
        rest, total = 1 - sum(fixed.values()), sum(raw[s] for s in open_)
        over = {s for s in open_ if total > 0 and rest * raw[s] / total > most[s]}
        if not over:
            return {s: (rest * raw[s] / total if s in open_ and total > 0 else fixed.get(s, 0.0)) for s in base}
        fixed |= {s: most[s] for s in over}
        open_ -= over
    return {s: fixed.get(s, 0.0) for s in base}


def entropy(weights: dict[str, float]) -> float:
    total = sum(weights.values()) or 1.0
    return -sum(w / total * math.log(w / total) for w in weights.values() if w > 0)


def temperature(base: dict[str, float], most: dict[str, float], wanted: float | None) -> tuple[dict[str, float], float]:
    """(weights, exponent). wanted: the entropy to reach; None: the flattest weights (smallest exponent from 0 up) that
    no repetition limit clips."""
    if wanted is None:
        low, high = 0.0, 1.0
        bound = lambda e: any(w >= most[s] * (1 - 1e-12) for s, w in poured(base, most, e).items() if base[s] > 0)
        if not bound(low):
            return poured(base, most, low), low
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if bound(middle) else (low, middle)
        return poured(base, most, high), high
    low, high = 0.0, 8.0
    for _ in range(80):  # entropy falls with the exponent
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(poured(base, most, middle)) > wanted else (low, middle)
    exponent = (low + high) / 2
    return poured(base, most, exponent), exponent


def token_sizes(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    folder: str = TOKENIZERS,
    name: str = "byte_bpe_50k",
) -> DataFrame:
    def run(batches):
        enc, _ = encoder(folder, name)
        for batch in batches:
            sizes = [len(encode(enc, t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"]
            )

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string")
    )
    return spread(rows).mapInArrow(run, "doc_id long, source string, tokens long")


def tempered_rest(
    targets: dict[str, float], shares: dict[str, float], most: dict[str, float], exponent: float | None = None
) -> tuple[dict[str, float], float]:
    """(weights, exponent): targets as far as `most` allows, the rest by shares**exponent over the sources that have room. exponent=None: bisected to the
    entropy that the targets leave once the exhausted sources are at their limits; of several such exponents the one nearest to 1 (the sources as large as they are)."""
    filled = {s: min(t, most[s]) for s, t in targets.items()}
    rest = 1 - sum(filled.values())
    if rest <= 1e-12:
        return filled, 0.0
    room = {s: max(0.0, most[s] - filled[s]) / rest if shares[s] > 0 else 0.0 for s in targets}

    def weights(e: float) -> dict[str, float]:
        extra = poured(shares, room, e)
        return {s: filled[s] + rest * extra[s] for s in filled}

    if exponent is not None:
        return weights(exponent), exponent
    wanted = entropy(poured(targets, {s: most[s] if shares[s] > 0 else 0.0 for s in targets}, 1.0))
    over = lambda e: entropy(weights(e)) - wanted
    grid = [n / 8 for n in range(-32, 65)]
    values = [over(e) for e in grid]
    crossings = [(abs(grid[n] - 1), n) for n in range(len(grid) - 1) if (values[n] > 0) != (values[n + 1] > 0)]
    if not crossings:
        best = min(range(len(grid)), key=lambda n: (round(abs(values[n]), 12), abs(grid[n] - 1)))
        return weights(grid[best]), grid[best]
    n = min(crossings)[1]
    low, high, sign = grid[n], grid[n + 1], values[n] > 0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (over(middle) > 0) == sign else (low, middle)
    return weights((low + high) / 2), (low + high) / 2


def plan(
    totals: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: int | None, wanted: float | None = None
) -> tuple[dict[str, float], dict[str, float], float, int]:
    """(budget in tokens of each source, weight of each, exponent, budget of all). Default budget: the tokens of all listed sources."""
    total = sum(totals.values())
    budget = total if budget is None else budget
    most = {s: repeats[s] * totals[s] / budget if budget else 0.0 for s in totals}
    shares = {s: t / total if total else 0.0 for s, t in totals.items()}
    scale = sum(targets.values())
    if scale > 0:
        weights, exponent = tempered_rest({s: t / scale for s, t in targets.items()}, shares, most)
    else:
        weights, exponent = temperature(shares, most, wanted)
    return {s: weights[s] * budget for s in totals}, weights, exponent, budget


def mix(
    documents: DataFrame,
    targets: DataFrame,
    budget: int | None = None,
    exact: bool = False,
    wanted_entropy: float | None = None,
    seed: int = 17,
    folder: str = TOKENIZERS,
    name: str = "byte_bpe_50k",
) -> tuple[DataFrame, DataFrame]:
    """(the mix: doc_id, source, tokens, uses; the report: one row for each listed source).

    budget: tokens of the mix, by default those of all listed sources once; exact: the largest mix in which every source that has texts
    still reaches its target share, instead; wanted_entropy: that of the mix where there are no targets."""
    spark = documents.sparkSession
    wanted = {
        r.source: (float(r.target_share or 0), int(1 if r.max_repeats is None else r.max_repeats))
        for r in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect()
    }
    # counted once, then narrow: a text's place in a permutation is a hash of its id, its row and the seed
    sizes = cut(
        token_sizes(documents, folder=folder, name=name)
        .where(F.col("source").isin(list(wanted)))
        .withColumn("place", F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(seed)))
        .withColumn("block", F.pmod(F.shiftright("place", 20), F.lit(BLOCKS)).cast("int"))
    )
    blocks = {
        (r.source, r.block): r.tokens for r in sizes.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect()
    }
    totals = {s: sum(t for (x, _), t in blocks.items() if x == s) for s in wanted}
    if exact:
        scale = sum(t for s, (t, _) in wanted.items() if totals[s]) or 1.0
        filled = [r * totals[s] / (t / scale) for s, (t, r) in wanted.items() if totals[s] and t > 0]
        budget = int(min(filled, default=0))
    budgets, weights, exponent, _ = plan(
        totals, {s: t for s, (t, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}, budget, wanted_entropy
    )
    ends = []
    for s in wanted:
        full = min(wanted[s][1], int(budgets[s] // totals[s])) if totals[s] else 0
        rest = budgets[s] - full * totals[s] if full < wanted[s][1] else 0.0
        at, before = 0, 0
        while at < BLOCKS and before + blocks.get((s, at), 0) <= rest:
            before += blocks.get((s, at), 0)
            at += 1
        ends.append((s, full, at if rest > 0 else 0, float(rest - before) if rest > 0 else 0.0))
    ended = F.broadcast(spark.createDataFrame(ends, "source string, full int, last_block int, rest double"))
    placed = sizes.join(ended, "source")
    whole = placed.where("block <> last_block").withColumn("extra", F.expr("int(block < last_block)"))
    order = Window.partitionBy("source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    partly = placed.where("block = last_block").withColumn(
        "extra", (F.sum("tokens").over(order) - F.col("tokens") / 2 <= F.col("rest")).cast("int")  # the nearest end
    )
    mixed = (
        whole.unionByName(partly)
        .withColumn("uses", F.col("full") + F.col("extra"))
        .where("uses > 0")
        .select("doc_id", "source", "tokens", "uses")
    )
    known = spark.createDataFrame(
        [(s, t, r, int(totals[s]), float(weights[s]), exponent) for s, (t, r) in wanted.items()],
        "source string, target_share double, max_repeats int, tokens long, planned_share double, exponent double",
    )
    reached = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("uses")).alias("mixed_tokens"),
        F.count(F.lit(1)).alias("texts"),
        F.max("uses").alias("most_uses"),
    )
    report = (
        known.join(reached, "source", "left")
        .fillna(0, ["mixed_tokens", "texts", "most_uses"])
        .withColumn("actual_share", F.try_divide("mixed_tokens", F.sum("mixed_tokens").over(Window.partitionBy())))
    )
    return mixed, report

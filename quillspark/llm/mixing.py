"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens, raised to an exponent and
normalised.  The exponent is bisected, on a grid of ``STEPS`` halvings of
[0, 1], to the largest value at which the weights' entropy is at least
``entropy`` times that of equal weights; if at some exponent a source would be
repeated more than ``repeats`` times within the budget, the exponent is raised
to the smallest at which none is, which takes precedence (at the exponent 1 all
sources repeat alike).  The budget, a multiple of the corpus' tokens, is divided
by the weights.  Each source realises its part as permutations of blocks: its
documents are hashed to blocks of about ``block_tokens`` tokens, each pass takes
the blocks in an order of its own, and the last pass ends where the part is
used up, within a block by an order of its documents; the document that crosses
the limit is the last.

Defined results: a null or blank text has no tokens and isn't taken; documents
of a null source form one source; rows of equal doc_id are ordered by their
text; a text of any length counts whole; a source or corpus without tokens gives
nothing; an empty table gives an empty result.  All columns of docs pass
through, whatever their names, followed by ``mix_epoch``, ``mix_block`` (the
block's place in its pass) and ``mix_place`` (a row's place in a block of which
only a part is taken, else 0); where docs has a column of such a name, the new
one ends in an underscore more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

#: Share of the entropy of equal weights that the mixture has at least.
ENTROPY = 0.97
#: Times at most that a source is repeated.
REPEATS = 4.0
#: Tokens to take, as a multiple of the corpus' tokens.
BUDGET = 1.0
#: Tokens of a block, about.
BLOCK_TOKENS = 100_000
STEPS = 20
#: Sources, or blocks of all passes, that are broadcast at most.
BROADCAST_ROWS = 500_000
#: First characters of the hash that orders a pass' blocks; blocks that share them are ordered in one task.
LEAD = 3

WORD = "[^ \\t\\n\\r]+"


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised powers of the shares of the tokens."""
    total = sum(tokens)
    raw = [(n / total) ** exponent if n else 0.0 for n in tokens]
    return [x / sum(raw) for x in raw]


def exponent(tokens: list[int], entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, steps: int = STEPS) -> float:
    """The exponent for sources of these tokens."""
    tokens = [n for n in tokens if n]
    if len(tokens) < 2:
        return 1.0
    goal = entropy * math.log(len(tokens))
    total = sum(tokens)

    def spread(k: int) -> bool:
        return -sum(w * math.log(w) for w in weights(tokens, k / (1 << steps)) if w) >= goal - 1e-12

    def short(k: int) -> bool:
        return max(w * budget * total / n for w, n in zip(weights(tokens, k / (1 << steps)), tokens, strict=True)) <= max(repeats, budget) + 1e-9

    low, high = 0, 1 << steps
    if not spread(high):
        while high - low > 1:  # spread holds at low (equal weights), not at high
            middle = (low + high) // 2
            low, high = (middle, high) if spread(middle) else (low, middle)
    else:
        low = high
    if not short(low):
        lack, fits = low, 1 << steps
        while fits - lack > 1:
            middle = (lack + fits) // 2
            lack, fits = (lack, middle) if short(middle) else (middle, fits)
        low = fits
    return low / (1 << steps)


def counted(docs: DataFrame) -> DataFrame:
    """(source, part, tokens) of each row with tokens: the number that places it in a block, and its size."""
    part = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return docs.select(F.col("source").alias("source"), part.alias("part"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("tokens")).where("tokens > 0")


def plan(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS) -> list[tuple[str | None, int, int, int]]:
    """(source, tokens, blocks, budget in tokens) of each source of counted rows: one row a source comes to the driver."""
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    found = sorted(((r["source"], r["n"]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    if not found:
        return []
    tokens = [n for _, n in found]
    share = weights(tokens, exponent(tokens, entropy, repeats, budget))
    total = sum(tokens)
    return [(s, n, max(1, -(-n // block_tokens)), int(math.floor(w * budget * total + 0.5))) for (s, n), w in zip(found, share, strict=True)]


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of docs that the mixture takes, as often as it takes them."""
    spark = docs.sparkSession
    rows = _spark.checkpoint(counted(docs))
    known = plan(rows, entropy, repeats, budget, block_tokens)
    sources = spark.createDataFrame(known, "s string, n bigint, blocks bigint, part bigint")
    # their numbers are known from the plan: few sources or blocks travel to all executors, many are joined by shuffle
    near = F.broadcast if len(known) <= BROADCAST_ROWS else (lambda x: x)
    passes_count = sum(b * (-(-p // n)) for _, n, b, p in known)
    near_blocks = F.broadcast if passes_count <= BROADCAST_ROWS else (lambda x: x)
    sizes = rows.join(near(sources.select("s", "blocks")), F.col("source").eqNullSafe(F.col("s"))).groupBy("s", (F.col("part") % F.col("blocks")).alias("b")).agg(F.sum("tokens").alias("size"))
    # passes a source is taken: full ones, and the one that the budget ends in
    passes = sources.where("part > 0").select(F.col("s").alias("p"), "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("part") - 1) / F.col("n")))).alias("e"), F.col("n").alias("all"))
    turn = F.md5(F.concat_ws("|", F.col("e").cast("string"), F.coalesce("s", F.lit("")), F.col("b").cast("string")))
    turned = sizes.join(near(passes), F.col("s").eqNullSafe(F.col("p"))).drop("p").withColumn("turn", turn).withColumn("lead", F.substring("turn", 1, LEAD))
    # places count the blocks of smaller turns: those that begin otherwise, summed up, and those that begin alike
    led = turned.groupBy("s", "e", "lead").agg(F.count("*").alias("k"), F.sum("size").alias("x"))
    ahead = Window.partitionBy("s", "e").orderBy("lead")
    led = led.select(F.col("s").alias("ls"), F.col("e").alias("le"), F.col("lead").alias("ll"), (F.sum("k").over(ahead) - F.col("k")).alias("k"), (F.sum("x").over(ahead) - F.col("x")).alias("x"))
    order = Window.partitionBy("s", "e", "lead").orderBy("turn", "b")
    blocks = (
        turned.withColumn("own", F.row_number().over(order) - 1)
        .withColumn("sum", F.sum("size").over(order) - F.col("size"))
        .join(led, F.col("s").eqNullSafe(F.col("ls")) & (F.col("e") == F.col("le")) & (F.col("lead") == F.col("ll")))
        .withColumn("before", F.col("e") * F.col("all") + F.col("x") + F.col("sum"))
        .where("before < part")
        .select("s", "b", F.col("e").cast("int").alias("epoch"), (F.col("k") + F.col("own")).cast("int").alias("block"), (F.col("part") - F.col("before")).alias("room"), "size")
    )
    blocks = _spark.checkpoint(blocks)
    # the user's columns travel as one, so that their names can't clash
    number = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    packed = docs.where(F.regexp_like("text", F.lit(WORD))).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), number.alias("number"))
    placed = packed.join(near(sources.select(F.col("s").alias("own"), "blocks")), F.col("row.source").eqNullSafe(F.col("own"))).select("row", "own", (F.col("number") % F.col("blocks")).alias("at"))
    here = F.col("own").eqNullSafe(F.col("s")) & (F.col("at") == F.col("b"))
    whole = placed.join(near_blocks(blocks.where("room >= size")), here).withColumn("place", F.lit(0))
    # one block of each source at most is taken in part
    within = Window.partitionBy("s", "b", "epoch").orderBy("turn", "row.doc_id", F.md5("row.text"))
    cut = (
        placed.join(near(blocks.where("room < size")), here)
        .withColumn("tokens", F.regexp_count("row.text", F.lit(WORD)).cast("bigint"))
        .withColumn("turn", F.md5(F.concat_ws("|", F.lit("d"), F.col("epoch").cast("string"), F.col("row.doc_id").cast("string"))))
        .withColumn("place", F.row_number().over(within) - 1)
        .withColumn("ahead", F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .where("ahead < room")
    )
    columns = [*(F.col("row")[c].alias(c) for c in docs.columns), *(F.col(a).cast("int").alias(b) for a, b in zip(("epoch", "block", "place"), added(docs), strict=True))]
    return whole.select(*columns).unionByName(cut.select(*columns))


def added(docs: DataFrame) -> list[str]:
    """The names of the mixture's own columns: with an underscore more where docs has such a column, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in ("mix_epoch", "mix_block", "mix_place"):
        while name in taken:
            name += "_"
        out.append(name)
    return out

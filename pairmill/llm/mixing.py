"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of token weight. Raking scales the cells to each target marginal
in turn until all hold; a document's probability is the calibrated weight of its cell over the weight it has, scaled so
that the largest is one. Rare cells, which together want a hundredth of the weight at most, do not set that scale: they
stay whole, and the others are raked on to make up for what they lack. Categories that a target does not name share the
target of ``"*"``. A target is given as shares or derived from the shares measured, so the number of cells is bounded by
the targets, whatever the data hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.common import row_key, text_or_empty, uniform
from pairmill.session import freeze

REST = "*"
# Share of the wanted weight that cells may have together without setting the scale of all others.
RARE = 0.01


@dataclass(frozen=True)
class Measured:
    """Shares as the data have them. Categories of less than ``least`` are pooled as ``"*"``."""

    least: float = 0.01

    def shares(self, top: Sequence[tuple[str, float]], total: float) -> dict[str, float]:
        named = {c: w / total for c, w in top if w >= self.least * total}
        return {**named, REST: max(0.0, 1.0 - sum(named.values()))}


@dataclass(frozen=True)
class AtMost:
    """No category above ``most`` of the mixture: larger ones are lowered to it, and the others fill the rest in the
    proportions they have. Where there are too few categories for that, all get the same share."""

    most: float

    @property
    def least(self) -> float:
        return 0.0

    def shares(self, top: Sequence[tuple[str, float]], total: float) -> dict[str, float]:
        named: dict[str, float] = {}
        others = total
        for c, w in top:
            left = 1.0 - self.most * len(named)
            if left <= 0 or w * left <= self.most * others:
                break
            named[c], others = self.most, others - w
        return {**named, REST: max(0.0, 1.0 - self.most * len(named))}


@dataclass(frozen=True)
class Tempered:
    """Shares in proportion to a power of those measured, none above ``most``: large categories are lowered and small ones
    lifted. Categories of less than ``least`` are pooled as ``"*"``, which counts as one."""

    power: float = 0.7
    most: float = 1.0
    least: float = 0.001

    def shares(self, top: Sequence[tuple[str, float]], total: float) -> dict[str, float]:
        named = Measured(self.least).shares(top, total)
        lifted = {c: s**self.power if s > 0 else 0.0 for c, s in named.items()}
        ordered = sorted(((c, w) for c, w in lifted.items() if c != REST), key=lambda x: (-x[1], x[0]))
        whole = sum(lifted.values())
        lowered = AtMost(self.most).shares(ordered, whole)
        # What is not lowered shares the rest as it stands.
        left = lowered.pop(REST)
        others = {c: w for c, w in lifted.items() if c not in lowered}
        weight = sum(others.values())
        return {**lowered, **{c: left * w / weight if weight else 0.0 for c, w in others.items()}}


Target = Mapping[str, float] | Measured | AtMost | Tempered
Targets = Mapping[str, Target]
Shares = Mapping[str, Mapping[str, float]]


def rake(
    cells: Mapping[tuple[str, ...], float],
    targets: Shares,
    rounds: int = 200,
    close: float = 1e-9,
    most: Mapping[tuple[str, ...], float] | None = None,
) -> dict:
    """Cell weights whose marginals are as ``targets`` (one mapping of category to share per dimension, in the order of
    the cell's parts). Targets of categories without weight are left out and the others scaled up. Stops when no factor
    differs from one by more than ``close``. With ``most`` no cell gets more than that, and a category whose cells are
    all full falls short of its target."""
    weights = {c: float(w) for c, w in cells.items() if w > 0}
    total = sum(weights.values())
    if most is not None:
        weights = {c: min(w, most[c]) for c, w in weights.items()}
    for _ in range(rounds):
        furthest = 0.0
        for axis, shares in enumerate(targets.values()):
            sums: dict[str, float] = {}
            for cell in sorted(weights):
                sums[cell[axis]] = sums.get(cell[axis], 0.0) + weights[cell]
            named = sum(shares[c] for c in sorted(sums))
            factor = {c: shares[c] / named * total / s for c, s in sums.items()}
            weights = {cell: w * factor[cell[axis]] for cell, w in weights.items()}
            if most is not None:
                weights = {c: min(w, most[c]) for c, w in weights.items()}
            furthest = max([furthest, *(abs(f - 1) for f in factor.values())])
        if furthest <= close:
            break
    return weights


def category(col: Column, shares: Mapping[str, float]) -> Column:
    """The category of a value as its target names it; NULL belongs to the rest."""
    named, value = [c for c in shares if c != REST], col.cast("string")
    return F.when(value.isin(named), value).otherwise(F.lit(REST))


def cell_probabilities(cells: Mapping[tuple[str, ...], float], targets: Shares, rare: float = RARE) -> dict:
    """The sampling probability of each cell. The scale is set by the largest ratio of wanted weight to weight after
    leaving out the cells of the largest ratios that want at most ``rare`` of the weight together."""
    wanted = rake(cells, targets)
    if not wanted:
        return dict.fromkeys(cells, 1.0)
    ratio = {c: w / cells[c] for c, w in wanted.items()}
    free = rare * sum(wanted.values())
    for cell in sorted(ratio, key=lambda c: (-ratio[c], c)):
        scale = ratio[cell]
        free -= wanted[cell]
        if free < 0:
            break
    kept = rake({c: w / scale for c, w in wanted.items()}, targets, most=cells)
    return {c: min(1.0, kept[c] / cells[c]) if c in kept else 1.0 for c in cells}


def shares_of(sums: DataFrame, axis: str, target: Target) -> Mapping[str, float]:
    """The shares that a target asks for; ``sums`` has the ``weight`` of each value of ``axis``, in any number of rows.
    At most as many categories as can be named are collected."""
    if isinstance(target, Mapping):
        return target
    total = float(sums.agg(F.sum("weight")).first()[0] or 0)
    if total <= 0:
        return {REST: 1.0}
    found = sums.filter(F.col(axis).isNotNull() & (F.col(axis) != REST)).groupBy(axis).agg(F.sum("weight").alias("weight"))
    bound = target.least or target.most
    top = found.filter("weight > 0").orderBy(F.desc("weight"), axis).limit(int(1 / bound) + 1).collect()
    return target.shares([(r[axis], float(r["weight"])) for r in top], total)


def measure(df: DataFrame, targets: Targets, tokens: Column) -> tuple[Shares, dict[tuple[str, ...], float]]:
    """The shares asked for and the weight of each cell. One aggregate over all rows; the rest works on its sums, of
    which at most one row per cell is collected."""
    axes = [F.col(a).cast("string").alias(a) for a in targets]
    sums = df.select(*axes, tokens.alias("_tokens")).groupBy(*targets).agg(F.sum("_tokens").alias("weight"))
    if not all(isinstance(t, Mapping) for t in targets.values()):
        sums = freeze(sums)
    shares = {a: shares_of(sums, a, t) for a, t in targets.items()}
    placed = sums.select(*(category(F.col(a), s).alias(a) for a, s in shares.items()), "weight")
    rows = placed.groupBy(*targets).agg(F.sum("weight").alias("weight")).collect()
    return shares, {tuple(r[a] for a in targets): float(r["weight"] or 0) for r in rows}


def mix(
    df: DataFrame,
    targets: Targets,
    tokens: Column,
    seed: int = 42,
    id_col: str = "doc_id",
    text: str = "text",
    name: str = "probability",
) -> DataFrame:
    """A sample of the documents in which token weights follow ``targets``, with each one's inclusion ``name``.

    A document stays if a number hashed from seed and id (from the text where the id is missing) is below its
    probability; repeated rows share their fate. Cells without tokens stay whole. Each target is a mapping of category
    to share, which needs the category ``"*"``, or :class:`Measured` or :class:`AtMost`, which follow the table; NULL
    counts as ``"*"``. Extra columns pass through. An empty table gives an empty one. Runs one aggregate over the rows
    when called.
    """
    for axis, target in targets.items():
        if isinstance(target, Mapping) and REST not in target:
            raise ValueError(f"the target of {axis} needs the category {REST!r}")
    shares, cells = measure(df, targets, tokens)
    chance = by_cell(cell_probabilities(cells, shares), shares)
    draw = uniform(F.lit(seed), row_key(id_col, text))
    return df.withColumn(name, chance).filter(draw < F.col(name))


def repeat(
    df: DataFrame,
    targets: Targets,
    tokens: Column,
    seed: int = 42,
    id_col: str = "doc_id",
    text: str = "text",
    name: str = "n_copies",
    expected: str = "expected_copies",
) -> DataFrame:
    """All documents, with how often the mixture takes each one: ``expected`` times, at least once, and ``name`` times as
    drawn, the next lower or higher whole number.

    Copies make token weights follow ``targets`` where :func:`mix` leaves documents out. The expected number of a cell is its
    wanted weight over the weight it has, divided by the smallest such ratio. Draws, targets, NULL, repeated rows and cells
    without tokens (taken once) are as in :func:`mix`. An empty table gives an empty one. Runs one aggregate over the rows
    when called.
    """
    for axis, target in targets.items():
        if isinstance(target, Mapping) and REST not in target:
            raise ValueError(f"the target of {axis} needs the category {REST!r}")
    shares, cells = measure(df, targets, tokens)
    found = cell_copies(cells, shares)
    draw = uniform(F.lit(seed), row_key(id_col, text))
    copies = df.withColumn(expected, by_cell(found, shares))
    whole = F.floor(expected)
    return copies.withColumn(name, (whole + (draw < F.col(expected) - whole).cast("int")).cast("int"))


def cell_copies(cells: Mapping[tuple[str, ...], float], targets: Shares) -> dict:
    """How often each cell is taken, at least once."""
    wanted = rake(cells, targets)
    ratio = {c: w / cells[c] for c, w in wanted.items() if w > 0}
    least = min(ratio.values(), default=1.0)
    # Ratios that differ by rounding only are the same.
    return {c: round(ratio[c] / least, 9) if c in ratio else 1.0 for c in cells}


def by_cell(values: Mapping[tuple[str, ...], float], shares: Shares) -> Column:
    """The value of a row's cell, one where it has none."""
    if not values:
        return F.lit(1.0)
    pairs = [x for cell, p in sorted(values.items()) for x in (F.lit("\x1f".join(cell)), F.lit(p))]
    cell = F.concat_ws("\x1f", *(category(F.col(a), s) for a, s in shares.items()))
    return F.coalesce(F.create_map(*pairs)[cell], F.lit(1.0))


def text_form(text: str = "text") -> Column:
    """A topic for texts that have none: the form they are written in."""
    words = word_weight(text)
    return (
        F.when(F.regexp_count(text_or_empty(text), F.lit(r" \| ")) * 10 > words, "list")
        .when(words < 100, "note")
        .when(words < 1000, "article")
        .otherwise("report")
    )


def word_weight(text: str = "text") -> Column:
    """Spaces and line breaks plus one: the weight of a text in words, without a pattern."""
    t = text_or_empty(text)
    bare = F.replace(F.replace(t, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.octet_length(t) - F.octet_length(bare) + 1



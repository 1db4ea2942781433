"""The most similar right row of each left row, exactly, with fewer products than the whole matrix has.

Right rows are dealt into tiles of similar ones, left rows into groups. In a tile the vectors are turned so that their first
components hold most of their length. The product of these components and of the lengths of the rest is an upper bound of the
cosine (Cauchy-Schwarz), so only pairs whose bound reaches the best cosine known of the left row are looked at further. How
many components are taken is chosen for each part of a group and each tile by a trial on some of their pairs; where no bound
pays, the whole product is taken. Tiles, groups and trials decide about time alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Scores equal to this many digits are ties; the lowest right place wins them.
TIE_DIGITS = 9
# Cells of one product, which bounds its size.
PRODUCT = 1 << 21
# Close right rows of a left row that are compared one by one, and pairs compared together.
MOST_CLOSE = 64
PAIRS = 1 << 12
# Rows of the nearest tile that a left row meets before all others.
FIRST = 512
# Bounds of a tile that are kept.
KEPT_CUTS = 4
# Left rows that meet a tile together, rows of a tile on average, and groups of left rows at most.
PART = 2048
TILE_ROWS = 4096
GROUPS = 16
# Rows that are worth a group or a tile of their own.
LEAST = 512
# Components that a bound may take, and those that are added before a pair is compared in full.
SHORT = (16, 24, 32, 48, 64, 80, 96, 112, 128, 160, 192)
MORE = 64
# What a pair that the bound leaves costs, in components of the product.
PAIR_COST = 3000


class _Best:
    """Left rows with the place and cosine of their best right row so far."""

    def __init__(self, left: np.ndarray, threshold: float):
        self.left, self.narrow = left, left.astype("float32")
        self.at, self.score = np.zeros(len(left), dtype="int64"), np.full(len(left), -np.inf)
        # What the best cosine is at least, before its row is known.
        self.least = np.full(len(left), float(threshold))
        # What cosines in single precision are wrong by: rounding of both rows, and of as many products and sums as a row
        # has components.
        self.wrong = (left.shape[1] + 8) * 2.0**-23

    def floor(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows], self.least[rows]) - 10.0**-TIE_DIGITS

    def take(self, rows: np.ndarray, places: np.ndarray, score: np.ndarray) -> None:
        ours, theirs = np.round(self.score[rows], TIE_DIGITS), np.round(score, TIE_DIGITS)
        better = (theirs > ours) | ((theirs == ours) & (places < self.at[rows]))
        self.at[rows[better]], self.score[rows[better]] = places[better], score[better]


class _Tile:
    """Similar right rows: their places, in ascending order, and the rows in single precision."""

    def __init__(self, right: np.ndarray, places: np.ndarray, turned: bool):
        self.right, self.places = right, places
        self.narrow = right[places].astype("float32")
        self.middle = self.narrow.mean(axis=0)
        self.cuts: dict[int, np.ndarray] = {}
        self.axes = None
        if turned:
            _, axes = np.linalg.eigh((self.narrow.T @ self.narrow).astype("float64"))
            self.axes = np.ascontiguousarray(axes[:, ::-1], dtype="float32")
            self.spun = self.narrow @ self.axes
            self.rest = _rest(self.spun, self.narrow)

    def cut(self, n: int) -> np.ndarray:
        """The first ``n`` components of the turned rows and the length of the rest, for a bound."""
        if n not in self.cuts:
            if len(self.cuts) == KEPT_CUTS:
                del self.cuts[next(iter(self.cuts))]
            self.cuts[n] = _cut(self.spun, self.rest, n)
        return self.cuts[n]


def best_rows(
    left: np.ndarray, right: np.ndarray, threshold: float, block_bytes: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each left row the position of its best right row (first among ties) and the cosine, -inf where none reaches
    ``threshold``. Rows are of length one, or zero. Right rows are taken in blocks of ``block_bytes``."""
    best = _Best(left, threshold)
    rows = max(1, block_bytes // (8 * max(1, right.shape[1])) if block_bytes else len(right))
    groups = [(g, best.narrow[g].sum(axis=0)) for g in _alike(best.narrow, min(GROUPS, len(left) // PART))]
    for start in range(0, len(right), rows):
        block = right[start : start + rows]
        turned = left.shape[1] > SHORT[0] and len(left) >= LEAST and len(block) >= LEAST
        alike = (some for t in _alike(block.astype("float32"), len(block) // TILE_ROWS) for some in _steps(t, 2 * TILE_ROWS))
        tiles = [_Tile(right, start + t, turned) for t in alike]
        for group, middle in groups:
            # The nearest tile first, so that the others meet good cosines; it meets those with some of its rows.
            tiles.sort(key=lambda t: -float(t.middle @ middle))
            if turned:
                some = tiles[0].narrow[:: max(1, len(tiles[0].narrow) // FIRST)].T
                for part in _steps(group, PART):
                    most = (best.narrow[part] @ some).max(axis=1) - best.wrong
                    best.least[part] = np.maximum(best.least[part], most)
            for tile in tiles:
                order = group[np.argsort(best.score[group], kind="stable")]
                for part in _steps(order, PART):
                    _meet(best, part, tile)
            for tile in tiles:
                tile.cuts.clear()
    best.score[best.score < threshold] = -np.inf
    return best.at, best.score


def _alike(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows dealt to at most ``most`` groups of similar direction."""
    n = min(most, len(rows) // LEAST)
    if n < 2 or rows.shape[1] <= SHORT[0]:
        return [np.arange(len(rows))] if len(rows) else []
    some = rows[np.linspace(0, len(rows) - 1, min(len(rows), 512 * n)).astype("int64")]
    middles = some[:: len(some) // n][:n].copy()
    for _ in range(6):
        nearest = (some @ middles.T).argmax(axis=1)
        for i in range(n):
            total = some[nearest == i].sum(axis=0)
            length = np.linalg.norm(total)
            if length > 0:
                middles[i] = total / length
    nearest = (rows @ middles.T).argmax(axis=1)
    found = [np.flatnonzero(nearest == i) for i in range(n)]
    # Small groups go together, as each costs a turn of its own.
    large = [f for f in found if len(f) >= LEAST]
    small = [f for f in found if 0 < len(f) < LEAST]
    return large + ([np.sort(np.concatenate(small))] if small else [])


def _rest(spun: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """How long turned rows are without their first components, for each number that a bound may take and some more; no
    shorter than they are, as turning in single precision is wrong by ``spare`` at most."""
    dim = rows.shape[1]
    spare = 2 * dim**0.5 * (dim + 8) * 2.0**-23
    left, at, found = np.einsum("ij,ij->i", rows, rows), 0, {}
    for n in sorted({*SHORT, *(n + MORE for n in SHORT)}):
        n = min(n, dim, spun.shape[1])
        if n > at:
            left, at = left - np.einsum("ij,ij->i", spun[:, at:n], spun[:, at:n]), n
            found[n] = np.sqrt(np.maximum(left, 0) + spare)
    return found


def _cut(spun: np.ndarray, rest: dict[int, np.ndarray], n: int) -> np.ndarray:
    out = np.empty((len(spun), n + 1), dtype="float32")
    out[:, :n], out[:, n] = spun[:, :n], rest[n]
    return out


def _meet(best: _Best, part: np.ndarray, tile: _Tile) -> None:
    """The left rows of ``part`` with all rows of a tile."""
    n = _components(best, part, tile) if tile.axes is not None else 0
    for some in _steps(part, max(1, PRODUCT // len(tile.narrow))):
        if not n or not _bounded(best, some, tile, n):
            _whole(best, some, tile)


def _components(best: _Best, part: np.ndarray, tile: _Tile) -> int:
    """How many components make the cheapest bound, by a trial; 0 if the whole product is cheaper."""
    dim = best.narrow.shape[1]
    rows = part[:: max(1, len(part) // 16)]
    some = slice(None, None, max(1, len(tile.narrow) // 256))
    spun, its_spun = best.narrow[rows] @ tile.axes, tile.spun[some]
    rest, its_rest = _rest(spun, best.narrow[rows]), {n: r[some] for n, r in tile.rest.items()}
    floor = best.floor(rows)[:, None]
    least, cheapest = dim, 0
    for n in SHORT:
        if n >= least:
            break
        bound = _cut(spun, rest, n) @ _cut(its_spun, its_rest, n).T
        cost = n + PAIR_COST * np.count_nonzero(bound >= floor) / bound.size
        if cost < least:
            least, cheapest = cost, n
    return cheapest


def _bounded(best: _Best, part: np.ndarray, tile: _Tile, n: int) -> bool:
    """Compares the pairs that a bound of ``n`` components leaves; False, with nothing done, if they are too many."""
    dim = best.narrow.shape[1]
    more = min(dim, n + MORE)
    rows = best.narrow[part]
    spun = rows @ tile.axes[:, :more]
    rests = _rest(spun, rows)
    short = _cut(spun, rests, n)
    # What turned rows of single precision are wrong by, both sides, besides their product.
    floor = (best.floor(part) - (2 + 2 * dim**0.5) * best.wrong).astype("float32")
    bound = short @ tile.cut(n).T
    left = _true_at(bound >= floor[:, None], bound.size // 16)
    if left is None:
        return False
    longer, others = _cut(spun, rests, more), tile.cut(more)
    # The bound of more components is that of the first ones, without their rest.
    mine, theirs = longer[:, n:], others[:, n:]
    rest, its_rest = short[:, n], tile.cut(n)[:, n]
    flat = bound.ravel()
    kept, cosines = [], []
    for pairs in (left[i : i + PAIRS] for i in range(0, len(left), PAIRS)):
        row, place = np.divmod(pairs, len(tile.narrow))
        again = flat[pairs] - rest[row] * its_rest[place] + np.einsum("ij,ij->i", mine[row], theirs[place])
        still = again >= floor[row]
        row, place = row[still], place[still]
        kept.append(pairs[still])
        cosines.append(np.einsum("ij,ij->i", rows[row], tile.narrow[place]))
    if kept:
        row, place = np.divmod(np.concatenate(kept), len(tile.narrow))
        cosine = np.concatenate(cosines)
        if len(row):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            most = np.full(len(part), -np.inf)
            most[row[starts]] = np.maximum.reduceat(cosine, starts)
            close = cosine >= np.maximum(most - best.wrong, best.floor(part))[row] - best.wrong - 10.0**-TIE_DIGITS
            _settle(best, part, tile, row[close], place[close])
    return True


def _whole(best: _Best, part: np.ndarray, tile: _Tile) -> None:
    """Cosines are first taken in single precision. What they are wrong by is bounded, so only right rows within that bound
    of a left row's largest can be its best one; these few are compared in double precision."""
    cosines = best.narrow[part] @ tile.narrow.T
    most = cosines.max(axis=1)
    floor = np.maximum(most - best.wrong - 10.0**-TIE_DIGITS, best.floor(part)) - best.wrong
    some = np.flatnonzero(most >= floor)
    if len(some) < len(part):
        part, floor, cosines = part[some], floor[some], cosines[some]
    row, place = np.divmod(_true_at(cosines >= floor.astype("float32")[:, None]), len(tile.narrow))
    _settle(best, part, tile, row, place)


def _settle(best: _Best, part: np.ndarray, tile: _Tile, row: np.ndarray, place: np.ndarray) -> None:
    """Compares pairs of a row in ``part`` and one of the tile in double precision; ``row`` ascends."""
    count = np.bincount(row, minlength=len(part))
    many = np.flatnonzero(count > MOST_CLOSE)
    # Rows with many close ones, such as zeros, are multiplied as a whole.
    for some in _steps(many, max(1, PRODUCT // (4 * len(tile.narrow)))):
        exact = best.left[part[some]] @ tile.right[tile.places].T
        found = np.round(exact, TIE_DIGITS).argmax(axis=1)
        best.take(part[some], tile.places[found], exact[np.arange(len(some)), found])
    if len(many):
        few = count[row] <= MOST_CLOSE
        row, place = row[few], place[few]
    if not len(row):
        return
    exact = np.empty(len(row))
    for pairs in _steps(np.arange(len(row)), PAIRS):
        exact[pairs] = np.einsum("ij,ij->i", best.left[part[row[pairs]]], tile.right[tile.places[place[pairs]]])
    # Best first in each row, the lower place first among ties.
    order = np.lexsort((place, -np.round(exact, TIE_DIGITS), row))
    first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
    best.take(part[row[first]], tile.places[place[first]], exact[first])


def _true_at(mask: np.ndarray, most: int | None = None) -> np.ndarray | None:
    """Places of the few true cells in a flat mask, eight looked at together; None if they are more than ``most``."""
    flat = mask.reshape(-1)
    if most is not None and np.count_nonzero(flat) > most:
        return None
    end = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:end].view("uint64") != 0)
    cells = np.flatnonzero(flat[:end].reshape(-1, 8)[eights])
    return np.concatenate([eights[cells >> 3] * 8 + (cells & 7), end + np.flatnonzero(flat[end:])])


def _steps(places: np.ndarray, step: int) -> Iterator[np.ndarray]:
    return (places[i : i + step] for i in range(0, len(places), step))

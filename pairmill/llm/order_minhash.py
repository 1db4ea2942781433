"""Near-duplicate texts by Order MinHash.

The k-mers of a text are its runs of five words, each labelled with its occurrence number. A sketch takes the few k-mers
that are smallest under one hash and keeps them in text order; texts with an equal sketch share a bucket. Because order
and repetition count, equal sketches speak for a small edit distance. Candidates are verified by a banded alignment of
their words, and by the share of their k-mers that they have in common: a changed word costs one edit, though it changes
five runs.

Equal texts are one node. At first each node meets one other: the smallest node of any of its buckets, and, once more, the
smallest of those of another class. After that only buckets that hold nodes of different classes are looked at again, and
there only nodes of different classes meet, inside a block of bounded size to which their texts travel. So a group of near
copies gives about one pair per text, a pair that is not similar never becomes a row, and yet every pair that shares a bucket
ends in one class or has been compared, or has too few k-mers in common to be similar.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.llm.blocks import BIN_ROWS, block_slices
from pairmill.llm.common import digest128, digest256, partitions, row_key, text_or_empty
from pairmill.llm.components import components
from pairmill.llm.exact_dedup import with_group
from pairmill.session import freeze

WORDS = 5
# A pair with Jaccard similarity j of its k-mers is missed with probability (1 - j^3)^32: 1e-5 at 2/3, 0.014 at 0.5.
SKETCHES = 32
PICKED = 3
SIMILARITY = 0.8
# Least Jaccard similarity of the k-mers of similar texts. Edits that spare so few runs that less is left are no near copy.
SHARED = 0.3
# Counts of k-mers are kept in this many bins, each up to 255.
BINS = 256
SEED = 4
# Rounds in which each text meets one other before what is still open is compared in full.
STAR_ROUNDS = 2
# Rows of a piece in the full comparison, where each brings its text along.
PIECE_ROWS = 512
# Words of the texts that a task of the full comparison keeps ready, 24 bytes each.
KEPT_WORDS = 1 << 20
# A character that is not white space for str.split().
WORD = r"(?U)[^\s\x1c-\x1f]"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(words: Sequence[str], k: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``k`` words in text order; a shorter text is one run."""
    hashes = word_hashes(words)
    n = max(1, len(hashes) - k + 1)
    runs = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        runs = (runs ^ hashes[i : i + n]) * GOLDEN
        runs ^= runs >> np.uint64(29)
    return runs


def labelled_kmers(runs: np.ndarray) -> np.ndarray:
    """The runs with their occurrence numbers hashed in, so that no two of a text are equal."""
    n = len(runs)
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    same = ordered[1:] == ordered[:-1]
    if same.any():
        first = np.concatenate([[True], ~same])
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = (np.arange(n) - start).astype(np.uint64)
        # First occurrences stay as they are, also in texts that repeat nothing.
        again = occurrence > 0
        mixed = (runs[again] ^ (occurrence[again] * np.uint64(0xC2B2AE3D27D4EB4F))) * GOLDEN
        runs = runs.copy()
        runs[again] = mixed ^ (mixed >> np.uint64(31))
    return runs


def sketches(runs: np.ndarray, count: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Bucket numbers of a text: for each hash its smallest k-mers in text order."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 63, size=count, dtype=np.uint64) | np.uint64(1)
    masks = rng.integers(0, 1 << 63, size=count, dtype=np.uint64)
    picked = min(picked, len(runs))
    step = max(1, 1_000_000 // len(runs))
    keys = masks.copy()
    for at in range(0, count, step):
        values = (runs[None, :] ^ masks[at : at + step, None]) * factors[at : at + step, None]
        values ^= values >> np.uint64(32)
        places = np.argpartition(values, picked - 1, axis=1)[:, :picked] if picked < len(runs) else None
        chosen = runs[np.sort(places, axis=1)] if places is not None else np.broadcast_to(runs, values.shape)
        for i in range(picked):
            keys[at : at + step] = (keys[at : at + step] ^ chosen[:, i]) * GOLDEN
            keys[at : at + step] ^= keys[at : at + step] >> np.uint64(30)
    return keys.view(np.int64)


def band_distance(a: Sequence, b: Sequence, limit: int) -> int:
    """The edit distance of two sequences if it is at most ``limit``, else ``limit + 1``.

    Only cells of the alignment within ``limit`` of its diagonal are computed. The band of one column is a pair of bit
    sets, the places where the distance grows and where it falls from one row to the next; each column is derived from
    the one before by a few operations on whole bit sets, and the band moves down by one row.
    """
    if len(a) < len(b):
        a, b = b, a
    lead = len(a) - len(b)
    if lead > limit:
        return limit + 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << (2 * limit + 1)) - 1
    # Rows at or above the border of the table do not differ from each other; below it the distance grows by row.
    grows, falls = full & ~((1 << limit) - 1), 0
    corner = 1 << (lead + limit)
    distance = lead
    for j, y in enumerate(b):
        match = places.get(y, 0)
        shift = j - limit
        match = (match >> shift if shift > 0 else match << -shift) & full
        same = (((match & grows) + grows) ^ grows) | match | falls
        up = falls | ~(same | grows)
        down = same & grows
        if not same & corner:
            distance += 1
            if distance > limit:
                return limit + 1
        below = (same & full) >> 1
        grows = (down | ~(below | up)) & full
        falls = below & up & full
    return distance


class Shingled:
    """What a comparison needs of a text: the hashes of its words in text order; its words and its k-mers, both labelled by
    occurrence and sorted. All are arrays."""

    def __init__(self, text: str):
        words = text.split()
        hashes = word_hashes(words)
        self.words = hashes
        self.bag = np.sort(labelled_kmers(hashes))
        self.kmers = np.sort(labelled_kmers(shingles(words)))


def common_to(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted, distinct numbers of one array are in the other."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def edits_allowed(longer: int | np.ndarray, similarity: float) -> np.ndarray:
    """The most edits between similar texts of which the longer one has ``longer`` words (a number or an array)."""
    return np.asarray((1 - similarity) * longer + 1e-9).astype(np.int64)


def kmers_needed(both: int | np.ndarray, shared: float) -> np.ndarray:
    """The fewest k-mers in common of texts that have ``both`` k-mers together and a Jaccard similarity of ``shared``."""
    return np.ceil(shared / (1 + shared) * both - 1e-9).astype(np.int64)


def similar(a: Shingled, b: Shingled, similarity: float = SIMILARITY, shared: float = SHARED) -> bool:
    """Whether at most a share 1 - similarity of the longer text's words have to be edited, and the k-mers of the texts have
    a Jaccard similarity of at least ``shared``."""
    longer = max(len(a.words), len(b.words))
    limit = int(edits_allowed(longer, similarity))
    if abs(len(a.words) - len(b.words)) > limit:
        return False
    if common_to(a.bag, b.bag) < longer - limit:
        return False
    if common_to(a.kmers, b.kmers) < kmers_needed(len(a.kmers) + len(b.kmers), shared):
        return False
    band = 16
    words, others = a.words.tolist(), b.words.tolist()
    while band < limit:
        if band_distance(words, others, band) <= band:
            return True
        band *= 4
    return band_distance(words, others, limit) <= limit


class LastRead:
    """Texts as comparisons need them, by number. The last ones used stay, up to ``KEPT_WORDS`` words and two at least, so that
    what a task holds does not grow with its texts."""

    def __init__(self, texts: Sequence):
        self.texts, self.kept, self.words = texts, OrderedDict(), 0

    def __getitem__(self, number: int) -> Shingled:
        if number in self.kept:
            self.kept.move_to_end(number)
        else:
            one = self.kept[number] = Shingled(self.texts[number].as_py())
            self.words += len(one.words)
            while self.words > KEPT_WORDS and len(self.kept) > 2:
                self.words -= len(self.kept.popitem(last=False)[1].words)
        return self.kept[number]


SKETCHED = "node binary, n_words int, n_kmers int, bag binary, counts binary, buckets array<long>"


def binned(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each of ``BINS`` bins, up to 255. What two texts have in common by bins is at least what they
    have in common, unless a bin is full."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def may_share(bins: np.ndarray, others: np.ndarray, row: int, needed: np.ndarray) -> np.ndarray:
    """Whether by their bins ``others`` can have as much in common with ``row`` as needed. Full bins say nothing."""
    common = np.minimum(bins[others], bins[row]).sum(axis=1, dtype=np.int64)
    full = (bins[row] == 255).any() | (bins[others] == 255).any(axis=1)
    return full | (common >= needed)


def sketch_table(named: DataFrame) -> DataFrame:
    """(node, n_words, n_kmers, bag, counts, buckets) of the rows (node, text) whose text has words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lengths, sizes, bags, counts, buckets = [], [], [], [], [], []
            for node, text in zip(batch.column(0), batch.column(1)):
                words = text.as_py().split()
                if not words:
                    continue
                runs = labelled_kmers(shingles(words))
                bags.append(binned(word_hashes(words)).tobytes())
                nodes.append(node.as_py())
                lengths.append(len(words))
                sizes.append(len(runs))
                counts.append(binned(runs).tobytes())
                buckets.append(np.unique(sketches(runs)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.binary()), pa.array(lengths, pa.int32()), pa.array(sizes, pa.int32()),
                    pa.array(bags, pa.binary()), pa.array(counts, pa.binary()), pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["node", "n_words", "n_kmers", "bag", "counts", "buckets"],
            )

    return named.mapInArrow(sketch, SKETCHED)


def _stars(labelled: DataFrame) -> DataFrame:
    """One pair (a, b) for each node that shares a bucket with a smaller class: the smallest such a."""
    least = labelled.groupBy("bucket").agg(F.min(F.struct("component", "node")).alias("first"))
    met = labelled.join(least, "bucket").filter(F.col("component") != F.col("first.component"))
    return met.groupBy(F.col("node").alias("b")).agg(F.min("first.node").alias("a")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shared: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, last = [None, None], [None, None]
            keep = []
            for row in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                for side in (0, 1):
                    if row[side] != names[side]:
                        names[side], last[side] = row[side], Shingled(row[side + 2].as_py())
                keep.append(similar(*last, similarity, shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(verify, "a binary, b binary")


def _dealt(labelled: DataFrame, open_: DataFrame) -> DataFrame:
    """Members (bucket, node) of open buckets (bucket, n, low), dealt into blocks of two pieces ``lo`` and ``hi`` of a bucket.

    Buckets whose smallest class is the same hold much the same texts, so their blocks go to one bin, as far as it has room:
    there a text is needed once. A bin gets ``BIN_ROWS`` members, give or take a block.
    """
    spark = labelled.sparkSession
    total = open_.agg(F.sum("n")).first()[0] or 0
    bins = max(partitions(spark), -(-total // BIN_ROWS))
    room = open_.groupBy("low").agg(F.ceil(F.sum("n") / BIN_ROWS).alias("parts"))
    sizes = open_.join(room, "low").select(
        "bucket",
        F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"),
        F.xxhash64("low", F.pmod(F.xxhash64("bucket"), "parts")).alias("place"),
    )
    met = labelled.select("bucket", "node").join(sizes, "bucket")
    met = met.withColumn("piece", F.pmod(F.xxhash64(F.lit("piece"), "node"), "pieces").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.withColumns({"lo": F.least("piece", "other"), "hi": F.greatest("piece", "other")})
    return met.select("bucket", "node", "piece", "lo", "hi", F.pmod(F.xxhash64("place", "lo", "hi"), F.lit(bins)).alias("bin"))


def _linked_in_blocks(members: DataFrame, described: DataFrame, similarity: float, shared: float) -> DataFrame:
    """Pairs (a, b) of similar texts, as many as join the classes of each block of ``members``, see :func:`_dealt`.
    ``described`` has each node's class, numbers, bins and text; a text travels once to each bin that needs it.

    Nodes of different classes in a block are compared, each pair in the lowest of its buckets in the bin; classes that a pair
    joins are one from then on, so a group of near copies takes about one comparison a text. Pairs that are not similar
    leave nothing behind.
    """
    # Fresh names tell the two sides of the meeting apart.
    needed = members.select(F.col("bin").alias("at"), F.col("node").alias("name")).distinct()
    needed = needed.join(described.withColumnRenamed("node", "name"), "name")

    def link(blocks: pa.Table, nodes: pa.Table) -> pa.Table:
        names, texts = nodes.column("name").to_pylist(), nodes.column("text").combine_chunks()
        number = {name: i for i, name in enumerate(names)}
        words, size = (nodes.column(c).to_numpy().astype(np.int64) for c in ("n_words", "n_kmers"))
        _, label = np.unique(np.array(nodes.column("component").to_pylist(), dtype=object), return_inverse=True)
        bags, counts = (
            np.frombuffer(b"".join(nodes.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("bag", "counts")
        )
        key, lo, hi, piece = (blocks.column(c).to_numpy() for c in ("bucket", "lo", "hi", "piece"))
        node = np.array([number[n] for n in blocks.column("node").to_pylist()], np.int64)
        # The blocks of each node in the bin, with its piece there.
        own: list[dict[tuple[int, int, int], int]] = [{} for _ in names]
        for n, p, block in zip(node.tolist(), piece.tolist(), zip(key.tolist(), lo.tolist(), hi.tolist())):
            own[n][block] = p
        def met_before(a: int, b: int, block: tuple[int, int, int]) -> bool:
            """Whether two nodes are compared in an earlier block: in one of a single piece, or as members of two."""
            both = own[a].keys() & own[b].keys()
            return any(x < block and (x[1] == x[2] or own[a][x] != own[b][x]) for x in both)

        read = LastRead(texts)
        found: list[tuple[bytes, bytes]] = []
        for inside in block_slices(key, lo, hi):
            first = inside[0]
            block = (int(key[first]), int(lo[first]), int(hi[first]))
            cross = lo[first] != hi[first]
            group, side = node[inside], piece[inside]
            if (label[group] == label[group[0]]).all():
                continue
            for at, row in enumerate(group.tolist()):
                others = group[at + 1 :]
                fits = label[others] != label[row]
                if cross:
                    fits &= side[at + 1 :] != side[at]
                others = others[fits]
                longer = np.maximum(words[others], words[row])
                limit = edits_allowed(longer, similarity)
                near = np.abs(words[others] - words[row]) <= limit
                others, common = others[near], (longer - limit)[near]
                # Words that need no edit are common to both; k-mers in common are asked for by ``shared``.
                others = others[may_share(bags, others, row, common)]
                others = others[may_share(counts, others, row, kmers_needed(size[others] + size[row], shared))]
                for other in others.tolist():
                    if label[other] == label[row] or met_before(row, other, block):
                        continue
                    if similar(read[row], read[other], similarity, shared):
                        found.append((min(names[row], names[other]), max(names[row], names[other])))
                        label[label == label[other]] = label[row]
        return pa.table({c: pa.array([pair[i] for pair in found], pa.binary()) for i, c in enumerate(("a", "b"))})

    return members.groupBy("bin").cogroup(needed.groupBy("at")).applyInArrow(link, "a binary, b binary")


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shared: float = SHARED
) -> DataFrame:
    """(key, node, id, class_id, kept), one row per row of ``df``; ``key`` is the row's :func:`row_key`, ``node`` a digest of
    its text.

    Rows belong to one class if their texts are equal or linked by a chain of similar texts. Two texts are similar if at most
    a share 1 - ``similarity`` of the longer one's words has to be edited, and their runs of five words have a Jaccard
    similarity of at least ``shared``. A similar pair whose runs have Jaccard similarity j, in the same order, is found with
    probability 1 - (1 - j^3)^32, and by way of others of its class. ``class_id`` is the smallest id of the class, NULL if
    none of its rows has an id. ``kept`` marks one text of one id in each class: the smallest by (id, key, node), ids that are
    NULL last; rows that repeat both id and text are marked alike. An id that stands beside several texts names several
    rows, each judged by its own text. Rows whose text is NULL, empty or without words are compared with none: each is its
    own class and kept. Texts of any length are compared whole. Other columns are left out, so no name clashes. An empty
    table gives an empty one. Runs jobs when called.
    """
    keyed = df.select(row_key(id_col, text).alias("key"), F.col(id_col).alias("id"), text_or_empty(text).alias("text"))
    keyed = keyed.withColumn("node", digest128(F.col("text")))
    # Copies of a text become one row in each map task, before anything travels.
    sketched = sketch_table(keyed.select("node", "text")).groupBy("node")
    nodes = freeze(sketched.agg(*(F.first(c).alias(c) for c in ("n_words", "n_kmers", "bag", "counts", "buckets"))))
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = freeze(placed.join(sizes.select("bucket"), "bucket"))
    texts = keyed.groupBy("node").agg(F.first("text").alias("text"))
    texts = freeze(texts.join(members.select("node").distinct(), "node", "left_semi"))

    labelled = members.withColumn("component", F.col("node"))
    links = tested = found = None
    for _ in range(STAR_ROUNDS):
        pairs = _stars(labelled)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = freeze(pairs)
        more = freeze(_verified(pairs, texts, similarity, shared))
        links, tested = (more, pairs) if links is None else (links.union(more), tested.union(pairs))
        found = freeze(components(links))
        labelled = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # Buckets in which classes still differ.
    open_ = labelled.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    open_ = freeze(open_.filter("low != high").select("bucket", "n", "low"))
    described = nodes.drop("buckets").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    described = described.join(texts, "node")
    more = freeze(_linked_in_blocks(freeze(_dealt(members, open_)), described, similarity, shared))
    if not more.isEmpty():
        found = freeze(components(links.union(more)))

    node = F.when(F.col("text").rlike(WORD), F.col("node"))
    rows = keyed.select("key", "id", F.col("node").alias("own"), node.alias("node")).join(found, "node", "left")
    rows = rows.select("key", "id", "own", F.coalesce("component", "node").alias("class"))
    rows = freeze(rows)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"), F.col("own"))
    best = rows.filter("class is not null").groupBy("class").agg(F.min(order).alias("best"))
    judged = rows.join(best, "class", "left")
    alone = F.col("class").isNull()
    return judged.select(
        "key",
        F.col("own").alias("node"),
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        (alone | ((F.col("key") == F.col("best.key")) & (F.col("own") == F.col("best.own")))).alias("kept"),
    )


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, shared: float = SHARED
) -> DataFrame:
    """One row of each class of :func:`near_classes`, with all its columns.

    A row goes for its own text's class only, never for that of another row with its id. Of rows that repeat id and text one
    stays, any of them. Rows whose text is NULL, empty or without words all stay, repeated or not. Columns of any name pass
    through, but for names that begin with ``__pm_``. An empty table gives an empty one. Runs jobs when called.
    """
    judged = near_classes(df, id_col, text, similarity, shared)

    def group(key: Column, node: Column) -> Column:
        return digest256(F.concat_ws("|", F.hex(node), key))

    named = judged.select(group(F.col("key"), F.col("node")).alias("__pm_group"), "kept")
    groups = named.groupBy("__pm_group").agg(F.min("kept").alias("__pm_kept"), F.count("*").alias("__pm_size"))
    groups = freeze(groups)
    counts = groups.agg(F.sum("__pm_size").alias("rows"), F.max(F.when(F.col("__pm_kept"), F.col("__pm_size"))).alias("most")).first()
    marked = df.withColumns(
        {
            "__pm_group": group(row_key(id_col, text), digest128(text_or_empty(text))),
            "__pm_row": F.monotonically_increasing_id(),
        }
    )
    # Rows meet their verdict without gathering the copies of a hot row in one task.
    kept = with_group(marked, groups, counts["rows"] or 0).filter("__pm_kept")
    columns = [F.col(f"`{c}`") for c in df.columns]
    if (counts["most"] or 0) < 2:
        return kept.select(columns)
    # Rows that are there twice or more with one id and one text.
    again = (F.col("__pm_size") > 1) & text_or_empty(text).rlike(WORD)
    return kept.filter(~again).unionByName(kept.filter(again).dropDuplicates(["__pm_group"])).select(columns)

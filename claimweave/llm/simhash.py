"""SimHash near-duplicates, candidates pruned by pigeonring chains.

Fingerprint: 64 bits over all word 4-grams of the whole text (repeats included), bit set if it is set
in over half of the XXH64 values.  Two fingerprints link if ``DISTANCE`` or fewer bits differ.

Candidates: the 64 bits form a ring of ``DISTANCE + 1`` segments.  By the pigeonring principle (Qin and
Xiao, 2018) linked fingerprints have a starting segment from which every chain of ``l`` consecutive
segments differs in at most ``floor(l * DISTANCE / (DISTANCE + 1))`` bits.  So the first segment is
equal and the second has one differing bit at most, that is, one of its halves is equal: the join key
is that segment with that half, ten keys a fingerprint.  Inside a key, pairs must pass the cumulative
budgets of chains of 2, 3 and 4 segments before the full Hamming distance is looked at.

Scale: equal fingerprints fold before any join, so a group of copies is one row however large it is.
Keys are sorted runs streamed through Arrow; a run leaves as a spanning forest of links, never as all
its pairs.  Keys that a 1/16 sample shows to be frequent are dealt over a grid of cells (each pair of
chunks of the run meets in one cell), so no task holds an unbounded run; the grid only spreads work, every pair
still meets.  Components are found by ``connected_components``.

Edge cases: a null or wordless text has fingerprint zero and links like any other; repeated rows link
to each other; rows that share an id are still told apart by their texts; a row without an id never
names a component (one of such rows only has none); a bit that exactly half the shingles have is 0; a very
long text is read whole and holds one hash a shingle; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import durable, free, join_apart, map_batches
from .components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: A run of one key that is expected to hold more fingerprints is dealt over a grid of cells.
CHUNK = 4096
SAMPLE = 16

WIDTHS = (13, 13, 13, 13, 12)
OFFSETS = (0, 13, 26, 39, 52)
BUDGETS = tuple(DISTANCE * length // len(WIDTHS) for length in range(1, len(WIDTHS) + 1))


def _mask(offset: int, width: int) -> int:
    return ((1 << width) - 1) << offset


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: One mask for each starting segment and half of the segment after it.
KEY_MASKS = [
    _mask(OFFSETS[i], WIDTHS[i]) | half
    for i in range(5)
    for j in [(i + 1) % 5]
    for half in (_mask(OFFSETS[j], WIDTHS[j] // 2), _mask(OFFSETS[j] + WIDTHS[j] // 2, WIDTHS[j] - WIDTHS[j] // 2))
]
#: For each starting segment the growing chains of two segments and more, with their budgets.
CHAINS = [
    [(sum(_mask(OFFSETS[(i + s) % 5], WIDTHS[(i + s) % 5]) for s in range(length)), BUDGETS[length - 1]) for length in range(2, 6)]
    for i in range(5)
]


def fingerprint(text: str | None) -> int:
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = raw.split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip((end - size).tolist(), end[SHINGLE - 1 :].tolist(), strict=False)), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 4096):
        ones += np.unpackbits(h[s : s + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs, ["doc_id", "text"], body, "doc_id long, fp long")


def _near(x: np.ndarray, start: int) -> np.ndarray:
    """Which XOR values pass the chains from ``start`` and, last of them, the full distance."""
    ok = np.ones(len(x), bool)
    for mask, budget in CHAINS[start]:
        ok[ok] = np.bitwise_count(x[ok] & np.uint64(mask)) <= budget
    return ok


def _small_runs(run: np.ndarray, table: np.ndarray, fp: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside short runs, all runs at once."""
    left, right = [], []
    for step in range(1, widest):
        i = np.nonzero(run[step:] == run[:-step])[0]
        for start in range(5):
            some = i[table[i] == start]
            if len(some):
                some = some[_near(fp[some] ^ fp[some + step], start)]
                left.append(some)
                right.append(some + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links ``a[i] - b[i]``."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _long_run(fp: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """A spanning forest of one long run: whoever is reached is taken out of the rest at once."""
    a, b = [], []
    rest = np.arange(len(fp))
    while len(rest):
        stack, rest = [int(rest[0])], rest[1:]
        while stack and len(rest):
            p = stack.pop()
            ok = _near(fp[rest] ^ fp[p], start)
            reached = rest[ok].tolist()
            rest = rest[~ok]
            a += [p] * len(reached)
            b += reached
            stack += reached
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, key, fp) -> links (a, b) of fingerprints, a forest for each run."""
    carry: list[np.ndarray] | None = None

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        cell, key, start, fp = cols
        node = fp.view(np.int64)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        short = size[run] <= 64
        keep = np.nonzero(short & (size[run] > 1))[0]
        i, j = _small_runs(run[keep], start[keep], fp[keep], int(size[size <= 64].max(initial=1)))
        a, b = node[keep][i].tolist(), node[keep][j].tolist()
        for r in np.nonzero(size > 64)[0].tolist():
            at = np.nonzero(run == r)[0]
            p, q = _long_run(fp[at], int(start[at[0]]))
            a += node[at[p]].tolist()
            b += node[at[q]].tolist()
        forest = _forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in forest], pa.int64()), pa.array([y for _, y in forest], pa.int64())], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
        cols[3] = cols[3].view(np.uint64)
        if carry is not None:
            cols = [np.concatenate(pair) for pair in zip(carry, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.nonzero((cols[1] != cols[1][-1]) | (cols[0] != cols[0][-1]))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        carry = [c[cut:] for c in cols]
        if cut:
            yield solve([c[:cut] for c in cols])
    if carry is not None and len(carry[0]):
        yield solve(carry)


def _keyed(nodes: DataFrame) -> DataFrame:
    key = F.explode(F.array(*[
        F.struct(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("key"), F.lit(t // 2).alias("start"))
        for t, mask in enumerate(KEY_MASKS)
    ])).alias("k")
    return nodes.select("fp", key).select("k.key", "k.start", "fp")


def _cells(keyed: DataFrame, nodes: DataFrame, chunk: int) -> DataFrame:
    """Column ``cell``: 0 for ordinary keys; frequent keys are copied to every cell of their chunk's row and column."""
    sample = _keyed(nodes.where(F.pmod(F.xxhash64(F.lit("sample"), "fp"), F.lit(SAMPLE)) == 0))
    often = (
        sample.groupBy("key").agg((F.count("*") * SAMPLE).alias("expected")).where(F.col("expected") > chunk)
        .select("key", F.ceil(F.col("expected") / chunk).cast("int").alias("chunks"))
    )
    dealt = keyed.join(often, "key", "left")
    mine: Column = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    grid = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda other: F.least(mine, other) * F.col("chunks") + F.greatest(mine, other) + 1,
    )
    return dealt.select(F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(grid)).alias("cell"), "key", "start", "fp")


def links(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``nodes(fp)``, all distinct -> links ``(a, b)`` that span every group of near fingerprints."""
    dealt = _cells(_keyed(nodes), nodes, chunk)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "cell").sortWithinPartitions("cell", "key", "fp").mapInArrow(_links, "a long, b long")


def _grouped(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    rows = durable(fingerprints(docs), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(nodes.select("fp"), chunk)).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, join_apart(named.select("fp", "root"), ids, "root")


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    rows, groups = _grouped(docs, chunk)
    return rows.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and, as last column ``name``, each row's fingerprint."""
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=schema.names)

    return docs.mapInArrow(body, schema)


def keep_one_of_each(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Only the ids that go are joined, so texts move only where Spark finds those too many to broadcast.
    Where ids repeat or are missing, an id does not tell which row is meant: then rows are matched by
    fingerprint, rows of one group that share its smallest id fold to one, and a row without an id stays only
    if no row of its group has one.
    """
    rows, groups = _grouped(docs, chunk)
    judged = durable(rows.join(groups, "fp"), "components")
    plain = judged.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    if plain:
        gone = judged.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    fp, root, least = (free(x, docs.columns) for x in ("__fingerprint", "__root", "__least"))
    labels = judged.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(least)).distinct()
    kept = _with_fingerprint(docs, fp).join(labels, fp).where(F.col(least).isNull() | (F.col("doc_id") == F.col(least)))
    return kept.dropDuplicates([root]).select(*docs.columns)

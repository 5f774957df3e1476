"""Similarity join of documents on word shingles, by a grouped prefix join.

A document's set is its distinct five-word shingles (lower-cased A-Z, words between ASCII white space; the
whole sequence where there are fewer words). Two documents link when their sets' Jaccard similarity is at
least ``num / den``. The steps:

1. Sets are hashed, digested and signed; documents with equal sets are one from here on. A count sketch over all
   shingles of all documents, sized by the texts' bytes, puts shingles into classes of frequency.
2. Each set is ordered by (class, hash), the same order for all, and cut to its prefix: two sets that link share
   a shingle of their prefixes. Sets with identical prefixes and size form a group, and prefix entries
   (shingle, group, size, position) are dealt by shingle in packed blocks. Entries of shingles that the sketch
   finds in ``2 ** HOT_BITS`` sets or more are not dealt by shingle at all; they go to step 5 as rows.
3. Entries of one shingle give candidate pairs of groups, filtered by size and by how much overlap the positions
   leave. A run, the entries of a shingle, with more than ``FULL_RUN`` groups gives only pairs with its centre, the
   entry of the least position (which has the fewest rare shingles); its entries are kept for step 5.
4. Groups expand to their members, candidate pairs are filtered by signature (the parity of the set's shingles
   in each of 256 cells bounds the overlap from above) and verified on the whole sets, and the links make components.
   Of a group, or a pair of groups, with more members than ``FULL_RUN`` the members make a run for step 5.
5. In the kept runs, documents that already are in one component need no comparison. First each run's entries
   meet one centre outside the largest component; then all that are still in different components are paired,
   filtered by size, position and signature, and verified. So a large group of near copies costs about one pair a
   member, and no link between different components is lost.

Cases: null and empty texts have an empty set and link with nothing, not even each other. Rows that repeat a
doc_id are documents of their own. Rows without a doc_id take part; they give no component_id, so where a
component has no row with one it is null, and they stay only where no row of their component has a doc_id. Very
long texts are read whole. Extra columns are ignored, and pass through ``one_per_component``. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.operators.components import connected_components
from sedimark.storage import staged

WORDS = 5
NUM, DEN = 3, 4
MIN_SKETCH_BITS, MAX_SKETCH_BITS = 16, 24
BYTES_PER_CELL = 200
SKETCH_BLOCKS = 64
FULL_RUN = 2
HOT_BITS = 16
BLOCK_ENTRIES = 250_000
BUCKET_SHINGLES = 1_000_000
BROADCAST_IDS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MEMO_LIMIT = 100_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, memo: _Words, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text. ``bytes`` splits and lower-cases as ASCII, as wanted."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(found) < words:
        whole = xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found) + 1)
        return np.array([whole] if found else [], np.uint64)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    n = len(h) - words + 1
    out = h[:n].copy()
    for k in range(1, words):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return np.unique(out)


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def _column(values, kind) -> pa.Array:
    return pa.array(values, kind)


# ---------------------------------------------------------------- step 1

SIGNS = ["s0", "s1", "s2", "s3"]


def signature(s: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: whether the set has an odd number of shingles in each cell."""
    odd = np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_bits(total_bytes: int) -> int:
    """Bits of the sketch's cell numbers: about ``BYTES_PER_CELL`` bytes of text a cell, within fixed bounds."""
    return min(MAX_SKETCH_BITS, max(MIN_SKETCH_BITS, (total_bytes // BYTES_PER_CELL).bit_length()))


def _sketch(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """One row per document (doc_id, th, n, d1, d2, signature) and, with ``block``, packed counts of the task's shingles."""
    per_block = (1 << bits) // SKETCH_BLOCKS
    names = ["doc_id", "th", "n", "d1", "d2", *SIGNS, "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts, kind = _Words(), np.zeros(1 << bits, np.uint32), pa.int64()
        for b in batches:
            kind, rows = b["doc_id"].type, []
            for t in b["text"]:
                s = shingles(t.as_py(), memo, words)
                # Cells of one set hardly ever coincide; a missed count only shifts an order that is free to choose.
                counts[(s >> np.uint64(64 - bits)).astype(np.int64)] += 1
                rows.append((len(s), *digest(s), *signature(s).tolist()))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["th"], *(_column([r[k] for r in rows], pa.int64()) for k in range(7))]
                + [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())],
                names,
            )
        for k in range(SKETCH_BLOCKS):
            part = counts[k * per_block : (k + 1) * per_block]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, kind), *([pa.nulls(1, pa.int64())] * 8), _column([k], pa.int32()), _column([packed], pa.binary())], names
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    signs = ", ".join(f"{c} long" for c in SIGNS)
    return docs.mapInArrow(run, f"doc_id {kind}, th long, n long, d1 long, d2 long, {signs}, block int, counts binary")


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Classes of cells: four a doubling of what a cell holds beyond the usual load and three deviations of it."""
    usual = float(np.median(counts))
    return (4 * np.log2(1 + np.maximum(0, counts - usual - 3 * np.sqrt(usual)))).astype(np.uint8)


def _classes(sketch: DataFrame, bits: int) -> np.ndarray:
    """The frequency class of every cell of the sketch, summed over all tasks: ``2 ** bits`` bytes."""
    per_block = (1 << bits) // SKETCH_BLOCKS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["block"].to_pylist(), b["counts"].to_pylist()):
                part = np.frombuffer(zlib.decompress(c), np.uint32)
                sums[k] = sums.get(k, 0) + part.astype(np.int64)
        packed = {k: zlib.compress(frequency_classes(v).tobytes(), 1) for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays(
            [_column(list(packed), pa.int32()), _column(list(packed.values()), pa.binary())], ["block", "classes"]
        )

    blocks = sketch.filter("block is not null").select("block", "counts").repartition(min(SKETCH_BLOCKS, int(sketch.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "block")
    classes = np.zeros(1 << bits, np.uint8)
    for r in blocks.mapInArrow(add, "block int, classes binary").collect():  # SKETCH_BLOCKS rows
        classes[r["block"] * per_block : (r["block"] + 1) * per_block] = np.frombuffer(zlib.decompress(r["classes"]), np.uint8)
    return classes


# ---------------------------------------------------------------- steps 2 and 3


def prefix(s: np.ndarray, classes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of a set, in the common order, that two sets that link cannot both miss, and its classes."""
    bits = int(len(classes)).bit_length() - 1
    rank = classes[(s >> np.uint64(64 - bits)).astype(np.int64)]
    order = np.argsort(rank, kind="stable")[: len(s) - -(-num * len(s) // den) + 1]
    return s[order], rank[order]


_KEY, _GROUP = np.uint64((1 << 40) - 1), (1 << 48) - 1
_ENTRY = np.dtype([("key", "<u8"), ("group", "<u8"), ("size", "<u4"), ("at", "<u4")])
_WIDTHS = {"key": 5, "group": 6, "size": 4, "at": 4}


def pack_entries(e: np.ndarray) -> bytes:
    """Entries byte by byte of each column, so that the high bytes of small numbers lie together and compress.

    A key is 40 bits of a shingle's hash and a group 48 bits of its own: entries that agree by chance add candidates
    and lose none.
    """
    planes = (np.ascontiguousarray(e[c]).view(np.uint8).reshape(len(e), -1)[:, :w].T.tobytes() for c, w in _WIDTHS.items())
    return b"".join(planes)


def unpack_entries(data: bytes) -> np.ndarray:
    n = len(data) // sum(_WIDTHS.values())
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out, p = np.zeros(n, _ENTRY), 0
    for c, w in _WIDTHS.items():
        wide = np.zeros((n, out.dtype[c].itemsize), np.uint8)
        wide[:, :w] = planes[p : p + w].T
        out[c] = wide.view(out.dtype[c]).ravel()
        p += w
    return out


_MEMBERS, _ENTRIES, _HOT_ENTRIES = 0, 1, 2


def _entries(docs: DataFrame, classes: np.ndarray, buckets: int, words: int, num: int, den: int, hot_bits: int) -> DataFrame:
    """Packed prefix entries by bucket of the shingle; hot ones and members (group, size, digest) by bucket of the group."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, table, seen, held, members, n = _Words(), sent.value, set(), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            e, bucket, hot = (np.concatenate([h[k] for h in held]) for k in range(3))
            m = np.array(members, "<i8").reshape(-1, 4)
            home = m[:, 0] % buckets
            rows = [(int(k), _MEMBERS, m[home == k].tobytes()) for k in np.unique(home)]
            for kind, mine in ((_ENTRIES, ~hot), (_HOT_ENTRIES, hot)):
                x, k = e[mine], bucket[mine]
                order = np.argsort(k, kind="stable")
                x, k = x[order], k[order]
                starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
                rows += [(int(k[at]), kind, pack_entries(part)) for at, part in zip(starts, np.split(x, starts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [_column([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "data"]
            )
            held.clear()
            members.clear()

        for b in batches:
            for t in b["text"]:
                s = shingles(t.as_py(), memo, words)
                d = digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                p, rank = prefix(s, table, num, den)
                e = np.empty(len(p), _ENTRY)
                group = xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(s)) & _GROUP
                e["key"], e["group"], e["size"], e["at"] = p & _KEY, group, len(s), np.arange(len(p))
                hot = rank >= 4 * hot_bits
                bucket = ((p >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                held.append((e, np.where(hot, group % buckets, bucket), hot))
                members.append((group, len(s), *d))
                n += len(p)
                if n >= BLOCK_ENTRIES:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(run, "bucket int, kind int, data binary")


def admissible(e: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which entry pairs may still reach the overlap that a link needs, by size and position."""
    a, b = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
    need = -(-num * (a + b) // (num + den))
    most = np.minimum(a - e["at"][i], b - e["at"][j])
    return (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (most >= need)


def run_pairs(e: np.ndarray, num: int, den: int, full_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate pairs of groups, entries of long runs) from entries of one or more shingles."""
    e = e[np.lexsort((e["group"], e["size"], e["at"], e["key"]))]
    again = np.zeros(len(e), bool)
    again[1:] = e[1:] == e[:-1]
    e = e[~again]
    start = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1]))) if len(e) else np.empty(0, np.int64)
    length = np.diff(np.concatenate((start, [len(e)])))
    found = [np.empty((0, 2), np.int64)]
    for m in np.unique(length[length > 1]):
        at = start[length == m]
        if m <= full_run:
            steps = [((at[:, None] + np.arange(m - gap)).ravel(), gap) for gap in range(1, m)]
            ends = ((i, i + gap) for i, gap in steps)
        else:
            ends = [(np.repeat(at, m - 1), (at[:, None] + np.arange(1, m)).ravel())]
        for i, j in ends:
            ok = admissible(e, i, j, num, den)
            found.append(np.column_stack((e["group"][i[ok]], e["group"][j[ok]])).astype(np.int64))
    pairs = np.concatenate(found)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs
    return pairs[pairs[:, 0] != pairs[:, 1]], e[np.repeat(length > full_run, length)]


def _candidates(entries: DataFrame, buckets: int, num: int, den: int, full_run: int) -> DataFrame:
    """Rows (kind, p, q, r, s): pair (group, group), kept entry (run, group, size, at), member (group, size, d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {_MEMBERS: [np.empty((0, 4), np.int64)], _ENTRIES: [np.empty(0, _ENTRY)], _HOT_ENTRIES: [np.empty(0, _ENTRY)]}
        for b in batches:
            for kind, data in zip(b["kind"].to_pylist(), b["data"].to_pylist()):
                got[kind].append(np.frombuffer(data, "<i8").reshape(-1, 4) if kind == _MEMBERS else unpack_entries(data))
        pairs, long_run = run_pairs(np.concatenate(got[_ENTRIES]), num, den, full_run)
        wide = np.zeros((len(pairs), 4), np.int64)
        wide[:, :2] = pairs
        kept = np.unique(np.concatenate((long_run, *got[_HOT_ENTRIES])))
        kept = np.column_stack([kept[c].astype(np.int64) for c in ("key", "group", "size", "at")])
        member = np.unique(np.concatenate(got[_MEMBERS]), axis=0)
        for kind, rows in (("pair", wide), ("entry", kept), ("member", member)):
            for k in range(0, len(rows), 100_000):
                part = rows[k : k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [_column([kind] * len(part), pa.string()), *(_column(part[:, c], pa.int64()) for c in range(4))], ["kind", "p", "q", "r", "s"]
                )

    return entries.repartition(buckets, "bucket").mapInArrow(run, "kind string, p long, q long, r long, s long")


# ---------------------------------------------------------------- steps 4 and 5


def _may_link(num: int, den: int, other: str = "_x") -> Column:
    """Whether sizes and signatures of two sets leave the overlap that a link needs."""
    a, b = F.col("size"), F.col(f"size{other}")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}{other}"))) for c in SIGNS), F.lit(0))
    need = F.ceil(F.lit(num) * (a + b) / F.lit(num + den))
    return (F.lit(den) * F.least(a, b) >= F.lit(num) * F.greatest(a, b)) & (a + b - apart >= 2 * need)


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of sets that link, from stored ``pairs``; texts are fetched by the doc_id of one row of each set."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = staged(sets.select("node", "d1", "d2", "doc_id").join(wanted, "node", "left_semi"), "jaccard-wanted")
    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    nodes = wanted.select("node", "d1", "d2")
    if wanted.count() <= BROADCAST_IDS:
        ids, nodes = F.broadcast(ids), F.broadcast(nodes)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").select("text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for b in batches:
            for k in range(0, len(b), 500):
                found = [shingles(t.as_py(), memo, words) for t in b["text"][k : k + 500]]
                d = [digest(s) for s in found]
                ends = np.cumsum([0] + [len(s) for s in found])
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(_column([x[k] for x in d], pa.int64()) for k in range(2)), sets], ["d1", "d2", "shingles"])

    made = texts.mapInArrow(shingled, "d1 long, d2 long, shingles array<long>").join(nodes, ["d1", "d2"])
    made = staged(made.select("node", "shingles"), "jaccard-sets")
    mine, other = (made.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    met = pairs.join(other, "b").join(mine, "a")
    shared, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    linked = met.filter(F.lit(den) * shared >= F.lit(num) * (total - shared))
    return staged(linked.select("a", "b").distinct(), "jaccard-links")


def _across(left: DataFrame, right: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of entries of one run in different components that size, position and signature leave open."""
    other = right.select(*(F.col(x).alias(f"{x}_x") for x in ("run", "node", "size", "at", "c", "own", *SIGNS)))
    need = F.ceil(F.lit(num) * (F.col("size") + F.col("size_x")) / F.lit(num + den))
    most = F.least(F.col("size") - F.col("at"), F.col("size_x") - F.col("at_x"))
    apart = (F.col("c") != F.col("c_x")) & (F.col("own") | F.col("own_x"))
    met = left.join(other, (F.col("run") == F.col("run_x")) & apart & (most >= need) & _may_link(num, den))
    return met.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def _join_components(
    docs: DataFrame, sets: DataFrame, runs: DataFrame, labels: DataFrame, done: DataFrame, words: int, num: int, den: int
) -> DataFrame:
    """``labels`` after the links between components within ``runs`` (run, own, at, node, size, signature).

    The first round meets only one centre a run, the second all that still are apart. Entries that are not ``own``
    meet only such that are. ``done`` are pairs compared before.
    """
    for everything in (False, True):
        label = labels.select(F.col("node").alias("_node"), "component")
        placed = runs.join(label, F.col("node") == F.col("_node"), "left")
        placed = staged(placed.select(*runs.columns, F.coalesce("component", "node").alias("c")), "jaccard-placed")
        parts = placed.groupBy("run", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("at", "size", "node")).alias("first"))
        main = parts.groupBy("run").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        main = staged(main.select("run", "main"), "jaccard-main")
        if main.isEmpty():
            return labels
        still = placed.join(main, "run")
        few = still.filter("c <> main")
        if not everything:
            centres = few.groupBy("run").agg(F.min(F.struct("at", "size", "node")).alias("first"))
            centres = centres.select(F.col("run").alias("_run"), F.col("first.node").alias("_node"))
            few = few.join(centres, (F.col("run") == F.col("_run")) & (F.col("node") == F.col("_node")), "left_semi")
        pairs = staged(_across(few, still, num, den).join(done, ["a", "b"], "left_anti"), "jaccard-rest")
        if pairs.isEmpty():
            continue
        known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = connected_components(known.unionByName(_links(docs, sets, pairs, words, num, den)), "a", "b")
        done = done.unionByName(pairs)
    return labels


def _components(
    docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, full_run: int = FULL_RUN, hot_bits: int = HOT_BITS
) -> DataFrame:
    """doc_id, th (hash of the text), n and, where the row is not alone in its component, ``keeper``: which row stays."""
    bits = sketch_bits(docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0)
    sketch = staged(_sketch(docs, words, bits), "jaccard-sketch")
    members = sketch.filter("block is null").drop("block", "counts")
    total = members.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * partitions, int(total) // BUCKET_SHINGLES)
    entries = _entries(docs, _classes(sketch, bits), buckets, words, num, den, hot_bits)
    found = staged(_candidates(entries, buckets, num, den, full_run), "jaccard-candidates")

    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    sets = members.filter("n > 0").groupBy("d1", "d2").agg(
        F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in SIGNS)
    )
    # Numbers are written with the sets, so all later reads agree on them.
    sets = staged(sets.withColumns({"doc_id": F.col("first.doc_id"), "node": F.monotonically_increasing_id()}), "jaccard-nodes")
    groups = found.filter("kind = 'member'").select(F.col("p").alias("g"), F.col("q").alias("size"), F.col("r").alias("d1"), F.col("s").alias("d2")).distinct()
    groups = staged(groups.join(sets, ["d1", "d2"]).select("g", "size", "node", *SIGNS), "jaccard-groups")
    counted = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("first"))
    several = staged(counted.filter("m > 1"), "jaccard-several")
    large = several.filter(F.col("m") > full_run)

    def both(pairs: DataFrame) -> DataFrame:
        """Members of the groups (p, q), each with each."""
        one = groups.withColumnRenamed("g", "p")
        two = groups.select(F.col("g").alias("q"), *(F.col(c).alias(f"{c}_x") for c in ("size", "node", *SIGNS)))
        met = pairs.join(one, "p").join(two, "q").filter(F.col("node") != F.col("node_x")).filter(_may_link(num, den))
        return met.select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b"))

    inside = several.filter(F.col("m") <= full_run).select(F.col("g").alias("p"), F.col("g").alias("q"))
    sizes = [large.select(F.col("g").alias(c), F.col("m").alias(f"m_{c}")) for c in "pq"]
    across = found.filter("kind = 'pair'").select("p", "q").distinct().join(sizes[0], "p", "left").join(sizes[1], "q", "left")
    across = staged(across, "jaccard-across")
    # A member of a large group meets the group's first member now and the others in step 5.
    stars = groups.join(large, "g").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    small = across.filter("m_p is null and m_q is null").select("p", "q")
    pairs = staged(both(small.unionByName(inside)).unionByName(stars).distinct(), "jaccard-pairs")
    labels = connected_components(_links(docs, sets, pairs, words, num, den), "a", "b")

    # Runs of step 5: kept entries; large groups; and groups that are paired with a large one, in its run.
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    kept = found.filter("kind = 'entry'").select(F.col("p").alias("run"), F.col("q").alias("g"), F.col("s").alias("at"), yes.alias("own")).distinct()
    crowd = large.select(F.xxhash64("g").alias("run"), "g", zero.alias("at"), yes.alias("own"))
    owner = F.when(F.col("m_q").isNotNull(), F.struct("q", "p")).otherwise(F.struct(F.col("p").alias("q"), F.col("q").alias("p")))
    guests = across.filter("m_p is not null or m_q is not null").select(owner.alias("o"))
    guests = guests.select(F.xxhash64("o.q").alias("run"), F.col("o.p").alias("g"), zero.alias("at"), F.lit(False).alias("own")).distinct()
    runs = staged(kept.unionByName(crowd).unionByName(guests).join(groups, "g").drop("g"), "jaccard-runs")
    if not runs.isEmpty():
        labels = _join_components(docs, sets, runs, labels, pairs, words, num, den)

    placed = staged(labels.join(sets.select("node", "first"), "node"), "jaccard-labels")
    keepers = placed.groupBy("component").agg(F.min("first").alias("keeper"))
    placed = placed.join(keepers, "component").select("node", "keeper")
    # Sets of one row outside every component stand for themselves and need no row here.
    homes = sets.select("node", "d1", "d2", "first", "copies").join(placed, "node", "left").filter("copies > 1 or keeper is not null")
    homes = homes.select("d1", "d2", F.coalesce("keeper", "first").alias("keeper"))
    return members.select("doc_id", "th", "n", "d1", "d2").join(homes, ["d1", "d2"], "left").select("doc_id", "th", "n", "keeper")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links lead to).

    ``options``: words, num, den, full_run, hot_bits.
    """
    found = _components(_identified(docs, id_col, text_col), **options)
    home = F.when(F.col("keeper").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), home.alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does, with all their columns.

    The row with the smallest doc_id stays, of several the one with the least hash of the text; rows equal in both
    stay or go together.
    """
    found = _components(_identified(docs, id_col, text_col), **options)
    stays = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.th") == F.col("th"))
    gone = found.filter(F.col("keeper").isNotNull() & ~stays).select(F.col("doc_id").alias("id"), "th").distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["id"]) & (F.xxhash64(docs[text_col]) == gone["th"]), "left_anti")

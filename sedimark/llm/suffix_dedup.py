"""Removal of repeated byte strings, by suffix arrays with threshold-bounded interval expansion.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere else, in the same text
or another one. Texts are judged as UTF-8 bytes on the input as it is; strings never cross texts.

Dealing the work: every window of ``length`` bytes is assigned to its anchor, the ``GRAM``-byte string in it with
the least hash (grams that repeat a short period come last), so equal windows have equal anchors. The windows of
one anchor in a row make a piece. Anchors that occur once are done. The pieces of the others are dealt by anchor; pieces
with the same 128-bit digest of their bytes collapse to one that counts twice.

In each task the pieces stand in one string. Its suffixes are sorted as far as ``length`` bytes by doubling, and
common prefix lengths come from the Burrows-Wheeler transform: intervals of suffixes that share a prefix are
expanded breadth first, one byte to the left at a time, and the boundary of an interval that is new at
prefix length l gets the value l, by increasing value. Expansion stops at ``length``: boundaries still without a
value separate suffixes that share at least that much. Windows in such a run repeat if they count twice or more.

Where more than ``HOT`` different pieces share an anchor (a passage in many different surroundings), their windows
are dealt one by one, by a 128-bit digest each, so that no task holds an anchor: windows whose digest is theirs alone
cannot repeat, and of the windows with one digest the first and the last go to the suffix array, whose verdict holds
for all of them.

Texts are known by two 64-bit hashes, so copies of a text share their pieces' fate; a text that occurs twice or more
counts its pieces twice. One document per different text gives the bytes of the pieces.

Cases: null counts as empty; texts under ``length`` bytes stay whole. Rows that repeat a doc_id are texts of their
own, so equal repeated rows of ``length`` bytes or more lose everything. A null doc_id is kept as such. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.storage import staged

LENGTH = 400
GRAM = 24
MAX_PERIOD = 12
CHUNK = 3 << 18
HOT = 8192
TEXT_CHUNK = 1 << 19
FIRST = 8
_POSITION_BITS = 24
_SEPARATOR, _END = 0xFF, 0xFE  # bytes that no UTF-8 text has


# ---------------------------------------------------------------- anchors


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, first byte highest."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    out = np.empty(len(buf), np.uint64)
    for k in range(8):
        part = padded[k : k + (len(buf) - k + 7) // 8 * 8]
        out[k::8] = part[: len(part) // 8 * 8].view(">u8")[: len(out[k::8])]
    return out


def gram_keys(buf: np.ndarray) -> np.ndarray:
    """Of each position but the last ``GRAM - 1``: the hash of the gram there, periodic grams above all others."""
    w = _words(buf)
    n = len(buf) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) + w[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[16 : 16 + n] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    h = (h ^ (h >> np.uint64(30))) >> np.uint64(1)
    dull = np.zeros(n, bool)
    for p in range(1, MAX_PERIOD + 1):
        dull |= (w[:n] == w[p : p + n]) & (w[16 - p : 16 - p + n] == w[16 : 16 + n])
    h[dull] |= np.uint64(1 << 63)
    return h


def anchors(texts: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(text, first window, windows, anchor hash) of every piece of ``texts``, in order."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    buf = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    span = length - GRAM + 1
    if len(buf) < length:
        return []
    if len(buf) >= 1 << _POSITION_BITS:
        raise ValueError(f"{len(buf)} bytes at once: positions have {_POSITION_BITS} bits")
    keys = gram_keys(buf)
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    packed = (keys & ~mask) | np.arange(len(keys), dtype=np.uint64)
    blocks = -(-len(packed) // span)
    full = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    full[: len(packed)] = packed
    grid = full.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(packed) - span + 1
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    at = (least & mask).astype(np.int64)
    # Windows that lie in one text: those of text t start at starts[t] .. starts[t] + sizes[t] - length.
    whose = np.searchsorted(starts, np.arange(n), "right") - 1
    inside = np.arange(n) - starts[whose] <= sizes[whose] - length
    at[~inside] = -1
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (whose[1:] != whose[:-1]))))
    count = np.diff(np.concatenate((first, [n])))
    real = at[first] >= 0
    first, count = first[real], count[real]
    t = whose[first]
    return list(zip(t.tolist(), (first - starts[t]).tolist(), count.tolist(), keys[at[first]].tolist()))


# ---------------------------------------------------------------- suffix array, transform, interval expansion


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first ``length`` bytes, and the sorted first eight bytes of each."""
    n = len(text)
    words = _words(text)
    order = np.argsort(words, kind="stable").astype(np.int32)
    first = words[order]
    del words
    start = np.concatenate(([True], first[1:] != first[:-1]))
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n, dtype=np.int32), np.int32(0)))
    h = FIRST
    while h < length:
        single = start & np.concatenate((start[1:], [True]))
        places = np.flatnonzero(~single).astype(np.int32)  # places of the order that still share their rank with another
        if not len(places):
            break
        at = order[places]
        later = at + h
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[at].astype(np.int64) * (n + 1) + second
        del later, second
        by = np.argsort(key, kind="stable").astype(np.int32)
        order[places] = at[by]
        key = key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        start[places] = fresh
        rank[at[by]] = np.maximum.accumulate(np.where(fresh, places, np.int32(0)))
        h *= 2
    return order, first


def shared_to_next(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, whether each suffix but the first shares ``length`` bytes with the one before it).

    ``text`` ends in a byte that it has nowhere else.
    """
    n = len(text)
    order, first = suffix_order(text, length)
    before = text[order - 1]
    back = np.empty(n, np.int32)  # last-to-first mapping
    back[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    # Prefix lengths under eight are read off the sorted first words, the rest by expansion from there.
    known = np.ones(n + 1, bool)
    known[1:n] = first[1:] != first[:-1]
    del first
    bounds = np.flatnonzero(known).astype(np.int32)
    left, right = bounds[:-1], bounds[1:] - 1
    for _ in range(FIRST, length):
        if not len(left):
            break
        sizes = right - left + 1
        total = int(sizes.sum())
        # Numbers of intervals and bytes as one: 32 bits hold 2 ** 23 intervals, and a task's text has fewer places.
        tag = np.repeat(np.arange(len(left), dtype=np.int32 if len(left) < 1 << 23 else np.int64), sizes) * 256
        places = np.arange(total, dtype=np.int32) + np.repeat(left - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        moved = back[places]
        tag += before[places]
        del places
        if total > n // 16:
            owner = np.full(n, -1, tag.dtype)
            owner[moved] = tag
            hit = np.flatnonzero(owner >= 0).astype(np.int32)
            tag = owner[hit]
        else:
            by = np.argsort(moved, kind="stable")
            hit, tag = moved[by], tag[by]
        edge = np.flatnonzero((tag[1:] != tag[:-1]) | (hit[1:] != hit[:-1] + 1))
        low, high = hit[np.concatenate(([0], edge + 1))], hit[np.concatenate((edge, [len(hit) - 1]))]
        new = ~known[high + 1]
        left, right = low[new], high[new]
        known[right + 1] = True
    return order, ~known[1:n]


def repeated_windows(pieces: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows of ``length`` bytes count at least twice among all pieces."""
    bases = np.cumsum([0] + [len(p) + 1 for p in pieces])[:-1]
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff\xfe", np.uint8)
    order, shared = shared_to_next(text, length)
    mine = np.zeros(len(text), np.int32)
    for base, p, w in zip(bases, pieces, weights):
        mine[base : base + len(p) - length + 1] = w
    run = np.concatenate(([0], np.cumsum(~shared)))
    weight = mine[order]
    flags = np.zeros(len(text), bool)
    flags[order] = (np.bincount(run, weights=weight) >= 2)[run] & (weight > 0)
    return [flags[b : b + len(p) - length + 1] for b, p in zip(bases, pieces)]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Runs of true flags as an array of (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).astype(np.int32)


# ---------------------------------------------------------------- stages

_PIECE = np.dtype(
    [("anchor", "<i8"), ("b1", "<i8"), ("b2", "<i8"), ("u1", "<i8"), ("u2", "<i8"), ("at", "<i4"), ("n", "<i4"), ("times", "<i4")]
)
_KEY = ["anchor", "b1", "b2"]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _digest(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data)
    return _signed(d >> 64), _signed(d & (1 << 64) - 1)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def _pieces(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Packed pieces by bucket of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        rows: list[tuple] = []

        def scan(group: list[tuple[int, int, int, bytes]]) -> None:
            for t, at, n, anchor in anchors([g[3] for g in group], length):
                u1, u2, base, text = group[t]
                rows.append((_signed(anchor), *_digest(text[at : at + n + length - 1]), u1, u2, base + at, n, 1))

        def out() -> pa.RecordBatch:
            e = np.array(rows, _PIECE)
            rows.clear()
            bucket = e["anchor"] % buckets
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(e) else np.empty(0, int)
            parts = np.split(e, starts[1:]) if len(e) else []
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "data"])

        group, held = [], 0
        for b in batches:
            for u1, u2, text in zip(b["u1"].to_pylist(), b["u2"].to_pylist(), b["text"]):
                seen = counts.get((u1, u2), 0)
                data = text.as_py().encode() if seen < 2 else b""
                counts[u1, u2] = seen + 1
                # Long texts in segments that overlap by all but one byte of a window: each window lies in one of them.
                for base in range(0, len(data) - length + 1, TEXT_CHUNK):
                    segment = data[base : base + TEXT_CHUNK + length - 1]
                    group.append((u1, u2, base, segment))
                    held += len(segment)
                    if held >= TEXT_CHUNK:
                        scan(group)
                        group, held = [], 0
                    if len(rows) >= 200_000:
                        yield out()
        if group:
            scan(group)
        yield out()

    return docs.mapInArrow(run, "bucket int, data binary")


def _shared(pieces: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Pieces whose anchor occurs more than once: the columns of ``_PIECE`` and ``hot``.

    ``times`` is 1 or 2 on one of the pieces with the same bytes, by how often these occur, and 0 on the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(d, _PIECE) for b in batches for d in b["data"].to_pylist()]
        e = np.concatenate([np.empty(0, _PIECE), *parts])
        e = e[np.lexsort((e["at"], e["u2"], e["u1"], e["b2"], e["b1"], e["anchor"]))]
        if not len(e):
            return

        def changes(*names: str) -> np.ndarray:
            new = np.zeros(len(e), bool)
            new[0] = True
            for name in names:
                new[1:] |= e[name][1:] != e[name][:-1]
            return new

        first = np.flatnonzero(changes("anchor", "b1", "b2", "u1", "u2", "at"))
        times = np.diff(np.concatenate((first, [len(e)])))
        e = e[first].copy()
        bytes_first = np.flatnonzero(changes("anchor", "b1", "b2"))
        totals = np.add.reduceat(times, bytes_first)
        e["times"] = 0
        e["times"][bytes_first] = np.minimum(totals, 2)
        of = np.cumsum(changes("anchor")) - 1
        several = np.bincount(of, weights=times)[of] >= 2
        crowded = np.bincount(of, weights=e["times"] > 0)[of] > hot
        e, crowded = e[several], crowded[several]
        for k in range(0, len(e), 100_000):
            x = e[k : k + 100_000]
            columns = [pa.array(np.ascontiguousarray(x[c])) for c in _PIECE.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crowded[k : k + 100_000])], [*_PIECE.names, "hot"])

    schema = "anchor long, b1 long, b2 long, u1 long, u2 long, at int, n int, times int, hot boolean"
    return pieces.repartition(buckets, "bucket").mapInArrow(run, schema)


def _verdicts(carriers: DataFrame, length: int) -> DataFrame:
    """(anchor, b1, b2, runs) of the pieces in ``carriers`` (anchor, b1, b2, times, piece), dealt by anchor."""
    kinds = {"anchor": pa.int64(), "b1": pa.int64(), "b2": pa.int64(), "runs": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b[c].to_pylist() for c in (*_KEY, "times", "piece")))]
        rows.sort(key=lambda r: r[0])
        chunk: list[tuple] = []

        def judge() -> pa.RecordBatch:
            flags = repeated_windows([r[4] for r in chunk], [r[3] for r in chunk], length)
            return _batch([(*r[:3], runs_of(f).tobytes()) for r, f in zip(chunk, flags) if f.any()], kinds)

        size = 0
        for r in rows:
            if size >= CHUNK and chunk[-1][0] != r[0]:
                yield judge()
                chunk, size = [], 0
            chunk.append(r)
            size += len(r[4])
        if chunk:
            yield judge()

    return carriers.mapInArrow(run, "anchor long, b1 long, b2 long, runs binary")


def _hot_verdicts(carriers: DataFrame, length: int, buckets: int) -> DataFrame:
    """``_verdicts`` of pieces whose anchors have many: window by window, dealt by digest."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"anchor": pa.int64(), "b1": pa.int64(), "b2": pa.int64(), "times": pa.int32(), "o": pa.int32(), "d1": pa.int64(), "d2": pa.int64()}
        for b in batches:
            for anchor, b1, b2, times, piece in zip(*(b[c].to_pylist() for c in (*_KEY, "times", "piece"))):
                windows = range(len(piece) - length + 1)
                yield _batch([(anchor, b1, b2, times, o, *_digest(piece[o : o + length])) for o in windows], kinds)

    schema = "anchor long, b1 long, b2 long, times int, o int, d1 long, d2 long"
    windows = staged(carriers.mapInArrow(digests, schema), "suffix-windows")
    place = F.struct(*_KEY, "o")
    counted = windows.groupBy("d1", "d2").agg(F.sum("times").alias("w"), F.min(place).alias("low"), F.max(place).alias("high")).filter("w > 1")
    once = F.col("low") == F.col("high")
    weighed = [F.struct(F.lit(k).cast("long").alias("k"), F.when(once, 2).otherwise(1).alias("weight"), F.col(c).alias("place")) for k, c in enumerate(("low", "high"))]
    chosen = counted.select("d1", "d2", F.explode(F.when(once, F.array(weighed[0])).otherwise(F.array(*weighed))).alias("x"))
    wanted = chosen.groupBy(*(F.col(f"x.place.{c}").alias(c) for c in _KEY)).agg(
        F.collect_list(F.struct("d1", "d2", "x.k", "x.weight", F.col("x.place.o").alias("o"))).alias("cuts")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"anchor": pa.int64(), "b1": pa.int64(), "b2": pa.int64(), "times": pa.int32(), "piece": pa.binary()}
        for b in batches:
            for piece, cuts in zip(b["piece"].to_pylist(), b["cuts"].to_pylist()):
                yield _batch([(c["d1"], c["d2"], c["k"], c["weight"], piece[c["o"] : c["o"] + length]) for c in cuts], kinds)

    pieces = carriers.join(wanted, _KEY).select("piece", "cuts")
    cuts = pieces.mapInArrow(cut, "anchor long, b1 long, b2 long, times int, piece binary").repartition(buckets, "anchor")
    true = staged(_verdicts(cuts, length).select(F.col("anchor").alias("d1"), F.col("b1").alias("d2")).distinct(), "suffix-true")
    found = windows.join(true, ["d1", "d2"], "left_semi").groupBy(*_KEY).agg(F.sort_array(F.collect_set("o")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in b["at"].to_pylist():
                flags = np.zeros(at[-1] + 1, bool)
                flags[at] = True
                out.append(runs_of(flags).tobytes())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in _KEY), pa.array(out, pa.binary())], [*_KEY, "runs"])

    return found.mapInArrow(pack, "anchor long, b1 long, b2 long, runs binary")


def suffix_dedup(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    ``with_text`` adds ``spans``, the removed (start, end) in bytes, and ``kept``, the remaining bytes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"u1": F.xxhash64("text"), "u2": F.xxhash64(F.reverse("text"), F.octet_length("text"))})
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = docs.filter(F.octet_length("text") >= length)
    shared = staged(_shared(_pieces(large.select("u1", "u2", "text"), buckets, length), buckets, hot), "suffix-shared")
    holders = large.groupBy("u1", "u2").agg(F.min("doc_id").alias("doc_id"))
    needed = shared.filter("times > 0").groupBy("u1", "u2").agg(F.collect_list(F.struct(*_KEY, "times", "hot", "at", "n")).alias("cuts"))
    needed = staged(needed.join(holders, ["u1", "u2"]), "suffix-needed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"anchor": pa.int64(), "b1": pa.int64(), "b2": pa.int64(), "times": pa.int32(), "hot": pa.bool_(), "piece": pa.binary()}
        for b in batches:
            out = []
            for text, cuts in zip(b["text"].to_pylist(), b["cuts"].to_pylist()):
                data = text.encode()
                out += [(c["anchor"], c["b1"], c["b2"], c["times"], c["hot"], data[c["at"] : c["at"] + c["n"] + length - 1]) for c in cuts]
            yield _batch(out, kinds)

    keys = needed.select(*(F.col(c).alias(f"_{c}") for c in ("u1", "u2", "doc_id")), "cuts")
    whole = large.join(
        keys.hint("shuffle_hash"), (F.col("u1") == F.col("_u1")) & (F.col("u2") == F.col("_u2")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    )
    schema = "anchor long, b1 long, b2 long, times int, hot boolean, piece binary"
    carriers = staged(whole.select("text", "cuts").mapInArrow(cut, schema), "suffix-carriers")
    verdicts = _verdicts(carriers.filter("not hot").repartition(buckets, "anchor"), length)
    crowded = carriers.filter("hot")
    if not crowded.isEmpty():
        verdicts = verdicts.unionByName(_hot_verdicts(crowded, length, buckets))
    verdicts = staged(verdicts, "suffix-verdicts")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [
                (u1, u2, at + s, at + e + length - 1)
                for u1, u2, at, runs in zip(*(b[c].to_pylist() for c in ("u1", "u2", "at", "runs")))
                for s, e in np.frombuffer(runs, np.int32).reshape(-1, 2).tolist()
            ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["u1", "u2", "s", "e"])

    hits = shared.join(verdicts, _KEY).select("u1", "u2", "at", "runs")
    spans = hits.mapInArrow(spread, "u1 long, u2 long, s int, e int").groupBy("u1", "u2").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = staged(spans, "suffix-spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist()):
                data, merged = text.encode(), []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                row = (len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"s": s, "e": e} for s, e in merged], kept) if with_text else row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])), pa.binary()]
            columns = [pa.array([r[k] for r in out], kinds[k]) for k in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<s:int,e:int>>, kept binary" if with_text else ""
    return docs.join(spans.hint("shuffle_hash"), ["u1", "u2"], "left").select("doc_id", "text", "spans").mapInArrow(remove, schema)

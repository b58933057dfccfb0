"""MinHash near-dedup by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, edges_of, groups, id_text, only, written
from .textkit import Words, grams, mix, seeds, signed, span_hashes, words


class Family(NamedTuple):
    """n sketches of some minima over k-mers of k words, for texts of least to most words."""

    k: int
    minima: int
    n: int
    least: int
    most: int


#: Long texts have too many words in common, and these too often in another order, for single words to be k-mers.
#: A text of 400 to 600 words is in both families: similar texts differ by half in length at most.
FAMILIES = (Family(1, 5, 36, 0, 600), Family(3, 2, 64, 400, 1 << 60))
SKETCHES = sum(f.n for f in FAMILIES)
#: Words up to which a text also meets every text that is similar, by what is left when some words are left out.
SHORT = 10
#: Least 2 * common words in order / (words of both).
SIMILARITY = 0.8
#: Longs of a document's bit set, of its words by occurrence, that rules out most pairs before they are aligned.
LONGS = 16
#: Documents aligned to one document in one group of rows.
SPREAD = 256
#: Documents of a bucket that are compared in one go; larger buckets go block against block.
BLOCK = 1024


def occurrences(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Number of earlier items of the same row with the same hash."""
    x = mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), dtype=np.int64)
    out[order] = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return out


def _least(y: np.ndarray, row: np.ndarray, begin: np.ndarray, count: np.ndarray, m: int) -> np.ndarray:
    """Places of the m least of each row, in the order of the text; len(y) for those that a row hasn't."""
    # Rows of many items are thinned first: about 4 m + 8 items of each are low enough.
    low = np.minimum((4 * m + 8) / count, 1.0)
    limit = np.where(low < 1, (low * 2.0**64 * (1 - 2.0**-50)).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.flatnonzero(y <= np.repeat(limit, count))
    got = np.bincount(row[at], minlength=len(count))
    poor = np.flatnonzero(got < np.minimum(count, m))
    if len(poor):  # by chance too few: all of these rows
        more = np.concatenate([np.arange(begin[r], begin[r] + count[r]) for r in poor])
        at = np.concatenate([at[~np.isin(row[at], poor)], more])
        got[poor] = count[poor]
    order = np.lexsort((y[at], row[at]))
    first = np.concatenate([[0], np.cumsum(got)[:-1]])
    rank = np.arange(len(at)) - np.repeat(first, got)
    keep = rank < m
    out = np.full((len(count), m), len(y), dtype=np.int64)
    out[np.repeat(np.arange(len(count)), got)[keep], rank[keep]] = at[order][keep]
    out.sort(axis=1)
    return out


def sketch(h: np.ndarray, ptr: np.ndarray, n: int = FAMILIES[0].n, k: int = FAMILIES[0].k, minima: int = FAMILIES[0].minima) -> np.ndarray:
    """n Order MinHash sketches, a row each: hashes of the k-mers with least hash, in the order of the text.

    K-mers are labelled by their occurrence in the row, so that repeats count. A
    row of fewer than k words is one k-mer of all its words; a row of fewer k-mers
    than minima uses those that it has. A row without words has sketches of 0.
    """
    rows, length = len(ptr) - 1, np.diff(ptr)
    out = np.zeros((rows, n), dtype=np.uint64)
    if not len(h):
        return out
    g = np.zeros(len(h), dtype=np.uint64)
    g[: max(len(h) - k + 1, 0)] = grams(h, k)
    row = np.repeat(np.arange(rows), length)
    left = np.repeat(ptr[1:], length) - np.arange(len(h))
    for r in np.flatnonzero((length > 0) & (length < k)):
        total = np.uint64(length[r])
        for x in h[ptr[r] : ptr[r + 1]]:
            total = mix(np.array([total ^ x]))[0]
        g[ptr[r]] = total
    ok = (left >= k) | ((np.repeat(length, length) < k) & (left == np.repeat(length, length)))
    g, row = g[ok], row[ok]
    count = np.bincount(row, minlength=rows)
    full = np.flatnonzero(count)
    count = count[full]
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    row = np.repeat(np.arange(len(full)), count)
    x = g ^ mix(occurrences(g, row).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    known = np.append(g, np.uint64(0))
    for j, s in enumerate(seeds(n, 11 + k)):
        y = (x ^ s) * (mix(np.array([s]))[0] | np.uint64(1))
        y ^= y >> np.uint64(29)
        y *= np.uint64(0xBF58476D1CE4E5B9)
        at = _least(y, row, begin, count, minima)
        value = np.full(len(full), s, dtype=np.uint64)
        for m in range(minima):
            value = mix(value * np.uint64(3) + known[at[:, m]])
        out[full, j] = value
    return out


def sketches(h: np.ndarray, ptr: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(rows, sketches, place of the first) for each family."""
    length, out, place = np.diff(ptr), [], 0
    for f in FAMILIES:
        rows = np.flatnonzero((length > 0) & (length >= f.least) & (length <= f.most))
        size = length[rows]
        own = np.concatenate([[0], np.cumsum(size)])
        items = h[np.repeat(ptr[:-1][rows] - own[:-1], size) + np.arange(own[-1])]
        out.append((rows, sketch(items, own, f.n, f.k, f.minima), place))
        place += f.n
    return out


def row_hashes(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Hash of each row's whole sequence; 0 for a row without items."""
    out = np.zeros(len(ptr) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        # Spans may not contain zeros, and each row's begin is given.
        out[full] = span_hashes(h | np.uint64(1), ptr[:-1][full])
        out[full] = mix(out[full] ^ np.diff(ptr)[full].astype(np.uint64))
    return out


SKETCHED = "id long, n int, whole long, sketches array<long>"


def parts_of(h: np.ndarray, least: float) -> np.ndarray:
    """Hashes of a row's text less some of its words, for rows of n words each: a column a choice.

    Similar texts have a common part of least / (2 - least) or more of the words of either.
    """
    n, out = h.shape[1], []
    for size in range(max(1, ceil(n * least / (2 - least) - 1e-9)), n + 1):
        at = np.array(list(combinations(range(n), size)))
        value = np.full((len(h), len(at)), size, dtype=np.uint64)
        for k in range(size):
            value = mix(value * np.uint64(3) + h[:, at[:, k]])
        out.append(value)
    return np.hstack(out)


def _sketch_rows(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What each text can share with a similar one: its sketches by their number and, from SKETCHES on, the parts of a short text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                length = np.diff(w.ptr)
                row, value = [], []
                for rows, s, place in sketches(w.hash, w.ptr):
                    row.append(np.repeat(rows, s.shape[1]))
                    value.append(mix(s + seeds(s.shape[1], 31 + place)[None, :]).ravel())
                for n in range(1, SHORT + 1):
                    short = np.flatnonzero(length == n)
                    if len(short):
                        for r, x in zip(short.tolist(), parts_of(w.hash[w.ptr[short][:, None] + np.arange(n)], least)):
                            x = np.unique(x)
                            row.append(np.full(len(x), r))
                            value.append(x)
                at, values = np.concatenate(row), np.concatenate(value)
                order = np.argsort(at, kind="stable")
                keep = np.flatnonzero(length)
                edge = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(length))[keep])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(signed(values[order])))
                ids = batch.column(0).slice(w.first, len(length)).take(pa.array(keep))
                yield pa.record_batch([ids, pa.array(length[keep].astype(np.int32)), pa.array(signed(row_hashes(w.hash, w.ptr)[keep])), lists], names=["id", "n", "whole", "sketches"])

    return run


TOKENS = "id long, n int, bits array<long>, tokens binary"


def bit_sets(w: Words) -> np.ndarray:
    """A row of LONGS a text: the bits of its words, repeats being words of their own."""
    x = mix(w.hash ^ mix(occurrences(w.hash, w.row).astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    out = np.zeros((len(w.ptr) - 1, 64 * LONGS), dtype=np.uint8)
    out[w.row, (x % np.uint64(64 * LONGS)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.int64)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each word's hash, as one binary value a document, and its bit set."""
    for batch in batches:
        for w in words(batch.column(1)):
            n = len(w.ptr) - 1
            raw = (w.hash >> np.uint64(32)).astype(np.uint32).tobytes()
            values = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((w.ptr * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)])
            bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * LONGS), pa.array(bit_sets(w).ravel()))
            yield pa.record_batch([batch.column(0).slice(w.first, n), pa.array(np.diff(w.ptr).astype(np.int32)), bits, values], names=["id", "n", "bits", "tokens"])


def _possible(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """The pairs (hub, id) without those that can't be similar: a bit that only one has is a word that isn't in common."""
    a = tokens.select(F.col("id").alias("hub"), F.col("n").alias("hn"), F.col("bits").alias("hbits"))
    apart = F.expr(" + ".join(f"bit_count(bits[{k}] ^ hbits[{k}])" for k in range(LONGS)))
    both = F.col("n") + F.col("hn")
    near = pairs.join(a, "hub").join(tokens.select("id", "n", "bits"), "id").filter(both - apart >= least * both)
    return cut(near.select("hub", "id").distinct())


def common_in_order(at: dict[int, int], n: int, other: list[int], band: int) -> int:
    """Longest common subsequence of n items, given as bit masks by item, with other, at most band places apart.

    One bit a place, all of a row's band at once: the band moves along with the
    rows, and a row costs a few operations on whole numbers of 2 * band + 1 bits.
    """
    wide = 2 * band + 1
    strip, top = (1 << wide) - 1, 1 << (wide - 1)
    # v: the places from low on, 0 where the row's length goes up; those below low are final.
    v, low, done = strip, -band, 0
    for x in other:
        m = at.get(x)
        if m is not None:
            u = v & (m >> low if low >= 0 else m << -low)
            if u:
                v = ((v + u) | (v - u)) & strip
        done += not v & 1
        v = (v >> 1) | top
        low += 1
    return done + wide - v.bit_count()


def masks(items: list[int]) -> dict[int, int]:
    at: dict[int, int] = {}
    for j, x in enumerate(items):
        at[x] = at.get(x, 0) | (1 << j)
    return at


def similar(at: dict[int, int], n: int, other: list[int], least: float) -> bool:
    """2 * common / (n + len(other)) >= least. The band is as wide as any alignment this good can stray."""
    both = n + len(other)
    need = least * both
    if 2 * min(n, len(other)) < need or 2 * sum(x in at for x in other) < need:
        return False
    band = int((both - need + abs(n - len(other))) // 2) + 1
    return 2 * common_in_order(at, n, other, band) >= need


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs, us, vs = None, [], [], []
        for batch in batches:
            hub, part, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            tokens = batch.column(3)
            for i in range(batch.num_rows):
                items = np.frombuffer(tokens[i].as_buffer(), dtype=np.uint32).tolist()
                h, d = int(hub[i]), int(ids[i])
                if h == d:  # a document of several texts has a row for each
                    hubs = [*(hubs if group == (h, int(part[i])) else []), (masks(items), len(items))]
                    group = (h, int(part[i]))
                elif group == (h, int(part[i])) and any(similar(at, n, items, least) for at, n in hubs):
                    us.append(h)
                    vs.append(d)
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
            us, vs = [], []

    return run


def _aligned(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (hub, id) that are similar; each hub's partners are spread over parts of about SPREAD rows."""
    size = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(SPREAD)).alias("parts"))
    placed = pairs.join(size, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    hubs = size.select("hub", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.col("hub").alias("id"))
    rows = placed.unionByName(hubs).join(tokens.select("id", "tokens"), "id").select("hub", "part", "id", "tokens")
    lined = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    return lined.mapInArrow(_verify(least), "u long, v long")


def _apart(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hub, id) of rows of different roots that may be similar, block by block; columns h, i, j, b, id, n, root, bits."""
    edge = edges_of(table, 3)
    i, j, b, ids, n, root = (table.column(k).to_numpy() for k in (1, 2, 3, 4, 5, 6))
    bits = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column(7).chunks]).reshape(-1, LONGS).view(np.uint64)
    for x, y in zip(edge, edge[1:]):
        at = x + np.argsort(n[x:y], kind="stable")
        size = n[at]
        for k in range(len(at)):
            # Longer ones within reach: 2 * the lesser / both must be least or more.
            end = int(np.searchsorted(size, size[k] * (2 - least) / least * (1 + 1e-9), "right"))
            others = at[k + 1 : end]
            others = others[root[others] != root[at[k]]]
            if i[x] != j[x]:  # pairs within a block are for i = j
                others = others[b[others] != b[at[k]]]
            if not len(others):
                continue
            both = n[others] + n[at[k]]
            near = others[both - np.bitwise_count(bits[others] ^ bits[at[k]]).sum(axis=1) >= least * both - 1e-9]
            if len(near):
                yield np.minimum(ids[near], ids[at[k]]), np.maximum(ids[near], ids[at[k]])


def _filtered(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            for hub, other in _apart(table, least):
                yield pa.record_batch([pa.array(hub), pa.array(other)], names=["hub", "id"])

    return run


def _mixed(bucket: DataFrame, part: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """(hub, id): pairs of a bucket that are in different groups yet and may be similar, by their bit sets.

    Of buckets with the same members one is compared, block against block.
    """
    named = bucket.select("h", "id").join(part, "id", "left").select("h", "id", F.coalesce("root", "id").alias("root"))
    key = F.xxhash64("id")
    mixed = named.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.bit_xor(key).alias("a"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("b")).filter("lo <> hi")
    alike = mixed.groupBy("a", "b", "size").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("parts"))
    placed = named.join(alike, "h").select("h", "id", "root", F.pmod(key, F.col("parts")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"))
    rows = placed.select("h", F.least("b", "x").alias("i"), F.greatest("b", "x").alias("j"), "b", "id", "root").join(tokens.select("id", "n", "bits"), "id")
    lined = rows.select("h", "i", "j", "b", "id", "n", "root", "bits").repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return lined.mapInArrow(_filtered(least), "hub long, id long").distinct()


def duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, kept_doc_id): each document to be dropped, and the one of its group that stays, the least id.

    Documents are compared as words in lower case, without punctuation, over their
    whole length. Two are candidates if any of their Order MinHash sketches agree
    or, for two of up to SHORT words, if they are similar at all; they are similar if
    2 * common words in order / words of both is at least similarity; groups are
    the connected components. All candidates of a bucket count: each is first
    aligned with the least id of the bucket, and then every pair that isn't in one
    group yet is compared as well, so that groups are those of all similar candidates.

    Rows with a null id or text and texts without a word are in no group. Several
    rows with the same id are one document, which joins the groups of any of its
    texts. Equal texts are a group however short. Texts of any length count whole.
    Of equally good documents the least id stays. Other columns are ignored. An
    empty table gives no rows. Ids that aren't integers raise ValueError.
    """
    base = id_text(docs, id_col, text_col).filter("text is not null")
    seen = written(base.mapInArrow(_sketch_rows(similarity), SKETCHED), "sketches")
    # Of equal texts that of the least id goes on; groups are combined before the shuffle, however large.
    copies = seen.groupBy("whole").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").select("whole", "first")
    copies = cut(copies)
    equal = cut(seen.select("id", "whole").join(copies, "whole").filter("id <> first").select(F.col("first").alias("u"), F.col("id").alias("v")).distinct())
    spread = seen.join(copies, "whole", "left").filter("first is null or first = id").select("id", F.explode("sketches").alias("h"))
    shared = spread.groupBy("h").agg(F.min("id").alias("hub"), F.max("id").alias("far")).filter("hub <> far").select("h", "hub")
    bucket = written(spread.join(shared, "h").select("h", "id", "hub").distinct(), "buckets")
    tokens = written(only(base, bucket.select("id"), "id").mapInArrow(_token_rows, TOKENS), "tokens")
    tried = bucket.filter("id <> hub").select("hub", "id").distinct()
    found = cut(_aligned(_possible(tried, tokens, similarity), tokens, similarity))
    part = cut(components(found))
    # Kept first: in one task with the contraction, which is Python as well, it would take two Python workers a core, and they stay.
    more = cut(_aligned(cut(_mixed(bucket, part, tokens, similarity)), tokens, similarity))
    links = found.unionByName(more).unionByName(equal)
    return components(links).select(F.col("id").alias("doc_id"), F.col("root").alias("kept_doc_id"))

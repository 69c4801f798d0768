"""Test items that leaked into documents.

Rare n-grams of words of the test items are the seeds: a document holding one is compared with the items it occurs in.
Of these pairs only those go on whose n-gram hits could cover enough of the item; they are aligned by Smith-Waterman
(match +1, replaced, missing or surplus word -3) around the hits. Where the best local alignment is no stretch that is
long enough, all pairs of stretches in the item's order are compared. A pair is a leak when one or two stretches with at
most one altered word in eight span at least half of the item's words; a stretch starts and ends with three same words.

Scale. Items are a table like any other: their words are hashed, and how many items hold an n-gram is counted over all
of them. Documents are read once, where they lie. Two bitmaps of a bounded size (``filter_bits``), made by Spark from
the n-grams of all items, tell a task which words may belong to an item; only of documents with a rare seed, and of
these only the words around hits, rows are written. Seeds then join documents with items by hash; a seed has at most
``rare_in`` items, so no key brings many items and many documents together. A bitmap only saves work: with so many items
that it fills up, more rows are written and the joins decide.

Defined results: null and empty texts match nothing; rows with a null id are dropped; repeated items and documents give
a pair once; items with fewer words than ``min_words`` have no n-gram that could tell them apart and never leak; further
columns are ignored; whole texts are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.text import words
from stridelake.sources.tables import materialise, shuffle_partitions

SEED, COVER = 4, 3  # words of a seed and of the n-grams by which the coverage is estimated
ERROR = 3.0
ALTERED = 7  # matches that an altered word of a stretch needs: one word in eight
EDGE = 3  # same words in a row with which a stretch starts and ends, so that unrelated words beside it do not count


def _align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of word ids: start and end in a, start and end in b, matches, altered words."""
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1))
    ramp = ERROR * np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.zeros(m + 1)
        row[1:] = np.maximum(h[i - 1, :-1] + np.where(b == a[i - 1], 1.0, -ERROR), h[i - 1, 1:] - ERROR)
        np.maximum(row, 0, out=row)
        h[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    i, j = int(i), int(j)
    i1, j1, hit, err = i, j, 0, 0
    while i > 0 and j > 0 and h[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if abs(h[i, j] - (h[i - 1, j - 1] + (1.0 if same else -ERROR))) < 1e-6:
            hit, err = hit + same, err + (not same)
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] - ERROR)) < 1e-6:
            i, err = i - 1, err + 1
        else:
            j, err = j - 1, err + 1
    return i, i1, j, j1, hit, err


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) from which EDGE words of a and b are the same, and whether the words before them are the same too."""
    same = np.zeros((len(a) + 2, len(b) + 2), bool)
    same[1:-1, 1:-1] = a[:, None] == b[None, :]
    n, m = len(a) - EDGE + 1, len(b) - EDGE + 1
    run = same[1 : n + 1, 1 : m + 1].copy()
    for k in range(1, EDGE):
        run &= same[1 + k : n + 1 + k, 1 + k : m + 1 + k]
    return run, same[:n, :m]


def _ends(a: np.ndarray, b: np.ndarray, least: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """The longest good stretch that ends at (i, j), for every place it can end: where it starts in a, matches, altered words.

    A stretch starts and ends with EDGE same words. For every start in a, the best alignment to every place is kept by
    matches less ALTERED for every altered word, which is not negative as long as the stretch keeps the rule.
    """
    if len(a) < EDGE or len(b) < EDGE:
        return {}
    run, before = _runs(a, b)
    first = run & ~before  # a longer start is as good
    rows = np.flatnonzero(first.any(1))
    unit, none = 1 << 24, -(1 << 60)  # matches in the lower bits, the balance in the upper ones
    err = ALTERED * unit
    at = np.full((len(rows), len(b) + 1), none, np.int64)
    ramp = err * np.arange(len(b) + 1, dtype=np.int64)
    out = {}
    for i in range(1, len(a) + 1):
        n = int(np.searchsorted(rows, i - EDGE))  # starts under way
        if n:
            now, row = at[:n], at[:n] - err
            np.maximum(row[:, 1:], now[:, :-1] + np.where(b == a[i - 1], unit + 1, -err), out=row[:, 1:])
            at[:n] = np.maximum.accumulate(row + ramp, axis=1) - ramp
        if i < EDGE:
            continue
        if n < len(rows) and rows[n] == i - EDGE:
            at[n, EDGE:][first[i - EDGE]] = EDGE * (unit + 1)
            n += 1
        js = np.flatnonzero(run[i - EDGE]) + EDGE
        if n and len(js):
            got = at[:n, js]
            good = (got >= 0) & (got % unit >= least)
            for c in np.flatnonzero(good.any(0)).tolist():
                r = int(good[:, c].argmax())
                hit = int(got[r, c]) % unit
                out[i, int(js[c])] = (int(rows[r]), hit, (hit - int(got[r, c]) // unit) // ALTERED)
    return out


def _stretches(a: np.ndarray, b: np.ndarray, least: int, enough: float = np.inf) -> list[tuple]:
    """One or two stretches in order, each of at least ``least`` matches and at most one altered word in eight, that span
    most of a, as (start and end in a, matches, altered words).

    A best local alignment that keeps the rule and spans ``enough`` words is taken as it is. Else, as it may bridge two
    good stretches or hide one, all pairs of stretches are compared: for every cut of a and b the longest that ends
    before it and the longest that starts after it.
    """
    i0, i1, _, _, hit, err = _align(a, b)
    if hit >= least and err * (ALTERED + 1) <= hit + err and i1 - i0 >= enough:
        return [(i0, i1, hit, err)]
    n, m = len(a), len(b)
    left = {(i, j): (s, i, h, e) for (i, j), (s, h, e) in _ends(a, b, least).items()}
    right = {(n - i, m - j): (n - i, n - s, h, e) for (i, j), (s, h, e) in _ends(a[::-1], b[::-1], least).items()}
    if not left:
        return []
    span = [np.zeros((n + 1, m + 1), np.int64) for _ in range(2)]
    for k, stretches in enumerate((left, right)):
        for (i, j), s in stretches.items():
            span[k][i, j] = s[1] - s[0]
    upto = np.maximum.accumulate(np.maximum.accumulate(span[0], axis=0), axis=1)
    since = np.maximum.accumulate(np.maximum.accumulate(span[1][::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    i, j = (int(x) for x in np.unravel_index(int((upto + since).argmax()), upto.shape))
    one = [s for (x, y), s in left.items() if x <= i and y <= j]
    two = [s for (x, y), s in right.items() if x >= i and y >= j]
    return [max(x, key=lambda s: s[1] - s[0]) for x in (one, two) if x]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of n consecutive words."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    u = ids.astype(np.uint64)
    for k in range(n):
        h = (h ^ (u[k : k + m] * _MIX[k])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
        return h

    def of(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in words(text)], np.int64)


class Item:
    """A test item: its words, where its covering n-grams are, and its rare seeds."""

    def __init__(self, w: np.ndarray, rare: set[int]):
        self.words, self.rare = w, rare
        self.cover: dict[int, list[int]] = defaultdict(list)
        for p, g in enumerate(grams(w, COVER).tolist()):
            self.cover[g].append(p)


def _reach(covered: np.ndarray, least: int) -> int:
    """No one or two stretches of an item span more of its words than this, by the words that n-gram hits cover.

    A stretch starts and ends with covered words. Altered words with two words between them leave the most uncovered:
    three for each but the last, which leaves one.
    """
    n = len(covered)
    if covered.sum() < least:
        return 0
    gaps = np.append(0, np.cumsum(~covered))
    begin, end = np.flatnonzero(covered), np.flatnonzero(covered) + 1
    size, open_ = end[None, :] - begin[:, None], gaps[end][None, :] - gaps[begin][:, None]
    size = np.where((size >= least) & ((open_ == 0) | ((ALTERED + 1) * (open_ + 2) <= 3 * size)), size, 0)
    upto, since = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    upto[end], since[begin] = size.max(0), size.max(1)
    return int((np.maximum.accumulate(upto) + np.maximum.accumulate(since[::-1])[::-1]).max())


def leak(doc: np.ndarray, place: np.ndarray, item: Item, share: float, min_stretch: int) -> tuple[float, float] | None:
    """(share of the item's words in stretches, share of altered words), from some words of a document and their places."""
    a = item.words
    g = grams(doc, COVER)
    whole = place[COVER - 1 :] - place[: len(g)] == COVER - 1  # no gap within
    pairs = [(q, p) for p in np.flatnonzero(whole).tolist() for q in item.cover.get(int(g[p]), ())]
    if not pairs:
        return None
    # hits on scattered diagonals are chance: keep those with company
    pairs = np.array(pairs)
    diag = (place[pairs[:, 1]] - pairs[:, 0]) // 16
    n = Counter(diag.tolist())
    pairs = pairs[np.array([n[d] + n[d - 1] + n[d + 1] >= 4 for d in diag.tolist()])]
    covered = np.zeros(len(a) + COVER, bool)
    for c in range(COVER):
        covered[pairs[:, 0] + c] = True
    if _reach(covered[: len(a)], min_stretch) < share * len(a):
        return None
    pad = padding(len(a))
    near = np.zeros(len(place), bool)
    hits = np.unique(place[pairs[:, 1]])
    lo = np.searchsorted(place, np.maximum(hits - pad, 0))
    hi = np.searchsorted(place, hits + COVER + pad)
    step = np.zeros(len(place) + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    near = np.flatnonzero(np.cumsum(step)[:-1] > 0)  # the words around hits, in order
    found = _stretches(a, doc[near], min_stretch, share * len(a))
    span = sum(s[1] - s[0] for s in found)
    if span >= share * len(a) and any(item.rare.intersection(grams(a[s[0] : s[1]], SEED).tolist()) for s in found):
        hit, err = sum(s[2] for s in found), sum(s[3] for s in found)
        return span / len(a), err / (hit + err)
    return None


def padding(n: int) -> int:
    """Words around a hit that a stretch of an item of n words may reach without another: its altered words may be close together."""
    return max(12, EDGE * (n // ALTERED) + EDGE)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = _Words()
    for b in batches:
        w = [hashed.of(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tolist() for x in w], pa.list_(pa.int64())), *(pa.array([grams(x, n).tolist() for x in w], pa.list_(pa.int64())) for n in (SEED, COVER))], ["item_id", "w", "seeds", "cover"])


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits places with the upper bits of all values of the column ``g`` set."""
    place = F.shiftrightunsigned("g", 64 - bits)
    rows = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(g, {64 - bits}) & 63 as int))")).alias("m")).toArrow()  # at most 2^(bits - 6) rows
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("m").to_numpy()
    return out.view(np.uint64)


def _in(bitmap: np.ndarray, g: np.ndarray) -> np.ndarray:
    p = g.view(np.uint64) >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) > 0


def _scan(seed_map: np.ndarray, cover_map: np.ndarray, least_items: int, share: float, pad: int):
    """Arrow function (doc_id, text) -> doc_id, seeds, covered, place, w of the documents that may hold an item.

    ``covered`` is the number of words in n-grams of any item that lie around a seed.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("seeds", pa.list_(pa.int64())), ("covered", pa.int64()), ("place", pa.list_(pa.int32())), ("w", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Words()
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = hashed.of(t)
                g = grams(w, SEED)
                hit = np.flatnonzero(_in(seed_map, g)) if len(g) else ()
                if not len(hit):
                    continue
                # words within reach of two covering n-grams in a row, as every stretch has: those of stretches are all among them
                c = _in(cover_map, grams(w, COVER))
                near = _spread(len(w), np.flatnonzero(c[1:] & c[:-1]), pad)
                n = int((_spread(len(w), np.flatnonzero(c), 0) & near).sum())
                if n < least_covered(least_items, share):
                    continue
                place = np.flatnonzero(near)
                for z, v in zip(out, (d, np.unique(g[hit]), n, place.astype(np.int32), w[place])):
                    z.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(z, f.type) for z, f in zip(out, schema)], schema=schema)

    return run


def _spread(n: int, hits: np.ndarray, pad: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.maximum(hits - pad, 0), 1)
    np.add.at(step, np.minimum(hits + COVER + pad, n), -1)
    return np.cumsum(step)[:-1] > 0


def least_covered(n_words: int, share: float) -> int:
    """Covered words without which no stretches span ``share`` of an item: an altered word leaves at most three uncovered, seven matches go with it."""
    return int(np.ceil(share * n_words * (1 - 3 / ALTERED))) - EDGE


def _align_pairs(share: float, min_stretch: int):
    """Arrow function (doc_id, place, w, item_id, item, rare) -> doc_id, item_id, share, altered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Item] = {}
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            place, w, item, rare = (b.column(i) for i in (1, 2, 4, 5))
            for r, (d, i) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                words_ = item[r].values.to_numpy()
                key = (i, words_.tobytes())  # an id may stand for several texts
                if key not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[key] = Item(words_, set(rare[r].values.to_pylist()))
                if got := leak(w[r].values.to_numpy(), place[r].values.to_numpy().astype(np.int64), known[key], share, min_stretch):
                    for z, v in zip(out, (d, i, *got)):
                        z.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "share", "altered"])

    return run


RESULT = "doc_id long, item_id long, share double, altered double"


def leaked_items(documents: DataFrame, items: DataFrame, *, share: float = 0.5, rare_in: int = 5, min_words: int = 8, min_stretch: int = 8, filter_bits: int = 27) -> DataFrame:
    """``doc_id, item_id, share, altered``: documents that hold a test item, wholly or in good part."""
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    it = texts.mapInArrow(_item_words, "item_id long, w array<long>, seeds array<long>, cover array<long>").where(F.size("w") >= min_words)
    it = materialise(it.withColumn("key", F.xxhash64("item_id", "w")), "items")
    size = it.agg(F.min(F.size("w")), F.max(F.size("w")), F.sum(F.size("w"))).first()
    if size[0] is None:
        return spark.createDataFrame([], RESULT)
    bits = min(filter_bits, max(12, int(size[2] * 64).bit_length()))
    held = it.select("key", F.explode(F.array_distinct("seeds")).alias("g"))
    rare = held.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= rare_in).select("g")
    of_item = materialise(held.join(rare, "g"), "seeds")
    maps = _bitmap(of_item, bits), _bitmap(it.select(F.explode("cover").alias("g")), bits)
    found = docs.mapInArrow(_scan(*maps, size[0], share, padding(size[1])), "doc_id long, seeds array<long>, covered long, place array<int>, w array<long>")
    found = materialise(found, "found")
    item = it.select("key", "item_id", F.col("w").alias("item")).join(of_item.groupBy("key").agg(F.collect_list("g").alias("rare")), "key")
    pairs = found.select("doc_id", "covered", F.explode("seeds").alias("g")).join(of_item, "g").groupBy("doc_id", "key").agg(F.first("covered").alias("covered"), F.count("*").alias("shared"))
    n = F.size("item")
    need = F.ceil(F.lit(share * (1 - 3 / ALTERED)) * n) - EDGE
    # matches of one or two stretches that span so much hold at least half as many seeds less 2 * (SEED - 1), of which some may not be rare
    seeds = F.ceil(F.lit(share / 2) * n) - 2 * (SEED - 1) - (n - (SEED - 1) - F.size("rare"))
    asked = pairs.join(item, "key").where((F.col("covered") >= need) & (F.col("shared") >= seeds)).join(found.select("doc_id", "place", "w"), "doc_id").select("doc_id", "place", "w", "item_id", "item", "rare")
    asked = asked.repartition(shuffle_partitions(spark), "doc_id", "item_id")  # few rows, much work: not to be put together
    return asked.mapInArrow(_align_pairs(share, min_stretch), RESULT).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.min("altered").alias("altered"))

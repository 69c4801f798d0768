"""Filling fixed-capacity containers with texts measured in tokens.

Vector best fit, largest first: a container has three capacities, tokens, documents and attention cost (the sum of the
squared lengths of what it holds). An item goes to the open container that can take it in all three and whose residual
vector, after taking it, has the smallest weighted norm; a new one is opened only if no open one can take the item. An
item longer than the capacity is cut into pieces of exactly the capacity and a rest; no other item is split.

Scale. Texts are tokenised where they are read; only ids and lengths move. Items are dealt by hash into groups of about
``group_items`` that are packed apart, so no task holds more. What lies in containers filled below ``refill`` is dealt
anew into groups of that size and packed again, until it is one group or until a level has filled less than
``least_gain`` of its items' containers: then items do not go together better, and they stay as they are packed.

Defined results: null texts and texts without tokens need no container and have no row; each document id is one item
(equal texts are different items, of an id that is repeated the longest text counts); a capacity that is null or below 1 is no container; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.sources.tables import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary cuts a text before merging.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The byte-level tokenizer of a vocabulary file, loaded once a process; the file is shipped with the job if it is not there."""
    if path not in _loaded:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _count(path: str, load):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            n = [len(t.encode_ordinary(x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every text that has tokens."""
    if os.path.exists(path):
        documents.sparkSession.sparkContext.addFile(path)
    docs = documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_count(path, tokenizer), "doc_id long, n_tokens long").where("n_tokens > 0")


W_DOCS, W_COST = 0.05, 0.05  # weights of the residual documents and attention cost against residual tokens


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int, max_cost: float) -> np.ndarray:
    """The container of every item (sizes in descending order, none above the capacity).

    All open containers are compared. ``max_cost`` is the attention cost a container takes; one that starts with a long
    item takes at least that item's own cost and, of what the room beside it could cost, the same share.
    """
    bins = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return bins
    share = max_cost / (float(capacity) * capacity)
    tokens, docs, cost, cap = (np.zeros(1024) for _ in range(4))  # left in the open containers; what the cost is measured against
    name = np.zeros(1024, np.int64)
    n_open, made, least = 0, 0, int(sizes[-1])
    for i, n in enumerate(sizes.tolist()):
        own = float(n) * n
        t, q = tokens[:n_open] - n, cost[:n_open] - own
        fits = np.flatnonzero((t >= 0) & (q >= 0))
        if len(fits):
            norm = (t[fits] / capacity) ** 2 + W_DOCS * ((docs[fits] - 1) / max_docs) ** 2 + W_COST * (q[fits] / cap[fits]) ** 2
            b = int(fits[norm.argmin()])
            bins[i] = name[b]
            tokens[b], docs[b], cost[b] = t[b], docs[b] - 1, q[b]
        else:
            b = n_open
            if b == len(name):
                tokens, docs, cost, cap, name = (np.concatenate([z, np.zeros_like(z)]) for z in (tokens, docs, cost, cap, name))
            cap[b] = max(max_cost, own + share * (capacity - n) ** 2)
            tokens[b], docs[b], cost[b], name[b] = capacity - n, max_docs - 1, cap[b] - own, made
            bins[i] = made
            made += 1
            n_open += 1
        if tokens[b] < least or docs[b] < 1 or cost[b] < least * least:  # nothing more fits: the last one takes its place
            n_open -= 1
            for z in (tokens, docs, cost, cap, name):
                z[b] = z[n_open]
    return bins


def _pack(refill: float, level: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        cap = int(pdf["capacity"].iloc[0])
        b = best_fit(pdf["n_tokens"].to_numpy(), cap, int(pdf["max_docs"].iloc[0]), float(pdf["max_cost"].iloc[0]) * cap * cap)
        fill = np.bincount(b, pdf["n_tokens"], b.max() + 1)
        return pdf.assign(container=b, level=level, done=pdf["final"] | (fill[b] >= refill * cap))

    return run


_ITEM = "container_kind string, capacity long, max_docs long, max_cost double, doc_id long, piece long, n_tokens long, grp long, final boolean"


def _by_kind(values: dict[str, int], other):
    """The value of the row's container kind."""
    return F.coalesce(F.create_map(*[F.lit(v) for k, x in values.items() for v in (k, x)])[F.col("container_kind")], F.lit(other)) if values else F.lit(other)


def pack(
    counts: DataFrame,
    containers: list[tuple[str, int]],
    *,
    max_docs_per_token: float = 1 / 16,
    max_cost: float = 0.75,
    group_items: int = 20_000,
    refill: float = 0.99,
    least_gain: float = 0.25,
) -> DataFrame:
    """``container_kind, container_id, doc_id, piece, token_start, n_tokens``: every item in a container of each kind.

    A container takes at most ``capacity * max_docs_per_token`` documents (16 at least) and an attention cost of
    ``max_cost * capacity ^ 2`` (see ``best_fit`` for items that alone cost nearly as much or more). ``counts`` may name a document
    repeatedly: its largest count holds.
    """
    spark = counts.sparkSession
    kinds = [(k, int(c), max(16, int(c * max_docs_per_token)), float(max_cost)) for k, c in containers if k is not None and c is not None and c >= 1]
    if not kinds:
        return spark.createDataFrame([], "container_kind string, container_id string, doc_id long, piece long, token_start long, n_tokens long")
    counts = materialise(counts.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "token_counts")
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity"), F.lit(m).cast("long").alias("max_docs"), F.lit(q).cast("double").alias("max_cost")) for k, c, m, q in kinds]))
    each = counts.select("doc_id", F.col("n_tokens").alias("all_tokens"), kind.alias("k")).select("doc_id", "all_tokens", "k.*")
    whole = F.floor(F.col("all_tokens") / F.col("capacity")).cast("long")
    # a piece of exactly the capacity fills a container
    full = each.where(F.col("all_tokens") >= F.col("capacity")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)))
    name = F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece")
    parts = [full.select("container_kind", name.alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"))]
    items = each.withColumn("piece", whole).withColumn("n_tokens", F.col("all_tokens") - whole * F.col("capacity")).where("n_tokens > 0")
    cols = ["container_kind", "capacity", "max_docs", "max_cost", "doc_id", "piece", "n_tokens"]
    items = items.select(*cols)
    size = lambda df: {r[0]: r[1] for r in df.groupBy("container_kind").count().collect()}  # noqa: E731  (one row a kind)
    left, before, level = size(items), {}, 0
    while left:
        groups = {k: -(-n // group_items) for k, n in left.items()}
        last = {k: groups[k] == 1 or n > (1 - least_gain) * before.get(k, n / (1 - least_gain)) for k, n in left.items()}
        rows = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), _by_kind(groups, 1))).withColumn("final", _by_kind(last, True))
        packed = rows.groupBy("container_kind", "grp").applyInPandas(_pack(refill, level), _ITEM + ", container long, level int, done boolean")
        packed = materialise(packed, f"packed{level}")
        name = F.concat_ws("-", "container_kind", "level", "grp", "container")
        parts.append(packed.where("done").select("container_kind", name.alias("container_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"), "n_tokens"))
        items = packed.where("not done").select(*cols)
        before, left, level = left, size(items), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fill_report(packed: DataFrame, containers: list[tuple[str, int]]) -> DataFrame:
    """``container_kind, n_containers, n_items, n_tokens, fill``: how full the containers of each kind are."""
    cap = F.create_map(*[F.lit(v) for k, c in containers if k is not None and c is not None for v in (k, c)])
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
    return per.groupBy("container_kind").agg(
        F.count("*").alias("n_containers"), F.sum("i").alias("n_items"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * F.first(cap[F.col("container_kind")]))).alias("fill")
    )


def broken_rules(packed: DataFrame, counts: DataFrame, containers: list[tuple[str, int]], *, max_docs_per_token: float = 1 / 16, max_cost: float = 0.75) -> DataFrame:
    """``container_kind, n_documents, n_overfull, n_crowded, n_costly, n_split, n_lost``: what ``pack`` promises, counted; all but the first are 0.

    Containers with too many tokens, documents or too high a cost; documents cut though they fit; documents of which
    tokens are missing or repeated.
    """
    cap = F.create_map(*[F.lit(v) for k, c in containers if k is not None and c is not None for v in (k, int(c))])[F.col("container_kind")]
    per = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("q"), F.max("n_tokens").alias("top"))
    room = F.greatest(F.lit(max_cost) * cap * cap, F.col("top") * F.col("top") + F.lit(max_cost) * (cap - F.col("top")) * (cap - F.col("top")))
    most = F.greatest(F.lit(16), (cap * max_docs_per_token).cast("long"))
    bad = lambda c: F.sum(c.cast("long"))
    of_bins = per.groupBy("container_kind").agg(bad(F.col("t") > cap).alias("n_overfull"), bad(F.col("d") > most).alias("n_crowded"), bad(F.col("q") > room).alias("n_costly"))
    doc = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("pieces"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end"))
    doc = doc.join(counts.select("doc_id", F.col("n_tokens").alias("all")), "doc_id", "full")
    of_docs = doc.groupBy("container_kind").agg(
        F.count("*").alias("n_documents"), bad((F.col("pieces") > 1) & (F.col("all") <= cap)).alias("n_split"), bad((F.col("t") != F.col("all")) | (F.col("end") != F.col("all")) | F.col("all").isNull()).alias("n_lost")
    )
    return of_docs.join(of_bins, "container_kind", "left").select("container_kind", "n_documents", "n_overfull", "n_crowded", "n_costly", "n_split", "n_lost")

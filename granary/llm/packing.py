"""Texts into containers of fixed capacity: best-fit decreasing with a segment tree over remaining capacities.

Items are placed from the largest to the smallest, each into the open container whose room left is the tightest that
holds it, else into a new one.  A leaf of the tree stands for an amount of room and knows whether an open container has
just that much; the tightest fit is the first such leaf from the item's size on, found in logarithmic time.  Two items
in one container are kept apart by a separator, so an item takes its size and a separator of a room that is one
separator larger.  Only a text that is larger than a container is cut, into full containers and a rest.

Scale: texts are counted once and only (id, tokens) travels on.  Items are packed in shards of about ``shard_rows``
documents by a hash of the id, so that no task holds more, whatever the table's size; each shard leaves at most a few
containers that are not full, which is the price against one single packing (``containers_bound`` tells how little).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.lineage import cut

#: Place of the vocabulary of a public byte-level tokenizer (ranks, one token a line); read by the driver, sent to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts texts into words for that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Room:
    """Segment tree over amounts of room 0..capacity; a leaf counts the open containers with that room."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, container: int) -> None:
        self.open.setdefault(room, []).append(container)
        node = room + self.width
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(room, container) with the least room that is at least ``need``; it is taken out."""
        count, node = self.count, need + self.width
        if node >= 2 * self.width:
            return None
        while not count[node]:
            while node & 1:  # a right child: what is larger lies to the right of an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.width:
            node <<= 1
            if not count[node]:
                node += 1
        room = node - self.width
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit(sizes: list[tuple[int, int]], capacity: int, separator: int) -> list[tuple[int, int, int, int, int]]:
    """(container, id, part, start, tokens) for (id, tokens); containers are numbered from 0.

    Larger first, equal ones in the order of ids.  Parts of a cut text are numbered from 0 with their first token.
    """
    out: list[tuple[int, int, int, int, int]] = []
    items: list[tuple[int, int, int, int]] = []
    number = 0
    for i, size in sizes:
        part = start = 0
        if size > capacity:
            while size - start >= capacity:
                out.append((number, i, part, start, capacity))
                number, part, start = number + 1, part + 1, start + capacity
        if size > start:
            items.append((start - size, i, part, start))
    items.sort()
    room = Room(capacity + separator)
    for less, i, part, start in items:
        need = separator - less
        fit = room.tightest(need)
        if fit is None:
            fit = capacity + separator, number
            number += 1
        out.append((fit[1], i, part, start, -less))
        room.add(fit[0] - need, fit[1])
    return out


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document with an id and a text that is not empty; of repeated rows the longest text counts."""
    with open(vocabulary, "rb") as file:
        ranks = dict(line.split() for line in file if line.strip())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in ranks.items()}, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in pdf["text"]]})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text <> ''")
    return texts.mapInPandas(count, "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def kinds_of(containers: DataFrame, limit: int = 1000) -> list[tuple[str, int, int]]:
    """(container_kind, capacity_tokens, separator_tokens), which the driver needs; more than ``limit`` kinds is an error, not a cut."""
    rows = containers.select("container_kind", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("s")).filter("container_kind is not null and capacity_tokens > 0").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} kinds of containers")
    return sorted((r[0], int(r[1]), int(r[2])) for r in rows)


def packed(docs: DataFrame, containers: DataFrame, *, vocabulary: str = VOCABULARY, shard_rows: int = 50_000) -> DataFrame:
    """(container_kind, shard, container_no, doc_id, part, start_token, tokens): every token of every text once per kind.

    Kinds with a null name or no capacity hold nothing, a null separator is none; empty and null texts take no place.
    """
    kinds = kinds_of(containers)
    sizes = cut(token_counts(docs, vocabulary=vocabulary))
    shards = max(1, -(-sizes.count() // shard_rows))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine: dict[int, list[tuple[int, int]]] = {}
        for pdf in batches:
            for shard, group in pdf.groupby("shard"):
                mine.setdefault(int(shard), []).extend(zip(group["doc_id"].tolist(), group["tokens"].tolist(), strict=True))
        for shard, items in mine.items():
            for kind, capacity, separator in kinds:
                out = pd.DataFrame(best_fit(items, capacity, separator), columns=["container_no", "doc_id", "part", "start_token", "tokens"])
                yield out.assign(container_kind=kind, shard=shard)[["container_kind", "shard", "container_no", "doc_id", "part", "start_token", "tokens"]]

    sharded = sizes.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return sharded.mapInPandas(pack, "container_kind string, shard int, container_no bigint, doc_id bigint, part int, start_token bigint, tokens bigint")


def fill_rates(docs: DataFrame, containers: DataFrame, **options) -> DataFrame:
    """Per kind: containers, items, tokens, the share of all room that is used, and the least number of containers any packing needs."""
    bins = packed(docs, containers, **options).groupBy("container_kind", "shard", "container_no").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    kinds = containers.select("container_kind", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("s")).distinct()
    total = bins.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    # every item and its separator, in rooms of one separator more
    bound = F.ceil((F.col("tokens") + F.col("items") * F.col("s")) / (F.col("capacity_tokens") + F.col("s")))
    return total.join(kinds, "container_kind").select("container_kind", "containers", "items", "tokens", F.round(F.col("tokens") / room, 6).alias("fill"), bound.alias("containers_bound"))

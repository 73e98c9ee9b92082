"""Filling fixed-capacity containers by sum-of-squares packing.

Items arrive one by one. Each goes to the fill level that minimises the sum
over all levels of the squared number of partially filled containers at that
level; the numbers stand in an array indexed by level. Items larger than the
capacity are cut into full pieces, which fill containers alone, and a rest.

Items are spread by a hash of their key over blocks of a bounded number of
items, so that no block, source or key can grow into a large task. Each block
packs on its own. Containers that are as good as full are settled; the items of
the others, a small part, are packed again in fewer blocks, as long as that brings
items together that were apart. An item is written once a round it takes part in,
and rounds are united, not joined.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.session import cut

BLOCK_ITEMS = 40_000
#: A container with more than this share of its space left is packed again with those of other blocks.
LOOSE = 0.02
#: Characters of a text that are encoded at once, up to the next place where it can be cut.
PIECE = 100_000
#: A blank before a letter and after a letter or digit: the pattern starts a token there.
_CUT = re.compile(r"(?<=[^\W_]) (?=[^\W\d_])")
#: Containers of a block are numbered below this.
_STRIDE = 1 << 32


@cache
def _encoding(path: str | None):
    """The byte-level BPE of a public vocabulary file of ranks; the default file is the installed 50k vocabulary."""
    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str | None = None) -> int:
    """Tokens of a whole text. A long one is encoded in pieces, cut only before a blank after a letter or digit, which no token spans; the count is exact."""
    if not text:
        return 0
    encode = _encoding(path).encode_ordinary
    total, at = 0, 0
    while at < len(text):
        cut_ = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut_.start() if cut_ else len(text)
        total += len(encode(text[at:end]))
        at = end
    return total


def token_counts(df: DataFrame, key: str, text: str, tokenizer_path: str | None = None) -> DataFrame:
    """(key, n_tokens) per document; NULL and empty texts have 0 tokens. Only counts leave the Python workers."""

    @F.pandas_udf("bigint")
    def count(column: pd.Series) -> pd.Series:
        return column.map(lambda t: count_tokens(t, tokenizer_path)).astype("int64")

    return df.select(key, count(F.coalesce(F.col(text), F.lit(""))).alias("n_tokens"))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, in order, and the fill of each container.

    Of equally good levels the fullest is taken. Items without size go to the
    last used container.
    """
    levels = np.zeros(capacity + 1, np.int64)
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    place = np.empty(len(sizes), np.int64)
    last = -1
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        if s == 0 and last >= 0:
            place[i] = last
            continue
        best, level = (never, 0) if s == 0 else (2 * int(levels[s]) + 1 if s < capacity else 0, 0)
        if 0 < s < capacity:
            now, then = levels[1 : capacity - s + 1], levels[s + 1 : capacity + 1]
            change = 2 * (then - now) + 2
            change[-1] = 1 - 2 * now[-1]  # the container is full and no longer counts
            change = np.where(now > 0, change, never)[::-1]
            k = int(change.argmin())
            if change[k] <= best and change[k] < never:
                level = capacity - s - k
        if level:
            container = at_level[level].pop()
            levels[level] -= 1
        else:
            container = len(fill)
            fill.append(0)
        fill[container] += s
        place[i] = last = container
        if fill[container] < capacity:
            at_level[fill[container]].append(container)
            levels[fill[container]] += 1
    return place, np.array(fill, np.int64)


def _pack_blocks(items: DataFrame, blocks: dict[int, int], first: int) -> DataFrame:
    """items (s, capacity, id, part, size) with container and the container's fill; ``blocks`` per s, numbered from ``first`` on; in the order of a hash."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["o", "id", "part"], kind="stable")
        sizes = pdf["size"].to_numpy()
        order = np.argsort(sizes == 0, kind="stable")
        place, fill = np.empty(len(pdf), np.int64), None
        own, fill = sum_of_squares(sizes[order], int(pdf["capacity"].iloc[0]))
        place[order] = own
        return pd.DataFrame({"s": pdf["s"], "capacity": pdf["capacity"], "id": pdf["id"], "part": pdf["part"], "size": pdf["size"], "container": (first + pdf["b"]) * _STRIDE + place, "fill": fill[place]})

    number = F.lit(1)
    for s, n in blocks.items():
        number = F.when(F.col("s") == s, n).otherwise(number)
    keyed = items.withColumns({"b": F.pmod(F.xxhash64("id", "part", F.lit(5 + first)), number), "o": F.xxhash64("id", "part", F.lit(23 + first))})
    return keyed.groupBy("s", "b").applyInPandas(one, "s bigint, capacity bigint, id bigint, part bigint, size bigint, container bigint, fill bigint")


def pack(sized: DataFrame, key: str, specs: DataFrame, size: str = "n_tokens", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(spec_id, key, piece, piece_tokens, container_id) for every document and every capacity.

    ``sized`` holds one row per integer key; ``specs`` holds spec_id and
    capacity_tokens. A document within the capacity is one piece (piece 0) and
    is never cut; a larger one is cut into full pieces and a rest. Documents
    without tokens get a container as well. NULL keys, NULL or negative sizes
    and NULL or non-positive capacities are left out. Repeated rows count once.
    Empty tables give no row.
    """
    spec_rows = specs.select(F.col("spec_id").cast("bigint").alias("s"), F.col("capacity_tokens").cast("bigint").alias("capacity")).filter("s IS NOT NULL AND capacity > 0").distinct()
    docs = sized.select(F.col(key).cast("bigint").alias("id"), F.col(size).cast("bigint").alias("n")).filter("id IS NOT NULL AND n >= 0").distinct()
    docs = cut(docs)  # sizes are measured once for all capacities
    per_spec = [docs.withColumns({"s": F.lit(r.s).cast("bigint"), "capacity": F.lit(r.capacity).cast("bigint")}) for r in spec_rows.collect()]
    if not per_spec:
        return docs.selectExpr("CAST(NULL AS BIGINT) AS spec_id", f"id AS `{key}`", "n AS piece", "n AS piece_tokens", "'' AS container_id").limit(0)
    cross = per_spec[0]
    for other in per_spec[1:]:
        cross = cross.unionByName(other)
    pieces = cross.select(
        "s", "capacity", "id", F.explode(F.expr("sequence(0L, greatest(0L, (n - 1) div capacity))")).alias("part"), "n"
    ).withColumn("size", F.expr("least(capacity, n - part * capacity)"))
    full = pieces.filter("size = capacity")
    rest = pieces.filter("size < capacity").drop("n")

    n_docs = docs.count()
    blocks = {r.s: max(1, -(-n_docs // block_items)) for r in spec_rows.collect()}  # a document has one rest at most per capacity
    first = 0
    placed = cut(_pack_blocks(rest, blocks, first))
    settled: list[DataFrame] = []
    while max(blocks.values()) > 1:
        loose = placed.filter(F.col("capacity") - F.col("fill") > F.col("capacity") * LOOSE)
        fewer = {r.s: max(1, -(-r["count"] // block_items)) for r in loose.groupBy("s").count().collect()}
        fewer = {s: n for s, n in fewer.items() if n <= blocks[s] * 0.8}
        if not fewer:  # the blocks are kept bounded, so nothing more can come together
            break
        again = (F.col("capacity") - F.col("fill") > F.col("capacity") * LOOSE) & F.col("s").isin(list(fewer))
        settled.append(placed.filter(~again))
        first += max(blocks.values())
        blocks = fewer
        placed = cut(_pack_blocks(placed.filter(again).select("s", "capacity", "id", "part", "size"), blocks, first))
    for more in settled:
        placed = placed.unionByName(more)
    # A full piece is its own container, named apart from those of the blocks.
    alone = full.select("s", "id", "part", "size", F.concat(F.lit("full-"), F.col("id"), F.lit("-"), F.col("part")).alias("container"))
    shared = placed.select("s", "id", "part", "size", F.concat(F.lit("shared-"), F.col("container")).alias("container"))
    out = shared.unionByName(alone)
    return out.select(F.col("s").alias("spec_id"), F.col("id").alias(key), F.col("part").alias("piece"), F.col("size").alias("piece_tokens"), F.col("container").alias("container_id"))

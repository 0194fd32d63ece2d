"""Documents into sequences of fixed capacity: vector best fit.

Sizes are tokens of the public byte-level BPE of 50,257 tokens known as gpt2 (here from
byte_bpe_50k.tiktoken, whose path on the driver is a parameter).
Documents fall into groups of about GROUP_DOCS by a hash of their id; a task packs
one group for one capacity, longest documents first. Every open sequence has three
residual capacities: tokens, documents, and attention cost (the sum of squared
lengths). Among all open sequences that can take a document under all three, the one
with the least weighted norm of what would remain takes it; if none can, a new sequence
is opened. All three bind: a sequence takes at most one document per TOKENS_PER_DOC
tokens of capacity, and more than one only up to ATTENTION of the attention cost of a
full document.

A document larger than a sequence is split into full pieces and a rest; only it is
ever split. A group leaves at most its last few sequences unfilled, so the groups
cost next to no room, and the number of groups grows with the corpus.

Defined results: null and empty texts have no tokens and lie in no sequence, blank
ones do; repeated documents are placed each; rows of pack_limits with a null or
non-positive capacity give nothing; extra columns are not read.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import ship, spread

GROUP_DOCS = 25_000
#: Weights of the residuals of tokens, documents and attention in the norm.
WEIGHTS = (1.0, 0.02, 0.05)
#: A sequence holds at most one document per so many tokens of capacity (LEAST_DOCS at least), and several only up to this share of the attention cost of one full document.
TOKENS_PER_DOC, LEAST_DOCS, ATTENTION = 64, 16, 0.9

TOKENIZER = os.environ.get("MARGINALIA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def from_ranks(content: bytes):
    """The encoding that a file of ranks describes; a worker builds it once."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str = TOKENIZER):
    with open(path, "rb") as f:
        return from_ranks(f.read())


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(encoding(path).encode_ordinary(text))


def pack(sizes: list[tuple[int, int]], capacity: int, docs: int | None = None, attention: float | None = None) -> list[tuple[int, int, int, int, int, int]]:
    """sizes: (doc_id, tokens). Gives (sequence, doc_id, piece, first_token, n_tokens, position) for every piece. docs and attention: capacities of a sequence (infinite ones switch them off)."""
    docs = docs or max(LEAST_DOCS, capacity // TOKENS_PER_DOC)
    attention = attention or ATTENTION * capacity * capacity
    wt, wd, wa = WEIGHTS
    out: list[tuple[int, int, int, int, int, int]] = []
    pieces: list[tuple[int, int, int, int]] = []
    n_seq = 0
    for doc, n in sizes:
        k = start = 0
        while n - start >= capacity:
            out.append((n_seq, doc, k, start, capacity, 0))
            n_seq, k, start = n_seq + 1, k + 1, start + capacity
        if n - start > 0:
            pieces.append((n - start, doc, k, start))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    least = pieces[-1][0] if pieces else 0
    # residual tokens, documents and attention of the open sequences, and their numbers
    room = np.zeros((3, max(16, len(pieces))))
    seq = np.zeros(room.shape[1], dtype=np.int64)
    n_open = closed = 0
    weights, limits = np.array([[wt], [wd], [wa]]), np.array([[capacity], [docs if np.isfinite(docs) else 1e18], [attention if np.isfinite(attention) else 1e36]])
    for n, doc, k, start in pieces:
        r = room[:, :n_open]
        need = np.array([[n], [1.0], [float(n) * n]])
        fits = np.flatnonzero((r >= need).all(axis=0))
        if len(fits):
            left = (r[:, fits] - need) / limits
            at = fits[np.argmin((weights * left * left).sum(axis=0))]
        else:
            at = n_open
            n_open += 1
            room[:, at], seq[at] = (capacity, docs, max(attention, float(n) * n)), n_seq
            n_seq += 1
        out.append((int(seq[at]), doc, k, start, n, int(capacity - room[0, at])))
        room[:, at] -= need[:, 0]
        if room[0, at] < least or room[1, at] < 1 or room[2, at] < least * least:
            room[0, at] = -1.0
            closed += 1
            if closed > 64 and closed * 4 > n_open:
                keep = np.flatnonzero(room[0, :n_open] >= 0)
                room[:, : len(keep)], seq[: len(keep)] = room[:, keep], seq[keep]
                n_open, closed = len(keep), 0
    return out


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of the texts that have any."""

    spark = documents.sparkSession
    ship(spark)
    with open(path, "rb") as f:  # on the driver only: the tasks get its content (under 1 MB)
        ranks = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = from_ranks(ranks.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(e.encode_ordinary(t)) for t in b["text"]]})

    return spread(documents.where("text <> ''").select("doc_id", "text")).mapInPandas(count, "doc_id long, n_tokens long")


def packed(documents: DataFrame, limits: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """limit_id, sequence_id, doc_id, piece, first_token, n_tokens, position (in the sequence)."""
    spark = documents.sparkSession
    schema = "limit_id long, sequence_id long, doc_id long, piece int, first_token long, n_tokens long, position long"
    tasks = [(r["limit_id"], r["capacity_tokens"]) for r in limits.select("limit_id", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()]
    if not tasks:
        return spark.createDataFrame([], schema)
    groups = max(1, -(-documents.count() // GROUP_DOCS))
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for i, c in tasks])).alias("t")
    items = token_counts(documents, path).where("n_tokens > 0").select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), each).select("doc_id", "n_tokens", "g", "t.limit_id", "t.capacity")

    def fill(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        limit, group = key
        rows = pack(list(zip(g["doc_id"].tolist(), g["n_tokens"].tolist())), int(g["capacity"].iloc[0]))
        out = pd.DataFrame(rows, columns=["sequence_id", "doc_id", "piece", "first_token", "n_tokens", "position"])
        out["sequence_id"] += int(group) * 1_000_000_000
        out.insert(0, "limit_id", limit)
        return out

    return items.groupBy("limit_id", "g").applyInPandas(fill, schema)


def fill_report(documents: DataFrame, limits: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per capacity: documents, sequences, tokens, unused room and the share filled."""
    p = packed(documents, limits, path).groupBy("limit_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("sequence_id").alias("n_sequences"), F.sum("n_tokens").alias("n_tokens"))
    room = F.col("n_sequences") * F.col("capacity_tokens")
    return p.join(F.broadcast(limits.select("limit_id", "capacity_tokens").distinct()), "limit_id").select("limit_id", "n_docs", "n_sequences", "n_tokens", (room - F.col("n_tokens")).alias("n_unused"), F.round(F.col("n_tokens") / room, 6).alias("share_filled"))

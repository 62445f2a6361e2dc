"""Token counts by section, attributed by offsets.

Every document is encoded once and whole. Token spans follow from the tokens' byte lengths, sections are byte spans
of the same text, and the two sorted lists are joined by interval. A token inside one section counts there; one
that crosses a boundary goes to the section that holds most of its bytes, the earlier one on a tie. Bytes outside
all sections form the unattributed rest.

By default the sections are the text's lines, each with its line feed. Other sections come as a column of
array<struct<start, end>> in code points, ordered and disjoint.

Defined cases: a null or empty text has no tokens and, by default, no sections; a section without tokens counts 0;
very long texts and words are encoded whole; repeated rows are rows of their own; an empty table gives an empty
result; other columns are ignored. The vocabulary's path is a parameter; nothing is trained.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<long>"


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    """The encoding and each token's length in bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines of UTF-8 text, each with its line feed."""
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64), ends.astype(np.int64)


def byte_offsets(raw: np.ndarray) -> np.ndarray:
    """The byte at which each code point starts, and the text's length."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Tokens per section, tokens that cross a boundary, tokens that touch no section."""
    counts = np.zeros(len(starts), np.int64)
    if not len(token_ends):
        return counts, 0, 0
    begin = np.concatenate([[0], token_ends[:-1]])
    if not len(starts):
        return counts, 0, len(token_ends)
    first = np.searchsorted(ends, begin, "right")  # the first section that ends after the token's start
    last = np.searchsorted(starts, token_ends, "left") - 1  # the last one that starts before its end
    within = first == last
    inside = within & (starts[np.minimum(first, len(starts) - 1)] <= begin) & (token_ends <= ends[np.minimum(first, len(ends) - 1)])
    np.add.at(counts, first[within], 1)
    crossing = np.flatnonzero(first < last)
    for t in crossing:
        s = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[s], token_ends[t]) - np.maximum(starts[s], begin[t])
        counts[s[np.argmax(share)]] += 1
    return counts, int(len(token_ends) - inside.sum() - (first > last).sum()), int((first > last).sum())


def attribute_tokens(docs: DataFrame, sections: str | None = None, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, n_outside, section_tokens."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, lengths = encoder(path, pattern)
        for frame in frames:
            rows = []
            for i, text in enumerate(frame["text"]):
                text = text if isinstance(text, str) else ""
                raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                ends = np.cumsum(lengths[np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)]) if text else np.zeros(0, np.int64)
                if len(ends) and ends[-1] != len(raw):
                    raise ValueError("the tokens don't cover the text")
                if sections is None:
                    starts, stops = line_spans(raw)
                else:
                    spans = frame[sections].iloc[i]
                    at = byte_offsets(raw)
                    spans = np.array([(s["start"], s["end"]) for s in (spans if spans is not None else ())], np.int64).reshape(-1, 2)
                    starts, stops = at[np.clip(spans[:, 0], 0, len(at) - 1)], at[np.clip(spans[:, 1], 0, len(at) - 1)]
                counts, crossing, outside = attribute(ends, starts, stops)
                rows.append((len(ends), len(starts), crossing, outside, counts))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"])
            out.insert(0, "doc_id", frame["doc_id"].array)
            yield out

    text_batches(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns, *([sections] if sections else [])).mapInPandas(count, SCHEMA)

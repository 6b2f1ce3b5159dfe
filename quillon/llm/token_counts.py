"""Token counts by section, from one encoding of each whole document.

A text is encoded once. The byte lengths of its tokens place every token in the text; sections are
spans of it, and the two are joined as sorted intervals. Boundaries are settled by one rule: a token
belongs to the section that holds its first character; if no section holds that, to the one that
holds its last character; else it lies between sections. So every token counts exactly once, and
no count depends on how a section would be encoded alone.

Sections are lines with a word: the first is the head, the others are the body.

Defined cases: a null or empty text has no tokens and no sections; repeated rows are counted each by
itself; special tokens' strings in a text are ordinary text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"


@cache
def encoder(path: str):
    """(encoding, byte length of each token) of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def line_sections(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines with a word, without their line ends."""
    cuts = np.flatnonzero(data == 0x0A)
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    words = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    held = words[ends] > words[starts]
    return starts[held], ends[held]


def attribute(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section (-1: between sections), and whether it crosses a section's edge.
    Sections are sorted and don't overlap."""
    if not len(starts):
        return np.full(len(token_starts), -1), np.zeros(len(token_starts), bool)

    def holding(at: np.ndarray) -> np.ndarray:
        i = np.searchsorted(starts, at, "right") - 1
        return np.where((i >= 0) & (at < ends[np.maximum(i, 0)]), i, -1)

    first, last = holding(token_starts), holding(token_ends - 1)
    return np.where(first >= 0, first, last), first != last


def count_text(text: str | None, path: str) -> tuple[int, list[int], int, int]:
    """Tokens, tokens by section, tokens between sections, tokens that cross an edge."""
    if not text:
        return 0, [], 0, 0
    coding, lengths = encoder(path)
    ids = np.array(coding.encode_ordinary(text), np.int64)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    token_ends = np.cumsum(lengths[ids])
    starts, ends = line_sections(data)
    section, crosses = attribute(token_ends - lengths[ids], token_ends, starts, ends)
    by = np.bincount(section + 1, minlength=len(starts) + 1)
    return len(ids), by[1:].tolist(), int(by[0]), int(crosses.sum())


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, n_sections, head_tokens, body_tokens,
    between_tokens, crossing_tokens, section_tokens (in order)."""
    path = path or vocabulary_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "n_sections", "head_tokens", "body_tokens", "between_tokens", "crossing_tokens", "section_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count_text(t.as_py(), path) for t in b.column("text")]
            longs = [[r[0] for r in rows], [len(r[1]) for r in rows], [sum(r[1][:1]) for r in rows], [sum(r[1][1:]) for r in rows], [r[2] for r in rows], [r[3] for r in rows]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in longs), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", section_tokens array<long>")

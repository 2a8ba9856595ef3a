"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that stands inside no token of the vocabulary can never be joined, so a piece of text
may be cut there and the fragments encoded on their own. Fragments are encoded together, a step of
merges at a time over arrays, and kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from watchline.llm.common import steps

#: Fixed value: the published pre-splitting pattern of this vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps encoded before it starts anew.
KEPT_PIECES = 200_000
#: Bytes of text of one step; a piece takes many times its bytes.
TEXT_BYTES = 1 << 20


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files of this kind."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes texts with the vocabulary file at ``path``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = printable_bytes()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = as_bytes(token)
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.decimal = [str(i) for i in range(size)]
        self.byte_id = np.array([vocab[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        keys, ranks, made = [], [], []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            keys.append(vocab[left] << 32 | vocab[right])
            ranks.append(rank)
            made.append(vocab[left + right])
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = (np.array(x, np.int64)[order] for x in (keys, ranks, made))
        self.none = len(keys)
        self.joins = np.zeros((256, 256), bool)  # pairs of bytes that stand inside some token
        for i, token in enumerate(self.token_bytes):
            if i not in self.special.values():
                for a, b in zip(token, token[1:], strict=False):
                    self.joins[a, b] = True
        lengths = np.array([len(t) for t in self.token_bytes], np.int64)
        self.lengths, self.begins = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.table = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.pieces = regex.compile(PIECES)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}

    def fragments(self, data: np.ndarray, piece_starts: np.ndarray) -> np.ndarray:
        """Starts of the fragments of concatenated pieces: the pieces' own, and the forced cuts."""
        cut = np.zeros(len(data), bool)
        cut[1:] = ~self.joins[data[:-1], data[1:]]
        cut[piece_starts] = True
        return np.flatnonzero(cut)

    def merged(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments of bytes, and the fragment of each id; all fragments take a merge at a time."""
        ids = self.byte_id[data]
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
        done_ids, done_owner = [], []
        while len(ids):
            rank = np.full(len(ids), self.none, np.int64)
            made = np.zeros(len(ids), np.int64)
            same = owner[:-1] == owner[1:]
            at = np.flatnonzero(same)
            key = ids[at] << 32 | ids[at + 1]
            slot = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
            known = self.keys[slot] == key
            rank[at[known]], made[at[known]] = self.ranks[slot[known]], self.made[slot[known]]
            first = np.flatnonzero(np.append(True, ~same))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = least == self.none
            if over.any():  # nothing more to merge in these fragments
                done_ids.append(ids[over])
                done_owner.append(owner[over])
            hit = (rank == least) & ~over
            # Of hits that overlap (a pair of equal ids in a run), every other one counts, from the left.
            run = np.flatnonzero(hit)
            if len(run):
                new = np.append(True, np.diff(run) > 1)
                place = np.arange(len(run)) - np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
                run = run[place % 2 == 0]
            ids = ids.copy()
            ids[run] = made[run]
            keep = ~over
            keep[run + 1] = False
            ids, owner = ids[keep], owner[keep]
        if not done_ids:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces and keep their ids."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        piece_starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])[:-1]]).astype(np.int64)
        starts = self.fragments(data, piece_starts)
        ids, fragment = self.merged(data, starts)
        piece = np.searchsorted(piece_starts, starts, side="right")[fragment] - 1
        bounds = np.searchsorted(piece, np.arange(len(raw) + 1))
        packed = ids.astype("<i4").tobytes()
        for i, p in enumerate(pieces):
            self.kept[p] = packed[4 * bounds[i] : 4 * bounds[i + 1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split: list[list[tuple[int, list[str]]]] = []
        missing: dict[str, None] = {}
        if len(self.kept) > KEPT_PIECES:
            self.kept = {}
        for text in texts:
            parts = []
            for part in self.stops.split(text) if self.stops else [text]:
                if part in self.special:
                    parts.append((self.special[part], []))
                elif part:
                    found = self.pieces.findall(part)
                    missing.update((p, None) for p in set(found) if p not in self.kept)
                    parts.append((-1, found))
            split.append(parts)
        if missing:
            self.learn(list(missing))
        look = self.kept.__getitem__
        out = []
        for parts in split:
            packed = [np.int32(i).tobytes() if i >= 0 else b"".join(map(look, found)) for i, found in parts]
            out.append(np.frombuffer(b"".join(packed), "<i4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.begins[ids] - (ends - lengths), lengths)
        return self.table[at].tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_table(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, and its ``ids`` if asked for.

    A null text counts as empty: no tokens, and the digests of the empty string. Rows keep their number;
    repeated rows and null ids are encoded as they stand. Other columns are left out.
    ``vocabulary`` is the file's path on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in steps(batches, step_bytes=TEXT_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = own.encode(texts)
            ids_sha, decoded_sha = [], []
            for ids in rows:
                listed = ",".join([own.decimal[i] for i in ids.tolist()])
                ids_sha.append(hashlib.sha256(listed.encode()).hexdigest())
                text = own.decode(ids).decode("utf-8", "replace")
                decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array([len(x) for x in rows], pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)

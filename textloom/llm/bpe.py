"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut into pieces by the tokenizer's pattern; each distinct piece is
encoded once per task. The symbols of many pieces lie in one flat array. A round
looks up every neighbouring pair by binary search over the sorted pair keys,
finds the lowest rank of each piece, merges all its occurrences from the left
and closes the gaps. Pieces without a mergeable pair leave the array.

A piece of more than LONG bytes would take one round for each of its ranks, over
all of its symbols. Such pieces keep linked positions by rank instead: a round
takes the lowest rank left and touches only the places where it stands.

The vocabulary file is read by the driver (its path is a parameter) and its
tables, whose size is that of the vocabulary, are broadcast.
"""

from __future__ import annotations

import json
import re
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import texts

#: The published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern over U+0000 to U+024F, whose letters, numbers and white space are listed: several times as fast.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_NEAR = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\u024f]")
#: Distinct pieces that a task remembers; beyond it only those of the texts at hand stay.
CACHE = 60_000
#: Bytes of a piece from which rounds go by rank.
LONG = 512
_NONE = np.int64(1 << 40)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (public rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_tables(path: str) -> dict:
    """Arrays of a byte-level BPE vocabulary in the tokenizers library's JSON format."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"not a plain byte-level BPE: {path}")
    vocab, chars = model["vocab"], byte_chars()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
    keys = left << 32 | right
    order = np.argsort(keys, kind="stable")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that strip or match single words are not supported")
    back = {c: b for b, c in enumerate(chars)}
    tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in vocab.items():
        tokens[i] = bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
    for t, i in added.items():
        tokens[i] = t.encode()
    return {"keys": keys[order], "rank": order.astype(np.int64), "made": made[order], "byte": np.array([vocab[c] for c in chars], np.int64), "added": added, "tokens": tokens}


class Coder:
    """Encoder and decoder over broadcast tables; holds a bounded memory of pieces."""

    def __init__(self, tables: dict):
        self.t = tables
        self.pattern = regex.compile(PATTERN)
        names = sorted(tables["added"], key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.memory: dict = {}  # piece -> its number
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.empty(len(tables["tokens"]), object)
        self.tokens[:] = tables["tokens"]

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces and remember them."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        sym = self.t["byte"][np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.t["keys"], pair), len(self.t["keys"]) - 1)
            rank = np.where((self.t["keys"][at] == pair) & (owner[:-1] == owner[1:]), self.t["rank"][at], _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = low == _NONE
            if over.any():
                done.append((owner[over], sym[over]))
            hit = np.flatnonzero((rank == low) & ~over)
            if len(hit):  # a run of overlapping hits (a a a) takes every second one, from the left
                head = np.flatnonzero(np.r_[True, np.diff(hit) != 1])
                hit = hit[(np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))) % 2 == 0]
                sym = sym.copy()
                sym[hit] = self.t["made"][at[hit]]
                gone = over.copy()
                gone[hit + 1] = True
            else:
                gone = over
            sym, owner = sym[~gone], owner[~gone]
        if not done:
            return
        owner, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(raw) + 1))
        sym = sym[order].astype(np.int32)
        self._keep(pieces, sym, cut)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or _NONE, symbol made) of neighbouring symbols."""
        pair = a << 32 | b
        at = np.minimum(np.searchsorted(self.t["keys"], pair), len(self.t["keys"]) - 1)
        return np.where(self.t["keys"][at] == pair, self.t["rank"][at], _NONE), self.t["made"][at]

    def learn_long(self, piece: str) -> None:
        """Encode one long piece: places by rank, the lowest rank first."""
        sym = self.t["byte"][np.frombuffer(piece.encode(), np.uint8)]
        n = len(sym)
        sym = np.append(sym, -1)  # no pair reaches beyond the end
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            places = places[after[places] < n]
            rank, _ = self._ranked(sym[places], sym[after[places]])
            order = np.argsort(rank, kind="stable")
            rank, places = rank[order], places[order]
            edge = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1], True]) if len(rank) else ()
            for lo, hi in zip(edge, edge[1:]):
                r = int(rank[lo])
                if r < _NONE:
                    if r not in waiting:
                        waiting[r] = []
                        heappush(heap, r)
                    waiting[r].append(places[lo:hi])

        note(np.arange(n - 1))
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            rank, made = self._ranked(sym[at], sym[after[at]])
            at, made = at[rank == r], made[rank == r]
            if len(at):  # of a run of overlapping places every second one, from the left
                chained = np.r_[False, after[at[:-1]] == at[1:]]
                head = np.flatnonzero(~chained)
                pick = (np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % 2 == 0
                at, made = at[pick], made[pick]
                gone = after[at]
                sym[at], alive[gone] = made, False
                after[at] = after[gone]
                before[after[gone]] = at
                left = before[at]
                note(np.unique(np.r_[left[left >= 0], at]))
        ids = sym[:n][alive[:n]]
        self._keep([piece], ids, np.array([0, len(ids)]))

    def _keep(self, pieces: list, sym: np.ndarray, cut: np.ndarray) -> None:
        self.memory.update(zip(pieces, range(len(self.start), len(self.start) + len(pieces))))
        self.start = np.concatenate([self.start, cut[:-1] + len(self.flat)])
        self.size = np.concatenate([self.size, np.diff(cut)])
        self.flat = np.concatenate([self.flat, sym.astype(np.int32)])

    def _forget(self, wanted: set) -> None:
        """Keep the remembered pieces that are wanted now: frequent ones stay known."""
        kept = [p for p in wanted if p in self.memory]
        number = np.array([self.memory[p] for p in kept], np.int64)
        self.flat, cut = _taken(self.flat, self.start[number], self.size[number])
        self.start, self.size = cut[:-1], np.diff(cut)
        self.memory = dict(zip(kept, range(len(kept))))

    def pieces(self, text: str) -> list:
        """Pieces of a text; an added token stands as its id."""
        find = (self.pattern if _BEYOND.search(text) else _NEAR).findall
        if self.special is None or not self.special.search(text):
            return find(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += find(text[at : m.start()])
            out.append(self.t["added"][m[0]])
            at = m.end()
        return out + find(text[at:])

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, offsets by text)."""
        cut = [self.pieces(t) for t in batch]
        wanted = set().union(*cut)
        if len(self.memory) > CACHE:
            self._forget(wanted)
        fresh = [p for p in wanted if p not in self.memory and isinstance(p, str)]
        for p in fresh:
            if len(p) > LONG:
                self.learn_long(p)
        fresh = [p for p in fresh if len(p) <= LONG]
        for lo in range(0, len(fresh), 50_000):
            self.learn(fresh[lo : lo + 50_000])
        if whole := [p for p in wanted if p not in self.memory]:
            self._keep(whole, np.array(whole), np.arange(len(whole) + 1))
        n = [len(c) for c in cut]
        number = np.array(list(map(self.memory.__getitem__, chain.from_iterable(cut))), np.int64)
        ids, end = _taken(self.flat, self.start[number], self.size[number])
        return ids, end[np.r_[0, np.cumsum(n)].astype(np.int64)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.tokens[ids].tolist()).decode("utf-8", "replace")


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of flat one after the other, their offsets)."""
    end = np.r_[0, np.cumsum(size)].astype(np.int64)
    return flat[np.repeat(start - end[:-1], size) + np.arange(end[-1])], end


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    """One coder for each vocabulary in a Python worker."""
    key = id(tables := shared.value)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(tables)
    return _coders[key]


@K.trimmed
def _encoded(iterator, shared, text: int):
    coder = _coder(shared)
    for batch in iterator:
        for lo, hi in K.batches(batch.column(text), 1 << 19):
            part = batch.slice(lo, hi - lo)
            apart = part.column(text).fill_null("").dictionary_encode()  # copies are encoded once
            ids, offs = coder.encode(apart.dictionary.to_pylist())
            which = apart.indices.to_numpy()
            ids, offs = _taken(ids, offs[which], np.diff(offs)[which])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))], [*part.schema.names, "ids"])


@K.trimmed
def _decoded(iterator, shared, column: int):
    coder = _coder(shared)
    for batch in iterator:
        lists = batch.column(column)
        offs, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        out = [coder.decode(values[a:b]) for a, b in zip(offs, offs[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """docs with one more column, ids array<int>: the tokens of the whole text.

    Same ids as the public tokenizers library without special tokens added; the
    strings of added tokens in a text become their ids. A null or empty text has
    no tokens. Columns named ids are replaced; repeated rows stay as they are.
    """
    docs = docs.drop("ids")
    shared = docs.sparkSession.sparkContext.broadcast(load_tables(tokenizer))
    at = docs.columns.index(text_col)
    schema = docs.withColumn("ids", F.expr("cast(null as array<int>)")).schema
    return docs.mapInArrow(lambda it: _encoded(it, shared, at), schema)


def decode(tokens: DataFrame, tokenizer: str, *, ids_col: str = "ids") -> DataFrame:
    """tokens with one more column, decoded: the text of ids_col, invalid UTF-8 replaced.

    A null or empty list gives an empty text; ids must be of the vocabulary.
    Columns named decoded are replaced; repeated rows stay as they are.
    """
    tokens = tokens.drop("decoded")
    shared = tokens.sparkSession.sparkContext.broadcast(load_tables(tokenizer))
    at = tokens.columns.index(ids_col)
    schema = tokens.withColumn("decoded", F.expr("cast(null as string)")).schema
    return tokens.mapInArrow(lambda it: _decoded(it, shared, at), schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    coded = decode(encode(texts(docs), tokenizer).drop("text"), tokenizer)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
